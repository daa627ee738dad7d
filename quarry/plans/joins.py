"""Joins: leak checks, lookups, first matches, skylines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus
from .dialect import add, pair, table

add("join_fresh_lines", "select lang, md5(text) as line from documents a where doc_id % 3 = 0 and not exists (select 1 from documents b where b.doc_id % 3 <> 0 and b.lang = a.lang and b.text = a.text)")
pair("join_anti_leak", lambda s, d: corpus.drop_leaks(table(s, d, "documents").where("doc_id % 4 = 0"), table(s, d, "documents").where("doc_id % 4 <> 0"), "text").select("doc_id"), "select doc_id from documents a where doc_id % 4 = 0 and not exists (select 1 from documents b where b.doc_id % 4 <> 0 and a.text = b.text)")
SPECS = "select 'en|src1|' as k, 'alpha' as option union all select 'en|src1|', 'beta' union all select 'fr|src2|', 'gamma' union all select 'de|src3|', 'delta'"
add("join_key_lookup", f"with specs as (select k, array_sort(collect_list(option)) as options from ({SPECS}) s group by k) select doc_id, element_at(options, cast(1 + @draw(concat('pick|', cast(doc_id as string))) % size(options) as int)) as picked from documents left join specs on concat_ws('|', lang, source, '') = specs.k")
#: Facts of our own by index, with phrases in lower case; a bounded table, so its phrases are literal patterns.
FACTS = {1: ["the thing", "anea"], 2: ["of the"], 3: ["and"], 4: ["les"]}
FIRST = " ".join(f"when regexp_like(low, '(^|[^a-z0-9])({'|'.join(phrases)})([^a-z0-9]|$)') then {i}" for i, phrases in FACTS.items())
add("join_phrase_retrieve", f"select conv_id, turn, case {FIRST} end as fact from (select conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from conversations) t")
MERGES = "select 't' as l, 'h' as r, 0 as rank union all select 'a', 'n', 1 union all select 'e', 'r', 2 union all select 'a', 'n', 9 union all select 'o', 'n', 3"
LETTERS = "(select doc_id, explode(transform(sequence(1, size(c) - 1), i -> concat(element_at(c, i), element_at(c, i + 1)))) as p from (select doc_id, split(text, '') as c from documents where length(text) > 1) s)"
add("join_merge_rank", f"with ranks as (select l, r, min(rank) as rank from ({MERGES}) m group by l, r) select doc_id, min(rank) as best, count(*) as pairs from {LETTERS} d join ranks on p = concat(l, r) group by doc_id")


def piece_ids(spark, sf_dir: str):
    """The place of each text's first word in the sorted vocabulary, or -1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.expr("get(array_remove(split(text, ' '), ''), 0)").alias("first"))
    words = docs.where("doc_id % 2 = 0").where(F.regexp_like("text", F.lit("^[A-Z][a-z]+ "))).select(F.col("first").alias("w")).distinct()
    placed = corpus.numbered(words, [], [F.col("w")])
    return docs.join(placed, docs["first"] == placed["w"], "left").select("doc_id", F.coalesce(F.col("__r") - 1, F.lit(-1)).alias("piece"))


pair("join_piece_id", piece_ids, "with pieces as (select w, row_number() over (order by w) - 1 as id from (select distinct element_at(@words(text), 1) as w from documents where doc_id % 2 = 0 and regexp_like(text, '^[A-Z][a-z]+ ')) p) select doc_id, coalesce(id, -1) as piece from (select doc_id, element_at(@words(text), 1) as first from documents) d left join pieces on d.first = pieces.w")
pair("join_pareto", lambda s, d: corpus.skyline(table(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_size", "p_retailprice"), "select p_partkey, p_size, p_retailprice from part a where not exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice))")


def frontier_first(spark, sf_dir: str):
    """Places of all parts, those of the skyline first, then by brand and key."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    front = corpus.skyline(parts, "p_size", "p_retailprice").select(F.col("p_partkey").alias("key"), F.lit(1).alias("frontier"))
    rows = parts.join(front, parts["p_partkey"] == front["key"], "left").select("p_partkey", "p_brand", F.coalesce("frontier", F.lit(0)).alias("frontier"))
    return corpus.numbered(rows, [], [F.col("frontier").desc(), F.col("p_brand"), F.col("p_partkey")]).select("p_partkey", F.col("__r").alias("place"))


pair("ord_frontier_first", frontier_first, """select p_partkey, row_number() over (order by frontier desc, p_brand, p_partkey) as place from (select a.p_partkey, a.p_brand, case when exists (select 1 from part b where b.p_size >= a.p_size and b.p_retailprice <= a.p_retailprice and (b.p_size > a.p_size or b.p_retailprice < a.p_retailprice)) then 0 else 1 end as frontier from part a) f""")
VARIANT = "concat('v', cast(doc_id % 6 as string))"
add("join_variant_report", f"""with evaluation as (select {VARIANT} as name, round(avg(case when doc_id % 3 = 0 then 1.0E0 else 0.0E0 end), 4) as quality from documents group by 1),
  manifest as (select {VARIANT} as name, count(*) as rows_kept from documents group by 1), estimate as (select {VARIANT} as name, max(length(text)) as bytes from documents group by 1),
  reply as (select {VARIANT} as name, round(avg(cast(size(split(text, ' ')) as double)), 6) as mean_len from documents group by 1)
  select evaluation.name, quality, rows_kept, bytes, mean_len from evaluation join manifest on evaluation.name = manifest.name join estimate on evaluation.name = estimate.name join reply on evaluation.name = reply.name""")
add("join_cross_keys", "select concat_ws('|', intent, device, cast(v as string)) as k from (select 'set' as intent union all select 'ask' union all select 'stop') i cross join (select 'light' as device union all select 'fan') d cross join (select explode(sequence(0, 14)) as v) n")
add("join_semi_unambiguous", "select role, line from (select distinct role, md5(text) as line from conversations) c where line in (select md5(text) from conversations group by 1 having count(distinct role) = 1)")
# every word of a text gathers a whole row of weights
GATHERED = "(select vec_id, label, {} as total, {} as squares from embeddings)"
ROW = "@fold(transform(embedding, v -> cast(v as double)), 0.0E0, (a, y) -> a + y)"
add("join_embedding_gather", f"select doc_id, count(*) as n, round(sum(total), 6) as total, round(sum(squares), 6) as squares from (select doc_id, @draw(w) % (select count(*) from embeddings) as tok from (select doc_id, explode(@words(text)) as w from documents) e) t join {GATHERED.format(ROW, ROW.replace('cast(v as double)', 'cast(v as double) * cast(v as double)'))} g on tok = vec_id group by doc_id")
pair("win_prev_turn", lambda s, d: corpus.before(table(s, d, "conversations").select("conv_id", "turn", "role", F.md5("text").alias("text")), "conv_id", ["turn"], ["role", "text"]).select("conv_id", "turn", F.col("before_role").alias("prev_role"), F.col("before_text").alias("prev_text")), "select conv_id, turn, lag(role) over (partition by conv_id order by turn) as prev_role, lag(md5(text)) over (partition by conv_id order by turn) as prev_text from conversations")
