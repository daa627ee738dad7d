"""Phrases looked up in texts, links of texts, cached answers, sweeps that go on, differences of tables, invalid bytes."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..functions import markdown
from ..operators import phrases, runs, tables
from ..sources import shared
from .dialect import pair, table

# all runs of three words of the benchmark's items, in the order of items and places
PHRASE_WORDS = 3


def benchmark_phrases(spark, sf_dir: str):
    words = table(spark, sf_dir, "benchmark").select("item_id", F.expr("array_remove(split(text, ' '), '')").alias("w")).where(F.size("w") >= PHRASE_WORDS)
    each = words.select("item_id", F.explode(F.expr(f"transform(sequence(1, size(w) - {PHRASE_WORDS - 1}), i -> struct(i, array_join(slice(w, i, {PHRASE_WORDS}), ' ') as p))")).alias("x"))
    return each.select(F.expr("item_id * 100000 + x.i").alias("ord"), F.col("x.p").alias("phrase"))


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
pair("join_phrase_index", lambda s, d: phrases.first_phrase(table(s, d, "documents"), benchmark_phrases(s, d)), f"""with words as (select item_id, list_filter(string_split(text, ' '), lambda w: w <> '') as w from benchmark),
  p as materialized (select min(ord) as ord, phrase from (select item_id * 100000 + i as ord, {LOWER.format(f"array_to_string(w[i:i + {PHRASE_WORDS - 1}], ' ')")} as phrase from (select item_id, w, unnest(range(1, len(w) - {PHRASE_WORDS - 2})) as i from words) x) y group by phrase),
  d as materialized (select doc_id, {LOWER.format('text')} as text from documents)
  select doc_id, min(ord) as ord, arg_min(phrase, ord) as phrase from d join p on contains(text, phrase) where regexp_matches(text, '(^|[^a-z0-9])' || regexp_escape(phrase) || '($|[^a-z0-9])') group by doc_id""")


# texts with fences, links, images, code and links outside put at drawn lines
SPOT = "@draw(concat('md|', cast(doc_id as string), '|', cast(i as string)))"
MARKED = f"""case when {SPOT} % 11 = 0 then '```' when {SPOT} % 11 = 1 then '  ~~~ x' when {SPOT} % 11 = 4 then concat('[f](#top) ', x, ' [m](mailto:a@b.c)')
  when {SPOT} % 11 < 4 then concat(x, ' [a](doc-', cast({SPOT} % 3000 as string), '.md#p) and `[b](no.md)` ![c](img.png) [d](https://x.y/z) [e](doc-', cast({SPOT} div 7 % 3000 as string), '.md "t")') else x end"""


def marked_texts(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "x"))
    from .dialect import to_spark

    return docs.selectExpr("doc_id", "i", f"{to_spark(MARKED)} as x").groupBy("doc_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(i, x))), v -> v.x)"), "\n").alias("text"))


def broken(spark, sf_dir: str):
    known = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return markdown.broken_links(marked_texts(spark, sf_dir), known)


ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
pair("src_markdown_links", broken, f"""with planted as (select doc_id, string_agg({MARKED}, chr(10) order by i) as text from (select doc_id, x, (o - 1)::BIGINT as i from (select doc_id, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1) as o from documents where text is not null) k) l group by doc_id),
  numbered as (select doc_id, unnest(l) as x, generate_subscripts(l, 1) as line from (select doc_id, regexp_split_to_array(text, '{ENDS}') as l from planted) s),
  fenced as (select doc_id, line, x, regexp_matches(x, '^\\s*(```|~~~)') as fence, count(*) filter (regexp_matches(x, '^\\s*(```|~~~)')) over (partition by doc_id order by line rows unbounded preceding) as n from numbered),
  found as (select doc_id, line, unnest(regexp_extract_all(regexp_replace(x, '`[^`]*`', '', 'g'), '!?\\[[^\\]]*\\]\\([^)\\s]+(?:\\s+"[^"]*")?\\)')) as link from fenced where not fence and n % 2 = 0),
  targets as (select doc_id, line::INTEGER as line, regexp_extract(link, '\\]\\(([^)\\s]+)', 1) as target from found where link[1] <> '!')
  select doc_id, line, target from targets where not regexp_matches(target, '^(https?://|mailto:|#)') and split_part(target, '#', 1) not in (select 'doc-' || doc_id || '.md' from documents where doc_id is not null)""")


def cached_answers(spark, sf_dir: str):
    """Answers for all documents from a cache that an earlier run filled for those of even id."""
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.lit(7).alias("seed"))
    folder = shared.path_for(spark, "answer-cache")
    ask = lambda prompt, seed: hashlib.md5(f"{prompt}:{seed}".encode()).hexdigest()
    runs.answers(prompts.where("doc_id % 2 = 0"), folder, ask)
    return runs.answers(prompts, folder, ask).select("doc_id", "cache_key", "hit", "answer")


KEY = "substr(sha256(concat_ws(chr(10), 'model', 'system', text, '7')), 1, 16)"
pair("src_answer_cache", cached_answers, f"select doc_id, {KEY} as cache_key, {KEY} in (select {KEY} from documents where doc_id % 2 = 0) as hit, md5(coalesce(text, 'None') || ':7') as answer from documents")

#: Variants of an acceptance rule: the words that a text may have.
VARIANTS = [{"name": f"{low}-{high}", "low": low, "high": high} for low, high in ((1, 40), (1, 200), (20, 100), (20, 400), (60, 800), (100, 5000))]


def swept(spark, sf_dir: str):
    """How well each variant of the rule agrees with the labels of quality; the sweep is run in two parts, the second going on where the first ended."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("quality", F.size(F.expr("array_remove(split(text, ' '), '')")).alias("n"))

    def run(v: dict):
        kept = F.col("n").between(v["low"], v["high"])
        return rows.agg(F.count_if(kept).alias("kept"), F.count_if(kept == (F.col("quality") == 1)).alias("right"), F.count("*").alias("n"))

    folder, schema = shared.path_for(spark, "sweep"), "kept long, right long, n long"
    runs.sweep(spark, VARIANTS[: len(VARIANTS) // 2], folder, schema, run)
    return runs.sweep(spark, VARIANTS, folder, schema, run).select("variant", "kept", "right", "n")


COUNTED = "(select quality, len(list_filter(string_split(text, ' '), lambda w: w <> '')) as n from documents join labels using (doc_id))"
pair("sink_sweep_report", swept, " union all ".join(f"select '{v['name']}' as variant, count_if(n between {v['low']} and {v['high']})::BIGINT as kept, count_if((n between {v['low']} and {v['high']}) = (quality = 1))::BIGINT as right, count(*) as n from {COUNTED} c" for v in VARIANTS))


def two_versions(spark, sf_dir: str):
    """The documents and another version of them: some rows gone, some with other texts or sources, some new."""
    docs = table(spark, sf_dir, "documents")
    kept = docs.where("doc_id % 97 <> 1").withColumn("text", F.expr("if(doc_id % 89 = 2, concat(text, '.'), text)")).withColumn("source", F.expr("if(doc_id % 83 = 3, null, source)"))
    return docs, kept.union(docs.where("doc_id % 79 = 4").withColumn("doc_id", F.expr("doc_id + 1000000000")))


pair("join_table_diff", lambda s, d: tables.diff(*two_versions(s, d), "doc_id"), """with new as (select doc_id, case when doc_id % 89 = 2 then text || '.' else text end as text, lang, case when doc_id % 83 = 3 then null else source end as source, n_chars from documents where doc_id % 97 <> 1
  union all select doc_id + 1000000000, text, lang, source, n_chars from documents where doc_id % 79 = 4)
  select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' else 'changed' end as change
  from documents o full join new n on o.doc_id = n.doc_id where o.doc_id is null or n.doc_id is null or o.text is distinct from n.text or o.lang is distinct from n.lang or o.source is distinct from n.source or o.n_chars is distinct from n.n_chars""")

# bytes that are no UTF-8: a stray byte, a character cut short, one that is too long for its value, and one cut by a letter
SPOILT = [("FF", ""), ("E282", ""), ("C0AF", ""), ("F09041", "")]
BYTES = " ".join(f"when {k} then concat(encode(text, 'UTF-8'), X'{b}', encode(' end', 'UTF-8'))" for k, (b, _) in enumerate(SPOILT))


def repaired(spark, sf_dir: str):
    """Texts of bytes that are partly no UTF-8 as JSON: each longest invalid part becomes U+FFFD."""
    spoilt = table(spark, sf_dir, "documents").selectExpr("doc_id", f"case doc_id % {len(SPOILT)} {BYTES} end as bytes")
    return spoilt.select("doc_id", F.sha2(F.to_json(F.struct(F.expr("make_valid_utf8(cast(bytes as string))").alias("text")), {"ignoreNullFields": "false"}), 256).alias("sha256"))


MENDED = {0: "chr(65533)", 1: "chr(65533)", 2: "chr(65533) || chr(65533)", 3: "chr(65533) || 'A'"}
pair("fn_json_repair", repaired, f"select doc_id, sha256(to_json({{'text': text || case doc_id % {len(SPOILT)} {' '.join(f'when {k} then {v}' for k, v in MENDED.items())} end || ' end'}})::VARCHAR) as sha256 from documents")
