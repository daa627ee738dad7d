"""Generated rows: reproducible draws, weighted choices, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus
from .dialect import add, pair, table

IDS = "(select explode(sequence(1, 3000)) as id)"
#: Weights of history lengths in percent, and sizes and seeds of the splits.
WEIGHTS = [(0, 45), (1, 30), (2, 15), (3, 10)]
SPLITS = [("train", 200000, 1), ("val", 4000, 2), ("test_id", 3000, 3), ("heldout", 3000, 4), ("robust", 3000, 5), ("multiturn", 2000, 6), ("safety", 2000, 7), ("teacher_test", 3000, 8), ("facts_heldout", 1000, 9), ("smalltalk_test", 1000, 10)]
LOW, RANGES = 0, []
for value, weight in WEIGHTS:
    RANGES.append(f"select {value} as v, {LOW} as lo, {LOW + weight} as hi")
    LOW += weight
add("gen_weighted_choice", f"with w as ({' union all '.join(RANGES)}) select id, v from (select id, @draw(concat('hist|', cast(id as string))) % 100 as u from {IDS} r) d join w on u >= lo and u < hi")
add("gen_turn_mix", f"select intent, count(*) as n, count_if(refers) as refers from (select case when u < 40 then 'set' when u < 70 then 'ask' when u < 90 then 'status' else 'chat' end as intent, @draw(concat('ref|', cast(id as string))) % 2 = 0 as refers from (select id, @draw(concat('intent|', cast(id as string))) % 100 as u from {IDS} r) d) m group by intent")
add("gen_frame_split", "select ord, frame from (select 1 as ord, 'put the <d> on' as frame, false as heldout union all select 2, 'could the <d> be off', true union all select 3, 'is the <d> on', false) f where not heldout")
add("gen_synthetic_fact", f"select id, case when @draw(concat('f|', cast(id as string))) % 10 < 3 then concat('the code of room ', cast(id % 90 as string), ' is ', cast(@draw(concat('c|', cast(id as string))) % 1000 as string)) else array_join(transform(sequence(1, 6), i -> element_at(array('oak', 'tin', 'map', 'fog', 'rug'), cast(1 + @draw(concat('w|', cast(id as string), '|', cast(i as string))) % 5 as int))), ' ') end as fact from {IDS} r")
TALKS = 200


def smalltalk(spark, sf_dir: str):
    """For each role as many drawn lines; lines are numbered over ranges, so that no role's lines meet in one task."""
    lines = table(spark, sf_dir, "conversations").select("role", F.md5("text").alias("line"), "conv_id", "turn")
    placed = corpus.numbered(lines, ["role"], [F.col("line"), F.col("conv_id"), F.col("turn")])
    roles = placed.groupBy("role").agg(F.max("__n").alias("n"))
    picks = roles.select("role", "n", F.explode(F.expr(f"sequence(1, {TALKS})")).alias("id")).select("role", "id", (corpus.draw(F.concat(F.lit("talk|"), F.col("id").cast("string"))) % F.col("n") + 1).alias("at"))
    picks = picks.withColumnsRenamed({"role": "__role", "at": "__at"})
    return placed.join(picks, F.col("role").eqNullSafe(F.col("__role")) & (F.col("__r") == F.col("__at"))).select("role", "id", "line")


pair("gen_smalltalk", smalltalk, f"with bank as (select role, md5(text) as line, row_number() over (partition by role order by md5(text), conv_id, turn) - 1 as r, count(*) over (partition by role) as n from conversations) select b.role, t.id, b.line from (select explode(sequence(1, {TALKS})) as id) t join bank b on b.r = @draw(concat('talk|', cast(t.id as string))) % b.n")
add("gen_split_sizes", " union all ".join(f"select '{n}' as split, {s} as seed, cast(greatest(4, floor({k} * 0.01E0)) as bigint) as n" for n, k, s in SPLITS))


def dataset(spark, sf_dir: str):
    """Documents to a dataset: cleaned, accepted, without repeats or leaks, split and shuffled."""
    accepted = F.size(F.split("text", " ")).between(10, 600)
    return corpus.build_dataset(table(spark, sf_dir, "documents"), accepted, {"val": 50, "test": 100}, "build|")


pair("gen_dataset_build", dataset, """with kept as (select k, min(doc_id) as doc_id, min(low) as low from (select doc_id, sha256(t) as k, sha256(lower(t)) as low from (select doc_id, trim(text, ' ') as t from documents) d where t <> '' and len(string_split(t, ' ')) between 10 and 600) e group by k),
  parts as (select doc_id, low, case when @draw(concat('build|', k)) % 1000 < 50 then 'val' when @draw(concat('build|', k)) % 1000 < 150 then 'test' else 'train' end as split from kept)
  select split, row_number() over (partition by split order by @draw(concat('build|', cast(doc_id as string))), doc_id) as place, doc_id from parts p where split = 'train' or not exists (select 1 from parts t where t.split = 'train' and t.low = p.low)""")
pair("udf_text_source", lambda s, d: corpus.answered(table(s, d, "documents").selectExpr("doc_id", "lang as prompt", "doc_id % 5 as seed"), lambda prompt, seed: f"{prompt}:{seed * seed}").select("doc_id", "answer"), "select doc_id, coalesce(lang, 'None') || ':' || ((doc_id % 5) * (doc_id % 5)) as answer from documents")

#: How often a correction stands, and how many rows of the original training set come with them.
REPEAT, REPLAY = 4, 300


def onpolicy(spark, sf_dir: str):
    """Documents whose quality a rule has wrong, four times, and a sample of the training documents, shuffled."""
    docs = table(spark, sf_dir, "documents")
    judged = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").withColumn("n", F.size(F.expr("array_remove(split(text, ' '), '')")))
    wrong = judged.where((F.col("n").between(20, 400)) != (F.col("quality") == 1))
    return corpus.onpolicy(wrong, docs.where("doc_id % 10 <> 0"), "doc_id", REPEAT, REPLAY, "onpolicy|")


DRAWN = "@draw(concat('onpolicy|', {}))"
pair("gen_onpolicy_build", onpolicy, f"""with wrong as (select doc_id from documents join labels using (doc_id) where (len(list_filter(string_split(text, ' '), lambda w: w <> '')) between 20 and 400) <> (quality = 1)),
  rows as (select 'correction' as kind, doc_id, unnest(range(1, {REPEAT + 1}))::INTEGER as copy from wrong union all select 'replay', doc_id, 0 from (select doc_id, row_number() over (order by {DRAWN.format('cast(doc_id as string)')}, doc_id) as r from documents where doc_id % 10 <> 0) o where r <= {REPLAY})
  select row_number() over (order by {DRAWN.format("concat(kind, cast(copy as string), cast(doc_id as string))")}, doc_id) as place, kind, copy, doc_id from rows""")
