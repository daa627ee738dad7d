"""Windows, ordered state, sorts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus
from .dialect import add, pair, table

def turns(spark, sf_dir: str):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split("text", " ")).cast("long").alias("n"))


def events(spark, sf_dir: str):
    return table(spark, sf_dir, "events")


N = "cast(size(split(text, ' ')) as bigint)"
pair("win_history_budget", lambda s, d: corpus.history_within(turns(s, d), "conv_id", "turn", F.col("n"), 80).select("conv_id", "turn"), f"select conv_id, turn from (select conv_id, turn, sum({N}) over (partition by conv_id order by turn desc rows unbounded preceding) as used from conversations) c where used <= 80")
pair("win_last_n_turns", lambda s, d: corpus.history_within(turns(s, d), "conv_id", "turn", F.col("n"), 400, 3).select("conv_id", "turn"), f"select conv_id, turn from (select conv_id, turn, sum({N}) over (partition by conv_id order by turn desc rows unbounded preceding) as used, row_number() over (partition by conv_id order by turn desc) as r from conversations) c where used <= 400 and r <= 3")


def packed(spark, sf_dir: str):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), F.length).alias("ids"))
    return corpus.packed_rows(rows, "doc_id", "ids", 129).select("row", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.col("ids")[0].cast("long").alias("first"))


pair("win_pack_rows", packed, "select row, cast(sum(id) as bigint) as total, cast(min(case when pos = 0 then id end) as bigint) as first from (select (start + i - 1) // 129 as row, (start + i - 1) % 129 as pos, id from (select start, unnest(ids) as id, generate_subscripts(ids, 1) as i from (select ids, coalesce(sum(len(ids)) over (order by doc_id rows between unbounded preceding and 1 preceding), 0)::BIGINT as start from (select doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) as ids from documents) d) o) p) q group by row having count(*) = 129")


def within(spark, sf_dir: str):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"))
    return corpus.offsets(rows, "doc_id", "n").where("start < 100000").select("doc_id", "n")


pair("win_budget_stop", within, f"select doc_id, n from (select doc_id, {N} as n, sum({N}) over (order by doc_id rows unbounded preceding) as s from documents) d where s - n < 100000")
pair("win_head_split", lambda s, d: corpus.numbered(table(s, d, "documents").select("lang", "doc_id"), ["lang"], [F.col("doc_id")]).select("lang", "doc_id", F.expr("case when __r <= greatest(1, __n div 50) then 'val' else 'train' end").alias("part")), "select lang, doc_id, case when r <= greatest(1, n div 50) then 'val' else 'train' end as part from (select lang, doc_id, row_number() over (partition by lang order by doc_id) as r, count(*) over (partition by lang) as n from documents) d")
pair("win_holdout_split", lambda s, d: corpus.holdout_split(table(s, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"], corpus.draw(F.concat(F.lit("split|"), F.col("doc_id").cast("string"))), "doc_id"), "select doc_id, lang, source, case when r <= case when n >= 3 then greatest(1, n div 5) else 0 end then 'test' else 'train' end as part from (select doc_id, lang, source, count(*) over (partition by lang, source) as n, row_number() over (partition by lang, source order by @draw(concat('split|', cast(doc_id as string))), doc_id) as r from documents) d")
LOSS = "(select event_type as run, row_number() over (partition by event_type order by event_id) as step, value as loss from events)"
pair("win_early_stop", lambda s, d: corpus.early_stop(events(s, d), "event_type", "event_id", "value", 8).withColumnRenamed("event_type", "run"), f"""select run, min(step) as stopped from (select run, step, sum(1 - improved) over (partition by run, era order by step) as stale from (select run, step, improved, sum(improved) over (partition by run order by step) as era
  from (select run, step, case when best is null or loss < best then 1 else 0 end as improved from (select run, step, loss, min(loss) over (partition by run order by step rows between unbounded preceding and 1 preceding) as best from {LOSS} l) b) i) e) s where stale >= 8 group by run""")
pair("win_latency_delta", lambda s, d: corpus.before(events(s, d).select("user_id", "event_id", F.expr("unix_micros(cast(ts as timestamp))").alias("at")), "user_id", ["at", "event_id"], ["at"]).select("event_id", F.expr("at - before_at").alias("delta_us")), "select event_id, @epoch_us(ts) - lag(@epoch_us(ts)) over (partition by user_id order by ts, event_id) as delta_us from events")
pair("win_every_n", lambda s, d: corpus.numbered(events(s, d).select(F.col("event_type").alias("run"), "event_id"), ["run"], [F.col("event_id")]).where("(__r + 1) % 50 = 0 or __r = __n").select("run", F.col("__r").alias("step")), "select run, step from (select run, step, row_number() over (partition by run order by step desc) as back from " + LOSS + " l) x where (step + 1) % 50 = 0 or back = 1")
add("win_recent_slice", "select doc_id, array_join(@part(@words(text), greatest(1, size(@words(text)) - 7), 8), ' ') as recent from documents")
# pairs of letters of whole texts, ranked by how often they stand; the window is over the distinct pairs only
add("win_rank", "select a, row_number() over (order by n desc, a) - 1 as merge_rank from (select concat(element_at(c, i), element_at(c, i + 1)) as a, count(*) as n from (select c, explode(sequence(1, size(c) - 1)) as i from (select split(text, '') as c from documents where length(text) > 1) s) p group by 1) q")
# the last value that is not null of each field, as the turns change it
pair("win_state_fold", lambda s, d: corpus.last_known(events(s, d).select("user_id", "event_id", "event_type"), "user_id", ["event_id"], {"fan": F.expr("case when event_type = 'view' then event_id % 4 end"), "heat": F.expr("case when event_type = 'click' then event_id % 2 end")}).select("user_id", "event_id", "fan", "heat"), """select user_id, event_id, @last_known(case when event_type = 'view' then event_id % 4 end) over w as fan, @last_known(case when event_type = 'click' then event_id % 2 end) over w as heat
  from events window w as (partition by user_id order by event_id rows between unbounded preceding and current row)""")
pair("ord_seeded_shuffle", lambda s, d: corpus.numbered(table(s, d, "documents").select("lang", "doc_id"), ["lang"], [F.md5(F.concat(F.lit("seed|"), F.col("doc_id").cast("string")))]).select("doc_id", F.col("__r").alias("place")), "select doc_id, row_number() over (partition by lang order by md5(concat('seed|', cast(doc_id as string)))) as place from documents")
add("ord_sample_k", "select doc_id from documents order by md5(concat('sample|', cast(doc_id as string))), doc_id limit 100")
add("ord_limit_per_group", "select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id) as r from documents) d where r <= 5")
V = "transform(embedding, v -> cast(v as double))"
add("ord_topk_ties", f"select vec_id, size(filter({V}, v -> v >= cutoff)) as n_kept, round(cutoff, 6) as cutoff from (select vec_id, embedding, element_at(array_sort({V}), size(embedding) - 4) as cutoff from embeddings) e")
add("ord_argmax_first", f"select vec_id, cast(array_position({V}, array_max({V})) as bigint) as at from embeddings")
pair("stream_sessionize_reset", lambda s, d: corpus.sessions(events(s, d).select("user_id", "event_id", "event_type"), "user_id", ["event_id"], F.col("event_type") == "purchase").groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")), "select user_id, session, count(*) as n, min(event_id) as first_event from (select user_id, event_id, sum(case when event_type = 'purchase' then 1 else 0 end) over (partition by user_id order by event_id) as session from events) s group by user_id, session")
pair("stream_stop_rule", lambda s, d: corpus.numbered(events(s, d).select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")]).groupBy("user_id").agg(F.expr("min(case when event_type = 'purchase' or __r >= 24 then __r end)").alias("stop_at"), F.count("*").alias("n")), "select user_id, min(case when event_type = 'purchase' or r >= 24 then r end) as stop_at, count(*) as n from (select user_id, event_type, row_number() over (partition by user_id order by event_id) as r from events) e group by user_id")
