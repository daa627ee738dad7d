"""Aggregations: suite metrics, counters, losses, latencies, banks."""

from __future__ import annotations

from ..operators import corpus, tokens
from .dialect import add, pair, table
from .filters import ACCEPT, TURN

#: Expected and predicted flags of labelled documents; nulls are values, so they are compared by distinctness.
SCORED = """(select d.doc_id, d.lang as suite, d.source as intent, d.text, l.quality = 1 as expected, length(d.text) >= 200 and not regexp_like(d.text, '[#*$%&|<>][#*$%&|<>]') as predicted,
  case when l.toxic = 1 then 'fan=1 diag=x' when d.doc_id % 9 = 0 then null else 'fan=1' end as action, case when d.doc_id % 5 = 0 then null else 'fan=1' end as predicted_action, d.doc_id % 11 = 0 as malformed
  from documents d join labels l on d.doc_id = l.doc_id)"""
RATE = "round(avg(case when {} then 1.0E0 else 0.0E0 end), 4) as {}"
ACTION, PREDICTED = "nullif(replace(coalesce(action, ''), ' diag=x', ''), '')", "predicted_action"
METRICS = [
    ("action is not distinct from predicted_action", "action_exact"), (f"{ACTION} is not distinct from {PREDICTED}", "actuator_exact"), ("expected = predicted and not malformed", "reply_exact"), ("expected = predicted", "fallback_correct"),
    ("size(filter(regexp_extract_all(text, '[0-9]+', 0), n -> instr(replace(text, '7', ''), n) = 0)) = 0", "numbers_grounded"), ("malformed", "malformed"), ("action is null and predicted_action is not null", "hallucinated_action"),
    ("predicted_action is not null and not malformed and doc_id % 13 = 0", "rejected"), ("length(text) >= 3000", "length_violation"), ("action is null", "no_action"),
]
RATES = ", ".join(RATE.format(f"coalesce({c}, false)", n) for c, n in METRICS)
add("agg_suite_metrics", f"select suite, count(*) as n, {RATES} from {SCORED} s group by suite")
add("agg_grouping_sets", f"select suite, intent, cast(grouping(intent) as bigint) as level, count(*) as n, {RATE.format('expected = predicted', 'correct')} from {SCORED} s group by grouping sets ((suite), (suite, intent))")
add("agg_mining_stats", f"""select suite, count(*) as graded, count_if(wrong_action) as wrong_action, count_if(wrong_fallback) as wrong_fallback, count_if(malformed and not wrong_action and not wrong_fallback) as wrong_reply
  from (select suite, malformed, action is distinct from predicted_action as wrong_action, expected <> predicted as wrong_fallback from {SCORED} s) w group by suite""")
add("agg_split_stats", """select split, count(*) as n, count_if(long) as dropped_too_long, count_if(not long and leak) as dropped_in_train, count_if(not long and not leak) as written
  from (select case when a.doc_id % 10 = 0 then 'val' else 'train' end as split, length(a.text) > 8000 as long, a.doc_id % 10 = 0 and b.k is not null as leak from documents a left join (select distinct md5(text) as k from documents where doc_id % 10 <> 0) b on md5(a.text) = b.k) x group by split""")
# the pattern of pre-tokens looks ahead, which DuckDB's cannot, so there is no twin
pair("agg_pretoken_freq", lambda s, d: tokens.piece_counts(table(s, d, "documents")))
WORDS = "(select w, count(*) as f from (select explode(@words(text)) as w from documents) e group by w)"
PAIRS = f"(select substr(w, i, 1) as a, substr(w, i + 1, 1) as b, f, w from (select w, f, explode(sequence(1, length(w) - 1)) as i from {WORDS} x where length(w) > 1) p)"
add("agg_pair_counts", f"select a, b, cast(sum(f) as bigint) as n, count(distinct w) as words from {PAIRS} p group by a, b")
add("agg_argmax_tiebreak", f"select a, b, cast(sum(f) as bigint) as n from {PAIRS} p group by a, b order by n desc, a, b limit 16")
add("agg_mean_len", "select lang, round(cast(sum(size(split(text, ' '))) as double) / greatest(count(*), 1), 6) as mean_len from documents group by lang")
add("agg_macro_avg", "select round(avg(m), 6) as macro from (select lang, avg(case when doc_id % 3 = 0 then 1.0E0 else 0.0E0 end) as m from documents group by lang) x")
add("agg_weighted_mean", "select event_type, round(cast(sum(value * m) as double) / greatest(sum(m), 1), 4) as loss from (select event_type, value, case when event_id % 3 = 0 then 0 else 1 end as m from events) e group by event_type")
VECTOR = "transform(embedding, v -> cast(v as double))"
SOFT = "transform({x}, v -> exp((v - array_max({x})) / 2.0E0))"
add("agg_masked_kl", f"""select label, round(sum(kl * m) / greatest(sum(m), 1), 6) as kl from (select label, case when vec_id % 4 = 0 then 0 else 1 end as m,
  @fold(transform(sequence(1, size(p)), i -> element_at(p, i) / sp * ln((element_at(p, i) / sp) / (element_at(q, i) / sq))), 0.0E0, (a, x) -> a + x) as kl
  from (select label, vec_id, p, q, @fold(p, 0.0E0, (a, x) -> a + x) as sp, @fold(q, 0.0E0, (a, x) -> a + x) as sq from (select label, vec_id, {SOFT.format(x=VECTOR)} as p, transform({VECTOR}, v -> exp(v / 3.0E0)) as q from embeddings) e) s) k group by label""")
pair("agg_p95_nearest", lambda s, d: corpus.nearest_rank(table(s, d, "events"), "event_type", "value", "event_id"), "select event_type, value as p95, n from (select event_type, value, count(*) over (partition by event_type) as n, row_number() over (partition by event_type order by value, event_id) - 1 as r from events) x where r = least(95 * n div 100, n - 1)")
add("agg_stage_cost", "select user_id % 10 as grp, round(sum(case when event_type in ('view', 'click') then value else 0 end) / 1000.0E0 / greatest(count(*), 1), 6) as attention_ms, round(sum(value) / 1000.0E0 / greatest(count(*), 1), 6) as total_ms from events group by 1")
add("agg_param_count", "select id, v * d + l * (2 * d * d + 2 * d * kv + 3 * d * ff) as params, round((v * d + l * (2 * d * d + 2 * d * kv + 3 * d * ff)) * 0.5625E0, 4) as q4_bytes from (select id, 256 + id * 8 as v, 32 * (1 + id % 6) as d, 1 + id % 12 as l, 16 * (1 + id % 3) as kv, 64 * (1 + id % 5) as ff from (select explode(sequence(1, 300)) as id) r) c")
add("agg_group_absmax", f"select vec_id, grp, round(array_max(transform(@part(x, 32 * grp - 31, 32), v -> abs(v))), 6) as absmax from (select vec_id, x, explode(sequence(1, cast((size(x) + 31) div 32 as int))) as grp from (select vec_id, {VECTOR} as x from embeddings) e) g")
add("agg_checksum", f"select label, round(sum(s), 4) as checksum from (select label, @fold({VECTOR}, 0.0E0, (a, x) -> a + x) as s from embeddings) e group by label")
add("agg_best_flag", "select lang, source, n, n = max(n) over (partition by lang) as best from (select lang, source, count(*) as n from documents group by lang, source) g")
add("agg_distinct_lines", "select lang, count(distinct md5(text)) as n_lines from documents group by lang")
add("agg_collect_bank", "select lang, @listed(source, source) as sources from (select distinct lang, source from documents) d group by lang")
add("set_union_distinct", "select lang, md5(text) as line from documents where doc_id % 2 = 0 union select lang, md5(text) as line from documents where doc_id % 3 = 0")
add("set_replicate_union", "select doc_id, copy from (select doc_id, explode(sequence(1, 3)) as copy from documents where doc_id % 20 = 0) r union all select doc_id, 0 as copy from documents where @draw(concat('replay|', cast(doc_id as string))) % 10 = 0")
pair("udaf_grouped", lambda s, d: corpus.grouped_median(table(s, d, "events"), "event_type", "value", "event_id"), "select event_type, round(median(value), 6) as middle from events group by event_type")
