"""Projections, filters and predicates over texts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus
from .dialect import add, pair

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tags of a document, drawn from its id.
TAGS = "filter(array(case when doc_id % 5 = 0 then 'safety' else '' end, case when doc_id % 7 = 0 then 'clarify' else '' end, case when doc_id % 2 = 0 then 'device' else 'chat' end), x -> x <> '')"
TAGGED = f"(select doc_id, lang, source, {TAGS} as tags from documents)"
add("flt_tag_overlap", f"select doc_id, lang from {TAGGED} d where arrays_overlap(tags, array('safety', 'clarify')) and lang = 'en'")
add("set_intersect", f"select doc_id, array_join(array_sort(array_intersect(tags, array('safety', 'device'))), ' ') as common from {TAGGED} d")
add("set_except", f"select doc_id, array_join(array_sort(@without(tags, array('safety', 'device'))), ' ') as others from {TAGGED} d")
add("set_subset", f"select doc_id, size(@without(array('safety', 'device'), tags)) = 0 as has_all from {TAGGED} d")
add("prj_optional_field", f"select doc_id, case when size(tags) > 1 then @json('id', doc_id, 'tags', array_sort(tags), 'allowed', lang) else @json('id', doc_id, 'tags', array_sort(tags)) end as record from {TAGGED} d")

# rejection sampling: candidates are drawn from a longer range, the first 500 accepted ones stay; fewer raise
pair("flt_reject_sample", lambda s, d: corpus.numbered(corpus.reject_sample(s.range(1, 4001), corpus.draw(F.concat(F.lit("reject|"), F.col("id").cast("string"))) % 4 == 0, 500, F.col("id")), [], [F.col("id")]).select("id", F.col("__r").alias("place")), "select id, place from (select id, row_number() over (order by id) as place from (select explode(sequence(1, 4000)) as id) r where @draw(concat('reject|', cast(id as string))) % 4 = 0) a where place <= 500")

WORDS = "size(@words(text))"
TURN = f"(select conv_id, turn, role, text, translate(text, '{UP}', '{LOW}') as low, {WORDS} as n from conversations)"
ACCEPT = """n between 1 and 30 and not regexp_like(text, '[<>]') and regexp_like(text, '^[ -~]*$') and not regexp_like(low, '(^|[^a-z])(never|forbidden)([^a-z]|$)')
  and regexp_like(low, '(^|[^a-z])(the|and|of)([^a-z]|$)') and size(regexp_extract_all(text, '-?[0-9]+([.][0-9]+)?', 0)) <= 3"""
add("flt_semantic_accept", f"select conv_id, turn, n from {TURN} t where {ACCEPT}")
add("agg_accept_stats", f"select role, count(*) as asked, count_if({ACCEPT}) as accepted, count_if(not ({ACCEPT})) as rejected from {TURN} t group by role")
add("flt_line_accept", f"select conv_id, turn from {TURN} t where n between 3 and 22 and regexp_like(low, '^[a-z ,.?!'' -]+$') and not arrays_overlap(@words(low), array('idiot', 'trash'))")
#: Held-out frames of our own: <d> is any device, <n> any number.
FRAMES = {1: "the <d> and", 2: "<n>", 3: "from the <d>"}
FOUND = " ".join("when regexp_like(low, '(^|[^a-z])" + f.replace("<d>", "(light|fan|anea|thnd|and|of)").replace("<n>", "[0-9]+") + f"([^a-z]|$)') then {i}" for i, f in FRAMES.items())
add("flt_heldout_pattern", f"select conv_id, turn, frame from (select conv_id, turn, case {FOUND} end as frame from {TURN} t) f where frame is not null")
# a question with its answer and four control tokens, without any history, has to fit the context
add("flt_ctx_fit", "select conv_id, turn, n from (select q.conv_id, q.turn, cast(size(@words(q.text)) + size(@words(a.text)) + 4 as bigint) as n from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user') x where n <= 120")
add("prj_fallback", "select doc_id, case when startswith(marked, '<fb:') then regexp_extract(marked, '^<fb:([a-z]+)>', 1) end as fallback, trim(regexp_replace(marked, '^<fb:[a-z]+>', '')) as reply from (select doc_id, case when doc_id % 4 = 0 then concat('<fb:unsure> ', replace(text, chr(10), ' ')) else replace(text, chr(10), ' ') end as marked from documents) m")
COMMAND = "case event_id % 7 when 0 then '/reset' when 1 then '/set t=3' when 2 then '/seed 12' when 3 then '/temp 0.7' when 4 then 'hello' when 5 then '/resets' else '/tokenize x y' end"
add("flt_allow_list", f"select event_id, cmd from (select event_id, {COMMAND} as cmd from events) c where cmd in ('/reset', '/help') or startswith(cmd, '/set ') or startswith(cmd, '/seed ')")
add("fn_command_parse", f"""select event_id, verb, case when verb in ('/reset', '/help') then case when arg is null then 'ok' else 'bad' end
   when verb = '/seed' then case when try_cast(arg as int) between 0 and 1000000 then 'ok' else 'bad' end when verb = '/temp' then case when try_cast(arg as double) between 0 and 2 then 'ok' else 'bad' end
   when verb in ('/set', '/tokenize') then case when arg is not null then 'ok' else 'bad' end when startswith(verb, '/') then 'unknown' else 'chat' end as result
  from (select event_id, element_at(split(cmd, ' '), 1) as verb, nullif(case when instr(cmd, ' ') > 0 then substr(cmd, instr(cmd, ' ') + 1) end, '') as arg from (select event_id, {COMMAND} as cmd from events) c) p""")
# the first 256 bytes, which may end within a character, so the line is given by its bytes
BARE = f"translate(replace(replace(text, chr(13), ''), chr(10), ''), '{UP}', '{LOW}')"
pair("prj_normalise_input", f"select conv_id, turn, line from (select conv_id, turn, hex(trim(cast(substring(encode({BARE}, 'UTF-8'), 1, 256) as string))) as line from conversations) n where line <> ''",
     f"select conv_id, turn, line from (select conv_id, turn, regexp_replace(substr(hex(encode({BARE})), 1, 512), '^(20)+|(20)+$', '', 'g') as line from conversations) n where line <> ''")
add("flt_message_guard", "select conv_id, turn, message from (select conv_id, turn, substr(trim(text), 1, 240) as message from conversations) m where message <> '' and not startswith(message, '/')")
CONFIG = "(select id, 64 + (id % 5) * 32 as d, 1 + id % 9 as heads, 1 + id % 4 as kv, id % 14 as layers, 250 + (id % 3) * 10 as vocab, id % 5 as norm from (select explode(sequence(1, 500)) as id) r)"
add("flt_config_validate", f"select id, case when layers < 1 or layers > 12 then 'layers' when vocab < 256 then 'vocab' when d % heads <> 0 then 'heads' when heads % kv <> 0 then 'kv' when (d div heads) % 2 <> 0 then 'odd head' when norm > 3 then 'norm' else 'ok' end as reason from {CONFIG} c")
