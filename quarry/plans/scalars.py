"""String, number, JSON and array functions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import tokens
from .dialect import add, pair, table
from .filters import LOW, UP

LINES = "select doc_id, concat(case doc_id % 4 when 0 then '1. ' when 1 then '- ' when 2 then '\"12) ' else '' end, x) as x from (select doc_id, {} as x from documents) l"
pair("fn_clean_line", lambda s, d: table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\\n")).alias("x")).select("doc_id", columns.clean_line(F.expr("concat(case doc_id % 4 when 0 then '1. ' when 1 then '- ' when 2 then '\"12) ' else '' end, x)")).alias("line")), "select doc_id, trim(regexp_replace(lower(trim(x, ' ')), '^([0-9]+[.)]|[-*•])\\s*', ''), chr(32) || chr(34) || chr(39)) as line from (" + LINES.format("unnest(string_split(text, chr(10)))") + ") y")
SPOKEN = sorted(((w, str(n)) for n in range(200) for w in columns.spoken(n)), key=lambda x: -len(x[0]))
SAID = "concat(text, ' seven of two hundred and one a hundred and five or Ninety-nine, one hundred twelve, fortytwo forty-two 3 zero')".replace("two hundred and one a", "two, a").replace("Ninety", "ninety")
# longest first, each form wherever it stands between other letters
pair("fn_number_words", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", columns.number_words_to_digits()(F.expr(SAID)).alias("line")), "select conv_id, turn, list_reduce([" + ", ".join(f"'{w}={n}'" for w, n in SPOKEN) + "], lambda acc, x: case when contains(acc, split_part(x, '=', 1)) then regexp_replace(acc, '\\b' || split_part(x, '=', 1) || '\\b', split_part(x, '=', 2), 'g') else acc end, " + SAID + ") as line from conversations")
# small numbers as words, one in four
NUMBERED = "@words(concat('set ', event_type, ' to ', cast(user_id % 9 as string), ' and ', cast(event_id % 7 as string), ' or 5'))"
WORDED = "element_at(array('zero', 'one', 'two', 'three', 'four', 'five'), coalesce(try_cast(element_at(w, i) as int), 0) + 1)"
add("fn_number_to_word", f"select event_id, array_join(transform(sequence(1, size(w)), i -> case when regexp_like(element_at(w, i), '^[0-5]$') and @draw(concat('number|', cast(event_id as string), '|', cast(i as string))) % 4 = 0 then {WORDED} else element_at(w, i) end), ' ') as line from (select event_id, {NUMBERED} as w from events) e")
pair("fn_numbers_grounded", lambda s, d: table(s, d, "events").select("event_id", columns.numbers_grounded(F.expr("concat('at ', cast(user_id % 40 as string), ' and 3')"), F.expr("concat('now ', cast(event_id % 400 as string), ' or 36')")).alias("grounded")), "select event_id, size(filter(regexp_extract_all(expected, '-?[0-9]+([.][0-9]+)?', 0), n -> instr(reply, n) = 0)) = 0 as grounded from (select event_id, concat('at ', cast(user_id % 40 as string), ' and 3') as expected, concat('now ', cast(event_id % 400 as string), ' or 36') as reply from events) e")
pair("fn_has_word", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", columns.has_word(F.col("text"), "the").alias("has_the")), f"select conv_id, turn, regexp_like(translate(text, '{UP}', '{LOW}'), '(^|[^a-z])the([^a-z]|$)') as has_the from conversations")
add("fn_prompt_layout", "select conv_id, concat('<bos>', @listed(concat(case role when 'user' then '<user>' else '<bot>' end, case when startswith(text, '<') then '' else ' ' end, text), turn), '<bot>') as prompt from conversations group by conv_id")
add("fn_plain_segments", "select conv_id, turn, array_join(filter(split(@replace_all(concat('<user> ', text, '<end>'), '<[a-z]+>', chr(1)), chr(1)), s -> s <> ''), '/') as segments from conversations")
OUTPUT = "case event_id % 6 when 0 then 'light is on<end><act> light=40</act>' when 1 then '<fb:unsure> which one<end>' when 2 then 'no end' when 3 then 'x<end> junk' when 4 then 'done<end><act> fan=9</act><eos>' else 'fine<end><eos>' end"
add("fn_output_parse", f"""select event_id, reply, fallback, action, closed = 0 or (rest <> '' and not regexp_like(rest, '^<act> [^<]*</act>$')) or coalesce(regexp_like(action, '=9$'), false) as malformed
  from (select event_id, closed, rest, trim(regexp_replace(head, '^<fb:[a-z]+>', '')) as reply, nullif(regexp_extract(head, '^<fb:([a-z]+)>', 1), '') as fallback, nullif(regexp_extract(rest, '^<act> ([^<]*)</act>$', 1), '') as action
  from (select event_id, instr(o, '<end>') as closed, case when instr(o, '<end>') > 0 then substr(o, 1, instr(o, '<end>') - 1) else o end as head, case when instr(o, '<end>') > 0 then replace(substr(o, instr(o, '<end>') + 5), '<eos>', '') else '' end as rest from (select event_id, {OUTPUT} as o from events) a) b) c""")
AT = "cast(2 + d % greatest(length(w) - 2, 1) as int)"
EDIT = f"case when length(w) < 4 then w when (kind + length(w)) % 4 = 0 then concat(substr(w, 1, {AT} - 1), substr(w, {AT} + 1, 1), substr(w, {AT}, 1), substr(w, {AT} + 2)) when (kind + length(w)) % 4 = 1 then concat(substr(w, 1, {AT} - 1), substr(w, {AT} + 1)) when (kind + length(w)) % 4 = 2 then concat(substr(w, 1, {AT}), substr(w, {AT})) else concat(substr(w, 1, {AT} - 1), translate(substr(w, {AT}, 1), 'aeinort', 'swubitp'), substr(w, {AT} + 1)) end"
add("fn_typo", f"select doc_id, array_join(transform(split(text, ' '), w -> {EDIT}), ' ') as typo from (select doc_id, text, @draw(concat('typo|', cast(doc_id as string))) as d, @draw(concat('kind|', cast(doc_id as string))) as kind from documents) k")
add("fn_decorate", "select conv_id, turn, concat(case when @draw(concat('p|', k)) < 1288490188 then 'please ' else '' end, text, case when @draw(concat('s|', k)) < 1288490188 then ' thanks' else '' end, case when @draw(concat('m|', k)) < 644245094 then '!' else '' end) as line from (select conv_id, turn, text, concat(cast(conv_id as string), '-', cast(turn as string)) as k from conversations) c")
add("fn_keyword_baseline", f"select conv_id, turn, case when instr(low, 'anea') > 0 then case when instr(low, ' on ') > 0 then 'light=100' else 'light=0' end when instr(low, 'thnd') > 0 then case when instr(low, ' of ') > 0 then 'fan=0' else 'fan=1' end when instr(low, 'with') > 0 then 'win=1' end as action from (select conv_id, turn, translate(text, '{UP}', '{LOW}') as low from conversations) c")


def pretokenized(spark, sf_dir: str):
    """doc_id and pieces of each whole text; the pattern looks ahead, which DuckDB's cannot, so there is no twin."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens.pretokens(F.coalesce("text", F.lit(""))).alias("pieces"))


pair("fn_pretokenize", lambda s, d: pretokenized(s, d).select("doc_id", F.array_join("pieces", "|").alias("pieces")))
pair("udtf_tokens", lambda s, d: pretokenized(s, d).select("doc_id", F.posexplode("pieces").alias("at", "piece")))


def first_merges(spark, sf_dir: str):
    """The first two merges of the words of plain letters, as texts."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.regexp_replace(F.translate("text", UP, LOW), "[^a-z]+", " "), " ")).alias("piece")).where("piece <> ''").groupBy("piece").agg(F.count("*").alias("n"))
    found = tokens.train(words, 2)
    names = [chr(i) for i in range(256)] + tokens.texts_of(found)
    return spark.createDataFrame([(names[a], names[b], n) for a, b, n in found], "a string, b string, n long")


# the second merge counts pairs after the first is made; a one-letter stand-in marks it
M = "(select w, count(*) as f from (select unnest(regexp_split_to_array(translate(text, '" + UP + "', '" + LOW + "'), '[^a-z]+')) as w from documents) e where w <> '' group by w)"
BEST = "(select {k} as step, a, b, cast(sum(f) as bigint) as n from (select substr(w, i, 1) as a, substr(w, i + 1, 1) as b, f from (select w, f, unnest(generate_series(1, length(w) - 1)) as i from {w} x where length(w) > 1) p) q group by a, b order by n desc, {order} limit 1)"
pair("fn_bpe_first_merges", first_merges, f"with m as materialized {M}, one as {BEST.format(k=1, w='m', order='a, b')}, m2 as materialized (select replace(w, (select a || b from one), 'Z') as w, f from m), two as {BEST.format(k=2, w='m2', order="replace(a, 'Z', (select a || b from one)), replace(b, 'Z', (select a || b from one))")} select a, b, n from one union all select replace(two.a, 'Z', one.a || one.b), replace(two.b, 'Z', one.a || one.b), two.n from two, one")


MERGES = 200


def trained(spark, sf_dir: str):
    """The first 200 merges over the pre-tokens of all texts: rank, the two symbols (bytes, then merges from 256 on) and how often they stood together."""
    found = tokens.train(tokens.piece_counts(table(spark, sf_dir, "documents")), MERGES)
    return spark.createDataFrame([(k, *m) for k, m in enumerate(found)], "rank int, a int, b int, n long")


# the pre-tokens without looking ahead: a mark goes between the last space of a run and those before; a symbol is one character from U+2710 on,
# of a character beyond ASCII the first byte matters only, since bytes are pieces of their own.  A merge is a replacement, all words at each step.
SYMBOL = "chr((10000 + {})::INTEGER)"
FIRST_BYTE = "case when unicode(c) < 128 then unicode(c) when unicode(c) < 2048 then 192 + unicode(c) // 64 when unicode(c) < 65536 then 224 + unicode(c) // 4096 else 240 + unicode(c) // 262144 end"
pair("fn_bpe_train", trained, f"""with recursive marked as (select regexp_replace(text, '( +)( [^ ])', '\\1' || chr(1) || '\\2', 'g') as text from documents),
  pieces as materialized (select w, count(*)::BIGINT as n from (select replace(unnest(regexp_extract_all(text, ' +$| +' || chr(1) || '| ?[A-Za-z]+=?| ?[^ ' || chr(1) || ']', 0, 's')), chr(1), '') as w from marked) x where length(w) > 1 group by w),
  words as materialized (select array_to_string([{SYMBOL.format(FIRST_BYTE)} for c in string_split(w, '')], '') as w, n from pieces),
  steps as (select -1 as rank, w, n, null::VARCHAR as p, null::BIGINT as c from words
  union all select s.rank + 1, replace(s.w, b.p, {SYMBOL.format("256 + s.rank + 1")}), s.n, b.p, b.c from steps s,
    (select p, sum(n)::BIGINT as c from (select substr(w, i, 2) as p, n from (select w, n, unnest(range(1, length(w))) as i from steps) k) q group by p order by c desc, p limit 1) b where s.rank < {MERGES - 1})
  select rank::INTEGER as rank, (unicode(substr(p, 1, 1)) - 10000)::INTEGER as a, (unicode(substr(p, 2, 1)) - 10000)::INTEGER as b, c as n from (select distinct rank, p, c from steps where rank >= 0) d""")


def encoded(spark, sf_dir: str):
    """Ids by the first 8 merges of the corpus itself, with special tokens of which one begins another."""
    docs = table(spark, sf_dir, "documents")
    found = tokens.train(tokens.piece_counts(docs), 8)
    marked = docs.select("doc_id", F.expr("concat('<s>', coalesce(text, ''), '<s><end')").alias("text"))
    return tokens.encode_documents(marked, [(a, b) for a, b, _ in found], ["<s>", "<s><end", "<end"]).select("doc_id", F.size("ids").alias("n"), F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary")).alias("crc"))


pair("fn_bpe_encode", encoded)
add("fn_token_count", "select doc_id, size(@words(text)) as n_words, length(text) as n_chars from documents")
add("fn_json_event", "select event_id, @json('event', event_type, 'text', concat('q\"', cast(user_id as string), chr(9), '\"')) as line from events")
add("fn_json_extract", "select event_type, cast(sum(cast(get_json_object(props, '$.k') as bigint)) as bigint) as k from events group by event_type")
add("fn_common_prefix", "select doc_id, case when n = least(size(a), size(b)) and size(a) = size(b) then greatest(n - 1, 0) else n end as reused from (select doc_id, a, b, coalesce(array_min(filter(transform(sequence(1, least(size(a), size(b))), i -> case when element_at(a, i) <> element_at(b, i) then i - 1 end), x -> x is not null)), least(size(a), size(b))) as n from (select doc_id, split(text, ' ') as a, split(substr(text, 1, cast(length(text) * (20 + doc_id % 60) div 60 as int)), ' ') as b from documents) d) p")
add("fn_lr_schedule", "select step, round(case when step < 100 then 0.001E0 * (step + 1) / 100 else 0.0001E0 + 0.5E0 * (0.001E0 - 0.0001E0) * (1 + cos(pi() * (step - 100) / 900.0E0)) end, 9) as lr from (select explode(sequence(0, 999)) as step) s")
add("fn_roofline", "select id, round(45.0E6 / (w + kv), 4) as ceiling, round(1000.0E0 * 20 * (w + kv) / 45.0E6, 4) as reply_ms from (select id, (l * (2 * d * d + 2 * d * kv + 3 * d * ff) + v * d) * 1.0E0 as w, l * 2 * (ctx div 2) * kv * 1.0E0 as kv from (select id, 512 as v, 32 * (1 + id % 6) as d, 1 + id % 12 as l, 16 * (1 + id % 3) as kv, 64 * (1 + id % 5) as ff, 128 + id as ctx from (select explode(sequence(1, 300)) as id) r) c) e")
HALF = "case when e = 0 then s * f / 1024.0E0 * pow(2.0E0, -14) when e = 31 then null else s * (1 + f / 1024.0E0) * pow(2.0E0, e - 15) end"
add("fn_f16_decode", f"select bits, {HALF} as value from (select bits, case when bits >= 32768 then -1 else 1 end as s, (bits div 1024) % 32 as e, bits % 1024 as f from (select explode(sequence(0, 65535)) as bits) b) p")
add("fn_prompt_for", "select lang, concat_ws(chr(10), 'Rules:', '1. keep the meaning', concat('Language: ', lang), case when n > 100 then concat('Examples: ', cast(n as string)) end) as prompt from (select lang, count(*) as n from documents group by lang) g")


def smoothed(spark, sf_dir: str):
    @F.pandas_udf("double")
    def smooth(x: pd.Series) -> pd.Series:
        return x * x / (1.0 + x.abs())

    return table(spark, sf_dir, "events").select("event_id", smooth("value").alias("y"))


pair("udf_vectorised", smoothed, "select event_id, value * value / (1.0E0 + abs(value)) as y from events")


def scored_encode(spark, sf_dir: str):
    """Ids of the turns by scored pieces: bytes, letters and a few longer pieces of our own."""
    letters = " etaonihsrdlucmfwypvbgkjqxz"
    pieces = [("<unk>", 0.0), ("<s>", 0.0), ("</s>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *((c, -20.0) for c in letters), *((p, -float(i)) for i, p in enumerate(["th", "the", " the", "an", "er", " a", "on", "re"], 1))]

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = tokens.ScoredPieces(pieces)
        for texts in batches:
            yield texts.map(lambda t: coder.encode(t or ""))

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", encode("text").alias("ids"))


pair("fn_scored_encode", scored_encode)
