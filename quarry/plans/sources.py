"""Scans and sinks."""

from __future__ import annotations

import struct
import uuid

from pyspark.sql import functions as F

from ..operators import corpus
from ..sources import model_blob, shared, tokenizer_blob
from .dialect import add, pair, table, to_spark
from .rules import STATE

IDS = "transform(@part(split(text, ' '), 1, 16), w -> length(w))"
add("src_padded_shift", f"""select doc_id, array_join(transform(@part(padded, 1, 12), v -> cast(v as string)), ',') as inputs, array_join(transform(@part(padded, 2, 12), v -> cast(v as string)), ',') as targets,
  array_join(transform(sequence(1, 12), i -> case when i >= least(3, n) and i < n then '1' else '0' end), ',') as mask
  from (select doc_id, size(ids) as n, @part(concat(ids, @repeat_list(0, 13)), 1, 13) as padded from (select doc_id, {IDS} as ids from documents) d) p""")
#: Tokens of a row; a longer sequence by one fits, since inputs and targets are shifted against each other.
CTX = 128


def split_rows(spark, sf_dir: str):
    """A split written as JSON lines (questions and answers as lengths of words), read again as inputs, next-token targets and a mask over the answer, all padded to the context."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.expr("transform(array_remove(split(text, ' '), ''), w -> length(w))").alias("ids"))
    asked, told = turns.where("role = 'user'"), turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("ids").alias("target_ids"))
    path = shared.path_for(spark, "split")
    asked.join(told, ["conv_id", "turn"]).select("conv_id", "turn", F.col("ids").alias("prompt_ids"), "target_ids").write.json(path)
    return load_split(spark, path, "conv_id long, turn long", CTX)


def load_split(spark, path: str, keys: str, ctx: int):
    """The keys, inputs, targets and mask of JSON lines with prompt_ids and target_ids; sequences longer than ``ctx`` and one are left out."""
    rows = spark.read.schema(f"{keys}, prompt_ids array<int>, target_ids array<int>").json(path)
    rows = rows.withColumn("ids", F.concat("prompt_ids", "target_ids")).withColumn("p", F.size("prompt_ids")).where(F.size("ids") <= ctx + 1)
    padded = rows.withColumn("padded", F.concat("ids", F.array_repeat(F.lit(0), F.lit(ctx + 1) - F.size("ids"))))
    mask = F.expr(f"transform(sequence(1, {ctx}), i -> if(i >= p and i < size(ids), 1, 0))")
    return padded.select(*[k.split()[0] for k in keys.split(", ")], F.slice("padded", 1, ctx).alias("inputs"), F.slice("padded", 2, ctx).alias("targets"), mask.alias("mask"))


joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
LENGTHS = "list_transform(list_filter(string_split(text, ' '), lambda w: w <> ''), lambda w: length(w))"
pair("src_load_split", lambda s, d: split_rows(s, d).select("conv_id", "turn", joined("inputs"), joined("targets"), joined("mask")), f"""with t as (select conv_id, turn, role, {LENGTHS} as ids from conversations),
  s as (select q.conv_id, q.turn, len(q.ids) as p, list_concat(q.ids, a.ids) as ids from t q join t a on a.conv_id = q.conv_id and a.turn = q.turn + 1 where q.role = 'user')
  select conv_id, turn, array_to_string(list_resize(ids, {CTX + 1}, 0)[1:{CTX}], ',') as inputs, array_to_string(list_resize(ids, {CTX + 1}, 0)[2:{CTX + 1}], ',') as targets,
    array_to_string(list_concat(list_resize([]::INTEGER[], (p - 1)::BIGINT, 0), list_resize([]::INTEGER[], (len(ids) - p)::BIGINT, 1), list_resize([]::INTEGER[], ({CTX} - len(ids) + 1)::BIGINT, 0)), ',') as mask from s where len(ids) <= {CTX + 1} and p > 0""")
RECORDS = "(select doc_id, lower(trim(r)) as record from (select doc_id, explode(split(text, chr(10))) as r from documents) e)"
add("src_delimited_records", f"select doc_id, md5(record) as record from {RECORDS} x where record <> ''")
add("sink_manifest_stats", "select @json('documents', count(*), 'languages', count(distinct lang), 'characters', cast(sum(length(text)) as bigint), 'digest', cast(sum(@draw(text)) as bigint)) as manifest from documents")


#: Lines of a key that stand in one record of a bank.
RECORD = 500
PART = "case when @draw(concat('part|', cast(doc_id as string))) % 5 = 0 then 'test' else 'train' end"


def bank(spark, sf_dir: str) -> str:
    """A bank written as JSON lines: records of a key with lines for training and for testing, at most RECORD of a key's lines in one."""
    lines = table(spark, sf_dir, "documents").select(F.concat_ws("|", "lang", "source").alias("key"), F.expr(to_spark(PART)).alias("part"), F.md5("text").alias("line"), "doc_id")
    placed = corpus.numbered(lines, ["key"], [F.col("line"), F.col("doc_id")]).withColumn("record", F.expr(f"(__r - 1) div {RECORD}"))
    records = placed.groupBy("key", "record").agg(*[F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col("line")))).alias(p) for p in ("train", "test")])
    path = shared.path_for(spark, "bank")
    records.select("key", "train", "test").write.json(path)
    return path


def bank_lines(spark, sf_dir: str):
    """Key, part and line of a bank, read from its JSON lines."""
    read = spark.read.schema("key string, train array<string>, test array<string>").json(bank(spark, sf_dir))
    return read.select("key", F.explode(F.create_map(F.lit("train"), "train", F.lit("test"), "test")).alias("part", "lines")).select("key", "part", F.explode("lines").alias("line"))


def bank_part(spark, sf_dir: str):
    """Training lines of the keys that have lines in both parts."""
    lines = bank_lines(spark, sf_dir)
    both = lines.groupBy("key").agg(F.count_distinct("part").alias("n")).where("n = 2").select("key")
    return lines.where("part = 'train'").join(both, "key", "left_semi").select("key", "line")


LINES = f"(select concat_ws('|', lang, source) as key, {PART} as part, md5(text) as line from documents)"
pair("src_bank_explode", bank_lines, f"select key, part, line from {LINES} l where line is not null")
pair("src_bank_part_filter", bank_part, f"select key, line from {LINES} l where line is not null and part = 'train' and key in (select key from {LINES} l where line is not null group by key having count(distinct part) = 2)")
KEY = "substr(@sha(concat_ws(chr(10), 'model', 'system', text, '7')), 1, 16)"
add("src_content_cache", f"with cache as (select distinct {KEY} as k from documents where doc_id % 2 = 0) select doc_id, {KEY} as cache_key, cache.k is not null as hit from documents left join cache on {KEY} = cache.k")
#: Event lines as a device prints them, with noise between.
PRINTED = "(select event_id, event_type, user_id, value, case when event_id % 10 = 3 then 'I (12) boot: ok' else concat('  @@{\"event\":\"', event_type, '\",\"user\":', cast(user_id as string), ',\"id\":', cast(event_id as string), '}') end as line from events)"
add("src_event_lines", f"select get_json_object(j, '$.event') as event, cast(get_json_object(j, '$.user') as bigint) as user_id, cast(get_json_object(j, '$.id') as bigint) as id from (select substr(trim(line), 3) as j from {PRINTED} p where startswith(trim(line), '@@{{')) l".replace("{{", "{"))
add("sink_markdown_table", "select lang, concat('| ', lang, ' | ', cast(n as string), ' | ', @one_decimal(mean), ' |') as line from (select lang, count(*) as n, cast(sum(length(text)) as double) / count(*) as mean from documents group by lang) m")
# links of pages that name no known page
LINKED = "(select page_id, explode(regexp_extract_all(html, 'href=\"([^\"#?]+)', 1)) as target from pages)"
add("src_link_scan", f"with known as (select distinct concat('/', element_at(split(url, '/'), 4)) as path from pages) select page_id, target, count(*) as n from {LINKED} l left join known on l.target = known.path where known.path is null group by page_id, target")
add("fn_checksums", "select doc_id, @sha(text) as sha256, md5(text) as md5 from documents")
add("src_priority_fallback", "select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by priority, doc_id) as r from (select lang, doc_id, 1 as priority from documents where source = 'src1' and lang <> 'en' union all select lang, doc_id, 2 as priority from documents) u) x where r = 1")
add("agg_tensor_absmax", "select label, size(embedding) as width, max(a) as absmax from (select label, embedding, array_max(transform(embedding, v -> abs(cast(v as double)))) as a from embeddings) e group by label, size(embedding)")
# two forms of one rule over the same states, the second with planted faults: as many differences are found as were planted
add("join_parity_diff", f"select x.event_id, a, b from (select event_id, case when t >= 32.0E0 then 1 else 0 end as a from {STATE} s) x full outer join (select event_id, case when (t < 32.0E0 or t is null) = (event_id % 97 = 5) then 1 else 0 end as b from {STATE} s where event_id % 101 <> 7) y on x.event_id = y.event_id where a is distinct from b")


def jsonl_split(spark, sf_dir: str):
    """Documents written as JSON lines by split, and counted again from the files."""
    path = f"{shared.root(spark)}/split-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 10 == 0, "val").otherwise("train").alias("split"))
    rows.write.partitionBy("split").json(path)
    return spark.read.schema("doc_id long, lang string, split string").json(path).groupBy("split", "lang").agg(F.count("*").alias("n"))


pair("sink_jsonl_split", jsonl_split, "select case when doc_id % 10 = 0 then 'val' else 'train' end as split, lang, count(*) as n from documents group by 1, 2")


def run_results(spark, sf_dir: str):
    """Results of runs, written by the tasks that hold them under names of their own, with other files beside them, and read back by name."""
    folder = shared.path_for(spark, "runs")
    found = table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    result = F.to_json(F.struct(F.col("n").alias("rows"), F.struct(F.struct("sources").alias("all")).alias("suites")))
    names = F.array(F.concat(F.lit("e-"), "lang", F.lit(".json")), F.concat(F.lit("e-"), "lang", F.lit(".model.json")), F.concat(F.lit("notes-"), "lang", F.lit(".json")))
    found.select(result.alias("value"), F.explode(names).alias("name")).write.partitionBy("name").text(folder)
    return scan_runs(spark, folder).select("run", F.get_json_object("content", "$.rows").cast("long").alias("n"), F.get_json_object("content", "$.suites.all.sources").cast("long").alias("sources"))


def scan_runs(spark, folder: str, skip: str = ".model.json"):
    """run, the name without its ending, and content of the results ``name=e*.json`` in a folder, but for those that end in ``skip``; only these are read."""
    files = spark.read.schema("value string, name string").text(folder).where("name like 'e%.json'").where(~F.endswith("name", F.lit(skip)))
    return files.select(F.regexp_extract("name", r"(.+)\.json$", 1).alias("run"), F.col("value").alias("content"))


pair("src_run_files", run_results, "select 'e-' || lang as run, count(*) as n, count(distinct source) as sources from documents where lang is not null group by lang")


def tensors(spark, sf_dir: str):
    """The vectors of each label as a tensor, stored by the label's remainder."""
    return table(spark, sf_dir, "embeddings").selectExpr("'m' || cast(label % 2 as string) as model", "'label' || cast(label as string) as name", "cast(label % 3 as int) as dtype", "cast(row_number() over (partition by label order by vec_id) as int) as row", "embedding as values")


def model_scan(spark, sf_dir: str):
    """Model files, written and read: rows, width and largest magnitude of each tensor."""
    folder = shared.path_for(spark, "model-files")
    model_blob.write(tensors(spark, sf_dir), folder)
    stats = ["count(*) as n_rows", "cast(max(size(values)) as bigint) as width", "round(max(array_max(transform(values, v -> abs(cast(v as double))))), 3) as absmax"]
    return model_blob.scan(spark, folder).groupBy("name", "dtype").agg(*map(F.expr, stats))


def model_sink(spark, sf_dir: str):
    """What the model files' headers and tables say: tokenizer bytes, tensors and bytes by type, after every check."""
    folder = shared.path_for(spark, "model-files")
    model_blob.write(tensors(spark, sf_dir), folder, tokenizer_blob.dump_merges(["<s>"], [(104, 101), (257, 32)]))

    def read(batches):
        import pandas as pd

        for batch in batches:
            for path, blob in zip(batch["path"], batch["content"]):
                held, table_ = model_blob.check(bytes(blob))
                version, specials, merges = tokenizer_blob.load(held)
                for entry in table_:
                    yield pd.DataFrame({"model": [path.rsplit("/", 1)[1][:-5]], "merges": [len(merges)], "dtype": [int(entry["dtype"])], "bytes": [int(entry["bytes"])]})

    found = model_blob.files(spark, folder).select("path", "content").mapInPandas(read, "model string, merges long, dtype int, bytes long")
    return found.groupBy("model", "dtype").agg(F.max("merges").alias("merges"), F.count("*").alias("tensors"), F.sum("bytes").alias("bytes"))


pair("src_model_scan", model_scan, "select 'label' || label as name, (label % 3)::INTEGER as dtype, count(*) as n_rows, max(len(embedding)) as width, round(max(list_max(list_transform(embedding, lambda v: abs(v::DOUBLE)))), 3) as absmax from embeddings group by label")
pair("sink_model", model_sink, "select 'm' || label % 2 as model, (label % 3)::INTEGER as dtype, 2::BIGINT as merges, count(distinct label) as tensors, sum(len(embedding) * case label % 3 when 0 then 4 when 1 then 1 else 0 end + case label % 3 when 1 then 4 when 2 then len(embedding) // 32 * 18 else 0 end)::BIGINT as bytes from embeddings group by 1, 2")


def tokenizer_rows(spark, sf_dir: str):
    """Both versions of a tokenizer file of the corpus' most frequent words, packed by one task, unpacked by another."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", " ")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("n"))
    top = words.orderBy(F.desc("n"), "w").limit(64).select("w", "n")  # the feature is a vocabulary of a stated size

    def pack(batches):
        import pandas as pd

        rows = pd.concat(list(batches)) if batches else pd.DataFrame()
        rows = rows.sort_values(["n", "w"], ascending=[False, True])
        yield pd.DataFrame({"blob": [tokenizer_blob.dump_pieces([(w.encode(), -float(i)) for i, w in enumerate(rows["w"])]), tokenizer_blob.dump_merges(list(rows["w"][:3]), [(i, i + 1) for i in range(len(rows))])]})

    def unpack(batches):
        import pandas as pd

        for batch in batches:
            for blob in batch["blob"]:
                version, specials, rows = tokenizer_blob.load(bytes(blob))
                for i, (a, b) in enumerate(rows):
                    yield pd.DataFrame({"version": [version], "id": [i], "piece": [a.decode() if version == 2 else ""], "a": [0 if version == 2 else a], "score": [float(b)]})

    return top.coalesce(1).mapInPandas(pack, "blob binary").mapInPandas(unpack, "version long, id long, piece string, a long, score double")


TOP = "(select w, row_number() over (order by n desc, w) - 1 as i from (select w, count(*) as n from (select unnest(string_split(text, ' ')) as w from documents) d where w <> '' group by w order by n desc, w limit 64) t)"
pair("src_tokenizer_blob", tokenizer_rows, f"select 2::BIGINT as version, i as id, w as piece, 0::BIGINT as a, -i::DOUBLE as score from {TOP} union all select 1, i, '', i, (i + 1)::DOUBLE from {TOP}")


def checkpoint(spark, sf_dir: str):
    """A flat checkpoint made of the vectors, imported again: the tensors' names, shapes and sums."""
    folder, (d, hidden, layers, heads, kv, vocab) = shared.path_for(spark, "checkpoint"), (8, 16, 2, 4, 2, 10)
    size = vocab * d + layers * (2 * d + 2 * d * d + 2 * d * d // 2 + 3 * d * hidden) + d
    numbers = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(-(-size // 64)).select("embedding").collect()  # a checkpoint of this size has so many numbers
    flat = [v for r in numbers for v in r["embedding"]][:size]
    shared.write_file(spark, f"{folder}/m.bin", struct.pack("<7i", d, hidden, layers, heads, kv, vocab, 32) + struct.pack(f"<{size}f", *flat))

    def read(batches):
        import pandas as pd

        for batch in batches:
            for blob in batch["content"]:
                for name, x in tokenizer_blob.load_checkpoint(bytes(blob))[1].items():
                    yield pd.DataFrame({"tensor": [name], "n": [x.size], "total": [round(float(x.astype("f8").sum()), 4)]})

    return spark.read.format("binaryFile").load(folder).select("content").mapInPandas(read, "tensor string, n long, total double")


SHAPES = [("embed", 80), *((f"{i}.{name}", n) for name, n in (("norm1", 8), ("q", 64), ("k", 32), ("v", 32), ("o", 64), ("norm2", 8), ("gate", 128), ("down", 128), ("up", 128)) for i in (0, 1)), ("norm", 8)]
FLAT = "(select row_number() over (order by vec_id, j) as pos, v from (select vec_id, generate_subscripts(embedding, 1) as j, unnest(embedding)::DOUBLE as v from embeddings where vec_id < 100) e)"
BOUNDS = ", ".join(f"('{name}', {1 + sum(m for _, m in SHAPES[:i])}, {sum(m for _, m in SHAPES[:i + 1])})" for i, (name, n) in enumerate(SHAPES))
pair("src_checkpoint_import", checkpoint, f"select tensor, count(*) as n, round(sum(v), 4) as total from {FLAT} f join (values {BOUNDS}) s(tensor, low, high) on pos between low and high group by tensor")
