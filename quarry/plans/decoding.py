"""Decoding over tables: stop rules, draws, products of packed weights; and weights fitted to labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import automata, packed, sampling
from ..operators import training
from .dialect import pair, table, to_spark

# a turn's words as tokens, whose classes are drawn: the end, the end of the reply, the start and the end of an action, or another
CLASS = "case when {u} < 2 then 1 when {u} < 7 then 2 when {u} < 11 then 3 when {u} < 15 then 4 else 0 end"
DRAW = "@draw(concat('stop|', cast(conv_id as string), '|', cast(turn as string), '|', cast(i as string))) % 100"
LIMIT, CONTEXT = 48, 96


def stopped(spark, sf_dir: str):
    """Where and why each turn's tokens stop."""
    turns = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "cast(length(text) % 70 as int) as prompt", "array_remove(split(text, ' '), '') as w")
    tokens = turns.selectExpr("conv_id", "turn", "prompt", to_spark(f"transform(w, (x, i) -> {CLASS.format(u=DRAW)})") + " as classes")
    return automata.stops(tokens, "classes", "prompt", LIMIT, CONTEXT).select("conv_id", "turn", "reason", "stopped_at")


# the rules as they are stated, one token of all turns a step
pair("fn_stop_reason", stopped, f"""with recursive turns as (select conv_id, turn, (length(text) % 70)::INTEGER as prompt, len(list_filter(string_split(text, ' '), lambda w: w <> ''))::INTEGER as n from conversations),
  tokens as (select conv_id, turn, i + 1 as pos, {CLASS.format(u=DRAW)} as c from (select conv_id, turn, unnest(range(n)) as i from turns) t),
  steps as (select conv_id, turn, prompt, 0::BIGINT as pos, false as replied, false as inside, 0 as acts, null::VARCHAR as reason from turns
  union all select conv_id, turn, prompt, pos, replied or c = 2 as replied, case when c = 4 then false else inside or c = 3 end as inside, acts,
    case when c = 1 then 'end' when replied and not inside and c <> 3 then 'malformed' when acts > {automata.ACTION_TOKENS} then 'action' when prompt + pos > {CONTEXT} then 'context' when pos >= {LIMIT} then 'limit' end as reason
  from (select s.conv_id, s.turn, s.prompt, t.pos, s.replied, s.inside, t.c, s.acts + case when s.inside or t.c = 3 then 1 else 0 end as acts from steps s join tokens t on t.conv_id = s.conv_id and t.turn = s.turn and t.pos = s.pos + 1 where s.reason is null) x)
  select conv_id, turn, coalesce(max(reason), 'open') as reason, max(pos)::INTEGER as stopped_at from steps group by conv_id, turn""")

#: Draws for each vector, with the temperatures, how many logits stay, the penalty and its window.
DRAWS, TEMPERATURES, BEST, PENALTY, RECENT = 2, (0.0, 0.5, 1.5), 8, 1.3, 4


def drawn(spark, sf_dir: str):
    """Ids drawn with the vectors as logits, the seed a vector's id."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, v -> 8D * v) as logits", "transform(sequence(1, 6), i -> cast(vec_id * i * 7 % 70 as int)) as recent")
    state, states = sampling.seeded(F.col("vec_id")), []
    for k in range(DRAWS):
        state = sampling.next_state(state)
        rows = rows.withColumn(f"s{k}", state)
        state = F.col(f"s{k}")
        states.append(F.struct(F.lit(k).alias("draw"), sampling.uniform(state).alias("r")))
    rows = rows.withColumn("x", F.explode(F.array(*states))).withColumn("temperature", F.explode(F.array(*[F.lit(t) for t in TEMPERATURES])))
    rows = rows.select("vec_id", "logits", "recent", "temperature", F.col("x.draw").alias("draw"), F.col("x.r").alias("r"))
    return sampling.sampled(rows, BEST, PENALTY, RECENT).select("vec_id", "draw", "temperature", "r", "id")


def _xorshift(x: str) -> str:
    """The generator's step in unsigned 128-bit arithmetic."""
    a = f"xor({x}, {x} // 4096)"
    b = f"xor({a}, ({a} * 33554432) % 18446744073709551616::UHUGEINT)"
    return f"xor({b}, {b} // 134217728)"


pair("vec_sample_drawn", drawn, f"""with recursive states as (select vec_id, -1 as draw, case when vec_id = 0 then {sampling.STATE_OF_ZERO}::UHUGEINT else vec_id::UHUGEINT end as x from embeddings union all select vec_id, draw + 1, {_xorshift('x')} from states where draw < {DRAWS - 1}),
  draws as (select vec_id, draw, ((x * {sampling.FACTOR}::UHUGEINT) % 18446744073709551616::UHUGEINT // 1099511627776)::DOUBLE / 16777216 as r from states where draw >= 0),
  recents as (select vec_id, t, count(*) as times from (select vec_id, vec_id * unnest([3, 4, 5, 6]) * 7 % 70 as t from embeddings) k group by vec_id, t),
  logits as (select e.vec_id, e.i, case when z > 0 then z / pow({PENALTY}::DOUBLE, coalesce(times, 0)) else z * pow({PENALTY}::DOUBLE, coalesce(times, 0)) end as z from (select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::DOUBLE * 8 as z from embeddings) e left join recents on recents.vec_id = e.vec_id and t = e.i),
  ranked as (select vec_id, i, z, max(z) over (partition by vec_id) as top, nth_value(z, {BEST}) over (partition by vec_id order by z desc rows between unbounded preceding and unbounded following) as cut from logits),
  weights as (select vec_id, temperature, i, z, top, case when z >= cut then exp((z - top) / case when temperature > 0 then temperature else 1 end) else 0 end as w from ranked, (select unnest([{', '.join(f'{t}::DOUBLE' for t in TEMPERATURES)}]) as temperature) t),
  summed as (select vec_id, temperature, i, z, top, sum(w) over (partition by vec_id, temperature order by i) as acc, sum(w) over (partition by vec_id, temperature) as total from weights)
  select s.vec_id, d.draw::INTEGER as draw, s.temperature, d.r, coalesce(min(i) filter (temperature > 0 and r * total < acc), min(i) filter (z = top))::INTEGER as id from summed s join draws d on d.vec_id = s.vec_id group by s.vec_id, d.draw, s.temperature, d.r""")

SCALE = "if(array_max(transform(g, v -> abs(v))) > 0, array_max(transform(g, v -> abs(v))) / 7D, 1D)"


def packed_product(spark, sf_dir: str):
    """All vectors as rows of packed four-bit weights, times four of them."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "transform(embedding, v -> cast(v as double)) as x")
    grouped = rows.selectExpr("vec_id", f"transform(sequence(0, (size(x) - 1) div {packed.GROUP}), k -> slice(x, k * {packed.GROUP} + 1, {packed.GROUP})) as groups")
    scaled = grouped.selectExpr("vec_id", "groups", f"transform(groups, g -> {SCALE}) as scales")
    q = scaled.selectExpr("vec_id", "scales", "flatten(transform(groups, (g, k) -> transform(g, v -> cast(greatest(-7D, least(7D, rint(v / scales[k]))) as int)))) as q")
    four = rows.where("vec_id < 4").selectExpr("vec_id as k", "x")  # the vectors that are asked for, whatever the table's size
    weights = q.select("vec_id", "scales", packed.pack("q").alias("bytes"))
    return weights.crossJoin(F.broadcast(four)).select("vec_id", "k", F.round(packed.dot("bytes", "scales", "x"), 6).alias("y"))


# without packing: the rows made whole again, then a plain product
pair("vec_matvec_q4", packed_product, f"""with v as (select vec_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::DOUBLE as v from embeddings),
  scales as (select vec_id, (i - 1) // {packed.GROUP} as g, case when max(abs(v)) > 0 then max(abs(v)) / 7.0E0 else 1.0E0 end as scale from v group by 1, 2),
  whole as (select v.vec_id, i, scale * greatest(-7.0E0, least(7.0E0, round_even(v / scale, 0))) as w from v join scales s on s.vec_id = v.vec_id and s.g = (i - 1) // {packed.GROUP})
  select w.vec_id, x.vec_id as k, round(sum(w.w * x.v), 6) as y from whole w join v x on x.i = w.i where x.vec_id < 4 group by 1, 2""")

WIDTH = 32


def fitted(spark, sf_dir: str):
    """Weights of the words' hashes that tell good from bad documents, by mini-batches: the best step, its validation loss and each weight."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null")
    rows = training.hashed_words(table(spark, sf_dir, "documents").join(labels, "doc_id"), WIDTH).selectExpr("doc_id", "y", f"transform(x, v -> {WIDTH}D * v) as x")
    held = F.expr("crc32(cast(doc_id as string)) % 5 = 0")
    run = training.fit(rows.where(~held), rows.where(held), "doc_id", WIDTH)
    told = [(i, run.best_step, round(float(run.best_loss), 6), round(float(w), 6)) for i, w in enumerate(run.weights)]
    return spark.createDataFrame(told, "place int, best_step int, best_loss double, weight double")


pair("train_logistic", fitted)
