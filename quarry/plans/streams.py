"""Structured Streaming over the event table, run until no data is left."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import shared
from ..streaming import sessions
from .dialect import pair, table

LINE = "case event_id % 9 when 0 then 'fan=2' when 1 then 'HEAT=1' when 2 then 'win=1' when 3 then 'hello' when 4 then '/reset' when 5 then 'win=0' when 6 then '  ' when 7 then 'fan=0' else '/kv-reset' end"


def folder(spark) -> str:
    return shared.path_for(spark, "stream")


def source(spark, sf_dir: str):
    """The events as a stream of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def timed(spark, sf_dir: str):
    return source(spark, sf_dir).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def finished_hours(spark, sf_dir: str):
    """Counts by hour and type of the hours that the watermark, an hour behind the latest event, has passed; the others are still open."""
    counts = timed(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    found = sessions.run_available(counts.select(F.unix_micros("w.start").alias("hour_us"), "event_type", "n"), folder(spark))
    return found


#: Slices in which the events arrive; minutes of the watermark and of the gap that ends a session.
SLICES, BEHIND, GAP = 8, 60, 30


def arriving(spark, sf_dir: str):
    """The events as a stream in slices of their order: some come a slice late, but within the watermark, and some three slices late."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("event_id")).first()[0]
    sliced = events.withColumn("slice", F.expr(f"cast(event_id * {SLICES} div {last + 1} as int)")) if last is not None else events.withColumn("slice", F.lit(0))
    ends = F.broadcast(sliced.groupBy("slice").agg(F.max("ts").alias("end")))  # a row a slice
    late = "case when event_id % 50 = 7 then 3 when event_id % 2 = 0 and ts > end - interval 20 minutes then 1 else 0 end"
    told = sliced.join(ends, "slice").select("event_id", "user_id", "ts", F.expr(f"least({SLICES - 1}, slice + {late})").alias("at"))
    folder_ = f"{folder(spark)}/arrived"
    return sessions.in_order(told, SLICES, F.col("at"), folder_)


def session_windows(spark, sf_dir: str, progress: list | None = None):
    """Sessions of each user that the watermark has closed: start, end and number of events; rows that come after the watermark are left out."""
    found = arriving(spark, sf_dir).withWatermark("ts", f"{BEHIND} minutes").groupBy("user_id", F.session_window("ts", f"{GAP} minutes").alias("w")).agg(F.count("*").alias("n"))
    told = found.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")
    ran = folder(spark)
    return sessions.whole_sessions(sessions.run_available(told, ran, progress), ran)


def late_count(spark, sf_dir: str):
    """How many rows the session windows left out."""
    progress: list = []
    session_windows(spark, sf_dir, progress)
    return spark.createDataFrame([(len([p for p in progress if p["numInputRows"]]), sessions.late_rows(progress))], "batches int, late long")


def session_events(spark, sf_dir: str):
    lines = source(spark, sf_dir).select((F.col("user_id") % 50).alias("session"), F.col("event_id").alias("seq"), F.expr(LINE).alias("line"))
    return sessions.run_available(sessions.stream(lines), folder(spark))


def waits(spark, sf_dir: str):
    """For each user the first purchase within six hours of the first event, or the deadline."""
    found = sessions.wait_until(timed(spark, sf_dir), F.col("user_id"), F.col("event_type") == "purchase", WAIT)
    return sessions.run_available(found, folder(spark))


WAIT = 6 * 3600
pair("stream_events_batchsim", finished_hours, "select @epoch_us(hour) as hour_us, event_type, n from (select date_trunc('hour', ts) as hour, event_type, count(*) as n from events group by 1, 2) e where hour + interval 1 hour <= (select max(ts) - interval 1 hour from events)")
pair("stream_wait_until", waits, f"""select session, case when hit is null then deadline else hit end as at_us, case when hit is not null then event_id end as event_id, hit is null as timed_out
  from (select user_id as session, min(@epoch_us(ts)) + {WAIT * 10**6} as deadline from events group by 1) d
  left join (select user_id, us as hit, event_id from (select e.user_id, @epoch_us(e.ts) as us, event_id, row_number() over (partition by e.user_id order by e.ts, event_id) as r from events e
    join (select user_id, min(@epoch_us(ts)) + {WAIT * 10**6} as deadline from events group by 1) b on e.user_id = b.user_id where event_type = 'purchase' and @epoch_us(e.ts) <= deadline) p where r = 1) h on h.user_id = d.session
  where deadline // 1000 + 1 <= (select max(@epoch_us(ts)) // 1000 from events)""")
# the fold of each session's lines, one line of all sessions a round
SET = "substr(low, 1, instr(low, '=') - 1)"
pair("stream_session_state", session_events, f"""with recursive lines as (select user_id % 50 as session, event_id as seq, lower(trim({LINE}, ' ')) as low, row_number() over (partition by user_id % 50 order by event_id) as r from events),
  fold as (select session, 0::BIGINT as r, 0::BIGINT as seq, '' as event, 0 as fan, 0 as heat, 0 as win, []::BIGINT[] as history from (select distinct user_id % 50 as session from events) s
  union all select session, r, seq, event, case when event = 'reset' then 0 when event = 'ok' and low like 'fan=%' then value else fan end,
    case when event = 'reset' then 0 when event = 'ok' and low like 'heat=%' then value else heat end, case when event = 'reset' then 0 when event = 'ok' and low like 'win=%' then value else win end,
    case when event in ('reset', 'forgotten') then [] when event in ('rejected', 'unknown') then history else list_filter(list_append(history, strlen(low)), lambda x, i: len(history) + 2 - i <= {sessions.TURNS} and list_sum(list_append(history, strlen(low))[i:]) <= {sessions.BYTES}) end
  from (select f.session, l.r, l.seq, l.low, fan, heat, win, history, coalesce(try_cast(split_part(low, '=', 2) as integer), 0) as value,
    case when low = '' then 'rejected' when low = '/reset' then 'reset' when low = '/kv-reset' then 'forgotten' when low like '/%' then 'unknown' when not regexp_matches(low, '^(fan=[0-3]|heat=[01]|win=[01])$') then 'chat'
      when low = 'heat=1' and win = 1 or low = 'win=1' and heat = 1 then 'heater_window' else 'ok' end as event
    from fold f join lines l on l.session = f.session and l.r = f.r + 1) x)
  select session, seq, event, fan, heat, win, len(history)::INTEGER as kept, coalesce(list_sum(history), 0)::INTEGER as bytes from fold where r > 0""")

ARRIVED = f"""placed as (select event_id, user_id, @epoch_us(ts) as us, (event_id * {SLICES} // (select max(event_id) + 1 from events))::INTEGER as slice from events),
  moved as (select event_id, user_id, us, slice, least({SLICES - 1}, slice + case when event_id % 50 = 7 then 3 when event_id % 2 = 0 and us > e.last - {20 * 60 * 10**6} then 1 else 0 end) as pos from placed p join (select slice as s, max(us) as last from placed group by 1) e on p.slice = e.s),
  marks as (select s.pos, max(m.us) // 1000 * 1000 - {BEHIND * 60 * 10**6} as mark from (select distinct pos from moved) s left join moved m on m.pos < s.pos - 1 group by 1),
  judged as (select m.*, mark is null or us + {GAP * 60 * 10**6} > mark as in_time from moved m join marks on marks.pos = m.pos)"""
pair("stream_session_windows", session_windows, f"""with {ARRIVED},
  started as (select user_id, us, case when us - lag(us) over (partition by user_id order by us) < {GAP * 60 * 10**6} then 0 else 1 end as s from judged where in_time),
  numbered as (select user_id, us, sum(s) over (partition by user_id order by us rows unbounded preceding) as k from started)
  select user_id, min(us) as start_us, max(us) + {GAP * 60 * 10**6} as end_us, count(*) as n from numbered group by user_id, k having max(us) + {GAP * 60 * 10**6} <= (select max(us) // 1000 * 1000 - {BEHIND * 60 * 10**6} from moved)""")
pair("stream_late_rows", late_count, f"with {ARRIVED} select (select count(distinct pos) from moved)::INTEGER as batches, count(*) filter (not in_time) as late from judged")
