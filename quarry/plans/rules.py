"""Device states, actions and the rule engine over them."""

from __future__ import annotations

from .dialect import add

#: A device state for each event, by whole-number arithmetic; sensors are null now and then.
STATE = """(select event_id, user_id, ts, event_type,
  case when event_id % 17 = 0 then null else ((event_id * 7) % 471 - 50) / 10.0E0 end as t,
  case when event_id % 19 = 0 then null else 10 + (event_id * 11) % 90 end as h,
  (event_id * 13) % 101 as soil, event_id % 4 as fan, (event_id div 4) % 2 as heat, (event_id div 2) % 2 as pump,
  (event_id % 11) * 10 as light, (event_id div 8) % 2 as win, ((event_id * 3) % 36) / 10.0E0 as pa,
  case when event_id % 5 = 0 then 1 else 0 end as vib,
  case event_id % 6 when 1 then 3 when 2 then 5 when 3 then 7 else 0 end as err
  from events)"""

#: The twelve rule names in order of priority.
RULES = "pump_blocked pump_dry heater_fault window_fault pump_fault sensor_offline fan_bearing too_hot too_cold too_humid soil_dry soil_wet".split()
#: What one pair of an action may be.
PAIR = "^(fan=0*[0-3]|heat=0*[01]|pump=0*[01]|light=0*([1-9]?0|100)|win=0*[01]|ack=0*[1-9][0-9]?|diag=(" + "|".join(RULES) + "))$"


def _pair(shift: int) -> str:
    return f"""case (event_id + {shift}) % 8
    when 0 then concat('fan=', cast((event_id div 3) % 5 as string)) when 1 then concat('heat=', cast((event_id div 5) % 3 as string))
    when 2 then concat('pump=', cast((event_id div 2) % 2 as string))
    when 3 then concat('light=', cast(((event_id div 7) % 12) * 10 + case when event_id % 13 = 0 then 5 else 0 end as string))
    when 4 then concat('win=', cast((event_id div 9) % 2 as string)) when 5 then concat('ack=', cast((event_id div 2) % 8 as string))
    when 6 then concat('diag=', case (event_id div 8) % 4 when 0 then 'too_hot' when 1 then 'soil_dry' when 2 then 'nope' else 'pump_dry' end)
    else 'zap=1' end"""


BODY = f"""concat_ws(' ', {_pair(0)}, case when event_id % 2 = 0 then {_pair(3)} end, case when event_id % 6 = 0 then {_pair(4)} end,
  case when event_id % 12 = 0 then {_pair(1)} end, case when event_id % 24 = 0 then {_pair(2)} end)"""
BODIES = f"(select *, {BODY} as body from {STATE} s)"
OK = f"""(size(split(body, ' ')) between 1 and 4 and size(filter(split(body, ' '), p -> not regexp_like(p, '{PAIR}'))) = 0
  and size(array_distinct(transform(split(body, ' '), p -> regexp_extract(p, '^[a-z]+', 0)))) = size(split(body, ' ')))"""


def _value(key: str) -> str:
    return f"try_cast(nullif(regexp_extract(body, '(^| ){key}=([0-9]+)', 2), '') as int) as a_{key}"


KEYS = ["fan", "heat", "pump", "light", "win", "ack"]
PARSED = f"(select *, {OK} as ok, {', '.join(map(_value, KEYS))}, nullif(regexp_extract(body, '(^| )diag=([a-z_]+)', 2), '') as a_diag from {BODIES} b)"
VERDICT = """case when not ok then 'malformed'
  when a_heat = 1 and err = 3 then 'fault_heater'
  when a_win is not null and a_win <> win and err = 5 then 'fault_window'
  when a_pump = 1 and err = 7 then 'fault_pump'
  when a_ack is not null and (err = 0 or a_ack <> err) then 'ack_mismatch'
  when a_heat = 1 and t >= 35.0E0 then 'overheat'
  when (a_heat is not null or a_win is not null) and coalesce(a_heat, heat) = 1 and coalesce(a_win, win) = 1 then 'heater_window'
  else 'ok' end"""
JUDGED = f"(select *, {VERDICT} as verdict from {PARSED} p)"

CONDITIONS = [
    "pump = 1 and pa >= 2.5E0", "pump = 1 and pa <= 0.3E0", "err = 3", "err = 5", "err = 7", "t is null or h is null", "fan > 0 and vib = 1",
    "t >= 32.0E0", "t <= 12.0E0", "h >= 75", "soil <= 25 and pump = 0", "soil >= 85",
]
MATCHES = "array_join(filter(array(" + ", ".join(f"case when {c} then '{r}' else '' end" for r, c in zip(RULES, CONDITIONS)) + "), x -> x <> ''), ',')"
FIRST = "case " + " ".join(f"when {c} then '{r}'" for r, c in zip(RULES, CONDITIONS)) + " end"
REMEDY = """case first_rule
  when 'pump_blocked' then 'pump=0' when 'pump_dry' then 'pump=0' when 'fan_bearing' then 'fan=0'
  when 'too_hot' then concat_ws(' ', case when heat = 1 then 'heat=0' end, case when fan < 3 and vib = 0 then 'fan=3' end, case when win = 0 and err <> 5 then 'win=1' end)
  when 'too_cold' then concat_ws(' ', case when win = 1 and err <> 5 then 'win=0' end, case when heat = 0 and err <> 3 and (win = 0 or err <> 5) then 'heat=1' end)
  when 'too_humid' then case when fan < 3 then concat('fan=', cast(least(3, greatest(2, fan + 1)) as string)) else '' end
  when 'soil_dry' then case when err <> 7 then 'pump=1' else '' end
  when 'soil_wet' then case when pump = 1 then 'pump=0' else '' end
  else '' end"""
#: Rules whose remedy also names the rule.
NAMED = "first_rule in ('pump_blocked', 'pump_dry', 'fan_bearing') or remedy = ''"
DIAGNOSED = f"(select *, {FIRST} as first_rule from {STATE} s)"
REMEDIED = f"(select *, case when first_rule is null then null else concat_ws(' ', nullif(remedy, ''), case when {NAMED} then concat('diag=', first_rule) end) end as action from (select *, {REMEDY} as remedy from {DIAGNOSED} d) r)"

#: Our own words for verdicts.
VERDICTS = [
    ("ok", 0, "accepted"), ("malformed", 1, "cannot be read"), ("fault_heater", 2, "the heater reports a fault"), ("fault_window", 3, "the window reports a fault"),
    ("fault_pump", 4, "the pump reports a fault"), ("ack_mismatch", 5, "no such fault to confirm"), ("overheat", 6, "already too warm to heat"), ("heater_window", 7, "heating with an open window"),
]
DIMENSION = " union all ".join(f"select '{c}' as code, {n} as number, '{m}' as message" for c, n, m in VERDICTS)

add("join_rule_match", f"select event_id, {MATCHES} as matches from {STATE} s")
add("rule_diagnose", f"select coalesce(first_rule, 'none') as first_rule, count(*) as n from {DIAGNOSED} d group by 1")
add("rule_remedy", f"select event_id, first_rule, action from {REMEDIED} r")
add("rule_validate", f"select event_id, verdict from {JUDGED} j")
add("rule_verdict_dim", f"with dim as ({DIMENSION}) select dim.number, dim.message, count(*) as n from {JUDGED} j join dim on j.verdict = dim.code group by 1, 2")
APPLIED = f"""(select event_id, coalesce(a_fan, fan) as fan, coalesce(a_heat, heat) as heat, coalesce(a_pump, pump) as pump, coalesce(a_light, light) as light,
  coalesce(a_win, win) as win, case when a_pump = 0 then 0.0E0 when a_pump = 1 and pump = 0 then 1.2E0 else pa end as pa, case when a_ack is not null then 0 else err end as err
  from {JUDGED} j where verdict = 'ok')"""
add("rule_apply", f"select event_id, cast(fan as bigint) as fan, cast(heat as bigint) as heat, cast(pump as bigint) as pump, cast(light as bigint) as light, cast(win as bigint) as win, pa, cast(err as bigint) as err from {APPLIED} a")
add("gen_validate_zero", f"select count(*) as violations from {APPLIED} a where heat = 1 and win = 1 or fan > 3 or light % 10 <> 0")
add("prj_struct_update", f"select event_id, @json('t', t, 'err', case when a_ack is not null then 0 else err end) as state from {JUDGED} j where verdict = 'ok'")

#: Operations on devices, drawn from the event.
COMMANDS = f"""(select *, case event_id % 5 when 0 then 'light' when 1 then 'fan' when 2 then 'heat' when 3 then 'pump' else 'win' end as device,
  case (event_id div 5) % 6 when 0 then 'on' when 1 then 'off' when 2 then 'set' when 3 then 'up' when 4 then 'down' else 'max' end as op,
  (event_id div 30) % 12 * 10 as arg from {STATE} s)"""
NOW = "case device when 'light' then light when 'fan' then fan when 'heat' then heat when 'pump' then pump else win end"
TARGET = """case when op = 'off' then 0
  when device in ('heat', 'pump', 'win') then case when op = 'on' then 1 end
  when op = 'on' then case when now > 0 then now when device = 'light' then 100 else 1 end
  when op = 'set' then case when device = 'light' and arg between 0 and 100 and arg % 10 = 0 then arg when device = 'fan' and arg <= 3 then arg end
  when op = 'max' then case when device = 'light' then 100 else 3 end
  when op = 'up' then case when device = 'light' and now < 100 then least(100, now + 20) when device = 'fan' and now < 3 then now + 1 end
  when op = 'down' then case when device = 'light' and now > 0 then greatest(0, now - 20) when device = 'fan' and now > 0 then now - 1 end
  end"""
RESOLVED = f"(select *, {TARGET} as target from (select *, {NOW} as now from {COMMANDS} c) n)"
REFUSAL = """case when target is null then 'cannot'
  when target = now then 'already'
  when device = 'heat' and target = 1 and err = 3 then 'fault'
  when device = 'heat' and target = 1 and t >= 35.0E0 then 'too warm'
  when device = 'heat' and target = 1 and win = 1 and err = 5 then 'window stuck open'
  when device = 'win' and err = 5 then 'fault'
  when device = 'pump' and target = 1 and err = 7 then 'fault'
  else '' end"""
COMMANDED = f"""(select *, case when refusal <> '' then null
  when device = 'heat' and target = 1 and win = 1 then 'win=0 heat=1'
  when device = 'win' and target = 1 and heat = 1 then 'heat=0 win=1'
  else concat(device, '=', cast(target as string)) end as action from (select *, {REFUSAL} as refusal from {RESOLVED} r) f)"""
add("rule_resolve_target", f"select event_id, device, op, cast(target as bigint) as target from {RESOLVED} r")
add("rule_device_command", f"select event_id, case when refusal = '' then 'done' else refusal end as reply, action from {COMMANDED} c")
add("rule_diag_reply", f"select event_id, case when first_rule is null then 'all is well' else concat('found ', first_rule, case when remedy <> '' then concat(', so ', @replace_all(remedy, ' ', ' and ')) else '' end) end as reply, action from (select *, {REMEDY} as remedy2 from {REMEDIED} r) q")
# a correction: put the first device back if it changed, then apply the operation to the other; if the revert is refused, only the second
add("rule_correction", f"""select event_id, coalesce(case when ok_back then back || ' ' || action end, action) as action, ok_back and action is not null as reverted
  from (select c.*, concat(device, '=', cast(now as string)) as back, not (device = 'heat' and now = 1 and err = 3) and not (device = 'pump' and now = 1 and err = 7) and not (device = 'win' and err = 5) and coalesce(target, now) <> now as ok_back from {COMMANDED} c) b""")

add("fn_action_parse", f"select event_id, ok, cast(a_fan as bigint) as a_fan, cast(a_light as bigint) as a_light, cast(a_ack as bigint) as a_ack, a_diag from {PARSED} p")
FORMATTED = "concat_ws(' ', " + ", ".join(f"case when a_{k} is not null then concat('{k}=', cast(a_{k} as string)) end" for k in KEYS) + ", case when a_diag is not null then concat('diag=', a_diag) end)"
add("fn_action_format", f"select event_id, {FORMATTED} as formatted from {PARSED} p where ok")
add("fn_describe_action", f"select event_id, array_join(transform(filter(split(body, ' '), p -> not startswith(p, 'diag=')), p -> concat('put ', @replace_all(p, '=', ' at '))), ' and ') as described from {PARSED} p where ok")
add("prj_actuators", f"select event_id, nullif(array_join(filter(split(body, ' '), p -> not startswith(p, 'diag=')), ' '), '') as actuators from {BODIES} b")
RENDERED = "concat('t=', coalesce(@one_decimal(t), 'na'), ' h=', coalesce(cast(h as string), 'na'), ' soil=', cast(soil as string), ' fan=', cast(fan as string), ' heat=', cast(heat as string), ' pump=', cast(pump as string), ' light=', cast(light as string), ' win=', cast(win as string), ' pa=', @one_decimal(pa), ' vib=', cast(vib as string), ' err=', cast(err as string))"
add("fn_state_render", f"select event_id, {RENDERED} as state from {STATE} s")
STRICT = "^t=(na|-?[0-9]+[.][0-9]) h=(na|[0-9]+) soil=([0-9]+) fan=([0-9]+) heat=([0-9]+) pump=([0-9]+) light=([0-9]+) win=([0-9]+) pa=([0-9]+[.][0-9]) vib=([0-9]+) err=([0-9]+)$"
BROKEN = f"(select event_id, case when event_id % 7 = 0 then @replace_all({RENDERED}, 'soil', 'sail') when event_id % 11 = 0 then concat({RENDERED}, ' x=1') else {RENDERED} end as line from {STATE} s)"
add("fn_state_parse", f"select event_id, regexp_like(line, '{STRICT}') as ok, try_cast(nullif(regexp_extract(line, '{STRICT}', 1), 'na') as double) as t, try_cast(nullif(regexp_extract(line, '{STRICT}', 2), 'na') as bigint) as h, case when regexp_like(line, '{STRICT}') then try_cast(regexp_extract(line, ' err=([0-9]+)$', 1) as bigint) end as err from {BROKEN} b")
#: The range of each key.
RANGES = {"t": (-40, 80), "pa": (0, 10), "h": (0, 100), "soil": (0, 100), "light": (0, 100), "fan": (0, 3), "heat": (0, 1), "pump": (0, 1), "win": (0, 1), "vib": (0, 1), "err": (0, 99)}
RANGE = " union all ".join(f"select '{k}' as k, {a} as lo, {b} as hi" for k, (a, b) in RANGES.items())
add("fn_assignment_parse", f"""with ranges as ({RANGE}), lines as (select event_id, concat(case event_id % 5 when 0 then 't' when 1 then 'h' when 2 then 'fan' when 3 then 'err' else 'zap' end, '=', case when event_id % 9 = 0 then 'x' else cast((event_id * 3) % 130 - 10 as string) end) as line from events)
  select event_id, line, case when v is null or ranges.k is null then 'bad' when v < lo or v > hi then 'range' else 'ok' end as result
  from (select event_id, line, element_at(split(line, '='), 1) as name, try_cast(element_at(split(line, '='), 2) as int) as v from lines) l left join ranges on l.name = ranges.k""")
add("fn_str_to_map", f"select event_id, element_at(transform(filter(split({RENDERED}, ' '), p -> startswith(p, 'light=')), p -> element_at(split(p, '='), 2)), 1) as light from {STATE} s")
add("fn_template_fill", f"select event_id, replace(replace('It is <t> degrees and <h> percent.', '<t>', coalesce(@one_decimal(t), 'unknown')), '<h>', coalesce(cast(h as string), 'unknown')) as reply from {STATE} s")
add("prj_alert_flags", f"select event_id, coalesce(t >= 32.0E0 or t <= 12.0E0, false) as a_t, coalesce(h >= 75, false) as a_h, soil <= 25 or soil >= 85 as a_soil, pump = 1 and (pa >= 2.5E0 or pa <= 0.3E0) as a_pa, err <> 0 as a_err from {STATE} s")
add("udf_rule_expr", f"select {', '.join(f'count_if({c}) as {r}' for r, c in zip(RULES, CONDITIONS))} from {STATE} s")
add("gen_state", """select id, case when mix < 6 then 'normal' else concat('case', cast(mix as string)) end as kind, case when mix = 7 then null else round(18 + u / 4294967296.0E0 * 8, 1) end as t
  from (select id, @draw(concat('mix|', cast(id as string))) % 18 as mix, @draw(concat('t|', cast(id as string))) as u from (select explode(sequence(1, 2000)) as id) r) d""")
