"""Stop rules of a token stream as a finite automaton, folded over arrays of tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Classes of tokens: anything else, the end of the stream, the end of the reply, the start and the end of an action.
OTHER, END, CLOSE, OPEN, SHUT = range(5)
#: States: in the reply, after it, in an action, and in an action that began before the reply had ended.
REPLY, AFTER, ACTION, EARLY = range(4)
#: Tokens that all actions together may take.
ACTION_TOKENS = 24


def transitions() -> list[tuple[int, int, int | None, str | None]]:
    """(state, class, next state, reason); a row with a reason stops."""
    rows: list[tuple[int, int, int | None, str | None]] = [(s, END, None, "end") for s in (REPLY, AFTER, ACTION, EARLY)]
    rows += [(AFTER, c, None, "malformed") for c in (OTHER, CLOSE, SHUT)] + [(AFTER, OPEN, ACTION, None)]
    rows += [(REPLY, OTHER, REPLY, None), (REPLY, SHUT, REPLY, None), (REPLY, CLOSE, AFTER, None), (REPLY, OPEN, EARLY, None)]
    rows += [(ACTION, c, ACTION, None) for c in (OTHER, CLOSE, OPEN)] + [(ACTION, SHUT, AFTER, None)]
    return rows + [(EARLY, OTHER, EARLY, None), (EARLY, OPEN, EARLY, None), (EARLY, CLOSE, ACTION, None), (EARLY, SHUT, REPLY, None)]


def stops(rows: DataFrame, classes: str, prompt: str, limit: int, context: int, action: int = ACTION_TOKENS) -> DataFrame:
    """rows with reason and stopped_at, how many of the tokens stand when the stream stops.

    ``classes`` is a column with the class of each token, ``prompt`` one with the tokens before them.  A stream stops with
    "end", with "malformed" at a token after the reply that opens no action, with "action" when actions take more than
    ``action`` tokens, with "limit" after ``limit`` tokens, with "context" when the next token would not fit the
    context, and with "open" when the tokens run out.  The token that stops it counts.
    """
    table = {(s, c): (n, r) for s, c, n, r in transitions()}
    flat = [table[s, c] for s in range(4) for c in range(5)]
    following = "array(" + ", ".join(str(-1 if n is None else n) for n, _ in flat) + ")"
    reasons = "array(" + ", ".join("cast(null as string)" if r is None else f"'{r}'" for _, r in flat) + ")"
    # the state and the class give a place in both arrays; a token counts for the action if it is in one after it, or closes one
    place = "s.state * 5 + c"
    taken = f"s.acts + if(get({following}, {place}) in ({ACTION}, {EARLY}) or s.state in ({ACTION}, {EARLY}) and c = {SHUT}, 1, 0)"
    reason = f"coalesce(get({reasons}, {place}), case when {taken} > {action} then 'action' when {prompt} + s.n + 1 > {context} then 'context' when s.n + 1 >= {limit} then 'limit' end)"
    step = f"if(s.reason is null, struct(get({following}, {place}) as state, s.n + 1 as n, {taken} as acts, {reason} as reason), s)"
    start = "struct(0 as state, 0 as n, 0 as acts, cast(null as string) as reason)"
    fold = f"if({limit} <= 0, named_struct('state', 0, 'n', 0, 'acts', 0, 'reason', 'limit'), aggregate({classes}, {start}, (s, c) -> {step}))"
    return rows.withColumn("__s", F.expr(fold)).withColumn("reason", F.coalesce("__s.reason", F.lit("open"))).withColumn("stopped_at", F.col("__s.n")).drop("__s")
