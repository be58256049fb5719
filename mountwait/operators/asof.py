"""Bounded, strict as-of left join.

``next_within``: for each left row, the right row of the same key with the
smallest time strictly after the left time and strictly before
``left time + window``.  ``prev_within``: the right row with the largest time
strictly before the left time and strictly after ``left time - window``.
Ties on the right time are settled by the ``tie`` column: the smallest value
wins in both directions (then the smallest carried values, so the choice is
always the same).  Left rows without a match (or with a null key or
time, or not ``eligible``) get a null match; no left row is dropped or
duplicated.

One plan at every size, DataFrame operations only (no UDF, no pairs, no job
while planning).  The left rows are shuffled once and joined to nothing
afterwards:

1. The right side is reduced before its exchange to one row per (key, time),
   the preferred one.  A million mounts at one instant cost one row a task.
2. Keys are counted over both sides.  A key above ``TARGET_CELL_ROWS`` rows is
   hot; a hot key gets equal-depth cuts of its times from a quantile sketch
   (``percentile_approx``), so that bursts are cut as finely as they are dense.
   The ``HOT_KEYS`` largest at most are cut, into twice as many cells at most (any
   other key has less than that share of all rows); their cuts are broadcast.
3. A row's cell is its place among its key's cuts, by binary search (cell 0
   for all other keys).  An instant that spans several cuts is spread over
   their cells by a hash of the row.  Cells grow with time within a key, right
   rows of an instant go to its first cell (last, going backward).
4. Both sides meet in one exchange by (key, cell).  A window per (key, cell), in
   the order of time, carries the nearest right row to each left row.
5. Left rows of hot keys without a right row in their own cell take the
   carry row of the nearest cell that has one: one row per cell of a hot key,
   broadcast.  Without hot keys, steps 2, 3 and 5 vanish when the plan adapts.

Several lookups of one table (``asof_lookups``) that share key and time share one
exchange and differ only in their windows; lookups by other keys follow one
after another on the same rows.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mountwait.functions.search import cuts_below
from mountwait.functions.timecols import as_duration_us, epoch_micros

# A key with more rows than this is cut (session setting mountwait.asof.targetCellRows).
TARGET_CELL_ROWS = 1_000_000
# Bounds of what is broadcast: hot keys, and cells of one hot key (a power of two).
HOT_KEYS = 100_000
MAX_CELLS = 1024
# percentile_approx: rank error 1 / accuracy of the key's rows, far below one cell
_ACCURACY = 20 * MAX_CELLS
_RANKS = ", ".join(f"{i / MAX_CELLS!r}D" for i in range(1, MAX_CELLS))

_K, _S, _C, _R, _M, _N = "_aj_k", "_aj_s", "_aj_c", "_aj_r", "_aj_m", "_aj_n"
_CUTS = "_aj_cuts"
_SIGN = {"forward": 1, "backward": -1}


def _as_list(x) -> list[str]:
    if x is None:
        return []
    return [x] if isinstance(x, str) else list(x)


def _conf_int(spark, key: str, default: int) -> int:
    """An integer session setting, or ``default`` when unset."""
    try:
        value = spark.conf.get(key, None)
    except Exception:
        value = None
    return int(value) if value else default


def _require(df: DataFrame, side: str, cols: list[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{side} side lacks columns {missing}; has {df.columns}")


# ------------------------------------------------------------------ the two sides

def _right_rows(right: DataFrame, by: str, time: str, tie: str | None, carry: list[str], key_type) -> DataFrame:
    """One row per (key, time): the right row with the smallest tie, then the smallest carried values."""
    fields = [F.col(time).alias("time")]
    if tie is not None:
        fields.append(F.col(tie).alias(tie))
    fields += [F.col(c) for c in carry]
    prefer = [F.col(tie).isNull().alias("n"), F.col(tie).alias("t")] if tie is not None else []
    rows = right.filter(F.col(by).isNotNull() & F.col(time).isNotNull()).select(
        F.col(by).cast(key_type).alias(_K), epoch_micros(time).alias(_S),
        F.struct(*prefer, F.struct(*fields).alias("m")).alias(_M))
    return rows.groupBy(_K, _S).agg(F.min(_M).getField("m").alias(_M)).selectExpr(_K, _S, _M, f"0 as {_R}")


# ------------------------------------------------------------------ cells of hot keys
# Expressions are SQL text: one call to the JVM each, and short to read.

def hot_cuts(points: DataFrame, target: int) -> DataFrame:
    """(key, cuts) of the hot keys of ``points`` (key, time, a non-null mark).

    ``cuts`` are inner boundaries of equal depth, ascending: a key of n rows gets
    one cell per ``target`` rows, at most ``MAX_CELLS``.
    """
    counts = points.groupBy(_K).agg(F.count(_N).alias(_N)).filter(f"{_N} > {target}")
    # the largest HOT_KEYS: any other key has less than 1 / HOT_KEYS of all rows.  They are one
    # partition of that many rows at most, so their sum is taken there.
    hot = counts.orderBy(F.desc(_N), _K).limit(HOT_KEYS).selectExpr(
        _K, _N, f"greatest({target}, ceil(sum({_N}) over () / {HOT_KEYS})) as bound")
    hot = hot.selectExpr(_K, f"cast(least({MAX_CELLS}, ceil({_N} / bound)) as int) as cells").filter("cells > 1")
    # the mark is read here too, so that the right rows' exchange serves both
    depth = points.join(F.broadcast(hot), _K).groupBy(_K, "cells").agg(F.expr(
        f"percentile_approx(if({_N} is null, null, {_S}), array({_RANKS}), {_ACCURACY})").alias("q"))
    return depth.selectExpr(_K, f"transform(sequence(1, cells - 1), i -> element_at(q, cast(floor(i * {MAX_CELLS} / cells) as int))) as {_CUTS}")


def _below(strict: bool) -> str:
    """Number of the row's cuts below its time (or up to it, unless ``strict``)."""
    return cuts_below(_CUTS, _S, MAX_CELLS, strict)


# ------------------------------------------------------------------ one pass

def _carry(rights: DataFrame, cuts: DataFrame, way: str) -> DataFrame:
    """(key, cell, carry) of hot keys: the nearest right row in the cells beyond; one row per cell.

    The first right row of a cell (the last, going backward) serves the cells between it and the
    next cell that has one.
    """
    sign, at = _SIGN[way], _below(way == "forward")
    edges = (rights.join(cuts, _K).selectExpr(_K, f"{at} as c", f"size({_CUTS}) as n", f"struct({sign} * {_S} as o, {_M} as m) as e")
             .groupBy(_K, "n", "c").agg(F.min("e").alias("e")))
    order = f"over (partition by {_K} order by c)"
    serves = (f"sequence(coalesce(lag(c) {order}, 0), c - 1)" if way == "forward"
              else f"sequence(c + 1, coalesce(lead(c) {order}, n))")
    some = "c > 0" if way == "forward" else "c < n"
    return (edges.selectExpr(_K, f"e.m as _aj_c_{way}", f"if({some}, {serves}, array()) as cells")
            .selectExpr(_K, f"_aj_c_{way}", f"explode(cells) as {_C}"))


def in_cells(keyed: DataFrame, rights: DataFrame, cuts: DataFrame, names: list[str], ways: list[str]) -> DataFrame:
    """Both sides as rows with a cell; the right rows' match stands in a column per direction.

    Left rows that take no part are dealt out over negative cells of the null key.  Going forward
    a right row stands in the first cell of its instant, going backward in the last.
    """
    rows = keyed.unionByName(rights, allowMissingColumns=True).join(cuts, _K, "left")
    mine = (f"cast(case when {_K} is null then -1 - pmod(_aj_h, {1 << 20}) when {_CUTS} is null then 0 "
            "else lo + pmod(_aj_h, hi - lo + 1) end as int)")
    rows = rows.selectExpr(*names, _K, _S, _R, _M, _CUTS, "_aj_h", f"{_below(True)} as lo", f"{_below(False)} as hi")
    if len(ways) == 1:
        edge = "lo" if ways[0] == "forward" else "hi"
        return rows.selectExpr(*names, _K, _S, _R, f"if({_R} = 1, {mine}, {edge}) as {_C}", f"{_M} as {ways[0]}")
    one = f"struct(if({_R} = 1, {mine}, lo) as {_C}, {_M} as forward, {_M} as backward)"
    two = f"struct(lo as {_C}, {_M} as forward, null as backward), struct(hi as {_C}, null as forward, {_M} as backward)"
    return rows.selectExpr(*names, _K, _S, _R, f"inline(if({_R} = 1 or lo = hi, array({one}), array({two})))")


def _pass(left: DataFrame, rights: DataFrame, by: str, time: str, lookups: list[dict], target: int,
          counted: DataFrame, spread: list[str]) -> DataFrame:
    """left with one match column per lookup; all of them by the same key and time.

    ``counted`` holds the left rows that size the cells: ``left`` itself or a
    cheaper frame with the same keys and times.
    """
    flags = [F.coalesce(lk["eligible"], F.lit(False)) if lk.get("eligible") is not None else F.lit(True)
             for lk in lookups]
    okay = F.expr(f"`{by}` is not null and `{time}` is not null") & functools.reduce(Column.__or__, flags)
    micros = epoch_micros(time)
    points = counted.filter(okay).select(F.col(by).alias(_K), micros.alias(_S), F.lit(1).alias(_N))
    # the mark keeps the reduced right rows whole here, so that their one exchange is used again below
    cuts = F.broadcast(hot_cuts(points.union(rights.selectExpr(_K, _S, f"if({_M} is null, null, 1)")), target))

    # equal hashes for equal rows: a row is dealt out the same way in every attempt of a task
    names, oks = [f"`{c}`" for c in left.columns], [f"_aj_ok{n}" for n in range(len(flags))]
    deal = F.expr(f"xxhash64({', '.join(f'`{c}`' for c in spread)})")
    keyed = left.select("*", *[c.alias(n) for c, n in zip(flags, oks)], F.when(okay, F.col(by)).alias(_K),
                        F.when(okay, micros).alias(_S), deal.alias("_aj_h"), F.lit(1).alias(_R))
    ways = [w for w in _SIGN if any(lk.get("direction", "forward") == w for lk in lookups)]
    rows = in_cells(keyed, rights, cuts, [*names, *oks], ways)

    # equal times: left rows before the right row, which is thus never their own match
    run = [f"last({w}, true) over (partition by {_K}, {_C} order by {-_SIGN[w]} * {_S}, {_R} desc "
           f"rows between unbounded preceding and current row) as _aj_{w}" for w in ways]
    rows = rows.selectExpr(*names, *oks, _K, _S, _R, _C, *run).filter(f"{_R} = 1")
    for w in ways:
        rows = rows.join(F.broadcast(_carry(rights, cuts, w)), [_K, _C], "left")
    rows = rows.selectExpr(*names, _S, *oks, *[f"coalesce(_aj_{w}, _aj_c_{w}) as _aj_{w}" for w in ways])
    found = []
    for n, lk in enumerate(lookups):
        w = lk.get("direction", "forward")
        gap = (epoch_micros(f"_aj_{w}.time") - F.col(_S)) * _SIGN[w]
        found.append(F.when(F.col(f"_aj_ok{n}") & (gap < F.lit(lk["window_us"])), F.col(f"_aj_{w}")).alias(lk["match"]))
    return rows.select(*names, *found)


# ------------------------------------------------------------------ public forms

def asof_lookups(left: DataFrame, right: DataFrame, *, right_by: str, right_time: str,
                 lookups: Sequence[dict], tie: str | None = None,
                 carry: Sequence[str] | str | None = None,
                 target_cell_rows: int | None = None, spread: Sequence[str] | str | None = None) -> DataFrame:
    """Several as-of lookups of one table against one right table.

    Each lookup is a dict with ``left_by``, ``left_time``, ``window``,
    ``match`` (output column) and optionally ``direction`` (default forward) and
    ``eligible``.  Lookups of the same key and time share one exchange of
    the rows; nothing is joined back, so rows and ids may repeat.  The right side
    is reduced and exchanged once for all lookups of the same key type.

    ``spread`` names the columns that tell rows of one key and instant apart
    (an id); by default all columns do.  Only where rows go depends on them.
    """
    target = target_cell_rows or _conf_int(left.sparkSession, "mountwait.asof.targetCellRows", TARGET_CELL_ROWS)
    carry = [c for c in _as_list(carry) if c not in (right_time, tie)]
    _require(right, "right", [right_by, right_time, *([tie] if tie else []), *carry])
    spread = _as_list(spread) or [f.name for f in left.schema if f.dataType.typeName() not in ("map", "variant")]
    groups: dict[tuple[str, str], list[dict]] = {}
    for lk in lookups:
        if lk.get("direction", "forward") not in ("forward", "backward"):
            raise ValueError("direction must be 'forward' or 'backward'")
        _require(left, "left", [lk["left_by"], lk["left_time"]])
        win_us = as_duration_us(lk["window"])
        if win_us <= 0:
            raise ValueError("window must be positive")
        groups.setdefault((lk["left_by"], lk["left_time"]), []).append({**lk, "window_us": win_us})
    out = left
    for (by, time), own in groups.items():
        rights = _right_rows(right, right_by, right_time, tie, carry, left.schema[by].dataType)
        # cells are sized on ``left``, which holds every key and time, not on an earlier pass's result
        out = _pass(out, rights, by, time, own, target, left, spread)
    return out.select(*left.columns, *[lk["match"] for lk in lookups])


def asof_within(left: DataFrame, right: DataFrame, *, left_by: str, right_by: str, left_time: str,
                right_time: str, window, direction: str = "forward", tie: str | None = None,
                carry: Sequence[str] | str | None = None, eligible: Column | None = None,
                match: str = "match", target_cell_rows: int | None = None,
                spread: Sequence[str] | str | None = None) -> DataFrame:
    """Attach the nearest right row within ``window`` as struct column ``match``.

    ``match`` has fields ``time`` (the right time), ``tie`` (when given) and
    the ``carry`` columns, or is null.  ``direction`` is ``"forward"`` (next
    right row) or ``"backward"`` (previous right row).  ``window`` is a
    ``timedelta`` or seconds.  A key with more than ``target_cell_rows`` rows of
    both sides (default: session setting ``mountwait.asof.targetCellRows``, else
    ``TARGET_CELL_ROWS``) is cut by time; this changes how the work is dealt out
    and nothing else.  ``spread`` is that of ``asof_lookups``.
    """
    return asof_lookups(left, right, right_by=right_by, right_time=right_time, tie=tie, carry=carry,
                        target_cell_rows=target_cell_rows, spread=spread,
                        lookups=[dict(left_by=left_by, left_time=left_time, window=window, direction=direction,
                                      match=match, eligible=eligible)])


def next_within(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    """Forward bounded as-of left join (first right row strictly after, strictly inside)."""
    return asof_within(left, right, direction="forward", **kw)


def prev_within(left: DataFrame, right: DataFrame, **kw) -> DataFrame:
    """Backward bounded as-of left join (last right row strictly before, strictly inside)."""
    return asof_within(left, right, direction="backward", **kw)
