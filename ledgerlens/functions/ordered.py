"""Ranks, running sums and exact quantiles over a distributed sort.

A window without a partition key would put every row on one task, and a window
keyed by month would put a month's products or customers there. These
primitives range-partition the rows instead, remember each row's part, and add
the small per-part offsets afterwards.

The range split is staged before the offsets are computed: Spark samples range
bounds per execution, so two executions of the same split need not agree.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ledgerlens.session import stage

_PART, _POS = "_range_part", "_range_row"
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in its low 33 bits


def _sorted_parts(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """Rows tagged with their range part and their position inside it."""
    tagged = (
        df.repartitionByRange(*keys)  # no fixed count: adaptive execution may merge small neighbours
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
        .withColumn(_PART, F.shiftright("_mid", _ROW_BITS).cast("int"))
        .withColumn(_POS, F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
        .drop("_mid")
    )
    return stage(tagged)


def _with_offsets(tagged: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    # Rows are sorted by group first, so there are at most (parts + groups)
    # (part, group) pairs: the broadcast is bounded by configuration.
    return tagged.join(F.broadcast(offsets), [_PART, *by])


def add_rank(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "Rank") -> DataFrame:
    """1-based row number in `order` inside each `by` group.

    `order` must identify a row; `by` columns must not be null.
    """
    tagged = _sorted_parts(df, [*(F.col(c) for c in by), *order])
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(_PART, *by)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(_POS).alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"))
        .select(_PART, *by, "_before")
    )
    return (
        _with_offsets(tagged, offsets, by)
        .withColumn(name, F.col("_before") + F.col(_POS) + 1)
        .drop(_PART, _POS, "_before")
    )


def add_running_sums(
    df: DataFrame,
    sums: Mapping[str, str],
    order: Sequence[Column],
    by: Sequence[str] = (),
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Running sum per `by` group: `sums` maps an output name to a column.

    `totals` maps an output name to a column whose group total is added too.
    Columns should be integers or decimals, so that the split does not show.
    """
    totals = totals or {}
    tagged = _sorted_parts(df, [*(F.col(c) for c in by), *order])
    earlier = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    group = Window.partitionBy(*by)
    part_sums = tagged.groupBy(_PART, *by).agg(
        *(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()),
        *(F.sum(c).alias(f"_t_{n}") for n, c in totals.items()),
    )
    offsets = part_sums.select(
        _PART,
        *by,
        *(F.sum(f"_s_{n}").over(earlier).alias(f"_b_{n}") for n in sums),
        *(F.sum(f"_t_{n}").over(group).alias(n) for n in totals),
    )
    inside = (
        Window.partitionBy(_PART, *by).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    )
    local = tagged.select("*", *(F.sum(c).over(inside).alias(f"_l_{n}") for n, c in sums.items()))
    out = _with_offsets(local, offsets, by)
    for n in sums:
        out = out.withColumn(n, F.col(f"_l_{n}") + F.coalesce(F.col(f"_b_{n}"), F.lit(0)))
    return out.drop(_PART, _POS, *(f"_l_{n}" for n in sums), *(f"_b_{n}" for n in sums))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), narrow: bool = False
) -> DataFrame:
    """Linear-interpolation quantiles: one row per (by.., Variable, Prob).

    Equal values collapse to one counted row before the sort, so a value that
    holds a third of the table costs one row. Nulls and NaN are left out.

    `narrow` suits tables of lines: a first pass sketches where each quantile
    must lie, a second keeps only the values around it and counts the rest
    below. Two reads replace the sort of all values; the result is as exact.
    """
    cells = F.array(*(F.struct(F.lit(c).alias("Variable"), F.col(c).cast("double").alias("_v")) for c in columns))
    values = df.select(*by, F.explode(cells).alias("_e")).select(*by, "_e.Variable", "_e._v")
    values = values.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if narrow:
        found = _narrowed_quantiles(values, probs, by)
        if found is not None:
            return found
    groups = [*by, "Variable"]
    counted = values.groupBy(*groups, "_v").agg(F.count(F.lit(1)).alias("_n"))
    running = add_running_sums(counted, {"_upto": "_n"}, [F.col("_v")], groups, {"_all": "_n"})
    return _pick(running.withColumn("Prob", F.explode(F.array(*(F.lit(float(p)) for p in probs)))), groups)


def _pick(running: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Interpolated value per (group, Prob). A row covers the 0-based ranks [_upto - _n, _upto)."""
    target = (F.col("_all") - 1) * F.col("Prob")
    covers = lambda rank: (F.col("_upto") - F.col("_n") <= rank) & (rank < F.col("_upto"))
    low, high = F.floor(target), F.ceil(target)
    picked = (
        running.where(covers(low) | covers(high))
        .groupBy(*groups, "Prob")
        .agg(
            F.max(F.when(covers(low), F.col("_v"))).alias("_a"),
            F.max(F.when(covers(high), F.col("_v"))).alias("_b"),
            F.max(target - low).alias("_frac"),
        )
    )
    return picked.select(*groups, "Prob", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_frac")).alias("Value"))


_SKETCH = 10_000  # percentile_approx is off by at most one part in this many


def _narrowed_quantiles(values: DataFrame, probs: Sequence[float], by: Sequence[str]) -> DataFrame | None:
    """Quantiles from the neighbourhood a sketch names; null if a sketch missed."""
    groups = [*by, "Variable"]
    margin = 3 / _SKETCH
    ends = [(max(p - margin, 0.0), min(p + margin, 1.0)) for p in probs]
    sketch = values.groupBy(*groups).agg(
        F.percentile_approx("_v", [e for pair in ends for e in pair], _SKETCH).alias("_q"),
        F.count(F.lit(1)).alias("_all"),
    )
    brackets = F.array(
        *(
            F.struct(
                F.lit(float(p)).alias("Prob"),
                (F.col("_q")[2 * i] if a > 0 else F.lit(float("-inf"))).alias("_from"),
                (F.col("_q")[2 * i + 1] if b < 1 else F.lit(float("inf"))).alias("_to"),
            )
            for i, (p, (a, b)) in enumerate(zip(probs, ends))
        )
    )
    # One row per group, variable and quantile.
    wanted = stage(sketch.select(*groups, "_all", F.explode(brackets).alias("_b")).select(*groups, "_all", "_b.*"))
    counted = (
        values.join(F.broadcast(wanted), groups)
        .where(F.col("_v") <= F.col("_to"))
        # All values below the bracket share the key null, which sorts first.
        .withColumn("_v", F.when(F.col("_v") >= F.col("_from"), F.col("_v")))
        .groupBy(*groups, "Prob", "_all", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    running = add_running_sums(counted, {"_upto": "_n"}, [F.col("_v")], [*groups, "Prob"])
    found = stage(_pick(running, groups))
    if found.where(F.col("Value").isNotNull()).count() < wanted.count():
        return None
    return found


_GATHERED = 20_000  # values around all quantiles that the driver may hold


def quantile_values(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> dict[tuple[str, float], float]:
    """Quantiles of the whole table as driver values (columns x probs of them), linearly interpolated and exact.

    One pass sketches all columns, one counts what lies below and around every quantile. Where too many values lie
    around one for the driver, further passes sketch inside the brackets first. Nothing is sorted.
    """
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    sizes = df.agg(*(F.count(value[c]).alias(f"n{i}") for i, c in enumerate(columns)), *(
        f(value[c]).alias(f"{name}{i}") for i, c in enumerate(columns) for name, f in (("low", F.min), ("high", F.max))
    )).first()
    wanted = []
    for i, c in enumerate(columns):
        n = sizes[f"n{i}"]
        if n:
            wanted += [_Wanted(c, p, (n - 1) * p, sizes[f"low{i}"], sizes[f"high{i}"], 0, n) for p in probs]
    while sum(w.inside for w in wanted if w.low < w.high) > _GATHERED:
        before = [w.inside for w in wanted]
        _narrow(df, value, wanted)
        if [w.inside for w in wanted] == before:
            break
    out = {}
    # Several values that come very often share a bracket: they are counted in a table.
    crowded = [w for w in wanted if w.low < w.high and w.inside > _GATHERED]
    for w in crowded:
        out[w.column, w.prob] = exact_quantiles(df, [w.column], [w.prob]).first()["Value"]
    wanted = [w for w in wanted if w not in crowded]
    found = _gather(df, value, wanted)
    for k, w in enumerate(wanted):
        first, last = (_at(found.get(k, []), rank - w.below) for rank in (math.floor(w.rank), math.ceil(w.rank)))
        out[w.column, w.prob] = first + (last - first) * (w.rank - math.floor(w.rank))
    return out


@dataclass
class _Wanted:
    """A quantile, and the values [low, high] among which it is: `below` values are less than those `inside`."""

    column: str
    prob: float
    rank: float
    low: float
    high: float
    below: int
    inside: int


def _narrow(df: DataFrame, value: Mapping[str, Column], wanted: list[_Wanted]) -> None:
    """Closer brackets by a sketch of what is inside the present ones, and how much that is."""
    inside = lambda w, low, high: F.when((value[w.column] >= low) & (value[w.column] <= high), value[w.column])
    sketches = []
    for k, w in enumerate(wanted):
        # The sketch is off by one part in _SKETCH; ranks next to the quantile are needed too.
        slack = 2 + 2 * w.inside / _SKETCH
        ends = [(math.floor(w.rank) - w.below - slack) / w.inside, (math.ceil(w.rank) - w.below + 1 + slack) / w.inside]
        ends = [min(max(e, 0.0), 1.0) for e in ends]
        sketches.append(F.percentile_approx(inside(w, w.low, w.high), ends, _SKETCH).alias(f"q{k}"))
    row = df.agg(*sketches).first()
    closer = [tuple(row[f"q{k}"]) for k in range(len(wanted))]
    counts = []
    for k, (w, (low, high)) in enumerate(zip(wanted, closer)):
        counts += [F.count_if(value[w.column] < low).alias(f"b{k}"), F.count(inside(w, low, high)).alias(f"i{k}")]
    row = df.agg(*counts).first()
    for k, (w, (low, high)) in enumerate(zip(wanted, closer)):
        below, count = row[f"b{k}"], row[f"i{k}"]
        if below <= math.floor(w.rank) and math.ceil(w.rank) < below + count:
            w.low, w.high, w.below, w.inside = low, high, below, count


def _gather(df: DataFrame, value: Mapping[str, Column], wanted: list[_Wanted]) -> dict[int, list[tuple[float, int]]]:
    """The values inside each bracket with their counts, in order."""
    out = {k: [(w.low, w.inside)] for k, w in enumerate(wanted) if w.low == w.high}
    rest = [(k, w) for k, w in enumerate(wanted) if k not in out]
    if not rest:
        return out
    cells = [F.struct(F.lit(k).alias("k"), F.when((value[w.column] >= w.low) & (value[w.column] <= w.high), value[w.column]).alias("v")) for k, w in rest]
    met = df.select(F.explode(F.filter(F.array(*cells), lambda c: c["v"].isNotNull())).alias("e")).select("e.*")
    for r in sorted(met.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n")).collect()):
        out.setdefault(r.k, []).append((r.v, r.n))
    return out


def _at(values: list[tuple[float, int]], rank: int) -> float:
    for v, n in values:
        if rank < n:
            return v
        rank -= n
    raise ValueError("a quantile lies outside its bracket")
