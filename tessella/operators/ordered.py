"""Operators on order: ranks, islands, merged intervals, cumulative offsets, adjusted p-values.

Within groups that fit in a task these are windows. Rows of no group, or of
groups of any size, are scanned in parts (:func:`scan`): the rows are dealt out
in ranges of their order, each part is summarised, the summaries of the parts
before it are what a part carries in, and a second pass adds that to the part's
own running values. No task sees more rows than its range has.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import dealt, ranged, staged

#: How often a pointer may be doubled: more clusters than rows can be.
_DOUBLINGS = 64


class Running(NamedTuple):
    """A running value: ``how`` over ``value`` of the rows up to this one, or of those before it; from the end if ``down``."""

    how: str
    value: Column | str | None = None
    before: bool = False
    down: bool = False


#: Of each way to run: the aggregate of rows, that of carried summaries, and how a carried and an own value meet.
_HOWS: dict[str, tuple[Callable[..., Column], Callable[..., Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "min": (F.min, F.min, F.least),
    "max": (F.max, F.max, F.greatest),
    "count": (F.count, F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    # the nearest value that is not null; of a part, see _summary
    "last": (lambda c: F.last(c, True), lambda c: F.last(c, True), lambda a, b: F.coalesce(b, a)),
}


def _summary(value: str, x: Running) -> Column:
    """What a part has to carry on; its rows come in no order, so the nearest value is told by its place."""
    if x.how == "last":
        return (F.min_by if x.down else F.max_by)(value, F.when(F.col(value).isNotNull(), F.col("_scan_place")))
    return _HOWS[x.how][0](value)


def placed(df: DataFrame, order: Sequence[Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows dealt out in ranges of ``by`` and ``order``: adds ``_scan_part``, the range, and ``_scan_place``, the place in it from 0.

    There are as many ranges as the number of rows asks for. The result is a written table, so both stay as they are.
    """
    keys = [*(F.col(c) for c in by), *order]
    out = staged(ranged(df, *keys).withColumn("_scan_at", F.monotonically_increasing_id()))
    return out.withColumn("_scan_part", F.shiftright("_scan_at", 33)).withColumn("_scan_place", F.col("_scan_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_scan_at")


def scan(df: DataFrame, order: Sequence[Column], running: dict[str, Running], by: Sequence[str] = ()) -> DataFrame:
    """Add running values in a total order, over all rows or in each group of ``by``, of whatever size.

    A summary has a row for each part (and group in it). Null groups are one
    group; a running value of no rows is null, a count of none is zero.
    """
    # expressions are computed once, before the rows are dealt out
    values = {f"_scan_v{i}": F.col(x.value) if isinstance(x.value, str) else F.lit(1) if x.value is None else x.value for i, x in enumerate(running.values())}
    rows = placed(df.withColumns(values), order, by)
    summaries = [_summary(v, x).alias(v) for v, x in zip(values, running.values(), strict=True)]
    parts = rows.groupBy(*by, "_scan_part").agg(*summaries)
    if not by:  # a row for each part: few, whatever the number of rows
        parts = df.sparkSession.createDataFrame(parts.collect(), parts.schema).coalesce(1)

    def frame(place: str, x: Running, last: int) -> Window:
        at = F.desc(place) if x.down else F.asc(place)
        return Window.partitionBy(*by, *(["_scan_part"] if place == "_scan_place" else [])).orderBy(at).rowsBetween(Window.unboundedPreceding, last)

    carried = parts.select(*by, F.col("_scan_part").alias("_scan_of"), *[_HOWS[x.how][1](v).over(frame("_scan_part", x, -1)).alias(f"{v}c") for v, x in zip(values, running.values(), strict=True)])
    same = F.col("_scan_part") == F.col("_scan_of")
    for c in by:
        carried = carried.withColumnRenamed(c, f"_scan_of_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_scan_of_{c}"))
    met = rows.join(carried if by else F.broadcast(carried), same)
    for (name, x), v in zip(running.items(), values, strict=True):
        own = _HOWS[x.how][0](v).over(frame("_scan_place", x, -1 if x.before else 0))
        both = _HOWS[x.how][2](F.col(f"{v}c"), own)
        met = met.withColumn(name, F.coalesce(both, F.lit(0)) if x.how == "count" else both)
    return met.select(*df.columns, *running)


def ranked(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Rank from 1 in a total order, in each group of ``by``."""
    if not by:
        return scan(df, order, {name: Running("count")})
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def mean_rank(df: DataFrame, first: Sequence[Column], second: Sequence[Column], by: Sequence[str], name: str = "mean_rank") -> DataFrame:
    """Average of the ranks in two orders."""
    if not by:
        both = ranked(ranked(df, first, (), "_a"), second, (), "_b")
        return both.withColumn(name, (F.col("_a") + F.col("_b")) / 2.0).drop("_a", "_b")
    a, b = (F.row_number().over(Window.partitionBy(*by).orderBy(*o)) for o in (first, second))
    return df.withColumn(name, (a + b) / 2.0)


def average_ties(value: str, by: Sequence[str]) -> Column:
    """Rank in which equal values share the mean of their places."""
    order = Window.partitionBy(*by).orderBy(value)
    peers = Window.partitionBy(*by, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2.0


def top_two(df: DataFrame, by: Sequence[str], score: str, item: str) -> DataFrame:
    """Each group's best and second item, their scores, and the margin; a group of one has no second."""
    best = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(item).alias("i"))))
    two = ranked(df, [F.desc(score), F.asc(item)], by, "_n").filter("_n <= 2").groupBy(*by).agg(best.alias("b"))
    first, second = F.get("b", F.lit(0)), F.get("b", F.lit(1))
    return two.select(*by, first.i.alias("best"), (-first.s).alias("best_score"), second.i.alias("runner_up"), (-second.s).alias("runner_up_score"), (second.s - first.s).alias("margin"))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return ranked(df, order, by, "_n").filter(F.col("_n") <= k).drop("_n")


def tied_at_top(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """How many rows share each group's highest score."""
    return df.groupBy(*by).agg(F.max(score).alias("top"), F.count(F.lit(1)).alias("n")).join(df.groupBy(*by, F.col(score).alias("top")).agg(F.count(F.lit(1)).alias("tied")), [*by, "top"]).select(*by, "top", "tied")


def islands(df: DataFrame, by: Sequence[str], position: str, step: int = 1) -> DataFrame:
    """Runs of positions ``step`` apart: ``island_start, island_end, length``; positions are distinct in a group."""
    run = (F.col(position) / step).cast("long") - F.col("_rank")
    return ranked(df, [F.asc(position)], by, "_rank").withColumn("_run", run).groupBy(*by, "_run").agg(F.min(position).alias("island_start"), F.max(position).alias("island_end"), F.count(F.lit(1)).alias("length")).drop("_run")


def longest_island(runs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each group's longest run; the first of equals."""
    return top_k(runs, by, [F.desc("length"), F.asc("island_start")], 1)


def gaps(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """What lies between neighbours in order: ``gap_start, gap_end``, where it is not empty."""
    order = Window.partitionBy(*by).orderBy(start, end)
    return df.select(*by, F.col(end).alias("gap_start"), F.lead(start).over(order).alias("gap_end")).filter("gap_end > gap_start")


def merged(df: DataFrame, by: Sequence[str], start: str = "start", end: str = "end", slack: int = 0) -> DataFrame:
    """Union of intervals that overlap or are at most ``slack`` apart: bounds and number of members."""
    if not by:
        up = [F.asc(start), F.asc(end)]
        marked = scan(df, up, {"_reach": Running("max", end, before=True)})
        new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + slack), 1).otherwise(0)
        marked = scan(marked.withColumn("_new", new), up, {"_island": Running("sum", "_new")})
        return marked.groupBy("_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("_island")
    df = dealt(df, *by)
    order = Window.partitionBy(*by).orderBy(start, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + slack), 1).otherwise(0)
    marked = df.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("_island")


def overlapping_neighbours(df: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Rows that start before an earlier one has ended."""
    order = Window.partitionBy(*by).orderBy(start, end)
    return df.withColumn("_before", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))).filter(F.col("_before") > F.col(start)).drop("_before")


def offsets(df: DataFrame, by: Sequence[str], order: Sequence[Column], size: str, name: str = "offset") -> DataFrame:
    """Sum of the sizes before each row."""
    if not by:
        return scan(df, order, {name: Running("sum", size, before=True)}).withColumn(name, F.coalesce(name, F.lit(0)))
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def rolling_sum(value: str, by: Sequence[str], order: Sequence[Column], width: int) -> Column:
    """Sum over this row and the next ``width - 1``."""
    return F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, width - 1))


def smallest_cover(df: DataFrame, by: Sequence[str], value: str, order: Sequence[Column], share: float) -> DataFrame:
    """The fewest leading rows whose values reach ``share`` of their group's total."""
    if not by:
        total = df.agg(F.sum(value).alias("_total"))
        run = offsets(df, (), order, value, "_before").crossJoin(F.broadcast(total))  # one row
        return run.filter(F.col("_before") < share * F.col("_total")).drop("_before", "_total")
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.coalesce(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.withColumn("_before", before).withColumn("_total", F.sum(value).over(Window.partitionBy(*by))).filter(F.col("_before") < share * F.col("_total")).drop("_before", "_total")


def benjamini_hochberg(df: DataFrame, p: str, by: Sequence[str], order: Sequence[str], name: str = "adjusted") -> DataFrame:
    """Adjusted p-values: the least of p n / rank from this rank on, one at most."""
    if not by:
        n = df.agg(F.count(F.lit(1)).alias("_n"))
        upward = [F.asc(p), *map(F.asc, order)]
        raw = ranked(df, upward, (), "_rank").crossJoin(F.broadcast(n)).withColumn("_raw", F.col(p) * F.col("_n") / F.col("_rank"))  # one row
        out = scan(raw, upward, {name: Running("min", "_raw", down=True)})
        return out.withColumn(name, F.least(F.lit(1.0), name)).drop("_rank", "_n", "_raw")
    up = Window.partitionBy(*by).orderBy(p, *order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    # from the largest p down, so that the minimum runs: a frame to the end would start anew for each row
    down = Window.partitionBy(*by).orderBy(F.desc(p), *map(F.desc, order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_raw", F.col(p) * n / F.row_number().over(up)).withColumn(name, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_raw")


def sessions(df: DataFrame, by: Sequence[str], time: str, most: float, name: str = "cluster") -> DataFrame:
    """Number rows whose neighbour in time is at most ``most`` before them as one cluster."""
    order = Window.partitionBy(*by).orderBy(time)
    new = F.when(F.col(time) - F.lag(time).over(order) <= most, 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def next_beyond(df: DataFrame, by: Sequence[str], position: str, most: float, name: str = "next") -> DataFrame:
    """Each distinct position of a group and the first one more than ``most`` beyond it, null if there is none.

    Positions and the points they reach stand in one order; going down, the
    last position met is the first one beyond a point.
    """
    at = df.select(*by, F.col(position).alias("_p")).filter(F.col("_p").isNotNull()).distinct()
    kind = at.schema["_p"].dataType
    points = at.select(*by, F.col("_p").alias("_x"), F.lit(0).alias("_reach"), "_p").union(at.select(*by, (F.col("_p") + F.lit(most)).cast(kind).alias("_x"), F.lit(1), "_p"))
    # a position that is only reached stands before the point that reaches it
    run = scan(points, [F.asc("_x"), F.asc("_reach"), F.asc("_p")], {name: Running("last", F.when(F.col("_reach") == 0, F.col("_p")), before=True, down=True)}, by)
    return run.filter("_reach = 1").select(*by, F.col("_p").alias(position), name)


def greedy_clusters(df: DataFrame, by: Sequence[str], position: str, most: float, name: str = "cluster") -> DataFrame:
    """Clusters that a sorted scan opens where a position is more than ``most`` beyond its cluster's first.

    Each cluster depends on where the one before began. So each position points
    to where the next cluster would begin if one began there; what a group's
    first position reaches by these pointers is found by doubling them: after
    ``k`` rounds the first ``2 ** k`` clusters are known. A row's cluster is
    the last beginning up to it. No group must fit in a task; null positions
    belong to no cluster, and null groups are one group.
    """
    keys = [F.col(c) for c in by]
    beyond = next_beyond(df, by, position, most, "_next").select(F.struct(*keys, F.lit(0)).alias("_g"), *by, F.col(position).alias("_p"), "_next")
    jump = staged(beyond)
    begun = staged(jump.groupBy("_g", *by).agg(F.min("_p").alias("_p")))
    n = 0
    for _ in range(_DOUBLINGS):
        step = begun.join(jump.filter("_next IS NOT NULL").select("_g", "_p", "_next"), ["_g", "_p"]).select("_g", *by, F.col("_next").alias("_p"))
        begun = staged(begun.union(step))
        before, n = n, begun.count()
        if n == before:
            break
        far = jump.select("_g", F.col("_p").alias("_next"), F.col("_next").alias("_far"))
        jump = staged(jump.filter("_next IS NOT NULL").join(far, ["_g", "_next"]).select("_g", *by, "_p", F.col("_far").alias("_next")).filter("_next IS NOT NULL"))
        if not jump.head(1):
            break
    starts = begun.select(*by, F.col("_p").alias(position)).withColumn("_opens", F.lit(1).cast("long"))
    rows = df.withColumn("_opens", F.lit(0).cast("long")).unionByName(starts, allowMissingColumns=True)
    run = scan(rows, [F.asc(position), F.desc("_opens")], {name: Running("sum", "_opens")}, by)
    return run.filter("_opens = 0").withColumn(name, F.when(F.col(position).isNotNull(), F.col(name))).select(*df.columns, name)
