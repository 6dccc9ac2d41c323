"""Ordered computations that stay parallel when one group is huge.

A plain ``Window.partitionBy(key)`` sends a whole group to one task, and a window
without keys sends the whole table there. The helpers below cut every group into
slices of the ordering column, work inside the slices in parallel, and stitch the
slices together through a summary that holds one row per slice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from floodlens.session import materialize

# Share of the rows that the cut points of select_ranks come from, and how far
# around an expected position they are set.
_SAMPLE = 0.02
_MARGIN = 0.01
# Rows of different values that one slot may have before it is cut again, and into how many.
_MOST_IN_SLOT = 1_000_000
_EVEN = 32
# Groups whose cut points are broadcast.
_FEW_GROUPS = 1000


def time_slice(ts: str, slice_us: int) -> Column:
    """Number of the fixed-width time slice that a timestamp falls into."""
    return F.expr(f"unix_micros({ts}) div {slice_us}")


def lag_in_slices(
    df: DataFrame, keys: Sequence[str], slice_col: str, order: str, values: dict[str, str]
) -> DataFrame:
    """Previous row's values per group; ``values`` maps source to new column.

    Rows must be unique on (keys, order). One shuffle of the rows by (keys, slice)
    plus one of a table with a row per slice.
    """
    # The join below drops NULL keys anyway; saying so first keeps both of its sides
    # identical up to the shuffle, which Spark then reuses.
    df = df.where(" AND ".join(f"{c} IS NOT NULL" for c in [*keys, slice_col]))
    inside = Window.partitionBy(*keys, slice_col).orderBy(order)
    across = Window.partitionBy(*keys).orderBy(slice_col)
    tails = (
        df.groupBy(*keys, slice_col)
        .agg(*[F.max_by(c, order).alias(f"_tail_{c}") for c in values])
        .select(*keys, slice_col, *[F.lag(f"_tail_{c}").over(across).alias(f"_carry_{c}") for c in values])
    )
    first = F.row_number().over(inside) == 1
    lagged = df.select(
        *df.columns, first.alias("_first"), *[F.lag(c).over(inside).alias(f"_prev_{c}") for c in values]
    ).join(tails, [*keys, slice_col])
    return lagged.selectExpr(
        *[f"`{c}`" for c in df.columns],
        *[f"CASE WHEN _first THEN _carry_{c} ELSE _prev_{c} END AS {new}" for c, new in values.items()],
    )


def running_totals(
    df: DataFrame,
    slice_col: str,
    order: Sequence[Column | str],
    values: dict[str, str],
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Cumulative sums over the whole table in ``order``.

    ``slice_col`` must rise with ``order``; the slice summary is the only thing
    that one task sees as a whole. ``totals`` also adds sums over all rows.
    """
    # These unpartitioned windows run over one row per slice.
    everything = Window.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.orderBy(slice_col).rowsBetween(Window.unboundedPreceding, -1)
    inside = (
        Window.partitionBy(slice_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = totals or {}
    # As above: identical sides let Spark reuse the shuffle below the summary.
    df = df.where(f"{slice_col} IS NOT NULL")
    offsets = (
        df.groupBy(slice_col)
        .agg(*[F.sum(c).alias(c) for c in {**values, **totals}])
        .select(
            slice_col,
            *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before_{c}") for c in values],
            *[F.sum(c).over(everything).alias(new) for c, new in totals.items()],
        )
    )
    running = [(F.sum(c).over(inside) + F.col(f"_before_{c}")).alias(new) for c, new in values.items()]
    return df.join(offsets, slice_col).select(*df.columns, *running, *totals.values())


def in_ranges(df: DataFrame, order: Column, ranges: int, slice_col: str) -> DataFrame:
    """Rows dealt to ranges of ``order``, with the number of their range: a slice for ``running_totals``.

    The sort's own sampled bounds cut the ranges, so no cut point passes the plan or the
    driver. Written, since the numbers are only certain within one run.
    """
    dealt = df.repartitionByRange(ranges, order).withColumn(slice_col, F.spark_partition_id())
    return materialize(dealt, "ranges")


def _with_cuts(data: DataFrame, scope: list[str], found: DataFrame, cuts: int) -> DataFrame:
    """Each row with its slot, in the order of values: those between two of its group's cut points
    (column _cuts) have even numbers, those equal to a cut point odd ones."""
    if scope:
        # One number is looked up far faster than several keys. Any cut points would do for a group, as
        # long as all its rows get the same; so two groups of one hash may share theirs.
        found = found.select(F.xxhash64(*scope).alias("_g"), "_cuts").dropDuplicates(["_g"])
        few = found.limit(_FEW_GROUPS + 1).collect()
        if len(few) <= _FEW_GROUPS:
            found = F.broadcast(data.sparkSession.createDataFrame(few, found.schema))
        columns = found.selectExpr("_g", *[f"get(_cuts, {i}) AS _c{i}" for i in range(cuts)])
        data = data.withColumn("_g", F.xxhash64(*scope)).join(columns, "_g", "left")
        limits = [f"_c{i}" for i in range(cuts)]
    else:
        limits = [f"{c!r}D" for c in found.first()["_cuts"] or []]
    # A group too small for the sample has no cuts and stays in one slot.
    slot = " + ".join(["0", *[f"CAST(coalesce({c} {op} _v, false) AS INT)" for c in limits for op in ("<", "<=")]])
    return data.selectExpr(*scope, "_v", f"{slot} AS _slot")


def select_ranks(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    ranks: Callable[[Column], Sequence[tuple[str, Column]]],
    near: Sequence[float],
    most: int = _MOST_IN_SLOT,
) -> DataFrame:
    """Exact order statistics per group without sorting the groups.

    ``ranks`` turns a column with the group size into (tag, 0-based rank) pairs.
    ``near`` lists the probabilities around which those ranks are expected. The
    result has one row per group and tag: (groups..., tag, value, total), with total the
    group size.

    Narrow value slots are cut around the expected positions, using approximate
    quantiles of a sample; a cut point is a slot of its own, so that a frequent value is found by
    the count alone. All rows are then counted per slot, and only slots that hold a
    wanted rank go on. While such a slot has more than ``most`` rows of different values, its
    rows are cut again, evenly. What is left is grouped by value and ordered. Bad cuts cost
    time and not exactness. Cut points of few groups are broadcast, those of many are joined.
    """
    data = df.select(*groups, F.col(value).cast("double").alias("_v"))
    data = data.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*groups, "_v"]))
    probs = sorted({min(max(p + d, 0.0), 1.0) for p in near for d in (-_MARGIN, _MARGIN)})
    guess = F.percentile_approx("_v", probs, 1000).alias("_cuts")
    scope = list(groups)
    slotted = _with_cuts(data, scope, data.sample(_SAMPLE, seed=11).groupBy(*scope).agg(guess), len(probs))
    hits = settled = None
    while True:
        # One row per group and slot.
        whole = Window.partitionBy(*scope)
        before = whole.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        slots = (
            slotted.groupBy(*scope, "_slot")
            # Zero has one sign, as in a group of values.
            .agg(
                F.count(F.lit(1)).alias("_n"),
                (F.min("_v") < F.max("_v")).alias("_mixed"),
                (F.min("_v") + F.lit(0.0)).alias("_least"),
            )
            .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        )
        if hits is None:
            sized = slots.withColumn("total", F.sum("_n").over(whole))
            pairs = [F.struct(F.lit(t).alias("tag"), r.cast("long").alias("rank")) for t, r in ranks(F.col("total"))]
            wanted = sized.select(*scope, "_slot", "_before", "_n", "_mixed", "_least", "total", F.inline(F.array(*pairs)))
        else:
            wanted = slots.join(hits.drop("_n", "_mixed", "_least"), scope)
        found = wanted.where("rank >= _before AND rank < _before + _n")
        # The rank inside the slot from here on; a few rows per group, read several times.
        inner = found.select(
            *scope, "_slot", "_n", "_mixed", "_least", "total", "tag", (F.col("rank") - F.col("_before")).alias("rank")
        )
        level = f"_slot{len(scope)}"
        hits = materialize(inner.withColumnRenamed("_slot", level), "rank-slots")
        # A slot of one value needs no further look at the rows.
        known = hits.where(~F.col("_mixed")).select(*groups, "tag", F.col("_least").alias("value"), "total")
        settled = known if settled is None else settled.unionByName(known)
        hits = hits.where("_mixed")
        largest = hits.agg(F.max("_n").alias("_n")).first()["_n"]
        if largest is None:
            return settled
        own = [*scope, level]
        # By one number again; rows of a slot that only shares its hash are dropped by the joins below.
        number = F.xxhash64(*own).alias("_g")
        rows = slotted.withColumnRenamed("_slot", level).withColumn("_g", number)
        rows = rows.join(hits.select(number).distinct(), "_g", "left_semi").drop("_g")
        scope = own
        if largest <= most:
            break
        # Read again for the next cut, its counts and what follows.
        rows = materialize(rows, "rank-rows")
        even = [i / _EVEN for i in range(1, _EVEN)]
        cuts = rows.groupBy(*scope).agg(F.percentile_approx("_v", even, 10 * _EVEN).alias("_cuts"))
        slotted = _with_cuts(rows, scope, cuts, len(even))

    inside = Window.partitionBy(*scope).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    searched = (
        rows.groupBy(*scope, "_v")
        .agg(F.count(F.lit(1)).alias("_here"))
        .withColumn("_upto", F.sum("_here").over(inside))
        .join(hits, scope)
        .where("rank < _upto AND rank >= _upto - _here")
        .select(*groups, "tag", F.col("_v").alias("value"), "total")
    )
    return searched.unionByName(settled)


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation: (groups..., one column per name)."""

    def ranks(total: Column) -> list[tuple[str, Column]]:
        pairs = []
        for name, p in probs.items():
            place = F.lit(p) * (total - 1).cast("double")
            pairs += [(f"{name}:lo", F.floor(place)), (f"{name}:hi", F.ceil(place))]
        return pairs

    def interpolate(name: str, p: float) -> Column:
        low, high = (F.max(F.when(F.col("tag") == f"{name}:{side}", F.col("value"))) for side in ("lo", "hi"))
        place = F.lit(p) * (F.max("total") - 1).cast("double")
        return (low + (high - low) * (place - F.floor(place).cast("double"))).alias(name)

    found = select_ranks(df, groups, value, ranks, list(probs.values()))
    return found.groupBy(*groups).agg(*[interpolate(name, p) for name, p in probs.items()])
