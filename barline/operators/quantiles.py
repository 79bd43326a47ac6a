"""Exact quantiles and row numbers of large groups, by selection from sorted ranges.

Values are counted first, so that repeated ones are one row, then sorted by
(group, value) into ranges, a task each.  Counts by range tell which ranges hold
the wanted places, and only these are looked into.  No task holds more than a
range, however few the groups are; only one row for each range and group is
ever brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline import scratch
from barline.frames import SYM


def _sorted(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with the range ``_part`` that holds them, rows before each range of a group and in the whole group); rows count ``_n`` times."""
    placed = scratch.table(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "sorted")
    sizes = placed.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed, sizes.withColumns({"_before": before, "_all": F.sum("_size").over(group)})


def quantiles(df: DataFrame, value: Column | str, shares: Sequence[float], by=SYM, into: str = "_q") -> DataFrame:
    """(by, into): an array of each group's quantiles, interpolated between the two nearest places.

    Null values don't count; groups without any other have no row, as have
    groups with a null key.  ``by`` may be empty: one row for the whole table.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [*by] or ["_whole"]
    rows = df.select(*by, *([] if by else [F.lit(0).alias("_whole")]), value.cast("double").alias("_v")).where("_v is not null")
    placed, sizes = _sorted(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")), keys, ["_v"])
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(q)).alias("q")) for i, q in enumerate(shares))))
    places = sizes.withColumn("_w", each).withColumn("_at", F.col("_w.q") * (F.col("_all") - 1))
    sides = F.explode(F.array(F.struct(F.floor("_at").alias("rank"), (F.floor("_at") + 1 - F.col("_at")).alias("weight")), F.struct((F.floor("_at") + 1).alias("rank"), (F.col("_at") - F.floor("_at")).alias("weight"))))
    wanted = places.withColumn("_s", sides).where("_s.weight > 0 and _before <= _s.rank and _s.rank < _before + _size")
    wanted = wanted.select(*keys, "_part", F.col("_w.i").alias("_i"), (F.col("_s.rank") - F.col("_before")).alias("_rank"), F.col("_s.weight").alias("_weight"))
    looked = placed.join(wanted.select(*keys, "_part").distinct(), [*keys, "_part"], "left_semi")
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = looked.withColumn("_upto", upto).join(wanted, [*keys, "_part"]).where("_upto - _n <= _rank and _rank < _upto")
    # a quantile has one or two places
    each = found.groupBy(*keys, "_i").agg(F.sum(F.col("_weight") * F.col("_v")).alias("_x"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(into)).select(*by, into)


def with_quantiles(df: DataFrame, value: Column | str, shares: Sequence[float], by=SYM, into: str = "_q") -> DataFrame:
    """``df`` with its group's quantiles, null where the group has no value."""
    fit = quantiles(df, value, shares, by, into)
    return df.join(fit, list(by), "left") if by else df.join(F.broadcast(fit), F.lit(True), "left")  # one row


def at_places(df: DataFrame, order: Sequence[str], places: Sequence[int]) -> DataFrame:
    """The distinct values of ``order`` (nulls first) that stand at these places, from 0, of the sorted table."""
    rows = df.select(*order).groupBy(*order).agg(F.count(F.lit(1)).alias("_n")).withColumn("_whole", F.lit(0))
    placed, sizes = _sorted(rows, ["_whole"], order)
    wanted = sizes.withColumn("_rank", F.explode(F.array(*(F.lit(int(p)) for p in places)))).where("_before <= _rank and _rank < _before + _size").select("_part", (F.col("_rank") - F.col("_before")).alias("_rank"))
    upto = F.sum("_n").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_upto", upto).join(wanted, "_part").where("_upto - _n <= _rank and _rank < _upto").select(*order).distinct()
