"""Resharding by minimum-cost flow, in DataFrame functions only.

Old shards are sources of their bytes, new shards sinks of their capacities; a
byte that stays in its shard costs nothing, one that moves costs one.  Shortest
paths in such a network cost 0 or 1, so the flow is found in two steps: every
shard first keeps what it holds up to its capacity, then the bytes left over
are sent to the room left.  A path that takes a kept byte back costs more than
one that doesn't, so neither step is ever undone, and the bytes moved are the
sum of what shards hold beyond their capacities, below which no plan can come.
Surpluses and rooms are laid on one line each; the pieces into which their ends
cut the line are the block transfers, fewer than old and new shards together.

A shard's rows are in the order of the md5 of their id (then id, size, checksum
of the text); a transfer is a span of this order's bytes, and a row goes with
the byte in its middle.  So a shard misses its capacity by at most one row's
size for each end of a span.  Positions come from sums by (shard, md5 prefix)
and by runs of equal rows, so that no window holds a whole shard or a hot key.
Only the first rows of spans are looked up; each row is then compared with
those of its shard where it lies, and texts are never shuffled.

Only shards that lose rows are rewritten; those that gain get further files,
all others stay as they are.  Old files are not deleted: ``Layout`` names the
shards of each folder that count.

The number of shards, not of rows, bounds what is sorted in one task, collected
or broadcast: MOST_SHARDS at most.

Null ids count as the empty text in the order, null texts as empty (size 1).
Equal rows are interchangeable and may be cut apart.  A row larger than a
capacity leaves its shard as near to it as whole rows allow.  An empty table
gives an empty layout.  Input columns named ``_shard``, ``_size``, ``_crc`` or
``_row`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barline.llm import shared

#: Shards, old or new, of one step.
MOST_SHARDS = 10_000
#: What sorts rows of a shard; ``_row`` parts equal ones.
KEY = ("_md5", "_id", "_size", "_crc", "_part", "_row")
_OWN = ("_shard", "_size", "_crc", "_row")


def size_of(text: Column) -> Column:
    """UTF-8 bytes of the text and one more."""
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Layout:
    """Shards in files: of each folder, the shards that count."""

    spark: SparkSession
    schema: StructType
    folders: tuple[tuple[str, tuple[int, ...]], ...]

    def read(self) -> DataFrame:
        """All rows with their ``_shard``."""
        frames = [self.spark.read.schema(self.schema).parquet(path).where(F.col("_shard").isin(list(shards))) for path, shards in self.folders if shards]
        if not frames:
            return self.spark.createDataFrame([], self.schema)
        out = frames[0]
        for frame in frames[1:]:
            out = out.union(frame)
        return out

    def sizes(self) -> DataFrame:
        """(shard, bytes) of the shards with rows."""
        return self.read().groupBy(F.col("_shard").alias("shard")).agg(F.sum("_size").alias("bytes"))


def lay_out(docs: DataFrame, shard: Column, text: str = "text") -> Layout:
    """Write ``docs`` to one folder for each shard number."""
    spark, path = docs.sparkSession, shared.place(docs.sparkSession, "shards")
    own = [F.col(f"`{c}`") for c in docs.columns if c not in _OWN]
    out = docs.select(*own, size_of(F.col(text)).alias("_size"), checksum(F.col(text)).alias("_crc"), F.monotonically_increasing_id().alias("_row"), shard.cast("int").alias("_shard"))
    out.write.partitionBy("_shard").parquet(path)
    found = spark.read.schema(out.schema).parquet(path).select("_shard").distinct().limit(MOST_SHARDS + 1).collect()
    _check(len(found))
    return Layout(spark, out.schema, ((path, tuple(sorted(r[0] for r in found))),))


def _check(shards: int) -> None:
    if shards > MOST_SHARDS:
        raise ValueError(f"more than {MOST_SHARDS} shards in one step")


def equal_capacities(sizes: DataFrame, shards: int) -> DataFrame:
    """(shard, capacity): the total in equal parts, to a byte."""
    total = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t"))
    each = total.select("t", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    return each.select("shard", F.expr(f"t * (shard + 1) div {shards} - t * shard div {shards}").alias("capacity"))


def transfers(sizes: DataFrame, capacities: DataFrame) -> DataFrame:
    """(old, new, start, end): spans of each old shard's bytes and where they go; spans with old = new stay.

    ``sizes`` (shard, bytes) and ``capacities`` (shard, capacity) have the same
    total and at most MOST_SHARDS rows each; a shard may be in one of them only.
    """
    line = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    both = sizes.join(capacities, "shard", "full").select("shard", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("capacity", F.lit(0)).alias("capacity"))
    kept = both.withColumn("keep", F.least("bytes", "capacity")).withColumns({"surplus": F.col("bytes") - F.col("keep"), "room": F.col("capacity") - F.col("keep")})
    ends = kept.withColumns({"s1": F.sum("surplus").over(line), "r1": F.sum("room").over(line)})
    # ends of surpluses and rooms on one line; up to each end the owners are the next ones to end
    points = ends.where("surplus > 0").select(F.col("s1").alias("x"), F.col("shard").alias("old"), F.lit(None).cast("int").alias("new"), (F.col("s1") - F.col("surplus") - F.col("keep")).alias("at"))
    points = points.union(ends.where("room > 0").select("r1", F.lit(None).cast("int"), "shard", F.lit(None).cast("long")))
    order = Window.orderBy("x", "old", "new")
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    pieces = points.select(F.first("old", True).over(onward).alias("old"), F.first("new", True).over(onward).alias("new"), F.lag("x", 1, 0).over(order).alias("x0"), F.col("x").alias("x1"), F.first("at", True).over(onward).alias("at"))
    moved = pieces.where("x1 > x0").select("old", "new", (F.col("x0") - F.col("at")).alias("start"), (F.col("x1") - F.col("at")).alias("end"))
    return ends.where("keep > 0").select(F.col("shard").alias("old"), F.col("shard").alias("new"), F.lit(0).cast("long").alias("start"), F.col("keep").alias("end")).union(moved)


def _facts(rows: DataFrame, doc_id: str, *more: Column) -> DataFrame:
    """What sorts each row, without its text; ``_part`` is the written part that holds it."""
    id_ = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    return rows.select("_shard", F.md5(id_.cast("binary")).alias("_md5"), id_.alias("_id"), "_size", "_crc", F.shiftright("_row", 33).alias("_part"), "_row", *more)


def _runs(facts: DataFrame, *more: str) -> tuple[DataFrame, DataFrame]:
    """Runs of equal rows (and of ``more``): their number ``n``, and ``rank`` and ``place``, the rows and bytes of the shard before them.

    Also the (shard, prefix) heads that these are summed by.
    """
    runs = facts.groupBy("_shard", F.substring("_md5", 1, 3).alias("_prefix"), "_md5", "_id", "_size", "_crc", *more).agg(F.count(F.lit(1)).alias("n"))
    bytes_ = F.col("n") * F.col("_size")
    sums = runs.groupBy("_shard", "_prefix").agg(F.sum("n").alias("rows"), F.sum(bytes_).alias("bytes"))
    above = Window.partitionBy("_shard").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    heads = sums.select("_shard", "_prefix", "bytes", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("rows", "bytes")))
    before = Window.partitionBy("_shard", "_prefix").orderBy("_md5", "_id", "_size", "_crc", *more).rowsBetween(Window.unboundedPreceding, -1)
    inside = runs.withColumns({"rows_in": F.coalesce(F.sum("n").over(before), F.lit(0)), "bytes_in": F.coalesce(F.sum(bytes_).over(before), F.lit(0))})
    placed = inside.join(heads.drop("bytes"), ["_shard", "_prefix"])
    return placed.withColumns({"rank": F.col("rows_above") + F.col("rows_in"), "place": F.col("bytes_above") + F.col("bytes_in")}).drop("rows_above", "bytes_above", "rows_in", "bytes_in"), heads


def _cuts(facts: DataFrame, spans: DataFrame) -> DataFrame:
    """(_shard, new, from, key, takes): the row that holds a span's first byte; it belongs to the span if ``takes``."""
    starts = spans.where("start > 0").select(F.col("old").alias("_shard"), "new", F.col("start").alias("from"))
    runs, heads = _runs(facts, "_part")
    near = starts.join(heads, "_shard").where("bytes_above <= from and from < bytes_above + bytes").select("_shard", "_prefix", "new", "from")
    held = runs.join(near, ["_shard", "_prefix"]).where("place <= from and from < place + n * _size")
    held = held.withColumn("k", F.expr("(from - place) div _size")).withColumn("takes", F.expr("place + k * _size + _size div 2 >= from"))
    # the run's k-th row, among those of one written part
    same = ["_shard", "_md5", "_id", "_size", "_crc", "_part"]
    nth = F.row_number().over(Window.partitionBy(*same, "new", "from").orderBy("_row")) - 1
    rows = facts.join(held.select(*same, "new", "from", "k", "takes"), same).withColumn("_nth", nth).where("_nth = k")
    return rows.select("_shard", "new", "from", F.struct(*KEY).alias("key"), "takes")


def reshard(layout: Layout, capacities: DataFrame, doc_id: str = "doc_id") -> tuple[Layout, DataFrame]:
    """(new layout, its ``transfers``): the shards brought to their ``capacities`` (shard, capacity)."""
    spans = shared.table(transfers(layout.sizes(), capacities), "transfers")
    planned = spans.limit(2 * MOST_SHARDS + 1).collect()
    _check(len(planned) // 2)
    losing = sorted({r.old for r in planned if r.old != r.new})
    staying = tuple((path, tuple(s for s in shards if s not in losing)) for path, shards in layout.folders)
    if not losing:
        return layout, spans
    rows = layout.read().where(F.col("_shard").isin(losing))
    cuts = _cuts(_facts(rows, doc_id), spans.where(F.col("old").isin(losing)))
    # where a shard's first span goes, and the cuts after it in order: a row for each losing shard
    first = spans.where("start = 0").where(F.col("old").isin(losing)).select(F.col("old").alias("_old"), F.col("new").alias("_first"))
    bounds = cuts.groupBy(F.col("_shard").alias("_old")).agg(F.sort_array(F.collect_list(F.struct("from", "new", "key", "takes"))).alias("_cuts"))
    where = first.join(bounds, "_old", "left")
    id_ = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    key = F.struct(F.md5(id_.cast("binary")).alias("_md5"), id_.alias("_id"), F.col("_size"), F.col("_crc"), F.shiftright("_row", 33).alias("_part"), F.col("_row"))
    passed = F.filter(F.coalesce("_cuts", F.array()), lambda c: (c["key"] < F.col("_key")) | ((c["key"] == F.col("_key")) & c["takes"]))
    # `where` has MOST_SHARDS rows at most, with fewer cuts than spans
    told = rows.withColumn("_key", key).join(F.broadcast(where), F.col("_shard") == F.col("_old"))
    new = F.when(F.size(passed) > 0, F.element_at(passed, -1)["new"]).otherwise(F.col("_first"))
    path = shared.place(layout.spark, "shards")
    told.withColumn("_shard", new.cast("int")).select(*layout.schema.names).write.partitionBy("_shard").parquet(path)
    gained = tuple(sorted({r.new for r in planned if r.old in losing}))
    return Layout(layout.spark, layout.schema, (*((p, s) for p, s in staying if s), (path, gained))), spans


def slots(layout: Layout, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row, from the texts in the files; slots count a shard's rows from 0."""
    rows = layout.read().select(F.col(doc_id).alias("doc_id"), "_shard", "_row", size_of(F.col(text)).alias("_size"), checksum(F.col(text)).alias("_crc"))
    runs, _ = _runs(_facts(rows, "doc_id", F.col("doc_id").isNull().alias("_null")), "_null")
    each = runs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k"))
    id_ = F.when(~F.col("_null"), F.col("_id")).cast(dict(rows.dtypes)["doc_id"])
    return each.select(id_.alias("doc_id"), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_shard").alias("shard"), (F.col("rank") + F.col("k")).cast("long").alias("slot"))
