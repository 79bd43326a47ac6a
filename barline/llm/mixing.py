"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Each source is a task whose integer weight ``a`` out of the total ``Q`` is its
target share.  Its block number j (from 0) is released at ``floor(j Q / a)``
and due at ``ceil((j + 1) Q / a)``; one block runs in each slot, the released
one that is due first (ties: by source).  As the shares add up to one, every
deadline is met, so in any prefix of the order each source is less than one
block away from its share.  The order repeats after Q slots, so only Q slots
are worked out, by one ``aggregate`` expression over them; every block's slot
then follows from its number alone.

Rows keep their order by the md5 of their id inside a source.  Row numbers come
from counts by (source, md5 prefix) and a running sum over the 4,096 prefixes,
so that no window holds a whole source, however hot.

``mix`` returns every input row with ``block``, ``release``, ``due``, ``slot``
and ``in_mix``.  The last is true before the first slot whose block is missing
because its source has run out: from there on the shares can't be kept.
Sources are one row each on the driver's side of the plan (their number, not
the rows', must fit a task).  A null source is a source of its own; rows with
a null id come first in their prefix; rows with equal ids are ordered by the
remaining columns' hash.  No row gives no row.  Input columns named like an
output column are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ADDED = ("block", "release", "due", "slot", "in_mix")


def _weights(docs: DataFrame, source: str, weights: Mapping[str, int] | None, default: int, alpha: float, parts: int) -> DataFrame:
    """(_source, _a, _rows), one row for each source present."""
    if weights is None:  # shares in proportion to rows ** alpha
        counts = docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_rows"))
        all_ = counts.agg(F.sum(F.pow("_rows", F.lit(alpha))).alias("_all"))  # one row
        share = F.round(parts * F.pow("_rows", F.lit(alpha)) / F.col("_all"))
        return counts.join(F.broadcast(all_), F.lit(True)).select("_source", "_rows", F.greatest(F.lit(1), share).cast("long").alias("_a"))
    given = F.lit(default)
    for name, a in weights.items():
        given = F.when(F.col("_source").eqNullSafe(F.lit(name)), F.lit(int(a))).otherwise(given)
    return docs.groupBy(F.col(source).alias("_source")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_a", given.cast("long"))


def pattern(sources: DataFrame) -> DataFrame:
    """(_source, _a, _q, _k, _at): the slot, within one round of _q, of each source's block k."""
    one = sources.where("_a > 0").agg(F.sort_array(F.collect_list(F.struct("_source", "_a"))).alias("s"), F.sum("_a").alias("q")).where("q is not null")
    edf = """aggregate(
        sequence(0L, q - 1),
        named_struct('done', transform(s, x -> 0L), 'order', cast(array() as array<int>)),
        (acc, t) -> transform(array(
            array_min(filter(
                transform(s, (x, i) -> named_struct(
                    'due', ((acc.done[i] + 1) * q + x._a - 1) div x._a,
                    'i', i,
                    'ready', acc.done[i] < x._a and (acc.done[i] * q) div x._a <= t)),
                e -> e.ready)).i),
            pick -> named_struct(
                'done', transform(acc.done, (n, i) -> if(i = pick, n + 1, n)),
                'order', concat(acc.order, array(pick))))[0],
        acc -> acc.order)"""
    slots = one.select("s", "q", F.posexplode(F.expr(edf)).alias("_at", "i"))
    by_source = Window.partitionBy("i").orderBy("_at")
    return slots.select(
        F.expr("s[i]._source").alias("_source"), F.expr("s[i]._a").alias("_a"), F.col("q").alias("_q"),
        (F.row_number().over(by_source) - 1).cast("long").alias("_k"), F.col("_at").cast("long").alias("_at"),
    )


def mix(docs: DataFrame, weights: Mapping[str, int] | None = None, default: int = 1, block_rows: int = 1, alpha: float = 0.7, parts: int = 100, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with the schedule's columns; sources of weight 0 get no slot.

    Without ``weights``, a source's weight is its part, of about ``parts``, in
    the sources' row counts to the power ``alpha``: large sources get a smaller
    share than they have of the rows, small ones a larger.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in _ADDED}  # no name of the input can clash
    docs = docs.select(*(F.col(f"`{k}`").alias(v) for k, v in own.items()))
    doc_id, source = own[doc_id], own[source]
    keyed = docs.withColumn("_md5", F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))).withColumn("_prefix", F.substring("_md5", 1, 3))
    sources = _weights(docs, source, weights, default, alpha, parts)
    slots = pattern(sources)
    # where each (source, prefix) begins in its source
    counts = keyed.groupBy(F.col(source).alias("_source"), "_prefix").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_source").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("_source", F.col("_prefix").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    # the first block that each source lacks, and so the end of the mix
    blocks = sources.where("_a > 0").withColumn("_m", F.ceil(F.col("_rows") / block_rows).cast("long"))
    lacks = blocks.join(slots.drop("_a"), blocks["_source"].eqNullSafe(slots["_source"]) & (F.col("_k") == F.col("_m") % F.col("_a")))
    end = lacks.agg(F.min(F.expr("(_m div _a) * _q + _at")).alias("_end"))
    others = [c for c, kind in docs.dtypes if c not in (doc_id,) and not kind.startswith("map")]
    inside = Window.partitionBy(source, "_prefix").orderBy("_md5", F.col(doc_id), F.xxhash64(*others) if others else F.lit(0))
    ranked = keyed.withColumn("_in", F.row_number().over(inside) - 1)
    placed = ranked.join(begins, ranked[source].eqNullSafe(begins["_source"]) & (ranked["_prefix"] == begins["_p"])).drop("_source", "_p")
    numbered = placed.withColumn("block", F.floor((F.col("_before") + F.col("_in")) / block_rows).cast("long"))
    info = slots.groupBy("_source").agg(F.first("_a").alias("_a"), F.first("_q").alias("_q"))
    # both tables have at most Q rows
    with_info = numbered.join(F.broadcast(info), numbered[source].eqNullSafe(info["_source"]), "left").drop("_source")
    turn = slots.select(F.col("_source").alias("_s"), "_k", "_at")
    slotted = with_info.join(F.broadcast(turn), with_info[source].eqNullSafe(turn["_s"]) & (with_info["block"] % with_info["_a"] == turn["_k"]), "left")
    return slotted.join(F.broadcast(end), F.lit(True)).select(  # `end` is one row
        *(F.col(v).alias(k) for k, v in own.items()), "block",
        F.expr("(block * _q) div _a").alias("release"),
        F.expr("((block + 1) * _q + _a - 1) div _a").alias("due"),
        F.expr("(block div _a) * _q + _at").alias("slot"),
        F.expr("coalesce((block div _a) * _q + _at < _end, false)").alias("in_mix"),
    )
