"""Connected components of an edge table, by forests of dealt edges and joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import shared


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least reachable number of each of n points, for one task's edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def stars(edges: list[tuple[bytes, bytes]]) -> tuple[list[bytes], list[bytes]]:
    """(least node, other node) of each component of one task's edges."""
    names = sorted({x for edge in edges for x in edge})
    place = {x: i for i, x in enumerate(names)}
    a, b = (np.array([place[e[k]] for e in edges], dtype=np.int64) for k in (0, 1))
    root = forest(len(names), a, b)
    moved = np.flatnonzero(root != np.arange(len(names)))
    return [names[root[i]] for i in moved], [names[i] for i in moved]


#: Edges that a task holds before it reduces them to a forest.
HELD = 500_000


def _merge(batches):
    """(a, b, again): a task's edges (a < b, dealt by b) as stars; ``again`` if
    some b has edges to several nodes, which other tasks must then hear of."""
    held, parent, again = set(), {}, False

    def reduced():
        low, other = stars(list(held))
        return set(zip(low, other))

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for edge in zip(*(c.to_pylist() for c in batch.columns)):
            again = again or parent.setdefault(edge[1], edge[0]) != edge[0]
            held.add(edge)
        if len(held) > HELD:
            held = reduced()
    if held:
        low, other = zip(*reduced())
        for at in range(0, len(low), 10_000):
            a, b = (pa.array(x[at : at + 10_000], kind) for x in (low, other))
            yield pa.RecordBatch.from_arrays([a, b, pa.array([again] * len(a))], names=["a", "b", "again"])


def _ups(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """(a, up): the smaller ends that have a smaller neighbour themselves; ``up`` has one row for each of its ``a``."""
    return pairs.select("a").distinct().join(up, "a")


def _moved_up(pairs: DataFrame, ups: DataFrame) -> DataFrame:
    """(a, b): each edge with its smaller end's ``up``, if there is one.  An end's
    edges are dealt over SALTS tasks, as it may have most of them."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(shared.SALTS - 1))).alias("salt")
    dealt = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(shared.SALTS)).cast("int"))
    return dealt.join(ups.select("a", "up", salts), ["a", "salt"], "left").select(F.coalesce("up", "a").alias("a"), "b")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): each node of an edge with the least node that it reaches.

    Each task reduces its edges to a forest's stars; these are dealt by their
    larger end, so no root gathers rows, and reduced again.  A node that then has edges to
    several smaller ones makes another round; from the third on, edges move up
    to their smaller end's smaller neighbour between rounds, so that long chains
    halve.  When every node has one edge to a smaller one, these are followed to
    the roots by joins, in which only ends with a smaller neighbour take part,
    and no end's edges meet in one task.  Each round's table is written to the
    shared folder.  Nodes may be of any ordered type; loops and repeated edges do no harm, edges
    with a null end are left out.
    """
    kind = dict(edges.dtypes)[a]
    schema = f"a {kind}, b {kind}, again boolean"
    ends = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    pairs = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    # each task's own forest first, so that a node has few edges left when they are dealt
    own = pairs.mapInArrow(_merge, schema).select("a", "b")
    merged = shared.table(own.repartition("b").mapInArrow(_merge, schema), "forest")
    for done in range(1, most_rounds + 1):
        if not merged.where("again").limit(1).count():
            break
        pairs = merged.select("a", "b")
        if done > 2:
            up = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("up"))
            tied = up.select(F.col("up").alias("a"), F.col("a").alias("b"))
            pairs = _moved_up(pairs, _ups(pairs, up)).select("a", "b").union(tied)
        after = shared.table(pairs.repartition("b").mapInArrow(_merge, schema), "forest")
        shared.drop(merged)
        merged = after
    else:
        raise RuntimeError(f"components need more than {most_rounds} rounds")
    while True:  # every node has one parent now; a node's parent's parent, until all parents are roots
        ups = shared.table(_ups(merged, merged.select(F.col("a").alias("up"), F.col("b").alias("a"))), "ups")
        if not ups.limit(1).count():
            break
        after = shared.table(_moved_up(merged, ups), "forest")
        shared.drop(merged)
        merged = after
    loops = ends.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("root"))
    all_ = merged.select(F.col("b").alias("node"), F.col("a").alias("root")).union(merged.select(F.col("a").alias("node"), F.col("a").alias("root"))).union(loops)
    labels = shared.table(all_.groupBy("node").agg(F.min("root").alias("root")), "labels")
    shared.drop(merged)
    return labels
