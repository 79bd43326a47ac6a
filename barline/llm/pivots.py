"""Hard negatives by a pivot table: inner products bracketed by stored distances.

Vectors x of whole numbers, of norm M at most, get one more component,
sqrt(M^2 - |x|^2), and an anchor q gets 0 there.  Then
|q - x|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner product is the least
distance.  A few rows are pivots; each row's distances to them are stored.  By
the triangle inequality |d(q,p) - d(x,p)| <= d(q,x) <= d(q,p) + d(x,p) for each
pivot p, which brackets the score from both sides.

1.  The table is sorted by length, nearest pivot and distance to it, and cut
    into blocks of about BLOCK rows.
2.  Anchors, in chunks of about CHUNK, meet blocks; a tile is one task's work.
    In it runs of CELL rows are taken in order of their best bound.  A run is
    passed over by the anchors that its bracket rules out, then single rows
    are, and what is left is checked by the exact inner product.
3.  First each anchor's best rows of its label are found, then for each of
    these the best rows of other labels whose score lies in a band below its
    score.  In the second step blocks that the bracket rules out aren't read.

Labels don't deal rows, so a hot label fills no task.  Pivots are chosen, each
the farthest from those before it, among at most ``sample`` rows; they decide
how much is checked, never what is found.  Brackets are widened by the rounding
errors of their distances.

Rows with a null label or a vector that is null or holds a null take no part,
nor do vectors with |x|^2 of 2^62 or more, whose scores may not fit a long.
Vectors meet those of their own length only.  Repeated rows are rows of their
own; ties go to the smaller id, null ids last.  Anchors without a positive, and
positives without a negative, give no row.  Other input columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm import shared

#: Rows of a block, anchors of a chunk, rows that are ruled out together.
BLOCK, CHUNK, CELL = 32_768, 2_048, 256
#: Pivots of each length of vectors.
PIVOTS = 8
#: Share of M^2 by which rounding may move a bracket: distances are roots of differences that are exact to 2^-50 of M^2.
SLACK = 1e-6


def choose_pivots(vectors: np.ndarray, m2: float, count: int = PIVOTS) -> np.ndarray:
    """Rows far from each other in the augmented space, with their last component."""
    last = np.sqrt(np.maximum(m2 - (vectors**2).sum(axis=1), 0.0))
    full = np.column_stack([vectors, last])
    taken, gap = [0], ((full - full[0]) ** 2).sum(axis=1)
    while len(taken) < min(count, len(full)) and gap.max() > 0:
        taken.append(int(gap.argmax()))
        gap = np.minimum(gap, ((full - full[taken[-1]]) ** 2).sum(axis=1))
    return full[taken]


def _distances(full: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (full**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def _with_distances(pivots: dict[int, np.ndarray], m2: float):
    """Batches of rows with packed vectors and distances to their length's pivots, as rows and as anchors."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector")
            size = np.diff(np.asarray(vectors.offsets))
            flat, starts = np.asarray(vectors.flatten()), np.r_[0, np.cumsum(size)]
            packed, near, cell = [b""] * len(size), np.zeros(len(size)), np.zeros(len(size), dtype=np.int32)
            mine, asked = [[]] * len(size), [[]] * len(size)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                x = flat[(starts[at][:, None] + np.arange(d))].reshape(len(at), d)
                for i, row in zip(at, x.astype("<i4")):
                    packed[i] = row.tobytes()
                p = pivots.get(int(d))
                if p is None:
                    continue
                v = x.astype(np.float64)
                rest = np.sqrt(np.maximum(m2 - (v**2).sum(axis=1), 0.0))
                dx, dq = _distances(np.column_stack([v, rest]), p), _distances(np.column_stack([v, np.zeros(len(v))]), p)
                cell[at], near[at] = dx.argmin(axis=1), dx.min(axis=1)
                for i, a, b in zip(at, dx, dq):
                    mine[i], asked[i] = a, b
            doubles = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("uid", "id", "unnamed", "label", "anchor", "n2")), pa.array(size, pa.int32()), pa.array(packed, pa.binary()), pa.array(cell), pa.array(near), pa.array(mine, doubles), pa.array(asked, doubles)],
                names=["uid", "id", "unnamed", "label", "anchor", "n2", "d", "v", "cell", "near", "dx", "dq"],
            )

    return run


def _kept(pool: list[tuple[np.ndarray, ...]], tie: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """The best ``top`` of each query among (query, score, row)."""
    q, s, r = (np.concatenate(c) for c in zip(*pool))
    order = np.lexsort((tie[r], -s, q))
    q, s, r = q[order], s[order], r[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[place < top], s[place < top], r[place < top]


def search(x: np.ndarray, q: np.ndarray, dx: np.ndarray, dq: np.ndarray, m2: float, allowed, low: np.ndarray, high: np.ndarray, tie: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, score, row) of the best rows of each query: anchor a's query j wants scores in [low, high][a, j].

    ``allowed(anchors, rows)`` says which pairs count; ``tie`` orders rows of equal scores.
    """
    n, asks = low.shape
    exact = float((x.astype(np.float64) ** 2).sum(axis=1).max()) * float((q.astype(np.float64) ** 2).sum(axis=1).max()) < 2.0**105
    xs, qs = (x.astype(np.float64), q.astype(np.float64)) if exact else (x.astype(np.int64), q.astype(np.int64))
    q2, slack = (q.astype(np.float64) ** 2).sum(axis=1), SLACK * m2 + 1.0
    starts = np.arange(0, len(x), CELL)
    near, far = np.zeros((n, len(starts))), np.full((n, len(starts)), np.inf)
    for k in range(dx.shape[1]):
        least, most, at = np.minimum.reduceat(dx[:, k], starts), np.maximum.reduceat(dx[:, k], starts), dq[:, k : k + 1]
        near, far = np.maximum(near, np.maximum(at - most, least - at)), np.minimum(far, at + most)
    upper, lower = (q2[:, None] + m2 - near**2) / 2 + slack, (q2[:, None] + m2 - far**2) / 2 - slack
    need, cap = low.astype(np.float64), high.astype(np.float64).max(axis=1)
    none = np.zeros(0, dtype=np.int64)
    pool, held = [(none, none, none)], 0
    for c in np.argsort(-upper.max(axis=0), kind="stable"):
        rows = np.arange(starts[c], min(starts[c] + CELL, len(x)))
        least = need.min(axis=1)
        some = np.flatnonzero((upper[:, c] >= least) & (lower[:, c] <= cap))
        if not len(some):
            continue
        near, far = np.zeros((len(some), len(rows))), np.full((len(some), len(rows)), np.inf)
        for k in range(dx.shape[1]):
            a, b = dq[some, k][:, None], dx[rows, k][None, :]
            near, far = np.maximum(near, np.abs(a - b)), np.minimum(far, a + b)
        base = q2[some][:, None] + m2
        left = ((base - near**2) / 2 + slack >= least[some][:, None]) & ((base - far**2) / 2 - slack <= cap[some][:, None])
        left &= allowed(some, rows)
        i, r = np.nonzero(left)
        if not len(i):
            continue
        scores = (qs[some] @ xs[rows].T)[i, r].astype(np.int64)
        for j in range(asks):
            fit = (scores >= low[some[i], j]) & (scores <= high[some[i], j]) & (scores >= need[some[i], j])
            pool.append((some[i[fit]] * asks + j, scores[fit], rows[r[fit]]))
            held += int(fit.sum())
        if held > 2 * n * asks * top:
            best = _kept(pool, tie, top)
            pool, held = [best], 0
            full = np.flatnonzero(np.bincount(best[0], minlength=n * asks) == top)
            worst = np.full(n * asks, -np.inf)
            last = np.searchsorted(best[0], full, side="right") - 1
            worst[full] = best[1][last].astype(np.float64) * (1 - 2.0**-50 * np.sign(best[1][last]))  # a double may lie above the score
            need = np.maximum(need, worst.reshape(n, asks))
    return _kept(pool, tie, top)


def _tiles(m2: float, top: int, below: tuple[int, int, int, int] | None):
    """The search of a (block, chunk) tile, over rows and anchors of each length."""

    def run(rows: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"anchor": pd.Series(dtype="int64"), "ask": pd.Series(dtype="int32"), "uid": pd.Series(dtype="int64"), "id": pd.Series(dtype="object"), "unnamed": pd.Series(dtype="bool"), "score": pd.Series(dtype="int64")})]
        for d in sorted(set(rows["d"]) & set(anchors["d"])):
            mine = rows[rows["d"] == d].sort_values(["cell", "near", "uid"], kind="stable").reset_index(drop=True)
            asked = anchors[anchors["d"] == d].reset_index(drop=True)
            x, q = (np.frombuffer(b"".join(f["v"]), dtype="<i4").reshape(len(f), d) for f in (mine, asked))
            dx, dq = (np.array(f[c].tolist(), dtype=np.float64).reshape(len(f), -1) for f, c in ((mine, "dx"), (asked, "dq")))
            labels = pd.factorize(pd.concat([mine["label"], asked["label"]]))[0]
            of_row, of_anchor, uid, own = labels[: len(mine)], labels[len(mine) :], mine["uid"].to_numpy(), asked["uid"].to_numpy()
            tie = np.empty(len(mine), dtype=np.int64)
            tie[mine.sort_values(["unnamed", "id", "uid"], kind="stable").index] = np.arange(len(mine))
            if below is None:
                low, high = np.full((len(q), 1), -(2**62), dtype=np.int64), np.full((len(q), 1), 2**62, dtype=np.int64)
                allowed = lambda a, r: (of_anchor[a][:, None] == of_row[r]) & (own[a][:, None] != uid[r])  # noqa: E731, B023
            else:
                most, (ln, ld, hn, hd) = max(map(len, asked["wanted"])), below
                low, high = np.full((len(q), most), 1, dtype=np.int64), np.zeros((len(q), most), dtype=np.int64)  # no score fits what isn't asked
                for i, wanted in enumerate(asked["wanted"]):
                    for j, s in enumerate(map(int, wanted)):
                        low[i, j], high[i, j] = -(-ln * s // ld), hn * s // hd
                allowed = lambda a, r: of_anchor[a][:, None] != of_row[r]  # noqa: E731, B023
            asks, score, r = search(x, q, dx, dq, m2, allowed, low, high, tie, top)
            a, j = np.divmod(asks, low.shape[1])
            out.append(pd.DataFrame({"anchor": own[a], "ask": j.astype(np.int32), "uid": uid[r], "id": mine["id"].to_numpy()[r], "unnamed": mine["unnamed"].to_numpy()[r], "score": score}))
        return pd.concat(out[1:] or out, ignore_index=True)

    return run


def _best(found: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each (anchor, ask) over all blocks, with their ``rank`` from 1."""
    order = Window.partitionBy("anchor", "ask").orderBy(F.desc("score"), "unnamed", "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100), sample: int = 2048, pivots: int = PIVOTS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for ``rows`` (id, label, vector of longs, anchor).

    A negative's score is at least low[0] / low[1] and at most high[0] / high[1] of the positive's.
    """
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    whole = rows.where("label is not null and vector is not null").where(~F.exists("vector", lambda x: x.isNull()))
    kind = dict(rows.dtypes)["id"]  # pandas has no null of every type, so that ids are filled and the null ones marked
    fit = whole.select(F.coalesce("id", F.lit("0").cast(kind)).alias("id"), F.col("id").isNull().alias("unnamed"), "label", "vector", F.coalesce("anchor", F.lit(False)).alias("anchor"), square.alias("n2")).where(F.col("n2") < 2.0**62)
    taken = shared.table(fit.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    count, asked, m2 = taken.agg(F.count(F.lit(1)), F.count_if("anchor"), F.coalesce(F.max("n2"), F.lit(0.0))).first()
    by_length: dict[int, list] = {}
    for r in taken.orderBy(F.xxhash64("uid")).limit(sample).select("vector").collect():
        by_length.setdefault(len(r.vector), []).append(r.vector)
    chosen = {d: choose_pivots(np.array(vs, dtype=np.float64).reshape(len(vs), d), m2, pivots) for d, vs in by_length.items()}

    kinds = dict(taken.dtypes)
    schema = f"uid long, id {kind}, unnamed boolean, label {kinds['label']}, anchor boolean, n2 double, d int, v binary, cell int, near double, dx array<double>, dq array<double>"
    blocks = max(1, math.ceil(count / BLOCK), min(math.ceil(count / (2 * CELL)), 2 * taken.sparkSession.sparkContext.defaultParallelism))
    chunks = max(1, math.ceil(asked / CHUNK))
    table = taken.select("uid", "id", "unnamed", "label", "anchor", "n2", "vector").mapInArrow(_with_distances(chosen, m2), schema)
    table = shared.table(table.repartitionByRange(blocks, "d", "cell", "near", "uid").withColumn("block", F.spark_partition_id()), "pivots")

    # which lengths a block holds, and how near and far its rows are from each pivot
    spread = table.select("block", "d", F.posexplode_outer("dx").alias("k", "x")).groupBy("block", "d", "k").agg(F.min("x").alias("least"), F.max("x").alias("most"))
    ranges = shared.table(spread.groupBy("block", "d").agg(F.sort_array(F.collect_list(F.struct("k", "least", "most"))).alias("spread")), "ranges")
    chunk = F.pmod(F.xxhash64("uid"), F.lit(chunks)).cast("int").alias("chunk")
    anchors = table.where("anchor").select(*(F.col(c).alias(c) for c in ("uid", "label", "d", "v", "dq", "n2")), chunk)  # columns apart from the rows' own
    held = table.select("block", "uid", "id", "unnamed", "label", "d", "v", "cell", "near", "dx", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def tiles(queries: DataFrame, top: int, below: tuple[int, int, int, int] | None) -> DataFrame:
        told = held.groupBy("block", "chunk").cogroup(queries.groupBy("block", "chunk")).applyInPandas(_tiles(m2, top, below), f"anchor long, ask int, uid long, id {kind}, unnamed boolean, score long")
        return _best(told, top).withColumn("id", F.when(~F.col("unnamed"), F.col("id")))

    def met(queries: DataFrame) -> DataFrame:
        """Anchors with each block that holds rows of their length: a row of each for each block, the stated query set against all rows."""
        return queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(ranges, ["block", "d"])

    near = tiles(met(anchors).drop("spread"), positives, None)
    firsts = shared.table(near.select("anchor", (F.col("rank") - 1).alias("ask"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = firsts.groupBy(F.col("anchor").alias("uid")).agg(F.transform(F.sort_array(F.collect_list(F.struct("ask", "positive_score"))), lambda p: p["positive_score"]).alias("wanted"))
    # a block is met if its bracket and the widest band of the anchor have something in common
    closest = F.aggregate("spread", F.lit(0.0), lambda s, p: F.coalesce(F.greatest(s, F.get("dq", p["k"]) - p["most"], p["least"] - F.get("dq", p["k"])), s))
    farthest = F.aggregate("spread", F.lit(float("inf")), lambda s, p: F.coalesce(F.least(s, F.get("dq", p["k"]) + p["most"]), s))
    slack = SLACK * m2 + 1.0
    may = ((F.col("n2") + m2 - closest * closest) / 2 + slack >= F.array_min("wanted") * (low[0] / low[1]) - slack) & ((F.col("n2") + m2 - farthest * farthest) / 2 - slack <= F.array_max("wanted") * (high[0] / high[1]) + slack)
    asks = met(anchors.join(wanted, "uid").where(F.array_max("wanted") >= 0)).where(may).drop("spread")
    far = tiles(asks, negatives, (*low, *high))
    names = taken.where("anchor").select(F.col("uid").alias("anchor"), F.when(~F.col("unnamed"), F.col("id")).alias("anchor_id"))
    out = far.select("anchor", "ask", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(firsts, ["anchor", "ask"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
