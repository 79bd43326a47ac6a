"""Near-duplicate embeddings: iterative quantisation and multi-index tables.

1.  Equal vectors form a class.  A rotation that balances the signs of the
    principal components is learnt on at most ``sample`` classes (those with
    the lowest hashes); several rotations give as many bits as are needed.
2.  The code is cut into tables of about log2(classes / LOAD) bits.  Two codes
    meet in a table if they differ there in one bit at most: each has its own
    value as a key, and looks under the values in which one of its set bits is
    clear.  So one of two codes that differ in a bit finds the other, and a
    table takes half as many keys of a code as it has bits.  For 10 million
    classes of any length that is some 16 tables of 20 bits, 176 keys, and with
    mark and code 12 KB that are shuffled for a vector.  The number of tables is such that a pair at the threshold
    meets with probability 0.97 if its bits differ independently; closer pairs
    meet almost surely.  Bits are taken about the sample's mean, where such a
    pair is at a wider angle; the tables are planned for the widest angle that
    it can have at any vector of the sample, or the mean is not subtracted
    where that would take more than ``WIDER`` times the tables.
    Pairs that meet are compared by whole codes, of CODE bits or more; in a key with more than RUN
    codes, all codes within twice the bound of a leader are tied to it, which
    takes in every pair of the codes within the bound, and these are done.
    After LEADERS leaders what is left of the key is tied together.
3.  Only a spanning forest of the pairs that pass leaves a task.  Its components
    are clusters.  In each cluster all pairs are compared by the cosine of the
    original vectors, in double precision.  Clusters of more than ``tile``
    classes have a core: vectors within half the threshold's angle of the
    cluster's mean are all linked with each other, by the triangle inequality,
    so only the others are compared, tile by tile, with all.  Nothing is capped.

Vectors that are null, zero, or hold nulls or non-finite numbers link with
nothing; each is its own component.  Vectors are compared with those of their
own length only; each length of more than FEW classes has its own tables.
Repeated rows are links of each other.  A null id is never the smallest unless
all ids of its component are null.  Other input columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import shared, wordhash
from barline.llm.components import components, forest

TILE = 512
#: Vectors of one length that are compared all with all, without tables.
FEW = 32
#: Bits in which codes may differ, beyond what is expected at the threshold, in deviations.
SPREAD = 3.0
#: Classes that a table has for each of its values.
LOAD = 16
#: Bits of a code at least, beyond those that tables use: what tells random pairs from near ones.
CODE = 256
#: Bits within which a chunk's codes stand for each other.
CLOSE = 4
#: Tables for vectors about their mean, at most, for each that they need about the origin.
WIDER = 2.0
#: Codes of a key that are compared all with all, and leaders of a longer run.
RUN, LEADERS = 1024, 64
#: Pairs that a bucket's task holds before it reduces them to a forest.
PAIRS = 4_000_000


class Quantiser:
    """Bits of vectors: signs of rotated principal components."""

    def __init__(self, sample: np.ndarray, tables: int, width: int, rounds: int = 30, seed: int = 11, centre: bool = True):
        unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
        self.mean = unit.mean(axis=0) * centre
        centred = unit - self.mean
        _, axes = np.linalg.eigh(centred.T @ centred)
        v = centred @ axes
        rng = np.random.default_rng(seed)
        d, blocks = v.shape[1], []
        for _ in range(math.ceil(code_bits(tables, width) / v.shape[1])):
            r, _ = np.linalg.qr(rng.standard_normal((d, d)))
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            blocks.append(axes @ r)
        self.project = np.concatenate(blocks, axis=1)[:, : code_bits(tables, width)]
        self.tables, self.width = tables, width

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return (unit - self.mean) @ self.project >= 0


def code_bits(tables: int, width: int) -> int:
    return max(tables * width, CODE)


def plan_tables(classes: int, threshold: float, recall: float = 0.97) -> tuple[int, int, int]:
    """(tables, bits in each, differing bits allowed in all)."""
    width = int(min(max(math.ceil(math.log2(max(classes / LOAD, 2))), 8), 24))
    threshold = min(threshold, 1 - 1e-9)
    p = math.acos(threshold) / math.pi
    meet = (1 - p) ** width + width * p * (1 - p) ** (width - 1)
    tables = max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))
    bits = code_bits(tables, width)
    return tables, width, math.ceil(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def centred_threshold(sample: np.ndarray, threshold: float) -> float:
    """The least cosine about the sample's mean of a pair at the threshold, one of which is in the sample.

    Unit vectors at cosine t are sqrt(2 - 2 t) apart; seen from a point at
    distance r or more from both, their cosine is 1 - (1 - t) / r^2 at least.
    """
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    near = float(((unit - unit.mean(axis=0)) ** 2).sum(axis=1).min())
    return max(-1.0, 1 - (1 - threshold) / near) if near > 0 else -1.0


def plan(sample: np.ndarray, classes: int, threshold: float) -> tuple[int, int, int, bool]:
    """(tables, bits in each, differing bits allowed in all, whether about the mean)."""
    plain, inner = plan_tables(classes, threshold), centred_threshold(sample, threshold)
    if inner > 0 and (about := plan_tables(classes, inner))[0] <= WIDER * plain[0]:
        return *about, True
    return *plain, False


def _hamming(codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes[a] ^ codes[b]).sum(axis=1, dtype=np.int64)


def _pairs_inside(starts: np.ndarray, sizes: np.ndarray):
    """Places (i, j), i < j, of all pairs inside each run, a bounded number at a time."""
    for s in np.unique(sizes[sizes > 1]):
        runs = starts[sizes == s]
        i, j = np.triu_indices(int(s), 1)
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(runs), step):
            base = runs[k : k + step, None]
            yield (base + i).ravel(), (base + j).ravel()


def _pairs_across(starts: np.ndarray, own: np.ndarray, sizes: np.ndarray):
    """Places (i, j) of the first ``own`` of each run with the rest of it, a bounded number at a time."""
    use = (own > 0) & (sizes > own)
    starts, own, rest = starts[use], own[use], (sizes - own)[use]
    first = 0
    upto = np.cumsum(own * rest)
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + 2_000_000)))
        s, n, m = starts[first:last], own[first:last], rest[first:last]
        run = np.repeat(np.arange(len(s)), n * m)
        at = np.arange(len(run)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        yield s[run] + at // m[run], s[run] + n[run] + at % m[run]
        first = last


def _canopies(codes: np.ndarray, members: np.ndarray, most: int):
    """(leader, others) ties that join, in one component each, every two members within ``most`` bits.

    A member within ``most`` bits of a leader has its partners within twice
    that of the leader, so it is done once these are tied.
    """
    for _ in range(LEADERS):
        if len(members) < 2:
            return
        far = _hamming(codes, members, members[:1])
        yield members[0], members[far <= 2 * most]
        members = members[far > most]
    if len(members) > 1:
        yield members[0], members


def _scatter(model: Quantiser, buckets: int):
    """Keys of a chunk's codes, packed by bucket; codes close to another's stand for it."""
    tables, width = model.tables, model.width

    def run(batches):
        for batch in batches:
            marks = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u8").reshape(-1, 2)
            vectors = np.array(batch.column(1).to_pylist(), dtype=np.float64)
            bits = model.bits(vectors)
            codes = np.packbits(bits, axis=1)
            codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % 8))).view("<u8")
            sub = (bits[:, : tables * width].reshape(len(bits), tables, width) * (1 << np.arange(width, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
            one = np.uint64(1) << np.arange(width, dtype=np.uint64)
            row, table, bit = np.nonzero(sub[:, :, None] & one)
            # a value's own key is even, those under which it looks are odd
            table = np.concatenate([np.tile(np.arange(tables), len(bits)), table]).astype(np.uint64)
            value = np.concatenate([sub.ravel(), sub[row, table[sub.size :].astype(np.int64)] ^ one[bit]])
            keys = wordhash.mix(value * np.uint64(4096) + table, 81) & ~np.uint64(1)
            keys[sub.size :] |= np.uint64(1)
            who = np.concatenate([np.repeat(np.arange(len(bits)), tables), row])
            order = np.argsort(keys, kind="stable")
            keys, who = keys[order], who[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            leader = np.repeat(who[starts], np.diff(np.r_[starts, len(keys)]))
            near = (who != leader) & (_hamming(codes, who, leader) <= CLOSE)
            tied = np.unique(np.stack([leader[near], who[near]], axis=1), axis=0)
            keys, who = keys[~near], who[~near]
            bucket = ((keys >> np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            keys, who, bucket = keys[order], who[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [], [], [], [], []
            for b in range(buckets):
                i, j = cuts[b], cuts[b + 1]
                ties = tied if b == 0 else tied[:0]
                if i == j and len(ties) == 0:
                    continue
                used, local = np.unique(who[i:j], return_inverse=True)
                for column, value in zip(out, (b, marks[used].tobytes() + codes[used].tobytes(), keys[i:j].tobytes(), local.astype("<u4").tobytes(), marks[ties].tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "points", "keys", "local", "ties"])

    return run


def _gather(words: int, most: int):
    """Edges (a, b) of each bucket's forest."""

    def solve(held):
        points = [np.frombuffer(r["points"], dtype="<u8") for r in held]
        sizes = [len(p) // (2 + words) for p in points]
        marks = np.concatenate([p[: 2 * n].reshape(n, 2) for p, n in zip(points, sizes)])
        codes = np.concatenate([p[2 * n :].reshape(n, words) for p, n in zip(points, sizes)])
        keys = np.concatenate([np.frombuffer(r["keys"], dtype="<u8") for r in held])
        base = np.r_[0, np.cumsum(sizes)[:-1]]
        who = np.concatenate([np.frombuffer(r["local"], dtype="<u4").astype(np.int64) + b for r, b in zip(held, base)])
        order = np.argsort(keys, kind="stable")
        keys, who = keys[order], who[order]
        value = keys >> np.uint64(1)
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
        left, right, kept = [], [], 0
        ends = np.r_[starts[1:], len(keys)] if len(starts) else starts
        own = ends - starts - np.add.reduceat((keys & np.uint64(1)).astype(np.int64), starts) if len(starts) else starts
        long = own * (ends - starts) > RUN * RUN
        for i, j in zip(starts[long], ends[long]):
            for leader, others in _canopies(codes, np.unique(who[i:j]), most):
                left.append(np.full(len(others), leader)), right.append(others)  # noqa: B018
        for i, j in itertools.chain(_pairs_inside(starts[~long], own[~long]), _pairs_across(starts[~long], own[~long], (ends - starts)[~long])):
            a, b = who[i], who[j]
            ok = _hamming(codes, a, b) <= most
            left.append(a[ok]), right.append(b[ok])  # noqa: B018
            kept += len(left[-1])
            if kept > PAIRS:  # their forest says as much
                root = forest(len(marks), np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(root != np.arange(len(marks)))
                left, right, kept = [moved], [root[moved]], 0
        if left:
            root = forest(len(marks), np.concatenate(left), np.concatenate(right))
            moved = np.flatnonzero(root != np.arange(len(marks)))
            yield from _edges(marks[moved], marks[root[moved]])
        for r in held:
            if r["ties"]:
                t = np.frombuffer(r["ties"], dtype="<u8").reshape(-1, 2, 2)
                yield from _edges(t[:, 0], t[:, 1])

    def run(batches):
        current, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["bucket"] != current and held:
                    yield from solve(held)
                    held = []
                current = row["bucket"]
                held.append(row)
        if held:
            yield from solve(held)

    return run


def _edges(a: np.ndarray, b: np.ndarray):
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], names=["a", "b"])


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of unit rows, at the threshold or above."""
    return x @ y.T >= threshold


_OUT = "mark binary, n long, a binary, b binary"


def _results(marks, counts, edges):
    """Count rows and edge rows in one batch."""
    a, b = zip(*edges) if edges else ((), ())
    nothing = [None] * len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array([*marks, *nothing], pa.binary()), pa.array([*map(int, counts), *nothing], pa.int64()), pa.array([*[None] * len(marks), *a], pa.binary()), pa.array([*[None] * len(marks), *b], pa.binary())],
        names=["mark", "n", "a", "b"],
    )


def _small(threshold: float):
    """All pairs of each cluster: linked rows of every class, and a forest."""

    def solve(rows):
        marks = [r[0] for r in rows]
        weight = np.array([r[1] for r in rows], dtype=np.int64)
        x = np.array([r[2] for r in rows], dtype=np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        linked = _linked(x, x, threshold)
        np.fill_diagonal(linked, False)
        root = forest(len(rows), *np.nonzero(linked))
        return _results(marks, linked @ weight, [(marks[i], marks[r]) for i, r in enumerate(root) if i != r])

    def run(batches):
        current, held = None, []
        for batch in batches:
            for cluster, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if cluster != current and held:
                    yield solve(held)
                    held = []
                current = cluster
                held.append(row)
        if held:
            yield solve(held)

    return run


def _tiles(threshold: float):
    """Classes of a tile against a part of the cluster's classes outside its core."""

    def solve(rows):
        outer = [r for r in rows if r[0] == 0]
        inner = [r for r in rows if r[0] == 1]
        if not outer or not inner:
            return None
        unit = lambda r: (x := np.array([k[4] for k in r], dtype=np.float64)) / np.linalg.norm(x, axis=1, keepdims=True)
        linked = _linked(unit(outer), unit(inner), threshold)
        place = {r[1]: k for k, r in enumerate(inner)}
        for k, r in enumerate(outer):
            if r[1] in place:
                linked[k, place[r[1]]] = False
        w_out, w_in = np.array([r[2] for r in outer]), np.array([r[2] for r in inner])
        core = np.array([r[3] for r in inner])
        a, b = np.nonzero(linked)
        names = [r[1] for r in outer] + [r[1] for r in inner]
        root = forest(len(names), a, b + len(outer))
        return _results(names, np.r_[linked @ (w_in * core), linked.T @ w_out], [(names[i], names[r]) for i, r in enumerate(root) if i != r])

    def run(batches):
        current, held = None, []
        for batch in batches:
            for cluster, tile, part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, tile, part) != current:
                    if held and (out := solve(held)):
                        yield out
                    held = []
                current = cluster, tile, part
                held.append(row)
        if held and (out := solve(held)):
            yield out

    return run


def _large(members: DataFrame, dims: int, threshold: float) -> DataFrame:
    """Counts and edges of clusters of more than TILE classes."""
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    norm = F.sqrt(F.aggregate(F.transform("v", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))
    unit = members.withColumn("norm", norm).withColumn("u", F.transform("v", lambda x: x.cast("double") / F.col("norm")))
    mean = unit.groupBy("cluster").agg(F.array(*(F.avg(F.col("u")[i]) for i in range(dims))).alias("mean"))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    # a cluster's figures go to each of its tiles, so that joins with them deal rows by tile and not whole clusters
    tiles = unit.select("cluster", "tile").distinct()
    by_tile = "cluster", "tile"
    cored = unit.join(mean.join(tiles, "cluster"), [*by_tile]).withColumn("core", F.coalesce(dot(F.col("u"), F.col("mean")) >= half * F.sqrt(dot(F.col("mean"), F.col("mean"))), F.lit(False)))
    cored = shared.table(cored.select("cluster", "mark", "w", "v", F.col("core").cast("int").alias("core"), F.col("tile")), "cores")
    tiles = shared.table(cored.select(*by_tile).distinct(), "tiles")
    core = cored.where("core = 1").groupBy("cluster").agg(F.sum("w").alias("all"), F.min("mark").alias("first"))
    inside = cored.where("core = 1").join(core.join(tiles, "cluster"), [*by_tile]).select("mark", (F.col("all") - F.col("w")).alias("n"), F.col("mark").alias("a"), F.col("first").alias("b"))
    outer = cored.where("core = 0")
    sizes = outer.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("parts"))
    outer = outer.join(sizes.join(tiles, "cluster"), [*by_tile]).withColumn("part", F.pmod(F.xxhash64("mark", F.lit(1)), F.col("parts")).cast("int"))
    parts = outer.select("cluster", "part").distinct()
    meetings = shared.table(parts.join(tiles, "cluster"), "meetings")
    rows = (
        outer.select("cluster", "part", "mark", "w", "core", "v").join(meetings, ["cluster", "part"]).select("cluster", "tile", "part", F.lit(0).alias("kind"), "mark", "w", "core", "v")
        .union(cored.join(meetings, [*by_tile]).select("cluster", "tile", "part", F.lit(1), "mark", "w", "core", "v"))
        .repartition("cluster", "tile", "part").sortWithinPartitions("cluster", "tile", "part")
    )
    return inside.union(rows.mapInArrow(_tiles(threshold), _OUT))


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", sample: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``."""
    spark = vectors.sparkSession
    v = F.transform(F.col(embedding), lambda x: x.cast("double"))
    size = F.array_max(F.transform("_v", F.abs))
    good = F.coalesce(F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (size > 0), F.lit(False))
    # squares of very large or small components would leave the range of doubles
    scaled = F.when((size > 1e150) | (size < 1e-150), F.transform("_v", lambda x: x / size)).otherwise(F.col("_v"))
    # the 128-bit mark of a vector's components; zero signs don't count
    plain = F.transform(F.col("_v"), lambda x: x + F.lit(0.0))
    mark = F.when(good, F.unhex(F.md5(F.to_json(plain).cast("binary"))))
    marked = shared.table(vectors.select(F.col(vec_id).alias("vec_id"), v.alias("_v")).withColumn("mark", mark).withColumn("_v", F.when(good, scaled)), "marked")
    classes = marked.where("mark is not null").groupBy("mark").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("first_id"), F.first("_v").alias("v"))
    classes = shared.table(classes, "classes")
    # vectors of another length have no cosine with these; a length that one task can hold needs no tables
    lengths = classes.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n"))
    few = classes.join(lengths.where(F.col("n").between(2, FEW)).withColumnRenamed("n", "m"), F.size("v") == F.col("dims"))
    parts = [few.select(F.col("dims").cast("string").cast("binary").alias("cluster"), "mark", "w", "v").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_small(threshold), _OUT)]
    parts += [_of_length(classes.where(F.size("v") == r.dims), r.dims, r.n, threshold, sample) for r in lengths.where(F.col("n") > FEW).collect()]
    links = shared.table(functools.reduce(DataFrame.union, parts), "links")
    counts = links.where("mark is not null").groupBy("mark").agg(F.sum("n").alias("n"))
    roots = components(links.select("a", "b")).select(F.col("node").alias("mark"), "root")
    rooted = classes.select("mark", "w", "first_id").join(roots, "mark", "left").join(counts, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = shared.attach(rooted, names, "root", "mark").select("mark", "component_id", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).cast("long").alias("n_links"))
    linked = shared.attach(marked.where("mark is not null").select("vec_id", "mark"), named, "mark", "vec_id").select("vec_id", "n_links", F.coalesce("component_id", "vec_id").alias("component_id"))
    alone = marked.where("mark is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _of_length(classes: DataFrame, dims: int, count: int, threshold: float, sample: int) -> DataFrame:
    """Counts and edges of the classes of one length."""
    picked = classes.select("mark", "v").orderBy(F.xxhash64("mark"), "mark").limit(sample).toArrow().column("v").combine_chunks()
    learnt = picked.flatten().to_numpy().reshape(-1, dims)
    tables, width, most, centre = plan(learnt, count, threshold)
    model = Quantiser(learnt, tables, width, centre=centre)
    words = (code_bits(tables, width) + 63) // 64
    buckets = int(max(12, min(count * tables * width // 500_000, 1 << 20)))
    packed = classes.select("mark", "v").mapInArrow(_scatter(model, buckets), "bucket int, points binary, keys binary, local binary, ties binary")
    near = packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_gather(words, most + 2 * CLOSE), "a binary, b binary").distinct()
    near = shared.table(near, "near")
    clusters = components(near).select(F.col("root").alias("cluster"), F.col("node").alias("mark"))
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    placed = shared.attach_few(clusters, sizes, "cluster", "mark").withColumn("tile", F.pmod(F.xxhash64("mark"), F.ceil(F.col("m") / TILE)).cast("int"))
    members = shared.table(placed.join(classes.select("mark", "w", "v"), "mark"), "members")
    small = members.where(F.col("m") <= TILE).select("cluster", "mark", "w", "v").repartition("cluster").sortWithinPartitions("cluster").mapInArrow(_small(threshold), _OUT)
    large = members.where(F.col("m") > TILE)
    return small.union(_large(large, dims, threshold)) if large.limit(1).count() else small
