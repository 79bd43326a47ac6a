"""N-gram Jaccard join: documents linked by shared word shingles, exactly.

A document's set holds the hashes of its distinct 5-word shingles.  Documents
with equal sets form a class and are compared once.  The join of the classes
has four steps.

1.  *Blocks.*  A set similar to another (Jaccard 0.75) shares with it one of
    its first ``n - ceil(0.75 n) + 1`` elements in any fixed order, so classes
    are gathered by these elements.  Elements found in many documents come
    last in the order (a list of bounded size; the list changes the work, not
    the result).  A block is the set of classes under one element.
2.  *Count-vector R-tree* inside each block (``counttree``): element hashes
    are put into groups, group counts are points, and pairs whose summed
    coordinate minima are too small are passed over.  Only a spanning forest
    of the surviving pairs leaves a block; very large blocks give a star.
    The forests' components are clusters outside which no link exists.
3.  *Verification.*  Each cluster's sets meet in one task, where surviving
    pairs are verified on the sets unless their documents are joined already.
    A cluster of more than ``tile`` classes is cut into tiles: tiles are
    solved alone, then hubs (sets of components that are not the largest, in
    rounds of twice as many) are compared with every tile, until each class
    outside the largest component has been a hub.  Pairs whose documents are
    joined already need no comparison; no pair is skipped otherwise.
4.  *Components* of the verified links, named by their smallest id.

Null and empty texts and texts of white space have no shingle and link with
nothing.  Repeated rows share their class.  A null id takes part, and is not
the smallest unless all are null.  Other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import counttree as T
from barline.llm import shared, wordhash
from barline.llm.components import components, stars

#: Elements in the list of frequent ones (8 bytes each when sent to workers).
FREQUENT = 1 << 17
#: Bytes of text that are handled as one chunk, and set elements for each bucket.
CHUNK, BUCKET = 4 << 20, 5 << 18
#: Classes of a block that are indexed together, and of a cluster in one task.
BLOCK, TILE, HUBS = 1024, 1024, 1024


def _sets(part: pa.Array):
    """(row, key) of a slice's distinct shingles, by row, with the rows' sizes and marks."""
    rows, keys = T.distinct(*T.shingles(*wordhash.words(part)))
    n = np.bincount(rows, minlength=len(part))
    marks = np.zeros((len(part), 2), dtype=np.uint64)
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        for k in (0, 1):
            marks[rows[starts], k] = np.add.reduceat(wordhash.mix(keys, 41 + k), starts)
    marks[:, 0] ^= wordhash.mix(n.astype(np.uint64), 43)
    return rows, keys, n, marks


def _chunks(batches, column: int):
    """(other columns' batch, slice of texts) pieces of about CHUNK bytes."""
    for batch in batches:
        for at, part in wordhash.slices(batch.column(column), CHUNK):
            yield batch.slice(at, len(part)), part


def profiles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n, mark): each document's set size and the 128-bit mark of its set (null if empty); ``digest`` is the text's."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        for batch, part in _chunks(batches, 1):
            _, _, n, marks = _sets(part)
            mark = [m.tobytes() if k else None for m, k in zip(marks, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(mark, pa.binary())], names=["doc_id", "digest", "n", "mark"])

    return docs.select(F.col(doc_id), F.col(text), F.xxhash64(text)).mapInArrow(run, f"doc_id {kind}, digest long, n long, mark binary")


def frequent_elements(docs: DataFrame, text: str = "text", limit: int = FREQUENT) -> np.ndarray:
    """Hashes of the elements held by most classes, most frequent last, at most ``limit``.

    Counts are summed over chunks that hold an element at least three times.
    """

    def run(batches):
        for _, part in _chunks(batches, 0):
            rows, keys, _, marks = _sets(part)
            _, first = np.unique(marks[:, 0], return_index=True)
            once = np.zeros(len(part), dtype=bool)
            once[first] = True
            element, count = np.unique(keys[once[rows]], return_counts=True)
            many = count >= 3
            yield pa.RecordBatch.from_arrays([pa.array(element[many].astype(np.int64)), pa.array(count[many])], names=["e", "c"])

    counts = docs.select(text).mapInArrow(run, "e long, c long").groupBy("e").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "e").limit(limit).toArrow()
    c, e = top.column("c").to_numpy(), top.column("e").to_numpy().astype(np.uint64)
    return e[np.lexsort((e, c))]


def _memberships(docs: DataFrame, frequent: np.ndarray, buckets: int, text: str) -> DataFrame:
    """(block, mark, hub): classes that share a prefix element with another class.

    ``block`` names a set of classes of at most BLOCK; in larger blocks it is
    null and ``hub`` is the class that all members are tied to.
    """
    by_hash = np.sort(frequent)
    rank = np.empty(len(frequent), dtype=np.uint64)
    rank[np.searchsorted(by_hash, frequent)] = np.arange(len(frequent), dtype=np.uint64)
    top = np.uint64(1 << 63)

    def scatter(batches):
        for _, part in _chunks(batches, 0):
            rows, keys, n, marks = _sets(part)
            _, first = np.unique(marks, axis=0, return_index=True)
            once = np.zeros(len(part), dtype=bool)
            once[first] = n[first] > 0
            keep = once[rows]
            rows, keys = rows[keep], keys[keep]
            if len(rows) == 0:
                continue
            if len(by_hash):  # frequent elements sort after all others
                at = np.minimum(np.searchsorted(by_hash, keys), len(by_hash) - 1)
                keys = np.where(by_hash[at] == keys, top | rank[at], keys)
                order = np.lexsort((keys, rows))
                rows, keys = rows[order], keys[order]
            starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            sizes = np.diff(np.r_[starts, len(rows)])
            place = np.arange(len(rows)) - np.repeat(starts, sizes)
            prefix = place < np.repeat(sizes - (3 * sizes + 3) // 4 + 1, sizes)
            rows, keys = rows[prefix], keys[prefix]
            bucket = (wordhash.mix(keys, 51) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, keys, bucket = rows[order], keys[order], bucket[order]
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            out = [], [], [], []
            for i, j in zip(cuts, np.r_[cuts[1:], len(bucket)]):
                used, local = np.unique(rows[i:j], return_inverse=True)
                for column, value in zip(out, (int(bucket[i]), marks[used].tobytes(), keys[i:j].tobytes(), local.astype("<u4" if len(used) > 65535 else "<u2").tobytes())):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "marks", "keys", "local"])

    def gather(batches):
        current, held = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if b != current and held:
                    yield from _blocks(held)
                    held = []
                current = b
                held.append(row)
        if held:
            yield from _blocks(held)

    rows = docs.select(text).mapInArrow(scatter, "bucket int, marks binary, keys binary, local binary")
    dealt = rows.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(gather, "block binary, mark binary, hub binary")


def _blocks(held):
    """The blocks of one bucket."""
    tables = [np.frombuffer(m, dtype="<u8").reshape(-1, 2) for m, _, _ in held]
    marks, place = np.unique(np.concatenate(tables), axis=0, return_inverse=True)
    place = place.ravel()
    ends = np.cumsum([len(t) for t in tables])
    keys, who = [], []
    for (_, k, local), table, end in zip(held, tables, ends):
        keys.append(np.frombuffer(k, dtype="<u8"))
        i = np.frombuffer(local, dtype="<u4" if len(table) > 65535 else "<u2").astype(np.int64)
        who.append(place[end - len(table) + i])
    keys, who = np.concatenate(keys), np.concatenate(who)
    order = np.argsort(keys, kind="stable")
    keys, who = keys[order], who[order]
    shared_ = np.zeros(len(keys), dtype=bool)
    same = keys[1:] == keys[:-1]
    shared_[1:] |= same
    shared_[:-1] |= same
    keys, who = keys[shared_], who[shared_]
    order = np.lexsort((who, keys))
    keys, who = keys[order], who[order]
    if len(keys) == 0:
        return
    new = np.r_[True, (keys[1:] != keys[:-1]) | (who[1:] != who[:-1])]
    keys, who = keys[new], who[new]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    # a block's name: two sums of its members' marks
    mixed = wordhash.mix(marks[:, 0], 61) ^ marks[:, 1]
    name = np.stack([np.add.reduceat(wordhash.mix(mixed[who], 62), starts), np.add.reduceat(wordhash.mix(mixed[who], 63), starts)], axis=1)
    known, out = set(), ([], [], [])
    for s, n, b in zip(starts, sizes, name):
        if n < 2 or (b := b.tobytes()) in known:
            continue
        known.add(b)
        members = [marks[w].tobytes() for w in who[s : s + n]]
        out[1].extend(members)
        out[0].extend([b if n <= BLOCK else None] * n)
        out[2].extend([None if n <= BLOCK else members[0]] * n)
        if len(out[0]) > 20000:
            yield _to_batch(out, ("block", "mark", "hub"))
            out = ([], [], [])
    if out[0]:
        yield _to_batch(out, ("block", "mark", "hub"))


def _to_batch(columns, names, kinds=None):
    kinds = kinds or [pa.binary()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


def _with_texts(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, added: str, make, carry: tuple[str, ...] = ()) -> DataFrame:
    """Texts of the classes' first documents, mapped by ``make(keys, n)``.

    ``classes`` has (mark, first), the id and text digest of a document of the
    class, and the ``carry`` columns.  A text is found by both, so rows that
    share an id don't meet; if digests collide, the set's mark tells.
    """
    kinds = dict(classes.dtypes)
    known = classes.select("mark", *carry, F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest"))
    rows = docs.select(F.col(doc_id).alias("_of"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"))
    texts = rows.join(known, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_digest"))).select("mark", *carry, "_text")
    schema = ", ".join(["mark binary", *(f"{c} {kinds[c]}" for c in carry), "n int", added])
    name = added.split()[0]

    def run(batches):
        for batch, part in _chunks(batches, len(carry) + 1):
            rows, keys, n, marks = _sets(part)
            starts = np.searchsorted(rows, np.arange(len(part) + 1))
            want = batch.column(0).to_pylist()
            keep = [i for i in range(len(part)) if marks[i].tobytes() == want[i]]
            made = [make(keys[starts[i] : starts[i + 1]], int(n[i])) for i in keep]
            columns = [c.take(pa.array(keep, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n[keep], pa.int32()), pa.array(made, pa.binary())], names=["mark", *carry, "n", name])

    return texts.mapInArrow(run, schema)


def _block_links(memberships: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b): spanning forests of the pairs that the R-tree lets pass in each block."""
    blocks = memberships.where("block is not null").join(vectors, "mark").groupBy("block").agg(F.collect_list(F.struct("mark", "n", "vector")).alias("m"))  # at most BLOCK classes

    def run(batches):
        edges = []
        for batch in batches:
            for i in range(batch.num_rows):
                if len(edges) > 200_000:
                    yield _to_batch(stars(edges), "ab")
                    edges = []
                members = batch.column(0)[i].values
                mark, n, vector = (members.field(k).to_pylist() for k in range(3))
                # a repeated id may bring a class in twice
                seen = {m: k for k, m in enumerate(mark)}
                use = sorted(seen.values(), key=lambda k: mark[k])
                if len(use) < 2:
                    continue
                sizes = np.array([n[k] for k in use], dtype=np.int64)
                found = T.links([T.unpack_vector(vector[k], n[k]) for k in use], sizes)
                edges += [(mark[use[a]], mark[use[b]]) for a, b in found]
        if edges:
            yield _to_batch(stars(edges), "ab")

    return blocks.select("m").mapInArrow(run, "a binary, b binary")


def _verify_groups(rows: DataFrame) -> DataFrame:
    """(a, b, large): each class's verified links inside its (cluster, tile), as stars from the least mark."""

    def solve(held):
        large = held[0][3]
        unique = {m: (n, s) for m, n, s, _ in held}
        marks = sorted(unique)
        sizes = np.array([unique[m][0] for m in marks], dtype=np.int64)
        sets = [np.frombuffer(unique[m][1], dtype="<u8") for m in marks]
        vectors = [T.count_vector(s, T.group_bits(len(s))) for s in sets]

        def check(i, j):
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return T.similar(common, len(sets[i]), len(sets[j]))

        found = T.links(vectors, sizes, check)
        if found:
            a, b = stars([(marks[i], marks[j]) for i, j in found])
            yield _to_batch((a, b, [large] * len(a)), ("a", "b", "large"), [pa.binary(), pa.binary(), pa.bool_()])

    def run(batches):
        current, held = None, []
        for batch in batches:
            for cluster, tile, mark, n, s, large in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, tile) != current and held:
                    yield from solve(held)
                    held = []
                current = cluster, tile
                held.append((mark, n, s, large))
        if held:
            yield from solve(held)

    dealt = rows.select("cluster", "tile", "mark", "n", "elements", "large").repartition("cluster", "tile").sortWithinPartitions("cluster", "tile")
    return dealt.mapInArrow(run, "a binary, b binary, large boolean")


def _hub_links(sets: DataFrame, hubs: DataFrame) -> DataFrame:
    """(a, b): verified links between hubs and the sets of their clusters' tiles.

    ``sets`` has each class's present ``root``; classes that are joined already
    aren't compared.  ``hubs`` (cluster, mark, part): each part of the hubs meets
    each tile of the cluster in one group, where the tile is indexed by an R-tree
    and the hubs stream past it.
    """
    columns = "mark", "n", "elements", "root"
    hub_rows = hubs.join(sets.select(*columns), "mark").join(sets.select("cluster", "tile").distinct(), "cluster")
    parts = hubs.select("cluster", "part").distinct()
    both = (
        sets.join(parts, "cluster").select("cluster", "tile", "part", F.lit(0).alias("kind"), *columns)
        .union(hub_rows.select("cluster", "tile", "part", F.lit(1), *columns))
        .repartition("cluster", "tile", "part").sortWithinPartitions("cluster", "tile", "part", "kind")
    )

    def run(batches):
        current, held, group = None, [], None
        for batch in batches:
            out = [], []
            for cluster, tile, part, kind, mark, n, s, root in zip(*(c.to_pylist() for c in batch.columns)):
                if (cluster, tile, part) != current:
                    current, held, group = (cluster, tile, part), [], None
                own = np.frombuffer(s, dtype="<u8")
                if kind == 0:
                    held.append((mark, own, root))
                    continue
                group = group or T.Group(held)
                for other in group.reach(own, root):
                    out[0].append(mark)
                    out[1].append(other)
            if out[0]:
                yield _to_batch(out, "ab")

    return both.mapInArrow(run, "a binary, b binary")


def _large_clusters(sets: DataFrame, links: DataFrame) -> DataFrame:
    """Links that join the tiles of large clusters: see step 3 above."""
    used = sets.sparkSession.createDataFrame([], "mark binary")
    limit, first = HUBS, True
    while True:
        roots = components(links).withColumnRenamed("node", "mark")
        sets_now = sets.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
        comp = shared.table(sets_now.select("cluster", "mark", "root"), "comp")
        size = comp.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"), F.min("mark").alias("least"))
        largest = size.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("largest"), F.sum("n").alias("all"))
        if first:  # one class of each component that is not below 1/HUBS of the cluster, so that most classes meet at once
            chosen = size.join(largest, "cluster").where(F.col("n") * HUBS >= F.col("all")).select("cluster", F.col("least").alias("mark"), F.lit(0).alias("part"))
        else:
            candidates = comp.join(largest, "cluster").where("root <> largest").select("cluster", "mark").join(used, "mark", "left_anti")
            open_ = candidates.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / limit).alias("shares"))
            hash_ = lambda k: F.xxhash64("mark", F.lit(k))
            chosen = candidates.join(open_, "cluster").where(F.pmod(hash_(1), F.col("shares")) == 0).select("cluster", "mark", F.pmod(hash_(2), F.lit(limit // HUBS)).cast("int").alias("part"))
        hubs = shared.table(chosen, "hubs")
        if not first and hubs.limit(1).count() == 0:
            return links
        links = shared.table(links.union(_hub_links(sets_now, hubs)), "links")
        used = shared.table(used.union(hubs.select("mark")), "used")
        if not first:
            limit *= 2
        first = False


def link_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(profiles, roots): ``profiles`` as above, with a number ``row``; ``roots`` (mark, root) of the classes that have a link."""
    profile = shared.table(profiles(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()), "profiles")
    elements = profile.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = int(max(12, min(elements // BUCKET, 1 << 20)))
    firsts = profile.where("mark is not null").groupBy("mark").agg(F.min(F.struct("doc_id", "digest")).alias("first"))
    memberships = shared.table(_memberships(docs, frequent_elements(docs, text), buckets, text).distinct(), "blocks")
    classes = firsts.join(memberships.select("mark").distinct(), "mark")
    vectors = shared.table(_with_texts(docs, classes, doc_id, text, "vector binary", lambda keys, n: T.pack_vector(T.count_vector(keys, T.group_bits(n)))), "vectors")
    stars = memberships.where("hub is not null").select(F.col("hub").alias("a"), F.col("mark").alias("b")).distinct()
    near = shared.table(_block_links(memberships, vectors).union(stars), "near")
    clusters = components(near).select(F.col("root").alias("cluster"), F.col("node").alias("mark"))
    counts = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    tiles = F.ceil(F.col("m") / TILE)
    placed = shared.attach_few(clusters, counts, "cluster", "mark").select("mark", "cluster", F.when(F.col("m") <= TILE, 0).otherwise(F.pmod(F.xxhash64("mark"), tiles)).cast("int").alias("tile"), (F.col("m") > TILE).alias("large"))
    sets = shared.table(_with_texts(docs, firsts.join(placed, "mark"), doc_id, text, "elements binary", lambda keys, n: keys.astype("<u8").tobytes(), ("cluster", "tile", "large")).dropDuplicates(["mark"]), "sets")
    links = shared.table(_verify_groups(sets), "links")
    # a whole cluster's stars are its components; tiles' stars are joined first
    roots = links.where("not large").select(F.col("b").alias("mark"), F.col("a").alias("root"))
    if sets.where("large").limit(1).count():
        joined = components(_large_clusters(sets.where("large"), links.where("large").select("a", "b")))
        roots = roots.union(joined.select(F.col("node").alias("mark"), "root"))
    return profile, roots


def _grouped(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, digest, n_shingles, component_id), one row for each row of ``docs``."""
    profile, roots = link_classes(docs, doc_id, text)
    by_mark = profile.where("mark is not null").groupBy("mark").agg(F.min("doc_id").alias("first_id"))
    rooted = by_mark.join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
    names = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = shared.attach(rooted, names, "root", "mark").select("mark", "component_id")
    alone = profile.where("mark is null").select("doc_id", "digest", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return shared.attach(profile.where("mark is not null"), named, "mark", "row").select("doc_id", "digest", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).union(alone)


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of ``docs``."""
    return _grouped(docs, doc_id, text).drop("digest")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that lead their group, with all their columns.

    Of rows that share id and text one stays; of rows that share an id with
    different texts, those stay whose own group the id leads; rows without a
    shingle all stay, but for repeats of id and text.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no name of the input can clash
    rows = docs.select(*(F.col(f"`{k}`").alias(v) for k, v in own.items()))
    leads = _grouped(docs, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "digest").distinct()
    same = rows[own[doc_id]].eqNullSafe(leads["doc_id"]) & (F.xxhash64(rows[own[text]]) == leads["digest"])
    kept = rows.join(leads, same).dropDuplicates(["doc_id", "digest"])
    return kept.select(*(F.col(v).alias(k) for k, v in own.items()))
