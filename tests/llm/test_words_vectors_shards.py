"""Resharding, hard negatives and spelling variants: edge cases and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import errata, pivots, queries_words, reshard

# --- resharding


def _least_moved(sizes, capacities):
    """Bytes moved by a minimum-cost flow, by shortest augmenting paths over old and new shards."""
    n, m = len(sizes), len(capacities)
    nodes, left, cost = n + m + 2, defaultdict(int), {}
    for i in range(n):
        left[0, 1 + i], cost[0, 1 + i], cost[1 + i, 0] = sizes[i], 0, 0
        for j in range(m):
            left[1 + i, 1 + n + j] = sizes[i]
            cost[1 + i, 1 + n + j], cost[1 + n + j, 1 + i] = int(i != j), -int(i != j)
    for j in range(m):
        left[1 + n + j, nodes - 1], cost[1 + n + j, nodes - 1], cost[nodes - 1, 1 + n + j] = capacities[j], 0, 0
    total = 0
    while True:
        far, back = {0: 0}, {}
        for _ in range(nodes):
            for (u, v), c in cost.items():
                if u in far and left[u, v] > 0 and far[u] + c < far.get(v, 1e9):
                    far[v], back[v] = far[u] + c, u
        if nodes - 1 not in far:
            return total
        path, v = [], nodes - 1
        while v:
            path.append((back[v], v))
            v = back[v]
        push = min(left[e] for e in path)
        total += push * far[nodes - 1]
        for u, v in path:
            left[u, v] -= push
            left[v, u] += push


@pytest.mark.parametrize("seed", range(6))
def test_transfers_move_the_fewest_bytes(spark, seed):
    rng = random.Random(seed)
    n, m = rng.randint(1, 6), rng.randint(1, 6)
    sizes = [rng.choice([0, rng.randint(1, 50)]) for _ in range(n)]
    sizes[0] += 1
    cuts = sorted(rng.randint(0, sum(sizes)) for _ in range(m - 1))
    capacities = [b - a for a, b in zip([0, *cuts], [*cuts, sum(sizes)])]
    spans = reshard.transfers(spark.createDataFrame(list(enumerate(sizes)), "shard int, bytes long"), spark.createDataFrame(list(enumerate(capacities)), "shard int, capacity long")).collect()
    assert sum(r.end - r.start for r in spans if r.old != r.new) == _least_moved(sizes, capacities)
    for i, size in enumerate(sizes):  # each old shard is covered once
        mine = sorted((r.start, r.end) for r in spans if r.old == i)
        assert [a for a, _ in mine] == [0, *(b for _, b in mine)][: len(mine)] and (mine[-1][1] if mine else 0) == size
    for j, room in enumerate(capacities):
        assert sum(r.end - r.start for r in spans if r.new == j) == room
    assert len(spans) <= 2 * (n + m)


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, old int, _shard string, size int").repartition(3)


def test_reshard_edges(spark):
    long = "é" * 3000
    rows = [(i, "x" * (i * 37 % 900), 0, "s", 1) for i in range(300)] + [(5000 + i, "y" * 50, 1, None, None) for i in range(40)] + [(None, "no id", 2, None, 1), (7, None, 2, None, 1), (8, "", 2, None, 1), (9, long, 2, None, 1)]
    rows += [(77, "same text", 0, "s", 1)] * 400  # one row, many times
    old = reshard.lay_out(_docs(spark, rows), F.col("old"))
    new, spans = reshard.reshard(old, reshard.equal_capacities(old.sizes(), 4))
    got = reshard.slots(new).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert set(shards) == {0, 1, 2, 3}
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    even = sum(n * k[1] for k, n in want.items()) / 4
    assert all(abs(sum(r.size for r in s) - even) <= 2 * 6001 for s in shards.values())
    assert all(abs(sum(r.size for r in shards[j]) - even) <= 1000 for j in (0, 1, 3))  # the longest text is in shard 2
    # a shard that only gains keeps its files
    kept = {s for path, held in new.folders for s in held if path == old.folders[0][0]}
    assert kept == {r.old for r in spans.collect()} - {r.old for r in spans.collect() if r.old != r.new}
    assert set(new.read().columns) >= {"doc_id", "text", "old", "size"}


def test_reshard_hot_row_is_cut(spark):
    old = reshard.lay_out(_docs(spark, [(1, "abc", 0, None, 1)] * 1000), F.col("old"))
    new, _ = reshard.reshard(old, reshard.equal_capacities(old.sizes(), 8))
    assert sorted(r.n for r in reshard.slots(new).groupBy("shard").agg(F.count("*").alias("n")).collect()) == [125] * 8
    again, _ = reshard.reshard(new, reshard.equal_capacities(new.sizes(), 8))
    assert again == new  # nothing to move, nothing is written
    fewer, _ = reshard.reshard(new, reshard.equal_capacities(new.sizes(), 3))
    assert {r.shard for r in fewer.sizes().collect()} == {0, 1, 2} and fewer.read().count() == 1000


def test_reshard_nothing(spark):
    old = reshard.lay_out(_docs(spark, []), F.col("old"))
    new, spans = reshard.reshard(old, reshard.equal_capacities(old.sizes(), 8))
    assert spans.count() == 0 and reshard.slots(new).count() == 0


# --- hard negatives


def _brute(rows, positives=5, negatives=3):
    out = []
    fit = [(u, i, y, v) for u, (i, y, v, _) in enumerate(rows) if y is not None and v is not None and None not in v and sum(x * x for x in v) < 2**62]
    by_id = lambda r: (-r[0], r[1] is None, r[1] or 0, r[2])
    for u, i, y, v in fit:
        if not rows[u][3]:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, t, z) for t, j, z, w in fit if t != u and len(w) == len(v)]
        for p in sorted((r for r in scored if r[3] == y), key=by_id)[:positives]:
            band = sorted((r for r in scored if r[3] != y and 50 * p[0] <= 100 * r[0] <= 95 * p[0]), key=by_id)[:negatives]
            out += [(i, p[1], k, r[1], p[0], r[0]) for k, r in enumerate(band, 1)]
    return Counter(out)


def _vectors(kind, rng):
    n, d = 260, 6
    rows = []
    for i in range(n):
        if kind == "random":
            v = [rng.randint(-200, 200) for _ in range(d)]
        elif kind == "ties":
            v = [rng.randint(0, 2) for _ in range(d)]
        elif kind == "clusters":
            v = [100 * (i % 4 == k) + rng.randint(-9, 9) + 60 for k in range(d)]
        else:  # large
            v = [rng.randint(-(2**29), 2**29) for _ in range(d)]
        rows.append((i // 2 if kind == "ties" and i < 40 else i, rng.choice([0, 0, 0, 1, 2]), v, i % 7 == 0))
    return rows


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "large"])
def test_hard_negatives_against_brute_force(spark, kind):
    rows = _vectors(kind, random.Random(5))
    rows += [(None, 1, [1] * 6, True), (900, None, [1] * 6, True), (901, 1, None, True), (902, 1, [1, None, 1, 1, 1, 1], True), (903, 1, [2, 3], True), (904, 1, [2, 4], None), (905, 2, [2, 3], False), (906, 2, [], True), (907, 1, [2**31] * 6, True), (908, 0, [0] * 6, True)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "id long, label int, vector array<long>, anchor boolean, n2 int, block string").repartition(3)
    got = pivots.hard_negatives(df)
    assert Counter(map(tuple, got.collect())) == _brute(rows)


def test_hard_negatives_of_one_label_and_none(spark):
    schema = "id long, label int, vector array<long>, anchor boolean"
    assert pivots.hard_negatives(spark.createDataFrame([(i, 1, [i, 1], True) for i in range(5)], schema)).count() == 0
    assert pivots.hard_negatives(spark.createDataFrame([], schema)).count() == 0


def test_brackets_rule_most_rows_out():
    """Far clusters are passed over without an inner product."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-5, 5, (2000, 8)) + 1000 * np.eye(8, dtype=int)[k] for k in range(8)])
    m2 = float((x**2).sum(axis=1).max())
    rest = np.sqrt(m2 - (x**2).sum(axis=1))
    p = pivots.choose_pivots(x[::50].astype(float), m2)
    full = lambda v, last: np.column_stack([v, last])
    dx, q = pivots._distances(full(x, rest), p), x[:1]
    dq, seen = pivots._distances(full(q, np.zeros(1)), p), []
    allowed = lambda a, r: seen.append(len(r)) or np.ones((len(a), len(r)), dtype=bool)
    low, high = np.array([[-(2**62)]]), np.array([[2**62]])
    ask, score, row = pivots.search(x, q, dx, dq, m2, allowed, low, high, np.arange(len(x)), 3)
    assert list(score) == sorted((int(s) for s in x @ q[0]), reverse=True)[:3]
    assert sum(seen) < len(x) / 4


# --- spelling variants


def _near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def _variants(counts):
    near = {w: [x for x in counts if _near(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    root = lambda w: w if form[w] is None else root(form[w])
    return {w: (form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None) for w in counts}


@pytest.mark.parametrize("alphabet", ["ab", "abcdé", "a"])
def test_variants_against_brute_force(spark, alphabet):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(300)} | {"kangaroo", "kangarooo", "kangaro", "angaroo", "kangaroos", "zkangaroo"}
    words |= {"b" * k for k in (63, 64, 65, 127, 128)} | {"ab" * 40 + x for x in ("", "c", "d", "cd")} | {"ab" * 31 + x for x in ("a", "ab", "ac", "bb", "aba")}
    counts = {w: rng.choice([1, 2, 5, 30, 200, 1500, 9000]) for w in words}
    rows = [(w, n) for w, n in counts.items()] + [("", 3), (None, 2)]
    split = [(w, 1) for w in list(counts)[:20]]  # repeated rows add up
    for w, _ in split:
        counts[w] += 1
    got = errata.variants(spark.createDataFrame([(*r, 1) for r in rows + split], "word string, n long, heavy int"))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()} == _variants(counts)


def test_pairs_come_up_once(spark):
    words = spark.createDataFrame([(w, 1) for w in ("aaa", "aa", "aaaa", "aab", "aba", "baa", "ab", "b", "a")], "word string, n long")
    pairs = Counter(frozenset((r.word, r.x)) for r in errata.one_edit(words).collect())
    assert set(pairs.values()) == {1}
    assert errata.variants(words.limit(0)).count() == 0


def test_long_words(spark):
    base = "lorem" * 30_000
    rows = [(base, 100), (base + "x", 10), (base[:70_000] + "q" + base[70_000:], 9), (base[1:], 8), ("z" + base[1:], 7), (base[:-1] + "z", 600)]
    got = {r.word: r for r in errata.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got[base].n_near == 5 and got[base].form == base[:-1] + "z" and got[base + "x"].root == base[:-1] + "z" and got[base[1:]].n_near == 2


def test_words_of_texts(spark):
    long = "Straße " * 4 + "x" * 200_000 + " Éclairs"
    rows = [(1, "Hello HELLO hellO, don't ÉCOLE9école", 1), (2, None, 1), (3, "", 1), (None, long, 1), (4, long, 1), (4, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word int")
    got = {r.word: r.n for r in errata.count_words(docs, least_length=5, least_n=2).collect()}
    assert got == {"hello": 3, "straße": 12, "x" * 200_000: 3, "Éclairs": 3}
    want = Counter()
    for doc, text, _ in rows:
        for run in __import__("re").findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            at = h % len(run)
            want[run[:at] + run[at + 1 :] if h % queries_words.ODD == 0 else run] += 1
    assert {r.word: r.n for r in errata.count_words(docs, queries_words.noise, 1, 1).collect()} == {w: n for w, n in want.items() if w}
