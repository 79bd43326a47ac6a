"""Mixing, licences, Jaccard join, embeddings, language model, pipeline:
edge cases and brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import components, counttree, itq, jaccard, kneser_ney, licenses, mixing, shared

LONG = " ".join(f"w{i}" for i in range(60000))


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, "one two three four five six", "a"), (2, None, "a"), (3, "", None), (4, " \n\t ", "b"), (5, LONG, "b"), (6, "One two THREE four five six", "c"), (6, "One two THREE four five six", "c"), (None, "one two three four five six", None), (7, "short text", "a"), (8, "short text", "a")]
    return spark.createDataFrame([(*r, 1, 2.0, "m", "d") for r in rows], "doc_id long, text string, source string, slot int, n double, mark string, digest string")


# --- components


def test_components_of_chains_and_loops(spark):
    rng = random.Random(2)
    chain = list(range(200))
    rng.shuffle(chain)
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(500, 501), (501, 500), (600, 600), (None, 3), (700, None)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(200)} == {0} and got[501] == got[500] == 500 and got[600] == 600
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- mixing


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 1}, {"a": 1}, None])
def test_mix_stays_within_a_block(spark, weights):
    sizes = {"a": 300, "b": 120, "c": 77, "d": 40}
    docs = spark.createDataFrame([(i, s) for s, n in sizes.items() for i in range(n)], "doc_id long, source string")
    rows = mixing.mix(docs, weights, alpha=0.5, parts=20).collect()
    assert len(rows) == sum(sizes.values()) and len({r.slot for r in rows}) == len(rows)
    if weights is None:
        total = sum(n**0.5 for n in sizes.values())
        weights = {s: max(1, round(20 * n**0.5 / total)) for s, n in sizes.items()}
    w = {s: weights.get(s, 1) for s in sizes}
    q, seen = sum(w.values()), Counter()
    inside = sorted((r for r in rows if r.in_mix), key=lambda r: r.slot)
    assert [r.slot for r in inside] == list(range(len(inside)))
    for t, r in enumerate(inside, 1):
        seen[r.source] += 1
        assert all(abs(seen[s] - t * w[s] / q) < 1 for s in w)
        assert r.release <= r.slot < r.due
    assert any(seen[s] == n for s, n in sizes.items())


def test_mix_edges(spark, edge):
    got = mixing.mix(edge, {"a": 2}, block_rows=2)
    rows = got.collect()
    assert len(rows) == 10 and got.columns[:6] == [c for c in edge.columns if c != "slot"]
    assert all(r.slot is not None for r in rows)
    assert mixing.mix(edge.limit(0), {"a": 2}).count() == 0 and mixing.mix(edge.limit(0)).count() == 0
    none = [r for r in mixing.mix(edge, {"a": 0}).collect() if r.source == "a"]
    assert none and all(r.slot is None and not r.in_mix for r in none)


# --- licences


def test_licences(spark, edge):
    mit = dict(licenses.KNOWN)["MIT"]
    texts = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace(",", " ,")), (2, "Some prose.\nReleased under the MIT Licence\nmore"), (3, mit + " extra"), (4, None), (5, ""), (6, "...")]
    known = licenses.known_licenses(spark)
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string"), known).collect()}
    assert got[1].license_id == "MIT" and got[2].notices == "MIT-notice" and got[2].license_id is None
    assert got[3].license_id is None and got[4].digest is None and got[5].digest is None and got[6].digest is None
    rows = licenses.scan(edge, known)
    assert rows.count() == 10 and licenses.scan(edge.limit(0), known).count() == 0
    assert known.count() == len(licenses.KNOWN)


def test_clauses_are_no_copyright_lines(spark):
    """Clauses and wrapped sentences stay; statements, typographic marks and spellings don't count."""
    text = "(c) You must keep this notice.\nThe owner of the\ncopyright grants a \u201clicence\u201d."
    known = licenses.known_licenses(spark, [("X", text)])
    assert known.first().digest
    texts = ["Copyright (c) 2001 A\n(C) you must keep this notice.\nThe owner of the copyright grants a 'license'", "The owner of the copyright grants a licence.", "(c) You must keep this notice.", "(c) 1999 A. Name\n" + text]
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).collect()}
    assert got == {0: "X", 1: None, 2: None, 3: "X"}


def test_long_holders_and_titles(spark):
    bsd = (licenses.TEXTS / "BSD-3-Clause.txt").read_text()
    named = bsd.replace("the University", "H" * 300 + " and Sons").replace("BY THE REGENTS AND", "BY " + "N" * 300 + " AND").replace("THE REGENTS OR", "O" * 200 + " OR")
    assert len(named) > len(bsd) + 700
    titled = "The " + "very " * 60 + "free license, in its third form " * 3 + "\n" + bsd
    docs = spark.createDataFrame([(1, named), (2, titled), (3, "Under this license one may\n" + bsd), (4, named + " and more")], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_licenses(spark), shipped=licenses.shipped_licenses(spark)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-3-Clause", 3: None, 4: None}


def test_shipped_licences_equal_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from barline.llm import queries_native

    rows = [(i, f.read_text()) for i, f in enumerate(sorted(licenses.TEXTS.glob("*.txt")))]
    rows += [(100 + i, "Some Licence\n\nCopyright (c) 1999 A\n" + t) for i, t in rows] + [(300, None), (301, ""), (302, "Released under the MIT License.\nx")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.license_id, r.digest, r.notices) for r in queries_native.op10_license_scan(spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = {tuple(r) for r in db.execute(f"SELECT doc_id, license_id, digest, notices FROM ({queries_native.OP10_SQL})").fetchall()}
    assert got == want and sum(r[1] is not None for r in got) > 20


def test_licences_as_shipped(spark):
    """Each whole text as its file, without its first line, and under another title and holder."""
    files = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    assert len(files) >= 20 and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "Unlicense", "MIT", "ISC"} <= set(files)
    texts = [(k, t) for k, t in files.items()] + [(k, t.replace("\n", "\r\n")) for k, t in files.items()]
    for k, titles in {"MIT": ["MIT License", "The MIT License (MIT)"], "ISC": ["ISC License"], "BSD-3-Clause": ["BSD 3-Clause License"], "BSD-2-Clause": ["BSD 2-Clause License"]}.items():
        body = files[k][re.search("Permission|Redistribution", files[k]).start() :]
        one = " ".join(body.split()).replace("University", "Example Corp")
        texts += [(k, body), *((k, f"{title}\n\nCopyright (c) 2021, A. Holder\nAll rights reserved.\n\n{x}") for title in titles for x in (body, one.replace(" 2. ", "\n* ").replace(" 1. ", "\n* ").replace(" 3. ", "\n* ")))]
    texts += [("Apache-2.0", files["Apache-2.0"].replace("[yyyy] [name of copyright owner]", "2020 Someone")), ("Apache-2.0", files["Apache-2.0"].partition("   APPENDIX")[0])]
    texts += [(None, files["MIT"] + "\nNo commercial use.\n"), (None, "Licensed under the Apache License, Version 2.0.\n" + files["MIT"]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.known_licenses(spark), shipped=licenses.shipped_licenses(spark)).collect()}
    assert [(k, got[i]) for i, (k, _) in enumerate(texts) if got[i] != k] == [] and len(got) == len(texts)


# --- Jaccard join


def _components(rows):
    """Brute force: id -> (set size, component)."""
    sets = []
    for i, t in rows:
        low = (t or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))).decode()
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())))
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for k in range(len(sets)):
        groups[find(k)].append(k)
    out = []
    for g in groups.values():
        ids = [sets[k][0] for k in g if sets[k][0] is not None]
        out += [(sets[k][0], len(sets[k][1]), min(ids) if ids else None) for k in g]
    return sorted(out, key=str)


def _corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    rows, base = [], []
    for i in range(n):
        kind = rng.random()
        if base and kind < 0.5:
            words = rng.choice(base).split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 5, 9, 40, 90])))
            base.append(text)
        if rng.random() < 0.3 and len(text.split()) > 20:
            text += " " + passage
        rows.append((i, text.upper() if rng.random() < 0.1 else text))
    return rows


@pytest.mark.parametrize("limits", [{}, {"TILE": 8, "BLOCK": 6, "HUBS": 4}])
def test_jaccard_against_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = _corpus(260, 4) + [(900, None), (901, ""), (902, " \n"), (903, LONG), (904, LONG + " end"), (905, "only four words here"), (906, "only FOUR words here")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == _components(rows)


def test_many_texts_under_one_id(spark):
    """Different texts that share an id, or have none, don't meet by it; their near copies are found all the same."""
    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(40)) for _ in range(400)]
    near = [t + " more" for t in texts[:50]]
    rows = [(7 if i % 2 else None, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(near)] + [(7, texts[1])] * 20
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows)
    linked = {r.doc_id: r.component_id for r in got if r.doc_id is not None and r.doc_id >= 100}
    assert linked == {100 + i: 7 if i % 2 else 100 + i for i in range(50)}
    plan = jaccard._with_texts(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(bytearray(b"m"), (7, 1))], "mark binary, first struct<doc_id: bigint, digest: bigint>"), "doc_id", "text", "vector binary", lambda k, n: b"")
    assert plan.count() == 0


def test_jaccard_edges(spark, edge):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(edge).collect()), key=str)
    assert got == sorted([(1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 59996, 5), (6, 2, 1), (6, 2, 1), (None, 2, 1), (7, 1, 7), (8, 1, 7)], key=str)
    assert jaccard.join(edge.limit(0)).count() == 0
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 7]
    twice = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, None)] * 2, "doc_id long, text string")
    assert sorted(r.doc_id for r in jaccard.keep_one(twice).collect()) == [1, 2]


def test_null_id_bridges_two_documents(spark):
    words = [f"q{i}" for i in range(60)]
    a, b, c = (" ".join(words[k : k + 48]) for k in (0, 6, 12))
    rows = [(1, a), (None, b), (None, b), (2, c), (3, "something else in five words")]
    want = _components(rows)
    assert (2, 44, 1) in want and (2, 44, 2) in _components([r for r in rows if r[0]])
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_bound_is_never_below_the_overlap():
    rng = np.random.default_rng(0)
    for _ in range(30):
        pool = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, 200)) for _ in range(2))
        for bits in (4, 6):
            bound = np.minimum(counttree.count_vector(a, bits), counttree.count_vector(b, bits)).sum()
            assert bound >= len(np.intersect1d(a, b))


# --- embeddings


def _cosine_components(rows, threshold=0.9):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v in good])
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    root = components.forest(len(good), *np.nonzero(linked))
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, good[k][0]), good[k][0])
    out = [(good[k][0], int(linked[k].sum()), least[root[k]]) for k in range(len(good))]
    have = {g[0] for g in good}
    return sorted(out + [(i, 0, i) for i, _ in rows if i not in have])


@pytest.mark.parametrize("tile", [512, 4])
def test_embeddings_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(itq, "TILE", tile)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    vectors = [list(map(float, b)) for b in base]
    for k in range(60):
        vectors.append([float(x) for x in base[k % 6] + rng.normal(scale=0.12, size=8)])
    vectors += [vectors[0], vectors[0], None, [0.0] * 8, [float("nan")] * 8, [1.0, None] * 4, [1.0, 2.0]]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame([(i, v, 1, 5) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    single = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = itq.near_duplicates(df).collect()
    want = _cosine_components(single)
    assert len(got) == len(rows)
    found, true = sum(r.n_links for r in got), sum(w[1] for w in want)
    assert 0.9 * true <= found <= true and all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert sum((r.vec_id, r.component_id) in {(w[0], w[2]) for w in want} for r in got) >= 0.9 * len(rows)


def test_recall_at_the_threshold(spark):
    """Pairs whose cosine is just above 0.9, the hardest ones."""
    rng = np.random.default_rng(6)
    a = rng.normal(size=(1500, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(0.902, 0.93, (1500, 1))
    b = c * a + np.sqrt(1 - c * c) * o
    rows = [(i, list(map(float, v))) for i, v in enumerate(np.concatenate([a, b]))]
    got = itq.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sum(r.n_links for r in got) >= 0.9 * 3000


def _pairs_at(a, rng, low=0.9005, high=0.905):
    a = a / np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.normal(size=a.shape)
    o -= (o * a).sum(axis=1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    c = rng.uniform(low, high, (len(a), 1))
    return np.concatenate([a, c * a + np.sqrt(1 - c * c) * o])


@pytest.mark.parametrize("kind", ["offset", "hot"])
def test_tables_find_pairs_off_the_origin(kind):
    """Recall of the tables at the threshold, with a common offset and beside a hot group."""
    rng = np.random.default_rng(9)
    n, d = 3000, 64
    a = rng.normal(size=(n, d)) / math.sqrt(d)
    if kind == "offset":
        a += np.eye(d)[0]  # the mean of unit vectors has norm 0.7
    else:
        a[: n // 3] = np.eye(d)[0] + 0.6 * a[: n // 3]
    x = _pairs_at(a, rng)
    sample = x[rng.permutation(len(x))[:2000]]
    tables, width, most, centre = itq.plan(sample, 10_000_000, 0.9)
    bits = itq.Quantiser(sample, tables, width, centre=centre).bits(x)
    apart = bits[:n] != bits[n:]
    met = (apart.reshape(n, tables, width).sum(axis=2) <= 1).any(axis=1) & (apart.sum(axis=1) <= most)
    print(f"{kind}: recall {met.mean():.3f}, of the first third {met[: n // 3].mean():.3f}, {tables} tables of {width} bits, centred {centre}")
    assert min(met.mean(), met[: n // 3].mean()) >= 0.93


def test_tables_meet_within_one_bit(monkeypatch):
    """Codes meet exactly where a table's values differ in one bit at most."""
    rng = np.random.default_rng(2)
    n, tables, width = 120, 3, 8
    bits = rng.integers(0, 2, (n, tables * width)).astype(bool)

    class Model:
        pass

    model = Model()
    model.tables, model.width, model.bits = tables, width, lambda v: bits
    marks = [int(i).to_bytes(16, "little") for i in range(n)]
    batch = itq.pa.RecordBatch.from_arrays([itq.pa.array(marks, itq.pa.binary()), itq.pa.array([[0.0]] * n)], names=["mark", "v"])
    monkeypatch.setattr(itq, "CLOSE", -1)
    packed = list(itq._scatter(model, 5)([batch]))
    met = set()
    monkeypatch.setattr(itq, "_hamming", lambda codes, a, b: met.update(zip(map(int, codes[a, 0]), map(int, codes[b, 0]))) or np.full(len(a), 99))
    for rows in packed:
        order = rows.sort_by("bucket") if hasattr(rows, "sort_by") else rows
        list(itq._gather(1, 5)([order]))
    codes = np.pad(np.packbits(bits, axis=1), ((0, 0), (0, 5))).view("<u8")[:, 0].tolist()
    apart = (bits[:, None] ^ bits[None]).reshape(n, n, tables, width).sum(axis=3)
    want = {frozenset((codes[i], codes[j])) for i in range(n) for j in range(i) if (apart[i, j] <= 1).any()}
    assert {frozenset(p) for p in met} == want and len(want) > 50


def test_long_runs_are_tied_in_linear_work(monkeypatch):
    """Every pair within the bound shares a component, and near copies take one leader."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (5, 512))
    bits = np.concatenate([base[rng.integers(0, 5, 1500)], rng.integers(0, 2, (300, 512))]) ^ (rng.random((1800, 512)) < 0.03)
    codes = np.packbits(bits.astype(bool), axis=1).view("<u8")
    for leaders in (64, 3):
        monkeypatch.setattr(itq, "LEADERS", leaders)
        ties = list(itq._canopies(codes, np.arange(1800), 40))
        root = components.forest(1800, np.concatenate([np.full(len(o), k) for k, o in ties]), np.concatenate([o for _, o in ties]))
        i, j = np.triu_indices(1800, 1)
        near = itq._hamming(codes, i, j) <= 40
        assert near.sum() > 10_000 and (root[i[near]] == root[j[near]]).all()
        assert len(ties) <= leaders + 1
    one = list(itq._canopies(codes, np.flatnonzero((bits[:1500] ^ base[0]).sum(axis=1) < 60), 70))
    assert len(one) == 1


def test_embedding_edges(spark):
    schema = "vec_id long, embedding array<float>"
    assert itq.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    one = itq.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0])] * 2 + [(None, [0.0, 1.0])], schema)).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id) for r in one) == [("3", 1, 3), ("3", 1, 3), ("None", 0, None)]


def test_vectors_of_any_length_and_size(spark):
    """Links inside each length, whatever the magnitudes; brute force over whole vectors."""
    rng = np.random.default_rng(4)
    vectors = []
    for d, n in ((3, 50), (5, 60), (4, 8), (2, 1)):
        base = rng.normal(size=(4, d))
        vectors += [[float(x) for x in base[k % 4] + rng.normal(scale=0.1, size=d)] for k in range(n)]
    vectors = [[x * 10.0 ** (0, 160, -160, -300, 300)[k % 5] for x in v] for k, v in enumerate(vectors)]
    vectors += [[5e-324, 0.0, 0.0], [1e308, 0.0, 0.0], [0.0, 0.0, 0.0], [], None, [float("inf"), 1.0, 2.0], [None, 1.0, 2.0]]
    got = {r.vec_id: (r.n_links, r.component_id) for r in itq.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")).collect()}
    usable = {k: np.array(v) / max(map(abs, v)) for k, v in enumerate(vectors) if v and None not in v and all(map(math.isfinite, v)) and any(v)}
    links = {k: [j for j, w in usable.items() if j != k and len(w) == len(v) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.9] for k, v in usable.items()}
    for k in range(len(vectors)):
        seen, new = {k}, [k]
        while new:
            new = [j for i in new for j in links.get(i, []) if j not in seen]
            seen.update(new)
        assert got[k] == (len(links.get(k, [])), min(seen)), k


# --- language model


def _model_rows():
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(6000)]
    rows, at = [], 0
    for i in range(120):
        n = rng.randint(0, 60)
        rows.append((i, i % 5 != 0, " ".join(words[at : at + n]) if n else None))
        at += n
    return rows + [(200, True, LONG[:3000]), (201, None, "W1 w2 NEW"), (202, False, ""), (203, True, "rep rep"), (203, True, "rep rep")]


def _plain_model(rows, order):
    """(probability of a token after its context, tokens with contexts by row, counts of words), in plain Python."""
    texts = [["<s>"] * (order - 1) + (t or "").lower().split() + ["</s>"] for _, _, t in rows]
    grams = [[tuple(t[i : i + order]) for i in range(len(t) - order + 1)] for t in texts]
    counts = {order: Counter(g for (_, f, _), gs in zip(rows, grams) if f is not False for g in gs)}
    one = Counter()
    for g, c in counts[order].items():
        one[g[-1]] += c
    for k in range(order - 1, 0, -1):
        lower = Counter()
        for g, c in counts[k + 1].items():
            lower[g[1:]] += c if k > 1 and g[1] == "<s>" else 1
        counts[k] = lower
    discounts = {k: kneser_ney._discounts(*(sum(v == i for v in x.values()) for i in (1, 2, 3, 4))) for k, x in counts.items()}
    after = defaultdict(lambda: [0, 0, 0, 0])
    for x in counts.values():
        for g, c in x.items():
            after[g[:-1], len(g)][0] += c
            after[g[:-1], len(g)][min(c, 3)] += 1

    def p(g):
        if not g:
            return 1 / (len(one) + 1)
        if (g[:-1], len(g)) not in after:
            return p(g[1:])
        x, c, d = after[g[:-1], len(g)], counts[len(g)].get(g, 0), discounts[len(g)]
        return (max(c - d[min(c, 3)], 0) + sum(d[i] * x[i] for i in (1, 2, 3)) * p(g[1:])) / x[0]

    return p, grams, one


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_against_brute_force(spark, order, monkeypatch):
    rows = _model_rows()
    monkeypatch.setattr(kneser_ney, "PART", 300)  # several parts in each bucket
    got = kneser_ney.score(spark.createDataFrame(rows, "doc_id long, train boolean, text string").repartition(3), "train", order=order).collect()
    p, grams, one = _plain_model(rows, order)
    total, kinds = sum(one.values()), len(one)
    for context in (("w1",) * (order - 1), ("<s>",) * (order - 1), ("never",) * (order - 1)):
        assert abs(sum(p((*context, w)) for w in one) + p((*context, "<new>")) - 1) < 1e-9
    want = sorted((i, len(t), sum(one[g[-1]] > 0 for g in t), total, round(sum(math.log10((one[g[-1]] + 1) / (total + kinds + 1)) for g in t), 6), round(sum(math.log10(p(g)) for g in t), 6)) for (i, _, _), t in zip(rows, grams))
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)
    shards = kneser_ney.model(spark.createDataFrame(rows, "doc_id long, train boolean, text string"), "train", order=order).collect()
    assert sum(len(s.hashes) // 8 for s in shards) == len({g for t in grams for g in t})
    for s in shards:
        h = np.frombuffer(s.hashes, dtype="<u8")
        assert (np.diff(h.astype(object)) > 0).all() and len(s.log10p) * 2 == len(s.hashes)


def test_language_model_edges(spark, edge):
    flagged = edge.withColumn("train", F.col("doc_id") != 7)
    rows = kneser_ney.score(flagged, "train").collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (2, 3, 4)} == {1}
    assert kneser_ney.score(flagged.limit(0), "train").count() == 0
    unseen = kneser_ney.score(edge.withColumn("train", F.lit(False)), "train").collect()
    assert len(unseen) == 10 and all(r.train_tokens == 0 for r in unseen)


def test_counts_over_a_byte_are_split():
    place, value = kneser_ney._split(np.array([1, 255, 256, 600]))
    assert np.bincount(place, weights=value).tolist() == [1, 255, 256, 600] and value.max() <= 255


# --- pipeline


def test_pipeline_against_brute_force(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from barline.llm import toxicity

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    clean = [r for r in docs.collect() if scores[r.doc_id] < pipeline.TOXIC]
    leads = {i for i, _, c in _components([(r.doc_id, r.text) for r in clean]) if i == c}
    left = [r for r in clean if r.doc_id in leads]
    stage = spark.createDataFrame([], docs.schema)
    one = pipeline.drop_toxic(spark, docs, sf)
    two = pipeline.drop_near_duplicates(spark, shared.table(one, "one"), sf)
    stage = shared.table(two, "two")
    assert sorted(r.doc_id for r in one.collect()) == sorted(r.doc_id for r in clean)
    assert stage.columns == docs.columns and sorted(r.doc_id for r in stage.collect()) == sorted(r.doc_id for r in left)
    mixed = pipeline.mix_sources(spark, stage, sf)
    n = Counter(r.source for r in left)
    total = sum(v**0.7 for v in n.values())
    weight = {s: max(1, math.floor(100 * v**0.7 / total + 0.5)) for s, v in n.items()}
    taken = Counter(r.source for r in mixed.collect() if r.in_mix)  # the shares hold until a source has run out
    q, size = sum(weight.values()), sum(taken.values())
    assert any(taken[s] == n[s] for s in n) and all(abs(taken[s] - size * weight[s] / q) < 1 for s in n)
    whole = pipeline.run(spark, sf)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in left)  # and no row goes
    assert sorted(r.doc_id for r in whole.collect()) == sorted(r.doc_id for r in left)


def test_mixing_stage_keeps_all_rows_beside_a_source_of_one(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sizes = {"big": 700, "mid": 90, None: 1}
    docs = spark.createDataFrame([(i, f"text {i} {s}", "en", s, 1) for s, n in sizes.items() for i in range(1000 * len(str(s)), 1000 * len(str(s)) + n)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = pipeline.mix_sources(spark, docs, "")
    rows = mixed.collect()
    assert Counter(r.source for r in rows) == sizes and len({r.slot for r in rows}) == len(rows)
    assert 0 < sum(r.in_mix for r in rows) < len(rows)
    # a prefix of the order after the single row has run out: the others in proportion to their weights
    head = Counter(r.source for r in sorted(rows, key=lambda r: r.slot)[:300])
    total = 700**0.7 + 90**0.7 + 1
    assert head[None] == 1 and abs(head["mid"] / head["big"] - round(100 * 90**0.7 / total) / round(100 * 700**0.7 / total)) < 0.02
    coded = pipeline.encode(spark, mixed, "").collect()
    assert {(r.doc_id, r.slot, r.in_mix) for r in coded} == {(r.doc_id, r.slot, r.in_mix) for r in rows} and len(coded) == len(rows)


def test_stages_keep_columns_of_any_name(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["block", "due", "_md5", "_prefix", "_in", "_lead", "_rows", "_text", "c0", "digest", "mark", "_salt"]
    docs = spark.createDataFrame([(i, f"some words of text {i % 3} here", "en", "a", 9, *(f"{n}{i}" for n in names)) for i in range(6)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    one = pipeline.drop_near_duplicates(spark, docs, "")
    assert one.columns == docs.columns and sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in docs.collect() if r.doc_id < 3)
    mixed = pipeline.mix_sources(spark, docs, "")
    assert mixed.columns == [*docs.columns, "slot", "in_mix"] and sorted(tuple(r) for r in mixed.drop("slot", "in_mix").collect()) == sorted(tuple(r) for r in docs.collect())


def test_keep_one_of_rows_that_share_an_id(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, b), (5, a), (5, a), (5, b), (6, a), (7, ""), (7, ""), (7, None), (None, b)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", b), ("5", a), ("7", ""), ("7", "None")]


def test_pipeline_stages_on_edges(spark, edge):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = edge.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    for rows in (docs, docs.limit(0)):
        for name, stage in pipeline.STAGES:
            rows = shared.table(stage(spark, rows, sf), name)
        assert "n_tokens" in rows.columns


def test_crc_matches_python(spark):
    assert spark.range(50).where(F.crc32(F.col("id").cast("string").cast("binary")) % 7 == 2).count() == sum(zlib.crc32(str(i).encode()) % 7 == 2 for i in range(50))
