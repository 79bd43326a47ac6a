"""Toxicity, tokens, archives, media: edge cases, exact round trips, brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barline.llm import arc, bpe, media, shared, tokens, toxicity, wordhash
from barline.llm.queries_map import tokenizer_file

LONG = "a very long text. " * 20000
EDGE = [(1, "You idiot. Fine day.", "x"), (2, None, "x"), (3, "", None), (4, " \n\t ", "y"), (5, LONG, "y"), (6, "same words here", "z"), (6, "same words here", "z"), (None, "no id at all", None)]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty, blank and long texts, repeated rows, and columns named like outputs."""
    return spark.createDataFrame([(*r, 1.5, 7, "q") for r in EDGE], "doc_id long, text string, source string, score double, n_tokens long, feature string")


def test_words_and_slices():
    texts = ["Hello  WORLD hello", None, "", "x\x0by\nz", "ß ẞ", "tail"] * 400
    a = pa.array(texts, pa.large_string())
    rows, hashes = wordhash.words(a)
    want = [w for t in texts for w in (t or "").replace("\x0b", " ").replace("\n", " ").split(" ") if w]
    assert len(hashes) == len(want)
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    names = [w.encode().translate(low) for w in want]
    assert len({(n, h) for n, h in zip(names, hashes)}) == len(set(names)) == len(set(hashes.tolist()))
    parts = [(at + r, h) for at, p in wordhash.slices(a, 100) for r, h in [wordhash.words(p)]]
    assert np.array_equal(np.concatenate([p[0] for p in parts]), rows) and np.array_equal(np.concatenate([p[1] for p in parts]), hashes)


def test_large_slices_agree():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["ab", "c.", "Döner", "x!"]) for _ in range(30000)) for _ in range(40)]
    a = pa.array(texts, pa.large_string())
    whole = wordhash.words(a, wordhash.NOT_ALNUM, (4,))
    one = [wordhash.words(a.slice(i, 1), wordhash.NOT_ALNUM, (4,)) for i in range(40)]
    assert np.array_equal(whole[1], np.concatenate([o[1] for o in one]))
    cuts = lambda s: np.flatnonzero(np.diff(s))
    for i in (0, 7, 39):
        assert np.array_equal(cuts(whole[2][whole[0] == i]), cuts(one[i][2]))


def test_toxicity_learns_and_locates(spark, edge):
    rng = random.Random(1)
    filler = ["the", "sun", "rose", "over", "hills", "and", "rivers", "today"]
    say = lambda bad: ". ".join(" ".join(rng.choice(filler) for _ in range(6)) + (" idiot" if bad and k % 2 else "") for k in range(4)) + "."
    docs = spark.createDataFrame([(i, say(i % 4 == 0)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [(scored[i], i % 4 == 0) for i in range(300, 400)]
    assert min(s for s, bad in held if bad) > 0.7 > max(s for s, bad in held if not bad)
    got = toxicity.offending_sentences(docs.where("doc_id = 300"), model).collect()
    assert got and all("idiot" in r.sentence for r in got)
    rows = toxicity.score(edge, model).collect()
    assert len(rows) == len(EDGE) and all(0 <= r.score <= 1 for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[2] == by_id[3] == by_id[4] == 0.0 and by_id[1] > 0.5
    assert toxicity.score(edge.limit(0), model).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert toxicity.score(docs, nothing).agg(F.max("score")).first()[0] < 0.01


@pytest.fixture(scope="module")
def libraries():
    tokenizers = pytest.importorskip("tokenizers")
    return {k: (tokenizer_file(k), tokenizers.Tokenizer.from_file(tokenizer_file(k))) for k in ("word_bpe_49k.json", "byte_bpe_50k.json")}


ALPHABET = list("aabeheinorst  \n\t.,!?'0123$%ÄßéΣσςİ\x0b\x1c\x85  ²Ⅳ中🙂ﬁ") + ["<|endoftext|>", "<|startoftext|>", "<|", "'re", "'ll", "the ", "ing", "   ", "\r\n"]


def _texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)] + ["", "a" * 3000, "ab" * 999, " " * 999, "\n" * 500 + "x", "!" * 999]


def test_ids_agree_with_the_library(libraries):
    file, lib = libraries["word_bpe_49k.json"]
    coder = bpe.word_coder(file)
    for t in _texts(1500, 2):
        want = lib.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(coder.encode(t), dtype="<u4")
        assert ids.tolist() == want
        assert coder.vocabulary.decode(ids).decode() == lib.decode(want, skip_special_tokens=False)


def test_counts_agree_at_every_prefix(libraries):
    file, lib = libraries["byte_bpe_50k.json"]
    counter = bpe.byte_counter(file)
    for k, t in enumerate(_texts(700, 3)):
        assert counter.count(t) == len(lib.encode(t, add_special_tokens=False).ids)
        if k < 150:
            got = counter.prefixes(t)
            assert got.tolist() == [len(e.ids) for e in lib.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)]
            for limit in (0, 1, 5):
                assert counter.measure(t, limit) == (got[-1], int(np.flatnonzero(got <= limit)[-1]))


def test_token_columns(spark, edge, libraries):
    word, byte = libraries["word_bpe_49k.json"], libraries["byte_bpe_50k.json"]
    rows = tokens.encoding_digests(edge, word[0]).collect()
    want = sorted((str(i), len(word[1].encode(t or "", add_special_tokens=False).ids)) for i, t, _ in EDGE)
    assert sorted((str(r.doc_id), r.n_tokens) for r in rows) == want
    assert {r.ids_sha256 for r in rows if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    counts = tokens.token_counts(edge, byte[0]).collect()
    assert len(counts) == len(EDGE) and all(r.over_limit == (r.n_tokens > 1024) for r in counts)
    table = tokens.prefix_table(edge.where("doc_id = 1"), byte[0]).select(tokens.tokens_at("counts", F.lit(9)).alias("n")).first().n
    assert table == len(byte[1].encode(EDGE[0][1][:9], add_special_tokens=False).ids)
    back = edge.where("doc_id = 6").select(tokens.decode(tokens.encode("text", word[0]), word[0]).alias("t")).first().t
    assert back == "same</w> words</w> here</w>"
    assert tokens.encoding_digests(edge.limit(0), word[0]).count() == tokens.token_counts(edge.limit(0), byte[0]).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archives_round_trip(spark, version):
    big = "<p>" + "x" * 300000 + "</p>"
    rows = [(1, "http://a/ b?q=ü", "<p>é\r\n\r\nWARC/1.1 trap</p>" * 9), (2, None, None), (3, "", ""), (4, "http://c", big), (5, "http://d", big), (5, "http://d", big), (6, "u", "short"), (7, "u", "short"), (None, "n", big)]
    pages = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, record_type string, key int").drop("key")
    archives = arc.pages_to_arc(pages, version=version)
    path = shared.place(spark, "warc")
    arc.write_warc(arc.mark_revisits(arc.convert(archives)), path, per_file=3)
    got = ((str(r.key), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in arc.read_warc(spark, path).collect())
    want = []
    for k, _, h in rows:
        data = (h or "").encode()
        again = h == big and k != 4
        want.append((str(k), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 4 if again else None))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert arc.convert(arc.pages_to_arc(pages.limit(0))).count() == 0


def test_archive_headers_are_checked():
    data = arc.arc_header("n.arc", 1, "2001") + arc.arc_record("http://x", b"HTTP/1.0 200 OK\r\n\r\nhi", 1, "20010203", 0, "n.arc")
    fields, block = next(arc.parse_arc(data))
    assert fields["Archive-date"] == "20010203" and block.endswith(b"hi")
    assert arc._iso("20010203") == "2001-02-03T00:00:00Z"
    with pytest.raises(ValueError):
        list(arc.parse_arc(data[:-1]))
    with pytest.raises(ValueError):
        list(arc.parse_arc(data.replace(b" text/html ", b" ").replace(b"http://x 127.0.0.1", b"http://x")))


def _filtered(samples, kinds, bpp):
    """A straightforward PNG filter, byte by byte."""
    out = bytearray()
    for y, row in enumerate(samples):
        out.append(kinds[y])
        for x, v in enumerate(row):
            a = int(row[x - bpp]) if x >= bpp else 0
            b = int(samples[y - 1][x]) if y else 0
            c = int(samples[y - 1][x - bpp]) if y and x >= bpp else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(v) - (0, a, b, (a + b) // 2, near)[kinds[y]]) & 255)
    return bytes(out)


def test_png_filters_and_checksums():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (25, 30), dtype=np.uint8)
    kinds = [int(k) for k in rng.integers(0, 5, 25)]
    head = media._chunk(b"IHDR", np.array([10, 25], dtype=">u4").tobytes() + bytes([8, 2, 0, 0, 0]))
    body = zlib.compress(_filtered(x, kinds, 3))
    png = media.SIGNATURE + head + media._chunk(b"tEXt", b"a\0b") + media._chunk(b"IDAT", body[:50]) + media._chunk(b"IDAT", body[50:]) + media._chunk(b"IEND", b"")
    assert np.array_equal(media.png_decode(png)[0], x)
    for at in (20, len(png) - 40, len(png) - 5):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.png_decode(bytes(bad))
    for n in (1, 2, 40):
        s = rng.integers(0, 256, (n, 192), dtype=np.uint8)
        assert np.array_equal(media.png_decode(media.png_encode(s))[0], s)


def test_cosine_hash_is_stable_under_noise():
    image = np.kron(np.random.default_rng(9).integers(40, 216, (8, 8)), np.ones((8, 8))).astype(np.uint8)
    noisy = np.clip(image + np.random.default_rng(1).normal(0, 3, image.shape), 0, 255).astype(np.uint8)
    bits = lambda m: np.unpackbits(np.frombuffer(media.cosine_hash(m, 1), dtype=np.uint8))
    assert (bits(image) != bits(noisy)).sum() <= 12
    assert (bits(image) != bits(np.random.default_rng(2).integers(0, 256, image.shape, dtype=np.uint8))).sum() > 12


def test_media_columns(spark, edge):
    rows = media.png_features(media.texts_to_png(edge)).collect()
    assert len(rows) == len(EDGE)
    want = {}
    for i, t, _ in EDGE:
        p = media.text_payload((t or "").encode())
        want[i] = (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    assert all((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == want[r.doc_id] for r in rows)
    same = {(r.media_sha256, r.feature) for r in rows if r.doc_id in (2, 3)}
    assert len(same) == 1
    damaged = spark.createDataFrame([(1, bytearray(b"no png")), (2, None)], "doc_id long, media binary")
    assert [r.payload_bytes for r in media.png_features(damaged, keep=("doc_id",)).collect()] == [None, None]
    assert media.png_features(media.texts_to_png(edge.limit(0))).count() == 0


def test_long_texts_are_split_like_short_ones(monkeypatch):
    """A text beyond the step is taken in pieces: same words, sentences and beginnings."""
    rng = random.Random(3)
    text = "".join(rng.choice(["word", "Ünïcode", "a", "x" * 90, "!"]) + rng.choice([" ", ". ", "\n", "-", "  "]) for _ in range(3000))
    for separators, prefixes in ((None, ()), (wordhash.NOT_ALNUM, (4, 5))):
        texts = pa.array([text], pa.large_string())
        want = wordhash.words(texts, separators, prefixes)
        with monkeypatch.context() as m:
            m.setattr(wordhash, "STEP_BYTES", 1000)
            got = wordhash.words(texts, separators, prefixes)
        assert all(np.array_equal(a, b) for a, b in zip(want[:3] if prefixes else want, got[:3] if prefixes else got))
        if prefixes:
            assert all(np.array_equal(a, b) for a, b in zip(want[3], got[3]))
    blanks = pa.array([" " * 5000 + "a" * 9000 + " "], pa.large_string())
    monkeypatch.setattr(wordhash, "STEP_BYTES", 1000)
    assert len(wordhash.words(blanks)[0]) == 1 and len(wordhash.words(pa.array(["a" * 5000], pa.large_string()))[0]) == 1


def test_damaged_png_header_is_a_value_error():
    whole = media.png_encode(np.zeros((2, 3), dtype=np.uint8))
    body = whole[16:29] + b"more"
    bad = whole[:8] + struct.pack(">I", len(body)) + b"IHDR" + body + struct.pack(">I", zlib.crc32(b"IHDR" + body)) + whole[33:]
    with pytest.raises(ValueError):
        media.png_decode(bad)
