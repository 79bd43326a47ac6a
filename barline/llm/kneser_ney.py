"""An n-gram language model with interpolated modified Kneser-Ney smoothing.

Tokens are the words of a text (A-Z as a-z) and one end mark; a token's context
is the ``order - 1`` tokens before it, with start marks where there are none.
With a(g) the count of an n-gram g (training occurrences for the highest order
and for what begins with a start mark, otherwise the number of different words
seen before it), the probability of a token after a context h is

    P(w | h) = (max(a(hw) - D(a(hw)), 0) + (D1 n1(h) + D2 n2(h) + D3 n3+(h)) P(w | h')) / A(h)

where A(h) adds up a(hw) over the words w, n1, n2, n3+ are the numbers of words
with an a(hw) of one, two, more, h' is h without its first word, and D1, D2, D3
are the order's discounts from its counts of counts.  A context that was never
seen gives P(w | h').  Below the single words stands 1 / (V + 1), V being the
number of words, so a word that was never seen has a share too.

How it is counted.  N-grams are dealt to buckets by their last context word,
so all that the formula needs of any order meets in one bucket, but for
figures of single words and of the n-grams after frequent words: such a word's
n-grams are spread over as many buckets as they need, by the token.  A chunk of
texts sends each bucket its distinct n-grams once, packed, with the documents
that hold them.  Buckets add up the counts and send partial figures of words
and spread contexts to these keys' homes, which send back the totals.  The
bucket then works out its shard of the model part by part, a sorted array of
n-gram hashes with their log-probabilities, which the worker maps from a
scratch file without a name while it looks up the chunks' n-grams, and sends
each chunk sums by document.  Both uses of the dealt n-grams are in one plan
and share its exchange.  ``model`` gives the same shards as a table.  Sent to
all workers are only totals (one row) and the FREQUENT commonest words.

Null and empty texts are the end mark alone.  Rows whose training flag is null
count as training rows.  Repeated rows count as often as they stand there, and
each gets its score.  Other input columns are ignored.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm import wordhash

START, END = (np.uint64(0x53746172745F5F31), np.uint64(0x456E645F5F5F5F32))
#: Text bytes of a chunk; text bytes for each bucket; n-grams of a bucket's part.
CHUNK, BUCKET, PART = 4 << 20, 24 << 20, 1 << 18
#: Words that are written as two bytes, and the share of a bucket that one context word may fill.
FREQUENT, SHARE = 65_000, 8
_ROW = "bucket int, chunk long, docs binary, train binary, data array<binary>, info binary"
_TOTALS = ("tokens", "words", "kinds", "m1", "m2", "m3", "m4")


def _split(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, one byte) entries: counts over 255 become several."""
    times = np.maximum((counts + 254) // 255, 1)
    place = np.repeat(np.arange(len(counts)), times)
    value = np.full(len(place), 255, dtype=np.int64)
    last = np.cumsum(times) - 1
    value[last] = counts - 255 * (times - 1)
    return place, value.astype(np.uint8)


def _narrow(index: np.ndarray, size: int) -> bytes:
    """Numbers below ``size`` in as few bytes each as hold them."""
    return index.astype(np.min_scalar_type(max(int(size) - 1, 0))).tobytes()


def _widen(data: bytes, n: int) -> np.ndarray:
    """The n numbers that ``_narrow`` packed."""
    return np.frombuffer(data, dtype=f"<u{len(data) // max(n, 1) or 1}")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal entries begins."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Words:
    """The commonest words, and how n-grams are dealt: known alike to all workers."""

    def __init__(self, frequent: np.ndarray, spread: np.ndarray, buckets: int, part: int):
        order = np.argsort(frequent)
        self.frequent, self.buckets, self.part = frequent[order], buckets, part
        self.spread = np.r_[1, spread[order]].astype(np.uint64)  # by code

    def code(self, words: np.ndarray) -> np.ndarray:
        """A number for each word, 0 for the words that aren't in the list."""
        at = np.minimum(np.searchsorted(self.frequent, words), len(self.frequent) - 1)
        return np.where(self.frequent[at] == words, at + 1, 0).astype("<u2")

    def decode(self, codes: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The words again, with the ``rest`` for code 0."""
        words = self.frequent[np.maximum(codes, 1).astype(np.int64) - 1]
        words[codes == 0] = rest
        return words

    def place(self, code: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Where n-grams with last context word v (of this code) and token w belong, over the 64-bit range."""
        salt = np.zeros(len(v), dtype=np.uint64)
        hot = np.flatnonzero(self.spread[code] > 1)
        salt[hot] = wordhash.mix(w[hot], 72) % self.spread[code[hot]] * np.uint64(0x9E3779B97F4A7C15)
        return wordhash.mix(v + salt, 71)

    def bucket(self, place: np.ndarray) -> np.ndarray:
        return ((place >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)


def _chain(context: list[np.ndarray]) -> np.ndarray:
    """Hash of a context (last word first)."""
    key = wordhash.mix(context[0], 74)
    for c in context[1:]:
        key = wordhash.mix(key + c * np.uint64(5), 75)
    return key


def _gram(key: np.ndarray, w: np.ndarray) -> np.ndarray:
    return wordhash.mix(key + w * np.uint64(3), 76)


def _before(token: np.ndarray, first: np.ndarray, start) -> np.ndarray:
    """What stands before each token; ``start`` before the first of a document."""
    out = np.empty_like(token)
    out[1:] = token[:-1]
    out[first] = start
    return out


def _scatter(words: Words, order: int):
    """Chunks of (id, training flag, text) to packed n-grams by bucket."""

    def pack(part: pa.Array, train: np.ndarray):
        """(tokens of each document, packed (bucket, documents, their flags, n-grams) of the chunk)."""
        rows, found = wordhash.words(part)
        n = np.bincount(rows, minlength=len(part)) + 1
        doc = np.repeat(np.arange(len(part), dtype=np.int32), n)
        w = np.empty(len(doc), dtype=np.uint64)
        ends = np.cumsum(n) - 1
        w[np.arange(len(found)) + rows] = found
        w[ends] = END
        del rows, found
        tokens, codes, start = [w], [words.code(w)], words.code(np.array([START]))[0]
        for _ in range(order - 1):
            tokens.append(_before(tokens[-1], ends - n + 1, START))
            codes.append(_before(codes[-1], ends - n + 1, start))
        place, h = words.place(codes[1], tokens[1], w), _gram(_chain(tokens[1:]), w)
        sort = np.argsort(place & np.uint64(0xFFFFFFFF00000000) | h >> np.uint64(32))
        doc, h, bucket = doc[sort], h[sort], words.bucket(place[sort])
        cuts = np.append(_starts(bucket), len(bucket))
        out = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            held = np.zeros(len(part), dtype=bool)
            held[doc[i:j]] = True
            used = np.flatnonzero(held)
            entry = _starts(h[i:j])  # where each distinct n-gram begins
            times, count = _split(np.diff(np.append(entry, j - i)))
            entry = sort[i:j][entry[times]]
            v = tokens[1][entry]
            run_ = _starts(v)
            times, length = _split(np.diff(np.append(run_, len(v))))
            data = [count.tobytes(), length.tobytes(), _narrow((np.cumsum(held) - 1)[doc[i:j]], len(used))]
            for k, at in enumerate((entry[run_[times]], entry, *[entry] * (order - 2))):
                k = (1, 0, *range(2, order))[k]
                code = codes[k][at]
                data += [code.tobytes(), tokens[k][at[code == 0]].tobytes()]
            out.append((int(bucket[i]), _narrow(used, len(part)), np.packbits(train[used]).tobytes(), data))
        return n, out

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, part in wordhash.slices(batch.column(2), CHUNK):
                train = batch.column(1).slice(at, len(part)).fill_null(True).to_numpy(zero_copy_only=False).astype(bool)
                n, packed = pack(part, train)
                info = pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(train)], names=["doc_id", "n", "train"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, info.schema) as writer:
                    writer.write_batch(info)
                bucket, docs, flags, data = zip(*packed)
                first = [sink.getvalue().to_pybytes(), *[None] * (len(packed) - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([task << 32 | number] * len(packed), pa.int64()), pa.array(docs, pa.binary()), pa.array(flags, pa.binary()), pa.array(data, pa.list_(pa.binary())), pa.array(first, pa.binary())], names=[x.split()[0] for x in _ROW.split(", ")])
                number += 1

    return run


class _Packed:
    """A packed row, of which stretches of n-grams are unpacked."""

    def __init__(self, row: dict, words: Words):
        self.row, self.words = row, words
        count, length, doc, *codes = row["data"]
        self.count = np.frombuffer(count, dtype=np.uint8)
        self.ends = np.cumsum(self.count, dtype=np.int32)
        self.doc = _widen(doc, int(self.ends[-1]))
        self.train = np.unpackbits(np.frombuffer(row["train"], dtype=np.uint8)).astype(bool)
        self.codes = [(np.frombuffer(a, dtype="<u2"), np.frombuffer(b, dtype="<u8")) for a, b in zip(codes[::2], codes[1::2])]
        self.runs = np.cumsum(np.frombuffer(length, dtype=np.uint8), dtype=np.int64)
        self.size = len(self.count)

    def column(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Last context words (k=0), tokens (1), or earlier context words (2 and up) of a stretch."""
        codes, rest = self.codes[k]
        if k == 0:
            return self.words.decode(codes, rest)[self._runs(lo, hi)]
        skip = np.count_nonzero(codes[:lo] == 0)
        own = codes[lo:hi]
        return self.words.decode(own, rest[skip : skip + np.count_nonzero(own == 0)])

    def _runs(self, lo: int, hi: int) -> np.ndarray:
        """Runs of last context words that the stretch's n-grams are in."""
        a, b = np.searchsorted(self.runs, (lo, hi - 1), side="right")
        ends = np.minimum(self.runs[a : b + 1], hi)
        return np.repeat(np.arange(a, b + 1), np.diff(np.r_[lo, ends]))

    def code(self, lo: int, hi: int) -> np.ndarray:
        """Codes of the last context words of a stretch."""
        return self.codes[0][0][self._runs(lo, hi)]

    def occurrences(self, lo: int, hi: int) -> slice:
        """Where the stretch's occurrences stand in ``doc``."""
        return slice(int(self.ends[lo - 1]) if lo else 0, int(self.ends[hi - 1]) if hi else 0)


class _Bucket:
    """A bucket's packed rows, worked through in parts."""

    def __init__(self, rows: list[dict], words: Words, order: int):
        self.words, self.order = words, order
        self.rows = [_Packed(r, words) for r in rows]
        number = 1 + sum(r.size for r in self.rows) // words.part
        # parts cut the range of places that belongs to the bucket; rows are sorted by place
        self.cuts = []
        low, high = (np.uint64(b) * np.uint64(1 << 32) // np.uint64(words.buckets) for b in (rows[0]["bucket"], rows[0]["bucket"] + 1))
        bounds = low + np.arange(1, number, dtype=np.uint64) * (high - low + np.uint64(1)) // np.uint64(number)
        for r in self.rows:
            inner = np.zeros(0, dtype=np.int64)
            if number > 1:
                inner = np.searchsorted(words.place(r.code(0, r.size), r.column(0, 0, r.size), r.column(1, 0, r.size)) >> np.uint64(32), bounds)
            self.cuts.append(np.r_[0, inner, r.size])
        self.parts = range(number)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The bucket's words, and the keys of its spread contexts, both sorted."""
        tokens, contexts = [], []
        for r in self.rows:
            tokens.append(np.unique(r.column(1, 0, r.size)))
            hot = np.flatnonzero(self.words.spread[r.code(0, r.size)] > 1)
            if len(hot):
                context = [r.column(k, 0, r.size)[hot] for k in (0, *range(2, self.order))]
                contexts += [np.unique(_chain(context[:k])) for k in range(1, self.order)]
        return np.unique(np.concatenate(tokens)), np.unique(np.concatenate(contexts)) if contexts else np.zeros(0, dtype=np.uint64)

    def part(self, p: int) -> list[dict]:
        """The part's levels, from whole n-grams down to word pairs.

        Each has distinct ``hash``, ``w``, ``context`` words, count ``a``, key
        of the context, ``at`` (place of its context among ``keys``), sums and
        numbers by context as ``stats``, and ``lower``, the place of the n-gram
        without its first word on the next level (on the last, None).
        """
        columns, counts = [[] for _ in range(self.order)], []
        for r, cut in zip(self.rows, self.cuts):
            lo, hi = int(cut[p]), int(cut[p + 1])
            if lo == hi:
                continue
            for k in range(self.order):
                columns[k].append(r.column(k, lo, hi))
            s = r.occurrences(lo, hi)
            seen = r.train[r.doc[s]].astype(np.int64)
            n = r.count[lo:hi].astype(np.int64)
            counts.append(np.add.reduceat(seen, np.cumsum(n) - n))
        if not counts:
            return []
        v, w, *earlier = (np.concatenate(c) for c in columns)
        context, a = [v, *earlier], np.concatenate(counts)
        levels = []
        for k in range(self.order - 1, 0, -1):
            key = _chain(context[:k])
            h = _gram(key, w)
            sort = np.argsort(h)
            first = _starts(h[sort])
            if levels:  # from the level above: its n-grams that end in this one
                inverse = np.empty(len(h), dtype=np.int64)
                inverse[sort] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
                levels[-1]["lower"] = inverse
                above, opens = a, context[k - 1] == START
                a = np.add.reduceat(np.where(opens, above, above > 0).astype(np.int64)[sort], first)
            else:
                a = np.add.reduceat(a[sort], first)
            sort = sort[first]
            w, context, key, h = w[sort], [c[sort] for c in context], key[sort], h[sort]
            keys, at = np.unique(key, return_inverse=True)
            stats = np.stack([np.bincount(at, weights=x, minlength=len(keys)) for x in (a, a == 1, a == 2, a >= 3)])
            levels.append({"hash": h, "w": w, "v": context[0], "a": a, "keys": keys, "at": at, "stats": stats, "lower": None, "order": k})
        return levels


def _by_bucket(batches):
    """Lists of a bucket's rows; rows come sorted by bucket."""
    current, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != current and held:
                yield held
                held = []
            current = row["bucket"]
            held.append(row)
    if held:
        yield held


def _homes(keys: np.ndarray, homes: int):
    """(places sorted by home, where each home's begin)."""
    home = (keys % np.uint64(homes)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    return order, np.searchsorted(home[order], np.arange(homes + 1))


def _add(total: np.ndarray, keys: np.ndarray, own: np.ndarray, figures: list[np.ndarray]) -> None:
    """Adds figures of ``own`` keys to the rows of the sorted ``keys``."""
    place = np.searchsorted(keys, own)
    for k, x in enumerate(figures):
        total[k] += np.bincount(place, weights=x, minlength=len(keys)).astype(np.uint64)


def _ask(words: Words, order: int):
    """Partial figures of each bucket's words and spread contexts, to the keys' homes."""

    def run(batches):
        for rows in _by_bucket(batches):
            held = _Bucket(rows, words, order)
            tokens, contexts = held.keys()
            of_words, of_contexts = np.zeros((2, len(tokens)), dtype="<u8"), np.zeros((4, len(contexts)), dtype="<u8")
            coc = np.zeros((order - 1, 4), dtype="<i8")
            for p in held.parts:
                for at, level in enumerate(held.part(p)):
                    coc[level["order"] - 1] += [(level["a"] == k).sum() for k in (1, 2, 3, 4)]
                    if at == 0:
                        _add(of_words[:1], tokens, level["w"], [level["a"]])
                    if level["order"] == 1:
                        _add(of_words[1:], tokens, level["w"], [level["a"] > 0])
                    if len(contexts):
                        mine = np.minimum(np.searchsorted(contexts, level["keys"]), len(contexts) - 1)
                        hot = contexts[mine] == level["keys"]
                        _add(of_contexts, contexts, level["keys"][hot], list(level["stats"][:, hot]))
            order_w, cuts_w = _homes(tokens, words.buckets)
            order_c, cuts_c = _homes(contexts, words.buckets)
            out = [[] for _ in range(7)]
            for b in range(words.buckets):
                w, c = order_w[cuts_w[b] : cuts_w[b + 1]], order_c[cuts_c[b] : cuts_c[b + 1]]
                if len(w) or len(c) or b == 0:
                    row = b, rows[0]["bucket"], tokens[w].tobytes(), _press(of_words[:, w]), contexts[c].tobytes(), _press(of_contexts[:, c]), coc.tobytes() if b == 0 else None
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), *(pa.array(c, pa.binary()) for c in out[2:])], names=["home", "bucket", "words", "figures", "contexts", "stats", "coc"])

    return run


def _press(figures: np.ndarray) -> bytes:
    """Whole numbers, compressed by byte planes."""
    planes = np.ascontiguousarray(figures, dtype="<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _figures(data: bytes, kinds: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(kinds, -1)


def _answer(order: int):
    """Whole figures of a home's keys, for each bucket that asked; and totals."""

    def run(batches):
        by_home: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                by_home.setdefault(row["home"], []).append(row)
        for home, rows in by_home.items():
            sums, places, cuts = [], [], []
            for keys, figures, kinds in (("words", "figures", 2), ("contexts", "stats", 4)):
                own = [np.frombuffer(r[keys], dtype="<u8") for r in rows]
                known, place = np.unique(np.concatenate(own), return_inverse=True)
                whole = np.zeros((kinds, len(known)), dtype="<u8")
                for r, x in zip(rows, own):
                    _add(whole, known, x, list(_figures(r[figures], kinds)))
                sums.append(whole), places.append(place), cuts.append(np.r_[0, np.cumsum([len(x) for x in own])])  # noqa: B018
            raw, before = sums[0]
            coc = sum((np.frombuffer(r["coc"], dtype="<i8") for r in rows if r["coc"]), np.zeros(4 * (order - 1), dtype=np.int64))
            totals = [int(raw.sum()), int((raw > 0).sum()), int(before.sum()), *(int((before == k).sum()) for k in (1, 2, 3, 4)), *map(int, coc)]
            for k, r in enumerate(rows):
                own = [_press(s[:, p[c[k] : c[k + 1]]]) for s, p, c in zip(sums, places, cuts)]
                t = totals if k == 0 else [0] * len(totals)
                yield pa.RecordBatch.from_arrays([pa.array([r["bucket"]], pa.int32()), pa.array([home], pa.int32()), *(pa.array([x], pa.binary()) for x in own), *(pa.array([x], pa.int64()) for x in t)], names=["bucket", "home", "figures", "stats", *_names(order)])

    return run


def _names(order: int) -> list[str]:
    return [*_TOTALS, *(f"c{k}_{i}" for k in range(1, order) for i in (1, 2, 3, 4))]


def _discounts(n1, n2, n3, n4):
    """(D1, D2, D3+) from the counts of counts; halves where these are too few."""
    if min(n1, n2, n3, n4) == 0:
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 1, 2, 3])


def _mapped(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays again, mapped read-only from a file that has no name any more."""
    out = []
    with tempfile.TemporaryFile() as f:
        for a in arrays:
            f.write(np.ascontiguousarray(a).tobytes())
        f.flush()
        at = 0
        for a in arrays:
            out.append(np.memmap(f, dtype=a.dtype, mode="r", offset=at, shape=a.shape) if a.size else a)
            at += a.nbytes
    return out


class _Shard:
    """One bucket's part of the model."""

    def __init__(self, held: _Bucket, answers: list[dict], words: Words, order: int):
        self.held = held
        self.tokens, self.contexts = held.keys()
        self.totals = {k: answers[0][f"all_{k}"] for k in _names(order)}
        of_words, self.of_contexts = np.zeros((2, len(self.tokens))), np.zeros((4, len(self.contexts)))
        order_w, cuts_w = _homes(self.tokens, words.buckets)
        order_c, cuts_c = _homes(self.contexts, words.buckets)
        for a in answers:
            b = a["home"]
            of_words[:, order_w[cuts_w[b] : cuts_w[b + 1]]] = _figures(a["figures"], 2)
            self.of_contexts[:, order_c[cuts_c[b] : cuts_c[b + 1]]] = _figures(a["stats"], 4)
        t = self.totals
        self.raw, before = of_words
        share = 1.0 / (t["words"] + 1)
        self.single = np.full(len(self.tokens), share)
        if t["kinds"]:
            d = _discounts(*(t[f"m{k}"] for k in (1, 2, 3, 4)))
            spare = d[1] * t["m1"] + d[2] * t["m2"] + d[3] * (t["words"] - t["m1"] - t["m2"])
            self.single = (np.maximum(before - d[np.minimum(before, 3).astype(int)], 0) + spare * share) / t["kinds"]
        self.base = np.log10((self.raw + 1) / (t["tokens"] + t["words"] + 1))

    def part(self, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted n-gram hashes, log10 of their probabilities, places of their tokens)."""
        levels = self.held.part(p)
        if not levels:
            return (np.zeros(0, dtype=np.uint64), np.zeros(0), np.zeros(0, dtype=np.int64))
        lower = self.single[np.searchsorted(self.tokens, levels[-1]["w"])]
        for level in reversed(levels):
            if level["lower"] is not None:
                lower = lower[level["lower"]]
            stats = level["stats"]
            if len(self.contexts):
                mine = np.minimum(np.searchsorted(self.contexts, level["keys"]), len(self.contexts) - 1)
                stats = np.where(self.contexts[mine] == level["keys"], self.of_contexts[:, mine], stats)
            d = _discounts(*(self.totals[f"c{level['order']}_{k}"] for k in (1, 2, 3, 4)))
            whole, spare = stats[0][level["at"]], (d[1:] @ stats[1:])[level["at"]]
            lower = np.where(whole > 0, (np.maximum(level["a"] - d[np.minimum(level["a"], 3)], 0) + spare * lower) / np.maximum(whole, 1), lower)
        return levels[0]["hash"], np.log10(lower), np.searchsorted(self.tokens, levels[0]["w"])


def _words(docs: DataFrame, text: str) -> Words:
    """The commonest words, from counts over all texts, and the number of buckets."""

    def run(batches):
        for batch in batches:
            for _, part in wordhash.slices(batch.column(0), CHUNK):
                word, n = np.unique(wordhash.words(part)[1], return_counts=True)
                many = n >= 3
                yield pa.RecordBatch.from_arrays([pa.array(word[many].astype(np.int64)), pa.array(n[many])], names=["e", "c"])

    size, rows = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    buckets = int(max(12, min((size or 0) // BUCKET, 1 << 20)))
    counts = docs.select(text).mapInArrow(run, "e long, c long").groupBy("e").agg(F.sum("c").alias("c"))
    top = counts.orderBy(F.desc("c"), "e").limit(FREQUENT).toArrow()
    # a sixth of a text's bytes are its tokens, about
    most = max(((size or 0) // 6 + rows) / buckets / SHARE, 1)
    frequent = np.r_[top.column("e").to_numpy().astype(np.uint64), START, END]
    return Words(frequent, np.ceil(np.r_[top.column("c").to_numpy(), rows, 1] / most).clip(1), buckets, PART)


def _plan(docs: DataFrame, train: str, doc_id: str, text: str, order: int):
    """(dealt n-grams, answers with totals, words)."""
    words = _words(docs, text)
    buckets = words.buckets
    dealt = docs.select(F.col(doc_id), F.col(train).cast("boolean"), F.col(text)).mapInArrow(_scatter(words, order), _ROW).repartitionById(buckets, F.col("bucket"))
    asked = dealt.sortWithinPartitions("bucket").mapInArrow(_ask(words, order), "home int, bucket int, words binary, figures binary, contexts binary, stats binary, coc binary")
    sums = ", ".join(f"{k} long" for k in _names(order))
    answers = asked.repartitionById(buckets, F.col("home")).mapInArrow(_answer(order), f"bucket int, home int, figures binary, stats binary, {sums}")
    totals = answers.agg(*(F.sum(k).alias(f"all_{k}") for k in _names(order)))
    with_totals = answers.select("bucket", "home", "figures", "stats").join(F.broadcast(totals), F.lit(True))  # one row
    return dealt, with_totals.repartitionById(buckets, F.col("bucket")), words


def model(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(bucket, part, hashes, log10p): the model as sorted hash arrays, to be written as a table."""
    dealt, answers, words = _plan(docs, train, doc_id, text, order)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [], [], [], []
        if left.num_rows:
            held = _Bucket(left.to_pylist(), words, order)
            shard = _Shard(held, right.to_pylist(), words, order)
            for p in held.parts:
                h, log, _ = shard.part(p)
                for column, value in zip(out, (held.rows[0].row["bucket"], p, h.tobytes(), log.astype("<f4").tobytes())):
                    column.append(value)
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["bucket", "part", "hashes", "log10p"])

    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, "bucket int, part int, hashes binary, log10p binary")


def score(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text", order: int = 3) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row.

    ``train`` names a boolean column: rows where it is true are counted.
    ``order`` is the number of words of an n-gram, 2 or more.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    kind = dict(docs.dtypes)[doc_id]
    dealt, answers, words = _plan(docs, train, doc_id, text, order)

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(7)]
        if left.num_rows:
            held = _Bucket(left.to_pylist(), words, order)
            del left
            shard = _Shard(held, right.to_pylist(), words, order)
            sums = [np.zeros((3, int(r.doc.max()) + 1)) for r in held.rows]
            for p in held.parts:
                hashes, log, token = _mapped(*shard.part(p))
                for r, cut, total in zip(held.rows, held.cuts, sums):
                    lo, hi = int(cut[p]), int(cut[p + 1])
                    if lo == hi:
                        continue
                    h = _gram(_chain([r.column(k, lo, hi) for k in (0, *range(2, order))]), r.column(1, lo, hi))
                    at = np.repeat(np.searchsorted(hashes, h), r.count[lo:hi])
                    doc, w = r.doc[r.occurrences(lo, hi)], token[at]
                    for k, x in enumerate((log[at], shard.base[w], shard.raw[w] > 0)):
                        total[k] += np.bincount(doc, weights=x, minlength=total.shape[1])
            tokens = shard.totals["tokens"]
            for r, (p_, base, known) in zip(held.rows, sums):
                for column, value in zip(out, (r.row["chunk"], r.row["docs"], p_.tobytes(), base.tobytes(), _narrow(known, known.max() + 1), r.row["info"], tokens)):
                    column.append(value)
        return pa.table([pa.array(out[0], pa.int64()), *(pa.array(c, pa.binary()) for c in out[1:6]), pa.array(out[6], pa.int64())], names=["chunk", "docs", "p", "base", "known", "info", "tokens"])

    parts = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(look_up, "chunk long, docs binary, p binary, base binary, known binary, info binary, tokens long")

    def add_up(batches):
        current, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["chunk"] != current and held:
                    yield _whole(held)
                    held = []
                current = row["chunk"]
                held.append(row)
        if held:
            yield _whole(held)

    chunks = parts.repartition("chunk").sortWithinPartitions("chunk")
    whole = chunks.mapInArrow(add_up, f"doc_id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return whole.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _whole(rows: list[dict]) -> pa.RecordBatch:
    """The rows of a chunk's documents, their parts added up."""
    with pa.ipc.open_stream(next(r["info"] for r in rows if r["info"])) as reader:
        info = reader.read_next_batch()
    size = info.num_rows
    sums = np.zeros((3, size))
    for r in rows:
        base = np.frombuffer(r["base"], dtype="<f8")
        docs = _widen(r["docs"], len(base))
        for total, part in zip(sums, (_widen(r["known"], len(base)), base, np.frombuffer(r["p"], dtype="<f8"))):
            total[docs] += part
    return pa.RecordBatch.from_arrays(
        [info.column(0), info.column(2), info.column(1), pa.array(sums[0].astype(np.int64)), pa.array(np.full(size, rows[0]["tokens"]), pa.int64()), pa.array(sums[1]), pa.array(sums[2])],
        names=["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    )
