"""Exact byte-pair encoding by backtracking, decoding and prefix counts.

Encoding.  An Aho-Corasick pass finds the longest token that starts at each
place of a piece.  Tokens are then laid from left to right, longest first; a
token may follow another only if the pair is *compatible*, that is, if merging
the two tokens' joined symbols gives just these two tokens back.  A place from
which no token leads on is closed and the last token is laid anew, shorter.
The first chain that reaches the end is the one that the merges give, and each
place is closed at most once, so the time is linear in the piece.

Compatibility needs no merging: undo the merges that made the left token's
right edge and the right token's left edge.  While two edge symbols face each
other, a merge of them that comes before either grows would have joined them.
Answers are kept in a table for later pairs.

Prefixes.  Every prefix of a piece ends in exactly one token that is
compatible with the last token of the prefix before it, so one pass stores the
token count of all prefixes (``Vocabulary.prefix_counts``).

Decoding.  The spelling of all tokens stands in one buffer; an offset table
gives each id's place, and numpy gathers the whole answer at once.

The vocabulary file is a parameter and is read by each worker process once.
Caches are bounded, and pieces of any length work.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

#: Entries that a worker's caches hold before they are emptied.
CACHE = 250_000
#: Letters of a piece that is kept in a cache; longer ones are worked out each time.
LONGEST = 64


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class _Cache(dict):
    """Computes what is missing.  When full it starts anew, and takes over what
    is asked for again from its last filling."""

    def __init__(self, make):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST:
            self[key] = value
        return value


class Vocabulary:
    """Tokens, merges and lookup tables of one tokenizer file.

    Inside, a piece is a string with one letter for each byte; where the
    vocabulary marks word ends, the last byte's letter is 256 higher.
    """

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
        self.spelling = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.of: dict[str, int] = {}
        for token, i in model["vocab"].items():
            body = token.removesuffix(self.end) if self.end else token
            if body and all(c in byte_of for c in body):
                codes = [byte_of[c] for c in body]
                if self.end and token != body:
                    codes[-1] += 256
                self.of[("".join(map(chr, codes)))] = i
        size = max(self.spelling) + 1
        self.length = [0] * size
        self.text = [""] * size
        for s, i in self.of.items():
            self.length[i], self.text[i] = len(s), s
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        #: The rank of the merge that makes a token; single letters come first.
        self.born = [-1] * size
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.merge[a, b] = rank
            made = vocab[left + right]
            if self.parts[made] is None:
                self.parts[made], self.born[made] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        self.shorter: list[int | None] = [None] * size
        for s, i in self.of.items():
            self.automaton.add_word(s, i)
            self.shorter[i] = next((self.of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.of), None)
        self.automaton.make_automaton()
        self.fits = _Cache(self._compatible)
        spelled = [self.spelling.get(i, "").encode() + b" " for i in range(size)]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(spelled), dtype=np.uint8)

    def _compatible(self, pair: tuple[int, int]) -> bool:
        a, b = pair
        never = len(self.merge)
        grow_a = grow_b = never  # ranks at which a and b become part of a larger token
        while True:
            rank = self.merge.get((a, b))
            if rank is not None and rank < grow_a and rank <= grow_b:
                return False
            if self.parts[a] is None and self.parts[b] is None:
                return True
            if self.born[a] > self.born[b] or self.born[a] == self.born[b] and self.parts[a] is not None:
                grow_a, a = self.born[a], self.parts[a][1]
            else:
                grow_b, b = self.born[b], self.parts[b][0]

    def letters(self, piece: bytes) -> str:
        s = piece.decode("latin-1")
        return s[:-1] + chr(ord(s[-1]) + 256) if self.end else s

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of one piece, as the merges give them."""
        s = self.letters(piece)
        whole = self.of.get(s)
        if len(s) == 1:
            return [whole]
        n, length = len(s), self.length
        longest: list[int | None] = [None] * (n + 1)
        for at, token in self.automaton.iter(s):
            longest[at + 1 - length[token]] = token  # later matches from a place are longer
        closed = bytearray(n + 1)
        chain: list[int] = []
        place, token = 0, longest[0]
        while place < n:
            last = chain[-1] if chain else None
            while token is not None and (closed[place + length[token]] or last is not None and not self.fits[last, token]):
                token = self.shorter[token]
            if token is not None:
                chain.append(token)
                place += length[token]
                token = longest[place]
            else:
                closed[place] = 1
                if last is None:
                    raise ValueError("the vocabulary lacks a letter of this piece")
                chain.pop()
                place -= length[last]
                token = last
        return chain

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token count of each prefix of 1, 2, ... bytes (vocabularies without word ends)."""
        s = piece.decode("latin-1")
        length, fits = self.length, self.fits
        last: list[int | None] = [None] * (len(s) + 1)
        count = [0] * (len(s) + 1)
        for at, token in self.automaton.iter(s):
            end = at + 1
            start = end - length[token]
            if last[end] is None and (start == 0 or last[start] is not None and fits[last[start], token]):
                last[end], count[end] = token, count[start] + 1
        return count[1:]

    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' spellings with one space between two tokens, as UTF-8."""
        if len(ids) == 0:
            return b""
        start, stop = self.offsets[ids], self.offsets[ids.astype(np.int64) + 1]
        size = stop - start
        shift = start - np.concatenate([[0], np.cumsum(size)[:-1]])
        return self.blob[np.repeat(shift, size) + np.arange(int(size.sum()))][:-1].tobytes()


@lru_cache(maxsize=4)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


#: FIXED VALUES: the public patterns that cut texts into pieces before merging.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


_BLANKS = regex.compile(r"\s*").match


class _Coder:
    """Cuts whole texts into pieces around special strings and encodes them."""

    def __init__(self, file: str, pattern: str):
        self.vocabulary = vocabulary(file)
        self.pieces = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.vocabulary.specials)) + ")").split
        self.openings = sorted({s[:2] for s in self.vocabulary.specials})

    def segments(self, text: str) -> list[str]:
        """Ordinary texts at even places, special strings at odd ones."""
        return self.cut(text) if self.may_hold_specials(text) else [text]

    def may_hold_specials(self, text: str) -> bool:
        return any(o in text for o in self.openings)


class WordCoder(_Coder):
    """Lower-cased words with word-end marks; white space is dropped."""

    def __init__(self, file: str):
        super().__init__(file, WORD_PATTERN)
        four = [i.to_bytes(4, "little") for i in range(len(self.vocabulary.length))]
        self.ids = _Cache(lambda piece: b"".join([four[i] for i in self.vocabulary.encode_piece(piece.encode())]))
        self.special_ids = {s: np.array([i], dtype="<u4").tobytes() for s, i in self.vocabulary.specials.items()}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        out = []
        for k, part in enumerate(self.segments(text)):
            if k % 2:
                out.append(self.special_ids[part])
            else:
                # lower case letter by letter: a final sigma is not treated apart
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out.append(b"".join(map(self.ids.__getitem__, self.pieces(part))))
        return b"".join(out)


@lru_cache(maxsize=2)
def word_coder(file: str) -> WordCoder:
    return WordCoder(file)


class ByteCounter(_Coder):
    """Token counts at prefixes, for byte-level vocabularies without word ends."""

    def __init__(self, file: str):
        super().__init__(file, BYTE_PATTERN)
        self.counts = _Cache(lambda piece: tuple(self.vocabulary.prefix_counts(piece.encode())))
        self.totals = _Cache(lambda piece: self.counts[piece][-1])

    def count(self, text: str) -> int:
        total = 0
        for k, part in enumerate(self.segments(text)):
            total += 1 if k % 2 else sum(map(self.totals.__getitem__, self.pieces(part)))
        return total

    def _ordinary(self, part: str, base: int, out: np.ndarray) -> int:
        """Fill in the counts at every prefix of a text without special strings."""
        at, run, run_base = 0, "", base
        for piece in self.pieces(part):
            by_byte = self.counts[piece]
            n = len(piece)
            if n == len(by_byte):
                out[at : at + n] = by_byte
            else:
                ends = np.cumsum([len(c.encode()) for c in piece])
                out[at : at + n] = np.array(by_byte)[ends - 1]
            out[at : at + n] += base
            if n == 3 and piece[0] == "'" and piece[1:].isalpha():
                out[at + 1] = base + 2  # cut short, a contraction is a quote and a letter
            # White space at the end of a prefix is one piece, as long as it goes on.
            lead = _BLANKS(piece).end()
            if lead:
                if not run:
                    run_base = base
                run += piece[:lead]
                if len(run) > lead:
                    whole = self.counts[run]
                    ends = np.cumsum([len(c.encode()) for c in run])[-lead:]
                    out[at : at + lead] = run_base + np.array(whole)[ends - 1]
            if lead < n:
                run = ""
            at += n
            base += by_byte[-1]
        return base

    def prefixes(self, text: str) -> np.ndarray:
        """Token count of each prefix of 0, 1, ... all characters."""
        out = np.zeros(len(text) + 1, dtype=np.int64)
        at = base = 0
        parts = self.segments(text)
        for k, part in enumerate(parts):
            n = len(part)
            if k % 2 == 0:
                base = self._ordinary(part, base, out[at + 1 : at + n + 1])
            else:  # a special string that is cut short is ordinary text
                before = parts[k - 1]
                start = at - len(before)
                for i in range(1, n):
                    out[at + i] = out[start] + sum(map(self.totals.__getitem__, self.pieces(before + part[:i])))
                base += 1
                out[at + n] = base
            at += n
        return out

    def fitting(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens."""
        return self.measure(text, limit)[1]

    def measure(self, text: str, limit: int) -> tuple[int, int]:
        """(tokens of the whole text, characters of the longest fitting prefix)."""
        if self.may_hold_specials(text):
            counts = self.prefixes(text)
            return int(counts[-1]), int(np.flatnonzero(counts <= limit)[-1])
        # Only the pieces around the limit need to be looked into.
        pieces = self.pieces(text)
        if len(text.encode()) <= limit - 8:
            return sum(map(self.totals.__getitem__, pieces)), len(text)
        after = np.cumsum(np.fromiter(map(self.totals.__getitem__, pieces), dtype=np.int64, count=len(pieces)))
        if len(pieces) == 0 or after[-1] <= limit - 8:
            return int(after[-1]) if len(pieces) else 0, len(text)
        first, last = np.searchsorted(after, [limit - 8, limit + 8])
        while first and not pieces[first - 1].strip():  # not within white space
            first -= 1
        base = int(after[first - 1]) if first else 0
        skipped = len("".join(pieces[:first]))
        window = "".join(pieces[first : last + 2])
        counts = np.zeros(len(window) + 1, dtype=np.int64)
        counts[0] = base
        self._ordinary(window, base, counts[1:])
        return int(after[-1]), skipped + int(np.flatnonzero(counts <= limit)[-1])


@lru_cache(maxsize=2)
def byte_counter(file: str) -> ByteCounter:
    return ByteCounter(file)
