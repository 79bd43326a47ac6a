"""Encoding, decoding and counting tokens of whole text columns.

All of these are narrow maps: no shuffle, bounded caches, any text length.
Null texts count as empty; empty texts have no token.  The outputs hold the id
column, what is computed and columns to ``carry``; others are ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.bpe import byte_counter, word_coder


def _rows(docs: DataFrame, doc_id: str, text: str, added: str, make, carry: tuple[str, ...] = ()):
    """Map ``make(text)`` -> tuple of values over the texts; ``carry`` columns stay."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{doc_id}` {kinds[doc_id]}", added, *(f"`{c}` {kinds[c]}" for c in carry)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [make(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), *(pa.array(c) for c in zip(*made)), *part.columns[2:]]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = [doc_id, *(x.split()[0] for x in added.split(", ")), *carry]
    return docs.select(F.col(doc_id), F.col(text).alias("_text"), *carry).mapInArrow(run, schema)


def encode(text: str | Column, file: str) -> Column:
    """Ids of each whole text, ``array<int>``."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        coder = word_coder(file)
        coded = [coder.encode(t or "") for t in texts.to_pylist()]
        ends = np.array([0, *itertools.accumulate(len(c) // 4 for c in coded)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), dtype="<i4")))

    return ids(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, file: str) -> Column:
    """Spelling of each id array: tokens with one space between."""

    @F.arrow_udf("string")
    def spelled(arrays: pa.Array) -> pa.Array:
        table = word_coder(file).vocabulary
        return pa.array([table.decode(np.array(a or [], dtype=np.int64)).decode() for a in arrays.to_pylist()], pa.string())

    return spelled(F.col(ids) if isinstance(ids, str) else ids)


def encoding_digests(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of each whole text, and the ``carry`` columns."""

    def make(t: str):
        coder = word_coder(file)
        coded = coder.encode(t)
        back = coder.vocabulary.decode(np.frombuffer(coded, dtype="<u4"))
        return len(coded) // 4, hashlib.sha256(coded).hexdigest(), hashlib.sha256(back).hexdigest()

    return _rows(docs, doc_id, text, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, carry)


def token_counts(docs: DataFrame, file: str, limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, fit_chars); fit_chars is the longest
    prefix, in characters, whose own encoding has at most ``limit`` tokens."""

    def make(t: str):
        counter = byte_counter(file)
        n, fit = counter.measure(t, limit)
        return len(t.encode()), n, n > limit, fit

    return _rows(docs, doc_id, text, "n_bytes long, n_tokens long, over_limit boolean, fit_chars long", make)


def prefix_table(docs: DataFrame, file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, counts): little-endian 32-bit token counts of the prefixes of 0, 1, ... characters."""

    def make(t: str):
        return (byte_counter(file).prefixes(t).astype("<u4").tobytes(),)

    return _rows(docs, doc_id, text, "counts binary", make)


def tokens_at(counts: str | Column, chars: Column) -> Column:
    """Token count of the prefix of ``chars`` characters, read from a prefix table (no text needed)."""
    counts = F.col(counts) if isinstance(counts, str) else counts
    at = F.greatest(F.lit(0), F.least(chars, F.octet_length(counts) / 4 - 1)).cast("int")
    byte = lambda k: F.conv(F.hex(F.substring(counts, at * 4 + k, F.lit(1))), 16, 10).cast("long")
    return byte(1) + byte(2) * 256 + byte(3) * 65536 + byte(4) * 16777216
