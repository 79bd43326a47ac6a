"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Each sentence has a probability
``p = sigmoid(bias + sum of the weights of its features)`` and the document's
score is their noisy-or, ``1 - prod(1 - p)``.  Only document labels are needed
for training: the gradient of the document's log-likelihood is shared out to
the sentences, so the weights end up locating the offending ones.

Features are hashed words and word beginnings; nothing else about a document
(language, source, id) is seen.  Fitting uses at most ``sample`` labelled rows
(those whose id hashes lowest), so the driver holds a bounded amount; scoring
is a narrow map over every whole text.

Null and empty texts have no sentence and score 0.0.  Repeated rows score
alike.  Input columns other than the named ones are ignored by ``fit`` and
kept by ``score``; an input column called like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm import shared, wordhash

#: Lengths in bytes of the word beginnings that count as features.
PREFIXES = (4, 5, 6, 7)
BITS = 20


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of hashed features (all others weigh 0), and the bias of every sentence."""

    features: np.ndarray
    values: np.ndarray
    bias: float

    @property
    def weights(self) -> np.ndarray:
        """A weight for each hash."""
        dense = np.zeros(1 << BITS, dtype=np.float32)
        dense[self.features] = self.values
        return dense


def _features(texts: pa.Array):
    """(row, sentence, feature) of every word's features in a slice."""
    rows, hashes, sentences, heads = wordhash.words(texts, wordhash.NOT_ALNUM, PREFIXES)
    shift = np.uint64(64 - BITS)
    return rows, sentences, [(h >> shift).astype(np.int64) for h in (hashes, *heads)]


def _sentence_scores(texts: pa.Array, weights: np.ndarray, bias: float):
    """(row of each sentence, its probability), for one slice.

    A feature counts once for each time it occurs; the best feature of each
    word counts, so that overlapping beginnings don't add up.
    """
    rows, sentences, columns = _features(texts)
    if len(rows) == 0:
        return rows, np.zeros(0)
    gain = weights[columns[0]].astype(np.float64)
    for c in columns[1:]:
        w = weights[c]
        gain = np.where(np.abs(w) > np.abs(gain), w, gain)
    first = np.flatnonzero(np.r_[True, sentences[1:] != sentences[:-1]])
    return rows[first], _sigmoid(bias + np.add.reduceat(gain, first))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def score_column(text: str | Column, model: ToxicityModel) -> Column:
    """Noisy-or score, 0 to 1, of each text."""
    known = {}

    @F.arrow_udf("double")
    def toxicity(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        if not known:
            known["weights"] = model.weights
        for at, part in wordhash.slices(texts):
            rows, p = _sentence_scores(part, known["weights"], model.bias)
            clean = np.bincount(rows, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(part))
            out[at : at + len(part)] = -np.expm1(clean)
        return pa.array(np.clip(out, 0.0, 1.0))

    return toxicity(F.col(text) if isinstance(text, str) else text)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the column ``into`` added (or replaced)."""
    return docs.withColumn(into, score_column(F.col(text), model))


def offending_sentences(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, sentence_no, probability, sentence) of sentences at ``least`` or more."""
    schema = f"{doc_id} {dict(docs.dtypes)[doc_id]}, sentence_no long, probability double, sentence string"

    def locate(batches):
        import re

        weights = model.weights
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for k, whole in zip(ids, batch.column(1).to_pylist()):
                parts = [s for s in re.split(r"(?<=[.!?\n\r])", whole or "") if s.strip()]
                rows, p = _sentence_scores(pa.array(parts, pa.large_string()), weights, model.bias)
                best = np.zeros(len(parts))
                np.maximum.at(best, rows, p)
                out += [(k, i, float(best[i]), parts[i].strip()) for i in np.flatnonzero(best >= least)]
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.int64(), pa.float64(), pa.string()))], names=[doc_id, "sentence_no", "probability", "sentence"])

    return docs.select(doc_id, text).mapInArrow(locate, schema)


def _held(batches):
    """(f, y, n): how many documents of each label hold each feature, batch by batch."""
    for batch in batches:
        labels = batch.column(0).to_numpy().astype(np.int64)
        for at, part in wordhash.slices(batch.column(1)):
            rows, _, columns = _features(part)
            pairs = np.unique(np.concatenate([rows << BITS | c for c in columns]))
            key, n = np.unique((pairs & (1 << BITS) - 1) << 1 | labels[at + (pairs >> BITS)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key >> 1), pa.array(key & 1), pa.array(n)], names=["f", "y", "n"])


def _hits(chosen: np.ndarray, strength: np.ndarray):
    """One row for each document: label, sentences without a chosen feature, and (sentence, feature's place) of the rest's words."""

    def run(batches):
        slot, most = np.full(1 << BITS, -1, dtype=np.int32), np.zeros(1 << BITS)
        slot[chosen], most[chosen] = np.arange(len(chosen)), strength
        for batch in batches:
            for at, part in wordhash.slices(batch.column(1)):
                rows, sentences, columns = _features(part)
                f = np.stack(columns)
                best = f[np.argmax(most[f], axis=0), np.arange(f.shape[1])]  # one feature for each word: the strongest that it has
                keep = slot[best] >= 0
                bounds = np.searchsorted(rows, np.arange(len(part) + 1))
                whole, empty, sent, feat = [], [], [], []
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    s, k = sentences[lo:hi], keep[lo:hi]
                    used, local = np.unique(s[k], return_inverse=True)
                    empty.append(len(np.unique(s)) - len(used))
                    sent.append(local.astype("<i4").tobytes())
                    feat.append(slot[best[lo:hi][k]].astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)).cast(pa.int32()), pa.array(empty, pa.int64()), pa.array(sent, pa.binary()), pa.array(feat, pa.binary())], names=["y", "empty", "sent", "feat"])

    return run


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = 6000, features: int = 512, steps: int = 200) -> ToxicityModel:
    """Train on at most ``sample`` labelled rows: those with the lowest hash of the id.

    Rows without a label or id are left out.  The ``features`` (the model's
    size) with the strongest link to the label get weights; the rest stay 0.
    They are chosen from counts made in Spark, and only words with a chosen
    feature come to the driver.  With no labelled row of both kinds, the model
    scores everything near 0.
    """
    chosen = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id), F.col(label).alias("y")).where(F.col(doc_id).isNotNull()).orderBy(F.xxhash64(F.col(doc_id)), F.col(doc_id)).limit(sample)
    picked = docs.select(F.col(doc_id), F.col(text).alias("t")).join(F.broadcast(chosen), doc_id).select("y", "t")  # at most `sample` rows
    picked = shared.table(picked, "labelled")
    kinds = {r.y: r.n for r in picked.groupBy(F.col("y").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return ToxicityModel(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), -12.0)
    n1, n0 = kinds[1], kinds[0]
    by_label = [F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0)) for k in (0, 1)]
    held = picked.mapInArrow(_held, "f long, y long, n long").groupBy("f").agg(by_label[0].alias("h0"), by_label[1].alias("h1")).where("h1 >= 2")
    odds = F.ln((F.col("h1") + 0.5) / (n1 + 1)) - F.ln((F.col("h0") + 0.5) / (n0 + 1))
    z = odds / F.sqrt(1 / (F.col("h1") + 0.5) + 1 / (F.col("h0") + 0.5))
    best = held.select("f", z.alias("z")).where("z > 2.5").orderBy(F.desc("z"), "f").limit(features).toArrow()
    chosen_f, strength = best.column("f").to_numpy(), best.column("z").to_numpy()
    rows = picked.mapInArrow(_hits(chosen_f, strength), "y int, empty long, sent binary, feat binary").toArrow()
    y, empties = rows.column("y").to_numpy().astype(np.float64), rows.column("empty").to_numpy().astype(np.float64)
    sents, feats = ([np.frombuffer(x, dtype="<i4") for x in rows.column(k).to_pylist()] for k in ("sent", "feat"))
    del rows
    sizes = np.array([s.max() + 1 if len(s) else 0 for s in sents])
    begins = np.cumsum(sizes) - sizes
    base = int(sizes.sum())
    doc_of = np.repeat(np.arange(len(y)), sizes)
    sent_of = np.concatenate([s + b for s, b in zip(sents, begins)])
    feat_of = np.concatenate(feats)
    lift = np.sqrt(n0 / n1)  # the rarer label counts for more
    theta = np.r_[np.full(len(chosen_f), 1.0), -6.0]
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, b = theta[:-1], theta[-1]
        x = b + np.bincount(sent_of, weights=w[feat_of], minlength=base)
        p, p0 = _sigmoid(x), _sigmoid(b)
        clean = np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(y)) + empties * np.log1p(-p0)
        score_ = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d log-likelihood / d clean, then d clean / d x = -p
        up = np.where(y == 1, lift * (1 - score_) / score_, -1.0)
        per = up[doc_of] * p
        g = np.r_[np.bincount(feat_of, weights=per[sent_of], minlength=len(w)) / len(y) - 1e-4 * w, ((up * empties * p0).sum() + per.sum()) / len(y)]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return ToxicityModel(chosen_f, theta[:-1].astype(np.float32), float(theta[-1]))
