"""Toxicity scores by a small convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its leading bytes (so inflected forms share weight).
Filters of widths 1, 2 and 3 run over the whole text, ReLU and max pooling over all positions give one value for each
filter, and a logistic layer turns these into a score.  All of it is learned: embeddings, filters and the layer start as
small random values and follow the gradient of the log loss, which reaches the words at each filter's maximum.

Training takes a bounded sample of labelled rows to one task (``rows`` by hash order, each of at most ``max_bytes``).
A fifth of it is not trained on: with the final weights it tells where the score crosses 0.5 (the best F1) and the
thresholds of the languages.  Scoring covers every whole text, slice by slice, on the executors.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shingles import U, Words, buffers, mix, slices, stream
from spanloom.llm.tables import map_arrow, text_or_empty

TRAIN_ROWS = 4000
MAX_BYTES = 1 << 16
BUCKETS = 1 << 15
SLICE = 1 << 18  # bytes in hand at a time; small enough for the processor's caches
PREFIXES = (4, 5, 6, 7)
DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
EPOCHS, BATCH, RATE, WORD_RATE = 4, 32, 0.01, 0.05
CALIBRATE = 5  # every so many-th row of either label
PRIOR_ROWS = 10  # toxic rows that the common threshold counts for against a language's own
_SALT = stream(1 + len(PREFIXES), 5)


def features(words: Words) -> np.ndarray:
    """(words, 1 + prefixes) bucket numbers: the word, and its first 4 to 7 bytes (the word itself where shorter)."""
    out = np.empty((len(words.start), 1 + len(PREFIXES)), dtype=np.int32)
    out[:, 0] = mix(words.hash ^ _SALT[0]) & U(BUCKETS - 1)
    for k, n in enumerate(PREFIXES):
        h = words.span_hash(words.start, np.minimum(words.start + n, words.end)) if len(words.start) else words.hash
        out[:, k + 1] = mix(h ^ _SALT[k + 1]) & U(BUCKETS - 1)
    return out


@dataclass
class Model:
    """Embeddings (features, BUCKETS, DIM), filters {width: (width, DIM, FILTERS)}, their biases, the logistic layer."""

    emb: np.ndarray
    conv: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def vectors(self, feats: np.ndarray) -> np.ndarray:
        x = self.emb[0][feats[:, 0]].copy()
        for k in range(1, feats.shape[1]):
            x += self.emb[k][feats[:, k]]
        return x

    def maxima(self, x: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter sums at every position, the first position of each text that has words, and the maxima there.

        Words past a text's end count as zero vectors.  Bias and ReLU are monotone, so they may follow the pooling."""
        taps = [self.conv[w][j] for w in WIDTHS for j in range(w)]
        z = x @ np.hstack(taps)
        y = np.empty((len(x), FILTERS * len(WIDTHS)), dtype=np.float32)
        ends = {j: np.flatnonzero(row[j:] != row[:-j]) for j in range(1, max(WIDTHS)) if len(row) > j}
        k = 0
        for i, w in enumerate(WIDTHS):
            out = y[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                tap = z[:, k : k + FILTERS]
                k += FILTERS
                if j == 0:
                    out[:] = tap
                elif j in ends:
                    out[:-j] += tap[j:]
                    out[ends[j]] -= tap[ends[j] + j]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        return y, first, np.maximum.reduceat(y, first, axis=0)

    def pooled(self, feats: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """(n, filters) pooled values; rows without words are zero."""
        z = np.zeros((n, FILTERS * len(WIDTHS)), dtype=np.float32)
        if len(row):
            _, first, top = self.maxima(self.vectors(feats), row)
            z[row[first]] = np.maximum(top + np.concatenate([self.bias[w] for w in WIDTHS]), 0)
        return z

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.out + self.out_bias - self.shift

    def threshold(self, lang: str | None) -> float:
        return self.thresholds.get(lang or "", 0.5)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _batch(feats: list[np.ndarray], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([feats[i] for i in index]), np.repeat(np.arange(len(index)), [len(feats[i]) for i in index])


def best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit of the best F1, half-way to the next lower one; of equal ones the highest, 0 without both labels."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][logit[order][:-1] == logit[order][1:]] = -1
    k = int(f1.argmax())
    low = logit[order][k + 1] if k + 1 < len(y) else logit[order][k] - 1
    return float((logit[order][k] + low) / 2)


class Adam:
    """Steps of bounded size for dense parameters, in place."""

    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]

    def update(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, (m, v) in zip(self.params, grads, self.moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)


def _new_model(rng: np.random.Generator, odds: float) -> Model:
    return Model(
        rng.normal(0, 0.1, (1 + len(PREFIXES), BUCKETS, DIM)).astype(np.float32),
        {w: rng.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS},
        rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32),
        odds,
    )


def _gradients(model: Model, f: np.ndarray, row: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Gradients of the mean log loss of a batch: dense ones (filters, their biases, output layer, its bias), and those of
    the words that have any, by place."""
    x = model.vectors(f)
    sums, first, top = model.maxima(x, row)
    z = np.zeros((len(y), sums.shape[1]), dtype=np.float32)
    z[row[first]] = np.maximum(top + np.concatenate([model.bias[w] for w in WIDTHS]), 0)
    g = ((sigmoid(model.logits(z)) - y) / len(y)).astype(np.float32)
    conv = {w: np.zeros_like(model.conv[w]) for w in WIDTHS}
    bias = {w: np.zeros(FILTERS, dtype=np.float32) for w in WIDTHS}
    gz = g[:, None] * model.out[None, :] * (z > 0)
    place, col = np.nonzero(sums == np.repeat(top, np.diff(np.append(first, len(row))), axis=0))
    one = np.unique(row[place] * sums.shape[1] + col, return_index=True)[1]
    place, col = place[one], col[one]  # the first place of each maximum
    up = gz[row[place], col]
    gx = np.zeros_like(x)
    for i, w in enumerate(WIDTHS):
        own = (col // FILTERS == i) & (up != 0)
        p, c, u = place[own], col[own] % FILTERS, up[own]
        np.add.at(bias[w], c, u)
        for j in range(w):
            ok = np.flatnonzero(p + j < len(row))
            ok = ok[row[p[ok] + j] == row[p[ok]]]
            np.add.at(conv[w][j].T, c[ok], u[ok, None] * x[p[ok] + j])
            np.add.at(gx, p[ok] + j, u[ok, None] * model.conv[w][j][:, c[ok]].T)
    words = np.flatnonzero(gx.any(axis=1))
    return [*conv.values(), *bias.values(), z.T @ g, np.array([g.sum()], dtype=np.float32)], words, gx[words]


def _features_of(texts: list[str | None]) -> list[np.ndarray]:
    feats: list[np.ndarray] = []
    data, offs = buffers(pc.utf8_lower(pa.array([x or "" for x in texts], pa.large_string())))
    for a, b in slices(offs, SLICE):
        words = Words(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
        cut = np.searchsorted(words.row, np.arange(b - a + 1))
        f = features(words)
        feats += [f[cut[i] : cut[i + 1]] for i in range(b - a)]
    return feats


def train(texts: list[str | None], labels: list[int], langs: list[str | None], epochs: int = EPOCHS, seed: int = 11, min_lang: int = 60) -> Model:
    """Fit on the given texts.  Languages with fewer than ``min_lang`` calibration rows, or one label, stay at 0.5; those
    of others lean to the common threshold as far as they have few toxic rows."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.int64)
    if len(y) < 4 or y.min() == y.max():
        model = _new_model(rng, 8.0 if len(y) and y.min() == 1 else -8.0)
        model.out[:] = 0
        return model
    model = _new_model(rng, float(np.log(y.mean() / (1 - y.mean()))))
    feats = _features_of(texts)
    aside = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        own = rng.permutation(np.flatnonzero(y == label))
        aside[own[::CALIBRATE] if len(own) >= CALIBRATE else own[:0]] = True
    learn, held = np.flatnonzero(~aside), np.flatnonzero(aside)
    offset = np.array([model.out_bias], dtype=np.float32)
    adam = Adam([*model.conv.values(), *model.bias.values(), model.out, offset], RATE)
    seen = np.zeros(model.emb.shape, dtype=np.float32)
    for _ in range(epochs):
        order = rng.permutation(learn)
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            f, row = _batch(feats, pick)
            if not len(f):
                continue
            dense, words, gx = _gradients(model, f, row, y[pick])
            adam.update(dense)
            model.out_bias = float(offset[0])
            for k in range(f.shape[1]):
                bucket, back = np.unique(f[words, k], return_inverse=True)
                g = np.zeros((len(bucket), DIM), dtype=np.float32)
                np.add.at(g, back, gx)
                seen[k][bucket] += g * g
                model.emb[k][bucket] -= WORD_RATE * g / (np.sqrt(seen[k][bucket]) + 1e-8)
    raw = np.concatenate([np.empty(0)] + [model.logits(model.pooled(*_batch(feats, held[k : k + 64]), len(held[k : k + 64]))) for k in range(0, len(held), 64)])
    model.shift = best_cut(raw, y[held])
    by_lang = np.array([x or "" for x in langs])[held]
    for lang in sorted(set(by_lang)):
        own, toxic = by_lang == lang, int(y[held][by_lang == lang].sum())
        if own.sum() >= min_lang and 0 < toxic < own.sum():
            cut = (best_cut(raw[own], y[held][own]) - model.shift) * toxic / (toxic + PRIOR_ROWS)
            model.thresholds[str(lang)] = float(sigmoid(np.array(cut)))
    return model


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo 5: fold 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, toxic, lang: at most ``rows`` labelled rows outside fold 0, by hash of their id.

    Of rows that repeat a doc_id the least text counts, of its labels the toxic one, so the sample does not depend on how
    the tables are read; lang is null where ``docs`` has none."""
    own = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 0)
    chosen = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), lang.alias("lang")).filter(F.octet_length("text") <= max_bytes)
    met = texts.join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x")).select("doc_id", "x.text", "toxic", "x.lang")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """Train on the sample in one task, in an order that does not depend on how the tables are partitioned.

    ``rows`` texts of at most ``max_bytes`` come to that task; that bounds the sample, not what is scored.  The driver gets
    the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((*x[:3], x[3] or "") for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True))
        model = train([x[1] for x in got], [x[2] for x in got], [x[3] for x in got])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    trained = map_arrow(training_rows(docs, labels, rows, max_bytes).repartition(1), run, "model binary").first()
    return pickle.loads(trained.model) if trained else train([], [], [])


def _score(model, text_at: int, carry: bool):
    """Scores of the text column ``text_at``, lower-cased a slice at a time; the columns go along if ``carry``, else the
    first one does.  A text crosses to Python once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            column = batch.column(text_at)
            out = [np.empty(0)]
            for a, b in slices(buffers(pc.fill_null(column, ""))[1], SLICE):
                data, offs = buffers(pc.utf8_lower(pc.fill_null(column.slice(a, b - a), "")))
                words = Words(data, offs)
                out.append(sigmoid(m.logits(m.pooled(features(words), words.row, b - a)).astype(np.float64)))
            n = batch.num_columns if carry else 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(np.concatenate(out), pa.float64())], [*batch.schema.names[:n], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Null texts are empty; texts without words get the score of an empty text; equal texts and repeated rows get equal
    scores; very long texts are scored whole, a slice of rows at a time; a null doc_id is in no fold; an empty table gives an
    empty table.  Only the text enters a score, whatever other columns there are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scored = map_arrow(rows, _score(shared, 1, False), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold of their language (0.5 where it, or the column, is
    missing).  Columns keep their names, types and order, clashing ones too; null and empty texts score as empty ones;
    repeated rows stay or go together."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    types = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(cols))
    cuts = F.lit(0.5)
    for lang, cut in sorted(model.thresholds.items()):
        cuts = F.when(F.col(f"c{cols.index('lang')}") == lang, cut).otherwise(cuts) if "lang" in cols else cuts
    kept = map_arrow(plain, _score(shared, cols.index("text"), True), f"{types}, score double").filter(F.col("score") < cuts)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)])
