"""Quality scores of texts: n-gram indicators scaled by class log-count ratios under a linear hinge-loss model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, give_back, put, small, worker_cache
from .wordhash import mix, text_bytes, words

BITS = 18             # log2 of the number of hashed features
BLOCK = 1 << 12       # features whose counts travel together
MAX_FIT = 12_000      # expected number of labelled rows that the linear model is fitted on; counts use all of them
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 30
BATCH = 128           # texts whose features are held at once

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once: words, pairs of words, and pairs of word shapes.

    A shape is what a word looks like: its length class, letter case, digits, its last mark, and whether it repeats the
    word before it or one met before in the last few.
    """
    h, s, e = words(data, offsets)
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none
    doc = np.searchsorted(offsets, s, "right") - 1
    length = e - s
    count = lambda table: np.concatenate([[0], np.cumsum(table[data])])
    upper, digit, mark = (c[e] - c[s] for c in (count(_UPPER), count(_DIGIT), count(_MARK)))
    last = np.where(_MARK[data[e - 1]], data[e - 1], 0).astype(np.uint64)
    shape = np.minimum(length, 31) // 4 + 8 * np.minimum(upper, 2) + 32 * (digit > 0) + 64 * np.minimum(mark, 3) + 256 * (upper == length)
    again = np.zeros(len(h), np.int64)
    for back in (1, 2, 3):
        again[back:] |= ((h[back:] == h[:-back]) & (doc[back:] == doc[:-back])) * (1 << min(back - 1, 1))
    shape = mix((shape.astype(np.uint64) << np.uint64(16)) + (last << np.uint64(4)) + again.astype(np.uint64) + np.uint64(1))
    same = doc[1:] == doc[:-1]
    three, one = np.uint64(3), np.uint64(0x9E3779B97F4A7C15)
    parts = [h, mix(h[:-1] * three + h[1:] * one)[same], mix(shape), mix(shape[:-1] * three + shape[1:] * one + three)[same]]
    owner = [doc, doc[1:][same], doc, doc[1:][same]]
    size = doc[-1] + 1
    words_in = np.bincount(doc, minlength=size)
    lengths = np.minimum(np.log2(np.maximum(words_in, 1)).astype(np.int64), 15)
    parts.append(mix(lengths.astype(np.uint64) + np.uint64(977)))
    owner.append(np.arange(size))
    keys = np.unique((np.concatenate(owner).astype(np.int64) << BITS) + (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def text_features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Features of a column, some texts at a time: the index of the first, text indices from there, features."""
    worker_cache("quality")
    for begin in range(0, len(column), BATCH):
        data, offsets = text_bytes(column.slice(begin, BATCH))
        yield begin, *_features(data, offsets)


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for begin, text, feature in text_features(batch.column(0)):
            own = label[begin + text]
            for c in (0, 1):
                counts[c] += np.bincount(feature[own == c], minlength=1 << BITS)
    rows = [(b // BLOCK, counts[:, b:b + BLOCK].astype("<i8").tobytes()) for b in range(0, 1 << BITS, BLOCK) if counts[:, b:b + BLOCK].any()]
    cols = list(zip(*rows)) or [(), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.binary())], ["block", "counts"])


def _sum_block(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(2 * BLOCK, np.int64)
    for batch in batches:
        for part in batch.column("counts"):
            total += np.frombuffer(part.as_py(), "<i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["block", "counts"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[bytes] = [b""] * batch.num_rows
        for begin, text, feature in text_features(batch.column(0)):
            at = np.searchsorted(text, np.arange(min(BATCH, batch.num_rows - begin) + 1))
            for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
                out[begin + i] = feature[a:b].astype("<i4").tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["label", "pick", "features"])


def fit_hinge(rows: list[np.ndarray], label: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for a linear model under hinge loss; rows are unit vectors of the scaled indicators."""
    weight, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] for r in rows]
    for v in values:  # in place: together they are the largest thing in the driver
        v /= max(np.sqrt((v * v).sum()), 1e-9)
    sign = np.where(label > 0, 1.0, -1.0)
    square = np.array([float((v * v).sum()) + 1.0 for v in values])
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            slope = sign[i] * (weight[rows[i]] @ values[i] + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            step = (new - dual[i]) * sign[i]
            if step:
                weight[rows[i]] += step * values[i]
                bias += step
                worst = max(worst, abs(step))
                dual[i] = new
        if worst < 1e-3:
            break
    return weight, bias


def _calibrate(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps on smoothed targets."""
    up, down = (label > 0).sum(), (label <= 0).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        w = np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return (a, b) if np.isfinite(a + b) and a > 0 else (1.0, 0.0)


@dataclass
class QualityModel:
    scaled: np.ndarray   # weight times ratio of each feature
    square: np.ndarray   # squared ratio, for the length of a row
    bias: float
    slope: float
    shift: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.zeros(len(column))
        for begin, text, feature in text_features(column):
            n = min(BATCH, len(column) - begin)
            dot = np.bincount(text, self.scaled[feature], minlength=n)
            norm = np.sqrt(np.bincount(text, self.square[feature], minlength=n))
            out[begin:begin + n] = dot / np.maximum(norm, 1e-9) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))


def fit_quality(labelled: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", max_fit: int = MAX_FIT) -> QualityModel:
    """Learn from (id, text, label 0/1). Log-count ratios come from every row; the linear model from about ``max_fit`` rows.

    The rows of the fit are picked by a hash of the id, so they are the same in every run. A fifth of them sets the
    curve from margins to scores. Without rows of both classes the score is the share of class 1, or 0.5.
    """
    rows = columns_of(labelled, text_col, label_col, id_col).where(F.col(label_col).isin(0, 1))
    rows = rows.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"), F.pmod(F.xxhash64(id_col), F.lit(1 << 30)).alias("pick"))
    counts = np.zeros((2, 1 << BITS), np.int64)
    summed = rows.select("text", "label").mapInArrow(_class_counts, "block int, counts binary").groupBy("block").applyInArrow(_sum_block, "block int, counts binary")
    for r in summed.collect():
        counts[:, r.block * BLOCK:(r.block + 1) * BLOCK] = np.frombuffer(r.counts, "<i8").reshape(2, BLOCK)
    seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(seen.values())
    if len(seen) < 2:
        share = min(max(seen.get(1, 0) / total, 0.01), 0.99) if total else 0.5
        none = np.zeros(1 << BITS)
        return QualityModel(none, none, 0.0, 1.0, float(np.log(share / (1 - share))))
    share = counts + SMOOTHING
    ratio = np.log(share[1] / share[1].sum()) - np.log(share[0] / share[0].sum())
    ratio[counts.sum(axis=0) == 0] = 0
    keep = int(min(1.0, max_fit / total) * (1 << 30))
    picked = rows.where(F.col("pick") < keep).mapInArrow(_rows, "label int, pick long, features binary").collect()
    picked.sort(key=lambda r: (r.pick, r.label, bytes(r.features)))
    features = [np.frombuffer(r.features, "<i4") for r in picked]
    label = np.array([r.label for r in picked])
    del picked
    test = np.arange(len(features)) % 5 == 4
    weight, bias = fit_hinge([f for f, t in zip(features, test) if not t], label[~test], ratio)
    model = QualityModel(weight * ratio, ratio * ratio, bias, 1.0, 0.0)
    margin = np.array([(model.scaled[f].sum() / max(np.sqrt(model.square[f].sum()), 1e-9)) + bias for f, t in zip(features, test) if t])
    if len(margin):
        model.slope, model.shift = _calibrate(margin, label[test])
    del features
    give_back()  # else the rows' memory stays with the driver for as long as it runs
    return model


def score(spark, model: QualityModel, text: Column) -> Column:
    """Score of a text column in [0, 1]; null is an empty text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(shared.value.scores(pa.array(texts, pa.large_string(), from_pandas=True)))
    return run(text)


def held_out(ident: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id's text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_classifier(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", max_fit: int = MAX_FIT) -> DataFrame:
    """``docs`` with held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= 0.5, else 0).

    The model sees texts only. Labels are joined by id, from rows that are not held out; a label that is null or not
    0 or 1 is left out, repeated labels and rows count as often as they occur. Null and empty texts get the score of a
    text without features. A null id is never held out and has no label. Input columns of the new names give way; an
    empty table gives an empty table.
    """
    have = {c.lower(): c for c in docs.columns}
    ident = F.col(f"`{have[id_col.lower()]}`")
    marked = columns_of(labels, id_col, label_col).select(F.col(id_col).alias("_lid"), F.col(label_col).alias("label")).where(~held_out(F.col("_lid")) & F.col("_lid").isNotNull() & F.col("label").isin(0, 1))
    known = columns_of(docs, id_col, text_col).join(small(marked), F.col(id_col) == F.col("_lid")).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), "label")
    model = fit_quality(known, max_fit=max_fit)
    out = put(docs, held_out=held_out(ident), score=score(docs.sparkSession, model, F.col(f"`{have[text_col.lower()]}`")))
    return put(out, predicted=(F.col("score") >= 0.5).cast("int"))
