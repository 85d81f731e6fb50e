"""Quality classifier by co-training.

Two views of a document are learnt apart: the text (hashed words and shape figures) and
the page metadata (language, source, length).  Over a few rounds each view labels the
unlabelled documents of a pool about which it is confident, for the other view to learn
from.  The views' scores are calibrated on held-out labels and combined by a logistic
model of the two calibrated log-odds, which then scores every document.

What is fitted on the driver is a bounded sample: at most ``labelled`` labelled documents
and a pool of ``pool`` others (Blum and Mitchell's U'), both chosen by a hash of the id.
Scoring maps all documents with a broadcast of the weights, whose size is fixed by
``BUCKETS``; there is no shuffle of texts.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, fresh, release, text_buffer, word_hashes, words_of
from .decontaminate import WORD_BYTES

BUCKETS = 1 << 14
META = 1 << 10


@dataclass(frozen=True)
class Settings:
    labelled: int = 8000          # most labelled documents that are fitted on
    pool: int = 4000              # unlabelled documents offered for pseudo-labels
    rounds: int = 3
    confident: float = 0.97       # calibrated probability of a class from which a view's label is passed on
    pseudo_weight: float = 0.5    # of a pseudo-label against a given one
    held_out: int = 4             # one labelled document in so many is for calibration
    threshold: float = 0.5        # a document is accepted from this probability of being good


# --- features ---------------------------------------------------------------------------------------------------------

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SIGN = np.zeros(256, bool)
for _a, _b in ((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E)):
    _SIGN[_a:_b + 1] = True
_PLAIN_SIGN = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"()-?"])
SHAPES = 10


def text_features(col: pa.Array):
    """(document, bucket, value) of the hashed words, log of 1 + count, and a row of shape figures per document."""
    data, offs = text_buffer(col)
    n = len(offs) - 1
    flat, starts, ends, first = words_of(data, offs, WORD_BYTES)
    h = word_hashes(flat, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(first))
    key, count = np.unique(doc.astype(np.int64) * BUCKETS + (h >> np.uint64(64 - 14)).astype(np.int64), return_counts=True)
    total = lambda flag: np.diff(np.concatenate([[0], np.cumsum(flag)])[offs]).astype(float)
    chars, words = np.maximum(np.diff(offs), 1), np.maximum(np.diff(first), 1)
    upper, digit, sign = _UPPER[data], _DIGIT[data], _SIGN[data]
    distinct = np.bincount(key // BUCKETS, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, key // BUCKETS, count)
    again = np.zeros(len(h), bool)
    if len(h):
        again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    repeats = np.bincount(doc, again, minlength=n)
    size = np.bincount(doc, ends - starts, minlength=n)
    shape = np.stack([
        np.log1p(words), distinct / words * 2, most / words * 4, repeats / words * 4, total(upper) / chars * 8,
        total(digit) / chars * 8, total(sign) / chars * 8, total(sign & ~_PLAIN_SIGN[data]) / chars * 16,
        size / words / 4, total(data == 10) / words * 4], axis=1)
    shape[np.diff(first) == 0, 1:] = 0
    return (key // BUCKETS).astype(np.int64), (key % BUCKETS).astype(np.int64), np.log1p(count), shape


def _slot(kind: str, value) -> int:
    return zlib.crc32(f"{kind}={value}".encode("utf-8", "replace")) % META


def meta_features(langs: list, sources: list, chars: list) -> np.ndarray:
    """Four hashed one-hot slots per document: language, source, length class, language with length class."""
    out = np.zeros((len(langs), 4), np.int64)
    for k, (lang, source, n) in enumerate(zip(langs, sources, chars, strict=True)):
        size = None if n is None else int(max(n, 0)).bit_length()
        out[k] = _slot("lang", lang), _slot("source", source), _slot("size", size), _slot("both", (lang, size))
    return out


# --- logistic regression on sparse rows ------------------------------------------------------------------------------

def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class Sparse:
    """Rows as (row, column, value) triples sorted by row."""

    def __init__(self, row, col, val, n, width):
        self.row, self.col, self.val, self.n, self.width = row, col, val, n, width

    def times(self, w):
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, g):
        return np.bincount(self.col, self.val * g[self.row], self.width)

    def take(self, keep):
        """The rows of a boolean mask."""
        new = np.cumsum(keep) - 1
        m = keep[self.row]
        return Sparse(new[self.row[m]], self.col[m], self.val[m], int(keep.sum()), self.width)


def _stack(parts: list[Sparse]) -> Sparse:
    base = np.cumsum([0] + [p.n for p in parts])
    return Sparse(np.concatenate([p.row + b for p, b in zip(parts, base[:-1], strict=True)]),
                  np.concatenate([p.col for p in parts]), np.concatenate([p.val for p in parts]), int(base[-1]), parts[0].width)


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 60, start=None) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression by limited-memory BFGS."""
    w = np.zeros(x.width + 1) if start is None else start.copy()
    scale = weight.sum() or 1.0

    def loss(w):
        z = x.times(w[:-1]) + w[-1]
        p = _sigmoid(z)
        value = (weight * (np.logaddexp(0, z) - y * z)).sum() / scale + ridge * (w[:-1] ** 2).sum() / 2
        g = weight * (p - y) / scale
        return value, np.append(x.back(g) + ridge * w[:-1], g.sum())

    value, grad = loss(w)
    past: list = []
    for _ in range(steps):
        d, used = -grad, []
        for s, t, r in reversed(past):
            a = r * (s @ d)
            d = d - a * t
            used.append(a)
        if past:
            s, t, r = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, r), a in zip(past, reversed(used), strict=True):
            d = d + s * (a - r * (t @ d))
        step, slope = 1.0, grad @ d
        while step > 1e-6:
            new, new_grad = loss(w + step * d)
            if new <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = step * d, new_grad - grad
        if s @ t > 1e-12:
            past = [*past[-7:], (s, t, 1 / (s @ t))]
        done = value - new < 1e-7
        w, value, grad = w + s, new, new_grad
        if done:
            break
    return w


def calibrate(score: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(slope, offset) of Platt's map from scores to probabilities, with his smoothed targets."""
    if not len(y):
        return np.array([1.0, 0.0])
    good, bad = y.sum(), (1 - y).sum()
    target = np.where(y > 0.5, (good + 1) / (good + 2), 1 / (bad + 2))
    x = Sparse(np.arange(len(y)), np.zeros(len(y), np.int64), score, len(y), 1)
    w = fit(x, target, np.ones(len(y)), 1e-4, 100)
    return np.array([max(w[0], 0.0), w[1]])


# --- co-training ------------------------------------------------------------------------------------------------------

@dataclass
class Model:
    """Weights of both views, their calibration, and the combination of the two log-odds."""
    text: np.ndarray
    meta: np.ndarray
    text_cal: np.ndarray
    meta_cal: np.ndarray
    mixed: np.ndarray
    pseudo: tuple = ()

    def score(self, x_text: Sparse, x_meta: Sparse):
        """(probability by text, by metadata, combined)."""
        a = self.text_cal[0] * (x_text.times(self.text[:-1]) + self.text[-1]) + self.text_cal[1]
        b = self.meta_cal[0] * (x_meta.times(self.meta[:-1]) + self.meta[-1]) + self.meta_cal[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mixed[0] * a + self.mixed[1] * b + self.mixed[2])


def cotrain(x_text: Sparse, x_meta: Sparse, y: np.ndarray, s: Settings) -> Model | None:
    """``y``: 1 good, 0 bad, NaN unlabelled (the pool). None if either class has fewer than two labels."""
    known = np.flatnonzero(~np.isnan(y))
    if min((y[known] == 1).sum(), (y[known] == 0).sum()) < 2:
        return None
    hold, train = np.zeros(len(y), bool), np.zeros(len(y), bool)
    for cls in (0, 1):                                      # both parts hold both classes
        own = known[y[known] == cls]
        hold[own[::s.held_out]] = True
    train[known] = ~hold[known]
    pool = np.isnan(y)
    views = [(x_text, 1e-4), (x_meta, 1e-3)]
    given, extra, models, cals, passed = y[train], [None, None], [None, None], [None, None], []
    for turn in range(s.rounds + 1):
        for v, (x, ridge) in enumerate(views):
            rows, labels, weight = x.take(train), given, np.ones(len(given))
            if extra[v] is not None and extra[v][0].any():
                picked, guess = extra[v]
                rows = _stack([rows, x.take(picked)])
                labels, weight = np.append(given, guess[picked]), np.append(weight, np.full(picked.sum(), s.pseudo_weight))
            models[v] = fit(rows, labels, weight, ridge, 60 if turn == 0 else 25, models[v])
            cals[v] = calibrate(x.take(hold).times(models[v][:-1]) + models[v][-1], y[hold])
        if turn < s.rounds:
            for v, (x, _) in enumerate(views):
                p = _sigmoid(cals[v][0] * (x.times(models[v][:-1]) + models[v][-1]) + cals[v][1])
                sure = pool & ((p >= s.confident) | (p <= 1 - s.confident))
                extra[1 - v] = (sure, (p >= 0.5).astype(float))
            passed.append((int(extra[0][0].sum()), int(extra[1][0].sum())))
    odds = [cals[v][0] * (x.take(hold).times(models[v][:-1]) + models[v][-1]) + cals[v][1] for v, (x, _) in enumerate(views)]
    n = int(hold.sum())
    both = Sparse(np.repeat(np.arange(n), 2), np.tile([0, 1], n), np.stack(odds, 1).ravel(), n, 2)
    return Model(*models, *cals, fit(both, y[hold], np.ones(n), 1e-3, 100), tuple(passed))


def _sparse_text(doc, bucket, value, shape) -> Sparse:
    n = len(shape)
    row = np.concatenate([doc, np.repeat(np.arange(n), SHAPES)])
    return Sparse(row, np.concatenate([bucket, np.tile(BUCKETS + np.arange(SHAPES), n)]),
                  np.concatenate([value * 0.25, shape.ravel()]), n, BUCKETS + SHAPES)


def _sparse_meta(slots: np.ndarray) -> Sparse:
    return Sparse(np.repeat(np.arange(len(slots)), 4), slots.ravel(), np.ones(slots.size), len(slots), META)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", good: int = 1, settings: Settings = Settings(),
          id_col: str = "doc_id", text_col: str = "text", meta_cols: tuple = ("lang", "source", "n_chars")) -> Model | None:
    """Fit on the labelled sample and the pool. Labels that are null or of unknown documents are left out; a document
    labelled twice counts twice. None (every document is accepted) if a class has fewer than two labels."""
    ids = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull()) \
        .select(F.col(id_col).alias("id"), (F.col(target) == good).cast("double").alias("y"))
    chosen = ids.orderBy(F.xxhash64("id"), "id", "y").limit(settings.labelled)
    others = docs.select(F.col(id_col).alias("id")).where("id is not null").orderBy(F.xxhash64("id", F.lit(1)), "id") \
        .limit(settings.pool).select("id", F.lit(None).cast("double").alias("y"))
    kind = docs.schema[id_col].dataType
    sample = chosen.unionByName(others).withColumn("id", F.col("id").cast(kind))
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        *[F.col(c).alias(f"m{k}") for k, c in enumerate(meta_cols)])

    def features(col):
        doc, bucket, value, shape = text_features(col)
        at = np.searchsorted(doc, np.arange(len(shape) + 1))
        pack = lambda k: zlib.compress(bucket[at[k]:at[k + 1]].astype("<u2").tobytes()
                                       + value[at[k]:at[k + 1]].astype("<f4").tobytes() + shape[k].astype("<f4").tobytes(), 1)
        return pa.array([pack(k) for k in range(len(shape))], pa.binary())

    # the sample has at most labelled + pool short rows, so it is broadcast
    rows = append_column(plain.join(F.broadcast(sample), "id"), "x", T.BinaryType(), "text", features) \
        .select("id", "y", "m0", "m1", "m2", "x").toArrow().to_pydict()
    labelled = {i for i, y in zip(rows["id"], rows["y"], strict=True) if y is not None}
    keep = sorted((k for k, (i, y) in enumerate(zip(rows["id"], rows["y"], strict=True)) if y is not None or i not in labelled),
                  key=lambda k: (zlib.crc32(str(rows["id"][k]).encode()), str(rows["id"][k]), str(rows["y"][k]), rows["x"][k]))
    doc, bucket, value, shape = [], [], [], []
    for new, k in enumerate(keep):
        raw = zlib.decompress(rows["x"][k])
        n = (len(raw) - 4 * SHAPES) // 6
        bucket.append(np.frombuffer(raw, "<u2", n))
        value.append(np.frombuffer(raw, "<f4", n, 2 * n))
        shape.append(np.frombuffer(raw, "<f4", SHAPES, 6 * n))
        doc.append(np.full(n, new))
    if not keep:
        return None
    x_text = _sparse_text(np.concatenate(doc), np.concatenate(bucket).astype(np.int64), np.concatenate(value).astype(float),
                          np.array(shape, float))
    x_meta = _sparse_meta(meta_features(*[[rows[f"m{j}"][k] for k in keep] for j in range(3)]))
    y = np.array([np.nan if rows["y"][k] is None else rows["y"][k] for k in keep])
    return cotrain(x_text, x_meta, y, settings)


RESULT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "p_good")])


def score(docs: DataFrame, model: Model | None, out: str, text_col: str = "text",
          meta_cols: tuple = ("lang", "source", "n_chars")) -> DataFrame:
    """``docs`` with a struct column ``out``: p_text, p_meta, p_good. Without a model all three are 1.

    A null text counts as empty, null metadata as a value of its own. Repeated rows get equal scores; other columns
    pass through (``out`` must be new)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    row = fresh(docs, "quality_input")
    texts = F.struct(F.col(text_col).alias("text"), F.col(meta_cols[0]).cast("string").alias("a"),
                     F.col(meta_cols[1]).cast("string").alias("b"), F.col(meta_cols[2]).cast("long").alias("c"))

    def make(col):
        text, m = col.field(0), shared.value
        if m is None:
            p = [np.ones(len(col))] * 3
        else:
            p = m.score(_sparse_text(*text_features(text)),
                        _sparse_meta(meta_features(*[col.field(k).to_pylist() for k in (1, 2, 3)])))
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in p], names=RESULT.names)

    schema = T.StructType([*docs.schema.fields, T.StructField(out, RESULT)])
    given = docs.withColumn(row, texts)

    def run(batches):
        release()
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                col = part.column(part.num_columns - 1)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], make(col)], names=schema.names)

    return given.mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id",
              text_col: str = "text", meta_cols: tuple = ("lang", "source", "n_chars"), target: str = "quality",
              good: int = 1) -> DataFrame:
    """``docs`` without those that the classifier trained on the label column ``target`` rejects; columns unchanged."""
    out = fresh(docs, "quality_score")
    model = train(docs, labels, target, good, settings, id_col, text_col, meta_cols)
    return score(docs, model, out, text_col, meta_cols).where(F.col(out)["p_good"] >= settings.threshold).drop(out)
