"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased, white space is made single spaces and the ends are padded, so that n-grams see word ends.
N-grams are hashed into 2**BITS buckets; a bucket counts once per document.

Training takes at most ``sample`` labelled rows, chosen by a hash of the id. One pass over their texts counts, for each
bucket and class, the documents that have it; the counts are summed in the tasks and in a second step, so the driver
gets a fixed number of arrays. From them follow the smoothed log-count ratios r, and the ``features`` buckets whose
ratio is most certain. A second pass gives each sampled document's chosen buckets; over these, scaled by r, the driver
fits a logistic regression by Newton steps with conjugate gradients (at most sample x features two-byte numbers).
Toxic rows are few, so even odds are not the best place to divide: two more models, each of one half's ratios and
rows, score the other half, and the bias is moved to where those scores divide the classes best (by F1).

Scoring is one pass over all texts with a broadcast table of 2**BITS weights. Texts are read whole, ``CHUNK`` characters at
a time; n-grams over the seams are kept by an overlap, so that the cuts change nothing.

Defined results: a null text is empty, and the empty text gets the model's score for no n-gram; labels other than 0 and 1
(null ones too) and null ids of labels are left out, and of labels that repeat an id the larger counts; with no row or only one class to learn from,
every score is the share of class 1 (0.5 without rows); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learns, materialize, text_of, tree_sum
from .memory import release

BITS = 18
SIZES = (4, 5)
BLANKS = re.compile("[\x20\x09-\x0d]+")
#: Characters hashed at once; n-grams over the seams are kept by an overlap.
CHUNK = 1 << 18


def bucket_pieces(text: str, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> Iterator[np.ndarray]:
    """The buckets of all character n-grams of a text, repeats included, chunk by chunk."""
    overlap = max(sizes) - 1
    tail, blank = " ", True
    for at in range(0, max(len(text), 1), CHUNK):
        # Of the letters only sigma is lower-cased by what stands around it; here it is always the same.
        new = BLANKS.sub(" ", text[at : at + CHUNK].replace("\u03a3", "\u03c3").lower())
        if blank and new.startswith(" "):
            new = new[1:]
        blank = new.endswith(" ") if new else blank
        if at + CHUNK >= len(text) and not blank:
            new += " "
        seen = len(tail) if at else 0
        clean = tail + new
        codes = np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint32) * np.uint32(0x9E3779B1)
        for size in sizes:
            # Those that end within the tail were in the chunk before.
            own = codes[max(seen - size + 1, 0) :]
            if len(own) >= size:
                n = len(own) - size + 1
                h = own[:n].copy()
                for k in range(1, size):
                    h *= np.uint32(0x01000193)
                    h ^= own[k : k + n]
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B + 2 * size)
                yield h >> np.uint32(32 - bits)
        tail = clean[-overlap:]


def ngram_buckets(text: str, sizes: tuple[int, ...] = SIZES, bits: int = BITS) -> np.ndarray:
    """The distinct buckets of all character n-grams of a text, in order."""
    found = np.zeros(0, np.uint32)
    for piece in bucket_pieces(text, sizes, bits):
        found = np.unique(np.concatenate([found, piece]))
    return found


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  #: by bucket, 0 for those not chosen
    bias: float

    def score(self, text: str) -> float:
        found = np.zeros(0, np.uint32)
        for piece in bucket_pieces(text):
            piece = piece[self.weights[piece] != 0]
            if len(piece):
                found = np.unique(np.concatenate([found, piece]))
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(dtype=np.float64), -30, 30))))


def sampled_labels(labels: DataFrame, label: str, id_col: str, folds: int, held_out: int, sample: int) -> DataFrame:
    """(id, y, half): at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of the id."""
    known = labels.where(F.col(f"`{label}`").cast("int").isin(0, 1) & learns(F.col(f"`{id_col}`"), folds, held_out))
    one = known.groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("y"))
    one = one.withColumn("half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int"))
    return materialize(one.orderBy(F.xxhash64(F.col("_id"), F.lit("sample")), "_id").limit(sample), "sampled-labels")


def _fit(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, penalty: float, steps: int = 12) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features times ``scale``: weights of the scaled features, bias."""
    at = np.concatenate(rows).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = scale[at]
    n, m = len(rows), len(scale)
    times = lambda w: np.bincount(doc, value * w[at], n)
    back = lambda g: np.bincount(at, value * g[doc], m)
    w, b = np.zeros(m), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(w) + b, -30, 30)))
        g, gb = back(p - y) + penalty * w, float((p - y).sum())
        if np.sqrt(g @ g + gb * gb) < 1e-4 * n:
            break
        d = np.maximum(p * (1 - p), 1e-6)
        x, xb = np.zeros(m), 0.0
        r, rb = -g, -gb
        s, sb, rr = r.copy(), rb, r @ r + rb * rb
        for _ in range(30):
            t = d * (times(s) + sb)
            hs, hb = back(t) + penalty * s, float(t.sum())
            a = rr / max(s @ hs + sb * hb, 1e-300)
            x, xb, r, rb = x + a * s, xb + a * sb, r - a * hs, rb - a * hb
            new = r @ r + rb * rb
            if new < 1e-8 * (g @ g + gb * gb):
                break
            s, sb, rr = r + new / rr * s, rb + new / rr * sb, new
        w, b = w + x, b + xb
    return w, b


def sampled_texts(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str, sample: int) -> DataFrame:
    """(text, y, half), written: at most ``sample`` texts of the ids in ``chosen`` (as many rows at most), each once per id.

    An id may have any number of rows: equal ones are put together in the tasks, and of the others those of least hash are
    taken, by hash alone.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    first = [F.first(c).alias(c) for c in ("_text", "y", "half")]
    texts = materialize(rows.groupBy("_id", F.sha2(F.col("_text").cast("binary"), 256).alias("_digest")).agg(*first), "labelled-texts")
    taken = texts.select("_id", "_digest").orderBy(F.xxhash64("_id", "_digest"), "_id", "_digest").limit(sample)
    return materialize(texts.join(F.broadcast(taken), ["_id", "_digest"]).select("_text", "y", "half"), "toxicity-sample")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", folds: int = 5, held_out: int = 0, sample: int = 20_000, features: int = 4096, penalty: float = 1.0) -> ToxicityModel:
    """Learn from at most ``sample`` labelled texts outside the held-out fold."""
    chosen = sampled_labels(labels, label, id_col, folds, held_out, sample)
    texts = sampled_texts(docs, chosen, id_col, text_col, sample)
    n_buckets = 1 << BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By half and class: documents with each bucket, and at the end all documents.
        total, some = np.zeros((2, 2, n_buckets + 1), np.int64), False
        for batch in batches:
            for text, y, half in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                total[half, y, ngram_buckets(text.as_py())] += 1
                total[half, y, n_buckets] += 1
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    total = tree_sum(texts.mapInArrow(count, "v binary"), 4 * (n_buckets + 1), "<i8", fan_in=8).reshape(2, 2, n_buckets + 1)
    n0, n1 = total[:, :, n_buckets].sum(0).tolist()
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.5
        return ToxicityModel(np.zeros(n_buckets, np.float32), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))

    def ratios(count: np.ndarray) -> np.ndarray:
        share = (count[:, :n_buckets] + 1) / (count[:, n_buckets:] + 2)
        return np.log(share[1] / share[0])

    both = total.sum(0)
    ratio, doubt = ratios(both), np.sqrt((1 / (both[:, :n_buckets] + 1)).sum(0))
    top = np.argsort(-np.abs(ratio) / doubt, kind="stable")[:features]
    top = np.sort(top[both[:, top].sum(0) > 0])
    place = np.full(n_buckets, -1, np.int32)
    place[top] = np.arange(len(top))
    placed = docs.sparkSession.sparkContext.broadcast(place)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [placed.value[ngram_buckets(x.as_py())] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array([x[x >= 0].astype("<u2").tobytes() for x in own], pa.binary())], ["y", "half", "at"])

    picked = texts.mapInArrow(pick, "y int, half int, at binary").collect()
    y, half = np.array([r.y for r in picked], np.float64), np.array([r.half for r in picked])
    at = [np.frombuffer(bytes(r["at"]), "<u2") for r in picked]
    weights, bias = _fit(at, y, ratio[top], penalty)
    weights = weights * ratio[top]
    apart = np.full(len(y), np.nan)
    for k in range(2):
        own = np.flatnonzero(half == k)
        if 0 < y[own].sum() < len(own):
            scale = ratios(total[k])[top]
            w, b = _fit([at[i] for i in own], y[own], scale, penalty)
            apart[half != k] = [b + (w * scale)[at[i]].sum() for i in np.flatnonzero(half != k)]
    table = np.zeros(n_buckets, np.float32)
    table[top] = weights
    return ToxicityModel(table, bias - dividing_score(y[~np.isnan(apart)], apart[~np.isnan(apart)]))


def dividing_score(y: np.ndarray, score: np.ndarray) -> float:
    """Where to divide ``score`` for the best F1 of class 1: midway to the next; 0 if there is only one class."""
    if y.sum() in (0, len(y)):
        return 0.0
    order = np.argsort(-score, kind="stable")
    hits = np.cumsum(y[order])
    k = int((2 * hits / (np.arange(1, len(y) + 1) + y.sum())).argmax())
    return float((score[order[k]] + score[order[min(k + 1, len(y) - 1)]]) / 2)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) for each document."""
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), text_of(text_col).alias("_text"))
    kind = rows.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [sent.value.score(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [id_col, "score"])
        release()

    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double").withColumn("predicted", predicted(F.col("score")))


def predicted(score: Column) -> Column:
    return F.when(score >= 0.5, 1).otherwise(0)
