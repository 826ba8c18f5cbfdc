"""Quality: random Fourier features of document statistics, ridge scores, isotonic calibration.

A document becomes ``STATISTICS``: shares of kinds of characters, repetition of words and lines, and lengths, computed
in one pass over whole texts. Scaled by the training rows' means and deviations they go through cosines at
random frequencies, whose products approximate a Gaussian kernel. Each task sums its rows' normal equations, the sums
are summed in a second step, and the driver solves one system of fixed size. A part of the training rows is left
out of the equations; on it, scores are mapped to shares of good documents by isotonic regression over fixed bins.

All labelled rows outside the held-out fold are learned from; labels meet the statistics by id, no texts shuffle.

Defined results: a null text is empty, and the empty text gets the score of its statistics (all 0); labels other
than 0 and 1 (null ones too) and null ids of labels are left out, and of labels that repeat an id the larger counts; with no row or only one class to learn
from, every score is the share of class 1 (0.5 without rows); an empty table gives an empty result; extra columns are
ignored by ``score_quality`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import learns, materialize, text_of, tree_sum, word_slices
from .memory import map_texts, release
from .toxicity import predicted

STATISTICS = (
    "log_chars log_words log_lines upper digits spaces marks pipes exclamations ends other non_ascii control word_length word_spread "
    "long_words distinct_words top_word same_as_before mixed_words repeated_lines line_words short_lines byte_entropy"
).split()
BINS = 2000
#: Bytes of a text cut into words at once.
SLICE = 1 << 19


def document_statistics(text: str) -> list[float]:
    """The values of ``STATISTICS`` of one whole text. Its words are seen slice by slice; distinct words and lines are held."""
    raw = text.encode("utf-8", "replace")
    if not raw.strip():
        return [0.0] * len(STATISTICS)
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda chars: float(count[list(chars)].sum()) / n
    kinds: Counter = Counter()
    n_words, total, squares, long_words, same, before = 0, 0, 0, 0, 0, []
    for words in word_slices(raw, SLICE):
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n_words, total, squares, long_words = n_words + len(words), total + int(sizes.sum()), squares + int((sizes * sizes).sum()), long_words + int((sizes > 20).sum())
        same += sum(map(bytes.__eq__, before + words, (before + words)[1:]))
        before = words[-1:] or before
        kinds.update(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    in_lines = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
    share = count[count > 0] / n
    letters = sum(x.isalpha() for x in kinds)
    mean = total / n_words
    return [
        np.log1p(n), np.log1p(n_words), np.log1p(len(lines)),
        of(range(65, 91)), of(range(48, 58)), of(b" \t\r\n\x0b\f"), of(b"#$%&*+=<>@^_~\\"), of(b"|"), of(b"!"), of(b".,;:?"), of(b"\"'()[]{}/-`"),
        of(range(128, 256)), of([*range(9), *range(14, 32), 127]),
        mean, max(squares / n_words - mean * mean, 0.0) ** 0.5, long_words / n_words, len(kinds) / n_words, max(kinds.values()) / n_words,
        same / n_words, 1 - letters / len(kinds),
        1 - len(set(lines)) / len(lines), float(np.log1p(in_lines.mean())), float((in_lines < 4).mean()), float(-(share * np.log2(share)).sum()),
    ]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats array<double>), one row per document."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [document_statistics(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.list_(pa.float64()))], ["id", "stats"])
        release()

    return map_texts(rows, run, f"id {kind}, stats array<double>")


def _stats(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    edges: np.ndarray  #: ridge scores at which ``shares`` hold; between them they are interpolated
    shares: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        scaled = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[np.sqrt(2 / len(self.phases)) * np.cos(scaled @ self.frequencies + self.phases), np.ones(len(x))]

    def score(self, x: np.ndarray) -> np.ndarray:
        """A thousandth of the ridge score keeps the order within calibrated steps."""
        raw = np.clip(self.features(x) @ self.weights, -0.5, 1.5)
        return 0.999 * np.interp(raw, self.edges, self.shares) + 0.001 * (raw + 0.5) / 2


def isotonic(good: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ``good`` in ``all_``, by pooling adjacent violators; bins without rows take part in none."""
    pools: list[list[float]] = []
    for i in np.flatnonzero(all_):
        pools.append([good[i], all_[i], [i]])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g, a, at = pools.pop()
            pools[-1] = [pools[-1][0] + g, pools[-1][1] + a, pools[-1][2] + at]
    out = np.full(len(all_), np.nan)
    for g, a, at in pools:
        out[at] = g / a
    return out


def fit_quality(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", folds: int = 3, held_out: int = 1, features: int = 256, width: float = 0.12, ridge: float = 1e-3, seed: int = 5) -> QualityModel:
    """Learn from the labelled rows outside the held-out fold. ``stats``: (id, stats), a written table."""
    y = F.col(f"`{label}`").cast("int")
    known = labels.where(y.isin(0, 1) & learns(F.col(f"`{id_col}`"), folds, held_out)).groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(y).alias("y"))
    own = stats.join(known, F.col("id") == F.col("_id")).select("stats", "y", (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("calibrates"))
    own = materialize(own, "quality-training")
    m = len(STATISTICS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * m + 2)
        for batch in batches:
            x, y = _stats(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            total += np.r_[x.sum(0), (x * x).sum(0), len(y), y.sum()]
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["v"])

    total = tree_sum(own.mapInArrow(moments, "v binary"), 2 * m + 2, "<f8")
    n, good = total[-2], total[-1]
    mean = total[:m] / max(n, 1)
    spread = np.sqrt(np.maximum(total[m : 2 * m] / max(n, 1) - mean**2, 1e-12))
    spread[spread < 1e-6] = 1
    rng = np.random.default_rng(seed)
    blank = QualityModel(mean, spread, rng.normal(size=(m, features)) * np.sqrt(2 * width), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0, 1.0]), np.full(2, good / n if n else 0.5))
    if good in (0, n):
        return blank
    d = features + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zz, zy = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            use = ~batch.column(2).to_numpy(zero_copy_only=False)
            z, y = blank.features(_stats(batch.column(0))[use]), batch.column(1).to_numpy(zero_copy_only=False)[use]
            zz, zy = zz + z.T @ z, zy + z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([np.r_[zz.ravel(), zy].astype("<f8").tobytes()], pa.binary())], ["v"])

    total = tree_sum(own.mapInArrow(equations, "v binary"), d * d + d, "<f8", fan_in=8)
    zz, zy = total[: d * d].reshape(d, d), total[d * d :]
    weights = np.linalg.solve(zz + ridge * max(zz[-1, -1], 1) * np.diag(np.r_[np.ones(features), 1e-9]) + 1e-9 * np.eye(d), zy)
    linear = QualityModel(mean, spread, blank.frequencies, blank.phases, weights, blank.edges, blank.shares)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS))
        for batch in batches:
            use = batch.column(2).to_numpy(zero_copy_only=False)
            raw = np.clip(linear.features(_stats(batch.column(0))[use]) @ weights, -0.5, 1.5)
            at, y = np.minimum(((raw + 0.5) / 2 * BINS).astype(int), BINS - 1), batch.column(1).to_numpy(zero_copy_only=False)[use]
            total += np.array([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary())], ["v"])

    good_in, all_in = tree_sum(own.mapInArrow(counts, "v binary"), 2 * BINS, "<f8").reshape(2, BINS)
    edges = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    if all_in.sum():
        shares = isotonic(good_in, all_in)
    else:
        shares = np.clip(edges, 0, 1)
    seen = ~np.isnan(shares)
    return QualityModel(mean, spread, blank.frequencies, blank.phases, weights, edges[seen], shares[seen])


def score_statistics(stats: DataFrame, model: QualityModel, id_col: str = "doc_id") -> DataFrame:
    """(id_col, score, predicted) of (id, stats)."""
    kind = stats.schema["id"].dataType.simpleString()
    sent = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(_stats(batch.column(1))))], [id_col, "score"])

    return stats.select("id", "stats").mapInArrow(run, f"`{id_col}` {kind}, score double").withColumn("predicted", predicted(F.col("score")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, score, predicted) for each document, learned from ``labels`` (id_col, quality)."""
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    return score_statistics(stats, fit_quality(stats, labels, id_col, **options), id_col)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows predicted to be of class 0; the columns stay as they are. Texts don't shuffle: each row
    is scored where it lies, by the model learned from a first pass."""
    stats = materialize(statistics(docs, id_col, text_col), "statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit_quality(stats, labels, id_col, **options))

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([document_statistics(t.as_py() or "") for t in batch.column(at)], np.float64).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.value.score(x) >= 0.5)).select(range(n))
        release()

    # Columns go by place, so that names that clash or repeat do no harm.
    n, at = len(docs.columns), docs.columns.index(text_col)
    placed = docs.toDF(*[f"c{i}" for i in range(n)])
    if docs.schema[at].dataType != StringType():
        # A text that is a string is sent once.
        placed, at = placed.withColumn("text", text_of(f"c{at}")), n
    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return map_texts(placed, good, kinds).toDF(*docs.columns)
