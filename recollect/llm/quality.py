"""Quality classifier: random Fourier features over document statistics, ridge scores from partition-summed normal
equations, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import pieces
from .worker import frugal, release
from .workspace import materialize, scratch

STATISTICS = (
    "log_words", "word_length", "long_words", "upper", "digits", "marks", "odd_marks", "beyond_ascii", "distinct", "top_word", "top_three",
    "doubled", "line_length", "lines_again", "sentence_ends", "one_letter",
)
COMPONENTS, RIDGE, SEED, BINS = 256, 1e-3, 20_240_229, 400
#: Labelled documents that a filter is fitted on, about; of more, a share by hash of the id is taken.
FIT_ROWS = 500_000
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_USUAL = b".,;:'\"!?()-"
_ODD = bytes(b for b in _MARKS if b not in _USUAL)
_HIGH = bytes(range(128, 256))


def statistics(text: bytes | None) -> list[float]:
    """The numbers in STATISTICS for one whole text; all 0 for null, empty and blank texts."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, size = len(words), len(text)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    counts = Counter(words)
    top = [c for _, c in counts.most_common(3)]
    lines = text.split(b"\n")
    letters = sum(map(len, words))
    return [
        math.log1p(n),
        letters / n,
        sum(len(w) > 20 for w in counts) / len(counts),
        share(_UPPER),
        share(_DIGITS),
        share(_MARKS),
        share(_ODD),
        share(_HIGH),
        math.log1p(len(counts)) / math.log1p(n),
        top[0] / n,
        sum(top) / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        math.log1p(size / len(lines)),
        1 - len(set(lines)) / len(lines),
        (text.count(b".") + text.count(b"!") + text.count(b"?")) / n,
        sum(c for w, c in counts.items() if len(w) == 1) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, x): a row per row of docs."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            made = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "x"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass(frozen=True)
class QualityModel:
    """Everything scoring needs; a few hundred numbers."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = fourier(x, self.mean, self.scale) @ self.weights
        return np.clip(np.interp(raw, self.knots, self.levels), 0.0, 1.0)

    def column(self, text: Column) -> Column:
        """The score of a text column; a text at a time becomes an object of its own."""
        model = self

        @F.arrow_udf("double")
        def quality_score(texts: pa.Array) -> pa.Array:
            release()
            made = np.empty((len(texts), len(STATISTICS)))
            for i, t in enumerate(texts):
                made[i] = statistics(t.as_py())
            return pa.array(model.score(made), pa.float64())

        return quality_score(text.cast("binary"))


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """cos(Wz + b) with a fixed seed, whose inner products approach a Gaussian kernel of width sqrt(dimensions); the
    last column is the constant."""
    rng = np.random.default_rng(SEED)
    w = rng.standard_normal((len(STATISTICS), COMPONENTS)) / math.sqrt(len(STATISTICS))
    b = rng.uniform(0, 2 * math.pi, COMPONENTS)
    z = np.clip((x - mean) / scale, -5, 5)
    return np.hstack([np.cos(z @ w + b) * math.sqrt(2 / COMPONENTS), np.ones((len(x), 1))])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3).cast("int")


def _solve(gram: np.ndarray) -> np.ndarray:
    n = max(gram[-1, -2], 1.0)  # the constant's square is the number of rows
    a, b = gram[:, :-1], gram[:, -1]
    return np.linalg.solve(a + RIDGE * n * np.eye(len(a)) / COMPONENTS, b)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic regression of values with weights, in order."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> QualityModel:
    """Fit on the labelled rows of folds 0 and 2; rows of fold 1, null labels and labels without a document are unused.

    The normal equations are summed over partitions, one row of the matrix per key; the calibration counts labels in
    BINS bins of the raw score that the model of the other fold gives. Without labels of both kinds the score is the
    labels' mean, or 0.5.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull())
    train = materialize(stats.where(fold(F.col("doc_id")) != 1).join(known, "doc_id").select("x", "y", fold(F.col("doc_id")).alias("fold")), "quality-train")
    moments = train.agg(F.count("*"), F.avg("y"), *[f(F.col("x")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    n, prior = moments[0], moments[1]
    mean = np.array([v or 0.0 for v in moments[2::2]])
    scale = np.maximum([v or 0.0 for v in moments[3::2]], 1e-6)
    if not n or prior in (0.0, 1.0):
        level = 0.5 if prior is None else prior
        return QualityModel(mean, scale, np.zeros(COMPONENTS + 1), np.array([0.0, 1.0]), np.array([level, level]))

    @frugal
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = {}
        for batch in batches:
            x, y, of = np.array(batch.column(0).to_pylist(), float), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for k in np.unique(of):
                z = fourier(x[of == k], mean, scale)
                grams[k] = grams.get(k, 0) + z.T @ np.hstack([z, y[of == k, None]])
        for k, g in grams.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(g), pa.int32()), pa.array(range(len(g)), pa.int32()), pa.array(list(g), pa.list_(pa.float64()))], ["fold", "i", "row"])

    summed = train.mapInArrow(sums, "fold int, i int, row array<double>").groupBy("fold", "i").agg(vector_to_array(Summarizer.sum(array_to_vector(F.col("row")))).alias("row")).collect()
    grams = {k: np.zeros((COMPONENTS + 1, COMPONENTS + 2)) for k in (0, 2)}
    for r in summed:
        grams[r["fold"]][r["i"]] = r["row"]
    other = {0: _solve(grams[2]), 2: _solve(grams[0])}
    low, width = -0.5, 2.0 / BINS

    @frugal
    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, of = np.array(batch.column(0).to_pylist(), float), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            z = fourier(x, mean, scale)
            raw = np.where(of == 0, z @ other[0], z @ other[2])
            at = np.clip((raw - low) / width, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(y, pa.float64())], ["bin", "y"])

    bins = sorted(train.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")).collect())
    counts, hits = np.array([b["n"] for b in bins], float), np.array([b["y"] for b in bins])
    levels = pool_adjacent(hits / counts, counts)
    knots = low + width * (np.array([b["bin"] for b in bins]) + 0.5)
    return QualityModel(mean, scale, _solve(grams[0] + grams[2]), knots, levels)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of docs.

    The statistics of every whole text are computed once and written; the fit and the scores both read them. Null and
    empty texts have statistics of 0 and a score like any other; repeated rows score alike; an empty table gives no
    rows. Other columns of docs are never read.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-statistics")
    with scratch(docs.sparkSession):
        model = fit(stats, labels, id_col, label_col)

    @F.pandas_udf("double")
    def scored(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(x.to_list(), float).reshape(-1, len(STATISTICS))))

    rows = stats.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), scored("x").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that score `least` or more, with the columns of docs.

    The fit reads only documents that have a label, at most about FIT_ROWS; then every text is read once, scored and
    kept or left out, with no join. Null and empty texts have a score like any other, so do rows with a null id;
    repeated rows fare alike; without usable labels every score is 0.5; an empty table gives no rows.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (fold(F.col(id_col)) != 1))
    ids = usable.select(F.col(id_col).alias("doc_id")).distinct()
    slots = 1 << 30
    taken = F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < F.lit(slots) * F.lit(float(FIT_ROWS)) / F.greatest(F.lit(ids.count()), F.lit(1))
    with scratch(docs.sparkSession):
        # eight bytes for each of about FIT_ROWS ids
        ids = materialize(ids.where(taken), "quality-ids")
        known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
        model = fit(materialize(document_statistics(known, "doc_id", "text"), "quality-statistics"), labels, id_col, label_col)
    return docs.where(model.column(F.col(text_col)) >= least)
