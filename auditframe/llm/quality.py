"""Quality by a regularised quadratic discriminant over transformed document statistics.

Each whole text gives ``FEATURES`` (lengths, shares of kinds of characters, repetition, compressibility), transformed towards
normal distributions and scaled by mean and deviation over all training rows.  For both classes the first and second moments
are summed by Spark over every labelled training row; the covariances are shrunk towards the pooled one and its diagonal.
The score is a calibrated sigmoid of the difference of the log densities, whose Mahalanobis distances use Cholesky factors that
are worked out once and travel with the function.

Null texts are empty ones and get a score like any text.  Unlabelled rows (no label row, or a null label) train nothing; with
labels of fewer than two classes every score is the share of label 1 (0.5 without labels).  Repeated rows count each.
"""

from __future__ import annotations

import dataclasses
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType

from auditframe.llm.common import cut_lineage, held_out, pick, table

FEATURES = (
    "log_bytes", "log_words", "mean_word", "deviation_word", "upper", "digit", "symbol", "space", "newline", "not_ascii", "exclaim",
    "distinct_words", "same_as_last", "compressed", "longest_run", "one_letter_words",
)
SHRINK_POOLED, SHRINK_DIAGONAL, RIDGE = 0.1, 0.1, 1e-3
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[48:58] = 4
_KIND[128:] = 5  # the rest, 0, are symbols


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = len(data)
    words = data.split()
    m = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    a = np.frombuffer(data, np.uint8)
    per_byte = np.bincount(a, minlength=256)
    kinds = np.bincount(_KIND, weights=per_byte, minlength=6)
    lengths = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    distinct = len(set(words))
    same = sum(map(bytes.__eq__, words, words[1:]))
    runs = np.flatnonzero(np.diff(a) != 0)
    longest = int(np.diff(np.concatenate(([-1], runs, [n - 1]))).max())
    packed = len(zlib.compress(data, 1))
    root = np.sqrt
    return [
        np.log1p(n), np.log1p(m), np.log1p(lengths.mean()), np.log1p(lengths.std()), root(kinds[2] / n), root(kinds[4] / n), root(kinds[0] / n), root(kinds[1] / n),
        root(per_byte[10] / n), root(kinds[5] / n), root(per_byte[33] / n), np.log((distinct + 1) / (m + 1)) / max(1.0, np.log1p(m)), root(same / max(m, 1)),
        np.log((packed + 20) / (n + 20)), np.log1p(longest), root((lengths == 1).sum() / max(m, 1)),
    ]


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, and ``stats``."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest).schema.add("stats", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [list(map(float, statistics(t))) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            kept = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(stats, pa.list_(pa.float64()))], names=[*rest, "stats"])

    return docs.mapInArrow(run, schema)


@dataclasses.dataclass(frozen=True)
class Discriminant:
    """Class means, inverse Cholesky factors and log determinants of the scaled statistics, and the calibration."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray  # class, feature
    factors: np.ndarray  # class: inverse of the lower Cholesky factor
    log_dets: np.ndarray
    slope: float
    offset: float

    def margin(self, stats: np.ndarray) -> np.ndarray:
        """Log density under class 1 less that under class 0."""
        z = (stats - self.centre) / self.scale
        d = [((z - m) @ f.T) ** 2 for m, f in zip(self.means, self.factors)]
        return 0.5 * (d[0].sum(1) + self.log_dets[0] - d[1].sum(1) - self.log_dets[1])

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.slope == 0:
            return np.full(len(stats), 1 / (1 + np.exp(-self.offset)))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(stats) + self.offset, -40, 40)))


def fit(labelled: DataFrame) -> Discriminant:
    """Fit on (stats, label) rows: one aggregate for the moments of both classes, one for the calibration."""
    d = len(FEATURES)
    x = [F.col("stats")[i] for i in range(d)]
    moments = [F.count("*").alias("n"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(x[i] * x[j]).alias(f"q{i}_{j}") for i in range(d) for j in range(i + 1)]]
    by = {r["label"]: r for r in labelled.groupBy("label").agg(*moments).collect()}
    n = np.array([by[k]["n"] if k in by else 0 for k in (0, 1)], float)
    if n.min() < 2:
        share = (n[1] + 0.5) / (n.sum() + 1)
        zero = np.zeros((2, d))
        return Discriminant(np.zeros(d), np.ones(d), zero, np.stack([np.eye(d)] * 2), np.zeros(2), 0.0, float(np.log(share / (1 - share))))
    sums = np.array([[by[k][f"s{i}"] for i in range(d)] for k in (0, 1)])
    squares = np.zeros((2, d, d))
    for k in (0, 1):
        for i in range(d):
            for j in range(i + 1):
                squares[k, i, j] = squares[k, j, i] = by[k][f"q{i}_{j}"]
    centre = sums.sum(0) / n.sum()
    total = squares.sum(0) / n.sum() - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(total), 1e-12))
    means = (sums / n[:, None] - centre) / scale
    cov = np.stack([(squares[k] / n[k] - np.outer(sums[k], sums[k]) / n[k] ** 2) / np.outer(scale, scale) for k in (0, 1)])
    pooled = np.tensordot(n / n.sum(), cov, 1)
    cov = (1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled
    cov = np.stack([(1 - SHRINK_DIAGONAL) * c + SHRINK_DIAGONAL * np.diag(np.diag(c)) + RIDGE * np.eye(d) for c in cov])
    lower = np.linalg.cholesky(cov)
    model = Discriminant(centre, scale, means, np.linalg.inv(lower), 2 * np.log(np.diagonal(lower, axis1=1, axis2=2)).sum(1), 1.0, 0.0)
    slope, offset = calibrate(histogram(labelled, model))
    return dataclasses.replace(model, slope=slope, offset=offset)


def histogram(labelled: DataFrame, model: Discriminant) -> list[tuple[float, int, int]]:
    """(margin, label, rows) over a fixed number of cells of the squeezed margin; covers every training row."""

    def margins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array(b.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
            cell = np.round(np.arcsinh(model.margin(stats)) * 50).clip(-1000, 1000).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(1)], names=["cell", "label"])

    cells = labelled.select("stats", F.col("label").cast("int").alias("label")).mapInArrow(margins, "cell bigint, label int")
    return [(float(np.sinh(r["cell"] / 50)), r["label"], r["n"]) for r in cells.groupBy("cell", "label").agg(F.count("*").alias("n")).collect()]


def calibrate(cells: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and offset of the logistic curve through the margins (Newton steps, lightly ridged)."""
    m, y, n = (np.array(c, float) for c in zip(*cells))
    m = np.clip(m, -50, 50)
    w = np.array([0.1, 0.0])
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (n * (p - y)) + 1e-3 * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - np.clip(step, -1, 1)
    return float(max(w[0], 1e-3)), float(w[1])


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """The rows with ``score`` and ``predicted`` in place of the statistics."""
    rest = [c for c in stats.columns if c != "stats"]
    schema = stats.select(*rest).schema.add("score", DoubleType()).add("predicted", IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(b.schema.get_field_index("stats")).to_pylist(), float).reshape(-1, len(FEATURES))
            s = model.score(x)
            kept = [b.column(b.schema.get_field_index(c)) for c in rest]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*rest, "score", "predicted"])

    return stats.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on every labelled training row of documents (doc_id, text)."""
    known = labels.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).select("doc_id", F.col("label").cast("int").alias("label"))
    # statistics first: the join then moves a few numbers a document and no text
    stats = with_statistics(docs.select("doc_id", "text").filter(~held_out(F.col("doc_id"), 5, 0)))
    return fit(cut_lineage(stats.join(known, "doc_id").select("stats", "label")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for documents (doc_id, text); labels (doc_id, label)."""
    known = labels.filter(F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    own = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    stats = cut_lineage(with_statistics(own))  # one pass over the texts; training and scoring read the numbers
    model = fit(cut_lineage(stats.filter("NOT held_out").join(known, "doc_id").select("stats", "label")))
    return scored(stats, model)


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted to be of quality, with all their columns."""
    model = train(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t) for t in b.column(b.schema.get_field_index("text")).to_pylist()], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= THRESHOLD))

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return score_documents(docs, pick(table(spark, sf_dir, "labels"), doc_id="doc_id", label="quality"))


QUERIES = {"op2_quality_qda": op2_quality_qda}
ORACLES: dict[str, str] = {}
