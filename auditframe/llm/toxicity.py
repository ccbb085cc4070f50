"""Toxicity by compression distance: how much shorter windows of a text become under a dictionary trained on toxic text.

Two zstandard dictionaries are trained, one on the toxic and one on the ordinary documents of a bounded sample of labelled
training rows (about ``SAMPLE`` of each label, by a hash of the id).  The library's own trainer picks what is frequent,
which in both classes is the same ordinary language (on the test tables its dictionaries found 27 of 100 toxic documents at 6
false alarms); so segments (words, and beginnings of words) are chosen by the contrast of their document frequencies between the
classes.  Both dictionaries end in the same common segments and in ordinary segments that resemble toxic ones, so that a
difference of compressed lengths comes from toxic segments alone.

A window is one word behind a fixed lead-in, which both dictionaries hold.  Its gain is the length under the ordinary
dictionary less that under the toxic one.  A text is described by the number and the share of its windows that reach the
``GAINS``; a logistic curve fitted on the sample calibrates the thresholds and turns this into a score.

Null and empty texts have no window and get the score of a text without any gain.  Labels other than 0 and 1 train nothing;
without toxic or without ordinary training rows every score is 0.  Repeated rows are scored each for itself.
"""

from __future__ import annotations

import dataclasses
import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from auditframe.llm.common import ascii_words, cut_lineage, held_out, pick, table

SAMPLE = 6000
SEGMENTS, COMMON, ALIKE, LEAST_DOCS, LEAST_ODDS, LEAST_Z = 400, 300, 600, 5, 3.5, 5.0
GRAM = 6  # bytes that an ordinary segment shares with a toxic one that it resembles; also the shortest match
GAINS, THRESHOLD = (2, 3, 4, 6), 0.5
PARTS = 2 * len(GAINS) + 1
_STRIP = b".,;:!?\"'()[]{}|*&$%#"
_CACHE_ROWS = 600_000


def segments(words: list[bytes]) -> set[bytes]:
    """Words and beginnings of words of a text, behind the space that begins them."""
    out = set()
    for w in set(words):
        w = w.strip(_STRIP)
        if 2 <= len(w) <= 24:
            out.add(b" " + w + b" ")
            for k in range(3, min(8, len(w))):
                out.add(b" " + w[:k])
    return out


@dataclasses.dataclass(frozen=True)
class Dictionaries:
    """Contents of both dictionaries, and the words that lead a window in."""

    toxic: bytes
    ordinary: bytes
    lead: bytes

    def gains(self) -> "Gains":
        return _gains(self)


class Gains:
    """Gain of each window, remembered by word."""

    def __init__(self, d: Dictionaries):
        self.lead, self.known = d.lead, {}
        self.toxic, self.ordinary = _compressor(d.toxic), _compressor(d.ordinary)

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            g = known.get(w)
            if g is None:
                window = self.lead + b" " + w + b" "
                g = len(self.ordinary(window)) - len(self.toxic(window))
                if len(w) <= 48:
                    if len(known) >= _CACHE_ROWS:
                        known.clear()
                    known[w] = g
            out.append(g)
        return np.array(out, np.int64)


@functools.lru_cache(maxsize=4)
def _gains(d: Dictionaries) -> Gains:
    return Gains(d)


def _compressor(content: bytes):
    """Compressed frames without any header bytes that do not depend on the window."""
    how = zstandard.ZstdCompressionParameters.from_level(
        3, strategy=zstandard.STRATEGY_LAZY2, min_match=GRAM, search_log=6, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0
    )
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress


def sample_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` training ids of each label (all, if fewer), by a hash of the id that stays below a share of its range."""
    own = labels.filter(F.col("label").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    n = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    span = 1 << 31
    part = lambda k: int(span * min(1.0, sample / max(1, n.get(k, 0))))
    return own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < F.when(F.col("label") == 1, part(1)).otherwise(part(0)))


def train_dictionaries(sampled: DataFrame) -> Dictionaries | None:
    """Contrast segment frequencies over the sampled (text, label) rows; only the chosen segments reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[label].update(segments(ascii_words(t)))
            for counts, label in zip(seen, (0, 1)):
                if counts:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array([label] * len(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["segment", "label", "docs"])

    unique = sampled.dropDuplicates(["text", "label"])  # copies of one text count once
    n = {r["label"]: r["n"] for r in unique.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return None
    counts = unique.select("text", "label").mapInArrow(count, "segment binary, label int, docs bigint")
    by = counts.groupBy("segment").agg(F.sum(F.when(F.col("label") == 1, F.col("docs")).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 0, F.col("docs")).otherwise(0)).alias("o"))
    t, o = F.col("t") / n[1], F.col("o") / n[0]
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("o") + 0.5) / (n[0] + 1))
    z = (t - o) / F.sqrt((F.col("t") + F.col("o")) / (n[0] + n[1]) * (1 / n[0] + 1 / n[1]))
    least = min(LEAST_DOCS, n[1])
    by = cut_lineage(by.filter(F.col("t") + F.col("o") >= least).select("segment", "t", "o", odds.alias("odds"), z.alias("z")))
    toxic = by.filter((F.col("t") >= least) & (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "segment").limit(SEGMENTS)
    chosen = [bytes(r["segment"]) for r in toxic.collect()]
    grams = {s[i : i + GRAM] for s in chosen for i in range(len(s) - GRAM + 1)}

    def resembles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([any(s[i : i + GRAM] in grams for i in range(len(s) - GRAM + 1)) for s in b.column(0).to_pylist()], pa.bool_()))

    plain = by.filter(F.col("odds") < 1).select("segment", "o")
    best = lambda df, k: b"".join(bytes(r["segment"]) for r in reversed(df.orderBy(F.desc("o"), "segment").limit(k).collect()))
    # the best segments stand last, nearest to the window
    base = best(plain.mapInArrow(resembles, "segment binary, o bigint"), ALIKE) + best(plain, COMMON)
    own = b"".join(reversed(chosen))
    return Dictionaries(own + base, bytes([1]) * len(own) + base, base[-24:])


def describe(gains: np.ndarray) -> list[float]:
    """Logarithm of the number of windows with each gain, whether there is any, and the share of the second."""
    counts = [int((gains >= g).sum()) for g in GAINS]
    return [*np.log1p(counts).tolist(), *(float(c > 0) for c in counts), float(np.sqrt(counts[1] / max(1, len(gains))))]


def with_gains(docs: DataFrame, d: Dictionaries, text: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns (without the text, unless it is kept), and ``__g0``, ``__g1``, ..."""
    rest = [c for c in docs.columns if keep_text or c != text]
    schema = docs.select(*(f"`{c}`" for c in rest)).schema
    for i in range(PARTS):
        schema = schema.add(f"__g{i}", DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = d.gains()
        for b in batches:
            x = np.array([describe(gains(ascii_words(t))) for t in b.column(b.schema.get_field_index(text)).to_pylist()], float).reshape(-1, PARTS)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), *map(pa.array, x.T)], names=[*rest, *(f"__g{i}" for i in range(PARTS))])

    return docs.mapInArrow(run, schema)


def fit_curve(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on the sampled descriptions (equal weight of the classes' base rates kept); mean, scale, weights."""
    x = np.array([[r[f"__g{i}"] for i in range(PARTS)] for r in rows], float)
    y = np.array([r["label"] for r in rows], float)
    n = np.array([r["n"] for r in rows], float)
    mean, scale = np.average(x, axis=0, weights=n), np.sqrt(np.average((x - np.average(x, axis=0, weights=n)) ** 2, axis=0, weights=n)) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(PARTS + 1)
    ridge = np.diag([1.0] * PARTS + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (n * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge, z.T @ (n * (p - y)) + ridge @ w)
        w -= np.clip(step, -2, 2)
    return mean, scale, w


@dataclasses.dataclass(frozen=True)
class Classifier:
    dictionaries: Dictionaries
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scored(self, docs: DataFrame, keep_text: bool = False) -> DataFrame:
        """The columns of documents (text), ``__score`` and ``__predicted``."""
        own = [c for c in docs.columns if keep_text or c != "text"]
        z = sum(((F.col(f"__g{i}") - float(self.mean[i])) / float(self.scale[i]) * float(self.weights[i]) for i in range(PARTS)), F.lit(float(self.weights[PARTS])))
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        rows = with_gains(docs, self.dictionaries, keep_text=keep_text).withColumn("__score", score)
        return rows.select(*(f"`{c}`" for c in own), "__score", (F.col("__score") >= THRESHOLD).cast("int").alias("__predicted"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier | None:
    """Fit on documents (doc_id, text) with labels (doc_id, label); None where a class has no training row."""
    chosen = cut_lineage(sample_labels(labels, sample))  # about 2 * sample ids
    sampled = cut_lineage(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label"))
    d = train_dictionaries(sampled)
    if d is None:
        return None
    cells = with_gains(sampled, d).groupBy("label", *(F.round(f"__g{i}", 3).alias(f"__g{i}") for i in range(PARTS))).agg(F.count("*").alias("n"))
    return Classifier(d, *fit_curve(cells.collect()))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) for documents (doc_id, text); labels (doc_id, label)."""
    own = docs.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "text")
    model = train(docs, labels, sample)
    if model is None:
        return own.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    return model.scored(own).withColumnsRenamed({"__score": "score", "__predicted": "predicted"})


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    model = train(docs, labels)
    return docs if model is None else model.scored(docs, keep_text=True).filter("__predicted = 0").drop("__score", "__predicted")


def op3_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return score_documents(docs, pick(table(spark, sf_dir, "labels"), doc_id="doc_id", label="toxic"))


QUERIES = {"op3_compression_toxicity": op3_compression_toxicity}
ORACLES: dict[str, str] = {}
