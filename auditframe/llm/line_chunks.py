"""Removal of repeated passages of lines.

A passage is a run of whole lines of at least ``LEAST_BYTES`` bytes that stands in more than one place, in whatever
surroundings.  From every line, and back from every line, the shortest run of that size is a window (a line of that size is one
by itself).  The windows of a passage depend on its own lines alone and cover all of them: a line behind the first window of the
passage has that many bytes of it before it, so the window back from it lies inside.  Windows whose digest comes more than once
anywhere are compared by bytes with the first of them (in the order of a hash of the document, then of place).  A line goes where
it lies in a window equal to an earlier one, unless it is part of the first copy of another passage; so every passage keeps a
whole first copy.  A window whose bytes differ (a hash collision) stays.  Blank lines begin and end no window; they go with the
passage around them.  Lines end with a newline, which belongs to its line; the rest of the text is left exactly as it was.

What was cut is counted in content-defined chunks: a rolling hash over the last ``WINDOW`` line hashes sets a boundary where it is
0 modulo ``DIVISOR``.  A run of lines that went counts as the chunks of at least ``LEAST_LINES`` lines in it whose bounds follow from its own lines
alone, or as one.

Nulls: a null text stays null and holds no passage; an empty text stays empty.  A null doc_id is an id like others.  Rows that
repeat both doc_id and text are one document: what stays of it stays in each of them.  No row is ever dropped: a document of
which all lines are cut keeps an empty text.  A text with a single line is a document, not a passage in one: it counts as a first
copy, and its copies are left to the removal of duplicate documents.  All other columns pass through (names beginning with ``__``
are ours).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.llm.common import cut_lineage, table

WINDOW, DIVISOR, LEAST_LINES, LEAST_BYTES = 2, 3, 2, 40
_BASE = np.uint64(0x9E3779B97F4A7C15)


def line_ends(data: bytes) -> np.ndarray:
    """The end of each line of the text, in bytes."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(data) else np.append(ends, len(data))


def chunk_bounds(data: bytes) -> list[tuple[int, int, int]]:
    """(begin, end, lines) of each chunk of the text, in bytes."""
    if not data:
        return []
    ends = line_ends(data)
    begins = np.append(0, ends[:-1])
    # the newline is left out, so that a passage at the end of a text has the same boundaries
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b].rstrip(b"\n")) for a, b in zip(begins.tolist(), ends.tolist())), np.uint64, len(ends))
    rolled = hashes.copy()
    for k in range(1, WINDOW):  # polynomial over the last WINDOW line hashes, modulo 2 ** 64
        rolled[k:] = rolled[k:] + hashes[:-k] * np.uint64(pow(int(_BASE), k, 1 << 64))
    last = np.append(np.flatnonzero((rolled >> np.uint64(33)) % np.uint64(DIVISOR) == 0), len(ends) - 1)
    last = np.unique(last)
    first = np.append(0, last[:-1] + 1)
    return [(int(begins[f]), int(ends[l]), int(l - f + 1)) for f, l in zip(first, last)]


def _map(df: DataFrame, schema: str, rows_of, inputs: int) -> DataFrame:
    """Rows out of (row number, other inputs, ...) by a Python function over Arrow batches."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.strip().split(" ")[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for given in zip(*(b.column(i).to_pylist() for i in range(inputs))) for r in rows_of(*given)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return df.mapInArrow(run, schema)


def passage_windows(data: bytes) -> list[tuple[int, int, int, int]]:
    """(first line, last line, begin, end) of each window of the text; the end leaves out the closing newline."""
    if len(data) < LEAST_BYTES:
        return []
    ends = line_ends(data)
    begins = np.append(0, ends[:-1])
    filled = np.array([n for n, (a, b) in enumerate(zip(begins.tolist(), ends.tolist())) if data[a:b].strip()], np.int64)
    begins, stops = begins[filled], ends[filled] - (np.frombuffer(data, np.uint8)[ends[filled] - 1] == 10)
    n = np.arange(len(filled))
    last, first = np.searchsorted(stops, begins + LEAST_BYTES), np.searchsorted(begins, stops - LEAST_BYTES, "right") - 1
    found = {*zip(n[last < len(n)].tolist(), last[last < len(n)].tolist()), *zip(first[first >= 0].tolist(), n[first >= 0].tolist())}
    return [(int(filled[f]), int(filled[l]), int(begins[f]), int(stops[l])) for f, l in sorted(found)]


def without_lines(data: bytes, cuts: list[tuple[int, int]], stay: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without the lines of ``cuts`` that are in none of ``stay`` (first line, last line), and the chunks that went."""
    ends = line_ends(data)
    begins = np.append(0, ends[:-1])
    gone = np.zeros(len(ends) + 1, bool)
    for runs, value in ((cuts, True), (stay, False)):
        for first, last in runs:
            gone[first : last + 1] = value
    before = None  # blank lines go between lines that went
    for n in range(len(ends)):
        if data[begins[n] : ends[n]].strip():
            if before is not None and gone[n] and gone[before]:
                gone[before:n] = True
            before = n
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)))
    sized = [(a, b) for a, b, lines in chunk_bounds(data) if lines >= LEAST_LINES and b - a >= LEAST_BYTES]
    # a boundary follows from a run where all lines of its rolling hash lie in it
    runs = [(int(begins[f + WINDOW]) if f + WINDOW < l else len(data), int(ends[l - 1])) for f, l in zip(edges[::2], edges[1::2])]
    kept = b"".join(data[begins[n] : ends[n]] for n in np.flatnonzero(~gone[:-1]).tolist())
    return kept, sum(max(1, sum(f <= a and b <= l for a, b in sized)) for f, l in runs)


def _digests(a: int, b: int, text: str | None):
    data = (text or "").encode("utf-8", "surrogatepass")
    more = int(b"\n" in data.strip())  # 0: the whole document is a single line
    for first, last, begin, end in passage_windows(data):
        yield a, b, more, first, last, np.uint64(xxhash.xxh3_64_intdigest(data[begin:end])).astype(np.int64).item()


def _texts(a: int, b: int, text: str, marks: list[dict]):
    data = text.encode("utf-8", "surrogatepass")
    at = {(first, last): (begin, end) for first, last, begin, end in passage_windows(data)}
    for m in marks:
        begin, end = at[m["line"], m["last"]]
        yield a, b, m["line"], m["last"], m["digest"], int(m["is_first"]), data[begin:end]


def _edited(text: pd.Series, cut: pd.Series, cut_to: pd.Series, stay: pd.Series, stay_to: pd.Series) -> pd.DataFrame:
    out = []
    for t, *runs in zip(text, cut, cut_to, stay, stay_to):
        if t is None:
            out.append((None, 0))
            continue
        kept, chunks = without_lines(t.encode("utf-8", "surrogatepass"), list(zip(*runs[:2])), list(zip(*runs[2:])))
        out.append((kept.decode("utf-8", "surrogatepass"), chunks))
    return pd.DataFrame(out, columns=["__kept", "__cut"])


def dedupe_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with repeated passages cut out of their texts; adds the number of chunks removed as ``__removed``."""
    # a document is its id and text, as two 64-bit hashes: the same in every job, unlike a row number
    k = ["__a", "__b"]
    own = docs.withColumns({"__a": F.xxhash64(F.col(key), F.col(text)), "__b": F.xxhash64(F.lit(1), F.col(text), F.col(key))})
    slim = own.select(*k, F.col(text).alias("t"))
    windows = cut_lineage(_map(slim, "__a bigint, __b bigint, more int, line int, last int, digest bigint", _digests, 3))
    # documents of a single line come first, as they are never cut
    keyed = windows.select("*", F.struct("more", "__a", "__b", "line").alias("at"))
    firsts = keyed.groupBy("digest").agg(F.min("at").alias("first"), F.max("at").alias("end")).filter("first < end AND end.more = 1")
    firsts = cut_lineage(firsts.select("digest", "first"))
    # a passage may come as often as it likes: two plain shuffles, so that the rows of one digest can be split
    is_first = F.col("at") == F.col("first")
    marks = keyed.join(firsts, "digest").filter((F.col("more") == 1) | is_first).select(*k, F.struct("line", "last", "digest", is_first.alias("is_first")).alias("mark"))
    by_document = cut_lineage(marks.groupBy(*k).agg(F.collect_set("mark").alias("marks")))
    # only documents that hold a repeated window go on; always by a shuffle, as the other side grows with the corpus
    concerned = slim.join(by_document.hint("shuffle_hash"), k).dropDuplicates(k).select(*k, "t", "marks")
    texts = cut_lineage(_map(concerned, "__a bigint, __b bigint, line int, last int, digest bigint, is_first int, passage binary", _texts, 4))
    models = texts.filter("is_first = 1").select("digest", F.col("passage").alias("model"))
    same = texts.filter("is_first = 0").join(models, "digest").filter(F.col("passage") == F.col("model")).select(*k, "line", "last", F.lit(0).alias("stays"))
    runs = same.unionByName(texts.filter("is_first = 1").select(*k, "line", "last", F.lit(1).alias("stays")))
    of = lambda stays: F.collect_set(F.when(F.col("stays") == stays, F.struct("line", "last")))
    drops = cut_lineage(runs.groupBy(*k).agg(of(0).alias("__cuts"), of(1).alias("__stay")).filter(F.size("__cuts") > 0))
    joined = own.join(drops.hint("shuffle_hash"), k, "left")
    given = [F.when(F.col("__cuts").isNotNull(), F.col(f"`{text}`")), *(F.col(c) for c in ("__cuts.line", "__cuts.last", "__stay.line", "__stay.last"))]
    joined = joined.withColumn("__edited", F.pandas_udf(_edited, "__kept string, __cut int")(*given))
    columns = [F.when(F.col("__edited.__cut") > 0, F.col("__edited.__kept")).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.coalesce("__edited.__cut", F.lit(0)).alias("__removed"))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, its code points, and how many chunks were cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedupe_lines(docs).select("doc_id", "text", F.char_length("text").cast("bigint").alias("n_chars"), F.col("__removed").alias("chunks_removed"))


QUERIES = {"op10_line_chunks": op10_line_chunks}
ORACLES: dict[str, str] = {}
