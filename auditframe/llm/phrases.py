"""Phrase collocations by marginalising the longest windows: lead columns, padded windows, and one ROLLUP over them.

Every word of a piece of text opens one window of up to ``LONGEST`` words (its lead columns, padded where the piece ends).  Only these
windows are counted; ROLLUP sums them over successively shorter prefixes, so the count of a shorter phrase is the sum over
the windows that begin with it, and no n-gram of another length is ever spread out.

Most windows occur once and would all cross the network.  So behind its first word a window is padded from the end of its longest
beginning that occurs ``LEAST`` times or more, as do all its parts: nothing longer can be a candidate, lie in one, or be cut from
one, and all shorter prefixes keep their counts.  What is that frequent is told by counts over hash cells, first of pairs, then of the
longer phrases made of such pairs: never too low, so no candidate is lost, and where cells are shared something rare is merely
not padded away.  Cells are counted range by range in arrays of fixed size,
with ranges in proportion to the input's partitions; what is sent to every task is two bitmaps of 2 ** ``BITS`` bits, whatever the input.

Null texts are empty ones, a null lang counts as ``und``; repeated rows all count, doc_id is not used.  Ties of equal score and count go
by the phrase's UTF-8 bytes.  Words hold no space, so a phrase joined by spaces names its words.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditframe.llm.common import cut_lineage, pick, table

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
BITS, CELL = 27, 24  # bits of the bitmap's index, and of a cell within its range
SECTION, HELD, WORDS = 2_000_000, 1_500_000, 400_000  # bytes split, windows held and words remembered at once
_BREAKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", b"\xff" * 10)  # no UTF-8 text holds this byte
_GAP, _LEAD = re.compile(rb"[ \t\xff]"), re.compile(rb"(?:[ \t]+[^ \t\xff]+){0,%d}" % (LONGEST - 1))
_PASSES = [(1,), (2, 3)]  # what each bitmap tells of: pairs, then three and four words
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# ---------------------------------------------------------------- words of a task


def _sections(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(section, the words of the same piece that its last windows still need)."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + SECTION)
        end = gap.start() if gap else len(data)
        yield data[at:end], _LEAD.match(data, end).group()
        at = end


def _split(data: bytes) -> list[bytes]:
    return data.replace(b"\xff", b" \xff ").split()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], int]]:
    """(lang, words with a break between pieces, how many of them open a window) for sections of bounded size."""
    for b in batches:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            data = text.encode("utf-8", "surrogatepass").lower().translate(_BREAKS)
            if len(data) > SECTION:
                for own, lead in _sections(data):
                    words = _split(own)
                    yield lang, words + lead.split(), len(words)
                continue
            held.setdefault(lang, []).append(data)
            size[lang] = size.get(lang, 0) + len(data)
            if size[lang] > SECTION:
                words = _split(b"\xff".join(held.pop(lang)))
                size[lang] = 0
                yield lang, words, len(words)
        for lang, datas in held.items():
            words = _split(b"\xff".join(datas))
            yield lang, words, len(words)


def _ahead(x: np.ndarray, k: int) -> np.ndarray:
    """What stands ``k`` places on, nothing behind the end."""
    return np.concatenate([x[k:], np.zeros(min(k, len(x)), x.dtype)])


def _is_set(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITS)
    return (h > 0) & (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def _alive(found: list[np.ndarray], bitmaps: list[np.ndarray]) -> list[np.ndarray]:
    """Whether each place has a word, a frequent pair, and so on, all parts of it frequent; bitmaps are those of ``frequent_starts``."""
    out = [found[0] > 0]
    for bits, lengths in zip(bitmaps, _PASSES):
        for k in lengths:
            out.append(_is_set(bits, found[k]) & out[-1] & _ahead(out[-1], 1))
    return out


class _Codes(dict):
    """Numbers words from 1 in the order met; a break is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class _Lang:
    """The words and windows of one language that a task holds."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
        self.clear()

    def clear(self) -> None:
        self.codes, self.hash, self.parts, self.held = _Codes({b"\xff": 0}), np.zeros(1, np.uint64), [], 0

    def starts(self, words: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Codes of the words, and hashes of the word, the pair, and so on that begin at each (0 where a break comes before their end)."""
        code = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        fresh = [xxhash.xxh3_64_intdigest(w, self.seed) | 1 for w in itertools.islice(self.codes, len(self.hash), None)]
        self.hash = np.concatenate([self.hash, np.array(fresh, np.uint64)])
        found = [self.hash[code]]
        for k in range(1, LONGEST):
            x = found[-1] * _ODD[0] + _ahead(found[0], k) * _ODD[1]
            x = (x ^ (x >> np.uint64(29))) * _ODD[2]
            x = (x ^ (x >> np.uint64(32))) | np.uint64(1)
            found.append(x * ((found[-1] > 0) & (_ahead(found[0], k) > 0)))
        return code, found

    def full(self) -> bool:
        return self.held > HELD or len(self.codes) > WORDS


# ---------------------------------------------------------------- beginnings that are frequent enough


def frequent_starts(docs: DataFrame, least: int = LEAST, before: list[bytes] = ()) -> bytes:
    """Bitmap over hashes of pairs of neighbours, or with that bitmap of phrases of three and four words whose pairs are frequent.

    What occurs ``least`` times or more in its language has its bit set.
    """
    shared = docs.sparkSession.sparkContext.broadcast(list(before))
    tasks = max(1, docs.rdd.getNumPartitions())
    range_bits = min(12, max(8, tasks.bit_length()))
    local = BITS - range_bits
    schema = "range int, cells binary, counts binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(hashes: list[np.ndarray]) -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(hashes), return_counts=True)
            where, cell = (h >> np.uint64(64 - range_bits)).astype(np.int32), ((h >> np.uint64(64 - range_bits - CELL)) & np.uint64((1 << CELL) - 1)).astype(np.uint32)
            ends = np.flatnonzero(np.diff(where)) + 1
            packed = [(int(w[0]), zlib.compress(np.diff(c, prepend=c[:1]).tobytes() + c[:1].tobytes(), 1), zlib.compress(np.minimum(k, 255).astype(np.uint8).tobytes(), 1)) for w, c, k in zip(np.split(where, ends), np.split(cell, ends), np.split(n, ends)) if len(w)]
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in packed], pa.int32()), pa.array([p[1] for p in packed], pa.binary()), pa.array([p[2] for p in packed], pa.binary())], names=["range", "cells", "counts"])

        langs: dict[str, _Lang] = {}
        hashes, held = [np.zeros(0, np.uint64)], 0
        for lang, words, own in _words(batches):
            state = langs.setdefault(lang, _Lang(lang))
            found = state.starts(words)[1]
            alive = _alive(found, [np.frombuffer(x, np.uint8) for x in shared.value])[-1]
            counted = []
            for k in _PASSES[len(shared.value)]:
                alive = alive & _ahead(alive, 1)  # both shorter ones within it
                counted.append(found[k][:own][alive[:own]])
            hashes += counted
            held += sum(map(len, counted))
            if held > 2 * HELD:
                yield rows(hashes)
                hashes, held = [np.zeros(0, np.uint64)], 0
            if sum(len(s.codes) for s in langs.values()) > WORDS:
                langs.clear()
        yield rows(hashes)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, now = np.zeros(1 << CELL, np.uint32), None

        def done() -> pa.RecordBatch:
            bits = np.zeros(1 << local, bool)
            bits[np.flatnonzero(cells >= least) >> (CELL - local)] = True
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["range", "bits"])

        for b in batches:
            for i in range(b.num_rows):
                where, packed, counts = [c[i].as_py() for c in b.columns]
                if where != now:
                    if now is not None:
                        yield done()
                    now = where
                    cells[:] = 0
                steps = np.frombuffer(zlib.decompress(packed), np.uint32)
                at = np.cumsum(steps[:-1], dtype=np.uint32) + steps[-1]
                np.add.at(cells, at, np.frombuffer(zlib.decompress(counts), np.uint8).astype(np.uint32))
        if now is not None:
            yield done()

    counted = docs.mapInArrow(count, schema).repartition("range").sortWithinPartitions("range")
    bits = np.zeros((1 << range_bits, (1 << local) // 8), np.uint8)
    for row in counted.mapInArrow(mark, "range int, bits binary").toLocalIterator():  # 2 ** BITS bits in all
        bits[row["range"]] = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
    return bits.tobytes()


# ---------------------------------------------------------------- windows and their prefixes


def _grouped(w: list[np.ndarray], n: np.ndarray) -> list[np.ndarray]:
    """Columns of the distinct rows, and the sums of their numbers."""
    order = np.lexsort(w[::-1])
    w = [c[order] for c in w]
    opens = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in w])]))
    return [*[c[opens] for c in w], np.add.reduceat(n[order], opens)]


def longest_windows(docs: DataFrame, bitmaps: list[bytes]) -> DataFrame:
    """(lang, w1..w4, n): windows of the words of (lang, text), counted within each task."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmaps)
    names = [f"w{k + 1}" for k in range(LONGEST)]
    schema = "lang string, " + ", ".join(f"{w} string" for w in names) + ", n bigint"

    def counted(lang: str, state: _Lang) -> Iterator[pa.RecordBatch]:
        *w, n = _grouped(*[[np.concatenate(c) for c in zip(*state.parts)][k] for k in (slice(LONGEST), LONGEST)])
        words = pa.array([None, *list(state.codes)[1:]], pa.binary()).cast(pa.string())
        for at in range(0, len(n), 1 << 16):
            part = slice(at, at + (1 << 16))
            columns = [words.take(pa.array(c[part])) for c in w]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns, pa.array(n[part], pa.int64())], names=["lang", *names, "n"])
        state.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [np.frombuffer(x, np.uint8) for x in shared.value]
        langs: dict[str, _Lang] = {}
        for lang, words, own in _words(batches):
            state = langs.setdefault(lang, _Lang(lang))
            code, found = state.starts(words)
            # lead columns, padded from the break or the end of the longest frequent phrase on
            window = [_ahead(code, k) * here for k, here in enumerate(_alive(found, bits))]
            opens = np.flatnonzero(code[:own] > 0)
            if len(opens):
                state.parts.append(_grouped([c[opens] for c in window], np.ones(len(opens), np.int64)))
                state.held += len(state.parts[-1][0])
            if state.full():
                yield from counted(lang, state)
        for lang, state in langs.items():
            if state.parts:
                yield from counted(lang, state)

    return docs.select("lang", "text").mapInArrow(run, schema)


def phrase_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, words, phrase, f): all phrases of 1 to ``LONGEST`` words that occur ``least`` times, and one row of 0 words with the language's words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter(F.length("text") > 0)
    names = [f"w{k + 1}" for k in range(LONGEST)]
    short = frequent_starts(texts, least)
    windows = longest_windows(texts, [short, frequent_starts(texts, least, [short])]).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    summed = cut_lineage(windows).rollup("lang", *names).agg(F.sum("n").alias("f"), F.grouping_id().alias("missing"))
    words = F.lit(LONGEST) - F.bit_count("missing")
    # a window that is padded before the prefix ends does not hold such a phrase
    whole = (words == 0) | F.element_at(F.array(*names), F.greatest(words, F.lit(1))).isNotNull()
    rows = summed.withColumn("words", words).filter((F.col("words") >= 0) & whole & ((F.col("words") == 0) | (F.col("f") >= least)))
    return cut_lineage(rows.select("lang", "words", F.concat_ws(" ", *names).alias("phrase"), "f"))


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best candidates."""
    counts = phrase_counts(docs, least)
    known = counts.filter("words > 0")
    several = known.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cut = several.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    side = lambda name, f: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    sized = cut.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    score = F.expr("(CAST(a AS DECIMAL(38,0)) * 2000000) div (CAST(l AS DECIMAL(38,0)) + CAST(r AS DECIMAL(38,0)))")
    best = sized.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # the most frequent longer candidate around each shorter one
    inner = [F.when(F.col("words") > m, F.array(*[F.when(F.col("words") >= s + m - 1, part(F.lit(s), F.lit(m))) for s in range(1, LONGEST - m + 2)])) for m in range(2, LONGEST)]
    around = several.filter("words > 2").select("lang", "a", F.explode(F.array_compact(F.concat(*[F.coalesce(i, F.array().cast("array<string>")) for i in inner]))).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(around, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (_exact(F.col("longer")) * 100 < _exact(F.col("a")) * share))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= top)
    totals = counts.filter("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(pick(table(spark, sf_dir, "documents"), lang="lang", text="text"))


_PARTS = " UNION ALL ".join(f"SELECT lang, {' || chr(32) || '.join(f'w{i}' for i in range(1, k + 1))} AS phrase, {k} AS words, count(*) AS f FROM win WHERE w{k} IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}" for k in range(1, LONGEST + 1))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, words, f AS a, {k} AS k, array_to_string(string_split(phrase, ' ')[1:{k}], ' ') AS first, array_to_string(string_split(phrase, ' ')[{k + 1}:], ' ') AS rest FROM g WHERE words > {k}" for k in range(1, LONGEST))
_INNER = " UNION ALL ".join(f"SELECT lang, array_to_string(string_split(phrase, ' ')[{s}:{s + m - 1}], ' ') AS phrase, f FROM g WHERE words > {m} AND words >= {s + m - 1}" for m in range(2, LONGEST) for s in range(1, LONGEST - m + 2))
SQL = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
piece AS (SELECT lang, doc, unnest(p) AS t, generate_subscripts(p, 1) AS pc FROM (SELECT lang, doc, string_split_regex(t, '[.,;:!?\\x0A-\\x0D]') AS p FROM d)),
tok AS (SELECT lang, doc, pc, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT lang, doc, pc, regexp_extract_all(t, '[^\\x20\\x09]+') AS p FROM piece)),
win AS (SELECT lang, w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3, lead(w, 3) OVER z AS w4 FROM tok WINDOW z AS (PARTITION BY doc, pc ORDER BY i)),
total AS (SELECT lang, count(*) AS n FROM win GROUP BY lang),
g AS MATERIALIZED ({_PARTS}),
cut AS ({_CUTS}),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cut c JOIN g x ON x.lang = c.lang AND x.phrase = c.first JOIN g y ON y.lang = c.lang AND y.phrase = c.rest),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (SELECT lang, phrase, max(f) AS longer FROM ({_INNER}) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.longer IS NULL OR 100 * o.longer < {SHARE} * b.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= {TOP}
"""

QUERIES = {"op12_phrases": op12_phrases}
ORACLES = {"op12_phrases": SQL}
