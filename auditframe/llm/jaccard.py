"""Exact n-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows, recursion.

A document is its set of word shingles (64-bit hashes); equal sets are one node.  The Jaccard distance is a metric, but most
sets are at distance 1 from each other, where no pivot tells them apart.  So the space is first cut by the prefix principle:
sets within the radius share one of their rarest ``n - ceil(0.8 n) + 1`` shingles, so each such shingle spans a small subspace.
Within a subspace:

* the pivot is its most central set (the smallest share of rare shingles); the other sets are measured against it, so the
  number of distances is linear in the entries and not in the pairs of a group;
* the region of a pivot is the ball of the join radius r (0.2), whose sets are linked through the pivot itself;
* sets outside the ball form the next, smaller subspace with a pivot of their own (``LEVELS`` times).

Then only links between different components can matter.  Every subspace joins its sets of different components within windows: by
the triangle inequality two sets within r differ by r at most in their distance to the pivot, so a boundary set meets only that
shell of the ball.  A set that shares fewer than ``MEASURED`` prefix shingles with the pivot is not measured and stays in every
window.  Sets within r share at least ``_least_shared`` prefix shingles, which a count over the subspaces tells; what is left is
measured exactly.  No link that could change a component is lost, and copies are never expanded into pairs.

The order of rarity needs no table that grows with the corpus: shingle counts are summed over ``CELLS`` hash cells; a cell
well above the mean holds a frequent shingle.  Any order gives exact results; this one keeps common passages out of the prefixes.

Null or empty texts, and texts of white space, have no set: 0 shingles and a component of their own.  Rows that repeat a
doc_id are nodes by their sets, and the component is the smallest doc_id that a row's set reaches.  A null doc_id never names
a component unless all its members are null.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.llm.common import ascii_words, cut_lineage, pick, table

WORDS, PERCENT = 5, 80
LEVELS, MEASURED = 2, 3
CELLS, _PART = 1 << 20, 1 << 15
BITS = 1 << 24
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(32)], np.uint64)


# ---------------------------------------------------------------- sets


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of the word shingles; the whole sequence is one shingle where there are fewer words."""
    words = ascii_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(size, len(words))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out + h[i : len(h) - k + 1 + i]) * _MULTIPLIERS[i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _cell(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def _schema_map(df: DataFrame, fn, schema: str, *names: str) -> DataFrame:
    return df.select(*names).mapInArrow(fn, schema)


def _totals(own: DataFrame, dtype: type, combine) -> dict[int, np.ndarray]:
    """Combine (part, counts) rows of all tasks into one array a part; in two steps, so that no group grows with the tasks."""
    schema = "part int, counts binary"

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = functools.reduce(combine, (np.frombuffer(zlib.decompress(c), dtype) for c in rows["counts"]))
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "counts": [zlib.compress(total.tobytes(), 1)]})

    first = own.withColumn("salt", F.spark_partition_id() % 64).groupBy("part", "salt").applyInPandas(lambda r: add(r), schema)
    rows = first.groupBy("part").applyInPandas(lambda r: add(r), schema).collect()  # a fixed number of cells, whatever the input
    return {r["part"]: np.frombuffer(zlib.decompress(r["counts"]), dtype) for r in rows}


def _parts(array: np.ndarray, size: int) -> pa.RecordBatch:
    parts = array.reshape(-1, size)
    return pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], names=["part", "counts"])


def frequency_levels(docs: DataFrame) -> bytes:
    """A level for every cell: 0 at or near the mean, then one for each doubling."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for b in batches:
            found = [shingle_set(t) for t in b.column(0).to_pylist()]
            cells += np.bincount(_cell(np.concatenate(found)), minlength=CELLS).astype(np.uint32)
        yield _parts(cells.astype(np.uint64), _PART)

    cells = np.zeros((CELLS // _PART, _PART), np.uint64)
    for part, counts in _totals(_schema_map(docs, count, "part int, counts binary", "text"), np.uint64, np.add).items():
        cells[part] = counts
    mean = cells.mean()
    usual = mean + 6 * np.sqrt(mean) + 8
    level = np.where(cells <= usual, 0, 1 + np.log2(np.maximum(cells / usual, 1)))
    return level.astype(np.uint8).tobytes()


def prefixes(docs: DataFrame, levels: bytes, size: int = WORDS) -> DataFrame:
    """(doc_id, source, n, d1, d2, rare, prefix): size and digest of each set, the share of rare shingles, and its prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            n, d1, d2, rare, pre = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingle_set(t, size)
                lv = level[_cell(s)]
                keep = len(s) - -(-PERCENT * len(s) // 100) + 1 if len(s) else 0
                order = np.argsort(lv, kind="stable")[:keep]  # by level, then by hash
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                d1.append((digest >> 64) - (1 << 63))
                d2.append((digest & ((1 << 64) - 1)) - (1 << 63))
                rare.append(int(100 * (lv == 0).mean()) if len(s) else 0)
                pre.append(s[order].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(rare, pa.int32()), pa.array(pre, pa.list_(pa.int64()))], names=["doc_id", "source", "n", "d1", "d2", "rare", "prefix"])

    return _schema_map(docs, run, "doc_id bigint, source bigint, n bigint, d1 bigint, d2 bigint, rare int, prefix array<bigint>", "doc_id", "source", "text")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = WORDS) -> DataFrame:
    """(node, shingles) of the wanted nodes (node, doc, source, d1, d2), worked out again from their texts.

    A bitmap of fixed size over the wanted texts' hashes keeps most other texts out of the shuffle.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(BITS, bool)
        for b in batches:
            bits[b.column(0).to_numpy() % BITS] = True
        yield _parts(np.packbits(bits), BITS // 64)

    found = _totals(wanted.select("source").mapInArrow(mark, "part int, counts binary"), np.uint8, np.bitwise_or)
    bits = np.zeros((8, BITS // 64), np.uint8)
    for part, b in found.items():
        bits[part] = b
    shared = docs.sparkSession.sparkContext.broadcast(bits.tobytes())

    def may_be(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for b in batches:
            yield b.filter(pa.array(bits[b.column(0).to_numpy() % BITS]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t, size) for t in b.column(3).to_pylist()]
            ok = [xxhash.xxh3_128_intdigest(s.tobytes()) == ((x + (1 << 63)) << 64) + y + (1 << 63) for s, x, y in zip(found, b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["node", "shingles"]).filter(pa.array(ok, pa.bool_()))

    at = docs.select("source", F.coalesce("doc_id", F.lit(-1)).alias("doc"), "text").mapInArrow(may_be, "source bigint, doc bigint, text string")
    rows = at.join(wanted.withColumn("doc", F.coalesce("doc", F.lit(-1))), ["source", "doc"]).dropDuplicates(["source", "doc"])
    return _schema_map(rows, run, "node bigint, shingles array<bigint>", "node", "d1", "d2", "text")


# ---------------------------------------------------------------- pairs and components


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both, either): sizes of intersection and union of each pair."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("bigint")
    rows = pairs.join(left, "a").join(right, "b").select("a", "b", both.alias("both"), (F.size("sa") + F.size("sb")).alias("sum"))
    return rows.select("a", "b", "both", (F.col("sum") - F.col("both")).alias("either"))


def _fits(n: Column, m: Column, percent: int) -> Column:
    """Whether sets of these sizes can be as similar as that."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of a link (a, b) reaches; alternating large-star and small-star steps."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # large star: greater neighbours move to the smallest neighbour
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.filter("u <> v").distinct())
        # small star: smaller neighbours and the node itself move to the smallest of them
        low = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut_lineage(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state == before or state[0] == 0:
            break
        before = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _least_shared(n: Column, m: Column) -> Column:
    """Prefix shingles that two sets of these sizes share at least when they are similar enough to link.

    They have ``both`` shingles in common or more; of the common ones in the order of rarity, those before the first
    ``prefix - (size - both)`` lie in the prefix of either set.
    """
    both = F.ceil(PERCENT * (n + m) / (100 + PERCENT))
    prefix = lambda size: size - F.ceil(PERCENT * size / 100) + 1
    return F.greatest(F.lit(1), F.least(prefix(n) - n + both, prefix(m) - m + both))


def _early(n: Column) -> Column:
    """So many of its rarest shingles a set needs to meet every set of its size or more that is similar enough (in their prefixes)."""
    return n - F.ceil(2 * PERCENT * n / (100 + PERCENT)) + 1


def _least_met(small: Column, large: Column) -> Column:
    """Early shingles of the smaller set in the prefix of the larger one that two similar sets have at least.

    Of their ``both`` common shingles in the order of rarity, those missing are behind the early ones or behind the prefix.
    """
    both = F.ceil(PERCENT * (small + large) / (100 + PERCENT))
    prefix = large - F.ceil(PERCENT * large / 100) + 1
    return F.greatest(F.lit(1), both - F.greatest(small - _early(small), large - prefix))


def _sized(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the sizes na and nb."""
    return pairs.join(sizes.withColumnsRenamed({"node": "a", "n": "na"}), "a").join(sizes.withColumnsRenamed({"node": "b", "n": "nb"}), "b")


def jaccard_components(docs: DataFrame, size: int = WORDS, levels: int = LEVELS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents (doc_id bigint, text)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("source"))
    rows = cut_lineage(prefixes(docs, frequency_levels(docs), size))
    # one row for each set; of the prefixes only the one that goes on is moved
    one = rows.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "source")).alias("at"), F.min("n").alias("n"), F.min("rare").alias("rare"))
    # the number of a node begins with its share of rare shingles, so the smallest number is the most central set
    number = F.col("rare").cast("bigint") * F.lit(1 << 55) + F.monotonically_increasing_id()
    # written with its number, which a second reading could give otherwise
    nodes = cut_lineage(one.select("d1", "d2", "least", F.col("at.doc_id").alias("doc"), F.col("at.source").alias("source"), "n", "rare").withColumn("node", number))
    sizes = nodes.select("node", "n")
    keyed = rows.filter("n > 0").select("source", F.coalesce("doc_id", F.lit(-1)).alias("doc"), "prefix")
    chosen = keyed.join(nodes.select("node", "source", F.coalesce("doc", F.lit(-1)).alias("doc")), ["source", "doc"]).select("node", "prefix")
    placed = chosen.join(sizes, "node").select("node", "n", F.posexplode("prefix").alias("at", "s"))
    entries = placed.select("node", "s", (F.col("at") < _early(F.col("n"))).alias("early"))
    spans = cut_lineage(entries.groupBy("s").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot < other").select("s", "pivot"))
    # a shingle may be in as many prefixes as it likes: two plain shuffles, so that its rows can be split
    members = cut_lineage(entries.join(spans, "s").select("s", "node", "pivot", "early"))

    subspace, measured, links = members, None, None
    shingles: list[DataFrame] = []

    def measure(pairs: DataFrame) -> DataFrame:
        """(a, b, both, either) of the pairs; sets are worked out where no earlier step has done so."""
        need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        for known in shingles:
            need = need.join(known.select("node"), "node", "left_anti")
        shingles.append(cut_lineage(sets_of(docs, cut_lineage(nodes.join(need, "node").select("node", "doc", "source", "d1", "d2")), size)))
        return cut_lineage(_measured(pairs, functools.reduce(DataFrame.unionByName, shingles)))

    close = F.col("both") * 100 >= F.col("either") * PERCENT
    for level in range(levels):
        shared = subspace.filter("node <> pivot").groupBy(F.col("node").alias("a"), F.col("pivot").alias("b")).agg(F.count("*").alias("k"))
        pairs = _sized(shared, sizes).filter(_fits(F.col("na"), F.col("nb"), 2 * PERCENT - 100))
        linkable = _fits(F.col("na"), F.col("nb"), PERCENT) & (F.col("k") >= _least_shared(F.col("na"), F.col("nb")))
        step = measure(cut_lineage(pairs.filter(linkable | (F.col("k") >= MEASURED)).select("a", "b")))
        measured = step if measured is None else measured
        ball = step.filter(close).select("a", "b")
        links = ball if links is None else cut_lineage(links.unionByName(ball))
        # outside the ball: the next subspace
        outside = subspace.filter("node <> pivot").join(ball.withColumnsRenamed({"a": "node", "b": "pivot"}), ["node", "pivot"], "left_anti").select("s", "node")
        outside = cut_lineage(outside)
        fresh = cut_lineage(outside.groupBy("s").agg(F.min("node").alias("pivot"), F.max("node").alias("other")).filter("pivot < other").select("s", "pivot"))
        subspace = cut_lineage(outside.join(fresh, "s"))
    groups = components(links)
    extra = measure(crossing(members, measured, groups, sizes)).filter(close).select("a", "b")
    if extra.limit(1).count():
        groups = components(links.unionByName(extra))
    named = nodes.select("node", "d1", "d2", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = cut_lineage(named.groupBy("component").agg(F.min("least").alias("component_id")))
    by_set = cut_lineage(named.join(smallest, "component").select("d1", "d2", "component_id"))
    ends = rows.select("doc_id", "n", "d1", "d2").join(by_set, ["d1", "d2"], "left")
    return ends.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def crossing(members: DataFrame, measured: DataFrame, groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that only a measurement can tell, by the windows of each subspace's pivot."""
    radius = 1 - PERCENT / 100 + 1e-9
    named = cut_lineage(sizes.join(groups, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component")))
    distance = measured.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("both") / F.col("either")).alias("d"))
    placed = members.join(distance, ["node", "pivot"], "left").join(named, "node")
    placed = cut_lineage(placed.select("s", "node", "n", "component", "early", F.when(F.col("node") == F.col("pivot"), F.lit(0.0)).otherwise(F.col("d")).alias("d")))
    # subspaces of a single component are done
    mixed = cut_lineage(placed.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("s"))
    open_ = cut_lineage(placed.join(mixed, "s"))
    # the smaller set brings its early shingles only, so sets that share a frequent passage but differ in the rest do not meet by it
    sides = [part.select("s", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("component").alias(f"c{x}"), F.col("d").alias(f"d{x}")) for x, part in (("a", open_.filter("early")), ("b", open_))]
    windows = F.col("da").isNull() | F.col("db").isNull() | (F.abs(F.col("da") - F.col("db")) <= radius)
    ordered = F.struct("na", "a") < F.struct("nb", "b")
    met = sides[0].join(sides[1], "s").filter(ordered & (F.col("ca") != F.col("cb")) & windows & _fits(F.col("na"), F.col("nb"), PERCENT))
    # two linked sets of different components meet in every subspace they share, so the count is that of what they share
    counted = met.groupBy("a", "b").agg(F.count("*").alias("k"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return cut_lineage(counted.filter(F.col("k") >= _least_met(F.col("na"), F.col("nb"))).select("a", "b"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The row with the smallest doc_id of every component (null ids last), with all columns; rows without words all stay."""
    # written with their numbers, as another job may split the same files otherwise
    own = cut_lineage(docs.withColumn("__n", F.monotonically_increasing_id()))
    parts = cut_lineage(jaccard_components(own.select(F.col("__n").alias("doc_id"), "text")).select(F.col("doc_id").alias("__n"), "component_id"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("__n").alias("n"))
    first = parts.join(own.select("__n", "doc_id"), "__n").groupBy("component_id").agg(F.min(order).alias("first"))
    kept = cut_lineage(first.select(F.col("first.n").alias("__n")))
    return own.join(kept, "__n", "left_semi").drop("__n")


def op4_metric_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    return jaccard_components(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))


QUERIES = {"op4_metric_jaccard": op4_metric_jaccard}
ORACLES: dict[str, str] = {}
