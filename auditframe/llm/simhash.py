"""SimHash near duplicates: BK-trees over shards of the fingerprint space, exact within the radius.

A text's fingerprint has a bit for every bit position that is set in more than half of the XXH64 hashes of its word shingles
(repeats included).  Equal fingerprints are one node, so copies never become pairs.

* Shards: two fingerprints that differ in ``RADIUS`` bits at most agree in one of ``RADIUS`` + 1 blocks of bits, so each block
  value is a shard.  A shard of more than ``TREE`` fingerprints is cut again by blocks of the bits that it leaves open; as distinct
  fingerprints fill at most 2 ** (open bits) places, that ends by itself, and no pair within the radius is lost.
* Trees: every shard has one BK-tree.  A node's children are keyed by their integer Hamming distance to it; a search goes on only
  along edges whose key differs from the query's own distance by the radius at most.  All trees of a task are grown and searched
  level by level in arrays.  The queries of a shard are its own members, so a tree is sent to just one task: trees broadcast to every
  executor would grow with the corpus.
* Links leave a shard as one star for each set of members that they join, so a dense group gives as many rows as members.

Null texts, empty ones and texts of white space have the fingerprint zero and are linked like any other.  A null doc_id never names a
component unless all its members are null; rows that repeat a doc_id each keep their own fingerprint.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.llm.common import ascii_words, cut_lineage, pick, table
from auditframe.llm.jaccard import components

WORDS, SEED, RADIUS = 3, 42, 3
TREE = 2048
_CHUNK = 1 << 16  # shingles whose bits are counted at once
_ROWS, _PAIRS = 1 << 16, 1 << 21  # members held, and pairs of query and node looked at, at once


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: str | None, size: int = WORDS) -> int:
    """Unsigned 64-bit SimHash; the whole sequence is one shingle where there are fewer words, and no word gives zero."""
    words = ascii_words(text)
    if not words:
        return 0
    size = min(size, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - size + 1], ends[size - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        spans = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist())
        h = np.array([digest(joined[a:b], SEED) for a, b in spans], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row of (doc_id bigint, text); fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- trees


def _distance(f: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(f[a] ^ f[b]).astype(np.int64)


class BKForest:
    """One BK-tree for each run of equal shard numbers; the first member of a run is its root."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        self.fps = fps
        opens = np.concatenate([[True], shard[1:] != shard[:-1]]) if len(fps) else np.zeros(0, bool)
        self.root = np.maximum.accumulate(np.where(opens, np.arange(len(fps)), 0))
        self.size = np.bincount(self.root, minlength=len(fps))[self.root]
        parents, keys, children = [], [], []
        waiting = np.flatnonzero(~opens)
        at = self.root[waiting]
        while len(waiting):  # every waiting member goes down one edge, or becomes that edge's child
            key = at * 65 + _distance(fps, waiting, at)
            edge, first, which = np.unique(key, return_index=True, return_inverse=True)
            child = waiting[first]
            parents.append(edge // 65)
            keys.append(edge % 65)
            children.append(child)
            at = child[which]
            stays = at != waiting
            waiting, at = waiting[stays], at[stays]
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        parent, key, child = join(parents), join(keys), join(children)
        order = np.lexsort((key, parent))
        self.key, self.child = key[order], child[order]
        self.start = np.searchsorted(parent[order], np.arange(len(fps) + 1))

    def within(self, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (member, node) of one shard that differ in at most ``radius`` bits, a level of the trees at a time."""
        q, node = queries, self.root[queries]
        while len(q):
            d = _distance(self.fps, q, node)
            near = (d <= radius) & (q != node)
            yield q[near], node[near]
            low, many = self.start[node], self.start[node + 1] - self.start[node]
            # the children whose edge lies within the radius of the query's own distance
            slot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
            follow = np.abs(self.key[slot] - np.repeat(d, many)) <= radius
            q, node = np.repeat(q, many)[follow], self.child[slot[follow]]

    def stars(self, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
        """(member, centre): the links of every shard, as one star for each set of linked members."""
        label = np.arange(len(self.fps))
        load = np.cumsum(self.size) // _PAIRS  # a query looks at its own tree's nodes at most
        for queries in np.split(np.arange(len(self.fps)), np.flatnonzero(np.diff(load)) + 1):
            for a, b in self.within(queries, radius):
                while True:
                    a, b = label[a], label[b]
                    open_ = a != b
                    if not open_.any():
                        break
                    a, b = a[open_], b[open_]
                    np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                    while (label[label] != label).any():
                        label = label[label]
        member = np.flatnonzero(label != np.arange(len(label)))
        return member, label[member]


def _tree_links(members: DataFrame, radius: int) -> DataFrame:
    """(a, b) of (mask, value, fp): the stars of every shard; a shard is whole in one task."""

    def solved(mask: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        moved = np.concatenate([[0], (np.diff(mask) != 0) | (np.diff(value) != 0)]) if len(fp) else np.zeros(0, np.int64)
        forest = BKForest(fp.view(np.uint64), np.cumsum(moved))
        member, centre = forest.stars(radius)
        return pa.RecordBatch.from_arrays([pa.array(fp[member]), pa.array(fp[centre])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)]
            if len(held[0]) >= _ROWS:  # the last shard may go on in the next batch
                cut = int(((held[0] != held[0][-1]) | (held[1] != held[1][-1])).sum())
                yield solved(*[h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield solved(*held)

    dealt = members.select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
    return dealt.mapInArrow(run, "a bigint, b bigint")


# ---------------------------------------------------------------- shards


def _finer(mask: int, parts: int) -> list[int]:
    """The mask with each of so many blocks of its open bits added."""
    open_ = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in open_[len(open_) * k // parts : len(open_) * (k + 1) // parts]) for k in range(parts)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def near_links(nodes: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b) of distinct fingerprints (fp): links that join every two that differ in at most ``radius`` bits; ``tree`` is 16 or more."""
    spark = nodes.sparkSession
    masks, links = [0], []
    rows = nodes.select(F.lit(0).cast("bigint").alias("mask"), "fp")
    while True:
        finer = {m: _finer(m, radius + 1) for m in masks}
        steps = spark.createDataFrame([(_signed(m), _signed(x)) for m, xs in finer.items() for x in xs], "mask bigint, next bigint")
        masks = sorted({x for xs in finer.values() for x in xs})
        # 4 ** level rows, and no more than six levels
        placed = rows.join(F.broadcast(steps), "mask").select(F.col("next").alias("mask"), F.col("next").bitwiseAND(F.col("fp")).alias("value"), "fp")
        sizes = placed.groupBy("mask", "value").agg(F.count("*").alias("size")).filter("size > 1")
        shards = cut_lineage(placed.join(sizes, ["mask", "value"]))
        links.append(cut_lineage(_tree_links(shards.filter(F.col("size") <= tree), radius).distinct()))
        rows = shards.filter(F.col("size") > tree).select("mask", "fp")
        if not rows.limit(1).count():
            return functools.reduce(DataFrame.unionByName, links)


def simhash_components(docs: DataFrame, size: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row of documents (doc_id bigint, text)."""
    rows = cut_lineage(fingerprints(docs, size))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = nodes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = cut_lineage(named.join(smallest, "component").select("fp", "component_id"))
    return rows.join(by_node, "fp").select("doc_id", "fp", "component_id")


def op11_bk_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = simhash_components(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op11_bk_simhash": op11_bk_simhash}
ORACLES: dict[str, str] = {}
