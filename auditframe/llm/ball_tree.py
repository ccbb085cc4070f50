"""Exact inner-product top-k by branch and bound over a ball tree in every shard.

Vectors are dealt over shards of about ``SHARD`` rows by a hash of the id; each shard builds a tree of balls (split at the median
along the line between two far vectors) and is one row: the tree, the vectors and the ids as blocks of bytes.  The queries are a
stated set, cut into blocks of ``BLOCK``.  A query's bound in a ball is q.c + |q| r.

First every query searches its home shard, where the nodes are taken in the order of their bounds; this gives it a kth score.
Then each block of queries meets every other shard, together with the kth scores so far; a node is looked at only for the
queries whose bound reaches their kth score, and scores found in one leaf lower the work in all later ones.  The candidates of
all shards are merged by (score descending, id ascending).  Nothing is approximate: a node is skipped only if its bound lies
below the kth score of every query, and the bounds carry the rounding error of their own arithmetic.

Components become floor(scale * x).  Vectors that are null, or hold a null or a component that is not finite, take no part; nor
do rows whose id is null or whose length differs from the most frequent one.  A query does not find its own row: rows with its
id.  Repeated rows are found each; equal scores go by the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from auditframe.llm.common import cut_lineage, pick, table

SHARD, BLOCK, LEAF, K, SCALE = 8192, 512, 128, 5, 256
_NONE, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def integer_vectors(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v) with v as integers; rows that take no part are gone."""
    fine = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.filter(fine).select("vec_id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))
    usual = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()  # one row
    return rows.filter(F.size("v") == (usual[0]["d"] if usual else 0))


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where they and all partial sums are below 2 ** 53, else in integers."""
    if q.size and v.size and np.abs(q).max().astype(float) * np.abs(v).max().astype(float) * q.shape[1] < 2.0**53:
        return (q.astype(np.float64) @ v.T.astype(np.float64)).astype(np.int64)
    return q @ v.T


class BallTree:
    """Balls over the rows of one shard: rows are in tree order, node i spans ``begin[i]:end[i]``."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.vectors, self.ids = vectors[order], ids[order]
        at = np.arange(len(ids))
        nodes: list[tuple[int, int, bool]] = []
        waiting = [(0, len(ids))]
        points = self.vectors.astype(np.float64)
        while waiting:
            a, b = waiting.pop()
            rows = points[at[a:b]]
            far = rows[np.argmax(((rows - rows[0]) ** 2).sum(1))]
            other = rows[np.argmax(((rows - far) ** 2).sum(1))]
            split = b - a > leaf and bool((far != other).any())
            nodes.append((a, b, not split))
            if split:
                side = rows @ (other - far)
                middle = (b - a) // 2
                at[a:b] = at[a:b][np.argsort(side, kind="stable")]
                waiting += [(a, a + middle), (a + middle, b)]
        self.vectors, self.ids = self.vectors[at], self.ids[at]
        leaves = [(a, b) for a, b, is_leaf in nodes if is_leaf]
        self.spans = np.array(leaves, np.int64).reshape(-1, 2)
        points = self.vectors.astype(np.float64)
        self.centres = np.array([points[a:b].mean(0) for a, b in self.spans]).reshape(len(leaves), vectors.shape[1] if vectors.ndim == 2 else 0)
        self.radii = np.array([np.sqrt(((points[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(self.spans, self.centres)])
        self.least = np.array([self.ids[a:b].min() for a, b in self.spans])
        # upper levels: pairs of neighbouring balls, so that one bound can rule out many leaves
        self.levels = []
        spans, centres, radii = np.stack([np.arange(len(leaves)), np.arange(len(leaves)) + 1], 1), self.centres, self.radii
        while len(spans) > 8:
            pairs = [(i, min(i + 2, len(spans))) for i in range(0, len(spans), 2)]
            up = np.array([centres[a:b].mean(0) for a, b in pairs])
            radii = np.array([(np.sqrt(((centres[a:b] - c) ** 2).sum(1)) + radii[a:b]).max() for (a, b), c in zip(pairs, up)])
            spans, centres = np.array([(spans[a, 0], spans[b - 1, 1]) for a, b in pairs]), up
            self.levels.append((spans, centres, radii))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, bar: np.ndarray, bar_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of this tree's rows for each query, best first, as far as they come before its bar (score, id)."""
        scores, found = np.full((len(queries), k), _NONE), np.full((len(queries), k), _LAST)
        if not len(self.ids) or not len(queries):
            return scores, found
        q = queries.astype(np.float64)
        norms = np.sqrt((q**2).sum(1))
        slack = 1e-9 * (norms * (np.sqrt((self.centres**2).sum(1)).max() + self.radii.max()) + 1)
        low = bar.astype(np.float64)
        alive = np.ones((len(q), len(self.spans)), bool)
        for spans, centres, radii in reversed(self.levels):
            bound = q @ centres.T + norms[:, None] * radii + slack[:, None]
            for i, (a, b) in enumerate(spans):
                alive[bound[:, i] < low, a:b] = False
        bounds = q @ self.centres.T + norms[:, None] * self.radii + slack[:, None]
        bounds[~alive] = -np.inf
        kth, kth_id = bar.copy(), bar_id.copy()
        for leaf in np.argsort(-bounds.max(0), kind="stable"):  # best bound of any query first
            # a ball that only reaches the kth score matters only with a smaller id
            needs = np.flatnonzero((bounds[:, leaf] > kth) | ((bounds[:, leaf] >= kth) & (self.least[leaf] < kth_id)))
            if not len(needs):
                continue
            a, b = self.spans[leaf]
            got, ids = products(queries[needs], self.vectors[a:b]), self.ids[a:b]
            better = ((got > kth[needs, None]) | ((got == kth[needs, None]) & (ids < kth_id[needs, None]))) & (ids != own[needs, None])
            for row in np.flatnonzero(better.any(1)):
                n, hits = needs[row], np.flatnonzero(better[row])
                s, i = np.append(scores[n], got[row, hits]), np.append(found[n], ids[hits])
                best = np.lexsort((i, -np.maximum(s, _NONE + 1)))[:k]
                scores[n], found[n] = s[best], i[best]
                if scores[n, -1] > kth[n] or (scores[n, -1] == kth[n] and found[n, -1] < kth_id[n]):
                    kth[n], kth_id[n] = scores[n, -1], found[n, -1]
        return scores, found


def _block(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of the key: ids and vectors as bytes (a group holds a bounded number of rows, by its hash)."""

    def gather(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(rows["v"].to_numpy()).astype(np.int64) if len(rows) else np.empty((0, 0), np.int64)
        return pd.DataFrame({key: [name[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "vectors": [v.tobytes()]})

    return df.groupBy(key).applyInPandas(gather, f"{key} bigint, ids binary, vectors binary")


def _arrays(ids: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(vectors, np.int64).reshape(len(i), -1)


def _parts(df: DataFrame, size: int) -> tuple[Column, int]:
    """Number of a row's group, so that groups have about ``size`` rows; rows of one id may go to different ones."""
    parts = max(1, -(-df.count() // size))
    return F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)), parts


_STATE = "block bigint, shard bigint, scores binary, found binary"


def _searched(rows: DataFrame, k: int) -> DataFrame:
    """Search the tree of each row's shard for its block; a task keeps the tree of the shard it read last."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for b in batches:
            for shard, ids, vectors, block, asked, queries, bars, bar_ids in zip(*b.columns):
                if shard.as_py() != last:
                    last, tree = shard.as_py(), BallTree(*reversed(_arrays(ids.as_py(), vectors.as_py())))
                own, q = _arrays(asked.as_py(), queries.as_py())
                bar = np.frombuffer(bars.as_py(), np.int64) if bars.is_valid else np.full(len(own), _NONE)
                bar_id = np.frombuffer(bar_ids.as_py(), np.int64) if bar_ids.is_valid else np.full(len(own), _LAST)
                s, f = tree.search(q, own, k, bar, bar_id)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()]), pa.array([last]), pa.array([s.tobytes()], pa.binary()), pa.array([f.tobytes()], pa.binary())], names=["block", "shard", "scores", "found"])

    return rows.select("shard", "ids", "vectors", "block", "asked", "queries", "bars", "bar_ids").mapInArrow(search, _STATE)


def _kth(states: DataFrame, k: int) -> DataFrame:
    """(block, home, bars, bar_ids): the kth score of each query so far, and its id."""

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [[np.frombuffer(x.as_py(), np.int64).reshape(-1, k)[:, -1].tobytes() for x in b.column(i)] for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(e, pa.binary()) for e in ends)], names=["block", "home", "bars", "bar_ids"])

    return states.mapInArrow(last, "block bigint, home bigint, bars binary, bar_ids binary")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``; both (vec_id, v), written tables."""
    shard, shards = _parts(vectors, SHARD)
    block, _ = _parts(queries, BLOCK)
    index = cut_lineage(_block(vectors.withColumn("shard", shard), "shard"))
    asked = cut_lineage(_block(queries.withColumn("block", block), "block")).select("block", F.col("ids").alias("asked"), F.col("vectors").alias("queries"))
    none = F.lit(None).cast("binary")
    home = asked.withColumns({"shard": F.col("block") % shards, "bars": none, "bar_ids": none})
    first = cut_lineage(_searched(home.join(index, "shard"), k))
    # every other shard meets each block once, with the kth scores of the home shard
    meetings = asked.join(_kth(first, k), "block").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    others = _searched(meetings.join(index, "shard").sortWithinPartitions("shard"), k)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, asked, scores, found in zip(*b.columns):
                own, s, f = (np.frombuffer(x.as_py(), np.int64) for x in (asked, scores, found))
                ok = s != _NONE
                columns = [np.full(ok.sum(), block.as_py()), np.repeat(np.arange(len(own)), k)[ok], np.repeat(own, k)[ok], f[ok], s[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["block", "place", "query_id", "vec_id", "score"])

    states = first.unionByName(others).join(asked.select("block", "asked"), "block").select("block", "asked", "scores", "found")
    flat = states.mapInArrow(rows, "block bigint, place bigint, query_id bigint, vec_id bigint, score bigint")
    # at most k rows of each shard for one query
    best = Window.partitionBy("block", "place").orderBy(F.desc("score"), "vec_id")
    return flat.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "embeddings"), vec_id="vec_id", v="embedding")
    vectors = cut_lineage(integer_vectors(rows.withColumn("vec_id", F.col("vec_id").cast("bigint"))))
    return top_k(vectors, cut_lineage(vectors.filter("vec_id % 50 = 0")))


QUERIES = {"op6_ball_tree": op6_ball_tree}
ORACLES = {
    "op6_ball_tree": """
WITH e AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
           FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
     k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
}
