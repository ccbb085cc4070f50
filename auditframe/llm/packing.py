"""Best-fit packing of tokenised documents into sequences, by a grouping genetic algorithm on islands.

A document is its ids and one separator.  Documents longer than a sequence are cut so that every piece but the first is
full; full pieces are sequences of their own, all other pieces are packed.  Pieces are dealt at random over blocks of about
``BLOCK`` pieces; each block is packed by ``ISLANDS`` populations.  A chromosome is a grouping (which pieces share a sequence).
Crossover injects whole well-filled bins of one parent into the other, drops the bins that hold a piece twice, and best-fits
the displaced pieces in descending length.  After an epoch each island passes its elite to the next one of its block (a
join); the best grouping of all islands counts.  A population stops early when it meets the lower bound of its block.

Nulls: a null text is an empty one, whose only id is the separator; a null doc_id stays null.  Rows that repeat a document
are packed each for itself, as a piece is known by the number of its row, not by its doc_id.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.llm.common import cut_lineage, is_exotic, pick, table

CAPACITY, SEPARATOR = 2048, 0
BLOCK, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 8, 24
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_CACHED_CHARS, _CACHE_ROWS = 48, 600_000


# ---------------------------------------------------------------- tokens


def _byte_of_letter() -> dict[str, int]:
    """Byte that each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """Bytes and ids of a byte-level vocabulary, or None where its merges are not in the order of their ids."""
    letter = _byte_of_letter()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = [model["vocab"].get(a + b, -1) for a, b in merges]
    if ids != sorted(set(ids)) or ids[:1] == [-1]:
        return None
    units = [t for t in model["vocab"] if len(t) == 1]
    return {bytes(letter[c] for c in t): model["vocab"][t] for t in (*units, *(a + b for a, b in merges))}


class Tokens(dict):
    """Ids of whole texts as the ``tokenizers`` library gives them, with those of short chunks remembered.

    A chunk begins where ASCII white space begins, which is always a boundary for the byte-level pattern; a text with other
    white space goes to the library whole.  Where the vocabulary's ids are in the order of its merges, chunks are merged by
    ``tiktoken`` over the same vocabulary, which gives the same ids in less time.
    """

    def __init__(self, json_text: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(json_text)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        ranks = ranks_of(json.loads(json_text)["model"])
        self.merge = lambda text: self.model.encode(text, add_special_tokens=False).ids
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            self.merge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = array("I", self.merge(chunk)).tobytes()
        if len(chunk) <= _CACHED_CHARS:
            if len(self) >= _CACHE_ROWS:
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if is_exotic(text):
            return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, _CHUNK.findall(text)))


@functools.lru_cache(maxsize=2)
def _tokens(json_text: str) -> Tokens:
    return Tokens(json_text)


def token_pieces(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(uid, key, piece, start, length, ids_crc32): the pieces of every document, each with a number of its own."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file: of fixed size
        model = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(model.value)
        end = np.asarray([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            rows = []
            for at, t in enumerate(batch.column(2).to_pylist()):
                ids = memoryview(tokens.encode(t or "") + end)
                n = len(ids) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                rows += [(at, i, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            cols = list(zip(*rows))
            of = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=["row", key, "piece", "start", "length", "ids_crc32"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key), F.col(text).alias("__text"))
    pieces = numbered.mapInArrow(cut, f"row bigint, `{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")
    return pieces.withColumn("uid", F.monotonically_increasing_id())


# ---------------------------------------------------------------- one block


class Grouping:
    """Bins of pieces; best fit finds the fullest bin with enough room through a bitmap of free sizes."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: dict[int, list[int]] = {}
        self.filled = 0

    def _index(self, b: int) -> None:
        room = self.free[b]
        if room:
            at = self.by_free.get(room)
            if at:
                at.append(b)
            else:
                self.by_free[room] = [b]
                self.filled |= 1 << room

    def add_bin(self, pieces: list[int]) -> None:
        self.bins.append(list(pieces))
        self.free.append(self.capacity - sum(self.lengths[i] for i in pieces))
        self._index(len(self.bins) - 1)

    def best_fit(self, pieces: list[int]) -> None:
        lengths, by_free = self.lengths, self.by_free
        for i in pieces:
            n = lengths[i]
            rest = self.filled >> n
            if not rest:
                self.bins.append([i])
                self.free.append(self.capacity - n)
                self._index(len(self.bins) - 1)
                continue
            room = n + (rest & -rest).bit_length() - 1
            at = by_free[room]
            b = at.pop()
            if not at:
                del by_free[room]
                self.filled &= ~(1 << room)
            self.bins[b].append(i)
            self.free[b] = room - n
            self._index(b)

    def fitness(self) -> float:
        """Falkenauer's: fewer and unequally filled bins are better."""
        return float(np.mean((1 - np.asarray(self.free) / self.capacity) ** 2)) if self.free else 1.0

    def genes(self) -> np.ndarray:
        """Bin number of each piece."""
        out = np.empty(len(self.lengths), np.int32)
        for b, pieces in enumerate(self.bins):
            out[pieces] = b
        return out

    @classmethod
    def of_genes(cls, genes: np.ndarray, lengths: list[int], capacity: int) -> "Grouping":
        g = cls(lengths, capacity)
        order = np.argsort(genes, kind="stable")
        for pieces in np.split(order, np.flatnonzero(np.diff(genes[order])) + 1):
            if len(pieces):
                g.add_bin(pieces.tolist())
        return g


def descending(lengths: list[int], rng: np.random.Generator | None = None) -> list[int]:
    """Longest first; with noise for the members of a first population."""
    keys = np.asarray(lengths, float)
    if rng is not None:
        keys = keys * (1 + rng.normal(0, 0.15, len(keys)))
    return np.argsort(-keys, kind="stable").tolist()


def cross(a: Grouping, b: Grouping, rng: np.random.Generator) -> Grouping:
    """Whole well-filled bins of b go into a; bins of a that share a piece with them are dissolved, their rest is best-fitted."""
    room = np.asarray(b.free)
    well = np.flatnonzero(room <= np.median(room))
    given = [b.bins[i] for i in well[rng.random(len(well)) < 0.5]]
    taken = {i for pieces in given for i in pieces}
    child = Grouping(a.lengths, a.capacity)
    for pieces in given:
        child.add_bin(pieces)
    displaced = []
    for pieces in a.bins:
        if taken.isdisjoint(pieces):
            child.add_bin(pieces)
        else:
            displaced += [i for i in pieces if i not in taken]
    child.best_fit(sorted(displaced, key=a.lengths.__getitem__, reverse=True))
    return child


def mutate(g: Grouping, rng: np.random.Generator) -> Grouping:
    """Dissolve the emptiest bins and a few others."""
    worst = set(np.argsort(g.free)[-max(1, len(g.bins) // 50) :].tolist()) | set(rng.integers(0, len(g.bins), max(1, len(g.bins) // 50)).tolist())
    out, loose = Grouping(g.lengths, g.capacity), []
    for b, pieces in enumerate(g.bins):
        if b in worst:
            loose += pieces
        else:
            out.add_bin(pieces)
    out.best_fit(sorted(loose, key=g.lengths.__getitem__, reverse=True))
    return out


def evolve(lengths: np.ndarray, elites: list[np.ndarray], seed: int, capacity: int, population: int = POPULATION, generations: int = GENERATIONS) -> np.ndarray:
    """The best grouping of one island after its generations: the bin of each piece."""
    rng = np.random.default_rng(seed)
    sizes = lengths.tolist()
    bound = -(-int(lengths.sum()) // capacity)
    members = [Grouping.of_genes(e, sizes, capacity) for e in elites]
    rank = lambda g: (len(g.bins), -g.fitness())
    while len(members) < population and not any(len(m.bins) <= bound for m in members):
        g = Grouping(sizes, capacity)
        g.best_fit(descending(sizes, rng if members or seed % ISLANDS else None))
        members.append(g)
    members.sort(key=rank)
    for _ in range(generations):
        if len(members[0].bins) <= bound or len(members) < 2:
            break
        i, j = rng.permutation(len(members))[:2]
        child = cross(members[i], members[j], rng)
        if rng.random() < 0.5:
            child = mutate(child, rng)
        members[-1] = min(members[-1], child, key=rank)
        members.sort(key=rank)
    return members[0].genes()


# ---------------------------------------------------------------- all blocks


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Add sequence_id and offset to every piece (columns uid and length must be there).

    ``pieces`` must be a written table, as its rows are read once an epoch.
    """
    small = pieces.filter(F.col("length") < capacity)
    blocks = max(1, -(-small.count() // block))
    # dealt by a hash of the row number: blocks are of like size whatever the keys and lengths are
    items = small.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"), "uid", F.col("length").cast("int").alias("length"))
    homes = items.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    elites = None
    state = "block bigint, island int, bins int, genes binary"

    def island(key: tuple, rows: pd.DataFrame, given: pd.DataFrame | None, epoch: int) -> pd.DataFrame:
        lengths = rows.sort_values("uid")["length"].to_numpy()
        found = [np.frombuffer(g, np.int32) for g in given.sort_values(["bins", "island"])["genes"]] if given is not None else []
        genes = evolve(lengths, found, int((key[0] * epochs + epoch) * islands + key[1]), capacity)
        return pd.DataFrame({"block": [key[0]], "island": [key[1]], "bins": [int(genes.max()) + 1], "genes": [genes.tobytes()]})

    for epoch in range(epochs):
        if elites is None:
            elites = homes.groupBy("block", "island").applyInPandas(lambda key, rows: island(key, rows, None, 0), state)
        else:  # each island keeps its elite and receives its neighbour's
            moved = elites.unionByName(elites.withColumn("island", (F.col("island") + 1) % islands))
            both = homes.groupBy("block", "island").cogroup(moved.groupBy("block", "island"))
            elites = both.applyInPandas(functools.partial(lambda epoch, key, rows, given: island(key, rows, given, epoch), epoch), state)
        elites = cut_lineage(elites)
    best = elites.groupBy("block").agg(F.min_by("genes", F.struct("bins", "island")).alias("genes"))

    def place(key: tuple, rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid").reset_index(drop=True)
        bins = np.frombuffer(chosen["genes"].iloc[0], np.int32)
        out = pd.DataFrame({"uid": rows["uid"], "bin": bins, "length": rows["length"].astype("int64")}).sort_values(["bin", "uid"])
        out["offset"] = out.groupby("bin")["length"].cumsum() - out["length"]
        # even numbers; full pieces take odd ones
        out["sequence_id"] = ((key[0] << 24) + out["bin"].astype("int64")) * 2
        return out[["uid", "sequence_id", "offset"]]

    placed = items.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(place, "uid bigint, sequence_id bigint, offset bigint")
    full = pieces.filter(F.col("length") >= capacity).select("*", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return pieces.join(placed, "uid").unionByName(full)


def pack_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    pieces = cut_lineage(token_pieces(docs, tokenizer_path))
    return pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_grouping_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op9_grouping_pack": op9_grouping_pack}
ORACLES: dict[str, str] = {}
