"""Byte-level BPE over a rank file, with a hierarchical-bitmap rank queue.

Text is cut by the tokenizer's pattern; inside a match, the adjacent pair of lowest rank is merged until none is left.
The pairs wait in one bucket per rank.  A hierarchical bitmap says which buckets hold anything, and a find-first-set
per level gives the lowest rank; a bucket hands out its leftmost position first.  Entries that a merge has made stale
are skipped when they come up, so a pre-token of n bytes takes O(n log n) however long it is.

The library's ``tiktoken`` is the model of the result: equal ids for every text.  Null texts count as empty; an empty
text has no ids.  Rows are encoded each for itself, so repeated rows, ties and clashing extra columns cannot matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from auditframe.llm.common import is_exotic, pick, table

#: pieces of white space and what follows it; cut where ASCII white space begins, which is always a pre-token boundary
_CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_CACHED_CHARS = 48
_CHUNK_ROWS, _WORD_ROWS = 700_000, 1_000_000  # of the two caches of a worker process


class Remembered(dict):
    """Results of a function of a string; those of short strings stay, up to so many."""

    def __init__(self, fn: Callable[[str], bytes], rows: int):
        self.fn, self.rows = fn, rows

    def __missing__(self, key: str) -> bytes:
        value = self.fn(key)
        if len(key) <= _CACHED_CHARS:
            if len(self) >= self.rows:
                self.clear()
            self[key] = value
        return value


class RankQueue:
    """Buckets of positions by rank; the lowest filled rank is found through a bitmap of two levels of 256-bit words."""

    BIT = [1 << i for i in range(256)]

    def __init__(self, ranks: int):
        self.words = [0] * ((ranks >> 8) + 1)
        self.groups = [0] * ((ranks >> 16) + 1)
        self.buckets: dict[int, list[int]] = {}

    def first_word(self) -> int:
        """The lowest filled word; beyond the first group the groups are walked."""
        for g, group in enumerate(self.groups):
            if group:
                return (g << 8) + (group & -group).bit_length() - 1
        raise LookupError("the queue is empty")


class ByteBPE:
    """Encoder and decoder for one rank table and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        # the pattern's white space is Unicode's White_Space property
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.chunks, self.words = Remembered(self._pieces, _CHUNK_ROWS), Remembered(self._word, _WORD_ROWS)
        size = max(self.tokens, default=0) + 1
        lengths = np.zeros(size, np.int64)
        for i, t in self.tokens.items():
            lengths[i] = len(t)
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token (``RankQueue.push`` and ``pop`` written out, as calls would take most of the time)."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        rank_of, queue, n = self.ranks.get, self.queue, len(word)
        words, groups, buckets, bit = queue.words, queue.groups, queue.buckets, queue.BIT
        parts = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = list(map(rank_of, map(bytes.__add__, parts, parts[1:])))  # the rank under which the pair that begins here waits
        waiting.append(None)
        fresh = [(rank, i) for i, rank in enumerate(waiting) if rank is not None]
        while True:
            for rank, i in fresh:
                if rank in buckets:
                    heapq.heappush(buckets[rank], i)
                else:
                    buckets[rank] = [i]
                    w = rank >> 8
                    if not words[w]:
                        groups[w >> 8] |= bit[w & 255]
                    words[w] |= bit[rank & 255]
            group = groups[0]
            if group:
                w = (group & -group).bit_length() - 1
            elif any(groups):
                w = queue.first_word()
            else:
                break
            found = words[w]
            rank = (w << 8) + (found & -found).bit_length() - 1
            bucket = buckets[rank]
            i = heapq.heappop(bucket)
            if not bucket:
                del buckets[rank]
                words[w] = found = found & (found - 1)
                if not found:
                    groups[w >> 8] &= ~bit[w & 255]
            fresh = []
            if waiting[i] != rank:
                continue  # stale: one of the two parts has been merged since
            j = after[i]
            k = after[j]
            parts[i] = merged = parts[i] + parts[j]
            parts[j] = waiting[j] = None
            after[i] = k
            if k < n:
                before[k] = i
                waiting[i] = rank = rank_of(merged + parts[k])
                if rank is not None:
                    fresh.append((rank, i))
            else:
                waiting[i] = None
            h = before[i]
            if h >= 0:
                waiting[h] = rank = rank_of(parts[h] + merged)
                if rank is not None:
                    fresh.append((rank, h))
        return [self.ranks[p] for p in parts if p is not None]

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pattern.findall(text)))

    def _word(self, word: str) -> bytes:
        return array("I", self.merge(word.encode("utf-8", "replace"))).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if is_exotic(text):
            return self._pieces(text)
        return b"".join(map(self.chunks.__getitem__, _CHUNK.findall(text)))

    def decode(self, ids: bytes) -> bytes:
        out = []
        for at in range(0, len(ids), 1 << 18):  # long texts in steps, to bound the memory
            part = np.frombuffer(ids[at : at + (1 << 18)], "<u4")
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            where = np.repeat(self.starts[part] - ends + lengths, lengths) + np.arange(ends[-1])
            out.append(self.bytes[where].tobytes())
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def from_rank_file(lines: bytes, pattern: str) -> ByteBPE:
    """One encoder per worker process, so that its cache serves all tasks there."""
    return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}, pattern)


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, decoded): ids of each whole text as little-endian 32-bit integers, and the bytes they decode to."""
    return _encoded(docs, rank_path, pattern, key, text, digest=False)


def encoding_digests(docs: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each whole text; ids and bytes do not leave the task."""
    return _encoded(docs, rank_path, pattern, key, text, digest=True)


def _encoded(docs: DataFrame, rank_path: str, pattern: str, key: str, text: str, digest: bool) -> DataFrame:
    with open(rank_path, "rb") as f:  # a vocabulary file: of fixed size, shipped with the function
        lines = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[key].dataType
    result = f"`{key}` {kind.simpleString()}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded binary")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = from_rank_file(lines.value, pattern)
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t or "")
                back = bpe.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()) if digest else (ids, back))
            columns = list(zip(*rows)) if rows else [[]] * (3 if digest else 2)
            types = [pa.int64(), pa.string(), pa.string()] if digest else [pa.binary(), pa.binary()]
            names = [key, *(("n_tokens", "ids_sha256", "decoded_sha256") if digest else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return pick(docs, **{key: key, "__text": text}).mapInArrow(encode, result)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
ORACLES: dict[str, str] = {}
