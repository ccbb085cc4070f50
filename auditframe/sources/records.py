"""Records of quoted text from splittable lines, by composing the quote state of blocks.

Whether a line begins inside a quoted field depends on every line before it.  Each block of a file is therefore read once for both
states it may begin in; a block as a whole maps the first state to the last, and such maps compose, so a prefix scan over one
small row a block tells where each begins.  No file is walked by one task, and only records that run over several lines are shuffled.

A quote opens only at the start of a field, a doubled quote stands for itself, and what follows a closing quote belongs to the
field.  Outside quotes a record ends at LF, CRLF or a lone CR; inside, all three are data.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from auditframe.session import cut_lineage, pin_partitions

_QUOTED = re.compile(rb'(?:[^"]++|"")*+')
BOTH = 2  # a row that is the same piece of a record whichever state its block begins in


def scan_line(line: bytes, inside: bool, delimiter: bytes) -> tuple[list[tuple[int, int, int, bool]], bool]:
    """Pieces of a line (start, end, delimiters, whether a quoted field holds one) and the state behind it; a lone CR ends a piece."""
    if b'"' not in line and (inside or b"\r" not in line[:-1]):
        n = line.count(delimiter)
        return [(0, len(line), 0 if inside else n, inside and n > 0)], inside
    rest = re.compile(rb"[^\r" + re.escape(delimiter) + rb"]*+")
    pieces, start, at, delims, quoted = [], 0, 0, 0, False
    while True:
        if not inside and line[at : at + 1] == b'"':
            inside, at = True, at + 1
        if inside:
            end = _QUOTED.match(line, at).end()
            quoted |= delimiter in line[at:end]
            if end >= len(line):
                break
            inside, at = False, end + 1
        at = rest.match(line, at).end()
        if at >= len(line):
            break
        if line[at : at + 1] == delimiter:
            delims += 1
        elif at < len(line) - 1:
            pieces.append((start, at, delims, quoted))
            start, delims, quoted = at + 1, 0, False
        at += 1
    pieces.append((start, len(line), delims, quoted))
    return pieces, inside


_SCHEMA = "file string, block bigint, place bigint, reading int, line binary, " + ", ".join(f"follows{s} boolean, open{s} boolean, delims{s} int, quoted{s} boolean, begun{s} bigint" for s in (0, 1))


def _scanned(lines: DataFrame, delimiter: str) -> DataFrame:
    """Pieces of lines (file, block, line), blocks in order within a partition, under both states that the block may begin in."""
    d = delimiter.encode()
    names = [c.split(" ")[0] for c in _SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), *[pa.bool_(), pa.bool_(), pa.int32(), pa.bool_(), pa.int64()] * 2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun, place = None, [False, True], [0, 0], 0
        for b in batches:
            out = []
            for file, block, line in zip(*[c.to_pylist() for c in b.columns]):
                if (file, block) != at:
                    at, state, begun, place = (file, block), [False, True], [0, 0], 0
                found = [scan_line(line, s, d) for s in (state if state[0] != state[1] else state[:1])]
                together = len(found) == 1 or all(len(f[0]) == 1 for f in found)
                for s, (pieces, after) in enumerate(found):
                    if together and s:
                        break
                    for i, (start, end, _, _) in enumerate(pieces):
                        place += 1
                        row = [file, block, place, BOTH if together else s, line[start:end]]
                        for t in (0, 1):
                            own, behind = found[t] if t < len(found) else found[0]
                            if not together and t != s:
                                row += [None] * 5
                                continue
                            follows = i == 0 and state[t]
                            begun[t] += not follows
                            row += [follows, i == len(own) - 1 and behind, own[i][2], own[i][3], begun[t]]
                        out.append(row)
                state = [f[1] for f in found] if len(found) == 2 else [found[0][1]] * 2
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return lines.select("file", F.col("block").cast("bigint"), F.coalesce("line", F.lit("")).cast("binary").alias("line")).mapInArrow(run, _SCHEMA)


def _starts(rows: DataFrame) -> DataFrame:
    """(file, block, state, before): the state each block begins in and the records begun before it."""
    ends = [F.max_by(F.struct(F.col(f"open{s}").alias("open"), F.col(f"begun{s}").alias("begun")), F.when(F.col("reading").isin(s, BOTH), F.col("place"))).alias(f"end{s}") for s in (0, 1)]
    blocks = rows.groupBy("file", "block").agg(*ends)
    order = Window.partitionBy("file").orderBy("block")
    so_far = order.rowsBetween(Window.unboundedPreceding, -1)
    # a block keeps the state, turns it, or sets it: the last one that set it and the turns since then decide
    sets = F.col("end0.open") == F.col("end1.open")
    turns = (F.col("end0.open") & ~F.col("end1.open")).cast("int")
    turned = blocks.select("*", F.coalesce(F.sum(turns).over(so_far), F.lit(0)).alias("turned"))
    last = F.last(F.when(sets, F.struct(F.col("end0.open").alias("open"), F.col("turned").alias("turned"))), ignorenulls=True).over(so_far)
    known = turned.withColumn("last", last)
    state = (F.coalesce(F.col("last.open").cast("int"), F.lit(0)) + F.col("turned") - F.coalesce("last.turned", F.lit(0))) % 2
    placed = known.withColumn("state", state.cast("int"))
    begun = F.when(F.col("state") == 0, F.col("end0.begun")).otherwise(F.col("end1.begun"))
    return placed.select("file", "block", "state", F.coalesce(F.sum(begun).over(so_far), F.lit(0)).alias("before"))


def in_blocks(lines: DataFrame) -> DataFrame:
    """Lines with their block; for any table of numbered lines (file, line_no, line) its range partitions are the blocks."""
    if "block" in lines.columns:
        return lines
    dealt = pin_partitions(lines.select("file", "line_no", "line").repartitionByRange("file", "line_no").sortWithinPartitions("file", "line_no"))
    return dealt.withColumn("block", F.spark_partition_id())


def assemble_records(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """(file, record_no, line, fields, quoted, crlf) of lines (file, block, line_id, line) or (file, line_no, line).

    ``fields`` is the number of fields, ``quoted`` whether a quoted field holds a delimiter, ``crlf`` whether CR LF ends the record.
    """
    rows = cut_lineage(_scanned(in_blocks(lines), delimiter))
    own = lambda name: F.when(F.col("state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")).alias(name)
    # one row a block, written, so that its real size lets the lines stay where they are
    read = rows.join(cut_lineage(_starts(rows)), ["file", "block"]).filter((F.col("reading") == BOTH) | (F.col("reading") == F.col("state")))
    line = F.col("line").cast("string")
    pieces = read.select("file", "block", "place", line.alias("line"), own("follows"), own("open"), own("delims"), own("quoted"), (F.col("before") + own("begun")).alias("record_no"))
    crlf = ~F.col("open") & F.col("line").endswith("\r")
    pieces = pieces.withColumn("crlf", crlf).withColumn("line", F.when(crlf, F.expr("substring(line, 1, char_length(line) - 1)")).otherwise(F.col("line")))
    several = F.col("follows") | F.col("open")
    single = pieces.filter(~several).select("file", "record_no", "line", (F.col("delims") + 1).alias("fields"), "quoted", "crlf")
    parts = F.array_sort(F.collect_list(F.struct("block", "place", "line")))
    joined = pieces.filter(several).groupBy("file", "record_no").agg(F.array_join(parts["line"], "\n").alias("line"), (F.sum("delims") + 1).cast("int").alias("fields"), F.bool_or("quoted").alias("quoted"), F.bool_or("crlf").alias("crlf"))
    return single.unionByName(joined)
