"""Layout of delimited text found from its content: delimiter, header row, field counts, quoting hazards.

All jobs run over the records that ``assemble_records`` makes of ``(file, line_no, line)`` and are keyed by file, so one job covers a folder of files.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.functions.text import trim_cell
from auditframe.session import cut_lineage
from auditframe.sources.records import assemble_records, in_blocks

# Delimiter candidates in order of preference, records that may be the header.
CANDIDATES = {"comma": ",", "semicolon": ";", "tab": "\t", "pipe": "|"}
HEADER_CANDIDATES = 3


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_id, line, file_bytes): physical lines; within a file they order by (block, line_id).

    Lines end at the newline, so a carriage return stays at the end of its line, and bytes that are no UTF-8 stay as they are.
    """
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"), F.col("value").alias("line"), F.col("_metadata.file_size").alias("file_bytes"),
    )


def bare(line: Column) -> Column:
    """The line without a byte-order mark before it and a carriage return after it."""
    return F.regexp_replace(line, "\\A\ufeff|\r\\z", "")


def _field_pattern(delimiter: str) -> str:
    d = re.escape(delimiter)
    return f'{d}("(?:[^"]++|"")*+"?[^{d}]*+|[^{d}]*+)'


def fields(line: Column, delimiter: str) -> Column:
    """Field values of one record, quotes resolved."""
    parts = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(_field_pattern(delimiter)), F.lit(1))
    return F.transform(
        parts, lambda p: F.when(p.startswith('"'), F.replace(F.regexp_replace(p, '\\A"((?:[^"]++|"")*+)"?', "$1"), F.lit('""'), F.lit('"'))).otherwise(p)
    )


def detect_delimiter(lines: DataFrame) -> DataFrame:
    """Per file: winning delimiter, runner-up and margin, by modal field count times consistency over all records."""
    counted, lines = None, in_blocks(lines)
    for i, (name, d) in enumerate(CANDIDATES.items()):
        own = assemble_records(lines, d).select("file", F.lit(i).alias("ord"), F.lit(name).alias("label"), F.col("fields").alias("k"))
        counted = own if counted is None else counted.unionByName(own)
    modes = counted.groupBy("file", "ord", "label", "k").count()
    modal = modes.groupBy("file", "ord", "label").agg(F.max(F.struct("count", "k")).alias("m"))
    score = F.when(F.col("m.k") <= 1, 0).otherwise(F.col("m.count") * (F.col("m.k") - 1))
    # four candidates per file
    ranked = modal.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-score).alias("neg"), "ord", "label", F.col("m.k").alias("k")))).alias("r"))
    first, second = F.element_at("r", 1), F.element_at("r", 2)
    return ranked.select(
        "file", first["label"].alias("winner"), first["k"].alias("field_count"), (-first["neg"]).cast("bigint").alias("score"),
        second["label"].alias("runner_up"), (-second["neg"]).cast("bigint").alias("runner_up_score"), (second["neg"] - first["neg"]).cast("bigint").alias("margin"),
    )


def detect_header(records: DataFrame, delimiter: str) -> DataFrame:
    """Per file of records (file, record_no, line): which of the first three looks most like a header, its names, score and margin.

    A header has textual, distinct cells that do not repeat in the records below it.
    """
    cells = F.transform(fields(bare(F.col("line")), delimiter), trim_cell)
    # three records a file, written: where their real size is small the records meet them in place, so that no file lands in one task
    head = cut_lineage(records.filter(F.col("record_no") <= HEADER_CANDIDATES).select("file", F.col("record_no").alias("place"), cells.alias("cells")))
    body = records.select("file", F.col("record_no").alias("below"), cells.alias("other"))
    n = F.size("cells")
    texty = F.size(F.filter("cells", lambda c: (F.length(c) > 0) & ~c.rlike(r"\A[+-]?[\d.,]+\z")))
    unique = F.size(F.array_distinct("cells"))
    # the records of a file meet its three candidates, themselves among them, so the join grows with the records and loses no candidate
    pairs = body.join(head, "file")
    under = F.col("below") > F.col("place")
    equal = F.size(F.filter(F.arrays_zip(F.col("cells").alias("a"), F.col("other").alias("b")), lambda z: z["a"] == z["b"]))
    repeats = pairs.groupBy("file", "place", "cells").agg(F.sum(F.when(under, equal).otherwise(0)).alias("repeats"), F.count_if(under).alias("rows_below"))
    score = texty / n * 0.5 + unique / n * 0.5 - F.col("repeats") / (n * F.greatest(F.lit(1), F.col("rows_below")))
    scored = repeats.withColumn("score", F.when(n == 0, 0.0).otherwise(score))
    ranked = scored.groupBy("file").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "place", "cells"))).alias("r"))
    first = F.element_at("r", 1)
    runner = F.coalesce(-F.try_element_at("r", F.lit(2))["neg"], F.lit(0.0))
    return ranked.select(
        "file", first["place"].alias("header_place"), F.round(-first["neg"] * 1000).cast("bigint").alias("score"), F.round(runner * 1000).cast("bigint").alias("runner_up_score"),
        F.array_join(first["cells"], "|").alias("names"),
    )


def field_count_histogram(records: DataFrame) -> DataFrame:
    return records.groupBy("file", F.col("fields").alias("field_count")).agg(F.count("*").alias("records"))


def ragged(histogram: DataFrame) -> DataFrame:
    """Per file: histogram text and whether records differ in their field count."""
    entries = F.transform(F.array_sort(F.collect_list(F.struct("field_count", "records"))), lambda e: F.concat(e["field_count"].cast("string"), F.lit("x"), e["records"].cast("string")))
    return histogram.groupBy("file").agg(F.array_join(entries, ", ").alias("histogram"), (F.count("*") > 1).alias("ragged"))


def naive_field_count_histogram(lines: DataFrame, records: DataFrame, delimiter: str) -> DataFrame:
    """Quote-blind field counts of lines next to the field counts of records, and how many lines the blind reading counts in excess."""
    line = bare(F.col("line"))
    naive = F.length(line) - F.length(F.replace(line, F.lit(delimiter), F.lit(""))) + 1
    blind = lines.filter(line != "").groupBy("file", naive.alias("field_count")).agg(F.count("*").alias("lines"))
    both = blind.join(field_count_histogram(records), ["file", "field_count"], "full_outer")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint") for c in ("lines", "records")]
    return both.select("file", "field_count", counts[0].alias("lines"), counts[1].alias("records"), F.greatest(F.lit(0), counts[0] - counts[1]).cast("bigint").alias("disagreeing"))


def quoted_delimiter_stats(lines: DataFrame, records: DataFrame) -> DataFrame:
    """Per file: records, those with a delimiter inside quotes, line terminators, lines that are no UTF-8, byte-order mark."""
    line = F.col("line")
    # the reader takes the mark off the first line, so files read here show it in their size; one byte may lack after the last line
    mark = F.bool_or(line.startswith("\ufeff"))
    if "file_bytes" in lines.columns:
        mark = mark | (F.max("file_bytes") - F.sum(F.octet_length(line) + 1) >= 2)
    raw = lines.groupBy("file").agg(F.count_if(~F.is_valid_utf8(line)).alias("invalid_utf8"), mark.alias("byte_order_mark"))
    seen = records.groupBy("file").agg(F.count("*").alias("records"), F.count_if("quoted").alias("quoted_delimiter"), F.count_if("crlf").alias("crlf"))
    return seen.join(raw, "file").select("file", "records", "quoted_delimiter", "crlf", "invalid_utf8", "byte_order_mark")
