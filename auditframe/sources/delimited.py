"""Readers for delimited and positional text, input binding, and sinks."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.session import cut_lineage, freed_shuffles
from auditframe.sources.layout import fields, read_lines
from auditframe.sources.records import assemble_records


def read_contract_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All columns as text, bound by header name, plus ``file`` and the 1-based ``row_index`` in the file.

    Files are split whether quoted fields hold line breaks or not.  The first of two equal header names wins; a file without a
    column has null there, a record too short for its file's header has an empty text.
    """
    records = assemble_records(read_lines(spark, path), delimiter)
    cells = records.select("file", "record_no", fields(F.col("line"), delimiter).alias("cells"))
    heads = cut_lineage(cells.filter("record_no = 1").select("file", F.col("cells").alias("names")))
    # the schema: distinct names, whatever the number of files
    first = heads.groupBy("names").agg(F.min("file").alias("file")).select("file", F.posexplode("names").alias("place", "name"))
    names = [r["name"] for r in first.groupBy("name").agg(F.min(F.struct("place", "file")).alias("at")).orderBy("at", "name").collect()]
    if not names:
        raise FileNotFoundError(path)
    at = lambda n: F.array_position("names", F.lit(n)).cast("int")
    values = [F.when(at(n) > 0, F.coalesce(F.try_element_at("cells", F.greatest(at(n), F.lit(1))), F.lit(""))).alias(n) for n in names]
    return cells.filter("record_no > 1").join(heads, "file").select("file", *values, (F.col("record_no") - 1).alias("row_index"))


def split_positional(lines: DataFrame, names: list[str], delimiter: str = "|") -> DataFrame:
    """Named columns of headerless lines; positions a short line lacks are null."""
    parts = F.split("line", F.lit("\\" + delimiter))
    return lines.select(*[c for c in lines.columns if c != "line"], *[F.try_element_at(parts, F.lit(i)).alias(n) for i, n in enumerate(names, 1)])


def read_positional(spark: SparkSession, path: str, names: list[str], delimiter: str = "|", encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless delimited files as text columns, decoded under their declared encoding."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.decode(F.col("value").cast("binary"), encoding).alias("line"))
    return split_positional(raw, names, delimiter)


LARGEST_CELL = 64 << 20  # bytes of a file that a task takes into one cell
LARGEST_READ = "spark.sql.sources.binaryFile.maxLength"


def bind_inputs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(name, bytes, sha256) per input file.

    SHA-256 runs through a file from its first byte to its last.  Tasks hash the files that fit into a cell; a larger one is
    streamed through the driver's JVM, a few files at a time and a small buffer of each, by the file system that Spark reads it with.
    """
    files = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    limit = min(LARGEST_CELL, int(spark.conf.get(LARGEST_READ)))
    small = files.filter(F.col("length") <= limit).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.filter(F.col("length") > limit).select("path", name, F.col("length").alias("bytes")).collect()  # one row a file, contents are not read
    if not large:
        return small
    with ThreadPoolExecutor(4) as pool:
        digests = list(pool.map(lambda r: _streamed_sha256(spark, r["path"]), large))
    return small.unionByName(spark.createDataFrame([(r["name"], r["bytes"], d) for r, d in zip(large, digests)], small.schema))


def _streamed_sha256(spark: SparkSession, path: str) -> str:
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    file = jvm.org.apache.hadoop.fs.Path(path)
    stream = file.getFileSystem(sc._jsc.hadoopConfiguration()).open(file)
    try:
        return jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes) of what storage holds below a folder; contents are not read.

    A listing starts a task for every folder, up to 10,000; a task lists many folders as well, so a few for each core do.
    """
    tasks = spark.conf.get(LISTING_TASKS)
    spark.conf.set(LISTING_TASKS, str(min(int(tasks), 4 * spark.sparkContext.defaultParallelism)))
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)  # lists here
    finally:
        spark.conf.set(LISTING_TASKS, tasks)
    return files.select("path", F.col("length").alias("bytes"))


# --- sinks -------------------------------------------------------------------------------------------------------------


def write_json(df: DataFrame, path: str) -> None:
    """One object a row, in gzip: every object repeats all its field names."""
    with freed_shuffles(df.sparkSession):
        df.write.mode("error").option("compression", "gzip").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    with freed_shuffles(df.sparkSession):
        df.write.mode("error").parquet(path)


def write_document(lines: DataFrame, path: str) -> None:
    """Text with one line feed per line; the part files, taken in name order, are the document."""
    ordered = lines.repartitionByRange("line_no").sortWithinPartitions("line_no")
    with freed_shuffles(lines.sparkSession):
        ordered.select("line_text").write.mode("error").option("lineSep", "\n").text(path)
