"""Reading tables, written steps and small helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.session import cut_lineage, scratch_path

__all__ = ["ascii_words", "batches_of", "cut_lineage", "held_out", "is_exotic", "pick", "scratch_path", "table"]

BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def batches_of(spark: SparkSession, rows: int = 1000) -> None:
    """Bound the rows of one Arrow batch, because texts can be long; a value the cluster chose itself stays."""
    if spark.conf.get(BATCH_SETTING, None) in (None, "10000"):
        spark.conf.set(BATCH_SETTING, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    batches_of(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under fixed names, so that extra or clashing columns of the input cannot interfere."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, as UTF-8 (bytes.lower and bytes.split do exactly that)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: White space besides space and \\t..\\r: the characters on which regular-expression engines may differ.
_EXOTIC = frozenset("\x1c\x1d\x1e\x1f\x85\xa0 ᠎    　") | {chr(c) for c in range(0x2000, 0x200C)}


def is_exotic(text: str) -> bool:
    """Whether the text holds white space other than space and \\t..\\r."""
    return not text.isascii() and not _EXOTIC.isdisjoint(text) or any(c in text for c in "\x1c\x1d\x1e\x1f")
