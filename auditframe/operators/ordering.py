"""Global positions and fixed-size chunks of a totally ordered table, without a single-task sort.

Rows are range-partitioned by the order columns, pinned, and numbered from per-partition counts.  Chunks have a fixed
number of rows whatever the keys look like, so a hot key cannot blow up one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditframe.session import cut_lineage, pin_partitions

_ROW_BITS = 1 << 33  # monotonically_increasing_id: partition number above, row number below this bit


def partition_offsets(pinned: DataFrame, weight: Column | None = None) -> DataFrame:
    """(__pid, __offset, __total): rows (or summed weights) in all earlier partitions; one row per partition."""
    per = pinned.groupBy(F.spark_partition_id().alias("__pid")).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n"))
    upto = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return per.select(
        "__pid", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__offset"), F.sum("__n").over(everything).alias("__total")
    )


def with_positions(df: DataFrame, order: list[Column], name: str = "position", total: str | None = None) -> DataFrame:
    """Add the 1-based place of every row in the given total order (and the row count, if named)."""
    pinned = pin_partitions(df.repartitionByRange(*order).sortWithinPartitions(*order))
    tagged = pinned.withColumns({"__pid": F.spark_partition_id(), "__row": F.monotonically_increasing_id() % _ROW_BITS})
    placed = tagged.join(F.broadcast(partition_offsets(pinned)), "__pid")  # one row per partition
    extra = [] if total is None else [F.col("__total").alias(total)]
    return placed.select(*df.columns, (F.col("__offset") + F.col("__row") + 1).cast("bigint").alias(name), *extra)


def with_chunks(df: DataFrame, size: int, halo: int, position: str = "position") -> DataFrame:
    """Add ``chunk`` and repeat the last ``halo`` rows of each chunk at the head of the next one (``is_halo``)."""
    if halo > size:
        raise ValueError("halo must not exceed the chunk size")
    own = ((F.col(position) - 1) / size).cast("bigint")
    spill = (F.col(position) - 1) % size >= size - halo
    homes = F.when(spill, F.array(F.struct(own.alias("chunk"), F.lit(False).alias("is_halo")), F.struct((own + 1).alias("chunk"), F.lit(True).alias("is_halo")))).otherwise(
        F.array(F.struct(own.alias("chunk"), F.lit(False).alias("is_halo")))
    )
    return df.withColumn("__home", F.explode(homes)).select("*", "__home.chunk", "__home.is_halo").drop("__home")


def exact_median(df: DataFrame, value: str) -> DataFrame:
    """One row (median, values): exact middle value, or the mean of the two middle values.

    Equal values are counted before the sort, so no value is too frequent for a partition.
    """
    # written, as a range partition reads its rows twice and the values may cost much
    counted = cut_lineage(df.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")))
    # missing values leave only here: a filter above would be pushed into, and repeat, the expression behind the value
    pinned = pin_partitions(counted.repartitionByRange("v").sortWithinPartitions("v")).filter("v IS NOT NULL")
    placed = pinned.withColumn("__pid", F.spark_partition_id()).join(F.broadcast(partition_offsets(pinned, F.col("n"))), "__pid")
    low, high = F.floor((F.col("__total") + 1) / 2), F.floor(F.col("__total") / 2) + 1
    sizes = partition_offsets(pinned, F.col("n")).withColumn("__end", F.lead("__offset", 1).over(Window.orderBy("__pid")))
    hit = sizes.filter((F.col("__offset") < high) & (F.coalesce("__end", "__total") >= low)).select("__pid")
    inside = placed.join(F.broadcast(hit), "__pid", "left_semi")
    upto = F.col("__offset") + F.sum("n").over(Window.partitionBy("__pid").orderBy("v"))
    ranked = inside.withColumn("__upto", upto)
    covers = lambda rank: F.max(F.when((F.col("__upto") - F.col("n") < rank) & (rank <= F.col("__upto")), F.col("v")))
    ends = ranked.agg(covers(low).alias("a"), covers(high).alias("b"), F.max("__total").alias("values"))
    return ends.select(((F.col("a") + F.col("b")) / 2).alias("median"), F.coalesce("values", F.lit(0)).cast("bigint").alias("values"))


def rank_within(df: DataFrame, groups: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Add the 1-based rank of each row inside its group, for groups of any size (no per-group sort in one task)."""
    columns = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in [*groups, *order]]
    placed = with_positions(df, columns, "__position")
    starts = placed.groupBy(*groups).agg(F.min("__position").alias("__start"))
    ranked = placed.join(starts, groups)
    return ranked.select(*df.columns, (F.col("__position") - F.col("__start") + 1).cast("bigint").alias(name))
