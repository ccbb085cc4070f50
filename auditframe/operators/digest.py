"""Canonical order, digests, probes and coverage of result tables.

A digest is a hash tree over items in canonical order: while there are more than ``BLOCK_ROWS`` items, every ``BLOCK_ROWS`` of them are replaced by
the SHA-256 of their lines; the digest is the SHA-256 of a head and the lines that are left.  The items are a column's cells, a
keyed entry's cells or a keyed list's lines.  The definition is the same at every size: blocks are hashed in parallel, no group
holds more than ``BLOCK_ROWS`` items, and what fits into one block has the digest of its plain lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.functions.canonical import CANONICALISATION as CELLS, canonical_cell, canonical_number, kind_of
from auditframe.operators.ordering import rank_within, with_positions
from auditframe.session import cut_lineage

BLOCK_ROWS = 10_000
CANONICALISATION = f"{CELLS}/blocks-{BLOCK_ROWS}"

# an order key is a column name, or (column name, "asc" | "desc")
OrderKey = str | tuple[str, str]


def order_columns(keys: list[OrderKey]) -> list[Column]:
    """Missing values last in both directions; strings compare bytewise."""
    out = []
    for key in keys:
        name, direction = (key, "asc") if isinstance(key, str) else key
        out.append(F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_last())
    return out


def _names(keys: list[OrderKey]) -> list[str]:
    return [k if isinstance(k, str) else k[0] for k in keys]


def canonical_order(df: DataFrame, keys: list[OrderKey]) -> DataFrame:
    """Rows with their 1-based ``position`` in canonical order."""
    return with_positions(df, order_columns(keys))


def order_violations(df: DataFrame, keys: list[OrderKey]) -> DataFrame:
    """Key tuples held by several rows; an empty result means the order is total."""
    return df.groupBy(*_names(keys)).agg(F.count("*").alias("rows")).filter("rows > 1")


def canonical_table(df: DataFrame, columns: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """Every column as canonical text (named ``c__<column>``), plus columns to keep as they are."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    texts = [canonical_cell(F.col(c), kinds[c]).alias(f"c__{c}") for c in (columns or df.columns)]
    return df.select(*[F.col(k) for k in keep or []], *texts)


def _hashed(lines: Column, head: Column, whole: Column) -> Column:
    """Hash of lines, behind the head where they are all that is left."""
    text = F.array_join(lines, "\n")
    return F.sha2(F.when(whole, F.concat_ws("\n", head, text)).otherwise(text), 256)


def _root(level: DataFrame, by: list[str], head: Column, block_rows: int) -> DataFrame:
    """(by, rows, digest) of hashed blocks (by, block, rows, items, digest), whatever their number; ``items`` counts the blocks of a tree."""
    done = []
    while True:
        level = cut_lineage(level)
        done.append(level.filter("items = 1").select(*by, "rows", "digest"))
        level = level.filter("items > 1")
        if level.isEmpty():
            out = done[0]
            for more in done[1:]:
                out = out.unionByName(more)
            return out
        grouped = level.groupBy(*by, "rows", "items", F.floor(F.col("block") / block_rows).alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "digest"))).alias("x"))
        level = grouped.select(*by, F.col("up").alias("block"), "rows", F.ceil(F.col("items") / block_rows).alias("items"), _hashed(F.col("x.digest"), head, F.col("items") <= block_rows).alias("digest"))


def tree_digests(df: DataFrame, keys: list[OrderKey], columns: list[str], entry: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(entry, column, rows, digest) of every column, each entry as a table of its own."""
    base = df.withColumn("__entry", F.lit("") if entry is None else entry)
    if entry is None:
        placed = with_positions(base, order_columns(keys), total="__rows")
    else:
        placed = rank_within(base, ["__entry"], order_columns(keys), "position")
        placed = placed.join(base.groupBy("__entry").agg(F.count("*").alias("__rows")), "__entry")
    texts = canonical_table(placed, columns, ["__entry", "__rows", "position"])
    block = F.floor((F.col("position") - 1) / block_rows).alias("block")
    blocks = texts.groupBy("__entry", "__rows", block).agg(F.array_sort(F.collect_list(F.struct("position", *[f"c__{c}" for c in columns]))).alias("x"))
    head = lambda name: F.concat_ws("\n", F.lit("col"), name, F.col("rows").cast("string"))
    blocks = blocks.withColumnRenamed("__rows", "rows")
    cells = [F.struct(F.lit(c).alias("column"), _hashed(F.col(f"x.c__{c}"), head(F.lit(c)), F.col("rows") <= block_rows).alias("digest")) for c in columns]
    hashed = blocks.select(F.col("__entry").alias("entry"), "block", "rows", F.ceil(F.col("rows") / block_rows).alias("items"), F.explode(F.array(*cells)).alias("h"))
    return _root(hashed.select("entry", "block", "rows", "items", "h.*"), ["entry", "column"], head(F.col("column")), block_rows)


def column_digests(df: DataFrame, keys: list[OrderKey], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(column, rows, digest) per column, cells in canonical row order."""
    return tree_digests(df, keys, df.columns, None, block_rows).select("column", "rows", "digest")


def _object_text(kind: str, columns: list[str], digests: Column) -> Column:
    """Text of an object: its kind, shape and ``name=digest`` lines in declared column order."""
    lines = F.array(*[F.concat(F.lit(f"{c}="), F.try_element_at(digests, F.lit(c))) for c in columns])
    return F.concat_ws("\n", F.lit("obj"), F.lit(kind), F.col("rows").cast("string"), F.lit(str(len(columns))), F.array_join(lines, "\n"))


def _objects(digests: DataFrame, columns: list[str], kind: str, by: list[str]) -> DataFrame:
    """One row per entry; a group holds one row per column."""
    grouped = digests.groupBy(*by, "rows").agg(F.map_from_entries(F.collect_list(F.struct("column", "digest"))).alias("d"))
    return grouped.select(*by, "rows", F.lit(len(columns)).alias("cols"), F.sha2(_object_text(kind, columns, F.col("d")), 256).alias("digest"))


def object_digest(df: DataFrame, keys: list[OrderKey], kind: str = "frame") -> DataFrame:
    """One row: rows, cols, digest and the canonicalisation it was made under."""
    return _objects(column_digests(df, keys), df.columns, kind, []).withColumn("canonicalisation", F.lit(CANONICALISATION))


def keyed_digests(df: DataFrame, key: str, keys: list[OrderKey], columns: list[str] | None = None) -> DataFrame:
    """(entry, rows, cols, digest): one object per key value, as if each were a table of its own."""
    columns = columns or [c for c in df.columns if c != key]
    return _objects(tree_digests(df, keys, columns, F.col(key).cast("string")), columns, "frame", ["entry"])


def keyed_list_digest(entries: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(digest, entries) of a keyed list: ``key=<entry digest>`` lines in bytewise key order, any number of keys."""
    placed = with_positions(entries.select("entry", "digest"), [F.col("entry")], total="rows")
    line = F.concat("entry", F.lit("="), "digest")
    blocks = placed.groupBy("rows", F.floor((F.col("position") - 1) / block_rows).alias("block")).agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("x"))
    nothing = F.lit(None).cast("string")  # a list has no head
    hashed = blocks.select("block", "rows", F.ceil(F.col("rows") / block_rows).alias("items"), _hashed(F.col("x.line"), nothing, F.lit(False)).alias("digest"))
    return _root(hashed, [], nothing, block_rows).select("digest", F.col("rows").alias("entries"))


def block_digests(df: DataFrame, keys: list[OrderKey], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(column, rows, digest, canonicalisation) with blocks of another size."""
    return column_digests(df, keys, block_rows).withColumn("canonicalisation", F.lit(f"{CELLS}/blocks-{block_rows}"))


def probes(df: DataFrame, keys: list[OrderKey]) -> DataFrame:
    """Three rows (selection_rule, fields): first, middle and last row in canonical order as column -> text."""
    placed = with_positions(df, order_columns(keys), total="__n")
    middle = F.ceil(F.col("__n") / 2)
    rules = F.array_compact(
        F.array(
            F.when(F.col("position") == 1, F.lit("index:1")),
            F.when(F.col("position") == middle, F.lit("index:ceil(n/2)")),
            F.when(F.col("position") == F.col("__n"), F.lit("index:n")),
        )
    )
    chosen = cut_lineage(placed.withColumn("rule", F.explode(rules)).drop("__n", "position"))
    texts = canonical_table(chosen, df.columns, ["rule"])
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(f"c__{c}"))]
    return texts.select(F.col("rule").alias("selection_rule"), F.create_map(*pairs).alias("fields"))


def keyed_probes(df: DataFrame, key: str, keys: list[OrderKey], columns: list[str]) -> DataFrame:
    """(entry, selection_rule, fields): first, middle and last row of every entry in canonical order, entries of any size."""
    base = df.select(F.col(key).cast("string").alias("__entry"), *dict.fromkeys([*columns, *_names(keys)]))
    placed = rank_within(base, ["__entry"], order_columns(keys), "position").join(base.groupBy("__entry").agg(F.count("*").alias("__rows")), "__entry")
    rules = {"index:1": F.lit(1), "index:ceil(n/2)": F.ceil(F.col("__rows") / 2), "index:n": F.col("__rows")}
    hit = F.array_compact(F.array(*[F.when(F.col("position") == at, F.lit(name)) for name, at in rules.items()]))
    texts = canonical_table(placed.select("__entry", F.explode(hit).alias("rule"), *columns), columns, ["__entry", "rule"])
    pairs = [x for c in columns for x in (F.lit(c), F.col(f"c__{c}"))]
    return texts.select(F.col("__entry").alias("entry"), F.col("rule").alias("selection_rule"), F.create_map(*pairs).alias("fields"))


def coverage(df: DataFrame) -> DataFrame:
    """One row: row, field and null counts, least and greatest numeric cell as canonical text."""
    kinds = {f.name: kind_of(f.dataType) for f in df.schema.fields}
    numbers = [c for c, k in kinds.items() if k == "num"]
    nulls = F.lit(0)
    for c in df.columns:
        nulls = nulls + F.count_if(F.col(c).isNull())
    aggs = [F.count("*").alias("row_count"), nulls.cast("bigint").alias("null_count")]
    for c in numbers:
        aggs += [F.min(F.col(c).cast("double")).alias(f"lo_{c}"), F.max(F.col(c).cast("double")).alias(f"hi_{c}")]
    row = df.agg(*aggs)

    def extreme(prefix: str, pick) -> Column:
        found = [F.col(f"{prefix}_{c}") for c in numbers]
        value = F.lit(None).cast("double") if not found else found[0] if len(found) == 1 else pick(*found)
        return F.when(value.isNotNull(), canonical_number(value))

    return row.select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("field_count"), "null_count",
        extreme("lo", F.least).alias("min"), extreme("hi", F.greatest).alias("max"),
    )


def checkpoint(df: DataFrame, name: str, keys: list[OrderKey], inputs: DataFrame, unit: str = "U01") -> DataFrame:
    """One row describing a result table: shape, order, digest, coverage, probes and the inputs it was made from."""
    df = cut_lineage(df)
    body = object_digest(df, keys)
    cover = coverage(df).select(F.struct("*").alias("coverage")).scalar()
    found = probes(df, keys).agg(F.array_sort(F.collect_list(F.struct("selection_rule", F.to_json("fields").alias("fields")))).alias("p")).scalar()
    bound = inputs.agg(F.array_sort(F.collect_list(F.struct("name", "bytes", "sha256"))).alias("i")).scalar()
    order = F.array(*[F.struct(F.lit(k if isinstance(k, str) else k[0]).alias("column"), F.lit("asc" if isinstance(k, str) else k[1]).alias("direction")) for k in keys])
    return body.select(
        F.lit(unit).alias("unit"), F.lit(name).alias("name"), F.lit("frame").alias("kind"), "rows", "cols",
        F.array(*[F.lit(c) for c in df.columns]).alias("colnames"), order.alias("canonical_order"),
        F.struct(F.lit("SHA-256").alias("algorithm"), "canonicalisation", F.col("digest").alias("value")).alias("digest"),
        cover.alias("coverage"), found.alias("probes"), bound.alias("inputs"),
    )
