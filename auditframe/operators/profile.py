"""Input profiles: value frequencies, cell kinds, ranges, magnitudes, gaps, column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from auditframe.functions.amounts import NUMBER_PATTERN, amount, classify_cell, profile_date, profile_number
from auditframe.functions.dates import PLAUSIBLE_FROM, PLAUSIBLE_TO, date_class, implausible, is_marker, mixed_date
from auditframe.functions.text import is_exponent_id, trim_cell
from auditframe.operators.ordering import rank_within, with_chunks, with_positions


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): how often each text occurs per column; the shared basis of the profile.

    Equal cells are combined before the shuffle and keys spread over field and value, so all later classification
    runs once per distinct text.
    """
    return df.unpivot([], columns, "field", "value").groupBy("field", F.coalesce("value", F.lit("")).alias("value")).agg(F.count("*").alias("n"))


def profile(counts: DataFrame) -> DataFrame:
    """Per field: kind histogram, null count, distinct, duplicates, range of numbers, or of dates when there are none."""
    kinds = ["date_iso", "date_yyyymmdd", "empty_marker", "number_de_comma", "number_plain", "text"]
    marked = counts.withColumns({"kind": classify_cell(F.col("value")), "num": profile_number(F.col("value")), "day": profile_date(F.col("value"))})
    stats = marked.groupBy("field").agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("kind") == "empty_marker", F.col("n"))), F.lit(0)).alias("null_count"),
        F.min("num").alias("min_number"),
        F.max("num").alias("max_number"),
        F.min("day").alias("min_day"),
        F.max("day").alias("max_day"),
        *[F.sum(F.when(F.col("kind") == k, F.col("n"))).alias(f"k_{k}") for k in kinds],
    )
    no_numbers = F.col("min_number").isNull()
    types = F.concat_ws("+", *[F.when(F.col(f"k_{k}").isNotNull(), F.concat(F.lit(f"{k}:"), F.col(f"k_{k}").cast("string"))) for k in kinds])
    return stats.select(
        "field", "rows", types.alias("type"), "null_count", "distinct_values", (F.col("rows") - F.col("distinct_values")).alias("duplicates"),
        "min_number", "max_number", F.when(no_numbers, F.col("min_day")).alias("min_date"), F.when(no_numbers, F.col("max_day")).alias("max_date"),
    )


def approximate_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Single-pass profile with sketched distinct counts, for tables where exact ones are not worth a shuffle."""
    aggs = []
    for c in columns:
        aggs += [F.approx_count_distinct(c).alias(f"d_{c}"), F.count_if(classify_cell(F.coalesce(c, F.lit(""))) == "empty_marker").alias(f"z_{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"d_{c}").alias("approx_distinct"), F.col(f"z_{c}").alias("null_count")) for c in columns])
    return df.agg(*aggs).select(F.explode(rows).alias("x")).select("x.*")


def values_in_full(counts: DataFrame, limit: int | None = None) -> DataFrame:
    """(field, value, n, distinct_values): every value of every field; a report may leave out fields with more than ``limit``."""
    fields = counts.groupBy("field").agg(F.count("*").alias("distinct_values"))  # one row a field
    kept = counts.join(fields, "field").select("field", "value", "n", "distinct_values")
    return kept if limit is None else kept.filter(F.col("distinct_values") <= limit)


def magnitude_histogram(counts: DataFrame) -> DataFrame:
    """Integer digits of the numbers per field; zero has its own bucket."""
    num = profile_number(F.col("value"))
    digits = F.when(F.col("num") == 0, "0").otherwise(F.length(F.floor(F.abs("num")).cast("decimal(38,0)").cast("string")).cast("string"))
    numbers = counts.withColumn("num", num).filter("num IS NOT NULL")
    return numbers.groupBy("field", digits.alias("magnitude")).agg(F.sum("n").alias("n"))


def date_range(counts: DataFrame) -> DataFrame:
    """Earliest and latest date over all fields and whether both are believable."""
    found = counts.select(profile_date(F.col("value")).alias("d")).agg(F.min("d").alias("min_date"), F.max("d").alias("max_date"))
    fine = (F.col("min_date") > F.lit(PLAUSIBLE_FROM).cast("date")) & (F.col("max_date") < F.lit(PLAUSIBLE_TO).cast("date"))
    return found.select("min_date", "max_date", F.coalesce(fine, F.lit(False)).alias("plausible"))


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("<absent>")).alias("value")).agg(F.count("*").alias("n"))


def markers_seen(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing markers that really occur in the date columns."""
    cells = df.select(F.explode(F.array(*[trim_cell(F.col(c)) for c in columns])).alias("marker"))
    return cells.filter(is_marker(F.col("marker"))).distinct()


# --- column statistics ---------------------------------------------------------------------------------------------


def _long(stats: DataFrame, columns: list[str], names: list[str]) -> DataFrame:
    """One wide row of ``<name>__<column>`` cells to one row per column."""
    rows = F.array(*[F.struct(F.lit(c).alias("field"), *[F.col(f"{n}__{c}").alias(n) for n in names]) for c in columns])
    return stats.select(F.explode(rows).alias("x")).select("x.*")


def date_stats(df: DataFrame, columns: list[str], parsed: dict[str, str] | None = None) -> DataFrame:
    """Per date column: readings by class, parsed range and count, implausible dates.

    ``parsed`` names the column holding what the run really read (a coerced column reads less than its cells say).
    One pass, one row per partition in the shuffle.
    """
    parsed = parsed or {}
    cells = df.select(
        *[date_class(F.col(c)).alias(f"k__{c}") for c in columns],
        *[(F.col(parsed[c]) if c in parsed else mixed_date(F.col(c))).alias(f"d__{c}") for c in columns],
    )
    aggs = []
    for c in columns:
        kind, day = F.col(f"k__{c}"), F.col(f"d__{c}")
        hyphen_bad = F.count_if(kind == "unreadable_hyphenated")
        aggs += [
            F.count_if(kind == "marker").alias(f"marker__{c}"),
            F.count_if(kind == "hyphen_ok").alias(f"hyphen_valid__{c}"),
            F.count_if(kind == "digits_ok").alias(f"eight_digit_valid__{c}"),
            (F.count_if(kind == "unreadable") + hyphen_bad).alias(f"unreadable__{c}"),
            hyphen_bad.alias(f"unreadable_hyphenated__{c}"),
            F.count(day).alias(f"parsed_count__{c}"),
            F.min(day).alias(f"min_date__{c}"),
            F.max(day).alias(f"max_date__{c}"),
            F.count_if(implausible(day)).alias(f"implausible__{c}"),
        ]
    names = ["marker", "hyphen_valid", "eight_digit_valid", "unreadable", "unreadable_hyphenated", "parsed_count", "min_date", "max_date", "implausible"]
    return _long(cells.agg(*aggs), columns, names)


def first_offenders(df: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """The unreadable cells of each date column ranked in received order; a report may ask for the first ones only."""
    # computed in a projection of its own, which is compiled; inside a generator it would be interpreted
    bad = F.array(*[F.when(date_class(F.col(c)).startswith("unreadable"), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c in columns])
    listed = df.select("row_index", bad.alias("bad")).select("row_index", F.explode_outer("bad").alias("x"))
    cells = listed.filter(F.col("x").isNotNull()).select("x.field", "row_index", "x.value")
    if limit is None:
        return rank_within(cells, ["field"], ["row_index"], "rank")
    rank = F.row_number().over(Window.partitionBy("field").orderBy("row_index"))  # ranks are cut before the shuffle
    return cells.withColumn("rank", rank.cast("bigint")).filter(F.col("rank") <= limit)


def amount_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per amount column: missing, negative, range, comma and dot spellings, zero and empty texts."""
    cells = df.select(
        *[trim_cell(F.col(c)).alias(f"t__{c}") for c in columns], *[amount(F.col(c)).alias(f"v__{c}") for c in columns]
    )
    aggs = []
    for c in columns:
        t, v = F.col(f"t__{c}"), F.col(f"v__{c}")
        dotted = t.contains(".") & ~t.contains(",")
        aggs += [
            F.count_if(t.isNotNull() & v.isNull()).alias(f"missing__{c}"),
            F.count_if(v < 0).alias(f"negative__{c}"),
            F.min(v).alias(f"min_value__{c}"),
            F.max(v).alias(f"max_value__{c}"),
            F.count_if(t.rlike(",[^,]*,")).alias(f"multi_comma__{c}"),
            F.count_if(dotted).alias(f"dot_no_comma__{c}"),
            F.count_if(dotted & t.rlike(r"\.[^.]{3}\z")).alias(f"thousands_dot__{c}"),
            F.count_if(t == "0").alias(f"zero_text__{c}"),
            F.count_if(t == "").alias(f"empty_text__{c}"),
        ]
    names = ["missing", "negative", "min_value", "max_value", "multi_comma", "dot_no_comma", "thousands_dot", "zero_text", "empty_text"]
    return _long(cells.agg(*aggs), columns, names)


def id_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(column, F.lit("")).alias("id")).agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))


def id_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: rows, distinct, duplicated and exponent-shaped identifiers, bytewise range."""
    return id_counts(df, column).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("*").alias("distinct_ids"),
        F.count_if(F.col("n") > 1).alias("duplicated_ids"),
        F.coalesce(F.sum(F.when(is_exponent_id(F.col("id")), F.col("n"))), F.lit(0)).alias("exponent_shaped"),
        F.min("id").alias("min_id"),
        F.max("id").alias("max_id"),
    )


def first_ids(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Duplicated identifiers and exponent-shaped ones with their first row; a report may ask for the first ones only."""
    counts = id_counts(df, column)
    first = lambda d: d if limit is None else d.orderBy("first_row").limit(limit)
    twice = first(counts.filter("n > 1")).select(F.lit("duplicated").alias("what"), "id", "first_row")
    exponent = df.filter(is_exponent_id(F.col(column))).select(F.lit("exponent").alias("what"), F.col(column).alias("id"), F.col("row_index").alias("first_row"))
    return twice.unionByName(first(exponent))


# --- positional files and loose cells --------------------------------------------------------------------------------


def _loose_number(text: Column) -> Column:
    body = F.translate(F.replace(text, F.lit("."), F.lit("")), ",", ".")
    return F.when(body.rlike(NUMBER_PATTERN), body.try_cast("double"))


def profile_positional(lines: DataFrame, width: int, key: int, delimiter: str = "|") -> DataFrame:
    """Per position 1..width of headerless lines: nulls (short lines count), numeric range, text flag; distinct keys at ``key``."""
    parts = F.split("line", F.lit("\\" + delimiter))
    cells = lines.select(F.posexplode(parts).alias("i", "value")).filter(F.col("value") != "").filter(F.col("i") < width)
    num = _loose_number(F.col("value"))
    per = cells.groupBy((F.col("i") + 1).alias("position")).agg(
        F.count("*").alias("filled"), F.min(num).alias("min_value"), F.max(num).alias("max_value"), F.count_if(num.isNull()).alias("texts")
    )
    keys = lines.select(F.try_element_at(parts, F.lit(key)).alias("v")).filter("v != ''").groupBy("v").agg(F.count("*").alias("n"))
    key_stats = keys.agg(F.count("*").alias("d"), F.sum("n").alias("r"))
    total = lines.agg(F.count("*").alias("n")).scalar()
    grid = lines.sparkSession.range(1, width + 1).select(F.col("id").cast("int").alias("position"))
    joined = grid.join(per, "position", "left")
    distinct = key_stats.select("d").scalar()
    at_key = F.col("position") == key
    return joined.select(
        "position",
        (total - F.coalesce("filled", F.lit(0))).alias("null_count"),
        "min_value",
        "max_value",
        (F.coalesce("texts", F.lit(0)) > 0).alias("has_text"),
        F.when(at_key, distinct).alias("distinct_keys"),
        F.when(at_key, total - distinct).alias("duplicate_keys"),
    )


def anchor_scores(cells: DataFrame) -> DataFrame:
    """Header row and label column found by content, each with the runner-up and the margin.

    ``cells`` has (row, col, number, text).  A header row collects day-serial numbers (30000..60000, whole); the label
    column is the one with the most distinct texts that do not read as numbers, below the header.
    """
    serial = F.col("number").between(30000, 60000) & (F.col("number") == F.floor("number"))
    by_row = cells.groupBy(F.col("row").alias("place")).agg(F.count_if(serial).alias("score"))

    def top_two(scores: DataFrame, what: str) -> DataFrame:
        best = scores.orderBy(F.col("score").desc(), "place").limit(2)
        first = F.min(F.struct((-F.col("score")).alias("s"), F.col("place").alias("p")))
        picked = best.agg(first.alias("first"), F.min("score").alias("second"), F.count("*").alias("n"))
        runner = F.when(F.col("n") > 1, F.col("second")).otherwise(F.lit(0))
        return picked.filter("n > 0").select(
            F.lit(what).alias("what"), F.col("first.p").alias("place"), (-F.col("first.s")).alias("score"),
            runner.alias("runner_up"), (-F.col("first.s") - runner).alias("margin"),
        )

    header = top_two(by_row, "header_row")
    below = cells.filter(F.col("row") > header.select("place").scalar())
    label = F.when(F.col("text").isNotNull() & _loose_number(F.col("text")).isNull(), F.col("text"))
    texts = below.select("col", label.alias("label")).distinct()
    by_col = texts.groupBy(F.col("col").alias("place")).agg(F.count("label").alias("score"))
    return header.unionByName(top_two(by_col.select(F.col("place").cast("bigint"), "score"), "label_column"))


# --- ordered series --------------------------------------------------------------------------------------------------

CHUNK_ROWS = 1_000_000


def _neighbours(df: DataFrame, series: str, order: list[str], halo: int, chunk_rows: int) -> tuple[DataFrame, Window]:
    placed = with_positions(df, [F.col(series).asc(), *[F.col(o).asc() for o in order]])
    chunks = with_chunks(placed, chunk_rows, min(halo, chunk_rows))
    return chunks, Window.partitionBy("chunk").orderBy("position")


def gaps(df: DataFrame, series: str, key: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(series, after, before) wherever two consecutive keys of a series are more than 1 apart."""
    chunks, window = _neighbours(df.select(series, key).distinct(), series, [key], 1, chunk_rows)
    previous = F.lag(F.struct(F.col(series).alias("s"), F.col(key).alias("k")), 1).over(window)
    seen = chunks.withColumn("previous", previous).filter("NOT is_halo")
    hit = seen.filter((F.col("previous.s") == F.col(series)) & (F.col(key) - F.col("previous.k") > 1))
    return hit.select(series, F.col("previous.k").alias("after"), F.col(key).alias("before"))


def trend_breaks(
    df: DataFrame, series: str, order: list[str], value: str, recent: int = 5, threshold: float = 10.0, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Steps whose size exceeds ``threshold`` times the median of the ``recent`` steps before them in the same series."""
    chunks, window = _neighbours(df, series, order, recent + 1, chunk_rows)
    back = F.lag(F.struct(F.col(series).alias("s"), F.col(value).alias("v")), 1).over(window)
    steps = chunks.withColumn("__back", back).withColumn(
        "step", F.when(F.col("__back.s") == F.col(series), F.col(value) - F.col("__back.v"))
    )
    # at most `recent` steps per row, those of the same series only
    earlier = F.collect_list(F.struct(F.col(series).alias("s"), F.col("step").alias("x"))).over(window.rowsBetween(-recent, -1))
    own = F.transform(F.filter(earlier, lambda e: (e["s"] == F.col("__series")) & e["x"].isNotNull()), lambda e: e["x"])
    listed = steps.withColumn("__series", F.col(series)).withColumn("__recent", F.array_sort(own)).filter("NOT is_halo AND step IS NOT NULL")
    middle = (F.try_element_at("__recent", F.lit((recent + 1) // 2)) + F.try_element_at("__recent", F.lit(recent // 2 + 1))) / 2
    judged = listed.filter(F.size("__recent") == recent).withColumn("recent_median", middle)
    ratio = F.abs(F.col("step") / F.col("recent_median"))
    return judged.filter((F.col("recent_median") != 0)).filter(ratio > threshold).select(series, *order, value, "step", "recent_median")


