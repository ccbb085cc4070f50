"""Contract lifecycle: 33 published values per row of the contract table, and the 25-column export.

Everything is a projection.  Decisions use unrounded values (kept in ``raw_*`` and ``parsed_*`` columns); rounding is
the last step.  Missing values are NULL throughout.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.functions.amounts import amount, is_finite
from auditframe.functions.dates import date_class, is_marker, mixed_date, separated_date, standard_form, year_label
from auditframe.functions.rendering import script_key, script_numbers, script_string
from auditframe.functions.rounding import round_columns
from auditframe.functions.text import trim_cell

# Input columns, published columns with their decimal places, export columns.
INPUT_COLUMNS = [
    "BSV", "DaBetrag", "Tilgungsbeginn", "Vertragsende", "abschlussdatum", "bausparsumme_teuro", "contract_type",
    "einloesungsdatum", "erstmalige_zuteilungsanwartschaft", "guthaben", "tariff_amount",
]
DATE_COLUMNS = ["abschlussdatum", "einloesungsdatum", "erstmalige_zuteilungsanwartschaft", "Tilgungsbeginn", "Vertragsende"]
AMOUNT_COLUMNS = ["DaBetrag", "bausparsumme_teuro", "guthaben", "tariff_amount"]
COERCED_COLUMNS = ["abschlussdatum", "einloesungsdatum"]
RECORD_COLUMNS = [
    "id", "phase", "savings_ratio", "saving_goal", "contract_type", "goal_fraction", "goal_source", "saving_reference",
    "balance", "bauspar_sum", "loan_notional", "bauspar_loan", "loan_to_bauspar_ratio", "is_bridge_loan",
    "allocation_estimated", "allocation_in_past", "repayment_active", "saving_after_allocation", "warn_loan_pointless",
    "contract_start_date", "first_payment_date", "allocation_date", "loan_start_date", "contract_end_date",
    "year_contract", "year_first_payment", "year_allocation", "year_loan_start", "x_contract", "x_first_payment",
    "x_allocation", "x_loan_start", "x_now",
]
PLACES = {
    "savings_ratio": 3, "saving_goal": 0, "goal_fraction": 4, "saving_reference": 0, "balance": 0, "bauspar_sum": 0,
    "loan_notional": 0, "bauspar_loan": 0, "loan_to_bauspar_ratio": 3, "x_contract": 4, "x_first_payment": 4,
    "x_allocation": 4, "x_loan_start": 4, "x_now": 4,
}
PHASES = ["done", "loan", "oversave", "save"]
GOAL_SOURCES = ["tariff", "fallback_no_tariff"]
UNIT_FACTOR = 1000.0
ALARM_RATIO = 0.5
AXIS_CONTRACT, AXIS_FIRST_PAYMENT, AXIS_ALLOCATION = 0.02, 0.06, 0.4
OVERSAVE_BUMP, OVERSAVE_CAP = 0.06, 0.46
AFTER_ALLOCATION_WIDTH, LOAN_WIDTH, SAVING_WIDTH = 0.18, 0.6, 0.34


@dataclass(frozen=True)
class LifecycleConfig:
    """Fixed default values of the calculation."""

    prefer_tariff_share: bool = True
    saving_goal_fraction_default: float = 0.4
    bridge_ratio_cutoff: float = 2.0
    warn_balance_fraction: float = 0.9
    allocation_fallback_days: int = 3652
    contract_end_fallback_days: int = 4018
    fallback_origin_days: int = 2557


DEFAULTS = LifecycleConfig()


def clamp(value: Column, low: float, high: float) -> Column:
    """Value held inside the interval; ``greatest``/``least`` skip nulls, so a missing value is kept apart."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


# --- column-wide coercion ------------------------------------------------------------------------------------------


def first_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: per column the first non-missing cell in received order, as ``<column>_first`` (value, row_index)."""
    aggs = []
    for c in columns:
        held = F.when(~is_marker(trim_cell(F.col(c))), F.struct(F.col("row_index"), F.col(c).alias("value")))
        aggs.append(F.min(held).alias(f"{c}_first"))
    return df.agg(*aggs)


def coercion_formats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per coerced column: first non-missing value, the form it fixes for the whole column, and the outcome.

    ``coerced`` - the form applies to every value; ``all_missing`` - no form and no hyphen, the column goes missing;
    ``abort`` - hyphenated but unreadable; ``empty`` - nothing but missing markers.
    """
    firsts = first_values(df, columns)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}_first").alias("first")) for c in columns])
    long = firsts.select(F.explode(rows).alias("x")).select(
        "x.column", F.col("x.first.row_index").alias("first_row"), F.col("x.first.value").alias("first_value")
    )
    form = standard_form(F.col("first_value"))
    outcome = (
        F.when(F.col("first_value").isNull(), "empty")
        .when(form.isNotNull(), "coerced")
        .when(trim_cell(F.col("first_value")).contains("-"), "abort")
        .otherwise("all_missing")
    )
    return long.select("column", "first_row", "first_value", form.alias("form"), outcome.alias("outcome"))


def coerce_date_column(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: the column read under the form of its first non-missing value; other values go missing."""
    firsts = first_values(df, [column]).select(standard_form(F.col(f"{column}_first.value")).alias("form"))
    t = trim_cell(F.col(column))
    form = firsts.scalar()
    value = F.when(form == "-", separated_date(t, "-")).when(form == "/", separated_date(t, "/"))
    return df.withColumn(name, F.when(~is_marker(t), value))


def abort_record(df: DataFrame, coerced: list[str] | None = None) -> DataFrame:
    """The first cell that stops a run, if any: code, row, column, raw value, rows completed before it.

    A coerced column stops the run before its first row when its first non-missing value is hyphenated and unreadable;
    any other date column stops it at every hyphenated unreadable value.
    """
    coerced = COERCED_COLUMNS if coerced is None else coerced
    up_front = (
        coercion_formats(df, coerced)
        .filter("outcome = 'abort'")
        .select(F.lit(0).alias("phase"), F.col("first_row").alias("row_index"), F.array_position(F.array(*[F.lit(c) for c in coerced]), F.col("column")).cast("int").alias("ordinal"), "column", F.col("first_value").alias("raw_value"))
    )
    plain = [c for c in DATE_COLUMNS if c not in coerced]
    bad = F.array_compact(
        F.array(
            *[
                F.when(date_class(F.col(c)) == "unreadable_hyphenated", F.struct(F.lit(1).alias("phase"), F.col("row_index"), F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(c).alias("raw_value")))
                for i, c in enumerate(plain)
            ]
        )
    )
    in_rows = df.select(F.explode(bad).alias("x")).select("x.*")
    first = up_front.unionByName(in_rows).agg(F.min(F.struct("phase", "row_index", "ordinal", "column", "raw_value")).alias("x")).filter("x IS NOT NULL")
    completed = F.when(F.col("x.phase") == 0, F.lit(0)).otherwise(F.col("x.row_index") - 1)
    return first.select(
        F.lit("DATE_PARSE_ABORT").alias("abort_code"), F.col("x.row_index").cast("bigint").alias("row_index"), "x.column", "x.raw_value", completed.cast("bigint").alias("rows_completed")
    )


# --- the calculation -----------------------------------------------------------------------------------------------


def parsed_cells(df: DataFrame, coerced: list[str]) -> DataFrame:
    """Dates and amounts of every row; columns absent from the table read as missing."""
    names = {
        "abschlussdatum": "parsed_start",
        "einloesungsdatum": "parsed_first_payment",
        "erstmalige_zuteilungsanwartschaft": "parsed_allocation",
        "Tilgungsbeginn": "parsed_repayment",
        "Vertragsende": "parsed_end",
    }
    plain = {}
    for column, name in names.items():
        if column not in df.columns:
            plain[name] = F.lit(None).cast("date")
        elif column in coerced:
            df = coerce_date_column(df, column, name)
        else:
            plain[name] = mixed_date(F.col(column))

    def read(column: str) -> Column:
        return amount(F.col(column)) if column in df.columns else F.lit(None).cast("double")

    plain["raw_loan_notional"] = read("DaBetrag")
    plain["raw_bauspar_sum"] = read("bausparsumme_teuro") * F.lit(UNIT_FACTOR)
    plain["raw_balance"] = read("guthaben")
    plain["tariff_value"] = read("tariff_amount")
    return df.withColumns(plain)


def _number(col: Column) -> Column:
    """An undefined difference of infinities is a missing value."""
    return F.when(~F.isnan(col), col)


def contract_cells(df: DataFrame, valuation_date: str, coerced: list[str] | None = None, cfg: LifecycleConfig = DEFAULTS) -> DataFrame:
    """All input cells, parsed values, unrounded results and decisions, one row per contract."""
    today = F.lit(valuation_date).cast("date")
    c = F.col
    df = parsed_cells(df, COERCED_COLUMNS if coerced is None else coerced)
    has_type = "contract_type" in df.columns
    df = df.withColumns(
        {
            "contract_start_date": F.coalesce("parsed_start", "parsed_first_payment", F.date_sub(today, cfg.fallback_origin_days)),
            "allocation_estimated": c("parsed_allocation").isNull(),
            "contract_end_estimated": c("parsed_end").isNull(),
            "tariff_usable": F.lit(cfg.prefer_tariff_share) & is_finite(c("tariff_value")) & (c("tariff_value") > 0),
            "sum_usable": is_finite(c("raw_bauspar_sum")) & (c("raw_bauspar_sum") > 0),
            "contract_type": c("contract_type") if has_type else F.lit(None).cast("string"),
        }
    )
    df = df.withColumns(
        {
            "allocation_date": F.coalesce(
                "parsed_allocation", F.date_add(F.coalesce("parsed_first_payment", "contract_start_date"), cfg.allocation_fallback_days)
            ),
            "raw_goal_fraction": F.when(c("tariff_usable"), c("tariff_value")).otherwise(F.lit(cfg.saving_goal_fraction_default)),
            "goal_source": F.when(c("tariff_usable"), "tariff").otherwise("fallback_no_tariff"),
            "raw_loan_to_bauspar_ratio": _number(F.when(c("sum_usable"), c("raw_loan_notional") / c("raw_bauspar_sum"))),
        }
    )
    df = df.withColumns(
        {
            "contract_end_date": F.coalesce("parsed_end", F.date_add(c("allocation_date"), cfg.contract_end_fallback_days)),
            "is_bridge_loan": is_finite(c("raw_loan_to_bauspar_ratio")) & F.coalesce(c("raw_loan_to_bauspar_ratio") > cfg.bridge_ratio_cutoff, F.lit(False)),
        }
    )
    df = df.withColumn("raw_saving_reference", F.when(c("is_bridge_loan"), c("raw_bauspar_sum")).otherwise(c("raw_loan_notional")))
    usable = is_finite(c("raw_saving_reference")) & (c("raw_saving_reference") > 0)
    df = df.withColumns(
        {
            "raw_saving_goal": c("raw_goal_fraction") * c("raw_saving_reference"),
            "raw_savings_ratio": F.when(usable, c("raw_balance") / c("raw_saving_reference")),
            "raw_bauspar_loan": _number(c("raw_saving_reference") - c("raw_balance")),
            "allocation_in_past": today > c("allocation_date"),
            "repayment_active": F.coalesce(today >= c("parsed_repayment"), F.lit(False)),
            "contract_ended": today >= c("contract_end_date"),
        }
    )
    ratio_known = is_finite(c("raw_savings_ratio"))
    df = df.withColumns(
        {
            "warn_loan_pointless": ratio_known & F.coalesce(c("raw_savings_ratio") >= cfg.warn_balance_fraction, F.lit(False)),
            "over_goal": ratio_known & F.coalesce(c("raw_savings_ratio") >= c("raw_goal_fraction"), F.lit(False)),
            "saving_progress": F.when(ratio_known, clamp(c("raw_savings_ratio") / c("raw_goal_fraction"), 0.0, 1.0)).otherwise(F.lit(0.0)),
            "saving_after_allocation": c("allocation_in_past") & ~c("repayment_active") & ~c("contract_ended"),
        }
    )
    df = df.withColumn(
        "phase",
        F.when(c("contract_ended"), "done").when(c("repayment_active"), "loan").when(c("over_goal"), "oversave").otherwise("save"),
    )
    in_loan = c("phase").isin("loan", "done")
    loan_from = F.coalesce("parsed_repayment", "allocation_date")

    def share(begin: Column, elapsed_from: Column, end: Column) -> Column:
        span = F.datediff(end, begin)
        part = clamp(F.datediff(today, elapsed_from) / span, 0.0, 1.0)
        return F.when(F.coalesce(span > 0, F.lit(False)), part).otherwise(F.lit(0.0))

    saving_x = F.lit(AXIS_FIRST_PAYMENT) + c("saving_progress") * SAVING_WIDTH
    x_now = (
        F.when(in_loan, F.lit(AXIS_ALLOCATION) + share(loan_from, loan_from, c("contract_end_date")) * LOAN_WIDTH)
        .when(
            c("saving_after_allocation"),
            F.lit(AXIS_ALLOCATION) + share(c("parsed_first_payment"), c("allocation_date"), c("allocation_date")) * AFTER_ALLOCATION_WIDTH,
        )
        .when(c("phase") == "oversave", F.least(saving_x + OVERSAVE_BUMP, F.lit(OVERSAVE_CAP)))
        .otherwise(saving_x)
    )
    return df.withColumns(
        {
            "raw_x_now": x_now,
            "raw_x_loan_start": F.when(in_loan, F.lit(AXIS_ALLOCATION)),
            "year_contract": year_label(c("contract_start_date")),
            "year_first_payment": year_label(c("parsed_first_payment")),
            "year_allocation": year_label(c("allocation_date"), c("allocation_estimated")),
            "year_loan_start": year_label(c("parsed_repayment")),
        }
    )


def publish(cells: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``row_index`` and the 33 published columns, rounded; ``keep`` adds unpublished columns for later checks."""
    c = F.col
    fixed = {"x_contract": AXIS_CONTRACT, "x_first_payment": AXIS_FIRST_PAYMENT, "x_allocation": AXIS_ALLOCATION}
    renamed = {"id": c("BSV"), "first_payment_date": c("parsed_first_payment"), "loan_start_date": c("parsed_repayment")}
    columns = []
    for name in RECORD_COLUMNS:
        if name in fixed:
            columns.append(F.lit(fixed[name]).alias(name))
        elif name in PLACES:
            columns.append(c(f"raw_{name}").alias(name))
        else:
            columns.append(renamed.get(name, c(name)).alias(name))
    frame = cells.select("row_index", *columns, *(keep or []))
    # the fixed axis positions have no more than four decimals already
    return round_columns(frame, {k: v for k, v in PLACES.items() if k not in fixed})


def contract_lifecycle(df: DataFrame, valuation_date: str, coerced: list[str] | None = None, cfg: LifecycleConfig = DEFAULTS) -> DataFrame:
    return publish(contract_cells(df, valuation_date, coerced, cfg))


# --- export --------------------------------------------------------------------------------------------------------

EXPORT_KINDS = {
    "id": "str", "phase": "str", "warn": "num", "sr": "num", "xc": "num", "xf": "num", "xa": "num", "xl": "num",
    "xn": "num", "lab_contract": "str", "lab_first": "str", "lab_alloc": "str", "lab_loan": "str", "guthaben": "num",
    "bausparsumme": "num", "save_target": "num", "loan_amount": "num", "dabetrag": "num", "alloc_est": "num",
    "da_bsum_ratio": "num", "bridge": "num", "goal_frac": "num", "contract_type": "str", "goal_source": "str",
    "special": "num",
}
# Published name of each renamed export column.
EXPORT_FROM = {
    "sr": "savings_ratio", "xc": "x_contract", "xf": "x_first_payment", "xa": "x_allocation", "xl": "x_loan_start",
    "xn": "x_now", "lab_contract": "year_contract", "lab_first": "year_first_payment", "lab_alloc": "year_allocation",
    "lab_loan": "year_loan_start", "guthaben": "balance", "bausparsumme": "bauspar_sum", "save_target": "saving_goal",
    "loan_amount": "bauspar_loan", "dabetrag": "loan_notional", "da_bsum_ratio": "loan_to_bauspar_ratio",
    "goal_frac": "goal_fraction", "warn": "warn_loan_pointless", "alloc_est": "allocation_estimated",
    "bridge": "is_bridge_loan",
}


def export_rows(record: DataFrame) -> DataFrame:
    """``row_index`` and the 25 export columns; ``special`` is decided on the rounded ratio."""
    alarm = is_finite(F.col("loan_to_bauspar_ratio")) & (F.col("loan_to_bauspar_ratio") < ALARM_RATIO)
    columns = []
    for name in EXPORT_KINDS:
        if name == "special":
            value = alarm.cast("int")
        elif name in ("warn", "alloc_est", "bridge"):
            value = F.col(EXPORT_FROM[name]).cast("int")
        else:
            value = F.col(EXPORT_FROM.get(name, name))
        columns.append(value.alias(name))
    return record.select("row_index", *columns)


def render_entries(export: DataFrame) -> DataFrame:
    """(row_index, entry): ``"key":{"name":value,...}`` per exported row."""
    flags = ("warn", "alloc_est", "bridge", "special")
    numbers = [name for name, kind in EXPORT_KINDS.items() if kind == "num" and name not in flags]
    fields = []
    for name, kind in EXPORT_KINDS.items():
        value = script_string(F.col(name)) if kind == "str" else F.col(name).cast("string")
        fields.append(F.concat(F.lit(f'"{name}":'), F.coalesce(value, F.lit("null"))))
    entry = F.concat(F.lit('"'), script_key(F.col("id")), F.lit('":{'), F.concat_ws(",", *fields), F.lit("}"))
    return script_numbers(export, numbers).select("row_index", entry.alias("entry"))


# Fixed texts of the rendered document.
DOCUMENT_FIRST = "// customers_data.js  --  generated by customer_engine.R"
DOCUMENT_OPEN = "window.CUSTOMERS = {"
DOCUMENT_CLOSE = "};"


def render_document(export: DataFrame, valuation_date: str) -> DataFrame:
    """(line_no, line_text): two comment lines, the opening line, one line per entry, the closing line.

    ``row_index`` is dense from 1, so a row's line number needs no sort; only the last entry has no comma.
    """
    total = export.agg(F.count("*").alias("n"))
    n = total.scalar()
    body = render_entries(export).select(
        (F.col("row_index") + 3).cast("bigint").alias("line_no"),
        F.concat("entry", F.when(F.col("row_index") == n, "").otherwise(",")).alias("line_text"),
    )
    comment = F.concat(F.lit("// "), F.col("n").cast("string"), F.lit(f" contracts, valuation date {valuation_date}"))
    frame_lines = total.select(
        F.explode(
            F.array(
                F.struct(F.lit(1).cast("bigint").alias("line_no"), F.lit(DOCUMENT_FIRST).alias("line_text")),
                F.struct(F.lit(2).cast("bigint").alias("line_no"), comment.alias("line_text")),
                F.struct(F.lit(3).cast("bigint").alias("line_no"), F.lit(DOCUMENT_OPEN).alias("line_text")),
                F.struct((F.col("n") + 4).alias("line_no"), F.lit(DOCUMENT_CLOSE).alias("line_text")),
            )
        ).alias("x")
    ).select("x.*")
    return body.unionByName(frame_lines)


def phase_summary(record: DataFrame) -> DataFrame:
    return record.groupBy("phase", F.coalesce("contract_type", F.lit("<absent>")).alias("contract_type")).agg(F.count("*").alias("contracts"))
