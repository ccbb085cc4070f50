"""Preconditions and exposure findings over a contract table and its computed record.

A check is data: the aggregates it needs, when it counts as breached and when it was exercised at all.  All requested
checks share one pass over the table.  A FLAGGED check never reports FAIL; a check that had nothing to look at reports
NOT_EXERCISED instead of passing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, functions as F

from auditframe.functions.amounts import amount, is_finite
from auditframe.functions.dates import date_class, implausible
from auditframe.functions.rendering import script_number
from auditframe.functions.text import is_exponent_id, trim_cell
from auditframe.operators import lifecycle as lc
from auditframe.operators.ordering import exact_median
from auditframe.operators.profile import id_stats, markers_seen
from auditframe.session import cut_lineage

PARSED = {
    "abschlussdatum": "parsed_start", "einloesungsdatum": "parsed_first_payment",
    "erstmalige_zuteilungsanwartschaft": "parsed_allocation", "Tilgungsbeginn": "parsed_repayment", "Vertragsende": "parsed_end",
}
UNROUNDED = [
    "raw_loan_to_bauspar_ratio", "raw_savings_ratio", "saving_progress", "tariff_value", "contract_end_estimated", *PARSED.values(),
]

# rows counted at the read, while the records were written
ROWS_READ = "__rows_read"

Stats = dict[str, Column]


@dataclass(frozen=True)
class Check:
    id: str
    severity: str
    stats: Callable[[list[str]], Stats]
    breached: Callable[[Callable[[str], Column]], Column]
    exercised: Callable[[Callable[[str], Column]], Column] | None = None
    # single-row tables whose columns join the statistics (distinct identifiers, the exact median, ...)
    lookups: Callable[[DataFrame], dict[str, DataFrame]] = field(default=lambda cells: {})


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _dates(columns: list[str]) -> list[str]:
    return [c for c in lc.DATE_COLUMNS if c in columns]


def _amounts(columns: list[str]) -> list[str]:
    return [c for c in lc.AMOUNT_COLUMNS if c in columns]


def _absent(columns: list[str]) -> list[str]:
    return [c for c in lc.INPUT_COLUMNS if c not in columns]


def collisions(columns: list[str]) -> list[str]:
    """Header names that begin with a declared name without being it."""
    return [f"{h} begins with {n}" for n in lc.INPUT_COLUMNS for h in columns if h != n and h.startswith(n)]


def _unreadable(columns: list[str]) -> Stats:
    kinds = {c: F.col(f"class_{c}") for c in _dates(columns)}
    stats = {f"unreadable_{c}": _count(k.startswith("unreadable")) for c, k in kinds.items()}
    stats |= {f"hyphenated_{c}": _count(k == "unreadable_hyphenated") for c, k in kinds.items()}
    return stats


def _sum(get: Callable[[str], Column], names: list[str]) -> Column:
    total = F.lit(0)
    for n in names:
        total = total + get(n)
    return total


def _plausible(columns: list[str]) -> Stats:
    stats = {}
    for c in _dates(columns):
        stats[f"parsed_{c}"] = F.count(PARSED[c])
        stats[f"outside_{c}"] = _count(implausible(F.col(PARSED[c])))
    return stats


def _tariff(columns: list[str]) -> Stats:
    t = F.col("tariff_value")
    return {"tariff_at_most_0": _count(is_finite(t) & (t <= 0)), "tariff_above_1": _count(is_finite(t) & (t > 1)), "tariff_missing": _count(~is_finite(t))}


def _negative(columns: list[str]) -> Stats:
    return {f"negative_{c}": _count(F.col(f"value_{c}") < 0) for c in _amounts(columns) if c != "tariff_amount"}


def _shape(columns: list[str]) -> Stats:
    outside = F.lit(False)
    for x in ("x_contract", "x_first_payment", "x_allocation", "x_loan_start", "x_now"):
        outside = outside | F.coalesce((F.col(x) < 0) | (F.col(x) > 1), F.lit(False))
    progress = (F.col("saving_progress") < 0) | (F.col("saving_progress") > 1)
    return {
        "phase_out_of_set": _count(~F.col("phase").isin(lc.PHASES)), "goal_source_out_of_set": _count(~F.col("goal_source").isin(lc.GOAL_SOURCES)),
        "position_outside": _count(outside), "progress_outside": _count(progress),
    }


def _commas(columns: list[str]) -> Stats:
    return {f"multi_comma_{c}": _count(trim_cell(F.col(c)).rlike(",[^,]*,")) for c in _amounts(columns)}


def _thousands(columns: list[str]) -> Stats:
    stats = {}
    for c in _amounts(columns):
        t = trim_cell(F.col(c))
        stats[f"thousands_dot_{c}"] = _count(~t.contains(",") & t.rlike(r"\.[^.]{3}\z"))
    return stats


def _euro(columns: list[str]) -> list[str]:
    return [f"thousands_dot_{c}" for c in _amounts(columns) if c != "bausparsumme_teuro"]


def _bands(columns: list[str]) -> Stats:
    r = F.col("raw_loan_to_bauspar_ratio")
    rounded = F.col("loan_to_bauspar_ratio")
    return {
        "ratio_missing": _count(~is_finite(r)), "ratio_at_most_05": _count(is_finite(r) & (r <= 0.5)),
        "ratio_between": _count(is_finite(r) & (r > 0.5) & (r <= 2)), "ratio_above_2": _count(is_finite(r) & (r > 2)),
        "alarms": _count(is_finite(rounded) & (rounded < lc.ALARM_RATIO)), "bridges": _count(F.col("is_bridge_loan")),
    }


def _fallbacks(columns: list[str]) -> Stats:
    both = F.col("allocation_estimated") & F.col("contract_end_estimated")
    return {
        "allocation_estimated": _count(F.col("allocation_estimated")), "contract_end_absent": _count(F.col("contract_end_estimated")),
        "both_absent": _count(both), "done_with_both_absent": _count(both & (F.col("phase") == "done")),
    }


def _discrepancy() -> Column:
    parts = [F.col("saving_reference"), F.col("balance"), F.col("bauspar_loan")]
    known = is_finite(parts[0]) & is_finite(parts[1]) & is_finite(parts[2])
    return F.when(known, F.abs(parts[2] - (parts[0] - parts[1])))


def _loan(columns: list[str]) -> Stats:
    return {"loan_discrepancies": _count(_discrepancy() > 0), "loan_discrepancy_max": F.coalesce(F.max(_discrepancy()), F.lit(0.0))}


def _warn(columns: list[str]) -> Stats:
    shown = is_finite(F.col("savings_ratio")) & F.coalesce(F.col("savings_ratio") >= lc.DEFAULTS.warn_balance_fraction, F.lit(False))
    return {"warn_disagreements": _count(shown != F.col("warn_loan_pointless"))}


def _ids(cells: DataFrame) -> dict[str, DataFrame]:
    return {"ids": id_stats(cells, "BSV").select("rows", "distinct_ids", "duplicated_ids")}


def _median(cells: DataFrame) -> dict[str, DataFrame]:
    r = F.col("raw_loan_to_bauspar_ratio")
    return {"middle": exact_median(cells.select(F.when(is_finite(r), r).alias("ratio")), "ratio")}


def _markers(cells: DataFrame) -> dict[str, DataFrame]:
    columns = _dates(cells.columns)
    seen = markers_seen(cells, columns).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("marker") == "", "(empty)").otherwise(F.col("marker")))), "|").alias("markers"))
    return {"seen": seen}


def _fixed(values: Callable[[list[str]], dict[str, str | int]]) -> Callable[[list[str]], Stats]:
    return lambda columns: {k: F.max(F.lit(v)) if isinstance(v, str) else F.coalesce(F.max(F.lit(v)), F.lit(v)) for k, v in values(columns).items()}


def _names(columns: list[str]) -> dict[str, str | int]:
    surplus = [c for c in columns if c not in lc.INPUT_COLUMNS]
    return {"absent": len(_absent(columns)), "surplus": len(surplus)}


CHECKS: list[Check] = [
    Check("P-01", "FAIL", _fixed(_names), lambda g: g("absent") > 0),
    Check("P-02", "FAIL", _fixed(lambda cols: {"id_present": int("BSV" in cols)}), lambda g: g("id_present") == 0),
    Check("P-03", "FAIL", _unreadable, lambda g: g("+unreadable_") > 0),
    Check("P-04", "FLAGGED", _plausible, lambda g: g("+outside_") > 0, lambda g: g("+parsed_") > 0),
    Check("P-05", "FAIL", _tariff, lambda g: (g("tariff_at_most_0") > 0) | (g("tariff_above_1") > 0)),
    Check("P-06", "FLAGGED", _negative, lambda g: g("+negative_") > 0),
    Check("P-07", "FLAGGED", lambda cols: {}, lambda g: g("duplicated_ids") > 0, lookups=_ids),
    Check("P-08", "FAIL", _shape, lambda g: g("phase_out_of_set") + g("goal_source_out_of_set") + g("position_outside") + g("progress_outside") > 0),
    Check("P-09", "FAIL", lambda cols: {"rows_read": F.max(ROWS_READ), "records_published": F.count("*")}, lambda g: g("rows_read") != g("records_published"), lambda g: g("rows_read").isNotNull()),
    Check("P-10", "FLAGGED", _fixed(lambda cols: {"prefix_collisions": len(collisions(cols))}), lambda g: g("prefix_collisions") > 0),
    Check("P-11", "FLAGGED", _commas, lambda g: g("+multi_comma_") > 0),
    Check("P-12", "FAIL", lambda cols: {"valuation_day": F.max(F.unix_date("valuation_date"))}, lambda g: g("valuation_day").isNull()),
    Check("P-13", "FLAGGED", lambda cols: {}, lambda g: (g("median") < 0.01) | (g("median") > 100), lambda g: g("values") > 0, lookups=_median),
    Check("FND-01", "FAIL", _thousands, lambda g: g("+thousands_dot_-bausparsumme_teuro") > 0),
    Check("FND-02", "FAIL", _tariff, lambda g: g("tariff_above_1") > 0),
    Check("FND-03", "FLAGGED", lambda cols: {"exponent_ids": _count(is_exponent_id(F.col("BSV")))}, lambda g: g("exponent_ids") > 0),
    Check("FND-04", "FLAGGED", lambda cols: {}, lambda g: g("duplicated_ids") > 0, lookups=_ids),
    Check("FND-05", "FLAGGED", _bands, lambda g: g("alarms") != g("ratio_at_most_05")),
    Check("FND-06", "FLAGGED", _unreadable, lambda g: g("+unreadable_") > 0),
    Check("FND-08", "FLAGGED", _fallbacks, lambda g: g("done_with_both_absent") > 0),
    Check("FND-09", "FLAGGED", _loan, lambda g: g("loan_discrepancy_max") > 1),
    Check("FND-10", "FLAGGED", lambda cols: {"phase_out_of_set": _shape(cols)["phase_out_of_set"], "savings_ratio_missing": _count(~is_finite(F.col("raw_savings_ratio")))},
          lambda g: g("phase_out_of_set") > 0),
    Check("FND-11", "FLAGGED", lambda cols: {}, lambda g: F.lit(False), lookups=_markers),
    Check("FND-12", "FLAGGED", _fixed(lambda cols: {"prefix_collisions": len(collisions(cols)), "absent": len(_absent(cols))}), lambda g: g("prefix_collisions") > 0),
    Check("FND-13", "FLAGGED", _warn, lambda g: g("warn_disagreements") > 0),
]
IDS = [c.id for c in CHECKS]


def checked_cells(df: DataFrame, valuation_date: str, coerced: list[str] | None = None) -> DataFrame:
    """Input cells, record and unrounded values side by side: what the checks read."""
    present = [c for c in df.columns if c in lc.INPUT_COLUMNS and c != "contract_type"]
    cells = lc.contract_cells(df, valuation_date, coerced)
    cells = cells.withColumns(
        {f"class_{c}": date_class(F.col(c)) for c in _dates(present)} | {f"value_{c}": amount(F.col(c)) for c in _amounts(present)}
        | {"valuation_date": F.lit(valuation_date).try_cast("date")}
    )
    derived = [f"class_{c}" for c in _dates(present)] + [f"value_{c}" for c in _amounts(present)]
    return lc.publish(cells, keep=[*present, *UNROUNDED, *derived, "valuation_date"])


def stored_cells(df: DataFrame, valuation_date: str, coerced: list[str] | None = None) -> DataFrame:
    """``checked_cells`` written once; the rows that this job read are observed on the way and kept beside the records."""
    seen = Observation()
    cells = cut_lineage(checked_cells(df.observe(seen, F.count(F.lit(1)).alias("rows")), valuation_date, coerced))
    return cells.withColumn(ROWS_READ, F.lit(seen.get["rows"]).cast("bigint"))


def cells_for(df: DataFrame, valuation_date: str, coerced: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """Cells for the chosen checks.

    They are stored when all checks are chosen or the rows read count; a few checks read them in passing, so that no more is
    computed than their columns.
    """
    stored = only is None or "P-09" in only
    return (stored_cells if stored else checked_cells)(df, valuation_date, coerced)


def evaluate(cells: DataFrame, header: list[str], only: list[str] | None = None) -> DataFrame:
    """(id, severity, status, evidence map) for the chosen checks; ``header`` holds the received column names.

    Several passes read the cells (identifiers, the median, the markers, everything else), so they are best stored first.  Cells
    that were not stored with their number of rows read leave P-09 unexercised.
    """
    chosen = [c for c in CHECKS if only is None or c.id in only]
    columns = [c for c in header if c != "row_index"]
    if ROWS_READ not in cells.columns:
        cells = cells.withColumn(ROWS_READ, F.lit(None).cast("bigint"))
    aggs: Stats = {}
    tables: dict[str, DataFrame] = {}
    wanted: dict[str, list[str]] = {}
    for check in chosen:
        stats = check.stats(columns)
        aggs |= stats
        wanted[check.id] = list(stats)
        for name, table in check.lookups(cells).items() if check.lookups else ():
            tables.setdefault(name, table)
            wanted[check.id] += table.columns
    row = cells.agg(*[a.alias(n) for n, a in aggs.items()]) if aggs else cells.sparkSession.range(1)
    for name, table in tables.items():
        row = row.withColumn(f"__{name}", table.select(F.struct(*table.columns)).scalar())
        row = row.withColumns({c: F.col(f"__{name}.{c}") for c in table.columns})

    def getter(check: Check) -> Callable[[str], Column]:
        def get(name: str) -> Column:
            if not name.startswith("+"):
                return F.col(name)
            prefix, _, without = name[1:].partition("-")
            return _sum(F.col, [n for n in wanted[check.id] if n.startswith(prefix) and n != prefix + without])

        return get

    out = []
    types = dict(row.dtypes)
    for check in chosen:
        get = getter(check)
        breached = F.coalesce(check.breached(get), F.lit(False))
        status = F.when(breached, check.severity).otherwise("PASS")
        if check.exercised is not None:
            status = F.when(~F.coalesce(check.exercised(get), F.lit(False)), "NOT_EXERCISED").otherwise(status)
        evidence = []
        for name in wanted[check.id]:
            text = script_number(F.col(name)) if types[name] == "double" else F.col(name).cast("string")
            evidence += [F.lit(name), F.coalesce(text, F.lit("none"))]
        out.append(F.struct(F.lit(check.id).alias("id"), F.lit(check.severity).alias("severity"), status.alias("status"), F.create_map(*evidence).alias("evidence")))
    return row.select(F.explode(F.array(*out)).alias("x")).select("x.*")


def preconditions(df: DataFrame, valuation_date: str, coerced: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    return evaluate(stored_cells(df, valuation_date, coerced), df.columns, only)


def evidence_text(results: DataFrame) -> DataFrame:
    """Evidence map flattened to ``name=value`` text in name order."""
    pairs = F.transform(F.array_sort(F.map_entries("evidence")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return results.withColumn("evidence", F.array_join(pairs, "; "))


# --- further checks --------------------------------------------------------------------------------------------------


def required_columns(catalogue: DataFrame, required: list[str]) -> DataFrame:
    """Per file: required names it lacks and how many further names it has; ``catalogue`` has (file, column)."""
    named = F.array(*[F.lit(r) for r in required])
    known = F.when(F.array_contains(named, F.col("column")), F.col("column"))
    got = catalogue.groupBy("file").agg(F.collect_set(known).alias("got"), F.count_if(known.isNull()).alias("surplus"))
    missing = F.array_sort(F.array_except(named, F.col("got")))
    return got.select("file", F.array_join(missing, ",").alias("absent"), "surplus", F.when(F.size(missing) > 0, "FAIL").otherwise("PASS").alias("status"))


def prefix_collisions(catalogue: DataFrame, required: list[str]) -> DataFrame:
    """(file, column, declared) where a header name strictly extends a declared name; the declared list is fixed and small."""
    declared = F.explode(F.array(*[F.lit(r) for r in required]))
    pairs = catalogue.withColumn("declared", declared)
    return pairs.filter(F.col("column").startswith(F.col("declared")) & (F.col("column") != F.col("declared"))).select("file", "column", "declared").distinct()


def thousands_dot_overlap(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: thousands-dot suspects, and whether their range lies inside that of the unambiguous spellings."""
    aggs, rows = [], []
    for c in columns:
        t = trim_cell(F.col(c))
        v = amount(F.col(c))
        suspect = ~t.contains(",") & t.rlike(r"\.[^.]{3}\z")
        aggs += [
            _count(suspect).alias(f"n_{c}"), F.min(F.when(suspect, v)).alias(f"slo_{c}"), F.max(F.when(suspect, v)).alias(f"shi_{c}"),
            F.min(F.when(~suspect, v)).alias(f"lo_{c}"), F.max(F.when(~suspect, v)).alias(f"hi_{c}"),
        ]
        overlap = (F.col(f"shi_{c}") >= F.col(f"lo_{c}")) & (F.col(f"slo_{c}") <= F.col(f"hi_{c}"))
        rows.append(F.struct(F.lit(c).alias("field"), F.col(f"n_{c}").alias("suspects"), F.col(f"slo_{c}").alias("suspect_min"), F.col(f"shi_{c}").alias("suspect_max"),
                             F.col(f"lo_{c}").alias("clear_min"), F.col(f"hi_{c}").alias("clear_max"), overlap.alias("ranges_overlap")))
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def declared_vs_observed(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Claims (id, klass, reading) against observations (id, reading): agreed, and whether a disagreement must halt."""
    a = declared.select("id", "klass", F.col("reading").alias("declared"))
    b = observed.select("id", F.col("reading").alias("observed"))
    both = a.join(b, "id", "left")
    agreed = F.col("declared").eqNullSafe(F.col("observed"))
    return both.select("id", "klass", "declared", "observed", agreed.alias("agreed"), ((F.col("klass") == "computation_critical") & ~agreed).alias("halts"))


def control_pair(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Each check on known-good and known-bad data: must pass on the first; ``separates`` when it fires on the second."""
    a = good.select("id", "severity", F.col("status").alias("good_status"))
    b = bad.select("id", F.col("status").alias("bad_status"))
    both = a.join(b, "id")
    quiet = F.col("good_status").isin("PASS", "NOT_EXERCISED")
    fired = F.col("bad_status").isin("FAIL", "FLAGGED")
    return both.select(
        "id", "severity", "good_status", "bad_status", (~quiet).alias("cried_wolf"), ((F.col("good_status") == "PASS") & fired).alias("separates"),
        (~((F.col("severity") == "FLAGGED") & (F.col("bad_status") == "FAIL"))).alias("severity_kept"),
    )
