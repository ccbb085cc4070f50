"""Queries and oracles of the contract table: cells, lifecycle, export, preconditions, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.functions import amounts, canonical, dates, rendering, text
from auditframe.functions.rounding import round_columns
from auditframe.operators import checks, lifecycle as lc, profile as pr
from auditframe.plans.registry import query
from auditframe.plans.views import frame, remembered, sql_with, view

DAY = "2026-03-31"
TABLE_COLUMNS = [
    "BSV", "abschlussdatum", "einloesungsdatum", "erstmalige_zuteilungsanwartschaft", "Tilgungsbeginn", "Vertragsende", "DaBetrag",
    "bausparsumme_teuro", "guthaben", "tariff_amount", "contract_type",
]



def _nearest(x: str, places: int) -> str:
    """Nearest of the two neighbouring decimals by distance, even numerator on a tie."""
    p = f"{10 ** places}.0::DOUBLE"
    k = f"floor(abs({x}) * {p})"
    lo, hi = f"({k} / {p})", f"(({k} + 1) / {p})"
    a, b = f"abs(abs({x}) - {lo})", f"abs({hi} - abs({x}))"
    return f"(CASE WHEN {x} < 0 THEN -1 ELSE 1 END * CASE WHEN {a} < {b} OR {a} = {b} AND {k} % 2 = 0 THEN {lo} ELSE {hi} END)"


# --- oracle-only views ---------------------------------------------------------------------------------------------

_MARK = "('', '0', '00', '0000', '00000000', 'NA', '<NA>')"
_AMOUNT_MARK = "('', 'NA', '<NA>', 'n/a', '-')"


def _day(x: str, pattern: str) -> str:
    part = lambda i: f"regexp_extract({x}, '{pattern}', {i})"
    return f"TRY_CAST(CASE WHEN regexp_matches({x}, '{pattern}') THEN lpad({part(1)}, 4, '0') || '-' || lpad({part(2)}, 2, '0') || '-' || lpad({part(3)}, 2, '0') END AS DATE)"


def _hyphen(x: str) -> str:
    return _day(x, r"^(\d{1,4})-(\d{1,2})-(\d{1,2})")


def _slash(x: str) -> str:
    return _day(x, r"^(\d{1,4})/(\d{1,2})/(\d{1,2})")


def _digits(x: str) -> str:
    return _day(x, r"^(\d{4})(\d{2})(\d{1,2})")


def _mixed(c: str) -> str:
    x = f"trim({c})"
    return f"CASE WHEN {x} IN {_MARK} THEN NULL WHEN contains({x}, '-') THEN coalesce({_hyphen(x)}, {_slash(x)}) ELSE {_digits(x)} END"


def _class(c: str) -> str:
    x = f"trim({c})"
    return (
        f"CASE WHEN {x} IN {_MARK} THEN 'marker' WHEN contains({x}, '-') THEN CASE WHEN coalesce({_hyphen(x)}, {_slash(x)}) IS NOT NULL THEN 'hyphen_ok' ELSE 'unreadable_hyphenated' END "
        f"WHEN {_digits(x)} IS NOT NULL THEN 'digits_ok' ELSE 'unreadable' END"
    )


def _body(c: str) -> str:
    x = f"trim({c})"
    return f"CASE WHEN contains({x}, ',') THEN replace(replace({x}, '.', ''), ',', '.') ELSE {x} END"


def _amount(c: str) -> str:
    body = f"({_body(c)})"
    return rf"CASE WHEN trim({c}) NOT IN {_AMOUNT_MARK} AND regexp_matches({body}, '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN TRY_CAST({body} AS DOUBLE) END"


def _coerced(c: str) -> str:
    first = f"(SELECT trim(arg_min({c}, row_index)) FROM v_contracts WHERE trim({c}) NOT IN {_MARK})"
    return f"CASE WHEN trim({c}) IN {_MARK} THEN NULL WHEN {_hyphen(first)} IS NOT NULL THEN {_hyphen(f'trim({c})')} WHEN {_slash(first)} IS NOT NULL THEN {_slash(f'trim({c})')} END"


view("o_parsed", f"""
SELECT *, {_coerced('abschlussdatum')} AS p_start, {_coerced('einloesungsdatum')} AS p_first, {_mixed('erstmalige_zuteilungsanwartschaft')} AS p_alloc,
  {_mixed('Tilgungsbeginn')} AS p_repay, {_mixed('Vertragsende')} AS p_end, {_amount('DaBetrag')} AS loan, {_amount('bausparsumme_teuro')} * 1000.0 AS bsum,
  {_amount('guthaben')} AS bal, {_amount('tariff_amount')} AS tariff, DATE '{DAY}' AS today FROM v_contracts
""", "v_contracts")
view("o_one", """
SELECT *, coalesce(p_start, p_first, today - 2557) AS c_start, p_alloc IS NULL AS est, CASE WHEN tariff > 0 THEN tariff ELSE 0.4::DOUBLE END AS frac,
  CASE WHEN tariff > 0 THEN 'tariff' ELSE 'fallback_no_tariff' END AS gsrc, CASE WHEN bsum > 0 THEN loan / bsum END AS ratio FROM o_parsed
""", "o_parsed")
view("o_two", """
SELECT *, coalesce(p_alloc, coalesce(p_first, c_start) + 3652) AS alloc, coalesce(ratio > 2, false) AS bridge, CASE WHEN coalesce(ratio > 2, false) THEN bsum ELSE loan END AS ref FROM o_one
""", "o_one")
view("o_three", """
SELECT *, coalesce(p_end, alloc + 4018) AS c_end, CASE WHEN ref > 0 THEN bal / ref END AS sr, frac * ref AS goal, ref - bal AS bloan, today > alloc AS past,
  coalesce(today >= p_repay, false) AS active FROM o_two
""", "o_two")
view("o_four", """
SELECT *, today >= c_end AS ended, coalesce(sr >= 0.9, false) AS warn, coalesce(sr >= frac, false) AS over_goal,
  CASE WHEN sr IS NULL THEN 0.0::DOUBLE ELSE greatest(least(sr / frac, 1.0::DOUBLE), 0.0::DOUBLE) END AS progress FROM o_three
""", "o_three")
view("o_five", """
SELECT *, CASE WHEN ended THEN 'done' WHEN active THEN 'loan' WHEN over_goal THEN 'oversave' ELSE 'save' END AS phase, past AND NOT active AND NOT ended AS saa,
  coalesce(p_repay, alloc) AS lfrom FROM o_four
""", "o_four")
view("o_six", """
SELECT *, CASE WHEN phase IN ('loan', 'done') THEN 0.4::DOUBLE + CASE WHEN c_end - lfrom > 0 THEN greatest(least((today - lfrom)::DOUBLE / (c_end - lfrom)::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END * 0.6::DOUBLE
  WHEN saa THEN 0.4::DOUBLE + CASE WHEN alloc - p_first > 0 THEN greatest(least((today - alloc)::DOUBLE / (alloc - p_first)::DOUBLE, 1.0::DOUBLE), 0.0::DOUBLE) ELSE 0.0::DOUBLE END * 0.18::DOUBLE
  WHEN phase = 'oversave' THEN least(0.06::DOUBLE + progress * 0.34::DOUBLE + 0.06::DOUBLE, 0.46::DOUBLE) ELSE 0.06::DOUBLE + progress * 0.34::DOUBLE END AS xnow,
  CASE WHEN phase IN ('loan', 'done') THEN 0.4::DOUBLE END AS xloan FROM o_five
""", "o_five")
_YEAR = "coalesce(lpad(CAST(year({}) AS VARCHAR), 4, '0'), '')"
view("o_book", f"""
SELECT row_index, BSV AS id, phase, {_nearest('sr', 3)} AS savings_ratio, {_nearest('goal', 0)} AS saving_goal, contract_type, {_nearest('frac', 4)} AS goal_fraction, gsrc AS goal_source,
  {_nearest('ref', 0)} AS saving_reference, {_nearest('bal', 0)} AS balance, {_nearest('bsum', 0)} AS bauspar_sum, {_nearest('loan', 0)} AS loan_notional, {_nearest('bloan', 0)} AS bauspar_loan,
  {_nearest('ratio', 3)} AS loan_to_bauspar_ratio, bridge AS is_bridge_loan, est AS allocation_estimated, past AS allocation_in_past, active AS repayment_active,
  saa AS saving_after_allocation, warn AS warn_loan_pointless, c_start AS contract_start_date, p_first AS first_payment_date, alloc AS allocation_date,
  p_repay AS loan_start_date, c_end AS contract_end_date, {_YEAR.format('c_start')} AS year_contract, {_YEAR.format('p_first')} AS year_first_payment,
  CASE WHEN est THEN '~' ELSE '' END || {_YEAR.format('alloc')} AS year_allocation, {_YEAR.format('p_repay')} AS year_loan_start,
  0.02::DOUBLE AS x_contract, 0.06::DOUBLE AS x_first_payment, 0.4::DOUBLE AS x_allocation, {_nearest('xloan', 4)} AS x_loan_start, {_nearest('xnow', 4)} AS x_now
FROM o_six
""", "o_six")
view("o_export", """
SELECT row_index, id, phase, warn_loan_pointless::INT AS warn, savings_ratio AS sr, x_contract AS xc, x_first_payment AS xf, x_allocation AS xa, x_loan_start AS xl, x_now AS xn,
  year_contract AS lab_contract, year_first_payment AS lab_first, year_allocation AS lab_alloc, year_loan_start AS lab_loan, balance AS guthaben, bauspar_sum AS bausparsumme,
  saving_goal AS save_target, bauspar_loan AS loan_amount, loan_notional AS dabetrag, allocation_estimated::INT AS alloc_est, loan_to_bauspar_ratio AS da_bsum_ratio,
  is_bridge_loan::INT AS bridge, goal_fraction AS goal_frac, contract_type, goal_source, coalesce(loan_to_bauspar_ratio < 0.5, false)::INT AS special FROM o_book
""", "o_book")


def _script(c: str) -> str:
    return f"coalesce(rtrim(rtrim(printf('%.6f', {c}), '0'), '.'), 'null')"


_ENTRY_PARTS = []
for _name, _kind in lc.EXPORT_KINDS.items():
    if _name in ("warn", "alloc_est", "bridge", "special"):
        _value = f"CAST({_name} AS VARCHAR)"
    elif _kind == "num":
        _value = _script(_name)
    else:
        _value = f"'\"' || {_name} || '\"'"
    _ENTRY_PARTS.append(f"'\"{_name}\":' || {_value}")
view("o_entries", "SELECT row_index, '\"' || id || '\":{' || " + " || ',' || ".join(_ENTRY_PARTS) + " || '}' AS entry FROM o_export", "o_export")

# --- tables --------------------------------------------------------------------------------------------------------


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    return frame(spark, sf, "v_contracts")


@remembered
def cells(spark: SparkSession, sf: str) -> DataFrame:
    return lc.contract_cells(contracts(spark, sf), DAY)


@remembered
def record(spark: SparkSession, sf: str) -> DataFrame:
    return lc.publish(cells(spark, sf))


@remembered
def export(spark: SparkSession, sf: str) -> DataFrame:
    return lc.export_rows(record(spark, sf))


@remembered
def checked(spark: SparkSession, sf: str) -> DataFrame:
    return checks.stored_cells(contracts(spark, sf), DAY)


def date_cells(spark: SparkSession, sf: str) -> DataFrame:
    return contracts(spark, sf).select("row_index", F.explode(F.array(*lc.DATE_COLUMNS)).alias("cell"))


_DATE_CELLS = "SELECT row_index, unnest([" + ", ".join(lc.DATE_COLUMNS) + "]) AS cell FROM v_contracts"
_AMOUNT_CELLS = "SELECT row_index, unnest([" + ", ".join(lc.AMOUNT_COLUMNS) + "]) AS cell FROM v_contracts"
_ALL_CELLS = "SELECT row_index, unnest([" + ", ".join(TABLE_COLUMNS) + "]) AS cell, unnest([" + ", ".join(f"'{c}'" for c in TABLE_COLUMNS) + "]) AS field FROM v_contracts"

# --- B: cells ------------------------------------------------------------------------------------------------------


@query("b1_parse_mixed_date", sql_with("v_contracts", body=f"SELECT row_index, cell, {_mixed('cell')} AS day FROM ({_DATE_CELLS}) x"))
def b1(spark, sf):
    return date_cells(spark, sf).select("row_index", "cell", dates.parse_mixed_date(F.col("cell"))["date"].alias("day"))


@query("b2_date_class", sql_with("v_contracts", body=f"SELECT {_class('cell')} AS how, count(*) AS n FROM ({_DATE_CELLS}) x GROUP BY 1"))
def b2(spark, sf):
    return date_cells(spark, sf).groupBy(dates.date_class(F.col("cell")).alias("how")).agg(F.count("*").alias("n"))


@query("b3_coerce_date_column", sql_with("v_contracts", body=f"SELECT row_index, {_coerced('abschlussdatum')} AS start_date, {_coerced('einloesungsdatum')} AS payment_date FROM v_contracts"))
def b3(spark, sf):
    df = lc.coerce_date_column(contracts(spark, sf), "abschlussdatum", "start_date")
    return lc.coerce_date_column(df, "einloesungsdatum", "payment_date").select("row_index", "start_date", "payment_date")


@query("b4_parse_de_number", sql_with("v_contracts", body=f"SELECT row_index, cell, {_amount('cell')} AS value FROM ({_AMOUNT_CELLS}) x"))
def b4(spark, sf):
    cells_ = contracts(spark, sf).select("row_index", F.explode(F.array(*lc.AMOUNT_COLUMNS)).alias("cell"))
    return cells_.select("row_index", "cell", amounts.parse_de_number(F.col("cell"))["value"].alias("value"))


_POISON = "CASE WHEN row_index % 1000 = 777 THEN '2013-13-45' ELSE Tilgungsbeginn END"


@query("b5_abort_record", sql_with("v_contracts", body=f"""SELECT 'DATE_PARSE_ABORT' AS abort_code, row_index, 'Tilgungsbeginn' AS "column", t AS raw_value, row_index - 1 AS rows_completed
FROM (SELECT row_index, {_POISON} AS t FROM v_contracts) x WHERE {_class('t')} = 'unreadable_hyphenated' ORDER BY row_index LIMIT 1"""))
def b5(spark, sf):
    poisoned = contracts(spark, sf).withColumn("Tilgungsbeginn", F.when(F.col("row_index") % 1000 == 777, "2013-13-45").otherwise(F.col("Tilgungsbeginn")))
    return lc.abort_record(poisoned)


_KIND = r"""CASE WHEN cell IN ('', '0', '00', '0000', '00000000', 'NA', '<NA>') THEN 'empty_marker' WHEN regexp_matches(cell, '^\d{4}-\d{2}-\d{2}$') THEN 'date_iso'
  WHEN regexp_matches(cell, '^\d{8}$') THEN 'date_yyyymmdd' WHEN regexp_matches(cell, '^-?\d{1,3}(\.\d{3})*,\d+$|^-?\d+,\d+$') THEN 'number_de_comma'
  WHEN regexp_matches(cell, '^-?\d+(\.\d+)?$') THEN 'number_plain' ELSE 'text' END"""


@query("b6_classify_cell", sql_with("v_contracts", body=f"SELECT field, {_KIND} AS kind, count(*) AS n FROM ({_ALL_CELLS}) x GROUP BY ALL"))
def b6(spark, sf):
    long = contracts(spark, sf).unpivot([], TABLE_COLUMNS, "field", "cell")
    return long.groupBy("field", amounts.classify_cell(F.col("cell")).alias("kind")).agg(F.count("*").alias("n"))


@query("b7_exponent_ids", sql_with("v_contracts", body=r"SELECT row_index, BSV AS id FROM v_contracts WHERE regexp_matches(BSV, '^[+-]?\d*\.?\d+[eE][+-]?\d+$')"))
def b7(spark, sf):
    return contracts(spark, sf).filter(text.is_exponent_id(F.col("BSV"))).select("row_index", F.col("BSV").alias("id"))


@query("b8_year_label", sql_with("o_parsed", body=f"SELECT row_index, {_YEAR.format('p_start')} AS plain, CASE WHEN p_start IS NULL THEN '' ELSE '~' END || {_YEAR.format('p_start')} AS estimated FROM o_parsed"))
def b8(spark, sf):
    d = F.col("parsed_start")
    return cells(spark, sf).select("row_index", dates.year_label(d).alias("plain"), dates.year_label(d, F.lit(True)).alias("estimated"))


@query("b9_clamp", sql_with("o_parsed", body="SELECT row_index, CASE WHEN bal IS NULL THEN NULL ELSE greatest(least(bal / 100000.0, 1.0), 0.25) END AS held FROM o_parsed"))
def b9(spark, sf):
    return cells(spark, sf).select("row_index", lc.clamp(F.col("raw_balance") / 100000.0, 0.25, 1.0).alias("held"))


@query("b10_round_exact", "SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 7, 3) AS r3, round_even(l_extendedprice, 0) AS r0, round_even(l_quantity / 4, 0) AS tie0 FROM lineitem")
def b10(spark, sf):
    base = frame(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") / 7).alias("r3"), F.col("l_extendedprice").alias("r0"), (F.col("l_quantity") / 4).alias("tie0")
    )
    return round_columns(base, {"r3": 3, "r0": 0, "tie0": 0})


@query("b11_canonical_number", "SELECT l_orderkey, l_linenumber, l_partkey, printf('%.8e', l_extendedprice / 7) AS a, CASE WHEN l_discount = 0 THEN '0.00000000e+00' ELSE printf('%.8e', l_discount / 8192) END AS b FROM lineitem")
def b11(spark, sf):
    return frame(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", canonical.canonical_number(F.col("l_extendedprice") / 7).alias("a"), canonical.canonical_number(F.col("l_discount") / 8192).alias("b")
    )


@query("b12_canonical_cells", r"""SELECT doc_id, replace(replace(replace(text, '\', '\\'), chr(10), '\n'), chr(13), '\r') AS text_cell,
  CASE WHEN n_chars % 3 = 0 THEN 'NA' WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END AS flag_cell, CAST(10000 + n_chars AS VARCHAR) AS date_cell FROM documents""")
def b12(spark, sf):
    docs = frame(spark, sf, "documents")
    flag = F.when(F.col("n_chars") % 3 != 0, F.col("n_chars") % 2 == 0)
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.col("n_chars") + 10000).cast("int"))
    return docs.select(
        "doc_id", canonical.canonical_cell(F.col("text"), "str").alias("text_cell"), canonical.canonical_cell(flag, "bool").alias("flag_cell"), canonical.canonical_cell(day, "date").alias("date_cell")
    )


@query("b13_script_number", f"SELECT l_orderkey, l_linenumber, l_partkey, {_script('l_extendedprice / 7')} AS a, {_script('l_discount / -4096')} AS b FROM lineitem")
def b13(spark, sf):
    return frame(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", rendering.script_number(F.col("l_extendedprice") / 7).alias("a"), rendering.script_number(F.col("l_discount") / -4096).alias("b")
    )


@query("b14_script_text", r"""SELECT page_id, '"' || replace(replace(html, '\', '\\'), '"', '\"') || '"' AS value_text, replace(url || '"x\', '"', '\"') AS key_text FROM pages""")
def b14(spark, sf):
    return frame(spark, sf, "pages").select(
        "page_id", rendering.script_string(F.col("html")).alias("value_text"), rendering.script_key(F.concat("url", F.lit('"x\\'))).alias("key_text")
    )


@query("b15_predicates", sql_with("v_contracts", body=r"""SELECT field, count(*) FILTER (regexp_matches(cell, '^\d{4}-\d{2}-\d{2}$') AND TRY_CAST(cell AS DATE) IS NOT NULL) AS iso_dates,
  count(*) FILTER (trim(cell) <> '') AS filled, count(*) FILTER (regexp_matches('C-' || cell, '^C-?[A-Za-z0-9][A-Za-z0-9._-]*$')) AS ids FROM (""" + _ALL_CELLS + ") x GROUP BY field"))
def b15(spark, sf):
    cell = F.col("cell")
    long = contracts(spark, sf).unpivot([], TABLE_COLUMNS, "field", "cell")
    return long.groupBy("field").agg(
        F.count_if(text.is_iso_date(cell)).alias("iso_dates"), F.count_if(text.has_content(cell)).alias("filled"),
        F.count_if(text.is_claim_id(F.concat(F.lit("C-"), cell))).alias("ids"),
    )


# --- I: lifecycle steps --------------------------------------------------------------------------------------------

_STEPS = {
    "i1_contract_start": ("c_start AS contract_start_date", ["contract_start_date"]),
    "i2_allocation": ("alloc AS allocation_date, est AS allocation_estimated", ["allocation_date", "allocation_estimated"]),
    "i3_contract_end": ("c_end AS contract_end_date, p_end IS NULL AS contract_end_estimated", ["contract_end_date", "contract_end_estimated"]),
    "i4_amounts": ("loan AS raw_loan_notional, bsum AS raw_bauspar_sum, bal AS raw_balance", ["raw_loan_notional", "raw_bauspar_sum", "raw_balance"]),
    "i5_goal": ("frac AS raw_goal_fraction, gsrc AS goal_source", ["raw_goal_fraction", "goal_source"]),
    "i6_contract_type": ("contract_type", ["contract_type"]),
    "i7_bridge": ("ratio AS raw_loan_to_bauspar_ratio, bridge AS is_bridge_loan, ref AS raw_saving_reference", ["raw_loan_to_bauspar_ratio", "is_bridge_loan", "raw_saving_reference"]),
    "i8_derived_amounts": ("goal AS raw_saving_goal, sr AS raw_savings_ratio, bloan AS raw_bauspar_loan, warn AS warn_loan_pointless", ["raw_saving_goal", "raw_savings_ratio", "raw_bauspar_loan", "warn_loan_pointless"]),
    "i9_predicates": ("past AS allocation_in_past, active AS repayment_active, ended AS contract_ended, over_goal", ["allocation_in_past", "repayment_active", "contract_ended", "over_goal"]),
    "i10_phase": ("phase, saa AS saving_after_allocation", ["phase", "saving_after_allocation"]),
    "i11_positions": ("progress AS saving_progress, xloan AS raw_x_loan_start, xnow AS raw_x_now", ["saving_progress", "raw_x_loan_start", "raw_x_now"]),
    "i12_labels": (f"{_YEAR.format('c_start')} AS year_contract, {_YEAR.format('p_first')} AS year_first_payment, CASE WHEN est THEN '~' ELSE '' END || {_YEAR.format('alloc')} AS year_allocation, {_YEAR.format('p_repay')} AS year_loan_start",
                   ["year_contract", "year_first_payment", "year_allocation", "year_loan_start"]),
}


def _register_step(name: str, sql: str, columns: list[str]) -> None:
    @query(name, sql_with("o_six", body=f"SELECT row_index, {sql} FROM o_six"))
    def run(spark, sf):
        return cells(spark, sf).select("row_index", *columns)


for _step, (_sql, _columns) in _STEPS.items():
    _register_step(_step, _sql, _columns)


@query("i13_published_numbers", sql_with("o_book", body="SELECT row_index, " + ", ".join(lc.PLACES) + " FROM o_book"))
def i13(spark, sf):
    return record(spark, sf).select("row_index", *lc.PLACES)


@query("i14_contract_book", sql_with("o_book", body="SELECT * FROM o_book"))
def i14(spark, sf):
    return record(spark, sf)


@query("i15_phase_summary", sql_with("o_book", body="SELECT phase, contract_type, count(*) AS contracts FROM o_book GROUP BY ALL"))
def i15(spark, sf):
    return lc.phase_summary(record(spark, sf))


# --- J: export -----------------------------------------------------------------------------------------------------


@query("j1_export_rows", sql_with("o_export", body="SELECT * FROM o_export"))
def j1(spark, sf):
    return export(spark, sf)


@query("j2_render_entries", sql_with("o_entries", body="SELECT * FROM o_entries"))
def j2(spark, sf):
    return lc.render_entries(export(spark, sf))


@query("j3_render_document", sql_with("o_entries", body=f"""
SELECT row_index + 3 AS line_no, entry || CASE WHEN row_index = (SELECT count(*) FROM v_contracts) THEN '' ELSE ',' END AS line_text FROM o_entries
UNION ALL SELECT 1, '{lc.DOCUMENT_FIRST}' UNION ALL SELECT 2, '// ' || CAST(count(*) AS VARCHAR) || ' contracts, valuation date {DAY}' FROM v_contracts
UNION ALL SELECT 3, '{lc.DOCUMENT_OPEN}' UNION ALL SELECT count(*) + 4, '{lc.DOCUMENT_CLOSE}' FROM v_contracts"""))
def j3(spark, sf):
    return lc.render_document(export(spark, sf), DAY)


# --- G: profiles ---------------------------------------------------------------------------------------------------

_NUM = f"CASE {_KIND} WHEN 'number_de_comma' THEN TRY_CAST(replace(replace(cell, '.', ''), ',', '.') AS DOUBLE) ELSE CASE WHEN regexp_matches(cell, '^-?\\d+(\\.\\d+)?$') THEN TRY_CAST(cell AS DOUBLE) END END"
_DATE = "CASE " + _KIND + " WHEN 'date_iso' THEN TRY_CAST(cell AS DATE) WHEN 'date_yyyymmdd' THEN TRY_CAST(substr(cell, 1, 4) || '-' || substr(cell, 5, 2) || '-' || substr(cell, 7, 2) AS DATE) END"
# '00000000' is an empty marker, yet has the shape of a compact date; it is no calendar day either way
_PROFILE = f"SELECT field, cell, {_KIND} AS kind, {_NUM} AS num, {_DATE} AS d FROM ({_ALL_CELLS}) x"


@remembered
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return pr.value_counts(contracts(spark, sf), TABLE_COLUMNS)


@query("g1_profile", sql_with("v_contracts", body=f"""
SELECT field, rows, type, null_count, distinct_values, rows - distinct_values AS duplicates, min_number, max_number, CASE WHEN min_number IS NULL THEN a END AS min_date, CASE WHEN min_number IS NULL THEN b END AS max_date FROM (
SELECT field, CAST(sum(n) AS BIGINT) AS rows, string_agg(kind || ':' || CAST(n AS VARCHAR), '+' ORDER BY kind) AS type, CAST(coalesce(sum(n) FILTER (kind = 'empty_marker'), 0) AS BIGINT) AS null_count,
  CAST(sum(dv) AS BIGINT) AS distinct_values, min(lo) AS min_number, max(hi) AS max_number, min(a) AS a, max(b) AS b
FROM (SELECT field, kind, count(*) AS n, count(DISTINCT cell) AS dv, min(num) AS lo, max(num) AS hi, min(d) AS a, max(d) AS b FROM ({_PROFILE}) p GROUP BY ALL) k GROUP BY field) z"""))
def g1(spark, sf):
    return pr.profile(counts(spark, sf))


@query("g2_values_in_full", sql_with("v_contracts", body=f"SELECT field, cell AS value, count(*) AS n, count(*) OVER (PARTITION BY field) AS distinct_values FROM ({_ALL_CELLS}) x GROUP BY field, cell"))
def g2(spark, sf):
    return pr.values_in_full(counts(spark, sf))


@query("g3_magnitude_histogram", sql_with("v_contracts", body=f"SELECT field, CASE WHEN num = 0 THEN '0' ELSE CAST(length(CAST(CAST(floor(abs(num)) AS BIGINT) AS VARCHAR)) AS VARCHAR) END AS magnitude, count(*) AS n FROM ({_PROFILE}) p WHERE num IS NOT NULL GROUP BY ALL"))
def g3(spark, sf):
    return pr.magnitude_histogram(counts(spark, sf))


@query("g4_date_range", sql_with("v_contracts", body=f"SELECT min(d) AS min_date, max(d) AS max_date, min(d) > DATE '1950-01-01' AND max(d) < DATE '2100-01-01' AS plausible FROM ({_PROFILE}) p"))
def g4(spark, sf):
    return pr.date_range(counts(spark, sf))


_WIDTH = 9
view("v_positional", """
SELECT o_orderkey AS line_no, CAST(o_orderkey % 1400 AS STRING) || '|' || o_orderpriority || '||' || CAST(o_custkey AS STRING) || ',' || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || '|' || CAST(o_orderdate AS STRING) || '|' ||
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END || '|x|' || CASE WHEN o_orderkey % 50 = 3 THEN 'short' ELSE 'y|' || CAST(o_custkey % 10 AS STRING) END AS line
FROM orders
""")
_SPLIT = "SELECT line_no, unnest(string_split(line, '|')) AS v, generate_subscripts(string_split(line, '|'), 1) AS position FROM v_positional"
_LOOSE = r"CASE WHEN regexp_matches(replace(replace(v, '.', ''), ',', '.'), '^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$') THEN CAST(replace(replace(v, '.', ''), ',', '.') AS DOUBLE) END"


@query("g5_profile_positional", sql_with("v_positional", body=f"""
SELECT CAST(g.position AS INTEGER) AS position, (SELECT count(*) FROM v_positional) - coalesce(n, 0) AS null_count, min_value, max_value, coalesce(t, 0) > 0 AS has_text,
  CASE WHEN g.position = 1 THEN (SELECT count(DISTINCT split_part(line, '|', 1)) FROM v_positional) END AS distinct_keys,
  CASE WHEN g.position = 1 THEN (SELECT count(*) - count(DISTINCT split_part(line, '|', 1)) FROM v_positional) END AS duplicate_keys
FROM (SELECT unnest(range(1, {_WIDTH + 1})) AS position) g LEFT JOIN (SELECT position, count(*) AS n, min({_LOOSE}) AS min_value, max({_LOOSE}) AS max_value, count(*) FILTER (({_LOOSE}) IS NULL) AS t
  FROM ({_SPLIT}) s WHERE v <> '' GROUP BY position) p ON p.position = g.position"""))
def g5(spark, sf):
    return pr.profile_positional(frame(spark, sf, "v_positional"), _WIDTH, key=1)


view("v_sheet", """
SELECT o_orderkey + 10 AS row, 1 AS col, CAST(NULL AS DOUBLE) AS number, o_orderpriority || CAST(o_custkey % 37 AS STRING) AS text FROM orders
UNION ALL SELECT o_orderkey + 10, 2, CAST(NULL AS DOUBLE), CAST(o_custkey AS STRING) || ',5' FROM orders
UNION ALL SELECT o_orderkey + 10, 3, CAST(o_custkey % 90000 AS DOUBLE) + 0.5, CAST(NULL AS STRING) FROM orders
UNION ALL SELECT 5, 10 + n_nationkey, 36526.0 + n_nationkey, CAST(NULL AS STRING) FROM nation
UNION ALL SELECT o_orderkey + 10, 4, CAST(36000 + o_orderkey % 5000 AS DOUBLE), CAST(NULL AS STRING) FROM orders
""")


@query("g6_anchor_scores", sql_with("v_sheet", body=f"""
SELECT 'header_row' AS what, CAST(arg_max(row, (s, -row)) AS BIGINT) AS place, max(s) AS score, (array_agg(s ORDER BY s DESC))[2] AS runner_up, max(s) - (array_agg(s ORDER BY s DESC))[2] AS margin
FROM (SELECT row, count(*) FILTER (number BETWEEN 30000 AND 60000 AND number = floor(number)) AS s FROM v_sheet GROUP BY row) a
UNION ALL SELECT 'label_column', CAST(arg_max(col, (s, -col)) AS BIGINT), max(s), (array_agg(s ORDER BY s DESC))[2], max(s) - (array_agg(s ORDER BY s DESC))[2]
FROM (SELECT col, count(DISTINCT text) FILTER (({_LOOSE.replace('(v,', '(text,')}) IS NULL) AS s FROM v_sheet WHERE row > 5 GROUP BY col) b"""))
def g6(spark, sf):
    return pr.anchor_scores(frame(spark, sf, "v_sheet"))


@query("g7_gaps", """SELECT user_id, CAST(after AS BIGINT) AS after, CAST(before AS BIGINT) AS before FROM (SELECT user_id, lag(k) OVER (PARTITION BY user_id ORDER BY k) AS after, k AS before FROM
  (SELECT DISTINCT user_id, CAST(floor(event_id / 10) AS BIGINT) AS k FROM events) e) x WHERE before - after > 1""")
def g7(spark, sf):
    keys = frame(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 10).cast("bigint").alias("k"))
    return pr.gaps(keys, "user_id", "k")


@query("h24_trend_breaks", """SELECT user_id, event_id, value, step, m AS recent_median FROM (
  SELECT *, median(step) OVER w AS m, count(step) OVER w AS n FROM (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events) s
  WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) x WHERE n = 5 AND m <> 0 AND abs(step / m) > 10""")
def h24(spark, sf):
    return pr.trend_breaks(frame(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", ["event_id"], "value")


_P = {"abschlussdatum": "p_start", "einloesungsdatum": "p_first", "erstmalige_zuteilungsanwartschaft": "p_alloc", "Tilgungsbeginn": "p_repay", "Vertragsende": "p_end"}


@query("g8_date_stats", sql_with("o_parsed", body="\nUNION ALL ".join(f"""
SELECT '{c}' AS field, count(*) FILTER (k = 'marker') AS marker, count(*) FILTER (k = 'hyphen_ok') AS hyphen_valid, count(*) FILTER (k = 'digits_ok') AS eight_digit_valid,
  count(*) FILTER (k LIKE 'unreadable%') AS unreadable, count(*) FILTER (k = 'unreadable_hyphenated') AS unreadable_hyphenated, count(d) AS parsed_count, min(d) AS min_date, max(d) AS max_date,
  count(*) FILTER (d < DATE '1950-01-01' OR d > DATE '2100-01-01') AS implausible FROM (SELECT {_class(c)} AS k, {p} AS d FROM o_parsed) x""" for c, p in _P.items())))
def g8(spark, sf):
    return pr.date_stats(cells(spark, sf), lc.DATE_COLUMNS, checks.PARSED)


@query("g8_first_offenders", sql_with("v_contracts", body="SELECT field, row_index, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY row_index) AS rank FROM (" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS field, row_index, {c} AS value FROM v_contracts WHERE {_class(c)} LIKE 'unreadable%'" for c in _P) + ") x) y"))
def g8b(spark, sf):
    return pr.first_offenders(contracts(spark, sf), lc.DATE_COLUMNS)


@query("g9_amount_stats", sql_with("v_contracts", body="\nUNION ALL ".join(f"""
SELECT '{c}' AS field, count(*) FILTER (v IS NULL) AS missing, count(*) FILTER (v < 0) AS negative, min(v) AS min_value, max(v) AS max_value,
  count(*) FILTER (length(t) - length(replace(t, ',', '')) >= 2) AS multi_comma, count(*) FILTER (contains(t, '.') AND NOT contains(t, ',')) AS dot_no_comma,
  count(*) FILTER (NOT contains(t, ',') AND contains(t, '.') AND length(t) - length(regexp_extract(t, '^.*\\.')) = 3) AS thousands_dot,
  count(*) FILTER (t = '0') AS zero_text, count(*) FILTER (t = '') AS empty_text FROM (SELECT trim({c}) AS t, {_amount(c)} AS v FROM v_contracts) x""" for c in lc.AMOUNT_COLUMNS)))
def g9(spark, sf):
    return pr.amount_stats(contracts(spark, sf), lc.AMOUNT_COLUMNS)


_IDC = "(SELECT BSV AS id, count(*) AS n, min(row_index) AS first_row FROM v_contracts GROUP BY BSV)"
_EXP = r"regexp_matches(id, '^[+-]?\d*\.?\d+[eE][+-]?\d+$')"


@query("g10_id_stats", sql_with("v_contracts", body=f"""SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_ids, count(*) FILTER (n > 1) AS duplicated_ids,
  CAST(coalesce(sum(n) FILTER ({_EXP}), 0) AS BIGINT) AS exponent_shaped, min(id) AS min_id, max(id) AS max_id FROM {_IDC} i"""))
def g10(spark, sf):
    return pr.id_stats(contracts(spark, sf), "BSV")


@query("g10_first_ids", sql_with("v_contracts", body=f"""SELECT * FROM (SELECT 'duplicated' AS what, id, first_row FROM {_IDC} i WHERE n > 1) a
UNION ALL SELECT * FROM (SELECT 'exponent', BSV AS id, row_index FROM v_contracts WHERE {_EXP.replace('id,', 'BSV,')} ) b"""))
def g10b(spark, sf):
    return pr.first_ids(contracts(spark, sf), "BSV")


@query("g11_tally", sql_with("o_book", body="SELECT 'phase' AS what, phase AS value, count(*) AS n FROM o_book GROUP BY ALL UNION ALL SELECT 'goal_source', goal_source, count(*) FROM o_book GROUP BY ALL UNION ALL SELECT 'contract_type', contract_type, count(*) FROM o_book GROUP BY ALL"))
def g11(spark, sf):
    r = record(spark, sf)
    parts = [pr.tally(r, c).select(F.lit(c).alias("what"), "value", "n") for c in ("phase", "goal_source", "contract_type")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("g12_markers_seen", sql_with("v_contracts", body=f"SELECT DISTINCT trim(cell) AS marker FROM ({_DATE_CELLS}) x WHERE trim(cell) IN {_MARK}"))
def g12(spark, sf):
    return pr.markers_seen(contracts(spark, sf), lc.DATE_COLUMNS)


# --- H: preconditions ----------------------------------------------------------------------------------------------


def _c(condition: str) -> str:
    return f"count(*) FILTER ({condition})"


_UNREAD = {f"unreadable_{c}": _c(f"{_class(c)} LIKE 'unreadable%'") for c in _P} | {f"hyphenated_{c}": _c(f"{_class(c)} = 'unreadable_hyphenated'") for c in _P}
_SUM_UNREAD = " + ".join(f"unreadable_{c}" for c in _P)
_TARIFF = {"tariff_at_most_0": _c("tariff <= 0"), "tariff_above_1": _c("tariff > 1"), "tariff_missing": _c("tariff IS NULL")}
_IDS_ = {"rows": "(SELECT count(*) FROM v_contracts)", "distinct_ids": f"(SELECT count(*) FROM {_IDC} i)", "duplicated_ids": f"(SELECT count(*) FROM {_IDC} i WHERE n > 1)"}
_DISC = f"abs({_nearest('bloan', 0)} - ({_nearest('ref', 0)} - {_nearest('bal', 0)}))"
_PRE: dict[str, tuple[str, dict[str, str], str, str]] = {
    "P-01": ("FAIL", {"absent": "0", "surplus": "0"}, "absent > 0", "true"),
    "P-02": ("FAIL", {"id_present": "1"}, "id_present = 0", "true"),
    "P-03": ("FAIL", _UNREAD, f"{_SUM_UNREAD} > 0", "true"),
    "P-04": ("FLAGGED", {f"parsed_{c}": f"count({p})" for c, p in _P.items()} | {f"outside_{c}": _c(f"{p} < DATE '1950-01-01' OR {p} > DATE '2100-01-01'") for c, p in _P.items()},
             " + ".join(f"outside_{c}" for c in _P) + " > 0", " + ".join(f"parsed_{c}" for c in _P) + " > 0"),
    "P-05": ("FAIL", _TARIFF, "tariff_at_most_0 > 0 OR tariff_above_1 > 0", "true"),
    "P-06": ("FLAGGED", {"negative_DaBetrag": _c("loan < 0"), "negative_bausparsumme_teuro": _c("bsum < 0"), "negative_guthaben": _c("bal < 0")}, "negative_DaBetrag + negative_bausparsumme_teuro + negative_guthaben > 0", "true"),
    "P-07": ("FLAGGED", _IDS_, "duplicated_ids > 0", "true"),
    "P-08": ("FAIL", {"phase_out_of_set": "0", "goal_source_out_of_set": "0", "position_outside": _c(f"{_nearest('xnow', 4)} NOT BETWEEN 0 AND 1"), "progress_outside": _c("progress NOT BETWEEN 0 AND 1")}, "position_outside + progress_outside > 0", "true"),
    "P-09": ("FAIL", {"rows_read": "(SELECT count(*) FROM v_contracts)", "records_published": "count(*)"}, "rows_read <> records_published", "true"),
    "P-10": ("FLAGGED", {"prefix_collisions": "0"}, "prefix_collisions > 0", "true"),
    "P-11": ("FLAGGED", {f"multi_comma_{c}": _c(f"length({c}) - length(replace({c}, ',', '')) >= 2") for c in lc.AMOUNT_COLUMNS}, " + ".join(f"multi_comma_{c}" for c in lc.AMOUNT_COLUMNS) + " > 0", "true"),
    "P-12": ("FAIL", {"valuation_day": f"CAST(DATE '{DAY}' - DATE '1970-01-01' AS INTEGER)"}, "valuation_day IS NULL", "true"),
    "P-13": ("FLAGGED", {"median": "median(ratio)", "values": "count(ratio)"}, "median < 0.01 OR median > 100", '"values" > 0'),
    "FND-01": ("FAIL", {f"thousands_dot_{c}": _c(f"NOT contains({c}, ',') AND regexp_matches({c}, '\\.[^.][^.][^.]$')") for c in lc.AMOUNT_COLUMNS},
               " + ".join(f"thousands_dot_{c}" for c in lc.AMOUNT_COLUMNS if c != "bausparsumme_teuro") + " > 0", "true"),
    "FND-02": ("FAIL", _TARIFF, "tariff_above_1 > 0", "true"),
    "FND-03": ("FLAGGED", {"exponent_ids": _c(_EXP.replace("id,", "BSV,"))}, "exponent_ids > 0", "true"),
    "FND-04": ("FLAGGED", _IDS_, "duplicated_ids > 0", "true"),
    "FND-05": ("FLAGGED", {"ratio_missing": _c("ratio IS NULL"), "ratio_at_most_05": _c("ratio <= 0.5"), "ratio_between": _c("ratio > 0.5 AND ratio <= 2"), "ratio_above_2": _c("ratio > 2"),
                           "alarms": _c(f"{_nearest('ratio', 3)} < 0.5"), "bridges": _c("bridge")}, "alarms <> ratio_at_most_05", "true"),
    "FND-06": ("FLAGGED", _UNREAD, f"{_SUM_UNREAD} > 0", "true"),
    "FND-08": ("FLAGGED", {"allocation_estimated": _c("est"), "contract_end_absent": _c("p_end IS NULL"), "both_absent": _c("est AND p_end IS NULL"), "done_with_both_absent": _c("est AND p_end IS NULL AND phase = 'done'")}, "done_with_both_absent > 0", "true"),
    "FND-09": ("FLAGGED", {"loan_discrepancies": _c(f"{_DISC} > 0"), "loan_discrepancy_max": f"max({_DISC})"}, "loan_discrepancy_max > 1", "true"),
    "FND-10": ("FLAGGED", {"phase_out_of_set": "0", "savings_ratio_missing": _c("sr IS NULL")}, "false", "true"),
    "FND-11": ("FLAGGED", {"markers": f"(SELECT string_agg(m, '|' ORDER BY m) FROM (SELECT DISTINCT CASE WHEN trim(cell) = '' THEN '(empty)' ELSE trim(cell) END AS m FROM ({_DATE_CELLS}) x WHERE trim(cell) IN {_MARK}) y)"}, "false", "true"),
    "FND-12": ("FLAGGED", {"prefix_collisions": "0", "absent": "0"}, "prefix_collisions > 0", "true"),
    "FND-13": ("FLAGGED", {"warn_disagreements": _c(f"coalesce({_nearest('sr', 3)} >= 0.9, false) <> warn")}, "warn_disagreements > 0", "true"),
}


def _pre_body(ids: list[str]) -> str:
    out = []
    for i in ids:
        severity, stats, breach, exercised = _PRE[i]
        inner = ", ".join(f'{v} AS "{k}"' for k, v in stats.items())
        show = " || '; ' || ".join(
            f"'{k}=' || " + (f"rtrim(rtrim(printf('%.6f', \"{k}\"), '0'), '.')" if k in ("median", "loan_discrepancy_max") else f'CAST("{k}" AS VARCHAR)') for k in sorted(stats)
        )
        out.append(f"SELECT '{i}' AS id, '{severity}' AS severity, CASE WHEN NOT ({exercised}) THEN 'NOT_EXERCISED' WHEN {breach} THEN '{severity}' ELSE 'PASS' END AS status, {show} AS evidence FROM (SELECT {inner} FROM o_six LIMIT 1) s")
    return "\nUNION ALL ".join(out)


def _register_check(name: str, ids: list[str] | None) -> None:
    @query(name, sql_with("o_six", body=_pre_body(ids or list(_PRE))))
    def run(spark, sf):
        df = contracts(spark, sf)
        cells = checked(spark, sf) if ids is None else checks.cells_for(df, DAY, only=ids)
        return checks.evidence_text(checks.evaluate(cells, df.columns, ids))


for _n, _ids in {
    "h1_columns_present": ["P-01", "P-02"], "h2_unreadable_dates": ["P-03", "FND-06"], "h3_plausible_dates": ["P-04"], "h4_tariff_share": ["P-05", "FND-02"],
    "h5_negative_amounts": ["P-06"], "h6_unique_ids": ["P-07", "FND-04"], "h7_derived_shapes": ["P-08"], "h8_rows_kept": ["P-09"], "h9_prefix_names": ["P-10", "FND-12"],
    "h10_two_commas": ["P-11"], "h12_median_ratio": ["P-13"], "h13_thousands_dot": ["FND-01"], "h14_exponent_ids": ["FND-03"],
    "h15_ratio_bands": ["FND-05"], "h16_chained_fallback": ["FND-08"], "h17_rounding_discrepancy": ["FND-09"], "h18_value_sets": ["FND-10"], "h19_marker_coverage": ["FND-11"],
    "h20_flag_vs_rounded": ["FND-13"], "h_all_preconditions": None,
}.items():
    _register_check(_n, _ids)


@query("h13_thousands_dot_ranges", sql_with("v_contracts", body="\nUNION ALL ".join(f"""
SELECT '{c}' AS field, count(*) FILTER (s) AS suspects, min(v) FILTER (s) AS suspect_min, max(v) FILTER (s) AS suspect_max, min(v) FILTER (NOT s) AS clear_min, max(v) FILTER (NOT s) AS clear_max,
  max(v) FILTER (s) >= min(v) FILTER (NOT s) AND min(v) FILTER (s) <= max(v) FILTER (NOT s) AS ranges_overlap
FROM (SELECT {_amount(c)} AS v, NOT contains({c}, ',') AND regexp_matches({c}, '\\.[^.][^.][^.]$') AS s FROM v_contracts) x""" for c in lc.AMOUNT_COLUMNS)))
def h13b(spark, sf):
    return checks.thousands_dot_overlap(contracts(spark, sf), lc.AMOUNT_COLUMNS)


# a catalogue of header names: one file per supplier nation, names cut or extended by key
_NAMES = ", ".join(f"('{c}', {i})" for i, c in enumerate(lc.INPUT_COLUMNS))
view("v_catalogue", f"""
SELECT DISTINCT 'file-' || CAST(s_suppkey AS STRING) || '.csv' AS file, CASE WHEN (s_suppkey + i) % 13 = 0 THEN name || '_alt' WHEN (s_suppkey + i) % 17 = 0 THEN lower(name) ELSE name END AS "column"
FROM supplier JOIN (VALUES {_NAMES}) n(name, i) ON i <= s_suppkey % 3 + 9
""")
view("s_catalogue", f"""
SELECT DISTINCT 'file-' || CAST(s_suppkey AS STRING) || '.csv' AS file, CASE WHEN (s_suppkey + i) % 13 = 0 THEN name || '_alt' WHEN (s_suppkey + i) % 17 = 0 THEN lower(name) ELSE name END AS `column`
FROM supplier JOIN (VALUES {_NAMES}) n(name, i) ON i <= s_suppkey % 3 + 9
""")
_REQ = "(VALUES " + ", ".join(f"('{c}')" for c in lc.INPUT_COLUMNS) + ") r(req)"


@query("h1_required_columns", sql_with("v_catalogue", body=f"""
SELECT f.file, coalesce(absent, '') AS absent, surplus, CASE WHEN absent IS NULL THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT file, count(*) FILTER ("column" NOT IN (SELECT req FROM {_REQ})) AS surplus FROM v_catalogue GROUP BY file) f
LEFT JOIN (SELECT file, string_agg(req, ',' ORDER BY req) AS absent FROM (SELECT DISTINCT file FROM v_catalogue) a, {_REQ} WHERE NOT EXISTS (SELECT 1 FROM v_catalogue v WHERE v.file = a.file AND v."column" = req) GROUP BY file) m USING (file)"""))
def h1b(spark, sf):
    return checks.required_columns(frame(spark, sf, "s_catalogue"), lc.INPUT_COLUMNS)


@query("h9_prefix_collisions", sql_with("v_catalogue", body=f"""SELECT DISTINCT file, "column", req AS declared FROM v_catalogue JOIN {_REQ} ON starts_with("column", req) AND "column" <> req"""))
def h9b(spark, sf):
    return checks.prefix_collisions(frame(spark, sf, "s_catalogue"), lc.INPUT_COLUMNS)


_DECLARED = [
    ("IO-ROWS", "observational", "503"), ("IO-NAMES", "computation_critical", "11"), ("IO-MARKERS", "observational", "5"), ("IO-COERCE", "computation_critical", "abschlussdatum, einloesungsdatum"),
    ("IO-TYPES", "observational", "6"), ("IO-IDS", "computation_critical", "unique"),
]


@query("h22_declared_vs_observed", sql_with("v_contracts", body=f"""
SELECT id, klass, declared, observed, declared IS NOT DISTINCT FROM observed AS agreed, klass = 'computation_critical' AND declared IS DISTINCT FROM observed AS halts
FROM (VALUES {', '.join(str(d) for d in _DECLARED)}) d(id, klass, declared) LEFT JOIN (
  SELECT 'IO-ROWS' AS id, CAST(count(*) AS VARCHAR) AS observed FROM v_contracts UNION ALL SELECT 'IO-NAMES', '11'
  UNION ALL SELECT 'IO-MARKERS', CAST(count(DISTINCT trim(cell)) AS VARCHAR) FROM ({_DATE_CELLS}) x WHERE trim(cell) IN {_MARK}
  UNION ALL SELECT 'IO-TYPES', CAST(count(DISTINCT contract_type) AS VARCHAR) FROM v_contracts
  UNION ALL SELECT 'IO-IDS', CASE WHEN count(*) = count(DISTINCT BSV) THEN 'unique' ELSE 'repeated' END FROM v_contracts) o USING (id)"""))
def h22(spark, sf):
    df = contracts(spark, sf)
    declared = spark.createDataFrame(_DECLARED, "id string, klass string, reading string")
    held = len([c for c in df.columns if c in lc.INPUT_COLUMNS])
    one = df.agg(F.count("*").cast("string").alias("rows"), F.count_distinct("contract_type").cast("string").alias("types"))
    ids = pr.id_stats(df, "BSV").select(F.when(F.col("duplicated_ids") == 0, "unique").otherwise("repeated").alias("reading"))
    marks = pr.markers_seen(df, lc.DATE_COLUMNS).agg(F.count("*").cast("string").alias("reading"))
    observed = (
        one.select(F.explode(F.create_map(F.lit("IO-ROWS"), F.col("rows"), F.lit("IO-TYPES"), F.col("types"), F.lit("IO-NAMES"), F.lit(str(held)))).alias("id", "reading"))
        .unionByName(ids.select(F.lit("IO-IDS").alias("id"), "reading"))
        .unionByName(marks.select(F.lit("IO-MARKERS").alias("id"), "reading"))
    )
    return checks.declared_vs_observed(declared, observed)


_CONTROLLED = list(_PRE)


@query("h23_control_pair", sql_with("o_six", body=f"""
SELECT id, severity, 'PASS' AS good_status, status AS bad_status, false AS cried_wolf, status IN ('FAIL', 'FLAGGED') AS separates, NOT (severity = 'FLAGGED' AND status = 'FAIL') AS severity_kept
FROM ({_pre_body(_CONTROLLED)}) b"""))
def h23(spark, sf):
    bad = contracts(spark, sf)
    plain = F.col("row_index").cast("string")
    # the same table with every doubtful cell replaced by a sound one
    good = bad.withColumns(
        {c: F.lit(f"{year}-01-31") for c, year in zip(lc.DATE_COLUMNS, (2010, 2010, 2020, 2021, 2030))} | {"DaBetrag": F.lit("100000"), "bausparsumme_teuro": F.lit("100"), "guthaben": F.lit("20000")}
        | {"BSV": plain, "tariff_amount": F.lit("0,4")}
    )
    return checks.control_pair(checks.preconditions(good, DAY, only=_CONTROLLED), checks.evaluate(checked(spark, sf), bad.columns, _CONTROLLED))
