"""Ledger JSON files to object tables and typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.functions.text import is_id_list
from auditframe.operators.structure import BLOCKING, Raw, _emit, _finding, parsed
from auditframe.session import LARGE_ROWS, cut_lineage

LIST_FIELDS = ["claims", "sources", "evidence", "edges"]
ITEM_LABEL = {"claims": "Claim", "sources": "Sources", "evidence": "Evidence", "edges": "Edges"}


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """One row per ledger file: ``(ledger_id, state, v)``; state is ``ok``, ``not_object`` or ``unreadable``.

    Nothing is stored; what reads the ledgers more than once stores them first.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("ledger_id"), F.col("value").alias("raw"))
    return parsed_state(text)


def ledger_state(ledgers: DataFrame) -> DataFrame:
    """Ledgers ``(ledger_id, raw)`` as ``read_ledger`` gives them, parsed once: every later table reads the stored binary form."""
    return stored(parsed_state(ledgers))


def stored(ledgers: DataFrame) -> DataFrame:
    return cut_lineage(ledgers, LARGE_ROWS)


def parsed_state(ledgers: DataFrame) -> DataFrame:
    opening = F.substring(F.ltrim(F.regexp_replace("raw", r"\A\s+", "")), 1, 1)
    state = F.when(F.col("v").isNull(), "unreadable").when(opening == "{", "ok").otherwise("not_object")
    return ledgers.select("ledger_id", "raw", F.try_parse_json("raw").alias("v")).select("ledger_id", state.alias("state"), "v")


def root_findings(ledgers: DataFrame) -> DataFrame:
    """Findings about the ledger itself: root, run object and list-typed fields."""
    bad_root = ledgers.filter("state = 'not_object'")
    unreadable = ledgers.filter("state = 'unreadable'")
    raw = Raw(F.col("v"))

    def absent(field: str) -> Column:
        return ~raw.present(field) | F.is_variant_null(raw.field(field))

    def not_list(field: str) -> Column:
        return F.try_variant_get("v", f"$.{field}", "array<variant>").isNull()

    checks = [
        F.when(
            ~F.coalesce(raw.type("run").startswith("OBJECT"), F.lit(False)), _finding(F.lit("Ledger field 'run' must be an object."))
        ),
        F.when(not_list("claims"), _finding(F.lit("Ledger field 'claims' must be a list."))),
    ]
    for field in LIST_FIELDS[1:]:
        checks.append(
            F.when(~absent(field) & not_list(field), _finding(F.lit(f"Ledger field '{field}' must be a list.")))
        )
    return (
        _emit(bad_root, [_finding(F.lit("Ledger root must be an object."))])
        .unionByName(_emit(unreadable, [_finding(F.lit("Ledger text is not readable JSON."))]))
        .unionByName(_emit(ledgers.filter("state = 'ok'"), checks))
    )


def explode_ledger(ledgers: DataFrame) -> dict[str, DataFrame]:
    """Object tables of all ledgers plus ``item_findings`` for list items that are not objects.

    ``idx`` counts only the objects of a list, ``pos`` all of its items.
    """
    good = ledgers.filter("state = 'ok'")
    out = {
        "runs": good.select(
            "ledger_id", F.lit(0).alias("pos"), F.lit(0).alias("idx"), F.to_json(F.try_variant_get("v", "$.run", "variant")).alias("raw")
        ).filter(F.json_object_keys("raw").isNotNull())
    }
    # one pass over the ledgers; whatever comes after reads rows of one item
    lists = good.select("ledger_id", *[_texts(field).alias(field) for field in LIST_FIELDS])
    items = cut_lineage(lists.select("ledger_id", F.explode(F.concat(*[_items(field) for field in LIST_FIELDS])).alias("x")).select("ledger_id", "x.*"))
    findings = None
    for field in LIST_FIELDS:
        own = items.filter(F.col("field") == field)
        out[field] = own.filter("idx IS NOT NULL").select("ledger_id", "pos", "idx", "raw")
        text = F.concat(F.lit(ITEM_LABEL[field] + (" at index " if field == "claims" else " item at index ")), F.col("pos").cast("string"), F.lit(" must be an object."))
        part = _emit(own.filter("idx IS NULL").select("ledger_id", "pos"), [_finding(text)])
        findings = part if findings is None else findings.unionByName(part)
    out["item_findings"] = findings
    return out


def _texts(field: str) -> Column:
    """(pos, raw) of every item of a list; raw is null for items that are not objects."""
    texts = F.transform(F.try_variant_get("v", f"$.{field}", "array<variant>"), lambda x: F.to_json(x))
    return F.transform(texts, lambda x, i: F.struct(i.alias("pos"), F.when(x.startswith("{"), x).alias("raw")))


def _items(field: str) -> Column:
    """(field, pos, idx, raw) of every item of a list of ``_texts``; idx is null for items that are not objects."""
    listed = F.coalesce(F.col(field), F.array().cast("array<struct<pos:int,raw:string>>"))
    item = lambda x, idx: F.struct(F.lit(field).alias("field"), x["pos"].alias("pos"), idx.cast("int").alias("idx"), x["raw"].alias("raw"))
    objects = F.transform(F.filter(listed, lambda x: x["raw"].isNotNull()), item)
    return F.concat(objects, F.transform(F.filter(listed, lambda x: x["raw"].isNull()), lambda x: item(x, F.lit(None))))


def typed_claims(objects: DataFrame) -> DataFrame:
    raw = Raw(F.col("v"))
    deps = raw.strings("depends_on")
    return parsed(objects).select(
        "ledger_id",
        "pos",
        raw.string("claim_id").alias("claim_id"),
        raw.shown("claim_id").alias("claim_shown"),
        raw.string("claim_type").alias("claim_type"),
        raw.string("claim_status").alias("claim_status"),
        raw.string("evidence_status").alias("evidence_status"),
        F.when(is_id_list(deps), deps).alias("depends_on"),
        raw.string("derivation_rule").alias("derivation_rule"),
        raw.string("qualification").alias("qualification"),
    )


def typed_sources(objects: DataFrame) -> DataFrame:
    raw = Raw(F.col("v"))
    return parsed(objects).select("ledger_id", "pos", raw.string("source_id").alias("source_id"))


def typed_evidence(objects: DataFrame) -> DataFrame:
    raw = Raw(F.col("v"))
    filled = raw.present("source_id") & ~raw.is_null("source_id")
    return parsed(objects).select(
        "ledger_id",
        "pos",
        raw.string("evidence_id").alias("evidence_id"),
        raw.string("source_id").alias("source_id"),
        F.when(filled, raw.shown("source_id")).alias("source_shown"),
        raw.string("retrieval_method").alias("retrieval_method"),
        raw.present("stance").alias("has_stance"),
    )


def typed_edges(objects: DataFrame) -> DataFrame:
    raw = Raw(F.col("v"))
    return parsed(objects).select(
        "ledger_id",
        "pos",
        raw.string("from").alias("src"),
        raw.string("to").alias("dst"),
        raw.string("type").alias("type"),
        raw.string("stance").alias("stance"),
    )


__all__ = ["BLOCKING", "explode_ledger", "read_ledger", "root_findings", "typed_claims", "typed_edges", "typed_evidence", "typed_sources"]
