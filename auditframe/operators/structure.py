"""Structure checks on raw ledger objects.

Every object arrives as one row ``(ledger_id, pos, idx, raw)``: ``pos`` is its place in the received list, ``idx`` its
place among the items that are objects, ``raw`` its JSON text.  All rules of one object kind are columns of a single
narrow projection, so the whole group of checks is one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.functions.text import has_content, is_claim_id, is_id_list, is_iso_date
from auditframe.operators import vocabulary as voc

FINDING = ["ledger_id", "rule_id", "severity", "message", "claim_id"]
BLOCKING = "RELEASE_BLOCKING"

REQUIRED = {
    "runs": voc.RUN_REQUIRED,
    "claims": voc.CLAIM_REQUIRED,
    "sources": voc.SOURCE_REQUIRED,
    "evidence": voc.EVIDENCE_REQUIRED,
}
KNOWN = {
    "claims": voc.CLAIM_REQUIRED + voc.CLAIM_OPTIONAL,
    "sources": voc.SOURCE_REQUIRED + voc.SOURCE_OPTIONAL,
    "evidence": voc.EVIDENCE_REQUIRED,
}
LABEL = {"runs": "Run", "claims": "Claim", "sources": "Source", "evidence": "Evidence"}
ID_FIELD = {"claims": "claim_id", "sources": "source_id", "evidence": "evidence_id"}

VOCABULARY = {
    "claims": {
        "claim_type": voc.CLAIM_TYPES,
        "claim_status": voc.CLAIM_STATUSES,
        "evidence_status": voc.EVIDENCE_STATUSES,
        "severity_if_wrong": voc.SEVERITIES,
    },
    "sources": {"kind": voc.SOURCE_KINDS, "access": voc.ACCESS_VALUES},
}

# What each field must be, worded as in the findings.
SHAPES = {
    "runs": {
        "run_id": "a non-empty string",
        "as_of_date": "an ISO date",
        "document_manifest": "a list of strings",
        "requested_output_formats": "a list of strings",
        "strict_blind_audit_required": "boolean",
        "model_id": "a non-empty string or null",
        "inherited_from_run": "a non-empty string or null",
    },
    "claims": {
        "normalised_claim": "a non-empty string",
        "conditions": "a list of strings",
        "blocked_by": "a list of strings",
        "appears_in": "a list of strings",
        "class": "a list of strings",
        "last_checked": "an ISO date or null",
        "last_successfully_verified": "an ISO date or null",
        "time_sensitive": "boolean",
        "reopened": "boolean",
        "source_statement": "a non-empty string",
        "derivation_rule": "a non-empty string or null",
        "qualification": "a non-empty string",
    },
    "sources": {
        "identifier": "a non-empty string",
        "title": "a non-empty string",
        "version_label": "a string or null",
        "locator": "a string or null",
        "version_date": "an ISO date or null",
        "sufficient_for": "a list of strings",
        "evidence_level": "a positive integer or null",
        "provenance_note": "a non-empty string",
    },
    "evidence": {
        "retrieved_at": "an ISO date",
        "fragment": "a string or null",
        "extract": "a string or null",
        "search_scope": "a string or null",
        "supersession_checked": "boolean",
        "superseded_by": "a list of strings",
        "queries_attempted": "a list of strings",
        "agent": "a non-empty string",
    },
}


class Raw:
    """Accessors to one parsed object; absent, null and wrongly typed fields stay apart."""

    def __init__(self, variant: Column):
        self.variant = variant

    def get(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self.variant, f"$.{name}", kind)

    def field(self, name: str) -> Column:
        return self.get(name, "variant")

    def type(self, name: str) -> Column:
        return F.schema_of_variant(self.field(name))

    def present(self, name: str) -> Column:
        return self.field(name).isNotNull()

    def is_null(self, name: str) -> Column:
        return self.type(name) == "VOID"

    def string(self, name: str) -> Column:
        """The text of a string field; null for anything else."""
        return F.when(self.type(name) == "STRING", self.get(name, "string"))

    def strings(self, name: str) -> Column:
        """The items of a list made of strings only; null for anything else."""
        items = self.get(name, "array<variant>")
        all_text = F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False)))
        texts = self.get(name, "array<string>")
        return F.when(F.coalesce(self.type(name).startswith("ARRAY"), F.lit(False)) & all_text, texts)

    def shown(self, name: str) -> Column:
        """Text of any value for messages: None, True/False, plain text, numbers, JSON for nested values."""
        kind = self.type(name)
        text = self.get(name, "string")
        return (
            F.when(kind.isNull() | (kind == "VOID"), "None")
            .when(kind == "BOOLEAN", F.initcap(text))
            .when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.to_json(self.field(name)))
            .otherwise(text)
        )


class Taken(Raw):
    """``Raw`` over the columns of ``taken``: fields and their types are there already and not sought again by every rule."""

    def __init__(self):
        super().__init__(F.col("v"))

    def get(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self.field(name), "$", kind)

    def field(self, name: str) -> Column:
        return F.col(f"v.{name}")

    def type(self, name: str) -> Column:
        return F.col(f"type_{name}")

    def string(self, name: str) -> Column:
        return F.when(self.type(name) == "STRING", F.col(f"text.{name}"))


def parsed(objects: DataFrame) -> DataFrame:
    return objects.withColumn("v", F.try_parse_json("raw"))


def taken(objects: DataFrame, names: list[str]) -> DataFrame:
    """Objects with the named fields taken out of their text once.

    ``v`` holds them as variants, ``type_<name>`` the type of each, ``text`` their texts: reading a string out of a variant builds a
    cast for every value, the JSON reader does not.
    """
    shape = {kind: ", ".join(f"`{n}` {kind}" for n in names) for kind in ("variant", "string")}
    fields = parsed(objects).withColumns({"v": F.try_variant_get("v", "$", f"struct<{shape['variant']}>"), "text": F.from_json("raw", shape["string"])})
    return fields.withColumns({f"type_{n}": F.schema_of_variant(f"v.{n}") for n in names})


def _finding(message: Column, claim_id: Column | None = None, rule: str = "V-000") -> Column:
    location = F.lit(None).cast("string") if claim_id is None else claim_id
    return F.struct(
        F.lit(rule).alias("rule_id"), F.lit(BLOCKING).alias("severity"), message.alias("message"), location.alias("claim_id")
    )


def _emit(objects: DataFrame, findings: list[Column] | Column) -> DataFrame:
    """Explode the findings of each object; rows without findings vanish.

    A list is computed in a projection of its own, which is compiled; inside a generator or a higher-order function it would be interpreted.
    """
    if isinstance(findings, list):
        listed = objects.select("ledger_id", F.array(*findings).alias("found"))
        exploded = listed.select("ledger_id", F.explode_outer("found").alias("f")).filter(F.col("f").isNotNull())
    else:
        exploded = objects.select("ledger_id", F.explode(findings).alias("f"))
    return exploded.select("ledger_id", "f.rule_id", "f.severity", "f.message", "f.claim_id")


def _location(kind: str, raw: Raw) -> Column:
    return raw.string("claim_id") if kind == "claims" else F.lit(None).cast("string")


def _subject(kind: str, raw: Raw) -> Column:
    """``Claim C-1`` / ``Source SRC-1`` / ``Run`` in messages."""
    if kind == "runs":
        return F.lit("Run")
    return F.concat(F.lit(LABEL[kind] + " "), raw.shown(ID_FIELD[kind]))


def _at_index(kind: str) -> Column:
    if kind == "runs":
        return F.lit("Run")
    return F.concat(F.lit(LABEL[kind] + " at index "), F.col("idx").cast("string"))


def missing_fields(objects: DataFrame, kind: str) -> DataFrame:
    """One finding per required field an object lacks."""
    raw = Raw(F.col("v"))
    absent = F.array_except(F.array(*[F.lit(f) for f in REQUIRED[kind]]), F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>")))
    location = _location(kind, raw)
    where = _at_index(kind)
    found = F.transform(
        absent, lambda f: _finding(F.concat(where, F.lit(" is missing required field '"), f, F.lit("'.")), location)
    )
    return _emit(parsed(objects), found)


def unknown_fields(objects: DataFrame, kind: str) -> DataFrame:
    """One finding per field outside the known set; runs may carry anything."""
    if kind not in KNOWN:
        return _emit(parsed(objects), F.array().cast("array<struct<rule_id:string,severity:string,message:string,claim_id:string>>"))
    raw = Raw(F.col("v"))
    extra = F.array_except(F.json_object_keys("raw"), F.array(*[F.lit(f) for f in KNOWN[kind]]))
    location = _location(kind, raw)
    where = _at_index(kind) if kind == "claims" else _subject(kind, raw)
    found = F.transform(extra, lambda f: _finding(F.concat(where, F.lit(" has unknown field '"), f, F.lit("'.")), location))
    return _emit(parsed(objects), found)


def _doubtful(objects: DataFrame, fields: list[str], fine: Column) -> DataFrame:
    """``parsed``, but ``v`` is null where ``fine`` holds for ``words``, the texts of the fields.

    The JSON reader gives the texts for less than parsing costs.  Columns, not a filter: that would build the text again for each mention.
    """
    words = F.from_json("raw", ", ".join(f"`{f}` string" for f in fields))
    return objects.withColumn("words", words).withColumn("v", F.when(~F.coalesce(fine, F.lit(False)), F.try_parse_json("raw")))


def _in_vocabulary(fields: dict[str, list[str]], absent: bool = True) -> Column:
    """True where every field holds a word of its vocabulary (or is absent, if that is fine too); none of these words is the text of a number, a truth value or a
    nested value.  Names stand in a text as they are unless it has escapes, and such a text is never fine."""
    fine = ~F.col("raw").contains("\\")
    for field, values in fields.items():
        held = F.coalesce(F.col(f"words.{field}").isin(values), F.lit(False))
        fine = fine & (held | ~F.col("raw").contains(f'"{field}"') if absent else held)
    return fine


def check_vocab(objects: DataFrame, kind: str) -> DataFrame:
    """Values outside their fixed vocabulary (a value of another type is outside too)."""
    raw = Raw(F.col("v"))
    fields = VOCABULARY.get(kind, {}) | ({"retrieval_method": voc.RETRIEVAL_METHODS} if kind == "evidence" else {})
    location = _location(kind, raw)
    checks = []
    for field, values in VOCABULARY.get(kind, {}).items():
        allowed = F.coalesce(raw.string(field).isin(values), F.lit(False))
        text = F.concat(_subject(kind, raw), F.lit(f" has invalid {field}="), raw.shown(field), F.lit("."))
        checks.append(F.when(raw.present(field) & ~allowed, _finding(text, location)))
    if kind == "evidence":
        allowed = F.coalesce(raw.string("retrieval_method").isin(voc.RETRIEVAL_METHODS), F.lit(False))
        text = F.concat(_subject(kind, raw), F.lit(" has invalid retrieval_method="), raw.shown("retrieval_method"), F.lit("."))
        checks.append(F.when(has_content(raw.string("evidence_id")) & ~allowed, _finding(text)))
    return _emit(_doubtful(objects, list(fields), _in_vocabulary(fields, absent=kind != "evidence")), checks)


def check_stances(edges: DataFrame) -> DataFrame:
    """Stance vocabulary on EVIDENCED_BY edges whose endpoints are filled in."""
    raw = Raw(F.col("v"))
    ends = has_content(raw.string("from")) & has_content(raw.string("to"))
    allowed = F.coalesce(raw.string("stance").isin(voc.STANCES), F.lit(False))
    bad = F.coalesce(raw.string("type") == "EVIDENCED_BY", F.lit(False)) & ends & ~allowed
    text = F.concat(F.lit("EVIDENCED_BY edge has invalid stance="), raw.shown("stance"), F.lit("."))
    fine = F.coalesce(F.col("words.stance").isin(voc.STANCES), F.lit(False)) | (F.col("words.type") != "EVIDENCED_BY")
    return _emit(_doubtful(edges, ["type", "stance"], fine), [F.when(bad, _finding(text, raw.string("from")))])


def _shape_holds(raw: Raw, field: str, shape: str, list_items_filled: bool) -> Column:
    nullable = shape.endswith(" or null")
    base = shape.removesuffix(" or null")
    if base == "a non-empty string":
        holds = has_content(raw.string(field))
    elif base == "a string":
        holds = raw.type(field) == "STRING"
    elif base == "boolean":
        holds = raw.type(field) == "BOOLEAN"
    elif base == "an ISO date":
        holds = is_iso_date(raw.string(field))
    elif base == "a list of strings":
        items = raw.strings(field)
        holds = F.coalesce(F.forall(items, has_content), F.lit(False)) if list_items_filled else items.isNotNull()
    elif base == "a positive integer":
        number = raw.get(field, "bigint")
        holds = (raw.type(field) == "BIGINT") & (number >= 1)
    else:
        raise ValueError(f"unknown shape {shape!r}")
    holds = F.coalesce(holds, F.lit(False))
    return holds | raw.is_null(field) if nullable else holds


def check_types(objects: DataFrame, kind: str) -> DataFrame:
    """Field shapes: text, booleans, dates, lists, the protocol version and object identifiers."""
    raw = Taken()
    location = _location(kind, raw)
    checks = []
    if kind == "claims":
        bad_id = raw.present("claim_id") & ~is_claim_id(raw.string("claim_id"))
        checks.append(F.when(bad_id, _finding(F.concat(_at_index(kind), F.lit(" has an invalid 'claim_id'.")), location)))
    elif kind in ID_FIELD:
        name = ID_FIELD[kind]
        text = F.concat(_at_index(kind), F.lit(f" has an invalid '{name}'."))
        checks.append(F.when(~has_content(raw.string(name)), _finding(text)))
    for field, shape in SHAPES[kind].items():
        holds = _shape_holds(raw, field, shape, list_items_filled=field == "sufficient_for")
        text = F.concat(_subject(kind, raw), F.lit(f" field '{field}' must be {shape}."))
        checks.append(F.when(raw.present(field) & ~holds, _finding(text, location)))
    if kind in ("runs", "evidence"):
        right = F.coalesce(raw.string("prompt_version") == voc.PROTOCOL_VERSION, F.lit(False))
        text = F.concat(_subject(kind, raw), F.lit(f" field 'prompt_version' must equal '{voc.PROTOCOL_VERSION}'."))
        checks.append(F.when(raw.present("prompt_version") & ~right, _finding(text)))
    names = [*SHAPES[kind], *([ID_FIELD[kind]] if kind in ID_FIELD else []), *(["prompt_version"] if kind in ("runs", "evidence") else [])]
    return _emit(taken(objects, names), checks)


def check_run_maps(runs: DataFrame) -> DataFrame:
    """Capability names and values, gate names and states."""
    raw = Raw(F.col("v"))
    out = []
    for field in ("capabilities", "gates"):
        wrong = raw.present(field) & ~raw.is_null(field) & ~raw.type(field).startswith("OBJECT")
        text = F.lit(f"Run field '{field}' must be an object.")
        out.append(_emit(parsed(runs), [F.when(wrong, _finding(text))]))
    entries = parsed(runs).select(
        "ledger_id", F.explode(F.try_variant_get("v", "$.capabilities", "map<string,variant>")).alias("name", "value")
    )
    known = F.col("name").isin(voc.CAPABILITIES)
    out.append(
        _emit(
            entries,
            [
                F.when(~known, _finding(F.concat(F.lit("Unknown capability field '"), F.col("name"), F.lit("'.")))),
                F.when(
                    known & (F.schema_of_variant("value") != "BOOLEAN"),
                    _finding(F.concat(F.lit("Capability '"), F.col("name"), F.lit("' must be boolean."))),
                ),
            ],
        )
    )
    gates = parsed(runs).select(
        "ledger_id", F.explode(F.try_variant_get("v", "$.gates", "map<string,variant>")).alias("name", "value")
    )
    kind = F.schema_of_variant("value")
    state = F.when(kind == "STRING", F.try_variant_get("value", "$", "string"))
    shown = F.when(kind == "VOID", "None").when(kind == "STRING", state).otherwise(F.to_json("value"))
    bad = ~has_content(F.col("name")) | ~F.coalesce(state.isin(voc.GATE_STATES), F.lit(False))
    text = F.concat(F.lit("Run gate '"), F.col("name"), F.lit("' has invalid status="), shown, F.lit("."))
    out.append(_emit(gates, [F.when(bad, _finding(text))]))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def check_id_list(claims: DataFrame) -> DataFrame:
    """``depends_on`` must be a list of distinct, well-formed claim identifiers."""
    raw = Raw(F.col("v"))
    text = F.concat(_subject("claims", raw), F.lit(" field 'depends_on' must be a unique list of Claim IDs."))
    bad = raw.present("depends_on") & ~is_id_list(raw.strings("depends_on"))
    return _emit(parsed(claims), [F.when(bad, _finding(text, _location("claims", raw)))])


def check_decision_conditions(claims: DataFrame) -> DataFrame:
    """``decision_conditions`` must hold objects with exactly ``decision_id`` and ``equals``, both filled in."""
    raw = Raw(F.col("v"))
    items = F.try_variant_get("v", "$.decision_conditions", "array<variant>")

    def well_formed(item: Column) -> Column:
        entry = Raw(item)
        names = F.array_sort(F.json_object_keys(F.to_json(item)))
        return F.coalesce(
            (names == F.array(F.lit("decision_id"), F.lit("equals")))
            & has_content(entry.string("decision_id"))
            & has_content(entry.string("equals")),
            F.lit(False),
        )

    is_list = F.coalesce(raw.type("decision_conditions").startswith("ARRAY"), F.lit(False))
    bad = raw.present("decision_conditions") & ~(is_list & F.coalesce(F.forall(items, well_formed), F.lit(False)))
    text = F.concat(_subject("claims", raw), F.lit(" field 'decision_conditions' is malformed."))
    return _emit(parsed(claims), [F.when(bad, _finding(text, _location("claims", raw)))])


def check_nonempty(ledgers: DataFrame, claims: DataFrame) -> DataFrame:
    """Ledgers whose claim list is empty."""
    empty = ledgers.join(claims.select("ledger_id").distinct(), "ledger_id", "left_anti")
    return _emit(empty, [_finding(F.lit("Ledger field 'claims' must not be empty."))])


def conditional_required(df: DataFrame, condition: Column, requirement: Column, message: Column) -> DataFrame:
    """Rows that meet ``condition`` but not ``requirement``; an unknown requirement counts as not met."""
    violated = F.coalesce(condition, F.lit(False)) & ~F.coalesce(requirement, F.lit(False))
    return _emit(df.filter(violated), [_finding(message, F.col("claim_id") if "claim_id" in df.columns else None)])


def artifact_coverage(requested: DataFrame, manifest: DataFrame) -> DataFrame:
    """Requested outputs ``(ledger_id, name)`` without a PRODUCED artifact ``(ledger_id, name, status)``."""
    produced = manifest.filter(F.col("status") == "PRODUCED").select("ledger_id", "name")
    missing = requested.select("ledger_id", "name").distinct().join(produced, ["ledger_id", "name"], "left_anti")
    return _emit(missing, [_finding(F.concat(F.lit("Requested output "), F.col("name"), F.lit(" was not produced.")), rule="V-026")])


def structure_findings(objects: dict[str, DataFrame]) -> list[DataFrame]:
    """All structure checks of a set of exploded ledgers."""
    out = []
    for kind in ("runs", "claims", "sources", "evidence"):
        out += [missing_fields(objects[kind], kind), check_types(objects[kind], kind)]
        if kind in KNOWN:
            out.append(unknown_fields(objects[kind], kind))
        if kind != "runs":
            out.append(check_vocab(objects[kind], kind))
    out += [
        check_run_maps(objects["runs"]),
        check_stances(objects["edges"]),
        check_id_list(objects["claims"]),
        check_decision_conditions(objects["claims"]),
    ]
    return out
