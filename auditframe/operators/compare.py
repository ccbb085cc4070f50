"""Comparison of checkpoints, tables and ordered name vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from auditframe.functions.canonical import canonical_cell, kind_of
from auditframe.operators.ordering import rank_within

# --- checkpoints: (unit, object, rows, cols, colnames, digest, canonicalisation) ---------------------------------------


def inputs_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """Input bindings (name, bytes, sha256) held by one side only, and by both."""
    keys = ["name", "bytes", "sha256"]
    left = a.select(*keys).distinct().withColumn("in_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, keys, "full_outer")
    only_a, only_b = F.count_if(F.col("in_b").isNull()), F.count_if(F.col("in_a").isNull())
    return both.agg(only_a.alias("only_a"), only_b.alias("only_b")).select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("inputs_match"))


def object_keys_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every object key with the side(s) that hold it."""
    left = a.select("unit", "object").distinct().withColumn("l", F.lit(True))
    right = b.select("unit", "object").distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("r").isNull(), "only_source").when(F.col("l").isNull(), "only_target").otherwise("common")
    return left.join(right, ["unit", "object"], "full_outer").select("unit", "object", side.alias("side"))


def digest_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Common objects and whether digest and canonicalisation both agree."""
    left = a.select("unit", "object", F.col("digest").alias("digest_a"), F.col("canonicalisation").alias("canon_a"))
    right = b.select("unit", "object", F.col("digest").alias("digest_b"), F.col("canonicalisation").alias("canon_b"))
    agree = (F.col("digest_a") == F.col("digest_b")) & (F.col("canon_a") == F.col("canon_b"))
    return left.join(right, ["unit", "object"]).select("unit", "object", agree.alias("agree"))


def localise(a: DataFrame, b: DataFrame, probes_a: DataFrame, probes_b: DataFrame) -> DataFrame:
    """Where differing objects differ: shape, column names, coverage, and probe fields.

    One row per finding (unit, object, what, item, source, target).  Probes are (unit, object, selection_rule, fields).
    """
    differing = digest_compare(a, b).filter("NOT agree").select("unit", "object")
    x = a.join(differing, ["unit", "object"], "left_semi").alias("x")
    y = b.join(differing, ["unit", "object"], "left_semi").alias("y")
    pairs = x.join(y, ["unit", "object"])
    shape = ["rows", "cols", "colnames", "null_count", "min", "max"]
    texts = F.array(*[F.struct(F.lit(s).alias("item"), F.col(f"x.{s}").cast("string").alias("source"), F.col(f"y.{s}").cast("string").alias("target")) for s in shape])
    shapes = pairs.select("unit", "object", F.explode(texts).alias("t")).select("unit", "object", F.lit("shape").alias("what"), "t.item", "t.source", "t.target")

    def cells(df: DataFrame, name: str) -> DataFrame:
        kept = df.join(differing, ["unit", "object"], "left_semi")
        return kept.select("unit", "object", "selection_rule", F.explode("fields").alias("field", name))

    fields = cells(probes_a, "source").join(cells(probes_b, "target"), ["unit", "object", "selection_rule", "field"], "full_outer")
    probed = fields.select("unit", "object", F.lit("probe").alias("what"), F.concat_ws(" ", "selection_rule", "field").alias("item"), "source", "target")
    return shapes.unionByName(probed).filter(~F.col("source").eqNullSafe(F.col("target")))


def compare_outcome(inputs: DataFrame, keys: DataFrame, digests: DataFrame) -> DataFrame:
    """0 all agree, 1 something diverges, 2 not comparable; counts of everything that led there."""
    k = keys.agg(F.count_if(F.col("side") == "only_source").alias("only_source"), F.count_if(F.col("side") == "only_target").alias("only_target"))
    d = digests.agg(F.count_if("agree").alias("agree"), F.count_if(~F.col("agree")).alias("differ"))
    row = k.select("*", inputs.select("inputs_match").scalar().alias("inputs_match"), d.select(F.struct("*")).scalar().alias("d"))
    incomparable = ~F.col("inputs_match") | (F.col("only_source") > 0) | (F.col("only_target") > 0)
    outcome = F.when(incomparable, 2).when(F.col("d.differ") > 0, 1).otherwise(0)
    return row.select("inputs_match", "only_source", "only_target", "d.agree", "d.differ", outcome.alias("outcome"))


def compare_many(source: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Per target: objects agreeing, differing, missing and unexpected against one source."""
    parts = []
    for name, target in targets.items():
        left = source.select("unit", "object", F.col("digest").alias("a"), F.col("canonicalisation").alias("ca"))
        right = target.select("unit", "object", F.col("digest").alias("b"), F.col("canonicalisation").alias("cb"))
        both = left.join(right, ["unit", "object"], "full_outer")
        same = (F.col("a") == F.col("b")) & (F.col("ca") == F.col("cb"))
        parts.append(
            both.agg(
                F.count_if(same).alias("agree"), F.count_if(~same).alias("differ"), F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("unexpected")
            ).select(F.lit(name).alias("target"), "*")
        )
    clean = (F.col("differ") == 0) & (F.col("missing") == 0) & (F.col("unexpected") == 0) & (F.col("agree") > 0)
    return reduce(lambda x, y: x.unionByName(y), parts).withColumn("agrees", clean)


def table_diff(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change, field, source, target): added and removed rows, and every changed cell as canonical text.

    Rows are matched by key and compared natively; only rows that differ are rendered as text.
    """
    values = [c for c in a.columns if c not in keys and c in b.columns]
    kinds = {f.name: kind_of(f.dataType) for f in a.schema.fields}
    left = a.select(*keys, F.struct(*values).alias("x"))
    right = b.select(*keys, F.struct(*values).alias("y"))
    both = left.join(right, keys, "full_outer")
    change = F.when(F.col("y").isNull(), "removed").when(F.col("x").isNull(), "added").otherwise("changed")
    changed = both.withColumn("change", change).filter((F.col("change") != "changed") | ~F.col("x").eqNullSafe(F.col("y")))
    texts = changed.select(
        *keys, "change", *[canonical_cell(F.col(f"x.{v}"), kinds[v]).alias(f"x__{v}") for v in values], *[canonical_cell(F.col(f"y.{v}"), kinds[v]).alias(f"y__{v}") for v in values]
    )
    cells = F.array(*[F.struct(F.lit(v).alias("field"), F.col(f"x__{v}").alias("source"), F.col(f"y__{v}").alias("target")) for v in values])
    long = texts.select(*keys, "change", F.explode(cells).alias("c")).select(*keys, "change", "c.field", "c.source", "c.target")
    whole = texts.filter("change != 'changed'").select(*keys, "change", *[F.lit(None).cast("string").alias(n) for n in ("field", "source", "target")])
    return long.filter("change = 'changed' AND source != target").unionByName(whole)


def compare_abort(a: DataFrame, b: DataFrame) -> DataFrame:
    """Abort records of two sides by run: agree only when code, row, column, value and completed rows all agree."""
    fields = ["abort_code", "row_index", "column", "raw_value", "rows_completed"]
    left = a.select("run_id", F.struct(*fields).alias("x"))
    right = b.select("run_id", F.struct(*fields).alias("y"))
    both = left.join(right, "run_id", "full_outer")
    differing = F.array_compact(F.array(*[F.when(~F.col(f"x.{f}").eqNullSafe(F.col(f"y.{f}")), F.lit(f)) for f in fields]))
    state = F.when(F.col("x").isNull() | F.col("y").isNull(), "one_side_only").when(F.size(differing) == 0, "agree").otherwise("differ")
    return both.select("run_id", state.alias("state"), F.when(state == "differ", F.array_join(differing, ",")).otherwise("").alias("differing"))


# --- ordered name vectors ----------------------------------------------------------------------------------------------


def compare_vectors(detected: DataFrame, declared: DataFrame, bindings: DataFrame) -> DataFrame:
    """(pair columns, n_detected, n_declared, only_detected, only_declared, state) for every bound pair.

    ``detected`` has (file, group, ordinal, field), ``declared`` (unit, constant, ordinal, value), ``bindings`` (file, group,
    unit, constant).  Vectors are compared place by place and member by member, never gathered into one list.
    """
    pair = ["file", "group", "unit", "constant"]
    left = rank_within(detected.select("file", "group", "ordinal", F.col("field").alias("v")), ["file", "group"], ["ordinal", "v"], "place")
    right = rank_within(declared.select("unit", "constant", "ordinal", F.col("value").alias("v")), ["unit", "constant"], ["ordinal", "v"], "place")
    lhs = bindings.join(left, ["file", "group"]).select(*pair, "place", "v")
    rhs = bindings.join(right, ["unit", "constant"]).select(*pair, "place", "v")
    places = lhs.withColumnRenamed("v", "a").join(rhs.withColumnRenamed("v", "b"), [*pair, "place"], "full_outer")
    by_place = places.groupBy(*pair).agg(
        F.count("a").alias("n_detected"), F.count("b").alias("n_declared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("misplaced")
    )
    members = (
        lhs.select(*pair, "v").distinct().withColumn("l", F.lit(1)).join(rhs.select(*pair, "v").distinct().withColumn("r", F.lit(1)), [*pair, "v"], "full_outer")
    )
    by_member = members.groupBy(*pair).agg(F.count_if(F.col("r").isNull()).alias("only_detected"), F.count_if(F.col("l").isNull()).alias("only_declared"))
    joined = bindings.join(by_place, pair, "left").join(by_member, pair, "left").na.fill(0, ["n_detected", "n_declared", "misplaced", "only_detected", "only_declared"])
    state = (
        F.when((F.col("n_detected") == 0) & (F.col("n_declared") == 0), "VACUOUS")
        .when(F.col("n_detected") == 0, "MISSING_DETECTED")
        .when(F.col("n_declared") == 0, "MISSING_DECLARED")
        .when(F.col("misplaced") == 0, "AGREE")
        .when((F.col("only_detected") == 0) & (F.col("only_declared") == 0), "SAME_VALUES_OTHER_ORDER")
        .otherwise("DIFFER")
    )
    return joined.select(*pair, "n_detected", "n_declared", "only_detected", "only_declared", state.alias("state"))


def uncovered(detected: DataFrame, declared: DataFrame, bindings: DataFrame, waivers: DataFrame) -> DataFrame:
    """Vectors no binding compares and no waiver names: (side, scope, name); waivers have the same columns."""
    seen = detected.select(F.lit("detected").alias("side"), F.col("file").alias("scope"), F.col("group").alias("name")).unionByName(
        declared.select(F.lit("declared").alias("side"), F.col("unit").alias("scope"), F.col("constant").alias("name"))
    )
    bound = bindings.select(F.lit("detected").alias("side"), F.col("file").alias("scope"), F.col("group").alias("name")).unionByName(
        bindings.select(F.lit("declared").alias("side"), F.col("unit").alias("scope"), F.col("constant").alias("name"))
    )
    keys = ["side", "scope", "name"]
    return seen.distinct().join(bound, keys, "left_anti").join(waivers, keys, "left_anti")


def vector_gate(compared: DataFrame, left_over: DataFrame, bad_ordinals: Column | None = None) -> DataFrame:
    """0 all pairs agree, 1 a pair diverges, 2 the gate established nothing (no pair, a vacuous pair, uncovered vectors)."""
    row = compared.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("state") == "VACUOUS").alias("vacuous"), F.count_if(~F.col("state").isin("AGREE", "VACUOUS")).alias("divergent")
    )
    row = row.withColumn("uncovered", left_over.agg(F.count("*")).scalar())
    broken = F.lit(False) if bad_ordinals is None else bad_ordinals
    outcome = F.when(broken | (F.col("pairs") == 0) | (F.col("vacuous") > 0) | (F.col("uncovered") > 0), 2).when(F.col("divergent") > 0, 1).otherwise(0)
    return row.select("pairs", "vacuous", "divergent", "uncovered", outcome.alias("outcome"))


def field_groups(usage: DataFrame, objects: list[str] | None = None, suffix: str = "_fields") -> DataFrame:
    """(file, group, ordinal, field): the sorted distinct fields used per object."""
    named = usage.select(F.trim("file").alias("file"), F.trim("object").alias("object"), F.trim("field").alias("field")).filter("object != '' AND field != ''")
    if objects is not None:
        named = named.filter(F.col("object").isin(objects))
    ranked = rank_within(named.distinct(), ["file", "object"], ["field"], "ordinal")
    return ranked.select("file", F.concat("object", F.lit(suffix)).alias("group"), "ordinal", "field")


def anchor_positions(layout: DataFrame, anchors: DataFrame) -> DataFrame:
    """Declared (object, field) probes against a positional layout (object, field, position)."""
    objects = layout.groupBy("object").agg(F.count("*").alias("n_fields"))
    places = layout.groupBy("object", "field").agg(F.min("position").alias("position"))
    found = anchors.join(objects, "object", "left").join(places, ["object", "field"], "left")
    state = F.when(F.col("n_fields").isNull(), "OBJECT_ABSENT").when(F.col("position").isNull(), "FIELD_ABSENT").otherwise("FOUND")
    return found.select("object", "field", "position", F.coalesce("n_fields", F.lit(0)).cast("bigint").alias("n_fields"), state.alias("state"))
