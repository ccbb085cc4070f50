"""Pattern scans over text tables, line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Fixed patterns of the scan and the line that must set off at least MIN_FIRING of them.
PATTERNS = {
    "assignment arrow": r"<-",
    "percent operator": r"%>%|%in%|%\|\|%",
    "apply/bind call": r"\b(sapply|lapply|vapply|mapply|tapply|do\.call|rbind|cbind)\s*\(",
    "function literal": r"\bfunction\s*\(",
    "source API call": r"\b(read\.table|read_excel|read\.csv|splinefun|write\.xlsx|excel_sheets|datatable|formatStyle|styleEqual|pivot_longer|ggplot|aes)\s*\(",
    "source API idiom": r"\b(data\.frame|stringsAsFactors|na\.rm|check\.names|drop\s*=\s*FALSE)\b",
    "dollar column access": r"[A-Za-z_.\]]\$[A-Za-z_.`]",
    "package load": r"\blibrary\s*\(|\brequire(Namespace)?\s*\(",
    "double-bracket index": r"\[\[\s*\"?[A-Za-z0-9_.]+\"?\s*\]\]",
    "source literal token": r"\bNULL\b|(?<!Boolean\.)\bTRUE\b|(?<!Boolean\.)\bFALSE\b|\bNA_real_\b|\bNA_character_\b",
    "source builtin call": r"\bifelse\s*\(|\bpaste0?\s*\(|\bsprintf\s*\(|\bsuppressWarnings\s*\(",
    "for-in loop header": r"\bfor\s*\(\s*[A-Za-z_.]+\s+in\s+[^:\s)]",
}
CONTROL_LINE = "comfortable <- sapply(valuation_by_year, function(df) sum(df$DaBetrag, na.rm=TRUE))"
MIN_FIRING = 4
LINE_BREAK = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"


def _unicode(pattern: str) -> str:
    """Word boundaries and character classes over all of Unicode, as the patterns mean them."""
    return f"(?U){pattern}"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line) of every text, lines numbered from 1; a final line break opens no further line."""
    parts = F.split(text, LINE_BREAK)
    return docs.select(key, F.posexplode(parts).alias("i", "line"), F.size(parts).alias("n")).filter("line != '' OR i < n - 1").select(
        key, (F.col("i") + 1).alias("line_no"), "line"
    )


def scan_patterns(docs: DataFrame, key: str, text: str, patterns: dict[str, str] | None = None) -> DataFrame:
    """(key, line_no, pattern, token, context) for the first match of each pattern in each line.

    The pattern list is an expression of the projection, so a scan is one narrow pass whatever the size of the texts.
    """
    patterns = PATTERNS if patterns is None else patterns
    found = F.array_compact(
        F.array(
            *[
                F.when(F.col("line").rlike(_unicode(p)), F.struct(F.lit(name).alias("pattern"), F.regexp_extract("line", _unicode(f"({p})"), 1).alias("token")))
                for name, p in patterns.items()
            ]
        )
    )
    hits = lines(docs, key, text).select(key, "line_no", "line", F.explode(found).alias("h"))
    return hits.select(key, "line_no", "h.pattern", "h.token", F.trim("line").alias("context"))


def scan_gate(docs: DataFrame, text: str, patterns: dict[str, str] | None = None, needed: int = MIN_FIRING) -> DataFrame:
    """One row per control text: how many patterns fire and whether the detector counts as valid."""
    patterns = PATTERNS if patterns is None else patterns
    fired = F.array_compact(F.array(*[F.when(F.col(text).rlike(_unicode(p)), F.lit(name)) for name, p in patterns.items()]))
    return docs.select("*", F.size(fired).alias("fired"), (F.size(fired) >= needed).alias("valid"))


def scan_summary(docs: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """CLEAN or FAIL per text with its number of hits, clean texts included."""
    counted = hits.groupBy(key).agg(F.count("*").alias("hits"))
    return docs.select(key).join(counted, key, "left").select(
        key, F.when(F.col("hits") > 0, "FAIL").otherwise("CLEAN").alias("verdict"), F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits")
    )


def first_hits(hits: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """The hits of each text ranked in reading order; a report may ask for the first ones only (ranks are cut before the shuffle)."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("line_no", "pattern"))
    ranked = hits.withColumn("rank", rank)
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def phrase_probes(docs: DataFrame, key: str, text: str, probes: dict[str, list[str]]) -> DataFrame:
    """(key, code) where every pattern of a code matches the same text."""
    def all_match(patterns: list[str]) -> Column:
        hit = F.lit(True)
        for p in patterns:
            hit = hit & F.col(text).rlike(p)
        return hit

    matched = F.array_compact(F.array(*[F.when(all_match(ps), F.lit(code)) for code, ps in probes.items()]))
    return docs.select(key, F.explode(matched).alias("code"))


def section_coverage(docs: DataFrame, key: str, text: str, required: list[str], heading: str = r"(?m)^#+[ \t]*(.+?)[ \t]*$") -> DataFrame:
    """(key, missing) for every required section a report lacks."""
    names = F.regexp_extract_all(text, F.lit(heading), F.lit(1))
    return docs.select(key, F.explode(F.array_except(F.array(*[F.lit(r) for r in required]), names)).alias("missing"))
