"""I-Match fingerprints: hashes of the distinct terms of a text that lie in a band of inverse document frequency.

The lexicon is every word whose document frequency lies between ``LOW`` and ``HIGH`` of all documents.  Its size is bounded:
with d distinct words a document on average, at most d / ``LOW`` words reach the lower end, however large the corpus.  The part that
some sub-lexicon keeps, about 23 %, becomes a constant of the plan (an array of small buckets), so every text is fingerprinted
within its own row.
Sub-lexicons are random subsets of it, by a hash of the word: set j keeps a word with probability 2 ** -(FIRST_SCALE + j % SCALES), so
long and short documents both have sets that hold a few of their words.  A fingerprint is one hash a set, over the sorted
distinct words kept; two are as like as the share of equal hashes among the sets that keep a word of either.

Null texts are empty ones.  A text without any word of the lexicon takes the hash of its whole text for every set, so equal
texts have equal fingerprints and others differ.  The next document of rows that repeat a doc_id is the one of the next
greater id; if that id repeats too, its smallest text counts.  Null ids come before all others, as one id.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from auditframe.llm.common import cut_lineage, pick, table
from auditframe.operators.ordering import with_positions

LOW, HIGH = 0.001, 0.2
FIRST_SCALE, SCALES, SETS = 4, 6, 24
_SPACE = r"[\x20\x09-\x0D]+"
_NO_ID = -(1 << 63)


def words_of(text: Column) -> Column:
    """Distinct words of the text as 64-bit hashes, A-Z lower-cased; null for an empty text."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.transform(F.split(lowered, _SPACE), lambda w: F.xxhash64(w)))


def document_frequencies(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, df) over all documents."""
    return docs.select(F.explode(words_of(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))


def kept_by(word: str) -> Column:
    """How many of the sub-lexicons of the first scale, which hold those of the others, keep the word."""
    mask = (1 << FIRST_SCALE) - 1
    return sum((F.xxhash64(word, F.lit(k)).bitwiseAND(F.lit(mask)) == 0).cast("int") for k in range(SETS // SCALES))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> list[int]:
    """Hashes of the words of the band that some sub-lexicon keeps, in ascending order.

    In the mean these are 23 % of the band, which holds (mean distinct words a document) / ``low`` words at most.
    """
    n = docs.agg(F.count("*").alias("n")).first()["n"]
    band = document_frequencies(docs, text).filter(F.col("df").between(max(1.0, low * n), max(1.0, high * n)) & (kept_by("word") > 0))
    return sorted(r["word"] for r in band.filter(F.col("word") != F.xxhash64(F.lit(""))).select("word").collect())


def in_lexicon(words: list[int]) -> "callable":
    """A function of a word hash: whether it is in the lexicon, by a bucket of a few words."""
    buckets: list[list[int]] = [[] for _ in range(max(1, len(words) // 4))]
    for w in words:
        buckets[w % len(buckets)].append(w)
    constant = F.from_json(F.lit(json.dumps(buckets)), "array<array<bigint>>")  # folded once, when the plan is made
    return lambda w: F.array_contains(F.element_at(constant, (F.pmod(w, F.lit(len(buckets))) + 1).cast("int")), w)


def fingerprint(text: Column, member) -> Column:
    """One hash of eight hex digits a set, or empty where a set keeps no word of the text."""
    terms = F.sort_array(F.filter(words_of(text), member))

    def part(terms: Column, j: int) -> Column:
        mask = (1 << (FIRST_SCALE + j % SCALES)) - 1
        kept = F.filter(terms, lambda t: F.xxhash64(t, F.lit(j // SCALES)).bitwiseAND(F.lit(mask)) == 0)
        return F.when(F.size(kept) > 0, F.lpad(F.lower(F.hex(F.xxhash64(kept, F.lit(j)).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")).otherwise(F.lit(""))

    whole = F.array_repeat(F.substring(F.sha2(text, 256), 1, 8), SETS)
    # a one-element array passes the terms on by name, so that they are not worked out again for every set
    parts = F.element_at(F.transform(F.array(terms), lambda t: F.array(*[part(t, j) for j in range(SETS)])), 1)
    return F.element_at(F.transform(F.array(parts), lambda p: F.when(F.array_max(p) == "", whole).otherwise(p)), 1)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the sets that keep a word of either fingerprint (hashes joined by colons)."""
    pairs = F.arrays_zip(F.split(a, ":").alias("a"), F.split(b, ":").alias("b"))
    used = F.size(F.filter(pairs, lambda p: (p["a"] != "") | (p["b"] != "")))
    same = F.size(F.filter(pairs, lambda p: (p["a"] != "") & (p["a"] == p["b"])))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and the likeness to the next document's."""
    docs = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    member = in_lexicon(lexicon(docs))
    ids = docs.groupBy("key").agg(F.max(F.char_length("text")).alias("n"))
    placed = cut_lineage(with_positions(ids, [F.col("key")], name="at", total="all"))
    before = placed.select((F.col("at") % F.col("all") + 1).alias("at"), F.col("key").alias("for_key"), F.floor(F.col("n") / 2).alias("half"))
    links = cut_lineage(placed.select("at", "key").join(before, "at").select("key", "for_key", "half"))
    # what the edited texts need of the next one; the shuffle of the documents by id serves both joins
    heads = docs.join(links, "key").select(F.col("for_key").alias("key"), F.expr("substring(text, 1, int(half))").alias("head"))
    heads = heads.groupBy("key").agg(F.min("head").alias("head"))
    n = F.char_length("text")
    edited = F.concat(F.expr("substring(text, 1, int(char_length(text) - floor(char_length(text) / 2)))"), F.expr("substring(head, 1, int(floor(char_length(text) / 2)))"))
    rows = docs.join(heads, "key").withColumn("edited", edited)
    done = rows.select(
        "key", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        # one expression for both texts, so the plan holds the lexicon once
        F.transform(F.array("text", "edited"), lambda t: F.array_join(fingerprint(t, member), ":")).alias("prints"),
    )
    done = cut_lineage(done.select("key", "n_chars", "edited_sha256", F.get("prints", F.lit(0)).alias("fingerprint"), F.get("prints", F.lit(1)).alias("edited_fingerprint")))
    following = done.groupBy("key").agg(F.min("fingerprint").alias("next_fingerprint")).join(links, "key").select(F.col("for_key").alias("key"), "next_fingerprint")
    return done.join(following, "key").select(
        F.nullif("key", F.lit(_NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))


QUERIES = {"op5_imatch": op5_imatch}
ORACLES: dict[str, str] = {}
