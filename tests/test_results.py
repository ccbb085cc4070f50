"""Digests, vectors, layout detection and readers on small inputs."""

import hashlib

from pyspark.sql import functions as F

from auditframe.operators import compare as cp, digest as dg
from auditframe.operators.ordering import rank_within
from auditframe.sources import delimited as dl, layout as ly
from auditframe.sources.records import assemble_records


def sha(parts):
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def test_object_digest_matches_direct_hash(spark):
    rows = [("b\\", 2.5, True), (None, None, None), ("a\n", -0.0, False)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, s string, x double, f boolean").repartition(3)
    columns = {
        "n": ["2.00000000e+00", "0.00000000e+00", "1.00000000e+00"], "s": ["a\\n", "b\\\\", "NA"],
        "x": ["0.00000000e+00", "2.50000000e+00", "NA"], "f": ["false", "true", "NA"],
    }
    lines = [f"{c}={sha(['col', c, '3', *v])}" for c, v in columns.items()]
    row = dg.object_digest(df, ["s"]).first()
    assert row["digest"] == sha(["obj", "frame", "3", "4", *lines]) and row["rows"] == 3
    small = {r["column"]: r["digest"] for r in dg.block_digests(df, ["s"], block_rows=2).collect()}
    assert small == {c: sha(["col", c, "3", sha(v[:2]), sha(v[2:])]) for c, v in columns.items()}
    assert small == {r["column"]: r["digest"] for r in dg.block_digests(df.repartition(1), ["s"], block_rows=2).collect()}
    assert [r["n"] for r in dg.canonical_order(df, [("s", "desc")]).orderBy("position").collect()] == [0, 2, 1]


def tree(head, items, block):
    """Plain version of the hash tree."""
    while len(items) > block:
        items = [sha(items[i : i + block]) for i in range(0, len(items), block)]
    return sha([*head, *items])


def test_digest_trees_of_any_depth(spark):
    df = spark.range(700).select((F.col("id") * 37 % 700).alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"), F.concat(F.lit("v"), "id").alias("v")).repartition(5)
    rows = sorted((r["id"], r["key"], r["v"]) for r in df.collect())
    for block in (3, 26, 27, 699, 700):
        got = {r["column"]: r["digest"] for r in dg.block_digests(df, ["id"], block_rows=block).collect()}
        assert got["v"] == tree(["col", "v", "700"], [r[2] for r in rows], block), block
    entries = {r["entry"]: r for r in dg.tree_digests(df, ["id"], ["v"], F.col("key"), 4).collect()}
    for key in ("hot", "k1", "k49"):
        own = [r[2] for r in rows if r[1] == key]
        assert entries[key]["digest"] == tree(["col", "v", str(len(own))], own, 4) and entries[key]["rows"] == len(own)


def test_keyed_list_of_a_million_keys(spark):
    n = 1_000_000
    entries = spark.range(n).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("entry"), F.hex("id").alias("digest")).repartition(4)
    (row,) = dg.keyed_list_digest(entries).collect()
    lines = [f"{i:07d}={i:X}" for i in range(n)]
    blocks = [sha(lines[i : i + dg.BLOCK_ROWS]) for i in range(0, n, dg.BLOCK_ROWS)]
    assert (row["digest"], row["entries"]) == (sha(blocks), n)
    (few,) = dg.keyed_list_digest(entries.filter("entry < '0000003'")).collect()
    assert few["digest"] == sha(lines[:3])


def test_vector_states(spark):
    det = [("f", "same", 1, "a"), ("f", "same", 2, "b"), ("f", "order", 1, "a"), ("f", "order", 2, "b"), ("f", "cut", 1, "a"), ("f", "lone", 1, "a")]
    dec = [("u", "same", 1, "a"), ("u", "same", 2, "b"), ("u", "order", 1, "b"), ("u", "order", 2, "a"), ("u", "cut", 1, "a"), ("u", "cut", 2, "c"), ("u", "more", 1, "z")]
    detected = spark.createDataFrame(det, "file string, group string, ordinal int, field string")
    declared = spark.createDataFrame(dec, "unit string, constant string, ordinal int, value string")
    pairs = ["same", "order", "cut", "lone", "none"]
    bound = spark.createDataFrame([("f", p, "u", p) for p in pairs], "file string, group string, unit string, constant string")
    compared = cp.compare_vectors(detected, declared, bound)
    assert {r["group"]: r["state"] for r in compared.collect()} == {
        "same": "AGREE", "order": "SAME_VALUES_OTHER_ORDER", "cut": "DIFFER", "lone": "MISSING_DECLARED", "none": "VACUOUS"}
    waived = spark.createDataFrame([], "side string, scope string, name string")
    left = cp.uncovered(detected, declared, bound, waived)
    assert [tuple(r) for r in left.collect()] == [("declared", "u", "more")]
    assert cp.vector_gate(compared, left).first()["outcome"] == 2


def test_rank_within_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, "x").otherwise("hot").alias("g"), F.col("id").alias("v")).repartition(5)
    got = rank_within(df, ["g"], ["v"], "r").groupBy("g").agg(F.count_distinct("r").alias("n"), F.max("r").alias("m")).collect()
    assert {r["g"]: (r["n"], r["m"]) for r in got} == {"x": (334, 334), "hot": (666, 666)}


def test_fields_and_header(spark):
    rows = [("f", 0, 'id,name,amount'), ("f", 1, '1,"a,""b""","2,5"'), ("f", 2, '2,,"3,5"'), ("f", 3, '3,c d,4')]
    df = spark.createDataFrame(rows, "file string, line_no int, line string")
    got = [r[0] for r in df.orderBy("line_no").select(ly.fields(F.col("line"), ",")).collect()]
    assert got == [["id", "name", "amount"], ["1", 'a,"b"', "2,5"], ["2", "", "3,5"], ["3", "c d", "4"]]
    head = ly.detect_header(assemble_records(df), ",").first()
    assert (head["header_place"], head["names"]) == (1, "id|name|amount")
    assert ly.detect_delimiter(df).first()["winner"] == "comma"


def test_records_over_line_breaks(spark):
    text = ["h1,h2", '1,"a', 'b', 'c"', "2,x", '3,"y', 'z"']
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, line_no int, line string").repartition(3)
    got = [(r["line"], r["fields"]) for r in assemble_records(df).orderBy("record_no").collect()]
    assert got == [("h1,h2", 2), ('1,"a\nb\nc"', 2), ("2,x", 2), ('3,"y\nz"', 2)]
    assert ly.ragged(ly.field_count_histogram(assemble_records(df))).first()["ragged"] is False


def test_csv_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿BSV,x,x,extra\r\n1,\"a,\"\"b\"\"\",z,\r\n2,\"two\nlines\",y,0".encode())
    (tmp_path / "b.csv").write_text("x,BSV\np,9\n")
    rows = dl.read_contract_csv(spark, str(tmp_path)).orderBy("BSV").collect()
    assert [(r["BSV"], r["x"], r["extra"], r["row_index"]) for r in rows] == [("1", 'a,"b"', "", 1), ("2", "two\nlines", "0", 2), ("9", "p", None, 1)]
    bound = {r["name"]: r for r in dl.bind_inputs(spark, str(tmp_path)).collect()}
    assert bound["b.csv"]["sha256"] == hashlib.sha256(b"x,BSV\np,9\n").hexdigest() and bound["b.csv"]["bytes"] == 10


def test_positional_reader(spark, tmp_path):
    (tmp_path / "k.txt").write_bytes("a|\xfc|c\nd|e\n".encode("latin-1"))
    assert [tuple(r)[1:] for r in dl.read_positional(spark, str(tmp_path), ["p", "q", "r"]).orderBy("p").collect()] == [("a", "\xfc", "c"), ("d", "e", None)]


def test_block_digests_equal_their_sql_beyond_two_levels(spark):
    import duckdb

    from auditframe.operators.digest import block_digests
    from auditframe.plans import results
    from auditframe.plans.views import sql_with

    sf, block = "/root/testdata/sf0.001", 10  # 1,500 rows: four levels
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{sf}/orders.parquet'")
    want = con.execute(sql_with("s_small", body=results._tree_sql(block))).fetchall()
    got = [tuple(r) for r in block_digests(results.small(spark, sf), results.KEYS, block).select("column", "rows", "digest", "canonicalisation").collect()]
    assert sorted(got) == sorted(want) and len(got) == 6


def test_a_listing_starts_few_tasks(spark, tmp_path):
    for i in range(100):
        (tmp_path / f"part={i}").mkdir()
        (tmp_path / f"part={i}" / "x").write_text("a" * (i + 1))
    before = spark.conf.get(dl.LISTING_TASKS)
    spark.sparkContext.setJobGroup("listing", "listing")
    try:
        files = dl.stored_files(spark, str(tmp_path))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
    assert spark.conf.get(dl.LISTING_TASKS) == before
    assert sorted(r["bytes"] for r in files.collect()) == list(range(1, 101))


def test_sinks_compute_the_book_once(spark, monkeypatch):
    from auditframe.plans import results

    read, write = {}, dl.write_json
    monkeypatch.setattr(dl, "write_json", lambda df, path: (read.update(files=df.inputFiles()), write(df, path)))
    rows = {r["rows"] for r in results.a11(spark, "/root/testdata/sf0.001").collect()}
    assert rows == {1500, 1504} and read["files"] and all("/parquet-" in f for f in read["files"])


def test_lines_are_dealt_once_for_both_histograms(spark, monkeypatch):
    """A range partition reads its rows twice; beyond that nothing may make the lines again."""
    from auditframe.plans import results

    made = spark.sparkContext.accumulator(0)

    def make(rows):
        for r in rows:
            made.add(1)
            yield ("f", r.id, f"{r.id},x")

    lines = spark.createDataFrame(spark.range(50).rdd.mapPartitions(make), "file string, line_no bigint, line string")
    monkeypatch.setattr(results, "contract_lines", lambda *a: lines)
    assert [tuple(r) for r in results.a7(spark, "").collect()] == [("f", 2, 50, 50, 0)] and made.value <= 100
