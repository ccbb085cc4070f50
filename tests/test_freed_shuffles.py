"""Shuffle files of written steps and the plans that read these steps."""

import time

from pyspark.sql import functions as F

from auditframe.plans import catalogue
from auditframe.session import SHUFFLE_CLEANUP, cut_lineage
from auditframe.sources import delimited


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}


def test_a_written_step_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    step = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count())
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false" and step.count() == 97


def test_rules_are_counted_one_after_the_other(spark):
    for name in ("d15_validate_rule_tally", "d15_validate_verdict"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "EVIDENCED_BY" not in plan and plan.count("Join") == (name == "d15_validate_verdict")


def test_sinks_leave_no_shuffle_files_and_a_small_json(spark, tmp_path):
    rows = spark.range(5_000).select((F.col("id") + 1).alias("line_no"), F.lit("the same long text in every line").alias("line_text"))
    before = _shuffle_files(spark)
    delimited.write_document(rows, str(tmp_path / "document"))
    delimited.write_json(rows, str(tmp_path / "json"))
    for _ in range(50):
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    parts = [p for p in (tmp_path / "json").iterdir() if p.name.startswith("part-")]
    assert parts and sum(p.stat().st_size for p in parts) < 5_000 * len("the same long text in every line") / 4
    assert sorted(r["line_no"] for r in spark.read.json(str(tmp_path / "json")).collect()) == list(range(1, 5_001))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "document")).collect()] == ["the same long text in every line"] * 5_000
