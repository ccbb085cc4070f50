"""Layout facts of real files: byte-order mark, carriage returns, bytes that are no UTF-8; ranked lists without a cut."""

import collections
import random

from pyspark.sql import functions as F

from auditframe.operators import ledger_rules, references
from auditframe.sources import delimited, layout
from auditframe.sources.records import assemble_records, in_blocks


def test_terminators_mark_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'\xef\xbb\xbfa,b\r\n1,"x\r\ny"\r\n\xff,2\r\n')
    (tmp_path / "b.csv").write_bytes(b"a,b\n1,2\n3,\"4,5\"")
    (tmp_path / "c.csv").write_bytes(b"\xef\xbb\xbfa,b\n1,2")
    lines = layout.read_lines(spark, str(tmp_path))
    records = assemble_records(lines)
    got = {r["file"].rpartition("/")[2]: r for r in layout.quoted_delimiter_stats(lines, records).collect()}
    # the CR LF inside quotes is data
    assert (got["a.csv"]["records"], got["a.csv"]["crlf"], got["a.csv"]["invalid_utf8"], got["a.csv"]["byte_order_mark"]) == (3, 3, 1, True)
    assert (got["b.csv"]["crlf"], got["b.csv"]["invalid_utf8"], got["b.csv"]["byte_order_mark"], got["b.csv"]["quoted_delimiter"]) == (0, 0, False, 1)
    assert got["c.csv"]["byte_order_mark"]
    assert {r["file"].rpartition("/")[2]: r["names"] for r in layout.detect_header(records, ",").collect()} == {"a.csv": "a|b", "b.csv": "a|b", "c.csv": "a|b"}


def test_delimiter_needs_all_lines(spark):
    """The first 300 lines hold a comma in a remark; the file is separated by semicolons."""
    rows = [("f", i + 1, "a;b,c" if i < 300 else "a;b") for i in range(2000)]
    assert layout.detect_delimiter(spark.createDataFrame(rows, "file string, line_no bigint, line string")).first()["winner"] == "semicolon"


def plain_records(text, delimiter=","):
    """Character by character: (fields, whether a quoted field holds a delimiter) of every record."""
    records, fields, field, quoted, inside, i, content = [], [], "", False, False, 0, False

    def end():
        nonlocal fields, field, quoted, content
        records.append(([*fields, field], quoted))
        fields, field, quoted, content = [], "", False, False

    while i < len(text):
        c = text[i]
        if inside:
            if c == '"' and text[i + 1 : i + 2] == '"':
                field, i = field + '"', i + 1
            elif c == '"':
                inside = False
            else:
                field, quoted = field + c, quoted or c == delimiter
        elif c == '"' and not field:
            inside = content = True
        elif c == delimiter:
            fields, field, content = [*fields, field], "", True
        elif c in "\r\n":
            i += text[i : i + 2] == "\r\n"
            end()
        else:
            field, content = field + c, True
        i += 1
    if content:
        end()
    return records


def test_records_of_any_text(spark, tmp_path):
    rng = random.Random(6)
    texts = ["".join(rng.choices(['"', '""', ",", "\n", "\r", "\r\n", "a", "é", ";", " "], [3, 1, 4, 3, 1, 1, 6, 1, 1, 1], k=rng.randrange(1, 120))) for _ in range(150)]
    texts += ['a,"b\nc",d\n' * 50, 'x"y,z\n"1\n2"\n', '"never closed\n' * 30, '"a""b",c\n"",""\n']
    texts = [t for t in texts if t.rstrip("\n") == t or not t.endswith("\n\n")]
    rows = [(f"f{i:03d}", n, line) for i, t in enumerate(texts) for n, line in enumerate(t.removesuffix("\n").split("\n"))]
    df = spark.createDataFrame(rows, "file string, line_no int, line string")
    for parts in (1, 7):
        blocks = in_blocks(df) if parts == 1 else df.withColumn("block", F.floor(F.col("line_no") / 3)).repartition(parts, "file").sortWithinPartitions("file", "line_no")
        got = collections.defaultdict(list)
        for r in assemble_records(blocks).orderBy("file", "record_no").collect():
            got[r["file"]].append((r["fields"], r["quoted"]))
        for i, t in enumerate(texts):
            want = plain_records(t)
            assert got[f"f{i:03d}"] == [(len(f), q) for f, q in want] or t.removesuffix("\n").endswith(("\n", "\r")) or not want, (t, parts)


def test_one_file_is_read_in_many_tasks(spark, tmp_path):
    rng = random.Random(7)
    body, want = [], []
    for i in range(4000):
        note = rng.choice(["plain", 'say "hi"', "two\nlines", "a,b", "cr\r\nlf", ""])
        cell = '"' + note.replace('"', '""') + '"' if set(note) & set('",\n\r') else note
        body.append(f"{i},{cell},{'x' * 20}")
        want.append((str(i), note, "x" * 20, i + 1))
    (tmp_path / "one.csv").write_bytes(("id,note,tail\n" + "\n".join(body)).encode())
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in kept:
            spark.conf.set(k, "4096")
        assert layout.read_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 8
        got = delimited.read_contract_csv(spark, str(tmp_path)).orderBy("row_index").collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert [(r["id"], r["note"], r["tail"], r["row_index"]) for r in got] == want


def test_missing_unit_is_a_unit(spark):
    rows = [("L", "Q", None, "s", "c", 1.0, None), ("L", "Q", None, "s", "c", 2.0, None), ("L", "P", None, "s", "c", 1.0, None), ("L", "P", None, "s", "c", 1.0, None)]
    q = spark.createDataFrame(rows, "ledger_id string, quantity_id string, effective_from date, scenario string, context string, value double, unit string")
    assert [r["message"] for r in ledger_rules.quantity_conflicts(q).collect()] == ["Quantity Q has 2 values for scenario s, context c."]


def test_source_named_none_is_a_source(spark):
    evidence = spark.createDataFrame([("L", f"E{i}", s, "none") for i, s in enumerate(["None", "S1", None])], "ledger_id string, evidence_id string, source_id string, retrieval_method string")
    edges = spark.createDataFrame([], "ledger_id string, src string, dst string, type string, stance string")
    found = references.negative_retrieval_clean(evidence, edges).select(F.regexp_extract("message", "E\\d", 0).alias("e")).collect()
    assert sorted(r["e"] for r in found) == ["E0", "E1"]
