"""Input bindings of files that no cell holds."""

import hashlib

from auditframe.sources import delimited


def test_files_beyond_the_largest_cell_are_bound(spark, tmp_path):
    contents = {"a b.bin": b"\xef\xbb\xbfx,y\n" + bytes(range(256)) * 40, "c.bin": b"\r\n" * 900, "small.txt": b"few", "no_end.bin": b"\x00" * 5000}
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    before = spark.conf.get(delimited.LARGEST_READ)
    spark.conf.set(delimited.LARGEST_READ, "1000")  # stands for the 2 GB that Spark reads into a cell at most
    try:
        rows = delimited.bind_inputs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(delimited.LARGEST_READ, before)
    assert {r["name"]: (r["bytes"], r["sha256"]) for r in rows} == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items()}
