"""Conversations of one block and of several: the same reports, and no numbering of the rows where none is longer than a block."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from test_text_structure import DIGEST, FIELDS, plain_reports

from auditframe.llm import turns
from auditframe.llm.queries import QUERIES


def _written(path, lengths):
    rng = random.Random(11)
    rows = [(c, rng.choice([t, t, t // 2, None]), rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Hi.", "no end", " ", f"Number {t}.", f"é {t} "])) for c, n in enumerate(lengths) for t in range(n)]
    pq.write_table(pa.table(dict(zip(("conv_id", "turn", "role", "text"), zip(*rows)))), path / "conversations.parquet")
    return rows


def test_reports_below_at_and_above_a_block(spark, tmp_path):
    rows = _written(tmp_path, [1, 2, 5, turns.BLOCK - 1, turns.BLOCK, turns.BLOCK + 1, 2 * turns.BLOCK + 3, 150])
    want = plain_reports(rows, DIGEST)
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: w[:-1] for c, w in want.items()}


def test_conversations_of_one_block_are_not_numbered(spark, tmp_path, monkeypatch):
    rows = _written(tmp_path, [3, 8, turns.BLOCK])

    def numbered(*_):
        raise AssertionError("rows were numbered")

    monkeypatch.setattr(turns, "rank_within", numbered)
    got = QUERIES["op13_turn_repair"](spark, str(tmp_path))
    assert "rangepartitioning" not in got._jdf.queryExecution().toString()
    assert len(got.collect()) == len({r[0] for r in rows})


def test_one_pass_gives_the_costs_of_all_lengths():
    rng = random.Random(12)
    for _ in range(300):
        letters, entry, tail = "".join(rng.choices("sSuUaAx", k=rng.randrange(1, 9))), rng.choice("0sua"), rng.random() < 0.5
        target = turns._target(entry, entry == "0", len(letters) + 4)
        for length, cost in enumerate(turns._costs(letters, target, 60, tail)):
            alone = turns.wagner_fischer(letters, target[:length], 60, tail)
            assert (alone[0] if alone else None) == (cost if cost <= 60 else None), (letters, target[:length], tail)
