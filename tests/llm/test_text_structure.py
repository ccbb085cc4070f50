"""SimHash components, phrase collocations and conversation repair against plain versions of their contracts."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from auditframe.llm import phrases, simhash, turns
from auditframe.llm.common import ascii_words
from auditframe.llm.jaccard import components
from auditframe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    w = ascii_words(text)
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)] if w else []
    return sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in h) > len(h)) if h else 0


def least_reachable(nodes, linked):
    """The smallest name of every component of the graph whose edges ``linked`` tells."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("folder", ["messy", SF])
def test_simhash_components(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "messy" else folder
    docs = duckdb.connect().execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()
    prints = [(i, plain_fingerprint(t)) for i, t in docs]
    root = least_reachable(sorted({f for _, f in prints}), lambda a, b: (a ^ b).bit_count() <= 3)
    least = collections.defaultdict(list)
    for i, f in prints:
        least[root[f]] += [] if i is None else [i]
    want = collections.Counter((i, f"{f:016x}", min(least[root[f]], default=None)) for i, f in prints)
    got = QUERIES["op11_bk_simhash"](spark, folder).select("doc_id", "fingerprint", "component_id").collect()
    assert collections.Counter(map(tuple, got)) == want


def test_simhash_splits_crowded_shards(spark):
    rng = random.Random(1)
    found = set()
    for _ in range(3):
        base = rng.getrandbits(64)
        for _ in range(250):
            x = base
            for _ in range(rng.randrange(1, 7)):
                x ^= 1 << rng.randrange(64)
            found.add(x)
    found |= {0, 1, (1 << 64) - 1, 0b111, 0b1111}
    groups = collections.defaultdict(set)
    for x, r in least_reachable(sorted(found), lambda a, b: (a ^ b).bit_count() <= 3).items():
        groups[r].add(simhash._signed(x))
    df = spark.createDataFrame([(simhash._signed(x),) for x in found], "fp bigint")
    got = collections.defaultdict(set)
    for r in components(simhash.near_links(df, tree=64)).collect():
        got[r["component"]] |= {r["node"], r["component"]}
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in groups.values() if len(g) > 1}


def test_bk_forest_follows_edges_only_within_the_radius():
    rng = np.random.default_rng(2)
    fps = np.unique(rng.integers(0, 1 << 12, 600, dtype=np.uint64))
    shard = np.sort(rng.integers(0, 5, len(fps)))
    forest = simhash.BKForest(fps, shard)
    assert len(forest.child) == len(fps) - len(set(shard))
    for parent in range(len(fps)):  # children are keyed by their distance to the parent, each key once
        own = slice(forest.start[parent], forest.start[parent + 1])
        assert [int(fps[parent] ^ fps[c]).bit_count() for c in forest.child[own]] == list(forest.key[own]) == sorted(set(forest.key[own]))
    got = {(int(a), int(b)) for x, y in forest.within(np.arange(len(fps))) for a, b in zip(x, y)}
    assert got == {(a, b) for a in range(len(fps)) for b in range(len(fps)) if a != b and shard[a] == shard[b] and int(fps[a] ^ fps[b]).bit_count() <= 3}


def test_long_and_odd_texts_have_plain_fingerprints(monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 7)
    for text in (None, "", " \t\n", "one", "One TWO", "a b c", "x " * 50, "É é\xa0b\x0bc d", " ".join(map(str, range(100)))):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


# ---------------------------------------------------------------- phrases


def plain_phrases(rows, least, share=80, top=2000):
    f = collections.Counter()
    total = collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    candidates = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    for (lang, p), a in candidates.items():
        if any(m == lang and len(q) > len(p) and 100 * b >= share * a and inside(p, q) for (m, q), b in candidates.items()):
            continue
        score, _, left, right = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, left, right, total[lang], score))
    ranked, place = [], collections.Counter()
    for lang, p, a, left, right, n, score in sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode())):
        place[lang] += 1
        if place[lang] <= top:
            ranked.append((lang, place[lang], p, a, left, right, n, score))
    return ranked


PHRASES = ["New York City", "in New York, we", "a b c d e", "x y! x y", "Ünï cödé\xa0z", "one\x0btwo\tthree  four", "b c d", "same same same same same"]


@pytest.mark.parametrize("section", [phrases.SECTION, 40])
def test_phrases_of_made_up_texts(spark, monkeypatch, section):
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(PHRASES, k=rng.randrange(1, 9)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("de", " .,\n"), ("en", "x y " * 2000)] + rows[:20]
    bitmap = phrases.frequent_starts(spark.createDataFrame(rows, "lang string, text string").fillna({"lang": "und", "text": ""}).coalesce(2), 7)
    assert len(bitmap) == 2**phrases.BITS // 8
    for name in ("SECTION", "HELD", "WORDS"):
        monkeypatch.setattr(phrases, name, section)
    got = phrases.collocations(spark.createDataFrame(rows, "lang string, text string"), least=7, top=50).collect()
    assert sorted(map(tuple, got)) == sorted(plain_phrases(rows, 7, top=50))


def test_sections_keep_every_window():
    data = b"aa bb\xffcc dd ee ff gg\xff" * 9
    own, windows = [], []
    phrases.SECTION, kept = 11, phrases.SECTION
    try:
        for section, lead in phrases._sections(data):
            words = phrases._split(section)
            own += words
            windows += [(words + lead.split())[i : i + 2] for i in range(len(words))]
    finally:
        phrases.SECTION = kept
    assert own == phrases._split(data)
    assert [w for w in windows if len(w) == 2 and b"\xff" not in w] == [list(p) for p in zip(own, own[1:]) if b"\xff" not in p]


# ---------------------------------------------------------------- conversations


def plain_audit(rows):
    """Cheapest and least audit by a search over grammar states; rows are (initial, must go, truncated)."""
    nexts = lambda s: "a" if s == "u" else "u"

    def inserted(states):
        for _ in range(3):
            for s, (c, a) in list(states.items()):
                new = (c + 5, a + "I")
                states[nexts(s)] = min(states.get(nexts(s), new), new)
        return states

    states = inserted({"0": (0, "")})
    for initial, gone, cut in rows:
        step = {}

        def reach(s, c, a):
            step[s] = min(step.get(s, (c, a)), (c, a))

        for s, (c, a) in states.items():
            reach(s, c + 2, a + "D")
            if not gone:
                if initial == nexts(s) or (initial == "s" and s == "0"):
                    reach(initial, c + 5 * cut, a + "K")
                reach(nexts(s), c + 1 + 5 * cut, a + "R")
        states = inserted(step)
    return min(states[s] for s in ("0", "a") if s in states)


def plain_reports(rows, order):
    """The contract, row by row; ``order`` breaks ties of equal turns."""
    convs = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), order(r[2])))
        seen, faults = set(), []
        for turn, role, text in found:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain_audit([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(found, faults)])
        state, lines, at = "0", [], 0
        for edit in audit:
            goal = "a" if state == "u" else "u"
            if edit != "D":
                state = found[at][1][:1] if edit == "K" else goal
                full = {"u": "user", "a": "assistant"}.get(state)
                lines.append((found[at][1] if edit == "K" else full) + ":" + ("" if edit == "I" else found[at][2]))
            at += edit != "I"
        turns_ = [r[0] for r in found if r[0] is not None]
        gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
DIGEST = lambda text: hashlib.sha256(text.encode()).digest()


@pytest.mark.parametrize("folder", ["messy", "/root/testdata/sf0.01"])
def test_conversation_reports(spark, request, folder):
    folder = request.getfixturevalue(folder) if folder == "messy" else folder
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{folder}/conversations.parquet'").fetchall()
    want = plain_reports(rows, DIGEST)
    got = QUERIES["op13_turn_repair"](spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[f] for f in FIELDS) == want[r["conv_id"]][:-1], r["conv_id"]


def test_repaired_turns_are_those_of_the_report(spark, messy):
    rows = duckdb.connect().execute(f"SELECT conv_id, turn, role, text FROM '{messy}/conversations.parquet'").fetchall()
    lines = collections.defaultdict(list)
    for r in turns.repaired_turns(turns.damaged(spark.read.parquet(f"{messy}/conversations.parquet"))).orderBy("conv", "order").collect():
        lines[r["conv"]].append(r["role"] + ":" + r["text"])
        assert (r["edit"] == "I") == (r["was"] is None) and (r["edit"] != "K" or r["was"] == r["role"])
    want = {" " if c is None else str(c): w[-1] for c, w in plain_reports(rows, DIGEST).items() if w[-1]}
    assert dict(lines) == want


def test_damaged_conversation_without_rows_left(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    pq.write_table(pa.table({"conv_id": [gone], "turn": [0], "role": ["user"], "text": ["Hi."]}), tmp_path / "conversations.parquet")
    (row,) = QUERIES["op13_turn_repair"](spark, str(tmp_path)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_alignments_of_all_short_conversations():
    rng = random.Random(8)
    for _ in range(3000):
        letters = "".join(rng.choices("sSuUaAxX", [2, 1, 6, 2, 6, 2, 1, 1], k=rng.randrange(1, 12)))
        found = turns.alignments(letters)
        assert found[turns._closed(found)] == plain_audit([(c.lower(), False, c.isupper()) for c in letters]), letters


def test_blocks_combine_to_the_whole():
    rng = random.Random(9)
    for _ in range(200):
        letters = "".join(rng.choices("sSuUaAx", k=rng.randrange(4, 30)))
        cuts = sorted(rng.sample(range(1, len(letters)), 3))
        parts = [letters[a:b] for a, b in zip([0, *cuts], [*cuts, len(letters)])]
        tables = [{(e, x): v for e in ("0" if i == 0 else "0sua") for x, v in turns.alignments(p, e, i == 3).items()} for i, p in enumerate(parts)]
        whole = {x: v for (e, x), v in turns._combined(tables).items()}
        best = whole[turns._closed(whole)]
        assert best[:2] == plain_audit([(c.lower(), False, c.isupper()) for c in letters])
