"""Every query on messy small tables against a plain version of its contract, and on empty tables."""

import base64
import collections
import hashlib
import math
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from auditframe.llm import ball_tree, bpe, jaccard, langmodel, line_chunks, packing, quality, toxicity, warc
from auditframe.llm.common import ascii_words
from auditframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def table(folder, name):
    return duckdb.connect().execute(f"SELECT * FROM '{folder}/{name}.parquet'").df().astype(object)


def docs_of(folder):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall()


def run(spark, name, folder):
    return [r.asDict() for r in QUERIES[name](spark, folder).collect()]


def remainder(doc_id, k):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % k


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, nothing, name):
    assert run(spark, name, nothing) == []


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_on_messy_tables(spark, messy, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{messy}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    columns = [c[0] for c in rel.description]
    want = collections.Counter(map(repr, rel.fetchall()))
    got = QUERIES[name](spark, messy).select(*columns).collect()
    assert collections.Counter(repr(tuple(r)) for r in got) == want


def test_arc_versions_and_damage():
    for v, line in ((1, b"http://x 1.2.3.4 20200102030405 text/html 5"), (2, b"http://x 1.2.3.4 20200102030405 text/html 200 - - 0 - 5")):
        block = f"{v} 0 Legacy\n{warc._FIELDS[v]}\n".encode()
        opening = b"filedesc://f 0.0.0.0 20200102030405 text/plain " + (b"200 - - 0 - " if v == 2 else b"") + str(len(block)).encode() + b"\n" + block + b"\n"
        good = opening + line + b"\nabcde\n" + line + b"\n\nabc\n\n"
        assert [r[5] for r in warc.parse_arc(good)] == [b"abcde", b"\nabc\n"]
        with pytest.raises(ValueError, match="declared length"):
            list(warc.parse_arc(opening + line + b"\nabc"))
        with pytest.raises(ValueError, match="does not fit"):
            list(warc.parse_arc(opening + b"http://x 1.2.3.4 20200102030405 text/html x y 5\nabcde\n"))
    assert warc.key_of_record_id("<urn:uuid:ffffffff-0000-8000-8100-0000fffffffc>") == -4


def test_scores_on_messy_tables(spark, messy):
    for name, threshold in (("op2_quality_qda", 0.3), ("op3_compression_toxicity", 0.5)):
        rows = run(spark, name, messy)
        assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in docs_of(messy))
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold) and r["held_out"] == (remainder(r["doc_id"], 5) == 0) for r in rows)


def test_classifiers_on_held_out_rows(spark):
    labels = {r["doc_id"]: r for r in table(SF, "labels").to_dict("records")}
    right = [(r["predicted"], labels[r["doc_id"]]["quality"]) for r in run(spark, "op2_quality_qda", SF) if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in right) / len(right) >= 0.95
    toxic = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in run(spark, "op3_compression_toxicity", SF) if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == y for p, y in toxic) / len(toxic) >= 0.9
    assert sum(p for p, y in toxic if not y) / sum(1 for _, y in toxic if not y) <= 0.03


def test_quality_degenerate_labels():
    assert len(quality.statistics("")) == len(quality.FEATURES) == len(quality.statistics("a b, c!"))
    assert np.isfinite(quality.statistics("é\n" * 4)).all()


def test_toxic_segment_gains():
    seg = b" awful  awfully  horrid "
    base = b" plain words that everyone writes in every text here"
    g = toxicity.Dictionaries(seg + base, bytes([1]) * len(seg) + base, base[-24:]).gains()([b"awfully", b"words", b"zzqqkk"])
    assert g[0] >= 3 and abs(g[1]) <= 1 and g[2] == 0


def components(rows, threshold=80, size=5):
    sets = []
    for _, t in rows:
        w = ascii_words(t)
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def test_jaccard_components(spark, messy):
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, "op4_metric_jaccard", messy))
    assert got == collections.Counter(components(docs_of(messy)))


def test_jaccard_chains_need_windows_and_rest(spark):
    """Chains of near copies: links that run between sets of different balls, and sets outside every ball."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(words[: 60] if i == 0 else words[3 * i : 60 + 3 * i])) for i in range(12)] + [(100 + i, " ".join(words[2 * i :])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for levels in (1, 2, 3):
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(df, levels=levels).collect()}
        assert got == {(d, c) for d, _, c in components(rows)}


def test_row_numbers_stay_when_files_are_split_otherwise(spark, tmp_path, monkeypatch):
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.createDataFrame([(n, f"text {n // 2}") for n in range(24)], "doc_id bigint, text string").repartition(12, "doc_id").write.parquet(f"{tmp_path}/docs")

    def by_text(docs):
        out = jaccard.cut_lineage(docs.selectExpr("doc_id", "crc32(CAST(text AS binary)) AS component_id"))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4200000")
        return out

    monkeypatch.setattr(jaccard, "jaccard_components", by_text)
    try:
        kept = jaccard.keep_one_of_each(spark.read.parquet(f"{tmp_path}/docs")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert sorted(r["doc_id"] for r in kept) == list(range(0, 24, 2))


def test_fingerprints(spark, messy):
    rows = run(spark, "op5_imatch", messy)
    docs = docs_of(messy)
    assert collections.Counter((r["doc_id"], r["n_chars"]) for r in rows) == collections.Counter((i, len(t or "")) for i, t in docs)
    ids = sorted({i for i, _ in docs}, key=lambda i: (i is not None, i))
    texts = collections.defaultdict(set)
    for i, t in docs:
        texts[i].add(t or "")
    by = collections.defaultdict(set)
    for r in rows:
        after = min(texts[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]])
        half = r["n_chars"] // 2
        edits = {hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest() for t in texts[r["doc_id"]] if len(t) == r["n_chars"]}
        assert r["edited_sha256"] in edits
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if len(texts[r["doc_id"]]) == 1:
            by[min(texts[r["doc_id"]])].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by.values())
    assert len({min(f) for f in by.values()}) > 50  # texts with the same words (in other case or order) may be equal


def test_half_edited_texts_are_more_alike_than_neighbours(spark):
    rows = run(spark, "op5_imatch", SF)
    assert sum(r["near_edited"] for r in rows) > 5 * sum(r["near_next"] for r in rows)


def test_ball_tree_prunes_and_is_exact():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.integers(-200, 200, (900, 8)), np.repeat(rng.integers(-200, 200, (1, 8)), 300, 0)])
    ids = rng.permutation(len(v)).astype(np.int64)
    tree = ball_tree.BallTree(v, ids, leaf=16)
    q = v[::60]
    s, f = tree.search(q, ids[::60], 5, np.full(len(q), ball_tree._NONE), np.full(len(q), ball_tree._LAST))
    for n, own in enumerate(ids[::60]):
        want = sorted(((-int(p), int(i)) for p, i in zip(v @ q[n], ids) if i != own))[:5]
        assert [(-int(a), int(b)) for a, b in zip(s[n], f[n])] == want
    big = np.array([[2**30, 1], [2**30, 2]])
    assert ball_tree.products(big, big)[0, 1] == 2**60 + 2  # beyond the doubles: integer arithmetic


def test_byte_bpe(spark, messy):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in docs_of(messy):
        ids = model.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op7_byte_bpe", messy)) == want


def test_byte_bpe_against_a_scan_of_all_pairs():
    ranks = {bytes([i]): i for i in range(256)}
    for t in (b"ab", b"ba", b"aa", b"aab", b"abab", b"aaaa", b"bb", b"bab"):
        ranks[t] = len(ranks)

    def plain(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = np.random.default_rng(1)
    model = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    for _ in range(300):
        word = bytes(rng.choice([97, 98, 99], rng.integers(2, 40), p=[0.5, 0.4, 0.1]).astype(np.uint8))
        assert model.merge(word) == ([ranks[word]] if word in ranks else plain(word))
    assert not model.queue.buckets and not any(model.queue.words)
    assert len(model.merge(b"ab" * 100_000)) == 50_000


def test_language_model(spark, messy):
    docs = docs_of(messy)
    counts = collections.Counter()
    for i, t in docs:
        if remainder(i, 7) != 2:
            counts.update(ascii_words(t) + [b""])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in docs:
        w = ascii_words(t) + [b""]
        want[i, remainder(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)] += 1
    rows = run(spark, "op8_log_bilinear", messy)
    assert collections.Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in rows) == want
    assert all(r["score"] < 0 for r in rows)


def test_language_model_probabilities_sum_to_one(spark):
    rows = [(collections.Counter(f"w{i % 23}x{i % 4} tail{i}".encode().split()),) for i in range(900)]
    counts = collections.Counter()
    for (c,) in rows:
        counts.update(c)
    counts[b""] = 900
    df = spark.createDataFrame([(bytearray(t), c) for t, c in counts.items()], "token binary, c bigint")
    k = langmodel.make_classes(df)
    share = collections.Counter()
    for t, i in k.head.items():
        share[int(k.of_head[i])] += 10 ** k.share[i]
    for c in range(len(k.mass)):  # a class of several tokens keeps one place for the unknown
        if c > k.end:
            share[c] += 10 ** -k.mass[c]
    assert all(abs(share[c] - 1) < 1e-9 for c in range(len(k.mass)))
    model = langmodel.LogBilinear.start(k.unigram)
    before = np.zeros((len(k.mass), langmodel.CONTEXT), np.int64)
    assert abs(np.exp(model.log_probabilities(before, np.arange(len(k.mass)))).sum() - 1) < 1e-5


def test_language_model_beats_the_unigram_base(spark):
    rows = [r for r in run(spark, "op8_log_bilinear", SF) if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_learns_from_every_position(spark):
    words = ["f"] * 16
    words[7:9] = ["p", "q"]  # q follows p, and only far from the first places of every sixteen
    docs = spark.createDataFrame([(" ".join(words * 40),)] * 1000, "text string").coalesce(2)
    k = langmodel.make_classes(langmodel.count_tokens(docs))
    p, q, f = (int(k.of_head[k.head[w]]) for w in (b"p", b"q", b"f"))
    place = (np.array([[p, f, f, f]]), np.array([q]))
    start, trained = langmodel.LogBilinear.start(k.unigram), langmodel.train(docs, k)
    assert trained.log_probabilities(*place)[0] > start.log_probabilities(*place)[0] + 0.5


def test_language_model_classes_grow_with_the_distinct_tokens(spark):
    sizes = []
    for v in (1_000, 90_000):
        counts = spark.range(v).selectExpr("CAST(concat('w', id) AS binary) AS token", "id + 1 AS c")
        k = langmodel.make_classes(counts)
        sizes.append(k.end + 1)
    assert sizes == [langmodel.WORDS, 300]


def check_packing(rows, docs):
    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    model.encode_special_tokens = True
    ids = [(i, model.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in docs]
    want = collections.Counter()
    for i, d in ids:
        first = len(d) % 2048 or 2048
        bounds = [0, *range(first, len(d) + 1, 2048)]
        for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, p, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *d[a:b]))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        ends = np.cumsum([n for _, n in places])
        assert ends[-1] <= 2048 and [o for o, _ in places] == [0, *ends[:-1]]
    return len(sequences), -(-sum(len(d) for _, d in ids) // 2048)


def test_packing(spark, messy):
    used, bound = check_packing(run(spark, "op9_grouping_pack", messy), docs_of(messy))
    assert used <= bound + 1
    used, bound = check_packing(run(spark, "op9_grouping_pack", SF), docs_of(SF))
    assert used <= 1.01 * bound


def test_crossover_keeps_every_piece_once():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 900, 300)
    genes = [packing.evolve(sizes, [], s, 1000, generations=6) for s in (0, 1)]
    a, b = (packing.Grouping.of_genes(g, sizes.tolist(), 1000) for g in genes)
    child = packing.mutate(packing.cross(a, b, rng), rng)
    assert sorted(i for p in child.bins for i in p) == list(range(300))
    assert all(f == 1000 - sum(sizes[i] for i in p) >= 0 for p, f in zip(child.bins, child.free))


def dedupe(rows):
    """Plain version: chunks by bytes, the first by the hash of the document keeps its own (any one may)."""
    chunks = collections.defaultdict(set)
    for key in {(i, t) for i, t in rows if t}:
        data = key[1].encode()
        for n, (a, b, lines) in enumerate(line_chunks.chunk_bounds(data)):
            if lines >= line_chunks.LEAST_LINES and b - a >= line_chunks.LEAST_BYTES:
                chunks[data[a:b].rstrip(b"\n")].add((key, n))
    return {c: places for c, places in chunks.items() if len(places) > 1}


def test_line_chunks(spark, messy):
    docs = docs_of(messy)
    repeated = dedupe(docs)
    rows = run(spark, "op10_line_chunks", messy)
    assert repeated and sum(r["chunks_removed"] for r in rows) == sum(len(p) - 1 for p in repeated.values())
    assert collections.Counter(r["doc_id"] for r in rows) == collections.Counter(i for i, _ in docs)
    untouched = collections.Counter((r["doc_id"], r["text"]) for r in rows if not r["chunks_removed"])
    assert not untouched - collections.Counter(docs)
    for chunk in repeated:  # one copy stays
        assert sum((r["text"] or "").count(chunk.decode()) for r in rows) == 1


def test_repeated_passages_go_whole_between_other_lines(spark):
    """Every line of a passage goes but in one document, whether it is one line, short lines or many, whatever stands around it."""
    rng = random.Random(11)
    own = lambda: f"own {rng.random()} {rng.random()} {rng.random()}"
    passages = [["one line of a passage that stands between other lines " * 2], ["short a", "short line b", "short line c", "and the last d"], [f"line {n} of a longer passage, {n * n}" for n in range(9)], ["a paragraph that is long enough to be one", "", "and a second one that is long enough, too"]]
    rows = [(n, "\n".join([own(), own(), *passages[n % 4], own(), "tiny"])) for n in range(40)] + [(100, "one line document, which is long enough to count")] * 2 + [(101, "one line document, which is long enough to count")]
    got = line_chunks.dedupe_lines(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    for lines in passages:
        assert sum("\n".join(lines) in r["text"] for r in got) == 1
        for line in filter(None, lines):
            assert sum(line in r["text"].split("\n") for r in got) == 1
    text = dict(rows)
    for r in got:
        kept = [x for x in text[r["doc_id"]].split("\n") if x.startswith(("own", "tiny", "one line document"))]
        assert kept == [x for x in r["text"].split("\n") if x.startswith(("own", "tiny", "one line document"))]
    assert sum(r["__removed"] > 0 for r in got) == 36


def test_passage_windows_cover_every_shared_run():
    rng = random.Random(3)
    for _ in range(300):
        passage = [bytes(rng.choices(b"abc", k=rng.randrange(1, 60))) for _ in range(rng.randrange(1, 7))]
        if len(b"\n".join(passage)) < line_chunks.LEAST_BYTES:
            continue
        found = []
        for head, tail in ((b"x\nyy\n", b"\nz"), (b"", b""), (b"own " * 20 + b"\n", b"\nq\nr\n")):
            data, skip = head + b"\n".join(passage) + tail, head.count(b"\n")
            inside = [(f - skip, l - skip) for f, l, _, _ in line_chunks.passage_windows(data) if f >= skip and l < skip + len(passage)]
            assert {n for f, l in inside for n in range(f, l + 1)} == set(range(len(passage)))
            found.append(inside)
        assert found[0] == found[1] == found[2]


def test_chunk_bounds_shift_with_inserted_lines():
    lines = [f"line {i} {i * i}\n".encode() for i in range(200)]
    whole, shifted = b"".join(lines), b"".join([b"new line\n", *lines[:100], b"another\n", *lines[100:]])
    of = lambda d: {d[a:b] for a, b, _ in line_chunks.chunk_bounds(d)}
    assert len(of(whole) & of(shifted)) >= len(of(whole)) - 4
    assert b"".join(whole[a:b] for a, b, _ in line_chunks.chunk_bounds(whole)) == whole


def test_pipeline_stages(spark, messy, tmp_path):
    docs = spark.read.parquet(f"{messy}/documents.parquet")
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, messy).write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        if name != "packing":
            assert docs.columns == columns
        if name in ("toxicity", "quality"):
            assert not collections.Counter(map(repr, docs.collect())) - collections.Counter(map(repr, before))
        if name == "line_dedup":
            assert docs.count() == len(before)
        if name == "near_duplicates":
            groups = components([(i, r["text"]) for i, r in enumerate(before)])
            assert docs.count() == len({c for _, _, c in groups})
    assert re.fullmatch(r"\w+", name) and docs.count() > 0
