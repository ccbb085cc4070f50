"""Small messy tables: nulls in any column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def passage(rng, lines=8):
    return "\n".join(sentence(rng, 9) for _ in range(lines))


def documents():
    rng = random.Random(5)
    base = [sentence(rng, rng.randrange(8, 60)) for _ in range(40)]
    texts = list(base)
    for t in base[:12]:  # exact and near copies, in another case and with one word changed
        w = t.split(" ")
        w[len(w) // 2] = "CHANGED"
        texts += [t, t.upper(), " ".join(w)]
    common = passage(rng)
    texts += [f"{sentence(rng, 12)}\n{common}\n{sentence(rng, 12)}\n{sentence(rng, 5)}" for _ in range(6)]
    texts += ["", None, "   \n\t ", "one", "one", "two words", "Ünï  cödé\xa0x　y z 日本語 😀", "x" * 3000, "a" * 50_000, sentence(rng, 30_000), "ends with newline\n" * 3]
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, "no id"), (None, None), (rows[5][0], "same id, other text")]
    rng.shuffle(rows)
    return rows


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(60), None]:
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * rng.randrange(0, 5) + rng.choices(["user", "assistant", "system", "tool", "", None], k=rng.randrange(0, 3))
        for t, role in enumerate(roles):
            text = rng.choice([sentence(rng, 4) + rng.choice([".", "!", "? ", "", "\n"]), "Same text.", "", None, " \t", "Ü?\x0b", "no end"])
            rows.append((c, None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1), role, text))
    long = [(900, t, "user" if t % 2 == 0 else rng.choice(["assistant", "assistant", "user", "x"]), sentence(rng, 3) + rng.choice([".", ".", ".", ""])) for t in range(1500)]
    rows += long + rows[:5] + [(901, 1, "user", "x" * 100_000), (901, 2, "assistant", "y" * 50_000 + ".")]
    rng.shuffle(rows)
    return rows


def write(folder, docs, labels, pages, vectors, turns=()):
    column = lambda i, kind: pa.array([t[i] for t in turns], kind)
    pq.write_table(pa.table({"conv_id": column(0, pa.int64()), "turn": column(1, pa.int64()), "role": column(2, pa.string()), "text": column(3, pa.string()), "conv": pa.array(range(len(turns)), pa.int64()), "digest": pa.array(["clash"] * len(turns), pa.string())}), f"{folder}/conversations.parquet")
    ids, texts = [d[0] for d in docs], [d[1] for d in docs]
    n = len(docs)
    extra = {name: pa.array(range(n), pa.int64()) for name in ("node", "s", "n", "score", "key", "row", "length", "digest", "at", "b")}
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en", None] * n, pa.string())[:n], "source": pa.array(["src0"] * n, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "label": pa.array([None] * n, pa.int32()), **extra}), f"{folder}/documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x[0] for x in labels], pa.int64()), "quality": pa.array([x[1] for x in labels], pa.int32()), "toxic": pa.array([x[2] for x in labels], pa.int32()), "text": pa.array(["clash"] * len(labels), pa.string())}), f"{folder}/labels.parquet")
    pq.write_table(pa.table({"page_id": pa.array([x[0] for x in pages], pa.int64()), "url": pa.array([x[1] for x in pages], pa.string()), "html": pa.array([x[2] for x in pages], pa.string()), "payload": pa.array([1] * len(pages), pa.int64())}), f"{folder}/pages.parquet")
    pq.write_table(pa.table({"vec_id": pa.array([x[0] for x in vectors], pa.int64()), "embedding": pa.array([x[1] for x in vectors], pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32()), "v": pa.array([0] * len(vectors), pa.int64())}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def messy(tmp_path_factory):
    rng = random.Random(9)
    docs = documents()
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _ in docs[::2]] + [(None, 1, 1), (999_999, 0, 0)]
    body = "<html>" + "y" * 200
    pages = [(5, "http://a/ b", body), (3, None, body), (9, "", body), (3, "http://c", body), (None, "u", body), (None, None, None), (7, "http://d", "short"), (8, "http://d", "short"),
             (11, "http://e", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9), (12, "http://f", "line\r\n\r\n\r\nü\n" * 20), (2**40, "g", "z" * 300_000), (-4, "neg", "neg" * 50)]
    vec = lambda: [rng.randrange(-3, 4) / 4 for _ in range(6)]
    same = vec()
    vectors = [(i, vec()) for i in range(0, 400)] + [(i, same) for i in range(400, 520)] + [(3, vec()), (50, vec()), (None, vec()), (1000, None), (1001, [1.0, None] + [0.0] * 4), (1050, [float("nan")] + [0.0] * 5), (1100, [float("inf")] + [0.0] * 5)]
    return write(tmp_path_factory.mktemp("messy"), docs, labels, pages, vectors, conversations())


@pytest.fixture(scope="session")
def nothing(tmp_path_factory):
    return write(tmp_path_factory.mktemp("nothing"), [], [], [], [])
