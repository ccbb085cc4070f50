"""Log-bilinear language model, trained by noise-contrastive estimation and scored with full normalisation.

Counts of every token of every training document are summed by Spark.  The model predicts a class from the classes of the last
``CONTEXT`` tokens: each of the most frequent tokens, as many as the square root of the distinct ones (``WORDS`` at least), is a
class of its own, all other tokens fall into classes by their last two bytes, a third as many.  Within such a class a token has its share by add-one counts, with one place for unknown tokens, so all
probabilities of a position sum to 1.

Training: a position's representation is the sum of its context's vectors, weighted by place; noise-contrastive estimation tells
the token that followed from ``NOISE`` draws of the class unigram, which a minibatch shares so that all is matrix products.  Classes that
follow each other form groups, as many as a group has members, and the group that followed is learnt the same way.  The probability of a class is that of
its group times its share within the group, each normalised in full, so a position costs the square root of the classes.
Every position of every training document is trained on once, in one of ``ROUNDS`` rounds.  In a round every partition trains from
the same start and Spark averages the parameters by the number of examples.  What is gathered, counts and examples, grows with the corpus.

Scoring: the counts of the most frequent tokens, ``HEAD`` at most, travel with the function (a bounded table); the rest of a text's tokens
are joined to the counts.  Null texts are empty and consist of the end token.  Without training rows every token is unknown, and
classes are equally likely.  Repeated rows count each, in training and in scoring.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from auditframe.llm.common import ascii_words, cut_lineage, held_out, pick, table

HEAD, WORDS, SUFFIXES = 100_000, 192, 63
DIMENSIONS, CONTEXT, NOISE, ROUNDS, BATCH, RATE = 16, 4, 64, 2, 1024, 0.1
POSITIONS = 1 << 14  # scored at once
END = b""  # no word is empty
_FLUSH = 400_000


def count_tokens(docs: DataFrame, text: str = "text") -> DataFrame:
    """(token, c) over all words and ends of the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["token", "c"])

        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(ascii_words(t))
                seen[END] += 1
            if len(seen) > _FLUSH:
                yield rows(seen)
                seen = Counter()
        if seen:
            yield rows(seen)

    return docs.select(text).mapInArrow(run, "token binary, c bigint").groupBy("token").agg(F.sum("c").alias("c"))


@dataclasses.dataclass
class Classes:
    """Class of every token: the head's by table, any other's by its last bytes."""

    head: dict[bytes, int]  # token -> place in the arrays
    of_head: np.ndarray  # class of each head token
    share: np.ndarray  # log10 share within its class of each head token
    logs: np.ndarray  # log10(c + 1) of each head token
    suffixes: dict[bytes, int]
    rest: int
    mass: np.ndarray  # log10 of the mass of each class (0 for single tokens)
    unigram: np.ndarray  # share of all training tokens, smoothed

    @property
    def end(self) -> int:
        return int(self.of_head[self.head[END]])

    def suffix_class(self, token: bytes) -> int:
        return self.suffixes.get(token[-2:], self.rest)


def make_classes(counts: DataFrame) -> Classes:
    """From the written counts; the head and the suffix table are of bounded size."""
    # the least count of the head, from a histogram of the counts, so that no task sends more than its share of the head
    step = F.floor(F.log2("c") * 16)
    bins = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = None, 0
    for at, n in bins:
        if held + n > HEAD:
            break
        least, held = at, held + n
    head = [(bytes(r["token"]), r["c"]) for r in counts.filter(step >= least).collect()] if least is not None else []
    head.sort(key=lambda r: (-r[1], r[0]))
    known = dict(head)
    ends = counts.filter(F.col("token") == F.lit(END)).first()
    known.setdefault(END, ends["c"] if ends else 0)
    words = max(WORDS, math.isqrt(sum(n for _, n in bins)))  # grows with the distinct tokens
    single = [t for t, _ in head[: words - 1] if t != END] + [END]
    tails = counts.groupBy(F.expr("substring(token, -2, 2)").alias("tail")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    tails = {bytes(r["tail"]): [r["c"], r["v"]] for r in tails.collect()}  # pairs of bytes: at most 65,793 rows
    for t in single:
        if t[-2:] in tails:
            tails[t[-2:]][0] -= known[t]
            tails[t[-2:]][1] -= 1
    ranked = sorted(tails, key=lambda k: (-tails[k][0], k))
    suffixes = {k: len(single) + i for i, k in enumerate(ranked[: max(SUFFIXES, words // 3)])}
    rest = len(single) + len(suffixes)
    mass, total = np.zeros(rest + 1), np.zeros(rest + 1)
    total[: len(single)] = [known[t] for t in single]
    for k, (c, v) in tails.items():
        i = suffixes.get(k, rest)
        mass[i] += c + v
        total[i] += c
    mass[len(single) :] += 1  # the place of unknown tokens
    mass[: len(single)] = 1
    own = {t: i for i, t in enumerate(single)}
    place = {t: i for i, t in enumerate(known)}
    of_head = np.array([own.get(t, suffixes.get(t[-2:], rest)) for t in place], np.int32)
    c = np.array([known[t] for t in place], float)
    share = np.where(of_head < len(single), 0.0, np.log10(c + 1) - np.log10(mass[of_head]))
    return Classes(place, of_head, share, np.log10(c + 1), suffixes, rest, np.log10(mass), (total + 1) / (total + 1).sum())


# ---------------------------------------------------------------- the model


def group_starts(classes: int) -> np.ndarray:
    """First class of each group; classes that follow each other form groups, as many as they have members."""
    return np.arange(0, classes, group_size(classes))


def group_size(classes: int) -> int:
    return math.isqrt(classes - 1) + 1


def log_shares(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural log of the softmax of each row at one of its columns; the logits are overwritten."""
    logits -= logits.max(1, keepdims=True)
    own = logits[np.arange(len(at)), at].astype(np.float64)
    return own - np.log(np.exp(logits, out=logits).sum(1, dtype=np.float64))


@dataclasses.dataclass
class LogBilinear:
    context: np.ndarray  # class, dimension
    output: np.ndarray  # class, dimension
    bias: np.ndarray
    group: np.ndarray  # group of classes, dimension
    group_bias: np.ndarray
    place: np.ndarray  # place before the token, dimension

    @classmethod
    def start(cls, unigram: np.ndarray, seed: int = 7) -> "LogBilinear":
        rng = np.random.default_rng(seed)
        of_groups = np.add.reduceat(unigram, group_starts(len(unigram)))
        near = lambda rows: rng.normal(0, 0.1, (rows, DIMENSIONS)).astype(np.float32)
        log = lambda share: np.log(share).astype(np.float32)
        return cls(near(len(unigram)), near(len(unigram)), log(unigram), near(len(of_groups)), log(of_groups), np.ones((CONTEXT, DIMENSIONS), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in dataclasses.fields(self)]).astype(np.float64)

    def of_flat(self, w: np.ndarray) -> "LogBilinear":
        """A model of the same shapes with these parameters."""
        shapes = [getattr(self, f.name).shape for f in dataclasses.fields(self)]
        ends = np.cumsum([math.prod(s) for s in shapes])
        return LogBilinear(*(part.reshape(s) for part, s in zip(np.split(w.astype(np.float32), ends[:-1]), shapes)))

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """Representation of each position from the classes before it (rows: positions, columns: places)."""
        out = self.context.take(before[:, 0], 0) * self.place[0]
        for j in range(1, CONTEXT):
            out += self.context.take(before[:, j], 0) * self.place[j]
        return out

    def log_probabilities(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Normalised natural log probability of each target class: that of its group times its share within the group."""
        r, size = self.predicted(before), group_size(len(self.bias))
        groups, members = np.divmod(target, size)
        out = log_shares(r @ self.group.T + self.group_bias, groups)
        order = np.argsort(groups, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(groups[order])) + 1) if len(order) else []:
            own = slice(groups[rows[0]] * size, (groups[rows[0]] + 1) * size)
            out[rows] += log_shares(r[rows] @ self.output[own].T + self.bias[own], members[rows])
        return out


def summed_rows(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct places, sum of the rows at each)."""
    order = np.argsort(places.astype(np.min_scalar_type(places.max())), kind="stable")  # numbers of 16 bits are sorted by their digits
    ordered = places[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[starts], np.add.reduceat(rows.take(order, 0), starts, axis=0)


def logistic(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-x)); x is overwritten."""
    np.negative(np.clip(x, -30, 30, out=x), out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Trainer:
    """Noise-contrastive estimation, of the class and of its group, with Adagrad steps on minibatches.

    A step changes only the rows that its positions and draws touch: Adagrad leaves a parameter without gradient as it is.
    """

    def __init__(self, model: LogBilinear, unigram: np.ndarray, seed: int):
        self.m = LogBilinear(*(np.array(getattr(model, f.name)) for f in dataclasses.fields(model)))
        of_groups = np.add.reduceat(unigram, group_starts(len(unigram)))
        self.log_noise, self.log_group_noise = ((np.log(share) + np.log(NOISE)).astype(np.float32) for share in (unigram, of_groups))
        self.cumulative, self.group_cumulative, self.rng = np.cumsum(unigram), np.cumsum(of_groups), np.random.default_rng(seed)
        self.squares = {f.name: np.full_like(getattr(model, f.name), 1e-2) for f in dataclasses.fields(model)}
        self.size, self.examples = group_size(len(unigram)), 0

    def step(self, before: np.ndarray, target: np.ndarray) -> None:
        m, n = self.m, len(target)
        r = m.predicted(before)
        d_r = self._contrast("output", "bias", r, target, self.cumulative, self.log_noise)
        d_r += self._contrast("group", "group_bias", r, target // self.size, self.group_cumulative, self.log_group_noise)
        near = [m.context.take(before[:, j], 0) for j in range(CONTEXT)]
        d_context = np.concatenate([d_r * m.place[j] for j in range(CONTEXT)])
        d_place = np.stack([np.einsum("ij,ij->j", d_r, c) for c in near])
        self._move("context", *summed_rows(d_context, before.T.ravel()), n)
        self._move("place", slice(None), d_place, n)
        self.examples += n

    def _contrast(self, vectors: str, biases: str, r: np.ndarray, target: np.ndarray, cumulative: np.ndarray, log_noise: np.ndarray) -> np.ndarray:
        """Move vectors and biases towards the targets and away from draws that the minibatch shares; the gradient of r."""
        q, b = getattr(self.m, vectors), getattr(self.m, biases)
        noise = np.minimum(np.searchsorted(cumulative, self.rng.random(NOISE)), len(cumulative) - 1)
        q_t, q_n = q.take(target, 0), q[noise]
        s_t = np.einsum("ij,ij->i", r, q_t) + b[target] - log_noise[target]
        s_n = r @ q_n.T + (b[noise] - log_noise[noise])
        g_t, g_n = logistic(-s_t), -logistic(s_n)  # towards the token that followed, away from the noise
        d_r = g_t[:, None] * q_t + g_n @ q_n
        # the bias is one more dimension
        rows = np.concatenate([np.column_stack([g_t[:, None] * r, g_t]), np.column_stack([g_n.T @ r, g_n.sum(0)])])
        at, d = summed_rows(rows, np.concatenate([target, noise]))
        self._move(vectors, at, d[:, :-1], len(target))
        self._move(biases, at, d[:, -1], len(target))
        return d_r

    def _move(self, name: str, at: np.ndarray | slice, gradient: np.ndarray, n: int) -> None:
        g = gradient / np.float32(n)
        self.squares[name][at] += g * g
        getattr(self.m, name)[at] += np.float32(RATE) * g / np.sqrt(self.squares[name][at])


def head_places(words: list[bytes], k: Classes) -> np.ndarray:
    """Place in the head of each word and of the end; -1 for the other words."""
    place = k.head.get
    ids = [place(w, -1) for w in words]
    ids.append(k.head[END])
    return np.array(ids, np.int64)


def class_sequence(words: list[bytes], ids: np.ndarray, k: Classes) -> np.ndarray:
    """Classes of the words and the end, after ``CONTEXT`` ends that stand before the text."""
    out = k.of_head[ids].astype(np.int64)
    for n in np.flatnonzero(ids < 0).tolist():
        out[n] = k.suffix_class(words[n])
    return np.concatenate([np.full(CONTEXT, k.end), out])


def windows(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(classes before each position, nearest first; class at it)."""
    n = len(classes) - CONTEXT
    return np.stack([classes[CONTEXT - 1 - j : CONTEXT - 1 - j + n] for j in range(CONTEXT)], 1), classes[CONTEXT:]


def train(docs: DataFrame, k: Classes) -> LogBilinear:
    """Parameters averaged over the partitions of the training documents (text)."""
    sc = docs.sparkSession.sparkContext
    classes, model = sc.broadcast(k), LogBilinear.start(k.unigram)
    for number in range(ROUNDS):
        begin = sc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], number: int = number, begin=begin) -> Iterator[pa.RecordBatch]:
            k, trainer, held = classes.value, Trainer(begin.value, classes.value.unigram, number), []
            waiting = 0

            def learn():
                before, target = (np.concatenate(x) for x in zip(*held))
                for at in range(0, len(target), BATCH):
                    trainer.step(before[at : at + BATCH], target[at : at + BATCH])

            for b in batches:
                for t in b.column(0).to_pylist():
                    words = ascii_words(t)
                    before, target = windows(class_sequence(words, head_places(words, k), k))
                    held.append((before[number::ROUNDS], target[number::ROUNDS]))
                    waiting += len(held[-1][1])
                    if waiting >= 64 * BATCH:
                        learn()
                        held, waiting = [], 0
            if held:
                learn()
            if trainer.examples:
                w = trainer.m.flat()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(w))), pa.array(w * trainer.examples), pa.array([trainer.examples] * len(w), pa.int64())], names=["i", "w", "n"])

        rows = docs.select("text").mapInArrow(run, "i bigint, w double, n bigint").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).collect()  # one row a parameter
        if rows:
            w = np.zeros(len(rows))
            for r in rows:
                w[r["i"]] = r["w"]
            model = model.of_flat(w)
    return model


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Model and base scores of every document (doc_id, text), learning from those that are not held out."""
    own = docs.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    training = own.filter("NOT held_out")
    counts = cut_lineage(count_tokens(training))
    size = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = size["n"] or 0, size["v"]
    k = make_classes(counts)
    model = train(training, k)
    partial = cut_lineage(_partial(own, k, model)).withColumn("uid", F.monotonically_increasing_id())  # over a written table
    tail = partial.select("uid", F.explode("tail").alias("t")).select("uid", F.col("t.token").alias("token"), F.col("t.times").alias("times"))
    found = tail.join(counts, "token").groupBy("uid").agg(F.sum("times").alias("tail_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("tail_logs"))
    rows = partial.drop("tail").join(found, "uid", "left")
    logs = F.coalesce("tail_logs", F.lit(0.0))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("head_logs") + logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (F.col("score") + logs).alias("score"),
    )


def _partial(docs: DataFrame, k: Classes, model: LogBilinear) -> DataFrame:
    """What head and model give for each document, and its other tokens, whose counts are still to be added."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((k, model))
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail_type = pa.list_(pa.struct([("token", pa.binary()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, model = shared.value
        in_training = k.logs > 0
        for b in batches:
            out, held, waiting = [], [], 0
            scores = np.zeros(b.num_rows)

            def score_held():
                before, target = (np.concatenate(x) for x in list(zip(*held))[1:])
                of = np.repeat([i for i, _, _ in held], [len(x) for _, _, x in held])
                for at in range(0, len(target), POSITIONS):  # long texts in steps, to bound the memory
                    now = slice(at, at + POSITIONS)
                    scores[:] += np.bincount(of[now], model.log_probabilities(before[now], target[now]), len(scores))

            for i, t in enumerate(b.column(2).to_pylist()):
                words = ascii_words(t)
                ids = head_places(words, k)
                inside = ids[ids >= 0]
                tail = Counter(words[i] for i in np.flatnonzero(ids < 0).tolist())
                held.append((i, *windows(class_sequence(words, ids, k))))
                waiting += len(ids)
                if waiting >= POSITIONS:
                    score_held()
                    held, waiting = [], 0
                shares = k.share[inside].sum() - sum(c * k.mass[k.suffix_class(w)] for w, c in tail.items())
                out.append((len(words) + 1, int(in_training[inside].sum()), float(k.logs[inside].sum()), float(shares), [{"token": w, "times": c} for w, c in tail.items()]))
            if held:
                score_held()
            out = [(*row[:3], row[3] + score / math.log(10), row[4]) for row, score in zip(out, scores.tolist())]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), tail_type]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(zip(*out), types))], names=["doc_id", "held_out", "n_tokens", "head_known", "head_logs", "score", "tail"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, head_known bigint, head_logs double, score double, tail array<struct<token: binary, times: bigint>>")


def op8_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text"))


QUERIES = {"op8_log_bilinear": op8_log_bilinear}
ORACLES: dict[str, str] = {}
