"""Scores by a log-bilinear neural model that noise-contrastive estimation trains.

Units are the most frequent words, more of them the more distinct words the corpus has, and, for all other words, classes
by their ending. The two units before a token predict its unit: their vectors, each times a matrix, add up to a guess.
Units lie in groups of equal frequency; a group's score is the guess times the group's vector plus its bias, and so is a
unit's score within its group, so a token is normalized over about twice the square root of the units. Training tells real
groups and units from noise ones, so it needs no sums; scoring divides by them. Within a class a word has its smoothed
share of the class's tokens, which leaves one share for unknown words. So the probabilities of all words, one unknown word
for each class included, add up to one.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import slices, texts, word_codes, written

#: A text's last token. No word is empty.
END = b""


@dataclass(frozen=True)
class Settings:
    words: int = 256  # units that are words, at least; else the square root of the distinct words
    classes: int = 128  # units that are endings, besides one for the other endings
    ending: int = 2  # bytes of a word that make its class
    size: int = 24  # of a vector
    noise: int = 32  # noise groups for each batch of examples, and half as many noise units for each group in it
    batch: int = 4096
    rate: float = 0.15
    rounds: int = 1  # passes over all training texts, averaged over the chunks after each
    known: int = 200_000  # most frequent words whose counts every task holds; the others' counts are joined
    chunk: int = 1 << 20  # tokens whose repeated examples are counted together
    learner: int = 1 << 22  # training tokens of one learner, about
    seed: int = 5


@dataclass
class Units:
    """What every task holds: bounded by Settings.known, words and classes."""

    names: pa.Array  # the known words
    unit: np.ndarray  # of the known words
    logs: np.ndarray  # log10(count + 0.5) of the known words
    endings: dict[bytes, int]
    other: int
    end: int  # the unit of the end token
    end_log: float
    share: np.ndarray  # log10 of (N + 0.5 (V + 1)) of each class; of a word's own unit 0
    words: int
    counts: np.ndarray  # training tokens by unit
    ending: int

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of distinct words, and the logarithms of their counts (NaN: not known here); last, those of the end."""
        at = pc.index_in(words, value_set=self.names)
        rare = np.asarray(pc.is_null(at))
        k = np.asarray(pc.fill_null(at, 0), dtype=np.int64)
        unit, log = (self.unit[k], self.logs[k]) if len(self.names) else (np.zeros(len(k), np.int64), np.zeros(len(k)))
        log = np.where(rare, np.nan, log)
        tails = [w.encode()[-self.ending :] for w in words.filter(pa.array(rare)).to_pylist()]
        unit = unit.copy()
        unit[rare] = [self.endings.get(t, self.other) for t in tails]
        return np.append(unit, self.end), np.append(log, self.end_log)


def with_ends(codes: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The words' numbers with an end after each text, and the texts' lengths with it."""
    return np.insert(codes, np.cumsum(sizes), end), sizes + 1


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all training texts; tasks add up before the shuffle and hold a bounded number of words. The end token is
    the word that is empty."""

    def run(batches):
        counts: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for b in slices(batches, 1 << 22):
            words, codes, sizes = word_codes(b.column(0))
            n = np.bincount(codes, minlength=len(words))
            for w, k in zip(words.to_pylist(), n.tolist()):
                if k:
                    counts[w] += k
            counts[""] += len(sizes)
            if len(counts) > 200_000:
                yield out()
                counts.clear()
        if counts:
            yield out()

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def units(counts: DataFrame, s: Settings) -> Units:
    """Word units and classes; classes get their counts and their numbers of distinct words over the whole table."""
    words = min(max(s.words, isqrt(counts.count())), s.known)
    # The least count that keeps within the bound comes from a histogram of at most 64 * 8 classes of counts.
    classes = counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 8).alias("k")).agg(F.count("*").alias("v"), F.min("n").alias("least"))
    least, held = 1 << 62, 0
    for r in sorted(classes.collect(), key=lambda r: -r.k):
        held += r.v
        if held > s.known:
            break
        least = r.least
    top = counts.filter(F.col("n") >= least).collect()
    known = sorted(((r.word.encode(), r.n) for r in top), key=lambda x: (-x[1], x[0]))
    names = [w for w, _ in known[:words]]
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(w.decode(),) for w in names] or [(None,)], "word string")), "word", "left_anti")
    by_end = rest.groupBy(F.expr(f"substring(encode(word, 'utf-8'), greatest(octet_length(word) - {s.ending - 1}, 1))").alias("e")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
    ends = by_end.orderBy(F.desc("n"), "e").limit(s.classes).collect()
    every = by_end.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    endings = {bytes(r.e): len(names) + k for k, r in enumerate(ends)}
    other = len(names) + len(ends)
    n = np.array([c for _, c in known[:words]] + [r.n for r in ends] + [(every.n or 0) - sum(r.n for r in ends)], float)
    v = np.array([0] * len(names) + [r.v for r in ends] + [(every.v or 0) - sum(r.v for r in ends)], float)
    share = np.where(np.arange(len(n)) < len(names), 0.0, np.log10(n + 0.5 * (v + 1)))
    unit = [k if k < len(names) else endings.get(w[-s.ending :], other) for k, (w, _) in enumerate(known)]
    logs = np.log10(np.array([c for _, c in known], float) + 0.5)
    at = {w: k for k, (w, _) in enumerate(known)}.get(END, -1)
    end = (unit[at], float(logs[at])) if at >= 0 else (other, float(np.log10(0.5)))
    return Units(pa.array([w.decode() for w, _ in known], pa.string()), np.array(unit, np.int64), logs, endings, other, *end, share, len(names), n, s.ending)


def grouped(p: np.ndarray) -> np.ndarray:
    """The group of each unit: units by falling probability, cut where the sum passes equal steps; about the root of their number."""
    order = np.argsort(-p, kind="stable")
    step = np.minimum((np.cumsum(p[order]) - p[order] / 2) / p.sum() * max(1, isqrt(len(p))), max(1, isqrt(len(p))) - 1).astype(np.int64)
    out = np.empty(len(p), np.int64)
    out[order] = np.unique(step, return_inverse=True)[1]  # steps without a unit are left out
    return out


class Model:
    """Vectors r of units and g of groups, a matrix for each of the two places before a token, and biases."""

    def __init__(self, counts: np.ndarray, s: Settings):
        rng, u = np.random.default_rng(s.seed), len(counts)
        p = (counts + 0.5) / (counts + 0.5).sum()
        self.group = grouped(p)
        self.of_group = np.bincount(self.group, p)
        self.within = p / self.of_group[self.group]
        self.members = np.split(np.argsort(self.group, kind="stable"), np.cumsum(np.bincount(self.group))[:-1])
        self.r = rng.normal(0, 0.1, (u, s.size)).astype(np.float32)
        self.g = rng.normal(0, 0.1, (len(self.of_group), s.size)).astype(np.float32)
        self.c = [np.eye(s.size, dtype=np.float32) * f for f in (0.8, 1.0)]
        self.b = np.log(self.within).astype(np.float32)
        self.d = np.log(self.of_group).astype(np.float32)

    def parts(self) -> tuple[np.ndarray, ...]:
        return (self.r, self.g, *self.c, self.b, self.d)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in self.parts():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size

    def places(self) -> list[np.ndarray]:
        """For each place before a token, what each unit adds to the guess."""
        return [self.r @ c for c in self.c]

    def log_probability(self, before: list[np.ndarray], target: np.ndarray) -> np.ndarray:
        """Natural logarithms, normalized over all groups and over the units of the target's group by batched products;
        repeated contexts are summed over the groups once."""
        u, place = len(self.b), self.places()
        contexts, which = np.unique(before[0].astype(np.int64) * u + before[1], return_inverse=True)
        total, guess = np.empty(len(contexts), np.float32), np.empty((len(contexts), self.r.shape[1]), np.float32)
        for i in range(0, len(contexts), 8192):
            part = contexts[i : i + 8192]
            guess[i : i + 8192] = place[0][part // u] + place[1][part % u]
            total[i : i + 8192] = log_sums(guess[i : i + 8192] @ self.g.T + self.d)
        own = self.group[target]
        out = np.einsum("ij,ij->i", guess[which], self.g[own]) + self.d[own] - total[which]
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(self.members) + 1))
        at = np.empty(u, np.int64)
        for k, members in enumerate(self.members):
            at[members] = np.arange(len(members))
            rows = order[starts[k] : starts[k + 1]]
            if len(members) > 1:
                for i in range(0, len(rows), 8192):
                    part = rows[i : i + 8192]
                    score = guess[which[part]] @ self.r[members].T + self.b[members]
                    out[part] += score[np.arange(len(part)), at[target[part]]] - log_sums(score)
        return out


def log_sums(score: np.ndarray) -> np.ndarray:
    top = score.max(axis=1)
    return top + np.log(np.exp(score - top[:, None]).sum(axis=1))


def rows_added(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values that share an index."""
    order = np.argsort(index, kind="stable")
    first = np.flatnonzero(np.diff(index[order], prepend=-1))
    out = np.zeros((n, values.shape[1]), np.float32)
    out[index[order][first]] = np.add.reduceat(values[order], first)
    return out


class Trainer:
    """Noise-contrastive estimation with step sizes by past gradients (AdaGrad)."""

    def __init__(self, model: Model, s: Settings, seed: int):
        self.m, self.s, self.rng = model, s, np.random.default_rng(seed)
        self.past = [np.full(x.shape, 1e-2, np.float32) for x in model.parts()]
        self.log_group = np.log(s.noise * model.of_group).astype(np.float32)
        self.log_unit = np.log(s.noise // 2 * model.within).astype(np.float32)
        self.edges = np.cumsum(model.of_group)
        self.inner = [np.cumsum(model.within[x]) for x in model.members]

    def learn(self, before: list[np.ndarray], target: np.ndarray) -> None:
        """Examples that repeat are one example with a weight; all of them are seen."""
        if not len(target):
            return
        u = len(self.m.b)
        key, weight = np.unique((before[0].astype(np.int64) * u + before[1]) * u + target, return_counts=True)
        order = self.rng.permutation(len(key))
        for i in range(0, len(order), self.s.batch):
            k = key[order[i : i + self.s.batch]]
            self.step(k // (u * u), k // u % u, k % u, weight[order[i : i + self.s.batch]].astype(np.float32))

    def drawn(self, edges: np.ndarray, n: int) -> np.ndarray:
        return np.minimum(np.searchsorted(edges, self.rng.random(n) * edges[-1]), len(edges) - 1)

    def contrast(self, guess, weight, vectors, bias, log_noise, target, noise):
        """The gradients of one contrast: of the guess, of the targets' vectors (times the guess) and of the noise's."""
        real, false = vectors[target], vectors[noise]
        up = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", guess, real) + bias[target] - log_noise[target], -30, 30)))
        down = 1 / (1 + np.exp(np.clip(log_noise[noise] - (guess @ false.T + bias[noise]), -30, 30)))
        g_real, g_false = weight * up, -weight[:, None] * down
        return g_real[:, None] * real + g_false @ false, g_real, g_false

    def step(self, w1: np.ndarray, w2: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        m, u, groups = self.m, len(self.m.b), len(self.m.d)
        place = m.places()
        guess, weight, own = place[0][w1] + place[1][w2], weight / weight.sum(), m.group[target]
        noise = self.drawn(self.edges, self.s.noise)
        d_guess, g_real, g_false = self.contrast(guess, weight, m.g, m.d, self.log_group, own, noise)
        d_g = rows_added(own, g_real[:, None] * guess, groups) + rows_added(noise, g_false.T @ guess, groups)
        d_d = np.bincount(own, g_real, groups) + np.bincount(noise, g_false.sum(axis=0), groups)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(groups + 1))
        g_unit, drawn, to_noise, b_noise = np.zeros(len(target), np.float32), [], [], []
        for k in np.flatnonzero(np.diff(starts)).tolist():
            members = m.members[k]
            if len(members) > 1:
                rows = order[starts[k] : starts[k + 1]]
                noise = members[self.drawn(self.inner[k], self.s.noise // 2)]
                to_guess, g_unit[rows], g_false = self.contrast(guess[rows], weight[rows], m.r, m.b, self.log_unit, target[rows], noise)
                d_guess[rows] += to_guess
                drawn.append(noise)
                to_noise.append(g_false.T @ guess[rows])
                b_noise.append(g_false.sum(axis=0))
        d_r = rows_added(target, g_unit[:, None] * guess, u)
        d_b = np.bincount(target, g_unit, u)
        if drawn:
            drawn = np.concatenate(drawn)
            d_r += rows_added(drawn, np.concatenate(to_noise), u)
            d_b += np.bincount(drawn, np.concatenate(b_noise), u)
        d_c = []
        for w, c in zip((w1, w2), m.c):
            d_place = rows_added(w, d_guess, u)
            d_r += d_place @ c.T
            d_c.append(m.r.T @ d_place)
        for x, d, past in zip(m.parts(), (d_r, d_g, *d_c, d_b.astype(np.float32), d_d.astype(np.float32)), self.past):
            past += d * d * 1e4  # gradients are means over a batch
            x += self.s.rate * d * 100 / np.sqrt(past)


def stream(target: np.ndarray, lengths: np.ndarray, end: int) -> list[np.ndarray]:
    """The two units before each token of texts that lie one after another; ends stand before a text."""
    first = np.cumsum(lengths) - lengths
    one = np.roll(target, 1)
    one[first] = end
    two = np.roll(one, 1)
    two[first] = end
    return [two, one]


def train(training: DataFrame, known, s: Settings, learners: int) -> np.ndarray:
    """Parameters: learners start with the same ones, each learns its texts, and the results are averaged by tokens. A text's
    learner and its place there follow from its id and text alone, so the model does not depend on how the table is laid
    out. What is sent is a model a learner, and what comes back one model."""
    start = Model(known.value.counts, s).flat()
    dealt = training.select("id", "text").repartition(learners, F.xxhash64("id", "text")).sortWithinPartitions(F.xxhash64("text", "id"))
    for round_ in range(s.rounds):

        def run(batches, start=start, round_=round_):
            k = known.value
            model = Model(k.counts, s)
            model.load(start)
            trainer = Trainer(model, s, s.seed + 1000003 * round_ + TaskContext.get().partitionId())
            waiting, held, seen = [], 0, 0

            def learn():
                target, lengths = (np.concatenate(x) for x in zip(*waiting))
                trainer.learn(stream(target, lengths, k.end), target)

            for b in slices(batches, 1 << 22):
                words, codes, sizes = word_codes(b.column(0))
                codes, lengths = with_ends(codes, sizes, len(words))
                waiting.append((k.of(words)[0][codes], lengths))
                held += len(codes)
                if held >= s.chunk:
                    learn()
                    waiting, held, seen = [], 0, seen + held
            if waiting:
                learn()
            seen += held
            if seen:
                flat = model.flat()
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * seen), pa.array(np.full(len(flat), float(seen)))], ["k", "x", "n"])

        sums = dealt.select("text").mapInArrow(run, "k int, x double, n double").groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
        for r in sums.select("k", (F.col("x") / F.col("n")).alias("x")).collect():
            start[r.k] = r.x
    return start


def scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row for each row of df: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts with crc32(id as text) mod 5 = 1 are held out of all that is learnt; rows with a null id are learnt from. A
    null or empty text is its end token alone. Repeated rows are learnt and scored each. An empty table gives none. Words
    beyond the settings' known ones are counted by a join, so counts are exact for all words.
    """
    s = settings
    spark = df.sparkSession
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))
    docs = texts(df, id_col, text_col).withColumn("held_out", held)
    training = docs.filter("not held_out")
    counts = written(word_counts(training), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    known = spark.sparkContext.broadcast(units(counts, s))
    learnt = spark.sparkContext.broadcast(train(training, known, s, max(1, -(-int(total.n) // s.learner))))
    norm = float(np.log10(total.n + 0.5 * (total.v + 1)))

    def run(batches):
        k = known.value
        model = Model(k.counts, s)
        model.load(learnt.value)
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches, 1 << 22):
            words, codes, sizes = word_codes(b.column(1))
            unit, log = k.of(words)
            codes, lengths = with_ends(codes, sizes, len(words))
            target, log_count = unit[codes], log[codes]
            inner = np.log10(np.e) * model.log_probability(stream(target, lengths, k.end), target) - k.share[target]
            first, rare = np.cumsum(lengths) - lengths, np.isnan(log_count)
            n_rare = np.add.reduceat(rare, first, dtype=np.int64)
            base = np.add.reduceat(np.where(rare, 0.0, log_count), first) - lengths * norm
            score = np.add.reduceat(inner + np.where(rare | (target < k.words), 0.0, log_count), first)
            at = np.flatnonzero(rare)
            pair, times = np.unique(np.repeat(np.arange(len(lengths)), lengths)[at] * (len(words) + 1) + codes[at], return_counts=True)
            tail = pa.StructArray.from_arrays([words.take(pa.array(pair % (len(words) + 1))), pa.array(times, pa.int64())], ["word", "n"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(pair // (len(words) + 1), minlength=len(lengths)))]).astype(np.int32)
            rows = pa.array(np.arange(row, row + len(lengths)))
            row += len(lengths)
            cols = [rows, b.column(0), b.column(2), pa.array(lengths), pa.array(lengths - n_rare), pa.array(base), pa.array(score), pa.ListArray.from_arrays(pa.array(ends), tail)]
            yield pa.RecordBatch.from_arrays(cols, ["row", "id", "held_out", "n_tokens", "known", "base", "model", "tail"])

    kind = docs.schema["id"].dataType.simpleString()
    part = docs.mapInArrow(run, f"row long, id {kind}, held_out boolean, n_tokens long, known long, base double, model double, tail array<struct<word: string, n: long>>")
    part = written(part, "scored")
    tail = part.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").alias("times"))
    more = tail.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen")
    )
    out = part.drop("tail").join(more, "row", "left")
    add = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"),
        F.lit(int(total.n)).cast("long").alias("train_tokens"), (F.col("base") + add).alias("base_score"), (F.col("model") + add).alias("score"),
    )
