"""Log-bilinear language model, trained with noise-contrastive estimation and scored with normalised probabilities.

A token belongs to a symbol: the most frequent words have one each, the end has one,
and all other words share the class of their last two bytes. The model predicts the
symbol from the symbols before it; within a class a word has its smoothed relative
frequency. Both factors are normalised, so a text has a true probability.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

from .common import chunks, columns, fold

END = b""
PARTS = "read long, word binary, n long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"


@dataclass(frozen=True)
class Settings:
    """``words`` symbols of single words, ``classes`` of endings; ``context`` symbols before the token; ``width`` of the vectors.

    ``known`` bounds the words whose counts are sent to the tasks; the counts of all
    other words are joined. Training starts on about ``start_documents`` documents and
    then runs over all, each task on its own; their parameters are averaged by tokens.
    """

    words: int = 127
    classes: int = 128
    context: int = 3
    width: int = 16
    noise: int = 64
    batch: int = 4_096
    rate: float = 0.1
    known: int = 150_000
    start_documents: int = 2_000
    seed: int = 5

    @property
    def symbols(self) -> int:
        return self.words + 1 + self.classes


def tokens(data: bytes) -> list[bytes]:
    """Words in lower case (A-Z), without the end."""
    return data.lower().split()


def ending(word: bytes, s: Settings) -> int:
    return s.words + 1 + zlib.crc32(word[-2:]) % s.classes


def token_counts(rows: DataFrame) -> DataFrame:
    """(word, n) over all rows; the end counts once per row. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter[bytes] = Counter()
        for _, texts in chunks(batches):
            for data in texts:
                counts.update(tokens(data))
            counts[END] += len(texts)
            if len(counts) > 200_000:
                yield flush()
                counts.clear()
        yield flush()

    return rows.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Counts that every task needs. ``index``: the known words; the arrays are by their number."""

    index: dict[bytes, int]
    counts: np.ndarray
    symbol: np.ndarray
    tokens: int
    distinct: int
    symbol_counts: np.ndarray
    class_distinct: np.ndarray
    floor: int

    def base_divisor(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    def inner_divisor(self) -> np.ndarray:
        """log10 of the divisor within each symbol; a symbol of one word has no inner factor."""
        return np.log10(self.symbol_counts + 0.5 * (self.class_distinct + 1))


def read_vocabulary(counts: DataFrame, s: Settings) -> Vocabulary:
    """From the counts of all training tokens. Known words are those with more than ``floor`` tokens.

    The floor is the least that leaves at most ``known`` words, found from the number of
    words of each count (counts from 4,096 on are taken by powers of 2^(1/8)).
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    step = F.when(F.col("n") < 4_096, F.col("n").cast("double")).otherwise(F.floor(F.log2("n") * 8) / 8 + 5_000)
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("v"), F.max("n").alias("top")).orderBy(F.desc("step")).collect()
    floor, seen = 0, 0
    for row in steps:
        seen += row["v"]
        if seen > s.known:
            floor = row["top"]
            break
    known = counts.filter(F.col("n") > floor).toPandas()  # at most s.known rows
    top = counts.filter(F.length("word") > 0).orderBy(F.desc("n"), "word").limit(s.words).collect()
    own = {bytes(r["word"]): i for i, r in enumerate(top)} | {END: s.words}
    classed = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(s.classes)) + s.words + 1
    by_class = counts.groupBy(classed.alias("symbol")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    symbol_counts, distinct = np.zeros(s.symbols), np.zeros(s.symbols)
    for row in by_class:
        symbol_counts[row["symbol"]], distinct[row["symbol"]] = row["n"], row["v"]
    end = counts.filter(F.length("word") == 0).first()
    single = {bytes(r["word"]): r["n"] for r in top} | ({END: end["n"]} if end else {})
    for word, n in single.items():  # these have left their class
        symbol_counts[ending(word, s)] -= n
        distinct[ending(word, s)] -= 1
        symbol_counts[own[word]] = n
    words = [bytes(w) for w in known["word"]]
    symbols = np.array([own.get(w, -1) if w in own else ending(w, s) for w in words], np.int64)
    return Vocabulary({w: i for i, w in enumerate(words)}, known["n"].to_numpy(np.int64), symbols, int(total["n"]), int(total["v"]), symbol_counts, distinct, floor)


@dataclass
class Model:
    """r(h) = sum of position weights times context vectors; the score of a symbol is r(h) . out + bias."""

    given: np.ndarray
    place: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.given, self.place, self.out, self.bias)])

    def vectors(self, context: np.ndarray) -> np.ndarray:
        """r(h) of every row of context symbols, from one table for each place."""
        r = (self.given * self.place[0])[context[:, 0]]
        for i in range(1, context.shape[1]):
            r += (self.given * self.place[i])[context[:, i]]
        return r

    def like(self, flat: np.ndarray) -> Model:
        parts, at = [], 0
        for x in (self.given, self.place, self.out, self.bias):
            parts.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Model(*parts)


def fresh_model(vocabulary: Vocabulary, s: Settings) -> Model:
    """Starts as the unigram model: the bias is the log frequency."""
    rng = np.random.default_rng(s.seed)
    p = (vocabulary.symbol_counts + 1) / (vocabulary.symbol_counts + 1).sum()
    given = (rng.standard_normal((s.symbols + 1, s.width)) * 0.1).astype(np.float32)
    out = (rng.standard_normal((s.symbols, s.width)) * 0.1).astype(np.float32)
    place = np.tile((1.0 / np.arange(1, s.context + 1))[:, None], (1, s.width)).astype(np.float32)
    return Model(given, place, out, np.log(p).astype(np.float32))


def contexts(symbols: np.ndarray, lengths: np.ndarray, s: Settings) -> np.ndarray:
    """Context symbols of every token (tokens x context), nearest first; before a text stands the start symbol."""
    inside = np.arange(len(symbols)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((len(symbols), s.context), s.symbols, np.int64)
    for i in range(s.context):
        out[i + 1 :, i] = np.where(inside[i + 1 :] > i, symbols[: len(symbols) - i - 1], s.symbols)
    return out


def scatter(size: int, index: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sum of the rows of each index: sorted by it (small numbers are sorted by their digits), runs are added up."""
    out = np.zeros((size, rows.shape[1]), np.float32)
    index = index.astype(np.min_scalar_type(size))
    order = np.argsort(index, kind="stable")
    index = index[order]
    begin = np.flatnonzero(np.r_[True, index[1:] != index[:-1]][: len(index)])
    out[index[begin]] = np.add.reduceat(rows[order], begin, axis=0) if len(begin) else 0
    return out


class Trainer:
    """Noise-contrastive estimation with AdaGrad; the noise is the unigram, shared by a batch."""

    def __init__(self, model: Model, symbol_counts: np.ndarray, s: Settings, seed: int):
        self.model, self.s, self.rng = model, s, np.random.default_rng(seed)
        self.p = (symbol_counts + 1) / (symbol_counts + 1).sum()
        self.shift = np.log(s.noise * self.p).astype(np.float32)
        self.sums = [np.full(x.shape, 1e-3, np.float32) for x in (model.given, model.place, model.out, model.bias)]
        self.seen = 0

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        m, n = self.model, len(target)
        noise = self.rng.choice(len(self.p), self.s.noise, p=self.p)
        r = m.vectors(context)
        good = np.einsum("nd,nd->n", r, m.out[target]) + m.bias[target] - self.shift[target]
        bad = r @ m.out[noise].T + (m.bias[noise] - self.shift[noise])
        g = (-1 / (1 + np.exp(np.clip(good, -30, 30))) / n).astype(np.float32)
        b = (1 / (1 + np.exp(-np.clip(bad, -30, 30))) / n).astype(np.float32)
        dr = g[:, None] * m.out[target] + b @ m.out[noise]
        d_out = scatter(len(m.out), target, g[:, None] * r) + scatter(len(m.out), noise, b.T @ r)
        d_bias = np.bincount(target, g, len(m.bias)) + np.bincount(noise, b.sum(0), len(m.bias))
        met = [scatter(len(m.given), at, dr) for at in context.T]  # of each place, by symbol
        d_place = np.stack([(m.given * d).sum(0) for d in met])
        d_given = sum(d * at for d, at in zip(met, m.place, strict=True))
        for x, total, d in zip((m.given, m.place, m.out, m.bias), self.sums, (d_given, d_place, d_out, d_bias), strict=True):
            d = d * np.float32(len(self.p))  # gradients of the order of one word's share
            total += d * d
            x -= (self.s.rate * d / np.sqrt(total)).astype(np.float32)
        self.seen += n

    def learn(self, symbols: np.ndarray, lengths: np.ndarray) -> None:
        context = contexts(symbols, lengths, self.s)
        order = self.rng.permutation(len(symbols))
        for i in range(0, len(order), self.s.batch):
            at = order[i : i + self.s.batch]
            self.step(context[at], symbols[at])


def symbol_rows(texts: list[bytes], v: Vocabulary, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Of all tokens: number among the known words (-1: none) and symbol; of each text: tokens with the end; and its words."""
    get = v.index.get
    words = [tokens(t) for t in texts]
    lengths = np.array([len(w) + 1 for w in words], np.int64)
    end = (get(END, -1),)
    number = np.fromiter(chain.from_iterable(part for w in words for part in (map(get, w, repeat(-1)), end)), np.int64, int(lengths.sum()))
    symbol = np.where(number >= 0, v.symbol[number] if len(v.symbol) else 0, -1)
    missing = np.flatnonzero(symbol < 0)
    if len(missing):
        ends = np.cumsum(lengths)
        owner = np.searchsorted(ends, missing, side="right")
        inside = missing - (ends - lengths)[owner]
        symbol[missing] = [ending(words[k][i], s) if i < len(words[k]) else s.words for k, i in zip(owner.tolist(), inside.tolist(), strict=True)]
    return number, symbol, lengths, words


def train_model(rows: DataFrame, v: Vocabulary, s: Settings) -> Model:
    """Start on a bounded part of the training documents, then one pass over all of them."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(v))
    model = fresh_model(v, s)
    documents = max(1, int(v.symbol_counts[s.words]))
    part = min(1.0, s.start_documents / documents)
    first = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) <= int(part * 1_000_000)).coalesce(1)

    def round_of(data: DataFrame, model: Model) -> Model:
        sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            start, vocabulary = cloudpickle.loads(sent.value), cloudpickle.loads(shared.value)
            trainer = Trainer(start.like(start.flat().copy()), vocabulary.symbol_counts, s, s.seed)
            for _, texts in chunks(batches, size=1 << 20):
                _, symbol, lengths, _ = symbol_rows(texts, vocabulary, s)
                trainer.learn(symbol, lengths)
            if trainer.seen:
                flat = trainer.model.flat().astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(np.full(len(flat), float(trainer.seen))), pa.array(flat * trainer.seen)], ["at", "weight", "value"])

        found = data.mapInArrow(run, "at long, weight double, value double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value")).toPandas()
        if found.empty:
            return model
        flat = np.zeros(len(model.flat()))
        flat[found["at"].to_numpy()] = found["value"].to_numpy()
        return model.like(flat)

    return round_of(rows, round_of(first, model))


@dataclass
class Scores:
    """Tables by place and context symbol: a score is the sum of one row for each place, its exponential their product.

    ``scores``: place x symbol before x symbol; the bias is in the first place's. ``powers``: their
    exponentials, divided by each row's largest, whose logarithm is in ``tops``.
    """

    scores: np.ndarray
    tops: np.ndarray
    powers: np.ndarray

    @staticmethod
    def of(model: Model) -> Scores:
        scores = (model.given * model.place[:, None]) @ model.out.T
        scores[0] += model.bias
        tops = scores.max(2)
        return Scores(scores, tops, np.exp(scores - tops[:, :, None]))

    def log10_probabilities(self, context: np.ndarray, symbols: np.ndarray, rows: int = 256) -> np.ndarray:
        """Normalised log10 probability of every symbol after its context: products of table rows, no exponentials."""
        places, total = range(context.shape[1]), np.empty(len(symbols), np.float32)
        for i in range(0, len(symbols), rows):
            at = context[i : i + rows]
            product = self.powers[0].take(at[:, 0], 0)
            for k in places[1:-1]:
                product *= self.powers[k].take(at[:, k], 0)
            last = self.powers[-1].take(at[:, -1], 0) if len(places) > 1 else np.ones_like(product)
            np.einsum("nj,nj->n", product, last, out=total[i : i + rows])
        far = total < 1e-25  # the places' largest lie so far apart that products are lost
        own = sum(self.scores[k][context[:, k], symbols].astype(np.float64) for k in places)
        log = np.log(np.where(far, 1, total)) + sum(self.tops[k][context[:, k]].astype(np.float64) for k in places)
        for i in np.flatnonzero(far):
            whole = sum(self.scores[k, context[i, k]].astype(np.float64) for k in places)
            log[i] = whole.max() + np.log(np.exp(whole - whole.max()).sum())
        return (own - log) / np.log(10)


def log10_probabilities(model: Model, symbols: np.ndarray, lengths: np.ndarray, s: Settings) -> np.ndarray:
    """Normalised log10 probability of every token's symbol."""
    return Scores.of(model).log10_probabilities(contexts(symbols, lengths, s), symbols)


def score_documents(documents: DataFrame, s: Settings = Settings(), id: str = "doc_id", text: str = "text", folds: int = 5, held_fold: int = 1) -> DataFrame:
    """One row per document with its token counts, the base score and the model's log10 probability.

    Null counts as empty, whose only token is the end. A null id counts as the empty text
    for the fold. Ids may repeat; each row is scored alone. Without training rows the
    model is uniform. A word never met in training has the share that smoothing leaves
    in its class, as the base has one for all.
    """
    rows = columns(documents, doc_id=id, text=text).select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), F.monotonically_increasing_id().alias("read"), "text")
    training = rows.filter(~F.col("held_out")).select("doc_id", "text")
    counts = cut_lineage(token_counts(training))
    vocabulary = read_vocabulary(counts, s)
    model = train_model(training, vocabulary, s)
    sent = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps((vocabulary, model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model = cloudpickle.loads(sent.value)
        base_divisor, inner_divisor = v.base_divisor(), v.inner_divisor()
        inner_divisor[: s.words + 1] = 0
        scores = Scores.of(model)
        count_log = np.log10(np.r_[v.counts, 0] + 0.5)
        for part, texts in chunks(batches, size=1 << 20):
            number, symbol, lengths, words = symbol_rows(texts, v, s)
            starts = np.cumsum(lengths) - lengths
            known, single = number >= 0, symbol <= s.words
            base = np.where(known, count_log[number], 0.0) - base_divisor
            inner = scores.log10_probabilities(contexts(symbol, lengths, s), symbol) + np.where(single, 0.0, np.where(known, count_log[number], 0.0) - inner_divisor[symbol])
            out = ([], [], [])
            reads = part.column(2).to_pylist()
            at = np.flatnonzero(~known)
            owner = np.searchsorted(starts, at, side="right") - 1
            rare: dict[tuple[int, bytes], int] = Counter((k, words[k][i]) if i < len(words[k]) else (k, END) for k, i in zip(owner.tolist(), (at - starts[owner]).tolist(), strict=True))
            for (k, word), n in rare.items():
                out[0].append(reads[k])
                out[1].append(word)
                out[2].append(n)
            m, n = len(out[0]), len(texts)
            none = lambda kind: pa.nulls(m, kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(reads + out[0], pa.int64()),
                    pa.array([b" %d" % r for r in reads] + out[1], pa.binary()),  # a text's own row meets no word
                    pa.array([0] * n + out[2], pa.int64()),
                    pa.concat_arrays([part.column(0).cast(pa.int64()), none(pa.int64())]),
                    pa.concat_arrays([part.column(1), none(pa.bool_())]),
                    pa.concat_arrays([pa.array(lengths), none(pa.int64())]),
                    pa.concat_arrays([pa.array(np.add.reduceat(known.astype(np.int64), starts)), none(pa.int64())]),
                    pa.concat_arrays([pa.array(np.add.reduceat(base, starts)), none(pa.float64())]),
                    pa.concat_arrays([pa.array(np.add.reduceat(inner, starts)), none(pa.float64())]),
                ],
                [f.split()[0] for f in PARTS.split(", ")],
            )

    parts = rows.mapInArrow(run, PARTS)
    rare = counts.filter(F.col("n") <= vocabulary.floor).withColumnRenamed("n", "c")
    met = parts.join(rare, "word", "left")
    late = F.when(F.col("n") > 0, F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).otherwise(0.0)
    summed = met.groupBy("read").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0))).alias("n_known"),
        F.sum("base").alias("base"), F.sum("model").alias("model"), F.sum(late).alias("late"),
    )
    return summed.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.col("late")).alias("base_score"), (F.col("model") + F.col("late")).alias("score"))
