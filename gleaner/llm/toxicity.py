"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Trained in numpy on a bounded sample of labelled rows; every overlapping window of
every text is scored, and a document's score is that of its worst window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, columns, fold

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
THRESHOLD = 0.3


@dataclass(frozen=True)
class Settings:
    """Sizes of the network and of its training.

    Windows of ``window`` words begin every ``stride`` words. A word of more than ``piece`` bytes,
    such as a sentence of a script without spaces, stands as overlapping pieces. The sample takes the
    labelled rows of either class that come first by the hash of their id, at most
    ``per_class`` of each, with texts of at most ``sample_bytes``. Training takes ``steps``
    batches, in which a share of the words is known by its letters alone.
    """

    window: int = 24
    stride: int = 12
    buckets: int = 1 << 13
    width: int = 8
    hidden: int = 8
    grams: tuple[int, ...] = (3, 4, 5)
    piece: int = 24
    per_class: int = 1_500
    sample_bytes: int = 1 << 16
    steps: int = 280
    batch: int = 128
    forget_words: float = 0.3
    rate: float = 0.01
    table_rate: float = 0.0005
    seed: int = 11


@dataclass
class Network:
    """Parameters by name; ``calibration`` turns the largest logit of a document into log odds."""

    settings: Settings
    p: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, float] = (1.0, 0.0)


def split_words(text: str, s: Settings) -> list[bytes]:
    """Words in lower case, parted by white space; a long one as pieces that begin every half piece, at whole letters."""
    words = text.lower().encode("utf-8", "replace").split()
    if not words or len(max(words, key=len)) <= s.piece:
        return words
    return [p for w in words for p in ((w,) if len(w) <= s.piece else word_pieces(w, s.piece))]


def word_pieces(word: bytes, size: int) -> list[bytes]:
    def whole(i: int) -> int:
        while i < len(word) and word[i] & 0xC0 == 0x80:
            i += 1
        return i

    return [word[whole(i) : whole(i + size)] for i in range(0, len(word) - size + size // 2, size // 2)]


@dataclass
class Spelled:
    """Buckets of words and of their character n-grams: those of word i are ``grams[starts[i] : starts[i] + counts[i]]``."""

    word: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    grams: np.ndarray

    def take(self, index: np.ndarray) -> Spelled:
        counts = self.counts[index]
        ends = np.cumsum(counts)
        at = np.repeat(self.starts[index] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
        return Spelled(self.word[index], ends - counts, counts, self.grams[at])


def spell(words: list[bytes], s: Settings) -> Spelled:
    """Hash words and their byte n-grams."""
    shown = [b"^" + w + b"$" for w in words]
    data = np.frombuffer(b"".join(shown), np.uint8).astype(np.uint64)
    lengths = np.array([len(w) for w in shown], np.int64)
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(shown)), lengths)
    room = (begin + lengths)[owner] - np.arange(len(data))
    owners, grams = [], []
    for n in s.grams:
        at = np.flatnonzero(room >= n)
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = (code ^ data[at + k]) * np.uint64(0x100000001B3)
        owners.append(owner[at])
        grams.append(((code ^ (code >> np.uint64(29))) % np.uint64(s.buckets)).astype(np.int64))
    owners_all, flat = np.concatenate(owners), np.concatenate(grams)
    order = np.argsort(owners_all, kind="stable")
    counts = np.bincount(owners_all, minlength=len(words))
    return Spelled(np.array([zlib.crc32(w) % s.buckets for w in words], np.int64), np.cumsum(counts) - counts, counts, flat[order])


def spell_many(words: list[bytes], s: Settings, part: int = 16_384) -> Spelled:
    """As ``spell``, a part at a time, so that the larger intermediate arrays stay small."""
    parts = [spell(words[i : i + part], s) for i in range(0, len(words), part)]
    counts = np.concatenate([p.counts for p in parts])
    return Spelled(np.concatenate([p.word for p in parts]), np.cumsum(counts) - counts, counts, np.concatenate([p.grams.astype(np.int32) for p in parts]))


def fresh(s: Settings) -> Network:
    rng = np.random.default_rng(s.seed)
    d, h = 2 * s.width, s.hidden

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {"word": normal(s.buckets, s.width, scale=0.05), "char": normal(s.buckets, s.width, scale=0.05)}
    for side in "fb":
        p |= {f"W{side}": normal(d, 3 * h, scale=d**-0.5), f"b{side}": np.zeros(3 * h, np.float32), f"U{side}": normal(h, 3 * h, scale=h**-0.5)}
    p |= {"A": normal(2 * h, 2 * h, scale=(2 * h) ** -0.5), "a": normal(2 * h, scale=0.3), "o": normal(2 * h, scale=0.3), "c": np.full(1, -2, np.float32)}
    return Network(s, p)


def inputs(p: dict[str, np.ndarray], words: Spelled) -> np.ndarray:
    """Vectors of words: the word's row beside the mean row of its n-grams (a word has one at least: its borders and a byte)."""
    if not len(words.word):
        return np.zeros((0, 2 * p["word"].shape[1]), np.float32)
    sums = np.add.reduceat(p["char"][words.grams], words.starts, axis=0)
    return np.concatenate([p["word"][words.word], sums / words.counts[:, None].astype(np.float32)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def recur(gates: np.ndarray, u: np.ndarray, valid: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of one direction. gates: steps x windows x 3h, already with bias; padded steps keep the state."""
    steps, n, h = gates.shape[0], gates.shape[1], u.shape[0]
    state, out = np.zeros((n, h), np.float32), np.empty((steps, n, h), np.float32)
    for t in range(steps):
        g = gates[t]
        zr = sigmoid(g[:, : 2 * h] + state @ u[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        side = state @ u[:, 2 * h :]
        new = np.tanh(g[:, 2 * h :] + r * side)
        move = (1 - z) * valid[t][:, None]
        if keep is not None:
            keep.append((state, z, r, side, new))
        state = state + move * (new - state)
        out[t] = state
    return out


def back(grad: np.ndarray, keep: list, u: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates and of u, from those of the states."""
    steps, n, h = grad.shape
    gates, du, carry = np.zeros((steps, n, 3 * h), np.float32), np.zeros_like(u), np.zeros((n, h), np.float32)
    for t in range(steps - 1, -1, -1):
        state, z, r, side, new = keep[t]
        v = valid[t][:, None]
        d = grad[t] + carry
        dnew = d * (1 - z) * v * (1 - new * new)
        dz = d * (state - new) * v * z * (1 - z)
        dr = dnew * side * r * (1 - r)
        gates[t] = np.concatenate([dz, dr, dnew], axis=1)
        inner = np.concatenate([dz, dr, dnew * r], axis=1)
        du += state.T @ inner
        carry = d * (1 - (1 - z) * v) + inner @ u.T
    return gates, du


def pooled(p: dict[str, np.ndarray], states: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Logits of the windows by attention over their steps; also the parts that training needs."""
    inner = np.tanh(states @ p["A"])
    marks = np.where(valid > 0, inner @ p["a"], -1e9)
    weight = np.exp(marks - marks.max(0)) * (valid > 0)
    weight /= np.maximum(weight.sum(0), 1e-9)
    mean = np.einsum("tn,tnh->nh", weight, states)
    return mean @ p["o"] + p["c"][0], inner, weight, mean


def forward(p: dict[str, np.ndarray], gates: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Logits. gates: steps x windows x 6h, forward direction first."""
    h3 = gates.shape[2] // 2
    ahead = recur(gates[:, :, :h3], p["Uf"], valid)
    behind = recur(gates[::-1, :, h3:], p["Ub"], valid[::-1])[::-1]
    return pooled(p, np.concatenate([ahead, behind], axis=2), valid)[0]


def projected(p: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Gate inputs of both directions for word vectors."""
    return np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], axis=1).astype(np.float32)


def window_index(lengths: list[int], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word positions (windows x steps), which of them exist, and each window's text. A text without words has one empty window."""
    starts = [np.arange(0, max(n - s.window + s.stride, 1), s.stride) for n in lengths]
    owner = np.repeat(np.arange(len(lengths)), [len(x) for x in starts])
    length = np.array(lengths, np.int64)[owner] if len(owner) else np.zeros(0, np.int64)
    base = (np.cumsum(lengths) - lengths)[owner] if len(owner) else length
    inside = (np.concatenate(starts) if starts else np.zeros(0, np.int64))[:, None] + np.arange(s.window)
    valid = inside < length[:, None]
    return np.where(valid, base[:, None] + inside, 0), valid, owner


class Scorer:
    """Scores texts; remembers the gate inputs of words met before."""

    def __init__(self, network: Network, remembered: int = 80_000, windows: int = 1_024):
        self.network, self.remembered, self.windows = network, remembered, windows
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows = np.zeros((0, 6 * self.network.settings.hidden), np.float32)
        self.used = 0

    def learn(self, fresh_words: list[bytes]) -> None:
        s, p = self.network.settings, self.network.p
        need = self.used + len(fresh_words)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need, 2 * len(self.rows)) - len(self.rows), self.rows.shape[1]), np.float32)])
        for i in range(0, len(fresh_words), 4_096):
            part = fresh_words[i : i + 4_096]
            self.rows[self.used : self.used + len(part)] = projected(p, inputs(p, spell(part, s)))
            self.used += len(part)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of every window and the text that it belongs to."""
        if len(self.known) > self.remembered:
            self.forget()
        known, fresh_words, numbers, lengths = self.known, [], [], []
        for text in texts:
            words = split_words(text, self.network.settings)
            for w in words:
                if w not in known:
                    known[w] = len(known)
                    fresh_words.append(w)
            numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            lengths.append(len(words))
        self.learn(fresh_words)
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        if not len(flat):
            flat = np.zeros(1, np.int64)
        index, valid, owner = window_index(lengths, self.network.settings)
        rows = self.rows if len(self.rows) else np.zeros((1, 6 * self.network.settings.hidden), np.float32)
        out = np.empty(len(owner), np.float32)
        for i in range(0, len(owner), self.windows):
            part = slice(i, i + self.windows)
            gates = rows[flat[index[part].T]]
            out[part] = forward(self.network.p, gates, valid[part].T.astype(np.float32))
        return out, owner

    def documents(self, texts: list[str]) -> np.ndarray:
        """Largest logit of each text."""
        logits, owner = self.logits(texts)
        out = np.full(len(texts), -np.inf)
        np.maximum.at(out, owner, logits)
        return out


def start_rows(network: Network, words: Spelled, numbers: list[np.ndarray], y: np.ndarray) -> None:
    """Start the first coordinate of both tables with the log odds of their words and n-grams among the labelled texts."""
    s = network.settings
    counts = {"word": np.zeros((2, s.buckets)), "char": np.zeros((2, s.buckets))}
    for own, label in zip(numbers, y.astype(int), strict=True):
        met = words.take(np.unique(own))
        counts["word"][label, np.unique(met.word)] += 1
        counts["char"][label, np.unique(met.grams)] += 1
    n = np.array([(y == 0).sum(), (y == 1).sum()])[:, None]
    for name, c in counts.items():
        rate = (c + 0.5) / (n + 1)
        trust = c.sum(0) / (c.sum(0) + 10)
        network.p[name][:, 0] = np.clip((np.log(rate[1]) - np.log(rate[0])) * trust, -2, 4) * 0.5


def train(texts: list[str], labels: np.ndarray, s: Settings = Settings(), toxic_share: float | None = None) -> Network:
    """Fit on whole texts with one label each: in every round the worst window of each text, and a random one of each clean text, are learnt.

    Without rows of both classes the network only knows the share of toxic rows.
    """
    y = np.asarray(labels, np.float32)
    network = fresh(s)
    share = float(y.mean() if toxic_share is None else toxic_share) if len(y) else 0.0
    if not 0 < y.sum() < len(y):
        network.calibration = (0.0, float(np.log((share + 1e-3) / (1 - share + 1e-3))))
        return network
    vocabulary: dict[bytes, int] = {b"\x00": 0}  # stands where a window has no word
    numbers = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in split_words(t, s)], np.int64) for t in texts]
    words = spell_many(list(vocabulary), s)
    start_rows(network, words, numbers, y)
    flat = np.concatenate([*numbers, np.zeros(1, np.int64)])
    index, valid, owner = window_index([len(x) for x in numbers], s)
    rng = np.random.default_rng(s.seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.p.items()}
    first = np.searchsorted(owner, np.arange(len(y)))
    count = np.bincount(owner, minlength=len(y))
    clean = np.flatnonzero(y == 0)
    step = 0
    while step < s.steps:
        x = np.concatenate([inputs(network.p, words.take(np.arange(i, min(i + 16_384, len(words.word))))) for i in range(0, len(words.word), 16_384)])
        if step == 0:  # the network knows nothing yet: the windows with the largest log odds
            logits = ((x[:, 0] + x[:, s.width])[flat[index]] * valid).max(1)
        else:
            rows = projected(network.p, x)
            logits = np.concatenate([forward(network.p, rows[flat[index[i : i + 2_048].T]], valid[i : i + 2_048].T.astype(np.float32)) for i in range(0, len(owner), 2_048)])
        worst = np.lexsort((-logits, owner))[first]
        spare = first[clean] + (rng.random(len(clean)) * count[clean]).astype(np.int64)
        picked = np.concatenate([worst, spare])
        rng.shuffle(picked)
        for i in range(0, len(picked), s.batch):
            step += 1
            learn_batch(network.p, moments, step, picked[i : i + s.batch], flat, index, valid, y[owner], words, s, rng)
    network.calibration = calibrate(Scorer(network).documents(texts), y, share)
    return network


def learn_batch(p, moments, step, picked, flat, index, valid, y, words, s, rng) -> None:
    """One step of Adam on the logistic loss of some windows."""
    used, place = np.unique(flat[index[picked]], return_inverse=True)
    place = place.reshape(len(picked), -1).T
    mask = valid[picked].T.astype(np.float32)
    words = words.take(used)
    x = inputs(p, words)
    known = (rng.random(len(used)) >= s.forget_words).astype(np.float32)[:, None]
    x[:, : s.width] *= known
    g = projected(p, x)[place]
    h, h3 = s.hidden, 3 * s.hidden
    kept_f, kept_b = [], []
    ahead = recur(g[:, :, :h3], p["Uf"], mask, kept_f)
    behind = recur(g[::-1, :, h3:], p["Ub"], mask[::-1], kept_b)[::-1]
    states = np.concatenate([ahead, behind], axis=2)
    logit, inner, weight, mean = pooled(p, states, mask)
    target = y[picked]
    d = ((sigmoid(logit) - target) / len(picked)).astype(np.float32)
    grads = {"o": mean.T @ d, "c": np.array([d.sum()], np.float32)}
    dmean = d[:, None] * p["o"]
    dweight = np.einsum("nh,tnh->tn", dmean, states)
    dmark = weight * (dweight - (weight * dweight).sum(0))
    dinner = dmark[:, :, None] * p["a"] * (1 - inner * inner)
    grads["a"] = np.einsum("tn,tnh->h", dmark, inner)
    grads["A"] = np.einsum("tnh,tnk->hk", states, dinner)
    dstates = weight[:, :, None] * dmean + dinner @ p["A"].T
    gates_f, grads["Uf"] = back(dstates[:, :, :h], kept_f, p["Uf"], mask)
    gates_b, grads["Ub"] = back(dstates[::-1, :, h:], kept_b, p["Ub"], mask[::-1])
    dg = np.zeros((len(used), 2 * h3), np.float32)
    np.add.at(dg, place.reshape(-1), np.concatenate([gates_f, gates_b[::-1]], axis=2).reshape(-1, 2 * h3))
    grads["Wf"], grads["Wb"] = x.T @ dg[:, :h3], x.T @ dg[:, h3:]
    grads["bf"], grads["bb"] = dg[:, :h3].sum(0), dg[:, h3:].sum(0)
    dx = dg[:, :h3] @ p["Wf"].T + dg[:, h3:] @ p["Wb"].T
    grads["word"], grads["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
    np.add.at(grads["word"], words.word, dx[:, : s.width] * known)
    each = (dx[:, s.width :] / words.counts[:, None]).astype(np.float32)
    np.add.at(grads["char"], words.grams, np.repeat(each, words.counts, axis=0))
    for k, grad in grads.items():
        m, v = moments[k]
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        rate = s.table_rate if k in ("word", "char") else s.rate
        p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


def calibrate(best: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the label on the largest logit, with classes weighted by their true share."""
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    x = np.stack([best, np.ones_like(best)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.linalg.solve(hess, x.T @ (weight * (q - y)) + 1e-2 * (w - [1.0, 0.0]))
    return float(np.clip(w[0], 0.05, 4.0)), float(w[1])


def labelled_sample(documents: DataFrame, labels: DataFrame, s: Settings, id: str, text: str, label: str, folds: int, held_fold: int) -> tuple[DataFrame, float]:
    """Texts and labels of the sample, and the share of toxic ones among all labelled rows outside the held-out fold.

    Ids with several labels count as toxic if one says so; of repeated ids one row is taken.
    """
    known = columns(labels, doc_id=id, toxic=label).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold("doc_id", folds) != held_fold))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = totals.get(1, 0) / max(1, totals.get(1, 0) + totals.get(0, 0))
    picked = [known.filter(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_class) for v in (0, 1)]
    chosen = picked[0].unionByName(picked[1])
    texts = columns(documents, doc_id=id, text=text).filter(F.octet_length("text") <= s.sample_bytes)
    joined = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 x per_class rows
    return joined.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), share


def score_toxicity(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held_fold: int = 2) -> DataFrame:
    """One row per document: held_out, score from 0 to 1, and predicted (score of 0.3 or more).

    Null counts as empty; a text without words is scored by its one empty window. Labels
    of the held-out fold are never read. Ids may be null or repeat; each row is scored
    alone. Without labels every score is near 0.
    """
    network = fit(documents, labels, s, id, text, label, folds, held_fold)
    sent = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(network))
    rows = columns(documents, doc_id=id, text=text).select("doc_id", (fold("doc_id", folds) == held_fold).alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(sent.value)
        scorer = Scorer(own)
        slope, shift = own.calibration
        for part, raw in chunks(batches):
            best = scorer.documents([b.decode("utf-8", "replace") for b in raw])
            score = 1 / (1 + np.exp(-np.clip(slope * best + shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, SCHEMA)


def fit(documents: DataFrame, labels: DataFrame, s: Settings, id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, held_fold: int = 2) -> Network:
    """The network, trained in a task: the driver's memory holds its parameters only, neither the sample nor the steps."""
    sample, share = labelled_sample(documents, labels, s, id, text, label, folds, held_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += batch.column("text").to_pylist()
            y += batch.column("toxic").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(train(texts, np.array(y, np.float32), s, share))], pa.binary())], ["network"])

    found = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(run, "network binary").first()
    return cloudpickle.loads(bytes(found["network"])) if found else train([], np.zeros(0), s, share)


def drop_toxic(documents: DataFrame, labels: DataFrame, s: Settings = Settings(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose text is not predicted toxic, judged row by row."""
    network = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(fit(documents, labels, s, id, text)))
    place = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = cloudpickle.loads(network.value)
        scorer = Scorer(own)
        slope, shift = own.calibration
        for part, raw in chunks(batches, place):
            best = scorer.documents([b.decode("utf-8", "replace") for b in raw])
            score = 1 / (1 + np.exp(-np.clip(slope * best + shift, -30, 30)))
            yield part.filter(pa.array(score < THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
