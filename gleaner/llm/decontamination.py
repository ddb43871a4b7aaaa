"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents become TF-IDF vectors over the benchmark's terms; a
distributed randomised SVD gives the latent space; passages near a benchmark item
there are candidates, which a longest common subsequence and an answer check decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

from .common import chunks, columns

PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Bytes as words see them: A-Z in lower case, ASCII punctuation as white space.
SEEN = bytes(32 if b in PUNCTUATION else b + 32 if 65 <= b <= 90 else b for b in range(256))
MATCHES = "doc_id long, item_id long, cosine double, lcs int, item_words int, answer_ratio double, first_word long"


@dataclass(frozen=True)
class Search:
    """``window`` words (a multiple of ``stride``) every ``stride`` words make a passage; ``rank`` and ``extra`` columns of the SVD's sketch.

    A word weighs its IDF to the power ``emphasis``.

    The space is fitted on every passage of every document and on the items, which weigh
    as much as all documents together. An item of more than ``window`` words is searched in
    pieces of so many. A candidate has a cosine of ``cosine`` or more with a piece and
    ``shared`` of the piece's distinct words. It is a leak if the common subsequence has ``overlap``
    of the item's words, or ``partial`` of them and ``answer`` of those of its last sentence.
    """

    window: int = 32
    stride: int = 16
    rank: int = 128
    extra: int = 16
    emphasis: float = 2.0
    cosine: float = 0.4
    shared: float = 0.4
    overlap: float = 0.75
    partial: float = 0.6
    answer: float = 0.8


def normal_words(data: bytes) -> list[bytes]:
    """Words in lower case (A-Z), parted by white space and ASCII punctuation."""
    return data.translate(SEEN).split()


@dataclass
class Items:
    """The benchmark, which is small: distinct normalised items, terms, and the words of each last sentence."""

    ids: list[list[int | None]]
    words: list[list[bytes]]
    answers: list[list[bytes]]
    terms: dict[bytes, int]


def read_items(benchmark: DataFrame, id: str, text: str) -> Items:
    """Items without words are dropped; equal ones share a row."""
    found: dict[tuple[bytes, ...], tuple[list, list[bytes]]] = {}
    for row in columns(benchmark, item_id=id, text=text).toLocalIterator():
        data = (row["text"] or "").encode()
        words = tuple(normal_words(data))
        if words:
            sentences = [s for s in map(normal_words, re.split(rb"(?<=[.!?])\s+|\n", data)) if s]
            found.setdefault(words, ([], sentences[-1]))[0].append(row["item_id"])
    terms: dict[bytes, int] = {}
    for words in found:
        for w in words:
            terms.setdefault(w, len(terms))
    return Items([i for i, _ in found.values()], [list(w) for w in found], [a for _, a in found.values()], terms)


def pieces(words: list, window: int) -> list[list]:
    """The words in pieces of ``window``; the last piece reaches the end and may overlap the one before."""
    starts = [*range(0, len(words) - window, window), max(0, len(words) - window)]
    return [words[i : i + window] for i in starts]


class TermNumbers:
    """Number of each word: its term, or ``len(terms)`` for any other word."""

    def __init__(self, terms: dict[bytes, int]):
        self.get, self.other = terms.get, len(terms)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Numbers of the words of each text."""
        return [np.fromiter(map(self.get, words, repeat(self.other)), np.int64, len(words)) for words in map(normal_words, texts)]


def blocks(numbers: list[np.ndarray], other: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers in rows of ``stride`` words, each text filled up with ``other``, and how many rows each text has."""
    counts = np.array([max(1, -(-len(x) // stride)) for x in numbers], np.int64)
    rows = np.full(int(counts.sum()) * stride, other, np.int64)
    at = 0
    for own, n in zip(numbers, counts, strict=True):
        rows[at : at + len(own)] = own
        at += n * stride
    return rows.reshape(-1, stride), counts


def passages(counts: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """First block of every passage and its text; the last passage of a text reaches its end."""
    per = np.maximum(1, counts - search.window // search.stride + 1)
    owner = np.repeat(np.arange(len(counts)), per)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    return (np.cumsum(counts) - counts)[owner] + inside, owner


def row_sums(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``weights`` that each row of numbers names; the last row of ``weights`` is zero and is skipped."""
    rows = np.sort(rows, axis=1)  # the words that weigh nothing come last
    filled = (rows < len(weights) - 1).sum(1)
    order = np.argsort(-filled, kind="stable")
    rows, filled = rows[order], filled[order]
    sums = np.zeros((len(rows), weights.shape[1]), np.float32)
    held = np.empty((1_024, weights.shape[1]), np.float32)
    for at in range(0, len(rows), len(held)):  # so few rows at once stay in the processor's cache
        part, most = sums[at : at + len(held)], filled[at : at + len(held)]
        for j in range(int(most[0])):
            n = int(np.searchsorted(-most, -j))  # rows with more than j such words
            part[:n] += np.take(weights, rows[at : at + n, j], axis=0, out=held[:n], mode="clip")
    out = np.empty_like(sums)
    out[order] = sums
    return out


def passage_sums(rows: np.ndarray, counts: np.ndarray, weights: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the terms' rows of ``weights`` over each passage, the passage's first block and its text.

    A passage's vector is linear in its words, so the sums of its strides are added up
    instead of building a sparse row for each passage.
    """
    sums = row_sums(rows, weights)
    first, owner = passages(counts, search)
    last = np.cumsum(counts)[owner] - 1
    out = sums[first].copy()
    for shift in range(1, search.window // search.stride):
        inside = first + shift <= last
        out[inside] += sums[first[inside] + shift]
    return out, first, owner


def term_sums(rows: np.ndarray, spread: np.ndarray, size: int, wide: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Terms met, and for each the sum of its blocks' rows of ``spread``, once for each time that it occurs.

    The blocks of a term are dealt into rows of ``wide``, which are added up first.
    """
    flat = rows.ravel()
    hits = np.flatnonzero(flat < size)
    if not len(hits):
        return hits, np.zeros((0, spread.shape[1]))
    hits = hits[np.argsort(flat[hits], kind="stable")]
    terms, begin, n = np.unique(flat[hits], return_index=True, return_counts=True)
    lines = -(-n // wide)
    top = np.cumsum(lines) - lines
    dealt = np.full(int(lines.sum()) * wide, len(spread), np.int64)
    dealt[np.repeat(top * wide - begin, n) + np.arange(len(hits))] = hits // rows.shape[1]
    each = row_sums(dealt.reshape(-1, wide), np.vstack([spread, np.zeros((1, spread.shape[1]), np.float32)]))
    return terms, np.add.reduceat(each, top, axis=0, dtype=np.float64)


def gram_product(rows: np.ndarray, counts: np.ndarray, weights: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray, float]:
    """For passages P as counts of terms: terms met, their rows of P'P ``weights``, and the sum of squares of P ``weights``."""
    y, first, owner = passage_sums(rows, counts, weights, search)
    # Each word of a passage adds the passage's y to its term: summed for each block first.
    spread = np.zeros((len(rows), weights.shape[1]), np.float32)
    last = np.cumsum(counts)[owner] - 1
    for shift in range(search.window // search.stride):
        inside = first + shift <= last
        spread[first[inside] + shift] += y[inside]
    return *term_sums(rows, spread, len(weights) - 1), float((y.astype(np.float64) ** 2).sum())


def numbered(rows: DataFrame, items: Items) -> DataFrame:
    """Rows (ids, counts, numbers), one for each chunk of texts: their ids, how many words each has, and the words' numbers."""
    terms = rows.sparkSession.sparkContext.broadcast(items.terms)
    kind = number_kind(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TermNumbers(terms.value)
        for part, texts in chunks(batches):
            numbers = known.of(texts)
            counts = np.array([len(x) for x in numbers], np.int64)
            ids = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays([part.column(0).cast(pa.int64())]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([counts.tobytes()]), pa.array([np.concatenate(numbers).astype(kind).tobytes()])], ["ids", "counts", "numbers"])

    return rows.mapInArrow(run, "ids array<long>, counts binary, numbers binary")


def number_kind(items: Items) -> type:
    return np.uint16 if len(items.terms) < 1 << 16 else np.int32


def numbered_chunks(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and numbers of the words of each chunk."""
    for batch in batches:
        for ids, counts, numbers in zip(*batch.columns, strict=True):
            ends = np.cumsum(np.frombuffer(counts.as_py(), np.int64))[:-1]
            yield ids.as_py(), np.split(np.frombuffer(numbers.as_py(), kind).astype(np.int64), ends)


def document_frequencies(words: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many documents each term occurs, and how many documents there are: counted over all of them."""
    size, kind = len(items.terms), number_kind(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size + 1, np.int64), 0
        met = np.zeros(size + 1, bool)
        for _, numbers in numbered_chunks(batches, kind):
            for own in numbers:
                met[:] = False
                met[own] = True
                total[:size] += met[:size]
            seen += len(numbers)
        total[size] = seen
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), pa.array(total)], ["term", "n"])

    counts = words.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(size + 1, np.int64)
    for row in counts:
        df[row["term"]] = row["n"]
    return df[:size], int(df[size])


def latent_space(words: DataFrame, items: Items, idf: np.ndarray, search: Search) -> np.ndarray:
    """Term vectors (terms x rank) of a randomised SVD of the TF-IDF matrix A of all passages and of the items.

    Each pass forms A'(A Q) in the tasks and adds the rows of each term; one pass for
    the range, one for the projection. Only terms x (rank + extra) numbers leave a task.
    The items' rows are scaled to the same sum of squares as all passages, so that every
    term has its place and more documents do not push the items out of the space.
    """
    size, wide = len(items.terms), min(search.rank + search.extra, len(items.terms))
    spark = words.sparkSession
    names = [f"v{j}" for j in range(wide)]
    kind = number_kind(items)
    own = blocks([np.array([items.terms[w] for w in ws], np.int64) for ws in items.words], size, search.stride)

    def product(q: np.ndarray) -> tuple[np.ndarray, float, np.ndarray, float]:
        sent = spark.sparkContext.broadcast(weigh(idf, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size + 1, wide))
            for _, numbers in numbered_chunks(batches, kind):
                terms, sums, squares = gram_product(*blocks(numbers, size, search.stride), sent.value, search)
                total[terms] += sums
                total[size, 0] += squares
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 1)), *[pa.array(c) for c in total.T]], ["term", *names])

        summed = words.mapInArrow(run, ", ".join(["term long", *[f"{n} double" for n in names]])).groupBy("term").agg(*[F.sum(n).alias(n) for n in names]).toPandas()
        out = np.zeros((size + 1, wide))
        out[summed["term"].to_numpy()] = summed[names].to_numpy()
        terms, sums, squares = gram_product(*own, sent.value, search)
        items_out = np.zeros((size, wide))
        items_out[terms] = sums
        return out[:size] * idf[:, None], out[size, 0], items_out * idf[:, None], squares

    y, squares, y_items, squares_items = product(np.random.default_rng(7).standard_normal((size, wide)))
    scale = squares / squares_items if squares > 0 and squares_items > 0 else 1.0
    q, _ = np.linalg.qr(y + scale * y_items)
    b, _, b_items, _ = product(q)
    values, vectors = np.linalg.eigh(q.T @ (b + scale * b_items))
    order = np.argsort(values)[::-1][: search.rank]
    return q @ vectors[:, order]


def weigh(idf: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Rows of the terms times their weights, and a row of zeros for other words."""
    return np.vstack([idf[:, None] * vectors, np.zeros((1, vectors.shape[1]))]).astype(np.float32)


def subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of bits per step (Hyyrö's method)."""
    places: dict[int, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def find_leaks(documents: DataFrame, benchmark: DataFrame, search: Search = Search(), id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row (doc_id, item_id, cosine, lcs, ...) for each document and each item that it holds.

    The best passage is told; ties: the first. Null texts hold nothing, items without
    words are held by nothing, an empty benchmark or table gives no rows. Repeated rows
    each give their rows. The benchmark is the small side: it is gathered and sent to the tasks.
    """
    rows = columns(documents, doc_id=id, text=text)
    spark = rows.sparkSession
    items = read_items(benchmark, item_id, item_text)
    if not items.words:
        return spark.createDataFrame([], MATCHES)
    words = cut_lineage(numbered(rows, items))
    df, n = document_frequencies(words, items)
    idf = (np.log((n + 1) / (df + 1)) + 0.05) ** search.emphasis
    weighted = weigh(idf, latent_space(words, items, idf, search))
    cut = [(q, [items.terms[w] for w in piece]) for q, ws in enumerate(items.words) for piece in pieces(ws, search.window)]
    queries = np.stack([weighted[piece].sum(0) for _, piece in cut])
    queries = (queries / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    sent = spark.sparkContext.broadcast(cloudpickle.dumps((items, cut, weighted, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, cut, weighted, queries = cloudpickle.loads(sent.value)
        other = len(items.terms)
        wanted = [[items.terms[w] for w in ws] for ws in items.words]
        answers = [[items.terms[w] for w in ws] for ws in items.answers]
        # Distinct terms of each piece in a rectangle, filled up with a number that no word has.
        whole = np.array([q for q, _ in cut], np.int64)
        distinct = [list(dict.fromkeys(w)) for _, w in cut]
        table = np.full((len(cut), max(map(len, distinct))), other + 1, np.int64)
        for q, w in enumerate(distinct):
            table[q, : len(w)] = w
        need = np.array([search.shared * len(w) for w in distinct])
        for ids, numbers in numbered_chunks(batches, number_kind(items)):
            rows, counts = blocks(numbers, other, search.stride)
            vectors, start, owner = passage_sums(rows, counts, weighted, search)
            last = np.cumsum(counts)[owner] - 1
            first = (start - (np.cumsum(counts) - counts)[owner]) * search.stride
            norms = np.linalg.norm(vectors, axis=1)
            best: dict[tuple[int, int], tuple] = {}
            for at in range(0, len(vectors), 4_096):
                end = min(at + 4_096, len(vectors))
                near = vectors[at:end] @ queries.T
                p, q = np.nonzero((near >= search.cosine * norms[at:end, None]) & (norms[at:end, None] > 0))
                present = np.zeros((end - at, other + 2), bool)
                for shift in range(search.window // search.stride):
                    inside = np.flatnonzero(start[at:end] + shift <= last[at:end])
                    present[inside[:, None], rows[start[at:end][inside] + shift]] = True
                both = np.concatenate([present[p[i : i + 50_000, None], table[q[i : i + 50_000]]].sum(1) for i in range(0, len(p), 50_000)]) if len(p) else np.zeros(0)
                hit = np.flatnonzero(both >= need[q])
                # Of an item's pieces that a passage is near, the nearest counts; the subsequence is taken once.
                hit = hit[np.lexsort((-near[p[hit], q[hit]], whole[q[hit]], p[hit]))]
                hit = hit[np.r_[True, (np.diff(p[hit]) != 0) | (np.diff(whole[q[hit]]) != 0)]] if len(hit) else hit
                for i in hit:
                    k, item, begin = int(owner[at + p[i]]), int(whole[q[i]]), int(first[at + p[i]])
                    size = len(wanted[item])
                    passage = numbers[k][max(0, begin - size) : begin + search.window + size].tolist()
                    lcs = subsequence(wanted[item], passage)
                    if lcs < search.partial * size:
                        continue
                    said = subsequence(answers[item], passage) / len(answers[item])
                    found = (lcs, float(near[p[i], q[i]] / norms[at + p[i]]), said, begin)
                    if (lcs >= search.overlap * size or said >= search.answer) and found[:2] > best.get((k, item), (-1,))[:2]:
                        best[k, item] = found
            out = [(ids[k], i, cos, lcs, len(items.words[q]), said, at) for (k, q), (lcs, cos, said, at) in sorted(best.items()) for i in items.ids[q]]
            cols = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")])

    return words.mapInArrow(run, MATCHES)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, search: Search = Search(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item. Every row is judged by its own text, told apart by its 64-bit hash, whatever its id."""
    mark = F.xxhash64(F.col(f"`{text}`"))
    leaks = find_leaks(documents.select(mark.alias("_mark"), F.col(f"`{text}`").alias("_text")), benchmark, search, "_mark", "_text")
    return documents.join(leaks.select(F.col("doc_id").alias("_leak")).distinct(), mark == F.col("_leak"), "left_anti")
