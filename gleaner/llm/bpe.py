"""Byte-level BPE by batched merge rounds over one flat array of symbols."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from .common import chunks, columns

#: The pattern of byte-level BPE pre-tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int64).max
#: Pieces that a task remembers before it starts afresh, and characters of a text that are cut into pieces at once.
REMEMBERED, SPAN = 120_000, 1 << 20
SCHEMA = "doc_id long, token_ids array<int>, n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in vocabulary files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass
class Tables:
    """Sorted pair keys with rank and result, the symbol of each byte, and the bytes of each symbol."""

    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    of_byte: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    letters: np.ndarray
    special: dict[str, int]
    size: int


def load_tables(path: str) -> Tables:
    """Read a tokenizers file of a byte-level BPE. Bounded by its vocabulary."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, merges = data["model"]["vocab"], data["model"]["merges"]
    special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
    size = max([*vocab.values(), *special.values()]) + 1
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    keys = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
    merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    letters = byte_letters()
    of_byte = np.zeros(256, np.int64)
    for c, b in letters.items():
        of_byte[b] = vocab[c]
    spelled = [b""] * size
    for word, i in vocab.items():
        spelled[i] = bytes(letters[c] for c in word) if all(c in letters for c in word) else word.encode()
    for word, i in special.items():
        spelled[i] = word.encode()
    lengths = np.array([len(s) for s in spelled], np.int64)
    return Tables(keys[order], order.astype(np.int64), merged[order], of_byte, np.cumsum(lengths) - lengths, lengths, np.frombuffer(b"".join(spelled), np.uint8), special, size)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of many runs, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def find_pairs(left: np.ndarray, right: np.ndarray, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Rank and result of each pair; rank NONE where no merge exists."""
    if not len(tables.keys):
        return np.full(len(left), NONE), np.zeros(len(left), np.int64)
    wanted = left * tables.size + right
    at = np.minimum(np.searchsorted(tables.keys, wanted), len(tables.keys) - 1)
    return np.where(tables.keys[at] == wanted, tables.ranks[at], NONE), tables.merged[at]


def merge_words(words: list[bytes], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words in one array, and how many each word has.

    A round merges, in every unfinished word, all occurrences of its pair of lowest
    rank from left to right; only pairs beside a merge are looked up again.
    """
    counts = np.array([len(w) for w in words], np.int64)
    symbols = tables.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), counts)
    rank, result = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
    inside = np.flatnonzero(owner[1:] == owner[:-1])
    rank[inside], result[inside] = find_pairs(symbols[inside], symbols[inside + 1], tables)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        lengths = np.diff(np.r_[first, len(owner)])
        least = np.repeat(np.minimum.reduceat(rank, first), lengths)
        over = least == NONE
        if over.any():
            done.append((owner[over], symbols[over]))
            symbols, owner, rank, result, least = (x[~over] for x in (symbols, owner, rank, result, least))
            if not len(symbols):
                break
        at = np.flatnonzero(rank == least)
        # In a run such as a a a the pairs overlap: every second one counts.
        head = np.maximum.accumulate(np.where(np.r_[True, at[1:] != at[:-1] + 1], np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - head) % 2 == 0]
        symbols[at] = result[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        now = place[at]
        symbols, owner, rank, result = symbols[keep], owner[keep], rank[keep], result[keep]
        touched = np.unique(np.r_[now, now[now > 0] - 1])
        rank[touched] = NONE
        touched = touched[touched + 1 < len(symbols)]
        touched = touched[owner[touched] == owner[touched + 1]]
        rank[touched], result[touched] = find_pairs(symbols[touched], symbols[touched + 1], tables)
    owners = np.concatenate([o for o, _ in done]) if done else np.zeros(0, np.int64)
    flat = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    return flat[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


class Encoder:
    """Remembers the symbols of the pieces that a task has met."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.pieces = regex.compile(PIECES)
        self.cut = regex.compile(r"(?<=\S) (?=\S)")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(tables.special, key=len, reverse=True))) + ")") if tables.special else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.counts = (np.zeros(0, np.int64) for _ in range(3))

    def spans(self, text: str) -> Iterator[str]:
        """The text in spans between which no piece lies across: cut before one space between other characters."""
        start = 0
        while len(text) - start > SPAN:
            m = self.cut.search(text, start + SPAN)
            if not m:
                break
            yield text[start : m.start()]
            start = m.start()
        yield text[start:]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        fresh: list[bytes | int] = []
        known = self.known

        def number(piece: str) -> int:
            i = known.get(piece)
            if i is None:
                i = known[piece] = len(known)
                fresh.append(piece.encode("utf-8", "replace"))
            return i

        found, ends = [], []
        for text in texts:
            runs = self.specials.split(text) if self.specials else [text]
            own = []
            for run in runs:
                if run in self.tables.special:
                    own.append(np.array([-1 - self.tables.special[run]], np.int64))
                else:
                    own += [np.fromiter(map(number, self.pieces.findall(span)), np.int64) for span in self.spans(run)]
            found += own
            ends.append(sum(map(len, own)))
        if fresh:
            flat, counts = merge_words(fresh, self.tables)
            begin = len(self.flat) + np.cumsum(counts) - counts
            self.flat, self.starts, self.counts = np.r_[self.flat, flat], np.r_[self.starts, begin], np.r_[self.counts, counts]
        index = np.concatenate(found) if found else np.zeros(0, np.int64)
        special = index < 0
        lengths = np.where(special, 1, self.counts[np.maximum(index, 0)] if len(self.counts) else 1)
        ids = self.flat[np.where(np.repeat(special, lengths), 0, ragged(np.where(special, 0, self.starts[np.maximum(index, 0)] if len(self.starts) else 0), lengths))] if len(self.flat) else np.zeros(int(lengths.sum()), np.int64)
        at = np.cumsum(lengths) - lengths
        ids[at[special]] = -1 - index[special]
        stops = np.r_[0, np.cumsum(lengths)][np.cumsum(ends)]
        return np.split(ids, stops[:-1])

    def decode(self, ids: np.ndarray) -> str:
        t = self.tables
        return t.letters[ragged(t.starts[ids], t.lengths[ids])].tobytes().decode("utf-8", "replace")


def bpe_round_trip(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its token ids, their digest and that of the decoded text.

    Null counts as empty and has no tokens. A special token's text becomes that token.
    Bytes that are no UTF-8 count as U+FFFD. ``round_trip`` says whether decoding gave
    the text again. Ids may be null or repeat. The tables are sent to the tasks; their
    size is bounded by the vocabulary.
    """
    tables = documents.sparkSession.sparkContext.broadcast(cloudpickle.dumps(load_tables(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(cloudpickle.loads(tables.value))
        for part, raw in chunks(batches):
            texts = [b.decode("utf-8", "replace") for b in raw]
            ids = encoder.encode(texts)
            decoded = [encoder.decode(x) for x in ids]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
                    pa.array([d == t for d, t in zip(decoded, texts, strict=True)], pa.bool_()),
                ],
                ["doc_id", "token_ids", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    return columns(documents, doc_id=id, text=text).mapInArrow(run, SCHEMA)
