"""Compression bands: zstandard ratios of the whole text and of fixed chunks against limits by length."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import chunks, columns

WHITE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, worst_chunk double, best_chunk double, verdict string"
)


@dataclass(frozen=True)
class Bands:
    """Compressed size by plain size. ``limits``: (bytes, least ratio, most ratio), between two lengths
    on a line over the logarithm of the length, beyond the outer ones as there.

    A short text cannot be compressed much and its header weighs more, so both limits
    fall with the length. Chunks of ``chunk`` bytes have limits of their own; the text
    fails when more than ``share`` of its chunks lie outside them. The least ratios lie
    0.01 to 0.03 below those of all texts labelled good at their length; the most ratios leave room
    for scripts of several bytes a letter and exclude base64, which has about 0.76.
    """

    limits: tuple[tuple[int, float, float], ...] = (
        (200, 0.45, 0.97),
        (500, 0.52, 0.88),
        (1_000, 0.48, 0.80),
        (2_000, 0.45, 0.74),
        (4_000, 0.43, 0.72),
        (8_000, 0.407, 0.70),
        (20_000, 0.39, 0.68),
        (50_000, 0.375, 0.68),
        (1_000_000, 0.30, 0.68),
    )
    shortest: int = 200
    chunk: int = 4_096
    chunk_limits: tuple[float, float] = (0.43, 0.72)
    share: float = 0.5
    level: int = 3

    def at(self, size: int) -> tuple[float, float]:
        """Least and most ratio of a text of so many bytes; below ``shortest`` any ratio is fine."""
        if size < self.shortest:
            return 0.0, float("inf")
        sizes, least, most = zip(*self.limits, strict=True)
        where, known = np.log(size), np.log(sizes)
        return float(np.interp(where, known, least)), float(np.interp(where, known, most))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, n)
    m = len(kinds)
    pairs = ids[:-2] * m + ids[1:-1]
    if m > 2_000_000:  # three factors would overflow 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    keys = pairs * m + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def base_measures(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = data.split()
    raw = np.frombuffer(data.translate(None, WHITE), np.uint8)
    seen: set[bytes] = set()
    copies = 0
    for line in data.split(b"\n"):
        if line in seen:
            copies += 1
        elif line.strip(WHITE):
            seen.add(line)
    return len(words), int(np.count_nonzero((raw & 0xC0) != 0x80)), len(data) - len(data.translate(None, SYMBOLS)), copies, repeat_words(words)


def band_verdict(data: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple[bool, float | None, float | None, float | None, str]:
    """Whether the text lies in the bands; ratio of the whole, largest and smallest of the whole chunks, and why."""
    if not data:
        return True, None, None, None, "ok"
    ratio = len(squeeze.compress(data)) / len(data)
    least, most = bands.at(len(data))
    parts = [len(squeeze.compress(data[i : i + bands.chunk])) / bands.chunk for i in range(0, len(data) - bands.chunk + 1, bands.chunk)]
    low, high = bands.chunk_limits
    repeated = sum(p < low for p in parts) > bands.share * len(parts)
    noisy = sum(p > high for p in parts) > bands.share * len(parts)
    why = "repetitive" if ratio < least or repeated else "incompressible" if ratio > most or noisy else "ok"
    return why == "ok", ratio, max(parts, default=None), min(parts, default=None), why


def quality_rules(documents: DataFrame, id: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: the base measures, the compression ratios and whether it is kept.

    Null counts as an empty text, which has no words and fails the base rule. Ids may
    be null or repeat; each row is judged alone. Texts of any length are read whole.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        for part, texts in chunks(batches):
            rows = []
            for data in texts:
                n, chars, symbols, lines, repeats = base_measures(data)
                failed = n < 50 or 100 * repeats > 50 * n
                fits, ratio, worst, best, why = band_verdict(data, bands, squeeze)
                rows.append((n, chars, symbols, lines, repeats, failed, fits and not failed, ratio, worst, best, why))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 3 + [pa.string()]
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *arrays], [f.split()[0] for f in SCHEMA.split(", ")])

    return columns(documents, doc_id=id, text=text).mapInArrow(judge, SCHEMA)
