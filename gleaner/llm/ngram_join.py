"""N-gram Jaccard join by parity sketches, and one document kept of each group of near copies.

Every distinct set of shingles is dealt into segments, more than its size band allows
different shingles, and each segment is the exclusive or of its shingles' hashes. Two
sets within the threshold have the same shingles in some segments at least (pigeonhole);
classes that agree in a segment are candidates. Sketches of parity bits, one flipped by
each shingle, differ in no more bits than the sets do, which rules out most candidates
before any text moves. What is left is verified on the exact sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage

from .common import chunks, columns, connected_components, pairs

#: Fixed odd multipliers of the hash.
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SKETCH = "doc_id long, mark long, n_shingles long, f1 long, f2 long, keys array<long>, bits array<long>"
BODIES = "n_shingles long, f1 long, f2 long, body binary"


@dataclass(frozen=True)
class Join:
    """Shingles of ``words`` words; a pair links when percent-wise intersection >= ``percent`` of the union.

    A size band ends at ``growth`` times its begin. ``block`` members of a segment's
    bucket are compared at once. ``bitmap`` bits tell which documents may be candidates.
    So many of the ``near``est candidates of a class are compared before all others.
    """

    words: int = 3
    percent: int = 90
    growth: float = 1.5
    block: int = 1_024
    bitmap: int = 1 << 26
    near: int = 512

    def most_different(self, both: int) -> int:
        """Largest symmetric difference of two linked sets with so many elements in all."""
        return both * (100 - self.percent) // (100 + self.percent)

    def begin(self, level: int) -> int:
        return math.ceil(self.growth**level)

    def different(self, level: int) -> int:
        """Largest difference of two linked sets below the end of a band."""
        return self.most_different(2 * (self.begin(level + 1) - 1))

    def spare(self, level: int) -> int:
        """Segments beyond those that pigeonhole needs: so many more agree, and so many of little content may be left out."""
        return 1 + (self.different(level) + 1) // 6

    def levels(self, n: int) -> list[int]:
        """The band of a size, and the next one if a linked set may lie there; none where only equal sets link."""
        if n < 1:
            return []
        level = int(math.log(n, self.growth))
        while self.begin(level + 1) <= n:
            level += 1
        while self.begin(level) > n:
            level -= 1
        above = [level + 1] if 100 * n >= self.percent * self.begin(level + 1) else []
        return [x for x in [level, *above] if self.different(x) > 0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hash of each word met; forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(data: bytes, known: WordHash, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in lower case (A-Z).

    A text with fewer words is one shingle; one without words has none. Sets are
    compared by these hashes, two of which agree by chance once in 2^64 pairs.
    """
    found = data.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    wide = min(words, len(found))
    out = np.full(len(found) - wide + 1, wide, np.uint64)
    for i in range(wide):
        out = mix(out * M1 + hashes[i : len(found) - wide + 1 + i])
    return np.unique(out)


def segment_keys(shingles: np.ndarray, level: int, join: Join) -> np.ndarray:
    """Keys of the segments: the exclusive or of their shingles' hashes, mixed with band and place.

    Linked sets have the same shingles in ``spare + 1`` segments or more. Those of the fewest
    shingles are left out, none or all of a size, ``spare`` at most: empty ones would agree in
    unrelated sets. Of two linked sets take the one that leaves out larger sizes: one of those
    that agree is too large for it, and so for the other, as it has the same shingles there.
    """
    n = join.different(level) + 1 + join.spare(level)
    mixed = mix(shingles + M1)
    place = ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    found = np.zeros(n, np.uint64)
    np.bitwise_xor.at(found, place, mixed)
    sizes = np.bincount(place, minlength=n)
    least = np.count_nonzero(np.cumsum(np.bincount(sizes)) <= join.spare(level))
    keys = mix(found * M1 + mix(np.arange(n, dtype=np.uint64) + (np.uint64(level) << np.uint64(40))))
    return keys[sizes >= least]


def parity_sketch(shingles: np.ndarray) -> np.ndarray:
    """Bits of which every shingle flips one: one to two for a shingle, in a power of two of 64-bit words.

    The exclusive or of the halves of a sketch is the sketch of half as many words.
    """
    words = 1 << max(0, int(len(shingles)).bit_length() - 6)
    bits = np.zeros(words, np.uint64)
    mixed = mix(shingles + M2)
    np.bitwise_xor.at(bits, ((mixed >> np.uint64(32)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (mixed & np.uint64(63)))
    return bits


def halved(bits: np.ndarray, words: int) -> np.ndarray:
    """The sketch in so many words, a power of two."""
    while len(bits) > words:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def fingerprints(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart."""
    with np.errstate(over="ignore"):
        sums = (mix(shingles ^ M2).sum(dtype=np.uint64), mix(shingles ^ M3).sum(dtype=np.uint64))
    return int(sums[0].astype(np.int64)), int(sums[1].astype(np.int64))


def ragged_array(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)
    flat = np.concatenate(rows).view(np.int64) if len(rows) else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def sketches(rows: DataFrame, join: Join) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, drawn = WordHash(), set()
        for part, texts in chunks(batches):
            if len(known) > 150_000:
                known.clear()
            if len(drawn) > 100_000:
                drawn.clear()
            sets = [shingle_set(t, known, join.words) for t in texts]
            prints = [fingerprints(s) for s in sets]
            keys = []
            for own, pair in zip(sets, prints, strict=True):
                levels = [] if pair in drawn else join.levels(len(own))  # copies in one task have their keys once
                keys.append(np.concatenate([np.zeros(0, np.uint64), *[segment_keys(own, level, join) for level in levels]]))
                drawn.add(pair)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), ragged_array(keys), ragged_array([parity_sketch(s) for s in sets])],
                ["doc_id", "mark", "n_shingles", "f1", "f2", "keys", "bits"],
            )

    return rows.mapInArrow(run, SKETCH)


def bitmap_of(rows: DataFrame, hash: F.Column, size: int) -> np.ndarray:
    """So many bits, one set for each hash modulo their number; as large for any number of rows.

    The words come as Arrow columns: a row object for each would be some 300 bytes.
    """
    slots = rows.select(F.pmod(hash, F.lit(size)).alias("slot"))
    words = slots.groupBy(F.floor(F.col("slot") / 32).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(slot, 32) AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(size // 32, np.uint32)
    bitmap[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return bitmap


def in_bitmap(bitmap: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bitmap[slots // 32] >> (slots % 32).astype(np.uint32)) & 1 == 1


def bodies(rows: DataFrame, wanted: DataFrame, join: Join) -> DataFrame:
    """The words of one text (node, body) of each wanted class, compressed: a fourth of the size of its set.

    The ids of the wanted classes are sent as a bitmap of their hashes, which has ``bitmap`` bits at any
    size of the input; where it fills up, more texts are sent than needed, none is missed.
    """
    sent = rows.sparkSession.sparkContext.broadcast(bitmap_of(wanted, F.xxhash64("root"), join.bitmap))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, squeeze = WordHash(), zstandard.ZstdCompressor()
        for batch in batches:
            slots = batch.column(0).to_numpy(zero_copy_only=False)
            hit = in_bitmap(sent.value, slots)
            for _, texts in chunks(iter([batch.filter(pa.array(hit))]), size=1 << 20):
                if len(known) > 150_000:
                    known.clear()
                sets = [shingle_set(t, known, join.words) for t in texts]
                prints = [fingerprints(s) for s in sets]
                packed = [squeeze.compress(b" ".join(t.lower().split())) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in prints], pa.int64()), pa.array([b for _, b in prints], pa.int64()), pa.array(packed, pa.binary())],
                    ["n_shingles", "f1", "f2", "body"],
                )

    found = rows.select(F.pmod(F.xxhash64("doc_id"), F.lit(join.bitmap)).alias("slot"), "text").mapInArrow(run, BODIES)
    # One text of each class, then its node: both by the same columns, so the texts are shuffled once.
    found = found.groupBy("n_shingles", "f1", "f2").agg(F.first("body").alias("body"))
    return found.join(wanted.select("node", "n_shingles", "f1", "f2"), ["n_shingles", "f1", "f2"]).select("node", "body")


def bucket_members(drawn: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """(key, node, n, rows) of every segment that two classes or more share; of segments with the same classes, one.

    Until it is known that a key is shared, a class goes by one of its fingerprints alone.
    All keys are shuffled once, added up in the tasks first. Those found to be shared are
    sent as a bitmap of bounded size, and only keys that meet a bit of it are shuffled
    again; where the bitmap fills up, more are shuffled than needed, none is missed.
    """
    keys = drawn.select("f1", F.explode("keys").alias("key"))
    shared = cut_lineage(keys.groupBy("key").agg(F.min("f1").alias("low"), F.max("f1").alias("high")).filter("low < high").select("key"))
    size = join.bitmap
    sent = drawn.sparkSession.sparkContext.broadcast(bitmap_of(shared, F.col("key"), size))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            hit = np.flatnonzero(in_bitmap(sent.value, flat % size))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner[hit])), pa.array(flat[hit])], names=["f1", "key"])

    found = drawn.select("f1", "keys").mapInArrow(meet, "f1 long, key long").join(shared, "key").distinct()
    found = cut_lineage(found.join(classes.select("f1", "node", F.col("n_shingles").alias("n")), "f1").select("key", "node", "n"))
    # Near copies share many segments: one bucket stands for all with its members, told by two 64-bit sums of their hashes.
    alike = [F.bit_xor(F.xxhash64("node", F.lit(seed))).alias(f"s{seed}") for seed in (1, 2)]
    buckets = found.groupBy("key").agg(F.count("*").alias("rows"), *alike).groupBy("rows", "s1", "s2").agg(F.min("key").alias("key"))
    return found.join(buckets.select("key", "rows"), "key")


def with_pivots(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members with their bucket's pivot, and how central each node is: the rows of all its buckets.

    The pivot is the bucket's most central member (ties: the smaller node), so that the
    original of a group of near copies tends to be compared with each of them.
    """
    central = members.groupBy("node").agg(F.sum("rows").alias("central"))
    ranked = members.join(central, "node")
    pivots = ranked.groupBy("key").agg(F.max(F.struct("central", -F.col("node"), "n")).alias("p"))
    return ranked.join(pivots.select("key", (-F.col("p.col2")).alias("pivot"), F.col("p.n").alias("pivot_n")), "key"), central


def near_size(a: str, b: str, join: Join) -> F.Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * join.percent


def not_too_far(candidates: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose parity sketches differ in no more bits than linked sets of their sizes may."""
    left = classes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("bits").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("bits").alias("y"))
    both = candidates.join(left, "a").join(right, "b")
    # Sizes of linked sets are less than a factor of two apart, so their sketches are as long or one is twice as long.
    words = F.least(F.size("x"), F.size("y"))
    half = lambda c: F.when(F.size(c) == words, F.col(c)).otherwise(F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), lambda p, q: p.bitwiseXOR(q)))
    apart = F.aggregate(F.zip_with(half("x"), half("y"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    most = F.floor((F.col("n") + F.col("m")) * (100 - join.percent) / (100 + join.percent))
    return both.filter((F.greatest(F.size("x"), F.size("y")) > 2 * words) | (apart <= most)).select("a", "b")


def verified(candidates: DataFrame, rows: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) whose exact sets are within the threshold."""
    nodes = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = cut_lineage(bodies(rows, cut_lineage(nodes.join(classes.select("node", "root", "n_shingles", "f1", "f2"), "node")), join))
    words, percent = join.words, join.percent

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, open_ = WordHash(), zstandard.ZstdDecompressor()
        last, right = None, None
        for batch in batches:
            if len(known) > 150_000:
                known.clear()
            fits = []
            for node, x, y in zip(*(batch.column(c) for c in ("b", "x", "y")), strict=True):
                if node.as_py() != last:  # pairs come by their second end
                    last, right = node.as_py(), shingle_set(open_.decompress(y.as_py()), known, words)
                left = shingle_set(open_.decompress(x.as_py()), known, words)
                common = len(np.intersect1d(left, right, assume_unique=True))
                fits.append(100 * common >= percent * (len(left) + len(right) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(end), F.col("body").alias(name)) for end, name in (("a", "x"), ("b", "y")))
    return candidates.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def rest_pairs(labelled: DataFrame, classes: DataFrame, join: Join, keep: int) -> DataFrame:
    """Pairs of members of a pivot's buckets whose labels differ and whose parity sketches allow a link.

    Near copies share many buckets, most of them with one pivot, so a pivot's members are
    compared once instead of once in each bucket. One end of a pair at least does not bear
    their commonest label. These members and all members are dealt into blocks, and a block
    of either makes a group, so that no group is larger than two blocks and a pivot with few
    such members makes few groups. Only pairs that pass the bound leave a group, and of each
    such member the ``keep`` ones of the nearest sketches for their sizes; pairs of a member
    that has others are marked as ``more``.
    """
    common = labelled.groupBy("pivot", "label").agg(F.count("*").alias("have"))
    common = common.groupBy("pivot").agg(F.max(F.struct("have", -F.col("label"))).alias("top"), F.sum("have").alias("all"))
    common = common.select("pivot", (-F.col("top.col2")).alias("common"), "all", (F.col("all") - F.col("top.have")).alias("odd")).filter("odd > 0")
    rows = labelled.join(common, "pivot").join(classes.select("node", "bits"), "node")
    blocks = {side: F.ceil(F.col(count) / join.block).cast("int") for side, count in (("odd", "odd"), ("any", "all"))}

    def dealt(side: str, other: str) -> F.Column:
        """A place for each group of this side's block with a block of the other side."""
        own = F.pmod(F.xxhash64("node"), blocks[side]).cast("int")
        return F.transform(F.sequence(F.lit(0), blocks[other] - 1), lambda o: F.struct(F.lit(side == "odd").alias("odd"), (own if side == "odd" else o).alias("low"), (o if side == "odd" else own).alias("high")))

    places = F.concat(dealt("any", "odd"), F.when(F.col("label") != F.col("common"), dealt("odd", "any")).otherwise(F.array()))
    rows = rows.select("pivot", "node", "n", "label", "bits", F.explode(places).alias("place")).select("pivot", "node", "n", "label", "bits", "place.*")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole groups, many at once; the last one of a batch waits for the next."""
        open_ = []
        for batch in batches:
            open_.append(batch)
            table = pa.Table.from_batches(open_).combine_chunks()
            cut = int(borders(table)[-1]) if len(table) else 0
            yield table.slice(0, cut)
            open_ = table.slice(cut).combine_chunks().to_batches()
        yield pa.Table.from_batches(open_, batch.schema) if open_ else None

    def borders(table: pa.Table) -> np.ndarray:
        place = [table.column(c).to_numpy() for c in ("pivot", "low", "high")]
        return np.r_[0, 1 + np.flatnonzero(np.any([x[1:] != x[:-1] for x in place], axis=0))]

    def linked_sketches(some: np.ndarray, every: np.ndarray, bits: list[np.ndarray], n: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs that may link of rows whose sketches have one length and rows of lengths a factor of two apart at most."""
        if not len(every):
            return
        lengths = sorted({len(bits[r]) for r in every})
        sides = [(every[[len(bits[r]) == words for r in every]], min(words, len(bits[some[0]]))) for words in lengths]
        sides = [(j, np.stack([halved(bits[r], words) for r in j]), np.stack([halved(bits[r], words) for r in some])) for j, words in sides]
        step = 1 + (1 << 19) // (1 + len(every) * lengths[-1])
        for begin in range(0, len(some), step):
            i = some[begin : begin + step, None]
            apart = np.concatenate([np.bitwise_count(own[begin : begin + step, None] ^ other[None]).sum(2, dtype=np.int64) for _, other, own in sides], axis=1)
            j = np.concatenate([j for j, *_ in sides])[None]
            fits = (label[i] != label[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * join.percent)
            fits &= apart <= (n[i] + n[j]) * (100 - join.percent) // (100 + join.percent)
            more = fits.sum(1) > keep
            if more.any():
                near = np.argpartition(np.where(fits[more], apart[more] / (n[i[more]] + n[j]), 2), keep - 1, axis=1)[:, :keep]
                fits[more] = False
                fits[np.flatnonzero(more)[:, None], near] = True
            x, y = np.nonzero(fits)
            yield i[x, 0], j[0, y], more[x]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            if table is None or not len(table):
                continue
            node, n, label, odd = (table.column(c).to_numpy() for c in ("node", "n", "label", "odd"))
            bits = [np.asarray(b, np.int64).view(np.uint64) for b in table.column("bits").to_numpy()]
            wide = np.array([len(b) for b in bits])
            a, b, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for rows in np.split(np.arange(len(table)), borders(table)[1:]):
                some, every = rows[odd[rows]], rows[~odd[rows]]
                for words in np.unique(wide[some]):
                    i, j = some[wide[some] == words], every[(wide[every] <= 2 * words) & (words <= 2 * wide[every])]
                    for x, y, left in linked_sketches(i, j, bits, n, label):
                        a.append(node[x])
                        b.append(node[y])
                        more.append(left)
            a, b, more = np.concatenate(a), np.concatenate(b), np.concatenate(more)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(more)], names=["a", "b", "more"])

    dealt_rows = rows.repartition("pivot", "low", "high").sortWithinPartitions("pivot", "low", "high")
    return dealt_rows.mapInArrow(compare, "a long, b long, more boolean").groupBy("a", "b").agg(F.max("more").alias("more"))


def ngram_components(documents: DataFrame, join: Join = Join(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_shingles and component_id, the smallest id reachable by links (itself included).

    Null and wordless texts have no shingles and link with nothing. Equal sets are one
    class from the start, so copies are never paired. Ids may repeat: each row is judged
    by its own text. A null id never names a component unless all its ids are null.

    Links are found in two steps. First every member of a bucket is compared with the
    bucket's pivot; a class takes the most central pivot that it links with as label. Then
    pairs of other members are compared unless they bear the same label, which connects
    them already: of each member with the nearest ones first. Where there are more than
    ``near``, all that is connected by then gets one label, and ``near`` times as many are
    compared, until none is left: a group of copies is not paired, and no link between
    different components' classes is left out.
    """
    return linked_rows(columns(documents, doc_id=id, text=text), join).select("doc_id", "n_shingles", "component_id")


def linked_rows(rows: DataFrame, join: Join) -> DataFrame:
    """One row per row (doc_id, text): its id, the text's hash (``mark``), n_shingles, component_id and a node of its component (``head``)."""
    drawn = cut_lineage(sketches(rows.select("doc_id", F.xxhash64("text").alias("mark"), "text"), join))
    classes = drawn.filter("n_shingles > 0").groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("root"), F.first("bits").alias("bits"))
    classes = cut_lineage(classes.withColumn("node", F.monotonically_increasing_id()))
    members, central = with_pivots(bucket_members(drawn, classes, join))
    members = cut_lineage(members.filter("node != pivot").groupBy("pivot", "node", "n", "pivot_n").agg(F.max("rows").alias("rows")))

    star = members.filter(near_size("n", "pivot_n", join))
    star = star.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()
    star = cut_lineage(not_too_far(star, classes, join))
    links = cut_lineage(verified(star, rows, classes, join))

    ends = pairs(links, ("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")).select(F.col("u").alias("node"), F.col("v").alias("mate"))
    ranked = ends.join(central.withColumnRenamed("node", "mate"), "mate")
    labels = ranked.groupBy("node").agg(F.max(F.struct("central", -F.col("mate"))).alias("best")).select("node", (-F.col("best.col2")).alias("label"))
    grouped = members.filter("rows > 2").select("pivot", "node", "n")
    tested, keep = star, join.near
    while True:
        labelled = grouped.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rest = rest_pairs(labelled, classes, join, keep).join(tested.select("a", "b", F.lit(True).alias("tested")), ["a", "b"], "left")
        rest = cut_lineage(rest)
        links = links.unionByName(verified(rest.filter("tested IS NULL").select("a", "b"), rows, classes, join))
        if rest.filter("more").isEmpty():
            break
        links, tested, keep = cut_lineage(links), tested.unionByName(rest.filter("tested IS NULL").select("a", "b")), keep * join.near
        labels = connected_components(links).withColumnRenamed("root", "label")

    joined = connected_components(links)
    named = classes.select("node", "root", "n_shingles", "f1", "f2").join(joined.withColumnRenamed("root", "head"), "node", "left").withColumn("head", F.coalesce("head", "node"))
    least = named.groupBy("head").agg(F.min("root").alias("component_id"))
    named = named.join(least, "head").select("n_shingles", "f1", "f2", "component_id", "head")
    out = drawn.select("doc_id", "mark", "n_shingles", "f1", "f2").join(named, ["n_shingles", "f1", "f2"], "left")
    return out.select("doc_id", "mark", "n_shingles", "head", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, join: Join = Join(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of linked texts stays: of the smallest id, null ids last.

    Ids may repeat: each row is judged by its own text, told apart by its 64-bit hash, and
    of rows with equal id and text one stays. Rows without shingles all stay.
    """
    found = cut_lineage(linked_rows(columns(documents, doc_id=id, text=text), join))
    order = F.struct(F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("mark").alias("_mark"))
    best = found.filter("n_shingles > 0").groupBy("head").agg(F.min(order).alias("best")).select("best.*", F.lit(False).alias("_bare"))
    bare = found.filter("n_shingles = 0").select(order.alias("best")).select("best.*", F.lit(True).alias("_bare")).distinct()
    none, own, mark = F.col(f"`{id}`").isNull(), F.coalesce(F.col(f"`{id}`"), F.lit(0)), F.xxhash64(F.col(f"`{text}`"))
    rows = documents.select(none.alias("_none"), own.alias("_id"), mark.alias("_mark"), F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"))
    rows = rows.join(best.unionByName(bare), ["_id", "_mark", "_none"]).withColumn("_own", F.when(F.col("_bare"), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    return rows.dropDuplicates(["_id", "_mark", "_none", "_own"]).select("_row.*")


ORACLE = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM worded),
sized AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM shingled),
single AS (SELECT doc_id, unnest(s) AS g FROM shingled),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM single a JOIN single b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM common JOIN sized p ON p.doc_id = x JOIN sized q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
linked AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, b.y FROM reach r JOIN linked b ON r.y = b.x)
SELECT z.doc_id, z.n AS n_shingles, min(r.y) AS component_id FROM sized z JOIN reach r ON r.x = z.doc_id GROUP BY ALL
""".strip()
