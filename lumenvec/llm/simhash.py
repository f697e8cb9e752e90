"""Near duplicates by SimHash fingerprints that meet at the anchors of a covering code.

A 64-bit fingerprint is cut into three blocks of 22, 21 and 21 bits. Two fingerprints with at
most d differing bits differ in at most t = d div 3 bits of one block. The anchors of a block are
the words of the perfect binary Golay code of length 23 (the block padded with zeros): every block
lies within 3 bits of exactly one anchor, its own. A fingerprint is sent to every anchor within
3 + t bits; so it meets, at the other's own anchor, each fingerprint that it must be compared
with. At an anchor, the fingerprints that own it are compared with all that reached it. A block has
4,096 anchors; very large tables meet at those of pairs of blocks, of which there are 16 million.

Nulls and empty texts: no word, fingerprint zero, linked like any other. Rows with equal texts or
repeated ids all appear in the result. A null id takes part through its fingerprint only.
Anchors with very many fingerprints are cut into a grid of bounded cells; no pair is lost.

Near duplicates of five-word shingles (``similar_documents``, ``keep_one``) meet by longer
fingerprints at the same anchors, where all are compared with all, and are linked by the exact
Jaccard similarity of their shingles. A pair above the limit is missed only if it meets nowhere or
its fingerprints differ by far more than expected (README has the measured share).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import Labels, arrow_map, by_key, checkpointed, components, small_batches, star

SEED = 42
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b110001110101
RADIUS = 3
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _again(hashes: np.ndarray) -> np.ndarray:
    """Further hashes from hashes, by the finaliser of the public splitmix64 generator."""
    x = hashes + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 8192):
        part = hashes[k : k + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingles(text: bytes | None, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words, in order; ASCII letters are lower-cased."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return np.array([digest(joined, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - shingle + 1].tolist()
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], "<u8")


def _fold(hashes: np.ndarray, halves: int) -> tuple[int, ...]:
    if not len(hashes):
        return (0,) * halves
    out = [_majority(hashes)]
    for _ in range(halves - 1):
        hashes = _again(hashes)
        out.append(_majority(hashes))
    return tuple(out)


def fingerprint(text: bytes | None, shingle: int, halves: int = 1) -> tuple[int, ...]:
    """Majority bits of the shingles' hashes, 64 for each half."""
    return _fold(shingles(text, shingle), halves)


def _names(halves: int) -> list[str]:
    return ["fp", *[f"fp{k}" for k in range(2, halves + 1)]]


def bag(hashes: np.ndarray) -> np.ndarray:
    """Distinct values for the shingles, sorted: the k-th occurrence of a hash has its own value."""
    hashes = np.sort(hashes)
    at = np.arange(len(hashes))
    first = np.maximum.accumulate(np.where(np.concatenate([[True], hashes[1:] != hashes[:-1]]), at, 0)) if len(hashes) else at
    times = (at - first).astype(np.uint64)
    return np.sort(np.where(times > 0, _again(hashes ^ _again(times)), hashes).view(np.int64))


def fingerprints(docs: DataFrame, shingle: int = 4, halves: int = 1) -> DataFrame:
    """``doc_id, fp`` (signed 64-bit; ``fp2`` and so on with more halves), ``key`` and ``n`` of each row of ``docs``.

    ``key`` is a hash of the shingles as a multiset, and ``n`` their number. Whole texts, one pass,
    no shuffle.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [shingles(t, shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            fps = np.array([_fold(h, halves) for h in hashes], np.uint64).reshape(-1, halves).view(np.int64)
            keys = np.array([_again(h).sum(dtype=np.uint64) for h in hashes], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(fps[:, k]) for k in range(halves)], pa.array(keys), pa.array([len(h) for h in hashes], pa.int64())],
                ["doc_id", *_names(halves), "key", "n"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, " + ", ".join(f"{n} long" for n in _names(halves)) + ", key long, n long")


@lru_cache
def _code(reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the 23 bits; the error patterns of up to ``reach`` bits by syndrome."""
    of_bit = []
    for bit in range(23):
        value = 1 << bit
        for k in range(22, 10, -1):
            if value >> k & 1:
                value ^= GOLAY << (k - 11)
        of_bit.append(value)
    patterns, syndromes = [], []
    for weight in range(reach + 1):
        for places in combinations(range(23), weight):
            syndrome = pattern = 0
            for p in places:
                syndrome ^= of_bit[p]
                pattern |= 1 << p
            patterns.append(pattern)
            syndromes.append(syndrome)
    order = np.argsort(syndromes, kind="stable")
    counts = np.bincount(syndromes, minlength=2048)
    return np.array(of_bit), np.array(patterns)[order], np.concatenate([[0], np.cumsum(counts)[:-1]]), counts


def _block_anchors(fp: np.ndarray, low: int, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many anchors of a block each fingerprint reaches; these, and the bits beyond the covering radius to each."""
    of_bit, patterns, first, counts = _code(reach)
    value = ((fp >> np.uint64(low)) & np.uint64((1 << length) - 1)).astype(np.int64)
    syndrome = np.zeros(len(fp), np.int64)
    for bit in range(length):
        syndrome ^= np.where(value >> bit & 1, of_bit[bit], 0)
    n = counts[syndrome]
    pattern = patterns[np.repeat(first[syndrome], n) + _within(n)]
    excess = np.maximum(np.bitwise_count(pattern.astype(np.uint64)).astype(np.int64) - RADIUS, 0)
    # The upper 12 bits of a code word determine it.
    return n, (np.repeat(value, n) ^ pattern) >> 11, excess


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each of ``counts``, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def anchors(fps: list[np.ndarray], differ: int, paired: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index of the fingerprint, anchor, and whether it is its own, for each block or pair of blocks of a half.

    A fingerprint reaches the anchors within the covering radius plus ``differ`` bits; of a pair of
    blocks, those at which both blocks' bits beyond the radius add up to at most ``differ``.
    """
    blocks = [(fp, *b) for fp in fps for b in BLOCKS]
    if not paired:
        for number, (fp, low, length) in enumerate(blocks):
            n, anchor, excess = _block_anchors(fp, low, length, RADIUS + differ)
            yield np.repeat(np.arange(len(fp)), n), (number << 24) + anchor, excess == 0
        return
    for number, (left, right) in enumerate(p for k in range(0, len(blocks), len(BLOCKS)) for p in combinations(blocks[k : k + len(BLOCKS)], 2)):
        n, a, ea = _block_anchors(*left, RADIUS + differ)
        m, b, eb = _block_anchors(*right, RADIUS + differ)
        index = np.repeat(np.arange(len(n)), n)  # of each left anchor
        times = m[index]
        other = np.repeat((np.cumsum(m) - m)[index], times) + _within(times)
        mine = np.repeat(np.arange(len(a)), times)
        excess = ea[mine] + eb[other]
        near = excess <= differ
        yield index[mine[near]], ((len(blocks) + number) << 24) + (a[mine[near]] << 12) + b[other[near]], excess[near] == 0


def _mix(fp: np.ndarray) -> np.ndarray:
    return (fp * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)


def _close(fps: np.ndarray, n: np.ndarray | None, rows: np.ndarray, cols: np.ndarray, most: int, least: float, block: int = 1 << 20, by_size: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places of ``rows`` and ``cols`` with at most ``most`` differing bits, by blocks.

    Sizes ``n`` too unlike for a similarity of ``least`` are left out. No place meets itself; where
    rows are columns too each pair comes once. ``by_size`` says that both ascend in size: then a block
    of rows meets only the columns of sizes like enough, and the result is the same.
    """
    same = len(rows) == len(cols) and np.array_equal(rows, cols)
    step = max(1, block // max(1, len(cols)))
    # Half the bits of unlike fingerprints differ: 64 of two words, 96 of three (whose counts still fit a byte).
    words = min(2 if most < 40 else 3, fps.shape[1])
    across = [fps[cols, w] for w in range(words)]
    if by_size:
        step, sizes = min(step, 64), n[cols]
    for k in range(0, len(rows), step):
        left, first, last = rows[k : k + step], k if same else 0, len(cols)
        if by_size:
            first = max(first, int(np.searchsorted(sizes, least * n[left[0]])))
            last = int(np.searchsorted(least * sizes, n[left[-1]], "right"))
        right = cols[first:last]
        apart = np.bitwise_count(fps[left, 0][:, None] ^ across[0][first:last])
        for w in range(1, words):
            apart += np.bitwise_count(fps[left, w][:, None] ^ across[w][first:last])
        i, j = np.nonzero(apart <= most)
        keep = i < j if same else left[i] != right[j]
        i, j = left[i[keep]], right[j[keep]]
        if n is not None and len(i):
            like = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j])
            i, j = i[like], j[like]
        if fps.shape[1] > words:
            near = np.bitwise_count(fps[i] ^ fps[j]).sum(1) <= most
            i, j = i[near], j[near]
        if len(i):
            yield i, j


#: From so many fingerprints on, they meet at anchors of pairs of blocks: more copies, far fewer comparisons.
PAIRED_FROM = 1 << 29


class Meeting:
    """How fingerprints meet at anchors: the deal, as rows of one anchor's (or its cell's) records in one value."""

    def __init__(self, halves: int, differ: int, paired: bool, mutual: bool, extra: tuple[str, ...], rows_per_cell: int, cols_per_cell: int):
        self.halves, self.differ, self.paired, self.mutual, self.extra = halves, differ, paired, mutual, extra
        self.rows_per_cell, self.cols_per_cell = rows_per_cell, cols_per_cell
        self.record = np.dtype([("fp", "<u8", (halves,)), ("node", "<i8"), *[(x, "<i8") for x in extra], ("role", "i1")])

    def _of(self, batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros(batch.num_rows, self.record)
        for k in range(self.halves):
            out["fp"][:, k] = batch.column(k).to_numpy().view(np.uint64)
        for k, name in enumerate(("node", *self.extra)):
            out[name] = batch.column(self.halves + k).to_numpy()
        return out

    def _gathered(self, batches: Iterable[pa.RecordBatch], most: int = 16_384) -> Iterator[np.ndarray]:
        held, rows = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, most):
                held.append(self._of(batch.slice(at, most)))
                rows += len(held[-1])
                if rows >= most // (8 if self.paired else 1):
                    yield np.concatenate(held)
                    held, rows = [], 0
        if held:
            yield np.concatenate(held)

    def _anchors(self, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for index, anchor, own in anchors([x["fp"][:, k] for k in range(self.halves)], self.differ, self.paired):
            yield index, anchor, np.ones(len(own), bool) if self.mutual else own

    def count(self, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in self._gathered(batches, 1 << 17):
            for _, anchor, own in self._anchors(x):
                at, place = np.unique(anchor, return_inverse=True)
                total, owned = np.bincount(place), np.bincount(place, own)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(owned.astype(np.int64)), pa.array(total)], ["anchor", "own", "total"])

    def grid(self, fps: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Crowded anchors, and the rows and columns of cells that each is cut into.

        An anchor is crowded if own times total is above that of one cell; single blocks have at most
        4,096 anchors each, and pairs of blocks are so many that only skew makes one crowded.
        """
        found = (
            fps.mapInArrow(self.count, "anchor long, own long, total long")
            .groupBy("anchor").agg(F.sum("own").alias("own"), F.sum("total").alias("total"))
            .filter(F.col("own") * F.col("total") > self.rows_per_cell * self.cols_per_cell)
            .toArrow().sort_by("anchor")
        )
        own, total = found["own"].to_numpy(), found["total"].to_numpy()
        return found["anchor"].to_numpy(), -(-own // self.rows_per_cell), -(-total // self.cols_per_cell)

    def deal(self, grid: tuple[np.ndarray, np.ndarray, np.ndarray]):
        hot, tall, wide = grid

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in self._gathered(batches):
                mixed = _mix(x["fp"][:, 0]).astype(np.int64)
                for index, anchor, own in self._anchors(x):
                    p = q = np.ones(len(anchor), np.int64)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                        crowded = hot[at] == anchor
                        p, q = np.where(crowded, tall[at], 1), np.where(crowded, wide[at], 1)
                    i, j = mixed[index] % p, mixed[index] // p % q
                    # Each is a column in all cells of its column; those that own the anchor are rows in all cells of their row.
                    down, row = np.repeat(np.arange(len(anchor)), p), _within(p)
                    across, column = np.repeat(np.flatnonzero(own), q[own]), _within(q[own])
                    apart = column != j[across]
                    across, column = across[apart], column[apart]
                    entry = np.concatenate([down, across])
                    cell_i, cell_j = np.concatenate([row, i[across]]), np.concatenate([j[down], column])
                    role = np.concatenate([np.where(own[down] & (i[down] == row), 3, 2), np.ones(len(across), np.int64)])
                    order = np.lexsort((cell_j, cell_i, anchor[entry]))
                    entry, cell_i, cell_j = entry[order], cell_i[order], cell_j[order]
                    records = x[index[entry]]
                    records["role"] = role[order]
                    a = anchor[entry]
                    starts = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (cell_i[1:] != cell_i[:-1]) | (cell_j[1:] != cell_j[:-1])])) if len(a) else np.zeros(0, np.int64)
                    offsets = (np.concatenate([starts, [len(a)]]) * self.record.itemsize).astype(np.int32)
                    blob = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(records.tobytes())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[starts]), pa.array(cell_i[starts].astype(np.int32)), pa.array(cell_j[starts].astype(np.int32)), blob], ["anchor", "i", "j", "records"]
                    )

        return run

    def cells(self, fps: DataFrame) -> DataFrame:
        """``anchor, i, j, records``, sorted within its partitions."""
        slim = small_batches(fps.select(*_names(self.halves), "node", *self.extra), 20_000)
        return slim.mapInArrow(self.deal(self.grid(slim)), "anchor long, i int, j int, records binary").repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def read(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, np.ndarray]]:
        """The key and the records of each cell."""
        for key, cell in by_key(batches, ["anchor", "i", "j"]):
            yield key, np.frombuffer(b"".join(cell["records"].to_pylist()), self.record)


def _rows_cols(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.flatnonzero(x["role"] & 1), np.flatnonzero(x["role"] & 2)


def links(fps: DataFrame, most: int = 4, halves: int = 1, differ: int | None = None, paired: bool | None = None, rows_per_cell: int = 4096, cols_per_cell: int = 32768) -> DataFrame:
    """Edges ``a, b`` that connect all of ``fps (fp, node)`` with at most ``most`` differing bits.

    ``fps`` holds each fingerprint once. By default fingerprints meet if they differ in as many bits
    of one block (or pair of blocks, if ``paired``) as some block of each pair surely does. Of the
    links found at one anchor a spanning star is returned: which texts are connected is whole, pairs
    are not all spelt out. ``paired`` None decides by the number of fingerprints; the links are the
    same.
    """
    if paired is None:
        paired = fps.count() >= PAIRED_FROM
    if differ is None:
        differ = most // halves * 2 // len(BLOCKS) if paired else most // (halves * len(BLOCKS))
    meeting = Meeting(halves, differ, paired, False, (), rows_per_cell, cols_per_cell)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in meeting.read(batches):
            labels = Labels(len(x))
            for i, j in _close(x["fp"], None, *_rows_cols(x), most, 0):
                labels.merge(i, j)
            a, b = star(x["node"], labels.root)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return meeting.cells(fps).mapInArrow(compare, "a long, b long").distinct()


#: Jaccard similarity of near duplicates, over five-word shingles.
SIMILAR = 0.8
#: Fingerprints for it: 256 bits in 12 blocks. Pairs that meet at an anchor within one bit more than the covering
#: radius of both, and differ in at most so many bits, are compared by their shingles.
SIMILAR_HALVES, SIMILAR_DIFFER, SIMILAR_BITS = 4, 1, 66
#: Of larger groups at one anchor only a star is compared first.
SMALL_GROUP = 24


def candidates(fps: DataFrame, least: float, halves: int = SIMILAR_HALVES, most: int = SIMILAR_BITS, differ: int = SIMILAR_DIFFER) -> DataFrame:
    """Pairs ``a, b`` of ``fps (fp, fp2, ..., node, n)`` that may be similar, for an exact comparison; and ``crowd``.

    Of a group of more than SMALL_GROUP at an anchor no pairs come, but each member with the smallest
    one, marked as ``crowd``: these say which groups are to be compared in tiles.
    """
    meeting = Meeting(halves, differ, False, True, ("n",), 8192, 16384)
    masks = np.zeros((halves * len(BLOCKS), halves), np.uint64)
    for k in range(len(masks)):
        low, length = BLOCKS[k % len(BLOCKS)]
        masks[k, k // len(BLOCKS)] = ((1 << length) - 1) << low

    def batch(a: np.ndarray, b: np.ndarray, crowd: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), crowd))], ["a", "b", "crowd"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (anchor, *_), x in meeting.read(batches):
            x = x[np.argsort(x["n"], kind="stable")]
            fp, n = np.ascontiguousarray(x["fp"]), np.ascontiguousarray(x["n"])
            rows, cols = _rows_cols(x)
            labels = Labels(len(x))
            for i, j in _close(fp, n, rows, cols, most, least, by_size=True):
                labels.merge(i, j)
            size = np.bincount(labels.root, minlength=len(x))[labels.root]
            small = (size > 1) & (size <= SMALL_GROUP)
            if small.any():
                for i, j in _close(fp, n, rows[small[rows]], cols[small[cols]], most, least, by_size=True):
                    # Those that an earlier block surely brings together come from there.
                    apart = fp[i] ^ fp[j]
                    new = np.ones(len(i), bool)
                    for mask in masks[: anchor >> 24]:
                        new &= np.bitwise_count(apart & mask).sum(1) > differ
                    yield batch(x["node"][i[new]], x["node"][j[new]], False)
            many = size > SMALL_GROUP
            if many.any():
                yield batch(*star(x["node"], np.where(many, labels.root, np.arange(len(x)))), True)

    return meeting.cells(fps).mapInArrow(compare, "a long, b long, crowd boolean").distinct()


#: Words of 64 bits of the filter that picks the texts to compare; false hits only cost work.
FILTER_WORDS = 1 << 18


def _chosen(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` may be in ``nodes (node)``, by a bitmap of fixed size; none is missed."""
    place, bit = F.pmod(F.shiftright("node", 6), F.lit(FILTER_WORDS)), F.pmod("node", F.lit(64)).cast("int")
    bits = nodes.groupBy(place.alias("_place")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    at = F.pmod(F.shiftright("doc_id", 6), F.lit(FILTER_WORDS))
    return docs.join(F.broadcast(bits), at == F.col("_place")).filter(
        F.call_function("shiftrightunsigned", F.col("_bits"), F.pmod("doc_id", F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    ).select("doc_id", "text")


def _bags(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, bag`` of each of ``nodes``, and of a few others; once for each text that an id has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [bag(shingles(t, shingle)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bags, pa.list_(pa.int64()))], ["doc_id", "bag"])

    found = arrow_map(_chosen(docs, nodes), run, "doc_id long, bag array<long>")
    return found.groupBy("doc_id", F.xxhash64("bag").alias("_key")).agg(F.first("bag").alias("bag")).drop("_key")


def similar(docs: DataFrame, pairs: DataFrame, least: float, shingle: int) -> DataFrame:
    """Those of ``pairs (a, b)`` of ids whose texts in ``docs (doc_id, text)`` have a Jaccard similarity of ``least`` or more.

    Shingles that repeat count as often as they do.
    """
    bags = _bags(docs, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), shingle)
    a = bags.select(F.col("doc_id").alias("a"), F.col("bag").alias("_a"))
    b = bags.select(F.col("doc_id").alias("b"), F.col("bag").alias("_b"))
    common = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(a, "a").join(b, "b").filter(common >= F.lit(least) * (F.size("_a") + F.size("_b") - common)).select("a", "b").distinct()


#: Members and shingles of a tile of a large group.
TILE, TILE_SHINGLES = 4096, 1 << 22


def similar_in_groups(docs: DataFrame, members: DataFrame, least: float, shingle: int, most: int = SIMILAR_BITS, halves: int = SIMILAR_HALVES) -> DataFrame:
    """Edges ``a, b`` that connect those of ``members (fp, ..., node, n, grp)`` of a ``grp`` with at most ``most``
    differing bits and a Jaccard similarity of ``least`` or more.

    A group is cut into tiles of bounded size; each pair of tiles is compared in one task, which
    returns only what it connects. Texts near the middle of a group come first, as they connect most
    of it; what is connected is not compared again.
    """
    names = _names(halves)
    shape = members.groupBy("grp").agg(F.count("*").alias("_rows"), F.sum("n").alias("_shingles")).select(
        "grp", F.greatest(F.ceil(F.col("_rows") / TILE), F.ceil(F.col("_shingles") / TILE_SHINGLES)).cast("int").alias("tiles")
    )
    bags = _bags(docs, members.select("node"), shingle)
    tiled = (
        members.join(shape, "grp").withColumn("t", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
        .join(bags, F.col("node") == F.col("doc_id"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select("grp", F.least("t", "other").alias("i"), F.greatest("t", "other").alias("j"), "t", "node", *names, "bag")
        .repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    )

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), cell in by_key(batches, ["grp", "i", "j"]):
            node, t = (cell[c].to_numpy() for c in ("node", "t"))
            fp = np.stack([cell[c].to_numpy().view(np.uint64) for c in names], axis=1)
            bags = cell["bag"].combine_chunks()
            bags = bags.chunk(0) if isinstance(bags, pa.ChunkedArray) else bags
            ends = bags.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            n = np.diff(ends)
            codes = np.unique(bags.flatten().to_numpy(), return_inverse=True)[1]
            marked = np.zeros(int(codes.max(initial=-1)) + 1, np.int64)
            labels = Labels(len(node))
            bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(len(fp), -1), axis=1)
            middle = np.packbits(2 * bits.sum(0, dtype=np.int64) > len(fp)).view("<u8")
            order = np.lexsort((node, np.bitwise_count(fp ^ middle).sum(1)))
            for left, right in _close(fp, n, order[t[order] == i], order[t[order] == j], most, least, 1 << 18):
                open_ = labels.root[left] != labels.root[right]
                left, right = left[open_], right[open_]
                for x in left[np.sort(np.unique(left, return_index=True)[1])].tolist():
                    others = right[left == x]
                    others = others[labels.root[others] != labels.root[x]]
                    if not len(others):
                        continue
                    mine = codes[ends[x] : ends[x + 1]]
                    marked[mine] = 1
                    places = np.repeat(ends[others], n[others]) + _within(n[others])
                    common = np.add.reduceat(marked[codes[places]], np.concatenate([[0], np.cumsum(n[others])[:-1]]))
                    marked[mine] = 0
                    near = others[common >= least * (n[x] + n[others] - common)]
                    labels.merge(np.full(len(near), x), near)
            a, b = star(node, labels.root)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return tiled.mapInArrow(compare, "a long, b long").distinct()


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = SIMILAR) -> DataFrame:
    """``doc_id, component_id`` of each row of ``docs (doc_id, text)``; rows without id don't appear.

    Links are pairs of texts that meet by their fingerprints and have a Jaccard similarity of
    ``least`` or more. Equal texts are one; texts without a word are all equal.
    """
    names = _names(SIMILAR_HALVES)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    rows = checkpointed(fingerprints(plain, shingle, SIMILAR_HALVES))
    once = checkpointed(rows.groupBy(*names, "key", "n").agg(F.min("doc_id").alias("node")))
    worded = once.filter("n > 0").select(*names, "node", "n")
    found = checkpointed(candidates(worded, least))
    near = similar(plain, found.filter("NOT crowd").select("a", "b"), least, shingle)
    groups = components(found.filter("crowd").select("a", "b"))
    roots = groups.select(F.col("root").alias("node")).distinct().withColumn("root", F.col("node"))
    members = checkpointed(worded.join(groups.unionByName(roots), "node").select(*names, "node", "n", F.col("root").alias("grp")))
    roots = components(near.unionByName(similar_in_groups(plain, members, least, shingle)))
    classes = once.join(roots, "node", "left").select(*names, "key", "n", F.coalesce("root", "node").alias("component_id"))
    return rows.join(classes, [*names, "key", "n"]).select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4, halves: int = 1) -> DataFrame:
    """``doc_id, fp, component_id`` of each row of ``docs (doc_id, text)`` (and ``fp2`` with two halves).

    ``component_id`` is the smallest id that links of at most ``most`` differing bits reach.
    """
    names = _names(halves)
    fps = checkpointed(fingerprints(docs, shingle, halves).select("doc_id", *names))
    once = checkpointed(fps.groupBy(*names).agg(F.min("doc_id").alias("node")))
    found = components(links(once.filter("node is not null"), most, halves))
    classes = once.join(found, "node", "left").select(*names, F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, names).select("doc_id", *names, "component_id")


def keep_one(docs: DataFrame, shingle: int = 5, least: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` less all but one of each group of near duplicates, with their columns.

    The row with the smallest id stays. Rows that repeat its id stay with it, as do rows without id.
    """
    found = similar_documents(docs, shingle, least)
    kept = found.filter("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    plain = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"))
    return plain.join(kept, F.col("_id") == F.col("_kept"), "left").filter("_kept is not null or _id is null").select("_row.*")
