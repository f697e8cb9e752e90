"""Cost-balanced packing of documents into token sequences.

Each task packs the documents of its own partition in groups of about ``group_tokens`` tokens; so
nothing is shuffled, memory is bounded by a group, and a lost task is simply run again. A group of
X tokens gets X div capacity full sequences and, for the rest, short ones whose lengths are the
powers of two that add up to it; so every sequence ends exactly full and none is padded. Pieces
longer than a sequence are cut first. Pieces then go in descending length to the sequence with the
lowest estimated cost (linear plus quadratic in the piece's length) that has room for them, whatever
their number; only what fits in no sequence whole is cut, over the largest gaps.

Nulls and empty texts: no token but the end token. Repeated rows and ids are packed as they come.
Very long texts are cut over several sequences. A table without rows gives no piece.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from lumenvec.llm.common import arrow_map

CAPACITY = 2048
END = 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
#: str.split() would also cut at these.
UNIT_SEPARATORS = re.compile("[\x1c-\x1f]")


class WordEncoder:
    """Token ids of whole texts by a tokenizer that encodes each white-space separated word alone.

    Words are looked up in two generations of a bounded table. A word of printable ASCII and
    accented Latin letters, which normalisation only lower-cases, is cut as the tokenizer's own
    pattern cuts it and goes straight to the tokenizer's model; any other word goes through the
    whole tokenizer.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ſ]+")
    PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ſ]+|[0-9]|[^a-z0-9ß-öø-įı-ſ]+")

    def __init__(self, path: str, generation: int = 800_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.generation, self.young, self.old = generation, {}, {}
        self.four_bytes = [t.to_bytes(4, "little") for t in range(self.tokenizer.get_vocab_size())]
        # The model sees bytes as printable characters; the tokenizer's own table of them.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x180)}

    def _word(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            if word.isascii() and word.isalpha():
                tokens = [t.id for t in self.tokenize(word.lower())]
            elif self.PLAIN.fullmatch(word) and "<|" not in word:
                low = word.lower()
                if not word.isascii():
                    pieces = [p.translate(self.shown) for p in ((low,) if low.isalpha() else self.PIECE.findall(low))]
                elif low[:-1].isalpha():  # a word and one sign
                    pieces = (low[:-1], low[-1])
                else:
                    pieces = self.PIECE.findall(low)
                tokens = [t.id for p in pieces for t in self.tokenize(p)]
            else:
                tokens = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = b"".join([self.four_bytes[t] for t in tokens])
        if len(self.young) >= self.generation:
            self.old, self.young = self.young, {}
        self.young[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if text.isascii() and not UNIT_SEPARATORS.search(text):
            words = text.split()
        else:
            for c in "\t\n\x0b\x0c\r":
                text = text.replace(c, " ")
            words = text.split(" ")
        get, word = self.young.get, self._word
        found = [get(w) for w in words]
        if None in found:
            found = [word(w) if ids is None else ids for w, ids in zip(words, found, strict=True)]
        return b"".join(found)


def cost(length: int, linear: float, quadratic: float) -> float:
    return linear * length + quadratic * length * length


def assign(
    lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 1024
) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(document, start, length)`` that hold each token once and have no gap."""
    total = sum(lengths)
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    sequences: list[list[tuple[int, int, int]]] = [[] for _ in room]
    pieces, free = [], 0
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= capacity:  # whole sequences for long documents
            sequences[free].append((doc, start, capacity))
            room[free] = 0
            free, start = free + 1, start + capacity
        if n > start:
            pieces.append((n - start, doc, start))
    pieces.sort(key=lambda p: (-p[0], p[1], p[2]))
    left = []
    # Lengths only fall: a sequence with too little room waits until they fit it, and then stays among those to choose from.
    ready: list[tuple[float, int]] = []
    waiting = [(-room[s], 0.0, s) for s in range(free, len(room))]
    heapq.heapify(waiting)
    for n, doc, start in pieces:
        while waiting and -waiting[0][0] >= n:
            _, spent, s = heapq.heappop(waiting)
            heapq.heappush(ready, (spent, s))
        if not ready:
            left.append((n, doc, start))
            continue
        spent, s = heapq.heappop(ready)
        sequences[s].append((doc, start, n))
        room[s] -= n
        if room[s]:
            heapq.heappush(waiting, (-room[s], spent + cost(n, linear, quadratic), s))
    gaps = sorted((-room[s], s) for s in range(len(room)) if room[s])
    gaps.reverse()  # the largest gap is taken from the end
    for n, doc, start in left:
        while n:
            s = gaps[-1][1]
            take = min(n, room[s])
            sequences[s].append((doc, start, take))
            room[s], n, start = room[s] - take, n - take, start + take
            if not room[s]:
                gaps.pop()
    return sequences


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_tokens: int = 1 << 20, with_ids: bool = True) -> DataFrame:
    """One row for each piece of ``docs (doc_id, text)``, with its token ids if ``with_ids``.

    ``sequence_id`` is unique in the result; ``offset`` is the piece's place in its sequence.
    ``tokenizer`` is the path of a vocabulary file that every machine has.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def emit(ids: list, held: list[bytes], sequence: int) -> tuple[pa.RecordBatch, int]:
        sequences = assign([len(h) // 4 for h in held], capacity)
        columns: list[list] = [[] for _ in range(7)]
        blobs = []
        for pieces in sequences:
            offset = 0
            for doc, start, n in pieces:
                blob = held[doc][4 * start : 4 * (start + n)]
                for column, value in zip(columns, (ids[doc], start, n, zlib.crc32(blob), len(held[doc]) // 4, sequence, offset), strict=True):
                    column.append(value)
                offset += n
                if with_ids:
                    blobs.append(blob)
            sequence += 1
        arrays = [pa.array(c, pa.int64()) for c in columns]
        if with_ids:
            lengths = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
            arrays.append(pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.frombuffer(b"".join(blobs), "<i4"))))
        else:
            arrays.append(pa.nulls(len(columns[0]), pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]), sequence

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder(path), np.array([END], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        ids, held, tokens = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(doc_id)
                held.append(encoder.encode(text.as_py() or "") + end)
                tokens += len(held[-1]) // 4
                if tokens >= group_tokens:
                    out, sequence = emit(ids, held, sequence)
                    yield out
                    ids, held, tokens = [], [], 0
        if held:
            yield emit(ids, held, sequence)[0]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, SCHEMA)
