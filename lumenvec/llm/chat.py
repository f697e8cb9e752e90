"""Chat formatting by token-level assembly.

A turn becomes the reserved id that opens a turn, the role's ids, the reserved id that ends the
header, the content's ids and the reserved id that closes the turn. Segments are encoded apart, so
no token spans a border, and text can never yield a reserved id. In the shown text the reserved
ids stand as control strings; where these occur in a role or content they are escaped by a
backslash (as are backslashes), which is undone when the output is read back. The loss mask comes
from the prefix sums of +1 at the start and -1 at the end of each assistant's content.

Null role or text: empty. Null turns come first. Repeated rows are kept, ordered by turn, role and
text. A row with a null conversation id is a conversation of its own. A conversation is read row by
row in order, so only its output is held in memory; one of more than MOST_TOKENS raises ValueError, as
it would be no training example. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.llm.common import arrow_map

OPEN, HEAD, CLOSE = "### ", ": ", " </turn>\n"
#: Control strings that are escaped inside texts, the escape sign first.
CONTROL = ("\\", "###", "</turn>")
ESCAPE = re.compile("|".join(map(re.escape, CONTROL)))
UNESCAPE = re.compile(r"\\(\\|###|</turn>)")
TRAINED_ROLE = "assistant"
#: Tokens that one conversation may have.
MOST_TOKENS = 1 << 28
FORMATTED = "conv_id long, n_turns long, ids array<int>, loss_mask array<tinyint>, text string"


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


@lru_cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("segments", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def reserved(path: str) -> tuple[int, int, int]:
    """The ids of the turn's opening, the header's end and the turn's end: free ones above the vocabulary."""
    free = encoding(path).max_token_value + 1
    return free, free + 1, free + 2


class Assembly:
    """One conversation as it grows."""

    def __init__(self, path: str):
        self.encode = encoding(path).encode_ordinary
        self.open, self.head, self.close = reserved(path)
        self.ids: list[int] = []
        self.marks: list[tuple[int, int]] = []
        self.shown: list[str] = []
        self.turns = 0

    def add(self, role: str, text: str) -> None:
        role_text, content = escape(role), escape(text)
        self.ids.append(self.open)
        self.ids += self.encode(role_text)
        self.ids.append(self.head)
        start = len(self.ids)
        self.ids += self.encode(content)
        if role == TRAINED_ROLE:
            self.marks += [(start, 1), (len(self.ids), -1)]
        self.ids.append(self.close)
        self.shown += [OPEN, role_text, HEAD, content, CLOSE]
        self.turns += 1

    def mask(self) -> np.ndarray:
        steps = np.zeros(len(self.ids) + 1, np.int8)
        for at, step in self.marks:
            steps[at] += step
        return np.cumsum(steps[:-1], dtype=np.int8)


def format_conversations(rows: DataFrame, tokenizer: str | None = None, most_tokens: int = MOST_TOKENS) -> DataFrame:
    """``conv_id, n_turns, ids, loss_mask, text`` of each conversation in ``rows (conv_id, turn, role, text)``.

    One shuffle by conversation; ``tokenizer`` is the path of a rank file that every machine has.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple[int | None, Assembly]] = []
        size, now = 0, None

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c, _ in done], pa.int64()), pa.array([a.turns for _, a in done], pa.int64()),
                    pa.array([np.array(a.ids, np.int32) for _, a in done], pa.list_(pa.int32())),
                    pa.array([a.mask() for _, a in done], pa.list_(pa.int8())),
                    pa.array(["".join(a.shown) for _, a in done], pa.string()),
                ],
                ["conv_id", "n_turns", "ids", "loss_mask", "text"],
            )
            done.clear()
            return out

        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if now is None or now[0] != conv or conv is None:
                    if size > 1 << 20:
                        yield flush()
                        size = 0
                    now = (conv, Assembly(path))
                    done.append(now)
                now[1].add(role or "", text or "")
                if len(now[1].ids) > most_tokens:
                    raise ValueError(f"conversation {conv} has more than {most_tokens} tokens")
                size += len(text or "")
        if done:
            yield flush()

    order = ["conv_id", "_salt", "turn", "role", "text"]
    slim = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).withColumn("_salt", F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text")))
    return arrow_map(
        slim.repartition("conv_id", "_salt").sortWithinPartitions(*order).select("conv_id", "role", "text"), run, FORMATTED
    )


def read_turns(ids: list[int], path: str) -> list[tuple[str, str]]:
    """Roles and texts of a conversation from its token ids."""
    start, head, close = reserved(path)
    decode = encoding(path).decode_bytes
    turns, part, role = [], [], ""
    for i in ids:
        if i == start:
            part = []
        elif i == head:
            role, part = unescape(decode(part).decode()), []
        elif i == close:
            turns.append((role, unescape(decode(part).decode())))
        else:
            part.append(i)
    return turns


def read_loss(ids: np.ndarray, mask: np.ndarray, path: str) -> list[str]:
    """Unescaped texts under the loss mask, one for each run of it."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
    decode = encoding(path).decode_bytes
    return [unescape(decode(ids[a:b].tolist()).decode()) for a, b in edges.reshape(-1, 2).tolist()]


def digests(formatted: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """What ``formatted`` says when its ids and mask are read back."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ids, mask in zip(batch.column(2), batch.column(3), strict=True):
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                turns, loss = read_turns(ids.tolist(), path), "".join(read_loss(ids, mask, path))
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            shown = pa.array([len(t.as_py()) for t in batch.column(4)], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string()), shown],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return arrow_map(formatted, run, schema)
