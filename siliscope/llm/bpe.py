"""Byte-pair encoding of review comments and its way back, with the vocabulary file of a public tokenizer.

A comment is cut into pieces by the tokenizer's pattern. Each piece starts as a doubly linked list of byte symbols; a
priority queue holds the merges that neighbouring symbols allow, by merge rank and then from the left. The best merge is
taken, its neighbours' new merges join the queue, and entries whose symbols have changed meanwhile are skipped as stale.
Decoding concatenates the vocabulary's strings and maps them back to bytes.

Nothing is shuffled; a task holds the vocabulary and a bounded table of pieces seen lately.
"""
from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from siliscope.llm.common import small_batches, text_of

# fixed value: the byte-level pattern of the tokenizer file's format
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: pieces whose ids a task keeps; the table starts anew when it is full
PIECES = 250_000
#: tokens a task holds before it passes them on
BATCH_TOKENS = 500_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Tokenizer:
    """Vocabulary, merge ranks and added tokens of a byte-level BPE file."""

    def __init__(self, path: str, pieces: int = PIECES):
        self.pieces = pieces
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, symbols = spec["model"], byte_symbols()
        self.vocabulary: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocabulary
        #: (left id, right id) -> (rank, merged id)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.byte_ids = [ids[s] for s in symbols]
        back = {s: b for b, s in enumerate(symbols)}
        self.strings: dict[int, bytes] = {i: bytes(map(back.__getitem__, s)) for s, i in ids.items()}
        self.strings |= {i: s.encode() for s, i in self.added.items()}
        self.pattern = regex.compile(PATTERN)
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.seen: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: best merge first, by rank and from the left."""
        symbol = [self.byte_ids[b] for b in piece]
        n = len(symbol)
        allowed = self.merges.get
        queue = []
        for i in range(n - 1):
            if found := allowed((symbol[i], symbol[i + 1])):
                queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
        if not queue:
            return tuple(symbol)
        heapq.heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            _, i, left, right, merged = pop(queue)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue  # stale: one of the two has been merged meanwhile
            symbol[i], symbol[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := allowed((merged, symbol[k])):
                    push(queue, (found[0], i, merged, symbol[k], found[1]))
            h = before[i]
            if h >= 0 and (found := allowed((symbol[h], merged))):
                push(queue, (found[0], h, symbol[h], merged, found[1]))
        return tuple([s for s in symbol if s >= 0])

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; the strings of added tokens become their ids, as the tokenizers library does it."""
        out: list[int] = []
        if self.cut is not None and any(a in text for a in self.added):
            for part in self.cut.split(text):
                if part in self.added:
                    out.append(self.added[part])
                elif part:
                    self._encode(part, out)
        else:
            self._encode(text, out)
        return out

    def _encode(self, text: str, out: list[int]) -> None:
        seen = self.seen
        for piece in self.pattern.findall(text):
            ids = seen.get(piece)
            if ids is None:
                if len(seen) >= self.pieces:
                    seen.clear()
                ids = seen[piece] = self.merge(piece.encode("utf-8"))
            out += ids

    def decode(self, ids: list[int]) -> str:
        """The concatenated strings of the ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def _lists(rows: list[list[int]]) -> pa.Array:
    offsets = [0]
    for r in rows:
        offsets.append(offsets[-1] + len(r))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array([x for r in rows for x in r], pa.int32()))


def encode(reviews: DataFrame, tokenizer_path: str, comment: str = "safe_comment", token_ids: str = "token_ids",
           decoded: str | None = None, pieces: int = PIECES) -> DataFrame:
    """Add the token ids of every whole comment as an array of int; a missing comment gives no tokens.

    With ``decoded``, a column of that name gets the text that the ids decode to, in the same pass. ``tokenizer_path`` names a
    tokenizers JSON file that every executor can open (an installed package's, or one shipped with the job). All other columns pass
    through; columns of the added names are replaced. ``pieces`` bounds the table of pieces that a task keeps: a smaller one saves
    memory and costs time. Nothing is trained.
    """
    small_batches(reviews)
    added = [token_ids] + ([decoded] if decoded else [])
    names = [c for c in reviews.columns if c not in added]
    held = reviews.select(*names, text_of(comment).alias("__text"))
    schema = held.drop("__text").schema.add(token_ids, ArrayType(IntegerType()))
    schema = schema.add(decoded, StringType()) if decoded else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(tokenizer_path, pieces)  # this task's own, so that a worker that lives on does not keep it
        for batch in batches:
            texts, others = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
            rows, lo, count = [], 0, 0
            for at, text in enumerate(texts, 1):
                rows.append(tokenizer.encode(text.as_py()))
                count += len(rows[-1])
                if count >= BATCH_TOKENS or at == batch.num_rows:
                    part = others.slice(lo, at - lo)
                    back = [pa.array([tokenizer.decode(ids) for ids in rows], pa.string())] if decoded else []
                    yield pa.RecordBatch.from_arrays([*part.columns, _lists(rows), *back], [*part.schema.names, *added])
                    rows, lo, count = [], at, 0

    return held.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, token_ids: str = "token_ids", decoded: str = "decoded_comment") -> DataFrame:
    """Add the text that the ids stand for; null ids give an empty text. All other columns pass through.

    An id outside the vocabulary raises KeyError.
    """
    names = [c for c in encoded.columns if c != decoded]
    held = encoded.select(*names, F.coalesce(F.col(token_ids), F.array().cast("array<int>")).alias("__ids"))
    schema = held.drop("__ids").schema.add(decoded, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(tokenizer_path)  # this task's own, so that a worker that lives on does not keep it
        for batch in batches:
            lists, others = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            texts = [tokenizer.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*others.columns, pa.array(texts, pa.string())], [*others.schema.names, decoded])

    return held.mapInArrow(run, schema)
