"""Encoding of a corpus by a public byte-level vocabulary, cut at boundaries that are certain."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How byte_bpe_50k divides a text before its merges; a fixed value of that public vocabulary.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZERS_DIR = "/opt/tokenizers"
CACHE_ITEMS = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", directory: str | None = None) -> str:
    """The file of ranks: in the given directory, that of TALLYFIELD_TOKENIZERS, or the usual place."""
    return os.path.join(directory or os.environ.get("TALLYFIELD_TOKENIZERS", TOKENIZERS_DIR), name)


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> id from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class ForcedBoundaryEncoder:
    """Byte-pair encoding of fragments between certain cuts.

    A token is a run of bytes, so two neighbouring bytes that lie next to each other in no
    token of the vocabulary can never end up in one: between them every encoding has a cut.
    Merges on either side of such a cut don't see each other. A text is therefore divided by
    the vocabulary's own pattern, each piece at its certain cuts, and the fragments, which are
    short and recur, are encoded one by one and joined. Encodings of pieces and of fragments
    are kept while there is room; both stores are emptied when full.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = SPLIT_PATTERN) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            b = np.frombuffer(token, np.uint8)
            inside[b[:-1], b[1:]] = True
        self.inside = inside
        self.joined = [bytes(row) for row in inside.astype(np.uint8)]
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.fragments: dict[bytes, tuple[int, ...]] = {}

    def cuts(self, data: bytes) -> list[bytes]:
        """The fragments of a piece."""
        joined, out, start, last = self.joined, [], 0, len(data) - 1
        for i in range(last):
            if not joined[data[i]][data[i + 1]]:
                out.append(data[start : i + 1])
                start = i + 1
        out.append(data[start:])
        return out

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """Repeatedly join the neighbouring parts whose union has the least rank, leftmost first."""
        ranks = self.ranks
        whole = ranks.get(fragment)
        if whole is not None:
            return (whole,)
        if len(fragment) > 512:
            return self._merge_long(fragment)
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        pair = [ranks.get(parts[i] + parts[i + 1], 1 << 40) for i in range(len(parts) - 1)]
        while pair:
            least = min(pair)
            if least == 1 << 40:
                break
            i = pair.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pair[i]
            if i < len(pair):
                pair[i] = ranks.get(parts[i] + parts[i + 1], 1 << 40)
            if i:
                pair[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 40)
        return tuple(ranks[p] for p in parts)

    def _merge_long(self, fragment: bytes) -> tuple[int, ...]:
        """The same merges over a linked list with a heap, for fragments of any length."""
        import heapq

        ranks, n = self.ranks, len(fragment)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(fragment[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            end[i], alive[j], after[i] = stop, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(fragment[i : end[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(fragment[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[fragment[i : end[i]]])
            i = after[i]
        return tuple(out)

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:
            ids: tuple[int, ...] = (whole,)
        else:
            found: list[int] = []
            for fragment in self.cuts(data):
                part = self.fragments.get(fragment)
                if part is None:
                    if len(self.fragments) >= CACHE_ITEMS:
                        self.fragments.clear()
                    part = self.merge(fragment)
                    if len(fragment) <= 64:
                        self.fragments[fragment] = part
                found.extend(part)
            ids = tuple(found)
        if len(piece) <= 64:
            if len(self.pieces) >= CACHE_ITEMS:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one. Strings like special tokens are plain text."""
        if not text:
            return []
        get, out = self.pieces.get, []
        for piece in self.split(text):
            out.extend(get(piece) or self._piece(piece))
        return out


_ENCODERS: dict[int, ForcedBoundaryEncoder] = {}


def _encoder(data: bytes, pattern: str) -> ForcedBoundaryEncoder:
    key = hash((data, pattern))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = ForcedBoundaryEncoder(read_ranks(data), pattern)
    return _ENCODERS[key]


def encode_column(df: DataFrame, text: str, keep: list[str], out: str = "ids", path: str | None = None, pattern: str = SPLIT_PATTERN) -> DataFrame:
    """The kept columns and the token ids of a text column, one row for each input row.

    A pure map over the whole table: nothing is shuffled, whole texts are encoded whatever
    their length, and the vocabulary (a file of fixed size, under 1 MB) is the only thing sent
    to the executors. Null and empty texts give an empty array. Kept columns pass unchanged,
    nulls and repeated rows included; other columns aren't read. An empty table gives no rows.
    """
    with open(path or vocabulary_path(), "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shipped.value, pattern)
        for batch in batches:
            at, step = 0, 2000
            while at < batch.num_rows:
                piece = batch.slice(at, step)
                at += step
                flat: list[int] = []
                offsets = [0]
                for t in piece.column(len(keep)).to_pylist():
                    flat.extend(encoder.encode(t))
                    offsets.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(keep))), ids], names=[*keep, out])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    schema = StructType([*rows.schema.fields[: len(keep)], StructField(out, ArrayType(IntegerType()))])
    return rows.mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str, keep: list[str], out: str = "text", path: str | None = None) -> DataFrame:
    """The kept columns and the text of a column of ids; bytes that aren't UTF-8 become U+FFFD."""
    with open(path or vocabulary_path(), "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())
    rows = df.select(*[F.col(c) for c in keep], F.col(ids).cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {v: k for k, v in read_ranks(shipped.value).items()}
        for batch in batches:
            texts = [None if x is None else b"".join(tokens[i] for i in x).decode("utf-8", "replace") for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, out])

    from pyspark.sql.types import StringType, StructField, StructType

    return rows.mapInArrow(run, StructType([*rows.schema.fields[: len(keep)], StructField(out, StringType())]))
