"""Byte-level BPE encoding and decoding.

Every match of the split pattern is encoded on its own. A match of up to ``SHORT``
bytes keeps the ranks of its neighbouring pairs in a list, whose smallest entry is
merged until none is left. For a longer one, the bytes of the match
start as one node each; a segment tree over the byte positions holds the rank
of the pair that starts at each live node, and its root names the leftmost
pair of minimum rank. A merge touches the merged node and its live neighbour
on the left, each one logarithmic point update, so a match of n bytes costs
O(n log n) however long it is.

Tasks stream Arrow batches; equal short matches are encoded once per task
(the table is emptied when it reaches ``MEMO`` entries, which bounds memory
and never changes ids). The rank table has a fixed size given by the
vocabulary file, and is read once on the driver and broadcast.

Defined cases: a null text is the empty text (no ids, the hash of no bytes);
repeated rows are encoded each; extra columns pass through unless the operator
writes a column of that name.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries kept in a task's table of encoded matches, and the longest match kept.
MEMO, MEMO_CHARS = 400_000, 64
#: Bytes of the longest match merged in a plain list.
SHORT = 64
NONE = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file with one ``base64 rank`` pair a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _encode_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Node k of the match goes from ``at[k]`` to ``at[k + 1]``; ``rank[k]`` is the rank of nodes k and k + 1 as one."""
    known = ranks.get
    at = list(range(len(piece) + 1))
    rank = [known(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
    while rank and (least := min(rank)) != NONE:
        i = rank.index(least)  # the leftmost
        del rank[i], at[i + 1]
        if i < len(rank):
            rank[i] = known(piece[at[i]:at[i + 2]], NONE)
        if i:
            rank[i - 1] = known(piece[at[i - 1]:at[i + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in zip(at, at[1:])]


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one match by repeatedly merging the leftmost pair of lowest rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT:
        return _encode_short(piece, ranks)
    size = 1
    while size < n:
        size *= 2
    # tree[size + i] is the rank of the pair that starts at node i; an inner
    # node holds the smaller child, so walking down from the root and
    # preferring the left child on ties finds the leftmost minimum.
    tree = [NONE] * (2 * size)
    end = list(range(1, n + 1))  # byte position where the node that starts at i ends
    before = list(range(-1, n - 1))  # start of the live node on the left
    for i in range(n - 1):
        tree[size + i] = ranks.get(piece[i:i + 2], NONE)
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k //= 2
        while k:
            least = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == least:
                break
            tree[k] = least
            k //= 2

    while tree[1] != NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != tree[k // 2]:
                k += 1
        i = k - size
        gone = end[i]
        end[i] = end[gone]
        put(gone, NONE)
        if end[i] < n:
            before[end[i]] = i
            put(i, ranks.get(piece[i:end[end[i]]], NONE))
        else:
            put(i, NONE)
        left = before[i]
        if left >= 0:
            put(left, ranks.get(piece[left:end[i]], NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class Codec:
    """Encodes and decodes texts with a rank table; ids travel as packed bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.pieces = np.empty(max(ranks.values(), default=-1) + 1, dtype=object)
        for piece, rank in ranks.items():
            self.pieces[rank] = piece
        self.memo: dict[str, bytes] = {}

    def _packed(self, match: str) -> bytes:
        found = encode_piece(match.encode("utf-8"), self.ranks)
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(match) <= MEMO_CHARS:
            self.memo[match] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO:
            self.memo.clear()
        known = self.memo.get
        return b"".join([known(m) or self._packed(m) for m in self.split(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(self.pieces[np.frombuffer(ids, dtype="<u4")].tolist())


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None,
                     with_ids: bool = True) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_tokens, ids (array of int; on request),
    ids_sha256 and decoded_sha256 (the hash of the bytes that the ids decode to)."""
    spark = docs.sparkSession
    made = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("encoded text"))
    schema = ", ".join([*(f"`{c}` {taken.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long"]
                       + ["ids array<int>"] * with_ids + ["ids_sha256 string", "decoded_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks.value, pattern)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                packed = [codec.encode(t) for t in part.column(len(keep)).to_pylist()]
                cols = [part.column(i) for i in range(len(keep))]
                cols.append(pa.array([len(x) // 4 for x in packed], pa.int64()))
                if with_ids:
                    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in packed]))
                cols.append(pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in packed]))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    return taken.mapInArrow(run, schema)
