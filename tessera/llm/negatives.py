"""Hard negatives by a secondary-sort shuffle.

Anchors are scored against all rows by the integer inner product of their
quantised vectors. An anchor's positives are its best other rows of the same
label; each of them opens a window of scores, from ``low`` to ``high`` per cent of
its own, and the best rows of other labels inside it are its hard negatives.

1. Rows are packed into blocks of ``BLOCK`` and anchors into chunks of ``CHUNK``
   (binary rows, so no Python object a vector). Blocks and chunks meet in cells, by
   an equi-join on the cell's number: a cell is one matrix product, worked on in
   tiles of bounded size. Every anchor meets every row; nothing is sampled.
2. First cells keep, of each anchor, the best positives of the cell; their merge
   gives each anchor's positives. Then cells keep, of each anchor and positive, the
   best negatives of the cell inside its window. Both are exact: what is best
   overall is among the best of its cell.
3. Pair scores are packed into byte keys (anchor, descending score, positives
   before negatives, id) whose byte order is the wanted order.
   ``repartitionAndSortWithinPartitions`` deals them by anchor and sorts them; one
   iterator passes over a partition, opens a window at each positive, gives a
   negative to every window that is open and not full, and closes windows that the
   falling scores have left. It holds an anchor's open windows, never its rows.

Scores are exact: products are summed in doubles while every partial sum stays
below 2**53, else in 64-bit integers; scores must stay within 9e16, so that their
percentages fit 64 bits.

Defined cases: rows with a null label, a null vector, or a null or non-finite
component take no part; of two vectors of unlike length the shorter counts as
filled up with zeros; a null id comes after all others and is no anchor; rows that
repeat an anchor's id, label and vector are that anchor, any other row is
another row (repeated rows can be ranked repeatedly); a positive whose score is
negative has an empty window; components are cut to 62 bits.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved, shuffle_parts

#: Rows of a block, anchors of a chunk, scores of a tile.
BLOCK, CHUNK, TILE = 4096, 1024, 1 << 20
SCALE = 256
_FAR = float(1 << 62)
_LAST = np.iinfo(np.int64).max


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their components floor(SCALE * x) as a matrix filled up with zeros)."""
    valid = np.asarray(column.is_valid())
    column = column.filter(pa.array(valid))
    length = np.asarray(column.value_lengths()).astype(np.int64) if len(column) else np.zeros(0, np.int64)
    flat = column.flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)) if len(flat) else np.zeros(0)
    row = np.repeat(np.arange(len(length)), length)
    good = np.ones(len(length), bool)
    good[row[~np.isfinite(x)]] = False
    out = np.zeros((len(length), int(length.max(initial=0))), np.int64)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    with np.errstate(invalid="ignore", over="ignore"):
        out[row, place] = np.clip(np.floor(SCALE * np.where(np.isfinite(x), x, 0.0)), -_FAR, _FAR).astype(np.int64)
    return np.flatnonzero(valid)[good], out[good]


def _narrow(x: np.ndarray) -> np.ndarray:
    """The components in as few bytes as hold them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


_PACK = "name long, n int, dim int, bytes int, ids binary, nulls binary, labels binary, marks binary, vectors binary, windows binary"


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Packs of at most ``size`` rows of (id, label, mark, vector, windows); name is a hash of the pack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            at = 0
            while at < b.num_rows:
                part = b.slice(at, size - n)
                held.append(part)
                n += part.num_rows
                at += part.num_rows
                if n == size:
                    yield pack(pa.Table.from_batches(held).combine_chunks())
                    held, n = [], 0
        if n:
            yield pack(pa.Table.from_batches(held).combine_chunks())

    def pack(t: pa.Table) -> pa.RecordBatch:
        column = {c: t.column(c).combine_chunks() for c in t.column_names}
        own, x = quantised(column["vector"])
        own, x = (own, x) if len(own) else (own[:0], x[:0])
        take = pa.array(own)
        ids = column["id"].take(take)
        null = np.asarray(ids.is_null()).astype(np.uint8)
        x = _narrow(x)
        values = {"n": len(own), "dim": x.shape[1], "bytes": x.itemsize, "ids": np.asarray(ids.fill_null(_LAST)).astype("<i8").tobytes(), "nulls": null.tobytes(),
                  "labels": np.asarray(column["label"].take(take)).astype("<i8").tobytes(), "marks": np.asarray(column["mark"].take(take)).astype("<i8").tobytes(),
                  "vectors": x.tobytes(), "windows": b"".join(column["windows"].take(take).to_pylist())}
        values["name"] = zlib.crc32(values["vectors"], zlib.crc32(values["ids"]))
        return pa.RecordBatch.from_pylist([values], schema=_schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    _schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _PACK.split(", ")])
    return rows.select("id", "label", "mark", "vector", "windows").mapInArrow(run, _PACK).where("n > 0")


class _Pack:
    def __init__(self, row: dict, prefix: str):
        get = lambda c: row[f"{prefix}_{c}"]
        self.ids, self.nulls = np.frombuffer(get("ids"), "<i8"), np.frombuffer(get("nulls"), np.uint8)
        self.labels, self.marks = np.frombuffer(get("labels"), "<i8"), np.frombuffer(get("marks"), "<i8")
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[get("bytes")]
        self.x = np.frombuffer(get("vectors"), kind).reshape(get("n"), get("dim"))
        windows = np.frombuffer(get("windows"), "<i8")
        self.windows = windows.reshape(get("n"), -1) if len(windows) else np.zeros((get("n"), 0), np.int64)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a with those of b."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    most = [float(np.abs(v.astype(np.float64)).max(initial=0)) for v in (a, b)]
    if dim * most[0] * most[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    with np.errstate(over="ignore"):
        return a.astype(np.int64) @ b.astype(np.int64).T


def _best(s: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(line, columns of the k largest allowed scores): equal scores by column, which rises with the id."""
    low = np.iinfo(np.int64).min
    s = np.where(allowed, s, low)
    k_ = min(k, s.shape[1])
    for i, line in enumerate(s):
        least = np.partition(line, len(line) - k_)[len(line) - k_]
        if least == low:
            pick = np.flatnonzero(allowed[i])
        else:
            above, equal = np.flatnonzero(line > least), np.flatnonzero((line == least) & allowed[i])
            pick = np.r_[above, equal[:k_ - len(above)]]
        if len(pick):
            yield i, pick


def _cells(anchors: DataFrame, rows: DataFrame) -> DataFrame:
    """Every chunk of anchors next to every block of rows, by an equi-join on the cell."""
    spark = rows.sparkSession
    n_rows, n_anchors = max(rows.count(), 1), max(anchors.count(), 1)
    named = lambda df, p, n: df.select(F.pmod(F.xxhash64("name"), F.lit(n)).alias(f"{p}_group"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns])
    sent = named(anchors, "a", n_anchors).withColumn("b_cell", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1)).cast("array<long>")))
    met = named(rows, "b", n_rows).withColumn("a_cell", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1)).cast("array<long>")))
    met = met.repartition(min(shuffle_parts(spark), n_rows * n_anchors), "b_group", "a_cell")
    return met.join(sent, (F.col("b_group") == F.col("b_cell")) & (F.col("a_cell") == F.col("a_group")))


def _through(cells: DataFrame, keep, schema: str) -> DataFrame:
    """``keep(anchors, lines, rows, scores)`` of every tile, as arrays by column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                a, b = _Pack(row, "a"), _Pack(row, "b")
                order = np.lexsort((b.ids, b.nulls))
                b.ids, b.nulls, b.labels, b.marks, b.x = b.ids[order], b.nulls[order], b.labels[order], b.marks[order], b.x[order]
                step = max(1, TILE // len(b.ids))
                for at in range(0, len(a.ids), step):
                    lines = np.arange(at, min(at + step, len(a.ids)))
                    found = keep(a, lines, b, scores(a.x[lines], b.x))
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=[c.split()[0] for c in schema.split(", ")])

    return cells.mapInArrow(run, schema)


def _other(a: _Pack, lines: np.ndarray, b: _Pack) -> np.ndarray:
    return (a.ids[lines][:, None] != b.ids) | (a.marks[lines][:, None] != b.marks)


def best_positives(cells: DataFrame, k: int) -> DataFrame:
    """(anchor, mark, score, id, no_id) of the k best rows of the anchor's label in each cell."""
    def keep(a, lines, b, s):
        found = list(_best(s, (a.labels[lines][:, None] == b.labels) & _other(a, lines, b), k))
        line = np.concatenate([np.full(len(c), i) for i, c in found] or [np.zeros(0, int)])
        col = np.concatenate([c for _, c in found] or [np.zeros(0, int)])
        return a.ids[lines][line], a.marks[lines][line], s[line, col], b.ids[col], b.nulls[col].astype(bool)

    return _through(cells, keep, "anchor long, mark long, score long, id long, no_id boolean")


_KEY = struct.Struct(">QqQBBQ")
_FLIP = 1 << 63


def key_of(anchor: int, mark: int, score: int, negative: int, no_id: int, item: int) -> bytes:
    """The bytes order by anchor, falling score, positives first, id (none last)."""
    return _KEY.pack(anchor + _FLIP, mark, _FLIP - 1 - score, negative, no_id, item + _FLIP)


def best_negatives(cells: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """Keys of the k best rows of other labels in each cell for each window of an anchor."""
    def keep(a, lines, b, s):
        out: set[tuple[int, int]] = set()
        other = a.labels[lines][:, None] != b.labels
        for j in range(a.windows.shape[1]):
            top = a.windows[lines, j][:, None]
            inside = other & (top != _LAST) & (100 * s <= high * top) & (100 * s >= low * top)
            some = np.flatnonzero(inside.any(axis=1))
            for i, cols in _best(s[some], inside[some], k):
                out.update((int(some[i]), int(c)) for c in cols)
        keys = [key_of(int(a.ids[lines[i]]), int(a.marks[lines[i]]), int(s[i, c]), 1, int(b.nulls[c]), int(b.ids[c])) for i, c in sorted(out)]
        return (pa.array(keys, pa.binary()),)

    return _through(cells, keep, "key binary")


def windows_of(keys: Iterator[bytes], k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, rank, negative, positive score, negative score) from sorted keys."""
    now, open_ = None, []
    for key in keys:
        anchor, mark, score, negative, no_id, item = _KEY.unpack(key)
        anchor, score, item = anchor - _FLIP, _FLIP - 1 - score, None if no_id else item - _FLIP
        if (anchor, mark) != now:
            now, open_ = (anchor, mark), []
        if not negative:
            open_.append([item, score, 0])
            continue
        # scores fall, so a window whose lower end was passed stays closed
        open_ = [w for w in open_ if w[2] < k and low * w[1] <= 100 * score]
        for w in open_:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor, w[0], w[2], item, w[1], score


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
         block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from (id, label, vector)."""
    spark = vectors.sparkSession
    rows = vectors.where("label is not null and vector is not null").select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "vector", F.xxhash64("label", "vector").alias("mark"),
        F.lit(b"").alias("windows"))
    blocks = saved(_packed(rows, block), "negatives-rows")
    # a row for each anchor and mark; the anchors' vectors stay as they are
    own = saved(rows.where(F.coalesce(is_anchor, F.lit(False)) & F.col("id").isNotNull()).dropDuplicates(["id", "mark"]), "negatives-anchors")
    rank = F.row_number().over(Window.partitionBy("anchor", "mark").orderBy(F.desc("score"), "no_id", "id"))
    found = best_positives(_cells(saved(_packed(own, chunk), "negatives-chunks"), blocks), positives)
    found = saved(found.withColumn("rank", rank).where(F.col("rank") <= positives), "negatives-positives")
    tops = found.groupBy("anchor", "mark").agg(F.sort_array(F.collect_list("score")).alias("tops"))  # a few a group
    full = F.concat("tops", F.array_repeat(F.lit(_LAST), positives - F.size("tops")))
    width = F.concat(*[_little_endian(full[j]) for j in range(positives)])
    ready = own.drop("windows").join(tops.select(F.col("anchor").alias("id"), "mark", width.alias("windows")), ["id", "mark"])
    cells = _cells(saved(_packed(ready, chunk), "negatives-chunks"), blocks)
    keys = best_negatives(cells, negatives, low, high).rdd.map(lambda r: (bytes(r[0]), None)).union(
        found.select("anchor", "mark", "score", "no_id", "id").rdd.map(lambda r: (key_of(r[0], r[1], r[2], 0, int(r[3]), r[4]), None)))
    dealt = keys.repartitionAndSortWithinPartitions(shuffle_parts(spark), lambda key: zlib.crc32(key[:16]))
    mined = dealt.mapPartitions(lambda part: windows_of((k for k, _ in part), negatives, low, high))
    return spark.createDataFrame(mined, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def _little_endian(value: Column) -> Column:
    """The eight bytes of a long, lowest first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))
