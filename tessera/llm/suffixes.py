"""Repeated passages by a sparse suffix array.

A repeat is a stretch of ``LEAST`` words (50) that occurs at another place too,
in another document or the same. Its first occurrence, by document id and
position, is the original; words covered by a later one are repeated words.

1. Every 50-word window names the leftmost of its 26 25-word grams with the
   smallest hash; only suffixes at these minimiser positions are retained.
   The choice depends on content alone, so equal windows retain the same
   suffix at the same offset. About 1 word in 13 starts a retained suffix.
2. First the grams of retained suffixes are counted. A filter of fixed size
   (``FILTER_BITS``), set where a gram occurs twice, keeps nearly all other suffixes
   from being sent in the second pass. A kept suffix carries the 64-bit hashes of the
   words right and left of its gram, as far as a window that names it reaches. (Range
   boundaries are sampled from that pass, which is run twice: writing its rows first
   would double the disk.)
3. Suffixes are sorted by the hash of their first 25 words, then by the words that
   follow. Range partitioning by the whole key splits a passage that a third of all
   documents share over many tasks, each of which streams its rows in chunks.
4. Neighbours are compared word by word: how far two neighbours agree to the right
   tells, for each length, which suffixes agree so far. The same comparison of
   neighbours in the order of the words to the left (nearest first) extends the
   match to the other side. Two suffixes that agree on l words to the left and
   25 - l to the right share a window, which is a repeat. A run of equal grams that
   touches a chunk's edge sends, for each window, its first occurrence in the chunk
   on to be compared with other chunks' (one row a window and chunk).

Windows are compared by the 64-bit hashes of their words; only the windows of runs at
a chunk's edge meet by one 64-bit hash over those.

Defined cases: a null text or one of under 50 words has no repeats; rows equal in
id and text are one document; rows that share an id but not the text are
documents of their own; a null id comes after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import bounded_batches, saved, shuffle_parts
from tessera.llm.jaccard import _buckets, _by_bucket, passed, text_filter, text_key
from tessera.llm.vectors import BASE, U, Words, mix, rolling_hashes, slices

LEAST, GRAM = 50, 25
#: Bits of the filter of grams that occur twice (8 MiB); grams of a task's flush.
FILTER_BITS, FLUSH = 26, 500_000
SIDE = LEAST - GRAM  # words of a window besides the gram
#: Rows of a chunk in the sorted stream.
CHUNK = 50_000
LAST_ID = np.iinfo(np.int64).max


def retained(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The retained suffixes of a text of word hashes: the hash of the 25-gram, its
    position, and the first start and the number of the windows that name it."""
    if len(h) < LEAST:
        none = np.zeros(0, np.int64)
        return np.zeros(0, U), none, none, none
    grams = rolling_hashes(h, GRAM)
    starts = np.arange(len(h) - LEAST + 1)
    at = starts + np.lib.stride_tricks.sliding_window_view(grams, SIDE + 1).argmin(axis=1)
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return grams[at[new]], at[new], new, np.diff(np.r_[new, len(starts)])


def _packed(values: np.ndarray, length: np.ndarray) -> pa.Array:
    """Binary values: of 64-bit ``values``, the next ``length`` for each row."""
    ends = 8 * np.r_[0, np.cumsum(length)]
    return pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


def _ragged(first: np.ndarray, size: np.ndarray, step: int) -> np.ndarray:
    """first, first + step, ... of each row, ``size`` of them."""
    ends = np.cumsum(size)
    return np.repeat(first, size) + step * (np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size))


def _twice(docs: DataFrame):
    """A broadcast bitmap of 2 ** FILTER_BITS bits, whatever the table's size: set where a gram occurs twice.

    A task sends each gram of a flush at most twice, so a hot passage costs no more
    than two entries a flush; one row of bits a bucket reaches the driver."""
    spark = docs.sparkSession
    n_buckets = min(_buckets(spark), 1 << 12)
    shift, span = U(64 - n_buckets.bit_length() + 1), (1 << FILTER_BITS) // n_buckets

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(kept: list[np.ndarray]) -> pa.RecordBatch:
            gram, n = np.unique(np.concatenate(kept), return_counts=True)
            gram = np.repeat(gram, np.minimum(n, 2))
            rows = list(_by_bucket((gram >> shift).astype(np.int32), [gram]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][0] for r in rows], pa.binary())], names=["bucket", "grams"])

        kept, size = [], 0
        for part in slices(batches, 0):
            words = Words(part.column(0))
            for a, b in zip(words.first, words.first[1:]):
                kept.append(retained(words.hash[a:b])[0])
                size += len(kept[-1])
            if size >= FLUSH:
                yield flush(kept)
                kept, size = [], 0
        if size:
            yield flush(kept)

    def mark(table: pa.Table) -> pa.Table:
        gram = np.sort(np.concatenate([np.frombuffer(x, U) for x in table.column("grams").to_pylist()]))
        bits, bucket = np.zeros(span, np.uint8), table.column("bucket")[0].as_py()
        again = gram[1:][gram[1:] == gram[:-1]]
        bits[(again >> U(64 - FILTER_BITS)).astype(np.int64) - bucket * span] = 1
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    found = docs.select("text").mapInArrow(send, "bucket int, grams binary").groupBy("bucket").applyInArrow(mark, "bucket int, bits binary")
    bitmap = np.zeros((n_buckets, span // 8), np.uint8)
    for row in found.toLocalIterator():
        bitmap[row["bucket"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return spark.sparkContext.broadcast(bitmap.ravel())


def _suffixes(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, start, n, key, right, left) for each retained suffix whose gram passes the filter of grams
    that occur twice; the n windows from ``start`` on name it."""
    schema = "doc_id long, uid long, start int, n int, key binary, right binary, left binary"
    twice = _twice(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = twice.value
        for part in slices(batches, 2):
            words = Words(part.column(2))
            found = [retained(words.hash[a:b]) for a, b in zip(words.first, words.first[1:])]
            row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            gram, at, start, n = (np.concatenate([f[i] for f in found]) for i in range(4))
            kept = passed(bitmap, (gram >> U(64 - FILTER_BITS)).astype(np.int64))
            if not kept.any():
                continue
            row, gram, at, start, n = row[kept], gram[kept], at[kept], start[kept], n[kept]
            base, before = words.first[row], at - start
            after = SIDE - before + n - 1
            right = words.hash[_ragged(base + at + GRAM, after, 1)]
            left = words.hash[_ragged(base + at - 1, before, -1)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(take), part.column(1).take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                _packed(gram.astype(">u8"), np.ones(len(gram), np.int64)), _packed(right.astype(">u8"), after), _packed(left.astype(">u8"), before)],
                names=[c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("uid"), "text").mapInArrow(run, schema)


def _words_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """A binary column of packed words as a matrix of SIDE words a row (zeros behind the last), and their numbers."""
    values = column.combine_chunks()
    ends = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, 4 * values.offset).astype(np.int64)
    raw = values.buffers()[2]
    words = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]].view(">u8").astype(U) if ends[-1] > ends[0] else np.zeros(0, U)
    size = np.diff(ends) // 8
    out = np.zeros((len(size), SIDE), U)
    row = np.repeat(np.arange(len(size)), size)
    out[row, _ragged(np.zeros(len(size), np.int64), size, 1)] = words
    return out, size


def _agreement(gram: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of rows sorted by gram and words: on how many words each agrees with the one before (-1: another gram)."""
    if not len(gram):
        return np.zeros(0, np.int64)
    differ = words[1:] != words[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), SIDE)
    return np.r_[-1, np.where(gram[1:] == gram[:-1], common, -1)]


def _repeats(chunk: pa.Table) -> Iterator[dict]:
    """Windows of a sorted chunk: spans that are settled here (kind 0) and windows
    to compare with other chunks' (kind 1)."""
    gram = _words_of(chunk.column("key"))[0][:, 0]
    same = gram[1:] == gram[:-1]
    edge = (gram == gram[0]) | (gram == gram[-1])
    kept = np.flatnonzero(np.r_[False, same] | np.r_[same, False] | edge)
    rows = chunk.take(pa.array(kept))
    gram, edge = gram[kept], edge[kept]
    (right, n_right), (left, n_left) = _words_of(rows.column("right")), _words_of(rows.column("left"))
    by_right = np.lexsort((*right.T[::-1], gram))
    by_left = np.lexsort((*left.T[::-1], gram))
    agree_right, agree_left = _agreement(gram[by_right], right[by_right]), _agreement(gram[by_left], left[by_left])
    doc = np.asarray(rows.column("doc_id").combine_chunks().fill_null(LAST_ID))
    uid, low = np.asarray(rows.column("uid")), np.asarray(rows.column("start")).astype(np.int64)
    # windows with l words to the left: two are equal if their rows agree on l words there and on the rest to the right
    found = []
    for l in range(SIDE + 1):  # noqa: E741
        row = np.flatnonzero((n_left >= l) & (n_right >= SIDE - l))
        if len(row):
            group = [np.empty(len(gram), np.int64) for _ in range(2)]
            group[0][by_right], group[1][by_left] = np.cumsum(agree_right < SIDE - l), np.cumsum(agree_left < l)
            found.append((row, (group[0][row] * (len(gram) + 1) + group[1][row]) * LEAST + l, low[row] + n_left[row] - l, np.full(len(row), l)))
    row, window, start, reach = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(4))
    order = np.lexsort((start, uid[row], doc[row], window))
    window, row, start, reach = window[order], row[order], start[order], reach[order]
    head = np.r_[True, window[1:] != window[:-1]][:len(window)]
    # rows that are equal in id, text and place are one occurrence
    again = ~head & np.r_[False, (doc[row][1:] == doc[row][:-1]) & (uid[row][1:] == uid[row][:-1]) & (start[1:] == start[:-1])][:len(window)]
    row, start, reach, head = row[~again], start[~again], reach[~again], head[~again]
    size = np.diff(np.r_[np.flatnonzero(head), len(head)])
    several = np.repeat(size > 1, size)
    settled = several & ~(head & edge[row])

    def to(pick: np.ndarray, kind: int, named) -> dict:
        at = np.flatnonzero(pick)
        return {"kind": np.full(len(at), kind, np.int32), "doc_id": doc[row[at]], "uid": uid[row[at]], "start": start[at],
                "window": named(row[at], reach[at]).astype(np.int64), "repeated": ~head[at], "several": several[at]}

    yield to(settled, 0, lambda r, l: np.zeros(len(r), U))
    yield to(head & edge[row], 1, lambda r, l: _window_hash(gram[r], left[r], right[r], l))


def _window_hash(gram: np.ndarray, left: np.ndarray, right: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
    """One hash of the windows that reach l words to the left of their gram and SIDE - l to the right."""
    column = np.arange(SIDE)
    power = np.multiply.accumulate(np.full(SIDE, BASE, U))
    sums = [np.where(column < reach[:, None], words * power, U(0)).sum(axis=1, dtype=U) for words, reach in ((left, l), (right, SIDE - l))]
    return mix(mix(mix(gram + l.astype(U)) + sums[0]) * U(BASE) + sums[1])


def _joined(found: dict) -> dict:
    """Consecutive starts of one document and role as one span."""
    order = np.lexsort((found["start"], found["repeated"], found["uid"], found["doc_id"]))
    f = {k: v[order] for k, v in found.items()}
    if not len(order):
        return {"kind": f["kind"], "doc_id": f["doc_id"], "uid": f["uid"], "start": f["start"], "end": f["start"], "window": f["window"], "repeated": f["repeated"], "several": f["several"]}
    new = np.r_[True, (f["doc_id"][1:] != f["doc_id"][:-1]) | (f["uid"][1:] != f["uid"][:-1]) | (f["repeated"][1:] != f["repeated"][:-1]) | (f["start"][1:] > f["start"][:-1] + 1)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(new) - 1]
    out = {k: v[new] for k, v in f.items()}
    out["end"] = f["start"][last] + LEAST
    return out


_SPANS = "kind int, doc_id long, uid long, start long, end long, window long, repeated boolean, several boolean"


def _compare(sorted_rows: DataFrame, chunk: int) -> DataFrame:
    def batch(f: dict) -> pa.RecordBatch:
        f = _joined(f) if len(f["kind"]) and f["kind"][0] == 0 else f | {"end": f["start"] + LEAST}
        ids = pa.array(f["doc_id"], pa.int64(), mask=f["doc_id"] == LAST_ID)
        return pa.RecordBatch.from_arrays([pa.array(f["kind"], pa.int32()), ids, *(pa.array(f[k], pa.int64()) for k in ("uid", "start", "end", "window")),
                                           pa.array(f["repeated"]), pa.array(f["several"])], names=[c.split()[0] for c in _SPANS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                held.append(b.slice(at, chunk))
                rows += held[-1].num_rows
                if rows >= chunk:
                    yield from map(batch, _repeats(pa.Table.from_batches(held)))
                    held, rows = [], 0
        if rows:
            yield from map(batch, _repeats(pa.Table.from_batches(held)))

    return sorted_rows.mapInArrow(run, _SPANS)


def repeated_passages(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, uid, start_word, end_word, repeated): disjoint spans of words, ends excluded.

    ``repeated`` is false for the first occurrence of a passage and true for the
    later ones. ``uid`` is xxhash64 of the text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    suffixes = _suffixes(docs)
    order = ["key", "right", "left", "doc_id", "uid", "start"]
    ranged = suffixes.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    found = saved(_compare(ranged, chunk), "repeats")
    # first occurrences of the windows at chunk edges: at most one a window and chunk
    meet = Window.partitionBy("window")
    turn = meet.orderBy(F.col("doc_id").asc_nulls_last(), "uid", "start")
    edges = (found.where("kind = 1").groupBy("window", "doc_id", "uid", "start", "end").agg(F.max("several").alias("several"))
             .withColumn("repeated", F.row_number().over(turn) > 1)
             .withColumn("several", F.col("several") | (F.count(F.lit(1)).over(meet) > 1)).where("several"))
    columns = ["doc_id", "uid", "start", "end", "repeated"]
    spans = found.where("kind = 0").select(*columns).union(edges.select(*columns))
    # a word that is repeated anywhere is repeated; spans of a role that overlap or touch become one
    text = Window.partitionBy("doc_id", "uid", "repeated").orderBy("start", "end")
    reach = F.max("end").over(text.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(text.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (spans.withColumn("reach", reach).withColumn("part", part).groupBy("doc_id", "uid", "repeated", "part")
            .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
            .select("doc_id", "uid", "start_word", "end_word", "repeated"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without the words of repeated passages (n_chars, where present, follows).

    A text loses its repeated words with the white space behind them; one that had
    words and keeps none goes. The first occurrence of every passage stays.
    """
    columns = docs.columns
    spans = repeated_passages(docs.select("doc_id", "text")).where("repeated").groupBy("doc_id", "uid").agg(
        F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
    # written, so that its size is known when the join with the texts is planned
    spans = saved(spans.select(F.col("doc_id").alias("cut_id"), F.col("uid").alias("cut_uid"), "cuts"), "cuts")
    row = F.struct(*[F.col(f"`{c}`") for c in columns if c != "text"]).alias("cut row")
    own_id, uid = F.col("doc_id").cast("long"), F.xxhash64("text")
    keyed = docs.select(row, "text", own_id.alias("own id"), uid.alias("own uid"), text_key(own_id, uid).alias("at"))
    row_type = keyed.schema["cut row"].dataType.simpleString()
    # a filter of fixed size tells texts that may have cuts: only those are shuffled to meet them
    cut_texts = text_filter(spans, "cut_id", "cut_uid")

    def dealt(some: bool) -> DataFrame:
        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                here = passed(cut_texts.value, np.asarray(b.column(4))) == some
                if here.any():
                    yield b.select([0, 1, 2, 3]).filter(pa.array(here))
        return keyed.mapInArrow(pick, f"`cut row` {row_type}, text string, `own id` long, `own uid` long")

    met = dealt(True).join(spans, F.col("own id").eqNullSafe(F.col("cut_id")) & (F.col("own uid") == F.col("cut_uid")), "left").select("cut row", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            cuts, texts = part.column(2).to_pylist(), part.column(1).to_pylist()
            if any(cuts):
                words = Words(part.column(1), hashed=False)
                for i, c in enumerate(cuts):
                    if c:
                        texts[i] = _without(words, i, c)
            stays = pa.array([not (c and not t) for c, t in zip(cuts, texts)])
            yield pa.RecordBatch.from_arrays([part.column(0).filter(stays), pa.array(texts, pa.string()).filter(stays)], names=["cut row", "text"])

    out = met.mapInArrow(run, f"`cut row` {row_type}, text string").union(dealt(False).select("cut row", "text"))
    fresh = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in columns else None}
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(f"`cut row`.`{c}`") for c in columns])


def _without(words: Words, i: int, cuts: list[dict]) -> str:
    """Text i without the given spans of words; empty if no word stays."""
    first, last, (a, z) = words.first[i], words.first[i + 1], words.text_at[i:i + 2]
    begin = np.r_[words.start[first:last], z]  # where each word starts, and the text's end
    stays, at = [], int(a)
    for c in cuts:
        stays.append(words.data[at:begin[c["start_word"]]].tobytes())
        at = int(begin[c["end_word"]])
    stays.append(words.data[at:z].tobytes())
    left = b"".join(stays).decode("utf-8")
    return left if left.strip(" \t\n\r\x0b\x0c") else ""
