"""Ranked lexical search with range-maximum tables over posting lists.

Every item's terms are looked up in all documents; a document's score for an item
is the sum of its terms' impacts (``impacts``), and each item's ``k`` best documents
are returned exactly.

1. Index. A task packs its documents into blocks: for each term a posting list in
   document order (document, occurrences), and each document's length. A block has
   at most ``POSTINGS`` postings and ``DOCS`` documents (one document may exceed the
   former by itself). Only terms that items ask for are kept, so the index is as long
   as its postings; the other terms count towards lengths and totals.
2. Totals: documents with a term, all terms, and documents by term are summed from
   all blocks, so impacts are those of the whole table.
3. Search. In a block each posting gets its impact, and a sparse table over the
   lists answers where a stretch of a list has its largest impact. An interval of
   documents is bounded by the sum of its terms' range maxima. Intervals are taken
   best bound first: the document with the largest impact in the interval is
   scored and splits it in two, each half with new bounds; an interval with few
   postings is scored whole. An interval whose bound lies under the k-th score found
   so far (in this and the task's earlier blocks) is left out. The best of all tasks
   are ranked by a window over (item, score), at most k rows an item and task.

Items are taken in passes of at most ``TERMS`` distinct terms (or one item), which
bounds what is broadcast; each pass reads the documents once. Terms are compared by
64-bit hashes.

Defined cases: a null or term-less text is no document of N and is never found; an
item without terms finds nothing; rows of documents with equal ids are documents of
their own; a null id comes after all others; items that repeat id and text are one
item, and items that share only the id are ranked apart.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import saved
from tessera.llm.vectors import Words, slices

#: Bounds of a block, and distinct terms of a pass over the documents.
POSTINGS, DOCS, TERMS = 1 << 19, 1 << 15, 1 << 20
#: An interval with fewer postings is scored whole; intervals taken at a time.
LEAF, WAVE = 2048, 32
_LAST = np.iinfo(np.int64).max

# ASCII bytes that are no letter or digit end a term.
BREAKS = np.zeros(256, bool)
BREAKS[:128] = True
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    BREAKS[ord(_first):ord(_last) + 1] = False


def term_words(texts: pa.Array) -> Words:
    return Words(texts, lower=True, breaks=BREAKS)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a term of weight w and tf occurrences adds to the score of a document of n terms."""
    m = 50 + (50 * n * n_docs) // max(n_terms, 1)
    return w * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


# ------------------------------------------------------------------- index

_BLOCK = "n_docs long, n_terms long, ids binary, nulls binary, lengths binary, terms binary, sizes binary, docs binary, counts binary"


class _Builder:
    """Documents and postings of the block that a task is filling."""

    def __init__(self):
        self.docs, self.postings, self.n_docs, self.n_terms = 0, 0, 0, 0
        self.parts: list[tuple] = []

    def add(self, ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, term: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        self.parts.append((ids, nulls, lengths, term, doc + self.docs, tf))
        self.docs += len(ids)
        self.postings += len(term)

    def row(self) -> pa.RecordBatch:
        ids, nulls, lengths, term, doc, tf = (np.concatenate([p[i] for p in self.parts]) if self.parts else np.zeros(0, np.int64) for i in range(6))
        order = np.lexsort((doc, term))
        term, doc, tf = term[order], doc[order], tf[order]
        head = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        values = [ids.astype("<i8"), nulls.astype(np.uint8), lengths.astype("<i8"), term[head].astype("<i4"),
                  np.diff(np.r_[head, len(term)]).astype("<i4"), doc.astype("<u2"), tf.astype("<u4")]
        cells = [[self.n_docs], [self.n_terms], *([v.tobytes()] for v in values)]
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * len(values)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def build_index(docs: DataFrame, vocabulary) -> DataFrame:
    """Blocks of the documents (doc_id, text) over the terms of ``vocabulary`` (a broadcast, sorted)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block = vocabulary.value, _Builder()
        for part in slices(batches, 1):
            words = term_words(part.column(1))
            lengths = np.diff(words.first)
            doc = np.repeat(np.arange(part.num_rows), lengths)
            at = np.minimum(np.searchsorted(known, words.hash), max(len(known) - 1, 0))
            hit = known[at] == words.hash if len(known) else np.zeros(len(doc), bool)
            pair, tf = np.unique(doc[hit] * len(known) + at[hit], return_counts=True)
            doc, term = np.divmod(pair, max(len(known), 1))
            held = np.unique(doc)  # a document without a known term can't be found
            ids = part.column(0).take(pa.array(held))
            nulls = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(_LAST))
            upto = np.searchsorted(doc, held, "right")
            first = 0
            while first < len(held):
                base = upto[first - 1] if first else 0
                room = max(1, int(np.searchsorted(upto, base + POSTINGS - block.postings, "right")) - first)
                to = min(len(held), first + min(room, DOCS - block.docs))
                if block.docs and block.postings + upto[to - 1] - base > POSTINGS:
                    yield block.row()
                    block = _Builder()
                    continue
                own = slice(base, upto[to - 1])
                block.add(ids[first:to], nulls[first:to], lengths[held[first:to]], term[own], np.searchsorted(held[first:to], doc[own]), tf[own])
                first = to
                if block.docs == DOCS or block.postings >= POSTINGS:
                    yield block.row()
                    block = _Builder()
            block.n_docs += int((lengths > 0).sum())
            block.n_terms += int(lengths.sum())
        if block.docs or block.n_docs:
            yield block.row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _BLOCK)


def totals(index: DataFrame, n_known: int) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms, and the number of documents of each known term (one number a term of the pass)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, some = np.zeros(n_known, np.int64), False
        for batch in batches:
            for terms, sizes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                df[np.frombuffer(terms, "<i4")] += np.frombuffer(sizes, "<i4")
                some = True
        if some:
            term = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], names=["term", "df"])

    sums = index.agg(F.sum("n_docs").alias("d"), F.sum("n_terms").alias("t")).first()
    rows = index.select("terms", "sizes").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(n_known, np.int64)
    df[rows["term"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return sums["d"] or 0, sums["t"] or 0, df


# ------------------------------------------------------------------ search

class RangeMaximum:
    """A sparse table over an array: where a range of it is largest."""

    def __init__(self, values: np.ndarray, longest: int):
        """``longest``: the longest range that is asked for."""
        self.values, self.table = values, [np.arange(len(values), dtype=np.int32)]
        step = 1
        while 2 * step <= longest:
            a, b = self.table[-1][:-step], self.table[-1][step:]
            self.table.append(np.where(values[a] >= values[b], a, b))
            step *= 2
        self.level_at = np.cumsum([0] + [len(t) for t in self.table])[:-1]
        self.flat = np.concatenate(self.table)

    def __call__(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Position of the maximum of each non-empty range lo..hi-1."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        base = self.level_at[level]
        a, b = self.flat[base + lo], self.flat[base + hi - (1 << level)]
        return np.where(self.values[a] >= self.values[b], a, b)


class Block:
    """A block's posting lists with their impacts."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, n_terms: int):
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.ids, self.nulls = get("ids", "<i8"), get("nulls", np.uint8)
        self.terms, sizes = get("terms", "<i4"), get("sizes", "<i4").astype(np.int64)
        self.first = np.r_[0, np.cumsum(sizes)]
        self.docs = get("docs", "<u2").astype(np.int64)
        owner = np.repeat(np.arange(len(self.terms)), sizes)
        self.impact = impacts(weights[self.terms][owner], get("counts", "<u4").astype(np.int64), get("lengths", "<i8")[self.docs], n_docs, n_terms)
        self.most = RangeMaximum(self.impact, int(sizes.max(initial=1)))
        self.keys = (owner << 16) | self.docs  # ascending: lists by term, documents within

    def bounds(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval (line) the sum of its terms' maxima, and the document of the largest."""
        some = hi > lo
        top = np.zeros(lo.shape, np.int64)
        at = np.zeros(lo.shape, np.int64)
        at[some] = self.most(lo[some], hi[some])
        top[some] = self.impact[at[some]]
        lead = top.argmax(axis=1)
        return top.sum(axis=1), self.docs[at[np.arange(len(lo)), lead]]

    def search(self, wanted: np.ndarray, best: Best) -> None:
        """Offer the documents of this block that may belong to the best for the terms ``wanted`` (ascending)."""
        own = np.flatnonzero(np.isin(self.terms, wanted))
        if not len(own):
            return
        lo, hi = self.first[own][None, :], self.first[own + 1][None, :]
        bound, split = self.bounds(lo, hi)
        scores = np.zeros(len(self.ids), np.int64)
        while True:
            open_ = bound >= max(best.least, 1)
            if not open_.any():
                return
            lo, hi, bound, split = lo[open_], hi[open_], bound[open_], split[open_]
            if len(bound) > WAVE:
                order = np.argpartition(-bound, WAVE)
                now, later = order[:WAVE], order[WAVE:]
            else:
                now, later = np.arange(len(bound)), np.zeros(0, np.int64)
            lo1, hi1, d = lo[now], hi[now], split[now]
            leaf = (hi1 - lo1).sum(axis=1) <= LEAF
            # documents of the leaves, and each other interval's split, are scored
            self._offer(_ranges(lo1[leaf].ravel(), hi1[leaf].ravel()), scores, best)
            lo1, hi1, d = lo1[~leaf], hi1[~leaf], d[~leaf]
            cut = np.searchsorted(self.keys, (own[None, :] << 16) | d[:, None])
            cut = np.clip(cut, lo1, hi1)
            held = (cut < hi1) & (self.docs[np.minimum(cut, len(self.docs) - 1)] == d[:, None])
            self._offer(cut[held], scores, best)
            lo2, hi2 = np.concatenate([lo1, cut + held]), np.concatenate([cut, hi1])
            bound2, split2 = self.bounds(lo2, hi2)
            lo, hi = np.concatenate([lo[later], lo2]), np.concatenate([hi[later], hi2])
            bound, split = np.r_[bound[later], bound2], np.r_[split[later], split2]

    def _offer(self, at: np.ndarray, scores: np.ndarray, best: Best) -> None:
        """Sum the impacts of the postings ``at``, which hold all postings of their documents."""
        if not len(at):
            return
        docs = self.docs[at]
        np.add.at(scores, docs, self.impact[at])
        docs = np.unique(docs)
        found = scores[docs]
        good = docs[(found > 0) & (found >= best.least)]
        best.offer(scores[good], self.ids[good], self.nulls[good])


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All positions of the ranges lo..hi-1."""
    size = hi - lo
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)


class Best:
    """The k best of what was offered, by score, then id (none last)."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.scores, self.ids, self.nulls = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        if not len(scores):
            return
        scores, ids, nulls = np.r_[self.scores, scores], np.r_[self.ids, ids], np.r_[self.nulls, nulls]
        order = np.lexsort((ids, nulls, -scores))[:self.k]
        self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]
        if len(order) == self.k:
            self.least = int(self.scores[-1])


def search_index(index: DataFrame, queries, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, score, doc_id): the k best documents of each task for each query (broadcast lists of term numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in queries.value]
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(batch.slice(i, 1).to_pylist()[0], weights.value, n_docs, n_terms)
                for wanted, b in zip(queries.value, best):
                    block.search(wanted, b)
        for q, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), q)), pa.array(b.scores), pa.array(b.ids, mask=b.nulls.astype(bool))],
                                                 names=["query", "score", "doc_id"])

    return index.mapInArrow(run, "query long, score long, doc_id long")


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct term hashes of each item, packed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            words = term_words(part.column(1))
            terms = [np.unique(words.hash[a:b]).astype("<u8").tobytes() for a, b in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.binary())], names=["item_id", "terms"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().mapInArrow(run, "item_id long, terms binary")


def passes(rows: Iterator, bound: int = TERMS) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(item ids, term hashes) of the items of each pass, read as a stream."""
    ids, terms, seen = [], [], 0
    for row in rows:
        own = np.frombuffer(bytes(row["terms"]), "<u8")
        if ids and seen + len(own) > bound:
            yield ids, terms
            ids, terms, seen = [], [], 0
        if len(own):
            ids.append(row["item_id"])
            terms.append(own)
            seen += len(own)
    if ids:
        yield ids, terms


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    found = []
    for ids, own in passes(saved(query_terms(items), "search-items").toLocalIterator(), terms):
        known = np.unique(np.concatenate(own))
        index = saved(build_index(docs, sc.broadcast(known)), "search-index")
        n_docs, n_terms, df = totals(index, len(known))
        weights = np.array([weight(n_docs, d) for d in df.tolist()], np.int64)
        queries = [np.searchsorted(known, t).astype(np.int32) for t in own]
        hits = search_index(index, sc.broadcast(queries), sc.broadcast(weights), n_docs, n_terms, k)
        names = spark.createDataFrame(list(enumerate(ids)), "number long, item_id long")
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = hits.withColumn("rank", rank).where(F.col("rank") <= k)
        found.append(saved(top.join(names, F.col("query") == F.col("number")).select("item_id", "rank", "doc_id", "score"), "search-found"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
