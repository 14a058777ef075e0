"""N-gram Jaccard join: a prefix-tree join over globally ordered shingle sets.

A text's set holds the 64-bit hashes of its distinct five-word shingles (A-Z
lower-cased; a shorter text is one shingle). Texts with equal sets are one
node, named by the hash of the set; the join looks for links between nodes.

1. Document frequencies of all shingles over all distinct sets are counted
   exactly (on the first 40 bits of the hash). Frequent shingles (at least
   ``FREQUENT`` sets) go to the end of the global order, by frequency; the
   rest are ordered by hash. Any order gives the same links; this one keeps
   shared passages out of the prefixes. The broadcast list of frequent shingles
   has at most ``LIST_MAX`` entries: if there are more, the bound on "frequent"
   rises until they fit, and the others keep their place by hash.
2. Two sets of at least 0.8 likeness share a shingle among the first
   n - ceil(0.8 n) + 1 of both. Prefix entries meet by shingle. For a shingle that
   fewer than ``FREQUENT`` prefixes hold, pairs are counted and kept when the shared
   part of their prefixes still allows the likeness. For any other only a
   star is drawn, over each stretch of sizes that are near enough to be linked. For
   one on the list each chunk of rows links its own sets and sends on the smallest
   and largest of each size class, so a hot shingle costs a few rows a chunk.
3. Components of these candidate edges are the units of the join: a link's
   two sets are always in one. The sets of a unit go to a cell, which
   stores them in a trie in global order. A probe walks the trie depth first,
   to the sets that share a shingle of their prefix with it, the prefixes being taken
   by the number of the cell's sets that hold a shingle (so that what most of a unit's
   sets share brings none of them together);
   the overlap with a path is computed once for all sets below it, and a
   subtree is left when the overlap plus what remains (of the probe, or of
   the longest set below) can't reach what the shortest set below needs, or
   when all sets below are already linked with the probe. A unit of more
   than ``BLOCK`` shingles is dealt to several cells: its sets are classed by size,
   so that linked sets are of one class or of neighbouring ones, classes are cut into
   blocks, and each pair of blocks that can hold links is a cell.
   Which sets go to which cells is known before the texts are read again; a filter
   of fixed size (``FILTER_BITS``) drops nearly all other texts before they are
   shuffled, and keys go through one exchange, by cell.
4. Components of the verified links give the answer.

Blobs: tasks send their keys as a few packed arrays a bucket, not as rows.
Sets are compared as 63-bit order keys; hash collisions (about 1e-13 for a pair
of texts of a thousand shingles) are accepted.

Defined cases: texts without words link with nothing and are their own
component; rows with a null id take part, and a component's id is its smallest
non-null id (null if it has none); repeated rows are equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components, labels
from tessera.llm.shared import bounded_batches, saved, shuffle_parts
from tessera.llm.vectors import U, Words, mix, shingles, slices

PERCENT = 80
FREQUENT, LIST_MAX = 64, 1 << 20
#: Keys a task gathers before it sends them on; shingles in a block of the join.
CHUNK, BLOCK = 500_000, 2_000_000
#: Candidate pairs worked on at a time; bytes of text; bits of the filter of represented texts (8 MiB).
SLAB, TEXTS, FILTER_BITS = 500_000, 1 << 18, 26
#: Sets that are compared without a look at their prefixes.
FEW = 6
_HEAVY = U(1) << U(63)


def _bounds() -> list[int]:
    """Least sizes of the size classes: each times 100 over PERCENT, rounded up, is the next, so that
    sets of one class can be linked, and those further apart than neighbouring classes can't."""
    out = [1]
    while out[-1] < 2**40:
        out.append(-(-100 * out[-1] // PERCENT))
    return out


_BOUNDS = np.array(_bounds())


def need(a, b):
    """Overlap that sets of a and b members need for the likeness."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n):
    return n - (-(-PERCENT * n // 100)) + 1


def _buckets(spark) -> int:
    """A power of two, 256 at least: then the rest of a 40-bit class has 32 bits at most."""
    return max(256, 1 << (4 * shuffle_parts(spark) - 1).bit_length() - 1)


def _sets(batches: Iterator[pa.RecordBatch], column: int = 1):
    """(row's other column as Arrow, list of sets) by slices."""
    for part in slices(batches, column, TEXTS):
        w = Words(part.column(column), lower=True)
        yield part, [shingles(w, i) for i in range(part.num_rows)]


def _set_id(s: np.ndarray) -> int:
    return int(mix(np.add.reduce(mix(s), keepdims=True) + U(len(s)))[0])


def _signed(i: int | None) -> int | None:
    return i if i is None or i < 1 << 63 else i - (1 << 64)


class Order:
    """The global order: light shingles by hash, then frequent ones by frequency."""

    def __init__(self, classes: np.ndarray, levels: np.ndarray):
        self.classes, self.levels = classes, levels

    def keys(self, s: np.ndarray) -> np.ndarray:
        out = s >> U(1)
        if len(self.classes):
            c = s >> U(24)
            at = np.minimum(np.searchsorted(self.classes, c), len(self.classes) - 1)
            hot = self.classes[at] == c
            out[hot] = _HEAVY | (self.levels[at[hot]] << U(56)) | (s[hot] >> U(8))
        return np.unique(out)


def _by_bucket(bucket: np.ndarray, arrays: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut):
        if len(part):
            yield int(bucket[part[0]]), [a[part].tobytes() for a in arrays]


def frequent_shingles(docs: DataFrame) -> DataFrame:
    """(class, sets): 40-bit shingle classes that FREQUENT distinct sets or more hold."""
    n_buckets = _buckets(docs.sparkSession)
    shift = U(64 - n_buckets.bit_length() + 1)
    rest_mask = U((1 << (int(shift) - 24)) - 1)

    def send(batches):
        def flush(kept):
            keys = np.concatenate(kept)
            rows = list(_by_bucket((keys >> shift).astype(np.int32), [((keys >> U(24)) & rest_mask).astype(np.uint32)]))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1][0] for r in rows], pa.binary())], names=["bucket", "keys"])

        kept, size, seen = [], 0, set()
        for _, sets in _sets(batches):
            for s in sets:
                if len(s) and (i := _set_id(s)) not in seen:
                    seen.add(i)
                    kept.append(s)
                    size += len(s)
            if size >= CHUNK:
                yield flush(kept)
                kept, size = [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
        if kept:
            yield flush(kept)

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        keys = np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("keys").to_pylist()])
        keys, n = np.unique(keys, return_counts=True)
        hot = n >= FREQUENT
        classes = (U(bucket) << (shift - U(24))) | keys[hot].astype(U)
        return pa.table({"class": classes.astype(np.int64), "sets": n[hot].astype(np.int64)})

    packed = docs.select("doc_id", "text").mapInArrow(send, "bucket int, keys binary")
    return packed.groupBy("bucket").applyInArrow(count, "class long, sets long")


def global_order(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Classes (ascending) and levels of the frequent shingles, LIST_MAX at most."""
    found = saved(frequent_shingles(docs), "frequent")
    # the list's size by bound: one row for each power of two
    sizes = {r["level"]: r["count"] for r in found.groupBy(F.floor(F.log2("sets")).cast("int").alias("level")).count().collect()}
    least = 0
    while sum(c for level, c in sizes.items() if level >= least) > LIST_MAX:
        least += 1
    rows = found.where(F.floor(F.log2("sets")) >= least).toPandas().sort_values("class")
    levels = np.minimum(np.log2(np.maximum(rows["sets"].to_numpy(), 1)) * 4, 127).astype(np.uint64)
    return rows["class"].to_numpy().astype(U), levels


def _prefix_entries(docs: DataFrame, order, n_buckets: int) -> DataFrame:
    """Kind 0: documents (doc_id, uid = xxhash64 of the text, a = set id, n). 1: edges (a, b) within a chunk. 2: packed prefix entries of a bucket."""
    shift = U(64 - n_buckets.bit_length() + 1)
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("uid", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def batch(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    def send(batches):
        by = Order(*order.value)
        seen: set[int] = set()
        kept: list = []
        size = 0

        def flush():
            token = np.concatenate([k[0] for k in kept])
            lens = [len(k[0]) for k in kept]
            sid = np.repeat(np.array([k[1] for k in kept], U), lens)
            n = np.repeat(np.array([k[2] for k in kept], np.uint32), lens)
            rest = np.repeat(np.array([k[3] for k in kept], np.uint32), lens)
            hot = token >= _HEAVY
            if hot.any():  # link a hot shingle's sets here, and send on those that can stand for them
                at = np.flatnonzero(hot)
                at = at[np.lexsort((sid[at], n[at], token[at]))]
                head = _heads(token[at], n[at])
                spoke = head != np.arange(len(at))
                star = np.unique(np.stack([sid[at][head[spoke]], sid[at][spoke]], 1), axis=0)
                if len(star):
                    yield batch(kind=np.full(len(star), 1, np.int32), a=star[:, 0].astype(np.int64), b=star[:, 1].astype(np.int64))
                # the smallest and the largest of each size class: any set that can be linked to one between them can be linked to one of these
                kind = np.stack([token[at], head.astype(U), np.searchsorted(_BOUNDS, n[at], "right").astype(U)])
                change = (kind[:, 1:] != kind[:, :-1]).any(axis=0)
                left = np.r_[np.flatnonzero(~hot), at[np.r_[True, change] | np.r_[change, True]]]
                token, sid, n, rest = token[left], sid[left], n[left], rest[left]
            rows = list(_by_bucket((mix(token) >> shift).astype(np.int32), [token, sid, n, rest]))
            yield batch(kind=np.full(len(rows), 2, np.int32), bucket=[r[0] for r in rows], blob=[b"".join(r[1]) for r in rows])

        for part, sets in _sets(batches):
            ids = [_set_id(s) if len(s) else None for s in sets]
            yield batch(kind=[0] * len(sets), doc_id=part.column(0).to_pylist(), uid=part.column(2).to_pylist(), a=[_signed(i) for i in ids], n=[len(s) for s in sets])
            for s, i in zip(sets, ids):
                if i is None or i in seen:
                    continue
                seen.add(i)
                keys = by.keys(s)
                prefix = keys[:prefix_length(len(keys))]
                light = int(np.searchsorted(prefix, _HEAVY))
                kept.append((prefix, i, len(keys), len(keys) - light))
                size += len(prefix)
            if size >= CHUNK // 2:
                yield from flush()
                kept, size = [], 0
                if len(seen) > 1_000_000:
                    seen.clear()
        if kept:
            yield from flush()

    return docs.select("doc_id", "text", F.xxhash64("text").alias("uid")).mapInArrow(send, "kind int, doc_id long, uid long, a long, b long, n long, bucket int, blob binary")


def _meet(table: pa.Table) -> pa.Table:
    """Candidate pairs of a bucket: counted for shingles of under FREQUENT sets (shared > 0), stars of others (shared 0)."""
    parts = []
    for x in table.column("blob").to_pylist():
        m = len(x) // 24
        parts.append((np.frombuffer(x, U, m), np.frombuffer(x, U, m, 8 * m), np.frombuffer(x, np.uint32, m, 16 * m), np.frombuffer(x, np.uint32, m, 20 * m)))
    token, sid, n, rest = (np.concatenate([p[i] for p in parts]) for i in range(4))
    by = np.lexsort((sid, token))
    token, sid, n, rest = token[by], sid[by], n[by].astype(np.int64), rest[by].astype(np.int64)
    once = np.r_[True, (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])]  # chunks may repeat a set
    token, sid, n, rest = token[once], sid[once], n[once], rest[once]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    size = np.diff(np.r_[first, len(token)])
    hot = (token[first] >= _HEAVY) | (size >= FREQUENT)  # a star joins all pairs that are not counted
    counted = [np.zeros((0, 4), np.int64)]
    for g in np.unique(size[(size > 1) & ~hot]):
        groups, step = first[(size == g) & ~hot], max(1, SLAB // int(g * (g - 1) // 2))
        for at in range(0, len(groups), step):
            counted.append(_pairs(groups[at:at + step], int(g), sid, n, rest))
    counted = np.concatenate(counted)
    many = np.flatnonzero(np.repeat(hot, size))
    many = many[np.lexsort((sid[many], n[many], token[many]))]
    head = _heads(token[many], n[many])
    own = head != np.arange(len(many))
    hub, spoke = many[head[own]], many[own]
    nothing = np.zeros(len(hub), np.int64)
    return pa.table({"a": np.r_[counted[:, 0], sid[hub].astype(np.int64)], "b": np.r_[counted[:, 1], sid[spoke].astype(np.int64)],
                     "shared": np.r_[counted[:, 2], nothing], "lacks": np.r_[counted[:, 3], nothing]})


def _heads(token: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For rows sorted by shingle and size, the first row of the stretch of its shingle
    in which no size is too far from the one before to be linked.

    Two sets that can be linked are in one stretch: what lies between them in size is
    near enough too. So stretches, joined as stars, hold every link of a hot shingle."""
    if not len(token):
        return np.zeros(0, np.int64)
    n = n.astype(np.int64)
    new = np.r_[True, (token[1:] != token[:-1]) | (100 * n[:-1] < PERCENT * n[1:])]
    return np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))


def _pairs(first: np.ndarray, g: int, sid: np.ndarray, n: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """(a, b, shingles shared here, shared prefix shingles that the pair needs) for the pairs within groups of g postings."""
    i, j = np.triu_indices(g, 1)
    a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
    near = 100 * np.minimum(n[a], n[b]) >= PERCENT * np.maximum(n[a], n[b])
    a, b = a[near], b[near]
    by = np.lexsort((sid[b], sid[a]))
    a, b = a[by], b[by]
    head = np.flatnonzero(np.r_[True, (sid[a][1:] != sid[a][:-1]) | (sid[b][1:] != sid[b][:-1])]) if len(a) else np.zeros(0, int)
    shared = np.diff(np.r_[head, len(a)])
    a, b = a[head], b[head]
    lacks = need(n[a], n[b]) - np.maximum(rest[a], rest[b])
    return np.stack([sid[a].astype(np.int64), sid[b].astype(np.int64), shared.astype(np.int64), lacks], axis=1)


class Trie:
    """Sorted sets as a trie: a node covers the depths start..end of the sets lo..hi-1."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        self.common = np.array([self._common(a, b) for a, b in zip(sets, sets[1:])], np.int64)
        self.root = self._node(0, len(sets), 0)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    def _node(self, lo: int, hi: int, start: int):
        """[start, end, lo, hi, shortest, longest, children, first set of each child]; built without recursion, since paths can be deep."""
        def make(lo: int, hi: int, start: int) -> list:
            if hi - lo == 1:
                return [start, n := len(self.sets[lo]), lo, hi, n, n, [], None]
            return [start, int(self.common[lo:hi - 1].min()), lo, hi, int(self.size[lo:hi].min()), int(self.size[lo:hi].max()), [], None]

        root = make(lo, hi, start)
        todo = [root]
        while todo:
            node = todo.pop()
            _, end, lo, hi, *_ = node
            if hi - lo == 1:
                continue
            node[7] = np.r_[lo, np.flatnonzero(self.common[lo:hi - 1] == end) + lo + 1]
            for a, b in zip(node[7].tolist(), [*node[7][1:].tolist(), hi]):
                child = make(a, b, end)
                node[6].append(child)
                todo.append(child)
        return root

    def _prefixes(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Postings of the sets' prefixes: (set of each posting, first posting of the same shingle,
        each set's postings). Prefixes here are by the shingles' number of sets in the trie, fewest
        first, so that what most sets share joins none by itself; a shingle's sets are ascending."""
        owner = np.repeat(np.arange(len(self.sets)), self.size)
        _, token, sets = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        by = np.lexsort((token, sets[token], owner))
        begin = np.cumsum(self.size) - self.size
        head = by[np.arange(len(by)) - begin[owner] < prefix_length(self.size)[owner]]
        head = head[sets[token[head]] > 1]
        head = head[np.lexsort((owner[head], token[head]))]
        token, owner = token[head], owner[head]
        by = np.lexsort((sets[token], owner))
        return owner, np.searchsorted(token, token), np.split(by, np.searchsorted(owner[by], np.arange(1, len(self.sets))))

    def links(self) -> list[tuple[int, int]]:
        """Links that join all sets which are linked directly or through others.

        A probe goes down the trie to sets before it that have a shingle of its prefix in
        theirs and aren't joined with it yet: a few of them first, since one link may join it
        with all. ``even`` is the number of first postings of a shingle that are known to be
        joined with each other; a probe that is joined with one of them passes by them."""
        label = np.arange(len(self.sets))
        members = {k: [k] for k in range(len(self.sets))}
        out = []

        def probe(x: int, some: np.ndarray) -> None:
            keys, nx = self.sets[x], len(self.sets[x])
            low, high = -(-PERCENT * nx // 100), 100 * nx // PERCENT
            todo = [(self.root, 0, some)]
            while todo:
                node, overlap, some = todo.pop()
                some = some[label[some] != label[x]]
                if not len(some):
                    continue
                start, end, lo, _, shortest, longest, children, at_child = node
                if longest < low or shortest > high:
                    continue
                passed = 0
                if end > start:
                    path = self.sets[lo][start:end]
                    at = np.searchsorted(keys, path)
                    overlap += int((keys[np.minimum(at, nx - 1)] == path).sum())
                    passed = int(np.searchsorted(keys, path[-1], "right"))
                elif end:
                    passed = int(np.searchsorted(keys, self.sets[lo][end - 1], "right"))
                if overlap + min(nx - passed, longest - end) < need(nx, max(shortest, low)):
                    continue
                if children:
                    child = np.searchsorted(at_child, some, "right") - 1
                    cut = np.flatnonzero(np.diff(child)) + 1
                    todo.extend((children[child[a]], overlap, some[a:b]) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(some)]))
                elif 100 * overlap >= PERCENT * (nx + len(self.sets[lo]) - overlap):
                    out.append((lo, x))
                    a, b = sorted((int(label[lo]), int(label[x])), key=lambda k: len(members[k]))
                    label[members[a]] = b
                    members[b] += members.pop(a)

        if len(self.sets) <= FEW:  # not worth the postings
            for x in range(1, len(self.sets)):
                probe(x, np.arange(x))
            return out
        owner, first, postings = self._prefixes()
        even, probed = np.ones(len(owner), np.int64), np.full(len(self.sets), -1)
        for x, mine in enumerate(postings):
            low, high = -(-PERCENT * len(self.sets[x]) // 100), 100 * len(self.sets[x]) // PERCENT
            at, step = 0, 1
            while at < len(mine):
                part, at, step = mine[at:at + step], at + step, 2 * step
                a = first[part]
                begin = np.where(label[owner[a]] == label[x], a + even[a], a)
                found = [owner[i:j] for i, j in zip(begin, part) if i < j]
                some = np.concatenate(found) if found else np.zeros(0, np.int64)
                some = np.unique(some[(label[some] != label[x]) & (probed[some] != x) & (self.size[some] >= low) & (self.size[some] <= high)])
                few = 2
                while len(some):  # the nearest in the order first
                    probed[some[-few:]] = x
                    probe(x, some[-few:])
                    some = some[:-few]
                    some, few = some[label[some] != label[x]], 4 * few
            a = first[mine]
            mine = mine[joined := label[owner[a]] == label[x]]
            a = a[joined]
            new = a + even[a] < mine
            whole = ~new
            whole[new] = [bool((label[owner[i:j]] == label[x]).all()) for i, j in zip(a[new] + even[a[new]], mine[new])]
            whole &= a < mine
            even[a[whole]] = mine[whole] - a[whole] + 1
        return out


def trie_join(table: pa.Table) -> pa.Table:
    """Links (a, b) between the sets of one unit."""
    ids = table.column("sid").to_pylist()
    sets = [np.frombuffer(x, U) for x in table.column("keys").to_pylist()]
    once = {sid: i for i, sid in enumerate(ids)}  # tasks may repeat a set
    order = sorted(once.values(), key=lambda i: (sets[i].astype(">u8").tobytes(), ids[i]))
    pairs = Trie([sets[i] for i in order]).links()
    found = pa.table({"a": pa.array([ids[order[i]] for i, _ in pairs], pa.int64()), "b": pa.array([ids[order[j]] for _, j in pairs], pa.int64())})
    several = table.column("several")[0].as_py()
    found = found if several else _stars(found)
    return found.append_column("several", pa.array([several] * len(found), pa.bool_()))


def _stars(links: pa.Table) -> pa.Table:
    """Each node of the links pointed at the smallest it reaches (a > b); as many rows as links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist()):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    far = [x for x in parent if find(x) != x]
    return pa.table({"a": pa.array(far, pa.int64()), "b": pa.array([find(x) for x in far], pa.int64())})


def _named(docs: DataFrame) -> DataFrame:
    """(doc_id, uid, n_shingles, set_id, component_id, first) for each row of ``docs`` (doc_id, text).

    ``uid`` is xxhash64 of the text, ``first`` the first document of the row's
    component: (no_id, doc_id, uid), null for a text without words.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    order = spark.sparkContext.broadcast(global_order(docs))
    n_buckets = _buckets(spark)
    entries = _prefix_entries(docs, order, n_buckets)
    routed = entries.withColumn("bucket", F.coalesce("bucket", F.pmod(F.hash("kind", "doc_id", "a", "b"), F.lit(n_buckets))))
    met = saved(_through(routed), "jaccard-met")
    rows = met.where("kind = 0").select("doc_id", "uid", F.col("a").alias("set_id"), F.col("n").alias("n_shingles"))
    pairs = (met.where("kind = 1 and shared > 0").groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("lacks").alias("lacks"))
             .where("shared >= lacks").select("a", "b"))
    stars = met.where("kind = 1 and shared = 0").select("a", "b").distinct()
    units = saved(components(pairs.union(stars), "a", "b"), "jaccard-units")
    # one document of each set, by id (nulls last) and text
    classes = rows.where("set_id is not null").groupBy("set_id").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("rep"), F.max("n_shingles").alias("size"))
    # written, so that its size is known when the join with the texts is planned
    chosen = saved(classes.join(units, F.col("set_id") == F.col("node")).select(
        "set_id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.uid").alias("rep_uid"), "size", "component"), "jaccard-chosen")
    found = saved(_unit_links(docs, saved(_cells(chosen), "jaccard-cells"), order), "jaccard-links")
    # links never leave a unit, so only units of several cells need another round
    links = labels(found.where("not several"), "a", "b").union(components(found.where("several"), "a", "b"))
    labelled = classes.join(links, F.col("set_id") == F.col("node"), "left").select("set_id", "rep", F.coalesce("component", "set_id").alias("label"))
    # nulls come last, so the first document has the component's smallest non-null id
    least = labelled.groupBy("label").agg(F.min("rep").alias("first"))
    names = labelled.join(least, "label").select(F.col("set_id").alias("named"), "first")
    return rows.join(names, F.col("set_id") == F.col("named"), "left").select(
        "doc_id", "uid", "n_shingles", "set_id", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) for each row of ``docs`` (doc_id, text)."""
    return _named(docs).select("doc_id", "n_shingles", "set_id", "component_id")


def _through(routed: DataFrame) -> DataFrame:
    """Documents and chunk edges as they are; prefix entries as candidate pairs."""
    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        plain = table.filter(pa.array(kind < 2)).select(["kind", "doc_id", "uid", "a", "b", "n"])
        plain = plain.append_column("shared", pa.array(np.zeros(len(plain)), pa.int64())).append_column("lacks", pa.array(np.zeros(len(plain)), pa.int64()))
        blobs = table.filter(pa.array(kind == 2))
        if not len(blobs):
            return plain
        found = _meet(blobs)
        nothing = pa.nulls(len(found), pa.int64())
        found = pa.table({"kind": pa.array(np.ones(len(found)), pa.int32()), "doc_id": nothing, "uid": nothing, "a": found["a"], "b": found["b"], "n": nothing,
                          "shared": found["shared"], "lacks": found["lacks"]})
        return pa.concat_tables([plain, found])

    return routed.groupBy("bucket").applyInArrow(run, "kind int, doc_id long, uid long, a long, b long, n long, shared long, lacks long")


def size_class(size: Column) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in _bounds()]), lambda b: b <= size))


def _cells(chosen: DataFrame) -> DataFrame:
    """``chosen`` with the cells of each set, and whether its unit has several.

    A small unit is the cell (0, 0). In another, a set is in block ``own`` of its size
    class, and meets its class's blocks and those of the neighbouring classes.
    """
    classed = chosen.withColumn("class", size_class(F.col("size")))
    # shingles by class: some 120 classes a unit at most
    counts = classed.groupBy("component", "class").agg(F.sum("size").alias("n"))
    units = counts.groupBy("component").agg(
        F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("class", (F.floor(F.col("n") / BLOCK) + 1).cast("int")))).alias("blocks"))
    # only units of several cells are looked up (one for BLOCK shingles at most); written, so that their number is known
    several = saved(units.where(F.col("total") > BLOCK).select(F.col("component").alias("unit"), "blocks"), "jaccard-large")
    met = classed.join(several, F.col("component") == F.col("unit"), "left").withColumn("several", F.col("unit").isNotNull())
    blocks = lambda c: F.coalesce(F.try_element_at("blocks", c), F.lit(0))
    name = lambda c, b: c.cast("long") * (1 << 32) + b
    own = F.pmod(F.xxhash64("set_id"), F.greatest(blocks(F.col("class")), F.lit(1))).cast("int")
    mine = name(F.col("class"), own)
    others = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.when(blocks(F.col("class") + d) > 0, F.transform(
        F.sequence(F.lit(0), blocks(F.col("class") + d) - 1), lambda k: name(F.col("class") + d, k))).otherwise(F.array().cast("array<bigint>"))))
    pairs = F.transform(others, lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j")))
    return met.select("set_id", "rep_id", "rep_uid", "component", "several", F.when(F.col("several"), pairs).otherwise(one).alias("cells"))


def text_key(doc_id: Column, uid: Column) -> Column:
    """Place of a text in the filter."""
    return F.shiftrightunsigned(F.xxhash64(doc_id, uid), 64 - FILTER_BITS).cast("int")


def text_filter(texts: DataFrame, id_col: str, uid_col: str):
    """A broadcast bitmap of 2 ** FILTER_BITS bits, whatever the table's size: set where one of the texts falls.

    At most 2 ** (FILTER_BITS - 16) rows of 8 KiB reach the driver."""
    def packed(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 16, np.uint8)
        bits[np.asarray(table.column("bit").combine_chunks())] = 1
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    places = texts.select(text_key(F.col(id_col), F.col(uid_col)).alias("at")).distinct()  # 65,536 a part at most
    parts = places.select(F.shiftright("at", 16).alias("part"), F.col("at").bitwiseAND(0xFFFF).alias("bit")).groupBy("part").applyInArrow(packed, "part int, bits binary")
    bitmap = np.zeros((1 << (FILTER_BITS - 16), 1 << 13), np.uint8)
    for row in parts.collect():
        bitmap[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return texts.sparkSession.sparkContext.broadcast(bitmap.ravel())


def passed(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each place's bit is set."""
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def _unit_links(docs: DataFrame, cells: DataFrame, order) -> DataFrame:
    seen_texts = text_filter(cells, "rep_id", "rep_uid")

    def wanted(batches):
        bitmap = seen_texts.value
        for b in batches:
            here = passed(bitmap, np.asarray(b.column(3)))
            if here.any():
                yield b.select([0, 1, 2]).filter(pa.array(here))

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("uid"), text_key(F.col("doc_id"), F.xxhash64("text")).alias("at"))
    texts = keyed.mapInArrow(wanted, "doc_id long, text string, uid long").join(
        cells, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("uid") == F.col("rep_uid"))).select("set_id", "text", "component", "several", "cells")

    def run(batches):
        by = Order(*order.value)
        seen: set[int] = set()
        for part, sets in _sets(batches):
            # repeated rows: a task sends a set once
            own = pa.array([not (i in seen or seen.add(i)) for i in part.column(0).to_pylist()])
            if len(seen) > 1_000_000:
                seen.clear()
            keys = pa.array([by.keys(s).tobytes() if ok else b"" for s, ok in zip(sets, own.to_pylist())], pa.binary())
            columns = [part.column(0), part.column(2), part.column(3), part.column(4), keys]
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in columns], names=["sid", "component", "several", "cells", "keys"])

    sets = texts.mapInArrow(run, "sid long, component long, several boolean, cells array<struct<i:bigint,j:bigint>>, keys binary")
    return sets.select("sid", "keys", "component", "several", F.explode("cells").alias("cell")).groupBy("component", "cell.i", "cell.j").applyInArrow(
        trie_join, "a long, b long, several boolean")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one row for each component: its first document by id (nulls last) and text.

    A document is an id (or none) and a text, so rows that share an id are judged
    apart. Of rows that repeat both, one stays: the smallest by its other columns.
    A text without words is a component for each id.
    """
    found = _named(docs.select(F.col("doc_id").cast("long"), "text"))
    first = F.col("set_id").isNull() | (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("uid") == F.col("first.uid")))
    # documents that go, and those that stay but have several rows;
    # written, so that its size is known when the join with the texts is planned
    met = saved(found.groupBy(F.col("doc_id").alias("met id"), F.col("uid").alias("met uid"))
                .agg(F.min(first).alias("met first"), F.count(F.lit(1)).alias("met rows")).where("not `met first` or `met rows` > 1"), "jaccard-met-again")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("met id")) & (F.xxhash64("text") == F.col("met uid"))
    alone = docs.join(met, same, "left_anti")
    # one row of each, taken map-side first; nothing to read where no row repeats
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("met row")
    several = docs.join(met.where("`met first`"), same).groupBy("met id", "met uid").agg(F.min(row).alias("met row")).select("met row.*")
    return alone.union(several)
