"""Token counts by trie-shared dynamic programming.

A pre-token is a word ``[^\\x20\\x09-\\x0D]+`` of the text with the vocabulary's
word mark in front. Its token count is the number of pieces of its best
segmentation under a unigram model: the vocabulary's pieces, with the score
-ln(rank + 1) of Zipf's law for the piece of that rank (the vocabulary file
orders pieces by merge, and its own score field is minus that rank). Code
points that no piece covers fall back to one piece per UTF-8 byte, each with
``BYTE_SCORE``. Of equally good segmentations the one with fewer pieces counts.

The distinct pre-tokens of a batch go into a trie; a walk over it computes the
forward score (best score and piece count of the prefix that ends at the node)
once per node, so pre-tokens that share a prefix share its work, and the
terminal nodes give the counts. Counts are kept per task for the batches that
follow, up to ``MEMO`` words (then the table is emptied; results don't change).

Defined cases: a null or empty text, or one of white space only, has 0 tokens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MEMO, MEMO_BYTES = 400_000, 96
#: Score of a byte piece: below every ordinary piece of a 32,000-piece vocabulary.
BYTE_SCORE = -12.0
#: The mark that stands for the space in front of a word (fixed value of the vocabulary's format).
WORD_MARK = "▁"


def read_pieces(path: str) -> dict[str, float]:
    """Piece -> score; control, unknown and byte pieces are left out."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = (i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return {sp.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(kept)}


class TrieCounter:
    """Counts the pieces of words; see the module text."""

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)

    def counts(self, words: set[str]) -> dict[str, int]:
        """Word -> number of pieces, for a set of distinct non-empty words."""
        trie: dict = {}
        for w in words:
            node = trie
            for c in WORD_MARK + w:
                node = node.setdefault(c, {})
            node[""] = w  # the terminal
        out: dict[str, int] = {}
        # Pre-order walk. best[d] is the forward score of the prefix of length
        # d on the current path, so a node's score is computed once for all
        # words below it.
        path: list[str] = []
        best: list[tuple[float, int]] = [(0.0, 0)]
        todo: list[tuple[int, str, dict]] = [(0, c, n) for c, n in trie.items()]
        get, longest = self.pieces.get, self.longest
        while todo:
            depth, c, node = todo.pop()
            del path[depth:], best[depth + 1:]
            path.append(c)
            n_bytes = len(c.encode("utf-8"))
            score, few = best[depth]
            top = (score + n_bytes * BYTE_SCORE, few - n_bytes)
            tail = ""
            for start in range(depth, max(-1, depth - longest), -1):
                tail = path[start] + tail
                s = get(tail)
                if s is not None:
                    top = max(top, (best[start][0] + s, best[start][1] - 1))
            best.append(top)  # the second part counts pieces downwards, so that fewer is larger
            for k, child in node.items():
                if k:
                    todo.append((depth + 1, k, child))
                else:
                    out[child] = -top[1]
        return out


def count_tokens(docs: DataFrame, pieces_path: str, keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words and n_tokens of the whole text."""
    made = ["n_words", "n_tokens"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in made]
    pieces = docs.sparkSession.sparkContext.broadcast(read_pieces(pieces_path))
    taken = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("counted text"))
    schema = ", ".join([*(f"`{c}` {taken.schema[c].dataType.simpleString()}" for c in keep), "n_words long", "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TrieCounter(pieces.value)
        memo: dict[bytes, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                split = [t.split() for t in part.column(len(keep)).to_pylist()]  # bytes.split() parts at the six ASCII spaces
                if len(memo) > MEMO:
                    memo.clear()
                new = {w for ws in split for w in ws if w not in memo}
                texts = {w.decode("utf-8"): w for w in new}
                memo.update((texts[t], n) for t, n in counter.counts(set(texts)).items())
                totals = [sum([memo[w] for w in ws]) for ws in split]
                for w in new:
                    if len(w) > MEMO_BYTES:
                        del memo[w]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), pa.array([len(ws) for ws in split], pa.int64()), pa.array(totals, pa.int64())],
                    names=[*keep, "n_words", "n_tokens"])

    return taken.mapInArrow(run, schema)

