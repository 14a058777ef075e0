"""BPE against tiktoken; token counts against a plain dynamic program."""
import hashlib
import struct

import public_tokenizers as vocab
import tiktoken
from helpers import awkward, awkward_rows, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, tokens

RANKS = bpe.read_ranks(vocab.path("byte_bpe_50k.tiktoken"))
PLAIN = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_encoding_equals_tiktoken_on_awkward_rows(spark):
    out = bpe.encode_documents(awkward(spark), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN)
    assert "score" in out.columns and "text" in out.columns
    rows = out.collect()
    assert len(rows) == len(awkward_rows())
    for r in rows:
        ids = PLAIN.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert bpe.encode_documents(empty(spark), vocab.path("byte_bpe_50k.tiktoken"), vocab.PATTERN).count() == 0


def test_short_and_long_matches_merge_alike(monkeypatch):
    words = [(x * n)[:n].encode() for x in ("the", "aab", "é ", "x0\n", "zqzqj") for n in (1, 2, 7, bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1, 200)]
    got = [bpe.encode_piece(w, RANKS) for w in words]
    monkeypatch.setattr(bpe, "SHORT", 0)
    assert got == [bpe.encode_piece(w, RANKS) for w in words]
    assert all(b"".join(bpe.Codec(RANKS, vocab.PATTERN).pieces[g].tolist()) == w for g, w in zip(got, words))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=60))
def test_encoding_equals_tiktoken_on_any_text(text):
    codec = bpe.Codec(RANKS, vocab.PATTERN)
    ids = codec.encode(text)
    assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == PLAIN.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdth ei", min_size=1, max_size=300))
def test_segment_tree_merges_the_leftmost_minimum(text):
    parts = [text.encode()[i:i + 1] for i in range(len(text))]
    while True:
        ranks = [RANKS.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        if not ranks or min(ranks) == 1 << 60:
            break
        i = ranks.index(min(ranks))
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    assert bpe.encode_piece(text.encode(), RANKS) == [RANKS[p] for p in parts]


def test_memo_limit_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 3)
    codec = bpe.Codec(RANKS, vocab.PATTERN)
    for text in ["the cat sat on the mat", "another text entirely", "the cat again"] * 2:
        ids = codec.encode(text)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == PLAIN.encode_ordinary(text)


PIECES = tokens.read_pieces(vocab.path("piece_bpe_32k.model"))


def plain_count(word):
    text = tokens.WORD_MARK + word
    best = [(0.0, 0)]
    for i, c in enumerate(text):
        n = len(c.encode())
        options = [(best[i][0] + n * tokens.BYTE_SCORE, best[i][1] - n)]
        options += [(best[j][0] + PIECES[text[j:i + 1]], best[j][1] - 1) for j in range(i + 1) if text[j:i + 1] in PIECES]
        best.append(max(options))
    return -best[-1][1]


def test_token_counts_equal_a_plain_dynamic_program(spark):
    docs = awkward(spark).where("length(text) < 30000 or text is null")
    rows = tokens.count_tokens(docs, vocab.path("piece_bpe_32k.model"), keep=["doc_id", "text", "score"]).collect()
    assert len(rows) == docs.count()
    known = {}
    for r in rows:
        found = [w.decode() for w in (r["text"] or "").encode().split()]
        for w in set(found) - known.keys():
            known[w] = plain_count(w)
        assert (r["n_words"], r["n_tokens"]) == (len(found), sum(known[w] for w in found))
    assert tokens.count_tokens(empty(spark), vocab.path("piece_bpe_32k.model")).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.sets(st.text(alphabet="thenigr漢é", min_size=1, max_size=12), max_size=20))
def test_trie_shares_prefixes_without_changing_counts(found):
    assert tokens.TrieCounter(PIECES).counts(found) == {w: plain_count(w) for w in found}
