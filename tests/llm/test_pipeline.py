"""The pipeline's rows against a plain version of its five stages."""
import hashlib
import re
import struct

from helpers import words
from test_codecs import PLAIN
from test_repeats import plain_components, plain_repeats
from test_tables import plain_facts, water

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def plain_quality(rows):
    facts = {r[0]: plain_facts(r[1]) for r in rows}
    rules = {i: (n < 50, 100 * rep > 50 * n, 10 * sym > chars, 4 * dup > n) for i, (n, chars, sym, dup, rep) in facts.items()}
    hosts = {}
    for i, _, _, source, _ in rows:
        hosts.setdefault(source, []).append(rules[i])
    bad = set()
    for k in range(4):
        counts = {h: (len(x), sum(r[k] for r in x)) for h, x in hosts.items() if h is not None}
        n = sum(c for c, _ in counts.values())
        mean = sum(f for _, f in counts.values()) / n
        spread = max(sum(f * f / c for c, f in counts.values()) / n - mean * mean, 1e-12)
        strength = min(max(mean * (1 - mean) / spread - 1, 2), 1000)
        bad |= {h for h, (c, f) in counts.items() if (f + mean * strength) / (c + strength) >= 0.8}
    return [r for r in rows if not any(rules[r[0]][:2]) and r[3] not in bad]


def plain_cut(rows):
    repeated, _ = plain_repeats(rows)
    out = []
    for i, text, lang, source, _ in rows:
        if i in repeated:
            raw = text.encode()
            at = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)] + [len(raw)]
            text = (raw[:at[0]] + b"".join(raw[at[k]:at[k + 1]] for k in range(len(at) - 1) if k not in repeated[i])).decode()
            if not words(text):
                continue
        out.append((i, text, lang, source, 0))
    return out


def plain_mix(rows):
    size = {r[0]: len(words(r[1])) for r in rows}
    sources = {}
    for r in rows:
        sources.setdefault(r[3], []).append(r)
    total = {s: sum(size[r[0]] for r in x) for s, x in sources.items()}
    target = water(total)
    out = []
    for s, x in sources.items():
        rate = min(target[s] / total[s], 3.0) if total[s] else 0.0
        more, start = (rate - int(rate)) * total[s], 0
        for r in sorted(x, key=lambda r: hashlib.md5(f"17:{r[0]}".encode()).hexdigest()):
            out += [r] * (int(rate) + (start + size[r[0]] / 2 < more))
            start += size[r[0]]
    return out


def test_pipeline_equals_the_plain_stages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = plain_quality(rows)
    assert 0 < len(good) < len(rows)
    named = {i: c for i, _, c in plain_components(good)}
    one = [r for r in good if named[r[0]] == r[0]]
    assert len(one) < len(good)
    expected = []
    for i, text, _, source, _ in plain_mix(plain_cut(one)):
        ids = PLAIN.encode_ordinary(text)
        expected.append((i, source, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == sorted(expected)
    assert all(len(r["ids"]) == r["n_tokens"] for r in out)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
