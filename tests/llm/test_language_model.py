import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import language_model, trie_files
from scriptorium.llm.language_model import DISCOUNT, score_texts
from scriptorium.llm.trie_files import EliasFano, bits_at, open_arrays, pack_bits, write_arrays


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + ["<end>"]


def brute_force(texts, train):
    rows = [tokens(t) for t in texts]
    learned = [r for r, ok in zip(rows, train) if ok]
    c1 = Counter(w for r in learned for w in r)
    total, types = sum(c1.values()), len(c1)
    c2 = Counter(p for r in learned for p in zip(r, r[1:]))
    c3 = Counter(p for r in learned for p in zip(r, r[1:], r[2:]))

    def weight(grams, context, whole):
        own = [n for g, n in grams.items() if g[:-1] == context]
        assert not own or sum(own) == whole
        return DISCOUNT * len(own) / whole if own else 1.0

    def p1(w):
        return (c1[w] + 0.5) / (total + 0.5 * (types + 1))

    def p2(v, w):
        n = c2.get((v, w))
        g = weight(c2, (v,), c1[v]) if c1[v] else 1.0
        return (max(n - DISCOUNT, 0) / c1[v] if n else 0) + g * p1(w)

    def p3(u, v, w):
        if (u, v) not in c2:
            return p2(v, w)
        n = c3.get((u, v, w))
        return (max(n - DISCOUNT, 0) / c2[u, v] if n else 0) + weight(c3, (u, v), c2[u, v]) * p2(v, w)

    out = []
    for r in rows:
        logs = [math.log10(p1(r[0]))]
        logs += [math.log10(p2(*r[:2]))] if len(r) > 1 else []
        logs += [math.log10(p3(*r[k - 2 : k + 1])) for k in range(2, len(r))]
        out.append((len(r), sum(c1[w] > 0 for w in r), total, sum(math.log10(p1(w)) for w in r), sum(logs)))
    return out


def run(spark, rows):
    d = spark.createDataFrame(rows, "doc_id long, text string, train boolean, n_tokens string")
    got = score_texts(d, F.col("train")).collect()
    return {(r.doc_id): (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got}, len(got)


@pytest.mark.parametrize("part_tokens, flush", [(2_000_000, 2_000_000), (40, 300)])
def test_against_brute_force(spark, monkeypatch, part_tokens, flush):
    """Small parts deal frequent contexts over several files."""
    monkeypatch.setattr(language_model, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(language_model, "FLUSH", flush)
    monkeypatch.setattr(language_model, "SHARD_WORDS", 4 if flush < 1000 else 2_000_000)
    rng = random.Random(3)
    words = ["The", "the", "a", "cat", "dog", "ran", "sat", "on", "é", "mat x", "z"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 30]))) for _ in range(60)] + [None, "", " \n", "unseen words only"] + ["the cat sat on a mat"] * 5 + ["long " * 3000]
    rows = [(k, t, k % 5 != 1, "clash") for k, t in enumerate(texts)]
    got, n = run(spark, rows)
    want = brute_force(texts, [r[2] for r in rows])
    assert n == len(rows)
    for k, w in enumerate(want):
        assert got[k][:3] == w[:3]
        assert got[k][3] == pytest.approx(w[3], abs=1e-9)
        # each quantised factor is off by half a step at most; back-off chains add up to three
        assert got[k][4] == pytest.approx(w[4], abs=4e-4 * w[0])


def test_without_training_rows_and_without_rows(spark):
    got, _ = run(spark, [(1, "a b", False, None), (2, None, False, None)])
    assert got[1] == (3, 0, 0, pytest.approx(0.0), pytest.approx(0.0))
    assert run(spark, [])[1] == 0


def test_held_out_gain_over_the_base(spark):
    """Every n-gram counts: a text that stood once in training is told from one that did not."""
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randint(0, 300)}" for _ in range(60))
    seen, unseen = [text() for _ in range(40)], [text() for _ in range(40)]
    rows = [(k, t, True, None) for k, t in enumerate(seen)] + [(100 + k, t, False, None) for k, t in enumerate(seen + unseen)]
    got, _ = run(spark, rows)
    again, fresh = [got[100 + k][4] for k in range(40)], [got[140 + k][4] for k in range(40)]
    assert max(fresh) < min(again) and sum(fresh) > sum(got[140 + k][3] for k in range(40)) * 1.05


def test_packed_bits(tmp_path):
    rng = np.random.default_rng(4)
    for bits in (1, 7, 23, 32, 41, 63):
        for n in (0, 1, 63, 64, 1000):
            v = rng.integers(0, 2**bits, n)
            assert (bits_at(pack_bits(v, bits), bits, np.arange(n)) == v).all()


def test_opened_files_are_bounded(tmp_path, monkeypatch):
    monkeypatch.setattr(trie_files, "OPEN_FILES", 3)
    uris = [write_arrays(f"file://{tmp_path}", {"x": np.arange(k)}) for k in range(9)]
    for uri in uris * 2:
        assert (open_arrays(uri)["x"] == np.arange(uris.index(uri))).all() and len(trie_files._opened) <= 3


def test_elias_fano(tmp_path):
    rng = np.random.default_rng(1)
    for n, top in ((1, 0), (1, 1000), (500, 3), (1000, 10**9), (4000, 4000)):
        values = np.sort(rng.integers(0, top + 1, n))
        a = open_arrays(write_arrays(f"file://{tmp_path}", EliasFano.encode(values, "x")))
        assert (EliasFano(a, "x")[np.arange(n)] == values).all()
