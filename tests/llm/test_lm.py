import math
import random
import re
import zlib
from collections import Counter

import pytest

from voxspark.llm import backoff_lm
from tests.llm.conftest import prose


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def held(i):
    return zlib.crc32(str(i).encode()) % 10 == 0


def brute(train):
    """P(token | last two) by the definition: counts and a prior dealt as the shorter context has it."""
    seqs = [["<edge>", *words(t), "<edge>"] for t in train]
    count = {k: Counter(tuple(s[i - k + 1 : i + 1]) for s in seqs for i in range(max(1, k - 1), len(s))) for k in (1, 2, 3)}
    n = sum(count[1].values())
    once, twice = (sum(c == m for c in count[1].values()) for m in (1, 2))
    unseen, types = (once + 0.5) / (n + 1), max(1, once**2 / (2 * twice + 1))

    def p(h, w):
        if not h:
            return (1 - unseen) * count[1][w,] / n if count[1][w,] else unseen / types
        prior, below = backoff_lm.PRIOR[len(h) - 1], p(h[1:], w)
        if not count[len(h)][h]:
            return below
        return (count[len(h) + 1][(*h, w)] + prior * below) / (count[len(h)][h] + prior)

    def score(text):
        s = ["<edge>", *words(text), "<edge>"]
        return sum(math.log10(p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s)))

    return score, p, count[1], types


@pytest.mark.parametrize("lanes", [1024, 7])
def test_scores(spark, docs, texts, monkeypatch, lanes):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(backoff_lm, "LANES", lanes)
    got = {r.doc_id: r for r in backoff_lm.lm_scores(docs).collect()}
    assert len(got) == len(texts)
    train = [t for i, t in texts if not held(i)]
    count = Counter(w for t in train for w in words(t))
    n, v, ends = sum(count.values()) + len(train), len(count) + 1, len(train)
    score, p, uni, types = brute(train)
    for h in ((), ("the",), ("<edge>",), ("the", "of"), ("<edge>", "the"), ("again", "again")):
        assert math.isclose(sum(p(h, w) for (w,) in uni) + types * p(h, "never seen"), 1)
    for i, t in texts:
        cs = [count[w] for w in words(t)] + [ends]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in cs)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(cs), sum(c > 0 for c in cs), n), i
        assert math.isclose(r.base_score, base, rel_tol=1e-9), i
        assert math.isclose(r.score, score(t), rel_tol=1e-9), (i, r.score, score(t))


def test_gibberish_is_less_likely_than_prose(spark, docs):
    rng = random.Random(3)
    new = [i for i in range(1000, 1400) if held(i)][:20]
    junk = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(60))
    more = [(i, prose(rng, 60) if k % 2 else junk()) for k, i in enumerate(new)]
    every = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {r.doc_id: r.score / r.n_tokens for r in backoff_lm.lm_scores(every).collect()}
    assert max(got[i] for i in new[::2]) < min(got[i] for i in new[1::2])


def test_without_training_documents(spark, docs):
    assert backoff_lm.lm_scores(docs.limit(0)).count() == 0
    i = next(i for i in range(100) if held(i))
    (r,) = backoff_lm.lm_scores(spark.createDataFrame([(i, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_ngrams_dont_depend_on_the_corpus_size(spark, monkeypatch):
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 400_000)
    rows = [(i, f"the quick red fox {i} sees the red dog") for i in range(12)]
    for filler in (1, 15_000):
        texts = rows + [(100 + i, "again " * filler) for i in range(20)]
        got = {r.doc_id: r.score for r in backoff_lm.lm_scores(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
        score, *_ = brute([t for i, t in texts if not held(i)])
        for i, t in rows:
            assert math.isclose(got[i], score(t), rel_tol=1e-9), (filler, i, got[i], score(t))


def test_more_blocks_than_buckets(spark, docs, texts, monkeypatch):
    from voxspark.llm import shared

    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", 20_000)
    want = {r.doc_id: r.score for r in backoff_lm.lm_scores(docs).collect()}
    monkeypatch.setattr(shared, "MOST_BUCKETS", 3)
    got = {r.doc_id: r.score for r in backoff_lm.lm_scores(docs).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in got)
