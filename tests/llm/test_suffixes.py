import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from voxspark.llm import bucket_refinement, textkit
from tests.llm.conftest import prose


def brute(rows):
    raw = [(-1 << 63 if i is None else i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in raw:
        for s in range(len(b) - 49):
            k = b[s : s + 50]
            least[k] = min(least.get(k, i), i)
    out = []
    for (i, b), (name, _) in zip(raw, rows, strict=True):
        gone = bytearray(len(b))
        for s in range(len(b) - 49):
            if least[b[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((name, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block_bytes", "hot"), [(8 << 20, 1 << 16), (20_000, 1 << 16), (20_000, 5)])
def test_remove_repeats(spark, monkeypatch, texts, block_bytes, hot):
    monkeypatch.setattr(bucket_refinement, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(bucket_refinement, "HOT", hot)
    rng = random.Random(11)
    shared = [prose(rng, n) for n in (8, 10, 12, 40, 90)]
    rows = [r for r in texts if r[0] != 95]
    for n in range(60):
        parts = [rng.choice(shared) for _ in range(rng.randint(1, 3))]
        parts = [p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)] for p in parts]
        rows.append((500 - n, (prose(rng, rng.randint(0, 6)) + "".join(parts) + prose(rng, rng.randint(0, 6)))))
    rows += [(600, "ab" * 100), (601, "ba" * 80), (602, "a" * 300), (603, "a" * 49), (604, "a" * 50), (605, "a" * 51), (None, shared[3]), (606, shared[4]), (606, shared[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bucket_refinement.remove_repeats_digest(docs).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_texts_are_what_the_digest_says(spark, docs):
    rows = bucket_refinement.remove_repeats(docs).collect()
    assert all(hashlib.sha256(r.text).hexdigest() == r.kept_sha256 and len(r.text) == r.n_bytes - r.n_removed for r in rows)


def test_nothing(spark, docs):
    assert bucket_refinement.remove_repeats_digest(docs.limit(0)).count() == 0
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "short")], "doc_id long, text string")
    assert [r.n_removed for r in bucket_refinement.remove_repeats_digest(empty).collect()] == [0, 0, 0]


def test_identifiers_are_made_for_what_the_first_round_leaves(monkeypatch):
    """Contexts of one q-gram that differ around it are told apart by eight bytes, without an identifier of each offset."""
    r, n = np.random.default_rng(3), 400
    around = r.integers(1, 256, (n, bucket_refinement.REACH)).astype(np.uint8)
    around[1] = around[0]
    mixed, mix = [], textkit.mix
    monkeypatch.setattr(textkit, "mix", lambda x: mixed.append(x.size) or mix(x))
    bits = np.full(n, (1 << bucket_refinement.OFFSETS) - 1, np.uint32)
    hit = bucket_refinement.refine(np.zeros(n, np.uint64), around, bits, np.arange(n))
    assert np.flatnonzero(hit).tolist() == [1] and hit[1] == bits[1]
    assert sum(mixed) < 2.5 * bucket_refinement.OFFSETS * n


def test_contexts_are_the_bytes_and_distances_of_strings():
    rng = random.Random(5)
    texts = ["", "a" * 49, *("".join(rng.choice("ab c") for _ in range(rng.randint(40, 300))) for _ in range(40)), "é" * 60, "x" * 50]
    block = bucket_refinement.Block(pa.table({"doc_id": range(len(texts)), "id": range(len(texts)), "text": texts}))
    raw = block.data.tobytes()
    strings = [s for s in range(len(raw)) if any(a <= s and s + 50 <= b for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True))]
    assert sorted(s for a, b in zip(block.low, block.high, strict=True) for s in range(a, b + 1)) == strings
    around, bits = block.contexts()
    for k, (at, low, high) in enumerate(zip(block.at.tolist(), block.low.tolist(), block.high.tolist(), strict=True)):
        assert bytes(around[k]) == bytes(raw[p] if low <= p < high + 50 else 0 for p in range(at - 30, at + 50))
        assert bits[k] == sum(1 << d for d in range(31) if low <= at - d <= high)


def test_cuts_take_few_bytes_a_byte():
    """What marks a block's repeated bytes takes a few bytes for each of its bytes, so a long text doesn't take many times its size."""
    import tracemalloc

    import numpy as np

    from voxspark.llm.bucket_refinement import covered_by

    rng = np.random.default_rng(4)
    for n in (0, 7, 50, 51, 3000):
        begins = np.zeros(n, bool)
        begins[: max(n - 49, 0)] = rng.random(max(n - 49, 0)) < (1 if n == 51 else 0.01)
        want = np.zeros(n, bool)
        for at in np.flatnonzero(begins):
            want[at : at + 50] = True
        assert np.array_equal(covered_by(begins), want)
    begins = np.ones(1 << 20, bool)
    tracemalloc.start()
    covered = covered_by(begins)
    assert tracemalloc.get_traced_memory()[1] <= 4 << 20  # counts and their sums took 20 before
    tracemalloc.stop()
    assert covered.all()
