import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest

from voxspark.llm import decontaminate, packing
from tests.llm.conftest import prose


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]+", low)


def brute(docs, items):
    out = {}
    for i, t in docs:
        w = tokens(t)
        for j, x in items:
            v = tokens(x)
            n, k = len(v), min(5, len(v))
            if not v:
                continue
            want = Counter(tuple(v[a : a + k]) for a in range(n - k + 1))
            for a in range(max(1, len(w) - n + 1)):
                part = w[a : a + n]
                own = Counter(tuple(part[b : b + k]) for b in range(len(part) - k + 1))
                both = sum((own & want).values())
                s = both / (own.total() + want.total() - both)
                if s >= 0.8 and s > out.get((i, j), (0,))[0]:
                    out[i, j] = (s, a, len(part))
    return out


@pytest.fixture(scope="session")
def leaks(texts):
    rng = random.Random(5)
    items = [(j, prose(rng, rng.choice([8, 15, 30, 50]))) for j in range(25)]
    items += [(30, "Three short words"), (31, ""), (32, None), (33, items[0][1].upper()), (34, "again " * 9)]
    rows = list(texts)
    for n in range(30):
        j, item = items[rng.randrange(25)]
        w = item.split(" ")
        if n % 3 == 1:
            w[0] = "edited"
        if n % 3 == 2:
            w = w[1:]
        rows.append((200 + n, " ".join([prose(rng, rng.choice([0, 40])), ", ".join([" ".join(w)]), prose(rng, 25)]).strip()))
    rows += [(240, "So, three SHORT words!"), (241, items[3][1]), (242, items[4][1] + "\n" + items[4][1])]
    return rows, items


def test_contaminated(spark, leaks):
    rows, items = leaks
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert len(want) > 25
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_words) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == want
    clean = decontaminate.without_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_item_blocks_cover_all(spark, leaks, monkeypatch):
    rows, items = leaks
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == set(brute(rows, items))


def test_hamming_search_is_complete():
    import numpy as np

    rng = np.random.default_rng(2)
    size = decontaminate.Size(ids=list(range(300)))
    size.finish(rng.normal(size=(300, 128)))
    probe = size.prints[rng.integers(0, 300, 200)].copy()
    bits = np.unpackbits(probe.view(np.uint8), axis=1)
    for b in bits:
        b[rng.choice(128, rng.integers(0, 60), replace=False)] ^= 1
    probe = np.packbits(bits, axis=1).view(np.uint16)
    apart = (np.unpackbits(probe.view(np.uint8), axis=1)[:, None] != np.unpackbits(size.prints.view(np.uint8), axis=1)[None]).sum(2)
    assert set(zip(*map(list, size.near(probe)), strict=True)) == set(zip(*map(list, np.nonzero(apart <= decontaminate.RADIUS)), strict=True))


def test_pack(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = "a  b c  d\x1c e\u0085 f 'll 'tis  \n\n x　 y 日本 語 <|endoftext|> z ​ q don't"
    extra = [(300, odd), (301, odd.replace("<|endoftext|>", "") * 3), (302, " lead"), (303, "trail  ")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    rows = packing.pack(both, path, window=64, shard_bytes=60_000).collect()
    assert len({r.shard for r in rows}) > 2
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in [*texts, *extra]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert not pieces
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    short = 0
    for parts in by.values():
        at = 0
        for o, m in sorted(parts):
            assert o == at
            at += m
        assert at <= 64
        short += at < 64
    assert short <= len({r.shard for r in rows})
    assert packing.pack(docs.limit(0), path).count() == 0


def test_neighbours_are_bm25():
    import math

    import numpy as np

    texts = ["red fish blue fish", "blue sky", "red red rose", "one fish", "sky", "", "tall tree", "small tree", "old car"]
    rows = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    index = packing.Index(np.array([r for r, _ in rows]), np.array([hash(w) & (1 << 60) - 1 for _, w in rows], np.uint64), len(texts))
    n, mean = len(texts), np.mean([len(t.split()) for t in texts])

    def score(q, d):
        out = 0
        for w in set(q.split()):
            df = sum(w in t.split() for t in texts)
            tf = d.split().count(w)
            if df > 1 and tf:
                out += q.split().count(w) * math.log((n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.split()) / mean))
        return out

    for seed, text in enumerate(texts):
        used = np.arange(n) == seed
        want = sorted((d for d in range(n) if d != seed and score(text, texts[d]) > 0), key=lambda d: (-score(text, texts[d]), d))
        assert index.neighbours(seed, used) == want


def test_fill_takes_the_seed_s_neighbours_first():
    class Fixed:
        def neighbours(self, seed, used):
            return {0: [3, 2]}.get(seed, [])

    got = packing.fill([6, 5, 4, 3], Fixed(), 8)
    assert got == [(0, 0, 6, 0, 0, 0), (3, 0, 2, 0, 6, 0), (3, 2, 1, 1, 0, 3), (1, 0, 5, 1, 1, 3), (2, 0, 2, 1, 6, 3), (2, 2, 2, 2, 0, 2)]


def test_neighbours_meet_in_a_shard(spark):
    """Of the near copies that an index of all documents ranks first, most are in the shard of their seed."""
    import random

    import numpy as np
    import public_tokenizers

    rng = random.Random(3)
    common, texts = [f"w{i}" for i in range(400)], []
    for group in range(150):
        base = [*rng.choices(common, k=60), *[f"topic{group}"] * 3]
        texts += [" ".join(base if not k else [w if rng.random() > 0.05 or w[0] == "t" else rng.choice(common) for w in base]) for k in range(4)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, t) for t in texts[:200]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), window=128, shard_bytes=12_000).collect()
    assert sum(r.start == 0 for r in got) == len(rows)
    shard = {r.doc_id: r.shard for r in got if r.doc_id is not None}
    assert len(set(shard.values())) > 10 and len({r.shard for r in got if r.doc_id is None}) > 5
    words = [(i, w) for i, t in enumerate(texts) for w in t.split()]
    index = packing.Index(np.array([i for i, _ in words]), np.array([hash(w) & (1 << 40) - 1 for _, w in words], np.uint64), len(texts))
    near = [(i, index.neighbours(i, np.arange(len(texts)) == i)[0]) for i in range(len(texts))]
    recall = sum(shard[i] == shard[j] for i, j in near) / len(near)
    print("neighbour recall", recall)
    assert recall > 0.8


def test_a_joined_vocabulary_packs_alike(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    # Shards of large keys are numbered as the partitions fall; all else is equal.
    sent, joined = (sorted(map(repr, packing.pack(docs, path, window=64, shard_bytes=60_000, most_terms=m).drop("shard", "sequence_id").collect())) for m in (1 << 20, 0))
    assert sent == joined and len(sent) > 500
    assert packing.pack(docs.limit(0), path, most_terms=-1).count() == 0


def test_plain_pieces_are_encoded_side_by_side(monkeypatch):
    """Words within a text go to the merger as one line; the ids are the tokenizer's, whatever the characters."""
    ids, one_by_one = packing.Ids(public_tokenizers.path("byte_bpe_50k.json")), []
    encode = ids._encode
    monkeypatch.setattr(ids, "_encode", lambda piece: one_by_one.append(piece) or encode(piece))
    texts = ["It's one, two; three... (four) 55 don't STOP", "a\nb c\r\n\td  e f ", " x café naïve Ɏ ŝ ɐ 漢字 ½ kk\x1cll m\x00n ª z q\u0085 r s t", "", "end ", " \n w  ", "last"]
    column = pa.array(texts * 2)
    (t,) = packing.textkit.slices(column)
    got, upto, _, _ = ids.of(t)
    assert [got[a:b].tolist() for a, b in zip(upto[:-1], upto[1:], strict=True)] == [ids.tokenizer.encode(x, add_special_tokens=False).ids for x in texts * 2]
    assert not {" one,", " two;", " (four)", " 55", " don't", " café", " naïve"} & set(one_by_one)


def test_hashes_are_told_apart_by_all_their_bits():
    """Sorted with their places in the lower bits, hashes that differ there alone are still told apart."""
    import numpy as np

    rng = np.random.default_rng(5)
    wide = rng.integers(1, 1 << 63, 300, dtype=np.uint64)[rng.integers(0, 300, 5000)]
    for value in (wide, wide ^ rng.integers(0, 2, 5000, dtype=np.uint64), np.arange(9, 0, -1).astype(np.uint64), wide[:1], wide[:0]):
        got = packing.textkit.distinct(value)
        assert all(np.array_equal(x, y) for x, y in zip(got, np.unique(value, return_index=True, return_inverse=True), strict=True))


def test_frequencies_go_out_as_a_row_for_each_bucket():
    import numpy as np

    texts = pa.record_batch({"text": [f"all w{i % 50} own{i}" for i in range(400)]})
    rows = pa.Table.from_batches(packing._frequencies(iter([texts, texts.slice(0, 100)]), 8))
    assert rows.num_rows <= 8  # a row for each of 451 terms before
    found = [packing._bucket(rows.filter(pa.compute.equal(rows.column("bucket"), b))) for b in rows.column("bucket").to_pylist()]
    found = pa.concat_tables(found)
    assert sum(found.column("pieces").to_pylist()) == 1500
    counts = sorted(x for x in found.column("df").to_pylist() if x)
    assert counts == [2] * 100 + [10] * 50 + [500]


def test_postings_of_used_documents_are_dropped():
    import numpy as np

    row = np.repeat(np.arange(40), 3)
    value = packing.textkit.mix(np.concatenate([[i % 4, 10 + i % 8, 100 + i] for i in range(40)]).astype(np.uint64))
    index, whole, used = packing.Index(row, value, 40), len(packing.Index(row, value, 40).doc), np.zeros(40, bool)
    for seed in range(30):
        used[seed] = True
        assert index.neighbours(seed, used) == packing.Index(row, value, 40).neighbours(seed, used)
    assert len(index.doc) <= whole // 3
