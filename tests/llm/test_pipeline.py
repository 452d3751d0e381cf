import zlib

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_dedup import classes, key_of, words
from tests.llm.test_windows import brute

from voxspark.llm import quality


def test_stages_against_brute_force(spark, tmp_path, texts):
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(8)
    items = [(j, prose(rng, 20)) for j in range(5)]
    rows = [*texts, *((400 + j, prose(rng, 60) + " " + items[j][1] + " " + prose(rng, 60)) for j in range(5))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, got = docs, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns and now.dtypes == docs.dtypes
        rows_now = {r.doc_id: r for r in now.collect()}
        got.append(rows_now)
    good, lined, apart, clean = got
    verdicts = {r.doc_id: r.kept for r in quality.quality_digest(docs).collect()}
    assert set(good) == {i for i, kept in verdicts.items() if kept} and all(len(words(r.text)) >= 50 for r in good.values())
    held = {}
    for i, r in good.items():
        for x in r.text.split("\n"):
            held.setdefault(key_of(x), set()).add(i)
    for i, r in good.items():
        kept = [x for x in r.text.split("\n") if len(key_of(x)) < 20 or len(held[key_of(x)]) < 3 or max(held[key_of(x)]) == i]
        assert lined[i].text == "\n".join(kept) and lined[i].n_chars == len(lined[i].text)
    assert set(lined) == set(good)
    assert set(apart) == set(classes([(i, r.text) for i, r in lined.items()]).values())
    assert set(clean) == set(apart) - {i for i, _ in brute([(i, r.text) for i, r in apart.items()], items)}
    assert len(set(apart) - set(clean)) == 5
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(clean)
    for r in pieces:
        ids = [*tokenizer.encode(clean[r.doc_id].text, add_special_tokens=False).ids, 0][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_empty_tables(spark, tmp_path, docs):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.limit(0).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
