"""Nulls in every column, repeated rows, empty texts and clashing columns, through every operator and stage."""

import corpus_pipeline
import pytest

from tests.llm.conftest import prose
from voxspark.llm import backoff_lm, bagminhash, bucket_refinement, decontaminate, language_id, licenses, line_dedup, packing, quality, sharding

ROWS = 14


@pytest.fixture(scope="module")
def odd(spark):
    import random

    rng = random.Random(2)
    good = [prose(rng, 150) for _ in range(4)]
    rows = [
        (1, good[0], "en", "a", 1), (1, good[0], "en", "a", 1), (1, good[1], "en", None, None), (2, good[0], None, "b", 2), (None, good[2], "en", "a", 3),
        (None, good[2], "en", "a", 3), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "de", "a", 0), (5, " \n\t", None, "a", 3),
        (6, "x", "en", "a", 1), (-7, good[3], "en", "a", 4), (1 << 60, "a\u0000b     c‍ \U0001f600 " * 30, "en", "a", 5), (8, "word " * 3000, "fr", "a", 6),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    names = ["id", "block", "shard", "kept", "h1", "h2", "k", "pos", "line", "band", "doc", "size", "held_out", "score", "n_lines", "n_dropped", "n_words", "item_id"]
    return df.selectExpr("*", *[f"'clash' AS `{n}`" for n in names])


def test_a_row_for_each_row(odd):
    assert odd.count() == ROWS
    assert quality.quality_digest(odd).count() == ROWS
    assert line_dedup.line_dedup_digest(odd).count() == ROWS
    assert sharding.sharding_digest(odd).count() == ROWS
    assert language_id.languages(odd).count() == ROWS
    assert backoff_lm.lm_scores(odd).count() == ROWS
    rows = bucket_refinement.remove_repeats_digest(odd).collect()
    assert len(rows) == ROWS
    assert all((r.n_removed > 0) == (r.doc_id in (1, 2) or (r.doc_id == 1)) or r.n_removed == 0 for r in rows)
    assert all(r.n_removed == r.n_bytes for r in rows if r.doc_id == 2)
    pieces = packing.pack_documents(odd).collect()
    assert sum(r.start == 0 for r in pieces) == ROWS


def test_classes_leave_out_null_ids(odd):
    got = {r.doc_id: r.class_id for r in bagminhash.near_duplicates(odd).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, -7, 1 << 60, 8} and got[2] == got[1] == 1 and got[3] == 3 and got[4] == 4 and got[5] == 5
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 1, 1, 3, 4, 5, 6, -7, 1 << 60, 8, None, None, None]))


def test_searches(spark, odd):
    items = spark.createDataFrame([(1, odd.filter("doc_id = -7").first().text), (None, "x"), (2, None), (3, "x")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, items).collect()}
    assert got == {(-7, 1), (6, None), (6, 3)}
    assert decontaminate.without_contaminated(odd, items).columns == odd.columns
    assert licenses.license_spans(odd).count() == 0


def test_stages(spark, odd, tmp_path):
    spark.createDataFrame([(1, None), (None, "some words that nothing holds")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (odd, plain):
            out = stage(spark, docs, str(tmp_path))
            assert out.dtypes == docs.dtypes
            extra = docs.columns[5:]
            assert {tuple(r) for r in out.select(*extra).collect()} <= {("clash",) * len(extra)}
