"""Every catalogue query against its SQL, and the values that were worked out when the fixtures were made."""

import math
import os
import re

import duckdb
import pytest

from voxspark.operators import occupancy
from voxspark.plans import catalogue, fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(repr(tuple(round(float(v), 6) if isinstance(v, float) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = duck.execute(f'SELECT {", ".join(f"""{chr(34)}{c}{chr(34)}""" for c in names)} FROM ({catalogue.oracle_sql()[name]})').fetchall()
    assert plain(df.select(*[f"`{c}`" for c in names]).collect()) == plain(want)


def test_fixture_sums(spark):
    r = fixtures.dense(spark, "/root/testdata/sf0.01").selectExpr("count(*) n", "sum(v) s", "count_if(v <> 0) nz").first()
    assert (r.n, r.s, r.nz) == (32000, 2828690, 22181)
    (c,) = catalogue.queries()["coverage_counts"](spark, "/root/testdata/sf0.01").collect()
    assert (c.present, c.zero, c.absent) == (4234, 2774, 1184)
    (q,) = catalogue.queries()["quality_basket"](spark, "/root/testdata/sf0.01").collect()
    assert (q.sse, q.max_err) == (147125, 4) and math.isclose(q.psnr, 39.91375, abs_tol=1e-5)


@pytest.mark.parametrize("name", ["atom_addressing", "lod_dims_grid", "sampled_verify", "zero_region_prepass"])
def test_keys_beyond_a_stored_volume(spark, tmp_path, name):
    """Part keys over 2^20: axes that are longer than those of a volume that can be stored."""
    con, far = duckdb.connect(), 1_100_000
    con.execute(f"COPY (SELECT * REPLACE (p_partkey + {far} AS p_partkey) FROM '{SF}/part.parquet') TO '{tmp_path}/part.parquet'")
    con.execute(f"COPY (SELECT * REPLACE (l_partkey + {far} AS l_partkey) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"COPY (FROM '{SF}/supplier.parquet') TO '{tmp_path}/supplier.parquet'")
    for t in ("part", "lineitem", "supplier"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    df = catalogue.queries()[name](spark, str(tmp_path))
    names = ", ".join(f'"{c}"' for c in df.columns)
    assert plain(df.collect()) == plain(con.execute(f"SELECT {names} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_transforms_shuffle_vectors_once_and_no_voxels(spark, tmp_path, monkeypatch):
    """Also with vectors that lack, a null one and an id below 0."""
    monkeypatch.setattr(fixtures, "QUADS", 1)
    con = duckdb.connect()
    con.execute(f"COPY (SELECT vec_id, CASE WHEN vec_id <> 7 THEN embedding END AS embedding FROM '{SF}/embeddings.parquet' WHERE vec_id < 700 AND vec_id % 50 <> 3 UNION ALL SELECT -1, embedding FROM '{SF}/embeddings.parquet' WHERE vec_id = 0) TO '{tmp_path}/embeddings.parquet'")
    con.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet' WHERE vec_id >= 0")
    df = catalogue.queries()["dct3_inverse_16"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    by = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "hashpartitioning(" in line]
    assert by.count("quad") == 1 and set(by) <= {"quad", "vec_id"}
    names = ", ".join(f'"{c}"' for c in df.columns)
    assert plain(df.collect()) == plain(con.execute(f"SELECT {names} FROM ({catalogue.oracle_sql()['dct3_inverse_16']})").fetchall())


def test_zero_regions_are_listed_after_the_shuffle(spark, tmp_path, monkeypatch):
    """They grow with the square of the input. Voxels without a z count too, and there may be none."""
    for name, n in (("TILE", 16), ("BAND", 3), ("MOST_TASKS", 5)):
        monkeypatch.setattr(occupancy, name, n, raising=False)
    con = duckdb.connect()
    odd = "l_partkey * 50 AS l_partkey, l_suppkey * 20 AS l_suppkey, CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey END AS l_orderkey"
    con.execute(f"COPY (SELECT * REPLACE ({odd}) FROM '{SF}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    con.execute(f"CREATE VIEW lineitem AS FROM '{tmp_path}/lineitem.parquet'")
    df = catalogue.queries()["zero_region_prepass"](spark, str(tmp_path))
    want = plain(con.execute(f"SELECT rz, ry, rx FROM ({catalogue.oracle_sql()['zero_region_prepass']})").fetchall())
    assert len(want) > 1000 and plain(df.collect()) == want
    listed = re.findall(r"Range \(0, (\d+)", df._jdf.queryExecution().executedPlan().toString())
    assert listed and sum(map(int, listed)) < len(want) / 4

    os.mkdir(tmp_path / "none")
    con.execute(f"COPY (FROM lineitem LIMIT 0) TO '{tmp_path}/none/lineitem.parquet'")
    assert catalogue.queries()["zero_region_prepass"](spark, str(tmp_path / "none")).collect() == []
