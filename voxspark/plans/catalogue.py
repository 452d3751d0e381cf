"""The registered queries on volumes, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.codec import atoms as codec
from voxspark.codec import masked
from voxspark.functions import addressing as A
from voxspark.model import MOST_LODS, Box, Extent
from voxspark.operators import analytics, coverage, metrics, occupancy, pyramid, repack, transform
from voxspark.plans import export, fixtures
from voxspark.plans.fixtures import sql
from voxspark.streaming import appends

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = oracle
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _dims(voxels: DataFrame) -> Extent:
    m = voxels.agg(F.max("x"), F.max("y"), F.max("z")).first()
    return Extent(m[0] + 1, m[1] + 1, m[2] + 1)


BLOCK_KEYS = ["block", "z", "y", "x"]
#: With what rows are partitioned by, so that no pass of a transform shuffles.
SPREAD_KEYS = ["quad", *BLOCK_KEYS]
Q = 4.0
_DCT = transform.values_sql(transform.dct_matrix(16), "k, i, c")
_STEP = transform.values_sql(transform.step_table(16, Q), "f, sq")
_LEVEL = "CASE WHEN 10 * abs(v) * 1048576 >= 8 * sq THEN least(32767, (abs(v) * 10485760 - 8 * sq) // (10 * sq) + 1) * sign(v) ELSE 0 END"


def _pass(source: str, axis: str, inverse: bool = False) -> str:
    by, to = ("k", "i") if inverse else ("i", "k")
    keys = ", ".join(f"m.{to} {c}" if c == axis else f"s.{c}" for c in BLOCK_KEYS)
    return f"SELECT {keys}, cast((sum(cast(m.c AS bigint) * s.v) + 8192) >> 14 AS bigint) v FROM {source} s JOIN dct m ON m.{by} = s.{axis} GROUP BY ALL"


_CHAIN = {
    "dct": _DCT,
    "steps": _STEP,
    "c0": "SELECT block, z, y, x, v - 128 v FROM vb",
    "c1": _pass("c0", "x"),
    "c2": _pass("c1", "y"),
    "cf": _pass("c2", "z"),
    "lv": f"SELECT block, z, y, x, z + y + x f, cast({_LEVEL} AS int) AS level, sq FROM cf JOIN steps ON f = z + y + x",
    "dq": "SELECT block, z, y, x, cast(sign(level) * floor((abs(level) + cast(0.2 AS double)) * sq / 1048576.0 + 0.5) AS bigint) v FROM lv",
    "i1": _pass("dq", "x", True),
    "i2": _pass("i1", "y", True),
    "i3": _pass("i2", "z", True),
}


def _chain(last: str, text: str) -> str:
    names = list(_CHAIN)
    return sql("+ " + ", ".join(f"{n} AS ({_CHAIN[n]})" for n in names[: names.index(last) + 1]) + " " + text, "vb")


def _coefficients(spark: SparkSession, d: str) -> DataFrame:
    values = fixtures.blocks(spark, d).withColumn("v", (F.col("v") - 128).cast("long"))
    return transform.forward(spark, values, 16, SPREAD_KEYS)


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return transform.quantize(spark, _coefficients(spark, d), 16, Q)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    v = fixtures.dense(spark, d)
    return metrics.paired(v, fixtures.reconstruction(v))


_PAIRS = "+ p AS (SELECT z, y, x, vd.v a, vr.v b, abs(vd.v - vr.v) err FROM vd JOIN vr USING (z, y, x)) "
_HALF = "z // 2 z, y // 2 y, x // 2 x"
_NZ = "CASE WHEN count(*) FILTER (WHERE v <> 0) = 0 THEN 0 ELSE cast((sum(v) + count(*) FILTER (WHERE v <> 0) // 2) // count(*) FILTER (WHERE v <> 0) AS int) END"

# addressing


@query(sql("SELECT z, y, x, z // 32 az, y // 32 ay, x // 32 ax, ((z // 32) % 32 * 32 + (y // 32) % 32) * 32 + (x // 32) % 32 slot, (cast(2 AS bigint) << 45) | (cast(z // 32 AS bigint) << 30) | (cast(y // 32 AS bigint) << 15) | cast(x // 32 AS bigint) AS packed, (x >> 4) & 15 nibble FROM vs", "vs"))
def atom_addressing(spark, d):
    v = fixtures.sparse(spark, d).withColumns({"az": A.atom("z"), "ay": A.atom("y"), "ax": A.atom("x")})
    return v.select("z", "y", "x", "az", "ay", "ax", A.slot("az", "ay", "ax").alias("slot"), A.packed_key(F.lit(2), "az", "ay", "ax").alias("packed"), A.nibble("x", 1).alias("nibble"))


@query("""WITH RECURSIVE l AS (SELECT 0 lod, cast(max(p_partkey) + 1 AS int) nx, (SELECT cast(max(s_suppkey) * 16 + 1 AS int) FROM supplier) ny, 64 nz FROM part
UNION ALL SELECT lod + 1, (nx + 1) // 2, (ny + 1) // 2, (nz + 1) // 2 FROM l WHERE lod < 7 AND greatest(nx, ny, nz) > 1),
g AS (SELECT lod, nx, ny, nz, ((nx + 31) // 32 + 31) // 32 rx, ((ny + 31) // 32 + 31) // 32 ry, ((nz + 31) // 32 + 31) // 32 rz FROM l)
SELECT *, cast(coalesce(sum(rx * ry * rz) OVER (ORDER BY lod ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS first_region FROM g""")
def lod_dims_grid(spark, d):
    nx = spark.read.parquet(f"{d}/part.parquet").agg(F.max("p_partkey")).first()[0] + 1
    ny = spark.read.parquet(f"{d}/supplier.parquet").agg(F.max("s_suppkey")).first()[0] * 16 + 1
    dims, rows, first = Extent(nx, ny, 64), [], 0
    for k in range(dims.n_lods):
        at = dims.lod(k)
        rz, ry, rx = at.regions()
        rows.append((k, at.nx, at.ny, at.nz, rx, ry, rz, first))
        first += rx * ry * rz
    return spark.createDataFrame(rows, "lod int, nx int, ny int, nz int, rx int, ry int, rz int, first_region long")


# occupancy


@query(sql("SELECT z // 32 az, y // 32 ay, x // 32 ax, count(*) n, cast(sum(v) AS bigint) total, count(*) FILTER (WHERE v <> 0) nonzero, max(v) = 0 all_zero FROM vs GROUP BY ALL", "vs"))
def atom_occupancy(spark, d):
    return occupancy.atom_stats(fixtures.sparse(spark, d))


@query(sql("SELECT z // 256 cz, y // 256 cy, x // 256 cx, count(*) n FROM vs WHERE v <> 0 GROUP BY ALL", "vs"))
def chunk_presence(spark, d):
    return occupancy.occupied(fixtures.sparse(spark, d), 256)


@query(sql("+ c AS (SELECT {h}, {nz} v FROM vs GROUP BY ALL) SELECT DISTINCT z // 64 cz, y // 64 cy, x // 64 cx FROM c WHERE v <> 0".format(h=_HALF, nz=_NZ), "vs"))
def occupancy_from_coarse(spark, d):
    return occupancy.from_coarse(pyramid.nonzero_mean(fixtures.sparse(spark, d)), 64)


@query(sql("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_orderkey % 64 // 128, (l_suppkey * 16) // 128, l_partkey // 128) IN (SELECT (z // 128, y // 128, x // 128) FROM vs WHERE v <> 0)", "vs"))
def occupied_chunks_semi(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.expr("cast(l_orderkey % 64 div 128 AS int)").alias("cz"), F.expr("cast((l_suppkey * 16) div 128 AS int)").alias("cy"), F.expr("cast(l_partkey div 128 AS int)").alias("cx"))
    return occupancy.only_occupied(rows, occupancy.occupied(fixtures.sparse(spark, d), 128)).select("l_orderkey", "l_linenumber")


@query(sql("+ c AS (SELECT DISTINCT y // 96 cy, x // 96 cx FROM vs WHERE v <> 0), m AS (SELECT max(y) // 64 my, max(x) // 64 mx FROM vs), g AS (SELECT a.i ry, b.i rx FROM range(0, (SELECT my + 1 FROM m)) a(i), range(0, (SELECT mx + 1 FROM m)) b(i)), t AS (SELECT DISTINCT r.i ry, q.i rx FROM c, range(0, (SELECT my + 2 FROM m)) r(i), range(0, (SELECT mx + 2 FROM m)) q(i) WHERE r.i BETWEEN cy * 96 // 64 AND (cy * 96 + 95) // 64 AND q.i BETWEEN cx * 96 // 64 AND (cx * 96 + 95) // 64) SELECT cast(0 AS int) rz, cast(ry AS int) ry, cast(rx AS int) rx FROM g WHERE (ry, rx) NOT IN (SELECT (ry, rx) FROM t)", "vs"))
def zero_region_prepass(spark, d):
    last = fixtures.entries(spark, d).agg(F.max("y"), F.max("x")).first()
    ny, nx = (0 if m is None else m // 64 + 1 for m in last)
    # One region deep: voxels count at whatever z.
    chunks = occupancy.occupied(fixtures.sparse(spark, d).withColumn("z", F.lit(0)), 96)
    return occupancy.definite_zero_regions((1, ny, nx), chunks, 96, 64)


# coverage

_EV = """+ a AS (SELECT az, ay, ax, max(CASE WHEN kind = 'atom' THEN 2 ELSE 1 END) cover, min(CASE WHEN kind = 'atom' THEN ingest_id END) payload_id FROM ev WHERE kind IN ('atom', 'zero_atom') GROUP BY ALL),
zr AS (SELECT DISTINCT az // 32 rz, ay // 32 ry, ax // 32 rx FROM ev WHERE kind = 'zero_region'),
gr AS (SELECT * FROM (SELECT DISTINCT az FROM ev), (SELECT DISTINCT ay FROM ev), (SELECT DISTINCT ax FROM ev)),
cv AS (SELECT az, ay, ax, CASE WHEN a.cover IS NOT NULL THEN a.cover WHEN zr.rz IS NOT NULL THEN 1 ELSE 0 END cover FROM gr LEFT JOIN a USING (az, ay, ax) LEFT JOIN zr ON zr.rz = az // 32 AND zr.ry = ay // 32 AND zr.rx = ax // 32) """


def _grid(log: DataFrame) -> DataFrame:
    """The addresses that the log's axes span: sequences of at most 16, 32 and 16 values."""
    axes = log.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in coverage.ATOM_KEY])
    for c in coverage.ATOM_KEY:
        axes = axes.withColumn(c, F.explode(c))
    return axes


def _covers(spark, d):
    log = fixtures.append_log(spark, d)
    return coverage.resolve(_grid(log), *coverage.merge(log))


@query(sql(_EV + "SELECT az, ay, ax, cover FROM cv", "ev"))
def coverage_resolve(spark, d):
    return _covers(spark, d)


@query(sql(_EV + "SELECT az, ay, ax, cover, coalesce(payload_id, -1) payload_id FROM a", "ev"))
def coverage_merge(spark, d):
    return coverage.merge(fixtures.append_log(spark, d))[0].withColumn("payload_id", F.coalesce("payload_id", F.lit(-1)))


@query(sql(_EV + "SELECT count(*) FILTER (WHERE cover = 2) present, count(*) FILTER (WHERE cover = 1) zero, count(*) FILTER (WHERE cover = 0) absent FROM cv", "ev"))
def coverage_counts(spark, d):
    return repack.counts(_covers(spark, d))


@query(sql(_EV + "SELECT az, ay, ax FROM cv WHERE cover = 0", "ev"))
def absent_atoms(spark, d):
    log = fixtures.append_log(spark, d)
    return coverage.absent(_grid(log), *coverage.merge(log))


@query(sql(_EV + "SELECT rz, ry, rx FROM zr WHERE NOT EXISTS (SELECT 1 FROM a WHERE cover = 2 AND az // 32 = rz AND ay // 32 = ry AND ax // 32 = rx)", "ev"))
def zero_region_marks(spark, d):
    atoms, zero = coverage.merge(fixtures.append_log(spark, d))
    return coverage.mark_zero_regions(zero, atoms)


@query(sql("SELECT z, y, x, v FROM vd WHERE z >= 2 AND z < 7 AND y >= 10 AND y < 41 AND x >= 5 AND x < 64", "vd"))
def box_read(spark, d):
    return coverage.crop(fixtures.dense(spark, d), Box(5, 10, 2, 64, 41, 7))


@query(sql("+ g AS (SELECT cast(a.i AS int) z, cast(b.i * 16 AS int) y, cast(c.i AS int) x FROM range(0, 8) a(i), range(0, 20) b(i), range(0, 100) c(i)) SELECT z, y, x, coalesce(v, 0) v FROM g LEFT JOIN vs USING (z, y, x)", "vs"))
def box_read_absent_zero(spark, d):
    grid = spark.range(8 * 20 * 100).select(F.expr("cast(id div 2000 AS int)").alias("z"), F.expr("cast(id div 100 % 20 * 16 AS int)").alias("y"), F.expr("cast(id % 100 AS int)").alias("x"))
    return coverage.read_box(grid, coverage.crop(fixtures.sparse(spark, d), Box(0, 0, 0, 100, 320, 8)))


# pyramid

_TWICE = "CASE WHEN {c} = m{c} AND m{c} % 2 = 0 THEN 2 ELSE 1 END"
_ODD = "+ m AS (SELECT max(z) mz, max(y) my, max(x) mx FROM vd), w AS (SELECT vd.*, " + " * ".join(_TWICE.format(c=c) for c in "zyx") + " w FROM vd, m) "


@query(sql(_ODD + f"SELECT {_HALF}, cast(floor(sum(v * w) / 8.0 + 0.5) AS int) v FROM w GROUP BY ALL", "vd"))
def downscale_box(spark, d):
    v = fixtures.dense(spark, d)
    return pyramid.box(v, _dims(v))


@query(sql(_ODD + f", h AS (SELECT {_HALF}, sum(v * w) s FROM w GROUP BY ALL), b AS (SELECT h.z, h.y, h.x, h.s, w.v, row_number() OVER (PARTITION BY h.z, h.y, h.x ORDER BY abs(w.v - h.s / cast(8 AS double)) DESC, w.z, w.y, w.x) r FROM h JOIN w ON w.z // 2 = h.z AND w.y // 2 = h.y AND w.x // 2 = h.x) SELECT z, y, x, CASE WHEN s = 0 THEN 0 ELSE cast(least(255, greatest(0, floor(s / cast(8 AS double) + 0.5 * (v - s / cast(8 AS double)) + 0.5))) AS int) END v FROM b WHERE r = 1", "vd"))
def downscale_cbox(spark, d):
    v = fixtures.dense(spark, d)
    return pyramid.cbox(v, _dims(v))


@query(sql(f"SELECT {_HALF}, cast((sum(v) + count(*) // 2) // count(*) AS int) v FROM vd GROUP BY ALL", "vd"))
def downscale_mean_round(spark, d):
    return pyramid.mean_round(fixtures.dense(spark, d))


@query(sql(f"SELECT {_HALF}, {_NZ} v FROM vd GROUP BY ALL", "vd"))
def decimate_nonzero(spark, d):
    return pyramid.nonzero_mean(fixtures.dense(spark, d))


def _level_sql(n: int) -> str:
    size = "(SELECT greatest(max(z), max(y), max(x)) FROM vd)"
    parts = [f"l{k} AS (SELECT {_HALF}, {_NZ} v FROM {'vd' if k == 1 else f'l{k - 1}'} WHERE {size} >= {1 << (k - 1)} GROUP BY ALL)" for k in range(1, n)]
    return "+ " + ", ".join(parts) + " SELECT z, y, x, v, 0 lod FROM vd" + "".join(f" UNION ALL SELECT z, y, x, v, {k} FROM l{k}" for k in range(1, n))


@query(sql(_level_sql(MOST_LODS), "vd"))
def pyramid_all_lods(spark, d):
    v = fixtures.dense(spark, d)
    return pyramid.levels(v, lambda v, _: pyramid.nonzero_mean(v), _dims(v).n_lods)


@query(sql(" UNION ALL ".join(f"(SELECT {_HALF}, {k} vote, {t} air FROM vd GROUP BY ALL)" for k, t in enumerate(("count(*) FILTER (WHERE v = 0) = count(*)", "count(*) FILTER (WHERE v = 0) * 2 > count(*)", "count(*) FILTER (WHERE v = 0) > 0"))), "vd"))
def mask_decimate_vote(spark, d):
    v, out = fixtures.dense(spark, d), None
    for k in range(3):
        one = pyramid.mask_vote(v, k).withColumn("vote", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


@query(sql(f"+ c AS (SELECT {_HALF}, {_NZ} v FROM vd GROUP BY ALL) SELECT f.z, f.y, f.x, f.v - c.v r FROM vd f JOIN c ON f.z // 2 = c.z AND f.y // 2 = c.y AND f.x // 2 = c.x", "vd"))
def residual_from_parent(spark, d):
    v = fixtures.dense(spark, d)
    return pyramid.residual(v, pyramid.nonzero_mean(v))


# blocks and masks


@query(sql("SELECT block, cast((sum(v) + 2048) // 4096 AS int) dc FROM vb GROUP BY ALL", "vb"))
def atom_dc(spark, d):
    return analytics.atom_dc(fixtures.blocks(spark, d), ["block"], 4096)


@query(sql(f"SELECT block, {_NZ} dc FROM vb GROUP BY ALL", "vb"))
def material_dc(spark, d):
    return analytics.material_dc(fixtures.blocks(spark, d), ["block"])


@query(sql("SELECT z // 8 bz, y // 8 AS by, x // 8 bx, count(*) FILTER (WHERE v <> 0) nonzero, round(coalesce(var_pop(v) FILTER (WHERE v <> 0), 0), 6) variance FROM vd GROUP BY ALL", "vd"))
def block_stats(spark, d):
    return analytics.block_stats(fixtures.dense(spark, d), 8)


@query(sql("SELECT z // 2 bz, y // 2 AS by, x // 2 bx, CASE WHEN max(v) = 0 THEN 1 WHEN min(v) > 0 THEN 2 ELSE 0 END kind FROM vd GROUP BY ALL", "vd"))
def cube_uniformity(spark, d):
    return analytics.uniformity(fixtures.dense(spark, d), 2)


def _octree_sql() -> str:
    same = "min(kind) = max(kind) AND min(kind) > 0"
    parts = ["o0 AS (SELECT z, y, x, CASE WHEN v = 0 THEN 1 ELSE 2 END kind, cast(1 AS bigint) bits FROM vd)"]
    parts += [f"o{k} AS (SELECT {_HALF}, CASE WHEN {same} THEN min(kind) ELSE 0 END kind, cast(CASE WHEN {same} THEN 1 ELSE 1 + sum(bits) END AS bigint) bits FROM o{k - 1} GROUP BY ALL)" for k in range(1, 4)]
    return "+ " + ", ".join(parts) + " SELECT * FROM o3"


@query(sql(_octree_sql(), "vd"))
def octree_mask_cost(spark, d):
    return analytics.octree_mask_cost(fixtures.dense(spark, d), 8)


_D = "(VALUES (0,0,0),(1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1)) d(a,b,c)"
_GROW = "SELECT DISTINCT p.block, p.z + a z, p.y + b y, p.x + c x FROM {p} p, " + _D + " WHERE p.z + a BETWEEN 0 AND 15 AND p.y + b BETWEEN 0 AND 15 AND p.x + c BETWEEN 0 AND 15"


@query(sql("+ air AS (SELECT block, z, y, x FROM vb WHERE v = 0) " + _GROW.format(p="air"), "vb"))
def mask_dilate(spark, d):
    v = fixtures.blocks(spark, d)
    return analytics.dilate(v.filter("v = 0"), v)


@query(sql(f"+ air AS (SELECT block, z, y, x FROM vb WHERE v = 0), g AS ({_GROW.format(p='air')}), r AS (SELECT block, z, y, x FROM vb EXCEPT SELECT * FROM g), e AS ({_GROW.format(p='r')}) SELECT * FROM g EXCEPT SELECT * FROM e", "vb"))
def mask_close(spark, d):
    v = fixtures.blocks(spark, d)
    return analytics.close(v.filter("v = 0"), v)


@query(sql("+ a AS (SELECT *, CASE WHEN v = 0 THEN 1 ELSE 0 END air FROM vb), c AS (SELECT air, lag(air, 1, 0) OVER (PARTITION BY block, y, x ORDER BY z) * 4 + lag(air, 1, 0) OVER (PARTITION BY block, z, x ORDER BY y) * 2 + lag(air, 1, 0) OVER (PARTITION BY block, z, y ORDER BY x) ctx FROM a) SELECT ctx, count(*) n, cast(sum(air) AS bigint) air FROM c GROUP BY ALL", "vb"))
def mask_context_hist(spark, d):
    return analytics.mask_contexts(fixtures.blocks(spark, d))


@query(sql(f"+ dc AS (SELECT block, {_NZ} dc FROM vb GROUP BY ALL), s AS (SELECT vb.*, CASE WHEN v = 0 THEN dc ELSE v END f FROM vb JOIN dc USING (block)), m AS (SELECT n.block, n.z + a z, n.y + b y, n.x + c x, cast(floor(sum(f) / cast(count(*) AS double) + 0.5) AS int) m FROM s n, {_D} WHERE abs(a) + abs(b) + abs(c) = 1 GROUP BY ALL) SELECT vb.block, vb.z, vb.y, vb.x, CASE WHEN v = 0 THEN m ELSE v END v FROM vb LEFT JOIN m USING (block, z, y, x)", "vb"))
def jacobi_fill_1(spark, d):
    return analytics.fill_once(fixtures.blocks(spark, d))


# transform


@query("WITH s AS (SELECT i AS idx, i // 256 + i // 16 % 16 + i % 16 f FROM range(0, 4096) t(i)) SELECT cast(row_number() OVER (ORDER BY f, idx) - 1 AS int) p, cast(idx AS int) idx FROM s")
def scan_order(spark, d):
    return spark.createDataFrame(transform.scan_order(16), "p int, idx int")


@query(sql("+ dct AS (" + _DCT + "), s AS (SELECT z, y, x, v - 128 v FROM vd), m AS (SELECT z, y, x // 16 g, x % 16 i, v FROM s) SELECT z, y, g, k x, cast((sum(cast(c AS bigint) * v) + 8192) >> 14 AS bigint) v FROM m JOIN dct USING (i) GROUP BY ALL", "vd"))
def dct_line_forward(spark, d):
    v = fixtures.dense(spark, d).select("z", "y", A.div("x", 16).alias("g"), A.local("x", 16).alias("x"), (F.col("v") - 128).alias("v"))
    return transform.lines(v, transform.small_table(spark, transform.dct_matrix(16), "k int, i int, c int"), ["z", "y", "g", "x"], "x")


@query(_chain("cf", "SELECT block, z, y, x, v FROM cf"))
def dct3_forward_16(spark, d):
    return _coefficients(spark, d).select(*BLOCK_KEYS, "v")


@query(_chain("i3", "SELECT block, z, y, x, cast(greatest(0, least(255, v + 128)) AS int) v FROM i3"))
def dct3_inverse_16(spark, d):
    values = transform.dequantize(_levels(spark, d)).select(*SPREAD_KEYS, "v")
    return transform.inverse(spark, values, 16, SPREAD_KEYS).select(*BLOCK_KEYS, A.clamp_u8(F.col("v") + 128).cast("int").alias("v"))


@query(_chain("lv", "SELECT block, z, y, x, level FROM lv"))
def quantize_levels(spark, d):
    return _levels(spark, d).select(*BLOCK_KEYS, "level")


@query(_chain("lv", "SELECT block, z, y, x, cast(sign(level) * ((abs(level) * cast(round_even(256 * (sq / 1048576.0), 0) AS bigint) + cast(round_even(cast(51.2 AS double) * (sq / 1048576.0), 0) AS bigint) + 128) >> 8) AS bigint) v FROM lv"))
def dequantize_q8(spark, d):
    return transform.dequantize_q8(_levels(spark, d)).select(*BLOCK_KEYS, F.when(F.col("level") == 0, F.lit(0).cast("long")).otherwise(F.col("v")).alias("v"))


@query(_chain("lv", ", sc AS (SELECT i AS idx, row_number() OVER (ORDER BY i // 256 + i // 16 % 16 + i % 16, i) p FROM range(0, 4096) t(i)) SELECT block, cast(max(CASE WHEN level <> 0 THEN p ELSE 0 END) AS int) eob FROM lv JOIN sc ON idx = (z * 16 + y) * 16 + x GROUP BY ALL"))
def eob_per_block(spark, d):
    return transform.end_of_block(spark, _levels(spark, d), 16, ["block"])


@query(_chain("lv", ", s AS (SELECT least(7, f * 8 // 46) band, count(*) n, count(*) FILTER (WHERE level <> 0) nonzero, count(*) FILTER (WHERE level < 0) negative, max(least(abs(level), 15)) top FROM lv GROUP BY ALL), p AS (SELECT *, nonzero / cast(n AS double) p FROM s) SELECT cast(band AS int) band, n, nonzero, negative, top, round(CASE WHEN p = 0 OR p = 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) * n END, 6) bits FROM p"))
def coef_band_stats(spark, d):
    return analytics.band_stats(_levels(spark, d))


@query(_chain("lv", ", s AS (SELECT least(7, f * 8 // 46) band, least(abs(level), 15) magnitude, count(*) n FROM lv GROUP BY ALL) SELECT cast(band AS int) band, cast(magnitude AS int) magnitude, n FROM s"))
def coef_magnitudes(spark, d):
    return analytics.magnitudes(_levels(spark, d))


@query(_chain("lv", ", h AS (SELECT least(7, f * 8 // 46) band, least(abs(level), 15) a, count(*) c FROM lv GROUP BY ALL), s AS (SELECT band, sum(c) n, sum(CASE WHEN a > 0 THEN c ELSE 0 END) nz FROM h GROUP BY ALL), e AS (SELECT band, sum(CASE WHEN a > 0 THEN -(c / cast(nz AS double)) * log2(c / cast(nz AS double)) ELSE 0 END) he FROM h JOIN s USING (band) GROUP BY ALL) SELECT cast(band AS int) band, round(CASE WHEN nz = 0 OR nz = n THEN 0 ELSE -(nz / cast(n AS double) * log2(nz / cast(n AS double)) + (1 - nz / cast(n AS double)) * log2(1 - nz / cast(n AS double))) * n END, 6) significance_bits, round((he + 1) * nz, 6) magnitude_bits FROM s JOIN e USING (band)"))
def coef_entropy(spark, d):
    return analytics.band_entropy(analytics.magnitudes(_levels(spark, d)))


@query(_chain("lv", ", s AS (SELECT block, count(*) n, count(*) FILTER (WHERE level <> 0) nz, cast(sum(CASE WHEN level <> 0 THEN 2 * floor(log2(cast(abs(level) AS double))) + 1 ELSE 0 END) AS double) m FROM lv GROUP BY ALL), p AS (SELECT *, nz / cast(n AS double) p FROM s), t AS (SELECT sum(round(CASE WHEN p = 0 OR p = 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END * n + m + nz + log2(n + cast(1 AS double)), 6)) bits FROM p), w AS (SELECT count(*) FILTER (WHERE v <> 0) material FROM vb) SELECT material, round(material * 8 / bits, 6) ratio FROM w, t"))
def material_ratio(spark, d):
    bits = analytics.bit_estimate(_levels(spark, d), ["block"]).select((F.col("bits") / 8).alias("len"))
    return analytics.material_ratio(fixtures.blocks(spark, d), bits)


@query(_chain("cf", "SELECT z + y + x f, round(sqrt(cast(sum(v * v) AS double) / count(*)), 6) rms FROM cf GROUP BY ALL"))
def dct_power_spectrum(spark, d):
    return analytics.power_spectrum(transform.with_frequency(_coefficients(spark, d)))


@query(_chain("lv", ", s AS (SELECT block, count(*) n, count(*) FILTER (WHERE level <> 0) nz, cast(sum(CASE WHEN level <> 0 THEN 2 * floor(log2(cast(abs(level) AS double))) + 1 ELSE 0 END) AS double) m FROM lv GROUP BY ALL), p AS (SELECT *, nz / cast(n AS double) p FROM s) SELECT block, round(CASE WHEN p = 0 OR p = 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END * n + m + nz + log2(n + cast(1 AS double)), 6) bits FROM p"))
def bit_estimate(spark, d):
    return analytics.bit_estimate(_levels(spark, d), ["block"])


@query(_chain("cf", "SELECT block, z, y, x, cast(CASE WHEN z + y + x = 0 THEN v ELSE greatest(abs(v) - 25, 0) * sign(v) END AS bigint) v FROM cf"))
def denoise_threshold(spark, d):
    return analytics.denoise(_coefficients(spark, d), 25).select(*BLOCK_KEYS, "v")


# quality


@query(sql(_PAIRS + ", s AS (SELECT count(*) n, cast(sum(err * err) AS bigint) sse, cast(sum(err) AS bigint) sae, max(err) max_err FROM p WHERE a > 0) SELECT n, sse, sae, max_err, round(CASE WHEN sse = 0 THEN 99.0 ELSE 10 * log10(65025.0 / (sse / cast(n AS double))) END, 6) psnr, round(sqrt(sse / cast(n AS double)), 6) rmse, round(sae / cast(n AS double), 6) mae FROM s", "vr"))
def quality_basket(spark, d):
    return metrics.basket(_pairs(spark, d).filter("a > 0"))


@query(sql(_PAIRS + "SELECT err, count(*) n FROM p GROUP BY ALL", "vr"))
def error_histogram(spark, d):
    return metrics.error_histogram(_pairs(spark, d))


@query(sql(_PAIRS + ", o AS (SELECT err, row_number() OVER (ORDER BY err) - 1 i, count(*) OVER () m FROM p) SELECT cast(s.p AS double) p, err FROM o, (VALUES (0.5), (0.9), (0.95), (0.99)) s(p) WHERE i = floor(cast(s.p AS double) * (m - 1))", "vr"))
def error_percentiles(spark, d):
    return metrics.error_percentiles(_pairs(spark, d))


@query(sql(_PAIRS + ", w AS (SELECT count(*) n, avg(a) ma, avg(b) mb, var_samp(a) va, var_samp(b) vb, covar_samp(a, b) cab FROM p GROUP BY z // 8, y // 8, x // 8) SELECT count(*) windows, round(avg((2 * ma * mb + cast(6.5025 AS double)) * (2 * cab + cast(58.5225 AS double)) / ((ma * ma + mb * mb + cast(6.5025 AS double)) * (va + vb + cast(58.5225 AS double)))), 6) ssim FROM w WHERE n = 512", "vr"))
def ssim_windows(spark, d):
    return metrics.ssim(_pairs(spark, d))


@query(sql(_PAIRS + "SELECT count(*) FILTER (WHERE a = 0 AND b <> 0) leaks, count(*) FILTER (WHERE a <> 0 AND b = 0) losses FROM p", "vr"))
def mask_fidelity(spark, d):
    return metrics.mask_fidelity(_pairs(spark, d))


@query(sql(_PAIRS + "SELECT z, y, x, a - b AS add FROM p WHERE err > 3", "vr"))
def outlier_corrections(spark, d):
    return analytics.corrections(_pairs(spark, d), 3)


@query(sql(f"+ a AS (SELECT {_HALF}, {_NZ} v FROM vd GROUP BY ALL), b AS (SELECT {_HALF}, cast((sum(v) + count(*) // 2) // count(*) AS int) v FROM vd GROUP BY ALL) SELECT z, y, x, a.v a, b.v b FROM a FULL JOIN b USING (z, y, x) WHERE a.v IS DISTINCT FROM b.v", "vd"))
def parity_two_paths(spark, d):
    v = fixtures.dense(spark, d)
    return metrics.differing(pyramid.nonzero_mean(v), pyramid.mean_round(v))


@query(sql(_PAIRS + ", w AS (SELECT p.*, s.scope, m.masked, CASE WHEN m.masked AND a = 0 THEN 0 ELSE b END c FROM p, (VALUES ('signal'), ('all')) s(scope), (VALUES (false), (true)) m(masked) WHERE s.scope = 'all' OR a > 0), t AS (SELECT scope, masked, count(*) n, cast(sum((a - c) * (a - c)) AS bigint) sse, max(abs(a - c)) max_err FROM w GROUP BY ALL) SELECT *, round(CASE WHEN sse = 0 THEN 99.0 ELSE 10 * log10(65025.0 / (sse / cast(n AS double))) END, 6) psnr FROM t", "vr"))
def volume_report(spark, d):
    return metrics.report(_pairs(spark, d))


@query(sql("+ p AS (SELECT z, y, x, vr.v + CASE WHEN abs(vd.v - vr.v) > 3 THEN vd.v - vr.v ELSE 0 END v FROM vd JOIN vr USING (z, y, x)) SELECT z, y, x, cast(v AS int) v FROM p", "vr"))
def outlier_applied(spark, d):
    v = fixtures.dense(spark, d)
    rec = fixtures.reconstruction(v)
    return analytics.corrected(rec, analytics.corrections(metrics.paired(v, rec), 3))


def _deblock_sql(step: int, strength: float, limit: int) -> str:
    parts, source = [], "vr"
    for c in "xyz":
        keys = ", ".join(k for k in "zyx" if k != c)
        near = f"{{}}(v) OVER (PARTITION BY {keys} ORDER BY {c})"
        move = f"cast(trunc(cast({strength / 2} AS double) * (%s)) AS int)"
        first = f"{c} % {step} = 0 AND {c} > 0 AND v <> 0 AND p <> 0 AND abs(v - p) < {limit}"
        last = f"{c} % {step} = {step - 1} AND n IS NOT NULL AND v <> 0 AND n <> 0 AND abs(n - v) < {limit}"
        to = " ".join([f"CASE WHEN {first} THEN greatest(0, least(255, v - {move % 'v - p'}))", f"WHEN {last} THEN greatest(0, least(255, v + {move % 'n - v'})) ELSE v END"])
        parts += [f"n{c} AS (SELECT *, {near.format('lag')} p, {near.format('lead')} n FROM {source})", f"d{c} AS (SELECT z, y, x, {to} v FROM n{c})"]
        source = f"d{c}"
    return "+ " + ", ".join(parts) + " SELECT z, y, x, cast(v AS int) v FROM dz"


@query(sql(_deblock_sql(8, 0.5, 16), "vr"))
def deblock_seams(spark, d):
    return pyramid.deblock(fixtures.reconstruction(fixtures.dense(spark, d)), 8, 0.5, 16)


@query(sql(f"+ c AS (SELECT {_HALF}, {_NZ} v FROM vd GROUP BY ALL), r AS (SELECT f.v, f.v - c.v r FROM vd f JOIN c ON f.z // 2 = c.z AND f.y // 2 = c.y AND f.x // 2 = c.x), k AS (SELECT 'own' kind, v, count(*) c FROM r GROUP BY ALL UNION ALL SELECT 'residual', r, count(*) FROM r GROUP BY ALL), t AS (SELECT kind, sum(c) n FROM k GROUP BY ALL) SELECT kind, cast(n AS bigint) n, round(sum(-(c / cast(n AS double)) * log2(c / cast(n AS double))) * n / 8, 4) bytes FROM k JOIN t USING (kind) GROUP BY kind, n", "vd"))
def residual_sizing(spark, d):
    v = fixtures.dense(spark, d)
    return analytics.sizes(v, pyramid.residual(v, pyramid.nonzero_mean(v)))


# layout

_ATOMS = "+ t AS (SELECT z // 32 az, y // 32 ay, x // 32 ax, CASE WHEN max(v) > 100 THEN 2 ELSE 1 END cover, cast(sum(v) AS bigint) len FROM vs GROUP BY ALL) "


def _atoms(spark, d):
    v = fixtures.sparse(spark, d)
    return v.groupBy(*occupancy.keys(32, ("az", "ay", "ax"))).agg(F.when(F.max("v") > 100, 2).otherwise(1).alias("cover"), F.sum("v").cast("long").alias("len"))


@query(sql(_ATOMS + "SELECT az // 32 rz, ay // 32 ry, ax // 32 rx, max(cover) flag, count(*) FILTER (WHERE cover = 2) present, cast(sum(CASE WHEN cover = 2 THEN len ELSE 0 END) AS bigint) bytes FROM t GROUP BY ALL", "vs"))
def region_classify(spark, d):
    return repack.regions_of(_atoms(spark, d))


@query(sql(_ATOMS + ", r AS (SELECT az // 32 rz, ay // 32 ry, ax // 32 rx, cast(sum(len) AS bigint) bytes FROM t WHERE cover = 2 GROUP BY ALL) SELECT *, cast(4096 + coalesce(sum(bytes) OVER (ORDER BY rz, ry, rx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS \"offset\" FROM r", "vs"))
def repack_offsets(spark, d):
    return repack.blob_offsets(repack.regions_of(_atoms(spark, d)))


@query(sql(_ATOMS + ", s AS (SELECT az, ay, ax, ((az % 32) * 32 + ay % 32) * 32 + ax % 32 slot, len FROM t WHERE cover = 2) SELECT *, cast(coalesce(sum(len) OVER (PARTITION BY az // 32, ay // 32, ax // 32 ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS at FROM s", "vs"))
def payload_offsets(spark, d):
    return repack.payload_offsets(_atoms(spark, d))


_PLACE = "((az * (SELECT max(ay) + 1 FROM t) + ay) * (SELECT max(ax) + 1 FROM t) + ax)"


@query(sql(_ATOMS + f"SELECT az, ay, ax, cover, len FROM t WHERE {_PLACE} % 7 = 0", "vs"))
def sampled_verify(spark, d):
    return repack.sampled(_atoms(spark, d), _dims(fixtures.sparse(spark, d)).atoms(), 7)


@query(sql(_PAIRS + ", t AS (SELECT z // 32 az, y // 32 ay, x // 32 ax, sum((a - b) * (a - b)) sse, count(*) n, max(a) > 0 present FROM p GROUP BY ALL), k AS (SELECT * FROM t WHERE " + _PLACE + " % 3 = 0 AND present ORDER BY az, ay, ax LIMIT 5) SELECT count(*) atoms, cast(sum(n) AS bigint) n, round(CASE WHEN sum(sse) = 0 THEN 99.0 ELSE 10 * log10(65025.0 / (sum(sse) / cast(sum(n) AS double))) END, 6) psnr FROM k", "vr"))
def verify_archive(spark, d):
    v = fixtures.dense(spark, d)
    dims = _dims(v).atoms()
    covers = occupancy.atom_stats(v).select("az", "ay", "ax", F.when(F.col("all_zero"), 1).otherwise(2).alias("cover"))
    return metrics.verified(repack.sampled(covers, dims, 3, most=5), metrics.paired(v, fixtures.reconstruction(v)))


@query(sql(_ATOMS + ", s AS (SELECT az, ay, ax, ((az % 32) * 32 + ay % 32) * 32 + ax % 32 slot, len FROM t WHERE cover = 2), o AS (SELECT *, cast(coalesce(sum(len) OVER (PARTITION BY az // 32, ay // 32, ax // 32 ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS inside FROM s), b AS (SELECT az // 32 rz, ay // 32 ry, ax // 32 rx, sum(len) bytes FROM s GROUP BY ALL), f AS (SELECT *, cast(4096 + coalesce(sum(bytes) OVER (ORDER BY rz, ry, rx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) base FROM b) SELECT az, ay, ax, len, cast(base + inside AS bigint) AS \"offset\" FROM o JOIN f ON rz = az // 32 AND ry = ay // 32 AND rx = ax // 32 WHERE (az + ay + ax) % 2 = 0", "vs"))
def atom_lookup(spark, d):
    atoms = _atoms(spark, d)
    return repack.located(atoms.filter("(az + ay + ax) % 2 = 0"), atoms)


@query(sql("+ r AS (SELECT z // 64 cz, y // 64 cy, x // 64 cx, z // 4 band FROM vd) SELECT count(*) AS reads, cast((SELECT count(*) FROM (SELECT DISTINCT * FROM r)) AS bigint) AS once FROM r", "vd"))
def io_read_once(spark, d):
    r = fixtures.dense(spark, d).select(*occupancy.keys(64, ("cz", "cy", "cx")), A.div("z", 4).alias("band"))
    return r.groupBy("cz", "cy", "cx", "band").agg(F.count("*").alias("n")).agg(F.sum("n").alias("reads"), F.count("*").alias("once"))


# trees, ratios and lab analytics


@query(sql("+ c AS (SELECT DISTINCT y // 16 // 16 sy, x // 16 // 16 sx, z // 16 // 16 sz, ((z // 16) % 16 * 16 + (y // 16) % 16) * 16 + (x // 16) % 16 child FROM vs WHERE v <> 0) SELECT sz, sy, sx, child, row_number() OVER (PARTITION BY sz, sy, sx ORDER BY child) - 1 AS rank FROM c", "vs"))
def sparse_tree_ranks(spark, d):
    return repack.tree_nodes(occupancy.occupied(fixtures.sparse(spark, d), 16))


@query(sql("+ c AS (SELECT DISTINCT y // 16 // 16 sy, x // 16 // 16 sx, z // 16 // 16 sz, ((z // 16) % 16 * 16 + (y // 16) % 16) * 16 + (x // 16) % 16 child FROM vs WHERE v <> 0) SELECT sz, sy, sx, child >> 6 AS word, count(*) n, cast(cast(sum(CASE WHEN child % 64 < 63 THEN cast(1 AS bigint) << (child % 64) ELSE 0 END) AS bigint) + min(CASE WHEN child % 64 = 63 THEN -9223372036854775808 ELSE 0 END) AS bigint) bits FROM c GROUP BY ALL", "vs"))
def sparse_tree_bitmaps(spark, d):
    return repack.node_bitmaps(repack.tree_nodes(occupancy.occupied(fixtures.sparse(spark, d), 16))).select("sz", "sy", "sx", "word", "n", "bits")


@query(sql(_ATOMS + "SELECT count(*) present, cast(sum(len) AS bigint) bytes, round(count(*) * 32768 / cast(sum(len) AS double), 6) ratio FROM t WHERE cover = 2", "vs"))
def payload_ratio(spark, d):
    return repack.payload_ratio(_atoms(spark, d))


@query(sql(_ATOMS + ", u AS (SELECT 0 lod, * FROM t UNION ALL SELECT DISTINCT 1, az // 2, ay // 2, ax // 2, 2, cast(1 AS bigint) FROM t) SELECT lod, az, ay, ax, row_number() OVER (ORDER BY lod DESC, az // 32, ay // 32, ax // 32, (az % 32 * 32 + ay % 32) * 32 + ax % 32) place FROM u", "vs"))
def layout_order(spark, d):
    fine = _atoms(spark, d).withColumn("lod", F.lit(0))
    coarse = fine.select(A.div("az", 2).alias("az"), A.div("ay", 2).alias("ay"), A.div("ax", 2).alias("ax"), F.lit(2).alias("cover"), F.lit(1).cast("long").alias("len"), F.lit(1).alias("lod")).distinct()
    return repack.places(fine.unionByName(coarse)).select("lod", "az", "ay", "ax", "place")


@query("WITH p AS (SELECT cast(floor(epoch(ts) / 3600) AS bigint) slot, count(*) n FROM events GROUP BY ALL) SELECT slot, n, cast(sum(n) OVER (ORDER BY slot) AS bigint) upto, n - lag(n) OVER (ORDER BY slot) AS change, round(sum(n) OVER (ORDER BY slot) / cast(slot - min(slot) OVER () + 1 AS double), 6) AS average, round((sum(n) OVER () - sum(n) OVER (ORDER BY slot)) / (sum(n) OVER (ORDER BY slot) / cast(slot - min(slot) OVER () + 1 AS double)), 6) AS eta FROM p QUALIFY change IS NOT NULL")
def ingest_throughput(spark, d):
    return repack.throughput(fixtures.append_log(spark, d), "ts", 3600).filter("change IS NOT NULL")


@query(_chain("cf", "SELECT block, z, y, x, v FROM cf WHERE z + y + x <= 20"))
def frequency_cut(spark, d):
    return analytics.drop_high(transform.with_frequency(_coefficients(spark, d)), 20).select(*BLOCK_KEYS, "v")


@query(_chain("cf", ", s AS (SELECT z + y + x f, round(sqrt(cast(sum(v * v) AS double) / count(*)), 6) rms FROM cf GROUP BY ALL) SELECT f, round(least(3.0, greatest(1.0, sqrt((SELECT max(rms) FROM s WHERE f > 0) / greatest(rms, cast(0.000001 AS double))))), 6) weight FROM s"))
def spectrum_quant_table(spark, d):
    return analytics.spectrum_weights(analytics.power_spectrum(transform.with_frequency(_coefficients(spark, d))))


@query(_chain("cf", ", s AS (SELECT block, sqrt(cast(sum(CASE WHEN z + y + x > 0 THEN v * v ELSE 0 END) AS double) / count(*)) p FROM cf GROUP BY ALL), e AS (SELECT block, round(p, 6) power, cast(least(7, greatest(0, floor(log2(greatest(p, cast(1 AS double)))))) AS int) entry FROM s) SELECT *, round(cast(4 AS double) * (1 + entry / cast(8 AS double)), 6) q FROM e"))
def adaptive_q_codebook(spark, d):
    return analytics.adaptive_steps(transform.with_frequency(_coefficients(spark, d)), ["block"], Q)


def _tree_sql(top: int, bottom: int, air: float, variance: float) -> str:
    parts, size = [], top
    while size >= bottom:
        st = f"SELECT z // {size} z, y // {size} y, x // {size} x, count(*) n, count(*) FILTER (WHERE v <> 0) nz, cast(sum(v) AS double) s, cast(sum(v * v) AS double) ss FROM vd GROUP BY ALL"
        up = "" if size == top else f" WHERE EXISTS (SELECT 1 FROM k{2 * size} p WHERE p.kind = 'split' AND p.z = a.z // 2 AND p.y = a.y // 2 AND p.x = a.x // 2)"
        split = f"WHEN 1 - nz / cast(n AS double) > cast({air} AS double) OR ss / greatest(nz, 1) - (s / greatest(nz, 1)) * (s / greatest(nz, 1)) > {variance} THEN 'split'" if size > bottom else ""
        parts.append(f"k{size} AS (SELECT z, y, x, CASE WHEN nz = 0 THEN 'zero' {split} ELSE 'leaf' END kind FROM ({st}) a{up})")
        size //= 2
    sizes = [top >> i for i in range(len(parts))]
    return "+ " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT {n} AS size, z, y, x, kind FROM k{n} WHERE kind <> 'split'" for n in sizes)


@query(sql(_tree_sql(8, 2, 0.32, 900.0), "vd"))
def octree_split(spark, d):
    return analytics.octree(fixtures.dense(spark, d), 8, 2, 0.32, 900.0)


# coding


@query(sql("SELECT z // 32 az, y // 32 ay, x // 32 ax, 2 cover, cast((sum(v) + 16384) // 32768 AS int) dc FROM vs WHERE v <> 0 GROUP BY ALL", "vs"))
def encode_atoms(spark, d):
    return codec.encode_voxels(fixtures.sparse(spark, d), 2.0).select("az", "ay", "ax", "cover", "dc")


def _coded_pairs(spark, d, q: float) -> DataFrame:
    v = fixtures.dense(spark, d)
    box = Box(3, 5, 1, 60, 50, 8)
    coded = codec.encode(codec.pack(v), q)
    return metrics.paired(coverage.crop(v, box), codec.decode_box(coded, box))


@query(sql("SELECT count(*) n, true exact_size, true good FROM vd WHERE z >= 1 AND z < 8 AND y >= 5 AND y < 50 AND x >= 3 AND x < 60", "vd"))
def decode_region_coded(spark, d):
    out = metrics.basket(_coded_pairs(spark, d, 0.5))
    return out.select("n", (F.col("n") == 7 * 45 * 57).alias("exact_size"), (F.col("psnr") > 27).alias("good"))


SWEEP = [round(0.10 * 1.15**k, 6) for k in range(37) if 0.10 * 1.15**k <= 16.0]
_SWEEP = transform.values_sql([(q, f, s) for q in SWEEP for f, s in transform.step_table(16, q)], "q, f, sq")


@query(_chain("cf", f""", st AS {_SWEEP}, lq AS (SELECT block, cast(st.q AS double) q, v, sq, {_LEVEL} AS level FROM cf JOIN st ON f = z + y + x),
e AS (SELECT block, q, count(*) n, count(*) FILTER (WHERE level <> 0) nz, sum(CASE WHEN level <> 0 THEN 2 * floor(log2(cast(abs(level) AS double))) + 1 ELSE 0 END) m, cast(sum((v - sign(level) * floor((abs(level) + cast(0.2 AS double)) * sq / 1048576.0 + 0.5)) * (v - sign(level) * floor((abs(level) + cast(0.2 AS double)) * sq / 1048576.0 + 0.5))) AS double) sse FROM lq GROUP BY ALL),
p AS (SELECT *, nz / cast(n AS double) p FROM e), b AS (SELECT q, n, sse, round(CASE WHEN p = 0 OR p = 1 THEN 0 ELSE -(p * log2(p) + (1 - p) * log2(1 - p)) END * n + m + nz + log2(n + cast(1 AS double)), 6) bits FROM p),
c AS (SELECT q, round(sum(n) * 8 / sum(bits), 6) ratio, round(CASE WHEN sum(sse) = 0 THEN 99.0 ELSE 10 * log10(65025.0 / (sum(sse) / sum(n))) END, 6) psnr FROM b GROUP BY q)
SELECT cast(t.t AS double) target, q, ratio, psnr FROM c, (VALUES (45), (40), (36)) t(t) WHERE psnr >= t.t QUALIFY row_number() OVER (PARTITION BY t.t ORDER BY ratio DESC, q) = 1"""))
def rd_sweep_best(spark, d):
    return analytics.best_points(analytics.sweep(spark, _coefficients(spark, d), 16, SWEEP, ["block"]), [45.0, 40.0, 36.0])


@query(sql("SELECT block, count(*) FILTER (WHERE v = 0) air, 0 leaks, 0 losses FROM vb GROUP BY ALL", "vb"))
def masked_block_codec(spark, d):
    v = fixtures.blocks(spark, d).withColumn("x", F.col("block") * 16 + F.col("x")).select("z", "y", "x", "v")
    rebuilt = codec.unpack(masked.decode(masked.encode(codec.pack(v, 16), 4.0)), 16)
    pairs = metrics.paired(v, rebuilt)
    leaks, losses = F.count_if((F.col("a") == 0) & (F.col("b") != 0)), F.count_if((F.col("a") != 0) & (F.col("b") == 0))
    return pairs.groupBy(A.div("x", 16).alias("block")).agg(F.count_if(F.col("a") == 0).alias("air"), leaks.cast("int").alias("leaks"), losses.cast("int").alias("losses"))


def _export_sql() -> str:
    parts = [f"l{k} AS (SELECT {_HALF}, {_NZ} v FROM {'vs' if k == 1 else f'l{k - 1}'} GROUP BY ALL)" for k in range(1, 4)]
    rows = " UNION ALL ".join(f"SELECT {k} lod, count(*) atoms, cast(sum(dc) AS bigint) dc FROM (SELECT cast((sum(v) + 16384) // 32768 AS int) dc FROM {'vs' if k == 0 else f'l{k}'} WHERE v <> 0 GROUP BY z // 32, y // 32, x // 32)" for k in range(4))
    return "+ " + ", ".join(parts) + " " + rows


@query(sql(_export_sql(), "vs"))
def export_pipeline(spark, d):
    coded = export.coded_levels(fixtures.sparse(spark, d), [2.0, 2.0, 2.0, 2.0])
    return coded.groupBy("lod").agg(F.count("*").alias("atoms"), F.sum("dc").cast("long").alias("dc"))


@query(sql(_EV + "SELECT az, ay, ax, cover, coalesce(payload_id, -1) payload_id FROM a", "ev"))
def event_append_stream(spark, d):
    return appends.event_stream(spark, d, fixtures.log_of).withColumn("payload_id", F.coalesce("payload_id", F.lit(-1)))
