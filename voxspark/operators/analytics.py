"""Statistics of blocks, masks and coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxspark.functions.addressing import div, stats_band
from voxspark.operators.transform import level_of, small_table, step_table, with_frequency

CUBE = ["z", "y", "x"]


def cubes(size: int) -> list:
    return [div(c, size).alias(f"b{c}") for c in CUBE]


def atom_dc(voxels: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean of a full block of n voxels, half up."""
    return voxels.groupBy(*keys).agg(F.expr(f"cast((sum(v) + {n // 2}) div {n} AS int)").alias("dc"))


def material_dc(voxels: DataFrame, keys: list) -> DataFrame:
    """Mean of the voxels that aren't 0, half up; 0 for a block of air."""
    return voxels.groupBy(*keys).agg(F.expr("CASE WHEN count_if(v <> 0) = 0 THEN 0 ELSE cast((sum(v) + count_if(v <> 0) div 2) div count_if(v <> 0) AS int) END").alias("dc"))


def block_stats(voxels: DataFrame, size: int) -> DataFrame:
    """Count and population variance of what isn't 0, by cube."""
    return voxels.groupBy(*cubes(size)).agg(F.count_if(F.col("v") != 0).alias("nonzero"), F.round(F.coalesce(F.expr("var_pop(v) FILTER (WHERE v <> 0)"), F.lit(0.0)), 6).alias("variance"))


def uniformity(voxels: DataFrame, size: int) -> DataFrame:
    """0 mixed, 1 all air, 2 all material, by cube."""
    return voxels.groupBy(*cubes(size)).agg(F.when(F.max("v") == 0, 1).when(F.min("v") > 0, 2).otherwise(0).alias("kind"))


def octree_mask_cost(voxels: DataFrame, size: int) -> DataFrame:
    """Bits of an octree over each cube's mask: one for a node, and its children's where it is mixed.

    Level by level from the voxels up: a node's cost and kind come from its eight children's.
    """
    nodes = voxels.select(*CUBE, F.when(F.col("v") == 0, 1).otherwise(2).alias("kind"), F.lit(1).cast("long").alias("bits"))
    while size > 1:
        same = F.min("kind") == F.max("kind")
        nodes = nodes.groupBy(*[div(c, 2).alias(c) for c in CUBE]).agg(
            F.when(same & (F.min("kind") > 0), F.min("kind")).otherwise(0).alias("kind"),
            F.when(same & (F.min("kind") > 0), F.lit(1)).otherwise(1 + F.sum("bits")).cast("long").alias("bits"),
        )
        size //= 2
    return nodes


_STEPS = [(dz, dy, dx) for dz, dy, dx in ((0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]


def dilate(points: DataFrame, within: DataFrame) -> DataFrame:
    """Points (block, z, y, x) and their six neighbours, as far as they lie in ``within``."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in _STEPS])).alias("d")
    near = points.select("block", *CUBE, step).select("block", (F.col("z") + F.col("d.a")).alias("z"), (F.col("y") + F.col("d.b")).alias("y"), (F.col("x") + F.col("d.c")).alias("x")).distinct()
    return near.join(within.select("block", *CUBE), ["block", *CUBE], "left_semi")


def close(points: DataFrame, within: DataFrame) -> DataFrame:
    """Dilation, then erosion: what remains doesn't touch the complement of the dilated points."""
    grown = dilate(points, within)
    rest = within.select("block", *CUBE).join(grown, ["block", *CUBE], "left_anti")
    return grown.join(dilate(rest, within), ["block", *CUBE], "left_anti")


def fill_once(voxels: DataFrame) -> DataFrame:
    """One sweep over the air of each block: the mean of its neighbours in the block; material stays."""
    dc = material_dc(voxels, ["block"])
    start = voxels.join(dc, "block").withColumn("f", F.when(F.col("v") == 0, F.col("dc")).otherwise(F.col("v")))
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in _STEPS[1:]])).alias("d")
    given = start.select("block", *CUBE, "f", step).select("block", (F.col("z") + F.col("d.a")).alias("z"), (F.col("y") + F.col("d.b")).alias("y"), (F.col("x") + F.col("d.c")).alias("x"), "f")
    mean = given.groupBy("block", *CUBE).agg(F.floor(F.sum("f") / F.count("*") + F.lit(0.5)).cast("int").alias("m"))
    return start.filter("v = 0").join(mean, ["block", *CUBE]).select("block", *CUBE, F.col("m").alias("v")).unionByName(voxels.filter("v <> 0").select("block", *CUBE, "v"))


def mask_contexts(voxels: DataFrame) -> DataFrame:
    """How often a voxel is air, by which of its three earlier neighbours are: eight contexts."""
    air = voxels.withColumn("air", (F.col("v") == 0).cast("int"))
    lag = lambda c: F.coalesce(F.lag("air").over(Window.partitionBy("block", *[k for k in CUBE if k != c]).orderBy(c)), F.lit(0))
    ctx = (lag("z") * 4 + lag("y") * 2 + lag("x")).alias("ctx")
    return air.select("air", ctx).groupBy("ctx").agg(F.count("*").alias("n"), F.sum("air").cast("long").alias("air"))


def band_stats(levels: DataFrame) -> DataFrame:
    """Coefficients, those that aren't 0, negative ones, and the entropy of significance, by band."""
    n, nz = F.count("*"), F.count_if(F.col("level") != 0)
    p = nz / n
    bits = F.when((p == 0) | (p == 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)) * n)
    return levels.groupBy(stats_band("f").alias("band")).agg(n.alias("n"), nz.alias("nonzero"), F.count_if(F.col("level") < 0).alias("negative"), F.max(F.least(F.abs("level"), F.lit(15))).alias("top"), F.round(bits, 6).alias("bits"))


def power_spectrum(coefficients: DataFrame) -> DataFrame:
    """Root mean square by L1 frequency."""
    return coefficients.groupBy("f").agg(F.round(F.sqrt(F.sum((F.col("v") * F.col("v")).cast("long")) / F.count("*")), 6).alias("rms"))


def bit_estimate(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Order-0 bits of each block: significance up to the end, magnitudes by their logarithm, signs, the end itself."""
    placed = levels.groupBy(*keys).agg(F.count_if(F.col("level") != 0).alias("nz"), F.count("*").alias("n"), F.sum(F.when(F.col("level") != 0, 2 * F.floor(F.log2(F.abs("level").cast("double"))) + 1).otherwise(0)).alias("m"))
    p = F.col("nz") / F.col("n")
    h = F.when((p == 0) | (p == 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return placed.select(*keys, F.round(h * F.col("n") + F.col("m") + F.col("nz") + F.log2(F.col("n") + 1.0), 6).alias("bits"))


def denoise(coefficients: DataFrame, threshold: int) -> DataFrame:
    """Soft threshold of all coefficients but the first."""
    small = F.greatest(F.abs("v") - threshold, F.lit(0)) * F.signum("v").cast("int")
    return coefficients.withColumn("v", F.when(F.col("z") + F.col("y") + F.col("x") == 0, F.col("v")).otherwise(small).cast("long"))


def corrections(pairs: DataFrame, cap: int) -> DataFrame:
    """Voxels whose error is over the cap, with what to add."""
    return pairs.filter(F.col("err") > cap).select("z", "y", "x", (F.col("a") - F.col("b")).alias("add"))


def corrected(voxels: DataFrame, table: DataFrame) -> DataFrame:
    """A decoded volume with the corrections of its outliers added."""
    return voxels.join(table, ["z", "y", "x"], "left").select("z", "y", "x", (F.col("v") + F.coalesce("add", F.lit(0))).cast("int").alias("v"))


def magnitudes(levels: DataFrame) -> DataFrame:
    """Coefficients by band and size, sizes from 15 on together."""
    return levels.groupBy(stats_band("f").alias("band"), F.least(F.abs("level"), F.lit(15)).cast("int").alias("magnitude")).agg(F.count("*").alias("n"))


def band_entropy(histogram: DataFrame) -> DataFrame:
    """Ideal bits by band of what isn't 0, and of the sizes and signs of those: a histogram of 128 rows at most."""
    w = Window.partitionBy("band")
    some = F.sum(F.when(F.col("magnitude") > 0, F.col("n")).otherwise(0)).over(w)
    share = F.col("n") / F.col("nz")
    rows = histogram.withColumns({"nz": some, "total": F.sum("n").over(w)})
    sizes = F.sum(F.when(F.col("magnitude") > 0, -share * F.log2(share)).otherwise(0.0))
    sums = rows.groupBy("band", "nz", "total").agg(sizes.alias("h"))
    p = F.col("nz") / F.col("total")
    bits = F.when((p == 0) | (p == 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)) * F.col("total"))
    return sums.select("band", F.round(bits, 6).alias("significance_bits"), F.round((F.col("h") + 1) * F.col("nz"), 6).alias("magnitude_bits"))


def material_ratio(voxels: DataFrame, payloads: DataFrame) -> DataFrame:
    """Voxels that aren't 0, and how many of them a payload's byte (``len``) holds."""
    total = payloads.agg(F.sum("len").alias("bytes"))
    return voxels.agg(F.count_if(F.col("v") != 0).alias("material")).join(F.broadcast(total)).select("material", F.round(F.col("material") / F.col("bytes"), 6).alias("ratio"))


def sizes(voxels: DataFrame, residual: DataFrame) -> DataFrame:
    """Order-0 bytes of a level's own values and of its residual from the level above."""
    values = voxels.select(F.lit("own").alias("kind"), F.col("v").alias("e")).unionByName(residual.select(F.lit("residual").alias("kind"), F.col("r").alias("e")))
    # A histogram has 511 values at most, so its windows are small.
    counts = values.groupBy("kind", "e").agg(F.count("*").alias("c")).withColumn("n", F.sum("c").over(Window.partitionBy("kind")))
    p = F.col("c") / F.col("n")
    return counts.groupBy("kind", "n").agg(F.round(F.sum(-p * F.log2(p)) * F.col("n") / 8, 4).alias("bytes"))


def sweep(spark: SparkSession, coefficients: DataFrame, n: int, qs: list[float], keys: list[str]) -> DataFrame:
    """(q, ratio, psnr) for each step: order-0 bits of each block, and the squared error of its coefficients.

    The transform keeps lengths, so the error of coefficients is that of voxels but for rounding. Each coefficient
    meets the steps of its own frequency, which are a table of fixed size.
    """
    steps = small_table(spark, [(float(q), f, s) for q in qs for f, s in step_table(n, q)], "q double, f int, sq long")
    levels = with_frequency(coefficients).join(steps, "f").withColumn("level", level_of("v", "sq"))
    size = F.floor((F.abs("level") + F.lit(0.2)) * F.col("sq") / F.lit(1048576.0) + F.lit(0.5))
    error = F.col("v") - F.signum("level") * size
    rows = levels.withColumn("error", error * error)
    bits = bit_estimate(rows, [*keys, "q"])
    sums = rows.groupBy("q").agg(F.count("*").alias("n"), F.sum("error").alias("sse"))
    mse = F.col("sse") / F.col("n")
    total = bits.groupBy("q").agg(F.sum("bits").alias("bits"))
    return sums.join(total, "q").select("q", F.round(F.col("n") * 8 / F.col("bits"), 6).alias("ratio"), F.round(F.when(mse <= 0, 99.0).otherwise(10 * F.log10(65025.0 / mse)), 6).alias("psnr"))


def best_points(points: DataFrame, targets: list[float]) -> DataFrame:
    """For each target the point (q, ratio, psnr) with the largest ratio that is good enough; none if none is."""
    wanted = points.withColumn("target", F.explode(F.array(*map(F.lit, targets)))).filter(F.col("psnr") >= F.col("target"))
    top = F.max_by(F.struct("q", "ratio", "psnr"), F.struct("ratio", -F.col("q")))
    return wanted.groupBy("target").agg(top.alias("p")).select("target", "p.*")


def drop_high(coefficients: DataFrame, keep: int) -> DataFrame:
    """Coefficients without those above a frequency: rows that aren't there are zeros."""
    return coefficients.filter(F.col("f") <= keep)


def spectrum_weights(spectrum: DataFrame, low: float = 1.0, high: float = 3.0) -> DataFrame:
    """A quantiser weight for each frequency: how far its power lies below the strongest, within bounds."""
    # A spectrum has 3n - 2 rows for blocks of n^3, so one window holds it.
    top = F.max(F.when(F.col("f") > 0, F.col("rms"))).over(Window.partitionBy(F.lit(1)))
    weight = F.least(F.lit(high), F.greatest(F.lit(low), F.sqrt(F.col("top") / F.greatest(F.col("rms"), F.lit(1e-6)))))
    return spectrum.withColumn("top", top).select("f", F.round(weight, 6).alias("weight"))


def adaptive_steps(coefficients: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A step for each block from a codebook of eight, by the power of its coefficients but the first."""
    ac = F.sqrt(F.sum(F.when(F.col("f") > 0, (F.col("v") * F.col("v")).cast("long")).otherwise(0)) / F.count("*"))
    index = F.least(F.lit(7), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(ac, F.lit(1.0)))))).cast("int")
    return coefficients.groupBy(*keys).agg(F.round(ac, 6).alias("power"), index.alias("entry")).withColumn("q", F.round(F.lit(q) * (F.lit(1.0) + F.col("entry") / F.lit(8.0)), 6))


def octree(voxels: DataFrame, top: int, bottom: int, most_air: float, most_variance: float) -> DataFrame:
    """(size, z, y, x, kind) of a split from cubes of ``top`` down to ``bottom``: ``zero``, or ``leaf``.

    A cube with much air or a large variance is split while it is larger than ``bottom``. Statistics of each size
    come from the voxels' sums of the size below; a cube is visited if the one above it was split.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "nz", "s", "ss")]
    now = voxels.select(*CUBE, F.lit(1).cast("long").alias("n"), (F.col("v") != 0).cast("long").alias("nz"), F.col("v").cast("long").alias("s"), (F.col("v") * F.col("v")).cast("long").alias("ss"))
    levels, size = {}, 1
    while size < top:
        size *= 2
        now = now.groupBy(*[div(c, 2).alias(c) for c in CUBE]).agg(*sums)
        if size >= bottom:
            levels[size] = now
    out, parents, size = None, None, top
    while size >= bottom:
        at = levels[size]
        if parents is not None:
            above = parents.select(*[F.col(c).alias(f"p{c}") for c in CUBE])
            at = at.join(above, [div(c, 2) == F.col(f"p{c}") for c in CUBE], "left_semi")
        mean = F.col("s") / F.greatest(F.col("nz"), F.lit(1))
        variance = F.col("ss") / F.greatest(F.col("nz"), F.lit(1)) - mean * mean
        split = F.lit(size > bottom) & ((1 - F.col("nz") / F.col("n") > most_air) | (variance > most_variance))
        kind = F.when(F.col("nz") == 0, "zero").when(split, "split").otherwise("leaf")
        at = at.withColumn("kind", kind)
        done = at.filter("kind <> 'split'").select(F.lit(size).alias("size"), *CUBE, "kind")
        out = done if out is None else out.unionByName(done)
        parents, size = at.filter("kind = 'split'"), size // 2
    return out
