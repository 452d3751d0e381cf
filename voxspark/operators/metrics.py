"""How near a reconstruction is: errors, percentiles, structural similarity, mask fidelity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions.addressing import div


def paired(ref: DataFrame, rec: DataFrame) -> DataFrame:
    """(z, y, x, a, b, err) of voxels of both."""
    both = ref.withColumnRenamed("v", "a").join(rec.withColumnRenamed("v", "b"), ["z", "y", "x"])
    return both.withColumn("err", F.abs(F.col("a") - F.col("b")))


def psnr(mse: Column) -> Column:
    return F.when(mse <= 0, 99.0).otherwise(10 * F.log10(65025.0 / mse))


def basket(pairs: DataFrame) -> DataFrame:
    """Squared and absolute errors, PSNR (99 where nothing differs), the largest error: one pass."""
    sums = pairs.agg(F.count("*").alias("n"), F.sum(F.col("err").cast("long") * F.col("err")).alias("sse"), F.sum("err").cast("long").alias("sae"), F.max("err").alias("max_err"))
    mse = F.col("sse") / F.col("n")
    return sums.select("n", "sse", "sae", "max_err", F.round(psnr(mse), 6).alias("psnr"), F.round(F.sqrt(mse), 6).alias("rmse"), F.round(F.col("sae") / F.col("n"), 6).alias("mae"))


def error_histogram(pairs: DataFrame) -> DataFrame:
    """Counts by error: 256 rows at most, whatever the volume."""
    return pairs.groupBy("err").agg(F.count("*").alias("n"))


def error_percentiles(pairs: DataFrame, shares: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """The error at index floor(p * (m - 1)) of the ordered errors, from the histogram."""
    hist = error_histogram(pairs)
    w = Window.orderBy("err").rowsBetween(Window.unboundedPreceding, 0)
    # The histogram has 256 rows at most, so its window is no large partition.
    upto = hist.withColumns({"upto": F.sum("n").over(w), "m": F.sum("n").over(Window.partitionBy(F.lit(1)))})
    wanted = F.explode(F.array(*map(F.lit, shares))).alias("p")
    return upto.select("*", wanted).filter(F.col("upto") > F.floor(F.col("p") * (F.col("m") - 1))).groupBy("p").agg(F.min("err").alias("err"))


def ssim(pairs: DataFrame, size: int = 8) -> DataFrame:
    """Mean structural similarity over complete windows, with sample variances; air counts."""
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    windows = pairs.groupBy(*[div(c, size).alias(f"w{c}") for c in "zyx"]).agg(
        F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("cab")
    )
    s = (2 * F.col("ma") * F.col("mb") + c1) * (2 * F.col("cab") + c2) / ((F.col("ma") ** 2 + F.col("mb") ** 2 + c1) * (F.col("va") + F.col("vb") + c2))
    return windows.filter(F.col("n") == size**3).agg(F.count("*").alias("windows"), F.round(F.avg(s), 6).alias("ssim"))


def mask_fidelity(pairs: DataFrame) -> DataFrame:
    """Air that leaked to material, and material lost to air."""
    return pairs.agg(F.count_if((F.col("a") == 0) & (F.col("b") != 0)).alias("leaks"), F.count_if((F.col("a") != 0) & (F.col("b") == 0)).alias("losses"))


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (z, y, x, a, b) in which two volumes differ; none if they are equal."""
    both = left.withColumnRenamed("v", "a").join(right.withColumnRenamed("v", "b"), ["z", "y", "x"], "full_outer")
    return both.filter(~F.col("a").eqNullSafe(F.col("b")))


def report(pairs: DataFrame) -> DataFrame:
    """Errors over signal and over all voxels, before and after air is forced back to 0: four rows, one pass."""
    variants = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), F.lit(m).alias("masked")) for s in ("signal", "all") for m in (False, True)])).alias("k")
    rows = pairs.select("a", "b", variants).select("k.*", "a", F.when(F.col("k.masked") & (F.col("a") == 0), 0).otherwise(F.col("b")).alias("b"))
    err = (F.col("a") - F.col("b")).cast("long")
    sums = rows.filter("scope = 'all' OR a > 0").groupBy("scope", "masked").agg(F.count("*").alias("n"), F.sum(err * err).alias("sse"), F.max(F.abs(F.col("a") - F.col("b"))).alias("max_err"))
    return sums.withColumn("psnr", F.round(psnr(F.col("sse") / F.col("n")), 6))


def verified(atoms: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of sampled atoms (az, ay, ax): how many there are, their voxels in both volumes, and the PSNR over these."""
    on = [div(c, 32) == F.col(k) for c, k in zip("zyx", ("az", "ay", "ax"), strict=True)]
    sums = pairs.join(atoms.select("az", "ay", "ax"), on).groupBy("az", "ay", "ax").agg(F.count("*").alias("n"), F.sum(F.col("err").cast("long") * F.col("err")).alias("sse"))
    return sums.agg(F.count("*").alias("atoms"), F.sum("n").alias("n"), F.round(psnr(F.sum("sse") / F.sum("n")), 6).alias("psnr"))
