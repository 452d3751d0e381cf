"""A volume as a folder of Parquet tables: created, appended to, marked, and read while it grows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxspark.codec import atoms as codec
from voxspark.functions.addressing import div, region
from voxspark.model import ATOM, CODED_ATOMS, KNOWN_ZERO, PRESENT, VOLUME_META, ZERO_REGIONS, Box, Dims, checked_q
from voxspark.operators import coverage, metrics, repack

KEY = ["az", "ay", "ax"]


def _touching(box: Box):
    """Atoms that a box touches: ranges, which a scan can skip by."""
    spans = zip(KEY, ((box.z0, box.z1), (box.y0, box.y1), (box.x0, box.x1)), strict=True)
    return reduce(and_, (F.col(k).between(low // ATOM, (high - 1) // ATOM) for k, (low, high) in spans))


def _atom_grid(spark: SparkSession, box: Box) -> DataFrame:
    """(az, ay, ax) of all atoms that a box touches: a row for 32768 voxels."""
    first = [getattr(box, f"{c}0") // ATOM for c in "zyx"]
    n = [(getattr(box, f"{c}1") - 1) // ATOM + 1 - f for c, f in zip("zyx", first, strict=True)]
    at = (f"id div {n[1] * n[2]} + {first[0]}", f"id div {n[2]} % {n[1]} + {first[1]}", f"id % {n[2]} + {first[2]}")
    return spark.range(n[0] * n[1] * n[2]).select(*[F.expr(f"cast({e} AS int)").alias(k) for k, e in zip(KEY, at, strict=True)])


class Archive:
    """Tables ``meta``, ``atoms`` (by volume and level) and ``zero`` under a root.

    Rows are only ever added. What is known of an atom is the most that any row says, its payload that of the
    first row with one; so appends may be repeated, and a reader sees whole files or none.
    """

    def __init__(self, spark: SparkSession, root: str, volume: str):
        self.spark, self.root, self.volume = spark, root, volume
        row = spark.read.schema(VOLUME_META).parquet(f"{root}/meta").filter(F.col("volume") == volume).first()
        if row is None:
            raise ValueError(f"{root} has no volume {volume!r}")
        self.dims, self.n_lods, self.base_q, self.metadata = Dims(row["nx"], row["ny"], row["nz"]), row["nlod"], list(row["base_q"]), row["metadata"]

    @classmethod
    def create(cls, spark: SparkSession, root: str, volume: str, dims: Dims, base_q: list[float], target_ratio: float = 10.0, metadata: str = "") -> Archive:
        """Sizes and ratio are checked; each level's step is held in its range."""
        if target_ratio < 1:
            raise ValueError("the target ratio is 1 or more")
        try:
            known = spark.read.schema(VOLUME_META).parquet(f"{root}/meta").filter(F.col("volume") == volume).isEmpty()
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = True
        if not known:
            raise ValueError(f"{root} has a volume {volume!r} already")
        q = [checked_q(v) for v in base_q]
        row = (volume, dims.nx, dims.ny, dims.nz, dims.n_lods, float(target_ratio), q, "dct32", metadata)
        spark.createDataFrame([row], VOLUME_META).write.mode("append").parquet(f"{root}/meta")
        return cls(spark, root, volume)

    def _check(self, lod: int) -> float:
        if not 0 <= lod < self.n_lods:
            raise ValueError(f"level {lod} isn't one of {self.n_lods}")
        if lod >= len(self.base_q):
            raise ValueError(f"level {lod} has no quantiser step")
        return self.base_q[lod]

    def _add(self, rows: DataFrame, lod: int) -> None:
        out = rows.select(F.lit(self.volume).alias("volume"), F.lit(lod).cast("tinyint").alias("lod"), *KEY, F.col("cover").cast("tinyint").alias("cover"), F.col("dc").cast("smallint").alias("dc"), F.col("q").cast("double").alias("q"), F.col("payload").cast("binary").alias("payload"), F.col("ingest_id").cast("long").alias("ingest_id"))
        out.withColumns({"rz": region("az"), "ry": region("ay"), "rx": region("ax")}).repartition("rz", "ry", "rx").sortWithinPartitions("rz", "ry", "rx", *KEY).drop("rz", "ry", "rx").write.mode("append").partitionBy("volume", "lod").parquet(f"{self.root}/atoms")

    def append_atoms(self, atoms: DataFrame, lod: int = 0, ingest_id: int = 0) -> None:
        """Atoms (az, ay, ax, vox): coded in their partitions, none of them outside the grid."""
        q = self._check(lod)
        nz, ny, nx = self.dims.lod(lod).atoms()
        inside = F.col("az").between(0, nz - 1) & F.col("ay").between(0, ny - 1) & F.col("ax").between(0, nx - 1)
        checked = atoms.withColumn("az", F.when(inside, F.col("az")).otherwise(F.raise_error(F.lit("an atom lies outside the volume")).cast("int")))
        self._add(codec.encode(checked, q).withColumn("ingest_id", F.lit(ingest_id)), lod)

    def append_box(self, voxels: DataFrame, box: Box, lod: int = 0, ingest_id: int = 0) -> None:
        """Voxels of a box of whole atoms; atoms of it that hold nothing are known to be zero."""
        box.within(Dims(*(32 * a for a in reversed(self.dims.lod(lod).atoms())))).aligned()
        packed = codec.pack(coverage.crop(voxels, box))
        self.append_atoms(packed, lod, ingest_id)
        # Of the box's atoms only those without a voxel get a row: what is present needs no mark.
        self.mark_zero_atoms(_atom_grid(self.spark, box).join(self.atoms(lod).filter(F.col("cover") == PRESENT), KEY, "left_anti"), lod, ingest_id)

    def mark_zero_atoms(self, atoms: DataFrame, lod: int = 0, ingest_id: int = 0) -> None:
        """Atoms (az, ay, ax): a present one stays present, as a reader takes the most that is known."""
        none = F.lit(None)
        self._add(atoms.select(*KEY, F.lit(KNOWN_ZERO).alias("cover"), F.lit(0).alias("dc"), none.alias("q"), none.alias("payload"), F.lit(ingest_id).alias("ingest_id")), lod)

    def mark_zero_regions(self, regions: DataFrame, lod: int = 0) -> None:
        """Regions (rz, ry, rx); one that holds a present atom stays as it is."""
        free = coverage.mark_zero_regions(regions.select("rz", "ry", "rx").distinct(), self.atoms(lod))
        free.select(F.lit(self.volume).alias("volume"), F.lit(lod).cast("tinyint").alias("lod"), "rz", "ry", "rx").write.mode("append").parquet(f"{self.root}/zero")

    def _table(self, name: str, schema: str, lod: int) -> DataFrame:
        try:
            df = self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            df = self.spark.createDataFrame([], schema)
        return df.filter((F.col("volume") == self.volume) & (F.col("lod") == lod))

    def atoms(self, lod: int = 0) -> DataFrame:
        """(az, ay, ax, cover, dc, q, payload): one row for each atom that anything is known of."""
        first = F.min_by(F.struct("dc", "q", "payload"), F.when(F.col("cover") == PRESENT, F.col("ingest_id")).otherwise(F.lit((1 << 63) - 1)))
        rows = self._table("atoms", CODED_ATOMS, lod).groupBy(*KEY).agg(F.max("cover").cast("int").alias("cover"), first.alias("p"))
        return rows.select(*KEY, "cover", "p.dc", "p.q", "p.payload")

    def zero_regions(self, lod: int = 0) -> DataFrame:
        return self._table("zero", ZERO_REGIONS, lod).select("rz", "ry", "rx").distinct()

    def coverage(self, grid: DataFrame, lod: int = 0) -> DataFrame:
        return coverage.resolve(grid, self.atoms(lod).select(*KEY, "cover"), self.zero_regions(lod))

    def read_box(self, box: Box, lod: int = 0) -> DataFrame:
        """(z, y, x, v) of any box within the level; what is absent reads as 0."""
        box.within(self.dims.lod(lod))
        stored = self.atoms(lod).filter((F.col("cover") == PRESENT) & _touching(box))
        atoms = _atom_grid(self.spark, box).join(stored.select(*KEY, "dc", "q", "payload"), KEY, "left")
        return coverage.crop(codec.unpack(codec.decode(atoms)), box)

    def stats(self, lod: int = 0) -> DataFrame:
        """Atoms by cover among those known, payload bytes with one of a header each, and the ratio over present atoms."""
        bytes_ = F.sum(F.length("payload") + 1)
        return self.atoms(lod).agg(F.count_if(F.col("cover") == PRESENT).alias("present"), F.count_if(F.col("cover") == KNOWN_ZERO).alias("zero"), bytes_.alias("bytes"), F.round(F.count_if(F.col("cover") == PRESENT) * 32768 / bytes_, 4).alias("ratio"))

    def accounting(self, lod: int = 0) -> DataFrame:
        """(kind, n, bytes): where the bytes of a level are."""
        return codec.accounted(self.atoms(lod).filter(F.col("cover") == PRESENT))

    def verify(self, voxels: DataFrame, stride: int, most: int | None = None, lod: int = 0) -> DataFrame:
        """(atoms, n, psnr) of every ``stride``-th atom of the grid that is present, ``most`` of them at most, against
        the volume that it was made of."""
        chosen = repack.sampled(self.atoms(lod), self.dims.lod(lod).atoms(), stride, most).filter(F.col("cover") == PRESENT).persist()
        decoded = codec.unpack(codec.decode(chosen))
        on = [div(c, ATOM) == F.col(k) for c, k in zip("zyx", KEY, strict=True)]
        source = voxels.join(F.broadcast(chosen.select(*KEY)) if most and most <= 10_000 else chosen.select(*KEY), on, "left_semi")
        both = decoded.withColumnRenamed("v", "b").join(source.withColumnRenamed("v", "a"), ["z", "y", "x"], "left").withColumn("a", F.coalesce("a", F.lit(0)))
        return metrics.verified(chosen, both.withColumn("err", F.abs(F.col("a") - F.col("b"))))
