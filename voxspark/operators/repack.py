"""Layout: which regions hold data, and where each blob and payload goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxspark.functions.addressing import local, region, slot
from voxspark.model import KNOWN_ZERO, PRESENT

REGION = ["rz", "ry", "rx"]


def regions_of(atoms: DataFrame) -> DataFrame:
    """Each region's flag (2 data, 1 zero, 0 absent), present atoms and their bytes; atoms: (az, ay, ax, cover, len)."""
    keyed = atoms.select(region("az").alias("rz"), region("ay").alias("ry"), region("ax").alias("rx"), "cover", "len")
    return keyed.groupBy(*REGION).agg(F.max("cover").alias("flag"), F.count_if(F.col("cover") == PRESENT).alias("present"), F.sum(F.when(F.col("cover") == PRESENT, F.col("len")).otherwise(0)).cast("long").alias("bytes"))


def blob_offsets(regions: DataFrame, base: int = 4096) -> DataFrame:
    """Regions with data one after the other. There is one row for 32768 atoms, so this window stays small."""
    w = Window.orderBy(*REGION).rowsBetween(Window.unboundedPreceding, -1)
    return regions.filter(F.col("flag") == PRESENT).select(*REGION, "bytes", (F.coalesce(F.sum("bytes").over(w), F.lit(0)) + base).alias("offset"))


def payload_offsets(atoms: DataFrame) -> DataFrame:
    """Each present atom's place in its region's blob: a running sum in slot order, region by region."""
    keyed = atoms.filter(F.col("cover") == PRESENT).withColumns({"rz": region("az"), "ry": region("ay"), "rx": region("ax"), "slot": slot("az", "ay", "ax")})
    w = Window.partitionBy(*REGION).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return keyed.select("az", "ay", "ax", "slot", "len", F.coalesce(F.sum("len").over(w), F.lit(0)).alias("at"))


def layout(atoms: DataFrame) -> DataFrame:
    """Coarse levels first, then regions, then slots: written so, a region's atoms are read in one go."""
    keyed = atoms.withColumns({"rz": region("az"), "ry": region("ay"), "rx": region("ax"), "slot": slot("az", "ay", "ax")})
    order = [F.desc("lod"), "rz", "ry", "rx"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order, "slot")


def counts(covers: DataFrame) -> DataFrame:
    """Atoms by cover."""
    return covers.agg(F.count_if(F.col("cover") == PRESENT).alias("present"), F.count_if(F.col("cover") == KNOWN_ZERO).alias("zero"), F.count_if(F.col("cover") == 0).alias("absent"))


def sampled(atoms: DataFrame, dims: tuple[int, int, int], stride: int, most: int | None = None) -> DataFrame:
    """Every ``stride``-th atom of the grid in raster order, before cover is looked at: the place is arithmetic.

    With ``most`` the first present ones of these, so many at most.
    """
    _, ny, nx = dims
    kept = atoms.filter(((F.col("az").cast("long") * ny + F.col("ay")) * nx + F.col("ax")) % stride == 0)
    return kept if most is None else kept.filter(F.col("cover") == PRESENT).orderBy("az", "ay", "ax").limit(most)


def places(atoms: DataFrame) -> DataFrame:
    """Each atom's ``place``, from 1, in the order of ``layout``: its row in the region after the rows of all before.

    Regions, one row for 32768 atoms, are summed up by their own window; no window holds the atoms of the volume.
    """
    keyed = atoms.withColumns({"rz": region("az"), "ry": region("ay"), "rx": region("ax"), "slot": slot("az", "ay", "ax")})
    order = [F.desc("lod"), *REGION]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    base = keyed.groupBy("lod", *REGION).agg(F.count("*").alias("w")).select("lod", *REGION, F.coalesce(F.sum("w").over(before), F.lit(0)).alias("base"))
    row = F.row_number().over(Window.partitionBy("lod", *REGION).orderBy("slot"))
    return keyed.withColumn("row", row).join(base, ["lod", *REGION]).withColumn("place", F.col("base") + F.col("row")).drop("row", "base")


def located(wanted: DataFrame, atoms: DataFrame) -> DataFrame:
    """(az, ay, ax, len, offset) of wanted atoms: the region's blob, then the payload in it; absent ones are no rows."""
    blobs = blob_offsets(regions_of(atoms)).select(*REGION, F.col("offset").alias("base"))
    inside = payload_offsets(atoms).join(wanted.select("az", "ay", "ax"), ["az", "ay", "ax"], "left_semi")
    keyed = inside.withColumns({"rz": region("az"), "ry": region("ay"), "rx": region("ax")})
    return keyed.join(blobs, REGION).select("az", "ay", "ax", "len", (F.col("base") + F.col("at")).alias("offset"))


def tree_nodes(chunks: DataFrame) -> DataFrame:
    """Chunks (cz, cy, cx) under nodes of 16^3 children: each child's index, and its rank among those present."""
    child = (local("cz", 16) * 16 + local("cy", 16)) * 16 + local("cx", 16)
    keyed = chunks.select(region16("cz").alias("sz"), region16("cy").alias("sy"), region16("cx").alias("sx"), child.alias("child"))
    w = Window.partitionBy("sz", "sy", "sx").orderBy("child")
    return keyed.withColumn("rank", F.row_number().over(w) - 1)


def node_bitmaps(nodes: DataFrame) -> DataFrame:
    """The presence bits of each node's children, 64 to a word: grouped ORs, so no list of children is collected."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("child").bitwiseAND(63))
    words = nodes.groupBy("sz", "sy", "sx", F.shiftright("child", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.withColumn("n", F.bit_count("bits"))


def region16(c: str):
    return F.shiftright(F.col(c), 4)


def payload_ratio(coded: DataFrame, voxels_per_atom: int = 32768) -> DataFrame:
    """Over present atoms: their bytes, voxels to bytes, and bytes to a present atom."""
    present = coded.filter(F.col("cover") == PRESENT)
    n, total = F.count("*"), F.sum("len").cast("long")
    return present.agg(n.alias("present"), total.alias("bytes"), F.round(n * voxels_per_atom / total, 6).alias("ratio"))


def throughput(rows: DataFrame, at: str, seconds: int) -> DataFrame:
    """Rows in each interval, those so far, the change from the interval before, the average so far, and how many
    intervals the rest takes at that rate. One row an interval, so a window holds them."""
    slot_ = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds).cast("long").alias("slot")
    per = rows.groupBy(slot_).agg(F.count("*").alias("n"))
    w, every = Window.orderBy("slot"), Window.partitionBy(F.lit(1))
    upto = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    average = upto / (F.col("slot") - F.min("slot").over(every) + 1).cast("double")
    rest = (F.sum("n").over(every) - upto) / average
    return per.select("slot", "n", upto.alias("upto"), (F.col("n") - F.lag("n").over(w)).alias("change"), F.round(average, 6).alias("average"), F.round(rest, 6).alias("eta"))
