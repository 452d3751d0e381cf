"""Near-duplicate texts: BagMinHash signatures of word shingles, banding, exact multiset verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.llm import textkit
from voxspark.llm.components import components
from voxspark.llm.shared import sized, written

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 20, 4

_U = np.uint64


def signatures(row: np.ndarray, element: np.ndarray, count: np.ndarray, rows: int, size: int) -> np.ndarray:
    """BagMinHash registers of each row's multiset: equal with probability the weighted Jaccard similarity.

    An element's weight axis is cut at 1, 2, 4, 8, ...; over each piece runs a Poisson process with the piece's
    length as rate, seeded by element and piece alone. A point has a time, a register, and a level within its
    piece; it counts where the level is below the element's weight, which is what halving the piece again and
    again would decide. A register holds the earliest time that fell on it. Processes stop at a horizon by which
    all registers of a row are almost surely hit; rows where one isn't go on with a later horizon.
    """
    out = np.full((rows, size), np.inf)
    weight = np.bincount(row, weights=count, minlength=rows)
    horizon = np.where(weight > 0, size * (np.log(size) + 3.0) / np.maximum(weight, 1), 0.0)
    todo = np.flatnonzero(weight > 0)
    while len(todo):
        mine = np.isin(row, todo) if len(todo) < rows else np.ones(len(row), bool)
        r0, e0, c0 = row[mine], element[mine], count[mine]
        piece = 0
        while len(r0):
            low, length = (0, 1) if piece == 0 else (1 << (piece - 1), 1 << (piece - 1))
            r, e, c = r0, e0, c0
            time, step = np.zeros(len(r)), 0
            while len(r):
                with np.errstate(over="ignore"):
                    draw = textkit.mix(e + _U(piece * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F & (1 << 64) - 1))
                time = time - np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / length
                on = time < horizon[r]
                r, e, c, time, draw = r[on], e[on], c[on], time[on], textkit.mix(draw[on])
                register = (draw >> _U(32)) % _U(size)
                if length > 1:
                    hit = low + (draw & _U(length - 1)).astype(np.int64) < c
                    np.minimum.at(out, (r[hit], register[hit].astype(np.int64)), time[hit])
                else:
                    np.minimum.at(out, (r, register.astype(np.int64)), time)
                step += 1
            piece += 1
            more = c0 > (1 << (piece - 1))
            r0, e0, c0 = r0[more], e0[more], c0[more]
        todo = todo[np.isinf(out[todo]).any(1)]
        out[todo] = np.inf
        horizon[todo] *= 3
    return out


def multisets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, row, element, count) of the shingles of each slice of texts."""
    for t in textkit.slices(column):
        row, element, count = textkit.numbered(*textkit.shingles(textkit.words(t), k))
        yield t.first, t.rows, row, element, count


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, rows, row, element, count in multisets(b.column("text"), SHINGLE):
            sign = signatures(row, element, count, rows, BANDS * ROWS).view(np.uint64)
            band = np.zeros((rows, BANDS), np.uint64)
            with np.errstate(over="ignore"):
                for j in range(ROWS):
                    band = textkit.mix(band * _U(31) + sign[:, j::ROWS])
                band = textkit.mix(band + np.arange(BANDS, dtype=np.uint64))
                ids = textkit.occurrences(row, element, count)
                whole, other = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
                np.add.at(whole, ids[0], textkit.mix(ids[1]))
                np.add.at(other, ids[0], textkit.mix(ids[1] ^ _U(0x9E3779B97F4A7C15)))
            size = np.bincount(row, weights=count, minlength=rows).astype(np.int64)
            bands = pa.ListArray.from_arrays(np.arange(0, rows * BANDS + 1, BANDS, dtype=np.int32), band.view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, rows), pa.array(whole.view(np.int64)), pa.array(other.view(np.int64)), pa.array(size), bands], ["doc_id", "whole", "other", "size", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, rows, row, element, count in multisets(b.column("text"), SHINGLE):
            owner, ids = textkit.occurrences(row, element, count)
            at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, rows), pa.ListArray.from_arrays(at, ids.view(np.int64))], ["doc", "ids"])


def _can_link(na: Column, sa: Column, nb: Column, sb: Column) -> Column:
    """Whether sizes n and shared parts s allow the similarity: what two texts have in common is at most min(sa, sb)."""
    both = F.least(sa, sb)
    return both >= LEAST * (na + nb - both)


def _masks(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(pivot, doc, mask): which of 64 shingles of the pivot the text has.

    What a text has of the pivot and a partner lacks is missing from what they share, besides what no other text
    has: in a group of near copies of one source this rules nearly all pairs out before they are made.
    """
    some = sets.select(F.col("doc").alias("pivot"), F.slice("ids", 1, 64).alias("some"))
    both = pairs.join(sets, "doc").join(some, "pivot")
    bits = F.transform("some", lambda x, i: F.when(F.array_contains("ids", x), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return both.select("pivot", "doc", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("mask"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose multisets overlap enough."""
    left, right = (sets.select(F.col("doc").alias(c), F.col("ids").alias(f"{c}_ids")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("a_ids", "b_ids"))
    return both.filter(common >= LEAST * (F.size("a_ids") + F.size("b_ids") - common)).select("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id): documents linked, directly or over others, by a multiset similarity of 0.8 or more.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; shingles are five words, or all words of a shorter text;
    ``class_id`` is the least doc_id of the class. Null and empty texts and texts of blanks are alone, each in
    its own class. Texts with equal shingles (by 128-bit sums) are copies and always of one class. Null ids aren't returned.

    Copies are collapsed first, so a group of copies costs a row a copy. The texts that share a band with another
    give (text, leader) pairs for two leaders of each band: as many pairs as texts, whatever the group's size.
    Verified pairs are contracted to components; then each text that shares a band with a text of another
    component is compared with it, unless bounds rule the similarity out: its size, the part of its shingles that no
    other text has, and 64 shingles of a common pivot. Sizes out of reach are never paired. So no link between texts that share a band is lost, and a large
    group of near copies makes no quadratic number of pairs. A link at 0.8 exactly shares one of 20 bands of 4
    registers with probability 1 - 3e-5. Nothing is collected; every join is on hashed keys that adaptive
    execution can split.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("doc_id").isNotNull())
    signed = written(docs.mapInArrow(_sign, "doc_id long, whole long, other long, size long, bands array<long>"), "bmh-signed")
    full = signed.filter(F.col("size") > 0)
    content = ["whole", "other", "size"]
    reps = written(full.groupBy(*content).agg(F.min("doc_id").alias("doc"), F.any_value("bands").alias("bands")), "bmh-reps")
    banded = reps.select("doc", F.explode("bands").alias("band"))
    many = banded.groupBy("band").agg(F.count("*").alias("m")).filter("m > 1").select("band")
    members = written(banded.join(many, "band"), "bmh-members", narrow=True)
    candidates = sized(written(members.select(F.col("doc").alias("doc_id")).distinct(), "bmh-candidates", narrow=True))
    sets = written(docs.join(candidates, "doc_id", "left_semi").mapInArrow(_elements, "doc long, ids array<long>").dropDuplicates(["doc"]), "bmh-sets")
    alone = sets.select("doc", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.min("doc").alias("doc")).filter("n = 1").groupBy("doc").agg(F.count("*").alias("alone"))
    size = F.size("ids").cast("long")
    live = sets.join(alone, "doc", "left").select("doc", size.alias("n"), (size - F.coalesce("alone", F.lit(0))).alias("s"))
    live = written(live.filter(F.col("s") >= LEAST * F.col("n")), "bmh-live", narrow=True)
    lively = written(members.join(live, "doc"), "bmh-lively", narrow=True)
    # One leader has the most that others share, as the source of a group of near copies does; the other is drawn.
    common = F.max(F.struct((F.col("s") / F.col("n")).alias("r"), F.col("doc").alias("d"))).alias("l1")
    drawn = F.min(F.struct(F.xxhash64("band", "doc").alias("h"), F.col("doc").alias("d"))).alias("l2")
    leaders = lively.groupBy("band").agg(common, drawn, F.count("*").alias("m")).filter("m > 1").select("band", F.array("l1.d", "l2.d").alias("leaders"))
    leaders = written(leaders, "bmh-leaders", narrow=True)
    spoke = lively.join(leaders, "band").select("doc", F.explode("leaders").alias("leader")).filter("doc <> leader")
    pairs = spoke.select(F.least("doc", "leader").alias("a"), F.greatest("doc", "leader").alias("b")).distinct()
    edges = written(_verified(_allowed(pairs, live), sets), "bmh-edges", narrow=True)
    parts = components(edges)
    placed = lively.join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("part", F.coalesce("part", "doc"))
    placed = written(placed, "bmh-placed", narrow=True)
    best = F.max(F.struct((F.col("s") / F.col("n")).alias("r"), F.col("doc").alias("d"))).alias("best")
    counted = placed.groupBy("band", "part").agg(F.count("*").alias("m"), best)
    top = F.max(F.struct("m", "part", "best")).alias("top")
    main = counted.groupBy("band").agg(F.count("*").alias("parts"), top).filter("parts > 1").select("band", F.col("top.part").alias("main"), F.col("top.best.d").alias("pivot"))
    split = written(placed.join(written(main, "bmh-main", narrow=True), "band"), "bmh-split", narrow=True)
    split = split.join(_masks(split.select("pivot", "doc").distinct(), sets), ["pivot", "doc"])
    split = written(split.join(reps.select("doc", "bands"), "doc"), "bmh-masked")
    sides = ("doc", "n", "s", "part", "mask", "bands")
    # Texts of n words, s of them shared, can be linked to texts of 0.8 n to (1 + 1 / 0.8) s - n words alone: a stray
    # meets the sizes in its range, so near copies that differ too much in what they don't share are never paired.
    step = lambda x: F.floor(F.log(F.greatest(x, F.lit(1.0))) / float(np.log(1.05)))
    low = step(LEAST * F.col("n") - 1e-6)
    reach = F.sequence(low, F.greatest(low, step((1 + 1 / LEAST) * F.col("s") - F.col("n") + 1e-6)))
    left = split.filter(F.col("part") != F.col("main")).select("band", F.explode(reach).alias("step"), *[F.col(c).alias(f"{c}_a") for c in sides])
    right = split.select("band", step(F.col("n").cast("double")).alias("step"), "main", "pivot", *[F.col(c).alias(f"{c}_b") for c in sides])
    need = (F.col("n_a") + F.col("n_b")) * (LEAST / (1 + LEAST)) - 1e-6
    missed = [F.col(f"n_{x}") - F.col(f"s_{x}") + F.bit_count(F.col(f"mask_{x}").bitwiseAND(F.bitwise_not(F.col(f"mask_{y}")))) <= F.col(f"n_{x}") - need for x, y in ("ab", "ba")]
    cross = (
        left.join(right, ["band", "step"])
        .filter((F.col("part_a") != F.col("part_b")) & ((F.col("part_b") == F.col("main")) | (F.col("doc_a") < F.col("doc_b"))))
        .filter(_can_link(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b")))
        .filter((F.col("doc_a") == F.col("pivot")) | (F.col("doc_b") == F.col("pivot")) | (missed[0] & missed[1]))
        # a pair is made in the first band that it shares
        .filter(F.element_at("bands_a", F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), F.lit(True)).cast("int")) == F.col("band"))
        .select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))
        .distinct()
    )
    parts = components(written(edges.unionByName(_verified(cross, sets)), "bmh-linked", narrow=True))
    named = reps.select(*content, "doc").join(parts.withColumnRenamed("node", "doc"), "doc", "left").select(*content, F.coalesce("part", "doc").alias("class_id"))
    classes = full.select("doc_id", *content).join(named, content).select("doc_id", "class_id")
    return written(classes.unionByName(signed.filter("size = 0").select("doc_id", F.col("doc_id").alias("class_id"))), "bmh-classes", narrow=True)


def _allowed(pairs: DataFrame, live: DataFrame) -> DataFrame:
    left, right = (live.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("s").alias(f"s_{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(_can_link(F.col("n_a"), F.col("s_a"), F.col("n_b"), F.col("s_b"))).select("a", "b")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with the row of least doc_id of each class; rows with a null doc_id stay, as do empty texts.

    Rows that repeat a kept doc_id all stay: ids name documents.
    """
    first = F.max(F.col("doc_id") == F.col("class_id")).alias("first")
    others = near_duplicates(docs).groupBy("doc_id").agg(first).filter(~F.col("first"))
    others = sized(written(others.select(F.col("doc_id").alias("__nd_id")), "bmh-others-of-classes", narrow=True))
    return docs.withColumn("__nd_id", F.col("doc_id").cast("long")).join(others, "__nd_id", "left_anti").drop("__nd_id")
