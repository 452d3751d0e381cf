"""Atoms coded and decoded in Spark: packing of voxels, payloads, reads of a box, and rate against quality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.codec import blocks as B
from voxspark.codec.rangecoder import decode_levels, encode_blocks
from voxspark.functions.addressing import local
from voxspark.model import ATOM, KNOWN_ZERO, PRESENT, Box

KEY = ["az", "ay", "ax"]
BATCH = 64
#: Voxels of a piece of a batch, values of a piece of its atoms, and frequencies an axis up to which many atoms are summed at once.
CELLS, PIECE, LOW = 1 << 20, 1 << 17, 8
#: Levels of a payload that is looked for among the others, and levels that are kept until they are coded together.
SHORT, LEVELS = 8, 1 << 19
CODED = "az int, ay int, ax int, cover int, dc int, q double, payload binary"


def _cell_lists(voxels: DataFrame, n: int) -> DataFrame:
    """(az, ay, ax, cells): the raster place and value of each voxel that isn't 0, by atom.

    An atom's list has n^3 entries at most; it is put together on the side that shuffles it.
    """
    place = (local("z", n) * n + local("y", n)) * n + local("x", n)
    keys = [F.floor(F.col(c) / n).cast("int").alias(k) for c, k in zip("zyx", KEY, strict=True)]
    # Coding an atom takes milliseconds, its voxels are some KB: small exchanges are kept from being merged to one task.
    parts = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = voxels.filter("v <> 0").select(*keys, (place * 256 + F.col("v")).cast("int").alias("cell")).repartition(parts, *KEY)
    return keyed.groupBy(*KEY).agg(F.collect_list("cell").alias("cells"))


def pack(voxels: DataFrame, n: int = ATOM) -> DataFrame:
    """(az, ay, ax, vox) of voxels (z, y, x, v): n^3 bytes in raster order, 0 where no voxel is given."""
    lists = _cell_lists(voxels, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                cells = b.column("cells")
                flat, size = cells.flatten().to_numpy(), cells.value_lengths().to_numpy()
                vox = np.zeros((b.num_rows, n**3), np.uint8)
                vox[np.repeat(np.arange(b.num_rows), size), flat >> 8] = flat & 255
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array([v.tobytes() for v in vox], pa.binary())], [*KEY, "vox"])

    return lists.mapInArrow(run, "az int, ay int, ax int, vox binary")


def unpack(atoms: DataFrame, n: int = ATOM) -> DataFrame:
    """(z, y, x, v) of atoms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, y, x = (i.ravel() for i in np.indices((n, n, n)))
        for b in batches:
            for i in range(b.num_rows):
                at = [b.column(k)[i].as_py() for k in KEY]
                v = np.frombuffer(b.column("vox")[i].as_py(), np.uint8)
                yield pa.RecordBatch.from_arrays([*(pa.array((a * n + c).astype(np.int32)) for a, c in zip(at, (z, y, x), strict=True)), pa.array(v.astype(np.int32))], ["z", "y", "x", "v"])

    return atoms.select(*KEY, "vox").mapInArrow(run, "z int, y int, x int, v int")


def code(vox: np.ndarray, q: float) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(dc, levels, payloads) of a batch of blocks."""
    n = vox.shape[1]
    dc = (vox.reshape(len(vox), -1).sum(1, dtype=np.int64) + n**3 // 2) // n**3
    levels = B.quantize(B.forward(vox.astype(np.int64) - dc[:, None, None, None]), q)
    order, bands, _ = B.scan(n)
    flat = levels.reshape(len(vox), -1)[:, order]
    block, place = np.nonzero(flat)
    return dc, levels, encode_blocks(np.bincount(block, minlength=len(vox)), place, flat[block, place], n**3, bands)


def _payloads(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[list[int], list[bytes]]:
    """(atoms, payloads) of atoms given by (atom, place, level). Atoms of a voxel or two have few payloads between them."""
    atom, place, level = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((place, atom))
    atom, place, level = atom[order], place[order], level[order]
    first = np.flatnonzero(np.append(True, atom[1:] != atom[:-1]))
    count = np.diff(np.append(first, len(atom)))
    nth, seen, own = [], {}, []
    for k, (i, c) in enumerate(zip(first.tolist(), count.tolist(), strict=True)):
        key = (place[i : i + c].tobytes(), level[i : i + c].tobytes()) if c <= SHORT else k
        if key not in seen:
            seen[key] = len(own)
            own.append(k)
        nth.append(seen[key])
    some = np.isin(np.repeat(np.arange(len(first)), count), own)
    data = encode_blocks(count[own], place[some], level[some], n**3, B.scan(n)[1])
    return atom[first].tolist(), [data[k] for k in nth]


def _transformed(atom: np.ndarray, place: np.ndarray, v: np.ndarray, dc: np.ndarray, q: float, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(atom, place in scan order, level) of the levels that aren't 0 of atoms given by their voxels, some atoms at a time.

    Atoms without a mean are worked out from their voxels; if these are few, at the low frequencies that have levels.
    Others are filled.
    """
    size = n**3
    first = [np.flatnonzero(np.append(True, k[1:] != k[:-1])) for k in ((atom * size + place) // n, (atom * size + place) // (n * n))]
    rows, planes = (np.bincount(atom[f], minlength=len(dc)) for f in first)
    reach = B.low_reach(np.bincount(atom, v, len(dc)), rows, planes, n, q)
    low = np.minimum(-(-reach // 4) * 4, n)
    cost = planes * low ** np.where(low > LOW, 2, 3)
    filled = dc != 0
    sparse = ~filled & (planes > 0) & (reach > 0)
    rank, step = B.ranks(n), B.steps(n, q).ravel()
    for m in np.unique(low[sparse]).tolist():
        own = np.flatnonzero(sparse & (low == m))
        part = np.cumsum(cost[own]) // PIECE
        raster = np.arange(size).reshape(n, n, n)[:m, :m, :m].ravel()
        for at in np.split(own, np.flatnonzero(part[1:] != part[:-1]) + 1):
            nth = np.full(len(dc), -1)
            nth[at] = np.arange(len(at))
            of = nth[atom]
            on = of >= 0
            some = of[on], place[on], v[on], n, m
            block, i, level = B.levels_low(*some, step[raster]) if m > LOW else B.quantize_some(B.forward_low(*some).reshape(len(at), -1), step[raster])
            yield at[block], rank[raster[i]], level
    own, start = np.flatnonzero(filled), np.searchsorted(atom, np.arange(len(dc) + 1))
    for at in (own[i : i + B.NEAR] for i in range(0, len(own), B.NEAR)):
        vox = np.repeat(-dc[at].astype(np.float64), size).reshape(len(at), size)
        for k, a in enumerate(at.tolist()):
            vox[k, place[start[a] : start[a + 1]]] += v[start[a] : start[a + 1]]
        block, i, level = B.quantize_some(B.lines(vox.reshape(-1, n, n, n), B.matrix(n)).reshape(len(at), -1), step)
        yield at[block], rank[i], level


def code_cells(cells: np.ndarray, count: np.ndarray, q: float, n: int = ATOM) -> tuple[np.ndarray, list[bytes]]:
    """(dc, payloads) of atoms given by the cells of their voxels that aren't 0: what ``code`` gives for them."""
    cells, key = cells.astype(np.int64), np.repeat(np.arange(len(count)), count) * n**3
    key += cells >> 8
    if (key[1:] <= key[:-1]).any():
        order = np.argsort(key, kind="stable")
        order = order[np.append(key[order][1:] != key[order][:-1], True)]
        key, cells = key[order], cells[order]
    atom, place, v = key // n**3, key % n**3, cells & 255
    dc = (np.bincount(atom, v, len(count)).astype(np.int64) + n**3 // 2) // n**3
    out = encode_blocks(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), n**3, B.scan(n)[1]) * len(count)
    found, held = [], 0
    for some in _transformed(atom, place, v, dc, q, n) if len(atom) else ():
        if len(some[0]):
            found.append(some)
            held += len(some[0])
        if held >= LEVELS:
            _put(out, found, n)
            found, held = [], 0
    if found:
        _put(out, found, n)
    return dc, out


def _put(out: list[bytes], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> None:
    for k, data in zip(*_payloads(found, n), strict=True):
        out[k] = data


def rebuild(levels: np.ndarray, dc: np.ndarray, q: float) -> np.ndarray:
    return np.clip(B.inverse(B.dequantize(levels, q)) + dc[:, None, None, None], 0, 255).astype(np.uint8)


def encode(atoms: DataFrame, q: float | None, n: int = ATOM) -> DataFrame:
    """Coded rows of atoms: all-zero ones are KNOWN_ZERO without a payload. No step set is an error, not a guess."""
    if q is None:
        raise ValueError("the level's quantiser step isn't set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                vox = np.stack([np.frombuffer(v, np.uint8) for v in b.column("vox").to_pylist()])
                atom, place = np.nonzero(vox)
                yield _coded(b, place * 256 + vox[atom, place], np.bincount(atom, minlength=len(vox)), q, n)

    return atoms.select(*KEY, "vox").mapInArrow(run, CODED)


def _coded(keys: pa.RecordBatch, cells: np.ndarray, count: np.ndarray, q: float, n: int) -> pa.RecordBatch:
    some = count > 0
    dc, payload = code_cells(cells, count, q, n)
    return pa.RecordBatch.from_arrays(
        [*(keys.column(k) for k in KEY), pa.array(np.where(some, PRESENT, KNOWN_ZERO).astype(np.int32)), pa.array(dc.astype(np.int32)), pa.array(np.full(len(count), q)), pa.array([p if s else None for p, s in zip(payload, some.tolist(), strict=True)], pa.binary())],
        [*KEY, "cover", "dc", "q", "payload"],
    )


def encode_voxels(voxels: DataFrame, q: float | None, n: int = ATOM) -> DataFrame:
    """``encode`` of ``pack``: coded rows of the atoms that voxels (z, y, x, v) make, which are never filled with zeros
    outside the coder."""
    if q is None:
        raise ValueError("the level's quantiser step isn't set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count = b.column("cells").value_lengths().to_numpy().astype(np.int64)
            piece = np.cumsum(count) // CELLS
            edges = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), b.num_rows]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                some = b.slice(i, j - i)
                yield _coded(some, some.column("cells").flatten().to_numpy(), count[i:j], q, n)

    return _cell_lists(voxels, n).mapInArrow(run, CODED)


def decode(coded: DataFrame, n: int = ATOM) -> DataFrame:
    """(az, ay, ax, vox) of coded rows; what isn't present decodes to zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, bands, _ = B.scan(n)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                b = whole.slice(at, BATCH)
                out = []
                for payload, dc, q in zip(b.column("payload").to_pylist(), b.column("dc").to_pylist(), b.column("q").to_pylist(), strict=True):
                    if payload is None:
                        out.append(bytes(n**3))
                        continue
                    levels = np.zeros(n**3, np.int64)
                    levels[order] = decode_levels(payload, bands)
                    out.append(rebuild(levels.reshape(1, n, n, n), np.array([dc]), q).tobytes())
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in KEY), pa.array(out, pa.binary())], [*KEY, "vox"])

    return coded.select(*KEY, "dc", "q", "payload").mapInArrow(run, "az int, ay int, ax int, vox binary")


def decode_box(coded: DataFrame, box: Box, n: int = ATOM) -> DataFrame:
    """Voxels of a box of stored atoms: a range filter on atoms, which a scan can skip by, then a crop."""
    from voxspark.operators.coverage import crop

    on = F.lit(True)
    for k, low, high in (("az", box.z0, box.z1), ("ay", box.y0, box.y1), ("ax", box.x0, box.x1)):
        on = on & F.col(k).between(low // n, (high - 1) // n)
    return crop(unpack(decode(coded.filter(on), n), n), box)


def rates(atoms: DataFrame, qs: list[float], n: int = ATOM) -> DataFrame:
    """(q, bytes, sse, n) summed over atoms, for each step: coded and rebuilt in one pass over each atom."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, BATCH) for whole in batches for at in range(0, whole.num_rows, BATCH)):
            vox = np.stack([np.frombuffer(v, np.uint8) for v in b.column("vox").to_pylist()]).reshape(-1, n, n, n)
            for q in qs:
                dc, levels, payload = code(vox, q)
                err = rebuild(levels, dc, q).astype(np.int64) - vox
                yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([sum(map(len, payload)) + len(vox)]), pa.array([int((err**2).sum())]), pa.array([vox.size])], ["q", "bytes", "sse", "n"])

    parts = atoms.select("vox").mapInArrow(run, "q double, bytes long, sse long, n long")
    return parts.groupBy("q").agg(*[F.sum(c).alias(c) for c in ("bytes", "sse", "n")])


def accounted(coded: DataFrame) -> DataFrame:
    """(kind, n, bytes) of stored rows: payloads, masks where there are any, and a header's byte for each present atom."""
    kinds = [F.struct(F.lit(k).alias("kind"), F.length(k).cast("long").alias("len")) for k in ("payload", "mask") if k in coded.columns]
    header = F.struct(F.lit("header").alias("kind"), F.when(F.col("payload").isNotNull(), F.lit(1)).cast("long").alias("len"))
    rows = coded.select(F.explode(F.array(*kinds, header)).alias("k")).select("k.*").filter("len IS NOT NULL")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum("len").alias("bytes"))
