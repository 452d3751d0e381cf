"""Suffix dedup: bytes of 50-byte strings that an earlier document has, by bucket-pointer refinement."""

from __future__ import annotations

import hashlib
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm import textkit
from voxspark.llm.shared import blocks_for, bucket_of, in_blocks, runs, written

DEPTH = 50
Q = 20
OFFSETS = DEPTH - Q + 1
REACH = OFFSETS - 1 + DEPTH
BLOCK_BYTES = 8 << 20

_U = np.uint64
_PIECE = 1 << 20
#: A q-gram with more suffixes than this is hot: its 50-byte strings are compared one by one in buckets of their own.
HOT = 1 << 16
_LOW = _U((1 << 24) - 1)


def _least(data: np.ndarray) -> np.ndarray:
    """For each start of a 50-byte string, the place of its least q-gram, leftmost of equals."""
    n = len(data) - DEPTH + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if n > _PIECE:
        return np.concatenate([_least(data[i : i + _PIECE + DEPTH - 1]) + i for i in range(0, n, _PIECE)])
    prefix = textkit.prefix_hash(data)
    with np.errstate(over="ignore"):
        key = (prefix[Q:] - prefix[:-Q]) * textkit.inverse_powers(len(data) - Q + 1)
    key &= ~_LOW
    key |= np.arange(len(key), dtype=np.uint64)
    width = 1
    while width * 2 <= OFFSETS:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    rest = OFFSETS - width
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    return (key & _LOW).astype(np.int64)


class Block:
    """The rows of one block, ordered by id, and the suffixes that stand for all of theirs.

    Every 50-byte string holds 31 q-grams; the suffix at the least of them (by hash) stands for it. So two equal
    strings are stood for by suffixes with one q-gram, at one distance, and a sixteenth of all suffixes is enough.
    """

    def __init__(self, table: pa.Table):
        table = table.sort_by([("id", "ascending"), ("text", "ascending")])
        self.doc_id, self.id = table.column("doc_id").combine_chunks(), table.column("id").to_numpy()
        parts = list(textkit.slices(table.column("text")))
        self.data = np.concatenate([p.data for p in parts])
        shift = np.cumsum([0] + [len(p.data) for p in parts])
        self.bounds = np.concatenate([[0], *(p.bounds[1:] + s for p, s in zip(parts, shift, strict=False))]).astype(np.int64)
        at, low, high, row, value = [], [], [], [], []
        for p, s in zip(parts, shift, strict=False):
            least = _least(p.data)
            if not len(least):
                continue
            # A suffix begins where the least q-gram changes, and with each row; it ends with its row's last string.
            new = np.append(True, least[1:] != least[:-1])
            new[p.bounds[:-1][p.bounds[:-1] < len(least)]] = True
            first = np.flatnonzero(new)
            owner = np.searchsorted(p.bounds, first, "right") - 1
            end = p.bounds[owner + 1] - DEPTH
            last = np.minimum(np.append(first[1:], len(least)) - 1, end)
            inside = first <= end
            first, last, owner = first[inside], last[inside], owner[inside]
            place = least[first]
            # Mixed once more: the least of 31 hashes is small, and its bucket would be one of the first.
            value.append(textkit.mix(textkit.spans_hashed(p.data, place, place + Q)))
            at.append(place + s)
            low.append(first + s)
            high.append(last + s)
            row.append(owner + p.first)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.at, self.low, self.high, self.row = (join(x, np.int64) for x in (at, low, high, row))
        self.value = join(value, np.uint64)

    def qgrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct q-grams in order; for each, whether two rows here have it, and its suffixes; each suffix's place."""
        value, first, where = textkit.distinct(self.value)
        shared = np.zeros(len(value), bool)
        shared[where[self.row != self.row[first][where]]] = True
        return value, shared, np.bincount(where, minlength=len(value)), where

    def only(self, on: np.ndarray) -> Block:
        """This block with the suffixes that are on."""
        out = copy(self)
        out.at, out.low, out.high, out.row, out.value = (x[on] for x in (self.at, self.low, self.high, self.row, self.value))
        return out

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes around each suffix that its strings cover, others 0, and a bit for each distance it stands for."""
        column, before = np.arange(REACH, dtype=np.int16), OFFSETS - 1
        around = np.empty((len(self.at), REACH), np.uint8)
        padded = np.lib.stride_tricks.sliding_window_view(np.pad(self.data, (before, DEPTH)), REACH)
        for i in range(0, len(self.at), 8192):
            part = slice(i, i + 8192)
            at, low, high = self.at[part], self.low[part], self.high[part]
            start, end = ((x - at + before).astype(np.int16)[:, None] for x in (low, high + DEPTH))
            np.multiply(padded[at], (column >= start) & (column < end), out=around[part])
        # Distances from at - high to at - low.
        one = np.uint64(1)
        bits = (one << (self.at - self.low + 1).astype(np.uint64)) - (one << (self.at - self.high).astype(np.uint64))
        return around, bits.astype(np.uint32)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct contexts ordered by q-gram: (first suffix with each, its bytes, its bits, each suffix's context)."""
        around, bits = self.contexts()
        key, words = self.value ^ textkit.mix(bits), around.view(np.uint64)
        for i in range(0, len(key), 8192):  # as many as stay in a core's cache
            part = key[i : i + 8192]
            with np.errstate(over="ignore"):
                for word in words[i : i + 8192].T:
                    part = textkit.mix(part * _U(31) + word)
            key[i : i + 8192] = part
        key, first, where = textkit.distinct(key)
        order = np.lexsort((key, self.value[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        first = first[order]
        return first, around[first], bits[first], rank[where]

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(identifiers in order, least owner here, start of each string, its place among them) of all 50-byte strings."""
        size = self.high - self.low + 1
        start = np.repeat(self.low - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        owner = np.repeat(self.id[self.row], size)
        start, at = np.unique(start, return_index=True)
        owner = owner[at]
        value, first, where = textkit.distinct(textkit.spans_hashed(self.data, start, start + DEPTH))
        return value, owner[first], start, where


def covered_by(begins: np.ndarray) -> np.ndarray:
    """Bytes that the 50-byte strings cover which begin where it says; at most 50 strings cover a byte."""
    edge = begins.astype(np.int8)
    edge[DEPTH:] -= begins[:-DEPTH].view(np.int8)
    np.cumsum(edge, dtype=np.int8, out=edge)
    return edge > 0


def shared_keys(keys: list[np.ndarray], shared: list[np.ndarray]) -> list[np.ndarray]:
    """Of blocks' q-gram keys in one bucket, those that another block or another row of the block has."""
    flat, out = np.concatenate(keys), np.concatenate(shared).copy()
    order = np.argsort(flat, kind="stable")
    same = flat[order[1:]] == flat[order[:-1]]
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return np.split(out, np.cumsum([len(k) for k in keys])[:-1])


def _later(flags: np.ndarray, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which rows have a key that a smaller owner has."""
    order = np.lexsort((owner, key))
    start = np.append(True, key[order[1:]] != key[order[:-1]])
    least = owner[order][start][np.cumsum(start) - 1]
    flags[order[owner[order] > least]] = True
    return flags


def _refined(value: np.ndarray, around: np.ndarray, bits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """``refine`` for some whole buckets of q-grams."""
    out = np.zeros(len(value), np.uint32)
    who, distance = np.nonzero((bits[:, None] >> np.arange(OFFSETS, dtype=np.uint32)) & 1 == 1)
    bucket = textkit.mix(value[who] + distance.astype(np.uint64))
    windows = np.lib.stride_tricks.sliding_window_view(around, 8, axis=1)
    eights = lambda w: np.ascontiguousarray(w).view(np.uint64)[..., 0]
    ident, have = eights(windows[:, :OFFSETS]), np.arange(len(value))
    for later in (8, 16, 18, 0):
        place = np.searchsorted(have, who)
        with np.errstate(over="ignore"):
            bucket = textkit.mix(bucket * _U(0x2545F4914F6CDD1D) + ident[place, OFFSETS - 1 - distance])
        order, _, new = textkit.ordered(bucket)
        same = ~new[1:]
        many = np.zeros(len(bucket), bool)
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
        who, distance, bucket = who[many], distance[many], bucket[many]
        if not len(who):
            return out
        if later:
            own = np.unique(who)
            # Identifiers are made for the contexts that the first round leaves.
            ident = textkit.mix(eights(windows[own])) if later == 8 else ident[np.searchsorted(have, own)]
            have = own
            with np.errstate(over="ignore"):
                ident = textkit.mix(ident[:, : ident.shape[1] - later] * _U(0x2545F4914F6CDD1D) + ident[:, later:])
    hit = _later(np.zeros(len(who), bool), owner[who], bucket)
    np.bitwise_or.at(out, who[hit], np.uint32(1) << distance[hit].astype(np.uint32))
    return out


def refine(value: np.ndarray, around: np.ndarray, bits: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each context a bit for each distance whose string an owner with a smaller id has too.

    The strings of the contexts start in buckets by q-gram and distance. Each round refines the buckets by sorting on
    the identifier of the bytes at the string's start, and drops strings that are alone in their bucket. An identifier
    is of 8 bytes at first; that of 16 bytes is made of those at an offset and 8 later, that of 32 bytes of those of 16
    bytes, and that of 50 bytes of those of 32 bytes at the offset and 18 later: each round reuses the identifiers of
    the round before, for the contexts that are left.
    """
    out = np.zeros(len(value), np.uint32)
    order, _, new = textkit.ordered(value)
    same = ~new[1:]
    many = np.zeros(len(value), bool)
    many[order[1:][same]] = True
    many[order[:-1][same]] = True
    order = order[many[order]]
    edges = np.flatnonzero(np.append(True, value[order[1:]] != value[order[:-1]])) if len(order) else np.zeros(0, np.int64)
    a = 0
    while a < len(order):
        # whole buckets, about 4k contexts at a time
        after = edges[np.searchsorted(edges, a + 4096) :]
        b = int(after[0]) if len(after) else len(order)
        part = order[a:b]
        out[part] = _refined(value[part], around[part], bits[part], owner[part])
        a = b
    return out


SCHEMA = "doc_id long, text binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


FIRST = "block long, bucket int, keys binary, shared binary, size binary, n int"
ALIVE = "block long, bucket int, on binary, hot binary, n int"
SECOND = "block long, bucket int, value binary, around binary, bits binary, owner binary, id binary, id_owner binary"
TOLD = "block long, bucket int, hit binary, later binary, n_later int"


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table({name: pa.array(v, kinds[kind]) for (name, kind), v in zip(fields, columns, strict=True)})


def _flat(table: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in table.column(name).to_pylist())])


def _bits(table: pa.Table, name: str, size: str) -> np.ndarray:
    rows = zip(table.column(name).to_pylist(), table.column(size).to_pylist(), strict=True)
    return np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(x, np.uint8), count=m).astype(bool) for x, m in rows)])


def _cut(flat: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flat, np.cumsum(sizes)[:-1])


def _count(table: pa.Table) -> pa.Table:
    """For each block's q-grams of one bucket: whether another row has it, and whether it is hot."""
    sizes = table.column("n").to_pylist()
    keys = _flat(table, "keys", np.uint32)
    on = shared_keys(_cut(keys, sizes), _cut(_bits(table, "shared", "n"), sizes))
    _, where = np.unique(keys, return_inverse=True)
    hot = np.bincount(where, _flat(table, "size", np.uint16))[where] > HOT
    packed = [[np.packbits(x).tobytes() for x in got] for got in (on, _cut(hot, sizes))]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "on": pa.array(packed[0], pa.binary()), "hot": pa.array(packed[1], pa.binary()), "n": table.column("n")})


def _answer(table: pa.Table) -> pa.Table:
    """For each block's contexts of one bucket the distances with a smaller owner; the same for strings of hot q-grams."""
    value, owner = _flat(table, "value", np.uint64), _flat(table, "owner", np.int64)
    hit = refine(value, _flat(table, "around", np.uint8).reshape(-1, REACH), _flat(table, "bits", np.uint32), owner)
    sizes, ids = [len(x) // 8 for x in table.column("value").to_pylist()], [len(x) // 8 for x in table.column("id").to_pylist()]
    one, by = _flat(table, "id", np.uint64), _flat(table, "id_owner", np.int64)
    later = _later(np.zeros(len(one), bool), by, one) if len(one) else np.zeros(0, bool)
    return pa.table({
        "block": table.column("block"),
        "bucket": table.column("bucket"),
        "hit": pa.array([x.tobytes() for x in _cut(hit, sizes)], pa.binary()),
        "later": pa.array([np.packbits(x).tobytes() for x in _cut(later, ids)], pa.binary()),
        "n_later": pa.array(ids, pa.int32()),
    })


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, text, n_bytes, n_removed, n_spans, kept_sha256): each row without the bytes that repeat.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input and lie in one document. Null texts are empty; texts under 50 bytes stay whole; rows of
    one doc_id are one document; a null doc_id is below all others; an empty table gives no rows. ``text`` holds the
    bytes that are left (null unless ``texts``), as cuts may part characters. Extra columns are ignored.

    Blocks of some MB of the table's partitions are written bucketed by block, and all three passes read them without
    a shuffle of texts. Pass 1 sends 4 bytes for each distinct q-gram of a block to the q-gram's bucket, which answers
    whether another row has it, and whether it is hot: a common phrase with more than HOT suffixes in the corpus.
    Pass 2 sends the distinct contexts of those suffixes to their buckets, which refine them; of hot q-grams it sends
    the 50-byte strings, which are dealt by their own identifiers, so that no bucket holds all contexts of a phrase.
    Pass 3 cuts. What a bucket gets of a block is one row; a string that a third of all documents hold is one key or
    context a block. Buckets grow in number, not in size. Equality is that of 64-bit identifiers.
    """
    n = blocks_for(docs, BLOCK_BYTES)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = in_blocks(own, BLOCK_BYTES, "suffix_blocks")

    def first(table: pa.Table) -> pa.Table:
        block, rows = table.column("block")[0].as_py(), []
        value, shared, size, _ = Block(table).qgrams()
        keys, size = (value & _U(0xFFFFFFFF)).astype(np.uint32), np.minimum(size, 65535).astype(np.uint16)
        for b, i, j in runs(bucket_of(value, n)):
            rows.append((block, b, keys[i:j].tobytes(), np.packbits(shared[i:j]).tobytes(), size[i:j].tobytes(), j - i))
        return _table(rows, FIRST)

    alive = written(blocks.groupBy("block").applyInArrow(first, FIRST).groupBy("bucket").applyInArrow(_count, ALIVE), "suffix-alive")

    def live(table: pa.Table, marks: pa.Table) -> tuple[Block, Block]:
        """The block with the suffixes that others share: those of hot q-grams, and the rest."""
        block, marks = Block(table), marks.sort_by("bucket")
        on, hot = _bits(marks, "on", "n"), _bits(marks, "hot", "n")
        where = block.qgrams()[3]
        return block.only((on & hot)[where]), block.only((on & ~hot)[where])

    def second(table: pa.Table, marks: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _table([], SECOND)
        rows: dict[int, list[bytes]] = {}
        hot, block = live(table, marks)
        at, around, bits, _ = block.distinct()
        value, owner = block.value[at], block.id[block.row[at]]
        for b, i, j in runs(bucket_of(value, n)):
            rows.setdefault(b, [b""] * 6)[:4] = [x[i:j].tobytes() for x in (value, around, bits, owner)]
        one, by, _, _ = hot.strings()
        for b, i, j in runs(bucket_of(one, n)):
            rows.setdefault(b, [b""] * 6)[4:] = [one[i:j].tobytes(), by[i:j].tobytes()]
        return _table([(table.column("block")[0].as_py(), b, *x) for b, x in rows.items()], SECOND)

    asked = blocks.groupBy("block").cogroup(alive.groupBy("block")).applyInArrow(second, SECOND)
    told = written(asked.groupBy("bucket").applyInArrow(_answer, TOLD), "suffix-told")
    nothing = {"long": F.lit(None).cast("long"), "int": F.lit(None).cast("int"), "binary": F.lit(None).cast("binary")}
    fields = {f.split()[0]: f.split()[1] for f in f"{ALIVE}, {TOLD}".split(", ")}
    both = [part.select(*[part[c] if c in part.columns else nothing[kind].alias(c) for c, kind in fields.items()]) for part in (alive, told)]

    def third(table: pa.Table, marks: pa.Table) -> pa.Table:
        final = marks.column("on").is_null().combine_chunks()
        hot, block = live(table, marks.filter(pa.compute.invert(final)))
        told = marks.filter(final).sort_by("bucket")
        begins = np.zeros(len(block.data), bool)
        if len(block.at):
            at, _, bits, where = block.distinct()
            later = block.id[block.row] > block.id[block.row[at]][where]
            mine = np.where(later, bits[where], _flat(told, "hit", np.uint32)[where])
            for distance in range(OFFSETS):
                begins[block.at[(mine >> np.uint32(distance)) & 1 == 1] - distance] = True
        if len(hot.at):
            _, by, start, where = hot.strings()
            later = hot.id[np.searchsorted(hot.bounds, start, "right") - 1] > by[where]
            begins[start[later | _bits(told, "later", "n_later")[where]]] = True
        covered = covered_by(begins)
        opens = covered.copy()
        opens[1:] &= ~covered[:-1]
        starts = block.bounds[:-1][block.bounds[:-1] < len(covered)]
        opens[starts] = covered[starts]
        rows = list(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True))
        count = lambda x: np.array([np.count_nonzero(x[a:b]) for a, b in rows], np.int64)
        removed, spans = count(covered), count(opens)
        keep = ~covered
        kept = (block.data[a:b][keep[a:b]] if gone else block.data[a:b] for (a, b), gone in zip(rows, removed.tolist(), strict=True))
        kept = [(hashlib.sha256(k).hexdigest(), k.tobytes() if texts else None) for k in kept]
        return pa.table({
            "doc_id": block.doc_id,
            "text": pa.array([k for _, k in kept], pa.binary()),
            "n_bytes": np.diff(block.bounds),
            "n_removed": removed,
            "n_spans": spans,
            "kept_sha256": pa.array([h for h, _ in kept], pa.string()),
        })

    marks = both[0].unionByName(both[1])
    return blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(third, SCHEMA)


def remove_repeats_digest(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` without the texts: nulls, short and empty texts, ties and repeated rows as there."""
    return remove_repeats(docs.select("doc_id", "text"), texts=False).drop("text")
