"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm import textkit

SHINGLE = 5
LEAST = 0.8
BITS, BLOCK_BITS = 128, 16
#: A similarity of 0.8 is an angle of 0.475, so 19.4 of 128 bits differ on average, with a deviation of 4.1.
RADIUS = 36
#: Bytes of benchmark texts that one pass over the documents carries to every task.
ITEM_BYTES = 4 << 20

_U = np.uint64
#: Words are runs of letters, digits and non-ASCII bytes.
GAP = textkit.SPACE.copy()
GAP[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def _signs(value: np.ndarray) -> np.ndarray:
    """-1 or 1 for each bit of each shingle."""
    halves = np.stack([textkit.mix(value ^ _U(0x51ED270B)), textkit.mix(value ^ _U(0xB5297A4D1E0C92F3))], 1)
    return np.unpackbits(halves.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


def _blocks(sums: np.ndarray) -> np.ndarray:
    """Fingerprints as BITS / BLOCK_BITS words of 16 bits."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


@dataclass
class Size:
    """The items of one number of words."""

    ids: list[int] = field(default_factory=list)
    shingles: list[Counter] = field(default_factory=list)
    prints: np.ndarray | None = None
    keys: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def finish(self, sums: np.ndarray) -> None:
        self.prints = _blocks(sums)
        for j in range(self.prints.shape[1]):
            order = np.argsort(self.prints[:, j], kind="stable")
            key, start = np.unique(self.prints[order, j], return_index=True)
            self.keys.append((key, np.append(start, len(order)), order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs at most RADIUS apart.

        Two fingerprints within the radius are within RADIUS // blocks on one block at least, so the buckets
        whose key is that near to a window's block hold every partner.
        """
        share, found = RADIUS // prints.shape[1], []
        for j, (key, start, order) in enumerate(self.keys):
            own, where = np.unique(prints[:, j], return_inverse=True)
            at, bucket = np.nonzero(_ONES[own[:, None] ^ key[None, :]] <= share)
            if not len(at):
                continue
            size = start[bucket + 1] - start[bucket]
            value = np.repeat(at, size)
            item = order[np.repeat(start[bucket] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            # each window takes the partners of its block's value
            first = np.searchsorted(value, np.arange(len(own) + 1))
            many = (first[1:] - first[:-1])[where]
            window = np.repeat(np.arange(len(where)), many)
            place = np.repeat(first[where] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            found.append(window * len(self.ids) + item[place])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pair = np.unique(np.concatenate(found))
        window, item = pair // len(self.ids), pair % len(self.ids)
        on = _ONES[prints[window] ^ self.prints[item]].sum(1, dtype=np.int64) <= RADIUS
        return window[on], item[on]


class Items:
    """Benchmark items by number of words, and for each shingle the numbers of words it occurs with."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        self.sizes: dict[int, Size] = {}
        sums: dict[int, list[np.ndarray]] = {}
        seen: dict[int, set[tuple[int, int]]] = {}
        for t in textkit.slices(pa.array([x for _, x in rows], pa.large_string())):
            w = textkit.words(t, gap=GAP)
            count = np.bincount(w.row, minlength=w.rows)
            first = np.concatenate([[0], np.cumsum(count)])
            for r in np.flatnonzero(count):
                n, k = int(count[r]), min(SHINGLE, int(count[r]))
                one = textkit.Words(w.start, w.end, np.zeros(n, np.int64), w.hash[first[r] : first[r + 1]], 1)
                value, _ = textkit.grams(one, k)
                size = self.sizes.setdefault(n, Size())
                size.ids.append(rows[t.first + int(r)][0])
                size.shingles.append(Counter(value.tolist()))
                sums.setdefault(n, []).append(_signs(value).sum(0))
                seen.setdefault(k, set()).update((v, n) for v in value.tolist())
        for n, size in self.sizes.items():
            size.finish(np.array(sums[n]))
        self.anchors = {}
        for k, pairs in seen.items():
            ordered = sorted(pairs)
            value, words = np.array([p[0] for p in ordered], np.uint64), np.array([p[1] for p in ordered], np.int64)
            mask = np.zeros(1 << 20, bool)
            mask[(value >> _U(44)).astype(np.int64)] = True
            self.anchors[k] = (value, words, mask)

    def matches(self, w: textkit.Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the best window for each row and item."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        total = np.bincount(w.row, minlength=w.rows)
        base = np.concatenate([[0], np.cumsum(total)])
        for k, (value, words, mask) in self.anchors.items():
            shingle, at = textkit.grams(w, k)
            on = np.flatnonzero(mask[(shingle >> _U(44)).astype(np.int64)])
            low, high = np.searchsorted(value, shingle[on], "left"), np.searchsorted(value, shingle[on], "right")
            on, low, high = (x[high > low] for x in (on, low, high))
            if not len(on):
                continue
            many = high - low
            size_of = words[np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            word = np.repeat(at[on], many)
            order = np.full(len(w.row) + 1, -1, np.int64)
            order[at] = np.arange(len(at))
            for n in np.unique(size_of).tolist():
                if min(SHINGLE, n) == k:
                    self._windows(w, n, k, word[size_of == n], shingle, order, base, best)
        for (row, item), (similarity, start, n) in best.items():
            yield row, item, similarity, start, n

    def _windows(self, w, n, k, anchor, shingle, order, base, best) -> None:
        """Windows of n words, or the whole of a shorter text, that hold one of the anchors."""
        row = w.row[anchor]
        low = np.maximum(anchor - (n - k), base[row])
        high = np.maximum(np.minimum(anchor, base[row + 1] - n), base[row])
        many = np.maximum(high - low + 1, 0)
        start = np.unique(np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum()))
        if not len(start):
            return
        size = self.sizes[n]
        for part in range(0, len(start), 4096):
            s = start[part : part + 4096]
            r = w.row[s]
            e = np.minimum(s + n, base[r + 1]) - k + 1
            # runs of words that some window of this part covers, and their running sums of signs
            edge = np.zeros(int(e.max()) - int(s[0]) + 1, np.int64)
            np.add.at(edge, s - s[0], 1)
            np.add.at(edge, e - s[0], -1)
            inside = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
            place = np.searchsorted(inside, np.stack([s, e - 1], 1) - s[0])
            running = np.zeros((len(inside) + 1, BITS), np.int32)
            np.cumsum(_signs(shingle[order[inside + s[0]]]), axis=0, out=running[1:])
            window, item = size.near(_blocks(running[place[:, 1] + 1] - running[place[:, 0]]))
            for i, j in zip(window.tolist(), item.tolist(), strict=True):
                a, b = int(s[i]), int(e[i])
                own = Counter(shingle[order[a:b]].tolist())
                both = sum((own & size.shingles[j]).values())
                similarity = both / (b - a + size.shingles[j].total() - both)
                if similarity >= LEAST:
                    key, begin = (int(r[i]), size.ids[j]), a - int(base[r[i]])
                    had = best.get(key)
                    if had is None or (similarity, -begin) > (had[0], -had[1]):
                        best[key] = (similarity, begin, b - a + k - 1)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in blocks of about ITEM_BYTES, so that no pass broadcasts more than that."""
    size = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 32).alias("b")).first()["b"] or 0
    blocks = max(1, -(-int(size) // ITEM_BYTES))
    dealt = items.select("item_id", "text", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in dealt.filter(F.col("block") == b).select("item_id", "text").collect()]


SCHEMA = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each document for each item it holds.

    Words are runs of characters other than ASCII blanks and punctuation, A-Z lower-cased. A window has as many
    words as the item, a shorter text is one window; shingles are five words (all words of shorter items), their
    weights the times they occur, the similarity is the weighted Jaccard index, 0.8 at least. Windows without a
    shingle of any item of their size have similarity 0 and get no fingerprint; those of all others are searched
    by Hamming distance. Items without words match nothing; null and empty texts hold nothing; repeated rows
    give equal rows, once. Items with one text are all reported.

    Documents aren't shuffled; whole texts are read once for each ITEM_BYTES of benchmark texts.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for rows in _item_blocks(items):
        index = spark.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column("doc_id")
                for t in textkit.slices(b.column("text")):
                    got = list(index.value.matches(textkit.words(t, gap=GAP)))
                    if got:
                        row, item, similarity, first, n = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(row) + t.first)), pa.array(item, pa.int64()), pa.array(similarity), pa.array(first, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

        found = texts.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out.distinct()


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text holds a window of an item, all columns as they were; nothing is shuffled."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    for rows in _item_blocks(items):
        index = spark.sparkContext.broadcast(Items(rows))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = np.ones(b.num_rows, bool)
                for t in textkit.slices(b.column(at)):
                    for row, *_ in index.value.matches(textkit.words(t, gap=GAP)):
                        clean[t.first + row] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(run, fields)
    return docs
