"""Packing: documents are put beside their BM25 neighbours in sequences of a fixed number of tokens."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxspark.llm import textkit
from voxspark.llm.shared import blocks_for, bucket_of, runs, sized, written

WINDOW = 1024
SHARD_BYTES = 2 << 20
#: Frequencies of so many terms at most are sent to all tasks: 48 MB.
MOST_TERMS = 4_000_000
FLUSH_TERMS = 1 << 21
#: Text whose terms make a bucket of frequencies.
TERM_BYTES = 16 << 20
K1, B = 1.2, 0.75
#: Pieces whose ids a worker keeps, some 32 bytes each.
MOST_CACHED = 2_000_000

_U = np.uint64
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "shard long, seed_doc_id long"
)


class Ids:
    """Token ids of texts. Pieces between blanks are looked up in a cache, others go through the tokenizer.

    A cut before a blank that stands between two characters other than blanks never parts a token, so the ids
    are those of the whole text. Texts that name a special token are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Fixed value: the public pattern of this vocabulary's pre-tokenizer.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        self.chars = str.maketrans({chr(b): chr(256 + i) for i, b in enumerate(other)})
        self._line, self._size = None, np.zeros(0, np.int64)
        self._word = self._merger(path)
        self.clear()

    def clear(self) -> None:
        # Ordered hashes of the pieces in the cache, and the number of each: 12 bytes a piece.
        self.keys, self.codes = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _merger(self, path: str) -> Callable[[str], list[int]]:
        """Ids of one word. Where the file's merges are in the order of their ids, ranks are ids, and the public
        merger for ranked bytes gives what the tokenizer's own model gives, in a quarter of the time."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [vocab[a + b] for a, b in merges]
        if order == sorted(order) and len(set(order)) == len(order):
            byte = {ord(c) if isinstance(c, str) else c: b for b, c in ((b, self.chars.get(b, b)) for b in range(256))}
            marks = {m.decode() for m in self.special}
            ranks = {bytes(byte[ord(c)] for c in token): i for token, i in vocab.items() if token not in marks}
            self._line = tiktoken.Encoding("lines", pat_str=self.split.pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._size = np.zeros(max(ranks.values()) + 1, np.int64)
            self._size[list(ranks.values())] = [len(token) for token in ranks]
            return tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda word: [t.id for t in self.tokenizer.model.tokenize(word.encode().decode("latin-1").translate(self.chars))]

    def _encode(self, piece: str) -> list[int]:
        if piece.isascii():
            if piece[0] == " " and piece[1:].isalpha():
                return self._word(piece)
        elif max(piece) >= "\u0250":
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        body = piece[1:] if piece[0] == " " else piece
        if body.isalpha():
            return self._word(piece)
        if body[-1:] in ".,;:!?" and body[:-1].isalpha():
            return self._encode(piece[:-1]) + self._word(piece[-1])
        return [i for word in self.split.findall(piece) for i in self._word(word)]

    def _encoded(self, pieces: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, plain ones first, and how many each has.

        ``plain`` pieces are cut from within texts, so their ids are the same side by side: they are encoded as one
        line, whose ids are dealt to them by the bytes that these stand for.
        """
        size, single, line = np.zeros(len(pieces), np.int64), np.flatnonzero(~plain), np.zeros(0, np.int64)
        if self._line and plain.any():
            own = [pieces[i] for i in np.flatnonzero(plain).tolist()]
            line = self._line(b"".join(own).decode())
            line = np.fromiter(line, np.int64, len(line))
            upto, end = np.cumsum(self._size[line]), np.cumsum([len(x) for x in own])
            last = np.searchsorted(upto, end)
            if (upto[last] != end).any():
                raise ValueError("a token reaches over a cut")
            size[plain] = np.diff(last + 1, prepend=0)
        else:
            single = np.arange(len(pieces))
        got = [self._encode(pieces[i].decode("utf-8", "replace")) for i in single.tolist()]
        size[single] = [len(x) for x in got]
        return np.concatenate([line, np.fromiter(chain.from_iterable(got), np.int64)]), size

    def _add(self, keys: np.ndarray, place: np.ndarray, pieces: list[bytes], plain: np.ndarray) -> None:
        """Puts pieces in the cache, their ordered hashes at their places among those it has."""
        got, size = self._encoded(pieces, plain)
        order = np.argsort(~plain, kind="stable") if self._line else np.arange(len(pieces))
        first, last = len(self.keys), len(self.keys) + len(keys)
        while self.used + len(got) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(got)] = got
        self.length[first:last] = size
        self.start[first + order] = self.used + np.cumsum(size[order]) - size[order]
        self.used += len(got)
        self.keys = np.insert(self.keys, place, keys)
        self.codes = np.insert(self.codes, place, np.arange(first, last, dtype=np.int32))

    def of(self, t: textkit.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids in order, each text's first place in them; the row and the hash of each piece without its blank."""
        if len(self.keys) > MOST_CACHED:
            self.clear()
        raw = t.data.tobytes()
        start, row = _cuts(t)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(t.rows + 1, np.int64), row, np.zeros(0, np.uint64)
        end = np.minimum(np.append(start[1:], len(t.data)), t.bounds[row + 1])
        blank = t.data[start] == 32
        term = textkit.spans_hashed(t.data, start + blank, end)
        if any(s in raw for s in self.special):
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True)]
            got = [self.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
            return np.fromiter(chain.from_iterable(got), np.uint32), np.concatenate([[0], np.cumsum([len(g) for g in got])]), row, term
        value, first, where = textkit.distinct(term ^ (blank.astype(np.uint64) << _U(63)))
        place = np.searchsorted(self.keys, value)
        had = np.zeros(len(value), bool)
        if len(self.keys):
            had = self.keys[np.minimum(place, len(self.keys) - 1)] == value
        new, code = np.flatnonzero(~had), np.empty(len(value), np.int64)
        code[had] = self.codes[place[had]]
        if len(new):
            code[new] = len(self.keys) + np.arange(len(new))
            at = first[new]
            a, b = start[at], end[at]
            odd = np.concatenate([[0], np.cumsum(_ODD[t.data], dtype=np.int64)])
            # A row's first and last pieces may lack the blank before them, or end in one.
            plain = (odd[a] == odd[b]) & blank[at] & (a > t.bounds[row[at]]) & (b < t.bounds[row[at] + 1])
            self._add(value[new], place[new], [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], plain)
        size, begin = self.length[code][where], self.start[code][where]
        upto = np.cumsum(size, dtype=np.int64)
        at = np.repeat(begin - (upto - size), size)
        at += np.arange(len(at))
        return self.flat[at], np.append(0, upto)[np.searchsorted(row, np.arange(t.rows + 1))], row, term


#: Bytes that a character other than a blank may not start or end with, as far as one byte can tell.
_BLANK = textkit.SPACE.copy()
_BLANK[[0x1C, 0x1D, 0x1E, 0x1F]] = True
#: Bytes of characters on which patterns of words may differ: controls, some Latin-1 signs, and all from U+0240 on.
_ODD = np.zeros(256, bool)
_ODD[:32] = True
_ODD[[9, 10, 13]] = False
_ODD[[0x7F, 0xC0, 0xC1, 0xC2]] = True
_ODD[0xC9:] = True
_AFTER = ~_BLANK
_AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False


def _cuts(t: textkit.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces start, and their rows. Next to characters that may be Unicode blanks there is no cut."""
    d, n = t.data, len(t.data)
    first = t.bounds[:-1][t.bounds[:-1] < n]
    at = np.flatnonzero(d[1:-1] == 32) + 1
    b, c = d[at - 1], d[at - 2]
    blank = _BLANK[b] | ((c == 0xC2) & ((b == 0x85) | (b == 0xA0)))
    wide = d[at - 3]
    blank |= (b >= 0x80) & (c >= 0x80) & ((wide == 0xE1) | (wide == 0xE2) | (wide == 0xE3))
    cut = np.zeros(n, bool)
    cut[at[~blank & _AFTER[d[at + 1]]]] = True
    cut[t.bounds[1:][t.bounds[1:] > t.bounds[:-1]] - 1] = False  # what follows it is another text
    cut[first] = True
    start = np.flatnonzero(cut)
    return start, np.repeat(np.arange(t.rows), np.diff(np.searchsorted(start, t.bounds)))


def _terms(t: textkit.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each piece without its blank, as ``Ids.of`` gives them."""
    start, row = _cuts(t)
    end = np.minimum(np.append(start[1:], len(t.data)), t.bounds[row + 1])[: len(start)]
    return row, textkit.spans_hashed(t.data, start + (t.data[start] == 32), end)


def _counted(row: np.ndarray, term: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, document, count) of each document's distinct terms, ordered."""
    pair = np.sort(term * n + row)
    at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])) if len(pair) else pair
    count, pair = np.diff(np.append(at, len(pair))), pair[at]
    return pair // n, pair % n, count


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.where(df < 2, 0.0, np.maximum(np.log((n - df + 0.5) / (df + 0.5)), 0.0))


class Terms:
    """Document frequencies of terms over a whole corpus, with its number of documents and mean length in terms.

    ``term`` is ordered; terms that aren't in it are found in one document or in most and weigh nothing.
    """

    def __init__(self, term: np.ndarray, df: np.ndarray, total: int, mean: float):
        self.term, self.df, self.total, self.mean = term, df, total, max(mean, 1.0)

    @classmethod
    def of(cls, row: np.ndarray, value: np.ndarray, n: int) -> Terms:
        """Those of ``n`` documents."""
        distinct, _, term = textkit.distinct(value)
        return cls(distinct, np.bincount(_counted(row, term, n)[0], minlength=len(distinct)), n, len(row) / max(n, 1))

    def idf(self, value: np.ndarray) -> np.ndarray:
        if not len(self.term):
            return np.zeros(len(value))
        place = np.minimum(np.searchsorted(self.term, value), len(self.term) - 1)
        return _idf(np.where(self.term[place] == value, self.df[place], 0).astype(np.int64), self.total)

    def weights(self, row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """(distinct values, term, document, count, BM25 weight) of the documents' distinct terms that weigh something."""
        distinct, _, term = textkit.distinct(value)
        term, doc, count = _counted(row, term, n)
        idf = self.idf(distinct)[term]
        on = idf > 0
        term, doc, count = term[on], doc[on], count[on]
        norm = K1 * (1 - B + B * np.bincount(row, minlength=n) / self.mean)
        return distinct, term, doc, count, idf[on] * count * (K1 + 1) / (count + norm[doc])


def strongest(terms: Terms, row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have a term that weighs something, and the one that weighs most in each; ties by hash."""
    distinct, term, doc, _, weight = terms.weights(row, value, n)
    most = np.zeros(n)
    np.maximum.at(most, doc, weight)
    on = weight == most[doc]
    best = np.full(n, np.iinfo(np.int64).min)
    np.maximum.at(best, doc[on], distinct.view(np.int64)[term[on]])
    found = np.flatnonzero(most > 0)
    return found, best[found]


class Index:
    """A BM25 inverted index of one shard's documents; a term is what stands between blanks, weighed by the corpus."""

    def __init__(self, row: np.ndarray, value: np.ndarray, n: int, terms: Terms | None = None):
        distinct, term, doc, count, weight = (terms or Terms.of(row, value, n)).weights(row, value, n)
        # A term that one document of the shard has alone leads to no other.
        on = np.bincount(term, minlength=len(distinct))[term] > 1
        term, doc, count, self.weight = term[on], doc[on], count[on], weight[on]
        self.n, self.doc, self.left = n, doc, n
        self.first = np.searchsorted(term, np.arange(len(distinct) + 1))
        order = np.argsort(doc.astype(np.uint16) if n <= 1 << 16 else doc, kind="stable")
        self.terms, self.count = term[order], count[order]
        self.of = np.searchsorted(doc[order], np.arange(n + 1))

    def neighbours(self, seed: int, used: np.ndarray) -> list[int]:
        """Unused documents that share a weighing term with the seed, best first; ties by place.

        What is used must stay so: when a fifth of the documents is used up, their postings are dropped.
        """
        left = self.n - int(np.count_nonzero(used))
        if 5 * left < 4 * self.left:
            on = ~used[self.doc]
            self.first = np.append(0, np.cumsum(on))[self.first]
            self.doc, self.weight, self.left = self.doc[on], self.weight[on], left
        own = slice(self.of[seed], self.of[seed + 1])
        start, size = self.first[self.terms[own]], self.first[self.terms[own] + 1] - self.first[self.terms[own]]
        at = np.repeat(start - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        score = np.bincount(self.doc[at], self.weight[at] * np.repeat(self.count[own], size), self.n)
        score[used] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")].tolist()


def fill(lengths: np.ndarray, index: Index, window: int) -> list[tuple[int, int, int, int, int, int]]:
    """(document, start, length, sequence, offset, seed) of each piece.

    The first unused document is a seed. Its window is filled with it and, while there is room, with its unused
    neighbours, best first; what doesn't fit goes on in the next window, whose seed it is. Where the seed has no
    neighbour left, the next unused document follows.
    """
    n = len(lengths)
    used = np.zeros(n, bool)
    out: list[tuple[int, int, int, int, int, int]] = []
    sequence, offset, seed, ranked, following = 0, 0, -1, None, 0
    for _ in range(n):
        doc = -1
        if offset:
            if ranked is None:
                ranked = iter(index.neighbours(seed, used))
            doc = next((d for d in ranked if not used[d]), -1)
        if doc < 0:
            while used[following]:
                following += 1
            doc = following
        used[doc] = True
        if not offset:
            seed, ranked = doc, None
        start, left = 0, int(lengths[doc])
        while left:
            take = min(left, window - offset)
            out.append((doc, start, take, sequence, offset, seed))
            start, left, offset = start + take, left - take, offset + take
            if offset == window:
                sequence, offset, seed, ranked = sequence + 1, 0, doc, None
    return out


@lru_cache(2)
def _ids(path: str) -> Ids:
    return Ids(path)


COUNTS = "bucket int, term binary, df binary, pieces long"


def _frequencies(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, term, df, pieces): a bucket's terms and the documents of each, added up within the task, 12 bytes a
    term; the terms of all documents in one row's pieces."""
    values: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    pieces = 0

    def flush(value: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        found = runs(bucket_of(value, buckets))
        rows = [[x[i:j].tobytes() for _, i, j in found] for x in (value, df.astype(np.uint32))]
        bucket, first = pa.array([b for b, _, _ in found], pa.int32()), pa.array([pieces, *[0] * (len(found) - 1)], pa.int64())
        return pa.RecordBatch.from_arrays([bucket, *(pa.array(x, pa.binary()) for x in rows), first], ["bucket", "term", "df", "pieces"])

    for b in batches:
        for t in textkit.slices(b.column("text")):
            row, term = _terms(t)
            own, _, where = textkit.distinct(term)
            values.append(own)
            counts.append(np.bincount(_counted(row, where, t.rows)[0], minlength=len(own)))
            pieces += len(row)
            if sum(map(len, values)) > FLUSH_TERMS:
                value, df = _summed(values, counts)
                if len(value) > FLUSH_TERMS // 2:
                    yield flush(value, df)
                    values, counts, pieces = [], [], 0
                else:
                    values, counts = [value], [df]
    if pieces:
        yield flush(*_summed(values, counts))


def _summed(values: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the sum of each one's counts."""
    order, value, new = textkit.ordered(np.concatenate(values))
    return value[new], np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), np.flatnonzero(new))


def _bucket(table: pa.Table) -> pa.Table:
    """A bucket's terms that two documents have, and a row of its pieces alone (df 0)."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    value, df = _summed(read("term", np.uint64), read("df", np.uint32))
    value, df = value[df > 1].view(np.int64), df[df > 1]
    pieces = np.append(np.zeros(len(df), np.int64), sum(table.column("pieces").to_pylist()))
    return pa.table({"term": np.append(value, 0), "df": np.append(df, 0), "pieces": pieces})


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t in textkit.slices(b.column("text")):
            row, term = _terms(t)
            value, _, where = textkit.distinct(term)
            of, doc, count = _counted(row, where, t.rows)
            salts = b.column("salt").slice(t.first, t.rows).to_numpy()
            length = np.bincount(row, minlength=t.rows)
            yield pa.RecordBatch.from_arrays([pa.array(salts[doc]), pa.array(value[of].view(np.int64)), pa.array(count), pa.array(length[doc])], ["salt", "term", "count", "length"])


def _keys_by_join(own: DataFrame, weighing: DataFrame, total: int, mean: float) -> DataFrame:
    """``own`` with each document's strongest term as ``key``, by a join on terms: for vocabularies too large to send."""
    idf = F.log((F.lit(total) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("count") * (K1 + 1) / (F.col("count") + K1 * (1 - B + B * F.col("length") / max(mean, 1.0)))
    found = own.mapInArrow(_postings, "salt long, term long, count long, length long").join(weighing, "term")
    best = found.groupBy("salt").agg(F.max(F.struct(weight.alias("w"), "term")).alias("best"))
    return own.join(best, "salt", "left").select("doc_id", "text", "salt", F.coalesce("best.term", "salt").alias("key"))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, most_terms: int = MOST_TERMS) -> DataFrame:
    """Pieces of all documents, each token id in exactly one, packed in sequences of at most ``window`` ids.

    A document's ids are those of its text and then id 0; null and empty texts are that id alone. Document
    frequencies and the mean length are those of the whole table. A document's retrieval key is its term that weighs
    most, so that documents of one subject have one key. Keys are dealt to shards of about ``shard_bytes`` by hash; a
    key with more than a quarter of a shard has shards of its own, among which its documents are dealt by a salt, and
    documents without a weighing term are dealt by theirs. A shard's index is one task's work of bounded size; shards
    grow in number. Only a shard's last sequence has padding. Repeated rows and null ids are packed as documents of
    their own; an empty table gives no rows; extra columns are ignored.

    Frequencies of the terms that weigh something go to all tasks while they are at most ``most_terms`` (12 bytes
    each); a larger vocabulary is joined on the term, for the keys and for each shard's terms, with the same result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = blocks_for(docs, TERM_BYTES)
    counted = own.select("text").mapInArrow(lambda batches: _frequencies(batches, buckets), COUNTS)
    counted = written(counted.groupBy("bucket").applyInArrow(_bucket, "term long, df long, pieces long"), "bm25-terms")
    total = own.count()
    mean = (counted.agg(F.sum("pieces").alias("p")).first()["p"] or 0) / max(total, 1)
    weighing = counted.filter((F.col("df") > 1) & (2 * F.col("df") < total)).select("term", "df")
    salted = own.withColumn("salt", F.monotonically_increasing_id())
    sent = None
    if weighing.count() <= most_terms:
        got = weighing.toArrow()
        term, df = got.column("term").to_numpy().view(np.uint64), got.column("df").to_numpy()
        order = np.argsort(term)
        sent = spark.sparkContext.broadcast(Terms(term[order], df[order].astype(np.uint32), total, mean))

        def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = b.column("salt").to_numpy().copy()
                for t in textkit.slices(b.column("text")):
                    doc, best = strongest(sent.value, *_terms(t), t.rows)
                    key[t.first + doc] = best
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], ["doc_id", "text", "salt", "key"])

        found = salted.mapInArrow(keyed, "doc_id long, text string, salt long, key long")
    else:
        found = _keys_by_join(written(salted, "bm25-documents"), weighing, total, mean)
    found = written(found, "bm25-keys")
    n = blocks_for(docs, shard_bytes)
    size = F.sum(F.octet_length("text") + F.lit(64)).alias("size")
    hot = found.groupBy("key").agg(size).filter(F.col("size") > shard_bytes // 4)
    hot = written(hot.select("key", F.ceil(F.col("size") / shard_bytes).alias("many"), F.spark_partition_id().alias("p")), "bm25-hot")
    # Running sums in two steps: of the parts, and within each.
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    parts = hot.groupBy("p").agg(F.sum("many").alias("w")).select("p", F.coalesce(F.sum("w").over(before(Window.orderBy("p"))), F.lit(0)).alias("base"))
    within = F.coalesce(F.sum("many").over(before(Window.partitionBy("p").orderBy("key"))), F.lit(0))
    hot = sized(written(hot.withColumn("within", within).join(parts, "p").select("key", "many", (F.lit(n) + F.col("base") + F.col("within")).alias("first")), "bm25-first"))
    shard = F.coalesce(F.col("first") + F.pmod(F.xxhash64("salt"), F.col("many")), F.pmod(F.xxhash64("key"), F.lit(n)))
    dealt = found.join(hot, "key", "left").select("doc_id", "text", shard.cast("long").alias("shard"))

    def run(table: pa.Table, terms: Terms) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        encoder, n, shard = _ids(tokenizer_path), table.num_rows, table.column("shard")[0].as_py()
        flat, size, row, term = [], [], [], []
        for t in textkit.slices(table.column("text")):
            ids, upto, rows, terms_of = encoder.of(t)
            flat.append(np.insert(ids, upto[1:], 0).astype("<u4"))
            size.append(np.diff(upto) + 1)
            row.append(rows + t.first)
            term.append(terms_of)
        flat, row, term = (np.concatenate(x) for x in (flat, row, term))
        first = np.concatenate([[0], np.cumsum(np.concatenate(size))])
        pieces = np.array(fill(np.diff(first), Index(row, term, n, terms), window))
        doc, start, length, sequence, offset, seed = pieces.T
        at = first[doc] + start
        raw = memoryview(flat.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
        names = table.column("doc_id").combine_chunks()
        return pa.table({
            "doc_id": names.take(pa.array(doc)),
            "start": start,
            "length": length,
            "ids_crc32": pa.array(crc, pa.int64()),
            "doc_tokens": np.diff(first)[doc],
            "sequence_id": sequence + (shard << 32),
            "offset": offset,
            "shard": pa.array(np.full(len(doc), shard)),
            "seed_doc_id": names.take(pa.array(seed)),
        })

    if sent is not None:
        return dealt.groupBy("shard").applyInArrow(lambda table: run(table, sent.value), SCHEMA)
    dealt = written(dealt, "bm25-dealt")
    own_terms = dealt.withColumnRenamed("shard", "salt").mapInArrow(_postings, "salt long, term long, count long, length long")
    frequencies = own_terms.select(F.col("salt").alias("shard"), "term").distinct().join(weighing, "term")

    def joined(table: pa.Table, rows: pa.Table) -> pa.Table:
        term = rows.column("term").to_numpy().view(np.uint64)
        order = np.argsort(term)
        return run(table, Terms(term[order], rows.column("df").to_numpy()[order], total, mean))

    return dealt.groupBy("shard").cogroup(frequencies.groupBy("shard")).applyInArrow(joined, SCHEMA)


def pack_documents(docs: DataFrame) -> DataFrame:
    """``pack`` with the vocabulary ``byte_bpe_50k.json`` in windows of 1024: nulls, empty texts and copies as there."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
