"""Language ID by word-first backoff: word log frequencies by language, character n-grams for unseen words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm import textkit

#: The classifier is fitted on a sample of labelled documents: about SAMPLE of each language, by hash of the id. A word
#: or n-gram is known if it is found LEAST times in the sample of a language and is at least one in KNOWN of the words
#: or n-grams there; so a language brings at most 6 KNOWN entries, whatever the corpus's size.
SAMPLE = 2000
LEAST = 2
KNOWN = 1 << 16
GRAMS = (5, 4, 3, 2, 1)
FOLDS = 5
#: Bytes of words' vectors that a worker keeps from slice to slice.
CACHE_BYTES = 64 << 20
NONE = "und"

#: ASCII characters that aren't letters stand between words, whatever else does.
GAP = np.ones(256, bool)
GAP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str | None) -> Counter:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _grams(word: str, n: int) -> list[str]:
    edged = f"_{word}_"
    return [edged[i : i + n] for i in range(len(edged) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (n = 0) and n-grams by language, added up in each partition of the sample."""
    whole: dict[str, Counter] = {}
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            whole.setdefault(lang, Counter()).update(words(text))
    for lang, counted in whole.items():
        for n in (0, *GRAMS):
            found: Counter = counted
            if n:
                found = Counter()
                for word, count in counted.items():
                    for g in _grams(word, n):
                        found[g] += count
            size = len(found)
            if size:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * size), pa.array(np.full(size, n, np.int32)), pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["lang", "n", "gram", "count"])


@dataclass
class Model:
    """The log frequency of every known word and n-gram in each language; tables tell their places."""

    languages: list[str]
    tables: dict[int, dict[str, int]] = field(default_factory=dict)
    grams: list[tuple[int, dict[str, int]]] = field(default_factory=list)
    values: np.ndarray | None = None
    rows: dict[int, int] = field(default_factory=dict)
    vectors: np.ndarray | None = None

    def fit(self, rows: pa.Table) -> Model:
        place = {v: i for i, v in enumerate(self.languages)}
        n_of, lang_of = rows.column("n").to_numpy(), np.array([place[v] for v in rows.column("lang").to_pylist()], np.int64)
        gram_of, count_of, total_of = rows.column("gram").to_pylist(), rows.column("count").to_numpy(), rows.column("total").to_numpy()
        parts, base = [], 0
        for n in (0, *GRAMS):
            table: dict[str, int] = {}
            on = np.flatnonzero(n_of == n)
            item = np.array([table.setdefault(gram_of[i], len(table)) for i in on], np.int64)
            count, total = np.zeros((len(table), len(self.languages))), np.ones(len(self.languages))
            count[item, lang_of[on]] = count_of[on]
            total[lang_of[on]] = total_of[on]
            parts.append(np.log((count + 0.5) / (total + 0.5 * (len(table) + 1))))
            self.tables[n] = {g: i + base for g, i in table.items()}
            base += len(table)
        self.values = np.concatenate(parts)
        self.grams = [(n, self.tables[n]) for n in GRAMS]
        return self

    def parts(self, word: str) -> list[int]:
        """Places of what speaks for a word: its own, or of its n-grams, from each place on the longest known."""
        at = self.tables[0].get(word)
        if at is not None:
            return [at]
        edged, found = f"_{word}_", []
        for i in range(len(edged) - 1):
            for n, table in self.grams:
                at = table.get(edged[i : i + n])
                if at is not None:
                    found.append(at)
                    break
        return found

    def backoff(self, word: str) -> np.ndarray:
        """Mean log frequency of a word's n-grams, or its own log frequency."""
        found = self.parts(word)
        return self.values[found].mean(0) if found else np.zeros(len(self.languages))

    def score(self, counted: Counter) -> np.ndarray:
        """Log likelihood of words by language; unseen words count through their n-grams."""
        return sum((count * self.backoff(word) for word, count in counted.items()), np.zeros(len(self.languages)))

    def _learn(self, keys: list[int], runs: Iterator[bytes]) -> None:
        """Rows of runs that weren't met yet: their words' vectors added up, and how many words they are."""
        flat: list[int] = []
        size, owner, worded = [], [], []
        for number, run in enumerate(runs):
            found = _WORD.findall(run.decode("utf-8", "replace").lower())
            worded.append(bool(found))
            for word in found:
                got = self.parts(word)
                if got:
                    flat += got
                    size.append(len(got))
                    owner.append(number)
        new = np.zeros((len(keys), len(self.languages) + 1))
        new[:, -1] = worded
        if flat:
            many = np.array(size)
            np.add.at(new, (np.array(owner), slice(None, -1)), np.add.reduceat(self.values[flat], np.cumsum(many) - many) / many[:, None])
        first = len(self.rows)
        if self.vectors is None or first + len(new) > len(self.vectors):
            grown = np.zeros((max(1 << 14, 2 * (first + len(new))), len(self.languages) + 1))
            if first:
                grown[:first] = self.vectors[:first]
            self.vectors = grown
        self.vectors[first : first + len(new)] = new
        self.rows.update(zip(keys, range(first, first + len(new)), strict=True))

    def totals(self, t: textkit.Texts) -> np.ndarray:
        """Log likelihoods of a slice of texts by language, and in the last column whether a text has words."""
        if len(self.rows) * 8 * (len(self.languages) + 1) > CACHE_BYTES:
            self.rows.clear()
            self.vectors = None
        w = textkit.words(t, gap=GAP)
        value, first, where = np.unique(w.hash, return_index=True, return_inverse=True)
        keys, known = value.tolist(), self.rows
        new = [i for i, v in enumerate(keys) if v not in known]
        if new:
            raw, at = t.data.tobytes(), first[new]
            self._learn([keys[i] for i in new], (raw[a:b] for a, b in zip(w.start[at].tolist(), w.end[at].tolist(), strict=True)))
        out = np.zeros((t.rows, len(self.languages) + 1))
        if len(keys):
            row = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))
            for j in range(out.shape[1]):
                out[:, j] = np.bincount(w.row, self.vectors[row, j][where], t.rows)
        return out


def fit(docs: DataFrame) -> Model:
    """The classifier of ``docs`` (doc_id, text, lang), from its labelled training rows alone."""
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_held_out())
    sizes = train.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    spark = docs.sparkSession
    shares = spark.createDataFrame([(r["lang"], min(1.0, SAMPLE / r["count"])) for r in sizes], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = train.join(F.broadcast(shares), "lang").filter(chance < F.col("share")).select("lang", "text")
    counted = sample.mapInArrow(_counts, "lang string, n int, gram string, count long").groupBy("lang", "n", "gram").agg(F.sum("count").alias("count"))
    total = F.sum("count").alias("total")
    totals = counted.groupBy("lang", "n").agg(total)
    kept = counted.join(F.broadcast(totals), ["lang", "n"]).filter((F.col("count") >= LEAST) & (F.col("count") * KNOWN >= F.col("total")))
    return Model([r["lang"] for r in sizes]).fit(kept.toArrow())


def _held_out():
    return F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(FOLDS)) == 0


def _predict(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for b in batches:
            names, scores = [], []
            for t in textkit.slices(b.column("text")):
                totals = m.totals(t)
                best = totals[:, :-1].argmax(1) if m.languages else np.zeros(t.rows, np.int64)
                worded = (totals[:, -1] > 0) & bool(m.languages)
                for total, i, on in zip(totals[:, :-1], best.tolist(), worded.tolist(), strict=True):
                    names.append(m.languages[i] if on else NONE)
                    scores.append(float(1 / np.exp(np.clip(total - total[i], -700, 0)).sum()) if on else 0.0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from its whole text alone.

    Words are runs of letters, lower-cased. A text that is null or has no letter is ``und`` with score 0, as is
    any where nothing could be learnt; ties go to the language with more documents, then by name. The score is
    the language's share of the likelihood. Rows whose crc32 of the id as text is 0 modulo 5 (a null id counts as 0)
    are never learnt from. Every language that has a training document is learnt. Repeated rows are predicted each; very
    long texts are read whole, a slice by itself; an empty table gives no rows; extra columns are ignored. Nothing but
    the fitting sample is shuffled. The model that is broadcast is bounded by the sample: at most KNOWN words and KNOWN
    n-grams of each length a language, each with a number for each language.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own))
    return own.select("doc_id", "text", _held_out().alias("held_out")).mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
