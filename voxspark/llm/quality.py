"""Quality rules: word and line statistics, and bands of zstandard ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm import textkit

#: Fixed values. Limits of compressed size / size by length in bytes: (from, least, most). Below the least a text
#: is repetitive, above the most it can't be compressed as prose can. The longer a text, the more of it has been seen
#: before; on short ones zstandard's frame weighs. The least lies a few hundredths below any text labelled good.
WHOLE_LIMITS = (
    (0, 0.0, 9.9),
    (64, 0.30, 1.60),
    (128, 0.34, 1.15),
    (256, 0.42, 0.95),
    (512, 0.46, 0.85),
    (1024, 0.445, 0.78),
    (2048, 0.43, 0.76),
    (4096, 0.40, 0.74),
    (16384, 0.37, 0.72),
    (65536, 0.35, 0.72),
)
#: Fixed values. The same for chunks of CHUNK_BYTES, and the share of a text's bytes whose chunks may lie outside. The
#: shorter chunk at a text's end has the limits of a text of its length.
CHUNK_BYTES = 4096
CHUNK_LIMITS = (0.415, 0.78)
CHUNK_SHARE = 0.30
LEVEL = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANKS = " \t\n\x0b\x0c\r"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_outside double"
)


def _dup_lines(text: str) -> int:
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            n += line in seen
            seen.add(line)
    return n


def _repeat_words(w: textkit.Words) -> np.ndarray:
    """Words of each row that lie in a 3-word window found twice or more in the row."""
    value, at = textkit.grams(w, 3)
    if not len(at):
        return np.zeros(w.rows, np.int64)
    row = w.row[at]
    order = np.lexsort((value, row))
    v, r = value[order], row[order]
    same = (v[1:] == v[:-1]) & (r[1:] == r[:-1])
    twice = np.zeros(len(v), bool)
    twice[1:] |= same
    twice[:-1] |= same
    first = at[order[twice]]
    covered = np.zeros(len(w.row), bool)
    for j in range(3):
        covered[first + j] = True
    return np.bincount(w.row[covered], minlength=w.rows)


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]


def compression(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, float]:
    """Ratio of the whole text, and the share of its bytes in chunks outside their limits.

    The chunk at the end is what is left, judged as a text of its length is; so a text of less than a chunk, which
    is its own only chunk, has no share besides its whole ratio's verdict.
    """
    if not raw:
        return 0.0, 0.0
    whole = len(compressor.compress(raw)) / len(raw)
    if len(raw) < CHUNK_BYTES:
        return whole, 0.0
    outside = 0
    for i in range(0, len(raw), CHUNK_BYTES):
        chunk = raw[i : i + CHUNK_BYTES]
        least, most = CHUNK_LIMITS if len(chunk) == CHUNK_BYTES else next(b[1:] for b in reversed(WHOLE_LIMITS) if b[0] <= len(chunk))
        outside += len(chunk) * (not least <= len(compressor.compress(chunk)) / len(chunk) <= most)
    return whole, outside / len(raw)


def verdict(n_bytes: np.ndarray, ratio: np.ndarray, outside: np.ndarray) -> np.ndarray:
    band = np.searchsorted([b[0] for b in WHOLE_LIMITS], n_bytes, "right") - 1
    least, most = (np.array([b[k] for b in WHOLE_LIMITS])[band] for k in (1, 2))
    return (n_bytes == 0) | ((ratio >= least) & (ratio <= most) & (outside <= CHUNK_SHARE))


def _measure(column: pa.Array) -> dict[str, np.ndarray]:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    parts: list[dict[str, np.ndarray]] = []
    for t in textkit.slices(column):
        w = textkit.words(t, lower=False)
        solid, lead = ~textkit.SPACE[t.data], (t.data & 0xC0) != 0x80
        raw = t.data.tobytes()
        texts = [raw[a:b] for a, b in zip(t.bounds[:-1].tolist(), t.bounds[1:].tolist(), strict=True)]
        packed = np.array([compression(x, compressor) for x in texts]).reshape(-1, 2)
        n_words, repeat = np.bincount(w.row, minlength=w.rows), _repeat_words(w)
        failed = (n_words < 50) | (100 * repeat > 50 * n_words)
        parts.append({
            "n_words": n_words,
            "word_chars": _sums(solid & lead, t.bounds),
            "n_symbols": _sums(_SYMBOL[t.data], t.bounds),
            "n_dup_lines": np.array([_dup_lines(x.decode("utf-8", "replace")) for x in texts], np.int64),
            "n_repeat_words": repeat,
            "base_failed": failed,
            "kept": ~failed & verdict(np.diff(t.bounds), packed[:, 0], packed[:, 1]),
            "ratio": packed[:, 0],
            "chunk_outside": packed[:, 1],
        })
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def quality_columns(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs``, then those of ``SCHEMA``, a row for each row of ``docs``.

    Null and empty texts have no words and so fail the base rule. Whole texts are measured, in their scan
    partitions: nothing is shuffled. Repeated rows and null ids are measured like others.
    """
    schema = docs.select(*carry).schema
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                got = _measure(b.column("__q_text"))
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *(pa.array(v) for v in got.values())], [*names, *got])

    return docs.select(*carry, F.col("text").alias("__q_text")).mapInArrow(run, f"{own}, {SCHEMA}")


def quality_digest(docs: DataFrame) -> DataFrame:
    """``quality_columns`` with the id: null and empty texts fail the base rule, copies are measured alike."""
    return quality_columns(docs, ["doc_id"])


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns as they were.

    Null and empty texts and those of under 50 words are rejected, of any length else by their bands; copies share one
    verdict, rows with a null id are judged like others, an empty table stays empty.

    The verdict is taken in one pass over whole rows, without a join.
    """
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(_measure(b.column(at))["kept"]))

    return docs.mapInArrow(run, fields)
