"""Language-model scores: a weighted backoff automaton of smoothed word n-grams, and an additive unigram beside it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxspark.llm import textkit
from voxspark.llm.shared import blocks_for, bucket_of, in_blocks, runs, written

ORDER = 3
#: Pseudo-counts that a context of one word, of two words gives to its failure arc.
PRIOR = (6.0, 3.0)
BLOCK_BYTES = 8 << 20
FOLDS = 10
#: Parts of a block's tokens that are walked side by side.
LANES = 1024

_U = np.uint64
_EDGE = _U(0x5851F42D4C957F2D)
#: Bytes of a key that buckets are sent: a word's hash is whole, an n-gram's is told apart within its bucket.
KEY_BYTES = (8, 5, 5)


def _narrow(x: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned integers that hold them; their width is the bytes for each."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64).tobytes()


def _wide(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def _cut_keys(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _keys(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view(np.uint64)[:, 0]


class Tokens:
    """A block's texts back to back, each between two edges: the context in which it starts, and its end token.

    ``grams[k]`` has the distinct n-grams of k + 1 tokens: their ordered keys, the place where each first ends, and for
    each token the one that it ends, -1 where a text is too short before it.
    """

    def __init__(self, table: pa.Table):
        self.table, rows = table, table.num_rows
        parts = [(t.first, textkit.words(t)) for t in textkit.slices(table.column("text"))]
        row = np.concatenate([np.zeros(0, np.int64), *(w.row + first for first, w in parts)])
        size = np.bincount(row, minlength=rows) + 2
        self.text = np.repeat(np.arange(rows), size)
        self.first = np.cumsum(size) - size
        self.hash = np.full(len(self.text), _EDGE)
        self.hash[np.arange(len(row)) + 2 * row + 1] = np.concatenate([np.zeros(0, np.uint64), *(w.hash for _, w in parts)])
        place = np.arange(len(self.text)) - self.first[self.text]
        self.scored = place > 0
        self.train = ~table.column("held_out").to_numpy(zero_copy_only=False)[self.text]
        self.grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        key = self.hash
        for k in range(ORDER):
            if k:
                with np.errstate(over="ignore"):
                    key = textkit.mix(np.append(_U(0), key[:-1]) * _U(0x2545F4914F6CDD1D) + self.hash)
            at = np.flatnonzero(place >= max(k, 1))
            value, first, where = np.unique(key[at], return_index=True, return_inverse=True)
            of = np.full(len(key), -1, np.int64)
            of[at] = where
            self.grams.append((value, at[first], of))

    def counts(self, k: int) -> np.ndarray:
        """How often the training texts of this block have each n-gram."""
        value, _, of = self.grams[k]
        return np.bincount(of[(of >= 0) & self.train], minlength=len(value))


class Automaton:
    """The part of the backoff automaton that a block's texts can reach.

    States are the empty context (0), then the contexts of one word, then those of two words, that training has. An
    arc carries the log10 probability of its word and leads to the longest context that the text then has. Where a
    state has no arc for a word, its failure arc leads to the context without its first word, at a weight. Contexts
    are smoothed by a prior of ``PRIOR`` pseudo-counts, dealt as the shorter context has it: arcs and failure arcs of
    a state add up to one. The empty context knows every word of training; unseen words share the mass that words
    found once have there, each getting the share of one of as many types as Chao's estimate says are unseen.
    """

    def __init__(self, tokens: Tokens, total: list[np.ndarray], facts: dict[str, int]):
        (words, _, word_of), n = tokens.grams[0], max(facts["tokens"], 1)
        unseen = (facts["once"] + 0.5) / (facts["tokens"] + 1) if facts["tokens"] else 1.0
        types = max(1.0, facts["once"] ** 2 / (2 * facts["twice"] + 1)) if facts["tokens"] else 1.0
        chance = [np.where(total[0] > 0, (1 - unseen) * total[0] / n, unseen / types)]
        self.width = len(words)
        edge = int(np.searchsorted(words, _EDGE))
        self.symbol = np.where(tokens.scored, word_of, edge)
        # A state for each n-gram that training has; n-grams that end a text lead nowhere and do no harm.
        state, fail, weight, below = [], [np.zeros(1, np.int64)], [np.zeros(1)], 1
        keys, logs, targets = [], [], []
        for k in range(ORDER):
            value, at, of = tokens.grams[k]
            on = total[k] > 0
            if k:
                before = tokens.grams[k - 1][2][at - 1] if k > 1 else self.symbol[at - 1]
                shorter = tokens.grams[k - 1][2][at]
                held, mass = total[k - 1][before], PRIOR[k - 1]
                p = (total[k] + mass * chance[k - 1][shorter]) / (held + mass)
                chance.append(np.where(on, p, 0.0))
                keys.append(state[k - 1][before[on]] * self.width + self.symbol[at[on]])
                logs.append(np.log10(p[on]))
            if k < ORDER - 1:
                own = np.zeros(len(value), np.int64)
                own[on] = below + np.arange(int(on.sum()))
                below += int(on.sum())
                state.append(own)
                fail.append(state[k - 1][shorter[on]] if k else np.zeros(int(on.sum()), np.int64))
                weight.append(np.log10(PRIOR[k] / (total[k][on] + PRIOR[k])))
                if k:
                    targets.append(own[on])
            else:
                targets.append(state[k - 1][shorter[on]] if k else np.zeros(0, np.int64))
        self.fail, self.weight = np.concatenate(fail), np.concatenate(weight)
        self.root_log, self.root_to = np.log10(chance[0]), state[0] if state else np.zeros(len(words), np.int64)
        self.start = int(self.root_to[edge])
        key = np.concatenate([np.zeros(0, np.int64), *keys])
        order = np.argsort(key)
        self.key = np.append(key[order], np.iinfo(np.int64).max)
        self.log = np.append(np.concatenate([np.zeros(0), *logs])[order], 0.0)
        self.to = np.append(np.concatenate([np.zeros(0, np.int64), *targets])[order], 0)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each state goes on its symbol, and the log10 probability of that: failure arcs until an arc is there."""
        log, to, state = np.zeros(len(state)), np.zeros(len(state), np.int64), state.copy()
        todo = np.arange(len(state))
        while len(todo):
            s, w = state[todo], symbol[todo]
            key = s * self.width + w
            place = np.searchsorted(self.key, key)
            hit, root = self.key[place] == key, s == 0
            log[todo] += np.where(root, self.root_log[w], np.where(hit, self.log[place], self.weight[s]))
            to[todo] = np.where(root, self.root_to[w], self.to[place])
            state[todo] = self.fail[s]
            todo = todo[~(hit | root)]
        return to, log

    def walk(self, tokens: Tokens) -> np.ndarray:
        """log10 probability of each text, in one traversal from left to right that carries the state.

        The block is walked in LANES parts side by side. A part begins ORDER - 1 tokens early, from the empty context:
        a state is the longest context that training has of the last ORDER - 1 tokens, so it is the true one by then.
        """
        n = len(self.symbol)
        length, early = -(-n // LANES), ORDER - 1
        begin = np.arange(0, n, length)
        log, state = np.zeros(n), np.zeros(len(begin), np.int64)
        for j in range(-early, length):
            at = begin + j
            on = np.flatnonzero((at >= 0) & (at < n))
            at = at[on]
            to, got = self.step(state[on], self.symbol[at])
            first = ~tokens.scored[at]
            state[on] = np.where(first, self.start, to)
            if j >= 0:
                log[at] = np.where(first, 0.0, got)
        return np.bincount(tokens.text, log, tokens.table.num_rows)


_PARTS = ", ".join(f"k{k} binary, c{k} binary" for k in range(ORDER))
ASK = f"block long, bucket int, {_PARTS}"
TOLD = f"block long, bucket int, {', '.join(f'n{k} int, t{k} binary' for k in range(ORDER))}, tokens long, seen long, once long, twice long"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _ask(table: pa.Table, n: int) -> pa.Table:
    """A row for each bucket: the block's n-grams there, and their counts in training texts."""
    tokens = Tokens(table)
    rows: dict[int, dict] = {}
    for k in range(ORDER):
        value, count = tokens.grams[k][0], tokens.counts(k)
        for b, i, j in runs(bucket_of(value, n)):
            rows.setdefault(b, {}).update({f"k{k}": _cut_keys(value[i:j], KEY_BYTES[k]), f"c{k}": _narrow(count[i:j])})
    block = table.column("block")[0].as_py()
    names = [f"{x}{k}" for k in range(ORDER) for x in "kc"]
    return pa.table({
        "block": pa.array([block] * len(rows), pa.int64()),
        "bucket": pa.array(list(rows), pa.int32()),
        **{name: pa.array([r.get(name, b"") for r in rows.values()], pa.binary()) for name in names},
    })


def _answer(table: pa.Table) -> pa.Table:
    """The counts over all blocks of a bucket's n-grams, in the order in which each block sent them."""
    m = table.num_rows
    out: dict[str, pa.Array] = {"block": table.column("block"), "bucket": table.column("bucket")}
    for k in range(ORDER):
        keys = [_keys(x, KEY_BYTES[k]) for x in table.column(f"k{k}").to_pylist()]
        counts = [_wide(x, len(own)) for x, own in zip(table.column(f"c{k}").to_pylist(), keys, strict=True)]
        value, where = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts), len(value)).astype(np.int64)
        told = np.split(total[where], np.cumsum([len(x) for x in keys])[:-1])
        out[f"n{k}"], out[f"t{k}"] = pa.array([len(x) for x in told], pa.int32()), pa.array([_narrow(x) for x in told], pa.binary())
        if not k:
            for name, x in (("tokens", total.sum()), ("seen", (total > 0).sum()), ("once", (total == 1).sum()), ("twice", (total == 2).sum())):
                out[name] = pa.array([int(x)] + [0] * (m - 1), pa.int64())
    return pa.table(out)


def lm_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Learnt from the documents whose crc32 of the id as text isn't 0 modulo 10; a null id counts as 0, so such
    rows are scored and not learnt from. Null and empty texts are the end token alone. Repeated rows are learnt
    from and scored each. Without training documents an unseen token has probability 1 in both, an empty table gives
    no rows. Extra columns are ignored.

    ``score`` is the log10 probability of the text in the backoff automaton of word n-grams up to ORDER words;
    ``base_score`` is the unigram with 0.1 added. Every n-gram of the training texts counts, whatever the corpus's
    size. The model stays distributed and grows with the corpus: each block of some MB of documents sends its
    distinct n-grams to their buckets, which answer with the counts over the corpus, and walks the part of the
    automaton that its texts reach. Nothing is broadcast; an n-gram that all documents hold is one entry a block.
    Words are told apart by 64-bit hashes, longer n-grams within a bucket by 40 bits.
    """
    n = blocks_for(docs, BLOCK_BYTES)
    held = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(FOLDS)) == 0
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))
    blocks = in_blocks(own, BLOCK_BYTES, "lm_blocks")
    asked = blocks.groupBy("block").applyInArrow(lambda table: _ask(table, n), ASK)
    told = written(asked.groupBy("bucket").applyInArrow(_answer, TOLD), "lm-counts")
    names = ("tokens", "seen", "once", "twice")
    row = told.agg(*[F.sum(c).alias(c) for c in names]).first()
    facts = {c: int(row[c] or 0) for c in names}

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens, answers = Tokens(table), answers.sort_by("bucket")
        total = [np.concatenate([_wide(x, m) for x, m in zip(answers.column(f"t{k}").to_pylist(), answers.column(f"n{k}").to_pylist(), strict=True)]) for k in range(ORDER)]
        rows, on = table.num_rows, tokens.scored
        text, count = tokens.text[on], total[0][tokens.grams[0][2][on]]
        n_tokens = np.bincount(text, minlength=rows)
        base = np.bincount(text, np.log10(count + 0.1), rows) - n_tokens * np.log10(facts["tokens"] + 0.1 * (facts["seen"] + 1))
        return pa.table({
            "doc_id": table.column("doc_id"),
            "held_out": table.column("held_out"),
            "n_tokens": n_tokens,
            "n_known": np.bincount(text, count > 0, rows).astype(np.int64),
            "train_tokens": np.full(rows, facts["tokens"], np.int64),
            "base_score": base,
            "score": Automaton(tokens, total, facts).walk(tokens),
        })

    return blocks.groupBy("block").cogroup(told.drop(*names).groupBy("block")).applyInArrow(score, SCHEMA)
