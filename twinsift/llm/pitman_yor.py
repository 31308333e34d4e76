"""Language-model scores from a hierarchical Pitman-Yor model of word pairs (after Teh, 2006).

Every word that precedes others is a context with a restaurant of its own: each following token
is a customer at a table of its word. A table is a customer of the one parent restaurant that
all contexts share, and whose own base is uniform over the known words and one unknown. So

    p(w | u) = (customers - d * tables of w in u) / (t + customers of u)
             + (t + d * tables of u) / (t + customers of u) * p(w),

and likewise for p(w) from the parent's customers. How many tables the customers of a word take
is sampled by Gibbs moves: every customer leaves the table it has, which may close it, and is
seated again by the Chinese-restaurant process given all others, sweep after sweep. The formula is
linear in tables, so averaging them over the sweeps averages the predictive probabilities.

How it is spread: documents are packed into batches of tokens, written once. A batch asks, for
its distinct pairs, the bucket of each context; the buckets add up the counts of all batches,
seat their restaurants (taking the parent's distribution from their own tables, as in
approximate distributed Gibbs sampling), answer the batches and send tables to the buckets of
the words, which answer with the parent's customers. All of a batch and all of a bucket meet
in packed arrays, counts are added up before they travel, and neither depends on a third of
all tokens being one pair. A context with very many pairs is hot: its words are dealt to slices,
each in a bucket of its own, which know the context's totals. Words are known by 48-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.toxicity import held_out
from twinsift.staging import ship_package, stage

#: Discount and strength of every restaurant.
DISCOUNT, STRENGTH = 0.8, 1.0

#: Sweeps of the sampler, the first of them not averaged.
SWEEPS = 5

#: Rounds in which the customers of a pair move; customers from which a pair moves in blocks, and their number.
ROUNDS, HEAVY, BLOCKS = 256, 16_384, 64

#: Tokens of a batch, and pairs that a bucket has on average.
BATCH, BUCKET = 3_000_000, 1_200_000

#: Texts that are split into words at once.
TEXTS = 2048

#: Pairs, counted in every batch that has them, from which a context is hot, and those of a slice of it.
HOT_PAIRS, SLICE = 300_000, 100_000

_MASK = (1 << 48) - 1

_FIELDS = [("batch", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("length", pa.list_(pa.int32())), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary()), ("n", pa.int64())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "batch bigint, kind int, bucket bigint, doc_id array<bigint>, held array<boolean>, length array<int>, x binary, y binary, z binary, n bigint"

# Kinds of rows.
TOKENS, ASK_CONTEXT, ASK_WORD, CONTEXTS, TABLES, WORDS, TOTALS, HOT_TABLES = range(8)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def pack48(a: np.ndarray) -> bytes:
    """Six bytes a value, equal places together."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpack48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(6, -1).T
    return out.reshape(-1).view("<u8")


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    x = words.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


class Hot(NamedTuple):
    """Hot contexts by rising hash: slices, and over all slices customers, ``spread`` and tables.

    The spread of pairs, their customers to the power of the discount, grows as their tables do: a
    slice takes its context's tables to be its own in the proportion of the spreads.
    """

    names: np.ndarray = np.zeros(0, np.uint64)
    slices: np.ndarray = np.zeros(0, np.int64)
    customers: np.ndarray = np.zeros(0)
    spread: np.ndarray = np.zeros(0)
    tables: np.ndarray = np.zeros(0)

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of ``words`` among the hot contexts, -1 for others."""
        if not len(self.names):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.names, words), len(self.names) - 1)
        return np.where(self.names[at] == words, at, -1)

    def add(self, names: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of ``values`` for each hot context."""
        return np.bincount(self.find(names), values, minlength=len(self.names))


class _Words:
    """The hashes of words, of one or of many. None is 0."""

    def __getitem__(self, word: bytes) -> int:
        return int(self.all([word])[0])

    def all(self, words: list[bytes] | np.ndarray) -> np.ndarray:
        return np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) & np.uint64(_MASK), np.uint64(1))


def _split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the first of them the end, each token's place among them, and the tokens of each text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text, b"").view(pa.string())))
    found = lists.flatten()
    kept = pc.not_equal(pc.binary_length(found), 0)  # white space around a text leaves empty words
    whose = pc.list_parent_indices(lists).filter(kept).to_numpy()
    coded = found.filter(kept).dictionary_encode()
    length = np.bincount(whose, minlength=len(text)) + 1
    place = np.zeros(int(length.sum()), np.int32)
    place[np.arange(len(whose)) + whose] = coded.indices.to_numpy() + 1
    kinds = _Words().all(coded.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False))
    return np.r_[np.zeros(1, np.uint64), kinds], place, length


def _tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches: documents, the vocabulary by falling frequency, and each token's place in it.
    The end of a text is the word 0."""
    ids, held, length, kinds, places, n, k = [], [], [], [], [], 0, 0

    def flush() -> pa.RecordBatch:
        vocab, number = np.unique(np.concatenate(kinds), return_inverse=True)
        first = np.cumsum([0, *map(len, kinds)])
        place = np.concatenate([number[at + own] for at, own in zip(first, places)])
        count = np.bincount(place, minlength=len(vocab))
        known = np.flatnonzero(count)  # a text may be cut from the batch that its words came with
        order = known[np.argsort(-count[known], kind="stable")]
        rank = np.empty(len(vocab), np.uint32)
        rank[order] = np.arange(len(order))
        packed = zlib.compress(rank[place].view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
        name = (TaskContext.get().partitionId() << 32) | k
        return _rows([dict(batch=name, kind=TOKENS, bucket=-1, doc_id=ids, held=held, length=length, x=pack48(vocab[order]), y=packed, n=n)])

    for batch in batches:
        for low in range(0, batch.num_rows, TEXTS):
            part = batch.slice(low, TEXTS)
            own, place, sizes = _split(part.column("text"))
            ends, keys, out, at = np.cumsum(sizes), part.column("doc_id").to_pylist(), part.column("held").to_pylist(), 0
            while at < len(sizes):
                begin = int(ends[at - 1]) if at else 0
                upto = min(int(np.searchsorted(ends, begin + BATCH - n)) + 1, len(sizes))
                ids += keys[at:upto]
                held += out[at:upto]
                length += sizes[at:upto].tolist()
                kinds.append(own)
                places.append(place[begin : ends[upto - 1]])
                n += int(ends[upto - 1]) - begin
                at = upto
                if n >= BATCH:
                    yield flush()
                    ids, held, length, kinds, places, n, k = [], [], [], [], [], 0, k + 1
    if ids:
        yield flush()


class Batch:
    """A batch's arrays: ``word`` and ``before`` per token as places in ``vocab``, and its distinct pairs."""

    def __init__(self, row: dict, buckets: int, hot: Hot = Hot()):
        self.vocab = unpack48(row["x"])
        self.word = np.frombuffer(zlib.decompress(row["y"]), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)
        self.length = np.array(row["length"], np.int64)
        self.held = np.array(row["held"], bool)
        self.start = np.cumsum(self.length) - self.length
        self.before = np.r_[0, self.word[:-1]]
        self.before[self.start] = np.flatnonzero(self.vocab == 0)[0]  # a text begins after an end
        size = len(self.vocab)
        self.by = _bucket(self.vocab, buckets)
        self.word_order = np.argsort(self.by, kind="stable")
        self.word_cuts = np.searchsorted(self.by[self.word_order], np.arange(buckets + 1))
        self.buckets = buckets
        self.hot, self.hot_at = hot, hot.find(self.vocab)

    def pair_up(self, hot_only: bool = False) -> None:
        """The distinct pairs, or those of hot contexts, and ``pair``: the place of each of the ``tokens`` among them."""
        size = len(self.vocab)
        self.tokens = np.flatnonzero(self.hot_at[self.before] >= 0) if hot_only else slice(None)
        pairs, self.pair = np.unique(self.before[self.tokens] * size + self.word[self.tokens], return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.context, self.follows = (pairs // size).astype(np.int32), (pairs % size).astype(np.int32)
        del self.before, pairs
        by = self.by[self.context]
        self.in_hot = self.hot_at[self.context] >= 0
        if self.in_hot.any():
            context, word = self.context[self.in_hot], self.vocab[self.follows[self.in_hot]]
            part = (word * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)) % self.hot.slices[self.hot_at[context]].astype(np.uint64)
            by[self.in_hot] = _bucket(self.vocab[context] + (part << np.uint64(48)) + part, self.buckets)
        self.pair_order = np.argsort(by, kind="stable").astype(np.int32)
        self.pair_cuts = np.searchsorted(by[self.pair_order], np.arange(self.buckets + 1))

    def trained(self) -> np.ndarray:
        return np.repeat(~self.held, self.length)

    def many(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Contexts of at least so many distinct pairs, and their pairs."""
        size = len(self.vocab)
        tokens = np.flatnonzero((np.bincount(self.before, minlength=size) >= least)[self.before])  # a context has no more pairs than tokens
        pairs = np.bincount(np.unique(self.before[tokens] * size + self.word[tokens]) // size, minlength=size)
        at = np.flatnonzero(pairs >= least)
        return self.vocab[at], pairs[at]

    def ask_contexts(self, name: int, hot_only: bool = False) -> list[dict]:
        self.pair_up(hot_only)
        pairs = np.bincount(self.pair[self.trained()[self.tokens]], minlength=len(self.context)).astype(np.int32)
        out = []
        for b in range(self.buckets):
            at = self.pair_order[self.pair_cuts[b] : self.pair_cuts[b + 1]]
            if len(at):
                first = np.flatnonzero(np.r_[True, np.diff(self.context[at]) != 0])
                runs = np.diff(np.r_[first, len(at)]).astype(np.int32)
                out.append(dict(batch=name, kind=ASK_CONTEXT, bucket=b, x=pack48(self.vocab[self.context[at[first]]]) + _squeeze(runs), y=pack48(self.vocab[self.follows[at]]), z=_squeeze(pairs[at]), n=len(first)))
        return out

    def ask_words(self, name: int) -> list[dict]:
        words = np.bincount(self.word[self.trained()], minlength=len(self.vocab)).astype(np.int32)
        out = []
        for b in range(self.buckets):
            at = self.word_order[self.word_cuts[b] : self.word_cuts[b + 1]]
            if len(at):
                out.append(dict(batch=name, kind=ASK_WORD, bucket=b, x=pack48(self.vocab[at]), y=_squeeze(words[at]), n=len(at)))
        return out


def _squeeze(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _array(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def _ask(buckets: int, kind: int, hot: Hot = Hot(), hot_only: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Batch(row, buckets, hot)
                yield _rows(own.ask_contexts(row["batch"], hot_only) if kind == ASK_CONTEXT else own.ask_words(row["batch"]))

    return run


def _many(buckets: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names, pairs = Batch(row, buckets).many(least)
                yield pa.record_batch({"context": names.astype(np.int64), "pairs": pairs.astype(np.int64)})

    return run


def tables(customers: np.ndarray, pull: np.ndarray, rng: np.random.Generator, d: float = DISCOUNT) -> np.ndarray:
    """Tables that the customers of each word take, all seated one after the other.

    ``pull`` is (strength + d * tables of the restaurant) * parent's probability of the word: a
    customer opens a table with the chance pull / (pull + seated - d * tables of the word). Of
    those after the first ``ROUNDS`` a block of 1 / ``ROUNDS`` of the seated is drawn at once.
    """
    t = np.minimum(customers, 1).astype(float)
    seated, at = 1, np.flatnonzero(customers > 1)
    while len(at):
        block = max(1, seated // ROUNDS)
        chance = pull[at] / (pull[at] + seated - d * t[at])
        t[at] += rng.binomial(np.minimum(customers[at] - seated, block).astype(np.int64), chance)
        seated += block
        at = at[customers[at] > seated]
    return t


class Seating:
    """Restaurants whose customers leave their tables and are seated again, sweep after sweep.

    A customer who leaves may close a table, which then counts neither in the restaurant nor as a
    customer of the parent; the next seat is chosen given all others: a table by its customers
    less the discount, or a new one by the parent's probability of the word. The parent, whose
    customers are the tables here, is seated anew after each sweep. In a round one customer of
    each pair moves, and of pairs of more than ``ROUNDS`` customers 1 / ``ROUNDS`` of them. Pairs
    of more than ``HEAVY`` customers are kept as sizes of tables and move in blocks.
    """

    def __init__(self, customers: np.ndarray, context: np.ndarray, word: np.ndarray, rng: np.random.Generator, scale: np.ndarray | float = 1.0):
        self.c, self.context, self.word, self.rng = customers.astype(np.int64), context, word, rng
        self.here = np.zeros(int(context.max(initial=-1)) + 1)
        self.scale = np.broadcast_to(np.asarray(scale, float), self.here.shape)
        self.of_word = np.zeros(int(word.max(initial=-1)) + 1)
        self.parent, self.total = np.zeros(len(self.of_word)), 0.0  # the parent's tables, and its customers
        self.t, self.seated = np.zeros(len(self.c), np.int64), np.zeros(len(self.c), np.int64)
        light = np.where(self.c <= HEAVY, self.c, 0)
        self.first = np.cumsum(light) - light
        self.pair = np.repeat(np.arange(len(light), dtype=np.int32), light)
        self.rank = (np.arange(len(self.pair)) - self.first[self.pair]).astype(np.int32)
        self.table, self.size = np.full(len(self.pair), -1, np.int32), np.zeros(len(self.pair), np.int32)
        self.free = np.arange(len(self.pair), dtype=np.int32)  # of each pair as many as it has customers less tables
        self.heavy = {int(p): np.zeros(0, np.int64) for p in np.flatnonzero(self.c > HEAVY)}

    def pull(self, p: np.ndarray, closed: np.ndarray | int = 0) -> np.ndarray:
        """(strength + d * tables of the context) * parent's probability of the word, of pairs ``p``
        without the tables they have just ``closed``; what moves in the same round still counts."""
        context, word = self.context[p], self.word[p]
        mine, here = self.of_word[word] - closed, self.here[context] - closed
        over = mine - DISCOUNT * np.minimum(np.maximum(self.parent[word], 1), mine)
        elsewhere = (self.scale[context] - 1) * here  # tables in other slices of the context
        return (STRENGTH + DISCOUNT * here * self.scale[context]) * (over + self.base) / (STRENGTH + self.total - closed + elsewhere)

    def _count(self, p: np.ndarray, by: int) -> None:
        # ``at`` is fast only if the number has the type of the array.
        np.add.at(self.here, self.context[p], float(by))
        np.add.at(self.of_word, self.word[p], float(by))
        self.total += by * len(p)

    def sweep(self) -> None:
        first = not self.seated.any()
        self.base = (STRENGTH + DISCOUNT * self.parent.sum()) / (len(self.of_word) + 1)  # the parent's own base for any word
        if first:
            late = ROUNDS + (ROUNDS * np.log(np.maximum(self.rank, 1) / ROUNDS)).astype(np.int32)
            order, turn = np.arange(len(self.pair)), np.where(self.rank < ROUNDS, self.rank, late)
        else:  # a single customer has no other table to go to
            order = np.flatnonzero(self.c[self.pair] > 1)
            turn = self.rank[order] % ROUNDS
        order = order[np.argsort(turn.astype(np.int16), kind="stable")].astype(np.int32)  # 16 bits are sorted by radix; turns are below 2,000
        cuts = np.cumsum(np.bincount(turn)) if len(turn) else []
        del turn
        for low, high in zip([0, *cuts[:-1]], cuts):
            if high > low:
                self._move(order[low:high], first)
        for p in self.heavy:
            left = int(self.c[p])
            while left:
                done = self.c[p] - left
                block = int(min(left, max(1, done // BLOCKS if first else -(-self.c[p] // BLOCKS))))
                self._move_block(p, block, first)
                left -= block
        self.parent = tables(self.of_word, np.full(len(self.of_word), (STRENGTH + DISCOUNT * np.maximum(self.parent, 1).sum()) / (len(self.of_word) + 1)), self.rng)

    def _move(self, i: np.ndarray, first: bool) -> None:
        """Seat the customers ``i``, in order of their pairs, who leave their tables but in the ``first`` sweep."""
        p, rng = self.pair[i], self.rng
        before, q = self.t[p], np.zeros(0, np.int32)
        if not first:
            old = self.table[i]
            np.subtract.at(self.size, old, np.int32(1))
            self.table[i] = -1
            np.subtract.at(self.seated, p, np.int64(1))
            closed = np.unique(old[self.size[old] == 0])
            q = self.pair[closed]
            self.free[self.first[q] + self.c[q] - self.t[q] + _places(q)] = closed
            np.subtract.at(self.t, q, np.int64(1))
        pull, n = self.pull(p, before - self.t[p]), self.seated[p]
        self._count(q, -1)
        new = rng.random(len(i)) * (pull + n - DISCOUNT * self.t[p]) < pull
        seat = np.empty(len(i), np.int32)
        at = np.flatnonzero(~new)
        among = n[at] if first else self.c[p[at]]  # in the first sweep the seated are those of lower ranks
        low = self.first[p[at]]
        while len(at):  # the table of any customer, refused by the share of the discount in it
            table = self.table[low + (rng.random(len(at)) * among).astype(np.int64)]
            size = self.size[table]
            taken = (table >= 0) & (rng.random(len(at)) * size < size - DISCOUNT)
            seat[at[taken]] = table[taken]
            left = np.flatnonzero(~taken)
            at, low, among = at[left], low[left], among[left]
        q = p[new]
        seat[new] = self.free[self.first[q] + self.c[q] - self.t[q] - 1 - _places(q)]
        np.add.at(self.size, seat, np.int32(1))
        self.table[i] = seat
        np.add.at(self.seated, p, np.int64(1))
        np.add.at(self.t, q, np.int64(1))
        self._count(q, 1)

    def _move_block(self, p: int, block: int, first: bool) -> None:
        sizes, rng, own = self.heavy[p], self.rng, np.array([p])
        if not first:
            sizes = sizes - rng.multivariate_hypergeometric(sizes, block, method="marginals")
            sizes = sizes[sizes > 0]
            self._count(np.repeat(own, self.t[p] - len(sizes)), -1)
        else:
            self.seated[p] += block
        pull, weight = self.pull(own)[0], sizes - DISCOUNT
        new = int(rng.binomial(block, pull / (pull + weight.sum())))
        if block > new:
            sizes = sizes + rng.multinomial(block - new, weight / weight.sum())
        self.heavy[p] = np.r_[sizes, np.ones(new, np.int64)]
        self.t[p] = len(self.heavy[p])
        self._count(np.repeat(own, new), 1)


def _places(q: np.ndarray) -> np.ndarray:
    """For each of some sorted values how many equal ones precede it."""
    return np.arange(len(q)) - np.searchsorted(q, q)


def seat(customers: np.ndarray, context: np.ndarray, word: np.ndarray, rng: np.random.Generator, scale: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Average tables per pair and per context, by Gibbs sweeps; contexts and words are numbers from 0.

    ``scale`` is how many times the tables of its pairs here a context has in all.
    """
    seating, pairs = Seating(customers, context, word, rng, scale), np.zeros(len(customers))
    for sweep in range(SWEEPS):
        seating.sweep()
        if sweep:
            pairs += seating.t / (SWEEPS - 1)
    return pairs, np.bincount(context, pairs, minlength=len(seating.here))


class Asked:
    """What batches ask of a bucket, with equal pairs added up: ``pair`` and ``context`` are the places
    of what was asked among the distinct ``pairs`` and ``names``."""

    def __init__(self, table: pa.Table):
        self.rows = table.sort_by("batch").to_pylist()
        contexts, runs, words, counts = [], [], [], []
        for r in self.rows:
            contexts.append(unpack48(r["x"][: 6 * r["n"]]))
            runs.append(_array(r["x"][6 * r["n"] :], np.int32))
            words.append(unpack48(r["y"]))
            counts.append(_array(r["z"], np.int32))
        self.n_contexts, self.n_words = [len(x) for x in contexts], [len(w) for w in words]
        self.names, self.context = np.unique(np.concatenate(contexts), return_inverse=True)
        self.kinds, word = np.unique(np.concatenate(words), return_inverse=True)
        of_pair = np.repeat(self.context, np.concatenate(runs))
        self.pairs, self.pair = np.unique(of_pair * len(self.kinds) + word, return_inverse=True)
        self.customers = np.bincount(self.pair, np.concatenate(counts))
        self.seen = np.flatnonzero(self.customers > 0)
        self.own, self.follows = self.pairs[self.seen] // len(self.kinds), self.pairs[self.seen] % len(self.kinds)

    def per_context(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.own, values, minlength=len(self.names))


def _hot_totals(table: pa.Table) -> pa.Table:
    a = Asked(table)
    c = a.customers[a.seen]
    return pa.table({"context": a.names.astype(np.int64), "customers": a.per_context(c), "spread": a.per_context(c**DISCOUNT)})


def _seat(buckets: int, hot: Hot = Hot()):
    def run(table: pa.Table) -> pa.Table:
        a = Asked(table)
        asked, names, kinds, pairs, seen, own, follows, customers = a.rows, a.names, a.kinds, a.pairs, a.seen, a.own, a.follows, a.customers
        hot_at = hot.find(names)
        is_hot = np.flatnonzero(hot_at >= 0)
        all_customers, scale = a.per_context(customers[seen]), np.ones(len(names))
        if len(is_hot):
            here = a.per_context(customers[seen] ** DISCOUNT)[is_hot]
            scale[is_hot] = np.where(here > 0, hot.spread[hot_at[is_hot]] / np.maximum(here, 1), 1)
            all_customers[is_hot] = hot.customers[hot_at[is_hot]]
        rng = np.random.default_rng(asked[0]["bucket"])
        t, _ = seat(customers[seen], own, follows, rng, scale[: int(own.max(initial=-1)) + 1])
        over = np.zeros(len(pairs), np.float32)
        over[seen] = customers[seen] - DISCOUNT * t
        # Of hot contexts the tables are added up over all slices later.
        back = (STRENGTH + DISCOUNT * a.per_context(t)) / (STRENGTH + all_customers)
        share = np.stack([1 / (STRENGTH + all_customers), back], axis=1).astype(np.float32)
        out, p, c = [], 0, 0
        for r, w, x in zip(asked, a.n_words, a.n_contexts):
            out.append(dict(batch=r["batch"], kind=CONTEXTS, bucket=r["bucket"], x=_squeeze(over[a.pair[p : p + w]]), y=_squeeze(share[a.context[c : c + x]])))
            p, c = p + w, c + x
        if len(is_hot):
            out.append(dict(batch=r["bucket"], kind=HOT_TABLES, bucket=r["bucket"], x=pack48(names[is_hot]), y=a.per_context(t)[is_hot].tobytes()))
        sums = np.bincount(follows, t, minlength=len(kinds))
        sent = np.flatnonzero(sums > 0)
        to = _bucket(kinds[sent], buckets)
        for b in np.unique(to):
            at = sent[to == b]
            out.append(dict(batch=r["bucket"], kind=TABLES, bucket=int(b), x=pack48(kinds[at]), y=_squeeze(sums[at].astype(np.float32)), n=len(at)))
        return pa.Table.from_pylist(out, schema=_SCHEMA)

    return run


def _words(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("kind", "ascending"), ("batch", "ascending")]).to_pylist()
        asked = [r for r in rows if r["kind"] == ASK_WORD]
        sent = [r for r in rows if r["kind"] == TABLES]
        wanted = [unpack48(r["x"]) for r in asked]
        kinds, word = np.unique(np.concatenate(wanted), return_inverse=True)
        count = np.bincount(word, np.concatenate([_array(r["y"], np.int32) for r in asked])).astype(np.int64)
        customers = np.zeros(len(kinds))
        for r in sent:  # every word with tables is a word of some batch
            np.add.at(customers, np.searchsorted(kinds, unpack48(r["x"])), _array(r["y"], np.float32).astype(float))
        known = int((count > 0).sum())
        rng = np.random.default_rng(rows[0]["bucket"] + (1 << 20))
        # The parent's base is uniform; its number of tables is hardly more than one for each word.
        pull = np.full(len(kinds), (STRENGTH + DISCOUNT * known * buckets) / (known * buckets + 1))
        t = tables(np.ceil(customers - 1e-9), pull, rng)
        over = (customers - DISCOUNT * np.minimum(t, customers)).astype(np.float32)
        out, p = [], 0
        for r, w in zip(asked, wanted):
            at = word[p : p + len(w)]
            out.append(dict(batch=r["batch"], kind=WORDS, bucket=r["bucket"], x=_squeeze(over[at]), y=_squeeze(count[at])))
            p += len(w)
        totals = np.array([count.sum(), known, customers.sum(), np.minimum(t, customers).sum()])
        out.append(dict(batch=-1, kind=TOTALS, bucket=r["bucket"], x=totals.tobytes()))
        return pa.Table.from_pylist(out, schema=_SCHEMA)

    return run


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _score(buckets: int, hot: Hot, n: float, v: float, customers: float, n_tables: float):
    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("kind", "ascending"), ("bucket", "ascending")]).to_pylist()
        own = rows[0]
        b = Batch(own, buckets, hot)
        b.pair_up()
        over, count = np.zeros(len(b.vocab)), np.zeros(len(b.vocab), np.int64)
        part, share = np.zeros(len(b.context)), np.ones((len(b.vocab), 2))
        for r in rows[1:]:
            if r["kind"] == CONTEXTS:
                at = b.pair_order[b.pair_cuts[r["bucket"]] : b.pair_cuts[r["bucket"] + 1]]
                part[at] = _array(r["x"], np.float32)
                first = np.flatnonzero(np.r_[True, np.diff(b.context[at]) != 0])
                share[b.context[at[first]]] = _array(r["y"], np.float32).reshape(-1, 2)
            else:
                at = b.word_order[b.word_cuts[r["bucket"]] : b.word_cuts[r["bucket"] + 1]]
                over[at], count[at] = _array(r["x"], np.float32), _array(r["y"], np.int64)
        is_hot = b.hot_at >= 0
        if is_hot.any():
            at = b.hot_at[is_hot]
            share[is_hot] = np.stack([np.ones(len(at)), STRENGTH + DISCOUNT * hot.tables[at]], axis=1) / (STRENGTH + hot.customers[at])[:, None]
        parent = (over + (STRENGTH + DISCOUNT * n_tables) / (v + 1)) / (STRENGTH + customers)
        p = part * share[b.context, 0] + share[b.context, 1] * parent[b.follows]
        base = np.log10((count + 0.5) / (n + 0.5 * (v + 1)))
        sums = [np.add.reduceat(x[at], b.start) for x, at in (((count > 0).astype(np.int64), b.word), (base, b.word), (np.log10(p), b.pair))]
        return pa.table({"doc_id": pa.array(own["doc_id"], pa.int64()), "held_out": b.held, "n_tokens": b.length, "n_known": sums[0], "train_tokens": np.full(len(b.length), int(n)), "base_score": sums[1], "score": sums[2]})

    return run


def hot_contexts(packed: DataFrame, n: int, buckets: int, hot_pairs: int = HOT_PAIRS, slice_pairs: int = SLICE) -> Hot:
    """The contexts of at least ``hot_pairs`` pairs over ``n`` batches, cut into slices, with their totals.

    Batches leave out contexts with so few pairs that all of them make half of ``hot_pairs`` at
    most. The list has 2 * pairs / ``hot_pairs`` contexts at most.
    """
    least = max(1, hot_pairs // (2 * max(n, 1)))
    many = packed.mapInArrow(_many(buckets, least), "context bigint, pairs bigint").groupBy("context").agg(F.sum("pairs").alias("pairs"))
    found = sorted((r.context, r.pairs) for r in many.where(F.col("pairs") >= hot_pairs / 2).collect())
    if not found:
        return Hot()
    names, pairs = (np.array(x, np.int64) for x in zip(*found))
    hot = Hot(names.astype(np.uint64), -(-(pairs + hot_pairs // 2) // slice_pairs))
    asked = packed.mapInArrow(_ask(buckets, ASK_CONTEXT, hot, True), _DDL)
    parts = asked.groupBy("bucket").applyInArrow(_hot_totals, "context bigint, customers double, spread double")
    totals = parts.groupBy("context").agg(F.sum("customers").alias("customers"), F.sum("spread").alias("spread")).orderBy("context").collect()
    return hot._replace(customers=np.array([r.customers for r in totals]), spread=np.array([r.spread for r in totals]))


def scores(documents: DataFrame, hot_pairs: int = HOT_PAIRS, slice_pairs: int = SLICE) -> DataFrame:
    """Scores of ``documents(doc_id, text, held)`` by a model of those that are not held out.

    ``base_score`` is the unigram score with half a count added, ``score`` the model's; both are
    sums of log10 over the words, A-Z in lower case, and one end. Null and empty texts are an end.
    Without training rows the model is uniform. Equal rows stay; an empty table gives no rows.
    """
    spark = documents.sparkSession
    ship_package(spark)
    read = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce("held", F.lit(False)).alias("held"))
    packed = stage(read.mapInArrow(_tokenize, _DDL), "token-batches")
    total, n = packed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    buckets = max(64, -(-total // BUCKET))
    hot = hot_contexts(packed, n, buckets, hot_pairs, slice_pairs)
    asked = packed.mapInArrow(_ask(buckets, ASK_CONTEXT, hot), _DDL)
    seated = stage(asked.groupBy("bucket").applyInArrow(_seat(buckets, hot), _DDL), "seated")
    if len(hot.names):
        n_tables = np.zeros(len(hot.names))
        for r in seated.where(F.col("kind") == HOT_TABLES).select("x", "y").toLocalIterator():  # a number a slice
            n_tables += hot.add(unpack48(r.x), np.frombuffer(r.y, np.float64))
        hot = hot._replace(tables=n_tables)
    to_words = packed.mapInArrow(_ask(buckets, ASK_WORD), _DDL).unionByName(seated.where(F.col("kind") == TABLES))
    parents = stage(to_words.groupBy("bucket").applyInArrow(_words(buckets), _DDL), "parents")
    totals = np.zeros(4)
    for r in parents.where(F.col("kind") == TOTALS).select("x").toLocalIterator():  # four numbers a bucket
        totals += np.frombuffer(r.x, np.float64)
    answers = packed.unionByName(seated.where(F.col("kind") == CONTEXTS)).unionByName(parents.where(F.col("kind") == WORDS))
    return answers.groupBy("batch").applyInArrow(_score(buckets, hot, *totals.tolist()), _SCORES)


def scored_documents(documents: DataFrame) -> DataFrame:
    """Scores of all documents; every fifth by crc32 of its id is held out."""
    return scores(documents.select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("held")))
