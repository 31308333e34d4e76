"""Byte-level BPE encoding by speculation and verification, and decoding.

Exact BPE merges the pair of lowest rank again and again. Here the words of a batch that have
not been seen are first cut greedily into the longest tokens of the vocabulary. A sequence of
tokens is what exact merging gives if and only if every two neighbours are compatible, that is
if merging their joint bytes gives the same two tokens; this is decided without merging by
taking the two apart towards their common border, the later merge first, and looking for an
earlier merge across it. All distinct neighbour pairs of a batch are tested at once with array
operations. Only words with an incompatible pair are merged exactly.

The tokenizer's file is read by the driver and broadcast: its size doesn't grow with the data.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.staging import ship_package

#: Fixed value: how text is cut into words before merging, as byte-level BPE defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words a task remembers.
REMEMBERED = 200_000

#: Words of more bytes than this are merged with a heap.
SHORT = 200

#: Words that are looked up and gathered at once.
CHUNK = 150_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_by_char() -> dict[str, int]:
    """The character that stands for each byte in vocabulary files: printable Latin-1 characters
    for themselves, the other bytes in order for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the tests on them."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE")
        to_byte = _bytes_by_char()
        raw = lambda token: bytes(to_byte[c] for c in token)
        self.ids = {raw(token): i for token, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.size = max([*self.ids.values(), *self.special.values()]) + 1
        tokens = [b""] * self.size
        for token, i in self.ids.items():
            tokens[i] = token
        for token, i in self.special.items():
            tokens[i] = token.encode()
        self.tokens = tokens
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)
        parts = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        a = np.array([self.ids[raw(x)] for x, _ in parts], np.int64)
        b = np.array([self.ids[raw(y)] for _, y in parts], np.int64)
        ab = np.array([self.ids[raw(x + y)] for x, y in parts], np.int64)
        if (np.diff(ab) <= 0).any() or (a >= ab).any() or (b >= ab).any():
            raise ValueError("ids of merged tokens don't rise with the order of merges")
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        self.left[ab], self.right[ab] = a, b
        self.ranks = dict(zip((a << 32 | b).tolist(), ab.tolist()))
        order = np.argsort(a << 32 | b)
        self.pair_keys, self.pair_ids = (a << 32 | b)[order], ab[order]
        whole = np.zeros(self.size, bool)
        whole[[i for i in self.ids.values()]] = True
        self.byte_ids = np.array([self.ids[bytes([i])] for i in range(256)], np.int64)
        sound = self.compatible(a, b, ab)
        for x, y, z, ok in zip(a.tolist(), b.tolist(), ab.tolist(), sound.tolist()):
            whole[z] = ok and whole[x] and whole[y]
        self.proposed = {t: i for t, i in self.ids.items() if whole[i]}
        self.longest: dict[bytes, int] = {}
        for t in self.proposed:
            self.longest[t[:3]] = max(self.longest.get(t[:3], 1), len(t))

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that two tokens merge to, else -1."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], -1)

    def compatible(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether exact merging leaves a border between each two tokens.

        ``before`` asks about merges earlier than a given one only.
        """
        out = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), self.size + 1) if before is None else before.astype(np.int64)
        while len(at):
            over = self.merged(x, y)
            crossed = (over >= 0) & (over < limit)
            out[at[crossed]] = False
            # The later of the two was merged last: before that, its part at the border stood there.
            # Tokens of one byte can't be taken apart; then the other one is.
            rx, ly = self.right[x], self.left[y]
            whole_x, whole_y = rx == x, ly == y
            first = ((x > y) & ~whole_x) | whole_y
            done = whole_x & whole_y
            limit = np.where(first, x, y + 1)
            x, y = np.where(first, rx, x), np.where(first, y, ly)
            go = ~crossed & ~done
            at, x, y, limit = at[go], x[go], y[go], limit[go]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy cut into the longest tokens."""
        out, i, n, get = [], 0, len(word), self.proposed.get
        while i < n:
            for end in range(min(n, i + self.longest.get(word[i : i + 3], 2)), i, -1):
                token = get(word[i:end])
                if token is not None:
                    break
            out.append(token)
            i = end
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging of one word."""
        return self.merge_all([word])[0].tolist()

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: flat ids, and tokens per word.

        Each round merges, in every word, the pair of its lowest rank wherever it stands (a merge
        makes no pair of lower rank). Words that are done leave; very long ones use a heap.
        """
        out: dict[int, np.ndarray] = {}
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = np.array(self._merge_long([self.ids[w[j : j + 1]] for j in range(len(w))]), np.int64)
        short = [i for i in range(len(words)) if i not in out]
        never = self.size
        ids = self.byte_ids[np.frombuffer(b"".join(words[i] for i in short), np.uint8)]
        word = np.repeat(np.arange(len(short)), [len(words[i]) for i in short])
        done_ids, done_word = [], []
        rank = self._ranks(ids, word, np.arange(len(ids)))
        while len(ids):
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(ids)]))
            ended = best == never
            if ended.any():
                done_ids.append(ids[ended])
                done_word.append(word[ended])
                ids, word, rank, best = ids[~ended], word[~ended], rank[~ended], best[~ended]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == best)
            # In a row of equal neighbours, as in "aaa", every second pair is merged.
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1])
            offset = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[offset % 2 == 0]
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            ids, word, rank = ids[keep], word[keep], rank[keep]
            changed = np.unique(np.r_[new, np.maximum(new - 1, 0)])
            rank[changed] = self._ranks(ids, word, changed)
        flat = np.concatenate(done_ids) if done_ids else np.array([], np.int64)
        of = np.concatenate(done_word) if done_word else np.array([], np.int64)
        order = np.argsort(of, kind="stable")
        count = np.zeros(len(words), np.int64)
        count[short] = np.bincount(of, minlength=len(short)) if len(short) else 0
        for i, found in out.items():
            count[i] = len(found)
        if not out:
            return flat[order], count
        pieces = np.split(flat[order], np.cumsum(count[short])[:-1]) if short else []
        every = out | dict(zip(short, pieces))
        return np.concatenate([every[i] for i in range(len(words))]), count

    def _ranks(self, ids: np.ndarray, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What the tokens at these places merge to with the next one of their word, else a value beyond all."""
        after = np.minimum(at + 1, len(ids) - 1)
        over = self.merged(ids[at], ids[after])
        return np.where((over >= 0) & (word[at] == word[after]) & (after > at), over, self.size)

    def _merge_long(self, ids: list[int]) -> list[int]:
        after = [*range(1, len(ids)), -1]
        before = [*range(-1, len(ids) - 1)]
        heap = [(t, i, x, y) for i, (x, y) in enumerate(zip(ids, ids[1:])) if (t := self.ranks.get(x << 32 | y)) is not None]
        heapq.heapify(heap)
        while heap:
            token, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j < 0 or ids[j] != y:
                continue
            ids[i], ids[j] = token, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (t := self.ranks.get(ids[p] << 32 | ids[q])) is not None:
                    heapq.heappush(heap, (t, p, ids[p], ids[q]))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of many words: flat ids, tokens per word, and how many words were merged exactly."""
        cut = [self.propose(w) for w in words]
        count = np.array([len(c) for c in cut], np.int64)
        flat = np.array([t for c in cut for t in c], np.int64)
        of = np.repeat(np.arange(len(words)), count)
        inner = np.flatnonzero(of[1:] == of[:-1]) if len(of) > 1 else np.array([], int)
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.unique(of[inner[~fits[back]]])
        if not len(failed):
            return flat, count, 0
        merged, n = self.merge_all([words[i] for i in failed.tolist()])
        total = count.copy()
        total[failed] = n
        out = np.empty(total.sum(), np.int64)
        start, good = np.cumsum(total) - total, np.ones(len(words), bool)
        good[failed] = False
        out[spread(start[good], total[good])] = flat[good[of]]
        out[spread(start[failed], n)] = merged
        return out, total, len(failed)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.joined[spread(self.starts[ids], self.lengths[ids])].tobytes()


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices of runs that begin at ``starts`` and have ``counts`` members, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


@lru_cache(maxsize=2)
def vocabulary(content: bytes) -> Vocabulary:
    return Vocabulary(json.loads(content))


class _Memory(dict):
    """Numbers of words; new ones are listed until they are encoded."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.n = 0
        self.flat, self.count, self.start = np.array([], np.int64), np.array([], np.int64), np.array([], np.int64)

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = self.n
        self.n += 1
        return self.n - 1

    def learn(self) -> None:
        special = self.vocab.special
        plain = [w.encode() if w not in special else b"" for w in self.new]
        flat, count, _ = self.vocab.encode_words(plain)
        for i, w in enumerate(self.new):
            if w in special:
                flat = np.insert(flat, count[:i].sum(), special[w])
                count[i] = 1
        self.flat, self.count, self.new = np.r_[self.flat, flat], np.r_[self.count, count], []
        self.start = np.cumsum(self.count) - self.count


def _words(vocab: Vocabulary, cut: regex.Pattern, text: str) -> list[str]:
    if vocab.special_pattern is None or not vocab.special_pattern.search(text):
        return cut.findall(text)
    out, at = [], 0
    for m in vocab.special_pattern.finditer(text):
        out += [*cut.findall(text[at : m.start()]), m.group()]
        at = m.end()
    return out + cut.findall(text[at:])


def encoder(spark: SparkSession, path: str | None = None):
    """A function of a text column: its token ids. Null and empty texts have none."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(open(path or default_path(), "rb").read())

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(shared.value)
        cut, memory = regex.compile(PATTERN), _Memory(vocab)
        for batch in batches:
            counts, parts, found, held = [], [], [], 0

            def gather() -> None:
                memory.learn()
                index = np.concatenate(found)
                ends = np.cumsum([len(f) for f in found])
                n = np.r_[0, np.cumsum(memory.count[index])]
                counts.append(np.diff(n[np.r_[0, ends]]))
                parts.append(memory.flat[spread(memory.start[index], memory.count[index])].astype(np.int32))
                found.clear()
                if memory.n > REMEMBERED:
                    memory.reset()

            for text in batch:
                words = _words(vocab, cut, (text.as_py() or b"").decode("utf-8", "replace"))
                found.append(np.fromiter(map(memory.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held > CHUNK:
                    gather()
                    held = 0
            if found:
                gather()
            offsets = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else np.zeros(1, np.int64)
            ids = np.concatenate(parts) if parts else np.array([], np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

    return lambda text: encode(text.cast("binary"))


def decoder(spark: SparkSession, path: str | None = None):
    """A function of a column of ids: the text. Bytes that are no UTF-8 become U+FFFD; null stays."""
    ship_package(spark)
    shared = spark.sparkContext.broadcast(open(path or default_path(), "rb").read())

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(shared.value)
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            counts = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(counts)
            texts = [vocab.decode(flat[e - n : e]).decode("utf-8", "replace") for e, n in zip(ends, counts)]
            yield pa.array([t if known else None for t, known in zip(texts, batch.is_valid().to_pylist())], pa.string())

    return decode


def with_tokens(documents: DataFrame, path: str | None = None, text: str = "text", out: str = "ids") -> DataFrame:
    """``documents`` with the token ids of their texts; an empty array for null and empty ones."""
    return documents.withColumn(out, encoder(documents.sparkSession, path)(F.col(text)))


def ids_digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)


def token_digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts and digests of ids and of decoded texts. Rows stay as they are, equal ones too."""
    encoded = with_tokens(documents.select("doc_id", "text"), path).drop("text")
    decoded = encoded.withColumn("decoded", decoder(documents.sparkSession, path)(F.col("ids")))
    return decoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
