"""Language-model scores by logistic context mixing.

A token (a word, or the end of a text) is coded as a run of binary decisions: a Huffman
code over at most HEAD most frequent training words, the end, and one class for all other
words. Each decision is predicted from the code's own shares and from two hashed contexts,
the token before and the two tokens before. Predictions are combined in the logistic domain (Mahoney, "Adaptive
weighing of context models", 2005) with weights that a gate picks by depth in the code and
by how often the longer context has been seen; a table of outcomes by gate and prediction
then refines the result. A word outside the head is either met among the training texts' other words, at its
share of them by an exact count that Spark joins on, or spelled; its probability is the sum of both. Spelling
mixes in the same way: the eight bits of each byte, and of the word's end, are predicted from hashed contexts of none to
five bytes before, with weights gated by how many of these contexts were seen. It is learnt from
the distinct rare words of a block.

On top of the tokens stands a memory that grows with the corpus: texts are cut into passages
where the hash of the last GRAM tokens says so, and passages are counted over all training texts.
One bit a passage, predicted from whether the passages before it were known, says
whether it is taken from the memory (at the cost of its share of all passages) or told
token by token. A training text's own passage is left out of the counts it is judged by.

Everything is learnt from all training texts. Words and passages are exact Spark aggregates
by 64-bit hash. Decisions are learnt online: training texts are dealt into blocks by a hash
of their text; a block goes through its texts in the order of that hash, predicts each batch from the counts so far,
moves its weights, then counts. Blocks' counts add up, and their weights are averaged as
sums of integers, so that scores do not depend on how the table is partitioned. The tables
that reach the driver (code book, slots of the contexts of tokens and bytes) have a fixed size.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import WORD_BYTES, WordHashes, arrow_in_small_batches, cut, mix64, ragged, shared_folder, shuffles_go, stored, table, text_bytes

#: At most so many words have codes of their own; training tokens that one block learns from.
HEAD, BLOCK_TOKENS = 65_000, 6_000_000
SLOT_BITS, PIECE = 20, 4096
SLOTS = 1 << SLOT_BITS
END_HASH, REST, END = np.uint64(0xE7037ED1A0B428DB), 0, 1
DEPTHS, SEEN, STEPS = 24, 4, 33
CONTEXTS = 2
INPUTS = CONTEXTS + 2
#: Contexts of a byte are the 0 to ORDERS - 1 bytes before it in its word.
ORDERS, LETTER_DEPTHS = 6, 8
PRIOR, RATE = 0.4, 0.02
#: Decisions are worked through so many tokens at a time, which keeps arrays in the cache.
BATCH = 8192
#: A passage ends where the hash of GRAM tokens is 0 modulo PASSAGE; one in HOT passages is frequent.
GRAM, PASSAGE, HOT = 4, 16, 1000
#: The byte that tells a word's end, which no word holds.
SPACE = 0x20
#: Spelling moves its weights after about so many bytes.
LETTER_BATCH, LETTER_RATE = 4096, 0.1
#: Bytes in their contexts whose bits a task that scores keeps.
SPELLED = 1 << 20


class Reader:
    """Tokens of a batch of texts: hashes in lower case (A-Z), an end after each text, and what spelling needs."""

    def __init__(self) -> None:
        self.read = WordHashes(lower=True)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[ord("A") : ord("Z") + 1] += 32

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hashes, where each text's tokens begin among them, which tokens are words)"""
        h, at = self.read(texts)
        docs = np.arange(len(texts) + 1)
        flat = np.full(len(h) + len(texts), END_HASH, np.uint64)
        word = np.ones(len(flat), bool)
        word[at[1:] + docs[:-1]] = False
        flat[word] = h
        return flat, at + docs, word

    def letters(self, texts: pa.Array, which: np.ndarray, most: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For a few texts at a time, of the words that ``which`` marks: their bytes, each word with its end; where they begin."""
        offsets, data = text_bytes(texts)
        done = 0
        for a, b in _spans_of(offsets, most):
            part, breaks = data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]
            edge = np.zeros(len(part) + 1, bool)
            edge[breaks] = edge[-1] = True
            inside = np.concatenate(([False], WORD_BYTES[part], [False]))
            starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
            ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
            here = which[done : done + len(starts)]
            done += len(starts)
            starts, size = starts[here], (ends - starts)[here] + 1
            first = np.cumsum(size) - size
            at = np.repeat(starts - first, size) + np.arange(size.sum())
            last = first + size - 1
            at[last] = 0
            spelled = self.lower[part[at]] if len(at) else np.zeros(0, np.uint8)
            spelled[last] = SPACE
            yield spelled, first


def _spans_of(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1))
        yield a, b
        a = b


def passages(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the passages, starts) of tokens ``h`` whose texts begin at ``at``; each text begins a passage."""
    ends = np.zeros(len(h) + 1, bool)
    ends[at] = True
    g = np.zeros(max(0, len(h) - GRAM + 1), np.uint64)
    for i in range(GRAM):
        g = mix64(g + h[i : i + len(g)])
    ends[GRAM : GRAM + len(g)] |= g % np.uint64(PASSAGE) == 0
    within = np.arange(len(h)) - np.repeat(at[:-1], np.diff(at))
    ends[:-1][(within > 0) & (within < GRAM)] = False  # a gram that reaches into the text before says nothing
    starts = np.flatnonzero(ends[:-1])
    place = np.arange(len(h)) - np.repeat(starts, np.diff(np.append(starts, len(h))))
    x = mix64(h + place.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    return (mix64(np.add.reduceat(x, starts)) if len(starts) else np.zeros(0, np.uint64)), starts


def _lengths(weights: list[int]) -> np.ndarray:
    """Lengths of a Huffman code for ``weights`` in falling order, by the method of two queues."""
    leaves = deque((n, i) for i, n in reversed(list(enumerate(weights))))
    inner: deque = deque()
    parent = [0] * (2 * len(weights) - 1)
    for node in range(len(weights), len(parent)):
        total = 0
        for _ in range(2):
            n, i = leaves.popleft() if leaves and (not inner or leaves[0][0] <= inner[0][0]) else inner.popleft()
            parent[i], total = node, total + n
        inner.append((total, node))
    depth = [0] * len(parent)
    for i in range(len(parent) - 2, -1, -1):
        depth[i] = depth[parent[i]] + 1
    return np.array(depth[: len(weights)], np.int64)


def code_book(hashes: np.ndarray, counts: np.ndarray, rest: int) -> dict:
    """Canonical Huffman codes of the classes (REST, END, then words) and the tables that find a word's class by its hash.

    ``hashes`` and ``counts`` hold the end first. A word that finds no place in three tables counts as a rare one.
    """
    slots = 1 << 18
    tables, left = [], np.arange(1, len(hashes))
    for shift in (46, 28, 10):
        key, index = np.zeros(slots, np.uint64), np.zeros(slots, np.int64)
        s = (hashes[left] >> np.uint64(shift)) & np.uint64(slots - 1)
        _, first = np.unique(s, return_index=True)
        key[s[first]], index[s[first]] = hashes[left[first]], left[first]
        tables.append((key, index))
        left = np.delete(left, first)
    rest += int(counts[left].sum())
    placed = np.delete(np.arange(len(hashes)), left)
    classes = np.zeros(len(hashes), np.int64)
    classes[placed] = np.arange(END, END + len(placed))
    n = np.concatenate(([rest], counts[placed])).astype(np.int64)
    weight = np.maximum(n, max(1, int(n.sum()) >> 20))
    order = np.lexsort((np.arange(len(n)), -weight))
    length = np.zeros(len(n), np.int64)
    length[order] = _lengths(weight[order].tolist())
    by = np.lexsort((np.arange(len(n)), length))
    per = np.bincount(length, minlength=length.max() + 1)
    code, value = np.zeros(len(n), np.int64), 0
    first_inner, offset, inner = [], [], 0
    taken = 0
    for d in range(length.max() + 1):
        value <<= 1
        code[by[taken : taken + per[d]]] = value + np.arange(per[d])
        taken += per[d]
        value += int(per[d])
        first_inner.append(value)
        offset.append(inner)
        inner += (1 << d) - value
    nodes = np.zeros((inner, 2), np.int64)
    for d in range(length.max()):
        on = length > d
        node = (code[on] >> (length[on] - d)) - first_inner[d] + offset[d]
        np.add.at(nodes, (node, (code[on] >> (length[on] - d - 1)) & 1), n[on])
    return {
        "tables": [(key, classes[index].astype(np.uint16)) for key, index in tables],
        "n": n,
        "length": length.astype(np.uint8),
        "code": code.astype(np.uint32),
        "shift": np.array(offset) - np.array(first_inner),
        "none": (np.log(nodes[:, 1] + PRIOR) - np.log(nodes[:, 0] + PRIOR)).astype(np.float32),
    }


def classes(book: dict, h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Class of each token; REST for words that have no code."""
    found, left = np.zeros(len(h), np.uint16), np.arange(len(h))
    for (key, index), shift in zip(book["tables"], (46, 28, 10), strict=True):
        s = ((h[left] >> np.uint64(shift)) & np.uint64((1 << 18) - 1)).astype(np.int64)
        hit = key[s] == h[left]
        found[left[hit]] = index[s[hit]]
        left = left[~hit]
    found[~word] = END
    return found


class Decisions:
    """The decisions of some tokens, by depth: tokens with long codes come first, so that each depth takes a slice."""

    def __init__(self, book: dict, c: np.ndarray, place: np.ndarray):
        """``c`` are classes of texts end to end, ``place`` tells where in its text a token stands."""
        length = book["length"][c]
        self.order = np.argsort(255 - length, kind="stable")
        self.book, self.length, self.code = book, length[self.order].astype(np.uint32), book["code"][c[self.order]]
        before = np.concatenate(([0], c[:-1])).astype(np.uint32) + np.uint32(1)
        before[place == 0] = 0
        second = np.concatenate(([0], before[:-1])).astype(np.uint32)
        second[place < 2] = 0
        one, two = before[self.order] * np.uint32(0x9E3779B1), second[self.order] * np.uint32(0x85EBCA77)
        one ^= one >> np.uint32(15)
        two ^= two >> np.uint32(13)
        self.keys = [one, one * np.uint32(0xC2B2AE3D) + two * np.uint32(0x165667B1) + np.uint32(0x27D4EB2F)]
        self.n = np.searchsorted(-self.length.astype(np.int64), -np.arange(self.length.max(initial=0)), "left")

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(depth, tokens, bit, node, slots of the contexts)"""
        for d, n in enumerate(self.n.tolist()):
            left = self.length[:n] - np.uint32(d)
            node = (self.code[:n] >> left).astype(np.int64) + self.book["shift"][d]
            bit = (self.code[:n] >> (left - np.uint32(1))) & np.uint32(1)
            step = node.astype(np.uint32) * np.uint32(0x2545F491) + np.uint32(0x6D2B79F5)
            slots = []
            for key in self.keys:
                x = (key[:n] ^ step) * np.uint32(0xD3A2646D)
                x ^= x >> np.uint32(15)
                slots.append(((x * np.uint32(0x846CA68B)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64))
            yield d, n, bit, node, slots


class Letters:
    """The decisions of spelled words: eight for each byte and for the end of a word, most significant bit first."""

    def __init__(self, c: np.ndarray, first: np.ndarray, which: np.ndarray | None = None):
        """``c`` are the bytes of words end to end, which begin at ``first``; ``which`` are the places of those that are asked for, else all are."""
        self.c = c.astype(np.uint32)
        place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
        key = np.zeros(len(c), np.uint32)
        self.keys = [key]
        for back in range(1, ORDERS):
            before = np.zeros(len(c), np.uint32)
            before[back:] = self.c[: max(0, len(c) - back)] + np.uint32(1)
            before[place < back] = 0
            key = (key + before + np.uint32(back)) * np.uint32(0x9E3779B1)
            key = key ^ (key >> np.uint32(15))
            self.keys.append(key)
        if which is not None:
            self.c, self.keys = self.c[which], [x[which] for x in self.keys]
        self.order = np.arange(len(self.c))

    def __iter__(self) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(depth, bytes, bit, node, slots of the contexts)"""
        for d in range(LETTER_DEPTHS):
            node = (self.c >> np.uint32(LETTER_DEPTHS - d)) + np.uint32(1 << d)
            bit = (self.c >> np.uint32(LETTER_DEPTHS - 1 - d)) & np.uint32(1)
            slots = []
            for key in self.keys:
                x = (key ^ node * np.uint32(0x2545F491)) * np.uint32(0xD3A2646D)
                x ^= x >> np.uint32(15)
                slots.append(((x * np.uint32(0x846CA68B)) >> np.uint32(32 - SLOT_BITS)).astype(np.int64))
            yield d, len(self.c), bit, None, slots


def _token_gate(seen: list[np.ndarray]) -> np.ndarray:
    """The gate of a token's decision, by how often its longest context was seen (in steps)."""
    return seen[-1].astype(np.int64)


def _letter_gate(seen: list[np.ndarray]) -> np.ndarray:
    """The gate of a byte's decision: how many of the longer contexts were seen, and whether the longest such one often."""
    return sum((x > 0).astype(np.int64) + (x > 1) for x in seen[1:])


LETTER_GATES = 2 * ORDERS - 1


def _stretched(pairs: np.ndarray) -> np.ndarray:
    x = np.log(pairs.astype(np.float32) + np.float32(PRIOR))
    return x[:, 1] - x[:, 0]


def _seen(n: np.ndarray) -> np.ndarray:
    """How often something was seen, in SEEN steps."""
    return ((n > 0).view(np.int8) + (n > 3).view(np.int8) + (n > 31).view(np.int8)).astype(np.int64)


def _mixed(w: np.ndarray, gate: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
    """Weighted sum of predictions, with the weights of the gate; the last weight stands alone."""
    w = np.ascontiguousarray(w.T)
    y = w[-1][gate]
    for i, v in enumerate(x):
        y += w[i][gate] * v
    return np.clip(y, -12, 12)


def _cells(gate: np.ndarray, y: np.ndarray) -> np.ndarray:
    return gate * STEPS + np.rint((y + np.float32(12)) * np.float32((STEPS - 1) / 24)).astype(np.int64)


def _first_weights() -> np.ndarray:
    return np.tile(np.array([0.6, 0.2, 0.2, 0.0], np.float32), (DEPTHS, SEEN, 1))


def _first_letter_weights() -> np.ndarray:
    return np.tile(np.array([0.05, 0.1, 0.2, 0.3, 0.3, 0.3, 0.0], np.float32), (LETTER_DEPTHS, LETTER_GATES, 1))


def _load(packed: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(packed))


def _dump(what) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(what))


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _expand(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.as_py()), kind)


def _tally(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """(h, n): how often tokens occur, each hash once for every ``most`` tokens."""
    reader, held, size = Reader(), [], 0

    def counted() -> pa.RecordBatch:
        x = np.sort(np.concatenate([*held, np.zeros(0, np.uint64)]))
        starts = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(x[starts].view(np.int64)), pa.array(np.diff(np.append(starts, len(x))), pa.int64())], names=["h", "n"])

    for batch in batches:
        h, _, _ = reader.tokens(batch.column(0))
        held.append(h)
        size += len(h)
        if size >= most:
            yield counted()
            held, size = [], 0
    yield counted()


KIND = "kind int, piece int, data binary"


def _encode(book, blocks: int):
    """Rows (block, h, packed, spelled): class numbers of a text, and the bytes of its distinct rare words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, reader = _load(book.value), Reader()
        for batch in batches:
            h, at, word = reader.tokens(batch.column(0))
            c = classes(code, h, word)
            rare = (c == REST) & word
            of = np.repeat(np.arange(len(at) - 1), np.diff(at))[rare]
            order = np.lexsort((h[rare], of))
            new = np.ones(len(order), bool)
            new[1:] = (h[rare][order][1:] != h[rare][order][:-1]) | (of[order][1:] != of[order][:-1])
            first = np.zeros(len(order), bool)
            first[order[new]] = True  # lexsort is stable, so that it is a word's first place in its text
            rare[rare] = first
            letters = [x[0] for x in reader.letters(batch.column(0), rare[word])]
            letters = np.concatenate([np.zeros(0, np.uint8), *letters])
            ends = np.append(0, np.flatnonzero(letters == SPACE) + 1)
            of_text = ends[np.searchsorted(of[first], np.arange(len(at)))]
            th = batch.column(1).to_numpy()
            packed = [_squeeze(c[a:b]) for a, b in zip(at[:-1], at[1:])]
            spelled = [_squeeze(letters[a:b]) for a, b in zip(of_text[:-1], of_text[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(th % blocks, pa.int64()), pa.array(th, pa.int64()), pa.array(packed, pa.binary()), pa.array(spelled, pa.binary())], names=["block", "h", "packed", "spelled"])

    return run


def _learn_block(book):
    def rows(what: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        kind, piece, data = zip(*what, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(piece, pa.int32()), pa.array([_squeeze(x.astype(np.int64)) for x in data], pa.binary())], names=["kind", "piece", "data"])

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _load(book.value)
        hs, texts, spelled = [], [], []
        for batch in batches:
            hs += batch.column(1).to_pylist()
            texts += [x.as_py() for x in batch.column(2)]
            spelled += [x.as_py() for x in batch.column(3)]
        order = np.argsort(np.array(hs), kind="stable")
        tokens, letters = Learner(CONTEXTS, _first_weights(), RATE, _token_gate, code["none"]), Learner(ORDERS, _first_letter_weights(), LETTER_RATE, _letter_gate)
        unpack, held, size, met, new, waiting = zstandard.ZstdDecompressor(), [], 0, set(), [], 0
        for i, k in enumerate(order.tolist()):
            held.append(np.frombuffer(unpack.decompress(texts[k]), np.uint16))
            size += len(held[-1])
            for x in unpack.decompress(spelled[k]).split(b" ")[:-1]:
                if x not in met:
                    met.add(x)
                    new.append(x)
                    waiting += len(x) + 1
            if size >= BATCH or i + 1 == len(order):
                tokens.learn(Decisions(code, np.concatenate(held), np.concatenate([np.arange(len(x)) for x in held])))
                held, size = [], 0
            if waiting >= LETTER_BATCH or new and i + 1 == len(order):
                for part in _lots(new, LETTER_BATCH):
                    sizes = np.array([len(x) + 1 for x in part])
                    letters.learn(Letters(np.frombuffer(b" ".join([*part, b""]), np.uint8), np.cumsum(sizes) - sizes))
                new, waiting = [], 0
        for kind, x in enumerate([*tokens.counts, *letters.counts]):
            yield rows([(kind, p, x[2 * p * PIECE : 2 * (p + 1) * PIECE]) for p in range(SLOTS // PIECE)])
        yield rows([(CONTEXTS + ORDERS, 0, tokens.sums()), (CONTEXTS + ORDERS + 1, 0, letters.sums())])

    return run


def _lots(words: list[bytes], most: int) -> Iterator[list[bytes]]:
    """``words`` in lots of about ``most`` bytes."""
    part, size = [], 0
    for x in words:
        part.append(x)
        size += len(x) + 1
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


class Learner:
    """Counts, weights and refinement of one mix."""

    def __init__(self, contexts: int, w: np.ndarray, rate: float, gate, none: np.ndarray | None = None):
        self.counts = [np.zeros(2 * SLOTS, np.int32) for _ in range(contexts)]
        self.w, self.rate, self.gate, self.none = w, rate, gate, none
        self.n, self.cells = np.zeros(w.shape[:2], np.int64), np.zeros((2, w.shape[0], w.shape[1] * STEPS), np.int64)

    def learn(self, decisions: Decisions | Letters) -> None:
        """One online step: predict ``decisions`` from the counts so far, move the weights, then count."""
        pairs = [x.view(np.int64) for x in self.counts]  # both counts of a slot in one look
        seen: list[list[np.ndarray]] = [[] for _ in self.counts]
        depths, gates, _ = self.w.shape
        for d, _, bit, node, slots in decisions:
            met = [x[s].view(np.int32).reshape(-1, 2) for x, s in zip(pairs, slots, strict=True)]
            at = min(d, depths - 1)
            gate = self.gate([_seen(x[:, 0] + x[:, 1]) for x in met])
            x = [*([] if self.none is None else [self.none[node]]), *map(_stretched, met)]
            y = _mixed(self.w[at], gate, x)
            both = np.bincount(_cells(gate, y) * 2 + bit, minlength=2 * gates * STEPS)
            self.cells[:, at] += both.reshape(-1, 2).T
            error = bit - 1 / (1 + np.exp(-y))
            size = np.bincount(gate, minlength=gates)
            self.n[at] += size
            rate = self.rate * 10 / np.maximum(size, 64)
            for i, v in enumerate([*x, None]):
                self.w[at, :, i] += (rate * np.bincount(gate, error if v is None else error * v, gates)).astype(np.float32)
            for store, s in zip(seen, slots, strict=True):
                store.append(s * 2 + bit)
        for x, s in zip(self.counts, seen, strict=True):
            if s:
                s = np.concatenate(s)
                np.add.at(x, s, np.ones(len(s), np.int32))

    def sums(self) -> np.ndarray:
        """Weights times decisions, decisions, and outcomes by gate and prediction."""
        return np.concatenate([np.rint(self.w.astype(np.float64) * self.n[:, :, None] * 1024).astype(np.int64).ravel(), self.n.ravel(), self.cells.ravel()])


def _mixer(sums: dict, first_kind: int, contexts: int, at: int, first: np.ndarray, step: bool) -> dict:
    """What blocks' ``sums`` give for scoring: predictions and how often slots were seen, weights, refinement."""
    pairs = [np.concatenate([sums.get((k, p), np.zeros(2 * PIECE, np.int64)) for p in range(SLOTS // PIECE)]).reshape(-1, 2) for k in range(first_kind, first_kind + contexts)]
    depths, gates, inputs = first.shape
    flat = sums.get((at, 0), np.zeros(depths * gates * (inputs + 1 + 2 * STEPS), np.int64))
    w, n, cells = np.split(flat, [depths * gates * inputs, depths * gates * (inputs + 1)])
    n = n.reshape(depths, gates, 1)
    cells = cells.reshape(2, depths, gates * STEPS)
    level = 1 / (1 + np.exp(-np.tile(np.linspace(-12, 12, STEPS), gates)))
    return {
        "stretch": [_stretched(x) for x in pairs],
        "seen": [_seen(x.sum(1)).astype(np.uint8) for x in (pairs if step else pairs[-1:])],
        "weights": np.where(n > 0, w.reshape(first.shape) / 1024 / np.maximum(n, 1), first).astype(np.float32),
        "refine": ((cells[1] + 20 * level) / (cells.sum(0) + 20)).astype(np.float32),
    }


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = sum(_expand(x, np.int64) for batch in batches for x in batch.column(2))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([_squeeze(total)], pa.binary())], names=["kind", "piece", "data"])


def _head(words: DataFrame) -> list:
    """(h, n) of the most frequent words, at most HEAD: those above the lowest count step that has room."""
    step = F.floor(F.log2("n") * 64).cast("int").alias("step")
    room, least = HEAD, 1 << 30
    for r in sorted(words.groupBy(step).count().collect(), key=lambda r: -r["step"]):  # at most 64 * 64 steps
        if room < r["count"]:
            break
        room, least = room - r["count"], r["step"]
    return words.where(step >= least).orderBy(F.desc("n"), "h").collect()


@shuffles_go
def learn(texts: DataFrame) -> dict:
    """The model of the training ``texts`` (a column text; null is empty)."""
    spark = texts.sparkSession
    arrow_in_small_batches(spark)
    words = texts.select("text").mapInArrow(_tally, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    folder = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    words.write.parquet(folder)
    total = spark.read.parquet(folder).agg(F.sum("n")).first()[0] or 0
    found = [(np.uint64(r["h"] % (1 << 64)), r["n"]) for r in _head(spark.read.parquet(folder).where("n > 1"))]
    ends = next((n for h, n in found if h == END_HASH), 1 if total else 0)
    found = [x for x in found if x[0] != END_HASH]
    hashes = np.array([END_HASH, *[h for h, _ in found]], np.uint64)
    counts = np.array([ends, *[n for _, n in found]], np.int64)
    book = code_book(hashes, counts, total - int(counts.sum()))
    sent = spark.sparkContext.broadcast(_dump(book))
    blocks = max(1, -(-total // BLOCK_TOKENS))
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    coded = texts.select("text", th.alias("h")).mapInArrow(_encode(sent, blocks), "block long, h long, packed binary, spelled binary")
    parts = coded.groupBy("block").applyInArrow(_learn_block(sent), KIND).groupBy("kind", "piece").applyInArrow(_add, KIND)
    sums = {(r["kind"], r["piece"]): np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["data"])), np.int64) for r in parts.collect()}  # (CONTEXTS + ORDERS) * 256 pieces and two more, whatever the corpus
    return {
        "book": book,
        "tokens": total,
        "mix": _mixer(sums, 0, CONTEXTS, CONTEXTS + ORDERS, _first_weights(), False),
        "letters": _mixer(sums, CONTEXTS, ORDERS, CONTEXTS + ORDERS + 1, _first_letter_weights(), True),
    }


def _bits(mix: dict, decisions: Decisions | Letters, gate_of, none: np.ndarray | None = None) -> np.ndarray:
    """Bits of each token's, or byte's, decisions."""
    bits = np.zeros(len(decisions.order))
    for d, n, bit, node, slots in decisions:
        at = min(d, len(mix["weights"]) - 1)
        gate = gate_of([x[s] for x, s in zip(mix["seen"], slots[-len(mix["seen"]) :], strict=True)])
        y = _mixed(mix["weights"][at], gate, [*([] if none is None else [none[node]]), *[x[s] for x, s in zip(mix["stretch"], slots, strict=True)]])
        one = (1 / (1 + np.exp(-y)) + mix["refine"][at][_cells(gate, y)]) * np.float32(0.5)
        bit = bit.astype(np.float32)
        bits[:n] -= np.log2((1 - bit) + (2 * bit - 1) * one)
    out = np.empty_like(bits)
    out[decisions.order] = bits
    return out


class Speller:
    """Bits of spelled words. A byte's bits follow from it and the ORDERS - 1 bytes before it in its word, and are kept by these."""

    def __init__(self, mix: dict):
        self.mix = mix
        self.keys, self.bits = np.zeros(SPELLED, np.uint64), np.zeros(SPELLED)

    def of_bytes(self, c: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bits of each of the bytes ``c`` of words end to end, which begin at ``first``."""
        place = np.arange(len(c)) - np.repeat(first, np.diff(np.append(first, len(c))))
        key = c.astype(np.uint64) + np.uint64(1 << 8 * ORDERS)  # no key is 0
        for back in range(1, ORDERS):
            before = np.zeros(len(c), np.uint64)
            before[back:] = c[: max(0, len(c) - back)]
            before[place < back] = 0
            key |= before << np.uint64(8 * back)
        at = (mix64(key) & np.uint64(SPELLED - 1)).astype(np.int64)
        out = self.bits[at]
        new = np.flatnonzero(self.keys[at] != key)
        if len(new):
            _, one, same = np.unique(key[new], return_index=True, return_inverse=True)
            one = new[one]
            found = _bits(self.mix, Letters(c, first, one), _letter_gate)
            out[new] = found[same]
            self.bits[at[one]] = found
            self.keys[at[one]] = key[one]
        return out

    def of_words(self, reader: Reader, texts: pa.Array, which: np.ndarray) -> np.ndarray:
        """Bits of each word that ``which`` marks."""
        out = [np.zeros(0)]
        for c, first in reader.letters(texts, which):
            if len(first):
                out.append(np.add.reduceat(self.of_bytes(c, first), first))
        return np.concatenate(out)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = _load(model.value), Reader()
        speller = Speller(m["letters"])
        log_c = np.log10(m["book"]["n"] + 0.5)
        log_c[REST] = 0.0
        for batch in batches:
            texts = batch.column(1)
            h, at, word = reader.tokens(texts)
            c = classes(m["book"], h, word)
            n = np.diff(at)
            place = np.arange(len(h)) - np.repeat(at[:-1], n)
            bits = np.concatenate([np.zeros(0), *[_bits(m["mix"], Decisions(m["book"], c[at[a] : at[b]], place[at[a] : at[b]]), _token_gate, m["book"]["none"]) for a, b in _spans_of(at, BATCH)]])
            rare = c == REST
            chunk, starts = passages(h, at)
            lists = np.searchsorted(starts, at)
            words_, first, same = np.unique(h[rare], return_index=True, return_inverse=True)
            which = np.zeros(int(rare.sum()), bool)
            which[first] = True
            spell = np.zeros(len(words_))
            spell[same[which]] = speller.of_words(reader, texts, _within(rare, which)[word])
            bits[rare] += spell[same]
            told = np.add.reduceat(bits, starts) if len(starts) else bits
            piece = np.searchsorted(starts, np.flatnonzero(rare), "right") - 1
            order = np.lexsort((same, piece))
            piece, same = piece[order], same[order]
            new = np.flatnonzero(np.append(True, (same[1:] != same[:-1]) | (piece[1:] != piece[:-1]))) if len(same) else np.zeros(0, np.int64)
            times = np.diff(np.append(new, len(same)))
            piece, same = piece[new], same[new]
            rare_at = np.searchsorted(piece, lists)
            within = piece - np.repeat(lists[:-1], np.diff(rare_at))
            offsets, _ = text_bytes(texts)
            head = np.add.reduceat(log_c[c], at[:-1]) if len(n) else np.zeros(0)
            known = n - np.add.reduceat(rare.astype(np.int64), at[:-1]) if len(n) else n
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(head, pa.float64()), ragged(words_[same].view(np.int64), rare_at), ragged(times.astype(np.int32), rare_at), ragged(within.astype(np.int32), rare_at), ragged(spell[same].astype(np.float32), rare_at), ragged(chunk.view(np.int64), lists), ragged(told, lists)],
                names=["doc_id", "train", "n_bytes", "n_tokens", "known", "head", "rare", "rare_n", "rare_at", "rare_bits", "passages", "told"],
            )

    return run


def _within(mask: np.ndarray, which: np.ndarray) -> np.ndarray:
    """``mask`` without those of its marks that ``which`` doesn't pick."""
    out = mask.copy()
    out[mask] = which
    return out


def _counted(looked: DataFrame, frequent: DataFrame) -> DataFrame:
    """``looked`` (h, row, n, train and others) with c, how often ``h`` occurs in training texts, and lo, the first such row and place.

    Passages that are frequent, which are at most HOT, are aggregated before they are shuffled.
    """
    at = Window.partitionBy("h")
    c, lo = F.sum(F.when(F.col("train"), F.col("n"))), F.min(F.when(F.col("train"), F.struct("row", "k")))
    rare = looked.join(F.broadcast(frequent), "h", "left_anti").withColumns({"c": c.over(at), "lo": lo.over(at)})
    often = looked.join(F.broadcast(frequent), "h", "left_semi")
    return rare.unionByName(often.join(F.broadcast(often.groupBy("h").agg(c.alias("c"), lo.alias("lo"))), "h"))


def _retold(batch: pa.RecordBatch, all_rare: int, p: float) -> list[np.ndarray]:
    """Bits of each text's passages if rare words may also be met among the training texts' ``all_rare`` ones, which ``p`` of them are.

    The last columns are words (k, n, c), rare_n, rare_at, rare_bits, told, train. A training text's own words of a passage are left out of their count.
    """
    words_, times, at, spell, told, train = batch.columns[-6:]
    flat, begin = np.array(told.flatten()), np.append(0, np.cumsum(pa.compute.list_value_length(told)))
    rare = np.append(0, np.cumsum(pa.compute.list_value_length(at)))
    at, spell = at.flatten().to_numpy(), spell.flatten().to_numpy().astype(np.float64)
    known = pa.compute.list_value_length(words_).to_numpy()
    doc = np.repeat(np.arange(len(known)), known)
    k, n, c = (pa.compute.struct_field(words_.flatten(), i).to_numpy() for i in range(3))
    c = np.maximum(0, c - np.where(train.to_numpy(zero_copy_only=False)[doc], n, 0))
    # every rare word pays for being spelled, unless it is met
    every = np.repeat(begin[:-1], np.diff(rare)) + at
    place = rare[doc] - 1 - k
    np.add.at(flat, every, times.flatten().to_numpy() * -math.log2(1 - p))
    met = -np.log2(p * c / max(1, all_rare) + (1 - p) * np.exp2(-spell[place]))
    np.add.at(flat, every[place], n * (met - spell[place] + math.log2(1 - p)))
    return np.split(flat, begin[1:-1])


def _flags(known: list, told: np.ndarray, log_all: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(taken from memory, bits, state of each passage); the state is what the two passages before were and how many bits are told."""
    cost = np.full(len(told), np.inf)
    for x in known:
        cost[x["k"]] = log_all - math.log2(x["c"])
    taken = cost < told
    before = np.concatenate(([0], taken[:-1])).astype(np.int64)
    second = np.concatenate(([0], before[:-1]))
    return taken, np.where(taken, cost, told), (2 * before + second) * 4 + np.minimum(3, told.astype(np.int64) // 64)


def _flag_counts(log_all: float, all_rare: int, p: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(32, np.int64)
        for batch in batches:
            for known, told in zip(batch.column(0).to_pylist(), _retold(batch, all_rare, p), strict=True):
                taken, _, state = _flags(known or [], told, log_all)
                n += np.bincount(2 * state + taken, minlength=32)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(32), pa.int32()), pa.array(n, pa.int64())], names=["i", "n"])

    return run


def _totals(log_all: float, all_rare: int, p: float, flag_bits: np.ndarray):
    """The first columns, and bits; the columns behind them are known_passages and those that ``_retold`` takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for known, told in zip(batch.column(-7).to_pylist(), _retold(batch, all_rare, p), strict=True):
                taken, cost, state = _flags(known or [], told, log_all)
                bits.append(float(cost.sum() + flag_bits[2 * state + taken].sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-7], pa.array(bits, pa.float64())], names=["doc_id", "train", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", "bits"])

    return run


@shuffles_go
def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, train, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row of ``docs`` (doc_id, text, train).

    Rows with train are those the model was learnt from: the counts of rare words and passages
    come from them here. A null text is empty: its one token is the end. Repeated rows count as
    often as they occur. Without training texts every token is unknown.
    """
    spark = docs.sparkSession
    arrow_in_small_batches(spark)
    sent = spark.sparkContext.broadcast(_dump(model))
    schema = "doc_id long, train boolean, n_bytes long, n_tokens long, known long, head double, rare array<long>, rare_n array<int>, rare_at array<int>, rare_bits array<float>, passages array<long>, told array<double>"
    folder = f"{shared_folder(spark)}/lm-{uuid.uuid4().hex}"
    docs.select("doc_id", "text", "train").mapInArrow(_score(sent), schema).withColumn("row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    rare = rows.select("row", "train", F.posexplode(F.arrays_zip("rare", "rare_n")).alias("j", "w")).select("w.rare", "row", F.col("w.rare_n"), "train", -1 - F.col("j")).toDF("h", "row", "n", "train", "k")
    told = rows.select("row", "train", F.posexplode("passages").alias("k", "h")).select("h", "row", F.lit(1).alias("n"), "train", "k")
    top = told.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {HOT}, {10 * HOT})").alias("top"))  # results don't hang on it
    frequent = cut(top.select("n", F.explode("top").alias("t")).where(F.col("t.count") * HOT >= F.col("n")).select(F.col("t.item").alias("h")))
    word = F.col("k") < 0
    counted = _counted(rare.union(told), frequent)
    others: Column = F.col("c") - F.when(word | ~F.col("train"), 0).otherwise(1)
    counted = counted.select("row", "k", "n", others.alias("c"), (word & F.col("train") & (F.struct("row", "k") == F.col("lo"))).alias("new"), F.when(word & F.col("train") & (F.col("c") > F.col("n")), F.col("n")).alias("again")).where("c > 0")
    one = F.struct("k", "n", "c")
    found = stored(counted.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("found"), F.count_if("new").alias("new"), F.sum("again").alias("again")))  # at most a text's own words and passages
    every = stored(rows.drop("rare", "passages").join(found, "row", "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<k:int,n:int,c:bigint>>"))))
    sums = every.agg(F.sum("new"), F.sum(F.when(F.col("train"), F.size("told"))), F.sum("again")).first()
    book, total = model["book"], model["tokens"]
    v = int((book["n"][1:] > 0).sum()) + (sums[0] or 0)
    log_all = math.log2(max(1, sums[1] or 0))
    all_rare = int(book["n"][REST])
    p = ((sums[2] or 0) + 0.5) / (all_rare + 1)  # share of rare words met in another passage
    words = F.filter("found", lambda x: x["k"] < 0)
    every = every.withColumns({"words": words, "known_passages": F.filter("found", lambda x: x["k"] >= 0)})
    of = ["words", "rare_n", "rare_at", "rare_bits", "told", "train"]
    n = np.zeros(32)
    for r in every.where("train").select("known_passages", *of).mapInArrow(_flag_counts(log_all, all_rare, p), "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
        n[r["i"]] = r["n"]
    n = n.reshape(16, 2) + 0.5
    flag_bits = -np.log2(n / n.sum(1, keepdims=True)).ravel()
    rare_log = F.aggregate("words", F.lit(0.0), lambda a, x: a + x["n"] * F.log10(x["c"] + 0.5))
    rare_known = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    unknown = F.col("n_tokens") - F.col("known") - rare_known
    base = F.col("head") + rare_log + unknown * math.log10(0.5) - F.col("n_tokens") * math.log10(total + 0.5 * (v + 1))
    own = {"n_known": F.col("known") + rare_known - int(book["n"][END] == 0), "train_tokens": F.lit(total).cast("long"), "base_score": base}
    out = every.select("doc_id", F.col("train").alias("of_train"), "n_bytes", "n_tokens", *[x.alias(k) for k, x in own.items()], "known_passages", *of)
    schema = "doc_id long, train boolean, n_bytes long, n_tokens long, n_known long, train_tokens long, base_score double, bits double"
    out = out.mapInArrow(_totals(log_all, all_rare, p, flag_bits), schema)
    score_ = -F.col("bits") * math.log10(2)
    return out.select("doc_id", "train", "n_bytes", "n_tokens", "n_known", "train_tokens", "base_score", score_.alias("score"), (F.col("bits") / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (~held).alias("train"))
    out = score(docs, learn(docs.where("train")))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
