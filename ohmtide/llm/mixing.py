"""Language-model scores by logistic context mixing over the bits of tokens.

A text is coded token by token (words, then an end), and each token bit by bit: its code is its way through a Huffman tree over the
counts of the training corpus, whose leaves are the most frequent words, buckets of all others by their hash, and the unknown word.
What tells a word of a bucket from the bucket's others is its share by corpus counts. Probabilities of all next tokens sum to one.

Each bit is predicted from its place in the tree under several contexts: none, the text so far, the word before, the two words before
(hashed, in tables of counts; three bits that follow each other share a hash and lie in one line of the cache), and the token that followed the last occurrence of the same words in the text, as long as the bits so
far are its. Their log-odds are mixed by weights that a gate chooses, and the mix is refined by an adaptive map from (gate, log-odds
of the mix by even weights) to what really came. Tables, weights and map learn from all training documents and from no others; so do
the counts of tokens. A text's own bits are learnt under the contexts of words as it goes, each after it has been predicted.

Learning takes two passes of sums: first the tables, then, under the tables' predictions, each gate's gradient and curvature at even
weights (from which one Newton step gives the weights) and the map. A training document is predicted, in learning and in its own
score, from the tables less what it added to them itself, as though it were held out; words that only it has are then the unknown
word. Sums don't depend on how the input is cut into files, lots or partitions, so neither do scores.

Scale: the texts are cut into lots of some MB. Each lot's distinct words join the corpus counts (one shuffle of words, one of
texts; the most frequent words, which are in every lot, are a bounded broadcast instead), and its texts become a table of coded
pieces with their counts. Both learning passes and the scoring are narrow over that table; what learning gives has a fixed size (66 MB)
and is summed by table of counts. Nothing grows with the corpus but the table of counts of words, which stays distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmtide.llm.common import NON_SPACE, drop_written, mix, most_frequent, pieces, utf8, word_hashes, word_spans, written

#: Bytes of text in a lot, and tokens after which the states within a text start anew.
LOT_BYTES, SEGMENT = 8 << 20, 1 << 18
END = np.uint64(0x0DDBA11C0FFEE5ED)
#: Slots of a table of counts, buckets of words that aren't among the most frequent, tokens modelled at once, and cells in a row of sums.
TABLE_BITS, BUCKET_BITS, GROUP, CHUNK = 22, 12, 4096, 1 << 20
#: Words whose counts are sent to all tasks, the most frequent: 16 bytes each, whatever the corpus.
FREQUENT = 100_000
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, n_bytes bigint, bits_per_byte double"


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    """Whether a document is kept from training. A null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of each row, END last; where each row's begin."""
    hashes, counts = [], []
    for i, j in pieces(offsets):
        own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        if len(own) > 8 << 20:  # one long text: hashed in parts that end between words
            n, low = 0, 0
            while low < len(own):
                high = min(low + (4 << 20), len(own))
                while high < len(own) and NON_SPACE[own[high]]:
                    high += 1
                s, e, _ = word_spans(own[low:high], np.array([0, high - low]), NON_SPACE)
                hashes.append(word_hashes(own[low:high], s, e))
                n, low = n + len(s), high
            counts.append(np.array([n]))
            continue
        s, e, first = word_spans(own, at, NON_SPACE)
        hashes.append(word_hashes(own, s, e))
        counts.append(np.diff(first))
    words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(n + 1)])
    out = np.full(begin[-1], END)
    inner = np.ones(len(out), bool)
    inner[begin[1:] - 1] = False
    out[inner] = words
    return out, begin


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -14, 14)))


class Tree:
    """The code of tokens in bits: a Huffman tree whose leaves are the unknown word, the frequent words, and buckets of all others.

    `top` are hashes of the frequent words and `counts` their counts, `buckets` the sum of count + 1 over the other known words by the
    upper bits of their hashes, `once` the number of words that training has once. A word's share of its leaf is by count + 1.
    """

    def __init__(self, top: np.ndarray, counts: np.ndarray, buckets: np.ndarray, once: int):
        # Words of less than 64 bits are told apart with their counts; those that still look alike share a leaf.
        self.keys, which = np.unique(self.key(top, counts), return_inverse=True)
        used = np.flatnonzero(buckets)
        self.bucket = np.zeros(len(buckets), np.int64)
        self.bucket[used] = 1 + len(self.keys) + np.arange(len(used))
        self.mass = np.concatenate([[1.0], np.bincount(which, counts + 1, minlength=len(self.keys)), buckets[used]])
        weight = self.mass.copy()
        weight[0] += once
        n = len(weight)
        order = np.argsort(weight, kind="stable")
        # Leaves and, from n on, inner nodes in the order of their making, both of ascending weight.
        w, up, side = [*weight[order].tolist()], np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.uint8)
        i, j, inner = 0, 0, []
        for k in range(n - 1):
            total = 0.0
            for s in (0, 1):
                if j >= len(inner) or i < n and w[i] <= inner[j]:
                    child, total, i = order[i], total + w[i], i + 1
                else:
                    child, total, j = n + j, total + inner[j], j + 1
                up[child], side[child] = n + k, s
            inner.append(total)
        self.size = n - 1
        depth = np.zeros(2 * n - 1, np.int64)
        for x in range(2 * n - 3, n - 1, -1):
            depth[x] = depth[up[x]] + 1
        self.length = depth[up[:n]] + 1 if n > 1 else np.zeros(1, np.int64)
        self.start = np.cumsum(self.length) - self.length
        # The way to each leaf: twice the inner node, and one more where it goes on to the right.
        path = np.zeros(self.length.sum() + 1, np.int32)
        at, leaf, left = np.arange(n), np.arange(n), self.length.copy()
        while len(leaf := leaf[left[leaf] > 0]):
            left[leaf] -= 1
            place = self.start[leaf] + left[leaf]
            path[place] = 2 * (up[at[leaf]] - n) + side[at[leaf]]
            at[leaf] = up[at[leaf]]
        # Nodes are counted by threes of a way, whose seven counts lie side by side: between the node and the bit are three bits that say
        # which of the seven it is (1, then 2 and 3, then 4 to 7). The bits of a way are a number, too, from the highest bit down: ways of
        # more than 64 bits would take 10^13 tokens.
        place, side = np.arange(len(path) - 1) - np.repeat(self.start, self.length), path & 1
        before = [np.concatenate([np.zeros(k, np.int32), side])[: len(place)] for k in (1, 2)]
        seventh = np.choose(place % 3, [1, 2 + before[0], 4 + 2 * before[1] + before[0]])
        self.way = np.zeros(len(path), np.int32)
        self.way[:-1] = path[:-1] >> 1 << 4 | seventh << 1 | side[:-1]
        self.code = np.zeros(n, np.uint64)
        np.bitwise_or.at(self.code, np.repeat(np.arange(n), self.length), side[:-1].astype(np.uint64) << np.clip(63 - place, 0, 63).astype(np.uint64))
        with np.errstate(over="ignore"):
            self.hashes = mix(np.arange(1, n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    @property
    def path(self) -> np.ndarray:
        return self.way >> 4 << 1 | self.way & 1

    def common(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many bits the ways to two leaves begin with that are the same; for the same leaf all."""
        apart = self.code[one] ^ self.code[other]
        apart &= ~(apart >> np.uint64(1))  # so that a float has the right exponent
        return np.where(one == other, self.length[one], 64 - np.frexp(apart.astype(np.float64))[1])

    @staticmethod
    def key(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return (words >> np.uint64(32) << np.uint64(32)) | np.minimum(counts, (1 << 32) - 1).astype(np.uint64)

    def leaves(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        key = self.key(words, counts)
        at = np.searchsorted(self.keys, key)
        frequent = np.append(self.keys, np.uint64(0))[at] == key
        other = self.bucket[(words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        return np.where(counts == 0, 0, np.where(frequent & (at < len(self.keys)), at + 1, other))


#: A pair of counts is one number: zeros in its lower half, and a one counts this much. Counts of a table stay below 2^30.
PAIR = 1 << 32


class Runs:
    """Places in the order of their keys (equal keys in their own order): `size` and `ones` are how many places each
    run has, and how many of these have a one."""

    def __init__(self, key: np.ndarray, bit: np.ndarray):
        n = len(key)
        self.shift = np.int64(max(int(n - 1).bit_length(), 1) + 1)
        self.order = key << self.shift  # with the place and the bit below, all are sorted by one sort of numbers
        self.order |= np.arange(0, 2 * n, 2)
        self.order |= bit
        self.order.sort()
        sorted_ = self.order >> self.shift
        self.new = np.ones(n + 1, bool)
        np.not_equal(sorted_[1:], sorted_[:-1], out=self.new[1:-1])

    def shared(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The places that don't have their key alone: the place, the pair of counts that its run has before it, the run's pair in all, and the key."""
        kept = self.new[1:] & self.new[:-1]
        kept = np.flatnonzero(np.logical_not(kept, out=kept))
        order, new = self.order.take(kept), self.new.take(kept)
        own = order & 1
        own *= PAIR - 1
        own += 1
        total = np.cumsum(own)
        last = total[-1:].copy()
        total -= own
        begin = total.take(np.flatnonzero(new))
        run = np.cumsum(new)
        run -= 1
        total -= begin.take(run)
        key = order >> self.shift
        order &= (1 << self.shift) - 1
        order >>= 1
        return order, total, np.diff(begin, append=last).take(run), key

    @property
    def size(self) -> np.ndarray:
        return np.diff(np.flatnonzero(self.new))

    @property
    def ones(self) -> np.ndarray:
        return np.add.reduceat(self.order & 1, np.flatnonzero(self.new[:-1])) if len(self.order) else self.order

    def spread(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each place a row: how many zeros and ones its run has before it, and two numbers that its run has."""
        out, run = np.zeros((len(self.order), 4), np.float32), np.cumsum(self.new[:-1]) - 1
        out[(self.order & (1 << self.shift) - 1) >> 1, 2:] = np.stack([a, b], axis=1)[run]
        at, before, _, _ = self.shared()
        out[at, :2] = before.view(np.int32).reshape(-1, 2)
        return out


def repeated(key: np.ndarray) -> np.ndarray:
    """Whether a key may come more than once: where the upper 46 bits of another are the same."""
    shift = np.uint64(max(int(len(key) - 1).bit_length(), 18))
    order = key >> shift << shift
    order |= np.arange(len(key), dtype=np.uint64)
    order.sort()
    at = (order & ((np.uint64(1) << shift) - np.uint64(1))).view(np.int64)
    order >>= shift
    same = order[1:] == order[:-1]
    out = np.zeros(len(key), bool)
    out[at[1:]] = same
    out[at[:-1]] |= same
    return out


class Mixer:
    """Mixes log-odds by gated weights and refines the mix by an adaptive map. What is learnt is sums alone."""

    BINS = 24

    def __init__(self, inputs: int, gates: int):
        width = inputs + 1
        self.even = np.full(width, 1 / inputs)
        self.even[-1] = 0
        self.slope, self.curve = np.zeros((gates, width)), np.zeros((gates, width, width))
        self.came = np.zeros((2, gates, self.BINS + 1))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.settle()

    def settle(self) -> None:
        """The weights and the map that the sums of the second pass give; without any, even weights and the mix itself."""
        self.add()
        # The prior holds the weights of a gate that has seen little near even ones. Rounding takes out the order of summation.
        step = np.linalg.solve(self.curve + 20 * np.eye(len(self.even)), self.slope[:, :, None])[:, :, 0]
        self.weights = np.round(self.even + step, 6)
        centre = squash((np.arange(self.BINS + 1) - self.BINS / 2) * 0.75)
        seen = np.stack([1 - centre, centre])[:, None, :] * 8 + self.came
        self.chance = (seen[1] / seen.sum(axis=0)).astype(np.float32)

    def even_mix(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Column by column: what a place gets may not depend on its neighbours, as it may in a product of matrices.
        even = x[0].copy()
        for v in x[1:-1]:
            even += v
        even = np.clip(even * np.float32(self.even[0]), -8.9, 8.9)
        at = even / np.float32(0.75) + np.float32(self.BINS / 2)
        left = at.astype(np.int32)
        return even, left, at - left

    def fit(self, x: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> None:
        """Learns the weights and the map; what is added to the sums at once is a few groups, as each gate has its own."""
        self.waiting.append((x, gate, bit.astype(np.float32)))
        if sum(len(b) for _, _, b in self.waiting) > 1 << 16:
            self.add()

    def add(self) -> None:
        if not self.waiting:
            return
        x, gate, bit = (np.concatenate(v, axis=-1) for v in zip(*self.waiting))
        self.waiting = []
        even, left, w = self.even_mix(x)
        p = squash(even)
        order = np.argsort(gate, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=len(self.weights)))])
        wide = len(x)
        moved = np.empty((wide + 2, len(gate)), np.float32)
        for row, v in zip(moved, (*x, p * (1 - p), bit - p)):
            np.take(v, order, out=row, mode="clip")
        for g in np.flatnonzero(np.diff(cuts)):
            own = moved[:, cuts[g] : cuts[g + 1]].astype(np.float64)
            right = own[:wide] * own[wide]
            self.curve[g] += own[:wide] @ right.T
            self.slope[g] += own[:wide] @ own[wide + 1]
        left += w >= 0.5
        size = self.came.shape
        left += gate.astype(np.int32) * np.int32(size[2])
        left += bit.astype(np.int32) * np.int32(size[1] * size[2])
        self.came += np.bincount(left, minlength=self.came.size).reshape(size)

    def probability(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """Of a one."""
        _, left, w = self.even_mix(x)
        weights, gate = np.ascontiguousarray(self.weights.astype(np.float32).T), gate.astype(np.int64)
        mixed = weights[0].take(gate)
        mixed *= x[0]
        part = np.empty_like(mixed)
        for k in range(1, len(x)):
            np.take(weights[k], gate, out=part, mode="clip")
            part *= x[k]
            mixed += part
        gate *= self.BINS + 1
        gate += left
        refined, flat = self.chance.ravel().take(gate), self.chance.ravel()
        gate += 1
        np.take(flat, gate, out=part, mode="clip")
        part -= refined
        part *= w
        refined += part
        np.clip(mixed, -12, 12, out=mixed)
        np.negative(mixed, out=mixed)
        np.exp(mixed, out=mixed)
        mixed += 1
        refined += 1 / mixed
        refined *= np.float32(0.5)
        return np.clip(refined, np.float32(1e-5), np.float32(1 - 1e-5), out=refined)


def in_order(key: np.ndarray) -> np.ndarray:
    """A stable argsort of numbers of up to 32 bits: with their places below them they are sorted themselves, which is much faster."""
    shift = np.int64(max(int(len(key) - 1).bit_length(), 1))
    order = key.astype(np.int64) << shift
    order |= np.arange(len(key))
    order.sort()
    return order & ((1 << shift) - 1)


def levels(n: np.ndarray, *least: int) -> np.ndarray:
    """How many of `least` each number reaches."""
    out = np.zeros(len(n), np.uint8)
    for x in least:
        out += n >= x
    return out


def counts_of(pairs: np.ndarray) -> np.ndarray:
    """Zeros and ones of pairs, in turn. Of halved counts a text may take more than there are; none is below zero."""
    out = pairs.view(np.int32).astype(np.float32)
    return np.maximum(out, 0, out=out)


def halved(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts, both of a pair halved until they are below 2^30."""
    if counts.dtype == np.int32 or counts.max(initial=0) < 1 << 30:
        return counts.astype(np.int32, copy=False)
    most = np.repeat(counts.reshape(-1, 2).max(axis=1), 2)
    return (counts >> np.maximum(np.frexp(most.astype(np.float64))[1] - 30, 0)).astype(np.int32)


def keep_memory() -> None:
    """Has the C library keep what is freed for the next group: it does so up to twice the largest block that it has had back."""
    np.empty(31 << 17)


def aligned(n: int, kind: type) -> np.ndarray:
    """Zeros that begin with a line of the cache, in memory of NumPy's own, for which it asks large pages."""
    raw = np.zeros(n * np.dtype(kind).itemsize + 64, np.uint8)
    skip = -raw.ctypes.data % 64
    return raw[skip : skip + n * np.dtype(kind).itemsize].view(kind)


class Model:
    #: What is summed in each pass.
    PAIRS = ("zero", "one", "two")
    SUMS = {"count": ("zero", "one", "two", "match"), "fit": ("slope", "curve", "came")}

    def __init__(self, total: int, distinct: int, tree: Tree | None = None):
        self.total, self.distinct, self.tree = total, distinct, tree
        self.mixer = Mixer(5, 96)
        if tree:
            self.zero, self.match = np.zeros(2 * max(tree.size, 1), np.int64), np.zeros(7 * 16 * 4, np.int64)
            self.pairs: dict[str, np.ndarray] = {}

    def ready(self, task: str) -> Model:
        """With empty tables, to be learnt, in the first pass."""
        if task == "count":
            self.one, self.two = aligned(2 << TABLE_BITS, np.int32), aligned(2 << TABLE_BITS, np.int32)
        return self

    def sums(self, task: str) -> Iterator[tuple[str, np.ndarray]]:
        """The sums of a pass, by name."""
        self.mixer.add()
        for kind in self.SUMS[task]:
            yield kind, getattr(self if task == "count" else self.mixer, kind).ravel()

    def take(self, sums: dict[str, np.ndarray]) -> None:
        """Takes the sums over all training documents for its own; tables of pairs may be given in parts, as planes and their lengths."""
        for kind, value in sums.items():
            if kind in self.SUMS["count"]:
                setattr(self, kind, value)
                if kind in self.PAIRS:
                    parts = [value] if isinstance(value, np.ndarray) else value
                    n, low = sum(len(v) if isinstance(v, np.ndarray) else v[1] for v in parts), 0
                    pairs = self.pairs[kind] = aligned(n // 2, np.int64)
                    for v in parts:
                        v = (halved(v) if isinstance(v, np.ndarray) else unplaned(*v, np.int32)).view(np.int64)
                        pairs[low : low + len(v)] = v
                        low += len(v)
            else:
                setattr(self.mixer, kind, value.reshape(getattr(self.mixer, kind).shape))
        self.mixer.settle()

    def score(self, words: np.ndarray, begin: np.ndarray, count: np.ndarray, learn: np.ndarray, task: str = "score", leaf: np.ndarray | None = None, ids: np.ndarray | None = None) -> np.ndarray:
        """Natural log probabilities of the tokens of texts. Words are told apart by all 64 bits, and are contexts by the upper 32.
        `learn` marks texts of training documents; tasks "count" and "fit" are given no others, and give no probabilities. `leaf` is
        each token's leaf of the tree, by its word and count if not given, and `ids` are small numbers that tell words apart, if there
        are any. Without a tree all tokens are in one leaf."""
        if self.tree is None:
            return np.log((count + 1) / (self.total + self.distinct + 1))
        tree, n = self.tree, len(words)
        leaf = tree.leaves(words, count) if leaf is None else leaf
        doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        t = np.arange(n) - begin[doc]
        order = np.argsort(words, kind="stable") if ids is None else in_order(ids)  # by text, too, as texts follow each other
        same = (words[order[1:]] == words[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        last = np.full(n, -1)
        last[order[1:]] = np.where(same, order[:-1], -1)
        # The token that followed the last occurrence of the predecessor, and how many tokens before it are the same.
        back = np.where(t > 0, last[np.maximum(np.arange(n) - 1, 0)], -1)
        has = back >= 0
        length, on = has.astype(np.int64), np.flatnonzero(has)
        for k in range(1, 6):
            on = on[t[back[on]] >= k]
            on = on[words[on - 1 - k] == words[back[on] - k]]
            length[on] += 1

        # One row a bit from here on.
        size = tree.length[leaf]
        offset = np.cumsum(size) - size
        token = np.repeat(np.arange(n), size)
        if not len(token):
            return np.where(leaf > 0, np.log((count + 1) / tree.mass[leaf]), 0)
        at = (tree.start[leaf] - offset).take(token)
        at += np.arange(len(at))
        way = tree.way.take(at).astype(np.int64)
        bit = way & 1
        # The threes of ways: where each begins, and its hash under the contexts.
        threes = (size + 2) // 3
        of_three = np.repeat(np.arange(n), threes)
        first = (offset - 3 * (np.cumsum(threes) - threes)).take(of_three)
        first += 3 * np.arange(len(first))
        new = np.zeros(len(way), np.int64)
        new[first] = 1
        three = np.cumsum(new)
        three -= 1
        context = words >> np.uint64(32)
        with np.errstate(over="ignore"):
            previous = np.where(t > 0, np.roll(context, 1), np.uint64(1) << np.uint64(33))
            second = np.where(t > 1, np.roll(context, 2), np.uint64(1) << np.uint64(34))
            contexts = (mix(previous + np.uint64(0xD6E8FEB86659FD93)), mix(previous * np.uint64(0x9E3779B97F4A7C15) + second))
            pairs = contexts[1] + doc.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            hashed, lines = tree.hashes.take(way.take(first) >> 4), []
            for h in contexts:
                h = h.take(of_three)
                h ^= hashed
                h *= np.uint64(0xBF58476D1CE4E5B9)
                h >>= np.uint64(64 - TABLE_BITS)
                lines.append(h.view(np.int64))
        # The way on that the token guessed would take, while its way so far is the same.
        on = np.flatnonzero(has)
        shared = tree.common(leaf[on], leaf[back[on] + 1])
        told = np.minimum(shared + 1, size[on])
        which = np.repeat(np.arange(len(on)), told)
        place = np.arange(len(which)) - (np.cumsum(told) - told).take(which)
        m = offset[on].take(which) + place
        came = bit.take(m)
        other = came ^ (place == shared.take(which))
        known = length[on].take(which)
        mslot = (known * 16 + np.minimum(place, 15)) * 2 + other
        if task == "count":
            self.zero += np.bincount((way >> 4 << 1) + bit, minlength=len(self.zero))
            self.match += np.bincount(mslot * 2 + came, minlength=len(self.match))
            way &= 15
            for table, line in ((self.one, lines[0]), (self.two, lines[1])):
                slot = (line << 1).take(three)
                slot ^= way
                np.add.at(table, slot, np.int32(1))
            return np.zeros(n)

        node, source = way >> 4, doc.take(token)
        x = np.empty((6, len(bit)), np.float32)
        half = np.float32(0.5)
        # Each place's own bit as a pair of counts, which the tables have of training texts.
        own = bit * (PAIR - 1)
        own += 1
        if not learn.all():
            own *= learn.take(source)
        # The node's counts less what the text has of its own there, and what of it comes before.
        both, before = self.pairs["zero"].take(node), np.zeros(len(bit), np.int64)
        both -= own
        source <<= 20
        source |= node
        at, text, whole, key = Runs(source, bit).shared()
        before[at] = text
        whole *= learn.take(key >> 20)
        both[at] += own.take(at) - whole
        both = counts_of(both)
        both += half
        zero, one = both[::2], both[1::2]
        np.log(one / zero, out=x[0])
        finer = one + zero
        np.divide(one, finer, out=finer)
        finer *= 2
        np.clip(finer, np.float32(1e-6), np.float32(2 - 1e-6), out=finer)
        before = before.view(np.int32).astype(np.float32)
        in_text = before[::2] + before[1::2]
        one = before[1::2] + finer
        zero = 2 - finer
        zero += before[::2]
        np.log(one / zero, out=x[1])
        gate = levels(in_text, 1, 3, 15)
        gate <<= 1
        here = np.zeros(n, bool)
        here[order[1:]] = same
        here[order[:-1]] |= same
        many_of = (np.roll(here, 1) & (t > 0), repeated(pairs))
        way >>= 1
        way &= 7
        docs = (doc << TABLE_BITS).take(of_three)
        for k, line in enumerate(lines):
            slot = line.take(three)
            slot ^= way
            # A context that the text has once has added this bit alone; others have added what the text has under them, and learn it as it goes.
            both = self.pairs[self.PAIRS[1 + k]].take(slot)
            both -= own
            many = np.flatnonzero(many_of[k].take(token))
            slot = slot.take(many)
            slot |= docs.take(three.take(many))
            at, text, whole, key = Runs(slot, bit.take(many)).shared()
            at = many.take(at)
            whole *= learn.take(key >> TABLE_BITS)
            text -= whole
            text += own.take(at)
            both[at] += text
            both = counts_of(both)
            zero, one = both[::2], both[1::2]
            seen = zero + one
            if k:
                gate += seen >= 1
            else:
                gate += levels(seen, 1, 4, 32) << 3
            one = one + finer
            np.subtract(2, finer, out=finer)
            finer += zero
            np.divide(one, finer, out=finer)
            np.log(finer, out=x[2 + k])
            if not k:
                seen += 2
                finer = np.divide(one, seen, out=one)
                finer *= 2
                np.clip(finer, np.float32(1e-6), np.float32(2 - 1e-6), out=finer)
        x[4] = x[0]
        wide = len(self.match)
        of = doc[on].take(which)
        off = of * wide + mslot * 2
        mine, seen = np.bincount(off + came, minlength=wide * (len(begin) - 1)).astype(np.float32), learn.astype(np.float32).take(of)
        zero, one = (np.maximum(self.match[mslot * 2 + k].astype(np.float32) - mine[off + k] * seen, 0) + half for k in (0, 1))
        x[4, m] = np.log(one / zero)
        x[5] = 0.3
        np.clip(x[:5], -12, 12, out=x[:5])
        gate[m] += ((known > 2).astype(np.uint8) + np.uint8(1)) << 5
        if task == "fit":
            self.mixer.fit(x, gate, bit)
            return np.zeros(n)
        p = self.mixer.probability(x, gate)
        # Of what came: p, or 1 - p.
        p -= (1 - bit).astype(np.float32)
        np.log(np.abs(p, out=p), out=p)
        out = np.add.reduceat(p, offset, dtype=np.float64)
        # What tells a word from the others of its leaf.
        return out + np.where(leaf > 0, np.log((count + 1) / tree.mass[leaf]), 0)


#: A piece: neighbouring texts of a lot, their distinct tokens (32 bits of each hash, and training counts) with the most frequent
#: first, and each token's place among these, whose four bytes are four runs that compress well.
PIECE = "doc_id array<bigint>, held array<boolean>, n_bytes array<bigint>, n_tokens array<bigint>, distinct binary, counts binary, ids binary"


def packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def planes(x: np.ndarray) -> bytes:
    """Numbers with the bytes of each rank together: they compress, as most counts are small."""
    return packed(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T))


def unplaned(data: bytes | pa.Buffer, n: int, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    ranks = np.frombuffer(pa.decompress(data, wide * n, codec="zstd", asbytes=True), np.uint8).reshape(wide, -1)
    return np.ascontiguousarray(ranks.T).view(kind).ravel()


def coded(texts: pa.Table, vocabulary: np.ndarray, counts: np.ndarray) -> pa.Table:
    """The pieces of a lot's texts; `vocabulary` ascends and holds all the lot's token hashes, `counts` their counts in training."""
    data, offsets = utf8(texts.column("text"))
    ids, held = texts.column("doc_id").to_pylist(), texts.column("held").to_pylist()
    rows: dict[str, list] = {c.strip().split()[0]: [] for c in PIECE.split(",")}
    for i, j in pieces(offsets):
        words, begin = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        at = np.searchsorted(vocabulary, words)
        if len(words) and (at.max() >= len(vocabulary) or (vocabulary[at] != words).any()):
            raise RuntimeError("the texts of a lot changed between two reads of the input; write it to a table first")
        seen = np.bincount(at, minlength=len(vocabulary))
        used = np.flatnonzero(seen)
        used = used[np.argsort(-seen[used], kind="stable")]
        place = np.zeros(len(vocabulary), np.uint32)
        place[used] = np.arange(len(used))
        runs = np.ascontiguousarray(place[at].view(np.uint8).reshape(-1, 4).T)
        own = (ids[i:j], held[i:j], np.diff(offsets[i : j + 1]), np.diff(begin), (vocabulary[used] >> np.uint64(32)).astype(np.uint32).tobytes(), packed(counts[used]), packed(runs))
        for name, value in zip(rows, own):
            rows[name].append(value)
    kinds = [pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
    return pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))


def run_piece(model: Model, piece: dict, task: str) -> dict[str, np.ndarray]:
    """Learns from a piece's training texts, or scores all its texts."""
    held, sizes = np.array(piece["held"], bool), np.array(piece["n_tokens"], np.int64)
    unpacked = lambda x, n: np.frombuffer(pa.decompress(x, n, codec="zstd", asbytes=True), np.uint8)
    ids = np.ascontiguousarray(unpacked(piece["ids"], 4 * int(sizes.sum())).reshape(4, -1).T).view(np.uint32).ravel()
    distinct = np.frombuffer(piece["distinct"], np.uint32).astype(np.uint64) << np.uint64(32)
    # The place, in the lower half, tells apart words whose upper halves are the same.
    words = (distinct | np.arange(len(distinct), dtype=np.uint64))[ids]
    c = unpacked(piece["counts"], 8 * len(distinct)).view(np.int64)[ids]
    begin = np.concatenate([[0], np.cumsum(sizes)])
    leaf = None
    if model.tree:
        row = np.repeat(np.arange(len(sizes)), sizes)
        leaf = model.tree.leaves(distinct, unpacked(piece["counts"], 8 * len(distinct)).view(np.int64))[ids]
        # A word that only this training document has is unknown to the others: with the document left out it is the unknown word.
        maybe = np.flatnonzero(~held[row] & (c <= sizes[row]))
        _, which, n = np.unique(row[maybe] * len(distinct) + ids[maybe], return_inverse=True, return_counts=True)
        leaf[maybe[n[which] == c[maybe]]] = 0
    # Long texts are modelled in segments, short ones in groups of neighbours.
    groups, tokens_ = [], GROUP
    for d in np.flatnonzero(~held) if task != "score" else range(len(sizes)):
        for low in range(begin[d], begin[d + 1], SEGMENT):
            high = min(low + SEGMENT, begin[d + 1])
            if tokens_ + high - low > GROUP or groups[-1][-1][1] != low:
                groups.append([])
                tokens_ = 0
            groups[-1].append((low, high, d))
            tokens_ += high - low
    logs = np.zeros(len(words))
    for group in groups:
        low, high = group[0][0], group[-1][1]
        cuts, owner = np.array([g[0] for g in group] + [high]) - low, [g[2] for g in group]
        logs[low:high] = model.score(words[low:high], cuts, c[low:high], ~held[owner], task, None if leaf is None else leaf[low:high], ids[low:high])
    if task != "score":
        return {}
    n = len(sizes)
    row = np.repeat(np.arange(n), sizes)
    found = {"n_tokens": sizes, "n_known": np.bincount(row, c > 0, minlength=n).astype(np.int64)}
    found["base_score"] = np.bincount(row, np.log10((c + 1) / (model.total + model.distinct + 1)), minlength=n)
    found["score"] = np.bincount(row, logs, minlength=n) / np.log(10)
    size = np.array(piece["n_bytes"], np.int64)
    return found | {"held_out": held, "n_bytes": size, "bits_per_byte": -found["score"] * np.log2(10) / np.maximum(size, 1)}


def learnt(table: DataFrame, total: int, distinct: int, tree: Broadcast, task: str, before: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The sums of a pass over the training texts of all pieces, given those of the pass before."""
    spark = table.sparkSession
    given = spark.sparkContext.broadcast(before)
    kind = np.int64 if task == "count" else np.float64

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        model, any_ = Model(total, distinct, tree.value).ready(task), False
        model.take(given.value)
        for batch in batches:
            for k in range(batch.num_rows):
                run_piece(model, batch.slice(k, 1).to_pylist()[0], task)
                any_ = True
        if any_:
            for name, value in model.sums(task):
                for low in range(0, len(value), CHUNK):
                    own = value[low : low + CHUNK].astype(kind)
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([low]), pa.array([len(own)]), pa.array([planes(own)], pa.binary())], ["name", "low", "n", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        n = parts.column("n")[0].as_py()
        whole = np.zeros(n, kind)
        for x in parts.column("sums"):
            whole += unplaned(x.as_buffer(), n, kind)
        return pa.table({"name": parts.column("name")[:1], "low": parts.column("low")[:1], "sums": pa.array([planes(whole)], pa.binary()), "n": pa.array([n])})

    # The tables of the first pass are large: no more tasks than the cores can run twice over give one.
    dealt = table.coalesce(2 * spark.sparkContext.defaultParallelism) if task == "count" else table
    sums = dealt.mapInArrow(part, "name string, low bigint, n bigint, sums binary")
    rows = sums.groupBy("name", "low").applyInArrow(add, "name string, low bigint, sums binary, n bigint").collect()
    given.unpersist()
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r["low"]):
        value = unplaned(bytes(r["sums"]), r["n"], kind)
        # The large tables are sent as planes: a broadcast lies on the disk of the driver and of each executor, and in each worker.
        found.setdefault(r["name"], []).append((planes(halved(value)), len(value)) if r["name"] in ("one", "two") else value)
    return before | {name: values if name in ("one", "two") else np.concatenate(values) for name, values in found.items()}


def lots(documents: DataFrame, lot_bytes: int) -> DataFrame:
    """doc_id, held, text and the lot of each row: neighbouring rows of one input partition, of about lot_bytes together.

    A lot is a run of as many rows as make lot_bytes on average. Rows of more than eight times the mean size have lots of their
    own, over shorter runs the larger they are, so that no lot has many times lot_bytes.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    whole = documents.agg(F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    mean = max((whole["bytes"] or 0) / max(whole["rows"], 1), 1)
    rows = max(int(lot_bytes / mean), 1)
    place = F.monotonically_increasing_id()  # the partition from bit 33 on, then the row
    octaves = F.least(F.greatest(F.floor(F.log2((size + 1) / mean)), F.lit(0)), F.lit(40)).cast("int")
    octave = F.when(octaves >= 3, octaves).otherwise(F.lit(0))
    run = F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / F.greatest(F.floor(F.lit(rows) / F.pow(F.lit(2.0), octave)), F.lit(1)))
    lot = F.shiftleft(F.shiftright(place, 33), 38).bitwiseOR(F.shiftleft(octave.cast("bigint"), 32)).bitwiseOR(run.cast("bigint"))
    return documents.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held"), F.coalesce("text", F.lit("")).alias("text"), lot.alias("lot"))


def score(documents: DataFrame, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte for each row of `documents`.

    A null or empty text has the end token alone. A null doc_id is a training document. Repeated rows are trained on and scored
    each. Without training documents N and V are 0 and every token has probability one in the base. Only doc_id and text are read;
    `documents` is read twice and must come out in the same partitions, as a table of files does (else this is found, and raised).
    """
    dealt = lots(documents, lot_bytes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # By lot, the tokens of training and of held-out texts. Few lots are open at a time; when they hold much, all are let go.
        open_: dict[int, tuple[list, list]] = {}
        held_tokens = 0

        def emit() -> Iterator[pa.RecordBatch]:
            for lot, (train, rest) in open_.items():
                words, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *train]), return_counts=True)
                more = np.setdiff1d(np.concatenate([np.zeros(0, np.uint64), *rest]), words)
                words, n = np.concatenate([words, more]), np.concatenate([n, np.zeros(len(more), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), lot)), pa.array(words.view(np.int64)), pa.array(n)], ["lot", "word", "n"])
            open_.clear()

        for batch in batches:
            data, offsets = utf8(batch.column(2))
            held, lot = batch.column(1).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy()
            for i, j in pieces(offsets):
                own, begin = tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                mark = np.repeat(lot[i:j] * 2 + held[i:j], np.diff(begin))
                for m in np.unique(mark):
                    open_.setdefault(int(m >> 1), ([], []))[int(m & 1)].append(own[mark == m])
                held_tokens += len(own)
                if held_tokens > 2_000_000:
                    yield from emit()
                    held_tokens = 0
        yield from emit()

    by_lot = written(dealt.mapInArrow(count, "lot bigint, word bigint, n bigint"), "lot-words")
    corpus = written(by_lot.groupBy("word").agg(F.sum("n").alias("c")), "corpus-words")
    whole = corpus.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    total, distinct = int(whole["n"]), int(whole["v"])
    # The most frequent words are in nearly every lot: their counts are sent to all tasks, and only the others are joined and dealt.
    top = most_frequent(corpus, "c", FREQUENT).toPandas()
    frequent = documents.sparkSession.sparkContext.broadcast((top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)))
    rare_words = by_lot.select("lot", "word").join(F.broadcast(most_frequent(corpus, "c", FREQUENT).select("word")), "word", "left_anti")
    vocabulary = rare_words.join(corpus.hint("merge"), "word").select("lot", "word", "c")

    def code(texts: pa.Table, words: pa.Table) -> pa.Table:
        hashes = np.concatenate([words.column("word").to_numpy().view(np.uint64), frequent.value[0]])
        counts = np.concatenate([words.column("c").to_numpy(), frequent.value[1]])
        hashes, order = np.unique(hashes, return_index=True)
        return coded(texts, hashes, counts[order])

    known = corpus.where("c > 0").join(F.broadcast(most_frequent(corpus, "c", FREQUENT).select("word")), "word", "left_anti")
    others = known.groupBy(F.shiftrightunsigned("word", 64 - BUCKET_BITS).alias("b")).agg(F.sum(F.col("c") + 1).alias("mass")).collect()
    buckets = np.zeros(1 << BUCKET_BITS)
    buckets[[r["b"] for r in others]] = [r["mass"] for r in others]
    tree = documents.sparkSession.sparkContext.broadcast(Tree(*frequent.value, buckets, int(whole["once"])))
    table = written(dealt.groupBy("lot").cogroup(vocabulary.groupBy("lot")).applyInArrow(code, PIECE), "pieces")
    for old in (by_lot, corpus):
        drop_written(documents.sparkSession, old)
    state: dict[str, np.ndarray] = {}
    for task in ("count", "fit"):
        state = learnt(table, total, distinct, tree, task, state)
    merged = documents.sparkSession.sparkContext.broadcast(state)
    names = [c.split()[0] for c in OUT.split(", ")]

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        model = Model(total, distinct, tree.value)
        model.take(merged.value)
        for batch in batches:
            for k in range(batch.num_rows):
                piece = batch.slice(k, 1).to_pylist()[0]
                got = run_piece(model, piece, "score")
                got |= {"doc_id": pa.array(piece["doc_id"], pa.int64()), "train_tokens": np.full(len(piece["doc_id"]), total, np.int64)}
                yield pa.RecordBatch.from_arrays([pa.array(got[k]) for k in names], names)

    return table.mapInArrow(scores, OUT)
