"""Periodic runs of words: repetitions that no neighbouring word extends, found from a text's squares."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.shared import map_batches
from tradewind.llm.words import sliced, words

#: A run has at least so many words and so many times its period.
LEAST, TIMES = 6, 4


class SuffixTree:
    """The suffixes of several sequences at once, each ended by a mark of its own.

    Nodes are kept as a suffix array does: rank[k] gives equal numbers to places whose next 2^k words are equal, in the
    order of the words, so a node of depth m is the stretch of the sorted suffixes that share m words. Places whose
    words occur once are not sorted further; no level is made beyond the longest repeated stretch.
    """

    def __init__(self, sequences: Sequence[np.ndarray]):
        sizes = np.array([len(s) for s in sequences], np.int64)
        self.first = np.cumsum(sizes + 1) - sizes  # one mark before everything, one behind each sequence
        n = int(sizes.sum()) + len(sizes) + 1
        owner = np.zeros(n, np.int64)
        letters = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[0] = False
        inside[self.first + sizes] = False
        owner[inside] = np.repeat(np.arange(len(sizes)), sizes)
        owner[self.first + sizes] = np.arange(len(sizes))
        if len(sizes):
            letters[inside] = np.concatenate(sequences) + 1
        letters[self.first + sizes] = 0
        owner[0] = -1
        self.n, self.inside, self.owner = n, inside, owner
        key = owner * (int(letters.max(initial=0)) + 1) + letters
        order = np.argsort(key, kind="stable")
        rank, repeated = self._ranks(key[order], order)
        self.rank = [rank]
        while len(repeated):
            # Places of one rank lie side by side in order; each group is sorted by what follows and renumbered.
            step = 1 << (len(self.rank) - 1)
            old = rank[repeated]
            key = old * n + rank[repeated + step]
            place = np.argsort(key, kind="stable")
            moved, key, old = repeated[place], key[place], old[place]
            at = np.arange(len(key))
            new_group = np.r_[True, old[1:] != old[:-1]]
            new_rank = np.r_[True, key[1:] != key[:-1]]
            within = at - np.maximum.accumulate(np.where(new_group, at, 0))
            own = old + np.maximum.accumulate(np.where(new_rank, at, 0)) - (at - within)
            rank = rank.copy()
            rank[moved] = own
            self.rank.append(rank)
            same = np.r_[False, key[1:] == key[:-1]]
            same[:-1] |= same[1:]
            repeated = moved[same]
        self.order = np.argsort(rank, kind="stable")

    def _ranks(self, key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank = np.zeros(len(key), np.int64)
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        same = ~fresh
        same[:-1] |= same[1:]
        return rank, order[same]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on are those from j on (i and j apart)."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.rank) - 1, -1, -1):
            step = (self.rank[k][i] == self.rank[k][j]).astype(np.int64) << k
            i += step
            j += step
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i are those before j."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.rank) - 1, -1, -1):
            size = 1 << k
            fits = (i >= size) & (j >= size)
            step = (fits & (self.rank[k][np.maximum(i - size, 0)] == self.rank[k][np.maximum(j - size, 0)])).astype(np.int64) << k
            i -= step
            j -= step
        return start - i

    def node(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers that are equal if and only if the next so many words from i on are equal, for depths of one at least."""
        level = np.frexp(depth.astype(float))[1].astype(np.int64) - 1
        head, tail = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            rank = self.rank[min(k, len(self.rank) - 1)]  # beyond the last level every place is alone
            head[at], tail[at] = rank[i[at]], rank[i[at] + depth[at] - (1 << k)]
        return depth, head, tail

    def below(self, i: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of order that holds every place whose next so many words are those from i on."""
        own = self.rank[-1][i]
        _, head, tail = self.node(i, depth)

        def same(at: np.ndarray) -> np.ndarray:
            there = self.order[np.clip(at, 0, self.n - 1)]
            fits = (at >= 0) & (at < self.n) & (there + depth < self.n)
            _, h, t = self.node(np.where(fits, there, i), depth)
            return fits & (h == head) & (t == tail)

        ends = []
        for sign in (-1, 1):
            reach, step = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
            growing = np.ones(len(i), bool)
            while growing.any():  # doubling steps while the node goes on, then halving ones
                growing &= same(own + sign * (reach + step))
                reach += np.where(growing, step, 0)
                step = np.where(growing, step * 2, step)
            while (step > 0).any():
                further = (step > 0) & same(own + sign * (reach + step))
                reach += np.where(further, step, 0)
                step //= 2
            ends.append(own + sign * reach)
        return ends[0], ends[1] + 1

    def blocks(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of the blocks of each sequence's Lempel-Ziv decomposition: from a place on, the longest stretch
        that occurs from an earlier place of the sequence on, or one word if there is none."""
        place = self.order
        longest = np.zeros(self.n, np.int64)
        for order in (place, place[::-1]):
            near = _before(order)
            has = near >= 0
            i, j = order[has], order[near[has]]
            mine = (self.owner[i] == self.owner[j]) & self.inside[i]
            i, j = i[mine], j[mine]
            longest[i] = np.maximum(longest[i], self.ahead(i, j))
        hop = np.maximum(longest, 1).tolist()
        starts = []
        ends = np.flatnonzero(~self.inside)[1:]
        for a, b in zip(self.first.tolist(), ends.tolist()):
            while a < b:
                starts.append(a)
                a += hop[a]
        starts = np.array(starts, np.int64)
        return starts, starts + np.maximum(longest, 1)[starts]


def _before(values: np.ndarray) -> np.ndarray:
    """For each value the place of the nearest one before it that is less, or -1."""
    near = np.arange(len(values)) - 1
    open_ = np.arange(len(values))
    for _ in range(300):  # jumps along the places found so far; few chains are longer
        open_ = open_[near[open_] >= 0]
        open_ = open_[values[near[open_]] > values[open_]]
        if not len(open_):
            return near
        near[open_] = near[near[open_]]
    out, stack, listed = [], [], values.tolist()
    for k, v in enumerate(listed):
        while stack and listed[stack[-1]] > v:
            stack.pop()
        out.append(stack[-1] if stack else -1)
        stack.append(k)
    return np.array(out, np.int64)


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number): for each size n the numbers 0 to n - 1, with whose they are."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering_squares(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray]:
    """(start, half): squares of which one lies, in the same run and not to the right, for the leftmost occurrence of
    every square of a sequence. Such a square ends in a block or in the next, so only shifts of these lengths are tried:
    from the block's end backwards and from its start forwards, each by how far both sides agree."""
    start, end = tree.blocks()
    size = end - start
    after = np.r_[size[1:], 0]
    after[np.r_[tree.owner[start[1:]] != tree.owner[start[:-1]], True].astype(bool)] = 0
    word = tree.rank[0]
    found = []
    which, k = _spread(size)
    k += 1
    right = end[which]
    left = right - k
    some = word[right] == word[left]
    right, left, k = right[some], left[some], k[some]
    ahead, behind = tree.ahead(right, left), tree.behind(right, left)
    at = np.maximum(left - behind, left - k + 1)
    good = ahead + behind >= k
    found.append((at[good], k[good]))
    which, k = _spread(size + after)
    k += 1
    left = start[which]
    right = left + k
    some = (right <= left + size[which] + after[which]) & (right < tree.n)
    some[some] &= word[right[some]] == word[left[some]]
    some[some] &= word[right[some] - 1] == word[left[some] - 1]
    which, left, right, k = which[some], left[some], right[some], k[some]
    ahead, behind = tree.ahead(right, left), tree.behind(right, left)
    at = np.maximum(left - behind, left - k + 1)
    good = (ahead + behind >= k) & (at + k <= end[which])
    found.append((at[good], k[good]))
    both = np.unique(np.stack([np.concatenate(x) for x in zip(*found)], 1), axis=0)
    return both[:, 0], both[:, 1]


def _primitive(tree: SuffixTree, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether a square's half is no power of a shorter stretch: no prime part of its length is a period of the square."""
    good = np.ones(len(at), bool)

    def test(which: np.ndarray, prime: np.ndarray | int) -> None:
        period = half[which] // prime
        good[which] = tree.ahead(at[which], at[which] + period) < 2 * half[which] - period

    left, rest = np.arange(len(at)), half.copy()
    p = 2
    while len(left):
        done = rest < p * p  # what is left of these lengths is a prime or one
        last = done & (rest > 1)
        test(left[last], rest[last])
        left, rest = left[~done], rest[~done]
        divides = rest % p == 0
        test(left[divides], p)
        while divides.any():
            rest = np.where(divides, rest // p, rest)
            divides = rest % p == 0
        left, rest = left[good[left]], rest[good[left]]
        p += 1
    return good


def runs(sequences: Sequence[np.ndarray], least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, start, length, period) of every run of at least so many words and so many (two at least) periods.

    By linear tandem repeats: Lempel-Ziv blocks give squares that cover every leftmost one; walking on from each, a
    word at a time as suffix links do, to the end of its run gives the vocabulary of squares with primitive halves, each
    a node of the tree; the places below those nodes are all squares of the sequences, and squares of one half at
    neighbouring places merge into a run, which no neighbouring word extends and whose half is its smallest period.
    """
    none = np.zeros(0, np.int64)
    tree = SuffixTree(sequences)
    at, half = covering_squares(tree)
    good = _primitive(tree, at, half)
    at, half = at[good], half[good]
    if not len(at):
        return none, none, none, none
    which, step = _spread(tree.ahead(at, at + half) - half + 1)
    at, half = at[which] + step, half[which]
    _, head, tail = tree.node(at, 2 * half)
    one = np.unique(np.stack([half, head, tail], 1), axis=0, return_index=True)[1]
    at, half = at[one], half[one]
    lo, hi = tree.below(at, 2 * half)
    which, step = _spread(hi - lo)
    at, half = tree.order[lo[which] + step], half[which]
    order = np.lexsort((at, half))
    at, half = at[order], half[order]
    begins = np.r_[True, (half[1:] != half[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(begins)
    last = np.r_[first[1:], len(at)] - 1
    start, period, length = at[first], half[first], at[last] - at[first] + 2 * half[first]
    long = length >= np.maximum(least, times * period)
    start, period, length = start[long], period[long], length[long]
    owner = tree.owner[start]
    start = start - tree.first[owner]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def recurring(found: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Whether some stretch of so many words occurs twice in a text, for each text of found (word numbers) cut at starts."""
    texts = len(starts) - 1
    owner = np.repeat(np.arange(texts), np.diff(starts))
    name = owner * (int(found.max(initial=0)) + 1) + found
    left = np.arange(len(found))
    for k in range(width):
        if k:
            left = left[left + k < starts[owner[left] + 1]]
            name = before[np.searchsorted(kept, left)] * (int(found.max(initial=0)) + 1) + found[left + k]
        if not len(left):
            break
        order = np.argsort(name, kind="stable")
        key = name[order]
        same = np.r_[False, key[1:] == key[:-1]]
        number = np.empty(len(key), np.int64)
        number[order] = np.cumsum(~same)
        same[:-1] |= same[1:]
        again = np.sort(order[same])
        kept, before = left[again], number[again]
        left = kept
    out = np.zeros(texts, bool)
    out[owner[left]] = True
    return out


def detect(docs: DataFrame, columns: str, step: Callable[[pa.RecordBatch, list[list[bytes]], list[list[tuple[int, int, int]]]], pa.RecordBatch], change: Callable[[int | None, list[bytes]], list[bytes] | None] | None = None) -> DataFrame:
    """What step makes of each batch of doc_id, the texts' words and their runs (start, length, period).

    change may give other words for a text of an id. Work stays within the rows of a slice of a batch: nothing is
    shuffled, and a text's runs cost time in proportion to its words, but for logarithms.
    """
    width = min(max(LEAST, TIMES * q) - q for q in range(1, LEAST + 1))

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in sliced(batch):
            names, found, starts = words(part.column("text"))
            spelt = names.cast(pa.large_binary()).to_pylist()
            numbers = [found[a:b].astype(np.int64) for a, b in zip(starts[:-1], starts[1:])]
            if change is not None:
                numbers = [n if (new := change(i, n)) is None else new for i, n in zip(part.column("doc_id").to_pylist(), numbers)]
                found = np.concatenate([np.zeros(0, np.int64), *numbers])
            # A run lies q words behind itself for at least width words, so a text in which no such stretch recurs has none.
            some = np.flatnonzero(recurring(found, starts, width))
            mine: list[list[tuple[int, int, int]]] = [[] for _ in numbers]
            for k, *run in zip(*(x.tolist() for x in runs([numbers[k] for k in some]))) if len(some) else ():
                mine[some[k]].append(tuple(run))
            yield step(part, [[spelt[w] for w in n.tolist()] for n in numbers], mine)

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.Table.from_batches(list(of(batch))).combine_chunks().to_batches()[0]

    return map_batches(docs.select("doc_id", F.col("text").cast("string").alias("text")), ["doc_id", "text"], columns, whole)


def collapsed(found: list[bytes], mine: list[tuple[int, int, int]]) -> bytes:
    """The words joined by spaces, less those that some run contains after its first period."""
    if not mine:
        return b" ".join(found)
    keep = np.ones(len(found), bool)
    for start, length, period in mine:
        keep[start + period : start + length] = False
    return b" ".join(w for w, k in zip(found, keep.tolist()) if k)


def planted(doc_id: int | None, found: np.ndarray) -> np.ndarray | None:
    """For a tenth of the ids, by crc32 of the id, the words with everything behind some place repeating a stretch of
    it; None for the others, for rows without an id and for texts without words."""
    if doc_id is None or not len(found):
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g, n = h // 10, len(found)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[np.r_[0:a, a + np.arange(n - a) % p]]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for every row of docs.

    Rows without a text have no words and no runs: nulls for the greatest run, and the digests of nothing. Rows without
    an id are searched like any other, as they are; repeated rows stay repeated; an empty table gives an empty result;
    other columns are not read.
    """

    def step(batch: pa.RecordBatch, texts: list[list[bytes]], found: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
        greatest = [max(mine, key=lambda r: (r[1], -r[0], -r[2]), default=None) for mine in found]
        column = lambda f: pa.array([None if r is None else f(*r) for r in greatest], pa.int64())
        listed = pa.array([hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in mine).encode()).hexdigest() for mine in found], pa.string())
        whole = pa.array([hashlib.sha256(collapsed(t, mine)).hexdigest() for t, mine in zip(texts, found)], pa.string())
        columns = [batch.column("doc_id").cast(pa.int64()), pa.array([len(x) for x in found], pa.int64()), column(lambda s, n, q: s), column(lambda s, n, q: n), column(lambda s, n, q: q), column(lambda s, n, q: 1000 * n // q), listed, whole]
        return pa.RecordBatch.from_arrays(columns, names="doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split())

    return detect(docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", step, planted)
