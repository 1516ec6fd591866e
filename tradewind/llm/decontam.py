"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming lookup, exact check."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.shared import discard, map_batches, stored, texts, written

SHINGLE = 5
SIMILARITY = 0.8
#: A window at the similarity threshold differs from its item by about 10 bits, by over 19 in under 1 in 1,000 cases.
RADIUS = 19
BLOCKS = (13, 13, 13, 13, 12)
#: Items, and bytes of their texts, that one pass over the documents looks for; a larger benchmark takes several passes.
#: An item takes about 100 bytes, a shingle of it about 40 and a table of at most 64 MB, so a pass's items take some 200 MB a worker.
ITEMS_A_PASS, BYTES_A_PASS = 20_000, 16_000_000

_word = re.compile(r"[^\W_]+")
_mix = np.array([_ | 1 for _ in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)], np.uint64)


@lru_cache(maxsize=1)
def _known() -> WordHashes:
    """The worker's memory of word hashes."""
    return WordHashes()


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_hashes(text: str, known: WordHashes, words: int = SHINGLE) -> np.ndarray:
    """One 64-bit hash a word shingle, in order; a text of fewer words is one shingle, one without words has none."""
    found = _word.findall(text.lower())
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(words, len(h))):
            out = (out ^ h[i : i + n]) * _mix[i % 5]
            out ^= out >> np.uint64(29)
    return out


def simhash(bits: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints from counts of set bits among n hashes, counts in the last axis."""
    return np.packbits(2 * bits > n, axis=-1, bitorder="little").view("<u8")[..., 0]


def unpack(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


class HammingIndex:
    """Fingerprints of items, each of a size class, by the values of five bit blocks.

    Within 19 bits, some block differs by at most three: a lookup tries every value within three bits of a window's
    block, so it misses no item of the class within the radius. An item takes a sorted place in each block's list and
    no more, however many values lie near its own.
    """

    def __init__(self, fingerprints: np.ndarray, sizes: np.ndarray | None = None):
        self.fingerprints = fingerprints
        sizes = np.zeros(len(fingerprints), np.int64) if sizes is None else np.asarray(sizes, np.int64)
        self.starts = np.cumsum((0, *BLOCKS))[:-1].astype(np.uint64)
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start, width in zip(self.starts, BLOCKS):
            near = np.array([sum(1 << b for b in chosen) for k in range(RADIUS // len(BLOCKS) + 1) for chosen in combinations(range(width), k)], np.int64)
            keys = (sizes << 16) | ((fingerprints >> start) & np.uint64((1 << width) - 1)).astype(np.int64)
            order = np.argsort(keys, kind="stable").astype(np.int32)
            self.blocks.append((near, keys[order], order))

    def within(self, windows: np.ndarray, size: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs of items of this size whose fingerprints differ by at most the radius."""
        found = [np.zeros(0, np.int64)]
        for (near, keys, items), start, width in zip(self.blocks, self.starts, BLOCKS):
            lo, hi = np.searchsorted(keys, (size << 16, (size + 1) << 16))
            own = keys[lo:hi] & 0xFFFF
            value = ((windows >> start) & np.uint64((1 << width) - 1)).astype(np.int64)
            for at in range(0, len(windows), 512):
                tried = (value[at : at + 512, None] ^ near[None, :]).ravel()
                first = np.searchsorted(own, tried, side="left")
                count = np.searchsorted(own, tried, side="right") - first
                hit = np.flatnonzero(count)
                first, count = first[hit], count[hit]
                w = np.repeat(at + hit // len(near), count)
                i = items[lo + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)].astype(np.int64)
                ok = np.bitwise_count(windows[w] ^ self.fingerprints[i]) <= RADIUS
                found.append(w[ok] * max(1, len(self.fingerprints)) + i[ok])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.fingerprints)), pairs % max(1, len(self.fingerprints))


class Benchmark:
    """Items in order of their number of shingles: a Hamming index of their fingerprints, and which items hold a shingle."""

    def __init__(self, items: list[tuple[int, str]]):
        known = WordHashes()
        held = sorted(((len(h), item, h) for item, text in items if item is not None and len(h := shingle_hashes(text or "", known))), key=lambda x: x[:2])
        self.ids = [item for _, item, _ in held]
        self.sizes = np.array([n for n, _, _ in held], np.int64)
        self.shingles = [h for _, _, h in held]
        self.index = HammingIndex(np.array([simhash(unpack(h).sum(0, dtype=np.int64), len(h)) for h in self.shingles], np.uint64), self.sizes)
        flat = np.concatenate(self.shingles) if held else np.zeros(0, np.uint64)
        self.every, of = np.unique(flat, return_inverse=True)
        pairs = np.unique(of.astype(np.int64) * max(1, len(held)) + np.repeat(np.arange(len(held)), self.sizes))
        self.holders = (pairs % max(1, len(held))).astype(np.int32)
        self.heads = np.searchsorted(pairs // max(1, len(held)), np.arange(len(self.every) + 1))
        self.low_bits = np.uint64((1 << max(16, min(26, (8 * len(self.every)).bit_length()))) - 1)
        self.maybe = np.zeros(int(self.low_bits) + 1, bool)
        self.maybe[(self.every & self.low_bits).astype(np.int64)] = True

    def seeds(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions of shingles that some item has, their numbers among all of the benchmark's)."""
        at = np.flatnonzero(self.maybe[(hashes & self.low_bits).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.every, hashes[at]), max(0, len(self.every) - 1))
        ok = self.every[k] == hashes[at] if len(at) else np.zeros(0, bool)
        return at[ok], k[ok]

    def plausible(self, hashes: np.ndarray) -> dict[int, np.ndarray]:
        """Starts of windows, by item size, that hold enough shingles of one item of that size to reach the similarity.

        At most as many shingles are shared as a window has of the item's: where these are too few no similarity is
        lost, and no fingerprint is made.
        """
        at, k = self.seeds(hashes)
        if not len(at):
            return {}
        met, times = np.unique(k, return_counts=True)
        count = self.heads[met + 1] - self.heads[met]
        holders = self.holders[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.heads[met], count)]
        hits = np.bincount(holders, np.repeat(times, count), len(self.ids))
        width = np.minimum(self.sizes, len(hashes))
        need = np.maximum(1, np.ceil(SIMILARITY * (self.sizes + width) / (1 + SIMILARITY) - 1e-9)).astype(np.int64)
        starts: dict[int, list[np.ndarray]] = {}
        for i in np.flatnonzero(hits >= need).tolist():
            own = np.searchsorted(self.every, np.unique(self.shingles[i]))
            place = at[np.isin(k, own)]
            w, m = int(width[i]), int(need[i])
            # Windows that hold m of these places begin at the last of m places less a window's width, or later, and no later than the first.
            lo, hi = np.maximum(place[m - 1 :] - w + 1, 0), np.minimum(place[: len(place) - m + 1], len(hashes) - w)
            ok = lo <= hi
            if ok.any():
                size = hi[ok] - lo[ok] + 1
                own_starts = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[ok], size)
                starts.setdefault(int(self.sizes[i]), []).append(np.unique(own_starts))
        return {n: np.unique(np.concatenate(s)) for n, s in starts.items()}

    def matches(self, hashes: np.ndarray) -> list[tuple[int, float, int, int, int]]:
        """(item id, similarity, first word, shingles, differing bits) of each item's best window.

        Windows are item-sized (the whole text, if that is shorter). The plausible ones are fingerprinted, looked up,
        and compared with the items found by their shingles, repeats counted.
        """
        best: dict[int, tuple[float, int, int, int]] = {}
        counts: dict[int, Counter] = {}
        for n, starts in self.plausible(hashes).items():
            width = min(n, len(hashes))
            for at in range(0, len(starts), 2048):
                part = starts[at : at + 2048]
                for run in np.split(part, np.flatnonzero(np.diff(part) > width) + 1):
                    low = int(run[0])
                    sums = np.zeros((int(run[-1]) + width - low + 1, 64), np.int32)
                    np.cumsum(unpack(hashes[low : int(run[-1]) + width]), axis=0, out=sums[1:])
                    prints = simhash(sums[run - low + width] - sums[run - low], width)
                    for w, i in zip(*(x.tolist() for x in self.index.within(prints, n))):
                        if i not in counts:
                            counts[i] = Counter(self.shingles[i].tolist())
                        start = int(run[w])
                        window = Counter(hashes[start : start + width].tolist())
                        both = sum(min(c, window[s]) for s, c in counts[i].items())
                        similarity = both / (n + width - both)
                        bits = int(np.bitwise_count(prints[w] ^ self.index.fingerprints[i]))
                        if similarity >= SIMILARITY and similarity > best.get(i, (0,))[0]:
                            best[i] = similarity, start, width, bits
        return sorted((self.ids[i], *found) for i, found in best.items())


def _shares(benchmark: DataFrame, items_a_pass: int, bytes_a_pass: int) -> Iterator[tuple[Broadcast, bool]]:
    """(items, whether these are all) of each share of the benchmark, about items_a_pass and bytes_a_pass of text at most.

    A share is read and sent to the tasks when the one before it has been used up.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shares = max(1, -(-count // items_a_pass), -(-size // bytes_a_pass))
    for share in range(shares):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(shares)) == share).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(Benchmark([(r.item_id, r.text) for r in rows])), shares == 1


def contaminated(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS, bytes_a_pass: int = BYTES_A_PASS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_shingles, differing_bits: each item that a document holds, at its best window.

    Words are runs of letters and digits, lower-cased; the similarity is the weighted Jaccard coefficient of the
    five-word shingles of window and item, at least 0.8. Items are sent to the tasks; of a benchmark of more than
    items_a_pass or bytes_a_pass, a pass over the documents is made for each share and its result written, so that
    what is sent at a time stays bounded. Null or wordless texts and items match nothing; rows of a null doc_id or of
    equal ids are reported like any other; two items of equal text are both reported. Empty tables give an empty
    result; other columns are not read.
    """
    schema = "doc_id long, item_id long, similarity double, first_word long, n_shingles int, differing_bits int"
    parts = []
    for sent, all_of_it in _shares(benchmark, items_a_pass, bytes_a_pass):

        def step(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            items, known = sent.value, _known()
            found = []
            if items.ids:
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                    found += [(doc, *m) for m in items.matches(shingle_hashes(text, known))]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32())
            columns = list(zip(*found)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in schema.split(", ")])

        part = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], schema, step)
        if all_of_it:
            return part
        parts.append(written(part, "found"))
        sent.destroy()
    return reduce(DataFrame.unionByName, parts)


def without_benchmark(docs: DataFrame, benchmark: DataFrame, items_a_pass: int = ITEMS_A_PASS, bytes_a_pass: int = BYTES_A_PASS) -> DataFrame:
    """The documents that hold no benchmark item, with their columns.

    The pass that searches a text also keeps or drops its row, so no text is shuffled. Every row is judged by its own
    text, also those that share a doc_id or have none; null texts stay. Each share of a large benchmark takes a pass
    over what the ones before it kept.
    """
    before = None
    for sent, all_of_it in _shares(benchmark, items_a_pass, bytes_a_pass):

        def step(batch: pa.RecordBatch, sent=sent) -> pa.RecordBatch:
            items, known = sent.value, _known()
            if not items.ids:
                return batch
            return batch.filter(pa.array([not items.matches(shingle_hashes(text, known)) for text in texts(batch)], pa.bool_()))

        docs = map_batches(docs, docs.columns, docs.schema, step)
        if not all_of_it:
            docs, path = stored(docs, "kept")
            sent.destroy()
            if before:
                discard(docs.sparkSession, before)
            before = path
    return docs
