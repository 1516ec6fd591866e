"""Near-duplicate groups by b-bit MinHash signatures and a multi-index Hamming join over their chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.graph import components
from tradewind.llm.shared import in_arrow, map_batches, written
from tradewind.llm.simhash import verified
from tradewind.llm.words import sliced, words

SHINGLE, PERCENT = 5, 85
#: A signature is CHUNKS chunks of CHUNK symbols of eight bits.
CHUNKS, CHUNK = 16, 7
SYMBOLS = CHUNKS * CHUNK
#: Symbols in which two signatures of a candidate pair may differ: if every chunk had two errors there would be 2 * CHUNKS,
#: so within the radius some chunk has one at most. At a similarity of 0.85 a symbol differs with probability 0.15; 32
#: or more of 112 do for one such pair in about 6,000, and for fewer above it.
RADIUS = 2 * CHUNKS - 1
#: Bits of the finer signature that pairs across groups meet first, and in how many they may differ: at a similarity of
#: 0.85 a bit differs with probability 0.075, and more than so many do for one such pair in 300,000.
FINE, FINE_RADIUS = 2048, 207
#: Rows of 40 bytes that are sent to every task rather than shuffled with the texts.
SENT = 200_000
#: Members of a shared key that one task compares at a time.
TILE = 1000

_draws = np.random.default_rng(13)
_ORDERS = _draws.integers(0, 1 << 32, (2, SYMBOLS), dtype=np.uint32) | np.uint32(1)
_FINE_ORDERS = _draws.integers(0, 1 << 32, (2, FINE), dtype=np.uint32) | np.uint32(1)
_PLACES = _draws.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(own: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, given its words' hashes in order."""
    n = max(1, len(own) - SHINGLE + 1) if len(own) else 0
    mixed = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(own))):
        mixed += own[k : k + n] * _PLACES[k]
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def _least(shingles: np.ndarray, orders: np.ndarray, rows: int) -> np.ndarray:
    """The least value of the shingles in each of the orders; a product alone would order some pairs alike in many."""
    short = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(orders.shape[1], (1 << 32) - 1, np.uint32)
    for at in range(0, len(short), rows):
        mixed = short[at : at + rows, None] ^ orders[0]
        mixed *= orders[1]
        mixed ^= mixed >> np.uint32(16)
        mixed *= np.uint32(0x85EBCA6B)
        np.minimum(least, mixed.min(0), out=least)
    return least


def signature(shingles: np.ndarray) -> np.ndarray:
    """Of each of SYMBOLS orders of the shingles, eight bits of the least."""
    least = _least(shingles, _ORDERS, 128)
    return ((least ^ (least >> np.uint32(15))) & np.uint32(255)).astype(np.uint8)


def fine_signature(shingles: np.ndarray) -> np.ndarray:
    """Of each of FINE orders of the shingles, one bit of the least; eight to a byte."""
    least = _least(shingles, _FINE_ORDERS, 8)
    return np.packbits((least * np.uint32(0x9E3779B1)) >> np.uint32(31))


def sets_of_batch(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The shingle hashes of each row's text."""
    for part in sliced(batch):
        names, found, starts = words(part.column("text"), lower=True)
        own = np.fromiter((xxhash.xxh64_intdigest(w) for w in names.cast(pa.large_binary()).to_pylist()), np.uint64, len(names))[found]
        for a, b in zip(starts[:-1], starts[1:]):
            yield shingle_hashes(own[a:b])


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, own (digest of the shingle set), signature; the last two are null for a text without words."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, own, signs = [], [], []
        for s in sets_of_batch(batch):
            n.append(len(s))
            own.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            signs.append(signature(s).tobytes() if len(s) else None)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "own", "signature"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, n_shingles long, own binary, signature binary", step)


def _matrix(column: pa.Array, width: int = SYMBOLS) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """SYMBOLS keys a signature: each chunk with each one of its symbols left out, under the number of that symbol.

    Two chunks share a key if and only if they differ in one symbol at most: leaving a symbol out stands for all its
    255 errors at once.
    """
    parts = signs.reshape(-1, CHUNKS, CHUNK).astype(np.int64) << (8 * np.arange(CHUNK, dtype=np.int64))
    keys = parts.sum(2)[:, :, None] - parts
    low = (1 << (8 * np.arange(CHUNK, dtype=np.int64))) - 1
    keys = (keys & low) | ((keys >> 8) & ~low)  # closes the gap, so that six symbols fill 48 bits
    return (keys | (np.arange(SYMBOLS, dtype=np.int64).reshape(CHUNKS, CHUNK) << 48)).reshape(-1, SYMBOLS)


def keyed(reps: DataFrame) -> DataFrame:
    """key, node: the keys of each (node, signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                keys = chunk_keys(_matrix(part.column("signature")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), SYMBOLS))], names=["key", "node"])

    return in_arrow(reps.select("node", "signature"), run, "key long, node long")


def within_radius(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures differ in RADIUS symbols at most."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = (_matrix(batch.column("of_a")) != _matrix(batch.column("of_b"))).sum(1) <= RADIUS
        return batch.select(["a", "b"]).filter(pa.array(near))

    of = lambda end: reps.select(F.col("node").alias(end), F.col("signature").alias(f"of_{end}"))
    return map_batches(pairs.join(of("a"), "a").join(of("b"), "b"), ["a", "b", "of_a", "of_b"], "a long, b long", step)


def _first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least number of a symbol whose key two rows of signatures share, or SYMBOLS; SYMBOLS too beyond the radius."""
    unlike = (left != right).reshape(-1, CHUNKS, CHUNK)
    errors = unlike.sum(2)
    shared = errors <= 1
    chunk = shared.argmax(1)
    row = np.arange(len(unlike))
    first = chunk * CHUNK + np.where(errors[row, chunk] == 1, unlike[row, chunk].argmax(1), 0)
    return np.where(shared[row, chunk] & (errors.sum(1) <= RADIUS), first, SYMBOLS)


def fine_signatures(held: DataFrame) -> DataFrame:
    """node, fine for the shingle sets (id, own)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fine = [fine_signature(np.frombuffer(x.as_buffer(), "<u8")).tobytes() for x in batch.column("own")]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fine, pa.binary())], names=["node", "fine"])

    return map_batches(held, ["id", "own"], "node long, fine binary", step)


def across(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) within both radii of members (key, node, part) that share a key and lie in different parts, each once.

    signatures holds node, signature and fine. A key's members are dealt into blocks of about TILE, and a task compares
    two blocks' signatures at a time in arrays, so no key's members gather in one task. A pair comes out only at the
    first key that it shares: nothing of it is emitted beyond the radii or a second time.
    """
    blocks = members.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    dealt = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = dealt.select("key", "node", "part", "block", other.alias("other")).select("key", "node", "part", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    rows = tiles.join(signatures, "node").select("key", "x", "y", "block", "part", "node", "signature", "fine").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "part", "node")

    def pairs(key: int, x: int, y: int, block: np.ndarray, part: np.ndarray, node: np.ndarray, signs: np.ndarray, fine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = [], []
        for i in range(len(node) - 1):
            from_ = int(np.searchsorted(part, part[i], "right"))  # members are sorted by part
            if from_ == len(node):
                break
            there = signs[from_:]
            hit = _first_shared(np.broadcast_to(signs[i], there.shape), there) == key >> 48
            if x != y:
                hit &= block[from_:] != block[i]
            near = np.flatnonzero(hit) + from_
            near = near[np.bitwise_count(fine[near] ^ fine[i]).sum(1) <= FINE_RADIUS]
            left.append(np.maximum(node[near], node[i]))
            right.append(np.minimum(node[near], node[i]))
        none = [np.zeros(0, np.int64)]
        return np.concatenate(left or none), np.concatenate(right or none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, held in _grouped(batches):
            a, b = pairs(*tile, *held)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return in_arrow(rows, run, "a long, b long")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], list[np.ndarray]]]:
    """Each tile's name and its columns, of rows that come sorted by tile; only one tile is held at a time."""
    name, held = None, []
    for batch in batches:
        ids = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
        own = [batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5).to_numpy(), _matrix(batch.column(6)), _matrix(batch.column(7), FINE // 8)]
        cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(1)) + 1).tolist(), len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            tile = tuple(ids[a].tolist())
            if tile != name and held:
                yield name, [np.concatenate(x) for x in zip(*held)]
                held = []
            name = tile
            held.append([x[a:b] for x in own])
    if held:
        yield name, [np.concatenate(x) for x in zip(*held)]


def sets_of(docs: DataFrame, named: DataFrame) -> DataFrame:
    """id, own (a shingle set's bytes) for the rows (doc_id, set) that named calls id: only their texts are split again."""
    named = written(named, "named")
    if named.count() <= SENT:  # else texts are shuffled to them
        named = F.broadcast(named)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(named, "doc_id")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(sets_of_batch(batch))
        digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
        mine = pa.array([a == b for a, b in zip(digests, batch.column("set").to_pylist())], pa.bool_())  # rows may repeat an id with another text
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "own"]).filter(mine)

    return map_batches(held, ["id", "set", "text"], "id long, own binary", step).groupBy("id").agg(F.any_value("own").alias("own"))


def links(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Verified links (a, b) of nodes, enough of them to connect all that links within the radius connect.

    reps holds node, id, own and signature of each distinct shingle set. First every key's members meet the one of them
    that shares most keys with others, which an origin does with its copies, and what is verified gives groups; then
    members of one key that lie in different groups meet each other. Pairs within a group that the first pass has made
    are never formed.
    """
    keys = keyed(reps)
    several = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keys.join(several, "key"), "shared")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    centres = shared.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("m")).select("key", F.col("m.node").alias("centre"))
    starred = shared.join(centres, "key").where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    first = written(within_radius(starred, reps), "starred")
    similar = written(verified(first, _held(docs, reps, first), PERCENT / 100, dtype="<u8"), "similar")
    members = shared.select("key", "node").join(components(similar), "node", "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    split = members.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    members = written(members.join(split, "key"), "members")
    open_ = members.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    held = _held(docs, reps, open_)
    more = written(across(members, reps.select("node", "signature").join(fine_signatures(held), "node")), "across")
    return similar.unionByName(verified(more, held, PERCENT / 100, dtype="<u8"))


def _held(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, own: the shingle sets of the nodes that the pairs name."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return written(sets_of(docs, reps.join(nodes, "node").select(F.col("node").alias("id"), F.col("id").alias("doc_id"), F.col("own").alias("set"))), "sets")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Sets are of distinct five-word shingles (fewer words: the whole sequence; none: an empty set, linked with nothing).
    Rows of equal sets are one node; nodes link if 100 times their intersection is at least 85 times their union, which
    is verified on the full sets of 64-bit shingle hashes. component_id is the least doc_id reachable. Repeated rows stay
    repeated, and rows that repeat an id with other texts are nodes of their own. Rows whose doc_id is null join the
    component of an equal set that has an id and link nothing themselves; else their component_id is null. kept is true
    where doc_id and component_id are the same, null or not. An empty table gives an empty result; other columns are
    not read.
    """
    rows = written(marked(docs), "signatures")
    reps = rows.where("doc_id is not null and own is not null").groupBy("own").agg(F.min("doc_id").alias("id"), F.any_value("signature").alias("signature"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "sets-once")
    parts = components(links(docs, reps))
    grouped = reps.join(parts, "node", "left").select("own", "id", F.coalesce("component", "node").alias("part"))
    least = grouped.groupBy("part").agg(F.min("id").alias("component_id"))
    named = grouped.join(least, "part").select("own", "component_id")
    found = rows.select("doc_id", "n_shingles", "own").join(named, "own", "left")
    component = F.when(F.col("own").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
