"""Near-duplicate groups by SimHash fingerprints and meet-in-the-middle ball hashing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.graph import components
from tradewind.llm.shared import map_batches, quoted, text_bytes, texts, written

RADIUS = 3
#: Bit blocks of the screen: of six, at most three can differ within the radius, so three agree.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: Fingerprints that one task emits the variants of.
EMITTERS = 20_000


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the XXH64 hashes of the word shingles, repeats included."""
    found = text.lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    return int(_majority(hashes[:, None])[0])


def _majority(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit word a column of hashes (rows, columns): bit b is set if it is set in over half of the rows."""
    ones = np.zeros((hashes.shape[1], 64), np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.ascontiguousarray(hashes[at : at + 8192], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(*part.shape, 8), axis=-1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), axis=-1, bitorder="little").view("<u8")[:, 0]


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long). Words are split at ASCII white space, only A-Z is lower-cased."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, words, seed) for t in text_bytes(batch)], dtype=np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, fp long", step)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _screened(reps: DataFrame) -> DataFrame:
    """The fingerprints that agree with another in three of six blocks: all that can have one within the radius."""
    starts = np.cumsum((0, *BLOCKS)).tolist()
    masks = [_signed(sum(((1 << BLOCKS[b]) - 1) << starts[b] for b in chosen)) for chosen in combinations(range(len(BLOCKS)), 3)]
    keys = reps.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks))).alias("t", "k"))
    shared = keys.groupBy("t", "k").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("t", "k")
    return keys.join(shared, ["t", "k"], "left_semi").select("fp").distinct()


def ball_links(reps: DataFrame, screen: bool = True) -> DataFrame:
    """Links (a, b) of fingerprints whose components are those of all pairs within three bits, for distinct ones (fp).

    With screen, only fingerprints emit that agree with another in three of six blocks; as any two within the radius
    do, the links are the same without it. It costs 20 rows a fingerprint and spares about 561 of each that it stops:
    most of them where fingerprints are few beside the 2^32 values of three blocks, and none where they are many.

    Every fingerprint then emits all its variants at one bit. Half of the radius is one and a half bits, so fingerprints of
    even parity also emit those at two bits of one half of the word: two fingerprints at three bits differ in parity,
    and two of the three bits lie in one half, so a variant at two bits of the even one meets one at a single bit of
    the odd one; at one or two bits, single-bit variants meet. Variants are shuffled on; at a variant, all that lie
    within two bits link to the least that lies within one: that pair is within three bits, which the filter
    verifies. A variant holds at most the 2,081 fingerprints of its ball, however large a group of copies is, and
    no pairs within a group are made.
    """
    single = [_signed(1 << i) for i in range(64)]
    double = [_signed((1 << i) | (1 << j)) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
    even = F.bit_count("fp") % 2 == 0
    if screen:
        reps = written(_screened(reps), "near")
    reps = reps.repartition(max(1, -(-reps.count() // EMITTERS)))
    met = reps.select("fp", F.explode(F.when(even, _masks([0, *single, *double])).otherwise(_masks([0, *single]))).alias("mask")).select(F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "mask")
    # A variant and its mask give the fingerprint, and a mask of few bits is stored in few bytes.
    fp, close = F.col("variant").bitwiseXOR(F.col("mask")), F.bit_count("mask") <= 1
    centre = F.min(F.when(close, fp)).over(Window.partitionBy("variant"))
    pairs = met.select("variant", "mask", centre.alias("centre")).select(fp.alias("a"), F.col("centre").alias("b")).where("a <> b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp, component_id for every row of docs: components of fingerprints that differ in at most three bits.

    Equal fingerprints are one node; a component is named by its least doc_id. A text without words has fingerprint
    zero and links like any other. Repeated rows stay repeated. Rows whose doc_id is null link the fingerprints that
    theirs lies near like any other; their component is null if no row of it has an id. An empty table gives an empty
    result; other columns are not read.
    """
    fps = written(fingerprints(docs, words, seed), "fingerprints")
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("id"))
    parts = components(ball_links(reps.select("fp")))
    group = reps.join(parts, reps.fp == parts.node, "left").select("fp", "id", F.coalesce("component", "fp").alias("group"))
    least = group.groupBy("group").agg(F.min("id").alias("component_id"))
    named = group.join(least, "group").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


# ---- near copies by five-word similarity ----

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a text, and bits of each. Texts at similarity 0.8 share over nine tenths of their distinct words, so
#: about one bit in 13 differs, and six fingerprints of 40 bits are all over two bits apart for about one such pair in 20.
BANDS, WIDTH = 6, 40
_word = re.compile(r"[^\W_]+")
_spread = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def band_prints(text: str) -> tuple[bytes, list[int]]:
    """(digest of the words in order, BANDS fingerprints of WIDTH bits of the distinct words); lower case, letters and digits only."""
    found = _word.findall(text.lower())
    whole = xxhash.xxh3_128_digest("\0".join(found).encode("utf-8", "surrogatepass"))
    if not found:
        return whole, [0] * BANDS
    own = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in set(found)], np.uint64)
    with np.errstate(over="ignore"):
        wide = (own[:, None] ^ (own[:, None] >> np.uint64(31))) * _spread
        wide ^= wide >> np.uint64(29)
    bits = int.from_bytes(_majority(wide).tobytes(), "little")
    return whole, [(bits >> (WIDTH * k)) & ((1 << WIDTH) - 1) for k in range(BANDS)]


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, own (digest of a text's words), prints: everything but the text."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [band_prints(t) for t in texts(batch)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([d for d, _ in found], pa.binary()), pa.array([p for _, p in found], pa.list_(pa.int64()))], names=["doc_id", "own", "prints"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, own binary, prints array<long>", step)


def colliding_pairs(reps: DataFrame) -> DataFrame:
    """Distinct (a, b, met) whose fingerprints of one band lie within two bits, for (id, prints); met counts the variants.

    Half of the radius is one bit: every fingerprint emits itself and its WIDTH variants at one bit. At a variant all
    go to the least id whose own fingerprint it is, or else to the least id there, so a group of any size makes one
    pair a row and variant; an original and its copies, which surround it, are paired with each other, and the nearer
    two fingerprints lie the more variants they meet at.
    """
    masks = _masks([0, *(1 << i for i in range(WIDTH))])
    bands = reps.select("id", F.posexplode("prints").alias("band", "fp")).select("id", "fp", F.shiftleft(F.col("band").cast("long"), WIDTH).alias("band"), F.explode(masks).alias("mask"))
    met = bands.select("id", F.col("band").bitwiseOR(F.col("fp").bitwiseXOR(F.col("mask"))).alias("variant"), (F.col("mask") == 0).alias("own"))
    w = Window.partitionBy("variant")
    centre = F.coalesce(F.min(F.when(F.col("own"), F.col("id"))).over(w), F.min("id").over(w))
    pairs = met.withColumn("b", centre).where("id <> b").select(F.greatest("id", "b").alias("a"), F.least("id", "b").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("met"))


def shingle_set(text: str, words: int = SHINGLE) -> np.ndarray:
    """32-bit hashes of a text's distinct word shingles, sorted; a text of fewer words is one shingle.

    Two texts of n shingles share n * n / 2^32 by chance, which moves no coefficient by over n / 2^32.
    """
    found = _word.findall(text.lower())
    return np.unique(np.array([xxhash.xxh32_intdigest(" ".join(found[i : i + words]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(found) - words + 1))], "<u4"))


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, own (a shingle set's bytes) of every row that a pair names: texts are shuffled once by id, alike at every size."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    held = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null").join(ids.hint("merge"), "id", "left_semi")

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingle_set(t).tobytes() for t in texts(batch)], pa.binary())], names=["id", "own"])

    return map_batches(held, ["id", "text"], "id long, own binary", step).groupBy("id").agg(F.min("own").alias("own"))


def verified(pairs: DataFrame, held: DataFrame, similarity: float = SIMILARITY, rows_a_part: int = 1000, dtype: str = "<u4") -> DataFrame:
    """The pairs (a, b) whose shingle sets in held (id, own: sorted hashes of this type) have this Jaccard coefficient,
    in whole hundredths, or more.

    Pairs of one b are dealt into parts of about rows_a_part and sorted behind b's own set, which is sent once to each
    part: no set's pairs gather in one task, and a task holds one of them and the rows of a batch.
    """
    pairs = pairs.select("a", "b")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / rows_a_part).cast("int").alias("parts"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    centres = held.hint("merge").join(parts, F.col("id") == F.col("b")).select(F.lit(None).cast("long").alias("a"), "b", every, "own")
    dealt = pairs.join(parts, "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("part"))
    others = held.hint("merge").join(dealt, F.col("id") == F.col("a")).select("a", "b", "part", "own")
    rows = centres.unionByName(others).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, percent = np.zeros(0, dtype), round(100 * similarity)
        for batch in batches:
            kept = []
            for a, own in zip(batch.column("a").to_pylist(), batch.column("own")):
                own = np.frombuffer(own.as_buffer(), dtype)
                if a is None:
                    centre = own.copy()
                    kept.append(False)
                else:
                    both = len(np.intersect1d(own, centre, assume_unique=True))
                    kept.append(100 * both >= percent * (len(own) + len(centre) - both))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _likely(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, met), distinct (a, b): each node's with the partner it met most often and with its least partner,
    the centre of most of its variants."""
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "met").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "met"))
    best = both.groupBy("x").agg(F.max(F.struct("met", "y"))["y"].alias("near"), F.min("y").alias("least"))
    chosen = best.select(F.greatest("x", "near").alias("a"), F.least("x", "near").alias("b")).unionByName(best.select(F.greatest("x", "least").alias("a"), F.least("x", "least").alias("b")))
    return chosen.distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of every row that has an id: groups of texts at a five-word similarity of 0.8 or more.

    Texts of the same words are one node, named by its least doc_id; so are texts without words. Colliding pairs are
    verified on their whole texts in two passes: each node's pairs with the partner it met most often and with its
    least one, the centre of most of its variants; then all that the first pass has not already put in one group. Ids are taken to be distinct, as keep_one makes them; of rows that repeat one, any may speak for it. Rows
    without an id are left out; an empty table gives an empty result.
    """
    marked = _marked(docs).where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("own", "prints")).alias("m"))
    marked = written(marked.select("doc_id", "m.own", "m.prints"), "marked")
    reps = written(marked.groupBy("own").agg(F.min("doc_id").alias("id"), F.any_value("prints").alias("prints")), "alike")
    pairs = written(colliding_pairs(reps.select("id", "prints")), "colliding")
    held = written(sets_of(docs, pairs), "compared")
    first = written(verified(_likely(pairs), held), "verified", few=True)
    part = written(components(first), "parts", few=True)
    of = lambda end: part.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    apart = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")
    more = verified(written(apart, "apart"), held)
    whole = components(first.unionByName(more))
    named = reps.select("own", "id").join(whole, F.col("id") == F.col("node"), "left").select("own", F.coalesce("component", "id").alias("component_id"))
    return marked.join(named, "own").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents less all but the least doc_id of each group of near copies.

    Rows without a doc_id stay. Rows that repeat an id and a text are one document; texts that share an id are documents
    of their own, compared under numbers below all ids. Only ids are joined to the texts: those that go and those that
    are repeated; where these are few, Spark sends them to the tasks and no text moves. Columns of any name pass through.
    """
    columns = [quoted(c) for c in docs.columns]
    repeated = written(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    single = docs.join(repeated, "doc_id", "left_anti").select(*columns)
    alike = [F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")), 256)]
    clashing = docs.join(repeated, "doc_id", "left_semi").groupBy(*alike).agg(F.first(F.struct(*columns)).alias("row")).select("row")
    below = F.least(F.lit(docs.agg(F.min("doc_id")).first()[0] or 0).cast("long"), F.lit(0).cast("long"))
    clashing = written(clashing.withColumn("node", below - 1 - F.monotonically_increasing_id()), "clashing")
    both = single.select(F.col("doc_id").cast("long").alias("doc_id"), "text").unionByName(clashing.select(F.col("node").alias("doc_id"), F.col("row.text").alias("text")))
    groups = written(near_copies(both), "groups")
    ids = clashing.select(F.col("node").alias("doc_id"), F.col("row.doc_id").cast("long").alias("id"))
    named = groups.join(ids, "doc_id", "left").select("component_id", F.struct(F.coalesce("id", "doc_id").alias("id"), F.col("doc_id").alias("node")).alias("as"))
    least = named.groupBy("component_id").agg(F.min("as").alias("least"))
    gone = named.join(least, "component_id").where(F.col("as.node") != F.col("least.node")).select(F.col("as.node").alias("node"))
    kept = single.join(gone.withColumnRenamed("node", "doc_id"), "doc_id", "left_anti").select(*columns)
    return kept.unionByName(clashing.join(gone, "node", "left_anti").select("row.*"))
