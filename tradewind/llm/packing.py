"""Packing tokenised documents into fixed-length training sequences, best fit decreasing."""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from tokenizers import Tokenizer

from tradewind.llm.shared import in_arrow, map_batches, quoted, text_bytes, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END = 0
#: Pieces that one task packs at a time; what its sequences leave open is packed again with other shards'.
SHARD = 20_000
#: Words, and chunks without white space, whose ids a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Bytes of text whose chunks are told apart at a time; a longer text is a slice of its own.
SLICE = 8_000_000
#: Characters of distinct chunks that are split into words at a time.
PART = 500_000

#: Normalisations of a tokenizer whose chunks may be lower-cased and split here: Latin-1 is in NFC as it is.
NORMAL = ["NFC", "Replace", "Lowercase"]
_odd = re.compile(r"[^\n\x21-\x7e\xc0-\xff]|<\|")

#: Stands between two chunks' ids; no token has it. WHOLE stands for an odd chunk among plain ones, which can't hold it.
NO_ID = 2**32 - 1
BREAK = NO_ID.to_bytes(4, "little")
WHOLE = "\ue000"


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level tokenizer writes for each byte: itself where it prints, else the next from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in prints else chr(next(rest)) for b in range(256)}


_letters = _byte_letters()


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def word_pattern(path: str) -> regex.Pattern | None:
    """The pattern by which a tokenizer file splits text into words, if it lower-cases, lets no word hold white space,

    spells words byte by byte and merges within them; None for any other, whose texts go through it whole."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    steps = (said.get("pre_tokenizer") or {}).get("pretokenizers") or []
    if said["model"].get("type") != "BPE" or [n.get("type") for n in (said.get("normalizer") or {}).get("normalizers", [])] != NORMAL or [x.get("type") for x in steps] != ["Split", "ByteLevel"]:
        return None
    split, spelled = steps
    if split.get("behavior") != "Removed" or not split.get("invert") or spelled.get("add_prefix_space") or spelled.get("use_regex") or "Regex" not in split.get("pattern", {}):
        return None
    found = regex.compile(split["pattern"]["Regex"])
    return None if any(found.search(c) for c in " \t\n\r\x0b\x0c") else found


def _little_endian(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


class WordIds(dict):
    """Ids of words, as little-endian bytes, for a tokenizer that has a word_pattern.

    Such a tokenizer drops white space and never lets a token cross it, so a text's ids are its chunks' ids in order.
    Chunks of Latin-1 characters are lower-cased and split into words as the tokenizer does it, all of them in one
    pass, and only words not met before go through its merges; any other chunk, or one that may hold a special token,
    goes through the tokenizer whole and is remembered like a word.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = _tokenizer(path)
        self.merges = self.tokenizer.model
        self.pieces = regex.compile(f"\n|{WHOLE}|{word_pattern(path).pattern}")

    def __missing__(self, w: str) -> bytes:
        spelled = w if w.isascii() else w.encode().decode("latin-1").translate(_letters)
        self[w] = ids = BREAK if w == "\n" else _little_endian([t.id for t in self.merges.tokenize(spelled)])
        return ids

    def of_chunks(self, chunks: pa.Array) -> pa.Array:
        """Each chunk's ids; there is at least one chunk, and none holds white space."""
        if len(self) > REMEMBERED:
            self.clear()
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(chunks)], chunks), pa.scalar("\n", chunks.type))[0].as_buffer().to_pybytes().decode("utf-8", "replace")
        whole = []
        if _odd.search(text):
            split = text.split("\n")
            at = [k for k, c in enumerate(split) if _odd.search(c)]
            whole = [split[k] for k in at]
            self.learn_whole(whole)
            for k in at:
                split[k] = WHOLE
            text = "\n".join(split)
        text, odd, parts, at = text.lower(), iter(whole), [], 0
        while at < len(text):  # a part at a time, so that few words are held at once
            end = text.find("\n", at + PART) + 1 or len(text)
            found = self.pieces.findall(text, at, end)
            parts.append(b"".join([self[next(odd) if w == WHOLE else w] for w in found] if whole else map(self.__getitem__, found)))
            at = end
        ids = np.frombuffer(b"".join(parts), "<u4")
        breaks = np.flatnonzero(ids == NO_ID)
        ids = np.delete(ids, breaks)
        ends = np.concatenate(([0], breaks - np.arange(len(breaks)), [len(ids)])) * 4
        return pa.Array.from_buffers(pa.large_binary(), len(chunks), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids)])

    def learn_whole(self, chunks: list[str]) -> None:
        new = [c for c in dict.fromkeys(chunks) if c not in self]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            found = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.update((c, _little_endian(e.ids)) for c, e in zip(part, found))


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def _slices(several: list[bytes]) -> Iterator[list[bytes]]:
    """The texts in turn, as many at a time as reach SLICE bytes."""
    part, size = [], 0
    for text in several:
        part.append(text)
        size += len(text)
        if size >= SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_ids(several: list[bytes], path: str) -> Iterator[bytes]:
    """Each text's ids as little-endian bytes, as the tokenizer gives them."""
    if word_pattern(path) is None:
        for at in range(0, len(several), 64):
            for e in _tokenizer(path).encode_batch_fast([t.decode("utf-8", "replace") for t in several[at : at + 64]], add_special_tokens=False):
                yield _little_endian(e.ids)
        return
    for part in _slices(several):
        split = pc.ascii_split_whitespace(pa.array(part, pa.large_binary()).view(pa.large_string()))
        chunks = split.flatten().dictionary_encode()
        ids = _word_ids(path).of_chunks(chunks.dictionary).take(chunks.indices)
        last = np.cumsum(pc.list_value_length(split).to_numpy())
        ends = np.frombuffer(ids.buffers()[1], np.int64)[np.concatenate(([0], last))].tolist()
        held = memoryview(ids.buffers()[2] or b"")
        for start, end in zip(ends, ends[1:]):
            yield bytes(held[start:end])


def token_pieces(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit): each document's tokens and the end id, cut every length tokens.

    A null or empty text is the end id alone; repeated rows give repeated pieces, a null doc_id stays null, an empty
    table gives an empty result, and other columns are not read. Texts are taken whole; with a tokenizer that has a
    word_pattern the ids of a slice's distinct chunks are put together from those of their words, which a worker
    remembers.
    """
    last = np.array([end], "<u4").tobytes()

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, found in zip(batch.column("doc_id").to_pylist(), token_ids(text_bytes(batch), tokenizer)):
            ids = found + last
            out += [(doc, k, at // 4, len(ids[at : at + 4 * length]) // 4, ids[at : at + 4 * length]) for k, at in enumerate(range(0, len(ids), 4 * length))]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["doc_id", "piece", "start", "length", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, piece int, start long, length long, ids binary", step)


class OpenBins:
    """A segment tree over remaining capacities 0..top: the tightest bin with room is found in log2(top) steps."""

    def __init__(self, top: int):
        self.size = 1 << top.bit_length()
        self.any = bytearray(2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]

    def put(self, room: int, sequence: int, used: int) -> None:
        self.bins[room].append((sequence, used))
        node = room + self.size
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """(room, sequence, used) of the bin with the least room of at least need; it is no longer open."""
        node = need + self.size
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.any[2 * node] else 2 * node + 1
        room = node - self.size
        sequence, used = self.bins[room].pop()
        while node and not (self.bins[room] if node >= self.size else self.any[2 * node] or self.any[2 * node + 1]):
            self.any[node] = 0
            node >>= 1
        return room, sequence, used


def best_fit(lengths: list[int], top: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, given in decreasing order."""
    tree, out, opened = OpenBins(top), [], 0
    for n in lengths:
        found = tree.take(n)
        if found is None:
            room, sequence, used, opened = top, opened, 0, opened + 1
        else:
            room, sequence, used = found
        out.append((sequence, used))
        if room > n:
            tree.put(room - n, sequence, used + n)
    return out


def pack(pieces: DataFrame, top: int = 2048, shard: int = SHARD, room: int | None = None) -> DataFrame:
    """pieces with sequence_id and offset. No piece is cut or dropped; a piece of `top` tokens is a sequence by itself.

    The other pieces are dealt evenly into shards of about `shard` rows, so that no key decides a task's size, and
    each is packed best fit decreasing; equal lengths go in the order of their other columns, so a rerun packs alike.
    The pieces of sequences that a shard leaves with over `room` tokens free (an eighth, if not given) are dealt and
    packed again, and so on, until one shard holds what is left or a pass saves no sequence: the result stays close to
    that of one packing of all pieces, whatever the number of shards. Columns besides length pass through; sequence_id
    and offset of the input give way. Pieces without a length are not placed (null). Repeated rows are placed one by
    one; an empty table gives an empty result.
    """
    own = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = written(pieces.select(*map(quoted, own)), "pieces")
    room = top // 8 if room is None else room
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType()), StructField("_free", LongType())])
    alone = pieces.where(F.col("length").isNull() | (F.col("length") >= top))
    done = [alone.withColumn("sequence_id", F.when(F.col("length").isNotNull(), -1 - F.monotonically_increasing_id())).withColumn("offset", F.when(F.col("length").isNotNull(), F.lit(0).cast("long")))]
    left, turn, before = pieces.where(F.col("length") < top), 0, None
    while True:
        shards = max(1, -(-left.count() // shard))
        placed = written(in_arrow(left.repartition(shards), partial(_packed, top=top, turn=turn), schema), "placed")
        free = placed.where(F.col("_free") > room)
        open_now = free.agg(F.count_distinct("sequence_id")).first()[0] if shards > 1 else 0
        if shards == 1 or open_now == 0 or (before is not None and open_now >= before):
            return reduce(DataFrame.unionByName, [*done, placed.drop("_free")])
        done.append(placed.where(F.col("_free") <= room).drop("_free"))
        left, turn, before = free.select(*map(quoted, own)), turn + 1, open_now


def _packed(batches: Iterator[pa.RecordBatch], top: int, turn: int) -> Iterator[pa.RecordBatch]:
    """One shard's pieces with sequence_id, offset and the tokens that their sequence leaves free."""
    if not (batches := [b for b in batches if b.num_rows]):
        return
    rows = pa.Table.from_batches(batches)
    ordered = [f.name for f in rows.schema if f.name != "length" and not pa.types.is_nested(f.type)]
    rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ordered)])
    lengths = rows.column("length").to_pylist()
    places = best_fit(lengths, top)
    used: dict[int, int] = {}
    for (s, _), n in zip(places, lengths):
        used[s] = used.get(s, 0) + n
    first = (turn << 56) + (TaskContext.get().partitionId() << 32)
    for name, values in (("sequence_id", [first + s for s, _ in places]), ("offset", [o for _, o in places]), ("_free", [top - used[s] for s, _ in places])):
        rows = rows.append_column(name, pa.array(values, pa.int64()))
    yield from rows.to_batches(max_chunksize=10_000)


def sequences(docs: DataFrame, length: int = 2048, tokenizer: str = TOKENIZER) -> DataFrame:
    """sequence_id, n_tokens, ids (array<long>), doc_ids: the packed training rows themselves, pieces in offset order.

    A sequence is at most `length` tokens, so gathering one is bounded.
    """
    placed = pack(token_pieces(docs, length, tokenizer), length)
    return placed.repartition("sequence_id").groupBy("sequence_id").applyInArrow(_assembled, "sequence_id long, n_tokens long, ids array<long>, doc_ids array<long>")


def _assembled(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("offset")
    ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), "<u4").astype(np.int64)
    return pa.table({"sequence_id": rows.column("sequence_id").slice(0, 1), "n_tokens": [len(ids)], "ids": [ids.tolist()], "doc_ids": [rows.column("doc_id").to_pylist()]})
