"""Spelling variants: words of the corpus one code point apart, and the common form that each rare one stands for."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.shared import in_arrow, texts, written

#: Code points and occurrences that a word has at least, and how many times as common its form is.
LENGTH, OCCURRENCES, TIMES = 7, 2, 10
#: Of the runs' checksums, one in so many loses a code point.
LOSSES = 31
#: Different words that a task counts before it hands them on.
HELD = 200_000

# Letters as Latin-1 bytes, A-Z in lower case; everything else parts words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


def letter_runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, each code point a byte."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def with_losses(doc_id: int | None, run: bytes) -> bytes:
    """The run, less one code point if the checksum of the id and the run says so; a null id is the empty text."""
    spelt = run if run.isascii() else run.decode("latin-1").encode()
    h = zlib.crc32(spelt, zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id))
    if h % LOSSES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of LENGTH code points and OCCURRENCES or more, counted over all texts.

    Each task counts the words of its batches and hands counts on, never occurrences.
    """

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                for word, n in Counter(w for w in letter_runs(text) if len(w) >= LENGTH).items():
                    word = with_losses(doc_id, word)
                    if len(word) >= LENGTH:
                        counts[word] += n
                if len(counts) > HELD:
                    yield out(counts)
                    counts.clear()
        yield out(counts)

    parts = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def nearest(words: DataFrame) -> DataFrame:
    """word, n, n_near, best (struct of less, the negative of its n, and word): how many of words (word, n) are one
    inserted, deleted or replaced code point away, and the commonest of them (ties: the first in code-point order).

    Every word goes to a group for each place, named by what stands before and behind it: words that meet there differ
    in that code point alone. It also goes to itself and to what is left of it without each code point: there the
    word itself meets those that hold one more. A group keeps its size and its first two words, itself before longer
    ones, then the commonest: they are enough for each member to know how many it has met and which is the best other.
    No pairs are made; a group holds one word a letter and place at most, some ninety a place.
    """
    places = "transform(sequence(1, length(word)), i -> concat(substr(word, 1, i - 1), '{}', substr(word, i + 1)))"
    keys = F.concat(
        F.array(F.struct(F.col("word").alias("key"), F.lit(True).alias("own"))),
        F.transform(F.expr(places.format("*")), lambda k: F.struct(k.alias("key"), F.lit(False).alias("own"))),
        F.transform(F.array_distinct(F.expr(places.format(""))), lambda k: F.struct(k.alias("key"), F.lit(False).alias("own"))),
    )
    met = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.key", "k.own")
    group = Window.partitionBy("key")
    whole = group.orderBy(F.desc("own"), F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct("own", (-F.col("n")).alias("less"), "word")
    found = met.withColumns({"size": F.count("*").over(group), "first": F.first(member).over(whole), "second": F.nth_value(member, 2).over(whole)}).where("size > 1")
    wild, first = F.col("key").contains("*"), F.col("first")
    mine = first["word"] == F.col("word")
    counted = F.when(wild | F.col("own"), F.col("size") - 1).when(first["own"], 1).otherwise(0)
    other = F.when(wild, F.when(mine, F.col("second")).otherwise(first)).when(F.col("own"), F.col("second")).when(first["own"], first)
    best = F.when(other.isNotNull(), F.struct(other["less"].alias("less"), other["word"].alias("word")))
    near = found.select("word", counted.alias("n_near"), best.alias("best")).where("n_near > 0")
    near = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for (word, form): the last word on the way from form to form.

    Each form is at least TIMES as common as its word, so no way is longer than counts have digits; each round doubles
    the steps taken and is written to the shared folder.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "forms")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the vocabulary of docs (doc_id, text).

    A word's form is its commonest near word if that is at least TIMES as common, else null; its root is the last word
    that forms lead to, itself if it has none. Null and empty texts hold no words; the words of a row without an id
    count like any other; repeated rows count each time; an empty table gives an empty result; other columns are not
    read.
    """
    found = written(nearest(written(vocabulary(docs), "vocabulary")), "near")
    has = -F.col("best.less") >= TIMES * F.col("n")
    found = found.select("word", "n", "n_near", F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n"))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
