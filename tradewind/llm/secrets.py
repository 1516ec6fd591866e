"""Secret scans with DataFrame functions only: base patterns, and sliding-window Shannon entropy of long strings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns (fixed values).
ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# A run is taken whole or fails whole, so the least length may stand in the pattern.
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Characters of a long candidate that are looked at together, and matches whose places are summed up together.
PIECE, BLOCK = 1000, 64
#: Bits a character that the best window of a candidate must reach, by character class. 20 characters hold 4.32 at most.
BITS = {"hex": 2.9, "upper": 3.4, "lower": 3.4, "mixed": 3.6, "letters": 3.2}
#: Strings of known harmless forms: UUIDs, runs of one or two characters, counted-up alphabets, placeholders.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^(.)\1+$",
    r"^(.{1,4})\1{3,}.{0,3}$",
    r"(?i)example|placeholder|changeme|your[_-]?(token|key|secret)|xxxx|0123456789|abcdefghij|1234567890",
)
#: Slugs of words and numbers, of small letters, perhaps with a capital first, or of capitals; possessive, so that a long one is matched in a loop.
SLUGS = (r"^(?:(?:[A-Z]?+[a-z]*+[0-9]*+|[0-9]++[a-z]{1,2}+)(?:[-_+/=]|$))++$", r"^(?:(?:[A-Z]*+[0-9]*+|[0-9]++[A-Z]{1,2}+)(?:[-_+/=]|$))++$")
#: Per mille of the letters of running text in English, German, French and Spanish, about (fixed values).
LETTERS = {"a": 85, "b": 16, "c": 32, "d": 43, "e": 145, "f": 16, "g": 21, "h": 34, "i": 73, "j": 3, "k": 8, "l": 45, "m": 28, "n": 78, "o": 60, "p": 23, "q": 6, "r": 67, "s": 73, "t": 70, "u": 45, "v": 12, "w": 12, "x": 3, "y": 10, "z": 6}
#: Bits by which a string of letters must look more like even draws than like words.
UNLIKE = 4.0
#: Characters that a candidate may hold; a count takes five bits, and twelve counts a number.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, of, block: int = BLOCK) -> Column:
    """of() of all elements before each one, zero before the first.

    Blocks are reduced first, then what comes before each block, then each block by itself, so an array of n elements
    takes about n * block + (n / block)^2 / 2 steps and no array is copied at each of its elements.
    """

    def folded(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: of(a, x))

    def parts(v: Column) -> Column:
        heads = lambda sums: F.transform(sums, lambda _, k: folded(F.slice(sums, F.lit(1), k)))
        within = lambda part, head: F.transform(part, lambda _, i: of(head, folded(F.slice(part, F.lit(1), i))))
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, F.lit(block)))
        return _let(cut, lambda c: _let(F.transform(c, folded), lambda sums: _let(heads(sums), lambda h: F.flatten(F.transform(c, lambda part, k: within(part, F.get(h, k)))))))

    return _let(values, lambda v: F.when(F.size(v) > 0, parts(v)).otherwise(v))


def _places(text: Column, pattern: str, ok) -> Column:
    """array<struct<start, end, whole>> of the pattern's leftmost non-overlapping matches that pass ok(whole).

    The pieces between matches and the matches in turn make up the text, so the sums of their lengths give the places.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"))
    empty = F.expr("cast(array() as array<struct<start:int,end:int,whole:string>>)")

    def placed(r: Column) -> Column:
        before = running(F.transform(r, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["whole"]), F.lit(0))), F.lit(0), lambda a, x: a + x)
        start = lambda x, at: at + F.length(x["gap"])
        found = F.zip_with(r, before, lambda x, at: F.struct(start(x, at).alias("start"), (start(x, at) + F.length(x["whole"])).alias("end"), x["whole"].alias("whole")))
        return F.filter(found, lambda x: x["whole"].isNotNull() & ok(x["whole"]))

    return F.when(text.rlike(pattern), _let(rows, placed)).otherwise(empty)


def best_window_bits(s: Column, window: int = WINDOW) -> Column:
    """The greatest Shannon entropy, in bits a character, of any window of the string; 0 if it is shorter than one.

    The characters' counts are kept as the window slides, each step adds one and takes off one, and the sum of n log2 n
    over them changes by these two terms alone. A long string is taken in pieces that overlap by a window, so that no
    step holds more than a piece of it. The string is of SIGNS; a window is of 31 characters at most.
    """
    pieces = F.regexp_extract_all(s, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return _let(pieces, lambda p: F.coalesce(F.array_max(F.transform(p, lambda x, i: _piece_bits(F.concat(x, F.substring(F.coalesce(F.get(p, i + 1), F.lit("")), 1, window - 1)), window))), F.lit(0.0)))


def _piece_bits(s: Column, window: int) -> Column:
    term = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    shift = lambda way, x, k: F.call_function(way, x, (5 * (k % 12)).cast("int"))
    one = F.lit(1).cast("long")

    def slid(codes: Column) -> Column:
        counted = lambda counts, k: shift("shiftright", F.get(counts, F.floor(k / 12).cast("int")), k).bitwiseAND(F.lit(31).cast("long"))
        added = lambda counts, k, n: F.transform(counts, lambda x, i: F.when(i == F.floor(k / 12), x + n * shift("shiftleft", one, k)).otherwise(x))

        def step(state: Column, i: Column) -> Column:
            into, out = F.get(codes, i), F.get(codes, i - window)
            up = counted(state["counts"], into)
            total = state["total"] + term(up + 1) - term(up)
            grown = F.struct(added(state["counts"], into, 1).alias("counts"), total.alias("total"), state["best"].alias("best"))

            def shrunk(g: Column) -> Column:
                down = counted(g["counts"], out)
                return F.struct(added(g["counts"], out, -1).alias("counts"), (g["total"] + term(down - 1) - term(down)).alias("total"), g["best"].alias("best"))

            held = _let(grown, lambda g: F.when(i >= window, shrunk(g)).otherwise(g))
            bits = lambda h: F.when(i >= window - 1, F.log2(F.lit(float(window))) - h["total"] / window).otherwise(F.lit(0.0))
            return _let(held, lambda h: F.struct(h["counts"], h["total"], F.greatest(h["best"], bits(h)).alias("best")))

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), 6).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["best"])

    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(SIGNS), c) - 1)
    return F.when(F.length(s) >= window, _let(codes, slid)).otherwise(F.lit(0.0))


def unlike_words(s: Column) -> Column:
    """Bits by which the letters of s look more like even draws from the alphabet than like running text."""
    weight = F.create_map(*(F.lit(x) for c, n in LETTERS.items() for x in (c, math.log2(1000 / 26 / n))))
    letters = F.split(F.regexp_replace(F.lower(s), "[^a-z]", ""), "")
    return F.aggregate(letters, F.lit(0.0), lambda a, c: a + F.coalesce(F.try_element_at(weight, c), F.lit(0.0)))


def _secret_like(s: Column) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and no allowed form fits it.

    The classes are hexadecimal, capitals with digits, small letters with digits, both with digits, and letters alone,
    of either case or both; all but the first may hold - _ + / =. Strings of the digit classes are let through if they
    are slugs; letters alone, unless they look more like even draws than like words. Only strings of digits and signs
    are of no class. The entropy is computed only for what is left.
    """
    digit, lower, upper = s.rlike("[0-9]"), s.rlike("[a-z]"), s.rlike("[A-Z]")
    least = F.when(s.rlike("^[0-9a-fA-F]+$") & digit & (lower | upper), BITS["hex"]).when(digit & upper & ~lower, BITS["upper"]).when(digit & lower & ~upper, BITS["lower"]).when(digit & lower & upper, BITS["mixed"]).when(lower | upper, BITS["letters"])
    allowed = F.when(digit, s.rlike(SLUGS[0]) | s.rlike(SLUGS[1])).otherwise(unlike_words(s) < UNLIKE)
    for form in ALLOW:
        allowed = allowed | s.rlike(form)
    return F.when(least.isNull() | allowed, F.lit(False)).otherwise(best_window_bits(s) >= least)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind, end by start and kind) and spans (base and entropy spans alike) for every row.

    Built-in functions only, a map over whole texts without a shuffle. Entropy spans that touch a base span add
    nothing. A null text is empty and has no spans; repeated rows give repeated rows; an empty table gives an
    empty result; other columns are not read. Places are in code points, ends exclusive. Time grows with a text's
    length and not with its square, however many matches it holds.
    """
    text = F.col("text")
    always = lambda whole: F.lit(True)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    found = found.withColumns({
        "assign": _places(text, ASSIGN, lambda whole: F.length(F.regexp_extract(whole, ASSIGN, 2)) >= 12),
        "access": _places(text, ACCESS, lambda whole: F.length(whole) >= 18),
        "hex": _places(text, HEX, always),
        "long": _places(text, CANDIDATE, always),
    })
    as_kind = lambda name, k: F.transform(name, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end")))
    found = found.withColumn("base", F.array_sort(F.concat(*(as_kind(n, k) for k, n in enumerate(KINDS[:3])))))
    found = found.withColumn("free", F.when((F.size("long") > 0) & (F.size("base") > 0), _apart(F.col("long"), F.col("base"))).otherwise(F.col("long")))
    found = found.withColumn("more", F.filter("free", lambda x: _secret_like(x["whole"])))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", as_kind("more", 3))).alias("spans"))


def _apart(spans: Column, base: Column) -> Column:
    """The spans (start, end, whole) that overlap none of base (start, kind, end).

    In order of their starts, a span is free if no base span that begins before it reaches into it and the next one
    begins at its end or later.
    """
    far = F.lit(2**31 - 1)
    rows = F.array_sort(F.concat(F.transform(base, lambda x: F.struct(x["start"].alias("start"), F.lit(False).alias("own"), x["end"].alias("end"), F.lit("").alias("whole"))), F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(True).alias("own"), x["end"].alias("end"), x["whole"].alias("whole")))))

    def kept(r: Column) -> Column:
        reach = running(F.transform(r, lambda x: F.when(x["own"], 0).otherwise(x["end"])), F.lit(0), F.greatest)
        following = F.reverse(running(F.reverse(F.transform(r, lambda x: F.when(x["own"], far).otherwise(x["start"]))), far, F.least))
        beside = F.arrays_zip(r.alias("x"), reach.alias("reach"), following.alias("next"))
        free = F.filter(beside, lambda b: b["x"]["own"] & (b["reach"] <= b["x"]["start"]) & (b["next"] >= b["x"]["end"]))
        return F.transform(free, lambda b: F.struct(b["x"]["start"].alias("start"), b["x"]["end"].alias("end"), b["x"]["whole"].alias("whole")))

    return _let(rows, kept)


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def of_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
