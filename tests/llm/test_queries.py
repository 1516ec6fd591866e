"""Every registered query of the corpus operators over a whole table, against its contract by independent code."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_operators import brute_secrets, brute_spans, held_out, spec_fingerprint
from tradewind.llm import decontam, html_text, language, packing, quality_model
from tradewind.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(sf):
    return dict(duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def rows(spark, sf):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = QUERIES[name](spark, sf).collect()
        return kept[name]

    return of


def listed(spans, names):
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


@pytest.mark.parametrize("name, kinds, brute", [("op1_pii", ("email", "ip", "card", "phone"), brute_spans), ("op8_secrets", ("assign", "access", "hex"), brute_secrets)])
def test_spans(name, kinds, brute, rows, texts):
    found = rows(name)
    assert sorted(r.doc_id for r in found) == sorted(texts)
    some = 0
    for r in found:
        base = brute(texts[r.doc_id] or "")
        assert [r[f"n_{k}"] for k in kinds] == [sum(x[1] == i for x in base) for i in range(len(kinds))]
        assert r.base_sha256 == hashlib.sha256(listed(base, kinds).encode()).hexdigest()
        own = r.spans.split(",") if r.spans else []
        assert set(listed(base, kinds).split(",")) - {""} <= set(own) and [int(x.split(":")[1]) for x in own] == sorted(int(x.split(":")[1]) for x in own)
        some += len(base)
    assert some > 0


def test_decontamination(rows, texts, sf):
    items = duckdb.sql(f"select item_id, text from '{sf}/benchmark.parquet'").fetchall()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    want = set()
    for d, t in texts.items():
        w = words(t)
        have = set(grams(w))
        for i, item in items:
            own = grams(words(item))
            n = sum(own.values())
            if not own or not w or sum(c for g, c in own.items() if g in have) < 0.8 * min(n, max(1, len(w) - 4)):
                continue
            size = min(n, max(1, len(w) - 4))
            for s in range(max(1, len(w) - 4) - size + 1):
                both = sum((grams(w[s : s + size + 4]) & own).values())
                if both / (n + size - both) >= decontam.SIMILARITY:
                    want.add((d, i))
                    break
    got = {(r.doc_id, r.item_id) for r in rows("op2_decontamination")}
    assert want and got == want and all(0.8 <= r.similarity <= 1 for r in rows("op2_decontamination"))


def test_simhash(rows, texts):
    prints = {d: spec_fingerprint(t) for d, t in texts.items()}
    label = {d: d for d in texts}
    changed = True
    while changed:
        changed = False
        for i in texts:
            for j in texts:
                if label[i] < label[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                    label[j], changed = label[i], True
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows("op3_simhash")} == {d: (f"{prints[d]:016x}", label[d]) for d in texts}


def test_html(rows, sf):
    pages = {i: (u, h) for i, u, h in duckdb.sql(f"select page_id, url, html from '{sf}/pages.parquet'").fetchall()}
    assert sorted(r.page_id for r in rows("op4_html")) == sorted(pages)
    for r in rows("op4_html"):
        url, html = pages[r.page_id]
        blocks = [t for _, t in html_text.Page(html or "").blocks]
        kept = iter(blocks)
        assert r.url == url and r.n_chars == len(r.text) and all(line in kept for line in r.text.split("\n") if line)  # blocks of the page, in its order
    assert sum(r.n_chars > 0 for r in rows("op4_html")) > 0.8 * len(pages)


def test_packing(rows, texts):
    whole, found = Tokenizer.from_file(packing.TOKENIZER), {}
    for r in rows("op5_packing"):
        found.setdefault(r.doc_id, []).append(r)
    assert sorted(found) == sorted(texts)
    total = 0
    for d, pieces in found.items():
        ids = whole.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for k, p in enumerate(sorted(pieces, key=lambda p: p.piece)):
            own = ids[2048 * k : 2048 * (k + 1)]
            assert (p.piece, p.start, p.length, p.ids_crc32) == (k, 2048 * k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        assert len(pieces) == math.ceil(len(ids) / 2048)
    by = {}
    for r in rows("op5_packing"):
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) <= math.ceil(total / 2048) + 1


def test_quality_rules(rows, texts):
    assert sorted(r.doc_id for r in rows("op6_quality_rules")) == sorted(texts)
    for r in rows("op6_quality_rules"):
        t = texts[r.doc_id] or ""
        w = WORD.findall(t)
        times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        again = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.kept and r.base_failed)


def test_quality_scores(spark, sf, rows, texts):
    """Each score from the machine's weights by the definition, all pairs of features written out, on short texts."""
    from tradewind.llm.shared import table

    machine = quality_model.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    got = {r.doc_id: r for r in rows("op9_quality")}
    assert sorted(got) == sorted(texts) and all(r.held_out == held_out(d, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for d, r in got.items())
    short = sorted(texts, key=lambda d: len(texts[d] or ""))[:12]
    for d in short:
        ((at, x),) = machine.rows([(texts[d] or "").encode()])
        pairs = sum(float(machine.v[at[i]] @ machine.v[at[j]]) * x[i] * x[j] for i in range(len(at)) for j in range(i))
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, machine.w0 + float(machine.w[at] @ x) + pairs)))), abs=1e-9)


def test_language_predictions(rows, sf, texts):
    """Counts, log-probabilities and the best language from plain dictionaries."""
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())

    def buckets(text):
        p, out = [ord(c) for c in f" {text.lower()} "], []
        for n in language.ORDERS:
            for i in range(len(p) - n + 1):
                h = 0
                for k in range(n):
                    h = (h * 0x01000193 + p[i + k] + k + 1) & 0xFFFFFFFF
                out.append(((h * 0x9E3779B1 & 0xFFFFFFFF) >> 18) & (language.BUCKETS - 1))
        return out

    count, seen = {}, Counter()
    for d, t in texts.items():
        if lang[d] is not None and t is not None and not held_out(d, 5, 0):
            count.setdefault(lang[d], Counter()).update(buckets(t))
            seen[lang[d]] += 1
    total = {x: sum(c.values()) + 0.1 * language.BUCKETS for x, c in count.items()}
    got = {r.doc_id: r for r in rows("op10_language")}
    assert sorted(got) == sorted(texts)
    for d in sorted(texts, key=lambda d: len(texts[d] or ""))[:60]:
        assert got[d].held_out == held_out(d, 5, 0)
        if not any(map(str.isalpha, texts[d] or "")):
            assert got[d].lang_pred == "und"
            continue
        b = buckets(texts[d])
        score = {x: sum(math.log((c[k] + 0.1) / total[x]) for k in b) + math.log(seen[x] / sum(seen.values())) for x, c in count.items()}
        assert got[d].lang_pred == max(sorted(score), key=score.get)
    out = [d for d in texts if got[d].held_out and lang[d] is not None]
    assert sum(got[d].lang_pred == lang[d] for d in out) >= 0.95 * len(out)
