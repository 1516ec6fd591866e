"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside four fixed base patterns."""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.shared import map_batches, texts

KINDS = ("email", "ip", "card", "phone")
#: Window and step in characters: a span of up to WINDOW - STEP characters lies whole in some window.
WINDOW, STEP = 96, 48

# Base patterns (fixed values).
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_trigger = re.compile(r"[@0-9]")
_digit = re.compile(r"[0-9]")
_local_char = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _card_ok(s: str) -> bool:
    digits = "".join(_digit.findall(s))
    return 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> list[tuple[int, int]]:
    """The pattern's matches, found from their @: a local part reaches left to the last match or the first other character."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _local_char:
            start -= 1
        if start < at and (m := _domain.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, kind: leftmost non-overlapping matches per kind, less those that fail their check."""
    if not _trigger.search(text):
        return []
    found = [(s, 0, e) for s, e in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _ip.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    found += [(m.start(), 2, m.end()) for m in _card.finditer(text) if _card_ok(m.group())]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _phone.finditer(text) if 9 <= len(_digit.findall(m.group())) <= 15]
    return sorted(found)


# ---- the model ----

_signs = "@.-+() \n/:_%#$&*!=\"',[]|<>\\;?{}~^`\t"
_table = np.full(128, 2, np.uint8)
for _i, _c in enumerate(_signs):
    _table[ord(_c)] = 6 + _i
_table[ord("0") : ord("9") + 1] = 3
_table[ord("A") : ord("Z") + 1] = 4
for _i in range(26):
    _table[ord("a") + _i] = 6 + len(_signs) + _i
PAD, LETTER, SYMBOLS = 0, 1, 6 + len(_signs) + 26
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
_forbidden = np.zeros((TAGS, TAGS), np.float32)
for _k in range(len(KINDS)):
    _forbidden[:, 2 + 2 * _k] = -1e4
    _forbidden[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = 0
_no_start = np.array([0] + [0, -1e4] * len(KINDS), np.float32)


def char_ids(text: str) -> np.ndarray:
    """A small symbol number per code point: digits are one symbol, so are upper-case and letters beyond ASCII."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(points < 128, _table[np.minimum(points, 127)], np.where(points >= 0xC0, LETTER, 2)).astype(np.uint8)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Tagger:
    """Weights of the bidirectional LSTM, its output layer and the CRF transitions."""

    def __init__(self, hidden: int = 20, embedding: int = 16, seed: int = 7):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.w = {"e": init(SYMBOLS, embedding) * 2, "out": init(2 * hidden, TAGS), "bias": np.zeros(TAGS, np.float32), "trans": np.zeros((TAGS, TAGS), np.float32)}
        for way in "fb":
            self.w |= {f"x{way}": init(embedding, 4 * hidden), f"h{way}": init(hidden, 4 * hidden), f"b{way}": np.zeros(4 * hidden, np.float32)}
            self.w[f"b{way}"][hidden : 2 * hidden] = 1
        self.hidden = hidden

    def run(self, ids: np.ndarray, way: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, rows, hidden) of one direction; ids is (time, rows)."""
        n, h = self.hidden, np.zeros((ids.shape[1], self.hidden), np.float32)
        c, table, out = h.copy(), self.w["e"] @ self.w[f"x{way}"] + self.w[f"b{way}"], np.empty((*ids.shape, self.hidden), np.float32)
        for t in range(len(ids)) if way == "f" else range(len(ids) - 1, -1, -1):
            z = table[ids[t]]
            z += h @ self.w[f"h{way}"]
            gates, g = _sigmoid(z[:, : 3 * n]), np.tanh(z[:, 3 * n :])
            before, c = c, gates[:, n : 2 * n] * c + gates[:, :n] * g
            tanh_c = np.tanh(c)
            if keep is not None:
                keep.append((t, gates, g, before, tanh_c, h))
            h = gates[:, 2 * n :] * tanh_c
            out[t] = h
        return out

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return np.concatenate([self.run(ids, "f"), self.run(ids, "b")], -1) @ self.w["out"] + self.w["bias"]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags (time, rows), and by how much each tag's emission beats O."""
        em, trans = self.emissions(ids), self.w["trans"] + _forbidden
        score, back = em[0] + _no_start, np.empty(em.shape, np.uint8)
        for t in range(1, len(em)):
            paths = score[:, :, None] + trans
            back[t] = paths.argmax(1)
            score = np.take_along_axis(paths, back[t][:, None, :].astype(np.int64), 1)[:, 0] + em[t]
        tags = np.empty(ids.shape, np.int64)
        tags[-1] = score.argmax(1)
        rows = np.arange(ids.shape[1])
        for t in range(len(em) - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        return tags, np.take_along_axis(em, tags[:, :, None], 2)[:, :, 0] - em[:, :, 0]

    def gradients(self, ids: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the gold tags under the CRF, and its gradients."""
        n, (steps, rows) = self.hidden, ids.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self.run(ids, "f", kept["f"]), self.run(ids, "b", kept["b"])], -1)
        em, trans = states @ self.w["out"] + self.w["bias"], self.w["trans"] + _forbidden
        lse = lambda x, axis: (m := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - m).sum(axis))
        alpha, beta = np.empty_like(em), np.zeros_like(em)
        alpha[0] = em[0] + _no_start
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + trans, 1) + em[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans[None] + (em[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        d_em = np.exp(alpha + beta - total[None, :, None])
        pair = np.exp(alpha[:-1, :, :, None] + trans + (em[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None])
        d_trans = pair.sum((0, 1))
        np.add.at(d_trans, (gold[:-1], gold[1:]), -1)
        score = np.take_along_axis(em, gold[:, :, None], 2).sum() + self.w["trans"][gold[:-1], gold[1:]].sum()
        np.put_along_axis(d_em, gold[:, :, None], np.take_along_axis(d_em, gold[:, :, None], 2) - 1, 2)
        d_em /= rows
        g = {"out": np.tensordot(states, d_em, ([0, 1], [0, 1])), "bias": d_em.sum((0, 1)), "trans": d_trans / rows, "e": np.zeros_like(self.w["e"])}
        d_states = d_em @ self.w["out"].T
        for way, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
            wh, dz_all = self.w[f"h{way}"], np.empty((steps, rows, 4 * n), np.float32)
            dh, dc, d_wh = np.zeros((rows, n), np.float32), np.zeros((rows, n), np.float32), np.zeros_like(wh)
            for t, gates, cand, before, tanh_c, h_before in reversed(kept[way]):
                dh = dh + d_states[t][:, part]
                dc = dc + dh * gates[:, 2 * n :] * (1 - tanh_c**2)
                dz = np.concatenate([dc * cand, dc * before, dh * tanh_c], 1) * gates * (1 - gates)
                dz = np.concatenate([dz, dc * gates[:, :n] * (1 - cand**2)], 1)
                dz_all[t] = dz
                d_wh += h_before.T @ dz
                dh, dc = dz @ wh.T, dc * gates[:, n : 2 * n]
            by_symbol = np.zeros((SYMBOLS, 4 * n), np.float32)
            np.add.at(by_symbol, ids.ravel(), dz_all.reshape(-1, 4 * n))
            g |= {f"h{way}": d_wh, f"b{way}": by_symbol.sum(0), f"x{way}": self.w["e"].T @ by_symbol}
            g["e"] += by_symbol @ self.w[f"x{way}"].T
        return float(total.sum() - score) / rows, g


class Writer:
    """Labelled training windows: invented prose around personal data in many spellings, and numbers that are none."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def pick(self, of):
        return self.r.choice(of)

    def digits(self, n: int) -> str:
        return str(self.r.randrange(10**n)).zfill(n)

    def word(self) -> str:
        parts = "an er th on re he in ti es or st en at to nt ha nd ou ea ng as ció ñ que è ment eau ü ß sch keit ge der la de".split()
        w = "".join(self.pick(parts) for _ in range(self.r.randrange(1, 5)))
        return w.capitalize() if self.r.random() < 0.15 else w

    def prose(self, n: int) -> str:
        style = self.r.random()
        words = [self.word() for _ in range(n)]
        if style < 0.08:
            words = [w.upper() + "!!" for w in words]
        elif style < 0.16:
            words = [w + self.pick(["###", "$$$", "%%%", "&&&", "***"]) for w in words]
        return "".join(w + self.pick([" "] * 12 + [", ", ". ", ".\n", "\n", ": "]) for w in words)

    def email(self) -> str:
        low = lambda a, b: "".join(self.pick("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randrange(a, b)))
        name = low(2, 9) + self.pick(["", "", ".", "_", "+", "-"]) + self.pick(["", low(1, 8), self.digits(self.r.randrange(1, 4))])
        host = low(2, 9) + self.pick(["", "", self.digits(1)]) + "." + self.pick(["com", "org", "net", "de", "fr", "es", "example.com", "co.uk", "edu", "info"])
        return name.rstrip("._+-") + self.pick(["@"] * 8 + [" @ ", "(@)", " [@] "]) + host

    def ip(self) -> str:
        if self.r.random() < 0.2:
            return ":".join(f"{self.r.randrange(1, 65536):x}" for _ in range(8))
        return ".".join(str(self.r.randrange(256)) for _ in range(4))

    def card(self) -> str:
        body = self.pick("3456") + self.digits(14)
        number = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return self.pick(["", "", " ", "-", ".", "/"]).join(number[i : i + 4] for i in range(0, 16, 4))

    def phone(self) -> str:
        d = self.digits
        return self.pick([f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(2)}-{d(3)}-{d(3)}-{d(3)}", f"({d(3)}) {d(3)}-{d(4)}", f"{self.r.randrange(200, 1000)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"00{d(2)} {d(3)} {d(6)}", f"0{d(4)}/{d(6)}", f"0{d(4)}/{d(6)}", f"0{d(4)}/{d(6)}", f"0{d(3)}/{d(7)}", f"{self.r.randrange(200, 1000)}-{d(3)}-{d(4)}", f"{self.r.randrange(200, 1000)}.{d(3)}.{d(4)}"])

    def other(self) -> str:
        d = self.digits
        n = self.r.randrange(1, 8)
        return self.pick([f"{d(1)}.{d(1)}", f"{d(1)}.{d(1)}.", f"{d(1)}.{d(1)}.{d(1)}", f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}:{d(2)}", f"{d(2)}/{d(2)}/19{d(2)}", f"${d(n)}.{d(2)}", d(n), f"{d(1)},{d(3)},{d(3)}", f"{d(2)}%", f'token = "{self.r.randbytes(20).hex()}"', self.r.randbytes(16).hex(), f"19{d(2)}-20{d(2)}", f"v{d(1)}", f"@{self.word()}", "@ ", f"#{d(4)}", f"ISBN 978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", f"AKIA{self.r.randbytes(8).hex().upper()}", self.numbered()])

    def numbered(self) -> str:
        """A number that is nobody's: of an order, a tax office, an account, a match."""
        d, f = self.digits, lambda n: str(self.r.randrange(10 ** (n - 1), 10**n))
        name = self.pick(["order", "Order no.", "invoice", "ref", "Tax", "tax number", "Account", "account no.", "IBAN", "Steuernummer", "commande", "pedido", "case", "serial", "part"])
        number = self.pick([f"20{d(2)}-{d(6)}-{d(2)}", f"{f(3)}/{d(3)}/{d(5)}", f"{f(4)} {d(4)} {d(4)}", f"{f(2)}-{d(7)}", f"{f(5)}-{d(5)}", f"{f(2)} {d(3)} {d(3)}", f"{f(8)}", f"{f(12)}", f"20{d(2)}/{d(5)}", f"{f(6)}-{d(4)}", f"DE{d(2)} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}"])
        return self.pick([f"{name} {number}", f"{name}: {number}", f"{name} {number}", number, f"{d(1)}-{d(1)}, {d(1)}-{d(1)}, {d(1)}-{d(1)}", f"{d(1)}:{d(1)} ({d(1)}:{d(1)})"])

    def window(self) -> tuple[np.ndarray, np.ndarray]:
        """A window of a long text, or one that begins a text, ends it, or holds it all: what lies behind an end is padding."""
        place = self.r.random()
        text = "" if place < 0.25 and self.r.random() < 0.5 else self.prose(self.r.randrange(12))
        tags = [0] * len(text)
        size = self.r.randrange(8, WINDOW) if place < 0.15 else WINDOW + 40
        while True:
            k = self.pick((0, 1, 2, 3, 3, 3, 4, 5, 6))  # telephone numbers come in most shapes
            piece = getattr(self, KINDS[k])() if k < 4 else self.other()
            if k == 3 and self.r.random() < 0.3:
                called = self.pick(["tel ", "Tel.: ", "call ", "phone ", "Fax: ", "mobile "])
                text, tags = text + called, tags + [0] * len(called)
            text += piece
            tags += [1 + 2 * k] + [2 + 2 * k] * (len(piece) - 1) if k < 4 else [0] * len(piece)
            if len(text) >= size:
                break
            between = self.pick([" "] * 6 + [", ", ". ", "\n", "### ", "!! ", ") ", '" ']) + self.prose(self.r.randrange(1, 8))
            text += between
            tags += [0] * len(between)
        if self.r.random() < 0.5:
            end = self.pick([".", "", "\n", "!", " "]) + (self.prose(self.r.randrange(6)) if self.r.random() < 0.5 else "")
            text, tags = text + end, tags + [0] * len(end)
        if place < 0.25:
            start = 0
        elif place < 0.5:  # up to the text's end
            start = max(0, len(text) - self.r.randrange(8, WINDOW + 1))
        else:
            start = self.r.randrange(max(1, len(text) - WINDOW))
        gold, ids = np.zeros(WINDOW, np.int64), np.full(WINDOW, PAD, np.uint8)
        begin = int(place < 0.25 or start == 0)  # padding before a text's first character, too
        part = tags[start : start + WINDOW - begin]
        gold[begin : begin + len(part)] = part
        ids[begin : begin + len(part)] = char_ids(text[start : start + WINDOW - begin])
        if gold[0] and gold[0] % 2 == 0:
            gold[0] -= 1  # a span that the window cuts begins at its edge
        return ids, gold


@lru_cache(maxsize=2)
def trained(steps: int = 540, rows: int = 32, seed: int = 11) -> Tagger:
    """The tagger, trained by Adam on written windows; no table is read, so a process trains it once for any input."""
    tagger, writer = Tagger(), Writer(seed)
    m = {k: np.zeros_like(v) for k, v in tagger.w.items()}
    v = {k: np.zeros_like(x) for k, x in tagger.w.items()}
    for step in range(1, steps + 1):
        windows = [writer.window() for _ in range(rows)]
        ids, gold = np.stack([w[0] for w in windows], 1), np.stack([w[1] for w in windows], 1)
        _, g = tagger.gradients(ids, gold)
        norm = np.sqrt(sum(float((x**2).sum()) for x in g.values()))
        rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
        for k, x in g.items():
            x = x * min(1, 5 / max(norm, 1e-6))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x**2
            tagger.w[k] = (tagger.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return tagger


# ---- decoding and reconciliation ----


def _window_starts(text: str) -> list[int]:
    """Of the overlapping windows, those with a digit or an @: without one, no kind can occur."""
    last = max(0, -(-(len(text) - WINDOW) // STEP)) * STEP
    starts: set[int] = set()
    for m in _trigger.finditer(text):
        k = m.start() // STEP * STEP
        starts.update((min(k, last), max(0, min(k - STEP, last))))
    return sorted(starts)


def _plausible(kind: int, s: str) -> bool:
    digits = len(_digit.findall(s))
    if kind == 0:
        return bool(re.fullmatch(r"[^\s@]+[\s(\[]*@[\s)\]]*[^\s@]+\.[^\s@.]{2,}", s))
    if kind == 1:
        parts = s.split(".")
        return len(parts) == 4 and all(re.fullmatch(r"[0-9]{1,3}", p) and int(p) <= 255 for p in parts) or bool(re.fullmatch(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", s))
    if kind == 2:
        return bool(re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", s)) and _card_ok(s)
    # With a country's or an area's prefix, or in the groups of North America.
    return 9 <= digits <= 15 and bool(re.fullmatch(r"(?:[+(]|0(?=.*[ ()./-]))[0-9 ()./-]+[0-9]|[2-9][0-9]{2}([-. ])[0-9]{3}\1[0-9]{4}", s))


def reconcile(found: list[tuple[int, int, int, float, bool]]) -> list[tuple[int, int, int]]:
    """Spans (start, end, kind, score, cut) of all windows to non-overlapping (start, kind, end) of the greatest total score.

    A span that its window cuts counts where no other window holds it whole; cut ones that overlap join. Spans are
    swept in order of their places, so a text of many spans takes time in proportion.
    """
    whole = {(s, e, k): w for s, e, k, w, cut in sorted(found, key=lambda x: x[3]) if not cut}
    parts, reach, held = [], [-1] * len(KINDS), sorted(whole)
    at = 0
    for s, e, k, w, _ in sorted(x for x in found if x[4]):
        while at < len(held) and held[at][0] <= s:  # whole spans that begin no later: how far those of each kind reach
            reach[held[at][2]] = max(reach[held[at][2]], held[at][1])
            at += 1
        if reach[k] < e:
            parts.append((s, e, k, w))
    joined: list[list] = []
    for s, e, k, w in parts:
        if joined and joined[-1][2] == k and s < joined[-1][1]:
            joined[-1][1], joined[-1][3] = max(e, joined[-1][1]), joined[-1][3] + w
        else:
            joined.append([s, e, k, w])
    spans = sorted([(s, e, k, w) for (s, e, k), w in whole.items()] + [tuple(x) for x in joined], key=lambda x: (x[1], x[0], x[2]))
    best: list[tuple[float, tuple]] = [(0.0, ())]
    ends = [0]
    for s, e, k, w in spans:
        before = bisect_right(ends, s) - 1
        take = best[before][0] + max(w, 1e-3)
        if take > best[-1][0]:
            best.append((take, (before, (s, k, e))))
        else:
            best.append((best[-1][0], (len(best) - 1, None)))
        ends.append(e)
    out, at = [], len(best) - 1
    while at:
        at, span = best[at][1]
        if span:
            out.append(span)
    return sorted(out)


def model_spans(tagger: Tagger, several: list[str], rows: int = 512) -> list[list[tuple[int, int, int]]]:
    """The model's spans of each text, windows of all texts decoded together; padding stands before a text and behind it."""
    several = [" " + text for text in several]
    places = [(i, s) for i, text in enumerate(several) for s in _window_starts(text)]
    ids = {i: char_ids(several[i]) for i in {i for i, _ in places}}
    for own in ids.values():
        own[0] = PAD
    found: dict[int, list] = {}
    for at in range(0, len(places), rows):
        part = places[at : at + rows]
        block = np.full((WINDOW, len(part)), PAD, np.uint8)
        for j, (i, s) in enumerate(part):
            piece = ids[i][s : s + WINDOW]
            block[: len(piece), j] = piece
        tags, margin = tagger.decode(block)
        begins = (tags % 2 == 1).T
        for j in np.flatnonzero(begins.any(1)):
            i, s = part[j]
            size = min(WINDOW, len(ids[i]) - s)
            for b in np.flatnonzero(begins[j]):
                e = b + 1
                while e < size and tags[e, j] == tags[b, j] + 1:
                    e += 1
                cut = b == 0 and s > 0 or e == WINDOW and s + e < len(ids[i])
                if b < size:
                    found.setdefault(i, []).append((s + int(b), s + int(e), int(tags[b, j] - 1) // 2, float(margin[b:e, j].sum()), bool(cut)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in several]
    for i, spans in found.items():
        for s, k, e in reconcile(spans):
            piece = several[i][s:e]
            s, e = s + len(piece) - len(piece.lstrip()), e - (len(piece) - len(piece.rstrip(" .,\n")))
            if _plausible(k, several[i][s:e]):
                out[i].append((s - 1, k, e - 1))
    return out


def added(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of more that overlap no base span, by one sweep over both in order of their starts."""
    out, reach, at = [], 0, 0
    for s, k, e in more:
        while at < len(base) and base[at][0] < e:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s:
            out.append((s, k, e))
    return out


def all_spans(tagger: Tagger, several: list[str]) -> list[tuple[list, list]]:
    """(base spans, base and added spans) of each text; a model span that overlaps a base span adds nothing."""
    out = []
    for text, more in zip(several, model_spans(tagger, several)):
        base = base_spans(text)
        out.append((base, sorted(base + added(base, sorted(more)))))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, text, base and spans (kind:start:end in code points, comma-joined) for every row of docs.

    Whole texts are searched: the base patterns everywhere, the model in every window that holds a digit or an @,
    which every kind has. A null text is empty and has no spans; repeated rows give repeated rows; an empty table
    gives an empty result. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        several = texts(batch)
        found = all_spans(sent.value, several)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([_joined(b) for b, _ in found], pa.string()), pa.array([_joined(a) for _, a in found], pa.string())], names=["doc_id", "base", "spans"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"], "doc_id long, base string, spans string", step)


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Every span's text gives way to its kind in brackets; of overlapping spans, the first names the kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """docs with personal data replaced in text, n_chars following where there is such a column; null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(tagger or trained())

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        several = batch.column("text").to_pylist()
        found = all_spans(sent.value, [t or "" for t in several])
        clean = [t if t is None or not spans else redact_text(t, spans) for t, (_, spans) in zip(several, found)]
        return batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(clean, pa.string()))

    out = map_batches(docs, docs.columns, docs.schema, step)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out
