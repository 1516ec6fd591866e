"""Personal data at every place of a text, and numbers that are nobody's."""

import pytest

from tradewind.llm import pii


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


@pytest.mark.parametrize("kind", pii.KINDS)
@pytest.mark.parametrize("place", ["alone", "amid a few words", "start", "middle", "end"])
def test_found_wherever_it_stands(tagger, kind, place):
    writer = pii.Writer(4000 + len(place))
    texts, spans = [], []
    for _ in range(200):
        value = getattr(writer, kind)()
        before = "" if place in ("alone", "start") else writer.prose(3 if "few" in place else 40).rstrip() + " "
        after = "" if place in ("alone", "end") else " " + writer.prose(3 if "few" in place else 40)
        texts.append(before + value + after)
        spans.append((len(before), pii.KINDS.index(kind), len(before) + len(value)))
    found = sum(s in every for s, (_, every) in zip(spans, pii.all_spans(tagger, texts)))
    assert found >= 0.95 * len(texts)


def test_numbers_that_are_nobodys(tagger):
    writer = pii.Writer(4100)
    texts = [f"{writer.prose(4)} {writer.numbered()} {writer.prose(4)}" for _ in range(300)]
    texts += ["Order number 2024-000123-77 was sent.", "Tax number 123/456/78901", "account 1234 5678 9012 at the bank", "They won 3-2, 4-1 and 2-0 in 2019-2020.", "ISBN 978-3-1234-5678-9", "On 2024-01-02 at 12:30, 45 people came", "123/456/78901", "1234 5678 9012", "2024-000123-77"]
    more = [(t, every) for t, (base, every) in zip(texts, pii.all_spans(tagger, texts)) if len(every) > len(base)]
    assert len(more) <= 0.02 * len(texts), more


def test_places_of_short_texts(tagger):
    for text in ("jo (@) mail.example.com", "Call (212) 555-0187.", "(212) 555-0187", "a\n(212) 555-0187", "é🙂 (212) 555-0187 é"):
        for _, every in pii.all_spans(tagger, [text]):
            for s, k, e in every:
                assert 0 <= s < e <= len(text) and text[s:e] == text[s:e].strip()
    assert pii.all_spans(tagger, ["", "7", "@", " "]) == [([], [])] * 4
