import random
import re

import pytest
from quorumlab.llm import pii

PLAIN = "k.ito at example dot net"
LONG = "tom [at] department-of-molecular-biology [dot] some-university [dot] example [dot] org"
PROSE = "words of a long and harmless line that says nothing of anyone " * 4


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(pii.labelled_table(spark))


@pytest.mark.parametrize("address", [PLAIN, LONG])
@pytest.mark.parametrize("before,after", [("", ""), ("reach ", " for help"), (PROSE + "reach ", " for help " + PROSE)])
def test_spelled_addresses_are_found_whole(spark, model, address, before, after):
    text = before + address + after
    (_, added), = pii.find_spans([text], model)
    assert [text[a:b] for a, b in added[0]] == [address] and not any(added[1:])
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in pii.redact(docs, model).collect()] == [(1, f"{before}<EMAIL>{after}", len(before + "<EMAIL>" + after))]


def test_windows_end_at_token_borders(model):
    for shift in range(60):
        text = "b" * 30 + "-" + "a" * shift + " 5 " + "word" * 15 + " 1" + "7" * 90
        for start, end in pii.windows_of(text):
            inner = [t for t in pii.tokens_of(text, 0, len(text)) if start < t[2] and t[1] < end]
            assert inner == pii.tokens_of(text, start, end)


def test_windows_grow_while_labels_reach_an_end(model, monkeypatch):
    monkeypatch.setattr(pii, "AROUND", 16)
    text = PROSE + "reach " + LONG + " for help"
    (_, added), = pii.find_spans([text, None, ""], model)[:1]
    assert [text[a:b] for a, b in added[0]] == [LONG]


def test_a_plain_dot_is_no_address(model):
    (_, added), = pii.find_spans(["They met at the mill and saw a dot on the hill; the dot was far away."], model)
    assert not any(added)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn_sum(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled)


def plain_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(p.lstrip("0")[:9] or 0) <= 255 for p in m[0].split("."))],
        [m.span() for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and luhn_sum(digits(m)) % 10 == 0],
        [m.span() for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15],
    ]


def test_all_kinds_are_the_plain_patterns(documents):
    rng = random.Random(7)
    texts = [r["text"] or "" for r in documents.select("text").collect()]
    texts += ["".join(rng.choices("0123456789" * 3 + "  --..++()@ab²٣", k=rng.randrange(5, 60))) for _ in range(4000)]
    texts += [f"x{rng.choice(['', '-', ' '])}{n}" for n in ("4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009 7")]
    texts += ["0" * 5000 + ".1.1.1", "1.1.1." + "0" * 5000 + "9", "1.2.3." + "9" * 5000, "+" + "1" * 5000, "1" * 5000]
    found = 0
    for text in texts:
        spans = pii.base_spans(text)
        assert spans == plain_spans(text)
        found += len(spans[2]) + len(spans[3])
    assert found > 20


def test_no_character_ends_the_job(spark):
    """Every code point before, after and between digits; superscripts and circled digits are no digits."""
    model = pii.train(pii.labelled_table(spark))
    pii.find_spans(["area 10² metres, call 5", "see note ① on page 12", "m² 5 ① ٣ 5٣", "0" * 5000 + ".1.1.1"], model)
    assert pii.shape("²") == "²" and pii.shape("7") == "d1<256" and pii.shape("٣") == "٣"
    points = [chr(i) for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    odd = [c for c in points if c.isdigit() or c.isnumeric() or c.isspace() or not c.isprintable()]
    for c in points:
        for token, _, _ in pii.tokens_of(f"5{c}7 {c}", 0, 5):
            pii.shape(token)
    texts = ["".join(f"{c}1{c}2 " for c in odd[i : i + 50]) for i in range(0, len(odd), 50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:400])], "doc_id long, text string")
    assert pii.find(docs, model).count() == len(texts[:400])


def test_training_takes_many_long_lines():
    """The bound on labelled lines can be used: memory follows tokens, not tokens times features."""
    rows = [pii.tokens_of(f"w{i} call 555-01{i % 100:02d} a" + " b c9" * 20, 0, 400) for i in range(200)]
    sequences = [(pii.token_features(t), [0] * len(t)) for t in rows]
    model = pii.Crf.train(sequences)
    assert set(model.decode([sequences[0][0]])[0]) == {0}


def spellings(rng):
    """Personal data in spellings that the patterns miss, of names and numbers that no labelled line has."""

    def digits(n):
        return "".join(str(rng.randrange(10)) for _ in range(n))

    def card():
        first = "4" + digits(14)
        return next(first + c for c in "0123456789" if luhn_sum(first + c) % 10 == 0)

    def cut(text, mark):
        return mark.join(text[i : i + 4] for i in range(0, 16, 4))

    name, host, tld = rng.choice(["maria", "li.wei", "paul-h"]), rng.choice(["mailbox", "acme", "hotel7"]), rng.choice(["com", "org", "de"])
    return [
        (0, f"{name} [at] {host} [dot] {tld}"), (0, f"{name}(at){host}.{tld}"), (0, f"{name} at {host} dot {tld}"),
        (2, cut(card(), ".")), (2, cut(card(), "/")),
        (3, f"{rng.randrange(200, 999)}-{digits(3)}-{digits(4)}"), (3, f"({rng.randrange(200, 999)}) {digits(3)}-{digits(4)}"),
    ]


def test_the_field_finds_spellings_it_was_not_shown(model):
    rng = random.Random(2)
    hits = total = 0
    for _ in range(60):
        for kind, value in spellings(rng):
            before, after = rng.choice(["you can reach ", "number: ", "reply to "]), rng.choice([" before noon", ", thanks", " and wait"])
            (_, added), = pii.find_spans([before + value + after], model)
            hits += (len(before), len(before) + len(value)) in added[kind]
            total += 1
    assert hits >= 0.75 * total


def test_the_field_leaves_the_given_documents_alone(model, documents):
    texts = [r["text"] or "" for r in documents.collect() if not re.search(r"[@+]|[0-9][ .-][0-9]", r["text"] or "")]
    assert len(texts) > 50 and not any(any(added) for _, added in pii.find_spans(texts, model))
