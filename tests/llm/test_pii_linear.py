"""Base spans equal those of the contract's patterns, and long runs take time in proportion."""

import random
import re
import time

import pytest

from peerbench.llm.pii import addresses, detect, emails, find_all

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


@pytest.mark.parametrize("alphabet", ["a.@-", "1.", "ab1.@ %é", "@.", "12.3 a"])
def test_matches_are_those_of_the_patterns(alphabet):
    rng = random.Random(alphabet)
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 24)))
        assert list(emails(text)) == [m.span() for m in EMAIL.finditer(text)], text
        assert list(addresses(text)) == [m.span() for m in IP.finditer(text)], text


@pytest.mark.parametrize(
    "text",
    [
        "x" * 5_000_000 + " a@b.co", "a@b " + "7" * 5_000_000 + " 1.2.3.4", "Ab9+/" * 1_000_000 + "@", "1." * 2_500_000 + "x", "a." * 1_000_000 + " (at) b dot co",
        " " * 3_000_000 + "me at home.de", "at " * 500_000 + "x.com", "a dot " * 300_000 + "at b dot com", "@" * 1_000_000, "+" * 1_000_000 + "1" * 1_000_000, "one " * 200_000,
    ],
    ids=range(11),
)
def test_long_runs_end_soon(text):
    start = time.process_time()
    find_all(text)
    assert time.process_time() - start < 30


def test_spans_after_long_runs():
    text = "x" * 100_000 + " jo@ex.org " + "1" * 100_000 + " 10.0.0.1"
    assert [(k, text[a:b]) for k, a, b in detect(text)] == [("email", "jo@ex.org"), ("ip", "10.0.0.1")]


PROSE = [
    "look for bugs at github.com", "buy it at amazon.com", "more at example.com", "Read it at nytimes.com", "He works at ibm.com now", "wir treffen uns at cafe.de",
    "nous sommes at orange.fr", "Watch the games at espn.com", "Siehe mehr at spiegel.de", "estamos at telefonica.es hoy", "we met her at work.org", "find a job at indeed.com today",
]


def test_prose_with_domains_is_left_alone():
    assert [t for t in PROSE if find_all(t)] == []
    for text in ("mail: jane at example.com", "ask jane.roe at example.com", "kontakt max7 at firma.de"):
        assert [k for k, *_ in find_all(text)] == ["email"], text
