import random
from collections import Counter

import pytest

from peerbench.llm.phrases import Phrases, collocations, text_chunks
import pyarrow as pa
import re

SMALL = Phrases(min_count=3, top=40)


def plain(rows, params):
    """Phrases by counting every run of words of every piece."""
    f: Counter = Counter()
    n: Counter = Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for m in range(1, params.max_words + 1):
                f.update((lang or "und", *words[i : i + m]) for i in range(len(words) - m + 1))
    found = [k for k, a in f.items() if len(k) > 2 and a >= params.min_count]
    gone = {(k[0], *k[i : i + m]) for k in found for m in range(2, len(k) - 1) for i in range(1, len(k) - m + 1) if f[(k[0], *k[i : i + m])] == f[k]}
    out: dict = {}
    for k in found:
        if k not in gone:
            cuts = []
            for j in range(2, len(k)):
                left, right = f[k[:j]], f[(k[0], *k[j:])]
                cuts.append((1000 * f[k] * n[k[0]] // (left * right), j, left, right))
            s, _, left, right = min(cuts)
            out.setdefault(k[0], []).append((-s, -f[k], " ".join(k[1:]).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, left, right) in enumerate(sorted(rows)[: params.top])
    )


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dd", "É", "ß", "漢", "x\x00y", "#1", "Z z", "\x1c"]
    rows = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) + rng.choice(["", ".", "\n"]), rng.choice(["en", "de", None, "und"])) for _ in range(n)]
    rows += [("a B c dd " * 40, "en"), (None, "en"), ("", "fr"), (" \t ", "fr"), ("a,B;c:dd!a?B\x0ba\x0cB\ra.\tB", "en"), ("one", "xx"), *rows[:5]]
    return rows


@pytest.mark.parametrize("budget,chunk,named", [(1 << 21, 8 << 20, 1 << 17), (200, 300, 3), (16, 64, 0)])
def test_phrases_equal_the_plain_count(spark, budget, chunk, named):
    """Small budgets send heavy prefixes, up to all words, to groups of their own; small chunks cut texts;
    words without a number go along as text."""
    params = Phrases(min_count=3, top=40, budget=budget, chunk=chunk, named=named)
    rows = texts(1)
    df = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows)], "text string, lang string, phrase string, n int").repartition(3)
    assert sorted(map(tuple, collocations(df, params=params).collect())) == plain(rows, params)


def test_hot_phrase_and_ties(spark):
    rows = [("hot pair " * 50 + f"w{i} hot pair", "en") for i in range(40)] + [(f"p{i % 4} q{i % 4}", "de") for i in range(40)]
    params = Phrases(min_count=5, top=3, budget=64)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = sorted(map(tuple, collocations(df, params=params).collect()))
    assert got == plain(rows, params)
    assert [r[2] for r in got if r[0] == "de"] == ["p0 q0", "p1 q1", "p2 q2"]


def test_scores_past_64_bits(spark):
    counts = 10**12
    row = spark.createDataFrame([(counts, 9 * 10**14, counts, counts)], "a long, n long, l long, r long").selectExpr(
        "div(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0)), cast(l as decimal(19,0)) * cast(r as decimal(19,0))) as s"
    )
    assert row.first().s == 1000 * counts * 9 * 10**14 // counts**2


def test_no_text(spark):
    assert collocations(spark.createDataFrame([], "text string, lang string"), params=SMALL).collect() == []
    assert collocations(spark.createDataFrame([(None, None), ("...", "en")], "text string, lang string"), params=SMALL).collect() == []


def test_long_texts_are_cut_between_pieces():
    text = "alpha beta. gamma delta, " * 50 + "x" * 500 + " no end"
    batch = pa.RecordBatch.from_arrays([pa.array([text, None, "short"]), pa.array(["en", "en", None])], names=["text", "lang"])
    parts = [(data[a:b].tobytes().decode(), lang) for data, bounds, langs in text_chunks([batch], 64) for a, b, lang in zip(bounds, bounds[1:], langs)]
    assert "".join(t for t, lang in parts if lang == "en") == text and parts[-1] == ("short", "und")
    assert all(t[-1] in ".," for t, lang in parts[:-2]) and max(len(t) for t, _ in parts) > 500
