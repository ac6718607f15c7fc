import hashlib
import random
import re

import pytest
from brute import SF

from peerbench.llm import queries
from peerbench.llm.pii import address_edits, char_edits, detect, digest, disguised, find_all, luhn, masked, number_edits, personal_data, rewrite

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_the_table(spark, documents):
    got = {r.doc_id: r for r in queries.op6_deobfuscation(spark, SF).collect()}
    total = 0
    for d, t in documents:
        want = base(t)
        listed = [":".join(map(str, x)) for x in want]
        r = got[d]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == k for x in want) for k in PATTERNS)
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert r.spans.split(",") == listed if listed else r.spans == ""
        total += len(want)
    assert len(got) == len(documents) and total > 50


def test_base_spans_of_random_marks():
    rng = random.Random(8)
    for _ in range(20_000):
        text = "".join(rng.choices("0123456789 +-.@(ab)é", k=rng.randint(1, 60)))
        assert detect(text) == base(text), text


@pytest.mark.parametrize(
    "text, kind, part",
    [
        ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
        ("so john dot doe at example dot com. The", "email", "john dot doe at example dot com"),
        ("user(at)mail(dot)example(dot)org", "email", "user(at)mail(dot)example(dot)org"),
        ("USER AT MAIL DOT COM", "email", "USER AT MAIL DOT COM"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ｊohn＠example．com", "email", "ｊohn＠example．com"),
        ("jo​hn@a.org", "email", "jo​hn@a.org"),
        ("a b 10[.]0[.]0[.]1 c", "ip", "10[.]0[.]0[.]1"),
        ("one nine two dot one six eight dot one dot one end", "ip", "one nine two dot one six eight dot one dot one"),
        ("192 dot 168 dot 1 dot 20", "ip", "192 dot 168 dot 1 dot 20"),
        ("card four zero four one eight nine four nine seven four six zero eight seven nine five.", "card", "four zero four one eight nine four nine seven four six zero eight seven nine five"),
        ("so 4041 8949 seven four six zero 8795", "card", "4041 8949 seven four six zero 8795"),
        ("４０４１894974608795", "card", "４０４１894974608795"),
        ("call plus four nine one five one two three four five six", "phone", "plus four nine one five one two three four five six"),
        ("+1 nine eight eight five five five two four eight five", "phone", "+1 nine eight eight five five five two four eight five"),
        ("+٤٩ ١٢٣٤٥٦٧", "phone", "+٤٩ ١٢٣٤٥٦٧"),
    ],
)
def test_disguises(text, kind, part):
    found = find_all(text)
    assert (kind, text.index(part), text.index(part) + len(part), False) in found
    assert [x[:3] for x in found if x[3]] == base(text)
    assert part not in masked(text, found)


def test_every_base_span_stays_and_clean_text_has_none(documents):
    rng = random.Random(9)
    pieces = [" at ", " dot ", "one ", "two ", "plus ", "+", "4041894974608795", "a@b.co", "1.2.3.4", "[.]", "(at)", "０", "а", "x", ".com", " ", "double "]
    for _ in range(5000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 14)))
        found = find_all(text)
        assert [x[:3] for x in found if x[3]] == base(text)
        assert all(0 <= a < b <= len(text) for _, a, b, _ in found)
    assert all(not disguised(t) for _, t in documents)


def test_offsets_of_a_rewritten_text():
    text = "a​а b [at] c dot org one two six one"
    mapped = text, list(range(len(text))), list(range(1, len(text) + 1))
    for edits_of in (char_edits, address_edits, number_edits):
        mapped = rewrite(mapped, edits_of(mapped[0]))
    assert mapped[0] == "aa b@c.org 1261"
    assert [text[a:b] for a, b in zip(mapped[1], mapped[2], strict=True)] == ["a", "а", " ", "b", " [at] ", "c", " dot ", "o", "r", "g", " ", "one", "two", "six", "one"]


def test_odd_rows(frame, spark):
    rows = [(1, ""), (2, None), (3, "a@b.co"), (3, "a@b.co"), (None, "1.2.3.4"), (4, "x" * 200_000 + " +1 (988) 555-2485")]
    got = digest(personal_data(frame(rows, extra=("spans", "kind", "masked")))).collect()
    assert len(got) == 6 and sum(r.n_email + r.n_ip + r.n_phone for r in got) == 4
    assert personal_data(spark.createDataFrame([], "doc_id bigint, text string"), with_masked=True).collect() == []
    assert luhn("4041894974608795") and not luhn("4041894974608796")
