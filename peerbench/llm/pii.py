"""Personal data, also where it is disguised, with spans in the source text.

Base spans are plain matches of an e-mail address, an IP address, a card number and a phone number.
Disguised ones are found in a normalised text: transducers rewrite look-alike characters, spelled
digits and written-out "at" and "dot", and keep for every character of what they write the source
characters that it stands for. The same detectors then run on the normalised text, and their spans are
mapped back. A span found there is added if it holds something rewritten and is not part of a base span
of its kind; base spans always stay.

A plain word "at" counts as a sign only within an address: with a written-out dot after it, or one of
``DOMAINS`` at the end. With another ending the ending has to be written in one case with the rest, and the
word before "at" must not be one of prose; a country code will do then, and any ending (also a country code
that is a word, as in "at work.so we") with a local part that has marks or digits, or with a word such as
"mail" or "Kontakt" before it. The names of the sign in the languages of the corpus, such as "arroba", need
no such test. Spelled digits count only within runs of digits and number signs.

Defined results: null and empty texts have no span. Every row, repeated ones and those with a null id
too, gives one row. Long texts are handled whole. Other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerbench.llm.tables import carried, uncarried

KINDS = ("email", "ip", "card", "phone")

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3,}")
PART = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# fixed values: letters of other scripts that look like Latin ones, in pairs
LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХԚԜаеѕіјһорсухԁԛԝѵӏ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυχ" + "․‐‑–−",
        "ABESIJKMHOPCTYXQWaesijhopcyxdqwvl" + "ABEZHIKMNOPTYXovikpux" + ".----",
        strict=True,
    )
)
# fixed values: zero width space, joiners, word joiner, byte order mark, soft hyphen
INVISIBLE = "​‌‍⁠﻿­"
# fixed values: digits in the languages of the corpus
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOT_WORDS = ("dot", "punkt", "point", "punto")
AT_WORDS = ("at",)
# fixed values: names of the sign in the languages of the corpus, and words for it that count in brackets only
AT_NAMES = ("arroba", "arobase", "arrobase", "arobas", "arrobas", "klammeraffe", "at-zeichen", "atzeichen", "affenschwanz", "ät")
AT_IN_BRACKETS = ("chez", "à", "bei", "a commercial")
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io")
# fixed values: country codes, and those of them that are common words
COUNTRIES = frozenset(
    "ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz "
    "de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo jp "
    "ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni nl no np nr nu nz "
    "om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz "
    "ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw".split()
)
WORD_COUNTRIES = frozenset("am as at be by do in is it me my no so to us".split())
# fixed values: words before "at" in prose, words that make a name of what follows, and words before an address
PROSE = frozenset(
    "a all also am and apply are arrive arrived available back based be been began but buy check checked click down download end ended even everyone find found go had has have he her here him his hosted i is it "
    "join joined just laugh live lives located look looked looking looks me meet met more not now one online only or out page people photo point posted published read register registered saw see seen she shop shouted "
    "sign site sold someone start started stay stayed stop stopped that them then there they this up us visit was we website went were work worked working works you "
    "ask bug bugs book booked browse code details developer docs engineer everything free games help helpdesk hosting info information issue issues job jobs learn life list login movies music news order page play post posts pricing "
    "project released search something stories stuff support talk talked things tickets us videos watch watched write "
    "alles arbeite arbeiten arbeitet bestellt bin bist da dabei das der die dort du er es gefunden gekauft gibt habe haben hier ich ihn ihr ist jetzt kaufen kauft lesen man mehr nur sie sind steht treffen uns war waren wir wohnt wurde zu "
    "achat achète acheter aller avec avons chercher dans elle elles est et était ici il ils je lire mais nous on ou plus pour sommes sont sur travaille travaillons trouve trouver tu voir vous "
    "aquí compra comprar con ellos ella era eres es está están estamos estoy hay lee leer más nos nosotros para pero se ser son soy trabaja trabajo una ver y yo".split()
)
NAMING = frozenset("a an any each every her his its my no our some that the their these this those your".split())
COMPATIBLE = ("<wide>", "<narrow>", "<font>", "<circle>", "<small>")

_DOT_WORD, _AT_WORD, _AT_NAME = "|".join(DOT_WORDS), "|".join((*AT_WORDS, *AT_NAMES)), "|".join(AT_NAMES)
_AT_BRACKETED = "|".join((*AT_WORDS, *AT_NAMES, *AT_IN_BRACKETS))
_OPEN, _CLOSE = r"[ \t]?[\[({<][ \t]?", r"[ \t]?[\])}>][ \t]?"
_DOT = rf"(?:{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}|[ \t]+(?:{_DOT_WORD})[ \t]+|\.)"
_AT = rf"(?P<at>{_OPEN}(?:{_AT_BRACKETED}|@){_CLOSE}|[ \t]+(?:{_AT_WORD})[ \t]+|[ \t]?@[ \t]?)"
_AT_FIRST = re.compile(_AT.replace("|[ \\t]+(", "|(?<![ \\t])[ \\t]+("), re.IGNORECASE)
_HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_LABEL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-"
_DOT_LAST = re.compile(rf"(?:{_DOT})\Z", re.IGNORECASE)
_ADDRESS_SIGN = re.compile(rf"[\[({{<][ \t]?(?:{_AT_BRACKETED}|{_DOT_WORD}|@|\.)[ \t]?[\])}}>]|[ \t](?:{_DOT_WORD}|{_AT_NAME})[ \t]|[ \t]@|@[ \t]|[ \t](?:{'|'.join(AT_WORDS)})[ \t]+[A-Za-z0-9.-]+\.[A-Za-z]{{2}}", re.IGNORECASE)
_BEFORE_ADDRESS = re.compile(
    r"\b(?:e-?mails?|mailto|mail|contact|write|reach|kontakt|schreib\w*|erreichbar|courriel|mél|contacte[rz]?|écri\w*|correo|contacto|contacta\w*|escrib\w*)\b"
    r"(?:[ \t]+(?:address|adresse|electrónico|me|us|to|is|unter|an|ist|est|à|es|a|mir|uns|moi|nous))*[ \t]*[:=]?[ \t]*$", re.IGNORECASE)  # fmt: skip
_DOT_TOKEN, _AT_TOKEN = re.compile(_DOT, re.IGNORECASE), re.compile(_AT, re.IGNORECASE)

_DIGIT_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_NUMBER_TOKEN = re.compile(rf"(?P<word>\b(?:{_DIGIT_WORD})\b)|(?P<times>\b(?:double|triple)\b)|(?P<dot>[ \t]*{_OPEN}(?:{_DOT_WORD}|\.){_CLOSE}[ \t]*|[ \t]*\b(?:{_DOT_WORD})\b[ \t]*)|(?P<plus>\bplus\b[ \t]*)|(?P<digit>[0-9])|(?P<gap>[ \t-]+|,[ \t]+)|(?P<sign>[.()+])", re.IGNORECASE)
_NUMBER_RUN = re.compile(rf"(?:(?:\b(?:{_DIGIT_WORD}|double|triple|plus|{_DOT_WORD})\b|[0-9]|[\[({{<.)\]}}>+])[ \t,-]*){{4,}}", re.IGNORECASE)
_NUMBER_SIGN = re.compile(rf"\b(?:{_DIGIT_WORD})\b[ \t,.()\[\]-]+(?:(?:{_DIGIT_WORD}|double|triple|{_DOT_WORD})\b|[0-9])|[0-9][ \t]*[\[({{<]?[ \t]?(?:{_DOT_WORD}|\[\.)\b|\b(?:{_DOT_WORD})\b[ \t\])}}>]*[0-9]|\bplus[ \t]+(?:[0-9]|(?:{_DIGIT_WORD})\b)|[0-9][\[({{<]\.[\])}}>][0-9]", re.IGNORECASE)

_SIGN_WORDS = {*DIGIT_WORDS, *DOT_WORDS, "double", "triple", "plus"}
_LAST_WORD = re.compile(r"\b([A-Za-z]+)[ \t]+$")
_LETTERS, _DIGIT = re.compile("[a-zéüö]+"), re.compile("[0-9]")

Span = tuple[str, int, int]
#: A normalised text with the source bounds of each of its characters.
Mapped = tuple[str, list[int], list[int]]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``: from each sign back over its local part
    and on over its host, so that no run is looked at from each of its characters."""
    last, at = 0, text.find("@")
    while at >= 0:
        begin = last + len(text[last:at].rstrip(LOCAL))
        host = HOST.match(text, at + 1) if begin < at else None
        last = host.end() if host else at + 1
        if host:
            yield begin, last
        at = text.find("@", last)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Matches of four numbers with dots between, each run of such numbers cut into fours from its start."""
    for run in DOTTED.finditer(text):
        parts = list(PART.finditer(text, *run.span()))
        for i in range(0, len(parts) - 3, 4):
            yield parts[i].start(), parts[i + 3].end()


def _is_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in text.split("."))


def _found_by(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text))


#: How a kind's matches are found, a character that they need, and whether a match holds.
DETECTORS: dict[str, tuple[Callable[[str], Iterator[tuple[int, int]]], str, Callable[[str], bool]]] = {
    "email": (emails, "@", lambda m: True),
    "ip": (addresses, ".", _is_ip),
    "card": (_found_by(CARD), "", _is_card),
    "phone": (_found_by(PHONE), "+", lambda m: 8 <= len(_digits(m)) <= 15),
}


def detect(text: str) -> list[Span]:
    """Plain matches, by kind, then start."""
    return [(kind, lo, hi) for kind in KINDS for find, needs, holds in [DETECTORS[kind]] if needs in text for lo, hi in find(text) if holds(text[lo:hi])]


@lru_cache(maxsize=20_000)
def plain_char(c: str) -> str:
    """What a character looks like, or itself."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    tag, _, _ = unicodedata.decomposition(c).partition(" ")
    if tag in COMPATIBLE:
        like = unicodedata.normalize("NFKC", c)
        if len(like) == 1 and like.isascii():
            return like
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


def rewrite(mapped: Mapped, edits: list[tuple[int, int, str]]) -> Mapped:
    """Replace parts of a mapped text, given in order; every new character stands for its whole part."""
    text, starts, ends = mapped
    out, new_starts, new_ends, at = [], [], [], 0
    for lo, hi, by in edits:
        out += [text[at:lo], by]
        new_starts += starts[at:lo]
        new_ends += ends[at:lo]
        if lo < hi:
            new_starts += [starts[lo]] * len(by)
            new_ends += [ends[hi - 1]] * len(by)
        at = hi
    out.append(text[at:])
    return "".join(out), new_starts + starts[at:], new_ends + ends[at:]


def char_edits(text: str) -> list[tuple[int, int, str]]:
    odd = {c: plain_char(c) for c in set(text) if not c.isascii()}
    odd = {c: x for c, x in odd.items() if c != x}
    return [(i, i + 1, odd[c]) for i, c in enumerate(text) if c in odd] if odd else []


@dataclass(frozen=True)
class Disguised:
    """Places in an address: local part, sign, host and end."""

    start: int
    at: int
    host: int
    end: int


def disguised_addresses(text: str) -> Iterator[Disguised]:
    """From each sign, also a written-out one, back over labels and dots to the start of the local part, and on
    over the host; matches do not overlap."""
    last, at = 0, 0
    while sign := _AT_FIRST.search(text, at):
        at, begin, before = sign.end(), sign.start(), sign.start()
        while True:
            label = text[max(last, before - 64) : before].rstrip(_LABEL)
            start = max(last, before - 64) + len(label)
            if start == before:
                break
            while not label and start > last:  # a label of more than 64 characters
                label = text[max(last, start - 4096) : start].rstrip(_LABEL)
                start = max(last, start - 4096) + len(label)
            begin = start
            dot = _DOT_LAST.search(text, max(last, start - 40), start)
            if not dot:
                break
            before = dot.start()
        host = _HOST.match(text, sign.end()) if begin < sign.start() else None
        if host:
            yield Disguised(begin, sign.start(), sign.end(), host.end())
            last = at = host.end()
        elif at == sign.start():
            at += 1


def _is_address(text: str, m: Disguised) -> bool:
    """Whether a match with a plain word "at" and plain dots is an address, by its ending, local part and context."""
    whole = text[m.start : m.end]
    ending = re.split(r"[^A-Za-z0-9-]+", text[m.host : m.end])[-1]
    code = ending.lower()
    if not (code.isalpha() and len(code) > 1 and (code in DOMAINS or ending.islower() or not any(c.islower() for c in whole))):
        return False
    local = text[m.start : m.at].lower()
    introduced = _BEFORE_ADDRESS.search(text, max(0, m.start - 60), m.start)
    if local in PROSE and not introduced:
        return False
    if not local.isalpha() and any(c.isalpha() for c in local) or introduced:
        return True
    before = _LAST_WORD.search(text, max(0, m.start - 20), m.start)
    return (code in DOMAINS or code in COUNTRIES and code not in WORD_COUNTRIES) and not (before and before[1].lower() in NAMING)


def address_edits(text: str) -> list[tuple[int, int, str]]:
    if not _ADDRESS_SIGN.search(text):
        return []
    edits = []
    for m in disguised_addresses(text):
        at = text[m.at : m.host]
        dots = list(_DOT_TOKEN.finditer(text, m.start, m.end))
        host_dots = [d[0] for d in dots if d.start() >= m.host]
        plain_at = at.strip().lower() in AT_WORDS
        if plain_at and all(d == "." for d in host_dots) and not _is_address(text, m):
            continue
        tokens = [(d.start(), d.end(), ".") for d in dots if d[0] != "." and (d.end() <= m.at or d.start() >= m.host)]
        tokens += [(m.at, m.host, "@")] if at != "@" else []
        edits += sorted(tokens)
    return edits


def _may_spell(text: str) -> bool:
    """Whether ``_NUMBER_SIGN`` can match: two of its words, one and a digit, or a dot in brackets."""
    words = sum(map(_SIGN_WORDS.__contains__, _LETTERS.findall(text.lower())))
    return words > 1 or words == 1 and bool(_DIGIT.search(text)) or any(x in text for x in ("[.", "(.", "{.", "<."))


def number_edits(text: str) -> list[tuple[int, int, str]]:
    if not _may_spell(text) or not _NUMBER_SIGN.search(text):
        return []
    edits = []
    for run in _NUMBER_RUN.finditer(text):
        tokens = list(_NUMBER_TOKEN.finditer(text, *run.span()))
        if not any(t.lastgroup in ("word", "dot", "plus") for t in tokens):
            continue
        times = 1
        for i, t in enumerate(tokens):
            kind, by = t.lastgroup, None
            before = tokens[i - 1].lastgroup if i else ""
            after = tokens[i + 1].lastgroup if i + 1 < len(tokens) else ""
            if kind == "word":
                by, times = DIGIT_WORDS[t[0].lower()] * times, 1
            elif kind == "times":
                times = 2 if t[0].lower() == "double" else 3
                by = "" if after == "gap" and i + 2 < len(tokens) and tokens[i + 2].lastgroup == "word" else None
                times = times if by is not None else 1
            elif kind == "dot":
                by = "."
            elif kind == "plus":
                by = "+"
            elif kind == "gap" and before in ("word", "times") and after in ("word", "times"):
                by = ""
            elif kind == "gap" and t[0] != " " and (before == "word" or after == "word"):
                by = " "
            if by is not None:
                edits.append((t.start(), t.end(), by))
    return edits


def disguised(text: str) -> list[Span]:
    """Spans that show only in the normalised text, in source characters."""
    mapped: Mapped | None = None
    changed: list[tuple[int, int]] = []
    for edits_of in (char_edits, address_edits, number_edits):
        edits = edits_of(mapped[0] if mapped else text)
        if edits:
            mapped = mapped or (text, list(range(len(text))), list(range(1, len(text) + 1)))
            changed += [(mapped[1][lo], mapped[2][hi - 1]) for lo, hi, _ in edits]
            mapped = rewrite(mapped, edits)
    if mapped is None:
        return []
    found = [(kind, mapped[1][lo], mapped[2][hi - 1]) for kind, lo, hi in detect(mapped[0])]
    changed.sort()
    return [x for x in found if any(lo < x[2] and hi > x[1] for lo, hi in changed)]


def find_all(text: str) -> list[tuple[str, int, int, bool]]:
    """All spans with whether they are base ones, by kind, then start."""
    base = detect(text)
    out = [(*x, True) for x in base]
    for kind, lo, hi in disguised(text):
        if not any(k == kind and a <= lo and hi <= b for k, a, b in base) and (kind, lo, hi, False) not in out:
            out.append((kind, lo, hi, False))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with ``<KIND>`` in place of each span; spans that overlap become one, of the first's kind."""
    out, at = [], 0
    for kind, lo, hi, _ in sorted(spans, key=lambda x: (x[1], -x[2])):
        if lo >= at:
            out += [text[at:lo], f"<{kind.upper()}>"]
        at = max(at, hi)
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_masked: bool = False, carry: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``spans`` (kind, start, end, base) and, if wanted, ``masked``: the text without them, or
    null where nothing was found; and the columns ``carry`` of the input."""
    more, more_schema = carried(docs, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_all(t) if t else [] for t in texts]
            spans = [[{"kind": k, "start": a, "end": b, "base": x} for k, a, b, x in f] for f in found]
            cols, names = [batch.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"]
            if with_masked:
                cols, names = [*cols, pa.array([masked(t, f) if f else None for t, f in zip(texts, found, strict=True)], pa.string())], [*names, "masked"]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[2:]], names=[*names, *batch.schema.names[2:]])

    schema = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint, base: boolean>>" + ", masked string" * with_masked + more_schema
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), *more)
    return uncarried(rows.mapInArrow(run, schema), carry)


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of their list, and the list of all spans."""
    listed = lambda spans: f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, x -> x.base and x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = F.expr(f"sha2(cast({listed('filter(spans, x -> x.base)')} as binary), 256)").alias("base_sha256")
    added = F.expr("cast(size(filter(spans, x -> not x.base)) as bigint)").alias("n_added")
    return found.select("doc_id", *counts, base, F.expr(listed("spans")).alias("spans"), added)
