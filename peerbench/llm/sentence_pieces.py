"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

Spaces become markers, with one more at the start; the pieces of a text are the path with the largest sum
of log scores. Ties go to the path found first, that with the longest last piece. A character that is
no piece costs more than any piece and is written as its bytes. Decoding joins pieces and bytes and turns
markers into spaces; it gives the text back, except that a marker character in a text becomes a space.

Pieces and scores come from a model file, which is read, not trained. As long as no piece has a marker
after another character, best paths never cross the start of a word, so words are solved once and kept
in a table in the task; new ones are solved together, one step of the trie for all of them at a time.

Defined results: null and empty texts have no pieces and decode to the empty text. Every row, repeated
ones and those with a null id too, gives one row. Long texts and words are handled whole. Other columns are
not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MARKER = "▁"
#: Below the least score, for characters that are no piece.
UNKNOWN_BELOW = 10.0
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
#: Entries of the table of words; when full it is emptied, which costs time only.
TABLE = 400_000
#: Longer words are solved one at a time.
LONG = 96


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


@dataclass
class PieceModel:
    """Pieces by id, and a double-array trie over their bytes: from state s, byte b leads to base[s] + b
    if check there is s; value is the piece that ends in a state, or -1."""

    pieces: list[str]
    scores: np.ndarray
    kinds: list[int]
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int
    unknown_score: float


def read_model(data: bytes) -> PieceModel:
    """The pieces of a model file. Unused pieces are in no path. A user-defined piece scores as many times the
    best normal score as it has characters, less a tenth, so that a path takes it wherever it occurs."""
    pieces, scores, kinds = [], [], []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append(own.get(1, b"").decode())
            scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
            kinds.append(own.get(3, NORMAL))
    values = np.array(scores)
    normal = values[[k == NORMAL for k in kinds]]
    for i, k in enumerate(kinds):
        if k == USER_DEFINED:
            values[i] = len(pieces[i]) * normal.max(initial=-np.inf if len(normal) else 0.0) - 0.1
    matched = {p.encode(): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
    below = float(normal.min(initial=np.inf if len(normal) else 0.0)) - UNKNOWN_BELOW
    return PieceModel(pieces, values, kinds, *double_array(matched), max(map(len, matched)), below)


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for key, value in keys.items():
        at = 0
        for b in key:
            if b not in children[at]:
                children[at][b] = len(children)
                children.append({})
                ends.append(-1)
            at = children[at][b]
        ends[at] = value
    size = 2 * len(children) + 512
    base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    taken = bytearray(size)
    taken[0] = 1
    # breadth first, as a parent's slot has to be known; single children fill the gaps, and several go
    # behind all others if they do not fit soon
    place, order, free, top = {0: 0}, [0], 256, 256
    for node in order:
        kids = children[node]
        order += kids.values()
        if not kids:
            continue
        low = min(kids)
        while taken[free]:
            free += 1
        slot, tries = free, 0
        while taken[slot] or any(taken[slot - low + b] for b in kids):
            slot, tries = slot + 1, tries + 1
            if tries == 300 and len(kids) > 1:
                slot = top + low + 1
            if slot + 512 >= len(taken):
                grow = len(taken)
                taken += bytes(grow)
                base, check, value = np.r_[base, np.zeros(grow, np.int64)], np.r_[check, np.full(grow, -1)], np.r_[value, np.full(grow, -1)]
        top = max(top, slot - low + max(kids))
        s, start = place[node], slot - low
        base[s] = start
        for b, kid in kids.items():
            place[kid] = start + b
            taken[start + b] = 1
            check[start + b] = s
            value[start + b] = ends[kid]
    used = max(place.values()) + 257
    return base[:used], check[:used], value[:used]


class PieceCoder:
    def __init__(self, model: PieceModel):
        self.model = model
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == BYTE}
        self.unknown = model.kinds.index(UNKNOWN) if UNKNOWN in model.kinds else 0
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else "⁇".encode() if k == UNKNOWN else p.encode() for p, k in zip(model.pieces, model.kinds, strict=True)]
        inside = any(MARKER in p.lstrip(MARKER) for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED))
        lines = "" if inside or any("\n" in p for p in model.pieces) else "\n"
        #: Words, with the markers before them; a line feed that is in no piece stands alone.
        self.split = re.compile(rf"{lines}|{MARKER}*[^{MARKER}{lines}]+|{MARKER}+" if lines else rf"{MARKER}*[^{MARKER}]+|{MARKER}+" if not inside else r"(?s).+")
        self.known: dict[str, bytes] = {}
        self.bytes_known = len(self.byte_ids) == 256
        self.byte_table = np.array([self.byte_ids.get(b, self.unknown) for b in range(256)], "<u4")

    def _written(self, path: list[int], ends: list[int], data: bytes) -> bytes:
        ids, at = [], 0
        for piece, end in zip(path, ends, strict=True):
            if piece >= 0:
                ids.append(piece)
            else:
                ids += [self.byte_ids[b] for b in data[at:end]] if len(self.byte_ids) == 256 else [self.unknown]
            at = end
        return np.array(ids, "<u4").tobytes()

    def solve_one(self, word: str) -> bytes:
        """Viterbi over one word, a step at a time."""
        m, data = self.model, word.encode()
        n = len(data)
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, value, scores, below = m.base, m.check, m.value, m.scores, m.unknown_score
        for i in range(n):
            if data[i] & 0xC0 == 0x80:
                continue
            first = data[i]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            single, s, j = False, 0, i
            while j < n:
                t = int(base[s]) + data[j]
                if t >= len(check) or check[t] != s:
                    break
                s, j = t, j + 1
                if value[s] >= 0:
                    single |= j - i == width
                    total = best[i] + scores[value[s]]
                    if total > best[j]:
                        best[j], back[j], piece[j] = total, i, int(value[s])
            if not single and best[i] + below > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = best[i] + below, i, -1
        return self._trace(back, piece, n, data)

    def _trace(self, back, piece, n: int, data: bytes) -> bytes:
        path, ends, at = [], [], n
        while at:
            path.append(int(piece[at]))
            ends.append(at)
            at = int(back[at])
        return self._written(path[::-1], ends[::-1], data)

    def _trace_all(self, words: list[str], grid: np.ndarray, size: np.ndarray, back: np.ndarray, piece: np.ndarray) -> None:
        """What :meth:`_trace` gives, for all words together: a step back in each, then all steps in order."""
        steps, row, at = [], np.arange(len(words)), size.astype(np.int64)
        while len(row):
            start = back[row, at].astype(np.int64)
            steps.append((row, start, at, piece[row, at]))
            on = start > 0
            row, at = row[on], start[on]
        row, start, end, which = (np.concatenate(x) for x in zip(*steps))
        order = np.lexsort((end, row))
        row, start, end, which = row[order], start[order], end[order], which[order]
        n = np.where(which >= 0, 1, end - start if self.bytes_known else 1)
        place = np.cumsum(n) - n
        within = np.arange(int(n.sum())) - np.repeat(place, n)
        ids = self.byte_table[grid[np.repeat(row, n), np.repeat(start, n) + within]] if self.bytes_known else np.full(int(n.sum()), self.unknown, "<u4")
        ids[place[which >= 0]] = which[which >= 0]
        data = ids.astype("<u4").tobytes()
        bounds = (4 * np.r_[0, np.cumsum(np.bincount(row, n, len(words)).astype(np.int64))]).tolist()
        for w, lo, hi in zip(words, bounds[:-1], bounds[1:], strict=True):
            self.known[w] = data[lo:hi]

    def solve(self, words: list[str]) -> None:
        """Viterbi over many words at once."""
        short = sorted((w for w in words if len(w) <= LONG // 4 or len(w.encode()) <= LONG), key=len)
        for w in set(words).difference(short):
            self.known[w] = self.solve_one(w)
        m = self.model
        for lo in range(0, len(short), 8192):
            some = short[lo : lo + 8192]
            data = [w.encode() for w in some]
            size = np.array([len(d) for d in data])
            width = int(size.max())
            grid = np.zeros((len(some), width + 4), np.uint8)
            flat = np.frombuffer(b"".join(data), np.uint8)
            row = np.repeat(np.arange(len(some)), size)
            grid[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            best = np.full((len(some), width + 5), -np.inf)
            back, piece = np.zeros(best.shape, np.int32), np.full(best.shape, -1, np.int32)
            best[:, 0] = 0.0
            for i in range(width):
                at = np.flatnonzero((i < size) & ((grid[:, i] & 0xC0) != 0x80))
                first = grid[at, i]
                wide = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
                single = np.zeros(len(at), bool)
                state, live, j = np.zeros(len(at), np.int64), np.arange(len(at)), i
                while len(live) and j < width:
                    live = live[j < size[at[live]]]
                    step = m.base[state[live]] + grid[at[live], j]
                    ok = (step < len(m.check)) & (m.check[np.minimum(step, len(m.check) - 1)] == state[live])
                    live, step = live[ok], step[ok]
                    state[live] = step
                    j += 1
                    found = m.value[step]
                    hit = np.flatnonzero(found >= 0)
                    if len(hit):
                        who, which = at[live[hit]], found[hit]
                        single[live[hit]] |= wide[live[hit]] == j - i
                        total = best[who, i] + m.scores[which]
                        more = total > best[who, j]
                        who = who[more]
                        best[who, j], back[who, j], piece[who, j] = total[more], i, which[more]
                who, end = at[~single], i + wide[~single]
                total = best[who, i] + m.unknown_score
                more = total > best[who, end]
                who, end = who[more], end[more]
                best[who, end], back[who, end], piece[who, end] = total[more], i, -1
            self._trace_all(some, grid, size, back, piece)

    def encode(self, texts: list[str | None], group: int = 1 << 20) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers."""
        at = 0
        while at < len(texts):
            parts, size = [], 0
            while at < len(texts) and size < group:
                text = texts[at]
                parts.append(self.split.findall(MARKER + text.replace(" ", MARKER)) if text else [])
                size += len(text or "") + 1
                at += 1
            words = set().union(*parts)
            if len(self.known) + len(words) > TABLE:
                self.known = {}
            new = words.difference(self.known)
            if new:
                self.solve(list(new))
            for x in parts:
                yield b"".join(map(self.known.__getitem__, x))

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data.replace(MARKER.encode(), b" ").decode("utf-8", "replace").removeprefix(" ")


def load_coder(path: str) -> PieceCoder:
    with open(path, "rb") as file:
        return PieceCoder(read_model(file.read()))


_CODERS: dict[str, PieceCoder] = {}


def _worker_coder(key: str, model: PieceModel) -> PieceCoder:
    """One coder, with the words that it has solved, for all tasks of a Python worker."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = PieceCoder(model)
    return _CODERS[key]


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_ids, n_bytes`` (ids of single bytes)``, ids_crc32, decoded`` and, if wanted, ``ids``. The
    model has a fixed size and is broadcast."""
    shared, key = docs.sparkSession.sparkContext.broadcast(load_coder(model).model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _worker_coder(key, shared.value)
        single = np.zeros(len(coder.bytes_of), bool)
        single[list(coder.byte_ids.values())] = True
        for batch in batches:
            got = list(coder.encode(batch.column(1).to_pylist()))
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in got]
            cols = [batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([int(single[x].sum()) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in got], pa.int64()), pa.array([coder.decode(x) for x in got], pa.string())]
            names = ["doc_id", "n_ids", "n_bytes", "ids_crc32", "decoded"]
            if keep_ids:
                cols, names = [*cols, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id bigint, n_ids bigint, n_bytes bigint, ids_crc32 bigint, decoded string" + ", ids array<int>" * keep_ids
    return docs.selectExpr(f"cast(`{id_col}` as bigint) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)
