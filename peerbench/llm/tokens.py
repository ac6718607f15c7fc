"""Token ids by a public word-level BPE tokenizer, with the ids of words kept between texts.

The tokenizer drops white space and never joins what stands on both sides of it, so a text's ids are
those of its words in order. Most words of a corpus have been met before; their ids come from a table
in the task, and only new words are encoded, many at once.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of the table; when full it is emptied, which costs time only.
TABLE = 500_000

#: Characters whose lower case depends on more than themselves.
_PLAIN_ONLY = re.compile("[Σİẞ]|<\\|")
_MARKS_MEET = re.compile(r"[^\w\s][.,][ \n]")


class WordTokens:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > TABLE:
            self.known = {"": b""}
        letters = [w for w in words if w.isalpha()]
        for at in range(0, len(letters), 5000):
            some = letters[at : at + 5000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) == len(some):
                data, first = ids.tobytes(), 0
                for w, to in zip(some, (last * 4).tolist(), strict=True):
                    self.known[w] = data[first:to]
                    first = to
            else:
                self.known.update(zip(some, self._encode(some), strict=True))
        others = [w for w in words if not w.isalpha()]
        self.known.update(zip(others, self._encode(others), strict=True))

    @staticmethod
    def _words(text: str) -> list[str]:
        """Parts of a text whose ids, in order, are those of the text."""
        if unicodedata.is_normalized("NFC", text) and not _PLAIN_ONLY.search(text):
            text = text.lower()
            if not _MARKS_MEET.search(text):
                # a mark after a letter or digit is a token of its own, so most words are met without
                text = text.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ").replace(",\n", " , ")
        return text.replace("\n", " ").split(" ")

    def ids(self, texts: list[str | None], group: int = 1 << 20) -> Iterator[bytes]:
        """Each text's ids as little-endian 32-bit numbers; a null text has none."""
        at = 0
        while at < len(texts):
            parts, size = [], 0
            while at < len(texts) and size < group:
                parts.append(self._words(texts[at] or ""))
                size += len(texts[at] or "") + 1
                at += 1
            words = set().union(*parts)
            new = words.difference(self.known)
            if new:
                before = self.known
                self._learn(new)
                if self.known is not before:
                    self._learn(words.difference(self.known))
            for x in parts:
                yield b"".join(map(self.known.__getitem__, x))


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One table for each tokenizer and Python worker."""
    return WordTokens(path)


def count_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, derive: dict[str, Column] | None = None, revised: Column | None = None) -> DataFrame:
    """``doc_id``, the columns ``keep`` (of ``docs`` or ``derive``) and ``n_tokens`` of every row, and, if ``revised``
    gives another version of its text, the ``new_tokens`` of that (null where it is null)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[(derive or {}).get(c, F.col(c)).alias(c) for c in keep or ()], *([] if revised is None else [revised.alias("revised_")]), F.col(text_col).alias("text_"))
    fields = rows.drop("text_", "revised_").dtypes
    twice, kept = revised is not None, len(fields)
    names = [*(n for n, _ in fields), "n_tokens", *["new_tokens"] * twice]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokens(tokenizer)
        for batch in batches:
            n = [len(x) // 4 for x in tokens.ids(batch.column("text_").to_pylist())]
            out = [*batch.columns[:kept], pa.array(n, pa.int64())]
            if twice:
                texts = batch.column("revised_").to_pylist()
                again = iter(tokens.ids([t for t in texts if t is not None]))
                out.append(pa.array([None if t is None else len(next(again)) // 4 for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = ", ".join(f"`{n}` {t}" for n, t in fields) + ", n_tokens bigint" + ", new_tokens bigint" * twice
    return rows.mapInArrow(run, schema)
