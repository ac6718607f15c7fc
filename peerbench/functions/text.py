"""Text normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space code points, as (first, last) pairs.
SPACE_CODES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
PLAIN = "".join(map(chr, range(0x20, 0x7F)))
# Each character is named: such a class is one look-up, whereas ranges and properties are tried in turn.
JUNK = "[" + "".join("\\" + c for c in PLAIN if not (c.isalnum() or c in "_ ")) + "]+"
SPACES = "".join(chr(c) for first, last in SPACE_CODES for c in range(first, last + 1))


def clean_text(col: Column) -> Column:
    """Keep word characters and white space, lower-case, collapse and trim the spaces.

    Word characters are letters and numbers of any script and the underscore. All white space
    becomes plain spaces first, by a table look-up, so that the patterns stay short; text of printable ASCII
    needs none and has a pattern of its own.
    """
    spaced = F.translate(col, SPACES, " " * len(SPACES))
    other = F.regexp_replace(spaced, r"[^a-zA-Z0-9_ \p{L}\p{N}]+", "")
    kept = F.when(col.rlike(r"[^\x20-\x7E]"), other).otherwise(F.regexp_replace(col, JUNK, ""))
    return F.trim(F.regexp_replace(F.lower(kept), "  +", " "))


def empty_to(col: Column, placeholder: str) -> Column:
    return F.when(col == "", F.lit(placeholder)).otherwise(col)
