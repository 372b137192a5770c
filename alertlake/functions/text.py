"""Text helpers with the reference semantics of trimming, clipping and matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertlake.functions.patterns import Pattern

# The Unicode white space characters.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
CLIP_BYTES = 1 << 20
CLIP_SUFFIX = " [truncated: docker log line exceeded limit]"


def trim_space(text: Column) -> Column:
    """Cut Unicode white space at both ends; ``trim`` would cut blanks only."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def non_empty(text: Column) -> Column:
    """NULL for an empty text. ``nullif`` and ``when`` would evaluate the text twice."""
    return F.get(F.array_remove(F.array(text), ""), F.lit(0))


def non_blank(text: Column) -> Column:
    """The trimmed text, NULL if nothing is left."""
    return non_empty(trim_space(text))


def is_blank(text: Column) -> Column:
    return F.coalesce(trim_space(text) == "", F.lit(True))


def first_of(columns: list[Column], default: Column | None = None) -> Column:
    return F.coalesce(*columns, F.lit(None).cast("string") if default is None else default)


def byte_prefix(text: Column, size: int) -> Column:
    """First bytes of the text; a character cut in the middle is dropped."""
    raw = F.substring(F.encode(text, "utf-8"), 1, size)
    decoded = F.make_valid_utf8(raw.cast("string"))
    # Only the last character can be damaged, and the damage decodes to U+FFFD.
    return F.when(F.is_valid_utf8(raw.cast("string")), decoded).otherwise(F.regexp_replace(decoded, "�+\\z", ""))


def clip_line(line: Column, max_bytes: int = CLIP_BYTES) -> Column:
    return F.when(F.octet_length(line) > max_bytes, F.concat(byte_prefix(line, max_bytes), F.lit(CLIP_SUFFIX))).otherwise(
        line
    )


def first_group(text: Column, patterns: list[Pattern]) -> Column:
    """First pattern that matches: its first non-blank group, else the whole match, in capitals."""
    found = []
    for pattern in patterns:
        groups = [non_blank(pattern.group(text, index)) for index in [*range(1, pattern.groups + 1), 0]]
        found.append(F.when(pattern.matches(text), F.coalesce(*groups)))
    return F.upper(first_of(found))


def first_capture(text: Column, patterns: list[Pattern]) -> Column:
    """Group 1 of the first pattern whose group 1 is not blank."""
    return first_of([non_blank(p.group(text, 1)) for p in patterns if p.groups])
