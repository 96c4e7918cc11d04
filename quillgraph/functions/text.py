"""String helpers: portable hashes, first-match replacement, fingerprints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable_hash(*parts: Column | str) -> Column:
    """32-bit hash that any engine with md5 reproduces; the basis of every seeded choice."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 8), 16, 10).cast("long")


def hashed_choice(key: Column, name: str, size: int) -> Column:
    return portable_hash(key, name) % F.lit(size)


def replace_first(text: Column, pattern: str, replacement: str) -> Column:
    """Replace the first match only. Groups of ``pattern`` count from $2 on."""
    return F.regexp_replace(text, f"(?s)^(.*?){pattern}", f"$1{replacement}")


def replace_first_literal(text: Column, old: str, new: str) -> Column:
    return replace_first(text, re.escape(old), new.replace("\\", "\\\\").replace("$", "\\$"))


def contains_any(text: Column, needles: list[str] | tuple[str, ...]) -> Column:
    result = F.lit(False)
    for needle in needles:
        result = result | text.contains(needle)
    return result


def djb2_fingerprint(text: Column) -> Column:
    """djb2 with xor over the characters, 32 bits, eight hex digits."""
    codes = F.transform(F.split(text, ""), lambda ch: F.ascii(ch).cast("long"))
    folded = F.aggregate(
        codes,
        F.lit(5381).cast("long"),
        lambda h, c: (h * F.lit(33)).bitwiseAND(F.lit(4294967295)).bitwiseXOR(c),
    )
    return F.lower(F.lpad(F.hex(folded), 8, "0"))


def word_tokens(text: Column) -> Column:
    """Letter runs, digit runs and single other characters, in order."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


WORD_PATTERN = r"\p{L}+|\p{N}+|[^\p{L}\p{N} \t\n\r\f\x0B]"
