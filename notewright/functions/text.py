"""Text functions with the white space and newline rules of Python strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that str.strip and str.split take for white space, as a character class.
SPACE = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters, one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def normal_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def decoded(content: Column) -> Column:
    """UTF-8 text with single newlines; null where the bytes are no UTF-8."""
    return normal_newlines(F.try_validate_utf8(content.cast("string")))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def without_front_matter(content: Column) -> Column:
    """What follows the second run of three dashes if the text begins with one; else the text."""
    parts = F.split(content, "---", 3)
    return F.when(content.startswith("---") & (F.size(parts) >= 3), parts[2]).otherwise(content)


def slug_name(path: Column) -> Column:
    """File name without folder and .md."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.md\z", "")
