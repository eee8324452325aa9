"""String expressions: Unicode white space, CJK tests, URLs, paths, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col

# Code-point ranges that count as Chinese text (ideographs, punctuation, full-width forms).
CJK_RANGES = (("4e00", "9fff"), ("3000", "303f"), ("ff00", "ffef"))
#: White space: what Unicode calls so, with the four separators U+001C to U+001F.
SPACE = r"[\s\x{1c}-\x{1f}]"
CJK = "[" + "".join(f"\\x{{{a}}}-\\x{{{b}}}" for a, b in CJK_RANGES) + "]"


def strip(x) -> Column:
    """Without leading and trailing Unicode white space (trim knows spaces only)."""
    return F.regexp_replace(col(x), f"(?U)^{SPACE}+|{SPACE}+$", "")


def is_blank(x) -> Column:
    return strip(x) == ""


def is_space(ch) -> Column:
    """Whether a single character is white space."""
    return col(ch).rlike(f"(?U)^{SPACE}$")


def has_cjk(x) -> Column:
    return col(x).rlike(CJK)


def chars(x) -> Column:
    """Code points of a string."""
    return F.filter(F.split(col(x), ""), lambda c: c != "")


def char_classes(x, vocab: list[str]) -> Column:
    """Class of each code point by a small vocabulary, comma-joined; -1 for one that is no token. Whole strings are replaced, not character by character."""
    known = {t: i for i, t in reversed(list(enumerate(vocab))) if len(t) == 1}
    mark = lambda i: chr(0xE001 + i)  # noqa: E731 - what stood there before is replaced first
    inside = "".join(f"\\x{{{ord(t):x}}}" for t in known)
    out = F.regexp_replace(col(x), f"[^{inside}]" if known else r"(?s).", chr(0xE000))
    out = F.translate(out, "".join(known), "".join(map(mark, known.values()))) if known else out
    for char, value in ((chr(0xE000), -1), *((mark(i), i) for i in known.values())):
        out = F.replace(out, F.lit(char), F.lit(f"{value},"))
    return F.rtrim(out, F.lit(","))


def is_url(x) -> Column:
    """A scheme and a host are present."""
    return F.coalesce(F.try_parse_url(col(x), F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(col(x), F.lit("HOST")).isNotNull(), F.lit(False))


def basename(path) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def score_label(label, score) -> Column:
    return F.format_string("%s %.2f", col(label), col(score))


def index_label(index, score) -> Column:
    return F.format_string("%d:%.3f", col(index), col(score))
