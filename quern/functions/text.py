"""Scalar text functions, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts written without spaces, marks of copies.
CJK = "\\u3040-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uAC00-\\uD7AF\\uF900-\\uFAFF\\x{20000}-\\x{2FA1F}"
#: Combining marks that folding drops.
MARKS = "".join(map(chr, range(0x300, 0x332)))
COPY_MARKS = r"(?: \([0-9]+\)| - copy| copy|_copy|-copy|的副本| 副本| copy [0-9]*)"


def words(text: Column) -> Column:
    """Words apart by one space: CJK characters alone, camelCase and digit edges split."""
    out = F.regexp_replace(text, f"([{CJK}])", " $1 ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    out = F.regexp_replace(out, r"(\p{Ll})(\p{Lu})", "$1 $2")
    out = F.regexp_replace(out, r"(\p{N})(\p{L})", "$1 $2")
    out = F.regexp_replace(out, r"(\p{L})(\p{N})", "$1 $2")
    return F.trim(F.regexp_replace(out, " +", " "))


def _bare(c: str) -> str:
    """A letter without its accents: the first character of its canonical decomposition."""
    whole = unicodedata.normalize("NFD", c)
    return whole[0] if len(whole) > 1 and all(unicodedata.combining(x) for x in whole[1:]) else c


#: Lower-case letters of the basic plane with accents, and the same without them. By rule: 700 letters.
_FOLDS = {c: _bare(c) for c in map(chr, range(0xC0, 0x2000)) if c.isalpha() and c.lower() == c and _bare(c) != c}
ACCENTED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())


def fold(text: Column) -> Column:
    """Lower case without accents, written as one character or as a letter and its marks."""
    return F.translate(F.lower(text), ACCENTED + MARKS, PLAIN)


def split_plain(text: Column) -> Column:
    """Folded runs of letters and digits, as an index reads text that is not split further."""
    return F.array_remove(F.split(F.regexp_replace(fold(text), r"[^\p{L}\p{N}]+", " "), " "), "")


def token_list(text: Column) -> Column:
    """Folded words, in order."""
    return F.array_remove(F.split(fold(words(F.translate(text, MARKS, ""))), " "), "")


def _is(c: str, kind: str) -> bool:
    return unicodedata.category(c).startswith(kind)


def _cjk(c: str) -> bool:
    return any(a <= c <= b for a, b in (("\u3040", "\u30ff"), ("\u3400", "\u4dbf"), ("\u4e00", "\u9fff"), ("\uac00", "\ud7af"), ("\uf900", "\ufaff"), ("\U00020000", "\U0002fa1f")))


def tokens_of(text: str, accents: bool = False) -> list[str]:
    """``token_list`` of a Python string, for queries; with ``accents`` they stay on."""
    text = "".join(c for c in text if c not in MARKS)
    spread = "".join(f" {c} " if _cjk(c) else c if _is(c, "L") or _is(c, "N") else " " for c in text)
    edges = [a + " " * ((_is(a, "Ll") and _is(b, "Lu")) or (_is(a, "N") and _is(b, "L")) or (_is(a, "L") and _is(b, "N"))) for a, b in zip(spread, spread[1:] + " ")]
    out = "".join(edges).lower()
    return (out if accents else "".join(_FOLDS.get(c, c) for c in out if c not in MARKS)).split()


def human_size(size: Column) -> Column:
    out = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for i, unit in enumerate(("KB", "MB", "GB")):
        out = out.when(size < 1024 ** (i + 2), F.format_string("%.1f " + unit, F.bround(size / 1024.0 ** (i + 1), 1)))
    return out.otherwise(F.format_string("%.1f TB", F.bround(size / 1024.0**4, 1)))


def age(seconds: Column) -> Column:
    """Rough age: just now, then whole minutes, hours, days, months of 30 and years of 365 days."""
    out = F.when(seconds < 60, "just now")
    for top, unit, name in ((3600, 60, "m"), (86_400, 3600, "h"), (30 * 86_400, 86_400, "d"), (365 * 86_400, 30 * 86_400, "mo")):
        out = out.when(seconds < top, F.concat(F.floor(seconds / unit).cast("string"), F.lit(name)))
    return out.otherwise(F.concat(F.floor(seconds / (365 * 86_400)).cast("string"), F.lit("y")))


def clean_tag(tag: Column) -> Column:
    bare = F.regexp_replace(F.trim(tag), "^#+", "")
    return F.regexp_replace(F.trim(F.lower(bare)), r"\s+", "-")


def plain_name(name: Column) -> Column:
    """A file name without a copy's marks, in lower case."""
    low = F.lower(name)
    ext = F.regexp_extract(low, r"^.+(\.[^.]*)$", 1)
    stem = F.rtrim(F.substring(low, F.lit(1), F.length(low) - F.length(ext)))
    return F.concat(F.regexp_replace(stem, f"(?<=.){COPY_MARKS}(?: |{COPY_MARKS})*$", ""), ext)


def name_passage(name: Column) -> Column:
    """A file name's words for a model: no extension, camelCase split, CJK text whole."""
    stem = F.regexp_replace(name, r"^(.+)\.[^.]*$", "$1")
    out = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}]+", " "), r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.trim(out)


def first_line(text: Column, most: int = 160) -> Column:
    """The first line with something on it, white space collapsed, cut at ``most`` characters."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    line = F.get(lines, F.lit(0))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def tilde(path: Column, home: str) -> Column:
    return F.when((path == home) | path.startswith(home + "/"), F.concat(F.lit("~"), F.substring(path, len(home) + 1, 1 << 30))).otherwise(path)


def display_url(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, "^https?://", ""), "/+$", "")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def spread(values: Column, n: int) -> Column:
    """``n`` of an array's elements, each from the middle of an even share."""
    size = F.size(values)
    picked = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(values, ((2 * i + 1) * size / (2 * n)).cast("int")))
    return F.when(size <= n, values).otherwise(picked)
