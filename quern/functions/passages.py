"""Texts cut into passages, and the lines that answer a search."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import first_line, tokens_of, words

CHUNK_BYTES, LINE_CHARS, LEAD_WORDS = 1000, 160, 3


def _cut_inside(raw: bytes, start: int, limit: int) -> int:
    """Where a line that is longer than a passage is cut: behind the last space of the passage's
    second half, else before the character that would not fit whole."""
    limit -= next(i for i in range(4) if raw[limit - i] & 0xC0 != 0x80)
    half = start + (limit - start) // 2 + 1
    return half + m.end() if (m := re.match(rb"(?s).*[ ]", raw[half:limit])) else limit


def chunks(text: str, most: int = CHUNK_BYTES) -> list[tuple[int, int]]:
    """Byte ranges of at most ``most`` bytes that together are the text, each ending with as many whole
    lines as fit; a line that fits nowhere is cut. A blank rest at the end makes no range."""
    raw = text.encode("utf-8", "surrogatepass")
    borders = [0, *(m.end() for m in re.finditer(b"\n", raw))]
    if borders[-1] < len(raw):
        borders.append(len(raw))
    cuts = [0]
    while cuts[-1] < len(raw):
        fits = borders[bisect_right(borders, cuts[-1] + most) - 1]
        cuts.append(fits if fits > cuts[-1] else _cut_inside(raw, cuts[-1], cuts[-1] + most))
    ranges = list(zip(cuts, cuts[1:]))
    if ranges and not raw[slice(*ranges[-1])].decode("utf-8", "surrogatepass").strip():
        ranges.pop()
    return ranges


def chunk_ranges(text: Column, most: int = CHUNK_BYTES) -> Column:
    """array<struct<start, end>> of byte ranges."""

    @F.arrow_udf("array<struct<start: int, end: int>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            yield pa.array([None if x is None else [{"start": a, "end": b} for a, b in chunks(x, most)] for x in batch.to_pylist()], kind)

    return cut(text)


def passage(chunk: Column, number: Column, kind: Column, header: Column) -> Column:
    """A chunk as a model reads it: in sheets, later chunks stand under the header row of the first."""
    return F.when((kind == "sheet") & (number > 0) & (header != ""), F.concat(header, F.lit("\n"), F.trim(chunk))).otherwise(F.trim(chunk))


def wanted_words(texts: list[str]) -> list[str]:
    """The distinct words of query terms, as the lines' words are read."""
    return list(dict.fromkeys(w for t in texts for w in tokens_of(t, accents=True)))


def _hits(text: Column, wanted: list[str]) -> Column:
    """How many of ``wanted`` begin a word of ``text``."""
    spaced = F.concat(F.lit(" "), F.lower(words(text)))
    return F.aggregate(F.array(*map(F.lit, wanted)), F.lit(0), lambda n, w: n + F.contains(spaced, F.concat(F.lit(" "), w)).cast("int"))


def snippet(text: Column, wanted: list[str]) -> Column:
    """The line that has most of ``wanted`` at the start of its words, the first of equals; null without
    any. A long line begins ``LEAD_WORDS`` words before its first match. All is JVM-side; put it behind
    the limit, where rows are few."""
    if not wanted:
        return F.lit(None).cast("string")
    scored = F.transform(F.split(text, "\n"), lambda line, i: F.struct(_hits(line, wanted).alias("n"), (-i).alias("i"), line.alias("line")))
    best = F.array_max(scored)
    pieces = F.split(F.trim(F.regexp_replace(best["line"], r"(?U)\s+", " ")), " ")
    first = F.array_position(F.transform(pieces, lambda p: _hits(p, wanted) > 0), F.lit(True))
    skip = F.when(F.length(F.array_join(pieces, " ")) > LINE_CHARS, F.greatest(first - 1 - LEAD_WORDS, F.lit(0))).otherwise(F.lit(0)).cast("int")
    shown = F.concat(F.when(skip > 0, "… ").otherwise(""), F.array_join(F.slice(pieces, skip + 1, F.size(pieces)), " "))
    short = F.when(F.length(shown) > LINE_CHARS, F.concat(F.substring(shown, 1, LINE_CHARS), F.lit("…"))).otherwise(shown)
    return F.when(best["n"] > 0, short)


def chunk_line(text: Column, start: Column, end: Column, wanted: list[str]) -> Column:
    """The line of a passage (a byte range of ``text``) that answers, else the passage's first line."""
    own = F.decode(F.substring(F.encode(text, "UTF-8"), start + 1, end - start), "UTF-8")
    return F.coalesce(snippet(own, wanted), first_line(own, LINE_CHARS))
