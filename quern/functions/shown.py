"""How values are shown, as columns: spans, sizes, ages, addresses, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COPY_WIDTH = 200


def _text(x: Column) -> Column:
    return x.cast("string")


def title(text: Column) -> Column:
    """The first line with something on it, trimmed and cut; empty if there is none."""
    lines = F.filter(F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    line = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.length(line) > COPY_WIDTH, F.concat(F.substring(line, 1, COPY_WIDTH), F.lit("…"))).otherwise(line)


def ago(milliseconds: Column) -> Column:
    """Just now, then whole minutes, hours and days."""
    minutes = F.floor(F.greatest(milliseconds, F.lit(0)) / 60_000)
    out = F.when(minutes < 1, "just now").when(minutes < 60, F.concat(_text(minutes), F.lit(" min ago")))
    return out.when(minutes < 1440, F.concat(_text(F.floor(minutes / 60)), F.lit(" h ago"))).otherwise(F.concat(_text(F.floor(minutes / 1440)), F.lit(" d ago")))


def subtitle(text: Column, milliseconds: Column) -> Column:
    """How long ago, and how many lines if there are several."""
    lines = F.size(F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), "\n"))
    return F.when(lines > 1, F.concat(ago(milliseconds), F.lit(" · "), _text(lines), F.lit(" lines"))).otherwise(ago(milliseconds))


def slug(*parts: Column) -> Column:
    """Lower case, with a dash for each character that is no ASCII letter or digit."""
    return F.regexp_replace(F.lower(F.concat_ws("-", *parts)), "[^a-z0-9]", "-")


def repository(text: Column) -> Column:
    """struct(owner, name) of a repository's address, or of ``owner/name``; null for anything else."""
    path = F.regexp_replace(F.trim(text), r"^(?:https?://)?(?:www\.)?(?:github\.com/)?", "")
    parts = F.split(F.regexp_replace(path, "/+$", ""), "/")
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", "")
    named = lambda x: F.coalesce(x.rlike(r"^[A-Za-z0-9._-]+$") & ~x.isin(".", ".."), F.lit(False))
    page = F.coalesce(F.get(parts, F.lit(2)).isin("tree", "blob"), F.lit(True))
    owner = F.get(parts, F.lit(0))
    return F.when(named(owner) & named(name) & page, F.struct(owner.alias("owner"), name.alias("name")))


def ttl(seconds: Column) -> Column:
    """A time to live in the largest unit of which there are two."""
    steps = ((120, 1, " s"), (7200, 60, " min"), (172_800, 3600, " h"))
    out = None
    for top, unit, name in steps:
        shown = F.concat(_text(F.floor(seconds / unit)), F.lit(name))
        out = F.when(seconds < top, shown) if out is None else out.when(seconds < top, shown)
    return out.otherwise(F.concat(_text(F.floor(seconds / 86_400)), F.lit(" d")))


def span(seconds: Column) -> Column:
    """How long something ran: the two largest units that it has, or one below an hour."""
    days, hours, minutes = F.floor(seconds / 86_400), F.floor(seconds / 3600) % 24, F.floor(seconds / 60) % 60
    out = F.when(days > 0, F.concat(_text(days), F.lit("d "), _text(hours), F.lit("h")))
    out = out.when(hours > 0, F.concat(_text(hours), F.lit("h "), _text(minutes), F.lit("m")))
    return out.when(minutes > 0, F.concat(_text(minutes), F.lit("m"))).otherwise(F.concat(_text(seconds), F.lit("s")))


def memory(size: Column) -> Column:
    """Whole megabytes, or gigabytes with one decimal."""
    mb = size / (1024.0 * 1024.0)
    return F.when(mb >= 1024, F.format_string("%.1f GB", F.bround(mb / 1024, 1))).otherwise(F.format_string("%.0f MB", F.bround(mb, 0)))


def capital(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 1 << 30))


def program_name(short: Column, path: Column) -> Column:
    """A process's name; one of 15 bytes may have been cut, and is whole in the program's path then."""
    whole = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.when((F.octet_length(short) == 15) & F.startswith(whole, short), whole).otherwise(short)


def squashed(text: Column) -> Column:
    """Without white space and case."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def is_day(text: Column) -> Column:
    """Whether it is written as a day, which is a file's name more often than a sum."""
    return text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")


def amount(text: Column) -> Column:
    """struct(amount, unit) of a number and what it counts."""
    bare = F.regexp_replace(text, r"^approx\. ", "")
    number = F.regexp_extract(bare, r"^([-+]?(?:[0-9]+[.]?[0-9]*|[.][0-9]+)(?:[eE][-+]?[0-9]+)?) ", 1).try_cast("double")
    unit = F.regexp_extract(bare, r"^[^ ]+ (.*)$", 1)
    return F.when(number.isNotNull() & (unit != ""), F.struct(number.alias("amount"), unit.alias("unit")))


def grouped(value: Column, decimals: int) -> Column:
    """With commas between thousands and fixed decimals; what rounds to nothing has no sign."""
    out = F.format_number(F.bround(value, decimals + 6), decimals)
    return F.when(out.rlike(r"^-[0.,]*$"), F.substring(out, 2, 1 << 30)).otherwise(out)


def to_hex(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def from_hex(text: Column) -> Column:
    """Bytes of a hash written in hexadecimal; null if it is none."""
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), F.unhex(text))


def answered(text: Column, schema: str) -> Column:
    """What a model answered in JSON, perhaps inside a fenced block; null if it is no JSON."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:```json|```)\s*", ""), r"\s*```$", "")
    said = F.from_json(bare, f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
    return F.when(said["_corrupt"].isNull(), said)


def described(text: Column, allowed: list[str], most_words: int = 20, most_tags: int = 8) -> Column:
    """struct(text, tags, labels) of a model's answer: a text of few words, few tags, and only labels that
    are allowed; null if the answer is no JSON."""
    said = answered(text, "text string, tags array<string>, labels array<string>")
    words = F.filter(F.split(said["text"], r"\s+"), lambda w: w != "")
    tags = F.slice(F.array_distinct(F.filter(F.transform(said["tags"], lambda t: F.lower(F.trim(t))), lambda t: t != "")), 1, most_tags)
    labels = F.array_intersect(F.array(*map(F.lit, allowed)).cast("array<string>"), F.coalesce(said["labels"], F.array().cast("array<string>")))
    return F.when(said.isNotNull(), F.struct(F.array_join(F.slice(words, 1, most_words), " ").alias("text"), tags.alias("tags"), labels.alias("labels")))
