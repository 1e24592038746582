"""Text of office documents and plain files, from their bytes."""

from __future__ import annotations

import io
import re
import time
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT_LIMIT, MOST_BYTES, DEADLINE = 65_536, 20 << 20, 5.0
OFFICE = {"docx", "pptx", "odt", "ods", "odp", "xlsx"}
#: Local names of elements: those that end a line, a cell, and those whose text counts.
LINES, CELLS, TEXTS = {"p", "h", "tr", "row", "table-row"}, {"tc", "c", "table-cell"}, {"t", "p", "h", "span", "a"}


class Full(Exception):
    """The text has reached its limit or its time."""


class Sink:
    """Collects lines up to a number of bytes and for a bounded time; blank lines are left out."""

    def __init__(self, limit: int):
        self.left, self.lines, self.until = limit, [], time.monotonic() + DEADLINE

    def line(self, text: str) -> None:
        if time.monotonic() > self.until:
            raise Full
        text = " ".join(text.split(" ")).strip()
        if not text:
            return
        raw = text.encode("utf-8", "replace")
        self.lines.append(raw[: self.left].decode("utf-8", "ignore"))
        self.left -= len(raw) + 1
        if self.left <= 0:
            raise Full


def plain(raw: bytes, limit: int = TEXT_LIMIT) -> str | None:
    """The first ``limit`` bytes as text; none if they are not UTF-8 but for a cut end, or hold NUL."""
    head = raw[:limit]
    if b"\0" in head:
        return None
    try:
        text = head.decode("utf-8")
    except UnicodeDecodeError as e:
        if len(raw) <= limit or e.start < len(head) - 3 or e.reason != "unexpected end of data":
            return None
        text = head[: e.start].decode("utf-8")
    return text.removeprefix("﻿").strip() or None


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml(stream, sink: Sink) -> None:
    """Paragraphs and rows are lines; cells of a row are set apart by tabs."""
    line: list[str] = []
    depth = 0  # of open cells
    for event, e in ElementTree.iterparse(stream, ("start", "end")):
        name = _name(e.tag)
        if event == "start":
            depth += name in CELLS
            continue
        if name == "tab":
            line.append("\t")
        if name in TEXTS and e.text:
            line.append(e.text) if name == "t" or not len(e) else line.insert(0, e.text)
        if name in CELLS:
            depth -= 1
            line.append("\t")
        elif name in LINES and not depth:
            sink.line("".join(line).rstrip("\t"))
            line.clear()
        if e.tail and e.tail.strip() and name in ("span", "a", "s", "tab"):
            line.append(e.tail)
        if name in LINES:
            e.clear()
    sink.line("".join(line))


def _sheets(archive: zipfile.ZipFile, names: list[str], sink: Sink) -> None:
    shared: list[str] = []
    if "xl/sharedStrings.xml" in archive.namelist():
        for _, e in ElementTree.iterparse(archive.open("xl/sharedStrings.xml")):
            if _name(e.tag) == "si":
                shared.append("".join(t.text or "" for t in e.iter() if _name(t.tag) == "t"))
                e.clear()
    for name in names:
        for _, row in ElementTree.iterparse(archive.open(name)):
            if _name(row.tag) != "row":
                continue
            cells = []
            for c in row:
                value = next((v.text or "" for v in c.iter() if _name(v.tag) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdecimal() and int(value) < len(shared) else value)
            sink.line("\t".join(cells))
            row.clear()


def _numbered(names: list[str], pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def office(raw: bytes, ext: str, limit: int = TEXT_LIMIT) -> str | None:
    """Text of a zipped document; none if it is broken, encrypted, too large or without text."""
    if len(raw) > MOST_BYTES:
        return None
    sink = Sink(limit)
    try:
        archive = zipfile.ZipFile(io.BytesIO(raw))
        names = archive.namelist()
        if ext == "xlsx":
            _sheets(archive, _numbered(names, r"xl/worksheets/sheet(\d+)\.xml"), sink)
        elif ext == "docx":
            _xml(archive.open("word/document.xml"), sink)
        elif ext == "pptx":
            for name in _numbered(names, r"ppt/slides/slide(\d+)\.xml"):
                _xml(archive.open(name), sink)
        else:
            if "META-INF/manifest.xml" in names and b"encryption-data" in archive.read("META-INF/manifest.xml"):
                return None
            _xml(archive.open("content.xml"), sink)
    except Full:
        pass
    except Exception:  # a broken document has no text; others must not suffer from it
        return None
    return "\n".join(sink.lines) or None


def read_text(raw: bytes | None, ext: str, limit: int = TEXT_LIMIT) -> str | None:
    if raw is None:
        return None
    return office(raw, ext, limit) if ext in OFFICE else plain(raw, limit)


def with_text(files: DataFrame, limit: int = TEXT_LIMIT) -> DataFrame:
    """``files`` (path, ext, ...) with ``text``, read by the executors; one document at a time is in memory,
    and of a plain file no more than the limit."""

    @F.arrow_udf("string")
    def extract(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for paths, kinds in batches:
            yield pa.array([read_file(p, k or "", limit) for p, k in zip(paths.to_pylist(), kinds.to_pylist())], pa.string())

    return files.withColumn("text", extract(F.col("path"), F.col("ext")))


def read_file(path: str, ext: str, limit: int = TEXT_LIMIT) -> str | None:
    """The text of a file; none where it can't be read."""
    try:
        with open(path, "rb") as f:
            return read_text(f.read(MOST_BYTES + 1 if ext in OFFICE else limit + 4), ext, limit)
    except OSError:
        return None
