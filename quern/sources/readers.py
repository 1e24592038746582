"""Readers of what other programs keep: browsers, desktops, rates, clipboards, plug-ins."""

from __future__ import annotations

import json
import os
import sqlite3
import subprocess
import sys
import tomllib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import spread as spread

FRAMES = 25
MARK = "profile string, title string, url string"
VISIT = "profile string, url string, title string, visit_count long, typed_count long, last_visit_time long, hidden boolean"
RATES = "result string, time_last_update_unix long, time_next_update_unix long, rates map<string, double>, `error-type` string"
WINDOW = "id long, title string, app string, app_id string, workspace int, minimized boolean"
COPY = "text string, copied long"


def _rows(schema: str, batches: Iterator[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """Rows that ``of`` gives for each (profile, path), as batches of ``schema``."""
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}
    fields = [(n, kinds[t]) for n, t in (c.split() for c in schema.split(", "))]
    for b in batches:
        for profile, path in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found = list(of(profile, path))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def marks_in(text: str) -> Iterator[tuple[str, str]]:
    """(title, url) of the bookmarks in a browser's file, in the file's order; none if it is broken."""
    try:
        roots = json.loads(text)["roots"]
        waiting = list(roots.values())[::-1]
    except (ValueError, KeyError, TypeError, AttributeError):
        return
    while waiting:
        node = waiting.pop()
        if not isinstance(node, dict):
            continue
        if node.get("type") == "url":
            if isinstance(node.get("name"), str) and isinstance(node.get("url"), str):
                yield node["name"], node["url"]
        elif isinstance(node.get("children"), list):
            waiting += node["children"][::-1]


def bookmarks(profiles: DataFrame) -> DataFrame:
    """(profile, title, url) of the bookmark files of ``profiles`` (profile, folder), on shared storage."""

    def of(profile: str, folder: str):
        try:
            with open(f"{folder}/Bookmarks", encoding="utf-8") as f:
                return [(profile, *m) for m in marks_in(f.read())]
        except (OSError, UnicodeDecodeError):
            return []

    return profiles.select("profile", "folder").mapInArrow(lambda b: _rows(MARK, b, of), MARK)


def history(profiles: DataFrame) -> DataFrame:
    """The pages in the history files of ``profiles``. A browser may hold a file locked, so it is read as
    one that does not change; one that can't be read gives nothing."""

    def of(profile: str, folder: str):
        path = f"{folder}/History"
        if not os.path.isfile(path):
            return
        try:
            db = sqlite3.connect(f"file:{quote(os.path.abspath(path))}?immutable=1", uri=True)
            try:
                for url, title, visits, typed, last, hidden in db.execute("SELECT url, title, visit_count, typed_count, last_visit_time, hidden FROM urls"):
                    yield profile, url, title, visits, typed, last, bool(hidden)
            finally:
                db.close()
        except sqlite3.Error:
            return

    return profiles.select("profile", "folder").mapInArrow(lambda b: _rows(VISIT, b, of), VISIT)


def profiles(spark: SparkSession, browser: str, folder: str) -> DataFrame:
    """(browser, profile, folder): the profiles that a browser's state file lists and that exist, by folder;
    the default one if it lists none."""
    state = f"{folder}/Local State"
    names = "profile struct<info_cache: map<string, struct<name: string>>>"
    listed = None
    if os.path.isfile(state):
        told = spark.read.text(state, wholetext=True).select(F.from_json("value", names).alias("s"))
        listed = told.select(F.explode("s.profile.info_cache").alias("dir", "info")).select("dir", F.col("info.name").alias("profile"))
    if listed is None or listed.isEmpty():
        listed = spark.createDataFrame([("Default", "Default")], "dir string, profile string")
    there = [d for d in sorted(os.listdir(folder)) if os.path.isdir(f"{folder}/{d}")] if os.path.isdir(folder) else []
    rows = listed.where(F.col("dir").isin(there))
    return rows.select(F.lit(browser).alias("browser"), "profile", F.concat(F.lit(f"{folder}/"), "dir").alias("folder")).orderBy("folder")


def rates(spark: SparkSession, path: str) -> DataFrame:
    """(code, rate, published, next): units per dollar in a saved answer of the rates' service. Raises if the
    answer is an error or has no rates."""
    told = spark.read.schema(RATES).option("multiLine", True).json(path)
    row = told.select("result", F.size("rates").alias("n"), "error-type").first()
    if not row or row["result"] != "success" or row["n"] < 1:
        raise ValueError(f"no rates: {(row and (row['error-type'] or row['result'])) or 'unreadable'}")
    return told.select(F.explode("rates").alias("code", "rate"), F.col("time_last_update_unix").alias("published"), F.col("time_next_update_unix").alias("next"))


def save_aside(path: str, text: str) -> None:
    """Write a file whole or not at all."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.partial", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.partial", path)


def is_due(next_at: int, now: int) -> bool:
    """Whether newer rates should be out."""
    return now >= next_at


def desktop_entries(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(dir_rank, id, path, name, other_names, exec, try_exec, icon, categories, in_terminal, shown) of
    the entry files of folders, the first folder's before the others'. Files are read whole, one a row."""
    rows = None
    for rank, folder in enumerate(f for f in folders if os.path.isdir(f)):
        files = spark.read.option("pathGlobFilter", "*.desktop").text(folder, wholetext=True)
        own = files.select(F.lit(rank).alias("dir_rank"), F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("path"), "value")
        rows = own if rows is None else rows.unionByName(own)
    if rows is None:
        rows = spark.createDataFrame([], "dir_rank int, path string, value string")
    return entries_of(rows.withColumn("id", F.regexp_extract(F.url_decode("path"), "([^/]+)$", 1)))


def entries_of(files: DataFrame) -> DataFrame:
    """Desktop entries of ``files`` (dir_rank, id, path, value); those without a name or command are left out."""
    lines = F.transform(F.split("value", "\r?\n"), F.trim)
    # The lines of the main group: behind its heading, before the next one.
    number = F.sequence(F.lit(0), F.size(lines) - 1)
    heads = F.filter(number, lambda i: F.startswith(F.get(lines, i), F.lit("[")))
    start = F.array_position(lines, "[Desktop Entry]").cast("int")
    end = F.coalesce(F.array_min(F.filter(heads, lambda i: i >= start)), F.size(lines))
    main = F.filter(F.slice(lines, start + 1, F.greatest(end - start, F.lit(0))), lambda x: F.contains(x, F.lit("=")))
    pairs = F.transform(main, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    rows = files.withColumn("_pairs", F.when(start > 0, pairs))

    def last(key: str):
        return F.element_at(F.transform(F.filter("_pairs", lambda p: p["k"] == key), lambda p: p["v"]), -1)

    def has(key: str):
        return F.exists("_pairs", lambda p: (p["k"] == key))

    def of(key: str):
        return F.when(has(key), last(key))

    listed = lambda x: F.filter(F.split(F.coalesce(x, F.lit("")), ";"), lambda k: k != "")
    hidden = F.exists("_pairs", lambda p: p["k"].isin("NoDisplay", "Hidden") & (p["v"] == "true"))
    out = rows.where(F.coalesce(of("Name"), F.lit("")) != "").where(F.coalesce(of("Exec"), F.lit("")) != "")
    flatpak = F.endswith(F.substring_index(of("Exec"), " ", 1), F.lit("flatpak"))
    name = F.concat(of("Name"), F.when(flatpak, " (Flatpak)").otherwise(""))
    others = F.array_compact(F.concat(listed(of("Keywords")), F.array(of("GenericName"))))
    shown = (F.coalesce(of("Type"), F.lit("")) == "Application") & ~hidden
    return out.select("dir_rank", "id", "path", name.alias("name"), others.alias("other_names"), of("Exec").alias("exec"), of("TryExec").alias("try_exec"), of("Icon").alias("icon"), listed(of("Categories")).alias("categories"), (F.coalesce(of("Terminal"), F.lit("")) == "true").alias("in_terminal"), shown.alias("shown"))


def windows(spark: SparkSession, path: str) -> DataFrame:
    """Open windows, as the desktop lists them."""
    return spark.read.schema(WINDOW).option("multiLine", True).json(path)


def copies(spark: SparkSession, path: str) -> DataFrame:
    """Kept copies; none where there is no file."""
    return spark.read.schema(COPY).option("multiLine", True).json(path) if os.path.exists(path) else spark.createDataFrame([], COPY)


def manifests(folder: str, platform: str = sys.platform) -> tuple[list[dict], list[str]]:
    """Plug-ins in a folder, by id, that run on the platform, and what is wrong with the others' files."""
    names = {"linux": "linux", "darwin": "macos", "win32": "windows"}
    good, bad = [], []
    for plugin in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        path = f"{folder}/{plugin}/plugin.toml"
        if not os.path.isfile(path):
            continue
        try:
            with open(path, "rb") as f:
                told = tomllib.load(f)
            if not told.get("name"):
                raise ValueError("it has no name")
            work = told.get("process")
            if not (told.get("command") or [""])[0] and not (work and (work.get("command") or [""])[0]):
                raise ValueError("it names no program to run")
            if work and not work.get("kinds"):
                raise ValueError("its processor names no kinds of file")
            if " " in told.get("keyword", ""):
                raise ValueError("its keyword is more than one word")
        except (OSError, ValueError, tomllib.TOMLDecodeError) as e:
            bad.append(f"{path}: {e}")
            continue
        if not told.get("platforms") or names.get(platform) in told["platforms"]:
            good.append({"id": plugin, "dir": f"{folder}/{plugin}", "position": "bottom", "requires": [], **told})
    return good, bad


def missing(manifest: dict, path: str | None = None) -> str | None:
    """The help of the first program that a plug-in needs and that is not there."""
    from shutil import which

    return next((f"{r['program']} is missing: {r.get('help', '')}".rstrip(": ") for r in manifest["requires"] if not which(r["program"], path=path)), None)


def video_length(path: str, probe: str = "ffprobe", seconds: float = 60) -> float:
    """A video's length in seconds, by the program that tells it."""
    out = subprocess.run([probe, "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path], capture_output=True, text=True, timeout=seconds)
    return float(out.stdout.strip())


def frame_times(length: float, n: int = FRAMES) -> list[float]:
    """The middles of ``n`` even parts of a video."""
    return [length * (2 * i + 1) / (2 * n) for i in range(n)]


def video_frames(path: str, length: float, folder: str, program: str = "ffmpeg", n: int = FRAMES, seconds: float = 300) -> list[str]:
    """Pictures at ``frame_times``, written to ``folder`` unless they are there."""
    os.makedirs(folder, exist_ok=True)
    out = [f"{folder}/{i:03d}.jpg" for i in range(n)]
    for at, to in zip(frame_times(length, n), out):
        if not os.path.exists(to):
            subprocess.run([program, "-v", "error", "-ss", f"{at:.3f}", "-i", path, "-frames:v", "1", "-vf", "scale=480:-2", to], check=True, timeout=seconds)
    return out
