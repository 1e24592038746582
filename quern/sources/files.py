"""A folder as a table of files: scan, ignore rules, projects, bundles and kinds."""

from __future__ import annotations

import hashlib
import os
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.model import bundle_kind, kind_of, level_of, readable

# Files whose folder is a project.
MARKERS = [".git", "Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "CMakeLists.txt", "composer.json", "Gemfile", "pubspec.yaml", "deno.json"]
SCHEMA = "path string, name string, ext string, is_dir boolean, size long, mtime long, mtime_ns long, ctime_ns long, executable boolean, head string, own_tags string"


# What is left out where a home has no rules of its own, by platform.
DEFAULT_RULES = [".*/", "!/.ssh/", "!/.gnupg/", "!/.kube/", "/.kube/cache/", "", ".DS_Store", "Thumbs.db", "desktop.ini", "", "node_modules/", "__pycache__/", "/go/pkg/", "/fvm/"]
PLATFORM_RULES = {"linux": ["/Android/Sdk/"], "darwin": ["/Library/"], "win32": ["/AppData/"]}
# Files up to this size are hashed whole, larger ones by three samples of that size; flags
# of files whose content is elsewhere, and of hidden ones.
WHOLE, SAMPLE = 64 << 20, 1 << 20
ELSEWHERE_ATTRIBUTES, ELSEWHERE_FLAGS, HIDDEN_ATTRIBUTES = 0x1000 | 0x40000 | 0x400000, 0x40000000, 0x2


def default_rules(platform: str = sys.platform) -> list[str]:
    return DEFAULT_RULES + PLATFORM_RULES.get(platform, [])


def rules_file(path: str) -> list[str]:
    """The rules in a file, which is written with the default ones where there is none."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write("\n".join(default_rules()) + "\n")
    with open(path, encoding="utf-8") as f:
        return f.read().splitlines()


def _pattern(glob: str) -> str:
    """A rule's glob as a regular expression over a whole relative path."""
    parts = re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?|\[!?[^]/]+\]|\\.)", glob)
    shown = {"**/": "(?:.*/)?", "/**": "/.+", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    out = ""
    for i, part in enumerate(parts):
        if not i % 2:
            out += re.escape(part)
        elif part in shown:
            out += shown[part]
        elif part.startswith("["):
            out += "[" + part[1:].replace("!", "^", 1) if part.startswith("[!") else part
        else:
            out += re.escape(part[1:])
    return out


class Rules:
    """Ignore rules of a folder: a glob a line, the last that matches counts. ``!`` takes one back, a
    final ``/`` is for folders only; a ``/`` elsewhere ties it to the rules' own folder, otherwise it is
    for names at any depth. ``inner`` rules, of a folder below, are asked first."""

    def __init__(self, lines: list[str], base: str = "", outer: Rules | None = None):
        self.base, self.outer, self.rules = base, outer, []
        for line in lines:
            line = line.rstrip() if not line.endswith("\\ ") else line
            if not line or line.startswith("#"):
                continue
            keep, glob = line.startswith("!"), line.removeprefix("!")
            only_dirs, glob = glob.endswith("/"), glob.rstrip("/")
            tied, glob = "/" in glob, glob.lstrip("/")
            self.rules.append((re.compile(("" if tied else "(?:.*/)?") + _pattern(glob), re.S), only_dirs, keep))

    def excludes(self, path: str, is_dir: bool) -> bool:
        """Whether ``path``, relative to the scan's root, is left out."""
        own = path[len(self.base) :].lstrip("/")
        for pattern, only_dirs, keep in reversed(self.rules):
            if (is_dir or not only_dirs) and pattern.fullmatch(own):
                return not keep
        return self.outer.excludes(path, is_dir) if self.outer else False


def hidden(s: os.stat_result) -> bool:
    """Hidden by the operating system, or only a stand-in for a file elsewhere."""
    attributes, flags = getattr(s, "st_file_attributes", 0), getattr(s, "st_flags", 0)
    return bool(attributes & (HIDDEN_ATTRIBUTES | ELSEWHERE_ATTRIBUTES) or flags & ELSEWHERE_FLAGS)


def own_tags(path: str) -> str | None:
    """The comma-separated tags that a desktop keeps with a file."""
    try:
        return os.getxattr(path, "user.xdg.tags").decode("utf-8", "replace")
    except (OSError, AttributeError):
        return None


class _Part(InputPartition):
    def __init__(self, folders: list[str], deep: bool):
        self.folders, self.deep = folders, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str, rules: list[str], parts: int):
        self.root, self.lines, self.parts = root.rstrip("/"), rules, parts

    def _rules(self, folder: str) -> Rules:
        """The rules in force in ``folder``: the scan's, and those of ignore files from the root down."""
        rules, at = Rules(self.lines), self.root
        for name in ["", *folder[len(self.root) + 1 :].split("/")] if folder != self.root else [""]:
            at = f"{at}/{name}" if name else at
            try:
                with open(f"{at}/.gitignore", encoding="utf-8") as f:
                    rules = Rules(f.read().splitlines(), at[len(self.root) + 1 :], rules)
            except (OSError, UnicodeDecodeError):
                pass
        return rules

    def partitions(self):
        """Folders are opened, level by level, until there are ``parts`` of them; those that were opened
        are listed by themselves, and the others with all that is below."""
        opened, ahead = [], [self.root]
        while ahead and len(ahead) < self.parts:
            level = [(f, r) for f in ahead for r in [self._rules(f)]]
            opened += ahead
            ahead = [e.path for f, r in level for e in self._list(f) if e.is_dir(follow_symlinks=False) and not r.excludes(e.path[len(self.root) + 1 :], True)]
        dealt = [ahead[i :: self.parts] for i in range(min(self.parts, len(ahead)))]
        return [*(_Part([f], False) for f in opened), *(_Part(d, True) for d in dealt)]

    @staticmethod
    def _list(folder: str) -> list[os.DirEntry]:
        try:
            return sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            return []

    def read(self, partition) -> Iterator[tuple]:
        todo = [(f, self._rules(f)) for f in partition.folders]
        while todo:
            folder, rules = todo.pop()
            for e in self._list(folder):
                try:
                    e.name.encode()
                    is_dir, s = e.is_dir(follow_symlinks=False), e.stat(follow_symlinks=False)
                except (OSError, UnicodeEncodeError):
                    continue
                if hidden(s) or rules.excludes(e.path[len(self.root) + 1 :], is_dir):
                    continue
                yield self._row(e, is_dir, s)
                if is_dir and partition.deep:
                    todo.append((e.path, self._inner(e.path, rules)))

    def _inner(self, folder: str, rules: Rules) -> Rules:
        try:
            with open(f"{folder}/.gitignore", encoding="utf-8") as f:
                return Rules(f.read().splitlines(), folder[len(self.root) + 1 :], rules)
        except (OSError, UnicodeDecodeError):
            return rules

    @staticmethod
    def _row(e: os.DirEntry, is_dir: bool, s: os.stat_result) -> tuple:
        stem, dot, ext = e.name.rpartition(".")
        ext = ext.lower() if stem and dot else ""
        runs, head = bool(s.st_mode & 0o111) and not is_dir, ""
        if not is_dir and ((not ext and runs) or ext == "key"):
            try:
                with open(e.path, "rb") as f:
                    head = f.read(4).decode("latin-1")
            except OSError:
                pass
        return (e.path, e.name, ext, is_dir, None if is_dir else s.st_size, s.st_mtime_ns // 10**9, s.st_mtime_ns, s.st_ctime_ns, runs, head, own_tags(e.path))


class FolderSource(DataSource):
    """``spark.read.format("quern_folder").option("root", ...)``, in about as many parts as ``parts`` says."""

    @classmethod
    def name(cls) -> str:
        return "quern_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["root"], [x for x in self.options.get("rules", "").split("\n") if x], int(self.options.get("parts", "64")))


def entries(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    spark.dataSource.register(FolderSource)
    return spark.read.format("quern_folder").option("root", root).option("rules", "\n".join(rules or [])).load()


def content_hash(path: str) -> str | None:
    """A hash of a file's content; of a large one's size, start, middle and end. None if it can't be read."""
    try:
        with open(path, "rb") as f:
            size = os.fstat(f.fileno()).st_size
            if size <= WHOLE:
                return hashlib.file_digest(f, "sha256").hexdigest()
            h = hashlib.sha256(size.to_bytes(8, "little"))
            for start in (0, size // 2 - SAMPLE // 2, size - SAMPLE):
                f.seek(start)
                h.update(f.read(SAMPLE))
            return h.hexdigest()
    except OSError:
        return None


def hashed(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with hash: that of ``known`` (path, hash) where it has one, else by reading files that are
    read as text or share their size with another. The others' contents are not needed."""
    files = found.where("not is_dir and size is not null")
    shared = files.groupBy("size").count().where("count > 1").select("size")
    told = known.where("hash is not null").select("path", "hash")
    todo = files.join(told, "path", "left_anti")
    todo = todo.where("readable").select("path").union(todo.join(shared, "size", "left_semi").select("path")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([content_hash(p) for p in b.column(0).to_pylist()], pa.string())], names=["path", "hash"])

    return found.drop("hash").join(told.unionByName(todo.mapInArrow(run, "path string, hash string")), "path", "left")


def catalogued(found: DataFrame, root: str, text_limit: int = 64 * 1024) -> DataFrame:
    """Files with kind, level, project and readable; ``text_limit`` is kept beside them, so that another
    limit makes every file that is read a changed one.

    A folder that holds a marker is a project unless it is inside one; a bundle is one file. Both are
    found by joining each path with its ancestors, which are as many as its slashes.
    """
    ups = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.call_function("substring_index", F.col("path"), F.lit("/"), i))
    marks = found.where(F.col("name").isin(MARKERS)).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).where(F.col("folder") != root).distinct()
    bundles = found.where(F.col("is_dir") & bundle_kind(F.col("ext")).isNotNull()).select(F.col("path").alias("folder"))
    above = found.select("path", F.explode(ups).alias("folder"))
    project = above.unionByName(found.select("path", F.col("path").alias("folder"))).join(marks, "folder").groupBy("path").agg(F.min_by("folder", F.length("folder")).alias("project"))
    inside = above.join(bundles, "folder").select("path").distinct()
    rows = found.join(inside, "path", "left_anti").join(project, "path", "left")
    rows = rows.withColumn("project", F.when(F.col("project") != F.col("path"), F.col("project"))).withColumn("_own", F.col("path"))
    own = marks.select(F.col("folder").alias("path"), F.lit(True).alias("_marked"))
    rows = rows.join(own, "path", "left")
    folder = F.coalesce(bundle_kind(F.col("ext")), F.when(F.col("_marked") & F.col("project").isNull(), "project").otherwise("folder"))
    kind = F.when(F.col("is_dir"), folder).otherwise(kind_of(F.col("name"), F.col("ext"), F.col("project").isNotNull(), F.col("head")))
    rows = rows.withColumn("kind", kind).drop("_own", "_marked").withColumn("level", level_of(F.col("kind")))
    rows = rows.withColumn("readable", readable(F.col("kind"), F.col("level"), F.col("project").isNotNull()))
    return rows.withColumn("text_limit", F.when(F.col("readable"), F.lit(text_limit).cast("long")))
