"""The catalogue as one object: scan, search, duplicates, tags, labels, meaning, processors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.passages import chunk_line, snippet, wanted_words
from quern.operators import dupes as D
from quern.operators import extras as E
from quern.operators import ingest as I
from quern.operators import labels as L
from quern.operators import meaning as M
from quern.operators import plugins as P
from quern.operators import search as S
from quern.operators import tags as G
from quern.operators.index import Index
from quern.plans.lang import DEFAULT_DISTANCE, DEFAULT_LIMIT, Query, clean_tag, parse
from quern.sources.documents import with_text
from quern.sources.files import catalogued, entries, hashed
from quern.sources.scratch import Scratch, scratch_root

TAGS = "hash string, tag string, source string, score double"
CONTENTS = "hash string, text string, text_limit long"
OUTPUTS = "hash string, processor string, version int, text string, tags array<string>, labels array<string>, algo string, bits long, duration double, error string"
EXTRAS = "hash string, text string, version long"
FILE_TAGS = "id long, tag string"
EMBEDDED = "model string, hash string, policy string"
NAMES = "model string, name string, vector array<float>"
TEXT_LIMIT = 64 * 1024
NOT_FOLDERS = ["folder", "project", "app"]


class Engine:
    """Tables as DataFrames; every change makes a new one, so readers keep the snapshot they have.

    ``files``: id, path, name, ext, kind, level, size, mtime, hash, project_id, text.
    """

    def __init__(self, spark: SparkSession, files: DataFrame | None = None, tags: DataFrame | None = None, home: str = "/home/u", zone: str = "UTC", text_limit: int = TEXT_LIMIT):
        self.spark, self.files, self.home, self.zone, self.text_limit = spark, files, home, zone, text_limit
        self.scratch = Scratch(spark)
        self.tag_rows = tags if tags is not None else spark.createDataFrame([], TAGS)
        self.contents = spark.createDataFrame([], CONTENTS)
        self.outputs = spark.createDataFrame([], OUTPUTS)
        self.extras = spark.createDataFrame([], EXTRAS)
        self.file_tags = spark.createDataFrame([], FILE_TAGS)
        self.embedded = spark.createDataFrame([], EMBEDDED)
        self.names = spark.createDataFrame([], NAMES)
        self.vectors: DataFrame | None = None
        self.index: Index | None = None
        if files is not None:
            self.reindex()

    # What is there

    def scan(self, root: str, rules: list[str] | None = None) -> dict[str, int]:
        """Read a folder that all executors see, and index what is new or changed.

        Files that did not change keep their hash; others are hashed where their text is read or where
        another file has their size. A text is read once for a content and limit, so files that were
        moved, copied or touched are not read again. Returns how many files there are, were new, changed
        or gone, and how many texts were read.
        """
        found = self.scratch.table(catalogued(entries(self.spark, root, rules), root, self.text_limit))
        old = self.files if self.files is not None and self.home == root else found.limit(0).withColumn("hash", F.lit(None).cast("string"))
        state = self.scratch.table(I.changes(old, found))
        rows = hashed(found, old.join(state.where("state = 'same'"), "path", "left_semi"))
        rows = self.scratch.table(rows.withColumn("id", F.xxhash64("path")).withColumn("project_id", F.when(F.col("project").isNotNull(), F.xxhash64("project"))))
        todo = I.unread(rows.where("readable"), self.contents, self.text_limit)
        fresh = self.scratch.table(with_text(todo, self.text_limit))
        self.contents = self.scratch.table(I.merged(self.contents, fresh.select("hash", "text", F.lit(self.text_limit).cast("long").alias("text_limit")), "hash"))
        before, self.home = self.files if self.home == root else None, root
        self.files = self.scratch.table(E.with_full_text(rows, E.full_texts(self.contents, self.extras)))
        own = self.files.where("own_tags is not null").select("id", F.explode(G.carried(F.col("own_tags"))).alias("tag"))
        self.file_tags = self.scratch.table(G.by_rule(self.files).unionByName(own).distinct())
        self.reindex(before, state)
        told = {r["state"]: r["n"] for r in state.groupBy("state").agg(F.count("*").alias("n")).collect()}
        return {"files": self.files.count(), **{k: told.get(k, 0) for k in ("new", "changed", "gone", "same")}, "read": fresh.count()}

    def reindex(self, before: DataFrame | None = None, state: DataFrame | None = None) -> None:
        """The full-text index of all files, or of those that ``state`` says are another than before."""
        path = f"{scratch_root(self.spark)}/quern-index-{uuid.uuid4().hex}"
        if self.index is None or before is None or state is None:
            self.index = Index.build(self.files, path, self.home)
            return
        changed = self.files.join(state.where("state in ('new', 'changed')"), "path", "left_semi")
        gone = before.join(state.where("state = 'gone'"), "path", "left_semi").select("id")
        self.index = self.index.refreshed(changed, gone, path, self.home)

    def folders(self) -> DataFrame:
        return self.files.where(F.col("kind").isin("folder", "project")).select("path").orderBy("path")

    def is_empty(self) -> bool:
        return self.files is None or self.files.isEmpty()

    # Search

    def query(self, text: str, now: int) -> Query:
        return parse(text, now, self.home, self.zone)

    def search(self, text: str, now: int, embedder: P.Embedder | None = None) -> DataFrame:
        """Ranked hits: path, name, kind, size, mtime, line, tags. Words are ignored with ``dupes:`` or
        ``similar:``, and what a meaning finds is fused with what the words find."""
        return self.search_with(self.query(text, now), now, embedder)

    def search_with(self, q: Query, now: int, embedder: P.Embedder | None = None) -> DataFrame:
        limit = q.limit or DEFAULT_LIMIT
        if q.dupes:
            return D.flattened(self._duplicates(q), limit)
        left = S.filters(self.files, q, self.tag_rows, self.file_tags, self.index)
        if q.similar:
            most = q.dupes.looks if q.dupes and q.dupes.looks is not None else DEFAULT_DISTANCE
            both = left.unionByName(self.files.where(F.col("path") == q.similar)).distinct() if q.similar else left
            near = D.similar_files(both.drop("text"), self.outputs.select("hash", "algo", "bits", "duration"), q.similar, most)
            return self._shown(near.limit(limit).withColumn("_rank", F.row_number().over(Window.orderBy("distance", "path"))).withColumn("line", F.lit(None).cast("string")))
        words = S.search_words(self.files, q, now, self.index, self.tag_rows, self.file_tags)
        words = words.withColumn("_rank", F.monotonically_increasing_id())
        hits, wanted = words.withColumn("start", F.lit(None).cast("int")).withColumn("end", F.lit(None).cast("int")), M.wants_meaning(q.terms)
        if "by_name" not in hits.columns:
            hits = hits.withColumn("by_name", F.lit(True))
        if embedder and wanted and self.vectors is not None:
            near = M.near_files(left, self.vectors.where(F.col("model") == embedder.id), self.names.where(F.col("model") == embedder.id), embedder.query(wanted), embedder.min_score)
            hits = self._fused(hits, near, limit)
        lines = wanted_words([t.text for t in q.terms])
        line = F.when(F.col("start").isNotNull(), chunk_line(F.col("text"), F.col("start"), F.col("end"), lines)).when(~F.coalesce("by_name", F.lit(True)), snippet(F.col("text"), lines))
        return self._shown(hits.withColumn("line", line))

    def _shown(self, hits: DataFrame) -> DataFrame:
        tags = G.of_files(hits.select("id", "hash"), self.tag_rows, self.file_tags)
        return hits.join(tags, "id", "left").orderBy("_rank").select("path", "name", "kind", "size", "mtime", "line", "tags")

    def _fused(self, words: DataFrame, near: DataFrame, limit: int) -> DataFrame:
        """Both rankings are of bounded length: the limit, and the nearest vectors' files."""
        a = words.select("id", F.row_number().over(Window.orderBy("_rank")).alias("rank"))
        b = near.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("rank"))
        top = S.fuse(a, b).join(a.withColumnRenamed("rank", "_word"), "id", "left").orderBy(F.desc("fused"), F.asc_nulls_last("_word"), "id").limit(limit)
        flags = words.select("id", "by_name")
        # What words found keeps its own line; only what a meaning alone found shows its passage.
        rows = self.files.join(F.broadcast(top), "id").join(flags, "id", "left").join(near.select("id", "start", "end"), "id", "left")
        start, end = (F.when(F.col("by_name").isNull(), F.col(c)).alias(c) for c in ("start", "end"))
        rows = rows.select(*(c for c in rows.columns if c not in ("start", "end")), start, end)
        return rows.withColumn("_rank", F.row_number().over(Window.orderBy(F.desc("fused"), F.asc_nulls_last("_word"), "id")))

    def _duplicates(self, q: Query) -> dict[str, DataFrame]:
        left = S.filters(self.files.where(~F.col("kind").isin(NOT_FOLDERS)), q, self.tag_rows, self.file_tags, self.index)
        wanted, parts = q.dupes, {}
        if wanted is None or wanted.same:
            parts["same"] = D.same(left)
        if wanted is None or wanted.looks is not None:
            parts["looks"] = D.look_alikes(left, self.outputs.select("hash", "algo", "bits", "duration"), DEFAULT_DISTANCE if wanted is None else wanted.looks)
        if wanted is None or wanted.names:
            parts["names"] = D.names(left)
        return parts

    def duplicates(self, text: str, now: int) -> DataFrame:
        """(likeness, key, n, wasted, first): groups of the kinds asked for, the most wasteful first."""
        groups = D.all_groups(self._duplicates(self.query(text, now)))
        return groups.orderBy(F.desc("wasted"), "rank", "first.path").drop("rank")

    # Tags and labels

    def forget(self, path: str) -> int:
        """Drop a path and what is below, and what was learnt of contents that no other file has; tags
        given or taken off by hand stay."""
        gone = self.scratch.table(self.files.where(I.under(F.col("path"), path)).select("id", "hash"))
        kept = self.scratch.table(self.files.where(~I.under(F.col("path"), path)))
        unused = gone.select("hash").distinct().join(kept.select("hash"), "hash", "left_anti")
        self.tag_rows = I.forgotten_tags(self.tag_rows, unused)
        self.contents, self.outputs, self.extras, self.embedded = (x.join(unused, "hash", "left_anti") for x in (self.contents, self.outputs, self.extras, self.embedded))
        if self.vectors is not None:
            self.vectors = self.vectors.join(unused, "hash", "left_anti")
        self.file_tags = self.file_tags.join(gone.select("id"), "id", "left_anti")
        changed = kept.limit(0)
        self.index = self.index.refreshed(changed, gone.select("id"), f"{scratch_root(self.spark)}/quern-index-{uuid.uuid4().hex}", self.home)
        self.files = kept
        return gone.count()

    def tag(self, path: str, tag: str, on: bool = True) -> None:
        """Give a tag to a file's content, or take it off; either clears the other."""
        row = self.files.where(F.col("path") == path).select("hash").first()
        if not row or row["hash"] is None:
            raise ValueError(f"no content of `{path}` is known")
        given = self.spark.createDataFrame([(row["hash"], clean_tag(tag))], "hash string, tag string")
        self.tag_rows = self.scratch.table(G.set_by_hand(self.tag_rows, given, on))

    def tags(self, path: str) -> list[str]:
        """The tags in force of the file at ``path``."""
        row = G.of_files(self.files.where(F.col("path") == path), self.tag_rows, self.file_tags).first()
        return row["tags"] if row else []

    def manual_tags(self) -> DataFrame:
        return G.manual_counts(self.tag_rows)

    def learn_labels(self, embedder: P.Embedder, labels: dict[str, str] | None = None) -> None:
        """Replace all learnt labels by those of descriptions and of examples given by hand."""
        labels = L.DEFAULT_LABELS if labels is None else labels
        vectors = self.vectors.withColumn("vec_id", F.xxhash64("hash", "chunk"))
        told = L.by_description(vectors, {k: embedder.query(v) for k, v in labels.items()}, embedder.min_score + L.MARGIN).select("hash", F.col("label").alias("tag"), F.lit("meaning").alias("source"), "score")
        like = L.by_example(vectors, self.tag_rows, embedder.min_score).select("hash", F.col("label").alias("tag"), F.lit("examples").alias("source"), "score")
        kept = self.tag_rows.where(~F.col("source").isin("meaning", "examples"))
        self.tag_rows = kept.unionByName(told, allowMissingColumns=True).unionByName(like, allowMissingColumns=True)

    # Meaning and processors

    def _texts(self) -> DataFrame:
        return E.full_texts(self.contents, self.extras)

    def embed(self, embedder: P.Embedder, private: list[str] | None = None, go_on=lambda: True) -> dict[str, int]:
        """Vectors of names and texts that have none yet, or whose text is another than it was; a model
        elsewhere sees no private folder. ``go_on`` is asked between the two."""
        rows = self.files if embedder.is_local else I.outside(self.files, private or [])
        names = self.scratch.table(M.name_vectors(rows, embedder, self.names))
        self.names = self.names.unionByName(names)
        if not go_on():
            return {"names": names.count(), "texts": 0}
        texts = self._texts().join(rows.where(F.col("level") >= M.MEANING).groupBy("hash").agg(F.min("kind").alias("kind")), "hash")
        policy = F.concat(F.lit("lines-1/"), "policy")
        done = self.embedded.where(F.col("model") == embedder.id).select("hash", "policy")
        todo = self.scratch.table(texts.withColumn("policy", policy).join(done, ["hash", "policy"], "left_anti"))
        new = self.scratch.table(P.embed(todo, embedder))
        if self.vectors is not None:
            stale = F.col("model") == embedder.id
            kept = self.vectors.where(~stale).unionByName(self.vectors.where(stale).join(todo.select("hash"), "hash", "left_anti"))
            new = kept.unionByName(new)
        self.vectors = new
        rest = self.embedded.where(F.col("model") != embedder.id).unionByName(self.embedded.where(F.col("model") == embedder.id).join(todo.select("hash"), "hash", "left_anti"))
        self.embedded = rest.unionByName(todo.select(F.lit(embedder.id).alias("model"), "hash", "policy"))
        return {"names": names.count(), "texts": todo.count()}

    def pending_meaning(self, embedder: P.Embedder) -> tuple[int, int]:
        """Names and contents that the model has yet to see."""
        row = M.pending_counts(self.files, self._texts().select("hash", "policy"), self.embedded, self.names, embedder.id).first()
        return row["names"], row["files"]

    def process(self, processor: P.Processor, private: list[str] | None = None) -> dict[str, int]:
        """Run a processor over contents that this version has not seen; tag them, and index again the
        files of contents of which something else is said than before."""
        rows = self.files if processor.is_local else I.outside(self.files, private or [])
        new = self.scratch.table(P.process(rows, processor, self.outputs))
        replaced = self.outputs.where(F.col("processor") == processor.id).join(new.select("hash"), "hash", "left_semi")
        kept = self.outputs.join(replaced.select("hash", "processor"), ["hash", "processor"], "left_anti")
        self.outputs = self.scratch.table(kept.unionByName(new))
        touched = new.select("hash")
        after = self.scratch.table(E.next_extras(self.extras, self.outputs, touched))
        changed = self.scratch.table(E.changed_hashes(self.extras, after))
        self.extras = after
        others = self.tag_rows.where("source not in ('plugin', 'plugin-label')").unionByName(self.tag_rows.where("source in ('plugin', 'plugin-label')").join(touched, "hash", "left_anti"))
        self.tag_rows = self.scratch.table(others.unionByName(G.by_processors(self.outputs.join(touched, "hash", "left_semi"))))
        before = self.files
        self.files = self.scratch.table(E.with_full_text(before, self._texts()))
        state = before.join(changed, "hash", "left_semi").select("path", F.lit("changed").alias("state"))
        self.reindex(before, state)
        told = new.agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
        return {"done": told["n"] - told["bad"], "failed": told["bad"]}
