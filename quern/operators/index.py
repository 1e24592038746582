"""The stored full-text index: postings by token, phrases by joins of places, BM25 over columns.

A posting is a token, a field, a file and a place of the token there. The table is sorted by token and
file, so a term reads the row groups of its tokens and nothing of the texts, equal values lie together and
take few bytes, and a hot token's postings lie in as many parts as they need. Nothing is gathered: building
is one pass over the texts and one sort.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import split_plain, token_list, tokens_of
from quern.plans.lang import Term

# The weights of names, folders and bodies, and BM25's parameters.
WEIGHTS = [10.0, 1.0, 1.0]
K1, B = 1.2, 0.75
NAME, DIRS, BODY = 0, 1, 2


def fields(files: DataFrame, home: str = "/home/u") -> DataFrame:
    """(id, name_tokens, dirs_tokens, body_tokens): a name is indexed as it is written and as words."""
    inside = F.regexp_replace(F.substring("path", len(home) + 2, 1 << 30), "(^|/)[^/]*$", "")
    body = F.coalesce(token_list(F.col("text")), F.array().cast("array<string>")) if "text" in files.columns else F.array().cast("array<string>")
    return files.select("id", F.concat(split_plain(F.col("name")), token_list(F.col("name"))).alias("name_tokens"), token_list(inside).alias("dirs_tokens"), body.alias("body_tokens"))


def postings(files: DataFrame, home: str = "/home/u") -> DataFrame:
    """(token, field, id, place) of files (id, name, path and perhaps text)."""
    own = fields(files, home)
    each = own.select("id", F.posexplode(F.array("name_tokens", "dirs_tokens", "body_tokens")).alias("field", "tokens"))
    return each.select("id", "field", F.posexplode("tokens").alias("place", "token")).select("token", "field", "id", "place")


def _sizes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, n): the tokens of every file, 0 for those without any."""
    counts = rows.groupBy("id").agg(F.count("*").alias("n"))
    return files.select("id").join(counts, "id", "left").fillna(0, ["n"])


def _write(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("token", "id").sortWithinPartitions("token", "id", "field", "place").write.parquet(path)


class Index:
    """Postings and the number of tokens of every file."""

    def __init__(self, postings: DataFrame, sizes: DataFrame):
        self.postings, self.sizes = postings, sizes

    @classmethod
    def build(cls, files: DataFrame, path: str, home: str = "/home/u") -> Index:
        """Write the index of ``files`` below ``path``, sorted by token."""
        spark = files.sparkSession
        _write(postings(files, home), f"{path}/postings")
        _sizes(files, spark.read.parquet(f"{path}/postings")).write.parquet(f"{path}/sizes")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/sizes"))

    def refreshed(self, changed: DataFrame, gone: DataFrame, path: str, home: str = "/home/u") -> Index:
        """The index with ``changed`` files read anew and those of ``gone`` (id) left out."""
        off = changed.select("id").unionByName(gone.select("id")).distinct()
        fresh = postings(changed, home)
        _write(self.postings.join(off, "id", "left_anti").unionByName(fresh), f"{path}/postings")
        self.sizes.join(off, "id", "left_anti").unionByName(_sizes(changed, fresh)).write.parquet(f"{path}/sizes")
        return Index.load(changed.sparkSession, path)

    def phrase(self, words: list[str], exact: bool, within: Iterable[int] = (NAME, DIRS, BODY)) -> DataFrame:
        """(id, field, n): how often the words stand side by side; the last is a prefix unless ``exact``."""
        rows = self.postings.where(F.col("field").isin(list(within)))
        last = len(words) - 1

        def of(i: int) -> Column:
            w = words[i]
            if i < last or exact:
                return F.col("token") == w
            return (F.col("token") >= w) & F.startswith("token", F.lit(w))

        met = None
        for i in range(last + 1):
            # Places where the phrase would begin.
            at = rows.where(of(i)).select("id", "field", (F.col("place") - i).alias("at"))
            met = at if met is None else met.join(at, ["id", "field", "at"])
        return met.groupBy("id", "field").agg(F.count("*").alias("n"))

    def term(self, term: Term) -> DataFrame:
        """(id, f, named): a term's weighted frequency, and whether names or folders have it."""
        words = tokens_of(term.text)
        within = [NAME] if term.name_only else [NAME, DIRS, BODY] if searches_body(term) else [NAME, DIRS]
        weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.col("field") + 1)
        return self.phrase(words, term.exact, within).groupBy("id").agg(F.sum(weight * F.col("n")).alias("f"), F.max(F.col("field") < BODY).alias("named"))

    def ranked(self, terms: list[Term]) -> DataFrame:
        """(id, score, by_name) of files that match all terms; a smaller score is better.

        Statistics are single rows. Each term's rows are those of its own tokens.
        """
        terms = [t for t in terms if tokens_of(t.text)]
        stats = self.sizes.agg(F.count("*").alias("_all"), F.avg("n").alias("_avg"))
        out, score, named = None, F.lit(0.0), F.lit(True)
        for i, t in enumerate(terms):
            own = self.term(t).toDF("id", f"_f{i}", f"_named{i}")
            stats = stats.crossJoin(own.agg(F.count("*").alias(f"_df{i}")))
            out = own if out is None else out.join(own, "id")
            f, n = F.col(f"_f{i}"), F.col(f"_df{i}")
            idf = F.greatest(F.log((F.col("_all") - n + 0.5) / (n + 0.5)), F.lit(1e-6))
            score -= idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
            named &= F.col(f"_named{i}")
        out = out.join(self.sizes.withColumnRenamed("n", "_n"), "id").crossJoin(F.broadcast(stats))
        return out.select("id", score.alias("score"), named.alias("by_name"))

    def without(self, words: Iterable[str]) -> DataFrame:
        """(id) of files whose name or folders have one of the words, to be left out."""
        out = None
        for w in words:
            if own := tokens_of(w):
                hit = self.phrase(own, False, [NAME, DIRS]).select("id")
                out = hit if out is None else out.unionByName(hit)
        return self.sizes.select("id").limit(0) if out is None else out.distinct()

    def counts(self) -> DataFrame:
        """(token, files, places) of bodies: the commonness of every word."""
        each = self.postings.where(F.col("field") == BODY).groupBy("token", "id").agg(F.count("*").alias("n"))
        return each.groupBy("token").agg(F.count("*").alias("files"), F.sum("n").alias("places"))


def searches_body(term: Term) -> bool:
    """Bodies are searched for words of three letters, or of other scripts, at least."""
    return not term.name_only and any(len(w) >= 3 or not w.isascii() for w in term.text.split())
