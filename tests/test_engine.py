import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.model import kind_of
from quern.operators.dupes import alike_pairs, groups_of, names, same
from quern.operators.graph import components
from quern.operators.ingest import changes, collected
from quern.operators.labels import by_example
from quern.plans import queries as Q
from quern.sources.scratch import Scratch

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(float(v), 6) if v is not None and not isinstance(v, (str, bool)) else v


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_its_oracle(spark, duck, name):
    got = Q.QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    found = duck.execute(Q.ORACLE[name])
    order = [x[0] for x in found.description]
    assert sorted(order) == columns
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("o")).orderBy("i")
    return [r["o"] for r in rows.collect()]


def test_text_functions(spark):
    assert column(spark, ["raisedBeds_x9.md", "seed-list-1998-11.csv", "春の種まき7月.txt", None], T.words) == ["raised Beds x 9 md", "seed list 1998 11 csv", "春 の 種 ま き 7 月 txt", None]
    assert column(spark, ["Seeds (3).CSV", "seeds copy.csv", "seeds - Copy.csv", "beds copy 4.md", "beds.md", "x的副本.txt", "x - copy (2).txt", " copy.md"], T.plain_name) == ["seeds.csv", "seeds.csv", "seeds.csv", "beds.md", "beds.md", "x.txt", "x.txt", " copy.md"]
    assert column(spark, [" #Big  Deal ", "x"], T.clean_tag) == ["big-deal", "x"]
    assert column(spark, ["\n  a\t b \n c", "", " \n "], T.first_line) == ["a b", None, None]


def test_body_words_are_those_of_whole_texts(spark, tmp_path):
    r = random.Random(6)
    parts = ["raisedBedsPlan", "w7", "报销", "x9Y", "é", "ÀbÇd", "-", "_", "\n", " ", "4", "Q", "词"]
    texts = ["".join(r.choices(parts, k=2500)), "a" * 1999 + " camelCase" * 300 + " last7", "short one", "", None, "。" * 3000]
    rows = [(i, t, "en", "src1", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def words(text):  # a character at a time
        out, prev = "", None
        for c in text:
            if "\u3040" <= c <= "\u30ff" or "\u3400" <= c <= "\u4dbf" or "\u4e00" <= c <= "\u9fff":
                out, prev = f"{out} {c} ", None
            elif c.isalnum():
                edge = prev and ((prev.islower() and c.isupper()) or prev.isnumeric() != c.isnumeric())
                out, prev = out + " " * bool(edge) + c, c
            else:
                out, prev = out + " ", None
        return " ".join(out.split())

    got = {r["id"]: r["body_words"] for r in Q.QUERIES["words_tokens"](spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else words(t) for i, t in enumerate(texts)}
    assert got[1].endswith(" last 7")


def test_kinds(spark):
    rows = [("a.pdf", "pdf", False), ("id_rsa", "", False), (".env.example", "example", False), (".env.local", "local", False), ("x.sh", "sh", True), ("x.sh", "sh", False), ("x.unknown", "unknown", False)]
    df = spark.createDataFrame(rows, "name string, ext string, p boolean")
    assert [r[0] for r in df.select(kind_of(F.col("name"), F.col("ext"), F.col("p"))).collect()] == ["pdf", "key", "config", "key", "code", "script", "other"]


def test_duplicates(spark):
    rows = [(1, "/a/seeds.csv", "seeds.csv", 20_000, 5, "h1"), (2, "/b/seeds (1).csv", "seeds (1).csv", 20_000, 6, "h1"), (3, "/c/tools.csv", "tools.csv", 20_000, 7, "h2"), (4, "/a/beds.md", "beds.md", 3, 8, "h3"), (5, "/a/beds copy.md", "beds copy.md", 4, 9, "h4")]
    files = spark.createDataFrame(rows, "id long, path string, name string, size long, mtime long, hash string")
    assert [(r["key"], r["n"], r["wasted"]) for r in groups_of(same(files), "same").collect()] == [("h1", 2, 20_000)]
    assert [(r["key"], r["n"], r["first"]["name"]) for r in groups_of(names(files), "names").collect()] == [("beds.md", 2, "beds.md")]


def test_fingerprints_and_components(spark):
    rows = [(1, "p", 0b0), (2, "p", 0b11), (3, "p", -1), (4, "p", 0b1111), (5, "q", 0b0)]
    pairs = alike_pairs(spark.createDataFrame(rows, "id long, algo string, bits long"), 2)
    assert sorted((r["a"], r["b"], r["distance"]) for r in pairs.collect()) == [(1, 2, 2), (2, 4, 2)]
    got = components(pairs, Scratch(spark)).collect()
    assert sorted((r["node"], r["component"]) for r in got) == [(1, 1), (2, 1), (4, 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(chain, Scratch(spark)).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(chain.limit(0), Scratch(spark)).count() == 0


def test_maintenance(spark):
    s = "path string, size long, mtime long"
    old, new = spark.createDataFrame([("a", 1, 1), ("b", None, 1), ("c", 1, 1)], s), spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("d", 1, 1)], s)
    assert {r["path"]: r["state"] for r in changes(old, new).collect()} == {"a": "same", "b": "changed", "c": "gone", "d": "new"}
    cache = spark.createDataFrame([("x", 5), ("y", 10), ("z", None), ("w", 95)], "hash string, unused_since long")
    left = collected(cache, spark.createDataFrame([("y",)], "hash string"), 100, 50)
    assert {r["hash"]: r["unused_since"] for r in left.collect()} == {"y": None, "z": 100, "w": 95}


def test_labels_by_example(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.95, 0.05]), ("d", [0.0, 1.0])]
    tags = spark.createDataFrame([("a", "money", "manual"), ("b", "money", "manual"), ("d", "lone", "manual")], "hash string, tag string, source string")
    got = by_example(spark.createDataFrame(rows, "hash string, vector array<double>"), tags, 0.3)
    assert sorted((r["hash"], r["label"]) for r in got.collect()) == [("a", "money"), ("b", "money"), ("c", "money")]
