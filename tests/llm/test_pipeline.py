import random
from collections import Counter

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from quern.llm.mixing import targets

from .fixtures import DOCUMENTS, documents, prose, words
from .test_operators import brute_components


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    df, _ = documents(spark)
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_documents_of_menu_and_footer_go_and_copies_stay(spark, sf_dir):
    r = random.Random(21)
    line = lambda k: f"{prose(r, 6)} fixed line {'abcdefghijklmnopqrstuvwxyz'[k]}"
    menu, footer, page = [line(k) for k in range(8)], [line(8 + k) for k in range(8)], [line(16 + k) for k in range(9)]
    rows = [(i, "\n".join([*menu, *(f"{prose(r, 2)} u{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + k)}" for k in range(1 + i % 3)), *footer]), "en", "h", 1) for i in range(60)]
    rows += [(100 + i, "\n".join([*menu, prose(r, 120), *footer]), "en", "h", 1) for i in range(20)]
    # Near copies that differ in one line each, nowhere the same, between fixed ends.
    rows += [(200 + i, "\n".join([*page[: i % 7 + 1], f"changed {chr(97 + i)} word here", *page[i % 7 + 2 :]]), "en", "k", 1) for i in range(14)]
    got = {r["doc_id"] for r in P.quality_rules(spark, spark.createDataFrame(rows, DOCUMENTS), sf_dir).collect()}
    assert got == {*range(100, 120), *range(200, 214)}


def test_near_duplicates_keep_one_of_each_component(spark, sf_dir):
    df, rows = documents(spark)
    got = P.near_duplicates(spark, df, sf_dir)
    assert got.columns == df.columns
    parts = brute_components(rows)
    kept = Counter(r["doc_id"] for r in got.collect())
    named = {c for d, n, c in parts if n}
    assert {d for d in kept if d not in (5, 6, 7)} - {None} == named - {None}
    assert all(kept[d] == 1 for d in (5, 6, 7, 1, 8, 15))


def test_near_duplicates_link_at_five_words_and_four_fifths(spark, sf_dir):
    r = random.Random(12)
    rows = []
    for i in range(30):  # copies with one to eight words changed: similarities on both sides of 0.8
        base = [f"w{i}x{j}" for j in range(100)]
        rows.append((2 * i, " ".join(base), "en", "a", 1))
        for j in r.sample(range(100), 1 + i % 8):
            base[j] = "other"
        rows.append((2 * i + 1, " ".join(base), "en", "a", 1))
    df = spark.createDataFrame(rows, DOCUMENTS)
    kept = {r["doc_id"] for r in P.near_duplicates(spark, df, sf_dir).collect()}
    named = lambda n, percent: {c for _, _, c in brute_components(rows, n, percent)}
    assert kept == named(5, 80) != named(4, 85)


def test_mixed_documents_hold_what_the_mix_takes(spark, sf_dir):
    df, rows = documents(spark)
    df = df.where("doc_id is not null and doc_id not in (14, 15)")
    own = [r for r in rows if r[0] is not None and r[0] not in (14, 15)]
    got = P.source_mix(spark, df, sf_dir).collect()
    sizes = Counter()
    for _, t, _, s, _ in own:
        sizes[s] += len(words(t))
    taken = Counter()
    whole = {r[0]: r[1] for r in own}
    for r in got:
        taken[r["source"]] += len(words(r["text"]))
        assert " ".join(words(r["text"])) in " ".join(words(whole[r["doc_id"]])) and r["n_chars"] == len(r["text"])
    for p in targets(list(sizes.items()), [1.0, 2.0, 3.0]):
        assert abs(taken[p.source] - p.target) <= 0.02 * p.target + 5


CLASHES = ["k", "c", "_k", "_k2", "_d", "_s", "_toxicity", "_lines", "_w", "_key", "_size", "size", "rows", "taken", "d", "g", "goes", "component_id", "score", "kept", "a.b"]


@pytest.mark.parametrize("name, stage", P.STAGES[:-1])
def test_stages_leave_other_columns_alone(spark, sf_dir, name, stage):
    df, rows = documents(spark)
    odd = df.withColumns({c: F.col("doc_id") * 7 + i for i, c in enumerate(CLASHES)})
    got = stage(spark, odd, sf_dir)
    assert got.columns == odd.columns and got.schema["n_chars"].dataType == odd.schema["n_chars"].dataType
    found = got.collect()
    assert all(r[c] == r["doc_id"] * 7 + i for r in found if r["doc_id"] is not None for i, c in enumerate(CLASHES))
    plain = stage(spark, df, sf_dir).collect()
    assert Counter((r["doc_id"], r["text"]) for r in found) == Counter((r["doc_id"], r["text"]) for r in plain)
    assert stage(spark, odd.limit(0), sf_dir).count() == 0


def test_toxic_documents_go_and_others_stay(spark, tmp_path):
    r = random.Random(31)
    rows, labels = [], []
    for i in range(600):
        w, bad = prose(r, 60).split(), i % 4 == 0
        for _ in range(3 * bad):
            w[r.randrange(60)] = r.choice(("vilo grubo", "the slimo", "zanko"))
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    rows += [(1001, None, "en", "a", 0), (1002, "", None, None, 0), (None, prose(r, 30), "en", "a", 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {x["doc_id"] for x in P.toxic_documents(spark, spark.createDataFrame(rows, DOCUMENTS), str(tmp_path)).collect()}
    good = {i for i in range(600) if i % 4} | {1001, 1002, None}
    assert len(good - kept) <= 6 and len(kept & {i for i in range(0, 600, 4)}) <= 15


def test_packing_places_every_token(spark, sf_dir):
    df, rows = documents(spark)
    got = P.packing(spark, df.withColumn("length", F.lit("x")), sf_dir).collect()
    assert Counter(r["doc_id"] for r in got if not r["start"]) == Counter(r[0] for r in rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        ends = [0]
        for offset, n in sorted(pieces):
            assert offset == ends[-1]
            ends.append(offset + n)
        assert ends[-1] <= 1024


def test_the_whole_pipeline(spark, sf_dir):
    got = P.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0
    empty = sf_dir + "-empty"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert P.run(spark, empty).count() == 0
