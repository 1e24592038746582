import io
import os
import random
import sys
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.engine import Engine
from quern.functions import text as T
from quern.functions.passages import chunk_line, chunk_ranges, chunks, snippet, wanted_words
from quern.operators import dupes as D
from quern.operators.plugins import Embedder, External, Processor, embed, process, register_query_plugin
from quern.sources.documents import office, plain
from quern.streaming.debounce import capped_batches

NOW = 1_789_560_000


def zipped(**files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def test_chunks_are_byte_ranges_at_lines_spaces_or_characters():
    assert chunks("") == [] and chunks("a\nb") == [(0, 3)] and chunks(" \n ") == []
    text = "line\n" * 300
    got = chunks(text)
    assert [b - a for a, b in got] == [1000, 500] and got[-1][1] == 1500
    long = "é" * 1500
    assert all((b - a) % 2 == 0 and b - a <= 1000 for a, b in chunks(long)) and chunks(long)[-1][1] == 3000
    spaced = "word " * 500
    assert all(spaced[a:b].endswith(" ") for a, b in chunks(spaced))


def test_chunk_column(spark):
    got = spark.createDataFrame([("a\nb",), (None,)], "t string").select(chunk_ranges(F.col("t")).alias("c")).collect()
    assert sorted((r["c"] or [(9, 9)])[0][0] for r in got) == [0, 9]


def line_of(spark, text, wanted):
    return spark.createDataFrame([(text,)], "t string").select(snippet(F.col("t"), wanted).alias("l")).first()["l"]


def test_lines(spark):
    assert line_of(spark, "soup of leeks\nfresh onion soup\nonions, then soup with onion", ["onion", "sou"]) == "fresh onion soup"
    assert line_of(spark, "a leek\nleekAndOnion pie", ["leek", "onion"]) == "leekAndOnion pie"
    assert line_of(spark, "nothing here", ["leek"]) is None and line_of(spark, None, ["leek"]) is None and line_of(spark, "x", []) is None
    assert line_of(spark, "stew " * 50 + "with leeks", ["leek"]) == "… stew stew with leeks"
    assert line_of(spark, "leek " + "stew " * 50, ["leek"]) == ("leek " + "stew " * 50)[:160] + "…"
    assert wanted_words(["redOnion 3kg", "Émile onion"]) == ["red", "onion", "3", "kg", "émile"]
    row = spark.createDataFrame([("é first\nsecond leek\nthird", 9, 21)], "t string, s int, e int")
    got = row.select(chunk_line(F.col("t"), F.col("s"), F.col("e"), ["leek"]).alias("a"), chunk_line(F.col("t"), F.col("s"), F.col("e"), ["no"]).alias("b")).first()
    assert tuple(got) == ("second leek", "second leek")


def test_tokens_are_the_same_on_both_sides(spark):
    r = random.Random(4)
    parts = ["a", "B", "ß", "é", "E\u0301", "Č", "ñ", "7", "٣", "٣x", "字", "かな", "한", "_", "-", " ", "\n", "İ", "x2y", "camelCase", "Ω", "ώ", "ﬁ", "ø", "\u0301", "²", "Ⅷ", "\U00020001"]
    texts = ["".join(r.choices(parts, k=r.randrange(12))) for _ in range(600)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.token_list(F.col("t")).alias("k")).collect()
    assert {r["i"]: r["k"] for r in rows} == {i: T.tokens_of(t) for i, t in enumerate(texts)}


def test_documents():
    docx = zipped(word__document_xml="<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>Peas &amp; beans</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>")
    assert office(docx, "docx") == "Peas & beans\ntwo"
    assert office(docx, "docx", 7) == "Peas & "
    slides = {f"ppt__slides__slide{i}_xml": f"<a xmlns:b='b'><b:p><b:t>slide {i}</b:t></b:p></a>" for i in (10, 2)}
    assert office(zipped(**slides), "pptx") == "slide 2\nslide 10"
    odt = {"content_xml": "<o xmlns:t='t'><t:h>Title</t:h><t:p>one <t:span>two</t:span> three</t:p></o>"}
    assert office(zipped(**odt), "odt").split("\n")[0] == "Title"
    assert office(zipped(**odt, **{"META-INF__manifest_xml": "encryption-data"}), "odt") is None
    sheet = {"xl__sharedStrings_xml": "<s><si><t>name</t></si></s>", "xl__worksheets__sheet1_xml": "<w><row><c t='s'><v>0</v></c><c><v>5</v></c></row></w>"}
    assert office(zipped(**sheet), "xlsx") == "name\t5"
    assert office(b"broken", "docx") is None
    assert plain("é".encode() * 3, 3) == "é" and plain(b"a\0b") is None and plain(b"\xff\xfe") is None and plain("﻿ x ".encode()) == "x"


@pytest.fixture
def home(tmp_path):
    root = tmp_path / "grower"
    files = {
        "Plots/raisedBeds_2023.md": "soil mix\nleeks beside the onions",
        "Plots/seeds/orderTomatoes.csv": "kind,amount\ntomato,3",
        "Plots/seeds/Čapková 種子.txt": "ředkvičky a mrkev",
        "tools/waterEvening.sh": "#!/bin/sh\nvalve --open 20m  # tomatoes first",
        ".gnupg/ring.gpg": "closed",
        "site/pyproject.toml": "[project]",
        "site/shop/cart.py": "def add(leek): ...",
        "site/build/out.py": "generated",
        "site/.gitignore": "/build/\n*.tmp\n!keep.tmp\ndocs/**/old\n",
        "site/a.tmp": "x", "site/keep.tmp": "kept", "site/docs/x/y/old/page.md": "gone", "site/docs/x/new.md": "stays",
        "Greenhouse.app/Contents/Info.plist": "x",
        "mulch.trash/a.txt": "x",
        "pics/one.png": "same bytes", "pics/two.png": "same bytes", "pics/Screenshot 4.png": "other",
    }
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_scan_and_search(spark, home):
    engine = Engine(spark)
    told = engine.scan(home, ["mulch.trash/"])
    kinds = {r["path"][len(home) + 1 :]: r["kind"] for r in engine.files.collect()}
    assert told["files"] == len(kinds) == told["new"] and told["read"] > 3
    assert kinds["site"] == "project" and kinds["site/shop/cart.py"] == "code" and kinds["Greenhouse.app"] == "app"
    assert kinds[".gnupg/ring.gpg"] == "key" and kinds["Plots"] == "folder"
    assert not any(p.startswith(("site/build", "Greenhouse.app/", "mulch", "site/docs/x/y/old")) for p in kinds)
    assert "site/keep.tmp" in kinds and "site/a.tmp" not in kinds and "site/docs/x/new.md" in kinds
    found = lambda q: [r["name"] for r in engine.search(q, NOW).collect()]
    assert found("tomatoes")[0] == "orderTomatoes.csv" and set(found("tomatoes")) == {"orderTomatoes.csv", "waterEvening.sh"}
    assert found("raisedBeds") == found("beds") == found("raisedbeds_2023") == ["raisedBeds_2023.md"]  # as written, and by words
    assert found("capkova") == found("ČAPKOVÁ") == found("種子") == found("子") == found("mrkev") == ["Čapková 種子.txt"]
    assert found("cart") == [] and found("cart kind:code") == ["cart.py"] and found("closed") == []
    assert found("tomatoes -water") == ["orderTomatoes.csv"] and found("-plots tomatoes") == ["waterEvening.sh"]
    line = {r["name"]: r["line"] for r in engine.search("onions", NOW).collect()}
    assert line == {"raisedBeds_2023.md": "leeks beside the onions"}
    assert engine.tags(f"{home}/site") == ["python"] and engine.tags(f"{home}/pics/Screenshot 4.png") == ["screenshot"]
    engine.tag(f"{home}/Plots/raisedBeds_2023.md", "#To Plant")
    assert found("tag:to-plant") == ["raisedBeds_2023.md"] and engine.manual_tags().collect()[0]["tag"] == "to-plant"
    engine.tag(f"{home}/Plots/raisedBeds_2023.md", "to plant", False)
    assert found("tag:to-plant") == [] and engine.tags(f"{home}/Plots/raisedBeds_2023.md") == []
    same = D.groups_of(D.same(engine.files, 1), "same").collect()
    assert [(r["n"], r["wasted"]) for r in same] == [(2, 10)]
    assert [r["name"] for r in engine.search(f"similar:{home}/pics/one.png", NOW).collect()] == ["two.png"]
    assert engine.forget(f"{home}/Plots") == 5 and found("beds") == []
    assert not engine.is_empty() and f"{home}/pics" in [r["path"] for r in engine.folders().collect()]


def test_scans_read_only_what_is_new(spark, home):
    engine = Engine(spark)
    first = engine.scan(home)
    again = engine.scan(home)
    assert (again["read"], again["new"], again["changed"], again["gone"], again["same"]) == (0, 0, 0, 0, first["files"])
    os.rename(f"{home}/tools/waterEvening.sh", f"{home}/tools/moved.sh")
    with open(f"{home}/Plots/raisedBeds_2023.md", "a") as f:
        f.write("\nparsnips")
    os.remove(f"{home}/pics/two.png")
    third = engine.scan(home)
    assert (third["read"], third["new"], third["gone"]) == (1, 1, 2)
    found = lambda q: [r["name"] for r in engine.search(q, NOW).collect()]
    assert found("parsnips") == ["raisedBeds_2023.md"] and found("valve") == ["moved.sh"] and found("two") == []
    small = Engine(spark, text_limit=12)
    small.scan(home)
    assert [r["name"] for r in small.search("onions", NOW).collect()] == []
    small.text_limit = 4096
    assert small.scan(home)["read"] >= first["read"] - 3
    assert [r["name"] for r in small.search("onions", NOW).collect()] == ["raisedBeds_2023.md"]


def kitchen(texts):
    """Vectors of three numbers by the letters of a text: what begins with t, with l, and the rest."""
    rows = [[sum(w[:1] == c for w in t.lower().split()) + 0.05 for c in "tl"] + [0.05] for t in texts]
    return [[x / sum(y * y for y in r) ** 0.5 for x in r] for r in rows]


def test_meaning_finds_names_and_passages(spark, home):
    engine = Engine(spark)
    engine.scan(home)
    model = Embedder("kitchen", kitchen, 0.9)
    names, texts = engine.pending_meaning(model)
    assert names > 1 and texts > 1
    assert engine.embed(model) == {"names": names, "texts": texts}
    assert engine.pending_meaning(model) == (0, 0) and engine.embed(model)["texts"] == 0
    hits = {r["name"]: r["line"] for r in engine.search("leek lettuce lovage", NOW, model).collect()}
    assert "raisedBeds_2023.md" not in hits or hits["raisedBeds_2023.md"]
    assert engine.search('"leek lettuce"', NOW, model).count() == 0
    far = Embedder("far", kitchen, 0.9, is_local=False)
    seen = engine.embed(far, [f"{home}/Plots"])
    assert seen["texts"] < texts


def test_processors_tag_and_index_what_they_say(spark, home):
    engine = Engine(spark)
    engine.scan(home)
    def look(job):
        if "Screenshot" in job["path"]:
            raise ValueError("unreadable")
        return {"text": "a wheelbarrow", "tags": [" Red Cart ", "red cart"], "labels": ["tools"], "algo": "phash", "bits": 7, "duration": None}

    own = Processor("look", 1, ("image",), look)
    assert engine.process(own) == {"done": 1, "failed": 1} and engine.process(own) == {"done": 0, "failed": 0}
    found = lambda q: sorted(r["name"] for r in engine.search(q, NOW).collect())
    assert found("wheelbarrow") == ["one.png", "two.png"] and found("tag:red-cart") == ["one.png", "two.png"]
    assert engine.tags(f"{home}/pics/one.png") == ["red-cart", "tools"]
    newer = Processor("look", 2, ("image",), lambda job: {"text": "a spade"})
    assert engine.process(newer)["done"] == 2
    assert found("wheelbarrow") == [] and found("spade") == ["Screenshot 4.png", "one.png", "two.png"] and found("tag:red-cart") == []


def test_look_alikes(spark):
    rows = [(i, f"/p/{n}", n, "image", 20_000 + i, 100 + i, h) for i, (n, h) in enumerate([("a.png", "h1"), ("b.png", "h2"), ("c.png", "h3"), ("a2.png", "h1"), ("d.mp4", "h4"), ("e.mp4", "h5"), ("f.mp4", "h6")])]
    files = spark.createDataFrame(rows, "id long, path string, name string, kind string, size long, mtime long, hash string")
    prints = spark.createDataFrame([("h1", "p", 0b0, None), ("h2", "p", 0b11, None), ("h3", "p", -1, None), ("h4", "v", 1, 100.0), ("h5", "v", 1, 101.5), ("h6", "v", 1, 140.0)], "hash string, algo string, bits long, duration double")
    groups = D.groups_of(D.look_alikes(files, prints, 8), "looks").collect()
    assert sorted((r["n"], r["first"]["name"]) for r in groups) == [(2, "d.mp4"), (3, "a.png")]
    near = [(r["name"], r["distance"]) for r in D.similar_files(files, prints, "/p/a.png", 8).collect()]
    assert near == [("a2.png", 0), ("b.png", 2)]
    shown = D.flattened({"looks": D.look_alikes(files, prints, 8)}, 1).collect()
    assert [r["caption"] for r in shown] == ["Look alike · 3 files · 39.1 KB spare", "Looks like a.png", "Looks like a.png"]


def test_processors_and_plugins(spark, tmp_path):
    files = spark.createDataFrame([("h1", "/a.png", "image"), ("h1", "/b.png", "image"), ("h2", "/c.png", "image"), ("h3", "/d.md", "doc")], "hash string, path string, kind string")

    def work(job):
        if job["hash"] == "h2":
            raise ValueError("cannot")
        return {"text": "a leek", "tags": [" Leek ", "leek", "food"]}

    own = Processor("describe", 1, ("image",), work)
    got = process(files, own)
    assert sorted((r["hash"], tuple(r["tags"]), r["error"]) for r in got.collect()) == [("h1", ("leek", "food"), None), ("h2", (), "cannot")]
    assert process(files, own, got).count() == 0
    program = tmp_path / "echo.py"
    program.write_text("import json, sys, time\nfor line in sys.stdin:\n    job = json.loads(line)\n    if job['hash'] == 'h2':\n        time.sleep(5)\n    print(json.dumps({'text': job['path'].upper()}), flush=True)\n")
    outside = process(files.coalesce(1), Processor("echo", 1, ("image",), External([sys.executable, str(program)], 2.0)))
    assert sorted((r["hash"], r["text"], r["error"]) for r in outside.collect()) == [("h1", "/A.PNG", None), ("h2", None, "no answer in 2 s")]
    model = Embedder("kitchen", kitchen)
    texts = spark.createDataFrame([("h1", "leek " * 400), ("h2", None)], "hash string, text string")
    assert embed(texts, model).count() == 2 and embed(texts, model, embed(texts, model)).count() == 0
    register_query_plugin(spark, "echo", lambda q, s: [{"title": q * s.get("n", 1)}])
    assert spark.sql("select title from echo('ab', '{\"n\": 2}')").first()[0] == "abab"


def test_capped_debounce(spark):
    rows = [("a", t) for t in (0, 5, 9, 13, 40)] + [("b", 3)]
    events = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    got = sorted(map(tuple, capped_batches(events, "k", 6, 12).collect()))
    assert got == [("a", 0, 12, 3), ("a", 13, 19, 1), ("a", 40, 46, 1), ("b", 3, 9, 1)]


def test_quiet_batches_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    from quern.streaming.debounce import quiet_batches

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    run = quiet_batches(stream, 300, "event_type").writeStream.format("memory").queryName("quiet").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    want = set(map(tuple, quiet_batches(events, 300, "event_type").collect()))
    got = set(map(tuple, spark.table("quiet").collect()))
    assert got <= want and len(want - got) <= 3  # the last batches are still open
