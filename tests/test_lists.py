import json
import os
import sqlite3
import sys
import time
from datetime import datetime
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import calculator as K
from quern.functions import clock as C
from quern.functions import fingerprint as P
from quern.operators import bundled as B
from quern.operators import meaning as M
from quern.operators import providers as L
from quern.operators.plugins import Embedder
from quern.operators.settings import Setting, resolved
from quern.plans.lang import Term
from quern.sources import files as S
from quern.sources import readers as R
from quern.streaming import watch as W
from quern.streaming.debounce import capped_batches, quiet_batches, quiet_runs


def test_sums_units_and_money():
    rates = {"USD": 1.0, "EUR": 0.5, "JPY": 150.0}
    told = {q: K.calculate(q, rates, "EUR") for q in ("3*(4+5)", "12 km to m", "2 lb in kg", "212 f to c", "40 usd", "8 eur to jpy", "2024-05-06", "7 mb", "12", "5 km to kg", "1 + 1 kg in g")}
    assert told == {"3*(4+5)": "27", "12 km to m": "12000 m", "2 lb in kg": "0.90718474 kg", "212 f to c": "100 c", "40 usd": "20.00 EUR", "8 eur to jpy": "2,400 JPY", "2024-05-06": None, "7 mb": None, "12": None, "5 km to kg": None, "1 + 1 kg in g": "2000 g"}
    assert K.arithmetic("-2^2") == -4 and K.arithmetic("2 apples") is None and K.arithmetic("1/0") is None
    assert K.home_currency("fr_FR.UTF-8", []) == "EUR" and K.home_currency("en-GB", ["GBP", "USD"]) == "GBP" and K.home_currency("C", []) == "USD"
    assert K.grouped(-1234567.891, 2) == "-1,234,567.89" and K.grouped(-0.001, 2) == "0.00"
    assert K.names_a_target("3 kg -> lb") and not K.names_a_target("3 kg")


def test_times_and_dates():
    now = datetime(2024, 3, 6, 18, 20, tzinfo=ZoneInfo("Europe/Paris"))
    answer = lambda q: C.answer(q, now)
    assert answer("time in osaka") == ("02:20 Thu 7 Mar · Osaka", "UTC+9 · 8 hours ahead of you") == answer("OSAKA time")
    assert answer("noon utc in kolkata") == ("17:30 Wed 6 Mar · Kolkata", "UTC+5:30 · 5.5 hours ahead of UTC")
    assert answer("7:45 pm nyc") == ("01:45 Thu 7 Mar", "UTC+1 · 6 hours ahead of NYC") and answer("9am in utc")[0] == "08:00 Wed 6 Mar · UTC"
    assert answer("25:00 utc in pst") is None and answer("9 lima") is None and answer("9am nowhere") is None
    assert answer("2024-01-31 + 1 month - 2 days") == ("Tue 27 Feb 2024", "8 days ago") and answer("tomorrow+1 week")[0] == "Thu 14 Mar 2024"
    assert answer("days since 2024-03-01") == ("5 days", "Fri 1 Mar 2024 to Wed 6 Mar 2024") and answer("yesterday - today")[0] == "-1 day"
    assert answer("days until 2024-02-20")[0] == "-15 days" and answer("days until 2024-02-20")[1].endswith(" · 2 weeks and 1 day")
    assert answer("seed list") is None and C.offset_text(-16_200) == "UTC-4:30"


def test_settings():
    own = [Setting("limit", "number", 5, 1, 9), Setting("first", "choice", "a", options=("a", "b")), Setting("on", "toggle", True), Setting("name", "text", "x")]
    values, problems = resolved(own, {"limit": 12, "first": "b", "on": 1, "other": 2})
    assert values == {"limit": 5, "first": "b", "on": True, "name": "x"} and len(problems) == 3
    assert resolved(own, {"limit": 0})[0]["limit"] == 5 and resolved(own, {"first": "c"})[1] and not resolved(own, {"limit": 9, "name": "y"})[1]


def test_queries_of_lists(spark):
    assert L.after_keyword("g  leeks", "g") == "leeks" and L.after_keyword("go", "g") is None and not L.long_enough(" a ") and L.long_enough("a b")
    titles = lambda q: [(r["title"], r["fills"]) for r in L.commands(spark, q).collect()]
    assert titles("s") == [] and titles("s now") == [] and sorted(titles("turn off")) == [("Shut down", "shut down now")]
    assert titles("shut down now") == [("Shut down", None)] and titles("lock") == [("Lock", None)]
    rows = [("Garden Planner", ["Beds;Soil"]), ("Old Planner", []), ("Goat Pens", ["plant"]), ("Soil", [])]
    apps = spark.createDataFrame(rows, "name string, other_names array<string>")
    rank = lambda q: [(r["name"], r["rank"]) for r in L.apps(apps, q).collect()]
    assert rank("gp") == [("Goat Pens", 2), ("Garden Planner", 2)] and rank("plan") == [("Old Planner", 1), ("Garden Planner", 1), ("Goat Pens", 3)]
    assert rank("soil") == [("Soil", 0), ("Garden Planner", 3)] and rank("g") == [] and rank("pl ga") == [("Garden Planner", 1)]


def test_process_tree(spark):
    rows = [(1, None, "systemd", 1.0, 10**9), (2, 1, "shell", 0.0, 10**6), (3, 2, "editor", 9.0, 10**6), (4, 2, "idle", 0.0, 10**3), (5, 1, "server", 3.0, 10**9), (6, 5, "worker", 1.0, 10**6), (7, 5, "worker", 2.0, 10**6)]
    p = spark.createDataFrame(rows, "pid long, parent long, name string, cpu double, memory long")
    shown = [(r["depth"], r["name"], r["cpu"], r["below"]) for r in L.process_tree(p).collect()]
    assert shown == [(0, "shell", 9.0, 2), (1, "editor", 9.0, 0), (0, "server", 6.0, 2), (1, "worker", 2.0, 0), (1, "worker", 1.0, 0)]
    assert [r["name"] for r in L.process_tree(p, ["idle"]).collect()] == ["shell", "idle"]
    assert [r["pid"] for r in L.process_tree(p, ["7"]).collect()] == [5, 7]
    assert len(L.process_tree(p, None, 2).collect()) == 2


@pytest.fixture
def browser(tmp_path):
    folder = tmp_path / "browser"
    for d in ("One", "Two"):
        (folder / d).mkdir(parents=True)
    (folder / "Local State").write_text(json.dumps({"profile": {"info_cache": {"Two": {"name": "Work"}, "One": {"name": "Home"}, "Gone": {"name": "Gone"}}}}))
    tree = {"roots": {"bar": {"type": "folder", "children": [{"type": "url", "name": "Seeds", "url": "http://seeds.example"}, {"type": "folder", "children": [{"type": "url", "name": "Deep", "url": "http://deep.example"}]}]}, "other": {"children": [{"type": "url", "name": 3, "url": "x"}]}}}
    (folder / "One" / "Bookmarks").write_text(json.dumps(tree))
    (folder / "Two" / "Bookmarks").write_text("{broken")
    db = sqlite3.connect(folder / "One" / "History")
    db.execute("CREATE TABLE urls (url TEXT, title TEXT, visit_count INT, typed_count INT, last_visit_time INT, hidden INT)")
    db.execute("INSERT INTO urls VALUES ('http://compost.example', 'Compost', 3, 1, 9, 0), ('http://hidden.example', NULL, 1, 0, 1, 1)")
    db.commit()
    db.close()
    (folder / "Two" / "History").write_text("no database")
    return str(folder)


def test_browser_files(spark, browser):
    found = R.profiles(spark, "Mosaic", browser)
    assert [(r["profile"], r["folder"].rpartition("/")[2]) for r in found.collect()] == [("Home", "One"), ("Work", "Two")]
    assert [r["profile"] for r in R.profiles(spark, "Mosaic", browser + "/none").collect()] == []
    assert sorted((r["title"], r["url"]) for r in R.bookmarks(found).collect()) == [("Deep", "http://deep.example"), ("Seeds", "http://seeds.example")]
    assert sorted((r["title"], r["visit_count"], r["hidden"]) for r in R.history(found).collect() if r["title"]) == [("Compost", 3, False)]
    both = L.browsed(R.bookmarks(found), R.history(found), "example", 5).collect()
    assert [(r["title"], r["bookmark"]) for r in both] == [("Deep", True), ("Seeds", True), ("Compost", False)]


def test_desktop_entries_rates_and_manifests(spark, tmp_path):
    for d, text in (("mine", "[Desktop Entry]\nName=Rake\nExec=rake %u\nType=Application\nKeywords=soil;bed;\n[Other]\nName=No\n"), ("system", "[Desktop Entry]\nName=Old Rake\nExec=oldrake\nType=Application\n")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "rake.desktop").write_text(text)
    (tmp_path / "system" / "hoe.desktop").write_text("[Desktop Entry]\nName=Hoe\nExec=/usr/bin/flatpak run hoe\nType=Application\nNoDisplay=true\nTerminal=true\n")
    (tmp_path / "system" / "bad.desktop").write_text("Name=x")
    rows = L.shadowed(R.desktop_entries(spark, [str(tmp_path / "mine"), str(tmp_path / "system"), str(tmp_path / "none")])).collect()
    assert sorted((r["name"], r["other_names"], r["shown"], r["in_terminal"]) for r in rows) == [("Hoe (Flatpak)", [], False, True), ("Rake", ["soil", "bed"], True, False)]

    path = str(tmp_path / "deep" / "rates.json")
    R.save_aside(path, json.dumps({"result": "success", "time_last_update_unix": 5, "time_next_update_unix": 9, "rates": {"USD": 1, "EUR": 0.5}}))
    assert sorted((r["code"], r["rate"], r["next"]) for r in R.rates(spark, path).collect()) == [("EUR", 0.5, 9), ("USD", 1.0, 9)]
    assert R.is_due(9, 9) and not R.is_due(9, 8) and os.listdir(tmp_path / "deep") == ["rates.json"]
    R.save_aside(path, json.dumps({"result": "error", "error-type": "quota"}))
    with pytest.raises(ValueError, match="quota"):
        R.rates(spark, path)

    for name, text in (("good", 'name = "Good"\ncommand = ["x"]\n[[requires]]\nprogram = "no-such-tool"\nhelp = "Get it."\n'), ("mac", 'name = "Mac"\ncommand = ["x"]\nplatforms = ["macos"]\n'), ("empty", 'name = "E"\n'), ("work", 'name = "W"\n[process]\ncommand = ["y"]\nkinds = []\n')):
        (tmp_path / "plugins" / name).mkdir(parents=True)
        (tmp_path / "plugins" / name / "plugin.toml").write_text(text)
    good, bad = R.manifests(str(tmp_path / "plugins"), "linux")
    assert [m["id"] for m in good] == ["good"] and len(bad) == 2 and "no-such-tool" in R.missing(good[0])
    (tmp_path / "w.json").write_text(json.dumps([{"id": 1, "title": "t", "app": "a", "app_id": "i", "workspace": 0, "minimized": False}]))
    assert R.windows(spark, str(tmp_path / "w.json")).count() == 1 and R.copies(spark, str(tmp_path / "none.json")).count() == 0
    assert R.frame_times(50.0, 25)[:2] == [1.0, 3.0]


def test_rules_are_those_of_ignore_files(tmp_path):
    rules = S.Rules(["*.tmp", "!keep.tmp", "/out", "logs/", "a/**/z", "doc/*.txt", "b[0-9]?", "\\#x"])
    out = {p: rules.excludes(p, d) for p, d in (("x.tmp", False), ("d/keep.tmp", False), ("out", False), ("d/out", False), ("logs", True), ("logs", False), ("d/logs", True), ("a/z", False), ("a/b/c/z", True), ("doc/a.txt", False), ("d/doc/a.txt", False), ("b7q", False), ("b77q", False), ("#x", False))}
    assert out == {"x.tmp": True, "d/keep.tmp": False, "out": True, "d/out": False, "logs": True, "logs": False, "d/logs": True, "a/z": True, "a/b/c/z": True, "doc/a.txt": True, "d/doc/a.txt": False, "b7q": True, "b77q": False, "#x": True}
    assert S.rules_file(str(tmp_path / "r" / "ignore"))[0] == ".*/" and os.path.exists(tmp_path / "r" / "ignore")
    inner = S.Rules(["!x.tmp", "/own"], "sub", rules)
    assert not inner.excludes("sub/x.tmp", False) and inner.excludes("sub/y.tmp", False) and inner.excludes("sub/own", True) and not inner.excludes("sub/d/own", True)
    big = tmp_path / "big"
    big.write_bytes(b"a" * 10)
    assert S.content_hash(str(big)) == S.content_hash(str(big)) and S.content_hash(str(tmp_path / "none")) is None


def test_large_files_are_hashed_by_samples(tmp_path, monkeypatch):
    monkeypatch.setattr(S, "WHOLE", 100)
    monkeypatch.setattr(S, "SAMPLE", 10)
    a, b, c = (tmp_path / n for n in "abc")
    a.write_bytes(b"x" * 200)
    b.write_bytes(b"x" * 50 + b"y" + b"x" * 149)  # outside the samples
    c.write_bytes(b"x" * 100 + b"y" + b"x" * 99)
    assert S.content_hash(str(a)) == S.content_hash(str(b)) != S.content_hash(str(c))


def test_models():
    table = np.array([[1.0, 0.0], [0.0, 2.0], [9.0, 9.0]])
    run = M.static_model(table, lambda t: [ord(c) - 97 for c in t], unknown=2)
    assert np.allclose(run(["ab", "a", "c", "", "az"]), [[0.4472136, 0.8944272], [1, 0], [0, 0], [0, 0], [1, 0]], atol=1e-6)
    remote = M.remote_model(lambda part: [{"index": i, "embedding": [3.0 * (i + 1), 4.0 * (i + 1)]} for i in reversed(range(len(part)))], 2)
    assert np.allclose(remote(["a", "b", "c"]), [[0.6, 0.8]] * 3)
    with pytest.raises(ValueError):
        M.remote_model(lambda part: [])(["a"])
    assert M.wants_meaning([Term("red"), Term("beds")]) == "red beds" and M.wants_meaning([Term("red")]) is None
    assert M.wants_meaning([Term("花园")]) == "花园" and M.wants_meaning([Term("beds", True)]) is None


def test_fingerprints():
    r = np.random.default_rng(3)
    picture = r.integers(0, 256, (90, 120, 3))
    grey = P.grey_square(picture)
    assert grey.shape == (64, 64)
    n = np.arange(64)
    for k, j in ((0, 0), (3, 5), (7, 7)):
        want = (grey * np.cos(np.pi / 64 * (n + 0.5) * k)[:, None] * np.cos(np.pi / 64 * (n + 0.5) * j)[None, :]).sum()
        assert np.isclose(P.low_frequencies(grey)[8 * k + j], want)
    near = np.clip(picture + r.integers(-3, 4, picture.shape), 0, 255)
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert apart(P.fingerprint(picture), P.fingerprint(near)) < 8 < apart(P.fingerprint(picture), P.fingerprint(r.integers(0, 256, (64, 64, 3))))
    assert P.sprite([picture] * 25).shape == (600, 800, 3)
    with pytest.raises(ValueError):
        P.sprite([picture])


def test_quiet_runs_are_those_of_one_window(spark):
    r = np.random.default_rng(5)
    times = [int(t) for t in np.cumsum(r.choice([1, 3, 9, 40, 300], 400))] + [7, 7]
    events = spark.createDataFrame([(t,) for t in times], "s long").select(F.timestamp_seconds("s").alias("ts"))
    want = sorted(map(tuple, quiet_batches(events, 10).collect()))
    for span in (11, 100, 100_000):
        assert sorted(map(tuple, quiet_runs(events, 10, span).collect())) == want
    assert quiet_runs(events.limit(0), 10).count() == 0


def test_due_batches_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    rows = [(k, 1000 + t) for k, t in (("a", 0), ("b", 3), ("a", 5), ("a", 9), ("a", 13), ("a", 40), ("a", 41), ("c", 500))]
    for i, part in enumerate((rows[:4], rows[4:7], rows[7:])):  # micro-batches in time order
        spark.createDataFrame(part, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    read = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    run = W.due_batches(read.withWatermark("ts", "0 seconds"), "k", 6, 12).writeStream.format("memory").queryName("due").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted((r["key"], r["opened"].timestamp(), r["due"].timestamp(), r["events"]) for r in spark.table("due").collect())
    events = spark.createDataFrame(rows, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
    want = sorted((r["key"], float(r["opened"]), float(r["due"]), r["events"]) for r in capped_batches(events, "k", 6, 12).collect())
    assert got == [x for x in want if x[0] != "c"]  # the last is still open


def test_loops(spark, tmp_path):
    spark.createDataFrame([("p", 1, "le"), ("p", 3, "leek"), ("q", 2, "x")], "plugin string, seq long, query string").write.parquet(str(tmp_path / "queries"))
    asked, scans, kept = [], [], []
    stream = spark.readStream.schema("plugin string, seq long, query string").parquet(str(tmp_path / "queries"))
    W.answers(stream, lambda p, q: asked.append((p, q))).trigger(availableNow=True).start().awaitTermination()
    W.rescans(stream, lambda: scans.append(1)).trigger(availableNow=True).start().awaitTermination()
    assert sorted(asked) == [("p", "leek"), ("q", "x")] and scans == [1]
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (" ", 4)], "text string, copied long").write.parquet(str(tmp_path / "copies"))
    copied = spark.readStream.schema("text string, copied long").parquet(str(tmp_path / "copies"))
    W.recorder(copied, lambda: R.copies(spark, str(tmp_path / "none")), lambda rows: kept.extend(map(tuple, rows.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert kept == [("a", 3), ("b", 2)]

    def late():
        time.sleep(0.4)
        return ["late"]

    assert list(W.progressive({"files": lambda: ["f"], "slow": late, "none": list})) == [{"files": ["f"]}, {"slow": ["late"]}]


def test_learning_round():
    class Known:
        def __init__(self):
            self.calls = []

        def embed(self, e, private):
            self.calls.append("embed")
            return {"texts": 2}

        def process(self, p, private):
            self.calls.append(p)
            return {"done": 1}

        def learn_labels(self, e, labels):
            self.calls.append("labels")

    engine = Known()
    assert W.learn(engine, Embedder("e", list), ["p1", "p2"], {}) == {"embedded": 4, "processed": 2}
    assert engine.calls == ["embed", "p1", "p2", "embed", "labels"] and sys.version_info >= (3, 11)


def test_bundled_plugins(spark):
    import io

    apps = spark.createDataFrame([("Garden Planner", [""])], "name string, other_names array<string>")
    own = B.registry({"apps": apps})
    assert [x["title"] for x in own["apps"]("gard", {})] == ["Garden Planner"] and own["system"]("sleep", {}) == [{"title": "Sleep", "fills": None}]
    assert [x["subtitle"] for x in own["web-search"]("leek & soup", {"first": "github"})] == ["github.com", "google.com", "duckduckgo.com"]
    assert own["web-search"]("leek & soup", {})[0]["action"]["open"].endswith("q=leek+%26+soup") and own["web-search"]("", {})[0]["action"]["open"] == "https://google.com"
    now = datetime(2024, 3, 6, tzinfo=ZoneInfo("UTC"))
    assert own["calculator"]("6*7", {"now": now})[0]["title"] == "42" and own["calculator"]("today + 1 day", {"now": now})[0]["subtitle"] == "tomorrow" and own["calculator"]("leek", {"now": now}) == []
    out = io.StringIO()
    B.serve(own["calculator"], ['{"query": "2+3"}', "broken", '{"query": 5}'], out)
    told = [json.loads(x) for x in out.getvalue().splitlines()]
    assert told[0]["items"][0]["title"] == "5" and "error" in told[1] and "error" in told[2]
    assert sorted(B.registry({})) == ["calculator", "web-search"]


def test_saved_table(tmp_path):
    table = np.arange(6, dtype=np.float32).reshape(3, 2)
    header = json.dumps({"__metadata__": {}, "ids": {"dtype": "I64", "shape": [1], "data_offsets": [24, 32]}, "v": {"dtype": "F32", "shape": [3, 2], "data_offsets": [0, 24]}}).encode()
    (tmp_path / "m").write_bytes(len(header).to_bytes(8, "little") + header + table.tobytes() + b"\0" * 8)
    assert np.array_equal(M.saved_table(str(tmp_path / "m")), table)


def test_command_line(spark, tmp_path):
    from quern import cli
    from quern.engine import Engine

    home = tmp_path / "plot"
    (home / "beds").mkdir(parents=True)
    (home / "beds" / "leekRows.md").write_text("plant leeks in rows\nwater them")
    (home / "beds" / "leekRows copy.md").write_text("plant leeks in rows\nwater them twice")
    engine, said = Engine(spark), []
    go = lambda *argv: (said.clear(), cli.run(["--home", str(home), *argv], engine, said.append, int(time.time()) + 7200))[1]
    assert go("index") == 0 and said[0].startswith("3 files, 3 new")
    assert go("search", "leek", "ext:md") == 0 and said[0].splitlines()[0].startswith("doc     leekRows") and "~/beds  ·  2h · " in said[0]
    assert go("s", "water") == 0 and "water them" in said[0] and go("s", "rhubarb") == 0 and said == ["Nothing found."]
    assert go("tag", str(home / "beds" / "leekRows.md"), "+Spring Bed") == 0 and said == ["#spring-bed"]
    assert go("tag", str(home / "beds" / "leekRows.md"), "-spring-bed") == 0 and said == ["No tags."]
    assert go("dupes", "--names") == 0 and said[0].startswith("Same name · 2 files") and said[-1] == "1 groups, 30 B spare"
    assert go("search", "kind:vegetable") == 2 and "vegetable" in said[0]
    assert go("reindex", str(home / "beds")) == 0
