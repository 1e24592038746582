import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r, n, words="the of and to in is that for it with as was on be at by this from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()):
    return " ".join(r.choice(words) for _ in range(n))


def documents(spark, extra=()):
    """Nulls in every column, empty, blank and very long texts, copies, repeated rows, odd characters."""
    r = random.Random(5)
    base = prose(r, 120)
    words = base.split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [
        (1, base, "en", "a", 1), (2, base, "en", "a", 1), (3, near, "en", "b", 1), (4, near.upper(), "en", None, 1), (5, None, None, None, None),
        (6, "", "en", "a", 0), (7, " \n\t ", "en", "b", 3), (8, "one two", "en", "b", 7), (9, "one two", "en", "c", 7), (10, "x" * 5000, "en", "c", 1),
        (11, prose(r, 20_000), "en", "c", 1), (12, "日本語 テキスト é ß <|endoftext|> ▁", "ja", "é", 1), (13, prose(r, 40) + "\n\n" + prose(r, 40), "en", "c", 1),
        (None, prose(r, 50), "en", "a", 1), (14, prose(r, 60), "en", "a", 1), (14, prose(r, 60), "en", "a", 1), (15, "a a a a a b a a a a a b", "en", "a", 1), (15, "a a a a a b a a a a a b", "en", "a", 1),
        *extra,
    ]
    return spark.createDataFrame(rows, DOCUMENTS), rows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
