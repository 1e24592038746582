"""Labels of contents, learnt from descriptions or from tagged examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import dot

AHEAD_BY, MARGIN, MIN_EXAMPLES = 0.03, 0.15, 2
# The labels that files get unless others are given, with what each means.
DEFAULT_LABELS = {
    "receipt": "a receipt: proof of purchase from a shop or restaurant, listing items, prices and a total paid",
    "invoice": "an invoice or bill asking for payment, with an amount due and a due date",
    "bank-statement": "a bank or credit card statement listing transactions and balances",
    "contract": "a contract, lease or agreement between parties, with terms and signatures",
    "payslip": "a payslip or pay stub with salary, deductions and net pay",
    "tax": "a tax return, tax form or tax assessment",
    "id-document": "an identity document like a passport, a national ID card or a residence permit, with a photo, a date of birth and a document number",
    "ticket": "a ticket or booking for a flight, train, hotel or event",
    "medical": "a medical record, prescription, test result or doctor's note",
    "manual": "a user manual, instructions or a guide for a product",
    "screenshot": "a screenshot of a computer or phone screen",
}


def by_description(vectors: DataFrame, labels: dict[str, list[float]], cutoff: float) -> DataFrame:
    """(hash, label, score): the label whose description is nearest to a content's three best chunks,
    if near enough and ahead of the next. Labels are configuration; each chunk is scored in place."""
    scored = F.array(*(F.struct(F.lit(name).alias("label"), dot(F.col("vector"), F.array(*map(F.lit, v))).alias("d")) for name, v in sorted(labels.items())))
    each = vectors.select("hash", F.explode(scored).alias("s")).select("hash", "s.label", "s.d")
    best = Window.partitionBy("hash", "label").orderBy(F.desc("d"))
    mean = each.withColumn("i", F.row_number().over(best)).where("i <= 3").groupBy("hash", "label").agg(F.avg("d").alias("score"))
    by = Window.partitionBy("hash").orderBy(F.desc("score"), "label")
    ranked = mean.withColumn("i", F.row_number().over(by)).withColumn("next", F.lead("score").over(by))
    return ranked.where((F.col("i") == 1) & (F.col("score") >= cutoff) & (F.col("next").isNull() | (F.col("score") - F.col("next") >= AHEAD_BY))).select("hash", "label", "score")


def _unit(df: DataFrame, key: str) -> DataFrame:
    """(key, vector): the direction of the sum of a key's vectors, summed place by place."""
    sums = df.select(key, F.posexplode("vector").alias("i", "x")).groupBy(key, "i").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = sums.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    size = F.sqrt(dot(F.col("v"), F.col("v")))
    return whole.select(key, F.transform("v", lambda x: x / size).alias("vector"))


def by_example(vectors: DataFrame, tags: DataFrame, least: float, most_tags: int = 10_000) -> DataFrame:
    """(hash, label, score): contents as near to a hand-given tag's centre as its farthest example."""
    means = _unit(vectors, "hash")
    examples = tags.where("source = 'manual'").select("hash", F.col("tag").alias("label")).join(means, "hash")
    enough = examples.groupBy("label").count().where(F.col("count") >= MIN_EXAMPLES).select("label")
    examples = examples.join(enough, "label", "left_semi")
    centres = _unit(examples.select("label", "vector"), "label").withColumnRenamed("vector", "centre")
    radius = examples.join(centres, "label").groupBy("label").agg(F.min(dot(F.col("vector"), F.col("centre"))).alias("radius"))
    # Tags given by hand are a person's, a row each; beyond a bound they are refused, not broadcast.
    around = centres.join(radius, "label")
    if around.limit(most_tags + 1).count() > most_tags:
        raise ValueError(f"over {most_tags} tags have examples")
    table = F.collect_list(F.struct("label", "centre", "radius"))
    near = means.crossJoin(F.broadcast(around.agg(table.alias("tags"))))
    scored = F.transform("tags", lambda t: F.struct(t["label"].alias("label"), dot(F.col("vector"), t["centre"]).alias("score"), t["radius"].alias("radius")))
    near = near.select("hash", F.explode(F.filter(scored, lambda t: t["score"] >= F.greatest(t["radius"], F.lit(least)) - 1e-12)).alias("t"))
    return near.select("hash", "t.label", "t.score")
