"""Vectors of texts and names: what is pending, what a search finds, what is forgotten."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.passages import passage
from quern.functions.text import name_passage
from quern.operators.search import NEAREST, best_of_group, nearest

# The least scores of models, the most bytes and tokens that a static model reads, and
# how many passages a remote one gets at once.
MIN_SCORES = {"multilingual": 0.30, "english": 0.25, "remote": 0.3}
MOST_BYTES, MOST_TOKENS, REMOTE_BATCH = 4096, 512, 64
MEANING = 3


def wants_meaning(terms) -> str | None:
    """The words to search by meaning, if they can carry one and none must match as written."""
    text = " ".join(t.text for t in terms)
    if any(t.exact or t.name_only for t in terms):
        return None
    return text if len(text) >= 4 or (len(text) >= 2 and not text.isascii()) else None


def static_model(rows, ids: Callable[[str], list[int]], unknown: int | None = None) -> Callable[[list[str]], list[list[float]]]:
    """Passages' vectors by a table with a row a token: the unit vector of the mean of a text's tokens."""
    import numpy as np

    table = np.asarray(rows, np.float32)

    def run(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), table.shape[1]), np.float32)
        for i, text in enumerate(texts):
            head = text.encode("utf-8", "surrogatepass")[:MOST_BYTES].decode("utf-8", "ignore")
            own = np.array(ids(head)[:MOST_TOKENS], np.int64)
            own = own[(own < len(table)) & (own != (-1 if unknown is None else unknown))]
            if len(own):
                out[i] = table[own].mean(axis=0)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(size > 0, size, 1)).tolist()

    return run


def saved_table(path: str):
    """The first two-dimensional table of 32-bit numbers in a file of named tensors: a length, a header in
    JSON, then the numbers. The file is mapped, not read."""
    import json

    import numpy as np

    with open(path, "rb") as f:
        n = int.from_bytes(f.read(8), "little")
        header = json.loads(f.read(n))
    told = next((t for k, t in sorted(header.items()) if k != "__metadata__" and t["dtype"] == "F32" and len(t["shape"]) == 2), None)
    if told is None:
        raise ValueError(f"{path} has no table of 32-bit numbers")
    return np.memmap(path, np.float32, "r", 8 + n + told["data_offsets"][0], tuple(told["shape"]))


def load_model(folder: str) -> Callable[[list[str]], list[list[float]]]:
    """The static model in a folder: its table of vectors and its tokenizer's file."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(f"{folder}/tokenizer.json")
    unknown = tokenizer.token_to_id("[UNK]")
    return static_model(saved_table(f"{folder}/model.safetensors"), lambda t: tokenizer.encode(t, add_special_tokens=False).ids, unknown)


def remote_model(ask: Callable[[list[str]], list[dict]], batch: int = REMOTE_BATCH) -> Callable[[list[str]], list[list[float]]]:
    """Passages' vectors by a service: ``ask`` sends up to ``batch`` texts and gives rows of index and
    embedding, in any order; vectors are brought to unit length."""

    def run(texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), batch):
            part = texts[i : i + batch]
            told = {int(r["index"]): r["embedding"] for r in ask(part)}
            if sorted(told) != list(range(len(part))):
                raise ValueError(f"asked for {len(part)} vectors, got {len(told)}")
            for j in range(len(part)):
                size = sum(x * x for x in told[j]) ** 0.5 or 1.0
                out.append([x / size for x in told[j]])
        return out

    return run


def passages(chunks: DataFrame) -> DataFrame:
    """``chunks`` (hash, chunk, start, end, text, kind), where text is the whole text, with passage: what
    a model reads of the chunk."""
    raw = F.encode("text", "UTF-8")
    own = F.decode(F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    header = F.regexp_replace(F.get(F.split("text", "\n"), F.lit(0)), "\r$", "")
    return chunks.withColumn("passage", passage(own, F.col("start"), F.col("kind"), header))


def name_vectors(files: DataFrame, embedder, done: DataFrame | None = None) -> DataFrame:
    """(model, name, vector) of names that the model has not seen; names without a word have none."""
    own = files.where(F.col("level") >= MEANING).select("name").distinct()
    if done is not None:
        own = own.join(done.where(F.col("model") == embedder.id).select("name"), "name", "left_anti")
    own = own.select("name", name_passage(F.col("name")).alias("words")).where("words <> ''")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = embedder.passages(b.column(1).to_pylist()) if b.num_rows else []
            columns = [pa.array([embedder.id] * b.num_rows, pa.string()), b.column(0), pa.array(vectors, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["model", "name", "vector"])

    return own.mapInArrow(run, "model string, name string, vector array<float>")


def pending_names(files: DataFrame, names: DataFrame, model: str) -> DataFrame:
    """(name) of files read for meaning that the model has no vector of."""
    done = names.where(F.col("model") == model).select("name")
    return files.where(F.col("level") >= MEANING).select("name").distinct().join(done, "name", "left_anti")


def pending_counts(files: DataFrame, texts: DataFrame, embedded: DataFrame, names: DataFrame, model: str, chunking: str = "lines-1") -> DataFrame:
    """(names, files): one row of how many names and contents the model has yet to see. ``texts`` is
    (hash, policy), ``embedded`` (model, hash, policy); a text with another policy than it was embedded
    with is pending again."""
    wanted = texts.join(files.where((F.col("level") >= MEANING) & F.col("hash").isNotNull()).select("hash").distinct(), "hash", "left_semi")
    done = embedded.where(F.col("model") == model).select("hash", "policy").distinct()
    left = wanted.withColumn("policy", F.concat(F.lit(chunking + "/"), "policy")).join(done, ["hash", "policy"], "left_anti")
    return pending_names(files, names, model).agg(F.count_distinct("name").alias("names")).crossJoin(left.agg(F.count("*").alias("files")))


def collected(vectors: DataFrame, embedded: DataFrame, names: DataFrame, texts: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, records and names after those of contents and files that are gone were forgotten."""
    known = texts.select("hash").distinct()
    left = [x.join(known, "hash", "left_semi") for x in (vectors, embedded)]
    return left[0], left[1], names.join(files.select("name").distinct(), "name", "left_semi")


def of_model(vectors: DataFrame, dims: int) -> DataFrame:
    """Vectors that a query of ``dims`` numbers can be compared with; others are of another version."""
    return vectors.where(F.size("vector") == dims)


def near_files(files: DataFrame, chunks: DataFrame, names: DataFrame, query: list[float], least: float, k: int = NEAREST) -> DataFrame:
    """Of ``files`` (filtered already), those whose chunk or name is among the ``k`` nearest vectors, with
    score, start and end of their best match (null where it is the name), best first.

    ``chunks`` is (hash, chunk, start, end, vector), ``names`` (name, vector); both are searched as one.
    The nearest are ``k`` rows at most, so they are broadcast.
    """
    one = chunks.select("hash", F.lit(None).cast("string").alias("name"), "start", "end", "vector", F.xxhash64("hash", "start").alias("vec_id"))
    two = names.select(F.lit(None).cast(chunks.schema["hash"].dataType).alias("hash"), "name", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"), "vector", F.xxhash64("name").alias("vec_id"))
    near = nearest(of_model(one.unionByName(two), len(query)), query, k, least).drop("vector")
    own = files.where(F.col("level") >= MEANING).select("id", "hash", "name")
    by_text = own.drop("name").join(F.broadcast(near.where("hash is not null").drop("name")), "hash").drop("hash")
    by_name = own.drop("hash").join(F.broadcast(near.where("name is not null").drop("hash")), "name").drop("name")
    best = best_of_group(by_text.unionByName(by_name), "id").select("id", "score", "start", "end")
    return best.orderBy(F.desc("score"), "id")


def unit(vector: Column) -> Column:
    """A vector at unit length; a zero vector stays as it is."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: F.when(size > 0, x / size).otherwise(x.cast("double")))


def mean(vectors: list[Column]) -> Column:
    """The mean of vectors of one length, place by place."""
    n = len(vectors)
    out = vectors[0]
    for v in vectors[1:]:
        out = F.zip_with(out, v, lambda x, y: x + y)
    return F.transform(out, lambda x: x / n)
