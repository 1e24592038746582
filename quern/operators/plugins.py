"""Extension points: embedders, file processors and query plug-ins, with their registries."""

from __future__ import annotations

import json
import subprocess
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ITEMS, MOST_TAGS = 50, 20


@dataclass(frozen=True)
class Embedder:
    """Vectors of texts; ``passages`` takes a list of texts and returns as many unit vectors."""

    id: str
    passages: Callable[[list[str]], list[list[float]]]
    min_score: float = 0.3
    is_local: bool = True

    def query(self, text: str) -> list[float]:
        return self.passages([text])[0]


@dataclass(frozen=True)
class Processor:
    """What a file says beyond its text; ``process`` takes a job and returns an output, both dicts."""

    id: str
    version: int
    kinds: tuple[str, ...]
    process: Callable[[dict], dict]
    is_local: bool = True


@dataclass
class Registry:
    embedders: dict[str, Embedder] = field(default_factory=dict)
    processors: dict[str, Processor] = field(default_factory=dict)

    def add(self, part: Embedder | Processor) -> None:
        (self.embedders if isinstance(part, Embedder) else self.processors)[part.id] = part


def embed(texts: DataFrame, embedder: Embedder, done: DataFrame | None = None, batch: int = 64) -> DataFrame:
    """(model, hash, chunk, start, end, vector) of contents (hash, text, perhaps kind) that the model has
    not seen. Later chunks of a sheet are read under its header row."""
    from quern.functions.passages import chunks

    if done is not None:
        texts = texts.join(done.where(F.col("model") == embedder.id).select("hash").distinct(), "hash", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, text, kind in zip(*(b.column(i).to_pylist() for i in range(3))):
                raw = text.encode("utf-8", "surrogatepass")
                head = text.partition("\n")[0].rstrip("\r") + "\n" if kind == "sheet" else ""
                rows += [(h, i, s, e, (head if s else "") + raw[s:e].decode("utf-8", "replace").strip()) for i, (s, e) in enumerate(chunks(text))]
            vectors = [v for i in range(0, len(rows), batch) for v in embedder.passages([r[4] for r in rows[i : i + batch]])]
            columns = [[embedder.id] * len(rows), *([r[k] for r in rows] for k in range(4)), vectors]
            kinds = [pa.string(), b.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["model", "hash", "chunk", "start", "end", "vector"])

    kinds = F.col("kind") if "kind" in texts.columns else F.lit(None).cast("string")
    own = texts.where("text is not null").select("hash", "text", kinds.alias("kind")).dropDuplicates(["hash"])
    kind = own.schema["hash"].dataType.simpleString()
    return own.mapInArrow(run, f"model string, hash {kind}, chunk int, start int, end int, vector array<float>")


def cleaned(values: list[str]) -> list[str]:
    return list(dict.fromkeys(v.strip().lower() for v in values if v.strip()))[:MOST_TAGS]


def process(files: DataFrame, processor: Processor, done: DataFrame | None = None) -> DataFrame:
    """(hash, processor, version, text, tags, labels, algo, bits, duration, error): one row a content of
    the processor's kinds that this version has not seen. A failure is that content's own row, not the
    job's; it is kept, so that it is not tried on every run."""
    todo = files.where(F.col("kind").isin(list(processor.kinds)) & F.col("hash").isNotNull())
    if done is not None:
        seen = done.where((F.col("processor") == processor.id) & (F.col("version") == processor.version)).select("hash")
        todo = todo.join(seen.distinct(), "hash", "left_anti")
    todo = todo.groupBy("hash").agg(F.min("path").alias("path"), F.min("kind").alias("kind"))
    names = ["hash", "processor", "version", "text", "tags", "labels", "algo", "bits", "duration", "error"]
    strings = pa.list_(pa.string())
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), strings, strings, pa.string(), pa.int64(), pa.float64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for job in b.to_pylist():
                try:
                    said = processor.process(job)
                    out.append((said.get("text"), cleaned(said.get("tags", [])), cleaned(said.get("labels", [])), said.get("algo"), said.get("bits"), said.get("duration"), said.get("error")))
                except Exception as e:
                    out.append((None, [], [], None, None, None, str(e) or type(e).__name__))
            columns = [b.column(0), [processor.id] * len(out), [processor.version] * len(out), *([r[k] for r in out] for k in range(7))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    return todo.select("hash", "path", "kind").mapInArrow(run, "hash string, processor string, version int, text string, tags array<string>, labels array<string>, algo string, bits long, duration double, error string")


class External:
    """A processor's ``process`` by a program that reads a JSON line a job and answers with one.

    The program stays for a worker's jobs; it is started again after it failed, died or took too long.
    """

    def __init__(self, command: list[str], seconds: float = 300.0):
        self.command, self.seconds, self.child = command, seconds, None

    def __getstate__(self):
        return self.command, self.seconds

    def __setstate__(self, state):
        self.__init__(*state)

    def stop(self) -> None:
        if self.child:
            self.child.kill()
            self.child.wait()
            self.child.stdin.close()
            self.child.stdout.close()
            self.child = None

    def __call__(self, job: dict) -> dict:
        if not self.child or self.child.poll() is not None:
            self.stop()
            self.child = subprocess.Popen(self.command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True, bufsize=1)
        late = threading.Timer(self.seconds, self.child.kill)
        late.start()
        try:
            self.child.stdin.write(json.dumps(job) + "\n")
            self.child.stdin.flush()
            answer = json.loads(self.child.stdout.readline() or "null")
            if not isinstance(answer, dict):
                raise RuntimeError("no answer" if late.is_alive() else f"no answer in {self.seconds:g} s")
            return answer
        except Exception:
            self.stop()
            raise
        finally:
            late.cancel()


def register_query_plugin(spark: SparkSession, name: str, answer: Callable[[str, dict], list[dict]]) -> None:
    """A table function ``name(query, settings as JSON)`` of title, subtitle, action and error."""

    class Plugin:
        def eval(self, query: str, settings: str):
            try:
                for item in answer(query, json.loads(settings or "{}"))[:MOST_ITEMS]:
                    yield item["title"], item.get("subtitle"), json.dumps(item.get("action")), None
            except Exception as e:  # the answer says what went wrong
                yield None, None, None, str(e) or type(e).__name__

    spark.udtf.register(name, F.udtf(Plugin, returnType="title string, subtitle string, action string, error string"))
