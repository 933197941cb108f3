"""Model serving at the edge: prompts in, texts out, in Arrow batches on the executors.

Failures are a status, never a text; answers are joined by key, never by position. `respond` asks within a plan,
`respond_once` keeps a ledger of what was answered, so that nothing is asked twice.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


class Responder(Protocol):
    def __call__(self, prompt: str) -> str: ...


@dataclass(frozen=True)
class Echo:
    """A deterministic stand-in for tests."""

    prefix: str = "Answer: "

    def __call__(self, prompt: str) -> str:
        return self.prefix + prompt[-40:]


@dataclass(frozen=True)
class ChatEndpoint:
    """A chat-completions endpoint over HTTP."""

    url: str
    model: str
    key: str = "EMPTY"
    temperature: float = 0.0
    max_tokens: int = 1024
    timeout: float = 3600.0
    extra: Mapping[str, object] = field(default_factory=dict)

    def __call__(self, prompt: str) -> str:
        from urllib.request import Request, urlopen

        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": self.temperature, "max_tokens": self.max_tokens, "stream": False, **self.extra}
        head = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        with urlopen(Request(self.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), head), timeout=self.timeout) as r:
            return json.loads(r.read())["choices"][0]["message"]["content"]


def endpoint(registry: Mapping[str, Mapping[str, object]], model: str, port: int | None = None, think_tokens: Mapping[str, int] | None = None, **options) -> ChatEndpoint:
    """A model's endpoint from a registry {model: {url, key}}; port replaces the URL's, think_tokens its length."""
    import re

    entry = registry[model]
    url = str(entry["url"])
    if port:
        url = re.sub(r":\d+(?=/|$)", f":{port}", url, count=1)
    return ChatEndpoint(url, model, str(entry.get("key", "EMPTY")), max_tokens=(think_tokens or {}).get(model, 1024), **options)


def replicas(prompts: DataFrame, samples: int) -> DataFrame:
    """Each prompt samples times, with sample_id from 0."""
    return prompts.withColumn("sample_id", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def respond(prompts: DataFrame, responder: Responder, prompt_col: str = "prompt", tasks: int | None = None, threads: int = 16) -> DataFrame:
    """prompts with text and status ("ok" or the error). tasks and threads bound the requests under way."""
    rows = prompts.repartition(tasks) if tasks else prompts
    schema = StructType([*rows.schema.fields, StructField("text", StringType()), StructField("status", StringType())])

    def one(prompt: str) -> tuple[str | None, str]:
        try:
            return responder(prompt), "ok"
        except Exception as e:  # what the service raises is data here
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                got = list(pool.map(one, b[prompt_col]))
                yield b.assign(text=[t for t, _ in got], status=[s for _, s in got])

    return rows.mapInPandas(run, schema)


def _entries(fs, folder: str, start: str) -> list:
    from pyarrow.fs import FileSelector

    found = fs.get_file_info(FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith(start) and f.base_name.endswith(".parquet"))


def _answered(spark: SparkSession, ledger: str, keys: Sequence[str], schema: StructType) -> DataFrame:
    """What the ledger holds, a row an answer; empty where there is none yet."""
    from .json_io import exists

    if not exists(spark, ledger):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(ledger)


def respond_once(
    prompts: DataFrame, responder: Responder, ledger: str, keys: Sequence[str], prompt_col: str = "prompt", rounds: int = 3, tasks: int = 8, batch: int = 32, threads: int = 16,
) -> DataFrame:
    """prompts with text and status, asking for each key until it is answered, in `rounds` rounds at most.

    ledger: a folder that driver and executors share. A task writes each batch of answers to it as soon as it has them;
    a task that is run again first reads what its earlier attempt wrote, so a lost executor costs at most the batch
    under way. Later rounds, and later calls with the same ledger, ask only for keys without an answer. Keys may
    not be null and not repeat; failed keys come back with the error of their last round.
    """
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSystem

    spark = prompts.sparkSession
    kinds = [prompts.schema[k] for k in keys]
    schema = StructType([*kinds, StructField("text", StringType()), StructField("status", StringType())])
    if prompts.groupBy(*keys).count().where("count > 1").limit(1).collect():
        raise ValueError("repeated keys")

    def one(prompt: str) -> tuple[str | None, str]:
        try:
            return responder(prompt), "ok"
        except Exception as e:  # what the service raises is data here
            return None, f"{type(e).__name__}: {e}"

    def asking(folder_uri: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            part = TaskContext.get().partitionId()
            fs, folder = FileSystem.from_uri(folder_uri)
            fs.create_dir(folder)
            before = _entries(fs, folder, f"{part:06d}-")
            done = {tuple(r.values()) for f in before for r in pq.read_table(f, columns=list(keys), filesystem=fs).to_pylist()}
            n, count = len(before), 0
            with ThreadPoolExecutor(threads) as pool:
                for b in batches:
                    left = b[[tuple(k) not in done for k in b[list(keys)].astype(object).itertuples(index=False, name=None)]] if done else b
                    for lo in range(0, len(left), batch):
                        piece = left.iloc[lo : lo + batch]
                        got = list(pool.map(one, piece[prompt_col]))
                        answers = piece[list(keys)].assign(text=[t for t, _ in got], status=[s for _, s in got])
                        table = pa.Table.from_pandas(answers, preserve_index=False)
                        name = f"{folder}/{part:06d}-{n:06d}"
                        pq.write_table(table.cast(pa.schema([f if f.name not in ("text", "status") else pa.field(f.name, pa.string()) for f in table.schema])), name, filesystem=fs)
                        fs.move(name, f"{name}.parquet")  # whole or not there
                        n, count = n + 1, count + len(piece)
            yield pd.DataFrame({"n": [count]})

        return run

    for i in range(rounds):
        known = _answered(spark, ledger, keys, schema).where("status = 'ok'").select(*keys).distinct()
        todo = prompts.select(*keys, prompt_col).join(known, list(keys), "left_anti").repartition(tasks, *keys)
        asked = todo.mapInPandas(asking(f"{ledger}/round-{i}-{uuid.uuid4().hex[:8]}"), "n long").agg(F.sum("n")).first()[0]
        if not asked:
            break
    last = F.max_by(F.struct("text", "status"), F.struct((F.col("status") == "ok").cast("int"), "_at")).alias("a")
    answers = _answered(spark, ledger, keys, schema).withColumn("_at", F.col("_metadata.file_modification_time")).groupBy(*keys).agg(last).select(*keys, "a.*")
    return prompts.join(answers, list(keys), "left")
