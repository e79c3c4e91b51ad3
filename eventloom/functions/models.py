"""Pluggable models: embedders, language models, entity finders. The defaults are deterministic and need no network."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.functions.durable import durable

Embedder = Callable[[list[str]], np.ndarray]
Client = Callable[[list[dict], dict], str]


def hashing_embedder(width: int = 64) -> Embedder:
    """Signed word hashing, the default where no model is installed."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), dtype=np.float32)
        for i, text in enumerate(texts):
            for word in text.split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                out[i, h % width] += 1 if h >> 63 else -1
        return out

    return embed


def stub_client(message: list[dict], parameters: dict) -> str:
    """Answers every prompt alike, so that pipelines can be run and tested offline."""
    return "None"


@dataclass
class Registry:
    """Named makers of models; a model is made once in each worker process."""

    embedders: dict[str, Callable[[], Embedder]] = field(default_factory=lambda: {"hashing": hashing_embedder})
    clients: dict[str, Callable[[], Client]] = field(default_factory=lambda: {"stub": lambda: stub_client})

    def embedder(self, name: str) -> Callable[[], Embedder]:
        if name not in self.embedders:
            raise ValueError(f"no embedder named {name!r}")
        return self.embedders[name]

    def client(self, name: str) -> Callable[[], Client]:
        """The maker of the client; an unknown name is a KeyError."""
        return self.clients[name]


def embed(text: Column, make: Callable[[], Embedder]) -> Column:
    """Vectors of cleaned texts in Arrow batches; null and empty texts have a null vector."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in batches:
            at = [i for i, x in enumerate(s) if isinstance(x, str) and x]
            out: list = [None] * len(s)
            for i, v in zip(at, model([s.iloc[i] for i in at]) if at else [], strict=True):
                out[i] = v
            yield pd.Series(out, index=s.index, dtype=object)

    return run(text)


def remote_embedder(call: Callable[[str], list[float]], width: int, most: int = 50_000, workers: int = 20, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Embedder:
    """An embedder around a service that takes one text: texts cut to ``most`` characters as the service asks, ``workers`` at
    a time, each tried ``tries`` times; empty texts are zeros, and vectors come back in order of the texts."""

    def one(text: str) -> list[float]:
        return retry(lambda: call(text[:most]), tries, sleep=sleep) if text else [0.0] * width

    def embed_all(texts: list[str]) -> np.ndarray:
        with ThreadPoolExecutor(workers) as pool:
            return np.array(list(pool.map(one, texts)), dtype=np.float32).reshape(len(texts), width)

    return embed_all


def embed_cached(rows: DataFrame, text: str, vector: str, make: Callable[[], Embedder], path: str) -> DataFrame:
    """rows with the vector of each text, read through a table of vectors by digest at ``path``: texts that it lacks are
    embedded once and added. Null texts have a null vector."""
    spark, kind = rows.sparkSession, "digest string, vector array<float>"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    known = spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)
    wanted = rows.select(F.sha2(text, 256).alias("digest"), F.col(text).alias("t")).where("t is not null").dropDuplicates(["digest"])
    new = wanted.join(known.select("digest"), "digest", "left_anti").select("digest", embed(F.col("t"), make).alias("vector"))
    durable(new).write.mode("append").parquet(path)
    held = spark.read.schema(kind).parquet(path).dropDuplicates(["digest"]).withColumnRenamed("vector", vector)
    return rows.withColumn("digest__", F.sha2(text, 256)).join(held, F.col("digest__") == F.col("digest"), "left").drop("digest__", "digest")


def embed_distinct(rows: DataFrame, text: str, vector: str, make: Callable[[], Embedder]) -> DataFrame:
    """rows with the vector of each text, every distinct text embedded once."""
    key = F.sha2(text, 256)
    known = rows.select(key.alias("__k"), F.col(text).alias("__t")).dropDuplicates(["__k"]).select("__k", embed(F.col("__t"), make).alias(vector))
    return rows.withColumn("__k", key).join(known, "__k", "left").drop("__k")


def retry(call: Callable[[], str], tries: int = 5, first: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; after a failure waits twice as long as before, with jitter, and gives up after ``tries``."""
    wait = first
    for attempt in range(tries):
        try:
            return call()
        except Exception:
            if attempt == tries - 1:
                raise
            sleep(wait + random.random() * 0.1)
            wait = min(most, 2 * wait)
    raise ValueError("tries must be positive")


def ask(prompts: DataFrame, prompt: str, answer: str, make: Callable[[], Client], parameters: dict | None = None, workers: int = 10, tries: int = 3, failed: str | None = None, accept: Callable[[str], bool] | None = None, system: str = "") -> DataFrame:
    """prompts with the model's answers, ``workers`` calls at a time in each task.

    An answer that ``accept`` turns down counts as a failure; a call that keeps failing gives ``failed``.
    """
    schema = T.StructType([*prompts.schema.fields, T.StructField(answer, T.StringType())])
    own = dict(parameters or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()

        def call(text: str) -> str:
            if not text:
                raise ValueError("empty prompt")
            told = [{"role": "system", "content": system}] if system else []
            answered = client([*told, {"role": "user", "content": text}], own)
            if accept and not accept(answered):
                raise ValueError("an answer that cannot be read")
            return answered

        def one(text: str) -> str | None:
            try:
                return retry(lambda: call(text), tries)
            except Exception:
                return failed

        with ThreadPoolExecutor(workers) as pool:
            for frame in batches:
                yield frame.assign(**{answer: list(pool.map(one, frame[prompt]))})

    return prompts.mapInPandas(run, schema)


def chat_messages(messages: Column) -> Column:
    """struct(system, turns): system text apart from the rest, unknown roles read as user."""
    known = F.transform(F.filter(messages, lambda m: m.role != "system"), lambda m: F.struct(F.when(m.role.isin("user", "assistant"), m.role).otherwise("user").alias("role"), m.content.alias("content")))
    system = F.array_join(F.transform(F.filter(messages, lambda m: m.role == "system"), lambda m: m.content), "\n")
    return F.struct(system.alias("system"), known.alias("turns"))


_CAPITALS = re.compile(r"\b(?:[A-ZÄÖÜÀ-Ý][\w'-]+)(?:\s+[A-ZÄÖÜÀ-Ý][\w'-]+)*")


def capital_entities(text: str) -> list[str]:
    """Runs of capitalised words, the default entity finder."""
    return _CAPITALS.findall(text or "")
