"""File sources and sinks: stages, gold tables, protocols, keyed caches, wide extraction tables."""

from __future__ import annotations

import hashlib
import json

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

c = F.col


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, bytes and sha256 of all files below a folder; equal contents once, the first path by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    hashed = files.select("path", c("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min("path").alias("path"), F.first("bytes").alias("bytes"))


def read_stage(spark: SparkSession, run: str, stage: str, schema: str | None = None) -> DataFrame:
    """One stage's JSON of every paper of a run (papers/<id>/<stage>.json), with the paper's id."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(f"{run}/papers/*/{stage}.json")
    return df.withColumn("paper_id", F.regexp_extract(F.input_file_name(), r"papers/([^/]+)/", 1))


def write_stage(df: DataFrame, run: str, stage: str) -> None:
    """Rows of a stage, a folder a paper; a repeated write replaces the papers it has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("paper_id").json(f"{run}/{stage}")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work items without a finished stage."""
    return work.join(done.select(*keys), keys, "left_anti")


def cached(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Requests that a content-addressed cache answers, and the misses; a null reply is a miss."""
    good = cache.where(c("reply").isNotNull())
    return requests.join(good, key), requests.join(good.select(key), key, "left_anti")


def append_log(df: DataFrame, path: str, keys: Column, last_seq: int) -> None:
    """Append decisions with running numbers after last_seq. The log has one writer, and a call's decisions
    are a reviewer's few answers: they are numbered in one task."""
    numbered = df.withColumn("seq", F.lit(last_seq) + F.row_number().over(Window.orderBy(keys)))
    numbered.write.mode("append").json(path)


def resolve_columns(header: list[str], aliases: dict[str, tuple[str, ...]], required: tuple[str, ...]) -> dict[str, str]:
    """Wanted name -> column of the file, by alias, case and outer space apart; a missing required one is an error."""
    known = {h.strip().lstrip("﻿").lower(): h for h in header}
    found = {}
    for name, others in aliases.items():
        for alias in (name, *others):
            if alias.lower() in known:
                found[name] = known[alias.lower()]
                break
    missing = [r for r in required if r not in found]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    return found


def read_gold(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], required: tuple[str, ...], numbers: tuple[str, ...] = ()) -> DataFrame:
    """A CSV table by column aliases; rows without the first required value are dropped; # starts a comment."""
    raw = spark.read.option("header", True).option("comment", "#").option("encoding", "UTF-8").csv(path)
    columns = resolve_columns(raw.columns, aliases, required)
    chosen = [F.expr(f"try_cast(`{col}` AS double)").alias(n) if n in numbers else c(f"`{col}`").alias(n) for n, col in columns.items()]
    return raw.select(*chosen).where(c(required[0]).isNotNull())


class _Strict(yaml.SafeLoader):
    """Refuses a key that is given twice."""

    def construct_mapping(self, node, deep=False):
        keys = [self.construct_object(k, deep=deep) for k, _ in node.value]
        twice = {k for k in keys if keys.count(k) > 1}
        if twice:
            raise ValueError(f"given twice: {', '.join(map(str, sorted(twice)))}")
        return super().construct_mapping(node, deep)


def load_settings(text: str, profiles: dict[str, dict]) -> dict:
    """Settings from YAML; its profile fills only what is not stated."""
    stated = yaml.load(text, Loader=_Strict) or {}
    profile = profiles.get(stated.get("profile", ""), {})
    return {**profile, **{k: v for k, v in stated.items() if v is not None}}


def settings_hash(settings: dict) -> str:
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def extraction_table(df: DataFrame, fixed: list[str], bag: str) -> DataFrame:
    """Fixed columns, then one mod_ column for every key of a map column, in the keys' order.

    Keys are moderators that a protocol names: a closed, short list.
    """
    keys = sorted(r["k"] for r in df.select(F.explode(F.map_keys(bag)).alias("k")).distinct().limit(1001).collect())
    if len(keys) > 1000:
        raise ValueError("over 1000 moderators: this is no closed list")
    return df.select(*fixed, *[F.element_at(bag, k).alias(f"mod_{k}") for k in keys])


def plain_json(df: DataFrame) -> DataFrame:
    """NaN and infinities as null, as JSON has neither."""
    out = []
    for name, kind in df.dtypes:
        x = c(f"`{name}`")
        out.append(F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(name) if kind in ("double", "float") else x)
    return df.select(*out)


def write_rows(df: DataFrame, stem: str, columns: list[str], formats: tuple[str, ...] = ("csv", "json")) -> None:
    """The same rows in each format, columns in the given order."""
    rows = plain_json(df.select(*columns))
    if "csv" in formats:
        rows.write.mode("overwrite").option("header", True).csv(f"{stem}.csv")
    if "json" in formats:
        rows.write.mode("overwrite").json(f"{stem}.json")
