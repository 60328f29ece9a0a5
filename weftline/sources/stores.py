"""Stores on disk: tables as Parquet, feature text, variable lists, and saved Naive-Bayes models."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("dfmethod", "dfscope", "dfnode", "dflink", "items", "feats", "itemfeats", "sourcemap")


def save(tables: dict[str, DataFrame], folder: str, append: bool = False) -> None:
    """Write every table to ``folder``/<name>.parquet. Ids come from the content, so that later loads can be appended."""
    for name, df in tables.items():
        df.write.mode("append" if append else "overwrite").parquet(f"{folder}/{name}.parquet")


def load_spec(spark: SparkSession, spec: str, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """The tables of 'folder' or, of some methods only, of 'folder:mid,mid'."""
    folder, _, ids = spec.rpartition(":")
    if folder and re.fullmatch(r"-?\d+(,-?\d+)*", ids):
        return load(spark, folder, [int(x) for x in ids.split(",")], tables)
    return load(spark, spec, None, tables)


def load(spark: SparkSession, folder: str, mids: list[int] | None = None, tables: Sequence[str] = TABLES) -> dict[str, DataFrame]:
    """The tables of a store; ``mids`` keeps the rows of those methods where a table names its method."""
    out = {}
    for name in tables:
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        out[name] = df.where(F.col("mid").isin(mids)) if mids is not None and "mid" in df.columns else df
    return out


#: Features of one record of a stream; an item with more has several records, which add up when read.
RECORD_FEATURES = 4096


def feature_text(features: DataFrame, sources: DataFrame | None = None, most: int = RECORD_FEATURES) -> DataFrame:
    """(item, part, text) of (item, feat, c): record streams with the item and its features in order.

    With ``srcs``, an array of [first, last] source positions, in ``features`` these go along. ``sources`` (id, path) gives the lines
    that name the files, as streams without item before all others (part -1).
    """
    has = "srcs" in features.columns
    own = features.where("item is not null")
    parts = own.groupBy("item").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    line = F.concat(F.lit("+FEAT "), F.to_json(F.struct("c", "feat", *(["srcs"] if has else []))))
    placed = own.join(parts, "item").withColumn("part", F.pmod(F.xxhash64("feat"), F.col("parts")).cast("long")).withColumn("line", line)
    per = placed.groupBy("item", "part").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))
    out = per.select("item", "part", F.concat(F.lit("+ITEM "), F.to_json(F.struct("item")), F.lit("\n"), "lines", F.lit("\n")).alias("text"))
    if sources is None:
        return out
    named = sources.where("id is not null").select(F.lit(None).cast("string").alias("item"), F.lit(-1).cast("long").alias("part"), F.concat(F.lit("+SOURCE "), F.to_json(F.array(F.col("id").cast("string"), F.coalesce("path", F.lit(""))))).alias("text"))
    return named.unionByName(out)


def read_feature_text(streams: DataFrame, text: str) -> DataFrame:
    """(item, feat, c, n_srcs) of record streams with +ITEM and +FEAT lines; a feature before any item is left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for body in pdf[text]:
                item = None
                for line in body.split("\n"):
                    if line.startswith("+ITEM "):
                        item = json.loads(line[6:])["item"]
                    elif line.startswith("+FEAT ") and item is not None:
                        f = json.loads(line[6:])
                        rows.append((item, f["feat"], f["c"], len(f.get("srcs") or ())))
            yield pd.DataFrame(rows, columns=["item", "feat", "c", "n_srcs"])

    return streams.where(F.col(text).isNotNull()).select(text).mapInPandas(run, "item string, feat string, c bigint, n_srcs bigint")


def read_sources(streams: DataFrame, text: str) -> DataFrame:
    """(id, path) of the +SOURCE lines of record streams."""
    lines = streams.where(F.col(text).isNotNull()).select(F.explode(F.split(text, "\n")).alias("l")).where("startswith(l, '+SOURCE ')")
    pair = F.from_json(F.substring("l", 9, 1 << 30), "array<string>")
    return lines.select(pair[0].cast("long").alias("id"), pair[1].alias("path"))


def variable_lines(variables: DataFrame) -> DataFrame:
    """Lines 'ref type' of (ref_name, ntype)."""
    return variables.select(F.concat_ws(" ", "ref_name", "ntype").alias("value"))


def read_variable_lines(lines: DataFrame) -> DataFrame:
    """(ref_name, ntype) of lines, cut at the first blank; lines without a blank are left out."""
    at = F.instr("value", " ")
    return lines.where(at > 1).select(F.substring("value", F.lit(1), at - 1).alias("ref_name"), F.substring("value", at + 1, F.length("value")).alias("ntype"))


def save_model(keys: DataFrame, feats: DataFrame, folder: str) -> None:
    keys.write.mode("overwrite").parquet(f"{folder}/keys.parquet")
    feats.write.mode("overwrite").parquet(f"{folder}/feats.parquet")


def load_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The model of ``save_model``; raises if it holds counts that no training gives."""
    keys, feats = spark.read.parquet(f"{folder}/keys.parquet"), spark.read.parquet(f"{folder}/feats.parquet")
    wrong = keys.where("key is null or k <= 0").limit(1).count() + feats.where("key is null or feat is null or c <= 0").limit(1).count()
    if wrong or feats.join(keys, "key", "left_anti").limit(1).count():
        raise ValueError("the model's counts do not belong together")
    return keys, feats
