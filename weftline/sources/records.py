"""Record streams: lines '+KEY value', records separated by blank lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fields(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, key name, value, ord) of every field line; other lines are left out."""
    found = F.filter(F.split(text, "\n"), lambda x: x.rlike("^\\+[A-Z]+ "))
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(found).alias("ord", "l"))
    return rows.select(key, F.col("ord").cast("long").alias("ord"), F.regexp_extract("l", "^\\+([A-Z]+) ", 1).alias("key"), F.regexp_replace("l", "^\\+[A-Z]+ ", "").alias("value"))


def read(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, nth, fields map): one row per record; a record ends at a blank line or with the text.

    Of a repeated field the last value stays. Records without fields are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, body in zip(pdf[key], pdf[text]):
                record, nth = {}, 0
                for line in [*body.split("\n"), ""]:
                    head, _, value = line.partition(" ")
                    if head[:1] == "+" and head[1:].isalpha() and head[1:].isupper():
                        record[head[1:]] = value
                    elif not line.strip() and record:
                        out.append((k, nth, record))
                        record, nth = {}, nth + 1
            yield pd.DataFrame(out, columns=[key, "nth", "fields"])

    kind = dict(docs.dtypes)[key]
    return docs.where(F.col(text).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, nth bigint, fields map<string,string>")


def write(recs: DataFrame, key: str) -> DataFrame:
    """(key, text): the records of each key as one stream, in their order."""
    line = F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(F.lit("+"), e["key"], F.lit(" "), e["value"])), "\n")
    return recs.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("text"))


def marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, path, s, e, props map) of lists of places: '+ path' before lines '- start end k=v ...', or '@ path start end k=v ...'.

    Lines that begin with '#', and places before any path, are left out. Of a repeated property the last value stays.
    """
    lines = docs.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, "\n")).alias("ord", "l"))
    lines = lines.select(key, F.col("ord").cast("long").alias("ord"), F.trim("l").alias("l"))
    at = W.partitionBy(key).orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    path = F.last(F.when(F.col("l").startswith("+ "), F.substring("l", 3, 1 << 30)), True).over(at)
    words = F.split("l", " ")
    own = F.col("l").startswith("@ ")
    first = F.when(own, 2).otherwise(1)
    found = lines.withColumn("path", F.when(own, F.get(words, F.lit(1))).otherwise(path)).where((own | F.col("l").startswith("- ")) & F.col("path").isNotNull())
    pairs = F.filter(F.slice(words, first + 3, F.size(words)), lambda x: x.contains("="))
    last = F.map_from_entries(F.transform(F.array_distinct(F.transform(pairs, lambda x: F.substring_index(x, "=", 1))), lambda k: F.struct(k, F.regexp_replace(F.element_at(F.filter(pairs, lambda x: F.substring_index(x, "=", 1) == k), F.lit(-1)), "^[^=]*=", ""))))
    number = lambda i: F.get(words, i).try_cast("long")
    return found.select(key, "ord", "path", number(first).alias("s"), number(first + 1).alias("e"), last.alias("props"))
