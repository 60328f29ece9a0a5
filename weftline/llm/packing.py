"""Items of varying length into containers of a fixed capacity: bounded-space online best-fit.

Every task packs its rows as they come. At most ``open_bins`` bins are open; a bitset marks which amounts of free space
occur among them, so the best fit is the lowest set bit at or above the item's size. If an item fits nowhere and all
bins are open, the fullest closes. Bins still open at a task's end are combined once more, ``GROUP`` tasks together, as
whole items of their fill: the input of that round is bounded by ``GROUP * open_bins`` bins, whatever the corpus size.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.common import cut

#: Bins open at once, and tasks whose last open bins are combined with each other.
OPEN_BINS, GROUP = 128, 256
#: Folder of the public tokenizers' files, and the vocabulary used.
TOKENIZERS, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The public tokenizer of a rank file, loaded once per worker."""
    vocabulary = os.path.basename(path)
    if path not in _encoders:
        import tiktoken

        #: Fixed value: the splitting pattern published with this vocabulary.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


class OpenBins:
    """The open bins of one capacity. ``put`` gives the bin of an item; ids count from 0."""

    def __init__(self, capacity: int, limit: int = OPEN_BINS):
        self.capacity, self.limit = capacity, limit
        self.bits = self.made = self.count = 0
        self.by_free: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return taken

    def put(self, size: int) -> int:
        if not 0 <= size <= self.capacity:
            raise ValueError(f"size {size} is not within 0 and {self.capacity}")
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, chosen = self.capacity, self.made
            self.made += 1
        left = free - size
        # a bin without space stays open for items of size 0 until it is the fullest to close
        self.by_free.setdefault(left, []).append(chosen)
        self.bits |= 1 << left
        self.count += 1
        return chosen

    def still_open(self) -> dict[int, int]:
        """Bin id to fill of the open bins."""
        return {b: self.capacity - free for free, bins in self.by_free.items() for b in bins}


def pieces(tokens: int, capacity: int) -> list[tuple[int, int]]:
    """(first token, tokens) of the parts of an item: one part unless the item alone exceeds the capacity."""
    return [(at, min(capacity, tokens - at)) for at in range(0, tokens, capacity)] or [(0, 0)]


def pack(documents: DataFrame, containers: DataFrame, open_bins: int = OPEN_BINS, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_id, bin, doc_id, piece, first_token, n_tokens): an assignment of all texts for each container.

    A text above the capacity is cut every ``capacity`` tokens, only its last part is packed with others. An empty text
    is an item of 0 tokens; a null text is no item. Containers without id or with a capacity below 1 are left out;
    repeated rows of one count once. ``bin`` is unique per container.
    """
    rows = containers.where("container_id is not null and capacity_tokens > 0").select("container_id", "capacity_tokens").distinct().sort("container_id")
    kinds = [(r[0], r[1]) for r in rows.toLocalIterator()]
    # the workers get the vocabulary from the driver, they need no such folder
    documents.sparkSession.sparkContext.addFile(f"{folder}/{vocabulary}")
    schema = "container_id bigint, task bigint, bin bigint, doc_id bigint, piece bigint, first_token bigint, n_tokens bigint, open_fill bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = encoder(SparkFiles.get(vocabulary)).encode_ordinary
        bins = [OpenBins(capacity, open_bins) for _, capacity in kinds]
        columns: list[list] = [[] for _ in range(8)]

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in schema.split(", ")])
            for c in columns:
                c.clear()
            return made

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                tokens = len(encode(text))
                for (container, capacity), own in zip(kinds, bins):
                    for piece, (first, size) in enumerate(pieces(tokens, capacity)):
                        for c, v in zip(columns, (container, task, own.put(size), doc, piece, first, size, None)):
                            c.append(v)
            yield flush()
        for (container, _), own in zip(kinds, bins):
            for b, fill in own.still_open().items():
                for c, v in zip(columns, (container, task, b, None, None, None, None, fill)):
                    c.append(v)
        yield flush()

    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    packed = cut(texts.mapInArrow(run, schema))
    last = packed.where("open_fill is not null").select("container_id", "task", "bin", "open_fill", F.floor(F.col("task") / GROUP).cast("long").alias("grp"))
    moved = last.groupBy("container_id", "grp").applyInPandas(_combiner(dict(kinds)), "container_id bigint, task bigint, bin bigint, into_task bigint, into_bin bigint")
    items = packed.where("open_fill is null").join(moved, ["container_id", "task", "bin"], "left")
    place = F.coalesce("into_task", "task") * F.lit(1 << 40) + F.coalesce("into_bin", "bin")
    return items.select("container_id", place.alias("bin"), "doc_id", "piece", "first_token", "n_tokens")


def _combiner(capacities: dict[int, int]):
    def combine(left: pd.DataFrame) -> pd.DataFrame:
        # the largest first; every bin may stay open, as their number is bounded
        left = left.sort_values(["open_fill", "task", "bin"], ascending=[False, True, True])
        bins = OpenBins(capacities[left["container_id"].iloc[0]], len(left) + 1)
        target = pd.Series([bins.put(int(s)) for s in left["open_fill"]], index=left.index)
        keep = ~target.duplicated()
        head = left[keep].set_index(target[keep])
        return pd.DataFrame({"container_id": left["container_id"], "task": left["task"], "bin": left["bin"], "into_task": head.loc[target, "task"].to_numpy(), "into_bin": head.loc[target, "bin"].to_numpy()})

    return combine


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, bins, tokens, fill) of an assignment: fill is the used share of all bins' capacity."""
    per = packed.groupBy("container_id").agg(F.count_distinct("bin").alias("bins"), F.sum("n_tokens").alias("tokens"))
    sizes: Sequence[str] = ["container_id", "capacity_tokens"]
    return per.join(containers.select(*sizes).distinct(), "container_id").select("container_id", "bins", "tokens", (F.col("tokens") / (F.col("bins") * F.col("capacity_tokens"))).alias("fill"))


def invariants(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_id, n_docs, n_overfull, n_broken, n_split) of an assignment.

    Documents placed; bins above their capacity; documents whose pieces overlap or leave a gap; documents in several
    pieces although they fit into one bin. All but the first are 0 in a valid assignment.
    """
    sizes = containers.where("container_id is not null").select("container_id", "capacity_tokens").distinct()
    bins = packed.groupBy("container_id", "bin").agg(F.sum("n_tokens").alias("fill")).join(F.broadcast(sizes), "container_id")
    over = bins.groupBy("container_id").agg(F.count_if(F.col("fill") > F.col("capacity_tokens")).alias("n_overfull"))
    parts = packed.groupBy("container_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("piece").alias("k"), F.max("piece").alias("last"), F.sum("n_tokens").alias("tokens"), F.max(F.col("first_token") + F.col("n_tokens")).alias("stop"))
    parts = parts.join(F.broadcast(sizes), "container_id")
    broken = (F.col("n") != F.col("k")) | (F.col("last") + 1 != F.col("n")) | (F.col("tokens") != F.col("stop"))
    split = (F.col("n") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))
    docs = parts.groupBy("container_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(broken).alias("n_broken"), F.count_if(split).alias("n_split"))
    return docs.join(over, "container_id").select("container_id", "n_docs", "n_overfull", "n_broken", "n_split")
