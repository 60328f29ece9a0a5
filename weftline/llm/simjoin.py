"""All pairs of set-valued records above a Jaccard similarity: minwise signatures in bands, then an exact check.

Records with equal sets form a class with one representative; only representatives are compared. A signature of
``bands * rows`` minwise hashes is cut into bands, and representatives that share a band bucket become candidates once.
Members of buckets above ``bucket_cap`` members, whose pairs must not be spelled out, go to an exact prefix-filter join
instead: two sets of similarity t share a member among the rarest ``len - ceil(t * len) + 1`` of each. A task that sees
such a bucket among its own records sends one row for it, so that a bucket with a third of all records never meets in one
task. Every row carries the size of its set and a bitmap of 64 bits: two sets differ by at least as many members as their
bitmaps by bits, so most candidates that cannot reach the similarity are dropped, without loss, before they are written. The rest are verified on
the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.common import cut, fits_broadcast

#: Bands and rows of a band: at similarity 0.6 a pair shares no band with probability 0.00014.
BANDS, BAND_ROWS = 64, 4
#: Members of a bucket whose pairs are spelled out, and parts into which the pairs inside a class of equal sets are split.
BUCKET_CAP, SALTS = 100, 32


def sets_of(df: DataFrame, record: str, member: str) -> DataFrame:
    """(id, members): the sorted distinct non-null members of every record. Null records are none."""
    pairs = df.where(F.col(record).isNotNull() & F.col(member).isNotNull())
    return pairs.groupBy(F.col(record).alias("id")).agg(F.array_sort(F.collect_set(member)).alias("members"))


def classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, rep) of every record, and (id, members) of the representatives: the least id of each distinct set.

    Sets are equal if two independent 64-bit hashes and the sizes agree.
    """
    marks = sets.select("id", F.xxhash64("members").alias("h1"), F.xxhash64(F.lit(1), "members").alias("h2"), F.size("members").alias("h3"))
    by = marks.groupBy("h1", "h2", "h3").agg(F.min("id").alias("rep"))
    member_of = cut(marks.join(by, ["h1", "h2", "h3"]).select("id", "rep"))
    reps = sets.join(member_of.where("id = rep").select("id"), "id", "left_semi")
    return member_of, reps


def bitmap(members: str) -> Column:
    """64 bits, of which each member sets one."""
    return F.aggregate(members, F.lit(0).cast("long"), lambda bits, m: bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(m), F.lit(64)).cast("int"))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def band_keys(values: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Bucket keys (sets x bands) of the non-empty sets that begin at ``starts`` in ``values``."""
    rng = np.random.default_rng(20240229)
    mul = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    base = _mix(values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    keys = np.empty((len(starts), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(starts), b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            least = np.minimum.reduceat((base * mul[k] + add[k]) >> np.uint64(16), starts)
            key = _mix(key * np.uint64(0x100000001B3) ^ least)
        keys[:, b] = key
    return keys.view(np.int64)


def bucket_rows(reps: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(bucket, id, crowd, n, bits): one row per representative and band, with the size and the bitmap of its set.

    ``crowd`` is false there. A bucket with more than ``bucket_cap`` members in one batch comes as one row with ``crowd``
    true instead, and each of its members there as one row with ``crowd`` null.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch["members"].value_lengths().to_numpy()
            values = batch["members"].flatten().to_numpy(zero_copy_only=False)
            ids, bits = (batch[c].to_numpy(zero_copy_only=False)[sizes > 0] for c in ("id", "bits"))
            if not len(ids):
                continue
            starts = np.concatenate([[0], np.cumsum(sizes[sizes > 0])[:-1]]).astype(np.int64)
            bucket, own = band_keys(values, starts, bands, rows).reshape(-1), np.repeat(ids, bands)
            kinds, which, counts = np.unique(bucket, return_inverse=True, return_counts=True)
            hot = counts > bucket_cap
            met = np.unique(own[hot[which]])
            cold = ~hot[which]
            yield _batch(bucket[cold], own[cold], False, np.repeat(sizes[sizes > 0], bands)[cold], np.repeat(bits, bands)[cold])
            if len(met):
                yield _batch(kinds[hot], np.zeros(hot.sum(), np.int64), crowd=True)
                yield _batch(_mix(met.astype(np.uint64)).view(np.int64), met, crowd=None)

    return reps.select("id", "members", bitmap("members").alias("bits")).mapInArrow(keys, "bucket bigint, id bigint, crowd boolean, n int, bits bigint")


def _batch(bucket: np.ndarray, ids: np.ndarray, crowd: bool | None, n: np.ndarray | None = None, bits: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of one kind: members of a bucket (False), a crowded bucket (True), members of such ones (null)."""
    none = np.zeros(len(ids), np.int64)
    cols = [pa.array(bucket), pa.array(ids), pa.array([crowd] * len(ids), pa.bool_()), pa.array((none if n is None else n).astype(np.int32)), pa.array(none if bits is None else bits)]
    return pa.RecordBatch.from_arrays(cols, names=["bucket", "id", "crowd", "n", "bits"])


def _bucket_pairs(bucket_cap: int, threshold: float = 0.0):
    """Pairs of ids in equal buckets, and (id, null) for the members of crowded ones; the rows come sorted by bucket.

    Pairs that sizes and bitmaps show to be below ``threshold`` are left out.
    """
    per_mille = round(threshold * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64)]

        def emit(b: np.ndarray, i: np.ndarray, kind: np.ndarray, n: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            alone = [i[kind == 2]]
            b, i, kind, n, bits = (c[kind != 2] for c in (b, i, kind, n, bits))
            _, which, counts = np.unique(b, return_inverse=True, return_counts=True)
            hot = counts > bucket_cap
            hot[which[kind == 1]] = True
            alone.append(np.unique(i[hot[which] & (kind == 0)]))
            b, i, n, bits = (c[~hot[which]] for c in (b, i, n, bits))
            gap, found = 1, []
            while gap < len(b):
                at = np.flatnonzero(b[gap:] == b[:-gap])
                if not len(at):
                    break
                sizes = n[at] + n[at + gap]
                common = np.minimum((sizes - np.bitwise_count((bits[at] ^ bits[at + gap]).view(np.uint64))) // 2, np.minimum(n[at], n[at + gap]))
                at = at[common * 1000 >= (sizes - common) * per_mille]
                found.append((i[at], i[at + gap]))
                gap += 1
            if found:
                x, y = (np.concatenate(c) for c in zip(*found))
                both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])
            lone = np.concatenate(alone)
            if len(lone):
                yield pa.RecordBatch.from_arrays([pa.array(lone), pa.nulls(len(lone), pa.int64())], names=["a", "b"])

        for batch in batches:
            kind = batch["crowd"].cast(pa.int8()).fill_null(2).to_numpy()
            held = [np.concatenate(pair) for pair in zip(held, (batch["bucket"].to_numpy(), batch["id"].to_numpy(), kind, batch["n"].to_numpy(), batch["bits"].to_numpy()))]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            yield from emit(*(c[:last] for c in held))
            held = [c[last:] for c in held]
        yield from emit(*held)

    return run


def prefix_pairs(reps: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b), a < b, of all sets that can reach ``threshold``: an exact prefix-filter join."""
    flat = reps.select("id", F.size("members").alias("n"), bitmap("members").alias("bits"), F.explode("members").alias("m"))
    freq = flat.groupBy("m").agg(F.count(F.lit(1)).alias("df"))
    ranked = flat.join(freq, "m").groupBy("id", "n", "bits").agg(F.array_sort(F.collect_list(F.struct("df", "m"))).alias("ms"))
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - F.lit(1e-9)).cast("int") + 1
    prefix = ranked.select("id", "n", "bits", F.explode(F.slice("ms", F.lit(1), length)).alias("m")).select("id", "n", "bits", "m.m")
    x, y = prefix.toDF("a", "na", "ba", "m"), prefix.toDF("b", "nb", "bb", "m")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    sizes = F.col("na") + F.col("nb")
    # twice the most members that both can have
    twice = sizes - F.bit_count(F.col("ba").bitwiseXOR(F.col("bb")))
    can = (small >= F.lit(threshold) * large - F.lit(1e-9)) & (twice * (1000 + round(threshold * 1000)) >= sizes * 2 * round(threshold * 1000))
    return x.join(y, "m").where((F.col("a") < F.col("b")) & can).select("a", "b").distinct()


def similar_reps(reps: DataFrame, threshold: float, bands: int = BANDS, rows: int = BAND_ROWS, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """(a, b, common, total) for the pairs of representatives with common / total at or above ``threshold``."""
    keyed = bucket_rows(reps, bands, rows, bucket_cap)
    met = cut(keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_bucket_pairs(bucket_cap, threshold), "a bigint, b bigint").distinct())
    pairs = met.where("b is not null")
    crowd = met.where("b is null").select(F.col("a").alias("id"))
    if not crowd.isEmpty():
        side = F.broadcast(crowd) if fits_broadcast(crowd) else crowd
        pairs = pairs.unionByName(prefix_pairs(reps.join(side, "id", "left_semi"), threshold)).distinct()
    left = reps.select(F.col("id").alias("a"), F.col("members").alias("ma"))
    right = reps.select(F.col("id").alias("b"), F.col("members").alias("mb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("ma", "mb")).cast("long")
    checked = both.select("a", "b", common.alias("common"), (F.size("ma") + F.size("mb")).cast("long").alias("sizes"))
    total = F.col("sizes") - F.col("common")
    # as whole numbers, so that the threshold itself is included whatever its binary form
    per_mille = round(threshold * 1000)
    return checked.where(F.col("common") * 1000 >= total * per_mille).select("a", "b", "common", total.alias("total"))


def similar_sets(df: DataFrame, record: str, member: str, threshold: float, min_size: int = 1, **how: int) -> tuple[DataFrame, DataFrame]:
    """Classes (id, rep) of equal sets, and the similar pairs (a, b, common, total), a < b, of their representatives.

    Sets below ``min_size`` members take no part; repeated rows are one member; an empty table gives no rows.
    """
    sets = cut(sets_of(df.select(record, member), record, member).where(F.size("members") >= min_size))
    member_of, reps = classes(sets)
    return member_of, cut(similar_reps(reps, threshold, **how))


def all_pairs(member_of: DataFrame, links: DataFrame) -> DataFrame:
    """(a, b), a < b: the links of representatives spelled out for all members, and the pairs inside every class."""
    one, two = member_of.toDF("x", "rep"), member_of.toDF("y", "rep2")
    across = links.join(one, F.col("a") == F.col("rep")).join(two, F.col("b") == F.col("rep2")).select("x", "y")
    many = member_of.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rep")
    copies = member_of.join(many, "rep").select("id", "rep")
    # the members of a large class are spread by salt, each part meets all members
    parts = copies.select(F.col("id").alias("x"), "rep", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt"))
    every = copies.select(F.col("id").alias("y"), "rep", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    inside = parts.join(every, ["rep", "salt"]).where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def link_counts(member_of: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, n_links) of every record: its class and the number of records that are similar to it."""
    sizes = member_of.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    reached = ends.join(sizes.toDF("other", "m"), "other").groupBy("rep").agg(F.sum("m").alias("linked"))
    per = sizes.join(reached, "rep", "left").select("rep", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return member_of.join(per, "rep").select("id", F.col("rep").alias("class_id"), "n_links")
