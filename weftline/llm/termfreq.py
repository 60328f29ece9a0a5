"""Occurrence and record counts of every term and n-gram, by suffix arrays with common-prefix intervals.

The tokens of a block of records form one collection, in which every position starts a suffix that ends with its record.
The suffixes are sorted by prefix doubling; a maximal run of neighbours with a common prefix of at least n tokens is the
interval of one n-gram. Its length is the number of occurrences; the records are the occurrences less the adjacencies of
equal records once the interval is ordered by record. A record lies in one block only, so the counts of an n-gram from
different blocks add up, and however frequent it is, a block sends one row for it.

What starts at a position whose n-gram occurs once in all of the collection occurs once itself, so such positions take no part
beyond n. Where n-grams that occur once are not asked for, light passes find for n = 1, 2, ... the hashes that occur again, and
one pass counts what is left. Without a greatest n, rounds count n = 1, then 2 .. 3, then 4 .. 7 and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.common import cut, fits_broadcast, lookup_join, one_per_key

#: Tokens of a block; a longer record is a block for itself.
BLOCK_TOKENS = 1 << 20
_PAD = np.iinfo(np.int64).min
_NO_DOC = np.iinfo(np.int64).min
_COUNTS = "n bigint, h1 bigint, h2 bigint, occurrences bigint, records bigint, rid bigint, pos bigint"


def suffix_array(tokens: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``depth`` tokens or more; a suffix ends where its record does."""
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64) + 1
    at, k, n = np.arange(len(tokens)), 1, len(tokens)
    while k < depth:
        far = at + k
        following = np.where(far < ends, rank[np.minimum(far, n - 1)], 0)
        pairs = rank * (n + 1) + following
        new = np.unique(pairs, return_inverse=True)[1].astype(np.int64) + 1
        if new.max(initial=0) == rank.max(initial=0):
            break  # equal suffixes stay equal, whatever the depth
        rank, k = new, 2 * k
    return rank


def _mixed(h: np.ndarray, token: np.ndarray, factor: int) -> np.ndarray:
    x = (h ^ token.view(np.uint64)) * np.uint64(factor)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def intervals(tokens: np.ndarray, ends: np.ndarray, doc: np.ndarray, weight: np.ndarray, starts: np.ndarray, low: int, high: int, rank: np.ndarray | None = None) -> Iterator[tuple]:
    """For n = low .. high: (n, first position of each interval, h1, h2, occurrences, weight, records).

    ``doc``, ``ends`` and ``weight`` are those of the positions' records; only the suffixes at ``starts`` take part.
    """
    rank = suffix_array(tokens, ends, high) if rank is None else rank
    order = starts[np.lexsort((doc[starts], rank[starts]))]
    size, last = ends[order] - order, len(tokens) - 1
    same = np.ones(len(order), dtype=bool)
    if len(order):
        same[0] = False
    h1, h2 = np.zeros(len(order), dtype=np.uint64), np.ones(len(order), dtype=np.uint64)
    for n in range(1, high + 1):
        t = np.where(size >= n, tokens[np.minimum(order + n - 1, last)], _PAD)
        # the common prefix with the suffix before has n tokens
        same[1:] &= t[1:] == t[:-1]
        h1, h2 = _mixed(h1, t, 0x9E3779B97F4A7C15), _mixed(h2, t, 0xC2B2AE3D27D4EB4F)
        full = size >= n
        if n < low:
            continue
        if not full.any():
            return
        begins = np.flatnonzero(full & ~same)
        ident = np.cumsum(full & ~same)[full] - 1
        docs = doc[order][full]
        by = np.lexsort((docs, ident))
        docs, sorted_ident = docs[by], ident[by]
        again = np.zeros(len(docs), dtype=bool)
        again[1:] = (docs[1:] == docs[:-1]) & (sorted_ident[1:] == sorted_ident[:-1])
        counted = (docs != _NO_DOC) & ~again
        occurrences = np.bincount(ident, minlength=len(begins))
        records = np.bincount(sorted_ident[counted], minlength=len(begins))
        sums = np.zeros(len(begins), dtype=np.int64)
        np.add.at(sums, ident, weight[order][full])
        yield n, order[begins], h1[begins].view(np.int64), h2[begins].view(np.int64), occurrences, sums, records


def _grams(tokens: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of the n-grams at ``starts``, all of which lie within their records."""
    h1, h2 = np.zeros(len(starts), dtype=np.uint64), np.ones(len(starts), dtype=np.uint64)
    for k in range(n):
        t = tokens[starts + k]
        h1, h2 = _mixed(h1, t, 0x9E3779B97F4A7C15), _mixed(h2, t, 0xC2B2AE3D27D4EB4F)
    return h1.view(np.int64), h2.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], block_tokens: int) -> Iterator[dict[str, np.ndarray]]:
    """The records of a task in blocks: tokens, and for every position the end, begin, doc and rid of its record; ``starts`` if chosen."""
    held: list[pa.RecordBatch] = []
    size = 0

    def block() -> dict[str, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        lists = rows["tokens"].combine_chunks()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        tokens, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
        spread = lambda x: np.repeat(x, sizes)
        out = {"tokens": tokens, "begin": spread(ends - sizes), "end": spread(ends), "rid": spread(rows["rid"].to_numpy()), "starts": np.arange(len(tokens), dtype=np.int64)}
        if "doc" in rows.column_names:
            out["doc"] = spread(rows["doc"].fill_null(_NO_DOC).to_numpy())
        if "starts" in rows.column_names:
            active = rows["starts"].combine_chunks()
            out["starts"] = active.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(ends - sizes, active.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        return out

    for batch in batches:
        held.append(batch)
        size += len(batch["tokens"].flatten())
        if size >= block_tokens:
            yield block()
            held, size = [], 0
    if size:
        yield block()


def _known(b: dict[str, np.ndarray], starts: np.ndarray, n: int, known: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The starts of n-grams within their records whose first hash is in ``known`` (sorted), if given, and these hashes."""
    starts = starts[starts + n <= b["end"][starts]]
    h = _grams(b["tokens"], starts, n)[0]
    if known is None:
        return starts, h
    inside = known[np.searchsorted(known, h).clip(max=len(known) - 1)] == h if len(known) else np.zeros(len(h), dtype=bool)
    return starts[inside], h[inside]


def _again(records: DataFrame, n: int, before, least: int, block_tokens: int) -> DataFrame:
    """(h1) of the n-grams that occur ``least`` times or more; ``before`` has those of n - 1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, block_tokens):
            starts = b["starts"] if before is None else _known(b, b["starts"], n - 1, before.value)[0]
            h, c = np.unique(_known(b, starts, n, None)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c.astype(np.int32))], names=["h1", "c"])

    sums = records.select("rid", "tokens").mapInArrow(count, "h1 bigint, c int").groupBy("h1").agg(F.sum("c").alias("c"))
    return sums.where(F.col("c") >= least).select("h1")


def _chosen(records: DataFrame, sets: list, block_tokens: int) -> DataFrame:
    """Counts of the n-grams whose first hash is in the n-th of ``sets``: one suffix array for all n."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, block_tokens):
            rank = suffix_array(b["tokens"], b["end"], len(sets))
            starts = b["starts"]
            for n, known in enumerate(sets, 1):
                starts = _known(b, starts, n, known.value)[0]
                yield from _counts(b, starts, n, n, rank)

    return _summed(records.select("rid", "doc", "tokens").mapInArrow(count, _COUNTS))


def _counts(b: dict[str, np.ndarray], starts: np.ndarray, low: int, high: int, rank: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    for n, at, h1, h2, occurrences, _, in_records in intervals(b["tokens"], b["end"], b["doc"], np.ones(len(b["tokens"]), np.int64), starts, low, high, rank):
        columns = [np.full(len(at), n), h1, h2, occurrences, in_records, b["rid"][at], at - b["begin"][at]]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[c.split()[0] for c in _COUNTS.split(", ")])


def _counted(records: DataFrame, low: int, high: int, block_tokens: int) -> DataFrame:
    """Counts of the n-grams with n from ``low`` to ``high`` of (rid, doc, tokens) at all positions, or at ``starts`` if there is such a column."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, block_tokens):
            yield from _counts(b, b["starts"], low, high)

    fields = ["rid", "doc", "tokens", *(["starts"] if "starts" in records.columns else [])]
    return _summed(records.select(*fields).mapInArrow(count, _COUNTS))


def _summed(parts: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("occurrences", "records")]
    return parts.groupBy("n", "h1", "h2").agg(*sums, F.min("rid").alias("rid"), F.min_by("pos", "rid").alias("pos"))


def word_ngrams(texts: DataFrame, max_n: int | None = 2, least: int = 1, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(n, ngram, occurrences, records) of (doc bigint, words array<string>): every run of up to ``max_n`` words.

    One row is one record. With ``least`` of 2 the n-grams that occur once are left out, which keeps the rows near the
    size of the input; without ``max_n`` all lengths are counted and ``least`` must be 2 at least, as every other run
    occurs once anyway. Null words are left out, a null or empty array holds nothing, a null ``doc`` counts as an
    occurrence but as no record. N-grams are told apart by two 64-bit hashes over the hashes of their words.
    """
    if max_n is None and least < 2:
        raise ValueError("all lengths can only be listed for n-grams that occur twice")
    words = F.filter("words", lambda w: w.isNotNull())
    named = texts.where("words is not null").select("doc", words.alias("words")).where(F.size("words") > 0)
    # a record is known by its content, so that no round depends on what an earlier one has stored
    named = named.select(F.xxhash64("doc", "words").alias("rid"), "doc", "words")
    tokens = F.transform("words", lambda w: F.xxhash64(w))
    records = named.select("rid", "doc", tokens.alias("tokens"))
    if least == 1:
        found = cut(_counted(records, 1, max_n, block_tokens))
    else:
        records = cut(records)
        found = _repeated(records, max_n, least, block_tokens)
    # the words of an n-gram stand at its first place
    places = found.groupBy("rid").agg(F.collect_list(F.struct("n", "pos", "occurrences", "records")).alias("grams"))
    spelled = named.select("rid", "words").join(places, "rid").groupBy("rid").agg(F.first("words").alias("words"), F.first("grams").alias("grams")).select("words", F.explode("grams").alias("g"))
    gram = F.array_join(F.slice("words", (F.col("g.pos") + 1).cast("int"), F.col("g.n").cast("int")), " ")
    return spelled.select("g.n", gram.alias("ngram"), "g.occurrences", "g.records")


def _repeated(records: DataFrame, max_n: int | None, least: int, block_tokens: int) -> DataFrame:
    """Counts of the n-grams that occur ``least`` times or more."""
    sets: list = []
    sc = records.sparkSession.sparkContext
    while max_n is not None and len(sets) < max_n:
        again = cut(_again(records, len(sets) + 1, sets[-1] if sets else None, least, block_tokens))
        if not fits_broadcast(again):
            break
        sets.append(sc.broadcast(np.sort(again.toArrow()["h1"].to_numpy().astype(np.int64))))
        if not len(sets[-1].value):
            max_n = len(sets)
    found = cut(_chosen(records, sets, block_tokens).where(F.col("occurrences") >= least)) if sets else None
    low = len(sets) + 1
    if max_n is not None and low > max_n:
        return found
    # too many to be held by every task, or no greatest n: rounds of joins
    active = records.withColumn("starts", F.sequence(F.lit(0), F.size("tokens") - 1))
    while max_n is None or low <= max_n:
        high = 2 * low - 1 if max_n is None else min(max_n, 2 * low - 1)
        counts = cut(_counted(active, low, high, block_tokens).where(F.col("occurrences") >= least))
        found = counts if found is None else found.unionByName(counts)
        low = high + 1
        again = counts.where(F.col("n") == high)
        if (max_n is not None and low > max_n) or again.isEmpty():
            break
        active = cut(_still_active(active, again, high))
    return found


def _still_active(records: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """The records with those starts whose n-gram is among ``repeated``: for more n-grams than all tasks can hold."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, tokens, starts in zip(batch["rid"].to_pylist(), batch["tokens"], batch["starts"]):
                t, at = tokens.values.to_numpy(zero_copy_only=False), starts.values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = at[at + n <= len(t)]
                if len(at):
                    columns = [np.full(len(at), rid), *_grams(t, at, n), at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rid", "h1", "h2", "at"])

    placed = records.select("rid", "tokens", "starts").mapInArrow(grams, "rid bigint, h1 bigint, h2 bigint, at bigint")
    # a frequent n-gram is looked up from all tasks: its side is repeated per salt
    hits = lookup_join(placed.withColumn("g", F.struct("h1", "h2")), repeated.select(F.struct("h1", "h2").alias("g")), "g", "left_semi")
    starts = hits.groupBy("rid").agg(F.array_sort(F.collect_set("at")).alias("starts"))
    return records.drop("starts").join(starts, "rid")


def term_counts(rows: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(term, occurrences, weight, records) of (doc, term, weight) rows, all bigint: the case n = 1 of records in pieces.

    A record's tokens may come in any number of rows. They are spread by (term, doc), so that what could count twice
    for a record meets in one block while a term or record with most of the rows does not meet in one task. A null term is no
    token, a null doc no record, a null weight adds 0. An empty table gives no rows.
    """
    tokens = rows.where(F.col("term").isNotNull()).select("doc", "term", F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            new = [batch["doc"].fill_null(_NO_DOC).to_numpy(), batch["term"].to_numpy(), batch["weight"].to_numpy()]
            held = [np.concatenate(pair) for pair in zip(held, new)]
            doc, term, _ = held
            # rows come sorted by term and doc: the last such pair may go on in the next batch
            at = int(np.flatnonzero((term[1:] != term[:-1]) | (doc[1:] != doc[:-1]))[-1:].sum()) + 1
            if len(doc) >= block_tokens and (at > 1 or (term[0], doc[0]) != (term[-1], doc[-1])):
                yield from block(*(c[:at] for c in held))
                held = [c[at:] for c in held]
        if len(held[0]):
            yield from block(*held)

    def block(doc: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.arange(len(term))
        for _, first, _, _, occurrences, sums, records in intervals(term, at + 1, doc, weight, at, 1, 1):
            columns = [term[first], occurrences, sums, records]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["term", "occurrences", "weight", "records"])

    parts = tokens.repartition("term", "doc").sortWithinPartitions("term", "doc").mapInArrow(count, "term bigint, occurrences bigint, weight bigint, records bigint")
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("occurrences", "weight", "records")])


def dictionary(feats: DataFrame) -> DataFrame:
    """(fid, term_id, term): term is ``feat`` without blanks, tabs and newlines at either end; all ``fid`` of a term share a term_id."""
    named = one_per_key(feats, "fid", ["feat"]).where(F.col("feat").isNotNull()).select("fid", F.btrim("feat", F.lit(" \t\n")).alias("term"))
    ids = named.groupBy("term").agg(F.min("fid").alias("term_id"))
    return named.join(ids, "term").select("fid", "term_id", "term")


def feature_terms(itemfeats: DataFrame, feats: DataFrame, rare_items: int = 3, rare_count: int = 5, common_share: float = 0.1) -> DataFrame:
    """(term, sum_count, n_items, mark) of every term in use; mark is 'common', 'rare' or null.

    Repeated rows of a ``sid0`` count once, rows without ``sid0`` never. A term is common in more than ``common_share``
    of all distinct ``tid``, otherwise rare below ``rare_items`` items or ``rare_count`` counts. A null ``feat_count``
    adds 0, a ``fid`` that is null or not in ``feats`` has no term.
    """
    n_items = itemfeats.select("tid").where(F.col("tid").isNotNull()).distinct().count()
    known = cut(dictionary(feats))
    rows = one_per_key(itemfeats, "sid0", ["tid", "fid", "feat_count"]).where(F.col("fid").isNotNull())
    tokens = lookup_join(rows, known.select("fid", "term_id"), "fid").select(F.col("tid").alias("doc"), F.col("term_id").alias("term"), F.col("feat_count").alias("weight"))
    counts = term_counts(tokens).select(F.col("term").alias("term_id"), F.col("weight").alias("sum_count"), F.col("records").alias("n_items"))
    rare = (F.col("n_items") < rare_items) | (F.col("sum_count") < rare_count)
    # in whole millionths, so that a share of exactly a tenth is not above it
    common = F.col("n_items") * 1_000_000 > F.lit(n_items * round(common_share * 1_000_000))
    mark = F.when(common, "common").when(rare, "rare")
    names = known.where(F.col("fid") == F.col("term_id")).select("term_id", "term")
    return counts.join(names, "term_id").select("term", "sum_count", "n_items", mark.alias("mark"))
