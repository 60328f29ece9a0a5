"""Passages of evaluation items inside a corpus, by one Aho-Corasick automaton over the normalised items.

Words are maximal runs of A-Z, a-z and 0-9 in lower case; the automaton reads the numbers of words. Its patterns are the
blocks of ``(min_words + 1) // 2`` words into which every item, question and answer alike, falls from its beginning: any
``min_words`` consecutive words of an item hold one of its blocks whole. So the automaton has at most one node for a word of
the items, and all items are searched in one scan. A hit is extended to both sides while document and item agree.
Positions are mapped back to the document only where something is found.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a passage.
MIN_WORDS = 12
#: Bytes of evaluation text in one automaton (some 60 bytes of memory per word); more text is taken in several scans.
AUTOMATON_BYTES = 32 << 20

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile("[A-Za-z0-9]+")
_built: dict[str, object] = {}


def words_of(text: str) -> list[bytes]:
    """The words of ``text`` in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Items:
    """The automaton over the blocks of items, with the items' words."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS):
        import ahocorasick

        self.min_words, self.block = min_words, (min_words + 1) // 2
        self.numbers: dict[bytes, int] = {}
        # items of equal words are one text with several owners
        owners: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text or ""))
            if len(ids) >= min_words:
                owners.setdefault(ids, set()).add(item)
        self.texts = [(ids, sorted(who)) for ids, who in owners.items()]
        places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for t, (ids, _) in enumerate(self.texts):
            for at in range(0, len(ids) - self.block + 1, self.block):
                places.setdefault(ids[at : at + self.block], []).append((t, at))
        self.machine = None
        if places:
            self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for key, found in places.items():
                self.machine.add_word(key, found)
            self.machine.make_automaton()

    def scan(self, text: str) -> dict[int, tuple[int, int]]:
        """For each item with a passage in ``text``: the character offsets (start, end) of its first one, at full length."""
        if self.machine is None:
            return {}
        number = self.numbers.get
        ids = tuple(map(number, words_of(text), repeat(0)))
        if len(ids) < self.min_words:
            return {}
        hits: dict[int, tuple[int, int]] = {}
        done: dict[tuple[int, int], int] = {}
        for end, found in self.machine.iter(ids):
            for t, at in found:
                begin = end - self.block + 1
                # a passage goes along one diagonal of document and item; what it covers is not extended again
                if done.get((t, begin - at), -1) >= end:
                    continue
                own, who = self.texts[t]
                a, b, x, y = begin, end + 1, at, at + self.block
                while a and x and ids[a - 1] == own[x - 1]:
                    a, x = a - 1, x - 1
                while b < len(ids) and y < len(own) and ids[b] == own[y]:
                    b, y = b + 1, y + 1
                done[t, begin - at] = b - 1
                if b - a >= self.min_words:
                    for item in who:
                        hits[item] = min(hits.get(item, (a, b)), (a, b))
        if hits:
            spans = [m.span() for m in _WORD.finditer(text)]
            hits = {item: (spans[a][0], spans[b - 1][1]) for item, (a, b) in hits.items()}
        return hits


def leaked(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """(doc_id, item_id, start_char, end_char): every document with every item of which it holds a passage.

    The offsets are those of the first passage in the document's own characters. Null texts hold nothing. Repeated rows
    of an item count once. The items are held-out texts of bounded size: up to ``automaton_bytes`` of them make one
    automaton and one scan of the corpus; more are taken group by group, with the same result.
    """
    spark = documents.sparkSession
    rows = items.where(F.col("item_id").isNotNull() & F.col("item_text").isNotNull()).select("item_id", "item_text").distinct().sort("item_id")
    parts: list[DataFrame] = []
    group: list[tuple[int, str]] = []
    size = 0
    for r in rows.toLocalIterator():
        if group and size + len(r[1]) > automaton_bytes:
            parts.append(_scan_group(documents, spark.sparkContext.broadcast(group), min_words))
            group, size = [], 0
        group.append((r[0], r[1]))
        size += len(r[1])
    found = _scan_group(documents, spark.sparkContext.broadcast(group), min_words)
    for part in parts:
        found = found.unionByName(part)
    if parts:
        found = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("start_char", "end_char")).alias("p")).select("doc_id", "item_id", "p.start_char", "p.end_char")
    return found


def _scan_group(documents: DataFrame, group, min_words: int) -> DataFrame:
    tag = uuid.uuid4().hex  # a worker builds the automaton once for all its tasks

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tag not in _built:
            _built.clear()
            _built[tag] = Items(group.value, min_words)
        machine = _built[tag]
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                out += [(doc, item, a, b) for item, (a, b) in machine.scan(text).items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["doc_id", "item_id", "start_char", "end_char"])

    texts = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    return texts.mapInArrow(find, "doc_id bigint, item_id bigint, start_char bigint, end_char bigint")
