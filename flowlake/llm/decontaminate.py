"""Benchmark decontamination by a prefix-filtered set join.

An item is a sequence of words; its windows are its runs of `window` words (one window,
the whole item, where it has fewer).  A document is searched for every window.

* Tokens are ordered by rarity: the number of documents that hold the word, counted over
  the whole corpus for the words that occur in items.
* A window counts as matched only if all its words are there (containment 1), so the
  necessary prefix of its token set is one token, the rarest.  Documents join windows on
  that token alone.
* Bounds: a window whose prefix token stands at offset o can only start at p - o for an
  occurrence p; the start must not be negative and the window must end within the text.
* Candidates are verified word by word.

Windows are held in memory by every task.  They are dealt in blocks of at most
`block_words` words, so memory stays bounded however large the benchmark is; each block
reads the documents once.  Usual benchmarks are one block.

Results for odd input: null, empty or wordless texts have no words and no hits; null or wordless
items and items without an id have no windows; texts of any length are searched whole; of
words that are equally rare the smaller is the prefix; items with equal text each count; rows
that repeat a doc_id are separate documents; empty tables give empty results or zero hits;
carried columns: see common.Carried.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import Carried, texts

#: Word characters are 0-9, a-z (A-Z are lowered first) and everything from U+0080 on.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WindowIndex:
    """Windows by their rarest word.  windows: (words, item ids)."""

    def __init__(self, windows: list[tuple[tuple[bytes, ...], tuple[str, ...]]], rarity: dict[bytes, int]):
        self.windows = windows
        self.by_prefix: dict[bytes, list[tuple[int, int, tuple[bytes, ...], tuple[str, ...]]]] = defaultdict(list)
        for words, items in windows:
            at = min(range(len(words)), key=lambda i: (rarity.get(words[i], 0), words[i], i))
            self.by_prefix[words[at]].append((at, len(words), words, items))
        self.prefixes = frozenset(self.by_prefix)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans [start, end) of occurring windows, and their items."""
        spans, items = [], set()
        n = len(words)
        prefixes = self.prefixes
        if prefixes.isdisjoint(words):
            return spans, items
        for p, w in enumerate(words):
            if w in prefixes:
                for at, size, window, ids in self.by_prefix[w]:
                    start = p - at
                    if start >= 0 and start + size <= n and tuple(words[start : start + size]) == window:
                        spans.append((start, start + size))
                        items.update(ids)
        return spans, items


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as disjoint ones in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[tuple[bytes, ...], tuple[str, ...]]]]:
    """Distinct windows with the ids of their items, in blocks; items are streamed, and only one block is held at a time.

    A window that stands in several blocks is found by each, with other items.
    """
    held: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    size = 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
        words = words_of(bytes(r[1])) if r[1] is not None else []
        if not words or r[0] is None:
            continue
        for i in range(max(1, len(words) - window + 1)):
            key = tuple(words[i : i + window])
            if key not in held:
                if held and size + len(key) > block_words:
                    yield [(k, tuple(sorted(v))) for k, v in sorted(held.items())]
                    held, size = defaultdict(set), 0
                size += len(key)
            held[key].add(r[0])
    yield [(k, tuple(sorted(v))) for k, v in sorted(held.items())]


def word_rarity(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that hold each word of the vocabulary (which is bounded by the block), over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for w in vocabulary.intersection(words_of(text)):
                    found[w] += 1
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()} if vocabulary else {}


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_words, spans (word ranges [start, end) that are hit, disjoint), items (ids, sorted as strings), n_hit, and the columns named in carry.

    benchmark: (item_id, text).  A document's words are numbered from 0.
    """
    carried = Carried(docs, carry, ("doc_id", "text", "n_words", "spans", "n_hit", "items"))
    carry, more = carried.inside, carried.schema
    docs = texts(docs, carried.columns)
    parts = []
    for block in blocks(benchmark, window, block_words):
        rarity = word_rarity(docs, frozenset(w for words, _ in block for w in words))
        index = docs.sparkSession.sparkContext.broadcast(WindowIndex(block, rarity))
        if not parts:
            parts.append(docs.mapInArrow(searcher(index, carry), SCHEMA + more))
        else:
            found = docs.select("doc_id", "text").mapInArrow(searcher(index, ()), SCHEMA).where(F.size("spans") > 0)
            parts.append(found.select("doc_id", F.xxhash64("text").alias("_text"), "spans", "items"))
    out = parts[0] if len(parts) == 1 else merge_blocks(parts[0], parts[1:], carry, SCHEMA + more)
    return carried.back(out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")))


SCHEMA = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def searcher(index, carry):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = words_of(text)
                hits, ids = index.value.search(words) if words else ([], ())
                n_words.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in covered(hits)])
                items.append(sorted(ids))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string())), *[batch.column(c) for c in carry]], ["doc_id", "text", "n_words", "spans", "items", *carry])

    return search


def merge_blocks(first: DataFrame, others: list[DataFrame], carry: tuple[str, ...], kind: str) -> DataFrame:
    """Hits of several blocks of items.  All but the first come as hit documents only, named by doc_id and a hash of the text; equal rows have equal hits."""
    own = ("doc_id", "text", "n_words")

    def union(batches):
        for batch in batches:
            parts, ids = batch.column("parts").to_pylist(), batch.column("ids").to_pylist()
            spans = [[{"start": x, "end": y} for x, y in covered([(s["start"], s["end"]) for part in p for s in part])] for p in parts]
            items = [sorted({i for part in p for i in part}) for p in ids]
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in own} | {"spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array(items, pa.list_(pa.string()))} | {n: batch.column(n) for n in carry})

    hits = reduce(DataFrame.unionByName, others).groupBy(F.col("doc_id").alias("_doc"), "_text").agg(F.collect_set("spans").alias("_spans"), F.collect_set("items").alias("_items"))
    joined = first.join(hits, first["doc_id"].eqNullSafe(hits["_doc"]) & (F.xxhash64("text") == hits["_text"]), "left")
    merged = joined.select(*own, *carry, F.concat(F.array("spans"), F.coalesce("_spans", F.array().cast("array<array<struct<start:bigint,end:bigint>>>"))).alias("parts"), F.concat(F.array("items"), F.coalesce("_items", F.array().cast("array<array<string>>"))).alias("ids"))
    return merged.mapInArrow(union, kind)
