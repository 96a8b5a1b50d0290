"""A log-structured index of window fingerprints, for incremental substring deduplication.

Each batch of documents becomes one immutable run: the fingerprints of its windows'
anchors (see `windows`), sorted within hash buckets, each with the documents that hold it
(by chunk and part of the chunk).  A batch's run is merge-joined with the sorted runs of all
earlier batches bucket by bucket.  Matches are verified on the words of both sides: the texts
of the batch and of those parts of history that share a fingerprint with it are read again
and compared by 128-bit digests of their words (see `windows`), so a fingerprint alone decides
nothing.  `compact` merges runs into one.

    index = FingerprintIndex(spark, path, Spec("words", 20, 8), buckets=64)
    first = index.ingest(docs_1)
    second = index.ingest(docs_2, history=docs_1)

`ingest` adds the batch's run (`add`) and returns its documents with the words removed that are
covered by a window which also starts earlier: in the batch, or anywhere in history (`judge`).
Batches come in ascending doc_id order.  The text of earlier batches is handed in; of it, only
documents in matched parts are dealt out and looked into.

A run is a Parquet table (bucket, fps, owners), committed by Spark.  After it a new manifest is
written beside the older ones, under the next number, and renamed into place; readers take the
highest.  The object's state changes after that, so a batch that fails anywhere before leaves
the index as it was and can be ingested again, and one that fails later can be judged again.
`compact` writes the merged run beside the old ones, which readers may still hold; `vacuum`
deletes runs and manifests that the newest manifest doesn't need.

Results for odd input: see `windows`; null and empty texts have no words; an empty batch makes
an empty run; rows that repeat a doc_id are separate documents; extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm import windows
from flowlake.llm.common import drop_path, texts, written
from flowlake.llm.windows import Spec

RUN = "bucket long, fps binary, owners binary"
MATCHED = windows.MATCHED + ", parts array<int>"
KIND = "doc_id long, n_words long, n_removed long, kept string"
#: Chunks of a batch are numbered from batch << BATCH_BITS; an owner is a chunk and one of its PARTS.
BATCH_BITS, PARTS = 32, 1024


def lot_prints(spec: Spec, buckets: int, lot: int = 1024):
    """bucket, fps (sorted), owners of lots of documents, which have their chunk and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, lot):
                rows = pa.Table.from_batches([whole.slice(at, lot)])
                chunk = windows.Chunk(rows, spec)
                first, _, anchor = chunk.stretches(False)
                owner = (rows.column("chunk").to_numpy() * PARTS + rows.column("part").to_numpy())[chunk.order][chunk.doc_of(first)] if len(first) else np.empty(0, np.int64)
                bucket, fp = windows.bucket_key(anchor, buckets)
                order = np.lexsort((owner, fp, bucket))
                bucket, fp, owner = bucket[order], fp[order], owner[order]
                new = np.ones(len(order), bool)
                new[1:] = (bucket[1:] != bucket[:-1]) | (fp[1:] != fp[:-1]) | (owner[1:] != owner[:-1])
                found, (fps, owners) = windows.split_by(bucket[new], fp[new].astype("<u4"), owner[new].astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(fps, pa.binary()), pa.array(owners, pa.binary())], ["bucket", "fps", "owners"])

    return run


def lists(rows: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [np.frombuffer(x, "<u4") for x in rows.column("fps").to_pylist()], [np.frombuffer(x, "<i8") for x in rows.column("owners").to_pylist()]


def merged(fps: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists as one: a stable sort of sorted lists one after the other merges them."""
    fps, owners = np.concatenate(fps), np.concatenate(owners)
    order = np.argsort(fps, kind="stable")
    return fps[order], owners[order]


def sorted_run(rows: pa.Table) -> pa.Table:
    """All fingerprints of a bucket, sorted, with their owners: from the lists of lots or of other runs."""
    fps, owners = merged(*lists(rows))
    return pa.table({"bucket": rows.column("bucket")[:1], "fps": pa.array([fps.tobytes()], pa.binary()), "owners": pa.array([owners.tobytes()], pa.binary())})


def inside(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of the sorted values are among the sorted others."""
    if not len(others):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(others, values), len(others) - 1)
    return others[at] == values


def joiner(first_live: int, after: int, hot: int):
    """Merge-joins the batch's run of a bucket with the runs before it.

    Rows of windows.MATCHED for chunks of the batch and of history, with the parts of history
    chunks that hold a fingerprint of the batch.
    """

    def among(runs, low, high):
        picked = [(f, o, (o // PARTS >= low) & (o // PARTS < high)) for f, o in runs]
        return [(f[keep], o[keep]) for f, o, keep in picked if keep.any()]

    def join(rows: pa.Table) -> pa.Table:
        runs = list(zip(*lists(rows), strict=True))
        live, past = among(runs, first_live, after), among(runs, 0, first_live)
        fps, owners = merged(*zip(*live, strict=True)) if live else (np.empty(0, "<u4"), np.empty(0, "<i8"))
        hits = [(f[hit], o[hit]) for f, o in past for hit in [inside(f, fps)]]
        fps, owners = merged([*[f for f, _ in hits], fps], [*[o for _, o in hits], owners])
        chunks = owners // PARTS
        order = np.lexsort((chunks, fps))
        chunks, fps, owners = chunks[order], fps[order], owners[order]
        new = np.ones(len(fps), bool)  # a chunk counts once a fingerprint
        new[1:] = (fps[1:] != fps[:-1]) | (chunks[1:] != chunks[:-1])
        out = windows.told(chunks[new], fps[new], rows.column("bucket")[0].as_py(), hot)
        old = np.unique(owners[chunks < first_live])
        own, (parts,) = windows.split_by(old // PARTS, (old % PARTS).astype("<i4"))
        by_chunk = dict(zip(own.tolist(), parts, strict=True))
        column = [np.frombuffer(by_chunk[c], "<i4") if c in by_chunk else None for c in out.column("chunk").to_pylist()]
        return out.append_column("parts", pa.array(column, pa.list_(pa.int32())))

    return join


class FingerprintIndex:
    def __init__(self, spark: SparkSession, path: str, spec: Spec, buckets: int):
        self.spark, self.path, self.spec, self.buckets = spark, path, spec, buckets
        self.state = self._read()

    def _store(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _manifests(self) -> list[str]:
        store, folder = self._store("manifests")
        names = [f.getPath().getName() for f in store.listStatus(folder)] if store.exists(folder) else []
        return sorted(n for n in names if n.endswith(".json") and not n.startswith("."))

    def _read(self) -> dict:
        names = self._manifests()
        if not names:
            return {"number": 0, "runs": [], "batches": 0, "chunks": []}
        return json.loads(self.spark.read.text(f"{self.path}/manifests/{names[-1]}").first()[0])

    def _commit(self, state: dict) -> None:
        """Writes the next manifest beside the others, renames it into place, and only then takes it as the state."""
        state = state | {"number": self.state["number"] + 1}
        store, folder = self._store("manifests")
        store.mkdirs(folder)
        _, temp = self._store("manifests", f".{uuid.uuid4().hex}")
        _, final = self._store("manifests", f"{state['number']:08d}.json")
        out = store.create(temp, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if store.exists(final) or not store.rename(temp, final):
            store.delete(temp, False)
            raise RuntimeError(f"another writer has committed manifest {state['number']} of {self.path}")
        self.state = state

    def _written(self, rows: DataFrame, level: int, batches: list[int]) -> dict:
        name = f"run-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return {"name": name, "level": level, "batches": batches}

    def runs(self, batches: int | None = None) -> DataFrame:
        """All runs, or those that hold any of the first so many batches."""
        names = [f"{self.path}/{r['name']}" for r in self.state["runs"] if batches is None or min(r["batches"]) < batches]
        return self.spark.read.schema(RUN).parquet(*names) if names else self.spark.createDataFrame([], RUN)

    def _placed(self, batch: int, docs: DataFrame, chunks: int) -> DataFrame:
        part = F.pmod(F.xxhash64(windows.own_hash()), F.lit(PARTS)).cast("int").alias("part")
        return windows.dealt(docs, chunks, batch << BATCH_BITS, (part,))

    def add(self, batch: DataFrame, chunk_bytes: int = 2 << 20) -> int:
        """Writes the batch's run and commits it; returns the batch's number."""
        number, spec, buckets = self.state["batches"], self.spec, self.buckets
        chunks = windows.shape(batch, chunk_bytes, 1).chunks
        prints = self._placed(number, batch, chunks).mapInArrow(lot_prints(spec, buckets), RUN)
        run = self._written(prints.groupBy("bucket").applyInArrow(sorted_run, RUN), 0, [number])
        self._commit({"runs": [*self.state["runs"], run], "batches": number + 1, "chunks": [*self.state["chunks"], chunks]})
        return number

    def judge(self, number: int, batches: list[DataFrame], hot: int = windows.HOT, salts: int = windows.SALTS) -> DataFrame:
        """doc_id, n_words, n_removed, kept (the other words, joined by one space) of the documents of batch `number`.

        batches: the documents of that batch and of all before it, one frame each, as they were added.
        """
        spec, buckets, first = self.spec, self.buckets, number << BATCH_BITS
        every = [self._placed(i, d, self.state["chunks"][i]) for i, d in enumerate(batches)]
        after = (number + 1) << BATCH_BITS
        matched = written(self.runs(number + 1).groupBy("bucket").applyInArrow(joiner(first, after, hot), MATCHED), "index-matched")
        rows = every[-1]
        if number:
            past = every[0]
            for more in every[1:-1]:
                past = past.unionByName(more)
            held = matched.where(F.col("chunk") < first).select("chunk", F.explode("parts").alias("part")).distinct()
            rows = rows.unionByName(past.join(held, ["chunk", "part"], "left_semi").select(*rows.columns))
        rows = windows.Shape(0, buckets, -(-sum(self.state["chunks"][: number + 1]) // 128)).spread(rows.drop("part"))
        found = windows.repeats(rows, matched.drop("parts"), spec, buckets, first, hot, salts)

        def finish(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or a.column("chunk")[0].as_py() < first:
                return without(windows.Chunk(a.slice(0, 0), spec), np.empty(0, bool))
            return without(*windows.covered(a, b, spec))

        return rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(windows.lean(finish), KIND)

    def ingest(self, batch: DataFrame, history: list[DataFrame] | DataFrame | None = None, chunk_bytes: int = 2 << 20) -> DataFrame:
        """add() and judge().  history: the documents of all earlier batches, one frame each, as they were added."""
        history = [history] if isinstance(history, DataFrame) else list(history or [])
        if len(history) != self.state["batches"]:
            raise ValueError(f"{self.state['batches']} earlier batches are indexed, {len(history)} are given")
        return self.judge(self.add(batch, chunk_bytes), [*history, batch])

    def compact(self, least: int = 2) -> None:
        """Merges the runs of the lowest level that has `least` of them into one of the next level."""
        for level in sorted({r["level"] for r in self.state["runs"]}):
            own = [r for r in self.state["runs"] if r["level"] == level]
            if len(own) >= least:
                rows = self.spark.read.schema(RUN).parquet(*[f"{self.path}/{r['name']}" for r in own])
                run = self._written(rows.groupBy("bucket").applyInArrow(sorted_run, RUN), level + 1, sorted(b for r in own for b in r["batches"]))
                self._commit({**self.state, "runs": [*[r for r in self.state["runs"] if r["level"] != level], run]})
                return

    def vacuum(self) -> None:
        """Deletes runs that the newest manifest doesn't name, and older manifests; only when nothing that reads them is left."""
        store, root = self._store()
        named = {r["name"] for r in self.state["runs"]}
        for f in store.listStatus(root):
            name = f.getPath().getName()
            if name.startswith("run-") and name not in named:
                drop_path(self.spark, f"{self.path}/{name}")
        for name in self._manifests()[:-1]:
            drop_path(self.spark, f"{self.path}/manifests/{name}")


def without(chunk: windows.Chunk, mask: np.ndarray) -> pa.Table:
    counts = np.concatenate([[0], np.cumsum(mask)])
    removed = counts[chunk.offsets[1:]] - counts[chunk.offsets[:-1]]
    kept = []
    for d, text in enumerate(chunk.text):
        words = text.split()
        if removed[d]:
            keep = ~mask[chunk.offsets[d] : chunk.offsets[d + 1]]
            words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
        kept.append(b" ".join(words))
    return pa.table({"doc_id": pa.array(chunk.doc_id, pa.int64()), "n_words": pa.array(np.diff(chunk.offsets)), "n_removed": pa.array(removed.astype(np.int64)), "kept": pa.array(kept, pa.binary()).cast(pa.string())})


def split_by_id(docs: DataFrame, batches: int) -> list[DataFrame]:
    """Documents in so many batches of ascending doc_id; nulls are in the first."""
    docs = texts(docs)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        part = docs
        if lo is not None:
            part = part.where(F.col("doc_id") > lo)
        if hi is not None:
            part = part.where((F.col("doc_id") <= hi) | F.col("doc_id").isNull() if lo is None else F.col("doc_id") <= hi)
        elif lo is None:
            part = docs
        out.append(part)
    return out


def incremental_dedup(docs: DataFrame, path: str, batches: int = 2, length: int = 20, gram: int = 8) -> DataFrame:
    """Indexes the documents in batches of ascending doc_id; the results of all batches."""
    spark = docs.sparkSession
    buckets = windows.shape(docs, 2 << 20, 5 * ((length - gram) // 2 + 1)).buckets
    index = FingerprintIndex(spark, path, Spec("words", length, min(gram, length)), buckets)
    parts = split_by_id(docs, batches)
    out = None
    for i, part in enumerate(parts):
        found = index.ingest(part, parts[:i])
        out = found if out is None else out.unionByName(found)
    index.compact()
    return out
