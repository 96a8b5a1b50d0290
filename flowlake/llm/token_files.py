"""Token-id files: documents compressed one by one under a shared zstandard dictionary.

`write_token_files` sorts documents by doc_id over range partitions; each partition
becomes one file, written under a name of its own and then renamed, so a task that runs
again leaves the same file.  Nulls in doc_id sort first.  A file holds

    magic "FLTOK1\\n", then one zstandard frame per document (its ids, little endian,
    2 bytes each if every id of the vocabulary fits, else 4),
    then the index: doc_ids (int64, with a byte per null), frame offsets (uint64, one
    more than documents), token counts (uint32),
    then a JSON footer (documents, tokens, id width, SHA-256 of the dictionary) and its
    length (uint32).

The dictionary is trained on the serialized ids of a bounded sample (`sample_docs`
documents with the smallest hashes of doc_id; it affects sizes only) and stored once
beside the files.  `manifest` rows tell each file's documents and tokens, so a document's
place among all ids follows from file totals, one row per file.

`read_token_files` gives documents back; `read_document` reads one document by its offset.

Tokens: texts are cut at ASCII white space, which no pre-token of the tokenizer spans, and
each distinct piece of a block is encoded by the tokenizers library once and held (`Encoder`).
When the table is full, pieces that came in one block only are dropped first.
Texts for which that might differ (non-ASCII white space, the vocabulary's special
strings, characters that compose across a cut) are encoded whole.

Results for odd input: null and empty texts have the end id only; texts of any length are one
frame; rows that repeat a doc_id are kept, next to each other, and ties among them are in no
fixed order; an empty table gives files without documents or no files, and no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
from collections.abc import Iterator
from itertools import compress, islice
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlake.llm.common import partitions, texts

MAGIC = b"FLTOK1\n"
SEPARATOR = "\x01"
#: Only texts up to this size serve to train the dictionary.
SAMPLE_BYTES = 16_384
#: Texts are encoded in blocks of about this size.
BLOCK_BYTES = 4_000_000
#: Longer pieces are encoded when they occur and not held.
HELD_CHARS = 48
#: Texts of characters up to U+00FF are cut and lowered by Python; these have another meaning there, or are the separator or a special's begin.
UNSAFE_LATIN = "\x01\x1c\x1d\x1e\x1f\x85\xa0"
#: In other texts also white space at which they are not cut, and marks that compose with a space before them.
UNSAFE = re.compile("[\x01\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|[ \t-\r][\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\u3099-\u309c\ufe20-\ufe2f]|<\\|")
#: Punctuation before a comma or point: the run is one pre-token and stays uncut.
RUN = re.compile(r"[.,](?<=[\W_].)(?<=\S.)")
#: Punctuation that ends a piece is a pre-token of its own. An apostrophe is not: it may begin a clitic.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The parts of a tokenizer file under which texts may be cut at white space.
SHAPE = {"normalizer": ["NFC", "Replace", "Lowercase"], "pre_tokenizer": ["Split", "ByteLevel"]}


def is_word(piece: str) -> bool:
    """Small letters up to U+00FF alone: one pre-token, which the normalizer leaves as it is."""
    return piece.isalpha() and piece.islower() and (piece.isascii() or max(piece) <= "\xff")


class Encoder:
    """Encodes texts by their pieces where the tokenizer's parts allow that, else whole."""

    def __init__(self, path: str, held: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.size, self.ids = held, {}
        #: Pieces of more than one block since the table was last full.
        self.again: set[str] = set()
        parts = json.loads(self.library.to_str())
        shape = {"normalizer": [x["type"] for x in (parts["normalizer"] or {}).get("normalizers", [])], "pre_tokenizer": [x["type"] for x in (parts["pre_tokenizer"] or {}).get("pretokenizers", [])]}
        mark = self.library.encode(SEPARATOR, add_special_tokens=False).ids
        self.cuts = shape == SHAPE and len(mark) == 1
        if self.cuts:
            self.mark = mark[0]
            #: Whole words need no pattern and no normalizer: the model alone encodes them, spelled in its letters for bytes.
            self.model, level = self.library.model, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(256)) if c.isalpha()})

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def spaced(self, text: str) -> str | None:
        """The text with white space between parts whose ids, joined, are the text's; None if it is to be encoded whole."""
        if not self.cuts or "<|" in text:
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None if UNSAFE.search(text) else text
        if any(c in text for c in UNSAFE_LATIN):
            return None
        text = text.lower()
        return text if RUN.search(text) else (text + " ").replace(", ", " , ").replace(". ", " . ").replace(".\n", " . ")

    def _divided(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        w = self.dtype.itemsize
        return [raw[a:b] for a, b in zip((starts * w).tolist(), (ends * w).tolist(), strict=True)]

    def _words(self, words: list[str]) -> list[bytes]:
        tokenize, number = self.model.tokenize, attrgetter("id")
        ids, ends = [], [0]
        for w in words:
            ids.extend(map(number, tokenize(w if w.isascii() else w.translate(self.letters))))
            ends.append(len(ids))
        places = np.array(ends)
        return self._divided(np.array(ids, self.dtype).tobytes(), places[:-1], places[1:])

    def _others(self, pieces: list[str]) -> list[bytes]:
        ids = np.array(self.library.encode_batch_fast([f" {SEPARATOR} ".join(pieces)], add_special_tokens=False)[0].ids, self.dtype)
        cuts = np.flatnonzero(ids == self.mark)
        if len(cuts) != len(pieces) - 1:
            return [self.whole(p) for p in pieces]
        return self._divided(ids.tobytes(), np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids)))

    def _learned(self, pieces: list[str]) -> dict[str, bytes]:
        words, others, tailed = [], [], []
        for p in pieces:
            if is_word(p):
                words.append(p)
            elif is_word(head := p.rstrip(TAIL)):
                tailed.append((p, head, p[len(head) :]))
            else:
                others.append(p)
        found = dict(zip(words, self._words(words), strict=True))
        more = {p: self.ids.get(p) or found.get(p) for _, *parts in tailed for p in parts}
        heads = [p for p, ids in more.items() if ids is None and is_word(p)]
        others += {p for p, ids in more.items() if ids is None and not is_word(p)}.difference(others)
        more.update(zip(heads, self._words(heads), strict=True))
        if others:
            more.update(zip(others, self._others(others), strict=True))
        found.update((p, more[head] + more[tail]) for p, head, tail in tailed)
        return {p: found.get(p) or more[p] for p in pieces}

    def encode(self, batch: list[str]) -> list[bytes]:
        spaced = [self.spaced(t) for t in batch]
        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in spaced], pa.large_string()))
        pieces = lists.flatten().dictionary_encode()
        every = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.ids.get, every))
        new = [p for p, known in zip(every, ids, strict=True) if known is None]
        self.again.update(compress(every, ids))
        if len(self.ids) + len(new) > self.size:
            kept = islice(self.again, self.size // 2)
            self.ids, self.again = {p: self.ids[p] for p in kept}, set()
        learned = self._learned(new)
        self.ids.update((p, x) for p, x in learned.items() if len(p) <= HELD_CHARS)
        joined = pa.array([learned[p] if known is None else known for p, known in zip(every, ids, strict=True)], pa.large_binary()).take(pieces.indices)
        places = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1)[lists.offsets.to_numpy()].tolist()
        raw = memoryview(joined.buffers()[2] or b"")
        return [self.whole(t) if s is None else raw[a:b].tobytes() for t, s, a, b in zip(batch, spaced, places, places[1:], strict=False)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, sample_docs: int, dictionary_bytes: int) -> bytes:
    """Empty if the sample is too small to train on."""
    import zstandard

    short = docs.where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("doc_id"))
    least = short.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    rows = short.where(F.col("h") <= least).select("text").limit(sample_docs).collect() if least is not None else []
    enc = encoder(tokenizer)
    samples = [x + np.array([end_id], enc.dtype).tobytes() for x in enc.encode([r[0] for r in rows])]
    try:
        return zstandard.train_dictionary(min(dictionary_bytes, sum(map(len, samples)) // 8), samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class _Shard:
    """One open file: frames now, index and footer at the end."""

    def __init__(self, root: str, name: str, dictionary: bytes, level: int, width: int):
        import zstandard

        self.fs, self.root = _fs(root)
        self.name, self.part = name, f".{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{self.root}/{self.part}", compression=None)
        self.out.write(MAGIC)
        d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if d:
            d.precompute_compress(level=level)
        self.press = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=True)
        self.width, self.sha = width, hashlib.sha256(dictionary).hexdigest()
        self.ids, self.nulls, self.offsets, self.counts = [], [], [len(MAGIC)], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.press.compress(ids)
        self.out.write(frame)
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.counts.append(len(ids) // self.width)

    def close(self) -> dict:
        foot = {"docs": len(self.ids), "tokens": int(sum(self.counts)), "width": self.width, "dictionary_sha256": self.sha, "index": self.offsets[-1]}
        self.out.write(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.offsets, "<u8").tobytes() + np.array(self.counts, "<u4").tobytes())
        raw = json.dumps(foot).encode()
        self.out.write(raw + struct.pack("<I", len(raw)))
        self.out.close()
        self.fs.move(f"{self.root}/{self.part}", f"{self.root}/{self.name}")
        return foot


def blocks(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
    """The rows (doc_id, text) in blocks: one ends with the row in which its texts pass BLOCK_BYTES."""
    cuts, size = [0], 0
    for at, n in enumerate(pc.binary_length(batch.column(1)).to_pylist(), 1):
        size += n
        if size > BLOCK_BYTES:
            cuts.append(at)
            size = 0
    return [batch.slice(a, b - a) for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True) if b > a]


def write_token_files(docs: DataFrame, root: str, tokenizer: str, end_id: int = 1, files: int | None = None, level: int = 3, sample_docs: int = 400, dictionary_bytes: int = 65_536) -> DataFrame:
    """Writes the files and returns the manifest: file, part, docs, tokens, dictionary_sha256 (one row a file).

    root: a URI of a folder that executors share (file:, hdfs:, s3:, ... as pyarrow opens them).
    """
    spark = docs.sparkSession
    docs = texts(docs)
    dictionary = train_dictionary(docs, tokenizer, end_id, sample_docs, dictionary_bytes)
    store, base = _fs(root)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/dictionary.zdict") as f:
        f.write(dictionary)
    held = spark.sparkContext.broadcast(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        shard = None
        end = np.array([end_id], enc.dtype).tobytes()
        for whole in batches:
            for batch in blocks(whole):
                shard = shard or _Shard(root, f"part-{part:06d}.fltok", held.value, level, enc.dtype.itemsize)
                for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                    shard.add(doc_id, ids + end)
        if shard:
            foot = shard.close()
            yield pa.RecordBatch.from_pylist([{"file": shard.name, "part": part, "docs": foot["docs"], "tokens": foot["tokens"], "dictionary_sha256": foot["dictionary_sha256"]}])

    kind = "file string, part long, docs long, tokens long, dictionary_sha256 string"
    dealt = docs.repartitionByRange(files or partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    rows = dealt.mapInArrow(write, kind).collect()  # one row a file
    return spark.createDataFrame(rows, kind)


def open_index(root: str, name: str, dictionary: bytes | None = None):
    """(random-access file, footer, doc_ids with None, offsets, counts)."""
    store, base = _fs(root)
    f = store.open_input_file(f"{base}/{name}")
    size = f.size()
    f.seek(size - 4)
    n = struct.unpack("<I", f.read(4))[0]
    f.seek(size - 4 - n)
    foot = json.loads(f.read(n))
    docs = foot["docs"]
    f.seek(foot["index"])
    raw = f.read(size - 4 - n - foot["index"])
    ids = np.frombuffer(raw, "<i8", docs)
    nulls = np.frombuffer(raw, "u1", docs, 8 * docs)
    offsets = np.frombuffer(raw, "<u8", docs + 1, 9 * docs)
    counts = np.frombuffer(raw, "<u4", docs, 9 * docs + 8 * (docs + 1))
    if dictionary is not None and hashlib.sha256(dictionary).hexdigest() != foot["dictionary_sha256"]:
        raise ValueError(f"{name} was written with another dictionary")
    return f, foot, [None if z else int(i) for i, z in zip(ids, nulls, strict=True)], offsets, counts


def load_dictionary(root: str) -> bytes:
    store, base = _fs(root)
    with store.open_input_stream(f"{base}/dictionary.zdict", compression=None) as f:
        return f.read()


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def read_document(root: str, name: str, at: int) -> list[int]:
    """The ids of the document at a place of one file, reading only the index and its frame."""
    dictionary = load_dictionary(root)
    f, foot, _, offsets, _ = open_index(root, name, dictionary)
    with f:
        f.seek(int(offsets[at]))
        raw = _decompressor(dictionary).decompress(f.read(int(offsets[at + 1] - offsets[at])))
    return np.frombuffer(raw, f"<u{foot['width']}").tolist()


def read_token_files(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary: little-endian unsigned 32-bit), in file order."""
    files = sorted(manifest.collect(), key=lambda r: r["part"])
    starts, total = [], 0
    for r in files:
        starts.append((r["file"], total))
        total += r["tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = load_dictionary(root)
        press = _decompressor(dictionary)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                f, foot, ids, offsets, counts = open_index(root, name, dictionary)
                firsts = start + np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                with f:
                    for a in range(0, len(ids), 256):
                        b = min(len(ids), a + 256)
                        f.seek(int(offsets[a]))
                        raw = f.read(int(offsets[b] - offsets[a]))
                        frames = [raw[int(x - offsets[a]) : int(y - offsets[a])] for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1], strict=True)]
                        wide = [np.frombuffer(press.decompress(x), f"<u{foot['width']}").astype("<u4").tobytes() for x in frames]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(firsts[a:b], pa.int64()), pa.array(counts[a:b].astype(np.int64)), pa.array(wide, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    rows = spark.createDataFrame(starts, "file string, start long").repartition(len(starts))
    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
