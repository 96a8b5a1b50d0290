"""SentencePiece encoding and decoding over a distinct-chunk table.

In the models served here no piece holds a whitespace marker after another character, so
no merge crosses from a character to a marker: a text falls into chunks, each a run of
markers and the characters up to the next marker, and chunks are segmented one by one.
The chunks of a block of documents are looked up in a table of distinct chunks; only new
ones are segmented, by the library, once; the ids are then joined back by the chunks'
positions.  A table belongs to one Python worker, holds up to `table_chunks` short chunks,
and is begun anew when full: memory is bounded and no chunk has to be shuffled.

A model for which this does not hold (pieces across markers, a normalizer, user-defined
symbols, no dummy prefix) is applied to whole texts, with the same results.

Results for odd input: a null or empty text has only the begin and end ids; texts of any
length are encoded whole, and so are chunks of more than HELD_CHARS characters; repeated rows
are kept; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import texts

#: Longer chunks are encoded when they occur and not held.
HELD_CHARS = 64
MARK = "▁"
CHUNK = re.compile(f" *[^ ]+| +")


class ChunkTable:
    def __init__(self, model: str, table_chunks: int):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size, self.ids = table_chunks, {}
        self.mark = array("I", [self.library.piece_to_id(MARK)]).tobytes()
        self.separable = self._separable()

    def _separable(self) -> bool:
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto.FromString(self.library.serialized_model_proto())
        n = model.normalizer_spec
        plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        return plain and not any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED or re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces)

    def _segment(self, chunks: list[str]) -> list[bytes]:
        """Each chunk begins with a space, which the library's dummy prefix stands for."""
        found = self.library.encode([c[1:] for c in chunks], num_threads=1)
        return [array("I", ids).tobytes() if len(c) > 1 else self.mark for c, ids in zip(chunks, found, strict=True)]

    def encode(self, batch: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without begin and end."""
        if not self.separable:
            return [array("I", ids).tobytes() for ids in self.library.encode(batch, num_threads=1)]
        split = [CHUNK.findall(" " + t.replace(MARK, " ")) if t else [] for t in batch]
        new = {c for chunks in split for c in chunks}.difference(self.ids)
        if len(self.ids) + len(new) > self.size:
            self.ids, new = {}, {c for chunks in split for c in chunks}
        new = list(new)
        self.ids.update(zip(new, self._segment(new), strict=True))
        out = [b"".join(map(self.ids.__getitem__, chunks)) for chunks in split]
        for c in new:
            if len(c) > HELD_CHARS:
                del self.ids[c]
        return out


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model: str, table_chunks: int) -> ChunkTable:
    if model not in _TABLES:
        _TABLES[model] = ChunkTable(model, table_chunks)
    return _TABLES[model]


def encode(docs: DataFrame, model: str, table_chunks: int = 600_000, block: int = 256) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit, with begin and end ids), decoded (the library's decode of all ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model, table_chunks)
        begin, end = (array("I", [i]).tobytes() for i in (table.library.bos_id(), table.library.eos_id()))
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                ids = [begin + x + end for x in table.encode(batch.column(1).to_pylist())]
                decoded = [table.library.decode(array("I", x).tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
