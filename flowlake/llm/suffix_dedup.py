"""Suffix-array deduplication of bytes by depth-limited digits.

The suffixes of all documents are compared through `length` bytes only, by the passes of
`windows`, in which a suffix leaves as soon as it is alone; suffixes that are still equal
after the last digit are exactly the repeated `length`-byte strings.  Each byte covered by a
string that also starts earlier is removed; strings are judged on the input.

The digits are those of `windows` (anchor, stretch, window), not leading bytes: a radix sort
that sends every suffix needs more than the disk that is given (figures in the README).

Results for odd input: see `windows`; null and empty texts are kept, empty; rows that repeat
a doc_id are separate documents, ordered by text, so the later of two equal rows loses what
the first keeps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlake.llm import windows
from flowlake.llm.common import Carried

KIND = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def whole_characters(data: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mask without bytes of characters of which it has a part only."""
    head = np.flatnonzero(data & 0xC0 != 0x80)
    if not len(head) or head[0]:
        head = np.concatenate([[0], head])
    whole = np.logical_and.reduceat(mask, head)
    return np.repeat(whole, np.diff(np.append(head, len(data))))


def cut(chunk: windows.Chunk, mask: np.ndarray, characters: bool) -> pa.Table:
    if characters and mask.any():
        mask = whole_characters(chunk.data, mask)
    counts = np.concatenate([[0], np.cumsum(mask)])
    removed = counts[chunk.offsets[1:]] - counts[chunk.offsets[:-1]]
    spans, kept = [], []
    for d, text in enumerate(chunk.text):
        if not removed[d]:
            spans.append([])
            kept.append(text)
            continue
        a, b = chunk.offsets[d], chunk.offsets[d + 1]
        spans.append([{"start": x, "end": y} for x, y in spans_of(mask[a:b])])
        kept.append(chunk.data[a:b][~mask[a:b]].tobytes())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": pa.array(chunk.doc_id, pa.int64()), "n_bytes": pa.array(np.diff(chunk.offsets)), "n_removed": pa.array(removed.astype(np.int64)), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})


def suffix_dedup(docs: DataFrame, length: int = 100, gram: int = 50, chunk_bytes: int = 2 << 20, characters: bool = False, carry: tuple[str, ...] = (), hot: int = windows.HOT, salts: int = windows.SALTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (maximal removed runs of bytes), kept (the other bytes), and the columns named in carry.

    characters: a character of which only a part is repeated stays, so kept is valid UTF-8.
    """
    spec = windows.Spec("bytes", length, min(gram, length))
    carried = Carried(docs, carry, ("doc_id", "n_bytes", "n_removed", "spans", "kept"))
    shape = windows.shape(docs, chunk_bytes, (length - gram) // 2 + 1)
    buckets, inside = shape.buckets, carried.inside
    rows = shape.spread(windows.dealt(docs, shape.chunks, carry=carried.columns))
    prints = rows.groupBy("chunk").applyInArrow(windows.lean(lambda t: windows.fingerprints(t, spec, buckets)), windows.PRINTS)
    matched = prints.groupBy("bucket").applyInArrow(windows.match(hot), windows.MATCHED)
    found = windows.repeats(rows, matched, spec, buckets, 0, hot, salts)

    def finish(a: pa.Table, b: pa.Table) -> pa.Table:
        chunk, mask = windows.covered(a, b, spec)
        out = cut(chunk, mask, characters)
        for c in inside:
            out = out.append_column(c, a.column(c).take(pa.array(chunk.order, pa.int64())))
        return out

    return carried.back(rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(windows.lean(finish), KIND + carried.schema))
