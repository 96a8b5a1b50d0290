"""Repeated windows over token sequences: the shared passes of substring deduplication.

A window is `length` consecutive tokens (bytes or words) of one document.  The passes find,
exactly, every window whose token sequence also starts earlier: at a smaller doc_id, or in
the same document further left.  A window that is alone with its digits so far leaves the
sort, and windows equal in the last digit are repeats.

digit 1  The `gram` tokens at the window's anchor: the leftmost smallest hash of a run of
         `gram` tokens inside the window.  Equal windows have equal anchors at the same
         offset, and neighbouring windows mostly share one, so a chunk of documents sends
         one 4-byte fingerprint for each distinct anchor.  (Fingerprints of unlike anchors
         may agree; that costs work and no result.)
digit 2  The stretch of neighbouring windows with one anchor.  Stretches equal as a whole
         (128 bits) are equal window by window: all but the earliest are repeats.
digit 3  Where stretches that differ share digit 1, their windows, again by 128 bits.
         Fingerprints come first here too, as most of these windows are alone.

Equality is decided by 128 bits in two lanes, made from the tokens themselves by steps that
mix their bits (no polynomial of the tokens, so no pair of texts collides by its form).

What is sent of a chunk holds each value once, with its earliest place, so a passage that
a third of all documents share reaches a task once per chunk, and nothing is ever paired
with anything.  Values that more than `HOT` chunks hold are told to the chunks as hot; they
are keyed by their stretch and reduced in SALTS parts before all of their rows meet, so a
task sees at most chunks / SALTS rows of one value.  Texts are dealt to chunks once; the
passes use that one exchange again and each recomputes hashes instead of storing them.

Order and odd input: rows with equal doc_id are ordered by text; rows without doc_id come
before all others; null and empty texts and documents with fewer tokens than a window have
no repeats; documents of any length are hashed in overlapping segments of SEGMENT tokens;
an empty table gives no rows.  Columns named in carry may have any name, ones that are used
here too; a name that the operator itself returns is the operator's (see common.Carried).
"""

from __future__ import annotations

import ctypes
import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlake.llm.common import measure, partitions, texts

SEGMENT = 1 << 15
#: Anchor order: hash bits first, then the position, so that the leftmost of equals is taken.
PLACE = np.uint64((1 << 24) - 1)
SEQ = 40
NULL_ID = -(1 << 63)
U = np.uint64


def lean(f):
    """f, after which the Python worker gives freed memory back; idle workers would else keep their peak."""

    def run(*tables: pa.Table) -> pa.Table:
        try:
            return f(*tables)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):
                pass

    return (lambda a: run(a)) if f.__code__.co_argcount == 1 else (lambda a, b: run(a, b))


class Spec(NamedTuple):
    """tokens: 'bytes' or 'words'; length: tokens of a window; gram: tokens of an anchor."""

    tokens: str
    length: int
    gram: int


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finalizer of SplitMix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Of each lane: factors of the left and the right half, and what tells the lanes' bytes apart.
LANES = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x243F6A8885A308D3), (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x13198A2E03707344))


def paired(a: np.ndarray, b: np.ndarray, lane: int) -> np.ndarray:
    """One value of two in order; either is a bijection while the other stays, and no sum of pairs is a pair of sums."""
    left, right, _ = LANES[lane]
    x = a * U(left)
    x += b * U(right)
    return stirred(x)


def stirred(x: np.ndarray) -> np.ndarray:
    """A lighter bijection, in place, for steps that others follow."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    return x


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, U)
    for i in range(min(8, n)):
        count = (n - i + 7) // 8
        out[i::8] = padded[i : i + 8 * count].view("<u8")
    return out


class Runs:
    """Hashes of all runs of `k` tokens, by doubling: a run is two shorter ones that cover it.

    tokens: bytes (uint8), of which eight are one exact integer, or word digests (uint64).
    """

    def __init__(self, lane: int, tokens: np.ndarray):
        self.lane, self.tokens, self.levels = lane, tokens, {}
        self.base = 8 if tokens.dtype == np.uint8 else 1

    def _leaf(self, k: int) -> np.ndarray:
        """Runs of at most `base` tokens."""
        if self.base == 1:
            return self.tokens
        out = loads(self.tokens)[: len(self.tokens) - k + 1]
        if k < 8:
            out &= U((1 << 8 * k) - 1)
        out ^= U(LANES[self.lane][2])
        return stirred(out)

    def of(self, k: int) -> np.ndarray:
        held = self.levels.get(k)
        if held is None:
            if len(self.tokens) < k:
                return np.empty(0, U)
            half = self.base
            while 2 * half < k:
                half *= 2
            n = len(self.tokens) - k + 1
            if k <= self.base:
                held = self._leaf(k)
            else:
                h = self.of(half)
                held = paired(h[:n], h[k - half : k - half + n], self.lane)
            self.levels[k] = held
        return held

    def spans(self, start: np.ndarray, end: np.ndarray, least: int, most: int) -> np.ndarray:
        """Hashes of ranges of `least` to `most` tokens: their length, and blocks that cover them, which `least` holds twice."""
        block = self.base
        while 4 * block <= least:
            block *= 2
        block = min(block, least)
        h = self.of(block)
        out = mixed((end - start).astype(U))
        for at in range(0, most, block):
            out = paired(out, h[np.minimum(start + at, end - block)], self.lane)
        return out


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at a time, and the longest word whose digest is made by columns.
SLICE, LONG_WORD = 1 << 19, 256
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], U)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word in two lanes: chained over its eights of bytes, or of BLAKE2 for long words."""
    out = (np.empty(len(starts), U), np.empty(len(starts), U))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        base = int(starts[a])
        eights = loads(data[base : ends[b - 1]] if ends[a] - starts[a] <= LONG_WORD or b > a + 1 else data[:0])
        at, size = starts[a:b] - base, ends[a:b] - starts[a:b]
        state = [mixed(size.astype(U) ^ U(LANES[lane][2])) for lane in (0, 1)]
        live = np.flatnonzero(size <= LONG_WORD)
        for k in range(0, LONG_WORD, 8):
            live = live[size[live] > k] if k else live
            if not len(live):
                break
            block = eights[at[live] + k] & LOW_BYTES[np.minimum(size[live] - k, 8)]
            for lane in (0, 1):
                state[lane][live] = paired(state[lane][live], stirred(block ^ U(LANES[lane][2])), lane)
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(data[starts[a + i] : ends[a + i]].tobytes(), digest_size=16).digest()
            state[0][i], state[1][i] = np.frombuffer(digest, "<u8")
        for lane in (0, 1):
            out[lane][a:b] = mixed(state[lane])
        a = b
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours, by block-wise prefix and suffix minima."""
    if w == 1:
        return x
    m = len(x) - w + 1
    blocks = np.full(-(-len(x) // w) * w, np.iinfo(U).max, U)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])


class Chunk:
    """The documents of a chunk in order, and their tokens."""

    def __init__(self, rows: pa.Table, spec: Spec):
        rows = rows.combine_chunks()
        text = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.binary())
        text = (text.chunk(0) if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_binary())
        ids = rows.column("doc_id").to_pylist()
        raw = text.to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (NULL_ID if ids[i] is None else ids[i], raw[i]))
        self.order = order
        self.doc_id = [ids[i] for i in order]
        self.text = [raw[i] for i in order]
        self.ids = np.array([NULL_ID if i is None else i for i in self.doc_id], np.int64)
        self.seq = np.arange(len(order)) - np.searchsorted(self.ids, self.ids)
        self.spec = spec
        if spec.tokens == "words":
            self._words()
        else:
            self.data = np.frombuffer(b"".join(self.text), np.uint8)
            self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in self.text], dtype=np.int64)]).astype(np.int64)

    def folded(self, text: bytes) -> bytes:
        """The text whose words count."""
        return text

    def _words(self) -> None:
        """Word ranges by a mask of white space, then the words' digests."""
        data = np.frombuffer(b"".join(map(self.folded, self.text)), np.uint8)
        cuts = np.concatenate([[0], np.cumsum([len(t) for t in self.text], dtype=np.int64)]).astype(np.int64)
        gap = SPACE[data]
        edge = np.ones(len(gap) + 1, bool)
        edge[1:] = gap
        edge[cuts[:-1]] = True
        starts = np.flatnonzero(~gap & edge[:-1])
        edge[:-1] = gap
        edge[cuts] = True
        ends = np.flatnonzero(~gap & edge[1:]) + 1
        self.offsets = np.searchsorted(starts, cuts).astype(np.int64)
        self.words = digests(data, starts, ends)

    def values(self, which: int, a: int, b: int) -> np.ndarray:
        return self.words[which][a:b] if self.spec.tokens == "words" else self.data[a:b]

    def place(self, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc_id (nulls smallest) and position, which together order occurrences."""
        return self.ids[doc], (self.seq[doc].astype(np.int64) << SEQ) | start

    def locate(self, ids: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """The token, counted through the chunk, of each place."""
        doc = np.searchsorted(self.ids, ids) + (pos >> SEQ)
        return self.offsets[doc] + (pos & ((1 << SEQ) - 1))

    def slabs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces (first token in the chunk, tokens), whole documents or segments, in lots of about SEGMENT tokens."""
        length = self.spec.length
        first, size, total = [], [], 0
        for d in range(len(self.ids)):
            a, b = int(self.offsets[d]), int(self.offsets[d + 1])
            while b - a >= length:
                n = min(b - a, SEGMENT)
                if total and total + n > SEGMENT:
                    yield np.array(first), np.array(size)
                    first, size, total = [], [], 0
                first.append(a)
                size.append(n)
                total += n
                if a + n == b:
                    break
                a += n - length + 1
        if first:
            yield np.array(first), np.array(size)

    def stretches(self, full: bool) -> tuple[np.ndarray, ...]:
        """Runs of windows with one anchor: first token in the chunk, windows, anchor hash; with full, also both hashes of the stretch."""
        length, gram = self.spec.length, self.spec.gram
        found = []
        for first, size in self.slabs():
            runs = Runs(0, np.concatenate([self.values(0, a, a + n) for a, n in zip(first, size, strict=True)]))
            anchors = runs.of(gram)
            keys = (anchors & ~PLACE) | np.arange(len(anchors), dtype=U)
            least = sliding_min(keys, length - gram + 1)
            piece = np.repeat(np.arange(len(size)), size)
            window = np.flatnonzero(piece[: len(least)] == piece[length - 1 : length - 1 + len(least)])
            anchor = (least[window] & PLACE).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            start, n = window[cut], np.diff(np.append(cut, len(window)))
            shift = (first - np.concatenate([[0], np.cumsum(size)[:-1]]))[piece[start]]
            out = [start + shift, n, anchors[anchor[cut]]]
            if full:
                other = Runs(1, np.concatenate([self.values(1, a, a + m) for a, m in zip(first, size, strict=True)]))
                out += [r.spans(start, start + n - 1 + length, length, 2 * length - gram) for r in (runs, other)]
            found.append(out)
        if not found:
            return tuple(np.empty(0, t) for t in ((np.int64, np.int64, U) + (U, U) * full))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def windows(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of the given stretches: first token in the chunk and both hashes."""
        token = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n) + np.arange(int(n.sum()))
        token.sort()
        out = (np.empty(len(token), U), np.empty(len(token), U))
        length = self.spec.length
        for begin, size in self.slabs():
            a = np.searchsorted(token, begin)
            b = np.searchsorted(token, begin + size - length, "right")
            hit = b > a
            if not hit.any():
                continue
            a, b = a[hit], b[hit]
            t0, t1 = token[a], token[b - 1] + length
            shift = t0 - np.concatenate([[0], np.cumsum(t1 - t0)[:-1]])
            at = np.concatenate([token[lo:hi] - s for lo, hi, s in zip(a, b, shift, strict=True)])
            into = np.concatenate([np.arange(lo, hi) for lo, hi in zip(a, b, strict=True)])
            for which in (0, 1):
                out[which][into] = Runs(which, np.concatenate([self.values(which, x, y) for x, y in zip(t0, t1, strict=True)])).of(length)[at]
        return token, *out

    def doc_of(self, token: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, token, "right") - 1

    def places(self, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc = self.doc_of(token)
        return self.place(doc, token - self.offsets[doc])


def later(*keys: np.ndarray) -> np.ndarray:
    """Which rows have an equal row before them.  Rows are in order of place already."""
    order = np.lexsort((np.arange(len(keys[0])), *keys[::-1]))
    same = np.ones(max(0, len(order) - 1), bool)
    for k in keys:
        same &= k[order][1:] == k[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[1:][same]] = True
    return out


def sorted_stretches(chunk: Chunk, full: bool) -> list[np.ndarray]:
    found = chunk.stretches(full)
    order = np.argsort(found[0], kind="stable")
    return [x[order] for x in found]


def bucket_key(anchor: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return (anchor >> U(32)) % U(buckets), (anchor & U(0xFFFFFFFF)).astype(np.uint32)


# The passes.  Each takes the documents of one chunk or the fingerprints of one bucket.


def prints_of(hashes: np.ndarray, chunk: int, buckets: int) -> pa.Table:
    """bucket, chunk, fps (sorted distinct 32-bit fingerprints) of the hashes."""
    bucket, fp = bucket_key(np.unique(hashes), buckets)
    order = np.lexsort((fp, bucket))
    bucket, fp = bucket[order], fp[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
    parts = [np.unique(x).astype("<u4").tobytes() for x in np.split(fp, cut[1:])] if len(cut) else []
    return pa.table({"bucket": pa.array(bucket[cut].astype(np.int64)), "chunk": pa.array([chunk] * len(cut), pa.int64()), "fps": pa.array(parts, pa.binary())})


def fingerprints(rows: pa.Table, spec: Spec, buckets: int) -> pa.Table:
    """Digit 1 of a chunk."""
    return prints_of(Chunk(rows, spec).stretches(False)[2], rows.column("chunk")[0].as_py(), buckets)


def match(hot: int):
    """Of one bucket: which fingerprints several chunks hold."""

    def run(rows: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, "<u4") for x in rows.column("fps").to_pylist()]
        chunks = np.repeat(rows.column("chunk").to_numpy(), [len(x) for x in parts])
        fps = np.concatenate(parts)
        order = np.argsort(fps, kind="stable")  # merges the sorted lists
        return told(chunks[order], fps[order], rows.column("bucket")[0].as_py(), hot)

    return run


PRINTS, MATCHED = "bucket long, chunk long, fps binary", "chunk long, bucket long, fps binary, hot binary"
#: A value that so many chunks hold is hot; its rows are reduced in SALTS parts first.
HOT, SALTS = 4096, 1024


def split_by(own: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, list[list[bytes]]]:
    """The distinct values of `own`, which is sorted, and the bytes of each column's rows for each."""
    cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, np.int64)
    return own[cut], [[x.tobytes() for x in np.split(c, cut[1:])] if len(cut) else [] for c in columns]


def told(chunks: np.ndarray, fps: np.ndarray, bucket: int, hot: int) -> pa.Table:
    """Of sorted fingerprints those that several chunks hold: chunk, bucket, fps, hot (a byte for each: whether more than `hot` chunks do)."""
    at = np.flatnonzero(np.concatenate([[True], fps[1:] != fps[:-1]])) if len(fps) else np.empty(0, np.int64)
    sizes = np.diff(np.append(at, len(fps)))
    count = np.repeat(sizes, sizes)
    take = count > 1
    chunks, fps, count = chunks[take], fps[take], count[take]
    order = np.lexsort((fps, chunks))
    own, (prints, marks) = split_by(chunks[order], fps[order].astype("<u4"), (count[order] > hot).astype(np.uint8))
    return pa.table({"chunk": pa.array(own.astype(np.int64)), "bucket": pa.array([bucket] * len(own), pa.int64()), "fps": pa.array(prints, pa.binary()), "hot": pa.array(marks, pa.binary())})


STRETCH = "h long, r1 long, r2 long, doc long, pos long, n long, chunk long, state int, hot boolean"
#: Of a stretch: one of its anchor's here; the first of several; one of several; stretches equal to others before them here.
ONE, SEVERAL, DIFFERENT, AGAIN = range(4)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


class Known:
    """The fingerprints of a chunk that others hold too, from its rows of MATCHED."""

    def __init__(self, found: pa.Table, buckets: int):
        self.buckets = buckets
        if found.num_rows:
            found = found.filter(pa.compute.is_valid(found.column("fps")))
        columns = [found.column(c).to_pylist() if found.num_rows else [] for c in ("bucket", "fps", "hot")]
        keys = [(U(b) << U(32)) | np.frombuffer(x, "<u4").astype(U) for b, x, _ in zip(*columns, strict=True)]
        hot = [np.frombuffer(h, np.uint8) for h in columns[2]]
        keys, hot = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((keys, U), (hot, np.uint8)))
        order = np.argsort(keys)
        self.keys, self.hot = keys[order], hot[order] > 0

    def of(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is known, and whether it is hot."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
        bucket, fp = bucket_key(hashes, self.buckets)
        key = (bucket << U(32)) | fp.astype(U)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        good = self.keys[at] == key
        return good, good & self.hot[at]


def joined_runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches that follow each other without a gap as one."""
    cut = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1] + n[:-1]])) if len(first) else np.empty(0, np.int64)
    return first[cut], np.add.reduceat(n, cut) if len(cut) else n


def candidates(rows: pa.Table, matched: pa.Table, spec: Spec, buckets: int, live_from: int) -> pa.Table:
    """Digit 2 of a chunk.

    An anchor that other chunks hold is sent once, with its stretch, or the earliest where it
    has several here.  Several stretches of an anchor, and those of hot ones, are also sent one
    by one, keyed by themselves, to have their windows compared; stretches equal to earlier
    ones here are told as they are, keyed by their place.
    """
    kind = ("h", "r1", "r2", "doc", "pos", "n", "chunk")
    if not rows.num_rows or not matched.num_rows and rows.column("chunk")[0].as_py() < live_from:
        return pa.table({k: pa.array([], pa.int64()) for k in kind} | {"state": pa.array([], pa.int32()), "hot": pa.array([], pa.bool_())})
    chunk = Chunk(rows, spec)
    first, n, anchor, r1, r2 = sorted_stretches(chunk, True)
    again = later(r1, r2, anchor)
    repeat, size = joined_runs(first[again], n[again])
    first, n, anchor, r1, r2 = (x[~again] for x in (first, n, anchor, r1, r2))
    _, at, count = np.unique(anchor, return_inverse=True, return_counts=True)
    known, hot = Known(matched, buckets).of(anchor)
    several = (count[at] > 1) | hot
    sent = ~later(anchor) & known & ~hot
    own = rows.column("chunk")[0].as_py()
    place = mixed(repeat.astype(U) ^ mixed(np.full(len(repeat), own + 1).astype(U)))
    parts = (
        (anchor[sent], r1[sent], r2[sent], first[sent], n[sent], np.where(several[sent], SEVERAL, ONE), np.zeros(int(sent.sum()), bool)),
        (r1[several], r1[several], r2[several], first[several], n[several], np.full(int(several.sum()), DIFFERENT), hot[several]),
        (place, place, place, repeat, size, np.full(len(repeat), AGAIN), np.zeros(len(repeat), bool)),
    )
    h, r1, r2, first, n, state, hot = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc, pos = chunk.places(first)
    return pa.table({"h": signed(h), "r1": signed(r1), "r2": signed(r2), "doc": pa.array(doc), "pos": pa.array(pos), "n": pa.array(n.astype(np.int64)), "chunk": pa.array(np.full(len(doc), own, np.int64)), "state": pa.array(state.astype(np.int32)), "hot": pa.array(hot)})


def located(chunk: Chunk, found: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """First token in the chunk and windows of what `found` tells about it."""
    if not found.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    found = found.filter(pa.compute.equal(found.column("kind"), kind))
    ids, pos, n = (found.column(c).to_numpy() for c in ("doc", "pos", "n"))
    return chunk.locate(ids, pos), n


def open_windows(chunk: Chunk, found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the stretches that differ from others with their anchor, here or elsewhere: first token in the chunk, both hashes."""
    first, n = located(chunk, found, OPEN)
    first, at = np.unique(first, return_index=True)
    return chunk.windows(first, n[at])


def window_fingerprints(rows: pa.Table, found: pa.Table, spec: Spec, buckets: int) -> pa.Table:
    """Digit 3 of a chunk, first by fingerprints."""
    if not rows.num_rows or not found.num_rows:
        return prints_of(np.empty(0, U), 0, buckets)
    return prints_of(open_windows(Chunk(rows, spec), found)[1], rows.column("chunk")[0].as_py(), buckets)


def repeated_windows(rows: pa.Table, found: pa.Table, spec: Spec, buckets: int) -> pa.Table:
    """Digit 3 of a chunk: of the windows whose fingerprint other chunks hold, each distinct one at its earliest place."""
    known = Known(found, buckets)
    if not rows.num_rows or not len(known.keys):
        return pa.table({k: pa.array([], pa.int64()) for k in ("w1", "w2", "doc", "pos", "chunk")} | {"hot": pa.array([], pa.bool_())})
    chunk = Chunk(rows, spec)
    token, w1, w2 = open_windows(chunk, found)
    take, hot = known.of(w1)
    token, w1, w2, hot = token[take], w1[take], w2[take], hot[take]
    once = ~later(w1, w2)
    doc, pos = chunk.places(token[once])
    own = rows.column("chunk")[0].as_py()
    return pa.table({"w1": signed(w1[once]), "w2": signed(w2[once]), "doc": pa.array(doc), "pos": pa.array(pos), "chunk": pa.array(np.full(len(doc), own, np.int64)), "hot": pa.array(hot[once])})


REPEAT, OPEN = 0, 1


def covered(rows: pa.Table, found: pa.Table, spec: Spec) -> tuple[Chunk, np.ndarray]:
    """The chunk, and for each of its tokens whether a repeated window covers it."""
    chunk = Chunk(rows, spec)
    at, m = located(chunk, found, REPEAT)
    token, w1, w2 = open_windows(chunk, found)
    token = token[later(w1, w2)]
    begin, size = [at, token], [m, np.ones(len(token), np.int64)]
    begin, size = np.concatenate(begin), np.concatenate(size)
    total = int(chunk.offsets[-1]) if len(chunk.offsets) else 0
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, begin, 1)
    np.subtract.at(change, begin + size - 1 + spec.length, 1)
    np.cumsum(change, out=change)
    return chunk, change[:total] > 0


def chunk_key(chunks: int, offset: int = 0):
    """A document's chunk: a function of doc_id, or of the text where that is null."""
    return (F.pmod(own_hash(), F.lit(chunks)) + F.lit(offset)).cast("long")


def own_hash():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def dealt(docs: DataFrame, chunks: int, offset: int = 0, carry: tuple = ()) -> DataFrame:
    """doc_id, text (binary), chunk and the columns in carry."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(doc_id.alias("doc_id"), text.cast("binary").alias("text"), chunk_key(chunks, offset).alias("chunk"), *carry)


#: Text bytes of one task of a pass, and the most chunks that documents are dealt to.
TASK_BYTES, MOST_CHUNKS = 1 << 28, 1 << 22


class Shape(NamedTuple):
    chunks: int
    buckets: int
    tasks: int

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by chunk to so many tasks, where the session's number is too small for them."""
        return rows.repartition(self.tasks, "chunk") if self.tasks > partitions(rows.sparkSession) else rows


def shape(docs: DataFrame, chunk_bytes: int, token_bytes: int) -> Shape:
    """Chunks, buckets and tasks for these documents: all grow with the text, and there are some for every shuffle partition.

    A chunk may send a row to each bucket, so there are no more buckets than memory asks for:
    4 million fingerprints each; chunks grow once there are MOST_CHUNKS.
    """
    _, size = measure(texts(docs))
    n = partitions(docs.sparkSession)
    chunks = min(MOST_CHUNKS, math.ceil(size / chunk_bytes))
    return Shape(max(2 * n, chunks), max(n, math.ceil(size / token_bytes / (1 << 22))), math.ceil(size / TASK_BYTES))


def earliest(rows: DataFrame, keys: tuple[str, ...], salts: int, *more) -> DataFrame:
    """Rows with their rank among those of equal keys, by place, and the columns in more.

    All rows of a key meet in one task, but hot ones first in `salts` parts, of which only the first of each goes on.
    Conditions name the rank, so that none moves below the exchange and both branches read the same one.
    """
    place = ("doc", "pos", "chunk")
    parts = rows.withColumn("salt", F.when(F.col("hot"), F.pmod("chunk", F.lit(salts)) + 1).otherwise(0)).repartition(keys[0], "salt")
    first = parts.select("*", F.row_number().over(Window.partitionBy(*keys, "salt").orderBy(*place)).alias("rank"), *more)
    done = first.where(F.when(F.col("rank") > 1, True).otherwise(F.col("salt") == 0))
    left = first.where(F.when(F.col("rank") > 1, False).otherwise(F.col("salt") > 0))
    return done.unionByName(left.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*place)))).drop("salt")


def repeats(rows: DataFrame, matched: DataFrame, spec: Spec, buckets: int, live_from: int = 0, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """Digits 2 and 3: chunk, kind, doc, pos, n, by which `covered` knows the repeats of each chunk.

    rows: from dealt(); matched: chunk, bucket, fps, hot; chunks below live_from are history,
    whose repeats among themselves don't matter.
    """
    keyed = rows.groupBy("chunk")
    stretch = keyed.cogroup(matched.groupBy("chunk")).applyInArrow(lean(lambda a, b: candidates(a, b, spec, buckets, live_from)), STRETCH)
    alike = Window.partitionBy("h", "salt")
    unlike = (F.max("state").over(alike) > ONE) | (F.min("r1").over(alike) != F.max("r1").over(alike)) | (F.min("r2").over(alike) != F.max("r2").over(alike))
    ranked = earliest(stretch, ("h", "r1", "r2"), salts, unlike.alias("open")).where("rank > 1 or open or hot")
    known = ranked.select("chunk", F.when((F.col("rank") > 1) | (F.col("state") == AGAIN), REPEAT).otherwise(OPEN).alias("kind"), "doc", "pos", "n")
    prints = keyed.cogroup(known.groupBy("chunk")).applyInArrow(lean(lambda a, b: window_fingerprints(a, b, spec, buckets)), PRINTS)
    seen = prints.groupBy("bucket").applyInArrow(match(hot), MATCHED)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("kind", "int"), ("doc", "long"), ("pos", "long"), ("n", "long"))]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("bucket", "long"), ("fps", "binary"), ("hot", "binary"))]
    both = known.select("*", *nothing).unionByName(seen.select("chunk", *none, "bucket", "fps", "hot"))
    window = keyed.cogroup(both.groupBy("chunk")).applyInArrow(lean(lambda a, b: repeated_windows(a, b, spec, buckets)), "w1 long, w2 long, doc long, pos long, chunk long, hot boolean")
    twice = earliest(window, ("w1", "w2"), salts).where("rank > 1")
    return known.unionByName(twice.select("chunk", F.lit(REPEAT).alias("kind"), "doc", "pos", F.lit(1).cast("long").alias("n")))
