"""N-gram Jaccard join by T-occurrence search (DivideSkip), and the components of its links.

A document is its set of distinct word n-grams.  Two documents link when
100 * |A & B| >= percent * |A | B|.

1. Documents with equal sets (size and two 64-bit sums) form a class; only its smallest
   doc_id is searched, so copies cost nothing and are never paired.  A doc_id with several
   texts is searched with each set that it stands for, and links the classes of its texts.
2. Grams are counted over the classes.  A chunk of documents sends each of its grams once,
   as a 4-byte fingerprint with its count; of fingerprints that occur in several classes
   the count's magnitude comes back.  Every document orders its grams by it, rarest first.
3. A linked pair shares at least T = ceil(percent n / 100) grams of either of its n.  The
   lists of a document's last T - k grams are its long ones, the others its short ones; of
   two documents that link, k grams at least are short for both (k is the smaller of theirs,
   `least_short`).  Grams of a single class have no list, and documents with T - 1 others
   at most have no partners.
4. Before the search, every document is compared with one or two leaders of its short
   lists, and links found join components.  A short list within one component can add
   nothing and is dropped; this is what keeps large groups of near copies linear.
5. T-occurrence search for every document over its remaining short lists, divided by the sizes
   of their documents so that only sizes that can link meet: a heap merges them and keeps each
   candidate of another component that occurs k times (`merge_short`).  The long lists are then
   probed for each candidate left, by binary search in the candidate's sorted grams, until T is
   reached or can't be (`probe`).
6. Components of all links.

Lists are dealt in blocks of about `block` entries, and a document whose lists are long in
all is searched in parts by the candidate's hash, so no row and no group grows with the most
frequent gram.  Candidates are pairs that share k rare grams, not all pairs of a list; texts
built so that unlike documents share k of their rarest grams cost what those pairs cost.
Grams are 64-bit hashes of 128-bit word digests (see `windows`): two given sets of 1,000 grams
have a hash in common by chance with probability 1e-13.

Results for odd input: null, empty and blank texts have no grams and are components of
their own; fewer words than a gram count as one gram, the whole sequence; texts of any length
are whole sets; a tie, exactly `percent`, links; documents without doc_id have a null
component and join nothing; rows that repeat a doc_id are joined as one node, each with its own
number of grams; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm import windows
from flowlake.llm.common import SCRATCH, drop_scratch, texts, written, written_at
from flowlake.llm.components import components
from flowlake.llm.windows import U

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


class Grams(windows.Chunk):
    """Documents of a chunk with A-Z lowered, as sets of gram hashes."""

    def __init__(self, rows: pa.Table, n: int):
        self.n = n
        super().__init__(rows, windows.Spec("words", n, n))

    def folded(self, text: bytes) -> bytes:
        return text.translate(LOWER)

    def sets(self) -> Iterator[np.ndarray]:
        """Sorted distinct grams of each document."""
        n = self.n
        hashed = windows.mixed(windows.Runs(0, self.words[0]).of(n))
        for a, b in zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(hashed[a : b - n + 1])
            elif b > a:
                yield windows.mixed(windows.Runs(0, self.words[0][a:b]).of(b - a) + U(b - a))
            else:
                yield np.empty(0, U)


def least_overlap(n: int, percent: int) -> int:
    """Grams that a set of n shares at least with any set it links with."""
    return -(-percent * n // 100)


def links(n: int, m: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (n + m - both)


def needed(n: int, m: int, percent: int) -> int:
    return -(-percent * (n + m) // (100 + percent))


def least_short(n: int, percent: int) -> int:
    """Occurrences among the short lists that a set of n asks of a candidate."""
    return max(1, min(8, 1 + n // 16, least_overlap(n, percent)))


# 1. Classes.


def signature(g: np.ndarray) -> tuple[int, int, int]:
    return len(g), int(windows.mixed(g * U(windows.LANES[0][0])).sum(dtype=U)), int(windows.mixed(g ^ U(windows.LANES[1][2])).sum(dtype=U))


def signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            size = np.diff(whole.column(1).cast(pa.large_binary()).buffers()[1] and np.frombuffer(whole.column(1).cast(pa.large_binary()).buffers()[1], np.int64)[whole.column(1).offset : whole.column(1).offset + whole.num_rows + 1]) if whole.num_rows else np.empty(0)
            while at < whole.num_rows:  # lots of about 2 MB
                to = at + max(1, int(np.searchsorted(np.cumsum(size[at:]), 2 << 20)))
                rows = pa.Table.from_batches([whole.slice(at, to - at)])
                grams = Grams(rows, n)
                sums = [signature(g) for g in grams.sets()]
                cols = [np.array(c, U).view(np.int64) for c in zip(*sums, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(grams.doc_id, pa.int64()), *map(pa.array, cols)], ["doc_id", "n", "d1", "d2"])
                at = to

    return run


# 2. Counts of grams, by bucket, and back to the chunks.


def chosen(rows: pa.Table, reps: pa.Table, n: int) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Of the documents that stand for their class: place, doc_id, grams.  A doc_id with several texts can stand for several classes."""
    grams = Grams(rows, n)
    signs = zip(*(np.array(reps.column(c).to_pylist(), np.int64).view(U).tolist() for c in ("n", "d1", "d2")), strict=True)
    wanted = set(zip(reps.column("rep").to_pylist(), signs, strict=True))
    ids = {i for i, _ in wanted}
    times = Counter(grams.doc_id)
    out = ([], [], [])
    for i, g in enumerate(grams.sets()):
        doc = grams.doc_id[i]
        if not len(g) or doc not in ids:
            continue
        if times[doc] > 1:
            own = (doc, signature(g))
            if own not in wanted:
                continue
            wanted.remove(own)
        for x, y in zip(out, (i, doc, g), strict=True):
            x.append(y)
    return out


EMPTY_COUNTS = {"bucket": pa.int64(), "chunk": pa.int64(), "fps": pa.binary(), "many": pa.binary()}


def empty(kinds: dict) -> pa.Table:
    return pa.table({k: pa.array([], t) for k, t in kinds.items()})


def counted(rows: pa.Table, reps: pa.Table, n: int, buckets: int) -> pa.Table:
    """Fingerprints of a chunk by bucket; many: (index, count) pairs of those that several documents here hold."""
    grams = chosen(rows, reps, n)[2] if rows.num_rows and reps.num_rows else []
    if not grams:
        return empty(EMPTY_COUNTS)
    bucket, fp = windows.bucket_key(np.concatenate(grams), buckets)
    value, count = np.unique((bucket << U(32)) | fp.astype(U), return_counts=True)
    bucket = (value >> U(32)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    own, fps, many = rows.column("chunk")[0].as_py(), [], []
    for v, c in zip(np.split(value, cut[1:]), np.split(count, cut[1:]), strict=True):
        fps.append((v & U(0xFFFFFFFF)).astype("<u4").tobytes())
        at = np.flatnonzero(c > 1)
        many.append(np.column_stack([at, c[at]]).astype("<u4").tobytes())
    return pa.table({"bucket": pa.array(bucket[cut]), "chunk": pa.array([own] * len(cut), pa.int64()), "fps": pa.array(fps, pa.binary()), "many": pa.array(many, pa.binary())})


def summed(rows: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk its fingerprints that several documents hold, with the binary magnitude of their number."""
    parts = [np.frombuffer(x, "<u4") for x in rows.column("fps").to_pylist()]
    counts = []
    for x, m in zip(parts, rows.column("many").to_pylist(), strict=True):
        c = np.ones(len(x), np.int64)
        pairs = np.frombuffer(m, "<u4").reshape(-1, 2)
        c[pairs[:, 0]] = pairs[:, 1]
        counts.append(c)
    chunk, fp, count = np.repeat(np.arange(len(parts)), [len(x) for x in parts]), np.concatenate(parts), np.concatenate(counts)
    order = np.argsort(fp, kind="stable")
    fp, chunk = fp[order], chunk[order]
    at = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    total = np.add.reduceat(count[order], at)
    total = np.repeat(total, np.diff(np.append(at, len(fp))))
    keep = total > 1
    fp, chunk, size = fp[keep], chunk[keep], np.minimum(255, np.ceil(4 * np.log2(total[keep]))).astype(np.uint8)
    order = np.argsort(chunk, kind="stable")
    own, (prints, sizes) = windows.split_by(chunk[order], fp[order].astype("<u4"), size[order])
    chunks = rows.column("chunk").to_numpy()[own] if len(own) else np.empty(0, np.int64)
    return pa.table({"chunk": pa.array(chunks.astype(np.int64)), "bucket": pa.array([rows.column("bucket")[0].as_py()] * len(own), pa.int64()), "fps": pa.array(prints, pa.binary()), "sizes": pa.array(sizes, pa.binary())})


# 3. Documents with short lists.

SEARCHED = {"doc": pa.int64(), "n": pa.int64(), "probes": pa.list_(pa.int64()), "grams": pa.binary()}


def probing(rows: pa.Table, found: pa.Table, n: int, buckets: int, percent: int) -> pa.Table:
    """Documents with short lists: doc, n, probes (grams that have one, rarest first), grams (sorted: those that any other class holds)."""
    reps = found.filter(pa.compute.is_valid(found.column("rep"))) if found.num_rows else found
    back = found.filter(pa.compute.is_valid(found.column("fps"))) if found.num_rows else found
    if not rows.num_rows or not reps.num_rows or not back.num_rows:
        return empty(SEARCHED)
    known = np.concatenate([(U(b) << U(32)) | np.frombuffer(x, "<u4").astype(U) for b, x in zip(back.column("bucket").to_pylist(), back.column("fps").to_pylist(), strict=True)])
    sizes = np.concatenate([np.frombuffer(x, np.uint8) for x in back.column("sizes").to_pylist()])
    order = np.argsort(known)
    known, sizes = known[order], sizes[order]
    out: dict[str, list] = {k: [] for k in SEARCHED}
    _, ids, sets = chosen(rows, reps, n)
    for doc, g in zip(ids, sets, strict=True):
        bucket, fp = windows.bucket_key(g, buckets)
        key = (bucket << U(32)) | fp.astype(U)
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        shared = known[at] == key
        single = len(g) - int(shared.sum())
        room = len(g) - least_overlap(len(g), percent)
        if single > room:
            continue
        grams, size = g[shared], sizes[at[shared]]
        first = np.lexsort((grams, size))[: room + least_short(len(g), percent) - single]
        out["doc"].append(doc)
        out["n"].append(len(g))
        out["probes"].append(grams[first].view(np.int64))
        out["grams"].append(grams.astype("<u8").tobytes())
    return pa.table({k: pa.array(v, SEARCHED[k]) for k, v in out.items()})


# 4. and 5. Comparison.


def probe(mine: np.ndarray, theirs: np.ndarray, at_least: int, block: int = 256) -> int:
    """Common values of two sorted arrays by binary search, given up (-1) once at_least is out of reach."""
    if len(mine) > len(theirs):
        mine, theirs = theirs, mine
    if not len(mine):
        return 0 if at_least <= 0 else -1
    both = 0
    for a in range(0, len(mine), block):
        part = mine[a : a + block]
        at = np.minimum(np.searchsorted(theirs, part), len(theirs) - 1)
        both += int((theirs[at] == part).sum())
        if both + len(mine) - a - len(part) < at_least:
            return -1
    return both


def merge_short(lists: list[list[tuple[int, int]]], k: int) -> list[int]:
    """Ids that enough of the sorted lists of (id, its k) hold: the smaller of both k.  A heap merges the lists."""
    out: list[int] = []
    last, asked, count = None, 0, 0
    for doc, own in heapq.merge(*lists):
        if doc == last:
            count += 1
        else:
            last, asked, count = doc, min(k, own), 1
        if count == asked:
            out.append(doc)
    return out


def compared(percent: int):
    """Pairs with both sets: those that link, as a, b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: batch.column(k).to_pylist() for k in ("a", "b", "na", "nb", "ga", "gb")}
            good = []
            for i, (n, m) in enumerate(zip(cols["na"], cols["nb"], strict=True)):
                t = needed(n, m, percent)
                both = probe(np.frombuffer(cols["ga"][i], "<u8"), np.frombuffer(cols["gb"][i], "<u8"), t) if min(n, m) >= t else -1
                good.append(both >= 0 and links(n, m, both, percent))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def linked(pairs: DataFrame, searched: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b.  Both sets are joined on; Spark splits a document that is in very many pairs."""
    a = searched.select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("grams").alias("ga"))
    b = searched.select(F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("grams").alias("gb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ga", "gb").mapInArrow(compared(percent), "a long, b long")


def leaders(entries: DataFrame) -> DataFrame:
    """a, b: every document with the leader that most of its short lists name, by two ways of naming one."""
    out = None
    for name, key in (("first", F.col("doc")), ("any", F.xxhash64("doc"))):
        head = entries.groupBy("gram").agg(F.min(F.struct(key.alias("k"), F.col("doc").alias("b"))).alias(name)).select("gram", f"{name}.b")
        votes = entries.join(head, "gram").where("doc <> b").groupBy("doc", "b").agg(F.count(F.lit(1)).alias("v"))
        best = votes.groupBy(F.col("doc").alias("a")).agg(F.max_by("b", F.struct("v", -F.col("b"))).alias("b"))
        out = best if out is None else out.unionByName(best)
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


#: Entries of a document's short lists that are merged at a time.
LOT = 1 << 16


def power_of_two(size, unit: int):
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(size / unit, F.lit(1.0))))).cast("long")


def candidates(entries: DataFrame, block: int, percent: int, lot: int = LOT) -> DataFrame:
    """a, b: pairs of different components that share k short lists, by a heap merge over each document's lists.

    entries: gram, doc, n, k, at (the gram's place in the document's order), component.
    """
    #: Sizes that link are in one band or in neighbours.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9).cast("int")
    several = entries.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("size")).where("x <> y").select("gram", "size", power_of_two(F.col("size"), block).alias("blocks"))
    open_ = entries.join(several, "gram").withColumn("band", band)
    lists = open_.groupBy("gram", "band", F.pmod(F.xxhash64("doc"), "blocks").alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc", "n", "k", "at", "component"))).alias("list"))
    work = open_.groupBy(F.col("doc").alias("a")).agg(power_of_two(F.sum("size"), lot).alias("parts"))
    query = open_.select("gram", "blocks", F.col("doc").alias("a"), F.col("n").alias("na"), F.col("k").alias("ka"), F.col("at").alias("pa"), F.col("component").alias("ca"), F.explode(F.array("band", F.col("band") - 1, F.col("band") + 1)).alias("band"))
    query = query.join(work, "a").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    both = query.join(lists, ["gram", "band"]).where(F.pmod("block", F.least("parts", "blocks")) == F.pmod("part", F.least("parts", "blocks")))
    #: Of a pair's first k shared grams, the overlap is at most those before it, it, and what follows it in either order.
    reach = lambda y: (100 + percent) * (F.least(F.col("na") - F.col("pa"), y["n"] - y["at"]) + F.least(F.col("ka"), y["k"]) - 1) >= percent * (F.col("na") + y["n"])
    #: A pair is searched from its larger set.
    before = lambda y: (y["n"] < F.col("na")) | (y["n"] == F.col("na")) & (y["doc"] < F.col("a"))
    within = F.filter("list", lambda y: before(y) & (y["component"] != F.col("ca")) & (F.pmod(F.xxhash64(y["doc"]), F.col("parts")) == F.col("part")) & reach(y))
    rows = both.select("a", "part", F.col("ka").alias("k"), F.transform(within, lambda y: y["doc"]).alias("docs"), F.transform(within, lambda y: y["k"]).alias("ks")).where(F.size("docs") > 0)
    return rows.repartition("a", "part").sortWithinPartitions("a", "part").mapInArrow(searched_lists, "a long, b long")


def searched_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merge of one document's lists after the other's; rows come sorted by document and part.

    Entries stay in Arrow's buffers until their document's turn, so one document's part is all that is held as objects.
    """
    now, k, lists = None, 0, []

    def found() -> pa.RecordBatch:
        docs = merge_short([list(zip(d.tolist(), n.tolist(), strict=True)) for d, n in lists], k)
        return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(docs), pa.int64()), pa.array(docs, pa.int64())], ["a", "b"])

    for batch in batches:
        a, part, own = (batch.column(c).to_numpy() for c in ("a", "part", "k"))
        docs, ks = (batch.column(c) for c in ("docs", "ks"))
        ends = docs.offsets.to_numpy()
        values = [x.values.to_numpy() for x in (docs, ks)]
        for i in range(batch.num_rows):
            if (a[i], part[i]) != now:
                if lists:
                    yield found()
                now, k, lists = (a[i], part[i]), int(own[i]), []
            lists.append(tuple(v[ends[i] : ends[i + 1]].copy() for v in values))
    if lists:
        yield found()


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, chunk_bytes: int = 4 << 20, block: int = 512, lot: int = LOT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included)."""
    docs = texts(docs)
    since = len(SCRATCH)
    sets, sets_path = written_at(docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(signatures(n), "doc_id long, n long, d1 long, d2 long"), "gram-sets")
    classes = sets.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"))
    shape = windows.shape(docs, chunk_bytes, 6)
    chunks, buckets = shape.chunks, shape.buckets
    rows = shape.spread(windows.dealt(docs, chunks))
    keyed = rows.groupBy("chunk")
    reps = classes.select("rep", "n", "d1", "d2", F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("long").alias("chunk"))
    counts = keyed.cogroup(reps.groupBy("chunk")).applyInArrow(windows.lean(lambda a, b: counted(a, b, n, buckets)), "bucket long, chunk long, fps binary, many binary")
    back = counts.groupBy("bucket").applyInArrow(summed, "chunk long, bucket long, fps binary, sizes binary")
    told = reps.select("chunk", "rep", "n", "d1", "d2", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "long"), ("fps", "binary"), ("sizes", "binary"))]).unionByName(back.select("*", *[F.lit(None).cast("long").alias(c) for c in ("rep", "n", "d1", "d2")]))
    searched = written(keyed.cogroup(told.groupBy("chunk")).applyInArrow(windows.lean(lambda a, b: probing(a, b, n, buckets, percent)), "doc long, n long, probes array<long>, grams binary"), "gram-searched")
    overlap = F.floor((percent * F.col("n") + 99) / 100)
    short = F.greatest(F.lit(1), F.least(F.lit(8), 1 + F.floor(F.col("n") / 16), overlap)).cast("int")
    entries = searched.select("doc", "n", short.alias("k"), F.posexplode("probes").alias("i", "gram"), F.size("probes").alias("p"))
    #: The place in the whole order: what comes first are grams of no other class.
    entries = entries.select("gram", "doc", "n", "k", ((F.col("n") - overlap + F.col("k") - F.col("p")) + F.col("i")).cast("long").alias("at"))
    #: Rows that repeat a doc_id are one node, so it links the classes of its texts.
    repeated = sets.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    tied, tied_path = written_at(sets.where("n > 0").join(repeated, "doc_id").join(classes, ["n", "d1", "d2"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct(), "gram-repeats")
    near = written(linked(leaders(entries), searched, percent).unionByName(tied), "gram-leaders")
    found = components(near, "gram-components")
    grouped = entries.join(found.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    rest = linked(candidates(grouped, block, percent, lot), searched, percent)
    final = components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest), "gram-components")
    drop_scratch(docs.sparkSession, since, keep=(sets_path, tied_path, SCRATCH[-1]))  # the last one is `final`
    named = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"))
    # A null-safe order of joins: classes are one row a set, so the large side only meets one.
    out = sets.where("n > 0 or doc_id is null").join(named, ["n", "d1", "d2"], "left").select("doc_id", "n", "component")
    nodes = tied.select(F.col("a").alias("doc_id")).distinct().join(final.select(F.col("node").alias("doc_id"), "component"), "doc_id")
    out = out.unionByName(sets.where("n = 0 and doc_id is not null").join(nodes, "doc_id", "left").select("doc_id", "n", "component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
