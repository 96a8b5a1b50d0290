"""Every operator against brute force, on the small tables and on odd input."""

import array
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlake.llm import common, decontaminate, fingerprint_index, licenses, ngram_join, pieces, quality_rules, resampling, suffix_dedup, token_files, toxicity, windows
from flowlake.llm.queries import QUERIES, tokenizer_path
from tests.llm import helpers as H


@pytest.fixture(scope="module")
def rows(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, sf, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()]


# op1


def test_decontamination_query(spark, sf, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    H.same(run(spark, sf, "op1_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), H.brute_decontaminate(rows, items))


@pytest.mark.parametrize("block", [2_000_000, 600])
def test_decontamination_odd(spark, block):
    docs = H.odd_rows()
    passage = docs[9][1]
    items = [(1, passage), (2, passage), (3, None), (4, " .,! "), (10, "one TWO, three"), (11, "absent words here"), (5, docs[6][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.decontaminate(H.odd_docs(spark), bench, block_words=block)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256), F.col("n_hit") > 0)
    H.same(got.collect(), H.brute_decontaminate(docs, items))
    assert decontaminate.decontaminate(H.empty_docs(spark), bench).count() == 0
    none = decontaminate.decontaminate(H.odd_docs(spark), bench.limit(0))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(docs)


# Carried columns


CLASHING = ("score", "chunk", "n_words", "kept", "h", "lang", "source", "spans", "text", "part", "n_hit")


def test_clashing_columns_are_carried_or_replaced(spark):
    """A carried column keeps its values under any name, and where the operator returns that name it is the operator's."""
    rows = [(i, t, *(f"{c}-{i}" for c in CLASHING if c != "text")) for i, t, *_ in H.odd_rows()]
    schema = "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING if c != "text")
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, H.odd_rows()[9][1])], "item_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    results = {
        "toxicity": (toxicity.score(docs, model, carry=CLASHING), {"doc_id", "score"}),
        "decontaminate": (decontaminate.decontaminate(docs, bench, carry=CLASHING), {"doc_id", "text", "n_words", "spans", "n_hit", "items"}),
        "suffix_dedup": (suffix_dedup.suffix_dedup(docs, carry=CLASHING), {"doc_id", "n_bytes", "n_removed", "spans", "kept"}),
    }
    for name, (found, own) in results.items():
        more = [c for c in CLASHING if c not in own]
        assert len(found.columns) == len(set(found.columns)) == len(own) + len(more), name
        got = found.collect()
        assert len(got) == len(rows), name
        texts = {(r[0], r[1]) for r in rows}
        for r in got:
            for c in more:
                assert (r["doc_id"], r[c]) in texts if c == "text" else r[c] == f"{c}-{r['doc_id']}", (name, c)


def test_operators_ignore_other_columns(spark):
    """Columns named like the operators' own change nothing where none is carried."""
    docs = H.odd_docs(spark)
    plain = docs.select("doc_id", "text", "lang")
    for f in (quality_rules.quality_rules, licenses.scan, lambda d: pieces.encode(d, tokenizer_path("piece_bpe_32k.model")).drop("decoded")):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(plain).collect()))


# op2


def test_pieces_query(spark, sf, rows):
    sp = pieces.ChunkTable(tokenizer_path("piece_bpe_32k.model"), 1000).library
    want = []
    for i, t in rows:
        ids = sp.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(ids), H.sha(array.array("I", ids).tobytes()), H.sha(sp.decode(ids).encode())))
    H.same(run(spark, sf, "op2_pieces", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), want)


def test_pieces_odd(spark):
    model = tokenizer_path("piece_bpe_32k.model")
    sp = pieces.ChunkTable(model, 1000).library
    got = pieces.encode(H.odd_docs(spark), model, table_chunks=50, block=3).select("doc_id", "ids", "decoded").collect()
    want = [(i, array.array("I", sp.encode(t or "", add_bos=True, add_eos=True)).tobytes(), sp.decode(sp.encode(t or ""))) for i, t, *_ in H.odd_rows()]
    H.same([(r[0], bytes(r[1]), r[2]) for r in got], want)
    assert pieces.encode(H.empty_docs(spark), model).count() == 0


def test_chunks_join_to_whole_texts():
    table = pieces.ChunkTable(tokenizer_path("piece_bpe_32k.model"), 30)
    assert table.separable
    rng = random.Random(3)
    cases = ["".join(rng.choice("ab é▁ \n\t\x00🙂") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    whole = [array.array("I", x).tobytes() for x in table.library.encode(cases)]
    assert [table.encode(cases[k : k + 7]) for k in range(0, 400, 7)] == [whole[k : k + 7] for k in range(0, 400, 7)]


# op3


def brute_resample(spark, rows, good, keep, buckets, seed):
    """Weights, keys and the choice from whole counts, n-gram by n-gram."""
    import pyarrow as pa
    from flowlake.llm.decontaminate import words_of

    vocabulary = sorted({w for _, t in rows for w in words_of((t or "").encode())})
    hashed = licenses.Folded(pa.table({"doc_id": pa.array([0], pa.int64()), "text": pa.array([b" ".join(vocabulary)], pa.binary())})).words[0]
    code = {w: int(h) for w, h in zip(vocabulary, hashed, strict=True)}
    pair = lambda a, b: int(windows.mixed(np.array([code[a] * 3 + code[b] & (1 << 64) - 1], np.uint64))[0])

    def grams(text):
        w = words_of((text or "").encode())
        return [code[x] % buckets for x in w] + [pair(x, y) % buckets for x, y in zip(w, w[1:])]

    raw, target = np.zeros(buckets), np.zeros(buckets)
    for i, t in rows:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)) if target.sum() else np.zeros(buckets)
    table = spark.createDataFrame([(i, t or "") for i, t in rows], "doc_id long, text string")
    hashes = table.select(F.xxhash64("doc_id", "text", F.lit(seed))).collect()
    out = []
    for (i, t), h in zip(rows, hashes, strict=True):
        g = grams(t)
        u = (((h[0] & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)
        out.append((i, len(g), sum(ratio[x] for x in g), sum(ratio[x] for x in g) - np.log(-np.log(u))))
    cut = sorted((r[3] for r in out), reverse=True)[round(keep * len(out)) - 1]
    return [(*r, r[3] >= cut) for r in out]


def test_resampling(spark, sf, rows):
    good = {r[0] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    got = sorted(map(tuple, QUERIES["op3_resampling"](spark, sf).collect()))
    want = sorted(brute_resample(spark, rows, good, 0.8, 10_000, 17))
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[4] for r in got] == [r[4] for r in want]
    assert np.allclose([r[2:4] for r in got], [r[2:4] for r in want])
    assert sum(r[4] for r in got) == round(0.8 * len(got))


def test_resampling_prefers_the_target(spark):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(60))) for i in range(100)]
    bad = [(i, " ".join(rng.choice("uno dos tres quatro".split()) for _ in range(60))) for i in range(100, 200)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    marks = spark.createDataFrame([(i,) for i in range(0, 100, 4)], "doc_id long")
    picked = [r[0] for r in resampling.resample(docs, marks, keep=0.5).where("selected").collect()]
    assert len(picked) == 100 and sum(i < 100 for i in picked) > 95


def test_resampling_odd(spark):
    good = spark.createDataFrame([(6,), (None,)], "doc_id long")
    got = resampling.resample(H.odd_docs(spark), good).collect()
    assert len(got) == len(H.odd_rows()) and all(np.isfinite(r["key"]) for r in got)
    assert resampling.resample(H.empty_docs(spark), good).count() == 0
    assert {r["log_weight"] for r in resampling.resample(H.odd_docs(spark), good.limit(0)).collect()} == {0.0}


def test_kth_largest(spark):
    values = [random.Random(2).choice([1.0, 2.0, 2.0, 5.5, -3.0]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 150, 299, 300):
        assert resampling.kth_largest(df, "key", k, bins=4, few=3) == sorted(values, reverse=True)[k - 1]


# op4 and op8


def test_fingerprint_query(spark, sf, rows):
    H.same(run(spark, sf, "op4_fingerprint_index", "doc_id", "n_words", "n_removed", "kept_sha256"), H.brute_words(rows))


def test_suffix_query(spark, sf, rows):
    H.same(run(spark, sf, "op8_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), H.brute_suffix(rows))


@pytest.mark.parametrize("length, gram", [(100, 50), (30, 8), (7, 7)])
def test_suffix_odd(spark, length, gram):
    found = suffix_dedup.suffix_dedup(H.odd_docs(spark), length, gram, carry=("lang", "source"))
    got = found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect()
    want = H.brute_suffix(H.odd_rows(), length)
    free = lambda r: r[0] is not None and r[0] >= 0
    H.same([r for r in got if free(r)], [r for r in want if free(r)])
    assert len(got) == len(want)
    assert suffix_dedup.suffix_dedup(H.empty_docs(spark), length, gram).count() == 0


def test_suffix_whole_characters(spark):
    docs = spark.createDataFrame([(1, "é" * 120 + "x"), (2, "y" + "é" * 120)], "doc_id long, text string")
    got = {r[0]: bytes(r[1]).decode() for r in suffix_dedup.suffix_dedup(docs, 100, 50, characters=True).select("doc_id", "kept").collect()}
    assert got[2] == "y" and got[1].endswith("x")


@pytest.mark.parametrize("batches, length", [(1, 20), (3, 20), (2, 5)])
def test_fingerprint_odd(spark, batches, length):
    found = fingerprint_index.incremental_dedup(H.odd_docs(spark), common.scratch(spark, "test-index"), batches, length, gram=min(8, length))
    got = found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    H.same(got, H.brute_words(H.odd_rows(), length))


def morse(n):
    """The first n letters of the Thue-Morse word and of its complement, which polynomial hashes modulo powers of two confuse."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_unlike_words_stay_unlike(spark):
    a, b = morse(1024)
    rows = [(1, " ".join([a] * 20)), (2, " ".join([b] * 20)), (3, a), (4, b), (5, f"{a} x y z v w"), (6, f"{b} x y z v w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    H.same(ngram_join.ngram_join(docs).collect(), H.brute_join(rows))
    found = fingerprint_index.incremental_dedup(docs, common.scratch(spark, "test-index"))
    H.same(found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect(), H.brute_words(rows))
    found = suffix_dedup.suffix_dedup(docs)
    H.same(found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect(), H.brute_suffix(rows))


def test_digests_know_words():
    import pyarrow as pa

    rng = random.Random(3)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 600]))) for _ in range(400)]
    chunk = windows.Chunk(pa.table({"doc_id": pa.array([1], pa.int64()), "text": pa.array([b"  ".join(words)], pa.binary())}), windows.Spec("words", 20, 8))
    assert len(chunk.words[0]) == len(words)
    pairs = list(zip(chunk.words[0].tolist(), chunk.words[1].tolist(), strict=True))
    assert len(set(pairs)) == len(set(words)) == len(set(zip(words, pairs, strict=True)))


@pytest.mark.parametrize("hot, salts", [(2, 3), (1, 1)])
def test_hot_values_in_parts(spark, hot, salts):
    """The results don't depend on which values count as hot."""
    rng = random.Random(8)
    passage, line = H.prose(rng, 30), H.prose(rng, 12)
    rows = [(i, f"{H.prose(rng, 8)} {passage} {H.prose(rng, 8)} {line}") for i in range(60)] + [(i, passage + " same end") for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.suffix_dedup(docs, 60, 20, chunk_bytes=1000, hot=hot, salts=salts)
    H.same(found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect(), H.brute_suffix(rows, 60))
    index = fingerprint_index.FingerprintIndex(spark, common.scratch(spark, "test-index"), windows.Spec("words", 20, 8), 4)
    parts = [docs.where("doc_id < 50"), docs.where("doc_id >= 50")]
    got = []
    for i, part in enumerate(parts):
        found = index.judge(index.add(part, 1000), parts[: i + 1], hot, salts)
        got += found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    H.same(got, H.brute_words(rows))


def test_failed_batches_leave_the_index(spark, monkeypatch):
    docs, path = H.odd_docs(spark), common.scratch(spark, "test-index")
    make = lambda: fingerprint_index.FingerprintIndex(spark, path, windows.Spec("words", 20, 8), 4)
    index = make()
    parts = [docs.where("doc_id < 8 or doc_id is null"), docs.where("doc_id >= 8")]
    index.ingest(parts[0]).count()
    before = json.dumps(index.state)
    real = fingerprint_index.FingerprintIndex._commit

    def broken(self, state):
        raise OSError("lost")

    monkeypatch.setattr(fingerprint_index.FingerprintIndex, "_commit", broken)
    with pytest.raises(OSError):
        index.ingest(parts[1], parts[:1])
    assert json.dumps(index.state) == before == json.dumps(make().state)
    monkeypatch.setattr(fingerprint_index.FingerprintIndex, "_commit", real)
    other = make()
    got = index.ingest(parts[1], parts[:1]).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    late = {r[0] for r in got}
    H.same(got, [r for r in H.brute_words(H.odd_rows()) if r[0] in late])
    with pytest.raises(RuntimeError):
        other.add(parts[1])
    again = make().judge(1, parts).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256)).collect()
    H.same(again, got)
    assert len(index.runs().inputFiles()) and len(make().state["runs"]) == 2
    index.vacuum()
    assert make().state == index.state


def test_index_runs_and_compaction(spark):
    docs = H.odd_docs(spark)
    path = common.scratch(spark, "test-index")
    index = fingerprint_index.FingerprintIndex(spark, path, windows.Spec("words", 20, 8), 4)
    first, second = docs.where("doc_id < 10"), docs.where("doc_id >= 10")
    index.ingest(first).count()
    index.ingest(second, first).count()
    fps = lambda: sorted(x for r in index.runs().collect() for x in zip(np.frombuffer(r["fps"], "<u4").tolist(), np.frombuffer(r["owners"], "<i8").tolist(), strict=True))
    before = fps()
    index.compact()
    assert len(index.state["runs"]) == 1 and fps() == before
    for r in index.runs().collect():
        assert (np.diff(np.frombuffer(r["fps"], "<u4").astype(np.int64)) >= 0).all()
    index.vacuum()
    reopened = fingerprint_index.FingerprintIndex(spark, path, windows.Spec("words", 20, 8), 4)
    assert reopened.state == index.state
    third = spark.createDataFrame([(99, docs.where("doc_id = 6").first()["text"])], "doc_id long, text string")
    assert reopened.ingest(third, [first, second]).first()["n_removed"] == 200
    with pytest.raises(ValueError):
        reopened.ingest(third, [first])


def test_hot_passages(spark):
    """Many documents with one passage between unlike words, and many copies."""
    rng = random.Random(8)
    passage = H.prose(rng, 30)
    rows = [(i, f"{H.prose(rng, 8)} {passage} {H.prose(rng, 8)}") for i in range(150)] + [(i, passage + " same end") for i in range(150, 250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.suffix_dedup(docs, 60, 20, chunk_bytes=5000)
    H.same(found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long"), F.sha2("kept", 256)).collect(), H.brute_suffix(rows, 60))


def test_long_sequences_in_segments(spark, monkeypatch):
    rng = random.Random(4)
    part = H.prose(rng, 700)
    rows = [(1, f"{part} {H.prose(rng, 300)} {part}"), (2, part[100:2000])]
    monkeypatch.setattr(windows, "SEGMENT", 300)
    import pyarrow as pa

    spec = windows.Spec("bytes", 50, 20)
    table = pa.table({"doc_id": pa.array([1, 2], pa.int64()), "text": pa.array([t.encode() for _, t in rows], pa.binary()), "chunk": pa.array([0, 0], pa.int64())})
    state = windows.candidates(table, pa.table({"chunk": pa.array([], pa.int64()), "bucket": pa.array([], pa.int64()), "fps": pa.array([], pa.binary()), "hot": pa.array([], pa.binary())}), spec, 4, 0)
    kinds = np.array(state.column("state").to_pylist())
    told = state.filter(pa.array(kinds >= windows.DIFFERENT)).select(["doc", "pos", "n"])
    kind = pa.array([windows.REPEAT if k == windows.AGAIN else windows.OPEN for k in kinds[kinds >= windows.DIFFERENT]], pa.int32())
    _, mask = windows.covered(table, told.append_column("kind", kind), spec)
    seen = set()
    want = np.concatenate([np.frombuffer(bytes(H.covered(t.encode(), 50, seen)), np.uint8) for _, t in rows])
    assert (mask == want.astype(bool)).all()


# op5


def test_grammar_marks():
    lex = toxicity.Lexicon({b"idio": 3.0, b"fool$": 2.0})
    f = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lex), strict=True))
    assert f("an idiot")["plain"] > 0
    assert f("not an idiot")["negated"] > 0 == f("not an idiot")["plain"]
    assert f("he said idiots everywhere")["reported"] > 0
    assert f("you idiot")["targeted"] > 0 == f("you idiot")["plain"]
    assert f("what an idiot you are")["targeted"] > 0
    assert f("a clause ends. idiot")["plain"] > 0
    assert f("foolish")["plain"] == 0 < f("fool")["plain"]
    for threat in ("i will destroy you", "i will kill you", "we will burn them all", "he killed them", "you kill", "ich werde dich töten", "je te tuerai", "los mataré"):
        assert f(threat)["threats"] > 0 == f(threat)["hedged_threats"], threat
    for none in ("the sun will burn", "kill. you", "killer you", "nothing here", ""):
        assert f(none)["threats"] == 0, none
    assert f("i won't kill you")["hedged_threats"] > 0 == f("i won't kill you")["threats"]
    assert f("nothing here") == dict.fromkeys(toxicity.FEATURES, 0.0)


def brute_marks(kinds):
    """Marks by looking around each symbol instead of running machines."""
    out = []
    for i, kind in enumerate(kinds):
        marks = 0
        if kind in (toxicity.INSULT, toxicity.THREAT):
            marks |= toxicity.NEGATED * (toxicity.NEGATION in kinds[max(0, i - 4) : i])
            marks |= toxicity.REPORTED * (toxicity.REPORT in kinds[:i])
            marks |= toxicity.TARGETED * (toxicity.TARGET in kinds[max(0, i - 5) : i] + kinds[i + 1 : i + 6])
        out.append(kind << 3 | marks)
    return out


def brute_features(text, arcs):
    import re

    def symbol(w):
        for kind, words in ((toxicity.TARGET, toxicity.TARGETS), (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS)):
            if w.decode(errors="replace") in words:
                return kind, 0.0
        weight = max([v for a, v in arcs.items() if (w == a[:-1] if a.endswith(b"$") else w.startswith(a))], default=0.0)
        forms = {(s + e.strip(".")).encode() for s, ends in toxicity.THREATS.items() for e in ends.split()}
        return (toxicity.INSULT, weight) if weight else (toxicity.THREAT, toxicity.THREAT_WEIGHT) if w in forms else (toxicity.OTHER, 0.0)

    sums, scores = dict.fromkeys(toxicity.FEATURES, 0.0), []
    for part in re.split(r"[.!?;:|\n]+|,(?= )", re.sub('["“«„]', " said ", text)):
        words = [symbol(w) for w in toxicity.tokens(part)]
        if not words:
            continue
        total = 0.0
        for (kind, weight), out in zip(words, brute_marks([k for k, _ in words]), strict=True):
            negated, reported, targeted = (bool(out & m) for m in (toxicity.NEGATED, toxicity.REPORTED, toxicity.TARGETED))
            if kind == toxicity.INSULT:
                sums["negated" if negated else "reported" if reported else "targeted" if targeted else "plain"] += weight
            elif kind == toxicity.THREAT and targeted:
                sums["hedged_threats" if negated or reported else "threats"] += 1
            else:
                continue
            total += weight / (2 if negated or reported else 1)
        scores.append(total)
    order = sorted([*scores, 0.0, 0.0], reverse=True)
    sums["best_clause"], sums["second_clause"], sums["share"] = order[0], order[1], 100 * sum(s > 0 for s in scores) / max(10, len(scores))
    return [float(np.log1p(sums[k])) for k in toxicity.FEATURES]


def test_features_against_brute_force():
    rng = random.Random(21)
    arcs = {b"idio": 3.0, b"idiot$": 4.0, b"fool$": 2.0, b"dre": 1.5}
    vocabulary = "idiot idiots idiocy fool foolish dreck you them not never said kill killed burning the a of töten dich nicht . , ! \n \" they matar tue stab stabbed".split(" ")
    lexicon = toxicity.Lexicon(arcs)
    for _ in range(600):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))
        assert toxicity.features(text, lexicon) == pytest.approx(brute_features(text, arcs)), text


def test_composition_is_sequence():
    a, b = toxicity.scope(toxicity.NEGATION, 2, toxicity.NEGATED), toxicity.onwards(toxicity.REPORT, toxicity.REPORTED)
    both = toxicity.compose(a, b)
    rng = random.Random(0)
    for _ in range(200):
        s = sa = sb = 0
        for _ in range(12):
            symbol = rng.randrange(6) << 3
            s, out = both.table[s][symbol]
            sa, mid = a.table[sa][symbol]
            sb, want = b.table[sb][mid]
            assert out == want


def test_toxicity_query(spark):
    """Of held-out labelled rows; toxic ones are few, so both kinds are held to a rate of their own."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op5_toxicity"](spark, sf).collect()
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    toxic = [p for y, p in held if y == 1]
    clean = [p for y, p in held if y == 0]
    assert sum(toxic) / len(toxic) > 0.9 and sum(clean) / len(clean) < 0.02


def test_toxicity_never_learns_held_out_labels(spark):
    """Labels of held-out rows turned round change no score."""
    rng = random.Random(2)
    bad = lambda i: f"{H.prose(rng, 20)} you worthless {rng.choice(['scumbag', 'scumbags'])} {H.prose(rng, 5)}"
    rows = [(i, bad(i) if i % 3 == 0 else H.prose(rng, 30)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    marks = [[(i, int(i % 3 == 0) ^ (turn and held(i))) for i, _ in rows] for turn in (0, 1)]
    scores = [sorted(toxicity.score(docs, toxicity.fitted(docs, spark.createDataFrame(m, "doc_id long, toxic int"))).collect()) for m in marks]
    assert scores[0] == scores[1]
    assert all((s >= 0.5) == (i % 3 == 0) for i, s in scores[0])


def test_toxicity_odd(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = H.odd_docs(spark)
    model = toxicity.learn(docs, labels)
    got = toxicity.score(docs, model, carry=("lang", "h"))
    assert got.columns == ["doc_id", "score", "lang", "h"] and got.count() == len(H.odd_rows())
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    one = toxicity.learn(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, one).where("score > 0.5").count() == 0
    assert toxicity.score(H.empty_docs(spark), toxicity.learn(H.empty_docs(spark), labels.limit(0))).count() == 0


# op6


def test_join_query(spark, sf, rows):
    H.same(run(spark, sf, "op6_ngram_join", "doc_id", "n_shingles", "component_id"), H.brute_join(rows))


def test_join_odd(spark):
    got = ngram_join.ngram_join(H.odd_docs(spark)).collect()
    H.same(got, H.brute_join(H.odd_rows()))
    assert ngram_join.ngram_join(H.empty_docs(spark)).count() == 0


@pytest.mark.parametrize("block, lot", [(512, 1 << 16), (3, 8)])
def test_join_chains_and_borders(spark, block, lot):
    """Chains of near copies, sizes around the border, and grams shared by all."""
    rng = random.Random(6)
    rows = []
    for g in range(6):
        words = H.prose(rng, 60).split()
        for k in range(12):
            rows.append((g * 100 + k, " ".join(words)))
            words[rng.randrange(len(words))] = f"w{g}x{k}"
    common_part = H.prose(rng, 20)
    rows += [(1000 + k, f"{common_part} {H.prose(rng, rng.randint(2, 12))}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    H.same(ngram_join.ngram_join(docs, n=2, percent=80, block=block, lot=lot).collect(), H.brute_join(rows, 2))


def test_join_repeated_ids(spark):
    """A doc_id with two texts stands for both classes, links them, and takes its blank rows along."""
    rng = random.Random(14)
    near = lambda t: " ".join([*t.split()[:-1], "changed"])
    x, y, z, v = (H.prose(rng, 80) for _ in range(4))
    rows = [(1, x), (1, y), (2, near(x)), (3, near(y)), (4, z), (5, z), (5, v), (5, " "), (6, v), (7, near(v)), (8, near(near(z))), (9, ""), (9, None)]
    for part in (rows, rows[::-1]):
        H.same(ngram_join.ngram_join(spark.createDataFrame(part, "doc_id long, text string")).collect(), H.brute_join(part))


def test_merge_and_probe():
    """What the merge of short lists keeps and the probe of whole sets confirms are the partners that comparing all sets finds."""
    rng = random.Random(9)
    sets = {i: np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(5, 40))], np.uint64)) for i in range(60)}
    short = {i: set(s[: len(s) - ngram_join.least_overlap(len(s), 50) + ngram_join.least_short(len(s), 50)].tolist()) for i, s in sets.items()}
    for q in range(0, 60, 7):
        lists = [sorted((i, ngram_join.least_short(len(sets[i]), 50)) for i in sets if g in short[i]) for g in short[q]]
        found = ngram_join.merge_short(lists, ngram_join.least_short(len(sets[q]), 50))
        assert found == sorted(set(found))
        good = {i for i in found if ngram_join.probe(sets[q], sets[i], ngram_join.needed(len(sets[q]), len(sets[i]), 50)) >= ngram_join.needed(len(sets[q]), len(sets[i]), 50)}
        want = {i for i, s in sets.items() if 100 * len(np.intersect1d(sets[q], s)) >= 50 * len(np.union1d(sets[q], s))}
        assert good == want
    assert ngram_join.merge_short([[(1, 2), (2, 9)], [(1, 2), (2, 9)], [(2, 9)]], 3) == [1, 2]


# op7


def test_token_files(spark, sf, rows):
    enc = token_files.Encoder(tokenizer_path("word_bpe_49k.json"))
    want, start = [], 0
    for i, t in sorted(rows):
        ids = np.array([*enc.library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    H.same(run(spark, sf, "op7_token_files", "doc_id", "start", "n_tokens", "ids_crc32"), want)


def test_token_files_odd(spark):
    path = tokenizer_path("word_bpe_49k.json")
    enc = token_files.Encoder(path)
    root = common.scratch(spark, "test-tokens")
    manifest = token_files.write_token_files(H.odd_docs(spark), root, path, files=3)
    got = token_files.read_token_files(spark, root, manifest).collect()
    want = sorted((-1 if i is None else i, (np.array([*enc.library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")).tobytes()) for i, t, *_ in H.odd_rows())
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], bytes(r["ids"])) for r in got) == want
    assert sorted(r["start"] for r in got) == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1]]).tolist()
    name = manifest.orderBy("part").first()["file"]
    _, _, ids, _, counts = token_files.open_index(root, name)
    assert len(token_files.read_document(root, name, len(ids) - 1)) == counts[-1]
    with pytest.raises(ValueError):
        token_files.open_index(root, name, b"another dictionary")
    none = common.scratch(spark, "test-tokens")
    assert token_files.read_token_files(spark, none, token_files.write_token_files(H.empty_docs(spark), none, path)).count() == 0


def test_pieces_of_words_are_the_whole_text():
    enc = token_files.Encoder(tokenizer_path("word_bpe_49k.json"), held=40)
    assert enc.cuts
    rng = random.Random(2)
    parts = ["the", "Don't", "don't", "ÉTÉ", "é", "é", "x.,y", "a.", "b,", "...", "'s", "we'll", "12", "3,4", "_.", "日本", "<|endoftext|>", "\x01", " ", "  ", "\n", "\t", "\xa0", "　", "ß", "İ", "ΑΣ"]
    cases = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    for k in range(0, 800, 9):
        assert enc.encode(cases[k : k + 9]) == [enc.whole(t) for t in cases[k : k + 9]]


def test_words_and_their_tails_are_the_whole_text():
    enc = token_files.Encoder(tokenizer_path("word_bpe_49k.json"), held=60)
    rng = random.Random(3)
    letters = [c for c in map(chr, range(256)) if c.isalpha()]
    tails = ["", "", "###", ",%%%", ".***", "!!", "'", "'s", ".'", "_", "-", "\"", ")", "~^`", "&&&.", ",,", "²", "1."]
    word = lambda: rng.choice(["", "", "(", "'"]) + "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 4, 60]))) + rng.choice(tails)
    cases = [*letters, "".join(letters), "", " ", *(rng.choice([" ", "\n", "\f\v "]).join(word() for _ in range(rng.randint(0, 9))) + rng.choice(["", " ", " Ж"]) for _ in range(900))]
    for k in range(0, len(cases), 11):
        assert enc.encode(cases[k : k + 11]) == [enc.whole(t) for t in cases[k : k + 11]]


def test_blocks_end_by_bytes(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 10)
    texts = ["éé", "é" * 9, "", "", "abc", "abcdefgh", "x" * 99, "y" * 10, ""]
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    assert [b.column(1).to_pylist() for b in token_files.blocks(batch)] == [texts[:2], texts[2:6], texts[6:7], texts[7:]]
    assert token_files.blocks(batch.slice(0, 0)) == []


def test_full_table_keeps_usual_words():
    enc = token_files.Encoder(tokenizer_path("word_bpe_49k.json"), held=100)
    learned, words = [], enc._words
    enc._words = lambda w: learned.extend(w) or words(w)
    alphabet = "abcdefghijklmnopqrstuvwxyz"
    usual = ["usual" + c for c in alphabet]
    for k in range(20):
        text = " ".join(usual + ["rare" + alphabet[k] + c for c in alphabet])
        assert enc.encode([text]) == [enc.whole(text)]
        assert len(enc.ids) <= 100
    assert sum(w in usual for w in learned) == len(usual)


# op9


def test_quality_query(spark, sf, rows):
    want = [(i, *H.brute_quality(t)) for i, t in rows]
    H.same(run(spark, sf, "op9_quality_rules", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), want)


def test_quality_odd(spark):
    found = quality_rules.quality_rules(H.odd_docs(spark))
    got = found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
    H.same(got, [(i, *H.brute_quality(t)) for i, t, *_ in H.odd_rows()])
    assert found.where("kept and base_failed").count() == 0 and found.where("kept is null").count() == 0
    assert quality_rules.quality_rules(H.empty_docs(spark)).count() == 0


def test_quality_has_no_python(spark):
    plan = quality_rules.measured(H.odd_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_jensen_shannon(spark):
    d = lambda p, q: spark.range(1).select(quality_rules.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert d([1, 2, 3], [2, 4, 6]) == pytest.approx(0, abs=1e-7)
    assert d([1, 0], [0, 5]) == pytest.approx(1)
    m = [0.75, 0.25]
    want = ((1 * np.log2(1 / m[0])) / 2 + (0.5 * np.log2(0.5 / m[0]) + 0.5 * np.log2(0.5 / m[1])) / 2) ** 0.5
    assert d([1, 0], [1, 1]) == pytest.approx(want)


# op10


def brute_licenses(rows, templates, n=5, containment=0.8, whole_words=20):
    """Licences of which some run of as many words as the window rule allows holds enough shingles, counted window by window."""
    from flowlake.llm.decontaminate import words_of

    out = {}
    for i, text in rows:
        words, found = words_of((text or "").encode()), set()
        for name, template in templates.items():
            own = words_of(template.encode())
            k = min(n, len(own))
            if not k:
                continue
            wanted = {tuple(own[a : a + k]) for a in range(len(own) - k + 1)}
            m, need = len(own) - k + 1, int(np.ceil(containment * len(wanted) - 1e-9)) if len(own) >= whole_words else len(wanted)
            runs = [tuple(words[a : a + k]) for a in range(len(words) - k + 1)]
            hit = [r in wanted for r in runs]
            stride = 1 << (m - 1).bit_length()
            size = 1 if m == 1 else 2 * stride
            if any(hit) and any(len({r for r, h in zip(runs[a : a + size], hit[a : a + size], strict=True) if h}) >= need for a in range(len(runs))):
                found.add(name.partition("#")[0])
        out[i] = found
    return out


def contained_runs(rows, templates, n=5):
    """Licences whose whole template stands in the text."""
    from flowlake.llm.decontaminate import words_of

    joined = lambda t: b" " + b" ".join(words_of((t or "").encode())) + b" "
    return {i: {name.partition("#")[0] for name, t in templates.items() if joined(t).strip() and joined(t) in joined(text)} for i, text in rows}


def test_licenses(spark):
    """Every template is found whole, in capitals, between other words; what is found is contained as far as is asked."""
    rng = random.Random(7)
    names = list(licenses.TEMPLATES)
    rows = [(k, f"{H.prose(rng, rng.randint(0, 70))}\n{licenses.TEMPLATES[n].upper()} {H.prose(rng, rng.randint(0, 30))}") for k, n in enumerate(names)]
    rows += [(500, H.prose(rng, 300)), (501, None), (502, ""), (503, " ".join(licenses.TEXTS["MIT"].split()[:20])), (504, "all rights"), (505, "reserved all rights reserved")]
    rows += [(506, "Code released under the MIT licence."), (507, "This program is licensed under the GNU General Public License, version 3"), (508, "\n# ".join(licenses.TEXTS["ISC"].split(",")))]
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), lot=3).collect()}
    whole, allowed = contained_runs(rows, licenses.TEMPLATES), brute_licenses(rows, licenses.TEMPLATES)
    for i, _ in rows:
        assert whole[i] <= got[i] <= allowed[i], i
    for k, n in enumerate(names):
        assert n.partition("#")[0] in got[k]
    assert not got[500] and not got[501] and not got[502] and not got[503] and not got[504] and got[505] == {"All-rights-reserved"}
    assert got[506] == {"MIT"} and got[507] == {"GPL-3.0"} and got[508] == {"ISC"}
    assert got[names.index("GPL-3.0")] == {"GPL-3.0", "GPL"} and got[names.index("BSD-3-Clause")] == {"BSD-3-Clause", "BSD"}


def test_licenses_query(spark, sf, rows):
    """The query's rows: words, licences found, and their number, against brute force over the whole table."""
    from flowlake.llm.decontaminate import words_of

    got = {r["doc_id"]: r for r in QUERIES["op10_licenses"](spark, sf).collect()}
    whole, allowed = contained_runs(rows, licenses.TEMPLATES), brute_licenses(rows, licenses.TEMPLATES)
    assert sorted(got) == sorted(i for i, _ in rows)
    for i, text in rows:
        found = set(got[i]["licenses"].split(",")) - {""}
        assert whole[i] <= found <= allowed[i] and got[i]["n_words"] == len(words_of(text.encode())) and got[i]["n_matches"] >= len(found)
        assert (got[i]["n_matches"] == 0) == (not found)


def test_licenses_against_every_window(spark):
    """Bands find what exact containment of every window finds."""
    rng = random.Random(12)
    words = H.prose(rng, 40).split()
    templates = {name: " ".join(words[a : a + n]) for name, a, n in (("five", 0, 5), ("nine", 3, 9), ("more", 10, 22), ("all", 0, 40))}
    rows = [(k, " ".join([*H.prose(rng, rng.randint(0, 40)).split(), *words[(a := rng.randrange(20)) : a + rng.randint(3, 40)], *H.prose(rng, 10).split()])) for k in range(120)]
    got = {r["doc_id"]: {m["license"] for m in r["matches"]} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()}
    whole, allowed = contained_runs(rows, templates), brute_licenses(rows, templates)
    for k, _ in rows:
        assert whole[k] <= got[k] <= allowed[k]
    assert sum(map(len, got.values())) >= 0.99 * sum(map(len, allowed.values()))


def test_licenses_odd(spark):
    found = licenses.scan(H.odd_docs(spark))
    assert found.count() == len(H.odd_rows()) and licenses.scan(H.empty_docs(spark)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(H.odd_docs(spark), most_words=3)
    assert licenses.scan(H.odd_docs(spark), {"none": " . "}).where("size(matches) > 0").count() == 0
