"""Toxicity by a weighted finite-state pattern grammar.

Two layers of transducers are composed.  Letters: the insult transducer accepts learned
beginnings of words and whole words with their weights, the threat transducer verbs of harm
with the endings that inflect them, and both turn a word into a symbol of a small alphabet
(insult, threat, target, negation, report, other).  Clauses: a clause is a string over that
alphabet, read by the composition of the negation transducer, which marks what follows a
negation within a few words, the report transducer, which marks what follows a verb of saying
or a quotation mark, and the target transducer, which marks what stands within a few words
after a person addressed; the target transducer then reads the clause backwards, so a person
who follows marks as well ("i will kill you").

Insults and threats leave the grammar with their marks.  A clause counts by its matches: an
insult by its weight, a threat only with a target in its clause, half of either where it is
negated or reported.  A text's features are sums over its clauses, by marks, its two best
clauses and the share of clauses with a match; no word counts outside its clause.

What is learned, from labelled rows only (doc_id names the label's row and is no feature):

* the insult arcs: word beginnings and whole words that toxic texts hold far more often
  than others, with their log odds as weights.  Beginnings stand for inflected words.
* the weights of marks and the scale: a logistic regression of the labels on the features.

Both are fitted on disjoint halves of a bounded sample: up to `per_label` rows of either
label, those with the smallest hashes, rows with equal text once.  The share of toxic rows
is counted over all training rows.  The model (at most `arcs` arcs) is broadcast.

Results for odd input: null and empty texts score as a text without matches; texts of any
length are read whole, clause by clause; rows that repeat a doc_id are scored each by its text,
and equal texts get equal scores; ties between arcs go to the smaller one, and a score of
exactly 0.5 counts as toxic; without any labelled rows of both kinds every score is the share
of toxic rows (0 without rows); an empty table gives no rows; carried columns: see common.Carried.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import Carried, texts

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
NEGATED, REPORTED, TARGETED = 1, 2, 4

# Words of the closed classes in English, German, French and Spanish.
TARGETS = "you your yours u they them their these those people he she him her everyone everybody du dich dir ihr euch sie ihn ihnen diese leute tu te toi vous les ils elles eux tú ti usted ustedes vosotros los ellos ellas".split()
NEGATIONS = "not no never nor neither isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot nicht kein keine keinen nie niemals jamais pas aucun aucune nunca jamás ningún ninguna tampoco".split()
REPORTS = "said says say called calls wrote writes claimed claims quoted according sagte sagt nannte nennt schrieb laut dit disait appelle appelé selon écrit dijo dice llamó llama según escribió".split()

# Verbs of harm as stems with their endings; a dot stands for none.
THREATS = {
    "kill": ". s ed ing", "murder": ". s ed ing", "hurt": ". s ing", "destroy": ". s ed ing", "beat": ". s en ing", "burn": ". s ed t ing", "crush": ". es ed ing",
    "smash": ". es ed ing", "punch": ". es ed ing", "stab": ". s bed bing", "shoot": ". s ing", "shot": ".", "strangl": "e es ed ing",
    "töt": "en e est et ete eten", "getötet": ".", "umbring": "en e st t", "umgebracht": ".", "schlag": "en e t", "schläg": "st t", "geschlagen": ".", "verprügel": "n e st t", "verbrenn": "en e st t", "zerstör": "en e st t",
    "tue": ". r s nt rai ras ra rons rez ront", "tué": ". s e es", "frapp": "er e es ent é és erai era", "brûl": "er e es ent é és erai era", "détrui": "re s t t sent rai ra",
    "mat": "ar o a as an aré ará arán ó aron ado", "golpe": "ar o a as an aré ará ó ado", "quem": "ar o a as an aré ará ó ado", "destru": "ir iré irá ido yo ye yes yen yó",
}

CLAUSE = re.compile(r"[.!?;:|\n]+|,(?= )")
#: Bytes of words: ASCII letters and digits, the apostrophe, and everything from 0x80 on.
WORDS = bytes(b if b >= 128 or chr(b).isalnum() or b == 39 else 32 for b in range(256))
#: Lengths of the beginnings that can be learned.
PREFIXES = tuple(range(3, 11))


class Machine(NamedTuple):
    """A deterministic transducer over (class, marks): table[state][symbol] = (state, symbol)."""

    table: tuple[tuple[tuple[int, int], ...], ...]


SYMBOLS = 6 * 8


def machine(states: int, step) -> Machine:
    """step(state, class) -> (next state, marks that the symbol gets)."""
    table = []
    for state in range(states):
        row = []
        for symbol in range(SYMBOLS):
            after, marks = step(state, symbol >> 3)
            row.append((after, symbol | (marks if symbol >> 3 in (INSULT, THREAT) else 0)))
        table.append(tuple(row))
    return Machine(tuple(table))


def scope(opens: int, length: int, mark: int) -> Machine:
    """Marks what comes up to `length` words after a word of the class `opens`."""
    return machine(length + 1, lambda s, c: (length if c == opens else max(0, s - 1), mark if s else 0))


def onwards(opens: int, mark: int) -> Machine:
    """Marks all that comes after a word of the class `opens` in the clause."""
    return machine(2, lambda s, c: (1 if c == opens else s, mark if s else 0))


def compose(first: Machine, second: Machine) -> Machine:
    """What `second` makes of the output of `first`, as one machine."""
    n = len(second.table)
    table = []
    for a in first.table:
        for s2 in range(n):
            row = []
            for after, out in a:
                then, end = second.table[s2][out]
                row.append((after * n + then, end))
            table.append(tuple(row))
    return Machine(tuple(table))


SCOPE = 5
GRAMMAR = compose(compose(scope(NEGATION, 4, NEGATED), onwards(REPORT, REPORTED)), scope(TARGET, SCOPE, TARGETED))
BACKWARDS = scope(TARGET, SCOPE, TARGETED)

CLOSED = {w.encode(): c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
FEATURES = ("plain", "targeted", "negated", "reported", "threats", "hedged_threats", "best_clause", "second_clause", "share")


class Letters:
    """A transducer over the letters of words: weights of accepted beginnings, and of whole words (arcs with a final $)."""

    def __init__(self, arcs: dict[bytes, float]):
        self.table: list[dict[int, int]] = [{}]
        self.begins: dict[int, float] = {}
        self.whole: dict[int, float] = {}
        for arc, weight in arcs.items():
            state = 0
            for letter in arc.removesuffix(b"$"):
                after = self.table[state].get(letter)
                if after is None:
                    after = self.table[state][letter] = len(self.table)
                    self.table.append({})
                state = after
            ends = self.whole if arc.endswith(b"$") else self.begins
            ends[state] = max(weight, ends.get(state, 0.0))

    def weight(self, word: bytes) -> float:
        """The best weight that the word is accepted with; 0 if it isn't."""
        state, best = 0, 0.0
        for letter in word:
            state = self.table[state].get(letter)
            if state is None:
                return best
            if state in self.begins and self.begins[state] > best:
                best = self.begins[state]
        return max(best, self.whole.get(state, 0.0))


THREAT_LETTERS = Letters({(stem + ending.replace(".", "")).encode() + b"$": 1.0 for stem, endings in THREATS.items() for ending in endings.split()})

#: Words whose symbols a lexicon remembers, begun anew when full.
REMEMBERED = 200_000


class Lexicon:
    """The letter transducers together: from words to symbols of the clause alphabet, insults with their weights."""

    def __init__(self, arcs: dict[bytes, float]):
        self.insults = Letters(arcs)
        self.seen: dict[bytes, tuple[int, float]] = {}

    def __getstate__(self):
        return {"insults": self.insults, "seen": {}}

    def symbol(self, word: bytes) -> tuple[int, float]:
        """(class, weight); a word of the closed classes is of its class, whatever the insult arcs accept."""
        found = self.seen.get(word)
        if found is None:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            kind = CLOSED.get(word, OTHER)
            weight = 0.0
            if kind == OTHER and (weight := self.insults.weight(word)):
                kind = INSULT
            elif kind == OTHER and THREAT_LETTERS.weight(word):
                kind, weight = THREAT, THREAT_WEIGHT
            found = self.seen[word] = kind, weight
        return found


#: What a threat at a target counts in its clause; insults count their log odds.
THREAT_WEIGHT = 3.0


def tokens(text: str) -> list[bytes]:
    return text.lower().encode().translate(WORDS).split()


def clauses(text: str) -> Iterator[list[bytes]]:
    """Words by clause; a quotation mark reads as a verb of saying."""
    text = text.replace('"', " said ").replace("“", " said ").replace("«", " said ").replace("„", " said ")
    for part in CLAUSE.split(text):
        words = tokens(part)
        if words:
            yield words


def matches(kinds: list[int]) -> list[int]:
    """The symbols of a clause with the marks that the grammar leaves on them."""
    state, out = 0, []
    for kind in kinds:
        state, symbol = GRAMMAR.table[state][kind << 3]
        out.append(symbol)
    state = 0
    for k in range(len(out) - 1, -1, -1):
        state, out[k] = BACKWARDS.table[state][out[k]]
    return out


def clause_score(words: list[bytes], lexicon: Lexicon, sums: Counter) -> float:
    """What the matches of one clause count together; sums by mark go to `sums`."""
    found = [lexicon.symbol(w) for w in words]
    total = 0.0
    for symbol, (kind, weight) in zip(matches([k for k, _ in found]), found, strict=True):
        marks = symbol & 7
        hedged = marks & (NEGATED | REPORTED)
        if kind == INSULT:
            sums["negated" if marks & NEGATED else "reported" if marks & REPORTED else "targeted" if marks & TARGETED else "plain"] += weight
        elif kind == THREAT and marks & TARGETED:
            sums["hedged_threats" if hedged else "threats"] += 1
        else:
            continue
        total += weight / (2 if hedged else 1)
    return total


def features(text: str, lexicon: Lexicon) -> list[float]:
    if not any(lexicon.symbol(w)[0] in (INSULT, THREAT) for w in set(tokens(text))):
        return [0.0] * len(FEATURES)
    sums: Counter = Counter()
    scores = [clause_score(words, lexicon, sums) for words in clauses(text)]
    best = sorted(scores, reverse=True)[:2]
    sums["best_clause"], sums["second_clause"] = [*best, 0.0][:2]
    sums["share"] = 100 * sum(s > 0 for s in scores) / max(10, len(scores))
    return [float(np.log1p(sums[k])) for k in FEATURES]


class Model(NamedTuple):
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, rows: list[list[float]]) -> np.ndarray:
        x = (np.array(rows, float).reshape(-1, len(FEATURES)) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Newton steps on the penalized likelihood; the bias isn't penalized."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    penalty = np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        gradient = x1.T @ (weight * (p - y)) + penalty @ w
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + penalty, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


# Learning.


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """text, toxic, half: up to per_label training rows of either label, those with the smallest hashes."""
    rows = None
    for y in (0, 1):
        own = labels.where(F.col("toxic") == y).select("doc_id", "toxic", F.xxhash64("doc_id", F.lit(7)).alias("h")).orderBy("h", "doc_id").limit(per_label)
        rows = own if rows is None else rows.unionByName(own)
    picked = docs.join(F.broadcast(rows), "doc_id").select("text", "toxic")
    return picked.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(2)).alias("half"))


def arcs_of(texts_by_label: DataFrame, arcs: int, least: float) -> dict[bytes, float]:
    """Word beginnings and words with log odds of `least` or more, counted once a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = set(tokens(text))
                seen[y].update({w[:n] for n in PREFIXES for w in words if len(w) >= n} | {w + b"$" for w in words})
        every = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(every, pa.binary()), pa.array([seen[1][a] for a in every], pa.int64()), pa.array([seen[0][a] for a in every], pa.int64())], ["arc", "toxic", "clean"])

    n = {r[0]: r[1] for r in texts_by_label.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return {}
    support = max(3, n[1] // 100)
    rows = texts_by_label.select("text", "toxic").mapInArrow(count, "arc binary, toxic long, clean long").groupBy("arc").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n[1] + 1)) - F.log((F.col("clean") + 1.0) / (n[0] + 1))
    good = rows.where(F.col("toxic") >= support).withColumn("w", odds).where(F.col("w") >= least)
    return {bytes(r["arc"]): r["w"] for r in good.orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "arc").limit(arcs).collect()}


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 4000, arcs: int = 3000, least: float = 2.0) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1), training rows only."""
    labels = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    share = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    total = sum(share.values())
    none = np.zeros(len(FEATURES))
    prior = (share.get(1, 0) + 0.5) / (total + 1)
    if not share.get(0) or not share.get(1):
        return Model(Lexicon({}), none, none + 1, none, float(np.log(prior / (1 - prior))) if total else -30.0)
    rows = sample(texts(docs), labels, per_label).persist()
    lexicon = Lexicon(arcs_of(rows.where("half = 0"), arcs, least))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, lexicon) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "x"])

    held = rows.where("half = 1").select("text", "toxic").mapInArrow(measure, "toxic int, x array<double>").collect()  # at most 2 * per_label short rows
    x, y = np.array([r["x"] for r in held], float).reshape(-1, len(FEATURES)), np.array([r["toxic"] for r in held], float)
    rows.unpersist()
    if len(set(y.tolist())) < 2:
        return Model(lexicon, none, none + 1, none + 0.5, -3.0)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    weights, bias = logistic((x - mean) / scale, y, weight)
    return Model(lexicon, mean, scale, weights, bias)


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score (0 to 1), and the columns named in carry."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    carried = Carried(docs, carry, ("doc_id", "score"))
    inside = carried.inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, held.value.lexicon) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.scores(found)), *[batch.column(c) for c in inside]], ["doc_id", "score", *inside])

    doc_id, text = F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")
    return carried.back(docs.select(doc_id, text, *carried.columns).mapInArrow(run, "doc_id long, score double" + carried.schema))


def held_out(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0


def fitted(docs: DataFrame, labels: DataFrame, **options) -> Model:
    """A model of the rows that aren't held out."""
    return learn(docs, labels.where(~held_out()), **options)
