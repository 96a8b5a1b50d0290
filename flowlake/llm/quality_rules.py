"""Quality rules by distribution divergence, in DataFrame expressions only.

One pass over the texts gives each document a row of counts: words, symbols, repeated
lines and word triples, characters by class, and occurrences of common words of its
language.  Counts are summed per language to the language references (one small row
each), and every document is compared with the reference of its language by the
Jensen-Shannon distance (base 2, 0 to 1) of both histograms.  Documents whose language is
none of COMMON_WORDS are compared with the sum of all documents, over the words of all
lists.

Minimum-length guards: distances are not judged where they would be noise, the classes
below `min_chars` word characters and the words below `min_common` common words seen.

Results for odd input: null texts count as empty, which fail the base rules; texts of any
length are counted whole; an empty table gives no rows; repeated rows are judged one by one;
a distance that equals its limit is kept; a null language has the reference of all; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import written

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
#: Positions take the low bits of a sort key, hash bits the others.
POSITION_BITS = 30

# Frequent function words of four languages.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split(),
    "en": "the of and to in a is that for it as was with be by on not he his are this at from or an have had which you were".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son aux ou".split(),
}
CLASSES = ("letters", "wide_letters", "digits", "punctuation", "symbols", "other")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once for each row."""
    return F.transform(F.array(value), body)[0]


def chars_without(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def repeated_triple_words(words: Column) -> Column:
    """Words that some 3-word window covers which occurs twice or more in the text.

    Windows are sorted by hash and position as plain integers; windows that share a hash
    with a neighbour are then sorted and compared by their words, so hashes decide nothing.
    """

    def triple(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def key(w: Column, i: Column) -> Column:
        return F.shiftleft(F.shiftright(F.xxhash64(*triple(w, i)), POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))

    def with_equal_neighbour(items: Column, same: Callable[[Column, Column], Column]) -> Column:
        return F.filter(items, lambda x, i: F.coalesce(same(F.get(items, i - 1), x), F.lit(False)) | F.coalesce(same(F.get(items, i + 1), x), F.lit(False)))

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        keys = F.sort_array(F.transform(starts, lambda i: key(w, i)))
        close = bind(keys, lambda k: with_equal_neighbour(k, lambda a, b: F.shiftright(a, POSITION_BITS) == F.shiftright(b, POSITION_BITS)))
        places = F.transform(close, lambda k: k.bitwiseAND((1 << POSITION_BITS) - 1).cast("int"))
        named = F.sort_array(F.transform(places, lambda i: F.struct(F.concat_ws(" ", *triple(w, i)).alias("g"), i.alias("i"))))
        twice = bind(named, lambda s: with_equal_neighbour(s, lambda a, b: a["g"] == b["g"]))
        at = F.sort_array(F.transform(twice, lambda s: s["i"]))
        return bind(at, lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda acc, i: F.struct((acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"]))

    return F.when(F.size(words) >= 4, count(words)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """A row of counts for each document: doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common."""
    lists = F.create_map(*[x for k, v in sorted(COMMON_WORDS.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
    every = F.array(*[F.lit(w) for w in all_words()])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.col("text")

    def by_words(w: Column) -> Column:
        known = F.filter(F.transform(F.filter(w, lambda x: F.length(x) <= 5), F.lower), lambda x: x.isin(*all_words()))
        listed = F.coalesce(lists[F.col("lang")], every)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeated_triple_words(w).alias("n_repeat_words"),
            bind(known, lambda k: F.transform(listed, lambda x: F.size(F.filter(k, lambda y: y == x)).cast("long"))).alias("common"),
        )

    def by_lines(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    #: What is left without white space and ASCII letters is short, and the other classes are counted there.
    def by_chars(dense: Column) -> Column:
        def rest(r: Column) -> Column:
            return F.struct(
                F.length(dense).cast("long").alias("word_chars"),
                F.array(*[x.cast("long") for x in (F.length(dense) - F.length(r), F.length(r) - chars_without(r, r"\p{L}+"), F.length(r) - chars_without(r, "[0-9]+"), F.length(r) - chars_without(r, r"[.,;:!?'\"()\-]+"), F.length(r) - chars_without(r, SYMBOLS), chars_without(r, r"[\p{L}0-9.,;:!?'\"()\-#*$%&|<>]+"))]).alias("classes"),
            )

        return bind(F.regexp_replace(dense, "[A-Za-z]+", ""), rest)

    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("doc_id", "lang", bind(words, by_words).alias("w"), bind(lines, by_lines).alias("n_dup_lines"), bind(F.regexp_replace(text, WORD_GAP, ""), by_chars).alias("c"))
    return rows.select("doc_id", "lang", "w.n_words", "c.word_chars", F.col("c.classes")[4].alias("n_symbols"), "n_dup_lines", "w.n_repeat_words", "c.classes", "w.common")


def all_words() -> list[str]:
    return sorted({w for v in COMMON_WORDS.values() for w in v})


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms of counts of equal length; 0 for an empty one."""

    def share(x: Column) -> Column:
        return bind(F.aggregate(x, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(x, lambda v: v / F.greatest(n, F.lit(1e-300))))

    def half(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def distance(a: Column, b: Column) -> Column:
        return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(F.zip_with(a, b, lambda x, y: (half(x, y) + half(y, x)) / 2), F.lit(0.0), lambda s, v: s + v)))

    return bind(share(p), lambda a: bind(share(q), lambda b: distance(a, b)))


def references(rows: DataFrame) -> DataFrame:
    """lang, ref_classes, ref_common: sums over all documents of a language; the language '' has the sums of all documents' classes."""
    n = len(CLASSES)
    longest = len(all_words())
    kinds = rows.groupBy("lang").agg(*[F.sum(F.get("classes", F.lit(i))).alias(f"k{i}") for i in range(n)], *[F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(longest)])
    own = kinds.select("lang", F.array(*[F.col(f"k{i}") for i in range(n)]).alias("ref_classes"), F.filter(F.array(*[F.col(f"w{i}") for i in range(longest)]), lambda x: x.isNotNull()).alias("ref_common"))
    total = kinds.agg(*[F.sum(f"k{i}").alias(f"k{i}") for i in range(n)]).select(F.lit("").alias("lang"), F.array(*[F.col(f"k{i}") for i in range(n)]).alias("all_classes"))
    return own.join(total, "lang", "left").select("lang", F.coalesce("all_classes", "ref_classes").alias("ref_classes"), "ref_common")


def quality_rules(docs: DataFrame, max_class_distance: float = 0.22, max_word_distance: float = 0.6, min_chars: int = 200, min_common: int = 40) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, word_distance, kept.

    docs: doc_id, text, lang.  References have one row for each of the languages of
    COMMON_WORDS and one for the rest, five at most, so they are broadcast.
    """
    rows = written(measured(docs), "quality-rules")
    judged = rows.join(F.broadcast(references(rows)), "lang", "left")
    judged = judged.select("*", jensen_shannon(F.col("classes"), F.col("ref_classes")).alias("class_distance"), jensen_shannon(F.col("common"), F.col("ref_common")).alias("word_distance"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    far = ((F.col("word_chars") >= min_chars) & (F.col("class_distance") > max_class_distance)) | ((F.aggregate("common", F.lit(0).cast("long"), lambda a, b: a + b) >= min_common) & (F.col("word_distance") > max_word_distance))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "class_distance", "word_distance", (~base & ~F.coalesce(far, F.lit(False))).alias("kept"))
