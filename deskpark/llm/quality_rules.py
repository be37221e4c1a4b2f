"""Quality rules by distribution divergence, with DataFrame functions only.

Each text has two histograms: of its character classes, and of the common words of its corpus with one
entry for all other words. Both are compared with the reference of the text's language by
Jensen-Shannon distance (base 2, from 0 to 1). A first reference is the sum over all documents of the
language that pass the base rules; the reference proper leaves out those that are far from the first.
A text far from its language is rejected; a text shorter than the guards is not judged. Common words
are the ``VOCABULARY`` most frequent words of at most ``SHORT`` letters of each language, counted over
all documents. Documents without a language are compared with the whole corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpark.llm.common import ASCII_SPACE, let, words_of
from deskpark.plans.materialize import materialize

#: Common words of a language, and the letters that one has at most.
VOCABULARY, SHORT = 24, 5
#: A text is rejected whose classes are beyond ``FAR_CLASSES``, or beyond ``OFF_CLASSES`` while its words are
#: beyond ``OFF_WORDS``; and how many characters and words a text needs for either distance.
FAR_CLASSES, OFF_CLASSES, OFF_WORDS = 0.33, 0.12, 0.29
LEAST_CHARS, LEAST_WORDS = 200, 60
WINDOW = 5
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
# Each character by itself: Java looks such a class up in one table.
_SPACES = r"[ \t\n\x0B\f\r]+"
_SYMBOLS, _STOPS, _MARKS = "#*$%&|<>", ".,;:!?'\"()-", "@+/=\\^_`~[]{}"


def base_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, text) -> (doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, w)."""
    text = F.coalesce("text", F.lit(""))
    df = docs.select("doc_id", "lang", text.alias("t"), F.array_remove(F.split(text, _SPACES), "").alias("w"))
    # All but the lower-case letters, which are most of a text: further counts need only read these.
    df = df.withColumn("rest", F.regexp_replace("t", F.lit("[a-z]+"), F.lit("")))
    without = lambda chars: (F.length("rest") - F.length(F.translate("rest", chars, ""))).cast("long")
    space, symbols = without(ASCII_SPACE), without(_SYMBOLS)
    lower, total = (F.length("t") - F.length("rest")).cast("long"), F.length("t").cast("long")
    upper, digits, stops, marks = without(_UPPER), without(_DIGITS), without(_STOPS), without(_MARKS)
    classes = F.array(lower, upper, digits, space, stops, symbols, marks)
    df = df.select("doc_id", "lang", "t", "w", (total - space).alias("word_chars"), symbols.alias("n_symbols"), total.alias("total"), classes.alias("classes"))
    other = F.col("total") - F.aggregate("classes", F.lit(0).cast("long"), lambda a, b: a + b)
    lines = F.filter(F.split("t", "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.select("doc_id", "lang", "w", "word_chars", "n_symbols", F.concat("classes", F.array(other)).alias("classes"), lines.alias("lines"))
    dup = F.size("lines") - F.size(F.array_distinct("lines"))
    return df.select("doc_id", "lang", "w", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols",
                     dup.cast("long").alias("n_dup_lines"), let(_windows(F.col("w")), _repeated).alias("n_repeat_words"), "classes")


def _windows(words: Column) -> Column:
    """The hash of each window of ``WINDOW`` words, put together from the hashes of its words."""

    def windows(hs: Column) -> Column:
        at = F.transform(hs, lambda h, i: F.xxhash64(h, *[F.get(hs, i + k) for k in range(1, WINDOW)]))
        return F.slice(at, F.lit(1), F.greatest(F.size(hs) - (WINDOW - 1), F.lit(0)))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs again in the text; a text without any is told from the distinct hashes alone."""

    def covered(s: Column) -> Column:
        like = lambda k, other: F.coalesce(F.get(s, k)["h"] == F.get(s, other)["h"], F.lit(False))
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: like(k, k - 1) | like(k, k + 1))
        places = F.sort_array(F.transform(again, lambda k: F.get(s, k)["i"]))
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, covered))


def common_words(docs: DataFrame, each: int = VOCABULARY) -> list[str]:
    """The most frequent short words of each language, counted over all documents; ``each`` of a language at most."""
    words = docs.select("lang", F.explode(F.filter(words_of(F.col("text")), lambda w: F.length(w) <= SHORT)).alias("word"))
    counted = words.groupBy("lang", "word").count().where(F.col("word").rlike(r"^\p{L}+$"))
    rank = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    best = counted.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= each)
    return sorted({r["word"] for r in best.select("word").distinct().collect()})


def judge(docs: DataFrame, far_classes: float = FAR_CLASSES, off_classes: float = OFF_CLASSES, off_words: float = OFF_WORDS) -> DataFrame:
    """(doc_id, text, lang, ...) -> base counts, base_failed, class_distance, word_distance, kept: a row for each input row.

    A null or empty text has no words and fails the base rules; a distance is null where its histogram
    is under its guard or its language has no text that passes the base rules, and then rejects nothing;
    null languages are compared with the whole corpus; repeated rows and null ids are judged like
    others; an empty table gives an empty result; other columns are not read.
    """
    vocabulary = common_words(docs)
    held = base_counts(docs)
    counts = let(F.filter("w", lambda w: w.isin(vocabulary)), lambda own: _counts(own, vocabulary)) if vocabulary else F.array().cast("array<bigint>")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    held = held.select("doc_id", "lang", *base, "classes", counts.alias("common"), failed.alias("base_failed"))
    others = F.array(F.col("n_words") - _total("common"))
    held = materialize(held.withColumn("common", F.concat("common", others)))
    bounds = (far_classes, off_classes, off_words)
    first = _far(held, _references(held.where(~F.col("base_failed")), len(vocabulary) + 1), *bounds)
    good = first.where(~F.col("base_failed") & ~F.col("far")).select(held.columns)
    out = _far(held, _references(good, len(vocabulary) + 1), *bounds)
    return out.select("doc_id", *base, "base_failed", (~F.col("base_failed") & ~F.col("far")).alias("kept"), "class_distance", "word_distance")


def _counts(own: Column, vocabulary: list[str]) -> Column:
    """How often each word of the vocabulary occurs among the words ``own``; only those that occur are looked for in the joined words."""
    padded = lambda v: F.concat(F.lit(" "), v, F.lit(" "))
    joined = F.concat(F.lit(" "), F.array_join(own, "  "), F.lit(" "))

    def each(held: Column) -> Column:
        count = lambda v: ((F.length(held["joined"]) - F.length(F.replace(held["joined"], padded(v), F.lit("")))) / (F.length(v) + 2)).cast("long")
        return F.transform(F.array(*map(F.lit, vocabulary)), lambda v: F.when(F.array_contains(held["kinds"], v), count(v)).otherwise(F.lit(0).cast("long")))

    return let(F.struct(joined.alias("joined"), F.array_distinct(own).alias("kinds")), each)


def _total(counts: str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b)


def _far(held: DataFrame, refs: DataFrame, far_classes: float, off_classes: float, off_words: float) -> DataFrame:
    """``held`` with class_distance, word_distance and far: whether they are beyond the bounds."""
    refs = materialize(refs)
    named = refs.select(*[F.col(c).alias(f"ref_{c}") for c in refs.columns])
    # One row for each language, of a hundred numbers: a table of languages, not of documents.
    known = F.broadcast(named) if named.count() <= 10_000 else named
    out = held.join(known, F.coalesce("lang", F.lit("")) == F.col("ref_lang"), "left")
    out = out.withColumn("class_distance", F.when(_total("classes") >= LEAST_CHARS, distance("classes", "ref_classes")))
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= LEAST_WORDS, distance("common", "ref_common")))
    far = (F.col("class_distance") > far_classes) | (F.col("class_distance") > off_classes) & (F.col("word_distance") > off_words)
    return out.withColumn("far", F.coalesce(far, F.lit(False)))


def _references(good: DataFrame, words: int) -> DataFrame:
    """(lang, classes, common) summed over the documents of a language; the language '' is the whole corpus."""
    sums = [F.sum(F.get("classes", F.lit(k))).alias(f"c{k}") for k in range(8)] + [F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(words)]
    each = good.groupBy("lang").agg(*sums)
    every = each.groupBy().agg(*[F.sum(c).alias(c) for c in each.columns[1:]]).select(F.lit("").alias("lang"), *each.columns[1:])
    both = each.where("lang <> ''").union(every.where("c0 is not null"))
    classes, common = F.array(*[f"c{k}" for k in range(8)]), F.array(*[f"w{k}" for k in range(words)])
    return both.select("lang", classes.alias("classes"), common.alias("common"))


def distance(p: str, q: str) -> Column:
    """Jensen-Shannon distance (base 2) of two arrays of counts of one length; null if either is empty of counts."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, b: a + b)
    share = lambda c, n: F.transform(c, lambda x: x / n)
    both = F.get(F.transform(F.array(F.struct(total(p).alias("p"), total(q).alias("q"))), lambda n: F.when(
        (n["p"] > 0) & (n["q"] > 0), F.zip_with(share(p, n["p"]), share(q, n["q"]), _part))), 0)
    divergence = F.aggregate(both, F.lit(0.0), lambda a, b: a + b)
    return F.when(divergence.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), divergence)))


def _part(x: Column, y: Column) -> Column:
    one = lambda v: F.when(v > 0, v * F.log2(2 * v / (x + y))).otherwise(0.0)
    return 0.5 * (one(x) + one(y))
