"""Spelling variant grouping by permuterm rotations.

A word marked with a terminator has a rotation for each of its places. Rotated so that the edited
character comes last, two words that differ by one replaced character share all of their rotation but
that last character; a word that lacks the character is the shared part itself. So the neighbours of a
word are found in one prefix range of the sorted rotations for each place: the rotations that go on from
the shared part by at most one character. A range holds at most one word for each letter of the alphabet
and the word without it, whatever the number of words; it is scanned once, and every word in it gets the
count of its neighbours there and the most frequent of them. No pairs are written.

A shared part and the character after it spell the word, so rotations carry no copy of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deskpark.plans.materialize import materialize

#: Letters of a run; the terminator is none of them.
LETTERS, END = "A-Za-zÀ-ÿ", "$"
#: Code points and occurrences that a word has at least; a run in ``EDITED`` loses a character; a form is so many times as frequent.
LEAST_LENGTH, LEAST_COUNT, EDITED, TIMES = 5, 3, 97, 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(doc_id, text) -> (word, n): the words of all runs, where one run in ``EDITED`` has lost a character."""
    run = F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"([{LETTERS}]{{{least_length},}})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    ascii_only = F.length("run") == F.octet_length("run")
    runs = runs.select("id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    edited = runs.select(F.when(F.col("h") % EDITED == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = edited.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _rotations(vocabulary: DataFrame) -> DataFrame:
    """(part, c, n): each word's rotation for each place, split into all but the last character and that; c is '' for a whole rotation."""
    word = F.col("word")
    rest = lambda i, skip: F.concat(F.substr(word, i + 1 + skip), F.lit(END), F.substr(word, F.lit(1), i))
    cut = F.transform(F.sequence(F.lit(0), F.length(word) - 1), lambda i: F.struct(rest(i, 1).alias("part"), F.substr(word, i + 1, F.lit(1)).alias("c")))
    whole = F.transform(F.sequence(F.lit(0), F.length(word)), lambda i: F.struct(rest(i, 0).alias("part"), F.lit("").alias("c")))
    return vocabulary.select("n", F.explode(F.concat(cut, whole)).alias("r")).select("r.part", "r.c", "n")


def neighbours(vocabulary: DataFrame) -> DataFrame:
    """Distinct (word, n) -> (word, n_near, near): the near words' count and the best of them as (falling, word).

    ``falling`` is minus the near word's n, so that the least struct is the most frequent word, ties by
    code points. Words without a near word have no row.
    """
    group = Window.partitionBy("part")
    rows = _rotations(vocabulary)
    # Deleting any character of a row of equal ones gives the same word: the first of the row counts.
    stem = F.substring_index("part", END, -1)
    rows = rows.withColumn("whole", F.col("c") == "")
    rows = rows.withColumn("first", ~F.col("whole") & ~F.endswith(stem, F.col("c")))
    best = F.struct((-F.col("n")).alias("falling"), "c")
    order = group.orderBy("whole", F.desc("n"), "c")
    rows = rows.select(
        "part", "c", "n", "whole", "first", F.sum((~F.col("whole")).cast("int")).over(group).alias("cut"),
        F.sum(F.col("first").cast("int")).over(group).alias("firsts"), F.max(F.when(F.col("whole"), F.col("n"))).over(group).alias("whole_n"),
        F.min(F.when(~F.col("whole"), best)).over(group).alias("top"), F.min(F.when(F.col("first"), best)).over(group).alias("top_first"),
        F.lead(F.when(~F.col("whole"), best)).over(order).alias("next"))
    spell = lambda c: F.concat(stem, c, F.substring_index("part", END, 1))
    named = lambda s: F.when(s.isNotNull(), F.struct(s.falling.alias("falling"), spell(s.c).alias("word")))
    # The best other word of a range: the best of all, or for that word itself the next.
    other = F.when(F.col("top").c == F.col("c"), F.col("next")).otherwise(F.col("top"))
    lacking = F.col("first") & F.col("whole_n").isNotNull()
    shorter = F.when(lacking, F.struct((-F.col("whole_n")).alias("falling"), spell(F.lit("")).alias("word")))
    count = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("cut") - 1 + lacking.cast("int"))
    near = F.when(F.col("whole"), named(F.col("top_first"))).otherwise(F.least(named(other), shorter))
    found = rows.where(count > 0).select(spell(F.col("c")).alias("word"), count.alias("k"), near.alias("near"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("near").alias("near"))


def _roots(linked: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last. A form is more frequent than its word, so no way returns.

    Each round doubles the way: ways are no longer than the logarithm of the greatest count.
    """
    ways = materialize(linked.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("via"), F.col("root").alias("further"))
        stepped = ways.join(on, ways.root == on.via, "left")
        ways = materialize(stepped.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")
        ways = ways.select("word", "root")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(doc_id, text, ...) -> (word, form, root, n, n_near, form_n), one row for each word.

    Null and empty texts have no words, a null id is the empty text before the colon, rows that share an
    id and repeated rows all count, texts of any length count whole; words of equal count are taken in
    code-point order; an empty table gives an empty result; other columns are not read.
    """
    vocabulary = materialize(words(docs, least_length, least_count))
    near = neighbours(vocabulary).withColumnRenamed("word", "near_word")
    held = vocabulary.join(near, F.col("word") == F.col("near_word"), "left")
    often: Column = -F.col("near.falling") >= times * F.col("n")
    held = materialize(held.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("near.word")).alias("form"),
        F.when(often, -F.col("near.falling")).alias("form_n")))
    roots = _roots(held.where("form is not null")).withColumnRenamed("word", "rooted")
    out = held.join(roots, F.col("word") == F.col("rooted"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
