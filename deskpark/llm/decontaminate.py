"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

A text is read in two ways, as rows of lower-cased words without punctuation. In both, a number and the
unit behind it are typed placeholders. The plain reading keeps all other words, so that a copy is met in
any case and spacing; the typed reading makes each row of up to four capitalised words, wherever it
stands, one name placeholder, on both sides alike, so that names may be changed, longer or shorter.
Windows of five read words (of all words, for an item of three or four) are hash-joined to those of the
benchmark items. A window needs two plain words to be a template; one of fewer is met with its own values
only, and counts only in items that mostly consist of such. An item is leaked by a text that holds, in
one reading and in one place, at least 0.8 of the item's distinct windows, unless the slots contradict:
each number, unit or name of the item must stand for one and the same value (for at least 0.8 of the
slots of the windows in common, by the commonest value).

A text that leaks an item holds one of a few of its rarest words; only texts with such a word are windowed. The
words are those of so many of the item's windows that the others are too few (see ``_likely``): no leak is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deskpark.llm.common import let
from deskpark.plans.materialize import materialize

WINDOW = 5
SHARE = 0.8
#: Plain words of a template; words of an item that is looked for inside texts (a shorter one is met as a whole text).
PLAIN_WORDS, INSIDE = 2, 3
#: Rows that may be broadcast at most (a few longs each); larger sides are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Words that texts are filtered by at most, with more of them every text is windowed; texts of which one is read
#: to estimate how rare a word is.
FILTER_WORDS, ESTIMATE = 20_000, 64
#: FIXED VALUES: units that may follow a number.
UNITS = (
    "km cm mm m mi ft in yd kg mg g lb lbs oz t l ml cl gal s ms min h hr hrs kb mb gb tb hz khz mhz ghz w kw mw v a "
    "percent degrees meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch "
    "inches yard yards gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon "
    "gallons second seconds minute minutes hour hours day days week weeks month months year years dollar dollars "
    "euro euros cent cents usd eur"
).split()
_MARK, _JOIN = "\u0001", "\u0003"
_SPACE = r" \t\n\x0B\f\r"
#: Spaces, dashes and quotes beyond ASCII, taken as spaces.
_WIDE = r"[\u00A0\u2000-\u206F\u3000]"
# Each character by itself: Java looks such a class up in one table, but tests ranges one by one.
_BETWEEN = f"[{_SPACE}" + "".join(f"\\{c}" for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") + "]+"
_COMMON = "[^ abcdefghijklmnopqrstuvwxyz,.]"
_POINT = r"(?<=[0-9])[.,](?=[0-9])"
_NUMBER = r"(?=[0-9])(?<![\p{L}\p{N}_])[0-9]+"
_UNIT = rf"(?i)({_MARK}n[0-9]+[{_SPACE}]+)({'|'.join(UNITS)}|%)(?![\p{{L}}\p{{N}}])"
_CAPITAL = r"(\p{Lu}[\p{Ll}\p{M}]+)(?![\p{L}\p{N}])"
_NAME = rf"(?={_COMMON})(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_CAPITAL}" + rf"(?:[{_SPACE}]+{_CAPITAL})?" * 3 + r"(?:'s(?![\p{L}\p{N}]))?"
PLAIN, TYPED = 0, 1
_EXACT, _WHOLE = 2, 3  # salts of the plain reading's windows beside PLAIN and TYPED


def _counted(text: Column) -> Column:
    """The text with its numbers and units marked, n or u and the value."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(_MARK), F.lit(" ")), F.lit(_JOIN), F.lit(" "))
    t = F.when(F.length(t) == F.octet_length(t), t).otherwise(F.regexp_replace(t, F.lit(_WIDE), F.lit(" ")))
    marked = F.regexp_replace(F.regexp_replace(t, F.lit(_POINT), F.lit("")), F.lit(_NUMBER), F.lit(f" {_MARK}n$0 "))
    marked = F.regexp_replace(marked, F.lit(_UNIT), F.lit(f"$1{_MARK}u$2 "))
    return F.when(t.rlike("[0-9]"), marked).otherwise(t)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), _BETWEEN), "")


def read(text: Column, reading: int, values: bool = True) -> Column:
    """The words of a text in one reading; a placeholder is a mark, its kind and its value (of a name only with ``values``)."""
    t = _counted(text)
    if reading == TYPED:
        value = _JOIN.join(f"${k}" for k in (1, 2, 3, 4)) if values else ""
        t = F.regexp_replace(t, F.lit(_NAME), F.lit(f" {_MARK}p{value} "))
    return _words(t)


def _kind(word: Column) -> Column:
    """A placeholder without its value; other words as they are."""
    return F.when(F.startswith(word, F.lit(_MARK)), F.substr(word, F.lit(1), F.lit(2))).otherwise(word)


def _hashes(words: Column, exact: bool = False) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w if exact else _kind(w)))


def _slide(hashes: Column, size: int, salt: int) -> Column:
    """The hash of each window of ``size`` words."""
    def windows(hs: Column) -> Column:
        at = F.transform(hs, lambda h, i: F.xxhash64(F.lit(10 * size + salt), h, *[F.get(hs, i + k) for k in range(1, size)]))
        return F.slice(at, F.lit(1), F.greatest(F.size(hs) - (size - 1), F.lit(0)))

    return let(hashes, windows)


def _whole(hashes: Column) -> Column:
    """The hash of a text of fewer words than a window, as an array; longer texts and those without a word have none."""
    one = lambda hs: F.xxhash64(F.lit(_WHOLE), F.array_join(F.transform(hs, lambda h: h.cast("string")), " "))
    few = lambda hs: F.when((F.size(hs) > 0) & (F.size(hs) < WINDOW), F.array(one(hs))).otherwise(F.array().cast("array<bigint>"))
    return let(hashes, few)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text, ...), (item_id, text, ...) -> (doc_id, item_id, n_windows, n_found, slot_agreement).

    One row for each item that a document leaks. Null ids are not reported, and items with a null id or
    without a word leak nowhere; an item of one or two words, or of three or four without two plain ones, is
    leaked by a text of just those words; rows that share an id are judged each by its own text and reported once,
    by the best; slot_agreement is 1 where no window in common has a slot; texts of any length are read
    whole; empty tables give an empty result; other columns are not read.
    """
    found = _text_leaks(docs, benchmark)
    named = _keyed(docs.where("doc_id is not null").select("doc_id", "text")).drop("text")
    best = F.max(F.struct(F.col("n_found") / F.col("n_windows"), "slot_agreement", "n_windows", "n_found")).alias("best")
    out = named.join(_small(found), ["_t", "_u"]).groupBy("doc_id", "item_id").agg(best)
    return out.select("doc_id", "item_id", "best.n_windows", "best.n_found", "best.slot_agreement")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` with all their columns whose text leaks no item, those with a null id as well."""
    bad = materialize(_text_leaks(docs, benchmark).select(F.struct("_t", "_u").alias("_key")).distinct())
    name = "_key"
    while name in docs.columns:
        name += "_"
    t, u = _key(F.col("text"))
    keyed = docs.withColumn(name, F.struct(t.alias("_t"), u.alias("_u")))
    return keyed.join(_small(bad.withColumnRenamed("_key", name)), name, "left_anti").select(docs.columns)


def _key(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text: what a text leaks depends on nothing else."""
    t = F.coalesce(text, F.lit(""))
    return F.xxhash64(t), F.xxhash64(F.lit(1), t)


def _keyed(rows: DataFrame) -> DataFrame:
    t, u = _key(F.col("text"))
    return rows.withColumn("_t", t).withColumn("_u", u)


def _text_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(_t, _u, item_id, n_windows, n_found, slot_agreement) of each distinct text and item that it leaks."""
    wanted = materialize(_wanted(benchmark))
    views = wanted.groupBy("item_id", "reading", "words").agg(F.count_distinct("h").alias("n"))
    kinds = sorted((r.salt, r.size) for r in wanted.select("salt", "size").distinct().collect())  # a dozen at most

    texts = _keyed(_likely(docs.select("text"), wanted))
    held = texts.select("_t", "_u", F.explode(_window_hashes(F.col("text"), kinds)).alias("h"))
    short = wanted.select("item_id", "reading", "h").distinct()
    met = held.join(_small(short), "h").groupBy("_t", "_u", "item_id", "reading").agg(F.count_distinct("h").alias("found"))
    met = materialize(met.join(_small(views), ["item_id", "reading"]).where(F.col("found") >= SHARE * F.col("n")).drop("found"))

    few = _small(met.select("_t", "_u").distinct())
    own = _keyed(docs.select("text")).join(few, ["_t", "_u"], "left_semi").dropDuplicates(["_t", "_u"])
    own = materialize(own).select("_t", "_u", F.explode(_placed(F.col("text"), kinds)).alias("own")).select("_t", "_u", "own.*")
    place = _places(own, met, short)
    return _agreeing(own, place, wanted)


def _window_hashes(text: Column, kinds: list[tuple[int, int]]) -> Column:
    """All window hashes of a text that an item may have: by salt and number of words."""
    parts = []
    for salt, size in kinds:
        hashes = _hashes(read(text, TYPED if salt == TYPED else PLAIN, values=False), salt in (_EXACT, _WHOLE))
        parts.append(_whole(hashes) if salt == _WHOLE else _slide(hashes, size, salt))
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


def _placed(text: Column, kinds: list[tuple[int, int]]) -> Column:
    """(p, h, few) of the windows of a text, as ``_window_hashes``: place, hash, words with their values."""
    def of(salt: int, size: int):
        def windows(words: Column) -> Column:
            hashes = _hashes(words, salt in (_EXACT, _WHOLE))
            if salt == _WHOLE:
                return F.transform(_whole(hashes), lambda h: F.struct(F.lit(0).alias("p"), h.alias("h"), words.alias("few")))
            return F.transform(_slide(hashes, size, salt), lambda h, i: F.struct(i.alias("p"), h.alias("h"), F.slice(words, i + 1, size).alias("few")))

        return windows

    parts = [let(read(text, TYPED if salt == TYPED else PLAIN), of(salt, size)) for salt, size in kinds]
    return F.concat(*parts) if parts else F.array().cast("array<struct<p:int,h:bigint,few:array<string>>>")


def _wanted(benchmark: DataFrame) -> DataFrame:
    """(item_id, reading, words, salt, size, q, h, few): the windows of each item that count, in each reading.

    words is the number of the item's words in that reading, q the window's place and few its words with their values.
    """
    items = benchmark.where("item_id is not null").select("item_id", "text").distinct()
    both = F.array(*[F.struct(F.lit(r).alias("reading"), read(F.col("text"), r).alias("w")) for r in (PLAIN, TYPED)])
    rows = items.select("item_id", F.explode(both).alias("r")).select("item_id", "r.reading", "r.w").where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WINDOW))
    at = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda q: F.struct(q.alias("q"), F.slice("w", q + 1, size).alias("few")))
    rows = rows.select("item_id", "reading", F.size("w").alias("words"), size.alias("size"), F.explode(at).alias("at"))
    rows = rows.select("item_id", "reading", "words", "size", "at.q", "at.few")
    is_plain = lambda w: ~F.startswith(w, F.lit(_MARK))
    plain = F.filter("few", is_plain)
    rows = rows.withColumn("good", F.size(plain) >= PLAIN_WORDS)
    view = W.partitionBy("item_id", "reading")
    rows = rows.withColumn("mostly", 2 * F.sum(F.col("good").cast("int")).over(view) >= F.count("*").over(view))
    inside = (F.col("words") >= INSIDE) & F.col("mostly")
    salt = F.when(inside & F.col("good"), F.col("reading"))  # a template
    salt = salt.when(F.col("mostly") & (F.col("words") >= INSIDE) | (F.col("reading") == TYPED), F.lit(None))
    salt = salt.when(F.col("words") < WINDOW, F.lit(_WHOLE)).when(F.col("good"), F.lit(PLAIN)).otherwise(F.lit(_EXACT))
    rows = rows.withColumn("salt", salt).where("salt is not null")
    whole = F.get(_whole(_hashes(F.col("few"), exact=True)), 0)
    hashed = F.when(F.col("salt") == _WHOLE, whole)
    for n in range(INSIDE, WINDOW + 1):
        for s in (PLAIN, TYPED, _EXACT):
            hashed = hashed.when((F.col("size") == n) & (F.col("salt") == s), F.get(_slide(_hashes(F.col("few"), s == _EXACT), n, s), 0))
    return rows.select("item_id", "reading", "words", "salt", "size", "q", hashed.alias("h"), "few")


def _likely(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts that hold a word without which too many windows of an item are missing: no other text leaks one.

    Of an item's n windows, n - ceil(0.8 n) + 1 are taken, each named by its rarest word, those of the rarest
    words: a text without any of these words lacks them all. How rare a word is, is estimated from one
    text in ``ESTIMATE``; the estimate decides which words are taken, and so how many texts are spared, but not
    which texts leak.
    """
    each = wanted.select("item_id", "reading", "h", F.explode("few").alias("word")).distinct()
    few = docs.where(F.pmod(F.xxhash64("text"), F.lit(ESTIMATE)) == 0)
    seen = few.select(F.explode(F.array_distinct(read(F.col("text"), PLAIN))).alias("word"))
    seen = seen.join(_small(each.select("word").distinct()), "word").groupBy("word").agg(F.count("*").alias("texts"))
    rank = F.struct((F.startswith("word", F.lit(_MARK + "p"))).alias("name"), F.startswith("word", F.lit(_MARK)).alias("marked"),
                    F.coalesce("texts", F.lit(0)).alias("texts"), (-F.length("word")).alias("letters"), "word")
    windows = each.join(seen, "word", "left").groupBy("item_id", "reading", "h").agg(F.min(rank).alias("r"))
    view = W.partitionBy("item_id", "reading")
    windows = windows.withColumn("n", F.count("*").over(view)).withColumn("k", F.row_number().over(view.orderBy("r", "h")))
    needed = windows.where(F.col("k") <= F.col("n") - F.ceil(SHARE * F.col("n")) + 1).select("r.word").distinct()
    found = [r.word for r in needed.limit(FILTER_WORDS + 1).collect()]
    if len(found) > FILTER_WORDS:
        return docs
    return docs.where(F.exists(read(F.col("text"), PLAIN), lambda w: w.isin(found))) if found else docs.where(F.lit(False))


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it was counted to be small; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _places(own: DataFrame, met: DataFrame, short: DataFrame) -> DataFrame:
    """(_t, _u, item_id, reading, low, high, n, found): the one place of each text that holds enough of an item.

    Places are spans of four times the item's words, each overlapping half of the next, so that a copy lies
    within one; of an item's readings and places the one of the greatest share counts, then the plain one, then the first.
    """
    pair = ["_t", "_u", "item_id", "reading"]
    rows = own.select("_t", "_u", "p", "h").join(_small(met), ["_t", "_u"]).join(_small(short), ["item_id", "reading", "h"])
    step = 2 * F.col("words")
    b = F.floor(F.col("p") / step)
    rows = rows.select(*pair, "n", "words", "h", F.explode(F.array(b - 1, b)).alias("b"))
    rows = rows.groupBy(*pair, "n", "words", "b").agg(F.count_distinct("h").alias("found")).where(F.col("found") >= SHARE * F.col("n"))
    best = F.max(F.struct((F.col("found") / F.col("n")).alias("share"), (-F.col("reading")).alias("r"), (-F.col("b")).alias("b"), "words", "n", "found")).alias("best")
    rows = rows.groupBy("_t", "_u", "item_id").agg(best)
    low = -F.col("best.b") * 2 * F.col("best.words")
    return materialize(rows.select("_t", "_u", "item_id", (-F.col("best.r")).alias("reading"), low.alias("low"),
                                   (low + 4 * F.col("best.words")).alias("high"), "best.n", "best.found"))


def _agreeing(own: DataFrame, place: DataFrame, wanted: DataFrame) -> DataFrame:
    """The places whose slots do not contradict: share of slots that take their item value's commonest value, where p - q is the same."""
    pair = ["_t", "_u", "item_id"]
    held = own.join(_small(place), ["_t", "_u"]).where("p >= low and p < high").drop("low", "high")
    items = wanted.where(F.col("salt") == F.col("reading")).select("item_id", "reading", "h", "q", F.col("few").alias("meant")).distinct()
    both = held.join(_small(items), ["item_id", "reading", "h"])
    slots = F.filter(F.arrays_zip("meant", "few"), lambda s: F.startswith(s["meant"], F.lit(_MARK)))
    both = both.select(*pair, (F.col("p") - F.col("q")).alias("place"), F.explode(slots).alias("s"))
    counted = both.groupBy(*pair, "place", F.col("s.meant").alias("meant"), F.col("s.few").alias("value")).count()
    counted = counted.groupBy(*pair, "place", "meant").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    agreed = counted.groupBy(*pair).agg((F.sum("most") / F.sum("all")).alias("slot_agreement"))
    out = place.join(agreed, pair, "left").withColumn("slot_agreement", F.coalesce("slot_agreement", F.lit(1.0)))
    return materialize(out.where(F.col("slot_agreement") >= SHARE).select(
        *pair, F.col("n").alias("n_windows"), F.col("found").alias("n_found"), "slot_agreement"))
