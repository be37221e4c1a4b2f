"""Quality rules: base counts and Jensen-Shannon distances against brute force, edge rows."""

import math
import re
from collections import Counter

import pytest

from deskpark.llm import quality_rules as r
from deskpark.llm.queries import queries
from llm.cases import EDGE, SF_SMALL


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def base(row):
    return row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed


def test_query_equals_brute_force(spark):
    docs = {x.doc_id: x.text for x in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries()["op3_quality_rules"](spark, SF_SMALL).collect()
    assert len(got) == len(docs)
    assert all(base(x) == brute_base(docs[x.doc_id]) for x in got)
    assert not any(x.kept and x.base_failed for x in got)


def test_rejects_junk_and_keeps_clean_text(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op3_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("n_words >= 60").collect()
    good, bad = [x for x in got if x.quality == 1 and not x.base_failed], [x for x in got if x.quality == 0]
    assert sum(x.kept for x in good) >= 0.99 * len(good)
    assert sum(x.kept for x in bad) <= 0.2 * len(bad)


def test_distance(spark):
    rows = [([3, 0, 5], [1, 1, 8]), ([1, 0, 0], [0, 0, 1]), ([2, 2, 2], [5, 5, 5]), ([0, 0, 0], [1, 2, 3])]
    got = [x.d for x in spark.createDataFrame(rows, "p array<long>, q array<long>").select(r.distance("p", "q").alias("d")).collect()]

    def brute(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x) / 2
        return math.sqrt(max(0, half(p, q) + half(q, p)))

    assert got[:3] == pytest.approx([brute(*x) for x in rows[:3]]) and got[3] is None


def test_common_words_count_all_documents(make):
    rows = [(i, "alpha beta beta gamma gamma gamma longerword", "en") for i in range(4)] + [(9, "delta delta", "fr"), (10, "x1 y2 !", "fr")]
    assert r.common_words(make(rows), each=2) == ["beta", "delta", "gamma"]


def test_edge_rows_and_empty_table(edge, empty):
    got = {x.doc_id: base(x) for x in r.judge(edge).collect()}
    assert got == {d: brute_base(t) for d, t in EDGE}
    assert r.judge(edge).count() == len(EDGE)
    assert r.judge(empty).count() == 0


def test_null_languages_are_compared_with_the_whole_corpus(make):
    letters = "abcdefghijklmnopqrst"
    rows = [(i, " ".join(f"the {letters[i]}{letters[k % 20]}{letters[k // 20]}word" for k in range(99)), "en") for i in range(20)]
    got = r.judge(make([*rows, (50, "&&& %%% ### $$$ &&&&& %%%%% " * 3 + " ".join(f"&&&{k}%%%" for k in range(200)), None)])).collect()
    odd = next(x for x in got if x.doc_id == 50)
    assert odd.class_distance > r.FAR_CLASSES and not odd.kept


def brute_judge(rows):
    """{doc_id: (class_distance, word_distance, kept)} of (doc_id, text, lang) rows with distinct ids, by the rules as stated."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t, _ in rows}
    by_lang = {}
    for i, _, lang in rows:
        by_lang.setdefault(lang, Counter()).update(w for w in words[i] if len(w) <= r.SHORT)
    vocabulary = set()
    for counted in by_lang.values():
        letters = [(-n, w) for w, n in counted.items() if w.isalpha()]
        vocabulary |= {w for _, w in sorted(letters)[: r.VOCABULARY]}
    vocabulary = sorted(vocabulary)

    def classes(t):
        kinds = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \t\n\x0b\f\r",
                 lambda c: c in r._STOPS, lambda c: c in r._SYMBOLS, lambda c: c in r._MARKS]
        found = [sum(map(k, t)) for k in kinds]
        return [*found, len(t) - sum(found)]

    held = {}
    for i, t, lang in rows:
        common = [words[i].count(v) for v in vocabulary]
        held[i] = lang, classes(t or ""), [*common, len(words[i]) - sum(common)], len(words[i]), brute_base(t)[-1]

    def distance(p, q):
        if not sum(p) or not sum(q):
            return None
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x) / 2
        return math.sqrt(max(0, half(p, q) + half(q, p)))

    def judged(ids):
        refs = {}
        for lang in {held[i][0] for i in held} | {None}:
            own = [held[i] for i in ids if lang in (held[i][0], None)]
            refs[lang] = [[sum(h[k][j] for h in own) for j in range(len(own[0][k]))] for k in (1, 2)] if own else None
        out = {}
        for i, (lang, c, w, n, failed) in held.items():
            ref = refs.get(lang)
            dc = distance(c, ref[0]) if ref and sum(c) >= r.LEAST_CHARS else None
            dw = distance(w, ref[1]) if ref and n >= r.LEAST_WORDS else None
            far = dc is not None and (dc > r.FAR_CLASSES or dc > r.OFF_CLASSES and dw is not None and dw > r.OFF_WORDS)
            out[i] = dc, dw, not failed and not far
        return out

    first = judged([i for i in held if not held[i][4]])
    return judged([i for i in held if first[i][2]])


def test_references_distances_and_kept_against_brute_force(spark, make):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()
    rows = [(d.doc_id, d.text, d.lang) for d in docs]
    rows += [(10**6, None, None), (10**6 + 1, "&%$ " * 200, "en"), (10**6 + 2, docs[0].text, None), (10**6 + 3, "seul ici " * 6, "xx")]
    want = brute_judge(rows)
    got = {x.doc_id: x for x in r.judge(make(rows)).collect()}
    assert set(got) == set(want) and any(not k for *_, k in want.values())
    for i, (dc, dw, kept) in want.items():
        assert got[i].kept == kept, i
        for mine, theirs in ((got[i].class_distance, dc), (got[i].word_distance, dw)):
            assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 1e-9)
