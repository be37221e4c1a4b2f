"""Spelling variants against brute force: edited runs, near words, forms, roots, edge rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

from deskpark.llm import spelling as s
from deskpark.llm.queries import queries
from llm.cases import EDGE, SF_SMALL

LOWER = str.maketrans(s._UPPER, s._LOWER)


def brute_words(rows):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    keyed, near = defaultdict(set), defaultdict(set)
    for w in words:  # candidates: equal after deleting one character at one of two places
        for k in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            keyed[k].add(w)
    for group in keyed.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def rows_of(df):
    found = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    want = brute(brute_words(rows))
    assert any(f for _, f, *_ in want) and rows_of(queries()["op12_spelling_variants"](spark, SF_SMALL)) == want


def test_dense_neighbourhoods(spark, make):
    """Few letters, so that most words have near words of every kind; long ways to the root; ties."""
    rng = random.Random(5)
    rows = []
    for i in range(300):
        word = "".join(rng.choice("aaabé") for _ in range(rng.randint(5, 8)))
        rows.append((i, " ".join([word] * rng.choice((1, 2, 3, 3, 4, 6, 9, 20, 50)))))
    want = brute(brute_words(rows))
    assert max(n for *_, n, _ in want) > 5 and any(f and f != r for _, f, r, *_ in want)
    assert rows_of(s.variants(make(rows))) == want


def test_way_to_the_root(make):
    """Every word's form is the next, eight steps in all."""
    chain = ["aaaaa" + "b" * k for k in range(9)]
    rows = [(k, f"{w} " * (3 * 2 ** k)) for k, w in enumerate(chain)]
    got = {r.word: r for r in s.variants(make(rows)).collect()}
    held = [w for w in chain if w in got]
    assert rows_of(s.variants(make(rows))) == brute(brute_words(rows)) and len({got[w].root for w in held}) == 1


def test_hot_word_and_repeated_characters(make):
    rows = [(i, "hellooo helloo hello hallo " + "hello " * 50) for i in range(200)] + [(1000 + i, "ÉCOLE école Ecole naïve×naïve") for i in range(9)]
    got = rows_of(s.variants(make(rows)))
    assert got == brute(brute_words(rows)) and {w: r for w, _, r, *_ in got}["helloo"] == "hello"


def test_edge_rows_and_empty_table(make, edge, empty):
    rows = [*EDGE, (None, "wörter wörter wörter worter"), (20, None)]
    assert rows_of(s.variants(make(rows))) == brute(brute_words(rows))
    assert rows_of(s.variants(edge)) == brute(brute_words(EDGE)) and s.variants(empty).collect() == []
