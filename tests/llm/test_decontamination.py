"""Operator 13 against a brute-force search of every window at every word, and against its SQL."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from media_forecast.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    """Sorted rows of the contract, from comparing every window with every place."""
    out = []
    for doc_id, text in docs:
        w, hit, named = words(text), set(), set()
        for item, t in items:
            q = words(t)
            for k in range(max(1, len(q) - window + 1) if q else 0):
                x = q[k: k + window]
                for s in range(len(w) - len(x) + 1):
                    if w[s: s + len(x)] == x:
                        hit.update(range(s, s + len(x)))
                        named.add(item)
        named = sorted(str(x) for x in named if x is not None)
        out.append((doc_id, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def brute_near(w, q, window, within):
    found = set()
    for k in range(max(1, len(q) - window + 1) if q else 0):
        want = set(q[k: k + window])
        covers = [(s, e) for s in range(len(w)) for e in range(s + 1, min(len(w), s + within) + 1) if want <= set(w[s:e])]
        found |= {(s, e) for s, e in covers if not any((s2, e2) != (s, e) and s <= s2 and e2 <= e for s2, e2 in covers)}
    return found


def spread(rows, r):
    filler = lambda: " ".join(r.choice("aa bb cc dd Ee ff é9".split()) for _ in range(r.randint(0, 30)))
    return [(k, filler()) for k in range(rows)]


def test_equal_to_brute_force(spark):
    r = random.Random(5)
    edge = [(900, None), (901, ""), (902, " ,.; \x00"), (903, "aa"), (903, "aa"), (None, "AA-bb_cc dd"), (904, "aa bb " * 3000)]
    docs = spread(60, r) + edge
    items = spread(12, r) + [(50, None), (51, "!!"), (52, "aa"), (52, "aa"), (None, "bb cc dd"), (53, "ff é9 ff é9 ff aa bb cc dd")]
    ddf = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, block string").repartition(3)
    idf = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, terms string")
    for window in (2, 3, 10):
        assert sorted(map(tuple, D.digests(ddf, idf, window).collect()), key=str) == brute(docs, items, window)
    want = brute(docs, items, 3)
    # Small index blocks and several passes over the items give the same.
    found = D.spans_of(D.build_index(ddf, block_bytes=200), idf, 3, item_bytes=40)
    got = {(x.doc_id, x.n_words, tuple(sorted({s.item_id for s in x.spans if s.item_id is not None}))) for x in found.collect()}
    names = {tuple(sorted({i for i, t in items if i is not None and brute([d], [(i, t)], 3)[0][5]})) + (d[0], len(words(d[1]))) for d in docs}
    assert {(*g[2], g[0], g[1]) for g in got} == names
    covered = found.select("doc_id", "n_words", D.covered(found["spans"]).alias("n_hit")).collect()
    assert sorted((x.doc_id, x.n_words, x.n_hit) for x in covered if x.doc_id is not None) == sorted(w[:3] for w in want if w[0] is not None)


def test_spans_and_proximity(spark):
    r = random.Random(8)
    docs = spread(25, r)
    item = "aa bb cc dd"
    ddf = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    idf = spark.createDataFrame([(7, item)], "item_id long, text string")
    for row in D.spans_of(D.build_index(ddf, 150), idf, window=3, within=6).collect():
        w = words(docs[row.doc_id][1])
        assert {(x.start, x.end) for x in row.near} == brute_near(w, words(item), 3, 6)
        assert all(x.item_id == 7 and " ".join(w[x.start: x.end]) in item for x in row.spans)


def test_empty_tables(spark):
    none_d = spark.createDataFrame([], "doc_id long, text string")
    none_i = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "aa bb")], "doc_id long, text string")
    assert D.digests(none_d, none_i).count() == 0
    assert [tuple(x) for x in D.digests(some, none_i).collect()] == brute([(1, "aa bb")], [], 10)


@pytest.mark.parametrize("n", [1, 9, 10, 11, 40])
def test_long_items_keep_their_windows(spark, n):
    text = " ".join(f"w{k}" for k in range(n))
    pieces = list(D.item_pieces(spark.createDataFrame([(1, text)], "item_id long, text string"), 10, 50))
    got = set().union(*(D.Windows([p], 10).owners and {tuple(p[1][k: k + 10]) for k in range(max(1, len(p[1]) - 9))} for p in pieces))
    w = text.encode().split()
    assert got == {tuple(w[k: k + 10]) for k in range(max(1, n - 9))}
