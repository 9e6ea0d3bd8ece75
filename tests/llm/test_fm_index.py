import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from latticework.llm import fm_index as fm

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(docs, bench, window=13):
    phrases = {}
    for item, text in bench:
        w = PATTERN.findall(lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for key, text in docs:
        w = PATTERN.findall(lower(text))
        hit, items = set(), set()
        for i in range(len(w)):
            for n in {len(p) for p in phrases}:
                if (p := tuple(w[i : i + n])) in phrases and len(p) == n:
                    hit.update(range(i, i + n))
                    items |= phrases[p]
        ids = sorted(str(x) for x in items if x is not None)
        out.append((key, len(w), len(hit), len(ids), fm.sha_of(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=120), st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=5), min_size=1, max_size=6))
def test_search_and_locate(values, phrases):
    index = fm.FMIndex(np.array(values, np.int64), sample=4)
    table = np.zeros((len(phrases), 5), np.int64)
    for i, p in enumerate(phrases):
        table[i, : len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        want = [i for i in range(len(values) - len(p) + 1) if values[i : i + len(p)] == p]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_against_brute_force(spark):
    random.seed(5)
    word = lambda: random.choice(["the", "of", "É", "x1", "Zebra", "qu", "ok"])
    bench = [(i, " ".join(word() for _ in range(random.choice([3, 9, 13, 14, 30])))) for i in range(12)] + [(50, None), (51, "--"), (None, "null id item words"), (9, "the of")]
    docs = []
    for i in range(120):
        text = [word() for _ in range(random.randint(0, 60))]
        if i % 3 == 0:
            passage = (random.choice(bench[:12])[1]).split()
            text[5:5] = passage[: random.choice([12, 13, len(passage)])]
        docs.append((i, " ".join(text).upper() if i % 7 == 0 else ", ".join(text)))
    docs += [(200, None), (201, ""), (202, docs[0][1]), (202, docs[0][1]), (None, docs[3][1]), (203, ("zz " * 5000) + bench[4][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS hits", "2 AS item_id")
    b = spark.createDataFrame(bench, "item_id long, text string")
    for block in (2_000_000, 40):
        found = fm.find(d, b, block_words=block)
        got = [tuple(r) for r in fm.digests(found, hits=found.columns[-1]).collect()]
        assert sorted(got, key=str) == sorted(brute(docs, bench), key=str)
    assert {r.n_hit for r in fm.digests(fm.find(d, b.limit(0), carry=["doc_id"]), hits="_hits").collect()} == {0}
    assert fm.find(d.limit(0), b).collect() == []


def test_spans_are_cut():
    assert fm.cut_spans("A b, c d. E", [(1, 3)]) == "A  d. E"
    assert fm.cut_spans("é b", [(0, 2)]) == "" and fm.cut_spans(None, []) is None


def test_remove_spans(spark):
    d = spark.createDataFrame([(1, "one two three FOUR five"), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "two three four")], "item_id long, text string")
    out = fm.remove_spans(fm.find(d, b, window=3)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(1, "one  five"), (2, None)]
