import random
from collections import Counter

import numpy as np
import pytest

from latticework.llm import minhash_join as mj
from latticework.llm.components import components


def sets_of(text):
    w = (text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [sets_of(t) for _, t in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least.setdefault(find(i), []).append(k)
    lowest = {r: min([k for k in ks if k is not None], default=None) for r, ks in least.items()}
    return Counter((k, lowest[find(i)], links[i]) for i, (k, _) in enumerate(rows))


def corpus(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = " ".join(random.choices(vocabulary, k=60))
    rows = []
    for i in range(60):
        base = random.choices(vocabulary, k=random.randint(3, 150))
        rows.append(base)
        for _ in range(random.choice([0, 0, 1, 5])):
            other = list(base)
            for _ in range(random.randint(0, 4)):
                other[random.randrange(len(other))] = random.choice(vocabulary)
            rows.append(other)
    texts = [" ".join(r) for r in rows] + [passage + " " + " ".join(random.choices(vocabulary, k=90)) for _ in range(20)]
    texts += [None, "", "  \n", "one", "one", "two words", "w1\nw2 w3\tw4 w5", "w1 w2 w3 w4 w5", "x " * 6000, "x " * 7000]
    ids = random.sample(range(10_000), len(texts))
    return [*zip(ids, texts), (None, texts[0]), (None, "unlike all others here"), (ids[1], texts[1]), (ids[1], texts[1])]


@pytest.mark.parametrize("blocks", [None, 3])
def test_against_brute_force(spark, monkeypatch, blocks):
    if blocks:  # every bucket and component over several blocks
        for name in ("BUCKET_BLOCK", "DOCS_BLOCK"):
            monkeypatch.setattr(mj, name, blocks)
    rows = corpus(7 if blocks else 8)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_links", "1 AS sig", "'x' AS digest")
    out = mj.join(df, carry=["doc_id", "sig"]).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == brute(rows)
    groups = {(r.class_id, r.doc_id if r.class_id is None or not sets_of(dict(rows).get(r.doc_id)) else 0) for r in out if r.doc_id is not None}
    assert sum(r["first"] for r in out) >= len(groups)


def test_one_of_each_group_stays(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS class_id", "2 AS first")
    kept = mj.deduplicate(df)
    assert kept.columns == df.columns
    kept = [(r.doc_id, r.text) for r in kept.collect()]
    classes = {(c if sets_of(t) else object()) for (k, t), c in zip(rows, [next(c for (a, c, _), _ in brute(rows).items() if a == k) for k, _ in rows]) if k is not None}
    worded = [(k, t) for k, t in kept if sets_of(t)]
    assert max(Counter(brute([*worded])).values(), default=0) <= 1 and all(n == 0 for _, _, n in brute(worded))
    assert len(kept) - len(worded) == 3 and len(classes) >= len(worded) - 1


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mj.join(df).collect() == [] and mj.deduplicate(df).collect() == []


def test_pruning_is_safe_and_sharp():
    n, least = mj.least_matches()[-1]
    assert 0.62 < least / n < 0.72
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 16, (2000, mj.HASHES)).astype(np.uint16)
    same = rng.random((2000, mj.HASHES)) < 0.8
    t = np.where(same, s, s + np.uint16(1))
    both = np.concatenate([s, t])
    i = np.arange(2000)
    assert len(mj.likely(both, i, i + 2000)) >= 1999
    assert len(mj.likely(both, i, np.roll(i, 1) + 2000)) == 0


def test_components(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(random.randint(0, 60), random.randint(0, 60)) for _ in range(40)] + [(5, 5), (900, 901), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


@pytest.mark.parametrize("shingles", [60, 25])
def test_links_count_once_where_block_pairs_hold_one_block(spark, monkeypatch, shingles):
    monkeypatch.setattr(mj, "SHINGLES_BLOCK", shingles)  # two or more blocks for each two copies
    rows = []
    for i in range(16):
        base = [f"w{i}x{k}" for k in range(60)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join([*base, "end"]))]
    out = mj.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == Counter((k, k // 2 * 2, 1) for k, _ in rows)


def test_whole_documents_table_against_brute_force(spark):
    """Recall of exact pairs at 0.8 over the whole table: all of them."""
    from latticework.llm.queries import op10_minhash_join

    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = brute_by_postings(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in op10_minhash_join(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def brute_by_postings(rows):
    sets = [sets_of(t) for _, t in rows]
    postings, shared = {}, Counter()
    for i, s in enumerate(sets):
        for x in s:
            for j in postings.setdefault(x, []):
                shared[j, i] += 1
            postings[x].append(i)
    label, links = list(range(len(rows))), Counter()
    pairs = [(i, j) for (i, j), c in shared.items() if 5 * c >= 4 * (len(sets[i]) + len(sets[j]) - c)]
    for i, j in pairs:
        links[i] += 1
        links[j] += 1
        old, new = max(label[i], label[j]), min(label[i], label[j])
        label = [new if x == old else x for x in label]
    least = {}
    for i, (k, _) in enumerate(rows):
        least[label[i]] = min(least.get(label[i], k), k)
    return {k: (least[label[i]], links[i]) for i, (k, _) in enumerate(rows)}


def test_one_hot_row_and_a_hub(spark):
    base = [f"v{i}" for i in range(40)]
    near = spark.createDataFrame([(1, " ".join(base)), (2, " ".join([*base, "end"]))], "doc_id long, text string")
    hot = spark.range(20_000).selectExpr("1L AS doc_id", f"'{' '.join(base)}' AS text")
    rows = mj.join(near.unionByName(hot)).groupBy("doc_id", "class_id", "n_links", "first").count().collect()
    got = sorted((r.doc_id, r.class_id, r.n_links, r["count"]) for r in rows if not r["first"])
    assert got == [(1, 1, 20_001, 20_000), (2, 1, 20_001, 1)]
    star = spark.range(1, 50_001).selectExpr("id * 3 AS a", "CASE WHEN id % 2 = 0 THEN 25000 * 3L ELSE id * 3 - 3 END AS b")
    found = components(star).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in found} == {0: 2, 6: 49_999}
