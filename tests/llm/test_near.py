"""Near-duplicates of documents and of vectors, against brute force."""

import random

import numpy as np
import pytest

from leafwright.llm import components, egojoin, hyperminhash


def brute_components(n, linked, names):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    least = {}
    for k in range(n):
        least[root(k)] = min(least.get(root(k), names[k]), names[k])
    return [least[root(k)] for k in range(n)]


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (7, 8), (7, 8)]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(7)
    got = {r["node"]: r["root"] for r in components.components(frame).collect()}
    nodes = sorted({x for e in edges for x in e})
    at = {x: k for k, x in enumerate(nodes)}
    expected = brute_components(len(nodes), [(at[a], at[b]) for a, b in edges], nodes)
    assert all(got.get(x, x) == e for x, e in zip(nodes, expected)) and all(r < n for n, r in got.items())
    assert components.components(frame.limit(0)).count() == 0


def shingles(s):
    words = (s or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_copies(rnd, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rnd.randrange(len(words))] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """A large group of near copies at every distance, a common line, exact copies, small groups and short texts."""
    rnd = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    texts = [near_copies(rnd, base, rnd.randrange(0, 7)) for _ in range(150)]
    line = " ".join(rnd.choice(vocabulary) for _ in range(12))
    texts += [line + "\n" + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    texts += ["Same TEXT here again and again, five words"] * 30 + ["same text here again and again, five words"] * 3
    for _ in range(15):
        other = [rnd.choice(vocabulary) for _ in range(rnd.randrange(6, 90))]
        texts += [near_copies(rnd, other, k) for k in (0, 0, 1, 2)]
    texts += ["one two", "one  two", "ONE\ttwo", "one two three", "a", "", " ", None]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("percent", "frequent", "block"), [(85, 32, 1024), (80, 4, 16)])
def test_documents_are_brute_force(spark, percent, frequent, block):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    names = [k * 3 + 1 for k in range(len(texts))]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    expected = dict(zip(names, brute_components(len(texts), linked, names)))
    frame = spark.createDataFrame(list(zip(names, texts)), "doc_id long, text string").repartition(5)
    rows = hyperminhash.near_duplicates(frame, percent=percent, frequent=frequent, block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {n: len(s) for n, s in zip(names, sets)}
    assert all(r["kept"] == r["first"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (800, 100, 120))
        a, b = np.unique(np.concatenate([both, one])), np.unique(np.concatenate([both, two]))
        sa, sb = (hyperminhash.sketch(x, 240)[None] for x in (a, b))
        errors.append(hyperminhash.estimate(sa, sb, np.array([len(a)]), np.array([len(b)]))[0] - 800 / 1020)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_odd_documents(odd):
    rows = hyperminhash.near_duplicates(odd).collect()
    assert len(rows) == 9 and set(rows[0].asDict()) == {*odd.columns, "n_shingles", "first"}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in by[1]] == [1, 1] and sorted(r["first"] for r in by[1]) == [False, True]
    assert all(by[k][0]["n_shingles"] == 0 and by[k][0]["component_id"] == k and by[k][0]["kept"] for k in (2, 3, 4))
    assert by[None][0]["component_id"] is None and by[None][0]["kept"] and by[7][0]["n_shingles"] == 1
    assert by[7][0]["text"] == "word " * 60_000
    assert hyperminhash.near_duplicates(odd.limit(0)).count() == 0
    assert "text" not in hyperminhash.near_duplicates(odd, with_text=False).columns


@pytest.mark.parametrize("block", [4096, 16])
def test_vectors_are_brute_force(spark, block):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    x = np.concatenate([centres[rng.integers(0, 20, 150)] + rng.normal(0, 0.25, (150, 16)), rng.normal(size=(50, 16)), np.repeat(centres[:1], 40, axis=0)]).astype(np.float32)
    labels = rng.integers(0, 3, len(x)).tolist()
    labels[3] = None
    rows = [(k * 2 + 5, v.tolist(), label) for k, (v, label) in enumerate(zip(x, labels))]
    rows += [(1, None, 1), (2, [0.0] * 16, 1), (3, [float("nan")] * 16, 1), (4, [None] * 16, 1), (6, [], 1), (8, [float("inf")] * 16, 1), (1001, [1.0, 0.0], 1), (1002, [1.0, 0.1], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    y = x.astype(float)
    cosine = y @ y.T / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    linked = [(a, b) for a in range(len(x)) for b in range(a) if labels[a] is not None and labels[a] == labels[b] and cosine[a, b] >= 0.93]
    names = [r[0] for r in rows[: len(x)]]
    degree = np.zeros(len(x), int)
    for a, b in linked:
        degree[a] += 1
        degree[b] += 1
    expected = dict(zip(names, zip(degree.tolist(), brute_components(len(x), linked, names))))
    expected |= {k: (0, k) for k in (1, 2, 3, 4, 6, 8)} | {1001: (1, 1001), 1002: (1, 1001)}
    got = egojoin.epsilon_components(frame, block=block)
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got.collect()} == expected
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.collect())


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], 1, 9), (1, [1.0, 0.0], 1, 9), (None, [1.0, 0.0], 1, 9), (2, [2e300, 0.0], 1, 9), (3, [-1e-300, 0.0], 1, 9)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n_links int")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in egojoin.epsilon_components(frame).collect()), key=str)
    assert got == [(0, 3, 1), (1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]
    assert egojoin.epsilon_components(frame.limit(0)).count() == 0


def test_skipping_loses_nothing():
    rng = np.random.default_rng(4)
    p = np.sort(rng.normal(size=(700, 3)), axis=0)
    far2 = 0.02
    whole = egojoin._Interval(p, 0, len(p))
    seen = set()
    for x, y in egojoin._leaves(whole, whole, far2):
        for a in range(x.start, x.end):
            for b in range(y.start, y.end):
                seen.add((min(a, b), max(a, b)))
    d2 = ((p[:, None] - p[None]) ** 2).sum(axis=2)
    near = {(int(a), int(b)) for a, b in zip(*np.nonzero(d2 <= far2)) if a < b}
    assert near <= seen and len(seen) < 700 * 700 / 2


def test_columns_named_like_the_working_ones_stay(spark):
    rows = [(1, "a b c d e f g", "x", 5, "r", "p", "t"), (2, "a b c d e f g", "y", 6, "s", "q", "u"), (3, None, "z", 7, "t", "o", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _packed string, _rid int, _set string, comp string, _text string")
    got = hyperminhash.near_duplicates(docs)
    assert got.columns == [*docs.columns, "n_shingles", "component_id", "kept", "first"]
    assert sorted((r["doc_id"], r["text"], r["_packed"], r["_rid"], r["_set"], r["comp"], r["_text"], r["component_id"]) for r in got.collect()) == [(1, "a b c d e f g", "x", 5, "r", "p", "t", 1), (2, "a b c d e f g", "y", 6, "s", "q", "u", 1), (3, None, "z", 7, "t", "o", "v", 3)]
    assert "text" not in hyperminhash.near_duplicates(docs, with_text=False).columns
