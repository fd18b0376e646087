"""The prefix trie, whole-number clustering and repeated passages, against brute force."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from leafwright.llm import anchors, lloyd, prefixtrie

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(strings):
    """Nodes of {conv_id: ((role, text), ...)}."""
    members = {}
    for c, s in strings.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    below = lambda p: [q for q in members if q[: len(p)] == p]
    out = []
    for p, who in members.items():
        under = below(p)
        leaves = [q for q in under if not any(len(r) == len(q) + 1 and r[:-1] == q for r in members)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(who) if strings[c] == p)
        parent = min(members[p[:-1]]) if p else None
        out.append((min(who), len(p), parent, len(who), sum(1 for q in members if q and q[:-1] == p), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(frame):
    return sorted((tuple(r[c] for c in NODE) for r in frame.collect()), key=repr)


def rows_of(strings):
    return [(c, t, r, x) for c, s in strings.items() for t, (r, x) in enumerate(s)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("blocks", [1, 3, 11])
def test_trie(spark, blocks):
    rnd = random.Random(blocks)
    turn = lambda: (rnd.choice("ua"), rnd.choice(["", "x", "yé", "long text"]))
    strings = {}
    for c in range(120):
        s = tuple(turn() for _ in range(rnd.choice([1, 1, 2, 3, 4, 6])))
        strings[c * 7 - 50] = rnd.choice(list(strings.values())) + (s if rnd.random() < 0.4 else ()) if strings and rnd.random() < 0.6 else s
    strings |= {10_000 + k: (("u", "common"), ("a", "copy")) for k in range(60)}
    strings[5] = tuple(("u", "deep") for _ in range(150))
    frame = spark.createDataFrame(rows_of(strings), SCHEMA).repartition(5)
    assert found(prefixtrie.prefix_trie(prefixtrie.sequences(frame), blocks=blocks)) == brute_trie(strings)


@pytest.mark.parametrize("strings", [{1: (("u", "a"),)}, {1: (("u", "a"),), 2: (("u", "a"),)}, {k: (("u", "a"),) * 3 for k in range(40)}, {1: (("u", "a"), ("u", "b")), 2: (("u", "a"),), 3: (("x", "a"),)}])
@pytest.mark.parametrize("blocks", [1, 4])
def test_small_tries(spark, strings, blocks):
    assert found(prefixtrie.prefix_trie(prefixtrie.sequences(spark.createDataFrame(rows_of(strings), SCHEMA)), blocks=blocks)) == brute_trie(strings)


def model_rebuilt(own):
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: tuple(own.get(c - c % 5, ())[: h[c]]) + tuple(own[c][h[c] :]) for c in own}


def test_rebuilt_conversations(spark):
    rnd = random.Random(4)
    own = {c: tuple((rnd.choice("ua"), rnd.choice("pqr")) for _ in range(rnd.randrange(1, 12))) for c in range(90) if c not in (15, 40)}
    strings = model_rebuilt(own)
    assert any(not s for s in strings.values())  # a conversation without turns: its first one is absent
    rows = prefixtrie.rebuilt(prefixtrie.sequences(spark.createDataFrame(rows_of(own), SCHEMA)))
    assert found(prefixtrie.prefix_trie(rows, blocks=3)) == brute_trie(strings)
    none = {c: s for c, s in own.items() if c % 5 and len(s) <= zlib.crc32(str(c).encode()) % 9}
    assert none  # all of these are empty, so the root is a leaf
    assert found(prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.sequences(spark.createDataFrame(rows_of(none), SCHEMA))), blocks=2)) == brute_trie(dict.fromkeys(none, ()))


def test_trie_of_odd_rows(spark):
    """Nulls count as empty and come first, ties go by the hash, repeated rows are turns, rows without an id are ignored."""
    rows = [(1, None, None, "b"), (1, 0, "u", None), (2, None, "", "b"), (2, 0, "u", ""), (None, 1, "u", "x"), (3, 1, "u", "one"), (3, 1, "u", "one"), (4, 2, "a", "p"), (4, 2, "a", "q"), (5, 2, "a", "q"), (5, 2, "a", "p")]
    frame = spark.createDataFrame([(*r, 7, "k") for r in rows], SCHEMA + ", depth int, keys string")
    nodes = found(prefixtrie.prefix_trie(prefixtrie.sequences(frame), blocks=2))
    key = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).digest()[:16]
    tied = tuple(sorted([("a", "p"), ("a", "q")], key=lambda x: key(*x)))
    assert nodes == brute_trie({1: (("", "b"), ("u", "")), 2: (("", "b"), ("u", "")), 3: (("u", "one"),) * 2, 4: tied, 5: tied})
    assert found(prefixtrie.prefix_trie(prefixtrie.rebuilt(prefixtrie.sequences(frame.limit(0))))) == []


def brute_clusters(rows, size, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in order[:k]]
    if not centroids:
        return []
    apart = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    for n in range(rounds + 1):
        near = [min(range(len(centroids)), key=lambda c: (apart(q, centroids[c]), c)) for _, q in kept]
        if n < rounds:
            for c in set(near):
                mine = [q for (_, q), x in zip(kept, near) if x == c]
                centroids[c] = [sum(col) // len(mine) for col in zip(*mine)]
    d = [apart(q, centroids[c]) for (_, q), c in zip(kept, near)]
    inertia = {c: sum(x for x, y in zip(d, near) if y == c) for c in set(near)}
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest() for c in set(near)}
    return sorted(((i, c, x, inertia[c], sum(d), digest[c]) for (i, _), c, x in zip(kept, near, d)), key=repr)


CLUSTER = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def clusters(frame, **options):
    return sorted((tuple(r[c] for c in CLUSTER) for r in lloyd.cluster_vectors(frame, **options).collect()), key=repr)


def test_clusters(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.choice([-0.5, 0.01, 0.3, 0.02]) + rnd.gauss(0, 0.02) for _ in range(4)]) for k in range(150)]
    rows += [(k, [0.25, -0.25, 0.5, 0.0]) for k in range(200, 300)]  # copies: one vector, counted a hundred times
    rows += [(3, rows[3][1]), (4, rows[9][1]), (None, [0.1] * 4), (400, None), (401, [0.1] * 3), (402, [0.1, None, 0.1, 0.1]), (403, [0.1, math.nan, 0.1, 0.1]), (404, [math.inf, 0.1, 0.1, 0.1]), (405, [])]
    frame = spark.createDataFrame([(*r, 1, 2, "q") for r in rows], "vec_id long, embedding array<float>, cluster int, w long, q string").repartition(4)
    single = [(r["vec_id"], r["embedding"]) for r in frame.select("vec_id", "embedding").collect()]
    assert clusters(frame, size=4) == brute_clusters(single, 4)
    few = [r for r in single if r[0] in (1, 2, 203, 204)]
    small = spark.createDataFrame(few, "vec_id long, embedding array<float>")
    assert clusters(small, size=4) == brute_clusters(few, 4)
    assert clusters(frame.limit(0), size=4) == [] and clusters(frame.where("vec_id >= 400"), size=4) == []


def test_exact_sums_and_ties():
    import numpy as np

    q = np.array([[0, 0], [2, 0], [1, 0]])
    best, distance = lloyd.nearest(q, np.array([[2, 0], [0, 0], [2, 0]]))
    assert best.tolist() == [1, 0, 0] and distance.tolist() == [0, 0, 1]
    big = np.array([[lloyd.LARGEST - 1] * 64], np.int64)
    assert lloyd.nearest(big, -big)[1].tolist() == [64 * (2 * (lloyd.LARGEST - 1)) ** 2]


def brute_repeats(texts, window):
    words = [(t or "").encode().split() for t in texts]
    starts = {}
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            starts.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = {(k, i + j) for where in starts.values() if len(where) > 1 for k, i in where for j in range(window)}
    out = []
    for k, w in enumerate(words):
        kept = [x for i, x in enumerate(w) if (k, i) not in gone]
        out.append((len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return out


@pytest.mark.parametrize("period", [1, 3, 7, 13, 21, 31])
def test_covers(period):
    cover = anchors.difference_cover(period)
    assert {(a - b) % period for a in cover for b in cover} == set(range(period)) and len(cover) * (len(cover) - 1) + 1 == period


@pytest.mark.parametrize("window", [1, 2, 5, 12, 35, 60])
def test_repeats(spark, window):
    rnd = random.Random(window)
    word = lambda: f"w{rnd.randrange(30 if window > 5 else 4000)}"
    passage = [word() for _ in range(3 * window + 5)]
    texts = []
    for _ in range(80):
        own = [word() for _ in range(rnd.randrange(0, 4 * window))]
        if rnd.random() < 0.6:
            a = rnd.randrange(len(passage))
            at = rnd.randrange(len(own) + 1)
            own[at:at] = passage[a : a + rnd.randrange(1, 2 * window + 3)]
        texts.append(rnd.choice([" ", "\n", " \t"]).join(own))
    texts += [texts[0]] * 40 + ["x " * (2 * window), "a b " * window, None, "", " \n", "é\x00ß " * window, "Only here. " * 2, "only HERE. " * 2]
    frame = spark.createDataFrame([(k, t, 5, "z", 1) for k, t in enumerate(texts)], "doc_id long, text string, n_words int, _starts string, rid long").repartition(6)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in anchors.without_repeats(frame, window=window, partitions=5).collect()}
    assert [got[k] for k in range(len(texts))] == brute_repeats(texts, window)


def test_repeats_of_odd_rows(spark, odd):
    """Null ids, repeated rows and columns of the new names."""
    out = anchors.without_repeats(odd.withColumn("kept_text", F.lit("old")).withColumn("_rid", F.lit(1)), window=5)
    rows = out.collect()
    assert out.columns == ["doc_id", "lang", "n_chars", "score", "lang_pred", "component_id", "kept", "n_tokens", "label", "_rid", "n_words", "n_removed", "kept_text"]
    texts = [r["text"] for r in odd.collect()]
    assert sorted((r["n_words"], r["n_removed"], r["kept_text"]) for r in rows) == sorted(brute_repeats(texts, 5))
    assert anchors.without_repeats(odd.limit(0)).count() == 0
    digests = {r["doc_id"]: r["kept_sha256"] for r in anchors.without_repeats(odd, digest=True).collect()}
    assert digests[3] == hashlib.sha256(b"").hexdigest()
