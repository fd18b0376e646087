"""BPE and packing against the tokenizers library."""

import hashlib
import random
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from leafwright.llm import bpe, packing
from leafwright.llm.common import vocabulary_path

LIBRARY = Tokenizer.from_file(vocabulary_path())
OWN = bpe.WordBpe(vocabulary_path())


@lru_cache(maxsize=10_000)
def ids(s):
    return LIBRARY.encode(s or "", add_special_tokens=False).ids


CASES = [
    "", " ", "a", "don't we'll I'm it's's 're", "ΑΣ ΣΑΣ. σς", "İstanbul ẞ ß", "a\x1cb\x1db\x85c\xa0d e　f", "<|endoftext|>x<|startoftext|> <|endoftext|", "日本語 テスト 한국어 번역",
    "é Å", "x" * 3000, "ab" * 5000, "123 4567 ½ ² Ⅷ", "🎉🎉 👨‍👩‍👧", "\x00\x01 \x7f", "naïve café ﬁne ǅ", "﻿a​b", "a!? b... c—, d.",
]


def test_encoding_and_decoding_equal_the_library():
    for s, mine in zip(CASES, OWN.encode_all(CASES, piece=2000)):
        assert mine.tolist() == ids(s), s
        assert OWN.decode_bytes(mine).decode() == LIBRARY.decode(ids(s), skip_special_tokens=False), s


def test_random_words():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("etaoinshrdlu'éß1.") for _ in range(rnd.randrange(1, 50))) for _ in range(3000)]
    for w, mine in zip(words, OWN.encode_all(words)):
        assert mine.tolist() == ids(w), w


def test_compatible_is_what_the_merges_leave():
    rnd = random.Random(5)
    inner = [i for i, s in OWN.spelling.items() if len(s) <= 4 and ord(s[-1]) < 256]
    every = list(OWN.spelling)
    for _ in range(3000):
        a, b = rnd.choice(inner), rnd.choice(every)
        merged = OWN._merge([OWN.symbol[ord(c)] for c in OWN.spelling[a] + OWN.spelling[b]])
        assert OWN.compatible(a, b) == (merged == [a, b])


def test_digests(odd):
    rows = bpe.token_digests(odd).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == 9
    for r in rows:
        expected = ids(texts[r["doc_id"]])
        assert r["n_tokens"] == len(expected)
        assert r["ids_sha256"] == hashlib.sha256(np.array(expected, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(expected, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.token_digests(odd.limit(0)).count() == 0
    assert bpe.encode_column(odd, decode=True).where("doc_id = 1").first()["decoded"] == LIBRARY.decode(ids(texts[1]), skip_special_tokens=False)


def check_pieces(rows, texts, length):
    """Every id in exactly one piece; sequences gapless, full, or a power of two long."""
    held, sequences = {}, {}
    for r in rows:
        whole = ids(texts[r["doc_id"]]) + [1]
        assert r["doc_tokens"] == len(whole)
        part = whole[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        held.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= length and (at == length or at & (at - 1) == 0)
    return held


def test_packing(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for size in (4_000_000, 5000):
        held = check_pieces(packing.pack(docs, shard_tokens=size).collect(), texts, 2048)
        assert set(held) == set(texts)
        for pieces in held.values():
            at = 0
            for start, n in sorted(pieces):
                assert start == at
                at += n


def test_packing_odd_rows(odd):
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    rows = packing.pack(odd, length=64, with_ids=True).collect()
    check_pieces(rows, texts, 64)
    total = sum(len(ids(r["text"])) + 1 for r in odd.collect())
    assert sum(r["length"] for r in rows) == total == sum(len(r["ids"]) // 4 for r in rows)
    assert packing.pack(odd.limit(0)).count() == 0


def test_neighbours_are_lexical():
    """A window's documents share more rare terms than chance: seeds take the documents of their own topic first."""
    rng = np.random.default_rng(0)
    docs = [np.concatenate([rng.integers(100 * (k % 4) + 10, 100 * (k % 4) + 90, 30), [1]]).astype("<u2") for k in range(200)]
    df = np.zeros(500)
    for d in docs:
        df[np.unique(d)] += 1
    index = packing._Index(docs, np.log1p((200 - df + 0.5) / (df + 0.5)), 31.0, 1.2, 0.75, 24)
    near = index.neighbours(0, np.arange(200) != 0, 20)
    assert (near % 4 == 0).mean() > 0.9


def test_recent_is_bounded():
    from leafwright.llm.common import Recent

    cache = Recent(4)
    for k in range(10):
        cache.keep(k, str(k))
        assert cache.find(0 if k < 2 else k) is not None and len(cache) + len(cache.old) <= 4
    assert cache.find(0) is None


def test_lockstep_equals_one_by_one(monkeypatch):
    """Many words at once, with a table so small that pairs push each other about."""
    monkeypatch.setattr(bpe, "_PAIR_BITS", 3)
    small = bpe.WordBpe(vocabulary_path())
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäößéèçñаиодеελ漢字ค"
    words = ["".join(rnd.choice(letters[: rnd.choice([3, 26, 34, 43])]) for _ in range(rnd.randint(1, 30))) for _ in range(3000)]
    words += ["a" * n for n in (1, 2, 63, 64, 65, 500)] + ["x" * 70 + "!", "don't", "a.b.c", "7up", "ab\u0301c", "ǅ", "ʰʷ"]
    texts = [" ".join(words[k::7]) for k in range(7)] + words[-20:] + ["", None, " \t "]
    assert [x.tolist() for x in small.encode_all(texts, piece=5000)] == [ids(t) for t in texts]
    bounds = np.cumsum([0] + [len(w.encode()) for w in words])
    found, n = small.encode_words(np.frombuffer("".join(words).encode(), np.uint8), bounds)
    assert np.split(found, np.cumsum(n)[:-1])[17].tolist() == small.encode_word(words[17].encode())
    assert found.tolist() == [i for w in words for i in small.encode_word(w.encode())]


def test_related_documents_meet_in_a_shard(spark):
    """Documents of 16 topics, dealt over partitions in turn: windows of small shards hold few topics each."""
    rnd = random.Random(3)
    topics = [["".join(rnd.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(12)] for _ in range(16)]
    rows = [(k, " ".join(rnd.choice(topics[k % 16]) for _ in range(30))) for k in range(800)]
    topic = lambda pieces: {(r["sequence_id"], r["doc_id"] % 16) for r in pieces}
    found = []
    for parts in (3, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        pieces = packing.pack(docs, length=512, shard_tokens=12_000).collect()
        assert {r["doc_id"] for r in pieces} == set(range(800))
        assert len(topic(pieces)) < 2.5 * len({r["sequence_id"] for r in pieces})
        found.append({frozenset((r["doc_id"], r["start"]) for r in pieces if r["sequence_id"] == s) for s in {r["sequence_id"] for r in pieces}})
    assert found[0] == found[1]  # whatever the partitions


def test_neighbours_by_all_terms_are_brute_force():
    """Seeds of more than 24 distinct terms: scores are sums over all of them."""
    rng = np.random.default_rng(2)
    docs = [rng.zipf(1.3, 150).clip(2, 400).astype("<u2") for _ in range(60)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=401)
    idf = np.log1p((60 - df + 0.5) / (df + 0.5))
    index = packing._Index(docs, idf, 150.0, 1.2, 0.75)
    for seed in range(60):
        score = np.array([sum((n := (d == t).sum()) * 2.2 / (n + 1.2) * idf[t] for t in np.unique(docs[seed])) for d in docs])
        near = index.neighbours(seed, np.arange(60) != seed, 10)
        expected = np.sort(np.delete(score, seed))[::-1][:10]
        assert np.allclose(score[near], expected, rtol=1e-4)
    assert packing.pack.__defaults__[4] is None


def test_neighbours_over_all_shards_are_brute_force(spark, docs):
    """Whatever the number of shards, the ten best are those of a plain search over all documents."""
    rows = [(r["doc_id"], (r["text"] or "")[:600]) for r in docs.where("doc_id < 120").collect()]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (None, "no id at all"), (220, None), (220, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = [(d, np.array(ids(t) + [1])) for d, t in rows]
    df = np.bincount(np.concatenate([np.unique(x) for _, x in held]))
    idf = np.log1p((len(held) - df + 0.5) / (df + 0.5))
    mean = np.mean([len(x) for _, x in held])
    bags = [np.bincount(x, minlength=len(df)) for _, x in held]
    weight = [n * 2.2 / (n + 1.2 * (0.25 + 0.75 * n.sum() / mean)) * idf for n in bags]
    for shard_tokens in (4_000_000, 6000, 1500):
        got = {}
        for r in packing.neighbours(frame, shard_tokens=shard_tokens).collect():
            got.setdefault(r["doc_id"], []).append((r["place"], r["neighbour_id"], r["score"]))
        for d, x in held:
            if d is None or d % 20:
                continue
            scores = sorted((float(weight[j][np.unique(x)].sum()), e) for j, (e, _) in enumerate(held) if e is not None and e != d)[::-1][:10]
            mine = sorted(got[d])
            if d == 220:  # two rows of one id ask each for itself
                assert [p for p, *_ in mine] == sorted([*range(1, 11)] * 2)
                continue
            assert [p for p, *_ in mine] == list(range(1, 11))
            assert np.allclose([s for *_, s in mine], [s for s, _ in scores], rtol=1e-4, atol=1e-4)
        assert [n for _, n, _ in sorted(got[0])][:2] == [200, 201]
    assert packing.neighbours(frame, F.col("doc_id") == 7, k=3).count() == 3
    assert packing.neighbours(frame.limit(0)).count() == 0


def test_routes_and_weights_of_a_batch_are_those_of_each_document():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    docs = [rng.zipf(1.3, n).clip(0, 299).astype("<u2") for n in (1, 2, 3, 700, 40, 1, 5000)]
    idf = rng.random(300) + 0.01
    column = pa.array([b"left out"] + [d.tobytes() for d in docs], pa.binary()).slice(1)
    flat, sizes = next(packing._slices(column, "<u2"))
    assert flat.tolist() == np.concatenate(docs).tolist() and sizes.tolist() == [len(d) for d in docs]
    doc, term, weight = packing._weights(flat, sizes, idf, 50.0, 1.2, 0.75)
    route = packing._Route("<u2", idf, 50.0, 1.2, 0.75)
    routes = route.routes(flat, sizes)
    for k, d in enumerate(docs):
        terms, tf = np.unique(d, return_counts=True)
        w = (tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len(d) / 50.0)) * idf[terms]).astype(np.float32)
        assert term[doc == k].tolist() == terms.tolist() and weight[doc == k].tolist() == w.tolist()
        best = terms[np.argsort(-route.draw[terms] / np.square(w, dtype=np.float64), kind="stable")[:4]]
        assert routes[k].tolist() == best.tolist() + [0xFFFFFFFF] * (4 - len(best))
