"""Language, quality and masked language model: held-out accuracy, odd rows, and plain recomputation."""

import numpy as np
from pyspark.sql import functions as F

from leafwright.llm import langid, maskedlm, quality

SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.language_of_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 100 and (got["lang"] == got["lang_pred"]).mean() > 0.98
    assert got["score"].between(0, 1).all()


def test_language_odd_rows(odd):
    got = langid.language_of_documents(odd)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert len(rows) == 9
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert all(by[k] == [("und", 0.0)] for k in (2, 3, 4, 6)) and by[1][0] == by[1][1]
    assert [r["held_out"] for r in rows if r["doc_id"] is None] == [True]
    assert langid.language_of_documents(odd.limit(0)).count() == 0
    unlabelled = langid.language_of_documents(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_counts_do_not_depend_on_pieces(monkeypatch):
    said = "Ça va? 12 Ürban ABC 日本 " * 40
    whole, n = langid.bucket_counts(said, 12)
    monkeypatch.setattr(langid, "_PIECE", 7)
    parts, m = langid.bucket_counts(said, 12)
    assert n == m and (whole == parts).all()


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.quality_of_documents(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    right = got["predicted"] == got["quality"]
    assert right.mean() > 0.9 and got["score"].between(0, 1).all()
    assert got[got["quality"] == 1]["score"].mean() > got[got["quality"] == 0]["score"].mean() + 0.3


def test_quality_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (8, 1), (None, 1), (3, None), (9, 5)], "doc_id long, quality int")
    rows = quality.quality_of_documents(odd, labels).collect()
    assert len(rows) == 9 and all(0 <= r["score"] <= 1 for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}
    assert len(blank) == 1
    assert {r["score"] for r in quality.quality_of_documents(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_of_documents(odd.limit(0), labels).count() == 0


def test_masked_probabilities_sum_to_one():
    net = maskedlm.Network(4, 4, 5, 2)
    w = net.start(np.arange(16.0))
    w += np.random.default_rng(0).normal(0, 0.3, w.shape).astype(np.float32)
    context = np.tile([1, 2, 16, 3], (16, 1))
    assert abs(np.exp(net.log_probabilities(w, np.arange(16), context)).sum() - 1) < 1e-5


def test_masked_step_is_the_gradient():
    net = maskedlm.Network(3, 3, 4, 1)
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.5, (net.rows, 5))
    w[net.parts["embedding"].stop - 1] = 0
    target, context = rng.integers(0, 9, 20), rng.integers(0, 10, (20, 2))
    loss = lambda v: -net.log_probabilities(v, target, context).mean()
    stepped, memory = w.copy(), np.zeros_like(w)
    net.step(stepped, memory, target, context, 1e-9)
    g = np.sqrt(memory) * -np.sign(stepped - w)
    for name in ("embedding", "place", "hidden", "class", "token"):
        row = net.parts[name].start
        for col in (0, 2):
            v = w.copy()
            v[row, col] += 1e-5
            assert abs((loss(v) - loss(w)) / 1e-5 - g[row, col]) < 1e-3


def test_masked_scores(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    noise = docs.limit(60).select((F.col("doc_id") + 10**6).alias("doc_id"), F.array_join(F.shuffle(F.split("text", " ")), " ").alias("text"))
    both = docs.select("doc_id", "text").unionByName(noise)
    got = maskedlm.score(both).toPandas()
    assert len(got) == both.count() and (got["mean_log_likelihood"].dropna() < 0).all()
    rows = {r["doc_id"]: r for r in maskedlm.score(odd, classes=8, size=8, buckets=16).collect()}
    assert rows[2]["n_tokens"] == rows[3]["n_tokens"] == 0 and rows[2]["log_likelihood"] == 0 and rows[3]["mean_log_likelihood"] is None
    assert rows[7]["n_tokens"] == 60_000
    assert maskedlm.score(odd.limit(0)).count() == 0


def test_masked_training_helps(spark):
    """After training the tokens of real documents are likelier than under the unigram start."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trained = maskedlm.score(docs).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    start = maskedlm.score(docs, rate=0.0).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert trained > start + 0.05


def test_masked_scores_of_words_in_a_bucket_rest_on_their_own_counts(spark):
    """One bucket: a document's score differs from another's of the same shape by the log of its words' counts."""
    docs = [(k, "the cat often sat") for k in range(30)] + [(k, "the cat twice sat") for k in range(30, 33)] + [(40, "the cat qzxv sat")]
    rows = maskedlm.score(spark.createDataFrame(docs, "doc_id long, text string"), classes=2, size=2, buckets=1, rate=0.0).toPandas().set_index("doc_id")
    likely = rows["log_likelihood"]
    assert len(rows) == 34 and likely[0] > likely[30] > likely[40]
    assert abs(likely[30] - likely[40] - np.log(3)) < 0.02


def test_language_is_a_plain_recount(spark):
    """Counts, priors and posteriors by dictionaries over every n-gram of every training text."""
    import math
    import zlib
    from collections import Counter

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500").limit(60)
    rows = docs.select("doc_id", "text", "lang").collect()
    used = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None and r["text"] is not None]
    bits = 10

    def buckets(text):
        code, out = [], Counter()
        for ch in text.lower():
            c = ord(ch) if ch.isalpha() else 32
            if c != 32 or not code or code[-1] != 32:
                code.append(c)
        for n in (1, 2, 3):
            for i in range(len(code) - n + 1):
                h = n * 0x9E3779B1 & 0xFFFFFFFF
                for k, m in zip(range(n), (2654435761, 2246822519, 3266489917)):
                    h = (h ^ code[i + k]) * m & 0xFFFFFFFF
                    h ^= h >> 15
                out[(h * 2654435761 & 0xFFFFFFFF) >> (32 - bits)] += 1
        return out

    known = sorted({r["lang"] for r in used})
    counts = {x: Counter() for x in known}
    for r in used:
        counts[r["lang"]] += buckets(r["text"])
    prior = {x: math.log(sum(r["lang"] == x for r in used) / len(used)) for x in known}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.language_of_documents(spark.createDataFrame(rows), bits=bits).collect()}
    for r in rows:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]] == ("und", 0.0)
            continue
        mine = buckets(r["text"])
        n = sum(mine.values())
        logs = {x: sum(k * math.log((counts[x][b] + 0.1) / (sum(counts[x].values()) + 0.1 * 2**bits)) for b, k in mine.items()) for x in known}
        best = max(known, key=lambda x: logs[x] + prior[x])
        odds = {x: logs[x] * min(1, 100 / n) + prior[x] for x in known}
        chance = 1 / sum(math.exp(odds[x] - odds[best]) for x in known)
        assert got[r["doc_id"]][0] == best and abs(got[r["doc_id"]][1] - chance) < 1e-9


def test_ftrl_is_plain_ftrl():
    """Weight by weight, by the published update, in dictionaries."""
    import math

    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(16, 4, replace=False)), rng.random(4), int(rng.integers(0, 2))) for _ in range(40)]
    alpha, beta, l1, l2, epochs = 0.7, 1.0, 0.01, 0.02, 3
    z, n = [0.0] * 17, [0.0] * 17
    w = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)
    for _ in range(epochs):
        for at, x, y in rows:
            parts = [*zip(at.tolist(), x.tolist()), (16, 1.0)]
            p = 1 / (1 + math.exp(-sum(w(i) * v for i, v in parts)))
            old = {i: w(i) for i, _ in parts}
            for i, v in parts:
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha * old[i]
                n[i] += g * g
    weights, bias = quality.ftrl(rows, 4, alpha, beta, l1, l2, epochs)
    assert np.allclose(weights, [w(i) for i in range(16)]) and abs(bias - w(16)) < 1e-12


def test_masked_score_of_one_document_by_hand():
    """A document's score from the parameters, token by token, in plain arithmetic."""
    import math

    net = maskedlm.Network(3, 3, 4, 2)
    w = net.start(np.arange(9.0), seed=5) + np.random.default_rng(6).normal(0, 0.4, (net.rows, 5)).astype(np.float32)
    w[net.parts["embedding"].stop - 1] = 0
    doc = [4, 0, 8, 8, 2, 5]
    part = {k: w[v].astype(float) for k, v in net.parts.items()}
    total = 0.0
    for i, target in enumerate(doc):
        h = part["hidden"][0, :4].copy()
        for j, o in enumerate((-2, -1, 1, 2)):
            if 0 <= i + o < len(doc):
                h += part["embedding"][doc[i + o], :4] * part["place"][j, :4]
        h = np.tanh(h)
        top = [math.exp(h @ part["class"][c, :4] + part["class"][c, 4]) for c in range(3)]
        low = [math.exp(h @ part["token"][t, :4] + part["token"][t, 4]) for t in range(target // 3 * 3, target // 3 * 3 + 3)]
        total += math.log(top[target // 3] / sum(top)) + math.log(low[target % 3] / sum(low))
    target, context = net.contexts([np.array(doc)])
    assert abs(float(net.log_probabilities(w, target, context).sum()) - total) < 1e-3


def test_shuffled_texts_are_less_likely(spark):
    """The same words in another order: the network's part of the score falls."""
    sentences = ["the old man went to the sea and came back with one fish", "a red house stands by the river near our small town", "she never told them where her brother hid all the money"]
    docs = spark.createDataFrame([(k, " . ".join(sentences[(k + i) % 3] for i in range(12))) for k in range(150)], "doc_id long, text string")
    noise = docs.where("doc_id < 10").select((F.col("doc_id") + 1000).alias("doc_id"), F.array_join(F.sort_array(F.transform(F.split("text", " "), lambda w: F.concat(F.md5(F.concat(w, F.lit("x"))), F.lit("/"), w))), " ").alias("text"))
    noise = noise.withColumn("text", F.regexp_replace("text", r"[0-9a-f]{32}/", ""))
    got = maskedlm.score(docs.unionByName(noise), classes=8, size=8, buckets=8, batch=256).toPandas()
    real, mixed = got[got["doc_id"] < 1000], got[got["doc_id"] >= 1000]
    assert mixed["mean_log_likelihood"].max() < real["mean_log_likelihood"].min() - 0.3


def test_masked_scores_do_not_depend_on_partitions(spark):
    """Documents are dealt by content: the same scores from 2 and 7 partitions, with one deal and with several."""
    rnd = np.random.default_rng(8)
    words = [f"w{k}" for k in range(300)]
    docs = spark.createDataFrame([(k % 190 if k % 19 else None, " ".join(rnd.choice(words, 40))) for k in range(200)], "doc_id long, text string")
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    run = lambda parts, deal: sorted(map(repr, maskedlm.score(docs.repartition(parts), classes=8, size=8, buckets=16, batch=256, deal_tokens=deal).collect()))
    several = run(2, 1500)
    assert several == run(7, 1500) and len(several) == 200
    assert run(3, 1 << 22) != several


def test_words_in_buckets_ask_once_for_each_document():
    """Distinct hashes of a text and their counts, with empty and null texts in between."""
    from types import SimpleNamespace

    import pyarrow as pa
    import xxhash

    texts = ["a b b known c b", "", None, "known known", "c a c a , c."]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts), pa.array(range(5))], names=["doc_id", "text", "rid"])
    out = maskedlm._Encode(SimpleNamespace(value={"known": 0}), 4)(batch)
    digest = lambda w: np.array(xxhash.xxh64_intdigest(w, 42), np.uint64).view(np.int64).item()
    got = [dict(zip(h, n)) for h, n in zip(out["hashed"].to_pylist(), out["times"].to_pylist())]
    assert got == [{digest("a"): 1, digest("b"): 3, digest("c"): 1}, {}, {}, {}, {digest("c"): 3, digest("a"): 2, digest(","): 1, digest("."): 1}]
    assert [len(x) // 2 for x in out["ids"].to_pylist()] == [6, 0, 0, 2, 7]


def test_masked_steps_work_in_the_same_arrays():
    """A step takes no new large arrays after the first, and what an earlier one left in them changes nothing."""
    import tracemalloc

    rng = np.random.default_rng(3)
    batches = [(rng.integers(0, 4096, n), rng.integers(0, 4097, (n, 4))) for n in (8192, 100, 8192)]
    used = maskedlm.Network(64, 64, 16, 2)
    w = used.start(np.arange(4096.0))
    for target, context in batches:
        tracemalloc.start()
        own, other, memory = w.copy(), w.copy(), np.full_like(w, 1e-6)
        tracemalloc.reset_peak()
        used.step(own, memory, target, context, 0.2)
        peak = tracemalloc.get_traced_memory()[1] - own.nbytes * 3
        tracemalloc.stop()
        maskedlm.Network(64, 64, 16, 2).step(other, np.full_like(w, 1e-6), target, context, 0.2)
        assert np.array_equal(own, other)
        assert np.array_equal(used.log_probabilities(own, target, context), maskedlm.Network(64, 64, 16, 2).log_probabilities(own, target, context))
    assert peak < 2 * 8192 * 64 * 4  # two arrays of logits


def _written(rng):
    """Documents of token numbers: empty ones, one shorter than a window, and some longer than a batch."""
    return [rng.integers(0, 4096, n).astype("<u2") for n in (0, 1, 700, 3, 0, 1500, 2, 4, 900, 1)]


def test_masked_documents_as_a_line_are_their_tokens_windows():
    """Learning and scoring along a line of documents give what single windows around each token give."""
    rng = np.random.default_rng(5)
    net, docs = maskedlm.Network(64, 64, 16, 2), _written(rng)
    target, context = net.contexts(docs)
    flat = [(k, i) for k, d in enumerate(docs) for i in range(len(d))]
    assert target.tolist() == [docs[k][i] for k, i in flat]
    assert context.tolist() == [[docs[k][i + o] if 0 <= i + o < len(docs[k]) else 4096 for o in (-2, -1, 1, 2)] for k, i in flat]
    along = net.start(np.bincount(target, minlength=4096).astype(float)).astype(float)
    single, memory, other = along.copy(), np.full_like(along, 1e-6), np.full_like(along, 1e-6)
    for k, (line, at) in enumerate(net.parted(*net.line(docs), 512)):
        net.learn(along, memory, line, at, 0.2)
        net.step(single, other, target[512 * k : 512 * k + 512], context[512 * k : 512 * k + 512], 0.2)
    assert np.abs(along - single).max() < 1e-9 and np.abs(along - net.start(np.ones(4096))).max() > 0.1
    got = np.concatenate([net.likelihoods(along, line, at, net.spread(along), net.large(along)) for line, at in net.parted(*net.line(docs), 512)])
    assert len(got) == len(target) and np.abs(got - net.log_probabilities(along, target, context)).max() < 1e-9


def test_masked_training_looks_every_token_up_once(monkeypatch):
    """Neither the rows that a step gathers nor what lies ready for a piece grows with the tokens around a target."""
    import tracemalloc
    from types import SimpleNamespace

    net = maskedlm.Network(64, 64, 16, 2)
    train = maskedlm._Train(net, SimpleNamespace(value=net.start(np.ones(4096))), 8192, 0.2)
    train.w, train.seen = train.start.value.copy(), 0
    train.memory = np.full_like(train.w, 1e-6)
    rng = np.random.default_rng(2)
    train.learn([rng.integers(0, 4096, 9000).astype("<u2")])  # the arrays that steps share
    docs, gathered, take = [rng.integers(0, 4096, 500).astype("<u2") for _ in range(400)], [0], np.take

    def counted(*args, **named):
        out = take(*args, **named)
        gathered[0] += out.size
        return out

    monkeypatch.setattr(np, "take", counted)
    tracemalloc.start()
    train.learn(docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert train.seen == 209_000 and gathered[0] < 200_000 * 40 and peak < 200_000 * 60


def test_masked_logits_beyond_single_precision():
    """Weights so large that a plain exponent overflows: probabilities still sum to one and a step stays finite."""
    net = maskedlm.Network(4, 4, 5, 2)
    w = net.start(np.arange(16.0))
    w += np.random.default_rng(0).normal(0, 100, w.shape).astype(np.float32)
    context = np.tile([1, 2, 16, 3], (16, 1))
    assert net.large(w) and not net.large(net.start(np.arange(16.0)))
    assert abs(np.exp(net.log_probabilities(w, np.arange(16), context)).sum() - 1) < 1e-4
    net.step(w, np.full_like(w, 1e-6), np.arange(16), context, 0.2)
    assert np.isfinite(w).all()


def test_masked_blank_texts_only(spark):
    rows = maskedlm.score(spark.createDataFrame([(1, None), (2, ""), (3, " \n")], "doc_id long, text string"), classes=2, size=2, buckets=1).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["log_likelihood"], r["mean_log_likelihood"]) for r in rows) == [(k, 0, 0.0, None) for k in (1, 2, 3)]
