"""The pipeline's stages, each on what the one before kept."""

import re

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names}
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "near-duplicates", "secrets", "packing"]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(9001, "12 !! 34", "en", "s", 8), (9002, None, "en", "s", None), (9003, docs.where("doc_id = 1").first()["text"], "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).withColumn("score", F.lit(1))
    first = cp.language(spark, docs, SF)
    assert first.columns == docs.columns
    kept = {r["doc_id"] for r in first.collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {9001, 9002}
    second = cp.good_quality(spark, first, SF)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = {r["doc_id"] for r in second.collect()}
    known = [d for d in kept if d in labels]
    assert sum((d in good) == (labels[d] == 1) for d in known) / len(known) > 0.9
    third = cp.unique(spark, second, SF)
    assert third.columns == docs.columns and not {1, 9003} <= {r["doc_id"] for r in third.collect()}
    fourth = cp.without_secrets(spark, third, SF).collect()
    assert len(fourth) == third.count() and all(r["n_chars"] == len(r["text"]) for r in fourth)
    assert not any(re.search("AKIA[A-Z0-9]{16}|password=[0-9a-f]{18}", r["text"]) for r in fourth)


def test_run_packs_everything_that_is_kept(spark):
    pieces = cp.run(spark, SF)
    sizes = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert sizes and all(r["n"] == r["m"] for r in sizes)


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_own_columns_stay(spark):
    """Columns that are named like a stage's working columns are carried with their values; n_chars may be absent."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").drop("n_chars")
    own = {c: F.lit("mine") for c in ("_lang_pred", "_lang_score", "_quality_score", "n_shingles", "component_id", "kept", "first")}
    docs = docs.withColumns(own)
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select(*own).distinct().collect()} == {("mine",) * len(own)}


def test_unique_is_the_brute_force_rule(spark):
    """One document, that of the least id, of each component of links at 0.8; near copies are made of the table's own texts."""
    import random

    rnd = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k in range(60):
        words = rnd.choice(list(texts.values())[:120]).split()
        for _ in range(rnd.randrange(0, 4)):
            words[rnd.randrange(len(words))] = f"other{k}"
        texts[5000 + k] = " ".join(words)
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    kept = sorted(r["doc_id"] for r in cp.unique(spark, frame, SF).collect())
    assert kept == [d for d in ids if find(d) == d] and len(kept) < len(ids)


def test_no_task_holds_two_python_workers(spark, monkeypatch):
    """Workers outlive their stage, so one task with two Python steps doubles what an executor holds from then on."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet

    def parquet(self, *args, **settings):
        plans.append(self._df)
        return write(self, *args, **settings)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    plans.append(cp.run(spark, SF))
    steps = 0
    for frame in plans:
        above = []  # depth of each operator on the way down, and whether a Python step is open in its task
        for line in frame._jdf.queryExecution().executedPlan().toString().splitlines():
            name = re.search(r"[A-Z].*", line)
            if not name:
                continue
            above = [x for x in above if x[0] < name.start()]
            python = bool(re.match("MapInArrow|FlatMapGroupsInArrow", name[0]))
            assert not (python and above and above[-1][1]), frame._jdf.queryExecution().executedPlan().toString()
            steps += python
            above.append((name.start(), python or bool(above) and above[-1][1] and "Exchange" not in name[0]))
    assert len(plans) > 10 and steps > 10
