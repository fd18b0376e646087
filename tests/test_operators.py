import hashlib
import random

import pytest
from pyspark.sql import functions as F

from leafwright.operators import coverage, planning, progress, scan, search, segment, state


def chapters_of(rows):
    out = {}
    for r in rows.orderBy("book", "chapter_no", "unit_no").collect():
        out.setdefault(r["book"], {}).setdefault((r["chapter_no"], r["title"]), []).append(r["unit"])
    return {b: [(t, u) for (_, t), u in c.items()] for b, c in out.items()}


def paragraphs(spark, books):
    return spark.createDataFrame([(b, k, t) for b, ts in books.items() for k, t in enumerate(ts)], "book string, para_no long, text string")


def test_buckets(spark):
    books = {
        "a": ["before", "CHAPTER I", "one", "two", "CHAPTER II", "CHAPTER III", "three"],
        "b": ["CHAPTER I", "CHAPTER II"],
        "c": ["only text"],
    }
    exact = segment.bucketed(paragraphs(spark, books)).orderBy("book", "para_no").collect()
    assert [(r["book"], r["title"], r["text"]) for r in exact] == [
        ("a", "CHAPTER I", "one"), ("a", "CHAPTER I", "two"), ("a", "CHAPTER III", "three"),
        ("b", "Untitled", "CHAPTER I"), ("b", "Untitled", "CHAPTER II"), ("c", "Untitled", "only text"),
    ]
    kept = segment.bucketed(paragraphs(spark, books), keep_preface=True).where("book in ('a', 'c')").orderBy("book", "para_no").collect()
    assert [(r["title"], r["text"]) for r in kept][0] == ("Preface", "before") and [r["title"] for r in kept][-1] == "Preface"
    assert segment.bucketed(paragraphs(spark, {"a": ["x"]}).limit(0)).count() == 0


def test_front_matter_merge_is_the_loop(spark):
    import re

    from leafwright.functions.text import CREDIT_TITLE

    rnd, rows, model = random.Random(1), [], {}
    for b in range(120):
        chapters = [(rnd.choice(["CHAPTER X", "BY HAND", "Copyright page", "TITLE"]), rnd.randrange(1, 14)) for _ in range(rnd.randrange(1, 7))]
        listed = []
        for c, (title, n) in enumerate(chapters):
            units = [f"{b}-{c}-{k}" for k in range(n)]
            listed.append([title, units])
            rows += [(str(b), c, title, k + 1, u) for k, u in enumerate(units)]
        while len(listed) > 1 and (re.match(CREDIT_TITLE, listed[0][0]) or len(listed[0][1]) <= 8):
            listed[1][1] = listed[0][1] + listed[1][1]
            listed.pop(0)
        model[str(b)] = [(t, u) for t, u in listed]
    frame = spark.createDataFrame(rows, "book string, chapter_no long, title string, unit_no long, unit string")
    assert chapters_of(segment.front_matter_merged(frame)) == model


def sizes_by_part(frame):
    return sorted(r["count"] for r in frame.groupBy("part").count().collect())


@pytest.fixture
def many_parts(spark):
    """Partitions are neither joined nor few."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_one_huge_book_over_many_tasks(spark, many_parts):
    """A heading before every 1,000th of 100,000 paragraphs of two sentences each: no task has a book, all get alike."""
    n = 100_000
    text = F.when(F.col("id") % 1000 == 0, F.concat(F.lit("CHAPTER "), F.col("id") + 1)).otherwise(F.concat(F.lit("One of "), F.col("id"), F.lit(". And more.")))
    rows = spark.range(0, n, 1, 6).select(F.lit("b").alias("book"), F.col("id").alias("para_no"), text.alias("text"))
    dealt = sizes_by_part(scan.ranged(rows, ["book", "para_no"]))
    assert len(dealt) == 9 and dealt[-1] < 2 * dealt[4]
    got = segment.bucketed(rows).groupBy("chapter_no", "title").agg(F.count("*"), F.min("para_no"), F.max("para_no")).orderBy("chapter_no").collect()
    assert [tuple(r) for r in got] == [(k + 1, f"CHAPTER {1000 * k + 1}", 999, 1000 * k + 1, 1000 * k + 999) for k in range(100)]
    units = segment.book_units(rows).groupBy("chapter_no").agg(F.count("*").alias("n"), F.max("unit_no").alias("top"), F.min_by("unit", "unit_no").alias("first"), F.first("title").alias("title")).orderBy("chapter_no").collect()
    assert len(units) == 100 * 25 and [r["n"] for r in units] == [r["top"] for r in units] == ([80] * 24 + [78]) * 100
    assert [(units[k]["title"], units[k]["first"]) for k in (0, 25 * 7 + 3)] == [("CHAPTER 1 (Part 1/25)", "One of 1."), ("CHAPTER 7001 (Part 4/25)", "One of 7121.")]


def test_running_sums(spark, many_parts):
    rnd = random.Random(8)
    rows = [(rnd.choice(["a", "b", None, "huge", "huge", "huge"]), k, rnd.randrange(-3, 9), "x") for k in range(3000)]
    frame = spark.createDataFrame(rows, "book string, no long, v int, part_name string").repartition(7)
    got = {r["no"]: (r["s"], r["c"]) for r in scan.running(frame, ["book"], ["no"], {"s": F.col("v"), "c": F.lit(1)}).collect()}
    sums, counts = {}, {}
    for b, k, v, _ in rows:
        sums[b], counts[b] = sums.get(b, 0) + v, counts.get(b, 0) + 1
        assert got[k] == (sums[b], counts[b])
    assert len(got) == 3000 and scan.running(frame.limit(0), ["book"], ["no"], {"s": F.col("v")}).count() == 0


def greedy(sizes, most_units=20, most_chars=2200):
    plan, at = [], 0
    while at < len(sizes):
        end, held = at, 0
        while end < len(sizes) and end - at < most_units and (end == at or held + sizes[end] <= most_chars):
            held += sizes[end]
            end += 1
        plan.append((at + 1, end - at, held))
        at = end
    return plan


@pytest.mark.parametrize("n", [1, 5, 11, 40, 30_000])
def test_windows_of_one_huge_chapter(spark, many_parts, n):
    """A chapter over many blocks, also blocks that are shorter than a window; small chapters stand around it."""
    rnd = random.Random(n)
    sizes = {("b", 1): [rnd.choice([0, 1, 5, 90, 300, 2200, 2500]) for _ in range(n)], ("a", 3): [7] * 50, ("b", 2): [2300, 0, 3], (None, 1): [500] * 9}
    rows = [(b, c, "T", k, "x" * s) for (b, c), each in sizes.items() for k, s in enumerate(each, 1)]
    frame = spark.createDataFrame(rows, "book string, chapter_no long, title string, unit_no long, unit string").repartition(5)
    found = {}
    for r in planning.windows(frame).orderBy("start").collect():
        found.setdefault((r["book"], r["chapter_no"]), []).append((r["start"], r["n_units"], r["n_chars"]))
        assert sum(map(len, r["texts"])) == r["n_chars"] and len(r["texts"]) == r["n_units"]
    assert found == {k: greedy(v) for k, v in sizes.items()}


def test_oversize(spark):
    rows = [("b", 1, "T", k + 1, str(k)) for k in range(161)] + [("b", 2, "U", 1, "x")]
    got = chapters_of(segment.oversize_split(spark.createDataFrame(rows, "book string, chapter_no long, title string, unit_no long, unit string")))
    assert [(t, len(u)) for t, u in got["b"]] == [("T (Part 1/3)", 80), ("T (Part 2/3)", 80), ("T (Part 3/3)", 1), ("U", 1)]


def units(spark, texts, chapter=1, book="b"):
    return spark.createDataFrame([(book, chapter, "T", k, t) for k, t in enumerate(texts, 1)], "book string, chapter_no long, title string, unit_no long, unit string")


def test_windows_are_greedy(spark):
    rnd = random.Random(2)
    rows, model = [], {}
    for c in range(60):
        sizes = [rnd.choice([1, 5, 100, 700, 2200, 2500]) for _ in range(rnd.randrange(1, 60))]
        rows += [("b", c, "T", k, "x" * n) for k, n in enumerate(sizes, 1)]
        plan, at = [], 0
        while at < len(sizes):
            end, held = at, 0
            while end < len(sizes) and end - at < 20 and (end == at or held + sizes[end] <= 2200):
                held += sizes[end]
                end += 1
            plan.append((at + 1, end - at, held))
            at = end
        model[c] = plan
    frame = spark.createDataFrame(rows, "book string, chapter_no long, title string, unit_no long, unit string")
    got = {}
    for r in planning.windows(frame).orderBy("chapter_no", "start").collect():
        got.setdefault(r["chapter_no"], []).append((r["start"], r["n_units"], r["n_chars"]))
        assert [len(t) for t in r["texts"]] and sum(map(len, r["texts"])) == r["n_chars"]
    assert got == model


def test_fingerprint_and_context(spark):
    frame = units(spark, ["a", "b é", "c", "d", "e"]).unionByName(units(spark, ["z"], 2))
    expected = hashlib.sha1("T\0a\0b é\0c\0d\0e\0T\0z\0".encode()).hexdigest()
    assert planning.fingerprint(frame).first()["source_hash"] == expected
    got = {(r["chapter_no"], r["unit_no"]): r["context"] for r in planning.context_before(frame).collect()}
    assert got[1, 1] is None and got[1, 3] == ["a", "b é"] and got[1, 5] == ["b é", "c", "d"] and got[2, 1] is None


def test_glossary(spark):
    said = "Emma met The Prince. Then Emma Woodhouse left. The Emma stays.\nEmma\nEmma"
    frame = spark.createDataFrame([("b", said), ("c", "nothing here")], "book string, text string")
    counts = {r["term"]: r["n"] for r in planning.term_counts(frame).collect()}
    assert counts == {"Emma": 1, "Then Emma Woodhouse": 1, "The Emma": 1, "Emma\nEmma": 1}
    terms = planning.glossary(planning.term_counts(spark.createDataFrame([("b", "Box. Box. Box. Cat. Cat. Cat. Dog.")], "book string, text string")))
    assert [(r["rank"], r["term"], r["rendering"]) for r in terms.orderBy("rank").collect()] == [(1, "Box", "<CONSISTENT:Box>"), (2, "Cat", "<CONSISTENT:Cat>")]
    answers = spark.createDataFrame([("b", 0, '{"Box": "상자", "Dog": "개", "Cat": " "}')], "book string, chunk_no long, reply string")
    assert [r["rendering"] for r in planning.enriched(terms, answers).orderBy("rank").collect()] == ["상자", "<CONSISTENT:Cat>"]


def test_resume_and_merge(spark):
    frame = units(spark, ["a", "b", "c"])
    hashes = planning.fingerprint(frame)
    right = hashes.first()["source_hash"]
    stored = spark.createDataFrame([("b", 1, 1, "A", right), ("b", 1, 9, "Z", right)], "book string, chapter_no long, unit_no long, translation string, source_hash string")
    pairs = progress.resumed(frame, stored, hashes)
    assert [r["translation"] for r in pairs.orderBy("unit_no").collect()] == ["A", "", ""]
    wrong = stored.withColumn("source_hash", F.lit("x"))
    assert [r["translation"] for r in progress.resumed(frame, wrong, hashes).orderBy("unit_no").collect()] == ["", "", ""]
    news = spark.createDataFrame([("b", 1, 1, 1, " "), ("b", 1, 2, 1, "B1"), ("b", 1, 2, 2, "B2"), ("b", 1, 2, 3, "\n")], "book string, chapter_no long, unit_no long, seq int, translation string")
    once = progress.merged(pairs, news)
    assert [r["translation"] for r in once.orderBy("unit_no").collect()] == ["A", "B2", ""]
    assert progress.merged(once, news).collect().sort() == once.collect().sort()
    assert progress.gate(once).first()["status"] == "incomplete"
    assert progress.missing_preview(once).first()["preview"] == "ch1 unit3"


def test_translation_with_failures(spark):
    frame = units(spark, ["one <i>x</i>", "two", "Stop", "four"])

    def model(request):
        if "One text" in request:
            if "Stop" in request:
                raise RuntimeError("no")
            return "[1] " + request.rsplit("\n\n", 1)[-1]
        return "[1] eins ◀TAG0▶x◀TAG1▶\n[2] zwei"

    got = progress.translated(frame, model, language="en").orderBy("unit_no").collect()
    assert [r["translation"] for r in got] == ["eins <i>x</i>", "zwei", "", "four"]
    pairs = frame.join(spark.createDataFrame([("b", 1, r["unit_no"], r["translation"]) for r in got], "book string, chapter_no long, unit_no long, translation string"), ["book", "chapter_no", "unit_no"])
    assert [r["translation"] for r in progress.filled(pairs, lambda u: "filled " + u).orderBy("unit_no").collect()] == ["eins <i>x</i>", "zwei", "filled Stop", "four"]
    proofed = progress.translated(frame, lambda r: "\n".join(f"[{k}] p{k}" for k in range(1, 5)), proof=True).orderBy("unit_no").collect()
    assert [r["translation"] for r in proofed] == ["p1", "p2", "p3", "p4"]


def test_catalogue_state(spark):
    log = spark.createDataFrame(
        [("a", 1, "requested", None, None), ("a", 2, None, "boom", None), ("a", 3, "published", None, ["error"]), ("b", 4, "requested", "x", None)],
        "id string, seq long, status string, error string, cleared array<string>",
    )
    now = state.current(log, ["status", "error"])
    assert {r["id"]: (r["status"], r["error"], r["created_seq"], r["updated_seq"]) for r in now.collect()} == {"a": ("published", None, 1, 3), "b": ("requested", "x", 4, 4)}
    assert [r["id"] for r in state.recent(now, 1).collect()] == ["b"] and state.recent(now, 0).count() == 0
    assert [r["allowed"] for r in state.transitions(log).orderBy("seq").collect()] == [True, False, True]


def test_queue(spark):
    log = spark.createDataFrame(
        [("p", 1, "enqueue", "P"), ("p", 2, "attempt", None), ("q", 3, "enqueue", "Q"), ("p", 4, "enqueue", "P2"), ("p", 5, "attempt", None), ("r", 6, "enqueue", "R"), ("r", 7, "remove", None), ("s", 8, "attempt", None)],
        "path string, seq long, op string, title string",
    )
    got = {r["path"]: (r["title"], r["queued_seq"], r["attempts"]) for r in state.queue(log).collect()}
    assert got == {"p": ("P2", 4, 1), "q": ("Q", 3, 0)}


def test_drain_stops_when_the_device_goes(spark):
    items = spark.createDataFrame([(0, p, k) for k, p in enumerate("abcd", 1)], "tick long, path string, pos long")
    outcomes = spark.createDataFrame([(0, "a", True, True, False), (0, "b", True, False, False), (0, "c", True, False, True), (0, "d", True, True, False)], "tick long, path string, exists boolean, pushed boolean, skipped boolean")
    got = state.drained(items, outcomes)
    assert [r["result"] for r in got.orderBy("pos").collect()] == ["pushed", "failed", "failed", "waiting"]
    assert state.drain_summary(got).first().asDict() == {"tick": 0, "queued": 4, "pushed": 1, "failed": 2, "left": 3}


def test_search(spark):
    rows = spark.createDataFrame([("q", 0, 1, "gutenberg", "Emma", "Jane", None), ("q", 1, 1, "local", "EMMA", "jane", "x"), ("q", 1, 2, "other", "Sense", "Jane", "public domain")], "query string, source_rank int, pos long, source string, title string, author string, rights string")
    found = search.merged(rows)
    assert [(r["source"], r["title"]) for r in found.orderBy("source_rank", "pos").collect()] == [("gutenberg", "Emma"), ("other", "Sense")]
    assert search.shown(found).first()["message"].endswith("1. [GB] Emma / Jane \n2. [other] Sense / Jane [public domain]")


def test_coverage(spark):
    frame = spark.createDataFrame([("a가😀",), (None,), ("",)], "text string")
    found = {r["cp"] for r in coverage.code_points(frame, always=False).collect()}
    assert found == {0x61, 0xAC00, 0x1F600}
    assert {r["text"] for r in coverage.json_texts(spark.createDataFrame([('{"k": ["v\\n", {"x": "y"}]}',)], "j string"), "j").collect()} == {"v\n", "y"}
    lines = [r["line"] for r in coverage.coverage_lines(coverage.code_points(frame, always=False)).orderBy("line_no").collect()]
    assert lines == ["# 3 codepoints (book-specific subset)", "0x0061", "0xAC00", "0x1F600"]


def test_fingerprints_are_streamed(spark):
    """Books of many batches: the digest is that of the whole, whatever the order of rows and the size of batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")
    rows = spark.range(0, 30_000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("b"), F.col("id") % 3)).alias("book"), F.floor(F.col("id") / 9000).alias("chapter_no"), F.concat(F.lit("T"), F.floor(F.col("id") / 9000)).alias("title"), (F.col("id") % 9000).alias("unit_no"), F.when(F.col("id") % 50 != 7, F.concat(F.lit("é"), F.col("id"))).alias("unit")
    )
    got = {r["book"]: r["source_hash"] for r in planning.fingerprint(rows.orderBy(F.rand(1))).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for book, k in ((None, 0), ("b1", 1), ("b2", 2)):
        state, chapter = hashlib.sha1(), None
        for i in range(k, 30_000, 3):
            if i // 9000 != chapter:
                chapter = i // 9000
                state.update(f"T{chapter}\0".encode())
            state.update((f"é{i}" if i % 50 != 7 else "").encode() + b"\0")
        assert got[book] == state.hexdigest()
    assert planning.fingerprint(rows.limit(0)).count() == 0


def test_full_text_in_parts(spark):
    rows = [(b, c, f"T{c}", k, f"{b}{c}.{k}") for b, c, n in (("a", 1, 7), ("a", 4, 1), ("a", 5, 3), ("b", 2, 2)) for k in range(1, n + 1)]
    frame = spark.createDataFrame(rows, "book string, chapter_no long, title string, unit_no long, unit string").repartition(3)
    whole = {"a": "\n\n".join(f"T{c}\n" + "\n".join(f"a{c}.{k}" for k in range(1, n + 1)) for c, n in ((1, 7), (4, 1), (5, 3))), "b": "T2\nb2.1\nb2.2"}
    parts = planning.full_text_parts(frame, units=3).orderBy("book", "chapter_no", "part_no").collect()
    assert {b: "".join(r["text"] for r in parts if r["book"] == b) for b in whole} == whole and len(parts) == 6
    assert {r["book"]: r["text"] for r in planning.full_text(frame).collect()} == whole


def test_a_run_keeps_no_requests_and_gives_each_window_the_units_before_it(spark, monkeypatch):
    from leafwright.operators import planning, progress

    kept = {}
    monkeypatch.setattr(progress, "table", lambda rows, name, real=progress.table: kept.setdefault(name, real(rows, name)))
    rows = spark.createDataFrame([("b", c, "t", k, f"unit {c}.{k} " + "x" * (k % 5) * 500) for c in (1, 2) for k in range(1, 40)], "book string, chapter_no long, title string, unit_no long, unit string")
    asked = spark.sparkContext.accumulator(0)

    def answer(request):
        asked.add(1)
        return request

    progress.translated(rows, answer).count()
    assert kept["replies"].columns == ["book", "chapter_no", "start", "texts", "reply"] and asked.value > 8
    before = {(r["chapter_no"], r["unit_no"]): r["context"] for r in planning.context_before(rows).collect()}
    for r in kept["replies"].collect():  # the reply is the request
        context = before[r["chapter_no"], r["start"]] or []
        assert all(u in r["reply"] for u in context) and r["reply"].count("unit ") == len(context) + len(r["texts"])
