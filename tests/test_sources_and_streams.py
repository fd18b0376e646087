import io
import json

import pytest
import zipfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwright.operators import render, state
from leafwright.sources import books, payloads
from leafwright.streaming import queue


def pairs(spark):
    rows = [("Bo", 1, "One & <two>", 1, "a & b", "가"), ("Bo", 1, "One & <two>", 2, "c", "나"), ("Bo", 2, "T2", 1, "d", "다"), ("No", 1, "T", 1, "x", " ")]
    return spark.createDataFrame(rows, "book string, chapter_no long, title string, unit_no long, unit string, translation string")


def test_epub_round_trip(spark, tmp_path):
    made = {r["book"]: r for r in render.epubs(pairs(spark), stamp="2024-01-01T00:00:00Z").collect()}
    assert made["No"]["status"] == "refused" and made["No"]["epub"] is None
    (tmp_path / "Bo.epub").write_bytes(bytes(made["Bo"]["epub"]))
    with zipfile.ZipFile(tmp_path / "Bo.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        assert "One &amp; &lt;two&gt;" in z.read("OEBPS/nav.xhtml").decode()
    read = books.markup_paragraphs(books.read_epubs(spark, str(tmp_path / "Bo.epub"))).orderBy("chapter_no", "para_no").collect()
    # Paragraphs of one character are dropped by the reader, as always.
    assert [(r["book"], r["chapter_no"], r["title"], r["text"]) for r in read] == [("Bo", 1, "One & <two>", "a & b")]


def test_cover_and_author(spark):
    rows = pairs(spark).where("book = 'Bo'").withColumn("author", F.lit(" "))
    covers = spark.createDataFrame([("Bo", bytearray(b"\xff\xd8\xff"))], "book string, cover binary")
    made = render.epubs(rows, covers=covers).first()
    import io

    with zipfile.ZipFile(io.BytesIO(bytes(made["epub"]))) as z:
        assert z.read("OEBPS/cover.jpg") == b"\xff\xd8\xff" and "<dc:creator>Unknown</dc:creator>" in z.read("OEBPS/content.opf").decode()


def test_chapter_parser():
    assert books.parse_chapter("<h2> A </h2><p>x<p>long <b>text</b><li><p>in</p></li>", "n.xhtml") == ("A", ["long text", "in", "in"])
    assert books.parse_chapter("<script>var p='<p>no</p>'</script>", "n.xhtml") == ("n", [])
    assert books.parse_chapter("", "c.html") == ("c", [])


def test_texts(spark, tmp_path):
    (tmp_path / "My Book.txt").write_text("x\n*** START OF IT ***\nOne\nline\n\n\nTwo\n\n.\n*** END OF IT ***\ny")
    rows = books.text_paragraphs(books.read_texts(spark, str(tmp_path / "My Book.txt"))).orderBy("para_no").collect()
    assert [r["text"] for r in rows] == ["One line", "Two", ". *"]
    assert books.local_candidates(spark, str(tmp_path)).first()["title"].replace("%20", " ") == "My Book"


def test_state_files(spark, tmp_path):
    schema = T.StructType([T.StructField("a", T.LongType())])
    assert books.read_state(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "bad.json").write_text("{broken")
    assert books.read_state(spark, str(tmp_path / "bad.json"), schema).count() == 0
    (tmp_path / "good.json").write_text('[{"a": 1}, {"a": 2}]')
    assert books.read_state(spark, str(tmp_path / "good.json"), schema).count() == 2


def test_catalogue_pages(spark):
    book = {"id": 7, "title": " Emma ", "authors": [{"name": "Jane"}, {"name": "X"}], "languages": [], "copyright": None, "formats": {"text/html; charset=utf-8": "h", "application/epub+zip": "e"}}
    pages = spark.createDataFrame([("q", 1, json.dumps({"next": None, "results": [book]})), ("q", 2, "broken")], "query string, page_no int, body string")
    row = payloads.catalogue(pages).first().asDict()
    assert (row["title"], row["author"], row["language"], row["rights"], row["fetch_url"], row["source_id"]) == ("Emma", "Jane, X", "en", "unknown", "h", "7")


def test_links(spark):
    page = '<a href="/ebooks/jane-austen/emma?x"><img></a><A HREF="/ebooks/jane-austen/emma">Emma</A><a href="/ebooks/jane-austen">J</a><a href="/d/emma_advanced.epub">x</a><a href="/d/emma.epub">y</a>'
    pages = spark.createDataFrame([("q", page)], "query string, html string")
    row = payloads.book_links(pages, "https://b").first()
    assert (row["title"], row["author"], row["source_id"]) == ("Emma", "Jane Austen", "emma")
    assert payloads.epub_link(pages, "https://b").first()["url"] == "https://b/d/emma.epub"


def test_stream_over_batches(spark, tmp_path):
    """Events in three files, a stop between them: pushed books stay gone until they are queued again, and then are there."""
    events, store, checkpoint = (str(tmp_path / x) for x in ("events", "store", "checkpoint"))
    batches = [
        [("a", 1, "enqueue", "A"), ("b", 2, "enqueue", "B"), ("gone", 3, "enqueue", "G")],
        [("c", 4, "enqueue", "C"), ("a", 5, "enqueue", "A2")],  # the device is away
        [("b", 6, "remove", None), ("d", 7, "attempt", None)],
    ]
    pushed = [["a"], None, ["c"]]
    expected = [{"b": ("B", 1)}, {"b": ("B", 1), "c": ("C", 0), "a": ("A2", 0)}, {"a": ("A2", 1)}]
    for rows, names, left in zip(batches, pushed, expected):
        spark.createDataFrame(rows, queue.LOG).coalesce(1).write.mode("append").parquet(events)

        def outcomes(items, number, names=names):
            if names is None:
                return None
            return items.select("path", (F.col("path") != "gone").alias("exists"), F.col("path").isin(names).alias("pushed"), F.lit(False).alias("skipped"), F.lit("10.0.0.9").alias("ip"), F.lit("cache").alias("source"))

        queue.run(spark, events, store, checkpoint, outcomes).awaitTermination(60)
        assert {r["path"]: (r["title"], r["attempts"]) for r in queue.stored_queue(spark, store).collect()} == left
    passes = [tuple(r) for r in queue.summaries(spark, store).orderBy("tick").select("tick", "queued", "discovered", "pushed", "failed", "left", "ip", "source").collect()]
    assert passes == [(0, 3, True, 1, 1, 1, "10.0.0.9", "cache"), (1, 3, False, 0, 0, 3, None, None), (2, 2, True, 1, 1, 1, "10.0.0.9", "cache")]


def test_a_lost_queue_is_an_error_and_a_batch_counts_once(spark, tmp_path):
    import shutil

    events, store, checkpoint = (str(tmp_path / x) for x in ("events", "store", "checkpoint"))
    asked = []

    def outcomes(items, number):
        asked.append(number)
        return items.select("path", F.lit(True).alias("exists"), (F.col("path") == "a").alias("pushed"), F.lit(False).alias("skipped"))

    add = lambda *rows: spark.createDataFrame(rows, queue.LOG).coalesce(1).write.mode("append").parquet(events)
    add(("a", 1, "enqueue", "A"), ("b", 2, "enqueue", "B"))
    queue.run(spark, events, store, checkpoint, outcomes).awaitTermination(60)
    for commit in (tmp_path / "checkpoint" / "commits").glob("*0*"):  # as if the driver had died before it noted the end of the batch
        commit.unlink()
    queue.run(spark, events, store, checkpoint, outcomes).awaitTermination(60)
    assert asked == [0] and [tuple(r) for r in queue.stored_queue(spark, store).select("path", "attempts").collect()] == [("b", 1)]
    with pytest.raises(ValueError, match="another checkpoint"):
        queue.run(spark, events, store, str(tmp_path / "other"), outcomes)
    add(("c", 3, "enqueue", "C"))
    shutil.rmtree(tmp_path / "store" / "queue" / "published")
    with pytest.raises(Exception, match="version 0 of .* was never published"):
        queue.run(spark, events, store, checkpoint, outcomes).awaitTermination(60)


def test_the_loop_runs_until_it_is_stopped(spark, tmp_path):
    import time

    events, store, checkpoint = (str(tmp_path / x) for x in ("events", "store", "checkpoint"))
    rows = lambda k: spark.createDataFrame([(f"p{k}", k, "enqueue", "T")], queue.LOG).coalesce(1).write.mode("append").parquet(events)
    rows(0)
    running = queue.run(spark, events, store, checkpoint, lambda items, number: None, every="200 milliseconds", keep=2)
    try:
        for k in (1, 2, 3):
            end = time.time() + 60
            while queue.stored_queue(spark, store).count() < k and time.time() < end:
                time.sleep(0.2)
            rows(k)
        while queue.stored_queue(spark, store).count() < 4 and time.time() < end:
            time.sleep(0.2)
    finally:
        running.stop()
    assert sorted(r["path"] for r in queue.stored_queue(spark, store).collect()) == ["p0", "p1", "p2", "p3"]
    assert len(list((tmp_path / "store" / "queue" / "data").iterdir())) <= 3  # older versions are gone


def test_versions(spark, tmp_path):
    from leafwright.versions import Conflict, MissingVersion, Versions

    frame = lambda *ids: spark.createDataFrame([(k,) for k in ids], "id long")
    held = lambda number=None: sorted(r["id"] for r in kept.read(number).collect())
    kept = Versions(spark, str(tmp_path / "state"), frame(1).schema)
    assert held() == [] and kept.numbers() == []
    assert [kept.save(frame(1)), kept.save(frame(1, 2)), kept.save(frame(3))] == [0, 1, 2]
    lost = kept.write(frame(9))  # a writer that dies here changes nothing
    assert held() == [3] and held(1) == [1, 2] and kept.numbers() == [0, 1, 2]
    with pytest.raises(Conflict):
        kept.publish(2, lost)
    assert held(2) == [3]
    kept.publish(3, lost)
    assert held() == [9]
    kept.expire(2)
    assert kept.numbers() == [2, 3] and held(2) == [3]
    with pytest.raises(MissingVersion, match="version 1"):
        kept.read(1)
    kept.write(frame(5))
    kept.sweep()
    assert len(list((tmp_path / "state" / "data").iterdir())) == 2
    (tmp_path / "state" / "data" / lost / "_SUCCESS").unlink()
    with pytest.raises(MissingVersion, match="lost its data"):
        kept.read()


def test_a_vanished_device_ends_the_pass(spark):
    items = spark.createDataFrame([(1, p, k) for k, p in enumerate("abc", 1)], "tick long, path string, pos long")
    outcomes = spark.createDataFrame([(1, "a", True, True, False), (1, "b", True, False, True), (1, "c", True, True, False)], "tick long, path string, exists boolean, pushed boolean, skipped boolean")
    assert {r["path"]: r["result"] for r in state.drained(items, outcomes).collect()} == {"a": "pushed", "b": "failed", "c": "waiting"}


def _epub(path, pages):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/c.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="p{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(pages)))
        z.writestr("O/c.opf", f'<package xmlns="http://www.idpf.org/2007/opf"><manifest>{items}<item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="i0"/></spine></package>')
        z.writestr("O/nav.xhtml", "<p>Not a chapter</p>")
        for k, page in enumerate(pages):
            z.writestr(f"O/p{k}.xhtml", page)


def test_epub_keeps_titles_capitals_and_documents_outside_the_spine(spark, tmp_path):
    from leafwright import api
    from leafwright.operators import segment

    _epub(tmp_path / "b.epub", ["<h1>The Title</h1><p>THIS IS ALL CAPITALS</p><p>Then text. More text.</p>", "<p>Outside of the spine.</p>", "<h1>Empty</h1>"])
    rows = api.read_books(spark, str(tmp_path / "b.epub"))
    units = [(r["chapter_no"], r["title"], r["unit_no"], r["unit"]) for r in segment.book_units(rows).orderBy("chapter_no", "unit_no").collect()]
    assert units == [(1, "The Title", 1, "THIS IS ALL CAPITALS"), (1, "The Title", 2, "Then text."), (1, "The Title", 3, "More text."), (2, "p1", 1, "Outside of the spine.")]
    _epub(tmp_path / "e.epub", ["<h1>No text</h1>"])
    with pytest.raises(ValueError, match="no chapters in e"):
        api.read_books(spark, str(tmp_path / "e.epub"))
    (tmp_path / "e.txt").write_text(" \n\n ")
    with pytest.raises(ValueError, match="no paragraphs"):
        api.read_books(spark, str(tmp_path / "e.txt"))


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from leafwright import scratch

    class Context:
        applicationId, master = "app-1", "spark://host:7077"

        class getConf:
            def get(self, name, default=None):
                return default

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch(Session)


def test_a_books_chapters_pass_through_its_zip_one_by_one():
    import pyarrow as pa

    names = ["book", "kind", "chapter_no", "xhtml", "nav", "ncx", "opf", "blank", "cover"]
    batch = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.string(), pa.int32(), pa.int64(), *[pa.string()] * 4, pa.bool_(), pa.binary()))], names=names)
    alive = []

    def rows():
        import weakref

        yield batch("a", 0, None, None, "n", "x", "o", False, None)
        for k in range(1, 6):
            chapter = batch("a", 1, k, f"chapter {k}" * 1000, *[None] * 5)
            alive.append(weakref.ref(chapter))
            yield chapter
            del chapter
            assert sum(r() is not None for r in alive) <= 1  # the one that is being packed
        yield batch("b", 0, None, None, "n", "x", "o", True, None)
        yield batch("b", 1, 1, "left out", *[None] * 5)

    a, b = (m.to_pylist()[0] for m in render._Zip()(rows()))
    with zipfile.ZipFile(io.BytesIO(a["epub"])) as z:
        assert z.namelist()[0] == "mimetype" and [z.read(f"OEBPS/chapter{k}.xhtml") for k in range(1, 6)] == [f"chapter {k}".encode() * 1000 for k in range(1, 6)]
    assert b == {"book": "b", "status": "refused", "epub": None}


def test_documents_and_paragraphs_are_handed_on_in_pieces():
    rows = ((str(k), k, "n", "x" * 100_000) for k in range(200))
    pieces = list(books._pieces(rows, books._DOCUMENT))
    assert [r for p in pieces for r in p.column(1).to_pylist()] == list(range(200))
    assert len(pieces) > 4 and max(p.nbytes for p in pieces) < books._PIECE + 200_000


def test_a_book_with_several_covers_is_one_file_and_books_dont_mix(spark):
    rows = spark.createDataFrame([(f"b{b}", c, f"t{c}", u, f"u{b}.{c}.{u}", "" if b == 3 and u == 2 else "k") for b in range(12) for c in range(1, 4) for u in (1, 2)], "book string, chapter_no long, title string, unit_no long, unit string, translation string")
    covers = spark.createDataFrame([("b1", b"x"), ("b1", b"y")], "book string, cover binary")
    made = {r["book"]: r for r in render.epubs(rows, covers=covers).collect()}
    assert len(made) == 12 and [b for b, r in made.items() if r["status"] == "refused"] == ["b3"]
    for b in set(made) - {"b3"}:
        with zipfile.ZipFile(io.BytesIO(bytes(made[b]["epub"]))) as z:
            assert [f"u{b[1:]}.{c}.1" in z.read(f"OEBPS/chapter{c}.xhtml").decode() for c in range(1, 4)] == [True] * 3
