"""The engine's services: search, building books, and the state of requests. Everything is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwright.operators import planning, progress, render, search, segment, state
from leafwright.scratch import table
from leafwright.sources import books, files

#: Readers of a source's candidates by its key: (spark, query) to rows of query, pos, title, author and what else there is.
Reader = Callable[[SparkSession, str], DataFrame]


def search_books(spark: SparkSession, query: str, readers: dict[str, Reader], per_source: int = search.PER_SOURCE) -> DataFrame:
    """Merged candidates of the sources that ``query`` is routed to, in their order; a source that fails is left out.

    An unknown source raises KeyError before anything is read.
    """
    routed = spark.createDataFrame([(query,)], "q string").select(search.route(F.col("q")).alias("r")).select("r.*").first()
    asked = [(rank, name, readers[name]) for rank, name in enumerate(routed["sources"])]
    rows = None
    for rank, name, reader in asked:
        try:
            found = reader(spark, routed["query"])
            found.limit(1).count()  # a source that can't be read fails here, not in the merged result
        except Exception as failure:
            spark.sparkContext._jvm.org.apache.logging.log4j.LogManager.getLogger("leafwright").warn(f"source {name} failed: {failure}")
            continue
        found = found.withColumns({"query": F.lit(routed["query"]), "source_rank": F.lit(rank), "source": F.lit(name)})
        rows = found if rows is None else rows.unionByName(found, allowMissingColumns=True)
    if rows is None:
        return spark.createDataFrame([], "query string, pos long, title string, author string, source_rank int, source string")
    return search.merged(rows, per_source)


def build_book(paragraphs: DataFrame, translate: Callable[[str], str], stored: DataFrame | None = None, language: str = "en", proof: bool = False) -> DataFrame:
    """Pairs of ``book, para_no, text`` with translations; stored pairs (with ``source_hash``) that still fit are kept.

    Only windows in which something is missing are asked for. Write the result before using it twice.
    """
    units = table(segment.book_units(paragraphs), "units")
    terms = planning.glossary(planning.term_counts(planning.full_text(units), language=language))
    hashes = planning.fingerprint(units)
    hashes = table(hashes, "hashes")
    if stored is None:
        pairs = units.withColumn("translation", F.lit(""))
    else:
        pairs = progress.resumed(units, stored, hashes)
    open_ = progress.remaining(planning.windows(units), pairs)
    inside = (F.col("unit_no") >= F.col("start")) & (F.col("unit_no") < F.col("start") + F.col("n_units"))
    todo = units.join(open_.select("book", "chapter_no", "start", "n_units"), ["book", "chapter_no"]).where(inside).select(*units.columns, "start")
    # A window is planned again on its own units: the same limits give the same window.
    todo = todo.withColumn("shift", F.col("start") - 1).withColumn("unit_no", F.col("unit_no") - F.col("shift"))
    key = F.concat_ws("\0", "book", F.col("chapter_no").cast("string"), F.col("shift").cast("string"))
    news = progress.translated(todo.select(key.alias("book"), "chapter_no", "title", "unit_no", "unit"), translate, _by_window(terms, todo, key), language, proof)
    part = F.split("book", "\0", -1)
    news = news.select(F.get(part, F.lit(0)).alias("book"), "chapter_no", (F.col("unit_no") + F.get(part, F.lit(2)).cast("long")).alias("unit_no"), F.lit(1).alias("seq"), "translation")
    return progress.merged(pairs, news).join(hashes, "book")


def _by_window(terms: DataFrame, todo: DataFrame, key) -> DataFrame:
    return todo.select("book", key.alias("window")).distinct().join(terms, "book").select(F.col("window").alias("book"), "rank", "term", "rendering")


def publish(pairs: DataFrame, **settings) -> DataFrame:
    """EPUB files of complete books; incomplete ones are refused (``status``)."""
    return render.epubs(pairs, **settings)


def get_status(log: DataFrame, request_id: str) -> DataFrame:
    return state.current(log.where(F.col("id") == request_id), _fields(log))


def list_recent(log: DataFrame, limit: int = 5) -> DataFrame:
    return state.recent(state.current(log, _fields(log)), limit)


def _fields(log: DataFrame) -> list[str]:
    return [c for c in log.columns if c not in ("id", "seq", "cleared")]


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of text or EPUB files by the path's ending; others raise ValueError, and so does a book without text.

    Text gives ``book, para_no, text``, whose chapters are yet to be found; EPUB also ``chapter_no, title``.
    """
    if path.lower().endswith(".epub"):
        return books.epub_paragraphs(spark, path)
    if path.lower().endswith(".txt"):
        found = files.listed(spark, path)
        rows = table(books.text_paragraphs(books.texts_of(files.contents(found))), "paragraphs")
        empty = [r["book"] for r in found.select(files.base_name(F.col("path")).alias("book")).join(rows, "book", "left_anti").limit(5).collect()]
        if empty:
            raise ValueError(f"no paragraphs in {', '.join(empty)}")
        return rows
    raise ValueError(f"unsupported format: {path}")
