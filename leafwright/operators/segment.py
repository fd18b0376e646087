"""From paragraphs to chapters of units: headings, front matter and oversize chapters.

All operators take and return long tables, one row for a paragraph or unit, with explicit order columns. Paragraphs
and units are numbered by running sums over range partitions (``scan``), so a book or chapter may be larger than a
task; windows hold a row for each chapter of a book only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafwright.functions.text import CHAPTER_CAP, CREDIT_TITLE, FRONT_MATTER_UNITS, TITLE_LENGTH, is_heading, sentences
from leafwright.operators.scan import running


def units(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``unit_no`` from 1, ``unit``: the sentences of each row."""
    return rows.select(*keys, F.posexplode(sentences(F.col(text))).alias("pos", "unit")).select(*keys, (F.col("pos") + 1).cast("long").alias("unit_no"), "unit")


def _chaptered(paragraphs: DataFrame, keep_preface: bool) -> tuple[DataFrame, DataFrame]:
    """Paragraphs with their ``chapter_no, units`` and how many units came before, and ``book, chapter_no, title, n, start``.

    A book of which no chapter has text is chapter 1, of all its paragraphs, headings too; ``whole`` says so, ``n`` and
    ``start`` are in units.
    """
    rows = paragraphs.select("book", "para_no", "text")
    also = {"heading": is_heading(F.col("text")), "units": sentences(F.col("text"))}
    size = F.size("units")
    rows = running(rows, ["book"], ["para_no"], {"chapter_no": F.col("heading").cast("int"), "upto": F.when(F.col("heading"), 0).otherwise(size), "upto_all": size}, also)
    low = 0 if keep_preface else 1
    text = ~F.col("heading")
    chapters = rows.groupBy("book", "chapter_no").agg(
        F.max(F.when(F.col("heading"), F.col("text"))).alias("heading"), F.count_if(text).alias("paras"), F.sum(F.when(text, size).otherwise(0)).alias("n"), F.min(F.col("upto") - F.when(text, size).otherwise(0)).alias("start"), F.sum(size).alias("n_all")
    )
    mine = W.partitionBy("book")
    chapters = chapters.withColumn("whole", F.sum(F.when(F.col("chapter_no") >= low, F.col("paras")).otherwise(0)).over(mine) == 0).withColumn("n_all", F.sum("n_all").over(mine))
    title = F.when(F.col("whole"), "Untitled").when(F.col("chapter_no") == 0, "Preface").otherwise(F.substring("heading", 1, TITLE_LENGTH))
    kept = chapters.where("whole or (paras > 0 and chapter_no >= %d)" % low)
    return rows, kept.select("book", F.col("chapter_no").alias("old_no"), F.when(F.col("whole"), F.lit(1).cast("long")).otherwise(F.col("chapter_no")).alias("chapter_no"), title.alias("title"), F.when(F.col("whole"), F.col("n_all")).otherwise(F.col("n")).alias("n"), F.when(F.col("whole"), 0).otherwise(F.col("start")).alias("start"), "whole")


def _placed(rows: DataFrame, chapters: DataFrame) -> DataFrame:
    """Paragraphs beside the chapter they are in; a heading is in none unless its book has no other text."""
    return rows.withColumnRenamed("chapter_no", "old_no").join(chapters, ["book", "old_no"]).where("whole or not heading")


def bucketed(paragraphs: DataFrame, keep_preface: bool = False) -> DataFrame:
    """``book, chapter_no, title, para_no, text`` of ``book, para_no, text``: a heading opens a chapter.

    Chapter 0 is what stands before the first heading; unless ``keep_preface`` it is dropped where the book has
    headings with text after them. A book without such chapters is one chapter, *Untitled*, of all its paragraphs.
    Rows without a book are dropped. The paragraphs are written once (this runs a job).
    """
    rows, chapters = _chaptered(paragraphs, keep_preface)
    return _placed(rows, chapters).select("book", "chapter_no", "title", "para_no", "text")


def chapter_units(chapters: DataFrame) -> DataFrame:
    """``book, chapter_no, title, unit_no, unit``: sentences of the chapters' paragraphs, numbered within the chapter.

    The paragraphs are written once (this runs a job).
    """
    rows = running(chapters.select("book", "chapter_no", "title", "para_no", "text"), ["book", "chapter_no"], ["para_no"], {"upto": F.size("units")}, {"units": sentences(F.col("text"))})
    rows = rows.select("book", "chapter_no", "title", (F.col("upto") - F.size("units")).alias("before"), F.posexplode("units").alias("pos", "unit"))
    return rows.select("book", "chapter_no", "title", (F.col("before") + F.col("pos") + 1).alias("unit_no"), "unit")


def _sizes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("book", "chapter_no").agg(F.count(F.lit(1)).alias("n"), F.first("title").alias("title"))


def _merged(sizes: DataFrame) -> DataFrame:
    """``book, chapter_no, title, n`` with ``new_no, new_title`` of the chapter each one becomes part of and units ``ahead`` of it there."""
    order = W.partitionBy("book").orderBy("chapter_no")
    total = F.sum("n").over(order)
    rows = sizes.withColumn("ahead", total - F.col("n")).withColumn("stays", ~F.col("title").rlike(CREDIT_TITLE) & (total > FRONT_MATTER_UNITS))
    mine = W.partitionBy("book")
    rows = rows.withColumn("stop", F.coalesce(F.min(F.when(F.col("stays"), F.col("chapter_no"))).over(mine), F.max("chapter_no").over(mine)))
    rows = rows.withColumn("stop_title", F.max(F.when(F.col("chapter_no") == F.col("stop"), F.col("title"))).over(mine))
    into = F.col("chapter_no") <= F.col("stop")
    return rows.select("book", "chapter_no", "n", F.greatest("chapter_no", "stop").alias("new_no"), F.when(into, F.col("stop_title")).otherwise(F.col("title")).alias("new_title"), F.when(into, F.col("ahead")).otherwise(0).alias("ahead"))


def _parted(sizes: DataFrame, cap: int) -> DataFrame:
    """``book, chapter_no, n`` with ``parts`` of each chapter and how many parts come ``earlier`` in the book."""
    parts = F.ceil(F.col("n") / cap)
    return sizes.withColumn("parts", parts).withColumn("earlier", F.coalesce(F.sum(parts).over(W.partitionBy("book").orderBy("chapter_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def _split(rows: DataFrame, cap: int) -> DataFrame:
    """Final chapters of units beside their chapter's ``parts`` and ``earlier``."""
    rows = rows.withColumn("part", F.floor((F.col("unit_no") - 1) / cap))
    named = F.when(F.col("parts") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" (Part "), (F.col("part") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit(")")))
    return rows.select("book", (F.col("earlier") + F.col("part") + 1).cast("long").alias("chapter_no"), named.alias("title"), (F.col("unit_no") - F.col("part") * cap).cast("long").alias("unit_no"), "unit")


def front_matter_merged(rows: DataFrame) -> DataFrame:
    """Chapters merged into the next one while the first is credits or has few units, counting what was merged.

    The first chapter that stays is the first whose title is not a credit and up to which there are more than
    eight units, or else the last; all chapters before it become part of it, under its title. ``rows`` is read twice.
    """
    plan = _merged(_sizes(rows)).drop("n")
    rows = rows.join(plan, ["book", "chapter_no"])
    return rows.select("book", F.col("new_no").alias("chapter_no"), F.col("new_title").alias("title"), (F.col("ahead") + F.col("unit_no")).cast("long").alias("unit_no"), "unit")


def oversize_split(rows: DataFrame, cap: int = CHAPTER_CAP) -> DataFrame:
    """Chapters of more than ``cap`` units in parts, ``title (Part j/n)``; chapters are numbered anew from 1. ``rows`` is read twice."""
    plan = _parted(_sizes(rows).drop("title"), cap).drop("n")
    return _split(rows.join(plan, ["book", "chapter_no"]), cap)


def book_units(paragraphs: DataFrame, keep_preface: bool = False, cap: int = CHAPTER_CAP) -> DataFrame:
    """From ``book, para_no, text`` to units of final chapters; paragraphs that have chapters (``chapter_no, title``) keep them as they are.

    The four steps above at once: paragraphs are numbered in one scan and written, what becomes of a chapter is told
    from the chapters' sizes. This runs a job.
    """
    if "chapter_no" in paragraphs.columns:
        return chapter_units(paragraphs)
    rows, chapters = _chaptered(paragraphs, keep_preface)
    sizes = chapters.groupBy("book", "chapter_no").agg(F.first("title").alias("title"), F.first("n").alias("n")).where("n > 0")
    plan = _merged(sizes)
    final = _parted(plan.groupBy("book", F.col("new_no").alias("chapter_no")).agg(F.sum("n").alias("n")), cap).select("book", F.col("chapter_no").alias("new_no"), "parts", "earlier")
    plan = chapters.select("book", "old_no", "chapter_no", "start", "whole").join(plan.drop("n").join(final, ["book", "new_no"]), ["book", "chapter_no"])
    rows = _placed(rows, plan)
    before = F.when(F.col("whole"), F.col("upto_all") - F.size("units")).otherwise(F.col("upto") - F.size("units") - F.col("start"))
    rows = rows.select("book", F.col("new_title").alias("title"), "parts", "earlier", (F.col("ahead") + before).alias("before"), F.posexplode("units").alias("pos", "unit"))
    return _split(rows.withColumn("unit_no", F.col("before") + F.col("pos") + 1), cap)
