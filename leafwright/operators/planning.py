"""Planning work on units: windows, context, fingerprints and glossaries."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafwright.operators import chains
from leafwright.shipping import ship

#: Limits of a window.
MOST_UNITS, MOST_CHARS, CONTEXT_UNITS = 20, 2200, 3
#: Terms of a glossary: how often a term must occur, how many are kept, how many go into a request.
LEAST_COUNT, MOST_TERMS, REQUEST_TERMS = 3, 30, 20
#: Terms of a book that are searched for, and hits of each that are quoted.
GROUNDED_TERMS, GROUNDED_HITS = 8, 3

# Capitalised English words that aren't names.
STOPWORDS = (
    "The A An And Or But Nor For Yet So In On At To Of With By From Up Down Out Off Over Under Again Further Then Once Here There "
    "When Where Why How All Any Both Each Few More Most Other Some Such No Not Only Own Same Than Too Very Can Will Just Should Now "
    "I You He She It We They Me Him Her Us Them My Your His Its Our Their This That These Those What Which Who Whom Whose Whichever "
    "Whoever Whomever Is Am Are Was Were Be Been Being Have Has Had Do Does Did Shall Would May Might Must Could Ought "
    "Mr Mrs Ms Miss Dr Sir Madam Lord Lady King Queen Prince Princess Captain Major General Colonel Father Mother Brother Sister Uncle "
    "Aunt Cousin Son Daughter Child Children Man Woman Boy Girl God Jesus Christ Heaven Hell "
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday "
    "January February March April June July August September October November December Spring Summer Autumn Winter "
    "North South East West Yes Oh Ah Eh Well Still Even Ever Never Always Often Sometimes However Therefore Moreover Meanwhile Besides "
    "Nevertheless Nonetheless Indeed Perhaps Probably Possibly Certainly Surely Truly Really Chapter Book Part Section "
    "One Two Three Four Five Six Seven Eight Nine Ten First Second Third Fourth Fifth Sixth Seventh Eighth Ninth Tenth"
).split()
#: The language whose terms are found by their capitals; other languages have no terms.
TERM_LANGUAGE = "en"


def windows(rows: DataFrame, most_units: int = MOST_UNITS, most_chars: int = MOST_CHARS) -> DataFrame:
    """``book, chapter_no, start, n_units, n_chars, texts``: units packed in order within both limits.

    A unit that is too long alone is a window of its own. ``start`` is the number of the window's first unit. A chapter
    may be larger than a task (see ``chains``). The units are written once (this runs a job).
    """
    return chains.windows(rows, most_units, most_chars)


def context_before(rows: DataFrame, n: int = CONTEXT_UNITS) -> DataFrame:
    """``book, chapter_no, unit_no, context``: the ``n`` units before each in its chapter; null where there is none."""
    frame = W.partitionBy("book", "chapter_no").orderBy("unit_no").rowsBetween(-n, -1)
    found = F.collect_list("unit").over(frame)
    return rows.select("book", "chapter_no", "unit_no", F.when(F.size(found) > 0, found).alias("context"))


class _Fingerprints:
    """SHA-1 of each book of a sorted partition; a hash object is all that is kept of a book."""

    def __call__(self, batches):
        book, chapter, state = None, None, None
        said = lambda x: (x or "").encode("utf-8", "surrogatepass") + b"\0"
        for batch in batches:
            done = []
            for name, number, title, unit in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or name != book:
                    if state is not None:
                        done.append((book, state.hexdigest()))
                    book, chapter, state = name, None, hashlib.sha1()
                if number != chapter:
                    chapter = number
                    state.update(said(title))
                state.update(said(unit))
            yield self.rows(done)
        if state is not None:
            yield self.rows([(book, state.hexdigest())])

    @staticmethod
    def rows(done: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], names=["book", "source_hash"])


def fingerprint(rows: DataFrame) -> DataFrame:
    """``book, source_hash``: SHA-1 over each chapter's title and units in order, each ended by NUL.

    A digest is a fold over a book from its beginning to its end, so a book is read by one task, but as a stream: its
    size doesn't matter. A chapter's title is that of its first unit; null titles and units count as empty.
    """
    ship(rows.sparkSession)
    order = ["book", "chapter_no", "unit_no"]
    streams = rows.select(F.col("book").cast("string").alias("book"), "chapter_no", "unit_no", "title", "unit").repartition("book").sortWithinPartitions(*order)
    return streams.select("book", "chapter_no", "title", "unit").mapInArrow(_Fingerprints(), "book string, source_hash string")


def full_text_parts(rows: DataFrame, units: int = 1000) -> DataFrame:
    """``book, chapter_no, part_no, text``: a book's full text in pieces, to be read in order without anything between.

    A chapter's title and units are a line each and a blank line parts chapters. A piece has ``units`` units at most
    (``unit_no`` counts from 1 in each chapter; the first piece, 0, has the title), so no book or chapter is one value.
    """
    part = F.floor((F.col("unit_no") - 1) / units).cast("long")
    pieces = rows.groupBy("book", "chapter_no", part.alias("part_no")).agg(F.first("title").alias("title"), F.transform(F.array_sort(F.collect_list(F.struct("unit_no", "unit"))), lambda x: x["unit"]).alias("u"))
    firsts = rows.groupBy("book").agg(F.min("chapter_no").alias("first_no"))
    gap = F.when(F.col("chapter_no") == F.col("first_no"), F.lit("")).otherwise(F.lit("\n\n"))
    head = F.when(F.col("part_no") == 0, F.concat(gap, "title", F.lit("\n"))).otherwise(F.lit("\n"))
    return pieces.join(firsts, "book").select("book", "chapter_no", "part_no", F.concat(head, F.array_join("u", "\n")).alias("text"))


def full_text(rows: DataFrame) -> DataFrame:
    """``book, text``: chapters with a blank line between, each its title and a line for each unit.

    One value for a book, so books must be below 2 GB; ``full_text_parts`` has no such bound.
    """
    parts = full_text_parts(rows)
    return parts.groupBy("book").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", "part_no", "text"))), lambda x: x["text"]), "").alias("text"))


_SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"
_TERM = r"(?U)\b([A-Z][a-z]{2,}(?:\s+[A-Z][a-z]{2,}){0,2})\b"


def _uncommon(stopwords: list[str] | None) -> Column:
    common = F.array(*map(F.lit, STOPWORDS if stopwords is None else stopwords))
    return ~F.forall(F.split("term", r"(?U)\s+", -1), lambda w: F.array_contains(common, w))


def term_counts(rows: DataFrame, text: str = "text", stopwords: list[str] | None = None, language: str = TERM_LANGUAGE) -> DataFrame:
    """``book, term, n``: capitalised phrases of one to three words, sentence by sentence, unless all words are common.

    Capitals say this of English only: texts in another ``language`` have no terms.
    """
    pieces = rows.where(F.lit(language == TERM_LANGUAGE)).select("book", F.explode(F.split(F.col(text), _SENTENCE_GAP, -1)).alias("sentence"))
    terms = pieces.select("book", F.explode(F.regexp_extract_all("sentence", F.lit(_TERM), F.lit(1))).alias("term"))
    return terms.where(_uncommon(stopwords)).groupBy("book", "term").agg(F.count(F.lit(1)).alias("n"))


def first_contexts(rows: DataFrame, order: list[str], text: str = "text", around: int = 30, stopwords: list[str] | None = None) -> DataFrame:
    """``book, term, context``: a few characters around a term in the first sentence that has it, by ``order``."""
    from leafwright.functions.text import strip

    pieces = rows.select("book", *order, F.posexplode(F.split(F.col(text), _SENTENCE_GAP, -1)).alias("pos", "sentence"))
    # A match begins after the gaps up to it and the matches before it.
    parts = pieces.withColumns({"terms": F.regexp_extract_all("sentence", F.lit(_TERM), F.lit(1)), "gaps": F.split("sentence", _TERM, -1)}).where(F.size("terms") > 0)
    length = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda acc, x: acc + F.length(x))
    found = parts.select("*", F.posexplode("terms").alias("k", "term")).where(_uncommon(stopwords))
    found = found.withColumn("at", length("gaps", F.col("k") + 1) + length("terms", F.col("k")) + 1)
    cut = strip(F.substr("sentence", F.greatest(F.col("at") - around, F.lit(1)), F.length("term") + around + F.least(F.col("at") - 1, F.lit(around))))
    return found.groupBy("book", "term").agg(F.min_by(cut, F.struct(*order, "pos", "k")).alias("context"))


def glossary(counts: DataFrame, least: int = LEAST_COUNT, most: int = MOST_TERMS) -> DataFrame:
    """``book, rank, term, n, rendering``: the most frequent terms of a book, each to be rendered consistently."""
    rank = F.row_number().over(W.partitionBy("book").orderBy(F.desc("n"), "term"))
    rows = counts.where(F.col("n") >= least).withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)
    return rows.select("book", "rank", "term", "n", F.concat(F.lit("<CONSISTENT:"), "term", F.lit(">")).alias("rendering"))


def enriched(terms: DataFrame, replies: DataFrame, chunk: int = REQUEST_TERMS) -> DataFrame:
    """Glossary rows with renderings from ``replies`` (``book, chunk_no, reply``), where a reply answers the term."""
    from leafwright.functions.replies import lenient_json
    from leafwright.functions.text import is_blank

    asked = terms.withColumn("chunk_no", F.floor((F.col("rank") - 1) / chunk))
    answers = replies.select("book", "chunk_no", lenient_json(F.col("reply")).alias("answers"))
    rows = asked.join(answers, ["book", "chunk_no"], "left")
    answer = F.when(F.col("answers").isNotNull(), F.try_element_at("answers", F.col("term")))
    return rows.select("book", "rank", "term", "n", F.when(~is_blank(answer), answer).otherwise(F.col("rendering")).alias("rendering"))


def grounding(terms: DataFrame, titles: DataFrame | None = None, top: int = GROUNDED_TERMS) -> DataFrame:
    """``book, rank, term, query``: what to search for, for the ``top`` most frequent terms of a book."""
    from leafwright.functions.replies import grounding_query

    rows = terms.where(F.col("rank") <= top)
    rows = rows.join(titles.select("book", F.col("title").alias("_title")), "book", "left") if titles is not None else rows.withColumn("_title", F.lit(None).cast("string"))
    return rows.select("book", "rank", "term", grounding_query(F.col("term"), F.col("_title")).alias("query"))


def snippets(asked: DataFrame, hits: DataFrame, most: int = GROUNDED_HITS) -> DataFrame:
    """``book, snippets``: lines ``[term] title content`` of the first ``most`` hits (``query, pos, title, content``) of each term."""
    from leafwright.functions.text import strip

    rows = asked.join(hits.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy("pos"))).where(F.col("n") <= most), "query")
    said = strip(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))
    rows = rows.withColumn("said", said).where("said <> ''")
    line = F.concat(F.lit("["), "term", F.lit("] "), "said")
    return rows.groupBy("book").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n", line.alias("line")))), lambda x: x["line"]).alias("snippets"))  # top x most lines a book


def rendered(terms: DataFrame, function, hits: DataFrame | None = None, titles: DataFrame | None = None, chunk: int = REQUEST_TERMS) -> DataFrame:
    """Glossary rows with renderings of an injected model, asked once for each ``chunk`` terms of a book.

    With search ``hits`` (``query, pos, title, content``) the snippets of the most frequent terms are part of each
    request. Terms that a reply doesn't answer, and chunks whose call fails, keep what they had. This runs a job that
    calls the model.
    """
    from leafwright.functions.replies import enrichment_request
    from leafwright.operators.progress import called
    from leafwright.scratch import table

    chunks = terms.withColumn("chunk_no", F.floor((F.col("rank") - 1) / chunk))
    chunks = chunks.groupBy("book", "chunk_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda t: t["term"]).alias("asked"))
    none = F.array().cast("array<string>")
    chunks = chunks.join(snippets(grounding(terms, titles), hits), "book", "left") if hits is not None else chunks.withColumn("snippets", none)
    asked = called(chunks.select("book", "chunk_no", enrichment_request(F.col("asked"), F.coalesce("snippets", none)).alias("request")), "request", function, "reply", attempts=1)
    return enriched(terms, table(asked.select("book", "chunk_no", "reply"), "renderings"), chunk)
