"""Payloads of catalogues and searches as rows; fetching them is not part of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafwright.functions.replies import stringified_json
from leafwright.functions.text import strip

PAGE = "struct<next:string,results:array<struct<id:bigint,title:string,authors:array<struct<name:string>>,languages:array<string>,copyright:boolean,formats:map<string,string>>>>"
# Formats in the order of preference.
FORMATS = ["text/plain; charset=utf-8", "text/plain; charset=us-ascii", "text/html; charset=utf-8", "application/epub+zip"]


def rights(copyright: Column) -> Column:
    """False, true and unknown."""
    return F.when(copyright == F.lit(False), "public domain").when(copyright, "copyright").otherwise("unknown")


def preferred(formats: Column) -> Column:
    """The address of the best format that has one."""
    return F.coalesce(*[F.nullif(F.try_element_at(formats, F.lit(f)), F.lit("")) for f in FORMATS])


def catalogue(pages: DataFrame, limit: int = 8) -> DataFrame:
    """Candidates of ``query, page_no, body`` (JSON pages in order), the first ``limit`` of each query."""
    rows = pages.select("query", "page_no", F.posexplode(F.from_json("body", PAGE)["results"]).alias("pos", "b"))
    place = F.row_number().over(W.partitionBy("query").orderBy("page_no", "pos"))
    rows = rows.withColumn("pos", place.cast("long")).where(F.col("pos") <= limit)
    names = F.array_join(F.transform("b.authors", lambda a: F.coalesce(a["name"], F.lit(""))), ", ")
    return rows.select(
        "query", "pos", F.lit("gutenberg").alias("source"), F.col("b.id").cast("string").alias("source_id"), strip(F.coalesce("b.title", F.lit(""))).alias("title"),
        F.coalesce(names, F.lit("")).alias("author"), F.coalesce(F.get("b.languages", F.lit(0)), F.lit("en")).alias("language"), rights(F.col("b.copyright")).alias("rights"), preferred(F.col("b.formats")).alias("fetch_url"),
    )


def links(pages: DataFrame) -> DataFrame:
    """``query, pos, href, text`` of the anchors of ``query, html``, in order."""
    anchor = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(anchor), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(anchor), F.lit(2)).alias("inner"))
    rows = pages.select("query", F.posexplode(pairs).alias("pos", "a"))
    text = strip(F.regexp_replace(F.regexp_replace(F.col("a.inner"), r"<[^>]*>", " "), r"(?U)\s+", " "))
    return rows.select("query", F.col("pos").cast("long").alias("pos"), F.col("a.href").alias("href"), text.alias("text"))


def book_links(pages: DataFrame, base: str, limit: int = 8) -> DataFrame:
    """Candidates of a result page: the first link with text of each path of the form /ebooks/author/title."""
    path = F.regexp_extract("href", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    rows = links(pages).withColumn("path", path).withColumn("parts", F.filter(F.split(F.col("path"), "/", -1), lambda s: s != ""))
    rows = rows.where(F.col("href").contains("/ebooks/") & F.col("path").startswith("/ebooks/") & (F.size("parts") == 3) & (F.col("text") != ""))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("query", "path").orderBy("pos"))).where("n = 1")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("query").orderBy("pos")).cast("long")).where(F.col("pos") <= limit)
    return rows.select(
        "query", "pos", F.lit("standard_ebooks").alias("source"), F.get("parts", F.lit(2)).alias("source_id"), F.substring("text", 1, 200).alias("title"),
        F.initcap(F.replace(F.get("parts", F.lit(1)), F.lit("-"), F.lit(" "))).alias("author"), F.lit("en").alias("language"), F.lit("public domain").alias("rights"), F.concat(F.lit(base), "path").alias("fetch_url"),
    )


def epub_link(pages: DataFrame, base: str) -> DataFrame:
    """``query, url``: the first plain ``.epub`` link of a page; relative ones are made absolute."""
    plain = F.col("href").endswith(".epub") & ~F.col("href").contains("advanced") & ~F.col("href").contains("kepub")
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), "href")).otherwise(F.col("href"))
    return links(pages).where(plain).groupBy("query").agg(F.min_by(url, "pos").alias("url"))


def event_messages(bodies: DataFrame) -> DataFrame:
    """``id, pos, message`` of ``id, content_type, body``: JSON after ``data:`` of an event stream, or the body itself."""
    stream = F.filter(F.split(F.regexp_replace("body", r"\r\n?", "\n"), "\n", -1), lambda line: line.startswith("data:"))
    texts = F.when(F.col("content_type").contains("text/event-stream"), F.transform(stream, lambda line: strip(F.substr(line, F.lit(6))))).otherwise(F.array("body"))
    rows = bodies.select("id", F.posexplode(texts).alias("pos", "message"))
    return rows.where(F.expr("is_valid_utf8(message) and try_parse_json(message) is not null")).select("id", F.col("pos").cast("long").alias("pos"), "message")


def search_hits(results: DataFrame, count: int = 5) -> DataFrame:
    """``id, pos, title, link, content`` of ``id, text``: a list, or an object's ``results`` or ``data``; text may be JSON twice."""
    hit = "array<struct<title:string,link:string,content:string>>"
    once = stringified_json(F.col("text"))
    boxed = F.from_json(once, f"struct<results:{hit},data:{hit}>")
    listed = F.when(strip(once).startswith("["), F.from_json(once, hit)).otherwise(F.coalesce(F.when(F.size(boxed["results"]) > 0, boxed["results"]), boxed["data"]))
    kept = F.slice(F.filter(listed, lambda h: h.isNotNull()), 1, count)
    rows = results.select("id", F.posexplode(kept).alias("pos", "h"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.select("id", (F.col("pos") + 1).cast("long").alias("pos"), empty(F.col("h.title")).alias("title"), empty(F.col("h.link")).alias("link"), empty(F.col("h.content")).alias("content"))


def best_cover(offers: DataFrame, least: int = 1024) -> DataFrame:
    """``book, url`` of ``book, rank, status, bytes, content_type, url``: the first acceptable picture by rank."""
    fine = (F.col("status") == 200) & (F.col("bytes") > least) & F.col("content_type").startswith("image/")
    return offers.where(fine).groupBy("book").agg(F.min_by("url", "rank").alias("url"))


# Sizes of a cover from the best to the least.
COVER_SIZES = ["extraLarge", "large", "medium", "thumbnail", "smallThumbnail", "L", "M", "S"]


def cover_offers(links: DataFrame) -> DataFrame:
    """``book, rank, url`` of ``book, pos, sizes`` (a map of sizes to addresses): hit by hit, the best size first."""
    rows = links.select("book", "pos", F.explode("sizes").alias("size", "url")).where(F.coalesce("url", F.lit("")) != "")
    size = F.array_position(F.array(*map(F.lit, COVER_SIZES)), F.col("size"))
    order = W.partitionBy("book").orderBy("pos", F.when(size > 0, size).otherwise(len(COVER_SIZES) + 1), "size")
    return rows.select("book", F.row_number().over(order).cast("long").alias("rank"), "url")


def call_results(messages: DataFrame, call_id: int = 2) -> DataFrame:
    """``id, result`` (JSON) of ``id, pos, message``: the first message that answers call ``call_id`` with a result."""
    rows = messages.select("id", "pos", F.get_json_object("message", "$.id").alias("call"), F.get_json_object("message", "$.result").alias("result"))
    return rows.where((F.col("call") == str(call_id)) & F.col("result").isNotNull()).groupBy("id").agg(F.min_by("result", "pos").alias("result"))


def environment(lines: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """``key, value`` of ``pos, line`` in the form KEY=VALUE: blanks and comments are skipped, the first line of a key counts.

    Quotes around a value go. Keys of ``present`` (``key``) keep their values there and are left out.
    """
    line = strip(F.col("line"))
    rows = lines.select("pos", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#") & F.contains("line", F.lit("=")))
    at = F.instr("line", "=")
    value = strip(F.substr("line", at + 1, F.length("line")))
    bare = F.regexp_replace(F.regexp_replace(value, r'^"+|"+$', ""), r"^'+|'+$", "")
    rows = rows.select("pos", strip(F.substr("line", F.lit(1), at - 1)).alias("key"), bare.alias("value")).groupBy("key").agg(F.min_by("value", "pos").alias("value"))
    return rows if present is None else rows.join(present.select("key"), "key", "left_anti")


def distinct_hosts(hosts: DataFrame) -> DataFrame:
    """``pos, host``: each host once, at its first place."""
    return hosts.groupBy("host").agg(F.min("pos").alias("pos")).select("pos", "host")


def hash_links(pages: DataFrame, base: str = "", limit: int = 8) -> DataFrame:
    """Candidates of the links to ``/md5/`` pages of ``query, html``: the first ``limit`` links of each query, in order.

    A hash is any run of hexadecimal digits. A link's text is its title (160 characters), and names the author after
    the word *by*, or after a hyphen where a comma or space and a year follow; else the author is unknown. A link
    without text is named after its hash. A hash that is linked twice is two candidates.
    """
    found = F.lower(F.regexp_extract("href", r"/md5/([0-9a-fA-F]+)", 1))
    rows = links(pages).withColumn("hash", found).where(F.col("hash") != "")
    rows = rows.withColumn("pos", F.row_number().over(W.partitionBy("query").orderBy("pos")).cast("long")).where(F.col("pos") <= limit)
    # Fixed pattern: where a label names its author.
    named = r"\bby\b\s+(.+?)$|-\s*([^,]+?),?\s*(\d{4})"
    author = F.coalesce(*[F.nullif(F.regexp_extract("text", named, k), F.lit("")) for k in (1, 2)], F.lit("Unknown"))
    title = F.when(F.col("text") == "", F.concat(F.lit("anna-"), F.substring("hash", 1, 8))).otherwise(F.col("text"))
    return rows.select(
        "query", "pos", F.lit("annas_archive").alias("source"), F.col("hash").alias("source_id"), F.substring(title, 1, 160).alias("title"), strip(author).alias("author"),
        F.lit("en").alias("language"), F.lit("unknown (user responsibility)").alias("rights"), F.concat(F.lit(base), F.lit("/md5/"), "hash").alias("fetch_url"),
    )
