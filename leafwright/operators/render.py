"""Rendering books: chapters, navigation, package files and the EPUB itself."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import is_blank, xml_escape
from leafwright.scratch import table
from leafwright.shipping import ship

_HEAD = '<?xml version="1.0" encoding="utf-8"?>'
_XHTML = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
_STYLE = 'body { line-height: 1.6; margin: 0.4em 0.6em; }\np.cp-original { margin-bottom: 0.2em; }\np.cp-translation { margin-bottom: 0.9em; }\n'


# The classes, languages and line heights of a pair's paragraphs.
def paragraph(kind: str, language: Column, text: Column, height: str) -> Column:
    return F.concat(F.lit(f'<p class="{kind}" xml:lang="'), language, F.lit(f'" style="line-height:{height};">'), text, F.lit("</p>"))


def chapters(pairs: DataFrame, source: str = "en", target: str = "ko", escape=xml_escape) -> DataFrame:
    """``book, chapter_no, title, xhtml``: units and translations by turns; empty translations are left out."""
    rows = pairs.select("book", "chapter_no", "title", "unit_no", "translation", escape(F.col("unit")).alias("o"), escape(F.col("translation")).alias("t"), escape(F.col("title")).alias("h"))
    both = F.concat(
        paragraph("cp-original", F.lit(source), F.col("o"), "1.55"),
        F.when(F.coalesce("translation", F.lit("")) == "", F.lit("")).otherwise(paragraph("cp-translation", F.lit(target), F.col("t"), "1.65")),
    )
    rows = rows.groupBy("book", "chapter_no").agg(F.first("title").alias("title"), F.first("h").alias("h"), F.array_sort(F.collect_list(F.struct("unit_no", both.alias("p")))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda x: x["p"]), "")
    opening = F.concat(F.lit(_HEAD + "<!DOCTYPE html>" + _XHTML + '<head><meta charset="utf-8"/><link rel="stylesheet" type="text/css" href="style.css"/><title>'), "h", F.lit("</title></head><body>"))
    heading = F.when(F.col("title") != "", F.concat(F.lit("<h1>"), "h", F.lit("</h1>"))).otherwise("")
    return rows.select("book", "chapter_no", "title", F.concat(opening, heading, body, F.lit("</body></html>")).alias("xhtml"))


def navigation(titles: DataFrame, escape=xml_escape) -> DataFrame:
    """``book, nav, ncx`` lists of ``book, chapter_no, title``."""
    rows = titles.select("book", "chapter_no", escape(F.col("title")).alias("t"))
    no = F.col("chapter_no").cast("string")
    entry = F.concat(F.lit('<li><a href="chapter'), no, F.lit('.xhtml">'), "t", F.lit("</a></li>"))
    point = F.concat(F.lit('<navPoint id="navpoint-'), no, F.lit('" playOrder="'), no, F.lit('"><navLabel><text>'), "t", F.lit('</text></navLabel><content src="chapter'), no, F.lit('.xhtml"/></navPoint>'))
    rows = rows.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("chapter_no", entry.alias("e"), point.alias("p")))).alias("x"))
    return rows.select("book", F.array_join(F.transform("x", lambda x: x["e"]), "\n").alias("nav"), F.array_join(F.transform("x", lambda x: x["p"]), "\n").alias("ncx"))


def package(titles: DataFrame, language: str = "en", stamp: str | None = None, cover: str | None = None, media_type: str = "image/jpeg") -> DataFrame:
    """``book, opf``: manifest and spine of ``book, chapter_no, title, author``; ``stamp`` is the UTC time to state."""
    no = F.col("chapter_no").cast("string")
    item = F.concat(F.lit('<item id="ch'), no, F.lit('" href="chapter'), no, F.lit('.xhtml" media-type="application/xhtml+xml"/>'))
    ref = F.concat(F.lit('<itemref idref="ch'), no, F.lit('"/>'))
    rows = titles.groupBy("book").agg(F.first("author").alias("author"), F.array_sort(F.collect_list(F.struct("chapter_no", item.alias("i"), ref.alias("r")))).alias("x"))
    author = author_or_unknown(F.col("author"))
    ident = F.substring(F.sha2("book", 256), 1, 32)
    when = F.lit(stamp) if stamp else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    pictures = f'<item id="cover-image" href="{cover}" media-type="{media_type}" properties="cover-image"/><item id="cover-page" href="cover.xhtml" media-type="application/xhtml+xml"/>' if cover else ""
    return rows.select("book", F.concat(
        F.lit(f'{_HEAD}<package version="3.0" xml:lang="{language}" xmlns="http://www.idpf.org/2007/opf" unique-identifier="bookid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="bookid">urn:uuid:'),
        ident, F.lit("</dc:identifier><dc:title>"), xml_escape(bilingual_title(F.col("book"))), F.lit("</dc:title><dc:creator>"), xml_escape(author), F.lit(f'</dc:creator><dc:language>{language}</dc:language><meta property="dcterms:modified">'), when,
        F.lit(f'</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="css" href="style.css" media-type="text/css"/>{pictures}'),
        F.array_join(F.transform("x", lambda x: x["i"]), ""), F.lit("</manifest><spine>" + ('<itemref idref="cover-page"/>' if cover else "") + '<itemref idref="nav"/>'), F.array_join(F.transform("x", lambda x: x["r"]), ""), F.lit("</spine></package>"),
    ).alias("opf"))


def author_or_unknown(c: Column) -> Column:
    return F.coalesce(F.when(~is_blank(c), c), F.lit("Unknown"))


def bilingual_title(c: Column) -> Column:
    return F.concat(c, F.lit(" (KO bilingual)"))


class _Zip:
    """EPUB files of sorted rows, a book's own row before those of its chapters; all that is kept of a book is its compressed bytes."""

    def __call__(self, batches):
        book = None
        for batch in batches:
            for k in range(batch.num_rows):
                name, kind, number, xhtml, nav, ncx, opf, blank, cover = (c[k].as_py() for c in batch.columns)
                if kind == 0:
                    if book is not None:
                        yield self.closed(book)
                    book = self.opened(name, nav, ncx, opf, blank, cover)
                elif book["zip"] is not None:
                    self.put(book["zip"], f"OEBPS/chapter{number}.xhtml", xhtml)
        if book is not None:
            yield self.closed(book)

    @staticmethod
    def put(z: zipfile.ZipFile, name: str, data, how: int = zipfile.ZIP_DEFLATED) -> None:
        z.writestr(zipfile.ZipInfo(name), data, compress_type=how)

    def opened(self, name, nav, ncx, opf, blank, cover) -> dict:
        if blank:
            return {"book": name, "zip": None}
        bytes_ = io.BytesIO()
        z = zipfile.ZipFile(bytes_, "w", zipfile.ZIP_DEFLATED)
        self.put(z, "mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        self.put(z, "META-INF/container.xml", _HEAD + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        if cover is not None:
            self.put(z, "OEBPS/cover.jpg", cover)
            self.put(z, "OEBPS/cover.xhtml", _HEAD + "<!DOCTYPE html>" + _XHTML + '<head><title>Cover</title></head><body><div><img src="cover.jpg" alt="cover"/></div></body></html>')
        return {"book": name, "zip": z, "bytes": bytes_, "nav": nav, "ncx": ncx, "opf": opf}

    def closed(self, book: dict) -> pa.RecordBatch:
        done = None
        if (z := book["zip"]) is not None:
            self.put(z, "OEBPS/nav.xhtml", _HEAD + "<!DOCTYPE html>" + _XHTML + f'<head><title>Contents</title></head><body><nav epub:type="toc" id="toc"><h1>Contents</h1><ol>{book["nav"]}</ol></nav></body></html>')
            self.put(z, "OEBPS/toc.ncx", _HEAD + f'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><navMap>{book["ncx"]}</navMap></ncx>')
            self.put(z, "OEBPS/style.css", _STYLE)
            self.put(z, "OEBPS/content.opf", book["opf"])
            z.close()
            done = book["bytes"].getbuffer()
        return pa.RecordBatch.from_arrays([pa.array([book["book"]], pa.string()), pa.array(["refused" if done is None else "written"]), pa.array([done], pa.binary())], names=["book", "status", "epub"])


def epubs(pairs: DataFrame, source: str = "en", target: str = "ko", stamp: str | None = None, covers: DataFrame | None = None) -> DataFrame:
    """``book, status, epub``: the zip of each complete book; one with a blank translation is refused and has none.

    ``pairs`` has ``book, chapter_no, title, unit_no, unit, translation`` and may have ``author``. A book's chapters
    go through one task one by one, in order, and what is kept of them is the compressed file, which is one value;
    books are independent. Of several covers of a book one is taken.
    """
    pairs = table(pairs.where("book is not null"), "pairs")  # four groupings read it
    author = "author" if "author" in pairs.columns else None
    titles = pairs.groupBy("book", "chapter_no").agg(F.first("title").alias("title"), (F.first(author) if author else F.lit(None).cast("string")).alias("author"))
    blank = pairs.groupBy("book").agg((F.count_if(is_blank(F.col("translation"))) > 0).alias("blank"))
    heads = navigation(titles).join(package(titles, source, stamp, "cover.jpg" if covers is not None else None), "book").join(blank, "book")
    heads = heads.join(covers.groupBy("book").agg(F.min("cover").alias("cover")), "book", "left") if covers is not None else heads.withColumn("cover", F.lit(None).cast("binary"))
    texts = chapters(pairs, source, target)
    rows = heads.withColumn("kind", F.lit(0)).unionByName(texts.select("book", F.lit(1).alias("kind"), "chapter_no", "xhtml"), allowMissingColumns=True)
    ship(pairs.sparkSession)
    # Dealt by a hash, which neither side is dealt by: Spark leaves the shuffle out where it takes a union's sides to be dealt alike.
    rows = rows.repartition(F.xxhash64("book")).sortWithinPartitions("book", "kind", "chapter_no")
    return rows.select("book", "kind", "chapter_no", "xhtml", "nav", "ncx", "opf", "blank", "cover").mapInArrow(_Zip(), "book string, status string, epub binary")
