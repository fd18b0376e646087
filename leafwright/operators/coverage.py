"""Symbol coverage: the distinct code points of texts, and which font to use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.functions.text import language_base


def code_points(texts: DataFrame, column: str = "text", always: bool = True) -> DataFrame:
    """``cp``: the distinct code points of a column; with ``always`` also printable ASCII and the replacement character.

    Each row gives its own distinct characters, and each task a bitmap for each 32,768 code points it has met, of
    which there are 35: that is all that is shuffled, however many texts there are.
    """
    own = texts.select(F.explode(F.array_distinct(F.split(F.col(column), ""))).alias("ch")).where("ch <> ''").select(F.ascii("ch").cast("long").alias("cp"))
    if always:
        spark = texts.sparkSession
        own = own.unionByName(spark.range(0x20, 0x7F).select(F.col("id").alias("cp"))).unionByName(spark.range(0xFFFD, 0xFFFE).select(F.col("id").alias("cp")))
    maps = own.groupBy(F.bitmap_bucket_number("cp").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cp")).alias("bits"))
    octets = maps.select("bucket", F.posexplode(F.split(F.regexp_replace(F.hex("bits"), "(..)", "$1 "), " ")).alias("at", "octet")).where("octet not in ('', '00')")
    places = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.conv("octet", 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), k).cast("int")) != 0)
    rows = octets.select("bucket", (F.col("at") * 8).alias("low"), F.explode(places).alias("k"))
    # Buckets count from 1 for code points from 1 on; code point 0 is alone in bucket 0.
    return rows.select(F.when(F.col("bucket") == 0, F.lit(0)).otherwise((F.col("bucket") - 1) * 32768 + F.col("low") + F.col("k") + 1).cast("long").alias("cp"))


def json_texts(documents: DataFrame, column: str) -> DataFrame:
    """``text``: the string values, not the keys, of JSON documents at any depth."""
    string = F.lit(r'"((?:[^"\\]|\\.)*)"(\s*:)?')  # with a colon after it, it is a key
    found = F.arrays_zip(F.regexp_extract_all(F.col(column), string, F.lit(1)).alias("raw"), F.regexp_extract_all(F.col(column), string, F.lit(2)).alias("colon"))
    rows = documents.select(F.explode(F.filter(found, lambda x: x["colon"] == "")).alias("s")).select(F.col("s.raw").alias("raw"))
    return rows.select(F.from_json(F.concat(F.lit('{"x":"'), "raw", F.lit('"}')), "x string")["x"].alias("text"))


def coverage_lines(points: DataFrame) -> DataFrame:
    """``line_no, line``: a head with the count, then a hexadecimal line for each code point in order."""
    # At most as many rows as Unicode has code points.
    count = points.agg(F.count(F.lit(1)).alias("n")).select(F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("# "), F.col("n").cast("string"), F.lit(" codepoints (book-specific subset)")).alias("line"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.orderBy("cp"))
    return count.unionByName(points.select(rank.cast("long").alias("line_no"), F.format_string("0x%04X", "cp").alias("line")))


def font(language: Column) -> Column:
    """(primary, fallback, preset) for a language: Chinese and Japanese take a second font for Hangul."""
    kind = lambda p, f, s: F.struct(F.lit(p).alias("primary"), F.lit(f).cast("string").alias("fallback"), F.lit(s).alias("preset"))
    return F.when(language_base(language).isin("ja", "zh"), kind("cjk-serif", "hangul-serif", "reading,cjk,hangul")).otherwise(kind("hangul-serif", None, "reading,hangul"))
