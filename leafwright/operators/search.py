"""Search: routing of queries, ordered union of sources, and the list that is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafwright.functions.text import strip

# Source keys, their badges, and the sources that are asked by default.
BADGES = {"gutenberg": "GB", "standard_ebooks": "SE", "annas_archive": "AA", "local": "LOCAL"}
DEFAULT_SOURCES = ["gutenberg", "standard_ebooks"]
PER_SOURCE, SHOWN = 5, 8


def route(query: Column) -> Column:
    """(sources, query) of a query: a prefix names the sources, a path is local, others go to the default ones."""
    q = strip(query)
    to = lambda names, rest: F.struct(F.array(*map(F.lit, names)).alias("sources"), rest.alias("query"))
    after = lambda n: strip(F.substr(q, F.lit(n + 1)))
    return (
        F.when(F.lower(q).startswith("annas:"), to([*DEFAULT_SOURCES, "annas_archive"], after(6)))
        .when(q.startswith("/") | q.startswith("~"), to(["local"], q))
        .when(F.lower(q).startswith("local:"), to(["local"], after(6)))
        .otherwise(to(DEFAULT_SOURCES, q))
    )


def merged(candidates: DataFrame, per_source: int = PER_SOURCE) -> DataFrame:
    """The first ``per_source`` rows of each source, less those whose title and author an earlier row has.

    Rows have ``query, source_rank, pos, source, title, author`` and what else they carry; letter case and what goes
    beyond 120 and 80 characters don't tell titles and authors apart.
    """
    first = candidates.withColumn("n", F.row_number().over(W.partitionBy("query", "source_rank").orderBy("pos"))).where(F.col("n") <= per_source)
    key = [F.substring(F.lower("title"), 1, 120), F.substring(F.lower("author"), 1, 80)]
    own = F.row_number().over(W.partitionBy("query", *key).orderBy("source_rank", "pos"))
    return first.withColumn("n", own).where("n = 1").drop("n")


# The messages with and without candidates.
FOUND, NOTHING = ("🔍 '{}' 검색 결과 ({}건)\n번호를 답장으로 보내면 번역을 시작합니다.\n\n", "🔍 '{}' — 검색 결과 없음")


def shown(rows: DataFrame, most: int = SHOWN, asked: DataFrame | None = None) -> DataFrame:
    """``query, message``: the numbered list of a query's merged candidates; of ``asked`` queries (``query``) without any, that there are none."""
    order = W.partitionBy("query").orderBy("source_rank", "pos")
    badges = F.create_map(*[F.lit(x) for pair in BADGES.items() for x in pair])
    right = F.when(F.col("rights").isNotNull() & ~F.col("rights").isin("", "unknown"), F.concat(F.lit("["), "rights", F.lit("]"))).otherwise("")
    rows = rows.withColumn("i", F.row_number().over(order))
    line = F.concat(F.col("i").cast("string"), F.lit(". ["), F.coalesce(badges[F.col("source")], "source"), F.lit("] "), "title", F.lit(" / "), "author", F.lit(" "), right)
    rows = rows.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(F.col("i") <= most, F.struct("i", line.alias("line"))))).alias("lines"))
    head = F.format_string(FOUND.replace("{}", "%s"), "query", F.col("n").cast("string"))
    rows = rows.select("query", F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("message"))
    if asked is None:
        return rows
    rows = asked.select("query").distinct().join(rows, "query", "left")
    return rows.select("query", F.coalesce("message", F.format_string(NOTHING.replace("{}", "%s"), "query")).alias("message"))
