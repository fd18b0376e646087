"""Requests and queues as append-only logs: current state, transitions, progress and the drain of a queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The states of a request and where each may lead (any may fail).
STATES = ["requested", "searching", "selected", "translating", "assembling", "published", "failed"]
NEXT_STATES = {"requested": ["searching", "selected"], "searching": ["selected"], "selected": ["translating"], "translating": ["assembling"], "assembling": ["published"], "published": [], "failed": ["selected"]}
#: A device address is believed for so long.
ADDRESS_TTL_MS = 300_000


def current(log: DataFrame, fields: list[str], key: str = "id", seq: str = "seq") -> DataFrame:
    """A row for each key with the last value of each field; events of ``log`` leave fields they don't set null.

    A field is set to null by an event whose ``cleared`` array (if the log has one) names it.
    """
    cleared = lambda f: F.array_contains(F.col("cleared"), f) if "cleared" in log.columns else F.lit(False)
    last = [F.max_by(F.struct(F.col(f).alias("v")), F.when(F.col(f).isNotNull() | F.coalesce(cleared(f), F.lit(False)), F.col(seq)))["v"].alias(f) for f in fields]
    return log.groupBy(key).agg(F.min(seq).alias("created_seq"), F.max(seq).alias("updated_seq"), *last)


def accepted(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """``log`` with ``accepted``: false for events of a key before the one that made its request (status ``requested``).

    An update of an id that isn't known is refused; drop such events, or report them, before ``current``.
    """
    made = F.min(F.when(F.col("status") == STATES[0], F.col(seq))).over(W.partitionBy(key))
    return log.withColumn("accepted", F.coalesce(F.col(seq) >= made, F.lit(False)))


def publish_events(rows: DataFrame) -> DataFrame:
    """Events that publish requests (``id, seq, path, url``): status, progress of 100 out of 100, and no error any more."""
    return rows.select(
        "id", "seq", F.lit("published").alias("status"), "path", "url", F.lit(100).cast("long").alias("done"), F.lit(100).cast("long").alias("total"),
        F.lit(100.0).alias("pct"), F.lit(None).cast("string").alias("error"), F.array(F.lit("error")).alias("cleared"),
    )


def recent(state: DataFrame, n: int) -> DataFrame:
    """The ``n`` requests that were made last, newest first; none for 0."""
    return state.orderBy(F.desc("created_seq")).limit(n)


def transitions(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """``key, seq, before, status, allowed`` for every event that sets a status."""
    rows = log.where(F.col("status").isNotNull())
    before = F.lag("status").over(W.partitionBy(key).orderBy(seq))
    allowed = F.create_map(*[x for k, v in NEXT_STATES.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))])
    rows = rows.select(key, seq, before.alias("before"), "status")
    fine = F.when(F.col("before").isNull(), F.col("status") == "requested").otherwise((F.col("status") == "failed") | (F.col("status") == F.col("before")) | F.coalesce(F.array_contains(allowed[F.col("before")], F.col("status")), F.lit(False)))
    return rows.withColumn("allowed", fine)


def crossings(progress: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Events of ``key, seq, done, total`` at which progress enters a higher fifth than ever before, but not the first."""
    pct = F.when(F.col("total") != 0, F.floor(100 * F.col("done") / F.col("total"))).otherwise(0)
    rows = progress.withColumn("pct", pct.cast("long")).withColumn("bucket", F.floor(F.col("pct") / 20).cast("long"))
    # Only buckets above zero are remembered, so the first one that counts is 1.
    seen = F.max(F.when(F.col("bucket") > 0, F.col("bucket"))).over(W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    return rows.withColumn("seen", F.coalesce(seen, F.lit(-1))).where("bucket > seen and bucket > 0").select(key, seq, "done", "total", "pct", "bucket")


def queue(log: DataFrame) -> DataFrame:
    """``path, title, queued_seq, attempts, last_attempt_seq`` of what is still queued.

    The log has ``path, seq, op, title``. ``enqueue`` puts a path at the end with no attempts, wherever it was;
    ``attempt`` counts; ``remove`` takes it out. State is a matter of each path's last enqueue and what follows.
    """
    order = W.partitionBy("path")
    rows = log.withColumn("start", F.max(F.when(F.col("op") == "enqueue", F.col("seq"))).over(order)).where("seq >= start")
    state = rows.groupBy("path").agg(
        F.max("start").alias("queued_seq"), F.max_by("title", F.when(F.col("op") == "enqueue", F.col("seq"))).alias("title"),
        F.count_if(F.col("op") == "attempt").alias("attempts"), F.max(F.when(F.col("op") == "attempt", F.col("seq"))).alias("last_attempt_seq"), F.bool_or(F.col("op") == "remove").alias("gone"),
    )
    return state.where("not gone").select("path", "title", "queued_seq", "attempts", "last_attempt_seq")


def advanced(items: DataFrame, log: DataFrame) -> DataFrame:
    """The queue ``items`` (as ``queue`` gives them) after further events ``log``: what ``queue`` says of both logs together."""
    rows = log.withColumn("start", F.max(F.when(F.col("op") == "enqueue", F.col("seq"))).over(W.partitionBy("path"))).where("start is null or seq >= start")
    news = rows.groupBy("path").agg(
        F.max("start").alias("start"), F.max_by("title", F.when(F.col("op") == "enqueue", F.col("seq"))).alias("new_title"), F.count_if(F.col("op") == "attempt").alias("more"),
        F.max(F.when(F.col("op") == "attempt", F.col("seq"))).alias("latest"), F.bool_or(F.col("op") == "remove").alias("gone"),
    )
    rows = items.join(news, "path", "full").where("not coalesce(gone, false) and (start is not null or queued_seq is not null)")
    fresh = F.col("start").isNotNull()
    return rows.select(
        "path", F.when(fresh, F.col("new_title")).otherwise(F.col("title")).alias("title"), F.coalesce("start", "queued_seq").alias("queued_seq"),
        (F.when(fresh, F.lit(0)).otherwise(F.col("attempts")) + F.coalesce("more", F.lit(0))).cast("long").alias("attempts"),
        F.when(fresh, F.col("latest")).otherwise(F.coalesce("latest", "last_attempt_seq")).alias("last_attempt_seq"),
    )


def delivered(requests: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """``id, path, family`` of the requests that have a file, with the first font family by name, if any (``name``)."""
    rows = requests.where(F.col("path").isNotNull()).select("id", "path")
    if families is None:
        return rows.withColumn("family", F.lit(None).cast("string"))
    return rows.crossJoin(F.broadcast(families.agg(F.min("name").alias("family"))))  # one row


def removals(pushes: DataFrame) -> DataFrame:
    """Queue events that take out what was delivered directly, of ``path, seq, pushed``: files that were not stay queued."""
    return pushes.where(F.coalesce("pushed", F.lit(False))).select("path", "seq", F.lit("remove").alias("op"), F.lit(None).cast("string").alias("title"))


def delivery_summary(family: Column, font_pushed: Column, book_pushed: Column) -> Column:
    """What arrived on a device (the font by its family, the book); null where nothing did."""
    parts = F.concat_ws(", ", F.when(F.coalesce(font_pushed, F.lit(False)), F.concat(F.lit("font "), family)), F.when(F.coalesce(book_pushed, F.lit(False)), F.lit("book")))
    return F.when(parts != "", F.concat(F.lit("On the device: "), parts))


def drained(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``tick, path, pos, result`` of one pass over a queue: ``gone``, ``pushed``, ``failed``, or ``waiting``.

    ``items`` has ``tick, path, pos``; ``outcomes`` has ``tick, path, exists, pushed, skipped``. The first push that
    finds no device is a failure and ends the pass; what comes after it waits.
    """
    rows = items.join(outcomes, ["tick", "path"], "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
    # A row for each pass: a window over one would hold its whole queue.
    stops = rows.where("exists and not pushed and skipped").groupBy("tick").agg(F.min("pos").alias("stop"))
    rows = rows.join(stops, "tick", "left")
    result = F.when(F.col("pos") > F.coalesce("stop", F.lit(2**62)), "waiting").when(~F.col("exists"), "gone").when(F.col("pushed"), "pushed").otherwise("failed")
    return rows.select("tick", "path", "pos", result.alias("result"))


def drain_summary(results: DataFrame, devices: DataFrame | None = None) -> DataFrame:
    """``tick, queued, pushed, failed, left`` of drained passes.

    With ``devices`` (``tick, ip, source``; no row, or no ip, where none was found) also ``discovered, ip, source``;
    a pass without a device leaves the whole queue as it is.
    """
    if devices is not None:
        results = results.join(devices.where(F.col("ip").isNotNull()), "tick", "left").withColumn("result", F.when(F.col("ip").isNull(), "waiting").otherwise(F.col("result")))
    keys = ["tick"] if devices is None else ["tick", "ip", "source"]
    rows = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queued"), F.count_if(F.col("result") == "pushed").alias("pushed"), F.count_if(F.col("result") == "failed").alias("failed"),
        F.count_if(F.col("result").isin("failed", "waiting")).alias("left"),
    )
    return rows if devices is None else rows.select("tick", "queued", F.col("ip").isNotNull().alias("discovered"), "pushed", "failed", "left", "ip", "source")


def delivery_message(c_title: str = "title", c_author: str = "author", c_source: str = "source") -> Column:
    """The message of a finished book: how to fetch it, or that it was pushed, or why that failed.

    Reads ``pushed`` (null: not tried), ``skipped``, ``path, elapsed_ms, error`` beside the title, author and source.
    """
    fetch = F.concat(F.lit("Library: look for '"), c_title, F.lit(" (KO bilingual)'"))
    sent = F.concat(F.lit("Sent to "), F.coalesce("path", F.lit("/Books")), F.lit(" ("), F.coalesce(F.col("elapsed_ms").cast("string"), F.lit("?")), F.lit(" ms)"))
    failed = F.concat(fetch, F.lit("\nPush failed: "), F.coalesce("error", F.lit("unknown")))
    how = F.when(F.col("pushed"), sent).when(F.col("pushed").isNotNull() & ~F.coalesce("skipped", F.lit(True)), failed).otherwise(fetch)
    return F.concat(F.lit("Translated: "), c_title, F.lit(" / "), c_author, F.lit("\nSource: "), c_source, F.lit("\n"), how)


def device_address(found: DataFrame, now_ms: int) -> DataFrame:
    """The address to use, of ``rank, ip, source, discovered_ms``: the least rank that has one; cached ones must be fresh."""
    fresh = (F.col("source") != "cache") | (F.lit(now_ms) - F.col("discovered_ms") < ADDRESS_TTL_MS)
    return found.where(F.col("ip").isNotNull() & fresh).agg(F.min_by(F.struct("ip", "source"), "rank").alias("x")).select("x.ip", "x.source")


def published(log: DataFrame, fixed_tags: tuple[str, ...] = ("bilingual", "korean")) -> DataFrame:
    """A library row for each title, the last published: ``title, path, source, seq, id, url, tags``; add your library's own tags."""
    last = F.row_number().over(W.partitionBy("title").orderBy(F.desc("seq")))
    rows = log.withColumn("n", last).where("n = 1").drop("n")
    ident = F.substring(F.sha2("title", 256), 1, 12)
    tags = F.concat_ws(",", *map(F.lit, fixed_tags), F.when(F.col("source").isNotNull() & (F.col("source") != ""), F.concat(F.lit("source:"), "source")))
    return rows.select("title", "path", "source", "seq", ident.alias("id"), F.concat(F.lit("/opds/book/"), ident).alias("url"), tags.alias("tags"))
