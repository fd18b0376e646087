"""Text functions of the document engine.

White space is Unicode white space everywhere (``(?U)``), which Java's default ``\\s`` and ``trim`` are not.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafwright.functions.entities import unescaped

# Abbreviations whose dots do not end a sentence, in the order in which they are masked.
ABBREVIATIONS = [
    "Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Sr.", "Jr.", "St.", "vs.", "etc.", "i.e.", "e.g.",
    "cf.", "pp.", "Vol.", "No.", "Ch.", "Aug.", "Sept.", "Oct.", "Nov.", "Dec.",
]

# Languages with a display name.
LANGUAGE_NAMES = {"en": "English", "ja": "Japanese", "fr": "French", "de": "German", "zh": "Chinese", "es": "Spanish"}

# Fixed patterns: what a whole paragraph must look like to be a chapter heading.
HEADINGS = [
    r"(?:CHAPTER|Chapter|Chap\.?|Ch\.)\s+[IVXLC0-9]+\b",
    r"第\s*[一二三四五六七八九十百千0-9]+\s*章",
    r"제\s*[0-9一二三四五六七八九十]+\s*장",
    r"【\s*[一二三四五六七八九十百千0-9]+\s*】",
    r"[A-Z][A-Z'\-]{1,}(?:\s+[A-Z'\-]+){1,5}\.?",
]

# Fixed patterns: titles of front matter.
CREDIT_TITLE = r"(?i)^(?:TRANSLATED\s+BY|COPYRIGHT|PUBLISHED|BY\s+[A-Z]|DEDICATION|ABOUT\s+THE|COLOPHON|PRODUCED\s+BY)"

# Fixed patterns: the markers around a text and the credits after the first one.
START_MARKER = r"\*\*\s*START\s+OF.*?\*\*\*"
END_MARKER = r"\*\*\s*END\s+OF.*?\*\*\*"
CREDITS = r"^\s*Produced by .*?(?:pgdp\.net|project gutenberg|distributed proofreading)[^\n]*\n"

#: The limits that define chapters (units).
CHAPTER_CAP, FRONT_MATTER_UNITS, TITLE_LENGTH = 80, 8, 200

_MASK = "\x00"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """Null, empty or white space only: in the engine all of them mean that a value is missing."""
    return strip(F.coalesce(c, F.lit(""))) == ""


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def sentences(c: Column) -> Column:
    """The sentences of a paragraph, in order; those of one or two characters vanish; never empty."""
    masked = reduce(lambda x, a: F.replace(x, F.lit(a), F.lit(a.replace(".", _MASK))), ABBREVIATIONS, c)
    parts = F.split(masked, r"""(?U)(?<=[.!?])\s+(?=[A-Z"'\[(])|(?<=[。！？])\s*""", -1)
    parts = F.filter(F.transform(parts, lambda p: strip(F.replace(p, F.lit(_MASK), F.lit(".")))), lambda p: F.length(p) > 2)
    # Bound to a variable: named twice, the whole chain would be computed twice.
    return F.element_at(F.transform(F.array(parts), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(c))), 1)


def paragraphs(c: Column) -> Column:
    """Blocks between blank lines, collapsed; those of one character or less vanish."""
    blocks = F.transform(F.split(c, r"(?U)\n\s*\n", -1), collapse)
    return F.filter(blocks, lambda b: F.length(b) > 1)


def without_boilerplate(c: Column) -> Column:
    """What stands after the first start marker and before the first end marker after it, without the first credits."""
    c = F.regexp_replace(c, rf"(?is)\A.*?{START_MARKER}", "")
    c = F.regexp_replace(c, rf"(?is){END_MARKER}.*\z", "")
    # Java replaces all matches; the text before the first one is part of the match, so that there is one only.
    return F.regexp_replace(c, rf"\A((?s:.*?))(?im:{CREDITS})", "$1")


def is_heading(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*(?:" + "|".join(HEADINGS) + r")\s*$")


def language_base(c: Column) -> Column:
    """The first part of a language tag in lower case; ``en`` if there is none."""
    return F.lower(F.split_part(F.coalesce(F.nullif(c, F.lit("")), F.lit("en")), F.lit("-"), F.lit(1)))


def language_name(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair])
    return F.coalesce(names[c], c)


def safe_filename(c: Column) -> Column:
    """Letters, digits, space, ``_`` and ``-``; others become ``_``; 80 characters; ``book`` if nothing is left."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", "_"), 1, 80), F.lit("")), F.lit("book"))


def xml_escape_once(c: Column) -> Column:
    """``& < > "`` as entities."""
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def xml_escape(c: Column) -> Column:
    """Entities decoded until nothing changes, then ``& < > "`` escaped once; null is empty."""
    return xml_escape_once(unescaped(F.coalesce(c, F.lit(""))))


def image_type(c: Column) -> Column:
    """(extension, media type) by magic bytes; JPEG if unknown."""
    kind = lambda e, m: F.struct(F.lit(e).alias("extension"), F.lit(m).alias("media_type"))
    starts = lambda hexed: F.hex(F.substring(c, 1, len(hexed) // 2)) == hexed
    return (
        F.when(starts("FFD8FF"), kind(".jpg", "image/jpeg"))
        .when(starts("89504E470D0A1A0A"), kind(".png", "image/png"))
        .when(starts("474946383761") | starts("474946383961"), kind(".gif", "image/gif"))
        .when(starts("52494646") & (F.hex(F.substring(c, 9, 4)) == "57454250"), kind(".webp", "image/webp"))
        .otherwise(kind(".jpg", "image/jpeg"))
    )


def percent(done: Column, total: Column) -> Column:
    """100 * done / total, one decimal, halves to even; 0 without a total."""
    return F.when(total != 0, F.bround(100 * done.cast("double") / total, 1)).otherwise(0.0)
