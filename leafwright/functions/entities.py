"""Character references of HTML as a column expression, as the standard library's ``html.unescape`` decodes them."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: what can be a reference, after its ampersand.
_REFERENCE = r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_REPLACEMENT = "�"


@cache
def _windows() -> dict[str, str]:
    """Numbers that stand for something else: those of Windows-1252 from 128 to 159, where it has a character, and zero."""
    out = {"0": _REPLACEMENT, "13": "\r"}
    for k in range(0x80, 0xA0):
        try:
            out[str(k)] = bytes([k]).decode("cp1252")
        except UnicodeDecodeError:
            out[str(k)] = chr(k)
    return out


def _table(held: dict[str, str]) -> Column:
    """A constant map: it is parsed once, when the plan is made."""
    return F.from_json(F.lit(json.dumps(held)), "map<string,string>")


def _character(n: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _number(reference: Column) -> Column:
    bare = F.rtrim(reference, F.lit(";"))
    hexadecimal = F.lower(F.substring(bare, 2, 1)) == "x"
    digits = F.ltrim(F.when(hexadecimal, F.substr(bare, F.lit(3))).otherwise(F.substr(bare, F.lit(2))), F.lit("0"))
    n = F.when(F.length(digits) > 7, F.lit(0x110000).cast("long")).when(hexadecimal, F.conv(F.concat(F.lit("0"), digits), 16, 10).cast("long")).otherwise(F.concat(F.lit("0"), digits).cast("long"))
    nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return F.coalesce(
        F.try_element_at(_table(_windows()), n.cast("string")),
        F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), F.lit(_REPLACEMENT)).when(nothing, F.lit("")).otherwise(_character(n)),
    )


def _name(reference: Column) -> Column:
    """A name, or the longest one without a semicolon that begins it, or the text as it is."""
    loose = {k: v for k, v in html5.items() if not k.endswith(";")}
    found = [F.try_element_at(_table(html5), reference)]
    for size in range(max(map(len, loose)), 1, -1):
        prefix = F.try_element_at(_table(loose), F.substring(reference, 1, size))
        found.append(F.when(F.length(reference) > size, F.concat(prefix, F.substr(reference, F.lit(size + 1)))))
    return F.coalesce(*found, F.concat(F.lit("&"), reference))


def unescaped_once(c: Column) -> Column:
    """``html.unescape`` of a text."""
    references = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(1))
    decoded = F.transform(references, lambda r: F.when(r.startswith("#"), _number(r)).otherwise(_name(r)))
    return F.array_join(F.zip_with(F.split(c, _REFERENCE, -1), F.concat(decoded, F.array(F.lit(""))), lambda gap, value: F.concat(gap, value)), "")


def unescaped(c: Column) -> Column:
    """References decoded until nothing changes.

    Each pass that changes a text makes it shorter, and by two at least while an ampersand is left to decode, so half
    its length bounds the passes; those after the last change do nothing.
    """
    kind = "struct<t:string,done:boolean>"
    bind = lambda x, f: F.element_at(F.transform(F.array(x), f), 1)  # noqa: E731  x is evaluated once
    start = F.struct(c.alias("t"), F.lit(False).alias("done")).cast(kind)
    step = lambda acc, k: F.when(acc["done"], acc).otherwise(bind(unescaped_once(acc["t"]), lambda t: F.struct(t.alias("t"), ((t == acc["t"]) | ~F.contains(t, F.lit("&"))).alias("done")).cast(kind)))
    return F.when(F.contains(c, F.lit("&")), F.aggregate(F.sequence(F.lit(1), F.floor(F.length(c) / 2).cast("int") + 1), start, step)["t"]).otherwise(c)
