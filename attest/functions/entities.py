"""HTML character references, decoded by column functions.

References are found by pattern, decoded one by one and put back between the pieces of the text, all inside the row.
Named ones come from the standard library's table, laid out by first letter; one that is not in it may start with one
that is and needs no semicolon, the longest such."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column, functions as F

from .text import let

# Fixed value: the references that a browser accepts, decimal, hexadecimal and named.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
# The same with their semicolon.
CLOSED = REFERENCE.replace(";?", ";")
REPLACEMENT = "�"
LAST = 0x10FFFF


def stands_for(code: int) -> str | None:
    """What a number that is no character of its own stands for: the old Western code page for 0x80 to 0x9F, a
    replacement for 0, nothing for other controls and the numbers set aside in a plane's end; null for all others."""
    if code == 0:
        return REPLACEMENT
    if code == 0x0D:
        return "\r"
    if 0x80 <= code <= 0x9F:
        try:
            return bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            return chr(code)
    if 0x01 <= code <= 0x08 or 0x0B == code or 0x0E <= code <= 0x1F or code == 0x7F or 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE:
        return ""
    return None


@cache
def tables() -> tuple[str, str, int]:
    """Names by first letter, numbers with a meaning of their own, and the longest name that needs no semicolon."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, text in html5.items():
        by_letter.setdefault(name[0], {})[name] = text
    planes = [p * 0x10000 + low for p in range(17) for low in (0xFFFE, 0xFFFF)]
    numbers = {str(c): stands_for(c) for c in [*range(0xA0), *range(0xFDD0, 0xFDF0), *planes] if stands_for(c) is not None}
    return json.dumps(by_letter), json.dumps(numbers), max(len(n) for n in html5 if not n.endswith(";"))


def decode_entities(c: Column, bare: bool = True) -> Column:
    """The text with its references decoded; null for null. Without ``bare`` one that lacks its semicolon is text."""
    reference = REFERENCE if bare else CLOSED
    names, numbers, longest = tables()
    by_letter = F.from_json(F.lit(names), "map<string,map<string,string>>")
    special = F.from_json(F.lit(numbers), "map<string,string>")

    def numbered(body):
        # Digits beyond ten can only lie past the last character, whatever their value.
        hexadecimal = body.rlike("^#[xX]")
        digits = F.regexp_replace(F.regexp_replace(body, "^#[xX]?0*|;$", ""), "^$", "0")
        code = F.when(F.length(digits) > 10, F.lit(LAST + 1)).otherwise(
            F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint"))
        return let(code, lambda n: F.coalesce(
            F.element_at(special, n.cast("string")),
            F.when((n > LAST) | ((n >= 0xD800) & (n <= 0xDFFF)), REPLACEMENT),
            F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))

    def named(body):
        def from_table(table):
            if not bare:
                return F.coalesce(F.element_at(table, body), F.concat(F.lit("&"), body))
            starts = F.transform(F.sequence(F.least(F.length(body) - 1, F.lit(longest)), F.lit(2), F.lit(-1)), lambda k: F.substr(body, F.lit(1), k))
            shorter = F.when(F.length(body) > 2, F.get(F.filter(starts, lambda s: F.element_at(table, s).isNotNull()), F.lit(0)))
            prefix = let(shorter, lambda s: F.when(s.isNotNull(), F.concat(F.element_at(table, s), F.substr(body, F.length(s) + 1))))
            return F.coalesce(F.element_at(table, body), prefix, F.concat(F.lit("&"), body))
        return F.coalesce(let(F.element_at(by_letter, F.substring(body, 1, 1)), from_table), F.concat(F.lit("&"), body))

    def one(found):
        return let(F.substr(found, F.lit(2)), lambda body: F.when(F.startswith(body, F.lit("#")), numbered(body)).otherwise(named(body)))

    def joined(found):
        texts = F.concat(F.transform(found, one), F.array(F.lit("")))
        return F.array_join(F.zip_with(F.split(c, reference), texts, lambda a, b: F.concat(a, b)), "")
    whole = let(F.regexp_extract_all(c, F.lit(reference), F.lit(0)), joined)
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)
