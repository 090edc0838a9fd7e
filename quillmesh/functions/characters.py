"""Entities and accents as JVM-side expressions; their tables come from Python's own when a query is built."""

from __future__ import annotations

import html
import json
import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# As Python reads character references: a number, or up to 32 characters of a name.
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|&|[^&]+"


@lru_cache(maxsize=1)
def _folds() -> tuple[str, str, dict[str, str]]:
    """(characters that fold to one of ASCII, these, characters that fold to several)."""
    one, to, many = [], [], {}
    for n in (n for n in range(0x80, 0x110000) if not 0xD800 <= n < 0xE000):
        if unicodedata.decomposition(chr(n)) and (plain := unicodedata.normalize("NFKD", chr(n)).encode("ascii", "ignore").decode()):
            if len(plain) == 1:
                one.append(chr(n))
                to.append(plain)
            else:
                many[chr(n)] = plain
    return "".join(one), "".join(to), many


@lru_cache(maxsize=1)
def _odd_numbers() -> dict[str, str]:
    """Numbers of character references that don't stand for the character of that number."""
    planes = [p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF)]
    return {str(n): found for n in [*range(0xA0), *range(0xFDD0, 0xFDF0), *planes] if (found := html.unescape(f"&#{n};")) != chr(n)}


def _table(of: dict[str, str]) -> Column:
    """A constant map."""
    return F.from_json(F.lit(json.dumps(of)), "map<string,string>")


def nfkd_ascii(c: Column) -> Column:
    """Compatibility decomposition, and of it what is ASCII: accents folded, ligatures and the like spelt out, the rest dropped."""
    one, to, many = _folds()
    several = "".join(many)
    table = _table(many)
    parts = F.regexp_extract_all(c, F.lit(f"[{several}]|[^{several}]+"), F.lit(0))
    spelt = F.when(c.rlike(f"[{several}]"), F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")).otherwise(c)
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(spelt, one, to), r"[^\x00-\x7f]", "")).otherwise(c)


def _by_number(digits: Column, base: int) -> Column:
    bare = F.ltrim(digits, F.lit("0"))
    n = F.conv(F.when(bare == "", "0").otherwise(F.left(bare, F.lit(8))), base, 10).cast("long")
    far = (F.length(bare) > 8) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(far, F.lit("�")).otherwise(F.coalesce(F.try_element_at(_table(_odd_numbers()), n.cast("string")), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))


def html_unescape(c: Column) -> Column:
    """All named and numbered character references as text, with or without a semicolon, as Python's ``html.unescape`` reads them."""
    names, short = _table(html5), _table({k: v for k, v in html5.items() if not k.endswith(";")})

    def text(x: Column) -> Column:
        name = F.substring(x, 2, 40)
        digits = F.rtrim(F.substring(x, 3, 1 << 20), F.lit(";"))
        sizes = F.filter(F.sequence(F.greatest(F.length(name) - 1, F.lit(1)), F.lit(1), F.lit(-1)), lambda i: (i > 1) & F.try_element_at(short, F.left(name, i)).isNotNull())
        size = F.get(sizes, F.lit(0))
        begins = F.when(size.isNotNull(), F.concat(F.try_element_at(short, F.left(name, size)), F.substring(name, size + 1, F.lit(40))))
        named = F.coalesce(F.try_element_at(names, name), begins, x)
        number = F.when(x.rlike("^&#[xX]"), _by_number(F.substring(digits, 2, 1 << 20), 16)).otherwise(_by_number(digits, 10))
        return F.when(~F.startswith(x, F.lit("&")) | (x == "&"), x).when(F.startswith(x, F.lit("&#")), number).otherwise(named)

    parts = F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0))
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(parts, text), "")).otherwise(c)
