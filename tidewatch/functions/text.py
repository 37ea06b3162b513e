"""String and number formatting kept in JVM expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def truthy(c: Column) -> Column:
    """The text value, or NULL where a JSON reader would call it empty (missing, '', bare 0).

    Quoted decimals such as "0.0000" count as present, as they do in the feeds.
    """
    return F.when(c.isNotNull() & ~c.isin("", "0", "0.0", "false"), c)


def number(c: Column) -> Column:
    """Text to double, NULL when it does not parse."""
    return c.try_cast("double")


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    words = F.transform(
        runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))
    )
    return F.array_join(words, "")


def percent(c: Column, digits: int = 0, signed: bool = False) -> Column:
    """0.1234 -> '12.3%'; exact halves go to the even digit."""
    return _formatted(f"%{'+' if signed else ''}.{digits}f%%", c * 100, digits)


def fixed(c: Column, digits: int = 0) -> Column:
    return _formatted(f"%.{digits}f", c.cast("double"), digits)


def _formatted(pattern: str, c: Column, digits: int) -> Column:
    """NULL stays NULL (a bare format would print it)."""
    return F.when(c.isNotNull(), F.format_string(pattern, round_exact(c, digits)))


def _halves(x: Column | float) -> tuple[Column | float, Column | float]:
    """A double as the sum of two that have half of its digits each (Veltkamp)."""
    t = x * 134217729.0
    high = t - (t - x)
    return high, x - high


def round_exact(c: Column, digits: int) -> Column:
    """Round a double by its exact binary value, exact halves to the even digit.

    ``bround`` goes by the shortest decimal text, which differs only where that text ends in a
    half: 2.675 is stored as a little less, 0.00015 too, 0.12345 as a little more. There the exact
    product of the number and the power of ten (Dekker) tells the side.
    """
    scale = float(10**digits)

    def rounded(x: Column) -> Column:
        ten = 10 * scale
        (xh, xl), (th, tl) = _halves(x), _halves(ten)
        product = x * ten
        left_over = ((xh * th - product) + xh * tl + xl * th) + xl * tl
        whole = F.bround(product, 0)
        beyond = ((product - whole) + left_over) * F.signum(x)
        nearer = (whole - 5 * F.signum(x)) / 10
        farther = nearer + F.signum(x)
        even = F.when(nearer % 2 == 0, nearer).otherwise(farther)
        side = F.when(beyond > 0, farther).when(beyond < 0, nearer).otherwise(even)
        half = (F.bround(x, digits + 1) == x) & (F.abs(whole % 10) == 5)
        return F.when(half, side / scale).otherwise(F.bround(x, digits))

    return F.element_at(F.transform(F.array(c.cast("double")), rounded), 1)


def mean_exact(c: Column, digits: int) -> Column:
    """Aggregate: mean of numbers with ``digits`` decimals, rounded to as many, halves to even.

    Summed as whole numbers, so the order of the rows cannot matter.
    """
    total = F.sum(F.round(c * 10**digits, 0).cast("long"))
    n = F.count(c)
    low = (total - F.pmod(total, n)) / n  # exact: a multiple of n
    rest = 2 * F.pmod(total, n)
    up = (rest > n) | ((rest == n) & (F.pmod(low, F.lit(2)) == 1))
    return (low + F.when(up, 1.0).otherwise(0.0)) / float(10**digits)


# Character names of the HTML standard (those that need no closing semicolon with and without it), and what
# numbers of the Windows code page stand for.
_CHARACTERS = json.dumps(
    {f"&{name}": text for name, text in html.entities.html5.items()}
    | {f"&#{n};": bytes([n]).decode("cp1252") for n in range(128, 160) if n not in (129, 141, 143, 144, 157)}
)
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_OPEN_NAMES = max(len(name) for name in html.entities.html5 if not name.endswith(";"))


def unescaped(c: Column) -> Column:
    """Text with its HTML character references replaced; a closing semicolon may lack, as in HTML.

    Of a name without one the longest known beginning counts; unknown names stay. Numbers that stand for no
    character give the replacement character, those of control characters and the like nothing.
    """
    names = F.from_json(F.lit(_CHARACTERS), "map<string,string>")

    def replaced(piece: Column) -> Column:
        number = F.regexp_extract(piece, "^&#([0-9]+);?$", 1)
        digits = F.when(number == "", F.regexp_extract(piece, "^&#[xX]0*([0-9a-fA-F]*);?$", 1)).otherwise(F.ltrim(number, F.lit("0")))
        is_number = piece.rlike("^&#[0-9xX]")
        # more digits than any character has
        value = F.when(number == "", F.conv(digits, 16, 10)).otherwise(digits)
        code = F.when(digits == "", F.lit(0)).when(F.length(digits) > 9, F.lit(1 << 40)).otherwise(value.try_cast("long"))
        nothing = (
            code.between(0x1, 0x8) | code.between(0xE, 0x1F) | (code == 0xB) | (code == 0x7F) | code.between(0xFDD0, 0xFDEF)
            | (code.bitwiseAND(0xFFFE) == 0xFFFE)
        )
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.when(~valid, F.lit("\ufffd")).when(nothing, F.lit("")).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        numbered = F.coalesce(F.try_element_at(names, F.concat(F.lit("&#"), code, F.lit(";"))), char)
        beginnings = [
            F.concat(F.try_element_at(names, F.substring(piece, 1, n + 1)), F.substring(piece, n + 2, 40)) for n in range(_OPEN_NAMES, 1, -1)
        ]
        named = F.coalesce(F.try_element_at(names, piece), *beginnings, piece)
        known = F.when(is_number, numbered).otherwise(named)
        return F.when(piece.startswith("&") & (F.length(piece) > 1), known).otherwise(piece)

    pieces = F.regexp_extract_all(c, F.lit(f"({_REFERENCE}|[^&]+|&)"), F.lit(1))
    return F.when(c.contains("&"), F.array_join(F.transform(pieces, replaced), "")).otherwise(c)


def series_prefix(external_id: Column) -> Column:
    """Text before the first hyphen; NULL for tickers without one."""
    return F.when(external_id.contains("-"), F.substring_index(external_id, "-", 1))


def strip_code_fence(c: Column) -> Column:
    """Drop a leading ``` line and a trailing ``` from a reply."""
    text = F.trim(c, F.lit(" \n\r\t"))
    text = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    return F.trim(F.regexp_replace(text, r"```$", ""), F.lit(" \n\r\t"))


def iso_millis(c: Column) -> Column:
    """ISO-8601 text to epoch ms; NULL when empty or unparsable. Zone-less text is UTC."""
    has_zone = c.rlike(r"T.*(Z|[+-]\d{2}:?\d{2})$")
    date_only = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    full = (
        F.when(date_only, F.concat(c, F.lit("T00:00:00Z")))
        .when(has_zone, c)
        .when(c.contains(":"), F.concat(c, F.lit("Z")))
    )
    return F.unix_millis(F.try_to_timestamp(full))
