"""Price and category expressions used while normalizing feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import fixed_values as fv
from tidewatch.functions.text import number, title_case, truthy


def unit_interval(c: Column) -> Column:
    return F.when(c.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))


def cents_to_unit(c: Column) -> Column:
    """Legacy cent prices (above 1) become dollars."""
    return F.when(c > 1.0, c / 100.0).otherwise(c)


def kalshi_yes_price(fields: Sequence[Column]) -> Column:
    """First positive price among ``fields`` (given in priority order), in [0, 1]."""
    candidates = [F.when(number(c) > 0, number(c)) for c in fields]
    return unit_interval(cents_to_unit(F.coalesce(*candidates)))


def polymarket_yes_price(
    outcome_prices: Column, last_trade: Column, best_bid: Column, best_ask: Column
) -> Column:
    """First outcome price, else last trade, else bid/ask midpoint, in [0, 1]."""
    outcomes = F.from_json(outcome_prices, "array<string>")
    first = number(F.try_element_at(outcomes, F.lit(1)))
    mid = (number(best_bid) + number(best_ask)) / 2.0
    return unit_interval(F.coalesce(first, number(last_trade), mid))


def category_from_title(title: Column, platform: str) -> Column:
    """First keyword group with a substring of the lower-cased title.

    Byte-wise ``contains`` tests stop at the first hit; one alternation pattern per group tries
    every word at every position and takes several times as long on long texts.
    """
    groups = fv.KALSHI_TITLE_KEYWORDS if platform == "kalshi" else fv.POLYMARKET_TITLE_KEYWORDS
    lowered = F.lower(title)
    out = None
    for category, words in groups:
        hit = reduce(or_, [lowered.contains(w) for w in words])
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise(fv.DEFAULT_CATEGORY)


def standard_category(raw: Column, title: Column, platform: str) -> Column:
    """Display category from the feed's own category, else from the title."""
    by_title = category_from_title(title, platform)
    cleaned = F.trim(raw)
    if platform == "kalshi":
        return F.when(cleaned != "", title_case(cleaned)).otherwise(by_title)
    mapping = F.create_map(
        *[F.lit(x) for pair in fv.POLYMARKET_CATEGORIES.items() for x in pair]
    )
    return F.coalesce(F.try_element_at(mapping, cleaned), by_title)


def first_truthy(*fields: Column) -> Column:
    return F.coalesce(*[truthy(c) for c in fields])
