"""Text: Unicode normal forms, tokens, symbols that are safe in paths, canonical symbols, ratings."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Symbols and what they stand for.
ALIASES = {
    "XAUUSD": "GC=F", "XAU": "GC=F", "GOLD": "GC=F", "XAGUSD": "SI=F", "XAG": "SI=F", "SILVER": "SI=F", "XPTUSD": "PL=F", "XPDUSD": "PA=F",
    "WTICOUSD": "CL=F", "USOIL": "CL=F", "WTI": "CL=F", "BCOUSD": "BZ=F", "UKOIL": "BZ=F", "BRENT": "BZ=F", "NATGAS": "NG=F", "XNGUSD": "NG=F", "COPPER": "HG=F", "XCUUSD": "HG=F",
    "SPX500": "^GSPC", "US500": "^GSPC", "SPX": "^GSPC", "NAS100": "^NDX", "US100": "^NDX", "USTEC": "^NDX", "US30": "^DJI", "DJI30": "^DJI", "WS30": "^DJI",
    "GER40": "^GDAXI", "GER30": "^GDAXI", "DE40": "^GDAXI", "UK100": "^FTSE", "JP225": "^N225", "JPN225": "^N225", "FRA40": "^FCHI", "EU50": "^STOXX50E", "HK50": "^HSI",
}
CRYPTO = ["BTC", "ETH", "SOL", "XRP", "ADA", "DOGE", "LTC", "BCH", "DOT", "AVAX", "LINK"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "NZD", "CNY", "CNH", "HKD", "SGD", "SEK", "NOK", "DKK", "PLN", "MXN", "ZAR", "TRY", "INR", "KRW", "BRL", "RUB", "THB"]
RATINGS = ["Buy", "Overweight", "Hold", "Underweight", "Sell"]
RATING_ACTIONS = {"buy": "BUY", "overweight": "BUY", "hold": "HOLD", "underweight": "SELL", "sell": "SELL"}

#: What a rating and its label look like, words, and what is safe in a path.
LABEL = r"(?i)rating.*?[:\-][\s*]*(\w+)"
RATING = r"(?i)\b(Buy|Overweight|Hold|Underweight|Sell)\b"
WORD = r"(?U)\w+(?:[-_]\w+)*"
SAFE = r"^[A-Za-z0-9._\-^=+]+$"


# Sentences that state a rule, by stage.
NUMERIC_STAGES = ["ENTRY", "CONFIRMATION", "INVALIDATION", "EXIT", "PROFIT_PROTECTION", "STOP_BEHAVIOR"]
_NUMBER, _AFTER = r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?)", r"(after [a-z][a-z0-9_-]*(?: [a-z][a-z0-9_-]*)*)"
NUMERIC_RULE = rf"^(?:({'|'.join(NUMERIC_STAGES)}): )?(LONG|SHORT) when ([a-z][a-z0-9_]*) (>=|>|<=|<) {_NUMBER} (points|pips|ticks|bps|fraction|hz|ratio) {_AFTER}\.?$"
MOVE_RULE = rf"^EXPECTED_MOVE: (LONG|SHORT) target {_NUMBER} points within ([1-9][0-9]*) seconds {_AFTER}$"
#: The unit of each feature that a rule may name.
FEATURE_UNITS = {
    "momentum": "points", "rolling_range": "points", "spread": "points", "spread_points": "points", "spread_expansion": "points", "return_1": "fraction", "m1_return": "fraction", "m5_return": "fraction",
    "volatility": "fraction", "direction_persistence": "fraction", "range_position": "fraction", "tick_count": "ticks", "tick_frequency": "hz", "burst": "ratio",
}
HORIZON_RULE = rf"^HORIZON: hold no longer than ([1-9][0-9]*) seconds {_AFTER}$"


def rule(quote: Column, stage: Column) -> Column:
    """A rule stated by a quote at a stage: direction, feature, operator, value, unit, condition, seconds.

    Only whole sentences of the three forms count, and only at the stage they name (ENTRY if none);
    anything else is null. Values are exact decimals.
    """
    part = lambda pattern, i: F.regexp_extract(quote, pattern, i)
    number = lambda c: c.cast("decimal(38,18)").alias("value")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    named = F.when(part(NUMERIC_RULE, 1) == "", "ENTRY").otherwise(part(NUMERIC_RULE, 1))
    numeric = F.struct(part(NUMERIC_RULE, 2).alias("direction"), part(NUMERIC_RULE, 3).alias("feature"), part(NUMERIC_RULE, 4).alias("operator"), number(part(NUMERIC_RULE, 5)), part(NUMERIC_RULE, 6).alias("unit"), part(NUMERIC_RULE, 7).alias("condition"), none("bigint", "seconds"))
    move = F.struct(part(MOVE_RULE, 1).alias("direction"), none("string", "feature"), F.lit(">=").alias("operator"), number(part(MOVE_RULE, 2)), F.lit("points").alias("unit"), part(MOVE_RULE, 4).alias("condition"), part(MOVE_RULE, 3).cast("bigint").alias("seconds"))
    hold = F.struct(F.lit("BOTH").alias("direction"), none("string", "feature"), F.lit("<=").alias("operator"), number(part(HORIZON_RULE, 1)), F.lit("seconds").alias("unit"), part(HORIZON_RULE, 2).alias("condition"), part(HORIZON_RULE, 1).cast("bigint").alias("seconds"))
    return F.when(stage.isin(*NUMERIC_STAGES) & quote.rlike(NUMERIC_RULE) & (named == stage), numeric).when((stage == "EXPECTED_MOVE") & quote.rlike(MOVE_RULE), move).when((stage == "HORIZON") & quote.rlike(HORIZON_RULE), hold)


def known_unit(rule: Column) -> Column:
    """Whether a rule can be applied: it names no feature, or one that is known in the unit it has."""
    return rule["feature"].isNull() | F.coalesce(F.try_element_at(_map(FEATURE_UNITS), rule["feature"]) == rule["unit"], F.lit(False))


def unicode_form(form: str, fold: bool = False) -> object:
    """A function of a text column: its normal form, case-folded if asked for.

    Spark has no Unicode normal forms, so whole Arrow batches go through Python's tables.
    """

    @F.pandas_udf("string")
    def normal(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(lambda t: None if t is None else unicodedata.normalize(form, t.casefold() if fold else t))

    return normal


def _folded(t: str | None) -> str | None:
    if t is None or t.isascii():
        return t if t is None else t.lower()
    apart = unicodedata.normalize("NFD", unicodedata.normalize("NFC", t).casefold())
    for mark in [c for c in set(apart) if unicodedata.category(c) == "Mn"]:
        apart = apart.replace(mark, "")
    return unicodedata.normalize("NFC", apart)


def folded(text: Column) -> Column:
    """Texts by case folding and without diacritics, composed again; plain ones need no tables."""

    @F.pandas_udf("string")
    def fold(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield texts.map(_folded)

    return fold(text)


def words(text: Column) -> Column:
    """Lower-case tokens: Unicode word characters, joined by single hyphens or underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def path_component(symbol: Column, longest: int = 32) -> Column:
    """The symbol if it is safe as one part of a path, else null: bounded, plain, and not only dots."""
    return F.when((F.length(symbol).between(1, longest)) & symbol.rlike(SAFE) & ~symbol.rlike(r"^\.+$"), symbol)


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def canonical_symbol(raw: Column) -> Column:
    """A user's symbol as a data vendor names it: alias, crypto pair, currency pair, or itself.

    A trailing plus goes; blank input stays as it is.
    """
    bare = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(F.upper(bare), r"\++$", "")
    base = F.regexp_extract(F.regexp_replace(s, "-", ""), "^(" + "|".join(CRYPTO) + ")(USDT|USDC|USD)$", 1)
    pair = (F.length(s) == 6) & F.substring(s, 1, 3).isin(CURRENCIES) & F.substring(s, 4, 3).isin(CURRENCIES)
    found = F.coalesce(F.try_element_at(_map(ALIASES), s), F.when(base != "", F.concat(base, F.lit("-USD"))), F.when(pair, F.concat(s, F.lit("=X"))), s)
    return F.when(bare == "", raw).otherwise(found)


def rating(text: Column) -> Column:
    """One of five ratings: the first line that labels one, else the first such word, else null.

    Wide and other compatible forms of letters and marks count as the plain ones.
    """
    text = unicode_form("NFKC")(text)
    known = F.array(*[F.lit(r.lower()) for r in RATINGS])
    labels = F.transform(F.split(text, r"\R"), lambda line: F.lower(F.regexp_extract(line, LABEL, 1)))
    labelled = F.get(F.filter(labels, lambda x: F.array_contains(known, x)), F.lit(0))
    word = F.lower(F.regexp_extract(text, RATING, 1))
    return F.initcap(F.coalesce(labelled, F.when(word != "", word)))


def rating_action(value: Column) -> Column:
    """BUY, HOLD or SELL for a rating, null for anything else."""
    return F.try_element_at(_map(RATING_ACTIONS), F.lower(F.trim(value)))
