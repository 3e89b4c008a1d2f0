
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Category -> bucket, by venue.
BUCKETS = {
    "pm": {
        "sports": "sports", "tennis": "sports", "esports": "sports", "soccer": "sports", "nba": "sports", "nfl": "sports", "mlb": "sports",
        "nhl": "sports", "golf": "sports", "boxing": "sports", "mma": "sports", "f1": "sports", "olympics": "sports",
        "crypto": "crypto", "bitcoin": "crypto", "ethereum": "crypto", "solana": "crypto", "xrp": "crypto", "up or down": "crypto",
        "politics": "politics", "geopolitics": "politics", "world": "politics", "elections": "politics", "us-current-affairs": "politics",
        "finance": "econ", "economy": "econ", "business": "econ", "companies": "econ", "stocks": "econ", "fed rates": "econ",
        "culture": "entertainment", "movies": "entertainment", "awards": "entertainment", "music": "entertainment",
        "celebrities": "entertainment", "pop culture": "entertainment", "tv": "entertainment", "mentions": "mentions",
        "science": "science", "tech": "science", "ai": "science", "health": "science", "weather": "weather", "climate": "weather",
    },
    "k": {
        "sports": "sports", "crypto": "crypto", "politics": "politics", "elections": "politics",
        "economics": "econ", "financials": "econ", "commodities": "econ", "companies": "econ",
        "entertainment": "entertainment", "social": "entertainment", "mentions": "mentions",
        "science and technology": "science", "health": "science", "climate and weather": "weather", "transportation": "other",
    },
}
# Days between close dates that a bucket allows, and cities by ticker suffix.
WINDOW_DAYS, DEFAULT_WINDOW_DAYS = {"sports": 1, "weather": 1}, 3
CITIES = {
    "NY": "new york", "CHI": "chicago", "MIA": "miami", "AUS": "austin", "LAX": "los angeles", "LA": "los angeles", "PHIL": "philadelphia",
    "DEN": "denver", "HOU": "houston", "SEA": "seattle", "SFO": "san francisco", "SF": "san francisco", "DAL": "dallas", "PHX": "phoenix",
    "DC": "washington",
}
# What a normalised title keeps no letter of, patterns over normalised titles, and the head of a ticker before its city.
DROPPED = r"[^a-z0-9 .+-]+"
HIGH = r"\b(highest|maximum|max|high temp)\b"
LOW = r"\b(lowest|minimum|min|low temp)\b"
HALVES = {"1st": r"\b(1st|first) half\b", "2nd": r"\b(2nd|second) half\b"}
MATCHUP = r"^[a-z0-9 .]+ vs [a-z0-9 .]+$"
WINNING = r"\b(win|wins|winner|beat|beats|moneyline)\b"
TICKER_HEAD = r"^KX(HIGH|LOW|MIN|MAX)?(TEMP)?"


def lookup(table: dict[str, str], key: Column, default: str | None = None) -> Column:
    found = F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items())))[key]
    return found if default is None else F.coalesce(found, F.lit(default))


def normalize_title(text: Column) -> Column:
    """[M1] Lower case; letters, digits, ``.``, ``+`` and ``-`` stay; single spaces."""
    kept = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), DROPPED, " ")
    return F.trim(F.regexp_replace(kept, " +", " "))


def category_bucket(platform: Column, category: Column) -> Column:
    """[M2] Coarse bucket of a venue's category, ``other`` where none is known."""
    key = F.lower(F.coalesce(category, F.lit("")))
    return F.when(platform == "pm", lookup(BUCKETS["pm"], key, "other")).otherwise(lookup(BUCKETS["k"], key, "other"))


def match_text(title: Column, raw_json: Column) -> Column:
    """[M3] The title, with the subtitle of the raw record where the title doesn't already say it."""
    sub = F.coalesce(F.get_json_object(raw_json, "$.yes_sub_title"), F.lit(""))
    said = F.contains(normalize_title(title), normalize_title(sub))
    return F.when((sub == "") | said, title).otherwise(F.concat(title, F.lit(" "), sub))


def numbers(text: Column) -> Column:
    """[M4] Sorted distinct numbers of a normalised title, without years."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), 1), lambda x: x.cast("double"))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: ~((x == F.floor(x)) & x.between(1900, 2100)))))


def extreme_class(text: Column) -> Column:
    """[M5] ``max``, ``min``, or null for neither or both."""
    high, low = text.rlike(HIGH), text.rlike(LOW)
    return F.when(high & ~low, "max").when(low & ~high, "min")


def half_class(text: Column) -> Column:
    """[M5] ``1st`` before ``2nd``, else null."""
    return F.when(text.rlike(HALVES["1st"]), "1st").when(text.rlike(HALVES["2nd"]), "2nd")


def _agree(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(True))


def compatible(a: Column, b: Column) -> Column:
    """[M6] Whether two normalised titles may state one proposition."""
    toss = [F.array_contains(F.split(t, " "), "toss") for t in (a, b)]
    bare = [t.rlike(MATCHUP) & (F.size(numbers(t)) == 0) & ~other.rlike(WINNING) for t, other in ((a, b), (b, a))]
    return (
        (numbers(a) == numbers(b))
        & _agree(extreme_class(a), extreme_class(b))
        & _agree(half_class(a), half_class(b))
        & (toss[0] == toss[1])
        & ~bare[0]
        & ~bare[1]
    )


def weather_city_ok(text: Column, series: Column) -> Column:
    """[M7] The city that the ticker names stands in the text; false where it is not known."""
    city = lookup(CITIES, F.regexp_replace(F.upper(series), TICKER_HEAD, ""))
    return F.coalesce(F.contains(text, city), F.lit(False))


def window_days(bucket: Column) -> Column:
    """[M10]"""
    return F.coalesce(F.create_map(*(F.lit(x) for x in chain.from_iterable(WINDOW_DAYS.items())))[bucket], F.lit(DEFAULT_WINDOW_DAYS))
