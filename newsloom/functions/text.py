"""Column functions over text: tokens, numbers, hashes, labels, dates and JSON.

All stay on the JVM; patterns name their character ranges, as Java's \\w and \\d are ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-zА-Яа-яЁё0-9]+"
LONG_TOKEN = "[а-яa-zё0-9]{3,}"
NUMBER = "[0-9]+(?:[.,][0-9]+)?"
TRUE_WORDS = ("true", "1", "yes", "y", "да", "истина", "t")
FALSE_WORDS = ("false", "0", "no", "n", "нет", "ложь", "f")


def safe_text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def tokens(x: Column) -> Column:
    """Distinct lower-cased letter and digit runs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(safe_text(x)), F.lit(TOKEN), 0))


def long_tokens(x: Column) -> Column:
    """Distinct lower-cased runs of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.lower(safe_text(x)), F.lit(LONG_TOKEN), 0))


def numbers(*texts: Column) -> Column:
    """Distinct numbers of several texts, with a decimal point."""
    out = None
    for t in texts:
        own = F.regexp_extract_all(F.regexp_replace(safe_text(t), ",", "."), F.lit(NUMBER), 0)
        out = F.array_distinct(own) if out is None else F.array_union(out, own)
    return out


def text_numbers(x: Column) -> Column:
    """Distinct numbers of one text, commas kept."""
    return F.array_distinct(F.regexp_extract_all(safe_text(x), F.lit(NUMBER), 0))


def jaccard(a: Column, b: Column) -> Column:
    """0 when both sets are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def word_count(x: Column) -> Column:
    """Unicode word runs."""
    return F.size(F.regexp_extract_all(safe_text(x), F.lit(r"(?U)\w+"), 0)).cast("long")


def space_word_count(x: Column) -> Column:
    return F.size(F.filter(F.split(safe_text(x), r"\s+"), lambda w: w != "")).cast("long")


def pair_count(n: Column) -> Column:
    return F.shiftright(n * (n - 1), 1).cast("long")


def news_id(x: Column) -> Column:
    """A trimmed id without the ``.0`` of a float."""
    return F.regexp_replace(F.trim(x.cast("string")), r"\.0$", "")


def content_hash(x: Column) -> Column:
    return F.sha2(safe_text(x), 256)


def stable_id(url: Column, title: Column, date: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", safe_text(url), safe_text(title), safe_text(date))), 1, 16)


def cluster_key(news: Column, prefix: str = "event") -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(news), 1, 12))


def days_between(a: Column, b: Column) -> Column:
    """Fractional days from a to b."""
    return (F.unix_micros(b) - F.unix_micros(a)) / F.lit(86_400e6)


def bool_like(x: Column) -> Column:
    """True or false for the usual words, null for others."""
    t = F.lower(F.trim(x.cast("string")))
    return F.when(t.isin(*TRUE_WORDS), True).when(t.isin(*FALSE_WORDS), False)


def slug(x: Column) -> Column:
    """Lower case; spaces, dashes and slashes become one underscore, other signs go."""
    return F.regexp_replace(F.regexp_replace(F.lower(safe_text(x)), r"[\s\-/]+", "_"), r"(?U)[^\w]", "")


def clean_lines(x: Column) -> Column:
    """Each line without its trailing blanks, the whole trimmed."""
    return F.trim(F.regexp_replace(safe_text(x), r"(?m)[ \t\r]+$", ""))


def probability_in_comment(x: Column) -> Column:
    return F.nullif(F.regexp_extract(x, r"p_significant=([0-9.]+)", 1), F.lit("")).cast("double")


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(x)


def label_of(x: Column, bounds: list[float], labels: list[str]) -> Column:
    """Right-closed bins; the last label has no upper bound."""
    out = F.when(x.isNull(), None)
    for hi, label in zip(bounds, labels, strict=False):
        out = out.when(x <= hi, label)
    return out.otherwise(labels[-1])


def json_map(x: Column) -> Column:
    return F.from_json(x, "map<string,string>")


def json_without(x: Column, key: str) -> Column:
    return F.to_json(F.map_filter(json_map(x), lambda k, v: k != key))


def json_with(x: Column, key: str, value: Column) -> Column:
    """The object with key set."""
    rest = F.map_filter(F.coalesce(json_map(x), F.create_map().cast("map<string,string>")), lambda k, v: k != key)
    return F.to_json(F.map_concat(rest, F.create_map(F.lit(key), value.cast("string"))))


def json_unquoted(x: Column) -> Column:
    """JSON that was stored as a JSON string, as what that string holds; any other JSON as it is."""
    return F.when(F.trim(x).startswith('"'), F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))).otherwise(x)


def significance_comment(p: Column, similarity: Column) -> Column:
    return F.format_string("p_significant=%.4f; max_prev_similarity=%.4f", p, similarity)


def length_of(x: Column, known: Column) -> Column:
    """A length computed before where there is one, else the text's."""
    return F.coalesce(known.cast("int"), F.length(safe_text(x))).cast("long")


def filled(x: Column) -> Column:
    """A feature without NaN, infinities or nulls, which become 0."""
    return F.coalesce(finite(x), F.lit(0.0))


def shown_date(ts: Column) -> Column:
    """A date; with its time unless that is midnight."""
    return F.when(F.date_trunc("day", ts) == ts, F.date_format(ts, "dd.MM.yyyy")).otherwise(F.date_format(ts, "dd.MM.yyyy HH:mm"))


def markdown_escaped(x: Column) -> Column:
    return F.regexp_replace(safe_text(x), r"([\\`*_{}\[\]()#+\-.!|>])", r"\\$1")


def moscow_day_start(ts: Column) -> Column:
    """The instant at which ts's day begins in Moscow, for a UTC session."""
    return F.to_utc_timestamp(F.date_trunc("day", F.from_utc_timestamp(ts, "Europe/Moscow")), "Europe/Moscow")
