"""Operator 10: quality rules as one Spark projection.

A table of thresholds (RULES) is compiled into one boolean expression over
measures of each text: length, symbol, stop-word and line ratios. The measures
themselves are one higher-order SQL expression, so no user function runs and no
row is shuffled; documents are independent of each other.

Defined results: a null or empty text has no words, so every count is 0 and it
fails; extra columns of the input pass through ``measured`` and ``judged`` (a
clashing name is replaced by the measure); a null doc_id stays null; a very long text
is measured whole; an empty table gives an empty table; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is it for on as was by at this are from or an he not which "
    "le la les de des du et un une est dans que qui pour pas en au ce il sur avec se "
    "der die das und ist von zu den mit ein eine nicht im auf für sie dem es auch als "
    "el los las del y por con una para su al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """numerator / denominator must lie within [least, most]; rows with a denominator under ``since`` pass."""

    name: str
    numerator: str
    denominator: str = "1"
    least: float | None = None
    most: float | None = None
    since: int = 1


#: The production table. ``base_failed`` is a rule of its own (see BASE).
RULES = (
    Rule("length", "n_words", least=10),
    Rule("word_length", "word_chars", "n_words", least=2, most=14),
    Rule("symbols", "n_symbols", "n_words", most=0.1),
    Rule("shouting", "n_bangs", "n_words", most=0.25, since=20),
    Rule("stop_words", "n_stop_words", "n_words", least=0.01, since=100),
    Rule("repeated_lines", "n_dup_lines", "n_word_lines", most=0.5, since=4),
    Rule("bullet_lines", "n_bullet_lines", "n_word_lines", most=0.9, since=4),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_word_lines", most=0.3, since=4),
)
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and names it in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeated_words(w: str = "w", k: int = 5) -> str:
    """SQL: how many of the words w lie in k-word windows that occur twice or more.

    Window hashes are compared first; only if two are equal, the windows are sorted by
    hash, words and place, so that equal ones are neighbours whatever their hashes are,
    and the covered words are summed from the gaps between the repeated windows.
    """
    before, after = "o[if(j > 0, j - 1, j + 1)].t", "o[if(j < size(o) - 1, j + 1, j - 1)].t"
    found = f"filter(transform(sequence(0, size(o) - 1), j -> if({before} = o[j].t OR {after} = o[j].t, o[j].i, -1)), p -> p >= 0)"
    covered = f"if(size(p) = 0, 0L, aggregate(sequence(0, size(p) - 1), {k}L, (a, i) -> a + if(i = 0, 0L, least({k}L, cast(p[i] - p[if(i = 0, 0, i - 1)] AS bigint)))))"
    body = let(f"sort_array({found})", "p", covered)
    body = let(f"sort_array(transform(g, (x, i) -> named_struct('h', x, 't', slice({w}, i + 1, {k}), 'i', i)))", "o", body)
    body = let(f"transform(sequence(0, size(h) - {k}), i -> xxhash64({', '.join(f'h[i + {j}]' for j in range(k))}))", "g", f"if(size(array_distinct(g)) = size(g), 0L, {body})")
    return f"if(size({w}) <= {k}, 0L, {let(f'transform({w}, x -> xxhash64(x))', 'h', body)})"


def measures(text: str) -> Column:
    """One struct of all measures of a text column."""
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    t = f"coalesce({text}, '')"
    inner = f"""named_struct(
        'n_words', cast(size(w) AS bigint),
        'word_chars', cast(length(array_join(w, '')) AS bigint),
        'n_symbols', cast(length(regexp_replace(t, '[^#*$%&|<>]+', '')) AS bigint),
        'n_dup_lines', cast(size(l) - size(array_distinct(l)) AS bigint),
        'n_repeat_words', {repeated_words()},
        'n_bangs', cast(length(regexp_replace(t, '[^!]+', '')) AS bigint),
        'n_stop_words', cast(size(filter(w, x -> lower(x) IN ({stop}))) AS bigint),
        'n_word_lines', cast(size(l) AS bigint),
        'n_bullet_lines', cast(size(filter(l, x -> x RLIKE '^[ \\\\t]*[-*•‣]')) AS bigint),
        'n_ellipsis_lines', cast(size(filter(l, x -> x RLIKE '([.][.][.]|…)[ \\\\t\\\\r]*$')) AS bigint))"""
    word = WORD.replace("\\", "\\\\")
    return F.expr(let(t, "t", let(f"regexp_extract_all(t, '{word}', 0)", "w", let(f"filter(split(t, '\\\\n'), x -> x RLIKE '{word}')", "l", inner))))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_bangs", "n_stop_words", "n_word_lines", "n_bullet_lines", "n_ellipsis_lines")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a long column for each of MEASURES."""
    rest = [c for c in docs.columns if c not in MEASURES]
    return docs.select(*[docs[c] for c in rest], measures(f"`{text}`").alias("_m")).select(*rest, *[F.col("_m")[m].alias(m) for m in MEASURES])


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The table of thresholds as one boolean column over the measures."""
    ok = F.lit(True)
    for r in rules:
        n, d = F.expr(r.numerator).cast("double"), F.expr(r.denominator).cast("double")
        within = F.lit(True)
        if r.least is not None:
            within &= n >= d * F.lit(float(r.least))
        if r.most is not None:
            within &= n <= d * F.lit(float(r.most))
        ok &= (d < F.lit(float(r.since))) | within
    return ok


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with the measures, base_failed and kept."""
    m = measured(docs.drop("base_failed", "kept"), text)
    return m.withColumn("base_failed", F.expr(BASE)).withColumn("kept", ~F.col("base_failed") & passes(rules))
