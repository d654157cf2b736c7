"""Quality rules: a table of thresholds compiled into one projection, in DataFrame functions only.

``MEASURES`` says how each measure of a text is taken, ``RULES`` between which bounds
a ratio of measures must lie.  A document is measured and judged in the task that
reads it: no shuffle, no join, no user functions.

Words are runs of other characters than space and 0x09 to 0x0D; a line is what lies
between two ``\\n``, and counts if it has a word.  A three-word window is repeated if
the same three words are found twice or more in the text.  Windows are told apart by
sorting their hashes, and those with equal hashes by sorting their words, so that the
count is exact: n log n for a text of n words.

A null text is empty: it has no words, fails the base rule and isn't kept.  Ratios over
nothing are 0.  Repeated rows are judged each, null ids stay null, other columns are
ignored (``measured``) or kept as they are (``keep``); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the base rule.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50

#: Frequent words of English, German, French and Spanish: prose of any of these has two of them at least.
STOP_WORDS = """
the be to of and that have with a in is it for was on by as this are at from
der die und den von zu das mit sich auf des für ist nicht dem im ein als eine
de la le et les en un du une que pour est qui par dans sur au pas avec
el y los se del las por no con su una es para al lo
""".split()

WORDS = r"array_remove(split({t}, '[ \t\n\u000b\u000c\r]+'), '')"
LINES = r"filter(split({t}, '\n'), x -> translate(x, ' \t\n\u000b\u000c\r', '') <> '')"

#: Places of three-word windows whose hash (the upper half of a number, its place the lower) another window has.
ALIKE = """
element_at(transform(
  array(sort_array(transform(sequence(0, size({w}) - 3), i -> shiftleft(xxhash64({w}[i], {w}[i + 1], {w}[i + 2]), 32) + i))),
  s -> transform(
    filter(s, (x, k) -> shiftright(x, 32) <=> shiftright(get(s, k - 1), 32) or shiftright(x, 32) <=> shiftright(get(s, k + 1), 32)),
    x -> cast(x & 4294967295 as int)
  )
), 1)
"""

#: Of these the places whose words another of them has too, in order.
REPEATED_AT = f"""
element_at(transform(
  array(sort_array(transform({ALIKE}, i -> named_struct('g', concat_ws(' ', {{w}}[i], {{w}}[i + 1], {{w}}[i + 2]), 'i', i)))),
  s -> sort_array(transform(filter(s, (x, k) -> x.g <=> get(s, k - 1).g or x.g <=> get(s, k + 1).g), x -> x.i))
), 1)
"""

#: The words that windows at these places cover.
REPEATED = f"""
if(size({{w}}) < 4, 0L, aggregate({REPEATED_AT}, named_struct('n', 0L, 'upto', 0),
  (a, i) -> named_struct('n', a.n + i + 3 - greatest(i, a.upto), 'upto', i + 3), a -> a.n))
"""


def in_case(word: str) -> set[str]:
    return {word, word.capitalize(), word.upper()}


#: Measures as SQL over t (the text), w (its words) and l (its lines).
MEASURES = {
    "n_words": "size(w)",
    "word_chars": "char_length(array_join(w, ''))",
    "n_symbols": f"char_length(t) - char_length(translate(t, '{SYMBOLS}', ''))",
    "n_lines": "size(l)",
    "n_dup_lines": "size(l) - size(array_distinct(l))",
    "n_repeat_words": REPEATED.format(w="w"),
    "n_stop_words": "size(filter(w, x -> x in (" + ", ".join(f"'{x}'" for x in sorted(set().union(*map(in_case, STOP_WORDS)))) + ")))",
}


@dataclass(frozen=True)
class Rule:
    """A document passes if ``measure``, or its ratio to ``per``, lies in ``low`` to ``high``."""

    name: str
    measure: str
    per: str | None = None
    low: float | None = None
    high: float | None = None


#: The usual bounds of published web corpora.
RULES = (
    Rule("length", "n_words", None, LEAST_WORDS, 100_000),
    Rule("word_length", "word_chars", "n_words", 3, 10),
    Rule("symbols", "n_symbols", "n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", None, 2, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.3),
)


def compiled(rule: Rule, measure=F.col) -> Column:
    """Whether the rule fails; ratios are compared as products, so that they are exact where the bounds are decimals."""
    by = measure(rule.per) if rule.per else F.lit(1)
    fails = F.lit(False)
    if rule.low is not None:
        fails = fails | (measure(rule.measure) < F.lit(str(rule.low)).cast("decimal(18,6)") * by)
    if rule.high is not None:
        fails = fails | (measure(rule.measure) > F.lit(str(rule.high)).cast("decimal(18,6)") * by)
    return fails


def bound(name: str, value: str, body: str) -> str:
    """``body`` with a lambda's ``name`` for ``value``, which is thus evaluated once a row."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def measures(text: str) -> Column:
    """A struct of all measures of the text column ``text``."""
    every = ", ".join(f"'{name}', cast({sql} as bigint)" for name, sql in MEASURES.items())
    return F.expr(bound("t", f"coalesce(`{text}`, '')", bound("w", WORDS.format(t="t"), bound("l", LINES.format(t="t"), f"named_struct({every})"))))


def free(df: DataFrame, name: str) -> str:
    while name in df.columns:
        name += "_"
    return name


def judged(docs: DataFrame, text_col: str, rules: Sequence[Rule], into: str) -> DataFrame:
    """The rows with a struct ``into`` of the measures, base_failed, failed (names of the rules that fail) and kept."""
    raw = free(docs, f"{into}_m")
    one = docs.withColumn(raw, measures(text_col))
    at = lambda name: F.col(raw)[name]
    base = (at("n_words") < LEAST_WORDS) | (at("n_repeat_words") * 100 > at("n_words") * MOST_REPEATED)
    failed = F.array_compact(F.array(*[F.when(compiled(r, at), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    kept = ~base & (F.size(failed) == 0)
    found = F.struct(*[at(name).alias(name) for name in MEASURES], base.alias("base_failed"), failed.alias("failed"), kept.alias("kept"))
    return one.withColumn(into, found).drop(raw)


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measures, base_failed, failed and kept of every row."""
    pair = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return judged(pair, "text", rules, "q").select("doc_id", "q.*")


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """The rows that pass, with their own columns."""
    name = free(docs, "quality")
    return judged(docs, text_col, rules, name).where(F.col(f"{name}.kept")).select(*[F.col(f"`{c}`") for c in docs.columns])
