"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are what ``WORD`` matches in the whole text. Every metric is made from the words and lines of one row by
array functions, so nothing is shuffled and a row's cost follows its own length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricetide.llm.common import WORD

WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it not of on or that the this to was with "
    "als auf das den der des die ein für ist mit sich und von zu "
    "au dans des du en est et la le les par pour que qui sur un une "
    "al con de del el las lo los para por se su una y"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text whose ``metric`` lies within the bounds."""

    metric: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", high=0.1),
    Rule("letter_word_ratio", 0.7),
    Rule("capital_word_ratio", high=0.4),
    Rule("stop_word_ratio", 0.06),
    Rule("same_as_before_ratio", high=0.2),
    Rule("dup_line_ratio", high=0.5),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _share(words: Column, condition) -> Column:
    return F.size(F.filter(words, condition)) / F.greatest(F.size(words), F.lit(1))


def _repeated_words(words: Column, k: int) -> Column:
    """Words in k-word windows that are found twice or more; windows are compared by 64-bit hashes."""
    starts = F.sequence(F.lit(1), F.size(words) - F.lit(k - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(k))))

    def covered(hashes: Column) -> Column:
        def at_twice(by_hash: Column) -> Column:
            same = lambda e, i: F.coalesce(F.get(by_hash, i)["h"] == e["h"], F.lit(False))
            twice = F.filter(by_hash, lambda e, i: same(e, i - 1) | same(e, i + 1))
            at = F.sort_array(F.transform(twice, lambda e: e["i"]))
            start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
            step = lambda a, i: F.struct((i + k).alias("end"), (a["n"] + i + k - F.greatest(a["end"], i)).alias("n"))
            return F.aggregate(at, start, step, lambda a: a["n"])

        by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(by_hash, at_twice)).otherwise(F.lit(0))

    return F.when(F.size(words) > k, _let(hashes, covered)).otherwise(F.lit(0))


def measure(text: Column) -> Column:
    """A struct of all counts and ratios of a whole text; a null text counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))

    def of_words(words: Column) -> Column:
        n = F.greatest(F.size(words), F.lit(1))
        chars = F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w))
        symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>]"))
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
        stop = _share(words, lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(STOP_WORDS))
        return _let(
            lines,
            lambda lines: _let(
                F.size(lines) - F.size(F.array_distinct(lines)),
                lambda dup: F.struct(
                    F.size(words).cast("long").alias("n_words"),
                    chars.alias("word_chars"),
                    symbols.cast("long").alias("n_symbols"),
                    dup.cast("long").alias("n_dup_lines"),
                    _repeated_words(words, WINDOW).cast("long").alias("n_repeat_words"),
                    (chars / n).alias("mean_word_chars"),
                    (symbols / n).alias("symbol_ratio"),
                    _share(words, lambda w: w.rlike(r"\p{L}")).alias("letter_word_ratio"),
                    _share(words, lambda w: ~w.rlike(r"\p{Ll}") & w.rlike(r"\p{Lu}.*\p{Lu}")).alias("capital_word_ratio"),
                    stop.alias("stop_word_ratio"),
                    _share(words, lambda w, i: F.coalesce(F.get(words, i - 1) == w, F.lit(False))).alias("same_as_before_ratio"),
                    (dup / F.greatest(F.size(lines), F.lit(1))).alias("dup_line_ratio"),
                ),
            ),
        )

    return _let(F.regexp_extract_all(text, F.lit(f"({WORD})")), of_words)


def passes(metrics: Column, rules=RULES) -> Column:
    """The rule table as one boolean expression."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict &= metrics[rule.metric] >= rule.low
        if rule.high is not None:
            verdict &= metrics[rule.metric] <= rule.high
    return verdict


def quality(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept and the ratios, for every row.

    Null and empty texts have no words, so they fail the base rule. Null ids and repeated rows are rows like
    others; an empty table gives none; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), measure(F.col("text")).alias("_m"))
    m = F.col("_m")
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    ratios = sorted({r.metric for r in rules})
    return rows.select("doc_id", *(m[c].alias(c) for c in counts), failed.alias("base_failed"), (~failed & passes(m, rules)).alias("kept"), *(m[c].alias(c) for c in ratios))


def sql(rules=RULES) -> str:
    """The same in DuckDB SQL over ``documents``."""
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    verdict = " and ".join(f"{r.metric} {op} {bound}" for r in rules for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None)
    ratios = ", ".join(sorted({r.metric for r in rules}))
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
l as (select r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
win as (select r, unnest(range(1, len(w) - {WINDOW - 2})) as i, w from d where len(w) >= {WINDOW}),
hit as (select r, i from (select r, i, count(*) over (partition by r, array_to_string(w[i:i+{WINDOW - 1}], ' ')) as c from win) where c > 1),
cov as (select r, count(distinct i + o) as c from hit, range(0, {WINDOW}) as t(o) group by r),
m as (select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c, 0) as n_repeat_words,
  greatest(len(w), 1)::double as n,
  len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / n as letter_word_ratio,
  len(list_filter(w, lambda x: not regexp_matches(x, '\p{{Ll}}') and regexp_matches(x, '\p{{Lu}}.*\p{{Lu}}'))) / n as capital_word_ratio,
  len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') in ({stop}))) / n as stop_word_ratio,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i-1])) / n as same_as_before_ratio,
  (len(l) - len(list_distinct(l))) / greatest(len(l), 1)::double as dup_line_ratio
  from d join l using (r) left join cov using (r)),
k as (select *, word_chars / n as mean_word_chars, n_symbols / n as symbol_ratio,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {verdict} as kept, {ratios} from k"""
