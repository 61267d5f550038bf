"""Row-wise text operators as pure Column expressions.

No Python UDF, so they work unchanged on batch DataFrames and on ``readStream`` DataFrames.
Rule sets are constant arrays of (literal, pattern): a pattern is only tried on a text that
holds the literal all its matches hold, so a row costs one substring search per rule and a
regular expression per rule that may match.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import (COMPOSE_SEPARATOR, DEFAULT_LABEL_RULES, DEFAULT_RULES, KEPT_PUNCTUATION,
                    LABEL_NAMES, LabelRules, Rules, digest_length, java_pattern, required_literal)

_TRIM = r'(?U)^\s+|\s+$'


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _any(cols):
    cols = list(cols)
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def _text(c) -> Column:
    """null / non-string -> '' (the reproduced cleaner treats both as empty)."""
    return F.coalesce(_col(c).cast('string'), F.lit(''))


def regex_trim(c) -> Column:
    """Strip Unicode whitespace on both ends (``F.trim`` only strips spaces)."""
    return F.regexp_replace(_col(c), _TRIM, '')


def _folded(t: Column) -> Column:
    """Lower case, with the characters that a case-insensitive pattern takes for ASCII letters."""
    odd = F.translate(F.lower(F.translate(t, 'İ', 'i')), 'ıſ', 'is')
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(odd)


def _rules(patterns) -> Column:
    """(word, pattern) of each rule, as one constant."""
    items = [F.struct(F.lit(required_literal(p)).alias('word'), F.lit(java_pattern(p)).alias('pattern')) for p in patterns]
    return F.array(*items) if items else F.array().cast('array<struct<word:string,pattern:string>>')


def _bound(value: Column, use) -> Column:
    """``use(x)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


# ---------------------------------------------------------------- B1 clean_text
def _removed(text: Column, pattern: str) -> Column:
    """Matches become blanks; texts without the mark that all matches hold are left alone."""
    mark = max(re.split('[a-z]+', required_literal(pattern)), key=len)
    if not mark:
        return F.regexp_replace(text, java_pattern(pattern), ' ')
    return _bound(text, lambda t: F.when(F.contains(t, F.lit(mark)), F.regexp_replace(t, java_pattern(pattern), ' ')).otherwise(t))


def _without_digests(text: Column, patterns) -> Column:
    """Digests of several lengths become blanks; a search for a run of the least one comes first."""
    least = min(map(digest_length, patterns))
    return _bound(text, lambda t: F.when(t.rlike(f'[a-fA-F0-9]{{{least}}}'), reduce(_removed, patterns, t)).otherwise(t))


def clean_text(c, rules: Rules = DEFAULT_RULES) -> Column:
    """Remove timestamps, ids, paths, addresses, digests, tags; normalise; lower.

    Each removal pattern is applied in order and each match becomes one space.
    """
    out = _text(c)
    for digests, patterns in groupby(rules.remove_patterns, lambda p: digest_length(p) > 0):
        out = _without_digests(out, list(patterns)) if digests else reduce(_removed, patterns, out)
    if rules.strip_special:
        out = F.regexp_replace(out, r'(?U)[^\w\s' + KEPT_PUNCTUATION + ']', ' ')
    out = F.regexp_replace(out, r'(?U)\s+', ' ')
    return F.trim(F.lower(out) if rules.lowercase else out)  # the only white space left is blanks


# ---------------------------------------------------------------- B2 is_relevant
def is_relevant(c, rules: Rules = DEFAULT_RULES) -> Column:
    """Length in [min_len, max_len] (code points) and any keyword as a substring."""
    words = [k for k in dict.fromkeys(rules.keywords) if not any(o != k and o in k for o in rules.keywords)]

    def relevant(t: Column) -> Column:
        n = F.length(t)
        found = _bound(F.lower(t), lambda low: _any(F.contains(low, F.lit(k)) for k in words))
        return (n > 0) & (n >= rules.min_len) & (n <= rules.max_len) & found
    return _bound(_text(c), relevant)


# ---------------------------------------------------------------- B3 manual_features
def manual_feature_columns(c) -> dict:
    t = _text(c)
    low = F.lower(t)
    n = F.length(t)
    denom = F.greatest(n, F.lit(1))
    return {
        'feat_length': n,
        'feat_word_count': F.regexp_count(t, F.lit(r'(?U)\S+')).cast('int'),
        'feat_has_error': low.contains('error'),
        'feat_has_fail': low.contains('fail'),
        'feat_has_exception': low.contains('exception'),
        'feat_has_warning': low.contains('warning'),
        'feat_has_timeout': low.contains('timeout'),
        'feat_has_retry': low.contains('retry') | low.contains('flaky'),
        'feat_has_success': low.contains('success') | low.contains('passed'),
        'feat_exclamation_count': (n - F.length(F.replace(t, F.lit('!'), F.lit('')))).cast('int'),
        'feat_uppercase_ratio': F.regexp_count(t, F.lit(r'\p{IsUppercase}')) / denom,
        'feat_digit_ratio': F.regexp_count(t, F.lit(r'\p{Nd}')) / denom,
    }


def manual_features(df: DataFrame, text_column: str = 'cleaned_text') -> DataFrame:
    return df.withColumns(manual_feature_columns(text_column))


# ---------------------------------------------------------------- B4 label_scores
def _score(t: Column, patterns) -> Column:
    """Matches of all patterns."""
    def counted(low: Column) -> Column:
        may = F.filter(_rules(patterns), lambda p: F.contains(low, p['word']))
        return F.aggregate(may, F.lit(0), lambda n, p: n + F.regexp_count(t, p['pattern']))
    return _bound(_folded(t), counted).cast('double')


def label_scores(c, rules: LabelRules = DEFAULT_LABEL_RULES) -> tuple[Column, Column]:
    """(flaky_score, regression_score): sums of non-overlapping match counts."""
    t = _text(c)
    return _score(t, rules.flaky), _score(t, rules.regression)


# ---------------------------------------------------------------- B5 label
def label_from_scores(c, flaky: Column, regression: Column,
                      rules: LabelRules = DEFAULT_LABEL_RULES) -> Column:
    t = _text(c)
    low = F.lower(t)
    neutral = _bound(_folded(t), lambda f: F.exists(_rules(rules.neutral), lambda p: F.contains(f, p['word']) & F.regexp_like(t, p['pattern'])))
    fallback = _any(low.contains(w) for w in rules.fallback_words)
    tie = low.contains(rules.tie_word)
    return (F.when(t == '', 0)
            .when((flaky == 0) & (regression == 0),
                  F.when(neutral, 0).when(fallback, 1).otherwise(0))
            .when(regression > flaky, 1)
            .when(flaky > regression, 0)
            .when(tie, 1)
            .otherwise(0)).cast('int')


def label_logs(df: DataFrame, text_column: str = 'cleaned_text', include_scores: bool = False,
               rules: LabelRules = DEFAULT_LABEL_RULES) -> DataFrame:
    """Add ``label`` (0 flaky, 1 regression), optionally the two scores.

    Scores are materialised as columns once and the label reads them, so the 53
    patterns are evaluated a single time per row.
    """
    fs, rs = label_scores(text_column, rules)
    out = df.withColumns({'flaky_score': fs, 'regression_score': rs})
    out = out.withColumn('label', label_from_scores(text_column, F.col('flaky_score'),
                                                    F.col('regression_score'), rules))
    return out if include_scores else out.drop('flaky_score', 'regression_score')


# ---------------------------------------------------------------- B6 label_name
def label_name(c) -> Column:
    return F.when(_col(c) == 0, F.lit(LABEL_NAMES[0])).otherwise(F.lit(LABEL_NAMES[1]))


# ---------------------------------------------------------------- B7 compose_text
def compose_text(cols, sep: str = COMPOSE_SEPARATOR) -> Column:
    """Join columns with ``sep``; null parts become '' (separators are kept)."""
    parts = []
    for i, c in enumerate(cols):
        if i:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_col(c).cast('string'), F.lit('')))
    return F.concat(*parts)
