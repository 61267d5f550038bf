"""DuckDB SQL builders for the correctness oracle.

The library's Spark code uses Java regexes with Unicode semantics; DuckDB uses RE2,
whose ``\\b``, ``\\w`` and ``\\s`` are ASCII-only and which has no look-around.  The
builders below spell the same rules out with explicit Unicode classes:

* word boundary around a pattern ``X``: ``(^|[^W])X([^W]|$)`` replaced by ``\\1 \\2``,
  run twice (adjacent matches share one separator);
* match counting with ``\\b``: count on a copy whose non-ASCII word characters are mapped
  to ``q`` (no rule mentions ``q``) and non-ASCII spaces to a blank;
* ``timeout`` not followed by ``fixed`` on the same line: per line, drop everything up to
  the last ``fixed`` and count ``timeout`` in the rest.
"""

from __future__ import annotations

from ..functions import rules as R
from .views import ERROR_TYPES, LOG_TEMPLATES

W = r'\p{L}\p{N}\p{M}\p{Pc}'
WS = r'\s\x0b\x85\p{Z}'


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def dbl(x: float) -> str:
    return f'CAST({x!r} AS DOUBLE)'


# ------------------------------------------------------------------ views
def _event_slots():
    return {
        'ts': "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')",
        'us_ts': "strftime(ts, '%m/%d/%Y %H:%M:%S')",
        'eu_ts': "strftime(ts, '%d-%m-%Y %H:%M:%S')",
        'lvl': 'upper(event_type)',
        'user': "concat('@dev', user_id)",
        'user_name': "concat('dev', user_id)",
        'ip': "concat('10.', user_id % 250, '.', event_id % 250, '.', event_id % 7 + 1)",
        'hex': "concat('0x', hex(event_id * 7919 + 4096))",
        'uuid': ("concat_ws('-', substr(md5(CAST(event_id AS VARCHAR)), 1, 8), substr(md5(CAST(event_id AS VARCHAR)), 9, 4), "
                 "substr(md5(CAST(event_id AS VARCHAR)), 13, 4), substr(md5(CAST(event_id AS VARCHAR)), 17, 4), "
                 "substr(md5(CAST(event_id AS VARCHAR)), 21, 12))"),
        'md5': 'md5(CAST(user_id AS VARCHAR))',
        'sha': 'sha1(CAST(event_id AS VARCHAR))',
        'pid': "concat('[', user_id * 13 + 100, ']')",
        'n': 'CAST(event_id % 1000 AS VARCHAR)',
        'k': 'CAST(event_id % 7 + 1 AS VARCHAR)',
        'path': "concat('/var/lib/ci/', event_type, '/run_', event_id % 50, '.log')",
    }


def _list(values):
    return '[' + ', '.join(lit(v) for v in values) + ']'


def ci_logs_sql() -> str:
    k = len(LOG_TEMPLATES)
    expr = f'{_list(LOG_TEMPLATES)}[event_id % {k} + 1]'
    for name, val in _event_slots().items():
        expr = f"replace({expr}, {lit('{' + name + '}')}, coalesce(CAST({val} AS VARCHAR), ''))"
    trace = ("CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('Traceback (most recent call last):' || chr(10) || "
             "'  at com.acme.', event_type, '.Runner.run(Runner.java:', event_id % 300, ')' || chr(10) || "
             "'  timeout handler ', CASE WHEN event_id % 3 = 0 THEN 'fixed' ELSE 'engaged' END) END")
    return (f'SELECT event_id AS log_id, user_id, event_type, {expr} AS log_text, '
            f'{_list(ERROR_TYPES)}[event_id % {k} + 1] AS error_type, {trace} AS stack_trace FROM events')


def doc_lines_sql() -> str:
    return ("SELECT doc_id, line_no, log_text FROM (SELECT doc_id, line_no, "
            f"regexp_replace(raw, '^[{WS}]+|[{WS}]+$', '', 'g') AS log_text FROM ("
            "SELECT doc_id, unnest(range(0, len(parts))) AS line_no, unnest(parts) AS raw FROM ("
            "SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))) "
            "WHERE log_text <> ''")


def all_logs_sql() -> str:
    return (f"SELECT 'events' AS source, log_id, CAST(0 AS BIGINT) AS line_no, log_text FROM ({ci_logs_sql()}) "
            f"UNION ALL SELECT 'documents' AS source, doc_id AS log_id, line_no, log_text FROM ({doc_lines_sql()})")


def preds_sql() -> str:
    h = "CAST(('0x' || substr(md5('score|' || CAST(d.doc_id AS VARCHAR)), 1, 8)) AS BIGINT)"
    si = f'({h} % 66 + l.quality * 35)'
    return ("SELECT d.doc_id, d.source, d.lang, d.n_chars, l.toxic, CAST(l.quality AS INTEGER) AS label, "
            f"CAST({si} AS DOUBLE) / 100.0 AS score, CASE WHEN {si} >= 50 THEN 1 ELSE 0 END AS prediction, "
            "CASE WHEN l.toxic = 0 THEN 'train' ELSE 'test' END AS split "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id")


def runs_sql() -> str:
    tp = 'sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END)'
    fp = 'sum(CASE WHEN label = 0 AND prediction = 1 THEN 1 ELSE 0 END)'
    fn = 'sum(CASE WHEN label = 1 AND prediction = 0 THEN 1 ELSE 0 END)'
    f1 = f'CASE WHEN 2 * {tp} + {fp} + {fn} > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END'
    correct = 'CASE WHEN label = prediction THEN 1 ELSE 0 END'
    return f"""
    SELECT b.source AS model, CASE WHEN b.lang IN ('en', 'fr') THEN 'ML' ELSE 'Text' END AS family,
           b.lang AS dataset, CASE WHEN b.lang IN ('en', 'de') THEN 1 ELSE 2 END AS run_seq,
           n_rows, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
           round(f1, 6) AS f1, round(train_seconds, 6) AS train_seconds, round(ms_per_row, 6) AS ms_per_row,
           round(memory_mb, 6) AS memory_mb,
           CASE WHEN b.lang IN ('en', 'fr') THEN NULL ELSE 3 END AS epochs,
           round(coalesce(overfit_gap, 0.0), 6) AS overfit_gap, round(cv_f1_mean, 6) AS cv_f1_mean,
           round(cv_f1_std, 6) AS cv_f1_std, round(train_seconds * 1.5, 6) AS train_cpu_seconds,
           round(pct_tokens_lost, 6) AS pct_tokens_lost
    FROM (SELECT source, lang, count(*) AS n_rows,
                 {correct.replace('CASE', 'sum(CASE', 1)}) / count(*) AS accuracy,
                 CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END AS precision,
                 CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END AS recall,
                 {f1} AS f1,
                 CAST(sum(n_chars) AS DOUBLE) / 1000.0 AS train_seconds, avg(n_chars) / 100.0 AS ms_per_row,
                 count(*) * CAST(8.0 AS DOUBLE) AS memory_mb,
                 avg(CASE WHEN split = 'train' THEN {correct} END)
                   - avg(CASE WHEN split = 'test' THEN {correct} END) AS overfit_gap,
                 sum(greatest(n_chars / 4 - 512, 0.0)) * 100 / greatest(sum(n_chars / 4), 1.0) AS pct_tokens_lost
          FROM preds GROUP BY source, lang) b
    JOIN (SELECT source, lang, avg(f1) AS cv_f1_mean, stddev_pop(f1) AS cv_f1_std
          FROM (SELECT source, lang, doc_id % 5 AS fold, {f1} AS f1 FROM preds GROUP BY source, lang, doc_id % 5)
          GROUP BY source, lang) c ON b.source = c.source AND b.lang = c.lang"""


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies are added)."""
    defs = {'ci_logs': ci_logs_sql, 'doc_lines': doc_lines_sql, 'all_logs': all_logs_sql,
            'preds': preds_sql, 'runs': runs_sql}
    order = ['ci_logs', 'doc_lines', 'all_logs', 'preds', 'runs']
    need = set(names)
    if 'runs' in need:
        need.add('preds')
    ctes = [f'{n} AS ({defs[n]()})' for n in order if n in need]
    return ('WITH ' + ', '.join(ctes) + ' ' + body) if ctes else body


# ------------------------------------------------------------------ rules
_BOUNDED = {
    r'\b(?:\d{1,3}\.){3}\d{1,3}\b': r'(?:\d{1,3}\.){3}\d{1,3}',
    r'\b[a-fA-F0-9]{32}\b': r'[a-fA-F0-9]{32}',
    r'\b[a-fA-F0-9]{40}\b': r'[a-fA-F0-9]{40}',
    r'\b[a-fA-F0-9]{64}\b': r'[a-fA-F0-9]{64}',
}


def _remove(expr: str, pattern: str) -> str:
    if pattern in _BOUNDED:
        p = f'(^|[^{W}]){_BOUNDED[pattern]}([^{W}]|$)'
        for _ in range(2):
            expr = f"regexp_replace({expr}, {lit(p)}, '\\1 \\2', 'gi')"
        return expr
    return f"regexp_replace({expr}, {lit(pattern)}, ' ', 'gi')"


def sql_clean(x: str, rules: R.Rules = R.DEFAULT_RULES) -> str:
    e = f"coalesce(CAST({x} AS VARCHAR), '')"
    for p in rules.remove_patterns:
        e = _remove(e, p)
    if rules.strip_special:
        e = f"regexp_replace({e}, '[^{W}{WS}.,:;!?\\-()]', ' ', 'g')"
    e = f"regexp_replace({e}, '[{WS}]+', ' ', 'g')"
    if rules.lowercase:
        e = f'lower({e})'
    return f'trim({e})'


def sql_relevant(x: str, rules: R.Rules = R.DEFAULT_RULES) -> str:
    t = f"coalesce({x}, '')"
    kw = ' OR '.join(f'contains(lower({t}), {lit(k)})' for k in rules.keywords) or 'false'
    return f'(length({t}) > 0 AND length({t}) >= {rules.min_len} AND length({t}) <= {rules.max_len} AND ({kw}))'


def _ascii_word_copy(x: str) -> str:
    e = f"coalesce(CAST({x} AS VARCHAR), '')"
    for cls in ('L', 'N', 'M', 'Pc'):
        e = f"regexp_replace({e}, '[^\\x00-\\x7F\\P{{{cls}}}]', 'q', 'g')"
    return f"regexp_replace({e}, '[\\x0b\\x85\\p{{Z}}]', ' ', 'g')"


_TIMEOUT = r'\btimeout\b(?!.*\bfixed\b)'


def _count(tq: str, p: str) -> str:
    if p == _TIMEOUT:
        return ("coalesce(list_sum(list_transform(string_split(" + tq + ", chr(10)), lambda l: "
                "len(regexp_extract_all(regexp_replace(l, '(?i)^.*\\bfixed\\b', ''), '(?i)\\btimeout\\b')))), 0)")
    return f'len(regexp_extract_all({tq}, {lit("(?i)" + p)}))'


def sql_scores(x: str) -> tuple[str, str]:
    tq = _ascii_word_copy(x)
    fs = ' + '.join(_count(tq, p) for p in R.FLAKY_PATTERNS)
    rs = ' + '.join(_count(tq, p) for p in R.REGRESSION_PATTERNS)
    return f'CAST(({fs}) AS DOUBLE)', f'CAST(({rs}) AS DOUBLE)'


def sql_label(x: str, fs: str, rs: str) -> str:
    """Label from already computed score columns ``fs``/``rs`` and the text ``x``."""
    t = f"coalesce(CAST({x} AS VARCHAR), '')"
    tq = _ascii_word_copy(x)
    neutral = ' OR '.join(f'regexp_matches({tq}, {lit("(?i)" + p)})' for p in R.NEUTRAL_PATTERNS)
    fallback = ' OR '.join(f'contains(lower({t}), {lit(w)})' for w in R.FALLBACK_REGRESSION_WORDS)
    return (f"CAST(CASE WHEN {t} = '' THEN 0 "
            f'WHEN {fs} = 0 AND {rs} = 0 THEN CASE WHEN {neutral} THEN 0 WHEN {fallback} THEN 1 ELSE 0 END '
            f'WHEN {rs} > {fs} THEN 1 WHEN {fs} > {rs} THEN 0 '
            f"WHEN contains(lower({t}), {lit(R.TIE_BREAK_WORD)}) THEN 1 ELSE 0 END AS INTEGER)")


def labelled(select_cols: str, text: str, src: str) -> str:
    """SELECT <cols>, label FROM src, scores computed once in a subquery."""
    fs, rs = sql_scores(text)
    return (f'SELECT {select_cols}, {sql_label(text, "fs", "rs")} AS label FROM '
            f'(SELECT *, {fs} AS fs, {rs} AS rs FROM {src}) _s')


def hash_sql(keys, seed=42, salt=None) -> str:
    parts = [lit(str(seed))] + ([lit(salt)] if salt else []) + [f'CAST({k} AS VARCHAR)' for k in keys]
    return f"md5(concat_ws('|', {', '.join(parts)}))"


def hex8_sql(h: str) -> str:
    return f"CAST(('0x' || substr({h}, 1, 8)) AS BIGINT)"


def hex15_sql(h: str) -> str:
    return f"CAST(('0x' || substr({h}, 1, 15)) AS BIGINT)"


def uniform_sql(keys, seed=42, salt=None) -> str:
    return f'({hex8_sql(hash_sql(keys, seed, salt))} / 4294967296.0)'
