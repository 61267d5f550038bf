"""SQL that fits and applies boosted stumps: the oracle of the model queries.

The rounds are unrolled, each a few common table expressions over the binned rows; ``k`` tells
fits apart that run side by side (the folds of a cross-validation).
"""

from __future__ import annotations

from ..models import boosting as B
from ..models import trees as T
from . import oracle as O

FEATURES = ['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']
KEYS = ['l_orderkey', 'l_linenumber', 'l_partkey', 'l_suppkey']
_K = range(len(FEATURES))
_BS = ', '.join(f'b{i}' for i in _K)

LINES = f"""lines AS (SELECT {', '.join(KEYS)}, {', '.join(FEATURES)}, CAST(l_returnflag = 'R' OR l_extendedprice > 1500 * l_quantity AS INTEGER) AS label,
  {O.uniform_sql(KEYS, 42, 'split')} < 0.2 AS test, row_number() OVER () AS row FROM lineitem)"""

_AT = ', '.join(f'{i}/{T.BINS - 1}::DOUBLE' for i in range(1, T.BINS - 1))
BINS = ['edges AS (SELECT ' + ', '.join(f'list_sort(list_distinct(list_filter(quantile_disc({f}, [{_AT}]), lambda q: q < max({f})))) AS e{i}' for i, f in enumerate(FEATURES))
        + ' FROM lines WHERE NOT test)',
        'coded AS (SELECT lines.*, ' + ', '.join(f'CASE WHEN {f} IS NULL THEN 0 ELSE 1 + len(list_filter(e{i}, lambda e: e < {f})) END AS b{i}' for i, f in enumerate(FEATURES))
        + ' FROM lines, edges)']


def cells(part: str, where: str) -> list[str]:
    rid = f"{O.hex8_sql(f'''md5(concat_ws('|', '42', {_BS}, y, part))''')} % {T.MODULUS - 1} + 1"
    return [f'cells AS (SELECT *, {rid} AS rid FROM (SELECT {_BS}, label AS y, {part} AS part, CAST(count(*) AS DOUBLE) AS n FROM coded WHERE {where} GROUP BY {_BS}, y, part))']


def boosted(held: list[int], spec: T.Spec = B.PRESETS['gb_benchmark']) -> list[str]:
    """s0, s1, ...: binned rows with their score ``m`` after that many rounds, by fit ``k``
    (``held`` names the part that each sets aside); stumps: (k, t, f, b, vl, vr, gain)."""
    out = [f"fits AS (SELECT unnest([{', '.join(map(str, held))}]) AS k)",
           's0 AS (SELECT fits.k, cells.*, ln(sum(CASE WHEN y = 1 AND part <> fits.k THEN n END) OVER (PARTITION BY fits.k)'
           ' / sum(CASE WHEN y = 0 AND part <> fits.k THEN n END) OVER (PARTITION BY fits.k)) AS m FROM cells, fits)']
    for t in range(1, spec.rounds + 1):
        draw = f'(rid * {pow(T.MULTIPLIER, t, T.MODULUS)} % {T.MODULUS}) / {T.MODULUS}::DOUBLE'
        side = ' UNION ALL '.join(f'SELECT k, {i} AS f, b{i} AS b, g, h, w FROM g{t}' for i in _K)
        picked = 'CASE b.f ' + ' '.join(f'WHEN {i} THEN b{i}' for i in _K) + ' END'
        out += [
            f'g{t} AS (SELECT k, {_BS}, w, w * (p - y) AS g, w * p * (1 - p) AS h FROM (SELECT *, CASE WHEN part = k THEN 0.0 ELSE floor(n * {spec.subsample} + {draw}) END AS w,'
            f' 1 / (1 + exp(-m)) AS p FROM s{t - 1}))',
            f'h{t} AS (SELECT k, f, b, sum(g) AS g, sum(h) AS h, sum(w) AS w FROM ({side}) GROUP BY k, f, b)',
            f'c{t} AS (SELECT k, f, b, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(w) OVER l AS wl, sum(g) OVER a AS ga, sum(h) OVER a AS ha, sum(w) OVER a AS wa FROM h{t}'
            ' WINDOW l AS (PARTITION BY k, f ORDER BY b), a AS (PARTITION BY k, f))',
            f'b{t} AS (SELECT *, gl * gl / wl + (ga - gl) * (ga - gl) / (wa - wl) - ga * ga / wa AS gain FROM c{t} WHERE wl >= {spec.min_rows} AND wa - wl >= {spec.min_rows} AND wa >= {spec.min_split}'
            ' QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, b) = 1)',
            f'v{t} AS (SELECT a.k, {t} AS t, CASE WHEN b.gain > 1e-9 THEN b.f END AS f, b.b, b.gain, b.wa, -{spec.rate} * b.gl / b.hl AS vl, -{spec.rate} * (b.ga - b.gl) / (b.ha - b.hl) AS vr,'
            f' -{spec.rate} * a.ga / a.ha AS v0 FROM (SELECT k, any_value(ga) AS ga, any_value(ha) AS ha FROM c{t} WHERE f = 0 GROUP BY k) a LEFT JOIN b{t} b ON b.k = a.k)',
            f's{t} AS MATERIALIZED (SELECT s.* EXCLUDE (m), s.m + CASE WHEN b.f IS NULL THEN b.v0 WHEN {picked} <= b.b THEN b.vl ELSE b.vr END AS m FROM s{t - 1} s JOIN v{t} b ON b.k = s.k)']
    out.append('stumps AS (' + ' UNION ALL '.join(f'SELECT * FROM v{t}' for t in range(1, spec.rounds + 1)) + ')')
    curve = ' UNION ALL '.join(f'SELECT k, {t} AS t, part = k AS held, y, n, m FROM s{t}' for t in range(1, spec.rounds + 1))
    out.append('curve AS (SELECT k, t, held, sum(n) AS n, sum(n * ln(1 + exp(CASE WHEN y = 1 THEN -m ELSE m END))) AS loss, coalesce(sum(CASE WHEN m > 0 AND y = 1 THEN n END), 0) AS tp,'
               f' coalesce(sum(CASE WHEN m > 0 AND y = 0 THEN n END), 0) AS fp, coalesce(sum(CASE WHEN m <= 0 AND y = 1 THEN n END), 0) AS fn FROM ({curve}) GROUP BY k, t, held)')
    return out


def adaboosted(spec: T.Spec = B.PRESETS['ada_benchmark']) -> list[str]:
    """The same tables for SAMME over stumps; after the round that ends the fit, alpha is null
    and the trees say nothing."""
    out = ['s0 AS (SELECT 0 AS k, cells.*, 0.0::DOUBLE AS m FROM cells)', 'v0 AS (SELECT 1.0::DOUBLE AS alpha)']
    for t in range(1, spec.rounds + 1):
        side = ' UNION ALL '.join(f'SELECT {i} AS f, b{i} AS b, w, y, n FROM w{t}' for i in _K)
        picked = 'CASE b.f ' + ' '.join(f'WHEN {i} THEN b{i}' for i in _K) + ' END'
        out += [
            f'w{t} AS (SELECT {_BS}, y, n, w * (SELECT sum(n) FROM cells) / sum(w) OVER () AS w FROM (SELECT *, n * exp(-0.5 * (2 * y - 1) * m) AS w FROM s{t - 1}))',
            f'h{t} AS (SELECT f, b, sum(w * y) AS g, sum(w) AS d, sum(n) AS n FROM ({side}) GROUP BY f, b)',
            f'c{t} AS (SELECT f, b, sum(g) OVER l AS gl, sum(d) OVER l AS dl, sum(n) OVER l AS nl, sum(g) OVER a AS ga, sum(d) OVER a AS da, sum(n) OVER a AS na FROM h{t}'
            ' WINDOW l AS (PARTITION BY f ORDER BY b), a AS (PARTITION BY f))',
            f'b{t} AS (SELECT *, gl * gl / dl + (ga - gl) * (ga - gl) / (da - dl) - ga * ga / da AS gain FROM c{t} WHERE nl >= 1 AND na - nl >= 1 QUALIFY row_number() OVER (ORDER BY gain DESC, f, b) = 1)',
            f'e{t} AS (SELECT *, (least(gl, dl - gl) + least(ga - gl, (da - dl) - (ga - gl))) / da AS err FROM b{t})',
            f'a{t} AS (SELECT e.*, CASE WHEN p.alpha IS NOT NULL AND err < 0.5 AND err > 1e-12 THEN {spec.rate} * ln((1 - err) / err) END AS alpha FROM e{t} e, v{t - 1} p)',
            f'v{t} AS (SELECT 0 AS k, {t} AS t, f, b, gain, na AS wa, alpha, CASE WHEN gl > dl - gl THEN 1 ELSE -1 END * coalesce(alpha, 0) AS vl,'
            f' CASE WHEN ga - gl > (da - dl) - (ga - gl) THEN 1 ELSE -1 END * coalesce(alpha, 0) AS vr FROM a{t})',
            f's{t} AS MATERIALIZED (SELECT s.* EXCLUDE (m), s.m + CASE WHEN {picked} <= b.b THEN b.vl ELSE b.vr END AS m FROM s{t - 1} s, v{t} b)']
    out.append('stumps AS (' + ' UNION ALL '.join(f'SELECT k, t, f, b, gain, wa, vl, vr, 0.0::DOUBLE AS v0 FROM v{t}' for t in range(1, spec.rounds + 1)) + ')')
    return out


def scored(spec: T.Spec = B.PRESETS['gb_benchmark']) -> list[str]:
    """stage: (row, t, m): the score of the test rows after each round."""
    picked = 'CASE f ' + ' '.join(f'WHEN {i} THEN b{i}' for i in _K) + ' END'
    base = '(SELECT any_value(m) FROM s0)'
    return [f'stage AS (SELECT row, t, label, {base} + sum(CASE WHEN f IS NULL THEN v0 WHEN {picked} <= b THEN vl ELSE vr END) OVER (PARTITION BY row ORDER BY t) AS m FROM coded, stumps WHERE test)']


def query(parts: list[str], select: str) -> str:
    return 'WITH ' + ',\n'.join(parts) + '\n' + select


_TRAIN = [LINES, *BINS, *cells('0', 'NOT test'), *boosted([-1])]
_ROUNDS = B.PRESETS['gb_benchmark'].rounds
_COUNTS = """counts AS (SELECT count(*) AS n, count(CASE WHEN m > 0 AND label = 1 THEN 1 END) AS tp, count(CASE WHEN m > 0 AND label = 0 THEN 1 END) AS fp,
  count(CASE WHEN m <= 0 AND label = 1 THEN 1 END) AS fn, count(CASE WHEN m <= 0 AND label = 0 THEN 1 END) AS tn FROM stage WHERE t = %d)"""
_METRICS = """SELECT round((tp + tn) / n, 6) AS accuracy, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
  round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1,
  n AS n_rows, true AS timed FROM counts"""

EVALUATE = query([*_TRAIN, *scored(), _COUNTS % _ROUNDS], _METRICS)
ADABOOST = query([LINES, *BINS, *cells('0', 'NOT test'), *adaboosted(), *scored(), _COUNTS % B.PRESETS['ada_benchmark'].rounds], _METRICS)
PREDICT = query([*_TRAIN, *scored()], f"""SELECT {', '.join('c.' + c for c in KEYS)}, CAST(m > 0 AS INTEGER) AS prediction,
  round(1 - 1 / (1 + exp(-m)), 6) AS probability_0, round(1 / (1 + exp(-m)), 6) AS probability_1 FROM stage JOIN coded c USING (row) WHERE t = {_ROUNDS}""")
MARGINS = query([*_TRAIN, *scored()], f"SELECT {', '.join('c.' + c for c in KEYS)}, round(m, 6) AS margin FROM stage JOIN coded c USING (row) WHERE t = {_ROUNDS}")
STAGED = query([*_TRAIN, *scored()], """SELECT CAST(t AS INTEGER) AS round, round(coalesce(2 * tp / (2 * tp + fp + fn), 0), 6) AS f1 FROM (
  SELECT t, count(CASE WHEN m > 0 AND label = 1 THEN 1 END) AS tp, count(CASE WHEN m > 0 AND label = 0 THEN 1 END) AS fp, count(CASE WHEN m <= 0 AND label = 1 THEN 1 END) AS fn
  FROM stage GROUP BY t)""")
DEVIANCE = query(_TRAIN, 'SELECT CAST(t AS INTEGER) AS round, round(2 * loss / n, 6) AS deviance FROM curve')
IMPORTANCE = query(_TRAIN, f"""SELECT n.feature, round(coalesce(count(s.f) / (SELECT count(f) FROM stumps), 0), 6) AS importance
FROM (SELECT unnest({FEATURES!r}) AS feature, unnest(range({len(FEATURES)})) AS f) n LEFT JOIN stumps s ON s.f = n.f GROUP BY n.feature""")
NODES = query(_TRAIN, f"""SELECT CAST(t AS INTEGER) AS round, ({FEATURES!r})[f + 1] AS feature, CAST(b AS INTEGER) AS cut,
  CASE f {' '.join(f'WHEN {i} THEN e{i}[b]' for i in _K)} END AS threshold, round(vl, 6) AS left_value, round(vr, 6) AS right_value, round(gain, 6) AS gain, wa AS rows FROM stumps, edges""")
STATS = query(_TRAIN, f"""SELECT CAST(n AS BIGINT) AS n_rows, {len(FEATURES)} AS n_features, {_ROUNDS} AS rounds, {_ROUNDS} AS best_round, round(2 * loss / n, 6) AS last_deviance, true AS timed
FROM curve WHERE t = {_ROUNDS}""")
STOPPED = query([LINES, *BINS, *cells('CAST(test AS INTEGER)', 'true'), *boosted([1]),
                 'seen AS (SELECT h.t, arg_min(p.t, p.loss) AS best FROM curve h JOIN curve p ON p.held AND p.t <= h.t WHERE h.held GROUP BY h.t)',
                 f'ended AS (SELECT coalesce(min(CASE WHEN t - best >= {B.PATIENCE} THEN t END), {_ROUNDS}) AS t FROM seen)'],
                f"""SELECT CAST(c.n AS BIGINT) AS n_rows, {len(FEATURES)} AS n_features, CAST(e.t AS INTEGER) AS rounds, CAST(s.best AS INTEGER) AS best_round,
  round(2 * c.loss / c.n, 6) AS last_deviance, true AS timed FROM ended e JOIN seen s ON s.t = e.t JOIN curve c ON c.t = e.t AND NOT c.held""")



def cross_validated(k: int) -> str:
    """Folds inside the classes by hash order."""
    fold = [f"folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY {O.hash_sql(KEYS)}, {', '.join(KEYS)}) - 1) % {k} AS INTEGER) AS fold FROM coded WHERE NOT test)"]
    rows = cells('fold', 'true')[0].replace('FROM coded', 'FROM folded')
    return query([LINES, *BINS, *fold, rows, *boosted(list(range(k)))], f"""SELECT round(avg(f1), 6) AS cv_f1_mean, round(stddev_pop(f1), 6) AS cv_f1_std, list(round(f1, 6) ORDER BY k) AS cv_f1
FROM (SELECT k, coalesce(2 * tp / (2 * tp + fp + fn), 0) AS f1 FROM curve WHERE held AND t = {_ROUNDS})""")
