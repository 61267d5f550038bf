"""The literal in front of each pattern never hides a match."""

import random
import re

from pyspark.sql import functions as F

from logtriage.functions import rules as R
from logtriage.functions import text as T

ALL = [*R.DEFAULT_REMOVE_PATTERNS, *R.PRESET2_REMOVE_PATTERNS, *R.FLAKY_PATTERNS, *R.REGRESSION_PATTERNS, *R.NEUTRAL_PATTERNS]
PIECES = ['flaky', 'FLAKY', 'ﬂaky', 'time', 'out', 'timeout', 'TIMEOUT', 'fixed', ' ', '\n', '  ', 'connection', 'refused', 'timed out', 'non-deterministic', 'random', 'ly', 'fail', 'bug', 'Kritik',
          'ſkipped', 'skipped', 'İgnored', 'ıgnored', 'known issue', 'wont fix', 'null', 'pointer', 'nullpointer', 'stack overflow', 'out of memory', 'index out of bounds', 'type error', 'linker error',
          'expected', 'but got', 'mismatch', 'passed', 'Pass', 'completed', 'ınfo', 'debug', 'error', '2024-01-15T10:30:45.123Z', '01/02/2024 10:11:12', '/var/log/x.log', 'C:\\a\\b', '10.0.0.1', '0xFF', '0XaB',
          'd41d8cd98f00b204e9800998ecf8427e', '[33]', '#12', '@bob', '123e4567-e89b-12d3-a456-426614174000', '.', '-', 'Straße', 'memory leak', 'heap corruption', 'segfault']


def texts():
    rnd = random.Random(11)
    return [''.join(rnd.choice(PIECES) + rnd.choice(['', ' ', ' ', '_']) for _ in range(rnd.randrange(12))) for _ in range(1500)] + ['', None]


def test_literals_stand_in_every_match():
    for p in ALL:
        word = R.required_literal(p)
        for t in filter(None, texts()):
            for m in re.finditer(p, t, re.IGNORECASE):
                assert word in m[0].lower().replace('ı', 'i').replace('ſ', 's').replace('i̇', 'i')
    assert R.required_literal('a|b') == '' and R.required_literal('(?:ab)?c+') == 'c' and R.required_literal('(') == ''


def test_prefiltered_scores_equal_the_plain_expressions(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], 'id int, t string')
    t = F.coalesce('t', F.lit(''))
    fs, rs = T.label_scores('t')
    plain = [sum((F.regexp_count(t, F.lit(R.java_pattern(p))) for p in ps), F.lit(0)).cast('double') for ps in (R.FLAKY_PATTERNS, R.REGRESSION_PATTERNS)]
    clean = t
    for p in R.DEFAULT_REMOVE_PATTERNS:
        clean = F.regexp_replace(clean, R.java_pattern(p), ' ')
    clean = F.trim(F.regexp_replace(F.regexp_replace(clean, r'(?U)[^\w\s' + R.KEPT_PUNCTUATION + ']', ' '), r'(?U)\s+', ' '))
    out = df.select(fs.alias('f'), rs.alias('r'), plain[0].alias('pf'), plain[1].alias('pr'), T.clean_text('t').alias('c'), F.lower(clean).alias('pc')).collect()
    assert all(r.f == r.pf and r.r == r.pr and r.c == r.pc for r in out)
    assert sum(r.f > 0 for r in out) > 100 and sum(r.r > 0 for r in out) > 100
    none = df.select(*T.label_scores('t', R.LabelRules(flaky=(), regression=(), neutral=()))).distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0.0)]
