"""Secret scans: pattern spans per text, plus multipart credential linking (DataFrame only).

Strong spans (``assign``, ``access``, ``hex``) are reported always.  Weak parts
(identifiers, unlabelled high-entropy tokens, endpoints) are reported only when a
complementary part lies in the same scope: a secret part next to an identity or endpoint
part.  A scope is a part's interval widened by ``reach`` code points on either side; the
join of intervals is an equi-join on (row key, bin of ``reach`` code points) with an
overlap condition, so its cost follows the number of parts, not its square.

Edge cases: null text is empty and has no spans; a null ``doc_id`` keeps its row; repeated
rows each get their result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_key, keyed, on_key, renamed, written

#: kind -> (Java pattern, group whose length counts, least length).  Keyword letters match
#: in either case, ASCII only.  {n,} equals "maximal run, then drop the short" for the
#: two kinds that are single character runs.
STRONG = {
    'assign': (r'''((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)''', 2, 8),
    'access': (r'AKIA[A-Z0-9]{12,}+', 0, 16),
    'hex': (r'[0-9a-f]{32,}+', 0, 32),
}
#: Weak parts: identities, secrets without a label, endpoints.
WEAK = {
    'identity': (r'''(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)''', 1, 4),
    'entropy': (r'(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+={0,2}', 0, 20),
    'endpoint': (r'''(?i:https?|ftp|ssh|s3|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+''', 0, 10),
}
KINDS = [*STRONG, *WEAK]
#: What part of a credential each kind is.
PART = {'assign': 'secret', 'hex': 'secret', 'entropy': 'secret', 'access': 'identity', 'identity': 'identity',
        'endpoint': 'endpoint'}
SPAN = 'array<struct<s:int,k:int,e:int>>'


def match_spans(text: Column, kind: str, rule: tuple) -> Column:
    """Spans (s, k, e) of the leftmost non-overlapping matches, in code points.

    ``split`` gives the text between the matches and ``regexp_extract_all`` the matches,
    so positions are running sums of their lengths.
    """
    pattern, group, least = rule
    lit = F.lit(pattern)
    between, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, lit, F.lit(0))
    counted = F.regexp_extract_all(text, lit, F.lit(group)) if group else whole
    sizes = F.transform(F.arrays_zip(whole.alias('w'), counted.alias('c'), between.alias('b')),
                        lambda x: F.struct(F.length(x['b']).alias('b'), F.length(x['w']).alias('w'), F.length(x['c']).alias('c')))
    zero = F.struct(F.lit(0).alias('at'), F.array().cast(SPAN).alias('out'))

    def step(acc, x):
        s = acc['at'] + x['b']
        e = s + F.coalesce(x['w'], F.lit(0))
        one = F.array(F.struct(s.alias('s'), F.lit(KINDS.index(kind)).alias('k'), e.alias('e')))
        return F.struct(e.alias('at'), F.when(x['c'] >= least, F.concat(acc['out'], one)).otherwise(acc['out']).alias('out'))

    return F.when(text.rlike(pattern), F.aggregate(sizes, zero, step, lambda acc: acc['out'])).otherwise(F.array().cast(SPAN))


def _overlaps(a: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (a['s'] < b['e']) & (b['s'] < a['e']))


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, th, strong, weak) per input row; weak parts that touch a strong span go."""
    k = keyed(docs)
    t = F.col('text')
    df = k.select('doc_id', 'th', *[match_spans(t, n, r).alias(n) for n, r in (STRONG | WEAK).items()])
    df = df.select('doc_id', 'th', F.array_sort(F.concat(*STRONG)).alias('strong'), F.concat(*WEAK).alias('weak'))
    return df.select('doc_id', 'th', 'strong', F.filter('weak', lambda w: ~_overlaps(w, F.col('strong'))).alias('weak'))


def linked_weak(found: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, th, linked): the weak spans with a complementary part within ``reach``."""
    part = F.create_map(*[x for i, n in enumerate(KINDS) for x in (F.lit(i), F.lit(PART[n]))])
    rows = (found.filter(F.size('weak') > 0).select('doc_id', 'th', F.explode(F.concat('strong', 'weak')).alias('x'))
            .distinct().select('doc_id', 'th', 'x.*').withColumn('part', part[F.col('k')]))
    bins = lambda s, e: F.explode(F.sequence(F.floor(s / reach).cast('int'), F.floor(e / reach).cast('int')))
    weak = (rows.filter(F.col('k') >= len(STRONG))
            .withColumn('bin', bins(F.greatest(F.col('s') - reach, F.lit(0)), F.col('e') + reach)))
    other = rows.select(F.col('doc_id').alias('o_id'), F.col('th').alias('o_th'), F.col('s').alias('o_s'),
                        F.col('e').alias('o_e'), F.col('part').alias('o_part'), bins(F.col('s'), F.col('e')).alias('o_bin'))
    hit = weak.join(other, weak.doc_id.eqNullSafe(other.o_id) & (weak.th == other.o_th) & (weak.bin == other.o_bin)
                    & (other.o_s < weak.e + reach) & (weak.s - reach < other.o_e) & (weak.part != other.o_part)
                    & ((weak.part == 'secret') | (other.o_part == 'secret')), 'left_semi')
    return hit.groupBy('doc_id', 'th').agg(F.collect_set(F.struct('s', 'k', 'e')).alias('linked'))


def all_spans(docs: DataFrame, reach: int = 200) -> DataFrame:
    """(doc_id, th, strong, spans) per input row; ``spans`` holds strong and linked weak
    spans ordered by start, then kind."""
    found = written(found_spans(docs), 'secrets')
    out = on_key(found, linked_weak(found, reach))
    empty = F.array().cast(SPAN)
    return out.select('doc_id', 'th', 'strong', F.array_sort(F.concat('strong', F.coalesce('linked', empty))).alias('spans'))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(':', F.get(names, x['k']), x['s'], x['e'])), ',')


def scan(docs: DataFrame, reach: int = 200) -> DataFrame:
    """Per row: doc_id, counts of the strong kinds, the digest of their list, all spans."""
    out = all_spans(docs, reach)
    n = lambda kind: F.size(F.filter('strong', lambda x: x['k'] == KINDS.index(kind))).cast('long')
    return out.select('doc_id', *[n(k).alias(f'n_{k}') for k in STRONG],
                      F.sha2(listed(F.col('strong')), 256).alias('base_sha256'), listed(F.col('spans')).alias('spans'))


def redact(docs: DataFrame, reach: int = 200, mark: str = '[SECRET]') -> DataFrame:
    """The documents with every reported secret or identity span replaced by ``mark``
    (endpoints stay).  All columns are kept; ``n_chars`` is recounted where it exists."""
    spans = (all_spans(docs, reach).filter(F.size('spans') > 0).dropDuplicates(['doc_id', 'th'])
             .select('doc_id', 'th', F.filter('spans', lambda x: x['k'] != KINDS.index('endpoint')).alias('_spans')))
    names = docs.columns
    rows, _, text = renamed(docs)
    j = by_key(rows, spans, 'left')
    t = F.col(text)
    zero = F.struct(F.lit(0).alias('at'), F.lit('').alias('out'))

    def step(acc, x):
        plain = F.substring(t, acc['at'] + 1, x['s'] - acc['at'])
        fresh = F.struct(x['e'].alias('at'), F.concat(acc['out'], plain, F.lit(mark)).alias('out'))
        more = F.struct(F.greatest(acc['at'], x['e']).alias('at'), acc['out'].alias('out'))
        return F.when(x['s'] >= acc['at'], fresh).otherwise(more)

    done = F.aggregate('_spans', zero, step, lambda acc: F.concat(acc['out'], F.substring(t, acc['at'] + 1, F.length(t))))
    hit = F.size('_spans') > 0
    out = j.withColumn(text, F.when(hit, done).otherwise(t))
    if 'n_chars' in names:
        n = f'c{names.index("n_chars")}'
        out = out.withColumn(n, F.when(hit, F.length(text).cast(rows.schema[n].dataType)).otherwise(F.col(n)))
    return out.select(*[f'c{i}' for i in range(len(names))]).toDF(*names)
