"""Small tables with the awkward rows that every operator must take, and brute-force words."""

import re

from pyspark.sql import types as T

WORD = re.compile(r'[^\x20\x09-\x0D]+')
LOWER = str.maketrans('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')

A = ('Colourless green ideas sleep furiously while nine grey herons watch the river bend, and nobody on the far bank '
     'remembers which of them arrived first that morning. ')
B = ('Élan vital, naïve façade: die Straße führt über größere Brücken, où l’on mange des crêpes près de la forêt en été; '
     'ñandúes corren por la pampa sin descanso alguno. ')

#: (doc_id, text, lang, source, n_chars) and columns whose names operators use themselves.
SCHEMA = T.StructType([
    T.StructField('doc_id', T.LongType()), T.StructField('text', T.StringType()), T.StructField('lang', T.StringType()),
    T.StructField('source', T.StringType()), T.StructField('n_chars', T.LongType()),
    *[T.StructField(n, T.StringType()) for n in ('_id', '_th', '_chunk', 'th', 'chunk', 'key', 'ids', 'w', 'k', 'a', 'b', 'fp', 'sig',
                                                 'words', 'toxic', 'quality', 'strong', 'weak', 'linked', 'n_removed', 'score', 'prompt')]])


def awkward_texts():
    long = ' '.join(f'w{i * i % 7919}' for i in range(20_000))
    return [
        (1, A + B + A), (2, B + 'An own ending of the second text.'), (3, None), (4, ''), (5, ' \t\n\r\x0b\x0c '), (6, 'one'),
        (7, 'x' * 30_000), (8, A + B + A), (8, A + B + A), (9, 'two words'), (9, 'Two Words'), (10, long), (11, long + ' tail'),
        (None, A + B + A), (None, 'no id and no copy of it anywhere else'), (12, 'password = "hunter2hunter2" ok'), (13, 'é🙂 ß ' * 40),
        (14, B.upper()), (15, 'a b c d e f g ' * 60), (2**40, A.lower())]


def docs_of(spark, rows=None, parts=3):
    rows = awkward_texts() if rows is None else rows
    n = len(SCHEMA) - 5
    full = [(i, t, 'en', None, None if t is None else len(t), *['x'] * n) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def key(row):
    return -1 if row is None else row
