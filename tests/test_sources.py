"""Readers: parallel CSV records against Spark's whole-file reader, and dispatch by extension."""

import random

import pytest

from logtriage.sources import csv_records as C
from logtriage.sources import readers as R


def whole(spark, path, infer=True):
    return spark.read.options(header=True, sep=',', multiLine=True, escape='"', quote='"', inferSchema=infer).csv(path)


@pytest.fixture
def small_splits(spark):
    names = ('spark.sql.files.maxPartitionBytes', 'spark.sql.files.openCostInBytes')
    was = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], '700')
    spark.conf.set(names[1], '1')
    yield
    for n, v in zip(names, was, strict=True):
        spark.conf.set(n, v)


def log_file(path, end, seed):
    rnd = random.Random(seed)

    def field():
        return rnd.choice(['plain', '"quo,ted"', '"say ""hi"" now"', '"one\nline two\n\nline four"', '""', '', 'é🙂', '"a\r\nb"', '"' + 'at x.y(Z)\n' * rnd.randrange(150) + '"'])
    rows = ['id,day,text,text,n'] + [f'{i},2024-01-{i % 28 + 1:02d},{field()},{field()},{i / 4}' for i in range(150)]
    path.write_bytes((end.join(rows) + end).encode())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize('end', ['\n', '\r\n'])
def test_one_large_quoted_file_is_read_by_several_tasks(spark, tmp_path, small_splits, end):
    log_file(tmp_path / 'logs.csv', end, 1)
    path = str(tmp_path / 'logs.csv')
    lines = C.lines_of(spark, path)
    assert lines.rdd.getNumPartitions() > 8 and C.splits(lines).filter('inside').count() > 3
    old, new = whole(spark, path), R.read_csv_logs(spark, path)
    assert new.dtypes == old.dtypes and new.columns == ['id', 'day', 'text2', 'text3', 'n']
    assert rows_of(new) == rows_of(old)
    assert rows_of(R.read_csv_logs(spark, path, 'id string, day string, a string, b string, n string')) == rows_of(whole(spark, path, False))


def test_several_files_and_an_unclosed_quote(spark, tmp_path, small_splits):
    for i in range(3):
        log_file(tmp_path / f'{i}.csv', '\n', i)
    assert rows_of(R.read_csv_logs(spark, str(tmp_path))) == rows_of(whole(spark, str(tmp_path)))
    (tmp_path / '3.csv').write_text('id,day,text,text,n\n1,,"never closed\n' + 'x\n' * 400)
    with pytest.warns(UserWarning, match='a task per file'):
        assert rows_of(R.read_csv_logs(spark, str(tmp_path))) == rows_of(whole(spark, str(tmp_path)))


def test_quotes_inside_unquoted_fields_read_whole_files(spark, tmp_path):
    (tmp_path / 'odd.csv').write_text('id,text\n1,5" pipe\n2,"ok"\n3,6" pipe\n')
    with pytest.warns(UserWarning, match='a task per file'):
        assert rows_of(R.read_csv_logs(spark, str(tmp_path / 'odd.csv'))) == [(1, '5" pipe'), (2, 'ok'), (3, '6" pipe')]
    (tmp_path / 'plain.csv').write_text('id,text\n4,"two\nlines"\n')
    got = {(r.source_file, r.id, r.text) for r in R.read_log_dir(spark, str(tmp_path)).collect()}
    assert got == {('odd.csv', '1', '5" pipe'), ('odd.csv', '2', 'ok'), ('odd.csv', '3', '6" pipe'), ('plain.csv', '4', 'two\nlines')}


def test_types_and_empty_columns(spark, tmp_path):
    (tmp_path / 't.csv').write_text('a;;b;A\n1;;true;99999999999\n;x;FALSE;2\n\n3;;;\n')
    df = R.read_csv_logs(spark, str(tmp_path / 't.csv'))
    assert df.dtypes == [('a0', 'int'), ('_c1', 'string'), ('b', 'boolean'), ('A3', 'bigint')]
    assert rows_of(df) == [(1, None, True, 99999999999), (3, None, None, None), (None, 'x', False, 2)]
    (tmp_path / 'e.csv').write_text('a,b\n')
    assert R.read_csv_logs(spark, str(tmp_path / 'e.csv')).collect() == []


def test_read_log_file_dispatches(spark, tmp_path):
    (tmp_path / 'a.CSV').write_text('log_text,n\n"one\ntwo",1\n')
    (tmp_path / 'b.Log').write_text(' first \n\nsecond\n')
    (tmp_path / 'c.txt').write_text('third\n')
    (tmp_path / 'd.json').write_text('{}')
    assert [tuple(r) for r in R.read_log_file(spark, str(tmp_path / 'a.CSV')).collect()] == [('one\ntwo', 1)]
    assert [r.log_text for r in R.read_log_file(spark, str(tmp_path / 'b.Log')).collect()] == ['first', 'second']
    assert [r.log_text for r in R.read_log_file(spark, str(tmp_path / 'c.txt')).collect()] == ['third']
    with pytest.raises(ValueError, match='json'):
        R.read_log_file(spark, str(tmp_path / 'd.json'))
    with pytest.raises(FileNotFoundError):
        R.read_log_file(spark, str(tmp_path / 'missing.log'))
