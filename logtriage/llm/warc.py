"""Writing WARC archives and reading them back: segments, chunked framing, revisits.

Writing: each row becomes an HTTP response record.  The body is framed in chunks
(Transfer-Encoding: chunked), and a block of more than ``segment_bytes`` is cut into a first
record and continuation records.  Of rows with equal payloads of at least ``REVISIT_BYTES``
the one with the least id is a response, the others are revisits that name its record.
Archives are plain .warc content, written by Spark's text sink with the record end as line
separator, so that a lost task leaves nothing behind.

Reading: the text source splits archives at version lines, so one archive is read by several
tasks; every record is checked against its Content-Length.  Continuation records are grouped
by the record they originate from, ordered by segment number and checked against the total
length; unsegmented records are not shuffled.  Then the HTTP head is cut off and the chunks
are put together.  A version line inside a block would be a false end, so the writer cuts the
chunk there; in foreign archives such a record is reported.

Edge cases: null payloads are empty; rows with null id stand after all others when the
response of a payload is chosen, and their record has no Page-ID; of repeated rows with the
least id one is the response and the others revisit it; an empty table gives archives without
records; other columns are ignored.  A record that is cut short, or misses a segment, or whose
length, framing or digest does not fit, is returned with ``problem`` set and without payload.

``write_archives`` reads its input twice and expects the same rows in the same partitions and
order, as table scans give them; write a computed DataFrame to a table first.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# ------------------------------------------------------------ fixed values of the format
VERSION = 'WARC/1.1'
END = '\r\n\r\n'
PROFILE = 'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'
HTTP_HEAD = b'HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n'
# --------------------------------------------------------------------------------------
REVISIT_BYTES = 100
SEGMENT_BYTES, CHUNK_BYTES = 1 << 15, 1 << 12
#: The tables have no time of capture.
DATE = '2000-01-01T00:00:00Z'
#: Payload bytes per Arrow batch that a task returns.
BATCH_BYTES = 4 << 20


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """``body`` in chunked transfer framing; no chunk holds a version mark."""
    cuts = sorted({*range(0, len(body), size), *(m.start() + 5 for m in re.finditer(VERSION.encode(), body)), len(body)})
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        out += [b'%x\r\n' % (hi - lo), body[lo:hi], b'\r\n']
    return b''.join([*out, b'0\r\n\r\n'])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a body in chunked framing (extensions and trailers are skipped), or None."""
    out, at = [], 0
    while True:
        end = body.find(b'\r\n', at)
        size = body[at:end].split(b';')[0].strip() if end >= 0 else b''
        if not re.fullmatch(rb'[0-9A-Fa-f]+', size):
            return None
        n, at = int(size, 16), end + 2
        if n == 0:
            return b''.join(out) if body[at:at + 2] == b'\r\n' or body.endswith(b'\r\n\r\n') else None
        if body[at + n:at + n + 2] != b'\r\n':
            return None
        out.append(body[at:at + n])
        at += n + 2


def record_id(page: int | None, tie: int, digest: str) -> str:
    return f'<urn:uuid:{uuid.UUID(bytes=sha256(f"{page}|{tie}|{digest}".encode()).digest()[:16], version=5)}>'


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f'{k}: {v}' for k, v in headers if v is not None), f'Content-Length: {len(block)}']
    return '\r\n'.join(lines).encode() + END.encode() + block


def _uri(text: str | None) -> str | None:
    return None if text is None else re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', text)


def records_of(row: dict, segment_bytes: int, chunk_bytes: int, date: str) -> Iterator[bytes]:
    """The records of one row, without their ends."""
    own = record_id(row['id'], row['tie'], row['digest'])
    about = [('WARC-Record-ID', own), ('WARC-Date', date), ('WARC-Target-URI', _uri(row['uri'])),
             ('WARC-Payload-Digest', f'sha256:{row["digest"]}'), ('Page-ID', row['id']), ('Content-Type', 'application/http;msgtype=response')]
    if row['first_tie'] is not None:
        refers = record_id(row['first_id'], row['first_tie'], row['digest'])
        yield _record([('WARC-Type', 'revisit'), *about, ('WARC-Profile', PROFILE), ('WARC-Refers-To', refers)], HTTP_HEAD)
        return
    block = HTTP_HEAD + chunked(row['payload'], chunk_bytes)
    if len(block) <= segment_bytes:
        yield _record([('WARC-Type', 'response'), *about], block)
        return
    yield _record([('WARC-Type', 'response'), *about, ('WARC-Segment-Number', 1)], block[:segment_bytes])
    for k, lo in enumerate(range(segment_bytes, len(block), segment_bytes), 2):
        total = len(block) if lo + segment_bytes >= len(block) else None
        part = f'<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f"{own}/{k}")}>'
        yield _record([('WARC-Type', 'continuation'), ('WARC-Record-ID', part), ('WARC-Date', date), ('WARC-Segment-Origin-ID', own),
                       ('WARC-Segment-Number', k), ('WARC-Segment-Total-Length', total)], block[lo:lo + segment_bytes])


def _sized(rows: Iterator, size) -> Iterator[list]:
    """Lists of rows of about BATCH_BYTES."""
    out, n = [], 0
    for r in rows:
        out.append(r)
        n += size(r)
        if n > BATCH_BYTES:
            yield out
            out, n = [], 0
    if out:
        yield out


def write_archives(pages: DataFrame, path: str, id_col='page_id', uri_col='url', payload_col='html', segment_bytes: int = SEGMENT_BYTES,
                   chunk_bytes: int = CHUNK_BYTES, date: str = DATE) -> str:
    """Write a record for every row into archives under ``path``."""
    payload = F.coalesce(F.col(payload_col).cast('binary'), F.lit(b''))
    rows = pages.select(F.col(id_col).cast('long').alias('id'), F.col(uri_col).cast('string').alias('uri'), payload.alias('payload'),
                        F.sha2(payload, 256).alias('digest'), F.monotonically_increasing_id().alias('tie'))
    keys = rows.filter(F.octet_length('payload') >= REVISIT_BYTES).select('id', 'digest', 'tie')
    copies = keys.groupBy('digest').agg(F.count(F.lit(1)).alias('n'), F.min(F.struct(F.col('id').isNull().alias('last'), 'id', 'tie')).alias('first'))
    copies = copies.filter('n > 1').select('digest', F.col('first.id').alias('first_id'), F.col('first.tie').alias('first_tie'))
    rows = rows.join(written(copies, 'warc-copies'), 'digest', 'left')  # broadcast only where Spark finds the written table small
    again = F.col('first_tie').isNotNull() & (F.col('first_tie') != F.col('tie'))
    rows = rows.select('id', 'uri', F.when(~again, F.col('payload')).alias('payload'), 'digest', 'tie', 'first_id', F.when(again, F.col('first_tie')).alias('first_tie'))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (r for i in range(batch.num_rows) for r in records_of({c: batch.column(c)[i].as_py() for c in batch.schema.names}, segment_bytes, chunk_bytes, date))
            for out in _sized(made, len):
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ['value'])

    rows.mapInArrow(run, 'value binary').select(F.col('value').cast('string').alias('value')).write.option('lineSep', END).text(path)
    return path


_READ = ('record_id string, kind string, page_id long, uri string, refers_to string, stated string, segment int, origin string, total long, '
         'block binary, problem string')
_READ_ARROW = pa.schema([('record_id', pa.string()), ('kind', pa.string()), ('page_id', pa.int64()), ('uri', pa.string()), ('refers_to', pa.string()),
                         ('stated', pa.string()), ('segment', pa.int32()), ('origin', pa.string()), ('total', pa.int64()), ('block', pa.binary()), ('problem', pa.string())])


def _number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r'-?[0-9]{1,18}|-?9[0-9]{18}', text) else None


def parsed(piece: bytes) -> dict:
    """One record, from behind a version line to before the next one."""
    head, _, rest = piece.partition(b'\r\n\r\n')
    fields = {}
    for line in re.sub(rb'\r\n[ \t]+', b' ', head).decode('utf-8', 'replace').split('\r\n'):
        k, _, v = line.partition(':')
        fields.setdefault(k.strip().lower(), v.strip())
    n = _number(fields.get('content-length'))
    whole = n is not None and rest[n:] in (b'\r\n\r', b'\r\n\r\n') and len(rest) >= n
    return {'record_id': fields.get('warc-record-id'), 'kind': fields.get('warc-type'), 'page_id': _number(fields.get('page-id')), 'uri': fields.get('warc-target-uri'),
            'refers_to': fields.get('warc-refers-to'), 'stated': (fields.get('warc-payload-digest') or '').removeprefix('sha256:') or None,
            'segment': _number(fields.get('warc-segment-number')), 'origin': fields.get('warc-segment-origin-id'), 'total': _number(fields.get('warc-segment-total-length')),
            'block': rest[:n] if whole else None, 'problem': None if whole else 'the record does not have its length'}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under ``path`` as they stand there."""
    mark = f'{VERSION}\r\n'.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = (p.as_py() for p in batch.column(0))
            made = (parsed(p.removeprefix(mark)) for p in pieces if p.strip())
            for out in _sized(made, lambda r: len(r['block'] or b'')):
                yield pa.RecordBatch.from_pylist(out, _READ_ARROW)

    return spark.read.option('lineSep', f'\n{VERSION}\r\n').text(path).select(F.col('value').cast('binary').alias('value')).mapInArrow(run, _READ)


def joined(parts: list[dict]) -> dict:
    """The record whose segments are ``parts``, each number once unless they differ."""
    parts = sorted(parts, key=lambda p: p['segment'] or 0)
    first, last = parts[0], parts[-1]
    problem = next((p['problem'] for p in parts if p['problem']), None)
    if not problem and [p['segment'] for p in parts] != list(range(1, len(parts) + 1)) or first['kind'] == 'continuation':
        problem = problem or 'segments are missing or repeated'
    block = None if problem else b''.join(p['block'] for p in parts)
    if block is not None and last['total'] != len(block):
        problem, block = 'the segments do not have the total length', None
    return {**first, 'block': block, 'problem': problem, 'total': last['total']}


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: segmented ones put together, the others as they are."""
    part = F.col('segment').isNotNull() | F.col('kind').eqNullSafe(F.lit('continuation'))
    parts = records.filter(part).withColumns({'key': F.coalesce('origin', 'record_id'), 'same': F.sha2('block', 256)}).dropDuplicates(['key', 'segment', 'same'])
    groups = parts.groupBy('key').agg(F.collect_list(F.struct(*_READ_ARROW.names)).alias('parts')).select('parts')  # the parts of one record

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield pa.RecordBatch.from_pylist([joined(batch.column(0)[i].as_py())], _READ_ARROW)

    return records.filter(~part).unionByName(groups.mapInArrow(run, _READ))


_PAYLOAD = 'record_id string, kind string, page_id long, uri string, refers_to string, payload binary, digest string, problem string'
_PAYLOAD_ARROW = pa.schema([('record_id', pa.string()), ('kind', pa.string()), ('page_id', pa.int64()), ('uri', pa.string()), ('refers_to', pa.string()),
                            ('payload', pa.binary()), ('digest', pa.string()), ('problem', pa.string())])


def decoded(record: dict) -> dict:
    """The payload of a response and its SHA-256, the stated one of a revisit."""
    out = {c: record[c] for c in ('record_id', 'kind', 'page_id', 'uri', 'refers_to', 'problem')} | {'payload': None, 'digest': record['stated']}
    if out['problem'] or record['kind'] != 'response':
        return out
    head, mark, body = record['block'].partition(b'\r\n\r\n')
    framed = re.search(rb'\r\ntransfer-encoding:[^\r\n]*\bchunked\b', head, re.I)
    payload = (dechunked(body) if framed else body) if mark else None
    if payload is None:
        return {**out, 'problem': 'the body is not framed as it says'}
    digest = sha256(payload).hexdigest()
    if record['stated'] not in (None, digest):
        return {**out, 'problem': 'the payload does not have its digest'}
    return {**out, 'payload': payload, 'digest': digest}


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, page_id, uri, refers_to, payload, digest, problem) for every response
    and revisit in the archives under ``path``; revisits have no payload of their own."""
    whole = reassembled(read_records(spark, path)).filter("kind in ('response', 'revisit', 'continuation') or problem is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (decoded({c: batch.column(c)[i].as_py() for c in batch.schema.names}) for i in range(batch.num_rows))
            for out in _sized(made, lambda r: len(r['payload'] or b'')):
                yield pa.RecordBatch.from_pylist(out, _PAYLOAD_ARROW)

    return whole.mapInArrow(run, _PAYLOAD)


def resolved(payloads: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem): revisits get
    length and digest of the response that they name, and its page."""
    size: Column = F.octet_length('payload').cast('long')
    rows = written(payloads.select('record_id', 'kind', 'page_id', F.col('refers_to').alias('target'), size.alias('size'), 'digest', 'problem'), 'warc-payloads')
    named = rows.filter("kind = 'response'").select(F.col('record_id').alias('_id'), F.col('page_id').alias('_page'), F.col('size').alias('_size'), F.col('digest').alias('_digest'))
    own = rows.filter('target is null').select('page_id', F.col('size').alias('payload_bytes'), F.col('digest').alias('payload_digest'), F.col('kind').alias('record_type'),
                                               F.lit(None).cast('long').alias('refers_to'), 'problem')
    lost = F.when(F.col('_id').isNull(), 'the response is missing').when(F.col('digest') != F.col('_digest'), 'the response has another digest')
    others = rows.filter('target is not null').join(named, F.col('target') == F.col('_id'), 'left').select(
        'page_id', F.col('_size').alias('payload_bytes'), F.col('_digest').alias('payload_digest'), F.col('kind').alias('record_type'), F.col('_page').alias('refers_to'),
        F.coalesce('problem', lost).alias('problem'))
    return own.unionByName(others)
