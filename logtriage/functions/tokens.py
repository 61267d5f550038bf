"""Tokenisation helpers (Column expressions) for TF-IDF and word encoding."""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern of the word analyser: a letter, then letters/digits/underscore, between
# Unicode word boundaries.
TOKEN_PATTERN = r'(?U)\b[a-zA-Z][a-zA-Z0-9_]*\b'


def _plain(ch: str) -> str:
    """NFKD without combining marks."""
    return ''.join(c for c in unicodedata.normalize('NFKD', ch) if not unicodedata.combining(c))


@cache
def accent_tables():
    """Built by rule over all code points: characters whose plain form is one other
    character (a ``translate`` table), and those with a longer plain form."""
    src, dst, marks, longer = [], [], [], {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xD800 <= cp <= 0xDFFF:
            continue
        base = _plain(ch)
        if not base:
            marks.append(ch)
        elif base != ch and len(base) == 1 and cp < 0x10000:
            src.append(ch)
            dst.append(base)
        elif base != ch and re.search('[0-9A-Za-z_]', base):  # others hold no token character
            longer[ch] = base.lower()
    marks = [m for m in marks if ord(m) < 0x10000]
    return ''.join(src) + ''.join(marks), ''.join(dst), longer


def strip_accents(c: Column) -> Column:
    """NFKD, then without combining marks, as far as token characters are concerned."""
    plain_from, plain_to, longer = accent_tables()
    spans = []
    for cp in sorted(map(ord, longer)):  # a few ranges that cover them; others in there stay as they are
        if spans and cp - spans[-1][1] < 64:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    odd = '[' + ''.join(f'\\x{{{a:x}}}-\\x{{{b:x}}}' for a, b in spans) + ']'
    table = F.from_json(F.lit(json.dumps(longer)), 'map<string,string>')  # one constant
    each = F.array_join(F.transform(F.split(c, ''), lambda x: F.coalesce(F.element_at(table, x), x)), '')
    return F.translate(F.when(c.rlike(odd), each).otherwise(c), plain_from, plain_to)


def word_tokens(c: Column) -> Column:
    """lower -> strip accents -> tokens matching the token pattern (array<string>).

    Accents are looked for in the parts between blanks that hold other characters than ASCII ones.
    """
    def plain(t: Column) -> Column:
        parts = F.transform(F.split(t, ' ', -1), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(strip_accents(x)))
        norm = F.when(F.octet_length(t) == F.length(t), t).otherwise(F.array_join(parts, ' '))
        return F.regexp_extract_all(norm, F.lit(TOKEN_PATTERN), 0)
    return F.transform(F.array(F.lower(F.coalesce(c.cast('string'), F.lit('')))), plain)[0]


def bigrams(tokens: Column) -> Column:
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(F.slice(tokens, 1, n), F.slice(tokens, 2, n),
                      lambda a, b: F.concat(a, F.lit(' '), b))
