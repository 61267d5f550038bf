"""Rule sets used by cleaning, relevance filtering and labelling.

Everything between the FIXED VALUES markers must stay equal to the rule sets whose
behaviour this library reproduces: the patterns are written in Python ``re`` syntax,
in their original order, and are compiled for Spark by :func:`java_pattern`.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

# ---------------------------------------------------------------------------
# FIXED VALUES (must equal the reproduced rule sets; order matters)
# ---------------------------------------------------------------------------

# Removal patterns of the cleaner, applied in this order, each match -> one space.
DEFAULT_REMOVE_PATTERNS = [
    r'\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?',  # ISO timestamp
    r'\d{2}/\d{2}/\d{4}\s\d{2}:\d{2}:\d{2}',  # US timestamp
    r'\d{2}-\d{2}-\d{4}\s\d{2}:\d{2}:\d{2}',  # EU timestamp
    r'[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}',  # UUID
    r'(?:/[a-zA-Z0-9_\-\.]+)+/?',  # Unix path
    r'[A-Z]:\\(?:[a-zA-Z0-9_\-\.]+\\)*[a-zA-Z0-9_\-\.]*',  # Windows path
    r'\b(?:\d{1,3}\.){3}\d{1,3}\b',  # IPv4
    r'0x[a-fA-F0-9]+',  # hex address
    r'\b[a-fA-F0-9]{32}\b',  # MD5
    r'\b[a-fA-F0-9]{40}\b',  # SHA1
    r'\b[a-fA-F0-9]{64}\b',  # SHA256
    r'\[\d+\]',  # process id in brackets
    r'#\d+',  # issue / PR number
    r'@[a-zA-Z0-9_]+',  # mention
]

# Characters kept by the special-character rule besides word chars and whitespace.
KEPT_PUNCTUATION = r'\.\,\:\;\!\?\-\(\)'

# Relevance keywords (substring match on the lower-cased line).
DEFAULT_KEYWORDS = [
    'error', 'fail', 'failed', 'failure', 'exception', 'assert',
    'timeout', 'null', 'undefined', 'crash', 'fatal', 'warning',
    'flaky', 'retry', 'unstable', 'intermittent', 'skipped',
    'success', 'passed', 'pass', 'build', 'test', 'deploy',
    'connection', 'refused', 'denied', 'permission', 'access',
    'memory', 'heap', 'stack', 'overflow', 'leak',
    'race', 'condition', 'deadlock', 'concurrent',
]

MIN_LINE_LENGTH = 10
MAX_LINE_LENGTH = 512

# Second preset (configuration file variant): 7 patterns, 14 keywords.
PRESET2_REMOVE_PATTERNS = [
    r'\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}',
    r'\d{2}/\d{2}/\d{4}\s\d{2}:\d{2}:\d{2}',
    r'[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}',
    r'/[a-zA-Z0-9_/\-\.]+/',
    r'\b(?:\d{1,3}\.){3}\d{1,3}\b',
    r'0x[a-fA-F0-9]+',
    r'\[.*?\]',
]
PRESET2_KEYWORDS = [
    'error', 'fail', 'exception', 'assert', 'timeout', 'null', 'undefined',
    'crash', 'fatal', 'warning', 'flaky', 'retry', 'unstable', 'intermittent',
]

# Patterns that point to a flaky / transient failure (class 0).
FLAKY_PATTERNS = [
    r'\bflaky\b',
    r'\bintermittent\b',
    r'\bunstable\b',
    r'\bretry\b',
    r'\bretrying\b',
    r'\bflapping\b',
    r'\btimeout\b(?!.*\bfixed\b)',
    r'\bconnection\s+(?:refused|reset|timed?\s*out)\b',
    r'\bnetwork\s+(?:error|issue|problem)\b',
    r'\brace\s+condition\b',
    r'\bconcurren(?:t|cy)\s+(?:error|issue)\b',
    r'\bresource\s+(?:busy|unavailable)\b',
    r'\btemporary\s+(?:failure|error)\b',
    r'\bspurious\b',
    r'\bnon[\-\s]?deterministic\b',
    r'\brandom(?:ly)?\s+fail',
    r'\bskipped\b',
    r'\bignored\b',
    r'\bknown\s+issue\b',
    r'\bwont\s*fix\b',
    r'\bexpected\s+(?:failure|to\s+fail)\b',
]

# Patterns that point to a real regression (class 1).
REGRESSION_PATTERNS = [
    r'\bregression\b',
    r'\bbug\b',
    r'\bdefect\b',
    r'\bbroken\b',
    r'\bbreak(?:s|ing)?\b',
    r'\bfatal\b',
    r'\bcritical\b',
    r'\bsevere\b',
    r'\bnull\s*pointer\b',
    r'\bsegmentation\s+fault\b',
    r'\bsegfault\b',
    r'\bstack\s*overflow\b',
    r'\bheap\s+(?:corruption|overflow)\b',
    r'\bmemory\s+leak\b',
    r'\bout\s+of\s+memory\b',
    r'\bindex\s+out\s+of\s+(?:bounds|range)\b',
    r'\bassertion\s+(?:failed|error)\b',
    r'\bunhandled\s+exception\b',
    r'\binvalid\s+(?:argument|parameter|input)\b',
    r'\btype\s*error\b',
    r'\bvalue\s*error\b',
    r'\bsyntax\s*error\b',
    r'\bcompilation?\s+(?:error|failed)\b',
    r'\blink(?:er|ing)?\s+error\b',
    r'\bpermission\s+denied\b',
    r'\baccess\s+denied\b',
    r'\bauthentication\s+(?:failed|error)\b',
    r'\bauthorization\s+(?:failed|error)\b',
    r'\bincorrect\s+(?:result|output)\b',
    r'\bwrong\s+(?:result|output|value)\b',
    r'\bmismatch\b',
    r'\bexpected.*but\s+(?:got|was|received)\b',
]

# Patterns of neutral / success lines.
NEUTRAL_PATTERNS = [
    r'\bsuccess(?:ful(?:ly)?)?\b',
    r'\bpass(?:ed)?\b',
    r'\bcompleted?\b',
    r'\binfo\b',
    r'\bdebug\b',
    r'\bstarting\b',
    r'\binitialized?\b',
]

# Substrings used by the labelling fallbacks.
FALLBACK_REGRESSION_WORDS = ['error', 'fail', 'exception']
TIE_BREAK_WORD = 'error'

# Label names (0 = flaky, 1 = regression).
LABEL_NAMES = {0: 'Flaky/False Positive', 1: 'True Regression'}

# Class names used by the classification report.
REPORT_TARGET_NAMES = ['Flaky/False Positive', 'Non Flaky (Possible Regression)']

# Augmentation choices: level prefixes and suffixes.
AUGMENT_PREFIXES = ['[ERROR] ', '[WARN] ', '[INFO] ', '[DEBUG] ', 'ERROR: ', 'WARN: ']
AUGMENT_SUFFIXES = [' (see logs for details)', ' [retryable]', ' !', '...']

# Separator used when composing message, error type and stack trace.
COMPOSE_SEPARATOR = ' [SEP] '

# ---------------------------------------------------------------------------
# end of FIXED VALUES
# ---------------------------------------------------------------------------

# Python's `re` is Unicode-aware for \w \d \s \b and case folding; Java needs
# UNICODE_CHARACTER_CLASS (U) and UNICODE_CASE (implied by U).  `d` (UNIX_LINES)
# makes `.` stop only at \n, as Python's `.` does.
JAVA_FLAGS = '(?iUd)'


def java_pattern(py_pattern: str, ignore_case: bool = True) -> str:
    """Python regex -> Java regex with Python-compatible Unicode semantics."""
    return (JAVA_FLAGS if ignore_case else '(?Ud)') + py_pattern


def required_literal(py_pattern: str) -> str:
    """The longest lower-case string that every match of the pattern holds, '' if none is found."""
    best, run = '', ''

    def visit(items) -> None:
        nonlocal best, run
        for op, arg in items:
            name = str(op)
            if name == 'LITERAL':
                run += chr(arg).lower()
                continue
            best, run = max(best, run, key=len), ''
            if name == 'SUBPATTERN':
                visit(arg[-1])
            elif name in ('MAX_REPEAT', 'MIN_REPEAT', 'POSSESSIVE_REPEAT') and arg[0] > 0:
                visit(arg[-1])
            best, run = max(best, run, key=len), ''
        best, run = max(best, run, key=len), ''

    try:
        visit(re._parser.parse(py_pattern))
    except (AttributeError, re.error):  # then every text is searched
        return ''
    return best if best.isascii() else ''


def digest_length(py_pattern: str) -> int:
    """n for a pattern of n hexadecimal digits between word boundaries, else 0."""
    m = re.fullmatch(r'\\b\[a-fA-F0-9\]\{(\d+)\}\\b', py_pattern)
    return int(m[1]) if m else 0


def _valid_patterns(patterns, kind):
    kept = []
    for p in patterns:
        try:
            re.compile(p)
        except re.error as exc:  # the reproduced behaviour: warn and skip
            warnings.warn(f'invalid {kind} pattern skipped: {p!r} ({exc})')
            continue
        kept.append(p)
    return kept


@dataclass(frozen=True)
class Rules:
    """Configurable cleaning / relevance rule set.

    User values *replace* the defaults (they are not merged).  Invalid patterns are
    skipped with a warning when the rule set is built.
    """

    remove_patterns: tuple = tuple(DEFAULT_REMOVE_PATTERNS)
    keywords: tuple = tuple(DEFAULT_KEYWORDS)
    min_len: int = MIN_LINE_LENGTH
    max_len: int = MAX_LINE_LENGTH
    lowercase: bool = True
    strip_special: bool = True

    def __post_init__(self):
        object.__setattr__(self, 'remove_patterns',
                           tuple(_valid_patterns(self.remove_patterns, 'removal')))
        object.__setattr__(self, 'keywords', tuple(self.keywords))

    @classmethod
    def preset2(cls) -> 'Rules':
        return cls(remove_patterns=tuple(PRESET2_REMOVE_PATTERNS),
                   keywords=tuple(PRESET2_KEYWORDS))

    @classmethod
    def from_options(cls, options: dict | None = None) -> 'Rules':
        """Build from a mapping shaped like the `preprocessing` config section."""
        o = dict(options or {})
        return cls(
            remove_patterns=tuple(o.get('remove_patterns', DEFAULT_REMOVE_PATTERNS)),
            keywords=tuple(o.get('important_keywords', DEFAULT_KEYWORDS)),
            min_len=int(o.get('min_line_length', MIN_LINE_LENGTH)),
            max_len=int(o.get('max_line_length', MAX_LINE_LENGTH)),
            lowercase=bool(o.get('lowercase', True)),
            strip_special=bool(o.get('remove_special_chars', True)),
        )


DEFAULT_RULES = Rules()


@dataclass(frozen=True)
class LabelRules:
    flaky: tuple = tuple(FLAKY_PATTERNS)
    regression: tuple = tuple(REGRESSION_PATTERNS)
    neutral: tuple = tuple(NEUTRAL_PATTERNS)
    fallback_words: tuple = tuple(FALLBACK_REGRESSION_WORDS)
    tie_word: str = TIE_BREAK_WORD


DEFAULT_LABEL_RULES = LabelRules()
