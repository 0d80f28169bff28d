"""Analyzers: text columns to arrays of tokens, as plain Spark expressions. A null text has null tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

_ALNUM = r"\p{IsAlphabetic}\p{N}"
_EDGES = rf"(?U)\A[^{_ALNUM}]++|[^{_ALNUM}]++\z"
#: White space with whatever else is neither letter nor number around it.
_BETWEEN = rf"(?U)[^{_ALNUM}\s]*+\s[^{_ALNUM}]*+"
# The blocks of characters that are cut into pairs.
_PAIRED = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7A3}"


def whitespace_lower(text: Column) -> Column:
    """Lower-case pieces between white space, without the punctuation at their ends; repeats are kept.

    One pass strips the ends of the text and one splits it: punctuation around white space belongs to the separator."""
    body = F.regexp_replace(F.lower(text), _EDGES, "")
    return F.filter(F.split(body, _BETWEEN), lambda x: x != "")


def _grams(chars: Column, n: int) -> Column:
    at = F.sequence(F.lit(0), F.size(chars) - n)
    return F.when(F.size(chars) >= n, F.transform(at, lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def ngram(text: Column) -> Column:
    """All pairs, then all triples, of the characters that are not white space, in lower case."""
    packed = F.lower(F.regexp_replace(text, r"(?U)\s+", ""))
    chars = F.filter(F.split(packed, ""), lambda c: c != "")
    both = F.transform(F.array(chars), lambda c: F.concat(_grams(c, 2), _grams(c, 3)))
    return F.when(text.isNotNull(), F.get(both, F.lit(0)))


def paired(text: Column) -> Column:
    """Runs of Han, kana and hangul give their neighbouring pairs (a single one itself); the rest gives words."""
    runs = F.regexp_extract_all(text, F.lit(f"([{_PAIRED}]+|[^{_PAIRED}]+)"), F.lit(1))

    def tokens(run: Column) -> Column:
        chars = F.filter(F.split(run, ""), lambda c: c != "")
        pairs = F.when(F.size(chars) < 2, chars).otherwise(_grams(chars, 2))
        return F.when(run.rlike(f"^[{_PAIRED}]"), pairs).otherwise(whitespace_lower(run))

    return F.flatten(F.transform(runs, tokens))


_BY_NAME = {"whitespace_lower": whitespace_lower, "ngram": ngram, "jieba": paired}


def analyze(text: Column, analyzer: str) -> Column:
    if analyzer not in _BY_NAME:
        raise QueryError("bad_request", f"unknown analyzer {analyzer!r}")
    return _BY_NAME[analyzer](text)
