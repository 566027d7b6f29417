"""Boolean trigram queries from regular expressions: what a text needs to hold for a pattern to match in it."""

from __future__ import annotations

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # before Python 3.11
    import sre_constants as sre
    import sre_parse

#: Exact sets larger than this are given up for what they all hold.
_MOST = 64
#: A query is a set of clauses (OR), each a set of trigrams (AND). ANY: every text may match.
Query = frozenset
ANY: Query = frozenset([frozenset()])


def _or(a: Query, b: Query) -> Query:
    out = a | b
    return frozenset(c for c in out if not any(d < c for d in out))


def _and(a: Query, b: Query) -> Query:
    out = frozenset(x | y for x in a for y in b)
    if len(out) > _MOST:
        return min((a, b), key=len)
    return frozenset(c for c in out if not any(d < c for d in out))


def _grams(words: set[str]) -> Query:
    """Texts that hold one of words whole, as a query."""
    out: Query = frozenset()
    for w in words:
        out = _or(out, frozenset([frozenset(w[i : i + 3] for i in range(len(w) - 2))]))
    return out


class _Info:
    """exact: the strings that match, or None; else every match starts with one of prefix and ends with one of suffix."""

    def __init__(self, exact: set[str] | None, prefix: set[str], suffix: set[str], query: Query):
        self.exact, self.prefix, self.suffix, self.query = exact, prefix, suffix, query


def _literal(words: set[str]) -> _Info:
    return _Info(words, words, words, ANY)


_UNKNOWN = _Info(None, {""}, {""}, ANY)


def _short(words: set[str], end: bool) -> set[str]:
    return {w[-2:] if end else w[:2] for w in words}


def _concat(a: _Info, b: _Info) -> _Info:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= _MOST:
        return _Info(out := {x + y for x in a.exact for y in b.exact}, out, out, _and(a.query, b.query))
    query = _and(a.query, b.query)
    for part in (a, b):
        if part.exact is not None:
            query = _and(query, _grams(part.exact))
    joined = {x + y for x in _short(a.suffix, True) for y in _short(b.prefix, False)}
    if len(joined) <= _MOST:
        query = _and(query, _grams(joined))
    prefix = {x + y for x in a.exact for y in b.prefix} if a.exact is not None and len(a.exact) * len(b.prefix) <= _MOST else a.prefix
    suffix = {x + y for x in a.suffix for y in b.exact} if b.exact is not None and len(a.suffix) * len(b.exact) <= _MOST else b.suffix
    return _Info(None, prefix, suffix, query)


def _any_of(parts: list[_Info]) -> _Info:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= _MOST:
        return _literal(set().union(*(p.exact for p in parts)))
    query: Query = frozenset()
    for p in parts:
        query = _or(query, _and(p.query, _grams(p.exact)) if p.exact is not None else p.query)
    prefix, suffix = (set().union(*(getattr(p, k) for p in parts)) for k in ("prefix", "suffix"))
    return _Info(None, prefix if len(prefix) <= _MOST else {""}, suffix if len(suffix) <= _MOST else {""}, query)


def _set(items) -> _Info:
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg).lower())
        elif op is sre.RANGE and arg[1] - arg[0] < _MOST:
            chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return _UNKNOWN
    return _literal(chars) if 0 < len(chars) <= 8 else _UNKNOWN


def _walk(tokens) -> _Info:
    out = _literal({""})
    for op, arg in tokens:
        if op is sre.LITERAL:
            part = _literal({chr(arg).lower()})
        elif op is sre.IN:
            part = _set(arg)
        elif op is sre.SUBPATTERN:
            part = _walk(arg[-1])
        elif op is sre.BRANCH:
            part = _any_of([_walk(x) for x in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
            least, most, inner = arg
            one = _walk(inner)
            if least == 0:
                part = _any_of([_literal({""}), one]) if most == 1 else _UNKNOWN
            else:
                part = one
                for _ in range(min(least, 4) - 1):
                    part = _concat(part, one)
                if most != least or least > 4:
                    part = _Info(None, part.prefix, part.suffix, _and(part.query, _grams(part.exact)) if part.exact is not None else part.query)
        elif op in (sre.AT, sre.ASSERT_NOT, sre.ASSERT):
            continue  # takes no text; to ask for less than it does is safe
        else:
            part = _UNKNOWN
        out = _concat(out, part)
    return out


def trigram_query(pattern: str) -> Query:
    """Clauses of trigrams in lower case: a text that matches has all trigrams of one clause at least. ANY: no trigram
    is needed, and only a full scan finds the matches."""
    info = _walk(sre_parse.parse(pattern))
    query = info.query
    if info.exact is not None:
        query = _and(query, _grams(info.exact))
    else:
        query = _and(_and(query, _grams(info.prefix)), _grams(info.suffix))
    return ANY if frozenset() in query else query
