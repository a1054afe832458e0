"""Registration of queries, and pieces of SQL that their twins share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def toks(col: str, pattern: str) -> str:
    return f"regexp_extract_all(lower({col}), '{pattern}')"


def content(col: str, pattern: str, stop, least: int = 1) -> str:
    return f"list_distinct(list_filter({toks(col, pattern)}, lambda t: length(t) >= {least} AND NOT list_contains({listed(stop)}, t)))"


def with_stems(words: str) -> str:
    return f"list_distinct(list_concat({words}, list_transform(list_filter({words}, lambda w: length(w) > 5), lambda w: w[1:5])))"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::double ELSE len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) END"


def covered(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::double ELSE len(list_intersect({a}, {b}))::double / len({a}) END"


def normalized(col: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({col}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def sentences(col: str) -> str:
    return f"string_split(regexp_replace({col}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))"


def token_estimate(col: str) -> str:
    dense = f"(length({col}) - length(regexp_replace({col}, '[^A-Za-z0-9\\s]', '', 'g')))"
    return f"CASE WHEN length({col}) = 0 THEN 0 ELSE greatest(1, round_even((length({col}) - {dense}) / 4.0::double + {dense} / 2.8::double, 0)) END::bigint"
