"""The text functions as DuckDB expressions, for the oracle; written apart from the Spark ones."""

from __future__ import annotations

from larkspur import lexicon as L


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(xs: list[str]) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def case(mapping: dict[str, str], x: str = "x") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in mapping.items()) + f" ELSE {x} END"


def norm(e: str) -> str:
    t = f"array_to_string(list_transform(list_filter(string_split_regex(lower(coalesce({e}, '')), '\\s+'), lambda x: x <> ''), lambda x: {case(L.ABBREVIATIONS)}), ' ')"
    for c in "abcdefghijklmnopqrstuvwxyz":
        t = f"regexp_replace({t}, '{c}{{3,}}', '{c}{c}', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'), '_+', ' ', 'g')"
    return f"trim(regexp_replace({t}, '\\s+', ' ', 'g'))"


def words_of(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda x: x <> '')"


SINGULAR = "CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN substr(x, 1, length(x) - 3) || 'y' WHEN x LIKE '%s' AND x NOT LIKE '%ss' AND length(x) > 3 THEN substr(x, 1, length(x) - 1) ELSE x END"


def tokens(e: str, keep: bool = True) -> str:
    t = f"list_transform({words_of(norm(e))}, lambda x: {SINGULAR})"
    return t if keep else f"list_filter({t}, lambda x: NOT list_contains({items(L.STOPWORDS)}, x))"


def match(e: str) -> str:
    return f"array_to_string({tokens(e)}, ' ')"


def compact(e: str) -> str:
    return f"replace({match(e)}, ' ', '')"


def fillers(e: str) -> str:
    return f"array_to_string(list_filter({words_of(norm(e))}, lambda x: NOT list_contains({items(L.FILLERS)}, x)), ' ')"


def soundex(e: str) -> str:
    t = f"regexp_replace(lower({e}), '[^a-z]', '', 'g')"
    c = f"translate(substr({t}, 2), 'bfpvcgjkqsxzdtlmnraeiouhwy', '111122222222334556')"
    for d in "123456":
        c = f"regexp_replace({c}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {t} = '' THEN '' ELSE rpad(substr(upper(substr({t}, 1, 1)) || {c}, 1, 4), 4, '0') END"
