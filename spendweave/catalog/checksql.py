"""Fragments of the checking SQL (DuckDB dialect) for text rules."""

from __future__ import annotations

from spendweave.functions.text import ACRONYMS, ONLY_SUFFIXES, PUNCTUATION, SPACE, STOP_WORDS, TRAILING_SUFFIXES
from spendweave.functions.domains import TWO_LABEL_SUFFIXES


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def words(c: str) -> str:
    text = f"regexp_replace(coalesce({c}, ''), '[&+]', ' and ', 'g')"
    text = f"regexp_replace({text}, {quoted(PUNCTUATION)}, ' ', 'g')"
    return f"trim(regexp_replace({text}, {quoted(SPACE + '+')}, ' ', 'g'))"


def key(c: str) -> str:
    low = f"lower({words(c)})"
    return f"(CASE WHEN regexp_matches({low}, {quoted(ONLY_SUFFIXES)}) THEN {low} ELSE regexp_replace({low}, {quoted(TRAILING_SUFFIXES)}, '') END)"


def suffixed(c: str) -> str:
    low = f"lower({words(c)})"
    return f"(regexp_matches({low}, {quoted(ONLY_SUFFIXES)}) OR regexp_matches({low}, {quoted(TRAILING_SUFFIXES)}))"


def title(c: str) -> str:
    text = f"trim(regexp_replace(coalesce({c}, ''), {quoted(SPACE + '+')}, ' ', 'g'))"
    bare = "regexp_replace(w, '[^A-Za-z0-9&]', '', 'g')"
    calm = f"CASE WHEN length({bare}) <= 3 OR {bare} IN {in_list(ACRONYMS)} THEN w ELSE concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) END"
    return f"(CASE WHEN length({text}) > 4 AND {text} = upper({text}) THEN array_to_string(list_transform(string_split({text}, ' '), lambda w: {calm}), ' ') ELSE {text} END)"


def domain(c: str) -> str:
    h = f"lower(trim({c}))"
    for pattern in ("(?s)^.*@", r"^[a-z][a-z0-9+.-]*://", r"(?s)[/?#:].*$", r"\.+$", r"^www\d?\."):
        h = f"regexp_replace({h}, {quoted(pattern)}, '')"
    two = f"regexp_extract({h}, '([^.]+\\.[^.]+)$', 1)"
    three = f"regexp_extract({h}, '([^.]+\\.[^.]+\\.[^.]+)$', 1)"
    valid = f"regexp_matches({h}, '^[a-z0-9.-]+\\.[a-z]{{2,}}$') AND NOT starts_with({h}, '.') AND NOT contains({h}, '..')"
    return f"(CASE WHEN {valid} THEN CASE WHEN {two} IN {in_list(TWO_LABEL_SUFFIXES)} AND {three} <> '' THEN {three} ELSE {two} END END)"


def keyword_filter(w: str) -> str:
    return f"length({w}) >= 4 AND {w} NOT IN {in_list(STOP_WORDS)} AND NOT regexp_matches({w}, '^[0-9]+$')"


def word_list(c: str) -> str:
    return f"string_split_regex(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+')"


def round_to(value: str, places: int) -> str:
    factor = f"{float(10 ** places)}::DOUBLE"
    return f"(floor((({value})::DOUBLE + 2.220446049250313e-16::DOUBLE) * {factor} + 0.5::DOUBLE) / {factor})"


def fnv1a(c: str) -> str:
    codes = f"list_transform(list_filter(string_split(coalesce({c}, ''), ''), lambda x: x <> ''), lambda x: ord(x)::BIGINT)"
    return f"lpad(lower(to_hex(list_reduce(list_prepend(2166136261::BIGINT, {codes}), lambda h, x: (xor(h, x) * 16777619::BIGINT) & 4294967295::BIGINT))), 8, '0')"
