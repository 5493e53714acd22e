"""Pieces of SQL for the oracle: the text functions of the core as DuckDB expressions."""

from __future__ import annotations

from lexigrid.functions import dims

MARKED, PLAIN = dims.accent_map()


def s(v) -> str:
    """A literal."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def listed(vs) -> str:
    return "[" + ", ".join(map(s, vs)) + "]"


def mapped(m) -> str:
    return "MAP {" + ", ".join(f"{s(k)}: {s(v)}" for k, v in m.items()) + "}"


def values(rows, names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(map(s, r)) + ")" for r in rows) + f") AS t({names})"


def fold(x: str) -> str:
    return f"translate({x}, {s(MARKED)}, {s(PLAIN)})"


def slug(x: str) -> str:
    return f"trim(regexp_replace({fold(f'lower({x})')}, '[^a-z0-9]+', '-', 'g'), '-')"


def words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}), '\s+'), lambda w: w <> '')"


def terms(x: str) -> str:
    return f"list_filter(list_distinct({words(x)}), lambda w: NOT list_contains({listed(dims.STOP_WORDS)}, w))"


def canonical(x: str) -> str:
    m = mapped({k.lower(): v.lower() for k, v in dims.QUERY_ABBREVIATIONS.items()})
    w = rf"list_transform(string_split(trim(regexp_replace(lower({x}), '\s+', ' ', 'g')), ' '), lambda w: coalesce({m}[w], w))"
    bare = rf"regexp_replace({fold(f'array_to_string({w}, chr(32))')}, '[^\p{{L}}\p{{N}}_\s]', '', 'g')"
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


def document_number(x: str) -> str:
    return f"regexp_replace(translate(replace({x}, '/', '-'), 'Đđ', 'Dd'), '[^A-Za-z0-9-]', '', 'g')"


def article_number(x: str) -> str:
    g = lambda p: f"nullif(regexp_extract({x}, '{p}', 1), '')"
    return rf"CAST(coalesce({g(r':d(\d+)')}, {g(r'(?i)điều\s+(\d+)')}, {g(r'^d?(\d+)$')}) AS INTEGER)"


def ngrams(w: str, n: int) -> str:
    return f"CASE WHEN len({w}) >= {n} THEN list_transform(range(1, len({w}) - {n} + 2), lambda i: array_to_string({w}[i:i + {n} - 1], ' ')) ELSE [] END"


def predicate(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(upper(trim({x})), '\s+', '_', 'g'), '_+', '_', 'g'), '_')"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {s(n)})" for n in needles) + ")"


def intent(x: str) -> str:
    q = f"lower({x})"
    return "CASE " + " ".join(f"WHEN {any_of(q, ns)} THEN {s(k)}" for k, ns in dims.INTENT_WORDS.items()) + rf" WHEN regexp_matches({x}, '[Đđ]iều\s+\d+') THEN 'reference' ELSE 'general' END"


def query_type(x: str) -> str:
    return "CASE " + " ".join("WHEN regexp_matches({}, {}) THEN {}".format(x, s("(?i)" + "|".join(f"(?:{p})" for p in ps)), s(k)) for k, ps in dims.QUERY_TYPE_PATTERNS.items()) + " ELSE 'general' END"


def valid(x: str) -> str:
    """A confidence or null where it is NaN."""
    return f"(CASE WHEN CAST({x} AS VARCHAR) <> 'nan' THEN {x} END)"
