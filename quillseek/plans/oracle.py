"""SQL (DuckDB) for what searches return, from the definitions of scores and not from the engine.

Without a location a fuzzy score is the least edit distance to any substring over the pattern's length.
"""

from __future__ import annotations

from collections.abc import Sequence

from quillseek.functions.text import TOKEN

EXACT = 2.0**-52
DEFAULT_TOKEN = TOKEN


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def distance(pattern: str, text: str) -> str:
    """Least edit distance between a pattern and any substring."""
    inner = f"list_transform(range(1, len({text}) - i + 2), lambda n: levenshtein({quoted(pattern)}, substr({text}, i, n)))"
    return f"coalesce(list_min(list_transform(range(1, len({text}) + 1), lambda i: list_min({inner}))), {len(pattern)})"


def fuzzy(pattern: str, text: str, threshold: float = 0.6) -> str:
    """Raw score of a folded text; null if it doesn't match."""
    m = len(pattern)
    d = distance(pattern, text)
    return f"(CASE WHEN {text} = {quoted(pattern)} THEN 0.0::DOUBLE WHEN {d} < {m} AND {d} / {m}::DOUBLE <= {threshold} THEN greatest(0.001, {d} / {m}::DOUBLE) END)"


def places(pattern: str, text: str) -> str:
    """For each place of a text the least edit distance between a pattern and a substring that begins there."""
    return f"list_transform(range(0, len({text})), lambda p: list_min(list_transform(range(0, len({text}) - p + 1), lambda n: levenshtein({quoted(pattern)}, substr({text}, p + 1, n)))))"


def whole_text(pattern: str, text: str, threshold: float) -> str:
    """As `fuzzy`, for long texts: only substrings whose length the allowed errors permit are compared, and only where one of as many
    pieces of the pattern as there are errors, and one more, is in reach."""
    m = len(pattern)
    k = max(e for e in range(m) if e / m <= threshold)
    pieces = [pattern[m * i // (k + 1) : m * (i + 1) // (k + 1)] for i in range(k + 1)]
    # Stretches of a text that overlap by all that a match can span; places are cheap to reach in them.
    stretches = f"list_transform(range(1, len(s) + 1), lambda i: s[i] || coalesce(substr(s[i + 1], 1, {m + k - 1}), ''))"
    some = " OR ".join(f"contains(c, {quoted(x)})" for x in pieces)
    near = " OR ".join(f"contains(substr(c, p, {m + k}), {quoted(x)})" for x in pieces)
    inner = f"list_min([{', '.join(f'levenshtein({quoted(pattern)}, substr(c, p, {n}))' for n in range(m - k, m + k + 1))}])"
    best = f"list_min(list_transform(list_filter(range(1, len(c) + 1), lambda p: {near}), lambda p: {inner}))"
    d = f"list_min(list_transform(list_filter({stretches}, lambda c: {some}), lambda c: {best}))"
    found = f"CASE WHEN {text} = {quoted(pattern)} THEN 0.0::DOUBLE WHEN d <= {k} THEN greatest(0.001, d / {m}::DOUBLE) END"
    return f"(SELECT {found} FROM (SELECT {d} AS d FROM (SELECT regexp_extract_all({text}, '(?s).{{1,200}}') AS s)))"


def marked(pattern: str, text: str, least: int) -> str:
    """Raw score of a folded text, as `fuzzy`, if so many adjacent letters of the pattern are where the best match first begins."""
    m = len(pattern)
    letters = "[" + "".join(sorted(set(pattern))) + "]"
    found = f"substr({text}, list_position(d, list_min(d)), {m} + list_min(d))"
    near = f"list_min(d) < {m} AND list_min(d) / {m}::DOUBLE <= 0.6 AND regexp_matches({found}, '{letters}{{{least},}}')"
    return f"(SELECT CASE WHEN {text} = {quoted(pattern)} THEN 0.0::DOUBLE WHEN {near} THEN greatest(0.001, list_min(d) / {m}::DOUBLE) END FROM (SELECT {places(pattern, text)} AS d))"


def located(pattern: str, text: str, threshold: float = 0.6, location: int = 0, distance: int = 100, find_all: bool = False) -> str:
    """Raw score of a folded text where the place of a match counts; null if it doesn't match.

    Errors are allowed one by one.  With e errors the places where the pattern begins are passed from the right to the left, as far
    as a match there could be good enough.  A place costs e / length + its distance from the location / `distance`; one that
    costs no more than the limit lowers the limit to it.  The place of that kind that is nearest on the right bounds how
    far the left is passed, and the first on the left ends the level.  The last place that was passed gives the score.
    """
    m = len(pattern)
    x, fit = f"least({location}, n)", "least(x + w, n)"
    rows = f"SELECT {text} AS f, {places(pattern, text)} AS d, len({text}) AS n"
    rows = f"SELECT *, {x} AS x, {threshold}::DOUBLE AS lim, 1.0::DOUBLE AS fin, false AS ok FROM ({rows})"
    exact = f"list_min(list_transform(list_filter(range(0, n), lambda p: d[p + 1] = 0 AND p >= x), lambda p: abs(p - x) / {distance}::DOUBLE))"
    rows = f"SELECT * REPLACE (least(lim, coalesce({exact}, lim)) AS lim) FROM ({rows})"
    for e in range(m):
        if e / m > threshold:
            break
        cost = lambda p, e=e: f"({e} / {m}::DOUBLE + abs({p} - x) / {distance}::DOUBLE)"
        last = "n - 1" if find_all else f"{fit} + {m} - 1"
        # w: how far from the location a match may be; r, l: the nearest places on both sides; g: whether this level is reached at all.
        rows = f"SELECT *, {e} / {m}::DOUBLE <= lim AS g, floor((lim - {e} / {m}::DOUBLE) * {distance} + 1e-9) AS w FROM ({rows})"
        rows = f"SELECT *, CASE WHEN g THEN list_filter(range(0, n), lambda p: d[p + 1] <= {e} AND p <= {last}) ELSE [] END AS h FROM ({rows})"
        rows = f"SELECT *, list_min(list_filter(h, lambda p: p > x)) AS r FROM ({rows})"
        rows = f"SELECT *, coalesce({cost('r')} <= lim, false) AS r_ok FROM ({rows})"
        rows = f"SELECT * REPLACE (CASE WHEN r IS NOT NULL THEN {cost('r')} ELSE fin END AS fin, CASE WHEN r_ok THEN {cost('r')} ELSE lim END AS lim), CASE WHEN r_ok THEN greatest(0, 2 * x - r - 1) ELSE greatest(0, x - w) END AS low FROM ({rows})"
        rows = f"SELECT *, list_filter(h, lambda p: p <= x AND p >= low) AS left_h FROM ({rows})"
        rows = f"SELECT *, list_max(left_h) AS l FROM ({rows})"
        rows = f"SELECT *, coalesce({cost('l')} <= lim, false) AS l_ok FROM ({rows})"
        rows = (
            f"SELECT f, d, n, x, CASE WHEN l_ok THEN {cost('l')} ELSE lim END AS lim, ok OR r_ok OR l_ok AS ok,"
            f" CASE WHEN l_ok THEN {cost('l')} WHEN l IS NOT NULL THEN {cost('list_min(left_h)')} ELSE fin END AS fin FROM ({rows})"
        )
    return f"(SELECT CASE WHEN f = {quoted(pattern)} THEN 0.0::DOUBLE WHEN ok THEN greatest(0.001, fin) END FROM ({rows}))"


def holds(condition: str) -> str:
    """Raw score of a condition that holds or doesn't."""
    return f"(CASE WHEN {condition} THEN 0.0::DOUBLE END)"


def norm(text: str, weight: float = 1.0) -> str:
    words = f"greatest(1, len(regexp_extract_all({text}, '[^\\t-\\r \\x{{A0}}]+')))"
    return f"(floor(1000.0::DOUBLE / pow({words}::DOUBLE, {0.5 * weight}) + 0.5) / 1000.0)"


def factor(raw: str, exponent: str, keyed: bool = True) -> str:
    """What a match contributes to its record's score; null if there is none."""
    base = f"CASE WHEN {raw} = 0 THEN {EXACT!r}::DOUBLE ELSE {raw} END" if keyed else raw
    return f"(CASE WHEN {raw} IS NOT NULL THEN pow({base}, {exponent}) END)"


def key_factor(raw: str, text: str, weight: float = 1.0, normed: bool = True, norm_weight: float = 1.0) -> str:
    """raw may name the folded text; text is the one whose words are counted."""
    return factor(raw, f"{weight!r}::DOUBLE" + (f" * {norm(text, norm_weight)}" if normed else ""))


def product(factors: Sequence[str]) -> str:
    return " * ".join(f"coalesce({f}, 1.0)" for f in factors)


def anything(factors: Sequence[str]) -> str:
    return " OR ".join(f"({f}) IS NOT NULL" for f in factors)


def records(table: str, pk: str, factors: dict[str, str], matched: str | None = None, log: bool = True, extra: str = "") -> str:
    """pk and rounded score of the records of a table; factors by name, of which some (or `matched`) must not be null."""
    columns = ", ".join(f"{f} AS {name}" for name, f in factors.items())
    names = list(factors)
    score = product(names)
    shown = f"round(ln({score}), 6)" if log else f"round({score}, 6)"
    return f"SELECT {pk}::BIGINT AS {pk}, {shown} AS score FROM (SELECT {pk}, {columns} FROM {table}) WHERE {matched or anything(names)} {extra}"


def token_statistics(table: str, texts: Sequence[str], words: Sequence[str], token: str = DEFAULT_TOKEN) -> str:
    """A one-row subquery: n, the texts with tokens, and d0, d1, ..., how many texts have each word."""
    rows = " UNION ALL ".join(f"SELECT regexp_extract_all({t}, {quoted(token)}) AS w FROM {table}" for t in texts)
    counts = ", ".join(f"count(*) FILTER (WHERE list_contains(w, {quoted(x)})) AS d{i}" for i, x in enumerate(words))
    return f"(SELECT count(*) FILTER (WHERE len(w) > 0) AS n, {counts} FROM ({rows}))"


def idf(i: int) -> str:
    return f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5))"


def token_raw(raws: Sequence[str]) -> str:
    """Raw score of a text from the raw scores of the query's words."""
    got = " + ".join(f"coalesce({idf(i)} * (1 - {r}), 0)" for i, r in enumerate(raws))
    total = " + ".join(idf(i) for i in range(len(raws)))
    return f"(CASE WHEN {' OR '.join(f'{r} IS NOT NULL' for r in raws)} THEN greatest(0.001, 1 - ({got}) / ({total})) END)"
