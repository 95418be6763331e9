"""SQL (DuckDB) for the corpus queries that SQL can express."""

from __future__ import annotations

from quillseek.llm import chat, licences, url_filter

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
    WITH d AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size, sha256(norm) AS text_sha256 FROM d GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (norm)
"""

#: Links by comparing all pairs; components by following links.
NEAR_VECTORS = """
    WITH RECURSIVE v AS (
        SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
    c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
    n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

#: Sources by how soon they are full; the first that isn't gives the level of all that aren't.
MIXING = r"""
    WITH d AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
            ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT AS h
        FROM documents
    ),
    s AS (
        SELECT source, sum(size)::DOUBLE AS n, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
        FROM d GROUP BY source
    ),
    o AS (
        SELECT *, coalesce(sum(2 * n) OVER (ORDER BY n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
            sum(w) OVER (ORDER BY n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w, 1.5 * sum(n) OVER () AS total, row_number() OVER (ORDER BY n / w, source) AS k
        FROM s
    ),
    lv AS (SELECT arg_min((total - full_before) / open_w, k) AS level FROM o WHERE (total - full_before) / open_w * w <= 2 * n),
    t AS (SELECT source, n, CASE WHEN level * w > 2 * n THEN 2 * n ELSE level * w END AS target FROM s, lv),
    b AS (SELECT *, CASE WHEN n > 0 THEN least(floor(target / n), 2) ELSE 0 END AS base FROM t),
    r AS (
        SELECT d.*, b.n, b.target, b.base, b.target - b.base * b.n AS budget,
            coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY d.source, h) AS own
        FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
    )
    SELECT doc_id, size, n::BIGINT AS source_size, target,
        (size * (base + CASE WHEN before + own <= budget OR (before < budget AND own <= 2 * (budget - before)) THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM r
"""


def _escaped(text: str) -> str:
    for old, new in chat.ESCAPES:
        text = f"replace({text}, '{old}', '{new}')"
    return text


CHAT = f"""
    WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
    ),
    t AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS begins FROM turns)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LOSS_ROLE}'), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
        sum(length({_escaped("text")}) + CASE WHEN begins THEN {len(chat.START + chat.CONTENT + chat.END)} + length({_escaped("role")}) ELSE {len(chat.TURN)} END)::BIGINT AS formatted_chars
    FROM t GROUP BY conv_id
"""


def _rules() -> tuple[str, str]:
    """The longest rule that fits host and path, allowing ones first, and its verdict."""
    ordered = sorted(url_filter.RULES, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow"))
    whens = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for h, p, v in ordered]
    rule = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in whens)
    verdict = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in whens)
    return f"CASE {rule} END", f"CASE {verdict} END"


def _urls() -> str:
    rule, verdict = _rules()
    rest = "CASE WHEN contains({0}, '://') THEN substr({0}, strpos({0}, '://') + 3) END"
    host = "coalesce(" + LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)") + ", '')"
    parts = f"SELECT *, {host} AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM ({{}})"
    node = f"{LOWER.format("split_part({0}, '://', 1)")} || '://' || host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1)"
    tag = "list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*[\"'']?canonical\\b'))"
    return f"""
        WITH RECURSIVE p AS ({parts.format(f"SELECT page_id, url, html, {rest.format('url')} AS rest FROM pages")}),
        q AS (SELECT *, {node.format("url")} AS node FROM p),
        named AS (
            SELECT node AS a, regexp_extract(unnest({tag}), '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target FROM q WHERE node IS NOT NULL AND html IS NOT NULL
        ),
        e AS (SELECT a, node AS b FROM (SELECT *, {node.format("target")} AS node FROM ({parts.format(f"SELECT a, target, {rest.format('target')} AS rest FROM named WHERE contains(target, '://')")})) WHERE a <> node),
        both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        reach AS (SELECT a, a AS b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
        judged AS (SELECT a, bool_or(coalesce({verdict} = 'block', false)) AS blocked FROM ({parts.format(f"SELECT a, {rest.format('b')} AS rest FROM reach")}) GROUP BY a)
        SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict FROM q LEFT JOIN judged ON node = a
    """


URLS = _urls()
LICENCES = licences.scan_sql()
