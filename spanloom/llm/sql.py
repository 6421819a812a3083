"""DuckDB SQL for the corpus queries that SQL can express."""

from spanloom.llm.mixing import REST, TARGETS

KNN = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score
  FROM whole q JOIN whole x ON q.vec_id <> x.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

def _target_sql(dim: str, named: dict[str, float] | None, power: float) -> str:
    if named is None:
        return f"of_{dim} AS (SELECT {dim} AS v, pow(CAST(sum(n) AS DOUBLE), {power}) AS raw FROM cells GROUP BY 1)"
    cases = " ".join(f"WHEN v = '{v}' THEN CAST({s!r} AS DOUBLE)" for v, s in named.items())
    over = max(REST, 1 - sum(named.values()))
    return f"""of_{dim} AS (
  SELECT v, coalesce(share, CAST({over!r} AS DOUBLE) * n / sum(n) FILTER (WHERE share IS NULL) OVER ()) AS raw
  FROM (SELECT v, n, CASE {cases} END AS share FROM (SELECT {dim} AS v, CAST(sum(n) AS DOUBLE) AS n FROM cells GROUP BY 1)))"""


def rake_sql(targets: dict[str, dict[str, float]] = TARGETS, rounds: int = 40, power: float = 0.7, keep: float = 0.8) -> str:
    """Raking as a chain of steps: every step scales the cells to the targets of one dimension."""
    steps = [
        """marked AS (
  SELECT doc_id, text, source, lang,
    CASE WHEN contains(text, ' | ') THEN 'tabular' WHEN coalesce(length(text), 0) < 600 THEN 'brief'
         WHEN coalesce(length(text), 0) < 3000 THEN 'article' ELSE 'long' END AS topic,
    CAST(coalesce(len(regexp_extract_all(text, '\\p{L}+|\\p{N}+|[^\\p{L}\\p{N} \\t\\n\\x0B\\f\\r]+')), 0) AS BIGINT) AS n_tokens
  FROM documents
)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS n FROM marked GROUP BY ALL)",
    ]
    for d in ("source", "lang", "topic"):
        steps.append(_target_sql(d, targets.get(d), power))
        steps.append(f"to_{d} AS MATERIALIZED (SELECT v, raw / (SELECT sum(raw) FROM of_{d}) AS t FROM of_{d})")
    steps.append("w0 AS (SELECT source, lang, topic, n / (SELECT sum(n) FROM cells) AS share, n / (SELECT sum(n) FROM cells) AS w FROM cells)")
    k = 0
    for _ in range(rounds):
        for d in ("source", "lang", "topic"):
            steps.append(
                f"m{k} AS MATERIALIZED (SELECT {d} AS v, sum(w) AS m FROM w{k} GROUP BY 1), "
                f"w{k + 1} AS MATERIALIZED (SELECT source, lang, topic, share, CASE WHEN m > 0 THEN w * t / m ELSE 0.0 END AS w FROM w{k} "
                f"JOIN m{k} ON w{k}.{d} IS NOT DISTINCT FROM m{k}.v JOIN to_{d} ON w{k}.{d} IS NOT DISTINCT FROM to_{d}.v)"
            )
            k += 1
    off = " UNION ALL ".join(f"SELECT max(abs(m - t)) AS e FROM (SELECT {d} AS v, sum(w) AS m FROM w{k} GROUP BY 1) x JOIN to_{d} ON x.v IS NOT DISTINCT FROM to_{d}.v" for d in ("source", "lang", "topic"))
    steps.append(f"errors AS (SELECT round(max(e), 6) AS marginal_error FROM ({off}))")
    steps.append(f"factors AS MATERIALIZED (SELECT *, CASE WHEN share > 0 THEN w / share ELSE 1.0 END AS factor FROM w{k})")
    steps.append(
        f"""levels AS (
  SELECT a.factor, ({keep} - coalesce(sum(b.share), 0)) / ((SELECT sum(factor * share) FROM factors) - coalesce(sum(b.factor * b.share), 0)) AS level
  FROM factors a LEFT JOIN factors b ON b.factor > a.factor GROUP BY a.factor
), level AS (SELECT max(level) AS level FROM levels WHERE level >= 0 AND level * factor <= 1)"""
    )
    steps.append("probs AS (SELECT source, lang, topic, round(factor, 6) AS weight, round(CASE WHEN level IS NULL THEN 1.0 ELSE least(1.0, level * factor) END, 6) AS prob FROM factors, level)")
    return (
        "WITH "
        + ",\n".join(steps)
        + """
SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, p.weight, p.prob, e.marginal_error,
  CAST(('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), d.text, '')), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) < p.prob AS kept
FROM marked d JOIN probs p ON d.source IS NOT DISTINCT FROM p.source AND d.lang IS NOT DISTINCT FROM p.lang AND d.topic IS NOT DISTINCT FROM p.topic
CROSS JOIN errors e
"""
    )


_CASE = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _node(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), {_CASE}) || CASE WHEN {rest} = '' THEN '/' ELSE {rest} END"


def _absolute(link: str) -> str:
    link = f"trim(replace({link}, '&amp;', '&'))"
    return f"CASE WHEN contains({link}, '://') THEN {link} WHEN {link} LIKE '//%' THEN scheme || ':' || {link} WHEN {link} LIKE '/%' THEN scheme || '://' || host || {link} END"


_RULE = """CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END"""

URLS = f"""
WITH RECURSIVE parts AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {_CASE}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme,
    CASE WHEN contains(url, '://') THEN {_node("url")} END AS node
  FROM pages
), ruled AS (
  SELECT *, {_RULE} AS rule
  FROM parts
), tags AS (
  SELECT node, scheme, host, regexp_extract(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0) AS link,
    regexp_extract(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0) AS meta
  FROM parts WHERE node IS NOT NULL
), targets AS (
  SELECT node, scheme, host, regexp_extract(link, '(?is)\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 1) || regexp_extract(link, '(?is)\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 2)
    || regexp_extract(link, '(?is)\\bhref\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 3) AS t FROM tags WHERE link <> ''
  UNION ALL SELECT node, scheme, host, regexp_extract(meta, '(?is)\\burl\\s*=\\s*["'']?([^"''>\\s]+)', 1) FROM tags WHERE meta <> ''
), ends AS (
  SELECT node AS a, {_absolute("t")} AS u FROM targets
), edges AS (
  SELECT a, {_node("u")} AS b FROM ends WHERE contains(u, '://')
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges
), reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), bad AS (
  SELECT node FROM ruled WHERE rule IN ('example.org/es/', 'example.org/en/1', 'com/de/')
  UNION SELECT node FROM (SELECT b AS node, split_part(b, '/', 1) AS host, regexp_extract(b, '(?s)^[^/]*([^?]*)', 1) AS path FROM edges)
  WHERE {_RULE} IN ('example.org/es/', 'example.org/en/1', 'com/de/')
), tainted AS (
  SELECT node FROM bad UNION SELECT r.node FROM reach r JOIN bad ON r.other = bad.node
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR t.node IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN tainted t ON ruled.node = t.node
"""

ORACLES: dict[str, str] = {
    "op2_rake_mixing": rake_sql(),
    "op8_redirect_equivalence": URLS,
    "op9_voronoi_knn": KNN,
}
