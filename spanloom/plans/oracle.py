"""DuckDB SQL for the library's queries: a relational formulation, apart from the array functions used on Spark."""

from __future__ import annotations

from spanloom.functions.charmaps import TABLES
from spanloom.functions.text import ENGLISH, TERM_FIXES
from spanloom.operators.jobs import STATUS
from spanloom.operators.translate import LEXICON

S = "[ \\t\\n\\r\\f]"

#: The layout lift, by windows over tokens.
LIFT = r"""
paras AS (
  SELECT doc_id, b.i AS block_no, regexp_extract_all(b.p, '[^ \t\r\f\x0B]+') AS toks
  FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda p, i: {'i': CAST(i - 1 AS INTEGER), 'p': p})) AS b
        FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), tokens AS (
  SELECT doc_id, block_no, u.wno AS wno, u.tok AS tok, CAST(u.wno // 12 AS INTEGER) AS line_no
  FROM (SELECT doc_id, block_no, unnest(list_transform(toks, lambda t, i: {'wno': CAST(i - 1 AS INTEGER), 'tok': t})) AS u FROM paras)
), numbered AS (
  SELECT *, regexp_matches(tok, '[0-9#$%&*+=<>_/|@^~-]') AS math,
    CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY block_no, line_no) - 1 AS INTEGER) AS line_seq
  FROM tokens
), cut AS (
  SELECT *, CAST(line_seq // 35 AS INTEGER) AS page_idx, line_seq % 35 AS line_in_page, CAST(wno % 12 AS INTEGER) AS span_no,
    CASE WHEN math IS DISTINCT FROM lag(math) OVER w AND lag(math) OVER w IS NOT NULL THEN 1 ELSE 0 END AS turn,
    coalesce(sum(length(tok) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    lead(wno) OVER w IS NULL AS is_last
  FROM numbered WINDOW w AS (PARTITION BY doc_id, line_seq ORDER BY wno)
), frags AS (
  SELECT *, CAST(sum(turn) OVER (PARTITION BY doc_id, line_seq ORDER BY wno) AS INTEGER) AS frag FROM cut
), firsts AS (
  SELECT *, min(wno) OVER (PARTITION BY doc_id, line_seq, frag) AS first_wno FROM frags
), spans AS (
  SELECT doc_id, page_idx, block_no, line_seq, span_no, frag, wno, first_wno, NOT math AS is_text,
    CASE WHEN math OR is_last THEN tok ELSE tok || ' ' END AS text, font,
    CASE WHEN contains(font, 'SFBX1440') THEN 14.5 ELSE 10.0 END AS size,
    x0, y0 + up AS y0, x0 + 5 * length(tok) AS x1, y0 + up + 10 AS y1, y0 + up + 8 AS oy
  FROM (
    SELECT *, CAST(72 + CASE WHEN block_no % 3 = 1 THEN 24 ELSE 0 END + 5 * before AS DOUBLE) AS x0, CAST(72 + 18 * line_in_page AS DOUBLE) AS y0,
      CASE WHEN NOT math THEN 0.0 WHEN (doc_id + first_wno) % 2 = 0 THEN -3.0 ELSE -8.0 END AS up,
      'ABCDEF+' || CASE
        WHEN math THEN ['CMMI10', 'CMR10', 'CMSY10', 'CMEX10', 'rsfs10', 'MSBM10'][CAST((doc_id + wno) % 6 + 1 AS INTEGER)]
        WHEN block_no = 0 AND line_no = 0 THEN 'SFBX1440'
        WHEN (wno // 5) % 7 = 3 THEN 'SFTI1000' WHEN (wno // 5) % 11 = 5 THEN 'SFBX1000' WHEN (wno // 5) % 13 = 6 THEN 'SFBI1000'
        ELSE 'SFRM1000' END AS font
    FROM firsts)
), styled AS (
  SELECT *, CASE WHEN contains(font, 'SFBI') THEN 'bolditalic' WHEN contains(font, 'SFBX') THEN 'bold' WHEN contains(font, 'SFTI') THEN 'italic' ELSE 'regular' END AS style,
    CASE WHEN split_part(font, '+', -1) LIKE 'CMR%' THEN substr(split_part(font, '+', -1), 1, 4)
         ELSE substr(split_part(font, '+', -1), 1, 4) END AS family
  FROM spans
)"""

SQL: dict[str, str] = {}


def add(name: str, body: str, steps: str = "") -> None:
    """Registers ``body`` over the lift and further ``steps``."""
    SQL[name] = "WITH RECURSIVE " + LIFT.strip() + (",\n" + steps.strip() if steps else "") + "\n" + body.strip()


#: Blocks' English marks.
MARKS = "('" + "','".join(ENGLISH) + "')"
#: Strips blanks from both ends of ``{0}``.
STRIP = "regexp_replace({0}, '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g')"
LEADER = "(\\.[ \t\n\r\f]){3,}"
NUMERIC = "^([ \t\n\r\f]|[0-9.,;:!?()\\[\\]/*+=-])+$"

K, B = "doc_id, page_idx, block_no, line_no", "doc_id, page_idx, block_no"
STYLE_ = "CASE WHEN contains(font, 'SFBI') THEN 'bolditalic' WHEN contains(font, 'SFBX') THEN 'bold' WHEN contains(font, 'SFTI') THEN 'italic' ELSE 'regular' END"

#: All spans by raw line, and raw lines.
RAWS = f"""
loose AS (
  SELECT doc_id, page_idx, block_no, line_seq, frag, 0 AS over_, span_no AS place, text, font, size, x0, y0, x1, y1, oy FROM styled
  UNION ALL
  SELECT doc_id, page_idx, block_no, line_seq, frag, 1, 0, 'd', 'ABCDEF+CMMI7', 7.0, x0, y0 - 3, x0 + 4, y0 + 2, oy - 5 FROM styled
  WHERE wno = first_wno AND (doc_id + wno) % 2 = 0 AND wno % 3 = 0 AND NOT is_text
), entries AS (
  SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'), 1, 3), ' ') || ' . . . . . ' || CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 200 AS VARCHAR) ELSE '' END AS entry,
    CASE WHEN doc_id % 2 <> 0 THEN CAST(doc_id % 200 AS VARCHAR) END AS num, CASE doc_id % 3 WHEN 0 THEN 50.0 WHEN 1 THEN 49.0 ELSE 51.0 END AS num_y
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), located AS (
  SELECT doc_id, page_idx, block_no, CAST(line_seq * 100 + dense_rank() OVER (PARTITION BY doc_id, line_seq ORDER BY frag, over_) - 1 AS INTEGER) AS raw_no,
    CAST(row_number() OVER (PARTITION BY doc_id, line_seq, frag, over_ ORDER BY place) - 1 AS INTEGER) AS span_no, text, font, size, x0, y0, x1, y1, oy FROM loose
  UNION ALL
  SELECT doc_id, 0, -1, 0, 0, entry, 'ABCDEF+SFRM1000', 10.0, 72.0, 50.0, CAST(72 + 5 * length(entry) AS DOUBLE), 60.0, 58.0 FROM entries
  UNION ALL
  SELECT doc_id, 0, -1, 1, 0, num, 'ABCDEF+SFRM1000', 10.0, 400.0, num_y, CAST(400 + 5 * length(num) AS DOUBLE), num_y + 10, num_y + 8 FROM entries WHERE num IS NOT NULL
), allspans AS MATERIALIZED (
  SELECT *, contains(font, '+SF') AS is_text, {STYLE_} AS style, substr(split_part(font, '+', -1), 1, 4) AS family FROM located
), rawlines AS MATERIALIZED (
  SELECT doc_id, page_idx, block_no, raw_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
    coalesce(min(y0) FILTER (WHERE NOT contains(font, 'CMEX')), avg(oy) - 3) AS c0, coalesce(max(y1) FILTER (WHERE NOT contains(font, 'CMEX')), avg(oy) + 3) AS c1,
    avg(oy) AS mean_oy, bool_or(is_text) AS has_text, bool_and(contains(font, 'CMEX')) AS tall, string_agg(text, '' ORDER BY span_no) AS said
  FROM allspans GROUP BY doc_id, page_idx, block_no, raw_no
)"""
#: The fold of a block's raw lines, one after the other, and the lines it gives.
FOLD = (
    RAWS.strip()
    + """, queue AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY doc_id, page_idx, block_no ORDER BY tall, raw_no) AS k, count(*) OVER (PARTITION BY doc_id, page_idx, block_no) AS n FROM rawlines
), fold AS (
  SELECT doc_id, page_idx, block_no, k, n, [{'c0': c0, 'c1': c1, 'm': [{'r': raw_no, 'x0': x0, 'x1': x1}]}] AS gs FROM queue WHERE k = 1
  UNION ALL
  SELECT doc_id, page_idx, block_no, k, n,
    CASE WHEN coalesce(hit, 0) > 0 THEN list_transform(gs, lambda g, i: CASE WHEN i = hit THEN {'c0': g.c0, 'c1': g.c1, 'm': list_append(g.m, own)} ELSE g END)
         ELSE list_append(gs, {'c0': c0, 'c1': c1, 'm': [own]}) END
  FROM (
    SELECT q.doc_id, q.page_idx, q.block_no, q.k, q.n, q.c0, q.c1, f.gs, {'r': q.raw_no, 'x0': q.x0, 'x1': q.x1} AS own,
      CASE WHEN q.tall THEN
        list_sort(list_filter(flatten(list_transform(f.gs, lambda g, i: list_transform(g.m, lambda m: {'gap': least(abs(q.x0 - m.x1), abs(m.x0 - q.x1)), 'i': CAST(i AS INTEGER)}))), lambda e: e.gap < 20))[1].i
      ELSE list_position(list_transform(f.gs, lambda g: least(q.c1 - q.c0, g.c1 - g.c0) > 0 AND 2 * (least(q.c1, g.c1) - greatest(q.c0, g.c0)) >= least(q.c1 - q.c0, g.c1 - g.c0)), true) END AS hit
    FROM fold f JOIN queue q ON q.doc_id = f.doc_id AND q.page_idx = f.page_idx AND q.block_no = f.block_no AND q.k = f.k + 1)
), fits AS (
  SELECT doc_id, page_idx, block_no, unnest(list_transform(gs, lambda g, i: {'y_group': CAST(i - 1 AS INTEGER), 'm': g.m}), recursive := false) AS g FROM fold WHERE k = n
), members AS (
  SELECT doc_id, page_idx, block_no, y_group, e.p AS p, e.r AS raw_no FROM (
    SELECT doc_id, page_idx, block_no, g.y_group AS y_group, unnest(list_transform(g.m, lambda m, i: {'p': i, 'r': m.r}), recursive := false) AS e FROM fits)
), gapped AS (
  SELECT m.*, r.x0, r.x1, r.has_text, row_number() OVER w AS q, CASE WHEN r.x0 - lag(r.x1) OVER w >= 8 THEN 1 ELSE 0 END AS gap
  FROM members m JOIN rawlines r USING (doc_id, page_idx, block_no, raw_no) WINDOW w AS (PARTITION BY doc_id, page_idx, block_no, y_group ORDER BY r.x0, m.p)
), clustered AS (
  SELECT *, CAST(sum(gap) OVER (PARTITION BY doc_id, page_idx, block_no, y_group ORDER BY q) AS INTEGER) AS cluster FROM gapped
), margins AS (
  SELECT *, min(x0) OVER (PARTITION BY doc_id, page_idx, block_no, y_group, cluster) AS lft FROM clustered
), verdicts AS (
  SELECT doc_id, page_idx, block_no, y_group, cluster, CAST(count(*) AS INTEGER) AS n_members, CAST(count(*) FILTER (WHERE x0 < lft + 15 AND has_text) AS INTEGER) AS n_margin,
    count(*) > 1 AND count(*) <= 8 AND bool_or(has_text) AND count(*) FILTER (WHERE x0 < lft + 15 AND has_text) <= 1 AS merged, string_agg(CAST(raw_no AS VARCHAR), ',' ORDER BY q) AS raws
  FROM margins GROUP BY doc_id, page_idx, block_no, y_group, cluster
), places AS MATERIALIZED (
  SELECT c.doc_id, c.page_idx, c.block_no, c.raw_no, c.y_group, c.q,
    CAST(dense_rank() OVER (PARTITION BY c.doc_id, c.page_idx, c.block_no ORDER BY c.y_group, c.cluster, CASE WHEN v.merged THEN 0 ELSE c.q END) - 1 AS INTEGER) AS line_no
  FROM clustered c JOIN verdicts v USING (doc_id, page_idx, block_no, y_group, cluster)
)"""
)
LINES = (
    FOLD
    + f""", placed AS (
  SELECT s.*, p.line_no, row_number() OVER (PARTITION BY {K} ORDER BY s.x0, p.q, s.span_no) AS j FROM allspans s JOIN places p USING ({B}, raw_no)
), runs AS MATERIALIZED (
  SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY {K} ORDER BY j) - 1 AS run
  FROM (SELECT *, NOT is_text AND coalesce(lag(is_text) OVER (PARTITION BY {K} ORDER BY j), true) AS begins FROM placed)
), drafts AS MATERIALIZED (
  SELECT {K}, string_agg(CASE WHEN is_text THEN text WHEN begins THEN '{{M' || CAST(run AS VARCHAR) || '}}' ELSE '' END, '' ORDER BY j) AS template,
    string_agg(CASE WHEN is_text THEN text ELSE '' END, '' ORDER BY j) AS text_only,
    CAST(sum(CASE WHEN begins THEN 1 ELSE 0 END) AS BIGINT) AS n_math, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, arg_min(size, j) AS first_size,
    arg_min(size, j) FILTER (WHERE is_text) AS text_size, arg_min(oy, j) FILTER (WHERE is_text) AS text_oy, arg_min(x0, j) FILTER (WHERE NOT is_text) AS math_x0
  FROM runs GROUP BY {K}
), judged AS MATERIALIZED (
  SELECT *, {STRIP.format("text_only")} <> '' AND NOT regexp_matches({STRIP.format("text_only")}, '{NUMERIC}') AS kept, {STRIP.format("text_only")} = '' AND n_math > 0 AS alone FROM drafts
), lonely AS MATERIALIZED (
  SELECT {K}, x0, (y0 + y1) / 2 AS mid, math_x0, row_number() OVER (PARTITION BY {B} ORDER BY line_no) AS k FROM judged WHERE alone
), homes AS (
  SELECT {B}, list({{'n': line_no, 'mid': (y0 + y1) / 2, 'x': math_x0}} ORDER BY line_no) AS h FROM judged WHERE kept AND n_math > 0 GROUP BY ALL
), attach AS (
  SELECT {B}, CAST(0 AS BIGINT) AS k, h, CAST(NULL AS INTEGER) AS line_no, CAST(NULL AS INTEGER) AS to_line FROM homes
  UNION ALL
  SELECT {B}, k, list_transform(h, lambda e: CASE WHEN e.n = best THEN {{'n': e.n, 'mid': e.mid, 'x': math_x0}} ELSE e END), line_no, best
  FROM (
    SELECT l.doc_id, l.page_idx, l.block_no, l.k, a.h, l.line_no, l.math_x0,
      list_sort(list_transform(list_filter(a.h, lambda e: abs(l.mid - e.mid) < 20 AND abs(l.x0 - e.x) < 15), lambda e: {{'far': abs(l.mid - e.mid), 'n': e.n}}))[1].n AS best
    FROM attach a JOIN lonely l ON l.doc_id = a.doc_id AND l.page_idx = a.page_idx AND l.block_no = a.block_no AND l.k = a.k + 1)
), attached AS MATERIALIZED (
  SELECT {K}, to_line, k FROM attach WHERE to_line IS NOT NULL
), numbers AS (
  SELECT {B}, raw_no, trunc(y0) AS y, {STRIP.format("said")} AS num, x1 AS num_x1 FROM rawlines WHERE regexp_matches({STRIP.format("said")}, '^[0-9]{{1,3}}$')
), tocs AS (
  SELECT *, regexp_matches(template, '{LEADER}') AS is_toc,
    CASE WHEN regexp_matches(template, '{LEADER}') THEN regexp_extract({STRIP.format(f"regexp_extract(template, '(?s)^.*?{LEADER}(.*)$', 2)")}, '^(?:\\.|[ \t\n\r\f])*([0-9]+)[ \t\n\r\f]*$', 1) ELSE '' END AS own_page
  FROM judged WHERE kept
), found AS (
  SELECT t.doc_id, t.page_idx, t.block_no, t.line_no, arg_max(n.num, n.raw_no) AS num, arg_max(n.num_x1, n.raw_no) AS num_x1
  FROM tocs t JOIN numbers n ON n.doc_id = t.doc_id AND n.page_idx = t.page_idx AND n.block_no = t.block_no AND trunc(t.y0) IN (n.y, n.y + 1)
  WHERE t.is_toc AND t.own_page = '' GROUP BY ALL
), stylesums AS (
  SELECT {K}, style, sum(length(text)) AS n, min(j) AS first_j FROM runs WHERE is_text AND {STRIP.format("text")} <> '' GROUP BY ALL
), dominants AS (
  SELECT {K}, style AS font_style FROM stylesums QUALIFY row_number() OVER (PARTITION BY {K} ORDER BY n DESC, first_j) = 1
), lines AS MATERIALIZED (
  SELECT {K}, t.template, n_math, x0, y0, coalesce(num_x1, x1) AS x1, y1, first_size, coalesce(text_size, first_size) AS font_size, coalesce(text_oy, y1) AS baseline,
    coalesce(font_style, 'regular') AS font_style, is_toc, CASE WHEN is_toc THEN {STRIP.format(f"regexp_extract(template, '(?s)^(.*?){LEADER}', 1)")} ELSE '' END AS toc_content, coalesce(num, own_page) AS toc_page_num
  FROM tocs t LEFT JOIN found f USING ({K}) LEFT JOIN dominants USING ({K})
)"""
)

add("span_classify", f"SELECT {B}, raw_no, span_no, is_text, style, family FROM allspans", RAWS)
add(
    "english_blocks",
    f"""
SELECT {B}, CAST(len(w) AS BIGINT) AS n_words, CAST(len(list_filter(w, lambda x: x IN {MARKS})) AS BIGINT) AS n_marks,
  len(w) >= 5 AND 10 * len(list_filter(w, lambda x: x IN {MARKS})) > 3 * len(w) AS is_english
FROM (SELECT {B}, regexp_extract_all(lower(coalesce(string_agg(text, '' ORDER BY raw_no, span_no) FILTER (WHERE is_text), '')), '[a-z]{{3,}}') AS w FROM allspans GROUP BY ALL)
""",
    RAWS,
)
add("line_templates", f"SELECT {K}, template, n_math FROM lines", LINES)
STYLERUNS = f"""
SELECT {K}, run_idx, CAST(sum(length(text)) AS INTEGER) AS n, any_value(style) AS style
FROM (SELECT *, CAST(sum(turn) OVER (PARTITION BY {K} ORDER BY j) AS INTEGER) AS run_idx
      FROM (SELECT r.*, CASE WHEN style <> lag(style) OVER (PARTITION BY {K} ORDER BY j) THEN 1 ELSE 0 END AS turn FROM runs r SEMI JOIN lines USING ({K}) WHERE is_text))
GROUP BY {K}, run_idx
"""
add("style_runs", STYLERUNS, LINES)
add("dominant_style", f"SELECT {K}, font_style FROM lines", LINES)
add(
    "line_filters",
    f"""
SELECT {B}, raw_no, regexp_matches({STRIP.format("said")}, '^[0-9]{{1,3}}$') AS is_page_number, NOT has_text AS no_text,
  regexp_matches({STRIP.format("said")}, '{NUMERIC}') AS numeric_only, regexp_matches(said, '{LEADER}') AS is_toc FROM rawlines
""",
    RAWS,
)
add("toc_parse", f"SELECT {K}, toc_content, toc_page_num, x1 FROM lines WHERE is_toc", LINES)
add("core_y_range", f"SELECT {B}, raw_no, c0, c1, mean_oy, tall FROM rawlines", RAWS)
add("bbox_union", f"SELECT {K}, x0, y0, x1, y1 FROM lines WHERE NOT is_toc", LINES)
add("merge_guard", f"SELECT {B}, y_group, cluster, raws, n_members, n_margin, merged FROM verdicts", FOLD)
add("y_overlap_groups", f"SELECT {B}, raw_no, y_group, line_no FROM places", FOLD)
add("attach_math_lines", f"SELECT {K}, to_line FROM attached", LINES)


def _quoted(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


def _strip(t: str) -> str:
    return STRIP.format(t)


def _lexicon(t: str) -> str:
    cases = " ".join(f"WHEN {_quoted(a)} THEN {_quoted(b)}" for a, b in LEXICON.items())
    return f"array_to_string(list_transform(string_split({t}, ' '), lambda w: CASE w {cases} ELSE w END), ' ')"


def _fixed(t: str) -> str:
    for a, b in TERM_FIXES:
        t = f"replace({t}, {_quoted(a)}, {_quoted(b)})"
    return t


def _mask(t: str) -> str:
    t = f"regexp_replace({t}, '\\{{M([0-9]+)\\}}', 'XXXM\\1XXX', 'g')"
    t = f"regexp_replace({t}, '([a-zA-ZÀ-ÿ])(XXXM[0-9]+XXX)', '\\1 \\2', 'g')"
    return f"regexp_replace({t}, '(XXXM[0-9]+XXX)([a-zA-ZÀ-ÿ])', '\\1 \\2', 'g')"


def _unmask(t: str) -> str:
    t = f"regexp_replace({t}, 'XXXM([0-9]+)XXX', '{{M\\1}}', 'gi')"
    t = f"regexp_replace({t}, '[ \\t\\n\\r\\f]+(\\{{M[0-9]+\\}})[ \\t\\n\\r\\f]+', ' \\1 ', 'g')"
    return _fixed(f"regexp_replace({t}, '[ \\t\\n\\r\\f]+(\\{{M[0-9]+\\}})-', ' \\1-', 'g')")


def _mapped(t: str, family: str) -> str:
    pairs = [(a, b) for a, b in TABLES[family].items() if ord(a) >= 32]
    return f"translate({t}, {_quoted(''.join(a for a, _ in pairs))}, {_quoted(''.join(b for _, b in pairs))})"


MAPPED = "CASE family " + " ".join(f"WHEN '{f}' THEN {_mapped('text', f)}" for f in TABLES) + " ELSE text END"
STYLED = "CASE WHEN family IN ('CMMI', 'CMBS', 'CMSY', 'CMEX', 'rsfs', 'EUFM') THEN 'math' WHEN family = 'CMBX' THEN 'bold' WHEN family IN ('CMR1', 'CMR5', 'CMR7', 'CMR8') THEN 'regular' END"
VISIBLE = "regexp_replace(text, '[ \\t\\n\\r\\f]', '', 'g')"
ROUTE = f"""CASE WHEN {STYLED} IS NULL THEN 'drop'
  WHEN family IN ('rsfs', 'EUFM') AND {VISIBLE} <> '' THEN 'copy'
  WHEN family = 'CMEX' AND translate({VISIBLE}, {_quoted("".join(a for a in TABLES["CMEX"] if ord(a) >= 32))}, '') <> '' THEN 'copy'
  WHEN family = 'CMSY' AND contains({VISIBLE}, chr(824)) THEN 'copy'
  WHEN {VISIBLE} = '' THEN 'blank' ELSE 'draw' END"""

OWN = "CASE WHEN is_toc THEN toc_content ELSE template END"
PARAS = (
    LINES
    + f""", ordered AS (
  SELECT *, CAST(row_number() OVER w - 1 AS INTEGER) AS seq,
    NOT is_toc AND font_style <> 'bold' AND first_size <= 11 AND n_math = 0 AS mergeable, CASE WHEN is_toc THEN toc_content ELSE template END AS own
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY page_idx, block_no, line_no)
), marked AS (
  SELECT *, CASE WHEN mergeable AND lag(mergeable) OVER w AND page_idx = lag(page_idx) OVER w AND abs(x0 - lag(x0) OVER w) < 20
      AND y0 - lag(y1) OVER w < lag(first_size) OVER w AND abs(first_size - lag(first_size) OVER w) < 0.5 THEN 0 ELSE 1 END AS fresh
  FROM ordered WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
), grouped AS (
  SELECT *, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS BIGINT) AS group_id FROM marked
), paras_ AS MATERIALIZED (
  SELECT doc_id, group_id, count(*) AS n_lines, string_agg(own, ' ' ORDER BY seq) AS template FROM grouped GROUP BY doc_id, group_id
), sent AS (
  SELECT *, {_mask("template")} AS wire_text FROM paras_
)"""
)
add("paragraph_groups", f"SELECT {K}, seq, group_id, mergeable FROM grouped", PARAS)
add("paragraph_text", "SELECT doc_id, group_id, n_lines, length(template) AS n_chars, wire_text FROM sent", PARAS)
add("mask_text", f"SELECT {K}, {_mask('template')} AS wire_text FROM lines", LINES)
add(
    "unmask_text",
    f"""SELECT {K}, {_unmask("noisy")} AS t
FROM (SELECT *, regexp_replace({_mask("template")}, 'XXXM([0-9]+)XXX', '  xxxm\\1xxx  ', 'g') AS noisy FROM lines WHERE n_math > 0)""",
    LINES,
)
WRONG = "[" + ", ".join(_quoted(a) for a, _ in TERM_FIXES) + "]"
SQL["term_fixes"] = f"""SELECT doc_id, {_fixed("raw")} AS t
FROM (SELECT doc_id, ({WRONG})[doc_id % 54 + 1] || ' ' || text || ' ' || ({WRONG})[doc_id * 7 % 54 + 1] AS raw FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"""
add(
    "greedy_batches",
    "SELECT doc_id, group_id, batch_no FROM batched",
    PARAS
    + """, seqd AS MATERIALIZED (
  SELECT doc_id, group_id, length(wire_text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY group_id) AS k FROM sent
), batched AS (
  SELECT doc_id, k, group_id, CAST(0 AS BIGINT) AS batch_no, n AS size FROM seqd WHERE k = 1
  UNION ALL
  SELECT s.doc_id, s.k, s.group_id, CASE WHEN f.size >= 4800 THEN f.batch_no + 1 ELSE f.batch_no END, CASE WHEN f.size >= 4800 THEN s.n ELSE f.size + s.n END
  FROM batched f JOIN seqd s ON s.doc_id = f.doc_id AND s.k = f.k + 1
)""",
)
CACHED = (
    PARAS
    + """, keyed AS (SELECT *, md5('fr' || chr(31) || 'en' || chr(31) || wire_text) AS key FROM sent
), cache AS (
  SELECT key, '~' || max(wire_text) AS raw, CASE WHEN max(doc_id) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status FROM keyed WHERE doc_id % 3 = 0 GROUP BY key
)"""
)
add("cache_hits", "SELECT doc_id, group_id, key, raw FROM keyed JOIN cache USING (key) WHERE status = 'ok'", CACHED)
add("cache_misses", "SELECT doc_id, group_id, key FROM keyed WHERE key NOT IN (SELECT key FROM cache WHERE status = 'ok')", CACHED)
add("lexicon_translate", f"SELECT doc_id, group_id, {_lexicon('wire_text')} AS raw FROM sent", PARAS)
add(
    "split_translation",
    f"""
SELECT g.doc_id, g.seq,
  CASE WHEN t.n_lines = 1 THEN t.translated
       WHEN g.seq = t.first_no + t.n_lines - 1 AND r.rest IS NOT NULL AND {_strip("r.rest")} <> '' THEN trim(coalesce({_strip("p.piece")}, '') || ' ' || {_strip("r.rest")})
       ELSE coalesce({_strip("p.piece")}, '') END AS translated
FROM grouped g JOIN todo t USING (doc_id, group_id)
LEFT JOIN pieces p ON p.doc_id = g.doc_id AND p.group_id = g.group_id AND p.line = g.seq - t.first_no
LEFT JOIN rests r ON r.doc_id = g.doc_id AND r.group_id = g.group_id
""",
    PARAS
    + f""", sizes AS (
  SELECT doc_id, group_id, min(seq) AS first_no, list(length(own) ORDER BY seq) AS lens FROM grouped GROUP BY doc_id, group_id
), todo AS MATERIALIZED (
  SELECT doc_id, group_id, n_lines, first_no, lens, {_lexicon("template")} AS translated FROM paras_ JOIN sizes USING (doc_id, group_id)
), shares AS MATERIALIZED (
  SELECT doc_id, group_id, n_lines - 1 AS last, regexp_extract_all(translated, '[ \\t\\n\\r\\f]+|[^ \\t\\n\\r\\f]+') AS toks,
    list_transform(lens, lambda n: CAST(trunc(CAST(length(translated) AS DOUBLE) * (CAST(n AS DOUBLE) / CAST(list_sum(lens) AS DOUBLE))) AS BIGINT)) AS share
  FROM todo WHERE n_lines > 1
), walk AS (
  SELECT doc_id, group_id, last, toks, share, 0 AS k, CAST(0 AS BIGINT) AS line, false AS over, CAST(0 AS BIGINT) AS next_line, CAST(0 AS BIGINT) AS used, 0 AS held FROM shares
  UNION ALL
  SELECT doc_id, group_id, last, toks, share, k + 1, goes, lost,
    CASE WHEN NOT lost AND goes < last AND total >= share[goes + 1] THEN goes + 1 ELSE goes END,
    CASE WHEN NOT lost AND goes < last AND total >= share[goes + 1] THEN 0 ELSE total END,
    CASE WHEN NOT lost AND goes < last AND total >= share[goes + 1] THEN 0 ELSE 1 END
  FROM (
    SELECT *, CASE WHEN fits THEN next_line WHEN next_line < last THEN next_line + 1 ELSE last END AS goes,
      over OR (NOT fits AND next_line = last) AS lost, CASE WHEN fits THEN used + n ELSE n END AS total
    FROM (SELECT *, length(toks[k + 1]) AS n, NOT over AND (held = 0 OR used + length(toks[k + 1]) <= share[next_line + 1] * CAST(1.3 AS DOUBLE)) AS fits FROM walk WHERE k < len(toks)))
), pieces AS (
  SELECT doc_id, group_id, line, string_agg(toks[k], '' ORDER BY k) AS piece FROM walk WHERE k > 0 AND NOT over GROUP BY doc_id, group_id, line
), rests AS (
  SELECT doc_id, group_id, string_agg(toks[k], '' ORDER BY k) AS rest FROM walk WHERE over GROUP BY doc_id, group_id
)""",
)
add(
    "changed_lines_by_page",
    f"SELECT doc_id, page_idx, count(*) FILTER (WHERE {_strip(_lexicon(OWN))} <> {_strip(OWN)}) AS n_changed, count(*) AS n_lines FROM lines GROUP BY ALL",
    LINES,
)
add("math_char_map", f"SELECT {B}, raw_no, span_no, family, {MAPPED} AS mapped, {_mapped('text', 'CMBX')} AS bold, {_mapped('text', 'EUFM')} AS fraktur FROM allspans WHERE NOT is_text", RAWS)
add("render_route", f"SELECT {B}, raw_no, span_no, {ROUTE} AS route FROM allspans WHERE NOT is_text", RAWS)

SEGS = (
    LINES
    + f""", texts AS (SELECT *, {_lexicon(OWN)} AS translated FROM lines
), cutup AS (
  SELECT {K}, x0, font_size, list_filter(string_split(regexp_replace(template, '(\\{{M[0-9]+\\}})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS segs,
    list_filter(string_split(regexp_replace(translated, '(\\{{M[0-9]+\\}})', chr(1) || '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS tsegs FROM texts
), segrows AS (
  SELECT {K}, x0 AS line_x0, font_size, u.i AS seg_no, u.s AS seg, CASE WHEN regexp_matches(u.s, '^\\{{M[0-9]+\\}}$') THEN 'math' ELSE 'text' END AS kind
  FROM (SELECT *, unnest(list_transform(segs, lambda s, i: {{'i': CAST(i - 1 AS INTEGER), 's': s}})) AS u FROM cutup)
), tsegrows AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY {K} ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos, sum(n) OVER (PARTITION BY {K}) AS text_len
  FROM (SELECT {K}, u.i AS seg_no, u.s AS seg, CASE WHEN regexp_matches(u.s, '^\\{{M[0-9]+\\}}$') THEN 0 ELSE length(u.s) END AS n
        FROM (SELECT *, unnest(list_transform(tsegs, lambda s, i: {{'i': CAST(i - 1 AS INTEGER), 's': s}})) AS u FROM cutup))
)"""
)
add("segments", f"SELECT {K}, seg_no, kind, seg FROM segrows", SEGS)
add(
    "style_map",
    f"""
SELECT {K}, seg_no, run_idx, substr(seg, CAST(greatest(pos, start) - pos + 1 AS BIGINT), CAST(least(pos + n, stop) - greatest(pos, start) AS BIGINT)) AS piece, style
FROM tsegrows JOIN spread USING ({K}) WHERE n > 0 AND start < pos + n AND stop > pos
UNION ALL SELECT {K}, seg_no, -1, seg, 'math' FROM tsegrows WHERE n = 0 AND text_len > 0
UNION ALL SELECT {K}, 0, 0, translated, font_style FROM texts ANTI JOIN (SELECT * FROM tsegrows WHERE text_len > 0) z USING ({K})
""",
    SEGS
    + f""", lens AS (SELECT {K}, max(text_len) AS size FROM tsegrows GROUP BY ALL
), stylerows AS ({STYLERUNS}
), stops AS (
  SELECT {K}, run_idx, style, CAST(trunc(CAST(sum(n) OVER w AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY {K}) AS DOUBLE) * CAST(size AS DOUBLE)) AS BIGINT) AS stop
  FROM stylerows JOIN lens USING ({K}) WINDOW w AS (PARTITION BY {K} ORDER BY run_idx)
), spread AS (
  SELECT * FROM (SELECT *, coalesce(lag(stop) OVER (PARTITION BY {K} ORDER BY run_idx), 0) AS start FROM stops) WHERE stop > start
)""",
)
G = f"{K}, run"
OWNGROUPS = (
    SEGS
    + f""", first_runs AS (
  SELECT a.doc_id, a.page_idx, a.block_no, a.to_line AS line_no, CAST(0 AS BIGINT) AS run, -a.k AS rank, r.j, r.text, r.font, r.size, r.x0, r.y0, r.x1, r.y1, r.oy, r.family
  FROM attached a JOIN runs r USING ({K}) WHERE r.run = 0 AND NOT r.is_text
), own_groups AS MATERIALIZED (
  SELECT {K}, CAST(run AS INTEGER) AS run, CAST(row_number() OVER (PARTITION BY {G} ORDER BY rank, j) - 1 AS INTEGER) AS pos, text, font, size, x0, y0, x1, y1, oy, family
  FROM (SELECT * FROM first_runs UNION ALL SELECT {K}, CAST(run AS BIGINT), 1, j, text, font, size, x0, y0, x1, y1, oy, family FROM runs SEMI JOIN lines USING ({K}) WHERE NOT is_text)
)"""
)
#: (run, text, font, size, x, y, width, height) of groups that every document gets.
MADE = (
    (0, "a", "CMMI10", 10, 100, 100, 8, 10), (0, "n", "CMMI7", 7, 120, 94, 6, 7), (0, "2", "CMR7", 7, 120, 106, 6, 7), (0, "b", "CMMI10", 10, 150, 100, 8, 10),
    (1, "C", "rsfs10", 10, 100, 100, 8, 10), (1, "r", "CMMI7", 7, 108, 97, 4, 7), (1, " ", "CMR10", 10, 112, 100, 3, 10), (1, "x", "CMMI10", 10, 130, 100, 8, 10),
    (2, "g", "EUFM10", 10, 80, 100, 8, 10), (2, "s", "CMSY7", 7, 89, 97, 4, 7), (2, "h", "CMMI10", 10, 110, 88, 9, 10), (2, "q", "CMMI10", 10, 110, 104, 9, 10),
    (2, "-", "CMSY10", 10, 140, 100, 0.25, 10), (2, "P", "CMEX10", 10, 150, 95, 12, 20), (2, "u", "CMMI7", 7, 170, 94, 5, 7), (2, "w", "CMMI7", 7, 170, 106, 5, 7),
    (3, "S", "CMEX10", 10, 100, 100, 6, 10), (3, "i", "CMMI7", 7, 106, 92, 4, 7), (3, "k", "CMMI7", 7, 106, 104, 4, 7),
)
_VALUES = ", ".join(f"({run}, {sum(m[0] == run for m in MADE[:k])}, '{t}', '{f}', {s}, {x}, {y}, {w}, {h})" for k, (run, t, f, s, x, y, w, h) in enumerate(MADE))
TIES = f""", pairs AS MATERIALIZED (
  SELECT {", ".join("a." + c for c in G.split(", "))}, a.pos AS pos_a, b.pos AS pos_b
  FROM mgroups a JOIN mgroups b USING ({G})
  WHERE a.pos < b.pos AND least(a.x1, b.x1) - greatest(a.x0, b.x0) > 0 AND abs(a.oy - b.oy) > 3
    AND abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) < greatest(least(a.x1 - a.x0, b.x1 - b.x0) * CAST(0.7 AS DOUBLE), CAST(2.0 AS DOUBLE))
    AND NOT EXISTS (SELECT 1 FROM mgroups c WHERE c.doc_id = a.doc_id AND c.page_idx = a.page_idx AND c.block_no = a.block_no AND c.line_no = a.line_no AND c.run = a.run AND c.pos <> a.pos AND c.pos <> b.pos
                    AND abs(c.x1 - least(a.x0, b.x0)) < 1.5)
), stackset AS (
  SELECT DISTINCT {G}, unnest([pos_a, pos_b]) AS pos FROM pairs
), scripts AS MATERIALIZED (
  SELECT {", ".join("b." + c for c in G.split(", "))}, b.pos AS base, f.pos
  FROM mgroups b JOIN mgroups f USING ({G})
  WHERE f.pos > b.pos AND b.family IN ('rsfs', 'EUFM') AND {_strip("b.text")} <> '' AND NOT EXISTS (
    SELECT 1 FROM mgroups k WHERE k.doc_id = b.doc_id AND k.page_idx = b.page_idx AND k.block_no = b.block_no AND k.line_no = b.line_no AND k.run = b.run AND k.pos > b.pos AND k.pos <= f.pos
      AND NOT ({_strip("k.text")} = '' OR (k.size < b.size AND abs(k.x0 - b.x1) < 3)))
), glyphs AS (
  SELECT {", ".join("s." + c for c in G.split(", "))}, s.base AS pos, min(m.x0) AS gx0, min(m.y0) AS gy0, max(m.x1) AS gx1, max(m.y1) AS gy1
  FROM scripts s JOIN mgroups m USING ({G}) WHERE m.pos = s.pos AND {_strip("m.text")} <> '' GROUP BY ALL
), drawn AS (
  SELECT m.*, s.pos IS NOT NULL AS stacked, {ROUTE} AS route, {STYLED} AS way, {MAPPED} AS mapped,
    least(m.x0, gx0) AS bx0, least(m.y0, gy0) AS by0, greatest(m.x1, gx1) AS bx1, greatest(m.y1, gy1) AS by1
  FROM mgroups m LEFT JOIN stackset s USING ({G}, pos) LEFT JOIN glyphs g USING ({G}, pos)
  WHERE m.x1 - m.x0 >= 0.5 AND NOT EXISTS (SELECT 1 FROM scripts a WHERE a.doc_id = m.doc_id AND a.page_idx = m.page_idx AND a.block_no = m.block_no AND a.line_no = m.line_no AND a.run = m.run AND a.pos = m.pos)
), wide AS (
  SELECT *, CASE WHEN way = 'math' THEN mapped ELSE text END AS shown,
    CASE WHEN route = 'drop' THEN x1 - x0 WHEN route = 'copy' THEN bx1 - bx0 ELSE length(CASE WHEN way = 'math' THEN mapped ELSE text END) * CAST(0.5 AS DOUBLE) * size END AS width,
    CASE WHEN stacked AND coalesce(lag(stacked) OVER (PARTITION BY {G} ORDER BY pos), false) THEN 0 ELSE 1 END AS fresh
  FROM drawn
), itemized AS (
  SELECT *, sum(fresh) OVER (PARTITION BY {G} ORDER BY pos) AS item FROM wide
), items AS MATERIALIZED (
  SELECT {G}, item, bool_or(stacked) AS stacked, max(width) AS w, max(width) + CASE WHEN bool_or(stacked) THEN 1.5 ELSE 0 END AS takes FROM itemized GROUP BY ALL
), laid AS (
  SELECT *, coalesce(sum(takes) OVER (PARTITION BY {G} ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS dx FROM items
), widths AS (SELECT {G}, sum(takes) AS width FROM items GROUP BY ALL)"""
GROUPS = (
    OWNGROUPS
    + f""", made(run, pos, text, font, size, x, y, w, h) AS (VALUES {_VALUES}
), mgroups AS MATERIALIZED (
  SELECT * FROM own_groups
  UNION ALL
  SELECT doc_id, 0, -2, 0, m.run, m.pos, m.text, 'ABCDEF+' || m.font, CAST(m.size AS DOUBLE), CAST(m.x + doc_id % 5 AS DOUBLE), CAST(m.y AS DOUBLE), CAST(m.x + m.w + doc_id % 5 AS DOUBLE), CAST(m.y + m.h AS DOUBLE),
    CAST(m.y + m.h - 2 AS DOUBLE), substr(m.font, 1, 4)
  FROM (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) d CROSS JOIN made m
)"""
    + TIES
)
add("math_groups", f"SELECT {G}, pos, text, x0, oy FROM own_groups", OWNGROUPS)
add("stacked_pairs", "SELECT * FROM pairs", GROUPS)
add("attached_scripts", "SELECT * FROM scripts", GROUPS)
add(
    "group_marks",
    f"""SELECT {G}, pos, route, shown AS drawn, dx, i.width, CASE WHEN route = 'copy' THEN bx0 - 1.5 END AS box_x0, CASE WHEN route = 'copy' THEN by0 - 2.5 END AS box_y0,
  CASE WHEN route = 'copy' THEN bx1 + 1.5 END AS box_x1, CASE WHEN route = 'copy' THEN by1 + 1.5 END AS box_y1 FROM itemized i JOIN laid l USING ({G}, item)""",
    GROUPS,
)
add(
    "fraction_bars",
    f"""
SELECT {G}, n_stacked, CAST(row_number() OVER (PARTITION BY {G} ORDER BY item) - 1 AS INTEGER) AS bar_no, dx AS dx0, dx + w AS dx1, bar_y
FROM laid JOIN (SELECT {G}, CAST(count(*) AS INTEGER) AS n_stacked, (arg_min(y1, y0 * 1000000 + pos) + arg_max(y0, y0 * 1000000 + pos)) / 2 AS bar_y FROM mgroups JOIN stackset USING ({G}, pos) GROUP BY {G}) b USING ({G})
WHERE stacked
""",
    GROUPS,
)
add(
    "pen_advance",
    f"""
SELECT {K}, seg_no, line_x0 + coalesce(sum(step) OVER (PARTITION BY {K} ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS x
FROM (SELECT s.*, CASE WHEN kind = 'text' THEN length(seg) * CAST(0.5 AS DOUBLE) * font_size ELSE coalesce(w.width, 0.0) END AS step
      FROM segrows s LEFT JOIN widths w ON s.doc_id = w.doc_id AND s.page_idx = w.page_idx AND s.block_no = w.block_no AND s.line_no = w.line_no AND s.kind = 'math' AND w.run = CAST(nullif(regexp_extract(s.seg, '^\\{{M([0-9]+)\\}}$', 1), '') AS BIGINT))
""",
    OWNGROUPS + ", mgroups AS (SELECT * FROM own_groups)" + TIES,
)
add("whiteout_rects", f"SELECT {K}, x0 - 1 AS x0, y0 - 1 AS y0, CASE WHEN is_toc THEN CAST(582 AS DOUBLE) ELSE x1 + 2 END AS x1, y1 + 1 AS y1 FROM lines", LINES)
add("font_baseline", f"SELECT {K}, font_size, baseline FROM lines", LINES)
add(
    "toc_leaders",
    f"""
SELECT {K}, dots_start, CAST(CASE WHEN stop > dots_start + 30 THEN trunc((stop - dots_start) / 10) ELSE 0 END AS INTEGER) AS n_dots, pn_x
FROM (SELECT *, coalesce(pn_x - 4, far - 2) AS stop FROM (
  SELECT {K}, x0 + 5 * length(toc_content) + 4 AS dots_start, greatest(x1, 500.0) AS far, CASE WHEN toc_page_num <> '' THEN greatest(x1, 500.0) - 5 * length(toc_page_num) END AS pn_x FROM lines WHERE is_toc))
""",
    LINES,
)
LINKS = r"""
links AS (
  SELECT page_id AS doc_id, 0 AS page_idx, u.i AS link_idx, u.t AS text, CAST(72 + 48 * (u.i % 8) AS DOUBLE) AS x0, CAST(72 + 18 * (u.i // 8) AS DOUBLE) AS y0,
    CAST(72 + 48 * (u.i % 8) + 5 * length(u.t) AS DOUBLE) AS x1, CAST(82 + 18 * (u.i // 8) AS DOUBLE) AS y1
  FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1), lambda t, i: {'i': CAST(i - 1 AS INTEGER), 't': t})) AS u
        FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL)
), shifted AS (
  SELECT DISTINCT doc_id, CAST(y0 + 5 + CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 3 END AS INTEGER) AS y FROM links
), reached AS (
  SELECT l.*, e.y IS NOT NULL AS hit FROM links l LEFT JOIN shifted e ON e.doc_id = l.doc_id AND abs(e.y - (l.y0 + l.y1) / 2) <= 1
)"""


def link(name: str, body: str) -> None:
    SQL[name] = "WITH " + LINKS.strip() + "\n" + body.strip()


link("link_colors", "SELECT doc_id, page_idx, link_idx, CASE WHEN link_idx % 3 = 0 THEN 0.0 ELSE 1.0 END AS r, CASE WHEN link_idx % 3 = 0 THEN 0.5 ELSE 0.0 END AS g, CASE WHEN link_idx % 3 = 0 THEN 1.0 ELSE 0.0 END AS b, link_idx % 3 = 1 AS set_colour, link_idx % 3 = 2 AS set_width FROM links")
link("link_extents", "SELECT doc_id, link_idx, CASE WHEN hit THEN 72.0 END AS orig_x0, CASE WHEN hit THEN 372.0 END AS text_end FROM reached")
PHRASES = r""", drawn AS (
  SELECT doc_id, y0, string_agg(text, ' ; ' ORDER BY link_idx) AS piece FROM links GROUP BY ALL
), wanted AS (
  SELECT DISTINCT doc_id, text FROM links WHERE text <> '' AND length(text) <= 20
), phrases AS (
  SELECT doc_id, text, y0, parts, unnest(range(len(parts) - 1)) AS n FROM (SELECT d.doc_id, w.text, d.y0, string_split(d.piece, w.text) AS parts FROM drawn d JOIN wanted w USING (doc_id))
), hits AS (
  SELECT doc_id, text, CAST(y0 AS INTEGER) AS line_no, CAST(n AS INTEGER) AS n, 80.0 + 5 * (list_sum(list_transform(parts[1:n + 1], lambda p: length(p))) + n * length(text)) AS hx0, y0 AS hy0 FROM phrases
)
"""
link("phrase_search", PHRASES + "SELECT doc_id, 0 AS page_idx, text, line_no, n, CAST(hx0 AS DOUBLE) AS hx0, CAST(hx0 + 5 * length(text) AS DOUBLE) AS hx1, hy0 FROM hits")
link(
    "link_reposition",
    PHRASES
    + """
SELECT doc_id, link_idx, printf('[%.3f %.3f %.3f %.3f]',
  CASE WHEN x0 >= 77 AND hx0 IS NOT NULL AND length(text) <= 20 THEN hx0 - 0.5 WHEN x0 < 77 THEN 72 ELSE 72 + (x0 - 72) * CAST(0.75 AS DOUBLE) END, 792 - y1,
  CASE WHEN x0 >= 77 AND hx0 IS NOT NULL AND length(text) <= 20 THEN hx0 + 5 * length(text) + 0.5 WHEN x0 < 77 THEN 372 ELSE 72 + (x1 - 72) * CAST(0.75 AS DOUBLE) END, 792 - y0) AS rect
FROM (
  SELECT r.*, h.hx0, row_number() OVER (PARTITION BY r.doc_id, r.link_idx ORDER BY abs(h.hx0 - r.x0) + abs(h.hy0 - r.y0), h.line_no, h.n) AS place
  FROM reached r LEFT JOIN hits h ON r.doc_id = h.doc_id AND r.text = h.text AND r.text <> '' AND abs(h.hy0 - r.y0) <= 15
  WHERE r.hit) WHERE place = 1
""",
)
link("links_lost", "SELECT doc_id, link_idx, text FROM links l WHERE NOT EXISTS (SELECT 1 FROM links s WHERE s.doc_id = l.doc_id AND s.x0 = l.x0 AND s.y0 = l.y0 AND s.link_idx % 4 <> 0)")
add(
    "text_under_links",
    f"""
SELECT doc_id, link_idx, {_strip("t")} AS text FROM (
  SELECT l.doc_id, l.link_idx, string_agg(s.text, '' ORDER BY s.block_no, s.raw_no, s.span_no) AS t
  FROM links l JOIN allspans s ON s.block_no >= 0 AND l.doc_id = s.doc_id AND l.page_idx = s.page_idx AND s.x0 < l.x1 AND s.x1 > l.x0 AND s.y0 < l.y1 AND s.y1 > l.y0 GROUP BY ALL)
WHERE {_strip("t")} <> ''
""",
    RAWS.strip() + "," + LINKS,
)
STATE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
JOBS = f"""jobs AS (
  SELECT user_id AS job_id, arg_max({STATE}, {{'ts': ts, 'id': event_id}}) AS status, min(ts) AS created, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS steps, count(*) AS n
  FROM events WHERE user_id IS NOT NULL GROUP BY user_id
)"""
SQL["job_status"] = f"""WITH {JOBS}
SELECT job_id, status, created, CASE WHEN steps > 0 THEN steps END AS progress, CASE WHEN steps > 0 THEN n END AS total,
  CASE WHEN steps > 0 THEN CAST(floor(100.0 * CAST(steps AS DOUBLE) / n + 0.5) AS BIGINT) END AS percent FROM jobs"""
SQL["job_expired"] = f"WITH {JOBS} SELECT job_id, status FROM jobs WHERE created < TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 600 SECOND"
SQL["job_downloads"] = f"""WITH {JOBS}
SELECT a.job_id, CASE WHEN j.status IS NULL THEN 404 WHEN j.status <> 'done' THEN 400 ELSE 200 END AS code
FROM (SELECT DISTINCT user_id + event_id % 2 * 1000000 AS job_id FROM events) a LEFT JOIN jobs j USING (job_id)"""
SQL["job_concurrency"] = """
WITH RECURSIVE log AS MATERIALIZED (
  SELECT event_id, ts, user_id AS job, event_type = 'signup' AS asks, CAST(user_id % 8 AS INTEGER) AS server, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS k
  FROM events WHERE user_id IS NOT NULL AND event_type IN ('signup', 'purchase', 'error')
), fold AS (
  SELECT server, CAST(0 AS BIGINT) AS k, list_filter([{'job': CAST(0 AS BIGINT), 'ts': TIMESTAMP '2024-01-01 00:00:00'}], lambda x: false) AS live, CAST(NULL AS BIGINT) AS event_id, false AS asks, 0 AS n_active FROM (SELECT DISTINCT server FROM log)
  UNION ALL
  SELECT server, k, CASE WHEN NOT asks THEN list_filter(held, lambda x: x.job <> job) WHEN len(held) < 2 THEN list_append(list_filter(held, lambda x: x.job <> job), {'job': job, 'ts': ts}) ELSE held END, event_id, asks, CAST(len(held) AS INTEGER)
  FROM (SELECT l.server, l.k, l.event_id, l.asks, l.job, CAST(l.ts AS TIMESTAMP) AS ts, CASE WHEN l.asks THEN list_filter(f.live, lambda x: epoch(CAST(l.ts AS TIMESTAMP)) - epoch(x.ts) <= 86400) ELSE f.live END AS held
        FROM fold f JOIN log l ON l.server = f.server AND l.k = f.k + 1)
)
SELECT event_id, server, n_active, n_active < 2 AS admitted FROM fold WHERE asks"""
SQL["upload_names"] = r"""
SELECT page_id, CASE WHEN NOT lower(name) LIKE '%.pdf' THEN 'suffix' WHEN octet_length(encode(html)) > 52428800 THEN 'size' END AS refused,
  regexp_replace(name, '\.[^.]*$', '') || '-translated.pdf' AS served_name, regexp_replace(name, '\.[^.]*$', '') || '-en.pdf' AS file_name
FROM (SELECT page_id, html, regexp_extract(url, '([^/?#]*)[^/]*$', 1) || CASE WHEN page_id % 2 = 0 THEN '.PDF' ELSE '' END AS name FROM pages)"""
