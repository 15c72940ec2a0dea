"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import re

from . import quotes, secrets

#: Whole table of components from ``nodes`` (id) and ``links`` (a, b): id, component.
_COMPONENTS = """
    either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS id, b AS other FROM either UNION SELECT reach.id, either.b FROM reach JOIN either ON either.a = reach.other),
    comp AS (SELECT nodes.id, least(nodes.id, coalesce(min(reach.other), nodes.id)) AS component
             FROM nodes LEFT JOIN reach ON reach.id = nodes.id GROUP BY nodes.id)"""

NEAR_DUPLICATES = f"""
    WITH RECURSIVE words AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
      FROM documents),
    shingles AS (
      SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
    nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component AS component_id, doc_id = component AS kept
    FROM documents JOIN comp ON comp.id = doc_id LEFT JOIN sizes USING (doc_id)"""

VECTOR_LINKS = f"""
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e,
             label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok FROM embeddings),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e)
              WHERE x.ok AND y.ok AND list_cosine_similarity(x.e, y.e) >= 0.98),
    nodes AS (SELECT vec_id AS id FROM v), {_COMPONENTS},
    degree AS (SELECT a AS id, count(*) AS n FROM either GROUP BY a)
    SELECT comp.id AS vec_id, coalesce(degree.n, 0) AS n_links, component AS component_id, comp.id = component AS kept
    FROM comp LEFT JOIN degree USING (id)"""


def _passages(level: str) -> str:
    only = f"array_to_string(list_transform(lines, lambda y: CASE WHEN y.lv = {level} THEN y.t ELSE '' END), chr(10))"
    part = r"trim(regexp_replace(lower(z), '[ \t\r\n\f\v]+', ' ', 'g'))"
    split = rf"regexp_split_to_array({only}, '\n[ \t\r]*\n')"
    return f"list_transform(list_filter(list_transform({split}, lambda z: {part}), lambda z: z <> ''), lambda z: md5(z))"


_LEVEL = rf"length(regexp_replace(regexp_extract(x, '{quotes.MARKS}'), '[^>]', '', 'g'))"

QUOTATIONS = rf"""
    WITH RECURSIVE m AS (
      SELECT conv_id, turn, role, text, count(*) AS copies,
             list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {{'lv': {_LEVEL}, 't': regexp_replace(x, '{quotes.MARKS}', '')}}) AS lines
      FROM conversations GROUP BY conv_id, turn, role, text),
    msg AS (
      SELECT conv_id, turn, role, copies, lines, md5(coalesce(role, chr(2)) || chr(1) || coalesce(text, chr(2))) AS key,
             trim(array_to_string(list_transform(list_filter(lines, lambda x: x.lv = 0), lambda x: x.t), chr(10))) AS body,
             list_max(list_transform(lines, lambda x: x.lv)) AS levels, {_passages('0')} AS own FROM m),
    firsts AS (SELECT conv_id, print, min(turn) AS original FROM (SELECT conv_id, turn, unnest(own) AS print FROM msg WHERE turn IS NOT NULL) GROUP BY ALL),
    asked AS (SELECT conv_id, turn, key, k, unnest({_passages('k')}) AS print FROM (SELECT *, unnest(range(1, levels + 1)) AS k FROM msg WHERE levels > 0)),
    q AS (SELECT asked.conv_id, asked.turn, asked.key, k, CASE WHEN original < asked.turn THEN original END AS original
          FROM asked LEFT JOIN firsts ON asked.conv_id IS NOT DISTINCT FROM firsts.conv_id AND asked.print = firsts.print),
    votes AS (SELECT conv_id, turn, key, original, count(*) FILTER (k = 1) AS direct, count(*) AS n FROM q WHERE original IS NOT NULL GROUP BY ALL),
    rep AS (SELECT conv_id, turn, key, arg_max(original, (direct, n, original)) AS original, sum(n) AS n_linked FROM votes GROUP BY ALL),
    made AS (SELECT conv_id, turn, key, count(*) AS n_quotes FROM q GROUP BY ALL),
    chain AS (SELECT conv_id, turn, min(original) AS up FROM rep GROUP BY ALL),
    walk AS (SELECT conv_id, turn, up FROM chain UNION
             SELECT walk.conv_id, walk.turn, chain.up FROM walk JOIN chain ON walk.conv_id IS NOT DISTINCT FROM chain.conv_id AND walk.up = chain.turn),
    roots AS (SELECT conv_id, turn, min(up) AS root FROM walk GROUP BY ALL),
    placed AS (SELECT *, row_number() OVER w - 1 AS place, lag(turn) OVER w AS before FROM msg
               WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, key)),
    linked AS (SELECT p.*, rep.original, rep.n_linked FROM placed p
               LEFT JOIN rep ON p.conv_id IS NOT DISTINCT FROM rep.conv_id AND p.turn IS NOT DISTINCT FROM rep.turn AND p.key = rep.key),
    ups AS (SELECT l.conv_id, l.place, CASE WHEN l.original IS NULL THEN l.place - 1
                     ELSE (SELECT min(o.place) FROM placed o WHERE o.conv_id IS NOT DISTINCT FROM l.conv_id AND o.turn = l.original) END AS up
            FROM linked l),
    tree AS (SELECT conv_id, place, [place] AS path FROM ups WHERE place = 0 UNION ALL
             SELECT ups.conv_id, ups.place, list_append(path, ups.place) FROM tree
             JOIN ups ON ups.conv_id IS NOT DISTINCT FROM tree.conv_id AND ups.up = tree.place AND ups.place > 0),
    ordered AS (SELECT conv_id, place, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS position FROM tree)
    SELECT p.conv_id, p.turn, role, body, copies, coalesce(n_quotes, 0) AS n_quotes, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked,
           CAST(levels AS INTEGER) AS levels, coalesce(original, before) AS reply_to,
           CASE WHEN original IS NOT NULL THEN 'quote' WHEN before IS NOT NULL THEN 'previous' ELSE 'start' END AS link,
           coalesce(root, p.turn) AS root, position
    FROM linked p
    JOIN ordered ON p.conv_id IS NOT DISTINCT FROM ordered.conv_id AND p.place = ordered.place
    LEFT JOIN made ON p.conv_id IS NOT DISTINCT FROM made.conv_id AND p.turn IS NOT DISTINCT FROM made.turn AND p.key = made.key
    LEFT JOIN roots ON p.conv_id IS NOT DISTINCT FROM roots.conv_id AND p.turn = roots.turn"""


#: Main text by the layout of the given pages: one article, cut at headings and paragraphs.  It knows nothing of other
#: layouts or of repeats; no block of these articles recurs on most pages of a host.
_PART = "regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g')"
for _name, _sign in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
    _PART = f"replace({_PART}, '{_name}', '{_sign}')"
ARTICLES = rf"""
    WITH parts AS (
      SELECT page_id, url, list_filter(list_transform(
               regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:h1|p)>'),
               lambda x: trim(regexp_replace(regexp_replace({_PART}, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM pages),
    texts AS (SELECT page_id, url, array_to_string(blocks, chr(10)) AS text FROM parts)
    SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts"""



def _spelt(pattern: str) -> str:
    """A pattern with both cases of each letter outside classes and escapes."""
    part = r"\[[^\]]*\]|\\(?:x[0-9A-Fa-f]{2}|.)|[a-z]"
    return re.sub(part, lambda m: f"[{m[0]}{m[0].upper()}]" if len(m[0]) == 1 else m[0], pattern)


def _secrets() -> str:
    """Matches of each rule in order; each starts where its text next occurs behind the end of the one before."""
    rules = []
    for k, r in enumerate(secrets.RULES):
        # runs of one class as long as wanted are the maximal runs
        pattern = r.pattern[:-1] + f"{{{r.least},}}" if r.kind == "hex" else r.pattern
        pattern = (_spelt(pattern) if r.fold else pattern).replace("'", "''")
        short = f"len(regexp_extract(match, '{pattern}', {r.group})) >= {r.least}"
        rules.append(f"SELECT id, {k} AS rule, '{r.kind}' AS kind, text, regexp_extract_all(text, '{pattern}') AS found FROM docs")
        rules[-1] = f"({rules[-1]})", f"WHEN {k} THEN {short}"
    return f"""
    WITH RECURSIVE docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    hits AS (SELECT * FROM ({" UNION ALL ".join(r for r, _ in rules)}) WHERE len(found) > 0),
    walk AS (
      SELECT id, rule, 1 AS i, strpos(text, found[1]) - 1 AS s, strpos(text, found[1]) - 1 + length(found[1]) AS e FROM hits
      UNION ALL
      SELECT h.id, h.rule, i + 1, e + strpos(substr(text, e + 1), found[i + 1]) - 1, e + strpos(substr(text, e + 1), found[i + 1]) - 1 + length(found[i + 1])
      FROM walk JOIN hits h ON h.id = walk.id AND h.rule = walk.rule WHERE i < len(found)),
    spans AS (SELECT w.id, w.rule, kind, s, e, found[i] AS match FROM walk w JOIN hits h ON h.id = w.id AND h.rule = w.rule),
    good AS (SELECT id, rule, s, kind || ':' || s || ':' || e AS span FROM spans WHERE CASE rule {" ".join(s for _, s in rules)} END),
    lists AS (SELECT id, count(*) FILTER (rule = 0) AS n_assign, count(*) FILTER (rule = 1) AS n_access, count(*) FILTER (rule = 2) AS n_hex,
                     string_agg(span, ',' ORDER BY s, rule) FILTER (rule < 3) AS base, string_agg(span, ',' ORDER BY s, rule) AS spans FROM good GROUP BY id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN lists USING (id)"""


#: Every contiguous phrase counted by itself; exact in HUGEINT.
COLLOCATIONS = r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
    spans AS (SELECT lang, w, i, unnest(range(0, 5)) AS more FROM starts),
    f AS (SELECT lang, array_to_string(w[i : i + more], ' ') AS phrase, more + 1 AS m, count(*) AS a
          FROM spans WHERE i + more <= len(w) GROUP BY ALL HAVING count(*) >= 100),
    cuts AS (SELECT lang, phrase, a, m, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
    cut AS (SELECT c.lang, c.phrase, c.a, c.m, k, x.a AS l, y.a AS r, sizes.n, CAST((1000::HUGEINT * c.a * sizes.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
            FROM cuts c JOIN sizes ON sizes.lang = c.lang
            JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
            JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 :], ' ')),
    worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (SELECT DISTINCT s.lang, s.phrase FROM worst s JOIN worst t ON s.lang = t.lang AND s.m < t.m AND t.a >= s.a
               AND contains(' ' || t.phrase || ' ', ' ' || s.phrase || ' ')),
    ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
               FROM worst ANTI JOIN inside USING (lang, phrase))
    SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quotation_threads": QUOTATIONS,
        "op2_setsketch_near_duplicates": NEAR_DUPLICATES,
        "op5_host_suffix_array_text": ARTICLES,
        "op10_rotation_code_links": VECTOR_LINKS,
        "op11_trigram_secrets": _secrets(),
        "op12_prefix_collocations": COLLOCATIONS,
    }
