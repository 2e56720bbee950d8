"""DuckDB SQL for the queries of reflume.queries.

Answers about manuscripts are worked out from the keys that the manuscripts
were made of, never by reading their text.
"""

from __future__ import annotations

from reflume.functions.text import ENTITIES

#: Keys of all manuscripts: citations (cit), entries (ent), a citation's items (item) and the scores of all pairs (pair).
_FAM = "concat(chr(CAST(65 + {k} % 26 AS INT)), 'z', translate(CAST({k} AS VARCHAR), '0123456789', 'abcdefghij'))"
_YEAR = "CAST(1950 + ({k} * 11) % 70 AS INT)"


def _fam(k: str) -> str:
    return _FAM.format(k=k)


def _year(k: str) -> str:
    return _YEAR.format(k=k)


_KEYS = """
WITH li AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p, l_suppkey AS s FROM lineitem),
rows_ AS (SELECT li.*, o_custkey + 1000000 AS g FROM li JOIN orders ON o_orderkey = o),
docs AS (SELECT DISTINCT o, g FROM rows_),
sup AS (SELECT o, s, row_number() OVER (PARTITION BY o ORDER BY s) AS r FROM (SELECT DISTINCT o, s FROM rows_)),
ent AS (
  SELECT o, s, CAST(r - 1 + CAST(o % 7 = 0 AS INT) AS INT) AS e, 'Title' AS word FROM sup
  UNION ALL SELECT o, s, CAST((SELECT max(r) FROM sup x WHERE x.o = sup.o) + CAST(o % 7 = 0 AS INT) AS INT), 'Second title' FROM sup WHERE r = 1 AND o % 13 = 0
),
cit AS (SELECT rows_.*, p % 5 AS kind, r + CAST(o % 7 = 0 AS INT) AS idx FROM rows_ JOIN sup USING (o, s)),
item AS (
  SELECT o, concat('b', p, '/', s) AS c, 0 AS i, s AS k, CASE WHEN kind = 4 THEN '47' END AS page, 1 AS whole FROM cit WHERE kind <> 3
  UNION ALL SELECT o, concat('b', p, '/', s), 1, g, NULL, 1 FROM cit WHERE kind = 2
  UNION ALL SELECT o, 'x', 0, g, NULL, 1 FROM docs WHERE o % 3 = 0
  UNION ALL SELECT o, concat('e', e), 0, s, NULL, 0 FROM ent
),
pair AS (
  SELECT item.o, item.c, item.i, ent.e,
    CASE WHEN item.k = ent.s THEN 1 WHEN item.k % 26 = ent.s % 26 THEN 4 ELSE 5 END AS tier,
    floor((CASE WHEN item.k = ent.s THEN 0.4 WHEN item.k % 26 = ent.s % 26 THEN 0.24 ELSE 0.0 END
      + CASE WHEN (item.k * 11) % 70 = (ent.s * 11) % 70 THEN 0.4 ELSE 0.0 END
      + CASE WHEN whole = 1 THEN 0.15 ELSE 0.075 END + CASE WHEN page IS NULL OR page = '47' AND false THEN 0.05 ELSE 0.0 END) * 10000 + 0.5) / 10000 AS score,
    (item.k * 11) % 70 = (ent.s * 11) % 70 AS same_year
  FROM item JOIN ent ON item.o = ent.o
  UNION ALL
  SELECT item.o, item.c, item.i, 0, 5, floor((CASE WHEN whole = 1 THEN 0.15 ELSE 0.075 END + CASE WHEN page IS NULL THEN 0.05 ELSE 0.0 END) * 10000 + 0.5) / 10000, false
  FROM item WHERE o % 7 = 0
),
top AS (
  SELECT o, c, i, max(score) AS best, count(*) FILTER (WHERE score >= 0.7 - 1e-9) AS above,
    arg_max(e, score * 100000 - e) AS e, arg_max(same_year, score * 100000 - e) AS same_year, list(score ORDER BY score DESC)[2] AS second,
    list(e ORDER BY score DESC, e) FILTER (WHERE score >= 0.7 - 1e-9) AS candidates
  FROM pair GROUP BY o, c, i
),
verdict AS (
  SELECT *, CASE WHEN above >= 2 AND best - second <= 0.1 + 1e-9 THEN 'AMBIGUOUS' WHEN above >= 1 THEN 'MATCHED' WHEN best >= 0.4 - 1e-9 THEN 'POSSIBLE_MISMATCH' ELSE 'MISSING_REFERENCE' END AS rel FROM top
),
graded AS (SELECT *, CASE rel WHEN 'AMBIGUOUS' THEN 3 WHEN 'POSSIBLE_MISMATCH' THEN 2 WHEN 'MISSING_REFERENCE' THEN 1 ELSE 0 END AS g FROM verdict),
final AS (SELECT o, c, arg_max(rel, g * 10 - i) AS rel, arg_max(e, g * 10 - i) AS e, arg_max(same_year, g * 10 - i) AS same_year FROM graded GROUP BY o, c),
use_ AS (
  SELECT o, e, 2 AS u FROM final WHERE rel = 'MATCHED' UNION ALL SELECT o, unnest(candidates), 1 FROM verdict WHERE rel = 'AMBIGUOUS'
),
allent AS (SELECT o, e FROM ent UNION ALL SELECT o, 0 FROM docs WHERE o % 7 = 0),
status AS (
  SELECT allent.o, allent.e, CASE max(u) WHEN 2 THEN 'CITED' WHEN 1 THEN 'AMBIGUOUS_USAGE' ELSE 'UNUSED' END AS status
  FROM allent LEFT JOIN use_ ON use_.o = allent.o AND use_.e = allent.e GROUP BY allent.o, allent.e
),
size_ AS (SELECT o, count(*) AS n FROM allent GROUP BY o),
num AS (
  SELECT o, CAST(idx AS INT) AS idx FROM cit WHERE kind = 3 UNION ALL SELECT o, 0 FROM docs WHERE o % 5 = 0 UNION ALL SELECT o, 99 FROM docs WHERE o % 11 = 0
),
tok AS (SELECT num.o, idx, CASE WHEN idx < 1 THEN 'unmatched' WHEN idx > n THEN 'out-of-range' ELSE 'resolved' END AS status FROM num JOIN size_ USING (o)),
issues AS (
  SELECT o, 'CS001' AS rule, 'ERROR' AS severity FROM final WHERE rel = 'MISSING_REFERENCE'
  UNION ALL SELECT o, 'CS002', 'WARNING' FROM status WHERE status = 'UNUSED'
  UNION ALL SELECT o, 'CS003', 'WARNING' FROM final WHERE rel IN ('POSSIBLE_MISMATCH', 'MATCHED', 'AMBIGUOUS') AND NOT same_year AND NOT (o % 7 = 0 AND e = 0)
  UNION ALL SELECT o, 'CS004', 'AMBIGUOUS' FROM final WHERE rel = 'AMBIGUOUS'
  UNION ALL SELECT o, 'CS005', 'WARNING' FROM ent WHERE o % 13 = 0 AND s = (SELECT min(s) FROM sup x WHERE x.o = ent.o)
  UNION ALL SELECT o, 'CS006', 'ERROR' FROM docs WHERE o % 7 = 0
  UNION ALL SELECT o, 'CS007', 'WARNING' FROM docs WHERE o % 5 = 0
  UNION ALL SELECT o, 'CS008', 'ERROR' FROM tok WHERE status <> 'resolved'
  UNION ALL SELECT status.o, 'CS009', 'WARNING' FROM status WHERE status = 'UNUSED' AND o IN (SELECT o FROM num) AND (o, e + 1) NOT IN (SELECT o, idx FROM tok WHERE status = 'resolved')
)
"""
_KEYS = _KEYS.replace(" OR page = '47' AND false", "")
_TEXT = "(SELECT doc_id, coalesce(text, '') AS line FROM documents)"
_WS = r"[\x09-\x0d \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"
_EXACT = rf"trim(regexp_replace(regexp_replace(lower(line), '\p{{P}}+', '', 'g'), '{_WS}', ' ', 'g'))"
_REFERENCE = f"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|{'|'.join(ENTITIES)});"
_NAMED = ", ".join(f"'{name}': chr({ord(char)})" for name, char in ENTITIES.items())
_ENTITY_SQL = f"""
WITH cut AS (
  SELECT page_id, string_split_regex(coalesce(html, ''), '{_REFERENCE}') AS gaps, regexp_extract_all(coalesce(html, ''), '{_REFERENCE}') AS found FROM pages
), read AS (
  SELECT page_id, gaps, list_transform(found, lambda e: struct_pack(whole := e, named := MAP {{{_NAMED}}}[e[2:-2]], code := CASE
    WHEN e[2] <> '#' THEN NULL WHEN lower(e[3]) = 'x' THEN TRY_CAST(concat('0x', e[4:-2]) AS BIGINT) ELSE TRY_CAST(e[3:-2] AS BIGINT) END)) AS found FROM cut
), told AS (
  SELECT page_id, gaps, list_transform(found, lambda x: coalesce(x.named, CASE WHEN x.code <= 1114111 AND NOT x.code BETWEEN 55296 AND 57343 THEN chr(CAST(x.code AS INTEGER)) END, x.whole)) AS found FROM read
)
SELECT page_id, md5(array_to_string(list_transform(range(1, len(gaps) + 1), lambda k: concat(gaps[k], found[k])), '')) AS decoded FROM told
"""
_DOC = "CAST(o AS VARCHAR) AS doc_id"
_TAG = r"""(SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<((?:"[^"]*"|''[^'']*''|[^>"''])*)>', 1)) AS inner_ FROM pages)"""

_CITES = """
SELECT {doc}, count(*) FILTER (WHERE f = 'a') AS author_date, count(*) FILTER (WHERE f = 'n') AS numeric, any_value(CAST(o % 5 = 0 AS BIGINT)) AS invalid, round(sum(conf), 4) AS confidence FROM (
  SELECT o, CASE WHEN kind = 3 THEN 'n' ELSE 'a' END AS f, CASE kind WHEN 0 THEN 0.9 WHEN 2 THEN 0.9 WHEN 4 THEN 0.97 ELSE 1.0 END AS conf FROM cit
  UNION ALL SELECT o, 'a', 0.9 FROM docs WHERE o % 3 = 0 UNION ALL SELECT o, 'a', 0.837 FROM ent
  UNION ALL SELECT o, 'n', 1.0 FROM docs WHERE o % 5 = 0 UNION ALL SELECT o, 'n', 1.0 FROM docs WHERE o % 11 = 0
) GROUP BY o
"""


def _count(rule: str) -> str:
    return _KEYS + f"SELECT {_DOC}, count(*) AS n FROM issues WHERE rule = '{rule}' GROUP BY o"


SQL: dict[str, str] = {
    "fold_text": rf"SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(coalesce(text, ''))), '{_WS}', ' ', 'g'))) AS folded FROM documents",
    "name_exact_key": f"SELECT doc_id, {_EXACT} AS k FROM {_TEXT}",
    "strip_diacritics": f"SELECT doc_id, strip_accents(line) AS k FROM {_TEXT}",
    "initials_key": f"SELECT doc_id, array_to_string(list_transform(list_filter(string_split(strip_accents({_EXACT}), ' '), lambda w: w <> ''), lambda w: w[1]), '') AS k FROM {_TEXT}",
    "label_truncate": f"SELECT doc_id, CASE WHEN length(line) <= 72 THEN line ELSE concat(line[1:69], '...') END AS k FROM {_TEXT}",
    "vn_family": "SELECT c_custkey, c_custkey % 4 IN (0, 2) AS vietnamese FROM customer",
    "tag_names": rf"SELECT page_id, regexp_extract(regexp_replace(inner_, '^/', ''), '^([^ \t\n\r/]*)', 1) AS name, count(*) AS n FROM {_TAG} GROUP BY ALL",
    "attr_values": rf"""SELECT page_id, regexp_extract(inner_, '(?:^|\s)href="([^"]*)"', 1) AS href, count(*) AS n FROM {_TAG} WHERE regexp_matches(inner_, '(?:^|\s)href="([^"]*)"') GROUP BY ALL""",
    "entity_decode": _ENTITY_SQL,
    "escape_html": "SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS escaped FROM pages",
    "local_names": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN concat(p_brand, ':x:', p_type) ELSE concat(p_brand, p_type) END AS local FROM part",
    "interpolated": "SELECT o_orderkey, concat(o_orderstatus, ': ', o_custkey, ' of {unknown}') AS message, 'file,n,unknown' AS names FROM orders",
    "heading_blocks": "SELECT conv_id, CASE role WHEN 'system' THEN 'heading' ELSE 'paragraph' END AS type, count(*) AS n, min(turn) AS first FROM conversations WHERE conv_id IS NOT NULL AND (role = 'system' OR trim(coalesce(text, '')) <> '') GROUP BY ALL",
    "bracket_regions": _KEYS + f"""SELECT {_DOC}, count(*) AS n, CAST(sum(m) AS BIGINT) AS inner_chars FROM (
      SELECT o, CASE kind WHEN 0 THEN 4 WHEN 1 THEN length({_fam("s")}) + 6 WHEN 2 THEN length({_fam("s")}) + length({_fam("g")}) + 14 WHEN 3 THEN length(CAST(idx AS VARCHAR)) ELSE length({_fam("s")}) + 13 END AS m FROM cit
      UNION ALL SELECT o, 4 FROM docs WHERE o % 3 = 0 UNION ALL SELECT o, 4 FROM docs WHERE o % 5 = 0 UNION ALL SELECT o, 1 FROM docs WHERE o % 5 = 0 UNION ALL SELECT o, 2 FROM docs WHERE o % 11 = 0
      UNION ALL SELECT o, 4 FROM ent UNION ALL SELECT o, 1 FROM ent) GROUP BY o""",
    "citations_extracted": _KEYS + _CITES.replace("{doc}", _DOC),
    "citation_items": _KEYS + f"SELECT {_DOC}, {_fam('k')} AS family, {_year('k')} AS year, page, count(*) AS n FROM item GROUP BY ALL",
    "bibliography_detect": _KEYS + f"""SELECT {_DOC}, 'detected' AS outcome, round(0.35 + 0.15 + 0.2 + 0.3 * least(3 - CAST(o % 7 = 0 AS INT), count(*)) / 3, 4) AS confidence, count(*) + 1 + CAST(o % 7 = 0 AS BIGINT) AS blocks FROM ent GROUP BY o""",
    "reference_parse": _KEYS + f"""SELECT {_DOC}, e AS entry_index, {_fam("s")} AS family, concat(lower(chr(CAST(65 + s % 26 AS INT))), 'j') AS initials, {_year("s")} AS year, concat(word, ' ', lower({_fam("s")})) AS title,
      'Journal of Tests' AS container_title, '12' AS volume, '3' AS issue, '45-60' AS pages, CAST(NULL AS VARCHAR) AS failure, CAST(1.0 AS DOUBLE) AS parse_confidence FROM ent
      UNION ALL SELECT {_DOC}, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'no (YYYY) year marker', 0.0 FROM docs WHERE o % 7 = 0""",
    "pair_scores": _KEYS + f"SELECT {_DOC}, e AS entry_index, count(*) AS pairs, round(sum(score), 4) AS score, count(*) FILTER (WHERE tier = 1) AS exact, count(*) FILTER (WHERE tier = 4) AS initials FROM pair GROUP BY o, e",
    "match_relationships": _KEYS + f"SELECT {_DOC}, rel AS relationship, count(*) AS n FROM final GROUP BY o, rel",
    "entry_status": _KEYS + f"SELECT {_DOC}, e AS entry_index, status FROM status",
    "numeric_binding": _KEYS + f"SELECT {_DOC}, idx AS index, status, CASE WHEN status = 'resolved' THEN idx - 1 END AS entry_index, count(*) AS n FROM tok GROUP BY o, idx, status",
    "missing_references": _count("CS001"),
    **{f"cs00{k}": _count(f"CS00{k}") for k in range(1, 10)},
    "severity_counts": _KEYS + f"""SELECT {_DOC}, count(*) FILTER (WHERE severity = 'ERROR') AS error, count(*) FILTER (WHERE severity = 'WARNING') AS warning, count(*) FILTER (WHERE severity = 'AMBIGUOUS') AS ambiguous, CAST(0 AS BIGINT) AS info
      FROM docs LEFT JOIN issues USING (o) GROUP BY o""",
    "report_meta": _KEYS + f"""SELECT {_DOC}, any_value(c) AS citations, any_value(n) AS "references", count(severity) FILTER (WHERE severity = 'ERROR') AS error, count(severity) FILTER (WHERE severity = 'WARNING') AS warning,
      count(severity) FILTER (WHERE severity = 'AMBIGUOUS') AS ambiguous, CAST(0 AS BIGINT) AS info
      FROM docs JOIN size_ USING (o) JOIN (SELECT o, count(*) AS c FROM (SELECT DISTINCT o, c FROM item UNION ALL SELECT o, CAST(idx AS VARCHAR) FROM num) GROUP BY o) USING (o) LEFT JOIN issues USING (o) GROUP BY o""",
    "custom_rule": _KEYS + f"SELECT {_DOC}, 'X001' AS rule_id, 'INFO' AS severity, CAST(1 AS BIGINT) AS n FROM docs",
    "issues_by_severity": _KEYS + f"SELECT {_DOC}, severity, CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARNING' THEN 1 ELSE 2 END AS rank, CAST(count(*) AS INT) AS n FROM issues GROUP BY o, severity",
    "resolution_events": """
      WITH c AS (SELECT user_id, max((ts, event_id)) FILTER (WHERE event_type = 'purchase') AS cleared FROM events GROUP BY user_id)
      SELECT user_id AS file, event_type AS citation_id, arg_max(event_id, (ts, event_id)) AS choice FROM events JOIN c USING (user_id)
      WHERE event_type <> 'purchase' AND (cleared IS NULL OR (ts, event_id) > cleared) GROUP BY user_id, event_type""",
    "multiset_precision": """
      WITH a AS (SELECT l_partkey, count(*) AS x FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), b AS (SELECT l_partkey, count(*) AS y FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
      f AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM a FULL JOIN b USING (l_partkey))
      SELECT round(sum(least(x, y)) / sum(x), 6) AS precision, round(sum(least(x, y)) / sum(y), 6) AS recall, CAST(sum(greatest(0, x - y)) AS BIGINT) AS false_positives FROM f""",
    "perf_percentiles": "SELECT event_type, round(median(value), 6) AS median, round(quantile_disc(value, 0.95), 6) AS p95, round(min(value), 6) AS min, round(max(value), 6) AS max, round((max(value) - min(value)) / median(value) * 100, 6) AS spread FROM events GROUP BY event_type",
    "stage_elapsed": """
      WITH e AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6) - epoch_us(ts) / 1e6 AS d FROM events)
      SELECT user_id, count(d) AS n, round(sum(d), 3) AS total, round(max(d), 3) AS longest FROM e GROUP BY user_id""",
    "zotero_fields": f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN {_fam('o_custkey')} END AS family, CASE WHEN o_orderkey % 5 <> 0 THEN {_year('o_custkey')} END AS year,
      CASE WHEN o_orderkey % 5 <> 0 THEN 'b' END AS suffix, CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0.7 ELSE 1.0 END AS DOUBLE) AS confidence FROM orders""",
    "word_keys": "SELECT c_custkey, c_mktsegment[1:3] AS family, CAST(c_custkey % 100 + CASE WHEN c_custkey % 100 < 30 THEN 2000 ELSE 1900 END AS INT) AS year FROM customer",
    "numeric_outcomes": """
      SELECT p_partkey, outcome, CASE WHEN outcome = 'valid' THEN CAST(d + 1 + CAST(k = 1 AS INT) AS INT) ELSE 0 END AS n, CAST(CASE WHEN outcome = 'valid' THEN CASE WHEN k = 1 THEN 0.9215 ELSE 0.95 END END AS DOUBLE) AS confidence FROM (
        SELECT p_partkey, d, k, CASE WHEN p_size + d < 0 OR d < 0 OR p_size < 1 THEN 'malformed' WHEN k = 0 THEN 'mixed' ELSE 'valid' END AS outcome
        FROM (SELECT p_partkey, p_size, p_partkey % 7 - 2 AS d, p_partkey % 4 AS k FROM part))""",
    "container_tail": """SELECT p_partkey, concat('Annals of ', p_brand) AS container_title, CASE WHEN p_partkey % 3 < 2 THEN CAST(p_size AS VARCHAR) END AS volume, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey % 90 AS VARCHAR) END AS issue,
      CASE WHEN p_partkey % 3 = 0 THEN concat(p_partkey, '–', p_partkey + 9) END AS pages FROM part""",
    "author_split": f"""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN concat_ws('|', {_fam('(c_custkey + 1)')}, {_fam('(c_custkey + 2)')}, {_fam('(c_custkey + 3)')}) WHEN 1 THEN concat_ws('|', {_fam('(c_custkey + 1)')}, {_fam('(c_custkey + 2)')})
      ELSE concat_ws('|', {_fam('c_custkey')}, {_fam('(c_custkey + 1)')}) END AS families, CASE c_custkey % 3 WHEN 0 THEN 'J.|J.|J.' WHEN 1 THEN 'J.|J.' ELSE 'Ann|Bob B.' END AS givens FROM customer""",
    "reference_failures": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'empty entry text' WHEN 1 THEN 'no (YYYY) year marker' WHEN 2 THEN 'no author segment before the year' END AS failure FROM supplier",
    "name_prefix": f"""SELECT c_custkey, concat({_fam('c_custkey')}, ' and ', {_fam('(c_custkey + 1)')}) AS prefix, CAST(CASE c_custkey % 3 WHEN 0 THEN 16 WHEN 1 THEN 7 ELSE 5 END AS INT) AS at, CAST(2 AS INT) AS authors FROM customer""",
    "field_alignment": "SELECT c_custkey, CAST(1 AS INT) AS n, CAST(6 AS INT) AS start, CAST(CASE c_custkey % 2 WHEN 0 THEN 1.0 ELSE 1.0 END AS DOUBLE) AS confidence FROM customer",
    "biblio_scores": _KEYS + f"""SELECT {_DOC}, 'Introduction' AS heading, 'style' AS heading_type, CAST(0.15 AS DOUBLE) AS confidence FROM docs
      UNION ALL SELECT {_DOC}, 'References', 'exact', round(0.35 + 0.15 + 0.2 + 0.3 * least(3 - CAST(o % 7 = 0 AS INT), count(*)) / 3, 4) FROM ent GROUP BY o""",
    "biblio_recovery": _KEYS + f"SELECT {_DOC}, 'detected' AS outcome, CAST(NULL AS DOUBLE) AS confidence, CAST(CASE o % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS blocks FROM docs",
    "reference_labels": _KEYS + f"""SELECT {_DOC}, e AS entry_index, concat({_fam('s')}, ', J. (', {_year('s')}, ') — ', word, ' ', lower({_fam('s')})) AS label FROM ent
      UNION ALL SELECT {_DOC}, 0, 'Junk without a year.' FROM docs WHERE o % 7 = 0""",
    "highlights": _KEYS + f"SELECT {_DOC}, 'CS007:0' AS issue_id, 'Bad marks ' AS before, '[1, x]' AS mark, ' and [0] appear.' AS after FROM docs WHERE o % 5 = 0",
    "severity_override": _KEYS + f"""SELECT {_DOC}, count(*) FILTER (WHERE severity = 'ERROR' AND rule <> 'CS001') AS error, count(*) FILTER (WHERE severity = 'WARNING' OR rule = 'CS001') AS warning, CAST(0 AS BIGINT) AS ambiguous,
      count(*) FILTER (WHERE rule = 'CS004') AS info FROM docs LEFT JOIN issues USING (o) GROUP BY o""",
    "resolution_candidates": _KEYS + f"SELECT {_DOC}, count(DISTINCT c) AS n, CAST(max(len(candidates)) AS INT) AS most FROM verdict WHERE rel = 'AMBIGUOUS' GROUP BY o",
    "expected_raws": """
      WITH told AS (SELECT o_orderkey AS fixture, o_orderpriority AS raw FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 14 <> 0
        UNION ALL SELECT o_orderkey, 'own' FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 14 <> 0)
      SELECT fixture, count(*) AS n, min(raw) AS least, max(raw) AS most FROM (
        SELECT l_orderkey AS fixture, CAST(l_partkey AS VARCHAR) AS raw FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 0) UNION ALL SELECT * FROM told
      ) GROUP BY fixture""",
    "expected_matches": """
      WITH li AS (SELECT l_orderkey AS fixture, l_linenumber AS c, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY 1, 2),
      r AS (SELECT *, CAST(p % 10 AS VARCHAR) AS raw FROM li),
      f AS (SELECT fixture, raw, arg_max(s, c) AS found FROM r WHERE c % 3 <> 0 AND s % 11 > 0 GROUP BY 1, 2),
      t AS (SELECT fixture, raw, min(p) AS told FROM r WHERE p % 5 = 0 GROUP BY 1, 2)
      SELECT fixture, raw, coalesce(told, found) AS entry FROM f FULL JOIN t USING (fixture, raw)""",
    "expected_issue_counts": _KEYS + f"""
      , want AS (SELECT o, rule FROM issues WHERE rule <> 'CS009'
        UNION ALL SELECT o, 'CS009' FROM status WHERE status = 'UNUSED' AND (o, e + 1) NOT IN (SELECT o, idx FROM tok WHERE status = 'resolved')),
      frame AS (SELECT o, unnest(['CS001', 'CS002', 'CS003', 'CS004', 'CS005', 'CS006', 'CS007', 'CS008', 'CS009']) AS rule FROM docs),
      n AS (SELECT o, rule, count(*) AS n FROM want GROUP BY o, rule)
      SELECT {_DOC}, rule AS rule_id, coalesce(n, 0) AS expected FROM frame LEFT JOIN n USING (o, rule)""",
    "resolution_upsert": """
      WITH h AS (SELECT user_id, event_type, max(event_id) AS choice, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) - 1 AS place FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2),
      n AS (SELECT user_id, event_type, max(event_id) AS newer, min(event_id) AS first FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2),
      b AS (SELECT *, count(place) OVER (PARTITION BY user_id) AS had FROM h FULL JOIN n USING (user_id, event_type))
      SELECT CAST(user_id AS VARCHAR) AS file, event_type AS citation_id, CAST(coalesce(newer, choice) AS VARCHAR) AS choice,
        coalesce(place, had - 1 + row_number() OVER (PARTITION BY user_id, place IS NULL ORDER BY first)) AS place FROM b""",
    "run_states": """
      WITH e AS (SELECT *, event_id % 7 AS g, max(event_id % 7) OVER (PARTITION BY user_id) AS newest FROM events)
      SELECT user_id AS session, g AS generation,
        coalesce(arg_max(CASE event_type WHEN 'purchase' THEN 'done' ELSE 'error' END, event_id) FILTER (WHERE event_type IN ('purchase', 'error')), 'analyzing') AS status,
        coalesce(string_agg(event_type, ',' ORDER BY event_id) FILTER (WHERE event_type IN ('view', 'click')), '') AS stages
      FROM e WHERE g = newest GROUP BY user_id, g""",
    "stage_status": """SELECT o_orderkey AS run_id, o_orderkey % 5 AS done, ['reading-document', 'detecting-bibliography', 'finding-citations', 'matching-references', 'running-checks'][o_orderkey % 5 + 1] AS current, 4 - o_orderkey % 5 AS pending FROM orders""",
    "docx_read": "SELECT CAST(n_nationkey AS VARCHAR) AS doc_id, CASE WHEN n_nationkey % 5 = 0 THEN 'NotADocxError' END AS error, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS text FROM nation",
    "utf16_lengths": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) * 0 + length(coalesce(text, '')) + len(regexp_extract_all(coalesce(text, ''), '[\\x{10000}-\\x{10FFFF}]')) + 2 AS BIGINT) AS units FROM documents",
}
