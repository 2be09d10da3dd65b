"""SQL (DuckDB) that gives the same rows as queries of this subpackage."""

from __future__ import annotations

P3_FOUND = r"""
WITH RECURSIVE rec AS (SELECT DISTINCT manifest_name AS m, id FROM manifest WHERE id IS NOT NULL AND manifest_name IS NOT NULL),
ent AS (SELECT DISTINCT manifest_name AS m, id, unnest(map_keys(groups)) AS k, lower(trim(unnest(map_values(groups)))) AS v FROM manifest),
tie AS (SELECT e.* FROM ent e JOIN manifest_head h ON h.name = e.m AND list_contains(h.split_strategy.grouping_keys, e.k)
  WHERE v NOT IN ('', '-', '--', '?', 'n/a', 'na', 'n.a.', 'nan', 'nil', 'none', 'null', 'unknown', 'unk', 'undefined', 'not available', 'missing', 'tbd')),
star AS (SELECT m, id, min(id) OVER (PARTITION BY m, k, v) AS lo FROM tie),
edge AS (SELECT DISTINCT m, id AS a, lo AS b FROM star UNION SELECT DISTINCT m, lo, id FROM star),
reach(m, a, b) AS (SELECT m, id, id FROM rec UNION SELECT r.m, r.a, e.b FROM reach r JOIN edge e ON e.m = r.m AND e.a = r.b),
sets AS (SELECT m, a AS id, min(b) AS set_id FROM reach GROUP BY m, a),
split AS (SELECT DISTINCT manifest_name AS m, id, CASE WHEN s IN ('train', 'training') THEN 'training' WHEN s IN ('val', 'dev', 'validation') THEN 'validation' WHEN s = 'test' THEN 'test' END AS split FROM (SELECT *, lower(trim(split)) AS s FROM manifest)),
torn AS (SELECT m, set_id FROM sets JOIN split USING (m, id) GROUP BY m, set_id HAVING count(DISTINCT split) > 1)
SELECT DISTINCT id, set_id FROM sets JOIN torn USING (m, set_id)"""

P4_TERMS = """
WITH once AS (SELECT DISTINCT document_id, page_index, token_index, label FROM annotation_token WHERE document_id IS NOT NULL),
n AS (SELECT count(DISTINCT document_id) AS total FROM once),
terms AS (
  SELECT 'label' AS field, label AS term, document_id FROM once WHERE label IS NOT NULL
  UNION ALL
  SELECT 'entity_type', s.entity_type, o.document_id FROM once o JOIN semantic_labels_v1 s ON s.name = o.label WHERE s.entity_type IS NOT NULL),
counted AS (SELECT field, term, count(*) AS tokens, count(DISTINCT document_id) AS documents FROM terms GROUP BY field, term)
SELECT field, term, tokens, documents, CASE WHEN documents < 3 THEN 'rare' WHEN documents > 0.5 * total THEN 'common' END AS mark FROM counted, n"""

# Blank tokens are no case; the classes are those of ``normalise``.
P5_FOUND = r"""
SELECT DISTINCT document_id, page_index, token_index FROM annotation_token
WHERE regexp_matches(text, '[^\x20-\x7e]') AND NOT regexp_full_match(text, '[ \x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2800}]*')
AND (regexp_matches(text, '[\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2800}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff0}-\x{fff8}\x{300}-\x{36f}\x{1ab0}-\x{1aff}\x{1dc0}-\x{1dff}\x{20d0}-\x{20ff}\x{fe20}-\x{fe2f}\x{ff01}-\x{ff5e}\x{ffe0}-\x{ffe6}]')
  OR (regexp_matches(text, '\p{Latin}') AND regexp_matches(text, '[\p{Greek}\p{Cyrillic}\p{Armenian}\p{Cherokee}\p{Coptic}\p{Georgian}\p{Hebrew}\p{Arabic}]')))"""

P6_FOUND = r"""
WITH once AS (SELECT DISTINCT document_id, page_index, token_index, text FROM annotation_token WHERE document_id IS NOT NULL)
SELECT document_id, page_index FROM once GROUP BY document_id, page_index
HAVING sum(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> ''))) > 512"""

# The one form of tokens. Letters of the Greek and Cyrillic alphabets and the plain Latin letters that look the same.
_LOOK, _ALIKE = "ͿΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγινορσυЅІЈАВЕКМНОРСТУХагеорсухѕіј", "JABEZHIKMNOPTYXayivopouSIJABEKMHOPCTYXareopcyxsij"
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
_NARROW = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_INVISIBLE = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff0}-\x{fff8}]+"
_BLANKS = r"[ \x{9}-\x{d}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{2800}]+"
FORMS = rf"""
seen AS (SELECT DISTINCT text FROM annotation_token WHERE text IS NOT NULL),
plainer AS (SELECT text, nfc_normalize(translate(regexp_replace(regexp_replace(text, '{_INVISIBLE}', '', 'g'), '{_BLANKS}', ' ', 'g'), '{_WIDE}', '{_NARROW}')) AS t FROM seen),
latin AS (SELECT text, trim(CASE WHEN regexp_matches(t, '\p{{Latin}}') AND regexp_matches(t, '[\p{{Greek}}\p{{Cyrillic}}]') THEN nfc_normalize(translate(t, '{_LOOK}', '{_ALIKE}')) ELSE t END, ' ') AS text_norm FROM plainer),
forms AS (SELECT text, text_norm, replace(replace(lower(text_norm), 'ß', 'ss'), 'ς', 'σ') AS match_key FROM latin)"""

P5_NORMALISED = f"""
WITH {FORMS}, odd AS ({P5_FOUND})
SELECT a.document_id, a.page_index, a.token_index, a.text, text_norm, match_key, o.document_id IS NULL AS plain FROM annotation_token a LEFT JOIN forms f ON f.text = a.text
LEFT JOIN odd o ON o.document_id = a.document_id AND o.page_index = a.page_index AND o.token_index = a.token_index"""

# Records as lists of words; pairs that share enough of the longer one's words, with repetitions; their edit distance by dynamic programming.
_OVERLAP = rf"""
WITH RECURSIVE {FORMS},
once AS (SELECT DISTINCT document_id, page_index, token_index, text FROM annotation_token WHERE document_id IS NOT NULL AND text IS NOT NULL),
rec AS (SELECT document_id AS id, list_filter(regexp_split_to_array(string_agg(match_key, ' ' ORDER BY page_index, token_index, o.text), ' +'), lambda w: w <> '') AS w FROM once o JOIN forms USING (text) GROUP BY document_id),
named AS (SELECT id, source, CASE WHEN s IN ('train', 'training') THEN 'training' WHEN s IN ('val', 'dev', 'validation') THEN 'validation' WHEN s = 'test' THEN 'test' END AS split FROM (SELECT *, lower(trim(split)) AS s FROM manifest WHERE id IS NOT NULL)),
side AS (SELECT id, bool_or(split = 'training') AS tr, bool_or(split <> 'training') AS he FROM named WHERE split IS NOT NULL GROUP BY id),
used AS (SELECT rec.*, tr, he FROM rec JOIN side USING (id) WHERE len(w) > 0),
part AS (SELECT id, len(w) AS n, tr, he, unnest(w) AS x FROM used), comp AS (SELECT *, row_number() OVER (PARTITION BY id, x) AS k FROM part),
shared AS (SELECT a.id AS ta, b.id AS hb FROM comp a JOIN comp b ON a.x = b.x AND a.k = b.k WHERE a.tr AND b.he AND a.id <> b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) >= greatest(a.n, b.n) - floor(greatest(a.n, b.n) / 5.0)),
dp AS (SELECT ta, hb, a.w AS a, b.w AS b, 0 AS i, range(0, len(b.w)::BIGINT + 1) AS r FROM shared JOIN used a ON a.id = ta JOIN used b ON b.id = hb UNION ALL
  SELECT ta, hb, a, b, i + 1, list_reduce(list_transform(range(1, len(b)::BIGINT + 1), lambda j: [j]), lambda acc, x: list_append(acc, least(r[x[1]] + CASE WHEN a[i + 1] <> b[x[1]] THEN 1 ELSE 0 END, r[x[1] + 1] + 1, acc[-1] + 1)), [(i + 1)::BIGINT]) FROM dp WHERE i < len(a)),
pair AS (SELECT ta, hb FROM dp WHERE i = len(a) AND r[-1] <= floor(greatest(len(a), len(b)) / 5.0))"""


# Pages put together again from their pieces.
P6_REJOINED = r"""
WITH once AS (SELECT DISTINCT document_id, page_index, token_index, text FROM annotation_token WHERE document_id IS NOT NULL),
words AS (SELECT document_id, page_index, flatten(list(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x{b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '') ORDER BY token_index, text)) AS w FROM once GROUP BY document_id, page_index)
SELECT document_id, page_index, len(w)::BIGINT AS n_words, md5(array_to_string(w, ' ')) AS words_md5, true AS within_limit, 32 AS least_repeated, 32 AS most_repeated FROM words WHERE len(w) > 512"""

P3_CHECK = f"""
WITH sets AS (SELECT * FROM ({P3_FOUND.replace("SELECT DISTINCT id, set_id FROM sets JOIN torn USING (m, set_id)", "SELECT m, id, set_id FROM sets")}))
SELECT m AS manifest_name, count(*) AS records, count(DISTINCT set_id) AS sets, 0::BIGINT AS torn_sets, true AS near_targets FROM sets GROUP BY m"""

P8_CHECK = """
SELECT t.source, t.target_share, t.max_repeat, count(d.doc_id) FILTER (length(d.text) > 0) AS documents, true AS within_repeat, true AS near_target FROM mix_target t LEFT JOIN documents d USING (source) GROUP BY ALL"""

# Leaks by brute force: windows of an item most of whose words the document has leave few pairs; for these, from every start in the item, the edits to the nearest text are counted word by word.
_WORDS = r"regexp_extract_all(replace(replace(lower(strip_accents(text)), 'ß', 'ss'), 'ς', 'σ'), '[\p{L}\p{N}]+')"
P7_FOUND = rf"""
WITH RECURSIVE doc AS (SELECT DISTINCT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL), item AS (SELECT item_id, {_WORDS} AS w FROM eval_item WHERE text IS NOT NULL),
dx AS (SELECT DISTINCT doc_id, unnest(w) AS x FROM doc), ix AS (SELECT item_id, w[k] AS x, k FROM (SELECT item_id, w, unnest(range(1, len(w)::BIGINT + 1)) AS k FROM item)),
hit AS (SELECT doc_id, item_id, k, count(*) OVER (PARTITION BY doc_id, item_id ORDER BY k RANGE BETWEEN 17 PRECEDING AND CURRENT ROW) AS n FROM dx JOIN ix USING (x)),
likely AS (SELECT DISTINCT doc_id, item_id FROM hit WHERE n >= 14),
dp AS (SELECT doc_id, item_id, i.w AS a, d.w AS b, s, s AS i, list_transform(range(0, len(d.w)::BIGINT + 1), lambda j: 0::BIGINT) AS r FROM likely JOIN doc d USING (doc_id) JOIN item i USING (item_id), LATERAL (SELECT unnest(range(0, greatest(0, len(i.w)::BIGINT - 17))) AS s) UNION ALL
  SELECT doc_id, item_id, a, b, s, i + 1, list_reduce(list_transform(range(1, len(b)::BIGINT + 1), lambda j: [j]), lambda acc, x: list_append(acc, least(r[x[1]] + CASE WHEN a[i + 1] <> b[x[1]] THEN 1 ELSE 0 END, r[x[1] + 1] + 1, acc[-1] + 1)), [r[1] + 1]) FROM dp WHERE i < len(a))
SELECT DISTINCT doc_id, item_id FROM dp WHERE i - s >= 18 AND 7 * list_min(r) <= i - s"""

SQL = {
    "p1_found": f"{_OVERLAP} SELECT DISTINCT least(ta, hb) AS id_a, greatest(ta, hb) AS id_b FROM pair",
    "p1_overlap_counts": f"""{_OVERLAP}, partner AS (SELECT ta AS id, 't' AS s, count(*) AS n FROM pair GROUP BY ta UNION ALL SELECT hb, 'h', count(*) FROM pair GROUP BY hb)
SELECT split, source, count(DISTINCT r.id) AS records, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS partners FROM (SELECT DISTINCT id, split, source FROM named) r LEFT JOIN partner p ON p.id = r.id AND p.s = CASE WHEN split = 'training' THEN 't' ELSE 'h' END GROUP BY split, source""",
    "p1_classes": f"""{_OVERLAP}, partner AS (SELECT ta AS id FROM pair UNION ALL SELECT hb FROM pair), links AS (SELECT id, count(*) AS n FROM partner GROUP BY id)
SELECT u.id AS document_id, min(u.id) OVER (PARTITION BY w) AS class_id, tr AS in_train, he AS in_held, coalesce(n, 0) AS links FROM used u LEFT JOIN links l ON l.id = u.id""",
    "p1_links": f"""{_OVERLAP}, class AS (SELECT id, min(id) OVER (PARTITION BY w) AS c FROM used), near AS (SELECT ta, hb, r[-1] AS d FROM dp WHERE i = len(a) AND r[-1] <= floor(greatest(len(a), len(b)) / 5.0))
SELECT DISTINCT t.c AS train_class, h.c AS held_class, d::INT AS distance FROM near JOIN class t ON t.id = ta JOIN class h ON h.id = hb WHERE t.c <> h.c""",
    "p3_found": P3_FOUND,
    "p3_split_check": P3_CHECK,
    "p4_terms": P4_TERMS,
    "p4_found": f"SELECT field, term, mark FROM ({P4_TERMS}) WHERE mark IS NOT NULL",
    "p5_found": P5_FOUND,
    "p5_normalised": P5_NORMALISED,
    "p6_found": P6_FOUND,
    "p6_rejoined": P6_REJOINED,
    "p7_found": P7_FOUND,
    "p8_share_check": P8_CHECK,
}
