"""SQL (DuckDB) that gives the same rows as the queries of the catalogue."""

from __future__ import annotations

from quirespark.functions.geometry import CORNERS
from quirespark.functions.text import FORMATS
from quirespark.operators.calibration import T_MAX, T_MIN
from quirespark.operators.extraction import BASELINE, ENTITY_TYPES
from quirespark.plans import fixtures as fx
from quirespark.sources import schemas

_PAGES = f"pages AS ({fx.OCR_PAGES})"
_NORM = r"trim(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
_SPACES = "[\\s\\x{b}\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _keyword(pages: str, signals: tuple[str, ...], threshold: float, labels: tuple[str, str]) -> str:
    hits = ", ".join(f"CASE WHEN bool_or(contains(' ' || n || ' ', ' {s} ')) THEN '{s}' END" for s in signals)
    return f"""{pages}, norm AS (SELECT document_id, {_NORM.format("coalesce(text, '')")} AS n FROM pages),
hit AS (SELECT document_id, list_filter([{hits}], lambda x: x IS NOT NULL) AS m FROM norm GROUP BY document_id),
classified AS (SELECT document_id, CASE WHEN len(m) / {len(signals)}.0::DOUBLE >= {threshold} THEN '{labels[0]}' ELSE '{labels[1]}' END AS label,
  round(len(m) / {len(signals)}.0::DOUBLE, 8) AS decision_score, {threshold}::DOUBLE AS decision_threshold, array_to_string(m, '|') AS matched_signals FROM hit)"""


_SIGNALS = ("invoice", "invoice date", "bill to", "amount due", "subtotal", "tax")
_CLASSIFIED = _keyword(f"WITH {_PAGES}", _SIGNALS, 0.3, ("INVOICE", "NOT_INVOICE"))


def _rules(unicode: bool = False) -> str:
    """Matches of every rule, marked; with Unicode's blanks, digits and word boundaries if asked for (a boundary at the start of a rule is a character of group 1)."""
    parts = []
    for k, (rule, kind, pattern) in enumerate(BASELINE):
        if unicode:
            pattern = pattern.replace(r"\b", r"(?:^|[^\p{L}\p{N}_])", 1).replace(r"\s", _SPACES).replace(r"[\d", r"[\p{Nd}").replace(r"\d", r"\p{Nd}")
        head, value = pattern.split("(?P<value>")
        parts.append(f"SELECT document_id, page_index, text, {k} AS rule, '{rule}' AS rule_id, '{kind}' AS entity_type, string_split_regex(regexp_replace(text, '(?i)({head})({value}', '\\1' || chr(1) || '\\2' || chr(2), 'g'), '[\\x01\\x02]') AS p FROM pages")
    return " UNION ALL ".join(parts)


# the same with the tokens that a value's extent overlaps
_REFERRED = f"""pages AS (SELECT document_id, page_index, string_agg(coalesce(text, ''), ' ' ORDER BY token_index, text) AS text FROM tok GROUP BY document_id, page_index),
places AS (SELECT document_id, page_index, token_index, length(coalesce(text, '')) AS n, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY document_id, page_index ORDER BY token_index, text ROWS UNBOUNDED PRECEDING) - 1 AS e FROM tok),
marked AS ({_rules(True)}),
found AS (SELECT *, unnest(range(0, len(p) // 2)) AS n FROM marked),
spans AS (SELECT document_id, page_index, rule, rule_id, entity_type, n, p[2 * n + 2] AS value, coalesce(list_sum(list_transform(p[1:2 * n + 1], lambda x: length(x))), 0)::INT AS start FROM found),
held AS (SELECT s.document_id, s.page_index, rule, rule_id, entity_type, s.n, regexp_replace(value, '^{_SPACES}+|{_SPACES}+$', '', 'g') AS raw_value, list(token_index ORDER BY token_index) AS refs
  FROM spans s JOIN places o ON o.document_id = s.document_id AND o.page_index = s.page_index AND o.e - o.n < s.start + length(value) AND o.e > s.start GROUP BY ALL),
referred AS (SELECT * FROM held WHERE raw_value <> '' QUALIFY row_number() OVER (PARTITION BY document_id, page_index, entity_type, raw_value, refs ORDER BY rule, n) = 1)"""

_EXTRACTED = f"""marked AS ({_rules()}),
found AS (SELECT *, unnest(range(0, len(p) // 2)) AS n FROM marked),
spans AS (SELECT *, p[2 * n + 2] AS raw_value, coalesce(list_sum(list_transform(p[1:2 * n + 1], lambda x: length(x))), 0)::INT AS start FROM found),
placed AS (SELECT *, length(substr(text, 1, start)) - length(replace(substr(text, 1, start), ' ', '')) AS first_token,
  length(substr(text, 1, start + length(raw_value))) - length(replace(substr(text, 1, start + length(raw_value)), ' ', '')) AS last_token FROM spans),
extracted AS (SELECT document_id, page_index, entity_type, raw_value, rule_id, first_token::INT AS first_token, last_token::INT AS last_token, (last_token - first_token + 1)::INT AS n_tokens FROM placed
  QUALIFY row_number() OVER (PARTITION BY document_id, page_index, entity_type, raw_value, first_token, last_token ORDER BY rule, n) = 1)"""

_TOKENS = f"tok AS ({fx.TOKENS})"
_BIO = f"""{_TOKENS},
known AS (SELECT t.*, s.prefix, s.entity_type, s.name IS NOT NULL AS known FROM tok t LEFT JOIN semantic_labels_v1 s ON s.name = t.label),
prev AS (SELECT *, lag(prefix) OVER w AS pp, lag(entity_type) OVER w AS pt FROM known WINDOW w AS (PARTITION BY document_id, page_index ORDER BY token_index, label NULLS FIRST)),
bad AS (SELECT document_id, page_index, token_index, label, CASE WHEN NOT known THEN 'unknown_label' WHEN prefix = 'I' AND NOT coalesce(pp IN ('B', 'I') AND pt = entity_type, false) THEN 'invalid_transition' END AS issue FROM prev),
seq AS (SELECT document_id, page_index, token_index, label, issue FROM bad WHERE issue IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY document_id, page_index ORDER BY issue <> 'unknown_label', token_index, label NULLS FIRST) = 1)"""
_SPANS = f"""{_BIO},
good AS (SELECT * FROM known k WHERE NOT EXISTS (SELECT 1 FROM seq s WHERE s.document_id = k.document_id AND s.page_index = k.page_index)),
open AS (SELECT *, sum(CASE WHEN prefix = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, page_index ORDER BY token_index ROWS UNBOUNDED PRECEDING) AS span FROM good),
spans AS (SELECT document_id, page_index, min(entity_type) AS entity_type, string_agg(coalesce(text, ''), ' ' ORDER BY token_index) AS raw_value, min(token_index) AS first_token, max(token_index) AS last_token
  FROM open WHERE prefix IN ('B', 'I') GROUP BY document_id, page_index, span)"""
_SIDES = f"""{_SPANS},
base AS (SELECT document_id AS sample_id, page_index, entity_type, raw_value, first_token, last_token FROM spans),
sides AS (SELECT *, 'reference' AS side FROM base UNION ALL
  SELECT sample_id, page_index, CASE WHEN first_token % 7 = 2 THEN 'SELLER_NAME' ELSE entity_type END, CASE WHEN first_token % 5 = 0 THEN raw_value || 'x' ELSE raw_value END, first_token,
    last_token + CASE WHEN first_token % 7 = 1 THEN 1 ELSE 0 END, 'predicted' FROM base WHERE first_token % 7 <> 0),
sliced AS (SELECT *, unnest([NULL, split_part(sample_id, '-', 1)]) AS cohort FROM sides)"""


def _prf(level: str, rows: str, key: str) -> str:
    return f"""WITH {_SIDES}, flags AS (SELECT cohort, {key}, bool_or(side = 'reference') AS r, bool_or(side = 'predicted') AS p FROM {rows} GROUP BY cohort, {key}),
kinds AS (SELECT cohort, r, p, unnest(['ALL', entity_type]) AS entity_type FROM flags),
c AS (SELECT cohort, entity_type, count(*) FILTER (r AND p) AS true_positives, count(*) FILTER (NOT r AND p) AS false_positives, count(*) FILTER (r AND NOT p) AS false_negatives FROM kinds GROUP BY cohort, entity_type),
s AS (SELECT *, true_positives::DOUBLE / nullif(true_positives + false_positives, 0) AS pr, true_positives::DOUBLE / nullif(true_positives + false_negatives, 0) AS re FROM c)
SELECT cohort, entity_type, true_positives, false_positives, false_negatives, round(pr, 8) AS precision, round(re, 8) AS recall,
  round(CASE WHEN pr IS NULL OR re IS NULL THEN NULL WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END, 8) AS f1, '{level}' AS level FROM s"""


_CLASSES = f"""WITH samples AS ({fx.CLASSIFIED}), sliced AS (SELECT *, unnest(list_distinct(list_filter([lang, source], lambda x: x IS NOT NULL)) || [NULL]) AS cohort FROM samples),
slices AS (SELECT DISTINCT cohort FROM sliced), labels AS (SELECT unnest(['INVOICE', 'NOT_INVOICE']) AS label)"""
_CLASS_METRICS = f"""{_CLASSES},
m AS (SELECT cohort, label, count(*) FILTER (reference = label) AS support, count(*) FILTER (reference = label AND prediction = label) AS tp, count(*) FILTER (prediction = label) AS np FROM sliced, labels GROUP BY cohort, label),
s AS (SELECT cohort, label, support, tp::DOUBLE / nullif(np, 0) AS pr, tp::DOUBLE / nullif(support, 0) AS re FROM m),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END AS f1 FROM s)"""

_REC = f"""WITH samples AS ({fx.RECOGNITION}),
vocab AS (SELECT *, string_split(reference, ' ') AS a, string_split(prediction, ' ') AS b FROM samples),
coded AS (SELECT *, list_sort(list_distinct(a || b)) AS v FROM vocab),
dist AS (SELECT sample_id, reference, prediction, p_brand, p_type, identifier_type, a, levenshtein(reference, prediction) AS ce,
  levenshtein(array_to_string(list_transform(a, lambda w: chr(33 + list_position(v, w)::INT)), ''), array_to_string(list_transform(b, lambda w: chr(33 + list_position(v, w)::INT)), '')) AS we FROM coded)"""

_BOXES = f"""WITH boxes AS ({fx.BOXES}), refs AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY n, x, shift, copies) - 1 AS reference_index, n, x, shift, copies FROM boxes),
expanded AS (SELECT *, unnest(range(0, copies)) AS k FROM refs), preds AS (SELECT sample_id, row_number() OVER (PARTITION BY sample_id ORDER BY n, k) - 1 AS predicted_index, n, x + shift AS x FROM expanded)"""
_IOU = "(greatest(0.0, least(r.x + 10, p.x + 10) - greatest(r.x, p.x)) * 10.0) / (200.0 - greatest(0.0, least(r.x + 10, p.x + 10) - greatest(r.x, p.x)) * 10.0)"

_LOGITS = """WITH rows AS (SELECT vec_id, label AS target, 'c' || (vec_id % 3) AS c, list_transform(embedding, lambda v: v::DOUBLE * 8) AS z FROM embeddings),
e AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM rows), p AS (SELECT vec_id, target, c, list_transform(x, lambda v: v / list_sum(x)) AS p FROM e),
m AS (SELECT vec_id, c, target, p, list_max(p) AS confidence, list_position(p, list_max(p)) - 1 AS predicted, -ln(greatest(p[target + 1], 1e-300)) AS nll,
  list_sum(list_transform(p, lambda v, i: pow(v - CASE WHEN i = target + 1 THEN 1.0 ELSE 0.0 END, 2))) AS brier FROM p)"""

_MAN = "manifest m"
_GROUPED = """keyed AS (SELECT m.manifest_name, m.pos, m.id, m.split, k.key, m.groups[k.key] AS value FROM manifest m
  JOIN (SELECT name, unnest(list_distinct(split_strategy.grouping_keys)) AS key FROM manifest_head WHERE split_strategy.method = 'grouped') k ON k.name = m.manifest_name)"""
_LEAKS = f"""{_GROUPED}, seen AS (SELECT *, first_value(split) OVER w AS first_split FROM keyed WHERE value IS NOT NULL WINDOW w AS (PARTITION BY manifest_name, key, value ORDER BY pos)),
leak AS (SELECT *, last_value(CASE WHEN split IS NOT DISTINCT FROM first_split THEN id END IGNORE NULLS) OVER (PARTITION BY manifest_name, key, value ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_id FROM seen)"""
_ARTIFACTS = "arts AS (SELECT manifest_name, pos, id, 'document' AS role, document.uri AS uri FROM manifest WHERE document.uri IS NOT NULL UNION ALL SELECT manifest_name, pos, id, 'annotation', annotation.uri FROM manifest WHERE annotation.uri IS NOT NULL)"

_MON = f"""WITH base AS ({fx.MONITORING}), mon AS (SELECT record_id, ts, stage, status, duration_seconds, CASE WHEN status <> 'ERROR' THEN user_id % 20 END AS output_count,
  CASE WHEN status <> 'ERROR' THEN (user_id % 100) / 100.0::DOUBLE END AS mean_confidence, event_type, status = 'ERROR' AS err FROM base)"""

_PIECES = f"""WITH {_TOKENS}, v AS (SELECT t.*, coalesce(bounding_box.x_min >= 0 AND bounding_box.y_min >= 0 AND bounding_box.x_max > bounding_box.x_min AND bounding_box.y_max > bounding_box.y_min AND bounding_box.x_max <= image_width AND bounding_box.y_max <= image_height, false) AS ok,
  s.id AS lab, i.id AS ins FROM tok t LEFT JOIN semantic_labels_v1 s ON s.name = t.label LEFT JOIN semantic_labels_v1 i ON i.name = CASE WHEN s.prefix = 'B' THEN 'I-' || s.entity_type ELSE s.name END),
g AS (SELECT document_id, page_index, token_index, greatest(1, ceil(length(text) / 4.0))::INT AS n, {", ".join(f"{'floor' if c.endswith('min') else 'ceil'}(1000.0::DOUBLE * bounding_box.{c} / {'image_width' if c[0] == 'x' else 'image_height'}::DOUBLE)::INT AS {c}" for c in CORNERS)}, lab, ins
  FROM v WHERE (document_id, page_index) NOT IN (SELECT (document_id, page_index) FROM v WHERE NOT ok OR lab IS NULL OR ins IS NULL)),
c AS (SELECT *, sum(n) OVER (PARTITION BY document_id, page_index) + 2 AS total, sum(n) OVER (PARTITION BY document_id, page_index ORDER BY token_index ROWS UNBOUNDED PRECEDING) - n AS before FROM g),
k AS (SELECT * EXCLUDE total, total > 512 AS truncated, CASE WHEN total > 512 THEN greatest(0, least(n, 510 - before)) ELSE n END AS take FROM c)"""


def _broken(when: str, where: str, keyword: str) -> str:
    return f"CASE WHEN {when} THEN [{where}, '{keyword}'] END"


_AT = "l || '.{}'"
_ANNOTATION_RULES = [_broken(f"{c} IS NULL", "l", "required") for c in ("token_index", "text", "b", "label")]
_ANNOTATION_RULES += [_broken("token_index < 0", _AT.format("token_index"), "minimum"), _broken("text = ''", _AT.format("text"), "minLength"), _broken("label IS NOT NULL AND label NOT IN (SELECT name FROM semantic_labels_v1 WHERE id <= 10)", _AT.format("label"), "enum")]
_ANNOTATION_RULES += [_broken(f"b IS NOT NULL AND b.{c} IS NULL", _AT.format("bounding_box"), "required") for c in CORNERS]
_ANNOTATION_RULES += [_broken(f"b.{c} {'<' if c.endswith('min') else '<='} 0", _AT.format(f"bounding_box.{c}"), "minimum" if c.endswith("min") else "exclusiveMinimum") for c in CORNERS]
_ANNOTATION_RULES += [_broken(f"k = 0 AND {c} IS NULL", "'$.pages[' || p || ']'", "required") for c in ("page_index", "image_width", "image_height")]
_ANNOTATION_RULES += [_broken(f"k = 0 AND {c} < {low}", f"'$.pages[' || p || '].{c}'", "minimum") for c, low in (("page_index", 0), ("image_width", 1), ("image_height", 1))]
_ANNOTATION_RULES += [_broken("p = 0 AND k = 0 AND document_id = ''", "'$.document_id'", "minLength"), _broken("p = 0 AND k = 0 AND length(document_id) > 256", "'$.document_id'", "maxLength")]


def _no_match(value: str, pattern: str) -> str:
    return f"NOT regexp_matches({value}, '{pattern}')"


_RECORD_RULES = [_broken(f"{c} IS NULL", "l", "required") for c in ("id", "split", "document")]
_RECORD_RULES += [_broken(_no_match("id", f"^{FORMATS['identifier']}$"), _AT.format("id"), "pattern"), _broken("length(id) > 256", _AT.format("id"), "maxLength"), _broken("split NOT IN ('training', 'validation', 'test')", _AT.format("split"), "enum")]
_RECORD_RULES += [_broken("len(list_distinct(cohorts)) + (CASE WHEN len(list_filter(cohorts, lambda x: x IS NULL)) > 0 THEN 1 ELSE 0 END) <> len(cohorts)", _AT.format("cohorts"), "uniqueItems"), _broken("cardinality(groups) = 0", _AT.format("groups"), "minProperties")]
for _role in ("document", "annotation"):
    _RECORD_RULES += [_broken(f"{_role} IS NOT NULL AND {_role}.{c} IS NULL", _AT.format(_role), "required") for c in ("uri", "sha256", "media_type")]
    _RECORD_RULES += [_broken(f"{_role}.uri = ''", _AT.format(f"{_role}.uri"), "minLength"), _broken(_no_match(f"{_role}.sha256", "^[a-f0-9]{64}$"), _AT.format(f"{_role}.sha256"), "pattern")]
    _RECORD_RULES += [_broken(_no_match(f"{_role}.media_type", schemas.MEDIA_PATTERN), _AT.format(f"{_role}.media_type"), "pattern"), _broken(f"{_role}.size_bytes < 0", _AT.format(f"{_role}.size_bytes"), "minimum")]
_PLACE = "l || '.cohorts[' || (i - 1) || ']'"
_EACH_COHORT = f"coalesce(flatten(list_transform(cohorts, lambda x, i: [{_broken('x IS NULL', _PLACE, 'type')}, {_broken(_no_match('x', schemas.KEY_PATTERN), _PLACE, 'pattern')}])), [])"
_GROUP = "l || '.groups.' || x.key"
_EACH_GROUP = f"""coalesce(flatten(list_transform(map_entries(groups), lambda x: [{_broken(_no_match('x.key', schemas.KEY_PATTERN), _AT.format('groups'), 'pattern')}, {_broken('x.value IS NULL', _GROUP, 'type')}, {_broken("x.value = ''", _GROUP, 'minLength')}, {_broken('length(x.value) > 256', _GROUP, 'maxLength')}])), [])"""
_HEAD_RULES = [_broken(f"{c} IS NULL", "'$'", "required") for c in ("schema_version", "version", "created_at", "tasks", "sources", "split_strategy")]
_HEAD_RULES += [_broken("schema_version <> '1.0.0'", "'$.schema_version'", "const"), _broken(_no_match("name", f"^{FORMATS['slug']}$"), "'$.name'", "pattern"), _broken(_no_match("version", f"^{FORMATS['semver']}$"), "'$.version'", "pattern"), _broken("len(tasks) = 0", "'$.tasks'", "minItems"), _broken("len(sources) = 0", "'$.sources'", "minItems")]
_HEAD_RULES += [_broken("split_strategy.method NOT IN ('source_provided', 'grouped', 'manual')", "'$.split_strategy.method'", "enum"), _broken("split_strategy.method = 'grouped' AND len(split_strategy.grouping_keys) = 0", "'$.split_strategy.grouping_keys'", "minItems"), _broken("split_strategy.random_seed < 0", "'$.split_strategy.random_seed'", "minimum")]
_EACH_TASK = "coalesce(list_transform(tasks, lambda x, i: CASE WHEN x IS NULL OR x NOT IN (" + ", ".join(f"'{t}'" for t in schemas.TASKS) + ") THEN ['$.tasks[' || (i - 1) || ']', 'enum'] END), [])"
_SOURCE = "'$.sources[' || (i - 1) || ']"
_EACH_SOURCE = f"""coalesce(flatten(list_transform(sources, lambda x, i: [{", ".join(_broken(f"x IS NOT NULL AND x.{c} IS NULL", _SOURCE + "'", "required") for c in ("name", "version"))}, {", ".join(_broken(f"x.{c} = ''", f"{_SOURCE}.{c}'", "minLength") for c in ("name", "version", "license"))}])), [])"""


def _level(name: str, rows: str, key: str) -> str:
    return f"""{name}_flags AS (SELECT cohort, {key}, bool_or(side = 'reference') AS r, bool_or(side = 'predicted') AS p FROM {rows} GROUP BY cohort, {key}),
{name} AS (SELECT cohort, entity_type, count(*) FILTER (r AND p) AS tp, count(*) FILTER (NOT r AND p) AS fp, count(*) FILTER (r AND NOT p) AS fn FROM (SELECT cohort, r, p, unnest(['ALL', entity_type]) AS entity_type FROM {name}_flags) GROUP BY ALL)"""


def _level_columns(name: str) -> str:
    tp, fp, fn = (f"coalesce({name}.{c}, 0)" for c in ("tp", "fp", "fn"))
    pr, re = f"({name}.tp::DOUBLE / nullif({name}.tp + {name}.fp, 0))", f"({name}.tp::DOUBLE / nullif({name}.tp + {name}.fn, 0))"
    return f"{tp} AS {name}_true_positives, {fp} AS {name}_false_positives, {fn} AS {name}_false_negatives, round({pr}, 8) AS {name}_precision, round({re}, 8) AS {name}_recall, round(CASE WHEN {pr} + {re} = 0 THEN 0.0 ELSE 2 * {pr} * {re} / ({pr} + {re}) END, 8) AS {name}_f1"


_ON = "{0}.cohort IS NOT DISTINCT FROM g.cohort AND {0}.entity_type = g.entity_type"
_EVALUATION = f"""WITH {_SIDES}, samples AS (SELECT DISTINCT document_id AS sample_id FROM annotation_token), sizes AS (SELECT cohort, count(*) AS sample_count FROM (SELECT unnest([NULL, split_part(sample_id, '-', 1)]) AS cohort FROM samples) GROUP BY cohort),
g AS (SELECT *, unnest(['ALL', {", ".join(f"'{t}'" for t in ENTITY_TYPES)}]) AS entity_type FROM sizes),
{_level("token", "(SELECT *, unnest(range(first_token, last_token + 1)) AS token FROM sliced)", "sample_id, entity_type, page_index, token")},
{_level("entity", "sliced", "sample_id, entity_type, page_index, first_token, last_token")},
fv AS (SELECT cohort, sample_id, entity_type, raw_value, sum(CASE side WHEN 'reference' THEN 1 ELSE -1 END) AS d FROM sliced GROUP BY ALL), ff AS (SELECT cohort, sample_id, entity_type, bool_and(d = 0) AS exact FROM fv GROUP BY ALL),
field AS (SELECT cohort, entity_type, count(*) AS n, count(*) FILTER (exact) AS x FROM (SELECT cohort, exact, unnest(['ALL', entity_type]) AS entity_type FROM ff) GROUP BY ALL)
SELECT g.cohort, g.entity_type, sample_count, {_level_columns("token")}, {_level_columns("entity")}, coalesce(n, 0) AS field_count, coalesce(x, 0) AS exact_matches, round(x / n::DOUBLE, 8) AS exact_match_rate
FROM g LEFT JOIN token ON {_ON.format("token")} LEFT JOIN entity ON {_ON.format("entity")} LEFT JOIN field ON {_ON.format("field")}"""

# Edits of each pair by dynamic programming: a cell is [cost, substitutions, insertions, deletions]; of equal costs a match or substitution comes before a deletion, a deletion before an insertion.
_CELL = "CASE WHEN {diag}[1] <= {up}[1] AND {diag}[1] <= {left}[1] THEN {diag} WHEN {up}[1] <= {left}[1] THEN {up} ELSE {left} END"
_OPS = f"""WITH RECURSIVE pairs AS (SELECT DISTINCT sample_id, reference AS a, prediction AS b FROM ({fx.RECOGNITION})),
dp AS (SELECT sample_id, a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: [j, 0, j, 0]) AS r FROM pairs UNION ALL
  SELECT sample_id, a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [[j]]), lambda acc, x: list_append(acc, {_CELL.format(
      diag="list_transform(r[x[1][1]], lambda v, k: v + CASE WHEN k <= 2 AND substr(a, i + 1, 1) <> substr(b, x[1][1]::INT, 1) THEN 1 ELSE 0 END)", up="list_transform(r[x[1][1] + 1], lambda v, k: v + CASE WHEN k IN (1, 4) THEN 1 ELSE 0 END)", left="list_transform(acc[-1], lambda v, k: v + CASE WHEN k IN (1, 3) THEN 1 ELSE 0 END)")}), [[i + 1, 0, 0, i + 1]]) FROM dp WHERE i < length(a)),
ops AS (SELECT sample_id, r[-1][2] AS s, r[-1][3] AS i, r[-1][4] AS d, CASE WHEN r[-1][1] = 0 THEN NULL WHEN (r[-1][2] > 0)::INT + (r[-1][3] > 0)::INT + (r[-1][4] > 0)::INT > 1 THEN 'mixed_character_edits' WHEN r[-1][2] > 0 THEN 'character_substitution' WHEN r[-1][3] > 0 THEN 'character_insertion' ELSE 'character_deletion' END AS category FROM dp WHERE dp.i = length(a))"""
_OBSERVED = f"""{_OPS}, {_BOXES.removeprefix("WITH ")}, hit AS (SELECT p.sample_id, count(DISTINCT r.reference_index) AS m FROM preds p JOIN refs r ON r.sample_id = p.sample_id AND {_IOU} >= 0.5 GROUP BY p.sample_id),
nn AS (SELECT r.sample_id, count(*) AS r, any_value(coalesce(p.n, 0)) AS p FROM refs r LEFT JOIN (SELECT sample_id, count(*) AS n FROM preds GROUP BY 1) p USING (sample_id) GROUP BY r.sample_id),
rec AS (SELECT x.*, o.* EXCLUDE sample_id FROM ({fx.RECOGNITION}) x JOIN ops o USING (sample_id)),
raw AS (SELECT sample_id, 'recognition' AS stage, category, s + i + d AS occurrences, [p_brand, p_type, NULL] AS c FROM rec WHERE category IS NOT NULL
  UNION ALL SELECT sample_id, 'recognition', 'identifier_mismatch', 1, [p_brand, p_type, NULL] FROM rec WHERE identifier_type IS NOT NULL AND reference <> prediction
  UNION ALL SELECT sample_id, 'detection', k.category, k.n, ['boxes-' || r, NULL] FROM (SELECT nn.*, unnest([{{'category': 'missed_region', 'n': r - coalesce(m, 0)}}, {{'category': 'spurious_region', 'n': p - coalesce(m, 0)}}]) AS k FROM nn LEFT JOIN hit USING (sample_id)) WHERE k.n > 0),
obs AS (SELECT sample_id, stage, category, occurrences, unnest(c) AS cohort FROM raw)"""


def _narrowed(levels: int, points: int) -> str:
    """Temperatures of least loss, each level a grid over the bracket around the best point of the one before; the last is as fine as doubles tell."""
    parts = ["d AS (SELECT list_transform(embedding, lambda v: (v::DOUBLE - embedding[label + 1]::DOUBLE) * 8) AS d FROM embeddings)", f"b0 AS (SELECT ln({T_MIN}) AS a, ln({T_MAX}) AS b)"]
    loss = "list_max(list_transform(d, lambda v: v / exp(x))) + ln(list_sum(list_transform(d, lambda v: exp(v / exp(x) - list_max(list_transform(d, lambda w: w / exp(x)))))))"
    for k in range(levels):
        parts += [f"g{k} AS (SELECT a, b, unnest(range({points})) AS i FROM b{k})", f"x{k} AS (SELECT a, b, i, a + (b - a) * i / {points - 1}.0::DOUBLE AS x FROM g{k})",
                  f"l{k} AS (SELECT any_value(a) AS a, any_value(b) AS b, i, any_value(x) AS x, avg({loss}) AS l FROM x{k}, d GROUP BY i)",
                  f"b{k + 1} AS (SELECT a + (b - a) * greatest(0, arg_min(i, (l, i)) - 1) / {points - 1}.0::DOUBLE AS a, a + (b - a) * least({points - 1}, arg_min(i, (l, i)) + 1) / {points - 1}.0::DOUBLE AS b FROM l{k} GROUP BY a, b)"]
    last = f"c AS (SELECT unnest([1.0::DOUBLE, {T_MIN}, {T_MAX}, exp((a + b) / 2)]) AS t FROM b{levels}), e AS (SELECT t, avg({loss.replace('exp(x)', 't')}) AS l FROM c, d GROUP BY t)"
    return f"WITH {', '.join(parts)}, {last} SELECT round(arg_min(t, (l, t)), 5) AS temperature, round(max(l) FILTER (t = 1.0), 8) AS nll_before, round(min(l), 8) AS nll_after FROM e"


_FIT = _narrowed(7, 17)


def _unpivoted(section: str, sql: str, measures: list[str], place: str = "''") -> str:
    pairs = ", ".join(f"{{'measure': '{m}', 'value': {m}::DOUBLE}}" for m in measures)
    return f"SELECT '{section}' AS section, cohort, {place} AS place, m.measure AS measure, round(m.value, 8) AS value FROM (SELECT *, unnest([{pairs}]) AS m FROM ({sql})) WHERE m.value IS NOT NULL"


SQL: dict[str, str] = {
    "label_distribution": f"{_CLASSIFIED} SELECT label, count(*) AS documents FROM classified GROUP BY label",
    "keyword_classify": f"{_CLASSIFIED} SELECT * FROM classified",
    "keyword_classify_documents": _keyword("WITH pages AS (SELECT doc_id::VARCHAR AS document_id, text FROM documents)", ("the report", "reported from", "without the", "according to"), 0.5, ("NARRATIVE", "OTHER")) + " SELECT * FROM classified",
    "normalize_text": f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents",
    "extract_entities": f"WITH {_PAGES}, {_EXTRACTED} SELECT * FROM extracted",
    "extract_field_coverage": f"WITH {_PAGES}, {_EXTRACTED} SELECT entity_type, count(DISTINCT document_id) AS documents, count(*) AS entities FROM extracted GROUP BY entity_type",
    "page_texts": f"WITH {_TOKENS} SELECT document_id, page_index, string_agg(coalesce(text, ''), ' ' ORDER BY token_index) AS text FROM tok GROUP BY document_id, page_index",
    "token_offsets": f"""WITH {_TOKENS}, o AS (SELECT *, length(coalesce(text, '')) AS n, sum(length(coalesce(text, '')) + 1) OVER (PARTITION BY document_id, page_index ORDER BY token_index, text ROWS UNBOUNDED PRECEDING) - 1 AS e FROM tok)
SELECT document_id, page_index, token_index, (e - n)::INT AS start, e::INT AS "end" FROM o""",
    "contiguity_check": f"WITH {_TOKENS}, o AS (SELECT *, (row_number() OVER (PARTITION BY document_id, page_index ORDER BY token_index) - 1)::INT AS expected_index FROM tok) SELECT document_id, page_index, token_index, expected_index FROM o WHERE token_index <> expected_index",
    # a page with a null text, or a box of a token that isn't blank which isn't a box, is refused whole
    "engine_payload_tokens": f"""WITH {_TOKENS}, boxed AS (SELECT *, bounding_box AS b, text IS NOT NULL AND regexp_full_match(text, '{_SPACES}*') AS blank FROM tok WHERE bounding_box IS NOT NULL),
refused AS (SELECT document_id, page_index FROM boxed WHERE text IS NULL OR NOT blank AND NOT coalesce(b.x_min >= 0 AND b.y_min >= 0 AND b.x_max > b.x_min AND b.y_max > b.y_min, false)),
kept AS (SELECT * FROM boxed WHERE NOT blank AND (document_id, page_index) NOT IN (SELECT (document_id, page_index) FROM refused))
SELECT document_id, page_index, (row_number() OVER (PARTITION BY document_id, page_index ORDER BY token_index) - 1)::INT AS token_index, text, bounding_box.x_min AS x_min, bounding_box.y_min AS y_min, bounding_box.x_max AS x_max, bounding_box.y_max AS y_max,
  round((token_index % 10) / 10.0::DOUBLE, 8) AS confidence FROM kept""",
    "bio_validate": f"WITH {_BIO} SELECT * FROM seq",
    "bio_reconstruct": f"WITH {_SPANS} SELECT * FROM spans",
    "vocabulary_check": f"""WITH v AS ({fx.LABEL_FAULTS}) SELECT name, 'invalid_name' AS issue FROM v WHERE CASE WHEN prefix = 'O' THEN name <> 'O' OR entity_type IS NOT NULL ELSE entity_type IS NULL OR name <> prefix || '-' || entity_type END
UNION ALL SELECT name, 'invalid_outside_label' FROM v WHERE (id = 0) <> (prefix = 'O')
UNION ALL SELECT name, 'duplicate_name' FROM v GROUP BY name HAVING count(*) > 1
UNION ALL SELECT entity_type, 'incomplete_pair' FROM v WHERE entity_type IS NOT NULL GROUP BY entity_type HAVING count(DISTINCT prefix) < 2
UNION ALL SELECT NULL, 'non_contiguous_ids' FROM v HAVING min(id) <> 0 OR max(id) <> count(*) - 1 OR count(DISTINCT id) <> count(*)""",
    "entity_token_prf": _prf("token", "(SELECT *, unnest(range(first_token, last_token + 1)) AS token FROM sliced)", "sample_id, entity_type, page_index, token"),
    "entity_span_prf": _prf("entity", "sliced", "sample_id, entity_type, page_index, first_token, last_token"),
    "entity_field_exact": f"""WITH {_SIDES}, v AS (SELECT cohort, sample_id, entity_type, raw_value, sum(CASE side WHEN 'reference' THEN 1 ELSE -1 END) AS d FROM sliced GROUP BY ALL),
f AS (SELECT cohort, sample_id, entity_type, bool_and(d = 0) AS exact FROM v GROUP BY ALL), k AS (SELECT cohort, exact, unnest(['ALL', entity_type]) AS entity_type FROM f)
SELECT cohort, entity_type, count(*) AS fields, count(*) FILTER (exact) AS exact, round(count(*) FILTER (exact) / count(*)::DOUBLE, 8) AS exact_match_rate FROM k GROUP BY cohort, entity_type""",
    "entity_overlaps": f"WITH {_SIDES} SELECT sample_id, side, page_index, token::INT AS token, count(*) AS uses FROM (SELECT *, unnest(range(first_token, last_token + 1)) AS token FROM sides) GROUP BY ALL HAVING count(*) > 1",
    "classification_confusion": f"{_CLASSES} SELECT s.cohort, r.label AS reference, p.label AS prediction, count(x.sample_id) AS sample_count FROM slices s CROSS JOIN labels r CROSS JOIN labels p LEFT JOIN sliced x ON x.cohort IS NOT DISTINCT FROM s.cohort AND x.reference = r.label AND x.prediction = p.label GROUP BY ALL",
    "classification_class_metrics": f"{_CLASS_METRICS} SELECT cohort, label, support, round(pr, 8) AS precision, round(re, 8) AS recall, round(f1, 8) AS f1 FROM f",
    "classification_summary": f"{_CLASS_METRICS}, a AS (SELECT cohort, count(*) AS sample_count, round(count(*) FILTER (reference = prediction) / count(*)::DOUBLE, 8) AS accuracy FROM sliced GROUP BY cohort) SELECT a.cohort, sample_count, accuracy, (SELECT round(avg(f1), 8) FROM f WHERE f.cohort IS NOT DISTINCT FROM a.cohort) AS macro_f1 FROM a",
    "edit_distances": f"{_REC} SELECT sample_id, ce::INT AS char_edits, we::INT AS word_edits FROM dist",
    "recognition_metrics": f"""{_REC}, s AS (SELECT *, unnest(list_distinct(list_filter([p_brand, p_type], lambda x: x IS NOT NULL)) || [NULL]) AS cohort FROM dist)
SELECT cohort, count(*) AS sample_count, sum(ce)::BIGINT AS character_edits, sum(length(reference))::BIGINT AS reference_characters, round(sum(ce)::DOUBLE / sum(length(reference)), 8) AS cer, sum(we)::BIGINT AS word_edits,
  sum(len(a))::BIGINT AS reference_words, round(sum(we)::DOUBLE / sum(len(a)), 8) AS wer, round(count(*) FILTER (reference = prediction) / count(*)::DOUBLE, 8) AS exact_match_rate,
  round(count(*) FILTER (reference = prediction AND identifier_type IS NOT NULL) / nullif(count(identifier_type), 0)::DOUBLE, 8) AS identifier_exact_match_rate FROM s GROUP BY cohort""",
    "iou_pairs": f"WITH boxes AS ({fx.BOXES}) SELECT r.sample_id, r.n, round({_IOU}, 8) AS iou FROM (SELECT sample_id, n, x, shift FROM boxes) r, LATERAL (SELECT r.x + r.shift AS x) p",
    "iou_candidates": f"{_BOXES} SELECT p.sample_id, p.predicted_index::INT AS predicted_index, r.reference_index::INT AS reference_index, round({_IOU}, 8) AS iou FROM preds p JOIN refs r ON r.sample_id = p.sample_id WHERE {_IOU} >= 0.1",
    # boxes lie 20 apart and are 10 wide, so a prediction can match one reference only: counts are those of distinct references
    "detection_metrics": f"""{_BOXES}, hit AS (SELECT p.sample_id, count(DISTINCT r.reference_index) AS m FROM preds p JOIN refs r ON r.sample_id = p.sample_id AND {_IOU} >= 0.5 GROUP BY p.sample_id),
n AS (SELECT r.sample_id, count(*) AS r, any_value(coalesce(p.n, 0)) AS p FROM refs r LEFT JOIN (SELECT sample_id, count(*) AS n FROM preds GROUP BY 1) p USING (sample_id) GROUP BY r.sample_id),
s AS (SELECT n.*, coalesce(m, 0) AS m, unnest(['boxes-' || n.r, NULL]) AS cohort FROM n LEFT JOIN hit USING (sample_id)),
t AS (SELECT cohort, count(*) AS sample_count, sum(m)::BIGINT AS tp, sum(p - m)::BIGINT AS fp, sum(r - m)::BIGINT AS fn FROM s GROUP BY cohort), q AS (SELECT *, tp::DOUBLE / nullif(tp + fp, 0) AS pr, tp::DOUBLE / nullif(tp + fn, 0) AS re FROM t)
SELECT cohort, sample_count, tp AS true_positives, fp AS false_positives, fn AS false_negatives, round(pr, 8) AS precision, round(re, 8) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) END, 8) AS f1 FROM q""",
    "box_normalize": f"""WITH {_TOKENS}, v AS (SELECT *, bounding_box.x_min >= 0 AND bounding_box.y_min >= 0 AND bounding_box.x_max > bounding_box.x_min AND bounding_box.y_max > bounding_box.y_min AND bounding_box.x_max <= image_width AND bounding_box.y_max <= image_height AS ok FROM tok)
SELECT document_id, page_index, token_index, CASE WHEN ok THEN floor(1000.0::DOUBLE * bounding_box.x_min / image_width::DOUBLE)::INT END AS x_min, CASE WHEN ok THEN floor(1000.0::DOUBLE * bounding_box.y_min / image_height::DOUBLE)::INT END AS y_min,
  CASE WHEN ok THEN ceil(1000.0::DOUBLE * bounding_box.x_max / image_width::DOUBLE)::INT END AS x_max, CASE WHEN ok THEN ceil(1000.0::DOUBLE * bounding_box.y_max / image_height::DOUBLE)::INT END AS y_max FROM v""",
    "subword_align": f"""WITH {_TOKENS}, v AS (SELECT t.*, coalesce(bounding_box.x_min >= 0 AND bounding_box.y_min >= 0 AND bounding_box.x_max > bounding_box.x_min AND bounding_box.y_max > bounding_box.y_min AND bounding_box.x_max <= image_width AND bounding_box.y_max <= image_height, false) AS ok,
  s.id AS lab, i.id AS ins FROM tok t LEFT JOIN semantic_labels_v1 s ON s.name = t.label LEFT JOIN semantic_labels_v1 i ON i.name = CASE WHEN s.prefix = 'B' THEN 'I-' || s.entity_type ELSE s.name END),
g AS (SELECT document_id, page_index, token_index, greatest(1, ceil(length(text) / 4.0))::INT AS n, floor(1000.0::DOUBLE * bounding_box.x_min / image_width::DOUBLE)::INT AS x, lab, ins FROM v WHERE (document_id, page_index) NOT IN (SELECT (document_id, page_index) FROM v WHERE NOT ok OR lab IS NULL OR ins IS NULL)),
c AS (SELECT *, sum(n) OVER (PARTITION BY document_id, page_index) + 2 AS total, sum(n) OVER (PARTITION BY document_id, page_index ORDER BY token_index ROWS UNBOUNDED PRECEDING) - n AS before FROM g),
k AS (SELECT *, CASE WHEN total > 512 THEN greatest(0, least(n, 510 - before)) ELSE n END AS take FROM c)
SELECT document_id, page_index, (sum(take) + 2)::BIGINT AS n_pieces, max(total) > 512 AS truncated, sum(take * x)::BIGINT AS x_sum, (sum(CASE WHEN take > 0 THEN lab + (take - 1) * ins ELSE 0 END) - 200)::BIGINT AS label_sum FROM k GROUP BY document_id, page_index""",
    "annotation_issues": f"""WITH {_BIO}, box AS (SELECT *, coalesce(bounding_box.x_min >= 0 AND bounding_box.y_min >= 0 AND bounding_box.x_max > bounding_box.x_min AND bounding_box.y_max > bounding_box.y_min, false) AS ok FROM tok),
pg AS (SELECT DISTINCT document_id, page_index FROM tok), pn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_index) - 1 AS e FROM pg), tn AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_index ORDER BY token_index) - 1 AS e FROM tok)
SELECT document_id, page_index, token_index, 'blank_token_text' AS code FROM tok WHERE text IS NULL OR regexp_full_match(text, '{_SPACES}*')
UNION ALL SELECT document_id, page_index, token_index, 'invalid_bounding_box' FROM box WHERE NOT ok
UNION ALL SELECT document_id, page_index, token_index, 'box_outside_page' FROM box WHERE ok AND (bounding_box.x_max > image_width OR bounding_box.y_max > image_height)
UNION ALL SELECT document_id, page_index, token_index, 'non_contiguous_token_index' FROM tn WHERE e <> token_index
UNION ALL SELECT document_id, page_index, token_index, 'invalid_bio_sequence' FROM seq
UNION ALL SELECT document_id, page_index, NULL, 'non_contiguous_page_index' FROM pn WHERE e <> page_index""",
    "softmax": f"{_LOGITS} SELECT vec_id, round(confidence, 8) AS confidence, predicted::INT AS predicted_index FROM m",
    "calibration_metrics": f"""{_LOGITS}, s AS (SELECT *, least(floor(confidence * 15)::INT, 14) AS bin, (predicted = target)::INT AS hit, unnest([c, NULL]) AS cohort FROM m),
b AS (SELECT cohort, bin, count(*) AS n, sum(confidence) AS cf, sum(hit) AS h, sum(nll) AS nll, sum(brier) AS br FROM s GROUP BY cohort, bin)
SELECT cohort, sum(n)::BIGINT AS sample_count, round(sum(nll) / sum(n), 8) AS nll, round(sum(abs(h - cf)) / sum(n), 8) AS ece, round(sum(br) / sum(n), 8) AS brier, round(sum(cf) / sum(n), 8) AS mean_confidence, round(sum(h)::DOUBLE / sum(n), 8) AS accuracy FROM b GROUP BY cohort""",
    "reliability_bins": f"""{_LOGITS}, b AS (SELECT least(floor(confidence * 15)::INT, 14) AS bin, count(*) AS n, avg(confidence) AS cf, avg((predicted = target)::INT) AS h FROM m GROUP BY 1), g AS (SELECT unnest(range(0, 15))::INT AS bin)
SELECT g.bin, round(g.bin / 15.0::DOUBLE, 8) AS lower_bound, round((g.bin + 1) / 15.0::DOUBLE, 8) AS upper_bound, coalesce(n, 0) AS sample_count, round(cf, 8) AS mean_confidence, round(h, 8) AS accuracy FROM g LEFT JOIN b USING (bin)""",
    "manifest_duplicate_ids": "SELECT manifest_name, pos, id, 'duplicate_record_id' AS code FROM manifest WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY manifest_name, id ORDER BY pos) > 1",
    "manifest_duplicate_artifacts": f"WITH {_ARTIFACTS} SELECT manifest_name, pos, id, role, uri, first_value(id) OVER w AS first_id FROM arts WINDOW w AS (PARTITION BY manifest_name, role, uri ORDER BY pos) QUALIFY row_number() OVER w > 1",
    "manifest_missing_groups": f"WITH {_GROUPED} SELECT manifest_name, pos, id, key FROM keyed WHERE value IS NULL",
    "manifest_split_leaks": f"WITH {_LEAKS} SELECT manifest_name, pos, id, key, value, split, first_split, first_id FROM leak WHERE split IS DISTINCT FROM first_split",
    "manifest_issues": f"""WITH {_ARTIFACTS}, {_LEAKS},
i AS (SELECT manifest_name, 1 AS phase, pos, 'duplicate_record_id' AS code, '.id' AS l, id FROM manifest WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY manifest_name, id ORDER BY pos) > 1
UNION ALL SELECT manifest_name, 1, pos, 'duplicate_artifact', '.' || role || '.uri', id FROM arts QUALIFY row_number() OVER (PARTITION BY manifest_name, role, uri ORDER BY pos) > 1
UNION ALL SELECT manifest_name, 2, pos, 'missing_group_value', '.groups', id FROM keyed WHERE value IS NULL UNION ALL SELECT manifest_name, 2, pos, 'split_leakage', '.groups.' || key, id FROM leak WHERE split IS DISTINCT FROM first_split)
SELECT manifest_name, phase, pos, code, '$.records[' || pos || ']' || l AS location, id FROM i""",
    "manifest_artifacts": """WITH a AS (SELECT doc_id AS pos, doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN 'document' ELSE 'annotation' END AS role, doc_id % 11 AS k, 'texts/' || doc_id || '.txt' AS plain,
  CASE doc_id % 14 WHEN 1 THEN '" "' WHEN 3 THEN '{"a": 1, "a": NaN}' WHEN 5 THEN ' [ ] ' WHEN 7 THEN 'null' WHEN 9 THEN '' WHEN 11 THEN '[1,]' ELSE text END AS text, doc_id % 14 AS j FROM documents),
b AS (SELECT *, CASE k WHEN 0 THEN 'texts' WHEN 1 THEN '../up/' || pos WHEN 2 THEN 'https://host/' || pos WHEN 3 THEN 'absent/' || pos ELSE
  CASE pos % 22 WHEN 7 THEN './' || plain WHEN 8 THEN 'a/.././' || plain WHEN 9 THEN replace(plain, '/', '//') WHEN 10 THEN replace(plain, '/', '%2F') ELSE plain END END AS uri FROM a)
SELECT 'texts' AS manifest_name, pos, id, role, uri, unnest(list_filter([CASE WHEN k = 0 THEN 'unreadable_artifact' END, CASE WHEN k IN (1, 2) THEN 'unsupported_artifact_uri' END, CASE WHEN k = 3 THEN 'missing_artifact' END, CASE WHEN k > 3 AND text = '' THEN 'empty_artifact' END,
  CASE WHEN k = 5 AND text IS NOT NULL THEN 'artifact_size_mismatch' END, CASE WHEN k = 4 THEN 'checksum_mismatch' END, CASE WHEN k > 3 AND role = 'annotation' AND text <> '' AND (j = 11 OR j NOT IN (1, 3, 5, 7) AND NOT json_valid(text)) THEN 'corrupt_annotation' END,
  CASE WHEN k > 3 AND role = 'annotation' AND j IN (5, 7) THEN 'empty_annotation' END], lambda x: x IS NOT NULL)) AS code FROM b""",
    "monitoring_summary": f"{_MON} SELECT stage, count(*) AS records, count(*) FILTER (err) AS errors, sum(output_count)::BIGINT AS outputs, round(avg(duration_seconds), 6) AS mean_duration, round(max(duration_seconds), 6) AS max_duration, round(avg(mean_confidence), 6) AS mean_confidence, round(count(*) FILTER (err) / count(*)::DOUBLE, 6) AS error_rate FROM mon GROUP BY stage",
    "monitoring_categories": f"{_MON} SELECT stage, event_type AS category, count(*) AS records FROM mon WHERE NOT err AND event_type IS NOT NULL GROUP BY ALL",
    "monitoring_issues": f"""WITH m AS ({fx.MONITORING_FAULTS}), f AS (SELECT *, status = 'ERROR' AS e FROM m)
SELECT record_id, unnest(list_filter([CASE WHEN duration_seconds IS NULL OR duration_seconds < 0 THEN 'invalid_duration' END, CASE WHEN model_name IS NULL THEN 'partial_model_identity' END, CASE WHEN output_count < 0 THEN 'negative_output_count' END,
  CASE WHEN mean_confidence > 1 THEN 'invalid_confidence' END, CASE WHEN twice THEN 'duplicate_categories' END, CASE WHEN e AND (error_type IS NULL OR trim(error_type) = '') THEN 'missing_error_type' END,
  CASE WHEN e AND (output_count IS NOT NULL OR mean_confidence IS NOT NULL) THEN 'error_with_outputs' END, CASE WHEN NOT e AND error_type IS NOT NULL THEN 'success_with_error_type' END], lambda x: x IS NOT NULL)) AS issue FROM f""",
    "monitoring_window": f"{_MON} SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start, stage, count(*) AS records, count(*) FILTER (err) AS errors, round(avg(duration_seconds), 6) AS mean_duration FROM mon GROUP BY ALL",
    "pipeline_inference": f"{_CLASSIFIED}, {_EXTRACTED}, x AS (SELECT document_id, count(*) AS n, string_agg(entity_type || '=' || raw_value, '|' ORDER BY entity_type || '=' || raw_value) AS e FROM extracted GROUP BY 1) SELECT document_id, label, coalesce(n, 0) AS n_entities, coalesce(e, '') AS entities FROM classified LEFT JOIN x USING (document_id)",
    "pipeline_records": f"""{_CLASSIFIED}, {_EXTRACTED}, x AS (SELECT document_id, count(*) AS n, string_agg(DISTINCT entity_type, '|' ORDER BY entity_type) AS c FROM extracted GROUP BY 1),
o AS (SELECT document_id, len(string_split(text, ' ')) AS n, list_avg(list_transform(range(len(string_split(text, ' '))), lambda i: (i % 4) / 4.0::DOUBLE)) AS conf FROM pages)
SELECT document_id, 'ocr' AS stage, 'SUCCESS' AS status, 0.25::DOUBLE AS duration_seconds, n AS output_count, '' AS output_categories, round(conf, 8) AS mean_confidence FROM o
UNION ALL SELECT document_id, 'classification', 'SUCCESS', 0.0, 1, label, NULL FROM classified
UNION ALL SELECT document_id, 'extraction', 'SUCCESS', 0.0, coalesce(n, 0), coalesce(c, ''), NULL FROM classified LEFT JOIN x USING (document_id)
UNION ALL SELECT document_id, 'pipeline', 'SUCCESS', 0.0, NULL, '', NULL FROM classified""",
    "bundle_manifest": "SELECT 'text' AS role, doc_id::VARCHAR AS filename, octet_length(encode(text)) AS size_bytes, sha256(text) AS sha256 FROM documents",
    "extract_token_references": f"WITH {_TOKENS}, {_REFERRED} SELECT document_id, page_index, entity_type, raw_value, rule_id, len(refs)::INT AS n_tokens, unnest(refs) AS token_index FROM referred",
    "engine_result_tokens": f"""WITH r AS ({fx.ENGINE_RESULTS}), k AS (SELECT document_id, result_index, document_id::BIGINT % 12 AS k FROM r)
SELECT document_id, CASE k WHEN 0 THEN 3 ELSE result_index END AS page_index, t.token_index, t.text, t.x_min, t.y_min, t.x_max, t.y_max, t.confidence FROM (SELECT *, unnest(CASE k
  WHEN 0 THEN [{{'token_index': 0, 'text': 'a', 'x_min': 1.0::DOUBLE, 'y_min': 2.0::DOUBLE, 'x_max': 3.0::DOUBLE, 'y_max': 4.0::DOUBLE, 'confidence': 0.5::DOUBLE}}, {{'token_index': 1, 'text': 'b', 'x_min': 5.0::DOUBLE, 'y_min': 6.0::DOUBLE, 'x_max': 7.0::DOUBLE, 'y_max': 8.0::DOUBLE, 'confidence': 1.0::DOUBLE}}]
  WHEN 1 THEN [{{'token_index': 0, 'text': 'a', 'x_min': 1.0::DOUBLE, 'y_min': 2.0::DOUBLE, 'x_max': 3.0::DOUBLE, 'y_max': 4.0::DOUBLE, 'confidence': 0.5::DOUBLE}}]
  WHEN 2 THEN [{{'token_index': 0, 'text': 'a', 'x_min': 1.0::DOUBLE, 'y_min': 2.0::DOUBLE, 'x_max': 3.0::DOUBLE, 'y_max': 4.0::DOUBLE, 'confidence': 0.5::DOUBLE}}] END) AS t FROM k)""",
    "engine_issues": f"""WITH r AS ({fx.ENGINE_RESULTS}) SELECT document_id, result_index, CASE document_id::BIGINT % 12 WHEN 3 THEN 'length_mismatch' WHEN 4 THEN 'invalid_confidence' WHEN 5 THEN 'invalid_geometry' WHEN 6 THEN 'length_mismatch' WHEN 7 THEN 'invalid_text'
  WHEN 8 THEN 'missing_array' WHEN 9 THEN 'missing_array' WHEN 10 THEN 'invalid_page_index' END AS issue FROM r WHERE document_id::BIGINT % 12 BETWEEN 3 AND 10""",
    "ocr_contract_issues": f"""WITH {_TOKENS}, p AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_index ORDER BY token_index) - 1 AS k, bounding_box AS b FROM tok), g AS (SELECT *, min(CASE WHEN token_index <> k THEN k END) OVER (PARTITION BY document_id, page_index) AS first_gap FROM p),
i AS (SELECT document_id, page_index, token_index, unnest(list_filter([CASE WHEN text IS NULL OR regexp_full_match(text, '{_SPACES}*') THEN 'blank_text' END, CASE WHEN NOT coalesce(b.x_min >= 0 AND b.y_min >= 0 AND b.x_max > b.x_min AND b.y_max > b.y_min, false) THEN 'invalid_box' END,
  CASE WHEN k = first_gap THEN 'non_contiguous_tokens' END, CASE WHEN token_index % 5 <> 3 AND token_index % 13 > 10 THEN 'invalid_confidence' END], lambda x: x IS NOT NULL)) AS issue FROM g) SELECT * FROM i""",
    "page_contract_issues": f"""WITH t AS ({fx.PAGE_GAPS}), p AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_index) - 1 AS k FROM (SELECT DISTINCT document_id, page_index FROM t))
SELECT document_id, page_index, 'non_contiguous_pages' AS issue FROM p WHERE page_index <> k QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY k) = 1""",
    "classification_contract_issues": f"""{_CLASSIFIED}, f AS (SELECT document_id, document_id::BIGINT % 9 AS k, label, decision_score AS s FROM classified)
SELECT document_id, CASE k WHEN 1 THEN 'unknown_label' WHEN 2 THEN 'label_disagrees' WHEN 3 THEN 'invalid_score' WHEN 4 THEN 'invalid_threshold' WHEN 5 THEN 'repeated_signal' ELSE 'empty_signal' END AS issue FROM f WHERE k BETWEEN 1 AND 6
UNION ALL SELECT document_id, 'label_disagrees' FROM f WHERE label = 'NOT_INVOICE' AND k IN (3, 4)""",
    "entity_contract_issues": f"""WITH {_PAGES}, {_EXTRACTED}, f AS (SELECT *, document_id::BIGINT % 9 AS k FROM extracted)
SELECT document_id, page_index, CASE WHEN k = 1 THEN 'OTHER' ELSE entity_type END AS entity_type, raw_value, CASE k WHEN 1 THEN 'unknown_entity_type' WHEN 2 THEN 'blank_rule_id' WHEN 3 THEN 'no_references' WHEN 4 THEN 'repeated_reference' ELSE 'negative_reference' END AS issue FROM f WHERE k BETWEEN 1 AND 5""",
    "span_contract_issues": f"""WITH {_SPANS} SELECT document_id, page_index, entity_type, first_token, unnest(list_filter([CASE WHEN regexp_full_match(raw_value, '{_SPACES}*') THEN 'blank_value' END,
  CASE WHEN entity_type NOT IN ({", ".join(f"'{t}'" for t in ENTITY_TYPES)}) THEN 'unknown_entity_type' END], lambda x: x IS NOT NULL)) AS issue FROM spans""",
    "subword_pieces": f"""{_PIECES} SELECT * FROM (
SELECT document_id, page_index, truncated, (1 + before + j)::INT AS piece, x_min, y_min, x_max, y_max, CASE WHEN j = 0 THEN lab ELSE ins END AS label_id FROM (SELECT *, unnest(range(0, take::BIGINT)) AS j FROM k)
UNION ALL SELECT document_id, page_index, truncated, unnest([0, total])::INT, 0, 0, 0, 0, -100 FROM (SELECT document_id, page_index, any_value(truncated) AS truncated, sum(take) + 1 AS total FROM k GROUP BY ALL))""",
    "feature_issues": f"""WITH {_TOKENS}, v AS (SELECT t.*, coalesce(bounding_box.x_min >= 0 AND bounding_box.y_min >= 0 AND bounding_box.x_max > bounding_box.x_min AND bounding_box.y_max > bounding_box.y_min AND bounding_box.x_max <= image_width AND bounding_box.y_max <= image_height, false) AS ok,
  s.id IS NOT NULL AND (s.prefix <> 'B' OR EXISTS (SELECT 1 FROM semantic_labels_v1 i WHERE i.name = 'I-' || s.entity_type)) AS known FROM tok t LEFT JOIN semantic_labels_v1 s ON s.name = t.label)
SELECT document_id, page_index, CASE WHEN bool_or(NOT ok) THEN 'invalid_bounding_box' ELSE 'unknown_label' END AS issue FROM v GROUP BY document_id, page_index HAVING bool_or(NOT ok OR NOT known)""",
    "annotation_schema_issues": f"""WITH {_TOKENS}, p AS (SELECT *, dense_rank() OVER (PARTITION BY document_id ORDER BY page_index) - 1 AS p, row_number() OVER (PARTITION BY document_id, page_index ORDER BY token_index, text) - 1 AS k FROM tok),
l AS (SELECT *, '$.pages[' || p || '].tokens[' || k || ']' AS l, bounding_box AS b FROM p),
i AS (SELECT document_id, page_index, token_index, unnest([{", ".join(_ANNOTATION_RULES)}]) AS v FROM l)
SELECT document_id, page_index, token_index, 'schema_violation' AS code, v[1] AS location, v[2] AS keyword FROM i WHERE v[1] IS NOT NULL""",
    "annotation_version_issues": """SELECT DISTINCT document_id, 'label_schema_mismatch' AS code, '$.label_schema_version' AS location, label_schema_version FROM annotation_token LEFT JOIN annotation_batch USING (batch_id) WHERE label_schema_version IS DISTINCT FROM '1.0.0'""",
    "manifest_schema_issues": f"""WITH r AS (SELECT *, '$.records[' || pos || ']' AS l FROM manifest),
v AS (SELECT manifest_name, pos, id, unnest([{", ".join(_RECORD_RULES)}] || {_EACH_COHORT} || {_EACH_GROUP}) AS v FROM r
UNION ALL SELECT name, NULL, NULL, unnest([{", ".join(_HEAD_RULES)}] || {_EACH_TASK} || {_EACH_SOURCE}) FROM manifest_head
UNION ALL SELECT name, NULL, NULL, ['$.records', 'minItems'] FROM manifest_head WHERE name NOT IN (SELECT manifest_name FROM manifest WHERE manifest_name IS NOT NULL))
SELECT manifest_name, pos, id, 'schema_violation' AS code, v[1] AS location, v[2] AS keyword, array_to_string(list_filter(regexp_split_to_array(substr(v[1], 2), '[.\\[\\]]'), lambda x: x <> ''), '/') AS parts FROM v WHERE v[1] IS NOT NULL""",
    "pipeline_failures": """WITH e AS (SELECT event_id::VARCHAR AS document_id, CASE event_id % 3 WHEN 0 THEN 'ocr' WHEN 1 THEN 'extraction' ELSE 'pipeline' END AS stage, CASE WHEN event_id % 3 = 0 THEN 'ValueError' ELSE 'Exception' END AS error_type, greatest(0.0, coalesce(value - 50, 0.0)) AS d FROM events WHERE event_type = 'error')
SELECT document_id, unnest(list_distinct([stage, 'pipeline'])) AS stage, 'ERROR' AS status, round(d, 6) AS duration_seconds, error_type, 0 AS categories FROM e""",
    "entity_evaluation": _EVALUATION,
    "region_matching": f"{_BOXES} SELECT p.sample_id, r.reference_index::INT AS reference_index, min(p.predicted_index)::INT AS predicted_index FROM preds p JOIN refs r ON r.sample_id = p.sample_id WHERE {_IOU} >= 0.5 GROUP BY ALL",
    "monitoring_window_p95": f"{_MON} SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M:%SZ') AS window_start, stage, count(*) AS records, count(*) FILTER (err) AS errors, round(avg(duration_seconds), 6) AS mean_duration, round(quantile_disc(duration_seconds, 0.95), 6) AS p95_duration FROM mon GROUP BY ALL",
    "edit_op_counts": f"{_OPS} SELECT sample_id, s::INT AS substitutions, i::INT AS insertions, d::INT AS deletions, category FROM ops",
    "ocr_error_ranking": f"""{_OBSERVED}, r AS (SELECT cohort, stage, category, count(DISTINCT sample_id) AS affected_samples, sum(occurrences)::BIGINT AS occurrences FROM obs GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY occurrences DESC, stage, category)::INT AS rank FROM r""",
    "ocr_error_slices": f"""{_OBSERVED}, n AS (SELECT cohort, count(*) AS samples FROM (SELECT unnest([p_brand, p_type, NULL]) AS cohort FROM ({fx.RECOGNITION}) UNION ALL SELECT unnest(['boxes-' || r, NULL]) FROM nn) GROUP BY cohort),
h AS (SELECT cohort, count(DISTINCT (stage, sample_id)) AS affected FROM obs GROUP BY cohort)
SELECT n.cohort, samples, coalesce(affected, 0) AS affected_samples FROM n LEFT JOIN h ON h.cohort IS NOT DISTINCT FROM n.cohort""",
    "temperature_fit": _FIT,
}

_RATES = ["precision", "recall", "f1"]
_COUNTS = ["true_positives", "false_positives", "false_negatives"]
_OF_LEVELS = [f"{x}_{c}" for x in ("token", "entity") for c in _COUNTS + _RATES]
SQL |= {
    "report_ocr": " UNION ALL ".join([
        _unpivoted("recognition", SQL["recognition_metrics"], ["sample_count", "character_edits", "reference_characters", "cer", "word_edits", "reference_words", "wer", "exact_match_rate", "identifier_exact_match_rate"]),
        _unpivoted("detection", f"SELECT *, 0.5 AS iou_threshold FROM ({SQL['detection_metrics']})", ["sample_count", *_COUNTS, *_RATES, "iou_threshold"]),
    ]),
    "report_classification": " UNION ALL ".join([
        _unpivoted("summary", SQL["classification_summary"], ["sample_count", "accuracy", "macro_f1"]), _unpivoted("classes", SQL["classification_class_metrics"], ["support", *_RATES], "label"),
        _unpivoted("confusion", SQL["classification_confusion"], ["sample_count"], "reference || '|' || prediction"),
    ]),
    "report_entities": _unpivoted("entities", SQL["entity_evaluation"], ["sample_count", *_OF_LEVELS, "field_count", "exact_matches", "exact_match_rate"], "entity_type"),
    "report_calibration": " UNION ALL ".join([
        _unpivoted("metrics", f"SELECT *, 2.0 AS temperature FROM ({SQL['calibration_metrics'].replace('* 8', '* 4')})", ["sample_count", "nll", "ece", "brier", "mean_confidence", "accuracy", "temperature"]),
        _unpivoted("reliability", f"SELECT *, NULL::VARCHAR AS cohort FROM ({SQL['reliability_bins'].replace('* 8', '* 4')})", ["lower_bound", "upper_bound", "sample_count", "mean_confidence", "accuracy"], "bin::VARCHAR"),
    ]),
    "report_errors": " UNION ALL ".join([
        _unpivoted("errors", SQL["ocr_error_ranking"], ["affected_samples", "occurrences", "rank"], "stage || '|' || category"), _unpivoted("samples", SQL["ocr_error_slices"], ["samples", "affected_samples"]),
    ]),
}
