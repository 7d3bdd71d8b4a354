"""SQL of the queries whose result SQL can give over whole tables."""

_GRAMS = r"""w AS (SELECT t, k, s, regexp_extract_all(lower(x), '[\p{L}\p{N}]+') AS w FROM r),
g AS (SELECT t, k, s, list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 20),
e AS (SELECT t, k, s, len(g) AS n, unnest(g) AS u FROM g),
c AS (SELECT a.t, a.k AS ka, b.k AS kb, a.s AS sa, b.s AS sb, a.n AS na, b.n AS nb, count(*) AS m FROM e a JOIN e b ON a.u = b.u AND a.t = b.t AND a.k < b.k GROUP BY ALL)"""

SQL = {
    "p4_found": f"""WITH r AS (SELECT DISTINCT 1 AS t, chunk_id AS k, '' AS s, chunk_text AS x FROM company_relationships WHERE chunk_text IS NOT NULL AND chunk_id IS NOT NULL),
{_GRAMS}
SELECT DISTINCT ka AS chunk_a, kb AS chunk_b FROM c WHERE 2 * m >= na + nb - m""",
    "p2_found": f"""WITH q AS (SELECT 'company_relationships' AS t, chunk_id AS k, split AS s, chunk_text AS x FROM company_relationships
  UNION ALL SELECT 'judge_examples', example_id, split, text FROM judge_examples),
r AS (SELECT DISTINCT t, k, CASE WHEN lower(trim(s)) = 'train' THEN 1 ELSE 0 END AS s, x FROM q WHERE x IS NOT NULL AND k IS NOT NULL AND lower(trim(s)) IN ('train', 'dev', 'test', 'validation')),
{_GRAMS}
SELECT DISTINCT t AS record_table, ka AS key_a, kb AS key_b FROM c WHERE 2 * m >= na + nb - m AND sa <> sb""",
}

_PAIR = r"""SELECT 'company_relationships' AS t, chunk_id AS k, split AS s, chunk_text AS x FROM company_relationships
  UNION ALL SELECT 'judge_examples', example_id, split, text FROM judge_examples"""

SQL["p2_by_split_and_source"] = rf"""WITH q AS ({_PAIR}),
r AS (SELECT DISTINCT t, k, CASE lower(trim(s)) WHEN 'validation' THEN 'dev' ELSE lower(trim(s)) END AS s, x FROM q
  WHERE x IS NOT NULL AND k IS NOT NULL AND lower(trim(s)) IN ('train', 'dev', 'test', 'validation')),
u AS (SELECT t, x, row_number() OVER () AS i FROM (SELECT DISTINCT t, x FROM r)),
m AS (SELECT t, k, s, i FROM r JOIN u USING (t, x)),
w AS (SELECT t, i, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w FROM u),
g AS (SELECT t, i, list_distinct([w[j] || ' ' || w[j + 1] || ' ' || w[j + 2] FOR j IN range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 20),
e AS (SELECT t, i, len(g) AS n, unnest(g) AS h FROM g),
c AS (SELECT a.i AS a, b.i AS b, a.n AS na, b.n AS nb, count(*) AS m FROM e a JOIN e b ON a.h = b.h AND a.t = b.t GROUP BY ALL),
l AS (SELECT a, b, m / na AS containment FROM c WHERE 2 * m >= na + nb - m),
p AS (SELECT x.t, x.s, x.k, containment FROM m x JOIN l ON x.i = l.a JOIN m y ON y.i = l.b AND y.s = 'train' AND y.t = x.t AND y.k <> x.k WHERE x.s <> 'train'),
v AS (SELECT t, s, k, count(*) AS n, max(containment) AS containment FROM p GROUP BY ALL),
o AS (SELECT 'company_relationships' AS t, chunk_id AS k, min(@ITEM@) AS source FROM company_relationships GROUP BY ALL
  UNION ALL SELECT 'judge_examples', example_id, min(filing) FROM judge_examples GROUP BY ALL)
SELECT t AS record_table, s AS split, source, count(*) AS records, sum(n)::BIGINT AS train_records, round(avg(containment), 6) AS mean_containment FROM v LEFT JOIN o USING (t, k) GROUP BY t, s, source"""

_SPACE = r"'^[\s\x{00a0}]+|[\s\x{00a0}]+$'"
_ITEM_RE = r"'^ ?(?:part ?[ivx]+[ ,.:-]*)?(?:item)?[ .:#-]*(\d{1,2})\.?([a-z]?)(?:[^a-z0-9]|$)'"


def _label(c: str) -> str:
    return f"lower(regexp_replace({c}, {_SPACE}, '', 'g'))"


def _item(c: str) -> str:
    s = rf"regexp_replace(lower({c}), '[\s\x{{00a0}}_]+', ' ', 'g')"
    part = lambda k: f"regexp_extract({s}, {_ITEM_RE}, {k})"
    return f"CASE WHEN {part(1)} <> '' THEN 'Item ' || regexp_replace({part(1)}, '^0', '') || upper({part(2)}) END"


SQL["p2_by_split_and_source"] = SQL["p2_by_split_and_source"].replace("@ITEM@", _item("item_key"))

_FILING = "regexp_replace(accession_number, '[^0-9]', '', 'g')"

SQL |= {
    "p3_found": f"""WITH RECURSIVE e AS (SELECT DISTINCT {_FILING} AS f, {_label("company_id")} AS c FROM company_relationships
  WHERE length({_FILING}) = 18 AND {_FILING} <> '000000000000000000' AND {_label("company_id")} NOT IN ('co-0000000', '')),
p AS (SELECT DISTINCT a.c AS x, b.c AS y FROM e a JOIN e b ON a.f = b.f AND a.c <> b.c),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
SELECT DISTINCT x AS company_a, y AS company_b FROM r WHERE x < y""",
    "p3_groups": f"""WITH RECURSIVE t AS (SELECT row_id::VARCHAR AS k, CASE WHEN length({_FILING}) = 18 AND {_FILING} <> '000000000000000000' THEN {_FILING} END AS f,
  CASE WHEN {_label("company_id")} NOT IN ('co-0000000', '') THEN {_label("company_id")} END AS c FROM company_relationships),
e AS (SELECT DISTINCT f, c FROM t WHERE f IS NOT NULL AND c IS NOT NULL), p AS (SELECT DISTINCT a.c AS x, b.c AS y FROM e a JOIN e b USING (f)),
r AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x), l AS (SELECT x AS c, min(y) AS label FROM r GROUP BY 1), lf AS (SELECT f, min(label) AS label FROM e JOIN l USING (c) GROUP BY 1),
a AS (SELECT 'company_relationships' AS record_table, k AS record_key, f, c FROM t WHERE k IS NOT NULL
  UNION ALL SELECT 'judge_examples', example_id, CASE WHEN length(regexp_replace(filing, '[^0-9]', '', 'g')) = 18 AND regexp_replace(filing, '[^0-9]', '', 'g') <> '000000000000000000' THEN regexp_replace(filing, '[^0-9]', '', 'g') END, NULL FROM judge_examples WHERE example_id IS NOT NULL)
SELECT record_table, record_key, coalesce(min(coalesce('c ' || coalesce(l.label, lf.label), 'f ' || a.f)), 'r ' || record_table || ' ' || record_key) AS grp
FROM a LEFT JOIN l USING (c) LEFT JOIN lf ON lf.f = a.f GROUP BY record_table, record_key""",
    "p5_found": f"""WITH i AS (SELECT DISTINCT chunk_id, {_item("item_key")} AS source FROM company_relationships WHERE chunk_id IS NOT NULL),
t AS (SELECT {_item("item_key")} AS source, max(keep_share) AS share FROM keep_targets GROUP BY 1),
l AS (SELECT outcome_id, chunk_id, confidence, row_number() OVER (PARTITION BY outcome_id ORDER BY evaluated_at DESC NULLS LAST, confidence DESC NULLS LAST, chunk_id DESC NULLS LAST) AS k FROM extraction_outcomes WHERE outcome_id IS NOT NULL),
o AS (SELECT outcome_id, source, share, confidence FROM l JOIN i USING (chunk_id) JOIN t USING (source) WHERE k = 1 AND confidence BETWEEN 0 AND 1),
c AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, count(*) OVER (PARTITION BY source ORDER BY confidence DESC RANGE UNBOUNDED PRECEDING) AS above FROM o),
x AS (SELECT source, max(confidence) AS cutoff FROM c WHERE above::DOUBLE / n >= share GROUP BY source)
SELECT DISTINCT outcome_id FROM o JOIN x USING (source) WHERE confidence >= cutoff""",
    "p5_cutoffs": f"""WITH i AS (SELECT DISTINCT chunk_id, {_item("item_key")} AS item_key FROM company_relationships WHERE chunk_id IS NOT NULL),
t AS (SELECT {_item("item_key")} AS item_key, max(keep_share) AS share FROM keep_targets GROUP BY 1),
l AS (SELECT outcome_id, chunk_id, confidence, row_number() OVER (PARTITION BY outcome_id ORDER BY evaluated_at DESC NULLS LAST, confidence DESC NULLS LAST, chunk_id DESC NULLS LAST) AS k FROM extraction_outcomes WHERE outcome_id IS NOT NULL),
o AS (SELECT outcome_id, item_key, confidence FROM l JOIN i USING (chunk_id) WHERE k = 1 AND confidence BETWEEN 0 AND 1),
c AS (SELECT *, count(*) OVER (PARTITION BY item_key) AS n, count(*) OVER (PARTITION BY item_key ORDER BY confidence DESC RANGE UNBOUNDED PRECEDING) AS above FROM o JOIN t USING (item_key)),
x AS (SELECT item_key, max(confidence) AS cutoff, min(above) AS kept FROM c WHERE above::DOUBLE / n >= share GROUP BY item_key),
n AS (SELECT item_key, count(*) AS records FROM o GROUP BY item_key)
SELECT t.item_key, t.share, coalesce(n.records, 0) AS records, x.cutoff, coalesce(x.kept, 0) AS kept FROM t LEFT JOIN n USING (item_key) LEFT JOIN x USING (item_key)""",
    "p6_cells": f"""WITH t AS (SELECT {_label("relationship_type")} AS relationship_type, {_item("item_key")} AS item_key, target_share, min_rows FROM mix_targets),
e AS (SELECT DISTINCT row_id, {_label("relationship_type")} AS relationship_type, {_item("item_key")} AS item_key FROM company_relationships WHERE row_id IS NOT NULL),
r AS (SELECT t.*, row_number() OVER (PARTITION BY relationship_type, item_key) AS r FROM t JOIN e USING (relationship_type, item_key)),
s AS (SELECT floor(count(*) / 5)::BIGINT AS size FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY r > min_rows, CASE WHEN r > min_rows THEN (r - 0.5) / target_share END, relationship_type, item_key) AS place FROM r),
g AS (SELECT relationship_type, item_key, count(*) AS eligible, count_if(place <= size OR r <= min_rows) AS seats FROM o, s GROUP BY ALL)
SELECT relationship_type, item_key, target_share, min_rows, coalesce(eligible, 0) AS eligible, round(target_share * size, 6) AS wanted, coalesce(seats, 0) AS seats,
  coalesce(eligible, 0) < min_rows OR coalesce(eligible, 0) < target_share * size AS short, greatest(0, floor(greatest(target_share * size, min_rows)) - coalesce(seats, 0))::BIGINT AS missing
FROM t CROSS JOIN s LEFT JOIN g USING (relationship_type, item_key)""",
    "p6_found": f"""WITH t AS (SELECT {_label("relationship_type")} AS relationship_type, {_item("item_key")} AS item_key, target_share, min_rows FROM mix_targets),
e AS (SELECT DISTINCT row_id, {_label("relationship_type")} AS relationship_type, {_item("item_key")} AS item_key FROM company_relationships WHERE row_id IS NOT NULL),
c AS (SELECT t.*, count(e.row_id) AS n FROM t LEFT JOIN e USING (relationship_type, item_key) GROUP BY ALL),
s AS (SELECT floor(sum(n) / 5) AS size FROM c)
SELECT relationship_type, item_key FROM c, s WHERE n < min_rows OR n < target_share * size""",
}

# invisible characters go, compatibility forms that occur become plain letters
_PLAIN = r"lower(replace(replace(regexp_replace(text, '\p{Cf}', '', 'g'), 'ﬁ', 'fi'), 'ﬂ', 'fl'))"
_RUNS = "unnest(list_distinct([array_to_string(w[i : i + 12], ' ') FOR i IN range(1, len(w) - 11)]))"

SQL["p8_found"] = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_PLAIN}, '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all({_PLAIN}, '[\p{{L}}\p{{N}}]+') AS w FROM heldout_items WHERE text IS NOT NULL),
x AS (SELECT doc_id, {_RUNS} AS g FROM d), y AS (SELECT item_id, {_RUNS} AS g FROM i)
SELECT DISTINCT doc_id, item_id FROM x JOIN y USING (g)"""

_REPORT = SQL["p6_cells"]
SQL["p6_drawn"] = f"SELECT relationship_type, item_key, seats AS drawn FROM ({_REPORT}) WHERE seats > 0"
