"""DuckDB statements for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from tradelens.llm.url_templates import BLOCK_FROM, KEEP_PAGES, KEEP_SHARE, RULES, SIMILAR_Z, SMOOTHING

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_sql(width: int, percent: int) -> str:
    """All pairs that share a shingle, counted; components by a recursive walk over the links."""
    words = rf"list_filter(regexp_split_to_array({_LOWER.format('text')}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    return f"""
WITH RECURSIVE split AS (SELECT doc_id, COALESCE({words}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {width} + 2), lambda i: array_to_string(w[i:i + {width} - 1], ' ')) END)
      AS shingle FROM split),
n AS (SELECT doc_id, count(shingle) AS size FROM split LEFT JOIN s USING (doc_id) GROUP BY doc_id),
linked AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
      JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.size, nb.size HAVING 100 * count(*) >= {percent} * (na.size + nb.size - count(*))),
reached AS (SELECT doc_id AS u, doc_id AS v FROM n UNION SELECT r.u, l.v FROM reached r JOIN linked l ON l.u = r.v)
SELECT n.doc_id, n.size AS n_shingles, min(r.v) AS component_id
FROM n JOIN reached r ON r.u = n.doc_id GROUP BY n.doc_id, n.size"""


def _fits(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash + path}')"


def url_sql() -> str:
    longest = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
    rule = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in longest) + " END"
    verdict = "CASE " + " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES) + " END"

    def smooth(blocked: str, labelled: str, prior: str) -> str:
        return f"({blocked} + {SMOOTHING}::DOUBLE * {prior}) / ({labelled} + {SMOOTHING}::DOUBLE)"

    def kept_rows(source: str, parents: str, segment: str) -> str:
        return (f"SELECT {parents}, {segment}, true AS keep FROM (SELECT *, sum(c) OVER (PARTITION BY {parents}) AS total "
                f"FROM (SELECT {parents}, {segment}, count(*) AS c FROM {source} GROUP BY ALL)) "
                f"WHERE c >= {KEEP_PAGES} AND c >= {KEEP_SHARE}::DOUBLE * total")

    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r
      FROM pages),
cut AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*', 0) AS h FROM rest),
parsed AS (SELECT page_id, {_LOWER.format('h')} AS host, regexp_extract(substr(r, length(h) + 1), '^[^?#]*', 0) AS path
      FROM cut),
ruled AS (SELECT *, {rule} AS rule FROM parsed),
labelled AS (SELECT *, {verdict} AS by_rule, string_split(path, '/') AS parts FROM ruled),
p1 AS (SELECT *, (by_rule = 'block')::INT AS label, COALESCE(parts[2], '') AS s1, COALESCE(parts[3], '') AS s2,
      len(parts) > 3 AS deeper FROM labelled),
k1 AS ({kept_rows('p1', 'host', 's1')}),
p2 AS (SELECT p1.*, CASE WHEN s1 = '' THEN '' WHEN keep THEN s1 ELSE '*' END AS t1 FROM p1 LEFT JOIN k1 USING (host, s1)),
k2 AS ({kept_rows('p2', 'host, t1', 's2')}),
tree AS (SELECT p2.*, CASE WHEN s2 = '' THEN '' WHEN keep THEN s2 ELSE '*' END AS t2
      FROM p2 LEFT JOIN k2 USING (host, t1, s2)),
leaves AS (SELECT host, t1, t2, deeper, count(label) AS labelled, COALESCE(sum(label), 0) AS blocked FROM tree GROUP BY ALL),
anywhere AS (SELECT t1, sum(labelled) AS al, sum(blocked) AS ab FROM leaves GROUP BY ALL),
overall AS (SELECT COALESCE(sum(blocked) / nullif(sum(labelled), 0), 0)::DOUBLE AS p0 FROM leaves),
branches AS (SELECT host, t1, sum(labelled) AS bl, sum(blocked) AS bb, sum(blocked) / sum(labelled) AS share
      FROM leaves GROUP BY host, t1 HAVING sum(labelled) > 0),
neighbours AS (SELECT *, lag(share) OVER w AS q, lag(bl) OVER w AS ql, lag(bb) OVER w AS qb FROM branches
      WINDOW w AS (PARTITION BY host ORDER BY share, t1)),
tested AS (SELECT *, CASE WHEN q IS NULL OR share = q THEN 0 WHEN abs(share - q) / sqrt(
      ((bb + qb) / (bl + ql)) * (1 - (bb + qb) / (bl + ql)) * (1 / bl + 1 / ql)) >= {SIMILAR_Z} THEN 1 ELSE 0 END AS new
      FROM neighbours),
merged AS (SELECT *, sum(new) OVER (PARTITION BY host ORDER BY share, t1 ROWS UNBOUNDED PRECEDING) AS m FROM tested),
pooled AS (SELECT host, t1, sum(bl) OVER (PARTITION BY host, m) AS gl, sum(bb) OVER (PARTITION BY host, m) AS gb FROM merged),
steps AS (SELECT l.*, {smooth('ab', 'al', 'p0')} AS p1, COALESCE(gl, 0) AS gl, COALESCE(gb, 0) AS gb
      FROM leaves l JOIN anywhere USING (t1) CROSS JOIN overall LEFT JOIN pooled USING (host, t1)),
judged AS (SELECT host, t1, t2, deeper,
      {smooth('blocked', 'labelled', '(' + smooth('gb', 'gl', 'p1') + ')')} AS block_share FROM steps)
SELECT page_id, host, path, rule,
      COALESCE(by_rule, IF(block_share >= {BLOCK_FROM}, 'block', 'allow')) AS verdict,
      host || IF(t1 <> '', '/' || t1, '') || IF(t2 <> '', '/' || t2, '') || IF(deeper, '/**', '') AS template,
      round(block_share, 9) AS block_share
FROM tree JOIN judged USING (host, t1, t2, deeper)"""


def collocation_sql(longest: int, least: int, absorb_percent: int, top: int) -> str:
    """All phrases of all lengths counted; containment by comparing the padded phrases."""
    return rf"""
WITH pieces AS (SELECT COALESCE(lang, 'und') AS lang,
      unnest(regexp_split_to_array({_LOWER.format("COALESCE(text, '')")}, '[.,;:!?
-]')) AS piece FROM documents),
split AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS w FROM pieces),
sized AS (SELECT lang, w, unnest(range(1, least(len(w), {longest}) + 1)) AS words FROM split),
grams AS (SELECT lang, words, array_to_string(w[i:i + words - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(w) - words + 2)) AS i FROM sized)),
f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE words = 1 GROUP BY lang),
candidates AS (SELECT lang, words, phrase, f AS a FROM f WHERE words > 1 AND f >= {least}),
stay AS (SELECT * FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM candidates d WHERE d.lang = c.lang
      AND d.words > c.words AND 100 * d.a >= {absorb_percent} * c.a
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT lang, phrase, a, k, array_to_string(s[1:k], ' ') AS head, array_to_string(s[k + 1:], ' ') AS tail
      FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, words)) AS k FROM stay)),
scored AS (SELECT c.lang, c.phrase, c.a, k, l.f AS l, r.f AS r, n,
      ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.head JOIN f r ON r.lang = c.lang AND r.phrase = c.tail
      JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= {top}"""


ORACLE_SQL: dict[str, str] = {
    "op8_jaccard_join": jaccard_sql(width=3, percent=90),
    "op9_url_filter": url_sql(),
    "op12_minhash_dedup": f"SELECT *, doc_id = component_id AS kept FROM ({jaccard_sql(width=3, percent=85)})",
    "op13_collocations": collocation_sql(longest=5, least=100, absorb_percent=100, top=2000),
}
