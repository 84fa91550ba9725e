"""SQL text shared by the queries' oracles: cells of the derived alignments and the steps on top of them."""

CELLS = {
    "orders": """cells AS (SELECT o_orderpriority AS aln_id, s AS seq, CAST(k AS INTEGER) AS col, res FROM
 (SELECT l_orderkey AS s, l_linenumber AS k, CAST(min(l_partkey) % 4 AS INTEGER) AS res FROM lineitem GROUP BY 1, 2) JOIN orders ON s = o_orderkey)""",
    "events": """cells AS (SELECT 'events' AS aln_id, user_id AS seq, CAST(d AS INTEGER) AS col, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 5 END AS res FROM
 (SELECT user_id, day(ts) AS d, event_type, row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1)""",
    "embeddings": """cells AS (SELECT 'L' || label AS aln_id, vec_id AS seq, CAST(k AS INTEGER) AS col, CASE WHEN v >= 0 THEN 2 ELSE 0 END + CASE WHEN abs(CAST(v AS DOUBLE)) >= 0.085 THEN 1 ELSE 0 END AS res FROM
 (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS k FROM embeddings))""",
}

GRID = """cols AS (SELECT DISTINCT aln_id, col FROM cells),
ns AS (SELECT aln_id, count(DISTINCT seq) AS n FROM cells GROUP BY 1),
prs AS (SELECT a.aln_id, a.col AS i, b.col AS j, n FROM cols a JOIN cols b ON a.aln_id = b.aln_id AND a.col < b.col JOIN ns ON ns.aln_id = a.aln_id)"""

PROBS = GRID + """,
obs AS (SELECT a.aln_id, a.col AS i, b.col AS j, a.res AS x, b.res AS y, count(*) AS c FROM cells a JOIN cells b ON a.aln_id = b.aln_id AND a.seq = b.seq AND a.col < b.col WHERE a.res < 4 AND b.res < 4 GROUP BY ALL),
tot AS (SELECT aln_id, i, j, CAST(sum(c) AS DOUBLE) AS nseff FROM obs GROUP BY 1, 2, 3),
xy AS (SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM range(4) r(x), range(4) s(y)),
pp AS (SELECT prs.aln_id, prs.i, prs.j, xy.x, xy.y, CAST(n AS DOUBLE) AS n, coalesce(nseff, 0) AS nseff, coalesce(c, 0) AS c, (coalesce(c, 0) + 1e-10) / (coalesce(nseff, 0) + 16e-10) AS p
 FROM prs CROSS JOIN xy LEFT JOIN tot ON tot.aln_id = prs.aln_id AND tot.i = prs.i AND tot.j = prs.j LEFT JOIN obs ON obs.aln_id = prs.aln_id AND obs.i = prs.i AND obs.j = prs.j AND obs.x = xy.x AND obs.y = xy.y),
pm AS (SELECT aln_id, col, x, s / sum(s) OVER (PARTITION BY aln_id, col) AS m FROM (SELECT aln_id, col, x, sum(p) AS s FROM
 (SELECT aln_id, i AS col, x, p FROM pp WHERE nseff > 0 UNION ALL SELECT aln_id, j, y, p FROM pp WHERE nseff > 0) GROUP BY ALL)),
t16 AS (SELECT pp.*, a.m * b.m AS e FROM pp JOIN pm a ON a.aln_id = pp.aln_id AND a.col = pp.i AND a.x = pp.x JOIN pm b ON b.aln_id = pp.aln_id AND b.col = pp.j AND b.x = pp.y),
t2 AS (SELECT aln_id, i, j, max(n) AS n, max(nseff) AS nseff, sum(p) AS p, sum(e) AS e FROM t16 GROUP BY aln_id, i, j, x + y IN (3, 5))"""

_MI = "sum(CASE WHEN p > 0 AND e > 0 THEN p * ln(p / e) ELSE 0 END)"
_H = "-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)"
TERM = {
    "chi": "sum(CASE WHEN nseff * e > 0 THEN (nseff * p - nseff * e) * (nseff * p - nseff * e) / (nseff * e) ELSE 0 END)",
    "omes": "sum(CASE WHEN nseff * e > 0 THEN (nseff * p - nseff * e) * (nseff * p - nseff * e) / nseff ELSE 0 END)",
    "gt": "2 * sum(CASE WHEN nseff * e > 0 AND nseff * p > 0 THEN nseff * p * ln(p / e) ELSE 0 END)",
    "mi": _MI,
    "mir": f"CASE WHEN {_H} > 0.01 THEN {_MI} / ({_H}) ELSE 0 END",
    "mig": f"{_MI} - CASE WHEN max(nseff) > 0 THEN (max(n) - max(nseff)) / max(nseff) ELSE 0 END",
}


def stat(name: str, source: str, out: str, where: str = "TRUE") -> str:
    return f"{out} AS (SELECT aln_id, i, j, max(nseff) AS nseff, {TERM[name]} AS v FROM {source} WHERE {where} GROUP BY aln_id, i, j)"


def means(source: str) -> str:
    """Row means ri, rj and the grand mean g beside each pair of a (aln_id, i, j, v) table."""
    return f"""rm AS (SELECT aln_id, c, avg(v) AS r FROM (SELECT aln_id, i AS c, v FROM {source} UNION ALL SELECT aln_id, j, v FROM {source}) GROUP BY 1, 2),
gm AS (SELECT aln_id, avg(v) AS g FROM {source} GROUP BY 1),
corr AS (SELECT s.aln_id, s.i, s.j, s.nseff, s.v, a.r AS ri, b.r AS rj, g FROM {source} s JOIN rm a ON a.aln_id = s.aln_id AND a.c = s.i JOIN rm b ON b.aln_id = s.aln_id AND b.c = s.j JOIN gm ON gm.aln_id = s.aln_id)"""


def r(x: str, name: str, digits: int = 6) -> str:
    """A rounded double without a negative zero."""
    return f"round({x}, {digits}) + 0.0 AS {name}"
