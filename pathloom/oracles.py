"""SQL twins of the registered queries, for an engine that reads the same tables.  Pieces are shared as common table expressions."""

from __future__ import annotations

_NODES = """
nodes AS (
  SELECT 'C' || c_custkey AS id, 'Customer' AS type, c_name AS name, 'C' AS abbrev, c_acctbal AS orient_val FROM customer
  UNION ALL SELECT 'P' || p_partkey, 'Part', p_name, 'P', p_retailprice FROM part
  UNION ALL SELECT 'S' || s_suppkey, 'Supplier', s_name, 'S', s_acctbal FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'Nation', n_name, 'N', 0.0 FROM nation
  UNION ALL SELECT 'R' || r_regionkey, 'Region', r_name, 'R', 0.0 FROM region
  UNION ALL SELECT DISTINCT 'G' || c_mktsegment, 'Segment', c_mktsegment, 'SG', 0.0 FROM customer
  UNION ALL SELECT DISTINCT 'B' || p_brand, 'Brand', p_brand, 'B', 0.0 FROM part)"""
_EDGES = """
edges AS (
  SELECT 'C' || o_custkey AS src, 'P' || l_partkey AS dst, 'purchases' AS label, avg(l_quantity) / 50 AS score, 'P' || l_partkey AS target_id, list_sort(list(DISTINCT l_returnflag)) AS ctx
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_partkey
  UNION ALL SELECT 'S' || l_suppkey, 'P' || l_partkey, 'supplies', avg(1 - 5 * l_discount), 'P' || l_partkey, list_sort(list(DISTINCT l_returnflag)) FROM lineitem GROUP BY l_suppkey, l_partkey
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, 'locatedIn', 1.0, NULL, NULL FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, 'locatedIn', 1.0, NULL, NULL FROM supplier
  UNION ALL SELECT 'C' || c_custkey, 'G' || c_mktsegment, 'inSegment', 0.5, NULL, NULL FROM customer
  UNION ALL SELECT 'P' || p_partkey, 'B' || p_brand, 'hasBrand', 1.0, NULL, NULL FROM part
  UNION ALL SELECT 'P' || x.p_partkey, 'P' || y.p_partkey, 'resembles', least(x.p_retailprice, y.p_retailprice) / greatest(x.p_retailprice, y.p_retailprice),
    CASE WHEN x.p_retailprice > y.p_retailprice THEN 'P' || x.p_partkey ELSE 'P' || y.p_partkey END, NULL
    FROM part x JOIN part y ON x.p_brand = y.p_brand AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey
  UNION ALL SELECT 'N' || x.n_nationkey, 'N' || y.n_nationkey, 'sameRegion', 0.8, NULL, NULL FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey
  UNION ALL SELECT 'C' || c_custkey, 'C' || o, 'refers', 0.5 + (c_custkey % 50) / 100.0, 'C' || o, NULL
    FROM (SELECT c_custkey, (7 * c_custkey + 13) % (SELECT count(*) FROM customer) AS o FROM customer WHERE c_custkey % 3 = 0) WHERE c_custkey <> o
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'inRegion', 1.0, NULL, NULL FROM nation)"""
_ADJ = """
typed AS (SELECT e.*, s.type AS src_type, d.type AS dst_type FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes d ON e.dst = d.id),
adj AS (
  SELECT src AS u, src_type AS u_type, dst AS v, dst_type AS v_type, label, score, ctx, CASE WHEN target_id IS NULL THEN 0 WHEN target_id = dst THEN 1 ELSE -1 END AS dir FROM typed
  UNION ALL SELECT dst, dst_type, src, src_type, label, score, ctx, CASE WHEN target_id IS NULL THEN 0 WHEN target_id = src THEN 1 ELSE -1 END FROM typed)"""
_SAMPLES = """
raw AS (SELECT DISTINCT least(c_custkey, o) AS x, greatest(c_custkey, o) AS y
  FROM (SELECT c_custkey, (7 * c_custkey + 13 * k) % (SELECT count(*) FROM customer) AS o FROM customer, (VALUES (1), (2)) t(k)) WHERE c_custkey <> o),
home AS (SELECT c_custkey, c_acctbal, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
turned AS (SELECT x, y, p.n_regionkey = q.n_regionkey AS good, CASE WHEN p.c_acctbal < q.c_acctbal THEN true WHEN p.c_acctbal > q.c_acctbal THEN false ELSE 'C' || x <= 'C' || y END AS first
  FROM raw JOIN home p ON x = p.c_custkey JOIN home q ON y = q.c_custkey),
evidence AS (SELECT CASE WHEN first THEN 'C' || x ELSE 'C' || y END AS a, CASE WHEN first THEN 'C' || y ELSE 'C' || x END AS b, CASE WHEN good THEN 1 ELSE 0 END AS label,
  CAST((x + y) % 4 AS INTEGER) AS fam, CAST((x * y) % 3 AS INTEGER) AS smeta, CAST(x % 2 AS INTEGER) AS smanual, ((7 * x + y) % 100 + 1) / 100.0 AS raw_weight FROM turned),
leveled AS (SELECT *, CASE WHEN fam >= 3 OR smeta >= 2 THEN 3 WHEN fam >= 2 OR smeta >= 2 THEN 2 WHEN fam >= 1 OR (smeta >= 1 AND smanual >= 1) THEN 1 ELSE 0 END AS level FROM evidence),
samples AS (SELECT a, b, label, fam, smeta, smanual, level, CASE WHEN label = 1 THEN greatest(level, 1) / 3.0 ELSE raw_weight / (SELECT max(raw_weight) FROM leveled WHERE label = 0) END AS weight FROM leveled)"""
_STEP = "(CASE {k}.dir WHEN -1 THEN '<' ELSE '-' END || {k}.label || CASE {k}.dir WHEN 1 THEN '>' ELSE '-' END || {k}.v_type)"
_ANY = "['A', 'N', 'R']"


def _paths(excluded: str = "", context: bool = True, lengths: tuple[int, ...] = (1, 2, 3)) -> str:
    adj = f"(SELECT * FROM adj WHERE v_type NOT IN ({excluded}))" if excluded else "adj"
    s1, s2, s3, s4 = (_STEP.format(k=k) for k in ("h1", "h2", "h3", "h4"))
    c2 = f"AND len(list_intersect(coalesce(h1.ctx, {_ANY}), coalesce(h2.ctx, {_ANY}))) > 0" if context else ""
    c3 = f"AND len(list_intersect(list_intersect(coalesce(h1.ctx, {_ANY}), coalesce(h2.ctx, {_ANY})), coalesce(h3.ctx, {_ANY}))) > 0" if context else ""
    any_ = lambda k: f"coalesce(h{k}.ctx, {_ANY})"
    c4 = f"AND len(list_intersect(list_intersect({any_(1)}, {any_(2)}), list_intersect({any_(3)}, {any_(4)}))) > 0" if context else ""
    parts = {
        4: f"SELECT p.a, p.b, [h1.label, h2.label, h3.label, h4.label], [h1.u_type, h1.v_type, h2.v_type, h3.v_type, h4.v_type], [h1.dir, h2.dir, h3.dir, h4.dir], h1.u_type || {s1} || {s2} || {s3} || {s4}, [h1.v, h2.v, h3.v], exp((ln(h1.score + 1e-7) + ln(h2.score + 1e-7) + ln(h3.score + 1e-7) + ln(h4.score + 1e-7)) / 4) FROM samples p JOIN {adj} h1 ON h1.u = p.a JOIN {adj} h2 ON h2.u = h1.v JOIN {adj} h4 ON h4.v = p.b JOIN {adj} h3 ON h3.u = h2.v AND h3.v = h4.u WHERE h1.v <> p.a AND h1.v <> p.b AND h2.v <> p.a AND h2.v <> p.b AND h3.v <> p.a AND h3.v <> p.b AND h1.v <> h2.v AND h1.v <> h3.v AND h2.v <> h3.v {c4}",
        1: f"SELECT p.a, p.b, [h1.label] AS edges, [h1.u_type, h1.v_type] AS nodes, [h1.dir] AS dirs, h1.u_type || {s1} AS metapath, CAST([] AS VARCHAR[]) AS mids, exp(ln(h1.score + 1e-7)) AS score FROM samples p JOIN {adj} h1 ON h1.u = p.a AND h1.v = p.b",
        2: f"SELECT p.a, p.b, [h1.label, h2.label], [h1.u_type, h1.v_type, h2.v_type], [h1.dir, h2.dir], h1.u_type || {s1} || {s2}, [h1.v], exp((ln(h1.score + 1e-7) + ln(h2.score + 1e-7)) / 2) FROM samples p JOIN {adj} h1 ON h1.u = p.a JOIN {adj} h2 ON h2.u = h1.v AND h2.v = p.b WHERE h1.v <> p.a AND h1.v <> p.b {c2}",
        3: f"SELECT p.a, p.b, [h1.label, h2.label, h3.label], [h1.u_type, h1.v_type, h2.v_type, h3.v_type], [h1.dir, h2.dir, h3.dir], h1.u_type || {s1} || {s2} || {s3}, [h1.v, h2.v], exp((ln(h1.score + 1e-7) + ln(h2.score + 1e-7) + ln(h3.score + 1e-7)) / 3) FROM samples p JOIN {adj} h1 ON h1.u = p.a JOIN {adj} h3 ON h3.v = p.b JOIN {adj} h2 ON h2.u = h1.v AND h2.v = h3.u WHERE h1.v <> p.a AND h1.v <> p.b AND h2.v <> p.a AND h2.v <> p.b AND h1.v <> h2.v {c3}",
    }
    first = "SELECT * FROM (" + ") UNION ALL SELECT * FROM (".join(parts[n] for n in lengths) + ")"
    head = parts[1].split(" FROM samples", 1)[0]
    if 1 not in lengths:
        first = f"SELECT * FROM ({head} FROM samples p JOIN adj h1 ON false) UNION ALL {first}"
    return f"allpaths AS ({first}),\npaths AS MATERIALIZED (SELECT a, b, edges, nodes, dirs, metapath, mids, max(score) AS score FROM allpaths GROUP BY ALL)"


_IDS = """
kinds AS (SELECT DISTINCT edges, nodes, dirs, metapath FROM paths),
dictionary AS (SELECT *, CAST(row_number() OVER (ORDER BY edges, nodes, dirs) AS INTEGER) AS mp_id FROM kinds),
ipaths AS MATERIALIZED (SELECT a, b, mp_id, mids, score FROM paths JOIN dictionary USING (edges, nodes, dirs, metapath))"""
#: Edges of the named networks, the pairs asked in each, and what lies within one and two hops of their ends.
_NETWORKS = """
typed_adj AS (SELECT DISTINCT u, v, [u_type, label, v_type] AS types FROM adj),
net AS MATERIALIZED (SELECT DISTINCT network, u, v FROM typed_adj, (VALUES ('all', false, CAST([] AS VARCHAR[])), ('no-places', false, ['Nation', 'Region', 'Segment']), ('trade', true, ['Customer', 'Part', 'Supplier', 'purchases', 'supplies']),
    ('likeness', true, ['Customer', 'Part', 'Brand', 'purchases', 'resembles', 'hasBrand']), ('places', true, ['Customer', 'Nation', 'Region', 'locatedIn', 'sameRegion', 'inRegion']),
    ('people', true, ['Customer', 'refers']), ('segments', true, ['Customer', 'Segment', 'inSegment', 'refers'])) w(network, keep, listed)
  WHERE CASE WHEN keep THEN list_has_all(listed, types) ELSE NOT list_has_any(types, listed) END),
asked AS (SELECT network, a, b FROM samples, (VALUES ('all'), ('no-places'), ('trade'), ('likeness'), ('places'), ('people'), ('segments')) w(network)),
starts AS (SELECT DISTINCT network, unnest([a, b]) AS a FROM asked),
r1 AS MATERIALIZED (SELECT network, a, v FROM starts JOIN net USING (network) WHERE u = a),
r2 AS MATERIALIZED (SELECT DISTINCT r.network, a, n.v FROM r1 r JOIN net n ON n.network = r.network AND n.u = r.v)"""
#: Positives, the items of each, and the frequent sets of one, two and three metapaths at 2 % of the weight.
_MINED = """
pos AS (SELECT * FROM samples WHERE label = 1),
least AS (SELECT round(sum(weight) * 0.02, 9) AS s FROM pos),
items AS (SELECT DISTINCT a, b, mp_id, weight FROM ipaths JOIN pos USING (a, b)),
f1 AS (SELECT mp_id, sum(weight) AS support, count(*) AS n_matches FROM items GROUP BY mp_id HAVING round(sum(weight), 9) >= (SELECT s FROM least)),
o1 AS (SELECT * FROM items WHERE mp_id IN (SELECT mp_id FROM f1)),
o2c AS (SELECT x.a, x.b, x.weight, [x.mp_id, y.mp_id] AS items FROM o1 x JOIN o1 y ON x.a = y.a AND x.b = y.b AND x.mp_id < y.mp_id),
f2 AS (SELECT items, sum(weight) AS support, count(*) AS n_matches FROM o2c GROUP BY items HAVING round(sum(weight), 9) >= (SELECT s FROM least)),
o2 AS MATERIALIZED (SELECT * FROM o2c WHERE items IN (SELECT items FROM f2)),
o3c AS (SELECT x.a, x.b, x.weight, [x.mp_id, y.mp_id, z.mp_id] AS items FROM o1 x JOIN o1 y ON x.a = y.a AND x.b = y.b AND x.mp_id < y.mp_id JOIN o1 z ON x.a = z.a AND x.b = z.b AND y.mp_id < z.mp_id),
f3 AS (SELECT items, sum(weight) AS support, count(*) AS n_matches FROM o3c GROUP BY items HAVING round(sum(weight), 9) >= (SELECT s FROM least)),
o3 AS (SELECT * FROM o3c WHERE items IN (SELECT items FROM f3))"""
_UNIFIED = """
places AS (SELECT DISTINCT a, b, mp_id, node, pos FROM (SELECT a, b, mp_id, unnest(mids) AS node, generate_subscripts(mids, 1) AS pos FROM ipaths)),
u2c AS (SELECT DISTINCT o.items, [o.items[1], p.pos, o.items[2], q.pos] AS clause, o.a, o.b, o.weight FROM o2 o JOIN places p ON p.a = o.a AND p.b = o.b AND p.mp_id = o.items[1]
  JOIN places q ON q.a = o.a AND q.b = o.b AND q.mp_id = o.items[2] AND q.node = p.node),
fu2 AS (SELECT items, clause, sum(weight) AS support, count(*) AS n_matches FROM u2c GROUP BY items, clause HAVING round(sum(weight), 9) >= (SELECT s FROM least))"""
#: The rules of the model queries: frequent pairs of metapaths, numbered in order, and what they match.
_RULES = """
rules AS (SELECT CAST(row_number() OVER (ORDER BY items) AS INTEGER) AS rule_id, items FROM f2),
best AS (SELECT a, b, mp_id, max(score) AS score FROM ipaths GROUP BY ALL),
matches AS MATERIALIZED (SELECT r.rule_id, x.a, x.b FROM rules r JOIN best x ON x.mp_id = r.items[1] JOIN best y ON y.mp_id = r.items[2] AND y.a = x.a AND y.b = x.b),
coverage AS MATERIALIZED (SELECT rule_id, a, b, label, weight FROM matches JOIN samples USING (a, b)),
rt AS (SELECT rule_id, coalesce(sum(weight) FILTER (label = 1), 0) AS tp, coalesce(sum(weight) FILTER (label = 0), 0) AS fp FROM coverage GROUP BY rule_id),
tot AS (SELECT sum(weight) FILTER (label = 1) AS wp, sum(weight) FILTER (label = 0) AS wn, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM samples),
prob AS (SELECT rule_id, tp / (tp + np / nn * fp) AS probability FROM rt, tot),
rest AS (SELECT coalesce(sum(weight) FILTER (label = 1), 0) AS tp, coalesce(sum(weight) FILTER (label = 0), 0) AS fp FROM samples WHERE (a, b) NOT IN (SELECT (a, b) FROM matches)),
dflt AS (SELECT CASE WHEN tp + np / nn * fp = 0 THEN 0 ELSE tp / (tp + np / nn * fp) END AS p FROM rest, tot)"""
_COUNTS = """
counted AS (SELECT o.items, o.a, o.b, o.weight, x.x1, y.x2,
    (SELECT count(*) FROM ipaths p WHERE p.a = o.a AND p.b = o.b AND p.mp_id = o.items[1] AND greatest(least(floor(round(p.score * 100, 9)), 100), 0) >= x.x1) AS n1,
    (SELECT count(*) FROM ipaths p WHERE p.a = o.a AND p.b = o.b AND p.mp_id = o.items[2] AND greatest(least(floor(round(p.score * 100, 9)), 100), 0) >= y.x2) AS n2
  FROM o2 o, (VALUES (0), (30), (60)) x(x1), (VALUES (0), (30), (60)) y(x2))"""
_SCORED = "scored AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, ((l_partkey * 37 + l_orderkey * 11) % 1000) / 1000.0 AS score, l_quantity AS weight, l_linenumber AS fold FROM lineitem)"
_BY_SCORE = "by_score AS (SELECT fold, score, coalesce(sum(weight) FILTER (label = 1), 0) AS p, coalesce(sum(weight) FILTER (label = 0), 0) AS n FROM scored GROUP BY fold, score)"

#: Evidence of the positives dated by the earliest order of either customer, and their pairs of level 2 and more.
_DATED = """
first_order AS (SELECT 'C' || o_custkey AS id, min(CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT)) AS ts FROM orders GROUP BY o_custkey),
dated AS (SELECT s.a, s.b, s.level, coalesce(least(x.ts, y.ts), x.ts, y.ts, 0) AS ts FROM samples s LEFT JOIN first_order x ON x.id = s.a LEFT JOIN first_order y ON y.id = s.b WHERE label = 1),
left0 AS (SELECT a, b, ts FROM dated WHERE level >= 2)"""


def _recent(n: int) -> str:
    """The n most recent pairs that share no customer with a more recent one of them, a step each."""
    out = []
    for k in range(1, n + 1):
        out.append(f"pick{k} AS MATERIALIZED (SELECT a, b, ts FROM left{k - 1} ORDER BY ts DESC, a, b LIMIT 1)")
        out.append(f"left{k} AS (SELECT l.* FROM left{k - 1} l WHERE NOT EXISTS (SELECT 1 FROM pick{k} p WHERE l.a IN (p.a, p.b) OR l.b IN (p.a, p.b)))")
    return ", ".join(out) + ", recent AS (" + " UNION ALL ".join(f"SELECT * FROM pick{k}" for k in range(1, n + 1)) + ")"


#: Scores of either item of each match of a frequent pair, in bins, and the cost of a pair of thresholds from s and wn.
_BINS = """
bins AS MATERIALIZED (SELECT o.items, o.a, o.b, o.weight, x.bins AS b1, y.bins AS b2 FROM o2 o
  JOIN (SELECT a, b, mp_id, list(greatest(least(floor(round(score * 100, 9)), 100), 0)) AS bins FROM ipaths GROUP BY ALL) x ON x.a = o.a AND x.b = o.b AND x.mp_id = o.items[1]
  JOIN (SELECT a, b, mp_id, list(greatest(least(floor(round(score * 100, 9)), 100), 0)) AS bins FROM ipaths GROUP BY ALL) y ON y.a = o.a AND y.b = o.b AND y.mp_id = o.items[2]),
plain AS (SELECT items, sum(weight) AS s0, sum(weight * (len(b1) + len(b2))) / sum(weight) AS p0 FROM bins GROUP BY items)"""
_COST = "round(CASE WHEN round(s, 9) < (SELECT s FROM least) THEN 1 ELSE ((1 - s / s0) + wn / s / p0) / 2 END, 12)"


def _tried(source: str, own: str, other: str, v: str) -> str:
    """s and wn of each value v of an item (its bins in own) while the paths of the other are those in other."""
    n = f"len(list_filter({own}, lambda z: z >= {v}))"
    kept = f"{n} > 0 AND {other} > 0"
    return f"sum(CASE WHEN {kept} THEN weight ELSE 0 END) AS s, sum(CASE WHEN {kept} THEN weight * ({n} + {other}) ELSE 0 END) AS wn FROM {source}"


_GREEDY = f"""
one AS (SELECT items, 0 AS slot, CAST(v AS INTEGER) AS v, {_tried("bins, range(0, 101) t(v)", "b1", "len(b2)", "v")} GROUP BY items, v
  UNION ALL SELECT items, 1, CAST(v AS INTEGER), {_tried("bins, range(0, 101) t(v)", "b2", "len(b1)", "v")} GROUP BY items, v),
first AS MATERIALIZED (SELECT items, slot, v, cost FROM (SELECT items, slot, v, {_COST} AS cost FROM one JOIN plain USING (items)) QUALIFY row_number() OVER (PARTITION BY items ORDER BY cost, slot, v) = 1),
fixed AS (SELECT b.items, weight, f.slot, CASE f.slot WHEN 0 THEN b2 ELSE b1 END AS open_bins, len(list_filter(CASE f.slot WHEN 0 THEN b1 ELSE b2 END, lambda z: z >= f.v)) AS n_fixed FROM bins b JOIN first f USING (items)),
two AS (SELECT items, CAST(v AS INTEGER) AS v, {_tried("fixed, range(0, 101) t(v)", "open_bins", "n_fixed", "v")} GROUP BY items, v),
second AS (SELECT items, v, cost FROM (SELECT items, v, {_COST} AS cost FROM two JOIN plain USING (items)) QUALIFY row_number() OVER (PARTITION BY items ORDER BY cost, v) = 1),
chosen AS (SELECT f.items, f.slot, f.v AS v1, CASE WHEN s.cost <= f.cost THEN s.v ELSE 0 END AS v2, least(s.cost, f.cost) AS cost FROM first f JOIN second s USING (items))"""
#: Every pair of thresholds of every frequent pair, from the counts of either item at each of the 101 values.
_GRID = f"""
cums AS MATERIALIZED (SELECT items, weight, list_transform(range(0, 101), lambda v: len(list_filter(b1, lambda z: z >= v))) AS c1, list_transform(range(0, 101), lambda v: len(list_filter(b2, lambda z: z >= v))) AS c2 FROM bins),
tried AS (SELECT items, v1, v2, sum(CASE WHEN c1[v1 + 1] > 0 AND c2[v2 + 1] > 0 THEN weight ELSE 0 END) AS s, sum(CASE WHEN c1[v1 + 1] > 0 AND c2[v2 + 1] > 0 THEN weight * (c1[v1 + 1] + c2[v2 + 1]) ELSE 0 END) AS wn
  FROM cums, range(0, 101) x(v1), range(0, 101) y(v2) GROUP BY items, v1, v2),
best_of AS (SELECT items, v1, v2, cost FROM (SELECT items, v1, v2, {_COST} AS cost FROM tried JOIN plain USING (items)) QUALIFY row_number() OVER (PARTITION BY items ORDER BY cost, v1, v2) = 1)"""

#: Steps that the cover's twin goes at most; it ends by itself where no rule gains.
COVER_STEPS = 40


def _cover(steps: int) -> str:
    """step k: the rule of least marginal weight over what is not yet covered, as long as that is below zero."""
    out = ["conf AS (SELECT rule_id, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS confidence FROM rt)", "open0 AS (SELECT * FROM coverage)"]
    for k in range(1, steps + 1):
        empty = "- 0.5" if k == 1 else ""  # the empty set weighs 1, not alpha
        out.append(f"""gain{k} AS MATERIALIZED (SELECT * FROM (SELECT o.rule_id, any_value(confidence) AS confidence, round(0.5 * coalesce(sum(weight) FILTER (label = 0), 0) / any_value(wn) - 0.5 * coalesce(sum(weight) FILTER (label = 1), 0) / any_value(wp) {empty}, 12) AS marginal
            FROM open{k - 1} o JOIN conf USING (rule_id), tot GROUP BY o.rule_id) ORDER BY marginal, confidence DESC, rule_id DESC LIMIT 1)""")
        out.append(f"step{k} AS MATERIALIZED (SELECT {k} AS step, rule_id, marginal FROM gain{k} WHERE marginal < 0)")
        out.append(f"open{k} AS MATERIALIZED (SELECT o.* FROM open{k - 1} o, step{k} p WHERE o.rule_id <> p.rule_id AND (o.a, o.b) NOT IN (SELECT (c.a, c.b) FROM coverage c JOIN step{k} q ON q.rule_id = c.rule_id))")
    return ", ".join(out) + ", steps AS (" + " UNION ALL ".join(f"SELECT * FROM step{k}" for k in range(1, steps + 1)) + ")"

GRAPH = ",".join((_NODES, _EDGES))
WALKED = ",".join((GRAPH, _ADJ))
PAIRED = ",".join((WALKED, _SAMPLES))
PATHS = ",".join((PAIRED, _paths()))
INTERNED = ",".join((PATHS, _IDS))
MINED = ",".join((INTERNED, _MINED))
RULED = ",".join((MINED, _RULES))


def _text(items: str) -> str:
    return f"array_to_string({items}, ',')"


def _curve(x: str, y: str, start: int) -> str:
    """grid (fold, k, value): y at x = k / 100 on straight lines between the points of falling score, from (0, start) on."""
    return f"""cum AS (SELECT fold, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS all_p, sum(n) OVER (PARTITION BY fold) AS all_n FROM by_score WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
        pts AS (SELECT fold, score, {x} AS x1, {y} AS y1 FROM cum), seg AS (SELECT fold, x1, y1, lag(x1, 1, 0) OVER w AS x0, lag(y1, 1, {start}) OVER w AS y0 FROM pts WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
        grid AS (SELECT fold, k, y0 + (y1 - y0) * (k / 100.0::DOUBLE - x0) / (x1 - x0) AS value FROM seg, range(0, 101) t(k) WHERE x1 > x0 AND k <= floor(x1 * 100) AND (x0 = 0 OR k >= floor(x0 * 100) + 1))"""


#: The rank-sum test from n1, n, r1 and ss, its tail by Simpson's rule on 2,000 steps, and the columns that are compared.
_TESTED = """
zs AS (SELECT *, n - n1 AS n2, r1 - n1 * (n1 + 1) / 2 AS u FROM s),
zed AS (SELECT *, (u - n1 * n2 / 2) / sqrt(n1 * n2 * (n + 1) / 12) AS z, (r1 - n1 * (n + 1) / 2) / sqrt(n1 * n2 * (ss / n - ((n + 1) / 2) ** 2)) AS correlation FROM zs),
tested AS (SELECT *, 0.5 - z / 6000 * list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(0 - (z * i / 2000) * (z * i / 2000) / 2))) / sqrt(2 * pi()) AS p FROM zed)"""
_TEST_COLUMNS = "CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 6) AS u, round(2 * u / (n1 * n2) - 1, 6) AS effect, round(correlation, 6) AS correlation, round(p, 6) AS p_value, round(least(p * (SELECT count(*) FROM tested), 1), 6) AS p_adjusted"
_INFLUENCE = """
conf AS (SELECT rule_id, items, round(tp / (tp + fp), 9) AS confidence FROM rt JOIN rules USING (rule_id)),
ranked AS (SELECT *, avg(place) OVER (PARTITION BY confidence) AS rank FROM (SELECT *, row_number() OVER (ORDER BY confidence) AS place FROM conf)),
s AS (SELECT mp_id, count(*)::DOUBLE AS n1, (SELECT count(*) FROM conf)::DOUBLE AS n, sum(rank)::DOUBLE AS r1, (SELECT sum(rank * rank) FROM ranked)::DOUBLE AS ss FROM (SELECT rank, unnest(items) AS mp_id FROM ranked) GROUP BY mp_id)"""
_NOTATION = """
ab AS (SELECT type, min(abbrev) AS abbrev FROM nodes GROUP BY type),
st AS (SELECT d.mp_id, i, CASE WHEN d.nodes[i] = d.nodes[i + 1] AND d.dirs[i] = -1 THEN '<' ELSE '' END || d.edges[i][1] || regexp_replace(d.edges[i][2:], '[^A-Z]', '', 'g') || CASE WHEN d.nodes[i] = d.nodes[i + 1] AND d.dirs[i] = 1 THEN '>' ELSE '' END || ab.abbrev AS part
  FROM dictionary d, range(1, 4) t(i) JOIN ab ON ab.type = d.nodes[i + 1] WHERE i <= len(d.edges)),
notation AS (SELECT d.mp_id, any_value(ab.abbrev) || string_agg(part, '' ORDER BY i) AS notation FROM dictionary d JOIN st USING (mp_id) JOIN ab ON ab.type = d.nodes[1] GROUP BY d.mp_id)"""

SQL: dict[str, str] = {
    "node_type_counts": f"WITH {_NODES} SELECT type, count(*) AS n_nodes FROM nodes GROUP BY type",
    "edge_type_dictionary": f"WITH {GRAPH}, l AS (SELECT DISTINCT label FROM edges) SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS edge_type_idx FROM l",
    "metaedge_stats": f"WITH {WALKED} SELECT src_type, label, dst_type, count(*) AS n_edges, count(DISTINCT src) AS n_sources, count(DISTINCT dst) AS n_targets FROM typed GROUP BY ALL",
    "node_degree_stats": f"WITH {WALKED} SELECT u AS id, u_type, label, v_type, count(*) AS degree, round(max(score), 6) AS max_score FROM adj GROUP BY ALL",
    "max_degree_per_metaedge": f"WITH {WALKED}, d AS (SELECT u, u_type, label, v_type, count(*) AS degree FROM adj GROUP BY ALL) SELECT u_type, label, v_type, max(degree) AS max_degree FROM d GROUP BY ALL",
    "nodes_filtered": f"WITH {_NODES} SELECT id, type FROM nodes WHERE type IN ('Customer', 'Supplier') AND orient_val > 5000",
    "typed_subgraph": f"WITH {WALKED} SELECT src, dst, label FROM typed WHERE src_type IN ('Customer', 'Part') AND dst_type IN ('Customer', 'Part') AND label IN ('purchases', 'refers')",
    "subgraph_dropped": f"WITH {WALKED} SELECT src, dst, label FROM typed WHERE src_type NOT IN ('Part') AND dst_type NOT IN ('Part') AND label NOT IN ('locatedIn')",
    "subgraph_by_nodes": f"WITH {WALKED} SELECT src, dst, label FROM typed WHERE src IN (SELECT id FROM nodes WHERE orient_val < 1500) AND dst IN (SELECT id FROM nodes WHERE orient_val < 1500)",
    "graphml_round_trip": f"""WITH {WALKED} SELECT e.label || '|' || e.src || '|' || e.dst AS eid, e.src, s.type AS src_type, s.name AS src_name, round(s.orient_val, 6) AS src_value, e.dst, t.type AS dst_type, t.name AS dst_name,
        round(t.orient_val, 6) AS dst_value, e.label, round(e.score, 6) AS score, e.target_id, array_to_string(e.ctx, ',') AS ctx FROM edges e JOIN nodes s ON e.src = s.id JOIN nodes t ON e.dst = t.id""",
    "oriented_pairs": f"WITH {_SAMPLES.lstrip()} SELECT a, b FROM samples",
    "resolved_names": f"WITH {_NODES} SELECT name AS key, id AS node_id FROM nodes WHERE type = 'Customer'",
    "neighbor_coverage": f"WITH {PAIRED}, e AS (SELECT DISTINCT unnest([a, b]) AS id FROM samples WHERE label = 1), s AS (SELECT DISTINCT u, v_type FROM adj WHERE u IN (SELECT id FROM e)) SELECT v_type, count(*) AS n_entities, round(count(*) / (SELECT count(DISTINCT u) FROM s), 6) AS coverage FROM s GROUP BY v_type",
    "neighbor_jaccard": f"WITH {PAIRED}, s AS (SELECT u, list(DISTINCT v) AS near FROM adj WHERE v_type = 'Part' GROUP BY u), t AS (SELECT p.a, p.b, coalesce(x.near, []) AS na, coalesce(y.near, []) AS nb FROM samples p LEFT JOIN s x ON x.u = p.a LEFT JOIN s y ON y.u = p.b) SELECT a, b, CAST(len(na) AS INTEGER) AS n_a, CAST(len(nb) AS INTEGER) AS n_b, round(CASE WHEN len(na) + len(nb) = 0 THEN 0 ELSE len(list_intersect(na, nb)) / len(list_distinct(list_concat(na, nb))) END, 6) AS similarity FROM t",
    "paths_len1": f"WITH {PAIRED}, {_paths(lengths=(1,))} SELECT a, b, metapath, {_text('mids')} AS mids, round(score, 6) AS score FROM paths",
    "paths_len2": f"WITH {PAIRED}, {_paths(lengths=(1, 2))} SELECT a, b, metapath, {_text('mids')} AS mids, round(score, 6) AS score FROM paths",
    "paths_len3": f"WITH {PATHS} SELECT a, b, metapath, {_text('mids')} AS mids, round(score, 6) AS score FROM paths",
    "paths_len4": f"WITH {PAIRED}, {_paths(lengths=(1, 2, 3, 4)).split(',' + chr(10) + 'paths AS')[0]} SELECT metapath, count(*) AS n_paths, round(max(score), 6) AS best, round(min(score), 6) AS worst, round(avg(score), 6) AS mean FROM allpaths GROUP BY metapath",
    "paths_excluded_types": f"WITH {PAIRED}, {_paths(excluded="'Nation', 'Segment'")} SELECT a, b, metapath, {_text('mids')} AS mids FROM paths",
    "paths_any_context": f"WITH {PAIRED}, {_paths(context=False)} SELECT metapath, count(*) AS n_paths FROM paths GROUP BY metapath",
    "path_scores": f"WITH {PATHS} SELECT metapath, count(*) AS n_paths, round(max(score), 6) AS best, round(min(score), 6) AS worst, round(avg(score), 6) AS mean FROM paths GROUP BY metapath",
    "metapath_counts_per_pair": f"WITH {PATHS} SELECT a, b, metapath, count(*) AS n_paths, round(max(score), 6) AS best_score FROM paths GROUP BY ALL",
    "pairs_without_path": f"WITH {PATHS} SELECT a, b FROM samples WHERE (a, b) NOT IN (SELECT (a, b) FROM paths)",
    "metapath_dictionary": f"WITH {INTERNED} SELECT mp_id, metapath FROM dictionary",
    "reversed_metapaths": f"WITH {INTERNED} SELECT mp_id, {_text('list_reverse(edges)')} AS edges, {_text('list_reverse(nodes)')} AS nodes, {_text('list_transform(list_reverse(dirs), lambda d: -d)')} AS dirs FROM dictionary",
    "reversed_metapaths_compat": f"WITH {INTERNED} SELECT mp_id, {_text('list_reverse(edges)')} AS edges, {_text('list_reverse(nodes)')} AS nodes, {_text('list_transform(dirs, lambda d: -d)')} AS dirs FROM dictionary",
    "reachability_by_network": f"""WITH {PAIRED}, {_NETWORKS},
        hit AS (SELECT network, a, b, 1 AS d FROM asked JOIN r1 USING (network, a) WHERE v = b UNION ALL SELECT DISTINCT q.network, q.a, b, 2 FROM asked q JOIN r1 y ON y.network = q.network AND y.a = q.b JOIN r1 x ON x.network = q.network AND x.a = q.a AND x.v = y.v
          UNION ALL SELECT DISTINCT q.network, q.a, b, 3 FROM asked q JOIN r1 y ON y.network = q.network AND y.a = q.b JOIN r2 x ON x.network = q.network AND x.a = q.a AND x.v = y.v
          UNION ALL SELECT DISTINCT q.network, q.a, b, 4 FROM asked q JOIN r2 y ON y.network = q.network AND y.a = q.b JOIN r2 x ON x.network = q.network AND x.a = q.a AND x.v = y.v),
        d AS (SELECT network, a, b, (SELECT min(d) FROM hit h WHERE h.network = q.network AND h.a = q.a AND h.b = q.b) AS distance FROM asked q)
        SELECT network, CAST(h AS INTEGER) AS hops, count(*) FILTER (distance = h) AS n_pairs, count(*) FILTER (distance <= h) AS cumulative FROM d, range(1, 5) t(h) GROUP BY network, h""",
    "evidence_level": f"WITH {_SAMPLES.lstrip()} SELECT a, b, fam, smeta, smanual, level FROM samples",
    "positive_pairs": f"WITH {_SAMPLES.lstrip()} SELECT a, b, level, round(level / 3.0, 6) AS weight FROM samples WHERE label = 1 AND level >= 1",
    "max_scaled_weights": f"WITH {_SAMPLES.lstrip()} SELECT a, b, round(raw_weight / (SELECT max(raw_weight) FROM evidence), 6) AS weight FROM evidence",
    "minmax_scaled_weights": f"WITH {_SAMPLES.lstrip()} SELECT a, b, round((weight - (SELECT min(weight) FROM samples)) / (SELECT max(weight) - min(weight) FROM samples), 6) AS weight FROM samples",
    "trainset_union": f"WITH {_SAMPLES.lstrip()} SELECT a, b, round(weight, 6) AS weight, label, CASE WHEN label = 1 AND level >= 3 THEN 'held-out' ELSE 'train' END AS part FROM samples",
    "path_networks": f"""WITH {INTERNED}, t AS (SELECT mp_id, list_concat(edges, nodes) AS types FROM dictionary)
        SELECT mp_id, 'trade' AS network FROM t WHERE list_has_all(['Customer', 'Part', 'purchases', 'resembles'], types)
        UNION ALL SELECT mp_id, 'no-places' FROM t WHERE NOT list_has_any(types, ['Nation', 'Region', 'Segment']) UNION ALL SELECT mp_id, 'people' FROM t WHERE list_has_all(['Customer', 'refers'], types)""",
    "evidence_level_stats": f"""WITH {_SAMPLES.lstrip()}, g AS (SELECT CAST(level AS VARCHAR) AS grp, a, b FROM samples WHERE label = 1 UNION ALL SELECT 'selected', a, b FROM samples WHERE label = 1 AND level >= 1),
        e AS (SELECT grp, count(DISTINCT entity) AS n_entities, count(DISTINCT c_nationkey) AS n_contexts FROM (SELECT grp, unnest([a, b]) AS entity FROM g) JOIN customer ON entity = 'C' || c_custkey GROUP BY grp)
        SELECT grp, count(*) AS n_rows, count(DISTINCT a || '|' || b) AS n_pairs, any_value(n_entities) AS n_entities, any_value(n_contexts) AS n_contexts FROM g JOIN e USING (grp) GROUP BY grp""",
    "metaedge_notation": f"""WITH {WALKED}, ab AS (SELECT type, min(abbrev) AS abbrev FROM nodes GROUP BY type),
        m AS (SELECT DISTINCT src_type, label, dst_type, CASE WHEN target_id IS NULL THEN 0 WHEN target_id = dst THEN 1 ELSE -1 END AS dir FROM typed),
        t AS (SELECT *, CASE WHEN src_type = dst_type AND dir = -1 THEN '<' ELSE '' END AS lt, CASE WHEN src_type = dst_type AND dir = 1 THEN '>' ELSE '' END AS gt FROM m)
        SELECT src_type, label, dst_type, dir, x.abbrev || lt || label[1] || regexp_replace(label[2:], '[^A-Z]', '', 'g') || gt || y.abbrev AS notation, src_type || '--' || lt || label || gt || '--' || dst_type AS pretty FROM t JOIN ab x ON x.type = src_type JOIN ab y ON y.type = dst_type""",
    "stratified_folds": f"WITH {_SAMPLES.lstrip()} SELECT a, b, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || a || '|' || b)) - 1) % 10 AS INTEGER) AS fold FROM samples",
    "frequent_metapaths": f"WITH {MINED} SELECT mp_id, round(support, 6) AS support, n_matches FROM f1",
    "frequent_pairs": f"WITH {MINED} SELECT {_text('items')} AS items, round(support, 6) AS support, n_matches FROM f2",
    "frequent_triples": f"WITH {MINED} SELECT {_text('items')} AS items, round(support, 6) AS support, n_matches FROM f3",
    "unifiable_patterns": f"""WITH {MINED}, k AS (SELECT DISTINCT mp_id, unnest(nodes[2:len(nodes) - 1]) AS kind FROM dictionary), e AS (SELECT items, unnest(items) AS mp_id FROM f2)
        SELECT DISTINCT {_text('items')} AS items FROM (SELECT items, kind FROM e JOIN k USING (mp_id) GROUP BY items, kind HAVING count(*) >= 2)""",
    "unification_support": f"WITH {MINED}, {_UNIFIED} SELECT {_text('items')} AS items, {_text('clause')} AS clause, round(support, 6) AS support, n_matches FROM fu2",
    "closed_patterns_compat": f"""WITH {MINED}, {_UNIFIED}, pats AS (SELECT items, [] AS clause, n_matches, 2 AS level FROM f2 UNION ALL SELECT items, [], n_matches, 3 FROM f3 UNION ALL SELECT items, clause, n_matches, 3 FROM fu2)
        SELECT {_text('items')} AS items, {_text('clause')} AS clause, n_matches FROM pats p WHERE NOT EXISTS (SELECT 1 FROM pats q WHERE q.level = p.level + 1 AND list_contains(q.items, p.items[1]) AND q.n_matches >= p.n_matches)""",
    "closed_patterns_strict": f"""WITH {MINED}, {_UNIFIED}, pats AS (SELECT items, CAST([] AS BIGINT[]) AS clause, n_matches, 2 AS level FROM f2 UNION ALL SELECT items, [], n_matches, 3 FROM f3 UNION ALL SELECT items, clause, n_matches, 3 FROM fu2)
        SELECT {_text('items')} AS items, {_text('clause')} AS clause, n_matches FROM pats p WHERE NOT EXISTS (SELECT 1 FROM pats q WHERE q.level = p.level + 1 AND list_has_all(q.items, p.items) AND (len(p.clause) = 0 OR p.clause = q.clause) AND q.n_matches >= p.n_matches)""",
    "path_histogram": f"""WITH {MINED}, s AS (SELECT o.items, o.a, o.b, i.slot, CAST(greatest(least(floor(round(p.score * 100, 9)), 100), 0) AS INTEGER) AS bin FROM o2 o, (VALUES (0), (1)) i(slot) JOIN ipaths p ON p.a = o.a AND p.b = o.b AND p.mp_id = o.items[i.slot + 1]),
        c AS (SELECT items, a, b, slot, bin, count(*) AS n FROM s GROUP BY ALL) SELECT {_text('items')} AS items, a, b, slot, bin, CAST(sum(n) OVER (PARTITION BY items, a, b, slot ORDER BY bin DESC) AS BIGINT) AS n_at_least FROM c""",
    "avg_path_count": f"""WITH {MINED}, {_COUNTS} SELECT {_text('items')} AS items, round(sum(weight), 6) AS s0, round(sum(weight * (n1 + n2)) / sum(weight), 6) AS p0 FROM counted WHERE x1 = 0 AND x2 = 0 GROUP BY items""",
    "threshold_cost_grid": f"""WITH {MINED}, {_COUNTS}, t AS (SELECT items, x1, x2, sum(CASE WHEN n1 > 0 AND n2 > 0 THEN weight ELSE 0 END) AS s, sum(CASE WHEN n1 > 0 AND n2 > 0 THEN weight * (n1 + n2) ELSE 0 END) AS wn FROM counted GROUP BY ALL),
        z AS (SELECT items, s AS s0, wn / s AS p0 FROM t WHERE x1 = 0 AND x2 = 0)
        SELECT {_text('items')} AS items, CAST(x1 AS INTEGER) AS x1, CAST(x2 AS INTEGER) AS x2, round(CASE WHEN round(s, 9) < (SELECT s FROM least) THEN 1 ELSE ((1 - s / s0) + wn / s / p0) / 2 END, 6) AS cost FROM t JOIN z USING (items)""",
    "threshold_matches": f"WITH {MINED}, {_COUNTS} SELECT {_text('items')} AS items, a, b, n1 + n2 AS n_paths FROM counted WHERE x1 = 30 AND x2 = 30 AND n1 > 0 AND n2 > 0",
    "rule_ids": f"WITH {RULED} SELECT rule_id, {_text('items')} AS items FROM rules",
    "rule_matches": f"WITH {RULED} SELECT rule_id, a, b FROM matches",
    "rule_matches_thresholded": f"WITH {RULED} SELECT r.rule_id, x.a, x.b FROM rules r JOIN best x ON x.mp_id = r.items[1] JOIN best y ON y.mp_id = r.items[2] AND y.a = x.a AND y.b = x.b WHERE x.score >= 0.5 AND y.score >= 0.3",
    "rule_matches_unified": f"""WITH {MINED}, {_UNIFIED}, rules AS (SELECT CAST(row_number() OVER (ORDER BY items, clause) AS INTEGER) AS rule_id, items, clause FROM fu2)
        SELECT DISTINCT r.rule_id, p.a, p.b FROM rules r JOIN places p ON p.mp_id = r.clause[1] AND p.pos = r.clause[2] JOIN places q ON q.mp_id = r.clause[3] AND q.pos = r.clause[4] AND q.a = p.a AND q.b = p.b AND q.node = p.node""",
    "fpr_pruned_rules": f"WITH {RULED} SELECT rule_id, round(fp, 6) AS fp FROM (SELECT rule_id, coalesce(fp, 0) AS fp FROM rules LEFT JOIN rt USING (rule_id)), tot WHERE round(fp, 9) <= round(0.05 * wn, 9)",
    "rule_confidence": f"WITH {RULED} SELECT rule_id, round(tp, 6) AS tp, round(fp, 6) AS fp, round(tp / (tp + fp), 6) AS confidence FROM rt",
    "significant_rules": f"""WITH {RULED}, k AS (SELECT rule_id, count(*) FILTER (label = 1) AS tp, count(*) AS hits FROM coverage GROUP BY rule_id),
        terms AS (SELECT rule_id, hits, np, nn, unnest(range(tp, least(hits, np) + 1)) AS x FROM k, tot),
        p AS (SELECT rule_id, least(sum(CASE WHEN hits - x > nn THEN 0 ELSE exp(lgamma(np + 1) - lgamma(x + 1) - lgamma(np - x + 1) + lgamma(nn + 1) - lgamma(greatest(hits - x, 0) + 1) - lgamma(greatest(nn - hits + x, 0) + 1)
          - lgamma(np + nn + 1) + lgamma(hits + 1) + lgamma(np + nn - hits + 1)) END), 1) AS p FROM terms GROUP BY rule_id)
        SELECT rule_id, round(p, 6) AS p_value FROM p WHERE p <= 0.05""",
    "rule_support_ratio": f"WITH {RULED} SELECT rule_id, round(tp / wp, 6) AS support, round(tp / (tp + np / nn * fp), 6) AS confidence FROM rt, tot",
    "explanation_subgraph": f"""WITH {RULED}, f AS (SELECT m.rule_id, m.a, m.b, p.mp_id, p.mids FROM matches m JOIN rules r USING (rule_id) JOIN ipaths p ON p.a = m.a AND p.b = m.b AND p.mp_id IN (r.items[1], r.items[2])),
        w AS (SELECT rule_id, a, b, mp_id, list_concat(list_concat([a], mids), [b]) AS walk FROM f), h AS (SELECT DISTINCT w.rule_id, w.a, w.b, d.edges[i] AS label, w.walk[i] AS u, w.walk[i + 1] AS v FROM w JOIN dictionary d USING (mp_id), range(1, 4) t(i) WHERE i <= len(d.edges))
        SELECT DISTINCT h.rule_id, h.a, h.b, e.label || '|' || e.src || '|' || e.dst AS eid FROM h JOIN edges e ON e.label = h.label AND ((e.src = h.u AND e.dst = h.v) OR (e.src = h.v AND e.dst = h.u))""",
    "explanation_graphml": f"""WITH {RULED}, f AS (SELECT m.rule_id, m.a, m.b, p.mp_id, p.mids FROM matches m JOIN rules r USING (rule_id) JOIN ipaths p ON p.a = m.a AND p.b = m.b AND p.mp_id IN (r.items[1], r.items[2])),
        w AS (SELECT rule_id, a, b, mp_id, list_concat(list_concat([a], mids), [b]) AS walk FROM f), h AS (SELECT DISTINCT w.rule_id, w.a, w.b, d.edges[i] AS label, w.walk[i] AS u, w.walk[i + 1] AS v FROM w JOIN dictionary d USING (mp_id), range(1, 4) t(i) WHERE i <= len(d.edges)),
        x AS (SELECT DISTINCT h.rule_id, h.a, h.b, e.label || '|' || e.src || '|' || e.dst AS eid, e.src, e.dst, e.label, round(e.score, 6) AS score, e.target_id FROM h JOIN edges e ON e.label = h.label AND ((e.src = h.u AND e.dst = h.v) OR (e.src = h.v AND e.dst = h.u))),
        v AS (SELECT DISTINCT rule_id, a, b, unnest([src, dst]) AS id FROM x),
        nt AS (SELECT rule_id, a, b, count(*) AS n_nodes, string_agg('<node id="' || id || '"><data key="n_id">' || id || '</data><data key="n_labels">:' || n.type || '</data><data key="n_name">' || n.name || '</data></node>', '' ORDER BY id) AS t FROM v JOIN nodes n USING (id) GROUP BY ALL),
        et AS (SELECT rule_id, a, b, count(*) AS n_edges, string_agg('<edge source="' || src || '" target="' || dst || '"><data key="e_label">' || label || '</data><data key="e_score">' || CAST(score AS VARCHAR) || '</data>' || coalesce('<data key="e_target">' || target_id || '</data>', '') || '</edge>', '' ORDER BY eid) AS t FROM x GROUP BY ALL)
        SELECT a, b, rule_id, CAST(n_nodes AS INTEGER) AS n_nodes, CAST(n_edges AS INTEGER) AS n_edges, '<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="n_id" for="node" attr.name="id" attr.type="string"/><key id="n_labels" for="node" attr.name="labels" attr.type="string"/>'
          || '<key id="n_name" for="node" attr.name="name" attr.type="string"/><key id="e_label" for="edge" attr.name="label" attr.type="string"/><key id="e_score" for="edge" attr.name="score" attr.type="double"/><key id="e_target" for="edge" attr.name="target" attr.type="string"/><graph edgedefault="directed">'
          || nt.t || et.t || '</graph></graphml>' AS xml FROM nt JOIN et USING (rule_id, a, b)""",
    "subgraph_sizes": f"""WITH {RULED}, f AS (SELECT m.rule_id, m.a, m.b, p.mp_id, p.mids FROM matches m JOIN rules r USING (rule_id) JOIN ipaths p ON p.a = m.a AND p.b = m.b AND p.mp_id IN (r.items[1], r.items[2])),
        n AS (SELECT rule_id, a, b, count(DISTINCT n) AS n_nodes FROM (SELECT rule_id, a, b, unnest(list_concat(list_concat([a], mids), [b])) AS n FROM f) GROUP BY ALL) SELECT rule_id, a, b, count(*) AS n_paths, any_value(n_nodes) AS n_nodes FROM f JOIN n USING (rule_id, a, b) GROUP BY ALL""",
    "explanation_rank": f"WITH {RULED} SELECT a, b, rule_id, round(probability, 6) AS probability, CAST(dense_rank() OVER (PARTITION BY a, b ORDER BY probability DESC) AS INTEGER) AS rank FROM matches JOIN prob USING (rule_id)",
    "set_weight": f"WITH {RULED}, c AS (SELECT DISTINCT a, b, label, weight FROM coverage) SELECT round(0.5 * (1 - sum(weight) FILTER (label = 1) / any_value(wp)) + 0.5 * sum(weight) FILTER (label = 0) / any_value(wn), 6) AS set_weight FROM c, tot",
    "default_probability": f"WITH {RULED} SELECT round(p, 6) AS default_probability FROM dflt",
    "predict_proba": f"WITH {RULED}, m AS (SELECT a, b, max(probability) AS p FROM matches JOIN prob USING (rule_id) GROUP BY a, b) SELECT a, b, round(coalesce(m.p, dflt.p), 6) AS probability, CASE WHEN coalesce(m.p, dflt.p) > 0.5 THEN 1 ELSE 0 END AS predicted FROM samples LEFT JOIN m USING (a, b), dflt",
    "weighted_roc_auc": f"WITH {_SCORED}, {_BY_SCORE}, c AS (SELECT *, sum(p) OVER (PARTITION BY fold ORDER BY score DESC) AS tp FROM by_score) SELECT fold, round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6) AS roc_auc FROM c GROUP BY fold",
    "pr_auc": f"""WITH {_SCORED}, {_BY_SCORE}, c AS (SELECT fold, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS all_p FROM by_score WINDOW w AS (PARTITION BY fold ORDER BY score DESC)),
        r AS (SELECT fold, score, tp / all_p AS recall, tp / (tp + fp) AS precision FROM c), s AS (SELECT fold, (recall - lag(recall, 1, 0) OVER w) * (precision + lag(precision, 1, 1) OVER w) / 2 AS step FROM r WINDOW w AS (PARTITION BY fold ORDER BY score DESC)) SELECT fold, round(sum(step), 6) AS pr_auc FROM s GROUP BY fold""",
    "roc_curve_points": f"WITH {_SCORED}, {_BY_SCORE} SELECT fold, score, round(sum(p) OVER w / sum(p) OVER (PARTITION BY fold), 6) AS tpr, round(sum(n) OVER w / sum(n) OVER (PARTITION BY fold), 6) AS fpr FROM by_score WINDOW w AS (PARTITION BY fold ORDER BY score DESC)",
    "best_threshold": f"""WITH {_SCORED}, k AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM scored GROUP BY score),
        r AS (SELECT score, sum(p) OVER w / sum(p) OVER () AS tpr, sum(n) OVER w / sum(n) OVER () AS fpr FROM k WINDOW w AS (ORDER BY score DESC)) SELECT round(score, 6) AS score, round(sqrt(tpr * (1 - fpr)), 6) AS g_mean, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round((tpr + 1 - fpr) / 2, 6) AS balanced_accuracy FROM r ORDER BY round(sqrt(tpr * (1 - fpr)), 12) DESC, score DESC LIMIT 1""",
    "param_study_topk": "WITH s AS (SELECT l_linenumber, l_returnflag, l_linestatus, avg(l_discount) AS mean FROM lineitem GROUP BY ALL), m AS (SELECT *, max(mean) OVER (PARTITION BY l_returnflag) AS best FROM s) SELECT l_linenumber, l_returnflag, l_linestatus, round(mean, 6) AS mean FROM m WHERE round(best - mean, 12) <= 0.0005",
    "ablation_summary": "SELECT CASE WHEN regexp_extract(p_name, '^small (.*)$', 1) = '' THEN 'Baseline' ELSE regexp_extract(p_name, '^small (.*)$', 1) END AS metaedge, round(avg(p_retailprice), 6) AS price_mean, round(stddev_samp(p_retailprice), 6) AS price_std FROM part GROUP BY 1",
    "pivot_mean_std": "SELECT l_returnflag, round(avg(l_tax) FILTER (l_linestatus = 'F'), 6) AS F_mean, round(2 * stddev_pop(l_tax) FILTER (l_linestatus = 'F'), 6) AS F_two_sigma, round(avg(l_tax) FILTER (l_linestatus = 'O'), 6) AS O_mean, round(2 * stddev_pop(l_tax) FILTER (l_linestatus = 'O'), 6) AS O_two_sigma FROM lineitem GROUP BY l_returnflag",
    "metapath_ranksum": f"""WITH t AS (SELECT l_linenumber AS grp, l_quantity AS v, count(*) AS t, count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem GROUP BY ALL), r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY grp ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2 AS rank FROM t),
        s AS (SELECT grp, sum(m)::DOUBLE AS n1, sum(t)::DOUBLE AS n, sum(rank * m)::DOUBLE AS r1, sum(rank * rank * t)::DOUBLE AS ss FROM r GROUP BY grp), {_TESTED} SELECT grp, {_TEST_COLUMNS} FROM tested""",
    "metapath_influence": f"""WITH {RULED}, {_INFLUENCE}, {_TESTED} SELECT mp_id, {_TEST_COLUMNS} FROM tested""",
    "influential_elements": f"""WITH {RULED}, {_INFLUENCE}, {_TESTED}, {_NOTATION},
        kept AS (SELECT mp_id, regexp_extract_all(notation, '[A-Z]+|[^A-Z]+') AS parts FROM notation JOIN tested USING (mp_id) WHERE least(p * (SELECT count(*) FROM tested), 1) < 0.9)
        SELECT element, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM kept), 6) AS share FROM (SELECT DISTINCT mp_id, unnest(parts[2:-2]) AS element FROM kept) GROUP BY element""",
    "cross_table": "SELECT l_returnflag, count(*) FILTER (l_quantity > 25) AS n_true, count(*) FILTER (NOT l_quantity > 25) AS n_false FROM lineitem GROUP BY l_returnflag",
    "melted_means": "WITH l AS (SELECT p_partkey, 'p_retailprice' AS variable, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'p_size', p_size FROM part) SELECT p_partkey, variable, round(value, 6) AS value, round(avg(value) OVER (PARTITION BY variable), 6) AS mean FROM l",
    "metapath_abbreviations": f"WITH {INTERNED}, {_NOTATION} SELECT mp_id, notation FROM notation",
    "holdout_greedy": f"WITH {_SAMPLES.lstrip()}, {_DATED}, {_recent(5)} SELECT a, b, ts FROM recent",
    "holdout_details": f"""WITH {_NODES}, {_SAMPLES}, {_DATED}, {_recent(5)} SELECT r.a, r.b, x.name AS name_a, y.name AS name_b, s.level, strftime(to_timestamp(r.ts) AT TIME ZONE 'UTC', '%d/%m/%Y') AS date,
        (SELECT string_agg(n_name, '-' ORDER BY n_name) FROM (SELECT DISTINCT n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE 'C' || c_custkey IN (r.a, r.b))) AS contexts,
        coalesce((SELECT string_agg(k, ';' ORDER BY k) FROM (SELECT CAST(min(o_orderkey) AS VARCHAR) AS k FROM orders WHERE 'C' || o_custkey IN (r.a, r.b) GROUP BY o_custkey)), '') AS publications
        FROM recent r JOIN samples s USING (a, b) JOIN nodes x ON x.id = r.a JOIN nodes y ON y.id = r.b""",
    "threshold_greedy": f"WITH {MINED}, {_BINS}, {_GREEDY} SELECT {_text('items')} AS items, CASE slot WHEN 0 THEN v1 || ',' || v2 ELSE v2 || ',' || v1 END AS x, round(cost, 6) AS cost FROM chosen",
    "threshold_grid": f"WITH {MINED}, {_BINS}, {_GRID} SELECT {_text('items')} AS items, v1 || ',' || v2 AS x, round(cost, 6) AS cost FROM best_of",
    "set_cover_steps": f"WITH {RULED}, {_cover(COVER_STEPS)} SELECT CAST(step AS INTEGER) AS step, rule_id, round(marginal, 6) AS marginal FROM steps",
    "roc_mean_curve": f"""WITH {_SCORED}, {_BY_SCORE}, {_curve("fp / all_n", "tp / all_p", 0)} SELECT round(k / 100.0, 6) AS at, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM grid GROUP BY k""",
    "pr_mean_curve": f"""WITH {_SCORED}, {_BY_SCORE}, {_curve("tp / all_p", "tp / (tp + fp)", 1)} SELECT round(k / 100.0, 6) AS at, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM grid GROUP BY k""",
}
