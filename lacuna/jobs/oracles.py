"""SQL of the registered queries, put together from common table expressions."""

from __future__ import annotations

from lacuna.functions.relabel import round_keys

P = """p AS (SELECT vec_id AS node_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, 1 + embedding[4]::DOUBLE AS density,
    1 + embedding[5]::DOUBLE AS temperature, 1 + abs(embedding[6]::DOUBLE) AS mass FROM embeddings)"""
GRID = """grid AS (SELECT iy * 24 + ix AS node_id, iy, ix, v FROM (SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS iy, CAST(hour(ts) AS BIGINT) AS ix,
    CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2))"""
PIXELS = """grid AS (SELECT iy * 64 + ix AS node_id, iy, ix, v FROM (SELECT CAST(floor(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) / 7) AS BIGINT) AS iy,
    CAST(l_partkey % 64 AS BIGINT) AS ix, CAST(count(*) AS DOUBLE) AS v FROM lineitem GROUP BY 1, 2))"""
FULL = """grid AS (SELECT t.n AS node_id, t.n // 24 AS iy, t.n % 24 AS ix, coalesce(v, 0.0) AS v FROM range((SELECT (max(iy) + 1) * 24 FROM raw)) t(n) LEFT JOIN raw ON raw.node_id = t.n)"""
RAW = GRID.replace("grid AS", "raw AS", 1)
WEEKS = PIXELS.replace("grid AS", "raw AS", 1) + ", " + FULL.replace("24", "64").replace("grid AS (", "grid AS MATERIALIZED (")
CROSS = "(VALUES (0, 1), (1, 0))"
AHEAD = "(VALUES (0, 1), (1, -1), (1, 0), (1, 1))"


def cells(deviations: float) -> str:
    return f"cells AS (SELECT g.*, v <= (SELECT avg(v) - {deviations}e0 * stddev_pop(v) FROM grid) AS inn FROM grid g)"


def edges(ahead: str = AHEAD, of: str = "grid", name: str = "e") -> str:
    return f"{name} AS (SELECT a.node_id AS src, b.node_id AS dst FROM {of} a CROSS JOIN {ahead} s(dy, dx) JOIN {of} b ON b.iy = a.iy + s.dy AND b.ix = a.ix + s.dx)"


def both(of: str = "e", name: str = "adj") -> str:
    return f"{name} AS (SELECT src AS node, dst AS nbr FROM {of} UNION ALL SELECT dst, src FROM {of})"


def reached(nodes: str, adj: str, name: str) -> str:
    """Least node of each component: all (node, start) pairs that walks inside the set make."""
    return f"""{name}_walk AS (SELECT node_id, node_id AS start FROM {nodes} UNION SELECT n.node_id, w.start FROM {name}_walk w JOIN {adj} ON {adj}.node = w.node_id JOIN {nodes} n ON n.node_id = {adj}.nbr),
    {name} AS (SELECT node_id, min(start) AS component FROM {name}_walk GROUP BY 1)"""


INNER = "inn AS (SELECT * FROM cells WHERE inn)"
HALVES = "halves AS (SELECT node_id, iy % 7 AS group_id FROM cells WHERE inn)"
GRID_GRAPH = ", ".join([GRID, cells(0.5), edges(), both()])
RADIUS_E = """e AS (SELECT a.node_id AS src, b.node_id AS dst FROM p a JOIN p b ON a.node_id < b.node_id
    AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.1e0 * 0.1e0)"""
ORDERS = "grid AS (SELECT o_orderkey AS node_id, o_orderkey // 128 AS iy, o_orderkey % 128 AS ix, o_totalprice AS v FROM orders)"
CALM = """blocks AS (SELECT iy // 8 AS jy, ix // 8 AS jx, avg(v) AS m FROM grid GROUP BY 1, 2), level AS (SELECT avg(m) - 0.3e0 * stddev_pop(m) AS l FROM blocks),
    cells AS (SELECT g.*, m <= l AS inn FROM grid g JOIN blocks ON jy = g.iy // 8 AND jx = g.ix // 8 CROSS JOIN level)"""


def peeled(of: str, name: str) -> str:
    return f"{name} AS (SELECT node_id FROM {of} WHERE NOT EXISTS (SELECT 1 FROM adj WHERE adj.node = {of}.node_id AND adj.nbr NOT IN (SELECT node_id FROM {of})))"


def numbered(of: str, name: str) -> str:
    return f"{name} AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cid FROM (SELECT DISTINCT component FROM {of}))"


def parents(k: int) -> str:
    """Components of round k with those of the round before that hold them."""
    return f"SELECT DISTINCT {k - 1} AS piter, a.cid AS pcid, {k} AS iter, b.cid AS cid FROM c{k} JOIN n{k} b USING (component) JOIN c{k - 1} d ON d.node_id = c{k}.node_id JOIN n{k - 1} a ON a.component = d.component"


LEVELS = "WITH RECURSIVE " + ", ".join(
    [ORDERS, CALM, INNER, edges(CROSS), both(), reached("inn", "adj", "c0"), numbered("c0", "n0")]
    + [peeled("inn", "s1"), reached("s1", "adj", "c1"), numbered("c1", "n1"), peeled("s1", "s2"), reached("s2", "adj", "c2"), numbered("c2", "n2")]
    + [f"up AS ({parents(1)} UNION ALL {parents(2)})"]
)


def binned(quantity: str) -> str:
    """Bins, profile and log ratio of one quantity."""
    return f"""b AS (SELECT *, sqrt(x * x + y * y) AS r FROM p),
    lim AS (SELECT min(r) AS r0, min(z) AS z0, greatest(1, ceil((max(r) - min(r)) / 0.05e0)) AS rn, greatest(1, ceil((max(z) - min(z)) / 0.05e0)) AS zn, max(r) - min(r) AS rs, max(z) - min(z) AS zs FROM b),
    k AS (SELECT b.*, CAST(greatest(0, least(floor((r - r0) / (rs / rn)), rn - 1)) AS BIGINT) AS r_bin, CAST(greatest(0, least(floor((z - z0) / (zs / zn)), zn - 1)) AS BIGINT) AS z_bin FROM b, lim),
    prof AS (SELECT r_bin, z_bin, sum(mass) AS mass, sum(mass * {quantity}) / sum(mass) AS mean FROM k GROUP BY 1, 2),
    ratio AS (SELECT node_id, ln({quantity} / mean) AS log_ratio FROM k JOIN prof USING (r_bin, z_bin))"""


def scaled(of: str, column: str) -> str:
    q = lambda x: f"quantile_cont({column}, {x})"
    return f"(SELECT {q(0.5)} AS center, CASE WHEN {q(0.75)} = {q(0.25)} THEN 1.0 ELSE {q(0.75)} - {q(0.25)} END AS scale FROM {of})"


def smooth(sigma: int, name: str, width: int = 24) -> str:
    """Separable Gaussian with half-sample reflection on the grid of days and 24 hours, or of another width; one reflection at each end."""
    reach, days = 4 * sigma, "(SELECT max(iy) + 1 FROM raw)"
    flip = lambda i, n: f"CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"
    return f"""{name}_k AS (SELECT d, w / (SELECT sum(exp(-0.5e0 * (d / {sigma}e0) * (d / {sigma}e0))) FROM range(-{reach}, {reach + 1}) t(d)) AS w
        FROM (SELECT d, exp(-0.5e0 * (d / {sigma}e0) * (d / {sigma}e0)) AS w FROM range(-{reach}, {reach + 1}) t(d))),
    {name}_x AS MATERIALIZED (SELECT f.node_id, f.iy, f.ix, sum(w * g.v) AS v FROM grid f CROSS JOIN {name}_k k JOIN grid g ON g.iy = f.iy AND g.ix = {flip("f.ix + k.d", width)} GROUP BY 1, 2, 3),
    {name} AS (SELECT f.node_id, any_value(o.v) / (sum(w * g.v) + 1e-10) AS v FROM {name}_x f CROSS JOIN {name}_k k JOIN {name}_x g ON g.ix = f.ix AND g.iy = {flip("f.iy + k.d", days)}
        JOIN grid o ON o.node_id = f.node_id GROUP BY 1)"""


def attention(sent: str, heads: list[str], outs: list[list[str]], last: list[float]) -> str:
    """Softmax of each head's logit over the rows of a node, weighted sums, mean of heads."""
    logits = ", ".join(f"{e} AS e{h}" for h, e in enumerate(heads))
    top = ", ".join(f"max(e{h}) OVER (PARTITION BY node_id) AS m{h}" for h in range(len(heads)))
    o = []
    for k, bias in enumerate(last):
        total = " + ".join(f"sum(exp(e{h} - m{h}) * {outs[h][k]}) / sum(exp(e{h} - m{h}))" for h in range(len(heads)))
        o.append(f"({total}) / {len(heads)} + {bias}e0 AS o{k}")
    return f"t AS (SELECT *, {top} FROM (SELECT *, {logits} FROM {sent})), o AS (SELECT node_id, {', '.join(o)} FROM t GROUP BY 1)"


def leaky(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN {x} ELSE 0.2e0 * ({x}) END)"


MEANS = "m AS (SELECT p.node_id, p.density AS x1, p.temperature AS x2, coalesce(avg(n.density), 0.0) AS m1, coalesce(avg(n.temperature), 0.0) AS m2 FROM p LEFT JOIN adj ON adj.node = p.node_id LEFT JOIN p n ON n.node_id = adj.nbr GROUP BY 1, 2, 3)"
SOFTMAX = f"""WITH {P}, {RADIUS_E}, {both()}, {MEANS},
    h AS (SELECT node_id, greatest(0, ((x1 + 0.5e0 * x2 + 0.5e0 * m1 - m2 + 0.1e0) - 0.2e0) / sqrt(0.99999e0 + 1e-5) * 1.5e0) AS h1,
        greatest(0, ((-x1 + 2 * x2 + m1 + 0.25e0 * m2 - 0.2e0) - 0.1e0) / sqrt(3.99999e0 + 1e-5) * 0.5e0 + 0.3e0) AS h2 FROM m),
    d AS (SELECT node_id, h1 - h2 AS l0, 0.5e0 * h1 + 0.5e0 * h2 + 0.1e0 AS l1, 2 * h1 AS l2, -h1 + h2 - 0.1e0 AS l3, 0.5e0 * h1 + h2 AS r0, h1 AS r1, h2 + 0.2e0 AS r2, h1 + h2 AS r3 FROM h),
    pairs AS (SELECT node AS node_id, nbr FROM adj UNION ALL SELECT node_id, node_id FROM p),
    sent AS (SELECT i.node_id, j.l0, j.l1, j.l2, j.l3, j.l0 + i.r0 AS a0, j.l1 + i.r1 AS a1, j.l2 + i.r2 AS a2, j.l3 + i.r3 AS a3 FROM pairs JOIN d i USING (node_id) JOIN d j ON j.node_id = pairs.nbr),
    {attention("sent", [f"{leaky('a0')} - 0.5e0 * {leaky('a1')}", f"0.5e0 * {leaky('a2')} + {leaky('a3')}"], [["l0", "l1"], ["l2", "l3"]], [0.25, -0.25])}
    SELECT node_id, round(exp(o0 - greatest(o0, o1)) / (exp(o0 - greatest(o0, o1)) + exp(o1 - greatest(o0, o1))), 6) AS score FROM o"""
SIGMOID = f"""WITH {GRID}, {edges()}, {both()},
    m AS (SELECT g.node_id, ln(g.v) AS x, coalesce(avg(ln(n.v)), 0.0) AS m FROM grid g LEFT JOIN adj ON adj.node = g.node_id LEFT JOIN grid n ON n.node_id = adj.nbr GROUP BY 1, 2),
    h AS (SELECT node_id, greatest(0, ((x + 0.5e0 * m + 0.1e0) - 0.2e0) / sqrt(0.99999e0 + 1e-5) * 1.5e0) AS h1, greatest(0, ((-x + m - 0.2e0) - 0.1e0) / sqrt(3.99999e0 + 1e-5) * 0.5e0 + 0.3e0) AS h2 FROM m),
    d AS (SELECT node_id, h1 - h2 AS l0, 0.5e0 * h1 + 0.5e0 * h2 + 0.1e0 AS l1, 0.5e0 * h1 + h2 AS r0, h1 + 0.2e0 AS r1 FROM h),
    pairs AS (SELECT node AS node_id, nbr FROM adj UNION ALL SELECT node_id, node_id FROM grid),
    sent AS (SELECT i.node_id, j.l0, j.l1, j.l0 + i.r0 AS a0, j.l1 + i.r1 AS a1 FROM pairs JOIN d i USING (node_id) JOIN d j ON j.node_id = pairs.nbr),
    {attention("sent", [leaky("a0"), f"-0.5e0 * {leaky('a1')}"], [["l0"], ["l1"]], [0.25])}
    SELECT node_id, round(1 / (1 + exp(-o0)), 6) AS score FROM o"""

def on_features(sql: str) -> str:
    """The network of points on the table q of features instead of p."""
    return sql.replace(MEANS, MEANS.replace("p.", "q.").replace("FROM p ", "FROM q ").replace("JOIN p n", "JOIN q n"))


SCALED = f"""f AS (WITH {binned("density")} SELECT node_id, (log_ratio - center) / scale AS f0 FROM ratio, {scaled("ratio", "log_ratio")}),
    g AS (WITH {binned("temperature")} SELECT node_id, (log_ratio - center) / scale AS f1 FROM ratio, {scaled("ratio", "log_ratio")}),
    q AS (SELECT node_id, f0 AS density, f1 AS temperature FROM f JOIN g USING (node_id))"""
PHI = "CASE WHEN x IS NULL THEN NULL ELSE (atan2(y, x) + pi()) % (2 * pi()) END"
HELD = f"""azimuths AS (SELECT node_id, {PHI} AS f FROM p), homes AS (SELECT *, least(floor(f / (2 * pi() / 8)), 7) AS home FROM azimuths),
    held AS (SELECT DISTINCT node_id, c AS chunk FROM (
        SELECT node_id, CAST(unnest([home, CASE WHEN f - home * (2 * pi() / 8) < 0.05e0 THEN (home + 7) % 8 END, CASE WHEN (home + 1) * (2 * pi() / 8) - f <= 0.05e0 THEN (home + 1) % 8 END]) AS BIGINT) AS c FROM homes) WHERE c IS NOT NULL)"""
SCORE = "exp(o0 - greatest(o0, o1)) / (exp(o0 - greatest(o0, o1)) + exp(o1 - greatest(o0, o1)))"
#: The network on all chunks at once: a node of a chunk has the number chunk * 2^32 + node_id.
CHUNKED = (
    on_features(SOFTMAX)
    .replace(
        f"WITH {P}, {RADIUS_E}, {both()}, ",
        f"WITH {P}, {SCALED.replace('q AS (', 'feats AS (')}, {HELD}, {RADIUS_E.replace('e AS', 'whole AS', 1)}, "
        f"e AS (SELECT s.chunk * 4294967296 + src AS src, s.chunk * 4294967296 + dst AS dst FROM whole JOIN held s ON s.node_id = src JOIN held d ON d.node_id = dst AND d.chunk = s.chunk), {both()}, "
        "q AS (SELECT chunk * 4294967296 + node_id AS node_id, density, temperature FROM held JOIN feats USING (node_id)), ",
    )
    .replace("SELECT node_id, node_id FROM p)", "SELECT node_id, node_id FROM q)")
    .replace(f"SELECT node_id, round({SCORE}, 6) AS score FROM o", f", won AS (SELECT node_id % 4294967296 AS node_id, arg_max({SCORE}, node_id) AS s FROM o GROUP BY 1)")
)
IMAGE = (
    "WITH RECURSIVE "
    + ", ".join([RAW, FULL, smooth(1, "fine"), smooth(2, "wide"), "mix AS (SELECT g.node_id, g.iy, g.ix, (fine.v + wide.v) / 2 AS v FROM grid g JOIN fine ON fine.node_id = g.node_id JOIN wide ON wide.node_id = g.node_id)"])
    + ", live AS (SELECT node_id, iy, ix, ln(v) AS lv FROM mix WHERE v > 0), "
    + f"feat AS (SELECT node_id, iy, ix, exp((lv - center) / scale) AS v FROM live, {scaled('live', 'lv')}), {edges(of='feat')}, "
    + SIGMOID.removeprefix(f"WITH {GRID}, {edges()}, ").replace("FROM grid", "FROM feat").replace("JOIN grid", "JOIN feat").removesuffix("SELECT node_id, round(1 / (1 + exp(-o0)), 6) AS score FROM o")
    + ", cells AS (SELECT mix.*, coalesce(1 / (1 + exp(-o0)), 0.0) AS score, coalesce(1 / (1 + exp(-o0)), 0.0) > 0.5 AS inn FROM mix LEFT JOIN o USING (node_id)), outs AS (SELECT * FROM cells WHERE NOT inn), "
    + edges(CROSS, "cells", "e4")
    + ", "
    + both("e4", "adj4")
    + ", "
    + reached("outs", "adj4", "c")
    + ' SELECT cells.node_id, round(v, 6) AS v, round(score, 6) AS score, inn OR count(*) OVER (PARTITION BY component) < 4 AND component IS NOT NULL AS "inner" FROM cells LEFT JOIN c ON c.node_id = cells.node_id'
)

MODE = """met AS (SELECT node, group_id, count(*) AS n FROM adj JOIN groups ON groups.node_id = adj.nbr GROUP BY 1, 2),
    best AS (SELECT node, arg_max(group_id, row(n, -group_id)) AS mode_group, max(n) AS n, count(*) AS groups, CAST(sum(n) AS BIGINT) AS total FROM met GROUP BY 1)"""
CONTACTS = """touch AS (SELECT DISTINCT h.group_id, adj.nbr FROM adj JOIN halves h ON h.node_id = adj.node),
    near AS (SELECT t.group_id, h.group_id AS other, count(*) AS n FROM touch t LEFT JOIN halves h ON h.node_id = t.nbr WHERE h.group_id IS NULL OR h.group_id <> t.group_id GROUP BY 1, 2)"""
BLOCKS = "blocks AS (SELECT node_id, (iy // 4) * 4 + ix // 6 AS group_id FROM cells WHERE inn)"


def merge_round(k: int) -> str:
    """Round k of merging: decisions on the groups h{k}, chains of moves by ascending (size, group), and the groups h{k + 1}."""
    return f"""touch{k} AS (SELECT DISTINCT h.group_id, adj.nbr FROM adj JOIN h{k} h ON h.node_id = adj.node),
    near{k} AS (SELECT t.group_id, h.group_id AS other, count(*) AS n FROM touch{k} t LEFT JOIN h{k} h ON h.node_id = t.nbr WHERE h.group_id IS NULL OR h.group_id <> t.group_id GROUP BY 1, 2),
    size{k} AS (SELECT group_id, count(*) AS size, count(*) FILTER (WHERE ix IN (0, 23)) AS edge FROM h{k} JOIN cells USING (node_id) GROUP BY 1),
    dec{k} AS MATERIALIZED (SELECT group_id, size, CASE WHEN touching = 0 THEN NULL WHEN (touching + edge) / neighbours::DOUBLE >= 0.2e0 THEN top ELSE group_id END AS target FROM (
        SELECT s.group_id, any_value(size) AS size, any_value(edge) AS edge, coalesce(sum(n), 0) AS neighbours, coalesce(sum(n) FILTER (WHERE other IS NOT NULL), 0) AS touching,
            arg_max(other, row(n, -other)) FILTER (WHERE other IS NOT NULL) AS top FROM size{k} s LEFT JOIN near{k} USING (group_id) WHERE s.group_id NOT IN (SELECT group_id FROM skip{k}) GROUP BY 1)),
    hop{k} AS (SELECT group_id, target AS reach, size, group_id AS turn FROM dec{k} WHERE target <> group_id
        UNION SELECT hop{k}.group_id, d.target, d.size, d.group_id FROM hop{k} JOIN dec{k} d ON d.group_id = hop{k}.reach AND d.target <> d.group_id AND (d.size, d.group_id) > (hop{k}.size, hop{k}.turn)),
    final{k} AS (SELECT group_id, arg_max(reach, row(size, turn)) AS final FROM hop{k} GROUP BY 1),
    skip{k + 1} AS (SELECT group_id FROM skip{k} UNION SELECT group_id FROM dec{k} WHERE target IS NULL),
    h{k + 1} AS MATERIALIZED (SELECT node_id, coalesce(final, group_id) AS group_id FROM h{k} LEFT JOIN final{k} USING (group_id))"""


HOLES = "WITH RECURSIVE " + ", ".join([RAW, FULL, cells(0.0), "outs AS (SELECT * FROM cells WHERE NOT inn)", edges(CROSS), both(), reached("outs", "adj", "c")])
SUPPLY = "e AS (SELECT DISTINCT -l_suppkey - 1 AS src, l_partkey AS dst FROM lineitem)"

PIXEL = "CAST(least(floor((pos - lo) / ((hi - lo) / {n})), {n} - 1) AS BIGINT)"


def reduced(rows: str, n: int, digits: int) -> str:
    """First, last, least and largest value of each of n pixel columns of rows (node_id, pos, v, c)."""
    r = lambda x, name: f'round({x}, {digits}) AS "{name}"'
    cols = ", ".join([r("arg_min(v, row(pos, node_id))", "first"), r("arg_max(v, row(pos, node_id))", "last"), r("min(v)", "least"), r("max(v)", "largest"), r("avg(c)", "color")])
    return f"t AS ({rows}), lim AS (SELECT min(pos) AS lo, max(pos) AS hi FROM t) SELECT {PIXEL.format(n=n)} AS pixel, count(*) AS n, {cols} FROM t, lim GROUP BY 1"


def swapped(seed: int) -> str:
    """s0, s1, ...: places x of the bijection of 0..n-1 after each round."""
    steps = [
        f"s{r + 1} AS (SELECT o_orderkey, zero, n, CASE WHEN ascii(md5('{seed}:{r}:' || CAST(greatest(x, y) AS VARCHAR))) % 2 = 1 THEN y ELSE x END AS x FROM (SELECT *, ({key} % n - x + n) % n AS y FROM s{r}))"
        for r, key in enumerate(round_keys(seed))
    ]
    return ", ".join(steps) + f" SELECT o_orderkey, CAST(CASE WHEN zero THEN 0 ELSE x + 1 END AS BIGINT) AS label FROM s{len(steps)}"


ORACLES = {
    "slice_mask": f"WITH {P} SELECT node_id, z FROM p WHERE abs(z - 0e0) < 0.05e0",
    "range_mask": f"WITH {P} SELECT node_id, x FROM p WHERE x > -0.1e0 AND x < 0.1e0",
    "line_mask": f"WITH {P} SELECT node_id, x, z FROM p WHERE abs(x) <= 0.08e0 AND abs(z) <= 0.08e0",
    "cylinder_filter": f"WITH {P} SELECT node_id, x, y, z FROM p WHERE x * x + y * y > 0.05e0 * 0.05e0 - 1e-4 AND x * x + y * y < 0.2e0 * 0.2e0 + 1e-4 AND abs(z) < 0.1e0 + 1e-4",
    "cylinder_boundary": f"WITH {P} SELECT node_id, sqrt(x * x + y * y) > 0.25e0 - 0.02e0 OR sqrt(x * x + y * y) < 0.02e0 + 0.02e0 OR z > 0.2e0 - 0.02e0 OR z < -0.2e0 + 0.02e0 AS is_boundary FROM p",
    "box_boundary": f"WITH {P} SELECT node_id, greatest(x, y, z) > 0.2e0 - 0.02e0 OR least(x, y, z) < -0.2e0 + 0.02e0 AS is_boundary FROM p",
    "polar_coordinates": f"WITH {P} SELECT node_id, round(sqrt(x * x + y * y), 6) AS r, round(atan2(y, x), 6) AS phi, round({PHI}, 6) AS phi_mod FROM p",
    "azimuth_chunks": f"""WITH {P}, a AS (SELECT node_id, {PHI} AS f FROM p), h AS (SELECT *, least(floor(f / (2 * pi() / 8)), 7) AS home FROM a)
        SELECT DISTINCT node_id, c AS chunk, c = home AS own FROM (
            SELECT node_id, home, CAST(unnest([home, CASE WHEN f - home * (2 * pi() / 8) < 0.05e0 THEN (home + 7) % 8 END, CASE WHEN (home + 1) * (2 * pi() / 8) - f <= 0.05e0 THEN (home + 1) % 8 END]) AS BIGINT) AS c FROM h) WHERE c IS NOT NULL""",
    "overlap_zone": f"""WITH {P} SELECT DISTINCT node_id FROM p CROSS JOIN range(33) t(k)
        WHERE ((atan2(y, x) + pi() - k * (2 * pi() / 32) + 0.01e0) % (2 * pi()) + 2 * pi()) % (2 * pi()) < 2 * 0.01e0""",
    "display_projection": f"WITH {P} SELECT node_id, round(log10(density), 6) AS log_density, round(asinh(temperature), 6) AS asinh_temperature FROM p",
    "region_class": f"WITH {GRID}, {cells(0.5)} SELECT node_id, CAST(CASE WHEN inn THEN 1 WHEN ix % 3 = 0 THEN 2 ELSE 0 END AS BIGINT) AS region FROM cells",
    "pixel_clean": f"WITH {GRID} SELECT node_id, CASE WHEN node_id % 5 IN (0, 1) THEN 0.0 ELSE v END::DOUBLE AS v FROM grid",
    "valid_pixels": f"WITH {PIXELS} SELECT node_id, iy, ix FROM grid WHERE v > 0",
    "pixel_edges_valid": f"WITH {PIXELS}, {edges()} SELECT src, dst FROM e",
    "pixel_edges_all": f"WITH {GRID}, lim AS (SELECT max(iy) + 1 AS h, max(ix) + 1 AS w FROM grid), every AS (SELECT n AS node_id, n // w AS iy, n % w AS ix FROM lim, range((SELECT h * w FROM lim)) t(n)), {edges(of='every')} SELECT src, dst FROM e",
    "radius_edges": f"WITH {P}, {RADIUS_E} SELECT src, dst FROM e",
    "edge_length_filter": f"""WITH {P} SELECT a.node_id AS src, b.node_id AS dst FROM p a JOIN p b ON b.node_id = a.node_id + 1
        WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.25e0 * 0.25e0""",
    "edge_canonical": f"WITH {SUPPLY} SELECT src, dst FROM e",
    "adjacency": f"WITH {GRID}, {edges()}, {both()} SELECT node, nbr FROM adj",
    "degree": f"WITH {SUPPLY}, {both()} SELECT node, count(*) AS degree FROM adj GROUP BY 1",
    "id_lookup": "SELECT l_partkey AS src, l_suppkey AS dst, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) AND l_suppkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2",
    "chunk_membership": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= '1998-01-01')",
    "chunk_last_wins": "SELECT l_partkey AS node_id, arg_max(l_quantity, row(l_orderkey, l_linenumber)) AS score FROM lineitem GROUP BY 1",
    "induced_edges": f"WITH {GRID}, {cells(0.5)}, {INNER}, {edges(of='inn')} SELECT src, dst FROM e",
    "rz_profile": f"WITH {P}, {binned('density')} SELECT r_bin, z_bin, round(mass, 6) AS mass, round(mean, 6) AS mean FROM prof",
    "profile_normalised": f"WITH {P}, {binned('temperature')} SELECT node_id, round(log_ratio, 6) + 0e0 AS log_ratio FROM ratio",
    "scaled_features": f"""WITH {P}, f AS (WITH {binned("density")} SELECT node_id, (log_ratio - center) / scale AS f0 FROM ratio, {scaled("ratio", "log_ratio")}),
        g AS (WITH {binned("temperature")} SELECT node_id, (log_ratio - center) / scale AS f1 FROM ratio, {scaled("ratio", "log_ratio")})
        SELECT node_id, round(f0, 6) + 0e0 AS f0, round(f1, 6) + 0e0 AS f1 FROM f JOIN g USING (node_id)""",
    "robust_scale": f"WITH {P}, q AS (SELECT node_id, ln(density) AS q FROM p) SELECT node_id, round((q - center) / scale, 6) + 0e0 AS scaled FROM q, {scaled('q', 'q')}",
    "robust_scale_by_group": """WITH s AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS center, quantile_cont(l_quantity, 0.75) - quantile_cont(l_quantity, 0.25) AS scale FROM lineitem GROUP BY 1)
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_quantity - center) / CASE WHEN scale = 0 THEN 1 ELSE scale END, 6) + 0e0 AS scaled FROM lineitem JOIN s USING (l_returnflag)""",
    "scaler_reuse": f"""WITH {P}, q AS (SELECT node_id, ln(density) AS q, ln(density * temperature) AS later FROM p)
        SELECT node_id, round((later - center) / scale, 6) + 0e0 AS scaled FROM q, {scaled("q", "q")}""",
    "saved_features": f"""WITH {P}, {binned("density")} SELECT k.node_id, round((ln(density * temperature / mean) - center) / scale, 6) + 0e0 AS f0
        FROM k JOIN prof USING (r_bin, z_bin), {scaled("ratio", "log_ratio")}""",
    "phase_space_hist": """SELECT CAST(least(floor((l_quantity - 0e0) / ((50e0 - 0e0) / 11)), 10) AS BIGINT) AS bx, CAST(least(floor((l_discount - (-0.005e0)) / ((0.105e0 - (-0.005e0)) / 11)), 10) AS BIGINT) AS by, count(*) AS n
        FROM lineitem WHERE l_quantity BETWEEN 0 AND 50 AND l_discount BETWEEN -0.005e0 AND 0.105e0 GROUP BY 1, 2""",
    "component_ids": f"""WITH RECURSIVE {GRID}, {cells(0.5)}, {INNER}, {edges()}, {both()}, {reached("inn", "adj", "c")},
        n AS (SELECT component, row_number() OVER (ORDER BY component) - 1 AS cid FROM c GROUP BY 1 HAVING count(*) >= 2) SELECT cid, node_id FROM c JOIN n USING (component)""",
    "component_medians": f"""WITH RECURSIVE {GRID}, {cells(0.5)}, {INNER}, {edges()}, {both()}, {reached("inn", "adj", "c")}
        SELECT component, count(*) AS n, median(v) AS median_v FROM c JOIN inn USING (node_id) GROUP BY 1""",
    "component_sizes": f"WITH RECURSIVE {PIXELS}, {cells(1.0)}, {INNER}, {edges(CROSS, 'inn')}, {both()}, {reached('inn', 'adj', 'c')} SELECT component, count(*) AS n FROM c GROUP BY 1",
    "peel_once": f"WITH {ORDERS}, {CALM}, {edges()}, {both()}, {INNER}, {peeled('inn', 's')} SELECT node_id FROM s",
    "peel_levels": f"""{LEVELS} SELECT inn.node_id, CAST(CASE WHEN s1.node_id IS NULL THEN 1 WHEN s2.node_id IS NULL THEN 2 ELSE 3 END AS BIGINT) AS iter_label
        FROM inn LEFT JOIN s1 ON s1.node_id = inn.node_id LEFT JOIN s2 ON s2.node_id = inn.node_id""",
    "lineage_edges": f"{LEVELS} SELECT CAST(piter AS BIGINT) AS parent_iter, pcid AS parent_cid, CAST(iter AS BIGINT) AS iter, cid FROM up",
    "lineage_seeds": f"""{LEVELS}, step AS (SELECT *, count(*) OVER (PARTITION BY piter, pcid) AS n FROM up),
        nodes AS (SELECT 0 AS iter, cid FROM n0 UNION ALL SELECT 1, cid FROM n1 UNION ALL SELECT 2, cid FROM n2),
        leaves AS (SELECT * FROM nodes ANTI JOIN up ON up.piter = nodes.iter AND up.pcid = nodes.cid),
        climb AS (SELECT l.iter, l.cid, coalesce(s.n, 0) > 1 AS invalid FROM leaves l LEFT JOIN step s ON s.iter = l.iter AND s.cid = l.cid
            UNION ALL SELECT s.piter, s.pcid, c.invalid FROM climb c JOIN step s ON s.iter = c.iter AND s.cid = c.cid AND s.n = 1)
        SELECT CAST(iter AS BIGINT) AS iter, cid, bool_or(invalid) AS invalid FROM climb c WHERE NOT EXISTS (SELECT 1 FROM step s WHERE s.iter = c.iter AND s.cid = c.cid AND s.n = 1) GROUP BY 1, 2""",
    "valid_components": f"""WITH RECURSIVE {ORDERS}, {CALM}, {INNER}, {edges(CROSS)}, {both()}, {reached("inn", "adj", "c")},
        hit AS (SELECT DISTINCT component FROM c JOIN cells USING (node_id) WHERE v > (SELECT max(v) * 0.97e0 FROM cells)), {numbered("hit", "n")} SELECT cid, node_id FROM c JOIN n USING (component) WHERE (SELECT count(*) FROM n) > 1""",
    "mode_neighbour": f"WITH {GRID_GRAPH}, {HALVES.replace('halves', 'groups', 1)}, {MODE} SELECT * FROM best",
    "mode_supplier_nation": f"WITH {SUPPLY}, {both()}, groups AS (SELECT -s_suppkey - 1 AS node_id, CAST(s_nationkey AS BIGINT) AS group_id FROM supplier), {MODE} SELECT * FROM best",
    "grow_wave": f"""WITH {GRID_GRAPH}, {HALVES.replace("halves", "groups", 1)}, {MODE}
        SELECT node AS node_id, mode_group AS group_id FROM best WHERE node IN (SELECT node_id FROM cells WHERE NOT inn) AND total >= 2 AND ((groups = 1 AND n >= 2) OR n >= 3)""",
    "merge_contacts": f"WITH {GRID_GRAPH}, {HALVES}, {CONTACTS} SELECT group_id, other, n FROM near",
    "merge_decisions": f"""WITH {GRID_GRAPH}, {HALVES}, {CONTACTS},
        size AS (SELECT group_id, count(*) AS size, count(*) FILTER (WHERE ix IN (0, 23)) AS edge FROM halves JOIN cells USING (node_id) GROUP BY 1),
        s AS (SELECT size.group_id, any_value(size) AS size, any_value(edge) AS edge, CAST(coalesce(sum(n), 0) AS BIGINT) AS neighbours, CAST(coalesce(sum(n) FILTER (WHERE other IS NOT NULL), 0) AS BIGINT) AS touching,
            arg_max(other, row(n, -other)) FILTER (WHERE other IS NOT NULL) AS top FROM size LEFT JOIN near ON near.group_id = size.group_id GROUP BY 1)
        SELECT group_id, size, neighbours, touching, CASE WHEN touching = 0 THEN NULL WHEN (touching + edge) / neighbours::DOUBLE >= 0.3e0 THEN top ELSE group_id END AS target FROM s""",
    "merge_all": f"WITH RECURSIVE {GRID_GRAPH}, {BLOCKS}, h0 AS (SELECT * FROM blocks), skip0 AS (SELECT 0 AS group_id), {', '.join(merge_round(k) for k in range(7))} SELECT node_id, group_id FROM h7",
    "group_stats": f"WITH {GRID}, {cells(0.5)} SELECT iy % 7 AS group_id, count(*) AS size, median(v) AS median_v, count(*) FILTER (WHERE ix IN (0, 23)) AS boundary FROM cells WHERE inn GROUP BY 1",
    "directed_edges": f"WITH {GRID}, {edges()} SELECT CASE WHEN a.v >= b.v THEN src ELSE dst END AS node, CASE WHEN a.v >= b.v THEN dst ELSE src END AS nbr FROM e JOIN grid a ON a.node_id = src JOIN grid b ON b.node_id = dst",
    "directed_edges_density_temperature": f"""WITH {P}, {RADIUS_E}, d AS (SELECT src, dst, a.density >= b.density AND a.temperature <= b.temperature AS f, b.density >= a.density AND b.temperature <= a.temperature AS g
        FROM e JOIN p a ON a.node_id = src JOIN p b ON b.node_id = dst) SELECT CASE WHEN f THEN src ELSE dst END AS node, CASE WHEN f THEN dst ELSE src END AS nbr FROM d WHERE f OR g""",
    "shell_reach": f"""WITH {GRID_GRAPH}, {HALVES}, a AS (SELECT DISTINCT nbr AS n FROM adj WHERE node IN (SELECT node_id FROM halves WHERE group_id = 0)), b AS (SELECT DISTINCT nbr AS n FROM adj WHERE node IN (SELECT n FROM a))
        SELECT DISTINCT nbr AS node_id FROM adj WHERE node IN (SELECT n FROM b)""",
    "shell_round": f"""WITH {GRID_GRAPH}, {HALVES},
        d AS (SELECT CASE WHEN a.v >= b.v THEN src ELSE dst END AS node, CASE WHEN a.v >= b.v THEN dst ELSE src END AS nbr FROM e JOIN grid a ON a.node_id = src JOIN grid b ON b.node_id = dst),
        s AS (SELECT node, h.group_id, count(*) AS n FROM d JOIN halves h ON h.node_id = d.nbr WHERE node IN (SELECT node_id FROM cells WHERE NOT inn) GROUP BY 1, 2)
        SELECT node AS node_id, arg_max(group_id, row(n, -group_id)) AS group_id FROM s GROUP BY 1""",
    "erosion": f"""WITH {ORDERS}, {CALM}, {INNER} SELECT node_id, iy, ix FROM inn WHERE NOT EXISTS (SELECT 1 FROM (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) s(dy, dx)
        WHERE inn.iy + dy BETWEEN 0 AND (SELECT max(iy) FROM grid) AND inn.ix + dx BETWEEN 0 AND 127 AND (inn.iy + dy) * 128 + inn.ix + dx NOT IN (SELECT node_id FROM inn))""",
    "dilation": f"""WITH {GRID}, {cells(0.5)} SELECT DISTINCT c.iy + y.d AS iy, c.ix + x.d AS ix FROM cells c CROSS JOIN range(-2, 3) y(d) CROSS JOIN range(-2, 3) x(d)
        WHERE inn AND abs(y.d) + abs(x.d) <= 2 AND c.iy + y.d BETWEEN 0 AND (SELECT max(iy) FROM grid) AND c.ix + x.d BETWEEN 0 AND 23""",
    "small_holes": f'{HOLES} SELECT cells.node_id, inn OR count(*) OVER (PARTITION BY component) < 4 AND component IS NOT NULL AS "inner" FROM cells LEFT JOIN c ON c.node_id = cells.node_id',
    "fill_holes": f"""{HOLES}, open AS (SELECT DISTINCT component FROM c JOIN cells USING (node_id) WHERE iy IN (0, (SELECT max(iy) FROM raw)) OR ix IN (0, 23))
        SELECT cells.node_id, inn OR component NOT IN (SELECT component FROM open) AS "inner" FROM cells LEFT JOIN c ON c.node_id = cells.node_id""",
    "gaussian_norm": f"WITH {RAW}, {FULL}, {smooth(1, 's')} SELECT node_id, round(v, 6) AS v FROM s",
    "multiscale_mean": f"WITH {RAW}, {FULL}, {smooth(1, 's')}, {smooth(2, 't')} SELECT s.node_id, round((s.v + t.v) / 2, 6) AS v FROM s JOIN t ON t.node_id = s.node_id",
    "gaussian_norm_shipping": f"WITH {WEEKS}, {smooth(1, 's', 64)}, {smooth(2, 't', 64)} SELECT node_id, 1::BIGINT AS sigma, round(v, 6) AS v FROM s UNION ALL SELECT node_id, 2, round(v, 6) FROM t",
    "multiscale_mean_shipping": f"WITH {WEEKS}, {smooth(1, 's', 64)}, {smooth(2, 't', 64)} SELECT s.node_id, round((s.v + t.v) / 2, 6) AS v FROM s JOIN t ON t.node_id = s.node_id",
    "max_over_scales": "SELECT l_partkey AS node_id, max(l_extendedprice) AS score FROM lineitem GROUP BY 1",
    "align_moments": f"WITH {GRID}, {cells(0.5)} SELECT round(var_samp(iy), 6) AS syy, round(var_samp(ix), 6) AS sxx, round(covar_samp(iy, ix), 6) AS sxy FROM cells WHERE inn",
    "nonzero_bbox": f'WITH {PIXELS}, {cells(-2.0)} SELECT min(iy) AS top, max(iy) AS bottom, min(ix) AS "left", max(ix) AS "right" FROM cells WHERE NOT inn',
    "graphconv_mean": f"WITH {P}, {RADIUS_E}, {both()}, {MEANS} SELECT node_id, round(m1, 6) AS mean_density, round(m2, 6) AS mean_temperature FROM m",
    "gnn_softmax": SOFTMAX,
    "classify_particles": on_features(SOFTMAX.replace(f"WITH {P}, ", f"WITH {P}, {SCALED}, ", 1)).replace(f"round({SCORE}, 6) AS score FROM o", f'round({SCORE}, 6) AS score, {SCORE} > 0.5 AS "inner" FROM o'),
    "chunk_members": f"WITH {P}, {HELD} SELECT chunk, node_id FROM held",
    "classify_chunk_tables": CHUNKED + ' SELECT node_id, round(coalesce(s, 0e0), 6) AS score, coalesce(s, 0e0) > 0.5 AS "inner" FROM p LEFT JOIN won USING (node_id)',
    "chunk_scores_cached": CHUNKED + ' SELECT node_id, round(coalesce(s, 0e0), 6) AS score, coalesce(s, 0e0) > 0.9 AS "inner" FROM p LEFT JOIN won USING (node_id)',
    "classify_event_raster": IMAGE,
    "preprocessed_event_raster": f"""WITH {RAW}, {FULL}, {smooth(1, 's')}, {smooth(2, 't')} SELECT 'composed' AS mode, s.node_id, 0::BIGINT AS sigma, round((s.v + t.v) / 2, 6) AS v FROM s JOIN t ON t.node_id = s.node_id
        UNION ALL SELECT 'max', node_id, 1, round(v, 6) FROM s UNION ALL SELECT 'max', node_id, 2, round(v, 6) FROM t""",
    "raster_from_arrays": """SELECT vec_id * (SELECT max(len(embedding)) FROM embeddings) + k - 1 AS node_id, vec_id AS iy, k - 1 AS ix, round(embedding[k]::DOUBLE, 6) AS v
        FROM embeddings, unnest(range(1, len(embedding) + 1)) t(k)""",
    "chunk_edges_merged": f"""WITH {P}, a AS (SELECT node_id, {PHI} AS f FROM p), h AS (SELECT *, least(floor(f / (2 * pi() / 8)), 7) AS home FROM a),
        held AS (SELECT DISTINCT node_id, c AS chunk FROM (
            SELECT node_id, CAST(unnest([home, CASE WHEN f - home * (2 * pi() / 8) < 0.05e0 THEN (home + 7) % 8 END, CASE WHEN (home + 1) * (2 * pi() / 8) - f <= 0.05e0 THEN (home + 1) % 8 END]) AS BIGINT) AS c FROM h) WHERE c IS NOT NULL),
        zone AS (SELECT DISTINCT node_id FROM p CROSS JOIN range(9) t(k) WHERE ((atan2(y, x) + pi() - k * (2 * pi() / 8) + 0.05e0) % (2 * pi()) + 2 * pi()) % (2 * pi()) < 2 * 0.05e0),
        short AS (SELECT s.node_id AS src, d.node_id AS dst FROM held s JOIN held d ON d.node_id = s.node_id + 1 AND d.chunk = s.chunk JOIN p a ON a.node_id = s.node_id JOIN p b ON b.node_id = d.node_id
            WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < 0.25e0 * 0.25e0)
        SELECT src, dst FROM short WHERE src NOT IN (SELECT node_id FROM zone) AND dst NOT IN (SELECT node_id FROM zone)
        UNION ALL (SELECT DISTINCT src, dst FROM short WHERE src IN (SELECT node_id FROM zone) OR dst IN (SELECT node_id FROM zone))""",
    "fits_region": f"""WITH {GRID}, t AS (SELECT iy - 3 AS iy, ix - 5 AS ix, v FROM range((SELECT max(iy) + 1 FROM grid)) a(iy) CROSS JOIN range(24) b(ix) LEFT JOIN grid USING (iy, ix)
        WHERE iy BETWEEN 3 AND (SELECT max(iy) - 2 FROM grid) AND ix BETWEEN 5 AND 19) SELECT iy * 15 + ix AS node_id, iy, ix, v FROM t""",
    "fits_whole": f"WITH {PIXELS} SELECT t.n AS node_id, t.n // 64 AS iy, t.n % 64 AS ix, coalesce(v, 0.0)::DOUBLE AS v FROM range((SELECT (max(iy) + 1) * 64 FROM grid)) t(n) LEFT JOIN grid ON grid.node_id = t.n",
    "display_relabel": f"WITH s0 AS (SELECT o_orderkey, o_custkey = 0 AS zero, (SELECT max(c_custkey) + 1 FROM customer) AS n, o_custkey AS x FROM orders), {swapped(7)}",
    "line_profile": f"WITH {P}, {reduced('SELECT node_id, y AS pos, log10(density) AS v, temperature AS c FROM p WHERE abs(x) <= 0.15e0 AND abs(z) <= 0.15e0', 40, 6)}",
    "line_profile_orders": f"WITH {reduced('SELECT o_orderkey AS node_id, o_orderkey::DOUBLE AS pos, o_totalprice AS v, o_custkey AS c FROM orders', 500, 4)}",
    "chunk_store": f"""WITH {P}, {HELD}, n AS (SELECT home AS section, count(*) AS own, count(*) FILTER (WHERE density > 1) AS dense FROM homes JOIN p USING (node_id) GROUP BY 1), halo AS (SELECT chunk, count(*) AS n FROM held GROUP BY 1)
        SELECT 151::BIGINT AS snapshot, CAST(section AS BIGINT) AS section, round(section * (2 * pi() / 8) - pi(), 6) AS low, round((section + 1) * (2 * pi() / 8) - pi(), 6) AS high,
            CAST(CASE section WHEN 2 THEN dense WHEN 3 THEN halo.n ELSE own END AS BIGINT) AS n, true AS complete FROM n JOIN halo ON chunk = section""",
    "chunk_store_first": f"WITH {P}, {HELD} SELECT chunk, held.node_id, chunk = home AS own FROM held JOIN homes USING (node_id) WHERE chunk < 2",
    "gnn_sigmoid": SIGMOID,
}
