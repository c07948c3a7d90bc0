"""SQL of the registered queries: shared table expressions and one statement for each query."""

from __future__ import annotations




def q(x: str) -> str:
    return f"CAST(round(({x}) * 1000000) AS BIGINT)"


G = """g AS (
    SELECT vec_id AS r, CAST(unnest(range(len(embedding))) AS BIGINT) AS c, unnest(list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 1000) + 1000)) AS z FROM embeddings
), sz AS (SELECT max(r) + 1 AS ny, max(c) + 1 AS nx FROM g)"""

NB = (
    G
    + """, h AS (
    SELECT *, lag(z) OVER p AS w0, lead(z) OVER p AS e0 FROM g WINDOW p AS (PARTITION BY r ORDER BY c)
), nb AS (
    SELECT r, c, z, e0 AS e, w0 AS w, lag(z) OVER p AS n, lead(z) OVER p AS s, lag(w0) OVER p AS nw, lag(e0) OVER p AS ne, lead(w0) OVER p AS sw, lead(e0) OVER p AS se
    FROM h WINDOW p AS (PARTITION BY c ORDER BY r)
)"""
)

_CHOICES = {1: ("z - e", "c <= nx - 3"), 2: ("(z - se) / 1.41", "r <= ny - 3 AND c <= nx - 3"), 4: ("z - s", "r <= ny - 3"), 8: ("(z - sw) / 1.41", "r <= ny - 3 AND c BETWEEN 1 AND nx - 2"), 16: ("z - w", "c BETWEEN 1 AND nx - 2"), 32: ("(z - nw) / 1.41", "r BETWEEN 1 AND ny - 2 AND c BETWEEN 1 AND nx - 2"), 64: ("z - n", "r BETWEEN 1 AND ny - 2"), 128: ("(z - ne) / 1.41", "r BETWEEN 1 AND ny - 2 AND c <= nx - 3")}

D8 = (
    NB
    + ", ch AS ("
    + " UNION ALL ".join(f"SELECT r, c, z, {code} AS code, CASE WHEN {ok} THEN {drop} ELSE CAST(-1e22 AS DOUBLE) END AS drop FROM nb, sz" for code, (drop, ok) in _CHOICES.items())
    + """), d8 AS (
    SELECT r, c, z, code FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY drop DESC NULLS LAST, code DESC) AS k FROM ch) WHERE k = 1
), dirs(code, dr, dc) AS (VALUES (1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1)
), e0 AS (
    SELECT r * nx + c AS src, (r + dr) * nx + c + dc AS dst, code, r, c, r + dr AS r2, c + dc AS c2, z, CASE WHEN code IN (2, 8, 32, 128) THEN CAST(1.41421356 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS scale
    FROM d8 JOIN dirs USING (code), sz WHERE r + dr BETWEEN 0 AND ny - 1 AND c + dc BETWEEN 0 AND nx - 1
), ed AS (
    SELECT e0.*, g.z AS z2, g.z < e0.z OR (g.z = e0.z AND e0.dst > e0.src) AS fwd FROM e0 JOIN g ON g.r = e0.r2 AND g.c = e0.c2
)"""
)

#: Walks over forward edges: every cell a with each cell b it passes, and the length of the way.
WALK = """, walk AS (
    SELECT src AS a, dst AS b, CAST(30 * scale AS DOUBLE) AS l FROM ed WHERE fwd
    UNION ALL SELECT walk.a, ed.dst, walk.l + 30 * ed.scale FROM walk JOIN ed ON ed.src = walk.b AND ed.fwd
)"""

AREA = (
    WALK
    + """, pu AS (
    SELECT r * nx + c AS id, 900.0 * (1 + coalesce(k, 0)) AS a FROM g CROSS JOIN sz LEFT JOIN (SELECT b, count(*) AS k FROM walk GROUP BY b) w ON w.b = g.r * nx + g.c
), ar AS (
    SELECT pu.id, CAST(pu.a + coalesce(x.a, 0) AS DOUBLE) AS a FROM pu LEFT JOIN (SELECT dst, sum(a) AS a FROM ed JOIN pu ON pu.id = ed.src WHERE NOT fwd GROUP BY dst) x ON x.dst = pu.id
)"""
)

LENGTH = (
    WALK
    + """, ml AS (
    SELECT r * nx + c AS id, coalesce(l, 0) AS l FROM g CROSS JOIN sz LEFT JOIN (SELECT b, max(l) AS l FROM walk GROUP BY b) w ON w.b = g.r * nx + g.c
), th AS (SELECT ed.dst, ed.src, ed.z, ed.fwd, ml.l + 30 * ed.scale AS l FROM ed JOIN ml ON ml.id = ed.src
), fl AS (
    SELECT ml.id, coalesce(t.l, 0) AS l, t.src AS donor, t.fwd FROM ml LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY round(l, 6) DESC, z DESC, src) AS k FROM th) WHERE k = 1) t ON t.dst = ml.id
)"""
)

OUTLETS = ", ol AS (SELECT r AS point, r * nx + c AS id FROM g, sz WHERE r % 50 = 25 AND c = 32)"
UPSTREAM = OUTLETS + ", up AS (SELECT point, id AS cell FROM ol UNION SELECT up.point, ed.src FROM up JOIN ed ON ed.dst = up.cell)"
CHI = (
    AREA
    + OUTLETS
    + """, cx AS (
    SELECT ol.id AS cell, CAST(pow(100000.0 / a, 0.45) * 30 AS DOUBLE) AS chi FROM ol JOIN ar ON ar.id = ol.id
    UNION ALL
    SELECT ed.src, cx.chi + pow(100000.0 / ar.a, 0.45) * 30 * CASE WHEN code IN (2, 8, 32, 128) THEN 1.414 ELSE 1 END
    FROM cx JOIN ed ON ed.dst = cx.cell JOIN ar ON ar.id = ed.src WHERE ed.src NOT IN (SELECT id FROM ol)
), ck AS (SELECT r, c, coalesce(chi, 0) AS chi FROM g CROSS JOIN sz LEFT JOIN (SELECT cell, max(chi) AS chi FROM cx GROUP BY cell) k ON k.cell = g.r * nx + g.c)"""
)
DIVIDES = """, dv AS (
    SELECT g.r, g.c, CASE WHEN f.dst IS NULL AND g.r BETWEEN 1 AND ny - 3 AND g.c BETWEEN 1 AND nx - 3 THEN 1 ELSE 0 END AS v
    FROM g CROSS JOIN sz LEFT JOIN (SELECT DISTINCT dst FROM ed) f ON f.dst = g.r * nx + g.c
), pd AS (
    SELECT ed.r, ed.c, 2 * ed.r - ed.r2 AS r3, 2 * ed.c - ed.c2 AS c3 FROM ed JOIN dv ON dv.r = ed.r AND dv.c = ed.c AND v = 1 CROSS JOIN sz
    WHERE 2 * ed.r - ed.r2 BETWEEN 0 AND ny - 1 AND 2 * ed.c - ed.c2 BETWEEN 0 AND nx - 1
)"""

_EDGE = {k: f"coalesce({k}, z)" for k in "eswn"}
_SX, _SY = f"(({_EDGE['e']} - {_EDGE['w']}) / 60.0)", f"(({_EDGE['s']} - {_EDGE['n']}) / 60.0)"


def _grad(before: str, after: str, z: str = "z") -> str:
    return f"CASE WHEN {before} IS NOT NULL AND {after} IS NOT NULL THEN ({after} - {before}) / 60.0 WHEN {after} IS NOT NULL THEN ({after} - {z}) / 30.0 ELSE ({z} - {before}) / 30.0 END"


def _kernel(condition: str, span: str) -> str:
    return f"o AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM range({span}) a(i), range({span}) b(j) WHERE {condition})"


def cells(value: str, source: str = "nb", ctes: str = NB, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}{extra} SELECT r AS \"row\", c AS col, {value} FROM {source}"


_FXY = "fx AS (SELECT *, (e - w) / 60.0 AS fx, (s - n) / 60.0 AS fy, (e - z * 2 + w) / 900.0 AS fxx, (s - z * 2 + n) / 900.0 AS fyy, (se - ne - sw + nw) / 3600.0 AS fxy FROM nb)"

_PRINCIPAL = f""", one AS (SELECT r, c, z, {_grad('w', 'e')} AS zx, {_grad('n', 's')} AS zy FROM nb
), a AS (SELECT *, lag(zx) OVER p AS w1, lead(zx) OVER p AS e1 FROM one WINDOW p AS (PARTITION BY r ORDER BY c)
), b AS (SELECT *, lag(zx) OVER p AS n1, lead(zx) OVER p AS s1, lag(zy) OVER p AS n2, lead(zy) OVER p AS s2 FROM a WINDOW p AS (PARTITION BY c ORDER BY r)
), d AS (SELECT r, c, zx, zy, {_grad('w1', 'e1', 'zx')} AS zxx, {_grad('n1', 's1', 'zx')} AS zxy, {_grad('n2', 's2', 'zy')} AS zyy FROM b
), hk AS (SELECT r, c, -((zx * zx + 1) * zyy - zx * zy * zxy * 2 + (zy * zy + 1) * zxx) / (pow(zx * zx + zy * zy + 1, 1.5) * 2) AS hm, (zxx * zyy - zxy * zxy) / ((zx * zx + zy * zy + 1) * (zx * zx + zy * zy + 1)) AS hg FROM d)"""

_POINTS = "pt AS (SELECT r AS point, r, c FROM g WHERE r % 50 = 25 AND c = 32)"
_NEAR = f"{_kernel('i * i + j * j <= 25', '-5, 5')}, {_POINTS}, nr AS (SELECT point, g.r, g.c, g.z FROM pt CROSS JOIN o JOIN g ON g.r = pt.r + i AND g.c = pt.c + j)"

_BAND = "CAST(z BETWEEN 950 AND 1050 AS INTEGER)"


def _morph(dilate: bool, times: int, source: str = "m0") -> str:
    out, at = "", source
    f = "greatest" if dilate else "least"
    for t in range(times):
        name = f"{source}{'d' if dilate else 'e'}{t}"
        out += f""", {name} AS (SELECT r, c, {f}(v, coalesce(lag(v) OVER a, 0), coalesce(lead(v) OVER a, 0), coalesce(lag(v) OVER b, 0), coalesce(lead(v) OVER b, 0)) AS v
        FROM {at} WINDOW a AS (PARTITION BY r ORDER BY c), b AS (PARTITION BY c ORDER BY r))"""
        at = name
    return out


_RELIEF_ORDER = """, ahead AS MATERIALIZED (SELECT id, donor FROM fl WHERE fwd
), hd AS (SELECT id AS cell, id AS top, 0 AS n FROM fl UNION ALL SELECT hd.cell, ahead.donor, hd.n + 1 FROM hd JOIN ahead ON ahead.id = hd.top
), tp AS (SELECT cell, arg_max(top, n) AS top FROM hd GROUP BY cell
), late AS (SELECT fl.id AS cell, tp.top FROM fl JOIN tp ON tp.cell = fl.donor WHERE NOT fwd)"""

ORACLE: dict[str, str] = {
    "grid_scan": cells("CAST(z AS BIGINT) AS v", "g", G),
    "xy_coords": cells("CAST(c * 30 AS BIGINT) AS x, CAST((ny - 1 - r) * 30 AS BIGINT) AS y", "g, sz", G),
    "xy_to_cell": f"WITH {G} SELECT event_id, CAST(ny - 1 - round_even(CAST(value AS DOUBLE) * 10 / 30, 0) AS BIGINT) AS \"row\", CAST(round_even((event_id % 2000) / 30.0, 0) AS BIGINT) AS col FROM events, sz WHERE value IS NOT NULL AND round_even(CAST(value AS DOUBLE) * 10 / 30, 0) BETWEEN 0 AND ny - 1 AND round_even((event_id % 2000) / 30.0, 0) BETWEEN 0 AND nx - 1",
    "geo_pixel_area": f"WITH {G} SELECT DISTINCT r AS \"row\", CAST(round(6371000.0 * 6371000.0 * radians(0.01) * abs(sin(radians((ny - 1 - r) * 0.01 + 0.005)) - sin(radians((ny - 1 - r) * 0.01 - 0.005)))) AS BIGINT) AS area FROM g, sz",
    "valid_data": cells("CASE WHEN z > 1000 THEN 1 END AS v", "g", G),
    "areas_greater_than": cells("CAST(a AS BIGINT) AS area", "g CROSS JOIN sz JOIN ar ON ar.id = r * nx + c WHERE a >= 9000", D8, AREA, True),
    "areas_between": f"WITH RECURSIVE {D8}{AREA}, dn AS (SELECT dst, max(a) AS top FROM ed JOIN ar ON ar.id = src GROUP BY dst) SELECT r AS \"row\", c AS col FROM g CROSS JOIN sz JOIN ar ON ar.id = r * nx + c LEFT JOIN dn ON dn.dst = ar.id WHERE a BETWEEN 9000 AND 90000 AND coalesce(top < 9000, true)",
    "log_area": cells(f"{q('log10(z)')} AS v", "g", G),
    "two_grid_extract": f"WITH {G}, k AS (SELECT l_partkey % 64 AS r, l_suppkey % 64 AS c, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT g.r AS \"row\", g.c AS col, CAST(z AS BIGINT) AS x, CAST(n AS BIGINT) AS y FROM g JOIN k USING (r, c) WHERE z <> 0 AND n <> 0",
    "scatter_pairs": f"WITH {G}, k AS (SELECT l_partkey % 64 AS r, l_suppkey % 64 AS c, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT g.r AS \"row\", g.c AS col, CAST(z AS BIGINT) AS x, CAST(n AS BIGINT) AS y FROM g JOIN k USING (r, c) CROSS JOIN sz WHERE (g.r * nx + g.c) % 3 = 0",
    "dem_edge": "WITH k AS (SELECT date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS d, hour(ts) AS c, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT min(d) AS d0, max(d) AS d1 FROM k), k2 AS (SELECT d - d0 AS r, c FROM k, b), f AS (SELECT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c FROM b, range(d1 - d0 + 1) t(i), range(24) u(j)), o AS (SELECT i, j FROM range(-1, 2) t(i), range(-1, 2) u(j) WHERE i <> 0 OR j <> 0), nbr AS (SELECT f.r, f.c, count(k2.r) AS n FROM f CROSS JOIN o LEFT JOIN k2 ON k2.r = f.r + i AND k2.c = f.c + j GROUP BY 1, 2) SELECT f.r AS \"row\", f.c AS col, CASE WHEN k2.r IS NOT NULL THEN CASE WHEN n < 8 THEN 1 ELSE 0 END END AS v FROM f JOIN nbr USING (r, c) LEFT JOIN k2 USING (r, c)",
    "quadrat_stats": f"WITH {G} SELECT CAST(r // 10 * 10 AS BIGINT) AS qrow, CAST(c // 8 * 8 AS BIGINT) AS qcol, CAST(sum(z) AS BIGINT) AS total, CAST(min(z) AS BIGINT) AS least, count(*) AS n FROM g, sz WHERE r // 10 * 10 <= ny - 10 AND c // 8 * 8 <= nx - 8 GROUP BY 1, 2",
    "hist2d": "WITH b AS (SELECT CASE WHEN l_quantity >= 1 AND l_quantity < 10 THEN 0 WHEN l_quantity >= 10 AND l_quantity < 25 THEN 1 WHEN l_quantity >= 25 AND l_quantity <= 50 THEN 2 END AS bx, CASE WHEN l_discount >= 0 AND l_discount < 0.03 THEN 0 WHEN l_discount >= 0.03 AND l_discount < 0.06 THEN 1 WHEN l_discount >= 0.06 AND l_discount <= 0.1 THEN 2 END AS bw FROM lineitem), f AS (SELECT CAST(i AS INTEGER) AS bx, CAST(j AS INTEGER) AS bw FROM range(3) t(i), range(3) u(j)) SELECT f.bx, f.bw AS \"by\", count(b.bx) AS n FROM f LEFT JOIN b ON b.bx = f.bx AND b.bw = f.bw GROUP BY 1, 2",
    "data_extent": f"WITH {G} SELECT min(r) AS row0, max(r) AS row1, min(c) AS col0, max(c) AS col1, CAST(min(c) * 30 AS BIGINT) AS xmin, CAST(max(c) * 30 AS BIGINT) AS xmax, CAST((any_value(ny) - 1 - max(r)) * 30 AS BIGINT) AS ymin, CAST((any_value(ny) - 1 - min(r)) * 30 AS BIGINT) AS ymax FROM g, sz WHERE z > 1200",
    "hypsometric_integral": f"WITH RECURSIVE {D8}{UPSTREAM} SELECT point, {q('(avg(g.z) - min(g.z)) / nullif(max(g.z) - min(g.z), 0)')} AS hi FROM up CROSS JOIN sz JOIN g ON g.r * nx + g.c = up.cell GROUP BY point",
    "sum_of_squares": f"WITH {G} SELECT r AS \"row\", {q('var_pop(z) * count(z)')} AS ss FROM g GROUP BY r",
    "plane_fit": f"WITH {G} SELECT {q('covar_pop(z, c * 30.0) / var_pop(c * 30.0)')} AS a, {q('covar_pop(z, r * 30.0) / var_pop(r * 30.0)')} AS b FROM g",
    "disc_mean": f"WITH {G}, {_kernel('i * i + j * j <= 9', '-3, 4')} SELECT (r - i + ny) % ny AS \"row\", (c - j + nx) % nx AS col, {q('avg(z)')} AS v FROM g, sz, o GROUP BY 1, 2",
    "moving_circle_max": f"WITH {G}, {_kernel('i * i + j * j < 9', '-3, 4')} SELECT r - i AS \"row\", c - j AS col, CAST(max(z) AS BIGINT) AS v FROM g, sz, o WHERE r - i BETWEEN 0 AND ny - 1 AND c - j BETWEEN 0 AND nx - 1 GROUP BY 1, 2",
    "moving_rectangle_mean": f"WITH {G}, {_kernel('true', '-2, 3')} SELECT r - i AS \"row\", c - j AS col, {q('avg(z)')} AS v FROM g, sz, o WHERE r - i BETWEEN 0 AND ny - 1 AND c - j BETWEEN 0 AND nx - 1 GROUP BY 1, 2",
    "local_relief": f"WITH {G}, {_kernel('i * i + j * j <= 9', '-3, 3')}, f AS (SELECT r, c, CASE WHEN r + i < 0 THEN -(r + i) - 1 WHEN r + i >= ny THEN 2 * ny - 1 - (r + i) ELSE r + i END AS r2, CASE WHEN c + j < 0 THEN -(c + j) - 1 WHEN c + j >= nx THEN 2 * nx - 1 - (c + j) ELSE c + j END AS c2 FROM g, sz, o) SELECT f.r AS \"row\", f.c AS col, CAST(max(g.z) - min(g.z) AS BIGINT) AS v FROM f JOIN g ON g.r = r2 AND g.c = c2 GROUP BY 1, 2",
    "template_count": f"WITH {G}, o AS (SELECT i, j FROM range(-2, 3) t(i), range(-1, 2) u(j)) SELECT (r - i + ny) % ny AS \"row\", (c - j + nx) % nx AS col, CAST(sum({_BAND}) AS BIGINT) AS v FROM g, sz, o GROUP BY 1, 2",
    "slopes": cells(f"{q(_SX)} AS sx, {q(_SY)} AS sy"),
    "max_slope": cells(f"{q(f'sqrt({_SX} * {_SX} + {_SY} * {_SY})')} AS v"),
    "hillshade": cells(f"{q('255 * (cos(radians(45.0)) * cos(atan(sqrt(sx * sx + sy * sy))) + sin(radians(45.0)) * sin(atan(sqrt(sx * sx + sy * sy))) * cos(radians(135.0) - atan2(sy, sx)))')} AS v", "sl", NB, f", sl AS (SELECT r, c, {_SX} AS sx, {_SY} AS sy FROM nb)"),
    "laplacian": cells(f"{q('(' + ' + '.join(_EDGE.values()) + ' - z * 4) / 900.0')} AS v"),
    "contour_curvature": cells(f"{q('(fxx * fy * fy - fxy * fx * fy * 2 + fyy * fx * fx) / nullif((fx * fx + fy * fy) * sqrt(fx * fx + fy * fy + 1), 0)')} AS v", "fx", NB, ", " + _FXY),
    "principal_curvature": cells(f"{q('hm + sqrt(greatest(hm * hm - hg, 0))')} AS k1, {q('hm - sqrt(greatest(hm * hm - hg, 0))')} AS k2", "hk", NB, _PRINCIPAL),
    "gradient": cells(f"{q(_grad('w', 'e'))} AS gx, {q(_grad('n', 's'))} AS gy"),
    "gradient_scale": f"WITH {G}, s AS (SELECT r, c, lag(z, 3) OVER a AS w, lead(z, 3) OVER a AS e, lag(z, 3) OVER b AS n, lead(z, 3) OVER b AS s FROM g WINDOW a AS (PARTITION BY r ORDER BY c), b AS (PARTITION BY c ORDER BY r)) SELECT r AS \"row\", c AS col, CASE WHEN r BETWEEN 3 AND ny - 4 AND c BETWEEN 3 AND nx - 4 THEN {q('(e - w) / 210.0')} END AS gx, CASE WHEN r BETWEEN 3 AND ny - 4 AND c BETWEEN 3 AND nx - 4 THEN {q('(s - n) / 210.0')} END AS gy FROM s, sz",
    "laplacian_scale": f"WITH {G}, s AS (SELECT r, c, z, lag(z, 3) OVER a AS w, lead(z, 3) OVER a AS e, lag(z, 3) OVER b AS n, lead(z, 3) OVER b AS s FROM g WINDOW a AS (PARTITION BY r ORDER BY c), b AS (PARTITION BY c ORDER BY r)) SELECT r AS \"row\", c AS col, CASE WHEN r BETWEEN 3 AND ny - 4 AND c BETWEEN 3 AND nx - 4 THEN {q('(e + w + s + n - z * 4) / 32400.0')} END AS v FROM s, sz",
    "gradient_direction": cells(f"{q(f'sqrt(pow({_grad(chr(119), chr(101))}, 2) + pow({_grad(chr(110), chr(115))}, 2))')} AS magnitude"),
    "flow_direction_d8": cells("CAST(code AS BIGINT) AS code", "d8", D8),
    "flow_edges": f"WITH {D8} SELECT src, dst, {q('scale')} AS scale, fwd AS forward FROM ed",
    "flow_donors": f"WITH {D8} SELECT dst, count(*) AS n, CAST(sum(src) AS BIGINT) AS total FROM ed GROUP BY dst",
    "flow_code_downhill": cells("coalesce(code, 0) AS code", "nb LEFT JOIN best USING (r, c)", NB, ", ch AS (" + " UNION ALL ".join(f"SELECT r, c, {k} AS k, {code} AS code, ({drop.split(' / ')[0].strip('()') if '/' in drop else f'({drop}) / 1.41'}) AS drop FROM nb" for k, (code, (drop, _)) in enumerate(_CHOICES.items())) + "), best AS (SELECT r, c, code FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY drop DESC, k) AS n FROM ch WHERE drop > 0) WHERE n = 1)"),
    "rivertools_recode": cells("CAST(CASE WHEN code = 1 THEN 128 ELSE code // 2 END AS BIGINT) AS code", "d8", D8),
    "divides": cells("v", "dv", D8, DIVIDES),
    "channel_slope": cells(f"{q('coalesce((g.z - ed.z2) / (sqrt(pow(ed.r - ed.r2, 2) + pow(ed.c - ed.c2, 2)) * 30), 0)')} AS v", "g LEFT JOIN ed USING (r, c)", D8),
    "paired_divides": f"WITH {D8}{DIVIDES} SELECT r AS \"row\", c AS col, r3 AS other_row, c3 AS other_col FROM pd",
    "cross_divide_dchi": f"WITH RECURSIVE {D8}{CHI}{DIVIDES} SELECT ck.r AS \"row\", ck.c AS col, coalesce({q('CASE WHEN least(ck.chi, f.chi) <> 0 THEN greatest(ck.chi, f.chi) - least(ck.chi, f.chi) ELSE 0 END')}, 0) AS v FROM ck LEFT JOIN pd ON pd.r = ck.r AND pd.c = ck.c LEFT JOIN ck f ON f.r = r3 AND f.c = c3",
    "norm_dchi": f"WITH RECURSIVE {D8}{CHI}{DIVIDES} SELECT ck.r AS \"row\", ck.c AS col, coalesce({q('CASE WHEN ck.chi > 0 AND f.chi > 0 THEN (greatest(ck.chi, f.chi) - least(ck.chi, f.chi)) / ((ck.chi + f.chi) / 2) END')}, 0) AS v FROM ck LEFT JOIN pd ON pd.r = ck.r AND pd.c = ck.c LEFT JOIN ck f ON f.r = r3 AND f.c = c3",
    "sort_rank": f"WITH {G} SELECT r AS \"row\", c AS col, row_number() OVER (ORDER BY z DESC, r * nx + c) - 1 AS rank FROM g, sz",
    "nearest_value": f"WITH {G}, {_NEAR} SELECT point, r AS \"row\", c AS col FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY abs(z - 1100), r, c) AS k FROM nr) WHERE k = 1",
    "nearest_at_least": f"WITH {G}, {_NEAR} SELECT point, r AS \"row\", c AS col FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY z < 1100, abs(z - 1100), r, c) AS k FROM nr) WHERE k = 1",
    "snap_greatest": f"WITH {G}, {_NEAR} SELECT point, CAST(c * 30 AS BIGINT) AS x, CAST((ny - 1 - r) * 30 AS BIGINT) AS y FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY z DESC, r, c) AS k FROM nr), sz WHERE k = 1",
    "tile_halo": f"WITH {G}, t AS (SELECT CAST(i AS BIGINT) AS t FROM range(1000) x(i)), tl AS (SELECT a.t AS tr, b.t AS tc, least(100, ny - a.t * 100) AS h, least(40, nx - b.t * 40) AS w FROM t a, t b, sz WHERE a.t * 100 < ny AND b.t * 40 < nx), p AS (SELECT tr, tc, CAST(i AS BIGINT) AS pr, CAST(j AS BIGINT) AS pc, tr * 100 + i - 5 AS r0, tc * 40 + j - 4 AS c0 FROM tl, range(110) y(i), range(48) z(j) WHERE i < h + 10 AND j < w + 8) SELECT tc AS tile_col, tr AS tile_row, pr AS \"row\", pc AS col, CAST(z AS BIGINT) AS v FROM p, sz JOIN g ON g.r = CASE WHEN r0 < 0 THEN -r0 - 1 WHEN r0 >= ny THEN 2 * ny - 1 - r0 ELSE r0 END AND g.c = CASE WHEN c0 < 0 THEN -c0 - 1 WHEN c0 >= nx THEN 2 * nx - 1 - c0 ELSE c0 END",
    "clip_extent": f"WITH {G} SELECT r - (ny - 1 - 200 + 1) AS \"row\", c - 11 AS col, CAST(z AS BIGINT) AS v FROM g, sz WHERE r BETWEEN ny - 1 - 200 + 1 AND ny - 1 - 101 AND c BETWEEN 11 AND 49",
    "mosaic_last_wins": f"WITH {G} SELECT r AS \"row\", c AS col, CAST(CASE WHEN r BETWEEN 20 AND 39 AND c BETWEEN 10 AND 29 THEN z * 2 ELSE z END AS BIGINT) AS v FROM g",
    "upstream_cells": f"WITH RECURSIVE {D8}{UPSTREAM} SELECT point, cell FROM up",
    "upstream_mask": f"WITH RECURSIVE {D8}{UPSTREAM} SELECT g.r AS \"row\", g.c AS col, CASE WHEN k.cell IS NULL THEN 0 ELSE 1 END AS v FROM g CROSS JOIN sz LEFT JOIN (SELECT DISTINCT cell FROM up) k ON k.cell = g.r * nx + g.c",
    "basin_bounds": f"WITH RECURSIVE {D8}{UPSTREAM} SELECT point, CAST(min(cell % nx) * 30 AS BIGINT) AS xmin, CAST(max(cell % nx) * 30 AS BIGINT) AS xmax, CAST(min(ny - 1 - cell // nx) * 30 AS BIGINT) AS ymin, CAST(max(ny - 1 - cell // nx) * 30 AS BIGINT) AS ymax FROM up, sz GROUP BY point",
    "drainage_area": cells("CAST(a AS BIGINT) AS area", "g CROSS JOIN sz JOIN ar ON ar.id = r * nx + c", D8, AREA, True),
    "flow_length": cells(f"{q('l')} AS length, donor", "g CROSS JOIN sz JOIN fl ON fl.id = r * nx + c", D8, LENGTH, True),
    "relief": f"WITH RECURSIVE {D8}{LENGTH}{_RELIEF_ORDER}, gg AS MATERIALIZED (SELECT r * nx + c AS id, r, c, z FROM g, sz), fin AS (SELECT tp.cell, coalesce(late.top, tp.top) AS top FROM tp LEFT JOIN late ON late.cell = tp.cell) SELECT x.r AS \"row\", x.c AS col, CAST(t.z - x.z AS BIGINT) AS v FROM fin JOIN gg x ON x.id = fin.cell JOIN gg t ON t.id = fin.top",
    "chi": cells(f"{q('chi')} AS chi", "ck", D8, CHI, True),
    "chi_scaled_relief": f"WITH RECURSIVE {D8}{UPSTREAM}, ow AS (SELECT up.cell, max(point) AS point FROM up GROUP BY cell) SELECT g.r AS \"row\", g.c AS col, coalesce({q('(g.z - b.z) * pow(100000.0, 0.45)')}, 0) AS v FROM g CROSS JOIN sz LEFT JOIN ow ON ow.cell = g.r * nx + g.c LEFT JOIN ol ON ol.point = ow.point LEFT JOIN g b ON b.r * nx + b.c = ol.id",
    "dilate": cells("v", "m0d1", G, f", m0 AS (SELECT r, c, {_BAND} AS v FROM g)" + _morph(True, 2)),
    "erode": cells("v", "m0e0", G, f", m0 AS (SELECT r, c, {_BAND} AS v FROM g)" + _morph(False, 1)),
    "opening": cells("v", "m0e0d0", G, f", m0 AS (SELECT r, c, {_BAND} AS v FROM g)" + _morph(False, 1) + _morph(True, 1, "m0e0")),
    "mask_flood": f"WITH RECURSIVE {G}{OUTLETS}, open AS (SELECT r * nx + c AS id, r, c FROM g, sz WHERE z >= 1000 OR (r % 50 = 25 AND c = 32)), wet AS (SELECT open.* FROM open JOIN ol USING (id) UNION SELECT o.* FROM wet JOIN open o ON o.r BETWEEN wet.r - 1 AND wet.r + 1 AND o.c BETWEEN wet.c - 1 AND wet.c + 1) SELECT g.r AS \"row\", g.c AS col, CASE WHEN wet.id IS NULL THEN 0 ELSE 1 END AS v FROM g CROSS JOIN sz LEFT JOIN wet ON wet.id = g.r * nx + g.c",
    "outlet_upsert": "SELECT prefix, name, CAST(x AS BIGINT) AS x FROM (SELECT *, row_number() OVER (PARTITION BY prefix, name ORDER BY k DESC) AS n FROM (SELECT r_name AS prefix, n_name AS name, n_nationkey AS x, 0 AS k FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, n_name, n_nationkey + 100, 1 FROM nation JOIN region ON r_regionkey = n_regionkey WHERE n_regionkey = 1)) WHERE n = 1",
    "ks_regression": f"WITH RECURSIVE {D8}{AREA}{OUTLETS}, cx AS (SELECT ol.point, ol.id AS cell, CAST(0 AS DOUBLE) AS chi, g.z AS z0 FROM ol CROSS JOIN sz JOIN g ON g.r * nx + g.c = ol.id UNION ALL SELECT cx.point, ed.src, cx.chi + pow(100000.0 / ar.a, 0.45) * 30 * CASE WHEN code IN (2, 8, 32, 128) THEN 1.414 ELSE 1 END, cx.z0 FROM cx JOIN ed ON ed.dst = cx.cell JOIN ar ON ar.id = ed.src JOIN ol ON ol.id <> ed.src AND ol.point = cx.point) SELECT point, {q('sum(chi * (g.z - z0)) / nullif(sum(chi * chi), 0)')} AS ks FROM cx CROSS JOIN sz JOIN g ON g.r * nx + g.c = cx.cell GROUP BY point",
}

_INNER = "BETWEEN 1 AND ny - 2 AND {c} BETWEEN 1 AND nx - 2"
_RING = "(VALUES (100, 400, 1500, 700), (1500, 700, 1200, 9000), (1200, 9000, 200, 8000), (200, 8000, 100, 400), (400, 2000, 800, 2000), (800, 2000, 800, 4000), (800, 4000, 400, 4000), (400, 4000, 400, 2000)) AS e(x0, y0, x1, y1)"


def _curvature() -> str:
    """Weights of the quadratic fit in a 5 x 5 window, from the normal equations."""
    from talusgrid.operators.spectral import inverse_normal

    h, u = inverse_normal(60.0, 30.0)
    rows, n = [], len(u) // 2
    for i in range(-n, n + 1):
        for j in range(-n, n + 1):
            x, y = j * 30.0, -i * 30.0
            a, b, c = (sum(w * t for w, t in zip(h[k], (x * x, y * y, x * y, x, y, 1.0), strict=True)) for k in range(3))
            rows.append(f"({i}, {j}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))".replace("np.float64(", "").replace(") AS", " AS"))
    return "o(i, j, wa, wb, wc) AS (VALUES " + ", ".join(rows) + ")"


ORACLE |= {
    "moving_median": f"WITH {G}, {_kernel('true', '-1, 2')} SELECT r - i AS \"row\", c - j AS col, {q('median(z)')} AS v FROM g, sz, o WHERE r - i BETWEEN 0 AND ny - 1 AND c - j BETWEEN 0 AND nx - 1 GROUP BY 1, 2",
    "downstream_path": f"WITH RECURSIVE {D8}{OUTLETS}, dp AS (SELECT point, CAST(0 AS BIGINT) AS seq, id, CAST(0 AS DOUBLE) AS d, [id] AS seen FROM ol UNION ALL SELECT dp.point, dp.seq + 1, ed.dst, dp.d + 30 * CASE WHEN code IN (2, 8, 32, 128) THEN CAST(1.414 AS DOUBLE) ELSE 1 END, list_append(seen, ed.dst) FROM dp JOIN ed ON ed.src = dp.id CROSS JOIN sz WHERE NOT list_contains(seen, ed.dst) AND r2 {_INNER.format(c='c2')}) SELECT point, seq, id // nx AS \"row\", id % nx AS col, {q('d')} AS distance FROM dp, sz WHERE id // nx {_INNER.format(c='id % nx')}",
    "longest_path": f"WITH RECURSIVE {D8}{LENGTH}{OUTLETS}, lp AS (SELECT point, CAST(0 AS BIGINT) AS seq, id, [id] AS seen FROM ol UNION ALL SELECT lp.point, lp.seq + 1, fl.donor, list_append(seen, fl.donor) FROM lp JOIN fl ON fl.id = lp.id WHERE fl.donor IS NOT NULL AND NOT list_contains(seen, fl.donor)) SELECT point, seq, id // nx AS \"row\", id % nx AS col FROM lp, sz",
    "points_with_length": f"WITH RECURSIVE {D8}{LENGTH} SELECT ed.r AS \"row\", ed.c AS col, CAST(ed.c * 30 AS DOUBLE) AS x, CAST((ny - 1 - ed.r) * 30 AS DOUBLE) AS y FROM ed CROSS JOIN sz JOIN fl a ON a.id = ed.src JOIN fl b ON b.id = ed.dst WHERE a.l <= 100 AND b.l >= 100 AND a.l >= 40",
    "coastline_outlets": cells("CAST(c * 30 AS DOUBLE) AS x, CAST((ny - 1 - r) * 30 AS DOUBLE) AS y", "m0d2 JOIN m0e2 USING (r, c) CROSS JOIN sz WHERE m0d2.v + m0e2.v = 1", G, ", m0 AS (SELECT r, c, CAST(z > 1000 AS INTEGER) AS v FROM g)" + _morph(True, 3) + _morph(False, 3)),
    "polygon_mask": f"WITH {G}, p AS (SELECT r, c, c * 30.0 AS x, (ny - 1 - r) * 30.0 AS y FROM g, sz) SELECT r AS \"row\", c AS col, CAST(count(x0) % 2 AS INTEGER) AS v FROM p LEFT JOIN {_RING} ON least(y0, y1) <= y AND y < greatest(y0, y1) AND x0 + (y - y0) * CAST(x1 - x0 AS DOUBLE) / (y1 - y0) > x GROUP BY r, c",
    "quadratic_curvature": f"WITH {G}, {_curvature()}, s AS (SELECT (r - i + ny) % ny AS r, (c - j + nx) % nx AS c, sum(z * wa) AS a, sum(z * wb) AS b, sum(z * wc) AS k FROM g, sz, o GROUP BY 1, 2), t AS (SELECT sum(wa) AS ta, sum(wb) AS tb, sum(wc) AS tk FROM o), f AS (SELECT r, c, a - ta * z AS a, b - tb * z AS b, k - tk * z AS k FROM s JOIN g USING (r, c), t) SELECT r AS \"row\", c AS col, {q('-a - b - sqrt((a - b) * (a - b) + k * k)')} AS v FROM f",
    "sinusoid": f"WITH {G}, w AS (SELECT r, c, 5 * sin(2 * pi() * 4 * c / CAST(nx - 1 AS DOUBLE)) AS v FROM g, sz) SELECT r AS \"row\", c AS col, {q('v + (SELECT abs(min(v)) FROM w)')} AS v FROM w",
    "ascii_export": f"WITH {G} SELECT r AS \"row\", string_agg(printf('%10.2f', z), ' ' ORDER BY c) AS line FROM g GROUP BY r",
    "upstream_tree": f"WITH RECURSIVE {D8}{OUTLETS}, tr AS (SELECT point, id AS cell, CAST(NULL AS BIGINT) AS parent, CAST(0 AS BIGINT) AS depth FROM ol UNION ALL SELECT tr.point, ed.src, ed.dst, tr.depth + 1 FROM tr JOIN ed ON ed.dst = tr.cell JOIN ol ON ol.point = tr.point AND ol.id <> ed.src), ds AS (SELECT dst, scale FROM (SELECT dst, scale, row_number() OVER (PARTITION BY dst ORDER BY list_position([16, 32, 64, 128, 1, 2, 4, 8], code) DESC) AS k FROM ed) WHERE k = 1) SELECT point, cell, parent, depth, g.r AS \"row\", g.c AS col, {q('coalesce(ds.scale, 1)')} AS distance_scale, {q('coalesce(ed.scale, 1)')} AS step_scale, CAST(g.z AS BIGINT) AS elevation FROM tr CROSS JOIN sz JOIN g ON g.r * nx + g.c = tr.cell LEFT JOIN ds ON ds.dst = tr.cell LEFT JOIN ed ON ed.src = tr.cell",
    "ksi": f"WITH RECURSIVE {D8}{AREA}{LENGTH[LENGTH.index(', ml AS'):]}{_RELIEF_ORDER}, own AS MATERIALIZED (SELECT ar.id, CASE WHEN a > 2000 THEN pow(2000.0 / (a - 2000.0), 0.45) * 30 * coalesce(ed.scale, 1) ELSE 0 END AS k FROM ar LEFT JOIN ed ON ed.src = ar.id), ks AS MATERIALIZED (SELECT hd.cell, sum(own.k) AS k FROM hd JOIN own ON own.id = hd.top GROUP BY hd.cell), fin AS (SELECT a.cell, a.k + coalesce(b.k, 0) AS k FROM ks a LEFT JOIN fl ON fl.id = a.cell AND NOT fl.fwd LEFT JOIN ks b ON b.cell = fl.donor) SELECT cell // nx AS \"row\", cell % nx AS col, {q('k')} AS v FROM fin, sz",
}

#: The cells of two sets of outlets' basins, and those of either with a four-neighbour in the other or shared with it.
_BOUNDARY = """, mk AS (SELECT DISTINCT CAST(CASE WHEN point % 100 = 25 THEN 0 ELSE 1 END AS INTEGER) AS side, cell // nx AS r, cell % nx AS c FROM up, sz
), bd AS (
    SELECT DISTINCT x.side, x.r, x.c FROM mk x CROSS JOIN (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(i, j) JOIN mk y ON y.side = 1 - x.side AND y.r = x.r + i AND y.c = x.c + j
)"""

#: Cells that a channel of 5,000 or more reaches over eight-connected cells of a Laplacian of at least 0.02.
_WET = f""", lp AS (SELECT r, c, ({' + '.join(_EDGE.values())} - z * 4) / 900.0 AS k FROM nb
), chn AS (SELECT id FROM ar WHERE a >= 5000
), opn AS MATERIALIZED (SELECT r * nx + c AS id, r, c FROM lp, sz WHERE k >= 0.02 OR r * nx + c IN (SELECT id FROM chn)
), wet AS (SELECT opn.* FROM opn JOIN chn USING (id) UNION SELECT o.* FROM wet CROSS JOIN (SELECT i, j FROM range(-1, 2) t(i), range(-1, 2) u(j)) n JOIN opn o ON o.r = wet.r + n.i AND o.c = wet.c + n.j)"""

ORACLE |= {
    "downstream_profile": ORACLE["downstream_path"].replace(f"id // nx AS \"row\", id % nx AS col, {q('d')} AS distance FROM dp, sz", f"{q('d')} AS length, CAST(g.z AS BIGINT) AS elevation FROM dp CROSS JOIN sz JOIN g ON g.r = id // nx AND g.c = id % nx"),
    "basin_boundary": f"WITH RECURSIVE {D8}{UPSTREAM}{_BOUNDARY} SELECT side, r AS \"row\", c AS col FROM bd",
    "paired_hollows": f"WITH RECURSIVE {D8}{AREA}{UPSTREAM}{_BOUNDARY}, cr AS MATERIALIZED (SELECT ed.src AS id, ed.dst FROM ed JOIN ar x ON x.id = ed.src JOIN ar y ON y.id = ed.dst WHERE x.a < 5000 AND y.a >= 5000), wk AS (SELECT side, r * nx + c AS id FROM bd, sz UNION SELECT wk.side, ed.dst FROM wk JOIN ed ON ed.src = wk.id WHERE wk.id NOT IN (SELECT id FROM cr)) SELECT DISTINCT side, CAST(cr.dst % nx * 30 AS DOUBLE) AS x, CAST((ny - 1 - cr.dst // nx) * 30 AS DOUBLE) AS y FROM wk JOIN cr USING (id), sz",
    "scaled_relief": f"WITH RECURSIVE {D8}{AREA}{LENGTH[LENGTH.index(', ml AS'):]}, st AS MATERIALIZED (SELECT fl.id, fl.donor, fl.fwd FROM fl JOIN ar ON ar.id = fl.donor WHERE ar.a > 2000), hd AS (SELECT id AS cell, id AS top, 0 AS n FROM fl UNION ALL SELECT hd.cell, st.donor, hd.n + 1 FROM hd JOIN st ON st.id = hd.top AND st.fwd), tp AS (SELECT cell, arg_max(top, n) AS top FROM hd GROUP BY cell), late AS (SELECT st.id AS cell, tp.top FROM st JOIN tp ON tp.cell = st.donor WHERE NOT st.fwd), gg AS MATERIALIZED (SELECT r * nx + c AS id, r, c, z FROM g, sz) SELECT x.r AS \"row\", x.c AS col, {q('(t.z - x.z) * pow(2000.0, 0.45)')} AS v FROM tp LEFT JOIN late USING (cell) JOIN gg x ON x.id = tp.cell JOIN gg t ON t.id = coalesce(late.top, tp.top)",
    "mainstem_valley_area": f"WITH RECURSIVE {D8}{AREA}{LENGTH[LENGTH.index(', ml AS'):]}{_WET}, gd AS MATERIALIZED (SELECT ed.src, ed.dst FROM ed JOIN ar ON ar.id = ed.src LEFT JOIN fl ON fl.id = ed.dst AND fl.donor = ed.src WHERE ed.fwd AND (fl.id IS NOT NULL OR a < 5000)), gw AS (SELECT src AS a, dst AS b FROM gd UNION ALL SELECT gw.a, gd.dst FROM gw JOIN gd ON gd.src = gw.b), sm AS (SELECT b, count(*) AS k FROM gw JOIN wet ON wet.id = gw.a GROUP BY b) SELECT g.r AS \"row\", g.c AS col, CAST(900 * (CASE WHEN wet.id IS NULL THEN 0 ELSE 1 END + coalesce(k, 0)) AS BIGINT) AS area FROM g CROSS JOIN sz LEFT JOIN wet ON wet.id = g.r * nx + g.c LEFT JOIN sm ON sm.b = g.r * nx + g.c",
    "filled_elevation": f"WITH RECURSIVE {G}, cell AS MATERIALIZED (SELECT r * nx + c AS id, r, c, z FROM g, sz), lv(id, level) USING KEY (id) AS (SELECT id, CASE WHEN r IN (0, ny - 1) OR c IN (0, nx - 1) THEN z ELSE 1e300 END FROM cell, sz UNION SELECT y.id, min(greatest(lv.level, y.z)) FROM lv JOIN cell x ON x.id = lv.id CROSS JOIN (SELECT i, j FROM range(-1, 2) t(i), range(-1, 2) u(j) WHERE i <> 0 OR j <> 0) o JOIN cell y ON y.r = x.r + i AND y.c = x.c + j JOIN recurring.lv AS old ON old.id = y.id WHERE lv.level < 1e300 AND greatest(lv.level, y.z) < old.level GROUP BY y.id) SELECT r AS \"row\", c AS col, CAST(level AS BIGINT) AS v FROM cell JOIN lv USING (id)",
}
