"""SQL of queries over walks, windows along flow, mainstems, regions and the flexure filter."""

from __future__ import annotations

from talusgrid.operators.fill import WALK_ORDER
from talusgrid.operators.flow import DIAGONAL_PATH
from talusgrid.operators.spectral import TWO_PI
from talusgrid.plans.raster_sql import _BAND, _WET, AREA, D8, OUTLETS, UPSTREAM, G, _morph, q

_DIAGONAL = f"CAST({DIAGONAL_PATH} AS DOUBLE)"

#: Cells with all eight neighbours and these in the order in which a walk takes them; walks hold the cells they visited.
_AROUND = f"""cell AS MATERIALIZED (SELECT r * nx + c AS id, r, c, z FROM g, sz
), wo(k, i, j) AS (VALUES {", ".join(str((k, *o)) for k, o in enumerate(WALK_ORDER))}
), nl AS MATERIALIZED (
    SELECT x.id, list({{'z': y.z, 'k': k, 'id': y.id, 'd': 30 * sqrt(CAST(i * i + j * j AS DOUBLE))}} ORDER BY y.z, k) AS l
    FROM cell x CROSS JOIN wo JOIN cell y ON y.r = x.r + i AND y.c = x.c + j GROUP BY x.id HAVING count(*) = 8
)"""


def _walks(rise: str) -> str:
    return f"""WITH RECURSIVE {G}{OUTLETS}, {_AROUND}, wk AS (
    SELECT point, CAST(0 AS BIGINT) AS seq, ol.id, cell.z, CAST(0 AS DOUBLE) AS distance, [ol.id] AS seen FROM ol JOIN cell USING (id)
    UNION ALL
    SELECT point, seq + 1, n.id, n.z, distance + n.d, list_append(seen, n.id)
    FROM (SELECT wk.*, list_filter(nl.l, lambda x: NOT list_contains(wk.seen, x.id))[1] AS n FROM wk JOIN nl ON nl.id = wk.id) WHERE n IS NOT NULL AND {rise}
)"""


def _windows(grows: str, start: str) -> str:
    """``win``: the paths around cells, as (center, k, n, z, a, r, c) from downstream to upstream; both ends grow while ``grows``."""
    return f"""WITH RECURSIVE {D8}{AREA}, nd AS MATERIALIZED (SELECT r * nx + c AS id, r, c, z, a FROM g CROSS JOIN sz JOIN ar ON ar.id = r * nx + c
), upn AS MATERIALIZED (SELECT dst AS id, src AS up, nd.z, nd.a, nd.r, nd.c FROM (SELECT dst, src, row_number() OVER (PARTITION BY dst ORDER BY a DESC, src DESC) AS k FROM ed JOIN ar ON ar.id = src) x JOIN nd ON nd.id = x.src WHERE k = 1
), dnn AS MATERIALIZED (SELECT src AS id, dst AS dn, nd.z, nd.a, nd.r, nd.c FROM ed JOIN nd ON nd.id = dst
), wp AS (
    SELECT nd.id AS center, dnn.dn AS d, upn.up AS u, upn.z - dnn.z AS rise, [dnn.dn, nd.id, upn.up] AS pts FROM nd JOIN upn ON upn.id = nd.id JOIN dnn ON dnn.id = nd.id WHERE {start}
    UNION ALL
    SELECT center, dnn.dn, upn.up, upn.z - dnn.z, list_concat([dnn.dn], pts, [upn.up]) FROM wp JOIN upn ON upn.id = wp.u JOIN dnn ON dnn.id = wp.d WHERE {grows} AND (wp.pts IS NULL OR dnn.dn <> upn.up)
), pt AS (SELECT center, len(pts) AS n, unnest(pts) AS id, unnest(range(len(pts))) AS k FROM wp WHERE NOT ({grows})
), win AS (SELECT center, n, k, z, a, r, c FROM pt JOIN nd USING (id))"""


_KS = f""", st AS (
    SELECT *, first_value(z) OVER w AS z0, CASE WHEN k = 0 THEN 0 ELSE (pow(a, -0.45) + pow(lag(a) OVER w, -0.45)) * 0.25 * 60 * CASE WHEN lead(r) OVER w <> r AND lead(c) OVER w <> c THEN {_DIAGONAL} ELSE 1 END END AS step
    FROM win WINDOW w AS (PARTITION BY center ORDER BY k)
), cu AS (SELECT center, n, k, z - z0 AS y, sum(step) OVER (PARTITION BY center ORDER BY k) AS chi FROM st
), sm AS (SELECT center, any_value(n) AS n, sum(chi * y) AS xy, sum(chi * chi) AS xx, sum(y * y) AS yy FROM cu WHERE k > 0 GROUP BY center
), ft AS (SELECT center, n, CAST(n - 1 AS BIGINT) AS df, xy / xx AS ks, greatest(yy - xy * xy / xx, 0) AS ss, xx, yy FROM sm
), tt AS (SELECT *, CASE WHEN ss > 0 THEN atan(abs(ks) / sqrt(ss / df / xx) / sqrt(CAST(df AS DOUBLE))) ELSE pi() / 2 END AS t FROM ft
), pv AS (
    SELECT *, 1 - CASE
        WHEN df % 2 = 0 THEN sin(t) * list_sum(list_transform(range(0, df // 2), lambda j: coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: (2 * i - 1) / CAST(2 * i AS DOUBLE) * cos(t) * cos(t)), 'product'), 1)))
        WHEN df = 1 THEN 2 * t / pi()
        ELSE 2 / pi() * (t + sin(t) * list_sum(list_transform(range(0, (df - 1) // 2), lambda j: cos(t) * coalesce(list_aggregate(list_transform(range(1, j + 1), lambda i: 2 * i / CAST(2 * i + 1 AS DOUBLE) * cos(t) * cos(t)), 'product'), 1))))
    END AS p FROM tt
)"""

_SLOPE = f""", st AS (
    SELECT *, 30 * CASE WHEN lead(r) OVER w <> r AND lead(c) OVER w <> c THEN {_DIAGONAL} ELSE 1 END AS step FROM win WINDOW w AS (PARTITION BY center ORDER BY k)
), sl AS (SELECT center, (arg_max(z, k) - arg_min(z, k)) / sum(step) AS v FROM st GROUP BY center)"""

_STEMS = f"""WITH RECURSIVE {D8}{AREA}{UPSTREAM}, tr AS MATERIALIZED (
    SELECT up.point, up.cell, CASE WHEN up.cell <> ol.id THEN ed.dst END AS parent, ar.a, g.z, CASE WHEN ed.scale > 1 THEN 30 * {_DIAGONAL} ELSE 30 END AS de
    FROM up JOIN ol USING (point) CROSS JOIN sz JOIN g ON g.r * nx + g.c = up.cell JOIN ar ON ar.id = up.cell LEFT JOIN ed ON ed.src = up.cell WHERE up.cell = ol.id OR ar.a > 900
), be AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point, parent ORDER BY a DESC, cell) AS k FROM tr WHERE parent IS NOT NULL) WHERE k = 1
), pr AS (
    SELECT tr.point, tr.cell AS profile, tr.parent IS NULL AS mainstem, CAST(0 AS BIGINT) AS seq, tr.cell, tr.a, tr.z, tr.de, tr.z AS z0, CAST(0 AS DOUBLE) AS chi FROM tr LEFT JOIN be USING (point, cell) WHERE be.cell IS NULL
    UNION ALL
    SELECT pr.point, profile, mainstem, seq + 1, be.cell, be.a, be.z, be.de, z0, chi + pow(pr.a, -0.45) * pr.de FROM pr JOIN be ON be.point = pr.point AND be.parent = pr.cell
)"""

#: Four-connected cells of equal value go by the smallest cell id that reaches them.
_REGIONS = f"""WITH RECURSIVE {G}, cell AS MATERIALIZED (SELECT r * nx + c AS id, r, c, {_BAND} AS v FROM g, sz
), ln AS MATERIALIZED (SELECT x.id AS a, y.id AS b FROM cell x CROSS JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) AS o(i, j) JOIN cell y ON y.r = x.r + i AND y.c = x.c + j AND y.v = x.v
), lb(id, label) USING KEY (id) AS (
    SELECT id, id FROM cell
    UNION
    SELECT ln.b, min(lb.label) FROM lb JOIN ln ON ln.a = lb.id JOIN recurring.lb AS old ON old.id = ln.b WHERE lb.label < old.label GROUP BY ln.b
)"""


def _spectrum() -> str:
    """The flexure filter by sums of waves: along rows, along columns, and back."""
    w = {n: f"(CASE WHEN {k} < ({n} + 1) // 2 THEN {k} ELSE 2 * (({n} + 1) // 2) - 1 - {k} END / (30.0 * (({n} + 1) // 2)))" for k, n in (("k", "nx"), ("l", "ny"))}
    response = f"1 / (600.0 * 9.81 + {TWO_PI**4!r} * 1e12 * pow(pow({w['nx']}, 2) + pow({w['ny']}, 2), 2))"
    return f"""WITH {G}, tx AS MATERIALIZED (SELECT t, cos(2 * pi() * t / CAST(nx AS DOUBLE)) AS co, sin(2 * pi() * t / CAST(nx AS DOUBLE)) AS si FROM sz, unnest(range(nx)) AS u(t)
), ty AS MATERIALIZED (SELECT t, cos(2 * pi() * t / CAST(ny AS DOUBLE)) AS co, sin(2 * pi() * t / CAST(ny AS DOUBLE)) AS si FROM sz, unnest(range(ny)) AS u(t)
), kx AS MATERIALIZED (SELECT a.t AS k, b.t AS c, w.co, w.si FROM sz, tx a, tx b JOIN tx w ON w.t = (a.t * b.t) % nx
), ky AS MATERIALIZED (SELECT a.t AS l, b.t AS r, w.co, w.si FROM sz, ty a, ty b JOIN ty w ON w.t = (a.t * b.t) % ny
), fa AS MATERIALIZED (SELECT r, k, sum(-z * 2700.0 * 9.81 * co) AS re, -sum(-z * 2700.0 * 9.81 * si) AS im FROM g JOIN kx USING (c) GROUP BY r, k
), fb AS MATERIALIZED (SELECT l, k, sum(re * co + im * si) AS re, sum(im * co - re * si) AS im FROM fa JOIN ky USING (r) GROUP BY l, k
), fc AS MATERIALIZED (SELECT l, k, re * f AS re, im * f AS im FROM (SELECT *, {response} AS f FROM fb, sz)
), fd AS MATERIALIZED (SELECT r, k, sum(re * co - im * si) AS re, sum(im * co + re * si) AS im FROM fc JOIN ky USING (l) GROUP BY r, k
), fe AS (SELECT r, c, sum(re * co - im * si) / (any_value(nx) * any_value(ny)) AS v FROM fd JOIN kx USING (k) CROSS JOIN sz GROUP BY r, c)"""


_STEEP = "rise < 100"

ORACLE: dict[str, str] = {
    "downhill_walk": _walks("n.z - z <= 20") + " SELECT point, seq, CAST(id % nx * 30 AS DOUBLE) AS x, CAST((ny - 1 - id // nx) * 30 AS DOUBLE) AS y, distance, z AS elevation FROM wk, sz",
    "discrete_flow": _walks("true") + ', la AS (SELECT wk.id, arg_max(900 * (seq + 1), point) AS a FROM wk JOIN nl USING (id) GROUP BY wk.id) SELECT r AS "row", c AS col, CAST(coalesce(a, 0) AS BIGINT) AS area FROM cell LEFT JOIN la USING (id)',
    "ks_smoothed": _windows(_STEEP, "nd.a > 0") + f"{_KS} SELECT nd.r AS \"row\", nd.c AS col, {q('ks')} AS v, {q('ss / n')} AS mse, {q('1 - ss / nullif(yy, 0)')} AS r2, {q('p')} AS pval FROM nd LEFT JOIN pv ON pv.center = nd.id",
    "channel_slope_smoothed": _windows(_STEEP, "nd.a > 1000") + f"{_SLOPE} SELECT nd.r AS \"row\", nd.c AS col, {q('v')} AS v FROM nd LEFT JOIN sl ON sl.center = nd.id",
    "mainstem_profile": f"{_STEMS} SELECT point, profile, mainstem, seq, cell, CAST(a AS BIGINT) AS area, CAST(z - z0 AS BIGINT) AS elevation, {q('de')} AS de, {q('chi')} AS chi FROM pr JOIN (SELECT point, profile FROM pr GROUP BY ALL HAVING count(*) > 4) USING (point, profile)",
    "equal_regions": f'{_REGIONS} SELECT r AS "row", c AS col, label AS region FROM cell JOIN lb USING (id)',
    "region_outlines": f"{_REGIONS} SELECT label AS region, CAST(any_value(v) AS BIGINT) AS value, count(*) AS cells FROM cell JOIN lb USING (id) GROUP BY label",
    "valley_area": f"WITH RECURSIVE {D8}{AREA}{_WET}, m0 AS (SELECT g.r, g.c, CASE WHEN wet.id IS NULL THEN 0 ELSE 1 END AS v FROM g CROSS JOIN sz LEFT JOIN wet ON wet.id = g.r * nx + g.c){_morph(True, 1)}{_morph(False, 1, 'm0d0')}, va AS MATERIALIZED (SELECT r * nx + c AS id, 900 * v AS a FROM m0d0e0, sz"
    "), on_ AS MATERIALIZED (SELECT ed.* FROM ed JOIN va ON va.id = ed.src WHERE va.a > 0), vw AS (SELECT src AS a, dst AS b FROM on_ WHERE fwd UNION ALL SELECT vw.a, on_.dst FROM vw JOIN on_ ON on_.src = vw.b AND on_.fwd), vp AS MATERIALIZED (SELECT va.id, va.a + coalesce(k, 0) AS a FROM va LEFT JOIN (SELECT b, 900 * count(*) AS k FROM vw GROUP BY b) x ON x.b = va.id)"
    ' SELECT g.r AS "row", g.c AS col, CAST(vp.a + coalesce(x.a, 0) AS BIGINT) AS area FROM g CROSS JOIN sz JOIN vp ON vp.id = g.r * nx + g.c LEFT JOIN (SELECT dst, sum(vp.a) AS a FROM on_ JOIN vp ON vp.id = on_.src WHERE NOT fwd GROUP BY dst) x ON x.dst = vp.id',
    "deflection": _spectrum() + ' SELECT r AS "row", c AS col, CAST(round(v * 1000) AS BIGINT) AS v FROM fe',
}
