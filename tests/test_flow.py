import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from support import array, heap_fill, ordered_area, ordered_length, receivers

from talusgrid.components import components
from talusgrid.functions import numeric
from talusgrid.grid import Georef, Grid, cells_of
from talusgrid.operators import accumulate, doubling, fill, flow, neighbours, profile
from talusgrid.operators.regions import _joined, regions
from talusgrid.plans import raster_queries
from talusgrid.runtime import checkpointed

GOLDEN = {
    "code": [[1, 16, 16, 16, 4], [64] * 5, [64] * 5, [64] * 5, [1, 16, 16, 16, 128]],
    "area": [[16, 28, 8, 4, 4], [3, 3, 3, 3, 7], [2, 2, 2, 2, 2], [1, 1, 1, 1, 1], [4, 7, 2, 1, 1]],
    "length": [[6, 7, 4, 3, 3], [2, 2, 2, 2, 4], [1, 1, 1, 1, 1], [0, 0, 0, 0, 0], [3, 4, 1, 0, 0]],
}


def test_golden_plane(spark):
    z = Grid.of_array(spark, [[10.0 * i + j for j in range(5)] for i in range(5)])
    fd = flow.flow_direction(z)
    assert np.array_equal(array(fd), GOLDEN["code"])
    assert np.array_equal(array(accumulate.area(fd, z)), GOLDEN["area"])
    assert np.allclose(array(accumulate.flow_length(fd, z)), GOLDEN["length"])


@pytest.fixture(scope="module")
def basin(spark):
    z = np.random.default_rng(3).integers(0, 40, (11, 13)).astype(float)
    g = Grid.of_array(spark, z, dx=2.0)
    fd = Grid(flow.flow_direction(g).cells.persist(), g.geo)
    return z, g, fd, array(fd)


def test_area_and_length_match_ordered_pushing(basin):
    z, g, fd, codes = basin
    assert np.allclose(array(accumulate.area(fd, g)), ordered_area(codes, z, 4.0))
    assert np.allclose(array(accumulate.flow_length(fd, g)), ordered_length(codes, z, 2.0))


def test_upstream_and_downstream(spark, basin):
    z, g, fd, codes = basin
    to = receivers(codes)
    outs = [(5, 5), (3, 7), (8, 2)]
    got = {(r.point, r.row, r.col) for r in flow.upstream(fd, cells_of(spark, outs)).collect()}
    want = set()
    for p, o in enumerate(outs):
        found, todo = {o}, [o]
        while todo:
            c = todo.pop()
            for d, r in to.items():
                if r == c and d not in found:
                    found.add(d)
                    todo.append(d)
        want |= {(p, *c) for c in found}
    assert got == want
    paths = flow.downstream_paths(fd, cells_of(spark, outs)).orderBy("point", "seq").collect()
    for p, o in enumerate(outs):
        walk, at = [], o
        while 0 < at[0] < 10 and 0 < at[1] < 12 and at not in walk:
            walk.append(at)
            at = to[at]
        assert [(r.row, r.col) for r in paths if r.point == p] == walk


def test_fill_equals_a_heap_flood_over_many_tiles(spark):
    z = np.random.default_rng(9).integers(0, 30, (23, 19)).astype(float)
    g = Grid.of_array(spark, z)
    want = heap_fill(z)
    assert np.array_equal(array(fill.fill(g, tile=7)), want)
    assert np.array_equal(array(fill.fill_in_order(g, epsilon=0.0)), want)
    drained = array(fill.fill(g, epsilon=1e-6, tile=8))
    assert (drained >= z).all() and np.allclose(drained, want, atol=1e-3)
    inner = drained[1:-1, 1:-1]
    lowest = np.min([drained[1 + i : 22 + i, 1 + j : 18 + j] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j], axis=0)
    assert (lowest < inner).all()  # no pits are left


def test_pit_is_filled_to_its_rim(spark):
    z = np.full((7, 7), 5.0)
    z[2:5, 2:5] = 1.0
    z[2, 0:3] = 3.0
    assert (array(fill.fill(Grid.of_array(spark, z)))[2:5, 2:5] == 3.0).all()
    deep = array(fill.fill_in_order(Grid.of_array(spark, z), maximum_pit_depth=1.0, epsilon=0.0))
    assert deep[3, 3] == 1.0 and deep[2, 2] == 3.0


def test_chi_grows_upstream_and_a_line_has_its_steepness(spark):
    n, ks, theta = 12, 3.0, 0.5
    codes = np.zeros((3, n))
    codes[1, 1:] = 16
    area = np.ones((3, n))
    area[1] = np.arange(n, 0, -1) * 100.0
    fd, a = Grid.of_array(spark, codes), Grid.of_array(spark, area)
    outlet = cells_of(spark, [(1, 1)])
    chi = array(accumulate.chi(a, fd, theta, 1.0, outlet))
    assert np.allclose(chi[1, 1:], np.cumsum(area[1, 1:] ** -theta)) and (chi[0] == 0).all()
    z = np.zeros((3, n))
    z[1, 1:] = ks * (chi[1, 1:] - chi[1, 1]) + 7
    tree = profile.chi_map(Grid.of_array(spark, z), fd, a, outlet, 0.0, theta, Ao=1.0)
    fit = profile.ks_fit(tree).first()
    assert np.isclose(fit.ks, ks) and np.isclose(fit.r2, 1.0)


def test_smoothed_ks_against_a_direct_fit(spark):
    n, theta = 15, 0.4
    rng = np.random.default_rng(2)
    codes = np.zeros((3, n))
    codes[1, 1:] = 16
    area = np.ones((3, n))
    area[1] = np.arange(n, 0, -1) * 50.0
    z = np.zeros((3, n))
    z[1] = np.cumsum(rng.random(n))
    grid = profile.ks_with_smoothing(*(Grid.of_array(spark, x) for x in (z, area, codes)), theta, horizontal_interval=6.0, area_threshold=60.0)
    got = grid.cells.where("row = 1 and col = 7").first()
    cols = np.arange(4, 11)
    w = area[1, cols] ** -theta
    chi = np.concatenate(([0], np.cumsum(0.5 * (w[1:] + w[:-1]))))
    y = z[1, cols] - z[1, cols[0]]
    k = chi @ y / (chi @ chi)
    assert np.isclose(got.value, k) and np.isclose(got.ss, ((y - k * chi) ** 2).sum()) and got.n_regression == 7
    assert 0 <= got.pval < 1e-3
    slope = array(profile.slope_with_smoothing(*(Grid.of_array(spark, x) for x in (z, area, codes)), horizontal_interval=6.0, min_area=60.0))
    assert np.isclose(slope[1, 7], (z[1, 10] - z[1, 4]) / 7)


def test_relief_and_ksi_follow_the_longest_path(basin):
    z, g, fd, codes = basin
    area, length = accumulate.area(fd, g), accumulate.flow_length(fd, g)
    donor = {(r.row, r.col): divmod(r.donor, 13) for r in length.cells.where("donor is not null").collect()}
    to = receivers(codes)
    order = sorted(np.ndindex(z.shape), key=lambda c: (-z[c], c[0] * 13 + c[1]))
    top, k = z.copy(), np.zeros(z.shape)
    a = array(area)
    for c in order:
        step = 2.0 * (1.41421356 if int(codes[c]) in (2, 8, 32, 128) and c in to else 1.0)
        k[c] += (8.0 / (a[c] - 8.0)) ** 0.5 * step if a[c] > 8 else 0
    own = k.copy()
    for c in order:
        if c in to and donor.get(to[c]) == c:
            top[to[c]] = top[c]
            k[to[c]] += k[c]
    assert np.allclose(array(accumulate.relief(fd, g, length, g)), top - z)
    assert np.allclose(array(accumulate.ksi(area, fd, 0.5, 8.0, length, g)), k) and (k >= own).all()


def test_walks_visit_the_lowest_new_neighbour(spark):
    z = np.random.default_rng(1).permutation(99).reshape(9, 11).astype(float)
    g = Grid.of_array(spark, z)
    starts = [(4, 5), (2, 2)]
    got = fill.walks(g, cells_of(spark, starts), tile=4).orderBy("point", "seq").collect()
    for p, s in enumerate(starts):
        seen, at = [s], s
        while 0 < at[0] < 8 and 0 < at[1] < 10:
            around = [(at[0] + i, at[1] + j) for i, j in fill.WALK_ORDER]
            new = [c for c in around if c not in seen]
            if not new:
                break
            at = min(new, key=lambda c: z[c])
            seen.append(at)
        assert [(r.row, r.col) for r in got if r.point == p] == seen


def test_regions_and_components(spark):
    z = np.random.default_rng(4).integers(0, 2, (15, 17)).astype(float)
    got = {(r.row, r.col): r.region for r in regions(Grid.of_array(spark, z)).collect()}
    label = {}
    for c in np.ndindex(z.shape):
        if c in label:
            continue
        todo, label[c] = [c], c[0] * 17 + c[1]
        while todo:
            i, j = todo.pop()
            for a, b in ((i, j + 1), (i + 1, j), (i, j - 1), (i - 1, j)):
                if 0 <= a < 15 and 0 <= b < 17 and z[a, b] == z[i, j] and (a, b) not in label:
                    label[a, b] = label[c]
                    todo.append((a, b))
    assert got == label
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40) if i % 10 != 9], "a long, b long")
    assert {(r.node, r.component) for r in components(pairs, checkpointed).collect()} == {(i, i // 10 * 10) for i in range(40)}


def test_mask_flood_and_divides(spark, basin):
    z, g, fd, codes = basin
    m = (z > 15).astype(float)
    wet = array(flow.flood_mask(Grid.of_array(spark, m, dx=2.0), cells_of(spark, [(5, 6)])))
    seen, todo = {(5, 6)}, [(5, 6)]
    while todo:
        i, j = todo.pop()
        for a in range(max(i - 1, 0), min(i + 2, 11)):
            for b in range(max(j - 1, 0), min(j + 2, 13)):
                if m[a, b] == 1 and (a, b) not in seen:
                    seen.add((a, b))
                    todo.append((a, b))
    assert {c for c in np.ndindex(wet.shape) if wet[c] == 1} == seen
    fed = set(receivers(codes).values())
    d = array(flow.divides(fd))
    assert all(d[i, j] == (1 <= i <= 8 and 1 <= j <= 10 and (i, j) not in fed) for i, j in np.ndindex(d.shape))


def test_restored_elevation_follows_the_steepness(spark):
    n = 10
    codes = np.zeros((3, n))
    codes[1, 1:] = 16
    area = np.ones((3, n))
    area[1] = np.arange(n, 0, -1) * 100.0
    z0 = np.zeros((3, n))
    z, _, changes = profile.restored_elevation(*(Grid.of_array(spark, x) for x in (codes, z0, area)), 0.5, 10.0, cells_of(spark, [(1, 1)]), 1)
    want = np.concatenate(([0.0], np.cumsum(10.0 * area[1, 1:-1] ** -0.5)))
    assert np.allclose(array(z)[1, 1:], want) and changes[0] > 0


def forest(n, seed, circle=False):
    """Links mostly to near ids, some far and some to ids that aren't there; of every seventh id there is none."""
    rng = np.random.default_rng(seed)
    ids = [i for i in range(n) if i % 7 != 3]
    link = {i: None if rng.random() < 0.05 else int(i + rng.integers(1, 6)) if rng.random() < 0.9 else int(rng.integers(i + 1, n + 5)) for i in ids}
    if circle:
        link |= {0: 9, 9: 18, 18: 0, 1: 2, 2: 1}
    return ids, link


@pytest.mark.parametrize(("one_task", "sent"), [(1 << 20, 1 << 17), (0, 0)])
def test_sums_by_blocks_equal_plain_walks(spark, monkeypatch, one_task, sent):
    for name, value in (("BLOCK", 16), ("ONE_TASK", one_task), ("SENT", sent)):
        monkeypatch.setattr(doubling, name, value)
    ids, link = forest(200, 4)
    step = {i: float(i % 5 + 1) for i in ids}
    ways = {}
    for i in ids:
        ways[i] = [i]
        while link[ways[i][-1]] in step:
            ways[i].append(link[ways[i][-1]])
    nodes = spark.createDataFrame([(i, link[i], step[i], i) for i in ids], "id long, j long, step double, k long")
    got = {r.id: (r.root, r.n, r.step, r.k) for r in doubling.path_sum(nodes, ["step", "k"]).collect()}
    assert got == {i: (w[-1], len(w), sum(step[x] for x in w), sum(w)) for i, w in ways.items()}
    got = {r.id: (r.step, r.k) for r in doubling.subtree_sum(nodes, ["step", "k"]).collect()}
    assert got == {i: (sum(step[x] for x in ids if i in ways[x]), sum(x for x in ids if i in ways[x])) for i in ids}
    got = {r.id: r.m for r in doubling.subtree_max(nodes.select("id", "j", "step")).collect()}
    assert got == {i: max(sum(step[x] for x in ways[y][: ways[y].index(i)]) for y in ids if i in ways[y]) for i in ids}
    keyed = nodes.select(F.explode(F.array(F.lit(5).cast("long"), F.lit(6).cast("long"))).alias("p"), "*").select(F.struct("p", "id").alias("id"), F.when(F.col("j").isNotNull(), F.struct("p", F.col("j").alias("id"))).alias("j"), "k")
    got = {(r.id.p, r.id.id): (r.root.p, r.root.id, r.n, r.k) for r in doubling.path_sum(keyed, ["k"]).collect()}
    assert got == {(p, i): (p, w[-1], len(w), sum(w)) for p in (5, 6) for i, w in ways.items()}


@pytest.mark.parametrize("one_task", [1 << 20, 0])
def test_targets_by_blocks_with_circles(spark, monkeypatch, one_task):
    monkeypatch.setattr(doubling, "BLOCK", 8)
    monkeypatch.setattr(doubling, "ONE_TASK", one_task)
    ids, link = forest(120, 5, circle=True)
    targets = {i for i in ids if i % 11 == 7}

    def first(i):
        seen = set()
        while i in link and i not in seen:
            if i in targets:
                return i
            seen.add(i)
            i = link[i]
        return None

    nodes = spark.createDataFrame([(i, link[i]) for i in ids], "id long, j long")
    got = {r.id: r.target for r in doubling.reaches(nodes, spark.createDataFrame([(t,) for t in targets], "id long")).collect()}
    assert got == {i: first(i) for i in ids if first(i) is not None}


def test_rounds_do_not_grow_with_the_path(spark, monkeypatch):
    """A path over all blocks is solved by blocks and once across: as many checkpoints whatever its length."""
    kept = []
    monkeypatch.setattr(doubling, "checkpointed", lambda df: kept.append(1) or df.localCheckpoint())
    for size in (8, 64):
        monkeypatch.setattr(doubling, "BLOCK", size)
        nodes = spark.range(4096).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("j"), F.lit(1).cast("long").alias("a"))
        assert doubling.path_sum(nodes, []).where("root = 0 and n = id + 1").count() == 4096
        assert doubling.subtree_sum(nodes, ["a"]).where("a = 4096 - id").count() == 4096
    assert len(kept) == 12


def test_sums_down_to_a_target_are_one_labelling(spark, monkeypatch):
    """Labels and sums come of one pass, circles and missing ends beside."""
    kept = []
    monkeypatch.setattr(doubling, "checkpointed", lambda df: kept.append(1) or df.localCheckpoint())
    nodes = spark.createDataFrame([(0, 1, 2.0), (1, 2, 3.0), (2, 3, 5.0), (3, 4, 7.0), (5, 6, 1.0), (6, 5, 1.0), (7, 99, 1.0)], "id long, j long, d double")
    got = {tuple(r) for r in doubling.path_to(nodes, ["d"], spark.createDataFrame([(2,)], "id long")).collect()}
    assert got == {(0, 2, 3, 10.0), (1, 2, 2, 8.0), (2, 2, 1, 5.0)} and len(kept) == 2


def test_neighbours_of_any_type_with_gaps_over_tiles(spark):
    cells = {(i, j): (i * 9 + j if (i + j) % 4 else None) for i in range(9) for j in range(7) if (i, j) != (4, 3)}
    rows = [(i, j, None if v is None else (v, f"s{v}")) for (i, j), v in cells.items()]
    g = Grid(spark.createDataFrame(rows, "row long, col long, value struct<n: long, s: string>"), Georef(7, 9))
    found = neighbours.shifted(g, [("se", 1, 1), ("n2", -2, 0), ("w", 0, -1)], tile=4)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.row, r.col): [x and x.n for x in (r.value, r.se, r.n2, r.w)] for r in found.collect()}
    assert got == {(i, j): [cells.get((i + a, j + b)) for a, b in ((0, 0), (1, 1), (-2, 0), (0, -1))] for i, j in cells}


def test_rows_kept_on_the_way_have_their_true_size(spark):
    kept = checkpointed(spark.range(1000).selectExpr("id", "1.5D AS v", "struct(id) AS s"))
    size = kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert 16000 <= int(str(size)) <= 100000 and kept.count() == 1000


def test_lengths_need_no_areas_and_lines_are_dealt_out(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    assert raster_queries.surface(spark, d).cells.rdd.getNumPartitions() == 4
    monkeypatch.setattr(accumulate, "area", None)
    assert raster_queries.longest_path(spark, d).count() > 0


@pytest.mark.parametrize("interval", [{"vertical_interval": 14.0}, {"horizontal_interval": 9.0}])
def test_windows_by_tiles_equal_those_by_joins(spark, monkeypatch, interval):
    z = np.random.default_rng(8).integers(0, 50, (23, 19)).astype(float)
    z[3, 4] = z[15, 11] = np.nan
    g = Grid.of_array(spark, z, dx=2.0)
    fd = Grid(checkpointed(flow.flow_direction(g).cells), g.geo)
    area = Grid(checkpointed(accumulate.area(fd, g).cells), g.geo)

    def paths(**size):
        return {r.center: [tuple(p) for p in r.points] for r in profile.window_paths(g, area, fd, **interval, **size).collect()}

    joins, sent = profile._grown_by_joins, []
    monkeypatch.setattr(profile, "_grown_by_joins", lambda *a: sent.append(a[-1].count()) or joins(*a))
    whole = paths()
    assert len(whole) > 20 and not sent  # no path leaves the one tile, and no join is needed
    few = paths(tile=5, halo=2)
    assert few == whole and 0 < sent[0] < z.size
    every = checkpointed(g.cells.where("value is not null").select(g.geo.cell_id().alias("center")))
    vertical = "vertical_interval" in interval
    plain = joins(g, area, fd, vertical, *interval.values(), 0.0, every)
    assert {r.center: [tuple(p) for p in r.points] for r in plain.collect()} == whole


def test_searches_in_step_equal_single_ones():
    goals = np.random.default_rng(2).normal(0, 3, 300)
    costs = lambda x, at: np.where(np.abs(x) <= 10, np.abs(x - goals[at]) ** 1.5 + np.sin(x), np.inf)
    x, f = numeric.nelder_mead_rows(costs, 0.5, len(goals))
    single = [numeric.nelder_mead(lambda t, k=k: costs(np.array([t]), np.array([k]))[0], 0.5) for k in range(len(goals))]
    assert x.tolist() == [s[0] for s in single] and f.tolist() == [s[1] for s in single]


def test_walks_along_a_tile_edge_stay_in_the_halo(spark, monkeypatch):
    z = np.full((30, 30), 90.0)
    for k in range(2, 28):
        z[k, 10 + k % 2 - 1] = 60.0 - k  # a zigzag along the edge between two tiles
    g = Grid.of_array(spark, z)
    starts = spark.createDataFrame([(1, 2, 9)], "point long, row long, col long")
    rounds = []
    monkeypatch.setattr(fill, "tiled", lambda *a: rounds.append(a) or neighbours.tiled(*a))
    far = [(r.seq, r.row, r.col) for r in fill.walks(g, starts, tile=10, halo=8).orderBy("seq").collect()]
    assert len(far) > 25 and len(rounds) <= 4
    assert far == [(r.seq, r.row, r.col) for r in fill.walks(g, starts, tile=64).orderBy("seq").collect()]


def test_valley_is_found_once(spark, basin, monkeypatch):
    calls = []
    monkeypatch.setattr(accumulate, "area", lambda d, o, on: calls.append(on.cells._jdf.queryExecution().optimizedPlan().toString()) or on)
    g = basin[1]
    zero = g.map(F.lit(0.0))
    accumulate.valley_area(g, g, zero, zero, 0.0, -1.0, 1)
    assert "Join" not in calls[0] and "Generate" not in calls[0]


def test_few_labels_are_joined_in_one_task():
    a = np.arange(499) * 7
    got = _joined(pa.table({"a": np.append(a, 9001), "b": np.append(a + 7, 9000)})).to_pydict()
    assert dict(zip(got["node"], got["component"], strict=True)) == {7 * i: 0 for i in range(500)} | {9000: 9000, 9001: 9000}
