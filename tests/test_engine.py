from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from skyfold.catalog import Catalog, joined, rows_of, with_offsets
from skyfold.conf import EngineConf
from skyfold.functions.bins import edge_bin, make_edges
from skyfold.functions.geometry import box, shell
from skyfold.operators import deposit, neighbors, slices
from skyfold.operators.cells import PointTree
from skyfold.operators.camera import Camera, Script
from skyfold.operators.histogram import histogram1d, histogram2d
from skyfold.orientation import Orientation
from skyfold.snapshot import Snapshot
from skyfold.sources import files
from skyfold.sources.store import Generic, ImageWriter, Reader, TimeSeriesWriter, Writer, save_catalog, save_histogram, save_snapshot
from skyfold.timeseries import TimeSeries


@pytest.fixture(scope="module")
def gas(spark):
    rng = np.random.default_rng(3)
    p = rng.random((500, 3)) * 10
    rows = [Row(row_id=i, Coordinates=Row(x=float(a), y=float(b), z=float(c)), Velocities=Row(x=1.0, y=2.0, z=2.0), Masses=float(i % 7 + 1), Density=float(i % 3 + 1), InternalEnergy=2.0) for i, (a, b, c) in enumerate(p)]
    return spark.createDataFrame(rows).cache()


def snap_of(gas, conf=None, **more):
    return Snapshot({0: gas, **more}, {"Time": 0.5, "MassTable": [0, 3.0]}, {"HubbleParam": 0.7, "ComovingIntegrationOn": 1}, {"GAMMA": 5 / 3}, conf)


def test_edge_values_of_histograms(spark):
    rows = [(v,) for v in (0.0, 1.0, 2.0, 3.0, 2.9999, -0.1, float("nan"), float("inf"), -float("inf"), None)]
    df = spark.createDataFrame(rows, "x double")
    got = histogram1d(df, F.col("x"), [0.0, 1.0, 2.0, 3.0], {"n": F.lit(1.0)}).orderBy("bin").collect()
    assert [r["n"] for r in got] == [1, 1, 2]
    same = {r["x"]: r["b"] for r in df.filter("x IS NOT NULL").select("x", edge_bin(F.col("x"), [0.0, 1.0, 2.0, 3.0]).alias("b")).collect()}
    assert same[3.0] is None and same[0.0] == 0 and same[float("inf")] is None
    with pytest.raises(ValueError):
        make_edges(0, 1, 3, log=True)
    auto = histogram1d(df.filter("x >= 0 AND x < 10"), F.col("x"), 3, {"n": F.lit(1.0)})
    assert sum(r["n"] for r in auto.collect()) == 4  # the largest value is left out


def test_normalized_histograms_sum_to_one(gas):
    h = histogram1d(gas, F.col("Masses"), [0.5, 2.0, 5.0, 9.0], {"m": F.col("Masses")}, normalize=True).collect()
    assert sum(r["m"] * (r["hi"] - r["lo"]) for r in h) == pytest.approx(1)
    h2 = histogram2d(gas, F.col("Coordinates.x"), F.col("Masses"), (0.0, 10.0), (0.5, 8.0), 5, 4, normalize=True).collect()
    assert sum(r["value"] for r in h2) * 2 * (7.5 / 4) == pytest.approx(1)
    with pytest.raises(ValueError):
        histogram2d(gas, F.col("Masses"), F.col("Masses"), (0.0, 1.0), (0.5, 8.0), 5, 4, log=True)


def test_predicates_push_bounds_to_the_scan(gas, spark, tmp_path):
    gas.write.parquet(str(tmp_path / "g"))
    df = spark.read.parquet(str(tmp_path / "g"))
    for p in (box(F.col("Coordinates"), (5, 5, 5), (2, 2, 2)), shell(F.col("Coordinates"), (5, 5, 5), 2)):
        plan = spark._jvm.PythonSQLUtils.explainString(df.filter(p).select("Masses")._jdf.queryExecution(), "formatted")
        pushed, schema = (next(x for x in plan.split("\n") if x.startswith(k)) for k in ("PushedFilters", "ReadSchema"))
        assert "GreaterThan(Coordinates.x" in pushed and "LessThan(Coordinates.z" in pushed and "Velocities" not in schema


def test_shell_agrees_with_numpy(gas):
    p = np.array([tuple(r["Coordinates"]) for r in gas.orderBy("row_id").collect()])
    d2 = ((p - 5) ** 2).sum(1)
    want = set(np.flatnonzero((d2 < 9) & (d2 >= 1)))
    assert {r["row_id"] for r in gas.filter(shell(F.col("Coordinates"), (5, 5, 5), 3, 1)).collect()} == want


def test_derived_columns_and_resolver(gas):
    conf = EngineConf()
    conf.add_user_function("0_Twice", lambda s: s["0_Masses"] * 2, ("0_Masses",))
    conf.add_user_function("0_Never", lambda s: s["0_Gone"], ("0_Gone",))
    conf.set_aliases({"0_Twice": "two"})
    s = snap_of(gas, conf)
    known = s.functions()
    assert "0_Volume" in known and "0_Twice" in known and "0_Never" not in known and "0_MagneticFieldStrength" not in known
    row = s.types[0].orderBy("row_id").select(s["two"].alias("t"), s["0_MeanMolecularWeight"].alias("mu"), s["0_VelocityMagnitude"].alias("v"), s["0_Pressure"].alias("p")).first()
    assert row["t"] == 2 and row["mu"] == pytest.approx(4 / 6.8) and row["v"] == 3 and row["p"] == pytest.approx(4 / 3)
    for bad in ("0_Never", "3_Masses", "0_Nothing"):
        with pytest.raises(KeyError):
            s[bad]
    assert s.unit("0_Volume").power("a") == 3 and s.unit("0_Temperatures").power("K") == 1
    conf.only_user_functions = True
    assert "0_Volume" not in s.functions()
    s.remove("0_Density")
    assert not s.stores("0_Density")
    assert "0_Twice" in s.info(0)["derived"]


def test_isothermal_gas_has_no_pressure(gas):
    s = snap_of(gas)
    s.config = {"ISOTHERMAL": 1}
    with pytest.raises(ValueError):
        s["0_Pressure"]


def test_selection_composes_and_mass_table(gas, spark):
    s = snap_of(gas)
    s.types[1] = gas.select("row_id", "Coordinates")
    both = s.select(0, F.col("Masses") > 3).select(0, spark.range(100).withColumnRenamed("id", "row_id"))
    want = sum(1 for i in range(100) if i % 7 + 1 > 3)
    assert both.types[0].count() == want and both.types[1].count() == 500
    com = {r["parttype"]: r for r in s.center_of_mass().collect()}
    assert com[1]["mass"] == 1500 and com[None]["mass"] == pytest.approx(com[0]["mass"] + 1500)


def test_curvature_of_a_straight_field_is_zero(spark):
    g = {f"g{i}{j}": float(i == j == 0) for i in range(3) for j in range(3)}
    df = spark.createDataFrame([Row(MagneticField=Row(x=1.0, y=0.0, z=0.0), BfieldGradient=Row(**g), Masses=1.0)])
    s = Snapshot({0: df})
    assert df.select(s["0_MagneticCurvature"].alias("k")).first()["k"] == 0


def test_offsets_and_ranges(spark, gas):
    groups = spark.createDataFrame([(5, 3), (1, 2), (2, 0), (9, 4)], "id long, n long")
    off = {r["id"]: (r["first"], r["last"]) for r in with_offsets(groups, "id", "n", blocks=3).collect()}
    assert off == {1: (0, 2), 2: (2, 2), 5: (2, 5), 9: (5, 9)}
    got = {r["row_id"]: r["object_id"] for r in joined(gas.filter("row_id < 12"), with_offsets(groups, "id", "n"), "id", bucket=2).collect()}
    assert got == {0: 1, 1: 1, 2: 5, 3: 5, 4: 5, 5: 9, 6: 9, 7: 9, 8: 9}
    assert rows_of(snap_of(gas), 0, 2, 3).types[0].count() == 3 and rows_of(snap_of(gas), 0, 2, 0).types[0].count() == 0


def test_nearest_and_radius_against_brute_force(spark):
    rng = np.random.default_rng(0)
    p, q = rng.random((300, 3)), rng.random((200, 3)) * 3 - 1
    frame = lambda a, name: spark.createDataFrame([(i, Row(x=float(x), y=float(y), z=float(z))) for i, (x, y, z) in enumerate(a)], f"{name} long, pos struct<x:double,y:double,z:double>")
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    p[7] = p[3]
    d2 = ((q[:, None] - p[None]) ** 2).sum(2)
    for sent in (0, 1000):
        got = {r["qid"]: r["id"] for r in neighbors.nearest(frame(p, "id"), frame(q, "qid"), sent_points=sent).collect()}
        assert got == dict(enumerate(d2.argmin(1)))
        apart = ((p[:, None] - p[None]) ** 2).sum(2)
        apart[apart == 0] = np.inf
        got = {r["qid"]: r["id"] for r in neighbors.nearest(frame(p, "id"), frame(p, "qid"), ignore_self=True, sent_points=sent).collect()}
        assert got == dict(enumerate(apart.argmin(1)))
    inside = {(r["qid"], r["id"]) for r in neighbors.within(frame(p, "id"), frame(q, "qid"), 0.3).collect()}
    assert inside == set(zip(*np.nonzero(d2 <= 0.09)))
    index = PointTree(p)
    who, dist = index.nearest(q)
    assert (who == d2.argmin(1)).all() and np.allclose(dist, d2.min(1))
    assert neighbors.nearest(frame(p[:0], "id"), frame(q, "qid")).count() == 0


def test_deposit_keeps_the_value_of_rows_well_inside(spark):
    df = spark.createDataFrame([(Row(x=5.0, y=4.2, z=5.0), 1.3, 7.0)], "pos struct<x:double,y:double,z:double>, h double, v double")
    cam = Camera((5.0, 5.0, 5.0), (10.0, 10.0, 10.0), "z", 16)
    image = deposit.dense(deposit.project(df, cam, F.col("pos"), F.col("h"), F.col("v")), cam)
    assert image.sum() * cam.area_per_pixel == pytest.approx(7)
    nested = deposit.dense(deposit.project_nested(df, cam, F.col("pos"), F.col("h"), F.col("v"), npix_min=4), cam)
    assert nested.sum() * cam.area_per_pixel == pytest.approx(7)
    turned = Camera((5.0, 5.0, 5.0), (10.0, 10.0, 10.0), Orientation(normal=(0, 0, 1), perp1=(1, 0, 0)), 16)
    same = deposit.dense(deposit.project(df, turned, F.col("pos"), F.col("h"), F.col("v")), turned)
    assert np.allclose(same, image)


def test_nine_spheres_have_density_one(spark):
    size, rows = 9.0, []
    for k, (i, j) in enumerate((i, j) for i in range(3) for j in range(3)):
        r = size / (20 * (k + 1))
        rows.append((Row(x=size * (i + 1) / 4, y=size * (j + 1) / 4, z=size / 2), 4 * math.pi / 3 * r**3))
    df = spark.createDataFrame(rows, "pos struct<x:double,y:double,z:double>, volume double")
    cam = Camera((size / 2,) * 3, (size,) * 3, "z", 128)
    h = deposit.kernel_size(F.col("volume"))
    image = lambda v, f: deposit.dense(f(df, cam, F.col("pos"), h, v), cam)
    for f in (deposit.project, deposit.project_nested):
        mass, volume = image(F.col("volume"), f), image(F.col("volume"), f)
        assert (volume > 0).any() and np.allclose(mass[volume > 0] / volume[volume > 0], 1)
    plain, nested = image(F.col("volume"), deposit.project), image(F.col("volume"), deposit.project_nested)
    assert nested.sum() == pytest.approx(plain.sum(), rel=1e-6)


def test_slice_stack_and_rays_of_a_lattice(spark):
    n = 8
    c = (np.arange(n) + 0.5) / n
    rng = np.random.default_rng(1)
    rows = [(i, Row(x=float(x + rng.normal(0, 1e-3)), y=float(y + rng.normal(0, 1e-3)), z=float(z + rng.normal(0, 1e-3))), 1 / n**3, 2.0 / n**3) for i, (x, y, z) in enumerate((x, y, z) for x in c for y in c for z in c)]
    df = spark.createDataFrame(rows, "id long, pos struct<x:double,y:double,z:double>, volume double, mass double")
    values = {"density": F.col("mass") / F.col("volume"), "mass": F.col("mass")}
    flat = slices.slice_image(df, Camera((0.5,) * 3, (1.0, 1.0, 0.0), "z", 8), "pos", "id", F.col("volume"), values).collect()
    assert len(flat) == 64 and all(r["density"] == pytest.approx(2) for r in flat)
    deep = Camera((0.5,) * 3, (1.0,) * 3, "x", 8)
    stack = slices.stack_image(df, deep, "pos", "id", F.col("volume"), {"mass": F.col("mass")}, True, 16).collect()
    assert len(stack) == 64 and all(r["mass"] == pytest.approx(2) for r in stack)
    ray = slices.ray_march(df, deep, "pos", "id", F.col("volume"), {"density": F.col("mass") / F.col("volume"), "one": F.lit(1.0)}, tol=0.5).collect()
    assert len(ray) == 64 and all(r["density"] == pytest.approx(2) and r["one"] == pytest.approx(1) for r in ray)
    kept, slices.SENT_POINTS = slices.SENT_POINTS, 10
    try:
        small = Camera((0.5,) * 3, (1.0,) * 3, "z", 2)
        far = slices.ray_march(df, small, "pos", "id", F.col("volume"), {"density": F.col("mass") / F.col("volume")}, tol=2.0).collect()
    finally:
        slices.SENT_POINTS = kept
    assert len(far) == 4 and all(r["density"] == pytest.approx(2) for r in far)


def test_camera_and_script(tmp_path):
    cam = Camera((1.0, 2.0, 3.0), (4.0, 2.0, 6.0), "z", 8)
    assert cam.npix_height == 4 and cam.extent == (-1.0, 3.0, 1.0, 3.0)
    assert cam.move(width=1).center == (2.0, 2.0, 3.0) and cam.zoom(2).width == 2
    assert Camera.from_description(cam.describe()) == cam
    with pytest.raises(ValueError):
        _ = Camera((0.0,) * 3, (3.0, 1.0, 1.0), "z", 8).npix_height
    script = Script(Camera((0.0,) * 3, (1.0,) * 3, Orientation(normal=(0, 0, 1)), 8)).do("zoom", 4.0).waypoint("near").do("rotated", "perp1", 30.0).do("half_resolution").do("double_resolution")
    fine = script.subdivided(2.0, 10.0)
    assert len(fine.cameras()) == 1 + 2 + 3 + 2 and len(fine.cameras("near")) == 6
    assert fine.cameras()[-1].direction == script.cameras()[-1].direction and fine.cameras()[-1].npix == 8
    script.save(str(tmp_path / "s.json"))
    assert Script.load(str(tmp_path / "s.json")).cameras()[-1].widths == script.cameras()[-1].widths


def test_writers_and_readers(spark, gas, tmp_path):
    folder = str(tmp_path)
    s = snap_of(gas)
    save_snapshot(spark, s, folder, "reduced", 3, ["0_Coordinates", "0_Masses", "0_Volume"], single_precision=True)
    r = Reader(spark, folder, 3, "reduced")
    r.expect_rows("PartType0")
    back = r.snapshot()
    assert dict(back.types[0].dtypes)["Masses"] == "double" and back.a == 0.5 and back.unit("0_Masses") == s.unit("0_Masses")
    physical = Reader(spark, folder, 3, "reduced", to_physical=True).load("PartType0").agg(F.sum("Masses")).first()[0]
    assert physical == pytest.approx(gas.agg(F.sum("Masses")).first()[0] / 0.7)
    w = Writer(spark, folder, "reduced", 3, "a", header={"Time": 0.5})
    with pytest.raises(FileExistsError):
        w.write_data("PartType0", gas)
    Writer(spark, folder, "reduced", 3, "r+", header={"Time": 0.5}).write_data("extra", gas.select("Masses"))
    with pytest.raises(ValueError):
        Writer(spark, folder, "reduced", 3, "a", header={"Time": 0.6})
    cam = Camera((5.0,) * 3, (10.0,) * 3, "z", 8)
    image = deposit.project(gas, cam, F.col("Coordinates"), F.lit(1.0), F.col("Masses"))
    iw = ImageWriter(spark, cam, folder, "image", 1)
    iw.save_image("0_Masses", image)
    iw.save_image("0_MassesTimesMasses", image)
    iw.finalize()
    ir = Reader(spark, folder, 1, "image")
    assert ir.camera() == cam and ir.derived_image("0_MassesTimesMasses").agg(F.max("value")).first()[0] == pytest.approx(1)
    with pytest.raises(ValueError):
        ImageWriter(spark, cam.zoom(2), folder, "image", 1, "a")
    cat = Catalog(spark.createDataFrame([(1, 2.0)], "GroupLen long, GroupMass double"))
    save_catalog(spark, cat, folder, "fof", 3)
    assert Reader(spark, folder, 3, "fof").catalog().groups.count() == 1
    save_histogram(spark, histogram1d(gas, F.col("Masses"), [0.0, 4.0, 8.0], {"n": F.lit(1.0)}), folder, "hist", 1, label="N")
    assert Reader(spark, folder, 1, "hist").meta["hist_info"]["colorlabel"] == "N"
    assert files.split_name("a/b/snap_247") == ("a/b", "snap", 247) and files.split_name("a/x") == ("a", "x", None)
    assert not [n for n in files.names(spark, folder) if n.endswith(".tmp")]


def test_time_series(spark, tmp_path):
    df = spark.createDataFrame([(0.25, 4.0), (0.5, 2.0), (1.0, 1.0)], "a double, value double")
    s = TimeSeries.of(df, "kpc small_a / small_h", h=0.5)
    assert {r["a"]: r["value"] for r in s.to_physical().df.collect()} == {0.25: 2.0, 0.5: 2.0, 1.0: 2.0}
    assert s.reduce_time("mean").first()["value"] == pytest.approx(7 / 3)
    assert s.stack(s).reduce_rows("sum").df.agg(F.sum("value")).first()[0] == 14
    assert s.between(0.0, 0.3).concat(s.between(0.3, 2.0)).df.count() == 3
    with pytest.raises(ValueError):
        s.stack(s.between(0.0, 0.5))
    with pytest.raises(ValueError):
        s.concat(TimeSeries.of(df, "kpc"))
    w = TimeSeriesWriter(spark, str(tmp_path), "series")
    w.save_series("one", s)
    w.save_series("two", s)
    with pytest.raises(ValueError):
        w.save_series("three", s.between(0.0, 0.5))
    w.finalize()
    assert Reader(spark, str(tmp_path), None, "series").series("two").h == 0.5


def test_generic_source(spark, gas):
    s = Generic(gas.select("row_id", "Masses")).give_info(10.0, hubble=0.7, comoving=True, a=0.5).set_positions(F.lit(1.0), F.lit(2.0), F.lit(3.0), "code_length small_a / small_h").set_data("Heat", F.lit(2.0), "K").open()
    assert s.a == 0.5 and s.unit("0_Heat").power("K") == 1
    assert s.quantity("0_Coordinates").unit.power("a") == 1


def test_stream_histogram_equals_batch(spark, gas, tmp_path):
    from skyfold.streaming.live import live_histogram

    gas.select("Masses").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("Masses double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live_histogram(stream, F.col("Masses"), [0.0, 3.0, 8.0], {"n": F.lit(1.0)}).writeStream.outputMode("complete").format("memory").queryName("hist").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = histogram1d(gas, F.col("Masses"), [0.0, 3.0, 8.0], {"n": F.lit(1.0)})
    assert {r["bin"]: r["n"] for r in spark.table("hist").collect()} == {r["bin"]: r["n"] for r in batch.collect()}


def test_point_tree_against_brute_force_on_clusters():
    """Dense places, places shared by many points and an outlier cost no more than even ones."""
    rng = np.random.default_rng(2)
    for n, kind in ((1, 0), (2, 0), (40, 1), (700, 0), (700, 1), (700, 2)):
        p = rng.normal(size=(n, 3))
        if kind == 1:
            p = np.round(p * 2) / 2
        if kind == 2:
            p[1:] *= 1e-3
            p[0] = 1e4
        q = np.concatenate([rng.normal(size=(150, 3)), p[:60]])
        if kind == 1:
            q = np.round(q * 2) / 2
        d = p[None] - q[:, None]
        d2 = d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2
        tree = PointTree(p)
        who, far = tree.nearest(q)
        assert (who == d2.argmin(1)).all() and (far == d2.min(1)).all()
        apart = np.where(d2 > 0, d2, np.inf)
        who, far = tree.nearest(q, True)
        assert (far == apart.min(1)).all() and (who == np.where(np.isfinite(far), apart.argmin(1), -1)).all()
        found = set()
        for i, j, x2 in tree.within(q, 0.5):
            found |= set(zip(i.tolist(), j.tolist(), x2.tolist()))
        i, j = np.nonzero(d2 <= 0.25)
        assert found == set(zip(i.tolist(), j.tolist(), d2[i, j].tolist()))


def test_clustered_points_within_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(size=(49_999, 3)) * 1e-4, [[1e4, 0.0, 0.0]]])
    tracemalloc.start()
    PointTree(p).nearest(rng.normal(size=(5000, 3)) * 1e-4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_radius_search_splits_crowds(spark):
    """A crowd in one cell is dealt over portions; counts and cuts are those of all its points."""
    rng = np.random.default_rng(4)
    p = np.concatenate([rng.random((1500, 3)) * 0.01, rng.random((200, 3))])
    q = np.concatenate([rng.random((20, 3)) * 0.01, rng.random((30, 3))])
    frame = lambda a, name: spark.createDataFrame([(i, Row(x=float(x), y=float(y), z=float(z))) for i, (x, y, z) in enumerate(a)], f"{name} long, pos struct<x:double,y:double,z:double>")
    d = p[None] - q[:, None]
    d2 = d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2
    for sent in (0, 10_000):
        got = neighbors.within(frame(p, "id"), frame(q, "qid"), 0.2, sent_points=sent).collect()
        assert {(r["qid"], r["id"]) for r in got} == set(zip(*np.nonzero(d2 <= 0.2 * 0.2))) and len(got) == (d2 <= 0.2 * 0.2).sum()
        few = {(r["qid"], r["id"]): r["n_all"] for r in neighbors.within(frame(p, "id"), frame(q, "qid"), 0.2, most=5, sent_points=sent).collect()}
        want = {}
        for i, row in enumerate(d2):
            inside = np.flatnonzero(row <= 0.2 * 0.2)
            want |= {(i, int(j)): len(inside) for j in inside[np.lexsort((inside, row[inside]))][:5]}
        assert few == want


@pytest.mark.parametrize("gas", [True, False])
def test_ray_march_against_a_plain_march(spark, gas):
    """Sent and tiled marches, also where cells are far from a tile and its margin has to grow."""
    rng = np.random.default_rng(5)
    p = np.concatenate([rng.random((60, 3)), 0.4 + 0.02 * rng.random((200, 3))])
    volume, value = rng.random(260) * 1e-2 + 1e-3, rng.random(260)
    rows = [(i, Row(x=float(a), y=float(b), z=float(c)), float(v), float(w)) for i, ((a, b, c), v, w) in enumerate(zip(p, volume, value))]
    df = spark.createDataFrame(rows, "id long, pos struct<x:double,y:double,z:double>, volume double, value double")
    cam = Camera((0.5, 0.5, 0.5), (1.0, 0.5, 1.0), "z", 8)
    want = {}
    for iy in range(4):
        for ix in range(8):
            place, z, total = np.array([(ix + 0.5) / 8, 0.25 + (iy + 0.5) / 8, 0.0]), 0.0, 0.0
            while z < 1.0:
                far = ((p - place - [0, 0, z]) ** 2).sum(1)
                k = int(far.argmin())
                step = max(0.5 * 2.4 * np.cbrt(volume[k] / (4 * np.pi / 3)) if gas else np.sqrt(far[k]), 1e-6)
                total += min(step, 1.0 - z) * value[k]
                z += step
            want[iy, ix] = total
    for sent in (0, 10_000):
        got = {(r["iy"], r["ix"]): r["value"] for r in slices.ray_march(df, cam, "pos", "id", F.col("volume"), {"value": F.col("value")}, tol=0.5, gas=gas, sent_points=sent).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6) for k in want)


def test_a_kernel_of_many_pixels():
    """One kernel in rows of pixels gives what the plain stencil gives; one that is far larger than the image takes the image's memory."""
    for x, y, h in ((10.3, 7.9, 23.7), (40.2, -3.1, 30.0), (5.5, 5.5, 12.25), (1.01, 15.99, 77.7)):
        images = []
        for parts in (deposit._stencils(np.array([x]), np.array([y]), np.array([h]), np.array([5.0]), 32, 16), deposit._wide_stencil(x, y, h, 5.0, 32, 16)):
            images.append(np.zeros(32 * 16))
            for flat, share in parts:
                np.add.at(images[-1], flat, share)
        assert np.allclose(*images, rtol=1e-12)
    total = sum(share.sum() for _, share in deposit._stencils(np.array([100.2]), np.array([50.1]), np.array([50_000.0]), np.array([1e9]), 512, 512))
    assert total == pytest.approx(1e9 * 512**2 / (np.pi * 5e4**2 / 2), rel=1e-3)


def test_norms_are_rounded_once(spark, tmp_path):
    """Rows of P2_project whose deposits lie half way between two millionths: kernels' norms as exact sums, whatever the order of the pixels."""
    from skyfold.plans.registry import QUERIES

    kernels = np.random.default_rng(4).random((200, 6, 6))
    q = np.where(kernels < 0.3, 1.0, kernels)
    share = 1.0 - q
    assert (deposit._norms(share) == [math.fsum(k.ravel()) for k in share]).all()
    assert (deposit._norms(share) == deposit._norms(share[:, ::-1].transpose(0, 2, 1))).all()
    ties = [(44.0, 24150.0, 0.04), (44.0, 41475.0, 0.04), (36.0, 11025.0, 0.04), (36.0, 17850.0, 0.04), (36.0, 23100.0, 0.04)]
    lines = [(k, 1, 1, 1, x, price, discount, 0.02, "N") for k, (x, price, discount) in enumerate(ties)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
    spark.createDataFrame(lines, names).coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = {}
    for x, price, discount in ties:
        px, py, h = ((x - 25.0) + 20.0) * 0.8, ((price / 2100.0 - 25.0) + 20.0) * 0.8, (1.2 + discount * 20.0) * 0.8
        r = int(h) + 1
        pixels = [(iy, ix) for iy in range(int(py) - r, int(py) + r) for ix in range(int(px) - r, int(px) + r)]
        s = {(iy, ix): 1.0 - ((px - (ix + 0.5)) * (px - (ix + 0.5)) + (py - (iy + 0.5)) * (py - (iy + 0.5))) / (h * h) for iy, ix in pixels}
        norm = math.fsum(v for v in s.values() if v > 0)
        for (iy, ix), v in s.items():
            if v > 0 and 0 <= ix < 32 and 0 <= iy < 32:
                want[iy, ix] = want.get((iy, ix), 0) + math.floor(v * (x / norm) * 1e6 + 0.5)
    assert {(r["iy"], r["ix"]): r["value"] for r in QUERIES["P2_project"](spark, str(tmp_path)).collect()} == want


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from skyfold.shared import shared_folder

    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(RuntimeError):
        shared_folder(session)
