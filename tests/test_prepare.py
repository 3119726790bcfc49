"""Stacks of rasters to the first table of the chain, on synthetic stacks with known answers."""

import numpy as np
import pytest

from siltgrid.plans import pipeline, prepare
from siltgrid.sources import rasters

DATES = (20200113, 20200125, 20200206)
W, L = 10, 8


def geometry(folder):
    k = np.arange(W * L)
    for name, v in (("lon", 100 + k / 1000), ("lat", 30 + k / 2000), ("dem", 500 + k)):
        (folder / f"{name}.raw").write_bytes(v.astype("<f4").tobytes())


def single(folder, seed=9876):
    rng = np.random.RandomState(seed)
    base = rng.uniform(80, 140, (L, W))
    ifgs = {}
    for place in ("master_20200101/master/master.slc", *(f"{d}/slave.slc" for d in DATES)):
        amplitude = np.maximum(base * rng.normal(1, 0.08, (L, W)), 1)
        path = folder / place
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes((amplitude * np.exp(1j * rng.uniform(-np.pi, np.pi, (L, W)))).astype("<c8").tobytes())
    for d in DATES:
        ifgs[d] = (rng.normal(size=(L, W)) + 1j * rng.normal(size=(L, W))).astype("<c8")
        (folder / str(d) / "isce_minrefdem.int").write_bytes(ifgs[d].tobytes())
    geometry(folder)
    for name, v in (("width.txt", W), ("len.txt", L), ("heading.1.in", -169.4626649344252), ("lambda.1.in", 0.056), ("master_day.1.in", 20200101), ("day.1.in", "\n".join(map(str, DATES))), ("bperp.1.in", "10\n20\n30")):
        (folder / name).write_text(f"{v}\n")
    return ifgs


def merged(folder):
    rng = np.random.RandomState(20260525)
    base = rng.uniform(80, 140, (L, W))
    row, col = np.mgrid[:L, :W]
    dates = (20200101, *DATES)
    for i, d in enumerate(dates):
        p = folder / "merged" / "SLC" / str(d) / f"{d}.slc.full"
        p.parent.mkdir(parents=True)
        p.write_bytes((base * (1 + 0.01 * i) * np.exp(1j * (0.1 * i + 0.02 * row + 0.03 * col))).astype("<c8").tobytes())
    for a, b in zip(dates, dates[1:]):
        p = folder / "merged" / "interferograms" / f"{a}_{b}" / f"filt_{a}_{b}.int"
        p.parent.mkdir(parents=True)
        p.write_bytes((rng.normal(size=(L, W)) + 1j * rng.normal(size=(L, W))).astype("<c8").tobytes())
    for d, v in zip(DATES, (10.0, 20.0, 30.0)):
        p = folder / "baselines" / f"20200101_{d}" / f"20200101_{d}.txt"
        p.parent.mkdir(parents=True)
        p.write_text(f"Bperp (average): {v}\n")
    geometry(folder)
    (folder / "width.txt").write_text(f"{W}\n")


def test_single_reference_stack(spark, tmp_path):
    ifgs = single(tmp_path)
    files = prepare.single_reference_layout(tmp_path)
    table, images = prepare.prepare(spark, files, "ps", 0.5, overlap=0)
    got = table.orderBy("pid").toPandas()
    assert len(got) == 80 and list(got.pid) == list(range(1, 81)) and images.reference == 0
    assert images.bperp == [0.0, 10.0, 20.0, 30.0] and images.day == [737791.0, 737803.0, 737815.0, 737827.0]
    ph = np.stack(got.ph)
    assert ph.shape == (80, 4) and (ph[:, 0] == 0).all()
    for k, d in enumerate(DATES):
        assert np.allclose(ph[:, k + 1], np.angle(ifgs[d])[got.az, got.rg], atol=1e-6)
    flat = got.az * W + got.rg
    assert np.allclose(got.lon, 100 + flat / 1000, atol=1e-5) and np.allclose(got.hgt, 500 + flat)
    assert list(got.sort_values(["y", "x"]).pid) == list(got.pid) and got.is_inner.all() and got.d_a.between(0, 0.5).all()
    stack = rasters.read_stack(spark, [files.images[d] for d in sorted(files.images)], W, length=L)
    assert len(prepare.calibrations(stack, 4)) == 4 and all(90 < c < 130 for c in prepare.calibrations(stack, 4))


def test_small_baseline_stack(spark, tmp_path):
    merged(tmp_path)
    files = prepare.merged_layout(tmp_path, 20200101, -169.4626649344252)
    table, images = prepare.prepare(spark, files, "sb", 10.0, overlap=0)
    assert images.pairs == [(0, 1), (1, 2), (2, 3)] and images.phase_bperp == [10.0, 10.0, 10.0]
    ph = np.stack(table.toPandas().ph)
    assert ph.shape == (80, 3) and np.allclose(ph, -0.1, atol=1e-5)
    assert prepare.max_phase_error(table, table) == 0.0
    with pytest.raises(ValueError, match="20200301"):
        prepare.prepare(spark, files, "sb", 10.0, pairs=[(20200101, 20200301)])


def test_patches_masks_and_text_products(spark, tmp_path):
    single(tmp_path)
    (tmp_path / "mask.raw").write_bytes(bytes([1] * W + [0] * (W * (L - 1))))
    files = prepare.single_reference_layout(tmp_path)
    table, _ = prepare.prepare(spark, files, "ps", 0.5, patches=(2, 1), overlap=1)
    got = table.toPandas()
    assert got.az.min() == 1 and set(got.patch) == {1, 2} and len(got) == 2 * 6 * 7 and got.is_inner.sum() == 70 and got.pid.nunique() == 70
    prepare.write_text_products(tmp_path / "out", files, table, [1.0, 2.0, 3.0, 4.0])
    assert (tmp_path / "out" / "pscphase.in").read_text().split()[0] == "10" and len((tmp_path / "out" / "pscphase.in").read_text().split()) == 4
    back = prepare.read_candidates(spark, f"{tmp_path}/out/candidates/ij")
    assert sorted(map(tuple, back.collect())) == sorted(zip(got.pid, got.az, got.rg))
    (tmp_path / "empty").write_text("")
    assert prepare.read_candidates(spark, str(tmp_path / "empty")).count() == 0
    (tmp_path / "patch.in").write_text("1\n6\n1\n8\n")
    assert prepare.read_patch_bounds(tmp_path / "patch.in") == (1, 6, 1, 8)


def test_serial_days_of_either_day_one():
    known = {20200113, 20200125}
    assert prepare.as_dates([737803, 737815], known) == [20200113, 20200125]
    assert prepare.as_dates([737803 - 366, 737815 - 366], known) == [20200113, 20200125]
    assert prepare.as_dates([20200113.0], known) == [20200113]


def test_phase_file_column_by_column(spark, tmp_path):
    z = np.exp(1j * np.arange(12).reshape(3, 4) / 3).astype("<c8")  # three images of four candidates
    (tmp_path / "ph").write_bytes(z.tobytes())
    got = rasters.phase_table(spark, str(tmp_path / "ph"), 4, 3).orderBy("row").toPandas()
    assert np.allclose(np.stack(got.ph), np.angle(z).T)
    with pytest.raises(ValueError, match="candidates"):
        rasters.phase_table(spark, str(tmp_path / "ph"), 5, 3)


def test_prepared_stack_goes_through_the_chain(spark, tmp_path):
    merged(tmp_path)
    table, images = prepare.prepare(spark, prepare.merged_layout(tmp_path, 20200101), "sb", 10.0, overlap=0)
    from siltgrid.params import Params

    params = Params(small_baseline=True).set("select_method", "PERCENT").set("merge_resample_size", 0.0)
    done = pipeline.run(table, images, params, end="gamma")
    assert done["gamma"].count() == 80
