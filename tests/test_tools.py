"""Command lines, validation reports, MATLAB files and vector sinks."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_prepare import merged, single

from siltgrid import cli
from siltgrid.operators import validation
from siltgrid.params import Params
from siltgrid.sources import matlab, vectors


def element(kind, payload):
    return struct.pack("<II", kind, len(payload)) + payload + bytes(-len(payload) % 8)


def variable(name, flags, shape, *parts):
    head = element(6, struct.pack("<II", flags, 0)) + element(5, struct.pack(f"<{len(shape)}i", *shape)) + element(1, name.encode())
    return element(14, head + b"".join(parts))


def level5(*variables, squeeze=False):
    body = b"".join(element(15, zlib.compress(v))[: 8 + len(zlib.compress(v))] if squeeze else v for v in variables)
    return b"MATLAB 5.0 MAT-file".ljust(124) + struct.pack("<H", 0x100) + b"IM" + body


def numeric(name, values):
    v = np.asarray(values, float)
    return variable(name, 6, v.shape, element(9, v.tobytes(order="F")))


@pytest.mark.parametrize("squeeze", [False, True])
def test_matlab_level_5(tmp_path, squeeze):
    z = np.array([[1 + 2j, 3 - 1j]])
    parts = [
        numeric("gamma_max_iterations", [[5.0]]), numeric("grid", [[1.0, 2.0], [3.0, 4.0]]),
        variable("select_method", 4, (1, 7), element(4, "PERCENT".encode("utf-16-le"))),
        variable("z", 6 | 0x800, (1, 2), element(9, z.real.tobytes()), element(9, z.imag.tobytes())),
        variable("c", 1, (1, 1), numeric("", [[7.0]])),
    ]
    (tmp_path / "parms.mat").write_bytes(level5(*parts, squeeze=squeeze))
    got = matlab.read_mat(tmp_path / "parms.mat")
    assert got["gamma_max_iterations"][0, 0] == 5 and got["grid"].tolist() == [[1, 2], [3, 4]] and got["select_method"] == "PERCENT"
    assert np.array_equal(got["z"], z) and got["c"][0][0, 0] == 7
    params = Params.load(tmp_path)
    assert params.get("gamma_max_iterations") == 5 and params.get("select_method") == "PERCENT" and params.get("clap_win") == 32
    (tmp_path / "parms.json").write_text('{"gamma_max_iterations": 2}')
    assert Params.load(tmp_path).get("gamma_max_iterations") == 2  # JSON goes first


def test_matlab_level_4_and_7_3(tmp_path):
    v = struct.pack("<5i", 0, 1, 2, 0, 2) + b"b\0" + np.array([1.5, 2.5]).tobytes() + struct.pack("<5i", 51, 1, 2, 0, 2) + b"t\0" + b"ok"
    (tmp_path / "a.mat").write_bytes(v)
    got = matlab.read_mat(tmp_path / "a.mat")
    assert got["b"].tolist() == [[1.5, 2.5]] and got["t"] == "ok"
    (tmp_path / "b.mat").write_bytes(b"MATLAB 7.3 MAT-file".ljust(512))
    with pytest.raises(ValueError, match="7.3"):
        matlab.read_mat(tmp_path / "b.mat")


def test_shapefile_and_binary_points(spark, tmp_path):
    df = spark.createDataFrame([(1, 10.5, 45.25, -3.25, None), (2, 11.5, 44.0, float("nan"), "x")], "pid long, lon double, lat double, velocity_mm_a double, velocity_mm_b string")
    assert vectors.write_shapefile(df, str(tmp_path / "p.shp")) == 2
    shp, dbf = (tmp_path / "p.shp").read_bytes(), (tmp_path / "p.dbf").read_bytes()
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) == 100 + 2 * 28
    assert struct.unpack("<4d", shp[36:68]) == (10.5, 44.0, 11.5, 45.25) and struct.unpack("<dd", shp[112:128]) == (10.5, 45.25)
    assert [dbf[32 + 32 * k : 43 + 32 * k].rstrip(b"\0") for k in range(3)] == [b"pid", b"velocity_m", b"velocity_1"]
    n, head, row = struct.unpack("<IHH", dbf[4:12])
    first = dbf[head : head + row]
    assert n == 2 and float(first[21:45]) == -3.25 and first[45:].strip() == b""
    got = {r.pid: bytes(r.geometry) for r in vectors.with_wkb(df).collect()}
    assert got[1] == struct.pack("<BIdd", 1, 1, 10.5, 45.25)


def test_report_of_two_tables(spark):
    a = spark.range(50).select(F.col("id").alias("pid"), (F.col("id") * 0.1).alias("k"), F.array(F.lit(3.1), F.lit(0.0)).alias("ph"), F.lit("x").alias("s"))
    b = a.where("pid < 40").select("pid", (F.col("k") + 0.5).alias("k_ps"), F.array(F.lit(-3.1), F.lit(0.0), F.lit(1.0)).alias("ph"), F.lit("y").alias("s"))
    got = {r["field"]: r for r in validation.report(a, b, ["pid"], {"k": "k_ps"}, ("ph",))}
    assert got["k"]["n_left"] == 50 and got["k"]["n_both"] == 40 and got["k"]["max_abs"] == pytest.approx(0.5)
    assert got["ph"]["sizes"] == [2, 3] and got["ph"]["max_abs"] == pytest.approx(2 * np.pi - 6.2) and got["ph"]["is_phase"]
    assert got["s"]["n_differs"] == 40
    assert 5 <= validation.sampled(a, ["pid"], 10).count() <= 15


def test_from_rasters_to_a_layer(spark, tmp_path, capsys):
    stack, out = tmp_path / "stack", tmp_path / "out"
    stack.mkdir()
    single(stack)
    assert cli.main(["prepare", str(stack), str(out), "--mode", "ps", "--threshold", "0.5", "--overlap", "0", "--text"], spark) == 0
    assert "ps: 80 candidates" in capsys.readouterr().out
    cli.main(["run", str(out), "--end", "gamma", "--set", "gamma_max_iterations=1"], spark)
    assert "gamma" in capsys.readouterr().out
    cli.main(["compare", f"{out}/prepared", f"{out}/prepared", "--keys", "pid", "--phases", "ph"], spark)
    found = json.loads(capsys.readouterr().out)
    assert {r["field"]: r["max_abs"] for r in found if "max_abs" in r}["ph"] == 0
    cli.main(["parameters", str(tmp_path / "p.json"), "--small-baseline"])
    assert json.loads((tmp_path / "p.json").read_text())["merge_resample_size"] == 100.0


def test_pairs_of_a_stack(tmp_path, capsys):
    merged(tmp_path)
    cli.main(["pairs", str(tmp_path)])
    assert capsys.readouterr().out.splitlines() == ["20200101 20200113", "20200113 20200125", "20200125 20200206"]
    cli.main(["pairs", str(tmp_path), "--source", "consecutive", "--neighbours", "2"])
    assert len(capsys.readouterr().out.splitlines()) == 5
    (tmp_path / "list").write_text("20200101 20190101\n")
    with pytest.raises(ValueError, match="20190101"):
        cli.main(["pairs", str(tmp_path), "--list", str(tmp_path / "list")])
