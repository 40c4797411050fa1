"""Grid and index layouts written here and read back."""

import datetime as dt
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.sources import grids as G


def _file(path, *rows):
    path.write_text("\n".join(rows) + "\n")
    return str(path)


@pytest.mark.parametrize(("order", "real"), [("<", "f4"), (">", "f8")])
def test_binary_blocks(spark, tmp_path, order, real):
    frame = lambda b: struct.pack(f"{order}i", len(b)) + b + struct.pack(f"{order}i", len(b))
    value = np.arange(24, dtype=f"{order}{real}").reshape(2, 3, 4)
    parts = [np.array([3.13], f"{order}{real}").tobytes(), struct.pack(f"{order}3i", 2, 3, 4), struct.pack(f"{order}i", 2), b"Rho     ", b"[O!U+!N] ", struct.pack(f"{order}7i", 2014, 4, 10, 1, 2, 3, 250)]
    parts += [value.ravel(order="F").tobytes(), (value * 2).astype(value.dtype).ravel(order="F").tobytes()]
    path = tmp_path / "a.bin"
    path.write_bytes(b"".join(map(frame, parts)))
    rows = G.read_binary_blocks(spark, str(path)).collect()
    assert len(rows) == 48 and {r["variable"] for r in rows} == {"Rho", "O!U+!N"} and rows[0]["time"] == dt.datetime(2014, 4, 10, 1, 2, 3, 250000)
    assert all(r["value"] == value[r["i"], r["j"], r["k"]] * (1 if r["variable"] == "Rho" else 2) for r in rows) and abs(rows[0]["version"] - 3.13) < 1e-6
    with pytest.raises(ValueError):
        G.records(b"\x01\x02\x03")


def test_text_frames(spark, tmp_path):
    def frame(title, it, rows):
        return [title, f"      {it}  1.0000000000E+01  2  0  2", "       2       1", "Lon Lat dBn dBe", *rows]

    path = _file(tmp_path / "g.outs", *frame("Grid (SMG) [deg] dB", 0, [" 0.0E+00 -8.0E+01 1.5E+00 2.0E+00", " 1.2E+02 -8.0E+01 -3.0E+00 4.0E+00"]), *frame("Grid (SMG) [deg] dB", 7, [" 0.0E+00 -8.0E+01 9.0E+00 2.0E+00", " 1.2E+02 -8.0E+01 8.0E+00 4.0E+00"]))
    rows = G.read_text_frames(spark, path, ["Lon", "dBn"]).orderBy("frame", "point").collect()
    assert [(r["frame"], r["iteration"], r["point"], r["Lon"], r["dBn"]) for r in rows] == [(0, 0, 0, 0.0, 1.5), (0, 0, 1, 120.0, -3.0), (1, 7, 0, 0.0, 9.0), (1, 7, 1, 120.0, 8.0)]
    assert rows[0]["title"] == "Grid (SMG) [deg] dB" and rows[0]["run_time"] == 10.0
    with_parameters = _file(tmp_path / "c.out", "cut", " 5 2.0 2 1 1", " 1 1", " 1.6667", "x z rho g", " 1.0E0 2.0E0 3.0E0")
    assert G.read_text_frames(spark, with_parameters).first()["values"] == {"x": 1.0, "z": 2.0, "rho": 3.0}


def test_array_rows(spark, tmp_path):
    path = _file(tmp_path / "oval.dat", "Oval at Lon=  0.0 120.0 240.0", "time oval", "2014 4 10 0 0 5 250 20.5 21.0 22.0", "2014 4 10 0 0")
    places, rows = G.read_array_rows(spark, path, "^Oval")
    assert places == [0.0, 120.0, 240.0] and [tuple(r)[1:] for r in rows.collect()] == [(dt.datetime(2014, 4, 10, 0, 0, 5, 250000), [20.5, 21.0, 22.0])]


def test_index_blocks(spark, tmp_path):
    start = dt.datetime(1998, 5, 1)
    data = [(e, start + dt.timedelta(hours=k), float(k) - 1.5) for e in ("ap", "dst") for k in range(5)]
    df = spark.createDataFrame(data, "element string, time timestamp_ntz, value double")
    out = str(tmp_path / "index")
    G.write_index_blocks(df, out)
    back = G.read_index_blocks(spark, f"{out}/*/*.txt").select("element", "time", "value")
    assert sorted(map(tuple, back.collect())) == sorted(data)
    assert G.index_block_lines(df).where("element = 'ap'").orderBy("n").first()["value"] == "#>"
    assert G.index_block_lines(df.limit(0)).isEmpty()


def test_daily_drivers(spark, tmp_path):
    head = {"DateTime": {"NAME": "IsoDateTime", "START_COLUMN": 0}, "Den_P": {"START_COLUMN": 1}, "G": {"START_COLUMN": 2, "DIMENSION": [2]}, "Den_P_status": {"START_COLUMN": 4}, "G_status": {"START_COLUMN": 5, "DIMENSION": [2]}}
    path = _file(tmp_path / "q.txt", *("# " + x for x in json.dumps(head, indent=1).splitlines()), "2012-09-01T00:00:00 3.5 1.0 2.0 2 1 0")
    row = G.read_daily_drivers(spark, path).select(F.col("dens"), "G1", "G2", "Qbits.*").first()
    assert list(row) == [3.5, 1.0, 2.0, 2, 1, 0]


def test_field_potential_boundary_pressure(spark, tmp_path):
    t89 = _file(tmp_path / "t89.dat", "year mo dy hr mn sc bx by bz", "2014 4 10 1 2 3 1.0 2.0 3.0 -4.0 -5.0 -6.0")
    assert list(G.read_field_rows(spark, t89).first())[1:] == [dt.datetime(2014, 4, 10, 1, 2, 3), [1.0, 2.0, 3.0], [-4.0, -5.0, -6.0]]
    for head, phi, mlt in ((" L MLT Epot", np.pi / 2, 6.0), (" L Phi Epot", 6.0, 72 / np.pi)):
        row = G.read_potential(spark, _file(tmp_path / f"{head.split()[1]}.in", "UT = 0", head, " 2.0 6.0 -1.5")).first()
        assert np.allclose([row["l"], row["phi"], row["mlt"], row["potential"]], [2.0, phi, mlt, -1.5])
    bound = _file(tmp_path / "b.dat", "3.00000E+02 2014 4 10 0 5 0", " Units are Hours, cm-3, and eV", " lt RhoH pPar", "00 1.5E+00 *************", "01 2.5E+00 3.0E+03")
    rows = G.read_boundary(spark, bound).orderBy("point").collect()
    assert [r["values"] for r in rows] == [{"lt": 0.0, "RhoH": 1.5, "pPar": 100000.0}, {"lt": 1.0, "RhoH": 2.5, "pPar": 3000.0}] and rows[0]["time"] == dt.datetime(2014, 4, 10, 0, 5) and rows[0]["elapsed"] == 300.0
    pressure = _file(tmp_path / "p.dat", "T= 0.0", "Lsh MLT PPER_H PPAR_E PTotal [keV/cm3]", "2.0 0.0 1.0 2.0 3.0")
    assert G.read_pressure(spark, pressure).drop("path").first().asDict() == {"L": 2.0, "mlt": 0.0, "perH": 1.0, "pare": 2.0, "total": 3.0}
