"""Length-framed files, packed here by hand, read in slices as a data source."""

import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.sources import records as R


def frame(order, real, step, time, sizes, names, coordinates, values, parameters=()):
    mark = lambda b: struct.pack(f"{order}i", len(b)) + b + struct.pack(f"{order}i", len(b))
    t = "f" if real == "f4" else "d"
    parts = [b"R R Mp/cc" + b" " * 70, struct.pack(f"{order}i{t}iii", step, time, len(coordinates), len(parameters), len(values)), struct.pack(f"{order}{len(sizes)}i", *sizes)]
    if parameters:
        parts.append(np.array(parameters, f"{order}{real}").tobytes())
    parts += [" ".join(names).encode(), np.array(coordinates, f"{order}{real}").tobytes()]
    return b"".join(map(mark, parts + [np.array(v, f"{order}{real}").tobytes() for v in values]))


def sample(order, real, frames=3, n=1000):
    rng = np.random.default_rng(4)
    data = rng.normal(size=(frames, 4, n)).astype(real)
    names = ["x", "z", "rho", "p", "g"]
    return data, b"".join(frame(order, real, 10 * k, 1.5 * k, (n, 1), names, d[:2], d[2:], (5 / 3,)) for k, d in enumerate(data))


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("real", ["f4", "f8"])
def test_frames_in_slices(spark, tmp_path, order, real):
    data, content = sample(order, real)
    (tmp_path / "a.outs").write_bytes(content)
    df = R.read_record_frames(spark, str(tmp_path), points=300)
    assert df.columns == [*(f.name for f in R.FRAME), "x", "z", "rho", "p"]
    assert df.rdd.getNumPartitions() == 12  # four ranges of points for each of three frames
    rows = df.orderBy("frame", "point").collect()
    assert len(rows) == 3000 and {(r["frame"], r["iteration"], r["run_time"]) for r in rows} == {(0, 0, 0.0), (1, 10, 1.5), (2, 20, 3.0)} and rows[0]["title"] == "R R Mp/cc"
    assert all(r[c] == data[r["frame"], k, r["point"]] for r in rows for k, c in enumerate(("x", "z", "rho", "p")))


def test_only_wanted_bytes_are_read(spark, tmp_path):
    """Values of other variables and frames may be anything: they are not looked at; only the named arrays and frames are."""
    data, content = sample("<", "f8")
    (tmp_path / "a.outs").write_bytes(content)
    found = R.read_record_frames(spark, str(tmp_path / "a.outs"), ["p", "missing"], points=500)
    one = found.where("frame = 1 and point < 700")
    assert {r["frame"] for r in one.collect()} == {1} and sorted(r["p"] for r in one.collect()) == sorted(data[1, 3, :700])
    assert one.where("missing is not null").count() == 0
    reader = R.FrameReader([str(tmp_path / "a.outs")], "frames", 500, found.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    rest = list(reader.pushFilters([EqualTo(("frame",), 1), GreaterThan(("point",), 3)]))
    assert [p.frame.frame for p in reader.partitions()] == [1, 1] and [r.attribute for r in rest] == [("point",)]
    assert "frame" in one._jdf.queryExecution().executedPlan().toString()


def test_blocks(spark, tmp_path):
    mark = lambda b: struct.pack(">i", len(b)) + b + struct.pack(">i", len(b))
    value = np.arange(24, dtype=">f8").reshape(2, 3, 4)
    parts = [struct.pack(">d", 3.13), struct.pack(">3i", 2, 3, 4), struct.pack(">i", 2), b"Rho     ", b"[O!U+!N] ", struct.pack(">7i", 2014, 4, 10, 1, 2, 3, 250), value.ravel(order="F").tobytes(), (2 * value).astype(">f8").ravel(order="F").tobytes()]
    (tmp_path / "b.bin").write_bytes(b"".join(map(mark, parts)))
    rows = R.read_record_frames(spark, str(tmp_path / "b.bin"), layout="blocks", points=5).collect()
    assert len(rows) == 24 and all(r["Rho"] == value[r["i"], r["j"], r["k"]] and r["O!U+!N"] == 2 * r["Rho"] for r in rows)
    assert rows[0]["time"] == dt.datetime(2014, 4, 10, 1, 2, 3, 250000) and rows[0]["version"] == 3.13


def test_broken_files(spark, tmp_path):
    _, content = sample("<", "f4", 2, 50)
    for name, broken in {"empty": b"", "text": b"no records here", "short": content[:-30], "marker": content[:-4] + b"\x01\x00\x00\x00"}.items():
        (tmp_path / name).write_bytes(broken)
        with pytest.raises(ValueError, match=name):
            R.frames_of(str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        R.files_of([str(tmp_path / "nothing")])


@pytest.mark.parametrize("double", [False, True])
def test_written_frames(spark, tmp_path, double):
    df = spark.range(500).select((F.col("id") % 2).alias("file"), (F.floor(F.col("id") / 2) % 3).cast("int").alias("step"), F.col("id"), (F.col("id") / 8).alias("x"), (-F.col("id")).alias("v"))
    found = R.write_record_frames(df, f"file://{tmp_path}/out", "file", "step", "id", ["x"], ["v"], double, ">").collect()
    assert sorted(r["frames"] for r in found) == [3, 3]
    back = R.read_record_frames(spark, [r["path"] for r in found], points=20)
    assert {(r["iteration"], r["x"], r["v"]) for r in back.collect()} == {(r["step"], r["x"], float(r["v"])) for r in df.collect()} and back.count() == 500
