"""Readers of many files and of binary formats: round trips, refusals, and what is left out."""

import io
import struct

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace.sources import binary, readers


def wave(n, seed):
    return np.random.default_rng(seed).normal(size=n)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("compress", [True, False])
def test_container_round_trip(order, compress):
    waves = {"force": wave(10, 0), "vibration_1": wave(3000, 1), "phase_current_1": wave(2000, 2), "empty": np.zeros(0)}
    raw = binary.container("N15_M07_F10_K001_1", waves, compress, order)
    assert {k: v.tolist() for k, v in binary.channels(memoryview(raw)).items()} == {k: v.tolist() for k, v in waves.items()}
    assert list(binary.channels(memoryview(raw), ["vibration_1"])) == ["vibration_1"]
    for cut in [0, 100, 127, 128, 140, len(raw) // 2, len(raw) - 9, len(raw) - 1]:
        with pytest.raises((EOFError, ValueError)):
            binary.channels(memoryview(raw[:cut]))
    with pytest.raises(ValueError):
        binary.channels(memoryview(b"x" * 200))


def test_container_elements_of_other_kinds():
    """Integers, complex numbers, cells and unknown elements stand beside what is read."""

    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def matrix(kind, dims, name, *parts, flags=0):
        return element(14, element(6, struct.pack("<II", kind | flags, 0)) + element(5, struct.pack(f"<{len(dims)}i", *dims)) + element(1, name) + b"".join(parts))

    small = struct.pack("<I", 2 << 16 | 3) + struct.pack("<h", -5) + b"\0\0"
    body = element(99, b"abc") + matrix(10, (1, 1), b"a", small) + matrix(6, (1, 2), b"b", element(9, struct.pack("<2d", 1, 2)), element(9, struct.pack("<2d", 3, 4)), flags=0x0800)
    body += matrix(1, (1, 2), b"c", matrix(6, (1, 1), b"", element(7, struct.pack("<f", 0.5))), element(14, b"")) + matrix(5, (2, 2), b"sparse", element(5, b"\0" * 8))
    head = b"".ljust(124) + struct.pack("<H", 0x0100) + b"IM"
    got = dict(binary.Container(memoryview(head + body)).variables())
    assert got["a"].tolist() == [-5] and got["b"].tolist() == [1 + 3j, 2 + 4j] and got["c"][0].tolist() == [0.5] and got["c"][1] is None and got["sparse"] is None


def test_bearing_recordings(spark, tmp_path):
    def put(bearing, point, k, n=30, current=30, cut=None):
        folder = tmp_path / bearing / bearing
        folder.mkdir(parents=True, exist_ok=True)
        name = f"{point}_{bearing}_{k}"
        waves = {"speed": wave(4, k), "vibration_1": wave(n, k)} | ({"phase_current_1": wave(current, k + 50)} if current else {})
        raw = binary.container(name, waves, k % 2 == 0)
        (folder / f"{name}.mat").write_bytes(raw[:cut])
        return waves

    for k in range(1, 5):
        first = put("K001", "N15_M07_F10", k) if k == 1 else put("K001", "N15_M07_F10", k)
        wanted = first if k == 1 else wanted
    put("KA04", "N09_M07_F10", 1, n=19)  # too short
    put("KA04", "N09_M07_F10", 2, cut=300)  # truncated
    put("KA04", "N09_M07_F10", 3, current=5)
    put("KA01", "N15_M07_F10", 1)  # no bearing of the table
    out = {r["session_id"]: r for r in readers.bearing_recordings(spark, str(tmp_path), most=3, window_s=2.0, fs=10.0).collect()}
    assert set(out) == {f"N15_M07_F10_K001_{k}" for k in (1, 2, 3)} | {"N09_M07_F10_KA04_3"}
    row = out["N15_M07_F10_K001_1"]
    assert row["vibration"] == wanted["vibration_1"][:20].tolist() and row["current"] == wanted["phase_current_1"][:20].tolist() and (row["label"], row["rpm"], row["fs"]) == ("healthy", 1500.0, 10.0)
    assert out["N09_M07_F10_KA04_3"]["current"] is None
    assert readers.bearing_recordings(spark, str(tmp_path), window_s=2.0, fs=10.0, current=False).where("current is not null").count() == 0
    errors = binary.recordings(binary.files(spark, str(tmp_path), "*.mat")).where("error is not null").select("path", "channels").collect()
    assert len(errors) == 1 and errors[0]["channels"] is None
    with pytest.raises(FileNotFoundError):
        readers.bearing_recordings(spark, str(tmp_path), window_s=9.0, fs=10.0)


def saved(a, **k):
    out = io.BytesIO()
    np.save(out, a, **k)
    return out.getvalue()


def test_arrays_of_every_kind():
    for kind in ["<f8", ">f8", "<f4", ">f4", "<f2", "i1", "<i2", ">i4", "<i8", "u1", ">u2", "<u8", "?"]:
        for shape in [(6,), (2, 3), (0,), (), (1, 2, 3)]:
            a = np.arange(np.prod(shape, dtype=int)).reshape(shape).astype(kind)
            for got in (binary.array(memoryview(saved(a))), binary.array(memoryview(saved(np.array(a, order="F"))))):
                assert got.dtype == a.dtype and got.shape == a.shape and (got == a).all()
    good = saved(np.arange(6.0))
    for bad in [b"", good[:5], good[:-1], good + b"\0", good.replace(b"(6,)", b"(7,)"), good.replace(b"<f8", b"|O8"), saved(np.array(["a"])), b"\x93NUMPY\x09" + good[7:]]:
        with pytest.raises((EOFError, ValueError)):
            binary.array(memoryview(bad))


def test_records_with_payloads(spark, tmp_path):
    import json

    (tmp_path / "w").mkdir()
    np.save(tmp_path / "w" / "v1.npy", np.arange(8.0).reshape(2, 4))
    np.save(tmp_path / "w" / "c1.npy", np.arange(3, dtype=">i2"))
    np.save(tmp_path / "w" / "unused.npy", np.arange(3))
    one = {"pump_id": "p1", "condition": "healthy", "vibration_path": "w/v1.npy", "current_path": "w/c1.npy", "rpm": 900}
    two = {"pump_id": "p2", "condition": "bearing", "severity": "2", "vibration_path": "w/v1.npy"}
    for i, e in enumerate((one, two)):
        (tmp_path / "w" / f"record_{i}.json").write_text(json.dumps(e))

    def check():
        got = {r["pump_id"]: r for r in readers.records(spark, str(tmp_path)).collect()}
        assert got["p1"]["vibration"] == list(range(8)) and got["p1"]["vibration_shape"] == [2, 4] and got["p1"]["current"] == [0, 1, 2] and got["p1"]["rpm"] == 900.0
        assert got["p2"]["current"] is None and got["p2"]["rpm"] == 1470.0 and got["p2"]["severity"] == "2" and got["p1"]["severity"] == "unknown" and got["p2"]["current_waveform"] is None

    check()
    (tmp_path / "manifest.json").write_text(json.dumps([one, two]))
    check()
    (tmp_path / "manifest.json").write_text(json.dumps([one, two | {"vibration_path": "w/none.npy"}]))
    with pytest.raises(PySparkException, match="missing"):
        readers.records(spark, str(tmp_path)).collect()
    raw = (tmp_path / "w" / "v1.npy").read_bytes()
    (tmp_path / "w" / "v1.npy").write_bytes(raw.replace(b"(2, 4)", b"(2, 5)"))
    (tmp_path / "manifest.json").write_text(json.dumps([one]))
    with pytest.raises(PySparkException, match="shape"):
        readers.records(spark, str(tmp_path)).collect()
    with pytest.raises(FileNotFoundError):
        readers.records(spark, str(tmp_path / "none"))


def telemetry_text(pump="A", sep=",", rows=2, cell=None, stamp=None, blank=0):
    decimal = "," if sep == ";" else "."
    lines = [sep.join(["Timestamp", *(f"{pump}_{c}" for c in readers.CHANNELS), "Barometer"])]
    for i in range(rows):
        cells = [f"0{decimal}{i}"] * len(readers.CHANNELS)
        if cell is not None and i == rows - 1:
            cells[2] = cell
        lines.append(sep.join([stamp if stamp is not None and i == rows - 1 else f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}Z", *cells, "1013"]))
    return "\n".join(lines) + "\n" + "\n" * blank + (sep * (len(readers.CHANNELS) + 1) + "\n") * blank


def test_many_telemetry_files_in_one_job(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"{'ABC'[i % 3]}_{i}.csv").write_text(telemetry_text("ABC"[i % 3], ",;"[i % 2], rows=4, blank=i % 2, cell="19.194.183" if i % 200 == 7 else None))
    spark.sparkContext.setJobGroup("many", "many")
    with pytest.warns(UserWarning, match="19.194.183"):
        out = readers.telemetry(spark, [str(tmp_path)])
    assert out.count() == 995 * 4
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("many")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 8  # whatever the files
    with pytest.raises(ValueError, match="corrupt"):
        readers.telemetry(spark, [str(tmp_path)], skip_corrupted=False)
    rows = readers.telemetry_rows(spark.read.format("binaryFile").load(str(tmp_path)))
    assert {(r["problem"], r["n"]) for r in rows.groupBy("problem").agg(F.count(F.lit(1)).alias("n")).collect()} == {(None, 995 * 4), ("cell", 5)}


@pytest.mark.parametrize(("text", "problem"), [(telemetry_text(stamp="yesterday?"), "timestamp"), (telemetry_text(stamp="2024-13-45"), "timestamp"), (telemetry_text().replace("A_Pres.PV", "A_Press"), "channels"), ("a,b\n1,2\n", "channels"), ("\n", "channels")])
def test_files_that_always_raise(spark, tmp_path, text, problem):
    (tmp_path / "A_1.csv").write_text(text)
    (tmp_path / "A_2.csv").write_text(telemetry_text())
    rows = readers.telemetry_rows(spark.read.format("binaryFile").load(str(tmp_path)))
    assert [r["problem"] for r in rows.where("error is not null").collect()] == [problem]
    for skip in (True, False):
        with pytest.raises(ValueError):
            readers.telemetry(spark, [str(tmp_path)], skip_corrupted=skip)


def test_telemetry_counts_every_row(spark, tmp_path):
    (tmp_path / "a.csv").write_text(telemetry_text(rows=5, cell="NaN"))
    (tmp_path / "b.csv").write_text(telemetry_text("B", ";", rows=5, cell="", stamp="", blank=3))
    out = readers.telemetry(spark, [str(tmp_path)])
    assert {r["pump"]: (r["count"], r["cells"]) for r in out.groupBy("pump").agg(F.count(F.lit(1)).alias("count"), F.count("ACR_Mot_TV").alias("cells")).collect()} == {"A": (5, 4), "B": (4, 4)}
    assert out.where("pump = 'B'").agg(F.max("Pres_PV")).first()[0] == 0.3


def test_numbered_lines_over_splits(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(5000)]
    (tmp_path / "lines.txt").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        out = readers.numbered_lines(spark, str(tmp_path / "lines.txt"))
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["n"], r["line"]) for r in got) == list(enumerate(lines))
