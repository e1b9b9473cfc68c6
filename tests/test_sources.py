import numpy as np
import pytest

from matrixloom.model import SparseFrame
from matrixloom.plans import report
from matrixloom.sources import benchlog, files, mtx
from matrixloom.streaming import runs as stream

REAL = "%%MatrixMarket matrix coordinate real symmetric\n% comment\n3 3 4\n1 1 2.0\n2 1 -1.0\n3 2 -1.0\n3 3 2.0\n"


def put(tmp_path, text, name="a.mtx"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def cells(a):
    return {(r["row"], r["col"]): r["val"] for r in a.entries.collect()}


def test_symmetric(spark, tmp_path):
    header, a = mtx.read_mtx(spark, put(tmp_path, REAL))
    assert (header.m, header.n, header.nnz, header.symmetry) == (3, 3, 4, "symmetric")
    assert cells(a) == {(0, 0): 2, (1, 0): -1, (0, 1): -1, (2, 1): -1, (1, 2): -1, (2, 2): 2}


@pytest.mark.parametrize(
    "banner,body,expected",
    [
        ("coordinate integer skew-symmetric", "2 2 1\n2 1 5", {(1, 0): 5, (0, 1): -5}),
        ("coordinate complex hermitian", "2 2 2\n1 1 3 4\n2 1 6 8", {(0, 0): 5, (1, 0): 10, (0, 1): 10}),
        ("coordinate pattern general", "2 3 2\n1 3\n2 1", {(0, 2): 1, (1, 0): 1}),
        ("array real general", "2 2\n1\n2\n3\n4", {(0, 0): 1, (1, 0): 2, (0, 1): 3, (1, 1): 4}),
        ("array real symmetric", "2 2\n1\n2\n3", {(0, 0): 1, (1, 0): 2, (0, 1): 2, (1, 1): 3}),
    ],
)
def test_kinds(spark, tmp_path, banner, body, expected):
    assert cells(mtx.read_mtx(spark, put(tmp_path, f"%%MatrixMarket matrix {banner}\n{body}\n"))[1]) == expected


def test_no_banner_and_wrong_count(spark, tmp_path):
    assert cells(mtx.read_mtx(spark, put(tmp_path, "2 2 1\n1 2 7\n"))[1]) == {(0, 1): 7}
    with pytest.raises(ValueError, match="entries"):
        mtx.read_mtx(spark, put(tmp_path, "2 2 3\n1 2 7\n"))


def test_mtx_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(int(r), int(c), float(v)) for r, c, v in zip(rng.integers(0, 50, 300), rng.integers(0, 40, 300), rng.normal(size=300), strict=True)]
    a = SparseFrame(spark.createDataFrame(rows, "row long, col long, val double").repartition(4), 50, 40)
    mtx.write_mtx(a, str(tmp_path / "out"))
    header, b = mtx.read_mtx(spark, str(tmp_path / "out"))
    assert (header.m, header.n, header.nnz) == (50, 40, 300)
    assert sorted(map(tuple, b.entries.collect())) == sorted(rows)


def test_smtx(spark, tmp_path):
    a = files.read_smtx(spark, put(tmp_path, "4, 6, 7\n0 3 3 6 7\n0 1 4 1 2 5 3\n", "a.smtx"))
    assert sorted(cells(a)) == [(0, 0), (0, 1), (0, 4), (2, 1), (2, 2), (2, 5), (3, 3)] and (a.m, a.n) == (4, 6)


def test_tokens(spark, tmp_path):
    path = put(tmp_path, "a b,c\n d  e\n")
    token = lambda kind: [r[0] for r in files.read_tokens(spark, path, kind).collect()]
    assert token("line") == ["a b,c", " d  e"] and token("word") == ["a", "b,c", "d", "e"] and token("csv") == ["a", "b", "c", "d", "e"]


def test_roofline(spark, tmp_path):
    path = put(tmp_path, '{"empirical": {"gflops": {"data": [["FP32", "100.5"]]}, "gbytes": {"data": [["L1", 50], ["DRAM", 5]]}}}', "r.json")
    roofs = files.read_roofline(spark, path)
    assert {(r["kind"], r["label"], r["value"]) for r in roofs.collect()} == {("gflops", "FP32", 100.5), ("gbytes", "L1", 50.0), ("gbytes", "DRAM", 5.0)}
    assert {r["label"]: r["knee"] for r in report.roofline_knees(roofs).collect()} == {"L1": 2.01, "DRAM": 20.1}


LINE = "SpMM kernel - matrix: ./matrices/{}.mtx (2708 rows, 2708 cols, 10556 nnz), read: 0.0100, coo_to_csr: 0.0020, format_conversion: 0.0030, format: {}, k: 128, system: AMD-EPYC-24, gflops: {}"


def test_logs(spark, tmp_path):
    text = "\n".join([LINE.format("cora", "VENDOR_A", "41.50"), LINE.format("cora", "VENDOR_A", "42.50"), "noise", LINE.format("b.c", "Basic CSR", "1.0")])
    logs = benchlog.read_logs(spark, put(tmp_path, text, "x.log"), "./matrices/", {"VENDOR_A": "VENDOR"})
    got = report.runs_avg(logs).collect()
    assert len(got) == 1 and got[0]["matrix"] == "cora" and got[0]["gflops"] == 42.0 and got[0]["format"] == "VENDOR" and got[0]["repeats"] == 2


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    put(folder, LINE.format("cora", "VENDOR_A", "41.50"), "1.log")
    q = stream.stream_averages(stream.stream_runs(spark, str(folder), "./matrices/")).writeStream.outputMode("complete").format("memory").queryName("averages").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        put(folder, LINE.format("cora", "VENDOR_A", "43.50"), "2.log")
        q.processAllAvailable()
        assert [tuple(r) for r in spark.sql("select matrix, gflops, repeats from averages").collect()] == [("cora", 42.5, 2)]
    finally:
        q.stop()


def test_pivot_of_repeats_is_an_error(spark):
    rows = spark.createDataFrame([("m", "f", 16, 1.0), ("m", "f", 16, 2.0)], "matrix string, format string, k int, gflops double")
    with pytest.raises(Exception, match="two values"):
        report.pivot_gflops(rows, ["f_16"]).collect()


def test_ppm(spark, tmp_path):
    pixels = spark.createDataFrame([(0, 1, 10, 20, 30), (1, 0, 0, 0, 0)], "y long, x long, r long, g long, b long")
    files.write_ppm(pixels, str(tmp_path / "out"), 2, 2)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in files.read_ppm(spark, put(tmp_path, text, "a.ppm")).collect()}
    assert got == {(0, 0): (255, 255, 255), (0, 1): (10, 20, 30), (1, 0): (0, 0, 0), (1, 1): (255, 255, 255)}
    (tmp_path / "b.ppm").write_bytes(b"P6 # binary\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, 6]))
    assert [tuple(r) for r in files.read_ppm(spark, str(tmp_path / "b.ppm")).orderBy("x").collect()] == [(0, 0, 1, 2, 3, 255), (0, 1, 4, 5, 6, 255)]


def test_complex_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(0, 1, (1.5, -2.0)), (3, 0, (0.0, 4.0))], "row long, col long, val struct<re:double,im:double>")
    mtx.write_complex(e, 4, 2, str(tmp_path / "c"))
    assert sorted(mtx.read_complex(spark, str(tmp_path / "c")).collect()) == sorted(e.collect())
    assert cells(mtx.read_mtx(spark, str(tmp_path / "c"))[1]) == {(0, 1): 2.5, (3, 0): 4.0}


def test_counters(spark, tmp_path):
    runs = spark.createDataFrame([("m", "f", 16, 1.0), ("n", "f", 16, 2.0)], "matrix string, format string, k int, gflops double")
    counters = spark.read.csv(put(tmp_path, "matrix,format,k,bytes\nm,f,16,77\n", "c.csv"), header=True, schema="matrix string, format string, k int, bytes long")
    assert {r["matrix"]: r["bytes"] for r in report.with_counters(runs, counters).collect()} == {"m": 77, "n": None}
