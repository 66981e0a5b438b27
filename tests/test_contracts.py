import io
import zipfile

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.sources import contracts, readers


def test_names_are_trimmed_and_must_not_meet(spark):
    df = spark.createDataFrame([(1, 2)], " Name  int, VALUE int".replace(" Name ", "` Name `"))
    assert contracts.normalize_columns(df).columns == ["name", "value"]
    with pytest.raises(contracts.ContractError):
        contracts.normalize_columns(spark.createDataFrame([(1, 2)], "` A ` int, a int"))


def test_integers(spark):
    good = spark.createDataFrame([("1",), ("2.0",), (None,)], "v string")
    assert rows(contracts.normalize_dataframe(good, integer=["v"])) == [(1,), (2,), (None,)]
    for bad in ("true", "1.5", "inf"):
        with pytest.raises(contracts.ContractError):
            contracts.normalize_dataframe(spark.createDataFrame([(bad,)], "v string"), integer=["v"])


def test_numbers_and_binaries(spark):
    with pytest.raises(contracts.ContractError):
        contracts.normalize_dataframe(spark.createDataFrame([(float("inf"),)], "v double"), numeric=["v"])
    df = spark.createDataFrame([(v,) for v in (" TRUE ", "false", "1.00", "0.0", None)], "v string")
    assert [v for (v,) in rows(contracts.normalize_dataframe(df, binary=["v"]))] == [True, False, True, False, None]
    with pytest.raises(contracts.ContractError):
        contracts.normalize_dataframe(spark.createDataFrame([("maybe",)], "v string"), binary=["v"])


def test_keys_and_kinds(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    with pytest.raises(contracts.ContractError):
        contracts.require_unique_key(df, "k")
    assert [d for *_, d in rows(contracts.duplicate_mask(df, "k", "first", ["v"]), "v")] == [False, True, False]
    assert [d for *_, d in rows(contracts.duplicate_mask(df, "k"), "v")] == [True, True, False]
    assert contracts.validate_dataframe(df, integer=["k"], string=["v"], usecols=["v"]).columns == ["v"]
    with pytest.raises(contracts.ContractError):
        contracts.validate_dataframe(df, numeric=["v"])
    with pytest.raises(contracts.ContractError):
        contracts.normalize_dataframe(df, string=["v"], integer=["v"])


def test_samples(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, 3.0)], "a double, b double")
    assert len(rows(contracts.match_sample(df, ["a", "b"]))) == 1
    assert rows(contracts.match_sample(df, ["a", "b"], "outer"), "a") == [(1.0, 0.0), (2.0, 3.0)]
    with pytest.raises(ValueError):
        contracts.match_sample(df, ["a"], "left")


def test_numeric_tokens(spark):
    df = spark.createDataFrame([(v,) for v in (" NA ", "1,234, 567", "12,34", "1 250", "")], "v string")
    assert [v for (v,) in rows(df.select(contracts.null_numeric_tokens(F.col("v"))))] == [None, "1234567", "12,34", "1250", None]


def test_canonical_columns_of_two_sources(spark):
    columns = [("year", "as_of", "int"), ("amount", "amt", "double"), ("lei", "lei", "string")]
    a = contracts.canonical(spark.createDataFrame([("2014", "75")], "as_of string, amt string"), columns, {"source": "a"})
    b = contracts.canonical(spark.createDataFrame([(2016, 3.5)], "as_of int, amt double"), columns, {"source": "b"})
    assert a.dtypes == b.dtypes and rows(a) == [(2014, 75.0, None, "a")]


def test_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("0000123456 1 250\n0000000001  2 05\n")
    fields = [("id", 10, "string"), ("amount", 6, "int")]
    assert rows(readers.read_fixed_width(spark, str(tmp_path / "f.txt"), fields), "id") == [("0000000001", 205), ("0000123456", 1250)]
    readers.check_record_width(spark, str(tmp_path / "f.txt"), 16)
    with pytest.raises(contracts.ContractError):
        readers.check_record_width(spark, str(tmp_path / "f.txt"), 15)
    (tmp_path / "d.csv").write_text("a;b\n1;2,5\nx;3\n")
    assert rows(readers.read_delimited(spark, str(tmp_path / "d.csv"), "a int, b double", ";", decimal_comma=True), "b") == [(1, 2.5), (None, 3.0)]
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("m.csv", "a,b\n1,x\n2,y\n")
    (tmp_path / "z.zip").write_bytes(buffer.getvalue())
    assert rows(readers.read_zipped(spark, str(tmp_path / "z.zip"), "m.csv", "a long, b string"), "a") == [(1, "x"), (2, "y")]


def test_matrices_and_coefficients(spark, tmp_path):
    m = np.arange(6.0).reshape(2, 3)
    readers.save_matrix(m, str(tmp_path / "m.bin"))
    got = {(r, c): v for _, r, c, v in rows(readers.read_matrices(spark, str(tmp_path / "m.bin")))}
    assert got == {(i, j): m[i, j] for i in range(2) for j in range(3)}
    with pytest.raises(ValueError):
        readers.matrix_of((tmp_path / "m.bin").read_bytes(), shape=(4, 4))
    (tmp_path / "b.txt").write_text("1.5 2.5\n")
    (tmp_path / "v.txt").write_text("4 0\n0 9\n")
    assert rows(readers.read_coefficients(spark, str(tmp_path / "b.txt"), str(tmp_path / "v.txt")), "place") == [(0, 1.5, 2.0), (1, 2.5, 3.0)]


def test_registry_and_filters(spark, tmp_path):
    readers.convert_to_parquet(spark.range(10), str(tmp_path / "r"))
    registry = readers.Registry()
    registry.add("r", "ten numbers", lambda **k: readers.load_partition(spark, str(tmp_path / "r"), **k))
    assert registry.names() == {"r": "ten numbers"}
    assert registry.load("r", filters=[("id", ">=", 8)], columns=["id"]).count() == 2
    with pytest.raises(ValueError):
        registry.load("q")
    assert readers.valid_parquet(spark, str(tmp_path / "r")) and not readers.valid_parquet(spark, str(tmp_path / "none"))
    with pytest.raises(NotImplementedError):
        readers.read_external("xlsx", "a.xlsx")
