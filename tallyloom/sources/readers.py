"""Readers and writers of files: delimited, fixed-width, zipped, matrices, JSON, and a registry of tables."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.plans.session import send_package
from tallyloom.sources.contracts import ContractError

#: Formats without a reader among the installed libraries.
NOT_READABLE = ("xlsx", "sas7bdat", "dta", "hdf5", "mat", "pickle")


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: str | T.StructType, sep: str = ",", header: bool = True, encoding: str = "UTF-8", decimal_comma: bool = False
) -> DataFrame:
    """Delimited text by an explicit schema; a value of another form is missing. With decimal_comma,
    numbers are written with a comma."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])
    raw = spark.read.csv(path, schema=text, sep=sep, header=header, encoding=encoding)

    def value(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if decimal_comma and isinstance(f.dataType, T.NumericType):
            c = F.replace(c, F.lit(","), F.lit("."))
        return c.try_cast(f.dataType).alias(f.name)

    return raw.select(*map(value, wanted))


def read_fixed_width(spark: SparkSession, path: str, fields: Sequence[tuple[str, int, str]]) -> DataFrame:
    """Records of one line: (name, width, type) in order; blanks around a value go, and an empty or
    badly formed one is missing."""
    lines, columns, at = spark.read.text(path), [], 1
    for name, width, kind in fields:
        c = F.nullif(F.trim(F.substring("value", at, width)), F.lit(""))
        columns.append((c if kind == "string" else F.replace(c, F.lit(" "), F.lit("")).try_cast(kind)).alias(name))
        at += width
    return lines.select(*columns)


def check_record_width(spark: SparkSession, path: str, width: int, records: int = 20) -> None:
    for row in spark.read.text(path).limit(records).collect():
        if len(row["value"]) != width:
            raise ContractError(f"a record of {len(row['value'])} characters, not {width}")


def read_zipped(spark: SparkSession, path: str, member: str, schema: str, **options) -> DataFrame:
    """One CSV member of every ZIP file under path; an archive is read by one task, in parts."""
    names = [f.name for f in T._parse_datatype_string(schema)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    yield from (p[names] for p in pd.read_csv(f, chunksize=100_000, **options))

    send_package(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def read_first(spark: SparkSession, path: str, columns: Sequence[str], n: int) -> DataFrame:
    return spark.read.parquet(path).select(*columns).limit(n)


def load_partition(spark: SparkSession, path: str, filters: Sequence[tuple[str, str, object]] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table with conjunctive filters (column, operator, value) and a choice of columns, both
    of which reach the scan."""
    out = spark.read.parquet(path)
    compare = {
        "==": lambda c, v: c == v, "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
        "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)),
    }
    for name, op, value in filters:
        if op not in compare:
            raise ContractError(f"unknown operator {op!r}")
        out = out.where(compare[op](F.col(name), value))
    return out.select(*columns) if columns else out


def convert_to_parquet(df: DataFrame, path: str, partitions: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def valid_parquet(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(path).schema)
    except Exception:
        return False


def save_matrix(values: np.ndarray, path: str, dtype: str = "float64") -> None:
    """Two 32-bit numbers, rows and columns, then the values by columns."""
    values = np.atleast_2d(values)
    with open(path, "wb") as f:
        f.write(struct.pack("<ii", *values.shape))
        f.write(np.asfortranarray(values, dtype=dtype).tobytes(order="F"))


def matrix_of(content: bytes, dtype: str = "float64", shape: tuple[int, int] | None = None) -> np.ndarray:
    rows, columns = struct.unpack("<ii", content[:8])
    values = np.frombuffer(content[8:], dtype=dtype)
    if shape is not None and int(np.prod(shape)) != len(values):
        raise ValueError(f"{len(values)} values do not make {shape}")
    return values.reshape(shape or (rows, columns), order="F")


def read_matrices(spark: SparkSession, path: str, dtype: str = "float64") -> DataFrame:
    """(file, row, column, value) of the matrices under path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                m = matrix_of(content, dtype)
                r, c = np.indices(m.shape)
                yield pd.DataFrame({"file": name, "row": r.ravel(), "column": c.ravel(), "value": m.ravel().astype("float64")})

    send_package(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row long, column long, value double")


def read_coefficients(spark: SparkSession, b_path: str, v_path: str) -> DataFrame:
    """(place, coef, se) from a vector and a covariance written as white-space-separated text."""
    numbers = F.transform(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " "), lambda x: x.try_cast("double"))
    b = spark.read.text(b_path, wholetext=True).select(F.posexplode(numbers).alias("place", "coef"))
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    v = spark.read.text(v_path, wholetext=True).select(F.posexplode(lines).alias("place", "value"))
    return b.join(v.select("place", F.sqrt(F.get(numbers, F.col("place"))).alias("se")), "place")


def write_numeric(value: float, path: str, form: str = "4.3f") -> None:
    with open(path, "w") as f:
        f.write(format(value, form))


def read_numeric(path: str) -> float:
    with open(path) as f:
        return float(f.read())


def write_json(value: object, path: str) -> None:
    with open(path, "w") as f:
        json.dump(value, f)


def read_json(path: str) -> object:
    with open(path) as f:
        return json.load(f)


class Registry:
    """Named loaders of tables, with descriptions."""

    def __init__(self) -> None:
        self._loaders: dict[str, tuple[str, Callable[..., DataFrame]]] = {}

    def add(self, name: str, description: str, loader: Callable[..., DataFrame]) -> None:
        self._loaders[name] = (description, loader)

    def names(self) -> dict[str, str]:
        return {n: d for n, (d, _) in sorted(self._loaders.items())}

    def load(self, name: str, *args, **kwargs) -> DataFrame:
        if name not in self._loaders:
            raise ValueError(f"no table {name!r}; there are {sorted(self._loaders)}")
        return self._loaders[name][1](*args, **kwargs)


def read_external(kind: str, path: str) -> DataFrame:
    """Formats that need a library that isn't here: convert them to Parquet first."""
    raise NotImplementedError(f"{path}: {kind} files can't be read here; convert them to Parquet" if kind in NOT_READABLE else f"unknown format {kind!r}")
