"""The tables that this package can load, by name: what each is, and a loader."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.sources import publishers
from tallyloom.sources.agency_loans import DATASETS, AgencyLoans
from tallyloom.sources.loan_archives import LoanArchive
from tallyloom.sources.readers import Registry


def loan_registers(spark: SparkSession, root: str, years: Iterable[int], source: str = "nara", columns: Iterable[str] | None = None) -> DataFrame:
    """Loans of several years under canonical names, each converted if it is not yet."""
    archive, columns = LoanArchive(spark, root), None if columns is None else list(columns)
    parts = [archive.load(y, source, columns, canonical=True, convert=True) for y in years]
    if not parts:
        raise ValueError("no year is asked for")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flow_variables(spark: SparkSession, folder: str, group: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A group's variables from the CSV files of a folder, one a table."""
    if group not in publishers.FLOW_SETS:
        raise ValueError(f"no group {group!r}; there are {sorted(publishers.FLOW_SETS)}")
    jvm = spark._jvm
    there = jvm.org.apache.hadoop.fs.Path(folder)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())

    def read(name: str) -> DataFrame | None:
        path = f"{folder.rstrip('/')}/{name}.csv"
        return publishers.read_table(spark, path) if fs.exists(jvm.org.apache.hadoop.fs.Path(path)) else None

    return publishers.flow_set(read, publishers.FLOW_SETS[group], publishers.FLOW_FORMER, columns)[0]


def agency(dataset: str) -> Callable[..., DataFrame]:
    def load(spark: SparkSession, folder: str, quarters: Iterable[tuple[int, int]], columns: Iterable[str] | None = None) -> DataFrame:
        return AgencyLoans(spark, folder, dataset).load_all(quarters, columns)

    return load


REGISTRY = Registry()
REGISTRY.add("housing_values", "Housing values of regions by month, from the publisher's wide CSV file", lambda spark, path, **more: publishers.housing_values(publishers.read_table(spark, path), **more))
REGISTRY.add("price_index", "House price indices by level and frequency, from the publisher's CSV file", lambda spark, path, level, frequency: publishers.price_index(spark.read.csv(path), level, frequency))
REGISTRY.add("tax_statistics", "Income tax statistics of a year by county or ZIP code, from the publisher's CSV file", lambda spark, path, level, year: publishers.tax_statistics(publishers.read_table(spark, path), level, year))
REGISTRY.add("loan_registers", "Mortgage loans of several years under canonical names", loan_registers)
REGISTRY.add("flow_table", "A table of the flow of funds by period", lambda spark, path, **more: publishers.flow_table(publishers.read_table(spark, path), **more))
REGISTRY.add("flow_variables", "A group of variables of the flow of funds by quarter", flow_variables)
for _name in DATASETS:
    REGISTRY.add(_name, f"Agency loans by quarter of origination: {_name.replace('_', ' ')}", agency(_name))


def list_datasets() -> dict[str, str]:
    """Names and what they are."""
    return REGISTRY.names()


def load_dataset(name: str, spark: SparkSession, *args, **more) -> DataFrame:
    return REGISTRY.load(name, spark, *args, **more)
