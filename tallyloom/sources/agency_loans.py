"""Loan files of the mortgage agencies: acquisitions and monthly performance by quarter of origination."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.contracts import ContractError
from tallyloom.sources.converted import ConvertedTables
from tallyloom.sources.loan_archives import unzipped

# Columns of the files, in their order.
FANNIE_ACQUISITION = (
    "loan_id channel seller_name orig_int_rate orig_upb orig_term orig_date first_pay_date orig_ltv orig_cltv n_borrowers orig_dti credit_score "
    "first_time_flag loan_purpose prop_type n_units occ_status prop_state zip3 mi_pct prod_type co_borr_credit_score mi_type reloc"
).split()
FREDDIE_ACQUISITION = (
    "credit_score first_pay_date first_time_flag maturity_date msa mi_pct n_units occ_status orig_cltv orig_dti orig_upb orig_ltv orig_int_rate "
    "channel prepay_pen_flag prod_type prop_state prop_type zip3 loan_id loan_purpose orig_term n_borrowers seller_name servicer_name"
).split()
FREDDIE_PERFORMANCE = (
    "loan_id asof_date current_upb delinq loan_age months_left repurchase modification zero_balance zero_balance_date current_rate "
    "current_deferred_upb last_due_date mi_recoveries net_sales_proceeds non_mi_recoveries expenses legal_costs maintenance_costs "
    "taxes_and_insurance misc_expenses actual_loss modification_cost step_modification_flag deferred_pay_mod estimated_ltv"
).split()
#: Columns that are numbers, and those that are months.
NUMBERS = set(
    "orig_int_rate orig_upb orig_term orig_ltv orig_cltv orig_dti credit_score n_borrowers n_units mi_pct co_borr_credit_score current_upb loan_age "
    "months_left current_rate current_deferred_upb mi_recoveries non_mi_recoveries expenses legal_costs maintenance_costs taxes_and_insurance "
    "misc_expenses actual_loss modification_cost estimated_ltv".split()
)
MONTHS = set("orig_date first_pay_date maturity_date asof_date zero_balance_date last_due_date".split())
#: Delinquency of property that the agency owns, and of what is no number. Fixed values.
OWNED, UNKNOWN = -1, -2

#: Columns, whether the file is in a zip archive, the archive's or file's name, and the member's.
DATASETS = {
    "fannie_acquisition": (FANNIE_ACQUISITION, "Acquisition_{year}Q{quarter}.txt", ""),
    "freddie_acquisition": (FREDDIE_ACQUISITION, "historical_data1_Q{quarter}{year}.zip", "historical_data1_Q{quarter}{year}.txt"),
    "freddie_performance": (FREDDIE_PERFORMANCE, "historical_data1_Q{quarter}{year}.zip", "historical_data1_time_Q{quarter}{year}.txt"),
}


def month(text: Column) -> Column:
    """The first day of a month given as 04/2005 or 200504; anything else is missing."""
    digits = F.when(text.rlike(r"^(0?[1-9]|1[0-2])/\d{4}$"), F.concat(F.substring_index(text, "/", -1), F.lpad(F.substring_index(text, "/", 1), 2, "0"))).when(text.rlike(r"^\d{4}(0[1-9]|1[0-2])$"), text)
    return F.make_date(F.substring(digits, 1, 4).try_cast("int"), F.substring(digits, 5, 2).try_cast("int"), F.lit(1))


def loan_fields(line: Column, dataset: str) -> list[Column]:
    """Typed columns of a line: codes stay text, and what is no number or month is missing."""
    names = DATASETS[dataset][0]
    parts = F.split(line, r"\|")
    out = []
    for i, name in enumerate(names):
        text = F.nullif(F.trim(F.get(parts, F.lit(i))), F.lit(""))
        out.append((text.try_cast("double") if name in NUMBERS else month(text) if name in MONTHS else text).alias(name))
    return out


def performance(rows: DataFrame) -> DataFrame:
    """Monthly rows with delinquency as a number (OWNED, or UNKNOWN), reo, and proceeds as an amount or a code."""
    amount = F.col("net_sales_proceeds").try_cast("double")
    owned = F.coalesce(F.col("delinq") == "R", F.lit(False))
    number = F.when(owned, F.lit(float(OWNED))).otherwise(F.coalesce(F.col("delinq").try_cast("double"), F.lit(float(UNKNOWN))))
    return rows.withColumns(
        {"reo": owned, "delinq": number.cast("long"), "net_sales_proceeds_amt": amount, "net_sales_proceeds_code": F.when(amount.isNull(), F.col("net_sales_proceeds"))}
    ).drop("net_sales_proceeds")


class AgencyLoans:
    """Quarters of a dataset: raw files in a folder, converted once to Parquet in its folder storage."""

    def __init__(self, spark: SparkSession, folder: str, dataset: str):
        if dataset not in DATASETS:
            raise ContractError(f"no dataset {dataset!r}; there are {sorted(DATASETS)}")
        self.spark, self.folder, self.dataset = spark, folder.rstrip("/"), dataset
        self.tables = ConvertedTables(spark, f"{self.folder}/storage")

    def raw(self, year: int, quarter: int) -> DataFrame | None:
        """A quarter's lines as value, or None if its file is not there."""
        _, name, member = DATASETS[self.dataset]
        name, member = (x.format(year=year, quarter=quarter) for x in (name, member))
        if name not in self.tables.files(self.folder):
            return None
        path = f"{self.folder}/{name}"
        return unzipped(self.spark, path, "latin-1", False, member).select("value") if member else self.spark.read.text(path)

    def load(self, year: int, quarter: int, columns: Iterable[str] | None = None, again: bool = False) -> DataFrame | None:
        """A quarter's loans, or None if there are none; again: make the Parquet table anew from the raw file."""
        name = f"{self.dataset}_{year}Q{quarter}"
        if again or not self.tables.has(name):
            lines = self.raw(year, quarter)
            if lines is None:
                return None
            made = lines.where(F.length("value") > 0).select(*loan_fields(F.col("value"), self.dataset))
            self.tables.make(name, lambda: performance(made) if self.dataset == "freddie_performance" else made, overwrite=again)
        rows = self.tables.read(name)
        return rows if columns is None else rows.select(*columns)

    def load_all(self, quarters: Iterable[tuple[int, int]], columns: Iterable[str] | None = None) -> DataFrame:
        """All the quarters that are there, one after the other, with their year and quarter."""
        columns = None if columns is None else list(columns)
        found = [(y, q, self.load(y, q, columns)) for y, q in quarters]
        parts = [df.withColumns({"year": F.lit(y), "quarter": F.lit(q)}) for y, q, df in found if df is not None]
        if not parts:
            raise FileNotFoundError(f"no file of {self.dataset} in {self.folder}")
        return reduce(DataFrame.unionByName, parts)
