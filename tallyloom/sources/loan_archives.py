"""Loan registers of many years: fixed-width texts and zipped delimited files, converted to Parquet a year at a
time and read with their filters pushed down."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.session import send_package
from tallyloom.sources.contracts import ContractError
from tallyloom.sources.converted import ConvertedTables
from tallyloom.sources.publishers import LOAN_FIELDS, canonical_loans, named

# Sums by tract of 1981 to 1989 (name, width).
TRACT_FIELDS = (
    ("respondent_name", 28), ("respondent_id", 8), ("msa_of_report", 4), ("census_tract", 6), ("state_code", 2), ("county_code", 3),
    ("agency_code", 1), ("census_validity_flag", 2), ("government_loan_validity_flag", 1), ("government_loan_count", 4),
    ("government_loan_amount_000s", 9), ("conventional_loan_validity_flag", 1), ("conventional_loan_count", 4),
    ("conventional_loan_amount_000s", 9), ("home_improvement_validity_flag", 1), ("home_improvement_loan_count", 4),
    ("home_improvement_loan_amount_000s", 9), ("multifamily_validity_flag", 1), ("multifamily_loan_count", 4),
    ("multifamily_loan_amount_000s", 9), ("nonoccupant_validity_flag", 1), ("nonoccupant_loan_count", 4),
    ("nonoccupant_loan_amount_000s", 9), ("record_quality_flag", 1), ("filler", 1),
)

# Loan records of 2004 to 2014 (name, width).
LATER_FIELDS = (
    ("asof_date", 4), ("respondent_id", 10), ("agency_code", 1), ("loan_type", 1), ("loan_purp", 1), ("occupancy", 1), ("loan_amt", 5),
    ("action_taken", 1), ("prop_msa", 5), ("state_code", 2), ("county_code", 3), ("census_tract", 7), ("app_sex", 1), ("co_app_sex", 1),
    ("app_income", 4), ("purchaser_type", 1), ("denial_reason_1", 1), ("denial_reason_2", 1), ("denial_reason_3", 1), ("edit_status", 1),
    ("prop_type", 1), ("preapprovals", 1), ("app_ethnicity", 1), ("co_app_ethnicity", 1), ("app_race_1", 1), ("app_race_2", 1),
    ("app_race_3", 1), ("app_race_4", 1), ("app_race_5", 1), ("co_app_race_1", 1), ("co_app_race_2", 1), ("co_app_race_3", 1),
    ("co_app_race_4", 1), ("co_app_race_5", 1), ("rate_spread", 5), ("hoepa_status", 1), ("lien_status", 1), ("seq_num", 7),
)

# Columns that are whole numbers, and those that are numbers with a fraction. All others are text.
WHOLE = frozenset(
    """activity_year action_taken app_ethnicity app_income app_race app_sex applicant_ethnicity applicant_sex applicant_credit_score_type
    applicant_ethnicity_observed applicant_sex_observed as_of_year asof_date aus_1 aus_2 aus_3 aus_4 aus_5 balloon_payment
    business_or_commercial_purpose census_validity_flag co_app_ethnicity co_app_income co_app_race co_app_sex co_applicant_ethnicity
    co_applicant_sex co_applicant_credit_score_type co_applicant_ethnicity_observed co_applicant_sex_observed construction_method
    conventional_loan_amount_000s conventional_loan_count conventional_loan_validity_flag denial_reason_1 denial_reason_2 denial_reason_3
    denial_reason_4 edit_status ffiec_msa_md_median_family_income government_loan_amount_000s government_loan_count
    government_loan_validity_flag hoepa_status home_improvement_loan_amount_000s home_improvement_loan_count home_improvement_validity_flag
    hud_median_family_income initially_payable_to_institution interest_only_payment lien_status loan_amt loan_amount loan_amount_000s
    loan_purp loan_purpose loan_type manufactured_home_land_property_interest manufactured_home_secured_property_type
    multifamily_loan_amount_000s multifamily_loan_count multifamily_validity_flag negative_amortization nonoccupant_loan_amount_000s
    nonoccupant_loan_count nonoccupant_validity_flag occupancy occupancy_type owner_occupancy open_end_line_of_credit
    other_nonamortizing_features preapprovals preapproval prop_type property_type purchaser_type record_quality_flag reverse_mortgage
    submission_of_application application_date_indicator number_of_1_to_4_family_units number_of_owner_occupied_units population
    tract_median_age_of_housing_units tract_one_to_four_family_units tract_one_to_four_family_homes tract_owner_occupied_units
    tract_population""".split()
)
WHOLE_PREFIXES = ("app_race_", "applicant_ethnicity_", "applicant_race_", "co_app_race_", "co_applicant_ethnicity_", "co_applicant_race_")
FRACTIONS = frozenset(
    """applicant_income_000s income loan_to_value_ratio minority_population minority_population_percent tract_minority_population_percent
    tract_to_msamd_income tract_to_msa_income_percentage""".split()
)
NO_VALUE = ("", "NA", "N/A", "NULL")

#: Bytes of an archive's member that are taken apart at once, and lines handed on together.
CHUNK, LINES = 1 << 20, 20_000


@dataclass(frozen=True)
class Layout:
    """fields: of fixed width, or none for delimited files with a header."""

    name: str
    fields: tuple[tuple[str, int], ...] = ()

    @property
    def width(self) -> int:
        return sum(w for _, w in self.fields)


TRACTS = Layout("tracts 1981-1989", TRACT_FIELDS)
EARLY = Layout("loans 1990-2003", tuple((n, w) for n, w, _ in LOAN_FIELDS))
LATER = Layout("loans 2004-2014", LATER_FIELDS)
DELIMITED = Layout("delimited")


def layout_of(year: int, source: str) -> Layout:
    """The archives' files of 1981 to 2014 have fixed widths, other sources' are delimited."""
    if source != "nara":
        return DELIMITED
    for layout, last in ((TRACTS, 1989), (EARLY, 2003), (LATER, 2014)):
        if 1981 <= year <= last:
            return layout
    raise ValueError(f"no fixed-width records of {year}")


def plain_name(column: str) -> str:
    return re.sub(r"[ /-]", "_", column.strip().lower())


def kind_of(column: str) -> str:
    name = plain_name(column)
    if name in WHOLE or name.startswith(WHOLE_PREFIXES):
        return "long"
    return "double" if name in FRACTIONS else "string"


def typed(text: Column, kind: str) -> Column:
    """A field's value: blanks around it and words for nothing are missing; numbers may have blanks inside
    and commas between thousands, and what is no number is missing."""
    text = F.trim(text)
    text = F.when(~F.upper(text).isin(*NO_VALUE), text)
    if kind == "string":
        return text
    bare = F.regexp_replace(text, r"\s+", "")
    bare = F.when(bare.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(bare, F.lit(","), F.lit(""))).otherwise(bare)
    number = F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
    return number if kind == "double" else F.when(number == F.floor(number), number.cast("long"))


def member_lines(content: bytes, encoding: str, only_csv: bool, member: str = "") -> Iterator[list[str]]:
    """Lines of the one file of a zip archive, or of a member by name, a batch at a time; it is never unpacked
    as a whole. A line of CSV files goes on over line ends inside quotes."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = [m for m in archive.infolist() if not m.is_dir() and m.file_size and not re.search(r"(^|/)(__MACOSX/|\._|\.DS_Store)", m.filename)]
        names = [m for m in names if m.filename.lower().endswith(".csv")] if only_csv else names
        names = [m for m in names if m.filename == member] if member else names
        if len(names) != 1:
            raise ContractError(f"an archive must hold one data file, not {[m.filename for m in names]}")
        out, rest = [], ""
        with archive.open(names[0]) as raw, io.TextIOWrapper(raw, encoding=encoding, newline="") as data:
            while chunk := data.read(CHUNK):
                parts = (rest + chunk).split("\n")
                rest = parts.pop()
                held = None
                for line in parts:
                    line = line if held is None else f"{held}\n{line}"
                    if only_csv and line.count('"') % 2:
                        held = line
                        continue
                    held = None
                    out.append(line.removesuffix("\r"))
                    if len(out) >= LINES:
                        yield out
                        out = []
                rest = rest if held is None else f"{held}\n{rest}"
        if rest:
            out.append(rest.removesuffix("\r"))
        if out:
            yield out


def unzipped(spark: SparkSession, path: str, encoding: str, only_csv: bool, member: str = "") -> DataFrame:
    """(at, value): lines of zip archives with their places, one task an archive."""
    send_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                at = 0
                for lines in member_lines(content.as_py(), encoding, only_csv, member):
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(lines)), pa.int64()), pa.array(lines, pa.string())], ["at", "value"])
                    at += len(lines)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "at long, value string")


def fixed_width(lines: DataFrame, layout: Layout) -> DataFrame:
    """Typed columns of lines; one of another width is an error in the task that reads it, an empty one goes."""
    wrong = F.raise_error(F.concat(F.lit(f"a record of {layout.name} isn't of {layout.width} characters but of "), F.length("value").cast("string")))
    whole = lines.where(F.length("value") > 0).select(F.when(F.length("value") == layout.width, F.col("value")).otherwise(wrong.cast("string")).alias("value"))
    out, at = [], 1
    for name, width in layout.fields:
        out.append(typed(F.substring("value", at, width), kind_of(name)).alias(name))
        at += width
    return whole.select(*out)


def is_zip(path: str) -> bool:
    return path.lower().endswith(".zip")


def read_raw(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """The records of a file, zipped or not, with typed columns under the file's own names."""
    if layout.fields:
        if is_zip(path):
            return fixed_width(unzipped(spark, path, "latin-1", False), layout)
        text = spark.read.option("encoding", "ISO-8859-1").option("sep", "\u0001").option("quote", "").option("escape", "").schema("value string")
        return fixed_width(text.csv(path), layout)
    if not is_zip(path):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    else:
        lines = unzipped(spark, path, "utf-8-sig", True)
        first = lines.where("at = 0").first()
        if first is None:
            raise ContractError(f"{path} has no header")
        names = next(iter(spark.createDataFrame([(first["value"],)], "v string").select(F.from_csv("v", F.lit(", ".join(f"_{i} string" for i in range(first["value"].count(",") + 1))), {"escape": '"'})).first()))
        names = [n for n in names if n is not None]
        parsed = F.from_csv("value", F.lit(", ".join(f"`{n}` string" for n in names)), {"escape": '"', "mode": "FAILFAST"})
        rows = lines.where((F.col("at") > 0) & (F.length("value") > 0)).select(parsed.alias("_r")).select("_r.*")
    return rows.select(*(typed(named(c), kind_of(c)).alias(c.strip()) for c in rows.columns))


class LoanArchive:
    """Raw files of years under <root>/raw/<source>/<year>/, converted once to <root>/parquet/<source>/<year>.

    Loads read the Parquet files, so that columns and filters reach the scan.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.tables = ConvertedTables(spark, f"{self.root}/parquet")

    def raw(self, year: int, source: str) -> str:
        folder = f"{self.root}/raw/{source}/{year}"
        files = [f for f in self.tables.files(folder) if not f.startswith((".", "_"))]
        if len(files) != 1:
            raise FileNotFoundError(f"{folder} must hold one file, not {files}")
        return f"{folder}/{files[0]}"

    def converted(self, year: int, source: str) -> bool:
        return self.tables.has(f"{source}/{year}")

    def convert(self, years: Iterable[int], source: str, overwrite: bool = False) -> list[str]:
        """The Parquet paths of years; those that are converted already are left alone."""
        return [
            self.tables.make(f"{source}/{y}", lambda y=y: read_raw(self.spark, self.raw(y, source), layout_of(y, source)), overwrite) for y in dict.fromkeys(years)
        ]

    def load(self, year: int, source: str, columns: Iterable[str] | None = None, where: Column | None = None, canonical: bool = False, convert: bool = False) -> DataFrame:
        """A year's records under the file's names, or under the canonical ones; where is on the names asked for."""
        if not self.converted(year, source):
            if not convert:
                raise FileNotFoundError(f"{source} {year} is not converted")
            self.convert([year], source)
        rows = self.tables.read(f"{source}/{year}")
        if canonical:
            if layout_of(year, source) is TRACTS:
                raise ContractError("sums by tract are no loans")
            rows = canonical_loans(rows, year, source)
        if where is not None:
            rows = rows.where(where)
        if columns is None:
            return rows
        wanted = list(columns)
        if unknown := [c for c in wanted if c not in rows.columns]:
            raise ContractError(f"unknown columns {unknown}")
        return rows.select(*wanted, *(["source_year", "source"] if canonical else []))
