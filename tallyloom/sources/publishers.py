"""Public statistics in the forms their publishers give them, brought to tables with keys and dates.

Every function takes the raw table as read (text or typed columns) and returns a plan: nothing is collected
but a table's own dictionary of column names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.joins import crosswalk_allocate, merge_date_many
from tallyloom.operators.panel import positional_dates, quarter_start, year_start
from tallyloom.operators.reshape import to_long
from tallyloom.sources.contracts import ContractError, canonical, normalize_columns, require_columns

MONTH = re.compile(r"\d{4}-\d{2}(-\d{2})?")

# The publishers' column names and what they are called here.
HOUSING_NAMES = {
    "RegionID": "region_id", "RegionName": "region_name", "RegionType": "region_type", "StateName": "state_name",
    "State": "state", "Metro": "metro", "SizeRank": "size_rank",
}
HOUSING_KEYS = {"county": "fips", "state": "state", "zip": "zip", "metro": "metro"}

# Columns of the price index files, in their order, by level and frequency.
PRICE_COLUMNS = {
    ("metro", "quarter"): ("msa", "code", "year", "quarter", "hpi", "unknown"),
    ("state", "quarter"): ("state", "year", "quarter", "hpi"),
    ("county", "year"): ("state", "county_name", "fips", "year", "annual_change_pct", "hpi", "hpi_1990_base", "hpi_2000_base"),
    ("zip3", "quarter"): ("zip3", "year", "quarter", "hpi", "index_type"),
    ("zip3", "year"): ("zip3", "year", "annual_change_pct", "hpi", "hpi_1990_base", "hpi_2000_base"),
    ("zip5", "year"): ("zip5", "year", "annual_change_pct", "hpi", "hpi_1990_base", "hpi_2000_base"),
}
PRICE_KEYS = {"metro": "code", "state": "state", "county": "fips", "zip3": "zip3", "zip5": "zip5"}

# Tax statistics; a code stands after n for returns and after a for amounts.
TAX_COLUMNS = {"n1": "n_returns", "mars2": "n_joint", "prep": "n_prepared", "n2": "n_exemptions", "numdep": "n_dependents", "a00100": "agi", "schf": "n_farm"}
TAX_CODES = {
    "00200": "wagesal", "00300": "interest", "00600": "dividends", "00650": "qualified_dividends", "00900": "business",
    "01000": "cap_gain", "01400": "retirement", "01700": "pension", "02300": "unemp", "02500": "social",
    "03300": "self_emp_ret", "04470": "itemized", "18425": "state_local_inc", "18450": "state_local_sales",
    "18500": "real_estate_tax", "18300": "taxes_paid", "19300": "mort_int_paid", "19700": "contributions",
    "04800": "taxable_income", "07100": "tax_credits", "07260": "res_energy_credit", "07220": "child_tax_credit",
    "07180": "child_dep_care_credit", "11070": "add_child_credit", "59660": "eitc", "59720": "excess_eitc",
    "09600": "alt_minimum_tax", "06500": "income_tax", "10300": "tax_liability", "11901": "tax_due_at_filing",
    "11902": "overpayments_refunded",
}
TAX_TEXT = {"state", "statefips", "countyfips", "countyname", "zipcode", "agi_stub", "count"}
ZIP_RANGE = (501, 99950)

# Loan records of 1990 to 2003 (name, width, type).
LOAN_FIELDS = (
    ("asof_date", 4, "int"), ("respondent_id", 10, "string"), ("agency_code", 1, "string"), ("loan_type", 1, "int"),
    ("loan_purp", 1, "int"), ("occupancy", 1, "int"), ("loan_amt", 5, "long"), ("action_taken", 1, "int"),
    ("prop_msa", 4, "string"), ("state_code", 2, "string"), ("county_code", 3, "string"), ("census_tract", 7, "string"),
    ("app_race", 1, "int"), ("co_app_race", 1, "int"), ("app_sex", 1, "int"), ("co_app_sex", 1, "int"),
    ("app_income", 4, "double"), ("purchaser_type", 1, "int"), ("denial_reason_1", 1, "int"),
    ("denial_reason_2", 1, "int"), ("denial_reason_3", 1, "int"), ("edit_status", 1, "string"), ("seq_num", 7, "string"),
)

# Older names of loan columns.
LOAN_ALIASES = {
    "asof_date": "activity_year", "as_of_year": "activity_year", "loan_purp": "loan_purpose",
    "occupancy": "occupancy_type", "owner_occupancy": "occupancy_type", "loan_amt": "loan_amount_000s",
    "prop_msa": "msa_md", "msamd": "msa_md", "msa_of_property": "msa_md", "census_tract_number": "census_tract",
    "app_income": "applicant_income_000s", "prop_type": "property_type", "preapprovals": "preapproval",
    "app_ethnicity": "applicant_ethnicity", "co_app_ethnicity": "co_applicant_ethnicity",
    "app_race": "applicant_race_1", "co_app_race": "co_applicant_race_1", "app_sex": "applicant_sex",
    "co_app_sex": "co_applicant_sex", "seq_num": "sequence_number",
} | {f"{old}_race_{i}": f"{new}_race_{i}" for old, new in (("app", "applicant"), ("co_app", "co_applicant")) for i in range(1, 6)}

# Canonical loan columns that are shared by the layouts read here, with their types.
LOAN_TYPES = {
    "activity_year": "long", "respondent_id": "string", "lei": "string", "agency_code": "string", "loan_type": "long",
    "loan_purpose": "long", "occupancy_type": "long", "property_type": "long", "preapproval": "long",
    "loan_amount_000s": "long", "action_taken": "long", "msa_md": "string", "state_code": "string",
    "county_code": "string", "census_tract": "string", "applicant_ethnicity": "long", "co_applicant_ethnicity": "long",
    "applicant_race_1": "long", "co_applicant_race_1": "long", "applicant_sex": "long", "co_applicant_sex": "long",
    "applicant_income_000s": "double", "purchaser_type": "long", "denial_reason_1": "long", "denial_reason_2": "long",
    "denial_reason_3": "long", "edit_status": "string", "sequence_number": "string", "rate_spread": "string",
    "hoepa_status": "long", "lien_status": "long",
} | {f"{side}_race_{i}": "long" for side in ("applicant", "co_applicant") for i in range(1, 6)}

# Short forms in the names of flow-of-funds series; sets of variables with their tables and codes,
# and codes that older vintages have; and what the first letters of a code say.
FLOW_WORDS = (
    ("households_and_nonprofit_organization", "hh_np"),
    ("households", "hh"),
    ("nonfinancial_corporate_business", "nfc"),
    ("domestic_financial_sectors", "fc"),
    ("consumption_of_fixed_capital_structures_equipment_and_intellectual_property_products_including_equity_reit_residential_structures_nipa_basis_", "cons_fixed_capital"),
    ("capital_formation_net_includes_equity_reit_residential_structures_ima_", "net_capital_formation"),
    ("gross_fixed_capital_formation_with_equity_reit_residential_structures_ima_", "gross_capital_formation"),
)
FLOW_SETS = {
    "household": {
        "assets": ("b101", "FL152000005"), "nonfinancial_assets": ("b101", "LM152010005"), "real_estate": ("b101", "LM155035015"),
        "real_estate_nonprofit": ("b101", "LM165035005"), "consumer_durables": ("b101", "LM155111005"), "residential_mortgages": ("b101", "FL153165105"),
        "consumer_credit": ("b101", "FL153166000"), "disposable_income": ("f101", "FA156012005"), "gross_income": ("f101", "FA156010001"),
        "personal_taxes": ("f101", "FA156210005"), "net_worth": ("b101", "FL152090005"), "residential_mortgages_flow": ("f101", "FA153165105"),
    },
    "financial": {
        "assets": ("l108", "FL704090005"), "liabilities": ("l108", "FL794190005"), "equity": ("l108", "LM793164105"), "loans": ("l108", "FL794023005"),
        "checkable_deposits": ("l108", "FL794023005"), "time_savings_deposits": ("l108", "FL794023005"), "money_market_shares": ("l108", "FL794023005"),
    },
    "banks": {
        "assets": ("l110", "FL704090005"), "liabilities": ("l110", "FL704190005"), "loans": ("l110", "FL704023005"),
        "checkable_deposits": ("l110", "FL703127005"), "time_savings_deposits": ("l110", "FL703130005"),
    },
    "corporate": {
        "financial_assets": ("b103", "FL104090005"), "liabilities": ("b103", "FL104190005"), "nonfin_assets": ("b103", "LM102010005"),
        "assets": ("b103", "FL102000005"), "assets_book": ("b103", "FL102000115"), "net_worth_book": ("b103", "FL102090005"),
        "net_worth_market": ("b103", "FL102090005"), "equities_outstanding_market": ("b103", "LM103164105"), "fdi_equity": ("b103", "LM103192105"),
        "gross_investment": ("f103", "FA105090005"), "gross_investment_fin": ("f108", "FA795090005"), "net_dividends": ("f103", "FA106121075"),
        "net_new_equity": ("f103", "FA103164103"), "net_new_paper": ("f103", "FA103169100"), "net_new_bonds": ("f103", "FA103163003"),
        "corp_equities_wealth": ("b101", "LM153064105"), "noncorp_business_wealth": ("b101", "LM152090205"), "mutual_fund_wealth": ("b101", "LM153064205"),
        "equities_outstanding_incl_fin": ("b1", "LM883164105"), "equities_outstanding_market_fin": ("l108", "LM793164105"),
        "net_new_equity_fin": ("f108", "FA793164105"), "net_dividends_fin": ("f3", "FA796121073"), "profits_pretax": ("f103", "FA106060005"),
        "profits_pretax_iva_cca": ("f103", "FA146060035"), "corp_taxes": ("f103", "FA106231005"), "iva": ("f103", "FA105020601"),
        "foreign_ret_earnings": ("f103", "FA106006065"), "capex": ("f103", "FA105050005"), "debt_securities": ("b103", "FL104122005"),
        "corporate_bonds": ("b103", "FL103163003"), "loans": ("b103", "FL104123005"), "loans_depository": ("b103", "FL103168005"),
        "foreign_deposits": ("b103", "FL103091003"), "checkable_deposits": ("b103", "FL103020000"), "time_savings_deposits": ("b103", "FL103030003"),
        "mmf_shares": ("b103", "FL103034000"), "repos": ("b103", "FL102051003"), "debt_securities_asset": ("b103", "LM104022005"),
        "loans_asset": ("b103", "FL104023005"), "mortgages": ("b103", "FL103165005"), "nonfinancial_assets_hist_cost": ("b103", "FL102010115"),
        "net_capital_transfers": ("f103", "FA105440005"), "cca": ("f103", "FA106300015"), "net_financial_assets": ("f103", "FA104090005"),
        "net_financial_assets_fin": ("f108", "FA794090005"), "net_liabilities": ("f103", "FA104194005"), "net_liabilities_fin": ("f108", "FA794190005"),
        "discrepancy": ("f103", "FA107005005"), "discrepancy_fin": ("f108", "FA797005005"), "misc_liabilities": ("b103", "FL103190005"),
        "new_debt_securities": ("f103", "FA104122005"), "new_loans": ("f103", "FA104123005"), "new_debt_securities_fin": ("f108", "FA794122005"),
        "new_loans_fin": ("f108", "FA794123005"), "closed_end_funds": ("l123", "LM554090005"), "exchange_traded_funds": ("l124", "LM564090005"),
        "mutual_fund_shares_liab": ("l108", "LM653164205"), "corp_equities_asset_fin": ("l108", "LM793064105"), "corp_equities_asset": ("b103", "LM103064103"),
    },
}
FLOW_FORMER = (("net_new_equity", "f103", "FA103164105"), ("checkable_deposits", "b103", "FL103020005"), ("equities_outstanding_market", "b103", "LM103164103"))
FLOW_KINDS = {"FA": "flow", "FU": "flow", "FV": "volume", "FR": "revaluation", "FL": "level", "LM": "level"}


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file with a header, all columns as text, so that no code loses its zeros."""
    return spark.read.csv(path, header=True)


def named(c: str) -> Column:
    """The column of this very name, dots included."""
    return F.col(f"`{c}`")


def code(c: Column, width: int) -> Column:
    """Digits of a code with its zeros, from text or a number."""
    text = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def housing_values(wide: DataFrame, geography: str = "county", value: str = "zhvi", codes: DataFrame | None = None) -> DataFrame:
    """A row a region and month end from a table with a column a month (YYYY-MM or YYYY-MM-DD).

    A county's key is fips: from its two code columns or, in files without them, from codes (region_id, fips).
    A state's key is its abbreviation: from the file or, in files without it, from codes (state_name, state).
    Regions that codes doesn't have are left out. A month without a value keeps its row."""
    if geography not in HOUSING_KEYS:
        raise ValueError(f"no geography {geography!r}; there are {sorted(HOUSING_KEYS)}")
    months = [c for c in wide.columns if MONTH.fullmatch(c)]
    if not months:
        raise ContractError("no column is a month")
    others = [c for c in wide.columns if c not in months]
    wide = wide.select(*(named(c).alias(HOUSING_NAMES.get(c, c)) for c in others), *(named(c).try_cast("double").alias(c) for c in months))
    key = HOUSING_KEYS[geography]
    if geography == "county" and {"StateCodeFIPS", "MunicipalCodeFIPS"} <= set(others):
        wide = wide.withColumn(key, F.concat(code(F.col("StateCodeFIPS"), 2), code(F.col("MunicipalCodeFIPS"), 3)))
    elif geography == "zip":
        wide = wide.withColumn(key, code(F.col("region_name"), 5))
    elif geography == "metro" and key not in wide.columns:
        wide = wide.withColumn(key, F.col("region_name"))
    elif key not in wide.columns:
        if codes is None:
            raise ContractError(f"the table has no {key}, and there is no table of codes")
        if geography == "county":
            codes = codes.select(F.col("region_id").cast("string").alias("_of"), code(F.col("fips"), 5).alias(key))
            wide = wide.join(codes, F.col("region_id").cast("string") == F.col("_of")).drop("_of")
        else:
            codes = codes.select(F.initcap("state_name").alias("_of"), F.col("state"))
            wide = wide.join(codes, F.col("region_name") == F.col("_of")).withColumnRenamed("_of", "state_name")
    ids = [key, *(c for c in wide.columns if c not in (*months, key, "StateCodeFIPS", "MunicipalCodeFIPS"))]
    rows = to_long(wide.select(*ids, *map(named, months)), ids, months, "_month", value, keep_missing=True)
    date = F.last_day(F.to_date(F.concat(F.substring("_month", 1, 7), F.lit("-01"))))
    return rows.select(key, date.alias("date"), *ids[1:], value)


def price_index(raw: DataFrame, level: str, frequency: str) -> DataFrame:
    """A price index by region and period start, from the file's columns in their order, all as text.

    Titles, notes and headers are the rows whose year is none, wherever they stand."""
    if (level, frequency) not in PRICE_COLUMNS:
        raise ValueError(f"no price index by {level} and {frequency}; there are {sorted(PRICE_COLUMNS)}")
    columns = PRICE_COLUMNS[level, frequency]
    if len(raw.columns) < len(columns):
        raise ContractError(f"{len(raw.columns)} columns, not {len(columns)}")
    raw = raw.select(*(named(a).alias(b) for a, b in zip(raw.columns, columns, strict=False)))
    rows = raw.where(F.trim(F.col("year").cast("string")).rlike(r"^\d{4}(\.0)?$"))
    text = {"state", "county_name", "msa", "index_type", "unknown"}
    whole = {"year", "quarter", "fips", "zip3", "zip5", "code"}

    def value(c: str) -> Column:
        x = F.col(c) if c in text else F.trim(F.col(c).cast("string")).try_cast("double")
        return (x.cast("int") if c in whole else x).alias(c)

    rows = rows.select(*map(value, columns)).drop("index_type", "unknown")
    date = quarter_start(F.col("year"), F.col("quarter")) if frequency == "quarter" else year_start(F.col("year"))
    key = PRICE_KEYS[level]
    return rows.select(key, date.alias("date"), *(c for c in rows.columns if c != key))


def tax_statistics(raw: DataFrame, by: str, year: int) -> DataFrame:
    """Returns and amounts by zip or county from a file of income classes; classes without returns don't
    count. Totals of a whole state (county or ZIP 0) and numbers that are no ZIP are left out."""
    names = TAX_COLUMNS | {f"n{k}": f"n_{v}" for k, v in TAX_CODES.items()} | {f"a{k}": v for k, v in TAX_CODES.items()}
    rows = normalize_columns(raw)
    require_columns(rows, ["n1", *(["zipcode"] if by == "zip" else ["statefips", "countyfips"])])
    number = {c: F.col(c).cast("string").try_cast("double") for c in rows.columns}
    if by == "zip":
        key, holds = number["zipcode"].cast("long"), number["zipcode"].between(*ZIP_RANGE)
    elif by == "county":
        key = (number["statefips"] * 1000 + number["countyfips"]).cast("long")
        holds = (number["statefips"] > 0) & (number["countyfips"] > 0)
    else:
        raise ValueError("by is 'zip' or 'county'")
    key_name = {"zip": "zip", "county": "fips"}[by]
    sums = [F.sum(number[c]).alias(names.get(c, c)) for c in rows.columns if c not in TAX_TEXT]
    out = rows.where(holds & (number["n1"] >= 1)).groupBy(key.alias(key_name)).agg(*sums)
    return out.select(key_name, F.lit(f"{year}-01-01").cast("date").alias("date"), *(c for c in out.columns if c != key_name))


def tax_by_zip3(rows: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Tax statistics by three digits of ZIP: of counties by a crosswalk (fips, zip3, factor), of ZIPs by
    their first three digits."""
    values = [c for c in rows.columns if c not in ("zip", "fips", "date")]
    if "fips" in rows.columns:
        if factors is None:
            raise ContractError("counties need a crosswalk")
        return crosswalk_allocate(rows, factors, "fips", "zip3", values, ["date"])
    return rows.groupBy((F.col("zip") / 100).cast("int").alias("zip3"), "date").agg(*(F.sum(c).alias(c) for c in values))


def loan_columns(line: Column) -> list[Column]:
    """Columns of a loan record of 1990 to 2003: codes stay text, blanks inside a number go, and what is
    no number is missing."""
    out, at = [], 1
    for name, width, kind in LOAN_FIELDS:
        c = F.nullif(F.trim(F.substring(line, at, width)), F.lit(""))
        out.append((c if kind == "string" else F.replace(c, F.lit(" "), F.lit("")).try_cast("double").cast(kind)).alias(name))
        at += width
    return out


def loan_records(spark: SparkSession, path: str) -> DataFrame:
    """Loan records of 1990 to 2003; a line of another width is an error in the task that reads it."""
    width = sum(w for _, w, _ in LOAN_FIELDS)
    wrong = F.raise_error(F.concat(F.lit(f"a record isn't of {width} characters but of "), F.length("value").cast("string")))
    lines = spark.read.text(path).select(F.when(F.length("value") == width, F.col("value")).otherwise(wrong.cast("string")).alias("value"))
    return lines.select(*loan_columns(F.col("value")))


def canonical_loans(native: DataFrame, year: int, source: str, columns: Iterable[str] | None = None) -> DataFrame:
    """Loans of any layout under one list of names and types: columns that a layout lacks are missing, and
    source_year and source tell where the rows came from. Filters on the result reach the scan."""
    wanted = list(LOAN_TYPES if columns is None else columns)
    if unknown := [c for c in wanted if c not in LOAN_TYPES]:
        raise ContractError(f"unknown loan columns {unknown}")
    if len(set(wanted)) < len(wanted):
        raise ContractError("a loan column is asked for twice")
    found: dict[str, str] = {}
    for c in native.columns:
        plain = re.sub(r"[ /-]", "_", c.strip().lower())
        name = LOAN_ALIASES.get(plain, plain)
        if name in LOAN_TYPES and found.setdefault(name, c) != c:
            raise ContractError(f"{found[name]} and {c} are both {name}")
    return canonical(native, [(c, found.get(c, f"no {c}"), LOAN_TYPES[c]) for c in wanted], {"source_year": str(year), "source": source})


def flow_table(raw: DataFrame, dictionary: DataFrame | None = None, kinds: bool = False) -> DataFrame:
    """A flow-of-funds table by period start; dates are 'YYYY:Qn' or years, and what is no number is missing.

    With a dictionary (code, name), series get names in place of codes, and with kinds their kind (level,
    flow, ...) after it. Series whose names would meet keep their codes. The dictionary has a row a column
    of the table; this is all that is collected."""
    series = [c for c in raw.columns if c != "date"]
    names = flow_names(dictionary, series, kinds) if dictionary is not None else {}
    text = F.col("date").cast("string")
    year = F.substring(text, 1, 4).try_cast("int")
    date = F.when(text.rlike(r"^\d{4}:Q[1-4]$"), quarter_start(year, F.substring(text, 7, 1).try_cast("int"))).otherwise(year_start(year))
    return raw.select(date.alias("date"), *(named(c).cast("string").try_cast("double").alias(names.get(c, c)) for c in series))


def flow_set(
    tables: Callable[[str], DataFrame | None], wanted: Mapping[str, tuple[str, str]], former: Iterable[tuple[str, str, str]] = (), columns: Iterable[str] | None = None
) -> tuple[DataFrame, list[str]]:
    """(table by date, names that no table has): variables from several tables, side by side on their dates.

    tables(name): a raw table, or None if there is none. wanted: variable to (table, series code without
    its frequency), as in FLOW_SETS; former: (variable, table, code) under which older vintages have a
    variable that the first code does not find. Only the series asked for are read from a table.
    """
    names = [c for c in (sorted(wanted) if columns is None else columns) if c in wanted]
    older = list(former)
    frames, found = [], set()
    for name in sorted({wanted[c][0] for c in names}):
        raw = tables(name)
        if raw is None:
            continue
        series = {}
        for c in names:
            codes = [code for t, code in (wanted[c], *((t, k) for v, t, k in older if v == c)) if t == name]
            have = [f"{k}.Q" for k in codes if f"{k}.Q" in raw.columns]
            if have:
                series[c] = have[0]
        if series:
            found |= set(series)
            table = flow_table(raw.select("date", *(named(k) for k in dict.fromkeys(series.values()))))
            frames.append(table.select("date", *(named(k).alias(c) for c, k in series.items())))
    if not frames:
        raise ContractError("no table has any of these series")
    return merge_date_many(frames).select("date", *(c for c in names if c in found)), [c for c in names if c not in found]


def positional_flows(raw: DataFrame, series: Mapping[str, str], order: str, start: str = "1945-10-01", since: str = "1951-10-01") -> DataFrame:
    """Series of a print file, whose rows are quarters from start on in the order of a column, from since on."""
    picked = raw.select(F.col(order).alias("_at"), *(named(c).cast("string").try_cast("double").alias(n) for c, n in series.items()))
    return positional_dates(picked, start, "quarter", ["_at"]).drop("_at").where(F.col("date") >= since).select("date", *series.values())


def read_prn(spark: SparkSession, path: str) -> DataFrame:
    """A print file: names in its first line, values between spaces, all as text; _at is the place of a row."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", "\\r?\\n"), lambda x: F.trim(x) != "")).alias("_at", "value"))
    head = lines.where("_at = 0").first()
    if head is None:
        raise ContractError(f"{path} is empty")
    names = [n.strip('"') for n in head["value"].split()]
    parts = F.split(F.trim("value"), r"\s+")
    return lines.where("_at > 0").select("_at", *(F.replace(F.get(parts, F.lit(i)), F.lit('"'), F.lit("")).alias(n) for i, n in enumerate(names)))


def flow_names(dictionary: DataFrame, series: Sequence[str], kinds: bool) -> dict[str, str]:
    name = F.regexp_replace(F.trim(F.lower("name")), r"\W+", "_")
    for long, short in FLOW_WORDS:
        name = F.replace(name, F.lit(long), F.lit(short))
    if kinds:
        kind = F.coalesce(*(F.when(F.substring("code", 1, 2) == k, F.lit(f"_{v}")) for k, v in FLOW_KINDS.items()), F.lit(""))
        name = F.concat(name, kind)
    found = dict(tuple(r) for r in dictionary.where(F.col("code").isin(list(series))).select("code", name).collect())
    used = [found.get(c, c) for c in series] + ["date"]
    return {c: n for c, n in found.items() if n and used.count(n) == 1}


def resolve_table(table: str, available: Iterable[str], renamed: Mapping[str, str] | None = None) -> str:
    """The file of a table asked for by its name, or by a former name that renamed maps to the present one."""
    have = set(available)
    for stem in (table, table.replace(".", "_")):
        if stem in have:
            return stem

    def plain(x: str) -> str:
        return re.sub(r"[._]", "", x).lower()

    found = {new.replace(".", "_") for old, new in (renamed or {}).items() if plain(old) == plain(table)} & have
    if len(found) != 1:
        raise ValueError(f"no table {table!r}")
    return found.pop()
