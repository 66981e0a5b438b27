import datetime

import pytest
from conftest import rows

from tallyloom.sources import publishers
from tallyloom.sources.contracts import ContractError


def day(text):
    return datetime.date.fromisoformat(text)


def test_counties_of_both_layouts(spark):
    schema = "RegionID int, RegionName string, State string, Metro string, StateCodeFIPS string, MunicipalCodeFIPS string, SizeRank int"
    for months, end, value in ((("2019-07", "2019-08"), "2019-08-31", 101.0), (("2026-05-31", "2026-06-30"), "2026-06-30", 151.5)):
        wide = spark.createDataFrame(
            [(1, "Autauga", "AL", "Montgomery", "01", "1.0", 1, 100.0, value), (2, "Aleutians East", "AK", None, "2", "013", 2, None, 202.0)],
            schema + "".join(f", `{m}` double" for m in months),
        )
        out = publishers.housing_values(wide)
        assert out.columns == ["fips", "date", "region_id", "region_name", "state", "metro", "size_rank", "zhvi"]
        assert {f for f, *_ in rows(out)} == {"01001", "02013"} and out.count() == 4
        assert out.where(f"fips = '01001' and date = '{end}'").first()["zhvi"] == value


def test_other_regions_and_codes(spark):
    wide = spark.createDataFrame([(7, "501", 1.0)], "RegionID int, RegionName string, `2020-02` double")
    assert rows(publishers.housing_values(wide, "zip").select("zip", "date")) == [("00501", day("2020-02-29"))]
    assert rows(publishers.housing_values(wide, "metro").select("metro")) == [("501",)]
    codes = spark.createDataFrame([(7, "1003")], "region_id int, fips string")
    assert rows(publishers.housing_values(wide, "county", codes=codes).select("fips", "zhvi")) == [("01003", 1.0)]
    states = spark.createDataFrame([("NEW YORK", "NY")], "state_name string, state string")
    named = spark.createDataFrame([(7, "New York", 1.0)], "RegionID int, RegionName string, `2020-02` double")
    assert rows(publishers.housing_values(named, "state", codes=states).select("state", "zhvi")) == [("NY", 1.0)]
    for bad, kind in ((wide, "county"), (wide.drop("2020-02"), "zip")):
        with pytest.raises(ContractError):
            publishers.housing_values(bad, kind)
    with pytest.raises(ValueError):
        publishers.housing_values(wide, "planet")


def test_price_index_below_titles(spark):
    text = ", ".join(f"c{i} string" for i in range(6))
    data = [("Title", None, None, None, None, None), ("Five-Digit ZIP Code", "Year", "Change", "HPI", "1990", "2000"), ("10001", "2010", ".", "100", "80", "75"), ("10001", "2011", "5.0", "105.0", "84.0", "78.75")]
    out = publishers.price_index(spark.createDataFrame(data, text), "zip5", "year")
    assert rows(out.select("zip5", "date", "annual_change_pct", "hpi"), "date") == [(10001, day("2010-01-01"), None, 100.0), (10001, day("2011-01-01"), 5.0, 105.0)]
    quarters = spark.createDataFrame([(100, 2010, 2, 101.5, "Native")], "a int, b int, c int, d double, e string")
    out = publishers.price_index(quarters, "zip3", "quarter")
    assert set(out.columns) == {"zip3", "date", "year", "quarter", "hpi"} and rows(out.select("date", "hpi")) == [(day("2010-04-01"), 101.5)]
    with pytest.raises(ValueError):
        publishers.price_index(quarters, "zip5", "quarter")


def test_tax_statistics(spark):
    by_zip = spark.createDataFrame([(10001, 1, 2, 50.0), (10001, 2, 3, 75.0), (10001, 3, 0, 9.0), (0, 1, 5, 1.0)], "ZIPCODE int, AGI_STUB int, N1 int, A00100 double")
    made = publishers.tax_statistics(by_zip, "zip", 2014)
    assert rows(made) == [(10001, day("2014-01-01"), 5.0, 125.0)]
    assert rows(publishers.tax_by_zip3(made).select("zip3", "agi")) == [(100, 125.0)]
    county = spark.createDataFrame([("01", "001", "AL", 1, 2, 50.0), ("01", "000", "AL", 1, 9, 90.0)], "STATEFIPS string, COUNTYFIPS string, STATE string, AGI_STUB int, N1 int, A00100 double")
    made = publishers.tax_statistics(county, "county", 2012)
    assert rows(made) == [(1001, day("2012-01-01"), 2.0, 50.0)]
    factors = spark.createDataFrame([(1001, 350, 0.25), (1001, 351, 0.75)], "fips long, zip3 int, factor double")
    assert rows(publishers.tax_by_zip3(made, factors).select("zip3", "agi"), "zip3") == [(350, 12.5), (351, 37.5)]


def record(amount, income="  NA"):
    parts = {"asof_date": "1995", "respondent_id": "0000123456", "loan_amt": amount, "app_income": income}
    return "".join(parts.get(n, "").rjust(w) for n, w, _ in publishers.LOAN_FIELDS)


def test_loan_records(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join([record("    1"), record("1 250", "  75"), record(" 2 05")]) + "\n")
    out = publishers.loan_records(spark, str(tmp_path / "a.txt"))
    assert rows(out.select("respondent_id", "loan_amt", "app_income"), "loan_amt") == [("0000123456", 1, None), ("0000123456", 205, None), ("0000123456", 1250, 75.0)]
    (tmp_path / "b.txt").write_text(record("    1") + "x\n")
    with pytest.raises(Exception, match="characters"):
        publishers.loan_records(spark, str(tmp_path / "b.txt")).collect()


def test_canonical_loans(spark):
    old = spark.createDataFrame([(2014, 250, 75, 1, "x"), (2014, 300, 90, 3, "x")], "asof_date int, loan_amt int, app_income int, action_taken int, source_only string")
    out = publishers.canonical_loans(old, 2014, "old").where("action_taken = 1")
    assert rows(out.select("activity_year", "loan_amount_000s", "applicant_income_000s", "lei", "source")) == [(2014, 250, 75.0, None, "old")]
    new = spark.createDataFrame([(2016, 300)], "as_of_year int, loan_amount_000s int")
    assert publishers.canonical_loans(new, 2016, "new").dtypes == out.dtypes
    for columns in (["nothing"], ["lei", "lei"]):
        with pytest.raises(ContractError):
            publishers.canonical_loans(new, 2016, "new", columns)
    with pytest.raises(ContractError):
        publishers.canonical_loans(new.selectExpr("as_of_year", "as_of_year asof_date"), 2016, "new")


def test_flow_tables(spark):
    raw = spark.createDataFrame([("2025:Q4", "100", "x")], "date string, `FL102000005.Q` string, `FA10.Q` string")
    words = spark.createDataFrame([("FL102000005.Q", "Nonfinancial corporate business; total assets")], "code string, name string")
    out = publishers.flow_table(raw, words, kinds=True)
    assert out.columns == ["date", "nfc_total_assets_level", "FA10.Q"] and rows(out) == [(day("2025-10-01"), 100.0, None)]
    assert rows(publishers.flow_table(spark.createDataFrame([("1990", "1")], "date string, a string"))) == [(day("1990-01-01"), 1.0)]
    twice = spark.createDataFrame([("FL102000005.Q", "same"), ("FA10.Q", "same")], "code string, name string")
    assert publishers.flow_table(raw, twice).columns == raw.columns
    assert publishers.resolve_table("S11.1.b", ["S11_1_b"]) == "S11_1_b"
    assert publishers.resolve_table("b103", ["S11_1_b"], {"B.103": "S11.1.b"}) == "S11_1_b"
    with pytest.raises(ValueError):
        publishers.resolve_table("b104", ["S11_1_b"], {"B.103": "S11.1.b"})


def test_sets_of_flow_variables(spark):
    b = spark.createDataFrame([("2000:Q1", "1", "5", "x"), ("2000:Q2", "ND", "6", "y")], "date string, `FL103020005.Q` string, `FL104090005.Q` string, `ZZ.Q` string")
    f = spark.createDataFrame([("2000:Q2", 2.5), ("2000:Q3", 3.5)], "date string, `FA105050005.Q` double")
    asked = []

    def tables(name):
        asked.append(name)
        return {"b103": b, "f103": f}.get(name)

    made, missing = publishers.flow_set(tables, publishers.FLOW_SETS["corporate"], publishers.FLOW_FORMER, ["capex", "checkable_deposits", "financial_assets", "discrepancy_fin", "iva", "no such"])
    assert made.columns == ["date", "capex", "checkable_deposits", "financial_assets"] and missing == ["discrepancy_fin", "iva"] and asked == ["b103", "f103", "f108"]
    assert rows(made, "date") == [(day("2000-01-01"), None, 1.0, 5.0), (day("2000-04-01"), 2.5, None, 6.0), (day("2000-07-01"), 3.5, None, None)]
    with pytest.raises(ContractError):
        publishers.flow_set(lambda _: None, publishers.FLOW_SETS["banks"])


def test_print_files(spark, tmp_path):
    (tmp_path / "t.prn").write_text('"A.Q" "B.Q"\n' + "\n".join(f"{i} {'ND' if i == 25 else i * 2}" for i in range(27)) + "\n")
    raw = publishers.read_prn(spark, str(tmp_path / "t.prn"))
    made = publishers.positional_flows(raw, {"B.Q": "b", "A.Q": "a"}, "_at")
    assert rows(made, "date") == [(day("1951-10-01"), 48.0, 24.0), (day("1952-01-01"), None, 25.0), (day("1952-04-01"), 52.0, 26.0)]
    (tmp_path / "e.prn").write_text("")
    with pytest.raises(ContractError):
        publishers.read_prn(spark, str(tmp_path / "e.prn"))
