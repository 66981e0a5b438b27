import io
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.sources import loan_archives as la
from tallyloom.sources.contracts import ContractError


def record(layout, **values):
    return "".join(str(values.get(n, "")).rjust(w)[:w] for n, w in layout.fields)


def put(root, source, year, name, content):
    folder = root / "raw" / source / str(year)
    folder.mkdir(parents=True)
    (folder / name).write_bytes(content)


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()


def test_widths_of_the_layouts():
    assert (la.TRACTS.width, la.EARLY.width, la.LATER.width) == (126, 60, 80)
    assert [la.layout_of(y, "nara") for y in (1981, 1990, 2003, 2004)] == [la.TRACTS, la.EARLY, la.EARLY, la.LATER] and la.layout_of(2015, "cfpb") is la.DELIMITED
    with pytest.raises(ValueError, match="2015"):
        la.layout_of(2015, "nara")


LINES = [
    record(la.LATER, asof_date=2006, respondent_id="0012", loan_amt="  100", app_income="  NA", app_race_1=5, state_code="01", rate_spread=" 3.25", seq_num="0000001"),
    record(la.LATER, asof_date=2006, respondent_id="é", loan_amt="1 00", app_income="  62", app_race_1="x", seq_num="0000002"),
]


def test_a_year_is_converted_once_and_read_with_its_filter(spark, tmp_path):
    put(tmp_path, "nara", 2006, "lar.zip", zipped({"lar.dat": "\r\n".join(LINES).encode("latin-1") + b"\r\n", "__MACOSX/._lar.dat": b"x"}))
    archive = la.LoanArchive(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError, match="not converted"):
        archive.load(2006, "nara")
    made = archive.load(2006, "nara", convert=True)
    assert rows(made.select("asof_date", "respondent_id", "loan_amt", "app_income", "app_race_1", "state_code", "rate_spread", "seq_num"), "seq_num") == [
        (2006, "0012", 100, None, 5, "01", "3.25", "0000001"),
        (2006, "é", 100, 62, None, None, None, "0000002"),
    ]
    (tmp_path / "raw/nara/2006/lar.zip").unlink()  # Parquet is all that is read from now on
    assert archive.convert([2006, 2006], "nara") == [str(tmp_path / "parquet/nara/2006")]
    again = archive.load(2006, "nara", ["loan_amount_000s", "applicant_race_1", "lien_status"], F.col("loan_amount_000s") > 50, canonical=True)
    assert rows(again.orderBy(F.col("applicant_race_1").desc_nulls_last())) == [(100, 5, None, "2006", "nara"), (100, None, None, "2006", "nara")]
    plan = again._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "FileScan parquet" in line)
    assert "GreaterThan(loan_amt,50)" in scan and "respondent_id" not in scan.split("ReadSchema:")[1]
    with pytest.raises(ContractError, match="unknown"):
        archive.load(2006, "nara", ["no such"])


def test_a_conversion_without_success_is_made_again(spark, tmp_path):
    put(tmp_path, "nara", 2006, "lar.txt", "\n".join(LINES).encode("latin-1"))
    archive = la.LoanArchive(spark, str(tmp_path))
    archive.convert([2006], "nara")
    assert archive.load(2006, "nara").where("respondent_id = 'é'").count() == 1
    (tmp_path / "parquet/nara/2006/_SUCCESS").unlink()
    assert not archive.converted(2006, "nara")
    assert archive.load(2006, "nara", convert=True).count() == 2 and archive.converted(2006, "nara")


def test_records_of_another_width_are_an_error(spark, tmp_path):
    put(tmp_path, "nara", 1995, "a.txt", (record(la.EARLY, loan_amt=1) + "\n" + "short").encode())
    with pytest.raises(Exception, match="isn't of 60 characters but of 5"):
        la.LoanArchive(spark, str(tmp_path)).load(1995, "nara", convert=True)


def test_sums_by_tract(spark, tmp_path):
    put(tmp_path, "nara", 1985, "a.txt", record(la.TRACTS, respondent_name="A bank, of the north", government_loan_count="0012").encode())
    archive = la.LoanArchive(spark, str(tmp_path))
    assert rows(archive.load(1985, "nara", ["respondent_name", "government_loan_count"], convert=True)) == [("A bank, of the north", 12)]
    with pytest.raises(ContractError, match="no loans"):
        archive.load(1985, "nara", canonical=True)


def test_zipped_delimited_files(spark, tmp_path, monkeypatch):
    text = '﻿as_of_year,respondent_id,Loan Amount 000s,applicant_income_000s,denial_reason_name_1,loan_term\r\n2016,0001,"1,250",62.5,"a, ""b""\nc",360\r\n2016,,N/A,x,null,Exempt\r\n'
    put(tmp_path, "cfpb", 2016, "a.zip", zipped({"hmda/a.csv": text.encode(), "readme.txt": b"x"}))
    made = la.LoanArchive(spark, str(tmp_path)).load(2016, "cfpb", convert=True)
    assert rows(made, "respondent_id") == [(2016, None, None, None, None, "Exempt"), (2016, "0001", 1250, 62.5, 'a, "b"\nc', "360")]
    canonical = la.LoanArchive(spark, str(tmp_path)).load(2016, "cfpb", ["activity_year", "loan_amount_000s"], canonical=True)
    assert rows(canonical, "loan_amount_000s") == [(2016, None, "2016", "cfpb"), (2016, 1250, "2016", "cfpb")]
    put(tmp_path, "cfpb", 2015, "b.zip", zipped({"a.csv": b"x", "b.csv": b"y"}))
    with pytest.raises(Exception, match="one data file"):
        la.LoanArchive(spark, str(tmp_path)).load(2015, "cfpb", convert=True)


def test_lines_over_chunks(monkeypatch):
    monkeypatch.setattr(la, "CHUNK", 7)
    monkeypatch.setattr(la, "LINES", 3)
    lines = [f'{i},"q\n{i}",{"z" * i}' for i in range(20)]
    got = [line for batch in la.member_lines(zipped({"a.csv": "\r\n".join(lines)}), "utf-8", True) for line in batch]
    assert got == lines
