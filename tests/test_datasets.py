import datetime

import pytest
from conftest import rows

from tallyloom.sources import datasets
from tallyloom.sources import loan_archives as la


def test_names_tell_what_they_are():
    names = datasets.list_datasets()
    assert list(names) == sorted(names) and {"loan_registers", "flow_variables", "fannie_acquisition", "housing_values"} <= set(names) and all(names.values())
    with pytest.raises(ValueError, match="no table"):
        datasets.load_dataset("no such", None)


def test_tables_are_loaded_by_name(spark, tmp_path):
    (tmp_path / "b101.csv").write_text("date,FL152000005.Q\n2001:Q1,3\n2001:Q2,ND\n")
    (tmp_path / "f101.csv").write_text("date,FA156010001.Q\n2001:Q2,7\n")
    made = datasets.load_dataset("flow_variables", spark, str(tmp_path), "household", ["assets", "gross_income", "net_worth"])
    assert rows(made, "date") == [(datetime.date(2001, 1, 1), 3.0, None), (datetime.date(2001, 4, 1), None, 7.0)]
    with pytest.raises(ValueError, match="no group"):
        datasets.load_dataset("flow_variables", spark, str(tmp_path), "none")
    (tmp_path / "h.csv").write_text("RegionID,RegionName,2020-02\n7,501,1.5\n")
    assert rows(datasets.load_dataset("housing_values", spark, str(tmp_path / "h.csv"), geography="zip").select("zip", "zhvi")) == [("00501", 1.5)]
    for year, layout in ((1995, la.EARLY), (2006, la.LATER)):
        folder = tmp_path / "raw" / "nara" / str(year)
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text("".join(str({"loan_amt": year % 100}.get(n, "")).rjust(w) for n, w in layout.fields))
    assert rows(datasets.load_dataset("loan_registers", spark, str(tmp_path), [1995, 2006], columns=["loan_amount_000s"]), "source_year") == [(95, "1995", "nara"), (6, "2006", "nara")]
