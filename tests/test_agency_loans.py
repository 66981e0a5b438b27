import datetime
import zipfile

import pytest
from conftest import rows

from tallyloom.sources import agency_loans as al
from tallyloom.sources.contracts import ContractError


def line(names, **values):
    return "|".join(str(values.get(n, "")) for n in names)


def test_acquisitions_and_performance(spark, tmp_path):
    fannie = [line(al.FANNIE_ACQUISITION, loan_id="100000000001", orig_date="04/2005", orig_upb="120000", credit_score="x", zip3="021"), "", line(al.FANNIE_ACQUISITION, loan_id="7", first_pay_date="13/2005")]
    (tmp_path / "Acquisition_2005Q2.txt").write_text("\n".join(fannie))
    loans = al.AgencyLoans(spark, str(tmp_path), "fannie_acquisition")
    assert rows(loans.load(2005, 2, ["loan_id", "orig_date", "orig_upb", "credit_score", "zip3", "first_pay_date"]), "loan_id") == [
        ("100000000001", datetime.date(2005, 4, 1), 120000.0, None, "021", None), ("7", None, None, None, None, None),
    ]
    (tmp_path / "Acquisition_2005Q2.txt").unlink()
    assert loans.load(2005, 2).count() == 2 and loans.load(2005, 3) is None  # the first comes from Parquet
    assert rows(loans.load_all([(2005, 2), (2005, 3)], ["loan_id"]), "loan_id") == [("100000000001", 2005, 2), ("7", 2005, 2)]
    with zipfile.ZipFile(tmp_path / "historical_data1_Q12006.zip", "w") as z:
        z.writestr("historical_data1_Q12006.txt", line(al.FREDDIE_ACQUISITION, loan_id="F1", first_pay_date="200604", credit_score=700) + "\n")
        months = [("3", "C"), ("R", "100.5"), ("XX", ""), ("", "U")]
        z.writestr("historical_data1_time_Q12006.txt", "\n".join(line(al.FREDDIE_PERFORMANCE, loan_id="F1", asof_date=f"20070{i}", delinq=d, net_sales_proceeds=p) for i, (d, p) in enumerate(months, 1)))
    assert rows(al.AgencyLoans(spark, str(tmp_path), "freddie_acquisition").load(2006, 1, ["loan_id", "first_pay_date", "credit_score"])) == [("F1", datetime.date(2006, 4, 1), 700.0)]
    made = al.AgencyLoans(spark, str(tmp_path), "freddie_performance").load(2006, 1)
    assert rows(made.select("asof_date", "delinq", "reo", "net_sales_proceeds_amt", "net_sales_proceeds_code"), "asof_date") == [
        (datetime.date(2007, 1, 1), 3, False, None, "C"),
        (datetime.date(2007, 2, 1), -1, True, 100.5, None),
        (datetime.date(2007, 3, 1), -2, False, None, None),
        (datetime.date(2007, 4, 1), -2, False, None, "U"),
    ]


def test_what_is_not_there(spark, tmp_path):
    with pytest.raises(ContractError, match="no dataset"):
        al.AgencyLoans(spark, str(tmp_path), "other")
    with pytest.raises(FileNotFoundError):
        al.AgencyLoans(spark, str(tmp_path), "fannie_acquisition").load_all([(2000, 1)])
