"""Scalar functions: one table of cases each."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paperledger.functions import amounts as A
from paperledger.functions import dates as D
from paperledger.functions import identity as I
from paperledger.functions import text as T


def values(spark, texts, make):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in rows.select("i", make(F.col("t")).alias("v")).orderBy("i").collect()]


AMOUNTS = {
    "1.234,56": "1234.56", "1,234.56": "1234.56", "1234": "1234", "1.234": "1234", "12,5": "12.5", "-5,00": "-5.00", "- 5,00": "-5.00", "+7": "7", "€ 1.148,70": "1148.70", "1.148,70 EUR": "1148.70",
    "1 234 567,89": "1234567.89", "199,50 399,00": None, "19% 218,25": None, "1.148,70 netto": "1148.70", "": None, "-": None, "abc": None, "1234567890123": None, "0,00": "0.00", "1.000.000": "1000000", "$5.5": "5.5", "12 34": None,
}


def test_parse_amount(spark):
    assert values(spark, list(AMOUNTS) + [None], A.parse_amount) == [*AMOUNTS.values(), None]


def test_parse_amount_with_a_pinned_separator(spark):
    got = values(spark, ["1.366,95 inkl. MwSt", "1,5000", "1,50000", ",5", "1.5", "1.366,95 brutto"], lambda t: A.parse_amount(t, F.lit(",")))
    assert got == [None, "1.5000", None, None, "15", "1366.95"]


def test_separator_render_and_compare(spark):
    assert values(spark, ["1.234,5", "1,234", "1.23", "12", "1.234.567,00"], A.detect_separator) == [",", None, ".", None, ","]
    assert values(spark, ["1234567.80", "-1000", "12.5", "0.00"], lambda t: A.render_amount(t, ",")) == ["1.234.567,80", "-1.000", "12,5", "0,00"]
    assert values(spark, ["1234567.80", "12.5"], lambda t: A.render_amount(t, ".", False)) == ["1234567.80", "12.5"]
    assert values(spark, ["2.00", "2", "02.10", None, "-0"], lambda t: A.number_equal(t, F.lit("2"))) == [True, True, False, False, False]
    assert values(spark, ["1.234,50 EUR", "x", "12", "1,50000"], lambda t: A.cell_to_dot(t, F.lit(","))) == ["1234.50", None, "12", "150000"]
    assert values(spark, ["1.5", " ", "poison", "1e3"], lambda t: A.money(A.to_decimal(t))) == ["1.50", None, None, "1000.00"]
    assert values(spark, ["25.00", "0.12345", "3"], lambda t: A.quantity(t.cast("decimal(18,6)"))) == ["25", "0.1235", "3"]


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-(10**11), 10**11), st.integers(1, 2)), min_size=20, max_size=40))
def test_render_then_parse_gives_the_amount_back(spark, numbers):
    dots = [f"{'-' if n < 0 else ''}{abs(n) // 10**k}.{abs(n) % 10**k:0{k}d}" for n, k in numbers]
    for sep in (",", "."):
        for grouped in (True, False):
            assert values(spark, dots, lambda t: A.parse_amount(A.render_amount(t, sep, grouped))) == dots  # noqa: B023


DATES = {
    "15.06.2026": "2026-06-15", "1.2.2026": "2026-02-01", "2026-06-15": "2026-06-15", "15/06/2026": "2026-06-15", "06/15/2026": None, "5. March 2024": "2024-03-05", "March 5, 2024": "2024-03-05", "5. März 2024": None, "15.06.49": "2049-06-15",
    "15.06.90": "1990-06-15", "15.06.75": None, "31.02.2026": None, "31.12.1989": None, "01.01.1990": "1990-01-01", "31.12.2100": "2100-12-31", "01.01.2101": None, "2026-06-15T10:00:00": None, "": None, " 15.06.2026 ": "2026-06-15",
}


def test_dates(spark):
    assert values(spark, list(DATES), D.parse_date) == list(DATES.values())
    assert values(spark, ["2026-06-05"], lambda t: D.render_date(t, "d. MMMM yyyy")) == ["5. June 2026"]
    assert values(spark, ["15.06.2026", "2026-06-15"], lambda t: D.parse_date_listed(t, F.array(F.lit("yyyy-MM-dd")))) == [None, "2026-06-15"]


def test_labels(spark):
    assert values(spark, ["Fällig am:", "Straße", "MwSt. 19%", "É-Ç", None], T.normalize_label) == ["falligam", "strae", "mwst19%", "ec", None]
    assert values(spark, ["Straße"], T.normalize_token) == ["strasse"]
    assert values(spark, ["R-2026-0042", "a.b*c"], T.generalize_pattern) == [r"R-\d+-\d+", r"a\.b\*c"]
    assert values(spark, ["Rechnungs-Nr.: 5", "Unsere Rechnungsnr 5", "RECHNUNGSNR"], lambda t: T.label_end(T.fold(t), "Rechnungsnr")) == [12, 0, 11]
    assert values(spark, ["```json\n{}\n```", "{}", "``` x"], T.strip_fences) == ["{}", "{}", "x"]
    assert values(spark, ["Netto: 5", "x 5", "5"], lambda t: T.label_before(t, F.instr(t, "5") - 1)) == ["Netto", None, None]


def test_identity(spark):
    assert values(spark, ["DE811907980", "DE 811907980", "DE811907981", "DE136695976", "FR811907980", None], I.valid_vat_id) == [True, True, False, True, False, False]
    assert values(spark, ["DE02120300000000202051", "de02 1203 0000 0000 2020 51", "DE03120300000000202051", "x"], I.valid_iban) == [True, True, False, False]
    assert values(spark, ["12/345/67890", "1234567890", "12345"], I.plausible_tax_number) == [True, True, False]
    assert values(spark, ["ACME Bürotechnik GmbH", None], lambda t: I.vendor_name_hash(t, F.lit(None).cast("string"))) == ["7b7db46f", None]


def test_vendor_ids(spark):
    lines = [("ACME Bürotechnik GmbH", 0.05), ("12345 Berlin", 0.08), ("USt-IdNr. DE811907980", 0.5), ("IBAN DE02 1203 0000 0000 2020 51", 0.9), ("Steuernummer 12/345/67890", 0.6)]
    df = spark.createDataFrame([(lines,)], "lines array<struct<text:string,y0:double>>")
    r = df.select(I.extract_vendor_ids(F.col("lines")).alias("v")).first().v
    assert (r.vat_id, r.tax_number, r.ibans, r.name_guess, r.postal_guess) == ("DE811907980", "12/345/67890", ["DE02120300000000202051"], "ACME Bürotechnik GmbH", "12345")


@pytest.mark.parametrize("text, folded", [("ÀÉîõü", "aeiou"), ("Ǆx", "ǆx")])
def test_fold_keeps_places(spark, text, folded):
    got = values(spark, [text], T.fold)[0]
    assert len(got) == len(text) and got == folded
