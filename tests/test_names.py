from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from notewright.functions import contact, names, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str | None) else 'int'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()["x"]


def test_jaro_winkler():
    assert names.jaro_winkler_value("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert names.jaro_winkler_value("", "a") == 0 and names.jaro_winkler_value("a", "a") == 1
    assert names.jaro_winkler_value("abc", "xyz") == 0
    assert names.token_set_value(["wilson"], ["marge", "wilson"]) == pytest.approx(0.5)
    assert names.token_set_value([], ["a"]) == 0


@pytest.mark.parametrize(("name", "want"), [("Robert", "R163"), ("Ashcraft", "A261"), ("Tymczak", "T522"), ("Pfister", "P236"), ("Honeyman", "H555"), ("", "0000"), (None, "0000"), ("123", "0000")])
def test_soundex(spark, name, want):
    assert one(spark, names.soundex_key(F.col("n")), n=name) == want


def test_names(spark):
    assert one(spark, names.normalize_name(F.col("n")), n="  Dr. José  O'Neil-Ruiz ") == "dr jose o neil ruiz"
    assert one(spark, names.normalize_name(F.col("n"), "all"), n="Łukasz Žižek") == "ukasz zizek"
    assert one(spark, names.name_tokens(F.col("n")), n="Dr. Ann Lee Jr.") == ["ann", "lee"]
    assert one(spark, names.name_suffix(F.col("n")), n="Ann Lee Jr.") == "jr" and one(spark, names.name_suffix(F.col("n")), n=None) is None
    assert one(spark, names.are_nickname_variants(F.lit("Bob Ito"), F.col("n")), n="Robert Ito")
    assert not one(spark, names.are_nickname_variants(F.lit("Bob"), F.col("n")), n="Bob") and not one(spark, names.are_nickname_variants(F.lit("Jon"), F.col("n")), n="John")


def test_contact(spark):
    a = "1420 Maple Street, Springfield, IL 62704"
    assert one(spark, contact.address_key(F.col("a")), a=a) == "1420|maple|62704"
    assert one(spark, contact.address_key(F.col("a")), a=a[:-6]) == "1420|maple"
    assert contact.address_value(a) == {"street": "1420 maple st", "city": "springfield", "state": "il", "zip": "62704"}
    assert contact.address_value("220 W Adams St Chicago Illinois 60606") == {"street": "220 w adams st", "city": "chicago", "state": "il", "zip": "60606"}
    assert contact.address_value("Springfield IL 62704")["street"] == "" and contact.address_value(None)["zip"] == ""
    assert one(spark, contact.phone_digits(F.col("p")), p="+1 (555) 010-9999") == "5550109999" and one(spark, contact.phone_last7(F.col("p")), p="12") == ""
    assert one(spark, contact.npi_valid(F.col("p")), p="1568291037") and not one(spark, contact.npi_valid(F.col("p")), p="1568291038") and not one(spark, contact.npi_valid(F.col("p")), p=None)
    assert one(spark, contact.vin_valid(F.col("p")), p="1M8GDM9AXKP042788") and not one(spark, contact.vin_valid(F.col("p")), p="1M8GDM9A1KP042788") and not one(spark, contact.vin_valid(F.col("p")), p="short")
    assert one(spark, contact.email_domain(F.col("p")), p=" A@B.c ") == "b.c" and one(spark, contact.email_domain(F.col("p")), p="none") == ""
    assert one(spark, contact.note_ids(F.col("p")), p="12.0, 7,,12") == ["12", "7"] and one(spark, contact.note_ids(F.col("p")), p=None) == []
    assert one(spark, contact.norm_value(F.lit("TIN"), F.col("p")), p="00-123 4567") == "001234567"
    assert not one(spark, contact.identifier_shape_ok(F.lit("phone"), F.col("p")), p="voicemail")


def test_text(spark):
    assert one(spark, text.polarity(F.col("t"), F.lit(20), F.lit(25)), t="Claimant denies that Smith was there") == "negated"
    assert one(spark, text.relation_predicate(F.col("t")), t=" Went-to ") == "TREATED_BY" and one(spark, text.graph_predicate(F.col("t")), t="mentioned in") is None
    assert one(spark, text.plausible_name(F.col("t")), t="Marge Wilson") and not one(spark, text.plausible_name(F.col("t")), t="Wilson") and not one(spark, text.plausible_name(F.col("t")), t="CONFIDENTIALITY NOTICE")
    assert one(spark, text.plausible_name(F.col("t"), F.array(F.lit("wilson"))), t="Wilson") and not one(spark, text.plausible_name(F.col("t")), t=None)
    assert one(spark, text.casing(F.col("t")), t="a b")["regime"] == "sparse"
    assert one(spark, text.boilerplate_score(F.col("t")), t="Privileged. Intended recipient. In error.") == 1.0 and one(spark, text.boilerplate_score(F.col("t")), t=None) == 0
    assert one(spark, text.weight_to_probability(F.col("t")), t=0) == 0.5
    assert one(spark, text.entity_type(F.col("t")), t="Dr. Vance") == "person" and one(spark, text.entity_type(F.col("t")), t=None) == "unknown"
    assert text.grounded_value("phone is 555-0100 now", 9, 17, "555-0100") and text.grounded_value("Marge Wilsen here", 0, 12, "Marge Wilson") and not text.grounded_value("abc", 0, 3, "zzz") and not text.grounded_value("abc", 0, 3, None)
    assert text.relocate("a\n b C", "A B c") == (0, 6, "case") and text.relocate("x", "y") is None and text.relocate("ab  cd", "b c") == (1, 5, "whitespace")
    assert text.locate_value("Ann, Bob, Ann", "Ann", 9) == 10 and text.locate_value("ann", "ANN", 0) == 0 and text.locate_value("Ann\n Lee", "ann lee", 0) == 0 and text.locate_value("x", "y", 0) == -1
