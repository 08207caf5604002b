"""Phones, addresses, e-mails, identifiers and the values of firm exports."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.functions.names import strip_latin_accents

# Street words and their short forms.
STREET_WORDS = {
    "street": "st", "st": "st", "avenue": "ave", "ave": "ave", "av": "ave", "boulevard": "blvd", "blvd": "blvd",
    "road": "rd", "rd": "rd", "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln", "court": "ct", "ct": "ct",
    "suite": "ste", "ste": "ste", "apartment": "apt", "apt": "apt", "floor": "fl", "fl": "fl", "north": "n", "south": "s",
    "east": "e", "west": "w", "place": "pl", "pl": "pl", "parkway": "pkwy", "pkwy": "pkwy",
}
# Words that name a street in an identifier's shape test.
STREET_TYPES = ("st", "street", "ave", "avenue", "rd", "road", "dr", "drive", "blvd", "boulevard", "ln", "lane", "ct", "court", "pl", "place", "pkwy", "parkway", "suite", "ste", "floor", "fl")
# US states by postal code, and names that are folded to them.
STATES = frozenset("al ak az ar ca co ct de fl ga hi id il in ia ks ky la me md ma mi mn ms mo mt ne nv nh nj nm ny nc nd oh ok or pa ri sc sd tn tx ut vt va wa wv wi wy dc pr".split())
STATE_NAMES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct",
    "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
    "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi",
    "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "ohio": "oh",
    "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt",
    "virginia": "va", "washington": "wa", "wisconsin": "wi", "wyoming": "wy",
}
# ISO 3779 weights, and the numbers of its letters.
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_LETTERS, VIN_NUMBERS = "ABCDEFGHJKLMNPRSTUVWXYZ", "12345678123457923456789"
DIGIT_KINDS = ("npi", "ssn", "tin", "phone")


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def digits(value: Column) -> Column:
    return F.regexp_replace(_text(value), "[^0-9]", "")


def phone_digits(value: Column) -> Column:
    """Digits; eleven with a leading 1 lose it."""
    d = digits(value)
    return F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)


def phone_last7(value: Column) -> Column:
    """The last seven digits, '' if there are fewer."""
    d = phone_digits(value)
    return F.when(F.length(d) >= 7, F.right(d, F.lit(7))).otherwise("")


def address_tokens(value: Column) -> Column:
    plain = F.regexp_replace(F.lower(strip_latin_accents(_text(value))), r"[^a-z0-9\s]", " ")
    table = F.create_map(*[F.lit(x) for pair in STREET_WORDS.items() for x in pair])
    return F.transform(F.filter(F.split(plain, r"\s+"), lambda t: t != ""), lambda t: F.coalesce(F.try_element_at(table, t), t))


def normalize_address(value: Column) -> Column:
    """Lower-case tokens with street words in their short form."""
    return F.array_join(address_tokens(value), " ")


def address_key(value: Column) -> Column:
    """number|first token that isn't a number|zip, what is missing left out."""
    norm = normalize_address(value)
    number = F.regexp_extract(norm, r"^([0-9]+)", 1)
    tokens = F.split(norm, " ")
    words = F.filter(F.when(number != "", F.slice(tokens, 2, 1 << 20)).otherwise(tokens), lambda t: (t != "") & ~t.rlike("^[0-9]+$"))
    zip_ = F.regexp_extract(norm, r"\b([0-9]{5})\b", 1)
    return F.concat_ws("|", F.nullif(number, F.lit("")), F.get(words, 0), F.nullif(zip_, F.lit("")))


def _fold(text: str) -> list[str]:
    return [STREET_WORDS.get(t, t) for t in re.sub(r"[^a-z0-9\s]", " ", text.lower()).split()]


def address_value(raw: str | None) -> dict[str, str]:
    """Street, city, state and zip of an address; '' for what it doesn't say."""
    raw = (raw or "").strip()
    code = m[1] if (m := re.search(r"\b([0-9]{5})(?:-[0-9]{4})?\b", raw)) else ""
    states = lambda t: [STATE_NAMES.get(x, x) for x in _fold(t)]
    tokens = states(raw)
    while tokens and tokens[-1] == code:
        tokens.pop()
    state = tokens.pop() if tokens and tokens[-1] in STATES else ""
    city = ""
    fields = [f for f in map(states, raw.split(",")) if f]
    if len(fields) > 1:
        own = next((i for i, f in enumerate(fields) if i and f[0] == state), None)
        if own is not None:
            city = " ".join(fields[own - 1])
        elif state and fields[-1][-1] in (code, state):
            city = " ".join(t for t in fields[-1] if t not in (code, state)) or " ".join(fields[-2])
    elif state and len(tokens) > 1:
        types = [i for i, t in enumerate(tokens) if t in STREET_WORDS.values()]
        if types and types[-1] + 1 < len(tokens):
            city = " ".join(tokens[types[-1] + 1 :])
            tokens = tokens[: types[-1] + 1]
    street = " ".join(tokens)
    if city and street.endswith(city):
        street = street[: -len(city)].strip()
    return {"street": street if street[:1].isdigit() else "", "city": city, "state": state, "zip": code}


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("street", "city", "state", "zip")]))
def address_parts(value: pd.Series) -> pd.DataFrame:
    """B11 as an Arrow UDF."""
    return pd.DataFrame([address_value(v) for v in value], columns=["street", "city", "state", "zip"])


def normalize_email(value: Column) -> Column:
    """Trimmed, lower case."""
    return F.lower(F.trim(_text(value)))


def email_domain(value: Column) -> Column:
    """What follows the first at-sign; '' without one."""
    e = normalize_email(value)
    at = F.instr(e, "@")
    return F.when(at > 0, F.substring(e, at + 1, F.length(e))).otherwise("")


def vin_valid(value: Column) -> Column:
    """17 characters without I, O and Q whose ninth is the ISO 3779 check digit."""
    v = F.upper(F.trim(_text(value)))
    numbers = F.translate(v, VIN_LETTERS, VIN_NUMBERS)
    total = sum((F.substring(numbers, i + 1, 1).try_cast("int") * w for i, w in enumerate(VIN_WEIGHTS)), F.lit(0)) % 11
    check = F.when(total == 10, "X").otherwise(total.cast("string"))
    return F.coalesce(v.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(v, 9, 1) == check), F.lit(False))


def npi_valid(value: Column) -> Column:
    """Ten digits that pass Luhn behind 80840."""
    d = digits(value)
    return (F.length(d) == 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), d))


def normalize_identifier(kind: Column, value: Column) -> Column:
    """Digits of npi, ssn, tin and phone; others trimmed, lower case."""
    return F.when(kind.isin(*DIGIT_KINDS), digits(value)).otherwise(normalize_email(value))


def identifier_shape_ok(kind: Column, value: Column) -> Column:
    """Whether a value can be an identifier of its kind at all."""
    s = F.trim(_text(value))
    n = F.length(digits(s))
    words = F.transform(F.split(F.lower(s), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,]+|[.,]+$", ""))
    return F.when(s == "", False).otherwise(
        F.when(kind == "phone", n >= 7)
        .when(kind == "email", s.contains("@") & F.substring_index(s, "@", -1).contains("."))
        .when(kind == "npi", npi_valid(s))
        .when(kind.isin("ssn", "tin"), n >= 9)
        .when(kind == "vin", vin_valid(s))
        .when(kind == "dob", n >= 4)
        .when(kind == "address", (n >= 1) | F.exists(words, lambda w: w.isin(*STREET_TYPES)))
        .otherwise(True)
    )


#: Fields whose separators don't count.
BARE_FIELDS = ("phone", "TIN", "zip_code")


def norm_value(field: Column, value: Column) -> Column:
    """A firm's value for comparison: phone, TIN and zip without separators; others squeezed, without ' .,;' at their ends; lower case."""
    low = F.lower(F.trim(_text(value)))
    bare = F.regexp_replace(low, r"[\s.()/,-]", "")
    return F.when(field.isin(*BARE_FIELDS), bare).otherwise(F.regexp_replace(F.regexp_replace(low, r"\s+", " "), r"^[ .,;]+|[ .,;]+$", ""))


def is_flagged(value: Column) -> Column:
    """1, true, yes or y."""
    return F.lower(F.trim(_text(value))).isin("1", "true", "yes", "y")


def note_ids(value: Column) -> Column:
    """The distinct note ids of a list cell, in order; 123.0 is 123."""
    tokens = F.transform(F.split(_text(value), ","), lambda t: F.regexp_replace(F.trim(t), r"^([0-9]+)\.0+$", "$1"))
    return F.array_distinct(F.filter(tokens, lambda t: t != ""))


def cited_notes(exact: Column, genai: Column) -> Column:
    """Notes that either search cites."""
    return F.array_union(note_ids(exact), note_ids(genai))
