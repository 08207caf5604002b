"""Person and organization names."""

from __future__ import annotations

import unicodedata

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens that are not part of a name, and suffixes that are.
TITLES = ("dr", "mr", "mrs", "ms", "miss", "atty", "esq", "prof")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")

# Groups of first names that stand for one another. "jon" is in two; the last counts.
NICKNAMES = (
    "robert rob bob bobby bert",
    "william will bill billy liam",
    "richard rich rick dick ricky",
    "james jim jimmy jamie",
    "john jack johnny jon",
    "michael mike mickey mick",
    "thomas tom tommy",
    "charles charlie chuck chas",
    "joseph joe joey",
    "edward ed eddie ted teddy",
    "anthony tony",
    "daniel dan danny",
    "christopher chris topher",
    "matthew matt",
    "nicholas nick nico",
    "elizabeth liz beth betty eliza lizzie",
    "katherine catherine kate katie kathy cathy kat",
    "margaret maggie meg peggy marge",
    "patricia pat patty trish",
    "jennifer jen jenny",
    "deborah deb debbie",
    "susan sue susie",
    "rebecca becca becky",
    "jonathan jon jonny",
    "alexander alex al xander",
    "benjamin ben benny",
    "samuel sam sammy",
    "stephen steven steve stevie",
    "andrew andy drew",
)
NICKNAME_GROUP = {name: i for i, group in enumerate(NICKNAMES) for name in group.split()}

LATIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"


def _plain(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """B1: compatibility decomposition without combining marks; null stays null."""
    return text.map(lambda t: None if t is None else t if t.isascii() else _plain(t))


def strip_latin_accents(text: Column) -> Column:
    """B1 for Latin-1 letters alone, inside the JVM."""
    return F.translate(text, LATIN, _plain(LATIN))


def normalize_name(name: Column, accents: str = "latin") -> Column:
    """B2: no accents, lower case, other than a-z, 0-9 and white space to spaces, squeezed, trimmed. Null gives ''.

    accents: "latin" strips Latin-1 accents in the JVM, "all" decomposes by an Arrow UDF.
    """
    plain = strip_accents(name) if accents == "all" else strip_latin_accents(name)
    lower = F.lower(F.coalesce(plain, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lower, r"[^a-z0-9\s]", " "), r"\s+", " "))


def name_tokens(name: Column, drop_titles: bool = True, drop_suffix: bool = True) -> Column:
    """Tokens of the normal form, by default without titles and suffixes."""
    out = [*(TITLES if drop_titles else ()), *(SUFFIXES if drop_suffix else ()), ""]
    return F.filter(F.split(normalize_name(name), " "), lambda t: ~t.isin(out))


def name_suffix(name: Column) -> Column:
    """The first suffix of the name, null if there is none."""
    return F.get(F.filter(F.split(normalize_name(name), " "), lambda t: t.isin(*SUFFIXES)), 0)


def jaro(a: str, b: str, floor: bool = False) -> float:
    """Jaro similarity; floor rounds half a transposition down."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    taken = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                taken.append(j)
                break
    if not left:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(left, sorted(taken), strict=True))
    m = len(left)
    half = moved // 2 if floor else moved / 2
    return (m / len(a) + m / len(b) + (m - half) / m) / 3


def jaro_winkler_value(a: str, b: str, mode: str = "plain") -> float:
    """Jaro-Winkler with p = 0.1 and prefixes of at most 4. mode "duckdb": floors half transpositions, boosts above 0.7 only."""
    j = jaro(a, b, floor=mode == "duckdb")
    if mode == "duckdb" and j <= 0.7:
        return j
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return j + prefix * 0.1 * (1 - j)


@lru_cache(1 << 16)
def remembered_jaro_winkler(a: str, b: str, mode: str) -> float:
    """Blocked pairs repeat the same few names over and over, so a worker remembers so many pairs of them."""
    return jaro_winkler_value(a, b, mode)


def jaro_winkler(mode: str = "plain"):
    """B4 as an Arrow UDF of two strings; null if either is."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else remembered_jaro_winkler(x, y, mode) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run


def token_set_value(a: list[str], b: list[str]) -> float:
    """Each token of the smaller set takes its best remaining partner, in order; the sum over the larger set's size."""
    if not len(a) or not len(b):
        return 0.0
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    rest, total = list(large), 0.0
    for t in small:
        scores = [remembered_jaro_winkler(t, u, "plain") for u in rest]
        best = scores.index(max(scores))
        total += scores[best]
        rest.pop(best)
    return total / len(large)


@F.pandas_udf(T.DoubleType())
def _token_set(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_value(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def token_set_jw(a: Column, b: Column) -> Column:
    """B5 of two names."""
    return _token_set(name_tokens(a), name_tokens(b))


def soundex_key(name: Column) -> Column:
    """Soundex of the letters of the normal form; '0000' without letters."""
    letters = F.regexp_replace(normalize_name(name), "[^a-z]", "")
    return F.when(letters == "", "0000").otherwise(F.soundex(letters))


def nickname_group(token: Column) -> Column:
    """Number of the nickname group, null for other names."""
    table = F.create_map(*[F.lit(x) for pair in NICKNAME_GROUP.items() for x in pair])
    return F.try_element_at(table, token)


def are_nickname_variants(a: Column, b: Column) -> Column:
    """The first tokens differ and are in one group."""
    x, y = F.get(name_tokens(a), 0), F.get(name_tokens(b), 0)
    return F.coalesce((x != y) & (nickname_group(x) == nickname_group(y)), F.lit(False))
