"""Predicates, polarity, classes, roles, casing, boilerplate, templates and types of text."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Relation predicates and the form they are folded to.
RELATION_FORMS = {
    "represented_by": "REPRESENTED_BY", "is_represented_by": "REPRESENTED_BY", "retained": "REPRESENTED_BY",
    "counsel_for": "REPRESENTS", "represents": "REPRESENTS", "attorney_for": "REPRESENTS",
    "treated_by": "TREATED_BY", "is_treated_by": "TREATED_BY", "went_to": "TREATED_BY", "was_seen_at": "TREATED_BY",
    "visited": "TREATED_BY", "seen_by": "TREATED_BY", "treats": "TREATED_BY",
    "referred_to": "REFERRED_TO", "referred": "REFERRED_TO",
    "repaired_by": "REPAIRED_BY", "repairs": "REPAIRED_BY", "vehicle_repaired_by": "REPAIRED_BY", "towed_to": "REPAIRED_BY",
    "employed_by": "EMPLOYED_BY", "works_for": "EMPLOYED_BY", "employed_at": "EMPLOYED_BY", "employer_of": "EMPLOYS",
    "affiliated_with": "AFFILIATED_WITH", "works_at": "AFFILIATED_WITH", "member_of": "AFFILIATED_WITH", "partner_at": "AFFILIATED_WITH",
    "supervises": "SUPERVISES", "supervisor_of": "SUPERVISES",
    "adjuster_on": "ADJUSTER_ON", "adjusts": "ADJUSTER_ON", "handled_by": "ADJUSTER_ON", "handles": "ADJUSTER_ON",
}
# Graph predicates and the form they are folded to; provenance that is no relation; relations too vague to keep.
GRAPH_FORMS = {
    "WENT_TO": "TREATED_BY", "WAS_SEEN_AT": "TREATED_BY", "VISITED": "TREATED_BY", "SEEN_BY": "TREATED_BY", "TREATS": "TREATED_BY",
    "REPRESENTS": "REPRESENTED_BY", "COUNSEL_FOR": "REPRESENTED_BY", "REPAIRS": "REPAIRED_BY", "FIXED": "REPAIRED_BY",
    "ADJUSTS": "ADJUSTED_BY", "HANDLED_BY": "ADJUSTED_BY", "WORKS_FOR": "EMPLOYED_BY", "EMPLOYED_AT": "EMPLOYED_BY",
}
GRAPH_BANNED = ("MENTIONED_IN", "HAS_NOTE", "APPEARS_IN", "REFERENCED_BY")
RELATION_BANNED = (*GRAPH_BANNED, "IS_IN_DOCUMENT", "NOTED_IN")
DEGENERATE = ("IS", "IS_ON", "IS_A", "WAS", "HAS", "REPORTS", "USED", "FILED", "ARRANGED", "PERFORMED", "MADE", "PROVIDED", "RECEIVED", "SENT", "CONTACTED")
IDENTIFIER_PREDICATE = "^(HAS_)?(NPI|TIN|SSN|EIN|PHONE|PHONE_NUMBER|EMAIL|EMAIL_ADDRESS|ADDRESS|DOB|DATE_OF_BIRTH|ZIP|POLICY_NUMBER|CLAIM_NUMBER)$"
# Polarity cues in order of precedence.
POLARITY_CUES = (
    ("retracted", ("wrong", "correct is", "prior note listed")),
    ("alleged", ("suspect", "alleg")),
    ("negated", ("denies", "denied", "no ", "not ")),
    ("reported", ("reported", "per records", "states", "advised")),
)
# Cues of roles, in order.
ROLE_CUES = (
    ("attorney", ("atty", "attorney", "counsel", "esq", "law group", "law offices", "llp", "legal", "trial group")),
    ("medical_provider", ("dr.", "dr ", "physician", "provider", "clinic", "hospital", "orthopedic", "physical therapy", "imaging", "chiropractic", "neurology", "medical group", "npi")),
    ("repair_shop", ("auto body", "collision", "automotive", "car care", "body works", "repair", "shop", "tin")),
    ("adjuster", ("adjuster", "claims department", "claim rep", "examiner")),
)
# Cues of entity classes.
SHOP_CUES = ("auto body", "collision", "automotive", "car care", "body works", "repair")
PROVIDER_CUES = ("orthopedic", "physical therapy", "imaging", "medical group", "chiropractic", "neurology", "clinic", "hospital")
FIRM_CUES = ("law group", "llp", "legal", "trial group", "attorneys", "law offices")
FIRM_AFTER_CUES = ("law group", "llp", "legal partners", "trial group", "injury attorneys", "law offices")
CARRIER_DOMAIN = "ourinsco.com"
LABEL_CLASS = {
    "person": "claimant", "organization": "medical_provider", "medical_provider": "medical_provider", "law_firm": "attorney",
    "attorney": "attorney", "repair_shop": "repair_shop", "adjuster": "adjuster", "claimant": "claimant",
}
# Labels that open header lines, and the shape of legal headings.
HEADER_LABELS = (
    "From Sent To Cc Subject Date Claim Claimant Clmt Atty Attorney Counsel Provider Physician Treating Mailing Email Phone Address Contact "
    "Birthdate DOB NPI TIN Direct Confidentiality Notice"
).split()
LEGAL_HEADING = r"^[A-Z][A-Z\s&'/.-]{6,}$"
# Cues of disclaimers.
BOILERPLATE_CUES = (
    "confidentiality", "intended recipient", "privileged", "unauthorized", "disclosure", "dissemination", "if you have received this",
    "in error", "delete this", "notify the sender", "attorney-client", "work product", "confidential and may be", "for the sole use",
)
# Keywords of note categories, in order.
CATEGORY_WORDS = (
    ("medical_management", ("tx", "treatment", "records", "physician", "provider", "npi", "surgery")),
    ("legal_litigation", ("demand", "counsel", "attorney", "litigation", "suit", "deposition")),
    ("siu_investigation", ("suspect", "siu", "fraud", "investigat", "inflating")),
    ("repair_estimate", ("repair", "parts", "estimate", "shop", "collision", "body")),
    ("payment", ("payment", "paid", "check", "issued", "reserve")),
    ("subrogation", ("subro", "subrogation", "recovery", "lien")),
    ("plan_of_action", ("poa", "plan of action", "spoke w", "follow up", "next call")),
    ("general_correspondence", ("correspondence", "email", "letter")),
)
# Pronouns by what they agree with, and descriptors by the class they stand for.
PRONOUNS = {"person": ("he", "him", "his", "she", "her", "hers"), "any": ("they", "them", "their", "theirs"), "org": ("it", "its")}
DESCRIPTORS = {
    "the physician": "medical_provider", "the doctor": "medical_provider", "the provider": "medical_provider",
    "the treating facility": "medical_provider", "the facility": "medical_provider", "the clinic": "medical_provider",
    "the hospital": "medical_provider", "said provider": "medical_provider", "the claimant": "claimant", "the clmt": "claimant",
    "the insured": "claimant", "the attorney": "attorney", "the atty": "attorney", "the counsel": "attorney", "the shop": "repair_shop",
    "the adjuster": "adjuster", "the carrier": "adjuster", "same as above": None,
}
PERSON_CLASSES = ("claimant", "attorney", "adjuster", "person", "medical_provider")
ORG_CLASSES = ("repair_shop", "organization", "law_firm", "medical_provider")
# Words that type a name.
LEGAL_FORMS = ("llp", "llc", "inc", "pc", "pllc", "ltd", "corp", "plc", "lp", "pa")
PERSON_TITLES = ("dr", "mr", "mrs", "ms", "miss", "prof", "rev", "hon", "sgt", "officer", "atty")
PERSON_SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "md", "do", "esq", "phd", "rn", "np", "dds", "dc", "lcsw", "pt")
HEAD_NOUNS = ("group", "associates", "partners", "center", "centre", "clinic", "services", "institute", "hospital", "company", "agency", "firm")


def any_in(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether the text holds one of the cues."""
    found = F.lit(False)
    for c in cues:
        found = found | text.contains(c)
    return found


def first_of(choices: list[tuple[Column, Column | str]], default: Column) -> Column:
    """The value of the first condition that holds."""
    out = F
    for condition, value in choices:
        out = out.when(condition, value)
    return out.otherwise(default)


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def relation_predicate(text: Column) -> Column:
    """Folded to its form; unknown ones in upper case."""
    raw = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[ -]", "_"), "_+", "_")
    raw = F.regexp_replace(raw, "^_|_$", "")
    return F.coalesce(F.try_element_at(_table(RELATION_FORMS), raw), F.upper(raw))


def relation_verdict(predicate: Column) -> Column:
    """Why a normal form is refused, null if it is not."""
    return F.when(predicate == "", "empty").when(predicate.isin(*RELATION_BANNED), "banned").when(predicate.rlike(IDENTIFIER_PREDICATE), "identifier").when(predicate.isin(*DEGENERATE), "degenerate")


def graph_predicate(text: Column) -> Column:
    """In upper case, folded; null for provenance, which is no relation."""
    p = F.upper(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"\s+", "_"))
    return F.when(~p.isin(*GRAPH_BANNED), F.coalesce(F.try_element_at(_table(GRAPH_FORMS), p), p))


def polarity(text: Column, start: Column, end: Column) -> Column:
    """By the first kind of cue in the window from 40 before to 10 behind the span."""
    low = F.greatest(start - 40, F.lit(0))
    window = F.lower(F.substring(text, low + 1, end + 10 - low))
    return first_of([(any_in(window, cues), F.lit(kind)) for kind, cues in POLARITY_CUES], F.lit("asserted"))


def role_from_context(context: Column) -> Column:
    """The first role with a cue in the context, null if none has."""
    low = F.lower(context)
    return first_of([(any_in(low, cues), F.lit(role)) for role, cues in ROLE_CUES], F.lit(None).cast("string"))


def entity_class(surface: Column, label: Column, left: Column, right: Column) -> Column:
    """The class of a name by itself, then by what stands around it, then by its label."""
    low, before, after = F.lower(surface), F.lower(left), F.lower(right)
    domain = f"@{CARRIER_DOMAIN}"
    return first_of(
        [
            (any_in(low, SHOP_CUES), F.lit("repair_shop")),
            (low.startswith("dr") | any_in(low, PROVIDER_CUES), F.lit("medical_provider")),
            (any_in(low, FIRM_CUES), F.lit("attorney")),
            (after.contains(domain) | before.contains(domain), F.lit("adjuster")),
            (after.contains("claims department") | any_in(before, ("adjuster", "claim rep")), F.lit("adjuster")),
            (after.rlike(r"@(?!ourinsco\.com|example\.com)[a-z0-9.\-]+\.[a-z]{2,}"), F.lit("attorney")),
            (any_in(after, FIRM_AFTER_CUES), F.lit("attorney")),
        ],
        F.coalesce(role_from_context(left), F.try_element_at(_table(LABEL_CLASS), label), F.lit("claimant")),
    )


def plausible_name(surface: Column, known: Column | None = None, extractors: Column | None = None) -> Column:
    """Two capitalised words or a leading "dr"; one alone needs a known token or two extractors.

    known: array of lower-case tokens of names the document has already introduced.
    """
    s = F.trim(F.coalesce(surface, F.lit("")))
    caps = F.filter(F.split(s, r"[\s,]+"), lambda t: t.rlike(r"^\p{Lu}") & F.regexp_replace(t, r"^\.+|\.+$", "").rlike(r"^\p{L}+$"))
    known = F.array().cast("array<string>") if known is None else F.coalesce(known, F.array().cast("array<string>"))
    extractors = F.lit(1) if extractors is None else extractors
    anchored = F.array_contains(known, F.lower(F.regexp_replace(F.get(caps, 0), r"^\.+|\.+$", ""))) | (extractors >= 2)
    shaped = (F.length(s) >= 3) & ~s.contains("\n") & ~s.rlike(LEGAL_HEADING) & ~s.rlike(rf"(?i)^({'|'.join(HEADER_LABELS)})\b")
    return F.coalesce(shaped & ((F.size(caps) >= 2) | F.lower(s).startswith("dr") | ((F.size(caps) == 1) & anchored)), F.lit(False))


def grounded_value(text: str | None, start: int, end: int, value: str | None, least: float = 0.82) -> bool:
    """The value stands within 5 characters of its span, or something like it does."""
    v = (value or "").strip().lower()
    if not v:
        return False
    window = (text or "")[max(0, start - 5) : end + 5].lower()
    if v in window:
        return True
    match = difflib.SequenceMatcher(None, b="", autojunk=True)
    match.set_seq1(v)
    for i in range(max(1, len(window) - len(v) + 1)):
        match.set_seq2(window[i : i + len(v)])
        if match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least:
            return True
    return False


@F.pandas_udf(T.BooleanType())
def span_grounded(text: pd.Series, start: pd.Series, end: pd.Series, value: pd.Series) -> pd.Series:
    """B25 as an Arrow UDF."""
    return pd.Series([grounded_value(t, int(s), int(e), v) for t, s, e, v in zip(text, start, end, value, strict=True)])


CASED_WORD = r"[A-Za-z][A-Za-z'’\-]+"


def casing(text: Column) -> Column:
    """Struct of regime, case_informative, n_words, upper_frac, capitalized_frac, lower_frac (rounded to 4)."""
    # A word begins at the first letter of a run of letters, apostrophes and hyphens; each kind is counted by one search.
    count = lambda pattern: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rf"(?<![A-Za-z'’\-])['’\-]*{pattern}(?![A-Za-z'’\-])"))
    n = count(r"[A-Za-z][A-Za-z'’\-]+")
    share = lambda pattern: F.when(n == 0, 0.0).otherwise(count(pattern) / n)
    upper, cap, lower = share(r"[A-Z][A-Z'’\-]+"), share(r"[A-Z][A-Za-z'’\-]+"), share(r"[a-z][a-z'’\-]+")
    regime = F.when(n < 12, "sparse").when(upper >= 0.60, "upper").when(cap <= 0.02, "lower").otherwise("mixed")
    return F.struct(
        regime.alias("regime"),
        (regime == "mixed").alias("case_informative"),
        n.alias("n_words"),
        F.round(upper, 4).alias("upper_frac"),
        F.round(cap, 4).alias("capitalized_frac"),
        F.round(lower, 4).alias("lower_frac"),
    )


def boilerplate_score(text: Column) -> Column:
    """A third for each disclaimer cue, at most 1; 0.15 more for a text with cues and without digits. Advisory."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = sum((low.contains(c).cast("int") for c in BOILERPLATE_CUES), F.lit(0))
    score = F.least(F.lit(1.0), hits / 3.0)
    return F.round(F.when((hits > 0) & ~low.rlike("[0-9]"), F.least(F.lit(1.0), score + 0.15)).otherwise(score), 3)


LABEL = r"^\s*(?:([A-Za-z][A-Za-z0-9 ._#/&-]{0,40})\s*[:=]\s|([A-Za-z][A-Za-z0-9 ._#/&]{0,40})\s+-\s)"


def template_fingerprint(text: Column, kind: Column | None = None) -> Column:
    """A hash of the sequence of line labels, null for fewer than two or for quoted segments."""
    lines = F.transform(F.split(text, "\n"), lambda line: F.concat(line, F.lit("\n")))
    name = lambda line: F.regexp_replace(F.lower(F.concat(F.regexp_extract(line, LABEL, 1), F.regexp_extract(line, LABEL, 2))), "[^a-z]", "")
    labels = F.filter(F.transform(lines, name), lambda x: x != "")
    value = F.when(F.size(labels) >= 2, F.substring(F.sha1(F.array_join(labels, "|")), 1, 16))
    return value if kind is None else F.when(kind != "quoted", value)


def note_category(text: Column) -> Column:
    """The category with most keyword hits, the first of equals; general_correspondence without any."""
    low = F.lower(F.coalesce(text, F.lit("")))
    counts = F.array(*[sum((F.regexp_count(low, F.lit(w)) for w in words), F.lit(0)) for _, words in CATEGORY_WORDS])
    names = F.array(*[F.lit(c) for c, _ in CATEGORY_WORDS])
    # the counts are bound once, as the only element of an array
    pick = lambda n: F.when(F.array_max(n) > 0, F.element_at(names, F.array_position(n, F.array_max(n)).cast("int")))
    return F.coalesce(F.transform(F.array(counts), pick)[0], F.lit("general_correspondence"))


def weight_to_probability(weight: Column) -> Column:
    """2**w / (1 + 2**w)."""
    return 1 / (1 + F.pow(F.lit(2.0), -weight))


def is_anaphor(surface: Column) -> Column:
    """A pronoun or a vague descriptor."""
    return F.lower(F.trim(surface)).isin(*[p for group in PRONOUNS.values() for p in group], *DESCRIPTORS)


def name_words(name: Column) -> Column:
    words = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(r"[A-Za-z&'’.\-]+"), F.lit(0))
    return F.filter(F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[.,'’]+|[.,'’]+$", ""))), lambda w: w != "")


def entity_type(name: Column, head_nouns: Column | None = None) -> Column:
    """Person, organization or unknown, by the string alone. head_nouns: array of learned last words."""
    words = name_words(name)
    first, last, n = F.get(words, 0), F.element_at(words, -1), F.size(words)
    nouns = F.array(*[F.lit(w) for w in HEAD_NOUNS]) if head_nouns is None else head_nouns
    return (
        F.when(n == 0, "unknown")
        .when(first.isin(*PERSON_TITLES) | last.isin(*PERSON_SUFFIXES), "person")
        .when(F.exists(words, lambda w: w.isin(*LEGAL_FORMS)) | name.contains("&"), "organization")
        .when((n >= 2) & F.array_contains(nouns, last), "organization")
        .when(n.isin(2, 3) & F.forall(words, lambda w: w.rlike(r"^\p{L}+$")), "person")
        .otherwise("unknown")
    )


def comparison_strategy(a: Column, b: Column) -> Column:
    """How two typed names compare; a mismatch is generic, never a veto."""
    known = F.when(a == "unknown", b).when(b == "unknown", a)
    return F.when((a == b) & a.isin("person", "organization"), a).when(known.isin("person", "organization"), known).otherwise("generic")


def descriptor_class(surface: Column) -> Column:
    """The class a descriptor stands for, null for none."""
    return F.try_element_at(_table({k: v for k, v in DESCRIPTORS.items() if v}), F.lower(F.trim(surface)))


def collapse(text: str) -> tuple[str, list[int]]:
    """A text with each run of white space as one space, and where each of its characters stood."""
    out, at = [], []
    for m in re.finditer(r"\s+|\S", text):
        out.append(" " if m[0].isspace() else m[0])
        at.append(m.start())
    return "".join(out), at


def relocate(text: str | None, quote: str | None) -> tuple[int, int, str] | None:
    """Where a quote stands: exact, else with white space collapsed, else without case. No paraphrase."""
    if not text or not (quote or "").strip():
        return None
    if (i := text.find(quote)) >= 0:
        return i, i + len(quote), "exact"
    flat, at = collapse(text)
    want = collapse(quote.strip())[0]
    for how, a, b in (("whitespace", flat, want), ("case", flat.lower(), want.lower())):
        if len(a) == len(at) and (i := a.find(b)) >= 0:
            return at[i], at[i + len(b) - 1] + 1, how
    return None


@F.pandas_udf(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("how", T.StringType())]))
def relocate_evidence(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
    """B31 as an Arrow UDF; nulls where the quote isn't found."""
    found = [relocate(t, q) or (None, None, None) for t, q in zip(text, quote, strict=True)]
    frame = pd.DataFrame(found, columns=["start", "end", "how"])
    return frame.astype({"start": "Int32", "end": "Int32"})


def locate_value(text: str | None, surface: str | None, hint: int) -> int:
    """The occurrence nearest to the hint, exact, else the first without case, else by collapsed white space; -1 for none."""
    if not text or not surface:
        return -1
    exact = [m.start() for m in re.finditer(f"(?={re.escape(surface)})", text)]
    if exact:
        return min(exact, key=lambda i: (abs(i - hint), i))
    low = text.lower()
    if (i := low.find(surface.lower())) >= 0:
        return i
    words = surface.lower().split()
    if not words:
        return -1
    spaced = re.compile(r"\s+".join(map(re.escape, words)))
    found = [m.start() for m in spaced.finditer(low) if m.end() - m.start() <= len(surface) + 8]
    return min(found, key=lambda i: (abs(i - hint), i)) if found else -1


@F.pandas_udf(T.IntegerType())
def locate(text: pd.Series, surface: pd.Series, hint: pd.Series) -> pd.Series:
    """B32 as an Arrow UDF."""
    return pd.Series([locate_value(t, s, int(h)) for t, s, h in zip(text, surface, hint, strict=True)], dtype="int32")
