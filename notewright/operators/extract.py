"""Extraction lanes over chunks, their union, and the sweep for what they missed.

A lane is a provider: a function from texts to lists of (start, end, label, score). Lanes that need a
model take one from their caller; nothing is substituted for a model that isn't there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions import text as values
from notewright.functions.text import locate_value
from notewright.operators.coref import ANAPHOR
from notewright.operators.intervals import uncovered, union_spans

Found = list[tuple[int, int, str, float]]
Provider = Callable[[list[str]], list[Found]]


class NoModel(RuntimeError):
    """A lane was asked for whose model isn't there."""


# Endings of organizations, words that open sentences, and words that are no names by themselves.
ORG_ENDINGS = "LLP LLC Inc PLLC PC Group Associates Partners Center Clinic Hospital Body Collision Automotive Orthopedics Neurology Therapy Imaging Chiropractic".split()
OPENERS = frozenset(
    "Contacted Spoke Reached Called Received Sent Left Confirmed Advised Requested Reviewed Discussed Emailed Followed Following Per Attached Forwarded "
    "Submitted Completed Performed Issued Filed Provider Counsel Treatment Status Financial Investigation Correspondence Mailing Billing Coverage Note File "
    "Diary Reserves Expense Nothing Awaiting Documentation No Will".split()
)
NO_NAMES = frozenset(
    "Claim Claimant Clmt Atty Attorney Counsel Provider Physician Email Phone Address Mailing Contact Birthdate From Sent To Subject Direct Date Of Birth Please "
    "Following Per Client Records Desk Re See Kindly We Confidentiality Notice This If You The Status Available Mon Tue Wed Thu Fri Sat Sun Jan Feb Mar Apr May Jun "
    "Jul Aug Sep Oct Nov Dec Law Group Department Claims Notify Sender Delete Message Intended Recipient Sole Use Attachments POA NPI TIN DOB".split()
)
# The forms of names, with the label (none: it depends on the words) and the score of each.
FORMS = {"titled": ("medical_provider", 0.9), "reversed": ("person", 0.85), "initial": ("person", 0.7), "sequence": ("", 0.75)}
# What may stand behind a name, and the most words of a title's name and of a sequence.
SUFFIXES = frozenset(["Jr", "Sr", "II", "III"])
TITLED_WORDS, SEQUENCE_WORDS = 3, 4
#: Words in capitals at their start, single capitals with a dot, commas, blanks on a line, and all else.
LEXEME = re.compile(r"(?P<W>[A-Z][A-Za-z'’-]++(?!\w))|(?P<I>[A-Z]\.)|(?P<C>,)|(?P<S>[ \t]+)|(?P<X>\w+|[^\w])")


class Lexemes:
    """A text cut into lexemes, and the words that follow one another in it."""

    def __init__(self, text: str):
        self.text = text
        found = [(m.lastgroup, m.start(), m.end()) for m in LEXEME.finditer(text)]
        self.kind = "".join(k for k, _, _ in found)
        self.start = [a for _, a, _ in found]
        self.end = [b for _, _, b in found]

    def word(self, i: int) -> str:
        return self.text[self.start[i] : self.end[i]]

    def run(self, i: int, most: int) -> int:
        """The last word of a run of at most `most` words, a blank between each two, that begins at word i."""
        for _ in range(most - 1):
            if self.kind[i + 1 : i + 3] != "SW":
                break
            i += 2
        return i

    def with_suffix(self, i: int) -> int:
        return i + 2 if self.kind[i + 1 : i + 3] == "SW" and self.word(i + 2) in SUFFIXES else i

    def form(self, name: str, i: int) -> int:
        """The last lexeme of a name of that form that begins at lexeme i; -1 if there is none."""
        if name == "initial":
            return i + 2 if self.kind[i : i + 3] == "ISW" else -1
        if self.kind[i] != "W":
            return -1
        if name == "reversed":
            return self.with_suffix(i + 3) if self.kind[i : i + 4] == "WCSW" else -1
        if name == "titled":
            if self.word(i) != "Dr":
                return -1
            dot = self.kind[i + 1 : i + 2] == "X" and self.word(i + 1) == "."
            first = i + 2 + dot
            return self.run(first, TITLED_WORDS) if self.kind[first - 1 : first + 1] == "SW" else -1
        last = self.run(i, SEQUENCE_WORDS)
        return self.with_suffix(last) if last > i else -1


def role_of(context: str) -> str | None:
    low = context.lower()
    return next((role for role, cues in values.ROLE_CUES if any(c in low for c in cues)), None)


def _sequence_label(words: list[str], context: str) -> str:
    if any(w.startswith(e) for w in words[1:] for e in ORG_ENDINGS) or any(words[-1].endswith(e) for e in ORG_ENDINGS):
        return "organization"
    return role_of(context) or "person"


def name_spans(text: str) -> Found:
    """Name-shaped spans, by their place: titled, surname first, initial, and sequences of capitalised words.

    Each form reads the text once from the left without overlap. Words that open sentences are
    taken off the front; anaphors and names of nothing but common words go, and so does a span inside
    a longer one. Of forms that agree in a span the one with the highest score counts.
    """
    lex = Lexemes(text)
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, (label, score) in FORMS.items():
        i = 0
        while i < len(lex.kind):
            last = lex.form(name, i)
            if last < 0:
                i += 1
                continue
            first = i
            while first < last and lex.kind[first : first + 2] == "WS" and lex.word(first) in OPENERS:
                first += 2
            span = lex.start[first], lex.end[last]
            words = [lex.word(j).rstrip(".") for j in range(first, last + 1) if lex.kind[j] in "WI"]
            plain = [w for w in words if w.isalpha()]
            if not ANAPHOR.fullmatch(text[span[0] : span[1]]) and not (plain and NO_NAMES.issuperset(plain)):
                own = label or _sequence_label(words, text[max(0, lex.start[i] - 40) : lex.start[i]])
                best[span] = max(best.get(span, (0.0, "")), (score, own))
            i = last + 1
    out: Found = []
    reached = -1
    for a, b in sorted(best, key=lambda s: (s[0], -s[1])):  # the longest first, so what ends no later than others before it lies inside one
        if b > reached:
            out.append((a, b, best[a, b][1], best[a, b][0]))
            reached = b
    return out


def names_lane(texts: list[str]) -> list[Found]:
    """C7 as a provider."""
    return [name_spans(t) for t in texts]


def salient_lane(texts: list[str], leading: int = 3) -> list[Found]:
    """A labelled stand-in for a model that attends to what comes first: the first few names, and those with a role's cue."""
    out = []
    for t in texts:
        found = name_spans(t)
        out.append([(a, b, label, 0.8) for i, (a, b, label, _) in enumerate(found) if i < leading or role_of(t[max(0, a - 40) : a])])
    return out


def located(items: list[dict], text: str) -> Found:
    """A model's entities (text, label, start) where their surface stands; offsets are hints, absent surfaces go."""
    out = []
    for item in items:
        surface = str(item.get("text") or "")
        at = locate_value(text, surface, int(item.get("start") or 0))
        if at >= 0:
            out.append((at, at + len(surface), str(item.get("label") or "person"), float(item.get("confidence") or 0.8)))
    return out


#: What a model has to answer for a text: a JSON schema.
SPAN_SCHEMA = {
    "type": "object",
    "required": ["entities"],
    "properties": {
        "entities": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ["text", "label"],
                "properties": {"text": {"type": "string"}, "label": {"type": "string"}, "start": {"type": "integer"}, "confidence": {"type": "number"}},
            },
        }
    },
}


def chosen(name: str, makers: dict[str, Callable[[], Provider]]) -> Provider:
    """The provider of that name. An unknown name and a model that can't be made are errors: nothing takes its place."""
    if name not in makers:
        raise ValueError(f"unknown lane {name}; there are {', '.join(sorted(makers))}")
    try:
        return makers[name]()
    except Exception as e:
        raise NoModel(f"lane {name}: {type(e).__name__}: {e}") from e


def span_model(predict: Callable[[list[str], list[str]], list[list[dict]]], labels: list[str], least: float = 0.5) -> Provider:
    """A provider of a model that answers, for a batch of texts and the labels wanted, dicts of start, end, label and score."""

    def run(texts: list[str]) -> list[Found]:
        return [[(int(s["start"]), int(s["end"]), str(s["label"]), float(s["score"])) for s in found if s["score"] >= least and 0 <= s["start"] < s["end"] <= len(t)] for t, found in zip(texts, predict(texts, labels), strict=True)]

    return run


def schema_model(ask: Callable[[list[str], dict], list[dict | None]]) -> Provider:
    """A provider of a model that answers a batch of texts in SPAN_SCHEMA. Answers out of it count as empty; surfaces are
    located, never taken at the model's offsets; anaphors are no names."""

    def run(texts: list[str]) -> list[Found]:
        out = []
        for t, answer in zip(texts, ask(texts, SPAN_SCHEMA), strict=True):
            items = answer.get("entities") if isinstance(answer, dict) else None
            good = [i for i in items or [] if isinstance(i, dict) and str(i.get("text") or "").strip() and not ANAPHOR.fullmatch(str(i["text"]).strip())]
            out.append(located([i | {"text": str(i["text"]).strip(), "start": i["start"] if isinstance(i.get("start"), int) else 0} for i in good], t))
        return out

    return run


SPANS = "start int, end int, text string, label string, extractors array<string>, score double, description string"


def lane(chunks: DataFrame, provider: Provider | None, name: str) -> DataFrame:
    """The spans that a provider finds in chunks (doc_id, char_start, text), in offsets of the document.

    The provider gets a batch of texts at a time, and is made once a worker if it caches its model.
    """
    if provider is None:
        raise NoModel(f"lane {name} has no model")
    kind = chunks.schema["doc_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [t or "" for t in f["text"]]
            rows = [(d, o + a, o + b, t[a:b], label, [name], score, None) for d, o, t, found in zip(f["doc_id"], f["char_start"], texts, provider(texts), strict=True) for a, b, label, score in found]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "text", "label", "extractors", "score", "description"])

    return chunks.select("doc_id", "char_start", "text").mapInPandas(run, f"doc_id {kind}, {SPANS}")


def extract(chunks: DataFrame, lanes: dict[str, Provider | None], gazetteer: DataFrame | None = None) -> DataFrame:
    """The union of all lanes' spans, and of gazetteer hits (doc_id, start, end, text, label, valid)."""
    found = None
    for name, provider in lanes.items():
        own = lane(chunks, provider, name)
        found = own if found is None else found.unionByName(own)
    if gazetteer is not None:
        hits = gazetteer.where("valid").select("doc_id", "start", "end", "text", "label", F.array(F.lit("regex_gazetteer")).alias("extractors"), F.lit(1.0).alias("score"), F.lit(None).cast("string").alias("description"))
        found = hits if found is None else found.unionByName(hits)
    return union_spans(found)


# Words that are no candidates by themselves.
NOISE = frozenset(
    "the and for with from sent subject please advise claim note status per our call attaching updated demand client available next week have not received records yet "
    "kindly expedite confidentiality notice this email any attachments are sole use intended recipient may contain privileged information you notify sender delete "
    "message direct earlier prior same above denies alleges ongoing pain spoke clmt atty poa corr coverage states mail returned undeliverable will confirm new addr tx dr "
    "re following suspect shop inflating parts file wrong correct listed birth date phone address mailing contact provider physician treating counsel attorney claimant "
    "name nm num tel ph dob birthdate npi tin".split()
)
CANDIDATE = r"\b(?:[A-Z][a-zA-Z'’\-]{2,}(?:[ \t]+[A-Z][a-zA-Z'’\-]{2,})*|\d[\w\-./]{2,})\b"


def sweep(docs: DataFrame, spans: DataFrame, most: int = 40) -> DataFrame:
    """doc_id, start, end, text: capitalised or numeric tokens that no span covers and that aren't noise."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = re.compile(CANDIDATE)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for d, t in zip(f["doc_id"], f["text"], strict=True):
                for m in shape.finditer(t or ""):
                    words = m[0].split()
                    if not ANAPHOR.fullmatch(m[0]) and not all(w.lower().strip(".,") in NOISE for w in words):
                        rows.append((d, m.start(), m.end(), m[0], t[max(0, m.start() - 40) : m.start()]))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "text", "left"])

    candidates = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, start int, end int, text string, left string")
    return uncovered(candidates, spans.select("doc_id", "start", "end"), most)


def promote(candidates: DataFrame, hits: DataFrame | None = None, structure_only: bool = False) -> DataFrame:
    """C11: candidates that become spans, with label: structured codes, names of two words, titles, words by a role's cue.

    hits: doc_id, start, end, label of valid gazetteer hits. structure_only: codes alone (the later rule).
    """
    c = candidates if hits is None else candidates.join(hits.select("doc_id", "start", "end", F.col("label").alias("code")), ["doc_id", "start", "end"], "left")
    if hits is None:
        c = c.withColumn("code", F.lit(None).cast("string"))
    role = values.role_from_context(F.col("left"))
    words = F.split("text", r"\s+")
    names_ = F.when((F.size(words) >= 2) & F.forall(words, lambda w: w.rlike("^[A-Z]")), F.coalesce(role, F.lit("person"))).when(F.lower("text").startswith("dr"), "medical_provider").when(F.col("text").rlike("^[A-Z]"), role)
    label: Column = F.col("code") if structure_only else F.coalesce(F.col("code"), names_)
    return c.withColumn("label", label).where("label is not null").select("doc_id", "start", "end", "text", "label")


def bind_identifiers(hits: DataFrame, told: DataFrame) -> DataFrame:
    """The hits with the owner that a model names for each, and method (named or unbound). Hits without one stay.

    hits: doc_id, kind, value and more. told: doc_id, kind, value, owner, as a model answered, so a value is
    compared by its letters and digits alone (phones by their last ten digits) and a hit that several
    owners are named for takes the least.
    """
    plain = F.regexp_replace(F.lower("value"), "[^a-z0-9]", "")
    key = F.when(F.col("kind") == "phone", F.right(plain, F.lit(10))).otherwise(plain).alias("__key")
    owners = told.where("owner is not null and owner <> ''").select("doc_id", "kind", key, "owner").groupBy("doc_id", "kind", "__key").agg(F.min("owner").alias("owner"))
    out = hits.select("*", key).join(owners, ["doc_id", "kind", "__key"], "left").drop("__key")
    return out.withColumn("method", F.when(F.col("owner").isNull(), "unbound").otherwise("named"))


def relations(raw: DataFrame) -> DataFrame:
    """Accepted and refused relations of a provider: predicate (folded), refused (reason or null), descriptor flags, polarity.

    raw: doc_id, subject, predicate, object, polarity, evidence, and text of the document. Evidence
    has to stand in the text; a polarity outside the closed set becomes asserted and is flagged.
    """
    predicate = values.relation_predicate(F.col("predicate"))
    known = F.col("polarity").isin("asserted", "negated", "alleged", "reported", "retracted")
    at = values.relocate_evidence("text", F.col("evidence"))
    out = raw.withColumn("at", at).withColumn("folded", predicate)
    return out.select(
        "doc_id", "subject", F.col("folded").alias("predicate"), "object",
        F.when(known, F.col("polarity")).otherwise("asserted").alias("polarity"), (~F.coalesce(known, F.lit(False))).alias("polarity_coerced"),
        values.is_anaphor(F.col("subject")).alias("subject_is_descriptor"), values.is_anaphor(F.col("object")).alias("object_is_descriptor"),
        F.col("at.start").alias("start"), F.col("at.end").alias("end"),
        F.coalesce(values.relation_verdict(F.col("folded")), F.when(F.col("at.start").isNull(), "evidence not found")).alias("refused"),
    )
