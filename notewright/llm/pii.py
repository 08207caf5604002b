"""Personal data: fixed patterns, and spans grown from anchors.

An Aho-Corasick automaton reads each whole text once, with A-Z in lower case, and reports anchors:
at-signs, plus signs, schemes and identifier cues in several languages. Deterministic parsers grow
each anchor to its boundaries and validate what they find: the e-mail's domain labels, the URL's
authority, an IBAN's length and check digits, an account or identity number's digits, a postal
address's street and house number. Number kinds without an anchor of their own (IP addresses,
cards) start at digits, which one search finds.

The four base kinds follow fixed patterns, leftmost and without overlap within a kind; a match
that fails validation is passed over as a whole. Anchored kinds add spans that overlap no base
span and no earlier anchored span. Offsets are code points, ends exclusive. A null or empty text
has no spans. Time is linear in a text's length whatever it holds: digit runs are walked whole, a
URL's tail is searched once for all schemes in it, and overlaps are looked up in sorted spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm.common import bound_batches
from notewright.llm.textvec import slices

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds that anchors add, in the order that ties at one start take after the base kinds.
ADDED_KINDS = ("iban", "ssn", "account", "url", "secret", "address")
ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

# Cue words, by the kind that they announce.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security", "sozialversicherungsnummer", "numéro de sécurité sociale", "seguridad social"),
    "account": ("account number", "account no", "acct", "kontonummer", "numéro de compte", "número de cuenta"),
    "secret": ("token", "api_key", "api-key", "api key", "apikey", "secret", "secret_key", "secret key", "access key", "access_key", "accesskey"),
    "password": ("password", "passwd", "passwort", "mot de passe", "contraseña"),
    "url": ("http://", "https://", "ftp://"),
    "address": ("address", "adresse", "anschrift", "dirección", "domicilio"),
}
# Words that end or begin the name of a street.
STREET_AFTER = "street st avenue ave road rd boulevard blvd lane ln drive dr court ct place pl square sq way highway hwy parkway pkwy terrace".split()
STREET_WITHIN = "straße strasse str weg platz allee gasse ring damm".split()
STREET_BEFORE = "rue avenue boulevard chemin impasse place quai calle avenida plaza paseo camino carrera".split()
# IBAN lengths by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: A whole chain of digit runs joined by dots: nothing in it is tried twice.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SSN = re.compile(r"[\x20\t]*(?:(?:number|no\.?|nr\.?|#)[\x20\t]*)?[:=#]?[\x20\t]*([0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4})(?![0-9-])")
ACCOUNT = re.compile(r"[\x20\t]*(?:(?:number|no|nr)\b)?\.?[\x20\t]*[:=#]?[\x20\t]*([0-9](?:[\x20-]?[0-9]){5,19})(?![0-9])")
SECRET = re.compile(r"[\x20\t]*[:=][\x20\t]*[\"']?([A-Za-z0-9_\-+/]{20,})(?![A-Za-z0-9_\-+/])")
#: After a cue for passwords any mark but white space, quotes and separators can belong to the secret.
PASSWORD = re.compile(r"[\x20\t]*[:=][\x20\t]*[\"']?([^\s\"'<>,;]{6,})")
AUTHORITY = re.compile(r"(?:[^\s/?#@\"'<>]+@)?[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?(?::[0-9]{1,5})?")
URL_TAIL = re.compile(r"[^\s\"'<>]*")
ADDRESS = re.compile(
    r"[\x20\t]*[:=#]?[\x20\t]*(?P<span>"
    rf"[0-9]{{1,6}}[A-Za-z]?,?\x20(?:[^\W\d_][\w.'-]{{0,30}}\x20){{1,4}}(?i:{'|'.join(STREET_AFTER)})\b\.?"
    rf"|(?:[^\W\d_][\w.'-]{{0,30}}\x20){{0,3}}[^\W\d_][\w'-]{{0,30}}?\x20?(?i:{'|'.join(STREET_WITHIN)})\.?\x20[0-9]{{1,5}}[A-Za-z]?"
    rf"|(?:[0-9]{{1,5}}[A-Za-z]?,?\x20)?(?i:{'|'.join(STREET_BEFORE)})\x20(?:[^\W\d_][\w.'-]{{0,30}}\x20?){{1,5}}(?:,?\x20?[0-9]{{1,5}})?)"
    r"(?P<rest>(?:,\x20?[^\W\d_][^\W\d_.'-]{0,30}(?:\x20[^\W\d_][^\W\d_.'-]{0,30}){0,2}){0,2}(?:,?\x20(?:[A-Z]{2}\x20)?[0-9]{4,5}(?:-[0-9]{4})?(?![0-9]))?)"
)
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")

Span = tuple[str, int, int]


def lowered(text: str) -> str:
    """A-Z in lower case, nothing else, so offsets stay."""
    return text.lower() if text.isascii() else text.encode().lower().decode()  # bytes.lower() changes A-Z alone


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for kind, cues in CUES.items():
        for cue in cues:
            for form in {cue, lowered(cue.upper())}:  # letters beyond A-Z keep their case in the text that is searched
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


_built: list[ahocorasick.Automaton] = []


def anchors(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of each anchor, by its end."""
    if not _built:
        _built.append(_automaton())
    for last, (kind, size) in _built[0].iter(lowered(text)):
        yield kind, last + 1 - size, last + 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> Span | None:
    """The address around the at-sign at `at`, not before `floor`."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    if start == at or not (domain := DOMAIN.match(text, at)):
        return None
    return "email", start, domain.end()


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _iban(text: str, at: int) -> Span | None:
    if not (m := IBAN.match(text, at)) or (at and text[at - 1].isalnum()):
        return None
    size = IBAN_LENGTH.get(m[0][:2])
    if size is None:
        return None
    seen = 0
    for i, c in enumerate(m[0]):
        seen += c != " "
        if seen == size:
            end = at + i + 1
            own = m[0][: i + 1].replace(" ", "")
            number = "".join(str(int(c, 36)) for c in own[4:] + own[:4])
            return ("iban", at, end) if int(number) % 97 == 1 and not text[end : end + 1].isalnum() else None
    return None


class Tails:
    """Where URLs that begin at rising places end; a tail that several schemes share is searched once."""

    def __init__(self, text: str):
        self.text, self.to, self.stripped = text, -1, -1

    def end(self, at: int) -> int:
        if at >= self.to:
            self.to = self.stripped = URL_TAIL.match(self.text, at).end()
            while self.stripped > at and self.text[self.stripped - 1] in ".,;:!?)]}":
                self.stripped -= 1
        return max(at, self.stripped)


def _url(text: str, start: int, end: int, tails: Tails) -> Span | None:
    """A URL whose authority has user information; other links are not personal."""
    m = AUTHORITY.match(text, end)
    if not m or "@" not in m[0] or (start and text[start - 1].isalnum()):
        return None
    to = m.end()
    return "url", start, tails.end(to) if text[to : to + 1] in ("/", "?", "#") else to


def _grown(kind: str, text: str, start: int, end: int) -> Span | None:
    """What an added kind's parser makes of an anchor other than a scheme."""
    if start and text[start - 1].isalnum():
        return None
    if kind == "iban":
        at = end
        while at < len(text) and text[at] in " \t:=#":
            at += 1
        return _iban(text, at)
    pattern = {"ssn": SSN, "account": ACCOUNT, "secret": SECRET, "password": PASSWORD, "address": ADDRESS}[kind]
    if not (m := pattern.match(text, end)):
        return None
    if kind == "address":
        return kind, m.start("span"), m.end("rest")
    if kind == "ssn":
        d = _digits(m[1])
        if d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000":
            return None
    if kind in ("secret", "password") and not (re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])):
        return None
    return "secret" if kind == "password" else kind, m.start(1), m.end(1)


def _ips(text: str, at: int) -> Iterator[Span]:
    """Each four runs of a chain, from its left; a chain of fewer holds none."""
    for m in DOTTED.finditer(text, at):
        parts = m[0].split(".")
        begin = m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            end = begin + sum(map(len, own)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in own):
                yield "ip", begin, end
            begin = end + 1


class Taken:
    """Disjoint places that spans have taken, sorted."""

    def __init__(self, spans: list[Span]):
        self.places: list[tuple[int, int]] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.places and a < self.places[-1][1]:
                self.places[-1] = (self.places[-1][0], max(b, self.places[-1][1]))
            else:
                self.places.append((a, b))

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.places, (b,))  # the first place that begins at b or later
        return i == 0 or self.places[i - 1][1] <= a

    def add(self, a: int, b: int) -> None:
        insort(self.places, (a, b))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text, each by start, then kind."""
    if not text:
        return [], []
    base: list[Span] = []
    late: list[tuple[str, int, int]] = []
    floor = plus = 0
    for kind, start, end in anchors(text):
        if kind == "email":
            if start >= floor and (s := _email(text, start, floor)):
                base.append(s)
                floor = s[2]
        elif kind == "phone":
            if start >= plus and (m := PHONE.match(text, start)):
                plus = m.end()
                if 10 <= len(_digits(m[0])) <= 15:
                    base.append(("phone", start, m.end()))
        else:
            late.append((kind, start, end))
    if first := DIGIT.search(text):
        base += _ips(text, first.start())
        for m in CARD.finditer(text, first.start()):
            if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                base.append(("card", m.start(), m.end()))
    base.sort(key=lambda s: (s[1], ORDER[s[0]]))
    added: list[Span] = []
    taken, tails = Taken(base), Tails(text)
    for kind, start, end in late:
        s = _url(text, start, end, tails) if kind == "url" else _grown(kind, text, start, end)
        if s and taken.free(s[1], s[2]):
            added.append(s)
            taken.add(s[1], s[2])
    added.sort(key=lambda s: (s[1], ORDER[s[0]]))
    return base, added


def join(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns keep, __base and __spans: the spans of each text, joined as kind:start:end by commas."""
    keep = docs.columns if keep is None else keep
    given = docs.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)], F.col("text").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            base, all_ = [], []
            for text in batch.column("__text"):
                b, a = find(text.as_py())
                base.append(join(b))
                all_.append(join(sorted(b + a, key=lambda s: (s[1], ORDER[s[0]]))) if a else base[-1])
            yield pa.record_batch([*(batch.column(i) for i in range(len(keep))), pa.array(base), pa.array(all_)], [*(f"__k{i}" for i in range(len(keep))), "__base", "__spans"])

    kinds = [f"__k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
    found = bound_batches(given).mapInArrow(run, ", ".join([*kinds, "__base string", "__spans string"]))
    return found.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "__base", "__spans")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with the columns they came with; each span becomes its kind in brackets. Overlapping spans become one, of the first's kind."""
    found = spans(docs)

    def clean(text: str | None, joined: str) -> str | None:
        if not text or not joined:
            return text
        out, at = [], 0
        for kind, a, b in (s.split(":") for s in joined.split(",")):
            if int(a) >= at:
                out += [text[at : int(a)], f"[{kind}]"]
            at = max(at, int(b))
        return "".join([*out, text[at:]])

    @F.udf("string", useArrow=True)
    def apply(text, joined):
        return clean(text, joined)

    return found.withColumn("text", apply("text", "__spans")).select(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: one row per document."""
    found = spans(docs, ["doc_id"])
    # every span starts with its kind and a colon, and no kind ends with another
    counts = [F.regexp_count("__base", F.lit(rf"\b{k}:")).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2("__base", 256).alias("base_sha256"), F.col("__spans").alias("spans"))
