"""Personal information in free text: found through disguises, replaced by typed placeholders."""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.message_text import LOOKALIKES
from marlstone.tables import table

KINDS = ("email", "phone", "idnum", "address", "name")
#: Different names that teach given and family names, at most: they go to every task. More
#: raise an error, none are left out.
MOST_NAMES = 1_000_000

# --- Normalising with the places kept ------------------------------------------------------

_INVISIBLE = "[­​-‏⁠-⁤﻿]"
_ENTITY = r"&(?:#\d{1,6}|#x[0-9a-fA-F]{1,5}|[a-zA-Z]{2,8});"
_HIDDEN, _CODED = re.compile(_INVISIBLE), re.compile(_ENTITY)
_DIGIT_WORDS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_DIGIT_RUN = re.compile(rf"\b(?ai:(?:{'|'.join(_DIGIT_WORDS)})(?:(?:[ -]| (?:dash|hyphen) )(?:{'|'.join(_DIGIT_WORDS)})){{5,}})\b")
_SAID = _DIGIT_WORDS | {"dash": "-", "hyphen": "-"}
_HOST = r"[A-Za-z0-9][\w-]*"
# A mail address with its signs in brackets, or spoken throughout.
_AT, _DOT = (rf"\s?[(\[{{]\s?{word}\s?[)\]}}]\s?" for word in ("at", "dot"))
_SPOKEN = rf"(?<![\w.+@/-])[A-Za-z0-9][\w+%-]*(?:(?:\.|\sdot\s)[\w+%-]+)*\sat\s{_HOST}(?:\sdot\s{_HOST})+"
_SIGNS = re.compile(rf"(?i:{_AT}(?={_HOST})|(?<=\w){_DOT}(?={_HOST})|{_SPOKEN})")
# What any of these signs holds, by characters that a search can skip to.
_BRACKETED = re.compile(r"(?i:[(\[{]\s?(?:at|dot)\s?[)\]}])")
_SAID_DOT = re.compile(rf"(?i:\sat\s{_HOST}\sdot\s)")
_SIGN = re.compile(r"\s?[(\[{]?\s?\b(at|dot)\b\s?[)\]}]?\s?", re.IGNORECASE)


def _one_to_one() -> dict[str, str]:
    """Characters that stand for another one: wide forms, blanks, dashes, letters of other scripts."""
    pairs = {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    pairs |= {c: " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]}
    pairs |= {c: "-" for c in [0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212]}
    for source, plain in LOOKALIKES.items():
        pairs[source] = chr(plain) if isinstance(plain, int) else plain
        upper = chr(source).upper()
        if len(upper) == 1:
            pairs[ord(upper)] = pairs[source].upper()
    return {chr(c): plain for c, plain in pairs.items()}


_SAME_LENGTH = _one_to_one()


def _same_length(text: str) -> str:
    """The text with characters that stand for another one replaced: by ASCII, which stands for nothing else."""
    for c in _SAME_LENGTH.keys() & {*text}:
        text = text.replace(c, _SAME_LENGTH[c])
    return text


_REPLACED = re.compile(f"(?P<digits>{_DIGIT_RUN.pattern})|(?P<shift>{_INVISIBLE}|{_ENTITY})|(?P<signs>{_SIGNS.pattern})")


def normalise(text: str) -> tuple[str, list[int] | None]:
    """The text with disguises undone, and the source place of each of its characters.

    Places are None where each character still stands at its own place. Look-alike
    letters, wide forms, odd blanks and dashes keep their length; invisible characters
    vanish, entities become their character, spelled digits become digits, and the at and
    dots of a mail address their signs.
    """
    if not text.isascii():
        text = _same_length(text)
    small = text.lower()
    # A run has six digits at least; the signs of an address are in brackets or hold a dot.
    spelled = sum(map(small.count, _DIGIT_WORDS)) >= 6 and _DIGIT_RUN.search(text)
    signs = (_BRACKETED.search(text) or "dot" in small and _SAID_DOT.search(text)) and _SIGNS.search(text)
    shifts = not text.isascii() and _HIDDEN.search(text) or "&" in text and _CODED.search(text)
    if not spelled and not signs and not shifts:
        return text, None
    out: list[str] = []
    places: list[int] = []
    at = 0

    def keep(end: int) -> None:
        nonlocal at
        out.append(text[at:end])
        places.extend(range(at, end))
        at = end

    def put(new: str, start: int, end: int) -> None:
        nonlocal at
        keep(start)
        out.append(new)
        places.extend([start] * len(new))
        at = end

    for m in _REPLACED.finditer(text):
        if m["digits"]:
            for word in re.finditer("[A-Za-z]+", m[0]):
                new = _SAID[word[0].lower()]
                put(new, m.start() + word.start(), m.start() + word.end())
                at = m.end() if word.end() == len(m[0]) else at + len(re.match("[ -]?", m[0][word.end():])[0])
        elif m["shift"]:
            put(_same_length(html.unescape(m[0])) if m[0][0] == "&" else "", m.start(), m.end())
        else:
            for sign in _SIGN.finditer(text, m.start(), m.end()):
                put("@" if sign[1].lower() == "at" else ".", sign.start(), sign.end())
    keep(len(text))
    return "".join(out), [*places, len(text)]


def source_span(text: str, places: list[int] | None, start: int, end: int) -> tuple[int, int]:
    """The source span of a span of the normalised text; a replaced piece is taken whole."""
    if places is None:
        return start, end
    first, last = places[start], places[end - 1]
    piece = re.compile(rf"{_ENTITY}|[A-Za-z]+").match(text, last)
    if piece and (places[end] if end < len(places) else len(text)) >= piece.end() and (text[last] == "&" or text[last:piece.end()].lower() in _DIGIT_WORDS):
        return first, piece.end()
    return first, last + 1


# --- Finding ----------------------------------------------------------------------------------

_DOMAIN = re.compile(rf"@{_HOST}(?:\.{_HOST})+")
_LOCAL = re.compile(r"(?<![\w.+@/-])[A-Za-z0-9][\w+%-]*(?:\.[\w+%-]+)*$")
_NEAR = 120  # characters before a domain or street that are looked at first; more if these don't hold the begin

# A search for a pattern tries it at every place of a text, which takes long, and few texts hold
# a finding. Each pattern has a form that all its matches hold, looked for in the text as it stands
# in _form(); forms begin with one fixed sign, which a search can skip to.
_LIKE_ASCII = "\u0130\u0131\u017f\u212a"  # all other letters that IGNORECASE takes for i, s or k
_FORM = bytes(ord("0") if 48 <= c < 58 else c + 32 if 65 <= c < 91 else c for c in range(256))


def _form(text: str) -> bytes | None:
    """The text in lower case with 0 for each digit and ? for what is not ASCII; None if that hides digits or letters."""
    if not text.isascii() and any(c.isdecimal() or c in _LIKE_ASCII for c in {*text} if c > "\x7f"):
        return None
    return text.encode("ascii", "replace").translate(_FORM)


_PHONE = re.compile(
    r"(?=[+(\d])(?<![\w.+/:#-])(?:\+\d{1,3}[ .-]?(?:\(0\)[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{1,5}(?:[ ./-]?\d{2,5}){1,6}"
    r"|00\d{2}(?:[ .-]\d{1,4}){3,6}|00\d{10,13}|\(\d{3,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d{1,4}(?: ?/ ?|[ .-])\d{2,5}(?:[ .-]?\d{2,5}){1,4}|07\d{9})(?: ?(?:ext\.?|extension) ?\d{1,5})?(?![\w-]|\.\d)",
    re.IGNORECASE,
)
# A phone number begins with + or digits in brackets, has three parts set apart, or begins with a zero.
_PHONE_FORM = re.compile(rb"0(?:(?<=[+]0)|(?<=[(]0)0{2,4}[)]|(?<!00)00[.-]000[.-]0000)")
_PHONE_ZERO = re.compile(r"0(?<![\w.+/:#-]0)\d+(?: ?/ ?|[ .-])?\d")
_BARE = re.compile(r"(?<![\w.+/-])\d{10,13}(?![\w-])")
_IDNUM = re.compile(
    r"(?=\d|[A-Za-z]{1,2} ?-?\d)(?<![\w./-])(?:\d{3}([- ])\d{2}\1\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[XYZ]-?\d{7}-?[A-Z]|[XYZ]\d{8}"
    r"|\d{8}-?[A-Z]|\d{6}-\d{4}|[A-Z]\d[A-Z]{2}\d{2}[A-Z]\d{2})(?![\w/-]|\.\d)",
    re.IGNORECASE,
)
_ID_FORM = re.compile(rb"0(?<!00)(?:00[- ]00[- ]0000|0000000|00000-0000|0 ?00 ?00 ?[a-d]|000000-?[a-z]|[a-z][a-z]00[a-z]00)")
_UNIT = r"(?:,? (?:Apt|Flat|Unit|Suite|Apartment)\.? ?\d{1,4}[A-Za-z]?)?"
_WORD = r"[^\W\d_]+"
_WAYS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Close|Court|Ct|Way|Place|Square|Terrace"
_RUES = "rue|avenue|boulevard|place|chemin|allée|impasse|quai"
_SIDES = r"(?:(?:East|West|North|South|[NSEW]\.?) )?"
_ADDRESS = re.compile(
    rf"(?=\d)(?<![\w.-])(?:\d{{1,4}}[A-Za-z]? {_SIDES}{_WORD} (?:{_WAYS})\b{_UNIT}"
    rf"|\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{_RUES}) (?:de la |de l'|des |du |de |d')?{_WORD})"
    rf"|(?=[CAP])\b(?:Calle|C/|Avenida|Avda\.|Plaza|Paseo) (?:de (?:la |las |los |el )?|del )?{_WORD},? \d{{1,4}}(?:, \d{{1,2}}[ºª°o] ?[A-Z]\b)?",
    re.IGNORECASE,
)
_ADDRESS_FORM = re.compile(
    rf"0(?:[a-z]? {_SIDES}[a-z?]+ (?:{_WAYS})(?![a-z0_])|(?: (?:bis|ter|quater))?,? (?:{_RUES.replace('é', '[?]')}) )".lower().encode()
)
_CALLE_FORM = re.compile(rb" (?<=[/.aeo] )(?:(?<=calle )|(?<=c/ )|(?<=avenida )|(?<=avda\. )|(?<=plaza )|(?<=paseo ))")
_STREETS = ("straße", "strasse", "str.", "weg", "allee", "gasse", "platz", "ring", "damm", "ufer")  # fixed values
_STREET = re.compile(rf"(?:{'|'.join(map(re.escape, _STREETS))}) \d{{1,4}}(?: ?[a-z]\b)?", re.IGNORECASE)
_STREET_FORM = re.compile(f" 0(?:{'|'.join(rf'(?<={re.escape(street)} 0)' for street in _STREETS)})".replace("ß", "[?]").encode())
_STREET_START = re.compile(r"[^\W\d_]+$")
_WORDS = re.compile(r"[^\W\d_]+")
_LETTERS = bytes(c if c < 128 and chr(c).isalpha() else 32 for c in range(256))
# Capitalised words that may stand before a family name without being a given name.
_NO_NAME = set(
    "the with for from to cc dear hi hello herr frau mr mrs ms miss dr prof mme madame monsieur señor señora und and y et by subject re fwd fyi wg our my is was were "
    "das der die el la le les los las von van de del attention caller contact card sent forward holder passport both ask please ich wir could can did does do has have had "
    "will would should may might when where why how who whom what if are let thanks thank since after before until while but or so that this then there here as at in on".split()
)


def fold(word: str) -> str:
    """Lower case without accents."""
    word = word.lower()
    if word.isascii():
        return word
    return "".join(c for c in unicodedata.normalize("NFD", word.replace("ł", "l")) if not unicodedata.combining(c))


class Names:
    """Given names, and the stems and endings that family names are made of."""

    def __init__(self, people: list[str]) -> None:
        parts = [p.split() for p in people if p and len(p.split()) >= 2]
        self.given = {fold(p[0]) for p in parts if len(p[0]) > 2}
        family = {fold(p[-1]) for p in parts}
        stems, ends = defaultdict(set), defaultdict(set)
        for f in family:
            for k in range(3, len(f) - 2):
                stems[f[:k]].add(f[k:])
                ends[f[k:]].add(f[:k])
        self.stems = {s for s, e in stems.items() if len(e) >= 4}
        self.ends = {e for e, s in ends.items() if len(s) >= 4}
        self.family = family
        self.known: dict[str, int] = {}

    def kind(self, word: str) -> int:
        """1 for a given name, 2 for a family name, else 0."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 300_000:
                self.known.clear()
            f = fold(word) if len(word) > 2 else ""
            made = f in self.family or any(f[:k] in self.stems and f[k:] in self.ends for k in range(3, len(f) - 2))
            got = self.known[word] = 2 if made else 1 if f in self.given else 0
        return got

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Spans of full names: given name or initial and family name, in either order."""
        found = text.encode().translate(_LETTERS).decode().split() if text.isascii() else _WORDS.findall(text)
        kinds = list(map(self.known.get, found))
        if None in kinds:
            kinds = [self.kind(w) if k is None else k for w, k in zip(found, kinds)]
        if 2 not in kinds:
            return []
        words, end = [], 0
        for w in found:
            start = text.index(w, end)
            end = start + len(w)
            words.append((start, end, w))
        out: list[tuple[int, int]] = []
        gap = lambda i: text[words[i][1] : words[i + 1][0]]  # noqa: E731  between word i and the next
        for i in [i for i, kind in enumerate(kinds) if kind == 2]:
            start = None
            if i and (between := gap(i - 1)) and between.isspace() and len(between) < 4:
                before = words[i - 1][2]
                if kinds[i - 1] == 1 or before[0].isupper() and len(before) > 2 and fold(before) not in _NO_NAME and kinds[i - 1] != 2:
                    start = words[i - 1][0]
            elif i and re.fullmatch(r"\.\s{1,3}", between := gap(i - 1)) and len(words[i - 1][2]) == 1 and words[i - 1][2].isalpha():
                start = words[i - 1][0]
                first = words[i - 2][2] if i > 1 else ""
                if i > 1 and gap(i - 2).isspace() and (kinds[i - 2] == 1 or len(first) > 2 and first[0].isupper() and fold(first) not in _NO_NAME):
                    start = words[i - 2][0]
            follows = i + 1 < len(words) and re.fullmatch(r",\s{1,3}", gap(i)) and (kinds[i + 1] == 1 or len(words[i + 1][2]) == 1 and words[i + 1][2].isupper() and text[words[i + 1][1] : words[i + 1][1] + 1] == ".")
            if follows and (start is None or kinds[i - 1] != 1 and len(words[i - 1][2]) > 1):
                end = words[i + 1][1]
                if len(words[i + 1][2]) == 1:
                    end += 1
                elif i + 2 < len(words) and len(words[i + 2][2]) == 1 and words[i + 2][2].isupper() and gap(i + 1).isspace() and text[words[i + 2][1] : words[i + 2][1] + 1] == ".":
                    end = words[i + 2][1] + 1
                out.append((words[i][0], end))
            elif start is not None:
                out.append((start, words[i][1]))
        return out


def _before(pattern: re.Pattern, text: str, end: int) -> re.Match | None:
    """The match of a pattern that ends in $ and holds no blank in the text up to a place, however far it begins before."""
    size = _NEAR
    while True:
        near = text[max(0, end - size) : end]
        found = pattern.search(near, near.rfind(" ") + 1)
        if found is None or found.start() > 1 or size >= end:
            return found
        size *= 4


def find_personal(text: str | None, names: Names) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the findings in a text, by their place in the source.

    Of overlapping findings the kinds that come first in KINDS stand, a number with the
    form of an identity number before a phone number. Handles, single names, version
    control remotes and numbers of orders, builds and versions are no findings.
    """
    if not text:
        return []
    plain, places = normalise(text)
    found: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if all(end <= s or start >= e for _, s, e in found):
            found.append((kind, start, end))

    if "@" in plain:
        for m in _DOMAIN.finditer(plain):
            local = _before(_LOCAL, plain, m.start())
            if local and local[0].lower() != "git" and not re.match(r":\S", plain[m.end() : m.end() + 2]):
                add("email", m.start() - len(local[0]), m.end())
    form = _form(plain)
    for m in _IDNUM.finditer(plain) if form is None or _ID_FORM.search(form) else ():
        add("idnum", *m.span())
    for m in _PHONE.finditer(plain) if form is None or _PHONE_ZERO.search(plain) or _PHONE_FORM.search(form) else ():
        if 9 <= sum(c.isdigit() for c in re.sub(r"(?i) ?ext.*", "", m[0])) <= 15:
            add("phone", *m.span())
    if places is not None:  # ten digits that are spelled out are a phone number, in digits they may be any
        for m in _BARE.finditer(plain):
            if text[places[m.start()]].isalpha():
                add("phone", *m.span())
    for m in _ADDRESS.finditer(plain) if form is None or _ADDRESS_FORM.search(form) or _CALLE_FORM.search(form) else ():
        if any(c.isupper() for c in m[0]):
            add("address", *m.span())
    if form is None or _STREET_FORM.search(form):
        for m in _STREET.finditer(plain):
            word = _before(_STREET_START, plain, m.start())
            if word and any(c.isupper() for c in word[0] + m[0]):
                add("address", m.start() - len(word[0]), m.end())
    for span in names.spans(plain):
        add("name", *span)
    return sorted(((kind, *source_span(text, places, s, e)) for kind, s, e in found), key=lambda x: x[1])


# --- On tables --------------------------------------------------------------------------------


def learn_names(users: DataFrame) -> Names:
    """Names of the users' table: its different names, at most MOST_NAMES, else an error."""
    people = users.select("real_name").where("real_name IS NOT NULL").distinct().limit(MOST_NAMES + 1).collect()
    if len(people) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} names")
    return Names(sorted(r[0] for r in people))


def personal_information(df: DataFrame, key: str, text: str, names: Names) -> DataFrame:
    """key, kind, found_text: each distinct finding of each text, as written there.

    Null, empty and blank texts have no findings; whole texts are searched. Other columns
    of df are not kept. Each text is searched on its own, without a shuffle.
    """
    shared = df.sparkSession.sparkContext.broadcast(names)
    key_type = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            rows, kinds, texts = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for kind, found in dict.fromkeys((k, value[s:e]) for k, s, e in find_personal(value, known)):
                    rows.append(i)
                    kinds.append(kind)
                    texts.append(found)
            keys = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(kinds, pa.string()), pa.array(texts, pa.string())], names=[key, "kind", "found_text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {key_type}, kind string, found_text string")


def redact(text: str | None, names: Names) -> str | None:
    """The text with each finding replaced by its kind in brackets, all else as it is."""
    if not text:
        return text
    out, at = [], 0
    for kind, start, end in find_personal(text, names):
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redacted(df: DataFrame, text: str, names: Names) -> DataFrame:
    """df with placeholders in its text column; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(names)
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            columns[at] = pa.array([redact(t, known) for t in columns[at].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    """rec_key, kind, found_text of the personal information in records.body."""
    return personal_information(table(spark, base, "records"), "rec_key", "body", learn_names(table(spark, base, "slack_users")))


def p4_redacted(spark: SparkSession, base: str) -> DataFrame:
    """rec_key and body with typed placeholders in place of personal information."""
    return redacted(table(spark, base, "records").select("rec_key", "body"), "body", learn_names(table(spark, base, "slack_users")))


def p4_counts(spark: SparkSession, base: str) -> DataFrame:
    """Findings and rows with findings per kind."""
    return p4_found(spark, base).groupBy("kind").agg(F.count("*").alias("n_findings"), F.count_distinct("rec_key").alias("n_rows"))


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted, "p4_counts": p4_counts}
ORACLES: dict[str, str] = {}
