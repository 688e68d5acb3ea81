"""PII surrogates (operator 5).

Entities are found by pattern and check digit, and each is replaced by a keyed surrogate of
its own type: digits stay digits, letters keep case and script, separators stay, card and
account numbers keep valid check digits. A surrogate is a function of the key, the type and
the entity in normal form, so every mention of an entity gets the same one. All distinct
entities are checked for collisions in what the text will show, with one another and with
entities that the corpus really holds; the losers draw again until none is left.

Types: email, phone, ip, card, account (IBAN), ssn, name (after a title, of any number of
parts, initials and particles; in the same text also without the title, wherever the surname
stands again).

Names are replaced part by part, and a part gets one surrogate whatever title or other part
stands beside it, so "Mr. John Smith", "Dr. Smith" and a later "Smith" remain one person. A
part that is somewhere a surname looks like a surname; others are given names of the gender
that the corpus' titles tell. Initials are drawn letter by letter and may coincide.

The key is the session's ``spark.quillgraph.pii.key`` unless the caller gives one.

Defined results: null text stays null with no entities; text without entities is returned
as it is; repeated rows each get a row; the other columns are kept.
"""

from __future__ import annotations

import hashlib
import logging
import re
import secrets
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import cut, fresh, prepared, table

#: Where a session names its key; the key of the registered query and pipeline where it names none, which is no secret.
KEY_SETTING, DEMO_KEY = "spark.quillgraph.pii.key", b"quillgraph-demo-key"
#: Entities drawn again up to which their surrogates are sent to every executor; beyond, joined.
BROADCAST_ENTITIES = 100_000
KINDS = ("email", "phone", "ip", "card", "account", "ssn", "name")

#: Titles before a name, by gender (f, m, or n where the title tells none).
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Dr": "n", "Prof": "n", "Doctor": "n", "Professor": "n",
    "MR": "m", "MRS": "f", "MS": "f", "DR": "n", "PROF": "n", "HERR": "m", "FRAU": "f",
    "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Sr": "m", "Sra": "f",
    "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Mme": "f", "Mlle": "f", "г-н": "m", "г-жа": "f",
}
#: Given names to draw from, by script and gender.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl Daniel Emil Felix Gabriel Hugo Ivan Julian Karl Leo Martin Noel Oscar Paul Quentin Robert Simon Victor".split(),
    ("latin", "f"): "Alba Bianca Clara Diana Elena Flora Greta Helena Irma Julia Karla Laura Maria Nora Olga Paula Rita Sara Teresa Vera".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Глеб Денис Игорь Кирилл Леонид Максим Николай Олег Павел Роман Семён Тимур".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса Софья".split(),
}
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha ho ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vi".split(), "cyrillic": "ба бе бо ва ве во га го да де до ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то".split()}
#: What a part of a name is, the first of several that a corpus shows: a surname, else a given name by gender.
ROLES = {"s": "0", "f": "1", "m": "2", "n": "3"}
#: Names that are common words too: without a title they count inside a sentence alone, where a capital tells.
WORDS = set(
    "black brown gray green white red gold good grand rich strong sharp wise young short long little hard major french will may mark grant chase cook cross drew hope love price judge "
    "spring summer winter north west rose snow grace joy law bill banks fields stone waters woods gross jung klein kurz lang schwarz sommer stark weiss braun blanc brun grand petit noir blanco leon moreno rojo rubio".split()
)
#: Parts that stand after a surname and tell nothing.
SUFFIXES = {"jr", "sr", "ii", "iii", "iv"}

_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_LETTER, _UPPER = r"[^\W\d_]", r"[^\W\d_a-zß-öø-ÿа-яё]"
#: What ends a sentence, or a line, before a word.
_OPENS = re.compile(r"(?:\A|[.!?:]['\")\]]*\s+|\n\s*|[\"“„«(]\s*)\Z")
#: A name part: a word, an initial with its dot, or a lone letter that is no English word.
_PART = rf"(?:{_UPPER}(?:{_LETTER}|['’](?={_UPPER}))+|(?:{_UPPER}|Ph|Th|Chr|St)\.|{_UPPER}(?!\w)(?:(?<![IA])|(?=\x20{_UPPER})))"
#: Small words that may stand before a name part.
_PARTICLE = r"(?:(?:von|van|vom|zu|zur|zum|der|den|dem|de|del|della|di|da|do|dos|das|du|des|la|le|las|los|el|al|bin|ibn|ben|ter|ten|te|af|av|фон|де)[\x20-])*"
_NAME = re.compile(rf"(?<!\w)({_TITLE})(\.?\x20(?:(?:{_TITLE})\.?\x20)*)({_PARTICLE}{_PART}(?:(?:[\x20-]|(?<=\.)){_PARTICLE}{_PART})*)")
_DIGITS = re.compile(
    r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\w))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{3}\)[\x20.-]?\d{3}[\x20.-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<!\d\x20)(?:\d{3}\x20\d{3}\x20\d{4}|0\d{2,4}[\x20/-]\d{5,8})(?!\x20\d))(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
)
#: Digits at blanks and hyphens, of which some may be a card.
_RUN = re.compile(r"(?<!\w)\d(?:[\x20-]?\d){12,}(?!\w)")
#: Lengths of the groups in which card numbers are printed.
_PRINTED = {(4, 4, 4, 4), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 3, 3, 3), (4, 5, 6)}
#: First digits and lengths of the numbers that are issued.
_ISSUED = re.compile(r"4(?:\d{12}|\d{15}|\d{18})\Z|3[47]\d{13}\Z|(?:5\d|2[2-7])\d{14}\Z|(?:30|36|38|39)\d{12,17}\Z|35\d{14,17}\Z|(?:5[06-9]|6\d)\d{11,17}\Z|220\d{13,16}\Z")
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")
_LOCAL = re.compile(r"[\w.%+-]{1,64}\Z")
_DOMAIN = re.compile(r"(?:[\w-]{1,63}\.){1,8}[^\W\d_]{2,24}(?![\w-])")
_ANY = re.compile(r"[0-9@]").search
_PARTS = re.compile(_PART).finditer
_CAPITALISED = re.compile(rf"(?<!\w){_UPPER}(?:{_LETTER}|['’](?={_UPPER}))+").finditer


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def iban(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def cards(text: str, others: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Start, end and digits of the card numbers in runs of digits, whatever numbers stand beside them.

    A run is first read as the tool reads it, as long as a card may be; where the check digit
    fails, and in what is left, shorter groupings are tried: printed forms and issued numbers
    first. Other entities (others, in order and apart) end a run.
    """
    starts, ends = [a for a, _ in others], [b for _, b in others]
    for run in _RUN.finditer(text):
        groups = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer(r"\d+", run[0])]
        near = others[bisect_right(ends, run.start()) : bisect_left(starts, run.end())]
        free = [not any(a < y and b > x for x, y in near) for a, b in groups]
        tried = []
        for i in range(len(groups)):
            digits = ""
            for j in range(i, len(groups)):
                digits += text[groups[j][0] : groups[j][1]]
                if len(digits) > 19:
                    break
                if len(digits) < 13 or not luhn(digits):
                    continue
                longest = i == 0 and (j + 1 == len(groups) or len(digits) + groups[j + 1][1] - groups[j + 1][0] > 19)
                shape = i == j or tuple(b - a for a, b in groups[i : j + 1]) in _PRINTED
                issued = bool(_ISSUED.match(digits))
                if (longest or shape or issued) and (longest or all(free[i : j + 1])):
                    tried.append((not (shape and issued), not longest, not shape, -len(digits), i, j, digits))
        used: set[int] = set()
        for *_, i, j, digits in sorted(tried):
            if used.isdisjoint(range(i, j + 1)):
                used.update(range(i, j + 1))
                yield groups[i][0], groups[j][1], digits


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of every entity, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    if _ANY(text):
        at = text.find("@")
        while at >= 0:
            left, right = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
            if left and right:
                start = left.start() + len(left[0]) - len(left[0].lstrip(".-%+"))
                if start < at:
                    found.append((start, right.end(), "email", text[start : right.end()].lower()))
            at = text.find("@", at + 1)
        for m in _DIGITS.finditer(text):
            kind, x = m.lastgroup, m[0]
            digits = re.sub(r"\D", "", x)
            if kind == "ip":
                if any(int(p) > 255 for p in x.split(".")):
                    continue
                norm = ".".join(str(int(p)) for p in x.split("."))
            elif kind == "phone":
                if not 7 <= len(digits) <= 15:
                    continue
                norm = ("+" if x[0] == "+" else "") + digits
            else:
                norm = digits
            found.append((m.start(), m.end(), kind, norm))
        others = [(a, b) for a, b, kind, _ in found if kind != "email"]
        found += [(a, b, "card", digits) for a, b, digits in cards(text, others)]
        for m in _ACCOUNT.finditer(text):
            norm = m[0].replace(" ", "")
            if iban(norm):
                found.append((m.start(), m.end(), "account", norm))
    if any(t in text for t in TITLES):
        for m in _NAME.finditer(text):
            name = m[3].removesuffix(".")  # the dot may end the sentence
            found.append((m.start(3), m.start(3) + len(name), "name", f"{TITLES[m[1]]}:{' '.join(name.split()).casefold()}"))
    kept = apart(found)
    named = [f for f in kept if f[2] == "name"]
    return apart(kept + again(text, named)) if named else kept


def apart(found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Entities in order; of overlapping ones the first, the longer, cards last."""
    kept, end = [], 0
    for f in sorted(found, key=lambda f: (f[0], f[2] == "card", -f[1])):
        if f[0] >= end:
            kept.append(f)
            end = f[1]
    return kept


def name_parts(text: str, start: int, end: int, gender: str) -> list[tuple[int, int, str, str, str]]:
    """Start, end, kind (part or initial), normal form and role of the parts of a name; particles stay."""
    spaced = list(re.finditer(r"[^\x20]+", text[start:end]))
    while len(spaced) > 1 and spaced[-1][0].rstrip(".").casefold() in SUFFIXES:
        spaced.pop()
    last = start + spaced[-1].start() if spaced else end
    out = []
    for m in _PARTS(text, start, end):
        word = m[0].rstrip(".")
        if m.start() > last and word.casefold() in SUFFIXES:
            continue
        kind = "initial" if len(word) == 1 or m[0] != word else "part"
        out.append((m.start(), m.start() + len(word), kind, word.casefold(), ROLES["s" if m.start() >= last else gender]))
    return out


def again(text: str, named: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Mentions without a title of the surnames among named, with given names of theirs before them, and of given names alone.

    Names that are WORDS are left where a sentence begins, for there any word has a capital.
    """
    surnames: dict[str, str] = {}
    given: dict[str, str] = {}
    for start, end, _, norm in named:
        for a, b, kind, part, role in name_parts(text, start, end, norm[0]):
            if kind == "part" and role == ROLES["s"] and b - a > 2:
                surnames.setdefault(part, norm[0])
            elif kind == "part" and b - a > 2:
                given.setdefault(part, norm[0])
    taken = {x for start, end, _, _ in named for x in range(start, end)}
    found, first = [], None

    def alone() -> None:
        if first and first[0] not in taken and not plain(first[0], text[first[0] : first[1]]):
            found.append((first[0], first[1], "name", f"{given[text[first[0] : first[1]].casefold().rpartition(' ')[2]]}:{text[first[0] : first[1]].casefold()}"))

    def plain(at: int, word: str) -> bool:
        return word.casefold() in WORDS and bool(_OPENS.search(text, max(0, at - 8), at))

    for m in _CAPITALISED(text):
        word = m[0].casefold()
        joined = bool(first) and text[first[1] : m.start()] == " "
        if word in surnames and (joined or not plain(m.start(), word)):
            if not joined:
                alone()
            start = first[0] if joined else m.start()
            found.append((start, m.end(), "name", f"{surnames[word]}:{text[start : m.end()].casefold()}"))
            first = None
        elif word in given and joined:
            first = (first[0], m.end())
        else:
            alone()
            first = (m.start(), m.end()) if word in given else None
    alone()
    return found


def expand(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str, str]]:
    """What is replaced: the entities that find gives, names part by part, with the parts' roles."""
    return [x for a, b, kind, norm in found for x in (name_parts(text, a, b, norm[0]) if kind == "name" else [(a, b, kind, norm, "")])]


class Stream:
    """Numbers drawn from a keyed hash of (kind, normal form, attempt)."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.n, self.pool = "\0".join(map(str, parts)).encode(), 0, b""
        self.key = key[:64]

    def draw(self, below: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % below

    def letter(self, c: str) -> str:
        """A letter or digit of the same script and case."""
        if c.isdigit() and c.isascii():
            return str(self.draw(10))
        for first, last in ("az", "AZ", "αω", "ΑΩ", "ая", "АЯ", "あん", "アン", "一龥", "가힣", "את", "بي"):
            if first <= c <= last:
                return chr(ord(first) + self.draw(ord(last) - ord(first) + 1)) if (first, last) != ("Α", "Ω") else "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"[self.draw(24)]
        if c.isalpha():
            return chr(ord("a") + self.draw(26)) if c.islower() else chr(ord("A") + self.draw(26)) if c.isupper() else c
        return c


def next_letter(key: bytes, c: str) -> str:
    """The letter after c in a keyed ring of its alphabet: different letters stay different, and none stays as it is."""
    for first, last in ("az", "ая", "αω"):
        if first <= c <= last:
            ring = sorted(map(chr, range(ord(first), ord(last) + 1)), key=lambda x: hashlib.blake2b(x.encode(), key=key[:64]).digest())
            return ring[ring.index(c) - 1]
    return Stream(key, "initial", c, 0).letter(c)


#: Attempts in the form and length of the entity; later ones have a character more each.
SAME_LENGTH = {"email": 2, "phone": 8, "ip": 24, "card": 8, "account": 8, "ssn": 8}


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0, role: str = "") -> str:
    """The surrogate in normal form; surface() gives it a mention's format.

    The space to draw from grows with the attempt, so any set of entities gets distinct ones:
    names by a syllable each, the others, once their own form has been tried, in length.
    role: of a name's part, as in ROLES.
    """
    if kind == "initial":
        return "".join(next_letter(key, c) for c in norm)
    s = Stream(key, kind, norm, attempt)
    more = max(0, attempt - SAME_LENGTH.get(kind, 0))
    digits = lambda n: "".join(str(s.draw(10)) for _ in range(n))
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        d = Stream(key, "domain", domain, 0)
        *labels, top = domain.split(".")
        return "".join(map(s.letter, local + "a" * more)) + "@" + ".".join(["".join(map(d.letter, x)) for x in labels] + [top])
    if kind == "ip":
        return ".".join(str(1 + s.draw(254)) for _ in range(4 + more))
    if kind == "card":
        body = norm[0] + digits(len(norm) - 2 + more)
        return next(body + str(c) for c in range(10) if luhn(body + str(c)))
    if kind == "phone":
        keep = 0 if norm[0] != "+" else 2 if norm[1] in "17" else 3
        return norm[:keep] + digits(len(norm) - keep + more)
    if kind == "ssn":
        return str(900 + s.draw(100)) + digits(6 + more)  # never issued
    if kind == "account":
        body = "".join(map(s.letter, norm[4:] + "0" * more))
        check = 98 - int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return norm[:2] + f"{check:02d}" + body
    script = "cyrillic" if "а" <= norm[0] <= "я" or norm[0] == "ё" else "latin"
    gender = {"1": "f", "2": "m", "3": "mf"[s.draw(2)]}.get(role, "")
    if gender and not attempt:
        pool = GIVEN[script, gender]
        return pool[s.draw(len(pool))].casefold()
    made = "".join(SYLLABLES[script][s.draw(len(SYLLABLES[script]))] for _ in range((2 if gender else 3) + attempt))
    if script == "cyrillic":
        feminine = gender == "f" or not gender and norm[-1] in "ая"
        return made + ("на" if feminine else "н") if gender else made + ("ва" if feminine else "в")
    return made + {"f": "na", "m": "n", "": ""}[gender]


def surface(kind: str, mention: str, made: str) -> str:
    """A surrogate in the format of the mention it replaces."""
    if kind in ("part", "initial"):
        return made.upper() if mention.isupper() and (len(mention) > 1 or len(made) == 1) else made.capitalize()
    if kind == "email":
        return made.upper() if mention.isupper() else "".join(b.upper() if a.isupper() else b for a, b in zip(mention, made)) if len(mention) == len(made) else made
    if kind == "ip":
        return made
    take = iter(made.lstrip("+"))
    return "".join([next(take, c) if c.isalnum() else c for c in mention] + list(take))


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, norm) over all whole texts, with the first of their roles and whether there are more."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0) if t.is_valid]
            seen = {(kind, norm, role) for t in texts for _, _, kind, norm, role in expand(t, find(t)) if kind != "initial"}
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in range(3)], ["kind", "norm", "role"])

    found = docs.select("text").mapInArrow(scan, "kind string, norm string, role string")
    return found.groupBy("kind", "norm").agg(F.min("role").alias("role"), (F.min("role") != F.max("role")).alias("mixed"))


def with_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    @F.pandas_udf("string")
    def made(kind, norm, attempt, role):
        import pandas as pd

        return pd.Series([surrogate(key, *x) for x in zip(kind, norm, attempt, role)], dtype=object)

    return found.withColumn("made", made("kind", "norm", "attempt", "role"))


def settled(found: DataFrame, key: bytes) -> DataFrame:
    """kind, norm, role, mixed, attempt, made with no two entities alike and none that the corpus holds.

    Every round is written; the rounds end as the losers draw from a space that grows each time.
    """
    state = cut(with_surrogates(found.withColumn("attempt", F.lit(0)), key), "surrogates")
    columns = [c for c in state.columns if c != "made"]
    while True:
        first = state.groupBy("kind", "made").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count("*").alias("n"))
        shared = first.where("n > 1").select("kind", "made", F.col("first.norm").alias("keeps"))
        real = state.select("kind", F.col("norm").alias("made"), F.lit("").alias("keeps"))
        taken = shared.unionByName(real.join(state.select("kind", "made"), ["kind", "made"], "left_semi")).groupBy("kind", "made").agg(F.min("keeps").alias("keeps"))
        lost = state.join(taken, ["kind", "made"]).where("norm <> keeps").select("kind", "norm")
        lost = cut(lost, "collisions")
        if lost.isEmpty():
            return state
        redraw = state.join(lost, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1).select(columns)
        state = cut(state.join(lost, ["kind", "norm"], "left_anti").select(*columns, "made").unionByName(with_surrogates(redraw, key)), "surrogates")


MADE = "array<struct<kind:string,norm:string,made:string>>"


_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession, default: bytes | None = None) -> bytes:
    """The session's key, else default, else one drawn for this application, so that no known key is ever used unasked.

    With a drawn key another application gives other surrogates; a warning says so.
    """
    key = spark.conf.get(KEY_SETTING, "").encode() or default
    if not key:
        if spark.sparkContext.applicationId not in _drawn:
            logging.getLogger(__name__).warning("%s is not set: surrogates follow a key drawn for this application alone", KEY_SETTING)
        key = _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))
    return key


def replace_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with surrogates in text, plus pii_spans: array of kind:start:end in the old text."""
    return swapped(docs, key, "pii_spans")


def swapped(docs: DataFrame, key: bytes | None, spans_name: str | None) -> DataFrame:
    """As replace_pii, under another name for the spans (which replace a column of that name), or without them."""
    prepared(docs.sparkSession)
    spark = docs.sparkSession
    key = session_key(spark) if key is None else key
    # entities whose surrogate does not follow from a mention alone
    odd = settled(cut(entities(docs), "entities"), key).where("attempt > 0 OR mixed").select("kind", "norm", "made")
    n = odd.count()
    own_name, done_name = fresh(docs.columns, "pii_own"), fresh(docs.columns, "pii_swap")
    if n <= BROADCAST_ENTITIES:
        known = spark.sparkContext.broadcast({(r["kind"], r["norm"]): r["made"] for r in odd.collect()})
        rows = docs.withColumn(own_name, F.lit(None).cast(MADE))
    else:
        known = spark.sparkContext.broadcast({})
        rows = _with_own(docs, odd, own_name)

    @F.pandas_udf("struct<text:string,spans:array<string>>")
    def swap(texts, owns):
        import pandas as pd

        out, spans = [], []
        for text, more in zip(texts, owns):
            if text is None or text != text:
                out.append(None)
                spans.append([])
                continue
            own = {(x["kind"], x["norm"]): x["made"] for x in more} if more is not None else known.value
            found = find(text)
            parts, at = [], 0
            for start, end, kind, norm, role in expand(text, found):
                made = own.get((kind, norm)) or surrogate(key, kind, norm, 0, role)
                parts += [text[at:start], surface(kind, text[start:end], made)]
                at = end
            out.append("".join([*parts, text[at:]]) if parts else text)
            spans.append([f"{kind}:{start}:{end}" for start, end, kind, _ in found])
        return pd.DataFrame({"text": pd.Series(out, dtype=object), "spans": spans})

    done = rows.withColumn(done_name, swap("text", own_name))
    kept = [F.col(done_name)["text"].alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != spans_name]
    return done.select(*kept, *[F.col(done_name)["spans"].alias(x) for x in (spans_name,) if x])


def _with_own(docs: DataFrame, odd: DataFrame, own_name: str) -> DataFrame:
    """Where too many surrogates would have to be sent round: each text's own, joined."""

    @F.pandas_udf("array<struct<kind:string,norm:string>>")
    def mentioned(texts):
        import pandas as pd

        return pd.Series([[{"kind": k, "norm": n} for k, n in {(f[2], f[3]) for f in expand(t, find(t))}] if isinstance(t, str) else [] for t in texts])

    h = fresh(docs.columns, "pii_hash")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    own = keyed.select(h, F.explode(mentioned("text")).alias("m")).select(h, "m.kind", "m.norm").distinct().join(odd, ["kind", "norm"])
    per_text = own.groupBy(h).agg(F.collect_list(F.struct("kind", "norm", "made")).alias(own_name))
    return keyed.join(per_text, h, "left").withColumn(own_name, F.coalesce(own_name, F.array().cast(MADE))).drop(h)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark, DEMO_KEY))
    return done.select("doc_id", "text", F.size("pii_spans").alias("n_entities"), F.array_join("pii_spans", ",").alias("spans"))
