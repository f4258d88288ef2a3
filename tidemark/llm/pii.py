"""Personal data: overlapping candidates from wide patterns, scored by boosted trees, beside a fixed base of strict patterns.

Everything on a document's way is a DataFrame function. The trees are fitted on EXAMPLES labelled texts that are written by rule from a fixed seed, in families
of forms (bracketed, worded, spaced, in other languages, ...) and of look-alikes. Their features are found by the same functions that score documents.
Each kind's threshold is calibrated on families that the trees have not seen: the lowest that keeps PRECISION. After that the trees are fitted again on all
families. No document is learnt from: none is labelled, and what a corpus holds must not teach the trees to pass over it. So a text has one result, in
whatever corpus it stands, and a model can be stored once and opened ever after.

Base spans stay whatever the trees say; a candidate is added if its probability reaches its kind's threshold and it
overlaps no base span.

Defined results: null text is empty and has no spans; spans are in code points, end exclusive; matches of a kind never
overlap each other; repeated rows get equal results; an empty table gives an empty result; columns other than the id and
the text are never read.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, fit
from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
# The possessive quantifiers and the look-behinds change no match: a match can only start where its run of characters does, or
# where the match before ended (\G). They keep the search linear and off the stack in very long texts.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for its kind's pattern to be worth a search.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
_OPEN, _SHUT = r"\x20?[\[({<]\x20?", r"\x20?[\])}>]\x20?"
_AT_WORD, _DOT_WORD = "(?:at|At|AT|arroba|ARROBA)", "(?:dot|Dot|DOT|punto|PUNTO|punkt|Punkt|PUNKT|point|POINT)"
_AT = rf"(?:\x20?@\x20?|{_OPEN}(?:{_AT_WORD}|@){_SHUT}|\x20{_AT_WORD}\x20)"
_DOT = rf"(?:\.|\x20\.\x20?|{_OPEN}(?:{_DOT_WORD}|\.){_SHUT}|\x20{_DOT_WORD}\x20)"
#: A word, or letters with a space after each.
_NAME, _HOST = r"(?:[A-Za-z0-9_](?:\x20[A-Za-z0-9_]){2,30}|[A-Za-z0-9_%+-]{1,64})", r"(?:[A-Za-z0-9](?:\x20[A-Za-z0-9]){2,30}|[A-Za-z0-9-]{1,63})"
_LETTERS = r"(?:[A-Za-z](?:\x20[A-Za-z]){1,5}(?![A-Za-z])|[A-Za-z0-9-]{1,63})"
_HEX = "[0-9A-Fa-f]{1,4}"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:{_DOT}{_NAME}){{0,3}}{_AT}{_HOST}(?:{_DOT}{_LETTERS}){{1,4}}",
    "ip": rf"(?<![0-9A-Za-z:.])(?:[0-9]{{1,3}}(?:(?:{_DOT}|{_OPEN}\.{_SHUT})[0-9]{{1,3}}){{3}}|(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}:(?:{_HEX}(?::{_HEX}){{0,5}})?|::{_HEX}(?::{_HEX}){{0,6}})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9](?:[\x20\t./_,–-]{0,3}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+\x20?|00)?[(]?[0-9](?:[\x20()./–-]{0,3}[0-9]){6,14}(?![0-9])",
}
WIDE_NEEDS = {
    "email": rf"{_AT}{_HOST}{_DOT}[A-Za-z0-9-]",
    "ip": rf"[0-9](?:{_DOT})[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f:]|::[0-9A-Fa-f]",
    "card": r"[0-9](?:[\x20\t./_,–-]{0,3}[0-9]){11}",
    "phone": r"[0-9](?:[\x20()./–-]{0,3}[0-9]){6}",
}
#: Examples that are written.
EXAMPLES = 6000
PRECISION = 0.9
#: No threshold is below this, whatever the precision.
FLOOR = 0.2
_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(steps: Column, n: Column) -> Column:
    """Sums of all steps before each: by blocks, so that many matches in one text cost little more than one pass."""
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int"))
    add = lambda own: F.aggregate(own, F.lit(0), lambda a, b: a + b)
    sums = F.transform(blocks, lambda b: add(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))
    before = let(sums, lambda s: F.transform(F.sequence(F.lit(1), F.size(s)), lambda b: add(F.slice(s, F.lit(1), b - 1))))
    return let(
        before,
        lambda p: F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda i: F.element_at(p, F.floor(i / _BLOCK).cast("int") + 1)
            + add(F.slice(steps, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)),
        ),
    )


_SPAN = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


#: What a text must have for any number: a digit, or the colons of an address that has none. Looked for once, for six patterns.
DIGITS = "[0-9]|::"


def matches(text: Column, pattern: str, needs: str, worth: Column | None = None) -> Column:
    """All matches: start, end, the match and what stands around it. The pieces between matches give the places.

    ``worth`` tells beforehand where a search is worth while.
    """

    def places(v: Column) -> Column:
        n = F.size(v["found"])
        gaps = F.transform(v["pieces"], lambda p: F.length(p))
        sizes = F.transform(v["found"], lambda p: F.length(p))
        steps = F.zip_with(F.slice(gaps, F.lit(1), n), sizes, lambda g, m: g + m)
        spans = let(
            F.struct(gaps.alias("gaps"), sizes.alias("sizes"), steps.alias("steps")),
            lambda w: let(
                _running(w["steps"], n),
                lambda sums: F.transform(
                    F.sequence(F.lit(1), n),
                    lambda i: F.struct(
                        (F.element_at(sums, i) + F.element_at(w["gaps"], i)).alias("start"),
                        (F.element_at(sums, i) + F.element_at(w["steps"], i)).alias("end"),
                        F.element_at(v["found"], i).alias("s"),
                        F.right(F.element_at(v["pieces"], i), F.lit(40)).alias("before"),
                        F.left(F.element_at(v["pieces"], i + 1), F.lit(8)).alias("after"),
                    ),
                ),
            ),
        )
        return F.when(n > 0, spans.cast(_SPAN)).otherwise(F.array().cast(_SPAN))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    useful = text.contains(needs) if needs == "@" else text.rlike(needs)
    return F.when(useful if worth is None else worth & useful, let(both, places)).otherwise(F.array().cast(_SPAN))


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check; strings of up to 19 digits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0)


def _octet() -> str:
    return r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def is_base(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_octet()}(?:\.{_octet()}){{3}}$")
    if kind == "card":
        return let(digits_of(s), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(digits_of(s)).between(9, 15)
    return F.lit(True)


#: Words before a span that speak for its kind, and words that speak against any.
FOR = {
    "email": r"mail|contact|write|reach|correo|courriel|schreib|escrib|adresse",
    "ip": r"\bip\b|host|server|address|login|connect|client|servidor|serveur",
    "card": r"card|visa|master|amex|credit|debit|karte|tarjeta|carte|payment",
    "phone": r"phone|\btel|call|fax|mobile|cell|whatsapp|\bsms|anruf|llam|appel|handy|m[oó]vil",
}
AGAINST = r"order|invoice|version|isbn|issn|\bids?\b|\bno\.|page|licen[sc]e|token|\bref|serial|total|price|date|year|chapter|hash|sku|build|release|section|copyright|\bdoi\b|time|\bat\b"
#: Last labels that end names of hosts more often than sentences.
ENDINGS = r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|at|ch|us|ca|br|mx|ar|pl|se|biz|dev|app)$"


def features(kind: int, c: Column) -> Column:
    """Format and context of a candidate, as an array of numbers."""
    s, before, after = c["s"], F.lower(c["before"]), c["after"]
    flag = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    count = lambda x: x.cast("double")

    def table(v: Column) -> Column:
        d, groups = v["d"], v["groups"]
        size = lambda g: F.coalesce(F.length(g), F.lit(0))
        return F.array(
            F.lit(float(kind)),
            count(F.length(d)),
            count(F.length(s)),
            count(F.length(F.regexp_replace(s, "[0-9A-Za-z]", ""))),
            count(F.length(F.regexp_replace(s, "[^A-Za-z]", ""))),
            flag(luhn(d)) if KINDS[kind] == "card" else F.lit(0.0),
            flag(before.rlike(FOR[KINDS[kind]])),
            flag(F.right(before, F.lit(16)).rlike(AGAINST)),
            flag(before.rlike(r"[\p{L}0-9._/#$@:=\[\"-]$")),
            flag(after.rlike(r"^(?:[\p{L}0-9/_%@\"]|[.:-][0-9])")),
            count(F.size(groups)),
            count(F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0))),
            count(F.coalesce(F.array_min(F.transform(groups, lambda g: F.length(g))), F.lit(0))),
            count(size(F.try_element_at(groups, F.lit(1)))),
            count(size(F.try_element_at(groups, F.lit(2)))),
            count(size(F.try_element_at(groups, F.lit(-1)))),
            flag(F.startswith(d, F.lit("0"))),
            flag(s.rlike(r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)?[0-9]{2})")),
            flag(s.rlike(r"^(?:\+|00|\()")),
            flag(s.rlike(rf"@|{_OPEN}(?:{_AT_WORD}|{_DOT_WORD}|\.){_SHUT}")),
            flag(s.rlike(rf"^{_octet()}(?:[^0-9]+{_octet()}){{3}}$")),
            flag(s.rlike("::|^(?:[^:]*:){7}[^:]*$")),
            flag(s.rlike(ENDINGS)),
            count(F.size(F.regexp_extract_all(s, F.lit(rf"\x20(?:{_AT_WORD}|{_DOT_WORD})\x20"), F.lit(0)))),
            flag(s.rlike(r"[A-Za-z]\x20[A-Za-z]\x20[A-Za-z]")),
            count(F.size(F.array_distinct(F.regexp_extract_all(s, F.lit("[^0-9A-Za-z]+"), F.lit(0))))),
            count(F.length(F.regexp_replace(s, "[^/.–_,-]", ""))),
        )

    return let(F.struct(digits_of(s).alias("d"), F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)).alias("groups")), table)


NEAR = {
    0: ["email me: ", "contact ", "write to ", "mail ", "Schreib an ", "correo: "],
    1: ["host ", "server address ", "IP ", "login from ", "client ", "connect to "],
    2: ["card ", "visa no ", "credit card: ", "Karte ", "payment with ", "tarjeta "],
    3: ["call ", "tel ", "phone: ", "my mobile ", "fax ", "Handy ", "whatsapp "],
}
FAR = ["order ", "invoice ", "version ", "ISBN ", "id ", "total ", "page ", 'token = "', "ref ", "on ", "time ", "#", "build ", "serial ", "price ", "section "]


def _families(r: random.Random) -> tuple[dict[int, list], dict[int, list]]:
    """Makers of personal forms and of look-alikes by kind; every third family is held out for calibration."""
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    pick = r.choice
    name = lambda: "".join(pick(["ma", "ri", "jo", "le", "an", "to", "ber", "sch", "el", "ka", "nn", "st"]) for _ in range(r.randint(1, 3)))
    word = lambda: "".join(pick(["the", "on", "er", "la", "un", "de", "tion", "est", "an", "ou", "ing", "re"]) for _ in range(r.randint(1, 3)))
    end = lambda: pick(["com", "org", "de", "fr", "net", "io", "es", "co", "edu"])
    user = lambda: pick([name, lambda: f"{name()}_{name()}", lambda: f"{name()}{r.randint(1, 99)}", lambda: f"{name()}-{name()}"])()
    octets = lambda: [str(r.choice([r.randint(1, 255), r.randint(1, 255), 10, 0, 192])) for _ in range(3)] + [str(r.randint(1, 254))]
    group16 = lambda: f"{r.randint(1, 65535):x}"
    spaced = lambda t: " ".join(t)

    def card(good: bool, n: int = 16) -> str:
        d = [int(x) for x in pick("45" if n == 16 else "3") + digits(n - 2)]
        check = -sum(x if (i - n) % 2 else (2 * x - 9 * (x > 4)) for i, x in enumerate(d)) % 10
        d.append(check if good else (check + r.randint(1, 9)) % 10)
        return "".join(map(str, d))

    def parted(t: str, by: str, sizes: tuple = (4, 4, 4, 4)) -> str:
        out, i = [], 0
        for n in sizes:
            out.append(t[i : i + n])
            i += n
        return by.join(x for x in out if x)

    personal = {
        0: [
            lambda: f"{user()}{pick(['(at)', ' (at) ', '[at]', ' [at] ', ' [AT] '])}{name()}.{end()}",
            lambda: f"{user()} at {name()} dot {end()}",
            lambda: f"{user()} AT {name()} DOT {end()}",
            lambda: f"{user()} (at) {name()} (dot) {end()}",
            lambda: f"{user()} {pick(['arroba', 'ARROBA'])} {name()} {pick(['punto', 'PUNTO'])} {end()}",
            lambda: f"{user()} {pick(['at', 'AT', '@'])} {name()} {pick(['punkt', 'PUNKT', 'Punkt', 'point'])} {end()}",
            lambda: f"{user()} @ {name()} . {end()}",
            lambda: f"{spaced(name())} @ {pick([name(), spaced(name())])} . {pick([end(), spaced(end())])}",
            lambda: f"{user()}{{at}}{name()}{{dot}}{end()}",
            lambda: f"{name()} (dot) {name()} (at) {name()} (dot) {end()}",
            lambda: f"{name()}[dot]{name()}[at]{name()}[dot]{end()}",
            lambda: f"{name()} dot {name()} at mail{r.randint(1, 9)} dot {name()} dot {end()}",
            lambda: f"{user()}<at>{name()}.{end()}",
            lambda: f"{user()} [@] {name()} [.] {end()}",
            lambda: f"{user()}@{name()} . {end()}",
        ],
        1: [
            lambda: ":".join(group16() for _ in range(8)),
            lambda: "[.]".join(octets()),
            lambda: " . ".join(octets()),
            lambda: "(dot)".join(octets()),
            lambda: f"fe80::{group16()}:{group16()}",
            lambda: "[dot]".join(octets()),
            lambda: " dot ".join(octets()),
            lambda: f"2001:{group16()}:{group16()}::{r.randint(1, 99)}",
            lambda: f"fe80::{':'.join(group16() for _ in range(4))}",
            lambda: "(.)".join(octets()),
            lambda: f"{'.'.join(octets()[:3])}[.]{r.randint(1, 254)}",
            lambda: f"fd{r.randint(16, 255):x}:{group16()}::{group16()}:{group16()}",
        ],
        2: [
            lambda: parted(card(True), "."),
            lambda: parted(card(True), "  "),
            lambda: parted(card(True), "/"),
            lambda: parted(card(True), "_"),
            lambda: parted(card(True), " - "),
            lambda: parted(card(True), "–"),
            lambda: parted(card(True, 15), pick([".", " - ", "/"]), (4, 6, 5)),
            lambda: parted(card(True), ", "),
            lambda: parted(card(True), " . "),
        ],
        3: [
            lambda: f"({digits(3)}) {digits(3)}-{digits(4)}",
            lambda: f"{pick('23456789')}{digits(2)}-{digits(3)}-{digits(4)}",
            lambda: f"00{pick(['49', '33', '34', '44'])} {digits(3)} {digits(7)}",
            lambda: f"0{digits(2)}/{digits(7)}",
            lambda: f"{pick('23456789')}{digits(2)}.{digits(3)}.{digits(4)}",
            lambda: f"0{pick('1234567')} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            lambda: f"+ {pick(['1', '49', '33'])} {digits(3)} {digits(7)}",
            lambda: f"07{digits(3)} {digits(6)}",
            lambda: f"(0{digits(2)}) {digits(6)}",
            lambda: f"1-800-{digits(3)}-{digits(4)}",
            lambda: f"0{digits(3)} {digits(3)} {digits(3)}",
            lambda: f"01{pick('567')}{digits(1)}-{digits(8)}",
            lambda: f"{pick('679')}{digits(2)} {digits(3)} {digits(3)}",
            lambda: f"0{digits(3)}-{digits(6)}",
            lambda: f"({digits(3)}){digits(3)}.{digits(4)}",
        ],
    }
    other = {
        0: [
            lambda: f"{word()} at {word()} dot {word()}",
            lambda: f"{word()} at {word()}.{word()}",
            lambda: f"{word()} at {word()}. {word()}",
            lambda: f"{word()} arroba {word()}.{word()}",
            lambda: f"{digits(1)} @ {digits(1)}.{digits(2)}",
            lambda: f"{word()} at {word()} . {word()}",
            lambda: f"{word()} (at) {word()}.{word()}",
            lambda: f"{word()} at {word()} point {word()}",
            lambda: f"{digits(2)} at {digits(2)}.{digits(1)}",
        ],
        1: [
            lambda: " . ".join(str(r.randint(256, 999)) for _ in range(4)),
            lambda: " . ".join(str(r.randint(1, 9)) for _ in range(4)),
            lambda: f"{pick(['face', 'add', 'bad', 'dead'])}::{pick(['feed', 'cafe', 'bed', 'fade'])}",
            lambda: "[.]".join(str(r.randint(256, 999)) for _ in range(4)),
            lambda: f"::{pick(['add', 'face', 'feed', 'decade'[:4]])}",
            lambda: f"{r.randint(1, 9)} dot {digits(1)} dot {digits(1)} dot {digits(3)}",
        ],
        2: [
            lambda: parted(card(False), pick([".", "/", "_"])),
            lambda: parted(card(False), pick([" - ", "  ", "–", ", "])),
            lambda: digits(pick([12, 13, 14, 17, 19])),
            lambda: f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
            lambda: card(False),
            lambda: ", ".join(digits(r.randint(1, 3)) for _ in range(7)),
            lambda: f"{digits(1)}.{digits(15)}",
            lambda: "/".join([digits(2), digits(2), digits(4)]) + " " + "/".join([digits(2), digits(2), digits(4)]),
            lambda: parted(card(False), " . "),
        ],
        3: [
            lambda: f"20{digits(2)}-0{r.randint(1, 9)}-1{digits(1)} 1{digits(1)}",
            lambda: f"1{digits(1)}/0{r.randint(1, 9)}/20{digits(2)}",
            lambda: digits(pick([7, 8, 9, 10, 11, 12, 14])),
            lambda: f"{digits(1)}.{digits(3)}.{digits(3)}",
            lambda: f"20{digits(2)} 20{digits(2)} 19{digits(2)}",
            lambda: card(True)[:15],
            lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
            lambda: f"{digits(1)} {digits(3)} {digits(3)}",
            lambda: f"{digits(2)}.{digits(4)} {digits(2)}.{digits(4)}",
            lambda: f"0-{digits(3)}-{digits(5)}-{digits(1)}",
            lambda: " ".join(digits(1) for _ in range(r.randint(7, 12))),
            lambda: f"{digits(2)}.{digits(2)}.{digits(4)} {digits(2)}",
            lambda: "-".join(digits(2) for _ in range(5)),
            lambda: f"{digits(5)}-{digits(5)}",
            lambda: f"{digits(4)}/{digits(4)}",
        ],
    }
    return personal, other


@dataclass(frozen=True)
class Example:
    text: str
    start: int
    end: int
    kind: int
    label: int
    held_out: bool


def examples(n: int = EXAMPLES, seed: int = 20) -> list[Example]:
    """Texts with one form each, by rule, among words that are made up."""
    r = random.Random(seed)
    personal, other = _families(r)
    syllables = ["the", "on", "er", "la", "un", "de", "tion", "est", "an", "ou", "wh", "ing", "en", "qu", "ra", "s", "ci", "é", "ä", "ó"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    phrase = lambda: " ".join(word() for _ in range(r.randint(1, 10)))
    out = []
    for i in range(n):
        kind, good = i % len(KINDS), r.random() < 0.5
        own = (personal if good else other)[kind]
        family = r.randrange(len(own))
        made = own[family]()
        lead = phrase() + " " if r.random() < 0.8 else ""
        if good:
            lead += r.choice(NEAR[kind]) if r.random() < 0.5 else ""
        else:
            lead += r.choice(FAR) if r.random() < 0.5 else ""
        tail = "" if r.random() < 0.2 else r.choice([" ", ", ", ". ", "\n", "%%% ", "!! "]) + phrase()
        out.append(Example(lead + made + tail, len(lead), len(lead) + len(made), kind, int(good), family % 3 == 2))
    return out


@dataclass(frozen=True)
class Model:
    trees: Trees
    thresholds: tuple[float, ...]


def candidates(text: Column, kind: int, numbers: Column | None = None) -> Column:
    return matches(text, WIDE[KINDS[kind]], WIDE_NEEDS[KINDS[kind]], None if kind == 0 else numbers)


_PLACED = "array<struct<start:int,kind:int,end:int>>"


def _placed(kind: int, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))).cast(_PLACED)


def base_spans(text: Column, numbers: Column | None = None) -> Column:
    """All base spans (start, kind, end), sorted."""

    def strict(kind: int) -> Column:
        name = KINDS[kind]
        return _placed(kind, F.filter(matches(text, BASE[name], NEEDS[name], None if kind == 0 else numbers), lambda m: is_base(name, m["s"])))

    return F.sort_array(F.concat(*map(strict, range(len(KINDS)))))


def labelled(spark: SparkSession, n: int = EXAMPLES, seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Example]]:
    """(features, label, kind, held out, example) and the examples, of all candidates outside of base spans; the table has a small row for each candidate."""
    made = examples(n, seed)
    rows = spark.createDataFrame([(i, e.text, e.start, e.end, e.kind, e.label, e.held_out) for i, e in enumerate(made)], "n long, text string, a int, b int, k int, label int, held boolean")

    def scored(kind: int) -> Column:
        of = lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), features(kind, c).alias("x"))
        free = F.filter(candidates(F.col("text"), kind), lambda c: ~F.exists("base", lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])))
        return F.transform(free, of)

    found = rows.withColumn("base", base_spans(F.col("text"))).select("n", "label", "held", "a", "b", "k", F.explode(F.concat(*map(scored, range(len(KINDS))))).alias("c"))
    hit = (F.col("c.start") < F.col("b")) & (F.col("a") < F.col("c.end")) & (F.col("c.kind") == F.col("k"))
    table = found.select("n", "held", "c.kind", "c.x", (F.col("label") * hit.cast("int")).alias("y")).orderBy("n", "c.kind", "c.start").collect()
    width = len(table[0].x) if table else 0
    x = np.array([t.x for t in table], float).reshape(len(table), width)
    return x, np.array([t.y for t in table], float), np.array([t.kind for t in table], int), np.array([t.held for t in table], bool), np.array([t.n for t in table], np.int64), made


def _fitted(x: np.ndarray, y: np.ndarray) -> Trees:
    return fit(x, y, rounds=30, depth=4)


def train(spark: SparkSession, n: int = EXAMPLES) -> Model:
    """Thresholds by trees that have not seen the held-out families, then trees that have seen all."""
    x, y, kind, held, *_ = labelled(spark, n)
    p = _fitted(x[~held], y[~held]).probabilities(x)
    thresholds = []
    for k in range(len(KINDS)):
        own, truth = p[held & (kind == k)], y[held & (kind == k)]
        good = [t for t in np.unique(own) if truth[own >= t].mean() >= PRECISION]
        thresholds.append(float(max(FLOOR, min(good, default=0.99))))
    return Model(_fitted(x, y), tuple(thresholds))


def measured(spark: SparkSession) -> dict[str, tuple[float, float, int]]:
    """By kind: precision and recall on families that neither trees nor thresholds have seen, and how many personal forms there were.

    Of the held-out families one half calibrates and the other is measured, then the other way round. A form without a candidate counts as missed.
    """
    x, y, kind, held, number, made = labelled(spark)
    p = _fitted(x[~held], y[~held]).probabilities(x)
    half = number // len(KINDS) % 2 == 0
    out = {}
    for k, name in enumerate(KINDS):
        added = right = met = 0
        for side in (half, ~half):
            own, truth = p[held & (kind == k) & ~side], y[held & (kind == k) & ~side]
            cut = max(FLOOR, min((t for t in np.unique(own) if truth[own >= t].mean() >= PRECISION), default=0.99))
            taken = held & (kind == k) & side & (p >= cut)
            added, right = added + int(taken.sum()), right + int((taken & (y > 0)).sum())
            met += len(np.unique(number[taken & (y > 0)]))
        forms = sum(e.kind == k and e.label and e.held_out for e in made)
        out[name] = (right / max(1, added), met / max(1, forms), forms)
    return out


def found(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and spans: arrays of (start, kind, end), sorted; kind is a place in KINDS."""
    span = _PLACED
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))

    def likely(kind: int) -> Column:
        def probability(c: Column) -> Column:
            return let(features(kind, c), lambda x: model.trees.column(lambda f: F.element_at(x, f + 1)))

        return _placed(kind, F.filter(candidates(F.col("text"), kind, F.col("__numbers")), lambda c: probability(c) >= model.thresholds[kind]))

    rows = rows.withColumn("__numbers", F.col("text").rlike(DIGITS))
    rows = rows.withColumn("base", base_spans(F.col("text"), F.col("__numbers")))
    rows = rows.withColumn("__likely", F.concat(*map(likely, range(len(KINDS)))))

    def free(v: Column) -> Column:
        # base spans in blocks with their bounds, so that many spans in one text are not all compared
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v["base"]) - 1) / _BLOCK).cast("int")),
            lambda b: let(
                F.slice(v["base"], b * _BLOCK + 1, F.lit(_BLOCK)),
                lambda own: F.struct(
                    own.alias("own"), F.element_at(own, 1)["start"].alias("low"), F.array_max(F.transform(own, lambda s: s["end"])).alias("high")
                ),
            ),
        )
        return let(
            blocks,
            lambda all_: F.filter(
                v["likely"],
                lambda c: ~F.exists(
                    all_,
                    lambda b: (b["low"] < c["end"])
                    & (b["high"] > c["start"])
                    & F.exists(b["own"], lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])),
                ),
            ),
        )

    added = (
        F.when(F.size("__likely") == 0, F.array().cast(span))
        .when(F.size("base") == 0, F.col("__likely"))
        .otherwise(let(F.struct(F.col("base"), F.col("__likely").alias("likely")), free))
    )
    return rows.withColumn("spans", F.sort_array(F.concat("base", added))).drop("__likely", "__numbers")


#: The model of this process.
_MODELS: list[Model] = []


def model_of(spark: SparkSession, path: str | None = None) -> Model:
    """The model: opened from ``path`` if it is stored there, else fitted, once for each process, and stored there if a path is given."""
    if path is not None and (own := _stored(spark, path)) is not None:
        return own
    if not _MODELS:
        _MODELS.append(train(spark))
    if path is not None:
        row = (json.dumps(_MODELS[0].trees.told()), list(_MODELS[0].thresholds))
        spark.createDataFrame([row], "trees string, thresholds array<double>").coalesce(1).write.mode("errorifexists").parquet(path)
    return _MODELS[0]


def _stored(spark: SparkSession, path: str) -> Model | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    row = spark.read.parquet(path).head()
    return Model(Trees.of(json.loads(row.trees)), tuple(row.thresholds))


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    spans = found(docs, model or model_of(docs.sparkSession), id_col, text_col)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return spans.select(
        "doc_id",
        *map(count, range(len(KINDS))),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id and the text with each span replaced by its kind in square brackets; of overlapping spans the first counts."""
    spans = found(docs, model or model_of(docs.sparkSession), id_col, text_col)
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    cut = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1)),
    )
    return spans.select("doc_id", cut.alias("text"))
