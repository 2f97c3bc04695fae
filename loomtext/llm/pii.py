"""Personal information in free text by weak supervision (problem 1).

Candidates for each kind come from wide patterns. Labelers (patterns, a gazetteer, context)
vote for or against a candidate or abstain; expectation-maximisation over a bounded sample of
chunks estimates how reliable each labeler is and gives every candidate a probability.
A logistic span classifier is trained on these probabilities, over the votes, the shape of the
candidate, its words and its neighbours; it decides for all chunks. Lexicons of common words and
of given and family names, which are induced since the gazetteer is incomplete, rest on counts
over all chunks.
"""

from __future__ import annotations

import math
import pickle
import re
from array import array
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomtext.llm.lexicon import ALL_FUNCTION_WORDS
from loomtext.plans.lineage import broadcast_if_small, hash_sample, materialize, small_rows

KINDS = ["email", "phone", "identity", "address", "name"]
#: Chunks, chosen by hash, that come to the driver to estimate the labelers and train the classifier.
TRAIN_CHUNKS = 12_000
#: A gazetteer of more names than this is first cut down, by a join, to the names that occur in the texts.
MAX_NAMES = 200_000
#: Words a counted lexicon may have at most; every worker holds them, and more of them are refused.
MAX_WORDS = 1_000_000
#: Different records that a task counts before it passes them on.
MAX_COUNTED = 200_000
DIM = 1 << 15

# ---------------------------------------------------------------- patterns
_UP = "A-ZÀ-ÖØ-Þ"
#: A letter of a name, also where its encoding is damaged.
_LET = r"(?:[^\W\d_]|[\u0080-\u00bf\u2013-\u203a\u20ac\u2122ŒœŠšŽžŸƒˆ˜�'’])"
_CAP = rf"[{_UP}]{_LET}+(?:-[{_UP}]{_LET}+)*"
_INI = rf"[{_UP}](?:\u0089|‰|�)?\."
# Titles that stand before a name.
TITLES = "Mr Mrs Ms Miss Mx Dr Prof Sir Dame Rev M Mme Mlle Me Herr Frau Sr Sra Srta don doña Don Doña D Dª Ing Dipl".split()
_TITLE = rf"(?:(?:{'|'.join(TITLES)})\.?\s+)*"
_MORE = rf"(?:,?\s+(?:{_INI}\s?)*(?:{_CAP}|{_INI}(?=\W|$)))"
NAME = re.compile(rf"(?<![\w@])(?=[{_UP}])(?:(?:{_INI}\s?)+{_CAP}{_MORE}*|{_CAP}{_MORE}+)")
#: French words run together: no given name starts so.
ELIDED = re.compile(r"(?:[cdjlmnst]|qu)['’]")
PART = re.compile(rf"{_CAP}|{_INI}|,")

_AT = r"(?:\s?@\s?|\s?&#64;\s?|\s?&commat;\s?|\s?[\[({<]\s?(?:at|@|AT|At|arobase|arroba)\s?[\])}>]\s?|\s(?:at|AT)\s(?=[\w-]+\s(?:dot|DOT)\s))"
_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|DOT|Dot|point|punkt|punto|\.)\s?[\])}>]\s?|\s(?:dot|DOT)\s)"
EMAIL = re.compile(rf"(?<!\w)\w[\w%+'-]*(?:\.[\w%+'-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,24}}(?![\w-])")

# Words for streets and boxes.
STREET = "Street St Road Rd Lane Ln Row Avenue Ave Close Court Ct Drive Dr Way Place Pl Square Sq Terrace Boulevard Blvd Crescent Hill Gardens Mews Walk Park Quay Alley Parade".split()
ROAD_FR = "rue avenue av boulevard bd bvd place chemin quai allée allées impasse route cours passage ruelle square sentier faubourg".split()
ROAD_ES = "calle c/ avda avenida plaza paseo camino carretera ronda travesía callejón glorieta pza".split()
ROAD_DE = "straße strasse str weg gasse platz allee ring damm ufer steig stieg pfad hof chaussee markt".split()

# What an email address, an address or an identity number cannot be written without.
MAIL_SIGNS = ("@", "(at", "[at", "{at", "<at", "at)", "at]", "( at", "[ at", "(AT", "[AT", " dot ", " DOT ", "&#64;", "&commat;", "arobase", "arroba")
STREET_SIGNS = (
    *(f" {w}" for w in STREET), *(f" {w}" for w in ROAD_FR), *(f"{w} " for w in ROAD_ES), *(w.capitalize() for w in ROAD_ES),
    *ROAD_DE, "stra", "Str", "Weg", "Platz", "Allee", "Gasse", "Markt", "Ring", "Damm", "Ufer", "Steig", "Hof ", "Am ", "An de", "Auf d", "Im ", "In der ", "Zum ", "Zur ", "Unter den ", "Box", "BP", "B.P", "Postfach", "Apartado", "Apdo", "ostale",
)
DIGIT = re.compile(r"\d")
ID_DIGITS = re.compile(r"\d(?:[ .-]?[A-Z\d]){4}")
PHONE_DIGITS = re.compile(r"\d[\d\s().\-/–]{5,}\d")
NEAR_CAPITALS = re.compile(rf"[{_UP}][^\s.!?:;]*[.,]?\s+[{_UP}]")

PHONE = re.compile(r"(?<![\w.+/&#(-])(?:\+\s?\d|\(\+?\d|\d)[\d\s().\-/–]{5,22}\d(?![\w])(?!\.\d)")
#: Ten digits as three, three and four.
NATIONAL = re.compile(r"\(?\d{3}\)?[-. ]\d{3}[-. ]\d{4}")
PHONE_CUE = re.compile(r"(?i)(?:tel|tél|phone|call|ring|fax|text|dial|number is|mobile|mob|office|cell|handy|telefon|anrufen|unter|appele[rz]|appel|llam[ea]|móvil|teléfono|numéro|whatsapp|partagent le|comparten|teilen sich|shared|joindre|au|al|le)\W{0,4}(?:\w{0,3}\W{1,2})?$")
PHONE_AFTER = re.compile(r"(?i)^\W{0,3}(?:anrufen|after|ask for|an\b|\()")
NOT_PHONE = re.compile(r"(?i)(?:order|catalogue|catalog|version|release|isbn|item|sku|ref|art|invoice|no|nr|ticket|part|serial|model|build|port|checksum|lot|parcel number|tracking|commande|bestell\w*|pedido|artikel\w*|katalog\w*|facture|rechnung\w*|number|id)\W{0,3}(?:number|no|nr|n[o°º])?\W{0,3}$")
DATE = re.compile(r"^(?:\d{4}[-./]\d\d?[-./]\d\d?|\d\d?[-./]\d\d?[-./]\d{4})$")

# Words that announce an identity number, by kind of document.
ID_LABELS = [
    r"SSN", r"social security (?:number|no\.?|nr\.?)", r"national id(?:entity)?(?: (?:number|card))?", r"national insurance(?: (?:number|no\.?))?", r"NINO", r"tax (?:id|number|no\.?|reference)", r"TIN", r"ITIN", r"EIN",
    r"passport(?: (?:number|no\.?|nr\.?))?", r"driv(?:er|ing)[’'`]?s?(?: |-)licen[cs]e(?: (?:number|no\.?))?", r"identity (?:card|number)(?: (?:number|no\.?))?", r"ID card(?: (?:number|no\.?))?", r"licen[cs]e (?:number|no\.?)", r"personal (?:number|id|code)",
    r"(?:num[ée]ro|n[°ºo]\.?) de s[ée]curit[ée] sociale", r"s[ée]curit[ée] sociale", r"NIR", r"CNI", r"carte d[’']identit[ée]", r"passeport(?: (?:num[ée]ro|n[°ºo]\.?))?", r"permis(?: de conduire)?(?: n[°ºo]\.?)?", r"num[ée]ro fiscal", r"NIF", r"titre de s[ée]jour",
    r"Steuer-?ID(?:entifikationsnummer)?(?:-?Nr\.?)?", r"Steuernummer", r"IdNr\.?", r"Reisepass(?:-?(?:nummer|nr\.?))?", r"Personalausweis(?:-?(?:nummer|nr\.?))?", r"Ausweis(?:-?(?:nummer|nr\.?))?", r"F[üu]hrerschein(?:-?(?:nummer|nr\.?))?", r"Sozialversicherungs(?:nummer|nr\.?)", r"(?:SV|RV)-Nummer",
    r"DNI", r"NIE", r"CIF", r"pasaporte(?: (?:n[úu]mero|n[°ºo]\.?))?", r"n[úu]mero de (?:la )?seguridad social", r"seguridad social", r"NUSS", r"permiso de conducir", r"carn[ée]t? de (?:conducir|identidad)", r"c[ée]dula",
]
_DAMAGED = str.maketrans({"é": "(?:é|Ã©|�|e)", "ü": "(?:ü|Ã¼|�|u)", "ú": "(?:ú|Ãº|�|u)", "°": "(?:°|Â°|�)"})
IDENTITY = re.compile(rf"(?i)(?<!\w)(?:{'|'.join(ID_LABELS)})(?:\s+(?:is|est|lautet|ist|es|n[ºo°]\.?|no\.?|nr\.?|number))?\s*[:#=]?\s*((?-i:(?=[A-Z\d .-]*\d)[A-Z\d](?:[ .-]?[A-Z\d])+)(?!\w))".replace("Ã", "Ã"))
BARE_ID = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|[XYZ]-\d{7}-[A-Z]|\d{8}[A-Z]|\d{2}\.\d{3}\.\d{3}-[A-Z]|[A-Z]{2} \d\d \d\d \d\d [A-D]|[12] \d\d \d\d \d\d \d{3} \d{3} \d\d)(?![\w-])")

_N = r"\d{1,4}\s?[A-Za-z]?(?:\s?[-/]\s?\d{1,4})?"
_ST = "|".join(STREET)
_FORMS = {
    "en": rf"(?P<flat>(?:Flat|Apt\.?|Apartment|Unit|Suite|Room|Appt\.?|Wohnung|Piso)\s+\d+\w?,?\s+)?(?P<en>{_N},?\s+(?:St\.?\s+)?(?:{_CAP}\s+){{1,3}}(?:{_ST})(?!\w)\.?)",
    "box": rf"(?P<box>P\.?\s?O\.?\s?Box\s+\d+|Box\s+\d+|BP\s+\d+|B\.P\.\s*\d+|Postfach\s+\d[\d ]*|Apartado(?:\s+de\s+[Cc]orreos)?\s+\d+|Apdo\.?\s+\d+|Bo[îi]te [Pp]ostale\s+\d+)",
    "fr": rf"(?P<fr>{_N}(?:\s?(?:bis|ter|quater))?,?\s+(?:{'|'.join(ROAD_FR)})\.?\s+(?:(?:de|du|des|la|le|les|l[’']|d[’'])\s?)*{_CAP}(?:[ -]{_CAP})*)",
    "es": rf"(?P<es>(?i:{'|'.join(ROAD_ES)})\.?\s+(?:(?:de|del|la|las|los|el)\s+)*{_CAP}(?:\s+{_CAP})*\s?,?\s+(?:n[º°]\.?\s*)?\d{{1,4}})",
    "de": rf"(?P<de>(?:{_CAP}(?:straße|strasse|stra(?:Ã.|�)e|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|stieg|pfad|chaussee)|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den)\s+{_CAP}|{_CAP}[ -](?:Straße|Strasse|Str\.|Weg|Platz|Allee|Gasse|Markt|Ring|Damm|Ufer|Steig|Hof))\s+{_N})",
}
#: The pattern with and without the two forms that start with a word, which are slow and which most texts cannot hold.
ADDRESS = {
    (spanish, german): re.compile(rf"(?<![\w.])(?:{'|'.join(f for k, f in _FORMS.items() if (k != 'es' or spanish) and (k != 'de' or german))})(?!\w)")
    for spanish in (False, True)
    for german in (False, True)
}
# What stands right before the number of a German address: the end of a street's name, or a preposition and a name.
_DE_ENDS = tuple("aße asse �e str. Str. weg Weg gasse Gasse platz Platz allee Allee ring Ring damm Damm ufer Ufer steig Steig stieg pfad chaussee Markt Hof".split())
_DE_NAMED = re.compile(r"(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den)\s+\S+$")
_NUMBER = re.compile(r"(?<=\S)\s+(?=\d)")


def may_be_german(text: str) -> bool:
    """Whether a number stands behind what can end the name of a German street: without that, the form cannot match."""
    for m in _NUMBER.finditer(text):
        before = text[max(0, m.start() - 200) : m.start()]
        if before.endswith(_DE_ENDS) or before[-4:-2] == "aÃ" or _DE_NAMED.search(before):
            return True
    return False


ADDRESS_CUE = re.compile(r"(?i)(?:near|lives?|tenant|resid\w*|parcel|deliver\w*|ship\w*|send|note|at|to|address|anschrift|adresse|wohnt|habite|livraison|vive|entregas?|domicil\w*|dirección|signed by|demeure|lieferung|;|,|an|au|en|in)\W{0,4}(?:\w{0,3}\W{1,2})?$")
ADDRESS_AFTER = re.compile(rf"^\W{{0,3}}(?:,?\s*(?:Apt|Flat|\d{{4,5}}|[{_UP}]\w+|\d+[ºª]))|^\s*$|^[,;.)]")
AFTER_NOUN = re.compile(r"^\s+(?![a-zà-ÿ]{1,3}\s|has|from|and|und|et|y|von)[a-zà-ÿ]{4,}")

# What announces a name, and what does so for certain; a star stands for any letters.
_STRONG = ["contact", "contacto", "witness", "applicant", "posted by", "signed by", "edited by", "verfasst von", "rédigé par", "escrito por", "zeuge war", "témoin", "testigo", "según", "laut", "d'après", "d’après", "according to", "card of", "name=", "name:", 'name"=', 'name":', "owner=", "owner:", 'owner"=', 'owner":', "ask for", "ansprechpartner*", "regards", "saludos", "grüße", "grüßen", "cordialement"]
_WEAK = ["written by", "by", "zeugin war", "selon", "name", "owner", "author", "tenant", "list", "said", "sincerely", "greetings", "cheers", "thanks", "so", "dear", "from", "von", "herr", "que", "that", "though", "because", "which", "what", "when", "and", "und", "et", "y", "with"]


class Cue:
    """Whether a text ends with one of several words and up to four characters that are no letters or digits: the ends are compared, no pattern is searched."""

    def __init__(self, words: list[str]):
        self.ends = tuple(w for w in words if not w.endswith("*"))
        self.stems = [w[:-1] for w in words if w.endswith("*")]
        self.open = re.compile(rf"(?:{'|'.join(self.stems)})\w*\W{{0,4}}$") if self.stems else None

    def search(self, text: str) -> bool:
        t = text.lower()
        for k in range(len(t), max(-1, len(t) - (6 if t.endswith("\n") else 5)), -1):
            if t.endswith(self.ends, 0, k):
                return True
            if k and (t[k - 1].isalnum() or t[k - 1] == "_"):
                break
        return any(x in t for x in self.stems) and self.open.search(t) is not None


STRONG_CUE, NAME_CUE = Cue(_STRONG), Cue([w for w in _STRONG if w[-1] not in "=:"] + _WEAK)
PLACE_CUE = re.compile(r"(?i)\b(?:in|near|at|to|from|outside|en|à|de|nach|bei|for|born in|hacia|vers|tenant at|beside|of)\s+$")
TITLES_BEFORE = re.compile(rf"(?:\b(?:{'|'.join(TITLES)})\.?\s+)+$")
#: Words in lower case, none of addresses or links.
PLAIN = re.compile(r"(?<![\w@.-])[a-zà-ÿ]{2,}+(?![\w@-])")
FIELD_AFTER = re.compile(r"^\s*(?:[|;\t<(,:]|-|$)")
# Words that end the name of a place or a thing.
THING = frozenset("hall street road lane row avenue close station church school bridge river mill hotel inn house library park museum college company ltd inc gmbh box center centre market".split())


def _spotter(signs: tuple[str, ...]):
    """Whether any of the signs stands in a text: one pass where the automaton library is there."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: any(x in text for x in signs)
    automaton = ahocorasick.Automaton()
    for x in signs:
        automaton.add_word(x, True)
    automaton.make_automaton()
    return lambda text: next(automaton.iter(text), None) is not None


has_mail_sign, has_street_sign, has_spanish_road = _spotter(MAIL_SIGNS), _spotter(STREET_SIGNS), _spotter(tuple(ROAD_ES))


@dataclass
class Candidate:
    kind: str
    start: int
    end: int
    votes: list[int]
    features: list[str] = field(default_factory=list)
    #: Where the label in front of it starts, if it has one.
    label: int | None = None


@dataclass
class Lexicon:
    given: frozenset[str] = frozenset()
    #: Lower-case words that are no names.
    common: frozenset[str] = frozenset()
    induced_given: frozenset[str] = frozenset()
    induced_family: frozenset[str] = frozenset()
    all_given: frozenset[str] = field(init=False)

    def __post_init__(self) -> None:
        self.all_given = self.given | self.induced_given


def _shape(text: str) -> str:
    return re.sub(r"\s+", "_", re.sub(r"[a-zà-ÿ]+", "a", re.sub(r"[A-ZÀ-Þ]+", "A", re.sub(r"\d", "9", text))))


def _context(text: str, start: int, end: int) -> tuple[list[str], str, str]:
    left, right = text[max(0, start - 40) : start], text[end : end + 40]
    before = re.findall(r"\w+|[^\w\s]", left.lower())[-2:]
    after = re.findall(r"\w+|[^\w\s]", right.lower())[:2]
    out = [f"<{w}" for w in before[-1:]] + ["<<" + "_".join(before)] + [f">{w}" for w in after[:1]] + [">>" + "_".join(after)]
    return out, left, right


def _blank(text: str, spans: list[tuple[int, int]]) -> str:
    """The text with spans overwritten, at unchanged positions."""
    if not spans:
        return text
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out += [text[at : max(a, at)], "\x00" * (b - max(a, at))]
            at = b
    return "".join(out) + text[at:]


def _emails(text: str) -> Iterator[Candidate]:
    if not has_mail_sign(text):
        return
    for m in EMAIL.finditer(text):
        s = m.group()
        ctx, left, _ = _context(text, m.start(), m.end())
        plain = "@" in s
        package = bool(re.search(r"@\s?\d", s)) or text[m.start() - 1 : m.start()] in ("/", "@")
        cue = bool(re.search(r"(?i)(?:mail|mailto|write|contact|write to|écrivez|escriba|schreiben|an|see|à|a|address|at|bitte)\W{0,4}$", left))
        spelled = bool(re.search(r"(?i)[\[(]\s?(?:at|dot)\s?[\])]|\bat\b.*\bdot\b", s))
        yield Candidate("email", m.start(), m.end(), [1 if plain or spelled else 0, -1 if package else 0, 1 if cue else 0], [f"shape={_shape(s)[:24]}", f"tld={s[-4:].lower()}", *ctx])


def _identities(text: str) -> Iterator[Candidate]:
    seen = set()
    if not ID_DIGITS.search(text):
        return
    for m in IDENTITY.finditer(text):
        s = m.group(1)
        start, end = m.span(1)
        seen.add(start)
        ctx, left, right = _context(text, start, end)
        digits = sum(c.isdigit() for c in s)
        yield Candidate("identity", start, end, [1, 1 if digits >= 6 else -1, 0, 1 if BARE_ID.fullmatch(s) else 0], [f"shape={_shape(s)[:24]}", f"label={m.group()[: start - m.start()].strip().lower()[:20]}", *ctx], m.start())
    for m in BARE_ID.finditer(text):
        if m.start() in seen:
            continue
        ctx, left, right = _context(text, m.start(), m.end())
        cue = bool(re.search(r"(?i)(?:ssn|social|secur|national|id|dni|nie|nif|tax|insurance|sociale|seguridad)\W{0,6}$", left))
        other = bool(NOT_PHONE.search(left))
        yield Candidate("identity", m.start(), m.end(), [0, 0, -1 if other else (1 if cue else 0), 1], [f"shape={_shape(m.group())[:24]}", "bare", *ctx])


def _addresses(text: str) -> Iterator[Candidate]:
    if not has_street_sign(text):
        return
    for m in ADDRESS[has_spanish_road(text.lower()), may_be_german(text)].finditer(text):
        s = m.group()
        ctx, left, right = _context(text, m.start(), m.end())
        form = next(k for k in _FORMS if m.groupdict().get(k))
        # a noun right after a street turns it into an attribute
        noun = form == "en" and bool(AFTER_NOUN.match(right))
        product = bool(re.search(r"(?i)\b(?:ordered|bought|sold|cost|paid|bestellt|commandé|comprado)\W+$", left))
        yield Candidate(
            "address", m.start(), m.end(),
            [1 if form == "box" else 0, 1 if form in ("en", "fr", "es", "de") and not noun else -1 if noun else 0, 1 if ADDRESS_CUE.search(left) or not left.strip() else 0, 1 if ADDRESS_AFTER.match(right) else 0, -1 if noun or product else 0, 1 if m.group("flat") else 0],
            [f"form={form}", f"shape={_shape(s)[:16]}", f"noun={noun}", *ctx],
        )


def _phones(text: str) -> Iterator[Candidate]:
    if not PHONE_DIGITS.search(text):
        return
    for m in PHONE.finditer(text):
        s = m.group()
        if "\n" in s or "\t" in s or "  " in s:
            # numbers of several fields: take the pieces
            pieces = [(x.start() + m.start(), x.group()) for x in re.finditer(r"[+(\d](?:[\d().\-/–]| (?=[\d(]))+", s)]
        else:
            pieces = [(m.start(), s)]
        for start, s in pieces:
            s = s.rstrip(" .-/(–")
            digits = re.sub(r"\D", "", s)
            if not 7 <= len(digits) <= 15 or DATE.match(s):
                continue
            end = start + len(s)
            ctx, left, right = _context(text, start, end)
            groups = re.findall(r"\d+", s)
            if 2 * sum(len(g) == 1 for g in groups) > max(len(groups), 3):
                # single digits in a row
                continue
            grouped = "-".join(str(len(g)) for g in groups)
            plus, paren, zero = s.startswith("+"), "(" in s, digits.startswith("0") and not digits.startswith("000")
            person = "\x00" in left
            decimals = bool(re.fullmatch(r"\d+[.,]\d+|\d{1,3}(?:\.\d+){2,3}", s)) and not (len(groups) >= 3 and len(groups[-1]) >= 4)
            other = bool(NOT_PHONE.search(left)) and not re.search(r"(?i)my number is\W*$", left)
            yield Candidate(
                "phone", start, end,
                [1 if plus else 0, 1 if paren else 0, 1 if zero and len(groups) >= 2 else 0, 1 if PHONE_CUE.search(left) or PHONE_AFTER.match(right) and len(groups) > 1 else 0, -1 if other else 0, -1 if decimals or len(groups) == 1 and not plus else 0, 1 if person and not other else 0, 1 if NATIONAL.fullmatch(s) and not other else 0],
                [f"groups={grouped}", f"shape={_shape(s)[:24]}", f"first={groups[0][:2] if groups else ''}", f"n={len(digits)}", f"sep={''.join(sorted(set(re.sub(r'[0-9]', '', s))))}", *ctx],
            )


def _low(word: str) -> str:
    return word.lower().strip("'’")


#: What speaks for or against a name whatever the lexicons hold, as bits.
COMMA, INITIAL, TITLED, STRONG, PLACE, MENU, MAIL = (1 << k for k in range(7))


def _spots(text: str) -> Iterator[tuple[int, int, str, str, str, int, str, str]]:
    """(start, end, given, family, before, bits, left, right) of what looks like a name, whatever the lexicons hold.

    ``before`` is the word in front of a reversed name that would make its family name the end of a whole name.
    """
    if not NEAR_CAPITALS.search(text):
        return
    for m in NAME.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in PART.finditer(m.group())]
        words = [k for k, p in enumerate(parts) if p[2] != ","]
        titles: set[int] = set()
        for x, k in enumerate(words[:-1]):
            t = parts[k][2].rstrip(".")
            # one letter is a title only in front of a whole name, and not after another title
            if t in TITLES and (len(t) > 1 or x + 2 < len(words) and not titles):
                titles.add(k)
        for x, i in enumerate(words):
            if i in titles:
                continue
            # a given name or initial, further initials, a family name: in either order
            j = i + 1
            while j < len(parts) and parts[j][2] != "," and parts[j][2].endswith("."):
                j += 1
            if j >= len(parts):
                # "Family I." does not end a sentence here
                continue
            comma = parts[j][2] == ","
            before = ""
            if comma:
                if j != i + 1 or parts[i][2].endswith(".") or j + 1 >= len(parts) or parts[j + 1][2] == ",":
                    continue
                if x and words[x - 1] == i - 1:
                    before = _low(parts[i - 1][2])
                j += 1
            if j in titles:
                continue
            a, b = parts[i], parts[j]
            first, last = (b, a) if comma else (a, b)
            gap = text[a[1] : b[0]]
            if "\n" in gap or gap == "\t" or b[2].endswith(".") and not comma:
                continue
            end = b[1]
            if comma:
                # initials after a reversed given name belong to it
                k = j + 1
                while k < len(parts) and parts[k][2].endswith(".") and len(parts[k][2]) <= 3 and not text[parts[k][1] :][:1].strip() == "":
                    end, k = parts[k][1], k + 1
            g, f = _low(first[2].rstrip(".")), _low(last[2])
            if ELIDED.match(g):
                continue
            left, right = text[max(0, a[0] - 40) : a[0]], text[end : end + 40]
            left_strip = TITLES_BEFORE.sub("", left)
            titled = left_strip != left
            strong = bool(STRONG_CUE.search(left_strip))
            place = not titled and not strong and bool(PLACE_CUE.search(left))
            menu = bool(re.search(r"[|»]\s*$", left)) and bool(re.match(r"\s*[|»]", right)) or bool(re.match(r"\s+[|»]", right)) and not re.search(r"@|\[dot\]|\d{3}", right)
            # after "Word, Word:" an address belongs to a label
            mail = bool(re.match(r"[\s|;,(<:]*(?:mailto:)?\x00", right)) and not (comma and right.startswith(":"))
            yield a[0], end, g, f, before, COMMA * comma | INITIAL * first[2].endswith(".") | TITLED * titled | STRONG * strong | PLACE * place | MENU * menu | MAIL * mail, left_strip, right


def _name_votes(g: str, f: str, bits: int, lex: Lexicon) -> tuple[list[int], bool, bool, bool, bool, bool]:
    """Votes on a name, and whether its words are in the gazetteer, induced as given, common (both) and induced as family."""
    gp, fp = g.split("-"), f.split("-")
    initial, comma = bits & INITIAL, bits & COMMA
    in_gaz = not initial and any(x in lex.given for x in gp)
    known = not initial and any(x in lex.induced_given for x in gp)
    family_common = any(x in lex.common or x in ALL_FUNCTION_WORDS for x in fp) or f in THING
    given_common = not initial and not in_gaz and g in ALL_FUNCTION_WORDS
    known_family = any(x in lex.induced_family for x in fp)
    votes = [
        1 if in_gaz and not family_common else 0,
        1 if bits & TITLED else 0,
        1 if bits & STRONG else 0,
        1 if bits & MAIL else 0,
        -1 if family_common else 0,
        -1 if f in THING or bits & PLACE and not in_gaz else 0,
        -1 if bits & MENU and not in_gaz and not bits & MAIL else 0,
        -1 if given_common else 0,
        1 if known_family and not given_common else 0,
        1 if known and not family_common else 0,
        # once given names are induced, "Word, Word" without one is rather an enumeration
        -1 if comma and not (in_gaz or known) else 0,
    ]
    return votes, in_gaz, known, family_common, given_common, known_family


def _name_static(text: str, start: int, end: int, g: str, f: str, bits: int, left_strip: str, right: str) -> list[str]:
    """Features of what looks like a name that no lexicon changes."""
    comma, initial, titled, strong, place, menu = (bool(bits & x) for x in (COMMA, INITIAL, TITLED, STRONG, PLACE, MENU))
    shown = [f"g={g}", f"f={f}", f"g3={g[-3:]}", f"f3={f[-3:]}", f"f4={f[-4:]}", f"p4={f[:4]}", f"title={titled}", f"comma={comma}", f"ini={initial}", f"place={place}", f"cue={NAME_CUE.search(left_strip)}", f"strong={strong}", f"menu={menu}", f"field={bool(FIELD_AFTER.match(right))}"]
    return shown + _context(text, start, end)[0]


def _name_dynamic(in_gaz: bool, known: bool, family_common: bool, given_common: bool, known_family: bool) -> list[str]:
    """Features that come from the lexicons."""
    return [f"gaz={in_gaz}", f"known={known}", f"kf={known_family}", f"fc={family_common}", f"gc={given_common}", f"both={in_gaz or known}/{known_family}"]


def _names(text: str, lex: Lexicon) -> Iterator[Candidate]:
    for start, end, g, f, before, bits, left_strip, right in _spots(text):
        if before and before in lex.all_given:
            # the family name ends a whole name: what follows the comma is something else
            continue
        votes, *known = _name_votes(g, f, bits, lex)
        yield Candidate("name", start, end, votes, _name_static(text, start, end, g, f, bits, left_strip, right) + _name_dynamic(*known))


def _settled(text: str) -> tuple[list[Candidate], str, str]:
    """Addresses, identity numbers and streets; the text without the addresses, and without all three."""
    found = list(_emails(text))
    plain = hidden = _blank(text, [(c.start, c.end) for c in found])
    if DIGIT.search(hidden):
        ids = list(_identities(hidden))
        hidden = _blank(hidden, [(c.start if c.label is None else c.label, c.end) for c in ids if c.votes[0] > 0])
        streets = list(_addresses(hidden))
        hidden = _blank(hidden, [(c.start, c.end) for c in streets])
        found += ids + streets
    return found, plain, hidden


def candidates(text: str, lex: Lexicon) -> list[Candidate]:
    """All candidates of a text. Later kinds do not look inside spans of earlier ones that their patterns settle."""
    found, _, hidden = _settled(text)
    if DIGIT.search(hidden):
        found += _phones(hidden)
    found += _names(hidden, lex)
    return found


# ---------------------------------------------------------------- estimation
class LabelModel:
    """Reliabilities of labelers by expectation-maximisation (two classes, independent votes)."""

    def fit(self, votes: np.ndarray, rounds: int = 40) -> LabelModel:
        n, k = votes.shape
        # start: the sign of the votes' sum
        q = 1 / (1 + np.exp(-1.5 * votes.sum(axis=1)))
        for _ in range(rounds):
            self.prior = float(np.clip(q.mean(), 0.02, 0.98))
            self.rates = np.zeros((2, k, 3))
            for c, w in ((0, 1 - q), (1, q)):
                for v in (-1, 0, 1):
                    # a vote is believed to favour its own side: that breaks the symmetry of the classes
                    cast = votes == v
                    own = 0.1 * (cast.sum(axis=0) + 1) * (1.0 if v == 0 else 1.7 if (v == 1) == (c == 1) else 0.3)
                    self.rates[c, :, v + 1] = (cast * w[:, None]).sum(axis=0) + own
                self.rates[c] /= self.rates[c].sum(axis=1, keepdims=True)
            q = self.posterior(votes)
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        at = votes + 1
        k = np.arange(votes.shape[1])
        logit = math.log(self.prior / (1 - self.prior)) + (np.log(self.rates[1][k, at]) - np.log(self.rates[0][k, at])).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _hash(kind: str, features: list[str]) -> list[int]:
    return [xxhash.xxh32_intdigest(f"{kind}|{x}") % DIM for x in features]


def _voted(votes: list[int]) -> list[str]:
    """Features of the votes: each that was cast, and all together."""
    return [f"v{n}={v}" for n, v in enumerate(votes) if v] + ["votes=" + "".join("-0+"[v + 1] for v in votes)]


def _hashed(kind: str, c: Candidate) -> list[int]:
    return _hash(kind, [*c.features, *_voted(c.votes), ""])


#: A candidate without what depends on the lexicons: number of its kind, start, end, hashed features, and of names given, family, the word before and bits.
Prepared = tuple[int, int, int, bytes] | tuple[int, int, int, bytes, str, str, str, int]


def prepare(text: str) -> tuple[list[Prepared], str]:
    """All candidates of a text as far as no lexicon matters, and the text without its addresses."""
    found, plain, hidden = _settled(text)
    if DIGIT.search(hidden):
        found += _phones(hidden)
    out: list[Prepared] = [(KINDS.index(c.kind), c.start, c.end, array("H", _hashed(c.kind, c)).tobytes()) for c in found]
    for start, end, g, f, before, bits, left_strip, right in _spots(hidden):
        shown = _hash("name", [*_name_static(hidden, start, end, g, f, bits, left_strip, right), ""])
        out.append((KINDS.index("name"), start, end, array("H", shown).tobytes(), g, f, before, bits))
    return out, plain


class SpanModel:
    """Lexicons, labeler reliabilities and the span classifier."""

    def __init__(self, lex: Lexicon, weights: np.ndarray):
        self.lex, self.weights = lex, weights
        self._weight = weights.tolist()
        self._known: dict[tuple, float] = {}

    def _dynamic(self, g: str, f: str, bits: int) -> float:
        """The weight of the votes and features that come from the lexicons; few combinations occur."""
        votes, *known = _name_votes(g, f, bits, self.lex)
        key = (*votes, *known)
        if key not in self._known:
            self._known[key] = float(sum(self._weight[k] for k in _hash("name", _voted(votes) + _name_dynamic(*known))))
        return self._known[key]

    def decide(self, prepared: list[Prepared]) -> list[tuple[str, int, int]]:
        """(kind, start, end) in order, not overlapping: the more probable candidate wins."""
        scored = []
        for kind, start, end, shown, *name in prepared:
            s = sum(map(self._weight.__getitem__, memoryview(shown).cast("H")))
            if name:
                g, f, before, bits = name
                if before and before in self.lex.all_given:
                    continue
                s += self._dynamic(g, f, bits)
            if s > 0:
                scored.append((-s, start, end, KINDS[kind]))
        taken: list[tuple[int, int, str]] = []  # in order of position
        for _, a, b, kind in sorted(scored):
            k = bisect_left(taken, (a,))
            if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or taken[k][0] >= b):
                taken.insert(k, (a, b, kind))
        return [(kind, a, b) for a, b, kind in taken]

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        return self.decide(prepare(text)[0]) if text and text.strip() else []


def _train_classifier(cands: list[Candidate], targets: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Logistic regression on soft labels over hashed features, by full-batch Adam."""
    idx = [_hashed(c.kind, c) for c in cands]
    flat = np.concatenate([np.array(x) for x in idx]) if idx else np.zeros(0, int)
    row = np.repeat(np.arange(len(idx)), [len(x) for x in idx])
    w, m, v = np.zeros(DIM), np.zeros(DIM), np.zeros(DIM)
    for t in range(1, rounds + 1 if len(idx) else 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[flat], len(idx)), -30, 30)))
        g = np.bincount(flat, (p - targets)[row], DIM) / len(idx) + 2e-6 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


# ---------------------------------------------------------------- counts over all chunks
#: What looks like a name: given, family, the word before, bits.
Record = tuple[str, str, str, int]


def count_text(text: str, words: Counter[str], names: Counter[Record]) -> list[Prepared]:
    """Adds the lower-case words outside addresses and what looks like a name; neither depends on a lexicon. Returns the candidates."""
    found, plain = prepare(text)
    words.update(PLAIN.findall(plain))
    names.update(x[4:] for x in found if len(x) > 4)
    return found


class Judge:
    """Whether what looks like a name is probably one, by the lexicons and the labelers' reliabilities; None where it is no candidate."""

    def __init__(self, lex: Lexicon, model: LabelModel):
        self.lex, self.model, self.known = lex, model, {}

    def __call__(self, g: str, f: str, before: str, bits: int) -> bool | None:
        if before and before in self.lex.all_given:
            return None
        votes = tuple(_name_votes(g, f, bits, self.lex)[0])
        if votes not in self.known:
            self.known[votes] = bool(self.model.posterior(np.array([votes]))[0] > 0.8)
        return self.known[votes]


def _good_names(words: list[tuple[str, str]]) -> tuple[frozenset[str], frozenset[str]]:
    return tuple(frozenset(y for k, w in words if k == key and w not in ALL_FUNCTION_WORDS for y in w.split("-")) for key in "gf")


class Counts:
    """Counts over a list of texts, for tests and small tables."""

    def __init__(self, texts: list[str]):
        self.words: Counter[str] = Counter()
        self.names: Counter[Record] = Counter()
        for t in texts:
            count_text(t, self.words, self.names)

    def common(self, least: int = 3) -> frozenset[str]:
        return frozenset(w for w, n in self.words.items() if n >= least)

    def induced(self, judge: Judge) -> tuple[frozenset[str], frozenset[str]]:
        """Given names that are probably seen with several families, and the reverse."""
        total: Counter[tuple[str, str]] = Counter()
        likely: Counter[tuple[str, str]] = Counter()
        partners: dict[tuple[str, str], set[str]] = defaultdict(set)
        for (g, f, before, bits), n in self.names.items():
            if (good := judge(g, f, before, bits)) is not None:
                for key, word, other in (("g", g, f), ("f", f, g)):
                    if len(word) > 1:
                        total[key, word] += n
                        if good:
                            likely[key, word] += n
                            partners[key, word].add(other)
        return _good_names([k for k in total if len(partners[k]) >= 2 and likely[k] >= 0.4 * total[k]])


class TableCounts:
    """The same over all rows of a table, by grouped sums; only the lexicons leave the executors.

    The one pass over the texts also writes the candidates of every text that has some (``prepared``: id, pickled list), so that
    deciding on them later needs no second pass.
    """

    def __init__(self, chunks: DataFrame, id_col: str):
        columns = ["kind", "g", "f", "before", "bits", "n", id_col, "prepared"]
        schema = StructType.fromDDL("kind string, g string, f string, before string, bits int, n long").add(chunks.schema[id_col]).add("prepared", "binary")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            words: Counter[str] = Counter()
            names: Counter[Record] = Counter()

            def frame() -> pd.DataFrame:
                rows = [("w", w, "", "", 0, n, None, None) for w, n in words.items()] + [("n", *r, n, None, None) for r, n in names.items()]
                words.clear()
                names.clear()
                return pd.DataFrame(rows, columns=columns).astype({id_col: object})

            for pdf in batches:
                out = []
                for i, t in zip(pdf[id_col], pdf.text):
                    if found := count_text(t, words, names):
                        out.append(("p", None, None, None, None, None, i, pickle.dumps(found, 5)))
                yield pd.DataFrame(out, columns=columns).astype(object)
                if len(words) + len(names) >= MAX_COUNTED:
                    yield frame()
            yield frame()

        rows = once(chunks.filter(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(id_col, "text"), id_col)
        counted = materialize(rows.mapInPandas(run, schema), "personal-candidates")
        self.prepared = counted.filter("kind = 'p'").select(id_col, "prepared")
        self.n = materialize(counted.filter("kind <> 'p'").groupBy("kind", "g", "f", "before", "bits").agg(F.sum("n").alias("n")), "personal-counts")

    def common(self, least: int = 3) -> frozenset[str]:
        # only words of what looks like a family name are ever looked up
        asked = self.n.filter("kind = 'n'").select(F.explode(F.split("f", "-")).alias("g")).distinct()
        words = self.n.filter((F.col("kind") == "w") & (F.col("n") >= least)).select("g").join(asked, "g", "left_semi")
        return frozenset(r.g for r in small_rows(words, MAX_WORDS, "common words"))

    def induced(self, judge: Judge) -> tuple[frozenset[str], frozenset[str]]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                good = [judge(*r) for r in zip(pdf.g, pdf.f, pdf.before, pdf.bits)]
                there = [x is not None for x in good]
                yield pdf.loc[there, ["g", "f", "n"]].assign(good=[bool(x) for x in good if x is not None])

        seen = self.n.filter("kind = 'n'").select("g", "f", "before", "bits", "n").mapInPandas(run, "g string, f string, n long, good boolean")
        sides = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("word"), F.col(o).alias("other")) for k, o in (("g", "f"), ("f", "g"))])
        pairs = seen.select(F.explode(sides).alias("s"), "n", "good").select("s.*", "n", "good").filter(F.length("word") > 1)
        pairs = pairs.groupBy("key", "word", "other").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("likely"))
        words = pairs.groupBy("key", "word").agg(F.sum("n").alias("n"), F.sum("likely").alias("likely"), F.count(F.when(F.col("likely") > 0, 1)).alias("partners"))
        words = words.filter((F.col("partners") >= 2) & (F.col("likely") >= 0.4 * F.col("n"))).select("key", "word")
        return _good_names([(r.key, r.word) for r in small_rows(words, MAX_WORDS, "induced names")])


def once(rows: DataFrame, id_col: str) -> DataFrame:
    """(id, text) with every id once, with the text that sorts last; only rows whose id occurs twice are moved for that."""
    twice = materialize(rows.groupBy(id_col).count().filter("count > 1").select(id_col), "repeated-ids")
    if twice.isEmpty():
        return rows
    twice = broadcast_if_small(twice, MAX_WORDS)
    return rows.join(twice, id_col, "left_anti").unionByName(rows.join(twice, id_col, "left_semi").groupBy(id_col).agg(F.max("text").alias("text")))


def train_on(texts: list[str], given_names: list[str], counts: Counts | TableCounts | None = None) -> SpanModel:
    """Labelers and classifier of a sample of texts; the lexicons of ``counts``, or of the texts themselves."""
    counts = Counts(texts) if counts is None else counts
    given = frozenset(_low(x) for x in given_names if x and x.strip())
    lex = Lexicon(given, counts.common())
    spots = [x[2:6] for t in texts for x in _spots(_settled(t)[2])]
    for _ in range(2):
        votes = [_name_votes(g, f, bits, lex)[0] for g, f, before, bits in spots if not (before and before in lex.all_given)]
        if votes:
            lex = Lexicon(given, lex.common, *counts.induced(Judge(lex, LabelModel().fit(np.array(votes)))))
    cands = [c for t in texts for c in candidates(t, lex)]
    target = np.zeros(len(cands))
    for kind in KINDS:
        mine = [k for k, c in enumerate(cands) if c.kind == kind]
        if mine:
            votes = np.array([cands[k].votes for k in mine])
            target[mine] = LabelModel().fit(votes).posterior(votes)
    return SpanModel(lex, _train_classifier(cands, target))


def train(chunks: DataFrame, given_names: DataFrame, id_col: str = "chunk_id", train_chunks: int = TRAIN_CHUNKS) -> SpanModel:
    return _train(chunks, given_names, id_col, train_chunks)[0]


def _train(chunks: DataFrame, given_names: DataFrame, id_col: str, train_chunks: int = TRAIN_CHUNKS) -> tuple[SpanModel, DataFrame]:
    """The model, and the candidates of all chunks."""
    rows = sorted(hash_sample(chunks.select(id_col, "text"), id_col, train_chunks).filter("text is not null").collect(), key=lambda r: str(r[0]))
    counts = TableCounts(chunks, id_col)
    return train_on(list({r[0]: r.text for r in rows}.values()), gazetteer(given_names, counts), counts), counts.prepared


def gazetteer(given_names: DataFrame, counts: TableCounts, most: int = MAX_NAMES) -> list[str]:
    """The given names of a table of any size that can matter: those in front of or behind a family name somewhere."""
    names = given_names.select("given_name").filter("given_name is not null")
    if names.limit(most + 1).count() > most:
        key = F.regexp_replace(F.lower("given_name"), "^['’]+|['’]+$", "")
        asked = counts.n.filter("kind = 'n'").select(F.explode(F.split("g", "-")).alias("_asked")).distinct()
        names = names.join(asked, key == F.col("_asked"), "left_semi")
    return sorted(r[0] for r in small_rows(names, MAX_WORDS, "given names that occur"))


def find_personal(chunks: DataFrame, given_names: DataFrame, id_col: str = "chunk_id", model: SpanModel | None = None) -> DataFrame:
    """(id, kind, start_pos, end_pos) of every occurrence; positions count code points from 0.

    Rows delivered twice count once; of deliveries whose texts differ, the text that sorts last is searched. With a given ``model`` every
    row is searched as it is. Null and blank texts give none. Without a model the texts are passed over once, for counts and candidates; deciding on
    the candidates is map-only.
    """
    schema = chunks.select(id_col).schema.add("kind", "string").add("start_pos", "integer").add("end_pos", "integer")
    if model is None:
        model, prepared = _train(chunks, given_names, id_col)

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(i, *s) for i, x in zip(pdf[id_col], pdf.prepared) for s in model.decide(pickle.loads(x))]
                yield pd.DataFrame(rows, columns=[id_col, "kind", "start_pos", "end_pos"])

        return prepared.mapInPandas(decide, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, *s) for i, t in zip(pdf[id_col], pdf.text) for s in model.spans(t)]
            yield pd.DataFrame(rows, columns=[id_col, "kind", "start_pos", "end_pos"])

    return chunks.filter(F.col(id_col).isNotNull() & F.col("text").isNotNull()).select(id_col, "text").mapInPandas(run, schema)


def mask_personal(chunks: DataFrame, given_names: DataFrame, id_col: str = "chunk_id", model: SpanModel | None = None) -> DataFrame:
    """(id, text, n_masked), one row per id: every occurrence replaced by <EMAIL>, <PHONE>, <IDENTITY>, <ADDRESS> or <NAME>.

    The remaining text is unchanged; null stays null; rows without an id are left out. Of deliveries of an id whose texts differ, the text that sorts last
    wins, before null; only rows whose id occurs several times are moved to find it.
    """
    model = train(chunks, given_names, id_col) if model is None else model
    schema = chunks.select(id_col).schema.add("text", "string").add("n_masked", "integer")

    def mask(text: str | None) -> tuple[str | None, int]:
        out, at = [], 0
        spans = model.spans(text)
        for kind, a, b in spans:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        return (text if text is None else "".join(out) + text[at:]), len(spans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [mask(t) for t in pdf.text]
            yield pd.DataFrame({id_col: pdf[id_col], "text": [r[0] for r in rows], "n_masked": [r[1] for r in rows]})

    rows = chunks.filter(F.col(id_col).isNotNull()).select(id_col, "text")
    return once(rows, id_col).mapInPandas(run, schema)
