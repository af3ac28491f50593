"""Personal information in free text by aggregated weak supervision.

Patterns of a general kind propose candidate spans. Labelers vote on each one or abstain: its
outer form, a gazetteer (the caller's names and those learnt from the corpus), the label before
it, a person beside it, a label of things, a line of its own, and what the corpus tells about the
words on its left, on its right and about its form. Expectation-maximisation estimates how
reliable each labeler is and what each candidate probably is; a logistic span classifier is
trained on that and decides.

Nothing here lists names of persons or sentences: given names are learnt by where they stand
(before many different family names, in greetings, below closing formulas, in e-mail addresses),
contexts by what stands beside mentions that are sure.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.names import LEGAL, NICKNAMES, fold
from postloom.llm.sample import sampled
from postloom.session import cut

KINDS = ("name", "email", "phone", "id_number", "street_address")
FOUND = "array<struct<kind:string,span_start:int,span_end:int>>"
CANDIDATES = "array<struct<kind:string,a:int,b:int,shape:string,left:string,right:string,fill:string,v:array<int>>>"

_W = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_UP = "A-ZÀ-ÖØ-ÞŁŠŽČŚŻĐİ"
# E-mails are found from their at-sign or its spelling, outwards
_AT = re.compile(r"@|[\[({] ?[Aa][Tt] ?[\])}]")
_AT_WORDS = re.compile(r"@|[\[({] ?[Aa][Tt] ?[\])}]| [Aa][Tt] (?=[\w-]+ [Dd][Oo][Tt] )")
_LOCAL = re.compile(r"[\w.+-]+$")
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[A-Za-z]{2,}\b")
_DOMAIN_SPELLED = re.compile(r"[\w-]+(?: ?[\[({] ?dot ?[\])}] ?[\w-]+|\.[\w-]+)+", re.I)
_DOMAIN_WORDS = re.compile(r"[\w-]+(?: dot [\w-]+)+", re.I)
_EXT = r"(?:,? ?(?:ext|extension|x|app|poste|durchwahl|dw)\.? ?\d{1,5})?"
_PHONE = re.compile(
    rf"(?<![\w+/.,-])(?:\+\d{{1,3}}[ .-]?(?:\(0\) ?)?(?:\(?\d{{1,4}}\)?[ ./-]?){{2,5}}\d{{2,4}}|00\d{{9,13}}|\(\d{{2,5}}\) ?\d{{3,4}}[ -]\d{{3,4}}|(?:1[ .-])?\d{{3}}([-. ])\d{{3}}\1\d{{4}}"
    rf"|0\d{{2,5}}[ /]\d{{3,8}}(?:[ -]\d{{3,5}})?|\d{{2}}([. ])\d{{2}}(?:\2\d{{2}}){{3}}|\d{{3}} \d{{4}} \d{{4}}){_EXT}(?![\w/-]|[.,]\d)",
    re.I,
)
# Numbers of any make: a prefix of letters or none, groups of digits and letters, a check letter
_CODE = re.compile(r"(?:[A-Z]{1,3}[ -]?)?\d[\dA-Z]*(?:[.-][\dA-Z]+)*(?:(?: \d{1,4}){1,4})?(?: ?[A-Z](?![\w'’]))?(?![\w/-]|[.,]\d)")
_DATE = re.compile(r"(?:19|20)\d\d[-./]\d\d?[-./]\d\d?|\d\d?[-./]\d\d?[-./](?:19|20)?\d\d")
_AMOUNT = re.compile(r"[A-Z]{3} ?\d+\.\d\d?")
_MONEY_BEFORE = re.compile(r"(?:[£$€¥]|\b[A-Z]{3}) ?$")
_MONEY_AFTER = re.compile(r" ?(?:[£$€¥%]|(?:EUR|USD|GBP|CHF|PLN|SEK|kg|km|m²?)\b)")
_ROOM = r"(?:Unit|Flat|Apt\.?|Apartment|Suite|Room|Floor)"
# Words for roads that stand behind or before the name of the road, or end it.
_ROAD = r"(?:Street|St|Road|Rd\.?|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Close|Way|Place|Pl|Square|Sq|Terrace|Crescent|Grove|Gardens|Row|Hill|Mews|Boulevard|Blvd|Parade|Walk|Alley|Quay|Wharf|Yard|Green|Park|Rise|View|Vale|Loop|Trail|Highway|Hwy|Parkway)"
_ROAD_BEFORE = (
    r"(?:rue|avenue|place|boulevard|allée|impasse|chemin|quai|cours|passage|square|route|calle|c/|avda\.?|avenida|plaza|paseo|camino|ronda|carrera|carretera|travesía|via|viale|vicolo|piazza|corso|largo|strada|"
    r"rua|praça|travessa|estrada|alameda|ulica|ul\.|aleja|al\.|plac)"
)
_ROAD_WORDS = frozenset(_ROAD_BEFORE[3:-1].replace(".?", "").replace("\\.", ".").split("|")) | {"avda.", "ul", "al"}
_SUFFIX = ("weg", "straße", "strasse", "str.", "gasse", "platz", "allee", "ring", "damm", "ufer", "steig", "straat", "laan", "plein", "gracht", "kade", "gatan", "vägen", "gade", "vej", "veien", "gata", "katu", "tie")
_DIGITS = re.compile(r"\d+")
_PARTICLE = r"(?:de la |de l['’]|des |du |de los |de las |del |della |dei |delle |da |do |dos |de |d['’]|la |le |les )"
_NUMBER_ROAD = re.compile(
    rf"\d{{1,4}}[A-Z]? (?:[^\W\d_][\w'’-]* ){{1,3}}?{_ROAD}(?![\w'])(?:, {_ROOM} \d{{1,4}}[A-Z]?\b)?"
    rf"|\d{{1,4}}(?:[A-Z]| ?bis| ?ter)?,? {_ROAD_BEFORE} {_PARTICLE}?[^\W\d_][\w'’-]*(?: (?-i:[{_UP}])[\w'’-]*)*",
    re.I,
)
_ROOM_BEFORE = re.compile(rf"\b{_ROOM} \d{{1,4}}[A-Z]?, $", re.I)
_BOX_BEFORE = re.compile(r"\b(?:P\.? ?O\.? ?Box|Postfach|Postbus|Apartado(?: de Correos)?|Boîte postale|BP|Casella postale) $", re.I)
_BEFORE_NUMBER = re.compile(rf"\b{_ROAD_BEFORE} {_PARTICLE}?[^\W\d_][\w'’-]*(?: {_PARTICLE}?(?-i:[{_UP}])[\w'’-]*){{0,3}},? ?$", re.I)
_SUFFIX_NUMBER = re.compile(rf"(?:(?-i:[{_UP}])[^\W\d_]+ )?\b[^\W\d_][^\W\d_-]*(?:-[^\W\d_]+)*\.? $", re.I)
_LETTER_AFTER = re.compile(r"\d{1,4}[A-Za-z]?(?!\w)")
# Forms of address, greetings, closing formulas.
_TITLES = frozenset("mr mrs ms miss dr prof sir herr herrn frau madame mme monsieur señor señora sr sra don doña signor signora sig dott mevrouw meneer pan pani".split())
_HELLO = r"(?:dear|hi|hello|hey|hallo|hola|bonjour|ciao|cher|chère|liebe[rs]?|estimad[oa]s?|querid[oa]|caro|cara|beste|geachte|good (?:morning|day|afternoon|evening)|guten (?:tag|morgen)|buenos días|buongiorno|sehr geehrte[rs]?)"
_GREETING = re.compile(rf"(?im)^[ \t]*{_HELLO}[ \t]+((?-i:[{_UP}])[^\n,:!.]{{0,40}}?)(?:,[ \t]*([^\n,:!]{{2,30}}))?[,:!.]?[ \t]*$")
_GREET = re.compile(rf"(?im)(?:^|\n)\s*{_HELLO}(?: \w+ (?:and|und|et|y|e|en))?\s+$")
_CLOSING = re.compile(r"(?im)^[ \t]*(?:(?:kind|best|warm|many)? ?(?:regards|wishes|thanks)|thank you|yours \w+|sincerely|cheers|mit (?:freundlichen|besten) grüßen|(?:viele|beste|liebe|freundliche) grüße|cordialement|bien à vous|merci|(?:un )?(?:cordial )?saludos?(?: cordiales)?|atentamente|gracias|cordiali saluti|met vriendelijke groet(?:en)?)[,.! ]*\r?\n+[ \t]*([^\n\d@]{2,40}?)[ \t]*\r?$")
_NAMED = re.compile(rf"(?i)\b(?:attn|attention|contact|kontakt|contacto|name|nom|nombre|nome|z\. ?hd\.?|ansprechpartner(?:in)?)\.?: *((?-i:[{_UP}])[^\n\d@,:]{{2,40}})")
_FAMILY = re.compile(rf"\.? ([{_UP}][^\W\d_]+(?:['’-][^\W\d_]+)*)")
_INITIAL = re.compile(rf"(?<![\w.])(?:[{_UP}]\. ?){{1,3}} ?[{_UP}][^\W\d_]+(?:['’-][^\W\d_]+)*")
_CAPITAL = re.compile(rf"(?<![\w@])[{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*\.?(?: [{_UP}][^\W\d_]*(?:['’-][^\W\d_]+)*\.?)+")
_WORD = re.compile(_W)
_MIDDLE = re.compile(rf"(?: [{_UP}]\.)+")
_NEXT_WORD = re.compile(rf" {{1,2}}({_W})")
_COMMA_BEFORE = re.compile(rf"({_W}), $")
_WORD_BEFORE = re.compile(rf"({_W}) $")
# Labels of numbers of persons, of numbers of things and of telephones.
_ID_LABEL = re.compile(
    r"(?i)(?:\b(?:passport|reisepass|passeport|pasaporte|passaporto|pass|id|identity|identité|identidad|identificación|ident\w*|(?:personal)?ausweis\w*|badge|dni|nie|nif|cif|rut|cpf|nino|ssn|nhs|social security|national insurance|insurance|versicherung\w*|sozialversicherung\w*"
    r"|sécurité sociale|seguridad social|tax|tin|steuer\w*|fiscale?|documento|cédula|licen[cs]e|führerschein|permis|permiso|employee|personalnummer|matricule|(?:customer|client|patient|member|kunden\w*|mitglied\w*)(?: (?:id|number|no|nr))?)\b)"
)
_THING_LABEL = re.compile(
    r"(?i)\b(?:part|item|article|artikel|artículo|art|sku|lot|los|lote|batch|charge|serial|serie|série|seriennummer|model|modell|firmware|version|folio|sheet|page|blatt|seite|ratio|ref|reference|referenz|référence|referencia|invoice|rechnung\w*|facture|factura|order|bestell\w*|commande|pedido"
    r"|tracking|sendung\w*|envío|account|konto|compte|cuenta|iban|doc|quotation|angebot|devis|replaces|pallet|container|vin|isbn|ean)\b"
)
_PHONE_LABEL = re.compile(r"(?i)\b(?:phone|tel|teléfono|téléphone|telefon\w*|telephone|mobile|mobil|handy|cell|fax|ring|call\w*|dial|rückruf|llam\w+|appel\w+)\b")
_HOME_LABEL = re.compile(r"(?i)(?:\b(?:address|adresse|anschrift|dirección|indirizzo|adres|ship to|deliver to|lives? at|live at|wohn\w+|residence|domicile|domicilio)\b[^\n.]{0,20})$")
_CLAUSE = re.compile(r"(?:[.!?;]\s|\n|: (?=[A-Z]))")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Lexicon:
    """Given names, ordinary words, and what the corpus tells about neighbours and forms."""

    def __init__(self, given: Iterable[str], common: Iterable[str], contexts: dict[tuple[str, str, str], int] | None = None):
        g = {x.lower() for x in given}
        g |= {fold(x) for x in g}
        # short forms of the given names that are known
        g |= {k for k, v in NICKNAMES.items() if v in g}
        self.given = g
        self.common = set(common)
        self.contexts = contexts or {}
        self._index = None

    def __getstate__(self) -> dict:
        return {"given": self.given, "common": self.common, "contexts": self.contexts, "_index": None}

    def known(self, low: str) -> Iterable[tuple[int, int]]:
        """Places of given names and titles in a text written small, whole words only."""
        if self._index is None:
            import ahocorasick

            self._index = ahocorasick.Automaton()
            for w in self.given | _TITLES:
                self._index.add_word(w, len(w))
            self._index.make_automaton()
        n = len(low)
        for last, size in self._index.iter(low):
            a, b = last + 1 - size, last + 1
            if (a and (low[a - 1].isalpha() or low[a - 1] in "_" or low[a - 1] in "'’-" and a > 1 and low[a - 2].isalpha())) or (b < n and (low[b].isalpha() or low[b] == "_" or low[b] in "'’-" and b + 1 < n and low[b + 1].isalpha())):
                continue
            yield a, b

    def is_given(self, w: str) -> bool:
        return w.lower() in self.given

    def rare(self, w: str) -> bool:
        """True if no part of a word is an ordinary word of the corpus."""
        return all(p and p not in self.common for p in w.lower().split("-"))

    def named(self, w: str) -> bool:
        """True for a word that may be a part of an unknown person's name."""
        low = w.lower().rstrip(".")
        return len(low) > 1 and low not in LEGAL and low not in _TITLES and self.rare(low) and not low.endswith(_SUFFIX[:11])


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    return any(x < b and a < y for x, y in spans)


def candidates(text: str, lex: Lexicon) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, shape) of every span worth judging."""
    out = []
    mails: list[tuple[int, int]] = []
    for m in (_AT_WORDS if " dot " in text.lower() else _AT).finditer(text):
        sign, gap = m.group(), m.start()
        words = sign[0] == " "
        if not words and text[gap - 1 : gap] == " ":
            gap -= 1
        left = _LOCAL.search(text[max(0, gap - 80) : gap])
        if not left or (mails and gap < mails[-1][1]):
            continue
        after = m.end() + (not words and text[m.end() : m.end() + 1] == " ")
        right = (_DOMAIN if sign == "@" else _DOMAIN_WORDS if words else _DOMAIN_SPELLED).match(text, after)
        if right:
            start = gap - len(left.group())
            mails.append((start, right.end()))
            out.append(("email", start, right.end(), "at" if sign == "@" else "words"))
    numbers = [m.span() for m in _DIGITS.finditer(text)]
    taken = list(mails)
    reached = 0
    for a, _ in numbers:
        s = a - 1 if a and text[a - 1] in "+(" else a
        m = _PHONE.match(text, s) if s >= reached else None
        if not m and s < a and a >= reached:  # a bracket around the number is not part of it
            s, m = a, _PHONE.match(text, a)
        if m:
            reached = m.end()
            if not _overlaps(mails, s, reached):
                out.append(("phone", s, reached, _shape(m.group())))
                taken.append((s, reached))
    reached = 0
    for a, b in numbers:
        if a < reached or b - a > 6 or (a and (text[a - 1].isalpha() or text[a - 1] == "_")):
            continue
        left = text[max(0, a - 60) : a]
        span = None
        road = _NUMBER_ROAD.match(text, a) if b - a <= 4 else None
        word = left.rstrip()[-14:].lower()
        if road:
            room = _ROOM_BEFORE.search(left)
            span = (a - len(left) + room.start() if room else a, road.end())
        elif left.endswith(" ") and word.endswith(_SUFFIX):
            m, end = _SUFFIX_NUMBER.search(left), _LETTER_AFTER.match(text, a)
            if m and end:
                s = m.start() if not lex.common or m.group().count(" ") < 2 or lex.rare(m.group().split(" ")[0]) else m.start() + m.group().index(" ") + 1
                if s and m.group().count(" ") == 2 and not left[s:].split(" ")[0].endswith(("er", "e", "es", "en")):
                    s = m.start() + m.group().index(" ") + 1
                whole = left[s:].strip().lower()
                span = (a - len(left) + s, end.end()) if not any(whole == x for x in _SUFFIX) else None
        elif word.endswith(("box", "postfach", "postbus", "apartado", "correos", "postale", "bp")):
            box = _BOX_BEFORE.search(left)
            span = (a - len(left) + box.start(), b) if box and not text[b : b + 1].isalnum() else None
        elif left[-1:] in " ," and not _ROAD_WORDS.isdisjoint(left.lower().split()):
            m, end = _BEFORE_NUMBER.search(left), _LETTER_AFTER.match(text, a)
            span = (a - len(left) + m.start(), end.end()) if m and end else None
        if span and not _overlaps(mails, *span):
            reached = span[1]
            out.append(("street_address", *span, _shape(text[span[0] : span[1]])))
            taken.append(span)
    reached = 0
    for a, b in numbers:
        if a < reached:
            continue
        s = a
        while s and s > a - 3 and text[s - 1].isupper():
            s -= 1
        if s == a and a > 1 and text[a - 1] in " -":
            s = a - 1
            while s and s > a - 4 and text[s - 1].isupper():
                s -= 1
            s = a if s == a - 1 else s
        if s and (text[s - 1].isalnum() or text[s - 1] in "_/@.-,"):
            s = a
            if s and (text[s - 1].isalnum() or text[s - 1] in "_/@.-,"):
                continue
        m = _CODE.match(text, s) or (_CODE.match(text, a) if s < a else None)
        if not m:
            continue
        a0, b0 = m.span()
        digits = sum(c.isdigit() for c in m.group())
        if digits < 5 or digits > 14 or _DATE.fullmatch(m.group()) or _AMOUNT.fullmatch(m.group()) or _MONEY_BEFORE.search(text[max(0, a0 - 5) : a0]) or _MONEY_AFTER.match(text, b0):
            continue
        if " " in m.group() and digits < 8 and not m.group()[0].isalpha():
            continue
        reached = b0
        if not _overlaps(taken, a0, b0):
            out.append(("id_number", a0, b0, _shape(m.group())))
            taken.append((a0, b0))
    for m in _INITIAL.finditer(text):
        last = m.group().rsplit(" ", 1)[-1].rsplit(".", 1)[-1]
        if last and lex.rare(last) and not _overlaps(mails, m.start(), m.end()):
            out.append(("name", m.start(), m.end(), "initial"))
    known: list[tuple[int, int]] = []
    low = _lower(text)
    for a, b in lex.known(low):
        w = text[a:b]
        if low[a:b] in _TITLES:
            m = _FAMILY.match(text, b)
            if m and m.group(1).lower() not in _TITLES and not lex.is_given(m.group(1)) and lex.rare(m.group(1)):
                out.append(("name", m.start(1), m.end(1), "titled"))
                known.append(m.span(1))
            if low[a:b] not in lex.given:
                continue
        if _overlaps(mails, a, b):
            continue
        start, end, shape = a, b, "lone"
        middle = _MIDDLE.match(text, b)
        at = middle.end() if middle else b
        after = _NEXT_WORD.match(text, at)
        before = text[max(0, a - 40) : a]
        turned = _COMMA_BEFORE.search(before) if before.endswith(", ") else None
        caps = _WORD_BEFORE.search(before) if before.endswith(" ") and not turned else None
        if after and len(after.group(1)) > 2 and lex.rare(after.group(1)) and (after.group(1)[0].isupper() or w.islower()) and not lex.is_given(after.group(1)):
            end, shape = after.end(1), "full"
        elif turned and len(turned.group(1)) > 2 and turned.group(1)[0].isupper() == w[0].isupper() and lex.rare(turned.group(1)) and not lex.is_given(turned.group(1)):
            start, shape = a - len(before) + turned.start(1), "turned"
            end = at
        elif caps and len(caps.group(1)) > 2 and caps.group(1).isupper() and not w.isupper() and lex.rare(caps.group(1)):
            start, shape = a - len(before) + caps.start(1), "turned"
        out.append(("name", start, end, shape))
        known.append((start, end))
    for m in _CAPITAL.finditer(text):  # persons the gazetteer does not know
        if _overlaps(known, *m.span()) or _overlaps(taken, *m.span()):
            continue
        words = [(m.start() + x.start(), x.group()) for x in re.finditer(r"\S+", m.group())]
        while words and not lex.named(words[0][1]):
            words = words[1:]
        if 2 <= len(words) <= 4 and all(len(w.rstrip(".")) == 1 or lex.named(w) for _, w in words) and not any(w.endswith(".") and len(w) > 2 for _, w in words[:-1]):
            a, end = words[0][0], words[-1][0] + len(words[-1][1].rstrip("."))
            out.append(("name", a, end, "pair"))
    for m in _GREETING.finditer(text):
        for g in (1, 2):
            if m.group(g) and " " not in m.group(g).strip() and not _overlaps(known, *m.span(g)) and lex.named(m.group(g)) and m.group(g).strip()[0].isupper():
                out.append(("name", m.start(g), m.start(g) + len(m.group(g).rstrip()), "lone"))
    return out


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", lambda w: "a" if len(w.group()) > 3 else "a" * len(w.group()), re.sub(r"\d+", lambda d: str(len(d.group())), s))[:24]


LABELERS = ("form", "gazetteer", "label", "person", "thing", "alone", "left", "right", "shape")
_THING = 4


def group(kind: str, shape: str) -> str:
    """Lone given names are judged among themselves, all else by kind."""
    return "name.lone" if kind == "name" and shape == "lone" else kind


def beside(text: str, a: int, b: int) -> tuple[str, str]:
    """The word (or the mark) on either side of a span."""
    left = text[max(0, a - 24) : a]
    words = _WORD.findall(left)
    tail = left[left.rfind(words[-1]) + len(words[-1]) :] if words else left
    one = "\n" if "\n" in tail or not left else "." if tail[:1] in ".!?" else "0" if any(c.isdigit() for c in tail) else (words[-1].lower() if words else tail[-1:])
    right = text[b : b + 24]
    mark = right[:1]
    if not right or right.lstrip(" .\r")[:1] in ("", "\n"):
        return one, "\n"
    if mark in ".,:;()/!?":
        return one, mark
    nxt = _WORD.search(right)
    return one, nxt.group().lower() if nxt and nxt.start() <= 2 else right.strip()[:1]


def _checks(s: str) -> bool:
    """True if the digits of a number agree with its check digit under a rule in public use."""
    d = [int(c) for c in s if c.isdigit()]
    bare = re.sub(r"[ .-]", "", s).upper()
    if re.fullmatch(r"\d{7,8}[\dK]", bare) and "-" in s:  # modulus 11
        rest = 11 - sum(int(c) * (2 + i % 6) for i, c in enumerate(reversed(bare[:-1]))) % 11
        return bare[-1] == {10: "K", 11: "0"}.get(rest, str(rest))
    if re.fullmatch(r"\d{8}[A-Z]", bare):  # modulus 23
        return bare[-1] == "TRWAGMYFPDXBNJZSQVHLCKE"[int(bare[:-1]) % 23]
    if re.fullmatch(r"[A-Z]{2}\d{6}[A-D]", bare):
        return True
    if len(d) in (10, 12) and bare.isdigit() and len(s) > len(d):  # Luhn
        return sum(x if i % 2 else (2 * x) // 10 + (2 * x) % 10 for i, x in enumerate(d[-10:])) % 10 == 0
    return False


def votes(text: str, kind: str, a: int, b: int, shape: str, lex: Lexicon, left: str | None = None, right: str | None = None) -> list[int]:
    """One vote per labeler: 1 for, -1 against, 0 abstains."""
    v = _static(text, kind, a, b, shape, lex)
    if left is None or right is None:
        left, right = beside(text, a, b)
    return v + told(group(kind, shape), left, right, shape, lex.contexts)


def told(g: str, left: str, right: str, shape: str, contexts: dict) -> list[int]:
    return [contexts.get((g, "l", left), 0), contexts.get((g, "r", right), 0), contexts.get((g, "s", shape), 0) if g in ("id_number", "phone") else 0]


def _static(text: str, kind: str, a: int, b: int, shape: str, lex: Lexicon) -> list[int]:
    before, after, s = text[max(0, a - 60) : a], text[b : b + 40], text[a:b]
    line_start = text.rfind("\n", 0, a) + 1
    line_end = text.find("\n", b)
    alone = text[line_start:a].strip() == "" and text[b : line_end if line_end >= 0 else len(text)].strip() in ("", ",")
    v = [0] * 6
    if kind == "name":
        v[0] = 1 if shape in ("full", "turned", "titled", "initial") else 0
        v[1] = 1 if shape != "lone" and any(lex.is_given(w) for w in _WORD.findall(s)) else 0
        v[2] = 1 if _GREET.search(before) or _WORD.findall(before)[-1:] and _WORD.findall(before)[-1].lower() in _TITLES and before.endswith((" ", ".")) else 0
        nxt = _NEXT_WORD.match(after)
        if nxt and (nxt.group(1).lower() in LEGAL or re.match(rf"(?i) {_ROAD}\b", after) or (shape == "pair" and nxt.group(1)[0].isupper())):
            v[_THING] = -1
    else:
        clause = _CLAUSE.split(before)[-1]
        near = clause[-40:]
        thing = _THING_LABEL.search(clause)
        if kind == "email":
            v[0] = 1
            v[1] = 1 if re.search(r"(?i)[a-z]{2,}$", s) else -1
        elif kind == "phone":
            v[0] = 1 if sum(c.isdigit() for c in s) >= 9 else -1
            v[2] = 1 if _PHONE_LABEL.search(near) else 0
            money = _MONEY_BEFORE.search(before[-5:]) or _MONEY_AFTER.match(after)
            v[_THING] = -1 if money or (thing and not v[2] and before[thing.end() - len(clause) :].count(" ") < 4) else 0
        elif kind == "id_number":
            v[0] = 1 if _checks(s) else 0
            v[2] = 1 if _ID_LABEL.search(near) else 0
            v[3] = 1 if _PERSON.search(after) or _PERSON.search(near[:-1]) else 0
            v[_THING] = -1 if thing else 0
        else:
            v[0] = 1
            v[2] = 1 if _HOME_LABEL.search(before) else 0
            v[3] = 1 if _PERSON.search(near) else 0
    v[5] = 1 if alone and not (kind == "name" and shape == "lone" and s.islower()) else 0
    return v


_PERSON = re.compile(rf"\b[{_UP}][^\W\d_]*\.? (?:[{_UP}]\. )?[{_UP}][^\W\d_]+")
_WIDTH = 1024


def features(kind: str, shape: str, left: str, right: str, v: Sequence[int]) -> list[int]:
    """Active positions of the classifier's feature vector (hashed to a fixed width)."""
    g = group(kind, shape)
    names = [g, f"{g}:{shape}", f"{g}<{left}", f"{g}>{right}", *(f"{g}#{LABELERS[j]}{x}" for j, x in enumerate(v) if x)]
    return [zlib.crc32(n.encode()) % _WIDTH for n in names]


def reliabilities(v: np.ndarray, rounds: int = 30, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(true positive rates, false positive rates, prior, posteriors) by EM over votes.

    A vote of 0 is a third outcome with its own rates, so an abstention can tell something too.
    Row i of the votes stands for ``times[i]`` candidates (1 by default).
    """
    k = v.shape[1]
    times = np.ones(len(v)) if times is None else times
    n = times.sum()
    score = v.sum(1) + 2.0 * v[:, _THING]
    post = np.where(score > 1, 0.95, np.where(score < 0, 0.05, 0.6))
    rates = np.zeros((2, k, 3))
    prior = 0.5
    for _ in range(rounds):
        prior = float(np.clip(((post * times).sum() + 2) / (n + 4), 0.05, 0.98))
        for c, w in enumerate(((1 - post) * times, post * times)):
            for x in (-1, 0, 1):
                # a vote against is known to be stronger evidence than its absence
                rates[c, :, x + 1] = ((v == x) * w[:, None]).sum(0) + (4.0 if (c == 1) == (x == 1) and x else 0.5)
            rates[c] /= rates[c].sum(1, keepdims=True)
        log = np.log([1 - prior, prior])[None, :].repeat(len(v), 0)
        for j in range(k):
            log += np.log(rates[:, j, :][:, v[:, j] + 1]).T
        post = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -30, 30)))
    return rates[1], rates[0], prior, post


def train(rows: list[tuple[str, str, str, str, list[int]]], patterns: dict[tuple, int] | None = None, steps: int = 300) -> np.ndarray:
    """Weights of the span classifier from (kind, shape, left, right, votes) of sample candidates.

    Targets are the labelers' aggregated votes. ``patterns`` counts (group, votes) over the whole
    corpus for the estimate of the labelers; without it the sample itself is counted. Persons the
    gazetteer knows are trained on a second time without it, so that unknown ones are judged by the rest,
    and numbers a second time without their form and neighbours.
    """
    if not rows:
        return np.zeros(_WIDTH + 1)
    groups = [group(k, s) for k, s, *_ in rows]
    patterns = patterns or Counter((g, *r[4]) for g, r in zip(groups, rows))
    target = np.zeros(len(rows))
    for g in sorted(set(groups)):
        at = [i for i, x in enumerate(groups) if x == g]
        seen = sorted(p for p in patterns if p[0] == g)
        times = np.array([patterns[p] for p in seen], dtype=float)
        # weighed as the sample is: the prior counts keep their strength whatever the size of the corpus
        times *= min(1.0, len(at) / times.sum())
        post = dict(zip(seen, reliabilities(np.array([p[1:] for p in seen]), times=times)[3]))
        target[at] = [post[(g, *rows[i][4])] for i in at]
    active = [features(k, s, le, ri, v) for k, s, le, ri, v in rows]
    hidden = [i for i, (k, s, *_, v) in enumerate(rows) if k == "name" and s == "full"]
    active += [features("name", "pair", rows[i][2], rows[i][3], [0, 0, *rows[i][4][2:]]) for i in hidden]
    # and numbers without their form and neighbours, so that a label decides about a form never seen
    bare = [i for i, r in enumerate(rows) if r[0] == "id_number"]
    active += [features("id_number", "", "", "", [0, *rows[i][4][1:6], 0, 0, 0]) for i in bare]
    target = np.concatenate([target, target[hidden], target[bare]])
    x = np.zeros((len(active), _WIDTH + 1), dtype=np.float32)
    for i, f in enumerate(active):
        x[i, f] = 1
        x[i, _WIDTH] = 1
    w = np.zeros(_WIDTH + 1, dtype=np.float32)
    grad2 = np.full(_WIDTH + 1, 1e-6, dtype=np.float32)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - target).astype(np.float32) / len(active) + 1e-4 * w
        grad2 += g * g
        w -= 0.5 * g / np.sqrt(grad2)
    return w


def resolve(found: Iterable[tuple], contexts: dict, w: Sequence[float]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the candidates that are accepted; no two overlap, numbers come before names."""
    scored = []
    for kind, a, b, shape, left, right, _, v in found:
        f = set(features(kind, shape, left, right, [*v, *told(group(kind, shape), left, right, shape, contexts)]))
        s = w[_WIDTH] + sum(w[i] for i in f)
        if s > 0:
            scored.append((kind == "name", -(b - a), -s, (kind, a, b)))
    taken: list[tuple[int, int]] = []
    out = []
    for _, _, _, (kind, a, b) in sorted(scored):
        if not _overlaps(taken, a, b):
            taken.append((a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda r: r[1])


def judged(text: str | None, lex: Lexicon) -> list[tuple]:
    """(kind, start, end, shape, left, right, filling word, votes of the labelers that see the text alone)."""
    if not text:
        return []
    out = []
    for kind, a, b, shape in candidates(text, lex):
        left, right = beside(text, a, b)
        out.append((kind, a, b, shape, left, right, text[a:b].lower() if group(kind, shape) == "name.lone" else "", _static(text, kind, a, b, shape, lex)))
    return out


def find(text: str | None, lex: Lexicon, w: Sequence[float]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the mentions of a text; no two overlap."""
    return resolve(judged(text, lex), lex.contexts, w)


def replace(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if text is None:
        return None
    parts, at = [], 0
    for kind, a, b in spans:
        parts += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join(parts) + text[at:]


# ---- what the corpus tells ---------------------------------------------------------------------
_SMALL = re.compile(r"\b[a-zà-öø-ÿ]{2,}\b")
_ANY = re.compile(r"[a-zà-öø-ÿ]{2,}")
_PAIRED = re.compile(rf"(?<![\w@.'’-])([{_UP}][a-zà-öø-ÿ]+) (?:[{_UP}]\. )?([{_UP}][^\W\d_]+)(?![\w'’@])")
_PAIRED_SMALL = re.compile(r"(?m)^[ \t]*([a-zà-öø-ÿ]{3,}) ([a-zà-öø-ÿ]{3,})[ \t\r]*$")
_TURNED = re.compile(rf"(?<![\w@.'’-])([{_UP}][^\W\d_]+)(,? )([{_UP}][a-zà-öø-ÿ]+)(?![\w'’@])")
_BOX = re.compile(r"([a-z]{3,})(?:[._+-]([a-z]{3,}))?\d*(?=@)")
_TITLED = re.compile(rf"(?i)\b(?:{'|'.join(sorted(_TITLES))})\.? ((?-i:[{_UP}])[^\W\d_]+)")


def _tally(texts: Iterable[str]) -> list[tuple[str, str, int, int, int, int]]:
    """(w, next, texts, written small, name slots, family slots): of words (next is ''), and of pairs of words."""
    df: Counter = Counter()
    small: Counter = Counter()
    slot: Counter = Counter()
    family: Counter = Counter()
    pairs: Counter = Counter()
    n = 0
    for t in texts:
        n += 1
        low = _lower(t)
        seen = set(_ANY.findall(low))
        df.update(seen)
        small.update(set(_SMALL.findall(t)))
        own: set[str] = set()
        for m in _GREETING.finditer(t):
            own.update(_ANY.findall(" ".join(x for x in m.groups() if x).lower()))
        for rule in (_CLOSING, _NAMED):
            for m in rule.finditer(t):
                if m.group(1).count(" ") < 3:
                    own.update(_ANY.findall(m.group(1).lower()))
        if "@" in t:
            for m in _BOX.finditer(low):
                own.update(x for x in m.groups() if x)
        slot.update(own)
        last = {w for m in _TITLED.finditer(t) for w in _ANY.findall(m.group(1).lower())} if not _TITLES.isdisjoint(seen) else set()
        last |= {w for m in _INITIAL.finditer(t) for w in _ANY.findall(m.group().lower())}
        family.update(last)
        two = set()
        for rule in (_PAIRED, _PAIRED_SMALL):
            for m in rule.finditer(t):
                two.add((m.group(1).lower(), m.group(2).lower()))
        for m in _TURNED.finditer(t):  # "Family, Given" and "FAMILY Given"
            if m.group(2) == ", " or m.group(1).isupper():
                two.add((m.group(3).lower(), m.group(1).lower()))
        pairs.update(two)
    return [("", "", n, 0, 0, 0)] + [(w, "", c, small[w], slot[w], family[w]) for w, c in df.items()] + [(a, b, c, 0, 0, 0) for (a, b), c in pairs.items()]


def _least(k: Column, n: int) -> Column:
    """A cautious estimate of a rate from k of n, one deviation below it; 0 for a single case."""
    return (k - F.sqrt(k)) / n


def learnt(documents: DataFrame, share: float = 0.003, low_share: float = 0.0006, name_share: float = 0.00001, given: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """(given names, ordinary words) of the corpus, from counts over every document.

    Ordinary words are in a share of all texts, or written small in a smaller share of them; rates
    are estimated cautiously, so that a word is judged alike at every size of the corpus and one
    text alone proves nothing. A given name stands directly before (or, turned, behind) three or more
    different words that are not ordinary, in a fifth of its texts or more, and once at least in a place
    made for names: a greeting, below a closing formula, behind a label, in an e-mail address. A beginning of such
    a name that stands there in a fifth of its texts, twice or more, is a short form of it. A word that mostly stands beside given names, titles or initials is a family name and not ordinary.

    ``given`` (column ``name``) adds the first words of the caller's names, those of one name in
    10,000 or more. The shares bound both lists (a text of k words adds to k shares), so no word is
    left out by a cap. Copies of a text count once. Empty tables give empty lists.
    """

    def tally(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(_tally(batch["text"]), columns=["w", "nxt", "df", "small", "slot", "family"])

    # one row per word and batch: counted before anything is shuffled
    texts = documents.filter("text is not null").select("text").distinct()
    counts = cut(texts.mapInPandas(tally, "w string, nxt string, df bigint, small bigint, slot bigint, family bigint").groupBy("w", "nxt").agg(*[F.sum(c).alias(c) for c in ("df", "small", "slot", "family")]))
    n = counts.filter("w = ''").agg(F.max("df")).first()[0] or 0
    if not n:
        return [], []
    words = counts.filter("w <> '' and nxt = ''").drop("nxt")
    often = (_least(F.col("df"), n) >= share) | (_least(F.col("small"), n) >= low_share)
    words = words.withColumn("often", often)
    pairs = counts.filter("nxt <> ''").select(F.col("w").alias("g"), F.col("nxt").alias("w"), F.col("df").alias("both"))
    plain = words.filter("often").select("w")
    legal = list(LEGAL | _TITLES)
    beside_rare = pairs.join(plain, "w", "left_anti").filter(~F.col("w").isin(legal) & (F.length("w") > 2))
    first = beside_rare.groupBy("g").agg(F.count("*").alias("different"), F.sum("both").alias("before"))
    names = first.join(words.withColumnRenamed("w", "g"), "g").filter(~F.col("g").isin(legal) & (F.length("g") > 2))
    names = names.filter((F.col("different") >= 3) & (F.col("before") >= 0.2 * F.col("df")) & (F.col("slot") > 0) & (F.col("small") < 0.5 * F.col("df")) & (F.col("before") / n >= name_share))
    names = names.select("g")
    if given is not None:
        heads = given.filter("name is not null").select(F.lower(F.regexp_extract("name", r"^\s*([^\W\d_]{2,}(?:['’-][^\W\d_]+)*)\s+\S", 1)).alias("g")).filter("g <> ''").groupBy("g").agg(F.count("*").alias("k"))
        total = heads.agg(F.sum("k")).first()[0] or 0
        names = names.unionByName(heads.filter(F.col("k") >= total / 10_000).select("g")).distinct()
    # short forms: beginnings of these names that stand mostly in places made for names
    starts = names.select(F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.length("g") - 1, F.lit(2))), lambda i: F.substring(F.col("g"), F.lit(1), i))).alias("w")).distinct()
    short = words.join(starts, "w").filter((F.col("slot") >= 0.2 * F.col("df")) & (F.col("slot") > 1) & (F.col("slot") / n >= name_share))
    names = cut(names.unionByName(short.select(F.col("w").alias("g"))).distinct())
    related = pairs.join(names, "g").groupBy("w").agg(F.sum("both").alias("related"))
    judged_words = words.join(related, "w", "left").withColumn("named", F.coalesce("related", F.lit(0)) + F.col("family"))
    family = (F.col("small") < 0.5 * F.col("df")) & (F.col("named") >= 0.5 * F.col("df"))
    ordinary = judged_words.filter(F.col("often") & ~family).join(names.withColumnRenamed("g", "w"), "w", "left_anti")
    return sorted(r[0] for r in names.collect()), [r[0] for r in ordinary.select("w").collect()]


def common_words(documents: DataFrame, share: float = 0.003, low_share: float = 0.0006) -> list[str]:
    """The ordinary words of ``learnt``."""
    return learnt(documents, share, low_share)[1]


def _candidate_column(lex: Lexicon) -> Column:
    fields = ("kind", "a", "b", "shape", "left", "right", "fill", "v")

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(fields, c)) for c in judged(t, lex)] for t in texts], index=texts.index)

    return F.pandas_udf(run, CANDIDATES).asNondeterministic()("text")


def learnt_contexts(found: DataFrame, share: float = 0.0003) -> dict[tuple[str, str, str], int]:
    """(group, side, token) -> vote of the words beside candidates and of their forms.

    ``found`` has the candidates of every text (column ``c``). Candidates the plain labelers are sure
    of teach the rest: a token votes for if two thirds of the told cases beside it are true ones,
    against if two thirds are false ones. Beside lone given names the words that fill the place tell:
    a place that many different names fill is one for persons, one that a single word fills, five
    times or more, is none. Tokens of a share of a group's candidates are kept, which bounds the answer.
    """
    c = found.select(F.inline("c"))
    g = _group()
    total = F.aggregate("v", F.lit(0), lambda s, x: s + x)
    # a label, the gazetteer or a check digit speaks for; a label of things against
    spoken = F.get("v", 1) + F.get("v", 2) + F.when(F.col("kind") == "id_number", F.get("v", 0) * 2).when(F.col("kind") == "street_address", F.get("v", 0)).otherwise(0)
    told_ = F.when(F.get("v", _THING) < 0, -1).when((spoken >= 1) & (total >= 1), 1).otherwise(0)
    flat = c.select(g.alias("g"), "fill", told_.alias("t"), F.explode(F.create_map(F.lit("l"), F.col("left"), F.lit("r"), F.col("right"), F.lit("s"), F.col("shape"))).alias("side", "token"))
    fills = flat.groupBy("g", "side", "token", "fill").agg(F.count("*").alias("n"), F.sum((F.col("t") > 0).cast("int")).alias("sure"), F.sum((F.col("t") < 0).cast("int")).alias("against"))
    agg = cut(fills.groupBy("g", "side", "token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.sum("sure").alias("sure"), F.sum("against").alias("against")))
    size = agg.filter("side = 'l'").groupBy("g").agg(F.sum("n").alias("all"))
    rows = agg.join(F.broadcast(size), "g").filter(F.col("n") >= share * F.col("all")).collect()
    out = {}
    for r in rows:
        if r["g"] == "name.lone":
            vote = 0
            if r["side"] != "s" and r["n"] >= 2:
                different = r["n"] ** 2 / r["squares"]
                vote = 1 if different >= 4 else -1 if different < 1.5 and r["n"] >= 5 else 0
        else:
            yes, no = r["sure"], r["against"]
            vote = 1 if yes >= 2 * no and yes > 0 and yes >= 0.1 * r["n"] else -1 if no > 2 * yes and no >= 0.1 * r["n"] else 0
        if vote:
            out[(r["g"], r["side"], r["token"])] = vote
    return out


def vote_patterns(found: DataFrame, contexts: dict) -> dict[tuple, int]:
    """How often each (group, votes) occurs over all candidates; the patterns are few."""
    c = found.select(F.inline("c")).select(_group().alias("g"), "left", "right", "shape", "v")
    c = c.groupBy("g", "left", "right", "shape", "v").agg(F.count("*").alias("n"))
    known = found.sparkSession.createDataFrame([(*k, v) for k, v in contexts.items()], "g string, side string, token string, vote int")
    # one row per token of a least share of the candidates: bounded by that share
    for side, col in (("l", "left"), ("r", "right"), ("s", "shape")):
        c = c.join(F.broadcast(known.filter(F.col("side") == side).select("g", F.col("token").alias(col), F.col("vote").alias(f"_{side}"))), ["g", col], "left")
    form = F.when(F.col("g").isin("id_number", "phone"), F.coalesce("_s", F.lit(0))).otherwise(0)
    seen = c.groupBy("g", F.concat("v", F.array(F.coalesce("_l", F.lit(0)), F.coalesce("_r", F.lit(0)), form)).alias("v")).agg(F.sum("n").alias("n"))
    return {(r["g"], *r["v"]): r["n"] for r in seen.collect()}


def _group() -> Column:
    return F.when((F.col("kind") == "name") & (F.col("shape") == "lone"), F.lit("name.lone")).otherwise(F.col("kind"))


def fitted(documents: DataFrame, sample: int = 1500, given: DataFrame | None = None, key: str = "doc_id") -> tuple[Lexicon, list[float], DataFrame]:
    """(lexicon, weights of the classifier, candidates of every text).

    Lexicon, contexts and labelers' rates come from all documents; the classifier is fitted on the
    candidates of the ``sample`` texts of least hash (those of up to 200 candidates), the only sample.
    A group with few candidates among them adds those of up to 30 texts of its own.
    """
    lex = Lexicon(*learnt(documents, given=given))
    found = cut(documents.filter("text is not null and text <> ''").select(key, F.xxhash64("text").alias("h"), _candidate_column(lex).alias("c")))
    lex.contexts = learnt_contexts(found)
    patterns = vote_patterns(found, lex.contexts)
    total: Counter = Counter()
    for p, n in patterns.items():
        total[p[0]] += n
    few = found.filter(F.size("c").between(1, 200)).select("h", "c")
    taken = {r["h"]: r["c"] for r in sampled(few, sample)}
    drawn = Counter(group(c["kind"], c["shape"]) for cs in taken.values() for c in cs)
    for g in sorted(k for k in total if drawn[k] < min(30, total[k])):  # too rare for the sample: texts of its own
        kind, lone = g.split(".")[0], g.endswith(".lone")
        has = F.exists("c", lambda x: (x["kind"] == kind) & ((x["shape"] == "lone") == F.lit(lone) if kind == "name" else F.lit(True)))
        taken |= {r["h"]: r["c"] for r in sampled(few.filter(has), 30)}
    rows = [(c["kind"], c["shape"], c["left"], c["right"], [*c["v"], *told(group(c["kind"], c["shape"]), c["left"], c["right"], c["shape"], lex.contexts)]) for _, cs in sorted(taken.items()) for c in cs]
    return lex, train(rows, patterns).tolist(), found


def mentions(documents: DataFrame, sample: int = 1500, key: str = "doc_id", given: DataFrame | None = None) -> DataFrame:
    """``(key, kind, span_start, span_end)`` of personal information in ``text``, whole texts.

    ``given`` (column ``name``) is the caller's gazetteer of persons; it may be left out. NULL and
    empty texts have none; repeated rows count once; an empty table has no mention.
    """
    lex, w, found = fitted(documents, sample, given, key)
    contexts, width = lex.contexts, len(LABELERS) - 3

    def run(*columns: pd.Series) -> pd.Series:
        out = []
        for kind, at, end, shape, left, right, v in zip(*columns):
            cs = ((k, int(a), int(b), s, le, ri, "", v[i * width : (i + 1) * width]) for i, (k, a, b, s, le, ri) in enumerate(zip(kind, at, end, shape, left, right)))
            out.append([{"kind": k, "span_start": a, "span_end": b} for k, a, b in resolve(cs, contexts, w)])
        return pd.Series(out, index=columns[0].index)

    # columns of plain arrays reach Python faster than arrays of structs
    pick = lambda f: F.transform("c", lambda x: x[f])
    plain = [pick(f) for f in ("kind", "a", "b", "shape", "left", "right")] + [F.flatten(pick("v"))]
    return found.select(key, F.pandas_udf(run, FOUND).asNondeterministic()(*plain).alias("m")).select(key, F.inline("m")).distinct()


def masked(documents: DataFrame, sample: int = 1500, given: DataFrame | None = None) -> DataFrame:
    """All columns, ``text`` with mentions replaced by typed placeholders and else unchanged."""
    key = documents.columns[0]
    lex, w, _ = fitted(documents, sample, given, key)

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([replace(t, find(t, lex, w)) for t in texts], index=texts.index)

    return documents.withColumn("text", F.pandas_udf(run, "string")("text"))
