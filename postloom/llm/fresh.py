"""Newly written lines of e-mail bodies, by semi-Markov decoding of spans.

A body is a sequence of units (runs of lines of one kind). A segmentation into labelled spans is
scored by the length of each span, by cues at its boundaries, by features of the span as a whole
and by the change of label; the best one is found by dynamic programming.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEW, QUOTE, INTRO, FORWARD, CLOSING, SIGNATURE, DEVICE, NOTICE = range(8)
LABELS = ("new", "quote", "intro", "forward", "closing", "signature", "device", "notice")

_QUOTED = re.compile(r"[ \t]{0,3}(?:[>|]|[^\W\d_]{1,3}>)")
_VERB = r"(?:wrote|writes|schrieb|écrit|a écrit|escribió|ha scritto|scritto|schreef|escreveu|skrev)"
_ON = r"(?:on|am|le|el|il giorno|il|op|em|den|at)"
_INTRO = re.compile(rf"(?i)^(?:{_ON}\b(?=.*\d).{{4,220}}?\b{_VERB}\b.{{0,160}}:|.{{2,160}}?\b{_VERB}\s+{_ON}\b(?=.*\d).{{4,70}}:|[^.!?:;]{{2,80}}\s{_VERB}\s?:)$", re.S)
_FIELD = (
    r"from|sent|date|to|cc|bcc|subject|reply-to|de|envoyé|envoyée|date d'envoi|à|objet|von|gesendet|datum|an|kopie|betreff|"
    r"enviado|fecha|para|asunto|da|inviato|data|a|oggetto|van|verzonden|aan|onderwerp"
)
_OPENS = re.compile(rf"(?i){_ON}\b(?=.*\d)")
_CUE = re.compile(
    rf"""(?ix)^(?:
    (?P<sep>-{{2,}}\s*[^-]*(?:message|nachricht|mensaje|messaggio|bericht|mail)[^-]*-{{2,}}|begin\ forwarded\ message\s*:|(?:anfang\ der\ )?weitergeleitete\ nachricht\s*:|début\ du\ message\ (?:réexpédié|transféré)\s*:|inicio\ del\ mensaje\ reenviado\s*:|inizio\ messaggio\ inoltrato\s*:)$
    |(?P<field>\*?(?:{_FIELD})\*?\s?:\*?(?:\s|$))
    |(?P<dash>--\s?)$
    |(?P<stars>\*{{3,}})$
    |(?P<rule>_{{5,}}|={{4,}}|-{{4,}}|~{{4,}}|\#{{4,}})$
    |(?P<close>(?:(?:(?:with\ )?(?:kind|best|warm|kindest|warmest|many)\s+)?(?:regards|wishes)|best|cheers|(?:many\ |kind\ )?thanks(?:\ again|\ a\ lot|\ in\ advance)?|thank\ you(?:\ very\ much)?|thx|tia|rgds|br|kr|yours(?:\ (?:sincerely|faithfully|truly))?|(?:very\ )?sincerely(?:\ yours)?|all\ the\ best|take\ care
        |mit\ (?:freundlichen|besten|herzlichen|lieben|vielen)\ grü(?:ß|ss)en|(?:freundliche|viele|beste|liebe|herzliche|schöne)\ grü(?:ß|ss)e|mfg|vg|lg|gru(?:ß|ss)|hochachtungsvoll|(?:vielen|besten|herzlichen)\ dank|danke
        |cordialement|(?:bien|très)\ (?:cordialement|à\ vous)|(?:sincères\ |meilleures\ )?salutations(?:\ distinguées)?|bien\ à\ vous|amicalement|merci(?:\ (?:d'avance|beaucoup))?
        |(?:un\ )?(?:cordial\ )?saludos?(?:\ cordial(?:es)?)?|atentamente|(?:muchas\ )?gracias|(?:cordiali|distinti)?\ ?saluti|grazie|(?:met\ )?(?:vriendelijke\ )?groet(?:en|jes)?)[\s,.!–-]*)$
    |(?P<device>(?:sent|written|typed|tapped)\ (?:from|on|with|via)\ (?:my|a|an)\ .{{2,70}}|(?:gesendet\ )?von\ (?:meinem|meiner|unterwegs)\ .{{2,60}}|gesendet\ von\ .{{2,40}}|envoyé\ (?:de|depuis)\ (?:mon|ma)\ .{{2,50}}|enviado\ desde\ mi\ .{{2,50}}|inviato\ (?:da|dal\ mio)\ .{{2,50}}|verzonden\ (?:van|vanaf)\ mijn\ .{{2,50}}|get\ \w+\ for\ \w+)$
    |(?P<notice>disclaimer\b.{{0,40}}$|confidentiality\ (?:notice|note)\b|\[?external\b.{{0,60}}\]$|\[?caution:|(?:this\ is\ an\ )?automat\w+\ (?:message|reply|mail|e-mail)\b)
    )"""
)
# Families of words that legal and automatic notices are made of; two of them make a line one.
_NOTICE_WORDS = (
    "confidential|privileged|vertraulich|confidentiel|confidencial|confidenziale|riservat|vertrouwelijk",
    "intended for|intended only for|intended solely for|addressee|recipient|empfänger|destinat|geadresseerde|bestimmt für",
    "unauthorised|unauthorized|unbefugt|non autoris|no autoriz|disclos|disseminat|distributi|copying|weitergabe|divulga",
    "delete|destroy|notify|löschen|vernichten|supprim|avertir|eliminar|notifier|notifique|cancellare",
    "in error|by mistake|received this|irrtümlich|par erreur|por error|per errore|reached you",
    "liable|liabilit|haftet|haftung|responsab|warrant|guarantee|gewähr",
    "virus|malware|viren",
    "contract|binding|verbindlich|contractuel|vinculante|terms and conditions|subject to",
    "views|opinion|meinung|expressed",
    "registered in|registered office|registered number|registered no|company no|company number|company reg|handelsregister|amtsgericht|siren |siret|vat no|vat reg|ust-id|under no",
    "environment|before printing|umwelt|avant d'imprimer|medio ambiente",
    "do not reply|nicht antworten|ne pas répondre|no responda|unsubscribe|abmelden|désabonner|not monitored",
    "this email|this e-mail|this message|this communication|diese e-mail|diese nachricht|ce message|ce courriel|este mensaje|este correo|questo messaggio|dit bericht|attachment",
)
_notice_index: list = []


def _notice(text: str) -> bool:
    """True for a line with words of two families near each other."""
    if len(text) < 24:
        return False
    if not _notice_index:
        import ahocorasick

        index = ahocorasick.Automaton()
        for n, words in enumerate(_NOTICE_WORDS):
            for w in words.split("|"):
                index.add_word(w, n)
        index.make_automaton()
        _notice_index.append(index)
    last = None
    for end, family in _notice_index[0].iter(text.lower()):
        if last is not None and family != last[1] and end - last[0] < 160:
            return True
        last = (end, family)
    return False


_PRICE = re.compile(r"(?<![\d.])\d[\d,]*[.,]\d\d\s*\|?$|\t")
_PHONE = re.compile(r"(?:^|[\s*/|:,(])(?:\+|\()?\d[\d ().\-/]{6,}\d(?:\s*(?:ext|x)\.?\s*\d+)?\s*$")
_SITE = re.compile(r"(?i)\bwww\.\S+\s*$|^\S+@\S+\.\w+$")
_FIRM = re.compile(r"(?i)\b(?:llc|ltd|inc|co|gmbh|l\.l\.c|limited|incorporated|company|corp|mbh|ag|plc|s\.?a|b\.?v)\.?$")
_PARTS = re.compile(r"^[^.!?|]{2,40}(?: \| [^.!?|]{2,40}){1,3}$|^[^.!?,]{3,40}, [^.!?,]{3,24}$|^[^.!?,]{3,24}, [^.!?,]{3,40}$")
_GREETING = re.compile(r"(?i)^(?:dear|hi|hello|hey|hallo|good (?:morning|afternoon|day|evening)|bonjour|hola|guten (?:tag|morgen)|sehr geehrte\w*|liebe[rs]?|cher|chère|estimad[oa]s?|buenos días|ciao|beste|geachte)\b")

#: Log weights. ``len`` holds, by label, the log probability of a span's number of units; it is
#: re-estimated from all messages by ``fit_lengths``. The others weigh cues and span features.
WEIGHTS: dict = {
    "new.text": 1.0, "new.short": 0.2, "new.cue": -2.0, "new.after_end": -0.4, "new.lone_quote": 1.5, "new.lone_indent": 1.5, "new.quoted": -5.0, "new.indented": -1.5,
    "quote.prefix": 4.0, "quote.indent": 2.5, "quote.lone_number": -4.0, "quote.lone_indent": -3.0,
    "intro.match": 5.0, "intro.before_quote": 2.0, "intro.loose": -2.5,
    "forward.separator": 4.0, "forward.fields": 3.0, "forward.lone_field": -9.0, "forward.unit": 5.0,
    "closing.formula": 4.0, "closing.name": 1.2, "closing.sender": 1.0, "closing.long": -4.0, "closing.gap": -0.8, "closing.bare": -0.5,
    "signature.dash": 4.5, "signature.rule": 3.0, "signature.firm_alone": 2.5, "signature.end_rule": 1.2, "signature.contact": 2.2, "signature.firm": 1.4, "signature.sender": 1.2, "signature.long": -3.0, "signature.none": -5.0, "signature.gap": -2.5, "signature.after_closing": 1.0,
    "device.match": 4.5, "notice.match": 4.5, "notice.more": 3.0, "notice.gap": -9.0, "notice.stars": 3.0, "notice.open_stars": -8.0,
    "turn.closing_new": -0.5, "turn.signature_new": -0.3,
    "len": {
        NEW: (0.0,), QUOTE: (0.0,), FORWARD: (0.0,), INTRO: (0.0,), DEVICE: (0.0,),
        CLOSING: (-1.2, -0.5, -1.6, -3.0), SIGNATURE: (-2.0, -1.2, -0.8, -0.8, -1.0, -1.5, -2.5, -3.5), NOTICE: (-0.8, -0.9, -1.3, -1.8, -2.3, -2.8, -3.3, -3.8),
    },
}


class Unit:
    """A run of lines of one kind: q quoted, i indented, a intro, t text, n short, else a cue name."""

    __slots__ = ("kind", "first", "last", "gap", "text", "count")

    def __init__(self, kind: str, line: int, gap: bool, text: str):
        self.kind, self.first, self.last, self.gap, self.text, self.count = kind, line, line, gap, text, 1


def _contact(s: str) -> bool:
    if len(s) >= 90 or _PRICE.search(s):
        return False
    phone = _PHONE.search(s)
    # nine digits or more: a date has eight
    return bool(phone and sum(c.isdigit() for c in phone.group()) >= 9 or _SITE.search(s) or (" | " in s and _PARTS.match(s)))


def units(lines: list[str]) -> list[Unit]:
    """The units of a body; blank lines belong to none and mark a gap before the next one."""
    n = len(lines)
    intro: dict[int, int] = {}
    for i, line in enumerate(lines):
        t = line.rstrip()
        if t.endswith(":") and len(t) < 240 and not _QUOTED.match(t) and t[0] not in " \t":
            start, whole = None, {}
            for s in (i, i - 1, i - 2, i - 3):
                if s < 0 or not lines[s].strip() or _QUOTED.match(lines[s]):
                    break
                whole[s] = " ".join(x.strip() for x in lines[s : i + 1])
                if _OPENS.match(whole[s]) and _INTRO.match(whole[s]):
                    start = s
                    break
            if start is None:
                for s, joined in whole.items():
                    # a name alone above "<address> wrote on" belongs to it
                    if _INTRO.match(joined) and not joined.startswith("<"):
                        start = s
                        break
            if start is not None:
                intro[start] = i
    out: list[Unit] = []
    gap, i = False, 0
    cur: Unit | None = None
    while i < n:
        line = lines[i]
        s = line.strip()
        if not s:
            gap = True
            i += 1
            continue
        c = line[0]
        if i in intro:
            u = Unit("a", i, gap, s)
            u.last = intro[i]
            out.append(u)
            cur, gap, i = u, False, intro[i] + 1
            continue
        if (c in ">| \t" or ">" in line[:4]) and _QUOTED.match(line):
            kind = "q"
        elif line.startswith("    ") or c == "\t":
            kind = "i"
        else:
            m = _CUE.match(s)
            kind = m.lastgroup if m else ("n" if len(s) <= 42 and s.count(" ") <= 5 and (s[-1] not in ".!?;:" or s.count(" ") <= 2) else "t")
            if kind == "n" and ("\t" in s or _PRICE.search(s)):
                kind = "t"
            if kind in "nt":
                kind = "contact" if _contact(s) else "notice" if _notice(s) else kind
        if cur is not None and kind == cur.kind and (kind in "qi" or (kind == "t" and not gap)):
            cur.last = i
            cur.count += 1
        else:
            cur = Unit(kind, i, gap, s if kind not in "qi" else line)
            out.append(cur)
        gap = False
        i += 1
    return out


def _signature_like(u: Unit, sender: frozenset[str]) -> int:
    """Evidence that a unit belongs to a signature: 2 contact, 1 firm or role, 0 none."""
    if u.kind == "contact":
        return 2
    if len(u.text) < 70 and u.count == 1 and (_FIRM.search(u.text) or _PARTS.match(u.text)):
        return 1
    return 0


def _sender(u: Unit, sender: frozenset[str]) -> bool:
    return bool(sender) and len(u.text) < 70 and any(w in sender for w in re.findall(r"[^\W\d_]{2,}", u.text.lower()))


def _length(lens: dict, label: int, k: int, step: float = -0.15) -> float:
    """Log weight of a span of k+1 units: the fitted lengths, and a geometric tail beyond them."""
    v = lens[label]
    return v[k] if k < len(v) else v[-1] + step * (k - len(v) + 1)


def spans(us: list[Unit], sender: frozenset[str], w: dict) -> Iterable[tuple[int, int, int, float]]:
    """All scored spans (from, to, label, score) over the units."""
    n = len(us)
    quotes = sum(u.kind == "q" for u in us)
    intros = any(u.kind == "a" for u in us)
    lens = w["len"]
    for i, u in enumerate(us):
        k = u.kind
        if k == "q":
            lone = u.count == 1 and quotes == 1 and not intros and re.match(r"\s*[>|]\s?\d", u.text)
            yield i, i + 1, QUOTE, w["quote.prefix"] + (w["quote.lone_number"] if lone else 0)
            yield i, i + 1, NEW, w["new.quoted"] + (w["new.lone_quote"] + 4 if lone else 0)
            continue
        if k == "i":
            lone = u.count == 1
            yield i, i + 1, QUOTE, w["quote.indent"] + (w["quote.lone_indent"] if lone and not (i and us[i - 1].kind == "a") else 0)
            yield i, i + 1, NEW, w["new.indented"] + (w["new.lone_indent"] if lone else 0)
            continue
        yield i, i + 1, NEW, w["new.text"] if k == "t" or (k == "n" and _GREETING.match(u.text)) else w["new.short"] if k in ("n", "field", "rule", "contact") else w["new.cue"]
        if k == "a":
            before = i + 1 < n and us[i + 1].kind in "qi"
            yield i, i + 1, INTRO, w["intro.match"] + (w["intro.before_quote"] if before else w["intro.loose"])
            continue
        if k in ("sep", "field", "rule"):
            fields = {x.text.split(":")[0].strip("* ").lower() for x in us[i + (k != "field") : i + 8 + (k != "field")] if x.kind == "field"} if k == "field" or (i + 1 < n and us[i + 1].kind == "field") else set()
            if k == "sep" or len(fields) >= 2:
                yield i, n, FORWARD, (w["forward.separator"] if k == "sep" else 0) + (w["forward.fields"] if len(fields) >= 2 else w["forward.lone_field"] / 3) + w["forward.unit"] * (n - i)
        if k == "close":
            score = w["closing.formula"]
            yield i, i + 1, CLOSING, score + lens[CLOSING][0] + w["closing.bare"]
            for j in range(i + 1, n):
                x = us[j]
                if x.kind not in ("n", "contact", "t") or (x.kind == "t" and (x.count > 1 or len(x.text) > 60)):
                    break
                if _GREETING.match(x.text):
                    break
                score += (w["closing.name"] if x.kind == "n" else -0.5) + (w["closing.sender"] if _sender(x, sender) else 0) + (w["closing.gap"] if x.gap else 0)
                if len(x.text) > 45:
                    score += w["closing.long"]
                yield i, j + 1, CLOSING, score + _length(lens, CLOSING, j - i, -1.5)
                if score < -6:
                    break
        # within a block of contact lines a signature starts at the first
        inner = k == "contact" and i > 0 and us[i - 1].kind == "contact" and not u.gap
        if k in ("dash", "rule") or k in ("n", "contact", "t") and not inner:
            idle = 0
            score = w["signature.dash"] if k == "dash" else w["signature.rule"] if k == "rule" else 0.0
            evidence = 3 if k == "dash" else 0
            if k == "rule" and us[i].text[0] == "-":
                score -= 1.0
            for j in range(i, n):
                x = us[j]
                if j > i or k not in ("dash", "rule"):
                    if x.kind not in ("n", "contact", "t", "rule", "field") or (x.kind == "t" and (x.count > 1 and k != "dash" or len(x.text) > 75)) or _GREETING.match(x.text):
                        break
                    if x.kind == "field" and not _PHONE.search(x.text):
                        break
                    if j > i and x.gap:
                        score += w["signature.gap"]
                    e = _signature_like(x, sender)
                    if x.kind == "rule":
                        if k != "rule" or x.text[0] != us[i].text[0]:
                            break
                        score += w["signature.end_rule"]
                    elif e:
                        score += w["signature.contact"] if e == 2 else w["signature.firm"]
                    elif x.kind == "t":
                        score += w["signature.long"] / (1 if k != "dash" else 2)
                    if _sender(x, sender):
                        score += w["signature.sender"]
                        e = e or (1 if x.kind == "n" and j > i else 0)
                    evidence += e
                    idle = 0 if e else idle + 1
                need = 2 if k in ("dash", "rule", "contact") else 1
                # a firm or role alone only counts below a closing or at the very end
                lonely = j == i and k in ("n", "t")
                after = i > 0 and (us[i - 1].kind == "close" or (i > 1 and us[i - 1].kind == "n" and us[i - 2].kind == "close"))
                yield i, j + 1, SIGNATURE, score + (max(-1.0, _length(lens, SIGNATURE, j - i, 0.0)) if k == "dash" else _length(lens, SIGNATURE, j - i)) + (0.2 * (j - i) if k == "dash" else 0.0) + (w["signature.none"] if evidence < need else 0) + (w["signature.after_closing"] if after else 0) + (0 if not lonely or after else w["signature.firm_alone"] if x.gap and _FIRM.search(x.text) else -2.0)
                if x.kind == "rule" and j > i:
                    break
                # evidence this far behind never makes up for what lies between; a -- line covers all below it
                if k != "dash" and (idle > 8 or score < -12):
                    break
        if k == "device":
            yield i, i + 1, DEVICE, w["device.match"]
        if k == "notice" or k == "stars":
            score = w["notice.match"] if k == "notice" else w["notice.open_stars"]
            yield i, i + 1, NOTICE, score + lens[NOTICE][0]
            for j in range(i + 1, n):
                x = us[j]
                if x.gap and k != "stars":
                    break
                if k == "stars" and x.kind == "stars":
                    score += w["notice.stars"] - w["notice.open_stars"] + w["notice.match"]
                elif x.kind in ("q", "i", "a", "sep", "dash", "close"):
                    break
                else:
                    score += w["notice.more"] + (2.5 if x.kind == "notice" else 0)
                yield i, j + 1, NOTICE, score + _length(lens, NOTICE, j - i)
                if k == "stars" and x.kind == "stars":
                    break


def decode(us: list[Unit], sender: frozenset[str], w: dict | None = None) -> list[tuple[int, int, int]]:
    """Best segmentation (from, to, label) of the units."""
    w = w or WEIGHTS
    n = len(us)
    best: list[dict[int, tuple[float, tuple | None]]] = [{} for _ in range(n + 1)]
    best[0][-1] = (0.0, None)
    ending: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for i, j, label, score in spans(us, sender, w):
        ending[j].append((i, label, score))
    cn, sn = w["turn.closing_new"], w["turn.signature_new"]
    for j in range(1, n + 1):
        here = best[j]
        for i, label, score in ending[j]:
            for prev, (base, _) in best[i].items():
                s = base + score
                if label == NEW:
                    s += cn if prev == CLOSING else sn if prev == SIGNATURE else 0.0
                old = here.get(label)
                if old is None or s > old[0]:
                    here[label] = (s, (i, prev))
    out, j = [], n
    if not n:
        return out
    label = max(best[n], key=lambda x: (best[n][x][0], -x))
    while j:
        i, prev = best[j][label][1]
        out.append((i, j, label))
        j, label = i, prev
    return out[::-1]


def labels(body: str | None, name: str | None = None, w: dict | None = None) -> list[int]:
    """Label of every line (NEW for blank ones)."""
    lines = [x[:-1] if x.endswith("\r") else x for x in (body or "").split("\n")]
    us = units(lines)
    out = [NEW] * len(lines)
    sender = frozenset(t for t in re.findall(r"[^\W\d_]{3,}", (name or "").lower()))
    for i, j, label in decode(us, sender, w):
        if label != NEW:
            for k in range(us[i].first, us[j - 1].last + 1):
                out[k] = label
    return out


def not_new(body: str | None, name: str | None = None, w: dict | None = None) -> list[int]:
    """Numbers of the lines the sender did not newly write; blank lines never count."""
    if not body:
        return []
    lines = body.split("\n")
    return [k for k, label in enumerate(labels(body, name, w)) if label != NEW and lines[k].strip()]


def lengths(body: str | None, name: str | None, w: dict) -> list[tuple[int, int]]:
    """(label, place in the label's list of lengths) of every span whose length is fitted."""
    us = units([x[:-1] if x.endswith("\r") else x for x in (body or "").split("\n")])
    most = {label: len(v) for label, v in w["len"].items()}
    return [(label, min(j - i, most[label]) - 1) for i, j, label in decode(us, frozenset(re.findall(r"[^\W\d_]{3,}", (name or "").lower())), w) if most[label] > 1]


class Corpus:
    """The different (body, name) of a table of messages: iterated here, or counted by the tasks that read them."""

    def __init__(self, messages: DataFrame):
        self.rows = messages.filter("body_text is not null").select("body_text", "from_name")

    def __iter__(self) -> Iterator[tuple[str, str | None]]:
        return (tuple(r) for r in self.rows.distinct().toLocalIterator())

    def lengths(self, w: dict) -> Counter:
        """How often each (label, place) occurs; copies count once. No text leaves its task, only a hash of it."""

        def run(bodies: pd.Series, names: pd.Series) -> pd.Series:
            return pd.Series([[label * 100 + k for label, k in lengths(b, n, w)] for b, n in zip(bodies, names)], index=bodies.index)

        copy = F.unhex(F.md5(F.concat(F.md5("body_text"), F.coalesce("from_name", F.lit("")))))
        hits = self.rows.select(copy.alias("copy"), F.pandas_udf(run, "array<int>").asNondeterministic()("body_text", "from_name").alias("hits")).filter("size(hits) > 0")
        once = hits.groupBy("copy").agg(F.any_value("hits").alias("hits"))
        return Counter({divmod(r[0], 100): r[1] for r in once.select(F.explode("hits").alias("hit")).groupBy("hit").count().collect()})


def fit_lengths(rows: Iterable[tuple[str, str]], rounds: int = 2, w: dict | None = None) -> dict:
    """Weights with span lengths re-estimated by hard expectation-maximisation over (body, name)."""
    w = dict(w or WEIGHTS)
    rows = rows if isinstance(rows, Corpus) else list(rows)
    for _ in range(rounds):
        counts = {label: [1.0] * len(v) for label, v in w["len"].items()}
        hits = rows.lengths(w) if isinstance(rows, Corpus) else Counter(x for body, name in rows for x in lengths(body, name, w))
        for (label, k), times in hits.items():
            counts[label][k] += times
        w["len"] = {label: tuple(max(-4.0, math.log(c / sum(v))) for c in v) if len(v) > 1 else (0.0,) for label, v in counts.items()}
    return w


def fitted(messages: DataFrame) -> dict:
    """Weights with span lengths of all messages."""
    return fit_lengths(Corpus(messages), rounds=1)


def quoted_lines(messages: DataFrame) -> DataFrame:
    """``(message_id, line_no)`` of the lines each sender did not newly write.

    Span lengths are fitted on all messages, whatever their length: each is decoded twice, once to
    count the lengths, once for its lines. Copies of a body of one sender count once. NULL and empty
    bodies have no lines; repeated rows of a message count once; a NULL sender name only loses the
    cue of the name. Lines end at LF, a CR before it is not part of the line.
    """
    w = fitted(messages)

    def run(bodies: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([not_new(b, n, w) for b, n in zip(bodies, names)], index=bodies.index)

    udf = F.pandas_udf(run, "array<int>").asNondeterministic()
    return messages.select("message_id", udf("body_text", "from_name").alias("k")).select("message_id", F.explode("k").alias("line_no")).distinct()


def fresh_text(messages: DataFrame) -> DataFrame:
    """``(message_id, text)``: the newly written lines of each message, joined by LF.

    The weights are those of ``quoted_lines`` over the same messages.
    """
    w = fitted(messages)

    def run(bodies: pd.Series, names: pd.Series) -> pd.Series:
        out = []
        for b, n in zip(bodies, names):
            gone = set(not_new(b, n, w))
            out.append("\n".join(x.rstrip("\r") for k, x in enumerate((b or "").split("\n")) if k not in gone).strip("\n"))
        return pd.Series(out, index=bodies.index)

    return messages.dropDuplicates(["message_id"]).select("message_id", F.pandas_udf(run, "string")("body_text", "from_name").alias("text"))
