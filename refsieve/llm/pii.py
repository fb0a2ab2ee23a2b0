"""Personal information in free text: a semi-Markov conditional random field over candidate segments.

Segments of bounded length are proposed with a kind each: spans with the form of an address, a number or an e-mail, and
every run of capitalised words, initials and particles, wherever it stands. Only names typed in lower case, which have no
form of their own, are proposed beside words that stand next to names in the training texts. Features of a whole span
(its form, the words around it, a form of address in front, a label, a citation or scale around it, contact data behind
it) score it; the best set of segments that don't overlap is found by dynamic programming, so boundaries and kinds are
chosen jointly. The weights maximise the conditional likelihood of labelled texts made from a grammar
(``pii_training``); in each pass some segments do without their words, so that forms and labels carry weight too.
"""

from __future__ import annotations

import base64
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .pii_training import GIVEN, SAMPLE, training_texts
from .tokenizer import default_vocabulary

KINDS = ("email", "phone", "id_number", "address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[NAME]"}
EPOCHS, STEP_SIZE, DECAY = 7, 0.4, 1e-5
#: Share of segments whose words a pass leaves out.
WORDLESS = 0.25
#: Words and places beside which lower-case names are always proposed.
CUES = {"and", "und", "y", "et", "&", "\n", "^"}
#: Characters before a number in which its label may stand, and behind a name in which contact data may start.
LABEL_REACH, CONTACT_REACH = 40, 24

_W = r"[^\W\d_]+(?:[\u0300-\u036f]+[^\W\d_]*)*"
_TOKEN = re.compile(rf"{_W}(?:['’-](?!s\b){_W})*|\d+|\r?\n|[^\w\s]|_")
_CAP = r"\p{Lu}[\p{L}\p{M}'’]*+(?:-\p{Lu}[\p{L}\p{M}'’]*+)*+"
_SEP, _CODE, _UK = r"(?:,[ ]?|[ ]?\r?\n)", r"\d{5}", r"[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}"
_TOWN = rf"{_CAP}(?:(?: (?:am|im|an|der|upon|sur|de|la|del))*+ {_CAP}){{0,2}}?"
_HOUSE = r"\d{1,5}(?:[A-Za-z]|[-–]\d{1,5})?"
_END = r"(?![\p{L}\p{M}\d])"
_ROAD = "Road|Rd|Street|St|Avenue|Ave|Lane|Ln|Close|Court|Ct|Drive|Dr|Way|Square|Terrace|Place|Boulevard|Blvd|Crescent|Gardens"

_EMAIL = regex.compile(
    r"(?<![\w.+-])\w[\w.+-]*+(?:[ ]?@[ ]?|[ ]?[\[(][ ]?(?:at|AT)[ ]?[\])][ ]?|[ ](?:at|AT)[ ](?=[\w-]+[ ](?:dot|DOT)[ ]))[\w-]++(?:(?:\.|[ ]?[\[(][ ]?(?:dot|DOT)[ ]?[\])][ ]?|[ ](?:dot|DOT)[ ])[\w-]++)++"
)
_EMAIL_SIGN = re.compile(r"@|[\[(] ?at ?[\])]| dot ", re.IGNORECASE)
_PHONE = re.compile(r"(?<![\w.,/\-–])(?:\+|00)?\(?\d[\d ()./\-]{5,22}\d(?:,?[ ](?:ext\.?|x)[ ]?\d{1,5})?(?![\w])")
_ID = re.compile(
    r"(?<![\w\-.])(?<!\d )(?:[A-Z]{1,3}\d{2} \d{6}|[A-Z]{1,3}-?\d{5,10}[A-Z]?|[A-Z]\d{7}[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|[A-Z]\d{3}\.\d{3}\.\d{2}|\d{7,9}-?[A-Z]|\d{6}-\d{4}|\d{3}[- ]\d{2}[- ]\d{4}|\d{3}[- ]\d{3}[- ]\d{4}|\d{3}-\d{4}|"
    r"\d{1,2}(?:[ .]\d{2,3}){3,6}|\d{2} \d{6} [A-Z] \d{3}|\d{5,12})(?![\w\-])"
)
_ADDRESS = [
    ("road", re.compile(rf"\b(?:{_ROAD})\b"), regex.compile(rf"(?<![\w.,])(?:(?:Flat|Apt|Unit) \d+[A-Za-z]?, )?{_HOUSE} {_CAP}(?: {_CAP}){{0,2}}? (?:{_ROAD})\b\.?(?P<unit>, (?:Apt|Apartment|Unit|Suite|Flat) ?\d+[A-Z]?)?(?P<town>(?:{_SEP}{_TOWN}(?:,? (?:[A-Z]{{2}} )?(?:{_CODE}|{_UK})){_END}|{_SEP}{_TOWN}{_END}))?")),
    ("low", re.compile(r" (?:rd|road|st|street|ave|ln|lane|dr|ct)\b"), regex.compile(r"(?<![\w.,])\d{1,5} [\p{Ll}\p{M}'-]+ (?:rd|road|st|street|ave|ln|lane|dr|ct)\b\.?(?P<town>,? [\p{Ll}\p{M}'-]{3,})?")),
    ("german", re.compile(r"(?:straße|strasse|str\.|gasse|weg|platz|allee) \d"), regex.compile(rf"(?<![\w])\p{{Lu}}[\p{{L}}\p{{M}}-]*(?:straße|strasse|str\.|gasse|weg|platz|allee) \d+(?: ?[a-z]\b)?\b(?P<town>{_SEP}{_CODE} {_TOWN}{_END})?")),
    ("french", re.compile(r"(?i)\b(?:rue|avenue|boulevard|place|chemin|allée)\b"), regex.compile(rf"(?<![\w.,])\d{{1,4}}(?: bis| ter)?,? (?:[rR]ue|[aA]venue|[bB]oulevard|[pP]lace|[cC]hemin|[aA]llée) (?:de |du |des |de la |d'|de l')?{_CAP}(?: {_CAP})?(?P<town>{_SEP}{_CODE} {_TOWN}{_END})?")),
    ("spanish", re.compile(r"\b(?:Calle|Avenida|Avda\.|Plaza|Paseo|C/)"), regex.compile(rf"(?<![\w])(?:Calle|Avenida|Avda\.|Plaza|Paseo|C/) ?(?:de |del |de la )?{_CAP}(?: {_CAP})?,? \d+(?P<unit>, ?\d+\.? ?[ºª°] ?[A-Z]?)?(?P<town>{_SEP}{_CODE} {_TOWN}{_END})?")),
    ("box", re.compile(r"Box \d|Postfach \d|Apartado \d"), regex.compile(rf"(?<![\w])(?:P\.? ?O\.? Box|Postfach|Apartado) \d+(?P<town>{_SEP}(?:{_CODE} {_TOWN}|{_TOWN}(?:,? (?:{_CODE}|{_UK}))?){_END})?")),
]
_CITATION = re.compile(r"\([^()\n]*\b(?:1[89]|20)\d\d[a-z]?\b[^()\n]*\)")
# Words that label numbers of papers, other numbers and phones.
_PAPER = re.compile(
    r"(?i)passport|passeport|pasaporte|reisepass|ausweis|identi|national id|\bid\b|\bdni\b|\bnie\b|\bnif\b|ssn|social sec|sozial|sécurité|seguridad|insurance|versich|policy|patient|paciente|\bmrn\b|medical rec|hospital num|staff|"
    r"employee|personnel|personalnum|badge|payroll|licen[cs]e|führerschein|permis|\bnhs\b|health card|case file|citizen"
)
_OTHER = re.compile(r"(?i)grant|award|project|protocol|ethic|regist|trial|\bissn|\bisbn|doi|table|fig|room|version|page|item|contract|journal|approv|fund")
_CALL = re.compile(r"(?i)\btel|phone|mobile|\bcell|\bcall|\bfax|ring|text me|reach|handy|tél|móvil|dial|number is")
# Forms of address, particles of surnames, words behind the names of scales and in those of organisations.
_TITLES = set("dr prof professor mr mrs ms miss herr frau sr sra mme med".split())
_PARTICLES = set("von van de der den del della la le di du da dos zu ten ter al el bin".split())
_SCALE = set("scale scales inventory questionnaire index test checklist interview survey subscale score anxiety depression coping strain burden impact".split())
_ORGS = set("university hospital institute center centre foundation council college clinic school district cohort group committee department society association ward site region sample closure".split())
# Words that are no part of a name.
_STOP = set(
    "the a an and or of for in on at to from with by about will would can could we you they he she it i my our your his her their this that these those is are was were be been has have had not no yes as but if when while "
    "please thank thanks dear hi hello hey best kind wishes regards sincerely yours all colleagues team everyone everybody participants staff participant patient interviewer author correspondence email mail tel phone fax contact call table figure what how when where who why which whose then there here so too very more less no team editor sir madam reviewers friends damen herren office group id "
    "der die das und ein eine wie im mit auf für von zu bei ist sind wir sie el los las una con por que es en y les des un une et dans pour sur est cc re fw".split()
) - {"von", "will", "mark"}

#: Forms of names: C capitalised word, I initial, v particle; w and i the same in lower case.
_UPPER = {
    x: x.replace("vv", "v")
    for x in "C CC CCC CI.C I.C I.I.C I.CC CI.I.C CIC IC CvC CvvC CCvC CCvvC CI.vC I.vC I.vvC I.I.vC vC vvC C,C C,CI. C,I. C,I.I. C,CI C,CC vC,C vC,I. CC,C C,CI.I.".split()
}
_LOWER = {x: x for x in "ww www wi.w i.w i.i.w wvw wvvw".split()}
_LONGEST = 7


@lru_cache(maxsize=1 << 17)
def _token_kind(t: str) -> tuple[str, str]:
    """Lower-case form of a token, digits masked, and its class letter."""
    low = t.lower()
    if t[0].isalpha():
        if low == t:
            return low, "v" if t in _PARTICLES else "i" if len(t) == 1 else "w"
        return low, "I" if len(t) == 1 else "C" if t[0].isupper() else "w"
    if t[0].isdigit():
        return "0" * len(t), "0"
    if t[-1] == "\n":
        return "\n", "n"
    return low, t if t in ".,:;()<&/" else "*"


class Text:
    """Tokens of a text: places, lower-case forms with masked digits, and a string of one class letter per token."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = list(_TOKEN.finditer(text))
        self.at = [m.start() for m in found]
        self.end = [m.end() for m in found]
        kinds = [_token_kind(m.group()) for m in found]
        self.low = [low for low, _ in kinds]
        self.cls = "".join([c for _, c in kinds])
        self.words = {low for low, c in kinds if c == "w"}
        self.cited = [(m.start(), m.end()) for m in _CITATION.finditer(text)] if "(" in text else []

    def in_citation(self, a: int) -> bool:
        k = bisect_right(self.cited, (a, math.inf)) - 1
        return k >= 0 and a < self.cited[k][1]


class Cues:
    """Words beside lower-case names: one or two before."""

    def __init__(self, one: set[str], two: set[tuple[str, str]]) -> None:
        self.one, self.two = one, two


Candidate = tuple[int, int, str, int, int, tuple[str, ...]]


def _form(s: str) -> str:
    """Digits and letters masked, runs counted."""
    return re.sub(r"(9|A)\1*", lambda m: m.group(1) + str(len(m.group())), "".join("9" if c.isdigit() else "A" if c.isalpha() else c for c in s))[:24]


def _patterned(t: Text) -> list[tuple[int, int, str, tuple[str, ...]]]:
    """Spans with the form of an e-mail, phone, number or address."""
    text, out = t.text, {}
    if _EMAIL_SIGN.search(text):
        for m in _EMAIL.finditer(text):
            out[m.start(), m.end(), "email"] = (f"plain={'@' in m.group()}",)
    if "0" in t.cls:
        for m in _PHONE.finditer(text):
            s = m.group()
            open_ = s[0] == "(" and s.count("(") > s.count(")")  # a bracket before the number
            s = s[open_:]
            digits = sum(c.isdigit() for c in s)
            if 7 <= digits <= 18:
                called = _CALL.search(text, max(0, m.start() - LABEL_REACH), m.start()) is not None
                start = "+" if s[0] == "+" else "00" if s[:2] == "00" else "0" if s[0] == "0" else "(" if s[0] == "(" else "9"
                marks = "".join(sorted({c for c in s if not c.isdigit() and c not in "ext"}))
                out[m.start() + open_, m.end(), "phone"] = (f"form={_form(s)}", f"digits={min(digits, 16)}", f"start={start} {digits}", f"start={start} called={called}", f"marks={marks}", f"marks={marks} {start}", f"ext={'x' in s}", f"called={called}")
        for m in _ID.finditer(text):
            s, a = m.group(), max(0, m.start() - LABEL_REACH)
            line = max(a, text.rfind("\n", a, m.start()) + 1)
            label, other = _PAPER.search(text, line, m.start()) is not None, _OTHER.search(text, line, m.start()) is not None
            form = _form(s)
            out[m.start(), m.end(), "id_number"] = (f"form={form}", f"letters={any(c.isalpha() for c in s)}", f"label={label}", f"other={other}", f"label={label} other={other}", f"label={label} form={form}")
        for name, sign, pattern in _ADDRESS:
            if not sign.search(text):
                continue
            for m in pattern.finditer(text, overlapped=False):
                a, b, town = m.start(), m.end(), m.groupdict().get("town")
                ends = {b: town is not None}
                if town:
                    ends[m.start("town")] = False
                    if name != "low" and (more := regex.compile(rf" {_CAP}{_END}").match(text, b)):  # towns of several words
                        ends[more.end()] = True
                        if again := regex.compile(rf" {_CAP}{_END}").match(text, more.end()):
                            ends[again.end()] = True
                if text[b - 1 : b] == "." and not town:  # a full stop may end the sentence
                    ends[b - 1] = False
                for e, has in ends.items():
                    part = text[m.start("town") : e] if has else ""
                    code = any(c.isdigit() for c in part)
                    out[a, e, "address"] = (f"form={name}", f"form={name} town={has}", f"code={code} town={has}", f"words={len(part.split())} code={code}", f"stop={text[e - 1 : e] == '.'}", f"town left={bool(town) and not has}", f"code left={any(c.isdigit() for c in text[e : m.end()])}", f"cap behind={bool(regex.match(' ' + _CAP, text[e : e + 12]))} code={code}")
    return [(a, b, k, f) for (a, b, k), f in out.items()]


def _named(t: Text, cues: Cues | None) -> list[tuple[int, int, str]]:
    """Token spans with the form of a name: first token, token behind the last, form."""
    cls, low, text, out = t.cls, t.low, t.text, []
    one, two = (cues.one, cues.two) if cues else ((), ())
    for i, c in enumerate(cls):
        if c in "CIv":
            forms = _UPPER
        elif c in "wi" and (i == 0 or low[i - 1] in one or (low[i - 2] if i > 1 else "^", low[i - 1]) in two):
            forms = _LOWER
        else:
            continue
        for size in range(1, _LONGEST + 1):
            form = forms.get(cls[i : i + size])
            if form is None or i + size > len(cls):
                continue
            words = low[i : i + size]
            if any(w in _STOP and len(w) > 1 for w in words):
                continue
            if size > 1:
                s = text[t.at[i] : t.end[i + size - 1]]
                if "  " in s or "\t" in s or "|" in s or (". " not in s and "." in s and form[-1] != "." and s.count(".") == 1 and " " not in s):
                    continue
            out.append((i, i + size, form))
    return out


def _skip_titles(t: Text, i: int) -> int:
    """First token of the forms of address before a token."""
    j = i
    while j:
        if t.low[j - 1] in _TITLES:
            j -= 1
        elif j > 1 and t.low[j - 1] == "." and t.low[j - 2] in _TITLES:
            j -= 2
        else:
            break
    return j


def _before(t: Text, i: int, name: bool) -> tuple[list[str], list[str]]:
    """Features of what stands before a token: of words, and others."""
    j = _skip_titles(t, i) if name else i
    low, cls = t.low, t.cls
    l1 = low[j - 1] if j else "^"
    l2 = low[j - 2] if j > 1 else "^"
    l3 = low[j - 3] if j > 2 else "^"
    c1 = cls[j - 1] if j else "n"
    c2 = cls[j - 2] if j > 1 else "n"
    words = [f"l1={l1}", f"l2={l2} {l1}", f"l3={l3} {l2} {l1}"]
    out = [f"lc={c1}", f"lc2={c2}{c1}"]
    if name:
        touches = j == i and j > 0 and (c1 in "CIv" or c1 == "." and c2 == "I") and t.text[t.end[i - 1] : t.at[i]] == " "
        out += [f"title={j < i}", f"touches={touches}", f"cited={t.in_citation(t.at[i])}"]
        if c1 not in "wv":
            words.append(f"far={l2}" if l2 != "^" else "far=^")
    return words, out


def _behind(t: Text, e: int, name: bool, contacts: list[int]) -> tuple[list[str], list[str]]:
    """Features of what stands behind a token."""
    low, cls, n = t.low, t.cls, len(t.low)
    r1 = low[e] if e < n else "$"
    r2 = low[e + 1] if e + 1 < n else "$"
    c1 = cls[e] if e < n else "n"
    c2 = cls[e + 1] if e + 1 < n else "n"
    words = [f"r1={r1}", f"r2={r1} {r2}"]
    out = [f"rc={c1}", f"rc2={c1}{c2}"]
    if name:
        k = bisect_left(contacts, t.end[e - 1])
        near = k < len(contacts) and contacts[k] - t.end[e - 1] <= CONTACT_REACH
        ahead = low[e : e + 4]
        stop = next((k for k, w in enumerate(ahead) if w in ("\n", ".", ",")), 4)
        scale, org = any(w in _SCALE for w in ahead[:stop]), any(w in _ORGS for w in ahead[:stop])
        year = any(w == "0000" for w in low[e : e + 3])
        out += [f"contact={near}", f"goes on={c1 == 'C' and t.text[t.end[e - 1] : t.at[e]] == ' '}", f"scale={scale}", f"org={org}", f"year={year}", f"comma on={c1 == ',' and c2 == 'C'}"]
    return words, out


_GIVEN = {w.lower() for w in GIVEN}
_THANKS = set("thank thanks grateful indebted acknowledge danken dank agradecemos remercions".split())
#: Public vocabularies whose whole lower-case words count as ordinary words.
VOCABULARIES = ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")


@lru_cache(maxsize=1)
def ordinary_words() -> frozenset[str]:
    """Lower-case words that are one token behind a blank in a public vocabulary: bounded by its size."""
    out = set()
    for name in VOCABULARIES:
        with open(default_vocabulary(name), "rb") as f:
            tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
            out |= {w for b in tokens if b[:1] == b" " and (w := b[1:].decode("utf-8", "replace")).isalpha() and w.islower() and len(w) > 1}
    return frozenset(out)


def _span(t: Text, i: int, e: int, form: str, ordinary: frozenset[str]) -> list[str]:
    """Features of a name alone."""
    plain = "".join("." if len(w) < 2 else "p" if w in ordinary or "-" in w and all(x in ordinary for x in w.split("-")) else "n" for w in t.low[i:e] if w[0].isalpha())
    thanks = any(w in _THANKS for w in t.low[max(0, i - 12) : i])
    case = "low" if form[0] in "wi" else "cap"
    words = t.low[i:e]
    shape = form + ("^" if t.text[t.at[i] : t.end[e - 1]].isupper() and len(form) > 1 else "")
    j = _skip_titles(t, i)
    left, right = t.cls[j - 1] if j else "n", t.cls[e] if e < len(t.cls) else "n"
    given = "first" if words[0] in _GIVEN else "other" if any(w in _GIVEN for w in words) else "none"
    said = any(w in t.words for w in words if len(w) > 2 and w not in _PARTICLES)
    return [f"form={shape}", f"form={shape} title={j < i}", f"form={shape} lc={left}", f"form={shape} rc={right}", f"form={shape} {left}{right}", f"given={given}", f"form={shape} given={given}", f"said={said}", f"form={shape} said={said}", f"org word={any(w in _ORGS or w in _SCALE for w in words)}",
            f"plain={case} {plain}", f"plain={plain} lc={left}", f"plain={plain} given={given}", f"plain={case} {plain.count('p')}", f"thanks={case} {thanks}", f"thanks={thanks} {plain}"]


#: (start, end, kind, features of words, other features)
Segment = tuple[int, int, str, list[str], list[str]]


def segments_of(text: str, cues: Cues | None) -> list[Segment]:
    """Candidate segments with their features, sorted by end."""
    t = Text(text)
    ordinary = ordinary_words()
    out = []
    contacts = []
    for a, b, kind, own in _patterned(t):
        (w1, o1), (w2, o2) = _before(t, bisect_left(t.at, a), False), _behind(t, bisect_left(t.at, b), False, [])
        out.append((a, b, kind, [f"{kind} {x}" for x in w1 + w2], [f"{kind} {x}" for x in ("bias", *o1, *o2, *own)]))
        if kind in ("email", "phone"):
            contacts.append(a)
    contacts.sort()
    front: dict[int, tuple[list[str], list[str]]] = {}
    back: dict[int, tuple[list[str], list[str]]] = {}
    for i, e, form in _named(t, cues):
        if i not in front:
            front[i] = _before(t, i, True)
        if e not in back:
            back[e] = _behind(t, e, True, contacts)
        (w1, o1), (w2, o2) = front[i], back[e]
        out.append((t.at[i], t.end[e - 1], "person_name", w1 + w2, ["bias", *o1, *o2, *_span(t, i, e, form, ordinary)]))
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


def _order(segments: list[tuple]) -> tuple[list[int], list[int]]:
    """By end: how many segments end at or before the start of each; how many start before its end."""
    ends = [s[1] for s in segments]
    starts = sorted(s[0] for s in segments)
    return [bisect_right(ends, s[0]) for s in segments], [bisect_left(starts, s[1]) for s in segments]


def _log_add(x: float, y: float) -> float:
    return max(x, y) + math.log1p(math.exp(-abs(x - y)))


def marginals(segments: list[tuple], score: list[float]) -> list[float]:
    """Probability of each segment (sorted by end) among all sets of segments that don't overlap."""
    n = len(segments)
    before, after = _order(segments)
    fwd = [0.0] * (n + 1)
    for i in range(n):
        fwd[i + 1] = _log_add(fwd[i], score[i] + fwd[before[i]])
    by_start = sorted(range(n), key=lambda i: segments[i][0])
    bwd = [0.0] * (n + 1)  # over segments from the k-th start on
    for k in range(n - 1, -1, -1):
        i = by_start[k]
        bwd[k] = _log_add(bwd[k + 1], score[i] + bwd[after[i]])
    return [math.exp(min(0.0, fwd[before[i]] + score[i] + bwd[after[i]] - fwd[n])) for i in range(n)]


def best(segments: list[tuple], score: list[float]) -> list[int]:
    """Indices of the segments (sorted by end) of the best set that don't overlap."""
    before, _ = _order(segments)
    top, take = [0.0] * (len(segments) + 1), [False] * len(segments)
    for i in range(len(segments)):
        with_ = score[i] + top[before[i]]
        take[i] = with_ > top[i]
        top[i + 1] = max(top[i], with_)
    out, i = [], len(segments)
    while i:
        if take[i - 1]:
            out.append(i - 1)
            i = before[i - 1]
        else:
            i -= 1
    return out[::-1]


def learn_cues(texts: list[tuple[str, list[tuple[int, int, str]]]]) -> Cues:
    """Words that stand before names in the training texts far more often than elsewhere."""
    seen, gold = Counter(), Counter()
    for text, items in texts:
        t = Text(text)
        low = ["^", "^", *t.low]
        for k in range(2, len(low)):
            seen.update([low[k], (low[k - 1], low[k])])
        for a, _, kind in items:
            if kind == "person_name":
                j = _skip_titles(t, bisect_left(t.at, a))
                gold.update([low[j + 1], (low[j], low[j + 1])])
    often = {c for c, n in gold.items() if n >= 4 and n >= 0.15 * seen[c] and c not in (".", ",", ")")} | CUES
    return Cues({c for c in often if isinstance(c, str)}, {c for c in often if isinstance(c, tuple)})


class Detector:
    """A trained detector: weights by feature and cue words."""

    def __init__(self, weights: dict[str, float], cues: Cues, ordinary: frozenset[str]) -> None:
        self.weights, self.cues, self.ordinary = weights, cues, ordinary

    def __reduce__(self):  # noqa: ANN204
        return Detector, (self.weights, self.cues, self.ordinary)

    def scored(self, text: str) -> tuple[list[tuple[int, int, str]], list[float]]:
        """Candidate segments, sorted by end, and their scores; what stands before and behind names is scored once a place."""
        t = Text(text)
        get = self.weights.get
        total = lambda names: sum([get(x, 0.0) for x in names])
        rows, contacts = [], []
        for a, b, kind, own in _patterned(t):
            (w1, o1), (w2, o2) = _before(t, bisect_left(t.at, a), False), _behind(t, bisect_left(t.at, b), False, [])
            rows.append((b, a, kind, total([f"{kind} {x}" for x in (*w1, *w2, "bias", *o1, *o2, *own)])))
            if kind in ("email", "phone"):
                contacts.append(a)
        contacts.sort()
        front: dict[int, float] = {}
        back: dict[int, float] = {}
        bias = get("bias", 0.0)
        for i, e, form in _named(t, self.cues):
            if (x := front.get(i)) is None:
                w, o = _before(t, i, True)
                x = front[i] = total(w) + total(o)
            if (y := back.get(e)) is None:
                w, o = _behind(t, e, True, contacts)
                y = back[e] = total(w) + total(o)
            rows.append((t.end[e - 1], t.at[i], "person_name", bias + x + y + total(_span(t, i, e, form, self.ordinary))))
        rows.sort()
        return [(a, b, k) for b, a, k, _ in rows], [s for *_, s in rows]

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """Items of a text: start, end, kind."""
        segments, score = self.scored(text)
        return [segments[i] for i in best(segments, score)] if segments else []

    def redact(self, text: str) -> str:
        """The text with its items replaced by placeholders of their kind."""
        out, at = [], 0
        for a, b, k in self.find(text):
            out += [text[at:a], PLACEHOLDER[k]]
            at = b
        return "".join([*out, text[at:]])


@lru_cache(maxsize=2)
def train(size: int = SAMPLE, seed: int = 9) -> Detector:
    """Fit the weights to ``size`` labelled texts."""
    texts = training_texts(size, seed)
    cues = learn_cues(texts)
    ids: dict[str, int] = {}
    number = lambda names: [ids.setdefault(x, len(ids)) for x in names]
    data = []
    for text, items in texts:
        gold, found = set(items), segments_of(text, cues)
        if found:
            data.append(([(s[0], s[1], s[2], number(s[3]), number(s[4])) for s in found], [float(s[:3] in gold) for s in found]))
    w, g2 = [0.0] * len(ids), [1e-2] * len(ids)
    r = random.Random(seed)
    for _ in range(EPOCHS):
        r.shuffle(data)
        for found, gold in data:
            used = [s[4] if r.random() < WORDLESS else s[3] + s[4] for s in found]
            score = [sum([w[f] for f in fs]) for fs in used]
            for fs, y, p in zip(used, gold, marginals(found, score), strict=True):
                if abs(y - p) > 5e-3:
                    for f in fs:
                        d = y - p - DECAY * w[f]
                        g2[f] += d * d
                        w[f] += STEP_SIZE * d / math.sqrt(g2[f])
    return Detector({x: round(w[k], 4) for x, k in ids.items() if abs(w[k]) > 1e-3}, cues, ordinary_words())


def find_items(docs: DataFrame, id: str = "doc_id", text: str = "text", detector: Detector | None = None) -> DataFrame:
    """(id, kind, found_text): one row for each different item of each row's text, as it stands there.

    Null, empty and blank texts have no items; repeated rows give repeated results; texts of any length are read whole;
    other columns are ignored. An empty table gives an empty result.
    """
    model = detector or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, kinds, found = [], [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                for kind, s in dict.fromkeys((kind, t[x:y]) for x, y, kind in model.find(t)) if t else ():
                    rows.append(k), kinds.append(kind), found.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string())], names=[id, "kind", "found_text"])

    rows = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`").alias("__text")).filter("__text is not null")
    return spread(rows).mapInArrow(run, f"`{id}` {rows.schema[0].dataType.simpleString()}, kind string, found_text string")


def redact(docs: DataFrame, id: str = "doc_id", text: str = "text", detector: Detector | None = None) -> DataFrame:
    """(id, text): every text with its items replaced by placeholders; null texts stay null."""
    model = detector or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if t is None else model.redact(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=[id, text])

    rows = docs.select(F.col(f"`{id}`"), F.col(f"`{text}`"))
    return spread(rows).mapInArrow(run, f"`{id}` {rows.schema[0].dataType.simpleString()}, `{text}` string")
