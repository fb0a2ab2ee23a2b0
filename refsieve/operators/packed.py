"""Several values packed in one field: one value per row, with its position.

A field is cut at its outer delimiters into segments, and every segment is masked to a *delimiter skeleton*: one class
letter per token, ordinary words and initials masked, delimiters, quotes and marker words kept. Segments repeat a small
number of skeletons whatever the size of the data. Splitting rules are resolved once per distinct skeleton and broadcast
- all of them while their counted number is small, else those of every skeleton with more than a set share of the
segments, while a rare one is resolved where it stands. Values are taken out by token position. Both passes over the
fields are Arrow batches with a memo of word classes, which costs a fraction of one regular expression per class.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, present

#: Rules are broadcast whole up to this many; else only those of skeletons with more than 1/HOT_SHARE of the segments.
RULE_ROWS, HOT_SHARE = 50_000, 20_000
#: Word classes and rules that a worker remembers.
MEMO = 1 << 17

# Marker words of author lists.
CONNECT = "and|und|et|y"
UNNAMED = r"alii|alia|others|other|colleagues|coll\.?|more|…|\.{3}|\[\.{3}\]|\[…\]"
DEGREES = r"ph\.?d\.?|m\.?d\.?|m\.?sc\.?|b\.?sc\.?|m\.?p\.?h\.?|m\.a\.|b\.a\.|r\.?n\.?|dr\.?p\.?h\.?|psy\.?d\.?|ed\.?d\.?|jr\.?|sr\.?|ii|iii|iv|esq\.?|mba|frcp|dphil"
TITLES = r"dr\.?|prof\.?|professor|mr\.?|mrs\.?|ms\.?|sir|dame"
TOPIC = "for|on"
ORG = (
    r"cent(?:er|re)s?|ctr\.?|univ(?:ersity|ersität|ersidad|ersité|\.)?|dep(?:artment|t\.?)|institut(?:e|es|o|ion)?|inst\.?|collab(?:oration|orative|\.)|"
    r"groups?|grp\.?|consortium|association|assoc\.?|assn\.?|hospitals?|hosp\.?|society|soc\.?|network|committee|foundation|council|agency|"
    r"ministry|team|organi[sz]ation|laborator(?:y|ies)|lab|school|college|faculty|clinic|initiative|project|board|panel|alliance|program(?:me)?|psychol(?:ogy|\.)"
)

_SEP = ";|/\r\n"
_INLINE = "".join(c for c in BLANKS if c not in "\r\n")
#: Quoted runs, delimiters, blanks and words; nothing is lost, so slices join to the text.
_TOKEN = re.compile(rf'"[^"]*(?:""[^"]*)*"|[{_SEP}]+|,|&|[{_INLINE}]+|[^{BLANKS},&"{_SEP}]+|"')

# Classes of words, the first that fits; other words are 'w'.
_CLASSES = [
    (letter, regex.compile(words))
    for letter, words in (
        ("e", "et"),
        ("E", "ET"),  # of 'ET AL', else initials
        ("l", r"(?i:al\.?)"),  # 'et al.', else initials
        ("a", CONNECT),
        ("x", f"(?i:{UNNAMED})"),
        ("n", "ON"),  # initials or a word in capitals: the neighbours tell
        ("j", r"\p{Lu}{1,2}"),
        ("g", r"[fF]\."),  # an initial or 'for'
        ("i", r"(?:\p{L}\p{M}*\.-?)+"),
        ("j", r"\p{Lu}(?:[.-]+\p{Lu}){0,3}"),
        ("d", f"(?i:{DEGREES})"),
        ("t", f"(?i:{TITLES})"),
        ("o", f"(?i:{ORG})"),
        ("p", f"(?i:{TOPIC})"),
        ("u", "(?i:of)"),
        ("f", "(?i:the|de|del|der|für)"),
        ("b", r"[\p{L}\p{M}]{3,}\."),
    )
]


@lru_cache(maxsize=MEMO)
def _letter(token: str) -> str:
    """Class letter of a token."""
    c = token[0]
    if c == '"':
        return "Q" if len(token) > 1 else "w"
    if c in ",&":
        return c
    if c in _SEP:
        return ";"
    if c in _INLINE:
        return "_"
    return next((letter for letter, p in _CLASSES if p.fullmatch(token)), "w")


def segments(field: str) -> list[tuple[list[str], str]]:
    """Tokens and skeleton of every segment between outer delimiters, without blanks around it; empty ones are left out."""
    tokens = _TOKEN.findall(field)
    out, start = [], 0
    for part in "".join(map(_letter, tokens)).split(";"):
        end = start + len(part)
        a, b = start + part.startswith("_"), end - part.endswith("_")
        if a < b:
            out.append((tokens[a:b], part[a - start : b - start]))
        start = end + 1
    return out


#: 'for Stress' or 'on Sleep, Stress' before a connector and 'Coping' or 'Wellbeing Place' behind it.
_INNER, _TAIL = re.compile(r"(?:_[wB],)*_[wB]_"), re.compile(r"_[wB](?:_[wB])?(?:,|_?[a&]|$)")


def _strip(s: str, a: int, b: int, also: str = "") -> tuple[int, int]:
    while a < b and s[a] in "_," + also:
        a += 1
    while a < b and s[b - 1] in "_," + also:
        b -= 1
    return a, b


def _kind(p: str) -> str:
    """Kind of a comma part: D degree, O organisation, I initials, S one word, G word and dotted initials, F full name."""
    core = [c for c in p if c not in "_Qt"]
    k = "".join(core)
    if k[:2] == "Bw" and len(k) == 2 and "_" in p:
        return "A"
    k = k.replace("B", "w")
    if not k:
        return "Q" if "Q" in p else "F"
    if set(k) <= {"d"}:
        return "D"
    if "o" in k or "p" in k or "a" in k or "&" in k or "u" in k:
        return "O"
    if set(k) <= {"i", "j"}:
        return "I" if "t" not in p else "F"
    if "t" in p:
        return "F"
    if k == "w":
        return "S"
    if k[0] == "w" and set(k[1:]) <= {"i"}:
        return "G"
    if set(k) <= {"w", "f"}:
        return "W"
    return "F"


def _comma_items(s: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Group comma parts into names: 'Surname, Given', 'Surname, I.', full names, organisations with their place."""
    kinds = [_kind(s[a:b]) for a, b in parts]
    # 'Dpt. Psychology' beside an organisation is one too, else a given name cut short with its surname
    two = len(kinds) == 2 and "O" in kinds
    kinds = [("O" if two else "W") if k == "A" else k for k in kinds]
    out: list[tuple[int, int]] = []
    i, n = 0, len(parts)
    while i < n:
        a, b = parts[i]
        k, j = kinds[i], i + 1
        if k == "O":
            topic = "p" in s[a:b]
            while j < n and (kinds[j] == "O" or topic and kinds[j] in "SW" and (j + 1 == n or kinds[j + 1] not in "IG" or "a" in s[a : parts[j][0]])):
                topic = topic or "p" in s[parts[j][0] : parts[j][1]]
                done = kinds[j] != "O"
                b = parts[j][1]
                j += 1
                if done:
                    break
        elif j < n and k == "S" and kinds[j] == "O" and n == 2:
            b, j = parts[j][1], j + 1
        elif j < n and kinds[j] == "I" and k in "SWF":
            b, j = parts[j][1], j + 1
        elif j < n and k == "S" and kinds[j] in "SGW" and not (kinds[j] == "W" and n > 2):
            b, j = parts[j][1], j + 1
        elif j < n and k == "S" and kinds[j] == "F" and n == 2:
            b, j = parts[j][1], j + 1
        elif j < n and k == "W" and (kinds[j] == "G" or kinds[j] == "S" and (j + 1 == n or kinds[j + 1] not in "ISG")):
            b, j = parts[j][1], j + 1
        while j < n and kinds[j] == "D":
            b, j = parts[j][1], j + 1
        if k == "D" and out:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        i = j
    return out


def resolve(s: str) -> list[tuple[int, int]]:
    """Token spans of the single values of a skeleton, in order."""
    s = re.sub("(?<=[ob]_)[ng]", "p", s).replace("n", "j").replace("g", "i").replace("b", "B")
    s = re.sub("E(?=_l)", "e", s).replace("E", "j")
    s = re.sub("(?<=e_)l", "x", s).replace("l", "j")
    s = re.sub("(?<=w_)B", "w", s)
    out: list[tuple[int, int]] = []
    start = 0
    for end in [k for k, c in enumerate(s) if c == ";"] + [len(s)]:
        a, b = _strip(s, start, end)
        start = end + 1
        # unnamed further authors, at the end of the segment
        while b > a and s[b - 1] == "x":
            a, b = _strip(s, a, b - 1)
            while b > a and s[b - 1] in "eax&":
                a, b = _strip(s, a, b - 1)
        # connectors: not inside 'Center for X and Y', 'Collaboration on X, Y and Z'
        pieces, p, topic = [], a, False
        for k in range(a, b):
            if s[k] == "p":
                topic = True
            elif s[k] in "a&e" and k > p and k + 1 < b:
                inside = topic and _INNER.fullmatch(s[s.rfind("p", p, k) + 1 : k]) and _TAIL.match(s[k + 1 : b])
                if not inside:
                    pieces.append((p, k))
                    p = k + 1
                topic = False
            elif s[k] in "a&" and k == p:
                p = k + 1
        pieces.append((p, b))
        for p, q in pieces:
            p, q = _strip(s, p, q, "a&")
            if p >= q:
                continue
            cuts = [k for k in range(p, q) if s[k] == ","]
            parts, at = [], p
            for k in [*cuts, q]:
                x, y = _strip(s, at, k)
                if x < y:
                    parts.append((x, y))
                at = k + 1
            run: list[tuple[int, int]] = []
            for part in parts:
                if s[part[0] : part[1]] == "Q":  # an enclosed value stands alone
                    out += _comma_items(s, run) + [part]
                    run = []
                else:
                    run.append(part)
            out += _comma_items(s, run)
    return out


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column("__skel")
        found = [[x for span in resolve(k) for x in span] for k in keys.to_pylist()]
        yield pa.RecordBatch.from_arrays([keys, pa.array(found, pa.list_(pa.int32()))], names=["__skel", "__spans"])


def _skeletons(fields: pa.Array) -> pa.Array:
    return pa.array([None if f is None else [k for _, k in segments(f)] for f in fields.to_pylist()], pa.list_(pa.string()))


def rules_of(fields: DataFrame) -> dict[str, list[int]]:
    """Rules (starts and ends of values, in turn) of the distinct skeletons of ``__field``: at most RULE_ROWS + HOT_SHARE of them."""
    found = fields.select(F.explode(F.arrow_udf(_skeletons, "array<string>")("__field")).alias("__skel")).groupBy("__skel").agg(F.count("*").alias("__n")).persist()
    count, total = found.agg(F.count("*"), F.sum("__n")).first()
    kept = found if count <= RULE_ROWS else found.filter(F.col("__n") > total // HOT_SHARE)
    rows = kept.select("__skel").mapInArrow(_rules, "__skel string, __spans array<int>").collect()
    found.unpersist()
    return {r["__skel"]: r["__spans"] for r in rows}


@lru_cache(maxsize=MEMO)
def _rare(skeleton: str) -> list[int]:
    return [x for span in resolve(skeleton) for x in span]


def _take(tokens: list[str], start: int, end: int) -> str:
    """The value at token positions: trimmed, without the quotes that enclose it."""
    raw = "".join(tokens[start:end]).strip(BLANKS)
    if end - start == 1 and len(raw) > 1 and raw[0] == '"':
        return raw[1:-1].replace('""', '"').strip(BLANKS)
    return raw


def split_packed(df: DataFrame, field: str, keep: list[str], pos: str = "pos", value: str = "value") -> DataFrame:
    """One row per single value of ``field``: the columns ``keep``, ``pos`` (bigint, from 1) and ``value``.

    Null and blank fields give no row; empty places and marks for further unnamed values are not counted; repeated rows
    give repeated results; a field without delimiter gives itself. ``keep`` may hold any column names: helpers are
    prefixed with ``__`` and the result has just the columns named. An empty table gives an empty result.
    """
    base = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{field}`").alias("__field")).filter(present(F.col("__field")).isNotNull())
    rules = base.sparkSession.sparkContext.broadcast(rules_of(base))

    def values(fields: pa.Array) -> pa.Array:
        known, out = rules.value, []
        for f in fields.to_pylist():
            row = []
            for tokens, skeleton in segments(f):
                spans = known.get(skeleton)
                spans = _rare(skeleton) if spans is None else spans
                row += [v for k in range(0, len(spans), 2) if (v := _take(tokens, spans[k], spans[k + 1]))]
            out.append(row)
        return pa.array(out, pa.list_(pa.string()))

    out = base.select(*[F.col(f"`{c}`") for c in keep], F.posexplode(F.arrow_udf(values, "array<string>")("__field")).alias("__pos", "__val"))
    return out.select(*[F.col(f"`{c}`") for c in keep], (F.col("__pos") + 1).cast("bigint").alias(pos), F.col("__val").alias(value))


def author_names(articles: DataFrame, field: str = "author", key: str = "ord") -> DataFrame:
    """Single authors of a table of references: (key, pos, author_name)."""
    return split_packed(articles, field, [key], "pos", "author_name")
