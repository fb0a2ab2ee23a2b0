"""Variant spellings of names: noisy-channel attribution.

Distinct spellings are counted and parsed into classes (surname and given names, or the words of an organisation) that
case, accents, order, punctuation, degrees and titles don't change. Classes are candidates for one another when their
surnames are at most one edit apart and their given names may agree. A class is then attached to the candidate of the
highest posterior: the frequency of the candidate as prior, times the likelihoods of the abbreviations, left-out names,
nicknames and typos that turn the candidate into the class. A class that explains itself best stays on its own.
Attachments are closed into groups by the graph operator of this subpackage.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.packed import DEGREES, ORG, TITLES, author_names
from ..runtime import cut
from .components import components

# Frequent short forms of given names in several languages with the names they stand for, and abbreviated
# words of organisations.
NICKNAMES = {
    k: tuple(v.split())
    for k, v in (
        line.split(" ", 1)
        for line in (
            "abby abigail|al alan albert alfred|alex alexander alexandra|allie alison|andy andrew andreas|angie angela|annie anne anna|barb barbara|bea beatrice beatriz|becky rebecca|ben benjamin|bernie bernard|bert albert herbert robert|bess elizabeth|"
            "beth elizabeth|betty elizabeth|bill william|billy william|bob robert|bobby robert|brad bradley|cathy catherine|charlie charles|chris christopher christian christine|chuck charles|cindy cynthia|connie constance|dan daniel|danny daniel|"
            "dave david|deb deborah|debbie deborah|dick richard|dolly dorothy|don donald|donny donald|dora dorothy theodora|doug douglas|drew andrew|ed edward edgar edwin|eddie edward|ella eleanor|ellie eleanor|fran frances|frank francis franklin|"
            "fred frederick friedrich|gabby gabriela gabrielle|gabi gabriela gabriele|gene eugene|geoff geoffrey|gerry gerald|gianni giovanni|ginny virginia|greg gregory|gus gustav augustus|hal harold henry|hank henry|hans johannes|harry harold henry|"
            "heinz heinrich|hugo hugh|jack john|jackie jacqueline|jake jacob|jamie james|jan johannes|jeff jeffrey|jen jennifer|jenny jennifer|jerry gerald jerome|jim james|jimmy james|joe joseph|joey joseph|johnny john|jon jonathan|josh joshua|josie josephine|"
            "judy judith|kai kaspar|kate katherine catherine|kathy katherine kathleen|katie katherine|katya ekaterina|ken kenneth|kim kimberly|kiko francisco|klaus nikolaus|kurt konrad|larry lawrence|len leonard|lenny leonard|leo leonard leopold|lexi alexandra|"
            "liz elizabeth|lizzie elizabeth|lola dolores|lou louis louise|lucy lucia|lupe guadalupe|maggie margaret|mandy amanda|manolo manuel|manny manuel|marge margaret|matt matthew|max maximilian|meg margaret|mel melanie melvin|mick michael|mickey michael|"
            "mike michael|misha mikhail|mitch mitchell|moe maurice|molly mary|nacho ignacio|nan ann|nancy ann|nate nathan nathaniel|ned edward|nell eleanor helen|nellie eleanor|nick nicholas|nicky nicholas nicole|nina antonina|nora eleanor|paco francisco|"
            "pam pamela|pancho francisco|pat patricia patrick|patty patricia|peggy margaret|penny penelope|pepe jose|pete peter|phil philip|polly mary|ray raymond|reggie reginald|rich richard|rick richard|ricky richard|rob robert|robby robert|ron ronald|ronnie ronald|"
            "rosie rose|roy leroy|rudi rudolf|russ russell|sally sarah|sam samuel samantha|sammy samuel|sandy sandra alexander|sasha alexander alexandra|sepp josef|seppl josef|sid sidney|stan stanley|stas stanislav|steff stefanie stefan|steve stephen steven|sue susan|"
            "susie susan|suzy susan|tammy tamara|ted theodore edward|teddy theodore|terry terence teresa|tess teresa|theo theodore|tilly matilda|tim timothy|toby tobias|tom thomas|tommy thomas|tony anthony antonio|trish patricia|trudy gertrude|ulli ulrich|uli ulrich ulrike|"
            "val valerie|vanya ivan|vic victor|vicky victoria|vince vincent|viv vivian|volodya vladimir|walt walter|wes wesley|will william|willy william|wolf wolfgang|zach zachary|zack zachary"
        ).split("|")
    )
}
ORG_SHORT = {
    "assn": "association", "assoc": "association", "centre": "center", "collab": "collaboration", "ctr": "center", "dep": "department", "dept": "department", "grp": "group",
    "hosp": "hospital", "inst": "institute", "int": "international", "intl": "international", "lab": "laboratory", "labs": "laboratory", "natl": "national", "psychol": "psychology",
    "res": "research", "soc": "society", "univ": "university",
}
SHORT_OF = {w: [k for k, x in ORG_SHORT.items() if x == w] for w in set(ORG_SHORT.values())}
ORG_DROP = {"the", "of", "for", "on", "and", "f", "in", "at", "und", "et"}

_ORG_WORD = re.compile(rf"(?i)(?<![\w.])(?:{ORG})(?![\w])")
_DEGREE = re.compile(rf"(?i)(?:,\s*|\s+)(?:{DEGREES})\s*$")
_TITLE = re.compile(rf"(?i)^\s*(?:{TITLES})\s+")
_QUOTED = re.compile(r'["“”«»]([^"“”«»]*)["“”«»]|\(([^()]*)\)')


def _one_off(words: list[str]) -> set[str]:
    return {w[:k] + w[k + 1 :] for w in words for k in range(len(w))} | set(words)


_ORG_NEAR = _one_off(["university", "institute", "department", "hospital", "association", "laboratory", "collaboration", "consortium", "research"])


def full_names(x: str) -> tuple[str, ...]:
    """A given name and the names it may be short for."""
    return (x, *NICKNAMES.get(x, ()))


def is_organisation(s: str) -> bool:
    """Whether a name is an organisation's: one of its words, or one a typo away, or a function word."""
    if _ORG_WORD.search(s) or re.search(r"(?i)(?<!\w)(?:of|for|on|and|the)(?![\w.])|&", s):
        return True
    return any(len(w) >= 7 and not _one_off([w]).isdisjoint(_ORG_NEAR) for w in re.findall(r"[^\W_]+", fold(s)))


def fold(s: str) -> str:
    """Lower case without accents and apostrophes."""
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("æ", "ae"))
    return "".join(c for c in s if not unicodedata.combining(c)).lower().replace("'", "").replace("’", "")


def _given(words: list[str], capitals: bool) -> list[str]:
    """Given names: full names, initials (one letter), shortened names (with their full stop)."""
    out = []
    for w in words:
        parts = [p for p in re.split(r"(?<=\.)|[-‐]", w) if p]
        for p in parts:
            bare = fold(p.rstrip("."))
            if not bare or not bare[0].isalpha():
                continue
            if len(bare) == 1:
                out.append(bare)
            elif p.endswith("."):
                out.append(bare + ".")
            elif p.isupper() and len(p) <= 3 and not capitals:
                out += list(bare)
            elif p.isupper() and len(p) <= 2:
                out += list(bare)
            else:
                out.append(bare)
    return out


def _initials(w: str, capitals: bool) -> bool:
    """Whether a word is initials only."""
    letters = re.sub(r"[^\w]", "", w)
    return bool(letters) and (len(letters) == 1 or "." in w and re.fullmatch(r"(?:\w\.-?)+\w?", w) is not None or w.isupper() and len(letters) <= (2 if capitals else 3) and "." not in w)


def parse(name: str) -> list[tuple[str, str, str]]:
    """(kind, surname, given) readings of a spelling; more than one where the order of two words is open.

    ``given`` is the given names joined by blanks; for an organisation ``surname`` is empty and ``given`` its words.
    """
    s = " ".join(name.split())
    if is_organisation(s):
        words = [ORG_SHORT.get(w, w) for w in re.findall(r"[^\W_]+", fold(s))]
        words = sorted(w for w in words if w not in ORG_DROP)
        return [("o", "", " ".join(words))] if words else []
    nick = [x for m in _QUOTED.finditer(s) for x in m.groups() if x]
    s = " ".join(_QUOTED.sub(" ", s).replace(" ,", ",").split())
    while (t := _DEGREE.sub("", s)) != s and len(re.findall(r"[^\W_]+", t)) > 1:  # 'Surname, M.D.' holds initials
        s = t
    while (t := _TITLE.sub("", s)) != s:
        s = t
    s = s.strip(" ,;")
    capitals = s.isupper() and bool(re.search(r"\w{4,}", s))
    squeeze = lambda ws: re.sub(r"[^\w]", "", fold("".join(ws)))
    if "," in s:
        last, _, first = s.partition(",")
        if _TITLE.match(first):
            first = _TITLE.sub("", first)
        given = _given(first.replace(",", " ").split(), capitals)
        if not given and nick:
            given = [fold(nick[0])]
        return [("p", squeeze([last]), " ".join(given))]
    words = s.split()
    ini = [_initials(w, capitals) for w in words]
    if len(words) == 1 or all(ini):
        return [("p", squeeze(words), fold(nick[0]) if nick else "")] if words else []
    if ini[-1]:  # Surname X. / Surname Given X.
        return [("p", squeeze(words[:1]), " ".join(_given(words[1:], capitals)))]
    if any(ini):  # G. Surname / Given M. Surname
        k = max(i for i, x in enumerate(ini) if x) + 1
        return [("p", squeeze(words[k:]), " ".join(_given(words[:k], capitals)))]
    # a given name cut short stands before or behind the surname
    if words[-1].endswith("."):
        return [("p", squeeze(words[:-1]), " ".join(_given(words[-1:], capitals)))]
    if words[0].endswith("."):
        return [("p", squeeze(words[1:]), " ".join(_given(words[:1], capitals)))]
    first = ("p", squeeze(words[1:]), " ".join(_given(words[:1], False) if not words[0].isupper() else [fold(words[0])]))
    last = ("p", squeeze(words[:-1]), fold(words[-1]))
    return [first, last]


def edits(a: str, b: str, most: int) -> int:
    """Edit distance with exchanges of neighbours; ``most`` + 1 where it is larger."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


# Log likelihoods of what a typist does to a canonical form.
INITIAL, SHORT, NICK, LEFT_OUT, ADDED, TYPO_GIVEN, TYPO_SURNAME, WORD_LEFT_OUT, SPELT_OUT = (math.log(p) for p in (0.3, 0.1, 0.1, 0.3, 0.05, 0.01, 0.04, 0.02, 0.2))


def channel(kind: str, sv: str, gv: str, sc: str, gc: str) -> tuple[float, int] | None:
    """Log likelihood of the variant (sv, gv) given the canonical form (sc, gc) and the number of typos; None if impossible."""
    if kind == "o":
        v, c = gv.split(), gc.split()
        only_v, only_c = [w for w in v if w not in c], [w for w in c if w not in v]
        if not only_v and len(only_c) == 1 and len(v) >= 3:
            return WORD_LEFT_OUT, 1
        if not only_c and len(only_v) == 1 and len(c) >= 3:
            return WORD_LEFT_OUT, 1
        left_out = len(only_c) - len(only_v)
        if not (left_out == 0 or left_out == 1 and len(v) >= 3) or not 1 <= len(only_v) <= 2:
            return None
        ll, typos = left_out * WORD_LEFT_OUT, left_out
        for x in only_v:
            apart = lambda y: min([edits(x, y, 2), *(edits(x, z, 1) + (edits(x, z, 1) > 1) for z in SHORT_OF.get(y, ()))])  # noqa: B023, E731
            best = min(only_c, key=apart)
            if apart(best) > (1 if len(x) < 8 or len(only_v) > 1 else 2):
                return None
            only_c.remove(best)
            ll, typos = ll + TYPO_SURNAME, typos + 1
        return ll, typos
    ll, typos = 0.0, 0
    if sv != sc:
        if min(len(sv), len(sc)) < 4 or edits(sv, sc, 1) > 1:
            return None
        ll, typos = ll + TYPO_SURNAME, 1
    v, c = gv.split(), gc.split()
    if not v and not c:  # a bare surname is linked to its own typo only
        return (ll, typos) if typos else None
    if not v or not c:
        return None
    for k in range(max(len(v), len(c))):
        if k >= len(v):
            ll += LEFT_OUT
        elif k >= len(c):
            if len(v[k]) > 1:
                return None
            ll += ADDED
        elif v[k] != c[k]:
            x, y = v[k], c[k]
            fx, fy = full_names(x), full_names(y)
            starts = lambda names, part: any(n.startswith(part) for n in names)
            if len(x) == 1 and starts(fy, x):
                ll += INITIAL
            elif len(y) == 1 and starts(fx, y):
                ll += SPELT_OUT
            elif x.endswith(".") and starts(fy, x[:-1]):
                ll += SHORT
            elif x.endswith(".") and len(y) > 3 and edits(x[:-1], y[: len(x) - 1], 1) <= 1 and x[0] == y[0]:
                ll, typos = ll + SHORT + TYPO_GIVEN, typos + 1
            elif not set(fx).isdisjoint(fy) or len(x) >= 3 and any(n.startswith(x) and len(n) > len(x) + 1 for n in fy):
                ll += NICK
            elif min(len(x), len(y)) >= 3 and not x.endswith(".") and not y.endswith(".") and (edits(x, y, 1) <= 1 or any(min(len(m), len(n)) >= 4 and edits(m, n, 1) <= 1 for m in fx for n in fy)):
                ll, typos = ll + TYPO_GIVEN, typos + 1
            elif sv == sc and min(len(x), len(y)) >= 6 and edits(x, y, 2) <= 2:
                ll, typos = ll + 2 * TYPO_GIVEN, typos + 1
            else:
                return None
    return ll, typos


def _deletes(s: str) -> list[str]:
    return sorted({s, *(s[:k] + s[k + 1 :] for k in range(len(s)))}) if len(s) >= 4 else [s]


def block_keys(kind: str, surname: str, given: str, rare: str) -> tuple[list[str], list[str]]:
    """Keys under which a class looks for candidates, and under which it is found as one.

    Organisations: their two rarest words one edit apart. Full given names: with the surname one edit apart, the name
    itself, a name it is short for or its first letters; with the surname as it is, the given name one edit apart.
    Initials and shortened names look for every given name of their first letter; as candidates, all names are found by
    it, and full names look for the forms of initials too. Bare surnames look for bare surnames. So two full names of one surname and initial don't meet unless alike, and
    the few forms of initials of a surname meet its names, not the names each other.
    """
    if kind == "o":
        keys = [f"o|{d}" for w in (rare or "").split() for d in _deletes(w)]
        return keys, keys
    near = _deletes(surname)
    first = given.split()[0] if given else ""
    if not first:
        keys = [f"n|{d}" for d in near]
        return keys, keys
    heads = [f"i|{d}|{h}" for d in near for h in sorted({n[0] for n in full_names(first)})]
    short = [f"h{x[1:]}" for x in heads]
    if len(first) == 1 or first.endswith("."):
        return heads, heads + short
    names = full_names(first)
    both = [f"f|{d}|{n}" for d in near for n in names] + [f"s|{d}|{h}" for d in near for h in sorted({n[:3] for n in names})]
    both += sorted({f"g|{surname}|{d}" for n in names for d in _deletes(n)})
    # with a typo in the surname, too: the end of a long name, or a short name one edit apart
    both += sorted({f"e|{d}|{x}" for d in near for n in names for x in [n[-3:]] * (len(n) >= 5) + _deletes(n) * (len(n) <= 6)})
    return both + short, both + heads


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("surname", pa.string()), ("given", pa.string())]))
    for b in batches:
        rows = [[dict(zip(("kind", "surname", "given"), r, strict=True)) for r in parse(n)] for n in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, kind)], names=["name", "n", "readings"])


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.list_(pa.string())
    for b in batches:
        rows = b.to_pydict()
        keys = [block_keys(k, s, g, r) for k, s, g, r in zip(rows["kind"], rows["surname"], rows["given"], rows["rare"], strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([k for k, _ in keys], lists), pa.array([k for _, k in keys], lists)], names=["cid", "looks", "found"])


def _score_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        r = b.to_pydict()
        v_out, c_out, score = [], [], []
        for kind, v, sv, gv, nv, tv, c, sc, gc, nc, tc, ic in zip(*(r[k] for k in ("kind", "v", "sv", "gv", "nv", "tv", "c", "sc", "gc", "nc", "tc", "ic")), strict=True):
            got = channel(kind, sv, gv, sc, gc)
            if got is None:
                continue
            ll, typos = got
            vt, ct, prior = gv.split(), gc.split(), nc
            full = lambda ts: (sum((len(t) > 1) - 0.5 * t.endswith(".") for t in ts), len(ts))
            if kind == "o":
                keep = nc > nv or nc == nv and c < v
                own = math.log(nv) + math.log(1e-3)
            elif typos and sv != sc:
                # the rarer surname is the typo, unless another person has these given names by chance
                keep = (tc, nc, c) > (tv, nv, v)
                own = math.log(tv) + math.log(max(math.prod(0.05 if len(t) == 1 else 0.01 for t in vt), 1e-3))
                prior = tc
            elif typos:
                # all spellings with this surname and initial stand behind the canonical form
                keep = True
                own = math.log(nv) + math.log(max(math.prod(0.05 if len(t) == 1 else 0.005 for t in vt), 1e-4))
                prior = max(nc, ic - nv if gv[0] == gc[0] else nc)
            else:
                keep = (full(ct), nc, c) > (full(vt), nv, v)
                own = -math.inf  # an abbreviation belongs to somebody
            posterior = math.log(prior) + ll
            if keep and posterior > own:
                v_out.append(v), c_out.append(c), score.append(math.log(nc) + ll)
        yield pa.RecordBatch.from_arrays([pa.array(v_out, pa.int64()), pa.array(c_out, pa.int64()), pa.array(score, pa.float64())], names=["v", "c", "score"])


def name_groups(names: DataFrame, column: str = "author_name") -> DataFrame:
    """(name, n, entity): every distinct spelling, its frequency and the entity it is attached to.

    Null and blank spellings are left out; repeated rows only raise the frequency; other columns are ignored; an empty
    table gives an empty result. Frequencies are combined map-side, so a spelling of any share is one row afterwards.
    """
    counted = names.select(F.col(f"`{column}`").alias("name")).filter(F.trim("name") != "").groupBy("name").agg(F.count("*").alias("n"))
    parsed = counted.mapInArrow(_parse_batches, "name string, n bigint, readings array<struct<kind:string,surname:string,given:string>>")
    parsed = cut(parsed.filter(F.size("readings") > 0))
    # The order of two bare words is settled by how often each is a surname or given name where the order is clear.
    clear = parsed.filter(F.size("readings") == 1).select("n", F.col("readings")[0].alias("r")).filter("r.kind = 'p'")
    surnames = clear.groupBy(F.col("r.surname").alias("surname")).agg(F.sum("n").alias("as_surname"))
    given = clear.select("n", F.explode(F.split("r.given", " ")).alias("given")).filter("length(given) > 1").groupBy("given").agg(F.sum("n").alias("as_given"))
    read = parsed.select("name", "n", F.posexplode("readings").alias("pos", "r")).select("name", "n", "pos", "r.kind", "r.surname", "r.given")
    open_ = read.join(surnames, "surname", "left").join(given, "given", "left")
    score = F.log1p(F.coalesce("as_surname", F.lit(0))) + F.log1p(F.coalesce("as_given", F.lit(0)))
    chosen = open_.groupBy("name", "n").agg(F.max_by(F.struct("kind", "surname", "given"), F.struct(score, -F.col("pos"))).alias("r"))
    placed = cut(chosen.select("name", "n", "r.*").withColumn("cid", F.xxhash64("kind", "surname", "given")))
    classes = placed.groupBy("cid").agg(F.first("kind").alias("kind"), F.first("surname").alias("surname"), F.first("given").alias("given"), F.sum("n").alias("n"))
    totals = classes.groupBy("kind", "surname").agg(F.sum("n").alias("total"))
    classes = classes.withColumn("head", F.substring("given", 1, 1))
    heads = classes.groupBy("kind", "surname", "head").agg(F.sum("n").alias("initial"))
    # the two rarest words of an organisation stand for its surname
    words = classes.filter("kind = 'o'").select("cid", "n", F.explode(F.array_distinct(F.split("given", " "))).alias("w"))
    often = words.groupBy("w").agg(F.sum("n").alias("df"))
    rare = words.join(often, "w").groupBy("cid").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("df", "w"))), 1, 2), lambda x: x["w"]), " ").alias("rare"))  # words of one name
    classes = cut(classes.join(totals, ["kind", "surname"]).join(heads, ["kind", "surname", "head"]).join(rare, "cid", "left"))
    keys = cut(classes.select("cid", "kind", "surname", "given", "rare").mapInArrow(_key_batches, "cid bigint, looks array<string>, found array<string>"))
    looks = keys.select(F.col("cid").alias("v"), F.explode("looks").alias("key")).select("v", F.xxhash64("key").alias("key"))
    found = keys.select(F.col("cid").alias("c"), F.explode("found").alias("key")).select("c", F.xxhash64("key").alias("key"))
    pairs = looks.join(found, "key").filter("v <> c").select("v", "c").distinct()
    side = lambda k: classes.select(F.col("cid").alias(k), F.col("surname").alias("s" + k), F.col("given").alias("g" + k), F.col("n").alias("n" + k), F.col("total").alias("t" + k), F.col("initial").alias("i" + k))
    full = pairs.join(side("v"), "v").join(side("c").join(classes.select(F.col("cid").alias("c"), "kind"), "c"), "c")
    scored = full.mapInArrow(_score_batches, "v bigint, c bigint, score double")
    links = scored.groupBy("v").agg(F.max_by("c", F.struct("score", "c")).alias("c"))
    groups = components(links, "v", "c")
    return placed.join(groups.select(F.col("vertex").alias("cid"), "component"), "cid", "left").select("name", "n", F.coalesce("component", "cid").alias("entity"))


def same_entity_pairs(groups: DataFrame) -> DataFrame:
    """(name_a, name_b) of different spellings of one entity, name_a before name_b by code point."""
    a, b = groups.select("entity", F.col("name").alias("name_a")), groups.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b")


def author_variants(articles: DataFrame) -> DataFrame:
    """(name, n, entity) of the single authors of a table of references."""
    return name_groups(author_names(articles))
