"""Detection of personal information: hand-written held-out texts, dynamic programming against enumeration, edge cases."""

import math
import random
from itertools import combinations

import refsieve.llm.pii as pii

# Written by hand, not by the grammar of the training texts: items stand in [kind|text], everything else is no item.
HELD_OUT = """
My supervisor [n|Maria Keller] told me to take two weeks off.
The interview with [n|Anna Schmidt] lasted almost an hour.
Dr. [n|Emily Carter] countersigned the consent sheet.
If it gets worse, ring the ward on [p|0171 2345678] before noon.
We stayed with relatives at [a|12 Rue de Rivoli, 75001 Paris] that summer.
The flat was at [a|221B Baker Street, London NW1 6XE] back then.
Nurse [n|Anna Keller] told us about the new rota.
Warm thanks to [n|Peter O'Brien] and [n|Lucía Gómez] for double coding.
For the syntax, please contact [n|Jonas Weber] ([e|jonas.weber@uni-mitte.de]).
Estimada [n|Carmen], gracias por su mensaje.
I spoke to [n|maria keller] yesterday and she was fine with it.
Sincerely,
[n|Thomas Müller]
[a|Hauptstraße 5, 10115 Berlin]
[p|+49 30 1234567]
My friend [n|Ahmed] said hope helps.
Her passport number is [i|C12345678], please blank it.
Letters should be sent to [n|Claire Dubois], [a|8 avenue Foch, 69006 Lyon].
Hello [n|Priya], did the transcripts arrive?
According to Smith et al. (2019), optimism declined in Boston.
The Beck Depression Inventory (Beck, 1961) has 21 items.
In San Francisco, nurses reported more stress than in Seattle.
The University of Michigan approved the protocol (no. 2019/12).
Interviewer: Good, [n|Samira], and what came after that?
We are indebted to [n|K. L. Fischer] for translating the scale.
From: [n|Helena Novak] <[e|h.novak@klinik-nord.example]>
Kind regards
[n|Oliver Grant]
Reach him under [e|o.grant (at) agency (dot) org] or [p|(415) 555-0199].
patient number [i|H204.118.09] was still in the header.
I moved to [a|77 Lakeview Drive, Austin, TX 78701] after the divorce.
Coders worked in pairs between March 2018 and June 2019.
Scores fell from 23.4 to 19.8 (p = .03, n = 1204).
My name is [n|Joanna Reyes] and I have two kids.
The transcript was checked by [n|David Cohen] in May.
Her employee number [i|E-204817] appears twice.
Funding came from grant 31-118-0045; see Table 4.
Jones and Patel (2004) disagree with Miller & Stone (2011).
The Hamilton Anxiety Scale was given again after 12 weeks.
Frau [n|Schneider] hat angerufen.
Bonjour [n|Camille], merci pour la relecture.
My sister [n|Teresa] drove me home.
Call [n|Mr Lindqvist|3] at [p|+46 8 123 456 78].
Resilience is not a fixed trait, as Garmezy (1991) argued.
We thank all participants and the staff of the clinic.
Please post it to [a|P.O. Box 114, Springfield 62701].
SSN [i|078-05-1120] must be deleted.
"""


def held_out():
    text, items, at = "", set(), 0
    kinds = {k[0]: k for k in pii.KINDS} | {"n": "person_name", "p": "phone"}
    while (a := HELD_OUT.find("[", at)) >= 0:
        b = HELD_OUT.index("]", a)
        kind, item, *skip = HELD_OUT[a + 1 : b].split("|")
        text += HELD_OUT[at:a]
        start = len(text) + (int(skip[0]) if skip else 0)
        text += item
        items.add((start, len(text), kinds[kind]))
        at = b + 1
    return text + HELD_OUT[at:], items


def test_held_out():
    text, want = held_out()
    assert len(want) > 35
    got = set(pii.train().find(text))
    right = len(got & want)
    assert right / len(want) >= 0.9, sorted(text[a:b] for a, b, _ in want - got)
    assert right / len(got) >= 0.9, sorted(text[a:b] for a, b, _ in got - want)


def sets(segments):
    n = len(segments)
    for size in range(n + 1):
        for pick in combinations(range(n), size):
            chosen = sorted(segments[i][:2] for i in pick)
            if all(a[1] <= b[0] for a, b in zip(chosen, chosen[1:], strict=False)):
                yield pick


def test_dynamic_programming():
    r = random.Random(2)
    for _ in range(40):
        segments = sorted([(a := r.randint(0, 12), a + r.randint(1, 5), "x", []) for _ in range(r.randint(1, 7))], key=lambda s: (s[1], s[0]))
        score = [r.uniform(-2, 3) for _ in segments]
        weight = {p: sum(score[i] for i in p) for p in sets(segments)}
        z = sum(math.exp(w) for w in weight.values())
        got = pii.marginals(segments, score)
        for i in range(len(segments)):
            assert math.isclose(got[i], sum(math.exp(w) for p, w in weight.items() if i in p) / z, rel_tol=1e-9)
        assert math.isclose(sum(score[i] for i in pii.best(segments, score)), max(weight.values()), abs_tol=1e-12)


def test_scores_agree():
    """Scoring by places gives the sums of the features of whole segments."""
    d = pii.train()
    text = held_out()[0]
    spans, scores = d.scored(text)
    full = {s[:3]: sum(d.weights.get(f, 0.0) for f in s[3] + s[4]) for s in pii.segments_of(text, d.cues)}
    assert set(spans) == set(full) and all(math.isclose(x, full[s], abs_tol=1e-9) for s, x in zip(spans, scores, strict=True))


def test_redaction():
    d = pii.train()
    text = "Dear Anna,\nplease write to a.b [at] c [dot] example or call +1-231-555-0177 ext. 4. As Weber (2001) argued, grant 31-364-005 ended."
    assert d.redact(text) == "Dear [NAME],\nplease write to [EMAIL] or call [PHONE]. As Weber (2001) argued, grant 31-364-005 ended."
    assert d.find("") == [] and d.find("nothing here") == []


def test_frame(spark):
    rows = [(1, "Dear Ann,\nDear Ann,\ncall me on 555-0193", "x", 1), (2, None, "x", 1), (3, "", "x", 1), (4, "plain " * 50_000 + "\nDear Bob,", "x", 1), (1, "Dear Ann,", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind string, found_text int")
    got = sorted(map(tuple, pii.find_items(df).collect()))
    assert got == [(1, "person_name", "Ann"), (1, "person_name", "Ann"), (1, "phone", "555-0193"), (4, "person_name", "Bob")]
    red = {(r["doc_id"], (r["text"] or "")[-8:]) for r in pii.redact(df).collect()}
    assert (2, "") in red and (4, " [NAME],") in red
    assert pii.find_items(df.limit(0)).count() == 0
