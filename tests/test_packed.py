"""Several values in one field."""

import pytest

from refsieve.operators.packed import author_names, resolve, segments, split_packed

CASES = {
    "Balilund, D K; Folmandall, Kofi T.; Daniel Quinkomum & F. Figuvelle": ["Balilund, D K", "Folmandall, Kofi T.", "Daniel Quinkomum", "F. Figuvelle"],
    '"Malmemen, K.","Jaeckinilk, Zofia C.","Quindutolt, Samuel ""Sam"""': ["Malmemen, K.", "Jaeckinilk, Zofia C.", 'Quindutolt, Samuel "Sam"'],
    "Balodarro, C.K., Krounkidona, J.": ["Balodarro, C.K.", "Krounkidona, J."],
    "A. Wourdixona, Zofia Keitalard, Katherine F. Malobix": ["A. Wourdixona", "Zofia Keitalard", "Katherine F. Malobix"],
    "Center for Stress and Coping, Drutanugo": ["Center for Stress and Coping, Drutanugo"],
    '"Center for Stress and Coping, Drutanugo" and Jeilekarro, Jelena B. and Wounkogost F': ["Center for Stress and Coping, Drutanugo", "Jeilekarro, Jelena B.", "Wounkogost F"],
    "A. B. Sturn; POGISOST COLLABORATION ON SLEEP, STRESS & RECOVERY; R. Veis": ["A. B. Sturn", "POGISOST COLLABORATION ON SLEEP, STRESS & RECOVERY", "R. Veis"],
    "Wourdixona, Irena M. et al": ["Wourdixona, Irena M."],
    "Fibendesh, I, et al.": ["Fibendesh, I"],
    "Ugo C. Quimorkelle and others": ["Ugo C. Quimorkelle"],
    "Chidi Malobix; …": ["Chidi Malobix"],
    "Traezorkolt ZK; Rigidum, Oksana, PhD": ["Traezorkolt ZK", "Rigidum, Oksana, PhD"],
    "Haelmembyre AL and Goran Taan": ["Haelmembyre AL", "Goran Taan"],
    " Gotosten SA;; V. Drinesyre; ; Inst. for Stress Research; and L. Bamo; ": ["Gotosten SA", "V. Drinesyre", "Inst. for Stress Research", "L. Bamo"],
    "Natuxen, Kofi\r\nQuust Study Group\r\nNabémyre, Heinrich V.": ["Natuxen, Kofi", "Quust Study Group", "Nabémyre, Heinrich V."],
    "Department of Psychology, University of Housur; Ribunesh, E": ["Department of Psychology, University of Housur", "Ribunesh, E"],
    'Deborah "Debbie" Dernastona and P. Kroo': ['Deborah "Debbie" Dernastona', "P. Kroo"],
    "Pesundiva, S./Oksana Sovidugo|X. Y": ["Pesundiva, S.", "Oksana Sovidugo", "X. Y"],
    "Meridian Consortium": ["Meridian Consortium"],
}


def test_cases(spark):
    rows = [(k, s) for k, s in enumerate(CASES)] + [(90, None), (91, ""), (92, "   ")]
    out = author_names(spark.createDataFrame(rows, "ord bigint, author string")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["ord"], r["pos"])):
        got.setdefault(r["ord"], []).append((r["pos"], r["author_name"]))
    for k, s in enumerate(CASES):
        assert got[k] == list(enumerate(CASES[s], 1)), s
    assert not {90, 91, 92} & set(got)


def test_skeletons_by_segment():
    found = segments('Ab, C.; "D; E" and F G;;\r\n ; H')
    assert [k for _, k in found] == ["w,_i", "Q_a_j_j", "j"] and len(resolve("Q_a_j_j")) == 2
    assert all("".join(tokens) in 'Ab, C.; "D; E" and F G;;\r\n ; H' for tokens, _ in found)


def test_edges(spark):
    assert split_packed(spark.createDataFrame([], "ord bigint, author string"), "author", ["ord"]).count() == 0
    long_ = "; ".join(f"Name{k}, A." for k in range(4000))
    df = spark.createDataFrame([(1, long_, "x", 5), (1, "A. Bcd", "y", 6), (1, "A. Bcd", "y", 6)], "ord bigint, author string, pos string, value int")
    out = split_packed(df, "author", ["ord"], "pos", "value")
    assert out.columns == ["ord", "pos", "value"] and out.count() == 4002


def test_as_typed(spark):
    df = spark.createDataFrame([(1, "\u00a0Ab\u00a0Cde, D.\u2009;\tEf,\u00a0G.\u2003"), (2, "x" * 200_000 + "; " + " " * 50_000 + '"' + "y" * 100_000)], "ord bigint, author string")
    out = {(r["ord"], r["pos"]): r["author_name"] for r in author_names(df).collect()}
    assert out[1, 1] == "Ab\u00a0Cde, D." and out[1, 2] == "Ef,\u00a0G." and len(out[2, 1]) == 200_000


def test_rare_skeletons_are_resolved_in_place(spark, monkeypatch):
    import refsieve.operators.packed as packed

    rows = [(k, s) for k, s in enumerate(CASES)]
    df = spark.createDataFrame(rows, "ord bigint, author string")
    whole = {tuple(r) for r in author_names(df).collect()}
    monkeypatch.setattr(packed, "RULE_ROWS", 2)
    monkeypatch.setattr(packed, "HOT_SHARE", 15)
    assert {tuple(r) for r in author_names(df).collect()} == whole


@pytest.mark.parametrize("s", ["", ";", "w", "w_a_w", ",,,", "x", "e_l", "Q,Q"])
def test_resolver_never_overlaps(s):
    at = 0
    for a, b in resolve(s):
        assert a >= at and b > a
        at = b
