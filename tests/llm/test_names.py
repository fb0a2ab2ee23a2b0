"""Spellings of names."""

import pytest

from refsieve.llm.names import block_keys, channel, edits, name_groups, parse, same_entity_pairs


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Sturmugin, Emeka H.", ("p", "sturmugin", "emeka h")), ("STURMUGIN, E. H.", ("p", "sturmugin", "e h")), ("Sturmugin EH", ("p", "sturmugin", "e h")), ("Rigidum, Oksana, PhD", ("p", "rigidum", "oksana")), ("Fumasall, M.D.", ("p", "fumasall", "m d")),
        ("Marg. Haendenelle", ("p", "haendenelle", "marg.")), ('Quindutolt, Samuel "Sam"', ("p", "quindutolt", "samuel")), ("Krourdeben Zachary C.", ("p", "krourdeben", "zachary c")), ("Prof. V. Veistandarro", ("p", "veistandarro", "v")),
        ("The Ctr. for Stress & Coping, Drutanugo", ("o", "", "center coping drutanugo stress")), ("Unviersity of X", ("o", "", "unviersity x")), ("Wourétall, F.", ("p", "wouretall", "f")),
    ],
)
def test_parse(name, want):
    assert parse(name)[0] == want


def test_edits():
    assert [edits(a, b, 2) for a, b in (("ab", "ab"), ("abcd", "abdc"), ("abcd", "abd"), ("abc", "xyz"), ("", "ab"))] == [0, 1, 1, 3, 2]


def test_channel():
    assert channel("p", "rigidum", "o", "rigidum", "oksana") and channel("p", "rigidum", "sam", "rigidum", "samuel p") and channel("p", "riigidum", "robert", "rigidum", "robert p")
    assert channel("p", "rigidum", "olga", "rigidum", "oksana") is None and channel("p", "malobix", "c", "malobix", "anna") is None
    assert channel("o", "", "coping center drutanugo", "", "center coping drutanugo stress") and channel("o", "", "kandor university", "", "hospital kandor university") is None


@pytest.mark.parametrize(("short", "full"), [("jack", "john"), ("jenny", "jennifer"), ("steve", "stephen"), ("steve", "steven"), ("larry", "lawrence"), ("harry", "henry"), ("pepe", "jose"), ("bob", "robert"), ("uli", "ulrike")])
def test_nicknames(short, full):
    assert channel("p", "rigidum", short, "rigidum", full)


def test_bare_surnames(spark):
    got, _ = groups(spark, ["Rigidum"] * 40 + ["Riigidum", "Malobix", "Rigidum, Oksana"])
    assert got == [["Malobix"], ["Rigidum", "Riigidum"], ["Rigidum, Oksana"]]


def test_keys_find_what_the_channel_links():
    """Classes that the channel links share a key in one direction; two unlike full names of a surname share none."""
    share = lambda a, b: bool({*block_keys(*a, "")[0]} & {*block_keys(*b, "")[1]} or {*block_keys(*b, "")[0]} & {*block_keys(*a, "")[1]})
    names = ["oksana", "o", "oks.", "oksanna", "olga", "robert", "bob", "r p", "samuel", "sam", "osana m", ""]
    for s1 in ("rigidum", "riigidum", "malobix"):
        for g1 in names:
            for s2 in ("rigidum", "malobix"):
                for g2 in names:
                    if (s1, g1) != (s2, g2) and (channel("p", s1, g1, s2, g2) or channel("p", s2, g2, s1, g1)):
                        assert share(("p", s1, g1), ("p", s2, g2)), (s1, g1, s2, g2)
    assert not share(("p", "wang", "xiulan"), ("p", "wang", "xoanbo")) and not share(("p", "wang", "olga"), ("p", "wang", "oksana"))


def groups(spark, names):
    g = name_groups(spark.createDataFrame([(n, 1) for n in names], "author_name string, n int"))
    out = {}
    for r in g.collect():
        out.setdefault(r["entity"], set()).add(r["name"])
    return sorted(map(sorted, out.values())), g


def test_groups(spark):
    one = ["Rigidum, Oksana"] * 20 + ["Rigidum, O."] * 9 + ["Oksana Rigidum", "RIGIDUM, OKSANA", "Rigidum, Oksana, PhD", "Oks. Rigidum", "Rigidum O", "Oksana Riigidum"]
    two = ["Rigidum, Samuel P."] * 8 + ["S. P. Rigidum", "Rigidum, Sam", 'Samuel "Sam" Rigidum']
    org = ["Center for Stress and Coping, Drutanugo"] * 9 + ["Ctr. f. Stress & Coping, Drutanugo", "Center for Stress and Coping, Drutanugoo"]
    alone = ["Malobix, Chidi", "Malobix, Anna", None, "", "  "]
    got, g = groups(spark, one + two + org + alone)
    assert got == sorted(map(sorted, [set(one), set(two), set(org), {"Malobix, Chidi"}, {"Malobix, Anna"}]))
    pairs = same_entity_pairs(g).collect()
    assert len(pairs) == sum(len(x) * (len(x) - 1) // 2 for x in got) and all(r["name_a"] < r["name_b"] for r in pairs)


def test_empty(spark):
    assert groups(spark, [None, ""])[0] == []
