"""Surviving fields."""

from refsieve.llm.survivors import golden_records, lacks_tail, survivor_fields

SCHEMA = "ord bigint, doi string, title string, author string, year string, source_db string, exported_at timestamp_ntz, vote string"


def stamp(day):
    import datetime

    return datetime.datetime(2021, 1, 1) + datetime.timedelta(days=day)


def frame(spark):
    rows = [
        (3, "10.5555/A", "A long title of a work on sleep", "X, Y. et al.", "200", "low", stamp(1), "v"),
        (1, "doi:10.5555/a", "A long title of a...", "X, Y.; Z, W.", " ", "low", stamp(2), "v"),
        (2, "https://doi.example/10.5555/a.", "A long title of a w", None, "(2011)", "high", stamp(3), "v"),
        (4, "10.5555/a", "A long title of a work on sleep!", " ", "20??", "high", stamp(4), "v"),
        (5, "10.5555/b", "alone", "Q", "2000", "high", stamp(1), "v"),
        (6, "10.5555/c", None, "et al.", "no date", None, None, "v"),
        (7, "<10.5555/C>", "  ", "…", "20", "unknown", None, "v"),
        (8, None, "t", "a", "2000", "high", stamp(1), "v"),
    ]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("low", 1), ("high", 5)], "source_db string, trust int")


def test_fields(spark):
    out = {(r["group_ord"], r["field"]): r["from_ord"] for r in survivor_fields(*frame(spark)).collect()}
    assert out == {(1, "title"): 4, (1, "author"): 1, (1, "year"): 2, (1, "doi"): 4, (6, "doi"): 6}


def test_golden(spark):
    out = {r["group_ord"]: r for r in golden_records(*frame(spark)).collect()}
    assert out[1]["year"] == "(2011)" and out[1]["author"] == "X, Y.; Z, W." and out[6]["title"] is None
    assert set(out) == {1, 6}


def test_empty(spark):
    a, t = frame(spark)
    assert survivor_fields(a.limit(0), t).count() == 0 and survivor_fields(a, t.limit(0)).count() == 5


def test_added_words_cut_nothing_off(spark):
    whole = "The role of grit in absenteeism of adolescents: a pre-registered replication"
    rows = [(1, "10.5555/a", whole, "X, Y.", "2001", "high", stamp(3), "v"), (2, "10.5555/a", whole.replace("registered", "registered possible recent"), "X, Y.", "2001", "low", stamp(1), "v"),
            (3, "10.5555/b", "Optimism among pregnant women", "X, Y.", "2001", "high", stamp(3), "v"), (4, "10.5555/b", "Optimism amogn pregnant potential wlen", "X, Y.", "2001", "low", stamp(1), "v"),
            (5, "10.5555/c", whole[:68], "X, Y.", "2001", "high", stamp(3), "v"), (6, "10.5555/c", whole.replace("registered", "registered possible"), "X, Y.", "2001", "low", stamp(1), "v"),
            (7, "10.5555/d", "Optimism among pregnant", "X, Y.", "2001", "high", stamp(3), "v"), (8, "10.5555/d", "Optimism amogn pregnant potential women", "X, Y.", "2001", "low", stamp(1), "v")]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["group_ord"]: r["from_ord"] for r in survivor_fields(df, frame(spark)[1]).filter("field = 'title'").collect()}
    assert out == {1: 1, 3: 3, 5: 6, 7: 8}


def test_lacks_tail():
    assert lacks_tail("how nurses in stoulmolten co".split(), "how nurses in stoulmolten cope job burnout hope and irritability".split())
    assert not lacks_tail("a daily diary study of nurses".split(), "a daily diary self reported study among potential early nurses".split())
