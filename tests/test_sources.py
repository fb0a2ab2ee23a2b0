"""RIS, CSV, run metadata, tracked files."""

from pyspark.sql import functions as F

from refsieve.sources.formats import read_references, write_references
from refsieve.sources.ris import parse_record, read_ris, to_table, write_ris
from refsieve.sources.tables import meta_paths, meta_time, read_articles, read_excerpts, read_run_meta, tracked_files, write_csv

RIS = "TY  - JOUR\nTI  - A title\nAU  - X, Y\nAU  - Z, W\nDO  - 10.1/a\nPY  - 2001\nER  - \n\nTY  - JOUR\nTI  - Other\n continued\nKW  - k\nZZ  - odd\nER  - \nTY  - JOUR\nT1  - Third é\nY1  - 1999\n"


def rows(df):
    return [tuple(r) for r in df.orderBy("ord").collect()]


def test_read(spark, tmp_path):
    for name, text in (("a.ris", RIS), ("b.ris", RIS.replace("\n", "\r\n"))):
        (tmp_path / name).write_text(text, encoding="utf-8", newline="")
    t = to_table(read_ris(spark, str(tmp_path)))
    got = rows(t.select("ord", "doi", "title", "author", "year"))
    want = [("10.1/a", "A title", "X, Y and Z, W", "2001"), (None, "Other continued", None, None), (None, "Third é", None, "1999")]
    assert got == [(k, *w) for k, w in enumerate(want * 2)]
    assert t.filter("ord = 1").first()["extra"] == {"type": ["JOUR"], "keywords": ["k"], "ZZ": ["odd"]}


def test_order_over_many_splits(spark, tmp_path):
    (tmp_path / "a.ris").write_text("".join(f"TY  - JOUR\nTI  - title {k}\nER  - \n\n" for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        out = rows(to_table(read_ris(spark, str(tmp_path / "a.ris"))).select("ord", "title"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert out == [(k, f"title {k}") for k in range(3000)]


def test_round_trip(spark, tmp_path):
    data = [(0, "10.1/a", "A  b", "X, Y and Z", "2001"), (1, None, None, None, None), (2, "d", "T - x", "Q", "1")]
    df = spark.createDataFrame(data, "ord bigint, doi string, title string, author string, year string")
    for files in (1, None):
        path = write_ris(df, str(tmp_path / f"out{files}"), files=files)
        assert rows(to_table(read_ris(spark, path)).select("ord", "doi", "title", "author", "year")) == data


def test_round_trip_keeps_every_field(spark, tmp_path):
    text = "TY  - CHAP\nTI  - A\nAU  - X, Y\nAU  - Z, W\nDO  - 10.1/a\nPY  - 2001\nAB  - Some words\nJO  - J\nKW  - k1\nKW  - k2\nN1  - note\nZZ  - odd\nER  - \n\nTY  - JOUR\nTI  - B\nER  - \n"
    (tmp_path / "in.ris").write_text(text)
    one = to_table(read_ris(spark, str(tmp_path / "in.ris")))
    path = write_ris(one, str(tmp_path / "out"), files=1)
    two = to_table(read_ris(spark, path))
    assert rows(one) == rows(two)
    assert two.filter("ord = 0").first()["extra"] == {"type": ["CHAP"], "abstract": ["Some words"], "journal": ["J"], "keywords": ["k1", "k2"], "notes": ["note"], "ZZ": ["odd"]}
    odd = spark.createDataFrame([(0, "t", {"a long name": ["v"], "keywords": ["x", None], "empty": [], "none": None})], "ord bigint, title string, extra map<string,array<string>>").selectExpr("ord", "title", "string(null) doi", "string(null) author", "string(null) year", "extra")
    back = to_table(read_ris(spark, write_ris(odd, str(tmp_path / "odd")))).first()
    assert back["extra"] == {"type": ["JOUR"], "notes": ["a long name: v"], "keywords": ["x"]}


def test_parse_edges(spark):
    df = spark.createDataFrame([("",), (None,), ("no tags",)], "s string").select(parse_record(F.col("s")).alias("t"))
    assert [r["t"] for r in df.collect()] == [[], None, []]


def test_csv(spark, tmp_path):
    data = [(2, 'a "b", c', "x\ny", None), (1, None, "q", "r"), (3, "ü", "", "s")]
    df = spark.createDataFrame(data, "ord bigint, mc string, hc1 string, hc2 string")
    path = write_csv(df, str(tmp_path / "c"), files=1)
    got = [tuple(r) for r in read_excerpts(spark, path).collect()]
    parts = [tuple(r) for r in read_excerpts(spark, write_csv(df, str(tmp_path / "p"))).collect()]
    assert sorted(parts, key=repr) == sorted(got, key=repr)
    assert got == [(None, "q", "r"), ('a "b", c', "x\ny", None), ("ü", None, "s")]


def test_meta_and_files(spark, tmp_path):
    (tmp_path / "meta").write_text("name|type|data|command|depend|seed|path|time|size|bytes|format|repository|iteration|parent|children|seconds|warnings|error\nx|stem|a|b|c|1|p*q|t1.5s|s|10|file|local|vector|||0.1||\n")
    m = read_run_meta(spark, str(tmp_path / "meta")).select(F.unix_micros(meta_time(F.col("time"))).alias("t"), meta_paths(F.col("path")).alias("p"), "parent").first()
    assert tuple(m) == (129_600_000_000, ["p", "q"], None)
    d = tmp_path / "01-some-slug"
    d.mkdir()
    (d / "01-some-slug.md").write_text("# x\ny")
    a = read_articles(spark, str(tmp_path / "*" / "*.md")).first()
    assert (a["article_no"], a["slug"], a["text"]) == (1, "some-slug", "# x\ny")
    assert tracked_files(spark, str(d / "*.md")).first()["bytes"] == 5


def test_bibtex(spark, tmp_path):
    text = """% a comment
@comment{none}
@article{k1,
  title = {The {Stress} of
   nurses},
  author = {Xu, Yan and Zed, W.},
  doi = "10.1/a", year = 2001, keywords = {sleep; grief}, volume = {3}
}
@book{k2, title={Other}, author={Q, R.}}
"""
    (tmp_path / "a.bib").write_text(text)
    t = to_table(read_references(spark, str(tmp_path / "a.bib")))
    assert rows(t.select("ord", "doi", "title", "author", "year")) == [(0, "10.1/a", "The Stress of nurses", "Xu, Yan and Zed, W.", "2001"), (1, None, "Other", "Q, R.", None)]
    assert t.filter("ord = 0").first()["extra"] == {"type": ["JOUR"], "keywords": ["sleep", "grief"], "volume": ["3"]}
    back = to_table(read_references(spark, write_references(t, str(tmp_path / "out.bib"))))
    assert rows(t) == rows(back)


def test_pubmed(spark, tmp_path):
    text = "PMID- 11\nTI  - Stress of\n      nurses.\nFAU - Xu, Yan\nAU  - Xu Y\nDP  - 2001 May\nLID - 10.1/a [doi]\nOT  - sleep\n\nPMID- 12\nTI  - Other\nAU  - Q R\n"
    for name, t in (("a.nbib", text), ("b.nbib", text.replace("\n", "\r\n"))):
        (tmp_path / name).write_text(t, newline="")
        got = to_table(read_references(spark, str(tmp_path / name)))
        assert rows(got.select("ord", "doi", "title", "author", "year")) == [(0, "10.1/a", "Stress of nurses.", "Xu, Yan", "2001"), (1, None, "Other", "Q R", None)]
        assert got.filter("ord = 0").first()["extra"] == {"type": ["JOUR"], "PMID": ["11"], "keywords": ["sleep"]}
