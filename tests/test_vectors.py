"""Similarity invariants and the pipeline."""

import math

from pyspark.sql import functions as F

from refsieve.operators.embed import embed_distinct, embed_texts, hashing_embedding
from refsieve.operators.vectors import cosine, cosine_to_queries, joined, joined_similarity, zip_pairs, zip_similarity
from refsieve.operators.dedup import dedup
from refsieve.plans.pipeline import Pipeline, Stage, bibliography_pipeline, full_code
from refsieve.streaming.dedup import stream_dedup


def test_cosine(spark):
    data = [([1.0, 2.0], [1.0, 2.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0), ([1.0, 1.0], [-2.0, -2.0], -1.0), ([1.0, 2.0], [10.0, 20.0], 1.0), ([0.0, 0.0], [1.0, 2.0], 0.0), (None, [1.0], None)]
    out = spark.createDataFrame(data, "a array<float>, b array<float>, w double").select(cosine(F.col("a"), F.col("b")).alias("s"), cosine(F.col("b"), F.col("a")).alias("t"), "w").collect()
    for r in out:
        assert r["s"] == r["t"]
        assert (r["s"] is None and r["w"] is None) or math.isclose(r["s"], r["w"], abs_tol=1e-12)


def test_queries_in_blocks(spark, monkeypatch):
    import refsieve.operators.vectors as v

    df = spark.createDataFrame([(k, [float(k % 7), 1.0]) for k in range(60)], "vec_id bigint, embedding array<float>")
    one = {tuple(r) for r in cosine_to_queries(df, "vec_id", "embedding", F.col("id") % 10 == 0).collect()}
    monkeypatch.setattr(v, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in cosine_to_queries(df, "vec_id", "embedding", F.col("id") % 10 == 0).collect()} == one
    assert len(one) == 6 * 59


def test_blocks_without_broadcast(spark, monkeypatch):
    import refsieve.operators.vectors as v

    df = spark.createDataFrame([(k, None if k == 7 else [0.0, 0.0] if k == 9 else [float(k % 5), 2.0]) for k in range(40)], "vec_id bigint, embedding array<float>")
    one = {tuple(r) for r in cosine_to_queries(df, "vec_id", "embedding", F.col("id") < 10, diagonal=True).collect()}
    for name, x in (("QUERY_BLOCK", 3), ("CHUNK", 7), ("BROADCAST_BLOCKS", 0)):
        monkeypatch.setattr(v, name, x)
    assert {tuple(r) for r in cosine_to_queries(df, "vec_id", "embedding", F.col("id") < 10, diagonal=True).collect()} == one
    sims = {(i, j): s for i, j, s in one}
    assert len(sims) == 400 and sims[7, 3] is None and sims[9, 1] == 0.0 and math.isclose(sims[3, 3], 1.0)
    assert cosine_to_queries(df.limit(0), "vec_id", "embedding", F.col("id") < 10).count() == 0


def test_similarities(spark):
    df = spark.createDataFrame([(1, ["abcd", "xyz"], ["abcd", "zzz", "q"])], "k int, p array<string>, q array<string>")
    embed = lambda c: hashing_embedding(c)
    assert [(r["pos"], round(r["sim"], 6)) for r in zip_similarity(df, ["k"], "p", "q", embed).collect()] == [(0, 1.0), (1, 0.0)]
    out = {(r["left"], r["right"]): r["sim"] for r in joined_similarity(df, ["k"], {"p": F.col("p"), "q": F.col("q"), "e": F.array()}, embed).collect()}
    assert set(out) == {("p", "q"), ("p", "e"), ("q", "e")} and 0 < out["p", "q"] < 1 and out["p", "e"] == 0.0


def test_embed_distinct(spark):
    df = spark.createDataFrame([(k, "abc" if k % 2 else None, f"t{k % 3} text") for k in range(30)], "k int, a string, b string")
    out = embed_distinct(df, ["a", "b"], hashing_embedding).collect()
    assert len(out) == 30 and all((r["a_vec"] is None) == (r["a"] is None) and sum(r["b_vec"]) == 5 for r in out)


def test_zip_and_join(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["x", "y"]), (2, [], ["x"]), (3, None, ["x"])], "k int, p array<string>, q array<string>")
    assert [tuple(r) for r in zip_pairs(df, ["k"], "p", "q").collect()] == [(1, 0, "a", "x"), (1, 1, "b", "y")]
    assert df.filter("k = 1").select(joined(F.col("p"))).first()[0] == "abc"


def test_embedders(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), (None,), ("ABCD",)], "t string")
    v = [r[0] for r in df.select(hashing_embedding(F.col("t"), 8)).collect()]
    assert sum(v[0]) == 2 and v[1] == [0.0] * 8 and v[2] is None and v[3] == v[0]
    out = [r["embedding"] for r in embed_texts(df, "t", lambda: lambda texts: [[float(len(t))] for t in texts]).collect()]
    assert out == [[4.0], [2.0], None, [4.0]]


def test_pipeline(spark, tmp_path):
    ris = tmp_path / "in.ris"
    ris.write_text("TY  - JOUR\nTI  - a\nER  - \nTY  - JOUR\nTI  - A\nER  - \n")
    run = lambda: bibliography_pipeline(spark, str(tmp_path / "store"), str(ris), str(tmp_path / "out"))
    p = run()
    assert set(p.run().values()) == {"ran"} and p.load("tbl_dedup").count() == 1
    p = run()
    assert set(p.run().values()) == {"skipped"} and p.ran == []
    ris.write_text("TY  - JOUR\nTI  - a\nER  - \nTY  - JOUR\nTI  - b\nDO  - x\nER  - \n")
    p = run()
    assert set(p.run().values()) == {"ran"} and p.load("tbl_dedup").count() == 2
    assert "tbl --> tbl_dedup" in p.mermaid() and ":::uptodate" in p.mermaid()


def test_a_changed_output_runs_again(spark, tmp_path):
    (tmp_path / "in.ris").write_text("TY  - JOUR\nTI  - a\nER  - \n")
    run = lambda out: bibliography_pipeline(spark, str(tmp_path / "store"), str(tmp_path / "in.ris"), str(tmp_path / out), files=1).run()
    run("one")
    states = run("two")
    assert states["dat_dedup"] == "ran" and states["tbl_dedup"] == "skipped" and (tmp_path / "two").exists()


def _inner(x):
    return x + 1


def _outer(x):
    return _inner(x)


def test_code_follows_callees():
    assert "return x + 1" in full_code(lambda: _outer(1))
    assert "def first_occurrences" in full_code(lambda t: dedup(t)) and "def fold" in full_code(lambda t: dedup(t))
    a, b = ((lambda v: lambda: v)(v) for v in ("a", "b"))
    assert full_code(a) != full_code(b)


def test_document(spark, tmp_path):
    p = Pipeline(spark, str(tmp_path / "s"), [Stage("good", lambda: spark.range(3))])
    p.run()
    path = p.render(str(tmp_path / "doc.md"), "Report", "What ran.")
    text = open(path).read()
    assert text.startswith("# Report\n\nWhat ran.\n\n```mermaid\ngraph LR") and "| good | done |" in text and p.manifest()["good"]["bytes"] > 0


def test_pipeline_goes_on_after_errors(spark, tmp_path):
    def bad():
        raise ValueError("no")

    p = Pipeline(spark, str(tmp_path / "s"), [Stage("bad", bad), Stage("child", lambda bad: bad, ["bad"]), Stage("good", lambda: spark.range(3))])
    assert p.run() == {"bad": "failed", "child": "blocked", "good": "ran"}
    assert "ValueError" in p.manifest()["bad"]["error"]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("A", 2), ("b", 3)], "k string, s int").withColumn("t", F.timestamp_seconds("s"))
    df.write.parquet(str(tmp_path / "in"))
    q = stream_dedup(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "t").writeStream.format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("out").count() == 2
