"""The pipeline's stages on a small corpus with planted cases."""

import random

import corpus_pipeline as P


def test_stages(spark, tmp_path):
    r = random.Random(9)
    words = ["".join(r.choice("thonereasting") for _ in range(r.randrange(3, 8))) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, text(60), "en", f"s{i % 3}", 0) for i in range(300)]
    toxic = {i for i in range(300) if i % 10 == 0}
    rows = [(i, t + " blorkface " + text(5) if i in toxic else t, *x) for i, t, *x in rows]
    copy = (400, rows[1][1], "en", "s1", 0)
    near = (401, rows[2][1] + " extra", "en", "s2", 0)
    private = (402, text(40) + " me@mail.example.com " + text(10), "en", "s0", 0)
    rows += [copy, near, private, (403, None, None, None, None), (404, "", "en", "s0", 0), (None, rows[3][1], "en", "s0", 0), (None, "a text without an id " * 9, "en", "s0", 0), (None, "a text without an id " * 9, "en", "s0", 0), (405, "one " * 20, "en", "s0", 0), (405, "two " * 20, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        seen.append({x.doc_id: x for x in docs.collect()})
        if name == "ngram_jaccard":
            assert docs.count() == len(seen[-1])  # one row without an id is left, and one of id 405
        if k < len(P.STAGES) - 1:
            assert docs.columns == P.COLUMNS, name
    clean = {x[0] for x in rows} - toxic
    assert set(seen[0]) == clean
    assert set(seen[1]) == clean - {400, 401} and seen[1][None].text.startswith("a text without")
    assert set(seen[2]) == set(seen[1]) and "me@mail" not in seen[2][402].text and seen[2][5].text == seen[1][5].text
    assert set(seen[3]) <= set(seen[2]) and len(seen[3]) > 150
    assert set(seen[4]) == set(seen[3]) and all(x.n_tokens == len(x.tokens) for x in seen[4].values())
    assert P.run(spark, str(tmp_path)).count() == spark.read.parquet(str(tmp_path / "out4")).count()


def test_empty(spark, tmp_path):
    """No documents, no labels, and a further column with a name of an operator's own."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, node long, pii string"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
