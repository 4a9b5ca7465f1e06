import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, labels = [], []
    for i in range(160):
        w = [word() for _ in range(40)]
        toxic = i % 5 == 1
        for _ in range(3 * toxic):
            w.insert(rng.randrange(40), rng.choice(["zzbad", "qqugly"]))
        rows.append((i, "Shared menu line\n" + " ".join(w), "en", f"s{i % 3}", 0, None))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 5 != 1]
    rows += [(1000 + k, r[1], r[2], r[3], 0, None) for k, r in enumerate(clean[:10])]  # copies
    rows += [(2000, None, "en", "s0", 0, None), (2001, "", None, None, 0, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, sig string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = seen[name] = spark.read.parquet(path)
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in seen.items()}
    toxic = {i for i, _, t in labels if t}
    assert len(ids["toxicity"] & toxic) <= 2 and {r[0] for r in clean} <= ids["toxicity"]
    assert ids["line_dedup"] == ids["toxicity"]
    assert not seen["line_dedup"].where("text LIKE 'Shared menu line%'").count()
    assert ids["near_duplicates"] == {i for i in ids["toxicity"] if not 1000 <= i < 2000}
    assert ids["mixing"] <= ids["near_duplicates"] and ids["packing"] == ids["mixing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["packing"].count()


def test_near_copies_leave_one_row_each(spark):
    rng = random.Random(2)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(5))
    rows = [(1, a), (5, a), (5, b)]  # 5 holds a copy and a text of its own
    rows += [(6, c), (6, c + " more"), (6, c)]  # near copies under one id
    rows += [(None, d), (None, d), (None, d + " more"), (None, b)]  # copies without an id
    rows += [(8, e), (8, e), (None, ""), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS id", "3 AS text_key", "4 AS k_id")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    near = lambda t, of: t is not None and t.startswith(of)
    assert len(got) == 7 and all(sum(near(t, x) for _, t in got) == 1 for x in (a, b, c, d, e))
    assert {(1, a), (5, b), (8, e), (None, ""), (None, None)} < set(got)
    assert {i for i, t in got if near(t, c)} == {6} and {i for i, t in got if near(t, d)} == {None}


def test_stages_over_an_empty_table_and_clashing_columns(spark, tmp_path):
    names = "row found score spans lines_removed b_lines mix_size target size copy text_key".split()
    extra = ", ".join(f"{n} int" for n in names)
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    for rows in ([], [(i, f"first line\nwords {i} " + "abc " * (i or 0), "en", None, 3, *range(len(names))) for i in (1, 2, None)]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            assert {tuple(r[n] for n in names) for r in out.collect()} == ({tuple(range(len(names)))} if rows else set()), name
        assert (corpus_pipeline.pack(spark, docs, str(tmp_path)).count() > 0) == bool(rows)
