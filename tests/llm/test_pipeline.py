import corpus_pipeline
from memberlens.llm import pii
from tests.llm import brute


def tables(spark, folder, rows, items):
    brute.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def rows_with_everything():
    word = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango"
    rows = [(i, f"unique{i} " + " ".join(f"term{i * 37 + j}" for j in range(30)), "en", "s", 0) for i in range(40)]
    rows += [(100, word + " one two three four", "en", "s", 0), (101, word + " one two three four", "en", "s", 0), (102, "write to jo.doe@mail.example.com today", None, "s", 0),
             (103, None, "en", "s", 0), (104, "123 456", "en", "s", 0), (105, "clean start " + word + " clean end", "en", "s", 0)]
    return rows, [(1, word)]


def test_stages_one_after_another(spark, fresh_dir):
    rows, items = rows_with_everything()
    tables(spark, fresh_dir, rows, items)
    docs, seen = spark.read.parquet(f"{fresh_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, fresh_dir), "t")
        seen[name] = docs
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen) and all(seen[n].columns == names for n in list(seen)[:-1])
    ids = {n: {r["doc_id"] for r in seen[n].select("doc_id").collect()} for n in seen}
    every = {r[0] for r in rows}
    assert every - ids["language"] == {103, 104}
    want = brute.near_duplicates([r for r in rows if r[0] in ids["language"]])
    assert ids["near_duplicates"] == {k for k, (_, c) in want.items() if k == c} and 101 not in ids["near_duplicates"] and 100 in ids["near_duplicates"]
    assert ids["decontamination"] == ids["personal_data"] == ids["near_duplicates"] == ids["packing"]
    text = {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen["personal_data"].collect()}
    assert text[105][0].split() == ["clean", "start", "clean", "end"] and text[105][1] == len(text[105][0])
    assert text[102][0] == "write to <EMAIL> today" and text[3] == (rows[3][1], 0)
    assert not any(pii.base_spans(t) for t, _ in text.values())
    assert seen["language"].where("doc_id = 102").first()["lang"] == "en"
    run = corpus_pipeline.run(spark, fresh_dir)
    assert sorted(map(tuple, run.select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "length", "ids_crc32").collect()))


def test_empty_and_awkward_tables(spark, fresh_dir):
    tables(spark, fresh_dir + "/e", [], [])
    assert corpus_pipeline.run(spark, fresh_dir + "/e").count() == 0
    tables(spark, fresh_dir + "/a", brute.awkward(), [(1, None)])
    assert corpus_pipeline.run(spark, fresh_dir + "/a").count() > 0


def test_texts_are_changed_in_the_step_that_finds_the_spans(spark, fresh_dir):
    rows, items = rows_with_everything()
    tables(spark, fresh_dir, rows, items)
    docs = spark.read.parquet(f"{fresh_dir}/documents.parquet")
    for stage in (corpus_pipeline.without_benchmark, corpus_pipeline.without_personal_data):
        plan = stage(spark, docs, fresh_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInPandas") == 1
