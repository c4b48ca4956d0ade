import numpy as np
from pyspark.sql import functions as F

from memberlens.llm import repeats
from tests.llm import brute


def test_different_texts_of_one_key_are_spread(spark):
    """One key with many different texts: no list of them at any row, results as for distinct keys in the order of hashes."""
    rng = np.random.default_rng(9)
    letters = lambda n: "".join(chr(97 + x) for x in rng.integers(0, 26, n))
    passage = letters(160)
    texts = [letters(120) + passage + letters(60) for _ in range(40)] + [passage + letters(50)] * 2
    rows = [(None if i % 2 else 5, t, None, None, None) for i, t in enumerate(texts)] + [(7, passage, None, None, None)]
    df = brute.frame(spark, rows)
    met = repeats.keyed(df, "doc_id", "text", ())
    assert not any("array" in f.dataType.simpleString() for f in met.schema) and "collect_" not in met._jdf.queryExecution().toString()
    assert met.where("key = 7 and variant = 0").count() == 1 and met.select("key", "variant").distinct().count() == 43
    order = df.select("doc_id", "text", F.xxhash64("text").alias("h")).distinct().orderBy(F.col("doc_id").isNull(), "doc_id", "h").collect()
    plain = brute.repeats([(i, r["text"], None, None, None) for i, r in enumerate(order)])
    want = {(r["doc_id"], r["text"]): plain[i] for i, r in enumerate(order)}
    found = repeats.repeated_spans(df).collect()
    assert len(found) == len(rows)
    for r in found:
        n, removed, spans, _ = want[r["doc_id"], r["body"]]
        assert (len(r["body"]), sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"])) == (n, removed, spans)
