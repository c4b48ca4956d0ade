from memberlens.llm import language, pii
from tests.llm import brute


def letters(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def rows_of_one_key(n=900):
    """All keys null or one and the same, and many copies of one text."""
    rows = [(None if i % 2 else 1, f"text {letters(i)} of its own", "xx", "s", 0) for i in range(n)]
    return rows + [(1, "the same text again", "xx", "s", 0)] * n + [(i, f"other {letters(i)}", "yy", "s", 0) for i in range(10)]


def test_language_sample_is_bounded_whatever_the_keys(spark):
    rows = language.training_sample(brute.frame(spark, rows_of_one_key()), "doc_id", "text", "lang", per_language=50).collect()
    texts = {(r["label"], r["k"]) for r in rows}
    assert len(rows) == len(texts) * language.PER_TEXT
    xx = [k for label, k in texts if label == "xx"]
    assert 25 <= len(xx) <= 50 and 1 <= sum(label == "yy" for label, _ in texts) <= 10


def test_personal_data_sample_is_bounded_whatever_the_keys(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "train", lambda windows, gold: seen.append(len(windows)))
    rows = [(k, f"write to {letters(i)}@mail.example.com", *rest) for i, (k, t, *rest) in enumerate(rows_of_one_key()[:900])]
    pii.fit(brute.frame(spark, rows), sample=100)
    # a window of the span and one of the text each
    assert seen and 20 * 2 <= seen[0] <= 50 * 2
