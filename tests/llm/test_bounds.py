import re
import time

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memberlens.llm import common, language, packing, pii, tokenfile, tokens
from tests.llm import brute

PLAIN = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")) or kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "a.b+c", "@", ".", "_", "%", "-", " ", "1.2.3.4", "0255", "256", "4539148803436467", "4539 1488", " 0343-6467", "+1 (234) 555-6789", "+", "7", "x", "é", "..", "١"]), max_size=14).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_known_texts():
    text = "x a.b@c.org, 1.2.3.4 1.2.3.256, 4539148803436467, +1 (234) 555-6789"
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.base_spans(text)] == [
        ("email", "a.b@c.org"), ("ip", "1.2.3.4"), ("card", "4539148803436467"), ("phone", "+1 (234) 555-6789")]
    assert pii.base_spans("1.2.3." + "0" * 6000 + "4") == [(0, 1, 6007)]


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000 + "@", ("a" * 50 + "@") * 20_000, "1." * 500_000, "+" + "(" * 1_000_000, "a@" + "b-" * 500_000])
def test_base_spans_take_linear_time(text):
    start = time.perf_counter()
    pii.base_spans(text)
    assert time.perf_counter() - start < 3


def test_letters_are_letters():
    assert [t for t in ("½", "²", "①", "Ⅷ", "1½ 2_", "", "漢", "é1", "ª") if language.has_letter(t)] == ["漢", "é1", "ª"]
    assert all(language.has_letter(t) == any(c.isalpha() for c in t) for t in map(chr, range(0x3000)))


def test_small_batches_keep_rows_and_bounds():
    frame = pd.DataFrame({"t": ["x" * n for n in (5, 5, 1, 30, 2, 2)] + [None, None], "i": range(8)})
    parts = list(common.small_batches([frame, frame.iloc[:0]], "t", 10))
    assert [list(p["i"]) for p in parts] == [[0, 1], [2], [3], [4, 5, 6, 7], []]
    assert all(p["t"].str.len().sum() <= 10 or len(p) == 1 for p in parts)


def test_tokens_do_not_depend_on_the_memory(monkeypatch):
    import public_tokenizers

    texts = ["one two, three. two one", "Wörter, words! words", "a" * 100 + " b", "one <|endoftext|> two"] * 3
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = public_tokenizers.path(name)
        wanted = list(tokens.encoded(texts, path))
        monkeypatch.setattr(tokens, "REMEMBERED", 2)
        monkeypatch.setattr(tokens, "_LOADED", {})
        assert list(tokens.encoded(texts, path)) == wanted and len(tokens.encoder(path).known) <= 2
        monkeypatch.undo()


def test_many_rows_of_one_key_lie_in_several_ranges(spark, fresh_dir):
    import public_tokenizers

    rows = [(None if i % 3 == 0 else 5, f"text {i} " * 20, None, None, None) for i in range(300)]
    path = fresh_dir + "/t"
    tokenfile.write_token_files(brute.frame(spark, rows), path, public_tokenizers.path("byte_bpe_50k.json"), partitions=6)
    sizes = [r["n"] for r in tokenfile.read_token_files(spark, path).groupBy("doc_id").count().withColumnRenamed("count", "n").collect()]
    assert sorted(sizes) == [100, 200] and spark.read.parquet(path).select("part").distinct().count() >= 4


def test_a_bin_is_taken_apart_into_bundles():
    frame = pd.DataFrame({"item": range(6), "length": [700, 700, 700, 90, 90, 90]})
    out = packing.packed_group(2048, 256)(frame).set_index("item")
    assert out["bin"].nunique() == 5 and set(out.loc[[3, 4, 5], "fill"]) == {90, 180} and out.loc[0, "fill"] == 700
    assert packing.packed_group(2048)(frame)["bin"].nunique() == 2
