import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from memberlens.llm import packing, tokenfile
from memberlens.llm.tokens import encoder
from tests.llm import brute

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PLAIN = {path: Tokenizer.from_file(path) for path in (WORD, BYTE)}


def ids(text, path):
    return PLAIN[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path,end", [(WORD, 49407), (BYTE, 50256)])
def test_strings_of_special_tokens_have_their_ids(path, end):
    import numpy as np

    for text in ("a <|endoftext|> b", "<|endoftext|>", "word<|endoftext|>word.<|startoftext|>", "a<|endoftext|>  \n b", "<|ENDOFTEXT|> x"):
        assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == ids(text, path)
    assert end in np.frombuffer(encoder(path).encode("a <|endoftext|> b"), "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|", "|>", " ", "  ", "\n", "a", "B.", "'s", "é", "　", "endoftext"]), max_size=12).map("".join))
def test_texts_around_special_tokens_equal_the_library(text):
    import numpy as np

    for path in (WORD, BYTE):
        assert np.frombuffer(encoder(path).encode(text), "<u4").tolist() == ids(text, path)


def test_documents_with_special_tokens(spark, fresh_dir):
    rows = [(1, "a <|endoftext|> b", None, None, None), (2, "plain", None, None, None)]
    got = sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in packing.packed_digest(brute.frame(spark, rows), WORD).collect())
    want = [[*ids(t, WORD), 0] for _, t, *_ in rows]
    assert got == [(k + 1, len(w), brute.crc(w)) for k, w in enumerate(want)]
    tokenfile.write_token_files(brute.frame(spark, rows), fresh_dir + "/s", BYTE, partitions=1)
    assert [(r["start"], bytes(r["ids"])) for r in tokenfile.read_token_files(spark, fresh_dir + "/s").orderBy("start").collect()] == [
        (0, b"".join(int(x).to_bytes(4, "little") for x in [*ids(rows[0][1], BYTE), 0])), (5, b"".join(int(x).to_bytes(4, "little") for x in [*ids("plain", BYTE), 0]))]


def test_offsets_of_merged_bins_do_not_overlap(spark):
    """The bin that keeps its name when bins merge may be the shorter one, which then stands behind."""
    lengths = [300 + 37 * i % 900 for i in range(200)]
    frame = spark.createDataFrame(list(enumerate(lengths)), "item long, length long")
    bins = {}
    for r in packing.pack(frame, group_items=10).join(frame, "item").collect():
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["offset"] + r["length"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a[1] == b[0] for a, b in zip(parts, parts[1:])) and parts[-1][1] <= 2048
