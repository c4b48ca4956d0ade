import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memberlens.llm import packing, tokenfile, tokens
from memberlens.llm.tokens import WordEncoder, encoder
from tests.llm import brute

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB'éÉßİıſ \n\t.,!#|19 ́\x1c　’漢\U0001f600"), st.characters(codec="utf-8"))))
def test_memory_gives_the_library_ids(text):
    for path in (WORD, BYTE):
        assert encoder(path).encode(text) == encoder(path).plain(text)


def test_known_awkward_texts():
    for text in ["a  b\n\n c \n", "it's o'Clock don't 'll", "<|endoftext|> x<|endoftext|>y", "wordſ word'S", "...'s", "x=1&y=2"]:
        for path in (WORD, BYTE):
            assert encoder(path).encode(text) == encoder(path).plain(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300))
def test_coding_round_trip(ids):
    ids = np.array(ids, np.uint32)
    ranked, control, data = tokenfile.encode_ids(ids)
    assert (tokenfile.decode_ids(ranked, control, data, len(ids)) == ids).all() and len(control) == -(-len(ids) // 4)


def test_many_ranks_take_more_bytes():
    ids = np.concatenate([np.arange(70_000), np.full(1000, 5)]).astype(np.uint32)
    ranked, control, data = tokenfile.encode_ids(ids)
    assert (tokenfile.decode_ids(ranked, control, data, len(ids)) == ids).all()
    assert np.frombuffer(ranked, "<u4")[0] == 5 and len(data) == 1001 + 255 + (65536 - 256) * 2 + (70_000 - 65536) * 3


@pytest.mark.parametrize("block,partitions", [(1 << 20, 1), (50, 3)])
def test_files_round_trip(spark, fresh_dir, block, partitions):
    docs = brute.clashing(brute.frame(spark))
    tokenfile.write_token_files(docs, fresh_dir + "/t", BYTE, block_tokens=block, partitions=partitions)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in tokenfile.read_token_files(spark, fresh_dir + "/t").collect())
    start, want = 0, []
    for k, t, *_ in sorted(brute.awkward(), key=lambda r: r[0]):
        ids = brute.token_ids(t, BYTE)
        want.append((start, k, len(ids), brute.crc(ids), np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want


def test_files_of_null_keys_and_empty_tables(spark, fresh_dir):
    rows = [(None, "b", None, None, None), (3, "a", None, None, None)]
    tokenfile.write_token_files(brute.frame(spark, rows), fresh_dir + "/n", BYTE, partitions=1)
    assert [r["doc_id"] for r in tokenfile.read_token_files(spark, fresh_dir + "/n").orderBy("start").collect()] == [None, 3]
    tokenfile.write_token_files(brute.frame(spark, []), fresh_dir + "/e", BYTE)
    assert tokenfile.read_token_files(spark, fresh_dir + "/e").count() == 0


def check_places(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(spark):
    rows = packing.packed_digest(brute.clashing(brute.frame(spark)), WORD).collect()
    want = []
    for k, t, *_ in brute.awkward():
        ids = brute.token_ids(t, WORD)
        want += [(k, i // 2048, i, len(ids[i:i + 2048]), brute.crc(ids[i:i + 2048])) for i in range(0, len(ids), 2048)]
    assert sorted(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows) == sorted(want)
    assert check_places(rows, 2048) == -(-sum(w[3] for w in want) // 2048)


@pytest.mark.parametrize("lengths,group,most", [
    ([1100] * 300, 40, 300), ([1500, 500, 40, 8] * 100, 25, 106), ([7] * 3000, 100, 12), ([2047, 1] * 50, 10, 52), ([2048] * 5, 10, 5), ([], 10, 0)])
def test_rounds_over_groups(spark, lengths, group, most):
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "item long, length long")
    rows = packing.pack(frame, group_items=group).join(frame, "item").collect()
    assert len(rows) == len(lengths) and check_places(rows, 2048) <= most


def test_best_fit_prefers_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([60, 50, 40, 48]), 100)
    assert bins.tolist() == [0, 1, 0, 1] and offsets.tolist() == [0, 0, 60, 50]


def test_empty_table(spark):
    assert packing.packed_digest(brute.frame(spark, []), WORD).count() == 0


def test_ids_of_a_vocabulary_are_ranked_without_a_sort(monkeypatch):
    for ids in ([], [0], [7, 7, 3, 50_000, 3, 7], [2**32 - 1, 5, 5]):
        ids = np.array(ids, np.uint32)
        values, counts = np.unique(ids, return_counts=True)
        ranked = tokenfile.encode_ids(ids)[0]
        assert np.frombuffer(ranked, "<u4").tolist() == values[np.lexsort((values, -counts))].tolist()
    monkeypatch.setattr(np, "unique", None)
    ids = np.array([7, 7, 3, 50_000], np.uint32)
    assert (tokenfile.decode_ids(*tokenfile.encode_ids(ids), 4) == ids).all()


def test_ids_of_a_new_word_need_no_numpy_array(monkeypatch):
    for path in (WORD, BYTE):
        enc, wanted = WordEncoder(path), encoder(path).plain("Zyxlthon, été zyxlthonea")
        with monkeypatch.context() as m:
            m.setattr(tokens.np, "array", None)
            assert enc.encode("Zyxlthon, été zyxlthonea") == wanted
