import duckdb
import pandas as pd
import pytest

from memberlens.llm import decontamination
from memberlens.llm.queries import ORACLES
from tests.llm import brute

ITEMS = [(None, "quick brown FOX jumps over the lazy dog while seventeen purple elephants dance"), (None, "emoji"), (2, "three"), (10, "One two")]


@pytest.mark.parametrize("block", [2_000_000, 6])
def test_items_without_a_key_hit_words_as_in_sql(spark, block):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [r for i, r in enumerate(brute.awkward()) if r[0] not in (7, 8, 9)]
    found = decontamination.digest(decontamination.contamination(brute.frame(spark, rows), items, block_words=block))
    documents = pd.DataFrame([r[:2] for r in rows], columns=["doc_id", "text"])  # noqa: F841
    benchmark = pd.DataFrame({"item_id": pd.array([k for k, _ in ITEMS], "Int64"), "text": [t for _, t in ITEMS]})  # noqa: F841
    want = duckdb.sql(ORACLES["op8_decontamination"]).fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want) and any(w[3] == 1 and w[2] > 12 for w in want)


def test_one_block_at_a_time(spark, monkeypatch):
    """Items are read from the driver's iterator only as far as the block in work and the one that follows."""
    taken, made, plain, search = [], [], decontamination.item_blocks, decontamination.block_findings

    def blocks(*args):
        for b in plain(*args):
            taken.append(len(b))
            yield b

    def findings(*args):
        made.append(len(taken))
        return search(*args)

    monkeypatch.setattr(decontamination, "item_blocks", blocks)
    monkeypatch.setattr(decontamination, "block_findings", findings)
    items = spark.createDataFrame([(i, f"word{i} filler{i} word{i + 1} filler{i + 1}") for i in range(5)], "item_id long, text string")
    found = decontamination.contamination(brute.frame(spark), items, block_words=4)
    assert made == [2, 3, 4, 5, 5]
    got = {r["doc_id"]: list(r["items"]) for r in found.collect()}
    assert got[7] == got[8] == ["0", "1", "2", "3", "4"] and got[1] == []
