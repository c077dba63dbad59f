from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from papyra.llm import ngram_lm

TEXTS = [" ".join(f"w{(i * i + 7 * i * k) % 97}" for i in range(k % 13 + 3)) for k in range(400)]


class Small:
    """A level whose nodes are the words themselves, numbered in some order."""

    order = 1

    def __init__(self, nodes: int):
        self.words, self.bases = 1000, {1: np.array([0, nodes])}

    def contexts(self, words, edge):
        row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        ok = np.flatnonzero(row[1:] == row[:-1])
        number = (words % np.uint64(997)).astype(np.int64)
        return number[ok].astype(np.uint64), number[ok + 1].astype(np.uint64)


def pairs(levels, batches) -> tuple[Counter, int]:
    found, size = Counter(), 0
    for block in ngram_lm.counter(levels, 5)(iter(batches)):
        size += sum(len(x.as_py()) for c in ("first", "second", "counts") for x in block[c])
        for i in range(len(block)):
            first, second, n = ngram_lm.joined(pa.Table.from_batches([block.slice(i, 1)]))
            where = ngram_lm.place(first, second, 5)
            assert set(where) == {block["shard"][i].as_py()}
            for key in zip(first.tolist(), second.tolist() if second is not None else [None] * len(first), n.tolist(), strict=True):
                found[key[:2]] += key[2]
    return found, size


@pytest.mark.parametrize("nodes", [1000, 1 << 60])
@pytest.mark.parametrize("waiting", [50, 1 << 20])
def test_counts_are_the_same_whether_keys_fit_into_one_number_and_take_few_bytes(nodes, waiting, monkeypatch):
    monkeypatch.setattr(ngram_lm, "WAITING", waiting)
    batches = [pa.record_batch({"text": pa.array(TEXTS[i : i + 40])}) for i in range(0, 400, 40)]
    levels, want = Small(nodes), Counter()
    for batch in batches:
        words, edge = ngram_lm.tokens(*ngram_lm.utf8(batch.column(0)))
        want.update(zip(*(x.tolist() for x in levels.contexts(words, edge)), strict=True))
    got, size = pairs(levels, batches)
    assert got == want
    if waiting > 50:  # 24 bytes each before
        assert size < 10 * len(want)


def test_words_are_counted_as_they_are():
    batches = [pa.record_batch({"text": pa.array(TEXTS + [None, ""])})]
    got, _ = pairs(None, batches)
    words, _ = ngram_lm.tokens(*ngram_lm.utf8(batches[0].column(0)))
    assert got == Counter((w, None) for w in words.tolist())
    assert list(ngram_lm.counter(None, 5)(iter([]))) == []
