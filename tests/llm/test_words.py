import re

import numpy as np
import pyarrow as pa
import pytest

from weekloom.llm import words


@pytest.mark.parametrize("segment", [7, 1 << 20])
@pytest.mark.parametrize("size", [3, 20, 1000])
def test_words_and_hashes(monkeypatch, segment, size):
    monkeypatch.setattr(words, "SEGMENT", segment)
    monkeypatch.setattr(words._Powers, "up", None)
    texts = ["hello  World a", "b", "", None, " x\ty ", "ééa bb", "zz"] * 3 + ["q" * 30 + " " + "w" * 9]
    batch = pa.record_batch({"text": texts})
    got, seen = [], {}
    for _, block in words.blocks(iter([batch]), size=size):
        low = block.mapped(words.LOWER)
        starts, ends, first = low.words(words.IN_WORD)
        hashes = low.hashes(starts, ends)
        for i in range(len(block)):
            found = [low.data[starts[j]:ends[j]].tobytes().decode() for j in range(first[i], first[i + 1])]
            for word, value in zip(found, hashes[first[i]:first[i + 1]]):
                assert seen.setdefault(word, value) == value
            got.append(found)
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").replace("World", "world")) for t in texts]
    assert len(set(seen.values())) == len(seen)


def test_a_null_over_bytes_is_empty():
    raw = pa.array(["abc", "def"])
    hidden = pa.Array.from_buffers(pa.string(), 2, [pa.py_buffer(b"\x02"), *raw.buffers()[1:]])
    (_, block), = words.blocks(iter([pa.record_batch({"text": hidden})]))
    assert [block.piece(i) for i in range(2)] == [b"", b"def"]


def test_runs_of_hashes_keep_order():
    values = np.arange(6, dtype=np.uint64)
    assert len(set(words.joined(values, 3).tolist())) == 4
    assert words.joined(values, 2)[0] != words.joined(values[::-1].copy(), 2)[-1]
    assert len(words.joined(values, 7)) == 0
