from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from notewright.llm import textvec


@pytest.mark.parametrize("piece", [3, 17, 1 << 19])
def test_words(piece, monkeypatch):
    monkeypatch.setattr(textvec, "PIECE", piece)
    r = random.Random(piece)
    texts = [None, "", " ", "a", "aé"] + ["".join(r.choice("ab é\n漢") for _ in range(r.randint(0, 40))) for _ in range(80)]
    buf, off = textvec.utf8(pa.array(texts))
    w = textvec.words(buf, off)
    known = {}
    for i, t in enumerate(texts):
        want = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        own = range(w.off[i], w.off[i + 1])
        assert [buf[w.start[k] : w.end[k]].tobytes() for k in own] == want
        for k, x in zip(own, want, strict=True):
            assert known.setdefault(x, w.hash[k]) == w.hash[k]
    assert len(set(known.values())) == len(known)


def test_windows_and_slices():
    h = np.arange(20, dtype=np.uint64)
    assert textvec.windows(h, 5)[3] == textvec.windows(h[3:8], 5)[0] and len(textvec.windows(h[:2], 5)) == 0
    assert textvec.inside(np.array([0, 3, 3, 10]), 3).tolist() == [0, 3, 4, 5, 6, 7]
    batch = pa.record_batch([pa.array(["a" * 10, None, "b" * 100, "c"])], ["text"])
    assert [b.num_rows for b in textvec.slices(iter([batch]), "text", 50)] == [2, 1, 1]
