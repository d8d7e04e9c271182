"""op7: anchors of texts longer than the places that a number holds."""

from types import SimpleNamespace

import numpy as np
import pytest

from tidelog.llm import common, repeats


@pytest.mark.parametrize("bits", [8, 24])
def test_ties_across_the_turn_of_places_go_left(monkeypatch, bits):
    monkeypatch.setattr(repeats, "_PLACE", np.uint64((1 << bits) - 1))
    data = np.frombuffer((b"ab" * 700 + bytes(range(97, 123)) * 40 + b"x" * 900), np.uint8)
    monkeypatch.setattr(repeats.pack, "get_ids", lambda x: x)
    monkeypatch.setattr(repeats.pack, "unpacked", lambda texts, lengths: (data, np.array([0, len(data)])))
    import pyarrow as pa

    got = repeats.Anchors(SimpleNamespace(ids=pa.array([7]), texts=None, lengths=None), 50, 20)
    prefix = common.prefix_hash(data)
    at = np.arange(len(data) - 19)
    hashes = common.range_hash(prefix, at, at + 20) & ~np.uint64((1 << bits) - 1)
    want = sorted({s + int(np.argmin(hashes[s : s + 31])) for s in range(len(data) - 49)})
    assert got.place.tolist() == want
