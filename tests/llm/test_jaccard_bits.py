"""op8: the exact count looks at every bit of a shingle's hash."""

import numpy as np
import pandas as pd

from tidelog.llm import jaccard, pack


def test_shingles_that_agree_in_the_upper_bits_are_several():
    keys = np.arange(1, 41, dtype=np.uint64) << jaccard.KEPT
    sets = {1: keys, 2: keys + np.uint64(1), 3: np.concatenate([keys[:36], keys[36:] + np.uint64(1)])}
    frame = pd.DataFrame({"id": list(sets), "n": [len(s) for s in sets.values()], "keys": [pack.put_keys(s) for s in sets.values()]})
    assert jaccard._tile(None, frame).values.tolist() == [[1, 3]]
    left = pd.DataFrame({"na": [40], "ka": [frame["keys"][0]]})
    right = pd.DataFrame({"b": [2, 3], "nb": [40, 40], "kb": list(frame["keys"][1:])})
    assert jaccard._settled((1,), left, right).values.tolist() == [[1, 3]]
