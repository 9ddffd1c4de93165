import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm.kernels import Words, sequence_hashes, slices, span_hashes

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZé \t\n\x0b\x0c\r\xa0", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_lower_cased_runs(texts):
    found = []
    for first, stop, raw, offsets in slices(pa.array(texts, pa.string()), limit=16):
        w = Words(raw, offsets)
        assert len(w.count) == stop - first
        for i in range(stop - first):
            found.append([w.data[a:z].tobytes() for a, z in zip(w.start[w.bounds[i]:w.bounds[i + 1]], w.end[w.bounds[i]:w.bounds[i + 1]])])
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
    assert found == [[x.encode() for x in re.findall("[^\x20\x09-\x0D]+", t)] for t in lower]


def test_equal_spans_hash_equally_wherever_they_stand():
    data = np.frombuffer(b"abcd--abcd-abdc", np.uint8)
    h = span_hashes(data, np.array([0, 6, 11]), np.array([4, 10, 15]))
    assert h[0] == h[1] != h[2]
    assert h[0] != span_hashes(data, np.array([0]), np.array([4]), 1)[0]


def test_sequence_hashes_depend_on_order():
    h = np.array([1, 2, 3, 1, 2, 3, 3, 2, 1], np.uint64)
    s = sequence_hashes(h, 3)
    assert len(s) == 7 and s[0] == s[3] != s[6]
    assert len(sequence_hashes(h, 10)) == 0
