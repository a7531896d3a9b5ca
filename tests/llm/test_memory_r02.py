"""What a task holds: of a very long line, of a range of the tree."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tidemark.llm import line_dedup as ld
from tidemark.llm import suffix_tree as st


def test_a_long_line_is_emitted_in_parts():
    words = [b"w%d" % (i % 977) for i in range(250_000)]
    tracemalloc.start()
    try:
        n = sum(1 for _ in ld.neighbourhood(words, 8))
        assert tracemalloc.get_traced_memory()[1] < 20 * len(words)  # it was 132 bytes a word
    finally:
        tracemalloc.stop()
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6], pa.int64()), pa.array([b" ".join(words), b"a b"], pa.binary())], ["id", "line"])
    sizes = [b.num_rows for b in ld.emitted(iter([batch]), 8)]
    assert n == 500_001 and sum(sizes) == n + 1 and max(sizes) <= 200_000  # they were one batch


def test_a_range_of_the_tree_holds_under_a_hundred_bytes_a_code():
    rng = np.random.default_rng(1)
    data, lengths = [], rng.integers(5, 400, 500)
    for _ in range(3):
        seq = np.minimum(rng.zipf(1.25, lengths.sum()) + 2, 19_999).astype(np.uint16)
        codes, n = np.unique(st.coded(seq, lengths), return_counts=True)
        data.append([st.pack(codes), st.pack(n.astype(np.uint32))])
    tracemalloc.start()
    try:
        answers = st.answered(data, np.full(20_000, 1 / 20_000), 3, 2)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sizes = [len(st.unpack(a)) for a in answers]
    assert sizes == [len(st.unpack(c)) for c, _ in data] and peak < 100 * sum(sizes)  # it was 148 bytes a code
