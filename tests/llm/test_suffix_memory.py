"""Strings of a bucket are laid out in slices: the memory for it does not grow with the bucket's bytes times eight."""

import tracemalloc

import numpy as np

from gridpace.llm.suffixes import aligned, anchored, covered, flags_in


def test_layout_is_bounded_and_right():
    rng = np.random.default_rng(5)
    length = rng.integers(1, 150, 60_000)
    body = rng.integers(0, 256, int(length.sum()), dtype=np.uint8)
    begin, column = np.cumsum(length) - length, rng.integers(0, 20, length.size)
    tracemalloc.start()
    rows = aligned(body, begin, length, column, 178)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < rows.nbytes + (32 << 20)
    for i in (0, 1, 4095, 4096, 59_999):
        want = np.zeros(178, np.uint8)
        want[column[i]: column[i] + length[i]] = body[begin[i]: begin[i] + length[i]]
        assert (rows[i] == want).all()


def peak(run):
    tracemalloc.start()
    out = run()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_a_chunk_takes_few_bytes_for_each_of_its_own():
    rng = np.random.default_rng(6)
    size = 6 << 20
    data = rng.integers(0, 256, size, dtype=np.uint8)
    off = np.unique(np.append(rng.integers(0, size, 2_000), (0, size)))
    pos, length = rng.integers(0, size - 300, 500), rng.integers(100, 300, 500)
    gone, most = peak(lambda: covered(size, pos, length))
    assert most < 6 * size
    want = np.zeros(size, bool)
    for a, n in zip(pos, length):
        want[a: a + n] = True
    assert (gone == want).all()
    n, most = peak(lambda: flags_in(gone, off))
    assert most < 1 << 20 and n.tolist() == [int(want[a:b].sum()) for a, b in zip(off[:-1], off[1:])]
    _, most = peak(lambda: anchored(data, off, 100))
    assert most < 7 * size
