"""The stored tables of contexts against the tree on one machine."""

import numpy as np
import pytest

from tidemark.llm import suffix_tree as st


def test_ranges_equal_the_tree(monkeypatch):
    """Subtrees learned range by range, with a last symbol cut in parts, against the whole tree."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        seq = rng.integers(3, 9, rng.integers(0, 40))
        seq[1::2] = (seq[: len(seq) // 2 * 2 : 2] + 1 - 3) % 6 + 3
        rows.append((i % 5 > 0, seq))
    flat = lambda some: np.concatenate([[st.START, *seq, st.END] for _, seq in some]).astype(np.int64)
    sym, levels, counts = flat(r for r in rows if r[0]), [], []
    for d in range(4):
        ctx = st.numbers(sym, levels)[-1]
        ok = (ctx >= 0) & (sym != st.START)
        code, n = np.unique(ctx[ok] << st.BITS | sym[ok], return_counts=True)
        counts.append((code, n))
        grow = code[code & (1 << st.BITS) - 1 != st.END]
        if d < 3:
            levels.append(st.Level(np.append(grow, st.START) if d == 0 else grow))
    tree = st.SuffixTree(9, counts, levels, least=10)
    assert len(tree.parent) > 10
    monkeypatch.setattr(st, "RANGE", (400, 100))
    letters = st.Alphabet(np.arange(6, dtype=np.uint64), np.bincount(sym, minlength=9)[3:9], {}, (0, 0), sum(t for t, _ in rows))
    bounds, split = letters.cuts(len(rows))
    assert len(split) > 2 and len(bounds) > 8
    lengths = np.array([len(s) for _, s in rows])
    codes = st.coded(np.concatenate([s for _, s in rows]).astype(np.uint16), lengths)
    distinct, of = np.unique(codes, return_inverse=True)
    n = np.bincount(of, np.repeat([t for t, _ in rows], lengths + 1), len(distinct))
    target = np.searchsorted(bounds, distinct >> np.uint64(32), "right") - 1
    lp = np.zeros(len(distinct))
    for r in np.unique(target):
        mine, symbol, shared = target == r, bounds[r] >> np.uint64(16), None
        if symbol in split:
            of_symbol = distinct >> np.uint64(48) == symbol
            times = np.bincount((distinct[of_symbol] & np.uint64(0xFFFF)).astype(int), n[of_symbol])
            shared = (symbol, np.flatnonzero(times).astype(np.uint64), times[times > 0])
        lp[mine] = st.evaluated(distinct[mine], n[mine], letters.root, 3, 10, shared)
    got = np.bincount(np.repeat(np.arange(len(rows)), lengths + 1), lp[of])
    for r, x in zip(rows, got):
        assert x == pytest.approx(tree.log(flat([r])).sum())


def test_packed_arrays():
    for kind in (np.uint64, np.uint32, np.uint16, np.float32, np.int64, np.float64, np.uint8):
        for n in (0, 1, 1000):
            x = np.random.default_rng(3).integers(0, 200, n).astype(kind)
            assert (st.unpack(st.pack(x)) == x).all() and st.unpack(st.pack(x)).dtype == x.dtype


def test_blocks_and_cuts_change_nothing(spark, monkeypatch):
    """Small blocks and ranges give the scores of large ones."""
    rng = np.random.default_rng(5)
    rows = [(i if i % 7 else None, " ".join(f"w{k}" for k in rng.zipf(1.5, rng.integers(0, 60)) % 300) if i % 11 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda: sorted([tuple(r) for r in st.score(df).collect()], key=repr)
    whole = get()
    assert len(whole) == 400
    for name, value in (("BLOCK", 700), ("RANGE", (300, 50)), ("OWNERS", 4), ("OWNER_BYTES", 3000)):
        monkeypatch.setattr(st, name, value)
    assert st.owners_for(sum(len(t or "") for _, t in rows)) > 4
    for a, b in zip(whole, get()):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-5)


def test_owners_grow_with_the_text():
    assert [st.owners_for(n) for n in (0, 1, st.OWNERS * st.OWNER_BYTES, st.OWNERS * st.OWNER_BYTES + 1, 10**14)] == [1024, 1024, 1024, 2048, 1 << 18]


def test_counts_beyond_32_bits(spark):
    """A word that blocks count three thousand million times each."""
    ask = lambda block, n: (block, 0, [st.pack(np.array([5, 9], np.uint64)), st.pack(np.array([n, 1], np.uint32)), st.pack(np.array([1, 2], np.uint16))])
    asked = spark.createDataFrame([ask(0, 3_000_000_000), ask(1, 3_000_000_000)], "block long, target int, data array<binary>")
    rows = st.own_words(asked, 100.0).collect()
    assert [st.unpack(r["data"][0]).tolist() for r in rows if r["kind"] == "answer"] == [[6_000_000_000, 2]] * 2
    assert [(r["k"], r["n"]) for r in rows if r["kind"] == "frequent"] == [(5, 6_000_000_000)]


def test_contexts_grow_with_the_corpus(spark):
    """A context that comes 30 times tells as much after a thousand times as many other tokens as alone."""
    rng = np.random.default_rng(2)
    told = [(i, " ".join(["alpha beta"] * 1)) for i in range(40)]
    noise = [(1000 + i, " ".join(f"w{k}" for k in rng.integers(0, 30, 500))) for i in range(400)]
    got = st.score(spark.createDataFrame(told + noise, "doc_id long, text string")).filter("doc_id < 1000").collect()
    assert all(r["score"] > r["base_score"] + 3 for r in got)
