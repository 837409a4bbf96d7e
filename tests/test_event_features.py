from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.operators.event_features import BitSlices, Bitmap, Counters, event_features, feature_rows

TX = (
    "delivery_id long, txid string, time long, provenance struct<source: string>, inputs array<struct<address: string, value_sats: long>>, "
    "outputs array<struct<address: string, value_sats: long>>, entity string, kind int"
)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 2**40)), max_size=60))
def test_carry_addition(pairs):
    s, want = BitSlices(), defaultdict(int)
    for p, v in pairs:
        s.add(np.array([p]), np.array([v]))
        want[p] += v
    at = np.array(sorted(want), np.int64)
    assert s.decode(at).tolist() == [want[p] for p in at]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(0, 3 << 16), st.integers(0, 2**50)), max_size=80), max_size=4))
def test_repeated_positions_add_up(chunks):
    s, ones, want, times = BitSlices(), BitSlices(), defaultdict(int), defaultdict(int)
    for pairs in chunks:
        pairs.sort()
        at, numbers = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        s.add(at, numbers)
        ones.add(at)
        for p, v in pairs:
            want[p] += v
            times[p] += 1
    at = np.array(sorted(want), np.int64)
    assert s.decode(at).tolist() == [want[p] for p in at] and ones.decode(at).tolist() == [times[p] for p in at]


def test_containers_stay_compressed():
    rng = np.random.default_rng(0)
    b, have = Bitmap(), set()
    for size in (10, 3000, 60_000, 40_000, 3, 65_000):
        new = np.unique(rng.integers(1 << 17, 3 << 16, size))
        common = b.flip(new)
        assert common.tolist() == sorted(have & set(new.tolist()))
        have ^= set(new.tolist())
        assert b.positions().tolist() == sorted(have)
        for c in b.containers.values():
            n = c.size if c.dtype == np.uint16 else int(np.bitwise_count(c).sum())
            assert (c.dtype == np.uint16) == (n <= 4096) and c.nbytes <= 8192
    b.flip(b.positions())
    assert not b.containers


def test_counters_count_a_hot_position():
    n = 100_000
    c = Counters()
    zero = np.zeros(n, np.int64)
    c.add(zero, zero, None, np.arange(n), zero + 7, zero)
    assert [x.tolist() for x in c.decode()] == [[0], [0], [n], [n - 1], [7 * n], [0]]
    assert sum(len(p.containers) for p in c.n.planes) == n.bit_count()


def brute(rows):
    first = {}
    for r in sorted(rows, key=lambda r: r[0]):
        key = (r[1] or "").strip().lower()
        first.setdefault(key or ("none", r[0]), r)
    out = defaultdict(lambda: [0, None, 0])
    for _, _, time, prov, ins, outs, *_ in first.values():
        for side, items in (("in", ins), ("out", outs)):
            for e in items or []:
                if e and e[0]:
                    k = f"{side}|{(prov and prov[0]) or '-'}|{'-' if e[1] is None else len(str(abs(e[1])))}"
                    f = out[e[0], k]
                    f[0] += 1
                    f[1] = max((x for x in (f[1], time or None) if x), default=None)
                    f[2] += e[1] or 0
    return {k: tuple(v) for k, v in out.items()}


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        item = lambda: None if rng.random() < 0.05 else (None if rng.random() < 0.1 else "hot" if rng.random() < 0.4 else f"a{rng.integers(30)}", None if rng.random() < 0.1 else int(rng.integers(-50, 10**6)))
        side = lambda: None if rng.random() < 0.1 else [item() for _ in range(rng.integers(4))]
        rows.append((i, [None, "", f"T{rng.integers(300)}", f" t{rng.integers(300)}"][rng.integers(4)], [None, 0, int(rng.integers(1, 99))][rng.integers(3)], None if rng.random() < 0.2 else (f"s{rng.integers(2)}",), side(), side(), "x", 1))
    got = {(r.address, r.event_type): (r.n, r.latest, r.total_sats) for r in feature_rows(event_features(spark.createDataFrame(rows, TX))).collect()}
    assert got == brute(rows)


def test_a_block_for_so_many_rows(spark, monkeypatch):
    """The number of tasks follows the rows, and adaptive execution does not join them again."""
    from tallyweave.operators import event_features as ef

    monkeypatch.setattr(ef, "BLOCK_ROWS", 40)
    rows = [(i, f"t{i}", i + 1, ("s",), [(f"a{i}", i)], None, "x", 1) for i in range(300)]
    got = event_features(spark.createDataFrame(rows, TX))
    assert got.count() == 300 and got.rdd.getNumPartitions() == 4 * 300 // 40 + 1


def test_empty(spark):
    assert event_features(spark.createDataFrame([], TX)).count() == 0


def test_chunks_of_a_block_add_up(monkeypatch):
    import pyarrow as pa

    from tallyweave.operators import event_features as ef

    monkeypatch.setattr(ef, "_CHUNK_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = sorted(((int(rng.integers(3)), f"e{rng.integers(9)}", f"k{rng.integers(4)}", 1, None if rng.random() < 0.3 else int(rng.integers(100)), int(rng.integers(2**45)), int(rng.integers(9))) for _ in range(300)), key=lambda r: r[0])
    names = ["block", "entity", "kind", "n", "latest", "plus", "minus"]
    kinds = [pa.int32(), pa.string(), pa.string(), *[pa.int64()] * 4]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 40]), kinds)], names) for i in range(0, 300, 40)]
    got = sorted((b, a, k, f["n"], f["latest"], f["total_sats"]) for b, out in enumerate(ef._fold(iter(batches))) for a, m in zip(out.column(0).to_pylist(), out.column(1).to_pylist()) for k, f in m)
    want = defaultdict(lambda: [0, None, 0])
    for b, e, k, n, t, p, m in rows:
        w = want[b, e, k]
        w[0], w[1], w[2] = w[0] + n, max((x for x in (w[1], t) if x is not None), default=None), w[2] + p - m
    assert got == sorted((*k, *v) for k, v in want.items())
