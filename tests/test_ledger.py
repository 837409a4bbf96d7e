"""Hand-computed cases, and sequential checkers written from the rules."""

import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import money
from tallyweave.operators import behavior, cohort, labels, ledger, metrics, peel, ranks, trace
from tallyweave.session import Scratch

BLOCKS = "height long, time long, txs array<struct<txid: string, time: long, inputs: array<struct<address: string, value_sats: long>>, outputs: array<struct<n: int, address: string, value_sats: long>>>>"


def led_of(spark, txs, block_time=0):
    """txs: (txid, time, {inputs as pairs}, [outputs as pairs]); one block."""
    t = [(i, ts, list(ins), [(k, a, v) for k, (a, v) in enumerate(outs)]) for i, ts, ins, outs in txs]
    return ledger.from_blocks(spark.createDataFrame([(1, block_time, t)], BLOCKS))


def features_of(led, min_txs=1, with_peel=False):
    p = peel.peel_columns(led, peel.chain_members(led)) if with_peel else None
    return {r.address: r for r in behavior.with_features(behavior.accumulators(led), p, min_txs).collect()}


def test_self_change_and_repeated_inputs(spark):
    led = led_of(spark, [("t1", 100, [("A", 60), ("A", 40)], [("B", 70), ("A", 25)])])
    f = features_of(led)
    a, b = f["A"], f["B"]
    assert (a.n_tx_out, a.sent_btc, a.n_tx_in, a.received_btc, a.number_of_splits, a.percentage_sent_to_new_addresses, a.out_degree) == (2, 1e-6, 0, 0, 1, 1, 1)
    assert (b.n_tx_in, b.received_btc, b.in_degree) == (1, 7e-7, 1)
    everyone = spark.createDataFrame([("A",), ("B",)], "address string")
    assert [tuple(r) for r in behavior.edges(led, everyone).select("src", "dst", "value_sats", "n_txs").collect()] == [("A", "B", 70, 2)]
    assert behavior.edges(led, everyone.where("address = 'A'")).count() == 0


def test_turnaround_and_layering(spark):
    led = led_of(spark, [("t1", 1000, [("X", 100)], [("A", 100)]), ("t2", 1500, [("Y", 50)], [("A", 50)]), ("t3", 1560, [("A", 150)], [(c, 30) for c in "PQRS"])])
    a = features_of(led)["A"]
    assert (a.avg_holding_time, a.number_of_splits, a.forward_ratio, a.lifetime_seconds, a.percentage_sent_to_new_addresses) == (60, 4, 1, 560, 1)
    assert a.layering_score == pytest.approx(0.36) and a.transaction_frequency == pytest.approx(19.285714)


def test_turnaround_across_slots(spark):
    led = led_of(spark, [("t1", 1000, [("X", 1)], [("A", 100)]), ("t2", 5 * 86400, [("A", 1)], [("B", 1)]), ("t3", 9 * 86400, [("A", 1)], [("B", 1)])])
    assert features_of(led)["A"].avg_holding_time == 5 * 86400 - 1000


def test_missing_time_uses_the_block(spark):
    assert features_of(led_of(spark, [("t", 0, [("A", 1)], [("B", 1)])], block_time=77))["A"].first_seen == 77


PEEL = [("t1", 1, [("A", 100)], [("B", 90), ("x1", 10)]), ("t2", 2, [("B", 90)], [("C", 85), ("x2", 5)]), ("t3", 3, [("C", 85)], [("D", 80), ("x3", 5)]), ("t5", 4, [("F", 100)], [("E", 97), ("y", 3)]), ("t4", 5, [("E", 97)], [("B", 95), ("x4", 5)])]


def test_peel_overwrite_and_backward_walk(spark):
    led = led_of(spark, PEEL)
    assert {r.txid: r.next for r in peel.successors(led).collect()}["t4"] == "t2"
    got = {r.address: (r.chain_length, r.position) for r in peel.chain_members(led).collect()}
    assert got == {"E": (4, 1), "B": (4, 2), "C": (4, 3), "D": (4, 4)}
    f = features_of(led, with_peel=True)
    assert [f[a].peel_chain_length for a in "EBCADF" if a in f] == [4, 4, 4, 0, 0, 0]
    assert [f[a].peel_like_spends for a in "BCE"] == [1, 1, 1]


def test_peel_edges(spark):
    led = led_of(spark, [("a", 1, [("I", 1)], [("P", 100), ("Q", 0)]), ("b", 2, [("I", 1)], [("P", 100)]), ("c", 3, [("I", 1)], [("P", 97), ("Q", 1), ("R", 1), ("S", 1)]), ("d", 4, [("I", 1)], [("Q", 15), ("P", 85)])])
    assert [(r.txid, r.carrier) for r in peel.peel_shaped(led).collect()] == [("d", "P")]


def sequential_chains(txs, cap=500):
    spent, shape = {}, {}
    order = sorted(range(len(txs)), key=lambda i: (txs[i][1], i))
    for i in order:
        for a, _ in txs[i][2]:
            spent.setdefault(a, i)
        outs = txs[i][3]
        total = sum(v for _, v in outs)
        if 2 <= len(outs) <= 3 and total:
            a, big = max(outs, key=lambda o: o[1])
            if big / total >= 0.85 and total > big:
                shape[i] = a
    used, out = set(), {}
    for s in order:
        if s in used or s not in shape:
            continue
        path, at = [], s
        while at in shape and at not in path and len(path) < cap:
            path.append(at)
            nxt = spent.get(shape[at])
            if nxt is None or nxt == at:
                break
            at = nxt
        if len(path) >= 3:
            used |= set(path)
            out |= {shape[t]: (len(path), k + 1) for k, t in enumerate(path)}
    lengths = {}
    for s in shape:
        path, at = [], s
        while at in shape and at not in path and len(path) < cap:
            path.append(at)
            nxt = spent.get(shape[at])
            if nxt is None or nxt == at:
                break
            at = nxt
        lengths[txs[s][0]] = len(path)
    return out, lengths


@pytest.mark.parametrize("seed, cap, forward", [(1, 500, False), (2, 500, False), (3, 4, False), (4, 5, True), (5, 7, True)])
def test_peel_against_sequential_checker(spark, monkeypatch, seed, cap, forward):
    """Random graphs with rings and shared carriers, one of them a single large component; with a small cap walks are cut off."""
    monkeypatch.setattr(peel, "MAX_WALK", cap)
    rnd = random.Random(seed)
    name = lambda: f"a{rnd.randrange(40)}"
    txs = [(f"t{i:03}", rnd.randrange(1, 60), [(name(), 10)], [(name(), 90), (name(), 5)] if rnd.random() < 0.8 else [(name(), 5)]) for i in range(90)]
    if forward:  # a chain of 40 transactions in order, with others that run into it
        txs += [(f"u{i:03}", 100 + i, [(f"b{i}", 100)], [(f"b{i + 1}", 90), ("z", 5)]) for i in range(40)]
        txs += [(f"v{i:03}", rnd.randrange(1, 200), [(f"c{i}", 100)], [(f"b{rnd.randrange(40)}", 90), ("z", 5)]) for i in range(12)]
    led = led_of(spark, txs)
    members, lengths = sequential_chains(txs, cap)
    assert {r.address: (r.chain_length, r.position) for r in peel.chain_members(led).collect()} == members
    assert {r.txid: r.walk_length for r in peel.walk_lengths(led).collect()} == lengths


def test_average_precision_ties(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (2, 1, 0.4)], "pos int, y int, score double")
    assert metrics.average_precision(rows).first()[0] == 0.8333
    assert metrics.average_precision(rows.withColumn("y", F.lit(0))).first()[0] == 0.0
    assert metrics.precision_at(rows).where("asked = 10").first().k == 3
    assert metrics.best_threshold(rows.withColumn("y", F.lit(0))).first().threshold == 0.5
    two = spark.createDataFrame([(0, 1, 0.9), (1, 1, 0.6), (2, 0, 0.6), (3, 0, 0.2)], "pos int, y int, score double")
    assert tuple(metrics.best_threshold(two, "youden").first()) == (0.21, 0.5)
    with pytest.raises(ValueError):
        metrics.best_threshold(two, "accuracy")


def listed(spark, **types):
    return spark.createDataFrame(list(types.items()), "address string, type string")


def test_trace(spark):
    led = led_of(spark, [("t0", 1, [("S", 1000000)], [("A", 1000000)]), ("t1", 2, [("A", 1000000)], [("B", 600000), ("C", 300000), ("D", 50000)])])
    t = trace.trace(led, "A")
    assert [(e["kind"], e["address"], e["hops"], e["value_sats"]) for e in t.endpoints] == [("DORMANT", "B", 1, 631579), ("DORMANT", "C", 1, 315789)]
    assert (t.stats["value_floor"], t.stats["pruned_branches"], t.stats["pruned_value"]) == (100000, 1, 52632)
    assert t.value_by_hop == {0: 1000000, 1: 947368} and t.verdict["headline"].startswith("94.7%") and t.verdict["next_step"]
    rows = trace.endpoint_rows(spark, t)
    assert rows.select(trace.path_text(F.col("path")).alias("p")).first().p.startswith(" 1. 631579") and rows.first().detail == "holds 0.00600 BTC and has spent nothing"
    assert trace.trace(led, "S").endpoints == [] and trace.trace(led, "S").verdict["outcome"] == "empty"
    lists = spark.createDataFrame([("B", "Exchange", "X", 0.7, "me"), ("C", "mixer", None, None, None)], "address string, type string, name string, confidence double, source string")
    named = trace.trace(led, "A", labels=lists)
    assert [(e["kind"], e["confidence"], e["label"], e["detail"]) for e in named.endpoints] == [("SERVICE", 0.7, "X", "listed as Exchange X, source: me"), ("MIXER", 0.95, None, "listed as mixer, source: given list")]
    assert named.endpoints[0]["deposit_candidate"] == "A" and named.verdict["accounts_for"] == "63.2%"
    assert trace.trace(led, "A", trace.TraceOptions(max_hops=0)).endpoints[0]["basis"] == "hop_limit"
    flagged = trace.trace(led, "A", sanctions=spark.createDataFrame([("B",)], "address string"))
    assert [e["kind"] for e in flagged.endpoints] == ["SANCTIONED", "DORMANT"]


def test_trace_from_another_source():
    step = trace.Step("t", 1, 1, 10**6, 10**6, [("B", 600000), ("C", 400000)], None)
    nodes = {"A": trace.Node("A", 1, 10**6, 0, steps=[step]), "B": OSError("timeout"), "C": None}

    class Stub:
        def read(self, addresses):
            return {a: nodes[a] for a in addresses}

    t = trace.trace(None, "A", reader=Stub())
    assert [(e["kind"], e["address"], e["share_of_source"]) for e in t.endpoints] == [("ERROR", "B", None), ("ERROR", "C", None)] and "timeout" in t.endpoints[0]["detail"]
    assert not trace.trace(None, "C", reader=Stub()).ok and trace.trace(None, "B", reader=Stub()).verdict["outcome"] == "offline"


def test_trace_peel_chain_is_one_hop(spark):
    chain = [(f"t{i}", i, [(f"a{i}", 10**7 - i)], [(f"a{i + 1}", 10**7 - i - 200), (f"x{i}", 199)]) for i in range(1, 6)]
    t = trace.trace(led_of(spark, [("t0", 0, [("S", 10**7)], [("a1", 10**7)]), *chain], block_time=0), "a1")
    assert t.peel_chains[0]["length"] == 5 and t.endpoints[0]["hops"] == 1 and t.endpoints[0]["path"][0]["via"] == "peel_chain"


def checked_trace(txs, source, hops, budget, floor, service, fan):
    """The rules of the search over plain lists: the queue is scanned for its largest value each time."""
    known = lambda a: [t for t in txs if a in [x for x, _ in t[2] + t[3]]]
    got = lambda a: sum(v for t in txs for x, v in t[3] if x == a)
    gave = lambda a: sum(v for t in txs for x, v in t[2] if x == a)
    place = {t[0]: i for i, t in enumerate(sorted(txs, key=lambda t: (t[1], t[0])))}
    spends = lambda a: sorted((t for t in txs if a in [x for x, _ in t[2]]), key=lambda t: -place[t[0]])
    def kind(a):
        return "SERVICE" if len(known(a)) >= service else "DORMANT" if got(a) and not gave(a) else "CONTINUE"
    def carrier(t):
        total = sum(v for _, v in t[3])
        if not 2 <= len(t[3]) <= 3 or not total:
            return None
        a, v = max(t[3], key=lambda o: o[1])
        return (a, v, total - v) if v / total >= 0.85 and total > v else None
    start = got(source)
    queue, best, read, ends, by_hop, pruned = [(start, source, 0)], {}, {source}, [], {}, [0, 0]
    while queue and len(read) - 1 < budget:
        k = max(range(len(queue)), key=lambda i: (queue[i][0], -i))
        value, a, h = queue.pop(k)
        if value < floor:
            pruned = [pruned[0] + 1, pruned[1] + value]
            continue
        if best.get(a, -1) >= value:
            continue
        best[a] = value
        read.add(a)
        by_hop[h] = by_hop.get(h, 0) + value
        if h and kind(a) != "CONTINUE":
            ends.append((kind(a), a, h, value))
            continue
        if h >= hops:
            ends.append(("HORIZON", a, h, value))
            continue
        out, share = [], min(1.0, value / max(1, got(a) or value))
        for t in spends(a):
            mine, total = sum(v for x, v in t[2] if x == a), sum(v for _, v in t[3])
            if not mine or not total:
                continue
            links, at = [], t
            while at and (c := carrier(at)) and (links or c[0] != a) and len(links) < 200:
                links.append(c)
                if len(read) - 1 >= budget and (len(links) >= 2 or c[0] not in read):
                    break
                read.add(c[0])
                at = None if kind(c[0]) != "CONTINUE" else next((x for x in spends(c[0]) if x[0] != at[0]), None)
            if len(links) >= 3:
                out.append((int(min(mine, links[-1][1]) * share + 0.5), links[-1][0]))
                continue
            for x, v in t[3]:
                if x != a:
                    f = int(int(mine * (v / total) + 0.5) * share + 0.5)
                    if f < floor:
                        pruned = [pruned[0] + 1, pruned[1] + f]
                    else:
                        out.append((f, x))
        out.sort(key=lambda b: -b[0])
        queue += [(f, x, h + 1) for f, x in out[:fan]]
        pruned[0] += max(0, len(out) - fan)
    return sorted(ends, key=lambda e: -e[3]), by_hop, len(read) - 1, pruned, len(queue)


@pytest.mark.parametrize("seed, budget", [(1, 200), (2, 12), (3, 40)])
def test_trace_against_sequential_checker(spark, seed, budget):
    rnd = random.Random(seed)
    name = lambda: f"a{rnd.randrange(45)}"
    txs = []
    for i in range(120):
        v = rnd.randrange(10**6, 10**8)
        outs = [(name(), v * 9 // 10), (name(), v // 20)] if rnd.random() < 0.5 else [(name(), v // 3) for _ in range(rnd.randrange(1, 5))]
        txs.append((f"t{i:03}", rnd.randrange(1, 90), [(name(), v)], outs))
    led, opt = led_of(spark, txs), trace.TraceOptions(max_hops=4, budget=budget, service_min_txs=16, max_branches=3)
    reader = trace.LedgerSource(led, opt)
    for source in ("a1", "a7"):
        t = trace.trace(led, source, opt, reader=reader)
        ends, by_hop, n_read, pruned, left = checked_trace(txs, source, 4, budget, t.stats["value_floor"], 16, 3)
        assert [(e["kind"], e["address"], e["hops"], e["value_sats"]) for e in t.endpoints] == ends
        assert t.value_by_hop == by_hop and t.stats["fetches"] == n_read
        assert [t.stats["pruned_branches"], t.stats["pruned_value"], t.stats["unexplored_branches"]] == [*pruned, left]


def test_classification(spark):
    rows = [("n", 999, 5, 1), ("k", 1000, 5, 1), ("t", 10000, 5, 1), ("m", 1000000, 5, 1), ("e", 3, 5, 1), ("s", 3, 5, 1), ("d", 3, 5, 0), ("o", 3, 5, 1)]
    t = spark.createDataFrame(rows, "address string, n_tx long, received long, sent long")
    lists = spark.createDataFrame([("e", "Exchange"), ("s", "scam")], "address string, type string"), spark.createDataFrame([("o",)], "address string")
    assert trace.classify(t.limit(0)).count() == 0
    got = {r.address: (r.kind, round(r.confidence, 6)) for r in trace.classify(t, *lists).collect()}
    assert got == {"n": ("CONTINUE", 0), "k": ("SERVICE", 0.55), "t": ("SERVICE", 0.75), "m": ("SERVICE", 0.9), "e": ("SERVICE", 0.95), "s": ("CONTINUE", 0), "d": ("DORMANT", 0.9), "o": ("SANCTIONED", 1)}


A1, A2 = "1" + "A" * 30, "3" + "B" * 30


def test_label_lists(spark):
    raw = spark.createDataFrame(
        [(0, A1, "bitcoin", "X", 1.6, [("h", 5, 2.5, 0.0)]), (1, A1, "bitcoin", None, 2.0, None), (2, A2, "ether", "X", 1.0, None), (3, "bad", "bitcoin", "X", 1.0, None)],
        "pos int, address string, blockchain string, family string, balance double, transactions array<struct<hash: string, time: long, amount: double, amountUSD: double>>",
    )
    rows = labels.parse_ransom_export(raw)
    assert [(r.address, r.family, r.balance_sats, r.n_payments) for r in labels.ransom_addresses(rows).collect()] == [(A1, "Unlabeled", 2, 0)]
    assert {r.family: (r.n_addresses, r.n_payments) for r in labels.ransom_families(rows).collect()} == {"X": (1, 1), "Unlabeled": (1, 0)}
    lines = spark.createDataFrame([(0, f'1,"Ann",XBT {A1}; alt {A2}'), (1, f"2,Bob,{A1}"), (2, None), (3, "x")], "pos int, value string")
    s = labels.parse_sanctions(lines)
    assert {r.address: r.entity for r in s.collect()} == {A1: "Ann", A2: "Ann"}
    assert {r.address: r.kind for r in labels.confirmed(rows.select("address"), s).collect()} == {A1: "sanctioned", A2: "sanctioned"}


def test_amount_text(spark):
    v = [0, 999, 1000, 100000, 10**8, 10**11, -123456789]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    assert [r[0] for r in df.select(money.human_coins(F.col("v"))).collect()] == ["0", "999 sats", "0.00001000 BTC", "0.00100 BTC", "1.000 BTC", "1000 BTC", "-1.235 BTC"]
    assert [r[0] for r in df.select(money.format_coins(F.col("v"), 4)).collect()][-1] == "-1.2345"
    t = spark.createDataFrame([(0.0,), (59.4,), (90.0,), (5400.0,), (129600.0,)], "s double").select(money.span_text(F.col("s")))
    assert [r[0] for r in t.collect()] == ["instant", "59s", "2m", "1.5h", "1.5d"]
    a = spark.createDataFrame([("bc1" + "q" * 39,), ("short",), (None,)], "a string").select(money.short_text(F.col("a")), money.address_kind(F.col("a")))
    assert [tuple(r) for r in a.collect()] == [("bc1qqqqq…qqqqqq", "bech32"), ("short", None), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(0.5e-8,), (float("nan"),), (None,), (1.5,)], "x double").select(money.coins_to_sats(F.col("x"))).collect()] == [1, 0, 0, 150000000]


def test_density_labels():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(0, 0.05, (60, 2)), rng.normal(3, 0.05, (60, 2)), rng.uniform(-8, 12, (12, 2))]
    got = cohort.density_labels(x, 15)
    assert len(set(got[:60]) - {-1}) == 1 and len(set(got[60:120]) - {-1}) == 1 and got[0] != got[60]
    assert (got[120:] == -1).sum() >= 8
    assert (cohort.density_labels(x[:5], 15) == -1).all()


def test_cohorts_assign_the_rest(spark):
    rows = [(f"a{i:03}", float(i % 2) * 5000 + i % 7, 1.0 + i % 2, 0.0, 1.0) for i in range(300)]
    f = spark.createDataFrame(rows, "address string, avg_holding_time double, number_of_splits double, percentage_sent_to_new_addresses double, transaction_frequency double")
    got = cohort.cohorts(f, max_points=100)
    assert got.count() == 300 and got.select("address").distinct().count() == 300


def test_percentiles_of_a_group_with_most_rows(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = [(None if i % 50 == 0 else "hot" if i % 3 else f"g{i % 7}", None if rng.random() < 0.1 else float(rng.integers(40)), float(rng.normal())) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, a double, b double")
    with Scratch(spark) as scratch:
        got = {r.g: r for r in ranks.percentiles(df, ["g"], ["a", "b"], 0.9, scratch).collect()}
        for g in {d[0] for d in data}:
            own = [d for d in data if d[0] == g]
            assert got[g]["size"] == len(own)
            for k, c in ((1, "a"), (2, "b")):
                assert got[g][c] == pytest.approx(np.percentile([d[k] for d in own if d[k] is not None], 90))
        assert ranks.percentiles(df.limit(0), ["g"], ["a"], 0.5, scratch).count() == 0


def test_height_window(spark):
    b = spark.range(10).selectExpr("id as height")
    assert sorted(r.height for r in ledger.height_window(b, count=3).collect()) == [7, 8, 9]
    assert ledger.height_window(b, count=30, end=4).count() == 5
    assert ledger.height_window(b.limit(0), days=1).count() == 0
