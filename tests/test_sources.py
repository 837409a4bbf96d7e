import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyweave.operators import behavior, ledger
from tallyweave.sources import blocks, explorer


def test_blocks_round_trip(spark, tmp_path):
    good = {"height": 1999, "hash": "h", "time": 5, "txs": [
        {"txid": "a", "time": 1, "inputs": [{"address": None, "value_sats": 1}], "outputs": [{"n": 0, "address": "X", "value_sats": 3}, {"n": 1, "address": None, "value_sats": 0}]},
        {"txid": "b", "time": 1, "inputs": [], "outputs": [{"n": 0, "address": None, "value_sats": 3}]},
    ]}
    (tmp_path / "in" / "001").mkdir(parents=True)
    (tmp_path / "in" / "001" / "1999.json").write_text(json.dumps(good))
    (tmp_path / "in" / "001" / "2000.json").write_text('{"height": 2000, "txs": [')
    (tmp_path / "in" / "2001.json").write_text(json.dumps({**good, "height": 2001, "n_tx": 9}))
    got = blocks.reduce_blocks(blocks.read_blocks_json(spark, str(tmp_path / "in")))
    blocks.write_blocks(got, str(tmp_path / "out"))
    rows = {r.height: r for r in blocks.read_blocks(spark, str(tmp_path / "out")).collect()}
    assert {h: (r.n_tx, r.n_tx_kept) for h, r in rows.items()} == {1999: (1, 1), 2001: (9, 1)}
    assert [r.height for r in blocks.read_blocks(spark, str(tmp_path / "out"), start=2000, end=3000).collect()] == [2001]
    assert blocks.tip_height(got) == 2001
    led = ledger.from_blocks(got)
    f = behavior.with_features(behavior.accumulators(led), min_txs=1)
    blocks.write_window(f, behavior.edges(led, f), behavior.window_stats(led, f), str(tmp_path / "w"))
    w = blocks.read_window(spark, str(tmp_path / "w"))
    assert w["features"].count() == 1 and w["meta"].first().transactions == 2


def test_canonical_transactions(spark, data):
    tx = blocks.canonical_transactions(spark.read.parquet(f"{data}/raw_tx.parquet")).cache()
    assert tx.where("txid is not null").count() > 10
    assert tx.where("fee_sats < 0 or (is_coinbase and fee_sats <> 0)").count() == 0
    kept = tx.where("txid is not null")
    assert blocks.require_real(kept).where("txid is not null").count() == kept.count()
    r = blocks.address_records(tx).agg(F.sum("total_received_sats"), F.sum("balance_sats")).first()
    assert r[0] > 0
    with pytest.raises(ValueError):
        blocks.provenance("made-up")
    with pytest.raises(PySparkException):
        blocks.require_real(tx.withColumn("txid", F.lit(None).cast("string"))).select("txid").collect()


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def wait(self, s):
        self.now += s


GOOD = "1" + "A" * 30


def made(providers, fetch, clock, **more):
    return explorer.Explorer(providers, fetch, clock, clock.wait, any_address=True, **more)


def test_provider_rotation():
    clock = Clock()
    a, b = explorer.esplora("A", "a"), explorer.offset_pages("B", "b", size=2)
    pages = {"B/rawaddr/x?limit=2&offset=0": '{"txs": [{"hash": "1"}, {"hash": "2"}]}', "B/rawaddr/x?limit=2&offset=2": '{"txs": [{"hash": "3"}]}'}
    e = made([a, b], lambda u: (200, pages[u]) if u in pages else (429, ""), clock)
    assert list(e.bodies("x")) == list(pages.values())
    first, second = e.status()
    assert (first["refusals_in_row"], first["last_reason"], second["answers"]) == (1, "status 429", 2) and first["rests_for"] == pytest.approx(60, abs=1)
    clock.now = 100
    assert list(e.bodies("x")) and e.status()[0]["refusals_in_row"] == 2 and e.standings["a"].free_at == pytest.approx(220, abs=1)
    for _ in range(9):
        e.standings["a"].took("refused", 0.0)
    assert e.standings["a"].free_at == 900
    e.standings["a"].took("answered", 0.0)
    assert e.standings["a"].refusals_in_row == 0 and e.standings["a"].free_at == 0


def test_other_errors_do_not_rest_a_provider():
    clock = Clock()
    answers = iter([(500, ""), (404, ""), (200, "[]")])
    e = made([explorer.esplora("A")], lambda u: next(answers), clock)
    assert list(e.bodies("x")) == ["[]"] and e.status()[0]["errors"] == 2 and e.status()[0]["rests_for"] == 0
    with pytest.raises(OSError, match="status 500"):
        made([explorer.esplora("A")], lambda u: (500, ""), clock).transaction("t")
    assert clock.now >= 0.35

    def broken(url):
        raise OSError("timeout")

    e = made([explorer.esplora("A")], broken, clock)
    with pytest.raises(OSError, match="timeout"):
        e.transaction("t")
    assert e.status()[0]["rests_for"] > 0 and len(e.calls) == 1


def test_one_short_wait_when_all_rest():
    clock = Clock()
    e = made([explorer.esplora("A")], lambda u: (200, "[]"), clock)
    e.standing(e.providers[0]).free_at = 15
    assert list(e.bodies("x")) == ["[]"] and clock.now >= 15
    e.standing(e.providers[0]).free_at = clock.now + 500
    with pytest.raises(OSError):
        list(e.bodies("x"))


def test_cursor_pages_and_cache(tmp_path):
    seen = []

    def fetch(url):
        seen.append(url)
        n = 25 if len(seen) == 1 else 1
        return 200, json.dumps([{"txid": f"t{i}"} for i in range(n)])

    cache = explorer.FolderCache(str(tmp_path))
    pages = list(made([explorer.esplora("E")], fetch, Clock(), cache=cache).bodies("x"))
    assert len(pages) == 2 and seen == ["E/address/x/txs", "E/address/x/txs/chain/t24"]
    # offline, the cache answers
    assert list(made([explorer.esplora("E")], None, Clock(), cache=cache).bodies("x")) == pages
    with pytest.raises(OSError, match="offline"):
        list(made([explorer.esplora("E")], None, Clock(), cache=cache).bodies("y"))
    cache.put("a/b", "1")
    cache.put("a_b", "2")
    assert (cache.get("a/b"), cache.get("a_b"), cache.get("c")) == ("1", "2", None)


def test_totals_transaction_and_gate():
    answer = {"chain_stats": {"funded_txo_sum": 5, "spent_txo_sum": 2, "tx_count": 3}, "mempool_stats": {"funded_txo_sum": 1}}
    e = explorer.Explorer([explorer.esplora("E")], lambda u: (200, json.dumps(answer)), Clock(), lambda s: None)
    got = e.totals(GOOD)
    assert (got["total_received_sats"], got["total_sent_sats"], got["balance_sats"], got["n_tx"]) == (6, 2, 4, 3)
    assert json.loads(e.transaction("t")) == answer and e.calls[-1] == "E/tx/t"
    with pytest.raises(ValueError):
        e.totals("nonsense")
    b = explorer.Explorer([explorer.offset_pages("B")], lambda u: (200, '{"total_received": 9, "total_sent": 4, "n_tx": 2}'), Clock(), lambda s: None)
    assert b.totals(GOOD)["balance_sats"] == 5


def test_patience_with_one_server():
    waits, answers = [], iter([(503, ""), (502, ""), (200, "ok")])
    assert explorer.fetch_patiently(lambda u: next(answers), "u", wait=waits.append) == "ok" and waits == [3, 6]
    with pytest.raises(OSError, match="status 404"):
        explorer.fetch_patiently(lambda u: (404, ""), "u", wait=waits.append)
    assert len(waits) == 2 and [explorer.backoff(429, k) for k in (0, 1, 9)] == [3, 6, 60] and explorer.backoff(None, 9) == 30


def test_config():
    assert explorer.fill_url("u/{address}?k={key}", "A", "K") == "u/A?k=K"
    assert explorer.fill_url("u/{address}", "A", "K") == "u/A?key=K"
    base = {"a": 1, "b": {"c": 2, "d": 3}}
    assert explorer.merged_config(base, '{"b": {"c": 5}}') == {"a": 1, "b": {"c": 5, "d": 3}}
    assert explorer.merged_config(base, "{broken") == explorer.merged_config(base, None) == base


def test_providers_of_a_config():
    assert [p.name for p in explorer.providers_of({})] == ["blockstream.info", "mempool.space", "blockchain.info"]
    own = {"providers": [{"kind": "esplora", "name": "mine", "base": "http://h/api/"}]}
    assert explorer.providers_of(own)[0].tx_url("t") == "http://h/api/tx/t"
    for bad in ({"kind": "x", "name": "n", "base": "http://h"}, {"kind": "esplora", "name": "n", "base": "file:///x"}, {"kind": "esplora", "name": "n", "base": "http://h", "key": "secret"}):
        with pytest.raises(ValueError) as e:
            explorer.providers_of({"providers": [bad]})
        assert "secret" not in str(e.value)


def test_data_source_plans(spark):
    spark.dataSource.register(explorer.ExplorerSource)
    assert spark.read.format("explorer").option("base", "http://127.0.0.1:9").load().columns == ["record_id", "address", "body"]
