"""Paged HTTP sources of transactions, with a choice among providers.

The transport is a function ``fetch(url) -> (status, text)``, so the logic runs
without a network; ``clock`` and ``wait`` are replaceable for the same reason.
``ExplorerSource`` makes it a Spark data source that yields raw bodies, to be
parsed by ``blocks.canonical_transactions``: one task per address.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyweave.functions.money import ADDRESS_PATTERNS

Fetch = Callable[[str], tuple[int, str]]
# Answers that refuse for now, and those that are worth another try. Fixed values.
REFUSED = frozenset({429, 430, 503})
OVERLOADED = frozenset({429, 430, 500, 502, 503, 504})
FIRST_BENCH, LONGEST_BENCH = 60.0, 900.0


# --------------------------------------------------------------------------- providers
@dataclass(frozen=True)
class Provider:
    """Where a provider's answers are: pages of an address, its totals, one transaction, and the raw block at a height.

    ``page_url`` gets address, page number and the transactions of the page before.
    ``totals`` reads (received, sent, number of transactions) from the text at ``totals_url``.
    """

    name: str
    page_url: Callable[[str, int, list], str]
    page_size: int
    tx_url: Callable[[str], str]
    totals_url: Callable[[str], str] | None = None
    totals: Callable[[dict], tuple[int, int, int]] | None = None


def esplora(base: str, name: str = "esplora") -> Provider:
    """Pages continue after the last transaction's identifier; totals are those of the chain and of the waiting transactions."""

    def url(address: str, page: int, last: list) -> str:
        return f"{base}/address/{address}/txs" + (f"/chain/{last[-1]['txid']}" if page and last else "")

    def totals(answer: dict) -> tuple[int, int, int]:
        parts = [answer.get(k) or {} for k in ("chain_stats", "mempool_stats")]
        return tuple(sum(int(p.get(k) or 0) for p in parts) for k in ("funded_txo_sum", "spent_txo_sum", "tx_count"))

    return Provider(name, url, 25, lambda txid: f"{base}/tx/{txid}", lambda address: f"{base}/address/{address}", totals)


def offset_pages(base: str, name: str = "offset", size: int = 50) -> Provider:
    """Pages are counted by offset; a page holds the totals too."""
    page = lambda address, n, last: f"{base}/rawaddr/{address}?limit={size}&offset={n * size}"
    totals = lambda answer: (int(answer.get("total_received") or 0), int(answer.get("total_sent") or 0), int(answer.get("n_tx") or 0))
    return Provider(name, page, size, lambda txid: f"{base}/rawtx/{txid}", lambda address: page(address, 0, []), totals)


# Public providers in order of preference. Fixed values.
PRESETS = (("esplora", "blockstream.info", "https://blockstream.info/api"), ("esplora", "mempool.space", "https://mempool.space/api"), ("offset", "blockchain.info", "https://blockchain.info"))


def preset_providers() -> list[Provider]:
    make = {"esplora": esplora, "offset": offset_pages}
    return [make[kind](base, name) for kind, name, base in PRESETS]


# --------------------------------------------------------------------------- choice among providers
@dataclass
class Standing:
    """What came of the calls to one provider."""

    answers: int = 0
    errors: int = 0
    refusals_in_row: int = 0
    free_at: float = 0.0
    called_at: float = float("-inf")
    reason: str | None = None

    def took(self, outcome: str, now: float, reason: str | None = None) -> None:
        """Note 'answered', 'refused' or 'error' (an answer that is of no use); only a refusal makes the provider rest, the longer the more in a row."""
        match outcome:
            case "answered":
                self.answers += 1
                self.refusals_in_row, self.free_at = 0, 0.0
            case "refused":
                self.free_at = now + min(LONGEST_BENCH, FIRST_BENCH * 2**self.refusals_in_row)
                self.refusals_in_row += 1
                self.reason = reason
            case "error":
                self.errors += 1
                self.reason = reason
            case _:
                raise ValueError(f"unknown outcome: {outcome}")


def backoff(status: int | None, attempt: int) -> float:
    """Seconds before the next try: longer after an overload answer than after a broken connection."""
    return min(60.0, 3.0 * 2**attempt) if status in OVERLOADED else min(30.0, 2.0 * 2**attempt)


def fetch_patiently(fetch: Fetch, url: str, tries: int = 3, wait: Callable[[float], None] = time.sleep) -> str:
    """The text at a URL of a single server (blocks have one): overloads and broken connections are tried again after a pause that doubles."""
    said = ""
    for attempt in range(tries):
        status: int | None = None
        try:
            status, text = fetch(url)
            if status == 200:
                return text
            said = f"status {status}"
        except OSError as e:
            said = str(e)
        if status is not None and status not in OVERLOADED:
            break
        if attempt + 1 < tries:
            wait(backoff(status, attempt))
    raise OSError(f"{url}: {said}")


class FolderCache:
    """Texts by key in a folder; a write is complete or absent, what can't be read is absent."""

    def __init__(self, folder: str):
        self.folder = folder

    def _path(self, key: str) -> str:
        # the key's own characters may be no file name, and may clash without letter case
        name = re.sub(r"[^A-Za-z0-9._-]", "_", key)[:60] + "-" + hashlib.sha256(key.encode()).hexdigest()[:12]
        return os.path.join(self.folder, name[-2:], name)

    def get(self, key: str) -> str | None:
        try:
            with open(self._path(key), encoding="utf-8") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):
            return None

    def put(self, key: str, text: str) -> None:
        path = self._path(key)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.{os.getpid()}.part", "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(f.name, path)


@dataclass
class Explorer:
    """Answers of the first willing provider, from the cache where it has them. Without ``fetch`` it is offline and has the cache alone."""

    providers: list[Provider]
    fetch: Fetch | None
    clock: Callable[[], float] = time.monotonic
    wait: Callable[[float], None] = time.sleep
    pace: float = 0.35
    attempts: int = 6
    longest_wait: float = 20.0
    cache: FolderCache | None = None
    any_address: bool = False
    standings: dict[str, Standing] = field(default_factory=dict)
    calls: list[str] = field(default_factory=list)

    def standing(self, p: Provider) -> Standing:
        return self.standings.setdefault(p.name, Standing())

    def status(self) -> list[dict]:
        now = self.clock()
        return [{"name": p.name, "answers": s.answers, "errors": s.errors, "refusals_in_row": s.refusals_in_row, "rests_for": max(0.0, s.free_at - now), "last_reason": s.reason} for p in self.providers for s in [self.standing(p)]]

    def _willing(self) -> Provider | None:
        """The first provider that does not rest."""
        now = self.clock()
        return next((p for p in self.providers if self.standing(p).free_at <= now), None)

    def _call(self, p: Provider, url: str) -> tuple[str, str]:
        """(outcome, text or reason) of one call, paced by provider."""
        s = self.standing(p)
        if (early := self.pace - (self.clock() - s.called_at)) > 0:
            self.wait(early)
        s.called_at = self.clock()
        self.calls.append(url)
        try:
            status, text = self.fetch(url)
        except OSError as e:
            s.errors += 1
            return "refused", str(e)  # an unreachable provider rests as well
        if status == 200:
            return "answered", text
        return ("refused" if status in REFUSED else "error"), f"status {status}"

    def ask(self, what: str, url_of: Callable[[Provider], str | None]) -> tuple[Provider, str]:
        """The first answer to a question that each provider has its own URL for."""
        if self.fetch is None:
            raise OSError(f"{what}: offline, and not in the cache")
        said = "no provider"
        for attempt in range(self.attempts):
            p = self._willing()
            if p is None:
                rest = min((self.standing(x).free_at for x in self.providers), default=0.0) - self.clock()
                if attempt or not self.providers or rest > self.longest_wait:
                    break  # all rest: one wait at most, and a short one
                self.wait(rest)
                continue
            url = url_of(p)
            if not url:
                said = f"{p.name} has no answer to this"
                continue
            outcome, text = self._call(p, url)
            self.standing(p).took(outcome, self.clock(), text if outcome != "answered" else None)
            if outcome == "answered":
                return p, text
            said = f"{p.name}: {text}"
        raise OSError(f"{what}: {said}")

    def bodies(self, address: str, max_pages: int = 4) -> Iterator[str]:
        """Raw pages, until one is short of a page's size or ``max_pages`` are read. Text that is no address raises."""
        self._gate(address)
        last: list = []
        for n in range(max_pages):
            key = f"pages/{address}/{n}"
            held = self.cache.get(key) if self.cache else None
            if held is None:
                p, text = self.ask(address, lambda p, n=n, last=last: p.page_url(address, n, last))
                held = json.dumps({"size": p.page_size, "text": text})
                if self.cache:
                    self.cache.put(key, held)
            page = json.loads(held)
            yield page["text"]
            got = json.loads(page["text"])
            last = got.get("txs", []) if isinstance(got, dict) else got
            if len(last) < page["size"]:
                return

    def totals(self, address: str) -> dict:
        """Received, sent, balance and number of transactions as the provider sums them up."""
        self._gate(address)
        p, text = self.ask(address, lambda p: p.totals_url and p.totals_url(address))
        received, sent, n = p.totals(json.loads(text))
        return {"address": address, "n_tx": n, "total_received_sats": received, "total_sent_sats": sent, "balance_sats": received - sent, "provider": p.name, "totals_derived_from_partial_history": False}

    def transaction(self, txid: str) -> str:
        """The raw body of one transaction."""
        held = self.cache.get(f"tx/{txid}") if self.cache else None
        if held is None:
            held = self.ask(txid, lambda p: p.tx_url(txid))[1]
            if self.cache:
                self.cache.put(f"tx/{txid}", held)
        return held

    def _gate(self, address: str) -> None:
        if not self.any_address and not any(re.match(pattern, address) for _, pattern in ADDRESS_PATTERNS):
            raise ValueError(f"no address: {address}")


# --------------------------------------------------------------------------- settings
def fill_url(template: str, address: str = "", key: str | None = None) -> str:
    """A template with its address and key; a key without a place becomes a parameter."""
    url = template.replace("{address}", address)
    if key:
        url = url.replace("{key}", key) if "{key}" in url else url + ("&" if "?" in url else "?") + f"key={key}"
    return url.replace("{key}", "")


def merged_config(defaults: dict, text: str | None) -> dict:
    """Saved settings over the defaults, members of members too; broken text gives the defaults."""
    try:
        saved = json.loads(text or "{}")
    except ValueError:
        return defaults
    merge = lambda a, b: {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}
    return merge(defaults, saved) if isinstance(saved, dict) else defaults


def providers_of(config: dict) -> list[Provider]:
    """The providers of a configuration (kind, name, base each, in order); without any, the presets. Other members are refused."""
    listed = config.get("providers") or [dict(zip(("kind", "name", "base"), x)) for x in PRESETS]
    make = {"esplora": esplora, "offset": offset_pages}
    for x in listed:
        if set(x) != {"kind", "name", "base"} or x["kind"] not in make or not re.match(r"https?://[^\s{}]+$", str(x["base"])):
            raise ValueError(f"not a provider: { {k: v for k, v in x.items() if k != 'key'} }")
    return [make[x["kind"]](x["base"].rstrip("/"), x["name"]) for x in listed]


# --------------------------------------------------------------------------- Spark data source
class ExplorerSource(DataSource):
    """``spark.read.format("explorer").option("addresses", "a,b").load()``; options base (one Esplora provider in place of the presets), config (JSON), maxpages, cache (a shared folder)."""

    @classmethod
    def name(cls) -> str:
        return "explorer"

    def schema(self) -> str:
        return "record_id long, address string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((i, a)) for i, a in enumerate(x for x in self.options.get("addresses", "").split(",") if x)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from urllib.error import HTTPError
        from urllib.request import urlopen

        def fetch(url: str) -> tuple[int, str]:
            try:
                with urlopen(url, timeout=60) as r:
                    return r.status, r.read().decode()
            except HTTPError as e:
                return e.code, ""

        o = self.options
        providers = [esplora(o["base"])] if "base" in o else providers_of(merged_config({}, o.get("config")))
        explorer = Explorer(providers, fetch, cache=FolderCache(o["cache"]) if "cache" in o else None, any_address="base" in o)
        i, address = partition.value
        for k, body in enumerate(explorer.bodies(address, int(o.get("maxpages", 4)))):
            yield i * 1_000_000 + k, address, body
