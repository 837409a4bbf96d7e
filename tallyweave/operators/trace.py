"""Following value forward from one address to where it stops.

The ledger is turned into two tables first: what is known of every address, with
its classification, and one row for each transaction an address spends in, with
its outputs and the output that would carry a peel chain on. Both are stored in
ranges of addresses. The search itself is a frontier of addresses with explicit
ranks (largest value first, of equal ones the one found first), which reads the
rows of many addresses at a time.

``budget`` bounds the addresses that the search reads and ``max_history`` the
transactions of each; of what was read, the driver holds twice the budget at
most and reads again what it let go.

Attribution is proportional: of an address that received R, of which v belongs
to the trace, the share min(1, v / R) of everything it sends on is followed.
"""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, fields
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyweave.functions.money import human_coins, round_half_up
from tallyweave.operators.ledger import Ledger
from tallyweave.session import Scratch

# Label types of services and of mixers, and the kinds at which value is not followed further. Fixed values.
SERVICE_LABELS = ("exchange", "service", "custodial", "payment_processor")
MIXER_LABELS = ("mixer", "tumbler", "coinjoin")
STOPS = ("SERVICE", "MIXER", "DORMANT")
_AT_ONCE = 48  # addresses of one read


@dataclass
class TraceOptions:
    max_hops: int = 6
    budget: int = 120
    min_value: int = 100_000
    min_fraction: float = 0.0002
    max_floor: int = 2_000_000
    service_min_txs: int = 1000
    max_branches: int = 12
    retain: float = 0.85
    max_peel_outputs: int = 3
    max_peel_length: int = 200
    max_history: int = 5000


def options(**given) -> TraceOptions:
    """Options by name; unknown names raise."""
    unknown = given.keys() - {f.name for f in fields(TraceOptions)}
    if unknown:
        raise ValueError(f"unknown options: {sorted(unknown)}")
    return TraceOptions(**given)


# --------------------------------------------------------------------------- column forms
def value_floor(start: Column, opt: TraceOptions = TraceOptions()) -> Column:
    return F.greatest(F.lit(opt.min_value), F.least(F.floor(start * F.lit(opt.min_fraction)), F.lit(opt.max_floor)))


def totals(led: Ledger) -> DataFrame:
    """(address, n_tx, received, sent, balance) as far as the ledger shows; change counts on both sides."""
    zero = F.lit(0).cast("long")
    rows = led.out.select("address", "txid", F.col("value").alias("r"), zero.alias("s")).unionByName(led.inp.select("address", "txid", zero.alias("r"), F.col("value").alias("s")))
    t = rows.groupBy("address").agg(F.count_distinct("txid").alias("n_tx"), F.sum("r").alias("received"), F.sum("s").alias("sent"))
    return t.withColumn("balance", F.col("received") - F.col("sent"))


def classify(t: DataFrame, labels: DataFrame | None = None, sanctions: DataFrame | None = None, opt: TraceOptions = TraceOptions()) -> DataFrame:
    """The totals with (kind, confidence, basis, detail, label): label lists first, then sanctions, then volume, then rest.

    ``labels`` has address and type, and may have name, confidence and source;
    of several rows of an address the first by type counts. Types that name
    neither a service nor a mixer say nothing. ``sanctions`` has address.
    """
    spark = t.sparkSession
    labels = labels if labels is not None else spark.createDataFrame([], "address string, type string")
    sanctions = sanctions if sanctions is not None else spark.createDataFrame([], "address string")
    own = [F.col(c).cast(kind) if c in labels.columns else F.lit(None).cast(kind) for c, kind in (("type", "string"), ("name", "string"), ("confidence", "double"), ("source", "string"))]
    listed = labels.select("address", F.struct(*[c.alias(n) for c, n in zip(own, ("type", "name", "confidence", "source"))]).alias("_l"))
    listed = listed.where(F.lower("_l.type").isin(*SERVICE_LABELS, *MIXER_LABELS)).groupBy("address").agg(F.min("_l").alias("_l"))
    flagged = sanctions.select("address", F.lit(True).alias("_flagged")).distinct()
    given = t.columns
    t = t.join(listed, "address", "left").join(flagged, "address", "left")
    n, kind = F.col("n_tx"), F.lower("_l.type")
    named = F.concat_ws("", F.lit("listed as "), "_l.type", F.when(F.col("_l.name").isNotNull(), F.concat(F.lit(" "), "_l.name")), F.lit(", source: "), F.coalesce("_l.source", F.lit("given list")))
    sure = F.coalesce("_l.confidence", F.lit(0.95))
    volume = F.least(F.lit(0.9), F.lit(0.55) + F.log10(n / F.lit(float(opt.service_min_txs))) * 0.2)
    none = F.lit(None).cast("string")
    out = F.when(kind.isin(*SERVICE_LABELS), _class("SERVICE", sure, "label_list", named, F.col("_l.name")))
    out = out.when(kind.isin(*MIXER_LABELS), _class("MIXER", sure, "label_list", named, F.col("_l.name")))
    out = out.when(F.col("_flagged"), _class("SANCTIONED", F.lit(1.0), "ofac_sdn", F.lit("on a sanctions list; value is followed past it"), none))
    out = out.when(n >= opt.service_min_txs, _class("SERVICE", volume, "transaction_volume", F.concat(n.cast("string"), F.lit(" transactions, as many as only a business has; no list confirms it")), none))
    parked = F.concat(F.lit("holds "), human_coins(F.col("balance") if "balance" in t.columns else F.col("received")), F.lit(" and has spent nothing"))
    out = out.when((F.col("received") > 0) & (F.col("sent") == 0), _class("DORMANT", F.lit(0.9), "never_spent", parked, none))
    found = out.otherwise(_class("CONTINUE", F.lit(0.0), None, none, none))
    return t.withColumn("_c", found).select(*given, "_c.kind", "_c.confidence", "_c.basis", "_c.detail", "_c.label")


def _class(kind: str, confidence: Column, basis: str | None, detail: Column, label: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), confidence.cast("double").alias("confidence"), F.lit(basis).cast("string").alias("basis"), detail.alias("detail"), label.alias("label"))


def haircut_step(led: Ledger, starts: DataFrame) -> DataFrame:
    """One hop of proportional attribution: (src, dst, observed, forwarded) per transaction output.

    ``starts`` has (address, value): what of each address belongs to the trace.
    """
    t = totals(led).select("address", "received")
    taint = F.least(F.lit(1.0), F.col("v") / F.greatest(F.lit(1), F.when(F.col("received") > 0, F.col("received")).otherwise(F.col("v"))))
    s = starts.select("address", F.col("value").alias("v")).join(t, "address", "left").select("address", taint.alias("taint"))
    spent = led.inp.join(s, "address").groupBy("txid", "address", "taint").agg(F.sum("value").alias("spent")).where("spent > 0")
    total = led.out.groupBy("txid").agg(F.sum("value").alias("total")).where("total > 0")
    o = led.out.select("txid", "o_pos", F.col("address").alias("dst"), F.col("value").alias("ov"))
    observed = round_half_up(F.col("spent") * (F.col("ov") / F.col("total")))
    return (
        spent.join(total, "txid").join(o, "txid").where("dst <> address")
        .select("txid", "o_pos", F.col("address").alias("src"), "dst", observed.alias("observed"), "taint")
        .withColumn("forwarded", round_half_up(F.col("observed") * F.col("taint"))).drop("taint")
    )


def spending(led: Ledger, opt: TraceOptions = TraceOptions()) -> DataFrame:
    """(address, ord, txid, time, height, spent, total, outs, carrier): one row for each transaction an address spends in.

    ``outs`` are the transaction's outputs in order. ``carrier`` is its largest
    output (address, value, rest), if it has the shape of a peel, else null.
    """
    text = lambda d: d.withColumn("txid", F.col("txid").cast("string"))
    outs = text(led.out).groupBy("txid").agg(F.sort_array(F.collect_list(F.struct("o_pos", "address", "value"))).alias("outs"), F.sum("value").alias("total"))
    big = F.array_max(F.transform("outs", lambda o: F.struct(o["value"].alias("value"), (-o["o_pos"]).alias("place"), o["address"].alias("address"))))
    peels = F.size("outs").between(2, opt.max_peel_outputs) & (F.col("total") > 0) & (big["value"] / F.col("total") >= opt.retain) & (F.col("total") > big["value"])
    carrier = F.when(peels, F.struct(big["address"].alias("address"), big["value"].alias("value"), (F.col("total") - big["value"]).alias("rest")))
    spent = text(led.inp).groupBy("address", "txid").agg(F.sum("value").alias("spent"), F.first("ord").alias("ord"))
    when = text(led.txs).select("txid", F.col("ts").alias("time"), "height")
    both = spent.join(when, "txid").join(outs.withColumn("carrier", carrier), "txid", "left")
    return both.select("address", "ord", "txid", "time", "height", "spent", F.coalesce("total", F.lit(0)).alias("total"), "outs", "carrier")


# --------------------------------------------------------------------------- reading addresses
@dataclass
class Step:
    """A transaction that an address spends in."""

    txid: str
    time: int
    height: int | None
    spent: int
    total: int
    outs: list[tuple[str, int]]
    carrier: tuple[str, int, int] | None


@dataclass
class Node:
    """What is known of an address; ``steps`` are its spending transactions, newest first."""

    address: str
    n_tx: int = 0
    received: int = 0
    balance: int = 0
    kind: str = "CONTINUE"
    confidence: float = 0.0
    basis: str | None = None
    detail: str | None = None
    label: str | None = None
    steps: list[Step] = field(default_factory=list)
    truncated: bool = False


class Source(Protocol):
    """Where addresses are read. An address that can't be read has an exception in place of its node, an unknown one while offline None."""

    def read(self, addresses: list[str]) -> dict[str, Node | Exception | None]: ...


class LedgerSource:
    """Addresses of a ledger. An address that the ledger does not know has nothing received and no steps."""

    def __init__(self, led: Ledger, opt: TraceOptions | None = None, labels: DataFrame | None = None, sanctions: DataFrame | None = None):
        self.opt = opt = opt or TraceOptions()
        # in the order of their keys, so that a lookup skips all files and row groups without them
        with Scratch(led.spark()) as scratch:
            stored = lambda d, name: scratch.keep(d.repartitionByRange("address").sortWithinPartitions("address"), name)
            self.nodes = stored(classify(totals(led), labels, sanctions, opt), "nodes")
            self.steps = stored(spending(led, opt), "steps")
            scratch.hold("nodes", "steps")

    def read(self, addresses: list[str]) -> dict[str, Node | Exception | None]:
        known = {r.address: r for r in self.nodes.where(F.col("address").isin(addresses)).collect()}
        found: dict[str, Node | Exception | None] = {
            a: Node(a, r.n_tx, r.received, r.balance, r.kind, r.confidence, r.basis, r.detail, r.label) if (r := known.get(a)) else Node(a) for a in addresses
        }
        limit = self.opt.max_history
        # the rank limit is applied in each task before the shuffle
        newest = W.partitionBy("address").orderBy(F.col("ord").desc())
        some = self.steps.where(F.col("address").isin([a for a in addresses if a in known])).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= limit + 1)
        for r in sorted(some.drop("ord").collect(), key=lambda r: (r.address, r["_r"])):
            node = found[r.address]
            if r["_r"] > limit:
                node.truncated = True
            else:
                node.steps.append(Step(r.txid, r.time, r.height, r.spent, r.total, [(o.address, o.value) for o in r.outs or []], tuple(r.carrier) if r.carrier else None))
        return found


class _Reader:
    """Nodes as they are asked for; others that will be soon are read along."""

    def __init__(self, source: Source, room: int):
        self.source, self.room = source, max(room, 2 * _AT_ONCE)
        self.held: OrderedDict[str, Node | Exception | None] = OrderedDict()

    def ahead(self, addresses: Iterable[str]) -> None:
        new = [a for a in dict.fromkeys(addresses) if a not in self.held][:_AT_ONCE]
        if new:
            self.held.update(self.source.read(new))
        while len(self.held) > self.room:
            self.held.popitem(last=False)

    def get(self, address: str, soon: Iterable[str] = ()) -> Node | Exception | None:
        if address not in self.held:
            self.ahead([address, *soon])
        self.held.move_to_end(address)
        return self.held[address]


# --------------------------------------------------------------------------- the search
@dataclass
class Trace:
    source: str
    ok: bool = True
    start_value: int = 0
    endpoints: list[dict] = field(default_factory=list)
    peel_chains: list[dict] = field(default_factory=list)
    value_by_hop: dict[int, int] = field(default_factory=dict)
    verdict: dict = field(default_factory=dict)
    stats: dict = field(default_factory=dict)
    settings: dict = field(default_factory=dict)


@dataclass(order=True)
class _Lead:
    """An address of the frontier; leads compare by rank."""

    rank: tuple[int, int]
    address: str = field(compare=False)
    hops: int = field(compare=False)
    path: tuple[dict, ...] = field(compare=False)

    @property
    def value(self) -> int:
        return -self.rank[0]


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


class _Search:
    def __init__(self, source: Source, start: Node, opt: TraceOptions):
        self.opt, self.start = opt, start
        self.floor = max(opt.min_value, min(math.floor(start.received * opt.min_fraction), opt.max_floor))
        self.reader = _Reader(source, 2 * opt.budget)
        self.frontier: list[_Lead] = []
        self.serial = 0
        self.charged = {start.address}  # addresses that count as read
        self.pruned, self.pruned_value, self.examined = 0, 0, 0
        self.result = Trace(start.address, start_value=start.received, settings=asdict(opt))

    @property
    def spent_budget(self) -> bool:
        return len(self.charged) > self.opt.budget

    def add(self, address: str, value: int, hops: int, path: tuple[dict, ...]) -> None:
        heapq.heappush(self.frontier, _Lead((-value, self.serial), address, hops, path))
        self.serial += 1

    def leads(self) -> Iterator[_Lead]:
        """Leads in rank order, without those below the floor and those that bring an address no more than before."""
        most: dict[str, int] = {}
        while self.frontier and not self.spent_budget:
            lead = heapq.heappop(self.frontier)
            if lead.value < self.floor:
                self.prune(1, lead.value)
            elif most.get(lead.address, -1) < lead.value:
                most[lead.address] = lead.value
                yield lead

    def prune(self, branches: int, value: int = 0) -> None:
        self.pruned += branches
        self.pruned_value += value

    def end(self, lead: _Lead, kind: str, node: Node | None, **more: object) -> None:
        share = lead.value / self.start.received if node else None
        known = {"n_tx": node.n_tx, "balance_sats": node.balance} if node else {}
        self.result.endpoints.append({"kind": kind, "address": lead.address, "hops": lead.hops, "value_sats": lead.value, "share_of_source": share, "path": list(lead.path), **known, **more})

    def run(self) -> Trace:
        self.add(self.start.address, self.start.received, 0, ())
        by_hop = self.result.value_by_hop
        for lead in self.leads():
            node = self.reader.get(lead.address, (x.address for x in heapq.nsmallest(_AT_ONCE, self.frontier)))
            if not isinstance(node, Node):
                self.end(lead, "ERROR", None, detail=f"could not be read: {node or 'not stored'}")
                continue
            self.charged.add(lead.address)
            self.examined += 1
            by_hop[lead.hops] = by_hop.get(lead.hops, 0) + lead.value
            if self.goes_on(lead, node):
                self.expand(lead, node)
        left = [x.value for x in self.frontier]
        self.result.endpoints.sort(key=lambda e: -e["value_sats"])
        self.result.stats = {
            "examined": self.examined, "fetches": len(self.charged) - 1, "pruned_branches": self.pruned, "pruned_value": self.pruned_value, "value_floor": self.floor,
            "unexplored_branches": len(left), "unexplored_value": sum(left), "budget_exhausted": self.spent_budget,
        }
        self.result.verdict = summarise(self.result.endpoints, self.start.received, len(left), self.opt)
        return self.result

    def goes_on(self, lead: _Lead, node: Node) -> bool:
        """Whether the value is followed past an address; says what stops it. The first address is never an end by its kind."""
        if lead.hops and node.kind != "CONTINUE":
            payer = lead.path[-1]["from"] if node.kind == "SERVICE" else None
            self.end(lead, node.kind, node, confidence=node.confidence, basis=node.basis, detail=node.detail, label=node.label, deposit_candidate=payer)
            if node.kind in STOPS:
                return False
        if lead.hops >= self.opt.max_hops:
            self.end(lead, "HORIZON", node, confidence=0.0, basis="hop_limit", detail=f"{lead.value} still on its way after {lead.hops} hops")
            return False
        if not node.steps and node.truncated:
            self.end(lead, "HORIZON", node, confidence=0.0, basis="history_truncated", detail=f"of {node.n_tx} transactions none that spends was read")
        return bool(node.steps)

    def expand(self, lead: _Lead, node: Node) -> None:
        """Put what an address sends on into the frontier: the largest branches of all its transactions."""
        taint = min(1.0, lead.value / max(1, node.received or lead.value))
        self.read_chains_ahead(node)
        branches = [b for step in node.steps if step.spent > 0 and step.total > 0 for b in self.branches(node.address, step, taint)]
        branches.sort(key=lambda e: -e["value_sats"])
        for edge in branches[: self.opt.max_branches]:
            self.add(edge["to"], edge["value_sats"], lead.hops + 1, (*lead.path, edge))
        self.prune(max(0, len(branches) - self.opt.max_branches))

    def branches(self, address: str, step: Step, taint: float) -> Iterator[dict]:
        """The edges of one transaction: a whole peel chain as one, else one for each output that is not too small."""
        base = {"txid": step.txid, "time": step.time, "block_height": step.height, "from": address, "taint_ratio": round(taint, 6)}
        chain = self.chain(address, step)
        if len(chain) >= 3:
            end, carried, _ = chain[-1]
            peeled = sum(rest for _, _, rest in chain)
            self.result.peel_chains.append({"started_at": step.txid, "length": len(chain), "ended_at": end, "peeled_sats": peeled, "links": chain[:20]})
            observed = min(step.spent, carried)
            yield {**base, "to": end, "value_sats": _half_up(observed * taint), "observed_sats": observed, "via": "peel_chain", "peel_length": len(chain), "peeled_sats": peeled}
            return
        for to, value in step.outs:
            if to and to != address:
                observed = _half_up(step.spent * (value / step.total))
                followed = _half_up(observed * taint)
                if followed < self.floor:
                    self.prune(1, followed)
                else:
                    yield {**base, "to": to, "value_sats": followed, "observed_sats": observed, "via": "transfer", "peel_length": None, "peeled_sats": None}

    def chain(self, address: str, step: Step | None) -> list[tuple[str, int, int]]:
        """The links (carrier, value, rest) of the peel chain that a transaction begins, as far as the budget lets it be read."""
        links: list[tuple[str, int, int]] = []
        while step and step.carrier and (links or step.carrier[0] != address) and len(links) < self.opt.max_peel_length:
            links.append(step.carrier)
            carrier = step.carrier[0]
            if self.spent_budget_for(carrier, len(links)):
                break
            node = self.reader.get(carrier)
            if isinstance(node, Node):
                self.charged.add(carrier)
            ends = not isinstance(node, Node) or node.kind != "CONTINUE"
            step = None if ends else next((s for s in node.steps if s.txid != step.txid), None)
        return links

    def spent_budget_for(self, carrier: str, links: int) -> bool:
        used_up = len(self.charged) > self.opt.budget
        return used_up and (links >= 2 or carrier not in self.charged)

    def read_chains_ahead(self, node: Node, waves: int = 6) -> None:
        """Read the carriers that the chains of an address go through next, a wave for all of them at once."""
        steps = node.steps
        for _ in range(waves):
            carriers = {s.carrier[0]: s.txid for s in steps if s.carrier and s.carrier[0] != node.address}
            if not any(a not in self.reader.held for a in carriers):
                return
            self.reader.ahead(carriers)
            held = [(self.reader.held.get(a), t) for a, t in carriers.items()]
            steps = [s for n, t in held if isinstance(n, Node) and n.kind == "CONTINUE" for s in [next((x for x in n.steps if x.txid != t), None)] if s]


def trace(led: Ledger | None, source: str, opt: TraceOptions | None = None, labels: DataFrame | None = None, sanctions: DataFrame | None = None, reader: Source | None = None) -> Trace:
    """Endpoints, peel chains, value by hop, verdict and counters of the search from one address.

    Reads from ``reader`` if given (to trace several addresses over one stored
    ledger, or from elsewhere), else from the ledger. ``labels`` and
    ``sanctions`` are those of ``classify``. ``budget`` counts the distinct
    addresses read besides the source. A source that is not stored anywhere
    gives ``ok`` false; one that never received anything has no endpoints.
    """
    opt = opt or TraceOptions()
    reader = reader or LedgerSource(led, opt, labels, sanctions)
    node = reader.read([source])[source]
    if not isinstance(node, Node):
        return Trace(source, ok=False, verdict=_said("offline", reason=str(node or "it is not stored")), settings=asdict(opt))
    if not node.received:
        return Trace(source, verdict=_said("empty"), settings=asdict(opt), stats={"examined": 0, "fetches": 0})
    return _Search(reader, node, opt).run()


# --------------------------------------------------------------------------- verdict
# what is said of a trace, by what decides it: headline, detail, next step, whether something can be done now
_SAID = {
    "offline": ("The address can't be read: {reason}.", None, None, False),
    "empty": ("Nothing was ever received here.", None, None, False),
    "none": ("No end was found.", "No branch stopped anywhere known within {hops} hops and {budget} addresses.", "Trace again with more hops and a larger budget.", False),
    "SERVICE": ("{share} of the value arrived at services.", "The largest part, {top}, came to {address} after {top_hops} hops{paid}.", "Ask that service about the receiving account, with the transactions of the path.", True),
    "MIXER": ("{share} of the value went into mixers.", "What comes out of a mixer can't be told apart.", "Follow the other branches, or look for like amounts soon afterwards.", False),
    "DORMANT": ("{share} of the value has not moved on.", "It lies on {n} addresses that have spent nothing.", "Watch these addresses.", True),
    "HORIZON": ("{share} of the value was still moving.", "The search ended after {hops} hops with {left} branches to go.", "Trace again with more hops and a larger budget.", False),
    "other": ("{n} ends were found, none of them a service.", None, None, False),
}
_DORMANT_SHARE = 0.3


def _said(what: str, **facts: object) -> dict:
    headline, detail, step, actionable = _SAID[what]
    return {"outcome": what, "headline": headline.format(**facts), "detail": detail and detail.format(**facts), "next_step": step, "actionable": actionable}


def summarise(endpoints: list[dict], start: int, unexplored: int, opt: TraceOptions) -> dict:
    """What was found and how much of the value it accounts for: services, mixers, unspent, unfinished, others."""
    sums: dict[str, int] = {}
    for e in endpoints:
        sums[e["kind"]] = sums.get(e["kind"], 0) + e["value_sats"]
    decides = next((k for k in ("SERVICE", "MIXER", "DORMANT", "HORIZON") if k in sums and (k != "DORMANT" or sums[k] > start * _DORMANT_SHARE)), "other" if endpoints else "none")
    own = [e for e in endpoints if e["kind"] == decides] or endpoints
    share = f"{sums.get(decides, 0) / start:.1%}"
    top = own[0] if own else {"value_sats": 0, "address": "", "hops": 0}
    payer = top.get("deposit_candidate")
    paid = f", paid by {payer}" if payer else ""
    out = _said(decides, share=share, hops=opt.max_hops, budget=opt.budget, left=unexplored, n=len(own), top=top["value_sats"], address=top["address"], top_hops=top["hops"], paid=paid)
    return out | ({"accounts_for": share} if decides == "SERVICE" else {})


# --------------------------------------------------------------------------- results as tables
_EDGE = "txid string, time long, block_height long, `from` string, taint_ratio double, `to` string, value_sats long, observed_sats long, via string, peel_length int, peeled_sats long"
ENDPOINT_SCHEMA = (
    "kind string, address string, hops int, value_sats long, share_of_source double, confidence double, basis string, detail string, label string, n_tx long, balance_sats long, deposit_candidate string, path array<struct<"
    + ", ".join(f"{c.rsplit(' ', 1)[0]}: {c.rsplit(' ', 1)[1]}" for c in _EDGE.split(", "))
    + ">>"
)


def endpoint_rows(spark: SparkSession, t: Trace) -> DataFrame:
    return spark.createDataFrame(t.endpoints, ENDPOINT_SCHEMA)


def hop_rows(spark: SparkSession, t: Trace) -> DataFrame:
    return spark.createDataFrame(sorted(t.value_by_hop.items()), "hop int, value_sats long")


def path_text(path: Column) -> Column:
    """One line per edge of a path."""
    return F.array_join(
        F.transform(path, lambda e, i: F.format_string("%2d. %d  %s -> %s%s", i + 1, e["value_sats"], e["from"], e["to"], F.when(e["via"] == "peel_chain", F.format_string(" (peel chain, %d links)", e["peel_length"])).otherwise(""))), "\n"
    )
