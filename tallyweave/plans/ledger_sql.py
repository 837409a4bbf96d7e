"""SQL twins of the ledger queries, over the mapping of orders to transactions."""

from __future__ import annotations

from tallyweave.operators.behavior import FEATURES as FEATURES_19

BASE = """
nc as (select count(*) n from customer),
txs as (select o_orderkey txid, date_diff('day', date '1970-01-01', cast(o_orderdate as date)) height,
  date_diff('day', date '1970-01-01', cast(o_orderdate as date)) * 86400 + o_orderkey % 86400 ts, o_custkey, cast(round(o_totalprice * 100) as bigint) v from orders),
inp as (select txid, height, ts, 0 i_pos, 'c' || o_custkey address, v value_ from txs),
outp as (select t.txid, t.height, t.ts, row_number() over (partition by t.txid order by l_linenumber, l_partkey, l_suppkey) o_pos,
  case when l_linenumber % 4 = 1 then 's' || l_suppkey else 'c' || ((l_partkey * 31 + l_suppkey * 17 + l_linenumber) % n) end address,
  case when l_discount >= 0.05 then cast(round(l_extendedprice * 100) as bigint) // 50 else cast(round(l_extendedprice * 100) as bigint) end value_
  from lineitem join txs t on l_orderkey = t.txid, nc where l_tax < 0.04),
ext as (select o.* from outp o where not exists (select 1 from inp i where i.txid = o.txid and i.address = o.address)),
first_ as (select address, min(ts) first_seen from (select address, ts from inp union all select address, ts from outp) group by 1)
"""
FEATURES = """,
rec as (select address, count(*) n_tx_in, sum(value_)::bigint received, max(value_) largest, max(ts) last_in from ext group by 1),
snd as (select address, count(*) n_tx_out, sum(value_)::bigint sent, max(ts) last_out from inp group by 1),
per_tx as (select txid, count(*) w, count(*) filter (first_seen >= ts) w_new from ext join first_ using (address) group by 1),
paid as (select address, max(w) split, sum(w)::bigint total, sum(w_new)::bigint new_ from inp join per_tx using (txid) group by 1),
pairs as (select distinct i.address src, o.address dst from inp i join ext o using (txid)),
ind as (select dst address, count(*) in_degree from pairs group by 1), outd as (select src address, count(*) out_degree from pairs group by 1),
ev as (select address, ts, height, txid, ts got from ext union all select address, ts, height, txid, null from inp),
asof_ as (select address, got, ts - last_value(got ignore nulls) over (partition by address order by ts, height, txid rows between unbounded preceding and 1 preceding) gap from ev),
turn as (select address, min(gap) fastest from asof_ where got is null and gap >= 0 group by 1),
acc as (select address, first_seen, greatest(last_in, last_out) last_seen, coalesce(n_tx_in, 0) n_tx_in, coalesce(n_tx_out, 0) n_tx_out, coalesce(received, 0) received,
  coalesce(sent, 0) sent, coalesce(largest, 0) largest, coalesce(split, 0) split, coalesce(total, 0) total, coalesce(new_, 0) new_, coalesce(in_degree, 0) in_degree,
  coalesce(out_degree, 0) out_degree, fastest
  from rec full join snd using (address) left join first_ using (address) left join paid using (address) left join ind using (address) left join outd using (address) left join turn using (address)),
shape0 as (select txid, ts, height, count(*) n_out, sum(value_)::bigint total, max(value_) biggest, arg_max(address, struct_pack(v := value_, p := -o_pos)) carrier from outp group by 1, 2, 3),
liked as (select * from shape0 where n_out in (2, 3) and total > 0 and biggest / total >= 0.85), shaped as (select * from liked where total > biggest),
spent as (select address, arg_min(txid, struct_pack(a := ts, b := height, c := txid)) txid from inp group by 1),
succ as (select s.txid, s.carrier, case when p.txid <> s.txid then n.txid end next_ from shaped s left join spent p on p.address = s.carrier left join shaped n on n.txid = p.txid)
"""
# chains: with no walk cut off, a start is a transaction that no earlier start's walk goes through
PEEL = """,
walk(start_, txid, n) as (select txid, txid, 1 from succ union all select w.start_, s.next_, n + 1 from walk w join succ s on s.txid = w.txid where s.next_ is not null and n < 500),
path as (select start_, txid, min(n) n from walk group by 1, 2), len_ as (select start_, count(*) len from path group by 1),
long_ as (select p.*, len, struct_pack(a := t.ts, b := t.height, c := t.txid) o from path p join len_ using (start_) join txs t on t.txid = p.start_ where len >= 3),
starts as (select start_ from (select distinct start_, o from long_) s where not exists (select 1 from long_ l where l.txid = s.start_ and l.start_ <> s.start_ and l.o < s.o)),
member as (select carrier address, arg_max(struct_pack(len := len, n := n), struct_pack(o := o, n := n)) m from long_ join starts using (start_) join succ using (txid) group by 1),
pc as (select i.address, max(m.len) len, count(l.txid) likes from inp i join member using (address) left join liked l on l.txid = i.txid group by 1)
"""
# without chains the two peel columns are 0
FEAT = """,
m as (select *, greatest(0, last_seen - first_seen) life, coalesce(fastest, greatest(0, last_seen - first_seen)) hold, n_tx_in + n_tx_out n from acc where n_tx_in + n_tx_out >= 2),
feat as (select address, first_seen, last_seen, hold::double avg_holding_time, split::double number_of_splits, case when total > 0 then new_ / total else 0 end percentage_sent_to_new_addresses,
  case when life > 0 then n / (life / 3600.0::double) else n end transaction_frequency, n_tx_in::double n_tx_in, n_tx_out::double n_tx_out, in_degree::double in_degree, out_degree::double out_degree,
  received / 1e8 received_btc, sent / 1e8 sent_btc, (received - sent) / 1e8 balance_btc, case when received > 0 then least(1.0, sent / received) else 0 end forward_ratio,
  life::double lifetime_seconds, 0.0::double peel_like_spends, 0.0::double peel_chain_length, largest / 1e8 largest_received_btc,
  case when split >= 4 and hold <= 600 and received > 0 then least(1.0, split / 10 * (1 - hold / 600)) else 0 end layering_score,
  case when in_degree >= 8 and out_degree <= 2 and received > 0 then least(1.0, in_degree / 40) else 0 end collector_score, 0.0::double peel_score from m)
"""
FULL = FEAT.replace("0.0::double peel_like_spends, 0.0::double peel_chain_length", "coalesce(likes, 0)::double peel_like_spends, coalesce(len, 0)::double peel_chain_length").replace(
    "0.0::double peel_score from m", "case when len >= 3 then least(1.0, len / 10) else 0 end::double peel_score from m left join pc using (address)"
)
GRAPH = """,
total_in as (select txid, sum(value_) t from inp group by 1 having sum(value_) > 0),
edge as (select i.address src, o.address dst, sum(floor(o.value_ * (i.value_ / t) + 0.5))::bigint value_sats, count(*) n_txs, arg_min(o.ts, struct_pack(a := o.height, b := o.ts, c := o.txid)) first_time
  from inp i join total_in using (txid) join ext o using (txid) where i.address <> o.address and i.address in (select address from feat) and o.address in (select address from feat) group by 1, 2),
adj as (select src address, dst other, value_sats, n_txs, 'out' dir from edge union all select dst, src, value_sats, n_txs, 'in' from edge)
"""
# the window documents: one row of each address and window, what is no number is 0
WINDOWS = "once as (select * from address_features where address is not null qualify row_number() over (partition by window_start, address order by row_id) = 1), feat as (select window_start || ':' || address address, address own, first_seen, last_seen, " + ", ".join(
    f"coalesce(case when isfinite({c}) then {c} end, 0) {c}" for c in FEATURES_19
) + " from once)"
# cohorts by the cell of the logarithms; cells of fewer than five are noise
SCORE = """,
score as (select *, layering_score * 0.5 + collector_score * 0.5 score from feat)
"""
MODEL = SCORE + """,
cell as (select address, ((floor(ln(1 + greatest(avg_holding_time, 0)))::int * 100 + floor(ln(1 + greatest(number_of_splits, 0)))::int) * 100 + floor(ln(1 + greatest(percentage_sent_to_new_addresses, 0)))::int) * 100 + floor(ln(1 + greatest(transaction_frequency, 0)))::int cluster from feat),
cl as (select address, case when count(*) over (partition by cluster) < 5 then -1 else cluster end cluster from cell),
risk0 as (select cluster, count(*) size, median(layering_score) l, median(collector_score) c, median(peel_score) p, median(forward_ratio) f, median(avg_holding_time) h from feat join cl using (address) group by 1),
risk as (select cluster::int cluster, size, cluster = -1 is_noise, round(least(1.0, 0.30 * l + 0.30 * c + 0.20 * p + 0.15 * f + case when h < 600 then 0.05 else 0 end::double), 4) risk, round(l, 4) median_layering, round(c, 4) median_collector,
  round(p, 4) median_peel, round(f, 4) median_forward_ratio, round(h, 1) median_holding_seconds from risk0),
conf as (select feat.address, max(kind) kind from (select address a, 'ransomware' kind from label_ransomware union all select address, 'sanctioned' from label_sanctions) join feat on a = own group by 1),
weak as (select f.address, case when kind is not null then 'confirmed_' || kind
  when (layering_score > 0.25 or collector_score > 0.25 or (peel_score > 0.6 and forward_ratio > 0.9)) and received_btc > 0.001 then 'behavioural_pattern'
  when r.cluster is not null then 'hdbscan_cluster'
  when layering_score = 0 and collector_score = 0 and peel_score < 0.2 and forward_ratio < 0.8 and avg_holding_time > 3600 then 'quiet_behaviour' else 'unlabelled' end source
  from feat f join cl using (address) left join (select cluster from risk where risk >= 0.35 and not is_noise and size >= 5) r using (cluster) left join conf using (address)),
lab as (select w.address, case when source like 'confirmed%' or source in ('behavioural_pattern', 'hdbscan_cluster') then 1 else 0 end y, source, collector_score * 0.5 + layering_score * 0.5 + forward_ratio * 0.3 score
  from weak w join feat using (address)),
cf as (select count(*) filter (y = 1 and score >= 0.5) tp, count(*) filter (y = 0 and score >= 0.5) fp, count(*) filter (y = 1 and score < 0.5) fn, count(*) filter (y = 0 and score < 0.5) tn from lab),
rk as (select y, row_number() over (order by score desc, address) r, sum(y) over (order by score desc, address rows unbounded preceding) tp from lab)
"""
BASE_TX = """
kept as (select * from tx qualify nullif(lower(trim(txid)), '') is null or row_number() over (partition by nullif(lower(trim(txid)), '') order by delivery_id) = 1),
named as (select txid, block_height height, coalesce(time, 0) t0, max(time) over (partition by block_height) bt, list_filter(coalesce(inputs, []), lambda e: e.address <> '') i, list_filter(coalesce(outputs, []), lambda e: e.address <> '') o
  from kept where block_height is not null and txid is not null),
txs as (select *, case when t0 <> 0 then t0 else bt end ts from named where len(i) > 0 or len(o) > 0),
inp as (select txid, height, ts, unnest(range(len(i))) i_pos, unnest(i).address address, coalesce(unnest(i).value_sats, 0) value_ from txs),
outp as (select txid, height, ts, unnest(range(len(o))) o_pos, unnest(o).address address, coalesce(unnest(o).value_sats, 0) value_ from txs),
"""


def q(select: str, upto: str = "base", tx: bool = False) -> str:
    base = BASE_TX + BASE[BASE.index("ext as ("):] if tx else BASE
    steps = {"base": "", "features": FEATURES, "peel": FEATURES + PEEL, "rows": FEATURES + FEAT + GRAPH + SCORE, "full": FEATURES + PEEL + FULL + GRAPH}
    return "with recursive " + base + steps[upto] + select


def w(select: str) -> str:
    """Over the window documents."""
    return "with " + WINDOWS + MODEL + select



_PR = "case when tp + fp > 0 then tp / (tp + fp) else 0 end"
_RC = "case when tp + fn > 0 then tp / (tp + fn) else 0 end"
_TAGS = """array_to_string(list_filter([case when layering_score > 0.1 then 'layering' end, case when collector_score > 0.1 then 'fan-in' end, case when peel_chain_length >= 3 then 'peel x' || floor(peel_chain_length + 0.5)::bigint end,
  case when forward_ratio > 0.95 then 'pass-through' end], lambda x: x is not null), ',')"""
_KIND = """case when regexp_matches(a, '^1[1-9A-HJ-NP-Za-km-z]{25,34}$') then 'p2pkh' when regexp_matches(a, '^3[1-9A-HJ-NP-Za-km-z]{25,34}$') then 'p2sh'
  when regexp_matches(a, '^bc1q[02-9ac-hj-np-z]{38,58}$') then 'bech32' when regexp_matches(a, '^bc1p[02-9ac-hj-np-z]{58}$') then 'taproot'
  when regexp_matches(a, '^([mn2][1-9A-HJ-NP-Za-km-z]{25,34}|tb1[02-9ac-hj-np-z]{38,58})$') then 'testnet' end"""

_DIMS = range(1, 65)
_DISTANCE = "sqrt(" + " + ".join(f"(e[{i}]::double - c{i}) * (e[{i}]::double - c{i})" for i in _DIMS) + ")"
_CENTROIDS = f"""d as (select vec_id, embedding e, label from embeddings), n as (select label, {", ".join(f"avg(e[{i}]::double) c{i}" for i in _DIMS)} from d group by 1),
      r as (select label, quantile_cont({_DISTANCE}, 0.9) radius from d join n using (label) group by 1)"""

SQL: dict[str, str] = {
    "tx_normalised": """select delivery_id, txid, coalesce(i, 0)::bigint total_in, coalesce(o, 0)::bigint total_out, ni = 0 is_coinbase,
      (case when ni = 0 then 0 else greatest(0, coalesce(i, 0) - coalesce(o, 0)) end)::bigint fee from (
      select delivery_id, txid, list_sum(list_transform(coalesce(inputs, []), lambda e: e.value_sats)) i, list_sum(list_transform(coalesce(outputs, []), lambda e: e.value_sats)) o,
      len(list_filter(coalesce(inputs, []), lambda e: e.address is not null)) ni from tx where txid is not null and provenance is not null)""",
    "address_flow": q("select address, received, sent, received - sent balance, case when received > 0 then least(1.0, sent / received) else 0 end forward_ratio from acc", "features"),
    "first_last_seen": q("select address, first_seen, last_seen from acc", "features"),
    "change_outputs": q("select txid, address, value_ as value from outp o where exists (select 1 from inp i where i.txid = o.txid and i.address = o.address)"),
    "degrees": q("select address, in_degree, out_degree from acc where in_degree + out_degree > 0", "features"),
    "split_width": q("select address, split max_split_width from paid", "features"),
    "paid_to_new": q("select address, total paid_to_total, new_ paid_to_new from paid", "features"),
    "turnaround": q("select address, fastest fastest_turnaround from turn", "features"),
    "address_features_base": q("select * from feat", "rows"),
    "address_features": q("select * from feat", "full"),
    "ledger_features": q("select * from feat", "full", tx=True),
    "peel_members": q("select address, m.len::int chain_length, m.n::int as position from member", "peel"),
    "layering_hits": q("select address, layering_score from feat where layering_score > 0", "rows"),
    "collector_hits": q("select address, collector_score from feat where collector_score > 0", "rows"),
    "pattern_counts": q("""select count(*) filter (layering_score > 0) layering, count(*) filter (collector_score > 0) collector, count(*) filter (peel_score > 0.5 and n_tx_out >= 2) peeling,
      count(*) filter (forward_ratio > 0.95 and received_btc > 0.01) pass_through from feat""", "full"),
    "window_stats": q("""select (select count(*) from txs) transactions, (select min(ts) from txs) window_start, (select max(ts) from txs) window_end, (select count(distinct height) from txs) blocks,
      (select count(*) from first_) distinct_addresses, (select count(*) from feat) addresses_with_min_activity""", "rows"),
    "edges": q("select * from edge", "rows"),
    "adjacency": q("select * from adj", "rows"),
    "top_edges": q("select address, dir, pos, other, value_sats, n_txs from (select *, row_number() over (partition by address, dir order by value_sats desc, other) pos from adj) where pos <= 30", "rows"),
    "exit_points": q("""select address, exit_kind, received_btc, in_degree, out_degree from (select *, case when in_degree >= 40 and out_degree >= 40 then 'service'
      when received_btc > 0.01 and n_tx_out = 0 then 'dormant' end exit_kind from feat) where exit_kind is not null""", "rows"),
    "peel_shaped_tx": q("select txid, n_out, total, biggest, carrier from shaped", "features"),
    "spent_by": q("select * from spent", "features"),
    "peel_successor": q('select txid, carrier, next_ "next" from succ', "features"),
    "peel_walk_length": q(""", walk(txid, pos_, n) as (select txid, txid, 1 from succ union all select w.txid, s.next_, n + 1 from walk w join succ s on s.txid = w.pos_ where s.next_ is not null and n < 500)
      select txid, max(n)::int walk_length from walk group by 1""", "features"),
    "ego_2hop": q(""", s as (select min(address) a from feat),
      h1 as (select other, max(value_sats) v from adj, s where address = a and other <> a group by 1 qualify row_number() over (order by v desc, other) <= 499),
      h2 as (select other, max(value_sats) v from adj where address in (select other from h1) and other not in (select other from h1) and other <> (select a from s) group by 1
        qualify row_number() over (order by v desc, other) <= 499 - (select count(*) from h1))
      select a address, 0 hops from s union all select other, 1 from h1 union all select other, 2 from h2""", "rows"),
    "induced_edges": q("select * from edge where src in (select address from feat where n_tx_in >= 20) and dst in (select address from feat where n_tx_in >= 20)", "rows"),
    "scaled_features": q(", ln_ as (select address, " + ", ".join(f"ln(1 + greatest({c}, 0)) {c}" for c in ("avg_holding_time", "number_of_splits", "percentage_sent_to_new_addresses", "transaction_frequency"))
      + " from feat) select address, " + ", ".join(f"round(({c} - avg({c}) over ()) / coalesce(nullif(stddev_pop({c}) over (), 0), 1), 6) {c}" for c in ("avg_holding_time", "number_of_splits", "percentage_sent_to_new_addresses", "transaction_frequency")) + " from ln_", "rows"),
    "cluster_risk": w("select * from risk"),
    "cluster_medians": w("select cluster::int cluster, count(*) size, cluster = -1 is_noise, median(avg_holding_time) avg_holding_time, median(number_of_splits) number_of_splits, median(percentage_sent_to_new_addresses) percentage_sent_to_new_addresses, median(transaction_frequency) transaction_frequency from feat join cl using (address) group by cluster"),
    "clusters_list": w("select cluster, size, risk from risk where not is_noise and size >= 3 order by risk desc, size desc, cluster limit 50"),
    "weak_labels": w("select address, y, source from lab"),
    "label_sources": w("select source, count(*) n from lab group by 1"),
    "fallback_score": w("select address, score from score"),
    "top_ranked": w("select row_number() over (order by score desc, address)::int rank, address, score from score qualify rank <= 25"),
    "tags": w(f"select address, {_TAGS} tags from feat"),
    "confusion": w("select * from cf"),
    "prf": w(f"select *, round_even(p, 4) as precision, round_even(r, 4) recall, round_even(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) f1 from (select *, {_PR} p, {_RC} r from cf)".replace("select *, round_even(p", "select tp, fp, fn, tn, round_even(p")),
    "youden_j": w(f"select round_even({_RC} - case when fp + tn > 0 then fp / (fp + tn) else 0 end, 4) youden_j from cf"),
    "average_precision": w("select round_even(coalesce(sum(case when y = 1 then tp / r end) / nullif(sum(y), 0), 0), 4) average_precision from rk"),
    "precision_at_k": w("select asked, count(*) k, round_even(sum(y) / count(*), 4) as precision, sum(y)::bigint hits from rk, (select unnest([10, 20, 50, 100]) asked) where r <= asked group by 1"),
    "youden_threshold": w(""", cand as (select round(0.05 + i / 100.0::double, 3) t from range(91) x(i)),
      c as (select t, count(*) filter (y = 1 and score >= t) tp, count(*) filter (y = 0 and score >= t) fp, count(*) filter (y = 1) p, count(*) filter (y = 0) n from cand, lab group by 1),
      f as (select t, round_even(tp / p - fp / n, 4) s from c)
      select arg_max(t, struct_pack(a := s, b := -t)) threshold, max(s) score from f"""),
    "cohort_counts": w("select count(distinct cluster) filter (cluster <> -1) n_clusters, count(*) filter (cluster = -1) n_noise from cl"),
    "address_counterparties": q("""select address, dir, pos, other, value_sats, exit_kind from (select *, row_number() over (partition by address, dir order by value_sats desc, other) pos from adj) x
      left join (select address other, case when in_degree >= 40 and out_degree >= 40 then 'service' when received_btc > 0.01 and n_tx_out = 0 then 'dormant' end exit_kind from feat) using (other) where pos <= 30""", "rows"),
    "api_graph_edges": q(""", s as (select min(address) a from feat),
      h as (select a address from s union select other from (select other, max(value_sats) v from adj, s where address = a and other <> a group by 1 qualify row_number() over (order by v desc, other) <= 499))
      select src, dst, value_sats, n_txs from edge where src in (select address from h) and dst in (select address from h)""", "rows"),
    "best_threshold": w(""", cand as (select round(0.05 + i / 100.0::double, 3) t from range(91) x(i)),
      c as (select t, count(*) filter (y = 1 and score >= t) tp, count(*) filter (y = 0 and score >= t) fp, count(*) filter (y = 1 and score < t) fn from cand, lab group by 1),
      f as (select t, round_even(case when tp > 0 then 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) else 0 end, 4) s from c)
      select arg_max(t, struct_pack(a := s, b := -t)) threshold, max(s) score from f"""),
    "nearest_centroid": f"""with {_CENTROIDS} select label, {", ".join(f"round(c{i}, 6) c{i}" for i in _DIMS)}, round(greatest(radius, 1e-6), 6) radius from n join r using (label)""",
    "address_kind": f"select a address, {_KIND} kind from (select distinct address a from address_features where address is not null)",
    "human_amount": """select distinct v, case when v = 0 then '0' when abs(v) < 1000 then v || ' sats' when abs(v) >= 100000000000 then printf('%.0f BTC', v / 1e8) when abs(v) >= 100000000 then printf('%.3f BTC', v / 1e8)
      when abs(v) >= 100000 then printf('%.5f BTC', v / 1e8) else printf('%.8f BTC', v / 1e8) end shown from (select unnest([0, 5, 999, 1000, 99999, 100000, 123456, 100000000, 123456789, 100000000000]) v)""",
    "format_amount": "select v, (case when v < 0 then '-' else '' end) || (abs(v) // 100000000) || '.' || substr(lpad((abs(v) % 100000000)::varchar, 8, '0'), 1, 4) shown from (select distinct value_sats v from edges where value_sats is not null)",
    "classify_address": q(""", rows_ as (select address, txid, value_ r, 0 s from outp union all select address, txid, 0, value_ from inp),
      t as (select address, count(distinct txid) n, sum(r) r, sum(s) s from rows_ group by 1)
      select address, case when n >= 60 then 'SERVICE' when r > 0 and s = 0 then 'DORMANT' else 'CONTINUE' end kind,
      case when n >= 60 then least(0.9, 0.55 + log10(n / 60.0::double) * 0.2) when r > 0 and s = 0 then 0.9 else 0.0 end::double confidence,
      case when n >= 60 then 'transaction_volume' when r > 0 and s = 0 then 'never_spent' end basis from t"""),
    "value_floor": q("select address, greatest(100000, least(floor(received * 0.0002), 2000000))::bigint floor_sats from acc where received > 0", "features"),
    "haircut_step": q(""", rt as (select address, sum(value_) r from outp group by 1), st as (select address, first_value v from (select address, max(value_) first_value from ext group by 1)),
      tt as (select address, least(1.0, v / greatest(1, case when r > 0 then r else v end))::double taint from st left join rt using (address)),
      sp as (select txid, address, taint, sum(value_) spent from inp join tt using (address) group by 1, 2, 3), tot as (select txid, sum(value_) total from outp group by 1)
      select o.txid, sp.address src, o.address dst, floor(spent * (value_ / total) + 0.5)::bigint observed, floor(floor(spent * (value_ / total) + 0.5) * taint + 0.5)::bigint forwarded
      from sp join tot using (txid) join outp o using (txid) where o.address <> sp.address and total > 0"""),
    "ransom_families": "select family, count(*) n_addresses, sum(n_payments)::bigint n_payments from (select coalesce(nullif(family, ''), 'Unlabeled') family, coalesce(n_payments, 0) n_payments from label_ransomware) group by 1",
    "confirmed_labels": "select address, max(kind) kind from (select address, 'ransomware' kind from label_ransomware union all select address, 'sanctioned' from label_sanctions) where address is not null group by 1",
    "ransom_wallets": "select address, n_payments from label_ransomware where n_payments >= 3 and family is not null and family <> 'Unlabeled' order by n_payments desc, address, family limit 20",
    "block_window": "select count(*) n_rows, min(block_height) first_height, max(block_height) last_height, count(distinct block_height) n_blocks from tx, (select max(block_height) h from tx) where block_height between greatest(0, h - 287) and h",
    "address_history": """with t as (select delivery_id, txid, unnest(list_distinct(list_filter(list_transform(list_concat(coalesce(inputs, []), coalesce(outputs, [])), lambda e: e.address), lambda a: a <> ''))) address from tx where txid is not null)
      select address, count(distinct txid) n_tx from t group by 1""",
    "evaluation": w(f"""select (select count(*) from lab) n, (select sum(y) from lab)::bigint n_positive, (select round_even(avg(y), 4) from lab) base_rate, tp,
      round_even(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 4) f1, round_even(r - case when fp + tn > 0 then fp / (fp + tn) else 0 end, 4) youden_j,
      (select round_even(coalesce(sum(case when y = 1 then tp / r end) / nullif(sum(y), 0), 0), 4) from rk) average_precision,
      (select round_even(avg(y), 4) from rk where r <= 10) precision_at_10, (select round_even(avg(y), 4) from rk where r <= 100) precision_at_100, round_even((tp + tn) / (tp + fp + fn + tn), 4) labelled_accuracy
      from (select *, {_PR} p, {_RC} r from cf)"""),
    "api_overview": q("""select (select count(*) from txs) transactions, (select min(ts) from txs) window_start, (select max(ts) from txs) window_end,
      (select count(distinct height) from txs) blocks, (select count(*) from first_) distinct_addresses, (select count(*) from feat) addresses_with_min_activity,
      count(*) filter (layering_score > 0) layering, count(*) filter (collector_score > 0) collector, count(*) filter (peel_score > 0.5 and n_tx_out >= 2) peeling,
      count(*) filter (forward_ratio > 0.95 and received_btc > 0.01) pass_through, (select count(*) from edge) edges,
      round((select max(height) - min(height) from txs) * 86400 / 3600.0::double, 1) as hours from feat""", "full"),
    "api_ranking": w(f"""select rank, address, score, {_TAGS} tags, received_btc, in_degree, out_degree from (select *, row_number() over (order by score desc, address)::int rank from score)
      where rank <= 25 and received_btc >= 0.05 and collector_score > 0.1"""),
    "api_address": w("""select f.address, case when in_degree >= 40 and out_degree >= 40 then 'service' when received_btc > 0.01 and n_tx_out = 0 then 'dormant' end exit_kind, rank, case when rank is not null then t.score end score,
      cl.cluster::int cluster, risk from feat f join cl using (address) join risk on risk.cluster = cl.cluster
      left join (select address, score, row_number() over (order by score desc, address)::int rank from score qualify rank <= 25) t using (address)"""),
    "api_graph_nodes": q(""", s as (select min(address) a from feat),
      h as (select a address, 0 hops from s union all select other, 1 from (select other, max(value_sats) v from adj, s where address = a and other <> a group by 1 qualify row_number() over (order by v desc, other) <= 499))
      select address, hops, hops = 0 is_seed, case when in_degree >= 40 and out_degree >= 40 then 'service' when received_btc > 0.01 and n_tx_out = 0 then 'dormant' end exit_kind, coalesce(t.score, 0.0)::double score,
      received_btc, balance_btc, in_degree, out_degree from h join feat using (address) left join (select address, score from score qualify row_number() over (order by score desc, address) <= 25) t using (address)""", "rows"),
    "high_risk_cohorts": w("select cluster, size, risk from risk where not is_noise and size >= 5 order by risk desc, cluster limit 6"),
    "report_tags": w("select address, " + _TAGS.replace("case when peel_chain_length >= 3 then 'peel x' || floor(peel_chain_length + 0.5)::bigint end", "case when peel_score > 0.5 then 'peeling' end") + " tags from feat"),
    "tx_parties": """with e as (select delivery_id, unnest(inputs).address address, 0::bigint r, unnest(inputs).value_sats s from tx union all select delivery_id, unnest(outputs).address, unnest(outputs).value_sats, 0 from tx)
      select delivery_id, address, sum(coalesce(r, 0))::bigint received, sum(coalesce(s, 0))::bigint spent from e where address <> '' group by 1, 2""",
    "nearest_assignment": f"""with {_CENTROIDS}, x as (select vec_id, n.label, {_DISTANCE} dist from d cross join n),
      b as (select vec_id, arg_min(label, struct_pack(a := dist, b := label)) label, min(dist) dist from x group by 1)
      select case when dist <= greatest(radius, 1e-6) then b.label else -1 end::int cluster, count(*) n from b join r using (label) group by 1""",
}
