"""Lists of known addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.money import is_real_address

CANDIDATE = r"\b((?:1|3)[1-9A-HJ-NP-Za-km-z]{25,34}|bc1[02-9ac-hj-np-z]{11,71})\b"


def parse_ransom_export(raw: DataFrame) -> DataFrame:
    """(pos, address, family, balance_sats, payments, n_payments) of export rows.

    ``raw`` has pos, address, blockchain, family, balance, transactions. Other
    chains and impossible addresses are left out, amounts rounded.
    """
    money = lambda c: F.floor(F.coalesce(c.cast("double"), F.lit(0.0)) + 0.5).cast("long")
    pay = F.transform(
        F.coalesce("transactions", F.array()),
        lambda t: F.struct(t["hash"].alias("txid"), t["time"].alias("time"), money(t["amount"]).alias("value_sats"), F.when(t["amountUSD"] != 0, t["amountUSD"]).alias("usd")),
    )
    family = F.coalesce(F.when(F.col("family") != "", F.col("family")), F.lit("Unlabeled"))
    kept = raw.where((F.col("blockchain") == "bitcoin") & is_real_address(F.col("address")))
    return kept.select("pos", "address", family.alias("family"), money(F.col("balance")).alias("balance_sats"), pay.alias("payments"), F.size(pay).alias("n_payments"))


def ransom_addresses(rows: DataFrame) -> DataFrame:
    """One row per address: the last one."""
    rest = [c for c in rows.columns if c not in ("address", "pos")]
    return rows.groupBy("address").agg(F.max_by(F.struct(*rest), "pos").alias("r")).select("address", "r.*")


def ransom_families(rows: DataFrame) -> DataFrame:
    """(family, n_addresses, n_payments); every row counts, repeated addresses too."""
    return rows.groupBy("family").agg(F.count("*").alias("n_addresses"), F.sum("n_payments").alias("n_payments"))


def parse_sanctions(lines: DataFrame) -> DataFrame:
    """(address, entity) of text lines (pos, value): all valid candidates, the second comma field of the first line with each."""
    found = lines.select("pos", F.explode(F.regexp_extract_all("value", F.lit(CANDIDATE), F.lit(1))).alias("address"), F.split("value", ",")[1].alias("e")).where(is_real_address(F.col("address")))
    name = F.trim(F.regexp_replace(F.coalesce("e", F.lit("")), r'^"|"$', ""))
    first = found.groupBy("address").agg(F.min_by(name, "pos").alias("entity"))
    return first.select("address", F.when(F.col("entity") != "", F.col("entity")).alias("entity"))


def confirmed(ransom: DataFrame, sanctions: DataFrame) -> DataFrame:
    """(address, kind) of both lists; sanctions win."""
    a = ransom.select("address", F.lit("ransomware").alias("kind"))
    b = sanctions.select("address", F.lit("sanctioned").alias("kind"))
    return a.unionByName(b).where("address is not null").groupBy("address").agg(F.max("kind").alias("kind"))


def pick_wallets(ransom: DataFrame, top: int = 20) -> DataFrame:
    """The labelled wallets with most payments, three at least; ties by address."""
    return ransom.where("n_payments >= 3 and family is not null and family <> 'Unlabeled'").orderBy(F.col("n_payments").desc(), "address").limit(top)
