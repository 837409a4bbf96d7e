"""Nested records to related flat tables.

Every array level becomes a child table. A child row carries ``_key`` (its own
surrogate key), ``_parent`` (the key of the row that holds the list) and
``_ord`` (its place in the list, from 0; null elements keep their place but give
no row). Keys are paths (``<root>/<list>.<place>/...``), so a key is unique in
its table and names all its ancestors.

Two forms of input are handled: typed columns (``flatten_typed``, the schema is
the DataFrame's own) and JSON bodies (``flatten_json``, the schema is merged
over all bodies first). Nothing is collected but the merged schema, whose size
is the number of distinct member paths, not of records.

The merged schema is inferred by built-in functions: each record gives the text
of its own shape, shapes are made distinct, and the few that are left are merged.
Only records whose shape contradicts itself are looked through value by value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RESERVED = ("_key", "_parent", "_ord")


# --------------------------------------------------------------------------- typed columns
def flatten_typed(df: DataFrame, key: str, name: str = "root", drop: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Flat tables of a DataFrame with nested columns.

    ``key`` names a column that is unique per row. Struct members become columns
    joined by ``__``; a column whose flat name is already taken gets a trailing
    ``_``. Empty and null arrays give no child rows; an empty table gives empty
    tables of the right schema. Maps stay columns of their table.
    """
    root = df.select(F.col(key).cast("string").alias("_key"), F.struct(*[c for c in df.columns if c not in drop]).alias("_e"))
    return _typed(root, name, head=["_key"])


def _typed(df: DataFrame, name: str, head: list[str]) -> dict[str, DataFrame]:
    flat, lists = [], []

    def walk(kind: T.DataType, at: Column, path: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, at.getField(f.name), (*path, f.name))
        elif isinstance(kind, T.ArrayType):
            lists.append((path, at, kind))
        else:
            flat.append((path or ("value",), at))

    walk(df.schema["_e"].dataType, F.col("_e"), ())
    names = _unique(["__".join(p) for p, _ in flat])
    out = {name: df.select(*head, *[c.alias(n) for n, (_, c) in zip(names, flat)])}
    for path, at, _ in lists:
        step = "__".join(path) or "list"
        child = (
            df.where(F.size(at) > 0)
            .select(F.col("_key").alias("_parent"), F.posexplode(at).alias("_ord", "_e"))
            .where("_e is not null")
            .withColumn("_key", F.concat("_parent", F.lit(f"/{step}."), F.col("_ord")))
        )
        out |= _typed(child, f"{name}.{step}", head=["_key", "_parent", "_ord"])
    return out


def _unique(names: list[str]) -> list[str]:
    taken, out = {n.lower() for n in _RESERVED}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


# --------------------------------------------------------------------------- JSON bodies
@dataclass
class Node:
    """Merged schema of one member path: the kinds seen, members, list element."""

    kinds: set[str] = field(default_factory=set)
    members: dict[str, Node] = field(default_factory=dict)
    element: Node | None = None

    @property
    def is_list(self) -> bool:
        return "array" in self.kinds

    def scalar_type(self) -> str | None:
        """SQL type of the scalar values; "number" where numbers and text occur."""
        seen = self.kinds - {"array", "object", "null"}
        if not seen:
            return None
        if seen == {"boolean"}:
            return "boolean"
        if "text" in seen:
            return "number" if seen & {"whole", "real"} and "boolean" not in seen else "string"
        if "boolean" in seen:
            return "string"
        return "bigint" if seen == {"whole"} else "double"


def parsed(body: Column) -> Column:
    """The body as a variant, or null where it is not exactly one valid JSON value.

    The parser alone accepts text after the value, so the body must also count
    as one element when put in brackets.
    """
    whole = F.json_array_length(F.concat(F.lit("["), body, F.lit("]")))
    return F.when(whole == 1, F.try_parse_json(body))


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for the expressions that are analysed meanwhile; it is as before afterwards."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _kind(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "whole" if -(2**63) <= v < 2**63 else "real"
    if isinstance(v, float):
        return "whole" if v.is_integer() and abs(v) < 2**53 else "real"
    if isinstance(v, str):
        return "text"
    return "array" if isinstance(v, list) else "object"


def _kinds_of_values(text: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """Every (path, kind) of one record."""
    todo: list[tuple[tuple[str, ...], object]] = [((), json.loads(text))]
    while todo:
        path, v = todo.pop()
        yield path, _kind(v)
        if isinstance(v, dict):
            todo += [((*path, "." + k), x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [((*path, "[]"), x) for x in v]


_SCALARS = {"BOOLEAN": "boolean", "BIGINT": "whole", "DOUBLE": "real", "FLOAT": "real", "STRING": "text", "VOID": "null"}
_TOKEN = re.compile(r"`((?:[^`]|``)*)`|([^<>,:` ]+)|([<>,:])")


def _kinds_of_shape(shape: str) -> Iterator[tuple[tuple[str, ...], str]]:
    """Every (path, kind) of a shape as ``schema_of_variant`` writes it."""
    # names in backticks are told from words and signs
    tokens = [(True, m[1].replace("``", "`")) if m[1] is not None else (False, m[2] or m[3]) for m in _TOKEN.finditer(shape)]
    at = 0

    def read(path: tuple[str, ...]) -> Iterator[tuple[tuple[str, ...], str]]:
        nonlocal at
        word = tokens[at][1]
        at += 1
        if word not in ("OBJECT", "ARRAY"):
            yield path, _SCALARS.get(word, "real" if word.startswith("DECIMAL") else "text")
            return
        yield path, word.lower()
        at += 1  # <
        while tokens[at] != (False, ">"):
            if word == "ARRAY":
                yield from read((*path, "[]"))
            else:
                name = tokens[at][1]
                at += 2  # name and colon
                yield from read((*path, "." + name))
            if tokens[at] == (False, ","):
                at += 1
        at += 1

    return read(())


def _kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: set[tuple[str, str]] = set()
    for pdf in batches:
        for shape, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
            seen.update((json.dumps(p), k) for p, k in (_kinds_of_values(text) if text is not None else _kinds_of_shape(shape)))
    yield pd.DataFrame(sorted(seen), columns=["path", "kind"])


def infer_schema(values: DataFrame, column: str, max_paths: int = 100_000) -> Node:
    """Merge the schemas of all variants of a column.

    Records are reduced to distinct shapes before anything leaves the tasks'
    partial aggregates; those whose shape says VARIANT somewhere (one list holds
    values of several kinds) come with their text and are read value by value.
    The driver gets distinct (path, kind) pairs. More than ``max_paths`` of them
    raise an error (member names then are data), so that nothing is silently
    left out. Text counts as text; ``flatten_json`` looks whether it is numbers.
    """
    shape = F.regexp_replace(F.schema_of_variant(column), r"DECIMAL\(\d+,\d+\)", "DOUBLE")
    mixed = F.concat(F.lit(" "), shape).rlike(r"[ <]VARIANT\b")
    shapes = values.where(F.col(column).isNotNull()).select(shape.alias("shape"), F.when(mixed, F.to_json(column)).alias("text")).distinct()
    pairs = shapes.mapInPandas(_kinds, "path string, kind string").distinct().limit(max_paths + 1).collect()
    if len(pairs) > max_paths:
        raise ValueError(f"more than {max_paths} member paths: the bodies use data as member names")
    root = Node()
    for path, kind in pairs:
        at = root
        for step in json.loads(path):
            if step == "[]":
                at.element = at.element or Node()
                at = at.element
            else:
                at = at.members.setdefault(step[1:], Node())
        at.kinds.add(kind)
    return root


def as_list(v: Column, path: str = "$", scalars: bool = False) -> Column:
    """A member as array<variant>; a bare object counts as a list of one, so does a bare scalar if wanted; null as none."""
    one = F.try_variant_get(v, path, "variant")
    # a cast to map succeeds for objects only
    bare = ~F.is_variant_null(one) if scalars else F.try_variant_get(v, path, "map<string,variant>").isNotNull()
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.when(bare, F.array(one)))


def _at(path: tuple[str, ...]) -> str:
    return "$" + "".join("['" + p.replace("\\", "\\\\").replace("'", "\\'") + "']" for p in path)


def _merged(a: Node, b: Node) -> Node:
    """The schema of values of either of two."""
    members = {k: _merged(a.members[k], b.members[k]) if k in a.members and k in b.members else a.members.get(k) or b.members[k] for k in {**a.members, **b.members}}
    element = _merged(a.element, b.element) if a.element and b.element else a.element or b.element
    return Node(a.kinds | b.kinds, members, element)


def child_lists(node: Node, synonyms: dict[str, tuple[str, ...]] | None = None) -> list[tuple[str, Node, Column]]:
    """(name, schema of the elements, list of variants) of every list that a record of this schema holds at its own level.

    ``synonyms`` maps a name to the member names that mean the same; their
    values are one list, the first that is a list or an object counting. Only
    the names that the merged schema knows are looked for.
    """
    found: list[tuple[str, Node, Column]] = []
    e = F.col("_e")

    def element_of(n: Node) -> Node:
        element = n.element or Node()
        # what stands bare in some records is an element there
        return _merged(element, Node(n.kinds - {"array", "null"}, n.members, None))

    def walk(n: Node, path: tuple[str, ...]) -> None:
        if n.is_list:
            found.append(("__".join(path) or "list", element_of(n), as_list(e, _at(path), scalars=True)))
            return
        for k, m in sorted(n.members.items()):
            if path or not any(k in names for names in (synonyms or {}).values()):
                walk(m, (*path, k))

    walk(node, ())
    for name, names in (synonyms or {}).items():
        known = [k for k in names if k in node.members]
        if known:
            schema = element_of(node.members[known[0]])
            for k in known[1:]:
                schema = _merged(schema, element_of(node.members[k]))
            found.append((name, schema, F.coalesce(*[as_list(e, _at((k,))) for k in known])))
    return found


def explode_lists(df: DataFrame, lists: list[tuple[str, Node, Column]], head: list[str | Column]) -> DataFrame:
    """Rows of several sibling child tables by one pass over their parents: ``head``, _list, _ord and the element _e."""

    def tagged(name: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<variant>")), lambda x, i: F.struct(F.lit(name).alias("l"), i.alias("i"), x.alias("x")))

    rows = df.select(*head, F.explode(F.concat(*[tagged(name, values) for name, _, values in lists])).alias("_x"))
    return rows.withColumns({"_list": F.col("_x.l"), "_ord": F.col("_x.i"), "_e": F.col("_x.x")}).drop("_x").where("_e is not null and not is_variant_null(_e)")


def flatten_json(df: DataFrame, key: str, column: str, name: str = "root", schema: Node | None = None, synonyms: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """Flat tables of a variant column; ``key`` is unique per row.

    The merged schema decides: a path that is a list in any record is a list in
    all (a bare object or scalar is a list of one). Scalar columns take the
    narrowest type that holds every value, numbers as text included. Rows whose
    variant is null give nothing; the key alone remains for objects without
    known members. ``synonyms`` are those of ``child_lists``, for the records
    themselves.
    """
    schema = schema or infer_schema(df, column)
    root = df.where(F.col(column).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.col(column).alias("_e"))
    return _json(root, schema, name, ["_key"], synonyms)


def _json(df: DataFrame, node: Node, name: str, head: list[str], synonyms: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    flat: list[tuple[tuple[str, ...], str]] = []
    lists = child_lists(node, synonyms)
    apart = {k for names in (synonyms or {}).values() for k in names}

    def walk(n: Node, path: tuple[str, ...]) -> None:
        if n.is_list or (len(path) == 1 and path[0] in apart):
            return
        if kind := n.scalar_type():
            flat.append((path, kind))
        for k, m in sorted(n.members.items()):
            walk(m, (*path, k))

    walk(node, ())
    get = lambda p, kind: F.try_variant_get("_e", _at(p), kind)
    # numbers and text under one name: a number column if all the text is numbers, by one pass for all of them
    both = [p for p, kind in flat if kind == "number"]
    if both:
        fits = lambda p, pattern: F.coalesce(F.bool_and(get(p, "string").rlike(pattern)), F.lit(True))
        tests = df.select([f(p, x).alias(f"{k}{i}") for i, p in enumerate(both) for k, f, x in (("w", fits, r"^[+-]?\d{1,18}$"), ("r", fits, r"^[+-]?\d+(\.\d+)?([eE][+-]?\d+)?$"))]).first()
        chosen = {p: "bigint" if tests[f"w{i}"] else "double" if tests[f"r{i}"] else "string" for i, p in enumerate(both)}
        flat = [(p, chosen.get(p, kind)) for p, kind in flat]
    names = _unique(["__".join(p) or "value" for p, _ in flat])
    out = {name: df.select(*head, *[get(p, kind).alias(n) for n, (p, kind) in zip(names, flat)])}
    for step, element, values in lists:
        child = explode_lists(df, [(step, element, values)], [F.col("_key").alias("_parent")]).select(
            "_parent", "_ord", "_e", F.concat("_parent", F.lit(f"/{step}."), F.col("_ord").cast("string")).alias("_key")
        )
        out |= _json(child, element, f"{name}.{step}", ["_key", "_parent", "_ord"])
    return out


# --------------------------------------------------------------------------- ledger transactions
IN_NAMES = ("vin", "inputs")
OUT_NAMES = ("vout", "outputs", "out")
SIDES = {"in": IN_NAMES, "out": OUT_NAMES}


def unwrap_bodies(raw: DataFrame) -> DataFrame:
    """(record_id, tx_pos, tx) for every non-null transaction of every valid body.

    A body is one transaction, or wraps several in a top-level array, in ``txs``,
    in ``tx`` or in the ``tx`` members of ``data.items``.
    """
    body = F.col("_b")
    items = F.try_variant_get(body, "$.data.items", "variant")
    many = F.coalesce(
        F.try_variant_get(body, "$", "array<variant>"),
        as_list(body, "$.txs"),
        as_list(body, "$.tx"),
        F.transform(as_list(items), lambda i: F.try_variant_get(i, "$.tx", "variant")),
    )
    has = lambda names: F.greatest(*[F.try_variant_get(body, f"$.{m}", "variant").isNotNull() for m in names])
    # a wrapper without transactions is none itself, unless it has lists of its own
    own = has((*IN_NAMES, *OUT_NAMES)) | ~has(("txs", "tx", "data"))
    single = F.when(own & F.try_variant_get(body, "$", "map<string,variant>").isNotNull(), F.array(body))
    # JSON lets a member name repeat; the last one counts
    with _setting(raw.sparkSession, "spark.sql.variant.allowDuplicateKeys", "true"):
        bodies = raw.select("record_id", parsed(F.col("body")).alias("_b")).where("_b is not null")
    return bodies.select("record_id", F.posexplode(F.coalesce(many, single)).alias("tx_pos", "tx")).where("tx is not null and not is_variant_null(tx)")


def raw_children(raw: DataFrame) -> DataFrame:
    """Both child tables of the raw bodies' transactions in one: record, place of its transaction, side, own place, element.

    The lists are those that the merged schema of all transactions names, under
    whatever name each record has them; every body is parsed and exploded once.
    """
    txs = unwrap_bodies(raw)
    lists = [x for x in child_lists(infer_schema(txs, "tx"), SIDES) if x[0] in SIDES]
    parents = txs.select("record_id", "tx_pos", F.col("tx").alias("_e"))
    if not lists:
        return parents.limit(0).select("record_id", "tx_pos", F.lit("in").alias("side"), F.lit(0).alias("item_pos"), F.col("_e").alias("e"))
    rows = explode_lists(parents, lists, ["record_id", "tx_pos"])
    return rows.select("record_id", "tx_pos", F.col("_list").alias("side"), F.col("_ord").alias("item_pos"), F.col("_e").alias("e"))


def tx_children(tx: DataFrame, side: str) -> DataFrame:
    """The same of the typed table, by ``flatten_typed``'s child tables."""
    column = "inputs" if side == "in" else "outputs"
    child = flatten_typed(tx.select("delivery_id", column), "delivery_id", "tx", drop=("delivery_id",))[f"tx.{column}"]
    return child.withColumn("delivery_id", F.col("_parent").cast("long")).withColumn("side", F.lit(side))


def child_rows(tx: DataFrame, raw: DataFrame) -> DataFrame:
    """Every input and output of both sources with its record, transaction and place."""
    out = raw_children(raw).select(F.lit("raw_tx").alias("origin"), F.col("record_id").alias("row_id"), "tx_pos", "side", "item_pos")
    for side in SIDES:
        out = out.unionByName(
            tx_children(tx, side).select(F.lit("tx").alias("origin"), F.col("delivery_id").alias("row_id"), F.lit(0).alias("tx_pos"), "side", F.col("_ord").alias("item_pos"))
        )
    return out


def transfers(tx: DataFrame, raw: DataFrame) -> DataFrame:
    """Inputs and outputs of both sources with address and value, whatever the members are called."""
    e = F.col("e")
    text = lambda p: F.try_variant_get(e, p, "string")
    whole = lambda p: F.try_variant_get(e, p, "bigint")
    address = F.coalesce(*map(text, ("$.address", "$.addr", "$.scriptpubkey_address", "$.prevout.scriptpubkey_address", "$.prev_out.addr")))
    value = F.coalesce(*map(whole, ("$.value_sats", "$.value", "$.prevout.value", "$.prev_out.value")))
    out = raw_children(raw).select(F.lit("raw_tx").alias("origin"), F.col("record_id").alias("row_id"), "tx_pos", "side", "item_pos", address.alias("address"), value.alias("value_sats"))
    for side in SIDES:
        t = tx_children(tx, side)
        out = out.unionByName(t.select(F.lit("tx").alias("origin"), F.col("delivery_id").alias("row_id"), F.lit(0).alias("tx_pos"), "side", F.col("_ord").alias("item_pos"), "address", "value_sats"))
    return out


def raw_tables(raw: DataFrame, synonyms: dict[str, tuple[str, ...]] | None = None) -> dict[str, DataFrame]:
    """All flat tables of the raw bodies at any depth, by the merged schema."""
    txs = unwrap_bodies(raw).select(F.concat_ws("/", "record_id", "tx_pos").alias("k"), "tx")
    return flatten_json(txs, "k", "tx", "tx", synonyms=synonyms)
