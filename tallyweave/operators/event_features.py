"""Per-entity feature table of typed events, by bit-sliced counters.

Entities are spread over blocks by hash; in a block they get dense ordinals. A
position is (event type, ordinal). The counters and totals of all positions of a
block are held as bit planes: plane k is the compressed bitmap of the positions
whose number has bit k set, in containers of 2**16 positions of one type, each
a sorted array of 16-bit places or, where it is dense, a bit set. Events are
counted by carry addition: of the occurrences of a position every pair is a
carry to the next plane; the odd one is added to the plane, whose new value is
the symmetric difference, and what both have in common is a carry as well.
Values are added the same way, from plane to plane. Latest times lie in arrays
aligned with the ordinals. Decoding reads the planes back into numbers.

Scale: each task counts its own events in planes first, a chunk at a time, and
sends the numbers of every position once, so an entity with a third of all
events sends one row per type and chunk. A block adds what it gets in chunks,
and its state grows with its entities and types only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.delivery import exactly_once

BLOCK_ROWS = 1 << 16
_CHUNK_ROWS = 1 << 18
_NEVER = np.iinfo(np.int64).min
_ARRAY_MOST = 4096  # places of a sorted 16-bit container; a bit set takes as much room
_PARTIAL = "block int, entity string, kind string, n long, latest long, plus long, minus long"
_FEATURES = "map<string,struct<n:bigint,latest:bigint,total_sats:bigint>>"


# --------------------------------------------------------------------------- compressed bitmaps
def _bits_of(places: np.ndarray) -> np.ndarray:
    """A bit set (1,024 words) of sorted places."""
    one = np.zeros(1 << 16, np.uint8)
    one[places] = 1
    return np.packbits(one, bitorder="little").view(np.uint64)


def _places_of(container: np.ndarray) -> np.ndarray:
    """The sorted places of a container."""
    if container.dtype == np.uint16:
        return container
    return np.flatnonzero(np.unpackbits(container.view(np.uint8), bitorder="little")).astype(np.uint16)


def _packed(bits: np.ndarray) -> np.ndarray:
    """The smaller form of a bit set."""
    return bits if int(np.bitwise_count(bits).sum()) > _ARRAY_MOST else _places_of(bits)


def _xor_and(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric difference and intersection of two containers."""
    if a.dtype == b.dtype == np.uint16 and a.size + b.size <= _ARRAY_MOST:
        both = np.sort(np.concatenate([a, b]), kind="stable")
        twice = np.zeros(both.size + 1, bool)
        np.equal(both[1:], both[:-1], out=twice[1:-1])
        return both[~(twice[1:] | twice[:-1])], both[1:][twice[1:-1]]
    x, y = (_bits_of(c) if c.dtype == np.uint16 else c for c in (a, b))
    return _packed(x ^ y), _packed(x & y)


class Bitmap:
    """A set of positions, in containers by their high bits."""

    def __init__(self) -> None:
        self.containers: dict[int, np.ndarray] = {}

    def flip(self, positions: np.ndarray) -> np.ndarray:
        """Symmetric difference with sorted distinct positions; gives the sorted positions that both had."""
        high = positions >> 16
        cuts = [0, *(np.flatnonzero(np.diff(high)) + 1).tolist(), positions.size]
        common = []
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z == a:
                continue
            key, own = int(high[a]), (positions[a:z] & 0xFFFF).astype(np.uint16)
            have = self.containers.get(key)
            if have is None:
                self.containers[key] = own if own.size <= _ARRAY_MOST else _bits_of(own)
                continue
            left, both = _xor_and(have, own)
            if left.size:
                self.containers[key] = left
            else:
                del self.containers[key]
            if both.size:
                common.append(_places_of(both).astype(np.int64) | key << 16)
        return np.concatenate(common) if common else np.empty(0, np.int64)

    def positions(self) -> np.ndarray:
        parts = [_places_of(c).astype(np.int64) | key << 16 for key, c in sorted(self.containers.items())]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)


# --------------------------------------------------------------------------- bit-sliced numbers
class BitSlices:
    """Non-negative integers at positions, as bit planes of compressed bitmaps."""

    def __init__(self) -> None:
        self.planes: list[Bitmap] = []

    def add(self, positions: np.ndarray, numbers: np.ndarray | None = None) -> None:
        """Add a number (without numbers, 1) at every position; positions are sorted and may repeat."""
        top = 1 if numbers is None else int(numbers.max(initial=0)).bit_length()
        carry, k = positions[:0], 0
        while k < top or carry.size:
            here = carry
            if k < top:
                own = positions if numbers is None else positions[(numbers >> k) & 1 == 1]
                here = np.sort(np.concatenate([own, carry]), kind="stable") if carry.size else own
            carry = self._add_to_plane(here, k)
            k += 1

    def _add_to_plane(self, positions: np.ndarray, k: int) -> np.ndarray:
        """Add 2**k at every position; gives the positions to add 2**(k+1) at."""
        if not positions.size:
            return positions
        while len(self.planes) <= k:
            self.planes.append(Bitmap())
        start = np.flatnonzero(np.r_[True, positions[1:] != positions[:-1]])
        if start.size == positions.size:
            return self.planes[k].flip(positions)
        times = np.diff(np.r_[start, positions.size])
        once = positions[start]
        pairs = np.repeat(once, times >> 1)
        both = self.planes[k].flip(once[times & 1 == 1])
        return np.sort(np.concatenate([pairs, both]), kind="stable") if both.size else pairs

    def decode(self, positions: np.ndarray) -> np.ndarray:
        """The numbers at positions, which must be sorted and cover all planes."""
        out = np.zeros(positions.size, np.int64)
        for k, plane in enumerate(self.planes):
            out[np.searchsorted(positions, plane.positions())] += 1 << k
        return out


class Counters:
    """Counts, totals and latest times of (kind, ordinal) positions."""

    def __init__(self) -> None:
        self.n, self.plus, self.minus = BitSlices(), BitSlices(), BitSlices()
        self.latest: dict[int, np.ndarray] = {}

    def add(self, kind: np.ndarray, ordinal: np.ndarray, n: np.ndarray | None, latest: np.ndarray, plus: np.ndarray, minus: np.ndarray) -> None:
        """Add rows; without ``n`` every row is one event. A missing time is ``_NEVER``."""
        # containers hold one kind each: the ordinal's high bits follow the kind
        at = (kind.astype(np.int64) << 32) | ordinal
        order = np.argsort(at, kind="stable")
        at = at[order]
        self.n.add(at, None if n is None else n[order])
        for slices, v in ((self.plus, plus), (self.minus, minus)):
            if v.any():
                slices.add(at, v[order])
        if not at.size:
            return
        start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        best = np.maximum.reduceat(latest[order], start)
        once = at[start][best != _NEVER]
        best = best[best != _NEVER]
        for k in np.unique(once >> 32).tolist():
            a, z = np.searchsorted(once, [k << 32, (k + 1) << 32])
            place = once[a:z] & 0xFFFFFFFF
            have = self.latest.get(k)
            if have is None or len(have) <= place[-1]:
                grown = np.full(max(int(place[-1]) + 1, 2 * (0 if have is None else len(have))), _NEVER)
                grown[: 0 if have is None else len(have)] = _NEVER if have is None else have
                have = self.latest[k] = grown
            have[place] = np.maximum(have[place], best[a:z])

    def decode(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """kind, ordinal, n, latest, plus and minus of all positions, by kind and ordinal."""
        # every event counts, so the planes of the counters hold all positions
        parts = [p.positions() for p in self.n.planes]
        at = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.int64)
        kind, ordinal = at >> 32, at & 0xFFFFFFFF
        latest = np.full(at.size, _NEVER)
        for k, times in self.latest.items():
            a, z = np.searchsorted(at, [k << 32, (k + 1) << 32])
            own = a + np.flatnonzero(ordinal[a:z] < len(times))
            latest[own] = times[ordinal[own]]
        return kind, ordinal, self.n.decode(at), latest, self.plus.decode(at), self.minus.decode(at)


# --------------------------------------------------------------------------- Spark steps
def typed_events(tx: DataFrame) -> DataFrame:
    """(entity, kind, time, value) of every input and output of the kept copies.

    kind is side, source and number of decimal digits of the value ('-' for a
    null source or value). Null and empty addresses are no entities.
    """

    def side(column: str) -> Column:
        # member by member, so that the scan reads these two members only
        pairs = F.arrays_zip(F.col(f"{column}.address").alias("address"), F.col(f"{column}.value_sats").alias("value"))
        return F.transform(
            F.filter(F.coalesce(pairs, F.array()), lambda e: e["address"].isNotNull() & (e["address"] != "")),
            lambda e: F.struct(F.lit(column == "inputs").alias("spent"), e["address"].alias("address"), e["value"].alias("value")),
        )

    # only what the events need goes through the copies' shuffle
    narrow = tx.select("delivery_id", "txid", "time", F.col("provenance.source").alias("source"), F.concat(side("inputs"), side("outputs")).alias("events"))
    digits = F.coalesce(F.length(F.abs(F.col("e.value")).cast("string")).cast("string"), F.lit("-"))
    return exactly_once(narrow).select("time", "source", F.explode("events").alias("e")).select(
        F.col("e.address").alias("entity"),
        F.concat_ws("|", F.when(F.col("e.spent"), "in").otherwise("out"), F.coalesce("source", F.lit("-")), digits).alias("kind"),
        F.when(F.col("time") != 0, F.col("time")).alias("time"),
        F.col("e.value").alias("value"),
    )


def _times(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, _NEVER).to_numpy(zero_copy_only=False)


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per entity and kind of each chunk of a task, counted in planes."""

    def counted(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        entity, kind = (pc.dictionary_encode(t[c]).combine_chunks() for c in ("entity", "kind"))
        value = pc.fill_null(t["value"], 0).to_numpy()
        c = Counters()
        c.add(kind.indices.to_numpy(), entity.indices.to_numpy(), None, _times(t["latest"]), np.maximum(value, 0), np.maximum(-value, 0))
        k, o, n, latest, plus, minus = c.decode()
        block = np.empty(len(entity.dictionary), np.int32)
        block[entity.indices.to_numpy()] = t["block"].to_numpy()
        columns = [pa.array(block[o]), entity.dictionary.take(pa.array(o)), kind.dictionary.take(pa.array(k)), pa.array(n), pa.array(latest, mask=latest == _NEVER), pa.array(plus), pa.array(minus)]
        return pa.RecordBatch.from_arrays(columns, ["block", "entity", "kind", "n", "latest", "plus", "minus"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= _CHUNK_ROWS:
            yield counted(held)
            held, rows = [], 0
    if rows:
        yield counted(held)


class _Block:
    """The state of one block; it grows with its entities and types, not with the rows added."""

    def __init__(self) -> None:
        self.ordinals: dict[str, int] = {}
        self.kinds: dict[str, int] = {}
        self.counters = Counters()

    def add(self, batches: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(batches)
        at = []
        for column, names in (("kind", self.kinds), ("entity", self.ordinals)):
            coded = pc.dictionary_encode(t[column]).combine_chunks()
            own = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()], np.int64)
            at.append(own[coded.indices.to_numpy()])
        n, plus, minus = (t[c].to_numpy() for c in ("n", "plus", "minus"))
        self.counters.add(*at, n, _times(t["latest"]), plus, minus)

    def decode(self) -> pa.RecordBatch:
        kind, ordinal, n, latest, plus, minus = self.counters.decode()
        by = np.lexsort((kind, ordinal))
        latest = latest[by]
        items = pa.StructArray.from_arrays(
            [pa.array(n[by]), pa.array(latest, mask=latest == _NEVER), pa.array((plus - minus)[by])],
            fields=[pa.field("n", pa.int64()), pa.field("latest", pa.int64()), pa.field("total_sats", pa.int64())],
        )
        offsets = np.r_[0, np.cumsum(np.bincount(ordinal, minlength=len(self.ordinals)))].astype(np.int32)
        features = pa.MapArray.from_arrays(pa.array(offsets), pa.array(list(self.kinds), pa.string()).take(pa.array(kind[by])), items)
        return pa.RecordBatch.from_arrays([pa.array(list(self.ordinals), pa.string()), features], ["address", "features"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of each block; rows come in the order of the blocks and are added a chunk at a time."""
    current, state, held, rows = None, None, [], 0
    for b in batches:
        blocks = b.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), b.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:]):
            if z == a:
                continue
            if state is None or blocks[a] != current:
                if state is not None:
                    state.add(held)
                    yield state.decode()
                current, state, held, rows = blocks[a], _Block(), [], 0
            held.append(b.slice(a, z - a))
            rows += z - a
            if rows >= _CHUNK_ROWS:
                state.add(held)
                held, rows = [b.slice(a, 0)], 0
    if state is not None:
        state.add(held)
        yield state.decode()


def event_features(tx: DataFrame) -> DataFrame:
    """(address, features): per address a map of event type to count, latest time and total value.

    ``latest`` is null where every time of the type is missing (null or 0); null
    values count as events of zero value, negative ones are subtracted. Columns
    other than those named in ``typed_events`` are not read; an empty table
    gives no rows.
    """
    spark = tx.sparkSession
    # the number of tasks follows the rows, so what one of them reads does not
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * tx.count() // BLOCK_ROWS + 1)
    partial = (
        typed_events(tx)
        .select(F.pmod(F.xxhash64("entity"), F.lit(blocks)).cast("int").alias("block"), "entity", "kind", F.col("time").alias("latest"), "value")
        .mapInArrow(_partials, _PARTIAL)
    )
    return partial.repartition(blocks, "block").sortWithinPartitions("block").mapInArrow(_fold, f"address string, features {_FEATURES}")


def feature_rows(features: DataFrame) -> DataFrame:
    """The table in long form: one row per address and event type."""
    return features.select("address", F.explode("features").alias("event_type", "f")).select(
        "address", "event_type", "f.n", "f.latest", "f.total_sats"
    )
