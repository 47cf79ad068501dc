"""Problem 6: what changed between full snapshots, by invertible Bloom lookup tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
HASHES = 3
ROWS = 65_536  # rows that are worked on at once, and as many more as complete their last bucket


def xxhash64_long(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of a bigint, for arrays (the published XXH64 of eight bytes)."""
    v, h = value.astype(np.int64).view(np.uint64), seed.astype(np.int64).view(np.uint64)
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))
    with np.errstate(over="ignore"):
        h = (h + P5 + np.uint64(8)) ^ (turn(v * P2, 31) * P1)
        h = turn(h, 27) * P1 + P4
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
    return (h ^ (h >> np.uint64(32))).view(np.int64)


def check_of(k1: np.ndarray, k2: np.ndarray, v: np.ndarray) -> np.ndarray:
    return xxhash64_long(v, xxhash64_long(k2, xxhash64_long(k1, np.full(len(k1), 42, np.int64))))


def cells_of(check: np.ndarray, width: int) -> np.ndarray:
    """Cells of an element, one in each of the HASHES parts of its bucket's table."""
    first = xxhash64_long(check, np.full(len(check), 42, np.int64))
    return np.stack([j * width + np.mod(xxhash64_long(np.full(len(check), j, np.int64), first), width) for j in range(HASHES)])


def peel(count: np.ndarray, fields: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peel many buckets' subtracted tables at once.

    ``count`` (buckets x cells) and ``fields`` (4 x buckets x cells: k1, k2, v, check) are consumed. Result: bucket of
    each recovered element, its sign, its three fields.
    """
    n, cells = count.shape
    count, fields = count.reshape(-1), fields.reshape(4, -1)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    candidates = np.flatnonzero(np.abs(count) == 1)
    rounds = 0
    while len(candidates) and rounds < 4 * cells:
        rounds += 1
        k1, k2, v = fields[0, candidates], fields[1, candidates], fields[2, candidates]
        check = check_of(k1, k2, v)
        pure = check == fields[3, candidates]
        candidates, k1, k2, v, check = candidates[pure], k1[pure], k2[pure], v[pure], check[pure]
        # an element may be alone in several of its cells: take it once
        bucket = candidates // cells
        _, once = np.unique(np.stack([bucket, check]), axis=1, return_index=True)
        bucket, k1, k2, v, check, sign = bucket[once], k1[once], k2[once], v[once], check[once], count[candidates[once]]
        if not len(bucket):
            break
        out.append((bucket, sign, np.stack([k1, k2, v])))
        at = bucket[None, :] * cells + cells_of(check, width)
        for part in at:  # cells of one part may coincide between elements
            np.subtract.at(count, part, sign)
            for f, x in enumerate((k1, k2, v, check)):
                np.bitwise_xor.at(fields[f], part, x)
        touched = np.unique(at)
        candidates = touched[np.abs(count[touched]) == 1]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((3, 0), np.int64)
    return tuple(np.concatenate([o[i] for o in out], axis=-1) for i in range(3))  # type: ignore[return-value]


def bit_tables(table: np.ndarray, tables: int, k1: np.ndarray, k2: np.ndarray, v: np.ndarray, check: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lookup tables of many sets at once: counts (tables x cells) and fields (4 x tables x cells). ``table``: the table of each element."""
    cells = HASHES * width
    slots = table[None, :] * cells + cells_of(check, width)
    count = np.bincount(slots.ravel(), minlength=tables * cells).astype(np.int64).reshape(tables, cells)
    fields = np.zeros((4, tables * cells), np.int64)
    for f, x in enumerate((k1, k2, v, check)):
        for part in slots:  # cells of one part may coincide between elements
            np.bitwise_xor.at(fields[f], part, x)
    return count, fields.reshape(4, tables, cells)


def recovered(count: np.ndarray, fields: np.ndarray, width: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Peel subtracted tables: elements (at, sign, k1, k2) of those that decode, and which tables don't.

    The digests decide: nothing is left, and what was recovered makes up the whole difference.
    """
    n, count, fields = len(count), np.ascontiguousarray(count), np.ascontiguousarray(fields)  # peeled in place
    total, digest = count[:, :width].sum(axis=1), np.bitwise_xor.reduce(fields[3, :, :width], axis=1)
    bucket, sign, found = peel(count, fields, width)
    left = (count != 0).any(axis=1) | (fields != 0).any(axis=(0, 2))
    got, mixed = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.add.at(got, bucket, sign)
    np.bitwise_xor.at(mixed, bucket, check_of(*found))
    bad = left | (got != total) | (mixed != digest)
    rows = pd.DataFrame({"at": bucket, "sign": sign, "k1": found[0], "k2": found[1]})
    return rows[~bad[bucket]] if len(rows) else rows, bad


def changes(bucket: np.ndarray, delivery: np.ndarray, k1: np.ndarray, k2: np.ndarray, v: np.ndarray, deliveries: int, width: int, growth: int, rounds: int) -> pd.DataFrame:
    """Changes between successive deliveries of whole buckets: delivery (the later), row (an element that has the key), kind.

    ``bucket`` and ``delivery`` are numbered from 0, ``deliveries`` in all. Tables that don't decode are built again, ``growth`` times as wide,
    ``rounds`` times at most; the rest is compared element by element.
    """
    check, pairs = check_of(k1, k2, v), deliveries - 1
    elements = pd.DataFrame({"bucket": bucket, "delivery": delivery, "k1": k1, "k2": k2, "row": np.arange(len(k1))})
    open_ = np.ones((int(bucket.max()) + 1, pairs), bool)  # which bucket and pair isn't settled
    out = []
    for _ in range(rounds):
        ids = np.flatnonzero(open_.any(axis=1))
        if not len(ids):
            break
        place = np.full(len(open_), -1)
        place[ids] = np.arange(len(ids))
        use = np.flatnonzero(place[bucket] >= 0)
        count, fields = bit_tables(place[bucket[use]] * deliveries + delivery[use], len(ids) * deliveries, k1[use], k2[use], v[use], check[use], width)
        count, fields = count.reshape(len(ids), deliveries, -1), fields.reshape(4, len(ids), deliveries, -1)
        at, pair = np.nonzero(open_[ids])
        rows, bad = recovered(count[at, pair + 1] - count[at, pair], fields[:, at, pair + 1] ^ fields[:, at, pair], width)
        rows = rows.assign(bucket=ids[at[rows["at"]]], pair=pair[rows["at"]])
        out.append(rows.assign(plus=rows["sign"] > 0, minus=rows["sign"] < 0).groupby(["bucket", "pair", "k1", "k2"], as_index=False)[["plus", "minus"]].any())
        open_[ids[at], pair] = bad
        width *= growth
    keys = pd.concat(out)
    keys = keys.assign(delivery=keys["pair"] + keys["plus"])  # a removed key is only in the earlier delivery
    found = keys.merge(elements, on=["bucket", "delivery", "k1", "k2"])
    kind = np.where(found["plus"] & found["minus"], "changed", np.where(found["plus"], "added", "removed"))
    settled = pd.DataFrame({"delivery": found["pair"] + 1, "row": found["row"], "kind": kind})
    at, pair = np.nonzero(open_)
    if not len(at):
        return settled
    return pd.concat([settled, compared(elements.assign(v=v), pd.DataFrame({"bucket": at, "pair": pair}))])


def compared(elements: pd.DataFrame, rest: pd.DataFrame) -> pd.DataFrame:
    """The exact way for the rest: full outer comparison of the given buckets and pairs."""
    side = lambda n: rest.assign(delivery=rest["pair"] + n).merge(elements, on=["bucket", "delivery"]).drop(columns="delivery")
    both = side(0).merge(side(1), on=["bucket", "pair", "k1", "k2"], how="outer", suffixes=("_a", "_b"), indicator="_in")
    both = both[(both["_in"] != "both") | (both["v_a"] != both["v_b"])]
    kind = np.where(both["_in"] == "both", "changed", np.where(both["_in"] == "right_only", "added", "removed"))
    return pd.DataFrame({"delivery": both["pair"] + 1, "row": both["row_b"].fillna(both["row_a"]).astype(np.int64), "kind": kind})


def differ(numbers: np.ndarray, keys: list[str], width: int, growth: int, rounds: int, piece: int):
    """mapInArrow function over elements sorted by bucket: whole buckets at a time to their changes."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        column = lambda c: t.column(c).to_numpy()
        bucket = np.unique(column("_bucket"), return_inverse=True)[1]
        c = changes(bucket, np.searchsorted(numbers, column("_no")), column("_k1"), column("_k2"), column("_v"), len(numbers), width, growth, rounds)
        named = t.select(keys).take(pa.array(c["row"].to_numpy(np.int64))).combine_chunks()
        parts = [pa.array(numbers[c["delivery"].to_numpy(np.int64)], pa.int64()), *(named.column(k).combine_chunks() for k in keys), pa.array(c["kind"].to_numpy(object), pa.string())]
        return pa.Table.from_arrays(parts, ["snapshot_no", *keys, "change_kind"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < piece:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            bucket = t.column("_bucket").to_numpy()
            whole = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if whole:
                yield from solved(t.slice(0, whole)).to_batches()
            held = t.slice(whole).to_batches()
        if held and sum(b.num_rows for b in held):
            yield from solved(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return run


def snapshot_changes(rows: DataFrame, no: str, keys: list[str], value, arrival: str, per_bucket: int = 256, width: int = 64, growth: int = 2, rounds: int = 3, piece: int = ROWS) -> DataFrame:
    """Keys added, removed or changed from each delivery to the next.

    ``rows``: deliveries ``no`` (integers), ``keys`` (columns, not null; rows with a null key or number belong to no
    record and are left out), ``arrival`` (of several rows of one delivery and key the last one counts) and
    ``value``, the column whose change counts (null is a value of its own). Result: snapshot_no (the later
    delivery), keys, change_kind. A delivery is compared with the one before it in the table; other columns are
    ignored. An empty table gives an empty result.

    Each delivery's records go into hash buckets of about ``per_bucket`` keys; each bucket has an invertible Bloom
    lookup table of 3 x ``width`` cells. The tables of consecutive deliveries are subtracted, unchanged records cancel,
    and differing (key hash, value hash) pairs are peeled. Buckets whose table doesn't decode, or whose digests
    don't agree, are tried again with a table ``growth`` times as wide, ``rounds`` times at most; those that still
    fail are compared record by record. So a result is exact unless two 128-bit key hashes collide.

    Copies of a key are reduced before they are shuffled. The records then go to their bucket in one shuffle, keys and value
    hash only; tables are built, subtracted and peeled in that task, again for failed buckets, and the recovered keys are those of
    the task's own rows. A task holds some ``piece`` records and one more bucket: ``per_bucket`` keys of every delivery.
    Runs one job, which counts the rows of each delivery.
    """
    wide = rows.where(" and ".join(f"`{c}` is not null" for c in [no, *keys]))
    named = [f"_key{i}" for i in range(len(keys))]
    last = wide.groupBy(F.col(no).cast("bigint").alias("_no"), *(F.col(k).alias(n) for k, n in zip(keys, named))).agg(F.max_by(value, F.col(arrival)).alias("_value"))
    counted = rows.groupBy(F.col(no).cast("bigint").alias("no")).count().orderBy("no").collect()  # a row per delivery
    numbers = np.array([r["no"] for r in counted if r["no"] is not None], np.int64)
    schema = StructType([StructField("snapshot_no", LongType()), *(StructField(n, last.schema[n].dataType) for n in named), StructField("change_kind", StringType())])
    if len(numbers) < 2:
        return rows.sparkSession.createDataFrame([], schema).withColumnsRenamed(dict(zip(named, keys)))
    buckets = max(1, -(-max(r["count"] for r in counted) // per_bucket))
    k1 = F.xxhash64(*named)
    bucket = F.pmod(k1, F.lit(buckets).cast("bigint"))
    sent = last.select("_no", *named, F.xxhash64("_value").alias("_v")).repartition(bucket)
    elements = sent.select(bucket.alias("_bucket"), "_no", k1.alias("_k1"), F.xxhash64(F.lit("second"), *reversed(named)).alias("_k2"), "_v", *named).sortWithinPartitions("_bucket")
    return elements.mapInArrow(differ(numbers, named, width, growth, rounds, piece), schema).withColumnsRenamed(dict(zip(named, keys)))
