"""Problem 8: filling fixed-capacity containers with texts, by lexical retrieval."""

from __future__ import annotations

import base64
import copy
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.common import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The published pre-splitting pattern of byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SHARD = 1500  # items of a shard of the index
K1, B = 1.2, 0.75


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import os

    import tiktoken

    if not os.path.isfile(path):
        raise ValueError(f"there is no tokenizer at {path}: `vocabulary` is to be the path of its ranks on every executor")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    terms, counts = np.unique(ids, return_counts=True)
    return terms.astype(np.int32), counts.astype(np.int32)


TERMS = "terms array<int>, counts array<int>"


def sizes(path: str, capacities: list[int]):
    """Token count of each text, its distinct tokens (the terms of the index) and how often each occurs; of a text that exceeds a capacity also those
    of what is left over when it is split (rest, in order of capacities)."""

    def lists(arrays: list[np.ndarray]) -> pa.ListArray:
        ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if len(arrays) else np.empty(0, np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        part = pa.list_(pa.struct([("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))
        for batch in batches:
            size, terms, counts, rests = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = np.array(encode(text) if text is not None else [], np.int32)
                t, c = terms_of(ids)
                size.append(len(ids))
                terms.append(t)
                counts.append(c)
                rests.append([dict(zip(("terms", "counts"), terms_of(ids[len(ids) // k * k :]))) if len(ids) > k else None for k in capacities])
            columns = [batch.column("row_no"), batch.column("doc_id"), pa.array(size, pa.int64()), lists(terms), lists(counts), pa.array(rests, part)]
            yield pa.RecordBatch.from_arrays(columns, ["row_no", "doc_id", "tokens", "terms", "counts", "rest"])

    return run


class Shard:
    """Inverted BM25 index over the items of one shard, with the corpus's document counts."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], held: np.ndarray, docs: int, mean: float) -> None:
        n = len(terms)
        lengths = np.array([len(t) for t in terms], np.int64)
        size = np.array([c.sum() if len(c) else 0 for c in counts], float)
        self.own, self.n = terms, n
        flat = np.concatenate(terms).astype(np.int64) if lengths.sum() else np.empty(0, np.int64)
        tf = np.concatenate(counts).astype(float) if lengths.sum() else np.empty(0)
        # postings by term and item: one sort of numbers that hold the term and the place
        keys = np.sort((flat << 32) | np.arange(len(flat)))
        order, sorted_ = keys & 0xFFFFFFFF, keys >> 32
        first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if len(keys) else np.empty(0, np.int64)
        self.term, self.start, self.end = sorted_[first], first, np.r_[first[1:], len(keys)][: len(first)]
        self.item = np.repeat(np.arange(n), lengths)[order]
        idf = np.repeat(np.log1p((docs - held[self.term] + 0.5) / (held[self.term] + 0.5)), self.end - self.start)
        norm = K1 * (1 - B + B * size / max(mean, 1.0))
        tf = tf[order]
        self.weight = idf * tf * (K1 + 1) / (tf + norm[self.item])

    def narrowed(self, free: np.ndarray) -> Shard:
        """The index of the free items only: what is looked up gets less as a shard is filled."""
        out = copy.copy(self)
        keep = free[self.item]
        upto = np.r_[0, np.cumsum(keep)]
        out.item, out.weight, out.start, out.end = self.item[keep], self.weight[keep], upto[self.start], upto[self.end]
        return out

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every item for the seed's terms."""
        at = np.searchsorted(self.term, self.own[seed])
        start, length = self.start[at], self.end[at] - self.start[at]
        if not len(start):
            return np.zeros(self.n)
        offsets = np.repeat(start - np.r_[0, np.cumsum(length)[:-1]], length)
        picked = np.arange(length.sum()) + offsets
        return np.bincount(self.item.take(picked), self.weight.take(picked), self.n)


def best_first(score: np.ndarray, items: np.ndarray, some: int = 32) -> Iterator[int]:
    """All items by falling score, equal ones in order; sorted piece by piece, as mostly a few are wanted."""
    while len(items) > 2 * some:
        own = score[items]
        high = own >= own[np.argpartition(-own, some)[some]]
        if high.all():
            break
        top = items[high]
        yield from top[np.argsort(-score[top], kind="stable")]
        items, some = items[~high], some * 4
    yield from items[np.argsort(-score[items], kind="stable")]


def fill(index: Shard, size: np.ndarray, capacity: int, wanted: np.ndarray | None = None, close: float = 0.25) -> np.ndarray:
    """Container number of each wanted item (none of which exceeds the capacity); -2 of the others.

    The largest unused item is the seed. Its unused neighbours fill the container, best score first, as long as
    they fit; the last quarter of the space goes to the largest item that fits, so that little is left over.
    """
    n = len(size)
    order = np.argsort(-size, kind="stable")
    falling = -size[order]
    free = np.ones(n, bool) if wanted is None else wanted[order].copy()  # by place in the order of sizes
    bins = np.full(n, -1) if wanted is None else np.where(wanted, -1, -2)
    at = np.empty(n, np.int64)
    at[order] = np.arange(n)
    number, room = 0, close * capacity
    indexed = n
    for place in range(n):
        if not free[place]:
            continue
        left_over = int(np.count_nonzero(free))
        if left_over < 0.7 * indexed and left_over > 32:
            index, indexed = index.narrowed(bins == -1), left_over
        seed = order[place]
        free[place], bins[seed] = False, number
        left = capacity - size[seed]
        score = None
        if left > room:
            score = index.scores(seed)
            for pick in best_first(score, np.flatnonzero((score > 0) & (bins == -1) & (size <= left))):
                if size[pick] <= left:
                    free[at[pick]], bins[pick] = False, number
                    left -= size[pick]
                    if left <= room:
                        break
        while left >= 0:
            first = int(np.searchsorted(falling, -left))  # all from here on fit
            ahead = free[first:]
            widest = first + int(ahead.argmax()) if len(ahead) else n
            if widest >= n or not free[widest]:
                break
            if score is not None:
                same = widest + np.flatnonzero(free[widest : int(np.searchsorted(falling, falling[widest], "right"))])
                widest = int(same[np.argmax(score[order[same]])])
            pick = order[widest]
            free[widest], bins[pick] = False, number
            left -= size[pick]
        number += 1
    return bins


ITEM = "row_no long, doc_id long, container string, capacity long, part long, start_token long, tokens long, terms array<int>, counts array<int>"
PLACED = ITEM + ", shard long, bin long, filled long"


def arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.asarray(x if x is not None else [], np.int64) for x in column]


def placed_items(items: pd.DataFrame, bins: np.ndarray, size: np.ndarray, capacity: int, shard: int, keep: float) -> pd.DataFrame:
    """The items with their containers; only those that are packed again keep their terms."""
    filled = np.bincount(bins, size).astype(np.int64)[bins] if len(bins) else np.empty(0, np.int64)
    out = items.assign(tokens=size, shard=shard, bin=bins, filled=filled)
    out.loc[filled >= keep * capacity, ["terms", "counts"]] = None
    return out[[c.split()[0] for c in PLACED.split(", ")]]


def first_packer(kinds: list[tuple[str, int]], held, docs: int, mean: float, keep: float):
    """applyInPandas function over one shard of texts: each kind of container is filled in turn."""

    def run(key: tuple, texts: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values(["row_no", "doc_id"], kind="stable").reset_index(drop=True)
        tokens = texts["tokens"].to_numpy(np.int64)
        whole_index, out = None, []
        for k, (container, capacity) in enumerate(kinds):
            whole = tokens // capacity
            size = tokens - whole * capacity
            wanted = (whole == 0) | (size > 0)
            parts = [r[k] for r in texts["rest"]]
            if any(p is not None for p in parts):  # what is left over of a split text is looked up by its own terms
                own = texts.assign(terms=[t if p is None else p["terms"] for t, p in zip(texts["terms"], parts)], counts=[c if p is None else p["counts"] for c, p in zip(texts["counts"], parts)])
                index = Shard(arrays(own["terms"]), arrays(own["counts"]), held.value, docs, mean)
            else:
                own, index = texts, whole_index or Shard(arrays(texts["terms"]), arrays(texts["counts"]), held.value, docs, mean)
                whole_index = index
            bins = fill(index, size, capacity, wanted)[wanted]
            items = own[wanted].assign(container=container, capacity=capacity, part=whole[wanted], start_token=(whole * capacity)[wanted])
            out.append(placed_items(items, bins, size[wanted], capacity, int(key[0]), keep))
        return pd.concat(out)

    return run


def packer(held, docs: int, mean: float, keep: float):
    """applyInPandas function over one shard of items of one kind of container."""

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["row_no", "doc_id", "part"], kind="stable").reset_index(drop=True)
        index = Shard(arrays(items["terms"]), arrays(items["counts"]), held.value, docs, mean)
        size, capacity = items["tokens"].to_numpy(np.int64), int(items["capacity"].iloc[0])
        return placed_items(items, fill(index, size, capacity), size, capacity, int(key[1]), keep)

    return run


def packed(documents: DataFrame, capacities: DataFrame, vocabulary: str = VOCABULARY, shard: int = SHARD, keep: float = 0.97, rounds: int = 3) -> DataFrame:
    """Put every text into containers of each capacity.

    ``documents``: doc_id, text; ``capacities``: container, capacity_tokens (a short list; those without a positive
    capacity are left out). Result, one row per item and container kind: container, bin (name of the container), doc_id,
    part (0, 1, … of a split text), start_token, tokens, bin_tokens (what its container holds in all).

    A text that exceeds the capacity is split: whole capacities fill containers alone, the rest is an item like others. No other text is split.
    Null and empty texts have no tokens and are items too; repeated rows are items of their own, also under one
    doc_id or none; other columns are ignored; an empty table gives an empty result.

    Items are spread over shards of about ``shard`` rows; each shard has an inverted BM25 index (its terms are the tokenizer's
    tokens, so the table of document counts of the whole corpus is bounded by the vocabulary), which returns the neighbours that fill
    a seed's container.
    Containers filled under ``keep`` are taken apart and packed again with those of other shards, ``rounds`` times in all.

    ``vocabulary`` is the path of a tokenizer's ranks on every executor. Runs jobs: it cuts the lineage at the sizes and each round.
    """
    spark = documents.sparkSession
    kinds = [(r["container"], int(r["capacity_tokens"])) for r in capacities.where("capacity_tokens > 0 and container is not null").select("container", "capacity_tokens").distinct().limit(1001).collect()]
    if len(kinds) > 1000:
        raise ValueError("capacities is to be a short list")
    if not kinds:
        return spark.createDataFrame([], "container string, bin string, doc_id long, part long, start_token long, tokens long, bin_tokens long")
    doc = F.col("doc_id").cast("bigint")
    numbered = documents.select(F.xxhash64(doc, "text").alias("row_no"), doc.alias("doc_id"), "text")  # the same however the table is read
    sized = cut(numbered.mapInArrow(sizes(vocabulary, [n for _, n in sorted(kinds)]), f"row_no long, doc_id long, tokens long, {TERMS}, rest array<struct<{TERMS.replace(' ', ':', 1).replace(', counts ', ',counts:')}>>"))
    docs, total = sized.agg(F.count("*"), F.sum(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
    counted = sized.select(F.explode("terms").alias("t")).groupBy("t").count().collect()  # at most a row per token of the vocabulary
    held = np.zeros(max((r["t"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        held[r["t"]] = r["count"]
    shared = spark.sparkContext.broadcast(held)
    kind = F.array(*(F.struct(F.lit(c).alias("container"), F.lit(n).cast("bigint").alias("capacity")) for c, n in sorted(kinds)))
    each = sized.select("row_no", "doc_id", "tokens", F.inline(kind))  # a fixed number of rows a text, one for each capacity
    whole = F.floor(F.col("tokens") / F.col("capacity"))
    chunk = F.transform(F.sequence(F.lit(0).cast("bigint"), whole - 1), lambda k: F.struct(k.alias("part"), (k * F.col("capacity")).alias("start_token"), F.col("capacity").alias("tokens")))
    chunks = F.when(whole > 0, chunk).otherwise(F.array().cast("array<struct<part:bigint,start_token:bigint,tokens:bigint>>"))
    done = each.where(whole > 0).select("container", "row_no", "doc_id", F.inline(chunks), F.col("capacity").alias("bin_tokens"))
    # rows that are the same in all are told apart by counting them; the window passes over them in a stream
    done = done.withColumn("copy", F.row_number().over(W.partitionBy("container", "row_no", "part").orderBy("doc_id")))
    done = done.select("container", F.concat_ws(" ", F.lit("full"), "row_no", "part", "copy").alias("bin"), "doc_id", "part", "start_token", "tokens", "bin_tokens")
    mean = float((total or 0) / max(docs, 1))
    items, count = sized, docs
    for round_no in range(rounds):
        limit = 0.0 if round_no == rounds - 1 else keep
        sharded = items.withColumn("_shard", F.pmod(F.xxhash64("row_no", F.lit(round_no)), F.lit(max(1, -(-count // shard)))))
        if round_no == 0:
            placed = sharded.groupBy("_shard").applyInPandas(first_packer(sorted(kinds), shared, docs, mean, limit), PLACED)
        else:
            placed = sharded.groupBy("container", "_shard").applyInPandas(packer(shared, docs, mean, limit), PLACED)
        placed = cut(placed)
        full = F.col("filled") >= limit * F.col("capacity")
        name = F.concat_ws(" ", F.lit(str(round_no)), "shard", "bin")
        done = done.unionByName(placed.where(full).select("container", name.alias("bin"), "doc_id", "part", "start_token", "tokens", F.col("filled").alias("bin_tokens")))
        items = placed.where(~full).drop("shard", "bin", "filled")
        count = items.groupBy("container").count().agg(F.max("count")).first()[0] or 0
        if not count:
            break
    return done
