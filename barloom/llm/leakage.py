"""Problem 9: evaluation texts in a training corpus, by a prefix-filtered set join."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.common import cut
from barloom.llm.words import readings_of, words_of

WINDOW = 12  # consecutive words that make a passage
SHINGLE = 5  # words of a token of the join
#: Characters of all items together up to which their distinct shingles (a number each) and words are sent to every executor. A shingle begins at
#: each word, so 4 M characters are under a million numbers and words: some 150 MB in a Python process. Beyond it tokens are joined by a shuffle.
BROADCAST_CHARS = 4_000_000


def shingles(words: list[str], size: int = SHINGLE) -> list[int]:
    """64-bit hashes of the shingles, in order; a hash that two shingles share is found out by the exact check."""
    digest = xxhash.xxh3_64_intdigest
    return [digest(" ".join(words[p : p + size])) - (1 << 63) for p in range(len(words) - size + 1)]


def shared(words: list[str], vocabulary: frozenset[str], size: int = SHINGLE) -> Iterator[tuple[int, int]]:
    """Place and hash of the shingles whose words all belong to the vocabulary: no other can be wanted, and most words of
    a corpus end a run, so few are hashed."""
    digest = xxhash.xxh3_64_intdigest
    ends = [-1, *[p for p, w in enumerate(words) if w not in vocabulary], len(words)]
    for before, end in zip(ends, ends[1:]):
        for p in range(before + 1, end - size + 1):
            yield p, digest(" ".join(words[p : p + size])) - (1 << 63)


def item_windows(window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each item's windows with their shingles: item_id, start, sh, place (of the shingle in the window), passage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item_id"], batch["text"]):
                words = words_of(text)
                sh = shingles(words)
                for start in range(len(words) - window + 1):
                    passage = " ".join(words[start : start + window])
                    rows += [(item, start, sh[start + k], k, passage) for k in range(window - SHINGLE + 1)]
            yield pd.DataFrame(rows, columns=["item_id", "start", "sh", "place", "passage"])

    return run


def counter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents that hold each shingle, summed per batch before anything is shuffled."""
    for batch in batches:
        seen: Counter[int] = Counter()
        for text in batch["text"]:
            seen.update({s for words in readings_of(text) for s in shingles(words)})
        yield pd.DataFrame({"sh": pd.Series(list(seen.keys()), dtype="int64"), "n": pd.Series(list(seen.values()), dtype="int64")})


FOUND = "doc_id long, words array<string>, lead int, tokens array<long>, sh long, n long"
PIECE = 64  # tokens of a stretch in a row, so that a long one isn't repeated whole for each of its tokens


def pieces(doc: int, words: list[str], tokens: list[int], window: int) -> Iterator[tuple]:
    """A stretch (its words and tokens) in rows of PIECE tokens, each with the words that windows about them can have; lead: words before the first token."""
    before = window - SHINGLE
    for low in range(0, len(tokens), PIECE):
        start = max(0, low - before)
        yield doc, words[start : low + PIECE + window - 1], low - start, tokens[low : low + PIECE], None, None


def finder(wanted, window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """One pass over the corpus for both sides of the join: how many documents hold each wanted shingle (sh, n; summed per batch), and the
    stretches of text that consist of wanted shingles and are long enough for a window (doc_id, words, tokens: their shingles in order)."""
    least = window - SHINGLE + 1  # a window has so many shingles, all of them wanted

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep, vocabulary = wanted.value
        for batch in batches:
            seen: Counter[int] = Counter()
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                held: set[int] = set()
                for words in readings_of(text):
                    at, tokens = -1, []  # of the stretch that is being read
                    for p, s in shared(words, vocabulary):
                        if s not in keep:
                            continue
                        held.add(s)
                        if p != at + len(tokens):
                            if len(tokens) >= least:
                                rows += pieces(doc, words[at : at + len(tokens) + SHINGLE - 1], tokens, window)
                            at, tokens = p, []
                        tokens.append(s)
                    if len(tokens) >= least:
                        rows += pieces(doc, words[at : at + len(tokens) + SHINGLE - 1], tokens, window)
                seen.update(held)
            rows += [(None, None, None, None, s, n) for s, n in seen.items()]
            yield pd.DataFrame(rows, columns=["doc_id", "words", "lead", "tokens", "sh", "n"], dtype=object).astype({"doc_id": "Int64", "lead": "Int32", "sh": "Int64", "n": "Int64"})

    return run


def vocabulary_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"word": sorted({w for text in batch["text"] for w in words_of(text)})}, dtype=object)


def spelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All shingles of a document with their places, for the join by a shuffle: doc_id, reading, at, n, sh."""
    for batch in batches:
        for doc, text in zip(batch["doc_id"], batch["text"]):
            for reading, words in enumerate(readings_of(text)):
                sh = shingles(words)
                for low in range(0, len(sh), 20_000):  # bounds the memory of a very long text
                    part = sh[low : low + 20_000]
                    yield pd.DataFrame({"doc_id": doc, "reading": reading, "at": range(low, low + len(part)), "n": len(words), "sh": part})


def verifier(window: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = set()
            for doc, text, candidates in zip(batch["doc_id"], batch["text"], batch["candidates"]):
                read = readings_of(text)
                for c in candidates:
                    if " ".join(read[c["reading"]][c["from"] : c["from"] + window]) == c["passage"]:
                        found.add((doc, c["item_id"]))
            yield pd.DataFrame(sorted(found), columns=["doc_id", "item_id"]).astype("int64")

    return run


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """Documents that hold ``window`` consecutive words of an item: (doc_id, item_id), each pair once.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are ignored. Null ids or texts and items of
    under ``window`` words match nothing; empty tables give an empty result; repeated rows change nothing.

    An item's windows are the sets to be found, their five-word shingles the tokens. As a window must be contained whole,
    its prefix is one token long: the one that the fewest documents hold (counted over the whole corpus). Windows with
    a token that no document holds are dropped at once. Documents are joined with prefix tokens only; a hit must
    leave room for the window before and after it, and is verified word by word.

    Runs jobs: the items' size; up to ``broadcast_chars`` also their distinct shingles and words, whose number that size bounds: they are sent
    to the executors, so that one pass over the corpus gives the counts and the stretches of text that can hold a window; only
    these, which are cut off with a checkpoint, are joined with the windows' prefix tokens. Beyond it all tokens are joined by a shuffle.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    tests = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    windows = tests.mapInPandas(item_windows(window), "item_id long, start int, sh long, place int, passage string")
    chars = tests.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    if chars <= broadcast_chars:
        return leaks_small(docs, tests, windows, window)
    return leaks_shuffled(docs, windows, window)


def prefixes_of(windows: DataFrame, held: DataFrame) -> DataFrame:
    """Each window's prefix: the one token that the fewest documents hold; windows with a token that none holds are dropped."""
    ranked = windows.join(held, "sh", "left").groupBy("item_id", "start").agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "sh", "place", "passage")).alias("p"))
    return ranked.where("p.n > 0").select("item_id", F.col("p.sh").alias("sh"), F.col("p.place").alias("place"), F.col("p.passage").alias("passage"))


def leaks_small(docs: DataFrame, tests: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    shs = windows.select("sh").distinct().toArrow().column("sh").to_pylist()
    words = tests.select("text").mapInPandas(vocabulary_of, "word string").distinct().toArrow().column("word").to_pylist()
    found = cut(docs.mapInPandas(finder(context.broadcast((frozenset(shs), frozenset(words))), window), FOUND))
    held = found.where("sh is not null").groupBy("sh").agg(F.sum("n").alias("n"))
    stretches = found.where("doc_id is not null").select("doc_id", "words", "lead", F.posexplode("tokens").alias("at", "sh"))
    hits = stretches.join(prefixes_of(windows, held), "sh").withColumn("from", F.col("lead") + F.col("at") - F.col("place"))
    inside = hits.where((F.col("from") >= 0) & (F.col("from") + window <= F.size("words")))  # positional and length bounds
    same = F.array_join(F.slice("words", F.col("from") + 1, window), " ") == F.col("passage")
    return inside.where(same).select("doc_id", "item_id").distinct()


def leaks_shuffled(docs: DataFrame, windows: DataFrame, window: int) -> DataFrame:
    spread = docs.mapInPandas(spelled, "doc_id long, reading int, at int, n int, sh long")
    held = docs.select("text").mapInPandas(counter, "sh long, n long").groupBy("sh").agg(F.sum("n").alias("n"))
    prefixes = prefixes_of(windows, held)
    start = F.col("at") - F.col("place")
    hits = spread.join(prefixes, "sh").where((start >= 0) & (start + window <= F.col("n")))
    hits = hits.select("doc_id", F.struct("item_id", "reading", start.alias("from"), "passage").alias("c")).distinct()
    # at most one candidate per window and place: a document's own length times the items that share its tokens
    grouped = hits.groupBy("doc_id").agg(F.collect_list("c").alias("candidates"))
    return docs.join(grouped, "doc_id").mapInPandas(verifier(window), "doc_id long, item_id long").distinct()
