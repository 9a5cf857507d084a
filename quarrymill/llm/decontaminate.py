"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of question and answer.

Spark counts the items' terms, cuts the items into shards of a bounded number of postings and builds each shard's inverted
index in a task, as arrays. One shard at a time is broadcast, so the broadcast is bounded whatever the benchmark's size, and
every training passage is queried against every shard. Impacts are divided by the item's score for itself, so one
threshold serves items of all lengths: 1 is a passage with all the item's terms.

A passage's bounds (sums of its terms' block maxima) are taken for all blocks at once and tell which blocks may hold an
item above the threshold. In these, cursors over the terms' postings move by the pivot rule: the cursors in order of their
items, the first whose summed term maxima reach the threshold is the pivot; cursors before it skip to its item, all skip
over a block that the bounds exclude, and an item that the first cursor has reached is scored.
"""

from __future__ import annotations

import math
import pickle
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Term occurrences in one shard of the index, on average half of it: some 60 bytes each.
SHARD_TERMS = 200_000
#: Bytes of text that are cut into words at a time; half passages in a piece of a text; sums of bounds held at a time.
SLICE, PIECE, HELD = 1 << 20, 256, 1 << 20
#: BM25's usual constants; items in a block of the index; slack for rounding in sums of bounds.
K1, B, ITEMS, SLACK = 1.2, 0.75, 4, 1e-9
#: Retrieval threshold as a share of the item's own score; overlap that a match needs; words in a shingle.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z lower-cased.
WORD_SQL = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def shingles(words: list[bytes]) -> set[bytes]:
    """Five-word shingles; fewer words count as one shingle, none give the empty set."""
    if not words:
        return set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def question_and_answer(text: bytes) -> tuple[set[bytes], set[bytes]]:
    """Shingles of the item without its last sentence, and of the last sentence; one sentence is both."""
    sentences = [w for s in re.split(rb"(?<=[.?!])\s+", text.strip()) if (w := words_of(s))]
    if len(sentences) < 2:
        whole = shingles(words_of(text))
        return whole, whole
    return shingles([w for s in sentences[:-1] for w in s]), shingles(sentences[-1])


def hashes(found: set[bytes]) -> np.ndarray:
    """Sorted 64-bit hashes of shingles."""
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(x) for x in found), dtype=np.uint64, count=len(found)))


def pointers(lengths: list[int]) -> np.ndarray:
    return np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(lengths, dtype=np.int64)])


def built(items: list[tuple[int | None, bytes, dict[bytes, int]]], count: int, mean: float) -> bytes:
    """One shard of the index as pickled arrays, from items (id, text, document frequency of its terms)."""
    items = sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    lists: dict[bytes, list[tuple[int, float]]] = {}
    longest = SHINGLE
    for at, (_, text, frequency) in enumerate(items):
        words = words_of(text)
        longest = max(longest, len(words))
        weight = {}
        for term, tf in Counter(words).items():
            idf = math.log(1 + (count - frequency[term] + 0.5) / (frequency[term] + 0.5))
            weight[term] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean))
        own = sum(weight.values())
        for term, w in weight.items():
            lists.setdefault(term, []).append((at, w / own))
    blocks = [sorted({at // ITEMS for at, _ in postings}) for postings in lists.values()]
    maxima = [
        max(w for at, w in postings if at // ITEMS == block)
        for own, postings in zip(blocks, lists.values(), strict=True)
        for block in own
    ]
    parts = [(*question_and_answer(text), shingles(words_of(text))) for _, text, _ in items]
    arrays = {
        "ids": [i for i, _, _ in items],
        "terms": list(lists),
        "step": longest,  # passages of twice the longest item at steps of its length hold every item that stands in a text
        "block_pointer": pointers([len(x) for x in blocks]),
        "block": np.array([x for own in blocks for x in own], dtype=np.int64),
        "block_maximum": np.array(maxima, dtype=np.float64),
        "pointer": pointers([len(x) for x in lists.values()]),
        "item": np.array([at for x in lists.values() for at, _ in x], dtype=np.int64),
        "impact": np.array([w for x in lists.values() for _, w in x], dtype=np.float64),
        "shingles": [tuple(map(hashes, part)) for part in parts],  # of question, answer and whole
        "short": [b" %b " % next(iter(part[2])) if len(part[2]) == 1 else None for part in parts],
    }
    return pickle.dumps(arrays)


def pieces(text: bytes, step: int) -> Iterator[tuple[int, list[bytes]]]:
    """A text's words in pieces of PIECE + 1 half passages of step words, the last half of one the first of the next.

    Gives the number of a piece's first half and its words. Words are cut from slices of the text, whatever its length.
    """
    folded = text.translate(_FOLD)
    held: list[bytes] = []
    first = at = 0
    while at < len(folded):
        end = folded.find(b" ", at + SLICE)
        end = len(folded) if end < 0 else end
        held += folded[at:end].split()
        at = end
        while len(held) > (PIECE + 1) * step:
            yield first, held[: (PIECE + 1) * step]
            held = held[PIECE * step :]
            first += PIECE
    if held:
        yield first, held


class Index:
    """One shard of the inverted index, opened for queries."""

    def __init__(self, blob: bytes) -> None:
        self.__dict__.update(pickle.loads(blob))
        self.number = {term: n for n, term in enumerate(self.terms)}
        self.blocks = math.ceil(len(self.ids) / ITEMS)
        self.items, self.impacts, self.ends = self.item.tolist(), self.impact.tolist(), self.pointer.tolist()
        self.most = np.maximum.reduceat(self.impact, self.pointer[:-1]).tolist()

    def above(self, terms: list[int], blocks: list[int]) -> list[tuple[int, float]]:
        """All (item, score) with the threshold at least in the given blocks (rising), by cursors and pivots."""
        items, most, goal = self.items, self.most, THRESHOLD - SLACK
        allowed, until = set(blocks), (blocks[-1] + 1) * ITEMS
        cursors = []  # (item, place, end of the list, term)

        def put(target: int, place: int, end: int, term: int) -> None:
            place = bisect_left(items, target, place, end)
            if place < end and items[place] < until:
                cursors.append((items[place], place, end, term))

        for term in terms:
            put(blocks[0] * ITEMS, self.ends[term], self.ends[term + 1], term)
        found = []
        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, cursor in enumerate(cursors):
                total += most[cursor[3]]
                if total >= goal:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            moved, cursors = cursors[: pivot + 1], cursors[pivot + 1 :]
            if item // ITEMS not in allowed:
                following = bisect_left(blocks, item // ITEMS)
                if following == len(blocks):
                    break
                target = blocks[following] * ITEMS
            elif moved[0][0] == item:
                score = sum(self.impacts[place] for _, place, _, _ in moved)
                if score >= goal:
                    found.append((item, score))
                target = item + 1
            else:
                target = item
            for _, place, end, term in moved:
                put(target, place, end, term)
        return found

    def overlaps(self, item: int, words: list[bytes], held: np.ndarray) -> tuple[float, float, float]:
        """Shares of the whole item's, its question's and its answer's shingles that a passage (words, shingles) has."""
        if (short := self.short[item]) is not None:  # an item of five words or fewer: its words in a row
            return (float(short in b" %b " % b" ".join(words)),) * 3
        share = lambda x: float(np.isin(x, held, assume_unique=True).mean())
        question, answer, whole = self.shingles[item]
        return share(whole), share(question), share(answer)

    def query(self, batch: list[tuple[int, int, list[bytes]]]) -> Iterator[tuple[int, tuple]]:
        """(text's number, match) for pieces (text's number, first half, words): every passage against every item."""
        step, size = self.step, len(self.terms)
        get = self.number.get
        ids = np.fromiter((get(w, -1) for _, _, words in batch for w in words), dtype=np.int64)
        lengths = np.array([len(words) for _, _, words in batch])
        counts = -(-lengths // step)
        base = np.cumsum(counts) - counts
        place = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        half = np.repeat(base, lengths) + place // step
        total = int(counts.sum())
        # Distinct terms of each half passage, and the sums of their block maxima.
        halves, terms = np.divmod(np.unique((half * size + ids)[ids >= 0]), size)
        cuts = np.searchsorted(halves, np.arange(total + 1))
        sums = np.zeros(total * self.blocks)
        wide = self.block_pointer[terms + 1] - self.block_pointer[terms]
        steps = np.cumsum(wide)
        for at in range(0, int(steps[-1]) + 1 if len(steps) else 0, HELD):
            s, e = np.searchsorted(steps, [at, at + HELD])
            n = wide[s:e]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.block_pointer[terms[s:e]], n)
            sums += np.bincount(np.repeat(halves[s:e], n) * self.blocks + self.block[within], self.block_maximum[within], len(sums))
        sums = sums.reshape(total, self.blocks)
        owner = np.repeat(np.arange(len(batch)), counts)
        last = np.append(owner[1:] != owner[:-1], True)
        bounds = sums + np.where(last[:, None], 0.0, np.roll(sums, -1, axis=0))
        # A piece's last half is a passage of its own only where the piece has no other.
        bounds[last & (np.repeat(counts, counts) > 1)] = 0.0
        passages, blocks = np.nonzero(bounds >= THRESHOLD - SLACK)
        edges = np.flatnonzero(np.diff(passages, prepend=-1)).tolist()
        for s, e in zip(edges, [*edges[1:], len(passages)] if edges else [], strict=True):
            k = int(passages[s])
            own = terms[cuts[k] : cuts[k + 1 if last[k] else k + 2]]
            found = self.above(np.unique(own).tolist(), blocks[s:e].tolist())
            if found:
                number, first, words = batch[owner[k]]
                a = int(k - base[owner[k]])
                passage = words[a * step : (a + 2) * step]
                held = hashes(shingles(passage))
                for item, score in found:
                    whole, question, answer = self.overlaps(item, passage, held)
                    if whole >= OVERLAP or (question >= OVERLAP and answer >= OVERLAP):
                        yield number, (item, (first + a) * step, score, whole, question, answer)

    def matches(self, texts: list[bytes | None]) -> list[list[tuple]]:
        """Per text: (item_id, word offset of the passage, BM25 share, overlap, question overlap, answer overlap), best per item."""
        best: list[dict[int, tuple]] = [{} for _ in texts]
        batch: list[tuple[int, int, list[bytes]]] = []
        most = max(1, HELD // self.blocks)

        def flush() -> None:
            for number, (item, *row) in self.query(batch):
                old = best[number].get(item)
                if old is None or (row[2], row[1]) > (old[3], old[2]):
                    best[number][item] = (self.ids[item], *row)
            batch.clear()

        waiting = 0
        for number, text in enumerate(texts):
            for first, words in pieces(text or b"", self.step):
                batch.append((number, first, words))
                waiting += -(-len(words) // self.step)
                if waiting >= min(most, 4 * PIECE):
                    flush()
                    waiting = 0
        if batch:
            flush()
        return [sorted(b.values(), key=lambda row: (row[0] is None, row[0] or 0, *row[1:])) for b in best]


@lru_cache(1)
def opened(blob: bytes) -> Index:
    """One shard per Python worker at a time."""
    return Index(blob)


def indexes(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The items' index in shards of some SHARD_TERMS term occurrences at most: columns shard, blob, built by tasks.

    An item is a distinct row of id and text; a null id is kept. Statistics (document frequencies, mean length) are those of
    all items, so sharding changes no score. Items without words are left out.
    """
    items = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null").distinct()
    sized = common.materialise(items.withColumn("words", F.regexp_count("text", F.lit(WORD_SQL))).where("words > 0"))
    count, total = sized.agg(F.count(F.lit(1)), F.sum("words")).first()
    shards = max(1, math.ceil((total or 0) / (0.5 * SHARD_TERMS))) if (total or 0) > SHARD_TERMS else 1
    sized = sized.select(F.pmod(F.xxhash64("item", "text"), F.lit(shards)).cast("int").alias("shard"), "item", "text")
    listed = F.array_distinct(F.regexp_extract_all(common.ascii_lower(F.col("text")), F.lit(WORD_SQL), F.lit(0)))
    terms = sized.select("*", F.explode(listed).alias("term"))
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = terms.join(frequency, "term").groupBy("shard", "item", "text").agg(F.collect_list(F.struct("term", "df")).alias("terms"))
    mean = (total or 0) / max(1, count)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        own = [
            (None if pd.isna(i) else int(i), text.encode(), {t["term"].encode(): t["df"] for t in terms})
            for i, text, terms in zip(rows["item"], rows["text"], rows["terms"], strict=True)
        ]
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "blob": [built(own, count, mean)]})

    # Ids travel as text: pandas would make floats of a column with nulls.
    known = known.withColumn("item", F.col("item").cast("string"))
    return common.materialise(known.groupBy("shard").applyInPandas(build, "shard int, blob binary"))


MATCH = "array<struct<item_id:bigint,passage_start:bigint,bm25:double,overlap:double,question_overlap:double,answer_overlap:double>>"
NAMES = ("item_id", "passage_start", "bm25", "overlap", "question_overlap", "answer_overlap")


def finders(items: DataFrame) -> list:
    """One function from a text column to its matches for each shard; the driver holds one shard at a time."""
    spark, shards = items.sparkSession, indexes(items)

    def finder(k: int):
        shared = spark.sparkContext.broadcast(bytes(shards.where(F.col("shard") == k).first().blob))

        @F.pandas_udf(MATCH)
        def find(texts: pd.Series) -> pd.Series:
            found = opened(shared.value).matches(texts.tolist())
            return pd.Series([[dict(zip(NAMES, m, strict=True)) for m in own] for own in found], dtype=object)

        return lambda text: find(text.cast("binary"))

    return [finder(r.shard) for r in shards.select("shard").orderBy("shard").collect()]


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row and benchmark item (distinct row of id and text; the id may be null) found in it.

    A match needs a BM25 share of THRESHOLD in some passage and 0.8 of the item's five-word shingles there, or of its
    question's and of its answer's (last sentence). Null and empty texts, and empty items, match nothing; repeated documents
    give repeated rows; a null id stays null; no items or no documents give no rows. Each shard is a pass over the documents
    of its own, so a task holds one shard.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    passes = [rows.select("doc_id", F.explode(find(F.col("text"))).alias("m")).select("doc_id", "m.*") for find in finders(items)]
    none = rows.select("doc_id", F.explode(F.array().cast(MATCH)).alias("m")).select("doc_id", "m.*")
    return reduce(DataFrame.union, passes) if passes else none


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item was found, whole.

    With one shard this is a filter. With more, each shard's pass names the texts that hold an item (by two hashes), and the
    documents with those texts go.
    """
    passes = finders(items)
    if not passes:
        return docs
    if len(passes) == 1:
        found = docs.withColumn("_qm_found", passes[0](docs[text_col]))
        return found.where(F.size("_qm_found") == 0).drop("_qm_found")
    key = F.struct(F.xxhash64(text_col).alias("x"), F.xxhash64(text_col, F.lit(13)).alias("y")).alias("_qm_key")
    held = [docs.where(F.size(find(docs[text_col])) > 0).select(key) for find in passes]
    return docs.withColumn("_qm_key", key).join(common.materialise(reduce(DataFrame.union, held).distinct()), "_qm_key", "left_anti").drop("_qm_key")


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
