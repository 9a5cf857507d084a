"""Token counts by byte-pair merging, with no identifiers emitted.

Every piece of text (as the vocabulary's splitting pattern cuts it) is a linked list of byte symbols and a heap of its
adjacent pairs by merge rank. The lowest-rank pair is popped and merged until none is left; a piece's count is its initial
symbols minus its merges. Pieces repeat, so each Python worker remembers the counts of short ones, in bounded memory.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache
from pathlib import Path

import pandas as pd
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: How byte-level vocabularies of this family cut a text before merging.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Pieces remembered by a worker, and the longest piece (in characters) that is.
REMEMBERED, SHORT = 500_000, 48
#: Bits of a symbol in a pair's number, and of a place in a heap entry.
PAIR, PLACE = 20, 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 stands for itself, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Merger:
    """Merge ranks and special strings of one vocabulary file."""

    def __init__(self, path: str) -> None:
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["model"]["merges"]]
        number: dict[str, int] = {s: b for b, s in enumerate(byte_symbols())}
        #: Rank of a pair, by both symbols in one integer; the symbol that a rank makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(merges):
            self.made.append(number.setdefault(a + b, len(number)))
            self.ranks.setdefault(number[a] << PAIR | number[b], rank)
        special = sorted((t["content"] for t in held["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.remembered = lru_cache(REMEMBERED)(self.piece)

    def piece(self, text: str) -> int:
        """Symbols left of one piece after all merges."""
        symbol = list(text.encode("utf-8", "surrogatepass"))
        n = len(symbol)
        get, made = self.ranks.get, self.made
        pairs = [get(a << PAIR | b) for a, b in zip(symbol, symbol[1:], strict=False)]
        heap = [rank << PLACE | i for i, rank in enumerate(pairs) if rank is not None]
        heapq.heapify(heap)
        pairs.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = 0
        while heap:
            rank, i = divmod(heapq.heappop(heap), 1 << PLACE)
            if pairs[i] != rank:
                continue  # one of the two has been merged meanwhile
            merges += 1
            j = after[i]
            symbol[i] = whole = made[rank]
            after[i] = k = after[j]
            pairs[j] = pairs[i] = None
            if k < n:
                before[k] = i
                pairs[i] = found = get(whole << PAIR | symbol[k])
                if found is not None:
                    heapq.heappush(heap, found << PLACE | i)
            k = before[i]
            if k >= 0:
                pairs[k] = found = get(symbol[k] << PAIR | whole)
                if found is not None:
                    heapq.heappush(heap, found << PLACE | k)
        return n - merges

    def plain(self, text: str) -> int:
        remembered, piece = self.remembered, self.piece
        return sum([remembered(p) if len(p) <= SHORT else piece(p) for p in PIECES.findall(text)])

    def count(self, text: str | None) -> int:
        """Tokens of a text; a special string inside it is one token."""
        if not text:
            return 0
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        return sum(map(self.plain, self.special.split(text))) + len(self.special.findall(text))


@lru_cache(2)
def merger(path: str) -> Merger:
    """One per Python worker and file."""
    return Merger(path)


def token_count(spark, text: Column, vocabulary: str) -> Column:
    """Tokens of a text under a byte-level BPE vocabulary file, which is sent to the executors by Spark. Null: 0."""
    spark.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        counter = merger(SparkFiles.get(name))
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    return count(text)


def counted(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: its id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).

    Null and empty texts have 0 bytes and tokens; null ids and repeated rows stay as they are; other columns are left out.
    """
    text = F.col(text_col)
    return docs.select(
        F.col(id_col),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(docs.sparkSession, text, vocabulary).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(common.table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
