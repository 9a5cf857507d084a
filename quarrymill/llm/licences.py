"""License scans: fuzzy search for short notices.

A text is reduced to its words. A notice that may have k errors is split into k + 1 pieces; a place with k errors at most
holds one of them unchanged (pigeonhole), so exact search for the pieces finds every candidate. The regex library's
bounded-error matching then verifies the surroundings of each candidate by itself and reports the span.
"""

from __future__ import annotations

from functools import cache
from heapq import heapify, heappop, heappush
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Base phrases, which count without errors only. Fixed values.
BASE = {"mit": b"under the mit license", "apache-2": b"apache license version 2", "cc-by-nc": b"cc by nc"}
#: Notices that are searched with errors, by label. Fixed values.
NOTICES = {
    "agpl-3": b"gnu affero general public license version 3",
    "apache-2": b"licensed under the apache license version 2 0",
    "artistic-2": b"the artistic license 2 0",
    "bsd": b"redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by": b"creative commons attribution 4 0 international",
    "cc-by-nc": b"licensed under cc by nc 4 0",
    "cc-by-sa": b"creative commons attribution sharealike",
    "cc0": b"creative commons zero",
    "gpl-2": b"gnu general public license version 2",
    "gpl-3": b"gnu general public license version 3",
    "isc": b"permission to use copy modify and or distribute this software for any purpose",
    "lgpl": b"gnu lesser general public license",
    "mit": b"released under the mit license",
    "mpl-2": b"mozilla public license version 2",
    "reserved": b"all rights reserved",
    "unlicense": b"free and unencumbered software released into the public domain",
}
#: One error for so many characters of a notice, and at most so many.
CHARS_PER_ERROR, MOST_ERRORS = 12, 4
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


class Notice(NamedTuple):
    label: str
    text: bytes
    errors: int
    seeds: tuple[tuple[bytes, int], ...]  # the pieces and their places in the notice
    pattern: regex.Pattern


@cache
def notices() -> tuple[Notice, ...]:
    found = []
    for label, text in NOTICES.items():
        errors = min(MOST_ERRORS, len(text) // CHARS_PER_ERROR)
        cuts = [round(i * len(text) / (errors + 1)) for i in range(errors + 2)]
        seeds = tuple((text[a:z], a) for a, z in zip(cuts, cuts[1:], strict=False))
        pattern = regex.compile(rb"(?b)(?:" + regex.escape(text) + rb"){e<=" + str(errors).encode() + rb"}")
        found.append(Notice(label, text, errors, seeds, pattern))
    return tuple(found)


class Found(NamedTuple):
    label: str
    first_word: int
    last_word: int
    errors: int
    score: float


def places(text: bytes, phrase: bytes) -> list[int]:
    found, at = [], text.find(phrase)
    while at >= 0:
        found.append(at)
        at = text.find(phrase, at + 1)
    return found


def words_before(text: bytes, offsets: list[int]) -> list[int]:
    """Number of spaces before each offset: the places of the spaces are taken once for a text."""
    spaces = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
    return np.searchsorted(spaces, np.array(offsets, dtype=np.int64)).tolist()


def best_in(notice: Notice, words: bytes, a: int, z: int) -> tuple | None:
    """The notice's best place between two offsets, as an entry of fuzzy()'s heap; None where there is none."""
    if z - a < len(notice.text) - notice.errors or not (m := notice.pattern.search(words, a, z)):
        return None
    errors = sum(m.fuzzy_counts)
    return (errors / len(notice.text), -len(notice.text), m.start(), notice.label, m.end(), errors, a, z)


def fuzzy(words: bytes) -> list[Found]:
    """Notices in a text of single-spaced words; where two overlap the one with the better score stays.

    Each place lies in the window of each of its seeds. The best place of all windows is kept; what is left of a window beside
    the kept places is searched again until nothing is found, so no place hides a worse one that it doesn't overlap. A window
    is as long as its notice and the errors on both sides, so the work grows with the number of seeds found.
    """
    by_label = {n.label: n for n in notices()}
    heap: list[tuple] = []
    for notice in by_label.values():
        starts = {at - offset for seed, offset in notice.seeds for at in places(words, seed)}
        for start in starts:
            a, z = max(0, start - notice.errors), min(len(words), start + len(notice.text) + notice.errors)
            if one := best_in(notice, words, a, z):
                heap.append(one)
    heapify(heap)
    covered = bytearray(len(words)) if heap else bytearray()  # 1 where a kept place stands
    kept: list[tuple] = []
    while heap:
        share, _, start, label, end, errors, a, z = heappop(heap)
        if covered.find(1, start, end) < 0:
            covered[start:end] = b"\x01" * (end - start)
            kept.append((1 - share, start, end, by_label[label], errors))
        # The parts of the window that no kept place covers.
        at = covered.find(0, a, z)
        while at >= 0:
            to = covered.find(1, at, z)
            if one := best_in(by_label[label], words, at, to if to >= 0 else z):
                heappush(heap, one)
            at = covered.find(0, to, z) if to >= 0 else -1
    edges = [x for _, a, z, _, _ in kept for x in (a + words.startswith(b" ", a), z)]
    if not edges:
        return []
    counts = words_before(words, [x for a, z in zip(edges[::2], edges[1::2], strict=True) for x in (a, max(a, z - 1))])
    found = [
        Found(notice.label, first, last, errors, score)
        for (score, _, _, notice, errors), first, last in zip(kept, counts[::2], counts[1::2], strict=True)
    ]
    return sorted(found, key=lambda f: (f.first_word, f.label))


def scan(text: bytes | None) -> tuple:
    """(n_words, base places as (label, first word), notices found) of one text."""
    words = text.translate(_FOLD).split() if text else []
    if not words:
        return 0, [], []
    whole = b" ".join(words)
    edged = b" " + whole + b" "
    hits = [(label, at) for label, phrase in BASE.items() for at in places(edged, b" " + phrase + b" ")]
    starts = words_before(edged, [at for _, at in hits]) if hits else []
    base = [(label, start) for (label, _), start in zip(hits, starts, strict=True)]
    return len(words), sorted(base, key=lambda b: b[1]), fuzzy(whole)


SCAN = (
    "n_words bigint, base array<struct<label:string,first_word:bigint>>, "
    "found array<struct<label:string,first_word:bigint,last_word:bigint,errors:int,score:double>>"
)


def licence_scan(text: Column) -> Column:
    """Struct of n_words, base (exact phrases) and found (notices with at most their bounded errors, and spans in words)."""

    @F.pandas_udf(f"struct<{', '.join(x.replace(' ', ':', 1) for x in SCAN.split(', '))}>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [scan(t) for t in texts]
        return pd.DataFrame(
            {
                "n_words": pd.Series([n for n, _, _ in rows], dtype="int64"),
                "base": pd.Series([[{"label": x, "first_word": w} for x, w in b] for _, b, _ in rows], dtype=object),
                "found": pd.Series([[f._asdict() for f in found] for _, _, found in rows], dtype=object),
            }
        )

    return run(text.cast("binary"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, base and found (see licence_scan).

    Null and empty texts have no words and nothing found. Null ids and repeated rows stay. Equally good overlapping notices:
    the longer one, then the first. An empty table gives no rows.
    """
    out = docs.select(F.col(id_col).alias("id"), licence_scan(F.col(text_col)).alias("s"))
    return out.select("id", "s.*")


def op7_licences(spark, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["first_word"])
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    every = F.array_sort(
        F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), F.transform("found", lambda f: f["label"])))
    )
    best = F.array_max(F.transform("found", lambda f: f["score"]))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
        F.array_join(
            F.transform("found", lambda f: F.concat_ws(":", f["label"], f["first_word"], f["last_word"], f["errors"])), ","
        ).alias("notices"),
    )
