"""Identifiers of texts under a word-level byte-pair vocabulary file, with each distinct word encoded once.

Such a vocabulary drops white space, so a text's identifiers are those of its words one after the other. Arrow finds the
distinct words of many texts; those of Latin letters are merged many at a time, one merge of each word a round; words with
other signs are cut first, and whatever isn't plain goes to the tokenizers library, which the tests hold all results against.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .tokens import byte_symbols

#: Words of Latin-1 letters alone, and words whose lower case, normal form and pieces are plain.
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: How these vocabularies cut a lower-cased plain word before merging. Fixed value.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: Lengths of pieces, in bytes, that are merged together; longer ones go to the library.
WIDTHS = (6, 9, 12, 16, 24, 40)
#: Distinct words remembered from one call to the next.
REMEMBERED = 400_000
NONE = np.int32(1 << 30)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places starts[i], starts[i] + 1, ... (counts[i] of them) for each i in turn."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


class Ragged:
    """Lists of numbers of several lengths in one array."""

    def __init__(self, counts: np.ndarray, values: np.ndarray) -> None:
        self.counts, self.values = counts, values
        self.starts = np.cumsum(counts) - counts

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Ragged:
        counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        return cls(counts, np.concatenate(lists) if lists else np.empty(0, dtype=np.int32))

    def take(self, rows: np.ndarray) -> Ragged:
        counts = self.counts[rows]
        return Ragged(counts, self.values[spread(self.starts[rows], counts)])

    def joined(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.counts, other.counts]), np.concatenate([self.values, other.values]))


def merge_parts(n: int, parts: list[tuple[np.ndarray, Ragged]]) -> Ragged:
    """One list for each of n rows, from (rows, their lists)."""
    counts = np.zeros(n, dtype=np.int64)
    for rows, lists in parts:
        counts[rows] = lists.counts
    out = Ragged(counts, np.empty(int(counts.sum()), dtype=np.int32))
    for rows, lists in parts:
        out.values[spread(out.starts[rows], lists.counts)] = lists.values
    return out


def utf8(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words, and each one's start and length."""
    words = words.cast(pa.large_binary())
    words = pa.concat_arrays([words])  # no offset
    _, ends, data = words.buffers()
    bounds = np.frombuffer(ends, dtype=np.int64, count=len(words) + 1 + words.offset)[words.offset :]
    return np.frombuffer(data or b"", dtype=np.uint8), bounds[:-1], np.diff(bounds)


class WordEncoder:
    """Encodes texts, without added special tokens."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        held = json.loads(Path(path).read_text(encoding="utf-8"))
        model, normal = held["model"], held.get("normalizer") or {}
        kinds = [n["type"] for n in normal.get("normalizers", [])]
        #: White space is dropped and case folded, each word by itself; else whole texts go to the library.
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and model.get("end_of_word_suffix") == "</w>"
        if not self.by_word:
            return
        self.special = [t["content"] for t in held["added_tokens"]]
        number = model["vocab"]
        self.inner = np.array([number[s] for s in byte_symbols()], dtype=np.int32)
        self.last = np.array([number[s + "</w>"] for s in byte_symbols()], dtype=np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([number[a] << 32 | number[b] for a, b in merges], dtype=np.int64)
        keys, first = np.unique(keys, return_index=True)  # of equal pairs the first has the rank
        self.keys, self.ranks = keys, first.astype(np.int32)
        self.made = np.array([number[a + b] for a, b in merges], dtype=np.int32)
        self.known, self.known_ids = pa.array([], pa.large_string()), Ragged.of([])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of symbols, NONE where there is no merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NONE)

    def merged(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> Ragged:
        """Symbols of pieces of at most width bytes: each round does every piece's merge of lowest rank, leftmost first."""
        n, place = len(starts), np.arange(width + 1)
        inside = place < lengths[:, None]
        flat = data[spread(starts, lengths)]
        values = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        values[ends] = self.last[flat[ends]]
        symbols = np.full((n, width + 1), -1, dtype=np.int32)
        symbols[inside] = values
        ranks = np.full((n, width + 1), NONE, dtype=np.int32)
        ranks[:, :-1] = self.rank(symbols[:, :-1], symbols[:, 1:])
        todo = np.arange(n)
        while len(todo):
            r, s = ranks[todo], symbols[todo]
            k = r.argmin(1)
            row = np.arange(len(todo))
            best = r[row, k]
            go = best < NONE
            if not go.all():
                todo, r, s, k, best = todo[go], r[go], s[go], k[go], best[go]
                row = row[: len(todo)]
                if not len(todo):
                    break
            s[row, k] = self.made[best]
            gather = np.minimum(place + (place > k[:, None]), width)  # what stands behind the pair moves up
            s, r = np.take_along_axis(s, gather, 1), np.take_along_axis(r, gather, 1)
            s[:, -1], r[:, -1] = -1, NONE
            r[row, k] = self.rank(s[row, k], s[row, np.minimum(k + 1, width)])
            before = np.flatnonzero(k > 0)
            r[before, k[before] - 1] = self.rank(s[before, k[before] - 1], s[before, k[before]])
            symbols[todo], ranks[todo] = s, r
        left = symbols >= 0
        return Ragged(left.sum(1), symbols[left])

    def by_library(self, texts: list[str]) -> Ragged:
        found = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return Ragged.of([np.array(e.ids, dtype=np.int32) for e in found])

    def pieces(self, pieces: pa.Array) -> Ragged:
        """Identifiers of pieces that are cut and lower-cased already."""
        data, starts, lengths = utf8(pieces)
        parts, least = [], 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > least) & (lengths <= width))
            parts.append((rows, self.merged(data, starts[rows], lengths[rows], width)))
            least = width
        rows = np.flatnonzero(lengths > least)
        parts.append((rows, self.by_library(pieces.take(pa.array(rows)).to_pylist())))
        return merge_parts(len(pieces), parts)

    def words(self, words: pa.Array) -> Ragged:
        """Identifiers of distinct words without a blank inside."""
        letters = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
        parts = [(np.flatnonzero(letters), self.pieces(pc.utf8_lower(words.filter(pa.array(letters)))))]
        rest = np.flatnonzero(~letters)
        texts = words.take(pa.array(rest)).to_pylist()
        plain = [bool(PLAIN.fullmatch(w)) and not ("<|" in w and any(x in w for x in self.special)) for w in texts]
        cut = [PIECES.findall(w.lower()) for w, p in zip(texts, plain, strict=True) if p]
        flat = pa.array([p for part in cut for p in part], pa.large_string()).dictionary_encode()
        ids = self.pieces(flat.dictionary).take(flat.indices.to_numpy())
        of = np.repeat(np.arange(len(cut)), [len(part) for part in cut])
        counts = np.bincount(of, weights=ids.counts, minlength=len(cut)).astype(np.int64)
        parts.append((rest[np.array(plain, dtype=bool)], Ragged(counts, ids.values)))
        odd = [w for w, p in zip(texts, plain, strict=True) if not p]
        parts.append((rest[~np.array(plain, dtype=bool)], self.by_library(odd)))
        return merge_parts(len(words), parts)

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Identifiers of whole texts; the caller bounds how many bytes of text come at a time."""
        if not self.by_word:
            return [np.array(e.ids, dtype=np.int32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        lists = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " "), " ")
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        at = pc.fill_null(pc.index_in(words, value_set=self.known), -1).to_numpy()
        fresh = np.flatnonzero(at < 0)
        new = words.take(pa.array(fresh))
        new_ids = self.words(new)
        at = at.copy()
        at[fresh] = len(self.known) + np.arange(len(fresh))
        ids = self.known_ids.joined(new_ids)
        if len(self.known) + len(fresh) <= REMEMBERED:
            self.known, self.known_ids = pa.concat_arrays([self.known, new]), ids
        found = ids.take(at[coded.indices.to_numpy()])
        cuts = np.concatenate([[0], np.cumsum(found.counts)])[bounds].tolist()
        return [found.values[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    return WordEncoder(path)
