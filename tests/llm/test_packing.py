import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrymill.llm import packing, wordbpe

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = wordbpe.WordEncoder(PATH)
ODD = [
    "", " ", "a" * 3000, "<|endoftext|>", "x<|endoftext|>y <|startoftext|>", "İSTANBUL ΣΑΣ Σ", "éé x", "don't I'LL 'Sx x's",
    "½²\x1c\x00", "1 22 333", "ß STRASSE ẞ", "😀日本語‍", "a\r\n\tb\x0bc\x85d", " ́x", "Ab" * 21 + " q",
]


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_identifiers_equal_the_library():
    assert [x.tolist() for x in ENCODER.texts(ODD)] == library(ODD)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("abcSt's.1é ß\n", max_size=60))
def test_any_text(text):
    assert ENCODER.texts([text])[0].tolist() == library([text])[0]


def test_other_vocabularies_take_whole_texts():
    other = str(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["two words", "", "it's\n\n x"]
    assert [x.tolist() for x in wordbpe.WordEncoder(other).texts(texts)] == [e.ids for e in Tokenizer.from_file(other).encode_batch(texts)]


def plain_rule(lengths, size):
    """The same choice by computing whole sums of squares."""
    open_, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        w = lengths[i]

        def total(gap, w=w):
            gaps = sorted(g for g, _ in open_)
            gaps.remove(gap)
            gaps.append(gap - w)
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)

        fits = sorted({g for g, _ in open_ if g >= w and g})
        if fits:
            gap = min(fits, key=lambda g: (total(g), g))
            at = max(k for k, (g, _) in enumerate(open_) if g == gap)
            _, members = open_.pop(at)
            open_.append((gap - w, members + [i]))
        else:
            open_.append((size - w, [i]))
        out = open_
    return sorted(tuple(m) for _, m in out)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=25))
def test_the_rule(lengths):
    sequence, place, gaps = packing.sum_of_squares(np.array(lengths, dtype=np.int64), 20)
    mine = {}
    for i in sorted(range(len(lengths)), key=lambda i: place[i]):
        mine.setdefault(int(sequence[i]), []).append(i)
    assert sorted(tuple(m) for m in mine.values()) == plain_rule(lengths, 20)
    assert gaps.tolist() == [20 - sum(lengths[i] for i in mine[s]) for s in range(len(gaps))]


def check(rows, texts, size):
    """rows: pieces of documents with distinct ids. Whole documents, true hashes, no gap, no overlap."""
    for doc_id, part in rows.groupby("doc_id"):
        ids = library([texts[doc_id] or ""])[0] + [0]
        part = part.sort_values("piece")
        assert part.piece.tolist() == list(range(-(-len(ids) // size)))
        assert part.start.tolist() == [k * size for k in part.piece]
        for p in part.itertuples():
            own = ids[p.start : p.start + size]
            assert (p.length, p.ids_crc32) == (len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()))
    assert set(rows.doc_id) == set(texts)
    for _, part in rows.groupby("sequence_id"):
        part = part.sort_values("offset")
        assert part.offset.tolist() == [0, *np.cumsum(part.length)[:-1].tolist()]
        assert part.length.sum() <= size


@pytest.mark.parametrize("folder", ["small_dir"])
def test_query(spark, request, folder):
    where = request.getfixturevalue(folder)
    rows = packing.op11_packing(spark, where).toPandas()
    docs = pd.read_parquet(f"{where}/documents.parquet")
    check(rows, dict(zip(docs.doc_id, docs.text, strict=True)), 2048)
    least = -(-int(rows.length.sum()) // 2048)
    assert rows.sequence_id.nunique() <= least * 1.02 + 1


def test_levels(spark, monkeypatch):
    """Many small tasks: what they leave loose is packed together, as tightly as in one."""
    monkeypatch.setattr(packing, "CHUNK", 40)
    texts = {i: "ab " * (1 + i * 7919 % 61) for i in range(600)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(16)
    rows = packing.pack(df, PATH, size=64).withColumnRenamed("id", "doc_id").toPandas()
    check(rows, texts, 64)
    assert rows.sequence_id.nunique() <= -(-int(rows.length.sum()) // 64) * 1.06
    alone = packing.packed(df, PATH, "doc_id", "text", 64, 0).toPandas()
    assert rows.sequence_id.nunique() < alone.sequence_id.nunique()


def test_edges(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "a b", "x"), (2, "a b", "x"), (3, "a " * 5000, "x")], "doc_id long, text string, gap string"
    )
    rows = packing.pack(df, PATH, size=2048).toPandas()
    assert sorted(rows.length.tolist()) == [1, 1, 3, 3, 3, 905, 2048, 2048]
    assert rows[rows.id.isna()].length.tolist() == [3]
    assert rows.sequence_id.nunique() == 3
    assert packing.pack(df.limit(0), PATH).count() == 0
    names = spark.createDataFrame([("k", "a b")], "doc_id string, text string")
    assert packing.pack(names, PATH).first().id == "k"
    same = spark.createDataFrame([(7, "a b")] * 500, "doc_id long, text string")
    assert packing.pack(same, PATH, size=12).toPandas().sequence_id.nunique() == 125
