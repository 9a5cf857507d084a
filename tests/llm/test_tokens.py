import pandas as pd
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarrymill.llm import tokens

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
LIBRARY = Tokenizer.from_file(PATH)
MERGER = tokens.Merger(PATH)
ODD = ["", " ", "a" * 3000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext", "don't I'LL", "é😀日本語\u200d", "\n\n  \t x", "½²\x1c\x00", "1 22 333", "ab" * 20_000]


def expected(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_counts_equal_the_library():
    assert [MERGER.count(t) for t in ODD] == expected(ODD)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert MERGER.count(text) == expected([text])[0]


def test_query(spark, small_dir):
    got = tokens.op5_token_counts(spark, small_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{small_dir}/documents.parquet")
    assert got.loc[docs.doc_id].n_tokens.tolist() == expected(docs.text.tolist())
    assert got.loc[docs.doc_id].n_bytes.tolist() == [len(t.encode()) for t in docs.text]
    assert (got.over_limit == (got.n_tokens > 512)).all()


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (1, "", "x"), (None, "a b", "x"), (2, "a b", "x"), (2, "a b", "x")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, tokens.counted(df, PATH).collect()), key=str)
    assert got == [(1, 0, 0, False), (1, 0, 0, False), (2, 3, 2, False), (2, 3, 2, False), (None, 3, 2, False)]
    assert tokens.counted(df.limit(0), PATH).count() == 0
