import math
import zlib

import pandas as pd
import regex
from pyspark.sql import functions as F

from quarrymill.llm import common, rules


def test_held_out_accuracy_and_kept_clean_documents(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = rules.op10_quality(spark, sf_dir).toPandas()
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    both = got.merge(labels, on="doc_id")
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert len(held) > 80
    assert (held.predicted == held.quality).mean() >= 0.95
    assert (held[held.quality == 1].predicted == 1).mean() >= 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()


def test_held_out_labels_change_nothing(spark, small_dir):
    docs, labels = common.table(spark, small_dir, "documents"), common.table(spark, small_dir, "labels")
    flipped = labels.withColumn("quality", F.when(rules.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rules.train(docs, labels) == rules.train(docs, flipped)


def test_rules_compile_to_what_they_say(spark):
    model = rules.RuleModel(0.5, [((("log_words", 1.0, 2.0),), 1.5), ((("symbol_share", None, 0.1), ("upper_share", 0.2, None)), -2.0)])
    rows = [(1.5, 0.0, 0.0), (3.0, 0.05, 0.5), (2.0, 0.1, 0.3)]
    df = spark.createDataFrame(rows, ", ".join(f"{rules.PREFIX}{n} double" for n in ("log_words", "symbol_share", "upper_share")))
    want = [1 / (1 + math.exp(-z)) for z in (2.0, -1.5, 0.0)]
    assert [round(r[0], 12) for r in df.select(model.score()).collect()] == [round(w, 12) for w in want]


def test_tree_paths():
    text = "Forest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 2.5)\n     If (feature 1 > 1.0E-4)\n      Predict: 0.0\n     Else (feature 1 <= 1.0E-4)\n      Predict: 1.0\n    Else (feature 0 > 2.5)\n     Predict: 1.0\n"
    assert rules.tree_rules(text) == {
        (("log_words", None, 2.5),),
        (("log_words", 2.5, None),),
        (("log_words", None, 2.5), ("word_length", 0.0001, None)),
        (("log_words", None, 2.5), ("word_length", None, 0.0001)),
    }


def test_odd_rows_and_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "a b", "x"), (None, "a b", "x"), (3, "z" * 300_000, "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    model = rules.train(docs, labels)
    out = rules.scored(docs, model, "s")
    assert out.columns == ["doc_id", "text", "score", "s"]
    assert all(0 <= r.s <= 1 for r in out.collect()) and out.count() == 5
    assert rules.scored(docs.limit(0), rules.train(docs.limit(0), labels.limit(0)), "s").count() == 0


def plain_features(text):
    """The statistics of one text, by plain counting."""
    t = text or ""
    count = lambda pattern: len(regex.findall(pattern, t))
    words, chars = max(1, count(r"[^\x20\x09-\x0D]+")), max(1, len(t))
    parts = regex.split(r"[\x20\x09-\x0D]+", t)
    return {
        "log_words": math.log1p(count(r"[^\x20\x09-\x0D]+")),
        "word_length": len(t) / words,
        "upper_share": count("[A-Z]") / chars,
        "letter_runs": count(r"\p{L}+") / words,
        "digit_share": count("[0-9]") / chars,
        "symbol_share": count(r"[#$%&*+<=>@^_`|~{}\\]") / words,
        "bang_share": count("[!?]") / words,
        "stop_share": count("[.;:]") / words,
        "comma_share": count(",") / words,
        "line_share": count("\n") / words,
        "short_share": sum(0 < len(p) <= 4 for p in parts) / words,
        "distinct_share": len(set(parts)) / words,
    }


def test_query_scores_match_plain_rules_on_whole_texts(spark, small_dir):
    docs = common.table(spark, small_dir, "documents")
    model = rules.train(docs, common.table(spark, small_dir, "labels"))
    assert model.rules
    got = {r.doc_id: r for r in rules.op10_quality(spark, small_dir).collect()}
    rows = docs.collect()
    assert len(rows) == len(got)
    for r in rows:
        own = plain_features(r.text)
        total = model.intercept
        for rule, weight in model.rules:
            total += weight * all((a is None or own[k] > a) and (z is None or own[k] <= z) for k, a, z in rule)
        assert abs(got[r.doc_id].score - 1 / (1 + math.exp(-total))) < 1e-9


def test_a_repeated_id_counts_once(spark):
    docs = spark.createDataFrame([(n, "plain words here " * 5 if n % 2 else "#### $$$$ !!!! ") for n in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    often = docs.union(docs.where("doc_id = 2").crossJoin(spark.range(500)).select("doc_id", "text"))
    assert rules.train(docs, labels) == rules.train(often, labels)
