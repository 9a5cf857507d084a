"""Quality classifier: a sparse ensemble of conjunctive rules.

Statistics of the text are Spark columns. A forest of shallow trees is fitted on labelled rows; every path from a root to a
node is a rule; a logistic model with a lasso penalty keeps few rules and weighs them; the kept rules are compiled back into
one Spark column, so scoring is a projection without Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Labelled rows the fit takes at most, by hash order; the forest; the lasso's weight.
TRAIN_ROWS = 6000
TREES, DEPTH, PENALTY, SEED = 16, 3, 0.003, 17
WORD = r"[^\x20\x09-\x0D]+"


def statistics(text: Column) -> dict[str, Column]:
    """Counts and shares over the whole text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    count = lambda pattern: F.regexp_count(t, F.lit(pattern)).cast("double")
    return {
        "chars": chars.cast("double"),
        "words": count(WORD),
        "upper": count("[A-Z]"),
        "letters": count(r"\p{L}+"),
        "digits": count("[0-9]"),
        "symbols": count(r"[#$%&*+<=>@^_`|~{}\\]"),
        "bangs": count("[!?]"),
        "stops": count(r"[.;:]"),
        "commas": count(","),
        "lines": count("\n"),
        "short": count(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,4}+(?![^\x20\x09-\x0D])"),
    }


def shares(s: dict[str, Column]) -> dict[str, Column]:
    """The features: statistics by words or characters."""
    words, chars = F.greatest(s["words"], F.lit(1.0)), F.greatest(s["chars"], F.lit(1.0))
    return {
        "log_words": F.log1p(s["words"]),
        "word_length": s["chars"] / words,
        "upper_share": s["upper"] / chars,
        "letter_runs": s["letters"] / words,
        "digit_share": s["digits"] / chars,
        "symbol_share": s["symbols"] / words,
        "bang_share": s["bangs"] / words,
        "stop_share": s["stops"] / words,
        "comma_share": s["commas"] / words,
        "line_share": s["lines"] / words,
        "short_share": s["short"] / words,
        "distinct_share": s["distinct"] / words,
    }


FEATURES = (
    "log_words", "word_length", "upper_share", "letter_runs", "digit_share", "symbol_share", "bang_share", "stop_share",
    "comma_share", "line_share", "short_share", "distinct_share",
)
PREFIX = "_qm_"


def all_statistics(text: Column) -> dict[str, Column]:
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return statistics(text) | {"distinct": F.size(F.array_distinct(words)).cast("double")}


def with_features(df: DataFrame, text: Column) -> DataFrame:
    """df with one column per feature, named PREFIX + feature: clashes with no column of its own."""
    own = all_statistics(text)
    df = df.withColumns({f"{PREFIX}s_{k}": v for k, v in own.items()})
    features = shares({k: F.col(f"{PREFIX}s_{k}") for k in own})
    return df.withColumns({PREFIX + k: v for k, v in features.items()}).drop(*[f"{PREFIX}s_{k}" for k in own])


#: A rule: feature -> (greater than, at most), either end None.
Rule = tuple[tuple[str, float | None, float | None], ...]


def tree_rules(debug: str) -> set[Rule]:
    """Every path from a root to a node below it, read from the forest's printed trees."""
    found: set[Rule] = set()
    path: list[tuple[int, str, str, float]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line)
        if "Tree " in line:
            path = []
        if not m:
            continue
        depth = len(m[1])
        path = [p for p in path if p[0] < depth] + [(depth, FEATURES[int(m[2])], m[3], float(m[4]))]
        ends: dict[str, list[float | None]] = {}
        for _, name, sign, value in path:
            low_high = ends.setdefault(name, [None, None])
            k = 0 if sign == ">" else 1
            old = low_high[k]
            low_high[k] = value if old is None else max(old, value) if k == 0 else min(old, value)
        found.add(tuple((name, *ends[name]) for name in sorted(ends)))
    return found


def named(name: str) -> Column:
    return F.col(PREFIX + name)


def rule_column(rule: Rule, get: Callable[[str], Column] = named) -> Column:
    held = F.lit(True)
    for name, low, high in rule:
        c = get(name)
        if low is not None:
            held = held & (c > low)
        if high is not None:
            held = held & (c <= high)
    return held.cast("double")


@dataclass
class RuleModel:
    """Weights of the kept rules; without rules the intercept alone gives the share of good rows."""

    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, get: Callable[[str], Column] = named) -> Column:
        """Score from 0 to 1 over the features that get returns by name."""
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.lit(float(weight)) * rule_column(rule, get)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(labelled: DataFrame) -> RuleModel:
    """Fit on rows with the feature columns and label (0.0 or 1.0). One class only, or no rows: a smoothed share."""
    import math

    counts = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    good, bad = counts.get(1.0, 0), counts.get(0.0, 0)
    if min(good, bad) < 5:
        return RuleModel(math.log((good + 1) / (bad + 1)))
    vectors = VectorAssembler(inputCols=[PREFIX + f for f in FEATURES], outputCol="features").transform(labelled)
    total = good + bad
    weighed = vectors.withColumn(
        "weight", F.when(F.col("label") == 1.0, F.lit(total / (2 * good))).otherwise(F.lit(total / (2 * bad)))
    )
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, maxBins=64, seed=SEED, weightCol="weight", featureSubsetStrategy="onethird",
        subsamplingRate=0.7,
    ).fit(weighed)
    rules = sorted(tree_rules(forest.toDebugString), key=repr)
    if not rules:
        return RuleModel(math.log((good + 1) / (bad + 1)))
    held = labelled.select("label", F.array(*[rule_column(r) for r in rules]).alias("r"))
    from pyspark.ml.functions import array_to_vector

    held = held.select("label", array_to_vector("r").alias("features")).cache()
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False, tol=1e-5
    ).fit(held)
    held.unpersist()
    kept = [(r, w) for r, w in zip(rules, lasso.coefficients.toArray().tolist(), strict=True) if abs(w) > 1e-6]
    return RuleModel(float(lasso.intercept), kept)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on labelled documents that aren't held out, at most rows of them (those with the least id hashes).

    Labels that are null, or that contradict each other for one id, count as absent. Of several texts of one id, the one
    with the least statistics counts.
    """
    known = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("_most"))
        .where("label = _most")
        .orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id")
        .limit(rows)
        .select(F.col("doc_id").alias("_id"), F.col("label").cast("double").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    joined = texts.join(F.broadcast(known), F.col("_doc") == F.col("_id")).select("label", "_doc", "_text")
    featured = with_features(joined, F.col("_text")).drop("_text")
    # One row per id, so that the sample stays bounded where an id repeats.
    single = featured.groupBy("_doc").agg(F.min(F.struct(*[PREFIX + f for f in FEATURES], "label")).alias("_row")).select("_doc", "_row.*")
    # The bounded sample in one order, so that bootstraps agree between reruns.
    sample = common.materialise(single.repartition(1).sortWithinPartitions("_doc")).drop("_doc").cache()
    model = fit(sample)
    sample.unpersist()
    return model


def scored(docs: DataFrame, model: RuleModel, column: str = "score", text_col: str = "text") -> DataFrame:
    """The documents with a score from 0 to 1 in the given column; null and empty texts are scored as empty ones.

    Statistics and features are bound by lambdas, so that a filter on the score, which Spark moves below projections with
    all it refers to, still takes each statistic once.
    """
    own = all_statistics(docs[text_col])
    held = F.array(F.struct(*[v.alias(k) for k, v in own.items()]))
    features = F.transform(held, lambda s: F.struct(*[v.alias(k) for k, v in shares({k: s[k] for k in own}).items()]))
    return docs.withColumn(column, F.transform(features, lambda f: model.score(lambda name: f[name]))[0])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
