"""Mixing sources to target weights with hash-threshold histograms.

Words are summed by source and bucket of a document hash. From the running sums of a source's buckets follows the one
bucket in which its budget ends; only that bucket is refined with the next bits of the hash, until it holds one hash value.
The documents below the threshold are then taken by a filter, with no sort and no window over documents. What a budget leaves
at its boundary is the next budget, for smaller documents behind it: nested thresholds, until nothing fits. Documents of
the one hash value at a boundary (rows of equal id and size, which nothing tells apart) are counted, and as many of them are
taken as still fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Bits of the document hash, and bits that one level of the histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: Rows that one task makes of a counted group at a time.
EXPAND = 50_000


def document_hash(key: Column, size: Column) -> Column:
    """60 bits of the MD5 of id and size as text, so that other engines reach the same selection; a null id counts as empty."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), size.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Budget of each source, for a table (source, source_size) with one row per source.

    Weights go by the sources' order by code point, null last, and repeat. The sizes' total is shared by weight; a target
    stops at most times its source's size and the excess is shared again by weight. As every source's cap per unit of
    weight is known, one running sum in that order finds who is capped: no rounds are needed. Adds rank, target, copies
    (whole copies of every document) and rest (words to take on top of them).
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    order = W.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    # Sources by cap over weight: a source is capped if sharing what the ones before it leave would exceed its cap.
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = W.partitionBy()
    ranked = (
        ranked.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.sum("cap").over(by_ratio) - F.col("cap"))
        .withColumn("weight_before", F.sum("weight").over(by_ratio) - F.col("weight"))
        .withColumn(
            "is_capped",
            F.col("cap") * (F.col("weights") - F.col("weight_before"))
            <= F.col("weight") * (F.col("total") - F.col("cap_before")),
        )
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("is_capped"), F.col("cap")).otherwise(0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("is_capped"), 0).otherwise(F.col("weight"))).over(everything))
    )
    share = (F.col("weight") * F.col("left")).cast("double") / F.when(F.col("open") > 0, F.col("open")).cast("double")
    ranked = ranked.withColumn("target", F.when(F.col("is_capped"), F.col("cap").cast("double")).otherwise(share))
    ranked = ranked.withColumn(
        "copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    )
    return ranked.select(
        "source", "rank", "source_size", "target", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("rest")
    )


def ends(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """Where each open rank's budget ends: rank, taken_to (the last hash value before, null: none), boundary (the hash value
    in which it ends, null: in none), used (words before the boundary), size and n (of the boundary's rows).

    rows: rank, size, hash; open_: rank, left, after. Rows count that stand after a hash value and are no larger than the
    budget. Each level of the histogram refines the one bucket in which the budget ends, until it holds one hash value.
    """
    state = open_.select("rank", "left", "after", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("used"), F.lit(False).alias("done"))
    none = F.lit(None).cast("long")
    state = state.withColumns({"taken_to": none, "boundary": none, "size": none, "n": none})
    shift = HASH_BITS
    while shift > 0:
        parent, shift = shift, max(0, shift - LEVEL_BITS)
        bounds = state.where("not done").select("rank", "left", "after", "low", "used")
        inside = rows.join(bounds, "rank").where(
            (F.col("hash") > F.col("after")) & (F.col("size") <= F.col("left")) & (F.shiftright("hash", parent) == F.shiftright("low", parent))
        )
        sums = inside.groupBy("rank", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("first_hash"), F.max("hash").alias("last_hash"),
            F.min("size").alias("least"), F.max("size").alias("most"), F.count(F.lit(1)).alias("rows"),
            F.first("left").alias("left"), F.first("used").alias("used"),
        )
        sums = sums.withColumn("until", F.col("used") + F.sum("words").over(W.partitionBy("rank").orderBy("bucket")))
        # The boundary is the first bucket that ends beyond the budget; all before it are taken.
        over = F.col("until") > F.col("left")
        edge = sums.groupBy(F.col("rank").alias("_rank")).agg(
            F.max(F.when(~over, F.col("last_hash"))).alias("_taken_to"),
            F.max(F.when(~over, F.col("until"))).alias("_used"),
            F.min(F.when(over, F.struct("bucket", "first_hash", "last_hash", "least", "most", "rows"))).alias("_e"),
        )
        one = F.col("_e.first_hash") == F.col("_e.last_hash")
        was = F.col("done")
        state = common.materialise(
            state.join(edge, state.rank == edge._rank, "left").select(
                "rank", "left", "after",
                F.coalesce(F.col("_e.bucket") * F.lit(1 << shift), "low").alias("low"),
                F.when(was, F.col("used")).otherwise(F.coalesce("_used", "used")).alias("used"),
                (was | F.coalesce(F.col("_e").isNull() | one, F.lit(True))).alias("done"),
                F.when(was, F.col("taken_to")).otherwise(F.coalesce("_taken_to", "taken_to")).alias("taken_to"),
                *[F.when(was, F.col(k)).when(one, F.col(f"_e.{v}")).alias(k) for k, v in (("boundary", "last_hash"), ("n", "rows"))],
                # Rows of one hash value are equal but for a collision of 60 bits; those are left out here.
                F.when(was, F.col("size")).when(one & (F.col("_e.least") == F.col("_e.most")), F.col("_e.least")).alias("size"),
            )
        )
        if state.where("not done").isEmpty():
            break
    return state.select("rank", "taken_to", "boundary", "used", "size", "n")


WINDOWS, EDGES = "array<struct<after:long,to:long,most:double>>", "array<struct<hash:long,take:long>>"


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per rank: windows (a row is taken that lies in one: after < hash <= to, size <= most) and edges (so many of the rows
    of one hash value are taken).

    Nested budgets: the rows up to the first one that doesn't fit are taken; what is left is the next budget, for the rows
    after it that are no larger, and so on until nothing fits. At last the smallest row beyond, if with it the words come
    nearer to the target than without. What is left falls by about a half in each round.
    """
    rows = sized.where("size > 0").select("rank", "size", "hash")
    state = budgets.select(
        "rank", F.col("rest").alias("left"), F.lit(-1).cast("long").alias("after"), (F.col("rest") > 0).alias("open"),
        F.array().cast(WINDOWS).alias("windows"), F.array().cast(EDGES).alias("edges"),
    )
    state = common.materialise(state)
    while not state.where("open").isEmpty():
        end = ends(rows, state.where("open").select("rank", "left", "after")).withColumnRenamed("rank", "_rank")
        rest = F.col("left") - F.coalesce("used", F.lit(0))
        take = F.coalesce(F.least("n", F.floor(rest / F.col("size"))), F.lit(0))
        window = F.struct("after", F.col("taken_to").alias("to"), F.col("left").alias("most"))
        edge = F.struct(F.col("boundary").alias("hash"), take.alias("take"))
        state = common.materialise(
            state.join(end, state.rank == end._rank, "left").select(
                "rank",
                (rest - take * F.coalesce("size", F.lit(0))).alias("left"),
                F.coalesce("boundary", "after").alias("after"),
                (F.col("open") & F.col("boundary").isNotNull()).alias("open"),
                F.when(F.col("taken_to").isNotNull(), F.array_append("windows", window)).otherwise(F.col("windows")).cast(WINDOWS).alias("windows"),
                F.when(F.col("boundary").isNotNull(), F.array_append("edges", edge)).otherwise(F.col("edges")).cast(EDGES).alias("edges"),
            )
        )
    near = rows.join(state.where("left > 0").select("rank", "left", "windows", "edges"), "rank")
    near = near.where((F.col("size") - F.col("left") < F.col("left")) & (F.col("size") > F.col("left")) & ~in_windows())
    last = near.groupBy(F.col("rank").alias("_rank")).agg(F.min(F.struct("size", "hash")).alias("more"))
    last = last.select("_rank", F.col("more.hash").alias("more"))
    grown = F.transform("edges", lambda e: F.struct(e["hash"].alias("hash"), (e["take"] + (e["hash"] == F.col("more")).cast("long")).alias("take")))
    known = F.exists("edges", lambda e: e["hash"] == F.col("more"))
    added = F.when(known, grown).otherwise(F.array_append("edges", F.struct(F.col("more").alias("hash"), F.lit(1).cast("long").alias("take"))))
    out = state.join(last, state.rank == last._rank, "left")
    return out.select("rank", "windows", F.when(F.col("more").isNull(), F.col("edges")).otherwise(added).alias("edges"))


def in_windows() -> Column:
    return F.exists("windows", lambda w: (F.col("hash") > w["after"]) & (F.col("hash") <= w["to"]) & (F.col("size") <= w["most"]))


def boundary_copies(groups: DataFrame) -> DataFrame:
    """The edges' rows out of counted groups: columns id, size, n, take and the plan's; adds extra (0 or 1) for each row."""
    parts = groups.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / EXPAND))))
    # Each part of a group is made by another task.
    parts = parts.repartition("rank", "id", "size", "_part")
    last = F.least(F.col("n"), (F.col("_part") + 1) * EXPAND)
    rows = parts.withColumn("_k", F.explode(F.sequence(F.col("_part") * EXPAND + 1, last)))
    return rows.withColumn("extra", ((F.col("_k") <= F.col("take")) & (F.col("size") > 0)).cast("long"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
) -> DataFrame:
    """One row per input row: id, size, source_size, target, copies (times that the document is taken), taken (words).

    Each source's documents are taken whole, copies times each, and some once more: going by a hash, all that fit what the
    target still leaves, and the smallest other if that comes nearer. A large document ends nothing: the ones behind it are
    taken as they fit, also where rows repeat. No document is taken more than
    most times. Null sources are one source, the last by order; null and empty texts have size 0 and take
    nothing. An empty table gives no rows. Reruns, and other partitionings, give the same rows.
    """
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")
    )
    sized = common.materialise(sized)
    sized = sized.withColumn("hash", document_hash(F.col("id"), F.col("size")))
    sources = common.materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")))
    counts = sources.select(F.col("source").alias("_source"), "docs")
    budgets = targets(sources.drop("docs"), weights, most)
    budgets = common.materialise(budgets.join(counts, budgets.source.eqNullSafe(counts._source)).drop("_source"))
    ranks = budgets.select(F.col("source").alias("_source"), "rank")
    ranked = common.materialise(sized.join(ranks, sized.source.eqNullSafe(ranks._source)).select("id", "size", "hash", "rank"))
    plan = common.materialise(budgets.join(thresholds(ranked, budgets), "rank").drop("source"))
    placed = common.join_groups(ranked, plan, "rank", "docs")
    edge = F.try_element_at(F.filter("edges", lambda e: e["hash"] == F.col("hash")), F.lit(1))
    placed = placed.withColumn("take", edge["take"])
    names = ["id", "size", "source_size", "target", "copies", "extra"]
    plain = placed.where("take is null").withColumn("extra", in_windows().cast("long"))
    counted = placed.where("take is not null").groupBy("rank", "id", "size", "source_size", "target", "copies", "take").agg(F.count(F.lit(1)).alias("n"))
    every = plain.select(*names).union(boundary_copies(counted).select(*names))
    copies = F.least(F.col("copies") + F.col("extra"), F.lit(most))
    return every.withColumn("copies", copies).drop("extra").withColumn("taken", F.col("copies") * F.col("size"))


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = mix(common.table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


#: Whole-table SQL of the same mix: one document after the other in the order of the hash, each taken if it still fits.
OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 15))::BIGINT AS h
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) AS rank FROM src),
weighed AS (SELECT *, (rank % 3 + 1)::BIGINT AS w, source_size * 3 AS cap FROM ranked),
running AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS ws,
         (sum(cap) OVER (ORDER BY cap / w, rank) - cap)::BIGINT AS cap_before,
         (sum(w) OVER (ORDER BY cap / w, rank) - w)::BIGINT AS w_before
  FROM weighed),
capped AS (SELECT *, cap * (ws - w_before) <= w * (total - cap_before) AS is_capped FROM running),
shared AS (
  SELECT *, (total - sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER ())::BIGINT AS rest_total,
         (sum(CASE WHEN is_capped THEN 0 ELSE w END) OVER ())::BIGINT AS open_w
  FROM capped),
target AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN cap::DOUBLE ELSE (w * rest_total)::DOUBLE / open_w::DOUBLE END AS target
  FROM shared),
budget AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS copies FROM target),
placed AS (
  SELECT s.doc_id, s.size, s.source, b.source_size, b.target, b.copies, b.target - b.copies * b.source_size AS rest,
         row_number() OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS LAST, s.size) AS k
  FROM sized s JOIN budget b ON s.source IS NOT DISTINCT FROM b.source),
walk AS (
  SELECT *, rest AS room, size > 0 AND size <= rest AS fits FROM placed WHERE k = 1
  UNION ALL
  SELECT p.*, w.room - CASE WHEN w.fits THEN w.size ELSE 0 END,
         p.size > 0 AND p.size <= w.room - CASE WHEN w.fits THEN w.size ELSE 0 END
  FROM walk w JOIN placed p ON p.source IS NOT DISTINCT FROM w.source AND p.k = w.k + 1),
spare AS (SELECT *, rest - (sum(CASE WHEN fits THEN size ELSE 0 END) OVER (PARTITION BY source))::BIGINT AS room_left FROM walk),
other AS (
  SELECT *, NOT fits AND size > room_left AND size - room_left < room_left AS nearer,
         row_number() OVER (PARTITION BY source, NOT fits AND size > room_left AND size - room_left < room_left ORDER BY size, k) AS place
  FROM spare)
SELECT doc_id, size, source_size, target, size * least(3, copies + (fits OR (nearer AND place = 1))::INTEGER) AS taken
FROM other
"""
