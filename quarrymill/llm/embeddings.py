"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, reranking by the vectors.

Principal directions and rotations are learned on a bounded sample so that the signs of the rotated vector are balanced bits.
The bits are cut into tables; vectors that agree in all bits of a table meet there. How many bits a table has follows from
the number of vectors, how many tables from the recall that is wanted at the cosine limit. Vectors of each length have
their own rotations and tables.

Codes meet first: whoever has a partner in a bucket within the Hamming limit, and meets it in no earlier table, stays; only
for these the original vectors are fetched and compared in double precision. So a pair counts once, no pairs are gathered
to remove doubles, and tasks put out members, counts per vector and the few edges that connect a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Vectors that the rotations are learned on, at most, by hash order, over all lengths; lengths that have learned rotations,
#: the commonest first (others have random ones, which need no sample); rounds of learning.
SAMPLE, LEARNED, ROUNDS = 20_000, 64, 30
#: Pairs just at the cosine limit that are made from the sample to find the Hamming limit.
TRIALS = 5000
#: Recall wanted of pairs just at the limit, under independent bits; nearer pairs have more.
RECALL = 0.95
BLOCK = 2048


def plan_tables(count: int, cosine: float) -> tuple[int, int]:
    """(bits of a table, number of tables) for so many vectors."""
    bits = min(40, max(8, math.ceil(math.log2(max(2, count))) - 3))
    agree = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(4, math.ceil(math.log(1 - RECALL) / math.log(1 - min(agree, 1 - 1e-9))))


def learn(sample: np.ndarray, bits: int, seed: int = 5) -> np.ndarray:
    """Projections as columns: as many rotations as the bits need, each over the principal directions.

    Iterative quantisation: signs of the rotated sample, then the orthogonal map that brings the sample nearest to them.
    The sample isn't centred: bits are then sides of planes through the origin, which vectors of a small angle share whatever
    the sample's mean is (centred, the codes of one tight group would be noise).
    """
    _, _, directions = np.linalg.svd(sample.T @ sample / max(1, len(sample)))
    width = min(sample.shape[1], 64)
    directions = directions[:width].T
    reduced = sample @ directions
    generator = np.random.default_rng(seed)
    columns = []
    for _ in range(math.ceil(bits / width)):
        rotation = np.linalg.qr(generator.standard_normal((width, width)))[0]
        for _ in range(ROUNDS):
            u, _, v = np.linalg.svd(np.where(reduced @ rotation >= 0, 1.0, -1.0).T @ reduced)
            rotation = (u @ v).T
        columns.append(directions @ rotation)
    return np.concatenate(columns, axis=1)[:, :bits]


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    big = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: F.coalesce((F.abs(x) < big) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one. They are scaled by a power of two first, so that neither large nor small numbers overflow."""
    exponents = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1]
    v = np.ldexp(vectors, -exponents)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Plan(NamedTuple):
    """Codes of the vectors of one length: bits of a table, tables, projections as columns (None: drawn), Hamming limit."""

    bits: int
    tables: int
    projections: np.ndarray | None
    limit: int


def hamming_limit(sample: np.ndarray, projections: np.ndarray, cosine: float, seed: int = 6) -> int:
    """Bits that differ at most among pairs just at the cosine limit: made in random directions and towards other vectors."""
    generator = np.random.default_rng(seed)
    base = np.concatenate([sample, sample])[:TRIALS] if len(sample) * 2 > TRIALS else np.tile(sample, (math.ceil(TRIALS / len(sample)), 1))
    towards = base[generator.permutation(len(base))]
    aside = np.where(np.arange(len(base))[:, None] % 2 == 0, generator.standard_normal(base.shape), towards)
    aside = aside - (aside * base).sum(axis=1, keepdims=True) * base
    length = np.linalg.norm(aside, axis=1)
    base, aside = base[length > 1e-6], aside[length > 1e-6] / length[length > 1e-6, None]
    if not len(base):
        return projections.shape[1]
    partner = cosine * base + math.sqrt(max(0.0, 1 - cosine * cosine)) * aside
    return int(((base @ projections >= 0) != (partner @ projections >= 0)).sum(axis=1).max()) + 1


def plans(rows: DataFrame, cosine: float) -> dict[int, Plan]:
    """A plan for each length that two usable vectors have at least, learned on a bounded sample. rows: v (usable).

    The LEARNED commonest lengths share the sample, SAMPLE vectors together; a rarer length's rotations are drawn by its
    number in the tasks, so that neither the driver nor a broadcast holds more for each of them than a few numbers.
    """
    sizes = {r["size"]: r["n"] for r in rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect() if r["n"] > 1}
    if not sizes:
        return {}
    common_ = sorted(sizes, key=lambda size: (-sizes[size], size))[:LEARNED]
    each = SAMPLE // len(common_)
    scale = 1 << 30
    bounds = F.create_map(*[F.lit(x) for size in common_ for x in (size, min(scale, int(1.2 * scale * each / sizes[size]) + 1))])
    rank = F.xxhash64("v", F.lit(3))
    chosen = rows.where(F.pmod(rank, F.lit(scale)) < F.try_element_at(bounds, F.size("v"))).distinct()
    order = W.partitionBy(F.size("v")).orderBy(F.pmod(rank, F.lit(scale)), "v")
    chosen = chosen.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= each).select("v")
    samples: dict[int, list] = {}
    for r in chosen.collect():
        samples.setdefault(len(r.v), []).append(r.v)
    found = {}
    for size, n in sizes.items():
        bits, tables = plan_tables(n, cosine)
        if size in samples:
            known = unit(np.array(samples[size], dtype=np.float64))
            projections = learn(known, bits * tables)
            found[size] = Plan(bits, tables, projections, hamming_limit(known, projections, cosine))
        else:
            found[size] = Plan(bits, tables, None, drawn(size, bits * tables, cosine)[1])
    return found


@lru_cache(8)
def drawn(size: int, bits: int, cosine: float) -> tuple[np.ndarray, int]:
    """Random projections for vectors of a length, and their Hamming limit."""
    generator = np.random.default_rng([size, bits])
    projections = generator.standard_normal((size, bits))
    return projections, hamming_limit(unit(generator.standard_normal((256, size))), projections, cosine)


def codes_of(vectors: list[np.ndarray], plan: Plan, cosine: float) -> np.ndarray:
    """Row per vector: each table's bits in whole bytes, one table after the other."""
    held = np.stack(vectors).astype(np.float64)
    projections = drawn(held.shape[1], plan.bits * plan.tables, cosine)[0] if plan.projections is None else plan.projections
    signs = unit(held) @ projections >= 0
    return np.packbits(signs.reshape(len(vectors), plan.tables, plan.bits), axis=2).reshape(len(vectors), -1)


GROUP = ["size", "t", "bucket", "bi", "bj"]


def near_pairs(part: pa.Table, bounds: np.ndarray, codes: np.ndarray, plan: Plan) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one length that meet here first, and within the Hamming limit. Where two blocks meet: across them."""
    t, blk = part["t"].to_numpy(), part["blk"].to_numpy()
    two = part["bi"].to_numpy() != part["bj"].to_numpy()
    codes = codes.reshape(len(codes), plan.tables, -1)
    for i, j in common.pairs_within(bounds, codes[0].size):
        across = ~two[i] | (blk[i] != blk[j])
        i, j = i[across], j[across]
        differing = codes[i] ^ codes[j]
        close = np.bitwise_count(differing).sum(axis=(1, 2), dtype=np.int32) <= plan.limit
        i, j, differing = i[close], j[close], differing[close]
        first = (~differing.any(axis=2)).argmax(axis=1) == t[i]
        yield i[first], j[first]


def by_length(whole: pa.Table) -> Iterator[tuple[int, pa.Table, np.ndarray, np.ndarray]]:
    """(length, rows, bounds of their groups, their codes) for the lengths in a table sorted by GROUP."""
    starts = common.group_bounds(whole, ["size"]).tolist()
    for s, e in zip(starts, starts[1:], strict=False):
        part = whole.slice(s, e - s).combine_chunks()
        codes = np.frombuffer(b"".join(part["code"].to_pylist()), dtype=np.uint8).reshape(e - s, -1)
        yield part["size"][0].as_py(), part, common.group_bounds(part, GROUP), codes


def candidates(reps: DataFrame, shared) -> DataFrame:
    """(rep and its place in a group) of whoever has a partner there by its code. reps: rep, size, tables, code."""
    keyed = reps.where("code is not null").select("rep", "size", "code", "tables", F.explode(F.sequence(F.lit(0), F.col("tables") - 1)).alias("t"))
    width = F.octet_length("code") / F.col("tables")
    key = F.substring("code", (F.col("t") * width + 1).cast("int"), width.cast("int"))
    keyed = keyed.select("rep", "size", "t", F.xxhash64(key).alias("bucket"), "code")
    blocks = common.blocked_buckets(keyed, ["size", "t", "bucket"], "rep", BLOCK).select(*GROUP, "blk", "rep", "code")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, GROUP):
            for size, part, bounds, codes in by_length(whole):
                met = np.zeros(len(codes), dtype=bool)
                for i, j in near_pairs(part, bounds, codes, shared.value[size]):
                    met[i] = met[j] = True
                if met.any():
                    kept = part.select([*GROUP, "blk", "rep"]).filter(pa.array(met)).combine_chunks()
                    yield from kept.to_batches()

    schema = "size int, t int, bucket long, bi int, bj int, blk int, rep long"
    return blocks.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(members, schema)


def compared(members: DataFrame, reps: DataFrame, shared, cosine: float, single: bool) -> DataFrame:
    """Rows (a, b, n): n links of vector a found in one group (b null), or an edge from a to b (n 0)."""
    kind = np.float32 if single else np.float64
    dealt = members.join(reps.select("rep", "copies", "vec", "code"), "rep")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, GROUP):
            for size, part, bounds, codes in by_length(whole):
                rep, copies = part["rep"].to_numpy(), part["copies"].to_numpy()
                vectors = unit(np.frombuffer(b"".join(part["vec"].to_pylist()), dtype=kind).reshape(-1, size).astype(np.float64))
                counts = np.zeros(len(rep), dtype=np.int64)
                forest = common.Forest(len(rep))
                step = max(1, common.HELD // (16 * size))
                for left, right in near_pairs(part, bounds, codes, shared.value[size]):
                    for at in range(0, len(left), step):
                        i, j = left[at : at + step], right[at : at + step]
                        linked = np.einsum("ij,ij->i", vectors[i], vectors[j]) >= cosine
                        i, j = i[linked], j[linked]
                        np.add.at(counts, i, copies[j])
                        np.add.at(counts, j, copies[i])
                        forest.link_all(i, j)
                some = np.flatnonzero(counts)
                edges = np.array(forest.edges, dtype=np.int64).reshape(-1, 2)
                a = np.concatenate([rep[some], rep[edges[:, 0]]])
                b = pa.array([None] * len(some) + rep[edges[:, 1]].tolist(), pa.int64())
                n = np.concatenate([counts[some], np.zeros(len(edges), dtype=np.int64)])
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    ready = dealt.select(*GROUP, "blk", "rep", "copies", "vec", "code").repartition(*GROUP).sortWithinPartitions(*GROUP)
    return ready.mapInArrow(links, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Equal vectors are one representative with a number of copies. Vectors that are null, empty, zero or have null or
    non-finite components link with nothing: n_links 0, a component of their own. Vectors of different lengths don't link. A
    row without id has no component and isn't kept. Repeated rows are copies of each other; an id may stand on different
    vectors, each of which has its own links. Other columns are ignored; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    good = usable(F.col("v"))
    own = F.col("id").alias("component_id")
    alone = rows.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), own)
    known = plans(rows.where(good).select("v"), cosine)
    shared = spark.sparkContext.broadcast(known)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64

    @F.pandas_udf("struct<vec:binary,code:binary,tables:int>")
    def coded(v: pd.Series) -> pd.DataFrame:
        held = [np.asarray(x, dtype=kind) for x in v]
        codes: list[bytes | None] = [None] * len(held)
        tables = [0] * len(held)
        places: dict[int, list[int]] = {}
        for k, x in enumerate(held):
            places.setdefault(len(x), []).append(k)
        for size, ks in places.items():
            if (plan := shared.value.get(size)) is not None:
                for k, code in zip(ks, codes_of([held[k] for k in ks], plan, cosine), strict=True):
                    codes[k], tables[k] = code.tobytes(), plan.tables
        return pd.DataFrame({"vec": [x.tobytes() for x in held], "code": codes, "tables": tables})

    # Two hashes stand for a vector where rows find their representative again, so that no vector moves for that.
    hashes = F.struct(F.xxhash64("v").alias("x"), F.xxhash64("v", F.lit(11)).alias("y"))
    distinct = rows.where(good).groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
    # Numbers of distinct vectors, whatever ids they share: given once, as the table is written.
    reps = distinct.select(
        F.monotonically_increasing_id().alias("rep"), "low", "copies", hashes.alias("h"), F.size("v").alias("size"), coded("v").alias("c")
    )
    reps = common.materialise(reps.select("rep", "low", "copies", "h", "size", "c.*"))
    members = common.materialise(candidates(reps, shared))
    found = common.materialise(compared(members, reps, shared, cosine, single))
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    roots = common.connected_components(found.where("b is not null").select("a", "b"))
    joined = reps.select("rep", "low", "copies", "h").join(counts, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left")
    joined = common.materialise(joined.select("h", "low", "copies", F.coalesce("others", F.lit(0)).alias("others"), F.coalesce("root", "rep").alias("root")))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members"))
    classes = common.join_groups(joined, common.materialise(lows), "root", "members")
    links = (F.col("others") + F.col("copies") - 1).alias("n_links")
    classes = common.materialise(classes.select("h", links, "component_id", "copies"))
    linked = common.join_groups(rows.where(good).select("id", hashes.alias("h")), classes, "h", "copies")
    every = linked.select("id", "n_links", "component_id").union(alone)
    return every.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return found.withColumnRenamed("id", "vec_id")
