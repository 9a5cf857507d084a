"""SimHash near-duplicates through pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to reference fingerprints. By the triangle inequality two
fingerprints at distance r differ by at most r in every coordinate, so a pair whose largest coordinate difference exceeds
the limit is discarded before it is verified bit by bit.

Distances to references concentrate around half the bits, so a pivot table alone can't say where a fingerprint's partners
are: comparing all rows of it would be a cross join. Candidates therefore come from pigeonhole banding, and the pivot
table decides which of them are verified.

- A limit of few bits (fingerprints of 64): the bits are cut into limit + k sets. At least k of them hold none of the
  differing bits, so one table for each choice of k sets finds every pair within the limit. k grows with the number of
  fingerprints.
- A similarity of shingles (fingerprints of 256 bits over distinct shingles): tables take random sets of bits, as many as
  find RECALL of the pairs just at the similarity, and more of nearer ones. Pairs within a loose limit are candidates; a
  link is a pair whose shingle sets themselves have the similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

PIVOTS = 24
#: Fingerprints in a block of a large bucket; a task holds two blocks.
BLOCK = 4096
#: Texts that a Python worker holds at a time.
TEXTS = 1000
SEED = 42
#: Bits of a fingerprint that stands for a similarity; share of the pairs just at it that tables find; and the standard
#: deviations that the estimated distance of a candidate may lie above its mean.
WIDE, RECALL, ABOVE = 256, 0.95, 3.0
#: Documents in a block of a large bucket where shingle sets are compared.
SET_BLOCK = 1024


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each shingle of a text's UTF-8 bytes, repeats included: A-Z lower-cased, six white-space bytes part words.

    Fewer words than width are one shingle, no words none.
    """
    words = text.lower().split() if text else []  # bytes: A-Z and the six white-space bytes only
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    n = max(1, len(words) - width + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype="<u8")
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:z], SEED) for a, z in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype="<u8")


def fingerprint_of(h: np.ndarray, words_out: int = 1) -> list[int]:
    """SimHash of shingle hashes: signed longs, the first from the hashes, further ones from mixes of them; none: zeros."""
    n = len(h)
    if not n:
        return [0] * words_out
    out = []
    for k in range(words_out):
        octets = (h if k == 0 else mixed(h, k)).view(np.uint8).reshape(n, 8)
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 1 << 16):
            ones += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0]))
    return out


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits from each hash (a multiply and xor-shift mix)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((k * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def fingerprint(text: Column, width: int = 4) -> Column:
    """64 bits as a signed long; null and empty texts give zero."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(shingle_hashes(t, width))[0] for t in texts], dtype="int64")

    return simhash(text.cast("binary"))


def sketch(text: Column, width: int) -> Column:
    """Struct of a text's set of shingles: node (a hash of the set), w0 to w3 (its fingerprint) and shingles.

    shingles are 32 bits of each distinct shingle's hash, sorted: two texts of n shingles see a common one too many with
    a chance of n^2 / 2^32, which shifts their similarity by 1 / n.
    """
    names = [f"w{k}" for k in range(WIDE // 64)]

    @F.pandas_udf(f"struct<node:bigint,{','.join(f'{n}:bigint' for n in names)},shingles:binary>")
    def sketched(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            h = np.unique(shingle_hashes(t, width))
            node = xxhash.xxh64_intdigest(h.tobytes(), SEED)
            rows.append((node - (1 << 64) if node >> 63 else node, *fingerprint_of(h, len(names)), np.unique((h >> np.uint64(32)).astype("<u4")).tobytes()))
        return pd.DataFrame(rows, columns=["node", *names, "shingles"])

    return sketched(text.cast("binary"))


def pivots(words: int = 1, count: int = PIVOTS) -> np.ndarray:
    """Full-width reference fingerprints: hashes of 0, 1, 2, ... One row each."""
    return np.array([[xxhash.xxh64_intdigest(f"{i}.{w}", 1) for w in range(words)] for i in range(count)], dtype=np.uint64)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def exact_masks(limit: int, count: int = 1) -> list[int]:
    """Tables for every pair within a limit on 64 bits: the bits of each choice of k out of limit + k sets.

    k, two at least, is the least for which a bucket of a table holds some four of so many unrelated fingerprints.
    """
    kept = next((k for k in range(2, 7) if 4 << (64 * k // (limit + k)) >= count), 6)
    parts = limit + kept
    cuts = [round(i * 64 / parts) for i in range(parts + 1)]
    masks = [((1 << (z - a)) - 1) << a for a, z in zip(cuts, cuts[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(masks, kept)]


def differing(similarity: float) -> float:
    """Share of bits that differ on average between sets of a Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def wide_limit(similarity: float, bits: int = WIDE) -> int:
    p = differing(similarity)
    return math.floor(bits * p + ABOVE * math.sqrt(bits * p * (1 - p)))


def sampled_masks(count: int, similarity: float, bits: int = WIDE) -> list[list[int]]:
    """Tables for a similarity among so many fingerprints: random sets of bits, larger and more of them as count grows."""
    size = min(48, max(8, math.ceil(math.log2(max(2, count))) - 4))
    agree = (1 - differing(similarity)) ** size
    generator = np.random.default_rng(SEED)
    masks = []
    for _ in range(math.ceil(math.log(1 - RECALL) / math.log(1 - agree))):
        chosen = generator.choice(bits, size, replace=False).tolist()
        masks.append([sum(1 << (b % 64) for b in chosen if b // 64 == w) for w in range(bits // 64)])
    return masks


def table_keys(words: list[Column], masks: list[list[int]]) -> Column:
    """Array of structs (t, key): the bits that a fingerprint has in each table, packed."""
    packed = lambda mask: [w.bitwiseAND(F.lit(signed(m)).cast("long")) for w, m in zip(words, mask, strict=True)]
    keys = [p[0] if len(p) == 1 else F.xxhash64(*p) for p in map(packed, masks)]
    return F.array(*[F.struct(F.lit(t).alias("t"), k.alias("key")) for t, k in enumerate(keys)])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


GROUP = ["t", "key", "bi", "bj"]


def bucket_rows(fps: DataFrame, names: list[str], masks: list[list[int]], block: int, member: str) -> DataFrame:
    """Fingerprints (columns names) in the blocks of each table's buckets: GROUP, blk, the member's id and names."""
    keys = fps.select(member, *names, F.explode(table_keys([F.col(n) for n in names], masks)).alias("k"))
    keys = keys.select(member, *names, "k.t", "k.key")
    return common.blocked_buckets(keys, ["t", "key"], member, block).select(*GROUP, member, "blk", *names)


def first_met_pairs(whole: pa.Table, names: list[str], masks: np.ndarray, limit: int, refs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the groups in a table that lie within the limit and meet in no earlier table.

    Where two blocks meet only pairs across them are looked at. The pivot distances discard pairs by their largest
    coordinate difference before the fingerprints themselves are compared.
    """
    words = np.stack([whole[n].to_numpy().astype(np.int64).view(np.uint64) for n in names], axis=1)
    pivoted = np.stack([distances(words, r) for r in refs], axis=1)
    t, blk = whole["t"].to_numpy(), whole["blk"].to_numpy()
    two = whole["bi"].to_numpy() != whole["bj"].to_numpy()
    for i, j in common.pairs_within(common.group_bounds(whole, GROUP), 8 * (len(names) + len(refs))):
        for k in range(pivoted.shape[1]):
            close = np.abs(pivoted[i, k] - pivoted[j, k]) <= limit
            i, j = i[close], j[close]
        across = ~two[i] | (blk[i] != blk[j])
        i, j = i[across], j[across]
        close = distances(words[i], words[j]) <= limit
        i, j = i[close], j[close]
        for at in range(0, max(1, len(i)), 1 << 14):
            x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            agree = ~((words[x] ^ words[y])[:, None, :] & masks[None]).any(axis=2)
            first = agree.argmax(axis=1) == t[x]
            yield x[first], y[first]


def near_fingerprints(fps: DataFrame, masks: list[int], limit: int) -> DataFrame:
    """Edges (a, b) that connect the fingerprints (fp, long, one row each) within the limit; not all pairs of a group."""
    blocks = bucket_rows(fps.select("fp", F.col("fp").alias("w0")), ["w0"], [[m] for m in masks], BLOCK, "fp")
    refs, table = pivots(), np.array([[m] for m in masks], dtype=np.uint64)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, GROUP):
            ids, forest = whole["fp"].to_numpy(), common.Forest(whole.num_rows)
            for i, j in first_met_pairs(whole, ["w0"], table, limit, refs):
                forest.link_all(i, j)
            if forest.edges:
                i, j = np.array(forest.edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return blocks.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(edges, "a long, b long")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, limit: int = 4) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id. Fingerprints link at limit or fewer differing bits.

    component_id is the smallest id reachable over links; null where no row of the class has an id. Null and empty texts
    share the fingerprint zero and are linked like any other. Equal rows are separate rows of one class. An empty table gives
    no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), width).alias("fp"))
    rows = common.materialise(rows, TEXTS)
    fps = common.materialise(rows.groupBy("fp").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")))
    linked = common.connected_components(near_fingerprints(fps, exact_masks(limit, fps.count()), limit))
    roots = fps.join(linked, fps.fp == linked.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    roots = common.materialise(roots)
    lows = roots.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("members"))
    classes = common.join_groups(roots.drop("low"), common.materialise(lows), "root", "members")
    return common.join_groups(rows, common.materialise(classes.select("fp", "n", "component_id")), "fp", "n").select("id", "fp", "component_id")


def sets_of(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows one after the other, and where each row's begin (and the end)."""
    values = column.to_pylist()
    starts = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum([len(v) // 4 for v in values], out=starts[1:])
    return np.frombuffer(b"".join(values), dtype="<u4"), starts


def similar(shingles: np.ndarray, starts: np.ndarray, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the other rows' sets have at least the Jaccard similarity with row i's."""
    own = shingles[starts[i] : starts[i + 1]]
    sizes = starts[others + 1] - starts[others]
    alike = np.minimum(sizes, len(own)) >= similarity * np.maximum(sizes, len(own)) - 1e-9
    kept = np.flatnonzero(alike & (sizes > 0)) if len(own) else np.zeros(0, dtype=np.int64)
    out = np.zeros(len(others), dtype=bool)
    if len(kept):
        held = np.concatenate([shingles[starts[j] : starts[j + 1]] for j in others[kept].tolist()])
        at = np.searchsorted(own, held)
        at[at == len(own)] = 0
        shared = np.add.reduceat(own[at] == held, np.cumsum(sizes[kept]) - sizes[kept], dtype=np.int64)
        out[kept] = shared >= similarity * (sizes[kept] + len(own) - shared) - 1e-9
    return out


def verified_edges(sketches: DataFrame, sets: DataFrame, masks: list[list[int]], limit: int, similarity: float) -> DataFrame:
    """Edges (a, b) between nodes whose shingle sets have the similarity; not all pairs of a group.

    sketches: node and w0 to w3; sets: node and shingles. Only nodes that have a candidate partner by their fingerprints
    fetch their sets. Every candidate pair is verified in the first table in which it meets, unless its two nodes are
    connected there already.
    """
    names = [f"w{k}" for k in range(WIDE // 64)]
    blocks = bucket_rows(sketches, names, masks, SET_BLOCK, "node")
    table, refs = np.array(masks, dtype=np.uint64), pivots(len(names), 2)
    member = [*GROUP, "blk", "node", *names]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, GROUP):
            met = np.zeros(whole.num_rows, dtype=bool)
            for i, j in first_met_pairs(whole, names, table, limit, refs):
                met[i] = met[j] = True
            if met.any():
                yield from whole.select(member).filter(pa.array(met)).combine_chunks().to_batches()

    schema = "t int, key long, bi int, bj int, blk int, node long, " + ", ".join(f"{n} long" for n in names)
    found = common.materialise(blocks.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(members, schema))
    # One set per node and task before sets are dealt out: copies don't meet in one task.
    single = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    dealt = found.join(single, "node").select(*member, "shingles")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, GROUP):
            ids, forest = whole["node"].to_numpy(), common.Forest(whole.num_rows)
            shingles, starts = sets_of(whole["shingles"])
            for left, right in first_met_pairs(whole, names, table, limit, refs):
                bounds = [*np.flatnonzero(np.diff(left, prepend=-1)).tolist(), len(left)]
                for s, e in zip(bounds, bounds[1:], strict=False):
                    i, others = int(left[s]), right[s:e]
                    others = others[forest.label[others] != forest.label[i]]
                    for at in range(0, len(others), SET_BLOCK):
                        part = others[at : at + SET_BLOCK]
                        if len(part := part[similar(shingles, starts, i, part, similarity)]):
                            forest.link(i, part)
            if forest.edges:
                i, j = np.array(forest.edges).T
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(edges, "a long, b long")


def keep_one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """The documents without near copies: of each class the row with the smallest id stays, whole.

    Two documents link if their sets of shingles (width words) have the Jaccard similarity or more; every link is verified
    on the sets, and a class is what links connect. Pairs just at the similarity are found with RECALL, nearer ones more
    often. Texts without words are copies of each other. Of rows with equal id and text one stays. Where no row of a class
    has an id, the one with the least text hash stays. Ids may be numbers or texts. An empty table gives no rows; all columns are kept.
    """
    sketched = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), sketch(F.col(text_col), width).alias("s"))
    rows = common.materialise(sketched.select("id", "h", "s.*"), TEXTS)
    names = [f"w{k}" for k in range(WIDE // 64)]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("k")
    nodes = common.materialise(rows.groupBy("node").agg(first, *[F.min(n).alias(n) for n in names]))
    masks = sampled_masks(nodes.count(), similarity)
    edges = verified_edges(nodes.select("node", *names), rows.select("node", "shingles"), masks, wide_limit(similarity), similarity)
    linked = common.connected_components(edges).withColumnRenamed("node", "_node")
    roots = nodes.select("node", "k").join(linked, F.col("node") == F.col("_node"), "left")
    kept = roots.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("k").alias("k"))
    keys = ["_qm_none", "_qm_id", "_qm_h"]
    kept = kept.select(F.col("k.none").alias(keys[0]), F.coalesce(F.col("k.id").cast("string"), F.lit("")).alias(keys[1]), F.col("k.h").alias(keys[2]))
    own = {keys[0]: F.col(id_col).isNull(), keys[1]: F.coalesce(F.col(id_col).cast("string"), F.lit("")), keys[2]: F.xxhash64(text_col)}
    # Equal rows become one before they are dealt out, so that no task gets many of them.
    return docs.withColumns(own).dropDuplicates(keys).join(kept, keys, "left_semi").drop(*keys)


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_classes(common.table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), "component_id")
