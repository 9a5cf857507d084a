"""Phrase collocation mining with weighted acyclic automata.

Four passes over the texts, each of which sums counts within a task before anything is shuffled. The first counts words. The
second counts pairs of frequent words by buckets of a hash, which leave out pairs that are surely rare, and the third does
the same for longer phrases of frequent pairs. The last counts the phrases that may be frequent: every shard sorts its phrases
and builds automata with counts, one for each range of prefixes (ranges of a hash of the first two words), and the automata
of a range are united, their weights summed. Parts of phrases are looked up by composing an automaton of the questions with the range's automaton.

Nothing that a phrase of the wanted count needs is left out: all its words and pairs are at least as frequent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import automata, common

#: Words of the longest phrases.
LONGEST = 4
#: Bytes of text that a task counts together, and texts that it takes out of an Arrow batch at a time.
CHARACTERS, ROWS = 6 << 20, 500
#: Bits of a bucket's number; a set of buckets takes 2 ** (BITS - 3) bytes, 16 MB, however large the corpus.
BITS = 27
#: Words of the corpus for each range of prefixes, and the least number of ranges.
RANGE_WORDS, LEAST_RANGES = 2_000_000, 16
#: States of shard automata that are held before they are united.
HELD = 1_000_000
UPPER = bytes(range(65, 91))
PIECE_ENDS = b".,;:!?\x0b\x0c\r"
TRANSLATED = bytes.maketrans(UPPER + PIECE_ENDS + b"\t", UPPER.lower() + b"\n" * len(PIECE_ENDS) + b" ")
AUTOMATON = "words array<string>, weights array<long>, first array<int>, labels array<int>, targets array<int>"
AUTOMATON_TYPES = [pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3]


# What tasks do with texts.


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(lang, distinct words, places of a text's words in them, -1 between pieces), so many texts of one lang at a time."""

    def coded(lang: str, texts: list[bytes]) -> tuple[str, pa.Array, np.ndarray]:
        blob = b"\n".join(texts).translate(TRANSLATED).replace(b"\n", b" \n ")
        words = pc.split_pattern(pa.array([blob], pa.large_binary()).cast(pa.large_string()), " ").flatten().dictionary_encode()
        known, at = words.dictionary, words.indices.to_numpy()
        empty, end = (pc.index(known, pa.scalar(x, known.type)).as_py() for x in ("", "\n"))
        at = at[at != empty]
        return lang, known, np.where(at == end, -1, at)

    for batch in batches:
        of: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for some in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
            for lang, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                of.setdefault(lang, []).append(text)
                size[lang] = size.get(lang, 0) + len(text)
                if size[lang] >= CHARACTERS:
                    yield coded(lang, of.pop(lang))
                    del size[lang]
        for lang, texts in of.items():
            yield coded(lang, texts)


def bucket_of(lang: str, phrase: tuple[str, ...]) -> int:
    """CRC-32 of lang and words, which Spark computes alike."""
    return zlib.crc32(" ".join((lang, *phrase)).encode())


def crc(*parts: Column) -> Column:
    return F.crc32(F.concat_ws(" ", *parts).cast("binary"))


def inside(buckets: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    return (buckets[numbers >> 3] >> (numbers & 7).astype(np.uint8) & 1).astype(bool)


def frequent_words(lang: str, words: pa.Array, buckets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """Which words may be frequent, and all words."""
    texts = words.to_pylist()
    numbers = np.fromiter((bucket_of(lang, (w,)) for w in texts), dtype=np.int64, count=len(texts)) >> (32 - BITS)
    return inside(buckets, numbers), texts


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = (left * np.uint64(0x9E3779B97F4A7C15) + right) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def places(
    lang: str, texts: list[str], keep: np.ndarray, at: np.ndarray, pairs: np.ndarray | None = None, longer: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 2, 3, ... words: where they start, and their buckets.

    Only phrases inside one piece, of frequent words, that the sets (of pairs, of longer phrases) hold; and only those whose
    two parts without the last and without the first word are such phrases.
    """
    hashes = np.zeros(len(texts) + 1, dtype=np.uint64)
    seed = zlib.crc32(lang.encode())
    rows = np.flatnonzero(keep)
    hashes[rows] = np.fromiter((xxhash.xxh64_intdigest(texts[i].encode(), seed) for i in rows.tolist()), dtype=np.uint64, count=len(rows))
    full = hashes[at]  # -1 takes the last
    good = np.append(keep, False)[at]
    starts = np.flatnonzero(good)
    for size in range(2, LONGEST + 1):
        starts = starts[starts + size <= len(at)]
        starts = starts[good[starts + 1]]
        code = mixed(full[starts], hashes[at[starts + size - 1]])
        buckets = (code >> np.uint64(64 - BITS)).astype(np.int64)
        known = pairs if size == 2 else longer
        if known is not None:
            there = inside(known, buckets)
            starts, code, buckets = starts[there], code[there], buckets[there]
        yield starts, buckets
        good = np.zeros(len(at), dtype=bool)
        good[starts] = True
        full = np.zeros(len(at), dtype=np.uint64)
        full[starts] = code


def counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, count); the null word has all words' count."""
    for lang, words, at in shards(batches):
        counts = np.bincount(at[at >= 0], minlength=len(words))
        rows = np.flatnonzero(counts)
        texts = pa.concat_arrays([words.take(pa.array(rows)).cast(pa.string()), pa.nulls(1, pa.string())])
        every = np.append(counts[rows], counts.sum())
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(every), pa.string()), texts, pa.array(every)], names=["lang", "word", "count"])


def phrases_of(lang: str, texts: list[str], at: np.ndarray, found_at: list[np.ndarray], ranges: int) -> Iterator[tuple[int, automata.Transducer]]:
    """(range, automaton) of a shard's phrases, which start at found_at (of two words, of three, ...)."""
    part = np.zeros(len(at), dtype=bool)
    part[found_at[0]] = True
    part[found_at[0] + 1] = True
    used, words = np.unique(at[part], return_inverse=True)
    names = [texts[i] for i in used.tolist()]
    order = sorted(range(len(names)), key=names.__getitem__)
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    names = [names[i] for i in order]
    place = np.full(len(at), -1, dtype=np.int64)
    place[part] = rank[words]
    found, counts, number_at = [], [], place
    for size, starts in enumerate(found_at, 2):
        # A phrase of size words is one of size - 1 words, by its number, and a word.
        kinds, code, number = np.unique(number_at[starts] << 32 | place[starts + size - 1], return_inverse=True, return_counts=True)
        before = kinds >> 32
        table = np.full((len(kinds), LONGEST), -1, dtype=np.int64)
        table[:, : size - 1] = before[:, None] if size == 2 else found[-1][before, : size - 1]
        table[:, size - 1] = kinds & 0xFFFFFFFF
        found.append(table)
        counts.append(number)
        number_at = np.full(len(at), -1, dtype=np.int64)
        number_at[starts] = code
    table, number = np.concatenate(found), np.concatenate(counts)
    if not len(table):
        return
    pairs, of = np.unique(table[:, 0] << 32 | table[:, 1], return_inverse=True)
    prefix = np.array([bucket_of(lang, (names[p >> 32], names[p & 0xFFFFFFFF])) % ranges for p in pairs.tolist()])[of]
    order = np.lexsort((*table.T[::-1], prefix))
    table, number, prefix = table[order], number[order], prefix[order]
    bounds = [*np.flatnonzero(np.diff(prefix, prepend=-1)).tolist(), len(prefix)]
    for s, e in zip(bounds, bounds[1:], strict=False):
        sorted_ = zip(table[s:e].tolist(), number[s:e].tolist(), strict=True)
        yield int(prefix[s]), automata.build((tuple([names[i] for i in row if i >= 0]), count) for row, count in sorted_)


def as_rows(found: list[tuple[int, str, automata.Transducer]]) -> pa.RecordBatch:
    ranges, langs, machines = zip(*found, strict=True) if found else ((), (), ())
    columns = list(zip(*machines, strict=True)) or [()] * 5
    arrays = [pa.array(c, t) for c, t in zip(columns, AUTOMATON_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(langs, pa.string()), *arrays], names=["range", "lang", *automata.Transducer._fields])


def machines(batch: pa.RecordBatch) -> Iterator[automata.Transducer]:
    columns = [batch.column(n).to_pylist() for n in automata.Transducer._fields]
    return (automata.Transducer(*x) for x in zip(*columns, strict=True))


# What Spark does.


def bucket_set(spark: SparkSession, numbers: DataFrame) -> Broadcast:
    """A set of buckets (column bucket) as a bitmap of fixed size in all tasks."""
    b = F.col("bucket").cast("long")
    rows = numbers.groupBy(F.bitmap_bucket_number(b).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(b)).alias("bits")).collect()
    whole = np.zeros(1 << (BITS - 3), dtype=np.uint8)
    for part, bits in rows:  # parts of 32,768 buckets; bucket 0 is number 1's position 0
        if part:
            whole[(part - 1) << 12 :][: 1 << 12] |= np.frombuffer(bytes(bits), dtype=np.uint8)[: len(whole) - ((part - 1) << 12)]
    return spark.sparkContext.broadcast(whole)


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, count of words with at least least occurrences; the null word has the lang's count of all words."""
    counted = docs.mapInArrow(counted_words, "lang string, word string, count long").groupBy("lang", "word").agg(F.sum("count").alias("count"))
    return common.materialise(counted.where((F.col("count") >= least) | F.col("word").isNull()))


def phrase_set(docs: DataFrame, words: Broadcast, pairs: Broadcast | None, least: int) -> Broadcast:
    """Buckets of phrases with at least least occurrences: of pairs, or of longer phrases if the pairs are given."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, known, at in shards(batches):
            keep, texts = frequent_words(lang, known, words.value)
            found = [buckets for _, buckets in islice(places(lang, texts, keep, at, pairs and pairs.value), 1 if pairs is None else None)]
            numbers, counts = np.unique(np.concatenate(found if pairs is None else found[1:]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(counts, pa.int32())], names=["bucket", "count"])

    counted = docs.mapInArrow(count, "bucket int, count int").groupBy("bucket").agg(F.sum("count").alias("count"))
    return bucket_set(docs.sparkSession, counted.where(F.col("count") >= least).select((F.col("bucket").cast("long") + 1).alias("bucket")))


def shard_automata(docs: DataFrame, words: Broadcast, pairs: Broadcast, longer: Broadcast, ranges: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, known, at in shards(batches):
            keep, texts = frequent_words(lang, known, words.value)
            found = [starts for starts, _ in places(lang, texts, keep, at, pairs.value, longer.value)]
            yield as_rows([(r, lang, machine) for r, machine in phrases_of(lang, texts, at, found, ranges)])

    return docs.mapInArrow(count, f"range int, lang string, {AUTOMATON}")


def word_automata(words: DataFrame, ranges: int) -> DataFrame:
    """The words themselves as automata of their ranges."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of: dict[tuple[int, str], list] = {}
            for lang, word, count in zip(*[batch.column(n).to_pylist() for n in ("lang", "word", "count")], strict=True):
                of.setdefault((bucket_of(lang, (word,)) % ranges, lang), []).append(((word,), count))
            yield as_rows([(r, lang, automata.build(sorted(found))) for (r, lang), found in of.items()])

    return words.where("word IS NOT NULL").mapInArrow(make, f"range int, lang string, {AUTOMATON}")


def united(parts: DataFrame, ranges: int, least: int) -> DataFrame:
    """One automaton for each range and lang, with the phrases of at least least occurrences."""

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, states = None, [], 0
        for batch in batches:
            keys = zip(batch.column("range").to_pylist(), batch.column("lang").to_pylist(), strict=True)
            for now, machine in zip(keys, machines(batch), strict=True):
                if now != key:
                    if held:
                        yield as_rows([(*key, automata.union(held, least))])
                    key, held, states = now, [], 0
                held.append(machine)
                states += len(machine.weights)
                if states > HELD and len(held) > 8:
                    held = [automata.union(held)]
                    states = 0  # counted anew: what is united stays
        if held:
            yield as_rows([(*key, automata.union(held, least))])

    dealt = parts.repartition(ranges, "range", "lang").sortWithinPartitions("range", "lang")
    return common.materialise(dealt.mapInArrow(unite, f"range int, lang string, {AUTOMATON}"))


def candidates_of(united_: DataFrame) -> DataFrame:
    """lang, words, counts (of the first 1, 2, ... words; 0 for one word): the phrases of two words and more."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, machine in zip(batch.column("lang").to_pylist(), machines(batch), strict=True):
                found = [(phrase, way) for phrase, way in machine.phrases() if len(phrase) > 1]
                arrays = [pa.array([lang] * len(found), pa.string()), pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([w for _, w in found], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["lang", "words", "counts"])

    return united_.mapInArrow(walk, "lang string, words array<string>, counts array<long>")


def looked_up(asked: DataFrame, united_: DataFrame, ranges: int) -> DataFrame:
    """asked (lang, part: words) with count: each range's questions as an automaton, composed with the range's automaton."""
    prefix = F.when(F.size("part") > 1, crc(F.col("lang"), F.get("part", F.lit(0)), F.get("part", F.lit(1)))).otherwise(crc(F.col("lang"), F.get("part", F.lit(0))))
    questions = asked.select((prefix % ranges).cast("int").alias("range"), "lang", "part").withColumn("kind", F.lit(1))
    both = united_.withColumn("kind", F.lit(0)).unionByName(questions, allowMissingColumns=True)
    dealt = both.repartition(ranges, "range", "lang").sortWithinPartitions("range", "lang", "kind", "part")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, key, builder = None, (None, None), automata.Builder()

        def answers() -> pa.RecordBatch:
            found = list(automata.compose(builder.finish(), machine))
            arrays = [pa.array([key[1]] * len(found), pa.string()), pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([n for _, n in found], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["lang", "part", "count"])

        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("kind", "range", "lang", "part")]
            for row, (kind, *now, part) in enumerate(zip(*columns, strict=True)):
                if tuple(now) != key:
                    if machine:
                        yield answers()
                    machine, key, builder = None, tuple(now), automata.Builder()
                if kind:
                    builder.add(tuple(part), 1)
                else:
                    machine = next(machines(batch.slice(row, 1)))
        if machine:
            yield answers()

    return dealt.mapInArrow(answer, "lang string, part array<string>, count long")


def scored(found: DataFrame, united_: DataFrame, ranges: int) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate: its lowest-scoring cut, the first of equal ones."""
    found = found.withColumn("phrase", F.array_join("words", " ")).withColumn("a", F.element_at("counts", -1))
    # Parts that the candidate's own path doesn't count: its first word, and what follows each cut.
    size = F.size("words")
    slots = [F.struct(F.lit(0).alias("slot"), F.slice("words", 1, 1).alias("part"))]
    slots += [F.when(size > k, F.struct(F.lit(k).alias("slot"), F.slice("words", F.lit(k + 1), size - k).alias("part"))) for k in range(1, LONGEST)]
    asked = found.select("lang", "phrase", "a", "counts", F.explode(F.filter(F.array(*slots), lambda x: x.isNotNull())).alias("x")).select("lang", "phrase", "a", "counts", "x.*")
    asked = common.materialise(asked.withColumn("key", F.concat_ws("\n", "lang", F.array_join("part", " "))))
    groups = asked.groupBy("key").agg(F.first("lang").alias("lang"), F.first("part").alias("part"), F.count(F.lit(1)).alias("n"))
    groups = common.materialise(groups)
    answers = looked_up(groups.select("lang", "part"), united_, ranges)
    answers = answers.withColumn("key", F.concat_ws("\n", "lang", F.array_join("part", " "))).select("key", "count")
    answers = common.materialise(answers.join(groups.select("key", "n"), "key"))
    told = common.join_groups(asked.select("key", "lang", "phrase", "a", "counts", "slot"), answers, "key", "n")
    parts = told.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("counts").alias("counts"), F.map_from_entries(F.collect_list(F.struct("slot", "count"))).alias("of")
    )
    wide = "decimal(19,0)"
    cuts = []
    for k in range(1, LONGEST):
        left = F.element_at("of", F.lit(0)) if k == 1 else F.get("counts", F.lit(k - 1))
        right = F.element_at("of", F.lit(k))
        # As decimals, which hold the product exactly.
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * F.col("a").cast(wide), left.cast(wide) + right.cast(wide))
        cuts.append(F.when(F.size("counts") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))))
    parts = parts.withColumn("cut", F.array_min(F.array(*cuts)))
    return parts.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def mine(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, top: int = 2000, share: int = 80
) -> DataFrame:
    """Each lang's first top phrases of 2 to 4 words: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends, and those into words at blanks and tabs. Everything
    counts within one lang; a null lang is und. a, l, r: occurrences of a phrase (at least least), of the words before its
    lowest-scoring cut, and of those after it; n: of all words. A phrase inside a longer candidate that has at least
    share % of its occurrences goes. Null and empty texts have no words, repeated rows count again, ties go by occurrences
    and then by the phrase's bytes. Other columns are left out. An empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    words = word_counts(docs, least)
    totals = words.where("word IS NULL").select("lang", F.col("count").alias("n"))
    ranges = max(LEAST_RANGES, (totals.agg(F.sum("n")).first()[0] or 0) // RANGE_WORDS)
    number = F.shiftright(crc(F.col("lang"), F.col("word")), 32 - BITS) + 1
    frequent = bucket_set(spark, words.where("word IS NOT NULL").select(number.alias("bucket")))
    pairs = phrase_set(docs, frequent, None, least)
    longer = phrase_set(docs, frequent, pairs, least)
    parts = shard_automata(docs, frequent, pairs, longer, ranges).unionByName(word_automata(words, ranges))
    whole = united(parts, ranges, least)
    found = common.materialise(candidates_of(whole))
    # Contiguous parts of two words and more of each longer candidate, with its occurrences.
    inner = [(i, n) for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)]
    size = F.size("words")
    subs = F.filter(F.array(*[F.when((size > n) & (size >= i + n - 1), F.array_join(F.slice("words", i, n), " ")) for i, n in inner]), lambda x: x.isNotNull())
    longer = found.where(size > 2).select("lang", F.explode(subs).alias("phrase"), F.element_at("counts", -1).alias("a"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    every = scored(found, whole, ranges).join(longer, ["lang", "phrase"], "left")
    wide = "decimal(21,0)"
    left = every.where(F.col("around").isNull() | (F.col("around").cast(wide) * 100 < F.col("a").cast(wide) * share))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    return mine(common.table(spark, sf_dir, "documents"))


#: The same by counting all phrases.
OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
f AS (
  SELECT lang, k, w[i:i + k - 1] AS p, count(*) AS c
  FROM places, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT * FROM f WHERE c >= 30),
candidate AS (SELECT * FROM often WHERE k > 1),
cut AS (
  SELECT c.lang, c.p, c.c AS a, c.j, x.c AS l, y.c AS r, (2000000::HUGEINT * c.c) // (x.c + y.c) AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM candidate) c
  JOIN often x ON x.lang = c.lang AND x.p = c.p[1:c.j]
  JOIN often y ON y.lang = c.lang AND y.p = c.p[c.j + 1:c.k]),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_part AS (
  SELECT lang, p[i:i + m - 1] AS p, max(c) AS around
  FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM candidate), (SELECT unnest([2, 3]) AS m)
  WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
ranked AS (
  SELECT lowest.lang, array_to_string(lowest.p, ' ') AS phrase, a, l, r, score
  FROM lowest LEFT JOIN inner_part s ON s.lang = lowest.lang AND s.p = lowest.p
  WHERE around IS NULL OR 100 * around < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked)
JOIN n USING (lang) WHERE rank <= 2000
"""
