"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Every task tokenises its own documents, cuts those longer than a sequence, and packs the pieces by decreasing length: a piece
goes into the open sequence whose choice makes the sum of the squared numbers of open sequences per residual gap smallest,
and opens a new one if it fits into none. No text and no identifier is shuffled. Sequences that a task leaves loosely filled
are opened again and their pieces packed together with those of other tasks, level by level, until that gains little.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordbpe

#: Tokens of a sequence.
LENGTH = 2048
#: Pieces that one task packs together, and characters of text that it tokenises together.
CHUNK, CHARACTERS = 50_000, 4_000_000
#: A sequence with this share of its places left or more is opened again at the next level.
LOOSE = 1 / 128
#: Levels stop where the loose sequences no longer fall below this share.
GAIN = 0.5
#: Bits of a sequence number below the number of its task or group.
LOCAL = 36


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence number (from 0) and place of each piece, and the residual gap of each sequence.

    Pieces go by decreasing length, equal ones in the given order. Moving one of the N[g] sequences with gap g to gap g - w
    changes the sum of squares by 2 * (N[g - w] - N[g]) + 2, closing it (g = w) by 1 - 2 * N[g]. Of equal changes the
    smallest gap counts, of sequences with one gap the last touched.
    """
    count = np.zeros(size + 1, dtype=np.int64)
    members: list[list[int]] = [[] for _ in range(size + 1)]
    gaps: list[int] = []
    sequence, place = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    never = np.iinfo(np.int64).max
    for i in np.argsort(-lengths, kind="stable").tolist():
        w = int(lengths[i])
        at = size
        if w < size:
            now = count[w:size]
            change = np.where(now > 0, 2 * (count[: size - w] - now) + 2, never)
            if now[0]:
                change[0] = 1 - 2 * now[0]
            k = int(change.argmin())
            at = k + w if change[k] != never else size
        if at < size:
            number = members[at].pop()
            count[at] -= 1
        else:
            number = len(gaps)
            gaps.append(size)
        sequence[i], place[i] = number, size - at
        gaps[number] = at - w
        if at > w:
            members[at - w].append(number)
            count[at - w] += 1
    return sequence, place, np.array(gaps, dtype=np.int64)


def pieces_of(identifiers: bytes, size: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, CRC-32) of one document's identifiers, 4 bytes each."""
    step = 4 * size
    return [
        (n, at // 4, len(part) // 4, zlib.crc32(part))
        for n, at in enumerate(range(0, len(identifiers), step))
        for part in [identifiers[at : at + step]]
    ]


def chunks_by_characters(texts: list[str]) -> Iterator[list[str]]:
    held, total = [], 0
    for t in texts:
        held.append(t)
        total += len(t)
        if total >= CHARACTERS:
            yield held
            held, total = [], 0
    if held:
        yield held


def packed(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, size: int, end: int) -> DataFrame:
    """Pieces of all documents, packed by the tasks that read them; gap is what their sequence has left."""
    docs.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name
    last = np.array([end], dtype="<u4").tobytes()
    kind = docs.schema[id_col].dataType
    out_schema = pa.schema([pa.field(n, pa.int64()) for n in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset", "gap")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = wordbpe.encoder(SparkFiles.get(name))
        base = TaskContext.get().partitionId() << LOCAL
        ids: list[pa.Array] = []
        rows: list[tuple[int, int, int, int]] = []
        done = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, rows, done
            if not rows:
                return
            table = np.array(rows, dtype=np.int64)
            rows = []
            sequence, place, gaps = sum_of_squares(table[:, 2], size)
            columns = [*table.T, base + done + sequence, place, gaps[sequence]]
            done += len(gaps)
            found = pa.concat_arrays(ids)
            ids = []
            yield pa.RecordBatch.from_arrays([found, *map(pa.array, columns)], names=["id", *out_schema.names])

        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            at = 0
            for some in chunks_by_characters(texts):
                parts = [pieces_of(ids_.astype("<u4").tobytes() + last, size) for ids_ in encoder.texts(some)]
                rows += [p for part in parts for p in part]
                of = np.repeat(np.arange(at, at + len(some)), [len(part) for part in parts])
                ids.append(batch.column(0).take(pa.array(of)))
                at += len(some)
                if len(rows) >= CHUNK:
                    yield from flush()
        yield from flush()

    fields = "piece long, start long, length long, ids_crc32 long, sequence_id long, offset long, gap long"
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(
        pack, f"id {kind.simpleString()}, {fields}"
    )


def repacked(loose: DataFrame, level: int, groups: int, size: int) -> DataFrame:
    """The pieces of loose sequences, packed anew in so many groups of whole sequences."""
    group = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups))
    columns = [*loose.columns]
    dealt = loose.withColumn("_group", group).repartition(groups, "_group").sortWithinPartitions("_group", "sequence_id", "offset")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in common.whole_groups(batches, ["_group"]):
            bounds = common.group_bounds(whole, ["_group"]).tolist()
            for s, e in zip(bounds, bounds[1:], strict=False):
                part = whole.slice(s, e - s)
                base = (1 << 62) | level << 56 | part["_group"][0].as_py() << LOCAL
                sequence, place, gaps = sum_of_squares(part["length"].to_numpy(), size)
                for column, values in (("sequence_id", base + sequence), ("offset", place), ("gap", gaps[sequence])):
                    part = part.set_column(part.column_names.index(column), column, pa.array(values))
                yield from part.select(columns).combine_chunks().to_batches()

    return dealt.mapInArrow(pack, loose.schema)


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", size: int = LENGTH, end: int = 0
) -> DataFrame:
    """One row per piece: id, piece (from 0), start, length, ids_crc32, sequence_id, offset.

    A document is its text's identifiers and the identifier end. Only documents longer than size are cut, into pieces of
    size tokens; the last may be shorter. Null and empty texts are the end alone. Null ids and repeated rows are documents
    like any other; other columns are left out. An empty table gives no rows. Sequence numbers name sequences and nothing
    else; each sequence's pieces stand from offset 0 without gaps.
    """
    whole = common.materialise(packed(docs, vocabulary, id_col, text_col, size, end))
    is_loose = F.col("gap") >= max(1, int(size * LOOSE))
    done, loose = whole.where(~is_loose), whole.where(is_loose)
    level, groups, before = 0, 2, float("inf")
    while True:
        pieces, sequences = loose.agg(F.count(F.lit(1)), F.count_distinct("sequence_id")).first()
        if sequences < 2 or groups == 1 or sequences > before * GAIN:
            break
        level, groups, before = level + 1, -(-pieces // CHUNK), sequences
        again = common.materialise(repacked(loose, level, groups, size))
        done, loose = done.unionByName(again.where(~is_loose)), again.where(is_loose)
    return done.unionByName(loose).drop("gap")


def op11_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed_ = pack(common.table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))
    return packed_.withColumnRenamed("id", "doc_id")
