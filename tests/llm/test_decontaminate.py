import random
import re
import tracemalloc

import numpy as np
import pandas as pd
from brute import ascii_lower
from pyspark.sql import functions as F

from quarrymill.llm import decontaminate as D

WORDS = [f"w{k}" for k in range(500)]


def words_in(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))


def parts_of(words):
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def expected(items, text):
    """Items of which a text holds 0.8 of the five-word shingles, or of the question's and the last sentence's."""
    held = parts_of(words_in(text))
    out = set()
    for i, t in items:
        whole = parts_of(words_in(t))
        sentences = [w for s in re.split(r"(?<=[.?!])[\x20\x09-\x0d]+", (t or "").strip()) if (w := words_in(s))]
        question = parts_of([w for s in sentences[:-1] for w in s]) if len(sentences) > 1 else whole
        answer = parts_of(sentences[-1]) if len(sentences) > 1 else whole
        share = lambda x: len(x & held) / len(x)
        if whole and (share(whole) >= 0.8 or (share(question) >= 0.8 and share(answer) >= 0.8)):
            out.add(i)
    return out


def test_planted_passages(spark, small_dir):
    items = [tuple(r) for r in pd.read_parquet(f"{small_dir}/benchmark.parquet").itertuples(index=False)]
    docs = pd.read_parquet(f"{small_dir}/documents.parquet")
    got = D.op9_decontamination(spark, small_dir).toPandas()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        assert set(got[got.doc_id == i].item_id) == expected(items, t)


def planted():
    generator = random.Random(5)
    items = [(k, " ".join(generator.choices(WORDS, k=generator.randrange(8, 60))) + ". " + " ".join(generator.choices(WORDS, k=6)) + ".") for k in range(90)]
    docs = []
    for n in range(150):
        words = generator.choices(WORDS, k=generator.randrange(0, 400))
        if n % 3 == 0:
            at = generator.randrange(len(words) + 1)
            item = items[n % 90][1].upper().split()
            if n % 2:
                item[len(item) // 2] = "changed"
            words[at:at] = item
        docs.append((n, " ".join(words), "x"))
    return items, docs


def test_shards_change_nothing_and_edges(spark, monkeypatch):
    items, docs = planted()
    docs += [(200, None, "x"), (201, "", "x"), (0, docs[0][1], "x"), (None, docs[0][1], "x"), (202, "pad " * 30_000 + items[4][1], "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, m string")
    bench = spark.createDataFrame([*items, (500, None), (501, ""), (502, "..."), (None, "w1 w2")], "item_id long, text string")
    results = []
    for size in (10**6, 500):
        monkeypatch.setattr(D, "SHARD_TERMS", size)
        assert (D.indexes(bench).count() == 1) == (size == 10**6)
        rows = D.contaminated(frame, bench).collect()
        results.append(sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in rows))
    assert results[0] == results[1]
    found = {}
    for d, i in results[0]:
        found.setdefault(d, set()).add(i)
    hits = misses = 0
    for d, t, _ in docs:
        want = expected(items, t)
        got = found.get(d if d is not None else -1, set())
        assert got <= want
        hits += len(got)
        misses += len(want - got)
    assert hits > 40 and misses == 0
    kept = D.without_contaminated(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, t, _ in docs if not expected(items, t)}


def test_no_items_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contaminated(docs, none).count() == 0 and D.without_contaminated(docs, none).count() == 1
    items = docs.select(F.col("doc_id").alias("item_id"), "text")
    assert D.contaminated(docs.limit(0), items).count() == 0
    assert [r.item_id for r in D.contaminated(docs, items).collect()] == [1]


def test_items_without_id_or_with_a_shared_id_are_all_found(spark, monkeypatch):
    generator = random.Random(3)
    texts = [" ".join(generator.choice(WORDS) for _ in range(30)) for _ in range(4)]
    bench = spark.createDataFrame([*zip([7, 7, None, None], texts, strict=True), (7, texts[0])], "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(f"before {t} after" for t in texts), (9, "clean " * 40)], "doc_id long, text string")
    for size in (10**6, 40):
        monkeypatch.setattr(D, "SHARD_TERMS", size)
        rows = D.contaminated(docs, bench).collect()
        assert sorted((r.doc_id, r.item_id) for r in rows if r.doc_id < 2) == [(0, 7), (1, 7)]
        assert [(r.doc_id, r.item_id) for r in sorted(rows, key=lambda r: r.doc_id)[2:]] == [(2, None), (3, None)]
        assert [r.doc_id for r in D.without_contaminated(docs, bench).collect()] == [9]


def shard(items):
    count, words = {}, [set(D.words_of(t)) for _, t in items]
    for own in words:
        for w in own:
            count[w] = count.get(w, 0) + 1
    mean = sum(len(D.words_of(t)) for _, t in items) / len(items)
    return D.Index(D.built([(i, t, count) for i, t in items], len(items), mean))


def test_cursors_find_what_full_scoring_finds():
    generator = random.Random(8)
    items = [(k, " ".join(generator.choices(WORDS[:60], k=generator.randrange(3, 30))).encode()) for k in range(300)]
    index = shard(items)
    hits = 0
    for _ in range(60):
        terms = sorted(generator.sample(range(len(index.terms)), generator.randrange(1, len(index.terms))))
        scores = np.zeros(len(items))
        bounds = np.zeros(index.blocks)
        for t in terms:
            s, e = index.ends[t], index.ends[t + 1]
            scores[index.item[s:e]] += index.impact[s:e]
            s, e = index.block_pointer[t : t + 2]
            bounds[index.block[s:e]] += index.block_maximum[s:e]
        blocks = np.flatnonzero(bounds >= D.THRESHOLD - D.SLACK).tolist()
        want = np.flatnonzero(scores >= D.THRESHOLD - D.SLACK).tolist()
        got = index.above(terms, blocks) if blocks else []
        assert [i for i, _ in got] == want and all(abs(s - scores[i]) < 1e-9 for i, s in got)
        hits += len(want)
    assert hits > 100


def test_a_long_text_takes_bounded_memory_and_loses_nothing(monkeypatch):
    generator = random.Random(4)
    items = [(k, " ".join(generator.choices(WORDS, k=40)).encode()) for k in range(400)]
    index = shard(items)
    filler = [w.encode() for w in generator.choices([*WORDS[:100], *(f"x{k}" for k in range(900))], k=1000)]
    text = b" ".join(filler * 2000)
    half = len(text) // 2
    text = items[3][1] + b" " + text[:half] + b" " + items[5][1] + b" " + text[half:] + b" " + items[7][1]
    assert len(text) > 7_000_000
    tracemalloc.start()
    found = index.matches([None, text, items[9][1]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [[m[0] for m in own] for own in found] == [[], [3, 5, 7], [9]]
    assert peak < 12 * len(text)
    monkeypatch.setattr(D, "PIECE", 2)
    monkeypatch.setattr(D, "SLICE", 100)
    short = text[:40_000] + b" " + items[8][1]
    for held in (400, 500):
        monkeypatch.setattr(D, "HELD", held)
        assert [m[0] for m in index.matches([short])[0]] == [3, 8]


def test_bounds_are_whole_however_they_are_cut(monkeypatch):
    generator = random.Random(6)
    items = [(k, " ".join(generator.choices(WORDS[:80], k=12)).encode()) for k in range(60)]
    index = shard(items)
    batch = [(n, 0, [w.encode() for w in generator.choices(WORDS[:80], k=100)]) for n in range(5)]
    seen = []
    for held in (1 << 20, 16, 64, 96):
        monkeypatch.setattr(D, "HELD", held)
        opened = []
        monkeypatch.setattr(index, "above", lambda terms, blocks: opened.append((tuple(terms), tuple(blocks))) or [], raising=False)
        assert list(index.query(batch)) == []
        seen.append(opened)
    assert seen[0] and all(s == seen[0] for s in seen)
