import collections
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.llm import automata, phrases

PHRASES = st.dictionaries(st.lists(st.sampled_from(["a", "b", "é", "\x01z"]), min_size=1, max_size=4).map(tuple), st.integers(1, 5), max_size=30)


def table(machine):
    return {p: way[-1] for p, way in machine.phrases()}


@settings(max_examples=300, deadline=None)
@given(PHRASES)
def test_automata_hold_their_phrases_in_as_few_states_as_can_be(counts):
    machine = automata.build(sorted(counts.items()))
    assert table(machine) == counts and [p for p, _ in machine.phrases()] == sorted(counts)
    prefixes = {p[:i] for p in counts for i in range(len(p) + 1)} | {()}
    endings = {frozenset((p[len(q) :], n) for p, n in counts.items() if p[: len(q)] == q) for q in prefixes if q}
    assert len(machine.weights) <= len(endings) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(PHRASES, max_size=4), st.integers(1, 6))
def test_union_sums_counts(parts, least):
    total = collections.Counter()
    for p in parts:
        total.update(p)
    got = automata.union([automata.build(sorted(p.items())) for p in parts], least)
    assert table(got) == {p: n for p, n in total.items() if n >= least}


@settings(max_examples=200, deadline=None)
@given(PHRASES, PHRASES)
def test_composition(asked, counted):
    got = dict(automata.compose(automata.build(sorted(asked.items())), automata.build(sorted(counted.items()))))
    assert got == {p: n for p, n in counted.items() if p in asked}


def plain(docs, least, top, share=80):
    """docs: (text, lang). The result by counting every phrase."""
    counts, total = collections.Counter(), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + n])) for n in range(1, 5) for i in range(len(words) - n + 1))
    candidates = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    around = {}
    for (lang, words), a in candidates.items():
        for n in range(2, len(words)):
            for i in range(len(words) - n + 1):
                key = (lang, words[i : i + n])
                around[key] = max(a, around.get(key, 0))
    rows = []
    for (lang, words), a in candidates.items():
        if 100 * around.get((lang, words), 0) >= share * a:
            continue
        cuts = [(counts[lang, words[:k]], counts[lang, words[k:]]) for k in range(1, len(words))]
        left, right = min(cuts, key=lambda x: 2000000 * a // sum(x))
        rows.append((lang, 2000000 * a // (left + right), a, " ".join(words), left, right))
    out = []
    for lang in total:
        mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3]))
        out += [(lang, i, r[3], r[2], r[4], r[5], total[lang], r[1]) for i, r in enumerate(mine[:top], 1)]
    return sorted(out)


def by_sql(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    return sorted(con.execute(phrases.OP13_SQL).fetchall())


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query(spark, folder):
    got = sorted(map(tuple, phrases.op13_phrases(spark, folder).collect()))
    assert got == by_sql(folder) and got


SCHEMA = "doc_id long, text string, lang string, phrase string"
TEXTS = [
    ("New York city, new york City! NEW  york\tstate of new york", "en"), ("new york\nnew york", "en"), ("é\x0b\x01 \x1f é \x01 \x1f", None), ("é \x01 \x1f.", "und"),
    ("", "en"), (None, "en"), (None, None), ("x", ""), ("a a a a a a, a a a", "l g"), ("a a", "l"), ("g a a g a a a", "l"), ("one two three four five " * 3000, "long"),
]


@pytest.mark.parametrize(("least", "top"), [(1, 2000), (2, 3), (4, 2000)])
def test_edges(spark, least, top):
    df = spark.createDataFrame([(i, *x, "x") for i, x in enumerate(TEXTS)], SCHEMA).repartition(5)
    assert sorted(map(tuple, phrases.mine(df, least=least, top=top).collect())) == plain(TEXTS, least, top)


def test_many_shards_and_ranges(spark, monkeypatch):
    """Texts cut into many shards, automata united in several steps, several ranges."""
    monkeypatch.setattr(phrases, "CHARACTERS", 400)
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "RANGE_WORDS", 100)
    words = ["of", "the", "in", "law", "art", "sea"]
    texts = [(" ".join(words[(i * 31 + j * j * 7) % 6] for j in range(40)), ["en", "de"][i % 3 > 1]) for i in range(120)]
    df = spark.createDataFrame([(i, *x, "x") for i, x in enumerate(texts)], SCHEMA).repartition(3)
    assert sorted(map(tuple, phrases.mine(df, least=5).collect())) == plain(texts, 5, 2000)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert phrases.mine(df).count() == 0


