import re

import pandas as pd
from brute import ascii_lower

from quarrymill.llm import licences as L

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))
    hits = sorted((k, v) for p, v in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    return len(words), hits


ODD = [None, "", "UNDER the-MIT\nLicense", "under the mit licenses", "xunder the mit license", "cc by nc cc by nc", "Apache License, Version 2.0 under the mit license", "under the mit licenseé", "\x00under\x7fthe mit license", "é " * 5000 + "cc by nc"]


def test_base_places(spark):
    df = spark.createDataFrame([(n, t, "x") for n, t in enumerate(ODD)] + [(2, ODD[2], "x"), (None, ODD[2], "x")], "doc_id long, text string, base string")
    rows = L.scanned(df).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        n, hits = plain(ODD[r.id if r.id is not None else 2])
        assert (r.n_words, [(b.first_word, b.label) for b in r.base]) == (n, hits)
    assert L.scanned(df.limit(0)).count() == 0


def test_query(spark, small_dir):
    got = L.op7_licences(spark, small_dir).toPandas().set_index("doc_id")
    docs = pd.read_parquet(f"{small_dir}/documents.parquet")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        n, hits = plain(t)
        r = got.loc[i]
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(hits), ",".join(sorted({v for _, v in hits})))
        assert (None if pd.isna(r.first_word) else r.first_word) == min((k for k, _ in hits), default=None)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))


def test_errors_within_the_bound_are_found_and_others_not():
    for notice in L.notices():
        text = notice.text.decode()
        for errors in range(notice.errors + 2):
            spoiled = list(text)
            for k in range(errors):
                at = (k + 1) * len(text) // (errors + 1)
                spoiled[at] = "0" if spoiled[at] != "0" else "1"
            words = ("before it " + "".join(spoiled) + " and after").encode()
            found = [f for f in L.fuzzy(words) if f.label == notice.label]
            if errors <= notice.errors:
                assert found and found[0].errors == errors and found[0].first_word == 2, (text, errors)
            else:
                assert not found


def test_clean_texts_have_nothing():
    assert L.scan(b"the license of the software is not stated here and all rights are yours")[1:] == ([], [])


def test_repeated_notices_take_linear_time():
    import time

    for notice in (b"all right reserved ", b"cc by nc ", b"gnu genral public license version 2 ", b"released under the mit licence "):
        began = time.perf_counter()
        n, base, found = L.scan(notice * (1_000_000 // len(notice)))
        assert time.perf_counter() - began < 60
        assert max(len(base), len(found)) == 1_000_000 // len(notice)
        assert [f.first_word for f in found[:3]] == [k * len(notice.split()) for k in range(len(found[:3]))]


def nearest(words, text, errors):
    """{(start, end): edits} of all places with so many edits at most, by plain dynamic programming."""
    out = {}
    for a in range(len(words)):
        row = list(range(len(text) + 1))
        for z in range(a + 1, min(len(words), a + len(text) + errors) + 1):
            last, row = row, [z - a]
            for j, c in enumerate(text):
                row.append(min(last[j] + (c != words[z - 1]), last[j + 1] + 1, row[j] + 1))
            if row[-1] <= errors:
                out[a, z] = row[-1]
    return out


NEIGHBOURS = [
    "released under the mit licence released under the mit license",
    "dual licensed gnu genral public licence version 2 or gnu general public license version 3 only",
    "all rights reserved all right reserved al rights reserved all rights reserved",
    "licensed under the apache licence version 2 0 mozilla public license version 2 mozila public license version 2",
    "gnu lesser general public licence gnu affero general public license version 3 gnu lesser general public license",
]


def test_neighbouring_notices_against_brute_force():
    for text in NEIGHBOURS:
        words = text.encode()
        places = [(e / len(n.text), -len(n.text), a, n.label, z, e) for n in L.notices() for (a, z), e in nearest(words, n.text, n.errors).items()]
        kept = []
        for one in sorted(places):
            if all(one[4] <= k[2] or k[4] <= one[2] for k in kept):
                kept.append(one)
        assert [(f.label, f.errors) for f in L.fuzzy(words)] == [(k[3], k[5]) for k in sorted(kept, key=lambda k: k[2])], text
    assert {f.label for f in L.fuzzy(NEIGHBOURS[1].encode())} == {"gpl-2", "gpl-3"}
    assert len(L.fuzzy(NEIGHBOURS[0].encode())) == 2
