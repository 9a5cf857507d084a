import random
import re
import time
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import functions as F

from quarrymill.llm import urls


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in host)
    fits = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


ODD = [None, "", "no scheme/en/", "http://", "HTTP://WWW.Example.COM/en/1?x=/fr/", "x://net/es/", "http://a.net/es", "http://com", "http://com/", "http://xcom/", "http://É.example.com/EN/", "a://b://c.com/x", "http://h.org/" + "a/" * 3000, "http://h.org/\n/x", "http://h.com?/en/#"]


def test_rules_match_plain_reading(spark):
    df = spark.createDataFrame([(n, u, "x") for n, u in enumerate(ODD)] + [(3, ODD[3], "x"), (None, ODD[4], "x")], "page_id long, url string, host string")
    got = urls.judged(df).collect()
    assert len(got) == len(ODD) + 2
    by_id = {r.id: r for r in got}
    for n, u in enumerate(ODD):
        host, path, rule, verdict = plain(u)
        r = by_id[n]
        assert (r.host, r.path, r.rule) == (host, path, rule), u
        assert r.verdict == (verdict or r.verdict) and r.verdict in ("allow", "block")


def test_query(spark, small_dir):
    got = urls.op4_url_filters(spark, small_dir).toPandas().set_index("page_id")
    pages = pd.read_parquet(f"{small_dir}/pages.parquet")
    for i, u in zip(pages.page_id, pages.url, strict=True):
        host, path, rule, verdict = plain(u)
        r = got.loc[i]
        assert (r.host, r.path) == (host, path) and (verdict is None or r.verdict == verdict)
        assert (r["rule"] or None) == rule


def test_labelled_templates_are_rejected_and_others_not(spark):
    rows = [(n, f"http://h.org/bad/{n}") for n in range(40)] + [(100 + n, f"http://h.org/good/{n}") for n in range(40)]
    rows += [(200 + n, f"http://new.org/x/{n}") for n in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = df.where("page_id % 2 = 0 and page_id < 200").select(F.col("page_id").alias("id"), (F.col("page_id") < 100).cast("int").alias("bad"))
    got = {r.id: r for r in urls.judged(df, labels).collect()}
    assert all(got[n].verdict == "block" and got[n].template == "/bad/{n}" for n in range(40))
    assert all(got[100 + n].verdict == "allow" for n in range(40))


def test_segments_that_vary_become_wildcards(spark):
    words = [f"{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(5)]
    df = spark.createDataFrame([(n, f"http://h.org/tag/{w}/x") for n, w in enumerate(words)], "page_id long, url string")
    assert {r.template for r in urls.judged(df).collect()} == {"/tag/*/x"}
    segments = spark.createDataFrame([("2024-01-02",), ("123",), ("123.html",), ("deadbeef01",), ("about",), ("abcdefgh12345",)], "s string")
    assert [r[0] for r in segments.select(urls.generalised(F.col("s"))).collect()] == ["{date}", "{n}", "{n}.html", "{hex}", "about", "{id}"]


def test_similar_branches_merge(spark):
    rows = [(n, f"http://h.org/{k}/{n}") for n, k in enumerate(["fr", "de", "en", "es"] * 10)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = df.select(F.col("page_id").alias("id"), F.col("url").rlike("/(fr|de)/").cast("int").alias("bad"))
    got = {r.template: r.verdict for r in urls.judged(df, labels).collect()}
    assert got == {"/{de..fr}/{n}": "block", "/{en..es}/{n}": "allow"}


def labelled(spark, rows):
    """rows: (url, bad or None, times)."""
    pages = [(url, bad) for url, bad, times in rows for _ in range(times)]
    df = spark.createDataFrame([(n, url) for n, (url, _) in enumerate(pages)], "page_id long, url string")
    labels = spark.createDataFrame([(n, bad) for n, (_, bad) in enumerate(pages) if bad is not None], "id long, bad int")
    return {r.template for r in urls.judged(df, labels).collect()}


def test_branches_merge_at_every_level_by_a_test_on_counts(spark):
    deep = [(f"http://h.org/top/{k}/p1", b, 10) for k in "xy" for b in (0, 1)] + [("http://h.org/top/z/p1", 1, 20), ("http://h.org/top/w/p2", 0, 20)]
    assert labelled(spark, deep) == {"/top/{x..y}/p1", "/top/z/p1", "/top/w/p2"}
    near = [("http://h.org/a/p", 1, 39), ("http://h.org/a/p", 0, 61), ("http://h.org/b/p", 1, 41), ("http://h.org/b/p", 0, 59)]
    assert labelled(spark, near) == {"/{a..b}/p"}
    assert labelled(spark, [("http://h.org/a/p", 1, 1), ("http://h.org/b/p", 1, 1)]) == {"/a/p", "/b/p"}
    far = [("http://h.org/a/p", 1, 20), ("http://h.org/a/p", 0, 80), ("http://h.org/b/p", 1, 50), ("http://h.org/b/p", 0, 50)]
    assert labelled(spark, far) == {"/a/p", "/b/p"}


def test_urls_of_many_segments(spark):
    """Work goes by the number of segments, not by its square times their length."""
    rows = [(n, "http://h.org/" + "/".join(f"s{k % 10}" for k in range(5000)) + f"/{n}") for n in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    began = time.perf_counter()
    got = urls.judged(df, df.select(F.col("page_id").alias("id"), F.lit(0).alias("bad"))).collect()
    assert time.perf_counter() - began < 90 and {r.template.count("/") for r in got} == {5001}


def test_empty(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_text_labels_cover_hosts_without_rules(spark):
    clean = "<style>p{}</style><script>x = '###';</script><p>" + "plain words of a page " * 20 + "</p>"
    junk = "<p>" + "some*** words### of%%% junk$$$ " * 20
    assert [r.s for r in spark.createDataFrame([(clean,), (junk,), ("<p>short",), (None,)], "h string").select(urls.page_signal(F.col("h")).alias("s")).collect()] == [0, 1, None, None]
    rows = [(n, f"http://farm.example.net/x/{n}", junk) for n in range(60)]
    rows += [(100 + n, f"http://good.example.net/en/{n}", clean) for n in range(12)]
    rows += [(200 + n, f"http://thin.example.net/en/{n}", "<p>short") for n in range(3)]
    rows += [(300 + n, f"http://mixed.example.net/{b}/{n}", h) for n, (b, h) in enumerate([("ok", clean), ("bad", junk)] * 6)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.verdict for r in urls.judged(df, urls.text_labels(df)).collect()}
    blocked = {n for n, v in got.items() if v == "block"}
    assert blocked == {*range(60), *range(301, 312, 2)}


def test_query_labels_pages_outside_the_allowing_rules(spark, small_dir):
    pages = spark.read.parquet(f"{small_dir}/pages.parquet")
    labelled = urls.text_labels(pages).join(pages.withColumnRenamed("page_id", "id"), "id")
    assert labelled.where("bad = 0 and not url rlike '^[^/]*//[^/?#]*com([/?#]|$)'").count() > 0


def test_deep_templates_are_told_apart_and_generalised(spark):
    rows = [(n, f"http://h.org/a/b/c/d/e/{'bad' if n % 2 else 'good'}/{n}") for n in range(40)]
    words = [f"{chr(97 + a)}{chr(97 + b)}" for a in range(10) for b in range(5)]
    rows += [(100 + n, f"http://v.org/1/2/3/4/5/tag/{w}/x") for n, w in enumerate(words)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = df.where("page_id < 20").select(F.col("page_id").alias("id"), (F.col("page_id") % 2).cast("int").alias("bad"))
    got = {r.id: r for r in urls.judged(df, labels).collect()}
    assert all(got[n].verdict == ("block" if n % 2 else "allow") for n in range(40))
    assert {got[100 + n].template for n in range(50)} == {"/{n}/{n}/{n}/{n}/{n}/tag/*/x"}


def plain_judgement(pages, labels):
    """(host, path, rule, template, purity, verdict) of each (id, url): the method on plain dicts, labels: {id: bad}."""
    ending = re.compile(r"\.[A-Za-z0-9]{1,5}$")
    forms = [(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$", "{date}"), (r"^[0-9]+$", "{n}"), (r"^(?=.*[0-9])[0-9a-fA-F-]{8,}$", "{hex}"), (r"^(?=.*[0-9])[A-Za-z0-9_-]{12,}$", "{id}"), (r"^.{41,}$", "{slug}")]

    def general(s):
        end = m[0] if (m := ending.search(s)) else ""
        stem = s[: len(s) - len(end)]
        return next((name + end for p, name in forms if re.search(p, stem)), s)

    rows = {}
    for i, u in pages:
        host, path, rule, ruled = plain(u)
        parts = [general(s) for s in path.split("/") if s] + ([""] if path.endswith("/") and len(path) > 1 else [])
        rows[i] = [host, path, rule, ruled, parts]
    values = defaultdict(Counter)
    for host, _, _, _, parts in rows.values():
        for k, s in enumerate(parts):
            values[host, *parts[:k]][s] += 1
    many = {b for b, v in values.items() if len(v) >= urls.MANY_VALUES and sum(v.values()) < len(v) * urls.FEW_PAGES}
    for r in rows.values():
        r[4] = ["*" if (r[0], *r[4][:k]) in many else s for k, s in enumerate(r[4])]
    branches = defaultdict(list)
    for i, (host, _, _, _, parts) in rows.items():
        for k, s in enumerate(parts):
            if i in labels and s not in ("", "*") and not s.startswith("{"):
                branches[(host, *parts[:k]), s].append(("/".join(parts[k + 1 :]) + f"|{len(parts)}", labels[i]))
    alike = defaultdict(list)
    for (parent, name), seen in branches.items():
        if len(seen) >= urls.LEAST:
            alike[parent, frozenset(s for s, _ in seen)].append((sum(b for _, b in seen) / len(seen), name, sum(b for _, b in seen), len(seen)))
    renamed = {}
    for (parent, _), found_ in alike.items():
        groups = []
        for share, name, bad, n in sorted(found_):
            if groups:
                _, last_bad, last_n = groups[-1][-1]
                pooled = (bad + last_bad) / (n + last_n)
                if (share - last_bad / last_n) ** 2 <= urls.APART**2 * pooled * (1 - pooled) * (1 / n + 1 / last_n):
                    groups[-1].append((name, bad, n))
                    continue
            groups.append([(name, bad, n)])
        for group in groups:
            names = [x[0] for x in group]
            if len(names) > 1:
                renamed.update({(parent, n): f"{{{min(names)}..{max(names)}}}" for n in names})
    counts = defaultdict(lambda: [0, 0])
    chains = {}
    for i, r in rows.items():
        host, parts = r[0], r[4]
        parts = r[4] = [renamed.get(((host, *parts[:k]), s), s) for k, s in enumerate(parts)]
        names = host.split(".")[::-1][:3]
        chain = [("all",), *[(".", *names[: k + 1]) for k in range(len(names))], *[("/", host, *parts[:k]) for k in range(len(parts) + 1)]]
        chains[i] = chain, len(names) + 1
        if i in labels:
            for node in chain:
                counts[node][0] += 1
                counts[node][1] += labels[i]
    out = {}
    for i, (host, path, rule, ruled, parts) in rows.items():
        chain, level = chains[i]
        purity = 0.5
        for node in chain:
            if node in counts:
                purity = (counts[node][1] + purity * urls.SMOOTHING) / (counts[node][0] + urls.SMOOTHING)
        if chain[0] not in counts:
            purity = urls.LIMIT / 2
        bad = any(node in counts for node in chain[level:]) and purity >= urls.LIMIT
        out[i] = host, path, rule, "/" + "/".join(parts), round(purity, 9), ruled or ("block" if bad else "allow")
    return out


def found(df):
    return {r.id: (r.host, r.path, r.rule, r.template, round(r.purity, 9), r.verdict) for r in df.collect()}


def test_templates_purities_and_verdicts_match_a_plain_version(spark):
    generator = random.Random(9)
    hosts = ["a.net", "b.a.net", "shop.org", "x.y.z.co.uk", "EX.com", ""]
    words = ["en", "fr", "news", "tag", "item", "p"]
    urls_ = []
    for _ in range(600):
        host = generator.choice(hosts)
        parts = [generator.choice(words) for _ in range(generator.randrange(3))]
        tail = generator.choice(["", str(generator.randrange(900)), f"{generator.randrange(99)}.html", "".join(generator.choices("abcdef", k=3)), "2024-01-05", "deadbeef99", "w" * 50])
        urls_.append(f"http://{host}/" + "/".join([*parts, tail]) + generator.choice(["", "?q=1", "#top"]))
    rows = [(n, u) for n, u in enumerate(urls_ + [None, "plain"])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    marks = {n: int(("fr" in u) ^ (generator.random() < 0.2)) for n, u in enumerate(urls_) if generator.random() < 0.6}
    labels = spark.createDataFrame(list(marks.items()), "id long, bad int")
    want = plain_judgement(rows, marks)
    assert found(urls.judged(df, labels)) == want
    assert len({v[4] for v in want.values()}) > 20 and {v[5] for v in want.values() if v[2] is None} == {"allow", "block"}


def test_query_against_the_plain_version(spark):
    sf_dir = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    marks = {r.id: r.bad for r in urls.text_labels(pages).collect()}
    want = plain_judgement([tuple(r) for r in pages.select("page_id", "url").collect()], marks)
    got = found(urls.op4_url_filters(spark, sf_dir).withColumnRenamed("page_id", "id"))
    assert got == want and len({v[4] for v in want.values() if v[2] is None}) > 3


def test_held_out_purity_tells_bad_pages_from_good_ones(spark):
    rows = [(n, f"http://h{n % 5}.org/{'spam' if n % 3 == 0 else 'ok'}/{n}") for n in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = df.select(F.col("page_id").alias("id"), (F.col("page_id") % 3 == 0).cast("int").alias("bad"))
    got = {r.id: r.verdict for r in urls.judged(df, labels.where("id % 2 = 0")).collect()}
    assert all(got[n] == ("block" if n % 3 == 0 else "allow") for n, _ in rows if n % 2)


def test_an_unlabelled_host_is_not_judged_by_its_suffix(spark):
    rows = [(n, f"http://bad{n % 4}.example.org/x/{n}") for n in range(80)] + [(100, "http://other.example.org/en/1")]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = df.where("page_id < 80").select(F.col("page_id").alias("id"), F.lit(1).alias("bad"))
    got = {r.id: r for r in urls.judged(df, labels).collect()}
    assert got[100].verdict == "allow" and got[100].purity > 0.5 and got[0].verdict == "block"
