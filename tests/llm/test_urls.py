from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from fettle.llm import urls as U

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(UPPER), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://Www.Example.COM/en/1?x#y", "https://example.com/en", "https://a.example.com/en/x", "https://com/", "https://telecom/", "http://x.net/fr/a",
        "http://x.net/FR/a", "http://x.net?/fr/", "no scheme", None, "", "://", "a://b://c/d", "http://É.org/ü?q", "http://h.com\n/x y", "http://www.www.example.com/en/z"]


def test_parts_and_rules_equal_plain_code(spark):
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(URLS)] + [(3, URLS[3], "x")], "page_id LONG, url STRING, verdict STRING")
    got = U.filter_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path) == parts(URLS[r.page_id])
        rule, verdict = rule_of(r.host, r.path)
        assert r.rule == rule and (verdict is None or r.verdict == verdict) and r.verdict in ("allow", "block") and 0 <= r.block_score <= 1
    assert U.filter_urls(pages.limit(0)).count() == 0
    unruled = U.filter_urls(pages.where(F.col("page_id").isin(8, 9))).collect()
    assert {r.verdict for r in unruled} == {"allow"}


def test_a_score_does_not_depend_on_its_neighbours():
    weights = np.random.default_rng(1).standard_normal(U.DIMS + 1)
    hosts, paths = ["a.b", "x\x02y", "", "long.host.name"], ["/p", "/q\x01", "", ""]
    together = U.scores(weights, hosts, paths)
    alone = [U.scores(weights, [h], [p])[0] for h, p in zip(hosts, paths, strict=True)]
    assert np.allclose(together, alone) and np.isclose(together[2], 1 / (1 + np.exp(-weights[U.DIMS])))


def test_held_out_accuracy(spark):
    """Half of the ruled urls teach, the other half are judged."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = U.host_path(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path")).withColumn("r", U.ruled(F.col("host"), F.col("path"))).where("r IS NOT NULL").orderBy("host", "path").collect()
    label = np.array([r.r.verdict == "block" for r in rows], float)
    pick = lambda x, k: x[k::2]
    weights = U.train([r.host for r in pick(rows, 0)], [r.path for r in pick(rows, 0)], pick(label, 0))
    p = U.scores(weights, [r.host for r in pick(rows, 1)], [r.path for r in pick(rows, 1)])
    assert ((p >= 0.5) == pick(label, 1)).mean() > 0.9


def test_a_small_class_is_among_the_labelled(spark):
    rows = [(f"h{k}.org", "/", "r", "block" if k < 3 else "allow") for k in range(600)]
    urls = spark.createDataFrame(rows, "host STRING, path STRING, rule STRING, verdict STRING")
    for n, block in ((10, 3), (4, 2)):
        hosts, _, label = U.labelled(urls, n)
        assert len(hosts) == len(set(hosts)) == n and label.sum() == block


def test_whole_result_equals_plain_code(spark):
    """All pages judged by rules in Python and, without one, by sums over the n-grams of each url alone."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url")
    weights = U.train(*U.labelled(pages.select(*[c.alias(n) for c, n in zip(U.host_path(F.col("url")), ("host", "path"))]).withColumn("r", U.ruled(F.col("host"), F.col("path"))).select("host", "path", "r.rule", "r.verdict")))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.filter_urls(pages).collect()}

    def cell(gram, size, salt):
        h = 2 * size + salt
        for b in gram:
            h = (h * U.B.BASE + b) % (1 << 64)
        return int(U.B.mix(np.array([h], np.uint64))[0] % np.uint64(U.DIMS))

    def block(host, path):
        cells = []
        for text, salt in ((host, 0), (path, 1)):
            data = f"\x01{text}\x02".encode() if text else b""
            cells += [cell(data[i : i + n], n, salt) for n in U.SIZES for i in range(len(data) - n + 1)]
        return weights[U.DIMS] + sum(weights[c] for c in cells) / max(1, len(cells)) ** 0.5 >= 0

    want = {}
    for r in pages.collect():
        host, path = parts(r["url"])
        rule, verdict = rule_of(host, path)
        want[r["page_id"]] = (host, path, rule, verdict or ("block" if block(host, path) else "allow"))
    assert got == want
