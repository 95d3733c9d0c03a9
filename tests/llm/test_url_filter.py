import math
import os
import re
import zlib

import pandas as pd
import pytest

from atelier.llm import url_filter

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
URLS = [None, "", "no scheme", "http://A.Example.NET/en/1?x#y", "http://example.net/de/", "http://example.net", "http://notexample.com/de/", "x://b.example.com/de/a?b", "http://org/fr/", "http://a.org/fr", "http://casino-bonus.example.com/en/win", "http://museum.example.com/en/3", "a://b://c/d", "http://h/\npath#f", "http://É.net/", "http://example.net/en/" * 3000]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = rest[: min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])]
        rest = rest[len(host) :]
        path = rest[: min([len(rest), *(rest.index(c) for c in "?#" if c in rest)])]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in RULES if (host == (h := r.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits)[1:] if fits else (None, None)


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(URLS)] * 2, "page_id long, url string, host string")
    for r in url_filter.judge(pages, RULES).collect():
        host, path, (rule, verdict) = brute(r["url"])
        j = r["judged"]
        assert (j["host"], j["path"], j["rule"]) == (host, path, rule), r["url"]
        assert j["verdict"] == verdict if verdict else j["verdict"] in ("allow", "block")


def tokens(url):
    host, path = url_filter._parts(url)
    return {w for w in re.split(r"[^a-z]+", host.decode()) if w}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="test tables are absent")
def test_table_shares_nothing_with_pages():
    """No host, word of a host, word within a word (of three letters at least), or path form of the tested table was learnt."""
    urls = [u for u in pd.read_parquet("/root/testdata/sf0.1/pages.parquet").url if u]
    own, theirs = [url_filter.labelled_urls(), set(urls)]
    mine = set().union(*(tokens(u) for u, _ in own)) - {"co", "info"}
    other = set().union(*(tokens(u) for u in theirs))
    assert not mine & other
    junk = {w for u in theirs for w in re.findall(r"[a-z]+", url_filter._parts(u)[0].decode().split(".example")[0]) if "-" in url_filter._parts(u)[0].decode()} - {"www", "blog", "m"}
    assert not [(w, x) for w in mine for x in junk if len(x) > 3 and x in w]
    forms = lambda paths: {re.sub(r"[0-9]+", "0", re.sub(r"[a-z]{2}/", "l/", p)) for p in paths}
    assert not forms(url_filter._parts(u)[1].decode() for u, _ in own) & forms(url_filter._parts(u)[1].decode() for u in theirs)


def test_held_out_words():
    """Of five folds of words each is judged by a model that learnt no host with any of its words."""
    table = url_filter.labelled_urls()
    words = {w for w in url_filter.BAD + url_filter.GOOD}
    told = []
    for fold in range(5):
        held = {w for w in words if zlib.crc32(w.encode()) % 5 == fold}
        has = lambda u, held=held: any(w in url_filter._parts(u)[0].decode() for w in held)
        model = url_filter.train([(u, y) for u, y in table if not has(u)])
        asked = [(u, y) for u, y in table if has(u) and not any(w in url_filter._parts(u)[0].decode() for w in words - held)]
        hosts, paths = zip(*(url_filter._parts(u) for u, _ in asked), strict=True)
        told += [(p >= 0.5, y) for p, (_, y) in zip(url_filter.probabilities(hosts, paths, model), asked, strict=True)]
    caught = sum(b and y for b, y in told)
    precision, recall = caught / sum(bool(b) for b, _ in told), caught / sum(y for _, y in told)
    print(f"held out: {len(told)} hosts, precision {precision:.3f}, recall {recall:.3f}")
    assert len(told) > 500 and precision > 0.9 and recall > 0.75


def test_probabilities_against_brute_force():
    """The scores of a row are the logistic of its normalised rarity-weighted n-gram sum, n-grams taken one by one."""
    table = url_filter.labelled_urls()[::40]
    weights, rarity = url_filter.train(table, rounds=50)
    for host, path in [(b"good-deals.test", b"/x/1"), (b"", b""), (b"a", b"")]:
        buckets = [0]
        for text, in_path in ((b"\x02" + host + b"\x03", 0), (b"\x04" + path + b"\x05", 1)):
            for n in url_filter.ORDERS:
                for i in range(len(text) - n + 1):
                    code = 0
                    for c in text[i : i + n]:
                        code = (code * 1_000_003 + c + 7) % (1 << 64)
                    buckets.append((code * 2 + in_path) * 0x9E3779B97F4A7C15 % (1 << 64) >> (64 - url_filter.BITS))
        x = [rarity[b] for b in buckets]
        z = sum(weights[b] * v for b, v in zip(buckets, x, strict=True)) / max(sum(v * v for v in x), 1e-9) ** 0.5
        assert abs(url_filter.probabilities([host], [path], (weights, rarity))[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_more_rules_than_a_broadcast_list_used_to_take(spark):
    rules = [("block", f"h{i}.test/") for i in range(120_000)] + [("allow", "h7.test/a")]
    pages = spark.createDataFrame([("http://x.h119999.test/q",), ("http://h7.test/a",), ("http://h7.test/" + "b" * 5_000_000,)], "url string")
    assert [r["judged"]["verdict"] for r in url_filter.judge(pages, rules).collect()] == ["block", "allow", "block"]


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "url string"), RULES).count() == 0
