"""URL filter: rules by host and path first, else logistic regression on hashed character n-grams of host and path.

The classifier learns from a small labelled URL table (at most `MAX_LABELLED` rows, checked), on the driver in numpy;
its weights are a fixed 2**BITS floats. Rules are a list of any length, broadcast once and looked up by each suffix of the
host, so their number does not slow the scan. Every URL is judged in one pass without a shuffle. The built-in table is made from general word
lists; held out by words (no word of a tested host was learnt), tests/llm/test_url_filter.py measures precision and recall.

A null URL or one without `://` has an empty host and path; it can't fit a rule with a host and is judged by the
classifier alone. A host fits a rule if equal or a subdomain; the URL's path must start with the rule's path; of
several the longest rule (host and path together, then the text itself) wins, so ties are settled. Repeated rows are judged
alike. Very long URLs are judged whole, in groups of about 4 MB. An empty table gives an empty result. A column named as `result_col` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

BITS, MAX_LABELLED, ORDERS = 16, 20_000, (2, 3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICT = "struct<rule: string, verdict: string, p_block: double>"

#: The words that the built-in table is made from: general vocabulary of unwanted and of ordinary sites.
BAD = (
    "payday loan loans credit cash prize lottery lucky jackpot roulette poker slots blackjack replica watches handbags discount deals coupon voucher bargain diet slim miracle"
    " viagra cialis pharmacy meds tablets steroid dating singles hookup escort webcam nude sexy girls porn torrent warez crack keygen serial cheats hack botnet phish login verify"
    " wallet crypto doubler mining seo backlinks traffic clicks popup banner affiliate mlm survey rewards gifts giveaway streaming movies download soft toolbar codec"
).split()
BAD_TAIL = "now online best top hot big vip club shop store zone hub pro 24 365 77 88 4u easy fast instant real max plus super mega buy get".split()
GOOD = (
    "library museum archive university college school institute observatory hospital council parliament gazette tribune herald chronicle review journal press radio opera theatre gallery"
    " garden botany geology physics chemistry biology algebra history poetry grammar recipes kitchen bakery weather climate harbour railway cycling hiking mountain valley river island"
    " village parish castle bridge lighthouse cathedral orchard vineyard dairy pottery weaving violin choir chess astronomy maps atlas dictionary lexicon compiler kernel python database"
).split()
NAMES = "holm berg dal strand feld brook wick ford mere stead combe worth bury ley gate moor vale ridge haven crest".split()


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for block): a small labelled table, made by rule from general word lists.

    Unwanted hosts join sales words, mostly by hyphens; ordinary hosts are topics, places and names, now and then with a hyphen.
    Both classes share the domains and the paths, so that neither tells them apart.
    """
    bad = [f"{w}-{BAD_TAIL[(3 * i + j) % len(BAD_TAIL)]}" for i, w in enumerate(BAD) for j in range(4)]
    bad += [f"{BAD_TAIL[(5 * i + j) % len(BAD_TAIL)]}-{w}" for i, w in enumerate(BAD) for j in range(3)]
    bad += [f"{w}-{BAD[(7 * i + 11 * j + 1) % len(BAD)]}" for i, w in enumerate(BAD) for j in range(4)]
    bad += [f"{w}{BAD_TAIL[(2 * i) % len(BAD_TAIL)]}" for i, w in enumerate(BAD)] + BAD
    good = [f"{w}{NAMES[(3 * i + j) % len(NAMES)]}" for i, w in enumerate(GOOD) for j in range(5)]
    good += [f"{w}{x}" for w in NAMES for x in NAMES if w != x] + [f"{w}{GOOD[(5 * i + 3 * j + 2) % len(GOOD)]}" for i, w in enumerate(GOOD) for j in range(3)]
    good += [f"{w}-{NAMES[(7 * i) % len(NAMES)]}" for i, w in enumerate(GOOD)] + GOOD
    ends, paths = ("test", "co.test", "info.test", "city.test"), ("/", "/index.php", "/about/", "/page/{}/", "/{}", "/view.php", "/2019/{}/", "/item{}.htm")
    out = []
    for label, hosts in ((1, bad), (0, good)):
        out += [(f"https://{host}.{ends[i % len(ends)]}{paths[i // len(ends) % len(paths)].format(i * 53 % 9973)}", label) for i, host in enumerate(hosts)]
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#`; then up to `?` or `#`. A-Z of the host are lower-cased."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("1")).isNotNull()
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(rest, F.translate(host, UPPER, LOWER)).otherwise(""), F.when(rest, path).otherwise("")


def _features(hosts: Sequence[bytes], paths: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of ^host$ and ^path$ (kinds apart), and where each row's begin; a row has one at least."""
    text = b"".join(b"\x02%b\x03\x04%b\x05" % (h, p) for h, p in zip(hosts, paths, strict=True))
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(h) + len(p) + 4 for h, p in zip(hosts, paths, strict=True)), np.int64, len(hosts))
    ends = np.cumsum(sizes)
    begins, row = ends - sizes, np.repeat(np.arange(len(hosts)), sizes)
    in_path = np.arange(len(raw)) >= (begins + np.fromiter((len(h) + 2 for h in hosts), np.int64, len(hosts)))[row]
    stop = np.where(in_path, ends[row], (begins + np.fromiter((len(h) + 2 for h in hosts), np.int64, len(hosts)))[row])
    buckets, rows = [], []
    for n in ORDERS:
        size = len(raw) - n + 1
        code = np.zeros(max(size, 0), np.uint64)
        for i in range(n if size > 0 else 0):
            code = code * np.uint64(1_000_003) + raw[i : i + size] + np.uint64(7)
        code = (code * np.uint64(2) + in_path[: len(code)]) * np.uint64(0x9E3779B97F4A7C15)
        fits = np.flatnonzero(np.arange(len(code)) + n <= stop[: len(code)])
        buckets.append((code[fits] >> np.uint64(64 - BITS)).astype(np.int64))
        rows.append(row[fits])
    buckets.append(np.zeros(len(hosts), np.int64))  # the bias, at bucket 0
    rows.append(np.arange(len(hosts)))
    return np.concatenate(buckets), np.concatenate(rows)


def _values(buckets: np.ndarray, rows: np.ndarray, n: int, rarity: np.ndarray) -> np.ndarray:
    """Each n-gram's rarity, over the length of its row's vector."""
    x = rarity[buckets]
    return x / np.sqrt(np.maximum(np.bincount(rows, x * x, n), 1e-9))[rows]


def _parts(url: str | None) -> tuple[bytes, bytes]:
    if not url or "://" not in url:
        return b"", b""
    rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return host.encode("utf-8", "replace").lower(), (slash + path).encode("utf-8", "replace")


def train(labelled: Sequence[tuple[str, int]], rounds: int = 800, rate: float = 20.0, l2: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, rarity of n-grams): full-batch gradient steps; the same table always gives the same model.

    An n-gram's rarity is the log of how many rows there are for each that has it, 0 if none has; so what all hosts share counts little.
    """
    if len(labelled) > MAX_LABELLED:
        raise ValueError(f"the labelled table has over {MAX_LABELLED} rows")
    if not labelled:
        return np.zeros(1 << BITS), np.zeros(1 << BITS)
    hosts, paths = zip(*(_parts(u) for u, _ in labelled), strict=True)
    y = np.array([v for _, v in labelled], float)
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # both classes weigh alike
    buckets, rows = _features(hosts, paths)
    held = np.bincount(np.unique(buckets * len(y) + rows) // len(y), minlength=1 << BITS)
    rarity = np.where(held > 0, np.log((len(y) + 1) / np.maximum(held, 1)), 0.0)
    rarity[0] = max(rarity[0], 1.0)  # the bias
    x, w = _values(buckets, rows, len(y), rarity), np.zeros(1 << BITS)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.bincount(rows, w[buckets] * x, len(y))))
        w -= rate * (np.bincount(buckets, ((p - y) * share)[rows] * x, len(w)) + l2 * w)
    return w, rarity


def probabilities(hosts: Sequence[bytes], paths: Sequence[bytes], model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    buckets, rows = _features(hosts, paths)
    return 1 / (1 + np.exp(-np.bincount(rows, model[0][buckets] * _values(buckets, rows, len(hosts), model[1]), len(hosts))))


def _cuts(hosts: pa.Array, paths: pa.Array, rows: int = 2000, size: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Begins and ends of groups of at most `rows` rows and about `size` bytes, one row at least."""
    lo = total = 0
    for i, n in enumerate((len(h.as_py()) + len(p.as_py()) for h, p in zip(hosts, paths, strict=True))):
        if i > lo and (i - lo == rows or total + n > size):
            yield lo, i
            lo, total = i, 0
        total += n
    if len(hosts):
        yield lo, len(hosts)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], labelled: Sequence[tuple[str, int]] | None = None, url_col: str = "url", cut: float = 0.5, result_col: str = "judged") -> DataFrame:
    """Adds struct `result_col` of host, path, rule, verdict and p_block. rules: (block or allow, host followed by path).

    Without a fitting rule a URL is blocked from a probability of `cut` on.
    """
    by_host: dict[str, list[tuple[int, str, str, str]]] = {}
    for verdict, rule in rules:
        host, slash, path = rule.partition("/")
        by_host.setdefault(host.lower(), []).append((len(rule), rule, slash + path, verdict))
    for own in by_host.values():
        own.sort(reverse=True)
    sent = pages.sparkSession.sparkContext.broadcast((by_host, train(labelled_urls() if labelled is None else labelled)))

    def fitting(by_host: dict, host: str, path: str) -> tuple[str, str] | None:
        best, at = None, 0
        while True:
            for n, rule, start, verdict in by_host.get(host[at:], ()):
                if path.startswith(start):
                    best = max(best or (0, "", ""), (n, rule, verdict))
                    break
            dot = host.find(".", at)
            if dot < 0:
                return best and best[1:]
            at = dot + 1

    @F.arrow_udf(VERDICT)
    def verdicts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        rules_of, model = sent.value
        for hosts, paths in batches:
            out: list[dict] = []
            for lo, hi in _cuts(hosts, paths):
                h, p = hosts[lo:hi].to_pylist(), paths[lo:hi].to_pylist()
                score = probabilities([x.encode() for x in h], [x.encode() for x in p], model)
                for host, path, s in zip(h, p, score.tolist(), strict=True):
                    found = fitting(rules_of, host, path)
                    out.append({"rule": found and found[0], "verdict": found[1] if found else "block" if s >= cut else "allow", "p_block": s})
            yield pa.array(out, pa.struct([("rule", pa.string()), ("verdict", pa.string()), ("p_block", pa.float64())]))

    host, path = split_url(F.col(url_col))
    verdict_col = free(pages, f"{result_col}_")
    inner = pages.withColumn(result_col, F.struct(host.alias("host"), path.alias("path")))
    parts = F.col(result_col)
    found = verdicts(parts["host"], parts["path"])
    return inner.withColumn(verdict_col, found).withColumn(result_col, F.struct(parts["host"].alias("host"), parts["path"].alias("path"), F.col(f"`{verdict_col}`.*"))).drop(verdict_col)
