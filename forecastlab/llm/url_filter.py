"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Rules as (verdict, rule); a rule is a host and the start of a path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]

#: The small labelled URL table, an invented one: hosts and paths of each kind, paired by URL_TABLE.
GOOD_HOSTS = ["news.example.com", "www.library.example.org", "docs.example.net", "blog.tionble.example.com", "m.thther.example.net", "wiki.example.org", "journal.example.net", "www.museum.example.com", "ththan.example.net", "school.example.com"]
GOOD_PATHS = ["/en/251", "/de/1204.html", "/fr/77/", "/es/31", "/articles/history-of-rivers", "/guide/install.html", "/2023/05/essay", "/research/paper-12", "/en/912?page=2", ""]
BAD_HOSTS = ["casino-bonus.example.com", "ads.tracker.example.net", "xxx-free.example.net", "cheap-pills.example.com", "win-prize.example.net", "click.adserver.example.com", "torrent-warez.example.net", "loan-offer.example.com", "poker-slots.example.net", "spam.seo-links.example.com"]
BAD_PATHS = ["/login", "/cart/checkout?sid=9", "/ads/banner.gif", "/track/pixel?uid=1", "/free-casino-bonus", "/xxx/video", "/buy-cheap-pills", "/redirect?url=http", "/signup/offer", "/wp-admin/popup.js"]


def url_table() -> list[tuple[str, str, int]]:
    """host, path and label (1: block): every pair of hosts and paths of one kind."""
    return [(h, p.partition("?")[0], label) for hosts, paths, label in ((GOOD_HOSTS, GOOD_PATHS, 0), (BAD_HOSTS, BAD_PATHS, 1)) for h in hosts for p in paths]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ? , # or the end, A-Z lower-cased; path: from there up to ?, # or the end. Both empty without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null without one. A rule fits its host and all subdomains where the path starts with its path."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: len(r[1])):
        at, _, start = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        found, verdict = F.when(fits, F.lit(rule)).otherwise(found), F.when(fits, F.lit(says)).otherwise(verdict)
    return found, verdict


def grams(host: str, path: str, bits: int, sizes: tuple[int, ...] = (3, 4, 5)) -> np.ndarray:
    """The hashed character n-grams of host and path, which are told apart and bracketed."""
    out = []
    for mark, part in (("h^", host), ("p^", path)):
        data = f"^{part}$"
        out += [crc32((mark + data[i : i + n]).encode()) & ((1 << bits) - 1) for n in sizes for i in range(len(data) - n + 1)]
    return np.unique(np.array(out, dtype=np.int64))


@cache
def train() -> tuple[np.ndarray, float]:
    """The model of the labelled URL table above."""
    return fit(url_table())


def fit(table: list[tuple[str, str, int]], bits: int = 14, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by gradient descent on the logistic loss over a small table of host, path and label (1: block)."""
    rows = [grams(h, p, bits) for h, p, _ in table]
    y = np.array([label for *_, label in table], dtype=float)
    scale = np.array([1 / np.sqrt(max(1, len(r))) for r in rows])
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        z = np.array([w[r].sum() for r in rows]) * scale + b
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        step = np.zeros_like(w)
        for r, e in zip(rows, error * scale):
            step[r] += e
        w -= rate * len(y) / 10 * (step + decay * w / len(y))
        b -= rate * error.sum()
    return w, b


def score(host: str, path: str, model: tuple[np.ndarray, float], bits: int = 14) -> float:
    """The probability that a URL is to be blocked."""
    at = grams(host, path, bits)
    return float(1 / (1 + np.exp(-(model[0][at].sum() / np.sqrt(max(1, len(at))) + model[1]))))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = 0.5, labelled: list[tuple[str, str, int]] | None = None) -> DataFrame:
    """One row for each row of pages (page_id, url): page_id, host, path, rule, verdict, block_score.

    The verdict is that of the longest rule that fits, else block where block_score is at least the threshold. The model is
    fitted once, on the driver, from labelled (host, path, 1 to block; by default url_table) and broadcast: 128 KB. Null
    URLs and those without :// have an empty host and path, which no rule fits and the model scores like any other. An
    empty table gives an empty result, repeated rows have a row each; other columns of pages are not looked at. Only the URL is read.
    """
    model = pages.sparkSession.sparkContext.broadcast(train() if labelled is None else fit(labelled))
    host, path = host_path(F.col("url"))
    parts = pages.select(F.col("page_id").cast("long"), F.coalesce(F.col("url"), F.lit("")).alias("url")).select("page_id", host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2048):
                scores = [score(h, p, model.value) for h, p in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(scores, pa.float64())], ["page_id", "host", "path", "block_score"])

    scored = parts.mapInArrow(run, "page_id long, host string, path string, block_score double")
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    model_says = F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, model_says).alias("verdict"), "block_score")
