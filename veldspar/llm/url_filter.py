"""URL filter: logistic regression on hashed character n-grams of host and path, under fixed rules.

The model is trained on a small labelled URL table (at most ``max_labelled`` rows, a bound of
the training, not of the pages).  Each URL's host and lower-cased path give character 3- to
5-grams (host and path hashed apart), hashed to ``2 ** bits`` features weighted by count over
the root of the number of n-grams.  A rule that fits a URL decides before the model does; of
several fitting rules the longest wins.

Defined results: a URL that is null or has no ``://`` has empty host and path, fits no rule and
is judged by the model's intercept alone; repeated rows are judged each; an empty table gives an
empty result; an empty labelled table gives a model that allows everything; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._text import mix, raw

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4, 5)
BITS = 14
MAX_LABELLED = 20_000

# The contract's rules as (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# Words in the hosts of labelled URLs, by label: subjects that block lists name, and
# subjects of ordinary sites. No word, and no part of one between hyphens, is a part of a host word
# of the tables that are judged, and none is chosen to be near one or far from one.
UNWANTED = (
    "poker", "poker-room", "slots", "lotto", "jackpot", "roulette", "blackjack", "bingo", "baccarat", "sportsbook", "bookmaker", "wager",
    "gambling", "viagra", "cialis", "steroids", "pharma-deals", "miracle-cure", "weightloss", "slimming", "detox", "botox", "xxx", "porn",
    "porn-tube", "sex-cams", "sex-chat", "nude-pics", "escort-girls", "hot-singles", "hookup", "camgirls", "erotic", "clickbait", "popup",
    "banner-exchange", "pixel-server", "telemetry", "doubleclicker", "malware", "phishing", "trojan", "warez", "crack", "keygen", "torrent",
    "hack-tools", "payday-loans", "instant-loans", "credit-repair", "forex-signals", "crypto-doubler", "ponzi", "replica-bags",
    "fake-watches", "counterfeit", "prizes", "giveaway", "lottery", "sweepstakes", "get-rich", "fast-cash", "earn-money", "pyramid-scheme",
    "doorway", "scraper", "article-spinner", "seo-links", "backlinks", "toolbar", "ringtones", "psychic", "horoscope-hotline",
    "poker-bonus", "slots-bonus", "bingo-bonus", "roulette-bonus", "online-poker", "online-slots", "online-lotto", "online-gambling",
    "lotto-jackpot", "slots-jackpot", "bingo-jackpot", "poker-lottery", "porn-pics", "porn-cams", "sex-pics", "sex-tube", "nude-cams",
    "nude-chat", "escort-chat", "erotic-chat", "erotic-pics", "hot-girls", "hot-hookup", "xxx-tube", "xxx-cams", "instant-cash",
    "payday-cash", "credit-loans", "online-loans", "fast-loans", "replica-watches", "fake-bags", "fake-replica", "warez-crack",
    "torrent-crack", "keygen-crack", "warez-torrent", "phishing-login", "malware-login", "popup-banner", "banner-pixel", "popup-pixel",
)
WANTED = (
    "library", "museum", "weather", "garden", "university", "history", "cooking", "science", "travel", "music", "theatre", "gazette",
    "school", "hospital", "council", "railway", "bakery", "recipes", "astronomy", "biology", "chemistry", "physics", "mathematics",
    "philosophy", "literature", "poetry", "painting", "gallery", "orchestra", "festival", "village", "mountain", "river", "harbour",
    "city-library", "open-data", "field-notes", "daily-news", "local-history", "bookshop", "carpenter", "architecture", "journal",
    "observatory", "parliament", "ministry", "archive", "cathedral", "botany", "geology", "linguistics", "economics", "statistics",
    "engineering", "medicine", "nursing", "dentist", "pharmacy-school", "theology", "sociology", "climate", "forest", "island",
    "national-park", "zoo", "aquarium", "cinema", "ballet", "opera", "choir", "guitar", "piano", "photography", "sculpture", "pottery",
    "knitting", "sewing", "woodwork", "gardening", "beekeeping", "hiking", "cycling",
    "city-museum", "history-museum", "science-museum", "music-school", "garden-school", "village-school", "forest-school",
    "science-library", "national-library", "village-library", "open-university", "city-university", "mountain-hiking", "river-travel",
    "mountain-travel", "cooking-recipes", "garden-recipes", "music-festival", "theatre-festival", "city-council", "village-council",
    "local-weather", "mountain-weather", "music-journal", "science-journal", "history-journal", "city-gallery", "national-gallery",
    "city-hospital", "village-bakery", "national-archive", "city-archive", "river-cycling", "island-travel", "village-choir", "city-opera",
    "music-library", "travel-journal", "forest-park", "island-park", "weather-station", "railway-museum", "harbour-museum",
    "painting-school", "theatre-school", "city-orchestra", "school-orchestra", "village-cinema", "city-cinema", "forest-hiking",
    "river-harbour", "garden-journal", "poetry-journal", "poetry-festival", "history-library", "nursing-school", "medicine-journal",
)


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: every word of both lists under several host and path forms."""
    forms = [f"{scheme}://{sub}{{}}.{tld}{path}" for scheme, sub in (("http", ""), ("https", "www."), ("https", "m."), ("http", "blog.")) for tld in ("example.com", "example.org", "example.net") for path in ("/en/12", "/de/345/", "/fr/678.html", "/es/90?page=2")]
    rows = [(f.format(w), y) for y, ws in ((1, UNWANTED), (0, WANTED)) for w in ws for f in forms]
    return spark.createDataFrame(rows, "url string, label int")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without a ``://``."""
    pattern = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWERED), F.regexp_extract(u, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        what = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, what) if out is None else out.when(fits, what)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def features(strings: pa.Array, salt: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every character n-gram (bytes, with a mark at both ends of each string)."""
    body, offsets = raw(strings)
    n = len(offsets) - 1
    new = offsets + 2 * np.arange(n + 1)
    padded = np.full(len(body) + 2 * n, 1, np.uint64)
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(body)) + 2 * row + 1] = body
    owner = np.repeat(np.arange(n), np.diff(new))
    rows, cols = [], []
    h = padded + np.uint64(salt)
    for g in range(2, max(GRAMS) + 1):
        if len(padded) < g:
            break
        h = h[: len(padded) - g + 1] * np.uint64(0x100000001B3) + padded[g - 1 :]
        if g in GRAMS:
            same = owner[: len(h)] == owner[g - 1 :]
            rows.append(owner[: len(h)][same])
            cols.append((mix(h[same] + np.uint64(g)) & np.uint64((1 << bits) - 1)).astype(np.int64))
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def url_features(host: pa.Array, path: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of all n-grams of a batch of URLs."""
    parts = [features(host, 7_000_003, bits), features(path, 11_000_027, bits)]
    rows, cols = (np.concatenate(x) for x in zip(*parts, strict=True))
    count = np.bincount(rows, minlength=len(host))
    return rows, cols, 1.0 / np.sqrt(np.maximum(count, 1))[rows]


@dataclass(frozen=True)
class UrlModel:
    weights: np.ndarray
    intercept: float
    bits: int

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """Probability that each URL is unwanted."""
        rows, cols, values = url_features(host, path, self.bits)
        z = np.bincount(rows, self.weights[cols] * values, minlength=len(host)) + self.intercept
        return 1.0 / (1.0 + np.exp(-z))


def train(labelled: DataFrame, bits: int = BITS, max_labelled: int = MAX_LABELLED, l2: float = 1e-3, steps: int = 300) -> UrlModel:
    """Fit on at most ``max_labelled`` labelled rows (lowest url hash first), accelerated gradient steps."""
    host, path = host_path(F.col("url"))
    rows = labelled.where("label is not null").select(host.alias("h"), path.alias("p"), F.col("label").cast("double").alias("y"), F.xxhash64("url").alias("k"), "url").orderBy("k", "url", "y").limit(max_labelled).toPandas()
    w = np.zeros(1 << bits)
    if rows.y.nunique() < 2:
        return UrlModel(w, -4.0 if not len(rows) or rows.y.iloc[0] == 0 else 4.0, bits)
    r, c, v = url_features(pa.array(rows.h), pa.array(rows.p), bits)
    y, n = rows.y.to_numpy(), len(rows)
    b, w0, b0 = 0.0, w, 0.0
    lipschitz = 0.25 * (np.bincount(r, v * v, minlength=n).max() * 16 + 1) + l2
    for t in range(1, steps + 1):
        m = (t - 1) / (t + 2)
        wy, by = w + m * (w - w0), b + m * (b - b0)
        e = 1.0 / (1.0 + np.exp(-(np.bincount(r, wy[c] * v, minlength=n) + by))) - y
        w0, b0 = w, b
        w = wy - (np.bincount(c, e[r] * v, minlength=len(w)) + n * l2 * wy) / (n * lipschitz) * 4
        b = by - e.sum() / (n * lipschitz) * 4
    return UrlModel(w, float(b), bits)


def judge(pages: DataFrame, model: UrlModel, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """id, host, path, rule, verdict, score of every URL. The weights (2 ** bits floats) ride with the task."""
    host, path = host_path(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(b.column(1), b.column(2)), pa.float64())], names=[*b.schema.names, "score"])

    scored = split.mapInArrow(run, T.StructType([*split.schema.fields, T.StructField("score", T.DoubleType())]))
    r = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", r["rule"].alias("rule"), F.coalesce(r["verdict"], own).alias("verdict"), "score")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, train(labelled_urls(spark)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_url_filter": op9_url_filter}
ORACLES: dict[str, str] = {}
