"""URL filtering: explicit rules first, then a logistic regression on hashed character n-grams of host and path.

The model is trained on the driver from a small labelled table of URLs; only its weight vector, of fixed size, is sent
to the executors, and pages are judged one by one without a shuffle.

Defined results. A null URL, or one without "://", has an empty host and path; no rule fits it, there is nothing to hold
against it, and it is allowed (p_block is then the bias alone). Very long URLs are read whole. Repeated rows get equal verdicts,
ties between rules of equal length go to block, and an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import lower_ascii

ALLOW, BLOCK = "allow", "block"

#: Invented labelled names, from which the small labelled table is built. None is a host of a table that is judged.
BLOCKED_NAMES = (
    "casino-royal", "lucky-casino", "mega-slots", "slots-palace", "poker-bonus", "bet-online", "sportsbets", "jackpot-win", "roulette-vip",
    "bingo-cash", "big-winner", "lottery-prizes", "pills-online", "discount-pills", "pharmacy-rx", "viagra-store", "weight-loss-pills", "cheap-meds",
    "adult-video", "adult-chat", "xxx-tube", "porn-free", "sexy-cams", "hot-escorts", "nude-pics", "spam-mail", "link-spam", "seo-spam-blog",
    "link-farm", "content-farm", "backlinks-farm", "ads-server", "adserver", "banner-ads", "popads", "click-track", "tracker-pixel", "tracking-ads",
    "free-iphone", "free-gift-cards", "win-prizes", "cheap-watches", "replica-bags", "payday-loans", "fast-cash-loans", "get-rich-quick",
    "crack-keygen", "warez-downloads", "torrent-movies", "phish-login", "account-verify-now", "malware-host",
)
ALLOWED_NAMES = (
    "library", "city-library", "museum", "history-museum", "university", "open-university", "school", "primary-school", "research-institute",
    "news", "local-news", "daily-herald", "evening-post", "radio", "weather", "weather-service", "encyclopedia", "wiki", "dictionary", "atlas",
    "garden", "botanic-garden", "recipes", "kitchen-notes", "travel-notes", "railways", "stations", "health-service", "hospital", "clinic",
    "theatre", "orchestra", "film-archive", "poetry", "authors", "book-reviews", "linux-docs", "developer-docs", "python-tutorials", "mathematics",
    "physics", "astronomy", "nature", "birdwatch", "rivers", "mountain-club", "chess-club", "football-league", "city-council", "parliament",
    "statistics-office", "public-records",
)
BLOCKED_PATHS = ("", "bonus/free-spins", "win-now/claim.php", "cheap/buy-online", "xxx/gallery-7", "track/click?id=44", "promo/best-odds")
ALLOWED_PATHS = ("", "wiki/River", "articles/history-of-bridges", "docs/install/guide", "2021/05/opening-hours", "search?q=maps", "about/contact")


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, 1 for URLs to block: each name under three hosts and paths, dealt in turn. Schemes, prefixes
    and endings are the same for both classes, so that only names and paths tell them apart."""
    rows = []
    for names, paths, label in ((BLOCKED_NAMES, BLOCKED_PATHS, 1), (ALLOWED_NAMES, ALLOWED_PATHS, 0)):
        for i, name in enumerate(names):
            for j in range(3):
                k = 3 * i + j
                prefix, ending = ("", "www.", "m.", "blog.")[k % 4], ("com", "org", "net", "info", "co")[k % 5]
                rows.append((f"{('http', 'https')[k % 2]}://{prefix}{name}.{ending}/{paths[k % len(paths)]}", label))
    return rows


LABELLED = labelled_urls()


@dataclass(frozen=True)
class Rule:
    pattern: str  # host, "/" and the start of a path
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


@dataclass(frozen=True)
class Settings:
    bits: int = 16  # of the hashed feature space
    sizes: tuple[int, ...] = (3, 4, 5)
    steps: int = 300
    rate: float = 0.5
    decay: float = 1e-3


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first "://", empty if there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The pattern and the verdict of the longest rule that fits; nulls if none does."""
    pattern = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == BLOCK)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        pattern, verdict = F.when(fits, r.pattern).otherwise(pattern), F.when(fits, r.verdict).otherwise(verdict)
    return pattern, verdict


def features(host: str, path: str, settings: Settings) -> np.ndarray:
    """The distinct hashed n-grams of host and path, each with its own mark at both ends."""
    found = set()
    for mark, part in ((b"h", host), (b"p", path)):
        data = b"^" + part.encode() + b"$" if part else b""
        for n in settings.sizes:
            found.update(zlib.crc32(mark + data[i : i + n]) for i in range(len(data) - n + 1))
    return np.unique(np.fromiter((x & ((1 << settings.bits) - 1) for x in found), np.int64, len(found)))


def split_url(url: str | None) -> tuple[str, str]:
    """host and path of a URL on the driver, as host_of and path_of give them."""
    rest = (url or "").partition("://")[2]
    cut = lambda s, marks: min([len(s), *(s.find(m) for m in marks if m in s)])
    at = cut(rest, "/?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at])
    return host, rest[at : at + cut(rest[at:], "?#")]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    settings: Settings

    def probability(self, host: str, path: str) -> float:
        """That the URL is one to block. N-gram weights are averaged, so that long URLs are not judged by length."""
        found = features(host, path, self.settings)
        total = self.bias + (self.weights[found].sum() / np.sqrt(len(found)) if len(found) else 0.0)
        return float(1 / (1 + np.exp(-total)))


def train(labelled: Sequence[tuple[str, int]] = LABELLED, settings: Settings = Settings()) -> Model:
    """Full-batch gradient descent with weight decay; the same table gives the same model."""
    rows = [features(*split_url(u), settings) for u, _ in labelled]
    y = np.array([v for _, v in labelled], float)
    index = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.maximum([len(r) for r in rows], 1))
    w, b = np.zeros(1 << settings.bits), 0.0
    for _ in range(settings.steps):
        total = b + np.bincount(owner, w[index], len(rows)) * scale
        error = (1 / (1 + np.exp(-total)) - y) / len(rows)
        w -= settings.rate * (np.bincount(index, (error * scale)[owner], len(w)) * 8 + settings.decay * w)
        b -= settings.rate * error.sum()
    return Model(w.astype(np.float32), float(b), settings)


def judge(pages: DataFrame, model: Model, rules: Sequence[Rule] = (), *, keep: tuple[str, ...] = ("page_id",), url: str = "url") -> DataFrame:
    """The columns in keep with host, path, rule, p_block (the model's, for every URL) and verdict."""

    @F.pandas_udf("double")
    def blocked(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series([model.probability(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    split = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    scored = split.withColumns({"rule": rule, "_v": verdict, "p_block": blocked("host", "path")})
    some = (F.col("host") != "") | (F.col("path") != "")
    by_model = F.when(some & (F.col("p_block") >= 0.5), BLOCK).otherwise(ALLOW)
    return scored.withColumn("verdict", F.coalesce("_v", by_model)).drop("_v")
