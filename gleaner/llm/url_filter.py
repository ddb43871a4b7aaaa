"""URL filter: host and path rules first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, columns

#: (verdict, host, path start)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

# The labelled table: invented addresses of the kinds that a crawl should skip, and of ordinary sites.
BLOCKED = """
best-casino.example/en/1 casino-royal.example/games online-casino.example/bonus casinowin.example/ mycasino.example/fr/12
win-big-slots.example/play slots-jackpot.example/en/7 poker-win.example/tables free-bets.example/de/3 sports-bets.example/odds
bets-now.example/en/88 free-betting.example/tips cheap-pills.example/buy pills-online.example/en/9 cheap-meds.example/shop
buy-viagra.example/cheap pharmacy-pills.example/de/41 spam-farm.example/links link-farm.example/en/5 spam-links.example/page/3
spamsite.example/x adult-x.example/ adult-videos.example/en/2 xxx-adult.example/video porn-tube.example/watch sex-cams.example/live
ads-track.example/click ad-track.example/pixel track-ads.example/en/30 click-ads.example/go adserver.example/banner
tracker-ads.example/b free-money.example/win warez-crack.example/download crack-keys.example/serial torrent-warez.example/get
fake-watches.example/sale replica-bags.example/cheap payday-loans.example/apply loans-cheap.example/en/6 forum.example/viagra-cheap
blog.example/casino-bonus news.example/free-bets-now shop.example/cheap-pills www.example/adult-xxx m.example/porn-video
""".split()
ALLOWED = """
www.university.example/en/12 library.example/books/3 news.example/world/2020 blog.example/en/17 m.example/fr/8 docs.example/guide
wiki.example/de/Berlin museum.example/art cityhall.example/services hospital.example/departments school.example/lessons
weather.example/today recipes.example/soup/4 garden.example/plants travel.example/italy rail.example/timetable science.example/papers/77
music.example/concerts theatre.example/programme radio.example/podcast/3 www.thewhen.example/en/110 blog.thring.example/de/25
m.tioner.example/es/300 thandon.example/fr/41 www.ererth.example/en/52 inganth.example/en/9 blog.ededtion.example/en/6?page=2
stones.example/en/741 shire.example/es/11 m.theand.example/en/25 www.onring.example/fr/18.html blog.bleand.example/en/5/
wherever.example/en/33 estate.example/de/7 kitchen.example/en/81 bakery.example/bread cinema.example/films forum.example/topic/12
maps.example/route history.example/rome nature.example/birds sports.example/results law.example/acts/9 jobs.example/teacher
""".split()


@dataclass(frozen=True)
class UrlModel:
    """Weights of hashed n-grams of host and path; each n-gram counts once in each part."""

    weights: np.ndarray
    bias: float
    sizes: tuple[int, ...] = (3, 4, 5)

    def slots(self, part: str, value: str) -> list[int]:
        return grams(part, value, self.sizes, len(self.weights))

    def score(self, host: str, path: str) -> float:
        found = [*self.slots("h", host), *self.slots("p", path)]
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[found].sum(), -30, 30))))


def grams(part: str, value: str, sizes: tuple[int, ...], buckets: int) -> list[int]:
    value = f"^{value}$"
    return list({zlib.crc32(f"{part}{value[i : i + n]}".encode()) % buckets for n in sizes for i in range(len(value) - n + 1)})


def train(blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, buckets: int = 1 << 14, sizes: tuple[int, ...] = (3, 4, 5), steps: int = 400, rate: float = 0.5, decay: float = 3e-3) -> UrlModel:
    """Gradient descent on the labelled table, which is small by its nature (``host/path`` rows)."""
    rows = [(u, 1.0) for u in blocked] + [(u, 0.0) for u in allowed]
    x = np.zeros((len(rows), buckets), np.float32)
    for i, (url, _) in enumerate(rows):
        host, _, path = url.partition("/")
        x[i, grams("h", host.removesuffix(".example"), sizes, buckets) + grams("p", "/" + path.split("?")[0], sizes, buckets)] = 1
    y = np.array([label for _, label in rows], np.float32)
    w, b = np.zeros(buckets, np.float32), 0.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(rows) + decay * w)
        b -= rate * float(error.mean())
    return UrlModel(w, b, sizes)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://``, A-Z lower-cased, and the path up to the query; both empty without it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """Longest fitting rule (``host + path``) and its verdict; null if none fits. Equal lengths: the first given."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, rule_host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        name = F.when(fits, rule_host + start).otherwise(name)
        verdict = F.when(fits, said).otherwise(verdict)
    return name, verdict


def url_filter(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, model: UrlModel | None = None, threshold: float = 0.5, id: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, fitting rule, score and verdict of every page.

    A null url or one without ``://`` has empty host and path, which no rule fits; the
    model judges it like any other. Ids may be null or repeat. Only id and url are read.
    """
    model = model or train()

    @F.pandas_udf("double")
    def scores(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series([model.score(strip_host(h), p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    rows = columns(pages, page_id=id, url=url)
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("_said"), scores("host", "path").alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("_said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")


def strip_host(host: str) -> str:
    """The host without its registry suffix, which the labelled table does not vary."""
    labels = host.split(".")
    keep = [x for x in labels[:-1] if x != "example"] or labels
    return ".".join(keep)
