"""URL filters: listed rules first, then logistic regression on hashed character n-grams.

Host and path are cut with column expressions. The longest rule whose host is the url's host or a parent
domain of it, and whose path starts the url's path, gives the verdict. All other urls are judged by a
numpy logistic regression over hashed n-grams of host and path, trained from a small labelled table.
Rules and table are parameters held on the driver; pages are judged where they are read.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and the
verdict of the model's bias (allow). An empty path fits no rule, since a rule's path begins with a slash.
Rows are judged one by one, so repeated rows repeat their verdict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notemill.llm import words

# Fixed values: (verdict, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

# A small labelled table of invented urls: what the model learns from.
LABELLED = (
    ("block", "http://casino-win.example/en/4"),
    ("block", "https://www.best-casino.example/slots"),
    ("block", "https://m.online-casino.example/fr/77?ref=x"),
    ("block", "http://blog.win-big-jackpot.example/es/9"),
    ("block", "https://www.free-bets.example/en/31"),
    ("block", "http://sports-bets.example/de/8#top"),
    ("block", "https://bets-today.example/odds/15"),
    ("block", "https://www.cheap-pills.example/en/2"),
    ("block", "http://pills-online.example/buy/12"),
    ("block", "https://m.cheap-meds.example/viagra"),
    ("block", "https://blog.cheap-loans.example/es/5"),
    ("block", "http://spam-farm.example/en/16"),
    ("block", "https://www.link-farm.example/de/1"),
    ("block", "https://m.seo-spam.example/fr/90"),
    ("block", "https://ads-track.example/en/3?utm_source=feed"),
    ("block", "http://www.ad-tracker.example/pixel/1.html"),
    ("block", "https://track-clicks.example/es/11"),
    ("block", "http://blog.popup-ads.example/en/6"),
    ("block", "https://adult-x.example/en/8"),
    ("block", "http://www.xxx-adult.example/fr/30"),
    ("block", "https://m.adult-cams.example/de/2"),
    ("block", "https://www.free-xxx.example/videos/7"),
    ("block", "http://free-download-crack.example/en/10"),
    ("block", "https://blog.get-rich-quick.example/es/4"),
    ("block", "https://m.poker-bonus.example.net/en/25"),
    ("block", "http://www.replica-watches.example.com/fr/9"),
    ("block", "https://blog.spam-offers.example.org/de/17"),
    ("allow", "https://www.university.example/en/4"),
    ("allow", "https://m.that.example.net/en/14"),
    ("allow", "http://m.hatter.example.com/en/61?page=2&ref=x"),
    ("allow", "https://www.father.example.org/fr/35"),
    ("allow", "http://m.interest.example.net/es/20#top"),
    ("allow", "https://blog.weathered.example.com/de/73"),
    ("allow", "http://thread.example.net/en/52.html"),
    ("allow", "https://m.otherwise.example.org/en/84/"),
    ("allow", "http://library.example/fr/77"),
    ("allow", "https://blog.gardening.example/en/9.html"),
    ("allow", "https://m.weather.example/de/8?page=2&ref=x"),
    ("allow", "https://news.example/es/31#top"),
    ("allow", "http://www.museum.example/en/2"),
    ("allow", "https://theatre.example/fr/12/"),
    ("allow", "https://blog.thinking.example/es/5"),
    ("allow", "http://m.another.example/de/16"),
    ("allow", "https://www.together.example/en/1?utm_source=feed"),
    ("allow", "https://weather-station.example/fr/90"),
    ("allow", "http://blog.history.example/en/3.html"),
    ("allow", "https://www.motion.example/es/11"),
    ("allow", "http://hand-tools.example/en/6"),
    ("allow", "https://m.northern.example/fr/30/"),
    ("allow", "https://www.recipes.example/de/2"),
    ("allow", "http://then.example/en/7?page=2&ref=x"),
    ("allow", "https://blog.open-science.example/en/10"),
    ("allow", "https://health-service.example/es/4"),
    ("allow", "http://www.edition.example/fr/66.html"),
    ("allow", "https://m.gathering.example/en/28#top"),
    ("allow", "https://notes.example/de/45"),
    ("allow", "http://blog.there-and-back.example/en/13"),
    ("allow", "https://www.station.example/es/71"),
)

SIZES = (3, 4)
BITS = 16
STEPS = 300
RATE = 0.3
DECAY = 1e-3
MADE = ("host", "path", "rule", "verdict")


def host_of(url: str) -> Column:
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


class RuleBook:
    """Rules by host; a url asks for its host and each parent domain."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[int, str, str] | None = None
        domain = host
        while domain:
            for start, rule, verdict in self.by_host.get(domain, ()):
                if path.startswith(start) and (best is None or (len(rule), rule) > best[:2]):
                    best = (len(rule), rule, verdict)
            domain = domain.partition(".")[2]
        return (best[1], best[2]) if best else (None, None)


def gram_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed n-gram) of every n-gram inside a row."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, places = [], []
    for size in SIZES:
        count = max(0, len(raw) - size + 1)
        key = np.full(count, size, dtype=np.uint64)
        for i in range(size):
            key = (key << np.uint64(8)) | raw[i : i + count].astype(np.uint64)
        inside = row[:count] == row[size - 1 : size - 1 + count]
        rows.append(row[:count][inside])
        places.append((words.scramble(key[inside]) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(places)


class UrlModel:
    def __init__(self, labelled: Sequence[tuple[str, str]]):
        urls = [url.partition("://")[2].partition("?")[0].partition("#")[0].lower() for _, url in labelled]
        y = np.array([verdict == "block" for verdict, _ in labelled], dtype=np.float64)
        self.weights, self.bias = np.zeros(1 << BITS), 0.0
        if not len(y) or y.all() or not y.any():
            self.bias = 1.0 if len(y) and y.all() else -1.0
            return
        row, place = gram_places(*words.bytes_of(pa.array(urls, pa.string())))
        names, column = np.unique(place, return_inverse=True)
        x = np.zeros((len(y), len(names)))
        x[row, column] = 1
        x /= np.maximum(1, np.sqrt(x.sum(axis=1, keepdims=True)))
        w, b = np.zeros(len(names)), -1.0
        for _ in range(STEPS):
            error = (1 / (1 + np.exp(-(x @ w + b))) - y) / len(y)
            w -= RATE * len(y) * (error @ x + DECAY * w)
            b -= RATE * error.sum()
        self.weights[names], self.bias = w, float(min(b, -1e-3))

    def block(self, host: list[str], path: list[str]) -> np.ndarray:
        raw, offsets = words.bytes_of(pa.array([h + p.lower() for h, p in zip(host, path, strict=True)], pa.string()))
        row, place = gram_places(raw, offsets)
        key = np.unique(row * (1 << BITS) + place)
        row, place = np.divmod(key, 1 << BITS)
        n = np.bincount(row, minlength=len(host))
        margin = np.bincount(row, self.weights[place], len(host)) / np.maximum(1, np.sqrt(n)) + self.bias
        return 1 / (1 + np.exp(-margin))


def filter_urls(
    pages: DataFrame,
    url: str = "url",
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: Sequence[tuple[str, str]] = LABELLED,
) -> DataFrame:
    """``pages`` with host, path, rule, ``block_score`` and verdict."""
    made = (*MADE, "block_score")
    book, model = RuleBook(rules), UrlModel(labelled)
    known = pages.sparkSession.sparkContext.broadcast((book, model))
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    cut = pages.select(F.struct(F.lit(True).alias("_"), *rest).alias("_row"), host_of(url).alias("host"), path_of(url).alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book, model = known.value
        for batch in batches:
            for part in words.slices(batch, "path"):
                host, path = part.column("host").to_pylist(), part.column("path").to_pylist()
                score = model.block(host, path)
                found = [book.match(h, p) for h, p in zip(host, path, strict=True)]
                verdict = [v or ("block" if s >= 0.5 else "allow") for (_, v), s in zip(found, score.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([r for r, _ in found], pa.string()), pa.array(verdict, pa.string()), pa.array(score, pa.float64())],
                    names=["_row", *made],
                )

    schema = T.StructType([*cut.schema.fields, *T.StructType.fromDDL("rule string, verdict string, block_score double")])
    out = cut.mapInArrow(judge, schema)
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in pages.columns if c not in made], *made)
