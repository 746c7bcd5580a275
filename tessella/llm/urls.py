"""URL filter: rules by host and path prefix, and a logistic regression for what no rule fits.

The regression's features are character n-grams of the host and of the path, hashed into 2**BITS buckets. It is fitted
on the driver by full-batch gradient descent on a small labelled table; its weights (2**BITS floats) go to the workers
once. Host, path and rule are column expressions; only the regression runs in Python. URLs are judged where they are
read: no shuffle, and a host that has a third of all pages costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import batch, map_batches

BITS, GRAMS = 14, (3, 4, 5)
SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"

#: (verdict, host, path prefix)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The small labelled table, written for this module: 1 is to be blocked (spam, gambling, adult, quick credit, fakes).
LABELLED = (
    ("http://online-casino-bonus.test/play", 1), ("https://www.best-poker-room.test/free-bonus", 1), ("http://slots-jackpot.test/win/now", 1),
    ("https://betting-tips.test/casino/odds?ref=1", 1), ("http://free-spins.test/slots", 1), ("https://casino.city-guide.test/bonus", 1),
    ("http://cheap-viagra.test/order", 1), ("https://discount-pills.test/buy/viagra", 1), ("http://pharmacy-no-prescription.test/cheap/pills.html", 1),
    ("https://buy-cialis.test/cheap", 1), ("http://diet-pills.test/lose-weight-fast", 1), ("https://miracle-weight-loss.test/offer", 1),
    ("http://xxx-cams.test/live", 1), ("https://adult-videos.test/watch/44", 1), ("http://hot-sex-chat.test/", 1),
    ("https://porn-tube.test/xxx/9", 1), ("http://escort-girls.test/adult", 1), ("https://nude-webcam.test/sex", 1),
    ("http://payday-loans.test/apply", 1), ("https://instant-cash-loan.test/no-credit-check", 1), ("http://get-rich-quick.test/earn-money-fast", 1),
    ("https://work-from-home-cash.test/earn/money", 1), ("http://crypto-double.test/free-coins", 1), ("https://forex-signals.test/make-money", 1),
    ("http://replica-watches.test/sale", 1), ("https://fake-designer-bags.test/replica/cheap", 1), ("http://cracked-software.test/keygen/download", 1),
    ("https://warez-torrents.test/crack", 1), ("http://link-exchange-spam.test/seo/backlinks", 1), ("https://buy-backlinks.test/seo-farm", 1),
    ("http://spam.test/click-here", 1), ("https://click-farm.test/traffic", 1), ("http://free-gift-cards.test/claim/prize", 1),
    ("https://you-won-a-prize.test/claim-now", 1), ("http://spammy-links.test/page?aff=77", 1), ("https://link-farm.test/links/1000", 1),
    ("https://library.test/catalogue/55", 0), ("https://www.university.test/en/research", 0), ("http://museum.test/exhibitions/2024", 0),
    ("https://news.test/politics/12.html", 0), ("http://www.gazette.test/local/council-meeting", 0), ("https://weather.test/forecast?city=3", 0),
    ("https://docs.software.test/guide/install", 0), ("https://wiki.test/wiki/History_of_printing", 0), ("http://forum.gardening.test/thread/8812", 0),
    ("https://blog.test/2024/05/a-walk-in-the-hills", 0), ("http://m.recipes.test/bread/sourdough", 0), ("https://school.test/timetable.html", 0),
    ("https://city.test/de/rathaus", 0), ("http://www.mairie.test/fr/horaires", 0), ("https://biblioteca.test/es/libros/7", 0),
    ("https://zeitung.test/de/kultur/88", 0), ("http://hospital.test/visitors", 0), ("https://journal.test/articles/10/abstract", 0),
    ("https://shop.test/books/fiction", 0), ("http://bicycle-repair.test/howto/brakes", 0), ("https://orchestra.test/concerts?season=2", 0),
    ("https://trains.test/departures/12", 0), ("http://archive.test/en/letters/1890", 0), ("https://maths.test/lectures/algebra.pdf", 0),
    ("https://en.test/en/1", 0), ("http://www.test/es/825?page=2", 0), ("https://garden.test/en/soil.html", 0), ("http://m.test/fr/671/", 0),
    ("https://farm-museum.test/visit", 0), ("http://bank-holiday-walks.test/en/9", 0), ("https://pillow-makers.test/about", 0), ("http://sussex-birds.test/sightings", 0),
    ("https://credit-union.test/members", 0), ("http://charity.test/gift-aid", 0), ("https://watchmaker.test/repairs", 0), ("http://data.test/download/table.csv", 0),
)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL: A-Z of the host lower-cased; both empty without `://`."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends)] if ends else rest
    at = rest.find("/")
    host, path = (rest, "") if at < 0 else (rest[:at], rest[at:])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def parts_of(url: Column) -> tuple[Column, Column]:
    """The same as columns."""
    found = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(found, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def buckets(host: str, path: str) -> np.ndarray:
    grams = (f"{k}{x[i : i + n]}" for k, x in (("h:", f"^{host}$"), ("p:", f"^{path}$")) for n in GRAMS for i in range(len(x) - n + 1))
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(g) & (1 << BITS) - 1 for g in grams), np.int64))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        at = buckets(host, path)
        return float(1 / (1 + np.exp(-(self.weights[at].sum() / np.sqrt(max(1, len(at))) + self.bias))))


def fit(labelled: tuple = LABELLED, rounds: int = 400, rate: float = 0.5, decay: float = 1e-3) -> Model:
    """Logistic regression by full-batch gradient descent; each URL's features have length 1."""
    rows = [buckets(*parts(u)) for u, _ in labelled]
    x = np.zeros((len(rows), 1 << BITS))
    for i, at in enumerate(rows):
        x[i, at] = 1 / np.sqrt(max(1, len(at)))
    y, w, b = np.array([v for _, v in labelled], float), np.zeros(1 << BITS), 0.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ g + decay * w)
        b -= rate * g.mean()
    return Model(w, b)


def judge(pages: DataFrame, rules: tuple = RULES, model: Model | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, rule and verdict of each row; `score` is the regression's probability of `block`.

    A null URL, or one without `://`, has an empty host and path and fits no rule; the regression judges it like any
    other. Ids may be null or repeat; an empty table gives no rows; other columns are not read.
    """
    model = model or fit()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(h, p) for h, p in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            verdicts = [v or ("block" if s >= threshold else "allow") for v, s in zip(b.column(4).to_pylist(), scores)]
            yield batch([x.split()[0] for x in SCHEMA.split(", ")], *(b.column(i) for i in range(4)), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64()))

    host, path = parts_of(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest last, of equally long ones the first
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return map_batches(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("known")), run, SCHEMA)
