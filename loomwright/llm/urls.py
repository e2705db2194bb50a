"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained in numpy on a small labelled table of URLs (a parameter; it is the whole training set).
A url without ``://`` or a null url has an empty host and path; the model judges these too.
The longest fitting rule wins, by the length of host and path together. Repeated rows are judged alike.
Other columns are not returned. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, small_batches, table

#: verdict, host, path
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: host, path, blocked: the labelled table.
LABELLED = (
    ("news.example.net", "/en/article/12", 0),
    ("library.example.net", "/fr/book", 0),
    ("docs.example.com", "/en/guide", 0),
    ("school.example.edu", "/course/3", 0),
    ("science.example.com", "/es/paper/7", 0),
    ("wiki.example.net", "/en/history", 0),
    ("health.example.com", "/en/advice", 0),
    ("museum.example.net", "/de/art", 0),
    ("casino.example.net", "/win/bonus", 1),
    ("freeporn.example.com", "/video/xxx", 1),
    ("cheap-pills.example.com", "/buy/viagra", 1),
    ("bets.example.net", "/poker/jackpot", 1),
    ("xxxcams.example.net", "/live", 1),
    ("warez.example.com", "/crack/keygen", 1),
    ("click-ads.example.net", "/popup/prize", 1),
    ("spam.example.com", "/free-money/now", 1),
)
BITS, GRAMS = 14, (3, 4, 5)


def features(host: str, path: str, bits: int = BITS) -> np.ndarray:
    """Bucket numbers of the distinct n-grams of host and path, which are told apart."""
    grams = {f"{kind}{s[i:i + n]}" for kind, s in (("h", f"^{host}$"), ("p", f"^{path}$")) for n in GRAMS for i in range(len(s) - n + 1)}
    return np.fromiter({zlib.crc32(g.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1) for g in grams}, dtype=np.int64)


def train(labelled=LABELLED, bits: int = BITS, rounds: int = 200, rate: float = 0.5, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent on length-normalised binary features."""
    x = np.zeros((len(labelled), 1 << bits))
    for row, (host, path, _) in zip(x, labelled, strict=True):
        f = features(host, path, bits)
        row[f] = 1 / np.sqrt(max(1, len(f)))
    y = np.array([v for *_, v in labelled], dtype=float)
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(rounds):
        miss = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ miss + decay * w)
        b -= rate * miss.mean()
    return w, b


def probability(model: tuple[np.ndarray, float], host: str, path: str) -> float:
    f = features(host, path, int(np.log2(len(model[0]))))
    return float(1 / (1 + np.exp(-(model[0][f].sum() / np.sqrt(max(1, len(f))) + model[1]))))


def split_url(url: Column) -> tuple[Column, Column]:
    found = F.instr(url, "://") > 0
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.when(found, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")
    path = F.when(found, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def judge(pages: DataFrame, rules=RULES, labelled=LABELLED, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block."""
    model = train(labelled)
    host, path = split_url(F.col("url"))
    out = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule, said = F.when(fits, f"{h}{p}").otherwise(rule), F.when(fits, kind).otherwise(said)
    out = out.withColumns({"rule": rule, "_said": said})
    small_batches(pages.sparkSession, 4096)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in batches:
            yield pd.Series([probability(model, h, p) for h, p in zip(hosts, paths, strict=True)], dtype="float64")

    out = out.withColumn("p_block", score("host", "path"))
    return out.withColumn("verdict", F.coalesce("_said", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))).drop("_said")


def op6(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"))
