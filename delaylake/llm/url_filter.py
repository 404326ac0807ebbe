"""Operator 7: URL verdicts from rules, and from boosted trees where no rule fits.

The trees see lexical features only: lengths, depth, digit ratio, entropy,
parameter counts, and for the last one and two labels of the host how often
labelled URLs with that suffix were blocked; for a URL that the trees are fitted on, its own
fold of the labelled ones does not count. Labelled URLs are those that a rule
decides. They are fitted on at most ``SAMPLE`` distinct labelled URLs (those
with the least hash), a bound that does not grow with the table; every page is
judged.

Defined results: a null url, or one without ``://``, has empty host and path, fits
no rule and is judged by the model; repeated pages give repeated rows; with no
labelled URL at all the model allows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, ship, table
from .trees import Boosted

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SAMPLE = 20_000
FOLDS = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_path(url):
    """Columns host and path of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(host, path, rules=RULES):
    """The longest fitting rule's name and verdict; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name = F.when(fits, F.lit(h + p)).otherwise(name)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _entropy(text: str) -> float:
    if not text:
        return 0.0
    counts = np.unique(list(text), return_counts=True)[1] / len(text)
    return float(-(counts * np.log2(counts)).sum())


@dataclass
class UrlModel:
    seen: dict[str, tuple[float, float]]
    prior: float
    trees: Boosted | None

    def rate(self, suffix: str, without: tuple[float, float] | None = None) -> float:
        """Share of block among labelled URLs of the suffix, drawn to the share in all; ``without`` leaves out counts."""
        blocked, n = self.seen.get(suffix, (0.0, 0.0))
        if without:
            blocked, n = blocked - without[0], n - without[1]
        return (blocked + 10 * self.prior) / (n + 10)

    def features(self, urls: pd.Series, hosts: pd.Series, paths: pd.Series, left_out: list[dict[str, tuple[float, float]]] | None = None) -> np.ndarray:
        """Rows of features; of labelled URLs ``left_out`` has the counts of their own fold, which their rates do without."""
        rows = []
        for k, (url, host, path) in enumerate(zip(urls.fillna(""), hosts, paths)):
            own = left_out[k] if left_out else {}
            labels = host.split(".")
            query = url.partition("?")[2].partition("#")[0]
            n = max(1, len(url))
            digits = sum(c.isdigit() for c in url)
            rows.append(
                (
                    len(url),
                    len(host),
                    len(path),
                    len(query),
                    path.strip("/").count("/") + 1 if path.strip("/") else 0,
                    len(labels),
                    max(map(len, labels)),
                    digits / n,
                    sum(c.isdigit() for c in host),
                    host.count("-"),
                    _entropy(url),
                    _entropy(host),
                    query.count("&") + 1 if query else 0,
                    float("#" in url),
                    float(url.startswith("https")),
                    len(re.findall(r"[^A-Za-z0-9:/.?&=#_-]", url)),
                    self.rate(labels[-1], own.get(labels[-1])),
                    self.rate(".".join(labels[-2:]), own.get(".".join(labels[-2:]))),
                )
            )
        return np.array(rows, dtype=np.float64).reshape(-1, 18)

    def scores(self, urls: pd.Series, hosts: pd.Series, paths: pd.Series) -> np.ndarray:
        if self.trees is None:
            return np.zeros(len(urls))
        return self.trees.predict(self.features(urls, hosts, paths))


def fit(labelled: pd.DataFrame) -> UrlModel:
    """Fit on ``url, host, path, verdict`` rows."""
    y = (labelled.verdict == "block").to_numpy(float)
    if not len(y):
        return UrlModel({}, 0.0, None)
    prior = float(y.mean())
    fold_of = labelled.url.fillna("").map(lambda u: zlib.crc32(u.encode("utf-8", "surrogatepass")) % FOLDS).to_numpy()
    folds: list[dict[str, tuple[float, float]]] = [{} for _ in range(FOLDS)]
    seen: dict[str, tuple[float, float]] = {}
    for host, label, fold in zip(labelled.host, y, fold_of):
        parts = host.split(".")
        for suffix in {parts[-1], ".".join(parts[-2:])}:
            for counts in (seen, folds[fold]):
                blocked, n = counts.get(suffix, (0.0, 0.0))
                counts[suffix] = (blocked + label, n + 1)
    model = UrlModel(seen, prior, None)
    # rules label some hosts more often than others: both verdicts weigh the same in all
    weight = np.where(y > 0, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9))
    model.trees = Boosted.fit(model.features(labelled.url, labelled.host, labelled.path, [folds[k] for k in fold_of]), y, weight)
    return model


def judged(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """``page_id, host, path, rule, verdict, score`` for every page; score is the model's chance of block, null where a rule decides."""
    ship(pages.sparkSession)
    url = F.col("url").cast("string")
    host, path = host_path(url)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    ruled = rows.filter("ruled is not null").select("url", "host", "path", F.col("ruled").alias("verdict"))
    labelled = bounded_sample(ruled, ["url"], sample, distinct=True)
    model = fit(labelled.toPandas())

    @F.pandas_udf("double")
    def score(urls: pd.Series, hosts: pd.Series, paths: pd.Series, ruled: pd.Series) -> pd.Series:
        open_ = ruled.isna().to_numpy()
        out = pd.Series([None] * len(urls), dtype="Float64")
        if open_.any():
            out[open_] = model.scores(urls[open_], hosts[open_], paths[open_])
        return out

    scored = rows.withColumn("score", score("url", "host", "path", "ruled"))
    return scored.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score"
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES: dict[str, str] = {}
