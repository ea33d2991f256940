"""URL filters: host and path rules, and a logistic regression on hashed character n-grams for the rest.

The model is trained from a small labelled URL table, here the urls that a rule decides: the ``LABELLED`` with the
smallest hash, a bound that does not grow with the pages. Features are the n-grams of 3 to 5 bytes of host and path,
hashed apart into ``DIMS`` cells and scaled by the root of their number. Training is numpy on the driver; scoring goes
through all pages, block by block.

Defined results: a null url, or one without ``://``, has an empty host and path; such a url has no n-grams and gets the
verdict of the model's constant; without labelled urls every verdict that no rule gives is allow; repeated rows are judged
one by one; an empty table stays empty; very long urls are blocks of their own in memory; a column named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fettle.llm import blocks as B
from fettle.llm.arrow import kept_fields, map_arrow

#: Host, path and verdict of each rule.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
LABELLED = 4_000
DIMS = 1 << 14
SIZES = (3, 4, 5)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path without query and fragment; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), r"\A[^?#]*", 0)
    host = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    choices = []
    for own, prefix, verdict in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        choices.append(F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*choices)


def grams(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the n-grams of each text, with the number of their text."""
    data, at = B.column_bytes(pa.array([f"\x01{t}\x02" if t else "" for t in texts], pa.string()))
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    data = data[: len(text)].astype(np.uint64)
    cells, owner = [], []
    for n in SIZES:
        k = max(0, len(data) - n + 1)
        h = np.full(k, 2 * n + salt, np.uint64)
        for j in range(n):
            h = h * np.uint64(B.BASE) + data[j : k + j]
        inside = text[:k] == text[n - 1 : k + n - 1]
        cells.append((B.mix(h)[inside] % np.uint64(DIMS)).astype(np.int64))
        owner.append(text[:k][inside])
    return np.concatenate(cells), np.concatenate(owner)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Cells of all n-grams, url after url, and where each url's begin (one more at the end)."""
    (a, x), (b, y) = grams(hosts, 0), grams(paths, 1)
    cell, who = np.concatenate([a, b]), np.concatenate([x, y])
    order = np.argsort(who, kind="stable")
    return cell[order], np.searchsorted(who[order], np.arange(len(hosts) + 1))


def scores(weights: np.ndarray, hosts, paths) -> np.ndarray:
    """The probability of block for each url."""
    cell, at = features(hosts, paths)
    sums = np.concatenate([[0.0], np.cumsum(weights[cell])])
    n = np.diff(at)
    return 1 / (1 + np.exp(-(weights[DIMS] + (sums[at[1:]] - sums[at[:-1]]) / np.sqrt(np.maximum(n, 1)))))


def train(hosts: list[str], paths: list[str], block: np.ndarray, rounds: int = 300, rate: float = 4.0, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression, both classes with the same total weight; the constant comes last."""
    weights = np.zeros(DIMS + 1)
    if not len(block):
        weights[DIMS] = -1.0
        return weights
    cell, at = features(hosts, paths)
    n = np.diff(at)
    value = np.repeat(1 / np.sqrt(np.maximum(n, 1)), n)
    owner = np.repeat(np.arange(len(n)), n)
    share = np.where(block == 1, 0.5 / max(1, block.sum()), 0.5 / max(1, (1 - block).sum()))
    for _ in range(rounds):
        wrong = (1 / (1 + np.exp(-(weights[DIMS] + np.bincount(owner, weights[cell] * value, len(n))))) - block) * share
        weights[:DIMS] -= rate * (np.bincount(cell, wrong[owner] * value, DIMS) + decay * weights[:DIMS])
        weights[DIMS] -= rate * wrong.sum()
    return weights


def _judge(batches: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        p = scores(shared.value, batch["host"].to_pylist(), batch["path"].to_pylist()) if len(batch) else np.zeros(0)
        columns = [pa.array(p) if f.name == "block_score" else batch[f.name] for f in schema]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def labelled(urls: DataFrame, n: int = LABELLED) -> tuple[list[str], list[str], np.ndarray]:
    """Host, path and label of the ``n`` distinct ruled urls with the smallest hash: half for each verdict, more where the other has fewer."""
    found = urls.where("rule IS NOT NULL").select("host", "path", "verdict").distinct()
    least = lambda verdict: found.where(F.col("verdict") == verdict).orderBy(F.xxhash64("host", "path"), "host", "path").limit(n).collect()
    block, allow = least("block"), least("allow")
    rows = block[: max(n // 2, n - len(allow))] + allow[: max(n - n // 2, n - len(block))]
    return [r.host for r in rows], [r.path for r in rows], np.array([r.verdict == "block" for r in rows], float)


def filter_urls(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules=RULES, n_labelled: int = LABELLED) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every page."""
    spark = pages.sparkSession
    host, path = host_path(F.col(url))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = parts.withColumn("r", ruled(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", "r.verdict")
    weights = train(*labelled(urls, n_labelled))
    fields = kept_fields(urls, urls.columns) + [T.StructField("block_score", T.DoubleType())]
    scored = map_arrow(urls, _judge, fields, shared=spark.sparkContext.broadcast(weights))
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("verdict", own))


