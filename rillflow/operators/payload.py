"""Payload features: entropy, character ratios, HTTP and DNS names, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window


def entropy(rows: DataFrame, key: Sequence[str], symbol: str) -> DataFrame:
    """Shannon entropy of exploded symbols over ln 256; -1 for two or fewer."""
    counts = rows.groupBy(*key, symbol).agg(F.count("*").alias("__c"))
    share = counts.withColumn("__n", F.sum("__c").over(Window.partitionBy(*key)))
    p = F.col("__c") / F.col("__n")
    return share.groupBy(*key).agg(F.when(F.max("__n") <= 2, -1.0).otherwise(F.round(-F.sum(p * F.ln(p)) / F.ln(F.lit(256.0)), 6)).alias("entropy"))


@F.pandas_udf(DoubleType())
def byte_entropy(payloads: pd.Series) -> pd.Series:
    """Shannon entropy of a payload's bytes over ln 256; -1 for two or fewer, and for none. Row by row, without a shuffle."""

    def of(data: bytes | None) -> float:
        if data is None or len(data) <= 2:
            return -1.0
        share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
        share = share[share > 0]
        return float(-(share * np.log(share)).sum() / np.log(256.0))

    return payloads.map(of)


def character_ratios(text: Column) -> dict[str, Column]:
    """Share of printable characters (tab-free text, line ends, 127 included) and of control characters below 10."""
    n = F.greatest(F.length(text), F.lit(1))
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    return {"char_ratio": F.round((F.length(text) - kept("[\\x20-\\x7F\\n\\r]")) / n, 6), "bin_ratio": F.round((F.length(text) - kept("[\\x00-\\x09]")) / n, 6)}


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, path and query by expressions that don't fail on odd urls."""
    part = lambda g: F.regexp_extract(url, r"^([a-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", g)
    return {"scheme": part(1), "host": part(2), "path": part(3), "query": part(4)}


def last_labels(host: Column, n: int) -> Column:
    """The last ``n`` labels of a host name; the name itself if it has fewer."""
    labels = F.split(host, r"\.")
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n), ".")


def fingerprint(*parts: Column) -> Column:
    """MD5 of comma-joined parts."""
    return F.md5(F.concat_ws(",", *parts))


def json_field(text: Column, name: str) -> Column:
    return F.get_json_object(text, f"$.{name}")
