"""Readable hosts and look-alike skeletons. Python, so only ever on distinct hosts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters that look like a Latin one.
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "ӏ": "l", "ѵ": "v", "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "г": "r", "Ӏ": "l", "ɢ": "g",
    "ο": "o", "α": "a", "ρ": "p", "ν": "v", "ι": "i", "υ": "u", "χ": "x", "κ": "k", "τ": "t", "ϲ": "c", "ε": "e", "η": "n", "ω": "w",
    "ց": "g", "օ": "o", "ս": "u", "ո": "n", "հ": "h", "զ": "q",
    "ı": "i", "ɑ": "a", "ⅼ": "l", "ℓ": "l", "ᴏ": "o", "ᴄ": "c", "ɡ": "g",
}


def _label(label: str) -> str:
    try:
        return label[4:].encode("ascii").decode("punycode") if label.lower().startswith("xn--") else label
    except (UnicodeError, ValueError):
        return label


@F.pandas_udf(StringType())
def readable(hosts: pd.Series) -> pd.Series:
    """Punycode labels decoded; what does not decode stays."""
    return hosts.map(lambda h: None if h is None else ".".join(map(_label, h.split("."))))


@F.pandas_udf(StringType())
def skeleton(hosts: pd.Series) -> pd.Series:
    """Lower case, without marks, look-alike letters as Latin ones."""

    def one(h: str | None) -> str | None:
        if h is None or h.isascii():
            return h and h.lower()
        plain = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", h.lower()))
        return "".join(LOOK_ALIKES.get(c, c) for c in plain if not "̀" <= c <= "ͯ")

    return hosts.map(one)


def host_table(messages: DataFrame, column: str) -> DataFrame:
    """``(host, readable, skeleton)`` of the distinct hosts of a column; joins back by host."""
    hosts = messages.select(F.col(column).alias("host")).where("host IS NOT NULL").distinct().withColumn("readable", readable("host"))
    return hosts.withColumn("skeleton", skeleton("readable"))
