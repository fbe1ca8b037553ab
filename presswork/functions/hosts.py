"""Internationalised host names in ASCII, label by label."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

#: Characters of a label and of a name at most.
LABEL, NAME = 63, 253


def to_ascii(host: str) -> str | None:
    """Compatibility forms and case folded, dots of any script as dots, labels beyond ASCII in Punycode; null if a label is empty or too long."""
    labels = re.split("[.\u3002\uff0e\uff61]", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", host).lower()))
    if len(labels) > 1 and not labels[-1]:
        labels.pop()
    coded = [x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels]
    if any(not 0 < len(x) <= LABEL or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|]", x) for x in coded) or len(".".join(coded)) > NAME:
        return None
    return ".".join(coded)


def ascii_host(host: Column) -> Column:
    def named(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: None if h is None else to_ascii(h))

    return F.pandas_udf(named, "string")(host)
