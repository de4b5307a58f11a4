"""What a file is by its first bytes, and XML as lines of text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# How files begin (hexadecimal), with their types.
SIGNATURES = (
    ("^25504446", "application/pdf"), ("^89504E470D0A1A0A", "image/png"), ("^FFD8FF", "image/jpeg"), ("^474946", "image/gif"), ("^(49492A00|4D4D002A)", "image/tiff"), ("^504B0304", "application/zip"), ("^D0CF11E0A1B11AE1", "application/x-cfb"),
    ("^52494646.{8}57415645", "audio/wav"), ("^4F676753", "audio/ogg"), ("^494433", "audio/mpeg"), ("^FF[EF]", "audio/mpeg"), ("^.{8}66747970(4D3441)", "audio/x-m4a"), ("^.{8}66747970(4D3442|6D7034|69736F6D)", "audio/mp4"),
)
MOST_CHARS = 500_000


def media_type(content: Column) -> Column:
    """The type of a file's content (binary): by signature, else XML by its first 64 bytes, else null."""
    head = F.hex(F.substring(content, 1, 64))
    text = F.decode(F.substring(content, 1, 64), "ISO-8859-1")
    out = F.when(text.rlike(r"^(\xEF\xBB\xBF)?\s*<(\?xml|[A-Za-z_][\w.:-]*[\s>/])"), "text/xml")
    for pattern, kind in reversed(SIGNATURES):
        out = F.when(head.rlike(pattern), kind).otherwise(out)
    return out


def _lines(xml: str | None) -> str:
    """Walks by a stack, so that depth is bounded by memory alone, and stops at ``MOST_CHARS``."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return ""
    out: list[str] = []
    size, todo = 0, [(root, root.tag)]
    while todo and size <= MOST_CHARS:
        node, path = todo.pop()
        own = [f"{path}@{k}: {v}" for k, v in node.attrib.items()]
        if node.text and node.text.strip():
            own.append(f"{path}: {node.text.strip()}")
        out += own
        size += sum(map(len, own)) + len(own)
        total, seen, inner = Counter(c.tag for c in node), Counter(), []
        for child in node:
            place = f"[{seen[child.tag]}]" if total[child.tag] > 1 else ""
            seen[child.tag] += 1
            inner.append((child, f"{path}/{child.tag}{place}"))
        todo += reversed(inner)
    text = "\n".join(out)
    return text if len(text) <= MOST_CHARS else text[:MOST_CHARS] + "\n[cut]"


@F.pandas_udf(StringType())
def xml_lines(xml: pd.Series) -> pd.Series:
    """``a/b[i]: value`` and ``a@name: value`` for every value of an XML text, 500,000 characters at most; empty if it can't be
    parsed. Spark's XML reader needs a schema that such files lack."""
    return xml.map(_lines)
