"""Scans of texts and JSON of any shape for images and paths."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import PurePosixPath
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweft.session import plain

# What a finding looks like, and the names under which documents keep paths.
PATTERNS = {
    "data_uri": r"(?i)data:image/",
    "local_image": r"""(?i)(?:src|href)\s*=\s*(?:"(?!https?://|//|data:)[^'"]+\.(?:jpe?g|png|webp)(?:[?#][^'"]*)?"|'(?!https?://|//|data:)[^'"]+\.(?:jpe?g|png|webp)(?:[?#][^'"]*)?')""",
    "css_url": r"""(?i)url\(\s*(['"]?)(?!https?://|//|data:)[^)'"\s]+\.(?:jpe?g|png|webp)(?:[?#][^)'"\s]*)?\1\s*\)""",
    "web_url": r"""https?://[^\s"'<>)]+""",
}
PATH_KEYS = ("local_path", "relative_path", "local_media_path")
REMOTE_KEY = "direct_remote_url"
PHOTO = (".jpg", ".jpeg", ".png", ".webp")
HERE = ("localhost", "127.0.0.1", "::1")


def is_local_photo(key: str, value: str) -> bool:
    """Whether a member of a document says that an image lies here: a path to one, or a remote address that is none."""
    try:
        at = urlsplit(value)
        host = at.hostname
    except ValueError:
        return key == REMOTE_KEY
    photo = PurePosixPath(at.path).suffix.lower() in PHOTO
    if key != REMOTE_KEY:
        return photo
    if re.match("data:image/", value, re.I):
        return True
    return bool(value) and (at.scheme not in ("http", "https") or not at.netloc or photo and host in HERE)


def content_scan(texts: DataFrame, key: str, text: str, kinds: tuple[str, ...] = tuple(PATTERNS)) -> DataFrame:
    """(key, kind, finding): each distinct finding of each text."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col(text), F.lit(PATTERNS[k]), F.lit(0)).alias("fs")) for k in kinds])
    x = texts.select(key, F.explode(found).alias("x")).select(key, "x.kind", F.explode("x.fs").alias("finding"))
    return x.distinct()


def key_scan(docs: DataFrame, key: str, payload: str, wanted: tuple[str, ...] = (*PATH_KEYS, REMOTE_KEY), photos: bool = True) -> DataFrame:
    """(key, path, value): texts under exactly the wanted names anywhere in JSON of any depth; unreadable JSON gives none.

    With photos only those are found that ``is_local_photo``. What lies under a wanted name is not
    searched further.
    """

    def visit(x, at: str) -> Iterator[tuple[str, str]]:
        if isinstance(x, dict):
            for k, v in x.items():
                here = f"{at}.{k}"
                if k in wanted and isinstance(v, str):
                    if not photos or is_local_photo(k, v):
                        yield here, v
                else:
                    yield from visit(v, here)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from visit(v, f"{at}[{i}]")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, p in zip(b["k"], b["p"]):
                try:
                    rows += [(k, at, v) for at, v in visit(json.loads(p), "$")]
                except (TypeError, ValueError, RecursionError):
                    continue
            yield plain(pd.DataFrame(rows, columns=["key", "path", "value"]))

    return docs.select(F.col(key).cast("string").alias("k"), F.col(payload).alias("p")).mapInPandas(run, "key string, path string, value string")
