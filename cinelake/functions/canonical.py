"""Canonical JSON and its keys (F10, D16): the same value gives the same text however its keys are ordered.

Keys are sorted at every depth, nothing stands between tokens, and characters beyond ASCII are escaped, as Python's
``json`` writes them.  That is no expression of Spark (its JSON functions keep the order of the text and the form of
numbers), so it runs over Arrow batches, once for each different text of a batch.
"""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: Bytes of a key, and of a host's.  Fixed values.
KEY_BYTES, HOST_BYTES = 16, 12


def canonical_text(text: str | None) -> str | None:
    """The canonical form of a JSON text; null for null and for what is no JSON."""
    try:
        return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


def key_of(text: str | None) -> str | None:
    """BLAKE2b of 128 bits of a text, as hex digits."""
    return None if text is None else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=KEY_BYTES).hexdigest()


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    known = {t: canonical_text(t) for t in text.dropna().unique()}
    return text.map(known)


@F.pandas_udf(StringType())
def hash_text(text: pd.Series) -> pd.Series:
    known = {t: key_of(t) for t in text.dropna().unique()}
    return text.map(known)


@F.pandas_udf(StringType())
def hash_json(text: pd.Series) -> pd.Series:
    """Key of the canonical form of a JSON text."""
    known = {t: key_of(canonical_text(t)) for t in text.dropna().unique()}
    return text.map(known)


@F.pandas_udf(StructType().add("canonical", StringType()).add("key", StringType()))
def canonical_and_key(text: pd.Series) -> pd.DataFrame:
    """Canonical form of a JSON text with its key, for one parse."""
    known = {t: canonical_text(t) for t in text.dropna().unique()}
    found = text.map(known)
    return pd.DataFrame({"canonical": found, "key": [key_of(t) if isinstance(t, str) else None for t in found]})


#: JSON texts of one member that are canonical as ``to_json`` writes them.
PLAIN = re.compile(r'\{"\w+":"[ !#-\[\]-~]*"\}', re.ASCII)


def member(text: str) -> str:
    """The one member of a JSON object in canonical form, with a comma after it; nothing for an object without one."""
    inner = (text if PLAIN.fullmatch(text) else canonical_text(text))[1:-1]
    return inner and inner + ","


@F.pandas_udf(StringType())
def hash_parts(source: pd.Series, stage: pd.Series, tools: pd.Series, params: pd.Series) -> pd.Series:
    """Key of the canonical object of four parts, each JSON text: keys in order are params, source, stage, tools.

    Only what is different among the settings and tools of a batch is parsed; the rest of a row is a text put together.
    """
    heads = {t: member(t) for column in (source, stage) for t in column.unique()}
    inner = {t: canonical_text(t) for column in (tools, params) for t in column.unique()}
    return pd.Series([
        None if inner[p] is None else key_of(f'{{"params":{inner[p]},{heads[s]}{heads[g]}"tools":{inner[t]}}}')
        for s, g, t, p in zip(source, stage, tools, params)
    ], dtype=object)


def cache_key(source: Column, stage: Column, tools: Column, params: Column) -> Column:
    """Key of a stage's result: of its source's fingerprint, its name, the tools' versions (a map) and its settings (JSON text).

    Settings that are no JSON give a null key; null settings or tools count as none.
    """
    alone = lambda x, name: F.to_json(F.struct(x.alias(name)))
    versions = F.to_json(F.coalesce(tools, F.create_map().cast("map<string,string>")))
    return hash_parts(alone(source, "source"), alone(stage, "stage"), versions, F.coalesce(params, F.lit("{}")))


#: What a host's key is made of, in order, with what stands for nothing; groups of flags are written as digits.  Fixed values.
HOST_PIECES = (("cores", "0"), ("ram_mib", "0"), ("arch", "none"), ("vram_mib", "0"), ("driver", "none"), ("ffmpeg", "none"), ("vendor", "none"))
HOST_FLAGS = (
    ("qsv_h264", "qsv_hevc", "qsv_av1"),
    ("amf_h264", "amf_hevc", "amf_av1"),
    ("d3d12_h264", "d3d12_av1"),
    ("vulkan_h264", "vulkan_hevc", "vulkan_av1"),
)


def host_text(flags: Column, encoders: Column) -> Column:
    """The twelve pieces that tell hosts apart, each followed by a bar.

    The plain pieces are read from columns of their names; ``flags`` is a map of what the host can do (what it lacks is off),
    ``encoders`` an array of names in any order.  Empty texts count as none, as nulls do.
    """
    plain = [F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(none)) for c, none in HOST_PIECES]
    has = lambda name: F.when(F.coalesce(F.try_element_at(flags, F.lit(name)), F.lit(False)), "1").otherwise("0")
    digits = [F.concat(*(has(n) for n in group)) for group in HOST_FLAGS]
    names = F.coalesce(F.array_join(F.array_sort(encoders), ","), F.lit(""))
    return F.concat(*(x for piece in [*plain, *digits, names] for x in (piece, F.lit("|"))))


@F.pandas_udf(StringType())
def host_key(text: pd.Series) -> pd.Series:
    """BLAKE2b of 96 bits of a host's text, as hex digits."""
    known = {t: hashlib.blake2b(t.encode(), digest_size=HOST_BYTES).hexdigest() for t in text.dropna().unique()}
    return text.map(known)
