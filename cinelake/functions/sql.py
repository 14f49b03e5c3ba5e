"""The library's functions under SQL names (X06): expressions, vectorised functions, and a table function.

Expressions are registered as SQL functions, which Catalyst puts in the place of their calls, so they cost what the
written-out expression costs.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from cinelake.functions import canonical

#: (name and arguments, type, body).
EXPRESSIONS = (
    ("media_half_up(x DOUBLE)", "BIGINT", "CAST(floor(x + 0.5D) AS BIGINT)"),
    ("media_half_even(x DOUBLE)", "BIGINT", "CAST(rint(x) AS BIGINT)"),
    ("media_frames(num BIGINT, den BIGINT, seconds DOUBLE)", "BIGINT", "CAST(floor(CAST(num AS DOUBLE) / den * seconds + 0.5D) AS BIGINT)"),
    ("media_ntsc_drop(num BIGINT, den BIGINT)", "BOOLEAN", "den = 1001 AND num % 1000 = 0"),
    ("media_frame_name(n BIGINT)", "STRING", "concat(lpad(CAST(n AS STRING), 8, '0'), '.png')"),
)


class Pack:
    """``pack_items(most, TABLE(items) PARTITION BY source_id ORDER BY item)``: each item with its pack.

    ``items`` has columns source_id, item and size.  A pack takes items in order while their sizes fit ``most``, one at
    least; a null size counts as 0.  Items stream by, so a source of any length is held in two numbers.
    """

    def __init__(self) -> None:
        self.pack, self.used = 0, 0

    def eval(self, most: int, row: Row) -> Iterator[tuple]:
        size = row["size"] or 0
        if self.used > 0 and self.used + size > most:
            self.pack, self.used = self.pack + 1, 0
        self.used += size
        yield row["source_id"], row["item"], self.pack


def register(spark: SparkSession) -> None:
    """Put all functions into a session; doing so again is harmless."""
    for head, kind, body in EXPRESSIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for name, function in (("media_hash_json", canonical.hash_json), ("media_hash_text", canonical.hash_text), ("media_canonical_json", canonical.canonical_json)):
        spark.udf.register(name, function)
    spark.udtf.register("pack_items", F.udtf(Pack, returnType="source_id string, item long, pack long"))
