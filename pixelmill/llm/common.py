"""What the text operators share: word rules, tables, shipping code to executors."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: the white space that parts words, as a Java pattern
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
# bytes.split() parts at exactly 0x20 and 0x09-0x0D, so this table only lower-cases A-Z
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ship(module: str) -> None:
    """Send a module's functions to executors by value, so they need no installed copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expression once inside a projection: a one-element transform keeps it from being inlined."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text (null: none), parted at ASCII white space."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN), "")


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-made table as a JSON literal; its size must be bounded by parameters."""
    import json

    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def keep_columns(df: DataFrame, made: list[str]) -> DataFrame:
    """Drop input columns whose names an operator is about to make: its own columns win."""
    clash = {m.lower() for m in made}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash])


def added(schema: T.StructType, fields: str) -> T.StructType:
    return T.StructType([*schema.fields, *T.StructType.fromDDL(fields).fields])


def hash_sample(df: DataFrame, rows: int, most: int, ties: list[str]) -> DataFrame:
    """The ``most`` rows of ``df`` with the least ``_h``, a 64-bit hash; ``rows`` is about how many there are.

    Hashes are spread evenly, so all others but a few are filtered out before rows meet for the sort.
    """
    share = F.col("_h") / float(1 << 64) + 0.5
    return df.where(share * rows <= 1.5 * most + 50).orderBy("_h", *ties).limit(most)


BITS = 1 << 25  # of a set of ids that tasks know: 4 MB, however many ids there are
_BITMAP = 4096  # bytes of Spark's bitmaps


def id_bits(ids: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """A bitmap of ``ids``, which are hashes, to keep most other rows in the scan; an exact join follows it."""
    place = F.pmod(F.col(key), F.lit(bits))
    made = ids.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((bits // (8 * _BITMAP) + 2, _BITMAP), np.uint8)
    for r in made.collect():  # of one size, set by ``bits``
        out[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def has_bit(table: np.ndarray, ids: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which ids ``id_bits`` may hold. Spark's bitmaps number from 1: bucket 1 starts with value 1, value 0 is alone."""
    at = ids % bits
    at = np.where(at > 0, at + (8 * _BITMAP - 1), 0)
    return (table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
