"""How datasets are written: compression, checksums, and the digits worth keeping."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = {"zlib": "gzip", "lzo": "snappy", "bzip2": "gzip", "blosc": "snappy", "blosc:lz4": "lz4_raw", "blosc:zstd": "zstd", "blosc:zlib": "gzip", "blosc2": "zstd", "blosc2:zstd": "zstd", "blosc2:lz4": "lz4_raw", "blosc2:zlib": "gzip"}


def quantize(c: Column, digits: int) -> Column:
    """Keeps so many decimal digits: rounds to the next power of two that resolves them, ties to even."""
    scale = float(2 ** math.ceil(math.log2(10**digits)))
    return F.bround(c * scale, 0) / scale


@dataclass
class Filters:
    complevel: int = 0
    complib: str = "zlib"
    shuffle: bool = True
    bitshuffle: bool = False
    fletcher32: bool = False
    least_significant_digit: int | None = None

    def __post_init__(self) -> None:
        if not 0 <= self.complevel <= 9:
            raise ValueError("compression levels are 0 to 9")
        if self.complib not in CODECS:
            raise ValueError(f"a compressor is one of {sorted(CODECS)}")

    @property
    def codec(self) -> str:
        return CODECS[self.complib] if self.complevel else "uncompressed"

    def apply(self, df: DataFrame) -> DataFrame:
        d = self.least_significant_digit
        if d is None:
            return df
        return df.select(*[quantize(F.col(f.name), d).cast(f.dataType).alias(f.name, metadata=f.metadata) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema.fields])

    def copy(self, **changes) -> Filters:
        return Filters(**(vars(self) | changes))
