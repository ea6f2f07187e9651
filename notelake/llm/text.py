"""What the operators share: small Arrow batches, words of UTF-8 bytes as hashes, shared scratch tables.

Words are ``[^\\x20\\x09-\\x0D]+``; as those blanks are ASCII, words can be cut on UTF-8 bytes. A word's hash is 64 bits
wide and depends on its bytes only; two different words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from notelake.sources.scratch import folder as shared_folder, written  # noqa: F401  for the other modules here

#: Bytes of text that one numpy step looks at; longer texts go piece by piece, cut between words.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_powers: dict[str, np.ndarray] = {}


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once: at most 512 rows, and about 8 MB, an Arrow batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def map_batches(df: DataFrame, schema: str, make) -> DataFrame:
    """``make()`` runs once a task and gives ``f(*arrow columns) -> columns``, which is applied to each Arrow batch."""
    small_batches(df.sparkSession)
    struct: StructType = _parse_datatype_string(schema)

    def run(batches):
        f, arrow = make(), to_arrow_schema(struct)
        for batch in batches:
            if batch.num_rows:
                columns = f(*batch.columns)
                arrays = [c if isinstance(c, pa.Array) and c.type == field.type else pa.array(c, field.type) for c, field in zip(columns, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; a null is an empty text."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            out = np.full(max(n, 1 << 12), base, np.uint64)
            out[0] = 1
            have = _powers[str(base)] = np.cumprod(out)
    return have[:n]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(text: bytes, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word in order; ``lower`` takes A-Z for a-z first."""
    text = text.translate(_LOWER) if lower else text
    out, at = [], 0
    while at < len(text):
        to = at + PIECE
        if to < len(text):
            cut = [x for c in b" \n\t\r\v\f" if (x := text.find(c, to, to + PIECE)) >= 0]
            while not cut and to < len(text):
                to += PIECE
                cut = [x for c in b" \n\t\r\v\f" if (x := text.find(c, to, to + PIECE)) >= 0]
            to = min(cut, default=len(text))
        data = np.frombuffer(text, np.uint8, min(to, len(text)) - at, at)
        starts, ends = word_bounds(data)
        if len(starts):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
            out.append(mixed((sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts]))
        at = to
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` words; empty with fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j, k in enumerate(powers(0xD6E8FEB86659FD93, width + 1)[1:]):
        total += words[j : j + n] * k
    return mixed(total)


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))
