"""Arrow scalar functions over payloads: the frame that byte-level operators share. No shuffle; columns stay pruned.

Only the value goes to Python and only the report comes back; the other columns stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

KEYS = ("source", "payload_id")
#: Python objects are made for so many bytes and rows at a time; beyond that a batch is held in Arrow only.
SLICE_BYTES, SLICE_ROWS = 1 << 18, 1024


def slices(values: pa.Array) -> Iterator[list]:
    """The values in runs of about SLICE_BYTES and of SLICE_ROWS at most, a longer one by itself."""
    held, size = [], 0
    for x in values:
        x = x.as_py()
        more = len(x) if isinstance(x, (str, bytes)) else 1
        if held and (size + more > SLICE_BYTES or len(held) == SLICE_ROWS):
            yield held
            held, size = [], 0
        held.append(x)
        size += more
    yield held


def made_of(value: Column, fields: str, make: Callable[[object], tuple]) -> Column:
    """A struct of the fields that make(value) gives; null for null. Texts that repeat in a batch are made once."""
    kinds = T._parse_datatype_string(fields)
    names, arrow = kinds.names, [to_arrow_type(f.dataType) for f in kinds]
    empty = (None,) * len(names)

    def part(some: list) -> pa.Array:
        columns = list(zip(*(empty if x is None else make(x) for x in some), strict=True)) or [()] * len(names)
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, arrow, strict=True)], names, mask=pa.array([x is None for x in some], pa.bool_()))

    def run(values: pa.Array) -> pa.Array:
        if pa.types.is_string(values.type) or pa.types.is_binary(values.type):
            coded = values.dictionary_encode()
            if 2 * len(coded.dictionary) < len(values):
                return pa.concat_arrays([part(some) for some in slices(coded.dictionary)]).take(coded.indices)
        return pa.concat_arrays([part(some) for some in slices(values)])

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, kinds)(value)


def per_payload(df: DataFrame, value: Column, fields: str, make: Callable[[object], tuple], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys and the fields that make(value) gives for each row; a null value gives null fields."""
    return df.select(*keys, made_of(value, fields, make).alias("made")).select(*keys, "made.*")


def zipped(df: DataFrame, value: Column, fields: str, make: Callable[[object], tuple], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row for each place of the arrays that make(value) gives, one array a field; null and empty give none."""
    names = [f.split()[0] for f in fields.split(", ")]
    arrays = ", ".join(f"{n} array<{f.split()[1]}>" for n, f in zip(names, fields.split(", "), strict=True))
    made = df.select(*keys, made_of(value, arrays, make).alias("made"))
    return made.select(*keys, F.inline(F.arrays_zip(*[F.col("made")[n].alias(n) for n in names]))).toDF(*keys, *names)


def round_all(x: np.ndarray, digits: int) -> list[float]:
    """round(v, digits) of each: by numpy, but for what is close to a tie."""
    scaled = x * 10**digits
    out = np.rint(scaled) / 10**digits + 0.0
    for i in np.flatnonzero(np.abs(np.abs(scaled - np.floor(scaled)) - 0.5) < 1e-6):
        out[i] = round(float(x[i]), digits) + 0.0
    return out.tolist()
