"""SQL names for the text functions: Arrow-batched Python functions on BINARY or STRING columns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..kernels import suffixes


def _bytes(x) -> bytes:
    return x.encode() if isinstance(x, str) else x


def _mapped(kernel, kind: str, arrow: pa.DataType, two: bool = False):
    if two:

        def run(a: pa.Array, b: pa.Array) -> pa.Array:
            return pa.array([None if x is None or y is None else kernel(_bytes(x), _bytes(y)) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], arrow)

    else:

        def run(a: pa.Array) -> pa.Array:
            return pa.array([None if x is None else kernel(_bytes(x)) for x in a.to_pylist()], arrow)

    return F.arrow_udf(run, kind)


def _tandems(text):
    return [{"left": a, "right": b, "period": p} for a, b, p in suffixes.tandems(text)]


def _factors(text):
    return [{"pos": p, "len": n} for p, n in suffixes.factors(text)]


def register_all(spark: SparkSession) -> list[str]:
    """Registers the functions for SQL and gives their names."""
    ints, binary = pa.list_(pa.int32()), pa.binary()
    tandem = pa.list_(pa.struct([("left", pa.int32()), ("right", pa.int32()), ("period", pa.int32())]))
    factor = pa.list_(pa.struct([("pos", pa.int32()), ("len", pa.int32())]))
    functions = {
        "text_suffix_array": _mapped(lambda t: suffixes.suffix_array(t)[0].tolist(), "array<int>", ints),
        "text_lcp_array": _mapped(lambda t: [*suffixes.suffix_array(t)[1].tolist(), 0], "array<int>", ints),
        "text_find": _mapped(suffixes.occurrences, "array<int>", ints, two=True),
        "text_occ": _mapped(lambda t, q: len(suffixes.occurrences(t, q)), "int", pa.int32(), two=True),
        "text_contains": _mapped(lambda t, q: q in t, "boolean", pa.bool_(), two=True),
        "text_min_rotation": _mapped(suffixes.rotation, "binary", binary),
        "text_longest_palindrome": _mapped(suffixes.palindrome, "binary", binary),
        "text_common_substring": _mapped(suffixes.common_substring, "binary", binary, two=True),
        "text_unique_matches": _mapped(suffixes.unique_matches, "array<binary>", pa.list_(binary), two=True),
        "text_tandem_repeats": _mapped(_tandems, "array<struct<left:int,right:int,period:int>>", tandem),
        "text_lz_factors": _mapped(_factors, "array<struct<pos:int,len:int>>", factor),
    }
    for name, function in functions.items():
        spark.udf.register(name, function)
    return sorted(functions)
