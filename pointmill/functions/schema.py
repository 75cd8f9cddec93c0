"""Measurement schemas: seven field types, their Spark types, and field resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

from pointmill.errors import EngineError

#: Unsigned 32-bit values live in longs, unsigned 64-bit ones in decimals; range checks guard both.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0), "f32": T.FloatType(),
    "f64": T.DoubleType(), "i32": T.IntegerType(), "i64": T.LongType(),
}
#: Types whose differences wrap, and their modulus.
UNSIGNED = {"bool": 2**8, "u32": 2**32, "u64": 2**64}
RANGES = {"u32": (0, 2**32 - 1), "u64": (0, 2**64 - 1)}
LARGEST = {"bool": 1, "u32": 2**32 - 1, "u64": 2**64 - 1, "f32": float("inf"), "f64": float("inf"), "i32": 2**31 - 1, "i64": 2**63 - 1}
SMALLEST = {"bool": 0, "u32": 0, "u64": 0, "f32": float("-inf"), "f64": float("-inf"), "i32": -(2**31), "i64": -(2**63)}
MOST_FIELDS, LONGEST_NAME = 64, 123


def check_component(name: str, error: str) -> str:
    """A database, measurement or series name is one path component."""
    if not name or name in (".", "..") or any(c in name for c in "/\\ \t\n") or name.startswith("_"):
        raise EngineError(error, repr(name))
    return name


@dataclass(frozen=True)
class MeasurementSchema:
    fields: tuple[tuple[str, str], ...]

    def __post_init__(self):
        if not 1 <= len(self.fields) <= MOST_FIELDS:
            raise EngineError("TOO_MANY_FIELDS", str(len(self.fields)))
        names = [n for n, _ in self.fields]
        for name, kind in self.fields:
            if kind not in SPARK_TYPES:
                raise EngineError("INVALID_MEASUREMENT", f"unknown type {kind!r}")
            if not name or len(name.encode()) > LONGEST_NAME or name in ("time_ns", "series"):
                raise EngineError("INVALID_MEASUREMENT", f"bad field name {name!r}")
        if len(set(names)) != len(names):
            raise EngineError("DUPLICATE_FIELD")

    @classmethod
    def parse(cls, text: str) -> "MeasurementSchema":
        """From `a/f64,b/u32`."""
        out = []
        for part in text.split(","):
            name, slash, kind = part.strip().rpartition("/")
            if not slash:
                raise EngineError("INVALID_MEASUREMENT", f"{part!r} is not name/type")
            out.append((name, kind))
        return cls(tuple(out))

    @classmethod
    def of(cls, df) -> "MeasurementSchema":
        """Schema of a frame in canonical shape, by metadata where a column has it, else by Spark type."""
        guess = {"boolean": "bool", "float": "f32", "double": "f64", "int": "i32", "bigint": "i64", "decimal(20,0)": "u64"}
        fields = []
        for f in df.schema:
            if f.name not in ("series", "time_ns"):
                kind = (f.metadata or {}).get("kind") or guess.get(f.dataType.simpleString())
                if kind is None:
                    raise EngineError("INVALID_MEASUREMENT", f"{f.name}: {f.dataType.simpleString()}")
                fields.append((f.name, kind))
        return cls(tuple(fields))

    def __str__(self) -> str:
        return ",".join(f"{n}/{k}" for n, k in self.fields)

    @property
    def kinds(self) -> dict[str, str]:
        return dict(self.fields)

    def struct(self) -> T.StructType:
        """Canonical shape: series, time_ns, then the fields, whose type names are kept as metadata."""
        head = [T.StructField("series", T.StringType(), False), T.StructField("time_ns", T.LongType(), False)]
        return T.StructType(head + [T.StructField(n, SPARK_TYPES[k], True, {"kind": k}) for n, k in self.fields])

    def resolve(self, fields: list[str] | tuple[str, ...]) -> list[str]:
        """["*"]: all, in schema order; []: none; else the named ones, in the order asked for."""
        fields = list(fields)
        if fields == ["*"]:
            return [n for n, _ in self.fields]
        seen: set[str] = set()
        for f in fields:
            if f not in self.kinds:
                raise EngineError("NO_SUCH_FIELD", f)
            if f in seen:
                raise EngineError("DUPLICATE_FIELD", f)
            seen.add(f)
        return fields
