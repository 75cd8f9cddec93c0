"""Errors of the engine: a name, a numeric code and a message."""

from __future__ import annotations

#: Codes that clients of the wire protocol know.
CODES = {
    "CREATE_DATABASE_ERROR": -2, "CREATE_MEASUREMENT_ERROR": -3, "INVALID_MEASUREMENT": -4, "INVALID_SERIES": -5,
    "NO_SUCH_FIELD": -7, "INCORRECT_WRITE_CHUNK_LEN": -9, "OUT_OF_ORDER_TIMESTAMPS": -10, "TIMESTAMP_OVERWRITE_MISMATCH": -11,
    "FIELD_OVERWRITE_MISMATCH": -12, "BITMAP_OVERWRITE_MISMATCH": -13, "NO_SUCH_SERIES": -17, "NO_SUCH_DATABASE": -18,
    "NO_SUCH_MEASUREMENT": -19, "MEASUREMENT_EXISTS": -20, "DUPLICATE_FIELD": -24, "TOO_MANY_FIELDS": -25,
    "INVALID_CONFIG_FILE": -26, "INVALID_CHUNK_SIZE": -27, "INVALID_NUMBER": -30, "INVALID_FORMULA_CHARACTER": -31,
    "UNEXPECTED_TOKEN": -32, "SHUNT_MISSING_FUNC_ARG": -33, "MISSING_PAREN": -34, "SHUNT_MISSING_OP_ARG": -35,
    "SHUNT_EXTRA_EXPRESSIONS": -36,
}


class EngineError(Exception):
    """`name` is one of CODES, or INVALID_ARGUMENT / INVALID_COMMAND (no code) for what has no code there."""

    def __init__(self, name: str, detail: str = ""):
        super().__init__(f"{name}: {detail}" if detail else name)
        self.name, self.code, self.detail = name, CODES.get(name), detail
