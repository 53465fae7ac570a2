"""Sample programs as data: postfix payloads that differ by row, read and run over planes.

A payload has a byte with its version (two highest bits) and width (two lowest), a count of tokens, and the tokens; a constant's
value follows its token in as many bytes as the width says.  Programs are read once for each distinct payload of a task, and each token is
one array operation over all samples of a row's planes, so programs need no plan of their own as ``postfix.compile_program`` does.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Token codes of a constant, of the last input, and of the operators.
CONSTANT, LAST_INPUT = 0, 32
UNARY = {64: "neg", 65: "abs", 66: "not", 67: "bsr"}
BINARY = {128: "sum", 129: "diff", 130: "prod", 131: "quot", 132: "and", 133: "or", 134: "xor", 135: "pow", 136: "min", 137: "max"}


def parse(payload: bytes | None) -> dict:
    """Width, codes, constants, depth and error of a payload: depth is that of the operand stack at most; an error leaves what was read before it."""
    out: dict = {"width": None, "codes": [], "constants": [], "depth": 0, "error": None}
    data = payload or b""
    try:
        if len(data) < 2:
            raise ValueError("a program ends early")
        if data[0] >> 6:
            raise ValueError("another version")
        width = out["width"] = 8 << (data[0] & 3)
        if not data[1]:
            raise ValueError("a program without tokens")
        at, depth, reserved = 2, 0, False
        for _ in range(data[1]):
            if at >= len(data):
                raise ValueError("a program ends early")
            code, value = data[at], 0
            at += 1
            if code == CONSTANT:
                if at + width // 8 > len(data):
                    raise ValueError("a program ends early")
                value = int.from_bytes(data[at : at + width // 8], "big", signed=True)
                at += width // 8
            out["codes"].append(code)
            out["constants"].append(value)
            reserved |= code > LAST_INPUT and code not in UNARY and code not in BINARY
        if at < len(data):
            raise ValueError("bytes after the program")
        if reserved:
            raise ValueError("a reserved token")
        for code in out["codes"]:
            need = 1 if code in UNARY else 2 if code in BINARY else 0
            if depth < need:
                raise ValueError("an operator lacks operands")
            depth += 1 - need
            out["depth"] = max(out["depth"], depth)
        if depth != 1:
            raise ValueError("a program leaves one value")
    except ValueError as e:
        out["error"] = str(e)
    return out


@lru_cache(4096)
def _parsed(payload: bytes | None) -> dict:
    return parse(payload)


def _grow(base: np.ndarray, exponent: np.ndarray, hold) -> np.ndarray:
    """Saturating power: 0 and 1 stay, -1 has the exponent's sign, other bases give 0 for a negative exponent."""
    out, factor, left = np.ones_like(base), base.copy(), np.where(exponent > 63, 62 + exponent % 2, exponent)  # beyond 63 every result is at an end
    for _ in range(6):
        out = np.where(left % 2 == 1, hold(out * factor), out)
        left = left // 2
        factor = hold(factor * factor)
    out = np.where(exponent < 0, 0 * base, out)
    return np.where((base == 0) | (base == 1), base, np.where(base == -1, 1 - 2 * (exponent % 2), out))


def run(program: dict, planes: list[np.ndarray]) -> np.ndarray:
    """The program over samples of the planes, before the clamp to the output's range; ValueError for an input that is not there or is beyond the width."""
    width = program["width"]
    top = (1 << width - 1) - 1
    kind = object if width == 64 else np.int64  # products of 32 bits stay in 64
    hold = lambda v: np.minimum(np.maximum(v, -top - 1), top)
    n = len(planes[0]) if planes else 1
    stack: list[np.ndarray] = []
    for code, value in zip(program["codes"], program["constants"], strict=True):
        if code == CONSTANT:
            stack.append(np.full(n, value, kind))
        elif code <= LAST_INPUT:
            if code > len(planes):
                raise ValueError("an input is not there")
            if planes[code - 1].max(initial=0) > top:
                raise ValueError("an input is beyond the width")
            stack.append(planes[code - 1].astype(kind))
        elif code in UNARY:
            v, name = stack.pop(), UNARY[code]
            if name == "bsr":
                stack.append(np.array([max(int(x), 1).bit_length() - 1 for x in v], kind))
            else:
                stack.append(~v if name == "not" else hold(-v if name == "neg" else abs(v)))
        else:
            b, a = stack.pop(), stack.pop()
            name = BINARY[code]
            if name in ("sum", "diff", "prod"):
                stack.append(hold(a + b if name == "sum" else a - b if name == "diff" else a * b))
            elif name == "quot":
                whole = abs(a) // np.where(b == 0, 1, abs(b))
                stack.append(np.where(b == 0, a, hold(np.where((a < 0) != (b < 0), -whole, whole))))
            elif name == "pow":
                stack.append(_grow(a, b, hold))
            else:
                stack.append({"and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a ^ b, "min": lambda: np.minimum(a, b), "max": lambda: np.maximum(a, b)}[name]())
    return stack[0]


def programs(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with their payloads, as ``parse`` reads them, in a struct ``program``; a null payload ends early."""
    kind = pa.struct([("width", pa.int32()), ("codes", pa.list_(pa.int32())), ("constants", pa.list_(pa.int64())), ("depth", pa.int32()), ("error", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([_parsed(p) for p in batch.column(batch.schema.get_field_index(payload)).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "program"])

    own = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInArrow(read, f"{own}, program struct<width:int,codes:array<int>,constants:array<long>,depth:int,error:string>")


def transform_planes(rows: DataFrame, key: str, planes: Column, low: Column, high: Column, payload: str = "payload") -> DataFrame:
    """(key, plane array<long>, error): each row's program over its input planes (array<array<long>>), clamped to low..high.

    A program that can't be read, an input that is not there, planes of different lengths or a sample beyond the program's width give an error and a null plane.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = [], []
            for data, inputs, a, b in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                try:
                    program = _parsed(data)
                    if program["error"]:
                        raise ValueError(program["error"])
                    own = [np.array(p, np.int64) for p in inputs or []]
                    if len({len(p) for p in own}) > 1:
                        raise ValueError("planes differ in size")
                    out.append(np.minimum(np.maximum(run(program, own), a), b).tolist())
                    errors.append(None)
                except ValueError as e:
                    out.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(errors, pa.string())], names=[key, "plane", "error"])

    kind = dict(rows.dtypes)[key]
    chosen = rows.select(F.col(key), F.col(payload).alias("_payload"), planes.alias("_planes"), low.cast("long").alias("_low"), high.cast("long").alias("_high"))
    return chosen.mapInArrow(work, f"`{key}` {kind}, plane array<long>, error string")
