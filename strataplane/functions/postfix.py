"""Per-sample postfix programs compiled to one column expression.

A program is a list of tokens: ``("in", i)`` pushes an input, ``("const", v)``
a constant, and a name applies an operator.  Each step saturates to the signed
width; the result is clamped to the output range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataplane.functions.integers import bit_scan, clip, div, lit64, power, saturate, wide

UNARY = ("neg", "abs", "not", "bsr")
BINARY = ("sum", "diff", "prod", "quot", "and", "or", "xor", "pow", "min", "max")
WIDTHS = (8, 16, 32, 64)


def validate(program: list, inputs: int, bits: int) -> None:
    """Raises ValueError unless the program leaves one value and its inputs, constants and width are in range."""
    if bits not in WIDTHS:
        raise ValueError(f"width {bits} is not one of {WIDTHS}")
    depth = 0
    for token in program:
        if isinstance(token, tuple):
            kind, value = token
            if kind == "in" and not 0 <= value < inputs:
                raise ValueError(f"there is no input {value}")
            if kind == "const" and not -(1 << bits - 1) <= value < 1 << bits - 1:
                raise ValueError(f"constant {value} is not of {bits} bits")
            depth += 1
        else:
            need = 1 if token in UNARY else 2 if token in BINARY else 0
            if not need:
                raise ValueError(f"unknown operator {token}")
            if depth < need:
                raise ValueError("an operator lacks operands")
            depth -= need - 1
    if depth != 1:
        raise ValueError("a program leaves one value")


def apply_unary(name: str, v: Column, bits: int) -> Column:
    if name == "neg":
        return saturate(-wide(v), bits)
    if name == "abs":
        return saturate(F.abs(wide(v)), bits)
    return F.bitwise_not(v) if name == "not" else bit_scan(v)


def apply_binary(name: str, a: Column, b: Column, bits: int) -> Column:
    if name in ("sum", "diff", "prod"):
        x, y = wide(a), wide(b)
        return saturate({"sum": x + y, "diff": x - y, "prod": (x * y).cast("decimal(38,0)")}[name], bits)
    if name == "quot":
        low = -(1 << bits - 1)
        return F.when(b == 0, a).when((a == lit64(low)) & (b == -1), lit64(-low - 1)).otherwise(_safe_div(a, b))
    if name == "pow":
        return power(a, b, bits)
    return {"and": a.bitwiseAND(b), "or": a.bitwiseOR(b), "xor": a.bitwiseXOR(b), "min": F.least(a, b), "max": F.greatest(a, b)}[name]


def _safe_div(a: Column, b: Column) -> Column:
    """Truncating division whose divisor is never 0, as both branches of a condition may be evaluated."""
    return div(a, F.when(b == 0, lit64(1)).otherwise(b))


def compile_program(program: list, inputs: list[Column], bits: int, low: int, high: int) -> Column:
    """The program as a column over bigint inputs; null inputs give null."""
    validate(program, len(inputs), bits)
    stack: list[Column] = []
    for token in program:
        if isinstance(token, tuple):
            stack.append(inputs[token[1]] if token[0] == "in" else lit64(token[1]))
        elif token in UNARY:
            stack.append(apply_unary(token, stack.pop(), bits))
        else:
            b, a = stack.pop(), stack.pop()
            stack.append(apply_binary(token, a, b, bits))
    return clip(stack[0], low, high)
