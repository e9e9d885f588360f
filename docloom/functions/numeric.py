"""Numbers, units and arithmetic as Column expressions."""

from __future__ import annotations

import ast
import math
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import col, literal_map

# Units of the simple scale map, with category and factor.
UNIT_CATEGORY = {
    "v": "voltage", "volt": "voltage", "volts": "voltage", "mv": "voltage", "kv": "voltage", "mm": "length", "cm": "length", "m": "length", "inch": "length", "in": "length",
    "°c": "temp", "c": "temp", "degc": "temp", "k": "temp", "w": "power", "mw": "power", "kw": "power", "hz": "freq", "khz": "freq", "mhz": "freq", "ghz": "freq", "gb": "memory", "tb": "memory", "mb": "memory",
}
UNIT_SCALE = {
    "v": 1.0, "volt": 1.0, "volts": 1.0, "mv": 1e-3, "kv": 1e3, "mm": 1e-3, "cm": 1e-2, "m": 1.0, "inch": 0.0254, "in": 0.0254,
    "°c": 1.0, "c": 1.0, "degc": 1.0, "k": 1.0, "w": 1.0, "mw": 1e-3, "kw": 1e3, "hz": 1.0, "khz": 1e3, "mhz": 1e6, "ghz": 1e9, "gb": 1.0, "tb": 1024.0, "mb": 1 / 1024,
}
_VALUE = r"^([+-]?[0-9]+(?:\.[0-9]+)?)[ \t]*([a-zA-Z°μµ%]+)?$"
_PREDICATE = r"([><]=?|=)[ \t\n]*([0-9]+(?:\.[0-9]+)?)[ \t\n]*([a-zA-Z°μµ%]+)?"


def unit_value(c: Column | str) -> Column:
    """struct(base_value, category) of an anchored number with a unit; case is ignored and scales carry no offset."""
    t = F.trim(col(c))
    value, unit = F.regexp_extract(t, _VALUE, 1), F.lower(F.regexp_extract(t, _VALUE, 2))
    number = F.when(value != "", value.try_cast("double"))
    scale, category = literal_map(UNIT_SCALE)[unit], literal_map(UNIT_CATEGORY)[unit]
    return F.struct((number * F.coalesce(scale, F.lit(1.0))).alias("base_value"), F.when(number.isNotNull(), F.when(unit == "", "dimensionless").otherwise(F.coalesce(category, unit))).alias("category"))


@F.pandas_udf(T.StringType())
def unit_string(texts: pd.Series) -> pd.Series:
    """normal form of an anchored number with a unit, the number to four significant digits; other texts in lower case."""
    out = []
    for t in texts:
        m = re.match(_VALUE, t.strip()) if t is not None else None
        out.append(None if t is None else f"{float(m[1]):.4g} {m[2].lower()}" if m and m[2] else f"{float(m[1]):.4g}" if m else t.strip().lower())
    return pd.Series(out, dtype="object")


def predicate(c: Column | str) -> Column:
    """P5: struct(op, target, category) of the first comparison in a query; null fields without one."""
    t = col(c)
    op, value, unit = (F.regexp_extract(t, _PREDICATE, k) for k in (1, 2, 3))
    low = F.lower(unit)
    known = literal_map(UNIT_SCALE)[low]
    return F.struct(F.nullif(op, F.lit("")).alias("op"), (value.try_cast("double") * F.coalesce(known, F.lit(1.0))).alias("target"), literal_map(UNIT_CATEGORY)[low].alias("category"))


def compare(op: Column, left: Column, right: Column) -> Column:
    """The comparison named by ``op``; false for an unknown one."""
    return F.when(op == ">", left > right).when(op == ">=", left >= right).when(op == "<", left < right).when(op == "<=", left <= right).when(op == "=", left == right).otherwise(False)


def money(c: Column | str) -> Column:
    """a number with parentheses or a leading minus as negative; currency, commas, blanks and percent are dropped."""
    t = F.trim(col(c))
    inner = F.regexp_extract(t, r"\(([0-9,.]+)\)", 1)
    negative = (inner != "") | t.startswith("-")
    bare = F.regexp_replace(F.when(inner != "", inner).when(t.startswith("-"), F.substring(t, 2, 1_000_000)).otherwise(t), r"[$,% \t\n]", "")
    number = F.when(bare.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), bare.try_cast("double"))
    return F.when(negative, -number).otherwise(number)


def numbers(c: Column | str) -> Column:
    """all numbers of a text, with or without parentheses, in order."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(\(?(?<![A-Za-z0-9_])[0-9](?:[0-9,.]*[0-9])?(?![A-Za-z0-9_])\)?)"), 1)
    return F.filter(F.transform(found, money), lambda n: n.isNotNull())


def operation(c: Column | str) -> Column:
    """taxonomy of a derivation by its signs and brackets."""
    d = F.trim(F.coalesce(col(c), F.lit("")))
    plus, minus, slash = d.contains("+"), d.contains("-"), d.contains("/")
    grouped = (plus | minus) & slash & (d.contains("(") | d.contains("["))
    return (
        F.when(d == "", "UNKNOWN")
        .when(grouped & d.rlike(r"/[ ]*[0-9]+\b"), "AVERAGE")
        .when(grouped & minus, "PERCENTAGE_CHANGE")
        .when(grouped, "MULTI_STEP")
        .when(plus, "SUM")
        .when(minus, "DIFFERENCE")
        .when(slash, "RATIO")
        .otherwise("OTHER")
    )


def derive(values: Column, op: Column) -> Column:
    """SUM, DIFFERENCE, AVERAGE, RATIO or PERCENTAGE_CHANGE of an array of numbers; null where it has too few or divides by zero."""
    n = F.size(values)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    first, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
    return (
        F.when(n == 0, F.lit(None).cast("double"))
        .when(op == "SUM", total)
        .when(op == "AVERAGE", total / n)
        .when((op == "DIFFERENCE") & (n >= 2), first - second)
        .when((op == "RATIO") & (n >= 2), first / F.nullif(second, F.lit(0.0)))
        .when((op == "PERCENTAGE_CHANGE") & (n >= 2), (first - second) / F.nullif(second, F.lit(0.0)) * 100)
    )


def numeric_match(pred: Column, gold: Column) -> Column:
    """within 0.01, or 0.1 % of the larger of the gold value and 1, as is or scaled by 100 either way."""
    near = lambda p: (F.abs(p - gold) <= 0.01) | (F.abs(p - gold) / F.greatest(F.abs(gold), F.lit(1.0)) <= 0.001)
    return F.coalesce(near(pred) | near(pred * 100) | near(pred / 100), F.lit(False))


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluate(expression: str | None) -> float | None:
    """value of an arithmetic expression of numbers, + - * / and brackets; None if it is anything else or divides by zero."""
    if not expression or len(expression) > 2000:
        return None
    text = expression.translate(str.maketrans("[]{}×÷", "()()*/"))
    text = re.sub(r"(?<=\d),(?=\d{3})", "", text)

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return float(node.value)
        if isinstance(node, ast.BinOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _OPS:
            return _OPS[type(node.op)](value(node.operand))
        raise ValueError(node)

    try:
        return value(ast.parse(text.strip(), mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, OverflowError, RecursionError, MemoryError):
        return None


@F.pandas_udf(T.DoubleType())
def evaluate_expression(expressions: pd.Series) -> pd.Series:
    return expressions.map(evaluate).astype("float64")


#: Node types of the arithmetic programs that may run; anything else is unsafe.
SAFE_NODES = (ast.Module, ast.Expression, ast.Assign, ast.Expr, ast.Name, ast.Load, ast.Store, ast.BinOp, ast.UnaryOp, ast.Constant, ast.Call, ast.List, ast.Tuple, ast.operator, ast.unaryop, ast.keyword)
SAFE_CALLS = {"abs": abs, "round": round, "min": min, "max": max, "sum": sum, "len": len, "float": float, "int": int}


def program_fault(code: str | None) -> str | None:
    """why a generated program is refused, or null: it has to be assignments of plain arithmetic and of SAFE_CALLS to names."""
    try:
        tree = ast.parse(code or "")
    except (SyntaxError, ValueError, RecursionError):
        return "does not parse"
    for node in ast.walk(tree):
        if not isinstance(node, SAFE_NODES):
            return f"{type(node).__name__} is not allowed"
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in SAFE_CALLS):
            return "call is not allowed"
        if isinstance(node, ast.Name) and node.id.startswith("__"):
            return "name is not allowed"
    return None


def run_program(code: str | None, most_bits: int = 4096) -> float | None:
    """the number bound to ``result`` by a program that passes ``program_fault``; evaluated node by node, never executed.

    No result, a division by zero, an unknown name or a power beyond ``most_bits`` gives null.
    """
    if program_fault(code):
        return None
    names: dict[str, object] = {}

    def value(node):
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return node.value
        if isinstance(node, ast.Name):
            return names[node.id]
        if isinstance(node, (ast.List, ast.Tuple)):
            return [value(e) for e in node.elts]
        if isinstance(node, ast.UnaryOp):
            return _OPS[type(node.op)](value(node.operand))
        if isinstance(node, ast.Call):
            return SAFE_CALLS[node.func.id](*map(value, node.args))
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow):
                if abs(b) * max(1, math.log2(abs(a) + 1)) > most_bits:
                    raise OverflowError
                return a**b
            return _OPS[type(node.op)](a, b)
        raise KeyError(type(node))

    try:
        for line in ast.parse(code).body:
            if isinstance(line, ast.Assign) and len(line.targets) == 1 and isinstance(line.targets[0], ast.Name):
                names[line.targets[0].id] = value(line.value)
        return float(names["result"])
    except (KeyError, ZeroDivisionError, OverflowError, TypeError, ValueError):
        return None


@F.pandas_udf(T.DoubleType())
def program_result(codes: pd.Series) -> pd.Series:
    return pd.Series([run_program(c) for c in codes], dtype="float64")
