"""Configured arithmetic as Columns."""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnsafeExpression(ValueError):
    """The text is not plain arithmetic over known columns."""


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Pow: F.pow}


def compile_expression(text: str, columns: list[str]) -> Column:
    """Names, numbers, + - * / // ** and parentheses; division by zero is null. Calls, attributes and anything else are refused."""
    try:
        tree = ast.parse(text.strip(), mode="eval").body
    except SyntaxError as e:
        raise UnsafeExpression(text) from e

    def build(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp):
            left, right = build(node.left), build(node.right)
            if isinstance(node.op, ast.Div):
                return F.try_divide(left.cast("double"), right.cast("double"))
            if isinstance(node.op, ast.FloorDiv):
                return F.floor(F.try_divide(left.cast("double"), right.cast("double")))
            if type(node.op) in _BINARY:
                return _BINARY[type(node.op)](left, right)
        elif isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        elif isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(node.value)
        elif isinstance(node, ast.Name) and node.id in columns:
            return F.col(node.id)
        raise UnsafeExpression(f"{text}: {ast.dump(node)}")

    return build(tree)
