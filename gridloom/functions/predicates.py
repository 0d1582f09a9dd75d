"""Filter strings in the data-frame query notation, as Columns: comparisons, and/or/not, & | ~, in, isin, between, arithmetic.

`x != y` is true where one side is null; ordered comparisons with null are false.
"""

from __future__ import annotations

import ast
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDER = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_MATH = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}


def to_column(text: str, columns: list[str]) -> Column:
    """ValueError if the text is no filter, or names a column that is not there."""
    try:
        tree = ast.parse(text.strip().replace("`", ""), mode="eval")
    except SyntaxError as e:
        raise ValueError(f"not a filter: {text!r}") from e

    def literal(node):
        try:
            return ast.literal_eval(node)
        except ValueError as e:
            raise ValueError(f"not a literal in {text!r}") from e

    def value(node) -> Column:
        if isinstance(node, ast.Name):
            if node.id not in columns:
                raise ValueError(f"no column {node.id!r}")
            return F.col(node.id)
        if isinstance(node, ast.Constant):
            return F.lit(node.value)
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -value(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in _MATH:
            return _MATH[type(node.op)](value(node.left), value(node.right))
        return test(node)

    def compare(left, op, right) -> Column:
        if isinstance(op, (ast.In, ast.NotIn)):
            own = F.coalesce(value(left).isin(list(literal(right))), F.lit(False))
            return own if isinstance(op, ast.In) else ~own
        if isinstance(op, ast.Eq):
            return F.coalesce(value(left) == value(right), F.lit(False))
        if isinstance(op, ast.NotEq):
            return ~F.coalesce(value(left) == value(right), F.lit(False))
        if type(op) in _ORDER:
            return F.coalesce(_ORDER[type(op)](value(left), value(right)), F.lit(False))
        raise ValueError(f"not understood: {text!r}")

    def test(node) -> Column:
        if isinstance(node, ast.BoolOp):
            out = test(node.values[0])
            for v in node.values[1:]:
                out = out & test(v) if isinstance(node.op, ast.And) else out | test(v)
            return out
        if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
            a, b = test(node.left), test(node.right)
            return a & b if isinstance(node.op, ast.BitAnd) else a | b
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.Not, ast.Invert)):
            return ~test(node.operand)
        if isinstance(node, ast.Compare):
            ends, out = [node.left, *node.comparators], None
            for a, op, b in zip(ends, node.ops, ends[1:]):
                one = compare(a, op, b)
                out = one if out is None else out & one
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
            own, args = value(node.func.value), node.args
            if node.func.attr == "isin":
                return F.coalesce(own.isin(list(literal(args[0]))), F.lit(False))
            if node.func.attr == "between":
                return F.coalesce(own.between(literal(args[0]), literal(args[1])), F.lit(False))
            if node.func.attr in ("isna", "isnull"):
                return own.isNull()
            if node.func.attr in ("notna", "notnull"):
                return own.isNotNull()
        if isinstance(node, (ast.Name, ast.Constant)):
            return value(node)
        raise ValueError(f"not understood: {text!r}")

    return test(tree.body)
