"""Expression strings of ``query`` and ``eval``: Python syntax over column names."""

from __future__ import annotations

import ast
import inspect

from .frame import DataFrame, Series

BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "truediv", ast.FloorDiv: "floordiv", ast.Mod: "mod", ast.Pow: "pow", ast.BitAnd: "and", ast.BitOr: "or", ast.BitXor: "xor"}
COMPARE = {ast.Eq: "eq", ast.NotEq: "ne", ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge"}


def evaluate(frame: DataFrame, text: str):
    """A series, or the frame with assigned columns if the text assigns."""
    outer = {}
    at = inspect.currentframe().f_back.f_back
    if at is not None:
        outer = {**at.f_globals, **at.f_locals}
    for line in filter(None, map(str.strip, text.splitlines())):
        tree = ast.parse(line.replace("@", "__at_"), mode="exec").body[0]
        if isinstance(tree, ast.Assign):
            frame = frame.assign(**{tree.targets[0].id: _value(frame, tree.value, outer)})
        else:
            return _value(frame, tree.value, outer)
    return frame


def _both(name, a, b):
    if isinstance(a, Series):
        return a._binary(name, b)
    return b._binary(name, a, True)


def _value(frame, node, outer):
    go = lambda n: _value(frame, n, outer)
    match node:
        case ast.Constant():
            return node.value
        case ast.Name() if node.id.startswith("__at_"):
            return outer[node.id[5:]]
        case ast.Name():
            return frame[node.id]
        case ast.List() | ast.Tuple():
            return [go(x) for x in node.elts]
        case ast.BinOp():
            a, b = go(node.left), go(node.right)
            return _both(BINARY[type(node.op)], a, b)
        case ast.UnaryOp():
            x = go(node.operand)
            return ~x if isinstance(node.op, (ast.Not, ast.Invert)) else -x
        case ast.BoolOp():
            out = go(node.values[0])
            for v in node.values[1:]:
                out = _both("and" if isinstance(node.op, ast.And) else "or", out, go(v))
            return out
        case ast.Compare():
            left, out = go(node.left), None
            for op, right in zip(node.ops, map(go, node.comparators)):
                if isinstance(op, (ast.In, ast.NotIn)):
                    said = left.isin(right)
                    said = ~said if isinstance(op, ast.NotIn) else said
                else:
                    name = COMPARE[type(op)]
                    flip = {"lt": "gt", "gt": "lt", "le": "ge", "ge": "le"}
                    said = left._binary(name, right) if isinstance(left, Series) else right._binary(flip.get(name, name), left)
                out, left = said if out is None else out & said, right
            return out
        case ast.Attribute():
            return getattr(go(node.value), node.attr)
        case ast.Call():
            return go(node.func)(*map(go, node.args), **{k.arg: go(k.value) for k in node.keywords})
    raise ValueError(f"not allowed in an expression: {ast.dump(node)}")


