"""Text templates of task configs as columns.

Inside {{ }} the templates' expression language is, but for a few words, that of Python: so Python's own grammar reads it, and the
nodes that say something about a row become Spark expressions: names, constants, lists, attributes and items, string methods,
filters behind a bar, comparisons, and/or/not, and `a if c else b`. What isn't understood is an error, never text: statements
({% %}), other calls, a name that is no column, a brace without its partner.

A missing value is null, and a text with a null place is null.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.scalars import strip

PLACE = re.compile(r"\{\{(.*?)\}\}", re.S)
LONE = re.compile(r"\{\{|\}\}|\{%|%\}|\{#|#\}")


def _text(value: Column) -> Column:
    return value.cast("string")


def _ends(side: str) -> Callable[..., Column]:
    """Python's lstrip and rstrip: white space of any kind, or any of the given characters."""

    def cut(value: Column, chars: str | None = None) -> Column:
        said = r"\s+" if chars is None else "[" + "".join(re.escape(c) for c in chars) + "]+"
        return F.regexp_replace(value, f"(?U)^{said}" if side == "l" else f"(?U){said}$", "")

    return cut


#: String methods and filters: what they make of a value and constants.
METHODS: dict[str, Callable[..., Column]] = {
    "strip": lambda v, chars=None: strip(v) if chars is None else _ends("r")(_ends("l")(v, chars), chars),
    "lstrip": _ends("l"),
    "rstrip": _ends("r"),
    "lower": lambda v: F.lower(v),
    "upper": lambda v: F.upper(v),
    "capitalize": lambda v: F.concat(F.upper(F.substring(v, 1, 1)), F.lower(F.substr(v, F.lit(2)))),
    "replace": lambda v, a, b: F.replace(v, F.lit(a), F.lit(b)),
    "startswith": lambda v, a: F.startswith(v, F.lit(a)),
    "endswith": lambda v, a: F.endswith(v, F.lit(a)),
    "split": lambda v, a: F.split(v, re.escape(a)),
}
FILTERS: dict[str, Callable[..., Column]] = {
    "trim": METHODS["strip"],
    "lower": METHODS["lower"],
    "upper": METHODS["upper"],
    "capitalize": METHODS["capitalize"],
    "replace": METHODS["replace"],
    "string": _text,
    "int": lambda v: v.try_cast("long"),
    "first": lambda v: F.get(v, F.lit(0)),
    "last": lambda v: F.try_element_at(v, F.lit(-1)),
    "join": lambda v, a="": F.array_join(v.cast("array<string>"), a),
    "count": lambda v: F.size(v),
    "default": lambda v, a: F.coalesce(v, F.lit(a)),
}
COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


class NotUnderstood(ValueError):
    pass


def _constants(call: ast.Call) -> list:
    if call.keywords or not all(isinstance(a, ast.Constant) for a in call.args):
        raise NotUnderstood("a call with something other than constants")
    return [a.value for a in call.args]


def _apply(known: dict, name: str, value: Column, args: list) -> Column:
    if name not in known:
        raise NotUnderstood(f"{name!r}; there are {sorted(known)}")
    try:
        return known[name](value, *args)
    except TypeError as e:
        raise NotUnderstood(f"{name!r} with {len(args)} arguments") from e


def _column(node: ast.expr, columns: list[str]) -> Column:
    of = lambda n: _column(n, columns)
    match node:
        case ast.Name(id=name):
            if name in ("true", "false", "none"):
                return F.lit({"true": True, "false": False, "none": None}[name])
            if name not in columns:
                raise NotUnderstood(f"no column {name!r}; there are {columns}")
            return F.col(f"`{name}`")
        case ast.Constant(value=bool() | int() | float() | str() | None):
            return F.lit(node.value)
        case ast.List(elts=items) | ast.Tuple(elts=items) if items:
            return F.array(*[_text(of(x)) for x in items])  # what a list is for here are texts
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=int() | float())):
            return F.lit(-node.operand.value)
        case ast.UnaryOp(op=ast.Not(), operand=x):
            return ~of(x)
        case ast.BoolOp(op=op, values=values):
            out = of(values[0])
            for v in values[1:]:
                out = out & of(v) if isinstance(op, ast.And) else out | of(v)
            return out
        case ast.Compare(left=left, ops=[op], comparators=[right]):
            if isinstance(op, ast.In | ast.NotIn):
                found = F.array_contains(of(right), _text(of(left)) if isinstance(right, ast.List | ast.Tuple) else of(left)) if not isinstance(right, ast.Constant) else F.contains(of(right), of(left))
                return found if isinstance(op, ast.In) else ~found
            if type(op) in COMPARE:
                return COMPARE[type(op)](of(left), of(right))
        case ast.IfExp(test=test, body=body, orelse=other):
            same = _is_constant(body) == _is_constant(other)  # a column's type isn't known here: beside a constant it is text
            how = (lambda x: x) if same else _text
            return F.when(of(test), how(of(body))).otherwise(how(of(other)))
        case ast.Subscript(value=value, slice=ast.Constant(value=str() as key)):
            return of(value)[key]
        case ast.Subscript(value=value, slice=at):
            place = at.operand.value if isinstance(at, ast.UnaryOp) and isinstance(at.op, ast.USub) and isinstance(at.operand, ast.Constant) else None
            return F.try_element_at(of(value), F.lit(-place)) if place is not None else F.get(of(value), of(at))
        case ast.Call(func=ast.Attribute(value=value, attr=name)):
            return _apply(METHODS, name, of(value), _constants(node))
        case ast.Attribute(value=value, attr=name):
            return of(value)[name]
        # a filter binds more tightly there than a bar does here: behind a sum it isn't clear what it is of
        case ast.BinOp(left=ast.BinOp(op=ast.Add()) | ast.UnaryOp(), op=ast.BitOr()):
            raise NotUnderstood(f"a filter behind a sum or a sign: {ast.unparse(node)}")
        case ast.BinOp(left=left, op=ast.BitOr(), right=ast.Name(id=name)):
            return _apply(FILTERS, name, of(left), [])
        case ast.BinOp(left=left, op=ast.BitOr(), right=ast.Call(func=ast.Name(id=name)) as call):
            return _apply(FILTERS, name, of(left), _constants(call))
        case ast.BinOp(left=left, op=ast.Add(), right=right) if _is_text(left) or _is_text(right):
            return F.concat(_text(of(left)), _text(of(right)))
    raise NotUnderstood(ast.unparse(node))


def _is_constant(node: ast.expr) -> bool:
    return isinstance(node.operand if isinstance(node, ast.UnaryOp) else node, ast.Constant)


def _is_text(node: ast.expr) -> bool:
    """Whether an operand of + is a text by its form alone."""
    match node:
        case ast.Constant(value=str()):
            return True
        case ast.Call(func=ast.Attribute(attr="strip" | "lstrip" | "rstrip" | "lower" | "upper" | "capitalize" | "replace")):
            return True
        case ast.BinOp(op=ast.Add(), left=left, right=right):
            return _is_text(left) or _is_text(right)
    return False


def expression(said: str, columns: list[str]) -> Column:
    """The value of what stands inside {{ }}."""
    try:
        return _column(ast.parse(said.strip(), mode="eval").body, columns)
    except (SyntaxError, NotUnderstood) as e:
        raise ValueError(f"{{{{{said}}}}} isn't understood: {e}") from e


def only_expression(pattern: str) -> str | None:
    """What stands inside the braces of a template that is nothing but one expression."""
    found = PLACE.fullmatch(pattern.strip())
    return found[1] if found and not LONE.search(found[1]) else None


def text(pattern: str, columns: list[str]) -> Column:
    """A template's text, its expressions as text. An empty template is an empty text."""
    parts, at = [], 0
    for place in PLACE.finditer(pattern):
        parts += [pattern[at : place.start()], expression(place[1], columns)]
        at = place.end()
    parts.append(pattern[at:])
    for said in parts[::2]:
        if LONE.search(said):
            raise ValueError(f"{pattern!r} isn't understood: {LONE.search(said)[0]}")
    out = [F.lit(p) if k % 2 == 0 else _text(p) for k, p in enumerate(parts) if k % 2 or p]
    return F.concat(*out) if out else F.lit("")
