"""Python-like expressions as Columns: a parsed tree is translated node by node, nothing is ever evaluated.

Names are columns (or `value`, the cell of a formula); calls are limited to the tables below. Attributes other
than `re.<function>`, lambdas, comprehensions, subscripts other than slices of text, and names with a
double underscore or an @ are refused. SQL never sees the text, so there are no subqueries to refuse.
"""

from __future__ import annotations

import ast
import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import MaskError
from .kernel import slice_number, unit

COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a.cast("double") / b, ast.Mod: lambda a, b: a - b * F.floor(a / b), ast.FloorDiv: lambda a, b: F.floor(a / b), ast.Pow: lambda a, b: F.pow(a, b)}
DATE_FORMATS = (("%Y", "yyyy"), ("%m", "MM"), ("%d", "dd"), ("%y", "yy"), ("%H", "HH"), ("%M", "mm"), ("%S", "ss"), ("%B", "MMMM"), ("%b", "MMM"), ("%A", "EEEE"), ("%a", "EEE"), ("%j", "DDD"))


def java_format(strftime: str) -> str:
    """A strftime pattern as a pattern of Spark's datetime functions; letters outside of directives are quoted."""
    out, i, known = "", 0, dict(DATE_FORMATS)
    while i < len(strftime):
        two = strftime[i : i + 2]
        if two in known:
            out, i = out + known[two], i + 2
        else:
            out, i = out + (f"'{strftime[i]}'" if strftime[i].isalpha() else strftime[i]), i + 1
    return out


class Translator:
    """names: columns by name; draw: digest of the row and a call's number, for random functions (None: refused)."""

    def __init__(self, names: dict[str, Column], draw: Callable[[int], Column] | None = None, today: datetime.date | None = None):
        self.names, self.draw, self.calls = names, draw, 0
        self.today = today or datetime.date.today()

    def refuse(self, what: str):
        raise MaskError("expression_refused", what)

    def translate(self, text: str) -> Column:
        if "@" in text or "__" in text:
            self.refuse(text)
        try:
            tree = ast.parse(text.strip().replace(" & ", " and ").replace(" | ", " or ") if isinstance(text, str) else self.refuse(repr(text)), mode="eval")
        except SyntaxError as e:
            raise MaskError("expression_error", str(e)) from None
        out = self.node(tree.body)
        return out if isinstance(out, Column) else F.lit(out)

    def literal(self, node: ast.AST):
        try:
            return ast.literal_eval(node)
        except ValueError:
            self.refuse(ast.dump(node)[:80])

    def node(self, n: ast.AST) -> Column:
        if isinstance(n, ast.Constant):
            if not isinstance(n.value, str | int | float | bool | type(None)):
                self.refuse(repr(n.value))
            return F.lit(n.value)
        if isinstance(n, ast.Name):
            if n.id in ("True", "False", "true", "false"):
                return F.lit(n.id.lower() == "true")
            return self.names[n.id] if n.id in self.names else self.refuse(f"name {n.id}")
        if isinstance(n, ast.BoolOp):
            parts = [self.node(v) for v in n.values]
            out = parts[0]
            for p in parts[1:]:
                out = (out & p) if isinstance(n.op, ast.And) else (out | p)
            return out
        if isinstance(n, ast.UnaryOp):
            x = self.node(n.operand)
            return ~x if isinstance(n.op, ast.Not | ast.Invert) else -x if isinstance(n.op, ast.USub) else x
        if isinstance(n, ast.BinOp):
            if type(n.op) not in BINARY:
                self.refuse(type(n.op).__name__)
            if isinstance(n.op, ast.Add) and (self.textual(n.left) or self.textual(n.right)):
                return F.concat(self.node(n.left).cast("string"), self.node(n.right).cast("string"))
            return BINARY[type(n.op)](self.node(n.left), self.node(n.right))
        if isinstance(n, ast.Compare):
            out, left = None, self.node(n.left)
            for op, right in zip(n.ops, n.comparators, strict=True):
                if isinstance(op, ast.In | ast.NotIn):
                    if not isinstance(right, ast.List | ast.Tuple | ast.Set):
                        hit = F.contains(self.node(right), left)
                    else:
                        hit = left.isin(*[self.literal(e) for e in right.elts])
                    one, nxt = (hit if isinstance(op, ast.In) else ~hit), left
                elif isinstance(op, ast.Is | ast.IsNot):
                    one, nxt = (left.isNull() if isinstance(op, ast.Is) else left.isNotNull()), left
                else:
                    nxt = self.node(right)
                    one = COMPARE[type(op)](left, nxt)
                out, left = (one if out is None else out & one), nxt
            return out
        if isinstance(n, ast.IfExp):
            return F.when(self.node(n.test), self.node(n.body)).otherwise(self.node(n.orelse))
        if isinstance(n, ast.JoinedStr):
            return F.concat(*[F.lit(v.value) if isinstance(v, ast.Constant) else self.node(v.value).cast("string") for v in n.values])
        if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Slice):
            return self.part(self.node(n.value), n.slice)
        if isinstance(n, ast.Call):
            return self.call(n)
        self.refuse(type(n).__name__)

    def textual(self, n: ast.AST) -> bool:
        if isinstance(n, ast.Constant):
            return isinstance(n.value, str)
        if isinstance(n, ast.Call):
            return (isinstance(n.func, ast.Name) and n.func.id in ("str", "format_date", "hash")) or (isinstance(n.func, ast.Attribute) and n.func.attr in ("sub", "upper", "lower", "strip"))
        if isinstance(n, ast.BinOp):
            return self.textual(n.left) or self.textual(n.right)
        return isinstance(n, ast.JoinedStr) or (isinstance(n, ast.Subscript))

    def part(self, text: Column, s: ast.Slice) -> Column:
        size = F.length(text)
        place = lambda x, default: default if x is None else (lambda v: F.greatest(size + v, F.lit(0)) if v < 0 else F.least(F.lit(v), size))(self.literal(x))
        if s.step is not None:
            if self.literal(s.step) != -1 or s.lower or s.upper:
                self.refuse("slice step")
            return F.reverse(text)
        lo, hi = place(s.lower, F.lit(0)), place(s.upper, size)
        return F.substring(text, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def next_draw(self) -> Column:
        if self.draw is None:
            self.refuse("random function")
        self.calls += 1
        return self.draw(self.calls)

    def between(self, lo: Column, hi: Column) -> Column:
        return lo + (slice_number(self.next_draw(), 0, 6) % (hi - lo + 1))

    def days(self, lo: int | Column, hi: int | Column) -> Column:
        lo, hi = (F.lit(x) if isinstance(x, int) else x for x in (lo, hi))
        return F.date_add(F.lit(self.today), self.between(lo, hi).cast("int"))

    def call(self, n: ast.Call) -> Column:
        if n.keywords:
            self.refuse("keyword argument")
        a = n.args
        if isinstance(n.func, ast.Attribute):
            return self.method(n, a)
        if not isinstance(n.func, ast.Name):
            self.refuse("call")
        name = n.func.id
        x = lambda i=0: self.node(a[i])
        t = F.lit(self.today)
        table = {
            "str": lambda: x().cast("string"), "int": lambda: F.when(x().cast("double") < 0, F.ceil(x().cast("double"))).otherwise(F.floor(x().cast("double"))), "float": lambda: x().cast("double"), "bool": lambda: x().cast("boolean"),
            "len": lambda: F.length(x()), "abs": lambda: F.abs(x()), "round": lambda: F.bround(x(), self.literal(a[1]) if len(a) > 1 else 0), "min": lambda: F.least(*map(self.node, a)), "max": lambda: F.greatest(*map(self.node, a)),
            "random": lambda: unit(self.next_draw()), "randint": lambda: self.between(x(0), x(1)), "hash": lambda: F.substring(F.sha2(F.concat(self.next_draw(), x().cast("string")), 256), 1, 8),
            "today": lambda: t, "now": lambda: t.cast("timestamp"), "days_from_now": lambda: F.date_add(t, x().cast("int")), "months_from_now": lambda: F.add_months(t, x().cast("int")), "years_from_now": lambda: F.add_months(t, (12 * x()).cast("int")),
            "format_date": lambda: F.date_format(x(), java_format(self.literal(a[1]))), "future_date": lambda: self.days(1, 30), "past_date": lambda: self.days(-30, -1), "date_this_year": lambda: self.days(-(self.today.timetuple().tm_yday - 1), 0),
            "date_this_month": lambda: self.days(1 - self.today.day, 0), "date_this_decade": lambda: self.days((datetime.date(self.today.year // 10 * 10, 1, 1) - self.today).days, 0), "date_of_birth": lambda: self.days(-90 * 365, -18 * 365),
            "date_between": lambda: F.date_add(x(0).cast("date"), (slice_number(self.next_draw(), 0, 6) % (F.datediff(x(1).cast("date"), x(0).cast("date")) + 1)).cast("int")),
            "time": lambda: F.date_format(F.timestamp_seconds(slice_number(self.next_draw(), 0, 6) % 86400), "HH:mm:ss"),
            "choice": lambda: F.element_at(F.array(*map(F.lit, self.literal(a[0]))), (slice_number(self.next_draw(), 0, 6) % len(self.literal(a[0])) + 1).cast("int")),
        }
        return table[name]() if name in table else self.refuse(f"function {name}")

    def method(self, n: ast.Call, a: list[ast.AST]) -> Column:
        f = n.func
        if isinstance(f.value, ast.Name) and f.value.id == "re" and "re" not in self.names:
            pattern = self.literal(a[0])
            if f.attr == "sub":
                import re

                return F.regexp_replace(self.node(a[2]), F.lit(pattern), F.lit(re.sub(r"\\(\d)", r"$\1", self.literal(a[1]))))
            text = self.node(a[1])
            if f.attr == "search":
                return text.rlike(pattern)
            if f.attr == "match":
                return text.rlike(f"^(?:{pattern})")
            if f.attr == "fullmatch":
                return text.rlike(f"^(?:{pattern})$")
            if f.attr == "findall":
                return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            if f.attr == "split":
                return F.split(text, pattern)
            if f.attr == "escape":
                import re

                return F.lit(re.escape(pattern))
            self.refuse(f"re.{f.attr}")
        text = self.node(f.value)
        plain = {"upper": F.upper, "lower": F.lower, "strip": F.trim, "title": F.initcap}
        if f.attr in plain and not a:
            return plain[f.attr](text)
        if f.attr in ("startswith", "endswith"):
            return getattr(text, f.attr)(self.literal(a[0]))
        if f.attr == "replace":
            return F.replace(text, F.lit(self.literal(a[0])), F.lit(self.literal(a[1])))
        self.refuse(f"method {f.attr}")


def column_expression(text: str, columns: list[str], names: dict[str, Column] | None = None, **options) -> Column:
    """An expression over columns of a DataFrame, as for filter, derive and when."""
    return Translator({c: F.col(f"`{c}`") for c in columns} | (names or {}), **options).translate(text)
