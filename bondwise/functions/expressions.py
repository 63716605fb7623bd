"""Model expressions as Spark SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of the expression language that are not model names.
RESERVED = [
    "sqrt", "exp", "ln", "pow", "min", "max", "abs", "if", "time", "t", "case", "when", "then", "else", "end", "and",
    "or", "not", "least", "greatest",
]
_NAME = r"[A-Za-z_][A-Za-z_0-9]*"
_TOKEN = re.compile(rf"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|({_NAME})|(&&|\|\||==|!=|<>|<=|>=|[-+*/^%()<>=!,]))")
# Operators by how tightly they bind, loosest first, with their Spark SQL form.
_LEVELS = [
    {"||": "OR", "or": "OR"}, {"&&": "AND", "and": "AND"}, {"==": "=", "=": "=", "!=": "<>", "<>": "<>", "<": "<", "<=": "<=", ">": ">", ">=": ">="},
    {"+": "+", "-": "-"}, {"*": "*", "/": "/", "%": "%"},
]
_LOGS = {"ln": "ln", "log": "ln", "log10": "log10", "log2": "log2"}


class _Formula:
    """One formula on its way to Spark SQL. A part is (sql, truth): conditions count 1 or 0 where a number is asked (0 if unknown), and numbers are true unless 0."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read formula at {text[at:at + 20]!r}")
            self.tokens.append(m[1] and ("number", m[1]) or m[2] and ("name", m[2]) or ("sign", m[3]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def take(self, wanted: str = "") -> tuple[str, str]:
        if self.at >= len(self.tokens) or (wanted and self.peek() != wanted):
            raise ValueError(f"formula lacks {wanted or 'a value'} at part {self.at + 1}")
        self.at += 1
        return self.tokens[self.at - 1]

    @staticmethod
    def number(part: tuple[str, bool]) -> str:
        return f"if({part[0]}, 1D, 0D)" if part[1] else part[0]

    @staticmethod
    def truth(part: tuple[str, bool]) -> str:
        return part[0] if part[1] else f"({part[0]} <> 0)"

    def binary(self, level: int = 0) -> tuple[str, bool]:
        if level == len(_LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            sign = _LEVELS[level][self.take()[1]]
            right = self.binary(level + 1)
            if level < 2:
                left = (f"({self.truth(left)} {sign} {self.truth(right)})", True)
            else:
                a, b = self.number(left), self.number(right)
                if sign == "/":
                    left = (_quotient(a, b), False)
                elif sign == "%":
                    left = (f"coalesce(try_mod({a}, {b}), CASE WHEN {b} = 0 THEN double('NaN') END)", False)
                else:
                    left = (f"({a} {sign} {b})", level == 2)
        return left

    def unary(self) -> tuple[str, bool]:
        if self.peek() in ("-", "+"):
            sign = self.take()[1]
            part = self.number(self.unary())
            return (f"(-{part})" if sign == "-" else part), False
        if self.peek() == "!":
            self.take()
            return f"(NOT {self.truth(self.unary())})", True
        base = self.atom()
        if self.peek() == "^":  # binds tighter than a sign on its left, and to the right first
            self.take()
            return f"power({self.number(base)}, {self.number(self.unary())})", False
        return base

    def atom(self) -> tuple[str, bool]:
        kind, text = self.take()
        if kind == "number":
            return f"{text}D", False
        if text == "(":
            part = self.binary()
            self.take(")")
            return part
        if kind != "name":
            raise ValueError(f"formula has {text!r} where a value should be")
        if self.peek() != "(":
            return ("`time`" if text in ("t", "time") else f"`{text}`"), False
        self.take("(")
        args = []
        while self.peek() != ")":
            args.append(self.binary())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        return self.call(text, args)

    def call(self, name: str, args: list[tuple[str, bool]]) -> tuple[str, bool]:
        if name == "time" and not args:
            return "`time`", False
        if name == "if":
            cond, yes, no = args
            return f"if({self.truth(cond)}, {self.number(yes)}, {self.number(no)})", False
        if name == "not":
            return f"(NOT {self.truth(args[0])})", True
        values = [self.number(a) for a in args]
        if name in ("min", "max"):
            return (f"{'least' if name == 'min' else 'greatest'}({', '.join(values)})" if len(values) > 1 else values[0]), False
        if name in _LOGS:
            x = values[0]
            return f"coalesce({_LOGS[name]}({x}), CASE WHEN {x} = 0 THEN double('-Infinity') WHEN {x} < 0 THEN double('NaN') END)", False
        return f"{name}({', '.join(values)})", False


def _quotient(a: str, b: str) -> str:
    """a / b as doubles divide: by zero it is infinite or not a number, never an error."""
    if re.fullmatch(r"[0-9.eE+-]+D", b) and float(b[:-1]):
        return f"({a} / {b})"
    if len(a) + len(b) < 80:
        return f"coalesce(try_divide({a}, {b}), {a} * power({b}, -1D))"
    # long operands are computed once
    return f"aggregate(array(CAST({b} AS DOUBLE)), CAST({a} AS DOUBLE), (x, y) -> coalesce(try_divide(x, y), x * power(y, -1D)))"


def to_sql(text: str) -> str:
    """Model text as Spark SQL of a double. ``^`` binds to the right, conditions are 1 or 0, ``time()`` and ``t`` are the column ``time``."""
    formula = _Formula(text)
    part = formula.binary()
    if formula.peek():
        raise ValueError(f"formula goes on after its end: {formula.peek()!r}")
    return formula.number(part)


def names_in(text: str) -> list[str]:
    """Names a model expression reads, without functions of the language, in order of appearance."""
    found = re.findall(rf"(?<![0-9.])\b{_NAME}\b", text)
    return [n for n in dict.fromkeys(found) if n not in RESERVED]


def referenced_names(rows: DataFrame, expr: str = "expr") -> DataFrame:
    """Explode each row of an expression column into (…, name, tagged): names applied to an argument or bare."""
    hits = F.regexp_extract_all(expr, F.lit(r"(?<![0-9.])\b([A-Za-z_][A-Za-z_0-9]*\b\s*\(?)"), 1)
    rows = rows.withColumn("hit", F.explode(F.array_distinct(F.transform(hits, lambda h: F.regexp_replace(h, r"\s", "")))))
    name = F.regexp_replace("hit", r"\($", "")
    out = rows.withColumn("name", name).withColumn("tagged", F.col("hit").endswith("("))
    return out.filter(~F.col("name").isin(RESERVED)).drop("hit")


def evaluate(rows: DataFrame, text: str, extra: dict[str, float] | None = None, name: str = "value") -> DataFrame:
    """Add a column with the expression's value; ``extra`` bindings shadow columns of the same name."""
    extra = extra or {}
    bound = [F.lit(float(v)).alias(k) for k, v in extra.items()]
    seen = [F.col(c) for c in rows.columns if c not in extra]
    inner = rows.select(F.struct(*rows.columns).alias("held_row"), *seen, *bound)
    return inner.withColumn("held_value", F.expr(to_sql(text)).cast("double")).select("held_row.*", F.col("held_value").alias(name))


def with_functions(rows: DataFrame, functions: list[tuple[str, str]]) -> DataFrame:
    """Add named function columns in order; a later function may read an earlier one."""
    return reduce(lambda df, f: df.withColumn(f[0], F.expr(to_sql(f[1])).cast("double")), functions, rows)


def rounded(number: Column, digits: int) -> Column:
    """The nearest multiple of 10^-digits by double arithmetic: the product is rounded, ties away from zero, and divided.

    ``F.round`` rounds the shortest decimal text of a double, which differs in the last digit for about one row in a million. Zeros keep the number's sign.
    """
    unit = float(10**digits)
    near = F.round(number * unit) / unit
    near = F.when(near == 0, number * 0.0).otherwise(near)
    return F.when(F.abs(near) < float("inf"), near).otherwise(number)


def fixed(number: Column, digits: int) -> Column:
    """A number with none, one or two digits after the point: its exact value rounded, ties to an even last digit.

    ``format_string`` rounds the shortest decimal text of a double instead, and ties up, so it makes 0.4 of 0.35, a double below 0.35.
    Here it renders what is rounded already, and as it stands what has more than 15 digits, is infinite or NaN.
    """
    scaled = number * float(10**digits)
    # what the product lost in rounding; each step is exact, and its sign matters only where the product fell on a tie
    lost = {0: F.lit(0.0), 1: (number * 8.0 - scaled) + number * 2.0, 2: ((number * 64.0 - scaled) + number * 32.0) + number * 4.0}[digits]
    tie = F.abs(scaled - F.rint(scaled)) == 0.5
    whole = F.rint(scaled + F.when(tie & (lost > 0), 0.25).when(tie & (lost < 0), -0.25).otherwise(-0.0))
    return F.format_string(f"%.{digits}f", F.when(F.abs(scaled) < 1e15, whole / float(10**digits)).otherwise(number))


def duration_text(seconds: str | Column) -> Column:
    """Seconds for display: milliseconds with falling precision, then seconds; exact values are rounded, ties to even."""
    s = F.col(seconds) if isinstance(seconds, str) else seconds
    ms = s * 1000.0
    return (
        F.when(ms < 1, F.concat(fixed(ms, 2), F.lit(" ms")))
        .when(ms < 100, F.concat(fixed(ms, 1), F.lit(" ms")))
        .when(ms < 10_000, F.concat(fixed(ms, 0), F.lit(" ms")))
        .otherwise(F.concat(fixed(s, 1), F.lit(" s")))
    )
