"""Column formulas: ``name = formula`` over a wide table, compiled to Spark columns.

A formula is parsed as a Python expression and interpreted node by node; only what ALLOWED lists is
taken. Formulas may use each other's names and are put in order of need. Row-wise functions become
expressions. Functions of neighbouring rows become windows inside blocks of rows, with as many
neighbours copied in as all nested calls together reach. Functions of all earlier rows and of the
whole column are computed as steps of their own, between which the columns so far are added.
"""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ieee, rowwise
from tidemark.functions.rowwise import EPS
from tidemark.operators import ordered
from tidemark.session import materialise, small

#: Scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826


class FormulaError(ValueError):
    """A formula that can't be compiled."""


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    formula: str


@dataclass(frozen=True)
class Value:
    """A compiled expression and how many rows it reaches back and ahead."""

    col: Column
    back: int = 0
    ahead: int = 0


ALLOWED = (
    ast.Expression, ast.Call, ast.Name, ast.Load, ast.Constant, ast.BinOp, ast.UnaryOp, ast.Compare, ast.BoolOp, ast.IfExp, ast.List, ast.Tuple,
    ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.Pow, ast.UAdd, ast.USub, ast.Not, ast.And, ast.Or, ast.Eq, ast.NotEq, ast.Gt, ast.GtE, ast.Lt, ast.LtE,
)


def parse(formula: str) -> ast.expr:
    text = (formula or "").strip()
    if not text:
        raise FormulaError("the formula is empty")
    try:
        tree = ast.parse(text, mode="eval")
    except SyntaxError as e:
        raise FormulaError(f"syntax: {e.msg}") from e
    for node in ast.walk(tree):
        if not isinstance(node, ALLOWED):
            raise FormulaError(f"{type(node).__name__} is not allowed")
        if isinstance(node, ast.Call) and not isinstance(node.func, ast.Name):
            raise FormulaError("only functions can be called, by their names")
    return tree.body


def dependencies(formula: str, names: Iterable[str]) -> set[str]:
    """Which of ``names`` a formula needs: bare, by COL, or by a COLS pattern. A formula that can't be read needs none."""
    names, found = set(names), set()
    try:
        tree = parse(formula)
    except FormulaError:
        return found
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and node.id in names:
            found.add(node.id)
        if isinstance(node, ast.Call) and node.args and isinstance(node.args[0], ast.Constant) and isinstance(node.args[0].value, str):
            text = node.args[0].value
            if node.func.id == "COL" and text in names:
                found.add(text)
            if node.func.id == "COLS":
                try:
                    found |= {n for n in names if re.search(text, n)}
                except re.error:
                    pass
    return found


def in_order(specs: Sequence[ColumnSpec]) -> tuple[list[ColumnSpec], set[str]]:
    """Specs with each after those it needs, otherwise as given; and the names that need themselves, directly or in a circle."""
    names = [s.name for s in specs]
    needs = {s.name: dependencies(s.formula, names) for s in specs}
    done: set[str] = set()
    out: list[ColumnSpec] = []
    left = list(specs)
    while ready := [s for s in left if needs[s.name] <= done]:
        out.append(ready[0])
        done.add(ready[0].name)
        left.remove(ready[0])
    circle = set(names) - done
    # What only leans on a circle isn't in it, but can't be computed either.
    return out + left, circle


def wrap(specs: Sequence[ColumnSpec], names: Iterable[str], template: str, suffix: str | None = None) -> list[ColumnSpec]:
    """Puts each named formula, in parentheses, for {x} of ``template``; under a new name if there is a ``suffix``."""
    if "{x}" not in template:
        raise FormulaError("the template has no {x}")
    names, out = set(names), []
    for s in specs:
        new = template.replace("{x}", f"({s.formula})")
        if s.name not in names:
            out.append(s)
        elif suffix:
            out += [s, ColumnSpec(s.name + suffix, template.replace("{x}", s.name if s.name.isidentifier() else f"COL({s.name!r})"))]
        else:
            out.append(replace(s, formula=new))
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass
class FormulaEngine:
    """Compiles and applies formulas along ``order``, within ``partition_by`` if the table is in long form.

    ``ties`` orders rows of equal ``order``. ``rows_per_block`` is how many rows a task holds along the
    global order, or along that of a key: a hot key takes many blocks.
    """

    order: str = "ts"
    partition_by: Sequence[str] = ()
    ties: Sequence[str] = ()
    rows_per_block: int = ordered.ROWS_PER_BLOCK

    def apply(self, df: DataFrame, specs: Sequence[ColumnSpec]) -> tuple[DataFrame, dict[str, str]]:
        """``df`` with a column for each spec that compiles, and a message for each that doesn't.

        Names must be new and different; duplicates raise. A spec in a circle, one that names an unknown
        column, or one that isn't an expression over columns is reported and left out.
        """
        names = [s.name for s in specs]
        if len(set(names)) < len(names):
            raise FormulaError(f"duplicate names: {sorted({n for n in names if names.count(n) > 1})}")
        errors: dict[str, str] = {}
        arranged, circle = in_order(specs)
        run = _Run(self, df)
        for s in arranged:
            try:
                if not s.name:
                    raise FormulaError("the name is empty")
                if s.name in df.columns:
                    raise FormulaError("there is such a column already")
                if s.name in circle:
                    raise FormulaError("it needs itself, or a formula that does")
                run.add(s.name, run.compile(s.formula))
            except (FormulaError, TypeError) as e:
                errors[s.name] = str(e)
        made = [s.name for s in specs if s.name not in errors]
        return run.finish().select(*[quoted(c) for c in [*df.columns, *made]]), errors

    def select_new(self, df: DataFrame, specs: Sequence[ColumnSpec]) -> DataFrame:
        """The new columns with the order column last; any error raises."""
        made, errors = self.apply(df, specs)
        if errors:
            raise FormulaError("; ".join(f"{k}: {v}" for k, v in errors.items()))
        return made.select(*[quoted(c) for c in [*self.partition_by, *[s.name for s in specs], self.order]])


class _Run:
    """One application of specs to a table: the columns still to be added, and the table so far."""

    def __init__(self, engine: FormulaEngine, df: DataFrame):
        self.engine, self.keys = engine, list(engine.partition_by)
        self.df, self.names = df, list(df.columns)
        self.numbered, self.many, self.pending, self.reach, self.temps = False, False, [], {}, 0
        self.functions = _functions(self)

    # Steps

    def add(self, name: str, value: Value) -> None:
        self.pending.append((name, value))
        self.reach[name] = (value.back, value.ahead)
        self.names.append(name)

    def temp(self) -> str:
        self.temps += 1
        return f"__step{self.temps}"

    def number(self) -> None:
        if not self.numbered:
            self.df, self.many = ordered.number(self.df, self.engine.order, self.keys, self.engine.ties, self.engine.rows_per_block)
            self.numbered = True

    def flush(self) -> None:
        """Adds the pending columns to the table; from then on they reach nowhere."""
        if not self.pending:
            return
        back, ahead = max(v.back for _, v in self.pending), max(v.ahead for _, v in self.pending)
        halo = (back or ahead) and self.many
        df = ordered.with_halo(self.df, back, ahead, self.engine.rows_per_block) if halo else self.df
        for name, value in self.pending:
            df = df.withColumn(name, value.col)
        self.df = ordered.without_halo(df) if halo else df
        self.pending, self.reach = [], {}

    def finish(self) -> DataFrame:
        self.flush()
        return self.df

    def staged(self, x, make: Callable[[DataFrame, str, str], DataFrame]) -> Value:
        """A column that ``make`` adds to the whole table from another."""
        source, out = self.temp(), self.temp()
        self.number()
        self.pending.append((source, self.value(x)))
        self.flush()
        self.df = make(self.df, source, out)
        return Value(F.col(out))

    # Values

    def value(self, x) -> Value:
        if isinstance(x, Value):
            return x
        if isinstance(x, (list, str)):
            raise FormulaError("a set or a text stands where a column is needed")
        return Value(F.lit(x))

    def column(self, name: str) -> Value:
        if name not in self.names:
            raise FormulaError(f"no column {name!r}")
        return Value(quoted(name), *self.reach.get(name, (0, 0)))

    def map(self, make: Callable[..., Column], *args) -> Value:
        values = [self.value(a) for a in args]
        return Value(make(*[v.col for v in values]), max((v.back for v in values), default=0), max((v.ahead for v in values), default=0))

    def over_set(self, make: Callable[[list[Column]], Column], items: list[Value], *more) -> Value:
        every = [*items, *[self.value(m) for m in more]]
        return Value(make([v.col for v in items]), max((v.back for v in every), default=0), max((v.ahead for v in every), default=0))

    def window(self, x, make: Callable[[Column, object], Column], back: int, ahead: int = 0) -> Value:
        self.number()
        v = self.value(x)
        return Value(make(v.col, ordered.block_window(self.keys)), v.back + back, v.ahead + ahead)

    # Interpretation

    def compile(self, formula: str) -> Value:
        found = self.visit(parse(formula))
        if not isinstance(found, Value):
            raise FormulaError("the formula is a constant or a set, not a column")
        return found

    def visit(self, node: ast.expr):
        return getattr(self, "_" + type(node).__name__.lower())(node)

    def _constant(self, node: ast.Constant):
        if isinstance(node.value, (bool, int, float, str)) or node.value is None:
            return node.value
        raise FormulaError(f"{node.value!r} is not allowed")

    def _name(self, node: ast.Name):
        return self.column(node.id)

    def _list(self, node: ast.List):
        return _flat(map(self.visit, node.elts))

    _tuple = _list

    def _unaryop(self, node: ast.UnaryOp):
        x = self.visit(node.operand)
        if not isinstance(x, Value):
            if isinstance(x, (str, list)) or x is None:
                raise FormulaError("a number or column is needed")
            return -x if isinstance(node.op, ast.USub) else +x if isinstance(node.op, ast.UAdd) else not x
        return self.map(lambda c: -c if isinstance(node.op, ast.USub) else c if isinstance(node.op, ast.UAdd) else ~c, x)

    def _binop(self, node: ast.BinOp):
        a, b = self.visit(node.left), self.visit(node.right)
        if not isinstance(a, Value) and not isinstance(b, Value):
            try:
                return _PLAIN[type(node.op)](a, b)
            except (ArithmeticError, TypeError) as e:
                raise FormulaError(f"constant: {e}") from e
        return self.map(_BINARY[type(node.op)], a, b)

    def _compare(self, node: ast.Compare):
        sides = [self.visit(x) for x in (node.left, *node.comparators)]
        tests = [self.map(_COMPARE[type(op)], a, b) for op, a, b in zip(node.ops, sides, sides[1:])]
        out = tests[0]
        for t in tests[1:]:
            out = self.map(lambda a, b: a & b, out, t)
        return out

    def _boolop(self, node: ast.BoolOp):
        both = (lambda a, b: a & b) if isinstance(node.op, ast.And) else (lambda a, b: a | b)
        out = self.visit(node.values[0])
        for x in node.values[1:]:
            out = self.map(both, out, self.visit(x))
        return out

    def _ifexp(self, node: ast.IfExp):
        test = self.visit(node.test)
        if not isinstance(test, Value):
            return self.visit(node.body if test else node.orelse)
        return self.map(lambda c, a, b: F.when(c, a).otherwise(b), test, self.visit(node.body), self.visit(node.orelse))

    def _call(self, node: ast.Call):
        name = node.func.id
        if name in self.names or name not in self.functions:
            raise FormulaError(f"no function {name}" if name not in self.functions else f"a column is named {name}, which hides the function")
        if node.keywords:
            raise FormulaError("keyword arguments are not allowed")
        try:
            return self.functions[name](*map(self.visit, node.args))
        except TypeError as e:
            raise FormulaError(f"{name}: {e}") from e


_PLAIN = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: lambda a, b: a / b, ast.Mod: lambda a, b: a % b, ast.Pow: lambda a, b: a**b}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: ieee.divide, ast.Mod: ieee.modulo, ast.Pow: lambda a, b: F.pow(ieee.double(a), ieee.double(b))}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b}


def _flat(items) -> list[Value]:
    """Columns of nested sets; anything else is left out."""
    out: list[Value] = []
    for x in items:
        if isinstance(x, list):
            out += _flat(x)
        elif isinstance(x, Value):
            out.append(x)
    return out


def _whole(x, what: str, least: int | None = None) -> int:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or int(x) != x:
        raise FormulaError(f"{what} must be a whole number")
    if least is not None and x < least:
        raise FormulaError(f"{what} must be {least} or more")
    return int(x)


def _fraction(x, what: str) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not 0 <= x <= 1:
        raise FormulaError(f"{what} must lie between 0 and 1")
    return float(x)


def _floor(x):
    return F.floor(x) if isinstance(x, Column) else math.floor(x)


def _set(x) -> list[Value]:
    return _flat([x])


def _functions(run: _Run) -> dict[str, Callable]:
    keys, m = run.keys, run.map

    def cols(pattern):
        try:
            return [run.column(c) for c in run.names if re.search(str(pattern), c)]
        except re.error as e:
            raise FormulaError(f"pattern: {e}") from e

    def rowset(make):
        return lambda *xs: run.over_set(make, _flat(xs))

    # Neighbouring rows

    def lag(x, n=1):
        n = _whole(n, "n")
        return run.window(x, lambda c, w: F.lag(c, n).over(w), max(n, 0), max(-n, 0))

    def with_lag(make):
        def f(x, n=1):
            return run.map(make, x, lag(x, n))

        return f

    def rolling(make):
        def f(x, w):
            w = _whole(w, "w", 1)

            def full(c, window):
                frame = window.rowsBetween(-(w - 1), 0)
                return F.when(F.count(c).over(frame) == w, make(ieee.double(c), frame))

            return run.window(x, full, w - 1)

        return f

    mean, std = rolling(lambda c, f: F.avg(c).over(f)), rolling(lambda c, f: F.stddev_samp(c).over(f))
    total = rolling(lambda c, f: F.sum(c).over(f))

    def roll_zscore(x, w):
        return m(lambda c, a, s: (ieee.double(c) - a) / (s + F.lit(EPS)), x, mean(x, w), std(x, w))

    # All earlier rows

    def ema(x, span):
        span = _whole(span, "span", 1)
        return run.staged(x, lambda df, a, b: ordered.ema(df, a, b, span, run.many, keys))

    # The whole column

    def known(x, of_table: Callable[[DataFrame, str], dict], by_key: Callable[[DataFrame, str], DataFrame]) -> list[Value]:
        """The column itself and some values of the whole column: literals of one row, or columns of a table of one row a key."""
        found: list[Value] = []

        def make(df, source, out):
            found.append(Value(F.col(source)))
            if keys:
                one = materialise(by_key(df, source))
                names = [c for c in one.columns if c not in keys]
                found.extend(Value(F.col(f"{out}_{c}")) for c in names)
                return ordered.beside(df, small(one.withColumnsRenamed({c: f"{out}_{c}" for c in names})), keys)
            found.extend(Value(F.lit(v)) for v in of_table(df, source).values())
            return df

        run.staged(x, make)
        return found

    def stats(x, **aggregates: Callable[[Column], Column]) -> list[Value]:
        made = lambda source: [f(F.col(source)).alias(n) for n, f in aggregates.items()]
        return known(x, lambda df, c: df.agg(*made(c)).first().asDict(), lambda df, c: df.groupBy(*keys).agg(*made(c)))

    def zscore(x):
        return m(lambda c, a, s: (c - a) / (s + F.lit(EPS)), *stats(x, mean=F.avg, std=F.stddev_samp))

    def minmax(x):
        return m(lambda c, a, b: (c - a) / (b - a + F.lit(EPS)), *stats(x, min=F.min, max=F.max))

    def at_ranks(x, **ranks: Callable[[int], int]) -> list[Value]:
        """The column itself and the values at indices of its sorted values; an index follows from their number."""

        def of_table(df, source):
            return ordered.values_at(ordered.value_counts(df, source, run.engine.rows_per_block), ranks)

        def by_key(df, source):
            return ordered.values_at_by_key(ordered.value_counts(df, source, run.engine.rows_per_block, keys), ranks, keys)

        return known(x, of_table, by_key)

    def clip(x, low, high):
        return m(lambda c, a, b: F.when(c < a, a).when(c > b, b).otherwise(c), x, low, high)

    def winsorize(x, p_low=0.01, p_high=0.99):
        low, high = _fraction(p_low, "p_low"), _fraction(p_high, "p_high")
        if low > high:
            raise FormulaError("p_low must not be above p_high")
        nearest = lambda p: lambda n: _floor((n - 1) * p + 0.5)
        return clip(*at_ranks(x, low=nearest(low), high=nearest(high)))

    def median(x) -> list[Value]:
        c, a, b = at_ranks(x, a=lambda n: _floor((n - 1) / 2), b=lambda n: _floor(n / 2))
        return [c, m(lambda a, b: (a + b) / 2, a, b)]

    def robust_z(x):
        c, centre = median(x)
        away, mad = median(m(lambda c, a: F.abs(c - a), c, centre))
        return m(lambda c, a, d: (c - a) / (d * F.lit(MAD_SCALE) + F.lit(EPS)), c, centre, mad)

    def rank_norm(x):
        def make(df, source, out):
            counts = ordered.value_counts(df, source, run.engine.rows_per_block, keys).select(*keys, F.col("x").alias(source), (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("__rank"))
            ranked = ordered.beside(df, counts, [*keys, source], "left")
            rows = materialise(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))) if keys else None
            ranked = ordered.beside(ranked, small(rows), keys) if keys else ranked.withColumn("__rows", F.lit(df.count()))
            return ranked.withColumn(out, F.when(F.col(source).isNotNull(), (F.col("__rank") - 1) / (F.col("__rows") - 1 + F.lit(EPS)))).drop("__rank", "__rows")

        return run.staged(x, make)

    def temperature(x, items, temp=1.0):
        if isinstance(temp, bool) or not isinstance(temp, (int, float)) or temp <= 0:
            raise FormulaError("temp must be above 0")
        if not _set(items):
            raise FormulaError("the set is empty")
        return run.over_set(lambda cs: rowwise.softmax_weight(run.value(x).col, cs, temp), _set(items), x)

    def against(make):
        return lambda x, items: run.over_set(lambda cs: make(run.value(x).col, cs), _set(items), x)

    return {
        # References
        "COL": lambda name: run.column(str(name)),
        "COLS": cols,
        "SET": lambda *xs: _flat(xs),
        # One value
        "ABS": lambda x: m(F.abs, x),
        "LOG": lambda x: m(ieee.ln, x),
        "EXP": lambda x: m(F.exp, x),
        "SQRT": lambda x: m(F.sqrt, x),
        "SIGN": lambda x: m(lambda c: F.when(c > 0, 1).when(c < 0, -1).otherwise(0), x),
        "ROUND": lambda x, digits=0: m(lambda c: F.round(ieee.double(c), _whole(digits, "digits")), x),
        "FLOOR": lambda x: m(lambda c: F.floor(c).cast("double"), x),
        "CEIL": lambda x: m(lambda c: F.ceil(c).cast("double"), x),
        "CLIP": clip,
        "CLAMP": clip,
        "MIN": lambda a, b: m(F.least, a, b),
        "MAX": lambda a, b: m(F.greatest, a, b),
        "IF": lambda c, a, b: m(lambda c, a, b: F.when(c, a).otherwise(b), c, a, b),
        "ISNA": lambda x: m(lambda c: c.isNull(), x),
        "ISFINITE": lambda x: m(ieee.is_finite, x),
        "COALESCE": lambda a, b: m(F.coalesce, a, b),
        "FILL_ZERO": lambda x: m(lambda c: F.coalesce(c, F.lit(0)), x),
        # Neighbouring rows
        "LAG": lag,
        "DIFF": with_lag(lambda c, p: c - p),
        "PCT_CHANGE": with_lag(lambda c, p: ieee.divide(c, p) - 1),
        "LOGRET": with_lag(lambda c, p: ieee.ln(c) - ieee.ln(p)),
        "ROLL_MEAN": mean,
        "ROLL_STD": std,
        "ROLL_SUM": total,
        "ROLL_ZSCORE": roll_zscore,
        # All earlier or later rows
        "CUMSUM": lambda x: run.staged(x, lambda df, a, b: ordered.cumulate(df, a, b, run.many, keys)),
        "CUMPROD": lambda x: run.staged(x, lambda df, a, b: ordered.cumulate(df, a, b, run.many, keys, product=True)),
        "EMA": ema,
        "FILL_FFILL": lambda x: run.staged(x, lambda df, a, b: ordered.ffill(df, a, b, run.many, keys)),
        "FILL_BFILL": lambda x: run.staged(x, lambda df, a, b: ordered.ffill(df, a, b, run.many, keys, backwards=True)),
        # The whole column
        "ZSCORE": zscore,
        "MINMAX": minmax,
        "WINSORIZE": winsorize,
        "ROBUST_Z": robust_z,
        "RANK_NORM": rank_norm,
        # One row
        "ROW_SUM": rowset(rowwise.row_sum),
        "ROW_MEAN": rowset(rowwise.row_mean),
        "ROW_MIN": rowset(rowwise.row_min),
        "ROW_MAX": rowset(rowwise.row_max),
        "ROW_COUNT_VALID": rowset(rowwise.row_count_valid),
        "ROW_STD": rowset(rowwise.row_std),
        "ROW_VAR": rowset(rowwise.row_var),
        "ROW_MEDIAN": rowset(rowwise.row_median),
        "ROW_QUANTILE": lambda items, q: run.over_set(lambda cs: rowwise.row_quantile(cs, _fraction(q, "q")), _set(items)),
        "ROW_TOPK_MEAN": lambda items, k: run.over_set(lambda cs: rowwise.row_topk_mean(cs, _whole(k, "k", 1)), _set(items)),
        "ROW_BOTTOMK_MEAN": lambda items, k: run.over_set(lambda cs: rowwise.row_bottomk_mean(cs, _whole(k, "k", 1)), _set(items)),
        # One column against a set
        "XS_DEMEAN": against(rowwise.xs_demean),
        "XS_ZSCORE": against(rowwise.xs_zscore),
        "XS_RANK": against(rowwise.xs_rank),
        "XS_PCTRANK": against(rowwise.xs_pctrank),
        "SOFTMAX_WEIGHT": temperature,
    }


FUNCTIONS = 54
