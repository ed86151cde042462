"""Expression trees over concepts, their JSON form, and their compilation to columns of a wide sheet.

A tree is evaluated for every (entity, period) of a sheet at once.  A zero denominator, and any missing operand, gives
NULL, which ``evaluate`` drops.  ``growth`` is (later - earlier) / earlier; ``base="right"`` and ``base="left"`` give the
two other conventions for a pair of explicit operands.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINARY = ("sum", "diff", "ratio", "mul", "growth", "min", "max", "avg")
WINDOWED = ("min", "max", "avg")


class Expr:
    """Base of tree nodes."""

    def children(self) -> list[Expr]:
        return []

    @property
    def depth(self) -> int:
        return 1 + max((c.depth for c in self.children()), default=-1)

    def leaves(self) -> list[str]:
        """Concepts of the leaves, left to right."""
        return [x for c in self.children() for x in c.leaves()]

    def count(self) -> int:
        return 1 + sum(c.count() for c in self.children())


@dataclass(frozen=True)
class Leaf(Expr):
    concept: str

    def leaves(self):
        return [self.concept]


@dataclass(frozen=True)
class Literal(Expr):
    value: float


@dataclass(frozen=True)
class Derived(Expr):
    name: str


@dataclass(frozen=True)
class Node(Expr):
    op: str
    left: Expr
    right: Expr

    def __post_init__(self):
        if self.op not in BINARY:
            raise ValueError(f"unknown operation {self.op}")

    def children(self):
        return [self.left, self.right]


@dataclass(frozen=True)
class Over(Expr):
    """A windowed minimum, maximum or average of an operand over this period and ``back`` earlier ones (None: all)."""

    op: str
    operand: Expr
    back: int | None = None

    def __post_init__(self):
        if self.op not in WINDOWED:
            raise ValueError(f"unknown window operation {self.op}")

    def children(self):
        return [self.operand]


@dataclass(frozen=True)
class Growth(Expr):
    """Growth of an operand against its value ``back`` periods earlier."""

    operand: Expr
    back: int = 1

    def children(self):
        return [self.operand]


@dataclass(frozen=True)
class Concept:
    """A named derived measure: an operation over names of facts or other derived measures."""

    op: str
    args: tuple[str, ...]
    family: str = "amount"


#: Derived measures of the star-schema sheet.
SALES = {
    "net_sales": Concept("diff", ("list_sales", "discounts")),
    "billed": Concept("sum", ("net_sales", "taxes")),
    "gross_profit": Concept("diff", ("net_sales", "catalog_cost")),
    "tax_expense": Concept("mul", ("gross_profit", "tax_rate")),
    "net_income": Concept("diff", ("gross_profit", "tax_expense")),
    "deductions": Concept("sum", ("discounts", "taxes", "returned_sales")),
    "gross_margin": Concept("ratio", ("gross_profit", "net_sales"), "rate"),
}
#: Derived measures of the annual sheet of companies.
ANNUAL = {
    "gross_profit": Concept("diff", ("revenue", "cost_of_goods_sold")),
    "operating_income": Concept("diff", ("gross_profit", "operating_expenses")),
    "pretax_income": Concept("diff", ("operating_income", "non_operating_expenses")),
    "income_tax_expense": Concept("mul", ("pretax_income", "income_tax")),
    "net_income": Concept("diff", ("pretax_income", "income_tax_expense")),
    "current_assets": Concept("sum", ("cash", "accounts_receivable", "inventories", "short_term_investments")),
    "longterm_assets": Concept("diff", ("total_assets", "current_assets")),
    "longterm_liabilities": Concept("diff", ("total_liabilities", "current_liabilities")),
}
#: Derived measures of quarterly filings; capital expenditures are negative there.
QUARTERLY = {
    "gross_profit": Concept("diff", ("total_revenues", "cost_of_sales")),
    "operating_income": Concept("diff", ("total_revenues", "total_costs_and_expenses")),
    "income_before_taxes": Concept("sum", ("operating_income", "other_income_expense_net")),
    "net_income": Concept("diff", ("income_before_taxes", "provision_for_income_taxes")),
    "total_current_assets": Concept("sum", ("cash_and_cash_equivalents", "short_term_investments", "accounts_receivable_net", "inventories", "prepaid_expenses_and_other")),
    "total_assets": Concept("sum", ("total_current_assets", "total_non_current_assets")),
    "total_current_liabilities": Concept("sum", ("accounts_payable", "deferred_revenue_current", "accrued_expenses_and_other", "current_portion_of_long_term_debt")),
    "total_liabilities": Concept("sum", ("total_current_liabilities", "total_non_current_liabilities")),
    "free_cash_flow": Concept("sum", ("net_cash_from_operating", "capital_expenditures")),
    "working_capital": Concept("diff", ("total_current_assets", "total_current_liabilities")),
}


def load_registry(spec: str | dict | list) -> dict[str, Concept]:
    """A registry from a mapping or list of entries, or their JSON; unknown operations and wrong arity are errors."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    entries = {e["name"]: e for e in spec} if isinstance(spec, list) else spec
    out = {}
    for name, e in entries.items():
        args = tuple(e["args"])
        if e["op"] not in ("sum", "diff", "ratio", "mul") or len(args) < 2 or e["op"] != "sum" and len(args) != 2:
            raise ValueError(f"bad definition of {name}")
        out[name] = Concept(e["op"], args, e.get("family", "amount"))
    return out


def fold(op: str, operands: list[Expr], balanced: bool = False) -> Expr:
    """One tree of binary nodes over the operands: a left chain, or halves of even height."""
    if not operands:
        raise ValueError("nothing to fold")
    if not balanced:
        return reduce(lambda a, b: Node(op, a, b), operands)
    half = (len(operands) + 1) // 2
    return operands[0] if len(operands) == 1 else Node(op, fold(op, operands[:half], True), fold(op, operands[half:], True))


def expand(expr: Expr, registry: dict[str, Concept], balanced: bool = False, within: tuple[str, ...] = ()) -> Expr:
    """The tree with derived measures replaced by their definitions; a definition that needs itself is an error."""
    if isinstance(expr, Derived):
        if expr.name in within:
            raise ValueError(f"{expr.name} is defined by itself")
        concept = registry[expr.name]
        named = [Derived(a) if a in registry else Leaf(a) for a in concept.args]
        return fold(concept.op, [expand(a, registry, balanced, (*within, expr.name)) for a in named], balanced)
    if isinstance(expr, Node):
        return Node(expr.op, expand(expr.left, registry, balanced, within), expand(expr.right, registry, balanced, within))
    if isinstance(expr, Over):
        return Over(expr.op, expand(expr.operand, registry, balanced, within), expr.back)
    if isinstance(expr, Growth):
        return Growth(expand(expr.operand, registry, balanced, within), expr.back)
    return expr


def to_json(expr: Expr) -> dict:
    match expr:
        case Leaf(concept):
            return {"leaf": concept, "depth": 0}
        case Literal(value):
            return {"literal": value, "depth": 0}
        case Derived(name):
            return {"derived": name, "depth": 0}
        case Node(op, left, right):
            return {"op": op, "left": to_json(left), "right": to_json(right), "depth": expr.depth}
        case Over(op, operand, back):
            return {"over": op, "operand": to_json(operand), "back": back, "depth": expr.depth}
        case Growth(operand, back):
            return {"growth": to_json(operand), "back": back, "depth": expr.depth}
    raise TypeError(expr)


def from_json(data: str | dict) -> Expr:
    """The tree of a JSON form; unknown shapes, operations and wrong depths are errors."""
    data = json.loads(data) if isinstance(data, str) else data
    if "leaf" in data:
        out: Expr = Leaf(data["leaf"])
    elif "literal" in data:
        out = Literal(float(data["literal"]))
    elif "derived" in data:
        out = Derived(data["derived"])
    elif "op" in data:
        out = Node(data["op"], from_json(data["left"]), from_json(data["right"]))
    elif "over" in data:
        out = Over(data["over"], from_json(data["operand"]), data.get("back"))
    elif "growth" in data:
        out = Growth(from_json(data["growth"]), data.get("back", 1))
    else:
        raise ValueError(f"no expression: {data}")
    if data.get("depth", out.depth) != out.depth:
        raise ValueError(f"stated depth {data['depth']}, found {out.depth}")
    return out


def show(expr: Expr) -> str:
    match expr:
        case Leaf(concept):
            return concept
        case Literal(value):
            return repr(value)
        case Derived(name):
            return name
        case Node(op, left, right):
            return f"{op}({show(left)}, {show(right)})"
        case Over(op, operand, back):
            return f"{op}_over({show(operand)}, {'all' if back is None else back})"
        case Growth(operand, back):
            return f"growth({show(operand)}, {back})"
    raise TypeError(expr)


def sum_terms(expr: Expr) -> list[Expr]:
    """Operands of a chain of sums; stops at other operations and at derived measures."""
    return [*sum_terms(expr.left), *sum_terms(expr.right)] if isinstance(expr, Node) and expr.op == "sum" else [expr]


def canonical(expr: Expr) -> str:
    """Text that is equal for trees that differ in the order of sums and products only."""
    match expr:
        case Node("sum", _, _):
            return "sum(" + ", ".join(sorted(map(canonical, sum_terms(expr)))) + ")"
        case Node("mul" | "min" | "max", left, right):
            return f"{expr.op}(" + ", ".join(sorted((canonical(left), canonical(right)))) + ")"
        case Node(op, left, right):
            return f"{op}({canonical(left)}, {canonical(right)})"
        case Over(op, operand, back):
            return f"{op}_over({canonical(operand)}, {back})"
        case Growth(operand, back):
            return f"growth({canonical(operand)}, {back})"
    return show(expr)


def restates(expr: Expr, registry: dict[str, Concept]) -> str | None:
    """The derived measure whose definition an anonymous tree (or a part of it) spells out."""
    known = {canonical(expand(Derived(n), registry)): n for n in registry}
    if not isinstance(expr, Derived) and (name := known.get(canonical(expand(expr, registry)))):
        return name
    return next((n for c in expr.children() if (n := restates(c, registry))), None)


def is_balanced(expr: Expr) -> bool:
    kids = expr.children()
    return all(map(is_balanced, kids)) and (len(kids) < 2 or abs(kids[0].depth - kids[1].depth) <= 1)


def apply_binary(op: str, left: Column, right: Column, base: str = "right") -> Column:
    """One operation on two columns; NULL where an operand is NULL or a denominator 0."""
    match op:
        case "sum" | "add":
            return left + right
        case "diff" | "subtract":
            return left - right
        case "mul" | "multiply":
            return left * right
        case "ratio" | "divide":
            return F.try_divide(left, right)
        case "growth":
            return F.try_divide(right - left, left) if base == "left" else F.try_divide(left - right, right)
        case "avg" | "average":
            return (left + right) / 2
        case "min" | "max":
            return F.when(left.isNotNull() & right.isNotNull(), (F.least if op == "min" else F.greatest)(left, right))
    raise ValueError(f"unknown operation {op}")


@dataclass
class Compiler:
    """Compiles trees to columns; windows need a sheet with one row an entity and period."""

    registry: dict[str, Concept] = field(default_factory=lambda: dict(SALES))
    entity: str = "entity"
    period: str = "period"
    growth_base: str = "right"

    def column(self, expr: Expr) -> Column:
        return self._column(expand(expr, self.registry))

    def _column(self, expr: Expr) -> Column:
        match expr:
            case Leaf(concept):
                return F.col(concept).cast("double")
            case Literal(value):
                return F.lit(float(value))
            case Node(op, left, right):
                return apply_binary(op, self._column(left), self._column(right), self.growth_base)
            case Over(op, operand, back):
                frame = Window.partitionBy(self.entity).orderBy(self.period).rowsBetween(Window.unboundedPreceding if back is None else -back, 0)
                return {"min": F.min, "max": F.max, "avg": F.avg}[op](self._column(operand)).over(frame)
            case Growth(operand, back):
                now = self._column(operand)
                then = F.lag(now, back).over(Window.partitionBy(self.entity).orderBy(self.period))
                return F.try_divide(now - then, then)
        raise TypeError(expr)

    def evaluate(self, sheet: DataFrame, expr: Expr, name: str = "answer", digits: int = 6) -> DataFrame:
        """(entity, period, answer) for every row where the tree has a value."""
        out = sheet.select(self.entity, self.period, F.round(self.column(expr), digits).alias(name))
        return out.where(F.col(name).isNotNull())

    def derive(self, sheet: DataFrame, names: list[str] | None = None) -> DataFrame:
        """The sheet with a column for each derived measure."""
        return sheet.withColumns({n: self.column(Derived(n)) for n in names or self.registry})


PROGRAM = "array<struct<op: string, v: double>>"


def program(expr: Expr, values: dict[str, float]) -> list[tuple[str, float | None]]:
    """Postfix program of a bound tree, for ``run_programs``."""
    match expr:
        case Leaf(concept):
            return [("push", float(values[concept]))]
        case Literal(value):
            return [("push", float(value))]
        case Node(op, left, right):
            return [*program(left, values), *program(right, values), (op, None)]
    raise TypeError(expr)


def run_programs(code: Column) -> Column:
    """Value of postfix programs, one a row: heterogeneous trees in one pass, on a stack held in an array."""
    empty = F.array().cast("array<double>")

    def step(stack: Column, item: Column) -> Column:
        below, left, right = F.slice(stack, 1, F.greatest(F.size(stack) - 2, F.lit(0))), F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1))
        value = F.lit(None).cast("double")
        for op in BINARY:
            value = F.when(item["op"] == op, apply_binary(op, left, right)).otherwise(value)
        return F.when(item["op"] == "push", F.concat(stack, F.array(item["v"]))).otherwise(F.concat(below, F.array(value)))

    return F.aggregate(code, empty, step, lambda s: F.when(F.size(s) == 1, F.get(s, F.lit(0))))
