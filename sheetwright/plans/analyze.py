"""Type rules of bound expressions, and what a valid expression means.

A bound tree's leaves are facts with entity, period, unit and semantic type.  ``analyze`` returns the meaning of the tree
or raises ``Rejected``: amounts only add up where they belong together.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


class Rejected(ValueError):
    """The expression has no consistent meaning."""


@dataclass(frozen=True)
class Fact:
    concept: str
    semantic_type: str
    entity: str
    period: str
    unit: str
    parent: str | None = None
    role: str | None = None

    @property
    def label(self) -> str:
        return self.concept.replace("_", " ") or "value"


@dataclass(frozen=True)
class Meaning:
    kind: str
    semantic_type: str
    text: str
    entity: str | None = None
    period: str | None = None
    unit: str | None = None
    concept: str | None = None
    from_period: str | None = None
    to_period: str | None = None


#: A bound tree: a fact, a number, or (operation, operands...).
Bound = Fact | float | tuple


def _context(a: Meaning, b: Meaning) -> bool:
    return a.entity == b.entity and a.period == b.period and a.entity is not None


def _terms(tree: Bound) -> list[Bound]:
    return [t for x in tree[1:] for t in _terms(x)] if isinstance(tree, tuple) and tree[0] == "sum" else [tree]


def analyze(tree: Bound, siblings: dict[tuple[str | None, str | None], set[str]] | None = None) -> Meaning:
    """``siblings`` has, by (parent, role), all concepts of the sheet: a sum of all components is their parent's total."""
    if isinstance(tree, Fact):
        return Meaning("leaf_metric", tree.semantic_type, f"{tree.label} for {tree.entity} in {tree.period}", tree.entity, tree.period, tree.unit, tree.concept)
    if not isinstance(tree, tuple):
        return Meaning("literal_scalar", "ratio", repr(tree))
    op, *operands = tree
    rule = {"sum": _sum, "diff": _diff, "ratio": _ratio, "mul": _mul, "growth": _growth, "min": _extreme, "max": _extreme, "avg": _average}.get(op)
    if rule is None:
        raise Rejected(f"unknown operation {op}")
    return rule(op, operands, [analyze(x, siblings) for x in operands], siblings or {})


def _amounts(op: str, found: list[Meaning]) -> None:
    if any(m.semantic_type != "amount" for m in found):
        raise Rejected(f"{op} takes amounts")
    if len({m.unit for m in found}) > 1:
        raise Rejected(f"{op} takes one unit")


def _sum(op, operands, found, siblings):
    _amounts(op, found)
    terms = [t for x in operands for t in _terms(x)]
    first = found[0]
    same = all(_context(first, m) for m in found)
    if same and all(isinstance(t, Fact) and t.role == "component" for t in terms):
        parents = {(t.parent, t.role) for t in terms}
        names = [t.concept for t in terms]
        if len(parents) == 1 and len(set(names)) == len(names) and len(names) > 1 and set(names) == siblings.get(next(iter(parents))):
            parent = terms[0].parent
            return Meaning("aggregate_components", "amount", f"total {parent} for {first.entity} in {first.period}", first.entity, first.period, first.unit, parent)
    if same:
        return Meaning("sum_amount", "amount", f"sum of {' and '.join(m.text for m in found)}", first.entity, first.period, first.unit)
    if all(m.entity == first.entity for m in found):
        return Meaning("sum_amounts", "amount", f"sum of {' and '.join(m.text for m in found)}", first.entity, None, first.unit)
    raise Rejected("sum takes one entity")


def _diff(op, operands, found, siblings):
    a, b = found
    _amounts(op, found)
    if not _context(a, b):
        raise Rejected("diff takes one entity and period")
    return Meaning("difference", "amount", f"difference between {a.text} and {b.text}", a.entity, a.period, a.unit)


def _ratio(op, operands, found, siblings):
    a, b = found
    terms = _terms(operands[0])
    if b.kind == "literal_scalar" and len(terms) == operands[1] and all(isinstance(t, Fact) for t in terms) and len({(t.concept, t.entity) for t in terms}) == 1 and len({t.period for t in terms}) == len(terms):
        return _average("avg", terms, [analyze(t) for t in terms], siblings)
    _amounts(op, found)
    if a.entity != b.entity or a.entity is None:
        raise Rejected("ratio takes one entity")
    return Meaning("ratio", "ratio", f"ratio of {a.text} to {b.text}", a.entity, a.period if a.period == b.period else None, "ratio")


def _mul(op, operands, found, siblings):
    amount = next((m for m in found if m.semantic_type == "amount"), None)
    factor = next((m for m in found if m.semantic_type in ("ratio", "rate")), None)
    if amount is None or factor is None:
        raise Rejected("mul takes an amount and a ratio or rate")
    if factor.entity is not None and factor.entity != amount.entity:
        raise Rejected("mul takes one entity")
    return replace(amount, kind="scaled_amount", text=f"result of {amount.text} scaled by {factor.text}", concept=None)


def _growth(op, operands, found, siblings):
    a, b = found
    if a.entity != b.entity or a.unit != b.unit or a.entity is None:
        raise Rejected("growth takes one entity and unit")
    if a.concept is not None and a.concept == b.concept:
        if a.period == b.period:
            raise Rejected("growth takes two periods")
        early, late = sorted((a.period, b.period))
        return Meaning("growth_rate", "ratio", f"growth in {a.concept.replace('_', ' ')} for {a.entity} from {early} to {late}", a.entity, late, "ratio", a.concept, early, late)
    return Meaning("growth_rate_composed", "ratio", f"growth between {a.text} and {b.text}", a.entity, None, "ratio")


def _over_time(op: str, found: list[Meaning]) -> Meaning | None:
    periods = [m.period for m in found]
    if len({(m.concept, m.entity) for m in found}) == 1 and found[0].concept and len(set(periods)) == len(periods) >= 2:
        word = {"min": "minimum", "max": "maximum", "avg": "average"}[op]
        first, last = min(periods), max(periods)
        text = f"the {word} of {found[0].concept.replace('_', ' ')} for {found[0].entity} using values from {first} through {last}"
        return Meaning(f"{op}_over_time", found[0].semantic_type, text, found[0].entity, last, found[0].unit, found[0].concept, first, last)
    return None


def _extreme(op, operands, found, siblings):
    if over := _over_time(op, found):
        return over
    _amounts(op, found)
    if len({m.entity for m in found}) > 1:
        raise Rejected(f"{op} takes one entity")
    word = {"min": "minimum", "max": "maximum"}[op]
    periods = {m.period for m in found}
    return Meaning(f"{op}_amounts", "amount", f"the {word} of {' and '.join(m.text for m in found)}", found[0].entity, periods.pop() if len(periods) == 1 else None, found[0].unit)


def _average(op, operands, found, siblings):
    over = _over_time("avg", found)
    if over is None:
        raise Rejected("avg takes one measure at several periods")
    return over


#: What the difference of two measures of one date is called.
IDENTITIES = {("assets", "liabilities"): "equity"}


def analyze_prototype(tree: Bound, siblings: dict[tuple[str | None, str | None], set[str]] | None = None) -> Meaning:
    """The meaning of a tree with the kinds that take precedence in prototypes: identities, changes over time, growth as a
    change over its base, and products of amounts; other trees have their usual meaning."""
    if isinstance(tree, tuple) and len(tree) == 3 and tree[0] in ("diff", "ratio", "mul"):
        a, b = (analyze_prototype(x, siblings) for x in tree[1:])
        amounts = a.semantic_type == b.semantic_type == "amount"
        if tree[0] == "diff" and amounts and _context(a, b) and (name := IDENTITIES.get((a.concept, b.concept))):
            return Meaning("named_identity", "amount", f"{name} of {a.entity} in {a.period}", a.entity, a.period, a.unit, name)
        alike = a.concept is not None and (a.concept, a.entity, a.unit) == (b.concept, b.entity, b.unit)
        if tree[0] == "diff" and amounts and alike and a.period != b.period:
            text = f"change in {a.concept.replace('_', ' ')} for {a.entity} from {b.period} to {a.period}"
            return Meaning("change_over_time", "amount", text, a.entity, None, a.unit, a.concept, b.period, a.period)
        if tree[0] == "ratio" and a.kind == "change_over_time" and alike and a.from_period == b.period:
            text = f"growth rate of {b.concept.replace('_', ' ')} for {b.entity} from {a.from_period} to {a.to_period}"
            return Meaning("growth_rate", "ratio", text, b.entity, None, "ratio", b.concept, a.from_period, a.to_period)
        if tree[0] == "mul" and amounts:
            return Meaning("product_amounts", "amount", f"product of {a.text} and {b.text}", a.entity if a.entity == b.entity else None, None, a.unit if a.unit == b.unit else None)
    return analyze(tree, siblings)
