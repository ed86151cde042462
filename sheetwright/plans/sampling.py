"""Reproducible sampling of expression trees: plan generation on the driver, not data."""

from __future__ import annotations

import hashlib

from .expr import Concept, Derived, Expr, Growth, Leaf, Node, Over, canonical, expand, is_balanced, restates


class Draws:
    """A stream of portable draws."""

    def __init__(self, seed: int):
        self.seed, self.n = seed, 0

    def uniform(self) -> float:
        self.n += 1
        return int(hashlib.md5(f"{self.seed}/{self.n}".encode()).hexdigest()[:8], 16) / 4294967296.0

    def pick(self, items: list):
        return items[int(self.uniform() * len(items))]


def terminal(draws: Draws, amounts: list[str], registry: dict[str, Concept], depth: int, derived_share: float) -> Expr:
    """A fact, or with some probability a derived measure whose definition fits the depth."""
    fit = [n for n, c in registry.items() if c.family == "amount" and expand(Derived(n), registry).depth <= depth]
    return Derived(draws.pick(fit)) if fit and draws.uniform() < derived_share else Leaf(draws.pick(amounts))


def amount_tree(draws: Draws, depth: int, amounts: list[str], rates: list[str], registry: dict[str, Concept], derived_share: float = 0.3, stop: float = 0.35, windows: bool = True) -> Expr:
    if depth == 0 or draws.uniform() < stop:
        return terminal(draws, amounts, registry, depth, derived_share)
    op = draws.pick(["sum", "diff", "mul", *(["min", "max", "avg"] if windows else [])])
    grow = lambda d: amount_tree(draws, d, amounts, rates, registry, derived_share, stop, windows)
    if op in ("min", "max", "avg"):
        return Over(op, Leaf(draws.pick(amounts)))
    if op == "mul":
        scale = ratio_tree(draws, depth - 1, amounts, rates, registry, derived_share=derived_share, stop=stop) if depth > 1 else Leaf(draws.pick(rates))
        return Node("mul", grow(depth - 1), scale)
    return Node(op, grow(depth - 1), grow(depth - 1))


def ratio_tree(draws: Draws, depth: int, amounts: list[str], rates: list[str], registry: dict[str, Concept], **options) -> Expr:
    if draws.pick(["ratio", "growth"]) == "growth":
        return Growth(Leaf(draws.pick(amounts)))
    return Node("ratio", amount_tree(draws, depth - 1, amounts, rates, registry, windows=False, **options), amount_tree(draws, depth - 1, amounts, rates, registry, windows=False, **options))


def sample(
    seed: int, count: int, depths: tuple[int, int], amounts: list[str], rates: list[str], registry: dict[str, Concept], balanced: bool = False, require_derived: bool = False, tries: int = 200
) -> list[Expr]:
    """Different valid trees within a depth range: no tree that spells out a derived measure, none twice.

    Trees are over-generated and filtered; ``balanced`` keeps height-balanced ones, ``require_derived`` those that use a
    derived measure.
    """
    if count < 1 or not 0 <= depths[0] <= depths[1]:
        raise ValueError("bad count or depths")
    draws, found = Draws(seed), {}
    for _ in range(tries * count):
        depth = depths[0] + int(draws.uniform() * (depths[1] - depths[0] + 1))
        build = ratio_tree if depth and draws.uniform() < 0.3 else amount_tree
        tree = build(draws, depth, amounts, rates, registry)
        names = _derived(tree)
        whole = expand(tree, registry)
        leaves = whole.leaves()
        if not depths[0] <= whole.depth <= depths[1] or restates(tree, registry) or balanced and not is_balanced(tree) or require_derived and not names or len(set(leaves)) != len(leaves):
            continue
        found.setdefault(canonical(tree), tree)
        if len(found) == count:
            break
    return list(found.values())


def _derived(tree: Expr) -> set[str]:
    return {tree.name} if isinstance(tree, Derived) else {n for c in tree.children() for n in _derived(c)}
