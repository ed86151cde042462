"""Sampling of many expression trees at once: each row grows its own tree, level by level, and rejects it or keeps it.

A draw depends on the seed, the tree, the attempt, the node's path and what it is for, and on nothing else, so a tree is the same however
rows are partitioned, and no tree waits for another.  A tree's nodes are an array of its row, in postorder; what rejection needs to know
(depths, leaves, canonical texts) is folded over them with a stack.  A tree takes its first valid attempt, and later ones are not grown,
so nothing is shuffled but what is left of trees that are alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prng import pick, uniform
from .expr import Concept, Derived, canonical, expand, sum_terms

ROW = {"path": "string", "want": "string", "budget": "int", "windows": "boolean", "open": "boolean", "op": "string", "concept": "string", "derived": "string"}
#: First attempts of the batches; the last is the number of attempts.
BATCHES = (0, 6, 40, 200)
FOLD = {
    "form": "string", "own": "string", "own_terms": "array<string>", "whole": "string", "whole_terms": "array<string>", "depth": "int", "whole_depth": "int", "leaves": "array<string>", "balanced": "boolean", "restates": "boolean",
    "derived": "boolean",
}
NAMED = "struct<name: string, depth: int, whole: string, terms: array<string>, leaves: array<string>>"


def _row(**fields: Column) -> Column:
    return F.struct(*(fields.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in ROW.items()))


def _definitions(registry: dict[str, Concept]) -> Column:
    """Of each derived measure: name, depth, canonical text and terms of its expansion, its leaves."""
    out = []
    for name in registry:
        whole = expand(Derived(name), registry)
        texts = lambda items: F.array(*map(F.lit, items))
        out.append(F.struct(F.lit(name).alias("name"), F.lit(whole.depth).alias("depth"), F.lit(canonical(whole)).alias("whole"), texts([canonical(t) for t in sum_terms(whole)]).alias("terms"), texts(whole.leaves()).alias("leaves")))
    return F.array(*out) if out else F.array().cast(f"array<{NAMED}>")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def grown(key: Column, start: Column, seed: int, amounts: list[str], rates: list[str], registry: dict[str, Concept], levels: int, derived_share: float, stop: float) -> Column:
    """The nodes of the tree that starts as ``start`` (a struct of ROW), in postorder, after so many levels; ``key`` is the text of tree and attempt."""
    heights = {n: expand(Derived(n), registry).depth for n, c in registry.items() if c.family == "amount"}
    known = F.array(*(_text_array(*(F.lit(n) for n, depth in heights.items() if depth <= budget)) for budget in range(levels)))

    def opened(n: Column) -> Column:
        draw = lambda what: uniform(seed, key, n["path"], F.lit(what))
        amount, ratio, fit = n["want"] == "amount", n["want"] == "ratio", known[n["budget"]]

        def made(ends: Column) -> Column:
            derived = F.when(ends & (F.size(fit) > 0) & (draw("derived") < derived_share), F.get(fit, F.floor(draw("which") * F.size(fit)).cast("int")))
            own = F.when(n["windows"], pick(["sum", "diff", "mul", "min", "max", "avg"], draw("op"))).otherwise(pick(["sum", "diff", "mul"], draw("op")))
            return F.struct(F.when(ratio, pick(["ratio", "growth"], draw("op"))).when(amount & ~ends, own).alias("op"), derived.alias("derived"))

        def kids(m: Column) -> Column:
            op, derived = m["op"], m["derived"]
            single = op.isNull() | op.isin("min", "max", "avg", "growth")
            concept = F.when(n["want"] == "rate", pick(rates, draw("which"))).when(single & derived.isNull(), pick(amounts, draw("which")))
            closed = _row(path=n["path"], want=n["want"], budget=n["budget"], windows=n["windows"], open=F.lit(False), op=op, concept=concept, derived=derived)
            kid = lambda at, want, windows: _row(path=F.concat(n["path"], F.lit(at)), want=want, budget=n["budget"] - 1, windows=windows, open=F.lit(True))
            inherited = n["windows"] & (op != "ratio")
            second = F.when(op != "mul", "amount").when(n["budget"] > 1, "ratio").otherwise("rate")
            return F.when(single, F.array(closed)).otherwise(F.array(kid("0", F.lit("amount"), inherited), kid("1", second, inherited), closed))

        return _let(amount & ((n["budget"] == 0) | (draw("stop") < stop)), lambda ends: _let(made(ends), kids))

    level = lambda nodes, _: F.flatten(F.transform(nodes, lambda n: F.when(n["open"], opened(n)).otherwise(F.array(n))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.array(start), level)


def _text_array(*items: Column) -> Column:
    return F.array(*items).cast("array<string>")


def _definition(definitions: Column, name: Column) -> Column:
    return F.get(F.filter(definitions, lambda d: d["name"] == name), F.lit(0))


def _fold(**fields: Column) -> Column:
    return F.struct(*(fields[c].cast(kind).alias(c) for c, kind in FOLD.items()))


def folded(nodes: Column, registry: dict[str, Concept], definitions: Column) -> Column:
    """What is known of a tree from its nodes in postorder: its JSON form, canonical texts, depths, leaves, and flags."""
    spelled = [canonical(expand(Derived(n), registry)) for n in registry]
    no, yes = F.lit(False), F.lit(True)

    def leaf(node: Column) -> Column:
        concept, op = node["concept"], node["op"]
        plain = F.concat(F.lit('{"leaf": "'), concept, F.lit('", "depth": 0}'))
        over = F.concat(op, F.lit("_over("), concept, F.lit(", None)"))
        growth = F.concat(F.lit("growth("), concept, F.lit(", 1)"))
        shown = F.when(op == "growth", growth).when(op.isNotNull(), over).otherwise(concept)
        form = (
            F.when(op == "growth", F.concat(F.lit('{"growth": '), plain, F.lit(', "back": 1, "depth": 1}')))
            .when(op.isNotNull(), F.concat(F.lit('{"over": "'), op, F.lit('", "operand": '), plain, F.lit(', "back": null, "depth": 1}'))).otherwise(plain)
        )
        depth = F.when(op.isNotNull(), 1).otherwise(0)
        own = _fold(form=form, own=shown, own_terms=_text_array(shown), whole=shown, whole_terms=_text_array(shown), depth=depth, whole_depth=depth, leaves=_text_array(concept), balanced=yes, restates=no, derived=no)
        name = node["derived"]
        named = lambda found: _fold(
            form=F.concat(F.lit('{"derived": "'), name, F.lit('", "depth": 0}')), own=name, own_terms=_text_array(name), whole=found["whole"], whole_terms=found["terms"], depth=F.lit(0), whole_depth=found["depth"],
            leaves=found["leaves"], balanced=yes, restates=no, derived=yes,
        )
        return F.when(name.isNotNull(), _let(_definition(definitions, name), named)).otherwise(own)

    def pair(op: Column, a: Column, b: Column) -> Column:
        def text(terms: Column, left: Column, right: Column) -> Column:
            listed = F.when(op == "sum", F.array_sort(terms)).when(op == "mul", F.array_sort(F.array(left, right))).otherwise(F.array(left, right))
            return F.concat(op, F.lit("("), F.array_join(listed, ", "), F.lit(")"))

        own_terms, whole_terms = F.concat(a["own_terms"], b["own_terms"]), F.concat(a["whole_terms"], b["whole_terms"])
        texts = F.struct(text(own_terms, a["own"], b["own"]).alias("own"), text(whole_terms, a["whole"], b["whole"]).alias("whole"), (F.greatest(a["depth"], b["depth"]) + 1).alias("depth"))

        def made(t: Column) -> Column:
            own, whole, depth = t["own"], t["whole"], t["depth"]
            form = F.concat(F.lit('{"op": "'), op, F.lit('", "left": '), a["form"], F.lit(', "right": '), b["form"], F.lit(', "depth": '), depth.cast("string"), F.lit("}"))
            return _fold(
                form=form, own=own, own_terms=F.when(op == "sum", own_terms).otherwise(F.array(own)), whole=whole, whole_terms=F.when(op == "sum", whole_terms).otherwise(F.array(whole)), depth=depth,
                whole_depth=F.greatest(a["whole_depth"], b["whole_depth"]) + 1, leaves=F.concat(a["leaves"], b["leaves"]), balanced=a["balanced"] & b["balanced"] & (F.abs(a["depth"] - b["depth"]) <= 1),
                restates=a["restates"] | b["restates"] | (whole.isin(*spelled) if spelled else no), derived=a["derived"] | b["derived"],
            )

        return _let(texts, made)

    def step(stack: Column, node: Column) -> Column:
        single = node["concept"].isNotNull() | node["derived"].isNotNull()
        below = F.slice(stack, 1, F.greatest(F.size(stack) - 2, F.lit(0)))
        both = pair(node["op"], F.try_element_at(stack, F.lit(-2)), F.try_element_at(stack, F.lit(-1)))
        return F.when(single, F.concat(stack, F.array(leaf(node)))).otherwise(F.concat(below, F.array(both)))

    empty = F.array().cast("array<struct<" + ", ".join(f"{c}: {t}" for c, t in FOLD.items()) + ">>")
    return F.get(F.aggregate(nodes, empty, step), F.lit(0))


def first_valid(
    tree: Column, seed: int, depths: tuple[int, int], amounts: list[str], rates: list[str], registry: dict[str, Concept], balanced: bool, require_derived: bool, derived_share: float, stop: float
) -> Column:
    """The first valid attempt of a tree: a struct of attempt, form, canonical and depth, all null if there is none."""
    definitions = _definitions(registry)
    nothing = F.lit(None).cast("struct<attempt: int, form: string, canonical: string, depth: int>")

    def leaves(nodes: Column) -> Column:
        named = lambda n: F.coalesce(_definition(definitions, n["derived"])["leaves"], _text_array())
        return F.flatten(F.transform(nodes, lambda n: F.when(n["concept"].isNotNull(), _text_array(n["concept"])).otherwise(named(n))))

    def judged(attempt: Column, f: Column) -> Column:
        fits = f["whole_depth"].between(*depths) & ~f["restates"]
        fits = fits & f["balanced"] if balanced else fits
        fits = fits & f["derived"] if require_derived else fits
        return F.when(fits, F.struct(attempt.alias("attempt"), f["form"].alias("form"), f["own"].alias("canonical"), f["whole_depth"].alias("depth"))).otherwise(nothing)

    def tried(attempt: Column) -> Column:
        def rooted(key: Column) -> Column:
            draw = lambda what: uniform(seed, key, F.lit(""), F.lit(what))
            budget = F.lit(depths[0]) + F.floor(draw("depth") * (depths[1] - depths[0] + 1)).cast("int")
            want = lambda start: F.when((start > 0) & (draw("root") < 0.3), "ratio").otherwise("amount")
            top = lambda start: _row(path=F.lit(""), want=want(start), budget=start, windows=F.lit(True), open=F.lit(True))
            nodes = grown(key, _let(budget, top), seed, amounts, rates, registry, depths[1] + 1, derived_share, stop)
            # most trees that fail have a leaf twice, which is known without their texts
            once = lambda ns: _let(leaves(ns), lambda found: F.size(found) == F.size(F.array_distinct(found)))
            return _let(nodes, lambda ns: F.when(once(ns), _let(folded(ns, registry, definitions), lambda f: judged(attempt, f))).otherwise(nothing))

        return _let(F.concat_ws("/", F.coalesce(tree.cast("string"), F.lit("")), attempt.cast("string")), rooted)

    def within(found: Column, first: Column, end: Column) -> Column:
        return F.aggregate(F.sequence(first, end - 1), found, lambda best, attempt: F.when(best["attempt"].isNotNull(), best).otherwise(tried(attempt)))

    batches = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("end")) for a, b in zip(BATCHES, BATCHES[1:], strict=False)))
    return F.aggregate(batches, nothing, lambda best, batch: F.when(best["attempt"].isNotNull(), best).otherwise(within(best, batch["first"], batch["end"])))


def sample_trees(
    trees: DataFrame, seed: int, depths: tuple[int, int], amounts: list[str], rates: list[str], registry: dict[str, Concept], balanced: bool = False, require_derived: bool = False, distinct: bool = True,
    derived_share: float = 0.3, stop: float = 0.35,
) -> DataFrame:
    """A valid tree for each row of ``trees`` (tree): (tree, attempt, form, canonical, depth).

    Valid trees have an expanded depth within ``depths``, no leaf twice, and no part that spells out a derived measure.  A tree that has no
    valid attempt among BATCHES[-1] has no row.  With ``distinct``, of trees that differ in the order of sums and products only, the
    smallest number stays.
    """
    if not 0 <= depths[0] <= depths[1] or not 0 <= derived_share <= 1 or require_derived and depths[1] == 0:
        raise ValueError("bad depths or share")
    best = first_valid(F.col("tree"), seed, depths, amounts, rates, registry, balanced, require_derived, derived_share, stop)
    # a narrow table of keys is few tasks where it is read, but much work
    dealt = trees.select("tree").repartition(int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = dealt.select("tree", F.inline(F.filter(F.array(best), lambda b: b["attempt"].isNotNull())))
    if not distinct:
        return found
    return found.groupBy("canonical").agg(F.min_by(F.struct("tree", "attempt", "form", "depth"), "tree").alias("best")).select("best.tree", "best.attempt", "best.form", "canonical", "best.depth")
