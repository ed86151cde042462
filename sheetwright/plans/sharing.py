"""Shared subexpressions of a table of trees: equal subtrees become one node, which is evaluated once for all trees.

A node's signature is a hash of its operation and its operands' signatures, or of its leaf or number, so equal subtrees of any trees have
the same one; operands of sums, products, minima and maxima are put in order first.  Signatures are folded over each tree's own nodes.
The different nodes are then evaluated by height, from the leaves up: what a height costs grows with its different nodes, not with
their uses, and only they meet the facts.  Of trees in JSON (``form_values``) equal texts are parsed and signed once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nodes import _apply, _let, cut, node_arrays, tree_arrays

#: Operations whose operands may be put in any order.
UNORDERED = ["sum", "add", "mul", "min", "max", "avg", "average"]
SIGNED = "struct<sig: string, height: int>"
#: What a signature stands for.
MADE = ["height", "op", "leaf", "literal", "kids"]


def signed(nodes: Column) -> Column:
    """Of a tree's nodes in postorder: signature, height, operation, leaf, number, the operands' signatures and whether it is the root, of each."""
    kinds = "array<struct<post: int, sig: string, height: int, op: string, leaf: string, literal: double, kids: array<string>>>"
    start = F.struct(F.array().cast(f"array<{SIGNED}>").alias("stack"), F.array().cast(kinds).alias("out"))

    def step(s: Column, node: Column) -> Column:
        height, is_op = F.size(s["stack"]), node["arity"] > 0
        own = F.coalesce(F.concat(F.lit("leaf "), node["leaf"]), F.concat(F.lit("number "), node["literal"].cast("string")), F.lit("nothing"))
        below = F.slice(s["stack"], 1, F.greatest(height - node["arity"], F.lit(0)))

        def row(args: Column, kids: Column) -> Column:
            sig = F.md5(F.when(is_op, F.concat(node["op"], F.lit("("), F.array_join(kids, ","), F.lit(")"))).otherwise(own))
            high = F.when(is_op, F.array_max(F.transform(args, lambda a: a["height"])) + 1).otherwise(0)
            return F.struct(node["post"].cast("int").alias("post"), sig.alias("sig"), high.cast("int").alias("height"), node["op"].alias("op"), node["leaf"].alias("leaf"), node["literal"].alias("literal"), kids.alias("kids"))

        def pushed(row: Column) -> Column:
            return F.struct(F.concat(below, F.array(F.struct(row["sig"].alias("sig"), row["height"].alias("height")))).alias("stack"), F.concat(s["out"], F.array(row)).alias("out"))

        in_order = lambda found: F.when(node["op"].isin(*UNORDERED), F.array_sort(found)).otherwise(found)
        args = F.slice(s["stack"], F.greatest(height - node["arity"] + 1, F.lit(1)), node["arity"])
        return _let(args, lambda a: _let(in_order(F.transform(a, lambda x: x["sig"])), lambda kids: _let(row(a, kids), pushed)))

    return F.aggregate(nodes, start, step, lambda s: F.transform(s["out"], lambda x: x.withField("root", x["post"] == F.size(s["out"]))))


def _signed_rows(trees: DataFrame) -> DataFrame:
    """``signatures`` of (tree, nodes), nodes in postorder."""
    # a tree has a node at least; plain ``inline`` would be given a filter that signs the nodes again
    return trees.select("tree", F.inline_outer(signed(F.col("nodes"))))


def signatures(nodes: DataFrame) -> DataFrame:
    """(tree, post, sig, height, op, leaf, literal, kids, root) of every node of ``node_table``."""
    return _signed_rows(tree_arrays(nodes))


def different(signs: DataFrame) -> DataFrame:
    """One row for each different subtree: (sig, height, op, leaf, literal, kids, uses)."""
    return signs.groupBy("sig").agg(*(F.any_value(c).alias(c) for c in MADE), F.count(F.lit(1)).alias("uses"))


def values_of(shared: DataFrame, facts: DataFrame, growth_base: str = "left", highest: int | None = None) -> DataFrame:
    """(sig, value) of the different subtrees; ``facts`` has key and value.  ``highest`` bounds the heights; if it is not given, it is looked up."""
    if highest is None:
        highest = shared.agg(F.max("height")).first()[0] or 0
    leaves = shared.where("height = 0").join(facts.select(F.col("key").alias("leaf"), F.col("value").alias("fact")), "leaf", "left")
    done = cut(leaves.select("sig", F.coalesce("literal", "fact").alias("value")))
    for height in range(1, highest + 1):
        rows = shared.where(F.col("height") == height).select("sig", "op", F.posexplode("kids").alias("at", "kid"))
        found = rows.join(done.select(F.col("sig").alias("kid"), "value"), "kid", "left")
        args = F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])  # a node's operands
        own = found.groupBy("sig", "op").agg(args.alias("args"))
        done = done.unionByName(cut(own.select("sig", _apply(F.struct("op"), F.col("args"), growth_base).alias("value"))))
    return done


def shared_values(nodes: DataFrame, facts: DataFrame, growth_base: str = "left", digits: int = 6) -> DataFrame:
    """(tree, value) of every tree, by way of the different subtrees."""
    signs = signatures(nodes)
    roots = signs.where("root").select("tree", "sig")
    return roots.join(values_of(cut(different(signs)), facts, growth_base), "sig").select("tree", F.round("value", digits).alias("value"))


def _rounded(value: Column, digits: int) -> Column:
    """Rounded as SQL engines round doubles, by way of the scaled double: ``round`` of Spark has other last digits for large values."""
    scaled = F.round(value * 10.0**digits) / 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), scaled).otherwise(value)


def form_values(questions: DataFrame, key: str, form: str, facts: DataFrame, growth_base: str = "left", digits: int = 6, levels: int | None = None) -> DataFrame:
    """(tree, value) of every question, by way of the different subtrees of its tree in JSON; ``levels`` as in ``node_arrays``.

    Equal texts, told by their MD5, are parsed as one: a question itself is a short row that meets the value of its text.
    """
    named = questions.select(F.col(key).alias("tree"), F.col(form).alias("form"))
    text = F.unhex(F.md5("form")).alias("text")
    session = questions.sparkSession
    # a text takes long for its few bytes: partitions sized by bytes, about one a core, would leave cores without work
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), 4 * session.sparkContext.defaultParallelism)
    arrays = node_arrays(named.select("form").distinct().select(text, "form").repartition(parts, "text"), "text", "form", levels)
    fields = lambda x: F.struct(*(x[c].alias(c) for c in ("post", "arity", "op", "leaf", "literal")))
    signs = _signed_rows(arrays.select("tree", F.sort_array(F.transform("nodes", fields)).alias("nodes")))
    # texts are parsed once: of a subtree stays a row for each text that it is the whole of, and one for all others
    kept = cut(signs.groupBy("sig", F.when(F.col("root"), F.col("tree")).alias("text")).agg(*(F.any_value(c).alias(c) for c in MADE)))
    values = values_of(cut(different(kept).drop("uses")), facts, growth_base)
    known = kept.where("text is not null").select("sig", "text").join(values, "sig").select("text", _rounded(F.col("value"), digits).alias("value"))
    return named.select("tree", text).join(known, "text", "left").select("tree", "value")
