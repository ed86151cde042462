"""Expression trees as rows: tables of trees that all differ are parsed, evaluated and cut into turns in one plan.

``node_table`` makes one row a node of trees in JSON.  Every level of the descent is a projection that puts each node's children behind
it, each node parsed once, so it shuffles nothing; a node is known by its path, the places of its ancestors among their siblings.

A tree's array is so in preorder, and subtrees' sizes are summed from its end; number, size and level give the postorder number.  A
subtree is an interval of postorder numbers, and its nodes are a slice of the tree's array.  ``evaluated`` runs over that array with a stack, once, and gives the value of every
node.  Only a tree's own nodes are ever gathered.

JSON forms: ``{"leaf": key}``, ``{"literal": number}``, ``{"op": name, "left": .., "right": ..}``, ``{"op": name, "args": [.. or keys]}``,
``{"derived": name, "expanded": ..}`` (the expansion, which keeps the name).  Anything else is a node without operation, leaf or
literal, whose value is NULL; of a name that an object repeats the last counts.  A missing operand, a zero denominator and an unknown operation give NULL, and so does everything above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an operation is called in a turn's question.
WORDS = {
    "max": "maximum", "min": "minimum", "average": "average", "avg": "average", "growth": "growth", "sum": "sum", "diff": "difference", "ratio": "ratio", "add": "sum",
    "subtract": "difference", "divide": "ratio", "mul": "product",
}
#: Operations over different measures: as a tree's root they are asked by the tree's own question.
CROSS = ["mul", "add", "subtract", "divide", "sum", "diff", "ratio"]
#: So many facts are broadcast.
FEW = 65536
#: The fields of a node's object that are read.
FIELDS = ["expanded", "derived", "leaf", "literal", "left", "right", "args", "op"]
NODE = {"path": "array<int>", "parent_op": "string", "text": "string", "open": "boolean", "op": "string", "leaf": "string", "literal": "double", "derived": "string", "arity": "int"}


def nesting(form: Column) -> Column:
    """How deep the braces of a JSON text are nested at most; braces in strings may make it more."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, brace: Column) -> Column:
        now = s["now"] + F.when(brace == "{", 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(F.regexp_extract_all(form, F.lit("[{}]"), F.lit(0)), start, step, lambda s: s["most"])


def _node(**fields: Column) -> Column:
    return F.struct(*(fields.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in NODE.items()))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is made once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _read(text: Column) -> Column:
    """The fields of a JSON object, each as text; of anything else none."""
    return F.from_json(F.when(F.ltrim(text).startswith("{"), text), "struct<" + ", ".join(f"{c}: string" for c in FIELDS) + ">")


def _expansion(body: Column) -> Column:
    """The fields of what an object expands to, itself if it does not; its name where the expansion has none."""
    named = lambda inner: F.struct(*(F.coalesce(body[c], inner[c]).alias(c) if c == "derived" else inner[c].alias(c) for c in FIELDS))
    return F.when(body["expanded"].isNull(), body).otherwise(_let(_read(body["expanded"]), named))


def _opened(node: Column) -> Column:
    """A node, and its children behind it, open; a node that is not open stays."""

    def family(body: Column) -> Column:
        is_key = ~node["text"].startswith("{") & (F.size(node["path"]) > 0)
        leaf, literal = F.when(is_key, node["text"]).otherwise(body["leaf"]), body["literal"]
        pair = F.when(body["left"].isNotNull() & body["right"].isNotNull(), F.array(body["left"], body["right"])).otherwise(F.from_json(body["args"], "array<string>"))
        kids = F.when(leaf.isNull() & literal.isNull(), F.filter(pair, lambda x: x.isNotNull()))

        def made(kids: Column) -> Column:
            op = F.when(F.size(kids) > 0, body["op"])
            closed = _node(path=node["path"], parent_op=node["parent_op"], open=F.lit(False), op=op, leaf=leaf, literal=F.when(leaf.isNull(), literal.try_cast("double")), derived=body["derived"], arity=F.size(kids))
            return F.concat(F.array(closed), F.transform(kids, lambda x, i: _node(path=F.concat(node["path"], F.array(i)), parent_op=body["op"], text=x, open=F.lit(True))))

        return _let(F.coalesce(kids, F.array().cast("array<string>")), made)

    # an expansion may be one more time expanded
    read = _let(_let(_let(_read(node["text"]), _expansion), _expansion), family)
    return F.when(node["open"], read).otherwise(F.array(node))


def _sizes(nodes: Column) -> Column:
    """The sizes of the subtrees of a tree's nodes in preorder, from the last to the first, by one pass with a stack."""
    none = F.array().cast("array<int>")
    start = F.struct(none.alias("stack"), none.alias("out"))

    def step(s: Column, node: Column) -> Column:
        arity, height = F.coalesce(node["arity"], F.lit(0)), F.size(s["stack"])
        size = F.aggregate(F.slice(s["stack"], F.greatest(height - arity + 1, F.lit(1)), arity), F.lit(1), lambda a, x: a + x)
        return _let(size, lambda n: F.struct(F.concat(F.slice(s["stack"], 1, F.greatest(height - arity, F.lit(0))), F.array(n)).alias("stack"), F.concat(s["out"], F.array(n)).alias("out")))

    return F.aggregate(F.reverse(nodes), start, step, lambda s: s["out"])


def node_arrays(questions: DataFrame, key: str, form: str, levels: int | None = None) -> DataFrame:
    """(tree, nodes): the nodes of each question's tree in preorder, with their numbers ``level``, ``post`` and ``size``; ``key`` is a question's own.

    ``levels`` bounds the depth of all trees; if it is not given, the deepest is looked up.
    """
    if levels is None:
        levels = (questions.agg(F.max(nesting(F.col(form)))).first()[0] or 0) + 1
    top = _node(path=F.array().cast("array<int>"), text=F.col(form), open=F.lit(True))
    rows = questions.select(F.col(key).alias("tree"), F.array(top).alias("nodes"))
    for _ in range(levels):
        rows = rows.select("tree", F.flatten(F.transform("nodes", _opened)).alias("nodes"))

    # children stand behind their parent, so nodes are in preorder
    def numbered(nodes: Column, sizes: Column) -> Column:
        def number(x: Column, i: Column) -> Column:
            size, level = F.get(sizes, i), F.size(x["path"])
            return F.struct(x["path"].alias("path"), level.alias("level"), (i + size - level).alias("post"), size.alias("size"), *(x[c].alias(c) for c in ("op", "parent_op", "leaf", "literal", "derived", "arity")))

        return F.transform(nodes, number)

    # in one expression: a column that a lambda of a later step reads may be made once for each element
    return rows.select("tree", _let(F.col("nodes"), lambda nodes: _let(F.reverse(_sizes(nodes)), lambda sizes: numbered(nodes, sizes))).alias("nodes"))


def node_table(questions: DataFrame, key: str, form: str, levels: int | None = None) -> DataFrame:
    """(tree, path, level, post, size, op, parent_op, leaf, literal, derived, arity), one row a node of ``node_arrays``."""
    # a tree has a node at least; plain ``inline`` would be given a filter that makes the nodes again
    return node_arrays(questions, key, form, levels).select("tree", F.inline_outer("nodes"))


def cut(rows: DataFrame) -> DataFrame:
    """``rows`` written to the session's checkpoint folder and read again, where it has one: what is built on them does not repeat their plan."""
    return rows.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else rows


def counted(facts: DataFrame) -> DataFrame:
    """``facts``, to be broadcast if they are few: Spark cannot tell how many rows their aggregates leave, and would shuffle all nodes."""
    rows = cut(facts)
    return F.broadcast(rows) if rows.count() <= FEW else rows


def bound(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """Nodes with the facts of their leaves; ``facts`` has ``key``, once each, and ``value``; its other columns are added."""
    known = counted(facts.withColumnRenamed("key", "leaf").withColumnRenamed("value", "fact_value"))
    return nodes.join(known, "leaf", "left").withColumn("value", F.coalesce("literal", "fact_value")).drop("fact_value")


def leaf_rows(nodes: DataFrame, leaves: DataFrame, key: str) -> DataFrame:
    """The same with a leaf table of each question (key, leaf_key, value, ..), as ``leaf_map`` makes it."""
    known = leaves.withColumnsRenamed({key: "tree", "leaf_key": "leaf", "value": "fact_value"}).dropDuplicates(["tree", "leaf"])
    return nodes.join(known, ["tree", "leaf"], "left").withColumn("value", F.coalesce("literal", "fact_value")).drop("fact_value")


def tree_arrays(nodes: DataFrame) -> DataFrame:
    """(tree, nodes): a tree's nodes in postorder; only the nodes of one tree are gathered."""
    rest = [c for c in nodes.columns if c not in ("tree", "post")]
    return nodes.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("post", *rest))).alias("nodes"))


def _apply(node: Column, args: Column, growth_base: str) -> Column:
    """A node's value from its operands' values."""
    first, second = F.get(args, F.lit(0)), F.get(args, F.lit(1))
    total = F.aggregate(args, F.lit(0.0), lambda a, x: a + x)
    two = F.size(args) == 2
    change = F.try_divide(second - first, first) if growth_base == "left" else F.try_divide(first - second, second)
    op = node["op"]
    made = (
        F.when(op.isin("sum", "add"), total).when(op == "min", F.array_min(args)).when(op == "max", F.array_max(args)).when(op.isin("avg", "average"), total / F.size(args))
        .when(two & op.isin("diff", "subtract"), first - second).when(two & op.isin("ratio", "divide"), F.try_divide(first, second)).when(two & (op == "mul"), first * second).when(two & (op == "growth"), change)
    )
    return F.when(~F.exists(args, lambda x: x.isNull()), made)


def evaluated(nodes: Column, growth_base: str = "left") -> Column:
    """The values of a tree's nodes, in postorder, by one pass with a stack.

    ``growth_base`` says which operand growth is measured against: in turns the left one.
    """
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("stack"), none.alias("out"))

    def step(s: Column, node: Column) -> Column:
        arity, height = node["arity"], F.size(s["stack"])
        args = F.slice(s["stack"], F.greatest(height - arity + 1, F.lit(1)), arity)
        value = F.when(arity == 0, node["value"]).otherwise(_apply(node, args, growth_base))
        below = F.slice(s["stack"], 1, F.greatest(height - arity, F.lit(0)))
        return F.struct(F.concat(below, F.array(value)).alias("stack"), F.concat(s["out"], F.array(value)).alias("out"))

    return F.aggregate(nodes, start, step, lambda s: s["out"])


def first_known(leaves: Column, field: str) -> Column:
    return F.get(F.filter(F.transform(leaves, lambda x: x[field]), lambda v: v.isNotNull() & (v != "")), F.lit(0))


def facts_below(nodes: Column, node: Column) -> Column:
    """What a node's subtree is about: (years, concept, entity); years in order, each once; the others of the first leaf that has one."""
    leaves = F.filter(F.slice(nodes, node["post"] - node["size"] + 1, node["size"]), lambda x: x["leaf"].isNotNull())
    years = F.array_sort(F.array_distinct(F.array_compact(F.transform(leaves, lambda x: x["period"].try_cast("int")))))
    return F.struct(years.alias("years"), first_known(leaves, "concept").alias("concept"), first_known(leaves, "entity").alias("entity"))


def tree_turns(nodes: DataFrame, questions: DataFrame, key: str = "question_id", digits: int = 6) -> DataFrame:
    """One row a turn of every tree: (key, turn_number, op, question, ground_truth, is_final).

    ``nodes`` are bound ones with ``concept``, ``entity`` and ``period``.  Turns come in postorder; leaves have none, nor has a minimum
    right below a minimum, or a maximum below a maximum.  A root over different measures asks the whole question; a named
    expansion asks for its name, and others by their operation, first and last year.  A turn about no year has no text.
    """
    trees = tree_arrays(nodes).withColumn("values", evaluated(F.col("nodes")))
    paired = F.zip_with("nodes", F.col("values"), lambda x, v: F.struct(x.alias("node"), v.alias("value")))
    nested = lambda n: n["op"].isin("min", "max") & n["parent_op"].eqNullSafe(n["op"])
    asked = F.filter(paired, lambda x: (x["node"]["arity"] > 0) & ~nested(x["node"]))
    asked = F.transform(asked, lambda x: F.struct(x["node"].alias("node"), facts_below(F.col("nodes"), x["node"]).alias("about"), x["value"].alias("value")))
    rows = trees.select("tree", F.posexplode(asked).alias("at", "x")).withColumnRenamed("tree", key)
    node, years = F.col("x.node"), F.col("x.about.years")
    words = F.create_map(*(F.lit(t) for pair in WORDS.items() for t in pair))
    who = F.concat(F.lit(" for "), F.coalesce("x.about.entity", F.lit("")))
    named = F.concat(F.lit("What is "), F.replace(node["derived"], F.lit("_"), F.lit(" ")), who, F.lit(" in "), F.get(years, F.lit(0)).cast("string"), F.lit("?"))
    first, last = F.get(years, F.lit(0)).cast("string"), F.try_element_at(years, F.lit(-1)).cast("string")
    other = F.concat(F.lit("What is the "), words[node["op"]], F.lit(" of "), F.coalesce("x.about.concept", F.lit("")), who, F.lit(" from "), first, F.lit(" to "), last, F.lit("?"))
    is_root = node["level"] == 0
    whole = is_root & node["op"].isin(*CROSS)
    rows = rows.join(questions.select(key, "question").withColumnRenamed("question", "whole"), key)
    return rows.select(
        key, (F.col("at") + 1).alias("turn_number"), node["op"].alias("op"), F.when(whole, F.col("whole")).when(node["derived"].isNotNull(), named).otherwise(other).alias("question"),
        F.round("x.value", digits).alias("ground_truth"), is_root.alias("is_final"),
    )


def tree_values(nodes: DataFrame, growth_base: str = "left", digits: int = 6) -> DataFrame:
    """(tree, leaves, depth, value) of every tree; a tree that does not parse or lacks an operand has a NULL value."""
    trees = tree_arrays(nodes)
    deepest = F.array_max(F.transform("nodes", lambda x: x["level"]))
    leaves = F.size(F.filter("nodes", lambda x: x["arity"] == 0))
    return trees.select("tree", leaves.alias("leaves"), deepest.alias("depth"), F.round(F.try_element_at(evaluated(F.col("nodes"), growth_base), F.lit(-1)), digits).alias("value"))
