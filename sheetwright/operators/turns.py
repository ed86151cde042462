"""Decomposition of compound expressions into turns, and scoring of replayed conversations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.expr import Compiler, Concept, Derived, Expr, Leaf, Literal, Node
from ..plans.render import bare_phrase


@dataclass(frozen=True)
class Turn:
    number: int
    expr: Expr
    final: bool


def decompose(expr: Expr) -> list[Turn]:
    """Post-order turns of a tree; minima of minima, and maxima of maxima, are one turn with what holds them."""
    found: list[Expr] = []

    def walk(e: Expr, root: bool) -> None:
        if isinstance(e, Leaf | Literal):
            return
        for c in e.children():
            if not (isinstance(e, Node) and isinstance(c, Node) and e.op == c.op and e.op in ("min", "max")):
                walk(c, False)
            else:
                for inner in c.children():
                    walk(inner, False)
        found.append(e)

    walk(expr, True)
    return [Turn(i + 1, e, e is expr) for i, e in enumerate(found)]


def turn_table(sheet: DataFrame, expr: Expr, registry: dict[str, Concept], digits: int = 6) -> DataFrame:
    """One row a (entity, period, turn): question text and ground truth; the final turn asks the whole question."""
    compiler, turns = Compiler(registry), decompose(expr)
    where = F.concat(F.lit(" for "), F.col("entity"), F.lit(" in "), F.col("period").cast("string"), F.lit("?"))
    listed = [
        F.struct(
            F.lit(t.number).alias("turn_number"), F.lit(getattr(t.expr, "op", "derived" if isinstance(t.expr, Derived) else "growth")).alias("op"),
            F.concat(F.lit(("What is " if isinstance(t.expr, Derived) else "What is the ") + bare_phrase(t.expr).removeprefix("the ")), where).alias("question"),
            F.round(compiler.column(t.expr), digits).alias("ground_truth"), F.lit(t.final).alias("is_final"),
        )
        for t in turns
    ]
    wide = sheet.select("entity", "period", F.array(*listed).alias("turns"))
    return wide.select("entity", "period", F.inline("turns"))


def messages(turns: Column, sheet_text: Column) -> Column:
    """User and assistant messages of a conversation's turns; the first user turn carries the sheet."""
    pair = lambda t: F.array(
        F.struct(F.lit("user").alias("role"), F.when(t["turn_number"] == 1, F.concat(sheet_text, F.lit("\n\n"), t["question"])).otherwise(t["question"]).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.lit("").alias("content")),
    )
    return F.flatten(F.transform(turns, pair))


def score_conversations(scored: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per conversation: turns, whether the final one is correct, the first failure, and whether it recovered.

    ``scored`` has the key, turn_number, is_final and correct.
    """
    fails = F.min(F.when(~F.col("correct"), F.col("turn_number")))
    ok = F.coalesce(F.bool_or(F.col("is_final") & F.col("correct")), F.lit(False))
    out = scored.groupBy(key).agg(F.count(F.lit(1)).alias("num_turns"), ok.alias("correct"), fails.alias("first_failure"))
    return out.withColumn("recovered", F.col("correct") & F.col("first_failure").isNotNull())


def first_failures(conversations: DataFrame) -> DataFrame:
    """Where failed conversations of more than one turn first failed."""
    return conversations.where("not correct and num_turns > 1").groupBy("num_turns", "first_failure").agg(F.count(F.lit(1)).alias("n"))


def leaf_map(questions: DataFrame, key: str = "question_id", slots: int = 14) -> DataFrame:
    """(key, slot, leaf_key, concept, entity, period, value) from wide columns ``leaf_<slot>_...``; blank slots are skipped."""
    own = [j for j in range(1, slots + 1) if f"leaf_{j}_key" in questions.columns]
    field = lambda j, f: (F.col(f"leaf_{j}_{f}") if f"leaf_{j}_{f}" in questions.columns else F.lit(None)).cast("string")
    one = lambda j: F.struct(
        F.lit(j).alias("slot"), field(j, "key").alias("leaf_key"), F.coalesce(field(j, "label"), F.lit("")).alias("concept"), F.coalesce(field(j, "entity"), F.lit("")).alias("entity"),
        F.coalesce(field(j, "period"), F.lit("")).alias("period"), F.coalesce(field(j, "value").try_cast("double"), F.lit(0.0)).alias("value"),
    )
    return questions.select(key, F.inline(F.array(*map(one, own)))).where("leaf_key <> ''")


def first_entity(leaves: Column) -> Column:
    """The entity of the first leaf that has one."""
    return F.get(F.filter(F.transform(leaves, lambda x: x["entity"]), lambda e: e.isNotNull() & (e != "")), F.lit(0))


def subtree_facts(tree: Expr, leaves: DataFrame, key: str = "question_id") -> DataFrame:
    """What a subtree is about in each question: (key, years, concept, entity).

    ``leaves`` has the key, slot, concept, entity and period of the questions' leaves; the subtree's own are those of its concepts.
    Years come in order, each once; concept and entity are those of the first leaf that has one; literals have none.
    """
    names = tree.leaves()
    own = leaves.where(F.col("concept").isin(*names)) if names else leaves.limit(0)
    place = F.array_position(F.array(*map(F.lit, names or [""])), F.col("concept"))
    first = lambda c: F.min_by(c, F.when(F.col(c) != "", F.struct(place, F.col("slot")))).alias(c)
    years = F.array_sort(F.array_compact(F.collect_set(F.col("period").try_cast("int")))).alias("years")
    return own.groupBy(key).agg(years, first("concept"), first("entity"))


def dataset_pass(questions: DataFrame, turns: DataFrame, key: str = "question_id") -> DataFrame:
    """Each question with its turns: (key, question, answer, depth, num_turns, turns, skipped, error).

    A question of depth below one is skipped, as one turn; one of which no turns could be made, as its tree does not parse or
    lacks a value, is skipped with an error.
    """
    own = turns.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn_number", "op", "question", "ground_truth", "is_final"))).alias("turns"))  # a question's turns
    rows = questions.select(key, "question", "answer", F.coalesce(F.col("depth"), F.lit(1)).alias("depth")).join(own, key, "left")
    shallow = F.col("depth") < 1
    bad = ~shallow & (F.col("turns").isNull() | F.exists("turns", lambda t: t["ground_truth"].isNull()))
    return rows.select(
        key, "question", "answer", "depth", F.when(shallow, 1).when(~bad, F.size("turns")).alias("num_turns"), F.when(~shallow & ~bad, F.col("turns")).alias("turns"),
        (shallow | bad).alias("skipped"), F.when(bad, F.when(F.col("turns").isNull(), "no turns").otherwise("a turn has no value")).alias("error"),
    )


def replay(turns: DataFrame, responses: DataFrame, parse, correct, key: str = "conv_id") -> DataFrame:
    """Turns scored against the responses to them: (key, turn_number, is_final, predicted, correct).

    ``responses`` has the key, turn_number and text; ``parse`` makes a number of a text and ``correct`` compares it with the truth.
    A turn without a response is wrong.
    """
    joined = turns.join(responses.select(key, "turn_number", "response"), [key, "turn_number"], "left").withColumn("predicted", parse(F.col("response")))
    return joined.select(key, "turn_number", "is_final", "predicted", F.coalesce(correct(F.col("predicted"), F.col("ground_truth")), F.lit(False)).alias("correct"))
