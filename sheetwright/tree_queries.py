"""Queries over tables of different expression trees, one for each order, with the SQL that must give the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.prng import pick, rank_key, uniform
from .operators import controller, obstacles, quotas
from .plans import binder, forest, meanings, nodes, sharing
from .plans.expr import SALES, Derived, Growth, Leaf, Literal, Node, Over, to_json
from .queries import ATOMS, draw_sql, query, rank_sql, sheet_of
from .sources import star

# ---- a tree for each order -------------------------------------------------------------------------------------


def _leaf(year: str, concept: str) -> dict:
    return {"leaf": f"<e>_<{year}>_{concept}"}


def _op(op: str, left: dict, right: dict) -> dict:
    return {"op": op, "left": left, "right": right}


A, B, C = (_leaf("y", f"<{x}>") for x in "abc")
A_NEXT, A_THIRD = _leaf("z", "<a>"), _leaf("x", "<a>")
#: Shapes of trees; names in angle brackets stand for an order's entity, years, concepts and operations.
SHAPES = [
    _op("<o>", A, B),
    _op("<o>", _op("<p>", A, B), C),
    _op("max", _op("max", A, A_NEXT), A_THIRD),
    _op("ratio", {"derived": "net_sales", "expanded": _op("diff", _leaf("y", "list_sales"), _leaf("y", "discounts"))}, _op("sum", A, B)),
    _op("growth", A, A_NEXT),
    _op("mul", _op("sum", A, B), _leaf("y", "tax_rate")),
    _op("ratio", _op("sum", _op("sum", A, A_NEXT), A_THIRD), {"literal": 3.0}),
    _op("min", _op("<o>", A, _leaf("z", "<b>")), _op("<p>", C, _op("diff", A, B))),
    A,
    _op("sum", _leaf("y", "discounts"), _leaf("y", "taxes")),
    _op("ratio", {"op": "sum", "args": ["<e>_<y>_<a>", B, {"op": "min", "args": [C, {"literal": 7.5}]}]}, {"derived": "usual_taxes", "expanded": _op("avg", _leaf("z", "taxes"), _leaf("x", "taxes"))}),
]
PICKED = ["list_sales", "discounts", "taxes", "catalog_cost", "tax_rate", "avg_price"]
OPS = ["sum", "diff", "ratio", "growth", "min", "max"]
#: What each name is drawn from, and with which seed.
DRAWN = {"a": (PICKED, 102), "b": (PICKED, 103), "c": (PICKED, 104), "o": (OPS, 105), "p": (OPS, 106)}
DEEPEST = 3


def _quoted(items: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


def _drawn_sql(items: list[str], seed: int, key: str = "o_orderkey") -> str:
    return f"({_quoted(items)})[1 + cast(floor({draw_sql(seed, key)} * {len(items)}) as integer)]"


def _forms_sql(shapes: list[dict]) -> str:
    made = _drawn_sql([json.dumps(s) for s in shapes], 101)
    for name, (items, seed) in DRAWN.items():
        made = f"replace({made}, '<{name}>', {_drawn_sql(items, seed)})"
    for name, value in (("e", "n_name"), ("y", "cast(y as varchar)"), ("z", "cast(case when y >= 1997 then y - 1 else y + 1 end as varchar)"), ("x", "cast(case when y >= 1997 then y - 2 else y + 2 end as varchar)")):
        made = f"replace({made}, '<{name}>', {value})"
    return f"""forms as (select o_orderkey as tree, {made} as form from (select o_orderkey, n_name, year(o_orderdate) as y from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey))"""


#: Nodes of the trees in SQL: paths are strings of digits, so that '~' comes after every path that it follows.
NODES_SQL = """read as (
        select tree, '' as path, cast(null as varchar) as above, cast(null as varchar) as parent_op, 0 as slot, cast(form as json) as js from forms
        union all
        select tree, path || i, path, op, i, child from (
            select tree, path, op, unnest(kids) as child, generate_subscripts(kids, 1) - 1 as i from (
                select tree, path, body ->> '$.op' as op, case when json_exists(body, '$.left') then [body -> '$.left', body -> '$.right'] else cast(body -> '$.args' as json[]) end as kids
                from (select tree, path, coalesce(js -> '$.expanded', js) as body from read where json_type(js) = 'OBJECT')) where kids is not null)),
    nodes as (
        select tree, path, above, parent_op, slot, length(path) as level, js ->> '$.derived' as derived, coalesce(js -> '$.expanded', js) ->> '$.op' as op,
               case when json_type(js) = 'VARCHAR' then js ->> '$' else js ->> '$.leaf' end as leaf, cast(js ->> '$.literal' as double) as literal from read)"""


def _values_sql() -> str:
    """Values level by level, from the deepest."""
    parts = []
    for k in range(DEEPEST, -1, -1):
        below = f"(select tree, above, list(v order by slot) as vs, count(*) as total, count(v) as known from v{k + 1} group by 1, 2)" if k < DEEPEST else "(select tree, above, [0.0] as vs, 0 as total, 0 as known from nodes where false)"
        parts.append(f"""v{k} as (select n.*, coalesce(c.total, 0) as arity, case when c.total is null then coalesce(n.literal, a.value) when c.known < c.total then null else case n.op
            when 'sum' then list_sum(vs) when 'min' then list_min(vs) when 'max' then list_max(vs) when 'avg' then list_sum(vs) / total when 'diff' then vs[1] - vs[2] when 'mul' then vs[1] * vs[2]
            when 'ratio' then vs[1] / nullif(vs[2], 0) when 'growth' then (vs[2] - vs[1]) / nullif(vs[1], 0) end end as v
            from nodes n left join {below} c on c.tree = n.tree and c.above = n.path left join atoms a on a.key = n.leaf where n.level = {k})""")
    return ", ".join(parts) + ", valued as (" + " union all ".join(f"select * from v{k}" for k in range(DEEPEST + 1)) + ")"


def forms(spark, d, shapes: list[dict]) -> DataFrame:
    """(tree, form): an expression of its own for each order, about its customer's nation and its year."""
    orders = star.table(spark, d, "orders").join(star.table(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(star.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("entity")), F.col("c_nationkey") == F.col("n_nationkey"))
    key, y = F.col("o_orderkey"), F.year("o_orderdate")
    late = y >= 1997
    made = pick([json.dumps(s) for s in shapes], uniform(101, key))
    for name, (items, seed) in DRAWN.items():
        made = F.replace(made, F.lit(f"<{name}>"), pick(items, uniform(seed, key)))
    for name, value in (("e", F.col("entity")), ("y", y), ("z", F.when(late, y - 1).otherwise(y + 1)), ("x", F.when(late, y - 2).otherwise(y + 2))):
        made = F.replace(made, F.lit(f"<{name}>"), value.cast("string"))
    return named.select(key.alias("tree"), made.alias("form"))


def facts(spark, d) -> DataFrame:
    """The nations' facts, with what is said of their concepts."""
    return star.atoms(sheet_of(spark, d)).withColumn("period", F.col("period").cast("string")).withColumnRenamed("parent_concept", "parent")


def bound_nodes(spark, d, shapes: list[dict]) -> DataFrame:
    return nodes.bound(nodes.node_table(forms(spark, d, shapes), "tree", "form", DEEPEST + 1), facts(spark, d))


START = f"with recursive {ATOMS}, "


@query(START + f"""{_forms_sql(SHAPES)}, {NODES_SQL}, placed as (
    select *, row_number() over (partition by tree order by path) as pre, row_number() over (partition by tree order by path || '~') as post from nodes)
    select tree, cast(pre as integer) as pre, cast(post as integer) as post, cast((select count(*) from nodes m where m.tree = p.tree and starts_with(m.path, p.path)) as integer) as size, cast(level as integer) as level, op, parent_op, leaf, literal, derived from placed p""")
def tree_nodes(spark, d):
    """Every node of every tree with its numbers."""
    rows = nodes.node_table(forms(spark, d, SHAPES), "tree", "form", DEEPEST + 1)
    return rows.select("tree", (F.col("post") - F.col("size") + F.col("level") + 1).alias("pre"), "post", "size", "level", "op", "parent_op", "leaf", "literal", "derived")


@query(START + f"""{_forms_sql(SHAPES)}, {NODES_SQL}, {_values_sql()}
    select tree, cast(count(case when arity = 0 then 1 end) as integer) as leaves, cast(max(level) as integer) as depth, round(max(case when level = 0 then v end), 6) + 0 as value from valued group by tree""")
def tree_values(spark, d):
    """The value of every tree."""
    return nodes.tree_values(bound_nodes(spark, d, SHAPES))


@query(START + f"""{_forms_sql(SHAPES)}, {NODES_SQL}, {_values_sql()},
    below as (
        select n.tree, n.path, list_sort(list_distinct(list(try_cast(a.period as integer)))) as years, arg_min(a.concept, l.path) as concept, arg_min(a.entity, l.path) as entity
        from nodes n join nodes l on l.tree = n.tree and starts_with(l.path, n.path) join atoms a on a.key = l.leaf where n.op is not null group by 1, 2),
    words as (select * from (values {', '.join(f"('{k}', '{v}')" for k, v in nodes.WORDS.items())}) w(op, word))
    select n.tree as question_id, cast(row_number() over (partition by n.tree order by n.path || '~') as integer) as turn_number, n.op,
           case when n.level = 0 and n.op in ({', '.join(repr(x) for x in nodes.CROSS)}) then 'Question ' || n.tree || '?'
                when n.derived is not null then 'What is ' || replace(n.derived, '_', ' ') || ' for ' || b.entity || ' in ' || years[1] || '?'
                else 'What is the ' || word || ' of ' || b.concept || ' for ' || b.entity || ' from ' || years[1] || ' to ' || years[-1] || '?' end as question,
           round(v, 6) + 0 as ground_truth, n.level = 0 as is_final
    from valued n left join below b on b.tree = n.tree and b.path = n.path left join words w on w.op = n.op
    where n.arity > 0 and not (n.op in ('min', 'max') and n.op is not distinct from n.parent_op)""")
def tree_turns(spark, d):
    """The turns of every tree: texts, truths, and which is the last."""
    questions = forms(spark, d, SHAPES).select(F.col("tree").alias("question_id"), F.concat(F.lit("Question "), F.col("tree").cast("string"), F.lit("?")).alias("question"))
    return nodes.tree_turns(bound_nodes(spark, d, SHAPES), questions)


@query(START + f"""{_forms_sql(SHAPES)}, {NODES_SQL}, {_values_sql()} select tree, round(v, 6) + 0 as value from valued where level = 0""")
def shared_values(spark, d):
    """The value of every tree, each different subtree evaluated once."""
    return sharing.form_values(forms(spark, d, SHAPES), "tree", "form", facts(spark, d), levels=DEEPEST + 1)


def _signatures_sql() -> str:
    parts = []
    for k in range(DEEPEST, -1, -1):
        below = f"(select tree, above, list(sig order by slot) as kids, max(height) as highest from s{k + 1} group by 1, 2)" if k < DEEPEST else "(select tree, above, [''] as kids, 0 as highest from nodes where false)"
        ordered = f"case when n.op in ({', '.join(repr(x) for x in sharing.UNORDERED)}) then list_sort(kids) else kids end"
        parts.append(f"""s{k} as (select n.*, case when c.tree is null then 0 else c.highest + 1 end as height, md5(case when c.tree is not null then n.op || '(' || array_to_string({ordered}, ',') || ')' else coalesce('leaf ' || n.leaf, 'number ' || n.literal, 'nothing') end) as sig
            from nodes n left join {below} c on c.tree = n.tree and c.above = n.path where n.level = {k})""")
    return ", ".join(parts) + ", signed as (" + " union all ".join(f"select tree, sig, height from s{k}" for k in range(DEEPEST + 1)) + ")"


@query(START + f"""{_forms_sql(SHAPES)}, {NODES_SQL}, {_signatures_sql()}, distinct_ as (select sig, any_value(height) as height, count(*) as uses from signed group by 1)
    select cast(height as integer) as height, count(*) as subtrees, cast(sum(uses) as bigint) as uses, max(uses) as most from distinct_ group by 1""")
def shared_subtrees(spark, d):
    """How many different subtrees there are of each height, and how often they are used."""
    signs = sharing.signatures(nodes.node_table(forms(spark, d, SHAPES), "tree", "form", DEEPEST + 1))
    return sharing.different(signs).groupBy("height").agg(F.count(F.lit(1)).alias("subtrees"), F.sum("uses").alias("uses"), F.max("uses").alias("most"))


# ---- what trees mean -------------------------------------------------------------------------------------------

#: The shapes whose operations all have two operands.
PAIRS = SHAPES[:-1]
SIBLINGS = {("sales", "component"): ["list_sales"], ("deductions", "component"): ["discounts", "taxes"], ("cost", "component"): ["catalog_cost"]}


def _meanings_sql() -> str:
    """The type rules level by level: a is the left operand's meaning and b the right one's."""
    no_terms = "[{'fact': false, 'concept': cast(null as varchar), 'entity': cast(null as varchar), 'period': cast(null as varchar), 'parent': cast(null as varchar), 'role': cast(null as varchar)}]"
    same = {c: f"a.{c} is not distinct from b.{c}" for c in ("entity", "period", "unit", "concept")}
    context = f"({same['entity']} and {same['period']} and a.entity is not null)"
    amounts = f"case when a.st <> 'amount' or b.st <> 'amount' then n.op || ' takes amounts' when not ({same['unit']}) then n.op || ' takes one unit' end"
    wanted = "case (a.terms)[1].parent " + " ".join(f"when '{p}' then {_quoted(sorted(v))}" for (p, _), v in SIBLINGS.items()) + " end"
    terms = "list_concat(a.terms, b.terms)"
    total = f"({context} and len(list_filter({terms}, lambda x: x.fact and x.role is not distinct from 'component' and x.parent is not distinct from (a.terms)[1].parent)) = len({terms}) and list_sort([x.concept for x in {terms}]) is not distinct from {wanted})"
    times = "list_sort([x.period for x in a.terms])"
    averaged = f"(coalesce(b.kind = 'literal_scalar' and len(a.terms) = b.lit and len(list_filter(a.terms, lambda x: x.fact and x.concept = (a.terms)[1].concept and x.entity = (a.terms)[1].entity)) = len(a.terms) and len(list_distinct({times})) = len(a.terms), false))"
    over = f"({same['concept']} and {same['entity']} and a.concept is not null and a.period <> b.period)"
    early, late = "least(a.period, b.period)", "greatest(a.period, b.period)"

    def struct(**f):
        names = ["kind", "st", "txt", "entity", "period", "unit", "concept", "f", "t", "err"]
        return "{" + ", ".join(f"'{c}': " + f.get(c, "cast(null as varchar)") for c in names) + "}"

    def along(op, word, concept="a.concept", entity="a.entity", first=early, last=late):
        text = f"'the {word} of ' || replace({concept}, '_', ' ') || ' for ' || {entity} || ' using values from ' || {first} || ' through ' || {last}"
        return struct(kind=f"'{op}_over_time'", st="a.st", txt=text, entity=entity, period=last, unit="a.unit", concept=concept, f=first, t=last)

    def extreme(op, word):
        plain = struct(kind=f"'{op}_amounts'", st="'amount'", txt=f"'the {word} of ' || a.txt || ' and ' || b.txt", entity="a.entity", period=f"case when {same['period']} then a.period end", unit="a.unit")
        return f"case when {over} then {along(op, word)} when {amounts} is not null then {struct(err=amounts)} when not ({same['entity']}) then {struct(err=chr(39) + op + ' takes one entity' + chr(39))} else {plain} end"

    scaled = lambda x, y: struct(kind="'scaled_amount'", st="'amount'", txt=f"'result of ' || {x}.txt || ' scaled by ' || {y}.txt", entity=f"{x}.entity", period=f"{x}.period", unit=f"{x}.unit", f=f"{x}.f", t=f"{x}.t")
    times_by = lambda x, y: f"case when {y}.entity is not null and {y}.entity is distinct from {x}.entity then {struct(err=chr(39) + 'mul takes one entity' + chr(39))} else {scaled(x, y)} end"
    sum_text = "'sum of ' || a.txt || ' and ' || b.txt"
    rules = f"""case
        when a.err is not null then {struct(err='a.err')} when b.err is not null then {struct(err='b.err')}
        when n.op = 'sum' then case when {amounts} is not null then {struct(err=amounts)}
            when {total} then {struct(kind="'aggregate_components'", st="'amount'", txt="'total ' || (a.terms)[1].parent || ' for ' || a.entity || ' in ' || a.period", entity='a.entity', period='a.period', unit='a.unit', concept='(a.terms)[1].parent')}
            when {context} then {struct(kind="'sum_amount'", st="'amount'", txt=sum_text, entity='a.entity', period='a.period', unit='a.unit')}
            when {same['entity']} then {struct(kind="'sum_amounts'", st="'amount'", txt=sum_text, entity='a.entity', unit='a.unit')} else {struct(err="'sum takes one entity'")} end
        when n.op = 'diff' then case when {amounts} is not null then {struct(err=amounts)} when not {context} then {struct(err="'diff takes one entity and period'")}
            else {struct(kind="'difference'", st="'amount'", txt="'difference between ' || a.txt || ' and ' || b.txt", entity='a.entity', period='a.period', unit='a.unit')} end
        when n.op = 'ratio' then case when {averaged} then {along('avg', 'average', '(a.terms)[1].concept', '(a.terms)[1].entity', times + '[1]', times + '[-1]')}
            when {amounts} is not null then {struct(err=amounts)} when not ({same['entity']}) or a.entity is null then {struct(err="'ratio takes one entity'")}
            else {struct(kind="'ratio'", st="'ratio'", txt="'ratio of ' || a.txt || ' to ' || b.txt", entity='a.entity', period=f"case when {same['period']} then a.period end", unit="'ratio'")} end
        when n.op = 'mul' then case when a.st = 'amount' and b.st in ('ratio', 'rate') then {times_by('a', 'b')} when b.st = 'amount' and a.st in ('ratio', 'rate') then {times_by('b', 'a')} else {struct(err="'mul takes an amount and a ratio or rate'")} end
        when n.op = 'growth' then case when not ({same['entity']} and {same['unit']}) or a.entity is null then {struct(err="'growth takes one entity and unit'")}
            when a.concept = b.concept and {same['period']} then {struct(err="'growth takes two periods'")}
            when a.concept = b.concept then {struct(kind="'growth_rate'", st="'ratio'", txt=f"'growth in ' || replace(a.concept, '_', ' ') || ' for ' || a.entity || ' from ' || {early} || ' to ' || {late}", entity='a.entity', period=late, unit="'ratio'", concept='a.concept', f=early, t=late)}
            else {struct(kind="'growth_rate_composed'", st="'ratio'", txt="'growth between ' || a.txt || ' and ' || b.txt", entity='a.entity', unit="'ratio'")} end
        when n.op = 'min' then {extreme('min', 'minimum')} when n.op = 'max' then {extreme('max', 'maximum')} end"""
    leaf = f"""select n.tree, n.path, n.above, n.slot, case when a.key is not null then 'leaf_metric' when n.literal is not null then 'literal_scalar' end as kind, case when a.key is not null then a.semantic_type when n.literal is not null then 'ratio' end as st,
        case when a.key is not null then replace(a.concept, '_', ' ') || ' for ' || a.entity || ' in ' || a.period when n.literal is not null then cast(n.literal as varchar) end as txt, a.entity, cast(a.period as varchar) as period, a.unit, a.concept,
        cast(null as varchar) as f, cast(null as varchar) as t, case when a.key is null and n.literal is null then 'unknown leaf ' || n.leaf end as err, n.literal as lit,
        [{{'fact': a.key is not null, 'concept': a.concept, 'entity': a.entity, 'period': cast(a.period as varchar), 'parent': a.parent_concept, 'role': a.role}}] as terms from nodes n left join atoms a on a.key = n.leaf where n.op is null"""
    parts = [f"m{DEEPEST} as ({leaf} and n.level = {DEEPEST})"]
    for k in range(DEEPEST - 1, -1, -1):
        parts.append(f"""m{k} as ({leaf} and n.level = {k} union all select tree, path, above, slot, r.kind, r.st, r.txt, r.entity, r.period, r.unit, r.concept, r.f, r.t, r.err, cast(null as double), terms from (
            select n.tree, n.path, n.above, n.slot, {rules} as r, case when n.op = 'sum' then {terms} else {no_terms} end as terms
            from nodes n join m{k + 1} a on a.tree = n.tree and a.above = n.path and a.slot = 0 join m{k + 1} b on b.tree = n.tree and b.above = n.path and b.slot = 1 where n.level = {k} and n.op is not null))""")
    return ", ".join(parts)


@query(START + f"""{_forms_sql(PAIRS)}, {NODES_SQL}, {_meanings_sql()}
    select tree, kind, st as semantic_type, txt as "text", entity, period, unit, concept, f as from_period, t as to_period, err as error from m0""")
def tree_meanings(spark, d):
    """What every tree means, or why it means nothing."""
    return meanings.tree_meanings(bound_nodes(spark, d, PAIRS), SIBLINGS)


@query(START + f"""{_forms_sql(PAIRS)}, {NODES_SQL}, {_meanings_sql()}
    select coalesce(kind, 'none') as kind, err is null as valid, count(*) as n from m0 group by 1, 2""")
def tree_meaning_kinds(spark, d):
    """How many trees have each kind of meaning."""
    found = meanings.tree_meanings(bound_nodes(spark, d, PAIRS), SIBLINGS)
    return found.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), F.col("error").isNull().alias("valid")).agg(F.count(F.lit(1)).alias("n"))


# ---- sampling --------------------------------------------------------------------------------------------------


@query()
def sampled_trees(spark, d):
    """A tree for each part, grown and rejected by its own draws; of trees alike the first."""
    parts = star.table(spark, d, "part").select(F.col("p_partkey").alias("tree"))
    return forest.sample_trees(parts, 7, (1, 3), [c for c, (kind, *_) in star.CONCEPTS.items() if kind == "amount"], ["tax_rate"], SALES)


@query(f"""with recursive numbered as (select c_custkey, {draw_sql(112, 'c_custkey')} < 0.25 as own, row_number() over (order by {rank_sql(111, 'c_custkey')} || '/' || c_custkey) - 1 as place from customer),
    walk as (
        select c_custkey, place, true as needed, true as derived, 1 as used from numbered where place = 0
        union all
        select n.c_custkey, n.place, w.used / cast(n.place + 1 as double) < 0.4, w.used / cast(n.place + 1 as double) < 0.4 or n.own, w.used + cast(w.used / cast(n.place + 1 as double) < 0.4 or n.own as integer)
        from walk w join numbered n on n.place = w.place + 1)
    select c_custkey, place, needed, derived from walk""")
def derived_controller(spark, d):
    """Which customers' questions must use a derived measure, so that two in five do all along, in a random order of customers."""
    rows = star.table(spark, d, "customer").select("c_custkey", (uniform(112, F.col("c_custkey")) < 0.25).alias("own"))
    placed = quotas.numbered(rows, F.concat(rank_key(111, F.col("c_custkey")), F.lit("/"), F.col("c_custkey").cast("string")))
    return controller.controlled(placed, "place", "own", rows.count(), 0.3, 0.5).select("c_custkey", "place", "needed", "derived")


# ---- binding ---------------------------------------------------------------------------------------------------

TEMPLATES = [
    json.dumps(to_json(t))
    for t in (
        Leaf("taxes"), Node("diff", Leaf("list_sales"), Leaf("discounts")), Node("ratio", Derived("net_sales"), Leaf("catalog_cost")), Node("mul", Node("sum", Leaf("taxes"), Leaf("discounts")), Leaf("tax_rate")),
        Growth(Leaf("list_sales")), Over("min", Leaf("discounts")), Node("sum", Over("avg", Leaf("taxes")), Over("max", Leaf("discounts"))), Node("ratio", Growth(Leaf("discounts")), Literal(2.0)),
    )
]


def _bound_sql() -> str:
    growth, over, leaf = binder.GROWTH, binder.OVER, r'\{"leaf": "(\w+)", "depth": 0\}'
    key = lambda period, concept: f"""'{{"leaf": "' || entity || '_' || {period} || '_' || {concept} || '"}}'"""
    concept = f"regexp_extract(found, '{growth}', 1)"
    earlier = f"list_filter(series[{concept}], lambda p: p < period)"
    then = f"({earlier})[1 + cast(floor({draw_sql(125, 'tree', 'attempt', concept)} * len({earlier})) as integer)]"
    grown = f"""'{{"op": "growth", "left": ' || {key(then, concept)} || ', "right": ' || {key('period', concept)} || '}}'"""
    op, over_concept = f"regexp_extract(found, '{over}', 1)", f"regexp_extract(found, '{over}', 2)"
    periods = f"series[{over_concept}]"
    chain = f"""list_reduce([{key('p', over_concept)} for p in {periods}], lambda x, y: '{{"op": "' || case {op} when 'avg' then 'sum' else {op} end || '", "left": ' || x || ', "right": ' || y || '}}')"""
    windowed = f"""case when len({periods}) >= 2 then case {op} when 'avg' then '{{"op": "ratio", "left": ' || {chain} || ', "right": {{"literal": ' || len({periods}) || '}}}}' else {chain} end end"""
    net = json.dumps(to_json(Node("diff", Leaf("list_sales"), Leaf("discounts"))))
    named = json.dumps(to_json(Derived("net_sales")))
    expanded = '{"derived": "net_sales", "expanded": ' + net + "}"
    return f"""facts as (select * from atoms where {draw_sql(122, 'key')} >= 0.1),
    series as (select entity, map_from_entries(list({{'k': concept, 'v': periods}})) as series from (select entity, concept, list(period order by period) as periods from facts group by 1, 2) group by 1),
    slices as (select entity, period, row_number() over (order by {rank_sql(123, 'entity', 'period')} || '/' || entity || '/' || period) - 1 as place, count(*) over () as places from (select distinct entity, period from facts)),
    templates as (select p_partkey as tree, replace({_drawn_sql(TEMPLATES, 121, 'p_partkey')}, '{named}', '{expanded}') as template from part),
    tries as (select tree, template, unnest(range(0, 8)) as attempt from templates),
    placed as (select t.tree, t.attempt, t.template, s.entity, s.period, series from tries t join slices s on s.place = floor({draw_sql(124, 't.tree', 't.attempt')} * s.places) join series using (entity)),
    grown as (select *, list_reduce(list_prepend(template, list_distinct(regexp_extract_all(template, '{growth}'))), lambda t, found: replace(t, found, {grown})) as text1 from placed),
    widened as (select *, list_reduce(list_prepend(text1, list_distinct(regexp_extract_all(text1, '{over}'))), lambda t, found: replace(t, found, {windowed})) as text2 from grown where text1 is not null),
    filled as (select tree, attempt, entity, period, regexp_replace(text2, '{leaf}', '{{"leaf": "' || entity || '_' || period || '_\\1"}}', 'g') as form from widened where text2 is not null),
    gone as (select distinct tree, attempt from (select tree, attempt, unnest(regexp_extract_all(form, '{binder.KEYS}', 1)) as key from filled) k anti join facts using (key)),
    bound as (select tree, arg_min({{'attempt': attempt, 'entity': entity, 'period': period, 'form': form}}, attempt) as b from filled anti join gone using (tree, attempt) group by tree)"""


@query(f"with {ATOMS}, {_bound_sql()} select tree, cast(b.attempt as integer) as attempt, b.entity as entity, b.period as period, b.form as form from bound")
def bound_trees(spark, d):
    """A template for each part, bound to a nation's facts, some of which are missing."""
    known = star.atoms(sheet_of(spark, d)).where(uniform(122, F.col("key")) >= 0.1)
    templates = star.table(spark, d, "part").select(F.col("p_partkey").alias("tree"), pick(TEMPLATES, uniform(121, F.col("p_partkey"))).alias("form"))
    return binder.bind(templates, known, SALES, 123)


# ---- clauses by the concepts of a question's own tree -----------------------------------------------------------

_CLAUSE_SQL = "case family " + " ".join(f"when '{k}' then ({_quoted([c.replace(chr(39), chr(39) * 2) for c in v])})[1 + cast(floor({draw_sql(131, 'tree')} * {len(v)}) as integer)]" for k, v in obstacles.CLAUSES.items()) + " end"


@query(START + f"""{_forms_sql(SHAPES)}, {NODES_SQL},
    own as (select distinct n.tree, a.concept, a.parent_concept from nodes n join atoms a on a.key = n.leaf),
    asked as (select tree, case when tree % 5 = 0 then 'What comes out?' else 'Regarding ' || string_agg(replace(concept, '_', case when tree % 2 = 0 then ' ' else ' of ' end), ' and ' order by concept) || ': what comes out?' end as question from own group by tree),
    scored as (select o.tree, question, concept, parent_concept, lower(question) as low, string_split(concept, '_') as ws from own o join asked using (tree)),
    hit as (select *, len(list_filter(ws, lambda x: contains(low, x))) as hits from scored),
    ranked as (select tree, question, concept, parent_concept, case when contains(low, replace(concept, '_', ' ')) then 100 + length(concept) when hits = len(ws) then 50 + hits else hits end as score from hit),
    best as (select tree, question, arg_min({{'concept': concept, 'family': parent_concept, 'score': score}}, {{'s': -score, 'c': concept}}) as b from ranked group by 1, 2),
    routed as (select tree, question, b.concept as concept, cast(b.score as integer) as score, case when b.score = 0 then 'generic' when b.family in ('sales', 'cost') then b.family when b.family in ('deductions', 'rate') then 'tax' else 'generic' end as family from best)
    select tree, concept, score, family, case when {draw_sql(132, 'tree')} < 0.5 then {_CLAUSE_SQL} || ' ' || question else question || ' ' || {_CLAUSE_SQL} end as question from routed""")
def tree_clauses(spark, d):
    """Each question with a clause of the family of that concept of its own tree that fits its words best."""
    leaves = nodes.node_table(forms(spark, d, SHAPES), "tree", "form", DEEPEST + 1).where("leaf is not null").select("tree", F.col("leaf").alias("key"))
    own = leaves.join(nodes.counted(facts(spark, d).select("key", "concept", "parent")), "key").select("tree", "concept", "parent").distinct()
    spaced = F.replace("concept", F.lit("_"), F.when(F.col("tree") % 2 == 0, " ").otherwise(" of "))
    named = own.groupBy("tree").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("concept", spaced.alias("t")))), lambda x: x["t"]), " and ").alias("named"))  # a tree's concepts
    asked = named.select("tree", F.when(F.col("tree") % 5 == 0, "What comes out?").otherwise(F.concat(F.lit("Regarding "), "named", F.lit(": what comes out?"))).alias("question"))
    found = obstacles.matched_family(own.join(asked, "tree"), "tree", {"sales": "sales", "cost": "cost", "deductions": "tax", "rate": "tax"})
    clause = obstacles.clause_of(F.col("family"), uniform(131, F.col("tree")))
    return found.select("tree", "concept", "score", "family", obstacles.beside(F.col("question"), clause, uniform(132, F.col("tree"))).alias("question"))
