"""The thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .compaction import compacted_clicks
from .exact_dedup import exact_duplicates
from .langid import fit, identify
from .line_dedup import line_report
from .merkle import document_manifest
from .mixing import mix
from .packing import pack_documents
from .quality import judge
from .repeats import repeat_report
from .simhash import near_duplicates
from .tool_chat import link
from .url_filter import judge_urls
from .warc import round_trip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))


#: Shares of all tokens that the mixing query aims at.
TARGETS = {"clean": 0.94, "junk": 0.04, "toxic": 0.02}


def mixed(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """Rates for the domains of the labels: toxic, else junk or clean by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "junk").when(F.col("quality") == 1, "clean")
    return mix(docs, labels.select("doc_id", domain.alias("domain")), TARGETS, scratch)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op2"))


def with_languages(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Language predictions from the labelled documents that are not held out."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = fit(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2), "lang", "text", "doc_id")
    return identify(docs.withColumn("held_out", held_out), model, [*keep, "held_out"])


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_languages(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["doc_id"])


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op4"))


#: The rules of the URL query: host and path prefix, and what they decide.
URL_RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES, Scratch(spark, "op5"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))


#: What the chat query validates: a call asks with the user's text and says at which turn.
TOOLS = {"answer": {"prompt": ("string", True, 1, 400), "turn": ("integer", True, 0, 99)}}


def op7_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn calls the tool ``answer``; the assistant's turn after it is the result, under the call's identifier.

    Turns of any other role, or none, are plain messages.  A call whose text's length is a multiple of four needs the next user turn's
    call, so it waits for it, and chains of such calls wait for their last one.
    """
    turns = table(spark, sf_dir, "conversations")
    name = lambda turn: F.concat(F.lit("t"), turn.cast("string"))
    prompt = F.coalesce("text", F.lit(""))
    arguments = F.to_json(F.struct(prompt.alias("prompt"), F.col("turn")))
    after = F.when(F.char_length(prompt) % 4 == 0, F.array(name(F.col("turn") + 2))).otherwise(F.array().cast("array<string>"))
    calls = turns.where("role = 'user'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), F.lit("answer").alias("name"), arguments.alias("arguments"), after.alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    others = turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))
    linked = link(calls, results, TOOLS, Scratch(spark, "op7"), others)
    return linked.select("conv_id", "turn", "kind", "call_id", "status", F.array_join("errors", "; ").alias("errors"), "due", "level", "json")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"), Scratch(spark, "op8"))


def packed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents packed by the public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    files = [public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken")]
    return pack_documents(docs, scratch, *files, public_tokenizers.PATTERN)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"), Scratch(spark, "op10"))


def op11_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(table(spark, sf_dir, "documents"), Scratch(spark, "op11"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(table(spark, sf_dir, "documents"), Scratch(spark, "op12"))


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted_clicks(table(spark, sf_dir, "clicks"), Scratch(spark, "op13"))


ORACLE = {
    "op12_merkle_manifest": """
        with recursive d as (
            select doc_id, lang, n_chars, concat(case when doc_id is null then '-' else strlen(doc_id::varchar) || ':' || doc_id end, case when source is null then '-' else strlen(source) || ':' || source end,
                       case when lang is null then '-' else strlen(lang) || ':' || lang end) as a, case when text is null then '-' else strlen(text) || ':' || text end as z
            from documents),
        e as (select doc_id, lang, sha256(concat(a, case when n_chars is null then '-' else strlen(n_chars::varchar) || ':' || n_chars end, z)) as leaf,
                     sha256(concat(a, case when n_chars is null then '-' else strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) end, z)) as other from d),
        leaves as (select doc_id, coalesce('v' || lang, 'n') as tree, leaf, other, row_number() over w - 1 as pos, count(*) over (partition by lang) as n from e
                   window w as (partition by lang order by doc_id nulls first, leaf)),
        nodes as (
            select tree, 0 as level, pos, n, leaf as digest from leaves
            union all
            select tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from nodes where n > 1 group by tree, level, pos // 2, n),
        subroots as (select tree, digest as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from nodes where n = 1),
        tops as (
            select 0 as level, pos, n, subroot as digest from subroots
            union all
            select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by pos)) from tops where n > 1 group by level, pos // 2, n),
        crc as (select range::int as b, list_reduce([range::bigint, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end) as c from range(256)),
        crcs as (select doc_id::varchar as s, 0 as k, 4294967295::bigint as c from (select distinct doc_id from documents where doc_id is not null)
                 union all select s, k + 1, xor(r.c >> 8, crc.c) from crcs r join crc on crc.b = xor(r.c, ascii(s[k + 1])) & 255 where k < length(s)),
        tampered as (select s, xor(c, 4294967295) % 7 = 0 as hit from crcs where k = length(s)),
        folds as (
            select l.doc_id, l.tree, l.leaf, 0 as level, l.pos, l.n, '' as proof, case when t.hit then l.other else l.leaf end as digest from leaves l left join tampered t on t.s = l.doc_id::varchar
            union all
            select f.doc_id, f.tree, f.leaf, f.level + 1, f.pos // 2, (f.n + 1) // 2, f.proof || coalesce(o.digest, ''),
                   sha256(case when f.pos % 2 = 1 then o.digest || f.digest else f.digest || coalesce(o.digest, '') end)
            from folds f left join nodes o on o.tree = f.tree and o.level = f.level and o.pos = xor(f.pos, 1) where f.n > 1),
        ends as (
            select f.doc_id, f.leaf, s.subroot, 0 as level, s.pos, s.n, f.proof, f.digest from folds f join subroots s using (tree) where f.n = 1
            union all
            select e.doc_id, e.leaf, e.subroot, e.level + 1, e.pos // 2, (e.n + 1) // 2, e.proof || coalesce(o.digest, ''),
                   sha256(case when e.pos % 2 = 1 then o.digest || e.digest else e.digest || coalesce(o.digest, '') end)
            from ends e left join tops o on o.level = e.level and o.pos = xor(e.pos, 1) where e.n > 1)
        select e.doc_id, e.leaf, e.subroot, t.digest as root, sha256(e.proof) as proof_sha256, e.digest as folded_root, e.digest = t.digest as verified
        from ends e cross join (select digest from tops where n = 1) t where e.n = 1
    """,
    "op7_chat_tools": """
        with calls as (
            select conv_id, turn, 't' || turn as call_id, coalesce(text, '') as prompt,
                   '{"arguments":{"prompt":' || to_json(coalesce(text, ''))::varchar || ',"turn":' || turn || '},"id":"t' || turn || '","name":"answer"}' as j
            from conversations where role = 'user'),
        firsts as (select conv_id, turn as first_turn, call_id, min(j) as first_json, arg_min(length(prompt), j) % 4 = 0 as waits from calls group by all),
        chains as (
            select f.conv_id, f.call_id, f.first_turn, f.first_json, f.waits and g.call_id is not null as goes_on
            from firsts f left join firsts g on g.conv_id = f.conv_id and g.first_turn = f.first_turn + 2),
        placed as (
            select *, min(case when not goes_on then first_turn end) over (partition by conv_id, first_turn % 2 order by first_turn rows between current row and unbounded following) as due
            from chains),
        results as (select conv_id, turn, 't' || (turn - 1) as call_id, text from conversations where role = 'assistant'),
        answers as (select conv_id, call_id, count(*) as n from results group by all)
        select c.conv_id, c.turn, 'call' as kind, c.call_id, case when c.j <> f.first_json then 'repeated' when a.n > 0 then 'linked' else 'unanswered' end as status,
               concat_ws('; ', case when length(prompt) < 1 then 'prompt: too small' when length(prompt) > 400 then 'prompt: too large' end, case when c.turn > 99 then 'turn: too large' end) as errors,
               f.due, cast((f.due - f.first_turn) // 2 as bigint) as level, c.j as json
        from calls c join placed f using (conv_id, call_id) left join answers a using (conv_id, call_id)
        union all
        select r.conv_id, r.turn, 'result', r.call_id, case when f.call_id is null then 'orphan' else 'linked' end, '', coalesce(f.due, r.turn), coalesce((f.due - f.first_turn) // 2, 0),
               '{"content":' || coalesce(to_json(r.text)::varchar, 'null') || ',"id":"' || r.call_id || '"}'
        from results r left join placed f using (conv_id, call_id)
        union all
        select conv_id, turn, 'message', null, 'plain', '', turn, 0, '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}'
        from conversations where role is null or role not in ('user', 'assistant')
    """,
    "op1_exact_dedup": """
        with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents)
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept, sha256(norm) as text_sha256
        from d window w as (partition by norm)
    """,
    "op10_warc": """
        with p as (select page_id, coalesce(html, '') as h from pages),
        f as (select page_id, h, strlen(h) as payload_bytes, min(page_id) over (partition by h) as first from p),
        r as (select *, payload_bytes >= 100 and page_id <> first as again from f)
        select page_id, payload_bytes, sha256(h) as payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to from r
    """,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_langid, op4_simhash, op5_url_filter, op6_quality, op7_chat_tools, op8_line_dedup, op9_packing, op10_warc, op11_repeats, op12_merkle_manifest, op13_compaction)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
