"""One query for each operator, over its whole table, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (chat, conversation_repair, embedding_dedup, exact_dedup, language_id, lm_score, mixing, packing, simhash,
                          substring_dedup, suffix_dedup, url_filter, whitening)
from tidemark.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block")]

URL_SQL = f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES {", ".join(str(r) for r in RULES)})
SELECT page_id, host, path, max_by(h || p, length(h || p)) AS rule, coalesce(max_by(v, length(h || p)), 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
GROUP BY page_id, host, path"""


@query("op2_url_filter", URL_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(str(r) for r in RULES)} AS t(host, path, verdict)")
    judged = url_filter.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op3_simhash")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


PROBE = "</s>[INST] ok [/INST]"

CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}')),
t AS (
  SELECT *, regexp_matches(text, '</?s>|\\[/?INST\\]|\\[SYS\\]|\\[ROLE=') AS escaped,
         replace(replace(replace(replace(role, '\\', '\\b'), '<', '\\l'), '[', '\\o'), ']', '\\r') AS named,
         replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '[', '\\o') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(8 + CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 5 ELSE 7 + length(named) END
                + length(CASE WHEN escaped THEN safe ELSE text END)) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


@query("op9_chat_format", CHAT_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(f"SELECT * FROM VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}') AS t(conv_id, turn, role, text)")
    out = chat.format_chat(rows.unionByName(probe))
    turns = F.col("turns")
    loss = F.array_join(chat.loss_spans(turns), "")
    shown = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
                      F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"))


DEDUP_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256 FROM n WINDOW w AS (PARTITION BY norm)"""


@query("op10_exact_dedup", DEDUP_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op7_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"))
    return packing.pack(cut).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op8_mixing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(*mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")))


@query("op4_lm_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(table(spark, sf_dir, "documents"))


@query("op6_embedding_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op1_substring_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    pages = language_id.page_rows(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return language_id.identify(pages, model).withColumnRenamed("id", "page_id")


@query("op12_suffix_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.repeated_strings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _repair_sql() -> str:
    """The same dynamic program as a recursive query over row numbers: four entries (cost, audit, output) a conversation."""
    def way(fro: str, edit: str, cost: int, name: str | None, extra: bool = True) -> str:
        cost = f"{fro}.c + {cost}" + (" + (f = 3)::INT" if extra and edit != "D" else "")
        out = f"{fro}.o" if name is None else f"{fro}.o || chr(10) || {name}"
        return f"CASE WHEN {fro}.c IS NOT NULL THEN {{'c': {cost}, 'a': {fro}.a || '{edit}', 'o': {out}}} END"

    def least(ways: list[str]) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))[1]"

    def kept(fro: str, initial: str) -> str:
        return f"CASE WHEN f NOT IN (1, 2) AND left(role, 1) = '{initial}' THEN {way(fro, 'K', 0, chr(39).join(['role || ', ':', ' || text']))} END"

    def renamed(fro: str, name: str) -> str:
        return f"CASE WHEN f NOT IN (1, 2) THEN {way(fro, 'R', 2, chr(39) + name + ':' + chr(39) + ' || text')} END"

    def added(fro: str, name: str) -> str:
        return way(fro, "I", 2, f"'{name}:'", False)

    steps = {"m0": [way("s0", "D", 3, None)], "m1": [way("s1", "D", 3, None), kept("s0", "s")],
             "m2": [way("s2", "D", 3, None)] + [renamed(s, "user") for s in ("s0", "s1", "s3")] + [kept(s, "u") for s in ("s0", "s1", "s3")],
             "m3": [way("s3", "D", 3, None), renamed("s2", "assistant"), kept("s2", "a")]}
    none = "NULL::STRUCT(c INT, a VARCHAR, o VARCHAR)"
    begin = "{'c': 0, 'a': '', 'o': ''}::STRUCT(c INT, a VARCHAR, o VARCHAR)"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)),
             lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 20 AS kind
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM raw, range(2) AS copy(k) WHERE kind > 0 AND (k = 0 OR kind = 3)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS time FROM hurt),
faulty AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, time) AS n,
         CASE WHEN trim(text, {blanks}) = '' THEN 1 WHEN time > 1 THEN 2
              WHEN right(trim(text, {blanks}), 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS f FROM seen),
paired AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair FROM faulty),
dp AS (
  SELECT conv_id, 0::BIGINT AS n, s0, s1, s2, {least(["s3", added("s2", "assistant")])} AS s3
  FROM (SELECT conv_id, s0, s1, {added("s0", "user")} AS s2, s3 FROM (SELECT DISTINCT conv_id, {begin} AS s0, {none} AS s1, {none} AS s3 FROM conversations))
  UNION ALL
  SELECT conv_id, n, m0, m1, t2, {least(["m3", added("t2", "assistant")])}
  FROM (SELECT *, {least(["m2"] + [added(m, "user") for m in ("m0", "m1", "m3")])} AS t2
        FROM (SELECT dp.conv_id, r.n, {", ".join(f"{least(w)} AS {m}" for m, w in steps.items())}
              FROM dp JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.n = dp.n + 1))),
last AS (SELECT conv_id, {least(["s0", "s3"])} AS best FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 1) AS blank, count_if(f = 2) AS duplicate,
         count_if(f = 3) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal FROM paired GROUP BY conv_id)
SELECT last.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit,
       sha256(best.o[2:]) AS repaired_sha256
FROM last LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM last.conv_id"""


@query("op13_conversation_repair", _repair_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    judged = conversation_repair.repair(conversation_repair.damaged(rows))
    every = rows.select(F.col("conv_id").alias("_conv")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return (every.join(judged, F.col("_conv").eqNullSafe(F.col("conv_id")), "left")
            .select(F.col("_conv").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
