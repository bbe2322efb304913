"""The operators as registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tradewind.llm import exact, language, licenses, mixing, neardup, packing, periodic, private, rules, sites, substrings, toxicity, tries
from tradewind.llm.shared import join_groups, stored

TOKENIZER = {
    "json_path": public_tokenizers.path("byte_bpe_50k.json"),
    "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    "pattern": public_tokenizers.PATTERN,
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    # skewed joins are split also where a shuffle follows
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def document_language_model(spark: SparkSession, folder: str) -> language.LanguageModel:
    return language.fit_language_model(table(spark, folder, "documents"), "text", "lang", "doc_id")


def packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_sequences(table(spark, folder, "documents"), **TOKENIZER)


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_sources(table(spark, folder, "documents")).drop("shard")


def license_notices(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(spark, folder, "documents"))


def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Learns from labels of ids whose CRC-32, as text, is no multiple of 5; the others are held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def private_spans(spark: SparkSession, folder: str) -> DataFrame:
    return private.span_digest(private.find_private(table(spark, folder, "documents")))


def document_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The source is a document's host; its texts of one language are a path of it."""
    docs = table(spark, folder, "documents")
    model = sites.fit_quality(docs, table(spark, folder, "labels"))
    return sites.site_quality(docs, model, F.col("source"), F.col("lang"))


def rule_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled good are the trusted target."""
    good = table(spark, folder, "labels").where("quality = 1").select("doc_id")
    return rules.quality_rules(table(spark, folder, "documents"), good)


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    decided = exact.exact_duplicates(table(spark, folder, "documents"), exact.half_of())
    return decided.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def document_language(spark: SparkSession, folder: str) -> DataFrame:
    """Documents declare a language and have a source as host; they have no address."""
    model = document_language_model(spark, folder)
    return language.identify_language(table(spark, folder, "documents"), model, declared=F.col("lang"), hosts=(F.col("source"),))


def page_language(spark: SparkSession, folder: str) -> DataFrame:
    """Pages declare a language in their markup and have an address: suffix, site and host.

    An address that is null or cannot be read says nothing; a null page is an empty text.
    """
    model = document_language_model(spark, folder)
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    # what is not closed is hidden to the end, as a browser does, so no open tag is tried twice
    html = F.coalesce(F.col("html"), F.lit(""))
    hidden = r"(?is)<script\b(?:[^<]++|<(?!/script))*+(?:</script[^>]*+>|\z)|<style\b(?:[^<]++|<(?!/style))*+(?:</style[^>]*+>|\z)|<!--(?:[^-]++|-(?!->))*+(?:-->|\z)"
    text = F.regexp_replace(F.regexp_replace(html, hidden, " "), r"<[^<>]*+>", " ")
    found = language.identify_language(
        table(spark, folder, "pages").withColumn("text", text),
        model,
        "page_id",
        declared=F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1)), F.lit("")),
        suffix=F.nullif(F.regexp_extract(host, r"\.([a-z]+)$", 1), F.lit("")),
        hosts=(F.regexp_extract(host, r"([^.]+\.[^.]+\.[^.]+)$", 0), host),
    )
    return found.withColumnRenamed("doc_id", "page_id")


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns and the ids of the rebuilt conversations: the first turns of the family's first conversation, then the own
    turns after as many of the own."""
    turns = stored(tries.number_turns(conversations), "numbered")
    own = stored(turns.groupBy("conv").agg(F.max("at").alias("len")), "lengths")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    family = own.select("conv", "len", head.alias("head"), (F.col("conv") - F.col("conv") % 20).alias("first"))
    first = family.join(own.select(F.col("conv").alias("first"), F.col("len").alias("first_len")), "first", "left")
    have = F.least("head", F.coalesce("first_len", F.lit(0))).alias("have")
    family = stored(first.select("conv", "len", "first", "head", have), "families")
    opening = turns.where("at <= 3").withColumnRenamed("conv", "first").join(family, "first").where("at <= have")
    rest = join_groups(turns, family, ["conv"], "len", turns.count()).where("at > head")
    rest = rest.withColumn("at", F.col("at") - F.col("head") + F.col("have"))
    columns = ["conv", "at", "c1", "c2", "words"]
    return stored(opening.select(columns).unionByName(rest.select(columns)), "rebuilt"), own.select("conv")


def conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return tries.prefix_nodes(*rebuilt_turns(table(spark, folder, "conversations")))


def repeated_windows(spark: SparkSession, folder: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Texts of every tenth id, by the CRC-32 of the id, repeat a block of their words from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    split = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    # each step is a projection of its own, so that a text is split once
    listed = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), F.when(h % 10 == 0, split).alias("words"))
    listed = listed.withColumn("n", F.coalesce(F.size("words"), F.lit(0)))
    listed = listed.withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    listed = listed.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    block = F.slice("words", F.col("a") + 1, F.col("p"))
    rest = F.slice(F.flatten(F.array_repeat(block, F.expr("cast(ceil((n - a) / p) as int)"))), 1, F.col("n") - F.col("a"))
    changed = F.array_join(F.concat(F.slice("words", 1, F.col("a")), rest), " ")
    return listed.select("doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of all runs and of the collapsed text, and the longest run."""
    found = periodic.find_runs(with_planted_runs(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    lines = F.when(F.size(line) > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("longest.s")).alias("start"),
        F.col("longest.length").alias("length"),
        (-F.col("longest.p")).alias("period"),
        F.expr("1000 * longest.length div -longest.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {
        "op1_hilbert_packing": packed,
        "op2_source_mixing": mixed,
        "op3_license_notices": license_notices,
        "op4_toxicity": toxicity_scores,
        "op5_private_spans": private_spans,
        "op6_near_duplicates": near_duplicates,
        "op7_site_quality": document_quality,
        "op8_exact_duplicates": exact_duplicates,
        "op9_language_id": document_language,
        "op10_quality_rules": rule_verdicts,
        "op11_prefix_trie": conversation_trie,
        "op12_repeated_windows": repeated_windows,
        "op13_periodic_runs": periodic_runs,
        "page_language_id": page_language,
        "pipeline": corpus_pipeline.run,
    }


EXACT_SQL = """
with texts as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as normal from documents
)
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size, doc_id = max(doc_id) over same as kept, sha256(normal) as text_sha256
from texts window same as (partition by normal)
"""

WINDOWS_SQL = r"""
with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
windows as (
  select doc_id, unnest(range(1, len(words) - 18)) as spot, unnest([array_to_string(words[i:i + 19], ' ') for i in range(1, len(words) - 18)]) as said from split
),
later as (select doc_id, spot from (select *, row_number() over (partition by said order by doc_id, spot) as nr from windows) where nr > 1),
removed as (select distinct doc_id, unnest(range(spot, spot + 20)) as spot from later),
placed as (select doc_id, unnest(range(1, len(words) + 1)) as spot, unnest(words) as word from split),
kept as (
  select doc_id, string_agg(word, ' ' order by spot) as rest, count(*) as n_kept from placed anti join removed using (doc_id, spot) group by doc_id
)
select doc_id, len(words) as n_words, len(words) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from split left join kept using (doc_id)
"""

NEAR_SQL = r"""
with recursive split as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from documents
),
sets as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
    else list_distinct([array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]) end as shingles from split
),
spread as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from sets),
links as (
  select a.doc_id as x, b.doc_id as y from spread a join spread b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))
),
reach as (select doc_id as x, doc_id as y from sets union select reach.x, links.y from reach join links on reach.y = links.x)
select doc_id, len(shingles) as n_shingles, min(y) as component_id, doc_id = min(y) as kept
from sets join reach on reach.x = doc_id group by doc_id, n_shingles
"""


def oracle_sql() -> dict[str, str]:
    """SQL for operators whose result a query over whole tables can state; ids are expected to be unique, as their docstrings say."""
    return {"op6_near_duplicates": NEAR_SQL, "op8_exact_duplicates": EXACT_SQL, "op12_repeated_windows": WINDOWS_SQL}
