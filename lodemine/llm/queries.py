"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemine.llm import (
    archives,
    decontaminate,
    filter_audit,
    langid,
    mixing,
    ngram_join,
    packing,
    periodic_runs,
    pseudonyms,
    quality,
    reply_trees,
    risk_rules,
    sharding,
)
from lodemine.llm.common import held_out, learnable, tokenizer_file, words
from lodemine.operators.skew import positions
from lodemine.session import materialize, scratch_path
from lodemine.sources.readers import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


@register
def op1_language_id(spark, folder):
    """The language of every document, learnt from the three quarters of them that are not held out."""
    docs = table(spark, folder, "documents")
    model = langid.train(docs, "text", "lang", learnable())
    return langid.predict(spark, docs, "doc_id", "text", model, [held_out().alias("held_out")])


@register
def op2_pseudonyms(spark, folder):
    """All documents with personal data replaced by keyed pseudonyms."""
    out = pseudonyms.pseudonymise(table(spark, folder, "documents"), key="corpus")
    return out.select("doc.doc_id", "text", F.size("kinds").cast("bigint").alias("n_replaced"), F.array_join("kinds", ",").alias("kinds"))


@register
def op3_quality(spark, folder):
    """The quality of every document by weighted rules, learnt from labels outside the held-out quarter."""
    model, statistics = quality.train(table(spark, folder, "documents"), table(spark, folder, "labels"), learnable())
    scored = statistics.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@register
def op4_reply_trees(spark, folder):
    """All conversations, each turn a reply to the turn before, formatted and read back."""
    told = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    line = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", line), (-7, 1, "assistant", line)], "conv_id bigint, turn bigint, role string, text string")
    turns = positions(told.unionByName(added).where("conv_id IS NOT NULL"), ["conv_id"], ["turn", "role", "text"], name="node")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    messages = turns.select(F.col("conv_id").alias("tree"), "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))
    pieces = reply_trees.formatted(reply_trees.chosen_paths(messages))
    return reply_trees.read_back(materialize(pieces)).withColumnRenamed("tree", "conv_id").drop("leaf")


@register
def op5_decontamination(spark, folder):
    """Every document against all windows of the benchmark."""
    found = decontaminate.find_overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


@register
def op6_ngram_join(spark, folder):
    """Near-duplicate components of all documents."""
    return ngram_join.similar_components(table(spark, folder, "documents"))


@register
def op7_mixing(spark, folder):
    """The sampling rate of every document after raking to source, language and topic weights."""
    mixed = mixing.mix_documents(table(spark, folder, "documents"))
    return mixed.select("doc.doc_id", "doc.source", "doc.lang", F.expr("substr(topic_key, 2)").alias("topic"), "tokens", "rate", (F.col("copies") > 0).alias("selected"))


@register
def op8_risk_rules(spark, folder):
    """Every document judged by base rules and by cutoffs that are safe for good documents of its language."""
    judged = risk_rules.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register
def op9_sharding(spark, folder):
    """All documents dealt to eight shards of equal row counts."""
    docs = table(spark, folder, "documents")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, 8)
    return dealt.select("row.*", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register
def op10_archives(spark, folder):
    """All pages written as legacy archives, converted, and read back from the new ones."""
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    archives.write_arc(table(spark, folder, "pages"), arc)
    archives.convert(spark, arc, warc)
    records = archives.read_warc(spark, warc)
    meant = records.where("kind = 'response'").select(F.col("record_id").alias("refers_to"), F.col("key").alias("first_id"))
    return records.join(meant, "refers_to", "left").select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), F.col("first_id").alias("refers_to")
    )


@register
def op11_packing(spark, folder):
    """All documents as token pieces, packed into sequences of 2,048 tokens."""
    made = packing.pieces(table(spark, folder, "documents"), "text", [F.col("doc_id")], tokenizer_file("byte_bpe_50k.json"), 2048, with_ids=False)
    return packing.pack_pieces(made, 2048).select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@register
def op12_filter_audit(spark, folder):
    """Five filters over all documents, in all orders."""
    filters = {
        "A": F.col("n_words") < 200,
        "B": 100 * F.col("n_distinct") < 50 * F.col("n_words"),
        "C": 100 * F.col("n_capitals") > 3 * F.col("n_points"),
        "D": F.col("n_symbols") > 0,
    }
    sets = filter_audit.failing_sets(table(spark, folder, "documents"), table(spark, folder, "labels"), filters, copies="E")
    return filter_audit.audit(sets, [*filters, "E"])


@register
def op13_periodic_runs(spark, folder):
    """The periodic runs of all documents, with repetitions planted in a tenth of them as the contract says."""
    hashed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, folder, "documents").select("doc_id", "text", words(F.col("text")).alias("w"), hashed.alias("h"))
    docs = docs.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
    docs = docs.withColumn("a", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.col("g") % F.col("n")).cast("int"))
    docs = docs.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    tail = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(tail, F.lit(1), F.col("n") - F.col("a")))
    text = F.when(F.col("a").isNotNull(), F.array_join(planted, " ")).otherwise(F.col("text"))
    found = periodic_runs.periodic_runs(docs, text, [F.col("doc_id")])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    found = found.withColumn("best", best)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
