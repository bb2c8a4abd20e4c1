"""Exact dedup by content-defined chunk recipes, in DataFrame operations alone.

Each normalised text is cut where its own content says so. Equal texts are cut alike, so a text is the ordered list (the
recipe) of its chunks. Chunks are deduplicated to verified identifiers: all chunk texts are grouped by (hash, text), map-side
first, so a chunk that a third of all documents share moves once per task; a hash that stands for one text only is that
chunk's identifier, and where two texts share a hash their rank among them joins it. From then on only lists of
identifiers move: long texts cross the network once at most, as chunks, and never for comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, one_space, row_join, texts

#: A chunk has 512 characters at least and ends after a vowel, one of n to t, and a space; or at 8,192 characters.
CHUNK = r"(?s).{512,8192}?(?<=[aeiouy][n-t] )|.{1,8192}"


def chunks_of(text: Column, pattern: str = CHUNK) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def exact_groups(docs: DataFrame, pattern: str = CHUNK, digest: Callable[[Column], Column] = F.xxhash64, keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text), and th (hash of the text as it is) if keyed.

    Texts are equal if they are identical once each run of ASCII white space is one space; null and empty texts are equal.
    The row with the smallest doc_id of a group stays (null doc_ids come last; of rows that repeat a doc_id and text, one
    stays). An empty table gives no rows; other columns of docs, whatever their names, are ignored. digest is a parameter
    so that tests can force two chunks onto one hash.
    """
    work = Work(docs.sparkSession, "exact-dedup")
    base = texts(docs).select("doc_id", F.xxhash64(F.col("text").cast("binary")).alias("th"), one_space(F.col("text")).alias("text"))
    cut = base.select("doc_id", "th", "text", chunks_of(F.col("text"), pattern).alias("chunks"))
    recipes = work.save(
        cut.select(
            "doc_id",
            *["th"] * keyed,
            F.monotonically_increasing_id().alias("row"),
            F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
            F.transform("chunks", lambda c: digest(c)).alias("recipe"),
        ),
        "recipes",
    )
    piece = cut.select(F.explode("chunks").alias("chunk")).select(digest(F.col("chunk")).alias("h"), "chunk")
    verified = piece.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    shared = work.save(verified.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared-hashes")
    if not shared.isEmpty():
        recipes = work.save(_with_ranks(docs, recipes, shared, pattern, digest), "ranked-recipes")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    groups = recipes.groupBy("recipe").agg(first, F.count("*").alias("group_size"))
    # The hash joins the key so that both sides are dealt anew and a hot group's rows can be split among tasks.
    dealt = recipes.withColumn("k", F.xxhash64("recipe"))
    return dealt.join(groups.withColumn("k", F.xxhash64("recipe")), ["k", "recipe"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        *["th"] * keyed,
    )


def _with_ranks(docs: DataFrame, recipes: DataFrame, shared: DataFrame, pattern: str, digest: Callable[[Column], Column]) -> DataFrame:
    """Recipes in which a chunk whose hash stands for several texts is told apart by its rank among them."""
    cut = texts(docs).select(one_space(F.col("text")).alias("text"))
    cut = cut.select(F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), chunks_of(F.col("text"), pattern).alias("chunks")).dropDuplicates(["text_sha256"])
    each = cut.select("text_sha256", F.posexplode("chunks").alias("pos", "chunk")).withColumn("h", digest(F.col("chunk"))).join(shared, "h", "left_semi")
    ranked = each.select("h", "chunk").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).cast("long"))
    ranks = each.join(ranked, ["h", "chunk"]).groupBy("text_sha256").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "rank"))).alias("ranks"))
    extra = F.flatten(F.transform("ranks", lambda r: F.array(r["pos"], r["rank"])))
    return recipes.join(ranks, "text_sha256", "left").select(*[c for c in recipes.columns if c != "recipe"], F.when(F.col("ranks").isNotNull(), F.concat("recipe", extra)).otherwise(F.col("recipe")).alias("recipe"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_groups drops; all columns stay. Rows that repeat a doc_id and text leave one.

    Only the keys of dropped rows, and of rows that occur more than once, are joined with the documents again.
    """
    work = Work(docs.sparkSession, "keep-first")
    keys = exact_groups(docs, keyed=True).groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__n"))
    odd = work.save(keys.filter("not __kept or __n > 1"), "odd")
    once = row_join(docs, odd, "left_anti")
    twins = work.save(odd.filter("__kept").select("__id", "__th"), "twins")
    if twins.isEmpty():
        return once
    again = row_join(docs, twins, "inner")
    first = again.withColumn("__nth", F.row_number().over(Window.partitionBy("__id", "__th").orderBy(F.lit(1))))
    return once.unionByName(first.filter("__nth = 1").drop("__id", "__th", "__nth"))
