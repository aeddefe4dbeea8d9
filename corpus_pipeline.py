"""A corpus pipeline over `documents`.

STAGES lists (name, function) in order; each function takes (spark, docs, sf_dir) and returns a
DataFrame, which `run` writes as Parquet to the shared folder and rereads as the next stage's docs. All
but the last return the columns of documents:

1. toxicity: documents that score at least the threshold go.
2. near_dedup: of each group of near duplicates the document with the least id stays.
3. substring_dedup: words of passages that a document with a smaller id holds too are taken out of the
   text; n_chars follows where a text changes.
4. decontaminate: documents that the contamination rule names go.
5. bpe_codec: token ids of what is left, with digests and the check that decoding gives the words back.

Rows with a null id are kept by stages 2 to 4, null and empty texts by all; rows that share an id are
judged each by its own text, so equal rows share their fate.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from fjordlake.llm.bpe_codec import digests
from fjordlake.llm.common import Scratch, bound_batches, table
from fjordlake.llm.decontaminate import contamination, judged
from fjordlake.llm.near_dedup import near_duplicates
from fjordlake.llm.substring_dedup import drop_repeats
from fjordlake.llm.toxicity import THRESHOLD, is_held_out, score_toxicity
from fjordlake.sources.shared import ship_package


def toxicity(spark, docs, sf_dir):
    bound_batches(spark)
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), held_out=is_held_out(F.col("doc_id")), with_row=True)
    return scored.where(F.col("_score") < THRESHOLD).drop("_score")


def _without(docs, gone):
    """docs without the rows that gone (doc_id, mark) names: mark is the xxhash64 of the text."""
    gone = gone.select(F.col("doc_id").alias("_gone_id"), F.col("mark").alias("_gone_mark")).distinct()
    own = (docs["doc_id"].cast("long") == gone["_gone_id"]) & (F.xxhash64(docs["text"].cast("string")) == gone["_gone_mark"])
    return docs.join(gone, own, "left_anti")


def near_dedup(spark, docs, sf_dir):
    return _without(docs, near_duplicates(docs, with_mark=True).where("NOT kept AND doc_id IS NOT NULL"))


def substring_dedup(spark, docs, sf_dir):
    out = drop_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontaminate(spark, docs, sf_dir):
    bad = judged(contamination(docs, table(spark, sf_dir, "benchmark"), with_text=True)).where("contaminated AND doc_id IS NOT NULL")
    return _without(docs, bad.select("doc_id", F.xxhash64("text").alias("mark")))


def bpe_codec(spark, docs, sf_dir):
    return digests(docs, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate),
    ("bpe_codec", bpe_codec),
]

#: SQL can't express the stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the whole documents table."""
    ship_package(spark)
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        docs = scratch.write(out, name)
