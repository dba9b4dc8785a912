"""Quality rules with a hashed n-gram likelihood ratio. DataFrame functions only.

Two multinomials over hashed word n-grams are compared: one of trusted
documents and one of the raw corpus. A document's verdict is the sum of the
log-ratios of its n-grams, divided by their number, against a fixed threshold.
Ratios are rounded to integers in units of 1 / SCALE nat, so sums do not depend
on the order of rows and every rerun decides every document alike.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, staged

#: Buckets of the hashed n-grams; the weights of all buckets travel as one literal.
BUCKETS = 1 << 16
SCALE = 1024
#: Expected occurrences that a bucket needs before its ratio counts half.
SMOOTHING = 10.0
#: Rows of marked ids (some 40 bytes each; one for 64 neighbouring integer ids) up to which they are broadcast.
BROADCAST_MARKS = 4_000_000
#: Nats per n-gram below which a document is rejected.
THRESHOLD = -0.1
WINDOW = 5
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def _prepared(docs: DataFrame, carried: list[Column], text_col: str) -> DataFrame:
    """carried columns, trimmed text, words and their hashes."""
    trimmed = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE_CHARS))
    words = F.when(F.col("_text") == "", F.array().cast("array<string>")).otherwise(F.split("_text", SPACE_RUN))
    rows = docs.select(*carried, F.col(text_col).alias("_raw"), trimmed.alias("_text")).withColumn("_words", words)
    return rows.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))


def _grams() -> Column:
    """Bucket of every word and of every pair of neighbouring words."""
    h = F.col("_hashes")
    mask = F.lit(BUCKETS - 1).cast("bigint")
    single = F.transform(h, lambda x: x.bitwiseAND(mask).cast("int"))
    firsts = F.slice(h, F.lit(1), F.greatest(F.size(h) - 1, F.lit(0)))
    pairs = F.transform(firsts, lambda x, i: F.xxhash64(x, F.get(h, i + 1)).bitwiseAND(mask).cast("int"))
    return F.concat(single, pairs)


def _marked(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, text, _good) of all ``docs``, and the staged marks of ``trusted.id`` that tell which are good.

    Integer ids are marked by one bit each of a long for 64 neighbours, so the
    marks of numbered documents stay far smaller than their ids and travel to
    the texts instead of the texts to them. Ids of other types have a row each.
    """
    whole = all(isinstance(df.schema[c].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) for df, c in ((docs, id_col), (trusted, "id")))

    def place(c: Column) -> tuple[Column, Column]:
        return (F.shiftright(c.cast("bigint"), 6), c.cast("bigint").bitwiseAND(F.lit(63)).cast("int")) if whole else (c, F.lit(0))

    key, bit = place(F.col("id"))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)
    marks = staged(trusted.filter("id is not null").select(key.alias("_key"), one.alias("_bit")).groupBy("_key").agg(F.bit_or("_bit").alias("_bits")), "trusted-marks")
    few = F.broadcast(marks) if marks.count() <= BROADCAST_MARKS else marks
    key, bit = place(F.col(id_col))
    good = F.coalesce(F.getbit("_bits", bit) == 1, F.lit(False))
    return docs.select(id_col, text_col).join(few, key == F.col("_key"), "left").select(id_col, text_col, good.alias("_good")), marks


def gram_weights(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> list[int]:
    """One integer log-ratio (units of 1 / SCALE) for each bucket.

    The raw model counts the n-grams of all ``docs``, the target model those of
    all documents whose id is in ``trusted.id``, which are broadcast as bits;
    only beyond BROADCAST_MARKS rows of them are texts shuffled. A bucket's
    ratio is shrunk to 0 by SMOOTHING expected occurrences. Without trusted
    documents all weights are 0. Counts are summed before the shuffle; BUCKETS
    rows reach the driver, whatever the input.
    """
    rows, marks = _marked(docs, trusted, id_col, text_col)
    rows = _prepared(rows, [F.col("_good")], text_col)
    found = rows.select("_good", F.explode(_grams()).alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("raw"), F.count_if("_good").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in found.collect():
        raw[row[0]], target[row[0]] = row[1], row[2]
    discard(marks)
    share = sum(target) / max(sum(raw), 1)
    return [round(SCALE * math.log((t + SMOOTHING) / (share * r + SMOOTHING))) if share else 0 for r, t in zip(raw, target, strict=True)]


def measured(docs: DataFrame, weights: list[int], carried: list[Column], *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """carried columns and the measures, base_failed, score and kept of each row."""
    rows = _prepared(docs, carried, text_col)
    names = [c for c in rows.columns if c not in ("_raw", "_text", "_words", "_hashes")]
    h = F.col("_hashes")
    n = F.size("_words").cast("bigint")
    joined = F.array_join("_words", "")
    lines = F.filter(F.split(F.coalesce("_raw", F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    windows = F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - WINDOW + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))
    # ratios as one string that Spark folds into an array literal once
    literal = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
    rows = rows.select(*names, "_hashes", n.alias("n_words"), joined.alias("_joined"), lines.alias("_lines"), windows.alias("_windows"), _grams().alias("_grams"))
    score = F.aggregate("_grams", F.lit(0).cast("bigint"), lambda acc, g: acc + F.get(literal, g))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    rows = rows.select(
        *names,
        "n_words",
        F.length("_joined").cast("bigint").alias("word_chars"),
        (F.length("_joined") - F.length(F.translate("_joined", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(repeats, F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("p"))))).alias("_ranked"),
        score.alias("_score"),
        F.size("_grams").alias("_n_grams"),
    )
    ranked = F.col("_ranked")
    twins = F.filter(ranked, lambda x, i: F.coalesce(x["h"] == F.get(ranked, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ranked, i + 1)["h"], F.lit(False)))
    rows = rows.withColumn("_starts", F.sort_array(F.transform(twins, lambda x: x["p"])))
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, p: F.struct((acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")),
        lambda acc: acc["n"],
    )
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    verdict = F.col("_score") >= F.lit(threshold * SCALE) * F.col("_n_grams")
    rows = rows.withColumn("base_failed", failed).withColumn("score", F.when(F.col("_n_grams") > 0, F.col("_score") / F.lit(float(SCALE)) / F.col("_n_grams")))
    rows = rows.withColumn("kept", ~F.col("base_failed") & verdict)
    out = [*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"]
    # one row in, one row out: a filter on the result stays above the explode instead of being unfolded into all the measures
    return rows.select(F.explode_outer(F.array(F.struct(*out))).alias("_out")).select("_out.*")


def assess(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: id, measures, base_failed, kept, score (nats per n-gram).

    Null and word-less texts have no words and fail the base rules (score
    null). Repeated rows are judged one by one alike, null ids are kept as they
    are and are never trusted, other columns are ignored, an empty table gives
    an empty table. Windows of five words are compared by 64-bit hashes. No row
    is shuffled.
    """
    weights = gram_weights(docs, trusted, id_col=id_col, text_col=text_col)
    return measured(docs.select(id_col, text_col), weights, [F.col(id_col)], text_col=text_col, threshold=threshold)


def keep_good(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns.

    Null and word-less texts go, repeated rows and null ids are judged row by
    row, and an empty table gives an empty one.
    """
    weights = gram_weights(docs, trusted, id_col=id_col, text_col=text_col)
    rows = measured(docs, weights, [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")], text_col=text_col, threshold=threshold)
    # an outer explode instead of a filter, which Spark would push down and so compute the measures many times over
    one = rows.select(F.explode_outer(F.when(F.col("kept"), F.array("_row"))).alias("_row"))
    return one.filter("_row is not null").select(*(F.col("_row")[c].alias(c) for c in docs.columns))
