"""Labelled rows and text measures shared by the two classifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F


def remainder(modulus: int) -> Column:
    """crc32 of the doc_id as text, modulo ``modulus``; a null doc_id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, share: float | None = None
) -> DataFrame:
    """(doc_id, text, label) of about ``most`` labelled rows at most, chosen by a hash of doc_id.

    With a ``share`` up to that part of them has label 1, however rare it is. Of a doc_id with
    contradicting labels, or with several texts, the smallest one counts.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).where(allowed)
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    is_one = F.col("label") == 1
    total = known.agg(F.count_if(is_one).alias("yes"), F.count_if(~is_one).alias("no")).first()
    wanted = most * (total.yes / max(total.yes + total.no, 1) if share is None else share)
    yes = min(wanted, total.yes)
    limits = [int(min(1.0, n / max(of, 1)) * (1 << 30)) for n, of in ((yes, total.yes), (most - yes, total.no))]
    limit = F.when(is_one, F.lit(limits[0])).otherwise(F.lit(limits[1]))
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(known), "doc_id")  # about ``most`` pairs of numbers, whatever the tables
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


_UPPER = re.compile("[A-ZÀ-Þ]")


def structure(text: str, words: list[str]) -> list[float]:
    """Measures of a text as a whole, each about 0 to 1."""
    n, w = max(len(text), 1), max(len(words), 1)
    count = text.count
    signs = sum(map(count, "#$%&*|!<>{}[]=~^"))
    marks = sum(map(count, ".,;:?'\"-()"))
    digits = sum(map(count, "0123456789"))
    lines = text.split("\n")
    short = sum(len(x) < 30 for x in lines)
    letters = sum(map(len, words))
    distinct = len(set(words))
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    upper = len(_UPPER.findall(text))
    spread = distinct / w
    return [
        signs / n * 10,
        marks / n * 10,
        digits / n * 10,
        upper / max(letters, 1),
        letters / w / 10,
        spread,
        repeats / w,
        len(set(lines)) / len(lines),
        short / len(lines),
        min(w, 5000) ** 0.5 / 70,
        count("|") / w,
        count("!!") / w,
        float(len(words) == 0),
        min(distinct, 2000) ** 0.5 / 45,
    ]
