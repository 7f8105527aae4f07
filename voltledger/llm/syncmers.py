"""Document fingerprints of closed syncmers (operator 7, DataFrame functions only).

The units are words (runs of characters other than space and ``\\x09-\\x0D``); of scripts that are written
without blanks, and of words beyond ``LONG`` characters, every character is a unit. Of all runs of ``K``
units those are kept whose smallest inner run of ``S`` units, by hash, is the first or the last one. Whether a
run is kept depends on its own units alone, so texts that share a passage share its anchors wherever it
stands, and an edit touches only the anchors over it. ``K - 1`` marks are put before the first unit,
and no inner run is smaller than one of two marks, so that short texts have anchors as well.

Two neighbouring anchors are 1 to ``K - S`` units apart. A fingerprint holds each anchor with its distance from
the one before it (0 for the first): eight hexadecimal digits of the hash, one of the distance, so places can be told
from it. Anchors of two fingerprints match where hash and distance agree, that is where the text between
them takes as many units on either side. Likeness is the units that distinct matching anchors stand for (their
distance, 1 for the first) over those of all distinct anchors; it is made of the fingerprints and nothing else.

Defined cases: null and empty texts, and texts of white space, have no anchors and an empty
fingerprint; two such are alike with 1, one such and another with 0. Documents are ordered by doc_id
descending, null last; rows with one doc_id by a hash of their texts. A table of one row is its own
next document. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltledger.sources.staging import Staging

K = 7
S = 2
# The number for a mark: of those up to 2e8 the one whose pair has the smallest hash.
BEFORE = 173_297_524
LONG = 40
# Characters written without blanks: Thai, Lao, Burmese, Khmer, kana, Han.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF"
BLANK = r"\x20\x09-\x0D"
_LETTER = f"[^{BLANK}{UNSPACED}]"


def units_of(text: Column, words: Column) -> Column:
    """The units of a text that neither begins nor ends with white space, given its words. Only texts that
    need it are cut by the slow pattern."""
    cut = F.regexp_extract_all(
        text, F.lit(f"(?<!{_LETTER}){_LETTER}{{1,{LONG}}}+(?!{_LETTER})|[^{BLANK}]"), F.lit(0)
    )
    has_long = F.exists(words, lambda w: F.char_length(w) > LONG)
    has_unspaced = (F.octet_length(text) > F.char_length(text)) & text.rlike(f"[{UNSPACED}]")
    return F.when(has_long | has_unspaced, cut).otherwise(words)


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the hashes of a text's anchors in their order, and as ``<out>_at`` the places of their first
    units (below 0 for anchors that begin before the first one)."""
    units, inner, count, at = f"_u_{out}", f"_s_{out}", f"_n_{out}", f"{out}_at"
    trim, words = f"_t_{out}", f"_w_{out}"
    trimmed = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r"))
    lead = F.array_repeat(F.lit(BEFORE).cast("long"), K - 1)
    df = df.withColumn(trim, trimmed).withColumn(words, F.split(trim, f"[{BLANK}]+", -1))
    cut = units_of(F.col(trim), F.col(words))
    df = df.withColumn(units, F.concat(lead, F.transform(cut, lambda w: F.xxhash64(w))))
    u, trimmed = F.col(units), F.col(trim)
    df = df.withColumns(
        {
            count: F.when(trimmed == "", 0).otherwise(F.size(u)),
            inner: F.transform(u, lambda h, i: F.xxhash64(h, F.get(u, i + 1))),
        }
    )
    s, last = F.col(inner), K - S
    places = F.when(F.col(count) >= K, F.sequence(F.lit(0), F.col(count) - K))
    kept = F.filter(
        F.coalesce(places, F.array().cast("array<int>")),
        lambda i: F.least(F.get(s, i), F.get(s, i + last))
        <= F.least(*(F.get(s, i + j) for j in range(1, last))),
    )
    df = df.withColumn(at, kept)
    run = lambda i: F.xxhash64(*(F.get(u, i + j) for j in range(K)))
    df = df.withColumn(out, F.transform(F.col(at), run))
    return df.withColumn(at, F.transform(F.col(at), lambda i: i - (K - 1))).drop(units, inner, count, trim, words)


def placed(anchors: Column, at: Column) -> Column:
    """Each anchor as a number: 32 bits of its hash and four of its distance from the one before."""
    return F.transform(
        anchors,
        lambda h, i: F.shiftleft(h.bitwiseAND(F.lit(0xFFFFFFFF)), 4)
        + F.coalesce(F.get(at, i) - F.get(at, i - 1), F.lit(0)),
    )


def fingerprint(marks: Column) -> Column:
    """The placed anchors in order, nine hexadecimal digits each."""
    return F.array_join(F.transform(marks, lambda m: F.lpad(F.hex(m), 9, "0")), "")


def _units(marks: Column) -> Column:
    """The units that placed anchors stand for."""
    return F.aggregate(marks, F.lit(0).cast("long"), lambda n, m: n + F.greatest(m.bitwiseAND(F.lit(15)), F.lit(1)))


def likeness(one: Column, other: Column) -> Column:
    """Share of the units of either text whose anchors match, 0 to 1."""
    union = _units(F.array_union(one, other))
    shared = _units(F.array_intersect(one, other))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def with_placed(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the placed anchors of a text."""
    df, at = with_anchors(df, text, out), f"{out}_at"
    return df.withColumn(out, placed(F.col(out), F.col(at))).drop(at)


def with_next(docs: DataFrame, staging: Staging) -> DataFrame:
    """Every text with its placed anchors, and the text and anchors of the next document in descending
    order: doc_id, text, own, next_text, next.

    The texts move once, to buckets of the order. Where the buckets begin is read off a range
    partitioning of the keys alone; the first document of a bucket is copied to the end of the bucket
    above it, one row per shuffle partition, so that no bucket has to look into another.
    """
    keyed = docs.select(
        "doc_id",
        F.coalesce("text", F.lit("")).alias("text"),
        F.struct(
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"),
            F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"),
        ).alias("key"),
    )
    # A number of its own, for keys alone are too small to tell how many buckets the texts need.
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = keyed.select("key").repartitionByRange(buckets, "key")
    spread = spread.groupBy(F.spark_partition_id().alias("part"))
    ends = staging.write(spread.agg(F.min("key").alias("low"), F.max("key").alias("high")))
    lows = [row.low for row in ends.orderBy("low").collect()]
    if not lows:
        rows = with_placed(docs.select("doc_id", "text"), "text", "own")
        return rows.withColumns({"next_text": F.col("text"), "next": F.col("own")}).where(F.lit(False))

    def literal(key) -> Column:
        return F.struct(F.lit(key.d).cast("long").alias("d"), F.lit(key.h).cast("long").alias("h"))

    # Two steps over about sqrt(n) bounds each find the bucket among n.
    width = max(1, int(len(lows) ** 0.5))
    groups = [lows[i : i + width] for i in range(0, len(lows), width)]
    heads = F.array(*(literal(g[0]) for g in groups))
    group = F.size(F.filter(heads, lambda b: b <= F.col("key")))
    table = F.array(*(F.array(*map(literal, g)) for g in groups))
    inside = F.size(F.filter(F.element_at(table, F.col("_g")), lambda b: b <= F.col("key")))
    placed = keyed.withColumn("_g", F.greatest(group, F.lit(1)))
    placed = placed.withColumn("bucket", ((F.col("_g") - 1) * width + inside).cast("int")).drop("_g")

    order = Window.orderBy("low")  # one row per shuffle partition
    ranked = ends.withColumn("bucket", F.row_number().over(order))
    tops = ranked.select(F.col("high").alias("key"), (F.col("bucket") % len(lows) + 1).alias("target"))
    copied = keyed.join(F.broadcast(tops), "key").select(
        "doc_id", "text", "key", F.col("target").alias("bucket"), F.lit(True).alias("copied")
    )
    rows = placed.select("doc_id", "text", "key", "bucket", F.lit(False).alias("copied"))
    rows = with_placed(rows.unionByName(copied), "text", "own")
    window = Window.partitionBy("bucket").orderBy("copied", F.desc("key"))
    rows = rows.select(
        "doc_id", "text", "copied", "own",
        F.lead("text").over(window).alias("next_text"), F.lead("own").over(window).alias("next"),
    )
    return rows.where("NOT copied").drop("copied")


def fingerprints(docs: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are."""
    staging = staging or Staging(docs.sparkSession, "syncmers")
    rows = with_next(docs, staging).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")),
        F.substring("next_text", F.lit(1), cut),
    )
    rows = rows.select("doc_id", "n_chars", "own", "next", edited.alias("edited"))
    return with_placed(rows, "edited", "changed").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
        F.size("own").alias("n_anchors"),
    )
