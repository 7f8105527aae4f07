"""Mixing sources to target weights by entropy balancing (operator 4, DataFrame functions only).

A document's size is its number of words. Sources in the order of their names, null last, weigh 3, 1,
2, repeating, and share 150 % of all words; a source stops at twice its words and the excess goes to
the others by weight. A document of size x in a source is to be taken at the rate 2 / (1 + exp(-t x)):
of all rates between 0 and 2 that give the source its words these are the nearest to 1 in (binary)
relative entropy, and the tilt t of each source is the solution of the convex dual, found by Newton
steps for all sources at once, each step an aggregation, kept inside a bracket. Rates then become 0, 1
or 2 copies. Within a source the documents are counted by classes of size (exact below 64 words, within
1/64 above), the number of copies of each class follows the running total of words from the largest
class down, and a class gives its extra copies to the documents with the smallest hashes.

Defined cases: null and empty texts have size 0 and are not taken; an empty source name is a source; rows
with a null doc_id are documents as any other; equal rows may be taken differently from one another but
reruns agree on how many; other columns are kept by ``mix`` and ignored by ``plan``; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltledger.sources.staging import Staging

# The weights of sources in order, the share of all words, the most a document is taken.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0

WORD = r"[^\x20\x09-\x0D]+"
EXACT_BITS = 6
RANKED = 1000
NEWTON_STEPS = 60
TOLERANCE = 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to (source, source_size): one row per source, so the windows are small.

    min(2 size, level * weight) for the one level at which the targets sum to the share: sources are
    full in the order of 2 size / weight.
    """
    named = sources.withColumn("_null", F.col("source").isNull())
    turn = F.row_number().over(Window.orderBy("_null", "source")) - 1
    weights = F.array(*(F.lit(float(w)) for w in WEIGHTS))
    weighed = named.withColumn("_w", F.element_at(weights, (turn % len(WEIGHTS) + 1).cast("int")))
    full = F.col("source_size") * MOST
    weighed = weighed.withColumn("_full", full).withColumn("_at", F.col("_full") / F.col("_w"))
    everything = Window.orderBy("_at", "_null", "source")
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = F.coalesce(F.sum("_full").over(before), F.lit(0.0))
    open_weight = F.sum("_w").over(all_rows) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    wanted = F.sum("source_size").over(all_rows) * SHARE
    level = (wanted - held) / open_weight
    leveled = weighed.withColumn("_level", level)
    # The level is that of the first source that is not full at its own turn.
    chosen = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(all_rows)
    target = F.least("_full", F.coalesce(chosen["_level"], F.lit(float("inf"))) * F.col("_w"))
    return leveled.withColumn("target", target).drop("_null", "_w", "_full", "_at", "_level")


def size_class(size: Column) -> Column:
    """The size with all but its leading bits cleared."""
    bits = F.length(F.bin(size)) - EXACT_BITS
    shift = F.greatest(bits, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)


def _tilts(classes: DataFrame, goals: DataFrame, staging: Staging) -> DataFrame:
    """(key, tilt) by Newton steps on the dual; full sources have no tilt.

    ``classes`` has one row per source and class of size: key, n, words. The tilt is per word divided
    by the mean size of the source, so that one bracket serves all.
    """
    goal = goals.where((F.col("target") > 0) & (F.col("target") < F.col("source_size") * MOST * (1 - 1e-12)))
    goal = goal.select("key", "target", "source_size", "documents")
    rows = staging.write(
        classes.join(goal, "key").select(
            "key", "words",
            (F.col("words") / F.col("n") * F.col("documents") / F.col("source_size")).alias("x"),
        )
    )
    state = goal.select(
        "key", "target", F.lit(0.0).alias("tilt"), F.lit(-1e9).alias("low"), F.lit(1e9).alias("high"),
        F.lit(1.0).alias("gap"),
    )
    state = staging.write(state)
    for _ in range(NEWTON_STEPS):
        rate = F.lit(MOST) / (F.exp(F.least(-F.col("tilt") * F.col("x"), F.lit(700.0))) + 1)
        sums = rows.join(state, "key").groupBy("key").agg(
            F.sum(F.col("words") * rate).alias("taken"),
            F.sum(F.col("words") * F.col("x") * rate * (1 - rate / MOST)).alias("slope"),
        )
        gap = F.col("taken") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        moved = state.join(sums, "key").select("key", "target", "tilt", low.alias("low"), high.alias("high"),
                                              gap.alias("gap"), "slope")
        furthest = F.greatest(F.lit(4.0), F.abs("tilt"))
        jump = F.col("gap") / F.greatest("slope", F.lit(1e-12))
        newton = F.col("tilt") - F.greatest(-furthest, F.least(furthest, jump))
        middle = (F.col("low") + F.col("high")) / 2
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        done = F.abs("gap") <= F.col("target") * TOLERANCE
        tilt = F.when(done, F.col("tilt")).when(inside, newton).otherwise(middle)
        state = staging.write(
            moved.select("key", "target", tilt.alias("tilt"), "low", "high",
                         (F.abs("gap") / F.col("target")).alias("gap"))
        )
        if (state.agg(F.max("gap").alias("gap")).first().gap or 0.0) <= TOLERANCE:
            break
    return state.select("key", "tilt")


def _copies(rated: DataFrame) -> DataFrame:
    """Add the number of copies a class gives in all, from the largest class of a source down, each
    rounded so that the words taken so far keep to the words wanted so far.

    The rows of a source are its classes of size: 64 for each power of two, whatever the number of
    documents.
    """
    item = F.struct(
        (-F.col("class")).alias("down"), "class", "n", "words", "rate"
    )
    listed = rated.groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("items"))

    def step(state: Column, row: Column) -> Column:
        wanted = state["wanted"] + row["words"] * row["rate"]
        mean = row["words"] / row["n"]
        count = F.round((wanted - state["taken"]) / mean)
        count = F.greatest(F.lit(0.0), F.least(count, row["n"] * MOST))
        out = F.struct(row["class"].alias("class"), count.cast("long").alias("copies"))
        return F.struct(
            wanted.alias("wanted"),
            (state["taken"] + count * mean).alias("taken"),
            F.concat(state["out"], F.array(out)).alias("out"),
        )

    none = F.array().cast("array<struct<class:bigint,copies:bigint>>")
    begin = F.struct(F.lit(0.0).alias("wanted"), F.lit(0.0).alias("taken"), none.alias("out"))
    plan = F.aggregate("items", begin, step, lambda state: state["out"])
    return listed.select("key", F.explode(plan).alias("c")).select("key", "c.class", "c.copies")


def plan(docs: DataFrame, staging: Staging | None = None) -> DataFrame:
    """Per document: doc_id, size, source_size, target (of its source), rate and copies.

    The frame also has ``place``, a hash of the row that ``mix`` joins by.
    """
    staging = staging or Staging(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"),
                        F.xxhash64("doc_id", "source", "text").alias("place"))
    # "key" is never null, so that joins find the null source.
    key = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    sized = staging.write(sized.withColumn("key", key).withColumn("class", size_class(F.col("size"))))
    classes = staging.write(
        sized.groupBy("key", "class").agg(
            F.first("source").alias("source"), F.count("*").alias("n"), F.sum("size").alias("words")
        )
    )
    sources = classes.groupBy("key").agg(
        F.first("source").alias("source"), F.sum("words").alias("source_size"), F.sum("n").alias("documents")
    )
    goals = staging.write(targets(sources))
    filled = classes.where("class > 0")
    tilts = _tilts(filled, goals, staging)
    rated = filled.join(goals.select("key", "target", "source_size", "documents"), "key").join(tilts, "key", "left")
    x = F.col("words") / F.col("n") * F.col("documents") / F.col("source_size")
    full = F.col("target") >= F.col("source_size") * MOST * (1 - 1e-12)
    rate = (
        F.when(F.col("target") <= 0, 0.0)
        .when(full, MOST)
        .otherwise(F.lit(MOST) / (F.exp(F.least(-F.col("tilt") * x, F.lit(700.0))) + 1))
    )
    rated = staging.write(rated.select("key", "class", "n", "words", rate.alias("rate")))
    given = rated.join(_copies(rated), ["key", "class"])
    base = F.least(F.floor(F.col("copies") / F.col("n")), F.lit(int(MOST))).cast("long")
    given = staging.write(
        given.select("key", "class", "rate", base.alias("base"),
                     (F.col("copies") - base * F.col("n")).alias("extra"),
                     F.ceil(F.col("n") / F.lit(RANKED)).cast("long").alias("parts"))
    )
    # The documents with the smallest hashes get the extra copies. Parts of the hash range are counted
    # first; only the part in which the last copy falls is put in order.
    share = F.shiftright(F.col("place"), 33) + F.lit(1 << 30)  # 0 to 2 ** 31 - 1
    part = F.floor(share * F.col("parts") / F.lit(1 << 31)).cast("long")
    open_rows = sized.join(given, ["key", "class"], "left").withColumn("part", part)
    counted = open_rows.where("extra > 0").groupBy("key", "class", "part").agg(F.count("*").alias("m"))
    running = Window.partitionBy("key", "class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counted.withColumn("before", F.coalesce(F.sum("m").over(running), F.lit(0)))
    before = before.select("key", "class", "part", "m", "before")
    ranked = open_rows.join(before, ["key", "class", "part"], "left")
    cut = (F.col("before") < F.col("extra")) & (F.col("extra") < F.col("before") + F.col("m"))
    is_cut = F.coalesce(cut, F.lit(False))
    below = F.coalesce(F.col("before") + F.col("m") <= F.col("extra"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("key", "class", "part").orderBy("place", "doc_id"))
    ranked = (
        ranked.where(~is_cut)
        .withColumn("got", below.cast("int"))
        .unionByName(
            ranked.where(is_cut).withColumn("got", (F.col("before") + rank <= F.col("extra")).cast("int"))
        )
    )
    got = F.when(F.col("extra") > 0, F.col("got")).otherwise(0)
    copies = F.coalesce(F.col("base") + got, F.lit(0)).cast("long")
    done = ranked.select("doc_id", "key", "size", "place", F.coalesce("rate", F.lit(0.0)).alias("rate"),
                         copies.alias("copies"))
    return done.join(goals.select("key", "source_size", "target"), "key").drop("key")


def report(docs: DataFrame) -> DataFrame:
    return plan(docs).select(
        "doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate",
    )


def mix(docs: DataFrame, staging: Staging | None = None) -> DataFrame:
    """The documents as often as the mix takes them, with their columns."""
    staging = staging or Staging(docs.sparkSession, "mixing")
    planned = plan(docs, staging).where("copies > 0").groupBy(F.col("place").alias("_place"))
    planned = staging.write(planned.agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")))
    place = F.xxhash64("doc_id", "source", "text")
    joined = docs.withColumn("_place", place).join(planned, "_place")
    # Equal rows share their copies evenly, and one of them takes what is left over.
    each = F.floor(F.col("_copies") / F.col("_rows")).cast("int")
    left = (F.col("_copies") % F.col("_rows")).cast("int")
    rows = joined.withColumn("_each", each).unionByName(
        joined.where("_rows > 1").withColumn("_each", left).dropDuplicates(["_place"])
    )
    copied = rows.where("_each > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_each")))
    return copied.select(*docs.columns)
