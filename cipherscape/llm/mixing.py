"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document of a source is to be copied ``target / source_size`` times.  The
whole part is certain; the fractions are rounded dependently.  Two sides meet, and
one gives copy probability to the other, in words, until one side is integral.
The direction is random such that each expectation stays what it was, and the
expected words of both together stay the same in each step.

Documents are dealt to blocks by a hash; within a block each, from the largest
on, meets the pool of the smaller ones after it, whose probabilities move alike,
so a large document is settled at once and the residual that remains is small:
a source ends within about one small document of its target.  The residuals of all blocks
meet in blocks again: a reduction tree whose every level has a ``block``-th of the
rows before, so a source that holds a third of the corpus is many small tasks.
Random numbers are hashes of the document's id and text, so reruns agree; rows that repeat
both are numbered and lie in blocks of their own.

Targets: sources in code-point order, null last, weigh ``weights`` in turn; a
target stops at ``most`` times its source's size and the excess is shared out by
weight until none is above.

Edge cases: a null or empty text has size 0, and is taken as often as its source's
whole part says, with 0 words; an empty source has target 0; repeated rows are rounded
each for itself; ties in size are broken by the random number; null ids and sources are values
like others; a very long text is one document, whose source ends within about its size of the
target if it is the only one; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherscape.llm.common import dense_ids, free, stage

#: Documents that meet in one block.
BLOCK = 64


def text_size(text: str) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, n, target) for rows of (source, size)."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    placed = dense_ids(sums, ["source"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = stage(placed.select("source", "source_size", "n", weight.alias("weight")), "sources")
    total = placed.agg(F.sum("source_size").alias("s")).first()["s"] or 0
    level, full = 0.0, F.col("source_size") * float(most)
    while True:  # the common target of a unit of weight; rises until no further source is full
        over = full <= F.col("weight") * level
        sums = placed.agg(F.sum(F.when(over, full)).alias("full"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        following = (share * total - (sums["full"] or 0.0)) / sums["open"] if sums["open"] else level
        if not sums["open"] or following <= level:
            break
        level = following
    return placed.select("source", "source_size", "n", F.least(full, F.col("weight") * level).alias("target"))


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with value computed once."""
    return F.transform(F.array(value), use)[0]


def _met(done: Column, x: Column) -> Column:
    """One meeting: document x and the pool of the smaller documents after it trade words.

    The pool's probabilities are ``a + b * p``; it holds ``size`` words, ``mass`` of
    them expected.
    """

    def offered(t: Column) -> Column:
        p = t["a"] + t["b"] * t["x"]["p"]
        size = t["size"] - t["x"]["size"]
        return F.struct(t["x"].alias("x"), t["a"].alias("a"), t["b"].alias("b"), p.alias("p"), size.alias("size"), (t["mass"] - p * t["x"]["size"]).alias("mass"))

    def weighed(t: Column) -> Column:
        own, mass, room = t["x"]["size"], F.greatest(t["mass"], F.lit(0.0)), F.greatest(t["size"] - t["mass"], F.lit(0.0))
        up, down = F.least((1 - t["p"]) * own, mass), F.least(t["p"] * own, room)  # words that x can take, and give
        # such that no expectation changes; a probability of 1 stays
        rises = (t["x"]["u"] * (up + down) < down) | (t["p"] >= 1)
        ends = F.when(rises, up >= (1 - t["p"]) * own).otherwise(down >= t["p"] * own)
        left = 1 - F.when(rises, F.when(mass > 0, up / mass).otherwise(0.0)).otherwise(F.when(room > 0, down / room).otherwise(0.0))
        return F.struct(
            t["x"].withField("p", F.when(ends, F.when(rises, 1.0).otherwise(0.0)).otherwise(F.when(rises, t["p"] + up / own).otherwise(t["p"] - down / own))).alias("x"),
            ends.alias("ends"), F.when(rises, t["a"] * left).otherwise(1 - left + t["a"] * left).alias("a"), (t["b"] * left).alias("b"),
            t["size"].alias("size"), F.when(rises, t["mass"] - up).otherwise(t["mass"] + down).alias("mass"),
        )

    def settled(t: Column) -> Column:
        return F.struct(
            F.when(t["ends"], F.concat(done["fixed"], F.array(t["x"]))).otherwise(done["fixed"]).alias("fixed"),
            F.when(t["ends"], done["residual"]).otherwise(t["x"]).alias("residual"), *[t[c].alias(c) for c in ("a", "b", "size", "mass")],
        )

    start = F.struct(x.alias("x"), *[done[c].alias(c) for c in ("a", "b", "size", "mass")])
    return _let(start, lambda t: _let(offered(t), lambda o: _let(weighed(o), settled)))


def rounded(rows: DataFrame, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """(row, extra) for rows of (row, source, key, size, p) with 0 < p < 1 and size > 0: p rounded to 0 or 1.

    key is what the random numbers hash, the same in every run; n is the number of
    rows of the source.
    """
    largest = rows.groupBy("source").count().agg(F.max("count").alias("n")).first()["n"] or 0
    sizes = rows.groupBy("source").agg(F.count("*").alias("n"))
    level, parts = 0, []
    now = rows.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    while True:
        blocks = F.ceil(F.col("n") / block)
        dealt = now.withColumn("block", F.pmod(F.xxhash64(F.col("key"), F.lit(seed), F.lit(2 * level)), blocks))
        random = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit(seed), F.lit(2 * level + 1)), 11) / float(1 << 53)
        item = F.struct((-F.col("size")).alias("order"), random.alias("u"), F.col("row"), F.col("key"), F.col("size"), F.col("p"))
        groups = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list(item)).alias("items"), F.max(blocks).alias("n"))
        nothing = F.expr("if(false, items[0], null)")
        size = F.aggregate("items", F.lit(0.0), lambda t, x: t + x["size"])
        mass = F.aggregate("items", F.lit(0.0), lambda t, x: t + x["p"] * x["size"])
        start = F.struct(
            F.slice("items", 1, 0).alias("fixed"), nothing.alias("residual"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"), size.alias("size"), mass.alias("mass")
        )
        # the last document of a block has no pool; it is the residual unless one was left before
        folded = groups.select("source", "n", F.element_at("items", -1).alias("last"), F.aggregate(F.expr("slice(items, 1, size(items) - 1)"), start, _met).alias("r"))
        folded = stage(folded, "mixed")
        last = F.col("last").withField("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("r.a") + F.col("r.b") * F.col("last.p"))))
        folded = folded.select(
            "source", "n", F.when(F.col("r.residual").isNull(), F.col("r.fixed")).otherwise(F.concat("r.fixed", F.array(last))).alias("fixed"),
            F.coalesce("r.residual", last).alias("left"),
        )
        parts.append(folded.select(F.explode("fixed").alias("x")).select("x.row", F.round("x.p").cast("int").alias("extra")))
        now = folded.select("left.row", "source", "left.key", "left.size", "left.p", "n")
        level += 1
        if largest <= block:
            break
        largest = -(-largest // block)
        # a block's size varies; the next level has at most as many rows as this one had blocks
    last = F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit(seed), F.lit(-1)), 11) / float(1 << 53)
    parts.append(now.select("row", (last < F.col("p")).cast("int").alias("extra")))
    return reduce(DataFrame.union, parts)


def apart(rows: DataFrame) -> DataFrame:
    """Rows (row, key, ...) with keys that no two rows share: of equal keys each but the first gets its number mixed in.

    Numbers count up within a partition of the input and on from what the partitions before it hold, so no task
    sees all rows of a key, and the keys don't depend on how the rows are dealt.
    """
    again = rows.groupBy("key").count().filter("count > 1").select("key")
    own = Window.partitionBy("key", "part").orderBy("row")
    some = rows.select("row", "key", F.shiftright("row", 33).alias("part")).join(again, "key", "left_semi").withColumn("n", F.row_number().over(own))
    sizes = some.groupBy("key", "part").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy("key").orderBy("part")) - F.col("size"))  # a row for each partition
    numbered = some.join(before, ["key", "part"]).select("row", (F.col("before") + F.col("n") - 1).alias("n"))
    return rows.join(numbered, "row", "left").withColumn("key", F.when(F.col("n") > 0, F.xxhash64("key", "n")).otherwise(F.col("key"))).drop("n")


def mixed(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 1, row: str | None = None
) -> DataFrame:
    """(row, id, size, source, source_size, target, copies): how often each row of ``docs`` is taken.

    ``row`` names a column that numbers the rows; without it they are numbered here.
    """
    row = F.col(row) if row else F.monotonically_increasing_id()
    rows = stage(docs.select(row.alias("row"), F.col(id), F.col(source).cast("string").alias("source"), text_size(text).alias("size"), F.xxhash64(id, text).alias("key")), "sizes")
    targets = stage(source_targets(rows, weights, share, most), "targets")
    named = targets.withColumnRenamed("source", "s").drop("n")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = rows.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("whole", F.floor(rate)).withColumn("p", rate - F.floor(rate))
    dealt = stage(dealt, "rates")
    open_rows = dealt.filter("p > 0 and size > 0").select("row", "source", "key", F.col("size").cast("double").alias("size"), "p")
    extra = rounded(stage(apart(open_rows), "open"), seed)
    return dealt.join(extra, "row", "left").select(
        "row", id, "size", "source", "source_size", "target", (F.col("whole") + F.coalesce("extra", F.lit(0))).alias("copies")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """The rows of ``docs``, each as often as the mix takes it."""
    columns = docs.columns
    row, times, copy = (free(name, columns) for name in ("row", "times", "copy"))
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    copies = mixed(rows, row=row, **options).filter("copies > 0").select(F.col("row").alias(row), F.col("copies").cast("int").alias(times))
    return rows.join(copies, row).withColumn(copy, F.explode(F.sequence(F.lit(1), times))).select(*columns)
