"""Mixing sources to target weights by Pareto order sampling.

Each document has an expected number of copies; the whole ones are certain.  For the remaining fraction p, documents are
ranked by (U / (1 - U)) / (p / (1 - p)), U a hash of the document, and the first ones are taken until
the source's words are reached: a fixed-size sample of unequal probabilities.  The cut in a source is narrowed digit by digit of
the rank: each round sums at most 2 ** DIGIT classes a source and keeps the one the cut falls in, so no source's rows meet in one task.
Sources, their targets and their factors stay tables; only sums over all of them come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import durable

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 2
#: Bits of a rank, and by how many of them its class is narrowed in a round.
BITS, DIGIT = 48, 6
#: Rows of a class that may be sorted in one task.
EDGE = 4096


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def tilt(size: Column) -> Column:
    """Relative inclusion of a document by its words, in steps of 1/8: short documents a little less, long ones a little more."""
    return F.round(F.least(F.greatest(F.log(size + 1) / F.lit(6.0), F.lit(0.5)), F.lit(1.5)) * 8) / 8


def shares(sources: DataFrame, weights=(3, 1, 2), total: float = 1.5, most: float = MOST_COPIES) -> DataFrame:
    """sources (source, size: one row each) with target: total * all words by weight; beyond most * its words a source gives to the others.

    Weights repeat over the sources by code point, null last.  Each round gives the sources that are full what they can take and shares the rest anew.
    """
    rows = durable(sources.orderBy(F.col("source").isNull(), "source").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "sources")
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    first = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("first"))  # a row for each partition of the sort
    place = F.col("first") + F.col("at") - F.shiftleft("part", 33)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    rows = durable(rows.join(first, "part").select("source", "size", weight.alias("weight")), "weights")
    all_ = rows.agg(F.sum("size")).first()[0] or 0
    unit, known = 0.0, -1
    while True:
        full = F.col("weight") * unit > most * F.col("size")
        r = rows.agg(F.count_if(full).alias("full"), F.sum(F.when(full, most * F.col("size")).otherwise(0.0)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if r["full"] == known or not r["open"]:
            break
        known, unit = r["full"], max(total * all_ - r["given"], 0.0) / r["open"]
    return rows.select("source", "size", F.when(full, most * F.col("size").cast("double")).otherwise(F.col("weight") * unit).alias("target"))


def factor(classes: Column, target: Column, most: float = MOST_COPIES) -> Column:
    """c such that the sum of min(most, c * w) * n over classes (array of structs w, n; w descending) is target."""
    start = F.struct(target.cast("double").alias("rest"), F.aggregate(classes, F.lit(0.0), lambda a, c: a + c["w"] * c["n"]).alias("words"), F.lit(None).cast("double").alias("c"))

    def step(a: Column, k: Column) -> Column:
        done = a["c"].isNotNull() | (a["words"] <= 0) | (a["rest"] <= 0)
        fits = a["rest"] / a["words"] * k["w"] <= most
        taken = F.struct((a["rest"] - most * k["n"]).alias("rest"), (a["words"] - k["w"] * k["n"]).alias("words"), F.lit(None).cast("double").alias("c"))
        found = F.struct(a["rest"].alias("rest"), a["words"].alias("words"), (a["rest"] / a["words"]).alias("c"))
        return F.when(done, a).when(fits, found).otherwise(taken)

    def finish(a: Column) -> Column:
        return F.coalesce(a["c"], F.when((a["words"] <= 0) & (a["rest"] >= 0), 1e9).when(a["words"] > 0, F.greatest(a["rest"], F.lit(0.0)) / a["words"]).otherwise(0.0))

    return F.aggregate(classes, start, step, finish)


def _same(other: str) -> Column:
    return F.col("source").eqNullSafe(F.col(other))


def _cuts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, low, low2) for each source, and the rows of its class of the cut with rest, the words still needed there.

    rows: row, source, size, need, key, key2.  Rows below (low, low2) are in the sample, and those of the cut's class as far as rest goes.
    """
    edge = rows.where("key is not null").withColumn("rest", F.col("need")).withColumn("low", F.lit(0).cast("long")).withColumn("low2", F.lit(0).cast("long"))
    per = BITS // DIGIT
    for level in range(2 * per):
        key, low = ("key", "low") if level < per else ("key2", "low2")
        shift = BITS - DIGIT * (level % per + 1)
        digit = F.shiftright(F.col(key), shift).bitwiseAND((1 << DIGIT) - 1)
        sums = edge.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest"))
        up = Window.partitionBy("source").orderBy("digit")
        sums = durable(sums.withColumn("before", F.sum("n").over(up) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy("source"))), "classes")
        if level == 0:  # where all or none is needed there is no class of the cut
            whole = sums.groupBy("source").agg(F.first("rest").alias("rest"), F.first("all").alias("all"))
            low_ = F.when(F.col("rest") < 0, 0).otherwise(1 << BITS).cast("long")
            outside = whole.where("rest < 0 or rest >= all").select("source", low_.alias("low"), F.lit(0).cast("long").alias("low2"))
        here = durable(sums.where("before <= rest and before + n > rest").select(F.col("source").alias("src"), "digit", F.col("before"), "rows"), "cut")
        edge = edge.join(here.select("src", F.col("digit").alias("own"), "before"), _same("src")).where(digit == F.col("own"))
        edge = edge.withColumn("rest", F.col("rest") - F.col("before")).withColumn(low, F.col(low) + F.shiftleft(F.col("own").cast("long"), shift)).drop("src", "own", "before")
        edge = durable(edge, "edge")
        if (here.agg(F.max("rows")).first()[0] or 0) <= EDGE:
            break
    cut = edge.groupBy("source").agg(F.first("low").alias("low"), F.first("low2").alias("low2"))
    return cut.unionByName(outside).withColumnRenamed("source", "src"), edge


def mix(docs: DataFrame, weights=(3, 1, 2), total: float = 1.5, seed: int = 11, row: Column | None = None) -> DataFrame:
    """(row, doc_id, source, size, source_size, target, copies, taken): a row for each row of docs (doc_id, text, source).

    Null or empty texts have size 0 and are never taken; a null source is one source, the last.  Equal rows share their random number, and ties
    are broken by a hash of row, then by row; row numbers rows as docs is read (monotonically_increasing_id) unless given.  taken = copies * size, at most 2 * size.
    An empty table gives an empty result.  Reruns over the same rows agree.  Other columns are ignored.
    """
    base = docs.select((F.monotonically_increasing_id() if row is None else row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), F.col("doc_id"), "text").alias("h"))
    base = durable(base.withColumn("w", tilt(F.col("size"))), "sizes")
    table = durable(base.groupBy("source", "w").agg(F.sum("size").alias("n")), "classes")  # tilt has 9 values
    plan = shares(table.groupBy("source").agg(F.sum("n").alias("size")), weights, total)
    by = table.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("by")).withColumnRenamed("source", "src")
    plan = plan.join(by, _same("src")).select("src", F.col("size").alias("source_size"), "target", factor(F.col("by"), F.col("target")).alias("factor"))
    rows = base.join(durable(plan, "plan"), _same("src")).drop("src")
    expected = F.when(F.col("size") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("factor") * F.col("w"))).otherwise(0.0)
    sure = F.floor(expected + 1e-9)
    rows = rows.withColumn("sure", sure.cast("long")).withColumn("p", F.greatest(expected - sure, F.lit(0.0)))
    u = (F.shiftrightunsigned("h", 11) + F.lit(0.5)) / F.lit(2.0**53)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    # The rank as a fraction, in BITS bits; null: no fraction is left to draw for.
    rank = F.least(F.floor(odds / (1 + odds) * (1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    rows = rows.withColumn("key", F.when(F.col("p") > 0, rank)).withColumn("key2", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "row"), 64 - BITS)).drop("h", "w", "factor", "p")
    certain = rows.groupBy("source").agg(F.sum(F.col("sure") * F.col("size")).alias("certain")).withColumnRenamed("source", "src")
    rows = rows.join(certain, _same("src")).drop("src").withColumn("need", F.col("target") - F.col("certain")).drop("certain")
    rows = durable(rows, "ranks")

    cut, edge = _cuts(rows.select("row", "source", "size", "need", "key", "key2"))
    along = Window.partitionBy("source").orderBy("key", "key2", "row")
    # The last one is taken if that ends nearer to the target.
    edge = edge.withColumn("sum", F.sum("size").over(along)).select(F.col("row").alias("edge_row"), (F.col("sum") - F.col("size") / 2 <= F.col("rest")).alias("edge"))
    rows = rows.join(cut, _same("src"), "left").join(edge, F.col("row") == F.col("edge_row"), "left")
    below = (F.col("key") < F.col("low")) | ((F.col("key") == F.col("low")) & (F.col("key2") < F.col("low2")))
    more = F.coalesce("edge", below, F.lit(False))
    copies = (F.col("sure") + more.cast("long")).alias("copies")
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", copies, (copies * F.col("size")).alias("taken"))
