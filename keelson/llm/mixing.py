"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Documents of a source have weights (by default the root of their
size, so that long documents are taken more often); the expected number of copies of a document is
its weight times a factor of its source, COPIES at most, such that the source's words come to its
target. The whole part is allotted for certain, the rest p, which differs from document to document,
is an inclusion probability. Documents are ranked by u/(1-u) / (p/(1-p)) with u a uniform hash of the
row (Rosen 1997), and taken from the lowest rank on while half of them or more fits the words that
the whole copies leave: a sample of fixed size in words, missed by half a document at most.

Weights are rounded to quarters of a power of two, so that a source's factor follows from at most 257
sums. A source may hold any share of the rows. No source is sorted as one group: ranks are cut into
4096 bins, and the bin where the target is reached into 4096 again; bins are summed before the
shuffle, and only rows of the last bin, a 2**-24 part of their source, are put in order. Rows that are
repeated tie there; they are counted by partition and numbered within it. Sources' targets come from a
table of one row per source; documents meet it by source and salt.

Defined results: a null text has size 0; null is a source of its own, ordered last; a source
without words has target 0; repeated rows are ranked one after another; an empty table gives
no rows; columns of the input but those named are not in the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, scratch

#: Weights of the sources in order, repeating; share of all words to take; copies at most.
WEIGHTS, SHARE, COPIES = (3, 1, 2), 1.5, 2.0
SALTS, BINS = 64, 4096
#: Bytes of a table that is broadcast.
SMALL = 8 << 20


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most=COPIES) -> DataFrame:
    """source, source_size, target: share of all words by weight, capped, the excess reshared."""
    by_source = checkpoint(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = checkpoint(by_source.repartitionByRange(16, *order).withColumn("part", F.spark_partition_id()))
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per partition
    before = F.array(*[F.lit(sum(n for q, n in counts.items() if q < p)) for p in range(max(counts, default=0) + 1)])
    rank = before[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(rank, F.lit(len(weights))).cast("int")]
    table = checkpoint(ranged.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).drop("part"))
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0  # words per unit of weight; rises as capped sources pass their excess on
    while True:
        full = F.col("cap") <= level * F.col("weight")
        capped, open_weight = table.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        new = (share * total - (capped or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    return table.select("source", "source_size", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


def factors(sizes: DataFrame, plan: DataFrame, most=COPIES) -> DataFrame:
    """``plan`` with factor and rest: copies are least(most, factor * weight), and what their whole parts leave of the target."""
    classes = sizes.groupBy("source", "class").agg(F.sum("size").alias("n")).filter("n > 0").withColumnRenamed("source", "source_")
    rows = classes.join(plan.select(F.col("source").alias("of_"), "target"), F.col("source_").eqNullSafe(F.col("of_"))).drop("of_").withColumn("w", weight_of("class"))
    heavy = Window.partitionBy("source_").orderBy(F.desc("class"))  # at most 257 rows a source
    above = F.coalesce(F.sum("n").over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(F.col("n") * F.col("w")).over(heavy.rowsBetween(0, Window.unboundedFollowing))
    tried = rows.withColumn("try", (F.col("target") - most * above) / below)
    fits = F.when(F.col("try") * F.col("w") <= most * (1 + 1e-9), F.col("try"))
    found = tried.groupBy("source_").agg(F.max_by(fits, F.when(fits.isNotNull(), F.col("class"))).alias("factor"))
    plan = plan.join(found, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    known = checkpoint(plan.withColumn("factor", F.greatest(F.lit(0.0), F.coalesce("factor", F.lit(float(1 << 60))))))
    copies = rows.join(known.select(F.col("source").alias("of_"), "factor"), F.col("source_").eqNullSafe(F.col("of_"))).withColumn("whole", whole_part(expected("factor", "class", most)))
    taken = copies.groupBy("source_").agg(F.sum(F.col("whole") * F.col("n")).alias("certain"))
    return known.join(taken, F.col("source").eqNullSafe(F.col("source_")), "left").withColumn("rest", F.col("target") - F.coalesce("certain", F.lit(0))).drop("source_", "certain")


def weight_of(name: str) -> Column:
    return F.pow(F.lit(2.0), F.col(name) / 4)


def expected(factor: str, name: str, most=COPIES) -> Column:
    return F.least(F.lit(float(most)), F.col(factor) * weight_of(name))


def whole_part(copies: Column) -> Column:
    return F.floor(copies + 1e-9).cast("long")


def measured(text_col: str = "text", weight: Column | None = None) -> dict[str, Column]:
    """size in words, class of the weight, checksum of the text."""
    size = n_words(F.col(text_col))
    heavy = F.sqrt(size.cast("double")) if weight is None else weight.cast("double")
    level = F.when(heavy > 0, F.greatest(F.lit(-128), F.least(F.lit(128), F.round(4 * F.log2(heavy))))).otherwise(0).cast("int")
    crc = F.crc32(F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8"))
    return {"size": size, "class": F.coalesce(level, F.lit(0)), "crc": crc}


def drawn(rows: DataFrame, seed: int, most=COPIES) -> DataFrame:
    """``rows`` (doc_id, size, class, crc and the source's factor) with whole copies, the odds p of one more, rank and its bins."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "crc"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    rows = rows.withColumn("u", u).withColumn("copies", expected("factor", "class", most)).withColumn("whole", whole_part(F.col("copies")))
    rows = rows.withColumn("p", F.when(F.col("copies") - F.col("whole") > 1e-9, F.col("copies") - F.col("whole")).otherwise(0.0)).drop("copies", "factor", "class")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    q = F.when(F.col("p") > 0, odds / (1 + odds)).otherwise(1.0)
    fine = F.least(F.floor(q * (BINS * BINS)), F.lit(BINS * BINS - 1)).cast("long")
    return rows.withColumn("rank", q).withColumn("fine", fine).withColumn("coarse", F.floor(fine / BINS).cast("long"))


def standing(b1: Column, b2: Column) -> Column:
    """1: one more copy is taken, 0: it is not (p is 0: there is none to take), 2: the row lies in the last bin."""
    return (
        F.when(F.col("p") == 0, 0)
        .when(b1.isNull() | (F.col("coarse") < b1), 1)
        .when(F.col("coarse") > b1, 0)
        .when(b2.isNull() | (F.col("fine") < b2), 1)
        .when(F.col("fine") == b2, 2)
        .otherwise(0)
    )


def decide(sizes: DataFrame, seed: int, row: list[str], **plan) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources with factor and last bins b1, b2 (null: not reached); rows that bins decide; rows of the last bins. ``in``: one more copy."""
    most = plan.get("most", COPIES)
    sources = checkpoint(factors(sizes, targets(sizes, **plan), most))
    salted = sizes.withColumn("salt", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(SALTS)).cast("int"))
    right = sources.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "source_")
    joined = salted.join(right, F.col("source").eqNullSafe(F.col("source_")) & (F.col("salt") == F.col("salt_"))).drop("source_", "salt_", "salt")
    ranked = checkpoint(drawn(joined, seed, most))

    def boundary(rows: DataFrame, bin_col: str, rest: str) -> DataFrame:
        """source, the bin in which ``rest`` words are reached, and what is left on entering it."""
        sums = rows.filter("p > 0").groupBy("source", bin_col).agg(F.sum("size").alias("n"), F.first(rest).alias("rest"))
        before = F.sum("n").over(Window.partitionBy("source").orderBy(bin_col)) - F.col("n")
        at = sums.withColumn("before", before).filter(F.col("before") + F.col("n") > F.col("rest"))
        return at.groupBy("source").agg(F.min(F.struct(F.col(bin_col), (F.col("rest") - F.col("before")).alias("left"))).alias("b"))

    def attach(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
        salted = found.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "source_").withColumnRenamed("b", name)
        on = F.col("source").eqNullSafe(F.col("source_")) & (F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(SALTS)) == F.col("salt_"))
        return rows.join(salted, on, "left").drop("source_", "salt_")

    first = checkpoint(boundary(ranked, "coarse", "rest"))
    rows = attach(ranked, first, "b1").withColumn("left1", F.when(F.col("coarse") == F.col("b1.coarse"), F.col("b1.left")))
    second = checkpoint(boundary(rows.filter("left1 is not null"), "fine", "left1"))
    rows = attach(rows, second, "b2").withColumn("state", standing(F.col("b1.coarse"), F.col("b2.fine")))
    rows = checkpoint(rows.withColumn("left2", F.col("b2.left")).withColumn("part", F.spark_partition_id()).drop("b1", "b2", "left1"))
    same = ["source", "rank", "doc_id", "crc", "size", "part"]
    last = rows.filter("state = 2").withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(*(row or ["size"]))))
    # rows that are repeated tie; one row stands for those of a partition
    ties = rows.filter("state = 2").groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.first("left2").alias("left2"))
    run = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("source").orderBy("rank", "doc_id", "crc", "part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("size")
    fits = F.when(F.col("size") > 0, F.floor((F.col("left2") - run) / F.col("size") + 0.5)).otherwise(0)
    upto = ties.withColumn("upto", fits).select(*[F.col(c).alias(f"{c}_") for c in same], "upto")
    on = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in same]
    edge = last.join(upto, on).withColumn("in", (F.col("nth") <= F.col("upto")).cast("int")).drop("nth", "upto", *[f"{c}_" for c in same])
    for found, b, bin_col in ((first, "b1", "coarse"), (second, "b2", "fine")):
        found = found.select(F.col("source").alias("of_"), F.col(f"b.{bin_col}").alias(b))
        sources = sources.join(found, F.col("source").eqNullSafe(F.col("of_")), "left").drop("of_")
    return sources, rows.filter("state < 2").withColumn("in", F.col("state")), edge


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weight: Column | None = None, **plan) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, odds (p), copies, taken, and ``row_col`` if there is one.

    weight: a positive number of each document; others, null and the weight of empty documents count as 1.
    """
    row = [row_col] if row_col else []
    sizes = checkpoint(docs.select(*row, F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *[c.alias(k) for k, c in measured(text_col, weight).items()]))
    _, sure, edge = decide(sizes, seed, row, **plan)
    copies = (F.col("whole") + F.col("in")).cast("long")
    return sure.unionByName(edge).withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", F.col("p").alias("odds"), "copies", (F.col("copies") * F.col("size")).alias("taken"), *row)


def repeat(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None, **plan) -> DataFrame:
    """Each row of ``docs`` as often as ``mix`` takes it.

    Texts are written once, beside their measures. What decides is a table of sources and of the rows of their last
    bins; it is broadcast up to SMALL bytes, so that texts stay where they are. A larger one is met by row.
    """
    keys = {"row": F.monotonically_increasing_id(), "doc_id": F.col(id_col), "source": F.col(source_col)}  # rows of one doc_id, or of none, are told apart
    rows = checkpoint(docs.select(F.struct(*docs.columns).alias("doc"), *[c.alias(k) for k, c in (keys | measured(text_col, weight)).items()]))
    with scratch() as keep:
        sources, sure, edge = decide(rows.drop("doc"), seed, ["row"], **plan)
        known = checkpoint(sources.select("source", "factor", "b1", "b2").unionByName(edge.select("row", "in"), allowMissingColumns=True))
        weighs = known.agg(F.sum(F.coalesce(F.octet_length(F.col("source").cast("string")), F.lit(0)) + 100)).first()[0] or 0
        if weighs <= SMALL:
            known = keep(known.coalesce(1))
            of = known.filter("row is null").select(F.col("source").alias("source_"), "factor", "b1", "b2")
            tied = known.filter("row is not null").select("row", "in")
            met = drawn(rows.join(F.broadcast(of), F.col("source").eqNullSafe(F.col("source_"))), seed, plan.get("most", COPIES))
            taken = met.withColumn("state", standing(F.col("b1"), F.col("b2"))).join(F.broadcast(tied), "row", "left")
            taken = taken.withColumn("copies", F.col("whole") + F.coalesce("in", "state"))
        else:
            copies = (F.col("whole") + F.col("in")).cast("long").alias("copies")
            taken = rows.join(keep(sure.unionByName(edge).select("row", copies).filter("copies > 0")), "row")
    return taken.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("doc.*")
