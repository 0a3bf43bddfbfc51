"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomrec.llm.common import before_bucket, fresh, kept, seeded_order

WORD = r"[^\x20\x09-\x0D]+"
#: One copy in fixed point, so that running sums of rates are exact whatever order they are added in.
UNIT = 1 << 20
#: A table of one row per source is sent to all tasks up to this many rows, and joined by key beyond.
SMALL_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts as the source by code point with null last."""
    return F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0) -> DataFrame:
    """Words each source should give: shares by weight of all words, none above ``cap`` times its size.

    ``totals`` has (skey, source_size, ...), one row per source. What lies above a cap is shared again by
    weight until none is above: sources sorted by cap over weight fill up in that order, so the level
    that remains follows from running sums over the sources.
    """
    place = (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place + 1)
    rows = totals.withColumn("weight", weight).withColumn("most", cap * F.col("source_size"))
    by_fill = Window.orderBy(F.col("most") / F.col("weight"), "skey")
    rows = rows.withColumns({
        "filled": F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)),
        "all": F.sum("source_size").over(Window.partitionBy()),
    })
    rows = rows.withColumn("level", (F.col("all") - F.col("filled")) / F.col("open"))
    # The first source whose cap its level no longer reaches sets the level for itself and all after it.
    stays = F.col("level") * F.col("weight") < F.col("most")
    first = F.struct((F.col("most") / F.col("weight")).alias("fill"), "skey", "level")
    final = F.min(F.when(stays, first)).over(Window.partitionBy())["level"]
    share = F.least("most", F.coalesce(final * F.col("weight"), F.col("most")))
    return rows.withColumn("target", share).drop("filled", "open", "all", "level", "most")


def tilted(rate_of: Column, pull: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(rate_of * pull, F.lit(50.0))))


def solve_dual(sizes: DataFrame, targets: DataFrame, cap: float, tolerance: float, rounds: int) -> DataFrame:
    """Multipliers of the token constraints: per source the root of sum(size * min(cap, exp(m * pull))) = target.

    The dual is convex and splits by source, so its Hessian is diagonal. Each round is one distributed
    pass over the (source, size) counts that yields gradient and Hessian; a Newton step that would leave
    the bracket known so far is replaced by its middle.
    """
    small = targets.count() <= SMALL_SOURCES
    near = F.broadcast if small else (lambda df: df)
    # Begin where all rows of a source would have one rate; the tilt moves the root a little from there.
    even = F.log(F.greatest(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)), F.lit(1e-9)))
    state = kept(targets.withColumns({"m": even, "lo": F.lit(-400.0), "hi": F.lit(400.0), "off": F.lit(1.0)}))
    for _ in range(rounds):
        m, pull, weight = F.col("m"), F.pow(F.col("size") / F.col("mean_size"), F.col("bend")), F.col("size") * F.col("n")
        rate = tilted(m, pull, cap)
        sums = (
            sizes.join(near(state.select("skey", "m", "mean_size", "bend")), "skey").groupBy("skey")
            .agg(F.sum(weight * rate).alias("got"), F.sum(F.when(rate < cap, weight * pull * rate).otherwise(0.0)).alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        lo, hi = F.when(gap < 0, m).otherwise(F.col("lo")), F.when(gap > 0, m).otherwise(F.col("hi"))
        step = m - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (step > lo) & (step < hi)
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        done = (off <= tolerance) | (F.col("target") >= cap * F.col("source_size") * (1 - tolerance))
        state = kept(state.join(sums, "skey").select(
            *targets.columns, F.when(done, m).when(inside, step).otherwise((lo + hi) / 2).alias("m"),
            lo.alias("lo"), hi.alias("hi"), F.when(done, 0.0).otherwise(off).alias("off"),
        ))
        if not state.where("off > 0").head(1):
            break
    return state


def entropy_mix(
    docs: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), cap: float = 3.0, bend: float = 0.25, seed: int = 11,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size_col: str | None = None,
    tolerance: float = 1e-7, rounds: int = 60, rows_per_bucket: int = 20_000,
) -> DataFrame:
    """How many copies of each row a mixture takes, so that sources give their target words.

    Rates minimise the relative entropy to one copy of each row, subject to one token constraint per
    source and at most ``cap`` copies. They are r = min(cap, exp(m * (size / mean size of the source) ** bend)):
    ``bend`` 1 tilts by length in full, 0 not at all (every row of a source alike). The multipliers m come
    from Newton iterations over (source, size) counts.

    Rates become copies by systematic rounding: the rates of a source are added up in fixed point in the
    order (size class, slice of the seeded hash, size, hash), and a row takes the whole numbers that its
    step passes. Rows longer than their source's mean are rounded first; the rates of the others are
    then scaled to fill what is left of the target, so that it is met to about one short row. Rows of
    like size stand together. Buckets have bounded size; a source with a third of all rows is many.

    Sources rank by code point, null last, and weigh ``weights`` in turn. Null texts have size 0, as
    texts without a word; such rows have rate 1 and take no words. An empty table stays empty.
    Rows that repeat an id are rows of their own; rows equal in id and size are interchangeable. Input
    columns are kept; appended are size, source_size (long), target, rate (double), copies, taken (long),
    which replace columns of these names (``size_col`` gives sizes already counted).
    """
    made = ["size", "source_size", "target", "rate", "copies", "taken"]
    plain = docs.drop(*[c for c in made if c != size_col])
    k, z, h, cls, part, fixed, base, whole, run, long_row = fresh(
        plain, "skey", "words", "mix_hash", "mix_class", "mix_part", "mix_rate", "mix_base", "mix_all", "mix_run", "mix_long"
    )
    rows = plain.withColumns({
        k: source_key(F.col(source_col)),
        z: F.coalesce(F.col(size_col).cast("long"), F.lit(0)) if size_col else word_count(F.col(text_col)),
    })
    sizes = kept(rows.groupBy(F.col(k).alias("skey"), F.col(z).alias("size")).agg(F.count(F.lit(1)).alias("n")))
    n_rows = sizes.agg(F.sum("n")).head()[0] or 0
    weight = F.col("size") * F.col("n")
    totals = sizes.groupBy("skey").agg(
        F.sum(weight).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("n")).otherwise(0)).alias("n_full")
    ).withColumns({
        "mean_size": F.greatest(F.col("source_size") / F.greatest(F.col("n_full"), F.lit(1)), F.lit(1.0)), "bend": F.lit(float(bend)),
    })
    solved = solve_dual(sizes, source_targets(totals, weights, cap), cap, tolerance, rounds)
    small = solved.count() <= SMALL_SOURCES
    full = F.col("target") >= cap * F.col("source_size") * (1 - tolerance)
    dual = solved.select(
        F.col("skey").alias(k), "source_size", "target", F.col("m").alias(run), F.col("mean_size").alias(base),
        (full & (F.col("source_size") > 0)).alias(whole),
    )
    slices = max(1, -(-n_rows // rows_per_bucket))
    rows = rows.join(F.broadcast(dual) if small else dual, k)
    pull = F.pow(F.col(z) / F.col(base), F.lit(float(bend)))
    rate = F.when(F.col(z) == 0, 1.0).when(F.col(whole), cap).otherwise(tilted(F.col(run), pull, cap))
    rows = rows.withColumns({
        "rate": rate, h: seeded_order(F.col(id_col), seed), cls: F.floor(4 * F.log2(F.col(z) + F.lit(1.0))),
        long_row: F.col(z) > F.col(base),
    }).drop(run, base, whole).withColumn(part, F.col(cls) * slices + F.floor(F.col(h) / F.lit(2.0**60 / slices)))

    def rounded(some: DataFrame) -> DataFrame:
        some = some.withColumn(fixed, F.round(F.col("rate") * UNIT).cast("long"))
        steps = some.groupBy(k, long_row, part).agg(F.sum(fixed).alias(fixed))
        offsets = before_bucket(steps, [k, long_row], part, fixed, base, whole).drop(whole)
        inside = Window.partitionBy(k, long_row, part).orderBy(z, h, id_col).rowsBetween(Window.unboundedPreceding, 0)
        some = some.join(offsets, [k, long_row, part]).withColumn(run, F.col(base) + F.sum(fixed).over(inside) + UNIT // 2)
        return some.withColumn("copies", F.expr(f"`{run}` div {UNIT} - (`{run}` - `{fixed}`) div {UNIT}"))

    thin = rows.select(k, id_col, z, h, part, long_row, "rate")
    longs = rounded(thin.where(F.col(long_row))).groupBy(k).agg(F.sum(F.col("copies") * F.col(z)).alias(run))
    shorts = thin.where(~F.col(long_row)).groupBy(k).agg(F.sum(F.col("rate") * F.col(z)).alias(fixed))
    left = solved.select(F.col("skey").alias(k), F.col("target").alias(base)).join(longs, k, "left").join(shorts, k, "left")
    fill = F.greatest(F.col(base) - F.coalesce(F.col(run), F.lit(0)), F.lit(0.0)) / F.greatest(F.col(fixed), F.lit(1.0))
    left = kept(left.select(k, fill.alias(fixed)))
    rows = rows.join(F.broadcast(left) if small else left, k)
    refilled = F.least(F.lit(cap), F.col("rate") * F.col(fixed))
    rows = rounded(rows.withColumn("rate", F.when(F.col(long_row) | (F.col(z) == 0), F.col("rate")).otherwise(refilled)).drop(fixed))
    return rows.select(
        *[c for c in plain.columns if c != size_col], F.col(z).alias("size"), "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col(z)).alias("taken"),
    )
