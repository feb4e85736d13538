"""Mixing sources to target weights by entropy balancing.

Of all rates per document that meet each source's token target, the mix takes those with
the least relative entropy to taking every document once, with no rate above ``MOST``.
Their form is ``min(MOST, exp(lambda * size))`` with one multiplier per source; the
multipliers solve the convex dual by safeguarded Newton steps, each one aggregation over
the histogram of (source, size). The sums are of fixed-point numbers, so they don't depend
on the order of rows and reruns agree bit by bit.

Rates then become copies. Documents of one source and size share a rate, so along the sizes
of a source, from the largest down, a size takes the rounded running sum of wanted copies
less that of the sizes before it. What this leaves over in words is settled at ``STOPS``
sizes of each source, the smallest ones among them. The copies of a size go to its documents
in hash order, numbered within cells of at most about ``ROWS_A_CELL`` rows.

Only DataFrame functions run, and no array grows with the rows or sizes of a source.

Defined results: a null text has size 0 and takes nothing, as does an empty one; null is a
source of its own, last in order; a source whose documents are all empty has target 0; ids
may be of any type that sorts, may be null and may repeat, each row being a document; of
documents of one source and size, those of lower text hash, then id, take a copy more; a
text of any length is read whole; an empty table gives an empty table. If the multipliers
don't settle in ``STEPS`` steps, that is an error. Other columns, whatever their names, are
ignored by ``balance`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import clear_of, cut, named, stored, unpacked

WEIGHTS = (1, 2, 3)
MOST = 3
STEPS, CLOSE = 100, 1e-7
STOPS = 128
ROWS_A_CELL = 20_000
BROADCAST_ROWS = 100_000  # of a source or a hot size: some 10 MB
WORD = r"[^\x20\x09-\x0D]+"
_FIX = 1_000_000
_NONE = "n"  # the null source; others have a "v" before their name


def _sum(x: Column | str) -> Column:
    return F.sum((F.col(x) if isinstance(x, str) else x).cast("decimal(38,0)")).cast("double")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def weighted(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds ``weight`` to rows with a ``key``: weights repeat in code point order, null last.

    The place of a source is its place in its range of names after the sources of the ranges before it, so no task
    holds all sources.
    """
    order = [F.col("key") == _NONE, F.encode("key", "utf-8")]
    ranged = cut(sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("at", 33)
    sizes = sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for r in sizes:
        starts += [F.lit(r.part), F.lit(before)]
        before += r.n
    if not starts:
        return ranged.drop("at").withColumn("weight", F.lit(0.0))
    place = F.element_at(F.create_map(*starts), part) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double")).drop("at")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (key, total): shares by weight, capped at ``most`` times the total, the excess reshared by weight.

    A source gets min(level * weight, most * total). The sum of these rises with the level and bends downwards, so
    Newton's steps from below reach the level that gives out everything, after finitely many.
    """
    told = cut(weighted(sources, weights))
    cap = most * F.col("total")
    whole = told.agg(_sum("total")).first()[0] or 0.0
    level, last = 0.0, -1.0
    while level > last:
        full = F.lit(level) * F.col("weight") >= cap
        got = told.agg(_sum(F.when(full, cap).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight")).cast("decimal(38,0)")).cast("double").alias("open")).first()
        last = level
        if got.open:
            level = max(level, (whole - (got.full or 0.0)) / got.open)
    return told.withColumn("target", F.least(F.lit(level) * F.col("weight"), cap.cast("double")))


def _fixed(x: Column) -> Column:
    return F.sum(F.round(x * _FIX).cast("decimal(38,0)")).cast("double") / _FIX


def multipliers(hist: DataFrame, wanted: DataFrame, most: int = MOST) -> DataFrame:
    """(key, target, unit, lam) that solve the dual over ``hist`` (key, size, n); lam belongs to size / unit."""
    n, size = F.col("n"), F.col("size")
    unit = hist.groupBy("key").agg((_sum(n * size * size) / F.greatest(_sum(n * size), F.lit(1.0))).alias("unit"))
    start = F.log(F.greatest("target", F.lit(1e-9)) / F.greatest(F.col("total"), F.lit(1)))
    state = cut(wanted.join(unit, "key").select("key", "total", "target", F.greatest("unit", F.lit(1.0)).alias("unit"), start.alias("lam"), F.lit(-2000.0).alias("low"), F.lit(2000.0).alias("high"), F.lit(False).alias("done")))
    rows = state.count()
    for _ in range(STEPS):
        x = size / F.col("unit")
        raw = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        free = raw < most
        open_ = state.where("not done")
        got = hist.join(_small(open_, rows), "key").groupBy("key").agg(
            _fixed(n * size * F.when(free, raw).otherwise(float(most))).alias("got"), _fixed(n * size * x * F.when(free, raw).otherwise(0.0)).alias("slope")
        )
        both = state.join(_small(got, rows), "key", "left")
        gap = F.col("got") - F.col("target")
        met = F.col("done") | (F.abs(gap) <= CLOSE * F.greatest(F.col("target"), F.lit(1.0))) | (F.col("target") >= most * F.col("total") * (1 - 1e-9)) | (F.col("high") - F.col("low") < 1e-9)
        low, high = F.when(gap < 0, F.col("lam")).otherwise(F.col("low")), F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.greatest(F.col("slope"), F.lit(1e-12))
        step = F.when((newton > low) & (newton < high), newton).otherwise((low + high) / 2)
        state = cut(both.select("key", "total", "target", "unit", F.when(met, F.col("lam")).otherwise(step).alias("lam"), F.when(met, F.col("low")).otherwise(low).alias("low"), F.when(met, F.col("high")).otherwise(high).alias("high"), met.alias("done")))
        if not state.where("not done").take(1):
            break
    else:
        raise RuntimeError(f"multipliers of {state.where('not done').count()} sources didn't settle in {STEPS} steps")
    return state.select("key", "target", "unit", F.when(F.col("target") >= most * F.col("total") * (1 - 1e-9), F.lit(1e9)).otherwise(F.col("lam")).alias("lam"))


def rounded(rates: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``take``, whole copies in all, to (key, size, n, rate).

    Running sums of wanted copies are rounded along falling sizes; the words that this leaves over are settled at the
    last size of each of ``STOPS`` stretches, where the carry of the stretches before is added.
    """
    down = W.partitionBy("key").orderBy(F.desc("size"))
    upto = down.rowsBetween(W.unboundedPreceding, 0)
    whole = F.round(F.sum(F.col("n") * F.col("rate")).over(upto)).cast("long")
    nth = rates.withColumns({"upto": whole, "place": F.row_number().over(down)})
    # the smallest half of the stops are sizes of their own, the other sizes are stretches of equal length
    sizes = nth.withColumns({"take": F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)), "of": F.count("*").over(W.partitionBy("key"))})
    alone = STOPS // 2
    long_ = F.greatest(F.col("of") - alone, F.lit(0))
    stop = F.when(F.col("place") > long_, F.lit(alone) + F.col("place") - long_).otherwise(F.floor((F.col("place") - 1) * alone / F.greatest(long_, F.lit(1)))).cast("int")
    # a running sum can round to more than most * n only where rates are at the cap
    sizes = sizes.withColumns({"stop": stop, "take": F.greatest(F.lit(0).cast("long"), F.least("take", F.col("n") * most))})
    over = F.col("size") * (F.col("n") * F.col("rate") - F.col("take"))
    last = F.min_by(F.struct("size", "n", "take"), "size")
    stretch = sizes.groupBy("key", "stop").agg(_fixed(over).alias("over"), last.alias("last"))

    def settle(done: Column, x: Column) -> Column:
        carry, end = done["carry"] + x["over"], x["last"]
        more = F.greatest(-end["take"], F.least(end["n"] * most - end["take"], F.round(carry / end["size"]).cast("long")))
        return F.struct((carry - more * end["size"]).alias("carry"), F.array_append(done["out"], F.struct(end["size"].alias("size"), more.alias("more"))).alias("out"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<struct<size:bigint,more:bigint>>").alias("out"))
    stops = stretch.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("stop", "over", "last"))).alias("all"))  # at most STOPS entries
    settled = stops.select("key", F.inline(F.aggregate("all", start, settle, lambda x: x["out"])))
    return sizes.join(settled, ["key", "size"], "left").select("key", "size", "n", "rate", (F.col("take") + F.coalesce("more", F.lit(0))).alias("take"))


def _rated(docs: DataFrame, whole: bool, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """(key, id, source, size, copies, rate, row) of each row, the row only if ``whole``, and (key, total, target)."""
    clear_of(docs, id_col, text_col, source_col)
    text, source = named(text_col), named(source_col).cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("v"), source), F.lit(_NONE))
    rows = docs.select(key.alias("key"), named(id_col).alias("id"), source.alias("source"), size.alias("size"), F.xxhash64(text, F.lit(5)).alias("tie"), *([F.struct(*map(named, docs.columns)).alias("row")] if whole else []))
    base = stored(rows)
    hist = cut(base.groupBy("key", "size").agg(F.count("*").alias("n")))
    wanted = cut(targets(hist.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("total")), weights, most))
    hist = hist.where("size > 0")
    solved = multipliers(hist, wanted, most)
    rate = F.least(F.lit(float(most)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("unit"), F.lit(50.0))))
    chosen = cut(rounded(hist.join(_small(solved, wanted.count()), "key").select("key", "size", "n", rate.alias("rate")), most))
    # a size of more rows than a cell holds is dealt to cells; there are fewer such sizes than rows / ROWS_A_CELL
    hot = cut(chosen.where(F.col("n") > ROWS_A_CELL).select("key", "size", F.ceil(F.col("n") / ROWS_A_CELL).cast("int").alias("cells")))
    full = base.where("size > 0").join(_small(hot, hot.count()), ["key", "size"], "left")
    cell = F.when(F.col("cells").isNull(), 0).otherwise(F.pmod(F.xxhash64("tie", "id", F.lit(11)), F.col("cells"))).cast("int")
    full = full.withColumn("cell", cell).drop("cells")
    # where each cell's copies beyond whole rounds begin and end, by running counts over the cells of a size
    count = full.where("cell > 0").groupBy("key", "size", "cell").agg(F.count("*").alias("m"))
    run = W.partitionBy("key", "size").orderBy("cell").rowsBetween(W.unboundedPreceding, 0)
    first = chosen.join(count.groupBy("key", "size").agg(F.sum("m").alias("rest")), ["key", "size"], "left").select("key", "size", F.lit(0).alias("cell"), (F.col("n") - F.coalesce("rest", F.lit(0))).alias("m"))
    upto = first.unionByName(count).withColumn("upto", F.sum("m").over(run))
    over = F.col("take") % F.col("n")
    share = lambda upto: F.floor(over * upto / F.col("n"))
    placed = upto.join(chosen, ["key", "size"]).select("key", "size", "cell", "rate", F.floor(F.col("take") / F.col("n")).alias("each"), (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("more"))
    ranked = full.withColumn("nth", F.row_number().over(W.partitionBy("key", "size", "cell").orderBy("tie", "id")))
    keep = ["key", "id", "source", "size", *(["row"] if whole else [])]
    taken = ranked.join(placed, ["key", "size", "cell"]).select(*keep, (F.col("each") + F.when(F.col("nth") <= F.col("more"), 1).otherwise(0)).cast("long").alias("copies"), "rate")
    none = base.where("size = 0").select(*keep, F.lit(0).cast("long").alias("copies"), F.lit(0.0).alias("rate"))
    return taken.unionByName(none), wanted.select("key", "total", "target")


def balance(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Per document: id, source, size, source_size, target (of its source), taken (copies * size), copies and rate."""
    rated, wanted = _rated(docs, False, id_col, text_col, source_col, weights, most)
    return rated.join(_small(wanted, wanted.count()), "key").select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", F.col("total").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """All columns of ``docs``, each row as many times as the mix takes it (empty texts: not at all)."""
    rated, _ = _rated(docs, True, id_col, text_col, source_col, weights, most)
    many = rated.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return unpacked(many, docs)
