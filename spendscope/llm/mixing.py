"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Rates minimise the relative entropy to the corpus under token constraints: the
documents of each group of a dimension (a source, or a language) shall bring a
given number of words. Dimensions may overlap; sources alone are one of them. The
convex dual is sum_d size_d * exp(sum_k x_k(d)) - sum_g target_g * x_g, d running
over documents and g over groups; its minimum gives every document the exponentially tilted
rate exp(sum of the x of its groups).

Each round sums gradient and Hessian up by group. Documents alike in all
dimensions have one rate, so they are added up once, into cells, and rounds
run over cells. Within a dimension groups are disjoint, so its block of the
Hessian is diagonal and equals the words that the groups bring at present; with the other
dimensions held, those grow with exp(x), so a round takes a dimension's Newton steps one after the
other from one sum, and dimensions take turns. A step is held to 1, as the exponential
makes Newton overshoot from below.

A rate r becomes floor(r) or floor(r) + 1 copies. A document's hash gives it a
fixed place; those below the source's border get the extra copy. The border is
found from two histograms of 4096 bins over all documents (the second inside
the bin that the first names) and an exact order of the places in the one
remaining bin, so no source is ever sorted or gathered whole. Some WINDOW
documents around the border then fill what is left of the target, the largest
that still fits first, so a source misses its target by a few words.

A long document at the border can leave the window far from the target. A source
that misses its target by more than the share MISS goes on behind its window:
places whose words fit in what is left are kept, a new border is found among
them in the same way, and so on until the miss is within MISS or no place
behind fits. Rounds have no limit; each begins behind the one before.

Targets: weights 1, 2, 3, repeating, over the sources in code-point order (null
last) share all words; a target stops at `most` times its source's size, and the
excess is shared by weight among the others, in closed form: sources ordered by
size / weight, the capped ones being those at the front. Ranks and running sums over
sources are local to ranges of them, with the sums of the ranges before added on.

Defined cases: a null or empty text has size 0 and the copies of its place; null
is a source of its own; rows that repeat a doc_id get equal copies; a null
doc_id has a place of its own; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendscope.llm.common import stored

_BINS = 4096
WINDOW = 24
#: Into how many parts the documents of a source are dealt to meet its row, so that no source goes to one task.
SALTS = 64
#: The share of its target by which a source may miss it while documents that fit are left behind its window.
MISS = 0.01
_PLACES = 1 << 48
#: Rounds of the dual at most, Newton steps in a round, and the relative miss from which one more round is exact to the last digits.
MOST_ROUNDS, _NEWTON, _SOLVED = 200, 60, 1e-8
_CLOSE = 1e-9


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def place_of(doc_id: Column) -> Column:
    """48 hash bits of the id as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("long")


def _running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Rows with running sums (inclusive) in an order, without one task that sees them all.

    Rows are dealt into ranges; sums run inside each, and those of the ranges before
    are added, of which there are as many as shuffle partitions.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()).withColumns({f"own {k}": v for k, v in sums.items()})
    dealt = stored(dealt, "ranges")
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = dealt.groupBy("range").agg(*(F.sum(f"own {k}").alias(f"all {k}") for k in sums))
    whole = whole.select("range", *(F.coalesce(F.sum(f"all {k}").over(before), F.lit(0)).alias(f"before {k}") for k in sums))
    both = dealt.withColumns({f"inside {k}": F.sum(f"own {k}").over(inside) for k in sums}).join(whole, "range")
    return both.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"inside {k}") + F.col(f"before {k}")).alias(k) for k in sums))


def weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, ...) one row each -> with `weight` by code-point order, null last."""
    ranked = _running(sources, [F.col("source").isNull(), F.col("source")], {"rank": F.lit(1).cast("long")})
    n = (F.col("rank") - 1) % len(cycle)
    return ranked.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in cycle)), (n + 1).cast("int")).cast("double")).drop("rank")


def targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """(source, source_size, weight) -> with `target`: weighted shares of all words, none above `most` times its size."""
    order = [F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    ranked = stored(_running(sources, order, {"size upto": F.col("source_size"), "weight upto": F.col("weight")}), "ranked")
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    if whole.weight is None:
        return sources.withColumn("target", F.lit(0.0))
    before, rest = F.col("size upto") - F.col("source_size"), F.lit(whole.weight) - (F.col("weight upto") - F.col("weight"))
    level = (F.lit(whole.words) - F.lit(most) * before) / rest
    ranked = ranked.withColumn("level", level).withColumn("capped", F.col("weight") * level > F.lit(most) * F.col("source_size"))
    # the first source that is not capped has the level; those after it, computed as if it were capped, have less
    share = ranked.filter(~F.col("capped")).agg(F.max("level")).first()[0]
    target = F.least(F.lit(most) * F.col("source_size"), F.col("weight") * F.lit(float("inf") if share is None else share))
    return ranked.select(*(F.col(f"`{c}`") for c in sources.columns), target.alias("target"))


def tilts(cells: DataFrame, constraints: dict[str, DataFrame], size_col: str = "size") -> tuple[DataFrame, float]:
    """Cells (a column per dimension, size) -> with `tilt`, by Newton's iterations on the dual; and the greatest relative miss left.

    `constraints` has a frame (dimension, target) for each dimension. Groups without words keep
    tilt 0, as do those without a target. Constraints that contradict one another end at
    MOST_ROUNDS, or earlier where the miss no longer falls.
    """
    rows = cells.filter(F.col(size_col) > 0)
    duals = {d: stored(t.filter("target > 0").select(d, "target", F.lit(0.0).alias("x"), F.lit(0.0).alias("miss")), "dual") for d, t in constraints.items()}

    def tilted(df: DataFrame) -> DataFrame:
        for d, dual in duals.items():
            df = df.join(dual.select(d, F.col("x").alias(f"x {d}")), d, "left")
        return df.withColumn("tilt", sum((F.coalesce(F.col(f"x {d}"), F.lit(0.0)) for d in duals), F.lit(0.0))).drop(*(f"x {d}" for d in duals))

    before = float("inf")
    for _ in range(MOST_ROUNDS):
        worst = 0.0
        for d in duals:
            now = tilted(rows).groupBy(d).agg(F.sum(F.col(size_col) * F.exp("tilt")).alias("words"))
            both = duals[d].drop("miss").join(now, d, "left")
            hessian = lambda move: F.col("words") * F.exp(move)
            step = lambda move: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (hessian(move) - F.col("target")) / hessian(move)))
            move = F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), F.lit(0.0), lambda m, _: m - step(m))
            miss = F.coalesce(F.abs(F.col("words") - F.col("target")) / F.col("target"), F.lit(0.0))
            duals[d] = stored(both.select(d, "target", F.when(F.col("words") > 0, F.col("x") + move).otherwise(F.col("x")).alias("x"), miss.alias("miss")), "dual")
            worst = max(worst, duals[d].agg(F.max("miss")).first()[0] or 0.0)
        if worst <= _SOLVED or (worst > 0.999 * before and len(duals) > 1):
            break
        before = worst
    return tilted(cells), worst if worst > _SOLVED else 0.0


def _meet(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with the columns of their source; both are dealt by source and part."""
    parts = sources.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("part", _part(F.col("place"))).join(parts, ["sid", "part"]).drop("part")


def _part(place: Column) -> Column:
    return place.bitwiseAND(SALTS - 1).cast("int")


def _border(hist: DataFrame, keys: list[str], bin_col: str) -> DataFrame:
    """Of each group's ordered bins that in which the summed words reach `need`; `need` becomes what is left inside it."""
    upto = F.sum("words").over(Window.partitionBy(*keys).orderBy(bin_col))
    hit = hist.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    hit = hit.filter((F.col("upto") >= F.col("need")) & (F.col("before") < F.col("need")))
    return hit.withColumn("need", F.col("need") - F.col("before")).drop("upto", "before")


def _thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, border): the place at which the words of all places up to it reach `need`. At most 4096 bins, or the places of one bin, are ordered at once."""
    first, second = F.shiftright("place", 36), F.shiftright("place", 24).bitwiseAND(_BINS - 1)
    words = F.sum("size").alias("words")
    rows = rows.filter("size > 0")
    one = rows.groupBy("sid", first.alias("one")).agg(words).join(sources.select("sid", "need"), "sid")
    one = _border(one, ["sid"], "one").drop("words")
    two = _meet(rows, one).filter(first == F.col("one")).groupBy("sid", "one", "need", second.alias("two")).agg(words)
    two = _border(two, ["sid"], "two").drop("words")
    last = _meet(rows, two).filter((first == F.col("one")) & (second == F.col("two"))).groupBy("sid", "need", "place").agg(words)
    last = _border(last, ["sid"], "place")
    return last.select("sid", F.col("place").alias("border"))


def _fill(rows: DataFrame, border: DataFrame) -> DataFrame:
    """(sid, need, low, high) -> (sid, low, high, chosen, left): all places below `low` and the chosen ones from there below `high` leave `left` of `need`."""
    near = _meet(rows, border).filter("place < high")
    below = near.groupBy("sid").agg(F.sum(F.when(F.col("place") < F.col("low"), F.col("size")).otherwise(0)).alias("before"))
    inside = near.filter("place >= low").groupBy("sid", "place").agg(F.sum("size").alias("words"))
    inside = inside.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct((-F.col("words")).alias("less"), "place"))).alias("window"))
    start = F.struct((F.col("need") - F.col("before")).alias("left"), F.array().cast("array<bigint>").alias("chosen"))
    fill = F.aggregate(
        F.coalesce("window", F.array().cast("array<struct<less:bigint,place:bigint>>")), start,
        lambda a, x: F.when(-x["less"] <= a["left"], F.struct((a["left"] + x["less"]).alias("left"), F.concat(a["chosen"], F.array(x["place"])).alias("chosen"))).otherwise(a))
    both = border.join(below, "sid").join(inside, "sid", "left").withColumn("fill", fill)
    return both.select("sid", "low", "high", F.col("fill.chosen").alias("chosen"), F.col("fill.left").alias("left"))


def _filled(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(sid, low, high, chosen, left): places below `low` get one copy more, and of those from there below `high` the chosen ones.

    The window around the border holds WINDOW places on average, whatever the source's size, as places are hashes.
    """
    rows = rows.filter("size > 0")
    border = _thresholds(rows, sources).join(sources.select("sid", "need", "n_docs"), "sid")
    reach = F.expr(f"{WINDOW // 2 * _PLACES} div n_docs")
    border = border.select("sid", "need", (F.col("border") - reach).alias("low"), (F.col("border") + reach + 1).alias("high"))
    return _fill(rows, border)


def _behind(rows: DataFrame, filled: DataFrame) -> DataFrame | None:
    """(sid, place) of the places behind the windows that get one copy more; None where there are none.

    `filled` has (sid, high, left, allowed); a round's table of fitting places is what the next one reads.
    """
    more, places = [], rows.filter("size > 0")
    state = stored(filled.filter("left > allowed").select("sid", "left", "high", "allowed"), "open")
    while not state.isEmpty():
        fits = _meet(places, state).filter("place >= high").groupBy("sid", "place", "left").agg(F.sum("size").alias("size")).filter("size <= left")
        places = stored(fits.select("sid", "place", "size"), "fits")
        n = places.groupBy("sid").agg(F.count("*").alias("n"))
        border = state.join(n, "sid").join(_thresholds(places, state.withColumn("need", F.col("left"))), "sid", "left")
        reach = F.expr(f"({_PLACES} - high) * {WINDOW // 2} div n")
        # where all that fit do not reach what is left, all are taken
        low = F.coalesce(F.greatest(F.col("border") - reach, F.col("high")), F.lit(_PLACES))
        border = stored(border.select("sid", F.col("left").alias("need"), low.alias("low"), F.coalesce(F.col("border") + reach + 1, F.lit(_PLACES)).alias("high")), "border")
        if border.isEmpty():
            break
        done = stored(_fill(places, border), "round")
        taken = (F.col("place") < F.col("low")) | F.array_contains("chosen", F.col("place"))
        more.append(stored(_meet(places, done.drop("left")).filter(taken).select("sid", "place"), "more"))
        state = stored(done.select("sid", "left", "high").join(state.select("sid", "allowed"), "sid").filter("left > allowed"), "open")
    return reduce(DataFrame.unionByName, more) if more else None


def _sid(source: Column) -> Column:
    return F.xxhash64(F.coalesce(source, F.lit("")), source.isNull())


def plan(
    docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame | None]:
    """(sid, source, source_size, weight, target, tilt, rate, base, low, high, chosen), one row per source; places behind the windows, if any."""
    source = F.col(f"`{source_col}`").cast("string")
    rows = stored(docs.select(
        source.alias("source"), _sid(source).alias("sid"), size_of(F.col(f"`{text_col}`")).alias("size"), place_of(F.col(f"`{id_col}`")).alias("place")), "sizes")
    sources = rows.groupBy("source", "sid").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = stored(targets(weights(sources, cycle), most), "targets")
    sources, _ = tilts(sources, {"sid": sources.select("sid", "target")}, "source_size")
    sources = sources.withColumn("rate", F.exp("tilt"))
    # rounding errors of the exponential must not turn 3 copies into 2
    sources = sources.withColumn("base", F.floor(F.col("rate") + _CLOSE)).withColumn("need", F.col("target") - F.col("base") * F.col("source_size"))
    sources = stored(sources, "sources")
    filled = _filled(rows, sources.filter(F.col("need") > _CLOSE * (F.col("target") + 1)))
    mix = stored(sources.join(filled, "sid", "left").drop("need"), "mix")
    return mix.drop("left"), _behind(rows, mix.withColumn("allowed", F.lit(MISS) * F.col("target")))


def copies_of(place: Column, prefix: str = "", behind: Column | None = None) -> Column:
    """Copies of a document from its place, the columns of its source's plan and whether it is among the places behind the window."""
    low, high, chosen, base = (F.col(prefix + c) for c in ("low", "high", "chosen", "base"))
    more = (place < low) | ((place < high) & F.array_contains(chosen, place))
    more = more if behind is None else F.coalesce(more, F.lit(False)) | behind
    return (base + F.when(more, 1).otherwise(0)).cast("long")


def mixed(
    docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, taken), one row per document row."""
    sources, more = plan(docs, cycle, most, id_col, text_col, source_col)
    doc_id = F.col(f"`{id_col}`")
    rows = docs.select(
        doc_id.alias("doc_id"), _sid(F.col(f"`{source_col}`").cast("string")).alias("sid"), size_of(F.col(f"`{text_col}`")).alias("size"), place_of(doc_id).alias("place"))
    both, behind = _meet(rows, sources), None
    if more is not None:
        both, behind = both.join(more.withColumn("behind", F.lit(True)), ["sid", "place"], "left"), F.col("behind").isNotNull()
    both = both.withColumn("copies", copies_of(F.col("place"), behind=behind))
    return both.select("doc_id", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def _free_prefix(columns: list[str]) -> str:
    """A beginning that no column has, whatever its case."""
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def repeated(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The mix itself: every document as often as its copies say, with all its columns."""
    own = _free_prefix(docs.columns)
    sources, more = plan(docs, cycle, most)
    sources = sources.select(*(F.col(c).alias(f"{own}{c}") for c in ("sid", "base", "low", "high", "chosen")))
    parts = sources.withColumn(f"{own}part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (_sid(docs["source"].cast("string")) == F.col(f"{own}sid")) & (_part(place_of(docs["doc_id"])) == F.col(f"{own}part"))
    both, behind = docs.join(parts, same), None
    if more is not None:
        more = more.select(F.col("sid").alias(f"{own}more"), F.col("place").alias(f"{own}place"))
        both = both.join(more, (F.col(f"{own}sid") == F.col(f"{own}more")) & (place_of(docs["doc_id"]) == F.col(f"{own}place")), "left")
        behind = F.col(f"{own}more").isNotNull()
    both = both.withColumn(f"{own}copies", copies_of(place_of(docs["doc_id"]), own, behind).cast("int")).filter(F.col(f"{own}copies") > 0)
    return both.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col(f"{own}copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
