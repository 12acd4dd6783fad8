"""Mixing sources to target weights by entropy balancing.

Each source has a token target.  Document rates minimise the relative entropy
to taking every document once, subject to the source's token constraint and an
upper bound of ``cap`` copies.  The convex dual has one unknown per source,
``rate = min(cap, exp(lambda * size / mean size))``, solved by Newton steps on
aggregates over a (source, size) histogram.  Rates then become whole copies:
the whole part of every rate, plus one more copy for the documents that come
first in a seeded order until the source's remaining tokens are used up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from winsight.llm.words import packed, space_words, unpacked
from winsight.session import materialise

WEIGHTS = (5, 2, 1)
#: Sources up to this many (a row of about 100 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
#: Bins of the rounding order: a source has so many rows at most in the running sum, and one bin is sorted.
ORDER_BINS = 4_096


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: float = 3.0, total: float | None = None) -> DataFrame:
    """``source, n_docs, source_size, weight, target`` from ``source, size`` rows.

    Sources in code point order (null last) take the weights in turn.  The
    budget (all sizes unless given) is shared by weight; a source above ``cap``
    times its size is cut there and the excess shared again.
    """
    found = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))  # one row per source
    turn = F.array(*[F.lit(float(w)) for w in weights])
    found = materialise(found.withColumn("weight", F.element_at(turn, F.pmod(place - 1, F.lit(len(weights))) + 1)), "mix-sources")
    limit = F.lit(cap) * F.col("source_size")
    if total is None:
        total = float(found.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # every pass cuts at least one more source, or ends
        cut = limit < F.lit(level) * F.col("weight")
        held, left = found.agg(F.coalesce(F.sum(F.when(cut, limit)), F.lit(0.0)), F.coalesce(F.sum(F.when(~cut, F.col("weight"))), F.lit(0.0))).first()
        higher = (total - held) / left if left else level
        if higher <= level:
            break
        level = higher
    return found.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")).cast("double"))


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def balance(sizes: DataFrame, targets: DataFrame, cap: float = 3.0, steps: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``source`` -> ``lam, mean, full``: the dual solution of each source (``full``: every rate is ``cap``)."""
    hist = materialise(sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    state = targets.select("source", "target", (F.col("source_size") / F.col("n_docs")).alias("mean"),
                           (F.col("target") >= F.col("source_size") * cap * (1 - 1e-9)).alias("full"), F.lit(0.0).alias("lam"),
                           F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                           F.lit(False).alias("done"))
    state = materialise(state.withColumn("done", F.col("full") | (F.col("target") <= 0)), "mix-dual")
    n = state.count()
    lam, target = F.col("lam"), F.col("target")
    for _ in range(steps):
        if state.where(~F.col("done")).limit(1).count() == 0:
            break
        h, s = hist.alias("h"), _few(state, n).alias("s")
        x = F.col("h.size") / F.col("mean")
        tilt = F.exp(F.least(lam * x, F.lit(50.0)))
        tokens = F.col("h.n") * F.col("h.size")
        sums = (h.join(s, F.col("h.source").eqNullSafe(F.col("s.source"))).where(~F.col("done"))
                .groupBy(F.col("s.source").alias("at")).agg(
                    F.sum(tokens * F.least(F.lit(cap), tilt)).alias("g"),
                    F.sum(F.when(tilt < cap, tokens * x * tilt).otherwise(0.0)).alias("slope")))
        now = state.join(_few(sums, n), state["source"].eqNullSafe(sums["at"]), "left").drop("at")
        gap = F.col("g") - target
        lo, hi = F.when(gap < 0, lam).otherwise(F.col("lo")), F.when(gap >= 0, lam).otherwise(F.col("hi"))
        now = now.withColumn("new_lo", lo).withColumn("new_hi", hi)
        reach = 1 + F.abs(lam)
        newton = lam - F.greatest(-reach, F.least(reach, gap / F.col("slope")))
        inside = (F.col("slope") > 0) & (newton > F.coalesce("new_lo", F.lit(-1e300))) & (newton < F.coalesce("new_hi", F.lit(1e300)))
        middle = (F.col("new_lo") + F.col("new_hi")) / 2
        step = F.when(inside, newton).when(middle.isNotNull(), middle).when(gap < 0, lam + reach).otherwise(lam - reach)
        hit = F.col("done") | F.col("g").isNull() | (F.abs(gap) <= tolerance * target)
        state = materialise(now.select(
            "source", "target", "mean", "full", F.when(hit, lam).otherwise(step).alias("lam"),
            F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"), hit.alias("done")), "mix-dual")
    return state.select("source", "lam", "mean", "full")


def _round(rows: DataFrame, targets: DataFrame, n: int, seed: int) -> DataFrame:
    """``rows`` (``row, id, source, size, rate``) plus whole ``copies``."""
    share = F.col("rate") - F.floor("rate")
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id"), F.col("row")), F.lit(1 << 52)) / float(1 << 52)
    first = draw / share  # order sampling: a document comes early in proportion to its share
    rows = rows.select("*", F.floor("rate").alias("base"), F.when((share > 1e-12) & (F.col("size") > 0), first).alias("turn"))
    rows = rows.withColumn("bin", F.floor(F.lit(ORDER_BINS) * F.col("turn") / (1 + F.col("turn"))))
    rows = materialise(rows, "mix-rates")
    sums = rows.groupBy("source").agg(F.sum(F.col("base") * F.col("size")).alias("taken"))
    t = targets.select(F.col("source").alias("at"), "target")
    need = sums.join(_few(t, n), sums["source"].eqNullSafe(F.col("at"))).select("source", (F.col("target") - F.col("taken")).alias("need"))
    need = materialise(need, "mix-need")
    bins = rows.where(F.col("turn").isNotNull()).groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    upto = F.sum("in_bin").over(Window.partitionBy("source").orderBy("bin"))
    bins = bins.select(F.col("source").alias("at"), "bin", upto.alias("upto"), "in_bin")
    edge = (bins.join(_few(need, n), bins["at"].eqNullSafe(need["source"]))
            .where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("in_bin") < F.col("need")))
            .select(F.col("at"), F.col("bin").alias("edge"), (F.col("need") - F.col("upto") + F.col("in_bin")).alias("rest")))
    wanted = materialise(_few(need, n).join(edge, need["source"].eqNullSafe(edge["at"]), "left").select(
        F.col("source").alias("at"), F.when(F.col("need") <= 0, F.lit(-1)).otherwise(F.col("edge")).alias("edge"), "rest"), "mix-edge")
    rows = rows.join(_few(wanted, n), rows["source"].eqNullSafe(wanted["at"])).drop("at")
    # only the one bin where the tokens run out is put in order
    mine = Window.partitionBy("source", "bin").orderBy("turn", "id", "row")
    at_edge = rows.where(F.col("bin") == F.col("edge")).select("row", (F.sum("size").over(mine) - F.col("size") / 2 < F.col("rest")).alias("in"))
    rows = rows.join(at_edge.withColumnRenamed("row", "at"), F.col("row") == F.col("at"), "left").drop("at")
    more = F.when(F.col("turn").isNull(), False).when(F.col("edge").isNull() | (F.col("bin") < F.col("edge")), True).otherwise(F.coalesce("in", F.lit(False)))
    return rows.select("row", "id", "source", "size", "key", "rate", (F.col("base") + more.cast("long")).alias("copies"))


def _settle(rows: DataFrame, targets: DataFrame, n: int, cap: int, rounds: int) -> DataFrame:
    """What whole documents leave over: per round and source one copy more or less
    of the largest document that fits into the rest."""
    rows = materialise(rows, "mix-copies")
    t = targets.select(F.col("source").alias("at"), "target")
    fixes = None
    for _ in range(rounds):
        now = rows if fixes is None else rows.join(fixes, rows["row"] == fixes["fix"], "left").select(
            *[rows[c] for c in rows.columns if c != "copies"], (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))
        taken = now.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
        rest = taken.join(_few(t, n), taken["source"].eqNullSafe(F.col("at"))).select(F.col("source").alias("at"), (F.col("target") - F.col("taken")).alias("rest"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("rest")) & F.when(F.col("rest") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        picked = (now.join(_few(rest, n), now["source"].eqNullSafe(F.col("at"))).where(fits)
                  .groupBy("source").agg(F.max(F.struct("size", "row", F.signum("rest").cast("long").alias("by"))).alias("m"))
                  .select(F.col("m.row").alias("fix"), F.col("m.by").alias("by")))
        fixes_new = picked if fixes is None else fixes.unionByName(picked).groupBy("fix").agg(F.sum("by").alias("by"))
        before = 0 if fixes is None else fixes.agg(F.sum(F.abs("by"))).first()[0] or 0
        fixes = materialise(fixes_new, "mix-fixes")
        if (fixes.agg(F.sum(F.abs("by"))).first()[0] or 0) == before:
            break
    if fixes is None:
        return rows
    return rows.join(fixes, rows["row"] == fixes["fix"], "left").select(
        *[rows[c] for c in rows.columns if c != "copies"], (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))


def plan_mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = 3, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", seed: int = 7, rounds: int = 4) -> DataFrame:
    """One row per document: ``id, key, source, size, source_size, target, rate, copies, taken``.

    ``key`` is a hash of the text.  Defined results: a null text has size 0
    and takes no words (its rate stays 1); null is a source of its own, last in
    order; an empty table gives an empty plan; repeated rows are documents of
    their own; a source without words has target 0.  Reruns agree: the only
    randomness is a seeded hash of the id.
    """
    size = F.size(space_words(F.col(text_col).cast("string"))).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                       F.xxhash64(F.col(text_col).cast("string")).alias("key"), size.alias("size"))
    # place among equal rows, so that repeated rows are told apart the same way on every run
    same = Window.partitionBy("id", "key", "source").orderBy("size")
    rows = materialise(rows.select("*", F.row_number().over(same).alias("nth")), "mix-sizes")
    rows = rows.withColumn("row", F.xxhash64("id", "key", "source", "nth")).drop("nth")
    targets = materialise(source_targets(rows, weights, float(cap)), "mix-targets")
    n = targets.count()
    dual = balance(rows, targets, float(cap))
    dual = dual.withColumnRenamed("source", "at")
    rate = F.when(F.col("full"), F.lit(float(cap))).when(F.col("size") == 0, 1.0).otherwise(
        F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("mean"), F.lit(50.0)))))
    rated = rows.join(_few(dual, n), rows["source"].eqNullSafe(F.col("at"))).select(*rows.columns, rate.alias("rate"))
    chosen = _settle(_round(rated, targets, n, seed), targets, n, cap, rounds)
    t = targets.select(F.col("source").alias("at"), "source_size", "target")
    return (chosen.join(_few(t, n), chosen["source"].eqNullSafe(F.col("at")))
            .select("id", "key", "source", "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: every document as often as the plan takes it, plus ``copy`` (1, 2, ...).

    Rows that share id, text and source share the copies planned for them.
    """
    plan = plan_mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    plan = plan.groupBy(F.col("id").alias("_id"), F.col("key").alias("_key"), F.col("source").alias("_source")).agg(
        F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    rest = [c for c in docs.columns if c != "copy"]
    held = packed(docs, _i=docs[id_col], _s=docs[source_col], _k=F.xxhash64(docs[text_col].cast("string")))
    out = held.join(plan, F.col("_i").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_k") == F.col("_key")))
    # repeated rows share their copies as evenly as they divide
    share = F.when(F.col("_rows") == 1, F.col("_copies")).otherwise(
        F.floor(F.col("_copies") / F.col("_rows")) + (F.row_number().over(
            Window.partitionBy("_id", "_key", "_source").orderBy("_key")) <= F.col("_copies") % F.col("_rows")).cast("long"))
    out = out.withColumn("_copies", share).where("_copies > 0")
    return out.select(*unpacked(rest), F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))
