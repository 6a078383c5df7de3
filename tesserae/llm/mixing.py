"""Temperature mixing of sources to target weights, by DataFrame operations only.

A source's natural share s becomes the weight s**t / sum(s**t).  The exponent t is bisected until the flattest mix
is found whose most repeated source stays within a repetition limit, or whose entropy is at most a target.  The
weights are realised over permutations of blocks: a source's documents are hashed into blocks, the blocks of each
epoch are permuted by a hash, and a source takes whole epochs and then blocks of one more until its budget ends
inside a block, where documents are taken in the order of their hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .packing import token_count

#: Documents of a block; points of one bisection job and its jobs (the exponent is found to 2**-20).
BLOCK_DOCS, POINTS, JOBS = 1024, 16, 5
#: Stretches of a source's order of blocks among which the end of its budget is found first.
STRETCHES = 4096


def _digest(*parts) -> Column:
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def _number(digest: Column, at: int, digits: int) -> Column:
    """A long from some hexadecimal digits."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def _unit(*parts) -> Column:
    """A number in [0, 1) from a hash."""
    return _number(_digest(*parts), 1, 10) / float(1 << 40)


def exponent(sources: DataFrame, budget_share: float, repetition: float | None, entropy: float | None) -> float:
    """The least exponent in [0, 1] under which both limits hold; 1 where none does.

    ``sources`` has share (positive).  Weights are s**t / Z; a source repeats budget_share * s**(t-1) / Z times;
    entropy is in nats.
    """
    low, high = 0.0, 1.0
    for _ in range(JOBS):
        step = (high - low) / POINTS
        grid = F.array(*[F.lit(low + step * i) for i in range(POINTS + 1)])
        each = sources.select("share", F.explode(grid).alias("t"))
        power = F.pow("share", "t")
        sums = each.groupBy("t").agg(F.sum(power).alias("z"), F.sum(power * F.log("share")).alias("w"), F.max(F.pow("share", F.col("t") - 1)).alias("most"))
        holds = F.lit(True)
        if repetition is not None:
            holds &= F.col("most") * budget_share / F.col("z") <= repetition * (1 + 1e-12)
        if entropy is not None:
            holds &= F.log("z") - F.col("t") * F.col("w") / F.col("z") <= entropy + 1e-12
        found = sums.where(holds).agg(F.min("t")).first()[0]
        if found is None:
            return 1.0
        if found <= low:
            return low
        low, high = max(low, found - step), found
    return high


def _end(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group of ``cells`` (keys, at, tokens, room), ordered by ``at``, the cell in which ``room`` ends, with what is left of it there."""
    upto = F.sum("tokens").over(Window.partitionBy(*keys).orderBy("at"))
    return cells.withColumn("upto", upto).where("upto > room and upto - tokens <= room").select(*keys, "at", (F.col("room") - F.col("upto") + F.col("tokens")).alias("room"))


def mixed_epochs(docs: DataFrame, budget: int | None = None, repetition: float | None = 2.0, entropy: float | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with columns _epoch, _block, _position, _tokens.

    ``docs`` has doc_id, text and source.  ``budget`` is in tokens (default: all there are); ``repetition`` is the
    most epochs of a source; ``entropy`` (nats) is the most the weights may have.  Ordering by _position
    interleaves the sources.  No source takes more tokens than its budget and each comes within one document of it.
    Cases: null sources are one source; a null text has one token (its end); texts of any length count whole;
    repeated rows are taken or left together, and so are rows whose hashes tie; null doc_ids are rows like others;
    other columns come through unchanged whatever their names, except that columns named like the four that are
    added give way to them (not in ``mix``); no rows give no rows.
    """
    taken = _taken(docs, budget, repetition, entropy, block_docs)
    added = ["_epoch", "_block", "_position", "_tokens"]
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in added], *[F.col(c[1:]).alias(c) for c in added])


def _taken(docs: DataFrame, budget: int | None, repetition: float | None, entropy: float | None, block_docs: int) -> DataFrame:
    """``row`` (all of a row of ``docs``, as a struct, so that no name of its columns meets one from here), epoch, block, position, tokens."""
    scratch = Scratch(docs.sparkSession)
    whole_row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    name, text = F.col("row.source"), F.col("row.text")
    rows = whole_row.withColumns({"src": F.coalesce(F.concat(F.lit("="), name), F.lit("null")), "tokens": token_count(text)}).withColumn("print", _digest("row.doc_id", "src", text))
    slim = scratch.save(rows.select("src", "tokens", "print"), "slim")
    per = scratch.save(slim.groupBy("src").agg(F.sum("tokens").alias("n"), F.count("*").alias("docs")), "sources")
    total = per.agg(F.sum("n")).first()[0]
    if not total:
        return rows.limit(0).select("row", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("block"), F.lit(0.0).alias("position"), "tokens")
    budget = int(total) if budget is None else int(budget)
    t = exponent(per.select((F.col("n") / total).alias("share")), budget / total, repetition, entropy)
    z = per.agg(F.sum(F.pow(F.col("n") / total, F.lit(t)))).first()[0]
    goal = F.least(F.floor(F.pow(F.col("n") / total, F.lit(t)) / z * budget).cast("long"), F.floor(F.col("n") * (repetition if repetition is not None else 1e18)).cast("long"))
    plan = per.withColumn("goal", goal).select("src", "n", "goal", F.floor(F.col("goal") / F.col("n")).cast("int").alias("whole"), F.pmod("goal", "n").alias("rest"), F.ceil(F.col("docs") / block_docs).alias("blocks"))
    plan = scratch.save(plan, "plan")

    block = F.pmod(_number(F.col("print"), 1, 15), F.col("blocks"))
    place = F.struct(_unit(F.col("src"), F.col("block"), F.col("whole")).alias("place"), F.col("block"))
    inside = _number(F.col("print"), 16, 15)
    dealt = slim.join(plan.where("rest > 0"), "src").withColumn("block", block).withColumns({"at": place, "inside": inside})
    # blocks in the order of the last epoch; the one in which the budget ends is found among STRETCHES of that
    # order first, so that no task orders all blocks of a source
    blocks = scratch.save(dealt.groupBy("src", "at", "rest").agg(F.sum("tokens").alias("tokens")), "blocks")
    stretch = F.floor(F.col("at.place") * STRETCHES)
    stretches = blocks.groupBy("src", F.col("rest").alias("room"), stretch.alias("at")).agg(F.sum("tokens").alias("tokens"))
    near = _end(stretches, ["src"]).select(F.col("src"), F.col("at").alias("s"), "room")
    ends = scratch.save(_end(blocks.withColumn("s", stretch).join(near, ["src", "s"]).select("src", "at", "tokens", "room"), ["src"]), "ends")
    here = dealt.join(ends, ["src", "at"]).groupBy("src", "room", "inside").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("src").orderBy("inside"))
    last = here.withColumn("upto", upto).where("upto <= room").groupBy("src").agg(F.max("inside").alias("end_inside"))
    plan = scratch.save(plan.join(ends.select("src", F.col("at").alias("end")), "src", "left").join(last, "src", "left"), "cuts")

    out = rows.join(plan, "src").withColumn("block", block).withColumn("at", place)
    before = (F.col("at") < F.col("end")) | (F.col("at") == F.col("end")) & (inside <= F.col("end_inside"))
    times = F.col("whole") + F.coalesce(before & (F.col("rest") > 0), F.lit(False)).cast("int")
    out = out.withColumn("times", times).where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    position = (F.col("epoch") + _unit(F.col("src"), F.col("block"), F.col("epoch"))) / (F.col("goal") / F.col("n"))
    return out.select("row", "epoch", "block", position.alias("position"), "tokens")


def mix(docs: DataFrame, budget: int | None = None, repetition: float | None = 2.0, entropy: float | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``mixed_epochs`` in the columns of ``docs``, all of them unchanged."""
    return _taken(docs, budget, repetition, entropy, block_docs).select(*[F.col("row")[c].alias(c) for c in docs.columns])
