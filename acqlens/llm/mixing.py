"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

1. Sizes: words of every text. Targets: the sources share the size of the whole by
   weight; a target stops at ``cap`` times its source, and the excess is shared anew by
   weight among the others until none is above.
2. Every source is dealt into shards of about SHARD_WORDS words by a seeded hash of
   the document id (copies of one row in chunks, so that they make many shards too).
   Inside a shard documents lie end to end in seeded order, cut into blocks of
   BLOCK_WORDS; what is left at the end belongs to the last block.
3. Apportionment: a shard's claim is its part of its source's target, in its blocks.
   Seats (one block taken once) go to the highest quotients claim / (2 k + 1), so each
   shard has an integer quota. Seats that no other outcome could change are given at
   once: by the bounds of the divisor, a claim's seats differ from it by at most half the
   number of shards times its share. Only the quotients in between are ranked, about
   three a shard: they are counted in BINS steps, and those of one step are sorted.
4. Selection: a quota of q over b blocks takes all blocks q div b times and q mod b
   of them once more, by a seeded permutation of the block numbers. A document takes the
   words that it has in taken blocks.

Everything is DataFrame operations; only the texts' scan reads texts. The targets'
rounds and the bin counts send a few numbers to the driver.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; a null id is hashed as empty; rows with equal source, id and size count as one
document of so many copies, and each takes the same number of words (the part of
the copies, rounded down); sources without words have target 0; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acqlens.llm.storage import blank, settle
from acqlens.operators.ranking import SortKey, ranked

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 12
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 16
BINS = 4096
STRIDES = (1_000_000_007, 998_244_353, 1_000_000_009, 2_147_483_647)  # primes above any shard's number of blocks


def size_of(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text."""
    return F.size(F.array_remove(F.split(blank(text), r"[\x20\x09-\x0D]+"), "")).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target) from (source, size) rows."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(sources, [], [SortKey("source", nulls_first=False)], [], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1)
    placed = settle(placed.select("source", "source_size", weight.cast("bigint").alias("weight"),
                                  (F.col("source_size") * cap).alias("most")))
    whole = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first().n
    at, stopped = 0.0, None
    while True:  # a source that has stopped stays so, as the others' level only rises
        now = placed.select(F.when(F.lit(at) * F.col("weight") > F.col("most"), F.col("most")).alias("stop"), "weight").agg(
            F.count("stop").alias("n"), F.coalesce(F.sum("stop"), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(F.col("stop").isNull(), F.col("weight"))), F.lit(0)).alias("open")).first()
        if now.n == stopped or not now.open:
            break
        at, stopped = (whole - now.held) / now.open, now.n
    return placed.select("source", "source_size", F.when(F.lit(at) * F.col("weight") > F.col("most"), F.col("most").cast("double"))
                         .otherwise(F.lit(at) * F.col("weight")).alias("target"))


def quotas(shards: DataFrame) -> DataFrame:
    """``shards`` (with ``shard_key``, claim, most) and their ``seats``: the whole claims' sum, rounded down, by highest quotients."""
    shards = settle(shards)
    sums = shards.agg(F.coalesce(F.sum("claim"), F.lit(0.0)).alias("claims"), F.count(F.lit(1)).alias("n")).first()
    seats = int(sums.claims + 1e-6)
    # |seats - claim| <= claim's share of n / 2, and 1 for rounding, whatever the divisor turns out to be.
    reach = F.col("claim") * ((sums.n / 2 + 1) / max(sums.claims, 1e-300)) + 1
    sure = F.greatest(F.floor(F.col("claim") - reach), F.lit(0))
    bounds = shards.withColumn("sure", F.least(sure, F.col("most"))).withColumn(
        "open", F.least(F.ceil(F.col("claim") + reach), F.col("most")) - F.col("sure"))
    given = bounds.agg(F.coalesce(F.sum("sure"), F.lit(0)).alias("n")).first().n
    left = seats - given
    # The quotient's inverse, (2 k + 1) / (2 claim): the lowest ones get the seats that are left.
    offers = bounds.where("open > 0 and claim > 0").select(
        "shard_key", F.col("claim"), F.explode(F.expr("sequence(sure, sure + open - 1)")).alias("k")).select(
        "shard_key", ((2 * F.col("k") + 1) / (2 * F.col("claim"))).alias("inverse"))
    low, high = offers.agg(F.min("inverse"), F.max("inverse")).first()
    won = None
    if low is not None and left > 0:
        step = F.least(F.floor((F.col("inverse") - low) / (max(high - low, 1e-300) / BINS)), F.lit(BINS - 1))
        binned = offers.withColumn("bin", step)
        before = 0
        for row in binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).orderBy("bin").collect():  # at most BINS rows
            if before + row.n >= left:
                break
            before += row.n
        last = binned.where(F.col("bin") == row.bin).orderBy("inverse", "shard_key").limit(int(left - before))
        won = binned.where(F.col("bin") < row.bin).select("shard_key").union(last.select("shard_key")).groupBy("shard_key").agg(
            F.count(F.lit(1)).alias("won"))
    if won is None:
        return bounds.withColumn("seats", F.col("sure")).drop("sure", "open")
    return bounds.join(won, "shard_key", "left").withColumn("seats", F.col("sure") + F.coalesce("won", F.lit(0))).drop("sure", "open", "won")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: int = SEED,
        block: int = BLOCK_WORDS, shard: int = SHARD_WORDS) -> DataFrame:
    """(id, size, source_size, target, taken) for every row of ``docs``."""
    sized = settle(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size")))
    aims = settle(targets(sized, weights, cap))
    copied = sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")).where("size > 0")
    chunks = F.least(F.ceil(F.col("copies") * F.col("size") / shard), F.col("copies"))
    items = copied.withColumn("chunks", chunks).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn(
        "here", F.expr("copies div chunks + if(chunk < copies % chunks, 1, 0)"))
    same = F.col("source").eqNullSafe(F.col("of_source"))
    by_source = aims.select(F.col("source").alias("of_source"), "source_size", "target")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("chunk")).cast("binary"))
    hashed = items.join(by_source, same).withColumn("order", order).withColumn(
        "shard", F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint") % F.ceil(F.col("source_size") / shard))
    in_shard = Window.partitionBy("source", "shard").orderBy("order", "doc_id", "size", "chunk")
    laid = settle(hashed.withColumn("words", F.col("size") * F.col("here")).withColumn(
        "stop", F.sum("words").over(in_shard.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "shard_key", F.md5(F.concat_ws(":", F.hex(F.coalesce("source", F.lit(""))), F.col("source").isNull().cast("string"),
                                       F.col("shard").cast("string")).cast("binary"))))

    blocks = F.greatest(F.expr(f"shard_size div {block}"), F.lit(1))
    shards = laid.groupBy("shard_key").agg(F.sum("words").alias("shard_size"), F.first("source_size").alias("all"),
                                           F.first("target").alias("target")).withColumn("blocks", blocks).select(
        "shard_key", "shard_size", "blocks", (F.col("target") * F.col("blocks") / F.col("all")).alias("claim"),
        (F.col("blocks") * cap).alias("most"))
    given = quotas(shards).select("shard_key", "shard_size", "blocks", F.expr("seats div blocks").alias("rounds"),
                                  (F.col("seats") % F.col("blocks")).alias("more"))

    # A block i goes once more if its place in the permutation i * stride + shift (modulo the blocks) is below ``more``.
    key = F.conv(F.substring("shard_key", 1, 12), 16, 10).cast("bigint")
    stride = F.element_at(F.array(*(F.lit(s).cast("bigint") for s in STRIDES)), (key % len(STRIDES)).cast("int") + 1)
    placed = laid.join(given, "shard_key").withColumn("start", F.col("stop") - F.col("words")).withColumn(
        "stride", stride).withColumn("shift", key % F.col("blocks"))
    more = F.expr(f"""
        if(more = 0, 0L, aggregate(
          sequence(least(start div {block}, blocks - 1), least((stop - 1) div {block}, blocks - 1)), 0L,
          (sum, i) -> sum + if((i * (stride % blocks) + shift) % blocks < more,
            least(stop, if(i = blocks - 1, stop, (i + 1) * {block})) - greatest(start, i * {block}), 0L)))""")
    taken = placed.select("source", "doc_id", "size", "copies", (F.col("rounds") * F.col("words") + more).alias("taken"))
    found = taken.groupBy("source", "doc_id", "size").agg(F.sum("taken").alias("taken"), F.first("copies").alias("copies")).select(
        F.col("source").alias("of_source"), F.col("doc_id").alias("of_doc"), F.col("size").alias("of_size"), F.expr("taken div copies as taken"))
    out = sized.join(aims.select(F.col("source").alias("aim_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("aim_source")))
    return out.join(found, same & F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("size") == F.col("of_size")), "left").select(
        F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
