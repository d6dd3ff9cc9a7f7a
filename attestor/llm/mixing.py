"""Mixing sources to target weights, in DataFrame functions only.

1. Each source's documents form one stream of words, cut into blocks of a fixed number of words; a source gets as many slots as its
   target has blocks.
2. The mix is a sequence of output shards of SHARD_SLOTS slots. Every slot draws its source with the sources' target shares as probabilities, so
   the counts of the sources in a shard are multinomial; a prefix sum of the counts over shards numbers a source's slots.
3. Draws miss the targets by the square root of the slots. What a source drew beyond its slots, spread evenly over its draws, goes to the
   sources that drew too few, so totals are met exactly and a shard's counts stay multinomial but for that share.
4. The j-th slot of a source takes the block to which a permutation of that source's block indices maps j, turn after turn, so no block is
   taken twice before all have been taken once, and none more often than targets allow; slots and documents meet in a join by block index.

Permutations are swap-or-not networks: bijections of [0, n) for any n, computed per index (an interpreted fold, not generated code), so neither a
sort nor a driver-side table is needed. A document's place in its stream is a prefix sum in two steps (cells of a source, then documents of
a cell; the number of cells follows the number of documents), so a hot source is dealt over many tasks. Sources are a list of at most
MAX_SOURCES, checked: what is broadcast is a row per source and GUIDE further ones.

Targets: sources in code-point order, null last, weigh 5, 2, 1 in turn and share all words; a target stops at ``limit``
times the source's words and the excess is shared among the others by weight, until none is above.

Defined cases: null text has no words; documents without words are taken zero times; a null source is a source of its own; repeated
rows are separate documents; ties of id and size are told apart by their text where texts are mixed, else they are interchangeable; a text of any
length is cut into blocks; an empty table gives an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from attestor import scratch
from attestor.llm.tables import WORD

WEIGHTS = (5, 2, 1)
LIMIT = 3
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
DOCS_PER_CELL = 8192
MAX_SOURCES = 65_536
GUIDE = 4096
#: Shards of a group whose counts are summed up before those of the next.
GROUP = 1024
ROUNDS = 24
OWN = ("size", "source_size", "target", "taken", "pieces", "first_shard")
PLACE = ("turn", "shard", "slot")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def permute(index: Column, n: Column, key: Column) -> Column:
    """A pseudorandom bijection of [0, n), one for each key: rounds that swap x with (k - x) mod n, or not, by a hash bit."""

    def step(x: Column, i: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, i), n) - x, n)
        return F.when(F.xxhash64(key, i, F.greatest(x, other)) % 2 == 0, x).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), step)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Sources (source, source_size) with their rank from 0 and target."""
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = ranked.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size").cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # a source is at its limit if the level at which it would reach it takes less than the total from all
    upto = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    above = F.sum("weight").over(everything) - F.sum("weight").over(upto)
    full = F.sum("cap").over(upto) + F.col("ratio") * above < F.col("total")
    rows = rows.withColumn("full", full)
    capped = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    free = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    level = (F.col("total") - capped) / F.nullif(free, F.lit(0.0))
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), F.coalesce(F.col("weight") * level, F.lit(0.0))))
    return rows.withColumn("target", target).select("source", "source_size", F.col("rank").cast("int").alias("rank"), "target")


def celled(sized: DataFrame, *, key: str = "doc_id", docs_per_cell: int = DOCS_PER_CELL) -> DataFrame:
    """A written table of documents (key, size, ...) with ``__cell``, the part of its source's stream that a document belongs to."""
    cells = sized.count() // docs_per_cell + 1
    return sized.withColumn("__cell", F.pmod(F.xxhash64(F.lit(11), F.col(f"`{key}`"), F.col("size")), F.lit(cells)))


def plan(rows: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """Of rows (source, __cell, size): the sources' targets, blocks and slots, and where each cell begins in its source's stream."""
    cells = scratch.cut(rows.groupBy("source", "__cell").agg(F.sum("size").alias("__words")), "mix-cells")
    sizes = scratch.cut(cells.groupBy("source").agg(F.sum("__words").cast("long").alias("source_size")), "mix-sizes")
    if (found := sizes.count()) > MAX_SOURCES:
        raise ValueError(f"{found} sources, more than {MAX_SOURCES}")
    goal = targets(sizes, weights=weights, limit=limit).withColumn("blocks", F.ceil(F.col("source_size") / block_words))
    # blocks of a source hold source_size / blocks words each on average; the last may be short
    goal = goal.withColumn("slots", F.when(F.col("blocks") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long"), limit * F.col("blocks"))).otherwise(0))
    goal = goal.withColumn("first_slot", F.sum("slots").over(Window.orderBy("rank")) - F.col("slots")).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))
    goal = scratch.cut(goal, "mix-targets")
    begin = F.coalesce(F.sum("__words").over(Window.partitionBy("source").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = cells.withColumn("__begin", begin).join(goal, cells.source.eqNullSafe(goal.source)).select(goal.source, "rank", "source_size", "target", "__cell", "__begin")
    starts = scratch.cut(starts, "mix-starts")
    scratch.drop(cells, sizes)
    return goal, starts


def drawn(goal: DataFrame, *, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """The draw: per shard and source (shard, rank) the slots that drew the source. ``goal``: a row per source, written.

    A slot's draw is a number below the number of all slots, whose source is looked up by the cell of a guide that it falls into.
    """
    spark, total = goal.sparkSession, goal.agg(F.max("all_slots")).first()[0] or 0
    shards, width = -(-total // shard_slots), max(1, -(-total // GUIDE))
    last = F.expr("first_slot + slots - 1")
    guide = goal.where("slots > 0").select("rank", "first_slot", last.alias("last_slot"), F.explode(F.sequence(F.expr(f"first_slot div {width}"), F.expr(f"(first_slot + slots - 1) div {width}"))).alias("guide"))
    # a shard's slots come from one row in one task, so what follows needs no further exchange
    rows = spark.range(shards).withColumnRenamed("id", "shard").repartition(max(1, min(20_000, -(-shards // 16))), "shard")
    rows = rows.select("shard", F.explode(F.sequence(F.lit(0), F.least(F.lit(shard_slots), total - F.col("shard") * shard_slots).cast("int") - 1)).alias("slot"))
    rows = rows.withColumn("v", F.pmod(F.xxhash64(F.lit(2 * seed), "shard", "slot"), F.lit(max(1, total)))).withColumn("guide", F.expr(f"v div {width}"))
    rows = rows.join(F.broadcast(guide), "guide").where(F.col("v").between(F.col("first_slot"), F.col("last_slot")))
    return rows.groupBy("shard", "rank").agg(F.sort_array(F.collect_list("slot")).alias("held"))


def slots(goal: DataFrame, *, shard_slots: int = SHARD_SLOTS, seed: int = 1) -> DataFrame:
    """All slots: shard, slot in it, the source's rank, the turn and the block taken."""
    draws = scratch.cut(drawn(goal, shard_slots=shard_slots, seed=seed).withColumn("group", F.expr(f"shard div {GROUP}")), "mix-draws")
    groups = scratch.cut(draws.groupBy("rank", "group").agg(F.sum(F.size("held")).alias("n")), "mix-groups")
    upto = Window.partitionBy("rank").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups_from = groups.select("rank", "group", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("begin"))
    # a row per source: drawn slots, how many of them are too many (or too few), and the number of the first of those among all
    level = goal.join(groups.groupBy("rank").agg(F.sum("n").alias("n")), "rank", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("over", F.col("n") - F.col("slots"))
    first = lambda x: F.sum(x).over(Window.orderBy("rank")) - x
    level = level.withColumn("from_over", first(F.greatest("over", F.lit(0)))).withColumn("from_under", first(F.greatest(-F.col("over"), F.lit(0))))
    level = scratch.cut(level.select("rank", "blocks", "n", "over", "from_over", "from_under"), "mix-level")
    under = level.where("over < 0").withColumn("i", F.explode(F.sequence(F.lit(0), -F.col("over") - 1)))
    under = scratch.cut(under.select((F.col("from_under") + F.col("i")).alias("e"), "rank", "blocks", (F.col("n") + F.col("i")).alias("j")), "mix-under")  # of the order of the root of all slots
    within = F.coalesce(F.sum(F.size("held")).over(Window.partitionBy("rank", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = draws.withColumn("within", within).join(groups_from, ["rank", "group"]).select("shard", "rank", (F.col("begin") + F.col("within")).alias("begin"), "held")
    numbered = scratch.cut(numbered, "mix-numbered")
    rows = numbered.join(F.broadcast(level), "rank").select("*", F.posexplode("held").alias("pos", "slot")).withColumn("j", F.col("begin") + F.col("pos"))
    before = F.when(F.col("over") > 0, F.expr("j * over div n")).otherwise(F.lit(0))
    rows = rows.withColumn("before", before).withColumn("extra", (F.col("over") > 0) & (F.expr("(j + 1) * over div n") > F.col("before")))
    own = rows.where(~F.col("extra")).select("shard", "slot", "rank", "blocks", (F.col("j") - F.col("before")).alias("j"))
    given = rows.where("extra").select("shard", "slot", (F.col("from_over") + F.col("before")).alias("e")).join(under, "e").select("shard", "slot", "rank", "blocks", "j")
    block = permute(F.col("j") % F.col("blocks"), F.col("blocks"), F.xxhash64(F.lit(2 * seed + 1), F.col("rank")))
    return own.unionByName(given).select("shard", "slot", "rank", F.expr("j div blocks").alias("turn"), block.alias("block"))


def stream(docs: DataFrame, starts: DataFrame, *, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Placed documents with their source's rank, size and target and their own ``__start`` in the source's stream."""
    order = [F.xxhash64(F.lit(12), F.col(f"`{key}`")), F.col(f"`{key}`"), "size", *(F.col(f"`{c}`") for c in ties)]
    within = F.coalesce(F.sum("size").over(Window.partitionBy("source", "__cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows, at = docs.withColumn("__within", within).alias("d"), starts.alias("s")
    joined = rows.join(at, F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.__cell") == F.col("s.__cell")))
    kept = [c for c in docs.columns if c != "__cell"]
    return joined.select(*(F.col(f"d.`{c}`") for c in kept), "s.rank", "s.source_size", "s.target", (F.col("s.__begin") + F.col("d.__within")).alias("__start"))


def blocks_of(rows: DataFrame, block_words: int) -> DataFrame:
    """A row per document of a stream and block that it reaches into; ``words`` of it lie there, after ``skip`` of its own."""
    start, end = F.col("__start"), F.col("__start") + F.col("size")
    reach = F.sequence(F.expr(f"__start div {block_words}"), F.expr(f"(__start + size - 1) div {block_words}"))
    rows = rows.where("size > 0").withColumn("block", F.explode(reach))
    low = F.greatest(start, F.col("block") * block_words)
    return rows.withColumn("skip", low - start).withColumn("words", F.least(end, (F.col("block") + 1) * block_words) - low)


def mix(docs: DataFrame, *, key: str = "doc_id", block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """Documents (key, source, size or text) with OWN: pieces counts the slots that hold words of the document, first_shard is the least shard with one."""
    size = n_words(F.col("text")) if "text" in docs.columns else F.col("size")
    sized = scratch.cut(docs.select(F.col(f"`{key}`"), "source", size.cast("long").alias("size")), "mix-sized")
    rows = celled(sized, key=key)
    goal, starts = plan(rows, weights=weights, limit=limit, block_words=block_words)
    at = scratch.cut(stream(rows, starts, key=key), "mix-stream")
    takes = slots(goal, shard_slots=shard_slots, seed=seed).groupBy("rank", "block").agg(F.count("*").alias("count"), F.min("shard").alias("shard"))
    # written, as an estimate of its size from the few rows of goal would be far too low
    parts = blocks_of(at.select("rank", "__start", "size"), block_words).join(scratch.cut(takes, "mix-takes"), ["rank", "block"])
    taken = parts.groupBy("rank", "__start").agg(F.sum(F.col("words") * F.col("count")).alias("taken"), F.sum("count").alias("pieces"), F.min("shard").alias("first_shard"))
    # only documents with words have a start of their own
    none = [F.lit(None).cast("long").alias(c) for c in ("taken", "pieces", "first_shard")]
    full = at.where("size > 0").join(taken, ["rank", "__start"], "left").unionByName(at.where("size = 0").select("*", *none))
    return full.select(key, "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("pieces", F.lit(0)).cast("long").alias("pieces"), "first_shard")


def realize(docs: DataFrame, *, text: str = "text", per_slot: bool = False, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, limit: int = LIMIT, weights: tuple[int, ...] = WEIGHTS, seed: int = 1) -> DataFrame:
    """The mix itself: a row per document and turn in which words of it are taken, with those words and the white space before each as its text.

    turn, shard and slot are added, of a row's slots the first; with per_slot there is a row for every slot that holds words of a document, and
    reading shards in the order of slots gives the mix. n_chars, if there, follows the text. Blocks are found by a document's place in its source's
    stream; the texts are joined to what is taken of them once, by a number that is written with them.
    """
    names = [c for c in docs.columns if c.lower() not in (*OWN, *PLACE)]
    whole = F.col(f"`{text}`").cast("string")
    numbered = docs.select(*(F.col(f"`{c}`") for c in names), n_words(whole).alias("size"), F.xxhash64(whole).alias("__digest"), F.monotonically_increasing_id().alias("__id"))
    numbered = scratch.cut(numbered, "mix-docs")
    rows = celled(numbered.select("__id", "doc_id", "__digest", "source", "size"))
    goal, starts = plan(rows, weights=weights, limit=limit, block_words=block_words)
    # the number decides among rows of equal id and text only, so the mix doesn't depend on how the table is partitioned
    at = scratch.cut(stream(rows, starts, ties=("__digest", "__id")).select("__id", "rank", "__start", "size"), "mix-stream")
    takes = scratch.cut(slots(goal, shard_slots=shard_slots, seed=seed), "mix-takes")
    parts = blocks_of(at, block_words).join(takes, ["rank", "block"])
    by = ["__id", "turn", *(("shard", "slot") if per_slot else ())]
    spans = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("skip", "words"))).alias("__spans"), F.min(F.struct("shard", "slot")).alias("__place"))
    spans = spans.select("__id", F.col("turn").alias("__turn"), "__spans", "__place")
    joined = numbered.select("__id", *(F.col(f"`{c}`") for c in names)).join(spans, "__id")
    # words are split after the join, as a text is smaller than the array of its words, and bound to a name, as each span would split them again
    words = F.regexp_extract_all(whole, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    taken = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice(w, s["skip"].cast("int") + 1, s["words"].cast("int")))), ""))
    out = joined.withColumn(text, F.get(taken, F.lit(0)))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length(F.col(f"`{text}`")).cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in names), F.col("__turn").alias("turn"), "__place.shard", "__place.slot")
