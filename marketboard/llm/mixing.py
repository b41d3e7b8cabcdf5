"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target in words. It is met by whole passes over the source and a part of a further pass. Documents lie
in blocks by a hash of their content, a pass takes blocks in a permuted order, and the last block of the part is cut
at the document, and the document at the word, at which the target is reached. So every source has an exact quota of
blocks. A tree halves the output shards again and again, and at each split draws how many blocks of every source go left:
the multivariate hypergeometric distribution, as if all blocks were shuffled together, without moving one. The leaves own
disjoint ranges of each source's permuted blocks. Within a shard documents are put in a random order.

Everything is DataFrame code. What is computed for sources and shards has as many rows as there are sources and shards.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketboard.llm.common import fresh, saved, uniform_hash

# ---- fixed values: weights by the order of the sources, and the most passes -------------------
WEIGHTS = (5, 2, 1)
MAX_PASSES = 3

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 1 << 16
#: The tree has so many levels that its leaves, the output shards, have at most so many words on average.
SHARD_WORDS = 1 << 22
SEED = 7
#: A draw is searched within so many standard deviations of its mean; what lies beyond has a chance under 1e-15.
DEVIATIONS = 9


def sized(documents: DataFrame, source: str = "source", text: str = "text", key: str | None = None) -> DataFrame:
    """source, size in words and a content hash (mark) of every document, and the key if one is named."""
    words = words_of(F.col(text))
    columns = [F.col(source).alias("source"), words.alias("size"), F.xxhash64(F.col(text), *([F.col(key)] if key else [])).alias("mark")]
    return documents.select(*([F.col(key).alias("key")] if key else []), *columns)


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MAX_PASSES) -> DataFrame:
    """number, source, source_size, target: one row for each source.

    The targets share the total by weight, but none is over most times its source; what exceeds that goes to the others by
    weight. With sources in order of the level at which they are full, the level of the others follows from running sums.
    """
    total = F.sum("source_size").over(Window.partitionBy())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.array(*[F.lit(float(w)) for w in weights])[(F.col("number") % len(weights)).cast("int")]
    sources = sources.withColumn("number", F.row_number().over(order) - 1).withColumn("weight", weight)
    full = F.lit(float(most)) * F.col("source_size")
    rising = Window.orderBy(full / F.col("weight"), "number")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.select(
        "number",
        "source",
        "source_size",
        "weight",
        full.alias("full"),
        (total - F.coalesce(F.sum(full).over(before), F.lit(0.0))).alias("left_words"),
        F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)).alias("left_weight"),
    )
    # The level is that of the first source that stays under its limit; sources before it are full.
    level = F.col("left_words") / F.col("left_weight")
    open_level = F.min(F.when(level * F.col("weight") < F.col("full"), F.struct(F.col("full") / F.col("weight"), "number", level.alias("level"))))
    sources = sources.withColumn("level", open_level.over(Window.partitionBy())["level"])
    target = F.when(F.col("level").isNull(), F.col("full")).otherwise(F.least("full", F.col("level") * F.col("weight")))
    return sources.select("number", "source", "source_size", target.alias("target"))


def _uniform(*columns: Column) -> Column:
    return uniform_hash(F.lit(SEED), *columns)


def hypergeometric(marked: Column, others: Column, draws: Column, chance: Column) -> Column:
    """How many of the draws, without replacement, are marked: inversion of the distribution at a number in [0, 1).

    Chances relative to the first value follow from one another; the sum of all of them gives the scale.
    """
    n = marked + others
    mean = draws * marked / F.greatest(n, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (others / F.greatest(n, F.lit(1))) * ((n - draws) / F.greatest(n - 1, F.lit(1))), F.lit(0.0)))
    reach = F.ceil(spread * DEVIATIONS) + 3
    low = F.greatest(F.lit(0), draws - others, F.floor(mean) - reach).cast("long")
    high = F.least(marked, draws, F.ceil(mean) + reach).cast("long")

    def step(k: Column) -> Column:
        """The chance of k over that of k - 1."""
        return (marked - k + 1) * (draws - k + 1).cast("double") / (k * (others - draws + k))

    ratios = F.when(high > low, F.sequence(low + 1, high)).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))
    total = F.aggregate(
        ratios,
        start,
        lambda a, k: F.struct((a["p"] * step(k)).alias("p"), (a["sum"] + a["p"] * step(k)).alias("sum")),
        lambda a: a["sum"],
    )
    begin = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"), F.lit(0).cast("long").alias("n"))
    passed = F.aggregate(
        ratios,
        begin,
        lambda a, k: F.struct(
            (a["p"] * step(k)).alias("p"),
            (a["sum"] + a["p"] * step(k)).alias("sum"),
            (a["n"] + F.when(a["sum"] <= chance * total, 1).otherwise(0)).cast("long").alias("n"),
        ),
        lambda a: a["n"],
    )
    return low + passed


def splitting_tree(quotas: DataFrame, levels: int) -> DataFrame:
    """number, shard, blocks: how many blocks of every source each shard gets.

    quotas: number, quota of blocks. Each level halves the nodes: the left one gets half of the node's blocks, and sources
    take their part of it one after another, each by a hypergeometric draw given what is left. A node is a row with the quotas
    of all sources, so a level is a projection. It is written, as its draws would else be computed again for both halves.
    """
    nodes = quotas.select(F.lit(0).alias("node"), F.col("quota").alias("n"), "number")
    packed = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("number", "n"))).alias("sources"))
    for level in range(levels):
        packed = saved(_split(packed, level).repartition("node"), "tree")
    rows = packed.select(F.col("node").alias("shard"), F.explode("sources").alias("s"))
    return rows.select("s.number", "shard", F.col("s.n").alias("blocks"))


def _split(packed: DataFrame, level: int) -> DataFrame:
    total = F.aggregate("sources", F.lit(0).cast("long"), lambda a, s: a + s["n"])
    packed = packed.withColumn("total", total)
    state = F.struct(
        F.col("total").alias("left"),
        F.floor((F.col("total") + F.col("node") % 2) / 2).cast("long").alias("draws"),
        F.array().cast("array<long>").alias("drawn"),
    )

    def draw(a: Column, s: Column) -> Column:
        chance = _uniform(F.lit(level), F.col("node"), s["number"])
        got = F.when(s["n"] > 0, hypergeometric(s["n"], a["left"] - s["n"], a["draws"], chance)).otherwise(F.lit(0).cast("long"))
        return F.struct(
            (a["left"] - s["n"]).alias("left"), (a["draws"] - got).alias("draws"), F.concat(a["drawn"], F.array(got)).alias("drawn")
        )

    packed = packed.withColumn("drawn", F.aggregate("sources", state, draw, lambda a: a["drawn"]))
    left = F.zip_with("sources", "drawn", lambda s, d: F.struct(s["number"].alias("number"), d.alias("n")))
    right = F.zip_with("sources", "drawn", lambda s, d: F.struct(s["number"].alias("number"), (s["n"] - d).alias("n")))
    halves = F.array(
        F.struct((F.col("node") * 2).alias("node"), left.alias("sources")),
        F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("sources")),
    )
    return packed.select(F.explode(halves).alias("half")).select("half.node", "half.sources")


def placed(sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The sized documents with their source's number and their block: by hash, about block_words in each."""
    blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.lit(1))
    known = sources.select("number", F.col("source").alias("named"), blocks.alias("blocks"))
    joined = sizes.join(known, F.col("source").eqNullSafe(F.col("named")))
    return joined.withColumn("block", F.floor(uniform_hash(F.lit(SEED), "mark") * F.col("blocks")).cast("long")).drop("named", "blocks")


def before_in_order(rows: DataFrame, value: Column, at: Column, bins: Column, lead: Column | None = None) -> DataFrame:
    """The rows with the sum (before) of the values of their source's rows that stand before them.

    Order: lead, then at (a number in [0, 1)), then block. Sums run over the bins of a source first and over the rows of a
    bin then, so no task gets all rows of a large source; bins: the root of their number, about.
    """
    rows = rows.select("*", value.cast("long").alias("_value"), at.alias("_at"), (F.lit(0) if lead is None else lead).alias("_lead"))
    rows = rows.withColumn("_bin", F.floor(F.col("_at") * bins).cast("long"))
    bin_order = Window.partitionBy("number").orderBy("_lead", "_bin")
    sums = rows.groupBy("number", "_lead", "_bin").agg(F.sum("_value").alias("_sum"))
    sums = sums.withColumn("_offset", F.sum("_sum").over(bin_order) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy("number", "_lead", "_bin").orderBy("_at", "block")
    rows = rows.withColumn("_inside", F.sum("_value").over(inside) - F.col("_value")).join(sums, ["number", "_lead", "_bin"])
    return rows.withColumn("before", F.col("_offset") + F.col("_inside")).drop("_value", "_at", "_lead", "_bin", "_offset", "_inside")


def block_plan(placed_documents: DataFrame, sources: DataFrame, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """number, block, shards (of every pass that takes the block), whole (passes over all of it), rest (words of the last
    pass if that takes only a part, else null): one row for each block of which something is taken."""
    sizes = placed_documents.groupBy("number", "block").agg(F.sum("size").alias("words")).filter("words > 0")
    known = sources.select(
        "number",
        F.floor(F.least(F.col("target") / F.greatest("source_size", F.lit(1)), F.lit(float(MAX_PASSES)))).cast("int").alias("passes"),
        F.col("source_size"),
        F.col("target"),
    )
    known = known.withColumn("more", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    blocks = saved(sizes, "blocks").join(known, "number")
    # The part of a pass: blocks in permuted order until the words are reached.
    bins = F.ceil(F.sqrt(F.col("source_size") / block_words)) + 1
    blocks = before_in_order(blocks, F.col("words"), _uniform(F.col("number"), F.lit(-1), F.col("block")), bins)
    blocks = blocks.withColumn("rest", F.greatest(F.least(F.col("more") - F.col("before"), F.col("words")), F.lit(0)))
    taken = F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0)
    blocks = saved(blocks.select("number", "block", "words", "passes", "rest", taken.alias("times"), bins.alias("bins")).filter("times > 0"), "taken")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    levels = max(1, ceil(log2(max(total, 1) / shard_words)))
    shards = splitting_tree(blocks.groupBy("number").agg(F.sum("times").cast("long").alias("quota")), levels)
    ends = Window.partitionBy("number").orderBy("shard")
    owned = shards.filter("blocks > 0").select("number", "shard", "blocks", (F.sum("blocks").over(ends) - F.col("blocks")).alias("first"))
    owned = owned.select("number", "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1)).alias("place"))
    # Every pass over a block has one place among all places of its source, in an order of its own for each pass.
    turns = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("turn"))
    mixed = _uniform(F.col("number"), F.col("turn"), F.col("block"))
    turns = before_in_order(turns, F.lit(1), mixed, F.col("bins"), F.col("turn")).withColumnRenamed("before", "place")
    turns = turns.join(owned, ["number", "place"])
    shards_of = F.transform(F.sort_array(F.collect_list(F.struct("turn", "shard"))), lambda x: x["shard"])
    plan = turns.groupBy("number", "block").agg(
        shards_of.alias("shards"), F.first("passes").alias("passes"), F.first("rest").alias("rest"), F.first("words").alias("words")
    )
    whole = F.col("passes") + F.when(F.col("rest") == F.col("words"), 1).otherwise(0)
    return plan.select(
        "number", "block", "shards", whole.alias("whole"), F.when((F.col("rest") > 0) & (F.col("rest") < F.col("words")), F.col("rest")).alias("rest")
    )


def cut_parts(placed_documents: DataFrame, plan: DataFrame) -> DataFrame:
    """number, mark, part: words of each document that the part of a cut block takes, in hash order to the word.

    Only one block of each source is cut. Documents of equal content share what falls to them evenly.
    """
    cut = placed_documents.join(plan.filter("rest is not null").select("number", "block", "rest"), ["number", "block"])
    alike = cut.groupBy("number", "mark", "size", "rest").agg(F.count("*").alias("n"))
    order = Window.partitionBy("number").orderBy(_uniform(F.lit(-2), F.col("mark")), "mark", "size")
    before = F.coalesce(F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.floor(F.greatest(F.least(F.col("rest") - before, F.col("size") * F.col("n")), F.lit(0)) / F.col("n"))
    return alike.select("number", "mark", "size", part.cast("long").alias("part"))


def mixture(
    documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", shard_words: int = SHARD_WORDS
) -> DataFrame:
    """What the mix takes of every document, one row for each row.

    size in words, source_size and target of its source, taken words (repeats counted) and the shards of its passes. Null
    texts and texts without words have size 0 and give nothing; null is a source of its own, the last. Repeated rows and
    repeated or null keys keep a row each. If no text has words, every target is 0. No documents: no rows. Other columns
    are not read.
    """
    sizes = saved(sized(documents, source, text, key), "sizes")
    sources = saved(targets(sizes), "sources")
    rows = saved(placed(sizes, sources), "placed")
    plan = saved(block_plan(rows, sources, shard_words), "plan")
    parts = cut_parts(rows, plan)
    out = rows.join(plan, ["number", "block"], "left").join(parts, ["number", "mark", "size"], "left")
    out = out.join(sources.select("number", "source_size", "target"), "number")
    taken = F.coalesce(F.col("whole") * F.col("size") + F.coalesce("part", F.lit(0)), F.lit(0))
    has = F.slice("shards", 1, F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0))
    return out.select(
        F.col("key").alias(key),
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.when(taken > 0, has).otherwise(F.array().cast("array<int>")).alias("shards"),
    )


def mixed_documents(documents: DataFrame, source: str = "source", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix itself: a row for each pass that takes a document, all columns as they were, shuffled within shards.

    The one document of each source at which its target is reached is cut after the word that reaches it. Texts
    without words are in no pass.
    """
    sizes = saved(sized(documents, source, text), "sizes")
    sources = saved(targets(sizes), "sources")
    rows = saved(placed(sizes, sources), "placed")
    plan = saved(block_plan(rows, sources, shard_words), "plan")
    parts = saved(cut_parts(rows, plan).filter("part > 0"), "parts")
    name = fresh(documents, "_mix")
    words = words_of(F.col(text))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(documents.columns)])
    whole = documents.select(row.alias("row"), F.col(source).alias("source"), F.xxhash64(text).alias("mark"), words.alias("size"))
    out = placed(whole.filter("size > 0"), sources).join(plan, ["number", "block"])
    out = out.join(parts, ["number", "mark", "size"], "left")
    turns = F.transform(
        F.slice("shards", 1, F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)),
        lambda shard, turn: F.struct(shard.alias("shard"), F.when(turn == F.col("whole"), F.col("part")).alias("part")),
    )
    out = out.withColumn(name, F.explode(turns)).select("row", "mark", F.col(f"{name}.shard").alias("shard"), F.col(f"{name}.part").alias("part"))
    out = out.repartition("shard").sortWithinPartitions("shard", _uniform(F.col("shard"), F.col("mark")))
    at = documents.columns.index(text)
    body = F.col(f"row.c{at}")
    pieces = F.regexp_extract_all(body, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("part") < words_of(body), F.array_join(F.slice(pieces, F.lit(1), F.col("part").cast("int")), "")).otherwise(body)
    return out.select(*[(cut if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(documents.columns)])


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
