"""Mixing sources to target weights.

The documents of each source are dealt by hash into blocks. A source's target in words is
met by whole passes over its blocks and, for the rest, blocks in a random order, each of
which is taken if it still fits; of the first that doesn't, some documents are taken for what
then remains. That fixes each
source's quota of blocks exactly. A splitting tree deals these quotas among output shards:
at every node the left half of the shards takes a multivariate hypergeometric share of each
source's blocks, drawn source by source. Each source's draws in random order are then cut
into disjoint runs for the shards, and a shard's documents are shuffled within the shard.

Everything is DataFrame functions and all randomness is hashes of a seed, so reruns agree.
Texts are read once, for their sizes. Tables of blocks and quotas have a bounded number of
rows for each source; windows run over those, and over the documents of one block of each
source. The join of documents with blocks has (source, block) as its key, which spreads a
hot source.

The number of sources is taken to be moderate (some hundred thousands at most): their targets
and the quotas of a node of the tree are one row or one task each.

Defined results: a null text has size 0; null is a source of its own, last in order; a
source without words has target 0; rows with equal ids share a block and each get a row; a
text of any length is one document and taken whole, so a source whose only document is larger
than its target is taken once or not at all, whichever is nearer; an empty table gives an
empty table; columns other than those named are not read by ``plan``, and ``mixed`` keeps
them and replaces ``shard`` and ``position``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.llm.common import let, staged

WEIGHTS = (5.0, 2.0, 1.0)
#: A document is taken at most so many times.
MOST_REPEATS = 3
BLOCKS = 512
#: Output shards, a power of two.
SHARDS = 16


def _ln_factorial(n: Column) -> Column:
    """ln n! for n >= 0, by Stirling's series at n + 8 (error below 1e-13)."""
    x = n.cast("double") + 8.0
    rising = F.lit(1.0)
    for k in range(1, 8):
        rising = rising * (n.cast("double") + float(k))
    return (x - 0.5) * F.ln(x) - x + 0.9189385332046727 + 1.0 / (12.0 * x) - 1.0 / (360.0 * x * x * x) + 1.0 / (1260.0 * F.pow(x, F.lit(5.0))) - F.ln(rising)


def _uniform(*of: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.pmod(F.xxhash64(*of), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` blocks out of ``total`` are among the ``marked`` ones: the quantile of ``u``."""
    low = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    high = F.least(marked, drawn)
    log_weight = lambda k: -(_ln_factorial(k) + _ln_factorial(marked - k) + _ln_factorial(drawn - k) + _ln_factorial(total - marked - drawn + k))

    def pick(logs: Column) -> Column:
        def at(weights: Column) -> Column:
            goal = u * F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
            walked = F.aggregate(
                weights,
                F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("k")),
                lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["k"] + F.when(a["sum"] + x < goal, 1).otherwise(0)).cast("long").alias("k")),
            )
            return F.least(low + walked["k"], high)

        return let(F.transform(logs, lambda x: F.exp(x - F.array_max(logs))), at)

    return let(F.transform(F.sequence(low, high), log_weight), pick)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Deal ``quotas`` (``source_key, quota``) among shards: ``shard, source_key, n``.

    A row is a node of the tree with all sources' counts; each level halves every node.
    """
    listed = F.array_sort(F.collect_list(F.struct("source_key", F.col("quota").alias("n"))))
    nodes = quotas.groupBy().agg(listed.alias("counts")).select(F.lit(0).alias("node"), "counts")
    kind = "struct<left:bigint,total:bigint,out:array<struct<source_key:bigint,n:bigint,l:bigint>>>"
    size = shards
    while size > 1:
        def step(state: Column, x: Column) -> Column:
            k = hypergeometric(state["total"], x["n"], state["left"], _uniform(F.lit(seed), F.lit(size), F.col("node"), x["source_key"]))
            return let(k, lambda k: F.struct((state["left"] - k).alias("left"), (state["total"] - x["n"]).alias("total"), F.concat(state["out"], F.array(F.struct(x["source_key"].alias("source_key"), x["n"].alias("n"), k.alias("l")))).alias("out")))

        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        half = F.floor(total / 2 + F.when(_uniform(F.lit(seed), F.lit(size), F.col("node")) < 0.5, 0.5).otherwise(0.0)).cast("long")
        begin = F.struct(half.alias("left"), total.alias("total"), F.array().cast("array<struct<source_key:bigint,n:bigint,l:bigint>>").alias("out")).cast(kind)
        dealt = nodes.select("node", F.aggregate("counts", begin, lambda s, x: step(s, x).cast(kind))["out"].alias("out"))
        # One small row for each node: written so that deep trees don't nest plans.
        dealt = staged(dealt, "split-level")
        side = lambda taken, k: F.struct((F.col("node") * 2 + k).alias("node"), F.transform("out", lambda x: F.struct(x["source_key"].alias("source_key"), taken(x).alias("n"))).alias("counts"))
        nodes = dealt.select(F.explode(F.array(side(lambda x: x["l"], 0), side(lambda x: x["n"] - x["l"], 1))).alias("c")).select("c.node", "c.counts")
        size //= 2
    return nodes.select(F.col("node").alias("shard"), F.explode("counts").alias("x")).select("shard", "x.source_key", "x.n").where("n > 0")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_key, source_size, target``: all words shared by weight, none above ``most`` times its source's size.

    The sources in order of size by weight: those before the first that stays below its cap are capped.
    """
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.get(listed, F.pmod(rank, F.lit(len(weights))))).withColumn("cap", F.col("source_size").cast("double") * most)
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    rows = rows.withColumn("share", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("fits", F.col("share") * F.col("weight") <= F.col("cap"))
    level = F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("r"), "share"))).over(Window.partitionBy())["share"]
    return rows.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), F.col("cap")))).select("source", "source_key", "source_size", "target")


def _source_key(source: Column) -> Column:
    return F.xxhash64(F.coalesce(F.concat(F.lit("="), source), F.lit("")))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """``doc_id, size, source_key, source_size, target, draws`` for each row of ``docs``.

    ``draws array<struct<pass, shard>>`` names the passes that take the document and the
    output shard of each.
    """
    source = docs[source_col].cast("string")
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.coalesce(F.regexp_count(docs[text_col].cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        source.alias("source"),
        _source_key(source).alias("source_key"),
        F.pmod(F.xxhash64(F.lit(seed), docs[id_col]), F.lit(blocks)).cast("int").alias("block"),
    )
    rows = staged(rows, "document-sizes")
    by_block = staged(rows.groupBy("source", "source_key", "block").agg(F.sum("size").alias("words")), "source-blocks")
    sources = staged(targets(by_block.groupBy("source", "source_key").agg(F.sum("words").alias("source_size")), weights), "source-targets")

    # Whole passes, then blocks in random order for the rest of the target.
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST_REPEATS))).otherwise(0).cast("int")
    own = by_block.drop("source").join(sources.drop("source"), "source_key").withColumn("passes", passes)
    rest = F.when(F.col("passes") < MOST_REPEATS, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)
    own = own.withColumn("rest", rest)
    # One row for each source, of at most ``blocks`` blocks in random order.
    listed = own.groupBy("source_key", "rest").agg(F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed + 1), F.col("source_key"), F.col("block")).alias("at"), "block", "words"))).alias("order"))
    begin = F.struct(F.col("rest").alias("left"), F.array().cast("array<int>").alias("taken"))
    fits = lambda s, x: F.when(x["words"] <= s["left"], F.struct((s["left"] - x["words"]).alias("left"), F.concat(s["taken"], F.array(x["block"])).alias("taken"))).otherwise(s)
    walk = listed.where("rest > 0").withColumn("s", F.aggregate("order", begin, fits))
    over = F.get(F.filter("order", lambda x: ~F.array_contains(F.col("s.taken"), x["block"])), 0)["block"]
    walk = walk.select("source_key", F.col("s.left").alias("left"), F.col("s.taken").alias("taken"), over.alias("cut"))
    own = own.join(walk, "source_key", "left")
    begun = F.coalesce(F.array_contains("taken", F.col("block")) | (F.col("block") == F.col("cut")), F.lit(False))
    own = own.withColumn("cut_words", F.when(F.col("block") == F.col("cut"), F.col("left")))
    drawn = own.withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("passes")))).where((F.col("pass") < F.col("passes")) | begun)
    at_random = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(seed + 2), F.col("source_key"), F.col("block"), F.col("pass")), "block", "pass")
    drawn = staged(drawn.withColumn("idx", F.row_number().over(at_random).cast("long") - 1).select("source_key", "block", "pass", "idx"), "block-draws")

    quotas = drawn.groupBy("source_key").agg(F.count("*").alias("quota"))
    leaves = split_quotas(quotas, shards, seed + 3)
    ends = F.sum("n").over(Window.partitionBy("source_key").orderBy("shard"))
    runs = leaves.withColumn("end", ends).withColumn("idx", F.explode(F.sequence(F.col("end") - F.col("n"), F.col("end") - 1)))
    placed = drawn.join(runs.select("source_key", "idx", "shard"), ["source_key", "idx"])
    draws = placed.groupBy("source_key", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"))

    held = own.select("source_key", "block", "source_size", "target", "passes", "cut_words").join(draws, ["source_key", "block"], "left")
    held = held.withColumn("draws", F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:int>>")))
    held = staged(held, "block-plan")
    joined = rows.drop("source").join(held, ["source_key", "block"])
    columns = ["doc_id", "size", "source_key", "source_size", "target", "draws"]
    whole = joined.where("cut_words is null").select(columns)
    in_turn = Window.partitionBy("source_key").orderBy(F.xxhash64(F.lit(seed + 4), F.col("doc_id")), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    some = joined.where("cut_words is not null").withColumn("until", F.sum("size").over(in_turn))
    inside = F.col("until") - F.col("size") / 2 <= F.col("cut_words")
    some = some.withColumn("draws", F.when(inside, F.col("draws")).otherwise(F.filter("draws", lambda d: d["pass"] < F.col("passes"))))
    return whole.unionByName(some.select(columns))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The rows that the mix takes, all columns, as often as it takes them, with ``shard`` and a random ``position`` in it.

    Rows with equal ids and equal sizes share their draws. The result is dealt by shard and
    run of positions, so a shard is no single task, and sorted by position within it.
    """
    planned = plan(docs, id_col, text_col, source_col, weights, blocks, shards, seed)
    taken = planned.groupBy("doc_id", "size", "source_key").agg(F.max_by("draws", F.size("draws")).alias("draws")).where("size(draws) > 0")
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    named = docs.select(F.struct("*").alias("row"), docs[id_col].alias("__id"), size.alias("__size"), _source_key(docs[source_col].cast("string")).alias("__key"))
    both = named.join(taken, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__size") == F.col("size")) & (F.col("__key") == F.col("source_key")))
    rows = both.select("row", F.explode("draws").alias("d"))
    place = F.xxhash64(F.lit(seed + 5), F.col("d.shard"), F.col("d.pass"), F.col("row").getField(id_col))
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "position")]
    mix = rows.select(*kept, F.col("d.shard").alias("shard"), place.alias("position"))
    return mix.repartition("shard", F.shiftrightunsigned("position", 54)).sortWithinPartitions("shard", "position")
