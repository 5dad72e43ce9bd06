"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree (operator 9).

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words;
   a target stops at twice its source's words and the excess is reshared by weight.
2. Each source's documents, permuted by a seeded hash, form a stream of words that is cut into blocks of
   nearly equal size. A source's quota is the number of blocks its target needs, passes over the whole
   stream included; its last block may be drawn in part, so the words drawn come to the target.
3. The quotas are split among output shards: at every node of a binary tree over the shards, the
   blocks that go left follow a multivariate hypergeometric draw, itself resolved by a binary tree
   over the sources with one hypergeometric draw per node (inverse distribution, native expressions,
   seeded uniforms). Shard sizes and source quotas are met exactly.
4. Shard k draws the next disjoint run of a source's permuted blocks, and its rows are put in random order
   of blocks (``mixed`` has the position; writers sort within shards).

Everything is DataFrame functions; only totals reach the driver. A source with a third of all rows is
dealt over hash buckets, and prefix sums go over bucket totals first.

Null texts and texts without words have size 0 and are never taken; a null source is a source;
repeated rows are separate rows (of one ``doc_id`` they may be told apart by place only). An
empty table gives an empty result. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from repocensus.llm.ranks import ranked
from repocensus.llm.tables import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 2048
SHARDS = 8
SEED = 42
ROWS_PER_BUCKET = 20_000
# Fixed primes for permuting block numbers, one per pass; the last stands in where one divides a block count.
PRIMES = (2147483647, 1000000007, 998244353, 2147483629)


def sized(docs: DataFrame) -> DataFrame:
    """``doc`` (the whole row), ``locator``, ``doc_id``, ``source`` and ``size`` of every row, stored."""
    return stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
            F.monotonically_increasing_id().alias("locator"),
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sized",
    )


def source_targets(rows: DataFrame) -> DataFrame:
    """``source``, ``idx`` (0-based order), ``source_size`` and ``target``, stored."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("idx") % len(WEIGHTS) + 1).cast("int"))
    sources = stored(
        ranked(sums, [F.col("source").isNull(), F.col("source")])
        .withColumn("idx", (F.col("rank") - 1).cast("long"))
        .withColumn("weight", weight)
        .select("source", "idx", "source_size", "weight"),
        "mix-sources",
    )
    budget = SHARE * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, open_weight = 0.0, None
    while True:  # each turn fixes the sources whose cap the present level exceeds
        capped = F.col("source_size") * MOST < F.col("weight") * F.lit(level)
        fixed, rest = sources.agg(
            F.sum(F.when(capped, F.col("source_size") * MOST)), F.sum(F.when(~capped, F.col("weight")))
        ).first()
        if not rest or rest == open_weight:
            break
        level, open_weight = (budget - (fixed or 0)) / rest, rest
    target = F.least(F.col("weight") * F.lit(level), (F.col("source_size") * MOST).cast("double"))
    return stored(sources.withColumn("target", target), "mix-targets")


def with_blocks(targets: DataFrame, block_words: int) -> DataFrame:
    """Adds the block layout: ``blocks``, their size ``q`` (one word more for the first ``r``), ``quota``, ``trim``."""
    wanted = F.least(F.round("target").cast("long"), F.col("source_size") * MOST)
    return (
        targets.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("q", F.expr("IF(blocks = 0, 0, source_size DIV blocks)"))
        .withColumn("r", F.expr("IF(blocks = 0, 0, source_size % blocks)"))
        .withColumn("wanted", wanted)
        .withColumn("passes", F.expr("IF(blocks = 0, 0, wanted DIV source_size)"))
        .withColumn("rest", F.expr("wanted - passes * source_size"))
        .withColumn("part", F.expr("IF(blocks = 0, 0, CAST(floor(rest / (source_size / blocks)) AS BIGINT))"))
        .withColumn("trim", F.expr("IF(blocks = 0, 0, CAST(round(rest - part * (source_size / blocks)) AS BIGINT))"))
        .withColumn("quota", F.expr("passes * blocks + part + IF(trim > 0, 1, 0)"))
    )


def with_draw(df: DataFrame) -> DataFrame:
    """Adds ``left``: how many of ``a`` good and ``b`` bad ones are good among ``n`` draws without replacement.

    Inverts the distribution at the uniform ``u``. Weights run from the mode outwards by their exact
    ratios, as far as nine standard deviations, where what is left is below double precision. One walk sums
    the weights, a second one stops at the uniform's share of the sum.
    """
    up = "s.w * ((a - k + 1D) * (n - k + 1D)) / (k * (b - n + k + 0D))"
    down = "s.w * ((k + 1D) * (b - n + k + 1D)) / ((a - k + 0D) * (n - k + 0D))"
    first = "struct(1D AS w, 1D AS z)"

    def total(numbers: str, factor: str) -> str:
        return f"aggregate({numbers}, {first}, (s, k) -> struct({factor} AS w, s.z + {factor} AS z)).z - 1D"

    def stop(numbers: str, factor: str, z: str) -> str:
        begin = f"struct(1D AS w, {z} AS z, CAST(NULL AS BIGINT) AS found)"
        found = f"IF(s.found IS NULL AND s.z + {factor} >= x, k, s.found) AS found"
        return f"aggregate({numbers}, {begin}, (s, k) -> struct({factor} AS w, s.z + {factor} AS z, {found})).found"

    steps = {
        "low": "greatest(0L, n - b)",
        "high": "least(n, a)",
        "mode": "greatest(low, least(high, CAST(floor((n + 1D) * (a + 1D) / (a + b + 2D)) AS BIGINT)))",
        "reach": "CAST(9 * sqrt(n * (a / (a + b)) * (b / (a + b)) * (a + b - n) / greatest(a + b - 1D, 1D)) AS BIGINT) + 12",
        "ups": "IF(mode < high, sequence(mode + 1, least(high, mode + reach)), CAST(array() AS ARRAY<BIGINT>))",
        "downs": "IF(mode > low, sequence(mode - 1, greatest(low, mode - reach), -1L), CAST(array() AS ARRAY<BIGINT>))",
        "z_up": total("ups", up),
        "z_down": total("downs", down),
        "x": "u * (1D + z_up + z_down)",
        "left": f"IF(x <= 1D, mode, coalesce({stop('ups', up, '1D')}, {stop('downs', down, '1D + z_up')}, mode))",
    }
    for name, step in steps.items():
        df = df.withColumn(name, F.expr(step))
    return df.drop(*[c for c in steps if c != "left"])


def split_quotas(sources: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(``shard``, ``idx``, ``n``): how many blocks of each source every shard gets; ``sources`` has ``idx`` and ``quota``.

    ``shards`` is a power of two. A level of the tree is one table of (node, source, blocks).
    """
    if shards & (shards - 1):
        raise ValueError("the number of shards must be a power of two")
    total, top = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.coalesce(F.max("idx"), F.lit(0))).first()
    depth = max(int(top).bit_length(), 0)
    level = sources.where("quota > 0").select(F.lit(0).cast("long").alias("node"), "idx", F.col("quota").alias("n"))
    width = shards
    while width > 1:
        level = stored(level, "mix-level")
        edge = f"CAST((node * {width} + {{k}}) * CAST({total} AS DECIMAL(38,0)) DIV {shards} AS BIGINT)"
        goes_left = F.expr(f"{edge.format(k=width // 2)} - {edge.format(k=0)}")
        draws = level.select("node").distinct().select("node", F.lit(0).cast("long").alias("g"), goes_left.alias("n"))
        for bit in range(depth - 1, -1, -1):
            child = F.shiftright("idx", bit)
            halves = level.groupBy("node", F.shiftright(child, 1).alias("g")).agg(
                F.sum(F.when(child % 2 == 0, F.col("n")).otherwise(0)).alias("a"),
                F.sum(F.when(child % 2 == 1, F.col("n")).otherwise(0)).alias("b"),
            )
            mixed = F.xxhash64(F.lit(seed), F.lit(width), F.lit(bit), "node", "g")
            uniform = (F.pmod(mixed, F.lit(1 << 53)) + 0.5) / float(1 << 53)
            drawn = with_draw(draws.join(halves, ["node", "g"]).withColumn("u", uniform))
            two = F.array(
                F.struct((F.col("g") * 2).alias("g"), F.col("left").alias("n"), F.col("a").alias("all")),
                F.struct((F.col("g") * 2 + 1).alias("g"), (F.col("n") - F.col("left")).alias("n"), F.col("b").alias("all")),
            )
            draws = drawn.select("node", F.explode(two).alias("c")).where("c.all > 0").select("node", "c.g", "c.n")
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("to_left").alias("n")),
            F.struct((F.col("node") * 2 + 1).alias("node"), (F.col("n") - F.col("to_left")).alias("n")),
        )
        sides = level.join(draws.select("node", F.col("g").alias("idx"), F.col("n").alias("to_left")), ["node", "idx"])
        level = sides.select("idx", F.explode(both).alias("c")).select("c.node", "idx", "c.n").where("n > 0")
        width //= 2
    return level.select(F.col("node").alias("shard"), "idx", "n")


def mixed(rows: DataFrame, targets: DataFrame, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """What every shard draws: ``locator``, ``pass``, ``start`` (first word in the document), ``n_words``, ``shard``, ``position``.

    ``position`` orders a shard: its blocks at random, the documents of a block in a row.
    """
    laid = with_blocks(targets, block_words)
    plan = stored(laid.select("idx", "quota"), "mix-quotas")
    quotas = split_quotas(plan, shards, seed)
    run = Window.partitionBy("idx").orderBy("shard")
    runs = quotas.withColumn("from", F.sum("n").over(run) - F.col("n")).groupBy("idx").agg(
        F.sort_array(F.collect_list(F.struct("from", "shard"))).alias("runs")  # as many as there are shards
    )
    sources = stored(laid.join(runs, "idx", "left"), "mix-runs")

    # The stream: documents by a seeded hash, through totals of hash buckets.
    count = rows.count()
    bits = max(0, math.ceil(math.log2(max(1, count / ROWS_PER_BUCKET))))
    key = F.xxhash64(F.lit(seed), "doc_id")
    bucket = F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")
    keyed = (
        rows.select("locator", "doc_id", F.col("source").alias("of_source"), "size")
        .where("size > 0")
        .join(sources.select("source", "idx"), F.col("of_source").eqNullSafe(F.col("source")))
        .select("idx", "locator", "doc_id", "size", key.alias("key"), bucket.alias("bucket"))
    )
    sums = keyed.groupBy("idx", "bucket").agg(F.sum("size").alias("words"))
    before = sums.select("idx", "bucket", (F.sum("words").over(Window.partitionBy("idx").orderBy("bucket")) - F.col("words")).alias("before"))
    in_bucket = Window.partitionBy("idx", "bucket").orderBy("key", "doc_id", "size", "locator").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        keyed.withColumn("ahead", F.coalesce(F.sum("size").over(in_bucket), F.lit(0)))
        .join(before, ["idx", "bucket"])
        .withColumn("at", F.col("before") + F.col("ahead"))
        .join(sources.drop("source", "source_size", "target", "weight"), "idx")
    )

    def block_of(word: str) -> str:
        return f"IF({word} < r * (q + 1), {word} DIV (q + 1), r + ({word} - r * (q + 1)) DIV q)"

    primes = "array(" + ", ".join(f"{p}L" for p in PRIMES) + ")"
    prime = f"IF(blocks % element_at({primes}, CAST(pass + 1 AS INT)) = 0, {PRIMES[-1]}L, element_at({primes}, CAST(pass + 1 AS INT)))"
    blocks = (
        placed.select("*", F.expr(f"explode(sequence({block_of('at')}, {block_of('(at + size - 1)')})) AS block"))
        .select("*", F.expr("explode(sequence(0L, passes)) AS pass"))
        .withColumn("shift", F.pmod(F.xxhash64(F.lit(seed), "idx", "pass"), "blocks"))
        .withColumn("draw", F.expr(f"pass * blocks + (({prime}) % blocks * block + shift) % blocks"))
        .where("draw < quota")
        .withColumn("begins", F.expr("block * q + least(block, r)"))
        .withColumn("ends", F.expr("begins + IF(draw = quota - 1 AND trim > 0, least(trim, q + 1), q + IF(block < r, 1, 0))"))
        .withColumn("ends", F.expr("least(ends, begins + q + IF(block < r, 1, 0))"))
        .withColumn("start", F.expr("greatest(at, begins) - at"))
        .withColumn("n_words", F.expr("least(at + size, ends) - greatest(at, begins)"))
        .where("n_words > 0")
    )
    shard = F.expr("element_at(filter(runs, x -> x.from <= draw), -1).shard")
    position = F.struct(F.xxhash64(F.lit(seed + 1), "idx", "draw").alias("of_block"), F.col("at"))
    return blocks.select("locator", "pass", "start", "n_words", shard.alias("shard"), position.alias("position"))


def mix_query(docs: DataFrame) -> DataFrame:
    rows = sized(docs.select("doc_id", "text", "source"))
    targets = source_targets(rows)
    takes = mixed(rows, targets).groupBy("locator").agg(F.sum("n_words").alias("taken"), F.min(F.struct("shard", "position")).alias("first"))
    named = targets.select(F.col("source").alias("of_source"), "source_size", "target")
    return (
        rows.select("locator", "doc_id", "source", "size")
        .join(named, F.col("source").eqNullSafe(F.col("of_source")))
        .join(takes, "locator", "left")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first.shard", F.col("first.position.of_block").alias("position"))
    )


def mix_stage(docs: DataFrame) -> DataFrame:
    """The mixture as documents: a row per document and pass, its text cut to the words drawn.

    A document drawn whole keeps its text unchanged; of one drawn in part, the drawn runs of words
    follow each other with the white space after each word. Rows come by shard and in the shard's order: blocks at random,
    a document with the first of its blocks.
    """
    rows = sized(docs)
    takes = mixed(rows, source_targets(rows)).groupBy("locator", "pass").agg(
        F.sum("n_words").alias("words"),
        F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("parts"),
        F.min(F.struct("shard", "position")).alias("first"),
    )
    # The words of a text are found once, however many runs of them are drawn.
    words = r"array(regexp_extract_all(doc.text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0))"
    runs = "transform(parts, p -> slice(w, CAST(p.start + 1 AS INT), CAST(p.n_words AS INT)))"
    cut = f"array_join(flatten(transform({words}, w -> flatten({runs}))), '')"
    drawn = rows.join(takes, "locator").withColumn("drawn", F.expr(f"IF(words = size, doc.text, {cut})"))
    columns = {"text": F.col("drawn")}
    if "n_chars" in docs.columns:
        whole = F.col("words") == F.col("size")
        columns["n_chars"] = F.when(whole, F.col("doc.n_chars")).otherwise(F.char_length("drawn").cast("long"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["first.shard", "first.position", "locator", "pass"]
    dealt = drawn.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return dealt.select(*[columns.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
