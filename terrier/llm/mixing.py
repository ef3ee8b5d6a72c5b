"""Mix sources to target weights: fixed blocks of words, multinomial draws per output shard, permuted indexes, a join.

The words of a source, in the order of doc_id, are cut into blocks of ``BLOCK_WORDS``, and its target becomes a number of draws.
The output is cut into shards of ``SHARD_SLOTS`` slots, a slot for a block. For each shard one multinomial draw over all sources, by their
draws, says how many of its slots each source gets. Sources then have a few draws too many or too few in all: the surplus draws of
a source (its last ones) keep their slots, but go in order to the sources that lack some. So every shard keeps its size, and every
source has exactly its number of draws.

The k-th draw of a source takes block ``permutation(k mod blocks)`` of its epoch ``k div blocks``, so a block is taken again only
after all others of its source. Draws meet blocks in a join on (source, index), which one hot source can't skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrier.llm.prefix import with_prefix
from terrier.llm.shared import fixed, n_words, stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK_WORDS = 32
#: Slots of an output shard, each for a block.
SHARD_SLOTS = 1 << 14
#: Sources that share one multinomial draw; beyond, a shard's slots are first drawn for groups of so many, then inside each group.
SOURCE_GROUP = 4096
SEED = 20240117
#: Rows of the source table up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 10_000
#: Groups of sources (of 64 kB at most) up to which they are broadcast.
BROADCAST_GROUPS = 64
SLICE = 1 << 17


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row for each source of ``sizes`` (source, size): src (its rank by code points, null last), source_size,
    first_word (words of the sources before it) and target.

    Weights repeat over the ranks. A target stops at ``most`` times its source's size; the excess is shared out
    again by weight until none is above. Each round sends two sums to the driver, whatever the number of sources.
    """
    per = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    ranked = with_prefix(per, [F.col("source").asc_nulls_last()], {"first_word": "source_size"})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("row_index") % len(weights) + 1).cast("int"))
    ranked = stored(ranked.select("source", F.col("row_index").alias("src"), "source_size", "first_word", weight.alias("weight"), (most * F.col("source_size")).cast("double").alias("most")), "ranked")
    level, total = 0.0, ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        full = F.col("weight") * level >= F.col("most")
        taken, rest = ranked.agg(F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if not rest or (now := (total - taken) / rest) <= level:
            break
        level = now
    return ranked.select("source", "src", "source_size", "first_word", F.least(F.col("weight") * level, F.col("most")).alias("target"))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n) at ``index``: four Feistel rounds, repeated while the result is n or more."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        x = out[todo]
        a, b = x >> np.uint64(half), x & low
        for r in range(4):
            m = (b + np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            a, b = b, a ^ (m >> np.uint64(33) & low)
        out[todo] = a << np.uint64(half) | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def _key(*parts: int) -> int:
    """A 63-bit key of some integers, the same everywhere."""
    x = 0
    for p in parts:
        x = (x ^ (p % (1 << 64))) * 0x9E3779B97F4A7C15 % (1 << 64)
        x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x ^= x >> 29
    return x >> 1


def wanted(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(src, blocks, want) for each source with words: its blocks and its draws, b for each whole size in the target and for the rest as many as come nearest."""
    size, target = F.col("source_size"), F.col("target")
    blocks, whole = F.ceil(size / block_words), F.floor(target / size)
    rest = F.round((target - whole * size) * blocks / size)
    return sources.filter("source_size > 0").select("src", blocks.cast("long").alias("blocks"), (whole * blocks + rest).cast("long").alias("want"))


def drawn(want: DataFrame, n_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, src, n): for each output shard, how many of its slots each source drew; the last shard may be shorter.

    A draw over very many sources is made in two steps, which gives the same chances: first the slots of each group of
    ``SOURCE_GROUP`` sources, then inside a group. The driver holds one sum for each group.
    """
    spark = want.sparkSession
    grouped = want.filter("want > 0").withColumn("part", F.floor(F.col("src") / SOURCE_GROUP))
    members = grouped.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("src", "want"))).alias("members"), F.sum("want").alias("all"))
    totals = sorted((r.part, r.all) for r in members.select("part", "all").collect())
    total = sum(n for _, n in totals)
    parts, share = np.array([p for p, _ in totals], np.int64), np.array([n for _, n in totals], float) / max(total, 1)

    def outer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame["id"]:
                counts = np.random.default_rng([seed, shard]).multinomial(min(n_slots, total - shard * n_slots), share)
                own = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "part": parts[own], "slots": counts[own]})

    def inner(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, part, slots, group in zip(frame["shard"], frame["part"], frame["slots"], frame["members"], strict=True):
                src, n = np.array([m["src"] for m in group], np.int64), np.array([m["want"] for m in group], float)
                counts = np.random.default_rng([seed, shard, part]).multinomial(slots, n / n.sum())
                own = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "src": src[own], "n": counts[own]})

    shards = spark.range(-(-total // n_slots)).repartition(fixed(None, spark)).mapInPandas(outer, "shard long, part long, slots long")
    # dealt out again, so that the two steps don't share a task: each holds Python workers of its own
    shards = shards.repartition(fixed(None, spark), "shard", "part")
    held = F.broadcast(members.select("part", "members")) if len(totals) <= BROADCAST_GROUPS else members.select("part", "members")
    return shards.join(held, "part").select("shard", "part", "slots", "members").mapInPandas(inner, "shard long, src long, n long")


def draws(sources: DataFrame, block_words: int = BLOCK_WORDS, n_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Rows (src, index, shard, draw, epoch): the block that each draw takes, and the output shard that it goes to."""
    want = stored(wanted(sources, block_words), "wanted")
    # a source's draws are numbered over the shards, in their order
    dealt = with_prefix(stored(drawn(want, n_slots, seed), "drawn"), [F.col("src"), F.col("shard")], {"first": "n"})
    got = stored(dealt.groupBy("src").agg(F.sum("n").alias("got"), F.min("first").alias("zero")), "got")
    each = want.join(got, "src", "left").select("src", "blocks", "want", F.coalesce("got", F.lit(0).cast("long")).alias("got"), "zero")
    each = stored(each.withColumns({"over": F.greatest(F.col("got") - F.col("want"), F.lit(0)), "under": F.greatest(F.col("want") - F.col("got"), F.lit(0))}), "each")
    lines = stored(with_prefix(each, [F.col("src")], {"over_at": "over", "under_at": "under"}).select("src", "blocks", "want", "got", "zero", "over_at", "under", "under_at"), "lines")
    few = lines.count() <= BROADCAST_SOURCES
    placed = dealt.select("src", "shard", "n", "first").join(F.broadcast(lines) if few else lines, "src").withColumn("first", F.col("first") - F.col("zero"))
    placed = stored(placed.withColumn("stay", F.greatest(F.least(F.col("n"), F.col("want") - F.col("first")), F.lit(0))), "placed")
    own = placed.filter("stay > 0").select("src", "blocks", "shard", "first", F.col("stay").alias("n"))
    # the k-th surplus slot goes to the k-th draw that a source lacks; both are about the square root of all draws
    k = F.sequence(F.col("stay"), F.col("n") - 1)
    surplus = placed.filter("stay < n").select("shard", F.explode(F.transform(k, lambda i: F.col("over_at") + F.col("first") + i - F.col("want"))).alias("e"))
    lack = lines.filter("under > 0").select("src", "blocks", "got", "under_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1)).alias("i"))
    lack = lack.select("src", "blocks", (F.col("got") + F.col("i")).alias("first"), (F.col("under_at") + F.col("i")).alias("e"))
    moved = lack.join(surplus, "e").select("src", "blocks", "shard", "first", F.lit(1).cast("long").alias("n"))

    def take(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for (src, blocks), group in frame.groupby(["src", "blocks"]):
                firsts, n, shards = (group[c].to_numpy() for c in ("first", "n", "shard"))
                ends = np.cumsum(n)
                for at in range(0, int(ends[-1]), SLICE):
                    i = np.arange(at, min(int(ends[-1]), at + SLICE))
                    row = np.searchsorted(ends, i, side="right")
                    k = firsts[row] + i - (ends - n)[row]
                    epoch, index = k // blocks, np.empty(len(k), np.int64)
                    for e in np.unique(epoch):
                        mine = epoch == e
                        index[mine] = permuted(k[mine] % blocks, int(blocks), _key(seed, int(src), int(e)))
                    yield pd.DataFrame({"src": src, "index": index, "shard": shards[row], "draw": k, "epoch": epoch})

    spread = own.union(moved).repartition(fixed(None, sources.sparkSession), "src", "shard", "first")
    return spread.mapInPandas(take, "src long, index long, shard long, draw long, epoch long")


def laid_out(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The written ``rows`` (doc_id, row, source, size, tie) in their sources (doc_id, row, src, size, source_size, target, start: words of the
    source before), and the sources. Rows lie by doc_id, then size, then tie (a hash of the text): only rows that are equal in all
    three lie as they come, so the order of the table doesn't matter."""
    sources = stored(targets(rows, weights), "targets")
    few = sources.count() <= BROADCAST_SOURCES
    placed = rows.join(F.broadcast(sources) if few else sources, rows["source"].eqNullSafe(sources["source"])).drop(rows["source"]).drop(sources["source"])
    laid = with_prefix(placed, [F.col("src"), F.col("doc_id"), F.col("size"), F.col("tie")], {"start": "size"})
    return stored(laid.select("doc_id", "row", "src", "size", "source_size", "target", (F.col("start") - F.col("first_word")).alias("start")), "laid"), sources


def pieces(laid: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(src, index, row, a, b) for each block that a row's words reach: words a to b of the row, b exclusive."""
    end = F.col("start") + F.col("size")
    blocks = laid.filter("size > 0").select("row", "src", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((end - 1) / block_words))).alias("index"))
    a = F.greatest(F.col("index") * block_words - F.col("start"), F.lit(0))
    b = F.least((F.col("index") + 1) * block_words - F.col("start"), F.col("size"))
    return blocks.select("src", "index", "row", a.alias("a"), b.alias("b"))


def shard_mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, n_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, source, blocks): what each output shard is mixed of. No row for a source that a shard has nothing of; none at all for an empty table."""
    rows = stored(docs.select("source", n_words(text).alias("size")), "sizes")
    sources = stored(targets(rows, weights), "targets")
    counts = draws(sources, block_words, n_slots, seed).groupBy("shard", "src").agg(F.count("*").alias("blocks"))
    return counts.join(sources, "src").select("shard", "source", "blocks")


def mix(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, block_words: int = BLOCK_WORDS, n_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_shard of every row of ``docs``.

    size: words, null text has none; taken: words that the mix takes from the row, repeats counted; at most three
    times its size; first_shard: the first output shard that takes a block with words of the row, null if none does. A null source
    is a source, ranked last. Rows without words are kept and taken 0 times; repeated rows are rows of their own. Where no
    source has words all targets are 0. An empty table gives no row; other columns are ignored. Reruns agree, in whatever
    order the rows come.
    """
    rows = stored(docs.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(F.col(text)).alias("tie"), F.monotonically_increasing_id().alias("row")), "sizes")
    laid, sources = laid_out(rows, weights)
    times = draws(sources, block_words, n_slots, seed).groupBy("src", "index").agg(F.count("*").alias("times"), F.min("shard").alias("shard"))
    # planned by the size of the source table, draws would be broadcast
    used = pieces(laid, block_words).join(times.hint("merge"), ["src", "index"]).groupBy("row").agg(F.sum((F.col("b") - F.col("a")) * F.col("times")).alias("taken"), F.min("shard").alias("first_shard"))
    return laid.join(used, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, n_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: for each epoch in which a row is drawn, a row with the columns of ``docs`` whose text is the
    drawn words. An epoch that takes all of a row's words keeps its text as it is. Rows without words are never drawn."""
    # numbered and written once, so that the words cut below are those of the rows that were drawn
    marked = stored(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "numbered")
    rows = stored(marked.select("doc.doc_id", "doc.source", n_words(F.col("doc.text")).alias("size"), F.xxhash64("doc.text").alias("tie"), "row"), "sizes")
    laid, sources = laid_out(rows)
    drawn_blocks = draws(sources, block_words, n_slots, seed).select("src", "index", "epoch")
    got = pieces(laid, block_words).join(drawn_blocks.hint("merge"), ["src", "index"]).groupBy("row", "epoch").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"))
    n_taken = F.aggregate("spans", F.lit(0).cast("long"), lambda x, s: x + s["b"] - s["a"])
    whole = laid.select("row", "size").join(got, "row").select("row", "spans", (n_taken == F.col("size")).alias("all"))
    words = F.split(F.regexp_replace("doc.text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    some = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice("words", (s["a"] + 1).cast("int"), (s["b"] - s["a"]).cast("int")))), " ")
    some = F.when(F.col("words").isNotNull(), some)  # two uses keep the split out of the lambda, where it would run for each span
    out = marked.join(whole, "row").withColumn("words", F.when(~F.col("all"), words)).withColumn("text", F.when(F.col("all"), F.col("doc.text")).otherwise(some))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
