"""Sharding by a k-d tree over metadata.

The tree splits its nodes level by level at weighted medians: of the node's dimensions the one with the
widest spread (as a share of its range over the whole table) is cut so that the bytes on both sides are in
the ratio of the shards they are to hold. The dimensions are metadata that equal texts share: the logarithm of the size,
the language in alphabetical order, characters by byte, and bytes by word; the text's checksum only orders rows that agree in one. A cut is found for all nodes together by counting bytes in
ever finer slices of the dimension, so each round is one aggregation of a fixed number of groups
per node. Equal texts have equal keys in every dimension and stay together, unless the cut falls into
more bytes of one text than the sizes may differ by: then that group is cut by its ids.

Law: ``bytes`` - the shards' sizes are near equal.

Defined cases: a null text has no bytes, size 8 and the checksum of the empty text; a null id sorts first
inside its group; repeated rows are rows of their own and each has a slot; an empty table gives an
empty one; columns besides the id, the text and the named dimensions are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from quadrille.llm.spark_io import partitions, written

SHARDS, EXTRA_BYTES = 24, 8
#: Slices of a node in a round.
SLICES = 4096
#: Sizes may differ by this share of a shard for a group to stay whole.
TOLERANCE = 0.002
DIMENSIONS = ("dim_size", "dim_lang", "dim_chars", "dim_words")
#: Ids are told apart between these bounds.
LOW, HIGH = -(1 << 61), 1 << 61


@dataclass
class Node:
    first: int  # shards first .. first + shards - 1
    shards: int
    dim: str = ""
    low: int = LOW  # the cut lies in (low, high]
    high: int = HIGH
    below: int = 0  # bytes of the node under low
    want: int = 0  # bytes that the lower side should get
    cut: int | None = None
    within: bool = False  # the cut is among the ids of one key
    key: int | None = None


def with_keys(df: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """(id, size, crc and a 62-bit key for each dimension): the value above, the text's checksum below."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + EXTRA_BYTES
    crc = F.crc32(F.encode(text, "UTF-8"))
    scaled = lambda value: F.shiftleft(F.least(value.cast("long"), F.lit((1 << 30) - 1)), 32) + F.col("text_crc32")
    lang = F.encode(F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "UTF-8") if lang_col else F.lit(b"")
    # the first bytes as a number, which is their alphabetical order
    order = F.conv(F.rpad(F.hex(F.substring(lang, 1, 3)), 6, "0"), 16, 10).cast("long")
    words = F.size(F.split(text, r"[\x20\x09-\x0D]+"))
    base = df.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("text_crc32"), order.alias("lang"), F.length(text).alias("chars"), words.alias("words"))
    share = lambda part, of: (part.cast("double") / of * (1 << 20)).cast("long")
    return base.select(
        "id", "size", "text_crc32",
        # logarithmic, so that few long texts don't make the dimension wide
        scaled((F.log2(F.col("size").cast("double")) * (1 << 24)).cast("long")).alias("dim_size"),
        scaled(F.col("lang")).alias("dim_lang"),
        scaled(share(F.col("chars"), F.col("size"))).alias("dim_chars"),
        scaled((F.log2(F.col("size") / F.col("words").cast("double")) * (1 << 20)).cast("long")).alias("dim_words"),
    )


def _spreads(rows: DataFrame) -> dict[int, tuple]:
    moments = [x for d in DIMENSIONS for x in (F.min(d).alias(f"lo_{d}"), F.max(d).alias(f"hi_{d}"))]
    return {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *moments).collect()}


def _width(r, dim: str) -> int:
    return (r[f"hi_{dim}"] >> 32) - (r[f"lo_{dim}"] >> 32)


def _bounded_id():
    return F.greatest(F.lit(LOW), F.least(F.lit(HIGH - 1), F.coalesce(F.col("id").cast("long"), F.lit(LOW))))


def _plan(nodes: list[Node]):
    """SQL: the node's key in its dimension (its id once the cut is among ids)."""
    key, low, high = F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for n in nodes:
        here = F.col("node") == n.first
        key = F.when(here, F.when(F.col(n.dim) == n.key, _bounded_id()) if n.within else F.col(n.dim)).otherwise(key)
        low, high = F.when(here, F.lit(n.low)).otherwise(low), F.when(here, F.lit(n.high)).otherwise(high)
    return key, low, high


def _search(rows: DataFrame, nodes: list[Node], share: float) -> None:
    """Finds every node's cut: a row goes down if its key is less."""
    open_ = list(nodes)
    while open_:
        key, low, high = _plan(open_)
        step = F.greatest(F.lit(1), F.expr(f"(b - a - 1) div {SLICES} + 1"))
        inside = rows.where(F.col("node").isin([n.first for n in open_])).select("node", "size", key.alias("key"), low.alias("a"), high.alias("b")).where("key >= a and key < b")
        counts = inside.select("node", "size", F.expr("key - a").alias("off"), step.alias("step")).select("node", "size", F.expr("off div step").alias("slice"))
        got: dict[int, dict[int, tuple[int, int]]] = {n.first: {} for n in open_}
        for r in counts.groupBy("node", "slice").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
            got[r.node][r.slice] = (r.bytes, r.n)
        for n in open_:
            step = max(1, (n.high - n.low - 1) // SLICES + 1)
            total, at = n.below, None
            for s in sorted(got[n.first]):
                more = got[n.first][s][0]
                if total + more >= n.want:
                    at = s
                    break
                total += more
            if at is None:
                n.cut = n.high
                continue
            after, alone = total + got[n.first][at][0], got[n.first][at][1] == 1
            slack = share * TOLERANCE
            a, b = n.low + at * step, min(n.low + (at + 1) * step, n.high)
            if n.want - total <= slack and (total or not after):
                n.cut = a
            elif after - n.want <= slack:
                n.cut = b
            elif alone:
                n.cut = a if n.want - total < after - n.want else b
            elif step == 1 and not n.within:
                # one key holds the cut: the rows of one text, which are cut by their ids
                n.within, n.key, n.low, n.high, n.below = True, a, LOW, HIGH, total
            elif step == 1:
                n.cut = a if n.want - total < after - n.want else b
            else:
                n.low, n.high, n.below = a, b, total
        open_ = [n for n in open_ if n.cut is None]


def kd_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) for each row of df."""
    rows = written(with_keys(df, id_col, text_col, lang_col), "keys").withColumn("node", F.lit(0))
    nodes, share, ranges = [Node(0, shards)], None, {}
    while nodes:
        spread = _spreads(rows)
        if share is None:
            share = (sum(r.bytes for r in spread.values()) if spread else 0) / shards
            ranges = {d: max([1, *(_width(r, d) for r in spread.values())]) for d in DIMENSIONS}
        split = []
        for n in nodes:
            if n.first not in spread:
                continue
            r = spread[n.first]
            lower = n.shards // 2
            n.dim = max(DIMENSIONS, key=lambda d: _width(r, d) / ranges[d])
            n.low, n.high = r[f"lo_{n.dim}"], r[f"hi_{n.dim}"] + 1
            n.want = r.bytes * lower // n.shards
            split.append((n, lower))
        if split:
            _search(rows, [n for n, _ in split], share)
        node = F.col("node")
        for n, lower in split:
            if n.within:
                up = (F.col(n.dim) > n.key) | ((F.col(n.dim) == n.key) & (_bounded_id() >= n.cut))
            else:
                up = F.col(n.dim) >= n.cut
            node = F.when((F.col("node") == n.first) & up, F.lit(n.first + lower)).otherwise(node)
        # written: else every level's cuts would stand inside the next one's expressions
        rows = written(rows.withColumn("node", node.cast("int")), "nodes")
        nodes = [m for n, lower in split for m in (Node(n.first, lower), Node(n.first + lower, n.shards - lower)) if m.shards > 1]
    return _with_slots(rows.select("id", "size", "text_crc32", F.col("node").alias("shard")), id_col, shards, partitions(df))


def _with_slots(rows: DataFrame, id_col: str, shards: int, parts: int) -> DataFrame:
    """Gapless places in each shard: counts of slices of a shard first, then places inside a slice."""
    per_shard = max(1, -(-parts // shards) * 4)
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(per_shard)).cast("int"))
    earlier = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = sliced.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = held.select("shard", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    nth = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("id", "text_crc32"))
    return sliced.withColumn("nth", nth).join(before, ["shard", "slice"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("begin") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
