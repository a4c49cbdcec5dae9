"""A Merkle manifest of a dataset, as a radix trie over ranks.

Each row is a leaf, the digest of its columns. The leaves of a group, in the
order of their ids, are cut into runs of ``fanout``; a run's digests together
give the node above it, until one node is left, and the groups' last nodes are
joined in the same way to a single root.

Ranks need no sort of all rows. Ids are cut into digits; a histogram counts the
rows of each group and digit prefix, and the sums of smaller digits under the
same prefix, added up from the first digit to the last, say how many rows come
before a cell. Only inside a cell of CELL ids are rows sorted. Where rows that
repeat an id fill a cell, its histogram goes on with the digits of the leaf, and
equal leaves are one row with a count until they have their ranks.

A rank's digits to the base ``fanout`` are the path of a leaf in the trie: all that
share the longest prefix are reduced first, then the next shorter, one small
shuffle a level. Proofs go the other way: a node hands the siblings on its way
to the root down to its children, so what is shared is moved once. Digests
travel as bytes and are hashed as hex text. Functions of DataFrames only.

Defined results: a null column is hashed as ``-``; null ids come first, a null
group is a group, before all others; rows that repeat id and group are ordered by
their leaf, and equal rows are leaves one after the other; a group of one row has
its leaf as its last node; an empty table has no rows and no root; columns that
aren't named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .line_dedup import LOWER, UPPER
from .scratch import discard, keep

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
#: Bits of an id that are not counted but sorted, in a cell, and of a digit above them.
CELL_BITS, DIGIT_BITS = 12, 8
#: Distinct leaves from which a cell is counted further, and copies that one task writes out.
CROWD = 1 << 14
COPIES = 1 << 12


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts together, as bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def text_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def leaf(*values: Column) -> Column:
    def part(c: Column) -> Column:
        s = c.cast("string")
        return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))

    return digest(*[part(v) for v in values])


def offsets(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``counts`` (keys, n) with ``before``, the rows of the same first key in smaller cells, and ``total``, all its rows."""
    found = None
    for depth in range(1, len(keys)):
        level = counts.groupBy(*keys[: depth + 1]).agg(F.sum("n").alias("n"))
        inside = Window.partitionBy(*keys[:depth])
        smaller = F.coalesce(F.sum("n").over(inside.orderBy(keys[depth]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if found is None:
            found = level.select(*keys[:2], smaller.alias("before"), F.sum("n").over(inside).alias("total"))
        else:
            level = level.select(*keys[: depth + 1], smaller.alias("here"))
            found = level.join(found, keys[:depth]).select(*keys[: depth + 1], (F.col("before") + F.col("here")).alias("before"), "total")
    return found


def id_digits(bits: int) -> list[Column]:
    """Digits of ``id``, highest first, whose low bits are sorted, when ids differ in their last ``bits`` bits; null comes first."""
    ordered = F.col("id").bitwiseXOR(F.lit(-(1 << 63)))
    count = max(1, -(-(bits - CELL_BITS) // DIGIT_BITS))
    digit = lambda j: F.shiftrightunsigned(ordered, CELL_BITS + DIGIT_BITS * j).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
    return [F.coalesce(digit(j) if CELL_BITS + DIGIT_BITS * j < 64 else F.lit(0), F.lit(-1)).cast("int") for j in reversed(range(count))]


def ranked(leaves: DataFrame) -> DataFrame:
    """Distinct leaves (g, id, leaf, copies, ...) with ``rank``, the rows of their group before them, and ``total``, all its rows."""
    ends = leaves.agg(F.min("id").alias("lo"), F.max("id").alias("hi")).first()
    bits = 0 if ends.lo is None else ((ends.lo ^ ends.hi) & ((1 << 64) - 1)).bit_length()
    digits = id_digits(bits)
    cell = ["g", *(f"d{j}" for j in range(len(digits)))]
    rows = leaves.withColumns({f"d{j}": d for j, d in enumerate(digits)})
    cells = rows.groupBy(*cell).agg(F.sum("copies").alias("n"), F.count("*").alias("leaves"))
    cells = keep(cells, "cells")
    place = offsets(cells, cell)
    # In a crowded cell an id's last bits and the leaf's first ones are digits too.
    low = F.coalesce(F.col("id").bitwiseAND(F.lit((1 << CELL_BITS) - 1)), F.lit(-1)).cast("int")
    nibbles = lambda at: F.conv(F.substring(F.hex("leaf"), at, 3), 16, 10).cast("int")
    finer = {"d_id": low, "d_leaf": nibbles(1), "d_more": nibbles(4)}
    crowded = cells.where(F.col("leaves") > CROWD).select(*cell)
    if crowded.isEmpty():
        return _inside(rows.join(place, cell), cell)
    deep = rows.join(crowded, cell, "left_semi").withColumns(finer)
    part = offsets(deep.groupBy(*cell, *finer).agg(F.sum("copies").alias("n")).withColumn("cell", F.struct(*cell)).select("cell", *finer, "n"), ["cell", *finer])
    part = part.select("cell.*", *finer, F.col("before").alias("within"))
    deep = deep.join(part, [*cell, *finer]).join(place, cell).withColumn("before", F.col("before") + F.col("within")).drop("within")
    rest = rows.join(crowded, cell, "left_anti").join(place, cell)
    return _inside(rest, cell).unionByName(_inside(deep, [*cell, *finer]))


def _inside(rows: DataFrame, cell: list[str]) -> DataFrame:
    earlier = Window.partitionBy(*cell).orderBy("id", "leaf").rowsBetween(Window.unboundedPreceding, -1)
    rank = F.col("before") + F.coalesce(F.sum("copies").over(earlier), F.lit(0))
    return rows.withColumn("rank", rank).drop("before", *cell[1:])


def each_copy(rows: DataFrame) -> DataFrame:
    """One row a copy, with ranks that go on from the first's."""
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))))
    if rows.where(F.col("copies") > COPIES).limit(1).count():
        parts = parts.repartition("g", "rank", "part")
    last = F.least(F.lit(COPIES), F.col("copies") - F.col("part") * COPIES) - 1
    again = parts.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return again.withColumn("rank", F.col("rank") + F.col("part") * COPIES + F.col("nth")).drop("part", "nth", "copies")


def hexed(digests: Column) -> Column:
    """The hex texts of an array of structs with a ``digest``, joined."""
    return F.array_join(F.transform(digests, lambda k: text_of(k.digest)), "")


def grow(nodes: DataFrame, largest: int, carried: tuple[str, ...] = (), fanout: int = FANOUT) -> list[DataFrame]:
    """Runs by level (g, idx, size, kids), from nodes (g, idx, size, digest) numbered in a group of ``size``.

    A group whose ``size`` is 1 is done: its only kid is its last node and isn't
    reduced. The kids of the first level keep the ``carried`` columns.
    """
    levels = []
    while True:
        kid = F.struct(F.col("idx").alias("at"), "digest", *carried)
        runs = nodes.groupBy("g", F.expr(f"idx div {fanout}").alias("run")).agg(F.max("size").alias("size"), F.sort_array(F.collect_list(kid)).alias("kids"))
        levels.append(keep(runs.withColumnRenamed("run", "idx"), "runs"))
        if largest <= 1:
            return levels
        above = levels[-1].where("size > 1")
        nodes = above.select("g", "idx", F.expr(f"(size - 1) div {fanout} + 1").alias("size"), digest(hexed(F.col("kids"))).alias("digest"))
        largest, carried = -(-largest // fanout), ()


def last_nodes(levels: list[DataFrame]) -> DataFrame:
    """(g, digest): the node that is left of each group."""
    found = [runs.where("size = 1").select("g", F.col("kids")[0]["digest"].alias("digest")) for runs in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def handed_down(levels: list[DataFrame], last: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Each kid of the first level with its siblings up to its group's last node, then those in ``last`` (g, siblings, subroot).

    ``siblings`` is an array of (left, right), digests of the siblings on each side, from a node upwards.
    """
    above = None
    for runs in reversed(levels):
        ones = runs.where("size = 1").join(last, "g").select("g", F.col("kids")[0].alias("kid"), "siblings", "subroot")
        if above is None:
            found = ones
        else:
            many = runs.where("size > 1").join(above, ["g", "idx"]).select("*", F.posexplode("kids").alias("nth", "kid"))
            left, right = F.slice("kids", F.lit(1), F.col("nth")), F.slice("kids", F.col("nth") + 2, F.lit(fanout))
            step = F.struct(F.unhex(hexed(left)).alias("left"), F.unhex(hexed(right)).alias("right"))
            found = many.select("g", "kid", F.concat(F.array(step), "siblings").alias("siblings"), "subroot").unionByName(ones)
        above = found.select("g", F.col("kid.at").alias("idx"), "siblings", "subroot")
    return found


def numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """(``groups`` with their place in the order of ``g``, how many there are). Sorted by ranges: no task has them all."""
    placed = groups.repartitionByRange("g").sortWithinPartitions("g").withColumn("p", F.spark_partition_id())
    placed = keep(placed.withColumn("i", F.monotonically_increasing_id() - F.shiftleft(F.col("p").cast("long"), 33)), "groups")
    before, at = [], 0
    for r in placed.groupBy("p").count().orderBy("p").collect():
        before.append((r["p"], at))
        at += r["count"]
    first = F.broadcast(groups.sparkSession.createDataFrame(before, "p int, first long"))
    return placed.join(first, "p").withColumn("idx", F.col("first") + F.col("i")).drop("p", "i", "first"), at


def folded(leaf_text: Column, siblings: Column) -> Column:
    """The root that follows from a leaf and its siblings, as hex text."""
    return F.aggregate(siblings, leaf_text, lambda node, s: F.sha2(F.concat(text_of(s.left), node, text_of(s.right)), 256))


PROOFS = "doc_id long, source string, leaf string, changed string, subroot string, root string, siblings array<struct<left:binary,right:binary>>"


def proofs(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT) -> DataFrame:
    """One row a row of ``docs``: its leaf, its group's subroot, the root, and its siblings on the way there.

    ``changed`` is the leaf of the row with some columns replaced by others, null without any.
    """
    values = [F.col(c) for c in fields]
    other = leaf(*[changed.get(c, F.col(c)) for c in fields]) if changed else F.lit(None).cast("binary")
    group = F.col(group_col).cast("string")
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.when(group.isNull(), "").otherwise(F.concat(F.lit("s"), group)).alias("g"),  # nulls first, without null keys
        leaf(*values).alias("leaf"),
        other.alias("changed"),
    )
    rows = rows.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed")))
    leaves = keep(rows.groupBy("g", "id", "leaf", "changed").agg(F.count("*").alias("copies")), "leaves")
    spark = docs.sparkSession
    placed = each_copy(ranked(leaves)).select("g", F.col("rank").alias("idx"), F.col("total").alias("size"), F.col("leaf").alias("digest"), "id", "changed")
    largest = leaves.groupBy("g").agg(F.sum("copies").alias("n")).agg(F.max("n")).first()[0]
    if not largest:
        return spark.createDataFrame([], PROOFS)
    levels = grow(placed, largest, ("id", "changed"), fanout)
    discard(leaves)
    groups, n = numbered(last_nodes(levels))
    over = grow(groups.select(F.lit("").alias("g"), "idx", F.lit(n).alias("size"), "digest", F.col("g").alias("group")), n, ("group",), fanout)
    root = bytes(last_nodes(over).first().digest).hex()
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    top = spark.range(1).select(F.lit("").alias("g"), none.alias("siblings"), F.lit(b"").alias("subroot"))
    top = handed_down(over, top, fanout).select(F.col("kid.group").alias("g"), "siblings", F.col("kid.digest").alias("subroot"))
    found = handed_down(levels, top, fanout)
    return found.select(
        F.col("kid.id").alias("doc_id"),
        F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).alias("source"),
        text_of(F.col("kid.digest")).alias("leaf"),
        text_of(F.coalesce("kid.changed", "kid.digest")).alias("changed"),
        text_of(F.col("subroot")).alias("subroot"),
        F.lit(root).alias("root"),
        "siblings",
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, and the root refolded after tampering with the text of one document in five."""
    text = F.col("text")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)
    found = proofs(docs.select(*FIELDS), {"text": tampered})
    hexes = F.transform("siblings", lambda s: F.concat(text_of(s.left), text_of(s.right)))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join(hexes, ""), 256).alias("proof_sha256"), folded(F.col("changed"), F.col("siblings")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
