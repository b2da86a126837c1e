"""Merkle manifest of a table: digests of rows, trees of a fixed fan-out by group, one root over the groups.

``H`` is the lowercase hex SHA-256 of its concatenated inputs, digests taken as hex text.  A row's leaf is the H of its
columns, ``-`` for a null, else UTF-8 byte count, ``:``, value.  Per group the leaves ascend by their key, and every
``fanout`` consecutive nodes of a level become their H, until one remains; the groups' last nodes, in the order of the
groups (null first, then bytewise), form the upper tree, whose last node is the root.

Going up, every level is joined with itself: a node in slot zero computes the places of its siblings (its place XOR 1 for a
binary tree, place and slot offsets otherwise), meets them in an equijoin on (group, place), and emits the parent.  A key of
that join is one node, so a group that holds a third of all rows is dealt as evenly as any other.  (Only slot-zero nodes ask:
the run that such a node brings together is also the sibling list of each of its members.)

Going down, a run meets its parent's path, one row a parent; paths are spread to leaves only inside the last run, so what is
shuffled for proofs is a path for ``fanout`` rows.  The number of levels is the logarithm of the largest group, the only
figure that the driver reads.

Defined cases: a null column is ``-``; a null group is a group of its own, the first; null keys come first in a group; rows
with equal keys are ordered by their digests, rows that repeat are leaves each; an empty table has no rows, so no root; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.ordering import row_number_within
from quire.session import cut_lineage

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
SIZE = 32                 # bytes of a digest


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def node_of(hex_text: Column) -> Column:
    """H of text, as bytes."""
    return F.unhex(F.sha2(hex_text, 256))


def encoded(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return node_of(F.concat(*(encoded(v) for v in values)))


def leaves(docs: DataFrame, group: str = "source", key: str = "doc_id", columns: Sequence[str] = COLUMNS,
           changed: dict[str, Column] | None = None) -> DataFrame:
    """``grp`` (bytewise ordered as the groups, null first), ``key``, ``leaf``, and ``other``: the leaf with ``changed`` columns."""
    now = changed or {}
    return docs.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(key).alias("key"),
                       leaf_of(*(F.col(c) for c in columns)).alias("leaf"),
                       leaf_of(*(now.get(c, F.col(c)) for c in columns)).alias("other"))


def sibling_places(place: Column, fanout: int) -> Column:
    """The places of the other nodes of a run, also those beyond the level's end."""
    if fanout == 2:
        return F.array(place.bitwiseXOR(F.lit(1).cast("long")))
    slot = F.pmod(place, F.lit(fanout).cast("long"))
    return F.transform(F.sequence(F.lit(1).cast("long"), F.lit(fanout - 1).cast("long")),
                       lambda shift: place - slot + F.pmod(slot + shift, F.lit(fanout).cast("long")))


def run_up(nodes: DataFrame, fanout: int) -> DataFrame:
    """One row a run of ``nodes`` (grp, place, n, digest, more): the parent's ``grp, place, n, digest``, the run's digests as
    one value (``run``) and what else its members carry (``members``)."""
    asks = nodes.filter((F.pmod("place", F.lit(fanout)) == 0) & (F.col("n") > 1))
    asked = asks.select("grp", F.col("place").alias("head"), F.explode(sibling_places(F.col("place"), fanout)).alias("place"))
    carried = F.struct("place", "digest", "more").alias("member")
    met = (asked.join(nodes, ["grp", "place"]).select("grp", "head", "n", carried)
           .unionByName(asks.select("grp", F.col("place").alias("head"), "n", carried)))
    runs = met.groupBy("grp", "head", "n").agg(F.sort_array(F.collect_list("member")).alias("members"))   # fanout members at most
    runs = runs.withColumn("text", F.concat_ws("", F.transform("members", lambda m: text_of(m["digest"]))))
    return runs.select("grp", F.expr(f"head div {fanout}").alias("place"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
                       node_of(F.col("text")).alias("digest"), F.unhex("text").alias("run"), F.col("members.more").alias("members"))


def levels_of(n: int, fanout: int) -> int:
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def grow(nodes: DataFrame, fanout: int) -> list[DataFrame]:
    """The runs of every level, from the leaves upwards (written at each level)."""
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    out = []
    for _ in range(levels_of(most, fanout)):
        out.append(cut_lineage(run_up(nodes, fanout)))
        nodes = out[-1].select("grp", "place", "n", "digest", F.lit(None).cast("int").alias("more"))
    return out


def tops(nodes: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """``grp, digest, level``: each group's last node."""
    last = nodes.filter("n = 1").select("grp", "digest", F.lit(0).alias("level"))
    for i, r in enumerate(runs):
        last = last.unionByName(r.filter("n = 1").select("grp", "digest", F.lit(i + 1).alias("level")))
    return last


STEP = "struct<slot: int, run: binary>"


def spread(runs: list[DataFrame], starts: DataFrame, nodes: DataFrame, fanout: int) -> DataFrame:
    """Paths of the leaves: ``grp, place, digest, more`` of each leaf, the columns of ``starts`` (grp, level, path and others:
    the way from a group's last node to the root), and ``path``: slot and run of each level, from the leaf to the root."""
    others = [c for c in starts.columns if c not in ("grp", "level", "path")]
    if not runs:
        return nodes.join(starts, "grp").select("grp", "place", "digest", "more", "path", *others)
    here = None
    for level in range(len(runs), 0, -1):
        begin = starts.filter(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("place"), "path", *others)
        here = begin if here is None else here.unionByName(begin)
        met = runs[level - 1].select("grp", "place", "run", "members").join(here, ["grp", "place"])
        kids = met.select("*", F.posexplode("members").alias("slot", "more"))
        here = kids.select("grp", (F.col("place") * fanout + F.col("slot")).alias("place"),
                           F.concat(F.array(F.struct("slot", "run").cast(STEP)), F.col("path")).alias("path"), *others,
                           F.col("run").substr(F.col("slot") * SIZE + 1, F.lit(SIZE)).alias("digest"), "more")
        if level > 1:
            here = here.drop("digest", "more")
    lone = nodes.filter("n = 1").select("grp", "place", "digest", "more").join(starts.drop("level"), "grp")
    return here.unionByName(lone.select(*here.columns))


def proof_text(path: Column) -> Column:
    """The siblings' digests along a path, level by level, left to right."""
    def others(step: Column) -> Column:
        return text_of(F.concat(step["run"].substr(F.lit(1), step["slot"] * SIZE), step["run"].substr(step["slot"] * SIZE + SIZE + 1, F.octet_length(step["run"]))))
    return F.concat_ws("", F.transform(path, others))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    def up(here: Column, step: Column) -> Column:
        run, slot = step["run"], step["slot"]
        return node_of(text_of(F.concat(run.substr(F.lit(1), slot * SIZE), here, run.substr(slot * SIZE + SIZE + 1, F.octet_length(run)))))
    return F.aggregate(path, leaf, up)


def manifest(rows: DataFrame, fanout: int = 16) -> DataFrame:
    """``key, other, leaf, subroot, root, path`` of every row of ``leaves()``: the digests as bytes, the path from leaf to root."""
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    rows = cut_lineage(rows.select("grp", "key", "leaf", "other"))
    placed = row_number_within(rows, ["grp"], [F.col("key").asc_nulls_first(), F.col("leaf")], "row_no", kind="long")
    counts = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    nodes = cut_lineage(placed.join(counts, "grp").select(
        "grp", (F.col("row_no") - 1).alias("place"), "n", F.col("leaf").alias("digest"), F.struct("key", "other").alias("more")))
    runs = grow(nodes, fanout)
    groups = cut_lineage(tops(nodes, runs))

    # the upper tree: the groups' last nodes in the order of the groups are the leaves of one group
    few = row_number_within(groups.withColumn("all", F.lit("")), ["all"], [F.col("grp")], "row_no", kind="long")
    upper = cut_lineage(few.select(F.col("all").alias("grp"), (F.col("row_no") - 1).alias("place"), F.lit(groups.count()).alias("n"), "digest",
                                   F.struct(F.col("grp").alias("name"), "level").alias("more")))
    above = grow(upper, fanout)
    root = tops(upper, above).select("grp", "level", F.col("digest").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    starts = spread(above, root, upper, fanout).select(F.col("more.name").alias("grp"), "more.level", "path", "root",
                                                       F.col("digest").alias("subroot"))
    out = spread(runs, cut_lineage(starts), nodes, fanout)
    return out.select("more.key", "more.other", F.col("digest").alias("leaf"), "subroot", "root", "path")
