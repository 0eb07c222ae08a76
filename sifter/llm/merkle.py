"""Merkle manifest of a table: a tree of digests per group, stored as blocks in
van Emde Boas order, and proofs read off the blocks by address arithmetic.

Every row is a leaf, the SHA-256 of its fields.  A group's leaves ascend by the
order column; while several nodes remain, every ``FAN`` consecutive ones (the
last run: fewer, even one) become the digest of their concatenation.  What
remains is the group's subroot; the subroots, in the order of their groups
(null first, bytewise), make the root the same way.  Digests go into digests
as hex text.

A tree is cut into aligned subtrees of ``BLOCK_LEVELS`` levels above up to
``FAN ** BLOCK_LEVELS`` nodes.  Such a block is built by one task and stored as
one row whose bytes hold its nodes in van Emde Boas order: the subtree is split
at half its height, the top half comes first, then every bottom half, each
again in this order.  ``address`` finds any node from its depth and number
alone, so siblings are read without pointers.  The roots of the blocks are the
nodes of the next tier, which recurses until one block is left, and a block's
``place`` is its address in the tree of blocks, by the same arithmetic.

Scale: leaves are numbered by a range sort that ties equal keys by the rows' place
in the table, so neither a group with a third of all rows nor repeated ids meet
in one task; a block is at most 4,096 nodes.  Rounds: one per factor of 4,096.
Only the root comes to the driver.  Every tier is a written table.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sifter.llm.common import written

FAN_BITS = 4
FAN = 1 << FAN_BITS
BLOCK_LEVELS = 3
BLOCK_BITS = FAN_BITS * BLOCK_LEVELS
WIDTH = 32  # bytes of a digest


# --- address arithmetic ---------------------------------------------------------

def tree_size(height: int, bits: int) -> int:
    """Nodes of a complete tree with ``height`` levels of nodes."""
    return ((1 << bits * height) - 1) // ((1 << bits) - 1)


def address(height: int, depth: int, index, bits: int = FAN_BITS):
    """Place of the node number ``index`` (a number or an array) at ``depth``
    below the root in the van Emde Boas order of a complete tree with
    ``height`` levels of nodes and 2 ** bits children each."""
    if height == 1:
        return index * 0
    top = height // 2
    if depth < top:
        return address(top, depth, index, bits)
    bottom = height - top
    below = bits * (depth - top)  # bits of the number inside its bottom tree
    inner = index & ((1 << below) - 1)
    return tree_size(top, bits) + (index >> below) * tree_size(bottom, bits) + address(bottom, depth - top, inner, bits)


@functools.cache
def _addresses(height: int) -> tuple[np.ndarray, ...]:
    """Addresses of all nodes, level by level from the lowest."""
    return tuple(address(height, d, np.arange(1 << FAN_BITS * d)) for d in reversed(range(height)))


def tree_levels(n: int, bits: int = FAN_BITS) -> int:
    """Levels above n nodes until one is left."""
    return 0 if n <= 1 else -(-(n - 1).bit_length() // bits)


# --- digests ----------------------------------------------------------------------

def field_text(c: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, colon, value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    """32 bytes: the SHA-256 of the fields' texts, one after the other."""
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in fields]).cast("binary"), 256))


def _hash(nodes: bytes) -> bytes:
    return hashlib.sha256(nodes.hex().encode()).digest()


def block_nodes(nodes: bytes, levels: int) -> bytes:
    """The nodes of a block over the given lowest ones, in van Emde Boas order
    (missing ones are zero)."""
    out = np.zeros((tree_size(levels + 1, FAN_BITS), WIDTH), np.uint8)
    for at in _addresses(levels + 1):
        row = np.frombuffer(nodes, np.uint8).reshape(-1, WIDTH)
        out[at[:len(row)]] = row
        if len(row) == 1 and len(at) == 1:
            break
        nodes = b"".join(_hash(nodes[i:i + FAN * WIDTH]) for i in range(0, len(nodes), FAN * WIDTH))
    return out.tobytes()


def block_rows(block: bytes, levels: int, n: int) -> list[bytes]:
    """The levels of a block over n nodes, lowest first."""
    every = np.frombuffer(block, np.uint8).reshape(-1, WIDTH)
    out = []
    for at in _addresses(levels + 1):
        out.append(every[at[:n]].tobytes())
        n = -(-n // FAN)
    return out


@dataclass(frozen=True)
class Step:
    """One level of a proof: the run's siblings before and after the node."""

    before: bytes
    after: bytes

    def packed(self) -> bytes:
        return bytes([len(self.before) // WIDTH, len(self.after) // WIDTH]) + self.before + self.after


def unpacked(path: bytes) -> list[Step]:
    out, at = [], 0
    while at < len(path):
        cut = at + 2 + path[at] * WIDTH
        end = cut + path[at + 1] * WIDTH
        out.append(Step(path[at + 2:cut], path[cut:end]))
        at = end
    return out


def _step(level: bytes, index: int) -> Step:
    run = index // FAN * FAN * WIDTH
    own = index * WIDTH
    return Step(level[run:own], level[own + WIDTH:run + FAN * WIDTH])


def paths(rows: list[bytes], outer: list[Step]) -> list[list[Step]]:
    """The steps from each lowest node of a block to the root of all."""
    above = [outer]
    for level in reversed(rows[:-1]):
        above = [[_step(level, i), *above[i // FAN]] for i in range(len(level) // WIDTH)]
    return above


def folded(leaf: bytes, path: list[Step]) -> bytes:
    """The root that a leaf and the siblings of its path give."""
    for s in path:
        leaf = _hash(s.before + leaf + s.after)
    return leaf


# --- numbering ----------------------------------------------------------------------

def numbered(rows: DataFrame, tag: str) -> DataFrame:
    """Rows (g, k, ...) with ``pos``, the place in group g by k, and ``n``, the
    group's rows.  Rows that tie keep the order of the table.  The sorted rows are
    written once, and counts per (group, sorted piece) give the offsets."""
    keys = [F.col("g").asc_nulls_first(), F.col("k").asc_nulls_first(), "tie"]
    placed = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(placed.drop("tie").withColumn("at", F.monotonically_increasing_id()), tag)
    placed = placed.withColumn("piece", F.shiftright("at", 33))
    pieces = placed.groupBy("g", "piece").agg(F.min("at").alias("start"), F.count("*").alias("c"))
    group = Window.partitionBy("g")  # one row per piece of the group
    before = F.coalesce(F.sum("c").over(group.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.select(F.col("g").alias("pg"), F.col("piece").alias("pp"), (before - F.col("start")).alias("shift"), F.sum("c").over(group).alias("n"))
    pieces = written(pieces, f"{tag}-pieces")  # its size is known, so Spark decides whether to broadcast it
    joined = placed.join(pieces, F.col("g").eqNullSafe(F.col("pg")) & (F.col("piece") == F.col("pp")))
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("pg", "pp", "piece", "shift", "at", "k")


# --- building ------------------------------------------------------------------------

_TIER = pa.schema([("g", pa.string()), ("block", pa.int64()), ("n_nodes", pa.int64()), ("n_blocks", pa.int64()),
                   ("levels", pa.int32()), ("nodes", pa.binary()), ("root", pa.binary())])
_TIER_DDL = "g string, block long, n_nodes long, n_blocks long, levels int, nodes binary, root binary"


def _build_block(table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    n, pos = table["n"][0].as_py(), table["pos"][0].as_py()
    levels = min(BLOCK_LEVELS, tree_levels(n))
    nodes = block_nodes(b"".join(table["digest"].to_pylist()), levels)
    return pa.Table.from_pylist([{
        "g": table["g"][0].as_py(), "block": pos >> BLOCK_BITS, "n_nodes": table.num_rows, "n_blocks": -(-n >> BLOCK_BITS),
        "levels": levels, "nodes": nodes, "root": nodes[:WIDTH]}], _TIER)


def grow(nodes: DataFrame, tag: str) -> list[DataFrame]:
    """The tiers of blocks over nodes (g, pos, n, digest), lowest first."""
    tiers = []
    while True:
        nodes = nodes.select("g", "pos", "n", "digest", F.shiftright("pos", BLOCK_BITS).alias("block"))
        tier = written(nodes.groupBy("g", "block").applyInArrow(_build_block, _TIER_DDL), f"{tag}{len(tiers)}")
        tiers.append(tier)
        rest = tier.where("n_blocks > 1")
        if rest.isEmpty():
            return tiers
        nodes = rest.select("g", F.col("block").alias("pos"), F.col("n_blocks").alias("n"), F.col("root").alias("digest"))


def _tops(tiers: list[DataFrame]) -> DataFrame:
    """(g, root) of every group: the root of its last block."""
    every = [t.where("n_blocks = 1").select("g", "root") for t in tiers]
    return functools.reduce(DataFrame.unionByName, every)


def _place(height: pa.Array, tier: pa.Array, block: pa.Array) -> pa.Array:
    """Address of a block in its group's tree of blocks."""
    h, k, b = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (height, tier, block))
    out = np.zeros(len(b), np.int64)
    for x in np.unique(h):
        for t in np.unique(k[h == x]):
            on = (h == x) & (k == t)
            out[on] = address(int(x), int(x - 1 - t), b[on], BLOCK_BITS)
    return pa.array(out)


@dataclass
class Manifest:
    """``leaves`` (g, id, digest, changed, pos, n), the tiers of the groups'
    trees, the numbered subroots, the tiers above them, and the root (32 bytes,
    None for an empty table)."""

    leaves: DataFrame
    tiers: list[DataFrame]
    subroots: DataFrame
    top: list[DataFrame]
    root: bytes | None

    def blocks(self) -> DataFrame:
        """All blocks as one table: tree (``group`` or ``root``), g, tier,
        place (address in the group's tree of blocks), block, n_nodes, levels,
        nodes.  This is the manifest to store; sort by g, place to lay the blocks
        out in van Emde Boas order too."""
        out = []
        for tree, tiers in (("group", self.tiers), ("root", self.top)):
            n_tiers = functools.reduce(DataFrame.unionByName, [
                t.where("n_blocks = 1").select(F.col("g").alias("tg"), F.lit(k + 1).alias("height")) for k, t in enumerate(tiers)])
            for k, t in enumerate(tiers):
                t = t.join(n_tiers, F.col("g").eqNullSafe(F.col("tg"))).drop("tg")
                out.append(t.select(F.lit(tree).alias("tree"), "g", F.lit(k).alias("tier"), F.arrow_udf(_place, "long")("height", F.lit(k), "block").alias("place"), "block", "n_nodes", "levels", "nodes"))
        return functools.reduce(DataFrame.unionByName, out)


def build(docs: DataFrame, fields: list[str], *, group_col: str, order_col: str, changed: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``.

    ``fields`` are hashed in the order given (null: ``-``; an empty text is a value).
    A null group is a group of its own, the first one; null ids come first.
    Rows with one id are leaves in the order of the table.  ``changed`` gives
    other values of some fields: the digest of the row so changed is kept
    beside each leaf, for ``proofs`` to test.  Other columns don't matter,
    whatever their names.  An empty table has no root.
    """
    now = [F.col(f"`{c}`") for c in fields]
    other = [(changed or {}).get(c, F.col(f"`{c}`")) for c in fields]
    leaf = leaf_digest(*now)
    rows = docs.select(F.col(f"`{group_col}`").cast("string").alias("g"), F.col(f"`{order_col}`").alias("k"), F.col(f"`{order_col}`").alias("id"),
                       leaf.alias("digest"), (leaf_digest(*other) if changed else leaf).alias("changed"))
    leaves = numbered(rows, "leaves")
    tiers = grow(leaves, "tier")
    subroots = _tops(tiers).select(F.lit("").alias("g"), F.col("g").alias("k"), F.col("g").alias("group"), F.col("root").alias("digest"))
    subroots = written(numbered(subroots, "subroots"), "subroots")
    top = grow(subroots, "top")
    root = _tops(top).first()
    return Manifest(leaves, tiers, subroots, top, bytes(root["root"]) if root else None)


# --- proofs ------------------------------------------------------------------------------

_PATHS = pa.schema([("g", pa.string()), ("pos", pa.int64()), ("path", pa.binary()), ("subroot", pa.binary())])


def _children(batches):
    """Paths of all nodes of blocks that know the path of their own root."""
    for batch in batches:
        for r in batch.to_pylist():
            first, outer = r["block"] << BLOCK_BITS, unpacked(r["path"])
            rows = block_rows(r["nodes"], r["levels"], r["n_nodes"])
            yield pa.RecordBatch.from_pylist([
                {"g": r["g"], "pos": first + i, "path": b"".join(s.packed() for s in p), "subroot": r["subroot"]}
                for i, p in enumerate(paths(rows, outer))], _PATHS)


def _with_outer(tier: DataFrame, outer: DataFrame) -> DataFrame:
    """Blocks of a tier with the path of their root; outer: (og, pos, path, subroot)."""
    outer = outer.select(F.col("g").alias("og"), "pos", "path", "subroot")
    on = F.col("g").eqNullSafe(F.col("og")) & (F.col("block") == F.col("pos"))
    return tier.join(outer, on).select("g", "block", "n_nodes", "levels", "nodes", "path", "subroot")


def _descend(tiers: list[DataFrame], roots: DataFrame, tag: str) -> DataFrame:
    """The lowest blocks with the paths of their roots.  ``roots`` (g, path,
    subroot) are the paths of the groups' last blocks."""
    outer = None
    for k in reversed(range(len(tiers))):
        own = tiers[k].where("n_blocks = 1").select(F.col("g").alias("tg")).join(roots, F.col("g").eqNullSafe(F.col("tg")))
        own = own.select("g", F.lit(0).cast("long").alias("pos"), "path", "subroot")
        outer = own if outer is None else own.unionByName(outer)
        blocks = _with_outer(tiers[k], outer)
        if k:
            outer = written(blocks.mapInArrow(_children, "g string, pos long, path binary, subroot binary"), tag)
    return blocks


def _prove(siblings: bool):
    kind = [("digest", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded", pa.string())]
    kind += [("siblings", pa.list_(pa.string()))] * siblings

    def prove(leaves: pa.Table, blocks: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        block = blocks.to_pylist()[0]
        steps = paths(block_rows(block["nodes"], block["levels"], block["n_nodes"]), unpacked(block["path"]))
        upper: dict[int, bytes] = {}  # what a run shares: the hex text of the steps after its first
        out = []
        for i, (digest, changed, path) in enumerate(zip(leaves["digest"].to_pylist(), leaves["changed"].to_pylist(), steps)):
            own = path[:1] if block["levels"] else []
            rest = path[len(own):]
            if i // FAN not in upper:
                upper = {i // FAN: b"".join(s.before + s.after for s in rest).hex().encode()}
            near = b"".join(s.before + s.after for s in own).hex().encode()
            row = {"digest": digest.hex(), "subroot": block["subroot"].hex(), "folded": folded(changed, path).hex(),
                   "proof_sha256": hashlib.sha256(near + upper[i // FAN]).hexdigest()}
            if siblings:
                whole = near.decode() + upper[i // FAN].decode()
                row["siblings"] = [whole[k:k + 2 * WIDTH] for k in range(0, len(whole), 2 * WIDTH)]
            out.append(row)
        made = pa.Table.from_pylist(out, pa.schema(kind))
        return made.append_column("id", leaves["id"]).append_column("g", leaves["g"])

    return prove


def proofs(m: Manifest, *, siblings: bool = False) -> DataFrame:
    """Per leaf: id, g, digest, subroot, root, proof_sha256 (of the siblings'
    hex texts, level by level via the subroot to the root, left to right) and
    folded, the root recomputed from the changed digest and the siblings.  With
    ``siblings`` also their list.  No rows for an empty table."""
    fields = {f.name: f.dataType.simpleString() for f in m.leaves.schema.fields}
    ddl = f"digest string, subroot string, proof_sha256 string, folded string{', siblings array<string>' * siblings}, id {fields['id']}, g string"
    start = _tops(m.top).select("g", F.lit(b"").alias("path"), F.col("root").alias("subroot"))
    above = _descend(m.top, start, "top-paths").mapInArrow(_children, "g string, pos long, path binary, subroot binary")
    roots = written(m.subroots.join(above.select("pos", "path"), "pos").select(
        F.col("group").alias("g"), "path", F.col("digest").alias("subroot")), "group-paths")
    blocks = _descend(m.tiers, roots, "paths")
    leaves = m.leaves.select("g", "id", "pos", "digest", "changed", F.shiftright("pos", BLOCK_BITS).alias("block"))
    found = leaves.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(_prove(siblings), ddl)
    return found.withColumn("root", F.lit(m.root.hex() if m.root else None).cast("string"))

