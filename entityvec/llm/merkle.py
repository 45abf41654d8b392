"""Merkle manifest of a table: leaves, a tree for each source, a tree over the sources, proofs.

The digests of every 16 consecutive nodes are hashed to their parent. A node's place gives the
block of 16 ** 3 nodes that it belongs to; a task holds one block, of three levels, at a time. Going up, blocks
give the next nodes; going down, each block gets the path from its root to that of the whole tree. A proof is
folded with SHA midstates: while a parent is hashed, the state before each child slot is
copied, so a replaced child takes up the state of its slot and hashes itself and what is to its right only.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entityvec.functions.scratch import written
from entityvec.llm.decontaminate import _LOWER, _UPPER

#: Children of a node, and levels that one task works on together.
FAN, LEVELS = 16, 3
BLOCK = FAN ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_HEX = 64


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each as ``-`` if null, else its length in bytes, ``:`` and itself."""
    def coded(c: Column) -> Column:
        c = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*map(coded, fields)), 256)


def _placed(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``nodes`` with their place ``pos`` from 0 in their group, and its size ``n``.

    A global sort deals rows evenly, also those of a hot group; rows number themselves in their
    partition, and the counts of the partitions before are added.
    """
    keys = [group, *order, "_tie"]
    tied = nodes.withColumn("_tie", F.monotonically_increasing_id())
    rows = written(tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
                   .withColumn("_at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    parts = written(rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "parts")
    # At most one row of a group for each partition of the sort.
    same = Window.partitionBy(group)
    places = parts.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", F.sum("_n").over(same).alias("n"),
        (F.sum("_n").over(same.orderBy("_part")) - F.col("_n")).alias("_before"))
    return (rows.join(places, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
            .withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_part", "_g", "_p", "_first", "_before"))


def height(n: int) -> int:
    """Levels above the leaves of a tree with ``n`` of them."""
    levels = 0
    while FAN ** levels < n:
        levels += 1
    return levels


class Tree:
    """Up to three levels over a block's digests (hex, as bytes), with the states before each child."""

    def __init__(self, digests: list[bytes], levels: int):
        self.levels: list[list[tuple[bytes, list]]] = []
        for _ in range(levels):
            parents, above = [], []
            for at in range(0, len(digests), FAN):
                run, state, states = digests[at:at + FAN], hashlib.sha256(), []
                for child in run:
                    states.append(state.copy())
                    state.update(child)
                parents.append((b"".join(run), states))
                above.append(state.hexdigest().encode())
            self.levels.append(parents)
            digests = above
        self.root = digests[0]

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        """(left, right) siblings of a node, level by level."""
        out = []
        for parents in self.levels:
            run, slot = parents[at // FAN][0], at % FAN * _HEX
            out.append((run[:slot], run[slot + _HEX:]))
            at //= FAN
        return out

    def fold(self, at: int, digest: bytes) -> bytes:
        """Digest of the block's root with node ``at`` replaced."""
        for parents in self.levels:
            run, states = parents[at // FAN]
            state = states[at % FAN].copy()
            state.update(digest)
            state.update(run[(at % FAN + 1) * _HEX:])
            digest = state.hexdigest().encode()
            at //= FAN
        return digest


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """((group, block), columns) of rows that come sorted by group, block and place."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        keys = list(zip(columns["g"], columns["block"]))
        start = 0
        for end in range(1, len(keys) + 1):
            if end < len(keys) and keys[end] == keys[start]:
                continue
            part = {name: values[start:end] for name, values in columns.items()}
            if held is not None and key == keys[start]:
                for name, values in part.items():
                    held[name] += values
            else:
                if held is not None:
                    yield key, held
                key, held = keys[start], part
            start = end
    if held is not None:
        yield key, held


def _levels(n: int, done: int) -> int:
    return max(0, min(LEVELS, height(n) - done))


def _climber(done: int):
    """Blocks to their root digests; ``done`` levels lie below."""
    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (group, block), rows in _blocks(batches):
            tree = Tree([d.encode() for d in rows["digest"]], _levels(rows["n"][0], done))
            out.append((group, block, rows["n"][0], tree.root.decode()))
            if len(out) == BLOCK:
                yield _batch(out)
                out = []
        yield _batch(out)

    def _batch(rows):
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                          names=["g", "pos", "n", "digest"])
    return climb


PATH = "array<struct<left:string,right:string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _texts(path: list[tuple[bytes, bytes]]) -> list[dict]:
    return [{"left": a.decode(), "right": b.decode()} for a, b in path]


def _sorted_blocks(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Each block's path in front of its nodes."""
    rest = [c for c in nodes.columns if c not in ("g", "pos", "n", "digest")]
    own = nodes.select("g", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest", *rest,
                       F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"),
                       F.lit(None).cast("string").alias("root"))
    heads = paths.select("g", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
                         F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("string").alias("digest"),
                         *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in rest], "path", "subroot", "root")
    return own.union(heads).repartition("g", "block").sortWithinPartitions("g", "block", "pos")


def _descender(done: int):
    """Blocks with the path of their root to the paths of their nodes."""
    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group, block), rows in _blocks(batches):
            above = [(p["left"].encode(), p["right"].encode()) for p in rows["path"][0]]
            tree = Tree([d.encode() for d in rows["digest"][1:]], _levels(rows["n"][1], done))
            count = len(rows["pos"]) - 1
            # A path has 1 KB for each level; a batch holds a few hundred.
            for start in range(0, count, 256):
                some = range(start, min(count, start + 256))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([group] * len(some), pa.string()), pa.array([rows["pos"][1 + i] for i in some], pa.int64()),
                     pa.array([_texts(tree.path(i) + above) for i in some], _PATH),
                     pa.array([rows["subroot"][0]] * len(some), pa.string()), pa.array([rows["root"][0]] * len(some), pa.string())],
                    names=["g", "pos", "path", "subroot", "root"])
    return descend


def _folder(proofs: bool):
    """Blocks of leaves with the path of their root to proofs and folded roots."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _), rows in _blocks(batches):
            above = [(p["left"].encode(), p["right"].encode()) for p in rows["path"][0]]
            # Upper parents have one open slot each: the state before it is hashed once for the block.
            states = [hashlib.sha256(left) for left, _ in above]
            upper = b"".join(left + right for left, right in above)
            leaves = [d.encode() for d in rows["digest"][1:]]
            tree = Tree(leaves, _levels(rows["n"][1], 0))
            proof_hashes, folded, paths = [], [], []
            for i, own in enumerate(leaves):
                path = tree.path(i)
                proof = hashlib.sha256(b"".join(left + right for left, right in path))
                proof.update(upper)
                proof_hashes.append(proof.hexdigest())
                changed = rows["changed"][1 + i]
                digest = tree.fold(i, own if changed is None else changed.encode())
                for before, (_, right) in zip(states, above):
                    state = before.copy()
                    state.update(digest)
                    state.update(right)
                    digest = state.hexdigest().encode()
                folded.append(digest.decode())
                if proofs:
                    paths.append(path + above)
            step = 256 if proofs else BLOCK
            for a in range(0, len(leaves), step):
                b = min(len(leaves), a + step)
                columns = [pa.array(rows["doc_id"][1 + a:1 + b], pa.int64()), pa.array(rows["digest"][1 + a:1 + b], pa.string()),
                           pa.array([rows["subroot"][0]] * (b - a), pa.string()), pa.array([rows["root"][0]] * (b - a), pa.string()),
                           pa.array(proof_hashes[a:b]), pa.array(folded[a:b])]
                names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]
                if proofs:
                    columns.append(pa.array([_texts(p) for p in paths[a:b]], _PATH))
                    names.append("proof")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return fold


def _grown(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """Tables of nodes every three levels, the last one with the roots of the groups."""
    tables = [nodes]
    for done in range(0, max(levels, 1), LEVELS):
        blocks = (tables[-1].select("g", F.floor(F.col("pos") / BLOCK).alias("block"), "pos", "n", "digest")
                  .repartition("g", "block").sortWithinPartitions("g", "block", "pos"))
        tables.append(written(blocks.mapInArrow(_climber(done), "g string, pos bigint, n bigint, digest string"), "nodes"))
    return tables


def _paths_down(tables: list[DataFrame], paths: DataFrame, stop: int) -> DataFrame:
    """Paths of the nodes of ``tables[stop]``, from those of the roots."""
    for round_ in range(len(tables) - 2, stop - 1, -1):
        made = _sorted_blocks(tables[round_], paths).mapInArrow(
            _descender(round_ * LEVELS), f"g string, pos bigint, path {PATH}, subroot string, root string")
        paths = written(made, "paths")
    return paths


def manifest(docs: DataFrame, changed: Column | None = None, proofs: bool = False) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root for every row of ``docs``.

    ``docs`` has doc_id, source, lang, n_chars and text. A leaf is the digest of these fields; the leaves of a source
    are ordered by doc_id (null first), the roots of the sources by source (null first, by bytes). ``changed``
    is a column with the digest of a replaced leaf, null for leaves left as they are: ``folded_root``
    is what the root becomes if this leaf alone is replaced. ``proof_sha256`` is of all siblings
    concatenated, from the leaf to the root; with ``proofs`` they are in column proof, a (left, right) pair for each level.

    Nulls in any column are part of the leaf, an empty text differs from a null one. Texts are hashed where they are
    read, however long, and never shuffled. Ties of doc_id are ordered by leaf; repeated rows are leaves of
    their own, next to each other. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    fields = [F.col(f"`{c}`") for c in FIELDS]
    leaves = docs.select(
        fields[0].cast("bigint").alias("doc_id"), fields[1].cast("string").alias("g"), leaf(*fields).alias("digest"),
        (F.lit(None).cast("string") if changed is None else changed).alias("changed"))
    placed = written(_placed(leaves, "g", ["doc_id", "digest"]), "leaves")
    levels = height(placed.agg(F.max("n")).first()[0] or 0)
    tables = _grown(placed, levels)
    # The sources' roots are the leaves of the upper tree, a single group.
    tops = tables[-1].select(F.lit("").alias("one"), "g", "digest").drop("n", "pos")
    sources = written(_placed(tops, "one", ["g"]).select(F.col("one").alias("g"), "pos", "n", "digest", F.col("g").alias("source")), "sources")
    upper = _grown(sources.drop("source"), height(sources.count()))
    root = upper[-1].select("g", "pos", F.array().cast(PATH).alias("path"),
                            F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    down = _paths_down(upper, root, 0)
    heads = sources.join(down.select("pos", "path", "root"), "pos").select(
        F.col("source").alias("g"), F.lit(0).cast("bigint").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    down = _paths_down(tables, written(heads, "paths"), 1)
    schema = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return _sorted_blocks(placed.select("g", "pos", "n", "digest", "doc_id", "changed"), down).mapInArrow(
        _folder(proofs), schema + (f", proof {PATH}" if proofs else ""))


def every_fifth_lowered() -> Column:
    """Leaf with A-Z of the text lower-cased where 5 divides crc32 of doc_id; null elsewhere and without doc_id."""
    drawn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(drawn, leaf(*[F.col(c) for c in FIELDS[:-1]], F.translate(F.col("text").cast("string"), _UPPER, _LOWER)))


def verified(docs: DataFrame) -> DataFrame:
    """The manifest with tampered leaves folded in, and whether each root came out as it was."""
    return manifest(docs, every_fifth_lowered()).withColumn("verified", F.col("folded_root") == F.col("root"))
