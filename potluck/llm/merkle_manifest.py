"""Merkle manifest of a table with proofs by pointer jumping.

Each row is a leaf: the sha256 of its fields, each as ``-`` if null, else its UTF-8 byte
count, ``:`` and the value. The leaves of a group ascend by id; every ``FAN`` consecutive
nodes (the last run may be shorter, even one) become the sha256 of their concatenated hex
digests, until one remains, the group's subroot. The subroots, ordered by group (null first,
else by UTF-8 bytes), give the root in the same way.

Proofs: every node holds a segment, the digests of its siblings on the left and on the right,
and a pointer to its parent. A round joins the nodes with themselves: a node appends the
segment of the node that it points to and takes over its pointer, so that distances double,
until every leaf's pointer has passed the root. A node at distance d has at most FAN ** d
leaves below it, so that no join key is hot while d is small; and the number of nodes that can
be pointed to at distance d is known beforehand from the sizes of the groups, so that they are
broadcast where, and only where, they fit into ``BROADCAST_BYTES``.

Leaves are placed by ``operators.ranking``: ranges, counts of ranges, offsets; no task holds
a whole group. Levels are written tables, each an eighth of the one before.

Defined cases: rows without an id come first; rows that share an id are ordered by their
leaf digests (equal leaves take any of their places); a null or empty field differs from
every other value; an empty table gives an empty manifest without a root; a group of one row
is its own subroot, a single subroot the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from potluck.llm.common import checkpointed
from potluck.operators.ranking import ranked

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
FAN = 8
BROADCAST_BYTES = 512 << 10
DIGEST_CHARS = 64


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the concatenated parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(c) for c in fields])


def fold(start: Column, proof: Column) -> Column:
    """The digest that ``start`` and the siblings of ``proof`` lead to."""
    return F.aggregate(proof, start, lambda below, run: digest(run["left"], below, run["right"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda run: F.array(run["left"], run["right"]))), ""), 256)


def _height(n: int) -> int:
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _grow(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level, and the node that remains of each tree.

    ``nodes``: tree, idx, hash, n (nodes of the tree on this level), held (any payload).
    Runs: tree, n, parent, kids (idx, hash, held; in order), hash."""
    runs, tops = [], []
    for _ in range(levels):
        tops.append(nodes.where("n = 1").select("tree", "hash"))
        kids = F.array_sort(F.collect_list(F.struct("idx", "hash", "held")))
        run = (nodes.where("n > 1").groupBy("tree", "n", F.expr(f"idx div {FAN}").alias("parent")).agg(kids.alias("kids"))
               .withColumn("hash", F.sha2(F.array_join("kids.hash", ""), 256)))
        runs.append(checkpointed(run, "merkle-runs"))
        nodes = runs[-1].select("tree", F.col("parent").alias("idx"), "hash", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"),
                                F.lit(None).cast("string").alias("held"))
    tops.append(nodes.where("n = 1").select("tree", "hash"))
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return runs, out


def _key(tree: Column, level: int, idx: Column) -> Column:
    return F.struct(tree.alias("tree"), F.lit(level).alias("level"), idx.cast("long").alias("idx"))


def _top_key(tree: Column) -> Column:
    return _key(tree, -1, F.lit(0))


def _places(runs: DataFrame, level: int, last: Column) -> DataFrame:
    """The nodes of a level with their pointers (``last`` where the run is the tree's only
    one) and segments of one step."""
    each = runs.select("tree", "n", "parent", "kids.hash", F.posexplode("kids").alias("i", "kid"))
    side = lambda at, count: F.array_join(F.slice("hash", at, count), "")
    run = F.struct(side(F.lit(1), F.col("i")).alias("left"), side(F.col("i") + 2, F.lit(FAN)).alias("right"))
    pointer = F.when(F.col("n") <= FAN, last).otherwise(_key(F.col("tree"), level + 1, F.col("parent")))
    return each.select(_key(F.col("tree"), level, F.col("kid.idx")).alias("key"), pointer.alias("pointer"),
                       F.array(run).alias("proof"), "kid.held", F.col("kid.hash").alias("node"))


def merkle_manifest(docs: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang",
                    carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``grp``, position, leaf, subroot, root, proof
    (array of (left, right), from the leaf upwards) and the columns of ``carry``."""
    extra = F.struct(*[c.alias(k) for k, c in (carry or {}).items()] or [F.lit(None).cast("string").alias("none")])
    rows = docs.select(F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       leaf([F.col(f"`{c}`") for c in fields]).alias("leaf"), extra.alias("carry"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())       # splits runs of equal rows
    placed = ranked(rows, ["grp"], ["doc_id", "leaf", "row"], "position", "size", write=checkpointed)
    leaves = placed.select(field(F.col("grp")).alias("tree"), F.col("position").alias("idx"), F.col("leaf").alias("hash"),
                           F.col("size").alias("n"), F.struct("grp", "doc_id", "carry", "position", F.col("size").alias("of")).alias("held"))
    # the shape of the forest: groups, rows of the largest, nodes on each level
    sizes = leaves.where("idx = 0").select("tree", "n", "held.grp")
    n_groups, largest = sizes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    low, high = _height(largest), _height(n_groups)
    on_level = sizes.agg(*[F.coalesce(F.sum(F.ceil(F.col("n") / F.lit(float(FAN ** k)))), F.lit(0)).cast("long").alias(f"l{k}")
                           for k in range(low + 1)]).first()

    runs, subroots = _grow(leaves, low)
    lone = leaves.where("n = 1")
    groups = ranked(sizes.select("tree", "grp"), [], ["grp"], "idx", write=checkpointed)
    top = subroots.join(groups, "tree").select(
        F.lit("").alias("tree"), "idx", "hash", F.lit(n_groups).cast("long").alias("n"), F.col("tree").alias("held"))
    top_runs, roots = _grow(checkpointed(top, "merkle-subroots"), high)
    found = roots.select("hash").first()                                   # one digest
    root = F.lit(found[0] if found else None).cast("string")

    # level -1 of a group's tree is its subroot, which is a leaf of the tree of groups
    done = F.lit(None).cast("struct<tree:string,level:int,idx:bigint>")
    to_subroot = _top_key(F.col("tree")) if high else done
    nodes = lone.select(to_subroot.alias("pointer"), F.array().cast("array<struct<left:string,right:string>>").alias("proof"),
                        "held", F.col("hash").alias("node"))
    inner = None
    for level, run in enumerate(runs):
        places = _places(run, level, to_subroot)
        if level == 0:
            nodes = nodes.unionByName(places.drop("key"))
        else:
            inner = _with(inner, places.select("key", "pointer", "proof"))
    for level, run in enumerate(top_runs):
        places = _places(run, level, done)
        key = _top_key(F.col("held")) if level == 0 else F.col("key")
        inner = _with(inner, places.select(key.alias("key"), "pointer", "proof"))

    # a group's only row is its subroot and points to itself, so it starts one step behind
    step, depth = 1, max(low, min(high, 1)) + high
    while step < depth:
        # nodes that lie step levels above another node
        bound = sum(on_level[step:]) + 2 * n_groups
        above = inner.where((F.col("key.level") >= step) | (F.col("key.level") < 0) | (F.col("key.tree") == ""))
        above = checkpointed(above, "merkle-pointers")
        small = bound * step * (2 * FAN * DIGEST_CHARS) <= BROADCAST_BYTES
        nodes, inner = _jump(nodes, above, small), _jump(above, above, small)
        step *= 2
    proof, at_leaf = F.col("proof"), F.col("node")
    return nodes.select(
        F.col("held.doc_id").alias("doc_id"), F.col("held.grp").alias("grp"), F.col("held.position").alias("position"),
        at_leaf.alias("leaf"), fold(at_leaf, F.slice(proof, F.lit(1), F.size(proof) - high)).alias("subroot"),
        root.alias("root"), proof, *[F.col("held.carry").getField(k).alias(k) for k in carry or {}])


def _jump(nodes: DataFrame, above: DataFrame, small: bool) -> DataFrame:
    """Segments continued by those of the nodes pointed to; pointers twice as far."""
    far = above.select(F.col("key").alias("far_key"), F.col("pointer").alias("far_pointer"), F.col("proof").alias("far_proof"))
    joined = nodes.join(F.broadcast(far) if small else far, F.col("pointer") == F.col("far_key"), "left")
    proof = F.when(F.col("far_proof").isNull(), F.col("proof")).otherwise(F.concat("proof", "far_proof"))
    return joined.withColumn("proof", proof).withColumn("pointer", F.col("far_pointer")).drop("far_key", "far_pointer", "far_proof")


def verify(manifest: DataFrame, observed: Column) -> DataFrame:
    """``manifest`` with folded_root, what the leaf ``observed`` and the stored siblings lead
    to, and verified: whether that is the root."""
    return (manifest.withColumn("folded_root", fold(observed, F.col("proof")))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


def _with(a: DataFrame | None, b: DataFrame) -> DataFrame:
    return b if a is None else a.unionByName(b)
