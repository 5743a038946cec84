"""A Merkle manifest of a dataset, and a proof for every row of it.

A leaf is the hash of a row's fields. Per group (language) leaves ascend by id, and every
`fanout` consecutive nodes become their hash until one, the subroot, remains; the subroots,
ordered by group, become the root in the same way. What is built is stored as node rows,
each with the digests of its children and the key of its parent. A recursive query then
ascends for all leaves at once: at each level a cursor meets its parent's row, appends the
siblings as a row of the result and folds the leaf's hash with them. The leaves of a lowest
run have all but their first siblings in common, so they share a cursor, which holds a folded
hash for each of them. What a cursor carries is small whatever the height; the siblings of a
run meet when the climb is over.

Cursors of many runs meet at one node near the top. Such nodes are stored in up to
MOST_COPIES copies, one for each CURSORS lowest runs, and cursors are dealt over them:
level l has an eighth of the rows of l - 1 and eight times their copies.

Digests travel as 32 bytes and are hashed as lower-case hex text. Hashes are over UTF-8.

Nulls and ties: a null field is `-`; a null id comes first and is never tampered with; a
null group is a group and comes first; equal ids are told apart by their leaves, and rows
equal throughout are leaves each. An empty table has no rows and no nodes. Columns beyond the
fields play no part, whatever they are called."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outvote.llm.columns import needed
from outvote.llm.ordinals import numbered
from outvote.staging import discard, stage

FANOUT = 8
CURSORS = 64
MOST_COPIES = 4096
#: The tree of subroots; trees of groups are called "" (null) or "=" and the group.
TOP = "/"
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def _hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf_digest(fields: list[Column]) -> Column:
    """`-` for a null, else byte count, `:` and the value, of all fields one after another."""
    texts = [f.cast("string") for f in fields]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return digest(F.concat(*parts))


def tampers(key: Column) -> Column:
    """Whether the contract tampers with this id."""
    return F.coalesce(F.crc32(F.encode(key.cast("string"), "UTF-8")) % 3 == 0, F.lit(False))


def leaves(documents: DataFrame, fields: list[str], id_col: str, group_col: str, text_col: str) -> DataFrame:
    """Staged rows of 100 bytes: key, tree, leaf, the leaf after tampering, place (idx) and count
    (n) in the tree. Texts are read once and do not travel."""
    rows = needed(documents, __key=id_col, **{f"__f{i}": c for i, c in enumerate(fields)})
    columns = [F.col(f"__f{i}") for i in range(len(fields))]
    changed = [F.translate(c, *_LOWER) if f == text_col else c for c, f in zip(columns, fields)]
    group = F.col(f"__f{fields.index(group_col)}").cast("string")
    hashed = rows.select(
        F.col("__key").alias("key"),
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("tree"),
        leaf_digest(columns).alias("leaf"),
        F.when(tampers(F.col("__key")), leaf_digest(changed)).alias("tampered"),
    )
    placed = numbered(stage(hashed, "merkle-hashed"), "tree", ["key", "leaf"], "merkle-leaves")
    return placed.withColumnsRenamed({"__row": "row", "__index": "idx", "__n": "n"})


def runs_of(leaves: DataFrame, fanout: int) -> DataFrame:
    """Staged: the lowest runs of each tree, with their leaves in order."""
    member = F.struct((F.col("idx") % fanout).cast("int").alias("o"), "key", "leaf", "tampered")
    found = leaves.groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct("idx", member.alias("m")))).alias("m"), F.min("row").alias("row"), F.max("n").alias("n")
    )
    return stage(found.withColumn("m", F.col("m.m")), "merkle-runs")


def _nodes_of(rows: DataFrame, children: Column, level: int, fanout: int) -> DataFrame:
    """rows: tree, idx (of the parents), n (of the children), weight; children: their digests,
    as hexadecimal text."""
    return rows.select(
        "tree",
        F.lit(level).alias("level"),
        "idx",
        F.unhex(children).alias("children"),
        digest(F.lower(children)).alias("digest"),
        F.ceil(F.col("n") / fanout).alias("n"),
        "weight",
    )


def _climbing(nodes: DataFrame, fanout: int, most: int, level: int, label: str) -> list[DataFrame]:
    """nodes: tree, idx, digest, n (nodes of its tree), weight (leaves below), of which some tree
    has `most`. The staged levels above them, from `level` up; a tree ends where n is 1."""
    built = []
    while most > 1:
        child = F.struct((F.col("idx") % fanout).alias("o"), F.col("digest").alias("d"))
        parents = nodes.filter("n > 1").groupBy("tree", F.floor(F.col("idx") / fanout).alias("idx")).agg(
            F.sort_array(F.collect_list(child)).alias("c"), F.sum("weight").alias("weight"), F.max("n").alias("n")
        )
        children = F.array_join(F.transform("c", lambda x: F.hex(x["d"])), "")
        nodes = stage(_nodes_of(parents, children, level, fanout), f"{label}-{level}")
        built.append(nodes)
        most, level = -(-most // fanout), level + 1
    return built


def _copies(weight: Column) -> Column:
    return F.least(F.lit(MOST_COPIES), F.ceil(weight / (CURSORS * FANOUT))).cast("int")


def _parent(level: Column, idx: Column, fanout: int, tree: Column) -> list[Column]:
    return [
        tree.alias("up_tree"),
        (level + 1).alias("up_level"),
        F.floor(idx / fanout).alias("up_idx"),
        (idx % fanout).cast("int").alias("up_ordinal"),
    ]


def build(runs: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """The node rows (tree, level, idx, digest, children, weight, up_tree, up_level, up_idx,
    up_ordinal, up_copies; up is null at the root) and the subroots (tree and the same link)."""
    most = runs.agg(F.max("n")).first()[0] or 0
    joined = F.array_join(F.transform("m", lambda x: F.hex(x["leaf"])), "")
    lowest = runs.filter("n > 1").withColumn("weight", F.size("m").cast("long"))
    first = stage(_nodes_of(lowest, joined, 1, fanout), "merkle-level-1")
    levels = [first, *_climbing(first, fanout, -(-most // fanout), 2, "merkle-level")]
    single = runs.filter("n = 1").select("tree", F.lit(0).alias("level"), F.col("m")[0]["leaf"].alias("digest"), F.lit(1).cast("long").alias("weight"))
    tops = reduce(
        DataFrame.unionByName, (x.filter("n = 1").select("tree", "level", "digest", "weight") for x in levels), single
    )
    ranked = numbered(tops.withColumn("top", F.lit(TOP)), "top", ["tree"], "merkle-subroots")
    above = ranked.select(F.col("top").alias("tree"), F.col("__index").alias("idx"), "digest", F.col("__n").alias("n"), "weight")
    high = _climbing(above, fanout, above.count(), 1, "merkle-top")

    own = ["tree", "level", "idx", "digest", "children", "weight"]
    link = ["up_tree", "up_level", "up_idx", "up_ordinal"]
    to_top = _parent(F.lit(0), F.col("__index"), fanout, F.col("top"))
    subroots = ranked.select("tree", "__n", *to_top).select("tree", *(F.when(F.col("__n") > 1, F.col(c)).alias(c) for c in link))
    inner = _parent(F.col("level"), F.col("idx"), fanout, F.col("tree"))
    none = [F.lit(None).cast(kind).alias(c) for c, kind in zip(link, ("string", "int", "long", "int"))]
    parts = [x.filter("n > 1").select(*own, *inner) for x in levels + high]
    parts += [x.filter("n = 1").select(*own).join(subroots, "tree") for x in levels]
    parts += [x.filter("n = 1").select(*own, *none) for x in high]
    nodes = stage(reduce(DataFrame.unionByName, parts), "merkle-nodes")
    up = nodes.select(F.col("tree").alias("up_tree"), F.col("level").alias("up_level"), F.col("idx").alias("up_idx"), _copies(F.col("weight")).alias("up_copies"))
    nodes, subroots = (stage(x.join(up, link[:3], "left"), "merkle-links") for x in (nodes, subroots))
    discard(*levels, *high)
    return nodes, subroots


def _folded(leaf: str, left: str, right: str) -> str:
    return f"unhex(sha2(concat(lower(hex({left})), lower(hex({leaf})), lower(hex({right}))), 256))"


def climb(runs: DataFrame, nodes: DataFrame, subroots: DataFrame) -> DataFrame:
    """Per leaf: key, leaf, subroot, root, proof (the siblings' digests one after another) and
    folded (the root that the tampered leaf and the siblings give)."""
    spark = runs.sparkSession
    # a lowest run is the node of level 1 itself, or a subroot of one leaf
    links = nodes.filter("level = 1").select("tree", "idx", "children", "digest", *(f"up_{c}" for c in ("tree", "level", "idx", "ordinal", "copies")))
    inner = runs.filter("n > 1").join(links.filter(F.col("tree") != TOP), ["tree", "idx"])
    alone = runs.filter("n = 1").join(subroots, "tree").withColumns({"children": F.lit(None).cast("binary"), "digest": F.col("m")[0]["leaf"]})
    hashed = _folded("coalesce(x.tampered, x.leaf)", "substring(children, 1, 32 * x.o)", "substring(children, 32 * x.o + 33)")
    starts = stage(
        inner.withColumn("folded", F.expr(f"transform(m, x -> {hashed})")).unionByName(
            alone.withColumn("folded", F.expr("transform(m, x -> coalesce(x.tampered, x.leaf))"))
        ),
        "merkle-cursors",
    )
    copied = nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), _copies(F.col("weight")) - 1))).drop("weight")
    copied = stage(copied, "merkle-copies")
    left, right = "substring(n.children, 1, 32 * c.ordinal)", "substring(n.children, 32 * c.ordinal + 33)"
    query = f"""
    WITH RECURSIVE climb AS (
      SELECT row, 0 AS step, up_tree AS tree, up_level AS level, up_idx AS idx, up_ordinal AS ordinal,
             cast(pmod(row, up_copies) AS int) AS salt, folded, cast(NULL AS binary) AS siblings,
             cast(NULL AS binary) AS subroot, CASE WHEN up_tree IS NULL THEN digest END AS root
      FROM {{starts}}
      UNION ALL
      SELECT c.row, c.step + 1, n.up_tree, n.up_level, n.up_idx, n.up_ordinal,
             cast(pmod(c.row, n.up_copies) AS int), transform(c.folded, f -> {_folded("f", left, right)}), concat({left}, {right}),
             CASE WHEN c.tree = '{TOP}' AND c.level = 1 THEN substring(n.children, 32 * c.ordinal + 1, 32) END,
             CASE WHEN n.up_tree IS NULL THEN n.digest END
      FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.level = c.level AND n.idx = c.idx AND n.salt = c.salt
      WHERE c.tree IS NOT NULL)
    SELECT row, step, CASE WHEN root IS NOT NULL THEN folded END AS folded, siblings, subroot, root FROM climb
    """
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    # the limit guards against endless recursion; here each step is one level of a finite tree
    spark.conf.set(limit, "-1")
    try:
        climbed = spark.sql(query, starts=starts, nodes=copied)
        steps = F.sort_array(F.collect_list(F.struct("step", "folded", "siblings", "subroot", "root")))
        met = climbed.groupBy("row").agg(steps.alias("s"))
        subroot = F.get(F.filter("s", lambda x: x["subroot"].isNotNull()), F.lit(0))["subroot"]
        last = F.element_at("s", -1)
        found = stage(
            met.select(
                "row",
                F.coalesce(subroot, last["root"]).alias("subroot"),
                last["root"].alias("root"),
                F.unhex(F.array_join(F.transform("s", lambda x: F.coalesce(F.hex(x["siblings"]), F.lit(""))), "")).alias("above"),
                last["folded"].alias("folded"),
            ),
            "merkle-paths",
        )
    finally:
        spark.conf.set(limit, before)
    discard(copied)
    each = starts.select("row", "m", "children").join(found, "row").withColumn("x", F.explode(F.arrays_zip("m", "folded")))
    beside = F.expr("concat(substring(children, 1, 32 * x.m.o), substring(children, 32 * x.m.o + 33))")
    return each.select(
        F.col("x.m.key").alias("key"),
        F.col("x.m.leaf").alias("leaf"),
        "subroot",
        "root",
        F.concat(F.coalesce(beside, F.lit(b"")), "above").alias("proof"),
        F.col("x.folded").alias("folded"),
    )


def manifest(
    documents: DataFrame,
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    text_col: str = "text",
    fanout: int = FANOUT,
) -> DataFrame:
    """Per document: id, leaf, subroot, root, proof (hex digests of its siblings, lowest level
    first), folded_root (from the tampered leaf) and verified (whether that is the root)."""
    runs = runs_of(leaves(documents, list(fields), id_col, group_col, text_col), fanout)
    found = climb(runs, *build(runs, fanout))
    return found.select(
        F.col("key").alias(id_col),
        _hex(F.col("leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        _hex(F.col("proof")).alias("proof"),
        _hex(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
