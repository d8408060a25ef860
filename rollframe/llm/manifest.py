"""Merkle manifest of a dataset, with a proof for every row by pointer jumping.

A row is a leaf: the hash of its fields. The leaves of a source, by doc_id, are hashed in runs of
``ARITY`` until one node remains, the source's subroot; the subroots, by source, are hashed
likewise into the root. A proof is the list of sibling digests from a leaf up to the root.

1. Leaves are numbered inside their source over range partitions, so a source that holds a third
   of all rows covers many tasks.
2. Trees grow ``DEPTH`` levels at a time: the nodes of a block of ``ARITY ** DEPTH`` neighbours
   are hashed up to one node, and the blocks' nodes are the next leaves. A block is bounded.
3. Every node holds the segment of siblings towards an ancestor, at first its parent. A round
   joins the table to itself: the segment up to the ancestor, then the ancestor's own segment.
   The distance doubles, so rounds grow with the logarithm of the depth. Inner nodes stay only
   where a later jump can land: those at multiples of the distance, and the few above subroots.
   The side looked up shrinks from half the leaves to a handful of rows.
4. Folding a leaf along its segment gives the root again, or does not if the row was changed.

Defined cases: a null doc_id comes first, and counts as empty text where its checksum is asked
for; rows that share an id stand by their leaf, and equal rows are equal leaves; a null source is
a source of its own, before all others; a null field is told from an empty one; a dataset of one
row has its leaf as root and an empty proof; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollframe.distributed import row_numbers
from rollframe.llm.common import query, staged, table
from rollframe.llm.labelled import remainder

ARITY = 3
DEPTH = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = ["tree", "level", "idx"]


def joined_hash(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_hash(**changed: Column) -> Column:
    """The leaf of a row; ``changed`` replaces fields."""
    fields = [changed.get(f, F.col(f)).cast("string") for f in FIELDS]
    return joined_hash(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields])


def _parents(digests: str) -> Column:
    """One hash of every run; the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(digests) / ARITY).cast("int") - 1)
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(digests, i * ARITY + 1, ARITY), ""), 256))


def _entries(digests: str, level: int, width: int) -> Column:
    """The nodes of a level of a block, with the digests to their left and right in the run."""
    def entry(_, i):
        at = i % ARITY
        return F.struct(F.lit(level).alias("level"), (F.col("block") * width + i).alias("idx"),
                        F.array_join(F.slice(digests, i - at + 1, at), "").alias("l"), F.array_join(F.slice(digests, i + 2, ARITY - 1 - at), "").alias("r"))
    return F.transform(digests, entry)


class Trees:
    """All trees of a table (tree, idx, digest), grown block by block."""

    def __init__(self, leaves: DataFrame):
        self.blocks: list[tuple[int, DataFrame]] = []
        counts = staged(leaves.groupBy("tree").agg(F.count("*").alias("n")))
        left = counts.agg(F.max("n")).first()[0] or 0
        nodes, base = leaves, 0
        while left:
            size = ARITY ** DEPTH
            block = nodes.groupBy("tree", F.floor(F.col("idx") / size).alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("have"))
            block = block.join(counts, "tree").select("tree", "block", F.col("n").alias("n0"), F.col("have.digest").alias("d0"))
            for s in range(DEPTH):
                block = block.withColumn(f"d{s + 1}", F.when(F.col(f"n{s}") > 1, _parents(f"d{s}"))).withColumn(f"n{s + 1}", F.ceil(F.col(f"n{s}") / ARITY))
            block = staged(block)
            self.blocks.append((base, block))
            more = F.col(f"n{DEPTH - 1}") > 1
            nodes = block.filter(more).select("tree", F.col("block").alias("idx"), F.col(f"d{DEPTH}")[0].alias("digest"))
            counts = block.filter(more & (F.col("block") == 0)).select("tree", F.col(f"n{DEPTH}").alias("n"))
            base, left = base + DEPTH, -(-left // size) if left > ARITY ** (DEPTH - 1) else 0

    def nodes(self) -> DataFrame:
        """All nodes below the tops: tree, level, idx, the siblings to the left and right, and whether the parent is a top."""
        out = None
        for base, block in self.blocks:
            for s in range(DEPTH):
                rows = block.filter(F.col(f"n{s}") > 1).select(
                    "tree", (F.col(f"n{s + 1}") == 1).alias("below_top"), F.inline(_entries(f"d{s}", base + s, ARITY ** (DEPTH - s))))
                out = rows if out is None else out.unionByName(rows)
        return out.select(*NODE, "l", "r", "below_top")

    def tops(self) -> DataFrame:
        """tree, level and digest of the one node that remains."""
        out = None
        for base, block in self.blocks:
            for s in range(DEPTH):
                own = F.col(f"n{s}") == 1
                rows = block.filter(own if s == 0 else own & (F.col(f"n{s - 1}") > 1)).select("tree", F.lit(base + s).alias("level"), F.col(f"d{s}")[0].alias("digest"))
                out = rows if out is None else out.unionByName(rows)
        return out


def _jumps(leaves: DataFrame) -> tuple[DataFrame, DataFrame, str, int]:
    """The leaves and the inner nodes with the segment to their parents; the root; the greatest depth."""
    trees = Trees(leaves.select("tree", "idx", F.col("leaf").alias("digest")))
    tops = staged(row_numbers(trees.tops(), [], ["tree"], "k").withColumn("k", F.col("k") - 1))
    above = Trees(tops.select(F.lit("t").alias("tree"), F.col("k").alias("idx"), "digest"))
    root = above.tops().first()
    one_source = root.level == 0
    depth = tops.agg(F.max("level")).first()[0] + root.level
    parent = [F.when(~F.col("below_top") | ~F.lit(one_source), c) for c in (F.col("tree"), F.col("level") + 1, F.floor(F.col("idx") / ARITY))]
    names = ("a_tree", "a_level", "a_idx")
    inside = trees.nodes().select(*NODE, *[c.alias(n) for c, n in zip(parent, names)], F.lit(False).alias("top"), "l", "r")
    up = above.nodes()
    parent = [F.when(~F.col("below_top"), c).alias(n) for c, n in zip((F.lit("t"), F.col("level") + 1, F.floor(F.col("idx") / ARITY)), names)]
    up = up.select(*NODE, *parent, F.lit(True).alias("top"), "l", "r")
    # The leaves of the upper tree are the subroots, under the names they have in their own trees.
    renamed = up.filter("level = 0").drop("tree", "level").join(tops.select(F.col("k").alias("idx"), "tree", "level"), "idx").withColumn("idx", F.lit(0).cast("long"))
    nodes = inside.unionByName(up.filter("level > 0")).unionByName(renamed).select(
        *NODE, *names, "top", F.array(F.struct("l", "r", "top")).alias("segment"))
    own = leaves.withColumn("level", F.lit(0)).join(nodes.filter("level = 0"), NODE, "left")
    none = F.array().cast(dict(nodes.dtypes)["segment"])
    return own.withColumn("segment", F.coalesce("segment", none)), nodes.filter("level > 0"), root.digest, depth


def prove(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """Per row: doc_id, source, leaf, subroot, root, proof (the sibling pairs from the leaf up),
    and ``folded_root``, what the proof makes of the ``claimed`` leaf (the row's own without one)."""
    leaf = leaf_hash()
    rows = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"),
        F.coalesce(claimed if claimed is not None else leaf, leaf).alias("claimed")))
    tree = F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit("n"))  # sorts null first, and apart from any source
    numbered = row_numbers(rows.withColumn("tree", tree), ["tree"], ["doc_id", "leaf"], "place")
    leaves = staged(numbered.withColumn("idx", F.col("place") - 1).drop("place", "source"))
    if not leaves.head(1):
        return _folded(leaves.withColumn("segment", F.array().cast("array<struct<l:string,r:string,top:boolean>>")), "")
    own, inner, root, depth = _jumps(leaves)
    # Two tables, so that Spark knows the size of the side that is looked up in each round.
    own, inner, done, distance = staged(own), staged(inner), [], 1
    while distance < depth:
        landing = inner.select(*[F.col(c).alias(f"on_{c}") for c in NODE], *[F.col(f"a_{c}").alias(f"to_{c}") for c in NODE], F.col("segment").alias("rest"))
        finished, further = F.col("a_tree").isNull(), F.col("top") | (F.col("level") % (2 * distance) == 0)

        def jump(rows: DataFrame, landing: DataFrame = landing) -> DataFrame:
            met = rows.join(landing, [F.col(f"a_{c}") == F.col(f"on_{c}") for c in NODE]).withColumn("segment", F.concat("segment", "rest"))
            return met.select(*[F.col(f"to_{c[2:]}").alias(c) if c.startswith("a_") else F.col(c) for c in rows.columns])
        done.append(own.filter(finished))
        own = staged(jump(own.filter(~finished)))
        inner = staged(jump(inner.filter(~finished & further)).unionByName(inner.filter(finished & further)))
        distance *= 2
    out = own
    for early in done:
        out = out.unionByName(early)
    return _folded(out, root)


def _folded(leaves: DataFrame, root: str) -> DataFrame:
    fold = lambda segment, start: F.aggregate(segment, F.col(start), lambda below, s: joined_hash(s["l"], below, s["r"]))
    return leaves.select(
        "doc_id", F.when(F.col("tree") != "n", F.substring("tree", 2, 2 ** 31 - 1)).alias("source"), "leaf",
        fold(F.filter("segment", lambda s: ~s["top"]), "leaf").alias("subroot"), F.lit(root).alias("root"),
        F.transform("segment", lambda s: F.struct(s["l"].alias("left"), s["r"].alias("right"))).alias("proof"),
        fold("segment", "claimed").alias("folded_root"))


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, lang, n_chars, text,
    list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(
      list_filter(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: c <> ''), lambda c: list_transform(range(8), lambda j: (CAST(ascii(c) AS BIGINT) >> CAST(j AS INTEGER)) & 1)))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) & 1 AS low FROM documents),
e AS (SELECT *, CASE WHEN low = 1 THEN replace(text, chr(10), '') ELSE text END AS changed FROM d),
h AS (SELECT r, doc_id, coalesce('v' || source, 'n') AS tree, source, low,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text, changed FROM e),
leaf AS (SELECT r, doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS claimed FROM h),
own AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
lv AS (SELECT tree, 0 AS level, idx, leaf AS digest, n FROM own
  UNION ALL SELECT tree, level + 1, idx // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx)), (n + {ARITY - 1}) // {ARITY} FROM lv WHERE n > 1 GROUP BY tree, level, idx // {ARITY}, n),
subs AS (SELECT tree, level AS top_level, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS k, count(*) OVER () AS n FROM lv WHERE n = 1),
up AS (SELECT 't' AS tree, 0 AS level, k AS idx, subroot AS digest, n FROM subs
  UNION ALL SELECT tree, level + 1, idx // {ARITY}, sha256(string_agg(digest, '' ORDER BY idx)), (n + {ARITY - 1}) // {ARITY} FROM up WHERE n > 1 GROUP BY tree, level, idx // {ARITY}, n),
every AS (SELECT * FROM lv WHERE n > 1 UNION ALL SELECT * FROM up WHERE n > 1),
seg AS (SELECT a.tree, a.level, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS g
  FROM every a JOIN every b ON a.tree = b.tree AND a.level = b.level AND a.idx // {ARITY} = b.idx // {ARITY} GROUP BY 1, 2, 3),
one AS (SELECT r, own.tree, 0 AS level, idx, claimed AS cur, '' AS sibs FROM own
  UNION ALL SELECT r, one.tree, one.level + 1, one.idx // {ARITY}, sha256(l || cur || g), sibs || l || g FROM one JOIN seg ON seg.tree = one.tree AND seg.level = one.level AND seg.idx = one.idx),
two AS (SELECT r, 0 AS level, k AS idx, cur, sibs FROM one JOIN subs ON one.tree = subs.tree AND one.level = subs.top_level
  UNION ALL SELECT r, two.level + 1, two.idx // {ARITY}, sha256(l || cur || g), sibs || l || g FROM two JOIN seg ON seg.tree = 't' AND seg.level = two.level AND seg.idx = two.idx)
SELECT doc_id, leaf, subroot, up.digest AS root, sha256(sibs) AS proof_sha256, cur AS folded_root, cur = up.digest AS verified
FROM own JOIN subs USING (tree) JOIN up ON up.n = 1 JOIN two ON two.r = own.r AND two.level = up.level"""


@query("op13_merkle_manifest", ORACLE)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    tampered = F.when(remainder(2) == 0, leaf_hash(text=F.replace(F.col("text"), F.lit("\n"), F.lit(""))))
    proof = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    return prove(table(spark, sf, "documents"), tampered).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
