"""Merkle manifest of a table: a digest for every document, one root for all, and a proof that joins the two.

Leaves are ranked within their group (language); the digits of the rank to base 8 say where in the tree a
leaf stands. Inside blocks of 512 leaves the digit columns are grouped away one after another, each time
nesting the children as structs in their parent. A block's root is a leaf of the tier above, which is rolled
up in the same way, so no row ever holds more than one block. On the way down a block is unfolded again: at
each level ``transform`` gives a child the digests left and right of it and ``explode`` makes it a row. Inside
a block that takes no join; a block meets the path of its own root once (one row for 512 leaves).

Defined results: nulls count as ``-`` in a leaf and a null group comes first; an empty text has the digest of
its length 0; rows with one id stand in the order of their digests, so repeated rows are interchangeable; an
empty table gives an empty table; further columns are left out; texts are digested whole, at any length.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import stored

#: Children of a node, and the digits of a rank that one block holds: 8 ** 3 = 512 nodes.
FAN = 8
DIGITS = 3
BLOCK = FAN**DIGITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as a leaf takes it: ``-`` for null, else its byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(**replaced: Column) -> Column:
    return digest(*[field(replaced.get(c, F.col(c))) for c in COLUMNS])


def ranked(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Add ``rank`` (from 0, within the group, nulls first) and ``size`` (the group's rows).

    Rows are range-partitioned and sorted once. A row's number within its partition and the partitions'
    counts give the rank, so a group that holds most of the rows is spread over many partitions.
    """
    by = [F.asc_nulls_first(c) for c in (group, *order)]
    placed = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), label)
    part = F.shiftright("_at", 33)
    runs = placed.groupBy(part.alias("_part"), F.col(group).alias("_of")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    whole = Window.partitionBy("_of")
    runs = runs.withColumn("size", F.sum("_n").over(whole)).withColumn("_before", F.sum("_n").over(whole.orderBy("_part")) - F.col("_n"))
    met = placed.join(runs, (part == F.col("_part")) & F.col(group).eqNullSafe(F.col("_of")))
    return met.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).select(*rows.columns, "rank", "size")


def rolled(nodes: DataFrame, group: str) -> DataFrame:
    """Nodes (group, rank, size, digest, held) to one row per block: its root and its nested children.

    All groupings keep to the partitioning by (group, block): one shuffle. A level at which the group has
    one node already is passed on as it is.
    """
    rows = nodes.select(F.col(group).alias("_group"), "size", F.expr(f"rank div {BLOCK}").alias("block"), *[F.expr(f"rank div {FAN**k} % {FAN}").cast("int").alias(f"d{k}") for k in range(DIGITS)], "digest", "held")
    rows = rows.repartition("_group", "block")
    for k in range(DIGITS):
        up = [f"d{j}" for j in range(k + 1, DIGITS)]
        child = F.struct(f"d{k}", "digest", "held" if k == 0 else "kids")
        rows = rows.groupBy("_group", "size", "block", *up).agg(F.array_sort(F.collect_list(child)).alias("kids"))
        joined = digest(F.array_join(F.transform("kids", lambda x: x.digest), ""))
        rows = rows.withColumn("digest", F.when(F.col("size") > FAN**k, joined).otherwise(F.col("kids")[0]["digest"]))
    return rows


def unfolded(blocks: DataFrame, above: DataFrame, kept: list[str]) -> DataFrame:
    """Blocks and the path of their roots to the nodes in them: (_group, block = rank, held, path, *kept).

    A path lists, from the node up, the digests left and right of it in its run.
    """
    held = above.withColumnsRenamed({"_group": "_g", "block": "_b"})
    rows = blocks.drop("digest").join(held, F.col("_group").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_b"))).drop("_g", "_b")
    for k in reversed(range(DIGITS)):
        below = "held" if k == 0 else "kids"
        digests = F.transform("kids", lambda x: x.digest)
        run = F.transform("kids", lambda x, i: F.struct(x[below].alias(below), i.alias("i"), F.array_join(F.slice(digests, F.lit(1), i), "").alias("l"), F.array_join(F.slice(digests, i + 2, F.lit(FAN)), "").alias("r")))
        step = F.when(F.col("size") > FAN**k, F.array(F.struct(F.col("c.l").alias("l"), F.col("c.r").alias("r")))).otherwise(F.array().cast("array<struct<l:string,r:string>>"))
        rows = rows.select("_group", "size", "block", "path", *kept, F.explode(run).alias("c"))
        rows = rows.select("_group", "size", (F.col("block") * FAN + F.col("c.i")).alias("block"), F.concat(step, "path").alias("path"), *kept, F.col(f"c.{below}").alias(below))
    return rows


class Tree:
    """The tiers of blocks above ranked nodes, one tree for each group."""

    def __init__(self, nodes: DataFrame, group: str, label: str) -> None:
        self.tiers = []
        while True:
            blocks = stored(rolled(nodes, group), label)
            self.tiers.append(blocks)
            if (blocks.agg(F.max("size")).first()[0] or 0) <= BLOCK:
                break
            group = "_group"
            nodes = blocks.select("_group", F.col("block").alias("rank"), F.expr(f"(size + {BLOCK - 1}) div {BLOCK}").alias("size"), "digest", F.lit(None).cast("int").alias("held"))

    def roots(self) -> DataFrame:
        return self.tiers[-1].select(F.col("_group"), "digest")

    def paths(self, above: DataFrame, kept: list[str]) -> DataFrame:
        """``above``: (_group, path of the group's root, *kept)."""
        found = above.withColumn("block", F.lit(0).cast("long"))
        for blocks in reversed(self.tiers):
            found = unfolded(blocks, found.select("_group", "block", "path", *kept), kept)
        return found


def siblings_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p.l, p.r)), ""))


def folded(path: Column, own: Column) -> Column:
    """The root that a leaf and the digests beside its way up give."""
    return F.aggregate(path, own, lambda acc, p: digest(p.l, acc, p.r))


def manifest(documents: DataFrame, tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """Per document: leaf, path, subroot of its language, root, digest of the proof, and the root folded from it.

    Where ``tampered`` holds, the fold starts from the leaf with ``changed`` for its text: such a row is
    verified only if that leaves its text as it was.
    """
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase) if changed is None else changed
    mark = F.coalesce(F.lit(False) if tampered is None else tampered, F.lit(False))
    leaves = documents.select(*COLUMNS).select("doc_id", "lang", leaf().alias("digest"), F.when(mark, leaf(text=lowered)).alias("other"))
    leaves = ranked(stored(leaves, "leaves"), "lang", ["doc_id", "digest"], "leaves-ranked")
    own = leaves.select("lang", "rank", "size", "digest", F.struct("doc_id", F.col("digest").alias("leaf"), "other").alias("held"))
    documents_tree = Tree(own, "lang", "leaf-blocks")

    subroots = ranked(documents_tree.roots().select(F.lit(0).alias("all"), "_group", "digest"), "all", ["_group"], "subroots")
    top = Tree(subroots.select("all", "rank", "size", "digest", F.struct(F.col("_group").alias("lang"), F.col("digest").alias("subroot")).alias("held")), "all", "subroot-blocks")
    start = top.roots().select("_group", F.array().cast("array<struct<l:string,r:string>>").alias("path"), F.col("digest").alias("root"))
    groups = top.paths(start, ["root"]).select(F.col("held.lang").alias("_group"), "path", F.col("held.subroot").alias("subroot"), "root")

    proofs = documents_tree.paths(groups, ["subroot", "root"])
    out = proofs.select(
        F.col("held.doc_id").alias("doc_id"), F.col("held.leaf").alias("leaf"), "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("path"), F.coalesce("held.other", "held.leaf")).alias("folded_root"), "path",
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tampering() -> Column:
    """Where 3 divides the CRC-32 of the decimal id."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0


def oracle_sql(levels: int = 8, top_levels: int = 5) -> str:
    """DuckDB SQL of the manifest for up to 8 ** levels documents a language and 8 ** top_levels languages."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    whole = lambda text: f"sha256({part('doc_id')} || {part('source')} || {part('lang')} || {part('n_chars')} || {part(text)})"
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bits}), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""WITH d AS (SELECT doc_id, source, lang, n_chars, text, {lower} AS lowered FROM documents),
l0 AS (SELECT doc_id, lang, {whole("text")} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {whole("lowered")} END AS other FROM d),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM l0),
n0 AS (SELECT lang, n, r, leaf AS h FROM l)"""

    def climb(k: int, name: str, before: str, group: str) -> str:
        up = f"SELECT {group}, any_value(n) AS n, r // 8 AS r, CASE WHEN any_value(n) > {8 ** (k - 1)} THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM {before} GROUP BY {group}, r // 8"
        # what stands left and right of a node in its run
        beside = f"SELECT {group}, r, n, CASE WHEN n > {8 ** (k - 1)} THEN coalesce(string_agg(h, '' ORDER BY r) OVER (PARTITION BY {group}, r // 8 ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a, CASE WHEN n > {8 ** (k - 1)} THEN coalesce(string_agg(h, '' ORDER BY r) OVER (PARTITION BY {group}, r // 8 ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS b FROM {before}"
        return f",\n{name} AS ({up}),\n{name}_beside AS ({beside})"

    for k in range(1, levels + 1):
        sql += climb(k, f"n{k}", f"n{k - 1}", "lang")
    sql += f",\nt0 AS (SELECT 0 AS g, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM n{levels})"
    for k in range(1, top_levels + 1):
        sql += climb(k, f"t{k}", f"t{k - 1}", "g")
    sql += ",\nw0 AS (SELECT l.doc_id, l.lang, l.r, l.leaf, coalesce(l.other, l.leaf) AS f, '' AS p FROM l)"
    fold = "{w}.*EXCLUDE (f, p), CASE WHEN s.a IS NULL THEN {w}.f ELSE sha256(s.a || {w}.f || s.b) END AS f, {w}.p || coalesce(s.a || s.b, '') AS p"
    for k in range(1, levels + 1):
        w = f"w{k - 1}"
        sql += f",\nw{k} AS (SELECT {fold.format(w=w)} FROM {w} JOIN n{k}_beside s ON s.lang IS NOT DISTINCT FROM {w}.lang AND s.r = {w}.r // {8 ** (k - 1)})"
    sql += f",\nv0 AS (SELECT w{levels}.doc_id, leaf, t0.h AS subroot, t0.r AS tr, f, p FROM w{levels} JOIN t0 ON t0.lang IS NOT DISTINCT FROM w{levels}.lang)"
    for k in range(1, top_levels + 1):
        w = f"v{k - 1}"
        sql += f",\nv{k} AS (SELECT {fold.format(w=w)} FROM {w} JOIN t{k}_beside s ON s.r = {w}.tr // {8 ** (k - 1)})"
    return sql.replace("*EXCLUDE", "* EXCLUDE") + f"\nSELECT doc_id, leaf, subroot, t.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM v{top_levels} CROSS JOIN t{top_levels} t"
