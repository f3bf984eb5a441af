"""Merkle manifest of a dataset: a hash tree per group of rows and one tree over the groups.

A leaf is the digest of a row.  Leaves of a group stand in order; a tree joins
every ``FAN`` consecutive nodes of a level to a parent until one is left.  The
levels are kept as concatenated strings: an aligned block of ``FAN`` squared
nodes is one string of hexadecimal digests, 64 characters each.  Fixed-width
substrings of a level are the runs, their digests laid end to end are the next
level, and the characters before and after a node in its run are its siblings.
A block so ends in one digest, which is a node of the next round's blocks, and
rounds go on until every group has one node.  All of it is SQL functions.

Leaves are numbered without any group in one task: rows are range-partitioned
by (group, order, leaf), numbered within partitions, and the partitions' counts
per group give the offsets.  A group of a third of all rows spans partitions.

Defined cases: a null value of any column is hashed as ``-``; null groups come
first and are one group; null ids come first in their group.  Rows of one id
stand in order of their leaves; equal leaves are interchangeable.  An empty
table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trialframe.llm.common import shared_table, table

FAN = 16
HEX = 64                  # characters of a digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def record(columns: list[Column]) -> Column:
    """The text that a leaf hashes: ``-`` for null, else the length in bytes, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def group_key(group: Column) -> Column:
    """A key without nulls in the order of the groups, nulls first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``g``) and ``idx``, the place of each row in its group by ``order``, and ``n``, the group's rows.

    Rows equal in ``order`` are dealt by a hash of their place in the table,
    which is written, so that repeated rows do not fall into one partition.
    """
    rows = shared_table(rows, "leaves").withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    rows = rows.repartitionByRange(*[F.asc_nulls_first(c) for c in ("g", *order, "tie")])
    rows = rows.sortWithinPartitions(*[F.asc_nulls_first(c) for c in ("g", *order, "tie")]).drop("tie")
    place = F.monotonically_increasing_id()
    rows = shared_table(rows.withColumn("part", F.shiftright(place, 33))
                        .withColumn("at", place.bitwiseAND((1 << 33) - 1)), "ordered")
    parts = rows.groupBy("g", "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("g", "part", F.sum("rows").over(Window.partitionBy("g")).alias("n"),
                         (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return rows.join(parts, ["g", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def cut(level: str, i: str, nodes: int) -> str:
    """SQL of the i-th substring of ``nodes`` nodes of a level."""
    return f"substring({level}, {i} * {nodes * HEX} + 1, {nodes * HEX})"


def blocks(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of nodes ``g, n, idx, h``: their two levels as strings, ``keep`` of each node, the block's digest ``top``.

    ``n`` is the number of nodes of the group: one node is the group's root and
    is not hashed again, and a group of at most ``FAN`` nodes has one level.
    """
    size = FAN * FAN
    kept = ", ".join(["x.idx AS idx", *(f"x.{c} AS {c}" for c in keep)])
    got = nodes.groupBy("g", F.expr(f"idx div {size}").alias("block")).agg(
        F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("idx", F.col("h").alias("node"), *keep))).alias("nodes"))
    got = got.select("g", "block", "n", F.expr("concat_ws('', transform(nodes, x -> x.node))").alias("level0"),
                     F.expr(f"transform(nodes, x -> struct({kept}))").alias("items"))
    runs = f"sequence(0, (length(level0) - 1) div {FAN * HEX})"
    got = got.withColumn("level1", F.expr(f"concat_ws('', transform({runs}, i -> sha2({cut('level0', 'i', FAN)}, 256)))"))
    return got.withColumn("top", F.expr(
        f"CASE WHEN n = 1 THEN level0 WHEN n <= {FAN} THEN level1 ELSE sha2(level1, 256) END"))


def sides(level: str, i: str) -> str:
    """SQL of the siblings of the i-th node of a level: the characters before and after it."""
    return f"struct(substring({level}, 1, {i} * {HEX}) AS left, substring({level}, ({i} + 1) * {HEX} + 1) AS right)"


def paths(tree: DataFrame, above: DataFrame) -> DataFrame:
    """``g, item, path`` of every node of a round: (left, right) siblings level by level up to the root.

    ``above`` holds ``g, idx, path`` of the blocks as nodes of the next round; its other columns come along.
    """
    more = [c for c in above.columns if c not in ("g", "idx", "path")]
    own = tree.join(above.select("g", F.col("idx").alias("block"), F.col("path").alias("above"), *more), ["g", "block"])
    # Runs first, then their nodes: a row carries the string of its run, not that of its block.
    run = own.select("g", "n", "above", *more, F.explode(F.expr(
        f"transform(sequence(0, (length(level0) - 1) div {FAN * HEX}), i -> struct({cut('level0', 'i', FAN)} AS nodes, "
        f"slice(items, i * {FAN} + 1, {FAN}) AS items, {sides('level1', 'i')} AS parent))")).alias("run"))
    run = run.select("g", "n", *more, F.col("run.nodes").alias("nodes"), F.col("run.items").alias("items"), F.concat(F.expr(
        f"CASE WHEN n > {FAN} THEN array(run.parent) ELSE cast(array() AS {STEP}) END"), "above").alias("above"))
    node = run.select("g", "n", "nodes", "above", *more, F.posexplode("items").alias("i", "item"))
    step = F.expr(f"CASE WHEN n > 1 THEN array({sides('nodes', 'i')}) ELSE cast(array() AS {STEP}) END")
    return node.select("g", "item", F.concat(step, "above").alias("path"), *more)


def build(nodes: DataFrame, keep: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """(the rounds' blocks, bottom first, and ``g, root``) of nodes ``g, n, idx, h``."""
    rounds = [shared_table(blocks(nodes, keep), "level")]
    most = rounds[0].agg(F.max("n")).first()[0] or 0
    while most > FAN * FAN:
        nodes = rounds[-1].select("g", F.expr(f"(n + {FAN * FAN - 1}) div {FAN * FAN}").alias("n"),
                                  F.col("block").alias("idx"), F.col("top").alias("h"))
        rounds.append(shared_table(blocks(nodes), "level"))
        most = -(-most // (FAN * FAN))
    return rounds, rounds[-1].select("g", F.col("top").alias("root"))


def all_paths(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the lowest nodes; ``above`` holds ``g, path`` of the groups themselves, and columns to pass on."""
    got = above.withColumn("idx", F.lit(0).cast("bigint"))
    for i, tree in enumerate(reversed(rounds)):
        got = paths(tree, got)
        if i < len(rounds) - 1:
            got = got.withColumn("idx", F.col("item.idx")).drop("item")
    return got


def proof(path: Column) -> Column:
    """All siblings, level by level, left to right."""
    return F.concat_ws("", F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def manifest(df: DataFrame, id_col: str, group_col: str, columns: list[str],
             tampered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """``id, leaf, subroot, root, path, candidate`` of every row.

    ``columns`` are hashed in this order.  ``candidate`` is the leaf to verify:
    that of the row with the ``tampered`` columns put in where ``when`` is
    true, else the leaf itself; ``folded(candidate, path)`` must be ``root``.
    """
    own = digest(record([F.col(c) for c in columns]))
    other = digest(record([(tampered or {}).get(c, F.col(c)) for c in columns]))
    rows = df.select(F.col(id_col).alias("id"), group_key(F.col(group_col)).alias("g"), own.alias("leaf"),
                     (F.when(when, other) if when is not None else F.lit(None).cast("string")).alias("changed"))
    leaves = numbered(rows, ["id", "leaf"])
    rounds, subroots = build(leaves.withColumnRenamed("leaf", "h").withColumn("leaf", F.col("h")), ("id", "leaf", "changed"))
    # The groups are the leaves of one more tree.
    groups = numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("h")), ["name"])
    top, root = build(groups, ("name", "h"))
    above = all_paths(top, root.withColumn("path", F.expr(f"cast(array() AS {STEP})")))
    above = shared_table(above.select(F.col("item.name").alias("g"), F.col("item.h").alias("subroot"), "root", "path"), "above")
    return all_paths(rounds, above).select(
        F.col("item.id").alias("id"), F.col("item.leaf").alias("leaf"), "subroot", "root", "path",
        F.coalesce("item.changed", "item.leaf").alias("candidate"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = manifest(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"],
                    {"text": F.translate("text", UPPER, LOWER)}, crc % 5 == 0)
    rows = rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", digest(proof(F.col("path"))).alias("proof_sha256"),
                       folded(F.col("candidate"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_sql(levels: int = 8) -> str:
    """``levels`` levels of joins: enough for 16 to that power of rows a group, and of groups."""
    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text))

    def tree(name: str) -> list[str]:
        out = []
        for k in range(levels):
            run = "PARTITION BY g, i // 16 ORDER BY i ROWS BETWEEN"
            out += [f"""{name}_s{k} AS (SELECT g, i, n > 1 AS live,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
  FROM {name}_{k})""", f"""{name}_{k + 1} AS (SELECT g, i // 16 AS i,
  CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (n + 15) // 16 AS n
  FROM {name}_{k} GROUP BY g, i // 16, n)"""]
        return out

    def climb(name: str, walk: str) -> list[str]:
        return [f"""{walk}_{k + 1} AS (SELECT t.* REPLACE (t.i // 16 AS i, t.proof || s.l || s.r AS proof,
  CASE WHEN s.live THEN sha256(s.l || t.f || s.r) ELSE t.f END AS f) FROM {walk}_{k} t JOIN {name}_s{k} s USING (g, i))"""
                for k in range(levels)]

    steps = [
        """bits(i, k, c) AS (SELECT range, 0, CAST(range AS UBIGINT) FROM range(256) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bits WHERE k < 8)""",
        "crc_table AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)",
        """keyed AS (SELECT *, coalesce('=' || source, '') AS g, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
  lambda x: CAST(ascii(x) AS UBIGINT)) AS bytes FROM documents)""",
        f"""hashed AS (SELECT doc_id, g, sha256({leaf('text')}) AS leaf, CASE WHEN xor(list_reduce(
    list_prepend(4294967295::UBIGINT, bytes), lambda c, b: xor(c >> 8, tab[CAST((xor(c, b) & 255) + 1 AS INTEGER)])),
    4294967295::UBIGINT) % 5 = 0 THEN sha256({leaf(f"translate(text, '{UPPER}', '{LOWER}')")}) END AS changed
  FROM keyed, crc_table)""",
        """leaf_0 AS (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
  count(*) OVER (PARTITION BY g) AS n FROM hashed)""", *tree("leaf"),
        f"""group_0 AS (SELECT '' AS g, g AS name, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n
  FROM leaf_{levels})""", *tree("group"),
        "up_0 AS (SELECT doc_id, leaf, g, i, coalesce(changed, leaf) AS f, '' AS proof FROM leaf_0)", *climb("leaf", "up"),
        f"""over_0 AS (SELECT u.doc_id, u.leaf, b.h AS subroot, '' AS g, b.i, u.f, u.proof
  FROM up_{levels} u JOIN group_0 b ON b.name = u.g)""", *climb("group", "over")]
    return "WITH RECURSIVE " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM over_{levels} o, group_{levels} t"""
