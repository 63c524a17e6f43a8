"""Conversation prefix trie with a pointer-jumping rollup.

1. Turns are reduced to a 120-bit digest and a word count. They are range-sorted by conversation and turn; a turn's place is
   its rank in its part plus what earlier parts hold of the conversation, so a conversation may span any number of parts.
2. A rebuilt conversation starts with up to HEAD - 1 turns of the first of its GROUP conversations. The digest of a prefix is the
   exclusive or of its turns' digests, each hashed with its place, again by ranks in a part and sums over parts.
3. A node is a distinct prefix digest; its parent's digest is its own without its last turn: digest-keyed edges.
4. Rollup by doubling: in round k a node holds the sums over its descendants nearer than 2^k and a pointer to its ancestor at
   distance 2^k. It adds the sums of the nodes that point at it and takes its pointer's pointer, so log2(depth) rounds
   carry leaves and savings to all ancestors. Hot pointers (the root, a common first turn) are met by `split_join`.
5. The ids of the conversations that end at a node are sorted in parts and written in chunks of CHUNK_IDS; a node of one chunk is
   hashed by SQL, one of more by a stream over its chunks, which holds one chunk at a time.

Defined cases: null role and text count as empty; a null turn sorts first; equal turns go by digest, then by place in
the input; repeated rows are turns of their own; rows without conv_id belong to no conversation; conv_id modulo GROUP keeps the
sign, as in SQL; an empty table has no node, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import WORD
from fieldloom.operators.joins import split_join
from fieldloom.session import stored

#: Every conversation of a GROUP starts with up to HEAD - 1 turns of the group's first (fixed by the contract).
GROUP, HEAD = 20, 4
CHUNK_IDS = 4096
#: Turns in a part of the sorted table, about.
PART_TURNS = 200_000
ROOT = (0, 0)


def digest(*columns: Column) -> tuple[Column, Column]:
    """Two 60-bit halves from the SHA-256 of the columns, each with its length before it."""
    own = F.concat(*[F.concat(F.octet_length(c), F.lit(":"), c) for c in columns])
    hexed = F.sha2(F.encode(own, "UTF-8"), 256)
    return tuple(F.conv(F.substring(hexed, 1 + 15 * i, 15), 16, 10).cast("long") for i in range(2))


def placed(at: Column, a: Column, b: Column) -> list[Column]:
    """The digest halves of a turn at a place."""
    return list(digest(at.cast("string"), a.cast("string"), b.cast("string")))


def before_parts(ranked: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """c_conv, c_part and the totals over all earlier parts of the conversation, for conversations of several parts."""
    per = ranked.groupBy("conv_id", "part").agg(*[c.alias(n) for n, c in totals.items()])
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    add = {n: (F.sum(n) if n == "n" else F.bit_xor(n)).over(earlier) for n in totals}
    return per.select(F.col("conv_id").alias("c_conv"), F.col("part").alias("c_part"), *[c.alias(n) for n, c in add.items()]).filter(F.col(next(iter(totals))).isNotNull())


def turns_in_order(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """conv_id, part, idx (from 1), a, b, words of every turn, stored; a part holds consecutive turns."""
    text, role = (F.coalesce(F.col(c), F.lit("")) for c in ("text", "role"))
    a, b = digest(role, text)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), a.alias("a"), b.alias("b"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()))
    parts = parts or max(1, -(-rows.count() // PART_TURNS))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("at")]
    rows = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    inside = Window.partitionBy("conv_id", "part").orderBy(*order[1:])
    ranked = rows.withColumn("idx", F.row_number().over(inside).cast("long"))
    more = before_parts(rows, {"n": F.count(F.lit(1))})
    # at most a row for each part: only a part's first conversation has earlier parts
    ranked = ranked.join(F.broadcast(more), (F.col("conv_id") == F.col("c_conv")) & (F.col("part") == F.col("c_part")), "left")
    return stored(ranked.select("conv_id", "part", (F.col("idx") + F.coalesce("n", F.lit(0))).alias("idx"), "a", "b", "words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every prefix of every rebuilt conversation (conv_id, depth, xa, xb, pa, pb, words: its digest, its parent's, its last
    turn's words), and every conversation with its length and the digest of its whole (conv_id, depth, xa, xb)."""
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = turns.filter((F.col("conv_id") % GROUP == 0) & (F.col("idx") < HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("idx", "a", "b", "words"))).alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % HEAD).cast("int")
    none = F.array().cast("array<struct<idx: bigint, a: bigint, b: bigint, words: bigint>>")
    convs = convs.withColumn("h", h).withColumn("base", base).join(heads, "base", "left")
    convs = stored(convs.select("conv_id", "n", "h", F.slice(F.coalesce("head", none), F.lit(1), F.col("h")).alias("head")))
    lead = F.transform("head", lambda t: F.struct(t["idx"].alias("depth"), *[c.alias(n) for n, c in zip(("da", "db"), placed(t["idx"], t["a"], t["b"]), strict=True)], t["words"].alias("words")))
    convs = convs.withColumn("lead", lead)
    both = lambda half: F.aggregate(F.col("lead"), F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(t[half]))
    convs = stored(convs.select("conv_id", "n", "h", "lead", both("da").alias("ha"), both("db").alias("hb")))
    # a conversation's own turns behind its first h, moved behind the head
    table = convs.select("conv_id", "n", "h", F.size("lead").alias("m"), "ha", "hb")
    total = convs.agg(F.sum("n")).first()[0] or 0
    own = split_join(turns, table, "conv_id", "n", total).filter(F.col("idx") > F.col("h"))
    own = own.withColumn("depth", F.col("idx") - F.col("h") + F.col("m"))
    da, db = placed(F.col("depth"), F.col("a"), F.col("b"))
    own = stored(own.select("conv_id", "part", "depth", "words", "ha", "hb", da.alias("da"), db.alias("db")))
    upto = Window.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    more = before_parts(own, {"ea": F.bit_xor("da"), "eb": F.bit_xor("db")})
    own = own.withColumns({"xa": F.bit_xor("da").over(upto), "xb": F.bit_xor("db").over(upto)})
    own = own.join(F.broadcast(more), (F.col("conv_id") == F.col("c_conv")) & (F.col("part") == F.col("c_part")), "left")
    whole = lambda x, head, earlier: F.col(x).bitwiseXOR(F.col(head)).bitwiseXOR(F.coalesce(earlier, F.lit(0)))
    own = own.select("conv_id", "depth", whole("xa", "ha", "ea").alias("xa"), whole("xb", "hb", "eb").alias("xb"), "da", "db", "words")
    upto_head = lambda half: F.aggregate(F.slice("lead", 1, F.col("t.depth").cast("int")), F.lit(0).cast("long"), lambda s, t: s.bitwiseXOR(t[half]))
    first = convs.select("conv_id", "lead", F.explode("lead").alias("t")).select("conv_id", "t.depth", upto_head("da").alias("xa"), upto_head("db").alias("xb"), "t.da", "t.db", "t.words")
    prefixes = first.unionByName(own)
    prefixes = stored(prefixes.select("conv_id", "depth", "xa", "xb", F.col("xa").bitwiseXOR(F.col("da")).alias("pa"), F.col("xb").bitwiseXOR(F.col("db")).alias("pb"), "words"))
    # the longest prefix of each; a conversation without turns ends at the root
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(x).cast("long").alias(c) for c, x in zip(("xa", "xb"), ROOT, strict=True)])
    deep = prefixes.select("conv_id", "depth", "xa", "xb").unionByName(roots).groupBy("conv_id").agg(F.max(F.struct("depth", "xa", "xb")).alias("end"))
    return prefixes, deep.select("conv_id", "end.*")


def _hashed(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each node's chunks, in order; a partition comes sorted by node."""
    node, state = None, None
    for batch in chunks:
        out = []
        for xa, xb, ids in zip(batch["xa"], batch["xb"], batch["ids"], strict=True):
            if (xa, xb) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (xa, xb), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["xa", "xb", "ends_sha256"])
    if node:
        yield pd.DataFrame([(*node, state.hexdigest())], columns=["xa", "xb", "ends_sha256"])


def end_hashes(ends: DataFrame, parts: int | None = None) -> DataFrame:
    """xa, xb, ends_sha256 of the nodes at which conversations end."""
    ends = stored(ends.select("xa", "xb", "conv_id"))
    parts = parts or max(1, -(-ends.count() // PART_TURNS))
    ends = stored(ends.repartitionByRange(parts, "xa", "xb", "conv_id").withColumn("part", F.spark_partition_id()))
    rank = F.row_number().over(Window.partitionBy("xa", "xb", "part").orderBy("conv_id"))
    chunk = ends.withColumn("chunk", F.floor((rank - 1) / CHUNK_IDS)).groupBy("xa", "xb", "part", "chunk")
    chunk = chunk.agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids"))
    chunks = stored(chunk)
    per = chunks.groupBy("xa", "xb").agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    one = per.filter("n = 1").select("xa", "xb", F.sha2("ids", 256).alias("ends_sha256"))
    many = chunks.join(per.filter("n > 1").select("xa", "xb"), ["xa", "xb"], "left_semi").repartition("xa", "xb").sortWithinPartitions("xa", "xb", "part", "chunk")
    return one.unionByName(many.select("xa", "xb", "ids").mapInPandas(_hashed, "xa long, xb long, ends_sha256 string"))


def rolled_up(nodes: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """nodes (key columns xa, xb, parent pa, pb; null at the root) with each value summed over its subtree.

    Logarithmic in the depth. A node's rows are small, and each round is stored, so a lost executor costs a round at most.
    """
    now = nodes.select("xa", "xb", F.col("pa").alias("ja"), F.col("pb").alias("jb"), *values)
    while True:
        now = stored(now)
        pointing = now.filter("ja is not null").groupBy("ja", "jb").agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).cast("long").alias(f"more_{v}") for v in values])
        pointing = stored(pointing)
        links = pointing.agg(F.sum("n")).first()[0]
        if not links:
            return now.drop("ja", "jb")
        targets = now.select(F.col("xa").alias("ja"), F.col("xb").alias("jb"), F.col("ja").alias("ka"), F.col("jb").alias("kb"))
        targets = targets.join(pointing.select("ja", "jb", "n"), ["ja", "jb"])
        moved = split_join(now.filter("ja is not null"), targets, ["ja", "jb"], "n", links).select("xa", "xb", F.col("ka").alias("ja"), F.col("kb").alias("jb"), *values)
        still = now.filter("ja is null").unionByName(moved)
        got = pointing.drop("n").withColumnsRenamed({"ja": "xa", "jb": "xb"})
        now = still.join(got, ["xa", "xb"], "left").select("xa", "xb", "ja", "jb", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])


def trie(conversations: DataFrame, parts: int | None = None) -> DataFrame:
    """A row per node, see the contract's columns. parts: of the sorted tables, by size if not given."""
    prefixes, ends = rebuilt(turns_in_order(conversations, parts))
    ends = stored(ends)
    inner = prefixes.groupBy("xa", "xb").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("words").alias("words"))
    null = F.lit(None).cast("long")
    root = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    root = root.select(*[F.lit(x).cast("long").alias(c) for c, x in zip(("xa", "xb"), ROOT, strict=True)], F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", null.alias("pa"), null.alias("pb"), F.lit(0).cast("long").alias("words"))
    nodes = stored(inner.unionByName(root))
    children = nodes.filter("pa is not null").groupBy(F.col("pa").alias("xa"), F.col("pb").alias("xb")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stored(nodes.join(children, ["xa", "xb"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own = nodes.select("xa", "xb", "pa", "pb", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"))
    sums = rolled_up(own, ("n_leaves", "saved_tokens"))
    whole = nodes.join(sums, ["xa", "xb"]).join(end_hashes(ends, parts), ["xa", "xb"], "left")
    whole = whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    named = nodes.filter("n_children > 0").select(F.col("xa").alias("pa"), F.col("xb").alias("pb"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    links = nodes.count()
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = split_join(whole.filter("pa is not null"), named.withColumnRenamed("n_children", "n_met"), ["pa", "pb"], "n_met", links)
    return inner.select(columns).unionByName(whole.filter("pa is null").withColumn("parent_conv_id", null).select(columns))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || strlen(coalesce(text, '')) || ':' || coalesce(text, ''))) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS v
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(v ORDER BY i) AS vs FROM t GROUP BY conv_id),
-- the unsigned CRC-32 of the decimal id, bit by bit
k AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS crc FROM c
  UNION ALL SELECT conv_id, s, i + 1, list_reduce(list_prepend(xor(crc, CAST(ascii(s[i + 1]) AS BIGINT)), [CAST(0 AS BIGINT) FOR x IN range(8)]), lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) FROM k WHERE i < length(s)),
h AS (SELECT conv_id, xor(crc, 4294967295) % 4 AS h FROM k WHERE i = length(s)),
r AS (SELECT c.conv_id, coalesce(b.vs[1 : h], []) || c.vs[h + 1 :] AS q FROM c JOIN h USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, q, unnest(range(0, len(q) + 1)) AS d FROM r),
n AS (SELECT q[1 : d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(q) = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
m AS (SELECT *, CASE WHEN d > 0 THEN node[1 : d - 1] END AS up, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(node[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own FROM n),
ch AS (SELECT up, count(*) AS n_children FROM m WHERE d > 0 GROUP BY up),
w AS (SELECT m.*, coalesce(n_children, 0) AS n_children FROM m LEFT JOIN ch ON ch.up = m.node),
a AS (SELECT node[1 : e] AS top, n_children, own FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM w)),
s AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum(own) AS BIGINT) AS saved_tokens FROM a GROUP BY top)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM w JOIN s ON s.top = w.node LEFT JOIN w u ON w.d > 0 AND u.node = w.up
"""
