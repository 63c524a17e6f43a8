"""Token ids as a content-addressed store.

Layout of a store, all Parquet in one folder that every executor sees:
  chunks/    hash (16 bytes), data (ids, little-endian, `width` bytes each), refs (how often recipes name it); every distinct chunk once
  recipes/   part, pos, doc_id, inner_start, n_tokens, chunks (hashes, 16 bytes each), root; ascending by doc_id
  manifest/  part, part_start, docs, tokens, root, and store_root, the Merkle root over the parts' roots

A rolling hash over the last ids cuts each document's ids into chunks, so equal passages give equal chunks
wherever they stand. A document's root is the Merkle root of its chunk hashes, a part's that of its
documents' roots. Reading checks every chunk against its hash and every recipe against its root, and fails loudly.
Checksums of documents are combined from their chunks' checksums, so a check moves no ids between tasks.

Defined cases: null or empty text is the end id alone; a null id sorts first; repeated ids and rows are documents of
their own, ordered by id, then by content; an empty table is an empty store; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm.common import bounded, documents, id_text, text_of, with_ids
from fieldloom.llm.tokens import default_tokenizer, encoder
from fieldloom.operators.joins import LEAST_HOT, MOST_HOT
from fieldloom.session import scratch, stored

#: Chunks of MIN to MAX ids, cut where the rolling hash of the last WINDOW ids begins with the bits of MASK zero.
MIN, MAX, WINDOW, MASK = 64, 2048, 8, 0xFF
#: Rows of recipes a part holds about.
PART_ROWS = 100_000
HASH_BYTES = 16


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH_BYTES).digest()


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node moves up unchanged; of nothing, the digest of nothing."""
    if not hashes:
        return digest(b"")
    while len(hashes) > 1:
        hashes = [digest(b"".join(hashes[i : i + 2])) if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that near ids get unrelated values."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def gears() -> np.ndarray:
    """The values of all 16-bit ids."""
    return (mixed(np.arange(1 << 16)) >> np.uint64(32)).astype(np.uint32)


def cuts(ids: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """For documents that begin at `starts` in ids (the last entry is the end): the ends of their chunks."""
    gear = gears()[ids] if ids.dtype == np.uint16 else (mixed(ids) >> np.uint64(32)).astype(np.uint32)
    roll = gear.copy()
    for k in range(1, WINDOW):
        roll[k:] += gear[:-k] << np.uint32(k)
    at = np.flatnonzero(roll < np.uint32((1 << 32) // (MASK + 1))) + 1  # the highest bits of all WINDOW ids
    first = np.searchsorted(at, starts)
    out = []
    for d in range(len(starts) - 1):
        begin, end = int(starts[d]), int(starts[d + 1])
        ends, last = [], begin
        for c in at[first[d] : first[d + 1]].tolist():
            while c - last > MAX:
                last += MAX
                ends.append(last)
            if c - last >= MIN:  # so no window reaches over the document's start
                ends.append(c)
                last = c
        while end - last > MAX:
            last += MAX
            ends.append(last)
        if end > last:
            ends.append(end)
        out.append(ends)
    return out


def _chunked(tokenizer: str, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sent = encoder(tokenizer), {}  # chunk: how often it came again
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                end = np.array([end_id], dtype=enc.dtype)
                docs = [np.concatenate([x, end]) for x in enc.encode(part["text"].tolist())]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in docs])])
                ids = np.concatenate(docs)
                raw, width = ids.tobytes(), ids.dtype.itemsize
                chunks, recipes = [], []
                for begin, ends in zip(starts.tolist(), cuts(ids, starts), strict=False):
                    names = []
                    for e in ends:
                        data = raw[begin * width : e * width]
                        names.append(h := digest(data))
                        if h in sent:
                            sent[h] += 1
                        else:
                            sent[h] = 0
                            chunks.append((h, data))
                        begin = e
                    recipes.append(b"".join(names))
                if len(sent) > 200_000:  # this only saves work: the store makes chunks unique
                    yield repeats(sent)
                    sent.clear()
                yield pd.DataFrame({"kind": "recipe", "doc_id": part["doc_id"].to_numpy(), "n_tokens": np.diff(starts), "hash": None, "data": recipes})
                yield pd.DataFrame({"kind": "chunk", "doc_id": None, "n_tokens": 1, "hash": [h for h, _ in chunks], "data": [x for _, x in chunks]})
        yield repeats(sent)

    def repeats(sent: dict) -> pd.DataFrame:
        again = [(h, n) for h, n in sent.items() if n]
        return pd.DataFrame({"kind": "repeat", "doc_id": None, "n_tokens": [n for _, n in again], "hash": [h for h, _ in again], "data": None})

    return run


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Recipes of one sorted part: places, running starts and roots."""
    part, pos, start = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b["n_tokens"].to_numpy(dtype=np.int64)
        ends = start + np.cumsum(n)
        names = [bytes(x) for x in b["chunks"]]
        roots = [merkle([x[i : i + HASH_BYTES] for i in range(0, len(x), HASH_BYTES)]) for x in names]
        yield pd.DataFrame({"part": part, "pos": np.arange(pos, pos + len(b)), "doc_id": b["doc_id"], "inner_start": ends - n, "n_tokens": n, "chunks": names, "root": roots})
        pos, start = pos + len(b), int(ends[-1]) if len(b) else start


RECIPES = "part int, pos long, doc_id long, inner_start long, n_tokens long, chunks binary, root binary"
PARTS = "part int, part_start long, docs long, tokens long, root binary"


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("pos")
    root = merkle([bytes(x) for x in rows["root"]])
    return pd.DataFrame({"part": [rows["part"].iloc[0]], "part_start": [0], "docs": [len(rows)], "tokens": [int(rows["n_tokens"].sum())], "root": [root]})


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encode every text, append end_id to each document and write the store under path."""
    spark = docs.sparkSession
    bounded(spark)
    rows = docs.select(id_text(), text_of().alias("text"))
    kinds = "kind string, doc_id string, n_tokens long, hash binary, data binary"
    staged = stored(rows.mapInPandas(_chunked(tokenizer or default_tokenizer(), end_id), kinds), "kind")
    unique = staged.filter("kind <> 'recipe'").groupBy("hash").agg(F.first("data", ignorenulls=True).alias("data"), F.sum("n_tokens").alias("refs"))
    unique.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = staged.filter("kind = 'recipe'").select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens", F.col("data").alias("chunks"))
    parts = max(1, -(-recipes.count() // PART_ROWS))
    order = [F.col("doc_id").asc_nulls_first(), F.col("chunks").asc()]
    ranged = recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = ranged.withColumn("doc_id", id_text()).mapInPandas(_placed, RECIPES.replace("doc_id long", "doc_id string"))
    with_ids(placed, "doc_id").write.option("compression", "zstd").parquet(f"{path}/recipes")
    per = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", "pos", "n_tokens", "root").groupBy("part").applyInPandas(_summed, PARTS)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    per = stored(per.withColumn("part_start", F.coalesce(F.sum("tokens").over(before), F.lit(0))))
    top = merkle([bytes(r["root"]) for r in per.select("part", "root").orderBy("part").toLocalIterator()])
    per.withColumn("store_root", F.lit(bytearray(top))).write.parquet(f"{path}/manifest")


def verify_manifest(spark: SparkSession, path: str) -> bytes:
    """The store's root, after the parts' roots were computed again from the recipes; raises on a difference."""
    kept = {r["part"]: (r["docs"], r["tokens"], bytes(r["root"])) for r in spark.read.parquet(f"{path}/manifest").toLocalIterator()}
    per = spark.read.schema(RECIPES).parquet(f"{path}/recipes").groupBy("part").applyInPandas(_summed, PARTS)
    again = {r["part"]: (r["docs"], r["tokens"], bytes(r["root"])) for r in per.toLocalIterator()}
    if kept != again:
        raise ValueError(f"the manifest of {path} doesn't match its recipes")
    return merkle([again[p][2] for p in sorted(again)])


def _references(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each chunk of each recipe; the recipe is held against its root first."""
    for b in batches:
        names = [[x[i : i + HASH_BYTES] for i in range(0, len(x), HASH_BYTES)] for x in map(bytes, b["chunks"])]
        for own, root in zip(names, b["root"], strict=True):
            if merkle(own) != bytes(root):
                raise ValueError("a recipe doesn't match its root")
        n = [len(x) for x in names]
        keys = {c: np.repeat(b[c].to_numpy(), n) for c in ("part", "pos")}
        yield pd.DataFrame(keys | {"idx": np.concatenate([np.arange(x) for x in n]) if n else [], "hash": [h for own in names for h in own]})


def _checked(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [bytes(x) for x in b["data"]]
            if any(digest(x) != bytes(h) for x, h in zip(data, b["hash"], strict=True)):
                raise ValueError("a chunk doesn't match its hash")
            wide = [np.frombuffer(x, dtype=f"<u{width}").astype("<u4").tobytes() for x in data]
            yield pd.DataFrame({"hash": b["hash"], "length": [len(x) // 4 for x in wide], "crc": [zlib.crc32(x) for x in wide]})

    return run


def _shift_tables() -> list[np.ndarray]:
    """For k from 0: tables by which a CRC-32 moves over 2**k zero bytes, one of 256 values for each of its bytes."""
    def tables(columns: list[int]) -> np.ndarray:
        out = np.zeros((4, 256), dtype=np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte] ^= np.where(np.arange(256) >> bit & 1, np.uint32(columns[8 * byte + bit]), np.uint32(0))
        return out

    # one zero byte: zlib's CRC of a zero byte, with its conditioning undone
    columns = [zlib.crc32(b"\0", (1 << j) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for j in range(32)]
    zero = zlib.crc32(b"\0", 0xFFFFFFFF) ^ 0xFFFFFFFF
    columns = [c ^ zero for c in columns]
    found = []
    for _ in range(44):
        found.append(tables(columns))
        columns = shifted(np.array(columns, dtype=np.uint32), found[-1]).tolist()
    return found


def shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


def combined(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Each chunk's CRC-32 moved over the bytes after it; the exclusive or over a document is the document's CRC-32."""
    crc, after = crc.astype(np.uint32), after.astype(np.int64)
    for k, table in enumerate(_shift_tables()):
        if not (after >> k).any():
            break
        on = (after >> k & 1).astype(bool)
        crc = np.where(on, shifted(crc, table), crc)
    return crc


def _documents_crc(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if not len(b):
            continue
        rows = [sorted((r["idx"], r["length"], r["crc"]) for r in own) for own in b["refs"]]
        flat = np.array([x for own in rows for x in own], dtype=np.int64)
        n = np.array([len(x) for x in rows])
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        ends = np.cumsum(flat[:, 1])
        total = np.add.reduceat(flat[:, 1], first)
        after = np.repeat(ends[first] - flat[first, 1] + total, n) - ends
        crc = np.bitwise_xor.reduceat(combined(flat[:, 2], 4 * after), first)
        if (total != b["n_tokens"].to_numpy()).any():
            raise ValueError("a recipe's chunks don't make up its document")
        yield pd.DataFrame({"doc_id": b["doc_id"], "start": b["start"], "n_tokens": total, "ids_crc32": crc.astype(np.int64)})


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.parquet(f"{path}/manifest").select("part", "part_start")
    rows = spark.read.schema(RECIPES).parquet(f"{path}/recipes").join(parts, "part")
    return rows.withColumn("start", F.col("part_start") + F.col("inner_start"))


def _refs(spark: SparkSession, path: str) -> DataFrame:
    refs = spark.read.schema(RECIPES).parquet(f"{path}/recipes").select("part", "pos", "chunks", "root")
    return refs.mapInPandas(_references, "part int, pos long, idx long, hash binary")


def resolved(spark: SparkSession, path: str, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """part, pos, idx of every reference with `read`'s columns of its chunk, null where the store lacks it.

    Chunks with very many references, a bounded number, are broadcast; their references then join on a key of their own that no
    chunk has, so they stay spread.
    """
    chunks = spark.read.schema("hash binary, data binary, refs long").parquet(f"{path}/chunks")
    limit = max(LEAST_HOT, (chunks.agg(F.sum("refs")).first()[0] or 0) // MOST_HOT)
    hot, cold = read(chunks.filter(F.col("refs") > limit)), read(chunks.filter(F.col("refs") <= limit))
    names = [c for c in hot.columns if c != "hash"]
    met = _refs(spark, path).join(F.broadcast(hot.select("hash", F.struct(*names).alias("found"))), "hash", "left")
    own = F.unhex(F.md5(F.concat_ws(",", "part", "pos", "idx")))
    met = met.withColumn("hash", F.when(F.col("found").isNull(), F.col("hash")).otherwise(own))
    met = met.join(cold.select("hash", F.struct(*names).alias("other")), "hash", "left").withColumn("found", F.coalesce("found", "other"))
    return met.select("part", "pos", "idx", *[F.col(f"found.{c}").alias(c) for c in names])


def checksums(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, from its files, everything verified."""
    met = resolved(spark, path, lambda chunks: chunks.select("hash", "data").mapInPandas(_checked(width), "hash binary, length long, crc long"))
    per = met.groupBy("part", "pos").agg(F.collect_list(F.struct("idx", "length", "crc")).alias("refs"))
    rows = _recipes(spark, path).select("part", "pos", "doc_id", "start", "n_tokens").join(per, ["part", "pos"])
    return with_ids(rows.select(id_text(), "start", "n_tokens", "refs").mapInPandas(_documents_crc, "doc_id string, start long, n_tokens long, ids_crc32 long"), "doc_id")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and the ids themselves, put together from the chunks."""
    met = resolved(spark, path, lambda chunks: chunks.select("hash", "data")).groupBy("part", "pos").agg(F.collect_list(F.struct("idx", "data")).alias("refs"))
    rows = _recipes(spark, path).select("part", "pos", "doc_id", "start", "n_tokens").join(met, ["part", "pos"])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [np.frombuffer(b"".join(r["data"] for r in sorted(own, key=lambda r: r["idx"])), dtype=f"<u{width}").astype(np.int64) for own in b["refs"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "start": b["start"], "n_tokens": b["n_tokens"], "ids": ids})

    return with_ids(rows.select(id_text(), "start", "n_tokens", "refs").mapInPandas(joined, "doc_id string, start long, n_tokens long, ids array<long>"), "doc_id")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_store(documents(spark, sf_dir), path)
    verify_manifest(spark, path)
    return checksums(spark, path)
