"""The text operators on a small corpus with every odd case, against brute force, and on an empty table."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql.functions import spark_partition_id

from fieldloom.llm import chaining, contexttree, convnet, fingerprints, jaccardjoin, mixing, packing, quality, shingles, tokencounts, tokens, tokenstore
from fieldloom.session import scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BIG = 1 << 62
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, size long, uid long, block long, start long, row long, kept boolean, label int, id long, spans string, take int, last string, part int, sequence_id long"


def corpus() -> list[tuple]:
    rng = random.Random(3)
    words = ["".join(rng.choice(["th", "er", "on", "an", "re", "é", "sh"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(70)
    out = [None, "", " \n\t ", "one", "two words", "a\0b c", "Ünïcode — ‘quotes’ 中文 😀", "x" * 3000, "and " * 90, "and " * 70 + "end", text(9000), "tab\tand  two spaces \n", "<|endoftext|> text"]
    out += [text(rng.randint(5, 300)) for _ in range(30)]
    base = text(200).split(" ")
    for k in range(12):  # near copies
        copy = list(base)
        copy[rng.randrange(200)] = f"edit{k}"
        out.append(" ".join(copy))
    out += [out[20]] * 4 + [f"{text(40)} {passage} {text(30)}" for _ in range(5)]
    out += ["!! WORD$$$ %%% " * 40, "spam | spam | " * 50]
    # ids beyond the whole numbers that a float holds, beside null ids and repeated ones
    rows = [(i if i < 13 else BIG + i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(out)]
    rows += [(None, "a null id", "en", "s0"), (5, "two words", "en", "s1"), (5, "two words", "en", "s1")]
    return [(i, t, lang, s, len(t or ""), 0.5, "k", 1, 2, 3, 4, 5, True, 1, 6, "s", 7, "l", 8, 9) for i, t, lang, s in rows]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels_of(spark, rows):
    return spark.createDataFrame([(r[0], 0 if "$$$" in (r[1] or "") or "|" in (r[1] or "") else 1) for r in rows] + [(3, None), (3, 0), (999, 1)], "doc_id long, quality int")


def shingle_set(t: str, k: int = 5) -> set:
    w = WORD.findall(t)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def expected_ids(t: str | None, end: int) -> list[int]:
    enc = tokens.encoder(tokens.default_tokenizer()).whole
    return enc.encode(t or "", add_special_tokens=False).ids + [end]


def test_encoder_equals_the_library():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "é", "'s", "x1", "!", "　", "\x1c", "\x85", "ABC", "d'", "|", "<|endoftext|>", "中", "\0"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    e = tokens.encoder(tokens.default_tokenizer())
    assert [x.tolist() for x in e.encode(texts)] == [x.ids for x in e.whole.encode_batch(texts, add_special_tokens=False)]


def test_packing(spark, docs, rows, empty):
    got = packing.pack(packing.pieces(docs), partition_pieces=20).collect()
    want = Counter()
    for r in rows:
        ids = expected_ids(r[1], 2)
        first, begin = len(ids) % 1024 or 1024, 0
        for k, end in enumerate(range(first, len(ids) + 1, 1024)):
            want[r[0], k, begin, end - begin, zlib.crc32(np.array(ids[begin:end], "<u4").tobytes())] += 1
            begin = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.pieces(empty)).count() == 0
    assert packing.bounds(packing.pack(packing.pieces(docs), partition_pieces=20)).first().sequences == len(bins)


def test_packing_exchange(spark):
    """Few bins are full: the exchange must come near to best-fit decreasing over all pieces, and never above a round before."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(200, 700, 300)
    items = spark.createDataFrame([(str(i), 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    whole = len(packing.best_fit(lengths, 1024)[2])
    used = []
    for rounds in (1, 2, 3, 4, None):
        packed = packing.pack(items, partition_pieces=40, rounds=rounds)
        got = packed.collect()
        assert sorted(r.doc_id for r in got) == sorted(str(i) for i in range(300))
        bins = defaultdict(list)
        for r in got:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            ends = [o + n for o, n in sorted(b)]
            assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024
        known = packing.bounds(packed).first()
        assert known.sequences == len(bins) and known.lower_bound == packing.lower_bound(np.bincount(lengths, minlength=1025), 1024) <= len(bins)
        used.append(len(bins))
    assert used == sorted(used, reverse=True) and used[-1] <= whole + 1


def fewest_bins(lengths: list[int], capacity: int) -> int:
    """The optimum by exhaustive search."""
    best = len(lengths)

    def place(i: int, spaces: list[int]) -> None:
        nonlocal best
        if len(spaces) >= best:
            return
        if i == len(lengths):
            best = len(spaces)
            return
        for s in sorted(set(spaces)):
            if s >= lengths[i]:
                rest = list(spaces)
                rest.remove(s)
                place(i + 1, [*rest, s - lengths[i]])
        place(i + 1, [*spaces, capacity - lengths[i]])

    place(0, [])
    return best


def test_lower_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(9)
    met = 0
    for k in range(150):
        lengths = sorted(rng.integers(1 if k % 2 else 6, 20, 9).tolist(), reverse=True)
        best, bound = fewest_bins(lengths, 20), packing.lower_bound(np.bincount(lengths, minlength=21), 20)
        assert bound <= best <= len(packing.best_fit(np.array(lengths), 20)[2])
        met += bound == best
    assert met > 100


def test_best_fit_and_bounds():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = rng.integers(1, 20, 14)
        bins, offsets, left = packing.best_fit(n, 20)
        assert (np.bincount(bins, n, len(left)) + left == 20).all()
        bound = packing.lower_bound(np.bincount(n, minlength=21), 20)
        assert -(-n.sum() // 20) <= bound <= len(left)
    assert packing.lower_bound(np.bincount([11] * 7, minlength=21), 20) == 7


def test_token_store(spark, docs, rows, empty):
    path = scratch(spark)
    tokenstore.write_store(docs, path)
    assert len(tokenstore.verify_manifest(spark, path)) == 16
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in tokenstore.checksums(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [r[0] for r in order]
    at = 0
    for r in got:
        assert r[1] == at
        at += r[2]
    want = Counter((r[0], len(i := expected_ids(r[1], 0)), zlib.crc32(np.array(i, "<u4").tobytes())) for r in rows)
    assert Counter((r[0], r[2], r[3]) for r in got) == want
    back = Counter((r.doc_id, tuple(r.ids)) for r in tokenstore.read_documents(spark, path).collect())
    assert back == Counter((r[0], tuple(expected_ids(r[1], 0))) for r in rows)
    hashes = spark.read.parquet(f"{path}/chunks")
    assert hashes.count() == hashes.select("hash").distinct().count()
    nothing = scratch(spark)
    tokenstore.write_store(empty, nothing)
    tokenstore.verify_manifest(spark, nothing)
    assert tokenstore.checksums(spark, nothing).count() == 0


def test_token_store_with_a_hot_chunk(spark):
    """Half of all references name one chunk: they stay spread, and every document's ids come back."""
    rng = random.Random(8)
    texts = [(i, "" if i % 2 else " ".join(rng.choice(["red", "blue", "green"]) for _ in range(30)) + f" {i}") for i in range(6000)]
    path = scratch(spark)
    tokenstore.write_store(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), path)
    chunks = spark.read.parquet(f"{path}/chunks")
    named = tokenstore._refs(spark, path).groupBy("hash").count()
    assert chunks.join(named, "hash").filter("refs <> count").count() == 0 and chunks.count() == named.count()
    assert chunks.agg({"refs": "max"}).first()[0] == 3000 > tokenstore.LEAST_HOT
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        met = tokenstore.resolved(spark, path, lambda c: c.select("hash", "data"))
        sizes = sorted(r["count"] for r in met.groupBy(spark_partition_id()).count().collect())
        assert sum(sizes) == 6000 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in tokenstore.checksums(spark, path).collect()}
    assert got == {i: (len(x := expected_ids(t, 0)), zlib.crc32(np.array(x, "<u4").tobytes())) for i, t in texts}


def test_context_tree(spark, docs, rows, empty):
    got = contexttree.score_texts(docs, depth=3, block_bytes=20_000, buckets=5).collect()
    assert len(got) == len(rows) and contexttree.score_texts(empty).count() == 0
    low = lambda t: (t or "").translate({i: i + 32 for i in range(65, 91)})
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    words = Counter(w for r in rows if not held(r[0]) for w in [*WORD.findall(low(r[1])), "\0end"])
    n, v = sum(words.values()), len(words)
    want = Counter()
    for r in rows:
        ws = [*WORD.findall(low(r[1])), "\0end"]
        want[r[0], held(r[0]), len(ws), sum(words[w] > 0 for w in ws), n, round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in ws), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_context_tree_equals_recursion(spark, docs, rows):
    """The mixture's probability against a plain recursive context-tree weighting."""
    depth = 2
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    low = lambda t: (t or "").encode().lower()
    some = [r for r in rows if len(r[1] or "") < 400][:25]
    got = {(r.doc_id, r.n_bytes): r.score for r in contexttree.score_texts(spark.createDataFrame(some, SCHEMA), depth=depth, block_bytes=500, buckets=3).collect()}
    counts = defaultdict(lambda: [0, 0])

    def bits(t):
        data = bytes([255] * depth) + t + b"\xff"
        for i in range(depth, len(data)):
            node = 1
            for j in range(7, -1, -1):
                bit = data[i] >> j & 1
                yield node, data[i - depth : i], bit
                node = node * 2 + bit

    for r in some:
        if not held(r[0]):
            for node, ctx, bit in bits(low(r[1])):
                for d in range(depth + 1):
                    counts[node, ctx[depth - d :]][bit] += 1
    children = defaultdict(set)
    for node, ctx in list(counts):
        if ctx:
            children[node, ctx[1:]].add(ctx)
    lg = math.lgamma
    kt = lambda a, b: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(node, ctx):
        if (node, ctx) not in memo:
            own = kt(*counts.get((node, ctx), (0, 0)))
            memo[node, ctx] = own if len(ctx) == depth else np.logaddexp(own, sum(weighted(node, c) for c in children[node, ctx])) - math.log(2)
        return memo[node, ctx]

    def p(node, ctx, bit):
        value = None
        for d in range(depth, -1, -1):
            c = ctx[depth - d :]
            a = counts.get((node, c), (0, 0))
            own = (a[bit] + 0.5) / (sum(a) + 1)
            w = math.exp(kt(*a) - math.log(2) - weighted(node, c))
            value = own if d == depth else w * own + (1 - w) * value
        return value

    for r in some:
        want = sum(math.log10(p(*x)) for x in bits(low(r[1])))
        assert abs(got[r[0], len(low(r[1]))] - want) < 1e-3 * max(1, abs(want)), r[0]


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs, range_rows=7).collect()
    sizes = [len(WORD.findall(r[1] or "")) for r in rows]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((r[0] is None, r[0] or 0, s) for r, s in zip(rows, sizes, strict=True))
    total, per = sum(sizes), Counter()
    for r, s in zip(rows, sizes, strict=True):
        per[r[3]] += s
    names = sorted(per, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_ = {}, set(names)
    while True:
        level = (total - sum(target[s] for s in names if s not in open_)) / max(1e-9, sum(weight[s] for s in open_))
        over = {s for s in open_ if level * weight[s] > 3 * per[s]}
        target |= {s: level * weight[s] for s in open_ - over} | {s: 3 * per[s] for s in over}
        if not over:
            break
        open_ -= over
    taken = Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == per[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) < 1 for s in names)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len(WORD.findall(r.text))
    assert all(abs(words[s] - target[s]) < 1 for s in names)
    assert mixing.mix(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_quality_rules(spark, docs, rows, empty):
    got = quality.judged(docs, labels_of(spark, rows)).collect()
    want = Counter()
    for r in rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(grams)
        rep = len({j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep, len(w) < 10 or 100 * rep > 20 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(r.kept != r.base_failed for r in got)  # too few labels to certify a cutoff
    assert quality.judged(empty, labels_of(spark, rows)).count() == 0 and quality.judged(docs, labels_of(spark, rows).limit(0)).count() == len(rows)


def test_binomial_bound_and_cutoffs(spark):
    from pyspark.sql import functions as F

    t = spark.createDataFrame([(n, k) for n in (10, 300, 5000) for k in (0, 1, 7)], "n long, k long")
    for r in t.select("n", "k", quality.binomial_tail(F.col("n"), F.col("k"), 0.005).alias("p")).collect():
        want = sum(math.comb(r.n, i) * 0.005**i * 0.995 ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * 0.005 else 1.0
        assert abs(r.p - want) < 1e-9
    clean, junk = "these are plain words in a row of more than ten", "$$$ %%% &&& $$$ w x y z a b c d"
    many = spark.range(8000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") % 10 == 0, junk).otherwise(clean).alias("text"))
    marks = many.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    kept = {(r.doc_id % 10 == 0, r.kept) for r in quality.judged(many, marks).collect()}
    assert kept == {(True, False), (False, True)}


def test_fingerprints(spark, docs, rows, empty):
    got = fingerprints.edited_likeness(docs, range_bytes=20_000).collect()
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).digest()))
    want, likeness = Counter(), {}
    for k, (i, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest()] += 1
        a, b = shingle_set(t), shingle_set(edited)
        likeness[hashlib.sha256(edited.encode()).hexdigest(), len(t)] = len(a & b) / len(a | b) if a | b else 1.0
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(abs(r.near_edited - likeness[r.edited_sha256, r.n_chars]) < 0.25 for r in got)
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    assert all(prints[r.doc_id] == r.fingerprint for r in got if r.doc_id not in (5,))
    assert fingerprints.edited_likeness(empty).count() == 0 and fingerprints.fingerprints(empty).count() == 0


def plain_score(net, data: bytes) -> float:
    """The network by loops: every filter at every place of every chunk."""
    pooled = []
    for begin in range(0, max(1, len(data) - (convnet.CHUNK - convnet.STEP)), convnet.STEP):
        chunk = data[begin : begin + convnet.CHUNK].ljust(convnet.CHUNK, b"\0")
        best = np.full(convnet.FILTERS, -np.inf)
        for at in range(0, convnet.CHUNK - convnet.WIDTH + 1, convnet.STRIDE):
            x = np.concatenate([net.embed[c] for c in chunk[at : at + convnet.WIDTH]]).astype(float)
            best = np.maximum(best, x @ net.filters.astype(float))
        pooled.append(np.maximum(best + net.bias, 0))
    z = np.mean(pooled, axis=0) @ net.out.astype(float) + float(net.out_bias[0])
    return 1 / (1 + math.exp(-z))


def test_network_equals_loops_and_numeric_gradients(monkeypatch):
    rng = np.random.default_rng(4)
    net = convnet.Net.fresh(rng)
    net.bias += rng.normal(0, 0.2, net.bias.shape).astype(np.float32)
    net.out *= 3
    texts = [bytes(rng.integers(1, 256, n).astype(np.uint8)) for n in (0, 1, 100, 256, 257, 480, 481, 1500)]
    assert np.allclose(net.score(texts), [plain_score(net, t) for t in texts], atol=1e-5)
    good, weight = np.array([1, 0, 1, 0, 1, 0, 1, 0], np.float32), np.linspace(0.5, 2, 8)
    loss = lambda: float(np.mean([-w * math.log(p if g else 1 - p) for p, g, w in zip((plain_score(net, t) for t in texts), good, weight)]))
    whole = convnet.gradients(net, texts, good, weight)
    monkeypatch.setattr(convnet, "SLICE", 3)
    for a, b in zip(whole, convnet.gradients(net, texts, good, weight), strict=True):
        assert np.allclose(a, b, atol=1e-5)
    for name in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(float))
    for part, grad in zip(net.parts(), whole, strict=True):
        flat, g = part.reshape(-1), grad.reshape(-1)
        for i in np.argsort(-np.abs(g))[:3]:
            was, step = flat[i], 1e-6
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - g[i]) < 1e-4


def test_classifier_on_held_out_documents(spark):
    """Labels of the held-out fold change nothing; of that fold, junk goes and clean documents stay."""
    F, d = convnet.F, "/root/testdata/sf0.01"
    held = convnet.fold("doc_id", convnet.FOLDS) == convnet.HELD
    docs, marks = convnet.documents(spark, d), convnet.labels(spark, d)
    lied = marks.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    two = [convnet.fit(docs, m, sample=40) for m in (marks, lied)]
    assert all((a == b).all() for a, b in zip(two[0].parts(), two[1].parts(), strict=True))
    d = "/root/testdata/sf0.1"
    docs, marks = convnet.documents(spark, d), convnet.labels(spark, d)
    rows = convnet.with_score(docs, convnet.fit(docs, marks)).join(marks, "doc_id").filter(held).select("quality", "score").collect()
    junk, clean = [r.score for r in rows if r.quality == 0], [r.score for r in rows if r.quality == 1]
    assert np.mean(np.array(junk) < convnet.CUTOFF) > 0.9 and np.mean(np.array(clean) >= convnet.CUTOFF) > 0.97


def test_classifier(spark, docs, rows, empty):
    net = convnet.trained([("plain words here and more " * k).encode() for k in range(1, 30)] + [("$$$ %%% &&& " * k).encode() for k in range(1, 30)], np.array([1] * 29 + [0] * 29, np.float32), epochs=10)
    p = net.score([b"some plain words here", b"&&& $$$ %%% $$$ %%% &&& $$$", b""])
    assert p[0] > 0.7 > 0.5 > p[1] and 0 <= p[2] <= 1
    out = convnet.with_score(docs, net, "_s").collect()
    assert len(out) == len(rows) and all(0 <= r["_s"] <= 1 for r in out)
    assert convnet.fit(docs, labels_of(spark, rows).limit(0)) == 1.0 and convnet.accepted(empty, labels_of(spark, rows)).count() == 0
    assert convnet.accepted(docs, labels_of(spark, rows)).columns == docs.columns
    chunks = convnet.chunks_of(bytes(range(256)) * 5)
    assert set(chunks.ravel().tolist()) == set(range(256)) and (chunks[1][: convnet.CHUNK - convnet.STEP] == chunks[0][convnet.STEP :]).all()


def near_groups(rows):
    sets = [shingle_set(r[1] or "") for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = len(sets[i] & sets[j])
            if same or sets[i] and both >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    least = lambda g: min((x for x in g if x is not None), default=None)
    return Counter((rows[i][0], least(groups[root(i)]), links[i]) for i in range(len(rows))), len(groups)


@pytest.mark.parametrize("options", [{}, {"block": 4}])
def test_jaccard_join(spark, docs, rows, empty, options):
    want, groups = near_groups(rows)
    got = jaccardjoin.linked_documents(docs, **options).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == want
    if not options:
        left = jaccardjoin.one_of_each(docs)
        assert left.count() == groups and left.columns == docs.columns
        assert jaccardjoin.linked_documents(empty).count() == 0 and jaccardjoin.one_of_each(empty).count() == 0


def test_bayesian_floor():
    floor = jaccardjoin.least_matches(0.8, 1e-7, 240, 24)
    assert floor[24] < 0.8 * 24 and all(0 < k < 0.8 * n for n, k in floor.items())
    tail = sum(math.comb(25, i) * 0.8**i * 0.2 ** (25 - i) for i in range(floor[24]))
    assert tail < 1e-7


def test_near_duplicates_by_bands(spark, docs, rows):
    want, _ = near_groups(rows)
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in fingerprints.near_duplicates(docs).collect()) == want


def test_substring_dedup(spark, docs, rows, empty):
    found = chaining.passages(docs, block_bytes=20_000, buckets=3).collect()
    text = defaultdict(list)
    for r in rows:
        text[r[0]].append(WORD.findall(r[1] or ""))
    for r in found:
        assert r.end_word - r.start_word >= 50 and r.equal_words >= 0.8 * (r.end_word - r.start_word)
        assert any(len(set(a[r.start_word : r.end_word])) for a in text[r.doc_id])
    left = chaining.without_repeats(docs, block_bytes=20_000, buckets=3)
    assert left.columns == docs.columns
    windows = defaultdict(set)
    kept = left.collect()
    for n, r in enumerate(kept):
        w = WORD.findall(r.text or "")
        for i in range(len(w) - 49):
            windows[tuple(w[i : i + 50])].add(n)
    assert not [k for k, v in windows.items() if len(v) > 1]
    before, after = {r[0]: r[1] for r in rows if len(WORD.findall(r[1] or "")) < 50}, {r.doc_id: r.text for r in kept}
    assert all(after[i] == t for i, t in before.items() if i != 5)
    assert chaining.passages(empty).count() == 0 and chaining.without_repeats(empty).count() == 0


def test_passages_tiled_by_shorter_shared_parts(spark):
    rng = random.Random(11)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, passages = [], []
    for p in range(12):  # a passage in two documents, its parts of under 50 words in 24 others
        passage = text(60)
        passages.append(passage)
        docs = [text(20) + passage + text(20) for _ in range(2)]
        docs += [text(20) + passage[a:b] + text(20) for a, b in ((0, 35), (25, 60), (0, 40), (20, 60), (0, 30), (30, 60)) for _ in range(4)]
        rows += [(100 * p + i, " ".join(d)) for i, d in enumerate(docs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = chaining.passages(docs, block_bytes=20_000, buckets=3).collect()
    words = {i: t.split(" ") for i, t in rows}
    for p, passage in enumerate(passages):
        pair = {100 * p, 100 * p + 1}
        assert any({r.doc_id, r.ref_id} == pair and r.start_word <= 20 and r.end_word >= 80 for r in found)
    for r in found:
        a, b = words[r.doc_id][r.start_word : r.end_word], words[r.ref_id][r.ref_start : r.ref_end]
        assert len(a) >= 50 and (r.equal_words < len(a) or a == b)
    left = [" ".join(WORD.findall(r.text)) for r in chaining.without_repeats(docs, block_bytes=20_000, buckets=3).collect()]
    assert all(sum(" ".join(p) in t for t in left) == 1 for p in passages)


def test_chains_and_alignment():
    x = np.array([0, 5, 9, 20, 21, 400])
    y = np.array([100, 105, 3, 118, 119, 500])
    assert chaining.chains(x, y)[0] == [0, 1, 3, 4]
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 60, 200).astype(np.uint64)
    b = np.concatenate([a[:90], a[93:140], rng.integers(0, 1 << 60, 2).astype(np.uint64), a[140:]])
    cx, cy, equal = chaining.aligned(a, b, np.array([20, 60, 110, 160]), np.array([20, 60, 107, 159]))
    assert equal.sum() == 197 and (cx[0], cx[-1]) == (0, 199) and (a[cx[equal]] == b[cy[equal]]).all()
    assert chaining.alike(np.array([True] * 60 + [False] * 40 + [True] * 55)) == [(0, 60), (100, 155)]
    assert chaining.cut_words("a b  c\nd e", [(1, 3)]) == "a d e"


def test_token_counts(spark, docs, rows, empty, monkeypatch):
    blocks, order = tokencounts.write_tokens(docs, block=64)
    monkeypatch.setattr(tokencounts, "SCAN_GROUP", 5)
    got = tokencounts.scan(blocks).join(order, ["file", "place"]).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((r[0], len(expected_ids(r[1], 0))) for r in rows)
    blocks, order = tokencounts.write_tokens(empty)
    assert tokencounts.scan(blocks).count() == 0


def test_token_scan_on_bare_blocks(spark):
    rng = np.random.default_rng(0)
    blocks, want = [], []
    for f in range(3):
        x = np.ones(50, "<u2") if f == 1 else rng.choice([9, 1, 2], p=[0.1, 0.5, 0.4], size=700).astype("<u2")
        blocks += [(f, b // 7, bytearray(x[b : b + 7].tobytes())) for b in range(0, len(x), 7)]
        at = place = 0
        for i, v in enumerate(x):
            if v == 9:
                want.append((f, place, at, i + 1 - at))
                place, at = place + 1, i + 1
        if at < len(x):
            want.append((f, place, at, len(x) - at))
    got = tokencounts.scan(spark.createDataFrame(blocks, tokencounts.BLOCKS), separator=9).collect()
    assert sorted((r.file, r.place, r.start, r.n_tokens) for r in got) == sorted(want)


def test_word_hashes_tell_words_apart():
    raw = [t.encode() for t in ("a b a", "", "b\tab", "é é")]
    h, o = shingles.word_hashes(raw)
    assert o.tolist() == [0, 3, 3, 5, 7] and h[0] == h[2] and h[1] == h[3] and h[5] == h[6] and len(set(h.tolist())) == 4


def test_pipeline(spark, tmp_path, rows):
    import corpus_pipeline

    d = f"file://{tmp_path}"
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    labels_of(spark, rows).write.parquet(f"{d}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "substring_dedup", "source_mixing", "best_fit_packing"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, d)
        path = scratch(spark)
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns, name
    out = corpus_pipeline.run(spark, d)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0


def test_an_oversized_text_keeps_no_other_out_of_the_sample(spark):
    """With a text beyond the sample's bytes, wherever it comes in order, the net is the one learnt without it."""
    rng = random.Random(12)
    words = ["the", "of", "and", "reading", "water", "house"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(8)) if i % 2 else "$$ ## " * 8, 1 if i % 2 else 0) for i in range(80)]
    docs, marks = (lambda r: spark.createDataFrame([x[:2] for x in r], "doc_id long, text string")), (lambda r: spark.createDataFrame([(x[0], x[2]) for x in r], "doc_id long, quality int"))
    plain = convnet.fit(docs(rows), marks(rows), sample_bytes=12_000)
    assert isinstance(plain, convnet.Net)
    for big in range(4):
        more = [*rows, (1000 + big, "word " * 2000, big % 2)]
        net = convnet.fit(docs(more), marks(more), sample_bytes=12_000)
        assert all(np.array_equal(a, b) for a, b in zip(plain.parts(), net.parts(), strict=True))


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by the plain table."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


@pytest.mark.parametrize(("n", "rate", "even", "least"), [(60, 0.1, True, 0.9), (60, 0.1, False, 0.95), (100, 0.1, False, 0.95), (100, 0.15, False, 0.9), (200, 0.15, False, 0.95)])
def test_recall_of_fuzzy_passages(spark, n, rate, even, least):
    """Planted passages within IDENTITY are found, and what is found are alike stretches of both texts."""
    rng = random.Random(int(n * 100 * rate) + even)
    vocabulary = [f"w{i}" for i in range(2000)]
    words = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    rows, pairs = [], 60
    for i in range(pairs):
        base = words(n)
        copy = list(base)
        for at in range(4, n, round(1 / rate)) if even else rng.sample(range(n), int(n * rate)):
            copy[at] = "changed" + rng.choice(vocabulary)
        rows += [(2 * i, " ".join(words(80) + base + words(90))), (2 * i + 1, " ".join(words(120) + copy + words(40)))]
    texts = {i: t.split(" ") for i, t in rows}
    found = chaining.passages(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=20_000, buckets=3).collect()
    met = set()
    for r in found:
        own, ref = texts[r["doc_id"]][r["start_word"] : r["end_word"]], texts[r["ref_id"]][r["ref_start"] : r["ref_end"]]
        assert len(own) >= chaining.MIN_WORDS and r["n_words"] == len(texts[r["doc_id"]])
        assert r["equal_words"] <= common_words(own, ref) and r["equal_words"] >= chaining.IDENTITY * max(len(own), len(ref))
        assert r["doc_id"] // 2 == r["ref_id"] // 2
        met.add(r["doc_id"] // 2)
    assert len(met) >= least * pairs, len(met)
