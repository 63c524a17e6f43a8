"""Substring dedup by collinear chaining: long passages that documents share, also with small changes.

1. Seeds: of the hashes of all runs of K words, the least of every WINDOW neighbours (winnowing), so any WINDOW+K-1 equal
   words in a row share a seed; short runs and narrow windows find passages with many changes too. A block of texts sends each
   distinct seed once, with the first document (in the order of a hash of the document) that holds it.
2. A bucket of seeds finds the first document of all that holds a seed, the reference, and answers the blocks whose
   documents share it. So a passage in any number of documents costs a row for each block, and no pairs are made.
3. In its block a document's matches with one reference are chained: a match follows another if it lies behind it in
   both texts, at a cost for the words between; the best predecessor comes from a Fenwick tree over the reference's places.
   A chain of one match counts only if BESIDE of the NEAR words around it agree (4 bits of each travel with the seed): chance
   matches of common words end here.
4. The reference's words around a chain are fetched in tiles, each tile once for each block, and the chain is aligned: gaps between
   its matches are closed by the best single shift and both ends are extended while words agree. Stretches of MIN_WORDS
   words with IDENTITY of them equal are the result.
5. A passage whose every seed has another first document is seen by no chain. So a block also lists its windows of MIN_WORDS words
   that hold no seed of one document alone; those outside the passages of step 4 meet by their hash, and all but the first
   document that holds such a window report it. So of exact passages none is lost.

Defined cases: null or empty text and texts under MIN_WORDS words have no passages; rows equal in id and text are one document;
a document's repetitions of itself don't count; ties go to the least document hash, then to the first place; an
empty table gives an empty result; extra columns are ignored (and kept by `without_repeats`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from fieldloom.llm.common import WORD, blocks_for, bounded, documents, id_text, text_of, whole_row, with_ids
from fieldloom.llm.shingles import _power_tables, mixed, shingle_hashes, slices, word_hashes
from fieldloom.session import stored

K, WINDOW = 6, 10
MIN_WORDS, IDENTITY = 50, 0.8
#: Words between two matches of a chain that use up the worth of a match, counted in both texts together.
GAP_WORDS = 80
#: Extending stops when it has lost this many words against its best.
DROP = 8
#: Words beside a seed whose hashes travel with it, before and after it, and how many must agree for a match on its own.
NEAR, BESIDE = (-2, -1, K, K + 1), 2
#: Words around a chain that are looked at, and words in a tile of a reference.
MARGIN, TILE = 128, 128
BLOCK_BYTES, BUCKETS = 4 << 20, 64


def winnowed(values: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places (in values) of the leftmost least value of every window of each text; a shorter text has one window."""
    n = len(values)
    if not n:
        return np.zeros(0, np.int64)
    far = np.full(window - 1, np.iinfo(np.uint64).max, np.uint64)
    wide = np.lib.stride_tricks.sliding_window_view(np.concatenate([values, far]), window)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    end = offsets[owner + 1]
    begin = np.arange(n)
    inside = (begin + window <= end) | (begin == offsets[owner])  # windows that lie in their text, or a short text's only one
    picks = np.flatnonzero(inside)
    best = np.empty(len(picks), np.int64)
    for at in range(0, len(picks), 1 << 17):
        part = picks[at : at + (1 << 17)]
        view = wide[part]
        short = part + window > end[part]
        if short.any():
            view = view.copy()
            view[part[:, None] + np.arange(window) >= end[part][:, None]] = np.iinfo(np.uint64).max
        best[at : at + len(part)] = part + view.argmin(axis=1)
    return np.unique(best)


def seeds(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By slices of texts: first index, word hashes and offsets; seeds, their text (in the slice) and word place in it."""
    for first, raw in slices(texts):
        words, offsets = word_hashes(raw)
        values, out, place = shingle_hashes(words, offsets, K)
        long = np.repeat(np.diff(offsets) >= K, np.diff(out))
        picks = winnowed(values, out)
        picks = picks[long[picks]]
        owner = np.searchsorted(out, picks, side="right") - 1
        yield first, words, offsets, *run_heads(values[picks], owner, place[picks] - offsets[owner])


def run_heads(seed: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a seed that comes again within K words, again and again (a word or short phrase repeated), only the first.

    A repetition of MIN_WORDS words or more also gets a seed of its own kind, which short repetitions don't have.
    """
    if not len(seed):
        return seed, owner, place
    order = np.lexsort((place, seed, owner))
    s, o, p = seed[order], owner[order], place[order]
    head = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1]) | (p[1:] - p[:-1] > K)])
    at = np.flatnonzero(head)
    reach = p[np.concatenate([at[1:], [len(p)]]) - 1] - p[at] + K
    long = at[reach >= MIN_WORDS]
    return np.concatenate([s[at], s[long] * _AGAIN + _AGAIN]), np.concatenate([o[at], o[long]]), np.concatenate([p[at], p[long]])


_AGAIN = np.uint64(0x9E3779B97F4A7C15)


def beside(words: np.ndarray, offsets: np.ndarray, owner: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Four bits, 1 to 15, of each of the NEAR words of a seed; 0 where the text has none."""
    out = np.zeros(len(place), np.uint16)
    begin, end = offsets[owner], offsets[owner + 1]
    for i, step in enumerate(NEAR):
        at = begin + place + step
        some = (at >= begin) & (at < end)
        out[some] |= ((words[at[some]] % np.uint64(15) + np.uint64(1)) << np.uint64(4 * i)).astype(np.uint16)
    return out


def agreeing(a: int, b: int) -> int:
    """How many of the NEAR words agree; one that either text lacks agrees."""
    return sum(not (x := a >> 4 * i & 15) or not (y := b >> 4 * i & 15) or x == y for i in range(len(NEAR)))


SENT = "bucket int, block long, seed binary, uid binary, place binary"
_SHARED = np.uint32(1 << 31)


def _sent(buckets: int):
    """A block's distinct seeds by bucket: the block's first document that holds the seed, its place, and whether more do."""

    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        uid = docs["uid"].to_numpy(np.int64)
        found = [(s, uid[first + o], p, beside(w, at, o, p)) for first, w, at, s, o, p in seeds(docs["text"].tolist())]
        s, u, p, near = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16))
        order = np.lexsort((p, u, s))
        s, u, p, near = s[order], u[order], p[order].astype(np.uint32), near[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
        tail = np.concatenate([head[1:], [len(s)]]) - 1
        p = p[head] | np.where(u[head] != u[tail], _SHARED, np.uint32(0))
        s, u, near = s[head], u[head], near[head]
        where = (s % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(buckets + 1))
        rows = []
        for b in range(buckets):
            own = order[cut[b] : cut[b + 1]]
            if len(own):
                rows.append((b, key[0], s[own].tobytes(), u[own].tobytes(), p[own].tobytes(), near[own].tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "block", "seed", "uid", "place", "near"])

    return run


ANSWERED = "block long, seed binary, uid binary, place binary"


def _referred(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block the seeds that its documents share with others, with the reference's document and place, and its id or near words.

    The reference's own block is told as well: it has to know that the seed is shared.
    """
    parts = [np.frombuffer(x, np.uint64) for x in rows["seed"]]
    s = np.concatenate(parts)
    u = np.concatenate([np.frombuffer(x, np.int64) for x in rows["uid"]])
    p = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["place"]])
    block = np.repeat(np.arange(len(rows)), [len(x) for x in parts])
    by = np.lexsort((u, s))
    s, u, p, block = s[by], u[by], p[by], block[by]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)
    size = np.diff(np.concatenate([first, [len(s)]]))
    more = (p & _SHARED) > 0
    shared = (size > 1) | (np.bincount(group, more) > 0)
    wanted = shared[group]
    out = []
    ref_u, ref_p = u[first][group], (p[first] & ~_SHARED)[group]
    name, kind = ("id", np.int64) if "id" in rows else ("near", np.uint16)
    extra = np.concatenate([np.frombuffer(x, kind) for x in rows[name]])[by][first][group][wanted]
    order = np.argsort(block[wanted], kind="stable")
    extra = extra[order]
    s, ref_u, ref_p, block = s[wanted][order], ref_u[wanted][order], ref_p[wanted][order], block[wanted][order]
    cut = np.searchsorted(block, np.arange(len(rows) + 1))
    for i, b in enumerate(rows["block"]):
        own = slice(cut[i], cut[i + 1])
        if cut[i + 1] > cut[i]:
            out.append((b, s[own].tobytes(), ref_u[own].tobytes(), ref_p[own].tobytes(), extra[own].tobytes()))
    return pd.DataFrame(out, columns=["block", "seed", "uid", "place", name])


def chains(x: np.ndarray, y: np.ndarray, worth: int = K, gap_words: int = GAP_WORDS) -> list[list[int]]:
    """Collinear chains of matches (x[i], y[i]), best first; each match is in one chain at most.

    A chain's score is `worth` for each match less worth/gap_words for each word passed in either text. The best
    predecessor with smaller x and y is the maximum of score plus cost of its place, over a prefix of y: a Fenwick tree.
    """
    n, cost = len(x), worth / gap_words
    order = np.lexsort((y, x)).tolist()
    rank = np.unique(y, return_inverse=True)[1].tolist()
    xs, ys = x.tolist(), y.tolist()
    size = max(rank) + 1
    tree: list[tuple[float, int]] = [(-1e18, -1)] * (size + 1)
    score, before = [0.0] * n, [-1] * n
    waiting: list[int] = []
    last = None
    for i in order:
        if xs[i] != last:  # equal x don't follow each other
            for j in waiting:
                value, r = (score[j] + cost * (xs[j] + ys[j]), j), rank[j] + 1
                while r <= size:
                    if value > tree[r]:
                        tree[r] = value
                    r += r & -r
            waiting, last = [], xs[i]
        best, r = (-1e18, -1), rank[i]
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - cost * (xs[i] + ys[i])
        score[i], before[i] = (worth + gain, best[1]) if gain > 0 else (float(worth), -1)
        waiting.append(i)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: (-score[i], xs[i], ys[i])):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = before[i]
        if chain:
            out.append(chain[::-1])
    return out


def shared_windows(words: np.ndarray, offsets: np.ndarray, owner: np.ndarray, place: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words (in words) of the windows of MIN_WORDS words that two documents may share, and the windows' hashes.

    owner, place, hit: the seeds, and whether another document holds them. A seed that starts WINDOW-1 words or more behind a
    window's begin and WINDOW-1 words or more before its last run of K words is picked in every text with this window.
    """
    alone = np.zeros(len(words) + 1, bool)
    alone[offsets[owner[~hit]] + place[~hit]] = True
    alone[offsets[owner[hit]] + place[hit]] = False
    count = np.concatenate([[0], np.cumsum(alone)])
    n = np.maximum(np.diff(offsets) - MIN_WORDS + 1, 0)
    begin = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(offsets[:-1], n)
    begin = begin[count[begin + MIN_WORDS - K - WINDOW + 2] == count[begin + WINDOW - 1]]
    up, down = _power_tables(len(words) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)])
    return begin, mixed((total[begin + MIN_WORDS] - total[begin]) * down[begin])


#: Rows without matches (x is null) are stretches: from `begin` on, the hashes of consecutive windows, in `words`.
CHAINED = "block long, doc_id string, uid long, n_words long, ref long, x binary, y binary, begin long, words binary"


def _chained(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The chains of a block's documents, each with 32 bits of the document's words around it, and the stretches of shared windows."""
    rows = []
    names = [c.split()[0] for c in CHAINED.split(", ")]
    if len(docs) and len(answers):
        s = np.concatenate([np.frombuffer(b, np.uint64) for b in answers["seed"]])
        u = np.concatenate([np.frombuffer(b, np.int64) for b in answers["uid"]])
        p = np.concatenate([np.frombuffer(b, np.uint32) for b in answers["place"]]).astype(np.int64)
        near = np.concatenate([np.frombuffer(b, np.uint16) for b in answers["near"]])
        order = np.argsort(s)
        s, u, p, near = s[order], u[order], p[order], near[order]
        docs = docs.drop_duplicates("uid")
        ids, uid = docs["doc_id"].tolist(), docs["uid"].to_numpy(np.int64)
        for first, words, offsets, seed, owner, place in seeds(docs["text"].tolist()):
            at = np.minimum(np.searchsorted(s, seed), len(s) - 1)
            hit = s[at] == seed
            begin, values = shared_windows(words, offsets, owner, place, hit)
            in_doc = np.searchsorted(offsets, begin, side="right") - 1
            cut = np.flatnonzero((np.diff(begin) != 1) | (np.diff(in_doc) != 0)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(begin)], strict=True):
                if b > a:
                    i = int(in_doc[a])
                    rows.append((key[0], ids[first + i], int(uid[first + i]), int(offsets[i + 1] - offsets[i]), 0, None, None, int(begin[a] - offsets[i]), values[a:b].tobytes()))
            hit &= u[at] != uid[first + owner]
            d, x, ref, y = owner[hit], place[hit], u[at[hit]], p[at[hit]]
            mine, its = beside(words, offsets, d, x), near[at[hit]]
            order = np.lexsort((x, ref, d))
            d, x, ref, y, mine, its = d[order], x[order], ref[order], y[order], mine[order], its[order]
            edge = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (ref[1:] != ref[:-1]), [True]])) if len(d) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                i = int(d[a])
                gx, gy = x[a:b], y[a:b]
                step_x, step_y = np.diff(gx), np.diff(gy)
                if (step_x == step_y).all() and (step_x > 0).all():  # one diagonal: cut where a gap costs more than a match is worth
                    splits = np.flatnonzero(step_x + step_y >= GAP_WORDS) + 1
                    found = np.split(np.arange(b - a), splits)
                else:
                    found = chains(gx, gy)
                own = words[offsets[i] : offsets[i + 1]]
                for c in found:
                    if len(c) == 1 and agreeing(int(mine[a + c[0]]), int(its[a + c[0]])) < BESIDE:
                        continue
                    cx, cy = gx[c], gy[c]
                    lo, hi = max(0, int(cx[0]) - MARGIN), min(len(own), int(cx[-1]) + K + MARGIN)
                    rows.append((key[0], ids[first + i], int(uid[first + i]), len(own), int(ref[a]), cx.astype(np.int32).tobytes(), cy.astype(np.int32).tobytes(), lo, own[lo:hi].astype(np.uint32).tobytes()))
    return pd.DataFrame(rows, columns=names)


TILES = "block long, ref long, ref_id string, ref_words long, tile long, words binary"


def _tiles(key: tuple, docs: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
    """The tiles of a block's documents that other blocks ask for."""
    rows = []
    if len(docs) and len(wanted):
        docs = docs[docs["uid"].isin(wanted["ref"].unique())].drop_duplicates("uid")
        ask = {r: g for r, g in wanted.groupby("ref")}
        ids, uid = docs["doc_id"].tolist(), docs["uid"].tolist()
        for first, raw in slices(docs["text"].tolist()):
            words, offsets = word_hashes(raw)
            for i in range(len(raw)):
                own = words[offsets[i] : offsets[i + 1]]
                for block, tile in zip(ask[uid[first + i]]["block"], ask[uid[first + i]]["tile"], strict=True):
                    rows.append((block, uid[first + i], ids[first + i], len(own), tile, own[tile * TILE : (tile + 1) * TILE].astype(np.uint32).tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])


def extended(equal: np.ndarray) -> int:
    """How far to go along a run of comparisons: to the best of matches less misses, until DROP is lost against it."""
    if not len(equal):
        return 0
    score = np.cumsum(np.where(equal, 1, -1))
    best = np.maximum.accumulate(np.maximum(score, 0))
    stop = np.flatnonzero(best - score > DROP)
    score = score[: stop[0]] if len(stop) else score
    return int(score.argmax()) + 1 if len(score) and score.max() > 0 else 0


def aligned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of a chain's alignment: place in a, place in b, equal. x, y: the matches' places in a and b.

    A word that stands in one text only is an unequal column at the place where the other text goes on.
    """
    columns: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def diagonal(at: int, to: int, n: int) -> None:
        if n > 0:
            columns.append((np.arange(at, at + n), np.arange(to, to + n), a[at : at + n] == b[to : to + n]))

    px, py = int(x[0]), int(y[0])
    back = min(px, py)
    left = extended((a[px - back : px] == b[py - back : py])[::-1])
    diagonal(px - left, py - left, left)
    shift = np.flatnonzero(np.diff(x - y)) + 1  # runs of matches on one diagonal
    heads, tails = np.concatenate([[0], shift]), np.concatenate([shift, [len(x)]]) - 1
    for i, (h, t) in enumerate(zip(heads.tolist(), tails.tolist(), strict=True)):
        end_x, end_y = int(x[t]) + k, int(y[t]) + k
        # a match that overlaps the one before it starts behind it in both texts
        skip = min(max(px - int(x[h]), py - int(y[h]), 0), end_x - int(x[h]))
        start_x, start_y = int(x[h]) + skip, int(y[h]) + skip
        if i and start_x >= px and start_y >= py:
            n = min(start_x - px, start_y - py)  # the gap: follow the old diagonal, then the new one, whichever cut is best
            old = np.concatenate([[0], np.cumsum(a[px : px + n] == b[py : py + n])])
            new = np.concatenate([[0], np.cumsum((a[start_x - n : start_x] == b[start_y - n : start_y])[::-1])])[::-1]
            cut = int((old + new).argmax())
            diagonal(px, py, cut)
            px, py = px + cut, py + cut
            rest = n - cut
            one_x, one_y = start_x - rest - px, start_y - rest - py
            columns.append((np.concatenate([np.arange(px, px + one_x), np.full(one_y, px + one_x)]), np.concatenate([np.full(one_x, py), np.arange(py, py + one_y)]), np.zeros(one_x + one_y, bool)))
            diagonal(start_x - rest, start_y - rest, rest)
        diagonal(start_x, start_y, end_x - start_x)
        px, py = max(px, end_x), max(py, end_y)
    n = min(len(a) - px, len(b) - py)
    diagonal(px, py, extended(a[px : px + n] == b[py : py + n]))
    cx, cy, equal = (np.concatenate(c) for c in zip(*columns, strict=True))
    return cx, cy, equal


def alike(equal: np.ndarray, identity: float = IDENTITY) -> list[tuple[int, int]]:
    """All maximal stretches of columns, begin and end, in which at least `identity` of them are equal.

    Equal columns score 1 and unequal ones lose identity/(1-identity), so a stretch scores 0 or more exactly if it is alike
    enough; the stretches are the disjoint ones of maximal score (found in one pass, by runs of columns).
    """
    if equal.mean() >= identity:
        return [(0, len(equal))]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(equal.astype(np.int8))) + 1, [len(equal)]])
    loss = identity / (1 - identity)
    found: list[list[float]] = []  # begin, end, score before begin, score at end
    total = 0.0
    for begin, end in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if not equal[begin]:
            total -= loss * (end - begin)
            continue
        new = [begin, end, total, total + end - begin]
        total = new[3]
        while True:
            at = next((i for i in range(len(found) - 1, -1, -1) if found[i][2] < new[2]), None)
            if at is None or found[at][3] >= new[3]:
                found.append(new)
                break
            new = [found[at][0], new[1], found[at][2], new[3]]
            del found[at:]
    return [(int(f[0]), int(f[1])) for f in found]


#: Ids are text here, as `passages` gives them they are longs.
PASSAGES = "doc_id string, uid long, n_words long, ref_id string, start_word long, end_word long, ref_start long, ref_end long, equal_words long"


def _aligned(key: tuple, chain_rows: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
    rows = []
    if len(chain_rows) and len(tiles):
        known = {(r, t): w for r, t, w in zip(tiles["ref"], tiles["tile"], tiles["words"], strict=True)}
        ids = dict(zip(tiles["ref"], tiles["ref_id"], strict=True))
        for c in chain_rows.itertuples():
            x, y = np.frombuffer(c.x, np.int32).astype(np.int64), np.frombuffer(c.y, np.int32).astype(np.int64)
            a = np.frombuffer(c.words, np.uint32)
            first, last = max(0, int(y[0]) - MARGIN) // TILE, (int(y[-1]) + K + MARGIN) // TILE
            b = np.frombuffer(b"".join(known.get((c.ref, t), b"") for t in range(first, last + 1)), np.uint32)
            from_x, from_y = c.begin, first * TILE
            cx, cy, equal = aligned(a, b, x - from_x, y - from_y)
            for i, j in alike(equal):
                x0, x1, y0, y1 = int(cx[i]) + from_x, int(cx[j - 1]) + 1 + from_x, int(cy[i]) + from_y, int(cy[j - 1]) + 1 + from_y
                if x1 - x0 >= MIN_WORDS:
                    rows.append((c.doc_id, c.uid, c.n_words, ids[c.ref], x0, x1, y0, y1, int(equal[i:j].sum())))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PASSAGES.split(", ")])


OPEN = "block long, doc_id string, uid long, n_words long, begin long, words binary"


def _open(key: tuple, stretches: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """The parts of a block's stretches whose windows its passages don't cover."""
    order = np.argsort(found["uid"].to_numpy(np.int64), kind="stable")
    uid, lo, hi = (found[c].to_numpy(np.int64)[order] for c in ("uid", "start_word", "end_word"))
    rows = []
    for c in stretches.itertuples():
        values = np.frombuffer(c.words, np.uint64)
        own = slice(*np.searchsorted(uid, [c.uid, c.uid + 1]))
        edge = np.zeros(len(values) + MIN_WORDS, np.int64)
        for x, y in zip((lo[own] - c.begin).tolist(), (hi[own] - c.begin).tolist(), strict=True):
            if x < len(edge) - 1 and y > 0:
                edge[max(x, 0)] += 1
                edge[min(y, len(edge) - 1)] -= 1
        free = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] == 0)])
        keep = np.concatenate([[False], free[MIN_WORDS:] > free[:-MIN_WORDS], [False]])
        for x, y in np.flatnonzero(keep[1:] != keep[:-1]).reshape(-1, 2).tolist():
            rows.append((key[0], c.doc_id, c.uid, c.n_words, c.begin + x, values[x:y].tobytes()))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in OPEN.split(", ")])


_NO_ID = np.uint32(1 << 30)


def windows_of(parts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row of `parts` and first word of all windows."""
    values = [np.frombuffer(w, np.uint64) for w in parts["words"]]
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    start = np.concatenate([np.arange(b, b + len(v)) for b, v in zip(parts["begin"], values, strict=True)])
    return np.concatenate(values), row, start


def _sent_windows(buckets: int):
    """A block's distinct open windows by bucket, as its seeds are sent, with the first document's id."""

    def run(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        s, row, p = windows_of(parts)
        u, ids = parts["uid"].to_numpy(np.int64)[row], parts["doc_id"]
        order = np.lexsort((p, u, s))
        s, u, p, row = s[order], u[order], p[order].astype(np.uint32), row[order]
        head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        tail = np.concatenate([head[1:], [len(s)]]) - 1
        p = p[head] | np.where(u[head] != u[tail], _SHARED, np.uint32(0)) | np.where(ids.isna().to_numpy()[row[head]], _NO_ID, np.uint32(0))
        s, u, i = s[head], u[head], np.array([0 if x is None else int(x) for x in ids], np.int64)[row[head]]
        where = (s % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(buckets + 1))
        own = [order[cut[b] : cut[b + 1]] for b in range(buckets)]
        rows = [(b, key[0], s[o].tobytes(), u[o].tobytes(), p[o].tobytes(), i[o].tobytes()) for b, o in enumerate(own) if len(o)]
        return pd.DataFrame(rows, columns=["bucket", "block", "seed", "uid", "place", "id"])

    return run


def _exact(key: tuple, parts: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """A block's exact passages: of runs of windows with one reference and shift, as many as cover all their words."""
    rows = []
    if len(parts) and len(answers):
        s, u, p, ids = (np.concatenate([np.frombuffer(x, kind) for x in answers[c]]) for c, kind in (("seed", np.uint64), ("uid", np.int64), ("place", np.uint32), ("id", np.int64)))
        order = np.argsort(s)
        s, u, p, ids = s[order], u[order], p[order], ids[order]
        value, row, start = windows_of(parts)
        at = np.minimum(np.searchsorted(s, value), len(s) - 1)
        hit = (s[at] == value) & (u[at] != parts["uid"].to_numpy(np.int64)[row])
        at, row, start = at[hit], row[hit], start[hit]
        if len(at):
            shift = (p[at] & ~_NO_ID).astype(np.int64) - start
            fresh = np.concatenate([[True], (np.diff(row) != 0) | (np.diff(start) != 1)])
            head = np.flatnonzero(fresh | np.concatenate([[True], (np.diff(shift) != 0) | (u[at[1:]] != u[at[:-1]])]))
            begin, end = start[head], start[np.concatenate([head[1:], [len(at)]]) - 1] + MIN_WORDS
            cut = np.concatenate([np.flatnonzero(fresh[head]), [len(head)]])
            doc_id, uid, n_words = parts["doc_id"].tolist(), parts["uid"].tolist(), parts["n_words"].tolist()
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                j = -1
                reached = int(begin[a])
                while j < b - 1:
                    j = a + int(np.searchsorted(begin[a:b], reached, side="right")) - 1
                    h, reached = int(head[j]), int(end[j])
                    r, x = int(row[h]), int(shift[h])
                    ref_id = None if p[at[h]] & _NO_ID else str(ids[at[h]])
                    rows.append((doc_id[r], uid[r], n_words[r], ref_id, int(begin[j]), reached, int(begin[j]) + x, reached + x, reached - int(begin[j])))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in PASSAGES.split(", ")])


def exact_rest(stretches: DataFrame, found: DataFrame, blocks: int, buckets: int) -> DataFrame:
    """The columns of PASSAGES: exact passages that the found ones don't cover, against the first document that holds them."""
    found = found.select("uid", "start_word", "end_word", F.pmod("uid", F.lit(blocks)).alias("block"))
    parts = stored(stretches.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(_open, OPEN))
    sent = parts.groupBy("block").applyInPandas(_sent_windows(buckets), SENT + ", id binary")
    answers = sent.groupBy("bucket").applyInPandas(_referred, ANSWERED + ", id binary")
    return parts.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_exact, PASSAGES)


def uid_of() -> Column:
    """A hash of a row's id and text, which orders the documents and names their block."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of()).alias("uid")


def passages(docs: DataFrame, block_bytes: int = BLOCK_BYTES, buckets: int | None = None) -> DataFrame:
    """The columns of PASSAGES: a passage of a document that its reference holds as well, in words from start to end.

    Without a number of buckets there is one for four blocks, at least BUCKETS, so that a bucket's share stays bounded.
    """
    blocks = blocks_for(docs, block_bytes)
    buckets = buckets or max(BUCKETS, blocks // 4)
    bounded(docs.sparkSession)
    rows = docs.select(id_text(), uid_of(), text_of().alias("text"))
    rows = rows.withColumn("block", F.pmod("uid", F.lit(blocks))).repartition(blocks, "block")
    sent = rows.groupBy("block").applyInPandas(_sent(buckets), SENT + ", near binary")
    answers = sent.groupBy("bucket").applyInPandas(_referred, ANSWERED + ", near binary")
    both = stored(rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_chained, CHAINED))
    chained, stretches = both.filter("x is not null"), both.filter("x is null")
    spans = chained.mapInPandas(_asked, "block long, ref long, first long, last long")
    wanted = spans.select("block", "ref", F.explode(F.sequence("first", "last")).alias("tile")).distinct()
    wanted = wanted.withColumn("ref_block", F.pmod("ref", F.lit(blocks)))
    tiles = rows.groupBy("block").cogroup(wanted.groupBy("ref_block")).applyInPandas(_tiles, TILES)
    found = stored(chained.groupBy("block").cogroup(tiles.groupBy("block")).applyInPandas(_aligned, PASSAGES))
    return with_ids(found.unionByName(exact_rest(stretches, found, blocks, buckets)), "doc_id", "ref_id")


def _asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        ends = [(np.frombuffer(y, np.int32)[0], np.frombuffer(y, np.int32)[-1]) for y in b["y"]]
        first = [max(0, int(f) - MARGIN) // TILE for f, _ in ends]
        last = [(int(e) + K + MARGIN) // TILE for _, e in ends]
        yield pd.DataFrame({"block": b["block"], "ref": b["ref"], "first": first, "last": last})


_WORD = re.compile(WORD)


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (begin, end) and the white space after them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        a, b = starts[a], starts[min(b, len(starts) - 1)]
        out.append(text[at : max(a, at)])
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """docs with every passage removed that its reference holds; a document of which no word is left goes, unless it had none."""
    found = passages(docs, **options)
    spans = found.groupBy(F.col("uid").alias("s_uid")).agg(F.collect_set(F.struct("start_word", "end_word")).alias("spans"))

    @pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else cut_words(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(texts, spans, strict=True)])

    once = cut.asNondeterministic()  # else the filter below would evaluate it a second time
    met = docs.select(whole_row(docs), uid_of()).join(spans, F.col("uid") == F.col("s_uid"), "left")  # the text travels once
    left = met.filter("spans is not null").select("row", once("row.text", "spans").alias("text")).filter(F.col("text").rlike(WORD))
    made = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    left = left.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
    return met.filter("spans is null").select("row.*").unionByName(left)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir)).select("doc_id", F.col("ref_id").alias("ref_doc_id"), "start_word", "end_word", "ref_start", "ref_end", "equal_words", "n_words")
