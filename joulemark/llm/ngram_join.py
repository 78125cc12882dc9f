"""N-gram Jaccard join by prefix trees.

A document's set is its distinct word shingles, hashed and put into one global order: by how often the shingle's bucket
was counted over all documents, then by hash. Sets that reach the threshold share a shingle among the first few of each
(the prefix), so documents meet by the shingles of their prefixes. Where they meet, the prefixes are stored in a tree;
other prefixes walk it level by level, pairs on a common path sharing the overlap so far, and a subtree is left as soon
as even all that remains could not lift the overlap to the threshold. What passes is compared by its whole sets.

A prefix is stored where each shingle that others have too is its first: from there on, TAIL of its shared shingles go
along with their places, so a document's share of the trees grows with its prefix and not with the square of it. A pair is
judged where it first meets; what lies before is known to differ, by the places. Besides, each document brings the
parities of its whole set by WIDTH hashed classes at most: as many as differ between two sets, so many shingles at least
are in one of them only, which drops pairs that cannot reach the threshold before they are written. Both are bounds
that never drop a link; what passes is compared by whole sets.

Documents with equal sets are one node. Of the partners that pass, each document first links with the nearest few (and
with the pivots of a shingle that very many have), then, only where a shingle still joins different components, with
more, and at last with all that are left in other components. So copies of one text cost as many pairs as there are
copies, and no pair between different components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import connected_components, discard, joined_components, lookup, release, rows, small_batches, written

WORDS, PERCENT = 3, 90
#: Buckets in which shingles are counted, to put frequent ones last, and the parts in which the counts are added up.
BUCKETS, PARTS = 1 << 18, 32
#: Members of a shingle's group beyond which it is dealt to several tasks.
GROUP = 256
#: Shared shingles that are sent from a meeting place on; bits of a set's parities that go with them at most, and of those
#: that are compared before texts are.
TAIL, WIDTH, WIDEST = 8, 1024, 1 << 17
#: Partners that a document links with in the first round and in the second; the third takes all.
NEAR, MORE = 4, 64
#: Columns of a meeting place.
POST = ["cls", "set", "n", "bits", "alone", "token", "k", "tokens", "at", "before", "known", "last"]
#: Tasks of a step at least; cells of a tree's table, about.
TASKS, CELLS = 64, 500_000
#: Bytes of texts that are hashed at once; the base of words' polynomials.
WINDOW, BASE = 1 << 18, 0x9FB21C651E98DF25


def _powers(base: int) -> np.ndarray:
    out = np.empty(WINDOW + 1, np.uint64)
    out[0], k = 1, 1
    while k <= WINDOW:  # by doubling
        m = min(k, WINDOW + 1 - k)
        out[k : k + m] = out[:m] * np.uint64(pow(base, k, 2**64))
        k *= 2
    return out


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes with texts beginning at cuts: each word's hash, and where it begins. Words end at ASCII white space and at cuts."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    n = len(data)
    begins = np.ones(n, bool)
    begins[1:] = space[:-1]
    begins[cuts[cuts < n]] = True
    ends = np.ones(n, bool)
    ends[:-1] = space[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    ends[inner - 1] = True
    begin, end = np.flatnonzero(begins & ~space), np.flatnonzero(ends & ~space) + 1
    shingler = _TABLES
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(shingler["byte"][data] * shingler["up"][:n], out=sums[1:])
    h = (sums[end] - sums[begin]) * shingler["down"][begin] ^ (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32), begin


class _Tables(dict):
    """What hashes are made of, once for a worker: a number for each byte (A-Z as a-z), powers of an odd number, of its inverse."""

    def __missing__(self, name: str) -> np.ndarray:
        if name == "byte":
            self[name] = np.array([xxhash.xxh64_intdigest(bytes([c]).lower()) for c in range(256)], np.uint64)
        else:
            self[name] = _powers(BASE if name == "up" else pow(BASE, -1, 2**64))
        return self[name]


_TABLES = _Tables()


class Shingler:
    """Distinct shingles of texts (UTF-8) as sorted 56-bit numbers. A-Z are lowered, words end at ASCII white space; a text
    of fewer words than a shingle has one of them all; no word, no shingle. A word's hash is a polynomial in its bytes, so
    those of a window of many texts are found at once; only its hashes are held of a long text."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        return self.sets(pa.array([text], pa.string()))[0]

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        column = column.cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
        if column.null_count:  # a null has no bytes of its own
            offsets = np.where(np.r_[column.is_null().to_numpy(zero_copy_only=False), False], np.r_[offsets[1:], offsets[-1]], offsets)
        out: list[np.ndarray] = []
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + WINDOW, "right")) - 1)
            if offsets[j] - offsets[i] <= WINDOW:
                h, begin = _word_hashes(data[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
                out += self._shingled(h, np.searchsorted(begin, offsets[i : j + 1] - offsets[i]))
            else:
                h = self._long(data[offsets[i] : offsets[j]])
                out += self._shingled(h, np.array([0, len(h)]))
            i = j
        return out

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Words' hashes of a text longer than a window, window by window; a word longer than that is hashed by its bytes."""
        found, at = [], 0
        while at < len(data):
            part = data[at : at + WINDOW]
            if at + WINDOW < len(data):
                space = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
                if not len(space):  # one word fills the window
                    rest = data[at:]
                    ends = next((k + int(np.argmax(hit)) for k in range(0, len(rest), WINDOW) if (hit := (rest[k : k + WINDOW] == 32) | ((rest[k : k + WINDOW] >= 9) & (rest[k : k + WINDOW] <= 13))).any()), len(rest))
                    found.append(np.array([xxhash.xxh64_intdigest(rest[:ends].tobytes().lower())], np.uint64))
                    at += ends
                    continue
                part = part[: space[-1] + 1]
            found.append(_word_hashes(part, np.zeros(0, np.int64))[0])
            at += len(part)
        return np.concatenate(found)

    def _shingled(self, h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        k = self.words
        x = self._mixed(h, k)
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            s = x[a : b - k + 1] if b - a >= k else self._mixed(h[a:b], b - a)
            s = np.sort(s)
            out.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
        return out

    def _mixed(self, h: np.ndarray, k: int) -> np.ndarray:
        m = len(h) - k + 1
        if m <= 0 or not k:
            return np.zeros(0, np.uint64)
        x = np.full(m, np.uint64(k * 0x9E3779B97F4A7C15 % 2**64))
        for j in range(k):
            x = (x ^ h[j : m + j]) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        return x >> np.uint64(8)


def ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles with their bucket's level in front: sorted, this is the global order."""
    return np.sort(levels[(shingles % np.uint64(len(levels))).astype(np.int64)].astype(np.uint64) << np.uint64(56) | shingles)


def least_overlap(n, m, percent: int = PERCENT):
    """Of two sets of n and m at the threshold: 100 o >= percent (n + m - o)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_length(n, percent: int = PERCENT):
    return n - -(-percent * n // 100) + 1


class PrefixTree:
    """The prefixes of many groups of sets as trees, one for each group, level by level.

    Of a prefix only shingles that other prefixes have too are kept (tokens), with their places in the whole set (at);
    known says how long the prefix is and last what it ends with. A node has a token, its parent (a group, at the top),
    the least and largest size and the least place below, and its rows, which lie together as rows are sorted.
    """

    def __init__(self, group: np.ndarray, tokens: list[np.ndarray], at: list[np.ndarray], size: np.ndarray, known: np.ndarray, last: np.ndarray):
        order = sorted(range(len(tokens)), key=lambda i: (group[i], tokens[i].astype(">u8").tobytes()))
        self.rows = np.array(order, np.int64)
        self.length = np.array([len(tokens[i]) for i in order], np.int64)
        self.group, self.size, self.known, self.last = (np.asarray(v)[self.rows] for v in (group, size, known, last))
        width = int(self.length.max(initial=0))
        table, places = np.zeros((len(order), width), np.int64), np.zeros((len(order), width), np.int64)
        for r, i in enumerate(order):
            table[r, : self.length[r]], places[r, : self.length[r]] = tokens[i], at[i]
        inside = np.arange(width) < self.length[:, None]
        new = np.ones_like(inside)
        new[1:] = np.logical_or.accumulate((table[1:] != table[:-1]) | ~inside[:-1] | (self.group[1:] != self.group[:-1])[:, None], axis=1)
        self.levels, self.groups = [], np.unique(self.group)
        above, nodes = np.searchsorted(self.groups, self.group), len(self.groups)
        for d in range(width):
            rows = np.flatnonzero(inside[:, d])
            first = new[rows, d]
            first[0] = True
            start = np.flatnonzero(first)
            low, high, least = np.minimum.reduceat(self.size[rows], start), np.maximum.reduceat(self.size[rows], start), np.minimum.reduceat(places[rows, d], start)
            begin = rows[start]
            end = np.r_[rows[start[1:] - 1], rows[-1]] + 1
            children = np.searchsorted(above[begin], np.arange(nodes + 1))
            self.levels.append((table[begin, d], low, high, least, begin, end, children))
            above = np.full(len(order), -1)
            above[rows] = np.cumsum(first) - 1
            nodes = len(start)

    def walk(self, group: np.ndarray, tokens: list[np.ndarray], at: list[np.ndarray], size: np.ndarray, known: np.ndarray, last: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (probe, row as given) of one group whose sets may reach the threshold by what is known of them."""
        size, none = np.asarray(size, np.int64), np.zeros(0, np.int64)
        length = np.array([len(p) for p in tokens], np.int64)
        if not self.levels or not length.sum():
            return none, none
        flat, places = np.concatenate(tokens), np.concatenate(at)
        every = np.unique(np.concatenate([flat, *(x[0] for x in self.levels)]))
        keys = np.repeat(np.arange(len(tokens)), length) * len(every) + np.searchsorted(every, flat)
        start = np.cumsum(length) - length
        out: list[tuple[np.ndarray, np.ndarray]] = []
        node = np.searchsorted(self.groups, group)
        fits = (node < len(self.groups)) & (self.groups[np.minimum(node, len(self.groups) - 1)] == group)
        probe, node = np.flatnonzero(fits), node[fits]
        overlap = np.zeros(len(probe), np.int64)
        for d, (token, low, high, least, begin, end, children) in enumerate(self.levels):
            # to the children, which share the overlap so far
            count = children[node + 1] - children[node]
            first = children[node]
            probe, overlap = np.repeat(probe, count), np.repeat(overlap, count)
            node = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            if not len(probe):
                break
            key = probe * len(every) + np.searchsorted(every, token[node])
            i = np.searchsorted(keys, key)
            hit = (i < len(keys)) & (keys[np.minimum(i, len(keys) - 1)] == key)
            overlap = overlap + hit
            before = i - 1 + hit  # the probe's last token up to this one
            passed = np.where(before >= start[probe], places[np.maximum(before, 0)] + 1, 0)
            n, lo, hi = size[probe], low[node], high[node]
            need = least_overlap(n, np.maximum(lo, -(-percent * n // 100)), percent)
            # beyond the end of the probe's prefix a token may or may not be in its set
            unknown = (token[node] > last[probe]) & (known[probe] < n)
            alive = (unknown | (overlap + np.minimum(hi - least[node] - 1, n - passed) >= need)) & (100 * hi >= percent * n) & (percent * lo <= 100 * n)
            probe, node, overlap = probe[alive], node[alive], overlap[alive]
            # the rows that end here come first below a node; several, where prefixes are equal
            row = begin[node]
            p, o, stop = probe, overlap, end[node]
            while len(row):
                here = self.length[row] == d + 1
                p, o, row, stop = p[here], o[here], row[here], stop[here]
                # what follows the prefix that ends first is unknown; all before it is counted
                shorter = last[p] <= self.last[row]
                rest = np.where(shorter, size[p] - known[p], self.size[row] - self.known[row])
                fine = (o + rest >= least_overlap(size[p], self.size[row], percent)) & (100 * np.minimum(size[p], self.size[row]) >= percent * np.maximum(size[p], self.size[row]))
                out.append((p[fine], self.rows[row[fine]]))
                row = row + 1
                more = row < stop
                p, o, row, stop = p[more], o[more], row[more], stop[more]
        if not out:
            return none, none
        return np.concatenate([p for p, _ in out]), np.concatenate([r for _, r in out])


def _summaries(docs: DataFrame, words: int) -> DataFrame:
    """A row for each document (doc_id, n, digest) and PARTS rows for each task with its counts of shingles by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, counts = Shingler(words), np.zeros(BUCKETS, np.uint32)
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])
        for x in batches:
            sets = shingles.sets(x.column("text"))
            n = [len(s) for s in sets]
            if sum(n):
                counts += np.bincount((np.concatenate(sets) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            none = [None] * len(n)
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
        size = BUCKETS // PARTS
        parts = [counts[i * size : (i + 1) * size].tobytes() for i in range(PARTS)]
        none = [None] * PARTS
        yield pa.RecordBatch.from_arrays([pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, part int, counts binary")


def _levels(found: DataFrame) -> np.ndarray:
    """A level of 0 to 127 for each bucket, by how far its count lies above the mean. Tallies are added up in two steps."""

    def add(x: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.uint64 if len(c) == 8 * (BUCKETS // PARTS) else np.uint32).astype(np.uint64) for c in x["counts"])
        return pd.DataFrame({"part": [x["part"].iloc[0]], "counts": [total.tobytes()]})

    some = found.where("part is not null").select("part", "counts", F.pmod(F.xxhash64("counts"), F.lit(8)).alias("s"))
    some = some.groupBy("part", "s").applyInPandas(add, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    counts = np.zeros(BUCKETS)
    for r in some.collect():  # PARTS rows
        size = BUCKETS // PARTS
        counts[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["counts"], np.uint64)
    return np.clip(np.ceil(12 * np.log2(np.maximum(counts, 1) / max(1.0, counts.mean()))), 0, 127).astype(np.uint8)


def parities(shingles: np.ndarray, most: int = WIDTH) -> bytes:
    """The parity of how many shingles fall into each of 64 to most classes, a power of two about as large as the set."""
    width = min(most, max(64, 1 << max(0, len(shingles) - 1).bit_length()))
    counts = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def apart(bits: list[bytes], p: np.ndarray, q: np.ndarray, chunk: int = 100_000) -> np.ndarray:
    """Of pairs of rows (p, q): in how many classes their parities differ; the longer one is folded to the shorter."""
    width = np.array([len(b) for b in bits], np.int64)
    out, low = np.zeros(len(p), np.int64), np.minimum(width[p], width[q])
    for w in np.unique(low):
        of = np.flatnonzero(low == w)
        used = np.unique(np.concatenate([p[of], q[of]]))
        table = np.empty((len(used), w), np.uint8)
        for k, i in enumerate(used):
            b = np.frombuffer(bits[i], np.uint8)
            while len(b) > w:
                b = b[: len(b) // 2] ^ b[len(b) // 2 :]
            table[k] = b
        a, b = np.searchsorted(used, p[of]), np.searchsorted(used, q[of])
        words = table.view(np.uint64)
        for k in range(0, len(of), chunk):
            out[of[k : k + chunk]] = np.bitwise_count(words[a[k : k + chunk]] ^ words[b[k : k + chunk]]).sum(axis=1)
    return out


def _prefixes(docs: DataFrame, levels: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, n, parities (wide ones only of sets larger than WIDTH) and prefix of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # BUCKETS bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for x in batches:
            n, first, bits, wide = [], [], [], []
            for s in shingles.sets(x.column("text")):
                n.append(len(s))
                bits.append(parities(s))
                wide.append(parities(s, WIDEST) if len(s) > WIDTH else None)
                first.append(ordered(s, shared.value)[: prefix_length(len(s), percent)].view(np.int64) if len(s) else s.view(np.int64))
            columns = [x.column("doc_id"), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(wide, pa.binary()), pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "bits", "wide", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, bits binary, wide binary, prefix array<long>")


def _dealt(members: DataFrame, keys: list[str], count: int, rows: int) -> DataFrame:
    """members with bucket: groups of keys dealt to tasks of about so many rows."""
    return members.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(max(TASKS, -(-count // rows)))))


def _given(x: pd.DataFrame, group: np.ndarray) -> tuple:
    return group, [np.asarray(v, np.int64) for v in x["tokens"]], [np.asarray(v, np.int64) for v in x["at"]], x["n"].to_numpy(), x["known"].to_numpy(), x["last"].to_numpy()


def _walked(x: pd.DataFrame, group: np.ndarray, indexed: np.ndarray, probing: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of x (probing, indexed) that pass, a few groups at a time, so that a tree's table stays small."""
    length = x["tokens"].map(len).to_numpy()
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
    size, widest = np.diff(np.r_[starts, len(order)]), np.maximum.reduceat(length[order], starts) if len(order) else np.zeros(0, np.int64)
    by_width = np.argsort(widest, kind="stable")
    cells = np.cumsum((size * widest * np.minimum(size, 64))[by_width]) // CELLS
    for part in np.split(by_width, np.flatnonzero(np.diff(cells)) + 1):
        own = np.concatenate([order[starts[g] : starts[g] + size[g]] for g in part]) if len(part) else order[:0]
        a, b = own[indexed[own]], own[probing[own]]
        if len(a) and len(b):
            tree = PrefixTree(*_given(x.iloc[a], group[a]))
            p, r = tree.walk(*_given(x.iloc[b], group[b]), percent)
            yield b[p], a[r]


def near_pairs(x: pd.DataFrame, group: np.ndarray, indexed: np.ndarray, probing: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (probing p, indexed q) of a group whose sets may reach the threshold, with q's rank among p's partners:
    pivots have -1, then comes the smallest document, then the others by how much their parities differ."""
    doc, n, bits = x["cls"].to_numpy(), x["n"].to_numpy(), list(x["bits"])
    pivot = x["pivot"].to_numpy() if "pivot" in x else np.zeros(len(x), bool)
    before = x["before"].to_list()
    found = []
    for p, q in _walked(x, group, indexed, probing, percent):
        fine = doc[p] != doc[q]
        p, q = p[fine], q[fine]
        if not len(p):
            continue
        # a pair that shares a shingle before meets there already
        met = np.fromiter((not pivot[j] and bool(len(before[i]) and len(before[j]) and not set(before[i]).isdisjoint(before[j])) for i, j in zip(p, q, strict=True)), bool, len(p))
        p, q = p[~met], q[~met]
        far = apart(bits, p, q)
        both = n[p] + n[q]
        fine = far <= both - 2 * least_overlap(both, 0, percent)
        found.append((p[fine], q[fine], far[fine]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    p, q, far = (np.concatenate(v) for v in zip(*found, strict=True))
    far = np.where(pivot[q], -2, far)
    least = np.full(len(x), np.iinfo(np.int64).max)
    np.minimum.at(least, p[far >= 0], doc[q[far >= 0]])
    far = np.where((far >= 0) & (doc[q] == least[p]), -1, far)
    order = np.lexsort((doc[q], far, p))
    p, q, far = p[order], q[order], far[order]
    plain = far > -2
    passed = np.cumsum(plain)
    start = np.flatnonzero(np.r_[True, np.diff(p) > 0]) if len(p) else p
    rank = passed - 1 - np.repeat(passed[start] - plain[start], np.diff(np.r_[start, len(p)]))
    return p, q, np.where(plain, rank, -1)


def _verified(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of written pairs (a, b, w) whose whole sets reach the threshold; w is about how many words the two have.
    Texts of documents in pairs alone are moved; a b with many partners is spread over several tasks."""
    need = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ngram-need")
    texts = lookup(docs.select(F.col("doc_id").alias("id"), "text"), need, "id", "left_semi")
    parts = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("parts"), F.sum("w").alias("w")), "ngram-parts")
    own = lookup(pairs.drop("w"), parts.drop("w"), "b", n=rows(parts)).select("b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("s"), F.col("a").alias("id"))
    probes = parts.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("s"), F.col("b").alias("id"))
    total = parts.agg(F.sum("w")).first()[0] or 0
    members = _dealt(own.unionByName(probes), ["b", "s"], max(rows(pairs), total // 500), 2000).join(texts, "id")

    def check(x: pd.DataFrame) -> pd.DataFrame:
        shingles, out = Shingler(words), []
        ids, b = x["id"].to_numpy(), x["b"].to_numpy()
        for (of, _), members in x.groupby(["b", "s"]).indices.items():
            probes = [shingles(x["text"].iat[r]) for r in members if ids[r] == of]
            for r in members:
                if ids[r] != of:
                    s = shingles(x["text"].iat[r])
                    if any(_reaches(s, p, percent) for p in probes):
                        out.append((ids[r], of))
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64).drop_duplicates()

    out = written(members.groupBy("bucket").applyInPandas(check, "a long, b long").distinct(), "ngram-links")
    discard(need, parts)
    return out


def _reaches(s: np.ndarray, p: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(s, p, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(s) + len(p) - both)


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when 100 x common shingles >= percent x shingles of either. Null, empty and wordless texts have
    no shingles and link with nothing. Rows that repeat a doc_id are one document, with the component of all; a null
    doc_id links with nothing and has no component. An empty table gives an empty result; extra columns are not read.
    Very long texts are taken whole: only their prefixes, a fixed number of parities and, where they pass, their own text
    are sent. Ties do not matter, as a component is named by its smallest doc_id. Shingles are compared by 56-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(_summaries(docs, words), "ngram-summaries")
    own = found.where("part is null").select("doc_id", "n", "digest")
    classes = written(own.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("cls")), "ngram-classes")
    levels = _levels(found)
    prefixes = _prefixes(docs.where("doc_id is not null"), levels, words, percent)
    # those that stand for no class go; the others, nearly all, need not be shuffled for it
    copies = own.where("n > 0 and doc_id is not null").select("doc_id").join(classes.select(F.col("cls").alias("doc_id")), "doc_id", "left_anti").distinct()
    copies = written(copies, "ngram-copies")
    prefixes = lookup(prefixes.where("n > 0"), copies, "doc_id", "left_anti")
    prefixes = prefixes.select(F.monotonically_increasing_id().alias("set"), F.col("doc_id").alias("cls"), "n", "bits", "wide", "prefix", F.size("prefix").alias("known"), F.element_at("prefix", -1).alias("last"))
    prefixes = written(prefixes, "ngram-prefixes")
    discard(copies)
    release(spark)
    wide = prefixes.where("wide is not null").select("cls", "wide")
    posts, most = _posts(prefixes, percent)

    component, links, tried, left = None, None, None, None
    for high in (NEAR, MORE, None):
        sent, count = (_first(posts, most), rows(posts)) if component is None else _between(posts, component, left, most)
        found_now = _passed(sent, count, percent, component is None, high)
        left = found_now.where("token is not null").select("token").distinct()
        pairs = found_now.where("token is null").groupBy("a", "b").agg(F.max("w").alias("w"))
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = written(pairs, "ngram-pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        if rows(pairs):
            more = _verified(docs, _wide_apart(pairs, wide, percent), words, percent)
            links = more if links is None else links.unionByName(more)
            component = connected_components(more) if component is None else joined_components(component, more)
            release(spark)
        elif component is None:
            component = connected_components(pairs.select("a", "b"))
        if most <= GROUP and left.isEmpty():
            break
    discard(posts, prefixes)
    classed = lookup(own, classes, "digest")
    if links is not None and not own.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        # a document is in the component of each set that rows of its doc_id have
        more = classed.where("doc_id <> cls").select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))
        component = joined_components(component, more)
        classed = classed.withColumn("cls", F.col("doc_id"))
    elif links is None:
        more = classed.where("doc_id <> cls").select(F.col("doc_id").alias("a"), F.col("cls").alias("b"))
        component = connected_components(more)
        classed = classed.withColumn("cls", F.col("doc_id"))
    out = lookup(classed, component.select(F.col("node").alias("cls"), "component"), "cls", n=rows(component))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "cls", "doc_id")).alias("component_id"))


def _posts(prefixes: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """A row for each meeting place of each set: a token of its prefix that other sets have in theirs, with k, how many have
    it, and of the shared tokens from there on the first TAIL and their places (at), and the two before. known and last say
    how far the prefix is known by them. Besides, the largest k.

    Sets of n and m shingles that first meet at places at and bt share at most the lesser rest of both. So a place is early
    if it can be the first in common with a set of the same size or a larger one, and a late one serves only smaller sets,
    at an early place of theirs; and of two sets alone the bound is tested itself."""
    early = (100 + percent) * (F.col("n") - F.col("at")) >= 2 * percent * F.col("n")
    postings = prefixes.select("set", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    shared = postings.groupBy("token").agg(F.count("*").alias("k"), F.sum("n").alias("ns"), F.sum("at").alias("ats"), F.count_if(early).alias("earlies")).where("k > 1")
    n, other = F.col("n"), F.col("ns") - F.col("n")
    rest = F.least(n - F.col("at"), other - (F.col("ats") - F.col("at")))
    two = ((100 + percent) * rest >= percent * (n + other)) & (100 * F.least(n, other) >= percent * F.greatest(n, other))
    meet = F.when(F.col("k") == 2, two).otherwise(early | (F.col("earlies") > 0))
    met = postings.join(shared, "token").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("at", "token", F.when(meet, F.col("k")).otherwise(0).alias("k")))).alias("x"))
    met = met.join(prefixes.drop("prefix", "wide"), "set").select("cls", "set", "n", "bits", "known", "last", F.col("x.at").alias("at"), F.col("x.token").alias("token"), F.col("x.k").alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            flat = {c: x.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "token", "k")}
            size = pa.compute.list_value_length(x.column("at")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            for chosen in np.array_split(np.flatnonzero(flat["k"] > 0), max(1, int((flat["k"] > 0).sum()) // 20_000)):
                row = np.searchsorted(ends, chosen, "right")
                whole = ends[row] - chosen
                length, back = np.minimum(TAIL, whole), np.minimum(2, chosen - (ends[row] - size[row]))

                def lists(first: np.ndarray, count: np.ndarray, values: np.ndarray) -> pa.Array:
                    starts = np.r_[0, np.cumsum(count)]
                    return pa.ListArray.from_arrays(starts.astype(np.int32), values[np.repeat(first - starts[:-1], count) + np.arange(starts[-1])])

                end = np.maximum(chosen + length - 1, 0)
                short = whole > TAIL
                known, last = (x.column(c).to_numpy(zero_copy_only=False)[row] for c in ("known", "last"))
                taken = {c: x.column(c).take(pa.array(row)) for c in ("cls", "set", "n", "bits")}
                out = [
                    taken["cls"], taken["set"], taken["n"], taken["bits"], pa.array(x.column("known").to_numpy()[row] - size[row], pa.int64()), pa.array(flat["token"][chosen]), pa.array(flat["k"][chosen]),
                    lists(chosen, length, flat["token"]), lists(chosen, length, flat["at"]), lists(chosen - back, back, flat["token"]),
                    pa.array(np.where(short, flat["at"][end] + 1, known), pa.int64()), pa.array(np.where(short, flat["token"][end], last), pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(out, names=POST)

    kinds = ("long", "long", "long", "binary", "long", "long", "long", "array<long>", "array<long>", "array<long>", "long", "long")
    largest = Observation()
    posts = met.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(POST, kinds, strict=True))).observe(largest, F.max("k").alias("k"))
    posts = written(posts, "ngram-posts")
    release(posts.sparkSession)
    return posts, largest.get["k"] or 0


def _band() -> Column:
    """By size: sets that link lie in the same band or in the next, as percent is 50 or more."""
    return F.floor(F.log2(F.col("n").cast("double"))).cast("long").alias("band")


def _first(posts: DataFrame, most: int) -> DataFrame:
    """Groups of the first round. A token of many sets is split by size band and at random, with the bands' pivots in
    each part: of a band the set with the fewest shingles of its own."""
    none = F.lit(0).cast("long")
    sent = posts.where(F.col("k") <= GROUP).withColumns({"band": F.lit(-1).cast("long"), "s": none, "pivot": F.lit(False)})
    if most > GROUP:
        hot = posts.where(F.col("k") > GROUP).withColumn("band", _band())
        parts = hot.groupBy("token", "band").agg(F.count("*").alias("c"), F.min(F.struct("alone", "set")).alias("v"))
        parts = written(parts.select("token", "band", F.ceil(F.col("c") / GROUP).cast("long").alias("parts"), F.col("v.set").alias("set")), "ngram-hot")
        own = hot.join(parts.drop("set"), ["token", "band"]).withColumns({"s": F.pmod(F.xxhash64("set", "token"), F.col("parts")), "pivot": F.lit(False)}).drop("parts")
        pivots = hot.join(parts.drop("parts"), ["token", "band", "set"]).withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        pivots = pivots.join(parts.drop("set"), ["token", "band"]).withColumns({"s": F.explode(F.sequence(none, F.col("parts") - 1)), "pivot": F.lit(True)}).drop("parts")
        sent = sent.unionByName(own).unionByName(pivots)
    keys = sent.withColumns({"x": none, "y": none, "first": F.lit(True), "second": ~F.col("pivot"), "visitor": F.lit(False), "component": F.col("cls")})
    return keys.drop("alone", "set", "k")


def _between(posts: DataFrame, component: DataFrame, left: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Groups of the later rounds, and how many rows they have but for those dealt to several tasks: those of the tokens that had partners left, and those that many sets have."""
    left = written(left, "ngram-left")
    own = lookup(posts.where(F.col("k") <= GROUP), left, "token", "left_semi")
    if most > GROUP:
        own = own.unionByName(posts.where(F.col("k") > GROUP))
    own = written(lookup(own, component.select(F.col("node").alias("cls"), "component"), "cls", n=rows(component)).withColumn("component", F.coalesce("component", "cls")), "ngram-own")
    own_rows = own
    open_ = own.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    own = lookup(own, written(open_, "ngram-open"), "token", "left_semi")
    none = F.lit(0).cast("long")
    sent = own.where(F.col("k") <= GROUP).withColumns({"band": F.lit(-1).cast("long"), "x": none, "y": none, "first": F.lit(True), "second": F.lit(True), "visitor": F.lit(False)})
    if most > GROUP:
        # a band's sets meet each other and those of the next band; in blocks, each of which goes to the tasks of all pairs with it
        hot = own.where(F.col("k") > GROUP).withColumn("own", _band())
        hot = hot.withColumn("band", F.explode(F.array(F.col("own"), F.col("own") - 1))).withColumn("visitor", F.col("own") != F.col("band")).drop("own")
        blocks = written(hot.groupBy("token", "band").agg(F.ceil(F.count("*") / GROUP).cast("long").alias("blocks"), F.min("visitor").alias("alone")).where("not alone").drop("alone"), "ngram-blocks")
        hot = hot.join(blocks, ["token", "band"]).withColumns({"i": F.pmod(F.xxhash64("set"), F.col("blocks")), "j": F.explode(F.sequence(none, F.col("blocks") - 1))})
        hot = hot.withColumns({"x": F.least("i", "j"), "y": F.greatest("i", "j"), "first": F.col("i") <= F.col("j"), "second": F.col("i") >= F.col("j")}).drop("i", "j", "blocks")
        sent = sent.unionByName(hot)
    return sent.withColumns({"s": none, "pivot": F.lit(False)}).drop("alone", "set", "k"), rows(own_rows)


def _wide_apart(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """pairs without those of large sets whose wide parities differ too much."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            p = np.flatnonzero(x.column("_p").is_valid().to_numpy(zero_copy_only=False) & x.column("_q").is_valid().to_numpy(zero_copy_only=False))
            both = x.column("w").to_numpy()
            fine = np.ones(len(both), bool)
            bits = [*x.column("_p").take(pa.array(p)).to_pylist(), *x.column("_q").take(pa.array(p)).to_pylist()]
            k = np.arange(len(p))
            fine[p] = apart(bits, k, k + len(p), 500) <= both[p] - 2 * least_overlap(both[p], 0, percent)
            yield pa.RecordBatch.from_arrays([x.column(c).filter(pa.array(fine)) for c in ("a", "b", "w")], names=["a", "b", "w"])

    large = pairs.where(F.col("w") > 2 * WIDTH).join(wide.toDF("a", "_p"), "a", "left").join(wide.toDF("b", "_q"), "b", "left")
    return written(pairs.where(F.col("w") <= 2 * WIDTH).unionByName(large.select("a", "b", "w", "_p", "_q").mapInArrow(run, "a long, b long, w long")), "ngram-close")


def _passed(sent: DataFrame, count: int, percent: int, first: bool, high: int | None) -> DataFrame:
    """Of about count rows sent, pairs (a, b, w), a > b, of different components, that the walk and the parities let pass, of ranks below high; and
    the tokens of groups, not dealt to several tasks (band -1), that have higher ranks."""

    def walk(x: pd.DataFrame) -> pd.DataFrame:
        group = x.groupby(["token", "band", "s", "x", "y"]).ngroup().to_numpy()
        component, doc, n, visitor, band, token = (x[c].to_numpy() for c in ("component", "cls", "n", "visitor", "band", "token"))
        # of two components, one at least is not a group's largest; within one block those alone need to probe. In the
        # first round all do, so that a group in which a pair is left is known by the ranks
        count = pd.DataFrame({"g": group, "c": component, "n": 1}).groupby(["g", "c"], as_index=False)["n"].sum()
        largest = count.sort_values(["g", "n", "c"]).drop_duplicates("g", keep="last").set_index("g")["c"].reindex(group).to_numpy()
        same = (x["x"] == x["y"]).to_numpy()
        probing = x["second"].to_numpy() & (first | ~(same & (component == largest)))
        p, q, rank = near_pairs(x, group, x["first"].to_numpy(), probing, percent)
        fine = (component[p] != component[q]) & ~(visitor[p] & visitor[q])
        p, q, rank = p[fine], q[fine], rank[fine]
        over = np.unique(token[p[(rank >= high) & (band[p] < 0)]]) if high else token[:0]
        fine = rank < (high or np.inf)
        p, q = p[fine], q[fine]
        out = pd.DataFrame({"a": np.maximum(doc[p], doc[q]), "b": np.minimum(doc[p], doc[q]), "w": n[p] + n[q], "token": pd.array([pd.NA] * len(p), "Int64")}).drop_duplicates(["a", "b"])
        none = pd.array([pd.NA] * len(over), "Int64")
        return pd.concat([out.astype("Int64"), pd.DataFrame({"a": none, "b": none, "w": none, "token": pd.array(over, "Int64")})])

    out = written(_dealt(sent, ["token", "band", "s", "x", "y"], count, 20_000).groupBy("bucket").applyInPandas(walk, "a long, b long, w long, token long"), "ngram-passed")
    release(sent.sparkSession)
    return out
