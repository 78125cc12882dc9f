"""Best-fit packing of token sequences, hierarchically.

Every partition tokenises its documents and packs them by best fit, longest first. Bins that are nearly full are done;
the others go on as single items, and a tree of rounds merges the items of ever more partitions by best fit again.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, written

CAPACITY, FAN = 2048, 8
#: A bin that has no more than this free is nearly full, in every round alike.
TOLERANCE = 8
#: A round's task holds so many items at most; a round that would leave more in its last group deals them into several.
ITEMS = 200_000
#: Unicode's white space, and the pattern by which byte-level BPE splits texts. Of BLANKS the last goes with what follows.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
BLANKS = re.compile(f"[{SPACE}]{{2,}}(?=[^{SPACE}])")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill; longest first, each into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, fill = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still take
    mask = 0  # the sizes of which there is one
    for i in order.tolist():
        n = int(lengths[i])
        if fits := mask >> n:
            rest = n + (fits & -fits).bit_length() - 1
            b = free[rest].pop()
            if not free[rest]:
                mask ^= 1 << rest
        else:
            b, rest = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if rest := rest - n:
            free[rest].append(b)
            mask |= 1 << rest
    return bins, offsets, np.array(fill, np.int64)


def numbered_bytes(tokenizer) -> dict[bytes, int] | None:
    """Tokens of a byte-level BPE that splits texts by PATTERN and numbers tokens in the order of their merges, as bytes; None for any other tokenizer."""
    spec = json.loads(tokenizer.to_str())
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    # byte-level BPE writes bytes as characters: printable ones as themselves, the others from 256 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    vocab = {k: i for k, i in model["vocab"].items() if k not in {t["content"] for t in spec["added_tokens"]}}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)) or len(merged) + 256 != len(vocab) or not all(k in vocab for k in byte):
        return None
    if any(len(tokenizer.model.tokenize(k)) != 1 for k in vocab):  # a token that no merges lead to
        return None
    return {bytes(map(byte.__getitem__, k)): i for k, i in vocab.items()}


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, as the tokenizer's encode without a template's tokens.

    ids() first splits a text at the tokenizer's added tokens; encode() takes what lies between, all of it as ordinary text. A byte-level BPE is run by tiktoken, which gives the same ids without an object for each; any other tokenizer encodes by itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in tokenizer.get_added_tokens_decoder().items()}
        heedless = not any(t.single_word or t.lstrip or t.rstrip for _, t in added.values())
        ranks = numbered_bytes(tokenizer) if heedless else None
        self.bpe = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.tokenizer = None if self.bpe else tokenizer  # a worker keeps one of them
        self.added = {k: np.array([i], "<u4").tobytes() for k, (i, _) in added.items()}
        # of those that begin at one place the longest counts
        self.cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def ids(self, text: str) -> bytes:
        if self.bpe is None:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, at = [], 0
        for m in self.cut.finditer(text) if self.cut else ():
            out += self.encode(text[at : m.start()]), self.added[m[0]]
            at = m.end()
        return b"".join([*out, self.encode(text[at:])]) if out else self.encode(text)

    def encode(self, text: str) -> bytes:
        find = functools.partial(self.bpe.encode_to_numpy, allowed_special=set(), disallowed_special=())
        try:
            return find(text).astype("<u4", copy=False).tobytes()
        except ValueError:  # blanks beyond what its pattern can go back over, before a word
            ends = [0, *(m.end() - 1 for m in BLANKS.finditer(text)), len(text)]
            return b"".join(find(text[a:b]).astype("<u4", copy=False).tobytes() for a, b in zip(ends, ends[1:], strict=False))


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker process keeps it."""
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenised(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """PIECES of all rows of docs, packed within each partition. bin: partition << 32 | the bin's number there."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = encoder(tokenizer or default_tokenizer()), TaskContext.get().partitionId()
        found: list[list] = [[], [], [], [], []]
        for x in batches:
            for doc, text in zip(x.column("doc_id").to_pylist(), x.column("text").to_pylist(), strict=True):
                ids = known.ids(text) + b"\0\0\0\0"  # id 0 ends a document
                n = len(ids) // 4
                ends = range((n - 1) % capacity + 1, n + 1, capacity)
                for k, end in enumerate(ends):
                    start = ends[k - 1] if k else 0
                    for to, v in zip(found, (doc, k, start, end - start, zlib.crc32(ids[4 * start : 4 * end])), strict=True):
                        to.append(v)
        length = np.array(found[3], np.int64)
        bins, offsets, fill = best_fit(length, capacity)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        arrays = [*(pa.array(v, k) for v, k in zip(found, kinds, strict=True)), pa.array(bins + (part << 32)), pa.array(offsets), pa.array(fill[bins] if len(bins) else fill)]
        yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An added token's string in a text is that token. A document's ids end with id 0; only documents longer than capacity are cut, the first piece taking what is odd.
    Null and empty texts are the id 0 alone. Repeated rows are packed as often as they come; a null doc_id stays null.
    An empty table gives an empty result; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    pieces = written(tokenised(docs, tokenizer, capacity), "pack-pieces")
    parts = (pieces.agg(F.max("bin")).first()[0] or 0) // 2**32 + 1

    def merge(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("bin")
        bins, offsets, fill = best_fit(x["fill"].to_numpy(), capacity)
        own = x["bin"].to_numpy()
        first = np.zeros(len(fill), np.int64)
        first[bins[offsets == 0]] = own[offsets == 0]  # a merged bin goes by the name of its first item
        return pd.DataFrame({"bin": own, "into": first[bins], "shift": offsets, "fill": fill[bins]})

    items = pieces.where(F.col("offset") == 0).select("bin", "fill")
    moves, level = None, 0
    while parts > 1:
        level, parts = level + 1, -(-parts // FAN)
        items = written(items.where(F.col("fill") < capacity - TOLERANCE), "pack-items")
        if not (n := items.count()):
            break
        group = F.shiftrightunsigned("bin", 32) / F.lit(FAN**level)
        salt = F.pmod(F.xxhash64("bin"), F.lit(-(-n // (ITEMS * parts))))
        merged = written(items.groupBy(group.cast("long").alias("g"), salt.alias("s")).applyInPandas(merge, "bin long, into long, shift long, fill long"), "pack-merged")
        step = merged.where("bin <> into or shift <> 0").select("bin", "into", "shift")
        if moves is None:
            moves = step
        else:
            later = step.select(F.col("bin").alias("into"), F.col("into").alias("_into"), F.col("shift").alias("_shift"))
            moved = moves.join(later, "into", "left").select("bin", F.coalesce("_into", "into").alias("into"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
            moves = written(moved.unionByName(step), "pack-moves")
        items = merged.where("bin = into").select("bin", "fill")
    if moves is None:
        moves = spark.createDataFrame([], "bin long, into long, shift long")
    return pieces.join(moves, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )
