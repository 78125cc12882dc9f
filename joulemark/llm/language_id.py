"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of varying order is fitted once on a bounded sample of labelled documents and
then frozen. A text's exact code length under a language is the sum, over its bytes, of the escapes from the longest
known context down to one that has seen the byte, and of that byte's own code length (escape method C, no exclusions;
below order 0 all 256 bytes are alike). The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, small_batches

ORDER = 3
#: A context belongs to a language's tree if it was seen so often in its sample.
LEAST = 6
#: Labelled documents of a language that are sampled (expected number), the bytes of such a document at most, and languages at most.
SAMPLE, LONGEST, LANGUAGES = 250, 100_000, 200
#: Bytes scored at once.
CHUNK = 1 << 16


class ContextTrees:
    """Frozen statistics: symbols[256], child[state, symbol] and cost[state, symbol, language] in bits.

    A state is a context that some language's tree holds; symbol 0 stands for a text's start, 1 for bytes never seen.
    """

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER, least: int = LEAST):
        self.langs, self.order = sorted(texts), order
        pad = bytes(order)
        joined = {k: np.frombuffer(pad + pad.join(t.encode("utf-8", "replace").replace(b"\0", b" ") for t in texts[k]), np.uint8) for k in self.langs}
        seen = np.unique(np.concatenate([*joined.values(), np.zeros(1, np.uint8)]))
        self.symbols = np.ones(256, np.int64)
        self.symbols[seen] = np.where(seen == 0, 0, np.arange(len(seen)) + 1)
        size = len(seen) + 1
        state, rows, child = {(): 0}, [np.full((size, len(self.langs)), 8.0)], [np.full(size, -1, np.int32)]
        for k in range(order + 1):
            tables = [self._counts(self.symbols[joined[lang]], k, size, least if k else 1) for lang in self.langs]
            for context in sorted(set().union(*tables)):
                # without the oldest byte it is the next shorter context, which is known if this one is
                row = rows[state[context[1:]] if k else 0].copy()
                for i, table in enumerate(tables):
                    if context in table:
                        which, n = table[context]
                        total = n.sum() + len(n)
                        row[:, i] += np.log2(total / len(n))
                        row[which, i] = np.log2(total / n)
                if k == 0:
                    rows[0] = row
                    continue
                state[context] = len(rows)
                child[state[context[1:]]][context[0]] = len(rows)
                rows.append(row)
                child.append(np.full(size, -1, np.int32))
        self.child, self.cost = np.stack(child), np.stack(rows).astype(np.float32)

    @staticmethod
    def _counts(ids: np.ndarray, k: int, size: int, least: int) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
        """Per context of k symbols, oldest first: the symbols that followed and how often."""
        n = len(ids) - k
        if n <= 0:
            return {}
        key, inside = np.zeros(n, np.int64), np.ones(n, bool)
        for j in range(k + 1):
            key = key * size + ids[j : j + n]
            inside &= ids[j : j + n] > 0
        keys, counts = np.unique(key[inside], return_counts=True)
        contexts, start = np.unique(keys // size, return_index=True)
        out = {}
        for c, a, b in zip(contexts.tolist(), start, [*start[1:], len(keys)], strict=True):
            if counts[a:b].sum() >= least:
                out[tuple(c // size**j % size for j in reversed(range(k)))] = (keys[a:b] % size, counts[a:b].astype(float))
        return out

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        flat = np.frombuffer(b"".join(texts), np.uint8)
        length = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.cumsum(length) - length
        for a in range(0, len(flat), CHUNK):
            b, low = min(a + CHUNK, len(flat)), max(0, a - self.order)
            ids = self.symbols[flat[low:b]]
            at = np.arange(a, b)
            of = np.searchsorted(start, at, "right") - 1
            begins = start[of]
            state, alive = np.zeros(b - a, np.int32), np.ones(b - a, bool)
            for k in range(1, self.order + 1):
                older = np.where(at - k >= begins, ids[np.maximum(at - k - low, 0)], 0)
                found = self.child[state, older]
                alive &= found >= 0
                state = np.where(alive, found, state)
            cost = self.cost[state, ids[a - low :]]
            lo, hi = of[0], of[-1] + 1
            for i in range(len(self.langs)):
                out[lo:hi, i] += np.bincount(of - lo, weights=cost[:, i], minlength=hi - lo)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; `und` and 0 where a text is null or has no letter."""
        known = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        bits = self.bits([t.encode("utf-8", "replace") if k else b"" for t, k in zip(texts, known, strict=True)])
        best = bits.argmin(1)
        odds = np.exp2(np.clip(bits.min(1, keepdims=True) - bits, -1000, 0))
        score = np.where(known, 1 / odds.sum(1), 0.0)
        return [self.langs[i] if k else "und" for i, k in zip(best, known, strict=True)], score


def sample(docs: DataFrame, per_language: int = SAMPLE) -> dict[str, list[str]]:
    """Texts of about per_language documents of each language, chosen by a hash of the identifier, of LONGEST bytes at most
    (so that the sample is bounded: about 25 MB a language); rows that repeat a document count once."""
    docs = docs.where("lang is not null and text is not null").where(F.octet_length("text") <= LONGEST).select("doc_id", "text", "lang")
    counts = docs.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_language / r["count"]))])
    rows = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).dropDuplicates(["doc_id", "lang"]).orderBy("lang", "doc_id").select("lang", "text").collect()
    texts: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in rows:
        texts[r["lang"]].append(r["text"])
    return {k: v for k, v in texts.items() if v}


def fold() -> object:
    """0 to 4; documents of fold 0 are held out of the training."""
    return F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(5))


def identify(docs: DataFrame, trees: ContextTrees, columns: list[str]) -> DataFrame:
    """columns of docs, then lang_pred and score, from the whole text; extra columns of docs are dropped. Where columns
    have these names (in any case), the two are called with as many underscores in front as make them free.

    Null text, empty text and text without a letter: `und`, score 0. Very long texts are scored whole, CHUNK bytes at a
    time. Of languages with equal code lengths the first by name is predicted. Repeated rows are scored alike.
    """
    spark = docs.sparkSession
    whole, pred, score = free_name("_text", columns), free_name("lang_pred", columns), free_name("score", columns)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trees)  # bounded: the sample is

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = shared.value
        for x in batches:
            found = trees.predict([t if isinstance(t, str) else None for t in x[whole]])
            yield x.drop(columns=whole).assign(**{pred: found[0], score: found[1]})

    own = docs.select(*(f"`{c}`" for c in columns), F.col("text").alias(whole))
    fields = [f for f in own.schema if f.name != whole]
    return own.mapInPandas(run, T.StructType([*fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))


def train(docs: DataFrame) -> ContextTrees:
    """Learns from text and lang of labelled documents outside fold 0 only. A null doc_id has no fold and isn't learned from."""
    return ContextTrees(sample(docs.where(fold() != 0)))
