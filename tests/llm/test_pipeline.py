"""The pipeline's stages against brute force, each on its own input."""

import itertools
import random

import pytest

import corpus_pipeline as P
from joulemark.llm import language_id, mixing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    r = random.Random(4)
    word = lambda letters: "".join(r.choices(letters, k=r.randint(2, 7)))
    base = [(" ".join(word(k) for _ in range(r.randint(30, 200))), lang) for lang, k in (("xx", "abcdef"), ("yy", "ghijkl")) for _ in range(20)]
    rows = []
    for i in range(150):
        text, lang = r.choice(base)
        if i % 3:
            w = text.split()
            w[r.randrange(len(w))] = "aa" if lang == "xx" else "gg"
            text = " ".join(w)
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    rows += [(150, None, None, None, None), (151, "12 34", "xx", "s1", 5), (152, "", None, None, 0)]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    docs, out = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in P.STAGES:
        got = stage(spark, docs, path)
        got.write.parquet(f"{path}/{name}")
        out.append((docs, spark.read.parquet(f"{path}/{name}")))
        docs = out[-1][1]
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "mixing", "packing"] and P.ORACLE_SQL is None


def test_all_but_the_last_keep_the_columns(stages):
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, after in stages[:-1])


def test_language(stages):
    before, after = stages[0]
    trees, rows = language_id.train(before), before.collect()
    lang, score = trees.predict([r["text"] for r in rows])
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r, x, s in zip(rows, lang, score, strict=True) if x != "und" and s >= 0.5} == set(range(150))


def test_copies(stages):
    before, after = stages[1]
    keep = {}
    for r in before.collect():
        keep[r["text"]] = max(keep.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in after.collect()} == set(keep.values())


def test_near_copies(stages):
    before, after = stages[2]
    sets = {}
    for r in before.collect():
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    at = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                at[a] = at[b] = min(at[a], at[b])
        if all(at[at[i]] == at[i] for i in at):
            break
    assert {r["doc_id"] for r in after.collect()} == {i for i in at if at[i] == i}


def test_mixing(stages):
    before, after = stages[3]
    drawn = mixing.mix(before, ["doc_id"]).where("_sampled").select("doc_id")
    assert {r[0] for r in drawn.collect()} == {r["doc_id"] for r in after.collect()}


def test_packing(stages):
    before, after = stages[4]
    out = after.toPandas()
    assert set(out["doc_id"]) == {r["doc_id"] for r in before.collect()}
    assert (out.groupby("sequence_id")["length"].sum() <= 2048).all()


#: Names that the stages use, or have used, for columns of their own.
NAMES = "score double, lang_pred string, _text string, _digest string, _weight double, _topic string, _source string, _factor double, _sampled boolean, id long, Component_ID long"


def odd_rows(r):
    word = lambda: "".join(r.choices("abcdef", k=r.randint(2, 7)))
    long = " ".join(word() for _ in range(30_000))
    texts = {1: "one two three four five six seven", 2: "one two three four five six seven", 3: long, 4: long + " more", 5: None, 6: "", 7: " ".join(word() for _ in range(50))}
    extra = (9.0, "mine", "t", "d", 7.0, "x", "y", 3.0, True, 4, 5)
    rows = [(k, t, "xx", "s", 1, *extra) for k, t in texts.items()] + [(1, texts[1], "xx", "s", 1, *extra)] * 2 + [(None, texts[1], None, None, None, *[None] * 11), (None, None, None, None, None, *[None] * 11)]
    return rows + [(100 + i, " ".join(word() for _ in range(40)), "xx", "s", 1, *extra) for i in range(30)]


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names: each stage's stated result."""
    rows = odd_rows(random.Random(2))
    df = spark.createDataFrame(rows, f"{COLUMNS}, {NAMES}")
    df.write.parquet(f"{tmp_path}/in")
    stages, df = dict(P.STAGES), spark.read.parquet(f"{tmp_path}/in")
    got = {k: stages[k](spark, df, str(tmp_path)) for k in ("language_id", "exact_dedup", "ngram_jaccard", "mixing")}
    assert all(x.columns == df.columns for x in got.values())
    kept = {k: sorted((r["doc_id"] for r in x.collect()), key=str) for k, x in got.items()}
    assert kept["language_id"] == sorted([1, 1, 1, 2, 3, 4, 7, None, *range(100, 130)], key=str)
    assert kept["exact_dedup"] == sorted([2, 3, 4, 6, 7, *range(100, 130)], key=str)
    assert kept["ngram_jaccard"] == sorted([1, 1, 1, 3, 5, 6, 7, None, None, *range(100, 130)], key=str)
    assert set(kept["mixing"]) <= {1, 2, 3, 4, 7, None, *range(100, 130)} and kept["mixing"].count(1) in (0, 3)
    values = [tuple(r) for r in got["exact_dedup"].where("doc_id = 2").collect()]
    assert values == [rows[1]]
    packed = stages["packing"](spark, df, str(tmp_path)).toPandas()
    assert set(packed["doc_id"].dropna()) == {r[0] for r in rows if r[0] is not None} and (packed[packed["doc_id"] == 1]["piece"] == 0).sum() == 3


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [f(spark, df, str(tmp_path)).count() for _, f in P.STAGES] == [0] * 5
    assert P.run(spark, str(tmp_path)).count() == 0
