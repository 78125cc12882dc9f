"""Each operator against brute force or planted cases, with nulls, empty and repeated rows, empty tables and clashing names."""

import collections

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from joulemark.llm import common, exact_dedup, html_text, language_id, mixing, near_vectors, ngram_join, packing, pii, sharding, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    rows, base = [], [words(r, r.randint(5, 120)) for _ in range(40)]
    for i in range(220):
        text = r.choice(base)
        if i % 3 == 0:
            w = text.split()
            w[r.randrange(len(w))] = "zz"
            text = " ".join(w)
        elif i % 3 == 1:
            text = words(r, r.randint(0, 60))
        rows.append((i, text, r.choice(["xx", "yy"]), r.choice(["s1", "s1", "s1", "s2", None]), len(text)))
    rows += [(220, None, None, None, None), (221, "", "xx", "s2", 0), (222, "  \n ", "yy", "s2", 4), (223, "One", "xx", "s2", 3), (224, "two words", "xx", None, 9), (225, "x" * 30_000, "xx", "s1", 30_000), (226, words(r, 4000), "yy", "s1", 0)]
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5)


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


def odd(spark):
    """Null identifiers, repeated rows, and columns whose names the operators use inside."""
    rows = [(1, "a b c d", "xx", "s", 1, 0, "q", "k"), (1, "a b c d", "xx", "s", 1, 0, "q", "k"), (None, "a b c d", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS + ", row long, digest string, component string")


@pytest.mark.parametrize("size", [100_000, 40])
def test_components_of_a_path_a_star_and_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(common, "FOREST", size)
    edges = [(i, i + 1) for i in range(60)] + [(1000, k) for k in range(1001, 1300)] + [(5000, 5000)]
    found = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {i: 0 for i in range(61)} | {k: 1000 for k in range(1000, 1300)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    first = common.connected_components(spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "a long, b long"))
    more = common.joined_components(first, spark.createDataFrame([(2, 9), (7, 5), (3, 0)], "a long, b long"))
    assert dict(map(tuple, more.collect())) == {1: 1, 2: 1, 8: 1, 9: 1, 5: 5, 6: 5, 7: 5, 3: 0, 0: 0}


def test_language(spark):
    r = random.Random(1)
    rows = [(i, words(r, 30, "abcde" if i % 2 else "fghij"), "xx" if i % 2 else "yy", "s", 0) for i in range(200)]
    rows += [(900, None, "xx", "s", 0), (901, "123 !?", "yy", "s", 0), (902, "", None, "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    out = {x["doc_id"]: x for x in language_id.identify(df, language_id.train(df), ["doc_id"]).collect()}
    assert all(out[i]["lang_pred"] == t for i, _, t, *_ in rows[:200]) and all(0 < out[i]["score"] <= 1 for i in range(200))
    assert {out[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert language_id.identify(empty(spark), language_id.train(empty(spark)), ["doc_id"]).count() == 0
    assert language_id.identify(odd(spark), language_id.train(df), odd(spark).columns).count() == 4


def test_code_length_is_that_of_plain_ppm(monkeypatch):
    texts = {"a": ["abracadabra abracadabra", "cadabra"], "b": ["zyzzyva zyx", "xyz zyzzy"]}
    trees = language_id.ContextTrees(texts, order=2, least=1)

    def plain(lang, text):
        counts = collections.defaultdict(collections.Counter)
        for t in texts[lang]:
            for i, k in itertools.product(range(len(t)), range(3)):
                if i >= k:
                    counts[t[i - k : i]][t[i]] += 1
        bits = 0.0
        for i, c in enumerate(text):
            for k in range(min(2, i), -1, -1):
                seen = counts.get(text[i - k : i])
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if c in seen:
                    bits += np.log2(total / seen[c])
                    break
                bits += np.log2(total / len(seen))
            else:
                bits += 8
        return bits

    probes = ["abra", "zyz cad", "q", "cadabra zyzzyva"]
    expected = [[plain(k, t) for k in ("a", "b")] for t in probes]
    assert np.allclose(trees.bits([t.encode() for t in probes]), expected, rtol=1e-5)
    monkeypatch.setattr(language_id, "CHUNK", 3)
    assert np.allclose(trees.bits([t.encode() for t in probes]), expected, rtol=1e-5)


def test_exact_dedup(spark, corpus, docs):
    group = collections.defaultdict(list)
    for i, t, *_ in corpus:
        group[t or ""].append(i)
    for digest in (exact_dedup.sha256_digest, lambda c: F.substring(exact_dedup.sha256_digest(c), 1, 0), lambda c: F.unhex(F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 2))):  # the others collide
        out = exact_dedup.exact_dedup(docs, digest).collect()
        assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in out} == {(i, max(g), len(g), i == max(g)) for g in group.values() for i in g}
    assert sorted(r["doc_id"] for r in exact_dedup.without_copies(docs).collect()) == sorted(max(g) for g in group.values())
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0
    kept = exact_dedup.without_copies(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == [(1, "a b c d"), (None, None)]


def dedup_rows(df):
    return sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in df.collect())


def expected_dedup(rows):
    group = collections.defaultdict(list)
    for i, t in rows:
        group[t or ""].append(i)
    return sorted((i, max(g), len(g), i == max(g)) for g in group.values() for i in g)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda c: F.unhex(F.substring(F.sha2(F.encode(c, "UTF-8"), 256), 1, 1 + 1))])
def test_dedup_state_goes_on_from_call_to_call(spark, tmp_path, digest):
    """Over growing input, in batches; with a digest that collides, rows of earlier calls are read again by their locators."""
    r = random.Random(3)
    rows, state = [], f"file://{tmp_path}/state"
    for call in range(3):
        more = [(1000 * call + i, r.choice([None, "", *(f"text {k}" for k in range(40))]) if i % 3 else f"own {call} {i}") for i in range(60)]
        rows += more
        df = spark.createDataFrame(more, "doc_id long, text string").repartition(4)
        if call:  # as files, and as rows of a query
            df.write.parquet(f"{tmp_path}/in{call}")
            df = spark.read.parquet(f"{tmp_path}/in{call}")
        assert dedup_rows(exact_dedup.exact_dedup(df, digest, state, files_per_batch=2)) == expected_dedup(rows)


def test_dedup_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    rows, state, save = [(i, f"text {i % 7}") for i in range(100)], f"file://{tmp_path}/state", exact_dedup._save
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    df.write.parquet(f"{tmp_path}/in")

    def failing(df, k, out):
        if k == 2:
            raise RuntimeError("an executor is lost")
        save(df, k, out)

    monkeypatch.setattr(exact_dedup, "_save", failing)
    with pytest.raises(Exception, match="executor is lost"):
        exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/in"), state=state, call="monday", files_per_batch=1)
    monkeypatch.setattr(exact_dedup, "_save", save)
    assert dedup_rows(exact_dedup.exact_dedup(spark.read.parquet(f"{tmp_path}/in"), state=state, call="monday", files_per_batch=1)) == expected_dedup(rows)
    assert dedup_rows(exact_dedup.exact_dedup(spark.createDataFrame([(200, "text 3")], "doc_id long, text string"), state=state)) == expected_dedup([*rows, (200, "text 3")])


def test_dedup_of_a_table_with_names_used_inside(spark):
    df = spark.createDataFrame([(1, "a", "mine", "lost?", "x"), (2, "a", "yours", None, "y")], "doc_id long, text string, digest string, lost string, `_digest` string")
    assert [tuple(r) for r in exact_dedup.without_copies(df).collect()] == [(2, "a", "yours", None, "y")]


def test_mixing(spark, corpus, docs):
    out = mixing.mix(docs, ["doc_id"]).toPandas()
    assert len(out) == len(corpus) and out["_prob"].between(0, 1).all()
    out["w"] = out["_weight"] * out["_tokens"]
    for c, power in (("_source", 0.8), ("_lang", 0.85), ("_topic", 0.95)):
        share = out.groupby(c)["_tokens"].sum() / out["_tokens"].sum()
        share = share[share > 0] ** power
        got = out.groupby(c)["w"].sum() / out["w"].sum()
        assert np.allclose((share / share.sum()).sort_index(), got[got > 0].sort_index(), atol=1e-4)
    assert mixing.mix(empty(spark), ["doc_id"]).count() == 0
    assert mixing.mix(odd(spark), odd(spark).columns).count() == 4


def test_mixing_to_given_targets(spark):
    rows = [(i, "a b c d", "xx" if i % 4 else "yy", f"s{i % 3}", 0) for i in range(2400)]
    df = spark.createDataFrame(rows, DOCS).withColumn("kind", F.when(F.col("doc_id") % 5 == 0, "k1").otherwise("k2"))
    targets = {"source": {"s0": 1, "s1": 1, "s2": 2}, "lang": {"xx": 1, "yy": 1, "absent": 0}, "topic": {"k1": 0.3, "k2": 0.7}}
    out = mixing.mix(df, ["doc_id"], targets=targets, by=F.col("kind")).toPandas()
    for c, want in (("_source", [0.25, 0.25, 0.5]), ("_lang", [0.5, 0.5]), ("_topic", [0.3, 0.7])):
        got = out.groupby(c)["_weight"].sum() / out["_weight"].sum()
        assert np.allclose(got.sort_index(), want, atol=1e-5)
        drawn = out[out["_sampled"]].groupby(c).size() / out["_sampled"].sum()
        assert np.allclose(drawn.sort_index(), want, atol=0.06)
    left_out = mixing.mix(df, ["doc_id"], targets={"lang": {"yy": 1}}).toPandas()
    assert (left_out[left_out["_lang"] == "xx"]["_prob"] == 0).all() and (left_out[left_out["_lang"] == "yy"]["_prob"] > 0).all()
    nulls = spark.createDataFrame([(None, f"text {i}", "xx", "s", 0) for i in range(400)], DOCS)
    assert 0 < mixing.mix(nulls, ["doc_id"], rate=0.5).where("_sampled").count() < 400


def brute_links(v, labels, cosine=0.93):
    out = collections.defaultdict(set)
    for i, j in itertools.combinations(range(len(v)), 2):
        if labels[i] is None or labels[i] != labels[j]:
            continue
        a, b = (None if x is None or any(c is None or not np.isfinite(c) for c in x) or not any(x) else np.array(x, float) for x in (v[i], v[j]))
        if a is not None and b is not None and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
            out[i].add(j)
            out[j].add(i)
    return out


def components(n, links):
    seen = {}
    for i in range(n):
        todo = [] if i in seen else [i]
        while todo:
            k = todo.pop()
            if k not in seen:
                seen[k] = i
                todo += links[k]
    return seen


def test_near_vectors(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres, rows, labels = r.normal(size=(6, 16)), [], []
    for i in range(400):
        c = centres[0] if i % 3 == 0 else centres[i % 6] if i % 3 == 1 else r.normal(size=16)
        rows.append([float(x) for x in np.float32(c + r.normal(size=16) * (0.05 if i % 2 else 0.25))])
        labels.append(i % 2 if i % 11 else 0)
    rows += [None, [0.0] * 16, [float("nan"), *[1.0] * 15], [None, *[1.0] * 15], rows[0], rows[0], rows[2], [1.0] * 16]
    labels += [0, 0, 0, 0, labels[0], labels[0], None, None]
    df = spark.createDataFrame([(i, v, label) for i, (v, label) in enumerate(zip(rows, labels, strict=True))], "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x"))
    links = brute_links(rows, labels)
    expected = components(len(rows), links)
    for cell in (1500, 40):
        monkeypatch.setattr(near_vectors, "CELL", cell)
        out = {x["vec_id"]: x for x in near_vectors.near_vectors(df).collect()}
        assert {i: (x["n_links"], x["component_id"]) for i, x in out.items()} == {i: (len(links[i]), expected[i]) for i in range(len(rows))}
    assert near_vectors.near_vectors(df.limit(0)).count() == 0
    named = df.where("vec_id < 60").withColumn("label", F.concat(F.lit("kind "), F.col("label").cast("string")))
    plain = {tuple(x) for x in near_vectors.near_vectors(df.where("vec_id < 60")).collect()}
    assert {tuple(x) for x in near_vectors.near_vectors(named).collect()} == plain


def test_cover_tree_levels():
    r = np.random.default_rng(4)
    x = np.concatenate([c + r.normal(size=(60, 8)) * 0.05 for c in r.normal(size=(5, 8))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = near_vectors._tree(x, np.arange(len(x)))

    def check(node):
        apart = np.linalg.norm(x[node.points] - x[node.centre], axis=1)
        assert apart.max() <= node.radius + 1e-7
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children])) == sorted(node.points)
            for c in node.children:
                # half the radius, but for what no level holds together
                assert c.radius <= node.radius / 2 + 1e-7 or not c.children
                check(c)

    assert tree.children
    check(tree)


def test_pii(spark):
    texts = ["mail a.b@c.example.com. or x@y", "a@b.c_x@d.e", "ip 1.2.3.4.5.6.7.8 and 999.1.1.1 and 010.0.0.255", "card 4111 1111 1111 1111 and 4111111111111112", "call +1 (415) 555-0100 or +12", None, "", "é" * 5 + " b@c.de", "1 " * 9000, "token = \"" + "0a" * 20 + "\"", "9" * 20_000, "a" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("more", F.lit(1))
    out = {r["doc_id"]: r for r in pii.find(df).select("doc_id", *pii.KINDS, pii.joined(F.col("base")).alias("base"), pii.joined(F.col("spans")).alias("spans")).collect()}
    assert out[0]["base"] == "email:5:22" and out[1]["base"] == "email:0:5,email:5:11" and out[7]["base"] == "email:6:12"
    assert out[2]["base"] == "ip:3:10,ip:11:18,ip:37:48" and out[3]["base"] == "card:5:24" and out[4]["base"] == "phone:5:22"
    assert all(out[i]["base"] == "" for i in (5, 6, 8, 10, 11)) and len(out) == len(texts)
    assert all(set(filter(None, r["base"].split(","))) <= set(r["spans"].split(",")) for r in out.values())
    assert pii.find(df.limit(0)).count() == 0


def test_pii_base_is_the_patterns(spark):
    """Against the contract's patterns, matched one after the other in Python, with the checks written out."""
    import re

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def fine(kind, x):
        d = [int(c) for c in x if c.isdigit() and c.isascii()]
        if kind == "ip":
            return all(int(p) <= 255 for p in x.split("."))
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(reversed(d))) % 10 == 0
        return kind != "phone" or 9 <= len(d) <= 15

    r = random.Random(11)
    texts = ["".join(r.choices("aB.@1+ -()é_9%0", k=r.randint(0, 60))) for _ in range(1500)] + ["".join(r.choices("0123456789 -", weights=[9] * 10 + [2, 2], k=r.randint(10, 50))) for _ in range(800)]
    texts += [" ".join(f"u{i}@h{i}.org 10.0.{i % 256}.1 4111 1111 1111 1111 +49 30 1234567{i % 10} é" for i in range(400))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for row in pii.find(df).select("doc_id", *pii.KINDS).collect():
        for kind, pattern in patterns.items():
            expected = [m.span() for m in re.finditer(pattern, texts[row["doc_id"]]) if fine(kind, m[0])]
            assert [(x["start"], x["end"]) for x in row[kind]] == expected, (kind, texts[row["doc_id"]][:200])


def test_pii_finds_planted_secrets(spark):
    r = random.Random(12)
    rows, planted = [], {}
    for i in range(300):
        key = r.choice(["AKIA" + "".join(r.choices("ABCDEFGH234567", k=16)), "ghp_" + "".join(r.choices("abcXYZ0189", k=36)), "sk-proj-" + "".join(r.choices("abc_XYZ0189", k=120)), "github_pat_" + "".join(r.choices("abcXYZ_0189", k=60))])
        text = f"the {r.choice(['key', 'token', 'secret'])} = {key} is set" if i % 3 == 0 else " ".join(r.choices(["plain", "words", "of", "prose", "0123456789abcdef0"[: r.randint(2, 12)]], k=20))
        rows.append((i, text))
        if i % 3 == 0:
            planted[i] = (text.index(key), text.index(key) + len(key))
    out = {x["doc_id"]: [(s["start"], s["end"]) for s in x["spans"] if s["kind"] == "secret"] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i] == ([planted[i]] if i in planted else []) for i in out)


def test_reliabilities_find_the_good_labelers():
    r = random.Random(6)
    tally = collections.Counter()
    for _ in range(5000):
        true = r.random() < 0.4
        tally[tuple(int(r.random() < (p if true else q)) for p, q in ((0.95, 0.05), (0.9, 0.1), (0.55, 0.45)))] += 1
    share, rates, _ = pii.reliabilities(sorted(tally.items()), 0.3)
    assert share == pytest.approx(0.4, abs=0.05) and rates[0][0] > 0.85 and rates[0][1] < 0.15 and rates[2][0] - rates[2][1] < 0.25


@pytest.mark.parametrize("shards", [40, 3])
def test_sharding(spark, corpus, docs, shards):
    out = sharding.shard(docs, shards).toPandas()
    counts = out.groupby("shard").size()
    assert sorted(out["doc_id"]) == sorted(i for i, *_ in corpus) and counts.max() - counts.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    text = {i: (t or "").encode() for i, t, *_ in corpus}
    assert all(row["size"] == len(text[row["doc_id"]]) + 16 and row["text_crc32"] == zlib.crc32(text[row["doc_id"]]) for row in out.to_dict("records"))
    assert sharding.shard(empty(spark)).count() == 0 and sharding.shard(odd(spark)).count() == 4
    if shards == 3:  # equal texts lie together: far fewer pairs apart than by chance
        same = [(a, b) for g in collections.Counter(t for t in text.values() if t) for a, b in itertools.combinations([i for i, t in text.items() if t == g], 2)]
        at = dict(zip(out["doc_id"], out["shard"], strict=True))
        assert sum(at[a] != at[b] for a, b in same) < 0.4 * len(same)


def test_sharding_gathers_groups_beside_a_large_one(spark):
    texts = ["hot"] * 1000 + [f"group {i}" for i in range(150) for _ in range(2 + i % 5)] + [f"single {i}" for i in range(1400)]
    out = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), 20).toPandas()
    assert sorted(out["doc_id"]) == list(range(len(texts))) and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
    shards = out.assign(text=[texts[i] for i in out["doc_id"]]).groupby("text")["shard"].nunique()
    assert shards["hot"] <= 10 and (shards.drop("hot") == 1).all()


def test_html():
    labeller = html_text.trained(600)
    page = """<html><head><title>T</title><script>var a="<p>no</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li><a>x<li><a>y</ul></nav>
    <div class="cookie">We use cookies.</div><article><h1>Head &amp; line</h1><p>First   para,\n with a <a href="?a>b">link</a>.<p><b>Second&nbsp;one.<br><p>Third.</article>
    <div class="comments"><h3>Comments</h3><div class="comment"><p>Nice words here.</p></div></div><form><label>Name</label><button>Send</button></form><footer>&copy; 2020 Me. All rights.</footer></body>"""
    assert html_text.main_text([page, None, "", "<p>"], labeller) == ["Head & line\n\nFirst para, with a link.\n\nSecond one.\n\nThird.", "", "", ""]
    r, wrong, total = random.Random(77), 0, 0
    for _ in range(150):
        found = html_text.blocks(html_text.training_page(r))
        truth = [html_text.MARK in t for t, *_ in found]
        p = labeller.probabilities([html_text.features([(t.replace(html_text.MARK, "") or "-", a, b) for t, a, b in found])])[0] >= 0.5
        wrong, total = wrong + int((p != np.array(truth)).sum()), total + len(found)
    assert wrong / total < 0.01


@pytest.mark.parametrize(("before", "after"), [
    ("<script>for(i=0;i<n;i++){} // don't</script>", ""), ('<script>var a="<!--";</script>', ""), ("<style>a:after{content:'<b'}</style>", ""), ("<SCRIPT>a<b</SCRIPT >", ""),
    ("<svg/>", ""), ('<svg class="i" />', ""), ("<svg>", ""), ("<iframe src=/>x</iframe>", ""), ("<noscript>a<b c='</noscript>", ""), ("", "<script>a <p>no</p>"), ("<canvas><canvas>", "<style>p{}"),
])
def test_html_text_after_raw_elements_stays(before, after):
    found = html_text.blocks(f"{before}<article><p>First long paragraph, it's here.</p><p>second</p></article>{after}")
    assert [t for t, *_ in found] == ["First long paragraph, it's here.", "second"]


def test_html_gradients():
    """Backpropagation through time agrees with differences."""
    net = html_text.Labeller()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    r = np.random.default_rng(0)
    x, mask = r.normal(size=(4, 2, 2 * html_text.WIDTH + html_text.FIGURES)).astype(np.float32), np.array([[True, True], [True, True], [True, False], [True, False]])
    for d in "fb":
        out, kept = net._pass(x, mask, d)
        g = {k: np.zeros_like(v) for k, v in net.w.items()}
        net._back(x, kept, np.ones_like(out) * mask[:, :, None], d, g)
        for name, at in ((f"h{d}", (3, 5)), (f"x{d}", (2, 40)), (f"b{d}", (20,))):
            w, e = net.w[name], 1e-3
            w[at] += e
            high = (net._pass(x, mask, d)[0] * mask[:, :, None]).sum()
            w[at] -= 2 * e
            low = (net._pass(x, mask, d)[0] * mask[:, :, None]).sum()
            w[at] += e
            assert g[name][at] == pytest.approx((high - low) / (2 * e), rel=0.05, abs=1e-3)


@pytest.mark.parametrize(("page", "texts"), [
    ('<p>one <a href="foo>two</a> three</p>', ["one two three"]), ("<p>one <b class='x>two</b></p><p>three</p>", ["one two", "three"]), ('<p title="a>b">one</p>', ["one"]), ("<p>1 < 2 and 3</p>", ["1 < 2 and 3"]),
])
def test_html_unclosed_quotes(page, texts):
    assert [t for t, *_ in html_text.blocks(page)] == texts


def test_html_tables(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>A b c.</p></article>"), (None, None, None)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    out = html_text.extract(df).collect()
    assert sorted(((r["page_id"], r["n_chars"]) for r in out), key=str) == [(1, len(out[0]["text"]) or len(out[1]["text"])), (None, 0)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_warc(spark, tmp_path):
    def record(kind, ident, url, date, status, headers, body=b""):
        http = f"HTTP/1.1 {status} X\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {ident}\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"

    import gzip

    data = [
        record("response", "r1", "http://www.A.com/x/?utm_source=f&b=2&a=1", "2024-01-01T00:00:00Z", 200, {"ETag": '"1"', "Content-Type": "text/html", "Cache-Control": "old"}, b"body1"),
        record("response", "r2", "https://a.com:443/x?a=1&b=2#top", "2024-01-02T00:00:00Z", 200, {"ETag": 'W/"2"'}, b"body2"),
        record("response", "r3", "http://a.com/x?a=1&b=2", "2024-01-02T06:00:00Z", 404, {}),
        record("revisit", "v1", "http://a.com/x?b=2&a=1", "2024-01-01T12:00:00Z", 304, {"ETag": '"1"', "Content-Type": "text/plain", "Cache-Control": "new"}),
        record("revisit", "v2", "http://a.com/x?b=2&a=1", "2024-01-03T00:00:00Z", 304, {"ETag": '"9"'}),
        record("revisit", "v3", "http://a.com/x?b=2&a=1", "2024-01-01T00:00:00Z", 304, {"ETag": '"1"'}),
        record("revisit", "v4", "http://other.com/", "2024-01-03T00:00:00Z", 304, {}),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(data[:3]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(d) for d in data[3:]))
    records = warc.read_warc(spark, str(tmp_path))
    assert {r["record_id"]: r["payload"] for r in records.collect()}["r2"] == b"body2"
    out = {r["record_id"]: r for r in warc.resolve_revisits(records).collect()}
    assert {k: (r["response_id"], r["verdict"]) for k, r in out.items()} == {"v1": ("r1", "resolved"), "v2": ("r2", "changed"), "v3": (None, "unresolved"), "v4": (None, "unresolved")}
    assert out["v1"]["headers"] == {"etag": '"1"', "content-type": "text/html", "cache-control": "new"}
    assert warc.resolve_revisits(records.limit(0)).count() == 0


def test_warc_repeated_headers_and_truncated_files(spark, tmp_path):
    import gzip

    rows = [("r", "http://a.com/", 10, "response", 200, {"ETag": "old", "etag": "1", "X": "y"}, None), ("v", "http://a.com/", 20, "revisit", 304, {"Etag": "1", "ETAG": "0"}, None)]
    df = spark.createDataFrame(rows, "record_id string, url string, s long, type string, status int, headers map<string,string>, digest string").withColumn("date", F.timestamp_seconds("s"))
    out = warc.resolve_revisits(df).collect()[0]
    assert (out["response_id"], out["verdict"]) == ("r", "resolved") and out["headers"] == {"etag": "1", "x": "y"}

    def record(ident, body):
        http = b"HTTP/1.1 200 OK\r\nA: 1\r\nA: 2\r\n\r\n" + body
        return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: {ident}\r\nWARC-Target-URI: u\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"

    made = [record(f"r{i}", random.Random(i).randbytes(5000)) for i in range(4)]
    packed = [gzip.compress(x) for x in made]
    (tmp_path / "whole.warc.gz").write_bytes(b"".join(packed))
    assert [x["record_id"] for x in warc.parse_warc(b"".join(packed))] == ["r0", "r1", "r2", "r3"]
    assert [x["record_id"] for x in warc.parse_warc(b"".join(made))] == ["r0", "r1", "r2", "r3"]
    assert [x["record_id"] for x in warc.parse_warc(gzip.compress(b"".join(made)))] == ["r0", "r1", "r2", "r3"]
    cut = packed[0] + packed[1][:3000] + packed[2] + packed[3][:-30]
    assert [x["record_id"] for x in warc.parse_warc(cut)] == ["r0", "r2"]
    (tmp_path / "cut.warc.gz").write_bytes(cut)
    found = warc.read_warc(spark, str(tmp_path)).collect()
    assert sorted(x["record_id"] for x in found) == ["r0", "r0", "r1", "r2", "r2", "r3"] and all(x["headers"] == {"a": "2"} and len(x["payload"]) == 5000 for x in found)


def test_revisits_across_slices(spark):
    r, rows = random.Random(8), [("far", "http://a.com/", -10**9, "response", 200, None, None), ("late", "http://a.com/", 10**10, "response", 200, None, None)]
    for i in range(400):
        rows.append((f"{i:04d}", "http://a.com/", r.randrange(10_000), r.choice(["response", "revisit"]), 200, None, None))
    df = spark.createDataFrame(rows, "record_id string, url string, s long, type string, status int, headers map<string,string>, digest string").withColumn("date", F.timestamp_seconds("s"))
    out = {x["record_id"]: x["response_id"] for x in warc.resolve_revisits(df).collect()}
    for i, _, s, kind, *_ in rows:
        if kind == "revisit":
            before = [(t, j) for j, _, t, k, *_ in rows if k == "response" and t < s]
            assert out[i] == (max(before)[1] if before else None)


def test_packing(spark, corpus, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(docs).toPandas()
    text = {i: x or "" for i, x, *_ in corpus}
    assert set(out["doc_id"]) == set(text)
    for i, g in out.groupby("doc_id"):
        ids, g = np.array([*t.encode(text[i], add_special_tokens=False).ids, 0], "<u4"), g.sort_values("piece")
        assert g["length"].sum() == len(ids) and list(g["start"]) == [0, *g["length"].cumsum()[:-1]] and (g["length"].iloc[1:] == 2048).all()
        assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for a, n, c in zip(g["start"], g["length"], g["ids_crc32"], strict=True))
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) + 2
    assert packing.pack(empty(spark)).count() == 0 and packing.pack(odd(spark)).count() == 4


@pytest.mark.parametrize("text", ["", " ", "a  b\n\n c\t", "<|endoftext|> x", "it's we'll 'S", "\x1c\x85x　y  ", "é²½ ٣ 中文  字", "a​b", "\x00 \x1f q", "  lead", "trail  "])
def test_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    assert packing.encoder(packing.default_tokenizer()).ids(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ids_of_all_characters_and_of_long_runs():
    from tokenizers import Tokenizer

    t, e = Tokenizer.from_file(packing.default_tokenizer()), packing.encoder(packing.default_tokenizer())
    assert e.bpe is not None
    chars = [chr(c) for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}b {c}1 {c}{c} \n" for c in chars[k : k + 512]) for k in range(0, len(chars), 512)]
    texts += [" " * 1_000_000 + "x\n" + "\n " * 400_000 + "y z     ", "a" * 200_000, "é" * 100_000, "0" * 100_000, "\n" * 300_000, "?!" * 100_000]
    for x in texts:
        assert e.ids(x) == np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def test_tokenizers_of_other_kinds_encode_by_themselves(corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), packing.encoder(path)
    assert e.bpe is None
    for _, x, *_ in corpus[:40]:
        assert e.ids(x or "") == np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes()


def test_added_tokens_are_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    texts = ["end <|endoftext|> next", "<|endoftext|>", "<|endoftext|><|endoftext|>  a\n <|endoftext|>", "a  <|endoftext|>'s", "<|endoftext|", "<|ENDOFTEXT|> <<|endoftext|>>"]
    ids = {i: np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4") for i, x in enumerate(texts)}
    assert list(ids[0]) == [437, 220, 50256, 1306, 0]
    out = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in out} == {i: (len(x), zlib.crc32(x.tobytes())) for i, x in ids.items()}


def test_best_fit():
    bins, offsets, fill = packing.best_fit(np.array([5, 9, 1, 5, 10, 4]), 10)
    assert sorted(fill) == [4, 10, 10, 10] and bins[1] == bins[2] and bins[0] == bins[3] and offsets[2] == 9


def shingle_sets(corpus, k=3):
    out = {}
    for i, t, *_ in corpus:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


@pytest.mark.parametrize(("k", "percent", "group"), [(3, 90, 256), (5, 80, 256), (3, 60, 4)])
def test_ngram_join(spark, corpus, docs, monkeypatch, k, percent, group):
    monkeypatch.setattr(ngram_join, "GROUP", group)
    sets = shingle_sets(corpus, k)
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links[a].add(b)
            links[b].add(a)
    expected = components(max(sets) + 1, links)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, k, percent).collect()}
    assert out == {i: (len(s), expected[i]) for i, s in sets.items()}


def test_ngram_odd_tables(spark):
    assert ngram_join.ngram_components(empty(spark)).count() == 0
    out = ngram_join.ngram_components(odd(spark)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str) == [(1, 2, 1), (1, 2, 1), (None, 0, None), (None, 2, None)]
    twice = spark.createDataFrame([(5, "a b c d e f g h i j k"), (3, "a b c d e f g h i j k"), (5, "q r s t u v w x y z"), (9, "q r s t u v w x y z")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in ngram_join.ngram_components(twice).collect()} == {(5, 3), (3, 3), (9, 3)}


def test_ngram_prefixes_are_not_shuffled_for_a_few_copies(spark, docs, monkeypatch):
    plans, write = {}, ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ngram_join.ngram_components(docs)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans["ngram-prefixes"] and "hashpartitioning(doc_id" not in plans["ngram-prefixes"]


def test_workers_give_back_what_they_freed(spark):
    common.small_batches(spark)
    names = list(common.FREED)
    found = spark.range(1).mapInPandas(lambda batches: (x.assign(v=[",".join(os.environ.get(n, "") for n in names)]) for x in batches), "id long, v string")
    assert found.first()["v"].split(",") == list(common.FREED.values())


def test_prefix_tree_prunes_but_loses_nothing():
    r = np.random.default_rng(9)
    base = np.unique(r.integers(0, 10**6, 120))
    sets = []
    for _ in range(60):
        s = set(base.tolist())
        for x in r.choice(base, r.integers(0, 10), replace=False):
            s.discard(int(x))
        s |= set(r.integers(0, 10**6, r.integers(0, 8)).tolist())
        sets.append(np.array(sorted(s), np.int64))
    n = np.array([len(s) for s in sets])
    known = np.array([ngram_join.prefix_length(k) for k in n])
    tokens, at = [s[:k] for s, k in zip(sets, known, strict=True)], [np.arange(k) for k in known]
    given = (np.zeros(len(sets), int), tokens, at, n, known, np.array([t[-1] for t in tokens]))
    p, q = ngram_join.PrefixTree(*given).walk(*given)
    found = set(zip(p.tolist(), q.tolist(), strict=True))
    for a, b in itertools.product(range(60), repeat=2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 90 * (n[a] + n[b] - both) and np.intersect1d(tokens[a], tokens[b]).size:
            assert (a, b) in found


