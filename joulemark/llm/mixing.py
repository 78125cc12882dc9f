"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Documents' tokens are tallied by source, language and topic. Raking finds a factor for each source, language and topic
so that the weighted tallies meet all three target marginals; a document is kept with a probability in proportion to
its weight. Targets are given by the caller, or are the corpus shares to a power below 1, which lifts small sources,
languages and topics. A topic is a column of the table, or else is told by the text's style.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lookup, written

#: Powers of the corpus shares that give targets where none are given; the most that a document's probability may be;
#: raking passes at least and at most, and the difference from a target, as a share of it, at which they end; languages
#: and topics at most.
POWERS = {"source": 0.8, "lang": 0.85, "topic": 0.95}
RATE, PASSES, MOST_PASSES, TOLERANCE, VALUES, SEED = 0.9, 15, 200, 1e-6, 1000, "mix-1"
#: What a missing source or language counts as.
NONE = "(none)"


def n_tokens() -> Column:
    return F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^ \\t\\n\\r]+")).cast("long")


def topic() -> Column:
    """A topic by the text's style, in want of a topic column: table, markup, shouting, note or prose."""
    text = F.coalesce("text", F.lit(""))
    return (
        F.when(F.instr(text, " | ") > 0, "table").when(text.rlike("[#$%&*]{3}"), "markup")
        .when((F.upper(text) == text) & (F.lower(text) != text), "shouting").when(n_tokens() < 50, "note").otherwise("prose")
    )


def names(columns: list[str]) -> dict[str, str]:
    """What mix calls its own columns beside those: with an underscore in front, or as many as make them free."""
    return {k: free_name(f"_{k}", columns) for k in ("source", "lang", "topic", "tokens", "factor", "weight", "prob", "sampled")}


def facts(docs: DataFrame, columns: list[str], by: Column | None = None) -> DataFrame:
    """columns of docs, and its own source, lang, topic and tokens, by their names beside columns."""
    own = names(columns)
    found = {"source": F.coalesce("source", F.lit(NONE)), "lang": F.coalesce("lang", F.lit(NONE)), "topic": topic() if by is None else F.coalesce(by.cast("string"), F.lit(NONE)), "tokens": n_tokens()}
    return docs.select(*(f"`{c}`" for c in columns), *(v.alias(own[k]) for k, v in found.items()))


def uniform() -> Column:
    """A number from 0 to 1 drawn by the document's identifier; where that is null, by its text."""
    key = F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def rake(tallies: DataFrame, powers: dict[str, float] | None = None, passes: int = PASSES, given: dict[str, dict[str, float]] | None = None) -> tuple[DataFrame, dict, dict, float, float]:
    """tallies (source, lang, topic, tokens) -> factors of sources (source, factor), of languages, of topics, the largest
    weight, and the residual: the largest difference from a language's target, as a share of it, before the last pass.

    given: target shares by source, lang or topic, in any unit; values that it leaves out have the target 0.
    Passes go on beyond passes until the residual is at most TOLERANCE, or no longer falls (targets that no weights can
    meet, as where a language's only source has the target 0), or after MOST_PASSES; a warning says so.

    A source's row holds its tallies by language and topic, so that its factor needs no join; only the sums by language
    and by topic, of which there are VALUES at most, reach the driver in each pass.
    """
    powers = powers or POWERS
    tallies = written(tallies.where("tokens > 0"), "mix-tallies")
    total = tallies.agg(F.sum("tokens")).first()[0]
    if not total:
        return tallies.select("source", F.lit(1.0).alias("factor")), {}, {}, 1.0, 0.0
    given = given or {}

    def targets(by: str) -> dict:
        rows = tallies.groupBy(by).agg(F.sum("tokens").alias("n")).limit(VALUES + 1).collect()
        if len(rows) > VALUES:
            raise ValueError(f"more than {VALUES} values of {by}")
        share = {r[by]: float(given[by].get(r[by], 0)) if by in given else (r["n"] / total) ** powers[by] for r in rows}
        if not sum(share.values()):
            raise ValueError(f"no {by} of the table has a target")
        return {k: v * total / sum(share[k] for k in sorted(share)) for k, v in share.items()}

    want_lang, want_topic = targets("lang"), targets("topic")
    sources = tallies.groupBy("source").agg(F.sum("tokens").alias("n"), F.collect_list(F.struct("lang", "topic", "tokens")).alias("cells"))
    share = F.coalesce(F.element_at(_map({k: float(v) for k, v in given["source"].items()}), F.col("source")), F.lit(0.0)) if "source" in given else F.pow(F.col("n") / total, powers["source"])
    norm = sources.agg(F.sum(share)).first()[0]
    if not norm:
        raise ValueError("no source of the table has a target")
    sources = written(sources.select("source", (share * total / norm).alias("want"), "cells"), "mix-sources")

    def factor(lang: dict, topic_: dict) -> Column:
        by_lang, by_topic = _map(lang), _map(topic_)
        weighted = F.aggregate("cells", F.lit(0.0), lambda s, x: s + x["tokens"] * F.element_at(by_lang, x["lang"]) * F.element_at(by_topic, x["topic"]))
        return F.when(weighted > 0, F.col("want") / weighted).otherwise(0.0)

    lang, topic_, residual, k = dict.fromkeys(want_lang, 1.0), dict.fromkeys(want_topic, 1.0), 1.0, 0
    before = 2.0
    while k < passes or (TOLERANCE < residual < 0.95 * before and k < MOST_PASSES):
        k, before = k + 1, residual
        cells = sources.select(factor(lang, topic_).alias("f"), F.explode("cells").alias("c")).select("f", "c.*")
        sums = cells.groupBy("lang").agg(F.sum(F.col("f") * F.col("tokens") * F.element_at(_map(topic_), F.col("topic"))).alias("n")).collect()
        residual = max(abs(lang[r["lang"]] * r["n"] / want_lang[r["lang"]] - 1) if want_lang[r["lang"]] else 0.0 for r in sums)
        new = {r["lang"]: want_lang[r["lang"]] / r["n"] if r["n"] else 0.0 for r in sums}
        sums = cells.groupBy("topic").agg(F.sum(F.col("f") * F.col("tokens") * F.element_at(_map(new), F.col("lang"))).alias("n")).collect()
        topic_, lang = {r["topic"]: want_topic[r["topic"]] / r["n"] if r["n"] else 0.0 for r in sums}, new
    if residual > TOLERANCE:
        warnings.warn(f"after {k} passes a language is off its target by {residual:.2g} of it", stacklevel=2)
    factors = sources.select("source", factor(lang, topic_).alias("factor"), "cells")
    weights = factors.select("factor", F.explode("cells").alias("c")).select((F.col("factor") * F.element_at(_map(lang), F.col("c.lang")) * F.element_at(_map(topic_), F.col("c.topic"))).alias("w"))
    return factors.drop("cells"), lang, topic_, weights.agg(F.max("w")).first()[0] or 1.0, residual


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k in sorted(values) for x in (k, values[k])]) if values else F.create_map().cast("map<string,double>")


def mix(
    docs: DataFrame, columns: list[str], powers: dict[str, float] | None = None, rate: float = RATE, passes: int = PASSES,
    targets: dict[str, dict[str, float]] | None = None, by: Column | None = None,
) -> DataFrame:
    """columns of docs, then source, lang, topic, tokens, weight, prob, sampled, called by names(columns).

    targets: shares by source, lang or topic, in any unit, as {"lang": {"en": 3, "de": 1}}; a value that is left out has
    the target 0, and one that is not in the table is passed over. by: the column that holds the topic.

    prob is weight x a common rate: rate, or less if the largest weight would need a probability above 1, so that
    no probability is cut and expected tokens keep to the targets. A null source or language is a value of its own;
    a text without tokens has weight 0 and goes. A draw is by doc_id, so repeated rows are drawn alike and ties do not
    matter; where doc_id is null it is by the text. Very long texts count with all their tokens. An empty table gives
    an empty result.
    """
    own = names(columns)
    tallies = facts(docs, [], by).groupBy(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic")).agg(F.sum("_tokens").alias("tokens"))
    factors, lang, topic_, most, _ = rake(tallies, powers, passes, targets)
    factors = written(factors.toDF(own["source"], own["factor"]), "mix-factors")
    draw = free_name("_draw", columns, own.values())
    # the draw is made beside the columns given, which need not hold doc_id and text
    drawn = facts(docs.withColumn(draw, uniform()), [*columns, draw], by)
    out = lookup(drawn.toDF(*columns, draw, *(own[k] for k in ("source", "lang", "topic", "tokens"))), factors, own["source"])
    weight = F.col(own["factor"]) * F.element_at(_map(lang), F.col(own["lang"])) * F.element_at(_map(topic_), F.col(own["topic"]))
    out = out.withColumn(own["weight"], F.when(F.col(own["tokens"]) > 0, weight).otherwise(0.0))
    out = out.withColumn(own["prob"], F.col(own["weight"]) * min(rate, 1 / most))
    out = out.withColumn(own["sampled"], F.col(draw) < F.col(own["prob"]))
    return out.select(*(f"`{c}`" for c in columns), *own.values())


def sql(powers: dict[str, float] | None = None, rate: float = RATE, passes: int = PASSES) -> str:
    """The same in DuckDB's SQL: every pass is two steps over the tallies."""
    powers = powers or POWERS
    steps = []
    for i in range(passes):
        steps += [
            f"f{i} AS (SELECT source, any_value(ws) / sum(tokens * bl * bt) AS f FROM c{i} GROUP BY source)",
            f"l{i} AS (SELECT lang, any_value(wl) / sum(f * tokens * bt) AS b FROM c{i} JOIN f{i} USING (source) GROUP BY lang)",
            f"t{i} AS (SELECT topic, any_value(wt) / sum(f * tokens * b) AS b FROM c{i} JOIN f{i} USING (source) JOIN l{i} USING (lang) GROUP BY topic)",
            f"c{i + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, tokens, ws, wl, wt, l.b AS bl, t.b AS bt FROM c{i} c JOIN l{i} l USING (lang) JOIN t{i} t USING (topic))",
        ]
    target = lambda by: f"(SELECT {by}, n ** {powers[by]} * (SELECT sum(tokens) FROM tally) / sum(n ** {powers[by]}) OVER () AS w FROM (SELECT {by}, sum(tokens) / (SELECT sum(tokens) FROM tally) AS n FROM tally GROUP BY {by}))"
    return f"""
WITH raw AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, coalesce(text, '') AS text,
                    len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n_tokens FROM documents),
facts AS MATERIALIZED (SELECT doc_id, text, source, lang, n_tokens, CASE WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#$%&*]{{3}}') THEN 'markup'
          WHEN upper(text) = text AND lower(text) <> text THEN 'shouting' WHEN n_tokens < 50 THEN 'note' ELSE 'prose' END AS topic FROM raw),
tally AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM facts GROUP BY ALL HAVING sum(n_tokens) > 0),
c0 AS MATERIALIZED (SELECT t.*, s.w AS ws, l.w AS wl, p.w AS wt, 1.0::DOUBLE AS bl, 1.0::DOUBLE AS bt FROM tally t JOIN {target("source")} s USING (source) JOIN {target("lang")} l USING (lang) JOIN {target("topic")} p USING (topic)),
{", ".join(steps)},
last AS MATERIALIZED (SELECT source, lang, topic, ws / sum(tokens * bl * bt) OVER (PARTITION BY source) * bl * bt AS w FROM c{passes}),
probs AS (SELECT doc_id, text, source, lang, topic, n_tokens, CASE WHEN n_tokens > 0 THEN w ELSE 0 END AS weight FROM facts LEFT JOIN last USING (source, lang, topic))
SELECT doc_id, source, lang, topic, n_tokens::BIGINT AS n_tokens, round(weight, 6) AS weight, round(weight * least({rate}, 1 / (SELECT max(w) FROM last)), 6) AS prob,
       ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, md5(text))), 1, 8))::BIGINT / 4294967296.0 < weight * least({rate}, 1 / (SELECT max(w) FROM last)) AS sampled
FROM probs"""
