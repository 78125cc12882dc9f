"""python -m joulemark.plans.cli run PIPELINE --store-uri ... --site ...: a pipeline over a site's stored tables."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.helpers import dotted, parse_options, split_options
from ..models.baseline import UsagePredictor
from ..sources.catalog import FORMATS, NAMESPACES, Catalog, RunLog
from ..sources.session import session
from . import pipelines as P


def preprocess(spark: SparkSession, c: Catalog, s: P.Settings, args: argparse.Namespace) -> None:
    x, y = P.validate_inputs(c.partitions(spark, "features"), c.partitions(spark, "labels"), s)
    if c.namespace == "train":
        x, y, report = P.evaluate_inputs(x, y, s)
        c.save(report, "adequacy")
    c.save(x.join(y, ["site_id", "ts"], "full"), "preprocessed")


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.drop("consumption"), df.select("site_id", "ts", "consumption").dropna()


def predict(spark: SparkSession, c: Catalog, s: P.Settings, args: argparse.Namespace) -> None:
    x, y = _split(c.load(spark, "preprocessed"))
    name = "prediction-autoenc" if args.autoenc else "prediction"
    activity = None
    if args.autoenc:
        adjusted = c.load(spark, "activity-adjusted") if c.namespace == "apply" and c.exists(spark, "activity-adjusted") else None
        c.save(P.create_activity(x, y, s, adjusted), "activity")
        activity = c.load(spark, "activity")
    path = c.path("model-autoenc" if args.autoenc else "model")
    if c.namespace == "train":
        model, _ = P.fit_predict_autoenc(x, y, activity, s) if args.autoenc else P.fit_predict(x, y, s)
        model.save(path)
    model = UsagePredictor.load(spark, path)
    c.save(P.predict_autoenc(model, x, activity, s) if args.autoenc else P.predict(model, x), name)
    if c.namespace == "train":
        c.save(P.in_sample(y, c.load(spark, name), activity, s), "metrics-autoenc" if args.autoenc else "metrics")


def evaluate(spark: SparkSession, c: Catalog, s: P.Settings, args: argparse.Namespace) -> None:
    if c.namespace == "train":
        raise ValueError("evaluate is of test or apply")
    _, y = _split(c.load(spark, "preprocessed"))
    end = "-autoenc" if args.autoenc else ""
    p, activity = c.load(spark, f"prediction{end}"), c.load(spark, "activity") if args.autoenc else None
    if c.namespace == "test":
        c.save(P.evaluate_on_test_autoenc(y, p, activity, s) if args.autoenc else P.evaluate_on_test(y, p), f"metrics{end}")
    else:
        c.save(P.evaluate_on_apply_autoenc(y, p, activity, s) if args.autoenc else P.evaluate_on_apply(y, p), f"impact{end}")


def adjust(spark: SparkSession, c: Catalog, s: P.Settings, args: argparse.Namespace) -> None:
    if c.namespace != "apply":
        raise ValueError("adjust is of apply")
    x, y = _split(c.load(spark, "preprocessed"))
    c.save(P.adjust_levels(x, y, UsagePredictor.load(spark, c.path("model-autoenc")), s), "activity-adjusted")


PIPELINES: dict[str, list[Callable]] = {"preprocess": [preprocess], "predict": [predict], "evaluate": [evaluate], "adjust": [adjust], "all": [preprocess, predict, evaluate]}
#: What each step reads and writes, by which a run may be cut.
READS = {"preprocess": ("features", "labels"), "predict": ("preprocessed", "activity-adjusted"), "evaluate": ("prediction", "activity"), "adjust": ("preprocessed", "model")}
WRITES = {"preprocess": ("preprocessed", "adequacy"), "predict": ("activity", "model", "prediction"), "evaluate": ("metrics", "impact"), "adjust": ("activity-adjusted",)}


def sliced(steps: list[Callable], nodes: list[str] = (), from_nodes: list[str] = (), to_nodes: list[str] = (), from_inputs: list[str] = (), to_outputs: list[str] = ()) -> list[Callable]:
    """The steps named; those from the first named, or that reads an input named, on; those up to the last named, or that
    writes an output named. A name that no step has is an error."""
    names = [f.__name__ for f in steps]
    known = {"node": set(names), "input": {x for n in names for x in READS[n]}, "output": {x for n in names for x in WRITES[n]}}
    for kind, given in (("node", (*nodes, *from_nodes, *to_nodes)), ("input", from_inputs), ("output", to_outputs)):
        if absent := sorted(set(given) - known[kind]):
            raise ValueError(f"no {kind} {', '.join(absent)} in {', '.join(names)}")
    starts = [i for i, n in enumerate(names) if n in from_nodes or set(READS[n]) & set(from_inputs)]
    ends = [i for i, n in enumerate(names) if n in to_nodes or set(WRITES[n]) & set(to_outputs)]
    steps = steps[min(starts, default=0) : max(ends, default=len(steps)) + 1]
    return [f for f in steps if not nodes or f.__name__ in nodes]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="joulemark")
    run = out.add_subparsers(dest="command", required=True).add_parser("run")
    run.add_argument("pipeline", choices=PIPELINES, nargs="?", default="all")
    run.add_argument("--store-uri", required=True)
    run.add_argument("--site", required=True)
    run.add_argument("-ns", "--namespace", choices=NAMESPACES, default="train")
    run.add_argument("--batch")
    run.add_argument("--input-uri")
    run.add_argument("--input-format", choices=FORMATS, default="parquet")
    run.add_argument("--load-arg", action="append", default=[], metavar="KEY=VALUE")
    for name in ("features", "labels"):
        run.add_argument(f"--{name}-format", choices=FORMATS, help=f"of the {name} alone")
        run.add_argument(f"--{name}-load-arg", action="append", default=[], metavar="KEY=VALUE")
    for name in ("from-inputs", "to-outputs", "from-nodes", "to-nodes"):
        run.add_argument(f"--{name}", type=split_options, default=[], metavar="A,B")
    run.add_argument("--node", action="append", default=[], metavar="NAME")
    run.add_argument("--param", action="append", default=[], metavar="KEY=VALUE", help="a setting, such as alignment.mode=value")
    run.add_argument("--config", help="a JSON file of settings")
    run.add_argument("--autoenc", action="store_true")
    run.add_argument("--track", action="store_true")
    run.add_argument("--run-id")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> Catalog:
    args = parser().parse_args(argv)
    spark = spark or session()
    values: dict = json.loads(open(args.config).read()) if args.config else {}  # noqa: SIM115
    for k, v in dotted(parse_options(args.param)).items():
        values[k] = values.get(k, {}) | v if isinstance(v, dict) else v
    default = P.Settings()
    settings = P.Settings(**{k: getattr(default, k) | v if isinstance(v, dict) else v for k, v in values.items()})
    steps = sliced(PIPELINES[args.pipeline], args.node, args.from_nodes, args.to_nodes, args.from_inputs, args.to_outputs)
    formats = {k: getattr(args, f"{k}_format") or args.input_format for k in ("features", "labels")}
    loads = {k: parse_options(args.load_arg) | parse_options(getattr(args, f"{k}_load_arg")) for k in ("features", "labels")}
    c = Catalog(args.store_uri, args.site, args.namespace, args.batch, formats, loads, args.input_uri, args.track, args.run_id)
    log = RunLog(f"{args.store_uri.rstrip('/')}/{args.site}/runs_log")
    if c.tracked:
        log.params(spark, c.run_id, values | {"pipeline": args.pipeline, "namespace": args.namespace})
    for step in steps:
        if step is evaluate and args.pipeline == "all" and args.namespace == "train":
            continue
        step(spark, c, settings, args)
        if c.tracked and (step is evaluate and c.namespace == "test" or step is predict and c.namespace == "train"):
            for r in c.load(spark, "metrics-autoenc" if args.autoenc else "metrics").toLocalIterator():
                log.metrics(spark, c.run_id, {r["site_id"]: {k: r[k] for k in ("CVRMSE", "NMBE", "MSE")}})
    return c


if __name__ == "__main__":
    main()
