"""Command line: prepare, run, configured, suite, crypto, export and plot."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .operators import circuits, counts, metrics
from .plans import config, protocol
from .sources import files


class Distinct(argparse.Action):
    """Takes a list of values, none of them twice."""

    def __call__(self, parser, namespace, values, option_string=None):
        if twice := sorted(str(v) for v, n in Counter(values).items() if n > 1):
            raise argparse.ArgumentError(self, f"given twice: {', '.join(twice)}")
        setattr(namespace, self.dest, values)


def positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError("a number of 1 or more is needed")
    return value


def _several(parser: argparse.ArgumentParser, flag: str, **how) -> None:
    parser.add_argument(flag, nargs="+", action=Distinct, **how)


def _table(parser: argparse.ArgumentParser) -> None:
    """What the commands that mine a table share."""
    parser.add_argument("--csv", nargs="+", required=True, help="coded CSV with the heading 0, 1, ...; NAME=PATH gives a table a name")
    parser.add_argument("--width", type=positive, nargs="+", required=True, help="columns of each table")
    parser.add_argument("--output", required=True)
    parser.add_argument("--max-rows", type=positive)
    for flag, kind, default in (("k", positive, 15), ("epsilon", float, 1.0), ("clients", positive, 4), ("m", positive, 2048), ("min-size", positive, 1), ("max-size", positive, 4)):
        parser.add_argument(f"--{flag}", type=kind, default=default)


def _arguments(argv: Sequence[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tallyveil", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    prepare = commands.add_parser("prepare", help="write the toy table or tables of the generated suite")
    _several(prepare, "--tables", default=["toy"], choices=["toy", *files.suite()])
    prepare.add_argument("--output", required=True)

    run = commands.add_parser("run", help="run methods at one configuration")
    suite = commands.add_parser("suite", help="run numbered sweeps")
    crypto = commands.add_parser("crypto", help="count under encryption")
    for one in (run, suite, crypto):
        _table(one)
    for one in (run, suite):
        _several(one, "--seeds", type=int, default=[2026])
        _several(one, "--methods", choices=config.METHODS)
    _several(suite, "--experiments", type=int, choices=list(config.SWEEPS), default=list(config.SWEEPS))
    _several(suite, "--values", type=float, help="in place of an axis's own")
    _several(suite, "--tables", help="names of the tables to take, in place of an axis's own")
    crypto.add_argument("--bits", type=positive, default=2048)
    crypto.add_argument("--threshold", type=int, default=0)
    _several(crypto, "--methods", choices=["circuit", "homomorphic"], default=["circuit", "homomorphic"])
    crypto.add_argument("--candidates", choices=["two-round", "public"], default="two-round")
    crypto.add_argument("--candidate-limit", type=positive, default=100_000)

    configured = commands.add_parser("configured", help="run a JSON configuration")
    configured.add_argument("--config", required=True)
    configured.add_argument("--width", type=positive, required=True)
    _several(configured, "--methods", choices=config.METHODS, default=["MAP-M"])
    configured.add_argument("--output", required=True)

    export = commands.add_parser("export", help="f1 and ncr for several k from a stored run of crypto")
    export.add_argument("--input", required=True)
    _several(export, "--ks", type=positive, required=True)
    export.add_argument("--output", required=True)

    plot = commands.add_parser("plot", help="write the series behind the plots of aggregated runs")
    plot.add_argument("--input", required=True)
    plot.add_argument("--output", required=True)
    return parser.parse_args(argv)


TEXT = {"dataset", "axis", "method", "result_kind", "evaluation_scope"}


def _write(spark: SparkSession, rows: list[dict], output: str) -> None:
    """runs and their summary, as CSV, and each row's keys in union."""
    keys = sorted({k for r in rows for k in r})
    cells = [tuple(None if r.get(k) is None else float(r[k]) if isinstance(r[k], (int, float)) else r[k] for k in keys) for r in rows]
    table = spark.createDataFrame(cells, ", ".join(f"`{k}` {'string' if k in TEXT else 'double'}" for k in keys))
    table.coalesce(1).write.mode("overwrite").csv(f"{output}/runs", header=True)
    measured = [k for k in metrics.SHOWN if k in keys]
    metrics.summarize(table, measured).coalesce(1).write.mode("overwrite").csv(f"{output}/aggregated", header=True)


def _base(args: argparse.Namespace) -> config.Config:
    p = config.Protocol(k=args.k, epsilon=args.epsilon, m=args.m, min_size=args.min_size, max_size=args.max_size)
    return config.Config(config.Data(clients=args.clients, max_rows=args.max_rows, strategy="order"), p)


def _tables(spark: SparkSession, args: argparse.Namespace) -> dict[str, DataFrame]:
    """The tables by name; one without a name is custom."""
    widths = args.width * len(args.csv) if len(args.width) == 1 else args.width
    named = [("custom", x) if "=" not in x else tuple(x.split("=", 1)) for x in args.csv]
    if len(dict(named)) < len(named):
        raise ValueError("two tables have one name")
    return {name: files.read_coded(spark, path, width) for (name, path), width in zip(named, widths, strict=True)}


def _encrypted(wide: DataFrame, args: argparse.Namespace) -> dict:
    """The top itemsets under encryption by each method, with what each took and how it agrees with the exact ones."""
    base = _base(args)
    owned = protocol.prepare(wide, base)
    if args.candidates == "public":
        candidates = counts.universe(owned.domain, args.max_size, args.candidate_limit)
    else:
        shares = protocol.budget.phases(args.epsilon, base.protocol.delta, args.clients, base.protocol.phase1_ratio, base.protocol.noisy_n_ratio)
        candidates = [c.itemset for c in protocol.first_round(owned, base.protocol, shares["epsilon_counts"], shares["epsilon_n"]).candidates]
    out = {}
    for method in args.methods:
        if method == "circuit":
            supports, info = circuits.circuit_mining(owned.wide, candidates, owned.owner, owned.domain, args.threshold)
        else:
            supports, info = circuits.encrypted_mining(owned.wide, candidates, owned.owner, args.threshold, bits=args.bits)
        best = sorted(supports.items(), key=lambda x: (-x[1], x[0]))[: args.k]
        everything = [[list(map(list, s)), n] for s, n in sorted(supports.items())]
        out[method] = {"supports": everything, "top": [[list(map(list, s)), n] for s, n in best], **circuits.agreement(owned.wide, supports, args.k, args.max_size, owned.domain), **info}
    return out


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _arguments(argv)
    spark = spark or SparkSession.builder.appName("tallyveil").getOrCreate()
    if args.command == "prepare":
        for name in args.tables:
            files.write_coded(files.toy(spark) if name == "toy" else files.generate(spark, **files.suite()[name]), f"{args.output}/{name}")
        return 0
    if args.command == "export":
        files.write_json(args.output, {"rows": protocol.k_sweep(args.input, args.ks)})
        return 0
    if args.command == "plot":
        aggregated = spark.read.csv(args.input, header=True, inferSchema=True)
        metrics.plot_series(aggregated).coalesce(1).write.mode("overwrite").csv(args.output, header=True)
        return 0
    if args.command == "configured":
        found = config.load(args.config)
        wide = files.read_coded(spark, found.data.path, args.width)
        _write(spark, [protocol.run_case(wide, found, m) for m in args.methods], args.output)
        return 0
    tables = _tables(spark, args)
    if args.command == "crypto":
        for name, wide in tables.items():
            found = _encrypted(wide, args)
            files.write_json(f"{args.output}/{name}.json", found)
            print(json.dumps({name: {method: told["top"] for method, told in found.items()}}))
        return 0
    base = _base(args)
    if args.command == "suite":
        names = args.tables or (["custom"] if list(tables) == ["custom"] else None)
        rows = protocol.sweep(tables, base, args.experiments, args.methods, args.seeds, folder=args.output, names=names, values=args.values)
    else:
        todo = [(name, config.at(base, seed=s), m) for name in tables for s in args.seeds for m in args.methods or config.COMPARED]
        rows = [protocol.run_case(tables[name], c, m, dataset=name) for name, c, m in todo]
    _write(spark, rows, args.output)
    return 0


if __name__ == "__main__":
    sys.exit(main())
