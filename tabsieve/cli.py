"""Command line: list, info, generate, evaluate, validate, download."""

from __future__ import annotations

import argparse
import json
import sys

from .operators.frames import IDENTIFIERS, drop_existing, numeric_columns, parse_filters
from .operators.generate import make_generator
from .operators.validate import validate
from .plans.report import fidelity_report, format_report, json_safe, save_report
from .session import local_session
from .sources import datasets, formats


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be positive")
    return n


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tabsieve", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("list")
    x.add_argument("--vertical")
    x = sub.add_parser("info")
    x.add_argument("dataset")
    x = sub.add_parser("generate")
    x.add_argument("--dataset")
    x.add_argument("--input")
    x.add_argument("-n", type=_positive, default=1000)
    x.add_argument("--generator", default="auto")
    x.add_argument("--filter", action="append", default=[])
    x.add_argument("--drop", default="")
    x.add_argument("--seed", type=int, default=42)
    x.add_argument("--output", required=True)
    x.add_argument("--report", action="store_true")
    x = sub.add_parser("evaluate")
    x.add_argument("real")
    x.add_argument("synthetic")
    x.add_argument("--target")
    x.add_argument("--drop", default="")
    x.add_argument("--type", default="cross_sectional")
    x.add_argument("--privacy", action="store_true")
    x.add_argument("--output")
    for name, kind, low, high in (("min-confidence", float, 0, 1), ("min-support", float, 0, 1), ("max-rules", int, 0, 1e6), ("min-lift", float, 0, 1e6), ("max-antecedents", int, 1, 4)):
        x.add_argument(f"--rule-{name}", type=kind)
        x.set_defaults(**{f"bounds_{name.replace('-', '_')}": (low, high)})
    x = sub.add_parser("validate")
    x.add_argument("path")
    x.add_argument("--min-rows", type=int, default=50)
    x.add_argument("--required", default="")
    x = sub.add_parser("download")
    x.add_argument("dataset", nargs="?")
    x.add_argument("--status", action="store_true")
    return p


def _rule_options(args) -> dict:
    out = {}
    for name in ("min_confidence", "min_support", "max_rules", "min_lift", "max_antecedents"):
        value, (low, high) = getattr(args, f"rule_{name}"), getattr(args, f"bounds_{name}")
        if value is not None:
            if not low <= value <= high:
                raise ValueError(f"--rule-{name.replace('_', '-')} must be between {low} and {high}")
            out[name] = value
    return out


def _listed(text: str) -> list[str]:
    return list(dict.fromkeys([c.strip() for c in text.split(",") if c.strip()] + list(IDENTIFIERS)))


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "list":
            for d in datasets.list_datasets(args.vertical):
                print(f"{d['id']:<20} {d['vertical']:<22} {d['name']}")
            return 0
        if args.command == "info":
            print(json.dumps(datasets.get_dataset_info(args.dataset), indent=2))
            return 0
        if args.command == "download" and (args.status or not args.dataset):
            print(json.dumps(datasets.status(), indent=2))
            return 0
        spark = spark or local_session()
        if args.command == "validate":
            got = validate(formats.read(spark, args.path), args.min_rows, required_columns=[c for c in args.required.split(",") if c])
            print(got)
            return 0 if got.ok else 1
        if args.command == "evaluate":
            real, syn = (drop_existing(formats.read(spark, x), _listed(args.drop)) for x in (args.real, args.synthetic))
            report = fidelity_report(real, syn, target=args.target, include_privacy=args.privacy, dataset_type=args.type, audit=_rule_options(args))
            print(format_report(report))
            if args.output:
                save_report(report, args.output)
            return 0
        if args.command == "generate":
            df = formats.read(spark, args.input) if args.input else datasets.load_dataset(spark, args.dataset)
            df = drop_existing(df, _listed(args.drop))
            got = validate(df, min_rows=10)
            if not got.ok and args.input:
                print(got, file=sys.stderr)
            filters, bad = parse_filters(args.filter)
            for b in bad:
                print(f"skipping malformed filter {b!r}", file=sys.stderr)
            numbers = set(numeric_columns(df))
            filters = {k: float(v) if k in numbers and isinstance(v, str) else v for k, v in filters.items()}
            out = make_generator(args.generator).fit(df).generate(args.n, filters, args.seed).cache()
            print(formats.write(out, args.output))
            if args.report:
                print(format_report(fidelity_report(df, out)))
            return 0
        print("no network: pass a fetch function to tabsieve.sources.datasets.download()", file=sys.stderr)
        return 1
    except (ValueError, KeyError, OSError, RuntimeError, ImportError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


__all__ = ["json_safe", "main"]

if __name__ == "__main__":
    sys.exit(main())
