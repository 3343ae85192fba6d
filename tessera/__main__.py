"""Command line: ``python -m tessera STAGE --option value ...``, or the same under ``spark-submit``.

The options of a stage are the parameters of its function, with their defaults; values are Python literals,
or texts.  ``static`` takes ``--data NAME --root PATH`` (a registered data set) and ``temporal`` a folder of flow
files; both write their tables under ``--path`` and print their last table's size.
"""

from __future__ import annotations

import argparse
import ast
import inspect
import sys
from collections.abc import Callable

from pyspark.sql import SparkSession

from tessera.plans.stages import STAGES
from tessera.sources import tables

#: Parameters that the command line makes itself.
_MADE = {"spark", "graph", "flows", "labels"}


def value(text: str) -> object:
    """A Python literal, several with commas between them, or the text itself."""
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def add_options(parser: argparse.ArgumentParser, stage: Callable) -> None:
    for name, p in inspect.signature(stage).parameters.items():
        if name not in _MADE:
            default = None if p.default is inspect.Parameter.empty else p.default
            parser.add_argument(f"--{name.replace('_', '-')}", type=value, default=default, required=p.default is inspect.Parameter.empty, help=f"default: {default!r}")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("tessera", description=__doc__)
    stages = out.add_subparsers(dest="stage", required=True)
    for name, stage in STAGES.items():
        sub = stages.add_parser(name, help=(stage.__doc__ or "").split("\n")[0])
        add_options(sub, stage)
        if name == "static":
            sub.add_argument("--data", required=True, help=f"one of {', '.join(sorted(tables.DATASETS))}")
            sub.add_argument("--root", required=True, help="where the data set is")
        else:
            sub.add_argument("--folder", required=True, help="the flow files' folder")
            sub.add_argument("--protocol", default="tcp")
            sub.add_argument("--days", type=value, default=None)
            sub.add_argument("--weight", default=None)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = vars(parser().parse_args(argv))
    stage, session = given.pop("stage"), spark or SparkSession.builder.appName("tessera").getOrCreate()
    if stage == "static":
        data, root = given.pop("data"), given.pop("root")
        graph = tables.load(data, session, root)
        labels = tables.load_problem(data, session, root, graph)[0] if data in tables.PROBLEMS else None
        given["dims"] = [given["dims"]] if isinstance(given["dims"], int) else given["dims"]
        out = STAGES[stage](session, graph, labels=labels, **given)
    else:
        folder, protocol, days, weight = (given.pop(k) for k in ("folder", "protocol", "days", "weight"))
        flows = tables.adjacency(tables.read_flows(session, folder, protocol, days), weight)
        out = STAGES[stage](session, flows, **given)
    print(f"{out.count()} rows")
    return 0


if __name__ == "__main__":
    sys.exit(main())
