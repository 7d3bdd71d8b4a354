"""Jobs from the command line: ``python -m loomgraph.plans.cli JOB --name value …``; a value that is JSON is read as such."""

from __future__ import annotations

import argparse
import inspect
import json
import sys
from collections.abc import Sequence

from ..session import session
from . import jobs

#: the jobs whose arguments are plain values
JOBS = ("generate_questions", "build_pairs", "split_judge", "frontier", "mine", "plot_telemetry")


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    sub = p.add_subparsers(dest="job", required=True)
    for name in JOBS:
        f = getattr(jobs, name)
        one = sub.add_parser(name.replace("_", "-"), help=(f.__doc__ or "").split("\n")[0])
        for a in list(inspect.signature(f).parameters.values())[1:]:
            need = a.default is inspect.Parameter.empty
            one.add_argument(f"--{a.name.replace('_', '-')}", dest=a.name, type=_value, required=need, **({} if need else {"default": a.default}))
    return p


def main(argv: Sequence[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    out = getattr(jobs, args.pop("job").replace("-", "_"))(session(), **args)
    if hasattr(out, "show"):
        out.show(truncate=False)
    elif out is not None:
        print(json.dumps(out, default=str, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
