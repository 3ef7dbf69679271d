"""python -m fieldloom --fields-a A.jsonl --fields-b B.jsonl --pairs P.jsonl [--mode M] [--matcher X] [flags]"""

from __future__ import annotations

import argparse
import json

from .operators.matchers import MATCHERS
from .plans import evaluation
from .session import local_session
from .sources.catalog import RunConfig


def main() -> None:
    p = argparse.ArgumentParser(description=__doc__)
    for name in ("--fields-a", "--fields-b", "--pairs"):
        p.add_argument(name, required=True)
    p.add_argument("--mode", choices=evaluation.MODES, default="single")
    p.add_argument("--matcher", choices=sorted(MATCHERS), default="rule")
    p.add_argument("--constrain", action="store_true")
    p.add_argument("--calibrate", action="store_true")
    p.add_argument("--assign", action="store_true")
    p.add_argument("--pairs-calib", help="pairs that calibrate, instead of a share of --pairs")
    p.add_argument("--n-boot", type=int, default=0, help="resamples for intervals of the metrics")
    p.add_argument("--weights", type=float, nargs=3, default=(0.4, 0.2, 0.4), metavar=("NAME", "TYPE", "PATH"))
    defaults = RunConfig()
    for name, value in vars(defaults).items():
        if isinstance(value, bool):
            p.add_argument(f"--{name.replace('_', '-')}", action="store_true")
        elif name != "mode":
            p.add_argument(f"--{name.replace('_', '-')}", type=type(value), default=value)
    a = p.parse_args()
    options = {}
    if a.mode == "single":
        options = {"config": RunConfig(**{k: getattr(a, k) for k in vars(defaults) if k != "mode"}), "constrain": a.constrain, "calibrate": a.calibrate, "assign": a.assign, "n_boot": a.n_boot}
    print(json.dumps(evaluation.run(local_session(), a.fields_a, a.fields_b, a.pairs, a.mode, a.matcher, a.pairs_calib, tuple(a.weights), **options), ensure_ascii=False))


if __name__ == "__main__":
    main()
