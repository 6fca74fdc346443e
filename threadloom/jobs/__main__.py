"""Run a stage: ``python -m threadloom.jobs label --features F --labeled L --report R``.

On a cluster, hand this file to spark-submit with the package as --py-files.
Options are the arguments of the stage functions.
"""

import argparse
import inspect
from typing import get_args

from threadloom.jobs import stages
from threadloom.session import build_session
from threadloom.sources.tables import remove_scratch

STAGES = {name[4:]: fn for name, fn in vars(stages).items() if name.startswith("run_")}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="threadloom.jobs")
    commands = top.add_subparsers(dest="stage", required=True)
    for name, fn in STAGES.items():
        command = commands.add_parser(name, help=inspect.getdoc(fn))
        command.add_argument("--shared", help="folder for intermediate tables that all executors see")
        for option in list(inspect.signature(fn).parameters.values())[1:]:
            given = {} if option.default is option.empty else {"default": option.default}
            kind = next(t for t in (get_args(option.annotation) or (option.annotation,)) if t is not type(None))
            command.add_argument(
                "--" + option.name.replace("_", "-"), dest=option.name, type=kind,
                required=option.default is option.empty, **given,
            )
    return top


def main(arguments: list[str] | None = None) -> None:
    options = vars(parser().parse_args(arguments))
    stage = options.pop("stage")
    shared = options.pop("shared")
    spark = build_session(f"threadloom-{stage}", **({"spark.checkpoint.dir": shared} if shared else {}))
    try:
        STAGES[stage](spark, **options)
    finally:
        remove_scratch(spark)


if __name__ == "__main__":
    main()
