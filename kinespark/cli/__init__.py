"""``kinespark`` command: writes runnable demos from a few answers."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from . import demos


def main(argv: Sequence[str] | None = None) -> int:
    """Run a subcommand: 0 done, 1 a file is in the way, 2 wrong or missing answers. Without one, help is printed."""
    parser = argparse.ArgumentParser(prog="kinespark", description="Embodied-data processing on Spark.")
    commands = parser.add_subparsers(metavar="<command>")
    for kind in demos.KINDS:
        demos.register(commands, kind)
    args = parser.parse_args(argv)
    if not hasattr(args, "run"):
        parser.print_help()
        return 0
    return args.run(args)
