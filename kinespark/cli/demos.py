"""The demos: their settings, cells and subcommands."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass, fields
from pathlib import Path

from . import notebooks
from .notebooks import Cells

METHODS = ("mediapipe", "wilor", "both")
RUNTIMES = ("local", "cluster")
FRAMES, EPISODES, SAMPLES = 12, 5, 8
FORMS: dict[str, tuple[str, Callable[[Cells], str]]] = {"script": ("demo.py", notebooks.script), "notebook": ("demo.ipynb", notebooks.notebook), "markdown": ("demo.md", notebooks.walkthrough)}


def _at_least_one(**given: int) -> None:
    for name, n in given.items():
        if n < 1:
            raise ValueError(f"{name} is at least 1, not {n}")


@dataclass
class HandsDemo:
    """Hand tracking over a frame dataset."""

    method: str = METHODS[0]
    runtime: str = RUNTIMES[0]
    mano_path: str | None = None
    dataset: str = "data/egocentric-sample"
    image_column: str = "observation.image"
    limit: int = FRAMES
    with_eval: bool = False

    def validate(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method is one of {METHODS}, not {self.method!r}")
        if self.runtime not in RUNTIMES:
            raise ValueError(f"runtime is one of {RUNTIMES}, not {self.runtime!r}")
        if self.method != "mediapipe" and not self.mano_path:
            raise ValueError(f"method {self.method!r} needs mano_path")
        _at_least_one(limit=self.limit)
        if self.runtime == "cluster" and self.with_eval:
            raise ValueError("with_eval goes with the local runtime only")

    def cells(self) -> Cells:
        self.validate()
        methods = ["mediapipe", "wilor"] if self.method == "both" else [self.method]
        column = (lambda m: f"hands_{m}") if len(methods) > 1 else (lambda m: "hands")
        master = 'SparkSession.builder.master("local[*]").getOrCreate()' if self.runtime == "local" else "SparkSession.builder.getOrCreate()  # started by spark-submit"
        tracks = "\n".join(f'df = df.withColumn("{column(m)}", track_hands(IMAGE, method="{m}"{f", mano_path={self.mano_path!r}" if m == "wilor" else ""}))' for m in methods)
        shown = ", ".join(f'"{column(m)}"' for m in methods)
        out: Cells = [
            (False, f"# Hand tracking with {' and '.join(methods)}\n\nReads frames, tracks hands in each, and shows the keypoints. Every method gives the same columns."),
            (False, "## Setup"),
            (True, f"from pyspark.sql import SparkSession\n\nfrom kinespark.functions.columns import named\nfrom kinespark.operators.hands import track_hands\nfrom kinespark.sources import frame_datasets\n\nspark = {master}"),
            (False, "## Read\n\nOne row per frame. The limit comes before decoding, so only these frames are decoded."),
            (
                True,
                f"DATASET, IMAGE, LIMIT = {self.dataset!r}, {self.image_column!r}, {self.limit}\n"
                'frames = frame_datasets.read(spark, DATASET).orderBy("episode_index", "frame_index").limit(LIMIT)\n'
                "df = frame_datasets.decoded(frames, frame_datasets.read_episodes(spark, DATASET, include_video_metadata=True), IMAGE)",
            ),
            (False, "## Track\n\nLazy: nothing runs before the next step."),
            (True, tracks),
            (False, "## Look"),
            (True, f'df.select("episode_index", "frame_index", {shown}).show()'),
            (
                True,
                "from pathlib import Path\n\nfrom kinespark.cli import drawing\n\n"
                f'rows = df.select(named(IMAGE).alias("image"), "{column(methods[0])}").collect()\n'
                f'pictures = [drawing.with_hands(drawing.pixels(r.image), r["{column(methods[0])}"]) for r in rows if r.image]\n'
                'Path("hands.png").write_bytes(drawing.png(drawing.montage(pictures)))',
            ),
        ]
        if self.runtime == "cluster":
            out.append((False, "## On a cluster\n\nRun with `spark-submit --conf spark.executor.resource.gpu.amount=1 --conf spark.task.resource.gpu.amount=0.25 demo.py`."))
        if self.with_eval:
            scores = ", ".join(f'"{m}": match_hands("{column(m)}", "observation.state", "observation.extrinsics")' for m in methods)
            out += [
                (False, "## Compare with the truth\n\nDetection rate, mean error and PCK of each method."),
                (True, f"from kinespark.operators.matching import match_hands\nfrom kinespark.operators.metrics import by_method, report\n\nreport(by_method(df, {{{scores}}})).show()"),
            ]
        return out


@dataclass
class RewardsDemo:
    """Reward scoring of episodes against a running server."""

    dataset: str = "data/robot-episodes"
    split: str = "train"
    episodes: int = EPISODES
    max_frames: int = SAMPLES
    video_key: str = "observation.images.image"

    def validate(self) -> None:
        _at_least_one(episodes=self.episodes, max_frames=self.max_frames)

    def cells(self) -> Cells:
        self.validate()
        return [
            (False, f"# Reward scoring of {self.dataset}\n\nScores episodes for task progress and success, and lists those in doubt."),
            (False, "## Setup\n\nThe server's address and headers come from the environment."),
            (
                True,
                "import json\nimport os\n\nfrom pyspark.sql import SparkSession\n\nfrom kinespark.functions.columns import list_join, named\nfrom kinespark.operators.rewards import score_rewards\n"
                "from kinespark.operators.segments import doubtful, reward_curve\nfrom kinespark.sources import frame_datasets\n\nspark = SparkSession.builder.getOrCreate()\n"
                'URL = os.environ["REWARD_URL"]\nHEADERS = json.loads(os.environ.get("REWARD_HEADERS", "{}"))',
            ),
            (False, "## Episodes\n\nSorted and limited before scoring, so only these are posted."),
            (
                True,
                f"DATASET, SPLIT, VIDEO_KEY = {self.dataset!r}, {self.split!r}, {self.video_key!r}\nEPISODES, MAX_FRAMES = {self.episodes}, {self.max_frames}\n"
                'of = lambda x: named(f"videos/{VIDEO_KEY}/{x}")\n'
                'episodes = frame_datasets.read_episodes(spark, "/".join([DATASET, SPLIT]), include_video_metadata=True).orderBy("episode_index").limit(EPISODES)\n'
                'episodes = episodes.select("episode_index", list_join("tasks").alias("task"), "length", of("from_timestamp").alias("from_ts"), of("to_timestamp").alias("to_ts"), of("video").alias("video"))',
            ),
            (False, "## Score"),
            (True, 'scored = episodes.withColumn("rewards", score_rewards("task", "length", "from_ts", "to_ts", "video", url=URL, max_frames=MAX_FRAMES, headers=HEADERS)).persist()\nreward_curve(scored, keep=("episode_index",)).show()'),
            (
                True,
                "from pathlib import Path\n\nfrom kinespark.cli import drawing\n\ncurves = {}\n"
                'for r in reward_curve(scored, keep=("episode_index", "task")).orderBy("episode_index", "index").collect():\n'
                '    curves.setdefault(f"{r.episode_index}: {r.task}", []).append((r.timestamp_s, r.reward_score))\n'
                'Path("progress.svg").write_text(drawing.curves_svg(curves))',
            ),
            (False, "## Episodes in doubt\n\nFinal success below one half."),
            (True, 'doubtful(scored).select("episode_index", "task").show()'),
        ]


KINDS = {"hands": HandsDemo, "rewards": RewardsDemo}
_CHOICES = {"method": METHODS, "runtime": RUNTIMES}


def register(commands, kind: str) -> None:
    """Adds the subcommand: a flag per setting, None where it wasn't given."""
    p = commands.add_parser(kind, help=KINDS[kind].__doc__)
    for f in fields(KINDS[kind]):
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            p.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            p.add_argument(flag, type=int if f.type == "int" else str, choices=_CHOICES.get(f.name))
    for flags, told in ((["--no-input"], "ask nothing"), (["--force", "-f"], "write over existing files")):
        p.add_argument(*flags, help=told, action="store_true")
    p.add_argument("--output-dir")
    p.add_argument("--format", default="all", choices=(*FORMS, "all"))
    p.set_defaults(run=lambda args: _run(kind, args))


def _ask(name: str, default):
    """An answer of the default's kind; an empty one takes the default, a wrong one is asked again."""
    choices = _CHOICES.get(name)
    while True:
        raw = input(f"{name} [{default if default is not None else ''}]: ").strip()
        if not raw:
            return default
        if isinstance(default, bool):
            return raw.lower() in ("y", "yes")
        if choices and raw.lower() not in choices:
            print(f"  one of: {', '.join(choices)}")
        elif isinstance(default, int) and not raw.lstrip("-").isdigit():
            print("  a number, please")
        else:
            return raw.lower() if choices else int(raw) if isinstance(default, int) else raw


def collect(kind: str, args: argparse.Namespace, asking: bool):
    """The settings from flags, then answers, then defaults."""
    made = KINDS[kind]()
    for f in fields(made):
        given, default = getattr(args, f.name), getattr(made, f.name)
        if f.name == "runtime" and made.method == "mediapipe":
            if given == "cluster":
                print("mediapipe needs no GPU: local runtime", file=sys.stderr)
            given = "local"
        if f.name == "with_eval":
            default = made.runtime == "local" and made.dataset == KINDS[kind]().dataset
            if made.runtime != "local" and given is None:
                given = False
        skip = f.name == "max_frames" or (f.name == "mano_path" and made.method == "mediapipe")
        setattr(made, f.name, given if given is not None else default if skip or not asking else _ask(f.name, default))
    return made


def _run(kind: str, args) -> int:
    if not (args.no_input or sys.stdin.isatty()):
        print("no terminal to ask on: give --no-input", file=sys.stderr)
        return 2
    asking = not args.no_input
    try:
        cells = collect(kind, args, asking).cells()
    except ValueError as wrong:
        print("error:", wrong, file=sys.stderr)
        return 2
    default = f"{kind}-demo"
    folder = Path(args.output_dir or (_ask("output folder", default) if asking else default))
    wanted = [v for k, v in FORMS.items() if args.format in (k, "all")]
    if taken := [folder / name for name, _ in wanted if (folder / name).exists() and not args.force]:
        print(f"error: {taken[0]} exists; --force writes over it", file=sys.stderr)
        return 1
    folder.mkdir(parents=True, exist_ok=True)
    for name, render in wanted:
        (folder / name).write_text(render(cells), encoding="utf-8")
        print(folder / name)
    print(f"Run: {'spark-submit' if getattr(args, 'runtime', None) == 'cluster' else 'python'} {folder / 'demo.py'}")
    return 0
