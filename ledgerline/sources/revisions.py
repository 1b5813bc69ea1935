"""Revisions of a model in git, read with plain git commands by the driver, and unified diffs."""

from __future__ import annotations

import difflib
import io
import subprocess
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from ledgerline.sources import entity


def _git(repository: str, *arguments: str) -> bytes:
    done = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, check=False)
    if done.returncode:
        raise ValueError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def resolve(repository: str, revision: str) -> str:
    """The commit that a name stands for."""
    return _git(repository, "rev-parse", "--verify", f"{revision}^{{commit}}").decode().strip()


def merge_base(repository: str, a: str, b: str) -> str:
    return _git(repository, "merge-base", resolve(repository, a), resolve(repository, b)).decode().strip()


def extract(repository: str, revision: str, target: str, below: str = "") -> str:
    """The files of a revision, written below ``target``; returns the folder of the model in it."""
    raw = _git(repository, "archive", "--format=tar", resolve(repository, revision), *([below] if below else []))
    with tarfile.open(fileobj=io.BytesIO(raw)) as archive:
        archive.extractall(target, filter="data")
    return str(Path(target) / below)


def load(spark: SparkSession, repository: str, revision: str, target: str, below: str = "") -> entity.Model:
    """The model of a revision; ``target`` is a folder that all executors see."""
    return entity.load_model(spark, f"file://{extract(repository, revision, target, below)}")


def last_changes(spark: SparkSession, repository: str, revision: str = "HEAD") -> DataFrame:
    """(path, commit, author, day) of the last change of every file."""
    text = _git(repository, "log", "--format=%x01%H%x02%an%x02%as", "--name-only", resolve(repository, revision)).decode()
    rows: dict[str, tuple] = {}
    for part in text.split("\x01")[1:]:
        head, _, names = part.partition("\n")
        for path in names.split("\n"):
            if path:
                rows.setdefault(path, (path, *head.split("\x02")))
    return spark.createDataFrame(sorted(rows.values()), "path string, commit string, author string, day string")


def unified(before: str, after: str, path: str, context: int = 3) -> str:
    """A unified diff of two texts, empty if they are equal."""
    lines = difflib.unified_diff(before.splitlines(True), after.splitlines(True), f"a/{path}", f"b/{path}", n=context)
    return "".join(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n" for line in lines)
