"""Git history as a Spark data source.

The driver lists the hashes of the walk and deals them out in ranges; each task
reads its own commits with the git command. ``walk_pos`` is the place in the walk
from the newest commit, so that order survives.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestone.errors import CommitNotFound, DiffFailed, InvalidGitFile, NoHead, NotARepository, WalkFailed
from lodestone.functions.text import FILES, PATHS_LIMIT, TEXT_LIMIT

SCHEMA = "walk_pos long, hash string, author string, date timestamp, message string, diff_summary string"


def _git(path: str, *args: str, stdin: bytes | None = None) -> bytes:
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], input=stdin, capture_output=True)
    if done.returncode:
        raise RuntimeError(done.stderr.decode(errors="replace").strip())
    return done.stdout


def open_repository(path: str) -> str:
    """The top of the repository that holds ``path``."""
    try:
        return _git(path, "rev-parse", "--show-toplevel").decode().strip() or path
    except (RuntimeError, FileNotFoundError):
        raise NotARepository(f"{path} is not inside a repository") from None


def git_dir(path: str) -> str:
    """The folder git keeps its data in; worktrees and submodules point to it."""
    dot = Path(path) / ".git"
    if dot.is_file():
        text = dot.read_text(errors="replace").strip()
        if not text.startswith("gitdir:") or not text.removeprefix("gitdir:").strip():
            raise InvalidGitFile(str(dot))
    try:
        return _git(path, "rev-parse", "--absolute-git-dir").decode().strip()
    except (RuntimeError, FileNotFoundError):
        raise NotARepository(f"{path} is not inside a repository") from None


def walk(path: str) -> list[str]:
    """Hashes from HEAD, children before parents, by time otherwise."""
    try:
        _git(path, "rev-parse", "--verify", "HEAD")
    except RuntimeError:
        raise NoHead() from None
    try:
        return _git(path, "rev-list", "--topo-order", "HEAD").decode().split()
    except RuntimeError as e:
        raise WalkFailed(str(e)) from None


def files_line(paths: list[str], limit: int = PATHS_LIMIT) -> str:
    line, first = FILES, True
    for p in sorted(set(paths)):
        longer = line + ("" if first else ", ") + p
        if len(longer.encode()) > limit:
            return line + ", ..."
        line, first = longer, False
    return line


def cut(text: str, limit: int = TEXT_LIMIT) -> str:
    data = text.encode()
    if len(data) <= limit:
        return text
    end = limit
    while end < len(data) and data[end] & 0xC0 == 0x80:  # finish the character
        end += 1
    return data[:end].decode() + "\n... (truncated)"


_BASE = ["diff-tree", "--stdin", "--always", "--root", "-r", "--no-renames"]


def diff_summaries(path: str, commits: list[str], parents: list[str | None]) -> Iterator[str]:
    """For each commit its changed paths, then the added and removed lines, against
    the first parent. Two processes serve all: one for names, one for patches."""
    asked = "".join(f"{c} {p}\n" if p else f"{c}\n" for c, p in zip(commits, parents)).encode()
    try:
        names = _sections(_git(path, *_BASE, "--name-only", "-z", stdin=asked).split(b"\0"), commits)
        patches = _sections(_git(path, *_BASE, "-p", "-U0", "--no-color", "--no-ext-diff", stdin=asked).split(b"\n"), commits)
    except RuntimeError as e:
        raise DiffFailed(str(e)) from None
    for commit in commits:
        yield _summary([n.decode(errors="replace") for n in names[commit]], patches[commit])


def _sections(parts: list[bytes], commits: list[str]) -> dict[str, list[bytes]]:
    """What follows each commit's own line. The commits come in the order asked, so
    only the next one's line can begin a section."""
    out: dict[str, list[bytes]] = {c: [] for c in commits}
    ahead, now = iter([*commits, None]), None
    next_ = next(ahead)
    for part in parts:
        if next_ and part == next_.encode():
            now, next_ = next_, next(ahead)
        elif now:
            out[now].append(part)
    return out


def _summary(names: list[str], patch: list[bytes]) -> str:
    body, header = [], False
    for line in patch:
        if line.startswith(b"diff --git "):
            header = True
        elif line.startswith(b"@@"):
            header = False
        elif not header and line[:1] in (b"+", b"-"):
            try:
                body.append(line.decode())
            except UnicodeDecodeError:
                continue
    return cut(files_line([n for n in names if n]) + "\n" + "".join(x + "\n" for x in body))


class _Range(InputPartition):
    def __init__(self, start: int, hashes: list[str]):
        self.start, self.hashes = start, hashes


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = open_repository(options.get("path", "."))
        self.diffs = str(options.get("includeDiffs", "true")).lower() == "true"
        self.size = int(options.get("commitsPerTask", "500"))

    def partitions(self) -> list[InputPartition]:
        hashes = walk(self.path)
        return [_Range(i, hashes[i : i + self.size]) for i in range(0, len(hashes), self.size)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        form = "%H%x00%an%x00%ct%x00%P%x00%B%x00"
        out = _git(self.path, "log", "--no-walk=unsorted", "--stdin", "-z", f"--format={form}", stdin="\n".join(partition.hashes).encode())
        fields = out.decode(errors="replace").split("\0")
        rows = [fields[at : at + 5] for at in range(0, 6 * len(partition.hashes), 6)]
        parents = [(r[3].split() or [None])[0] for r in rows]
        diffs = diff_summaries(self.path, partition.hashes, parents) if self.diffs else iter([""] * len(rows))
        for i, ((commit, author, seconds, _, message), diff) in enumerate(zip(rows, diffs)):
            date = datetime.fromtimestamp(int(seconds), timezone.utc)
            yield partition.start + i, commit.strip(), author or "Unknown", date, message, diff


class GitSource(DataSource):
    """spark.read.format("git_history").option("path", ...).load()"""

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def history(spark: SparkSession, path: str, include_diffs: bool = True) -> DataFrame:
    open_repository(path)
    spark.dataSource.register(GitSource)
    return spark.read.format("git_history").option("path", path).option("includeDiffs", str(include_diffs).lower()).load()


def since(commits: DataFrame, last: str) -> DataFrame:
    """The walk before it meets ``last``; not all that ``last`` cannot reach: a
    side branch that comes later in the walk is left out."""
    stop = commits.where(F.col("hash") == last).agg(F.min("walk_pos").alias("stop")).first().stop
    if stop is None:
        raise CommitNotFound(f"{last[:7]} is not in the history")
    return commits.where(F.col("walk_pos") < stop)
