"""Data sources for files and Git: spark.read.format("source_tree" | "git_tree" | "git_commits" | "git_changes" | "git_blame" | "git_line_log").

Spark's own file readers hide names that begin with _ or ., and so every __init__.py; these list files themselves. A
partition is a range of paths, read where it runs: the root or repository must be a folder that all executors reach.
"""

from __future__ import annotations

import json
import os
import subprocess
import threading
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders that hold no sources of the repository itself.
EXCLUDED = [".git", ".venv", "venv", "env", "__pycache__", "node_modules", ".mypy_cache", ".pytest_cache", ".ruff_cache", "dist", "build", ".tox", "site-packages"]
#: A larger file is listed without its text.
MAX_BYTES = 1_000_000
FILES_A_PARTITION = 200


def git(repo: str, *args: str) -> bytes:
    """Output of a git command; an error of git is raised."""
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def checked_revision(revision: str) -> str:
    if not revision or revision.startswith("-"):
        raise ValueError(f"not a revision: {revision!r}")
    return revision


class _Part(InputPartition):
    def __init__(self, items: list[str]):
        self.items = items


def _cut(items: list[str]) -> list[_Part]:
    return [_Part(items[i : i + FILES_A_PARTITION]) for i in range(0, len(items), FILES_A_PARTITION)] or [_Part([])]


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def items(self) -> list[str]:
        return []

    def rows(self, items: list[str]) -> Iterator[tuple]:
        raise NotImplementedError

    def partitions(self) -> list[_Part]:
        return _cut(self.items())

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from self.rows(partition.items)


class _Files(_Reader):
    """Options: path; suffix (default .py); excluded (comma-separated names); above (true: a root below a folder of such a name has no files).

    Names of folders are looked at from the root down; with above those over the root count as well.
    """

    def items(self):
        root, suffix = self.options["path"], self.options.get("suffix", ".py")
        excluded = set(self.options["excluded"].split(",")) if "excluded" in self.options else set(EXCLUDED)
        found = []
        if self.options.get("above", "false").lower() == "true" and excluded & set(os.path.abspath(root).split(os.sep)):
            return found
        for folder, below, names in os.walk(root):
            below[:] = [d for d in below if d not in excluded]
            found += [os.path.relpath(os.path.join(folder, n), root) for n in names if n.endswith(suffix)]
        return sorted(found)

    def rows(self, items):
        for path in items:
            try:
                with open(os.path.join(self.options["path"], path), encoding="utf-8", errors="replace") as f:
                    text = f.read()
                lines = text.count("\n") + (text != "" and not text.endswith("\n"))
                yield path, os.path.basename(path), text, lines, None
            except OSError as e:
                yield path, os.path.basename(path), None, 0, type(e).__name__


def _blobs(repo: str, names: list[str]) -> dict[str, bytes]:
    """The blobs of some ids, by one process."""
    if not names:
        return {}
    out = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="\n".join(names).encode(), check=True, capture_output=True).stdout
    found, at = {}, 0
    while at < len(out):
        end = out.index(b"\n", at)
        name, _, size = out[at:end].decode().split()
        found[name] = out[end + 1 : end + 1 + int(size)]
        at = end + 2 + int(size)
    return found


class _Tree(_Reader):
    """Options: path, revision. Blobs of a commit; the text is null for one that is too large or no UTF-8."""

    def items(self):
        out = git(self.options["path"], "ls-tree", "-r", "-l", "-z", checked_revision(self.options["revision"])).decode("utf-8", "replace")
        return sorted("\t".join([x.partition("\t")[2], *x.split()[2:4]]) for x in out.split("\0") if x and x.split()[1] == "blob")

    def rows(self, items):
        names, wanted = [], []
        for item in items:
            path, name, size = item.rsplit("\t", 2)
            names.append(path)
            wanted.append(name if int(size) <= MAX_BYTES else None)
        found = _blobs(self.options["path"], [w for w in wanted if w])
        for path, name in zip(names, wanted, strict=True):
            try:
                text = found[name].decode() if name else None
            except UnicodeDecodeError:
                text = None
            yield self.options["revision"], path, text, None if text is not None else "UNREADABLE"


def _log(repo: str, names: list[str], form: str, *args: str) -> Iterator[list[str]]:
    """The fields of a log format (with NULs between them), and file names if args ask for them, of some commits: one process, read as it writes.

    A word that only this process knows begins each commit, so no message and no file name can be taken for the next one.
    """
    if not names:
        return
    mark = uuid.uuid4().hex
    command = ["git", "-C", repo, "log", "--no-walk=unsorted", "--stdin", "-z", f"--format=%x00{mark}%x00{form}%x00", *args]
    with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE) as p:
        threading.Thread(target=lambda: (p.stdin.write("".join(f"{n}\n" for n in names).encode()), p.stdin.close()), daemon=True).start()
        own, rest = None, b""
        while chunk := p.stdout.read(1 << 16):
            *words, rest = (rest + chunk).split(b"\0")
            for word in (w.decode("utf-8", "replace") for w in words):
                if word.strip("\n") == mark:
                    if own is not None:
                        yield own
                    own = []
                elif own is not None:
                    own.append(word)
        if own is not None:
            yield [*own, rest.decode("utf-8", "replace")]
    if p.returncode:
        raise subprocess.CalledProcessError(p.returncode, command)


class _Commits(_Reader):
    """Options: path; revisions (HEAD, or previous..current); max_count. Newest first, with the sorted changed files; none for an empty repository."""

    def items(self):
        repo = self.options["path"]
        span = checked_revision(self.options.get("revisions", "HEAD"))
        limit = [f"--max-count={int(self.options['max_count'])}"] if "max_count" in self.options else []
        try:
            return git(repo, "log", "--format=%H", *limit, span).decode().split()
        except subprocess.CalledProcessError:
            return []

    def rows(self, items):
        for name, author, email, at, message, *files in _log(self.options["path"], items, "%H%x00%an%x00%ae%x00%ct%x00%B", "--no-renames", "--name-only", "--cc"):
            yield name, author, email, datetime.fromtimestamp(int(at), UTC), message.strip(), sorted(f.strip("\n") for f in files if f.strip("\n"))


class _Changes(_Reader):
    """Options: path, previous, current. (path, status, old_path); renames and copies have status R and the old path."""

    def rows(self, items):
        a, b = (checked_revision(self.options[k]) for k in ("previous", "current"))
        words = git(self.options["path"], "diff", "--name-status", "-z", "-M", a, b).decode("utf-8", "replace").split("\0")
        found, i = [], 0
        while i < len(words) - 1:
            moved = words[i][0] in "RC"
            found.append((words[i + 1 + moved], "R" if moved else words[i][0], words[i + 1] if moved else None))
            i += 2 + moved
        yield from sorted(found, key=lambda x: x[:2])


def _listed(value: str) -> list:
    """An option that is a JSON array, or names with commas between them."""
    return json.loads(value) if value.lstrip().startswith("[") else value.split(",")


def _commits(repo: str, names: set[str]) -> dict[str, tuple]:
    """Author, time and message of some commits, by one process."""
    each = (x[:4] for x in _log(repo, sorted(names), "%H%x00%an%x00%ct%x00%B", "-s"))
    return {name: (author, datetime.fromtimestamp(int(at), UTC), message.strip()) for name, author, at, message in each}


class _Blame(_Reader):
    """Options: path; files (a JSON array, or names with commas between them); revision. The commit that last touched each line; files that git cannot blame have no rows."""

    def items(self):
        return _listed(self.options["files"])

    def rows(self, items):
        blamed = []
        for path in items:
            try:
                out = git(self.options["path"], "blame", "-s", "-l", "--root", self.options.get("revision", "HEAD"), "--", path).decode("utf-8", "replace")
            except subprocess.CalledProcessError:
                continue
            blamed.append((path, [line.split()[0].lstrip("^") for line in out.splitlines()]))
        known = _commits(self.options["path"], {n for _, names in blamed for n in names})
        for path, names in blamed:
            for n, name in enumerate(names, 1):
                yield path, n, name, *known[name]


class _Revisions(_Reader):
    """Options: path; revisions (a JSON array, or names with commas between them; default HEAD). Whether the folder itself is a repository, and the commit that each name means, null for none."""

    def items(self):
        return _listed(self.options.get("revisions", "HEAD"))

    def rows(self, items):
        repo = self.options["path"]
        try:
            own = git(repo, "rev-parse", "--show-cdup").strip() == b""  # a folder inside a repository is none
        except (subprocess.CalledProcessError, OSError):
            own = False
        for name in items:
            commit = None
            if own and name and not name.startswith("-"):
                found = subprocess.run(["git", "-C", repo, "rev-parse", "--verify", "--quiet", f"{name}^{{commit}}"], capture_output=True)
                commit = found.stdout.decode().strip() or None
            yield repo, own, name, commit


class _LineLog(_Reader):
    """Options: path; ranges (a JSON array of [file, first line, last line]); revision. Newest first, the commits that changed lines of each range, by git's own line history; none where git knows no such lines."""

    def items(self):
        return [json.dumps(x) for x in json.loads(self.options["ranges"])]

    def rows(self, items):
        for file, first, last in map(json.loads, items):
            span = f"-L{int(first)},{int(last)}:{file}"
            try:
                out = git(self.options["path"], "log", span, "-s", "--format=%H", checked_revision(self.options.get("revision", "HEAD"))).decode()
            except subprocess.CalledProcessError:
                continue
            names = out.split()
            known = _commits(self.options["path"], set(names))
            for rank, name in enumerate(names):
                yield file, int(first), int(last), rank, name, *known[name]


def _source(name: str, ddl: str, reader: type[_Reader]) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return ddl

        def reader(self, schema):
            return reader(dict(self.options))

    return Source


SOURCES = [
    _source("source_tree", "path string, file_name string, text string, line_count int, error string", _Files),
    _source("git_tree", "revision string, path string, text string, error string", _Tree),
    _source("git_commits", "commit_hash string, author_name string, author_email string, committed_at timestamp, message string, changed_files array<string>", _Commits),
    _source("git_revisions", "path string, is_repository boolean, revision string, commit_hash string", _Revisions),
    _source("git_changes", "path string, status string, old_path string", _Changes),
    _source("git_blame", "file_path string, line_number int, commit_hash string, author_name string, committed_at timestamp, message string", _Blame),
    _source("git_line_log", "file_path string, first int, last int, rank int, commit_hash string, author_name string, committed_at timestamp, message string", _LineLog),
]


def register(spark: SparkSession) -> None:
    for s in SOURCES:
        spark.dataSource.register(s)
