"""Directory trees as a Spark data source (op 1): ``spark.read.format("filetree")``.

Partitions are groups of subtrees of each root (top-level entries, directories
opened further when those are few), read inside executors, so a walk of many
roots, of one wide root, or of one huge directory runs in parallel. The last name
of a root is its key; two roots of the same name are refused. Every entry arrives:
files, directories (also empty), dot-files, ``__init__.py``, symbolic links
(listed, never followed while walking; reading one follows it, and a failure
becomes the ``error`` column). Files above ``max_size`` carry only their first
8 KiB (enough for MIME detection). The paths must be on storage that every
executor mounts.

Options: ``roots`` (JSON list of directories) and/or ``parent`` (every
subdirectory is a root), ``max_size`` (bytes, default 1 MiB),
``target_partitions`` (default 64; raise it with the size of the cluster).
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import constants as K
from ..session import ship_package

SCHEMA = (
    "root string, path array<string>, is_dir boolean, is_symlink boolean, size bigint, content binary, error string"
)

# A worker holds so many rows, or so many bytes of content, before it hands them on.
BATCH_ROWS = 512
BATCH_BYTES = 4 * 1024 * 1024


class _Part(InputPartition):
    """Entries of one root: ``subtrees`` are walked, ``alone`` are directories that give only their own row."""

    def __init__(self, root: str, subtrees: list[list[str]], alone: list[list[str]] | None = None):
        self.root = root
        self.subtrees = subtrees
        self.alone = alone or []


def _shown(name: str) -> str:
    """A file name as text: bytes that are not UTF-8 become replacement characters."""
    return os.fsencode(name).decode("utf-8", "replace")


def _err(e: OSError) -> str:
    return f"{e.strerror or e} (os error {e.errno})" if getattr(e, "errno", None) else str(e)


def _file_row(root: str, parts: list[str], full: str, is_link: bool, max_size: int):
    shown = [_shown(p) for p in parts]
    size = None
    try:
        size = os.stat(full).st_size  # follows a link, like reading does
        with open(full, "rb") as fh:
            data = fh.read(K.DETECTION_BYTES) if size > max_size else fh.read()
    except OSError as e:
        return (root, shown, False, is_link, size, None, _err(e))
    return (root, shown, False, is_link, size, data, None)


def _walk(top: str, root: str, rel: list[str], max_size: int) -> Iterator[tuple]:
    """Rows of an entry and all below it, one per path; open directories wait on a list, not on the call stack."""
    waiting = [rel]
    while waiting:
        parts = waiting.pop()
        full = os.path.join(top, *parts)
        is_link = os.path.islink(full)
        if is_link or not os.path.isdir(full):
            yield _file_row(root, parts, full, is_link, max_size)
            continue
        error, names = None, []
        try:
            names = sorted(os.listdir(full), reverse=True)
        except OSError as e:
            error = _err(e)
        yield (root, [_shown(p) for p in parts], True, False, None, None, error)
        waiting.extend([*parts, n] for n in names)


def _batch(pa, rows: list[tuple]):
    types = [pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_(), pa.int64(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)], names=names)


class FileTreeReader(DataSourceReader):
    def __init__(self, options):
        self.roots = json.loads(options.get("roots", "[]"))
        self.parent = options.get("parent")
        self.max_size = int(options.get("max_size", K.DEFAULT_MAX_SIZE))
        self.target = int(options.get("target_partitions", "64"))

    def partitions(self):
        """At most about ``target_partitions`` groups of entries, and at least one per root with entries.

        The entries of every root, and of the widest directories when roots have
        few entries, are listed here (names only) and dealt out in groups of
        about equal number, so a flat directory of any width is a bounded number
        of tasks.
        """
        roots = list(self.roots)
        if self.parent:
            with os.scandir(self.parent) as entries:
                roots += sorted(e.path for e in entries if e.is_dir())
        names = [os.path.basename(os.path.normpath(r)) for r in roots]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"roots of the same name cannot be told apart: {', '.join(twice)}")
        subtrees: dict[str, list[list[str]]] = {}
        alone: dict[str, list[list[str]]] = {}
        for r in roots:
            try:
                subtrees[r] = [[n] for n in sorted(os.listdir(r))]
            except OSError:
                subtrees[r] = []
        # open directories level by level until there are enough entries to deal out
        opened = 0
        grows = True
        while grows and opened < self.target and sum(map(len, subtrees.values())) < self.target:
            grows = False
            for r in roots:
                deeper: list[list[str]] = []
                for rel in subtrees[r]:
                    full = os.path.join(r, *rel)
                    below = []
                    if opened < self.target and os.path.isdir(full) and not os.path.islink(full):
                        opened += 1
                        try:
                            below = sorted(os.listdir(full))
                        except OSError:
                            below = []
                    if below:
                        alone.setdefault(r, []).append(rel)
                        deeper.extend([*rel, n] for n in below)
                        grows = True
                    else:
                        deeper.append(rel)
                subtrees[r] = deeper
        size = max(1, -(-sum(map(len, subtrees.values())) // max(1, self.target)))
        parts = []
        for r in roots:
            groups = [subtrees[r][i : i + size] for i in range(0, len(subtrees[r]), size)]
            for i, group in enumerate(groups):
                parts.append(_Part(r, group, alone.get(r) if i == 0 else None))
        return parts or [_Part("", [])]

    def read(self, partition: _Part):
        """Arrow batches of at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes of content (one file at least)."""
        import pyarrow as pa

        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[5] or b"")
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield _batch(pa, rows)
                rows, held = [], 0
        if rows:
            yield _batch(pa, rows)

    def _rows(self, partition: _Part) -> Iterator[tuple]:
        name = _shown(os.path.basename(os.path.normpath(partition.root)))
        for rel in partition.alone:
            yield (name, [_shown(p) for p in rel], True, False, None, None, None)
        for rel in partition.subtrees:
            yield from _walk(partition.root, name, rel, self.max_size)


class FileTreeDataSource(DataSource):
    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FileTreeReader(self.options)


def register(spark) -> None:
    ship_package(spark)
    spark.dataSource.register(FileTreeDataSource)


def scan_files(spark, roots: list[str], max_size: int = K.DEFAULT_MAX_SIZE):
    """``files`` of the given roots (root = the directory's last name)."""
    register(spark)
    return (
        spark.read.format("filetree")
        .option("roots", json.dumps([os.path.abspath(r) for r in roots]))
        .option("max_size", str(max_size))
        .load()
    )


def scan_parent(spark, parent: str, max_size: int = K.DEFAULT_MAX_SIZE):
    """``files`` of every subdirectory of ``parent`` (each one a root)."""
    register(spark)
    return (
        spark.read.format("filetree")
        .option("parent", os.path.abspath(parent))
        .option("max_size", str(max_size))
        .load()
    )
