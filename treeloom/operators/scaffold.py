"""Blueprint inputs and scaffolding (ops 6, 7, 51, 52).

plan: wanted nodes ⟕ existing paths on (root, path) -> create / keep /
overwrite, plus a conflict flag; the whole plan is validated before anything
is written. write: the plan is materialised by executors into a target folder
on shared storage, many roots in parallel, directories first.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package


class ScaffoldConflict(RuntimeError):
    pass


# ---------------------------------------------------------------------------
# templates (op 6) and inline text (op 7)
# ---------------------------------------------------------------------------


def pick_template(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """requests(req_id, dir, name) ⟕ templates(dir, name, text, builtin) -> (req_id, text, source, error).

    Priority: the directory's file named NAME, then NAME.tree, then the built-in
    called NAME without a trailing '.tree'. Unknown names get the error text
    listing the built-ins (sorted).
    """
    files = templates.filter(~F.col("builtin"))
    builtins = templates.filter(F.col("builtin"))
    exact = requests.join(files, ["dir", "name"]).select("req_id", "text", F.lit(1).alias("prio"), F.lit("dir").alias("source"))
    dotted = (
        requests.withColumn("name", F.concat("name", F.lit(".tree")))
        .join(files, ["dir", "name"])
        .select("req_id", "text", F.lit(2).alias("prio"), F.lit("dir").alias("source"))
    )
    bname = F.regexp_replace(F.col("name"), r"\.tree$", "")
    built = (
        requests.select("req_id", bname.alias("bname"))
        .join(builtins.select(F.col("name").alias("bname"), "text"), "bname")
        .select("req_id", "text", F.lit(3).alias("prio"), F.lit("builtin").alias("source"))
    )
    best = (
        exact.unionByName(dotted)
        .unionByName(built)
        .groupBy("req_id")
        .agg(F.min_by(F.struct("text", "source"), "prio").alias("b"))
        .select("req_id", F.col("b.text").alias("text"), F.col("b.source").alias("source"))
    )
    # one aggregated text of all built-in names, for the error text
    listing = builtins.agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("l")).first()["l"] or "none"
    err = F.concat(
        F.lit("Template '"), F.col("name"), F.lit("' was not found in "), F.col("dir"),
        F.lit(f" or built-in templates ({listing})"),
    )
    return requests.join(best, "req_id", "left").select(
        "req_id", "text", "source", F.when(F.col("text").isNull(), err).alias("error")
    )


def normalize_inline(text: Column) -> Column:
    """Inline blueprint text: a literal backslash-n becomes a newline."""
    return F.replace(text, F.lit("\\n"), F.lit("\n"))


def input_conflict(inline: Column, template: Column, input_file: Column) -> Column:
    """Error text when more than one blueprint source is given."""
    n = sum((c.isNotNull()).cast("int") for c in (inline, template, input_file))
    return F.when(n > 1, F.lit("Use only one of --input, --template, or --inline"))


# ---------------------------------------------------------------------------
# plan (op 51)
# ---------------------------------------------------------------------------


def scaffold_plan(wanted: DataFrame, existing: DataFrame, force: bool = False, dry_run: bool = False) -> DataFrame:
    """wanted(root, path, is_dir[, content]) ⟕ existing(root, path, is_dir) ->
    (..., exists, existing_is_dir, action, conflict, replaces_dir).

    * directory: exists as directory -> keep; exists as file -> needs force, then
      create (a dry run reports keep); absent -> create;
    * file: exists (file or directory) -> needs force, then overwrite; absent -> create;
    * a dry run never conflicts.
    """
    ex = existing.select("root", "path", F.col("is_dir").alias("existing_is_dir"))
    j = wanted.join(ex, ["root", "path"], "left")
    exists = F.col("existing_is_dir").isNotNull()
    dir_action = (
        F.when(~exists, F.lit("create"))
        .when(F.col("existing_is_dir"), F.lit("keep"))
        .otherwise(F.lit("keep") if dry_run else F.lit("create"))
    )
    file_action = F.when(exists, F.lit("overwrite")).otherwise(F.lit("create"))
    action = F.when(F.col("is_dir"), dir_action).otherwise(file_action)
    needs_force = exists & ~(F.col("is_dir") & F.col("existing_is_dir"))
    conflict = needs_force & F.lit(not force and not dry_run)
    return j.select(
        "*",
        exists.alias("exists"),
        action.alias("action"),
        conflict.alias("conflict"),
        (~F.col("is_dir") & F.coalesce(F.col("existing_is_dir"), F.lit(False))).alias("replaces_dir"),
    )


# ---------------------------------------------------------------------------
# write (op 52)
# ---------------------------------------------------------------------------


def _unsafe(name: Column) -> Column:
    return name.isNull() | name.isin("", ".", "..") | name.contains("/") | name.contains("\\")


_EVENT_SCHEMA = T.StructType(
    [
        T.StructField("root", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("action", T.StringType()),
        T.StructField("written", T.BooleanType()),
    ]
)


def _refuse(plan: DataFrame) -> None:
    """Raise for the first unsafe name or conflict of a plan, before anything is written."""
    unsafe = _unsafe(F.col("root")) | F.coalesce(F.size("path") <= 0, F.lit(True)) | F.exists("path", _unsafe)
    bad = plan.filter(unsafe | F.col("conflict")).select("root", "path", unsafe.alias("unsafe")).limit(1).collect()
    if bad:
        where = f"{bad[0]['root']}/{'/'.join(bad[0]['path'] or [])}"
        if bad[0]["unsafe"]:
            raise ScaffoldConflict(f"unsafe path: {where}")
        raise ScaffoldConflict(f"{where} already exists; use --force to overwrite")


def _stage(rows: DataFrame, act) -> DataFrame:
    """Run ``act(root, path, content)`` once per row in the executors and keep the events.

    The events are checkpointed at once: later reads of them write nothing again.
    A task that is tried again repeats the same outcome.
    """
    from .joins import freeze

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for root, path, content in zip(*(whole.column(c) for c in ("root", "path", "content"))):
                act(root.as_py(), path.as_py(), content.as_py())  # one file's text at a time
            yield pa.RecordBatch.from_arrays(
                [*(whole.column(c) for c in names), pa.array([True] * whole.num_rows, pa.bool_())], names=[*names, "written"]
            )

    names = ["root", "path", "is_dir", "action"]
    return freeze(rows.mapInArrow(run, _EVENT_SCHEMA))


class _Places:
    """Where a write keeps what it has not finished: new files, what it replaced, and which directories it made.

    Everything stands in one folder below the target, so each step is a rename
    inside one file system, and what was done can be told from what is there.
    """

    def __init__(self, target: str, work: str):
        self.target, self.work = target, work

    def at(self, root: str, path: list[str]) -> str:
        return os.path.join(self.target, root, *path)

    def new(self, root: str, path: list[str]) -> str:
        return os.path.join(self.work, "new", root, *path)

    def _key(self, kind: str, root: str, path: list[str]) -> str:
        digest = hashlib.sha256("/".join([root, *path]).encode()).hexdigest()
        return os.path.join(self.work, kind, digest[:2], digest)

    def prepare(self, root: str, path: list[str], content) -> None:
        """The new file, outside of its place."""
        full = self.new(root, path)
        os.makedirs(os.path.dirname(full), exist_ok=True)
        with open(full, "w", encoding="utf-8", newline="") as fh:
            fh.write(content or "")

    def _set_aside(self, root: str, path: list[str]) -> None:
        old = self._key("old", root, path)
        os.makedirs(os.path.dirname(old), exist_ok=True)
        if not os.path.lexists(old):
            os.rename(self.at(root, path), old)

    def clear(self, root: str, path: list[str], is_dir: bool) -> None:
        """What is in the way of a directory or a file is set aside."""
        full = self.at(root, path)
        folder = os.path.isdir(full) and not os.path.islink(full)
        if os.path.lexists(full) and folder != is_dir:
            self._set_aside(root, path)

    def make(self, root: str, path: list[str]) -> None:
        """A directory and those above it; each one made is noted first."""
        for depth in range(len(path) + 1):
            full = self.at(root, path[:depth])
            if not os.path.isdir(full):
                note = self._key("made", root, path[:depth])
                os.makedirs(os.path.dirname(note), exist_ok=True)
                with open(note, "w"):
                    pass
                os.makedirs(self.target, exist_ok=True)
                try:
                    os.mkdir(full)
                except FileExistsError:  # another task made it, or something else is in its place
                    if not os.path.isdir(full):
                        raise

    def put(self, root: str, path: list[str]) -> None:
        """The new file to its place; a file there is set aside, anything else is an error."""
        self.make(root, path[:-1])
        full, new = self.at(root, path), self.new(root, path)
        if not os.path.lexists(new):
            return  # an earlier try of this task has put it there
        if os.path.lexists(full):
            if os.path.isdir(full) and not os.path.islink(full):
                raise IsADirectoryError(f"a directory is in the place of a file: {full}")
            self._set_aside(root, path)
        os.rename(new, full)

    def take_back(self, root: str, path: list[str]) -> None:
        """A new file that was put in its place goes."""
        full = self.at(root, path)
        if not os.path.lexists(self.new(root, path)) and os.path.isfile(full):
            os.remove(full)

    def unmake(self, root: str, path: list[str]) -> None:
        """A directory that was made goes, unless others have put something there."""
        if os.path.exists(self._key("made", root, path)):
            try:
                os.rmdir(self.at(root, path))
            except OSError:
                pass

    def restore(self, root: str, path: list[str]) -> None:
        old = self._key("old", root, path)
        if os.path.lexists(old) and not os.path.lexists(self.at(root, path)):
            os.rename(old, self.at(root, path))

    def forget(self, folder: str) -> None:
        full = os.path.join(self.work, folder)
        if os.path.isdir(full):
            shutil.rmtree(full)


def _undo(rows: DataFrame, places: _Places) -> None:
    """The target as it was: new files go, then directories made (deepest first), then what was set aside returns."""
    _stage(rows.filter("NOT is_dir"), lambda root, path, _: places.take_back(root, path))
    above = F.explode(F.sequence(F.lit(0), F.size("path") - F.when(F.col("is_dir"), 0).otherwise(1))).alias("depth")
    made = rows.select("root", "path", above).select("root", F.slice("path", F.lit(1), F.col("depth")).alias("path")).distinct()
    made = made.select("*", F.lit(True).alias("is_dir"), F.lit("undo").alias("action"), F.lit(None).cast("string").alias("content"))
    deepest = made.agg(F.max(F.size("path"))).first()[0]
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        _stage(made.filter(F.size("path") == depth), lambda root, path, _: places.unmake(root, path))
    _stage(rows, lambda root, path, _: places.restore(root, path))


def scaffold_write(plan: DataFrame, target: str, dry_run: bool = False) -> DataFrame:
    """Materialise a plan under ``target/<root>/``; returns the recorded events.

    Names ('..', '', separators) and conflicts are checked for the whole plan
    first, so a refused plan leaves the target untouched. New files are written
    beside their places, then put there by renames in finished stages: what is in
    the way is set aside (a file where a directory belongs, a directory where a file
    belongs), directories are made, files are put. A stage that fails has all of
    them undone before the error is raised, so the target is as it was.
    """
    ship_package(plan.sparkSession)
    _refuse(plan)
    cols = plan.select("root", "path", "is_dir", "action", F.col("content").cast("string").alias("content"))
    if dry_run:
        return cols.select("root", "path", "is_dir", "action", F.lit(False).alias("written"))
    existed = os.path.isdir(target)
    work = os.path.join(target, f".scaffold-{uuid.uuid4().hex}")
    places = _Places(target, work)
    names = cols.withColumn("content", F.lit(None).cast("string"))
    in_way = names
    if "replaces_dir" in plan.columns:
        kept = plan.filter(F.col("exists") & (F.col("replaces_dir") | (F.col("is_dir") & ~F.col("existing_is_dir"))))
        in_way = kept.select("root", "path", "is_dir", "action", F.lit(None).cast("string").alias("content"))
    try:
        _stage(cols.filter("NOT is_dir"), places.prepare)
        try:
            _stage(in_way.filter("is_dir"), lambda root, path, _: places.clear(root, path, True))
            _stage(in_way.filter("NOT is_dir"), lambda root, path, _: places.clear(root, path, False))
            made = _stage(names.filter("is_dir"), lambda root, path, _: places.make(root, path))
            events = made.unionByName(_stage(names.filter("NOT is_dir"), lambda root, path, _: places.put(root, path)))
        except BaseException:
            _undo(names, places)
            raise
    except BaseException:
        _clean(plan, places)
        if not existed and os.path.isdir(target) and not os.listdir(target):
            os.rmdir(target)
        raise
    _clean(plan, places)
    return events


def _clean(plan: DataFrame, places: _Places) -> None:
    """Remove the working folder: its many parts in the executors, the empty rest here."""
    parts = plan.select(F.concat(F.lit("new/"), F.col("root")).alias("folder")).distinct()
    digits = "0123456789abcdef"
    kinds = plan.sparkSession.createDataFrame([(f"{k}/{a}{b}",) for k in ("old", "made") for a in digits for b in digits], "folder string")
    rows = parts.unionByName(kinds).select(
        "folder", F.lit("").alias("root"), F.array("folder").alias("path"), F.lit(True).alias("is_dir"),
        F.lit("clean").alias("action"), F.lit(None).cast("string").alias("content"),
    )
    _stage(rows, lambda root, path, _: places.forget(path[0]))
    if os.path.isdir(places.work):
        shutil.rmtree(places.work)
