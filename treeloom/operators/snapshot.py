"""A walk over a ``files`` table: the kept files and the kept tree nodes of every root."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from . import paths, rules


@dataclass(frozen=True)
class WalkOptions:
    include_hidden: bool = False
    no_ignore: bool = False
    all: bool = False
    exclude: tuple[str, ...] = field(default_factory=tuple)
    mktree_ignore: bool = True
    max_size: int = K.DEFAULT_MAX_SIZE


@dataclass
class Walk:
    files: DataFrame  # kept file rows (with content)
    nodes: DataFrame  # kept nodes: (root, path, is_dir, name, depth)
    errors: DataFrame | None = None  # (root, error) of roots whose ignore file is invalid; they keep nothing


def walk(files: DataFrame, opts: WalkOptions | None = None) -> Walk:
    """Filter a files table the way a pruning directory walk would.

    Hidden names, built-in and user globs are one per-row predicate over every
    ancestor prefix (no join). Directory nodes come from the closure of all
    paths, so a directory whose files are all excluded stays as an empty one.
    Per-root ignore files (``.mktreeignore``, ``.gitignore``/``.ignore``) add
    rule joins, see ``ignore.apply_ignore_files``; when ignore files exist the
    hidden-name test moves there, because a whitelisting rule rescues a hidden
    name.
    """
    from .ignore import apply_ignore_files, ignore_files_present

    opts = opts or WalkOptions()
    include_hidden = opts.include_hidden or opts.all
    use_git = not (opts.no_ignore or opts.all)
    present = ignore_files_present(files) if (use_git or opts.mktree_ignore) else set()
    git_present = use_git and "git" in present
    mk_present = opts.mktree_ignore and "mktree" in present
    hide_later = git_present and not include_hidden

    def keep(path, is_dir):
        return rules.keep_predicate(path, is_dir, include_hidden or hide_later, opts.all, list(opts.exclude))

    kept_files = files.filter(~F.col("is_dir") & keep(F.col("path"), F.lit(False)))
    nodes = paths.path_closure(files)
    nodes = nodes.filter(keep(F.col("path"), F.col("is_dir")))
    w = Walk(kept_files, nodes)
    if git_present or mk_present:
        w = apply_ignore_files(files, w, mktree=mk_present, git=git_present, hide=hide_later)
    return w
