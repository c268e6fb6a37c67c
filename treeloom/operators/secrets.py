"""Credential findings (ops 34, 35): (root, path, line, kind), never the matched value.

Plan: cheap guards (literal needles, two short regexes) prefilter each
windowed text, then only surviving texts are split into lines (``posexplode``)
and each line is tested against every rule whose guard it passes; matched
kinds are exploded. All
patterns are literals, compiled once per task. The patterns are written in the
common subset of Java and RE2 regex syntax (no ``\\b``, ``.``, ``$``), so the
same strings run in the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inspect import ContentOptions, windowed

_B = "(?:^|[^A-Za-z0-9_])"  # left boundary
_E = "(?:[^A-Za-z0-9_]|\\z)"  # right boundary

# Kinds of credentials and their patterns (from the vendors' public token formats).
SECRET_RULES = [
    ("private key", "-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
    ("AWS access key", _B + "(?:AKIA|ASIA)[0-9A-Z]{16}" + _E),
    ("GitHub token", _B + "(?:(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,})" + _E),
    ("GitLab token", _B + "glpat-[A-Za-z0-9_-]{20,}" + _E),
    ("OpenAI API key", _B + "sk-(?:proj-|svcacct-|admin-)?[A-Za-z0-9_-]{20,}" + _E),
    ("Google API key", _B + "AIza[0-9A-Za-z_-]{35}" + _E),
    ("Stripe key", _B + "(?:sk|rk)_(?:live|test)_[0-9A-Za-z]{16,}" + _E),
    ("Slack token", _B + "xox[abposr]-[0-9A-Za-z-]{10,}" + _E),
    ("JWT", _B + "eyJ[A-Za-z0-9_-]{5,}[.]eyJ[A-Za-z0-9_-]{5,}[.][A-Za-z0-9_-]{5,}"),
    (
        "authorization header",
        "(?i)authorization[ \\t]*[:=][ \\t]*[\"']?(?:bearer|basic|token)[ \\t]+[A-Za-z0-9._~+/=-]{8,}",
    ),
    (
        "credential assignment",
        "(?i)" + _B + "(?:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|auth[_-]?token|token|client[_-]?secret)"
        "[ \\t]*[:=][ \\t]*[\"'][^\"' \\t]{4,}[\"']",
    ),
]

ANY_SECRET = "|".join(f"(?:{rx})" for _k, rx in SECRET_RULES)

# Cheap guards: a rule can only match where its guard does (literal needles, or a short
# regex without a leading boundary group). Scanning whole texts with guards first is
# ~60x cheaper than running the boundary-led patterns at every position.
RULE_GUARDS = {
    "private key": ["PRIVATE KEY-----"],
    "AWS access key": ["AKIA", "ASIA"],
    "GitHub token": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"],
    "GitLab token": ["glpat-"],
    "OpenAI API key": ["sk-"],
    "Google API key": ["AIza"],
    "Stripe key": ["_live_", "_test_"],
    "Slack token": ["xoxa-", "xoxb-", "xoxp-", "xoxo-", "xoxs-", "xoxr-"],
    "JWT": ["eyJ"],
    "authorization header": "(?i)authorization",
    "credential assignment": "[:=][ \\t]*[\"']",
}


def _guard(t: Column, kind: str) -> Column:
    g = RULE_GUARDS[kind]
    if isinstance(g, str):
        return t.rlike(g)
    out = None
    for needle in g:
        c = t.contains(needle)
        out = c if out is None else (out | c)
    return out


def any_guard(t: Column) -> Column:
    out = None
    for k, _rx in SECRET_RULES:
        c = _guard(t, k)
        out = c if out is None else (out | c)
    return out


def _kinds(line: Column) -> Column:
    hits = [
        F.when(_guard(line, k) & line.rlike(rx), F.struct(F.lit(i).alias("rule"), F.lit(k).alias("kind")))
        for i, (k, rx) in enumerate(SECRET_RULES)
    ]
    return F.filter(F.array(*hits), lambda h: h.isNotNull())


def secret_findings(inspected: DataFrame, opts: ContentOptions | None = None,
                    policy: DataFrame | None = None) -> DataFrame:
    """(root, path, line, rule, kind) over the windowed text of text files.

    ``policy``: (root, scan) from ``options.secret_scan_policy``; roots with
    scan = false are removed first (broadcast semi join, size-checked), so their
    text is never scanned.
    """
    if policy is not None:
        from .joins import checked_broadcast

        inspected = inspected.join(checked_broadcast(policy.filter(F.col("scan")).select("root")), "root", "left_semi")
    text = windowed(F.col("text"), opts)
    cand = inspected.filter(F.col("kind") == "text").select("root", "path", text.alias("t")).filter(
        any_guard(F.col("t"))
    )
    lines = cand.select("root", "path", F.posexplode(F.split("t", "\n")).alias("pos", "l")).select(
        "root", "path", (F.col("pos") + 1).alias("line"), F.regexp_replace("l", "\r\\z", "").alias("l")
    )
    return lines.select("root", "path", "line", F.explode(_kinds(F.col("l"))).alias("h")).select(
        "root", "path", F.col("line").cast("bigint").alias("line"), F.col("h.rule").alias("rule"), F.col("h.kind").alias("kind")
    )


def secret_report_pieces(findings: DataFrame) -> DataFrame:
    """Op 35: (root, seq, path, text) of the warning text of each root with findings.

    One piece per finding, ordered by path, line and rule (a piece's path is the
    file's path, then line and rule number in sortable form), between the opening
    and the closing line.
    """
    from .joins import freeze

    place = F.format_string("%012d %06d", F.col("line").cast("bigint"), F.col("rule").cast("bigint"))
    entry = F.concat(F.lit("  "), F.array_join("path", "/"), F.lit(":"), F.col("line").cast("string"), F.lit(" \u2014 "), F.col("kind"), F.lit("\n"))
    # findings are few (bounded by the credentials present): materialise once, reuse for counts and text
    rows = freeze(
        findings.select("root", F.lit(1).alias("seq"), F.concat("path", F.array(F.lit(""), place)).alias("path"), entry.alias("text"))
    )
    n = F.col("findings")
    counts = rows.groupBy("root").agg(F.count("*").alias("findings"))
    none = F.array().cast("array<string>")
    head = F.concat(
        F.lit("Warning: "), n.cast("string"), F.lit(" potential secret"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")),
        F.lit(" detected in content about to be exported:\n"),
    )
    tail = F.lit("Review the files or exclude them with --exclude. Use --no-secret-scan to disable this warning.\n")
    return (
        counts.select("root", F.lit(0).alias("seq"), none.alias("path"), head.alias("text"))
        .unionByName(rows)
        .unionByName(counts.select("root", F.lit(2).alias("seq"), none.alias("path"), tail.alias("text")))
    )


def secret_report(findings: DataFrame) -> DataFrame:
    """(root, findings, report): the warning text of each root with findings as one string."""
    from .ordering import concatenated

    pieces = secret_report_pieces(findings)
    counts = pieces.filter("seq = 1").groupBy("root").agg(F.count("*").cast("bigint").alias("findings"))
    return counts.join(concatenated(pieces, "report"), "root")
