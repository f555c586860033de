"""Transport, authentication and fingerprint drift as findings; references and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tls_order, version_change

OLD_TLS = ("TLSv1.0", "TLSv1.1", "SSLv3")


def _each(rows: DataFrame, keys: list[str], cases: list[tuple[str, str, Column]]) -> DataFrame:
    """One row for each case (issue, severity, condition) that holds; a null condition does not."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(a).alias("issue"), F.lit(b).alias("severity"))) for a, b, c in cases]))
    return rows.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def transport_findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """R111 from transport, tls_version (null or plain: none), cert_valid, self_signed and hsts; stdio is left out."""
    tls = F.col("tls_version")
    secure = tls.isNotNull() & ~tls.isin("plain", "error")
    return _each(
        rows.where("transport <> 'stdio'"),
        keys,
        [
            ("plain HTTP", "high", tls.isNull() | (tls == "plain")),
            ("TLS error", "high", tls == "error"),
            ("outdated TLS", "critical", tls.isin(*OLD_TLS)),
            ("invalid certificate", "high", secure & ~F.col("cert_valid")),
            ("self-signed certificate", "medium", secure & F.col("self_signed")),
            ("no HSTS", "medium", secure & ~F.col("hsts")),
        ],
    )


#: Fixed value: the first profile without sessions.
STATELESS_PROFILE = "2026-07-28"


def auth_findings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """R112: checks that failed, and a session under a profile that has none. A null is a check that was not made.

    ``rows`` has pkce, iss, app_type, and uses_session and protocol_version where sessions were looked at.
    """
    if "uses_session" not in rows.columns:
        rows = rows.withColumns({"uses_session": F.lit(None).cast("boolean"), "protocol_version": F.lit(None).cast("string")})
    return _each(
        rows,
        keys,
        [
            ("no PKCE", "high", F.col("pkce") == F.lit(False)),
            ("no issuer check", "high", F.col("iss") == F.lit(False)),
            ("no application type", "medium", F.col("app_type") == F.lit(False)),
            ("session in a stateless profile", "medium", F.col("uses_session") & (F.col("protocol_version") >= STATELESS_PROFILE)),
        ],
    )


def fingerprint_drift(rows: DataFrame) -> DataFrame:
    """R110: every fingerprint (server_id, seen, and what it holds) against the one before it of the same server."""
    order = Window.partitionBy("server_id").orderBy("seen")
    names = ("server_version", "protocol_version", "endpoint", "tool_hash", "tls_version")
    rows = rows.select("server_id", "seen", *names, *[F.lag(c).over(order).alias(f"old_{c}") for c in names], F.row_number().over(order).alias("nth"))
    later = F.col("nth") > 1
    differs = lambda c: later & ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    change = version_change("old_server_version", "server_version")
    return _each(
        rows,
        ["server_id", "seen"],
        [
            ("first scan", "medium", F.col("nth") == 1),
            ("version rollback", "critical", differs("server_version") & (change == "rollback")),
            ("major upgrade", "high", differs("server_version") & (change == "major_upgrade")),
            ("tool list changed", "high", differs("tool_hash")),
            ("TLS downgrade", "high", later & (tls_order("tls_version") < tls_order("old_tls_version"))),
            ("endpoint changed", "high", differs("endpoint")),
            ("protocol changed", "medium", differs("protocol_version")),
        ],
    )


def migration_issues(rows: DataFrame, profile: str = "2025-06") -> DataFrame:
    """Targets that use sessions under an older protocol than the profile."""
    return rows.where(F.col("uses_session") & ~F.startswith("protocol_version", F.lit(profile))).select("target", F.lit("session").alias("issue"))


def reference_kind(ref: str = "ref") -> Column:
    """npm, pypi, github or null (a local path) of a package reference."""
    c = F.trim(F.col(ref))
    return (
        F.when(c.startswith("npm:"), "npm")
        .when(c.startswith("pip:") | c.startswith("pypi:"), "pypi")
        .when(c.startswith("gh:") | c.rlike(r"^https?://github\.com/[^/]+/[^/]+") | c.endswith(".git") | c.startswith("git@"), "github")
    )


def launched_package(target: str = "target") -> Column:
    """npm:name or pip:name of a launch command; null for other launchers. Flags are skipped and versions cut."""
    parts = F.filter(F.split(F.trim(F.col(target)), r"\s+"), lambda p: p != "")
    runner = F.regexp_replace(F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"^.*[/\\]", ""), r"\.exe$", "")
    kind = F.when(runner.isin("npx", "bunx", "pnpx"), "npm").when(runner.isin("uvx", "pipx"), "pip")
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.startswith("-") & ~p.isin("run", "dlx", "exec"))
    return F.concat(kind, F.lit(":"), F.regexp_extract(F.get(rest, F.lit(0)), r"^(@[^/]+/[^@]+|[^@]+)", 1))


def triage(findings: DataFrame) -> DataFrame:
    """A class for the known kinds of findings (rule_id, server, tool): the first rule that fits; others open."""
    rule, server, tool = F.col("rule_id"), F.col("server"), F.col("tool")
    kind = (
        F.when((rule == "R105") & server.contains("filesystem") & (tool.contains("read_file") | tool.contains("write_file")), "false_positive")
        .when(rule == "R101", "needs_review")
        .when((rule == "R001") & server.contains("puppeteer"), "true_positive")
        .otherwise("open")
    )
    return findings.withColumn("class", kind)


def typosquat_findings(near: DataFrame) -> DataFrame:
    """T001 from names near a known one."""
    return near.select("name", F.lit("T001").alias("rule_id"), F.lit("high").alias("severity"), F.concat(F.lit("close to "), "suspected").alias("title"))
