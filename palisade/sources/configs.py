"""Agent configuration files: which files they are, what they launch and allow, and what is wrong with that."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import unicode_pattern
from .manifests import outside

#: Names of configuration files; those with a folder match the end of a path.
CONFIG_NAMES = (
    "claude_desktop_config.json", ".mcp.json", "mcp.json", ".claude/settings.json", ".claude/settings.local.json",
    ".cursor/mcp.json", ".vscode/mcp.json", ".gemini/settings.json", ".windsurf/mcp.json",
)
#: Fixed values: (rule, severity, pattern) of commands.
COMMANDS = (
    ("M001", "critical", r"\b(?:curl|wget)\b[^\n|]*\|\s*(?:ba)?sh\b"),
    (
        "M002",
        "critical",
        r"(?i)base64\s+(?:-d|--decode|-D)\b[^\n]*\|\s*(?:ba)?sh\b"
        r"|\|\s*base64\s+(?:-d|--decode)\b[^\n]*\|\s*(?:ba)?sh\b"
        r"|(?:eval|exec)\b[^\n]*base64\s+(?:-d|--decode)",
    ),
    (
        "M003",
        "critical",
        r"(?i)(?:~/?\.ssh/|/\.ssh/id_|\.aws/credentials|\.aws/config|\.env\b|\.npmrc|\.config/gh/|\.docker/config\.json|\.netrc)[^\n]*"
        r"(?:curl|wget|\bnc\b|/dev/tcp|invoke-?webrequest|\biwr\b)"
        r"|(?:curl|wget|\bnc\b|/dev/tcp|invoke-?webrequest|\biwr\b)[^\n]*"
        r"(?:~/?\.ssh/|/\.ssh/id_|\.aws/credentials|\.env\b|\.npmrc|\.config/gh/|\.netrc)",
    ),
    (
        "M004",
        "high",
        r"(?i)(?:curl|wget|invoke-?webrequest|\biwr\b)\b[^\n]*\b"
        r"(?:pastebin\.com|webhook\.site|requestbin|ngrok\.io|burpcollaborator|interactsh|oast\.|\.onion)\b",
    ),
    (
        "M005",
        "critical",
        r"(?i)/dev/tcp/\d|\b(?:ba)?sh\s+-i\b[^\n]*(?:/dev/tcp|\bnc\b|>&)|\bnc\b[^\n]*\s-e\b"
        r"|mkfifo\b[^\n]*\|[^\n]*\b(?:ba)?sh\b|python[0-9.]*\b[^\n]*socket[^\n]*subprocess",
    ),
    (
        "M007",
        "high",
        r"(?i)\brm\s+-[a-z]*r[a-z]*f\b|\bmkfs\b|\bshutdown\b|\breboot\b|\bdd\s+if=|:\(\)\s*\{|\bchmod\s+-R\s+777\b",
    ),
)
#: Permissions that allow a whole kind of tool; launchers of packages, and their words that are no package.
BROAD_PERMISSION = r"(?i)^(?:Bash\(\*\)|Bash\(:\*\)|.*\(\*\)|\*)$"
RUNNERS = ("npx", "npm", "pnpm", "yarn", "bunx", "uvx", "pipx", "uv")
RUNNER_WORDS = ("exec", "run", "tool", "dlx")


def is_agent_config(path: str = "path") -> Column:
    """Whether a path is that of an agent's configuration, outside of folders of others.

    Spark's file sources pass over names that begin with a dot: the files come as a table (path, content).
    """
    ends = "|".join(re.escape(x) for x in CONFIG_NAMES if "/" in x)
    names = "|".join(re.escape(x) for x in CONFIG_NAMES if "/" not in x)
    plain = F.replace(F.col(path), F.lit("\\"), F.lit("/"))
    own = outside(F.col(path), ("node_modules", ".git", ".venv", "venv", "__pycache__", "dist", "build"))
    return plain.rlike(rf"(?:^|/)(?:{names})$|(?:{ends})$") & own


def _texts(values) -> list[str]:
    return [x for x in values if isinstance(x, str)]


def _entries(data: dict) -> Iterator[tuple]:
    """(kind, place, text, launcher, arguments) of the servers, hooks and permissions of one configuration."""
    servers = data.get("mcpServers") or data.get("servers")
    for name, spec in (servers if isinstance(servers, dict) else {}).items():
        if isinstance(spec, dict):
            launcher = spec["command"] if isinstance(spec.get("command"), str) else None
            args = _texts(spec["args"]) if isinstance(spec.get("args"), list) else []
            env = _texts(spec["env"].values()) if isinstance(spec.get("env"), dict) else []
            yield "command", f"mcpServers.{name}", " ".join([*([] if launcher is None else [launcher]), *args, *env]), launcher, args
    hooks = data.get("hooks")
    for event, entry in (hooks if isinstance(hooks, dict) else {}).items():
        open_nodes = [entry]
        while open_nodes:
            node = open_nodes.pop()
            if isinstance(node, dict):
                if isinstance(node.get("command"), str):
                    yield "command", f"hooks.{event}", node["command"], None, []
                node = list(node.values())
            open_nodes += [x for x in node if isinstance(x, (dict, list))]
    allowed = data.get("permissions")
    if isinstance(allowed, dict):
        yield "mode", "permissions.defaultMode", str(allowed.get("defaultMode", "")), None, []
        rules = allowed.get("allow")
        for rule in _texts(rules if isinstance(rules, list) else []):
            yield "permission", "permissions.allow", rule, None, []


def config_entries(files: DataFrame) -> DataFrame:
    """path, kind (command, permission or mode), place, text, launcher, args of configurations (path, content).

    Text that is no JSON object, or an entry of another shape, gives nothing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in batch.itertuples(index=False, name=None):
                try:
                    data = json.loads(content or "")
                except ValueError:
                    continue
                if isinstance(data, dict):
                    rows += [(path, *x) for x in _entries(data) if x[3] is None or isinstance(x[3], str)]
            yield pd.DataFrame(rows, columns=["path", "kind", "place", "text", "launcher", "args"])

    return files.select("path", "content").mapInPandas(run, "path string, kind string, place string, text string, launcher string, args array<string>")


def runner_package(launcher: str = "launcher", args: str = "args") -> Column:
    """The package that a launcher of packages runs, without its version: its first argument that is no flag; null for other commands."""
    runner = F.regexp_replace(F.regexp_replace(F.lower(F.col(launcher)), r"^.*/", ""), r"\.exe$", "")
    first = F.get(F.filter(F.col(args), lambda x: ~x.startswith("-") & ~x.isin(*RUNNER_WORDS)), F.lit(0))
    return F.when(runner.isin(*RUNNERS), F.nullif(F.regexp_extract(first, r"^(@[^/]*(?:/[^@]+)?|[^@]+)", 1), F.lit("")))


def config_findings(files: DataFrame) -> DataFrame:
    """M001 to M007: path, rule_id, severity, place and evidence of commands and permissions that no configuration should hold."""
    rows = config_entries(files)
    finding = lambda rule, severity: F.struct(F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"))
    command = F.col("kind") == "command"
    cases = [F.when(command & F.col("text").rlike(unicode_pattern(p, False)), finding(r, s)) for r, s, p in COMMANDS]
    broad = (F.col("kind") == "permission") & F.trim("text").rlike(BROAD_PERMISSION)
    broad = broad | ((F.col("kind") == "mode") & (F.lower("text") == "bypasspermissions"))
    hits = F.array_compact(F.array(*cases, F.when(broad, finding("M006", "high"))))
    return rows.select("path", F.explode(hits).alias("h"), "place", F.substring("text", 1, 200).alias("evidence")).select("path", "h.*", "place", "evidence")
