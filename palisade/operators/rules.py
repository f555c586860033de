"""Detection rules over text surfaces and tools, as Column expressions where their semantics allow.

A pattern rule takes rows with a column ``text`` and gives one row per match.
"""

from __future__ import annotations

import base64
import itertools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import entropy, name_parts, printable_share, unicode_pattern

#: Names that are reported as they are.
DANGEROUS_NAMES = (
    "eval", "exec", "system", "shell", "bash", "cmd", "subprocess", "os", "rm", "del", "delete", "drop", "truncate",
    "kill", "shutdown", "reboot", "sudo", "su", "chmod", "chown", "format", "fdisk",
)

#: Hidden code points.
HIDDEN_POINTS = (
    0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064,
    0xFEFF, 0xFFF9, 0xFFFA, 0xFFFB,
)

#: Fixed values: (label, severity, pattern) of prompt injections; case is ignored.
INJECTIONS = (
    ("ignore previous instructions", "critical", r"ignore\s+(?:all\s+)?(?:previous|prior|above)\s+(?:instructions?|prompts?|directives?)"),
    ("you must / you are now", "high",
     r"you\s+must\s+(?:ignore|disregard|forget|reveal|leak|exfiltrat|comply|obey|never|always|not\s+(?:tell|mention|reveal|follow))"
     r"|you\s+are\s+now\s+(?:a\b|an\b|in\s+\w+\s+mode|going\s+to|allowed|able\s+to|free|unrestricted|jailbroken|dan\b)"
     r"|you\s+are\s+(?:required|compelled)\s+to"),
    ("system: directive injection", "critical", r"system\s*:\s*(?!hostname|time|info|status)"),
    ("role-playing / pretend directive", "high", r"(?:as\s+an?\s+AI|pretend\s+(?:you\s+are|to\s+be))"),
    ("IM start/end delimiter injection", "critical", r"<\|im_start\|>|<\|im_end\|>|<\/?\s*\|?\s*im_\w+\s*\|?\s*>?"),
    ("Llama instruction tag injection", "high", r"\[/?INST\]|<<SYS>>|\[/?SYS\]"),
    ("don't follow your instructions", "high", r"do\s+not\s+(?:follow|obey|listen|trust)\s+(?:your|the)\s+(?:instructions?|system|prompt)"),
    ("override system prompt", "critical", r"(?:override|overwrite|replace)\s+(?:the\s+)?(?:system\s+)?(?:prompt|instructions?)"),
    ("jailbreak role assignment", "critical", r"you\s+are\s+a\s+(?:helpful\s+)?(?:jailbreak|exploit|hacker|pentest)"),
    ("disregard safety guidelines", "critical",
     r"disregard\s+(?:all\s+)?(?:safety|security|ethical|content)\s+(?:guidelines?|policies?|restrictions?)"),
)

#: Hidden or deceptive markup.
HIDDEN_MARKUP = (
    ("hidden element", "high",
     r'<(?:span|div|p|a|font|label)\b[^>]*\b(?:style\s*=\s*"[^"]*(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0'
     r'|font-size\s*:\s*0|color\s*:\s*transparent|width\s*:\s*0|height\s*:\s*0)[^"]*")[^>]*>'),
    ("deceptive link", "high", r'<a\b[^>]*\bhref\s*=\s*"[^"]*"[^>]*>\s*(?:click\s*here|here|more|\.{2,}|.{0,2})\s*</a>'),
    ("zero font", "high", r"<font\s+size\s*=\s*[\"']?\s*0\s*[\"']?[^>]*>"),
    ("deceptive markdown link", "high", r"\[(?:.{0,2}|click here|here|more)\]\([^)]+\)"),
)

#: Known secret formats; case counts.
SECRETS = (
    ("OpenAI API key", "critical", r"sk-[a-zA-Z0-9]{32,}"),
    ("OpenAI project key", "critical", r"sk-proj-[a-zA-Z0-9]{32,}"),
    ("GitHub personal access token", "critical", r"ghp_[a-zA-Z0-9]{36}"),
    ("GitHub OAuth token", "critical", r"gho_[a-zA-Z0-9]{36}"),
    ("Slack token", "critical", r"xox[bpras]-[a-zA-Z0-9-]+"),
    ("AWS access key ID", "critical", r"AKIA[0-9A-Z]{16}"),
    ("JWT token", "critical", r"eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}"),
    ("Google API key", "critical", r"AIza[0-9A-Za-z_-]{35}"),
    ("Database connection string", "critical", r"(?:mongodb|postgresql|mysql|redis)://[^\s]{10,}"),
    ("GitHub fine-grained token", "critical", r"github_pat_[a-zA-Z0-9_]{36,}"),
    ("HuggingFace token", "critical", r"hf_[a-zA-Z0-9]{34}"),
    ("Teleport token", "critical", r"tpt_[a-zA-Z0-9]{32,}"),
    ("Generic API key prefix", "critical", r"key-[a-zA-Z0-9]{32,}"),
    ("Generic secret prefix", "critical", r"secret-[a-zA-Z0-9]{32,}"),
    ("Generic token prefix", "critical", r"token-[a-zA-Z0-9]{32,}"),
)
#: Long runs, tokens that look like credentials, what is stripped from them, and the entropy that makes a secret.
TOKEN, TOKEN_EDGES = r"^[A-Za-z0-9_\-+/=.]{16,}$", "\"'`,;:{}[]()"
GENERIC_BASE64 = r"[a-zA-Z0-9+/]{40,}={0,2}"
GENERIC_ENTROPY = 4.5

#: Supply chain indicators; case counts but for the code execution one.
SUPPLY_CHAIN = (
    ("curl-to-shell pipe", "high", r"curl\s+.*\|.*(?:bash|sh|zsh)"),
    ("wget-to-shell pipe", "high", r"wget\s+.*-O\s*-\s*\|.*(?:bash|sh)"),
    ("pip install", "medium", r"\b(?:pip|pip3)\s+install\b"),
    ("npm/yarn install", "medium", r"\b(?:npm|yarn|pnpm)\s+(?:install|add)\b"),
    ("cargo install", "medium", r"\bcargo\s+(?:install|add)\b"),
    ("dynamic import", "medium", r"\bimportlib\.(?:import_module|load_source)\b"),
    ("dynamic code execution", "high", r"(?i)\b(?:eval|exec|__import__)\s*\("),
    ("Node.js require()", "medium", r"\brequire\s*\(\s*[\"']"),
    ("npx execution", "high", r"\bnpx\s+"),
    ("other pkg manager", "low", r"\b(?:gem|cpan|composer)\s+install\b"),
)
INSTALL_LABELS = ("pip install", "npm/yarn install", "npx execution")
#: Words of setup notes.
INSTALL_WORDS = ("setup", "install the server", "getting started", "quick start", "configuration", "usage")
INSTALL_DOCS = "|".join(INSTALL_WORDS)
#: Runs that are decoded.
RUNS = {
    "base64": r"(?:^|[^a-zA-Z0-9+/=])([A-Za-z0-9+/]{40,}={0,2})(?:[^a-zA-Z0-9+/=]|$)",
    "hex": r"(?:0x)?([0-9a-fA-F]{32,})",
}

#: Fixed values: (name side, description side, what the name says, what the description says); case is ignored.
SCOPES = (
    (r"\b(?:file|filesystem|read_file|write_file|fs|disk)\b", r"\b(?:network|internet|http|https|api|remote|fetch|url|curl|socket)\b", "file", "network"),
    (r"\b(?:db|database|sql|nosql|query|table)\b", r"\b(?:file|filesystem|disk|rm\b|delete|remove\b|exec|spawn|shell)\b", "database", "filesystem/shell"),
    (r"\b(?:read|get|fetch|list|search|query)\b", r"\b(?:write|delete|create|update|exec|run|shell|spawn|sudo)\b", "read-only", "write/exec"),
    (r"\b(?:crypto|wallet|key|sign|encrypt|decrypt)\b", r"\b(?:network|internet|http|url|api|remote|fetch|send|transfer)\b", "crypto", "network"),
    (r"\b(?:browser|tab|window|dom|render|html)\b", r"\b(?:file|filesystem|disk|process|exec|spawn)\b", "browser", "system"),
    (r"\b(?:notify|alert|message|chat|send)\b", r"\b(?:exec|run|shell|spawn|sudo|admin)\b", "notification", "execution"),
    (r"\b(?:config|setting|env|environment)\b", r"\b(?:exec|spawn|shell|script|deploy|run)\b", "configuration", "remote-exec"),
    (r"\b(?:search|find|lookup|locate)\b", r"\b(?:write|create|delete|update|modify|remove)\b", "search", "write"),
    (r"\b(?:log|audit|monitor|track|observe)\b", r"\b(?:exec|run|cmd|command|shell)\b", "logging", "command execution"),
    (r"\b(?:cache|temp|tmp|scratch)\b", r"\b(?:download|fetch|pull|install|load)\b", "cache", "download"),
)
#: Words of tools that stand between others.
BRIDGES = (
    "bridge", "proxy", "adapter", "wrapper", "gateway", "facade", "middleware", "connector", "relay", "translator",
    "integration", "orchestrator", "manager", "handler", "provider", "service", "client", "interface",
)

#: Traversal language, the words that make it protective, and what negates those.
TRAVERSAL = (r"\.\.[/\\]", r"\bpath\s*(?:traversal|injection|bypass|escape)\b", r"\b(?:symlink|symbolic\s*link)\b")
PROTECTIVE = r"\b(?:prevent|protect|reject|den(?:y|ie)|block|sanitiz|validat|disallow|forbid|(?:not?|never)\s+follow)\w*"
NEGATOR = r"\b(?:not|no|never|doesn'?t|does\s+not|won'?t|without)\s*$"

#: Capability patterns, over " name description " in lower case with - as _.
_W = r"(?:^|[^a-z])"
CAPABILITIES = {
    "code_exec": rf"{_W}(?:execute|exec|eval|shell|bash|powershell|subprocess|spawn|repl)(?![a-z])"
    rf"|{_W}run_?(?:command|code|shell|script)|{_W}shell_?exec",
    "browser_control": rf"{_W}(?:puppeteer|playwright|selenium|webdriver|screenshot)"
    rf"|(?:browser|page)_(?:navigate|goto|click|type|screenshot|evaluate|snapshot|hover|drag|select|fill)|{_W}navigate_to",
    "db_write": rf"{_W}(?:sql|insert|update|upsert|drop_?table|execute_?sql|database|db_?(?:write|exec|query)|cursor\.)",
    "fs_write": rf"{_W}(?:write|create_?file|delete|remove|unlink|edit_?file|move_?file|rename|mkdir|rmdir|save_?file|upload"
    r"|put_?file|append_?file|patch_?file)",
    "secret_access": rf"{_W}(?:secret|credential|password|api_?key|access_?token|private_?key|vault|keychain|\.env\b|keyring)",
    "net_egress": rf"{_W}(?:fetch|http|https|request|download|url|webhook|send_?(?:email|message)|post_?to|curl|wget|api_?call|outbound)",
    "fs_read": rf"{_W}(?:read_?file|read_?directory|list_?(?:files|directory)|cat_?file|get_?file|open_?file|load_?file|stat_?file|glob)",
}


#: What every match of these patterns holds: one of the tuples, whole. Injections in text in one case, as ``folded`` gives it.
SECRET_HOLDS = (
    ("-", "sk-"), ("-", "key-"), ("-", "secret-"), ("-", "token-"), ("-", "xox"), ("_", "ghp_"), ("_", "gho_"), ("_", "github_pat_"), ("_", "hf_"), ("_", "tpt_"),
    ("AKIA",), ("AIza",), ("eyJ",), ("://", "mongodb://"), ("://", "postgresql://"), ("://", "mysql://"), ("://", "redis://"),
)
INJECTION_HOLDS = (
    ("ignore",), ("you", "must"), ("you", "are"), ("system", ":"), ("pretend",), ("im_",), ("inst]",), ("sys]",), ("<<sys>>",), ("do", "not", "follow"), ("do", "not", "obey"),
    ("do", "not", "listen"), ("do", "not", "trust"), ("override",), ("overwrite",), ("replace",), ("disregard",),
)
#: The one short injection: its words are in most texts, so it is looked for as it is.
INJECTION_WORDS = r"(?U)as\s+an?\s+ai"
#: What matches begin with, as a class that is quick to rule out; where case is ignored, \u0130 and \u0131 are an i, and \u017f is an s.
SECRET_STARTS = "(?=[sgxAemprhtk][efhiopkyIK])"
INJECTION_STARTS = "(?=[iI\u0130\u0131yYsS\u017faApPdDoOrR<\\[])"


def folded(text: str | Column) -> Column:
    """The text in lower case, with the letters beyond ASCII that patterns without case take for ASCII ones as these."""
    c = F.col(text) if isinstance(text, str) else text
    for x, y in (("\u0130", "i"), ("\u0131", "i"), ("\u017f", "s")):
        c = F.replace(c, F.lit(x), F.lit(y))
    return F.lower(c)


def holds(text: str | Column, wanted) -> Column:
    """Whether a text holds all of one of the tuples; what several in a row begin with is looked for once."""
    c = F.col(text) if isinstance(text, str) else text
    find = lambda x: F.contains(c, F.lit(x))
    out = F.lit(False)
    for first, rest in itertools.groupby(wanted, key=lambda w: w[0]):
        rest = [w[1:] for w in rest]
        out = out | (find(first) if () in rest else find(first) & holds(text, rest))
    return out


def has_secret(text: str = "text") -> Column:
    """Whether a pattern of ``SECRETS`` is in a text."""
    every = unicode_pattern("|".join(f"(?:{p})" for _, _, p in SECRETS), False)
    return holds(text, SECRET_HOLDS) & F.col(text).rlike(f"{SECRET_STARTS}(?:{every})")


def has_injection(text: str = "text", lowered: str | None = None) -> Column:
    """Whether a pattern of ``INJECTIONS`` is in a text; ``lowered`` is a column that has it folded, if there is one."""
    every = unicode_pattern("|".join(f"(?:{p})" for _, _, p in INJECTIONS))
    may = lambda x: holds(x, INJECTION_HOLDS) | x.rlike(INJECTION_WORDS)
    # As the element of an array a text is folded once, not for each part that is looked for.
    held = F.exists(F.array(folded(text)), may) if lowered is None else may(F.col(lowered))
    return held & F.col(text).rlike(f"{INJECTION_STARTS}(?:{every})")


def dangerous_names(tools: DataFrame) -> DataFrame:
    """R001: tools of a dangerous name."""
    return tools.where(F.lower("name").isin(*DANGEROUS_NAMES)).select("server", "name", F.lit("critical").alias("severity"))


def hidden_points(texts: DataFrame, keys: list[str], in_name: Column | None = None) -> DataFrame:
    """R101: one row per hidden code point: its position and number."""
    points = "".join(chr(x) for x in HIDDEN_POINTS)
    some = texts.where(F.col("text").rlike(f"[{points}]"))
    found = some.select(*keys, F.posexplode(F.split("text", "")).alias("position", "c")).where(F.col("c").rlike(f"[{points}]"))
    code = F.conv(F.hex(F.encode("c", "UTF-16BE")), 16, 10).cast("int")
    severity = F.when(in_name, "critical").otherwise("high") if in_name is not None else F.lit("high")
    return found.select(*keys, "position", code.alias("code_point"), severity.alias("severity"))


def pattern_matches(texts: DataFrame, keys: list[str], patterns, ignore_case: bool = True) -> DataFrame:
    """One row per match of each (label, severity, pattern) in each text."""

    def matches(label: str, severity: str, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(unicode_pattern(pattern, ignore_case)), F.lit(0))
        return F.transform(
            found, lambda m: F.struct(F.lit(label).alias("label"), F.lit(severity).alias("severity"), m.alias("matched"))
        )

    every = F.explode(F.flatten(F.array(*[matches(*x) for x in patterns]))).alias("m")
    # One quick look for any of the patterns keeps most texts from being searched ten times over.
    any_of = "|".join(f"(?:{p})" for _, _, p in patterns)
    if patterns is SECRETS and not ignore_case:
        some = texts.where(has_secret())
    elif patterns is INJECTIONS and ignore_case:
        some = texts.where(has_injection())
    else:
        some = texts.where(F.col("text").rlike(unicode_pattern(any_of, ignore_case)))
    return some.select(*keys, every).select(*keys, "m.*")


def injections(texts: DataFrame, keys: list[str]) -> DataFrame:
    """R102."""
    return pattern_matches(texts, keys, INJECTIONS)


def encoded_payloads(texts: DataFrame, keys: list[str]) -> DataFrame:
    """R103: base64 runs of 40 and hex runs of 32 characters or more, with or without 0x, high where they decode to readable text.

    A base64 run stands between other characters, and loses its padding before it is decoded, so only runs of whole
    groups decode; other runs stay medium. A hex run is reported only if readable.
    """
    readable = re.compile(rb"[\x09-\x0d\x20-\x7e]")

    def decoded(run: str, kind: str) -> bool:
        try:
            raw = base64.b64decode(run.rstrip("="), validate=True) if kind == "base64" else bytes.fromhex(run)
        except ValueError:
            return False
        return len(readable.findall(raw)) / max(len(raw), 1) > 0.8

    @F.pandas_udf("boolean")
    def is_readable(run: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([decoded(r, k) for r, k in zip(run, kind, strict=True)])

    def part(kind: str, pattern: str) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("run")))

    parts = [part(*x) for x in RUNS.items()]
    some = texts.where(F.col("text").rlike("|".join(RUNS.values())))
    found = some.select(*keys, F.explode(F.flatten(F.array(*parts))).alias("m")).select(*keys, "m.*")
    found = found.withColumn("readable", is_readable("run", "kind")).where((F.col("kind") == "base64") | F.col("readable"))
    return found.select(*keys, "kind", "run", F.when(F.col("readable"), "high").otherwise("medium").alias("severity"))


def hidden_markup(texts: DataFrame, keys: list[str]) -> DataFrame:
    """R104."""
    return pattern_matches(texts, keys, HIDDEN_MARKUP)


def scope_mismatches(tools: DataFrame) -> DataFrame:
    """R105: the name says one scope, the description another; descriptions of a bridge that use two words of the name are left out."""
    description = F.coalesce("description", F.lit(""))
    said = F.size(F.filter(name_parts("name"), lambda w: F.contains(F.lower(description), w))) >= 2
    bridge = F.exists(F.array(*[F.lit(b) for b in BRIDGES]), lambda b: F.contains(F.lower(description), b))
    hits = F.array_compact(
        F.array(*[F.when(F.col("name").rlike(unicode_pattern(a)) & description.rlike(unicode_pattern(b)), f"{x} -> {y}") for a, b, x, y in SCOPES])
    )
    return tools.where(~(bridge & said)).select("server", "name", F.explode(hits).alias("mismatch"))


def secrets(texts: DataFrame, keys: list[str]) -> DataFrame:
    """R106: known formats, long base64-like runs and tokens like credentials of high entropy; a value once for each text, in that order."""
    known = pattern_matches(texts, keys, SECRETS, ignore_case=False).withColumn("stage", F.lit(0))
    generic = pattern_matches(texts, keys, (("Generic base64-like", "high", GENERIC_BASE64),), ignore_case=False)
    generic = generic.where(entropy("matched") > GENERIC_ENTROPY).withColumn("stage", F.lit(1))
    # Only runs that are long enough with their edges are cut out and trimmed.
    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"\S{16,}"), F.lit(0)), lambda t: F.btrim(t, F.lit(TOKEN_EDGES)))
    tokens = texts.select(*keys, F.explode(F.filter(tokens, lambda t: t.rlike(TOKEN))).alias("matched"))
    tokens = tokens.where(entropy("matched") > GENERIC_ENTROPY)
    tokens = tokens.select(*keys, F.lit("High-entropy token").alias("label"), F.lit("high").alias("severity"), "matched", F.lit(2).alias("stage"))
    every = known.unionByName(generic).unionByName(tokens)
    first = every.groupBy(*keys, "matched").agg(F.min(F.struct("stage", "label", "severity")).alias("m"))
    return first.select(*keys, "matched", "m.label", "m.severity")


def supply_chain(texts: DataFrame, keys: list[str]) -> DataFrame:
    """R108, without what reads like the setup notes of the tool itself."""
    docs = F.lower("text").rlike(INSTALL_DOCS)
    found = pattern_matches(texts.withColumn("_docs", docs), [*keys, "_docs"], SUPPLY_CHAIN, ignore_case=False)
    return found.where(~(F.col("_docs") & F.col("label").isin(*INSTALL_LABELS))).drop("_docs")


def traversals(texts: DataFrame, keys: list[str]) -> DataFrame:
    """R113: traversal language that no protective word stands before within 60 characters, or one that is negated."""
    patterns = [re.compile(p, re.I) for p in TRAVERSAL]
    guard, negator = re.compile(PROTECTIVE, re.I), re.compile(NEGATOR, re.I)

    def matches(text: str | None) -> list[str]:
        out = []
        for m in (m for p in patterns for m in p.finditer(text or "")):
            before = text[max(0, m.start() - 60) : m.start()]
            g = guard.search(before)
            if not g or negator.search(before[: g.start()].rstrip()):
                out.append(m.group())
        return out

    @F.pandas_udf("array<string>")
    def found(text: pd.Series) -> pd.Series:
        return text.map(matches)

    some = texts.where(F.col("text").rlike(unicode_pattern("|".join(TRAVERSAL))))
    return some.select(*keys, F.explode(found("text")).alias("matched"), F.lit("high").alias("severity"))


def response_flags(texts: DataFrame, keys: list[str]) -> DataFrame:
    """What a captured response holds: URLs, scripts, secrets, injections."""
    # Most texts hold none of the fixed parts of a pattern, which are found much faster than it.
    texts = texts.withColumn("_folded", folded("text"))
    return texts.select(
        *keys,
        (F.contains("text", F.lit("://")) & F.col("text").rlike(unicode_pattern(r"https?://"))).alias("has_url"),
        (holds("_folded", (("<script",), ("javascript:",))) & F.col("text").rlike(unicode_pattern(r"<script\b|javascript:"))).alias("has_script"),
        has_secret().alias("has_secret"),
        has_injection(lowered="_folded").alias("has_injection"),
    )


def capability_tags(name: str = "name", description: str = "description") -> Column:
    """Capabilities of a tool; reading files does not count beside writing them; pure_compute for none."""
    text = F.regexp_replace(F.lower(F.concat(F.lit(" "), F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")), F.lit(" "))), "-", "_")
    tags = F.array_compact(F.array(*[F.when(text.rlike(p), c) for c, p in CAPABILITIES.items()]))
    tags = F.when(F.array_contains(tags, "fs_write"), F.array_remove(tags, "fs_read")).otherwise(tags)
    return F.when(F.size(tags) == 0, F.array(F.lit("pure_compute"))).otherwise(tags)


def text_profile(texts: DataFrame, keys: list[str]) -> DataFrame:
    return texts.select(*keys, F.round(printable_share("text"), 6).alias("printable"))
