"""Findings across servers: collisions, look-alikes, chains, similarity and distance joins."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import unicode_pattern

#: What reads data and what sends it; what writes; keywords of a capability.
READS = r"\b(?:read|get|fetch|download|retrieve|extract|access)\b.*\b(?:file|data|secret|key|token|password|email)\b"
SENDS = r"\b(?:send|post|upload|publish|forward|share|transmit|exfiltrate)\b"
WRITES = r"\b(?:write|create|delete|remove|modify|update|exec|run|spawn|shell|sudo)\b"
CAPABILITIES = {
    "file_read": r"\b(?:read_file|get_file|read.*file|file.*read)\b",
    "file_write": r"\b(?:write_file|create_file|save.*file|file.*write|edit_file)\b",
    "web_fetch": r"\b(?:fetch_url|http_get|web_request|curl|fetch.*url|url.*fetch)\b",
    "shell_exec": r"\b(?:exec|eval|shell|bash|cmd|subprocess|command)\b",
    "database": r"\b(?:sql|query|database|postgres|mysql|nosql|table)\b",
}


def tool_text() -> Column:
    return F.concat_ws(" ", "name", "description")


def name_collisions(tools: DataFrame) -> DataFrame:
    """Names (lower case) that two tools or more have, with how many tools and servers."""
    return (
        tools.groupBy(F.lower("name").alias("name"))
        .agg(F.count("*").alias("tools"), F.count_distinct("server").alias("servers"))
        .where("tools >= 2")
    )


#: Letters told apart by the count filter; the others count together.
LETTERS = "abcdefghijklmnopqrstuvwxyz_"


def _least_shared(sizes: Column, threshold: float) -> Column:
    """How many pairs of neighbouring letters two names of together so many letters share at least, if their ratio reaches the threshold.

    Matching blocks hold M = threshold * sizes / 2 letters at least. Between two blocks lies an unmatched letter, so there are at
    most sizes - 2 M + 1 of them, and a block of m letters holds m - 1 neighbours.
    """
    return F.ceil(sizes * (1.5 * threshold - 1) - 1 - 1e-9)


def _grams(names: DataFrame) -> DataFrame:
    """name, size and each neighbouring pair of its letters with a number, so that a pair that repeats counts as often as it stands."""
    i = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("i")
    pairs = names.where("size > 1").select("name", "size", i).select("name", "size", F.substring("name", F.col("i"), F.lit(2)).alias("gram"))
    times = pairs.groupBy("name", "size", "gram").agg(F.count("*").alias("n"))
    each = F.transform(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda k: F.concat("gram", k.cast("string")))
    return times.select("name", "size", F.explode(each).alias("gram"))


def similar_name_candidates(names: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs (a, b), a the lesser, of different names (column name) that may reach the threshold.

    An inverted index of neighbouring letters: of each name the rarest ones are kept, all but as many as it must share with any
    partner less one, so that two names that share enough share one that both keep. Names too short for that meet by a
    letter. Then lengths and numbers of letters must allow the ratio.
    """
    sized = names.select("name", F.length("name").alias("size")).where("size > 0").distinct()
    far = (2 - threshold) / threshold
    # The partner of least length asks for the fewest; a pair that meets by neighbours shares one at least.
    fewest = F.greatest(F.lit(1), _least_shared(F.col("size") + F.ceil(F.col("size") / far - 1e-9), threshold))
    grams = _grams(sized)
    common = grams.groupBy("gram").agg(F.count("*").alias("names"))
    order = Window.partitionBy("name").orderBy("names", "gram")
    ranked = grams.join(common, "gram").withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") <= F.col("size") - fewest).select("name", "size", "gram")
    # Pairs so short that they need share no neighbours share a letter: their sizes add up to this at most.
    short = int((1 + 1e-9) / (1.5 * threshold - 1)) if threshold > 2 / 3 else 1 << 20
    letters = sized.where(F.col("size") < short).select("name", "size", F.explode(F.array_distinct(F.split("name", ""))).alias("letter")).where("letter <> ''")
    letters = letters.select("name", "size", F.concat(F.lit("letter "), "letter").alias("gram"))
    index = kept.unionByName(letters)
    left, right = (index.select(F.col("name").alias(x), F.col("size").alias(f"n_{x}"), "gram") for x in "ab")
    close = (F.col("n_a") <= F.col("n_b") * far) & (F.col("n_b") <= F.col("n_a") * far)
    met = left.join(right, "gram").where((F.col("a") < F.col("b")) & close & (~F.col("gram").startswith("letter ") | (F.col("n_a") + F.col("n_b") <= short)))
    met = met.select("a", "b", "n_a", "n_b").distinct()
    number = lambda x, c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    shared = sum((F.least(number(F.col("a"), c), number(F.col("b"), c)) for c in LETTERS), F.lit(0))
    rest = lambda x: F.length(F.regexp_replace(x, f"[{LETTERS}]", ""))
    enough = 2 * (shared + F.least(rest("a"), rest("b"))) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9
    return met.where(enough).select("a", "b")


def shadowed_names(tools: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs of different names of different servers that are almost alike: a, b, ratio.

    Names are compared, not tools: each distinct name once, with the least server that has it and the number that do. A pair's
    ratio is that of matching blocks (Ratcliff and Obershelp), of the lesser name to the greater; it is computed for ``similar_name_candidates`` only.
    """
    names = tools.groupBy(F.lower("name").alias("name")).agg(F.min("server").alias("server"), F.count_distinct("server").alias("servers"))
    side = lambda x: names.select(F.col("name").alias(x), F.col("server").alias(f"server_{x}"), F.col("servers").alias(f"n_{x}"))
    pairs = similar_name_candidates(names, threshold).join(side("a"), "a").join(side("b"), "b")
    pairs = pairs.where((F.col("server_a") != F.col("server_b")) | (F.col("n_a") > 1) | (F.col("n_b") > 1))

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    found = pairs.select("a", "b", ratio("a", "b").alias("ratio"))
    return found.where((F.col("ratio") >= threshold) & (F.col("ratio") < 1))


def exfiltration_chains(tools: DataFrame) -> DataFrame:
    """Servers that read data with the number of other servers that send data out.

    Every reader and every sender of another server form a chain; a reader's
    chains are counted from two sums, its own share taken off, not listed.
    """
    text = tool_text()
    per = tools.groupBy("server").agg(
        F.count_if(text.rlike(unicode_pattern(READS))).alias("readers"), F.count_if(text.rlike(unicode_pattern(SENDS))).alias("senders")
    )
    total = per.agg(F.count_if(F.col("senders") > 0).alias("sending"))
    own = F.when(F.col("senders") > 0, 1).otherwise(0)
    return per.where("readers > 0").crossJoin(F.broadcast(total)).select(  # by one row
        "server", "readers", (F.col("sending") - own).alias("chains")
    )


def capability_overlap(tools: DataFrame, least: int = 3) -> DataFrame:
    """Capabilities that so many servers offer."""
    text = tool_text()
    tags = F.array_compact(F.array(*[F.when(text.rlike(unicode_pattern(p)), c) for c, p in CAPABILITIES.items()]))
    return (
        tools.select("server", F.explode(tags).alias("capability"))
        .groupBy("capability")
        .agg(F.count_distinct("server").alias("servers"))
        .where(F.col("servers") >= least)
    )


def permission_gradient(tools: DataFrame) -> DataFrame:
    """One row if some servers only read while others write: how many of each."""
    writes = F.max(tool_text().rlike(unicode_pattern(WRITES))).alias("writes")
    per = tools.groupBy("server").agg(writes)
    found = per.agg(F.count_if(~F.col("writes")).alias("read_only"), F.count_if("writes").alias("writing"))
    return found.where("read_only > 0 and writing > 0")


def risk_pairs(findings: DataFrame) -> DataFrame:
    """Different pairs of servers that occur in one cross-server finding (column servers, an array)."""
    i = F.posexplode("servers").alias("i", "a")
    first = findings.select("servers", i)
    pairs = first.select("a", F.explode(F.slice("servers", F.col("i") + 2, F.size("servers"))).alias("b"))
    return pairs.where(F.col("a") != F.col("b")).distinct()


SEVERITY_INDEX = {"low": 0, "medium": 1, "high": 2, "critical": 3}


def severity_match(a: Column, b: Column) -> Column:
    """1, 0.7, 0.3 or 0 by the distance of two severities; 0.5 if one is unknown."""
    index = F.create_map(*[F.lit(x) for pair in SEVERITY_INDEX.items() for x in pair])
    apart = F.abs(index[F.lower(a)] - index[F.lower(b)])
    return F.when(apart.isNull(), 0.5).when(apart == 0, 1.0).when(apart == 1, 0.7).when(apart == 2, 0.3).otherwise(0.0)


def word_set(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), r"\s+"), ""))


def match_advisories(findings: DataFrame, advisories: DataFrame, mapped: list[str], min_score: float = 0.3) -> DataFrame:
    """The best score of each (rule, advisory): 0.4 word Jaccard + 0.4 rule has a weakness class + 0.2 severity.

    Different sets of words of findings and of advisories meet by the words that they share. Without a shared word only
    findings of a mapped rule, of which there are few kinds, can reach ``min_score`` above 0.2: their
    rules and severities, as many as ``mapped`` allows, meet every advisory, as the score asks for. Advisories of the same words
    and severity score alike: they are scored once, and only the best scores that reach ``min_score`` meet the advisories.
    """
    severity = severity_match(F.col("severity"), F.col("cve_severity"))
    weakness = F.when(F.col("rule_id").isin(mapped), 0.4).otherwise(0.0)
    said = findings.select("rule_id", F.concat_ws(" ", "title", "description").alias("text"), "severity").distinct()
    kinds = said.select("rule_id", F.array_sort(word_set(F.col("text"))).alias("words"), "severity").distinct()
    other = advisories.select("cve_id", F.col("severity").alias("cve_severity"), F.array_sort(word_set(F.col("description"))).alias("cve_words"))
    alike = ["cve_words", "cve_severity"]
    classes = other.select(*alike).distinct()
    a = kinds.select("words").distinct().select("words", F.explode("words").alias("word"))
    b = classes.select("cve_words").distinct().select("cve_words", F.explode("cve_words").alias("word"))
    common = a.join(b, "word").groupBy("words", "cve_words").agg(F.count("*").alias("common"))
    union = F.size("words") + F.size("cve_words") - F.col("common")
    near = common.select("words", "cve_words", (F.col("common") / union).alias("jaccard"))
    met = kinds.join(near, "words").join(classes, "cve_words")
    scored = met.select("rule_id", *alike, (0.4 * F.col("jaccard") + weakness + 0.2 * severity).alias("score"))
    if min_score <= 0.2:
        apart = kinds.select("rule_id", "severity").distinct()
    else:
        apart = kinds.where(F.col("rule_id").isin(mapped)).select("rule_id", "severity").distinct()
    apart = apart.join(classes).select("rule_id", *alike, (weakness + 0.2 * severity).alias("score"))
    best = scored.unionByName(apart).groupBy("rule_id", *alike).agg(F.max("score").alias("score")).where(F.col("score") >= min_score)
    best = best.select("rule_id", F.col("cve_words").alias("_words"), F.col("cve_severity").alias("_severity"), "score")
    same = F.col("_words").eqNullSafe(F.col("cve_words")) & F.col("_severity").eqNullSafe(F.col("cve_severity"))
    return best.join(other, same).groupBy("rule_id", "cve_id").agg(F.max("score").alias("score"))


#: Names of packages and scopes that others imitate.
KNOWN_PACKAGES = (
    "@modelcontextprotocol/server-filesystem", "@modelcontextprotocol/server-memory", "@modelcontextprotocol/server-everything",
    "@modelcontextprotocol/server-sequential-thinking", "@modelcontextprotocol/server-git", "@modelcontextprotocol/server-github",
    "@modelcontextprotocol/server-gitlab", "@modelcontextprotocol/server-slack", "@modelcontextprotocol/server-postgres",
    "@modelcontextprotocol/server-sqlite", "@modelcontextprotocol/server-puppeteer", "@modelcontextprotocol/server-brave-search",
    "@modelcontextprotocol/server-google-maps", "@modelcontextprotocol/server-everart", "@modelcontextprotocol/server-fetch",
    "@modelcontextprotocol/server-redis", "@modelcontextprotocol/server-sentry", "@modelcontextprotocol/server-gdrive",
    "@modelcontextprotocol/inspector",
    "mcp-server-git", "mcp-server-time", "mcp-server-fetch", "mcp-server-sqlite",
    "@playwright/mcp", "@browsermcp/mcp", "@notionhq/notion-mcp-server", "@upstash/context7-mcp", "@wonderwhy-er/desktop-commander",
    "chrome-devtools-mcp", "firecrawl-mcp", "tavily-mcp", "exa-mcp-server", "duckduckgo-mcp-server", "mcp-server-kubernetes",
    "blender-mcp", "figma-developer-mcp",
    "twitter-mcp", "stripe-mcp", "github-mcp", "slack-mcp", "notion-mcp", "postmark-mcp",
)
KNOWN_SCOPES = ("@modelcontextprotocol", "@playwright", "@notionhq", "@upstash", "@browsermcp")


def _nearest(text: Column, known: tuple[str, ...], limit: int, short: int, share: float) -> Column:
    """struct(distance, suspected) of the nearest of a short list within reach, ties to the lesser; null if there is none."""
    options = F.array(*[F.lit(k) for k in known])
    scored = F.transform(options, lambda k: F.struct(F.levenshtein(text, k, limit).alias("distance"), k.alias("suspected")))
    reach = lambda k: F.greatest(F.lit(1), F.floor(F.length(k) * share))
    near = F.filter(scored, lambda x: (x["distance"] > 0) & (x["distance"] <= reach(x["suspected"])) & (F.least(F.length(text), F.length(x["suspected"])) >= short))
    return F.array_min(near)


def nearest_known(names: DataFrame, packages: tuple[str, ...] = KNOWN_PACKAGES, scopes: tuple[str, ...] = KNOWN_SCOPES, limit: int = 2) -> DataFrame:
    """name, suspected, distance of names (column name) that look like a known package or scope but are none.

    A name is compared trimmed and in lower case with packages within ``limit`` edits, a third of the known name at most,
    both of five characters or more; ties go to the lesser known name. A name near no package whose scope is near a known
    one is reported with that scope and distance 1. The known names are literals of the plan: nothing is joined.
    """
    low = names.select(F.lower(F.trim("name")).alias("name")).where("name <> ''").distinct()
    scope = F.regexp_extract("name", r"^(@[^/]*)/", 1)
    rows = low.where(~F.col("name").isin(*packages)).withColumn("p", _nearest(F.col("name"), packages, limit, 5, 0.34))
    alike = F.when((scope != "") & ~scope.isin(*scopes), _nearest(scope, scopes, limit, 0, 1.0))
    rows = rows.withColumn("s", F.when(F.col("p").isNull(), alike))
    suspected = F.coalesce("p.suspected", F.concat("s.suspected", F.lit("/…")))
    distance = F.coalesce("p.distance", F.when(F.col("s").isNotNull(), 1))
    return rows.select("name", suspected.alias("suspected"), distance.alias("distance")).where("suspected is not null")
