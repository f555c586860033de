"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A Java pattern whose classes and case folding are Unicode, as those of other regex dialects are by default."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def entropy(text: str | Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for fewer than three characters."""
    c = F.col(text) if isinstance(text, str) else text
    n = F.length(c)
    letters = F.split(c, "")
    shares = F.transform(F.array_distinct(letters), lambda x: F.size(F.filter(letters, lambda y: y == x)) / n)
    bits = F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))
    return F.when(n < 3, 0.0).otherwise(bits)


def name_parts(name: str | Column) -> Column:
    """Distinct lower-case parts of a snake, kebab or camel case name."""
    c = F.col(name) if isinstance(name, str) else name
    cut = F.regexp_replace(c, r"([a-z0-9])([A-Z])", "$1_$2")
    cut = F.regexp_replace(cut, r"([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.array_distinct(F.array_remove(F.split(F.lower(cut), r"[_\-\s.]+"), ""))


def printable_share(text: str | Column) -> Column:
    """The share of tabs, line ends and printable ASCII characters."""
    c = F.col(text) if isinstance(text, str) else text
    return F.length(F.regexp_replace(c, r"[^\x09-\x0d\x20-\x7e]", "")) / F.greatest(F.length(c), F.lit(1))


def glob_pattern(glob: str) -> str:
    """An anchored Java pattern for a shell glob (``* ? [..] [!..]``), case-sensitive."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            inside = glob[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{'^' + inside[1:] if inside[0] == '!' else inside}]")
            i = end + 1
        else:
            out.append(f"\\{c}" if not c.isalnum() and c != "_" and ord(c) < 128 else c)
    return f"(?s)^(?:{''.join(out)})$"


def version_numbers(version: str | Column) -> Column:
    """Numbers of a dotted version, after a leading v and up to a suffix; null if one is no number."""
    c = F.col(version) if isinstance(version, str) else version
    core = F.regexp_replace(F.regexp_replace(c, r"^[vV]", ""), r"[-+].*$", "")
    numbers = F.transform(F.split(core, r"\."), lambda x: x.try_cast("int"))
    return F.when(~F.exists(numbers, lambda x: x.isNull()), numbers)


def version_change(old: str | Column, new: str | Column) -> Column:
    """same, rollback, major_upgrade or minor_upgrade; what cannot be read is a minor upgrade."""
    a, b = version_numbers(old), version_numbers(new)
    old, new = (F.col(x) if isinstance(x, str) else x for x in (old, new))
    return (
        F.when(old.eqNullSafe(new), "same")
        .when(a.isNull() | b.isNull(), "minor_upgrade")
        .when(b < a, "rollback")
        .when(F.get(b, F.lit(0)) > F.get(a, F.lit(0)), "major_upgrade")
        .otherwise("minor_upgrade")
    )


def cvss_base_score(vector: str | Column) -> Column:
    """CVSS v3 base score of a vector; null if a metric is missing. Weights are those of the published standard."""
    c = F.col(vector) if isinstance(vector, str) else vector
    metrics = F.str_to_map(F.regexp_replace(c, r"^CVSS:3\.\d/", ""), F.lit("/"), F.lit(":"))

    def weight(name: str, **values: float) -> Column:
        out = F.lit(None).cast("double")
        for key, value in values.items():
            out = F.when(metrics[name] == key, value).otherwise(out)
        return out

    changed = metrics["S"] == "C"
    attack = weight("AV", N=0.85, A=0.62, L=0.55, P=0.2) * weight("AC", L=0.77, H=0.44) * weight("UI", N=0.85, R=0.62)
    rights = F.when(changed, weight("PR", N=0.85, L=0.68, H=0.5)).otherwise(weight("PR", N=0.85, L=0.62, H=0.27))
    exploitability = 8.22 * attack * rights
    impact = [weight(x, H=0.56, L=0.22, N=0.0) for x in ("C", "I", "A")]
    iss = 1 - (1 - impact[0]) * (1 - impact[1]) * (1 - impact[2])
    total = F.when(changed, 7.52 * (iss - 0.029) - 3.25 * F.pow(iss - 0.02, F.lit(15))).otherwise(6.42 * iss)
    raw = F.least(F.lit(10.0), F.when(changed, 1.08 * (total + exploitability)).otherwise(total + exploitability))
    # Rounded up to one decimal, in whole hundred thousandths as the standard says.
    up = F.ceil(F.round(raw * 100000) / 10000) / 10
    known = metrics["S"].isin("C", "U")
    return F.when(known & (total <= 0), 0.0).when(known, up.cast("double"))


def cvss_severity(score: str | Column) -> Column:
    """critical from 9, high from 7, medium from 4, else low; medium if there is no score."""
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s.isNull(), "medium").when(s >= 9, "critical").when(s >= 7, "high").when(s >= 4, "medium").otherwise("low")


def tls_order(version: str | Column) -> Column:
    """Position of a TLS or SSL version, oldest first; -1 if unknown."""
    c = F.upper(F.col(version) if isinstance(version, str) else version)
    out = F.lit(-1)
    for i, name in enumerate(("SSLV2", "SSLV3", "TLSV1", "TLSV1.1", "TLSV1.2", "TLSV1.3")):
        out = F.when(c == name, i).otherwise(out)
    return out


def slug(text: str | Column) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def origin(url: str | Column) -> Column:
    """scheme://host[:port] of a URL; null without a host."""
    c = F.col(url) if isinstance(url, str) else url
    found = F.regexp_extract(c, r"^([a-zA-Z][\w+.-]*://[^/?#]+)", 1)
    return F.when(found != "", F.lower(found))


def repository(url: str | Column) -> Column:
    """owner/name of a URL on GitHub, without ``.git`` at its end; null for others and for those without a name."""
    c = F.col(url) if isinstance(url, str) else url
    place = r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)([^?#]*)"
    parts = F.filter(F.split(F.regexp_extract(c, place, 2), "/"), lambda x: x != "")
    name = F.concat_ws("/", F.get(parts, F.lit(0)), F.regexp_replace(F.get(parts, F.lit(1)), r"\.git$", ""))
    return F.when(F.contains(F.regexp_extract(c, place, 1), F.lit("github.com")) & (F.size(parts) >= 2), name)
