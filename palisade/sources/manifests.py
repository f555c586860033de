"""Dependency manifests of projects: which files are manifests, and what they depend on."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders whose files are not a project's own.
SKIPPED = (".venv", "venv", "node_modules", ".git", "__pycache__", "dist", "build")
DEPENDENCY = "ecosystem string, name string, version string, direct boolean, integrity string, license string, requires array<string>"


def _row(name: str, version: str, direct: bool, integrity="", licence="", requires=()) -> tuple:
    return name, version, direct, str(integrity or ""), str(licence or ""), list(requires) if isinstance(requires, dict) else []


def clean_version(spec: str) -> str:
    """The first version number of a range; empty if it names none."""
    m = re.search(r"\d+(?:\.\d+){0,3}(?:[-+][0-9A-Za-z.]+)?", spec)
    return m[0] if m else ""


def _npm_lock(text: str) -> Iterator[tuple]:
    """Versions 2 and 3 list packages by path, version 1 by name; only direct ones lie one folder deep."""
    data = json.loads(text)
    packages, named = data.get("packages"), data.get("dependencies")
    found = False
    for path, info in (packages if isinstance(packages, dict) else {}).items():
        if path and isinstance(info, dict) and isinstance(info.get("version"), str):
            name, depth = path.rpartition("node_modules/")[2], path.count("node_modules/")
            if name:
                found = True
                yield _row(name, info["version"], depth == 1 and path.startswith("node_modules/"), info.get("integrity"), info.get("license"), info.get("dependencies"))
    for name, info in (named if isinstance(named, dict) and not found else {}).items():
        if isinstance(info, dict) and isinstance(info.get("version"), str):
            yield _row(name, info["version"], True, info.get("integrity"), info.get("license"), info.get("dependencies"))


def _package_json(text: str) -> Iterator[tuple]:
    """Ranges by the first version that they name; without one (``*``, ``latest``) a dependency cannot be looked up and is left out."""
    data = json.loads(text)
    for part in ("dependencies", "devDependencies", "optionalDependencies"):
        block = data.get(part)
        for name, spec in (block if isinstance(block, dict) else {}).items():
            if isinstance(spec, str) and clean_version(spec):
                yield _row(name, clean_version(spec), True)


def _yarn_lock(text: str) -> Iterator[tuple]:
    """Blocks of a header (the selectors of one package) and indented fields."""
    for block in re.split(r"\n(?=\S)", text):
        head, _, body = block.partition("\n")
        fields = dict(re.findall(r'^\s+(version|integrity):?\s+"?([^"\s]+)"?', body, re.M))
        if head.endswith(":") and not head.startswith("#") and "version" in fields:
            first = head.rstrip(":").split(",")[0].strip().strip('"')
            yield _row(first.rpartition("@")[0] or first, fields["version"], False, fields.get("integrity"))


def _requirement(line: str) -> Iterator[tuple]:
    m = re.match(r"([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?(.*)", line)
    if m and clean_version(m[2]):
        yield _row(m[1], clean_version(m[2]), True)


def _requirements(text: str) -> Iterator[tuple]:
    for line in text.splitlines():
        line = line.partition("#")[0].strip()
        if line and not line.startswith("-"):
            yield from _requirement(line)


def _pyproject(text: str) -> Iterator[tuple]:
    data = tomllib.loads(text)
    for spec in (data.get("project") or {}).get("dependencies") or []:
        if isinstance(spec, str):
            yield from _requirement(spec)
    poetry = ((data.get("tool") or {}).get("poetry") or {}).get("dependencies")
    for name, spec in (poetry if isinstance(poetry, dict) else {}).items():
        version = clean_version(str(spec.get("version", "") if isinstance(spec, dict) else spec))
        if name.lower() != "python" and version:
            yield _row(name, version, True)


def _python_lock(text: str) -> Iterator[tuple]:
    for item in tomllib.loads(text).get("package") or []:
        if isinstance(item.get("name"), str) and isinstance(item.get("version"), str):
            files = [item["sdist"]] if isinstance(item.get("sdist"), dict) else []
            files += item["wheels"] if isinstance(item.get("wheels"), list) else []
            hashes = [x["hash"] for x in files if isinstance(x, dict) and x.get("hash")]
            yield _row(item["name"], item["version"], False, hashes[0] if hashes else "")


def _pnpm_lock(text: str) -> Iterator[tuple]:
    import yaml

    # The safe loader in C where PyYAML has it.
    packages = (yaml.load(text, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}).get("packages")
    for key, info in (packages if isinstance(packages, dict) else {}).items():
        m = re.match(r"/?((?:@[^/]+/)?[^@/]+)[@/]([^()]+)", str(key))
        if m and isinstance(info, dict):
            source = info.get("resolution")
            yield _row(m[1], m[2], False, source.get("integrity") if isinstance(source, dict) else "", "", info.get("dependencies"))


#: By file name: ecosystem, parser and whether the file locks its ecosystem. Of several locks the last in this order counts.
MANIFESTS: dict[str, tuple[str, Callable, bool]] = {
    "package-lock.json": ("npm", _npm_lock, True),
    "pnpm-lock.yaml": ("npm", _pnpm_lock, True),
    "yarn.lock": ("npm", _yarn_lock, True),
    "package.json": ("npm", _package_json, False),
    "uv.lock": ("PyPI", _python_lock, True),
    "poetry.lock": ("PyPI", _python_lock, True),
    "pdm.lock": ("PyPI", _python_lock, True),
    "pyproject.toml": ("PyPI", _pyproject, False),
    "requirements.txt": ("PyPI", _requirements, False),
}


def outside(path: Column, folders: tuple[str, ...] = SKIPPED) -> Column:
    """Whether no folder of a path is one of these."""
    return ~F.arrays_overlap(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), F.array(*[F.lit(x) for x in folders]))


def is_manifest(path: str = "path") -> Column:
    """Whether a path is that of a manifest of a project's own."""
    return F.regexp_replace(path, r"^.*[/\\]", "").isin(*MANIFESTS) & outside(F.col(path))


def manifest_files(spark: SparkSession, root: str) -> DataFrame:
    """project, path, content of the manifests below ``root``; a project is a folder of the root.

    Spark's file sources pass over names that begin with a dot, and so over no manifest.
    """
    names = "{" + ",".join(MANIFESTS) + "}"
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).text(root, wholetext=True)
    rows = read.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where(is_manifest())
    below = F.substring_index("path", root.rstrip("/") + "/", -1)
    return rows.select(F.regexp_extract(below, r"^([^/]+)/", 1).alias("project"), "path", "content")


def dependencies(files: DataFrame) -> DataFrame:
    """project, source, ecosystem, name, version, direct, integrity, license, requires from manifest files (project, path, content).

    A project's lock file of an ecosystem, the last in the order of MANIFESTS and by path, takes the place of its other manifests, even if it
    lists nothing. Of equal (ecosystem, name in lower case, version) the first stays. A file that cannot be parsed gives nothing.
    """
    order = list(MANIFESTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for project, path, content in batch.itertuples(index=False, name=None):
                source = re.split(r"[/\\]", path or "")[-1]
                if source not in MANIFESTS:
                    continue
                ecosystem, parse, lock = MANIFESTS[source]
                head = project, source, path, order.index(source), lock
                try:
                    found = list(parse(content or ""))
                except Exception:  # noqa: BLE001  any malformed file
                    continue
                # A row without a name says that the file was read.
                rows.append((*head, -1, ecosystem, None, None, None, None, None, None))
                rows += [(*head, i, ecosystem, *x) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["project", "source", "path", "rank", "lock", "nth", *[x.split()[0] for x in DEPENDENCY.split(", ")]])

    kind = dict(files.dtypes)["project"]
    found = files.select("project", "path", "content").mapInPandas(
        run, f"project {kind}, source string, path string, rank int, lock boolean, nth int, {DEPENDENCY}"
    )
    by = ["project", "ecosystem"]
    # One pass over the parsed files: they are not parsed again for their locks. Null projects have no locks.
    locked = F.max(F.when(F.col("lock") & F.col("name").isNull() & F.col("project").isNotNull(), F.struct("rank", "path")))
    kept = found.withColumn("locked", locked.over(Window.partitionBy(*by))).where("name is not null")
    kept = kept.where(F.when(F.col("locked").isNull(), ~F.col("lock")).otherwise(F.struct("rank", "path") == F.col("locked")))
    fields = ["source", "name", "direct", "integrity", "license", "requires"]
    first = kept.groupBy(*by, F.lower("name").alias("_name"), "version").agg(F.min_by(F.struct(*fields), F.struct("rank", "path", "nth")).alias("f"))
    return first.select("project", "f.source", "ecosystem", "f.name", "version", "f.direct", "f.integrity", "f.license", "f.requires")
