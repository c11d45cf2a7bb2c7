"""Declared architecture: requirement files, pyproject.toml, compose files and JSON declarations as entities and relationships.

files: path, text. Results are (kind, key, entity_type, name, source, target, rel_type, properties, file, line, reason); kind: entity, relationship or unresolved.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import database_engine, requirement

#: Which files are read.
REQUIREMENTS = r"(^|/)requirements\.txt$|(^|/)requirements/(base|main|prod|production|runtime)\.txt$"
COMPOSE = r"(^|/)(docker-)?compose(\.[\w-]+)?\.ya?ml$"
#: Lists of a declaration, the entity type and relationship that each stands for.
DECLARED = {"publishes": ("EVENT", "PUBLISHES"), "consumes": ("EVENT", "CONSUMES"), "calls": ("SERVICE", "CALLS"), "databases": ("DATABASE", "ACCESSES"), "tables": ("TABLE", "ACCESSES"), "apis": ("API", "EXPOSES")}


def _project_dependencies(text: str) -> tuple[list, str | None]:
    """The dependencies of a project file, and what is wrong with it if anything is."""
    try:
        project = tomllib.loads(text).get("project", {})
    except tomllib.TOMLDecodeError as e:
        return [], f"no valid TOML: {e}"
    if not isinstance(project, dict):
        return [], "project is no table"
    listed = project.get("dependencies", [])
    return (listed, None) if isinstance(listed, list) else ([], "dependencies are no list")


def declared_dependencies(files: DataFrame) -> DataFrame:
    """(file, line, name, version) of requirement files and of [project] dependencies; version is the specifier without blanks, empty if there is none.

    A file that is no TOML or has other shapes there has no rows here; unreadable_manifests() tells it.
    """
    lines = files.where(F.col("path").rlike(REQUIREMENTS)).select(F.col("path").alias("file"), F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "raw"))
    plain = lines.select("file", (F.col("pos") + 1).alias("line"), requirement(F.col("raw")).alias("r"))

    def listed(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                found, _ = _project_dependencies(text)
                lines = text.splitlines()
                rows += [(path, next((i for i, x in enumerate(lines, 1) if d in x), None), d) for d in found if isinstance(d, str)]
            yield pd.DataFrame(rows, columns=["file", "line", "raw"]).astype({"line": "Int32"})

    toml = files.where(F.col("path").rlike(r"(^|/)pyproject\.toml$") & F.col("text").isNotNull()).mapInPandas(listed, "file string, line int, raw string")
    both = plain.unionByName(toml.select("file", "line", requirement(F.col("raw")).alias("r")))
    return both.where("r is not null").select("file", "line", F.col("r.name").alias("name"), F.col("r.spec").alias("version"))


def unreadable_manifests(files: DataFrame) -> DataFrame:
    """(file, reason) of project files that are no TOML, or whose project or dependencies are of another shape."""

    def read(batches: Iterator[pd.DataFrame]):
        for b in batches:
            told = [(path, _project_dependencies(text)[1]) for path, text in zip(b["path"], b["text"], strict=True)]
            yield pd.DataFrame([x for x in told if x[1]], columns=["file", "reason"])

    return files.where(F.col("path").rlike(r"(^|/)pyproject\.toml$") & F.col("text").isNotNull()).mapInPandas(read, "file string, reason string")


def compose_services(files: DataFrame) -> DataFrame:
    """(file, name, image, depends_on, error) of the services of compose files; a file that is no YAML has one row with its error."""

    def read(batches: Iterator[pd.DataFrame]):
        import yaml

        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    data = yaml.safe_load(text)
                except yaml.YAMLError as e:
                    rows.append((path, None, None, None, str(e).splitlines()[0]))
                    continue
                services = data.get("services") if isinstance(data, dict) else None
                for name, spec in services.items() if isinstance(services, dict) else []:
                    spec = spec if isinstance(spec, dict) else {}
                    needs = spec.get("depends_on")
                    rows.append((path, str(name), spec.get("image") if isinstance(spec.get("image"), str) else None, [str(x) for x in needs] if isinstance(needs, (list, dict)) else [], None))
            yield pd.DataFrame(rows, columns=["file", "name", "image", "depends_on", "error"])

    own = files.where(F.col("path").rlike(COMPOSE) & F.col("text").isNotNull())
    return own.mapInPandas(read, "file string, name string, image string, depends_on array<string>, error string")


def compose_entities(services: DataFrame) -> DataFrame:
    """(file, key, entity_type, name, engine): databases by their image, else services."""
    engine = database_engine(F.col("image"))
    kind = F.when(engine.isNotNull(), "DATABASE").otherwise("SERVICE")
    return services.where("name is not null").select("file", F.concat(F.lower(kind), F.lit(":"), "name").alias("key"), kind.alias("entity_type"), "name", engine.alias("engine"))


def compose_links(services: DataFrame) -> DataFrame:
    """(file, source, target, known): what services depend on; known is false for a name that the file doesn't have."""
    entities = compose_entities(services)
    links = services.select("file", "name", F.explode("depends_on").alias("needs"))
    source = entities.where("entity_type = 'SERVICE'").select("file", "name", F.col("key").alias("source"))
    target = entities.select("file", F.col("name").alias("needs"), F.col("key").alias("target"))
    return links.join(source, ["file", "name"]).join(target, ["file", "needs"], "left").select("file", "source", F.coalesce("target", "needs").alias("target"), F.col("target").isNotNull().alias("known"))


def declarations(files: DataFrame, file_name: str) -> DataFrame:
    """(file, field, value, method, entity_type, rel_type, line, reason) of JSON declarations of a given file name.

    What is no list, no name or (in `apis`) no {method, path} has a reason instead of a value. An API's value is its path. line: the first one that holds the value as JSON.
    """

    def read(batches: Iterator[pd.DataFrame]):
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    data = json.loads(text)
                    if not isinstance(data, dict):
                        raise ValueError("it is no object")
                except ValueError as e:
                    rows.append((path, None, None, None, None, str(e)))
                    continue
                lines = text.splitlines()
                at = lambda v: next((i for i, x in enumerate(lines, 1) if json.dumps(v) in x), None)  # noqa: B023, E731
                for field, values in data.items():
                    if field not in DECLARED:
                        rows.append((path, field, None, None, None, "unknown field"))
                    elif not isinstance(values, list):
                        rows.append((path, field, None, None, None, "not a list"))
                    elif field == "apis":
                        for v in values:
                            method, place = (v.get("method"), v.get("path")) if isinstance(v, dict) else (None, None)
                            good = isinstance(method, str) and isinstance(place, str) and place.startswith("/")
                            rows.append((path, field, place, method.upper(), at(place), None) if good else (path, field, None, None, None, "not a method and a /path"))
                    else:
                        rows += [(path, field, v, None, at(v), None) if isinstance(v, str) and v.strip() else (path, field, None, None, None, "not a name") for v in values]
            yield pd.DataFrame(rows, columns=["file", "field", "value", "method", "line", "reason"]).astype({"line": "Int32"})

    own = files.where((F.substring_index("path", "/", -1) == file_name) & F.col("text").isNotNull())
    out = own.mapInPandas(read, "file string, field string, value string, method string, line int, reason string")
    at = lambda i: F.create_map(*(F.lit(x) for k, v in DECLARED.items() for x in (k, v[i])))[F.col("field")]
    return out.select("file", "field", "value", "method", at(0).alias("entity_type"), at(1).alias("rel_type"), "line", "reason")


def http_links(calls: DataFrame, services: DataFrame, own: str | None = None) -> DataFrame:
    """calls: file_path, name (an address), line; services: name. Calls whose host is a known service, but not the own one; unknown hosts are never guessed to be one. Test files don't count."""
    from ..functions.columns import is_test_path, url_host

    known = services.where(~F.col("name").eqNullSafe(F.lit(own))).select(F.lower("name").alias("host"), F.col("name").alias("service")).distinct()
    return calls.where(~is_test_path(F.col("file_path"))).select("file_path", "line", url_host(F.col("name")).alias("host")).join(known, "host").select("file_path", "line", "service")
