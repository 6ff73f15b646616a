"""MAINTAINERS files: parse on the driver (a bounded text), match as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import email_of, glob_regex

KEYS = {"M": "maintainer", "R": "reviewer", "L": "mailing_list", "S": "status", "T": "tree", "K": "keyword"}


def parse(text: str) -> list[dict]:
    """Sections of a MAINTAINERS text: name, people, lists, status and path rules (F, X, N) with depth."""
    out: list[dict] = []
    title = None
    for line in text.splitlines():
        if len(line) > 2 and line[1] == ":" and line[0].isupper():
            key, value = line[0], line[2:].strip()
            if title is not None:
                out.append({"name": title, "rules": [], **{v: [] for v in KEYS.values()}})
                title = None
            if not out:
                continue
            if key in "FXN":
                pattern = value if key == "N" else glob_regex(value)
                depth = 0 if key == "N" else len([p for p in value.rstrip("*").split("/") if p])
                out[-1]["rules"].append((key, pattern, depth))
            elif key in KEYS:
                out[-1][KEYS[key]].append(value)
        elif line.strip() and not line[0].isspace():
            title = line.strip()
    return out


def rules(spark: SparkSession, sections: list[dict]) -> DataFrame:
    """name, rule, pattern, depth: a row for each path rule."""
    rows = [(s["name"], r, p, d) for s in sections for r, p, d in s["rules"]]
    return spark.createDataFrame(rows, "name string, rule string, pattern string, depth int")


def people(spark: SparkSession, sections: list[dict]) -> DataFrame:
    rows = [(s["name"], k, v) for s in sections for k in ("maintainer", "reviewer") for v in s[k]]
    return spark.createDataFrame(rows, "name string, role string, raw string").select("name", "role", email_of(F.col("raw")).alias("email"))


def owners(paths: DataFrame, rules_: DataFrame) -> DataFrame:
    """path, name, depth: sections with a matching F or N rule and no matching X rule; depth is the deepest matching rule's.
    A rule is joined by its leading literal folder to the paths below that folder, and its pattern tested on those alone; only
    rules that begin with a wildcard, or are free patterns, meet every path."""
    literal = F.regexp_replace(F.regexp_extract("pattern", r"^\^((?:[A-Za-z0-9_/]|\\[^A-Za-z0-9])*/)", 1), r"\\(.)", "$1")
    by_folder = rules_.withColumn("_folder", F.when(F.col("rule") == "N", F.lit("")).otherwise(literal))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    hit = paths.select("path").distinct().withColumn("_folder", F.explode(above)).join(by_folder, "_folder").filter(F.expr("path rlike pattern"))
    found = hit.groupBy("path", "name").agg(F.max("depth").alias("depth"), F.max((F.col("rule") == "X").cast("int")).alias("out"))
    return found.filter("out = 0").select("path", "name", "depth")
