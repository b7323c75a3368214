"""Source files as rows: scanning, classification, packages, aliases and diffs."""

from __future__ import annotations

import json
import os
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import glob_regex
from skein.sources.config import Config

#: Dependencies that say which frameworks a project uses (fixed values).
FRAMEWORKS = ("vue", "vue-router", "pinia", "vuex", "vue-demi", "@vue/composition-api", "nuxt", "electron")

#: Bytes of files that a task reads.
TASK_BYTES = 16 << 20


def _packed(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``files`` in partitions of ``TASK_BYTES`` or as many as a shuffle has: Spark counts each file as 4 MB, so 32 small ones a task."""
    plan = files._jdf.queryExecution()
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), plan.optimizedPlan().stats().sizeInBytes() // TASK_BYTES)
    return files.coalesce(most) if plan.toRdd().getNumPartitions() > most else files


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, rel_path, content, length) of all files below ``root`` but those of installed packages."""
    files = _packed(spark, spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))
    path = F.regexp_replace("path", "^file:(//)?", "")
    base = root.removeprefix("file://").rstrip("/")
    rel = F.when(path.startswith(base + "/"), F.substring(path, len(base) + 2, 100_000)).otherwise(path)
    return files.where(~F.col("path").contains("/node_modules/")).select(path.alias("path"), rel.alias("rel_path"), F.decode("content", "UTF-8").alias("content"), "length")


def classify(files: DataFrame, config: Config) -> DataFrame:
    """Files that a pattern of the configuration names, with the first entity type whose patterns match; empty files go.

    Patterns apply to the path below the source root, or to the end of the whole path. ``ordinal`` follows the order of
    the types, then the path: the order in which first matches are taken everywhere.
    """
    chosen, place = F.lit(None).cast("string"), F.lit(None).cast("int")
    for k, (name, patterns) in reversed(list(enumerate(config.entities.items()))):
        if patterns:
            regex = "|".join(glob_regex(p) for p in patterns)
            ends = "|".join("(?:^|/)" + glob_regex(p)[1:] for p in patterns)
            hit = F.col("rel_path").rlike(regex) | F.col("path").rlike(ends)
            chosen, place = F.when(hit, name).otherwise(chosen), F.when(hit, k).otherwise(place)
    found = files.where("length > 0").withColumn("entity_type", chosen).withColumn("type_ordinal", place).where("entity_type is not null")
    return found.withColumn("ordinal", F.struct("type_ordinal", "path"))


def package(spark: SparkSession, folder: str) -> DataFrame:
    """(id, name, entity_type, properties) of the package.json in a folder; no row if there is none."""
    path = os.path.join(folder, "package.json")
    empty = spark.createDataFrame([], "id string, name string, entity_type string, properties string")
    if not os.path.exists(path):
        return empty
    with open(path, encoding="utf-8") as f:
        try:
            raw = json.load(f)
        except ValueError:
            return empty
    needs = {**(raw.get("dependencies") or {}), **(raw.get("devDependencies") or {})}
    about = {
        "name": raw.get("name"),
        "version": raw.get("version"),
        "vueVersion": needs.get("vue"),
        "hasPinia": "pinia" in needs,
        "hasVuex": "vuex" in needs,
        "hasRouter": "vue-router" in needs,
        "hasVueDemi": "vue-demi" in needs,
        "frameworkDeps": {k: v for k, v in needs.items() if k in FRAMEWORKS},
        "hasLint": "lint" in (raw.get("scripts") or {}),
        "hasTest": "test" in (raw.get("scripts") or {}),
    }
    return spark.createDataFrame([(path, raw.get("name") or "package.json", "package", json.dumps(about))], empty.schema)


def aliases(folder: str) -> list[tuple[str, str]]:
    """(prefix, folder) of the path aliases in a folder's tsconfig.json or, failing that, its parent's."""
    for top in (folder, os.path.dirname(folder)):
        path = os.path.join(top, "tsconfig.json")
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                try:
                    options = json.load(f).get("compilerOptions") or {}
                except ValueError:
                    return []
            base = os.path.join(top, options.get("baseUrl") or ".")
            return [(k.replace("/*", "/"), posixpath.normpath(os.path.join(base, v[0].replace("/*", "/")))) for k, v in (options.get("paths") or {}).items() if v]
    return []


def diff_lines(spark: SparkSession, text: str) -> DataFrame:
    """(line_no, line) of a unified diff given as text."""
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line_no long, line string")
