"""File trees as tables: predicates on names and sizes, listing, and reading."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import basename, extension

MOST_BYTES = 1_000_000

#: Directory and file names, suffixes and name parts that decide whether a file is indexed.
NOISE_PARTS = [
    ".git", ".hg", ".svn", ".venv", "venv", "env", ".env", "node_modules", "bower_components", "dist", "build", "out",
    "target", "bin", "obj", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".tox", ".idea", ".vscode",
    ".vs", "coverage", ".nyc_output", "htmlcov", "vendor", "third_party", "third-party", ".next", ".nuxt", ".svelte-kit",
    "site-packages", "egg-info",
]
NOISE_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Cargo.lock", "Gemfile.lock", "composer.lock", "go.sum", ".DS_Store", "Thumbs.db"]
NOISE_SUFFIXES = [
    ".exe", ".dll", ".so", ".dylib", ".bin", ".o", ".a", ".lib", ".pyd", ".zip", ".tar", ".gz", ".bz2", ".xz", ".7z",
    ".rar", ".jar", ".war", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav",
    ".avi", ".mov", ".mkv", ".flac", ".ogg", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".pdf", ".doc", ".docx", ".xls",
    ".xlsx", ".ppt", ".pptx", ".db", ".sqlite", ".sqlite3", ".parquet", ".lock",
]
SECRET_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".crt", ".cer", ".der", ".csr", ".gpg", ".asc", ".kdbx", ".ppk"]
SECRET_NAMES = [
    ".env", ".env.local", ".env.development", ".env.production", ".env.test", ".env.staging", ".envrc", "id_rsa", "id_dsa",
    "id_ecdsa", "id_ed25519", ".htpasswd", ".netrc", "_netrc", ".pgpass", "credentials", "credentials.json",
    "service-account.json", "secrets.yaml", "secrets.yml", "secrets.json", ".npmrc", ".pypirc", ".dockercfg",
]
SECRET_WORDS = ["secret", "credential", "private_key", "privatekey", "private-key", "apikey", "api_key", "passwd", "password"]
TEMPLATE_SUFFIXES = [".example", ".sample", ".template", ".dist"]
LANGUAGES = {
    "python": [".py"], "javascript": [".js", ".jsx", ".mjs", ".cjs"], "typescript": [".ts", ".mts", ".cts"], "tsx": [".tsx"],
    "go": [".go"], "java": [".java"], "rust": [".rs"], "c": [".c", ".h"], "cpp": [".cpp", ".cc", ".cxx", ".hpp"],
    "c_sharp": [".cs"], "ruby": [".rb"], "php": [".php"], "swift": [".swift"], "kotlin": [".kt", ".kts"], "scala": [".scala"],
}


def is_noise(path: Column) -> Column:
    """Noise by any path component, by name, by suffix, or minified. Paths are relative to the tree's root."""
    name = basename(path)
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, NOISE_PARTS))) | name.isin(NOISE_NAMES) | extension(name).isin(NOISE_SUFFIXES) | name.endswith(".min.js") | name.endswith(".min.css")


def is_secret(path: Column) -> Column:
    """Credential material by name; templates of such files are not."""
    name = F.lower(basename(path))
    template = name.rlike("(?:" + "|".join(x.replace(".", r"\.") for x in TEMPLATE_SUFFIXES) + r")\z")
    return ~template & (name.isin(SECRET_NAMES) | extension(name).isin(SECRET_SUFFIXES) | name.rlike("|".join(SECRET_WORDS)))


def language(path: Column) -> Column:
    found = F.lit("text")
    for name, suffixes in LANGUAGES.items():
        found = F.when(extension(basename(path)).isin(suffixes), name).otherwise(found)
    return found


def right_size(size: Column) -> Column:
    return size.between(1, MOST_BYTES)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, file_size) of every regular file below a folder that the executors share, hidden ones included.

    Noise directories are pruned on the way. Spark's own readers skip names
    that begin with a dot or underscore, hence the walk.
    """
    rows = []
    for folder, below, names in os.walk(root):
        below[:] = sorted(d for d in below if d not in NOISE_PARTS)
        for name in sorted(names):
            full = os.path.join(folder, name)
            if os.path.isfile(full):
                rows.append((os.path.relpath(full, root).replace(os.sep, "/"), os.path.getsize(full)))
    return spark.createDataFrame(rows, "file_path string, file_size long")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """Indexable files: predicates on path and size come before any content is read."""
    found = list_files(spark, root)
    return found.where(~is_noise(F.col("file_path")) & ~is_secret(F.col("file_path")) & right_size(F.col("file_size"))).withColumn("language", language(F.col("file_path")))


def read_sources(files: DataFrame, root: str) -> DataFrame:
    """Adds source_text: UTF-8 with line ends as \\n; null where the bytes aren't UTF-8 or can't be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path in batch["file_path"]:
                try:
                    with open(os.path.join(root, path), encoding="utf-8") as f:
                        texts.append(f.read())
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield batch.assign(source_text=texts)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields) + ", source_text string"
    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.repartition(tasks, "file_path").mapInPandas(run, schema)
