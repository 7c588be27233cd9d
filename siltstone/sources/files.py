"""Directory scans: what is read of a file tree, what is skipped and why."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import redact

MAX_BYTES = 2 * 1024 * 1024
# Folders that are never entered, besides those whose names begin with a dot.
PRUNED = ("node_modules", "venv", "__pycache__", "dist", "build")


def gitignore(lines: list[str], base: str = "") -> list[tuple[str, bool, bool]]:
    """(pattern, folders only, taken back) of a .gitignore in folder base, in order; the last that matches a path decides."""
    out = []
    for raw in lines:
        line = re.sub(r"(?<!\\)\s+$", "", raw.rstrip("\r\n"))
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.lstrip("!") if line.startswith("!") else line
        folder, line = line.endswith("/"), line.rstrip("/")
        rooted = "/" in line
        body, at = "", 0
        line = line.lstrip("/")
        while at < len(line):
            if line.startswith("**/", at):
                body, at = body + "(?:.*/)?", at + 3
            elif line.startswith("**", at):
                body, at = body + ".*", at + 2
            elif line[at] == "[" and "]" in line[at + 1 :]:
                end = line.index("]", at + 1)
                body, at = body + "[" + line[at + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                body, at = body + {"*": "[^/]*", "?": "[^/]"}.get(line[at], re.escape(line[at])), at + 1
        out.append((f"{re.escape(base)}{'' if rooted else '(?:.*/)?'}{body}", folder, back))
    return out


def excluded(path: str, folder: bool, rules: list[tuple[str, bool, bool]]) -> bool:
    """Whether the last of the rules that matches a relative path excludes it."""
    out = False
    for body, folders_only, back in rules:
        if (folder or not folders_only) and re.fullmatch(body, path):
            out = not back
    return out


def listed(spark: SparkSession, root: str, rules: list[tuple[str, bool, bool]] = ()) -> list[tuple[str, str, int]]:
    """(path, relative path, length) of each file below root. Folders are entered one by one on the driver: never pruned or excluded ones,
    and each adds its own .gitignore to the rules of what is below it."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out, left = [], [(fs_path(root), "", list(rules))]
    while left:
        at, base, known = left.pop()
        entries = {f.getPath().getName(): f for f in fs.listStatus(at)}
        own = entries.get(".gitignore")
        if own is not None and not own.isDirectory():
            stream = fs.open(own.getPath())
            try:
                known = known + gitignore(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n"), base)
            finally:
                stream.close()
        for name, f in entries.items():
            path = base + name
            if f.isDirectory():
                if name not in PRUNED and not name.startswith(".") and not excluded(path, True, known):
                    left.append((f.getPath(), path + "/", known))
            elif not (name.startswith(".") and name.endswith(".crc")) and not excluded(path, False, known):
                out.append((f.getPath().toString(), path, f.getLen()))
    return sorted(out, key=lambda x: x[1])


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow.fs import FileSystem

    def content(path: str) -> bytes:
        fs, own = FileSystem.from_uri(re.sub(r"^file:/*", "file:///", path))
        with fs.open_input_stream(own) as f:
            return f.read()

    for frame in frames:
        yield frame.assign(content=[content(p) if r is None else b"" for p, r in zip(frame["path"], frame["reason"])])


def scan(spark: SparkSession, root: str, rules: list[tuple[str, bool, bool]] = (), protect: bool = True, max_bytes: int = MAX_BYTES) -> DataFrame:
    """file_path, reason (null: read; else sensitive, large, skipped or binary), content (null unless read). Names and sizes decide
    before anything is read; tasks read only what is left."""
    names = spark.createDataFrame(listed(spark, root, rules), "path string, file_path string, length long")
    name = F.regexp_extract("file_path", "[^/]*$", 0)
    reason = F.when(F.lit(protect) & redact.sensitive(name), "sensitive").when(name.rlike(r".\.jsonl$"), "skipped").when(F.col("length") > max_bytes, "large")
    read = names.withColumn("reason", reason).mapInPandas(_read, "path string, file_path string, length long, reason string, content binary")
    why = F.coalesce("reason", F.when(~F.is_valid_utf8("content"), "binary"))
    return read.select("file_path", why.alias("reason"), F.when(why.isNull(), F.decode("content", "UTF-8")).alias("content"))


def read_texts(scanned: DataFrame) -> DataFrame:
    """file_path and redacted content of what was read, with the tokens of the whole file."""
    return scanned.where("reason is null").select("file_path", redact.redacted(F.col("content")).alias("content"))


def skip_counts(scanned: DataFrame) -> DataFrame:
    return scanned.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("files"))
