"""Readers of archive folders: texts, transcripts, JSON lines, manifests, binaries, zip archives, policies."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archivolt.functions.text import strip
from archivolt.operators.moderation import Policy, Rule

SEGMENTS = "segments array<struct<text string>>"
# fixed values: file types that do not belong into an archive's repository
FORBIDDEN = (
    ".mp4", ".mov", ".mkv", ".wav", ".flac", ".mp3", ".aac", ".png", ".jpg", ".jpeg", ".webp", ".zip", ".7z", ".tar", ".gz", ".safetensors", ".onnx", ".pt", ".pth", ".gguf",
)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole UTF-8 files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of transcript files: their segments' texts by line, or the JSON itself if it has no list of segments.

    A file that is no JSON keeps a null text.
    """
    raw = read_texts(spark, path)
    doc = F.from_json("text", SEGMENTS)
    whole = F.try_parse_json("text")
    joined = strip(F.array_join(F.transform(doc["segments"], lambda s: F.coalesce(s["text"], F.lit(""))), "\n"))
    return raw.select("path", F.when(doc["segments"].isNotNull(), joined).when(whole.isNotNull(), F.to_json(whole)).alias("text"))


def read_json_lines(spark: SparkSession, path: str, schema: str, required: str = "text") -> DataFrame:
    """Rows of JSON lines; blank and malformed lines, and rows whose required field is null or blank, are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r")).select("r.*")
    return rows.where(strip(F.col(required)) != "")


def read_manifests(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """JSON documents of a glob with their file paths; a malformed one keeps null fields."""
    return spark.read.schema(schema).json(pattern, multiLine=True, mode="PERMISSIVE").select("*", F.col("_metadata.file_path").alias("path"))


def read_pointers(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All ``*.pointer.json`` below a folder, but for those in a ``.git`` folder."""
    return (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.pointer.json")
        .json(root, multiLine=True)
        .select("*", F.col("_metadata.file_path").alias("path"))
        .where(~F.contains("path", F.lit("/.git/")))
    )


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256) of any files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("size"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"))


def read_archives(spark: SparkSession, path: str, descriptor: str | None = None) -> DataFrame:
    """The members of the zip archives of a folder or glob, see ``archive_members``."""
    return archive_members(spark.read.format("binaryFile").load(path).select(F.col("path").alias("package"), "content"), descriptor)


def archive_members(archives: DataFrame, descriptor: str | None = None) -> DataFrame:
    """(package, error, path, size, sha256, content): the members of zip archives (package, content).

    A bad archive is one row with an error and nulls: bad_zip; unsafe_member_name, its path listing the first five of them;
    missing_descriptor if one is named and not there. A null content is a missing archive. An archive must fit a row.
    """

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib
        import io
        import zipfile

        for pdf in batches:
            rows = []
            for name, content in zip(pdf["package"], pdf["content"], strict=True):
                if content is None:
                    rows.append((name, "missing", None, None, None, None))
                    continue
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        files = [i for i in z.infolist() if not i.is_dir()]
                        unsafe = sorted(i.filename for i in files if not _is_safe(i.filename))
                        if unsafe:
                            rows.append((name, "unsafe_member_name", ", ".join(unsafe[:5]), None, None, None))
                        elif descriptor is not None and descriptor not in z.namelist():
                            rows.append((name, "missing_descriptor", None, None, None, None))
                        else:
                            for i in files:
                                data = z.read(i)
                                rows.append((name, None, i.filename, len(data), "sha256:" + hashlib.sha256(data).hexdigest(), data))
                except zipfile.BadZipFile:
                    rows.append((name, "bad_zip", None, None, None, None))
            yield pd.DataFrame(rows, columns=["package", "error", "path", "size", "sha256", "content"]).astype({"size": "Int64"})

    return archives.select("package", "content").mapInPandas(members, "package string, error string, path string, size bigint, sha256 string, content binary")


def _is_safe(name: str) -> bool:
    return bool(name) and "\\" not in name and not {"", ".", ".."} & set(name.split("/"))


def descriptor_status(content: Column) -> Column:
    """What is wrong with the bytes of a JSON descriptor, null if nothing: missing, not_utf8, not_json or not_object."""
    text = F.try_validate_utf8(content.cast("string"))
    parsed = F.try_parse_json(text)
    return (
        F.when(content.isNull(), "missing").when(text.isNull(), "not_utf8").when(parsed.isNull(), "not_json")
        .when(~F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), "not_object")
    )


def entry_faults(text: Column, field: str = "contents") -> Column:
    """The first thing wrong with the list of entries in a JSON descriptor, null if nothing: not_array, entry_not_object,
    entry_path_missing, entry_sha_missing or entry_size_missing; the earliest entry counts. A missing list is an empty one."""
    listed = F.try_variant_get(F.try_parse_json(text), f"$.{field}", "variant")
    kind = F.schema_of_variant(listed)
    items = F.try_variant_get(listed, "$", "array<variant>")

    def fault(e: Column) -> Column:
        is_kind = lambda name, kinds: F.schema_of_variant(F.try_variant_get(e, f"$.{name}", "variant")).isin(kinds)
        return (
            F.when(~F.startswith(F.schema_of_variant(e), F.lit("OBJECT")), "entry_not_object")
            .when(~F.coalesce(is_kind("path", ["STRING"]), F.lit(False)), "entry_path_missing")
            .when(~F.coalesce(is_kind("sha256", ["STRING"]), F.lit(False)), "entry_sha_missing")
            .when(~F.coalesce(is_kind("size", ["BIGINT"]), F.lit(False)), "entry_size_missing")
        )

    first = F.get(F.filter(F.transform(items, fault), lambda x: x.isNotNull()), F.lit(0))
    return F.when(listed.isNotNull(), F.when(~F.startswith(kind, F.lit("ARRAY")), F.lit("not_array")).otherwise(first))


def read_policy(path: str) -> Policy:
    """A policy file in JSON, or in YAML where PyYAML is there. Its name defaults to the file's, its version to ``user-supplied``."""
    file = Path(path)
    raw = file.read_text(encoding="utf-8")
    if file.suffix.lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{file.name}: YAML needs PyYAML; JSON does not") from e
        doc = yaml.safe_load(raw)
    else:
        doc = json.loads(raw)
    if not isinstance(doc, dict) or "rules" not in doc:
        raise ValueError("policy without rules")
    rules = tuple(Rule(r["name"], tuple(r["patterns"]), r.get("category", "custom"), r.get("severity", "medium")) for r in doc["rules"])
    return Policy(doc.get("name", file.stem), str(doc.get("version", "user-supplied")), rules)


def forbidden_files(paths: DataFrame, allowed: tuple[str, ...] = ("docs/", "assets/public/")) -> DataFrame:
    """The paths of forbidden file types outside the allowed folders."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    ok = F.lit(False)
    for prefix in allowed:
        ok = ok | F.col("path").startswith(prefix)
    return paths.where(ext.isin(list(FORBIDDEN)) & ~ok)


def missing_keys(documents: DataFrame, required: tuple[str, ...] = ("$schema", "$id", "title", "description")) -> DataFrame:
    """(path, missing) of JSON texts (path, text) that lack a required top-level key; null keys for malformed ones."""
    lacking = F.array_except(F.array(*[F.lit(k) for k in required]), F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>")))
    return documents.select("path", lacking.alias("missing")).where(F.size("missing") > 0)
