"""Sources: report XML, image listings, JSON fixtures, DICOM and other films, run tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import drop_marked

REPORT = "uId struct<_id: string>, MedlineCitation struct<Article: struct<Abstract: struct<AbstractText: array<struct<_Label: string, _VALUE: string>>>>>, MeSH struct<major: array<string>>, _corrupt_record string"


def _last(label: str) -> Column:
    """Text of the last block with this label, trimmed; empty without one."""
    blocks = F.col("MedlineCitation.Article.Abstract.AbstractText")
    return F.trim(F.coalesce(F.try_element_at(F.filter(blocks, lambda x: x["_Label"] == label), F.lit(-1))["_VALUE"], F.lit("")))


def reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Parsed reports (study_id, texts, mesh) and, apart, files that do not parse. The id is the number in the file's name."""
    raw = spark.read.format("xml").option("rowTag", "eCitation").option("mode", "PERMISSIVE").schema(REPORT).load(path)
    raw = raw.withColumn("path", F.col("_metadata.file_path"))
    study = F.regexp_extract("path", r"([^/]+)\.xml$", 1)
    major = F.filter(F.transform(F.coalesce("MeSH.major", F.array().cast("array<string>")), F.trim), lambda x: x != "")
    good = raw.where("_corrupt_record is null").select(study.alias("study_id"), _last("FINDINGS").alias("findings_raw"), _last("IMPRESSION").alias("impression_raw"), _last("INDICATION").alias("indication_raw"), major.alias("mesh"))
    cleaned = lambda c: drop_marked(F.col(c))
    changed = F.array_compact(F.array(*(F.when(F.contains(F.col(f"{c}_raw"), F.lit("XXXX")), F.lit(f"placeholders removed from {c}")) for c in ("findings", "impression", "indication"))))
    good = good.select("study_id", cleaned("findings_raw").alias("findings_text"), cleaned("impression_raw").alias("impression_text"), cleaned("indication_raw").alias("indication"), "mesh", changed.alias("notes"))
    # the second condition always holds: Spark refuses queries that read the corrupt column alone
    return good, raw.where("_corrupt_record is not null and length(coalesce(uId._id, '')) >= 0").select(study.alias("study_id"), "path", F.lit("corrupt report").alias("reason"))


def images(spark: SparkSession, path: str, glob: str = "CXR*.png") -> DataFrame:
    """study_id and its image paths in order; bytes are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path")
    files = files.withColumn("study_id", F.regexp_extract(F.regexp_extract("path", "([^/]+)$", 1), r"^CXR(\d+)_", 1)).where("study_id <> ''")
    return files.groupBy("study_id").agg(F.sort_array(F.collect_list("path")).alias("image_paths"))


def studies(spark: SparkSession, reports_path: str, images_path: str) -> tuple[DataFrame, DataFrame]:
    """Studies with a sound report and an image, and what was skipped with the reason."""
    good, bad = reports(spark, reports_path)
    both = good.join(images(spark, images_path), "study_id", "full_outer")
    kept = both.where("image_paths is not null and findings_text is not null")
    reason = F.when(F.col("image_paths").isNull(), "no image").otherwise("no report")
    skipped = both.where("image_paths is null or findings_text is null").select("study_id", reason.alias("reason")).union(bad.select("study_id", "reason"))
    return kept, skipped


def corpus_root(candidates: list[str], exists: Callable[[str], bool]) -> str:
    """The first candidate that holds reports, else the last (the committed sample)."""
    return next((c for c in candidates[:-1] if exists(f"{c}/reports")), candidates[-1])


_CACHE: dict[str, DataFrame] = {}


def cached(root: str, load: Callable[[str], DataFrame]) -> DataFrame:
    if root not in _CACHE:
        _CACHE[root] = load(root).cache()
    return _CACHE[root]


def reset_cache() -> None:
    for df in _CACHE.values():
        df.unpersist()
    _CACHE.clear()


def gold_cases(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.option("multiLine", "true").schema(f"cases array<struct<{schemas.GOLD}>>").json(path)
    return doc.select(F.inline("cases"))


def phi_samples(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Samples of a JSON array, or of files with one in each line, as store.write_json leaves them."""
    return spark.read.option("multiLine", str(not lines).lower()).schema(schemas.PHI).json(path)


def guidelines(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.option("multiLine", "true").schema(f"entries array<struct<{schemas.GUIDELINES}>>").json(path)
    return doc.select(F.posexplode("entries").alias("ord", "e")).select("ord", "e.*")


def operating_points(spark: SparkSession, path: str | None, exists: Callable[[str], bool]) -> DataFrame:
    """The table of thresholds; empty where there is no file. Null thresholds are dropped."""
    if path is None or not exists(path):
        return spark.createDataFrame([], schemas.OPERATING_POINTS)
    return spark.read.option("multiLine", "true").schema(schemas.OPERATING_POINTS).json(path).where("threshold is not null")


def glob_images(cases: DataFrame, files: DataFrame) -> DataFrame:
    """image_paths of each case whose image_path is a pattern: an equi-join on the id in it, then the pattern itself."""
    study = F.regexp_extract(F.regexp_extract("image_path", "([^/]+)$", 1), r"^CXR(\d+)_", 1)
    pattern = F.concat(F.lit("(^|/)"), F.regexp_replace(F.regexp_replace(F.regexp_extract("image_path", "([^/]+)$", 1), r"([.+()\[\]{}^$|\\])", r"\\$1"), r"\*", "[^/]*"), F.lit("$"))
    one = files.select(F.col("study_id").alias("_id"), F.explode("image_paths").alias("_path"))
    hits = cases.withColumns({"_study": study, "_pattern": pattern}).join(one, F.col("_study") == F.col("_id"), "left")
    paths = F.sort_array(F.collect_list(F.when(F.expr("_path rlike _pattern"), F.col("_path"))))
    return hits.groupBy(*cases.columns).agg(paths.alias("image_paths"))


def is_dicom(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(dcm|dicom)$")


def pixels_complete(length: Column, rows: Column, columns: Column, samples: Column, bits: Column) -> Column:
    return length >= rows * columns * samples * (bits / 8)


def films(spark: SparkSession, path: str, decode: Callable[[str, bytes], dict] | None = None) -> DataFrame:
    """path, width, height, mean, std, symmetry, error of each film. decode gives a 2-D array for a path and bytes; without it Pillow or pydicom must be installed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions import pixels

        for b in batches:
            yield pd.DataFrame([pixels.describe(p, c, decode) for p, c in zip(b["path"], b["content"])], columns=["path", "width", "height", "mean", "std", "symmetry", "error"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return raw.mapInPandas(run, "path string, width int, height int, mean double, std double, symmetry double, error string")


def data_uri(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))


FILM = "path string, tags map<string, string>, dropped array<string>, dropped_meta array<string>, notes array<string>, width int, height int, mean double, std double, symmetry double, error string"


def dicom_films(spark: SparkSession, path: str, read: Callable[[str, bytes], dict] | None = None) -> DataFrame:
    """Films of DICOM files with the tags that may pass, the names of those that may not, and what was done to the pixels.

    Tags are scrubbed as the file is read. read gives tags, meta and pixels of a path and its bytes; without it
    sources/dicom.py reads plain little-endian files, and pydicom, if installed, others. A file that can't be read is a
    row with its error. For films in archives see archived_films.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(is_dicom(F.col("path"))).select("path", "content")
    return scrubbed_films(raw, read)


def archived_films(spark: SparkSession, path: str, read: Callable[[str, bytes], dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """FILM of the whole DICOM members of archives, and, apart, members and archives that are cut off, with the reason."""
    from . import archives

    members = archives.films(spark, path, "archive", "member", "complete", "content", "error")
    at = F.concat_ws("/", "archive", "member").alias("path")
    return scrubbed_films(members.where(F.col("complete") & is_dicom(F.col("member"))).select(at, "content"), read), members.where(~F.col("complete")).select("archive", "member", F.col("error").alias("reason"))


def scrubbed_films(raw: DataFrame, read: Callable[[str, bytes], dict] | None = None) -> DataFrame:
    """FILM of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..functions import pixels

        for b in batches:
            yield pd.DataFrame([pixels.dicom_film(p, c, read) for p, c in zip(b["path"], b["content"])], columns=[x.strip().split(" ")[0] for x in re.sub("<[^>]*>", "", FILM).split(",")])

    return raw.mapInPandas(run, FILM)
