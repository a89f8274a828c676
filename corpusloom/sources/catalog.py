"""File catalogues: listing with hashes, and provenance read from file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Instruments in the order of detection, folders, months, patterns.
INSTRUMENTS = [
    ("دستور", ["الدستور", "دستور", "costitution", "constitution"]),
    ("القانون التنظيمي", ["القانون التنظيمي"]),
    ("ظهير شريف", ["ظهير شريف"]),
    ("مرسوم", ["مرسوم"]),
    ("قرار", ["قرار"]),
    ("قانون", ["القانون", "قانون"]),
]
CIVIL, CIVIL_FOLDERS = "المادة المدنية", ["المادة العقارية", "المادة الكرائية", "المادة المدنية"]
CATEGORIES = [
    "المادة المدنية", "المادة التجارية", "مادة المعاملات الالكترونية", "المادة الأسرية", "مادة الحقوق والحريات",
    "مادة الوظيفة العمومية", "مادة التأمين و التقاعد", "المادة الجنائية",
]
HIJRI_MONTHS = [
    "محرم", "صفر", "ربيع الأول", "ربيع الآخر", "جمادى الأولى", "جمادى الثانية", "جمادى الآخرة", "رجب", "شعبان", "رمضان", "شوال",
    "ذي القعدة", "ذو القعدة", "ذى القعدة", "ذي الحجة", "ذو الحجة",
]
NUMBER = r"رقم\s*:?\s*([A-Za-z]?\s*[_\-]?\s*\d[\d.\-–—/]*)"
PAREN_DATE = r"\(([^)]*\d{3,4}[^)]*)\)"
BARE_DATE = r"(?U)(?:بتاريخ|الصادر في|صادر في|صادر بتاريخ|المؤرخ بتاريخ)\s*(\d{1,2}\s+\S+\s+\d{4})"
FRENCH = r"(?iU)ترجمة فرنسية|بالفرنسية|النسخة الفرنسية|version fran|traduction|\(fr\)|\bfr\b"


def scan(spark: SparkSession, folder: str, suffix: str = ".pdf") -> DataFrame:
    """path, size, sha256 of all files below folder whose name ends in suffix, whatever its case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower("path").endswith(suffix)).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def read_texts(spark: SparkSession, folder: str, limit: int = 20_000_000) -> DataFrame:
    """path, text, error of text files; a file above the limit or not UTF-8 is a row with an error, never a failure."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(F.col("length") <= limit, text).alias("text"), F.when(F.col("length") > limit, "too large").when(text.isNull(), "not utf-8").alias("error"))


def needs_ocr(text: Column, least: int = 20) -> Column:
    return F.length(T.strip(text)) < least


def stem(name: Column, size: int | None = 120) -> Column:
    s = T.collapse(F.regexp_replace(T.strip(name), r"(?i)\.pdf$", ""))
    return s if size is None else F.rtrim(F.substring(s, 1, size))


def law_type(full: Column) -> Column:
    folded = T.fold_arabic(full)
    cases = [(folded.startswith(v), t) for t, names in INSTRUMENTS for v in names] + [(F.contains(folded, F.lit(v)), t) for t, names in INSTRUMENTS for v in names]
    out = F.when(*cases[0])
    for test, t in cases[1:]:
        out = out.when(test, t)
    return out


def law_number(full: Column) -> Column:
    token = F.regexp_replace(F.regexp_replace(F.regexp_extract(full, NUMBER, 1), r"\s+", ""), r"^[.\-–—/]+|[.\-–—/]+$", "")
    return F.nullif(token, F.lit(""))


def hijri_date(full: Column) -> Column:
    months = "|".join(sorted((m.translate(str.maketrans("یکى", "يكي")) for m in HIJRI_MONTHS), key=len, reverse=True))
    pattern = rf"((?:فاتح|\d{{1,2}})\s+(?:من\s+)?(?:{months})\s+\d{{3,4}})"
    folded = T.fold_arabic(full)
    found = F.regexp_extract(folded, pattern, 1)
    # Folding maps one character to one, so the span found on the folded text cuts the original.
    return F.when(F.length(found) > 0, F.substring(full, F.position(found, folded), F.length(found)))


def gregorian_date(full: Column) -> Column:
    paren = F.regexp_replace(F.trim(F.regexp_extract(full, PAREN_DATE, 1)), r"^(?:صادر\s+)?(?:بتاريخ\s+)?", "")
    return F.coalesce(F.nullif(paren, F.lit("")), F.nullif(F.regexp_extract(full, BARE_DATE, 1), F.lit("")))


def category(folder: Column, kind: Column) -> Column:
    folded = T.fold_arabic(folder)
    has = lambda v: F.contains(folded, F.lit(v.translate(str.maketrans("یکى", "يكي"))))
    out = F.when((kind == "دستور") & (F.trim(folder) == ""), "دستور")
    for v in CIVIL_FOLDERS:
        out = out.when(has(v), CIVIL)
    for v in CATEGORIES:
        out = out.when(has(v), v)
    return out.when(F.trim(folder) != "", F.trim(folder)).otherwise("unknown")


def provenance(files: DataFrame) -> DataFrame:
    """files (filename, folder) with what their names tell; without an instrument a file is quarantined under its folder."""
    full = stem(F.col("filename"), None)
    rows = files.select("filename", "folder", full.alias("full"))
    f = F.col("full")
    kind = law_type(f)
    language = F.when(f.rlike(FRENCH), "fr").otherwise("ar")
    return rows.select(
        "filename", "folder", kind.alias("law_type"), law_number(f).alias("law_number"), hijri_date(f).alias("hijri_date"), gregorian_date(f).alias("gregorian_date"),
        language.alias("language"), F.when(language == "fr", "fr-translation").otherwise("ar-general").alias("edition"),
        F.coalesce(kind, F.col("folder")).alias("source"), F.when(kind.isNull(), stem(F.col("filename"))).otherwise(F.coalesce(law_number(f), stem(F.col("filename")))).alias("version"),
        category(F.col("folder"), kind).alias("category"), kind.isNull().alias("quarantined"),
    )
