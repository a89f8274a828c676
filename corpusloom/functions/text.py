"""Column functions over text: tokens, hashes, ids, language, direction, clean-up. All but nfkc run in the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
TOKEN = "[0-9a-zÀ-ɏͰ-ϿЀ-ӿ؀-ۿ]+"
SPARSE_DIM = 2048
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
ARABIC = r"؀-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-﻿"
HEBREW = r"֐-׿"
LATIN = "a-zA-ZàáâãäåçèéêëìíîïðñòóôõöùúûüýþÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖÙÚÛÜÝÞ"
FRENCH_ACCENTS = "éèêàçùîôâëï"
FRENCH_WORDS = ["le", "la", "les", "des", "une", "est", "pour", "dans", "avec", "votre", "vous", "dit"]
#: Texts that a batch has as Python strings at once.
SLICE = 256
NEWLINE_WEIGHT, SERVED_TOKENS = 4, 450


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    return F.lower(collapse(c))


def title(c: Column, size: int = 200) -> Column:
    return F.substring(collapse(c), 1, size)


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def hash_index(token: Column, dim: int = SPARSE_DIM) -> Column:
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % dim


def uuid5_url(name: Column) -> Column:
    """UUID of version 5 in the URL namespace."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def chunk_id(source: Column, version: Column, edition: Column, article: Column, text: Column, page: Column, ordinal: Column) -> Column:
    return F.concat_ws(":", source, version, edition, F.coalesce(article, F.lit("section")), F.substring(F.sha2(text, 256), 1, 16), F.concat(F.lit("p"), F.coalesce(page.try_cast("int"), F.lit(0))), F.concat(F.lit("o"), F.coalesce(ordinal.try_cast("int"), F.lit(0))))


def count_chars(c: Column, members: str) -> Column:
    return F.length(F.regexp_replace(c, f"[^{members}]+", "")).cast("long")


def detect_lang(c: Column) -> Column:
    """Characters are counted only where there are Arabic ones; the words are looked for as whole runs of letters, never split."""
    return (
        F.when(c.rlike(f"[{ARABIC}]") & (count_chars(c, ARABIC) > count_chars(c, LATIN)), "ar")
        .when(c.rlike(f"[{FRENCH_ACCENTS}]"), "fr")
        .when(c.rlike(f"(?i)(?<![a-zA-Z])(?:{'|'.join(FRENCH_WORDS)})(?![a-zA-Z])"), "fr")
        .otherwise("en")
    )


def detect_direction(c: Column) -> tuple[Column, Column]:
    """(direction, language)."""
    arabic, hebrew, latin = count_chars(c, ARABIC), count_chars(c, HEBREW), count_chars(c, LATIN)
    rtl = arabic + hebrew > latin
    lang = F.when(rtl & (hebrew > arabic), "he").when(rtl, "ar").when(F.lower(c).rlike(f"[{FRENCH_ACCENTS}]"), "fr").otherwise("en")
    return F.when(rtl, "rtl").otherwise("ltr"), lang


def served_estimate(tokens_: Column, text: Column) -> Column:
    return tokens_ + NEWLINE_WEIGHT * (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))))


def wire_safe(c: Column) -> Column:
    return F.translate(c, '"]', "')")


def fold_arabic(c: Column) -> Column:
    return F.translate(c, "٠١٢٣٤٥٦٧٨٩یکى", "0123456789يكي")


def safe_filename(c: Column, size: int = 180) -> Column:
    return F.substring(F.regexp_replace(c, r"(?U)[^\p{Alnum}\-_.]", "_"), 1, size)


def slug(c: Column, size: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, size)


def length_class(n: Column) -> Column:
    return F.when(n < 600, "short").when(n <= 1300, "medium").otherwise("long")


def middle_query(c: Column, least: int = 65, start: int = 25, size: int = 40) -> Column:
    words = F.split(collapse(c), " ")
    n = F.size(words)
    at = F.greatest(F.lit(start), F.floor(n / 2).cast("int") - 20)
    return F.when(n >= least, F.array_join(F.slice(words, at + 1, F.lit(size)), " "))


def sentences(c: Column) -> Column:
    return F.filter(F.split(c, r"(?<=[.!?\n])(?U)\s+"), lambda s: F.length(strip(s)) > 0)


def pack(pieces: Column, least: int = 1500, most: int = 2000) -> Column:
    """Greedy fold: pieces are joined by a space until their lengths reach `least`; the only piece, if longer than `most`, is sliced."""
    none = lambda: F.array().cast("array<string>")
    joined = lambda now: strip(F.array_join(now, " "))
    start = F.struct(none().alias("done"), none().alias("now"), F.lit(0).alias("n"))

    def step(a, x):
        now, n = F.array_append(a.now, x), a.n + F.length(x)
        full = n >= least
        return F.struct(F.when(full, F.array_append(a.done, joined(now))).otherwise(a.done).alias("done"), F.when(full, none()).otherwise(now).alias("now"), F.when(full, F.lit(0)).otherwise(n).alias("n"))

    packed = F.aggregate(pieces, start, step, lambda a: F.when(F.size(a.now) > 0, F.array_append(a.done, joined(a.now))).otherwise(a.done))
    alone = F.get(packed, F.lit(0))
    slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(alone) - 1) / least).cast("int")), lambda i: F.substring(alone, i * least + 1, F.lit(least)))
    return F.when((F.size(packed) == 1) & (F.length(alone) > most), slices).otherwise(packed)


def batch_plan(lengths: Column, texts: int = 32, chars: int = 24_000) -> Column:
    """Sizes of consecutive batches of at most `texts` texts and `chars` characters; a longer text is a batch of its own."""
    start = F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("n"))

    def step(a, x):
        close = (a.k > 0) & ((a.k >= texts) | (a.n + x > chars))
        return F.struct(F.when(close, F.array_append(a.done, a.k)).otherwise(a.done).alias("done"), F.when(close, F.lit(1)).otherwise(a.k + 1).alias("k"), F.when(close, x.cast("long")).otherwise(a.n + x).alias("n"))

    return F.aggregate(lengths, start, step, lambda a: F.when(a.k > 0, F.array_append(a.done, a.k)).otherwise(a.done))


def nfkc(c: Column) -> Column:
    """Compatibility composition; the JVM has no built-in for it, so texts that are not ASCII go through Arrow, of which SLICE at a time are
    strings of Python."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        parts = [pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in texts.slice(s, SLICE).to_pylist()], pa.string()) for s in range(0, len(texts), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, run(F.when(wide, c))).otherwise(c)
