"""Rules over single texts: classes, dates, obligations, contradictions, gates. A matter's whole analysis is in `casefile`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Keyword weights by document class, in order of declaration.
CLASS_KEYWORDS: list[tuple[str, list[tuple[str, int]]]] = [
    ("contract", [("contrat de travail", 3), ("remuneration", 2), ("employeur", 2), ("salaire mensuel", 2), ("salarie", 1)]),
    ("letter", [("licenciement", 3), ("notification", 2), ("par la presente", 2), ("madame", 1), ("monsieur", 1), ("objet:", 1)]),
    ("payslip", [("bulletin de paie", 3), ("salaire brut", 2), ("cotisations", 2), ("payslip", 2)]),
    ("correspondence", [("courriel", 2), ("correspondance", 2), ("e-mail", 1), ("email", 1)]),
    ("judgment", [("tribunal", 2), ("jugement", 3), ("cour d'appel", 3), ("decision de justice", 2)]),
    ("statute_copy", [("code du travail", 3), ("dahir", 2), ("bulletin officiel", 2)]),
]
CLASS_THRESHOLD = 2
#: Patterns and words of the extraction rules.
PERSON = r"(?iuU)\b(?:Mr|Mrs|Ms|M\.|Mme|Me)\.?\s+([A-ZÀ-Þ][\wÀ-ÿ'’-]+(?:\s+[A-ZÀ-Þ][\wÀ-ÿ'’-]+){0,2})"
#: A name starts where its run of name characters has its first letter; runs and spaces are taken whole, so no word is tried letter by letter.
COMPANY = r"(?iuU)(?:\G|(?<![\wÀ-ÿ'’&.-]))(?:(?![A-ZÀ-Þ])[\wÀ-ÿ'’&.-])*+([A-ZÀ-Þ][\wÀ-ÿ'’&.-]*+(?:\s++[A-ZÀ-Þ][\wÀ-ÿ'’&.-]*+){0,3}\s++(?:SARL|SA\b|SAS|LLC|Inc\.?|Ltd\.?))"
DATE = r"\b(\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{2,4})\b"
DURATION = r"(?i)(\d+\s*(?:months?|mois))"
OBLIGATIONS = ["will be paid", "shall pay", "must pay", "doit payer", "notice period"]
EXPECTED_TYPES, PAYSLIPS = ["contract", "letter", "correspondence"], 3
GREETINGS = [
    "hello", "hi", "hey", "hello there", "thanks", "thank you", "who are you", "what are you", "good morning", "good afternoon", "good evening",
    "bonjour", "salut", "merci", "bonsoir", "qui etes vous", "qui êtes vous",
    "سلام", "مرحبا", "مرحباً", "شكرا", "شكراً", "السلام عليكم", "سلام عليكم", "من انت", "من أنت",
    "salam", "azul", "labas", "la bas", "cava", "ca va", "ça va",
]
GREETING_CHARS = 40
TOOLS = ["search_matter", "search_authority", "search_both", "out_of_scope"]
EVIDENCE_MARKS = ["[matter:", "¶"]


def any_of(c: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles])


def classify(c: Column, keywords=None, threshold: int = CLASS_THRESHOLD) -> Column:
    """Class of the greatest keyword score; the class declared first wins a tie; below the threshold unknown."""
    low = F.lower(c)
    scores = [F.struct(sum((F.when(F.contains(low, F.lit(w)), n).otherwise(0) for w, n in words), F.lit(0)).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name")) for i, (name, words) in enumerate(keywords or CLASS_KEYWORDS)]
    best = F.array_max(F.array(*scores))
    return F.when(best["score"] >= threshold, best["name"]).otherwise("unknown")


def glossary(c: Column, terms: list[str]) -> Column:
    """How many of the terms a text holds."""
    low = F.lower(c)
    return sum((F.coalesce(F.contains(low, F.lit(t.lower())), F.lit(False)).cast("long") for t in terms), F.lit(0).cast("long"))


def dates(sections: DataFrame, *carry: str) -> DataFrame:
    """section, the carried columns, at, date, label; the label looks at the 30 characters before the date, which five dates before it and what
    lies between them fill."""
    rows = sections.withColumns({"_g": F.split("text", DATE, -1), "_h": F.regexp_extract_all("text", F.lit(DATE), F.lit(1))}).select("section", *carry, "_g", "_h", F.posexplode("_h").alias("i", "date"))
    parts = [F.coalesce(F.get(c, F.col("i") - k), F.lit("")) for k in range(5, 0, -1) for c in ("_g", "_h")]
    around = F.lower(F.right(F.concat(*parts, F.get("_g", F.col("i"))), F.lit(30)))
    label = F.when(around.rlike("notice|préavis|pré-avis"), "notice date").when(around.rlike("effect|partir"), "effective date").otherwise("mentioned date")
    return rows.select("section", *carry, F.col("i").alias("at"), "date", label.alias("label"))


def obligations(sections: DataFrame) -> DataFrame:
    found = sections.select("section", F.posexplode(F.split("text", r"(?<=[.!;])(?U)\s+")).alias("at", "s"))
    return found.where(any_of(F.lower("s"), OBLIGATIONS)).select("section", "at", T.strip(F.col("s")).alias("what"))


def contradictions(sections: DataFrame) -> DataFrame:
    """Pairs of different durations that different sections give for the notice period; one equi-join on the topic."""
    noticed = sections.where(F.lower("text").rlike("notice period|préavis"))
    said = noticed.select("matter", "section", F.posexplode(F.transform(F.regexp_extract_all("text", F.lit(DURATION), F.lit(1)), lambda x: F.lower(x))).alias("at", "value"))
    a, b = said.alias("a"), said.alias("b")
    later = (F.col("a.section") < F.col("b.section")) & (F.col("a.value") != F.col("b.value"))
    return a.join(b, (F.col("a.matter") == F.col("b.matter")) & later).select(F.col("a.matter").alias("matter"), F.col("a.section").alias("a_section"), F.col("a.value").alias("a_value"), F.col("b.section").alias("b_section"), F.col("b.value").alias("b_value"))


def greeting(c: Column) -> Column:
    low = greeting_form(c)
    return (F.length(low) <= GREETING_CHARS) & low.isin(GREETINGS)


def greeting_form(c: Column) -> Column:
    return T.collapse(F.regexp_replace(F.lower(c), r"[\p{Punct}،؟؛«»‹›…—–]+", " "))


def greeting_lang(c: Column) -> Column:
    """en, fr or ar of a greeting that says so; null for others and for transliterated ones."""
    low = greeting_form(c)
    of = lambda words: low.isin(words)
    return F.when(of([w for w in GREETINGS[11:17]]), "fr").when(of([w for w in GREETINGS[17:26]]), "ar").when(of(GREETINGS[:11]), "en")


def intent(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.when(F.contains(low, F.lit("out_of_scope")) & ~F.contains(low, F.lit("in_scope")), "OUT_OF_SCOPE").otherwise("IN_SCOPE")


def privacy(evidence: Column, external: Column, mode: Column, consent: Column) -> Column:
    return F.when(~evidence, "ok").when(~external, "ok").when(mode == "strict", "violation").when(~consent, "consent-needed").otherwise("ok")


def tool_call(c: Column) -> Column:
    """struct(tool, query) of the text if it is an envelope as a whole, else of the first block in it that is one; null without any. Both
    fields must be strings, the tool known and the query not blank; white space around it goes."""
    whole = T.strip(c)
    blocks = F.concat(F.array(whole), F.regexp_extract_all(whole, F.lit(r'(\{[^{}]*"tool"[^{}]*\})'), F.lit(1)))

    def envelope(x):
        v = F.try_parse_json(x)
        text = lambda name: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))
        asked = T.strip(text("query"))
        return F.when(text("tool").isin(TOOLS) & (F.length(asked) > 0), F.struct(text("tool").alias("tool"), asked.alias("query")))

    return F.get(F.array_compact(F.transform(blocks, envelope)), F.lit(0))
