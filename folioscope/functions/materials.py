"""What a value was measured in, from the words around it, and whether it was calculated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import fold, unspaced, words

# Words of specimens, folded, in the order in which they are tried.
SPECIMENS = {
    "urine": r"\b(urin\w*|моч\w*|сеч\w*|orina|ουρ\w*)",
    "stool": r"\b(stool|f[ae]eces|кал|копрограм\w*|heces|κοπραν\w*)\b",
    "semen": r"\b(semen|sperm\w*|спермограм\w*|эякул\w*|еякул\w*|esperma|σπερμ\w*)",
    "saliva": r"\b(saliva|слюн\w*|слин\w*|σαλιο\w*)",
    "smear": r"\b(smear|swab|мазок|мазк\w*|frotis|επιχρισμ\w*)",
    "liquor": r"\b(csf|cerebrospinal|ликвор|ликвор\w*|liquido cefalorraquideo)",
    "sputum": r"\b(sputum|мокрот\w*|esputo)",
    "blood": r"\b(blood|serum|plasma|кров\w*|сыворот\w*|сироватк\w*|плазм\w*|sangre|suero|αιμα\w*|ορο[σς])",
}
DERIVED = r"\b(egfr|gfr|скф|шкф|filtration|filtrado|clearance|клиренс\w*|кліренс\w*|calculated|расчет\w*|розрах\w*|calculad\w*)\b"


def _says(text: Column, pattern: str) -> Column:
    """In the text as it is, closed up, folded, or both."""
    forms = [text, unspaced(text), fold(text), fold(unspaced(text))]
    out = F.lit(False)
    for form in forms:
        out = out | F.coalesce(form.rlike("(?iU)" + pattern), F.lit(False))
    return out


def material_of(heading: Column, name: Column, snippet: Column, title: Column, title_before: Column) -> Column:
    """The first specimen that the heading names, else the name, the line, the title, or the title
    that this document carries on from.  Blood is taken from headings and titles only: too many
    tests have it in their names."""
    found = []
    for text, blood in ((heading, True), (name, False), (snippet, False), (title, True), (title_before, True)):
        choice = None
        for specimen, pattern in SPECIMENS.items():
            if specimen == "blood" and not blood:
                continue
            hit = _says(text, pattern)
            choice = F.when(hit, specimen) if choice is None else choice.when(hit, specimen)
        found.append(choice)
    return F.coalesce(*found)


def settled_material(person: Column, table: Column, word: Column, panel: Column, no_sample: Column) -> Column:
    """struct(material, source) by precedence: a person's word, a table that runs sideways, a printed
    word, the panel; else whether there is no sample at all, else unknown."""
    said = lambda c, source: F.when(c.isNotNull(), F.struct(c.alias("material"), F.lit(source).alias("source")))
    none = F.struct(F.lit(None).cast("string").alias("material"), F.when(no_sample, "no sample").otherwise("unknown").alias("source"))
    return F.coalesce(said(person, "person"), said(table, "table"), said(word, "printed"), said(panel, "panel"), none)


def is_derived(name: Column, unit: Column, heading: Column) -> Column:
    """Whether a value is a calculated rate, by its name, its unit per 1.73 m2, or its heading."""
    per_surface = F.coalesce(unit.rlike(r"1[.,]73"), F.lit(False))
    return per_surface | _says(name, DERIVED) | _says(heading, DERIVED)


def specimen_word(name: Column) -> Column:
    return F.trim(name).rlike("(?iU)^(" + "|".join(SPECIMENS.values()) + ")$")


def inverted_tables(rows: DataFrame, heading: str = "heading", name: str = "name") -> DataFrame:
    """The headings of tables that run sideways: of several words, and every row under them is named for
    a specimen and not for a test.  One row a heading."""
    told = rows.where(F.trim(F.coalesce(F.col(heading), F.lit(""))) != "").groupBy(F.trim(heading).alias("heading"))
    every = told.agg(F.bool_and(F.coalesce(specimen_word(F.col(name)), F.lit(False))).alias("sideways"))
    return every.where(F.col("sideways") & (F.size(words(fold(F.col("heading")))) > 1)).select("heading")


def heading_tests(headings: DataFrame, names: DataFrame, heading: str = "heading") -> DataFrame:
    """(heading, indicator_id): the test that a heading names, a unit behind it left out: the longest of
    its beginnings, word by word, that is a folded name in names(name, indicator_id)."""
    read = headings.select(F.col(heading).alias("_heading"), F.split(fold(F.col(heading)), r"\s+").alias("_parts"))
    beginnings = F.transform(F.sequence(F.lit(1), F.size("_parts")), lambda n: F.array_join(F.slice("_parts", 1, n), " "))
    cuts = read.select(F.col("_heading").alias("heading"), F.posexplode(beginnings).alias("n", "name"))
    known = names.select(fold(F.col("name")).alias("name"), "indicator_id").groupBy("name").agg(F.min("indicator_id").alias("indicator_id"))
    return cuts.join(known, "name").groupBy("heading").agg(F.max_by("indicator_id", "n").alias("indicator_id"))
