"""Data-quality rules: each is a function of the subject tables that gives findings.

Subject tables (columns that a rule does not name may be missing):
  documents(document_id, file_id, date, doc_type, title, provider, institution_was, transcribed, due,
            date_flags array, page_dates array<date>, birth_dates array<date>, pages array<int>)
  values(observation_id, document_id, page, name, value, value_numeric, comparator, value_kind, value_role,
         unit, reference, reference_low, reference_high, column_heading, snippet, indicator_id, material, date)
  pages(document_id, page, sent, got, as_text, tabular)      unreadable(document_id, page)
  indicators(indicator_id, spelling)
A finding is (rule, document_id, page, line); page and line may be null.

A rule of rows is a condition on a table's row, and all those asked for are one select over it, whose
array of findings is exploded: one scan, however many rules.  A rule of groups makes its findings
itself, out of tables that prepared() has read and parsed once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions.dates import quoted_dates
from ..functions.eyes import measurements_named, the_eye_alone
from ..functions.parsing import GRAMS, MOLAR_MASS, MOLES, on_distinct, printed_ends, unit_key, unit_of_range
from ..functions.text import WORD, fold, mixed_script_words, words
from ..session import staged
from . import copies, suspects

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Rule:
    name: str
    step: str
    subject: str
    find: Callable[..., DataFrame] | None = None
    on: bool = True
    thresholds: dict = field(default_factory=dict)
    weight: int = 1
    base: str = ""
    holds: Callable[..., Column] | None = None
    line: Callable[[], Column] | None = None


REGISTRY: dict[str, Rule] = {}


def rule(name: str, step: str, subject: str = "document", on: bool = True, weight: int = 1, **thresholds):
    """A rule of groups: a function of the prepared tables that gives findings."""

    def note(f):
        REGISTRY[name] = Rule(name, step, subject, f, on, thresholds, weight)
        return f

    return note


def row_rule(name: str, step: str, base: str, subject: str = "document", on: bool = True, weight: int = 1, line: Callable[[], Column] | None = None, **thresholds):
    """A rule of rows: a condition on a row of the prepared table `base`."""

    def note(f):
        REGISTRY[name] = Rule(name, step, subject, None, on, thresholds, weight, base, f, line)
        return f

    return note


def _read_reference(reference: str | None, unit: str | None) -> dict:
    """All that a printed range and a unit say, read once."""
    ends = printed_ends(reference, unit) or {}
    low, high = ends.get("low"), ends.get("high")
    reversed_ = low is not None and high is not None and low > high
    closed = {"r_low": None, "r_high": None} if reversed_ else {"r_low": low, "r_high": high}
    return closed | {"r_reversed": reversed_, "r_names": unit_of_range(reference), "unit_key": unit_key(unit)}


def _or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def _word_count(column: str) -> Column:
    return F.regexp_count(_or_empty(column), F.lit(WORD))


class Prepared:
    """The subject tables with what the rules read of them, each made once and only if a rule asks."""

    def __init__(self, tables: Tables, kept: bool) -> None:
        self._tables, self._kept = tables, kept

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name) if name in ("values", "met", "units") else self._tables[name]

    def _keep(self, df: DataFrame) -> DataFrame:
        """Rules of groups read it again, each its own columns: written once, if there are several."""
        return staged(df) if self._kept else df

    @cached_property
    def values(self) -> DataFrame:
        """values with what its range and its unit say: r_low, r_high, r_reversed, r_names, unit_key."""
        said = "r_low double, r_high double, r_reversed boolean, r_names string, unit_key string"
        return self._keep(on_distinct(self._tables["values"], ["reference", "unit"], _read_reference, said))

    @cached_property
    def met(self) -> DataFrame:
        """Values with their pages, both without blanks and with their numbers cut out, once each."""
        packed = lambda c: F.regexp_replace(_or_empty(c), r"\s+", "")
        numbers = lambda c: F.transform(N.number_tokens(_or_empty(c)), lambda x: F.regexp_replace(x, r"\s+", ""))
        own = self.values.select(
            "document_id", "page", "value", "value_kind", "snippet", packed("value").alias("value_packed"), packed("reference").alias("reference_packed"),
            numbers("value").alias("value_numbers"), numbers("reference").alias("reference_numbers"),
        )
        pages = self._tables["pages"].select("document_id", "page", "as_text", packed("sent").alias("sent_packed"), packed("got").alias("got_packed"), _word_count("sent").alias("sent_words"))
        return own.join(pages, ["document_id", "page"])

    @cached_property
    def units(self) -> DataFrame:
        """How often each test has each unit: (indicator_id, unit_key, n, numbered)."""
        own = self.values.where("indicator_id is not null")
        return self._keep(own.groupBy("indicator_id", "unit_key").agg(F.count(F.lit(1)).alias("n"), F.count("value_numeric").alias("numbered")))


def run(tables: Tables, *, only: list[str] | None = None, switched: dict[str, bool] | None = None, changed: dict[str, dict] | None = None) -> DataFrame:
    """Findings of the rules that are on, or of those in `only`; `switched` overrides what ships on, and
    `changed` thresholds.  Names that are not in the registry are errors."""
    switched, changed = switched or {}, changed or {}
    for name in [*(only or []), *switched, *changed]:
        if name not in REGISTRY:
            raise KeyError(f"no rule {name}")
    asked = [r for r in REGISTRY.values() if (r.name in only if only is not None else switched.get(r.name, r.on))]
    for r in asked:
        if unknown := set(changed.get(r.name, {})) - set(r.thresholds):
            raise KeyError(f"{r.name} has no threshold {sorted(unknown)}")
    limits = {r.name: r.thresholds | changed.get(r.name, {}) for r in asked}
    t = Prepared(tables, kept=sum(r.find is not None for r in asked) > 2)
    parts = []
    for base in dict.fromkeys(r.base for r in asked if r.holds):
        page = F.col("page").cast("int") if "page" in t[base].columns else F.lit(None).cast("int")
        told = [
            F.when(r.holds(**limits[r.name]), F.struct(F.lit(r.name).alias("rule"), page.alias("page"), (r.line() if r.line else F.lit(None)).cast("string").alias("line")))
            for r in asked
            if r.base == base and r.holds
        ]
        # The array itself is exploded: of an expression over it Spark asks first whether it is empty, and so evaluates every condition again.
        fired = t[base].select("document_id", F.explode(F.array(*told)).alias("f")).where("f is not null")
        parts.append(fired.select("f.rule", "document_id", "f.page", "f.line"))
    for r in (r for r in asked if r.find):
        found = r.find(t, **limits[r.name])
        pick = lambda c, kind: (F.col(c) if c in found.columns else F.lit(None)).cast(kind).alias(c)  # noqa: B023, E731
        parts.append(found.select(F.lit(r.name).alias("rule"), "document_id", pick("page", "int"), pick("line", "string")))
    return reduce(DataFrame.unionByName, parts)


def tally(findings: DataFrame) -> DataFrame:
    """(rule, findings, documents)."""
    by = findings.groupBy("rule", "document_id").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("rule").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("documents"))


def to_check(findings: DataFrame) -> DataFrame:
    """(document_id, codes, best): each document's rules in the registry's order, documents by the first of them."""
    order = F.array_position(F.array(*map(F.lit, REGISTRY)), F.col("rule"))
    coded = findings.select("document_id", F.struct(order.alias("place"), "rule").alias("c")).distinct()
    by = coded.groupBy("document_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return by.select("document_id", F.transform("c", lambda x: x["rule"]).alias("codes"), F.col("c")[0]["place"].alias("best"))


RESULT = "coalesce(value_role, 'result') = 'result'"


def _line(values: DataFrame) -> DataFrame:
    return values.select("document_id", "page", F.col("snippet").alias("line"))


def _scale() -> list[Column]:
    """What a number is compared over: its test, unit and material."""
    return [F.col("indicator_id"), F.coalesce("unit_key", F.lit("")).alias("_unit"), F.coalesce("material", F.lit("")).alias("_material")]


def _results(t: Prepared) -> DataFrame:
    return t["values"].where(F.expr(RESULT) & F.col("indicator_id").isNotNull())


def _far(a: Column, b: Column, apart_by: float) -> Column:
    return ~a.eqNullSafe(b) & ~F.coalesce(F.abs(a - b) <= apart_by, F.lit(False))


# ------------------------------------------------------------------ step validate, subject document


def _snippet() -> Column:
    return F.col("snippet")


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


@row_rule("number_differs", "validate", "values", line=_snippet)
def number_differs():
    return F.col("value_numeric").isNotNull() & N.number_differs(F.col("value"), F.col("value_numeric"))


@row_rule("comparator_missing", "validate", "values", line=_snippet)
def comparator_missing():
    return N.comparator_printed(F.col("value")).isNotNull() != F.col("comparator").isNotNull()


@row_rule("quantitative_without_number", "validate", "values", line=_snippet)
def quantitative_without_number():
    return (F.col("value_kind") == "quantitative") & (F.size(N.number_tokens(F.coalesce("value", F.lit("")))) == 0)


@row_rule("reference_reversed", "validate", "values", line=_snippet)
def reference_reversed():
    return F.col("r_reversed")


@row_rule("range_read_two_ways", "validate", "values", line=_snippet, apart_by=0.0)
def range_read_two_ways(apart_by):
    read = (F.col("r_low").isNotNull() | F.col("r_high").isNotNull()) & (F.col("reference_low").isNotNull() | F.col("reference_high").isNotNull())
    return read & (_far(F.col("r_low"), F.col("reference_low"), apart_by) | _far(F.col("r_high"), F.col("reference_high"), apart_by))


@rule("row_without_result", "validate")
def row_without_result(t):
    return t["values"].groupBy("document_id", "page", F.col("name").alias("line")).agg(F.bool_or(F.expr(RESULT)).alias("any")).where("not any")


@rule("repeated_value", "validate")
def repeated_value(t):
    keys = ["document_id", "page", "name", "value", "unit"]
    more = t["values"].groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return more.select("document_id", "page", F.col("name").alias("line"), F.explode(F.sequence(F.lit(2), F.col("n"))).alias("k"))


@row_rule("named_after_the_eye", "validate", "values", line=_snippet)
def named_after_the_eye():
    return the_eye_alone(F.col("name")).isNotNull() & (F.size(measurements_named(F.col("snippet"))) > 0)


@row_rule("several_measurements_in_one_value", "validate", "values", line=_snippet)
def several_measurements_in_one_value():
    return F.size(measurements_named(F.col("value"))) > 1


@row_rule("dates_far_apart", "validate", "documents", most_days=60)
def dates_far_apart(most_days):
    return F.datediff(F.array_max("page_dates"), F.array_min("page_dates")) > most_days


@row_rule("date_to_check", "validate", "documents", line=lambda: F.concat_ws(",", "date_flags"))
def date_to_check():
    return F.size("date_flags") > 0


@rule("lab_without_values", "validate")
def lab_without_values(t):
    return t["documents"].where("doc_type = 'lab_panel' and due").join(t["values"], "document_id", "left_anti").select("document_id")


@row_rule("unreadable_parts", "validate", "unreadable")
def unreadable_parts():
    return F.lit(True)


# ------------------------------------------------------------------ step validate, subject archive


@rule("possible_copy", "validate", "archive", least_shared=3, least_size=5, ratio=0.6, overlap=0.8)
def possible_copy(t, **limits):
    items = t["values"].where(RESULT).select(F.col("document_id").alias("document"), F.struct(fold(F.col("name")).alias("name"), "value").alias("item"))
    heads = t["documents"].select(F.col("document_id").alias("document"), F.col("file_id").alias("file"), "date")
    pairs = copies.possible_copies(heads, items, **limits)
    return pairs.select(F.explode(F.array(F.struct(F.col("a").alias("d"), F.col("b").alias("o")), F.struct(F.col("b").alias("d"), F.col("a").alias("o")))).alias("p")).select(
        F.col("p.d").alias("document_id"), F.col("p.o").cast("string").alias("line")
    )


@rule("range_powers_from_the_rest", "validate", "archive", on=False, least=5, agree=0.75, powers=1.5)
def range_powers_from_the_rest(t, **limits):
    closed = t["values"].where("indicator_id is not null and r_low > 0 and r_high > 0").withColumn("middle", F.sqrt(F.col("r_low") * F.col("r_high")))
    return _line(suspects.powers_from_the_rest(closed, "indicator_id", "middle", **limits))


# ------------------------------------------------------------------ step suspects


@rule("unit_missing_where_others_have_one", "suspects", "archive", on=False, least=4)
def unit_missing_where_others_have_one(t, least):
    """Numbers without a unit in tests of which at least `least` numbers have one."""
    return _line(_with_units_elsewhere(t).where(F.col("with_unit") >= least))


def _with_units_elsewhere(t: Prepared) -> DataFrame:
    have = t["units"].where("unit_key is not null").groupBy("indicator_id").agg(F.sum("numbered").alias("with_unit")).where("with_unit > 0")
    return t["values"].where("unit_key is null and value_numeric is not null").join(have, "indicator_id")


@rule("number_far_from_the_others", "suspects", "archive", weight=3, times=10.0, least=4)
def number_far_from_the_others(t, times, least):
    keyed = _results(t).select("document_id", "page", "snippet", "value_numeric", *_scale())
    return _line(suspects.far_from_median(keyed, ["indicator_id", "_unit", "_material"], "value_numeric", times, least))


@row_rule("institution_looks_like_a_name", "suspects", "documents", "archive", weight=3, line=lambda: F.col("institution_was"))
def institution_looks_like_a_name():
    return F.col("institution_was").isNotNull()


@row_rule("lab_form_without_a_title", "suspects", "documents", "archive", on=False)
def lab_form_without_a_title():
    return F.expr("doc_type = 'lab_panel' and transcribed and trim(coalesce(title, '')) = ''")


@rule("unit_alone_in_a_series", "suspects", "archive", weight=2, most=1, others=10)
def unit_alone_in_a_series(t, most, others):
    habit = t["units"].where("unit_key is not null").select("indicator_id", "unit_key", "n")
    total = habit.groupBy("indicator_id").agg(F.sum("n").alias("all"))
    alone = habit.join(total, "indicator_id").where((F.col("n") <= most) & (F.col("all") - F.col("n") >= others)).select("indicator_id", "unit_key")
    return _line(t["values"].join(alone, ["indicator_id", "unit_key"]))


@rule("value_names_another_test", "suspects", "archive", on=False, weight=2, letters=8)
def value_names_another_test(t, letters):
    """Spellings of one word meet the value's words; of several words, the value's text holds them whole."""
    spelled = t["indicators"].select(F.col("indicator_id").alias("other"), fold(F.col("spelling")).alias("s")).where(F.length("s") >= letters)
    spelled = spelled.withColumn("first", F.element_at(words(F.col("s")), 1))
    said = t["values"].withColumn("folded", fold(F.col("value"))).select("*", F.explode(F.array_distinct(words(F.col("folded")))).alias("first"))
    met = said.join(spelled, "first").where("other <> indicator_id")
    whole = F.contains(F.concat(F.lit(" "), F.concat_ws(" ", words(F.col("folded"))), F.lit(" ")), F.concat(F.lit(" "), F.concat_ws(" ", words(F.col("s"))), F.lit(" ")))
    return _line(met.where(whole).dropDuplicates(["observation_id"]))


# ------------------------------------------------------------------ step charts


@rule("two-scales-in-one-test", "charts", "series", same_band=0.15, least=2)
def two_scales_in_one_test(t, same_band, least):
    """Values whose range, times a power of ten, is the range that most of their test and unit have."""
    r = t["values"].where("indicator_id is not null and r_low > 0 and r_high > 0").withColumn("log", F.log10(F.sqrt(F.col("r_low") * F.col("r_high"))))
    r = r.withColumn("_unit", F.coalesce("unit", F.lit("")))
    usual = suspects.medians(r, ["indicator_id", "_unit"], "log").where(F.col("n") >= least).withColumnRenamed("median", "usual")
    met = r.join(usual, ["indicator_id", "_unit"]).withColumn("power", F.bround(F.col("log") - F.col("usual")))
    return _line(met.where((F.col("power") != 0) & (F.abs(F.col("log") - F.col("usual") - F.col("power")) <= F.log10(F.lit(1 + same_band)))))


@row_rule("unit_from_range", "charts", "values", "value", line=_snippet)
def unit_from_range():
    """Values without a unit whose range names one."""
    return F.col("unit_key").isNull() & F.col("r_names").isNotNull()


@row_rule("value_quoted_from_another_study", "charts", "values", "value", line=_snippet, least_days=31, ahead=3)
def value_quoted_from_another_study(least_days, ahead):
    """Values whose own line names a day at least a month from the document's date, and not after it."""
    return quoted_dates(F.col("snippet"), F.col("date"), least_days - 1, ahead).isNotNull()


@row_rule("one_scale_for_a_test", "charts", "values", "value", on=False, line=_snippet)
def one_scale_for_a_test():
    """Values that a molar conversion moves onto their test's scale: the name itself must say the analyte."""
    named = reduce(Column.__or__, [F.contains(F.lower("name"), F.lit(a)) for a in MOLAR_MASS])
    return F.col("unit_key").isin([u for u, f in MOLES.items() if f != 1]) | (F.col("unit_key").isin(list(GRAMS)) & named)


@rule("unit_by_numbers", "charts", "material", agreement=2.0, least_to_join=2)
def unit_by_numbers(t, agreement, least_to_join):
    """Values without a unit that lie within `agreement` of the spread of exactly one unit of their test and material."""
    v = _results(t).where("value_numeric > 0").withColumn("_material", F.coalesce("material", F.lit("")))
    printed = v.where("trim(coalesce(unit, '')) <> ''").groupBy("indicator_id", "_material", F.col("unit").alias("scale")).agg(
        F.min("value_numeric").alias("least"), F.max("value_numeric").alias("most"), F.count(F.lit(1)).alias("n")
    )
    printed = printed.where(F.col("n") >= least_to_join)
    met = v.where("trim(coalesce(unit, '')) = ''").join(printed, ["indicator_id", "_material"])
    fits = met.where((F.col("value_numeric") * agreement >= F.col("least")) & (F.col("value_numeric") <= F.col("most") * agreement))
    one = fits.groupBy("observation_id").agg(F.count(F.lit(1)).alias("k")).where("k = 1")
    return _line(v.join(one, "observation_id", "left_semi"))


# ------------------------------------------------------------------ step extract


@row_rule("page_text_missing", "extract", "pages", least=20)
def page_text_missing(least):
    return F.length(F.trim(_or_empty("got"))) < least


@row_rule("page_text_short", "extract", "pages", sent_words=40, share=0.5)
def page_text_short(sent_words, share):
    sent, got = _word_count("sent"), _word_count("got")
    return (sent > sent_words) & (got < share * sent)


@row_rule("page_numbers_missing", "extract", "pages", least=10, share=0.9)
def page_numbers_missing(least, share):
    sent = N.number_tokens(_or_empty("sent"))
    kept = F.filter(sent, lambda x: F.contains(_or_empty("got"), x))
    return (F.size(sent) >= least) & (F.size(kept) < share * F.size(sent))


@rule("table_page_without_values", "extract")
def table_page_without_values(t):
    labs = t["documents"].where("doc_type = 'lab_panel'").select("document_id")
    return t["pages"].where("tabular").join(labs, "document_id").join(t["values"], ["document_id", "page"], "left_anti").select("document_id", "page")


# What an organisation's name holds, and titles before a person's.
ORGANISATION = "laborator|clinic|hospital|center|centre|институт|клини|больниц|лікарн|лаборатор|центр|hospital|clínica|centro|κλινικ|νοσοκομ|εργαστ|ooo|ltd|gmbh|s\\.?a\\.?"
PERSON_TITLE = r"(?i)(?<!\p{L})(dr|prof|md|доктор|врач|лікар|проф|dra?|doctor|ιατρ\p{L}*)\.?(?!\p{L})"
INITIALS = r"\p{Lu}\p{Ll}+\s+\p{Lu}\.\s*\p{Lu}\.|\p{Lu}\.\s*\p{Lu}\.\s*\p{Lu}\p{Ll}+"


def looks_like_a_person(name: Column) -> Column:
    return ~F.lower(name).rlike(ORGANISATION) & (name.rlike(PERSON_TITLE) | name.rlike(INITIALS))


@row_rule("provider_reads_like_a_person", "extract", "documents", line=lambda: F.col("provider"))
def provider_reads_like_a_person():
    return looks_like_a_person(F.col("provider"))


def _two_alphabets() -> Column:
    return mixed_script_words(F.concat_ws(" ", "title", "provider"))


@row_rule("word_in_two_alphabets", "extract", "documents", line=lambda: F.concat_ws(",", _two_alphabets()))
def word_in_two_alphabets():
    return F.size(_two_alphabets()) > 0


def _absent(as_text: bool, column: str, against: str, numbers_only: bool) -> Column:
    """Whether `column` of a value has a number, or is as a whole, what the text of its page has not."""
    of_page = (F.coalesce("value_kind", F.lit("")) != "qualitative") & (F.col("as_text") == as_text)
    page = F.col(f"{against}_packed")
    if not numbers_only:
        return of_page & ~F.contains(page, F.col(f"{column}_packed"))
    return of_page & F.exists(f"{column}_numbers", lambda x: ~F.contains(page, x))


@row_rule("value_not_on_the_page", "extract", "met", line=_snippet, least_words=40)
def value_not_on_the_page(least_words):
    return (F.col("sent_words") >= least_words) & _absent(True, "value", "sent", True)


@row_rule("value_not_in_page_text", "extract", "met", line=_snippet)
def value_not_in_page_text():
    return _absent(True, "value", "got", False)


@row_rule("value_not_in_own_page_text", "extract", "met", line=_snippet)
def value_not_in_own_page_text():
    return _absent(False, "value", "got", False)


@row_rule("reference_not_in_page_text", "extract", "met", line=_snippet)
def reference_not_in_page_text():
    return _absent(True, "reference", "got", True)


@row_rule("reference_not_in_own_page_text", "extract", "met", line=_snippet)
def reference_not_in_own_page_text():
    return _absent(False, "reference", "got", True)


@row_rule("letters_in_numeric_value_on_image", "extract", "met", line=_snippet)
def letters_in_numeric_value_on_image():
    return (F.col("value_kind") == "quantitative") & ~F.col("as_text") & N.unexplained_letters(F.col("value"))


@row_rule("comparator_not_printed", "extract", "values", line=_snippet)
def comparator_not_printed():
    return F.col("comparator").isNotNull() & N.comparator_printed(F.col("value")).isNull()


@rule("no_column_headings_in_multi_value_rows", "extract")
def no_column_headings_in_multi_value_rows(t):
    rows = t["values"].groupBy("document_id", "page", F.col("snippet").alias("line"), "name").agg(F.count(F.lit(1)).alias("n"), F.count("column_heading").alias("headings"))
    return rows.where("n > 1 and headings = 0")


@row_rule("document_date_is_birth_date", "extract", "documents")
def document_date_is_birth_date():
    return F.array_contains("birth_dates", F.col("date"))


@rule("unreadable_on_images", "extract")
def unreadable_on_images(t):
    images = t["pages"].where("not as_text").select("document_id").distinct()
    return t["unreadable"].join(images, "document_id", "left_semi").select("document_id", "page")


# ------------------------------------------------------------------ what other thresholds would find


@dataclass(frozen=True)
class Metric:
    """What a threshold of a rule is held against: the rule finds a row whose metric is at least the
    threshold, or, if not `at_least`, below it (`strict`: above it, not equal)."""

    threshold: str
    of: Callable[..., DataFrame]
    at_least: bool = True
    strict: bool = False


def _ratio(t: Prepared, least: int) -> DataFrame:
    keyed = _results(t).where("value_numeric > 0").select("document_id", "value_numeric", *_scale())
    keys = ["indicator_id", "_unit", "_material"]
    met = keyed.join(suspects.medians(keyed, keys, "value_numeric").where(F.col("n") >= least), keys)
    x, middle = F.col("value_numeric"), F.col("median")
    return met.select("document_id", F.greatest(x / middle, middle / x).alias("metric"))


METRICS = {
    "number_far_from_the_others": Metric("times", lambda t, least: _ratio(t, least)),
    "unit_missing_where_others_have_one": Metric("least", lambda t: _with_units_elsewhere(t).select("document_id", F.col("with_unit").alias("metric"))),
    "dates_far_apart": Metric("most_days", lambda t: t["documents"].select("document_id", F.datediff(F.array_max("page_dates"), F.array_min("page_dates")).alias("metric")), strict=True),
    "page_text_missing": Metric("least", lambda t: t["pages"].select("document_id", F.length(F.trim(_or_empty("got"))).alias("metric")), at_least=False),
    "page_text_short": Metric("share", lambda t, sent_words: _share_of_words(t, sent_words), at_least=False),
    "value_quoted_from_another_study": Metric(
        "least_days", lambda t, ahead: t["values"].select("document_id", F.datediff("date", quoted_dates(F.col("snippet"), F.col("date"), 0, ahead)).alias("metric"))
    ),
}


def _share_of_words(t: Prepared, sent_words: int) -> DataFrame:
    sent, got = _word_count("sent"), _word_count("got")
    return t["pages"].where(sent > sent_words).select("document_id", (got / sent).alias("metric"))


def trial(tables: Tables, name: str, values: list[float], changed: dict | None = None) -> DataFrame:
    """(rule, threshold, findings, documents): what a rule would find at each of the values of its
    threshold, its other thresholds as shipped or as `changed`.

    One pass for all values: each row's metric is put into the band between two of them, rows are
    counted by document and band, and the counts run up from the band that fires last.  A document
    counts from its most telling row on.
    """
    metric = METRICS[name]
    limits = {k: v for k, v in (REGISTRY[name].thresholds | (changed or {})).items() if k != metric.threshold}
    ordered = sorted({float(v) for v in values}, reverse=not metric.at_least)  # the last one finds least
    x = F.col("metric").cast("double")
    reached = {(True, False): lambda v: x >= v, (True, True): lambda v: x > v, (False, False): lambda v: x < v, (False, True): lambda v: x <= v}[metric.at_least, metric.strict]
    rows = metric.of(Prepared(tables, kept=False), **limits).where("metric is not null")
    banded = rows.withColumn("band", F.size(F.filter(F.array(*map(F.lit, ordered)), reached))).where("band > 0")
    by_document = banded.groupBy("document_id", "band").agg(F.count(F.lit(1)).alias("n"))
    most = by_document.groupBy("document_id").agg(F.max("band").alias("band"))
    counted = by_document.select("band", "n", F.lit(0).cast("long").alias("d")).unionAll(most.select("band", F.lit(0).cast("long").alias("n"), F.lit(1).cast("long").alias("d")))
    counts = counted.groupBy("band").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    asked = rows.sparkSession.createDataFrame([(k, v) for k, v in enumerate(ordered, 1)], "place int, threshold double")
    met = asked.join(counts, F.col("band") >= F.col("place"), "left")  # as many rows as there are values, on both sides
    summed = met.groupBy("place", "threshold").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("findings"), F.coalesce(F.sum("d"), F.lit(0)).alias("documents"))
    return summed.select(F.lit(name).alias("rule"), "threshold", "findings", "documents")


# ------------------------------------------------------------------ summaries over what is open

# What summarises what.  A document that has any of the rules on the right has the one on the left.
SUMMARIES = {
    "transcription_incomplete": ["page_text_missing", "page_text_short", "page_numbers_missing", "unreadable_parts", "unreadable_on_images"],
    "value_not_on_the_page": ["value_not_in_page_text", "value_not_in_own_page_text", "reference_not_in_page_text", "reference_not_in_own_page_text"],
    "checks_still_failing": [
        "number_differs", "comparator_missing", "quantitative_without_number", "reference_reversed", "range_read_two_ways", "row_without_result", "repeated_value",
    ],
}


def open_summaries(findings: DataFrame, settled: DataFrame) -> DataFrame:
    """(summary, rule, findings, documents, only_here): open findings folded along SUMMARIES, by grouping sets:
    a row for each rule under its summary, one for each summary (rule null), one for all (both null).

    `settled` (document_id, rule) are findings that somebody has decided; they are not open.  Rules
    under no summary are under `other`.  only_here counts the documents that have open findings
    in this group and no other one of its level.
    """
    by_rule = {r: s for s, rs in SUMMARIES.items() for r in [*rs, s]}
    place = F.create_map(*[F.lit(x) for pair in by_rule.items() for x in pair])
    opened = findings.join(settled.select("document_id", "rule").distinct(), ["document_id", "rule"], "left_anti")
    opened = opened.withColumn("summary", F.coalesce(F.try_element_at(place, "rule"), F.lit("other")))
    by = opened.groupBy("document_id", "summary", "rule").agg(F.count(F.lit(1)).alias("n"))
    has = by.groupBy("document_id").agg(F.count(F.lit(1)).alias("rules"), F.count_distinct("summary").alias("summaries"))
    met = by.join(has, "document_id")
    sets = met.groupingSets([["summary", "rule"], ["summary"], []], "summary", "rule")
    alone = F.when(F.grouping("rule") == 0, F.count_distinct(F.when(F.col("rules") == 1, F.col("document_id")))).when(
        F.grouping("summary") == 0, F.count_distinct(F.when(F.col("summaries") == 1, F.col("document_id")))
    )
    counts = [F.sum("n").alias("findings"), F.count_distinct("document_id").alias("documents")]
    return sets.agg(*counts, F.coalesce(alone, F.count_distinct("document_id")).alias("only_here"))


__all__ = ["METRICS", "REGISTRY", "SUMMARIES", "Prepared", "Rule", "open_summaries", "run", "tally", "to_check", "trial"]
