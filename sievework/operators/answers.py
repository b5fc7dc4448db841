"""Generated answers: strict schemas with the faults of each field, citations, and the metrics of a set of answers.

Answers are read as VARIANT, so the types that a model wrote are known, and all
checks are column expressions. A field may be given as another type where that
loses nothing: whole numbers as text or decimals, truth values as 0, 1 or words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import repair

LEVELS = ("high", "medium", "low")
# Words that stand for truth values.
TRUE = ("1", "true", "t", "yes", "y", "on")
FALSE = ("0", "false", "f", "no", "n", "off")


def _at(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def _text(value: Column) -> Column:
    return _at(value, "$", "string")


def _is_whole(value: Column) -> Column:
    return ~_is(value, "OBJECT") & ~_is(value, "ARRAY") & F.coalesce(_whole(value).isNotNull(), F.lit(False))


def _whole(value: Column) -> Column:
    """A whole number, or null."""
    written = F.trim(_text(value))
    digits = F.regexp_extract(written, r"^([+-]?\d+)(?:\.0*)?$", 1)
    return F.when(_is(value, "BOOLEAN"), (written == "true").cast("long")).otherwise(digits.try_cast("long"))


def _truth(value: Column) -> Column:
    """A truth value, or null."""
    word = F.lower(_text(value))
    told = F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)
    decimal = F.when(_text(value).try_cast("double") == 1, True).when(_text(value).try_cast("double") == 0, False)
    return F.when(_is(value, "BOOLEAN") | _is(value, "STRING"), told).when(_is(value, "BIGINT") | _is(value, "DECIMAL") | _is(value, "DOUBLE"), decimal)


def _keys(value: Column) -> Column:
    return F.json_object_keys(F.to_json(value))


@dataclass(frozen=True)
class Field:
    """A field of a schema: its kind (texts, whole_numbers, cases, text, level, truth); lists may be absent, others not."""

    name: str
    kind: str

    @property
    def listed(self) -> bool:
        return self.kind in ("texts", "whole_numbers", "cases")

    def fault(self, answer: Column) -> Column:
        """'missing', 'type', 'value' or null."""
        value = _at(answer, f"$.{self.name}")
        if self.listed:
            items = _at(value, "$", "array<variant>")
            one = {"texts": lambda x: _is(x, "STRING"), "whole_numbers": _is_whole, "cases": _is_case}[self.kind]
            return F.when(value.isNull(), None).when(~_is(value, "ARRAY"), "type").when(~F.forall(items, one), "type")
        if self.kind == "text":
            bad = F.when(~_is(value, "STRING"), "type")
        elif self.kind == "level":
            bad = F.when(~_is(value, "STRING"), "type").when(~_text(value).isin(*LEVELS), "value")
        else:
            bad = F.when(_truth(value).isNull(), "type")
        return F.when(value.isNull(), "missing").otherwise(bad)

    def read(self, answer: Column) -> Column:
        value = _at(answer, f"$.{self.name}")
        items = F.coalesce(_at(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        if self.kind == "texts":
            return F.transform(items, _text)
        if self.kind == "whole_numbers":
            return F.transform(items, _whole)
        if self.kind == "cases":
            return F.transform(items, lambda x: _at(x, "$.case_id", "string"))
        return _truth(value) if self.kind == "truth" else _text(value)


def _is_case(item: Column) -> Column:
    """An object of the texts case_id and reason, and of nothing else."""
    named = F.coalesce(F.array_sort(_keys(item)) == F.array(F.lit("case_id"), F.lit("reason")), F.lit(False))
    return _is(item, "OBJECT") & named & _is(_at(item, "$.case_id"), "STRING") & _is(_at(item, "$.reason"), "STRING")


# The fields of a full and of a simplified analysis.
FULL = (
    Field("predicted_accusations", "texts"),
    Field("relevant_articles", "whole_numbers"),
    Field("key_facts", "texts"),
    Field("missing_information", "texts"),
    Field("similar_cases", "cases"),
    Field("analysis", "text"),
    Field("confidence", "level"),
    Field("requires_manual_review", "truth"),
)
SIMPLIFIED = (Field("candidate_accusations", "texts"), Field("key_facts", "texts"), Field("confidence", "level"), Field("requires_manual_review", "truth"))


def faults(json_text: Column, answer: Column, schema: tuple[Field, ...] = FULL) -> Column:
    """What is wrong with an answer, in the order of the schema: 'not_an_object', or 'extra:' and 'field:fault' entries; empty if valid.

    ``answer`` is the VARIANT of ``json_text``. An object that names a field twice is no object.
    """
    extra = F.transform(F.array_sort(F.array_except(F.json_object_keys(json_text), F.array(*[F.lit(f.name) for f in schema]))), lambda k: F.concat(F.lit("extra:"), k))
    own = F.array_compact(F.array(*[F.concat(F.lit(f"{f.name}:"), f.fault(answer)) for f in schema]))
    return F.when(~_is(answer, "OBJECT"), F.array(F.lit("not_an_object"))).otherwise(F.concat(own, F.coalesce(extra, F.array().cast("array<string>"))))


def parsed(answers: DataFrame, output: str) -> DataFrame:
    """answers with found (text of the JSON object, or null), readable, and for each of full, simplified and repaired a struct of faults and the schema's fields.

    Fields of an invalid answer are null. Repair gives known spellings of keys and values their canonical form first.
    """
    texts = answers.withColumn("found", repair.extract_json_object(F.col(output))).withColumn("__fixed", repair.canonicalize_output(F.col(output)))
    read = texts.withColumn("__raw", F.try_parse_json("found")).withColumn("__new", F.try_parse_json("__fixed")).withColumn("readable", F.col("__raw").isNotNull())

    def checked(text: str, value: str, schema: tuple[Field, ...]) -> Column:
        wrong = faults(F.col(text), F.col(value), schema)
        ok = F.size(wrong) == 0
        return F.struct(wrong.alias("faults"), *[F.when(ok, f.read(F.col(value))).alias(f.name) for f in schema])

    shapes = {"full": checked("found", "__raw", FULL), "simplified": checked("found", "__raw", SIMPLIFIED), "repaired": checked("__fixed", "__new", SIMPLIFIED)}
    return read.withColumns(shapes).drop("__raw", "__new", "__fixed")


def citation_faults(cases: Column, articles: Column, retrieved_cases: Column, retrieved_articles: Column) -> Column:
    """STRUCT<valid, invalid_case_ids, invalid_articles>: citations of what was not retrieved, each as often as it is made."""
    none = F.array()
    wrong_cases = F.filter(cases, lambda c: ~F.array_contains(F.coalesce(retrieved_cases, none.cast("array<string>")), c))
    wrong_articles = F.transform(F.filter(articles, lambda a: ~F.array_contains(F.coalesce(retrieved_articles, none.cast("array<bigint>")), a)), lambda a: a.cast("string"))
    return F.struct((F.size(wrong_cases) + F.size(wrong_articles) == 0).alias("valid"), wrong_cases.alias("invalid_case_ids"), wrong_articles.alias("invalid_articles"))


def evaluation(rows: DataFrame, reference: str, known: Column, cases: str, articles: str, groups: list[str] = ()) -> DataFrame:
    """Metrics of parsed() answers, of all rows or of each group, in one aggregation.

    ``reference`` holds the right labels, ``known`` the labels that count, ``cases``
    and ``articles`` what was retrieved. An invalid answer predicts no label. Micro-F1
    counts labels of whole sets; it is 0 where there is nothing to count. Of the
    outputs without JSON (no_or_truncated_json), unreadable_json have an object that can't be read.
    """
    gold = F.array_intersect(reference, known)
    forms = {"full": "predicted_accusations", "simplified": "candidate_accusations", "repaired": "candidate_accusations"}
    counts, out = [], []
    for form, field in forms.items():
        told = F.array_intersect(F.coalesce(F.col(f"{form}.{field}"), F.array().cast("array<string>")), known)
        counts += [F.size(F.array_intersect(gold, told)).alias(f"{form}_tp"), (F.size(told) + F.size(gold)).alias(f"{form}_told"), (F.size(f"{form}.faults") == 0).alias(f"{form}_ok")]
        both = F.sum(f"{form}_told")
        out += [F.avg(F.col(f"{form}_ok").cast("int")).alias(f"{form}_schema_rate"), F.when(both == 0, 0.0).otherwise(2.0 * F.sum(f"{form}_tp") / both).alias(f"{form}_micro_f1")]
    cited = citation_faults(F.col("full.similar_cases"), F.col("full.relevant_articles"), F.col(cases), F.col(articles))
    marked = rows.withColumn("__c", cited).select(*groups, "readable", "found", *counts, "__c")
    shares = [F.avg(F.col("readable").cast("int")).alias("json_rate"), *out, F.avg(F.coalesce(F.col("full_ok") & F.col("__c.valid"), F.lit(False)).cast("int")).alias("grounded_rate")]
    numbers = [
        F.coalesce(F.sum(F.when(F.col("full_ok"), F.size("__c.invalid_case_ids") + F.size("__c.invalid_articles"))), F.lit(0)).alias("unsupported_citations"),
        F.count_if(~F.col("readable")).alias("no_or_truncated_json"),
        F.count_if(~F.col("readable") & F.col("found").isNotNull()).alias("unreadable_json"),
        F.count_if(~F.col("full_ok")).alias("full_schema_invalid"),
        F.count_if(~F.col("simplified_ok")).alias("simplified_schema_invalid"),
    ]
    done = marked.groupBy(*groups).agg(F.count("*").alias("rows"), *shares, *numbers)
    rates = [c for c in done.columns if c.endswith("_rate") or c.endswith("_f1")]
    return done.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in rates})


def fault_histogram(rows: DataFrame, form: str = "full") -> DataFrame:
    """fault, n of parsed() answers."""
    return rows.select(F.explode(f"{form}.faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))
