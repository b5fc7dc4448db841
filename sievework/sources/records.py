"""Readers of case records in their several shapes, one schema for all of them."""

from __future__ import annotations

import ast
import json
import zipfile
from collections.abc import Iterator
from io import BytesIO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import normalize_text

_TERM = "struct<imprisonment:string,fine:string,death_penalty:boolean,life_imprisonment:boolean>"
#: All field names that a case record may have.
RAW = f"""
case_id string, id string, fact string, input string, text string, content string,
accusations array<string>, accusation array<string>, accusation_ids array<string>, relevant_articles array<string>, source_split string,
labels struct<accusations:array<string>,relevant_articles:array<string>,imprisonment_months:string,fine:string,life_imprisonment:boolean,death_penalty:boolean>,
meta struct<accusation:array<string>,relevant_articles:array<string>,term_of_imprisonment:{_TERM}>,
output struct<`罪名`:array<string>,`有期徒刑`:string,`是否死刑`:boolean,`是否无期`:boolean,`罚金`:string>
"""


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines; blank lines are skipped, a byte-order mark is dropped, bad lines fail unless not ``strict``."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    mode = "FAILFAST" if strict else "PERMISSIVE"
    return lines.select(F.from_json("value", schema, {"mode": mode}).alias("r")).where("r is not null").select("r.*")


def read_jsonl_head(spark: SparkSession, path: str, schema: str | T.StructType, limit: int) -> DataFrame:
    """The first ``limit`` good lines of a file in their order, with ``line``, their place in it (from 0).

    A file is read by as many tasks as it has blocks; the place in the file is
    the block's offset in it and the line's place in the block, kept as (part, line).
    """
    lines = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
    good = lines.select("__at", F.from_json(F.regexp_replace("value", "^\ufeff", ""), schema).alias("r"), F.trim("value").alias("v")).where("v <> '' and r is not null")
    head = good.orderBy("__at").limit(limit)
    return head.select(F.shiftright("__at", 33).alias("part"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("line"), "r.*")


def validated(raw: DataFrame, split: str, faults: Column, label_ids: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """Normalised cases of a split without faults, and those with some.

    ``faults`` is a list of names over the normalised columns, as violations() makes.
    """
    cases = normalized(raw, split, label_ids).withColumn("faults", faults)
    return cases.where(F.size("faults") == 0).drop("faults"), cases.where(F.size("faults") > 0)


def _first_text(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def _first_list(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.size(c) > 0, c) for c in columns], F.array().cast("array<string>"))


def normalized(raw: DataFrame, split: str | None = None, label_ids: dict[str, int] | None = None) -> DataFrame:
    """Case records of any of the shapes in RAW as one schema.

    Empty values fall through like missing ones; labels and numbers come
    distinct and sorted; a case without id gets one from the SHA-1 of its fact.
    """
    fact = normalize_text(F.coalesce(_first_text(F.col("fact"), F.col("input"), F.col("text"), F.col("content")), F.lit("")))
    stripped = F.filter(F.transform(_first_list(F.col("accusations"), F.col("accusation"), F.col("labels.accusations"), F.col("meta.accusation"), F.col("output.`罪名`")), lambda x: F.trim(x)), lambda x: x != "")
    labels = F.array_sort(F.array_distinct(stripped))
    numbers = F.filter(_first_list(F.col("relevant_articles"), F.col("labels.relevant_articles"), F.col("meta.relevant_articles")), lambda x: F.trim(x).rlike("^-*[0-9]+$"))
    articles = F.array_sort(F.array_distinct(F.transform(numbers, lambda x: F.trim(x).cast("int"))))
    given = F.array_sort(F.array_distinct(F.transform(F.filter(_first_list(F.col("accusation_ids")), lambda x: x.rlike("^[0-9]+$")), lambda x: x.cast("int"))))
    if label_ids:
        known = F.create_map(*[F.lit(x) for pair in label_ids.items() for x in pair])
        mapped = F.array_sort(F.array_distinct(F.array_compact(F.transform(F.col("accusations"), lambda x: F.element_at(known, x)))))
        ids = F.when(F.size("given") > 0, F.col("given")).otherwise(mapped)
    else:
        ids = F.col("given")
    term, old, nested = F.col("meta.term_of_imprisonment"), F.col("output"), F.col("labels")
    penalty = (
        F.when(term.isNotNull(), _penalty(term["imprisonment"], term["fine"], term["life_imprisonment"], term["death_penalty"]))
        .when(nested.isNotNull(), _penalty(nested["imprisonment_months"], nested["fine"], nested["life_imprisonment"], nested["death_penalty"]))
        .when(old.isNotNull(), _penalty(old["有期徒刑"], old["罚金"], old["是否无期"], old["是否死刑"]))
    )
    named = F.trim(_first_text(F.col("case_id"), F.col("id")))
    own_split = F.coalesce(F.lit(split), F.col("source_split")) if split else F.col("source_split")
    first = raw.select(named.alias("named"), fact.alias("fact"), labels.alias("accusations"), given.alias("given"), articles.alias("relevant_articles"), penalty.alias("penalty"), own_split.alias("source_split"))
    made = F.concat(F.lit(f"{split or 'case'}-"), F.substring(F.sha1("fact"), 1, 16))
    return first.select(F.coalesce(F.nullif("named", F.lit("")), made).alias("case_id"), "fact", "accusations", ids.alias("accusation_ids"), "relevant_articles", "penalty", "source_split")


def _penalty(months: Column, fine: Column, life: Column, death: Column) -> Column:
    """Signed months; fines of digits only; missing flags are false."""
    return F.struct(
        F.when(months.rlike("^-?[0-9]+$"), months.cast("int")).alias("imprisonment_months"),
        F.when(fine.rlike("^[0-9]+$"), fine.cast("long")).alias("fine"),
        F.coalesce(life, F.lit(False)).alias("life_imprisonment"),
        F.coalesce(death, F.lit(False)).alias("death_penalty"),
    )


_EXTERNAL = "source string, source_case_id string, fact string, accusations array<string>, relevant_articles array<string>, defendants array<string>, term string, fine string, alignment_reliable boolean"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with labels in ``meta``; a fine of null and no fine differ (fine_present)."""
    schema = "id string, fact string, meta struct<accusation:array<string>,relevant_articles:array<string>,term_of_imprisonment:struct<imprisonment:string,death_penalty:boolean,life_imprisonment:boolean>,punish_of_money:string>"
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.regexp_replace("value", "^﻿", "").alias("v"))
    rows = lines.select(F.from_json("v", schema).alias("r"), F.array_contains(F.json_object_keys(F.get_json_object("v", "$.meta")), "punish_of_money").alias("fine_present"))
    return rows.select("r.id", "r.fact", F.col("r.meta.accusation").alias("accusations"), F.col("r.meta.relevant_articles").alias("relevant_articles"), F.col("r.meta.term_of_imprisonment").alias("term"), F.col("r.meta.punish_of_money").alias("fine"), F.coalesce("fine_present", F.lit(False)).alias("fine_present"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """ZIP archives of JSON or JSON lines, one row a defendant; reliable if the fact names the defendant."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(BytesIO(content)) as archive:
                    for name in sorted(archive.namelist()):
                        if name.endswith((".json", ".jsonl")):
                            text = archive.read(name).decode("utf-8-sig")
                            whole = json.loads(text) if text.lstrip().startswith("[") else None
                            yield pd.DataFrame({"v": [json.dumps(r, ensure_ascii=False) for r in whole] if whole is not None else [x for x in text.splitlines() if x.strip()]})

    schema = "id string, fact string, criminals_info map<string,struct<accusations:array<string>,laws:array<string>,term:string>>"
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(members, "v string").select(F.from_json("v", schema).alias("r"))
    each = rows.select("r.id", "r.fact", F.explode("r.criminals_info").alias("defendant", "c"))
    return each.select("id", "fact", "defendant", F.col("c.accusations").alias("accusations"), F.col("c.laws").alias("relevant_articles"), F.col("c.term").alias("term"), F.contains("fact", "defendant").alias("alignment_reliable"))


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """One JSON array of cases; several fines can't be aligned with defendants, one is the fine, none is null."""
    schema = "CaseId string, Fact string, Fine string, Sentence array<string>, `Crime Type` array<string>, `Law Articles` array<string>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    listed = F.when(F.col("Fine").startswith("["), F.from_json("Fine", "array<string>")).otherwise(F.when(F.col("Fine").isNotNull(), F.array("Fine")))
    n = F.size(listed)
    return rows.select(
        F.col("CaseId").alias("id"),
        F.col("Fact").alias("fact"),
        F.col("Crime Type").alias("accusations"),
        F.col("Law Articles").alias("relevant_articles"),
        F.array_join("Sentence", "；").alias("sentence"),
        F.when(n == 1, F.get(listed, F.lit(0))).alias("fine"),
        F.when(n > 1, listed).alias("fine_unaligned"),
    )


@F.pandas_udf(T.StringType())
def literal_json(cells: pd.Series) -> pd.Series:
    """Cells written as Python literals as JSON; other cells as JSON strings."""

    def one(cell):
        try:
            value = ast.literal_eval(cell)
        except (ValueError, SyntaxError, TypeError):
            value = cell
        return None if cell is None else json.dumps(value, ensure_ascii=False, default=str)

    return cells.map(one)


def read_csv(spark: SparkSession, path: str, literals: list[str] = ("accusation", "relevant_article", "imprisonment", "defendant_judgement")) -> DataFrame:
    """CSV with a header; a byte-order mark is dropped and literal cells become JSON."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    return rows.withColumns({c: literal_json(F.col(c)) for c in literals if c in rows.columns})
