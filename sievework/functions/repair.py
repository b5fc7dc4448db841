"""JSON objects in generated text: extraction, canonical keys and validation."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of keys and confidence values.
KEYS = {
    "candidate_accusations": ["candidate_accusations", "predicted_accusations", "罪名候选", "预测罪名"],
    "key_facts": ["key_facts", "关键事实"],
    "confidence": ["confidence", "置信度"],
    "requires_manual_review": ["requires_manual_review", "人工复核标记", "是否需要人工复核"],
}
CONFIDENCE = {"high": ["高", "高置信度", "high"], "medium": ["中", "中等", "中置信度", "medium"], "low": ["低", "低置信度", "low"]}
NO_REVIEW = ["false", "否", "无需人工复核", "不需要"]

_KEY = {alias: name for name, aliases in KEYS.items() for alias in aliases}
_LEVEL = {alias: name for name, aliases in CONFIDENCE.items() for alias in aliases}


def find_object(text: str | None) -> str | None:
    """The first complete JSON object of a text; null if there is none."""
    if text is None:
        return None
    before, thought, after = text.partition("</think>")
    body = after if thought else before
    at = body.find("{")
    if at < 0:
        return None
    try:
        _, end = json.JSONDecoder().raw_decode(body, at)
        return body[at:end]
    except ValueError:
        pass
    # not valid JSON: the text up to the closing brace, as a parser will then say what is wrong
    open_, quoted, i = 0, False, at
    while i < len(body):
        c = body[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        else:
            quoted = c == '"'
            open_ += (c == "{") - (c == "}")
            if not open_:
                return body[at : i + 1]
        i += 1
    return None


def _listed(value) -> list:
    return [value] if isinstance(value, str) else value


def canonical(raw: str | None) -> str | None:
    """A simplified analysis with canonical keys and values, as JSON; null if it can't be read."""
    found = find_object(raw)
    try:
        value = json.loads(found) if found else None
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    named = {_KEY[k]: v for k, v in value.items() if k in _KEY}
    labels = [x for x in _listed(named.get("candidate_accusations", [])) or [] if isinstance(x, str) and x.strip()]
    review = named.get("requires_manual_review", True)
    out = {
        "candidate_accusations": [x.removesuffix("罪") for x in labels],
        "key_facts": _listed(named.get("key_facts", [])),
        "confidence": _LEVEL.get(str(named.get("confidence", "low")).strip().lower(), "low"),
        "requires_manual_review": review.strip().lower() not in NO_REVIEW if isinstance(review, str) else bool(review),
    }
    return json.dumps(out, ensure_ascii=False, sort_keys=True)


@F.pandas_udf(T.StringType())
def extract_json_object(texts: pd.Series) -> pd.Series:
    return texts.map(find_object)


@F.pandas_udf(T.StringType())
def canonicalize_output(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)


def has_only_keys(json_text, allowed: list[str]):
    """Whether a JSON object has no keys but these (from_json would drop others silently)."""
    return F.size(F.array_except(F.json_object_keys(json_text), F.array(*[F.lit(k) for k in allowed]))) == 0
