"""Label mappings, configurations and thresholds: small driver-side files and their checks."""

from __future__ import annotations

import ast
import json
import os

from pyspark.sql import DataFrame, SparkSession

from sievework.operators.stats import label_ids, label_support

_ENCODINGS = ("utf-8-sig", "gb18030")


def parsed_mapping(raw: bytes) -> dict[str, int]:
    """label -> id of a JSON object in UTF-8 or GB 18030, or of a Python literal."""
    texts = []
    for encoding in _ENCODINGS:
        try:
            texts.append(raw.decode(encoding))
        except UnicodeDecodeError:
            continue
    readers = [(json.loads, t) for t in texts] + [(ast.literal_eval, raw.decode("utf-8", "replace"))]
    for read, text in readers:
        try:
            found = read(text)
            return {str(label): int(number) for label, number in found.items()}
        except (ValueError, SyntaxError, AttributeError, TypeError):
            continue
    raise ValueError("neither JSON nor a literal of labels and numbers")


def read_mapping(spark: SparkSession, path: str) -> dict[str, int]:
    return parsed_mapping(bytes(spark.read.format("binaryFile").load(path).select("content").first()[0]))


def mapping_json(mapping: dict[str, int]) -> str:
    """The mapping in order of its ids."""
    return json.dumps({k: mapping[k] for k in sorted(mapping, key=mapping.get)}, ensure_ascii=False, indent=2)


def corpus_mapping(df: DataFrame, labels: str) -> DataFrame:
    """label, label_id of all labels of a corpus, from 0 in label order."""
    return label_ids(label_support(df, labels))


def mapping_faults(mapping: dict[str, int], expected: int | None = None) -> list[str]:
    """What is wrong with a mapping's ids: repeated, with gaps, or not as many as expected."""
    ids = sorted(mapping.values())
    faults = {
        "repeated_ids": len(set(ids)) < len(ids),
        "ids_with_gaps": set(ids) != set(range(len(ids))),
        "wrong_size": expected is not None and len(ids) != expected,
    }
    return [name for name, wrong in faults.items() if wrong]


def checked_thresholds(values: dict[str, float], labels: int) -> list[float]:
    """Thresholds by label id; their ids must be exactly 0 .. labels - 1."""
    by_id = {int(k): float(v) for k, v in values.items()}
    if len(by_id) != len(values) or by_id.keys() != set(range(labels)):
        raise ValueError("thresholds and labels have different ids")
    return [by_id[i] for i in range(labels)]


def read_config(path: str) -> dict:
    """A YAML file whose root is a mapping; an empty one is an empty mapping."""
    import yaml  # not needed by anything else

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        root = yaml.safe_load(f)
    if root is None:
        return {}
    if not isinstance(root, dict):
        raise TypeError(f"{path}: its root is no mapping")
    return root


def resolved(path: str, root: str | None = None) -> str:
    """An absolute path as it is, others below ``root`` or the current folder."""
    return path if os.path.isabs(path) else os.path.realpath(os.path.join(root or os.getcwd(), path))


def nested(value, *keys):
    """The value under a path of keys, null where one is missing."""
    for key in keys:
        value = value.get(key) if isinstance(value, dict) else None
    return value
