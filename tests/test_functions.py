from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import chunking, features, money, redaction, repair, rules, text



def test_normalize(one):
    assert one(text.normalize_text(F.col("t")), t="ＡＢＣ　 \n １２３\x01") == "ABC 123"


def test_duplicate_ids_ignore_punctuation_and_width(one):
    ids = {one(text.duplicate_group_id(F.col("t")), t=t) for t in ("盗窃1000元。", "盗窃，１０００元", "盗窃 1000 元")}
    assert len(ids) == 1 and ids.pop().startswith("DG-")


@pytest.mark.parametrize(("t", "n", "grams"), [("a b\nc", 2, ["ab", "bc"]), ("ab", 3, ["ab"]), ("", 2, []), ("  ", 3, []), ("盗窃罪", 2, ["盗窃", "窃罪"])])
def test_ngrams(one, t, n, grams):
    assert one(text.character_ngrams(F.col("t"), n), t=t) == grams
    assert one(text.ngram_count(F.col("t"), n), t=t) == len(grams)


def test_word_boundaries_are_ascii(one):
    """As in other engines, a letter with an accent is no part of a word."""
    assert one(redaction.tags(F.col("t"), rules.FACTORS), t="vu, laéouell inäßzu bin the_ Of of") == ["of", "in", "la"]
    assert one(redaction.scan(F.col("t"), rules.PRIVACY), t="é1234567890123456é x12345678901234567")["bank_card"] == 1
    assert redaction.portable(r"a\\b\d") == r"a\\b\d"


def test_redaction_in_order(one):
    t = "被告人张三，出生于1990年1月2日，住址：某市某路一号，电话13812345678，证号110101199001021234。"
    counts = one(redaction.redaction_counts(F.col("t"), rules.ZH_PRIVACY), t=t)
    assert sum(counts.values()) >= 4 and counts["identity_card"] == 1 and counts["bank_card"] == 0 and counts["name"] == 1
    clean = one(redaction.redact(F.col("t"), rules.ZH_PRIVACY), t=t)
    assert "被告人[NAME_REDACTED]，" in clean
    assert sum(one(redaction.scan(F.col("t"), rules.ZH_PRIVACY), t=clean).values()) == 0
    assert one(redaction.privacy_status(F.col("t"), rules.ZH_PRIVACY), t="无") == "clean"


def test_leakage_masks_conclusions_only(one):
    m = one(redaction.mask_leakage(F.col("t")), t="被告人盗窃人民币5000元，其行为已构成盗窃罪，判处有期徒刑一年，并处罚金二千元。")
    assert "5000元" in m["text"] and "盗窃罪" not in m["text"] and "有期徒刑" not in m["text"] and "二千元" not in m["text"]
    assert m["removed"] and m["types"][0] == "explicit_charge_conclusion"


def test_sentences_with_verdicts_go(one):
    t = "被告人窃得手机一部，价值3000元。案发后自首。其行为构成盗窃罪。本院认为：应当从轻。"
    out = one(redaction.drop_leaking_sentences(F.col("t")), t=t)
    assert out == "被告人窃得手机一部，价值3000元。案发后自首。"
    hits = one(redaction.leakage_hits(F.col("t")), t=out)
    assert sum(hits.values()) == 0


def test_low_information(one):
    assert one(redaction.is_low_information(F.col("t")), t="公诉机关指控的犯罪事实与审理查明的事实一致")
    assert not one(redaction.is_low_information(F.col("t")), t="公诉机关指控的犯罪事实与审理查明的事实一致" + "长" * 200)


@pytest.mark.parametrize(("t", "n"), [("二百三十四", 234), ("十", 10), ("两万", 20000), ("一万零五", 10005), ("77", 77), ("三千零二十", 3020), ("百五", 105), ("零十", 10), ("三万", 30000), ("", 0)])
def test_numerals(one, t, n):
    assert one(money.chinese_integer(F.col("t")), t=t) == n


def test_unknown_numeral_is_null(one):
    assert one(money.chinese_integer(F.col("t")), t="三x") is None
    assert one(money.chinese_integer(F.col("t"), strict=False), t="第三x") == 3


@pytest.mark.parametrize(
    ("t", "status", "amount"),
    [(None, "missing", None), (" ", "missing", None), ("0", "zero", 0), ("一万元", "positive", 10000), ("1万", "positive", 10000), ("10000元", "positive", 10000), ("罚金人民币1,500元", "positive", 1500), ("若干", "invalid", None), ("-1000", "positive", 1000)],
)
def test_amounts(one, t, status, amount):
    assert tuple(one(money.parse_rmb(F.col("t")), t=t)) == (status, amount)


def test_negative_numbers_are_invalid(one):
    assert tuple(one(money.parse_number(F.col("v")), v=-1)) == ("invalid", None)
    assert tuple(one(money.parse_number(F.col("v")), v=12.9)) == ("positive", 12)


@pytest.mark.parametrize(("v", "b"), [(0, 0), (5, 0), (6, 1), (9_999, 8), (20_000, 8), (-3, 8)])
def test_buckets(one, v, b):
    assert one(money.bucket(F.col("v"), rules.IMPRISONMENT_EDGES), v=v) == b


def test_factors_and_dimensions(one):
    assert one(redaction.tags(F.col("t"), rules.ZH_SENTENCING_FACTORS), t="价值人民币3000元，如实供述，认罪认罚") == ["坦白", "认罪认罚", "涉案金额"]
    assert one(redaction.tags(F.col("t"), rules.ZH_DIMENSIONS), t="二人共同故意致人轻伤，损失500元") == ["amount", "injury_result", "joint_crime", "intentional"]


def test_labels(one):
    assert one(text.canonical_labels(F.col("v")), v=["[盗窃]", "抢 劫", "【盗窃】", ""]) == ["抢劫", "盗窃"]
    assert one(text.strip_suffix(F.col("t"), "罪"), t=" 盗窃罪罪 ") == "盗窃罪"


def test_similarity_prefers_near_amounts(one):
    q = "价值3000元，自首"
    near, far = "价值3100元，自首", "价值90000元，自首"

    def s(d):
        a, b = F.col("q"), F.col("d")
        return one(features.structured_similarity(redaction.tags(a, rules.ZH_FACTORS), redaction.tags(b, rules.ZH_FACTORS), features.amount(a), features.amount(b), features.year(a), features.year(b)), q=q, d=d)

    assert s(near) > s(far) and abs(s(q) - (0.45 + 0.45 + 0.05)) < 1e-9


def test_negative_types(one):
    q, d = F.col("q"), F.col("d")
    assert one(features.negative_type(q, d, F.lit(True)), q=["amount"], d=["negligent"]) == "same_charge_different_behavior"
    assert one(features.negative_type(q, d, F.lit(False)), q=["attempted", "amount"], d=["amount"]) == "completed_vs_attempted"


@pytest.mark.parametrize(
    ("t", "found"),
    [('x</think>```json\n{"a": {"b": "}"}} tail```', '{"a": {"b": "}"}}'), ('{"a": 1', None), ("none", None), ('say {bad: "}"} now', '{bad: "}"}'), (None, None), ('{"q": "\\"}"} x', '{"q": "\\"}"}')],
)
def test_json_objects(t, found):
    assert repair.find_object(t) == found


def test_canonical_output():
    got = json.loads(repair.canonical('{"罪名候选": ["盗窃罪", " ", 3], "关键事实": "x", "置信度": " 中等 ", "人工复核标记": "否"}'))
    assert got == {"candidate_accusations": ["盗窃"], "key_facts": ["x"], "confidence": "medium", "requires_manual_review": False}
    assert json.loads(repair.canonical("{}"))["confidence"] == "low"


@pytest.mark.parametrize("t", ["", "短。", "一二三四五。" * 200, "无标点" * 400, "甲。" + "乙" * 900 + "。丙"])
def test_chunks(t):
    got = list(chunking.cuts(t))
    assert got[0][0] == 0 and got[-1][1] == len(t)
    for (a, b), (c, _) in zip(got, got[1:]):
        assert b - a <= chunking.SIZE and a < c <= b
    if len(t) <= chunking.SIZE:
        assert got == [(0, len(t))]


def test_chunk_sizes_are_checked():
    with pytest.raises(ValueError, match="overlap"):
        list(chunking.cuts("x", 10, 10))
