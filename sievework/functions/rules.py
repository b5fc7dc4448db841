"""Rule packs: ordered (name, pattern) tables that the text operators take as data.

Patterns are written for Java regular expressions.
"""

from __future__ import annotations

# Patterns and words of the Chinese legal pack, in the order in which they apply.
ZH_PRIVACY = [
    ("identity_card", r"(?<!\d)\d{17}[0-9Xx](?!\d)"),
    ("mobile", r"(?<!\d)1[3-9]\d{9}(?!\d)"),
    ("bank_card", r"(?<!\d)\d{16,19}(?!\d)"),
    ("birth_date", r"(?:出生于?|生于)\s*\d{4}年\d{1,2}月(?:\d{1,2}日)?"),
    ("plate", r"[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼][A-Z][A-Z0-9×＊*]{5}"),
    ("organization_code", r"(?<![A-Z0-9])[A-Z0-9]{8}-[A-Z0-9](?![A-Z0-9])"),
    ("address", r"(?:住址?|户籍(?:地|所在地))[:：]?[^，。；]{3,80}"),
    ("name", r"((?:被告人|被害人|证人)\s*)([一-鿿]{2,4})(?=[，。,；;])"),
]
ZH_LEAKAGE = [
    ("explicit_charge_conclusion", r"(?:其行为|上述行为|被告人行为)?(?:已)?构成[^，。；]{1,30}?罪"),
    ("explicit_prosecution_charge", r"应当?以[^，。；]{1,30}?罪(?:追究|定罪|处罚)"),
    ("explicit_charge_request", r"以[^，。；]{1,30}?罪(?:提起公诉|判处)"),
    ("explicit_verdict_charge", r"(?:判决如下[:：]?\s*)?被告人[^，。；]{0,24}?犯[^，。；]{1,30}?罪"),
    ("explicit_death_or_life_sentence", r"(?:决定执行|判处)[^，。；]{0,30}?(?:死刑|无期徒刑)"),
    ("explicit_term_sentence", r"(?:决定执行|判处)[^，。；]{0,30}?(?:有期徒刑|拘役|管制)[^，。；]{0,24}"),
    ("generic_sentence_after_verdict_verb", r"(?:判处|决定执行|处以)[^，。；]{1,100}"),
    ("explicit_probation_sentence", r"(?:宣告)?缓刑[一二三四五六七八九十百零〇0-9年月个]+"),
    ("explicit_fine_sentence", r"(?:并处罚金|判处罚金|处罚金|并处)[^，。；]{0,40}"),
]
ZH_LEAKAGE_MASK = "[罪名结论已脱敏]"
ZH_BOUNDARY = r"(?:法院认为|本院认为|判决如下|本院判决)[:：]?"
ZH_SENTENCE_LEAKAGE = [
    ("charge_conclusion", r"(?:犯|构成|以)[^，。；]{1,30}?罪(?:追究刑事责任)?"),
    ("term", r"(?:判处|决定执行)[^，。；]{0,30}?(?:有期徒刑|拘役|管制|无期徒刑|死刑)[^，。；]{0,25}"),
    ("probation", r"缓刑[一二三四五六七八九十百零〇0-9年月个]+"),
    ("fine", r"(?:并处|判处)?罚金(?:人民币)?[^，。；]{0,30}"),
]
ZH_SENTENCE_ENDS = "。；;!?！？"
ZH_LOW_INFORMATION = [
    r"公诉机关指控的(?:罪名和)?(?:犯罪)?事实与.*?(?:查明|认定)的(?:犯罪)?事实(?:基本)?(?:一致|相同)",
    r"(?:经)?(?:二审|本院|审理).*?(?:事实|证据).*?(?:一审|原审|原判).*?(?:一致|相同|确认|清楚)",
    r"(?:经)?(?:二审|本院|审理).*?(?:一审|原审|原判).*?(?:事实|证据).*?(?:一致|相同|确认|清楚)",
    r"(?:经)?审理查明.*?(?:一审|原审|原判).*?(?:事实|证据|认定).*?(?:一致|相同|确认|清楚)",
]
ZH_GENERIC_TERMS = r"被告人|行为人|当事人|案发后|主动|已经|取得谅解|谅解|退赃|退赔|返还|人民币|财物"
ZH_AMOUNT = r"(?:价值|金额|价款|损失|共计|合计|人民币)\s*([0-9]+(?:\.[0-9]+)?|[零〇一二两三四五六七八九十百千万]+)\s*(万元|万|元)"
ZH_YEAR = r"(?<!\d)((?:19|20)\d{2})年"
ZH_FACTORS = [
    ("自首", r"自首|主动投案"),
    ("坦白", r"坦白|如实供述"),
    ("退赃退赔", r"退赃|退赔|返还"),
    ("取得谅解", r"谅解"),
    ("累犯或前科", r"累犯|前科|曾因.*(?:判刑|刑事处罚)"),
    ("未遂", r"未遂"),
]
ZH_SENTENCING_FACTORS = [*ZH_FACTORS, ("认罪认罚", r"认罪认罚"), ("涉案金额", r"(?:价值|金额|人民币)[^，。；]{0,16}(?:元|万元)")]
ZH_DIMENSIONS = [
    ("amount", r"(?:人民币|价值|赃款|金额|获利|损失).{0,12}\d|\d+(?:万|元)"),
    ("injury_result", r"轻伤|重伤|死亡|伤残|抢救无效|法医"),
    ("joint_crime", r"共同|伙同|同案|召集|纠集|多人|主犯|从犯"),
    ("attempted", r"未遂|中止|预备|未得逞"),
    ("intentional", r"故意|明知|非法占有|预谋|蓄意"),
    ("negligent", r"过失|疏忽|应当预见|未尽"),
]
ZH_DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
ZH_UNITS = {"十": 10, "百": 100, "千": 1000, "万": 10000}
ZH_FACT_KEYWORDS = ["持刀", "殴打", "盗窃", "骗取", "抢劫", "死亡", "重伤", "轻伤", "金额", "价值", "自首", "投案", "累犯", "赔偿", "谅解", "故意", "过失"]
AUTHORITATIVE_SUFFIXES = ["gov.cn", "court.gov.cn", "spp.gov.cn", "npc.gov.cn"]
VERIFIED_STATUSES = ["human_verified_official", "verified_official"]
EFFECTIVE_STATUSES = ["effective", "现行有效"]
IMPRISONMENT_EDGES = [0, 6, 12, 24, 36, 60, 120, 180, 300, 10_000]
FINE_EDGES = [0, 1_000, 2_000, 5_000, 10_000, 20_000, 50_000, 100_000, 10**12]

# The generic pack, for texts in other languages; its patterns mean the same in RE2.
PRIVACY = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("phone", r"\+?[0-9]{0,2} ?\([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("bank_card", r"\b[0-9]{16,19}\b"),
    ("ip_address", r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"),
]
LEAKAGE = [
    ("rights", r"[Aa]ll rights reserved"),
    ("license", r"[Ll]icen[sc]e[d]?"),
    ("copyright", r"[Cc]opyright"),
]
LEAKAGE_MASK = "[MASKED]"
SENTENCE_ENDS = ".;!?"
DIMENSIONS = [
    ("number", r"[0-9]"),
    ("shout", r"!!"),
    ("table", r" \| "),
    ("accent", r"[\x{00C0}-\x{024F}]"),
    ("mail", r"@"),
]
FACTORS = [("the", r"\bthe\b"), ("and", r"\band\b"), ("of", r"\bof\b"), ("in", r"\bin\b"), ("de", r"\bde\b"), ("la", r"\bla\b")]
