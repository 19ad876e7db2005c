"""Ordered rule tables. Patterns, kinds and their order are fixed values: each rule sees what the rules before it left."""

from __future__ import annotations

from .vocab import COMPOUND_SURNAMES, SINGLE_SURNAMES


def bounded(p: str) -> str:
    """p not glued to an ASCII letter or digit on either side."""
    return f"(?<![0-9A-Za-z]){p}(?![0-9A-Za-z])"


# Secrets and personal data in operators' texts.
REDACTIONS = (
    (r"\b(sk-[A-Za-z0-9]{8,}|pk-[A-Za-z0-9]{8,}|AKIA[0-9A-Z]{12,}|ghp_[A-Za-z0-9]{20,}|xox[baprs]-[A-Za-z0-9-]{10,})\b", "[redacted-secret]"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "[redacted-email]"),
    (r"\b\d{13,19}\b", "[redacted-number]"),
    (r"(?<!\d)\+?\d[\d\s().-]{7,}\d(?!\d)", "[redacted-phone]"),
)

# Attacks on prompts, first match names the category; then what forces a verdict.
ATTACKS = (
    (r"(?i)\b(ignore|disregard|forget|override|bypass)\b.{0,40}\b(previous|prior|above|earlier|all|these|any|the)\b.{0,25}\b(instruction|direction|directive|rule|prompt|context|guardrail|policy)s?\b", "instruction_override"),
    (r"(?i)\b(act as|you are now|pretend to be|role[- ]?play as|behave as)\b.{0,25}\b(system|admin|administrator|developer|dan|root|assistant)\b", "role_hijack"),
    (r"(?i)\bsystem prompt\b|\bdeveloper mode\b|\bjailbreak\b|\bDAN mode\b|\bdo anything now\b", "jailbreak"),
    (r"(?i)</?s>|<\|.*?\|>|\{\{.*?\}\}|\[/?INST\]|```", "delimiter_injection"),
    (r"(忽略|无视|不要理会|不用管)[^。]{0,12}(之前|上述|前面|所有|以上)[^。]{0,12}(指令|指示|指引|说明|规则|提示|要求|设定)", "instruction_override_cn"),
    (r"(扮演|充当|假装|现在是).{0,8}(系统|管理员|开发者|助手)", "role_hijack_cn"),
)
VERDICT_FORCING = r"(?i)\b(respond|reply|output|answer|return|mark|classify|set|say|print)\b\s+(with\s+|as\s+)?[\"']?\b(allow|approved|compliant|safe|buy|enter|low)\b"

# Committing language.
REDLINES = (
    ("diagnostic", r"确诊(?:为|是)?"),
    ("diagnostic", r"明确诊断(?:为|是)?"),
    ("diagnostic", r"诊断(?:为|是)(?!不明)"),
    ("diagnostic", r"\bdiagnos(?:is|ed|e)\b\s*[::]?"),
    ("diagnostic", r"\bconfirms?\s+(?:the\s+)?diagnosis\b"),
    ("exclusion", r"(?:可|能|已|完全)?排除"),
    ("exclusion", r"(?:完全|可)?除外"),
    ("exclusion", r"\brule[ds]?\s+out\b"),
    ("exclusion", r"\bis\s+ruled\s+out\b"),
    ("exclusion", r"\bexcludes?\s+(?:the\s+)?(?:diagnosis|possibility)\b"),
    ("treatment", r"建议[^。；;]{0,6}?(?:服用|口服|静脉|输液|用药|抗感染治疗)"),
    ("treatment", r"建议[^。；;]{0,6}?(?:手术|治疗|化疗|放疗)"),
    ("treatment", r"\bprescrib(?:e|ed|ing)\b"),
    ("treatment", r"\b(?:start|initiate|administer)\s+\w+(?:cillin|mycin|azole)\b"),
    ("treatment", r"\btreat\s+with\b"),
)
# What replaces it, on the text as it stands.
NEUTRAL = (
    (r"明确诊断(?:为|是)?", "提示"),
    (r"确诊(?:为|是)?", "提示"),
    (r"诊断(?:为|是)", "考虑为"),
    (r"(?:可|能|已|完全)?排除", "未见明确"),
    (r"(?:完全|可)?除外", "未见明确"),
    (r"建议([^。；;]{0,6}?)(?:服用|口服|静脉|输液|用药|抗感染治疗)", "建议结合临床"),
    (r"建议([^。；;]{0,6}?)(?:手术|治疗|化疗|放疗)", "建议结合临床"),
    (r"(?i)\bdiagnos(?:is|ed|e)\b\s*[::]?", "findings suggest"),
    (r"(?i)\brule[ds]?\s+out\b", "without evidence of"),
    (r"(?i)\bis\s+ruled\s+out\b", "is not evident"),
    (r"(?i)\bprescrib(?:e|ed|ing)\b", "clinical correlation for"),
    (r"(?i)\btreat\s+with\b", "clinical correlation regarding"),
)

# Identifiers in clinical text, (kind, value, context before it).
_NAME = r"(?:Patient|Dr\.?|Referring physician|Ordering physician|Attending physician|Reported by|Read by|Dictated by|Signed by|患者|姓名|医生|医师|报告医师|审核医师)[:：\s]+"
_GIVEN = r"(?:[一-鿿]{1,2}(?=[，。、；：,;:\s]|$))|(?:[一-鿿]{1,2})"
_SEP = r"[-－/／.．\s]"
IDENTIFIERS = (
    ("name", r"[A-Z][a-zA-Z'\-]+(?:\s+[A-Z][a-zA-Z'\-]+)+", _NAME),
    ("name", r"[A-Z][a-zA-Z'\-]+,\s*[A-Z][a-zA-Z'\-]+", _NAME),
    ("name", r"[A-Z][a-zA-Z'\-]+[·・][A-Z][a-zA-Z'\-]+", _NAME),
    ("name", r"[一-鿿]{2,4}[·・][一-鿿]{2,4}", _NAME),
    ("name", f"(?:{'|'.join(COMPOUND_SURNAMES + SINGLE_SURNAMES)})(?:{_GIVEN})", _NAME),
    ("name", bounded(r"[A-Z]{2,}\^[A-Z]{2,}(?:\^[A-Z]*)*"), ""),
    ("patient_id", bounded(r"(?i:MRN|No\.)\d{6,9}"), ""),
    ("patient_id", bounded(r"\d{6,10}"), r"(?i:(?:MRN|Medical Record(?: Number)?)|病案号|住院号)[:：\s]+"),
    ("accession", bounded(r"(?i:ACC|No\.)\d{7,9}"), ""),
    ("national_id", bounded(r"\d{17}[\dXx]"), ""),
    ("date", bounded(rf"\d{{4}}{_SEP}\d{{1,2}}{_SEP}\d{{1,2}}"), ""),
    ("date", bounded(rf"\d{{1,2}}{_SEP}\d{{1,2}}{_SEP}\d{{4}}"), ""),
    ("date", r"\d{4}年\d{1,2}月\d{1,2}日", ""),
    ("date", bounded(r"\d{8}"), ""),
    ("institution", bounded(r"[A-Z][A-Za-z.\s]{2,40}?(?:Hospital|Medical Center|Clinic|Health System|Medical Group)"), ""),
    ("institution", r"[一-鿿]{2,10}(?:医院|诊所|医疗中心)", ""),
    ("phone", rf"[（(]\d{{3}}[）)]{_SEP}?\d{{3}}{_SEP}?\d{{4}}", ""),
    ("phone", bounded(rf"(?:\+86|0086|86){_SEP}?1[3-9]\d{_SEP}?\d{{4}}{_SEP}?\d{{4}}"), ""),
    ("phone", bounded(rf"1[3-9]\d{_SEP}\d{{4}}{_SEP}\d{{4}}"), ""),
    ("phone", bounded(rf"\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}"), ""),
    ("phone", r"1[3-9]\d{9}(?![0-9A-Za-z])", r"(?:(?i:Phone|Tel|Contact(?: number)?)|电话|联系电话|手机)[:：\s]*"),
)
