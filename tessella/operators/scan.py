"""Rule-based safety and personal-data scanning."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tessella.functions.text import scan_text
from tessella.session import small_batches, spread


class Rule(NamedTuple):
    id: str
    cls: str
    sub: str
    severity: str
    pattern: str


# The safety rules, on normalised text; (?i) where a rule folds case.
SAFETY = (
    Rule("PI-01", "prompt_injection", "instruction_override", "critical", r"(?i)ignore\s+(all\s+)?(previous\s+)?instructions"),
    Rule("PI-02", "prompt_injection", "instruction_override", "critical", r"(?i)forget\s+(everything|all|previous)"),
    Rule("PI-03", "prompt_injection", "instruction_override", "critical", r"(?i)disregard\s+(all\s+)?(previous|prior|above)"),
    Rule("PI-04", "prompt_injection", "instruction_override", "high", r"(?i)do\s+not\s+follow\s+(the\s+)?(previous|above|prior)"),
    Rule("PI-05", "prompt_injection", "role_switching", "high", r"(?i)you\s+are\s+now\s+(?!going|about|ready)"),
    Rule("PI-06", "prompt_injection", "role_switching", "high", r"(?i)act\s+as\s+(if\s+you\s+are\s+)?a?\s*(different|new|another)"),
    Rule("PI-07", "prompt_injection", "role_switching", "medium", r"(?i)pretend\s+(to\s+be|you\s+are)"),
    Rule("PI-08", "prompt_injection", "jailbreak", "critical", r"(?i)\bDAN\b.*\bmode\b|\bmode\b.*\bDAN\b"),
    Rule("PI-09", "prompt_injection", "jailbreak", "critical", r"(?i)jailbreak"),
    Rule("PI-10", "prompt_injection", "jailbreak", "critical", r"(?i)bypass\s+(your\s+)?(restrictions|limitations|rules|filters)"),
    Rule("PI-11", "prompt_injection", "jailbreak", "high", r"(?i)without\s+(any\s+)?(restrictions|limitations|rules)"),
    Rule("PI-12", "prompt_injection", "jailbreak", "critical", r"(?i)disable\s+(your\s+)?(safety\s+|content\s+)?filter"),
    Rule("PI-14", "prompt_injection", "context_manipulation", "high", r"(?i)\[system\]|\{system\}|system\s+prompt"),
    Rule("PI-15", "prompt_injection", "context_manipulation", "high", r"(?i)reveal\s+(your\s+)?(system\s+)?prompt"),
    Rule("PI-16", "prompt_injection", "context_manipulation", "medium", r"(?i)what\s+(is|are)\s+your\s+(initial\s+)?instructions"),
    Rule("PI-17", "prompt_injection", "context_manipulation", "medium", r"\[\[.*?\]\]|<<.*?>>|\{\{.*?\}\}"),
    Rule("PI-19", "prompt_injection", "encoding_attack", "medium", r"(?i)decode\s+this|encrypted\s+message"),
    Rule("PI-20", "prompt_injection", "hypothetical", "low", r"(?i)hypothetically|in\s+theory|theoretically|if\s+you\s+could"),
    Rule("PI-21", "prompt_injection", "hypothetical", "low", r"(?i)for\s+(educational|research|academic)\s+purposes"),
    Rule("PI-22", "prompt_injection", "jailbreak", "high", r"(?i)developer\s+mode|dev\s+mode|debug\s+mode"),
    Rule("PI-23", "prompt_injection", "jailbreak", "high", r"(?i)enable\s+(hidden|secret|special)\s+(features|mode|commands)"),
    Rule("PI-24", "prompt_injection", "context_manipulation", "high", r"(?i)```system|```instruction|```prompt"),
    Rule("PI-25", "prompt_injection", "context_manipulation", "medium", r"(?i)---\s*(system|instruction|prompt)"),
    Rule("PI-13T", "prompt_injection", "context_manipulation", "critical", r"(?i)<\|system\|>|<system>|(?:^|\n)\s*system\s*:\s*(?:you\s+are|ignore|forget|disregard)"),
    Rule("PT-02", "path_traversal", "path_traversal", "critical", r"(?i)\.\.%2f|\.\.%5c"),
    Rule("PT-03", "path_traversal", "path_traversal", "high", r"(?i)/etc/(passwd|shadow|hosts|sudoers)"),
    Rule("PT-04", "path_traversal", "path_traversal", "high", r"[Cc]:\\[Ww]indows\\[Ss]ystem32"),
    Rule("PT-05", "path_traversal", "path_traversal", "medium", r"(?i)/proc/self/environ|/proc/self/cmdline"),
    Rule("PT-01T", "path_traversal", "path_traversal", "critical", r"(?i)(?:\.\.[/\\]){2,}(?:[^/\\]{0,40}[/\\])*(?:etc|proc|windows|shadow|passwd|sudoers|system32)|(?:\.\.[/\\])(?:etc|proc|windows)[/\\]"),
    Rule("CI-01", "command_injection", "command_injection", "critical", r"\$\([^)]{1,200}\)"),
    Rule("CI-02", "command_injection", "command_injection", "critical", r"`[^`]{1,200}`"),
    Rule("CI-03", "command_injection", "command_injection", "critical", r"(?i);\s*(rm|curl|wget|chmod|chown|bash|sh|python[23]?|perl)\b"),
    Rule("CI-04", "command_injection", "command_injection", "high", r"(?i)\|\s*(curl|wget|sh|bash|nc|ncat|python)\b"),
    Rule("CI-05", "command_injection", "command_injection", "high", r"(?i)&&\s*(curl|wget|sh|bash|rm|cat|echo|python)\b"),
    Rule("CI-06", "command_injection", "command_injection", "critical", r"(?i);\s*rm\s+-[rf]"),
    Rule("CI-07", "command_injection", "command_injection", "medium", r"(?i)\|\s*sh\b|\|\s*bash\b"),
    Rule("CI-08", "command_injection", "command_injection", "medium", r"(?i)\$\{IFS\}|\$\(printf"),
)
# The personal-data and credential rules, on raw text.
PII = (
    Rule("PII-01", "pii", "email", "medium", r"\b[A-Za-z0-9._%+\-]+@(?![A-Za-z0-9.\-]*example\.com\b|company\.io\b|cluster\.local\b)[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    Rule("PII-02", "pii", "ssn", "high", r"\b\d{3}-\d{2}-\d{4}\b"),
    Rule("PII-03", "pii", "credit_card", "high", r"\b\d{4}[\-\s]?\d{4}[\-\s]?\d{4}[\-\s]?\d{4}\b"),
    Rule("PII-04", "pii", "api_key", "critical", r"\b(sk-[a-zA-Z0-9]{48}|sk-ant-[a-zA-Z0-9\-]{20,})\b"),
    Rule("PII-05", "pii", "github_token", "critical", r"\b(ghp_[a-zA-Z0-9]{36}|github_pat_[a-zA-Z0-9_]{82})\b"),
    Rule("PII-06", "pii", "password", "high", r"(?i)password\s*[:=]\s*[\"']?[^\"'\s]{4,}[\"']?"),
    Rule("PII-07", "pii", "aws_access_key", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    Rule("PII-08", "pii", "bearer_token", "high", r"(?i)\bBearer\s+[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+\b"),
)
#: What any match of a rule contains, in lower case: a plain search for it comes before the expression.
NEEDS = {
    "PI-01": ("ignore",), "PI-02": ("forget",), "PI-03": ("disregard",), "PI-04": ("follow",), "PI-05": ("now",), "PI-06": ("act",), "PI-07": ("pretend",), "PI-08": ("dan",),
    "PI-09": ("jailbreak",), "PI-10": ("bypass",), "PI-11": ("without",), "PI-12": ("disable",), "PI-14": ("[system]", "{system}", "prompt"), "PI-15": ("reveal",), "PI-16": ("instructions",),
    "PI-17": ("[[", "<<", "{{"), "PI-19": ("decode", "encrypted"), "PI-20": ("hypothetically", "theor", "if"), "PI-21": ("purposes",), "PI-22": ("mode",), "PI-23": ("enable",), "PI-24": ("```",), "PI-25": ("---",),
    "PI-13T": ("system",), "PT-02": ("..%",), "PT-03": ("/etc/",), "PT-04": ("system32",), "PT-05": ("/proc/",), "PT-01T": ("..",), "CI-01": ("$(",), "CI-02": ("`",), "CI-03": (";",), "CI-04": ("|",),
    "CI-05": ("&&",), "CI-06": (";",), "CI-07": ("|",), "CI-08": ("${ifs}", "$(printf"), "PII-01": ("@",), "PII-02": ("-",), "PII-04": ("sk-",), "PII-05": ("ghp_", "github_pat_"), "PII-06": ("password",),
    "PII-07": ("akia",), "PII-08": ("bearer",),
}
#: Characters of a personal-data match that are kept.
MATCHED = 60


def portable(rules: tuple[Rule, ...]) -> tuple[Rule, ...]:
    """The rules without lookaround, which every SQL engine's expressions have."""
    return tuple(r for r in rules if "(?!" not in r.pattern and "(?=" not in r.pattern)


def _hit(text: Column, low: Column, rule: Rule) -> Column:
    test = text.rlike(rule.pattern)
    if needs := NEEDS.get(rule.id):
        found = F.contains(low, F.lit(needs[0]))
        for n in needs[1:]:
            found = found | F.contains(low, F.lit(n))
        test = found & test
    return test


def _rules(text: Column, rules: tuple[Rule, ...], body, low: Column | None = None) -> Column:
    """The array of body(rule) of the rules that match: one pass over a row, no explosion by rule."""
    low = F.lower(text) if low is None else low
    return F.array_compact(F.array(*(F.when(_hit(text, low, r), body(r)) for r in rules)))


def matched_rules(text: Column, rules: tuple[Rule, ...] = SAFETY) -> Column:
    return F.coalesce(_rules(text, rules, lambda r: F.lit(r.id)), F.array().cast("array<string>"))


def safety_scan(df: DataFrame, *, id_col: str, text_col: str, rules: tuple[Rule, ...] = SAFETY, normalise: bool = True) -> DataFrame:
    """id, rule_id, cls, sub, severity, start and end of the first match of each rule that a text matches."""
    small_batches(df.sparkSession)
    text = scan_text(text_col) if normalise else F.col(text_col)
    rows = spread(df).select(F.col(id_col), text.alias("__t")).withColumn("__l", F.lower("__t"))

    def body(r: Rule) -> Column:
        found = F.regexp_extract("__t", r.pattern, 0)
        start = F.regexp_instr(F.col("__t"), F.lit(r.pattern)) - 1
        return F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.cls).alias("cls"), F.lit(r.sub).alias("sub"), F.lit(r.severity).alias("severity"), start.alias("start"), (start + F.length(found)).alias("end"))

    return rows.select(id_col, F.explode(_rules(F.col("__t"), rules, body, F.col("__l"))).alias("m")).select(id_col, "m.*")


def pii_scan(df: DataFrame, *, id_col: str, text_col: str, rules: tuple[Rule, ...] = PII) -> DataFrame:
    """id, rule_id, sub, severity and matched (60 characters at most) of every match in the raw text."""
    found = lambda r: F.transform(
        F.regexp_extract_all(text_col, F.lit(r.pattern), F.lit(0)), lambda m: F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.sub).alias("sub"), F.lit(r.severity).alias("severity"), F.substring(m, 1, MATCHED).alias("matched"))
    )
    hits = F.concat(*(F.when(_hit(F.col(text_col), F.col("__l"), r), found(r)).otherwise(F.array().cast("array<struct<rule_id:string,sub:string,severity:string,matched:string>>")) for r in rules))
    return spread(df.select(id_col, text_col)).select(id_col, text_col, F.lower(text_col).alias("__l")).select(id_col, F.explode(hits).alias("m")).select(id_col, "m.*")


def added_line_lint(lines: DataFrame, rules: tuple[Rule, ...], *, waiver: str = "lint-ok") -> DataFrame:
    """path, line and rule_id of added lines that match a rule and carry no waiver; lines: path, line, text."""
    return lines.where(~F.contains("text", F.lit(waiver))).select("path", "line", F.explode(matched_rules(F.col("text"), rules)).alias("rule_id"))
