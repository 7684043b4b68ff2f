"""Text patterns for injection attempts and leaked data, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# ---- fixed values: injection patterns (finding type, severity, confidence, remediation, patterns) ----
INJECTION_GROUPS = [
    ("prompt_injection", "CRITICAL", 0.90,
     "Sanitize user input before sending to LLM. Consider input validation and prompt hardening.", {
         "ignore_previous": r"ignore\s+(all\s+)?previous\s+instructions?",
         "disregard_previous": r"disregard\s+(all\s+)?previous\s+(commands?|instructions?|prompts?)",
         "forget_everything": r"forget\s+(everything|all\s+previous|your\s+instructions?)",
         "new_instructions": r"new\s+instructions?\s*:",
         "override_system": r"override\s+(system|safety)\s+(prompt|instructions?)",
         "do_not_follow": r"do\s+not\s+follow\s+(your|the)\s+(previous|original)\s+instructions?",
     }),
    ("jailbreak_attempt", "HIGH", 0.85,
     "Implement jailbreak detection in your prompt pipeline. Consider using a moderation layer.", {
         "dan_mode": r"\bDAN\s+mode\b",
         "you_are_dan": r"you\s+are\s+now\s+(a\s+)?DAN",
         "developer_mode": r"developer\s+mode\s+(enabled|activated|on)",
         "act_without_restrictions": r"act\s+as\s+if\s+you\s+have\s+no\s+restrictions?",
         "pretend_no_guidelines": r"pretend\s+(you\s+)?(are|have)\s+(no|without)\s+(guidelines?|restrictions?|rules?)",
         "hypothetical_scenario": r"in\s+a\s+hypothetical\s+scenario\s+where\s+you\s+(have|had)\s+no\s+(rules?|restrictions?)",
     }),
    ("role_confusion", "HIGH", 0.80,
     "Escape or strip role-boundary tokens from user input before prompt construction.", {
         "system_role_inject": r"system\s*:\s*you\s+are",
         "system_tag_inject": r"<\|system\|>",
         "system_bracket_inject": r"\[SYSTEM\]",
         "system_xml_inject": r"<system>",
         "assistant_role_inject": r"<\|assistant\|>",
     }),
    ("encoded_injection", "MEDIUM", 0.70,
     "Filter encoded content in user inputs. Consider a content-type allowlist.", {
         "base64_decode": r"base64[\s._-]*(decode|encoded?)",
         "eval_call": r"\beval\s*\(",
         "exec_call": r"\bexec\s*\(",
         "dunder_import": r"__import__\s*\(",
         "hex_encode_trick": r"\\x[0-9a-f]{2}\\x[0-9a-f]{2}",
     }),
    ("delimiter_injection", "MEDIUM", 0.65,
     "Use robust prompt delimiters that cannot be mimicked by user input. Consider XML-safe escaping.", {
         "closing_prompt_tag": r"</prompt>",
         "end_marker": r"---\s*END\s*---",
         "triple_backtick_boundary": r"```\s*(system|instructions?|prompt)\s*```",
         "xml_closing_tags": r"</?(instructions?|context|system_prompt)>",
     }),
]
# ---- fixed values: leak patterns -------------------------------------------------------------------
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
PHONE = r"\b(?:\+?1[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
API_KEYS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "stripe_secret_key": r"sk_live_[0-9a-zA-Z]{24,}",
    "github_pat": r"ghp_[0-9a-zA-Z]{36}",
    "openai_api_key": r"sk-[0-9a-zA-Z]{20,}",
    "slack_bot_token": r"xoxb-[0-9a-zA-Z-]+",
    "google_api_key": r"AIza[0-9A-Za-z_-]{35}",
}
# ---- fixed values: lower-case parts every match of a pattern contains -------------------------------
# (free of the letters s and k, which other characters fold to); they skip the regex on most texts
ANCHORS = {
    "ignore_previous": ("ignore", "previou"), "disregard_previous": ("regard", "previou"), "forget_everything": ("forget",),
    "new_instructions": ("new", "truction", ":"), "override_system": ("override",), "do_not_follow": ("not", "follow"),
    "dan_mode": ("dan", "mode"), "you_are_dan": ("you", "now", "dan"), "developer_mode": ("developer", "mode"),
    "act_without_restrictions": ("act", "triction"), "pretend_no_guidelines": ("pretend",),
    "hypothetical_scenario": ("hypothetical",), "system_role_inject": ("tem", ":", "you", "are"),
    "system_tag_inject": ("<|",), "system_bracket_inject": ("[", "tem]"), "system_xml_inject": ("<", "tem>"),
    "assistant_role_inject": ("<|",), "base64_decode": ("64", "code"), "eval_call": ("eval", "("), "exec_call": ("exec", "("),
    "dunder_import": ("__import__",), "hex_encode_trick": ("\\x",), "closing_prompt_tag": ("</prompt>",), "end_marker": ("---", "end"),
    "triple_backtick_boundary": ("```",), "xml_closing_tags": ("<", ">"),
}
KEY_ANCHORS = {"aws_access_key": "AKIA", "stripe_secret_key": "sk_live_", "github_pat": "ghp_", "openai_api_key": "sk-",
               "slack_bot_token": "xoxb-", "google_api_key": "AIza"}
REMEDIATION = {
    "pii_ssn": "CRITICAL: SSN detected. Purge from logs and review data handling. Add output filtering.",
    "pii_credit_card": "CRITICAL: Credit card number detected. Purge from logs and add PCI-compliant output filtering.",
    "pii_email": "Redact email addresses from LLM outputs. Consider PII masking in your pipeline.",
    "pii_phone": "Redact phone numbers from LLM outputs. Consider PII masking in your pipeline.",
    "api_key_leak": "API key (%s) detected. Rotate immediately and add secret scanning to your pipeline.",
}
#: what SSNs, cards and phone numbers all hold
DIGITS = r"\d{3}"
EXCERPT: int | None = None  # characters of a finding to show; all by default

FINDING_TYPE = ("array<struct<finding_type:string,severity:string,confidence:double,matched_text:string,"
                "pattern_name:string,location:string,remediation:string>>")
UNICODE = "(?U)"  # \b, \d and \s follow Unicode, as in Python


# The expressions below are written as SQL text over a column name: hundreds of
# nested parts parse in one call, where building them piece by piece takes seconds.


def _text(value: str) -> str:
    return "r'" + value + "'" if "'" not in value else '"' + value.replace("\\", "\\\\") + '"'


def _finding(kind: str, severity: str, confidence: float, matched: str, name: str, location: str, advice: str) -> str:
    return (f"named_struct('finding_type', '{kind}', 'severity', '{severity}', 'confidence', {confidence}D, "
            f"'matched_text', {matched}, 'pattern_name', '{name}', 'location', '{location}', 'remediation', {_text(advice)})")


def _excerpt(text: str) -> str:
    if EXCERPT is None:
        return text
    return f"if(length({text}) > {EXCERPT}, concat(left({text}, {EXCERPT}), '...'), {text})"


def _bind(value: str, var: str, body: str) -> str:
    """``body`` over ``var``, with ``value`` computed once per row."""
    return f"transform(array({value}), {var} -> {body})[0]"


def _matches(text: str, regex: str, anchor: str | None = None) -> str:
    found = f"regexp_extract_all({text}, {_text(UNICODE + regex)}, 0)"
    return found if anchor is None else f"if(contains({text}, '{anchor}'), {found}, array())"


def _first_of_each(values: str, key: str) -> str:
    """First value ``m`` of each ``key`` expression over m, in order."""
    return _bind(values, "vs", _bind(f"transform(vs, m -> {key})", "ks",
                                     "transform(array_distinct(ks), k -> element_at(vs, cast(array_position(ks, k) AS int)))"))


def _injection(text: str, location: str) -> str:
    found = []
    for kind, severity, confidence, advice, patterns in INJECTION_GROUPS:
        for name, regex in patterns.items():
            hit = f"regexp_extract({text}, {_text('(?i)' + UNICODE + regex)}, 0)"
            body = _bind(hit, "hit", _finding(kind, severity, confidence, _excerpt("hit"), name, location, advice))
            present = " AND ".join(f"contains(low, {_text(part)})" for part in ANCHORS[name])
            found.append(f"if({present}, {body}, null)")
    return _bind(f"lower({text})", "low", f"filter(array({', '.join(found)}), f -> f.matched_text <> '')")


def _ssn(text: str, location: str) -> str:
    body = _finding("pii_ssn", "CRITICAL", 0.95, "'XXX-XX-XXXX'", "ssn", location, REMEDIATION["pii_ssn"])
    return f"transform({_matches(text, SSN)}, m -> {body})"


def _card(text: str, location: str) -> str:
    digits = f"transform({_matches(text, CARD)}, m -> regexp_replace(m, {_text(UNICODE + '[\\s-]')}, ''))"
    body = _finding("pii_credit_card", "CRITICAL", 0.95, "concat('****-****-****-', right(d, 4))", "credit_card", location,
                    REMEDIATION["pii_credit_card"])
    return f"transform(filter({digits}, d -> luhn_check(d)), d -> {body})"


def _email(text: str, location: str) -> str:
    body = _finding("pii_email", "MEDIUM", 0.90, _excerpt("m"), "email_address", location, REMEDIATION["pii_email"])
    return f"transform({_first_of_each(_matches(text, EMAIL, '@'), 'lower(m)')}, m -> {body})"


def _phone(text: str, location: str) -> str:
    digits = f"regexp_replace(m, {_text(UNICODE + '[\\s().-]')}, '')"
    body = _finding("pii_phone", "MEDIUM", 0.80, _excerpt("m"), "phone_number", location, REMEDIATION["pii_phone"])
    return f"transform({_first_of_each(_matches(text, PHONE), digits)}, m -> {body})"


def _keys(text: str, location: str) -> str:
    vendors = []
    for name, regex in API_KEYS.items():
        body = _finding("api_key_leak", "HIGH", 0.92, "concat(left(m, 8), '...')", name, location,
                        REMEDIATION["api_key_leak"] % name)
        vendors.append(f"transform({_matches(text, regex, KEY_ANCHORS[name])}, m -> {body})")
    return f"concat({', '.join(vendors)})"


def _leaks(text: str, location: str) -> str:
    """SSNs, cards and phone numbers are looked for only where a text has three digits in a row, which each of them has."""
    every, few = ((_ssn, _card, _email, _phone, _keys), (_email, _keys))
    joined = lambda kinds: f"concat({', '.join(part(text, location) for part in kinds)})"
    return f"if({text} rlike {_text(UNICODE + DIGITS)}, {joined(every)}, {joined(few)})"


def injection_findings(text: str, location: str) -> Column:
    """First match of each injection pattern in column ``text``, in pattern order."""
    return F.expr(_injection(text, location))


def ssn_findings(text: str, location: str) -> Column:
    return F.expr(_ssn(text, location))


def card_findings(text: str, location: str) -> Column:
    """Card-shaped numbers that pass the Luhn check, last four digits kept."""
    return F.expr(_card(text, location))


def email_findings(text: str, location: str) -> Column:
    return F.expr(_email(text, location))


def phone_findings(text: str, location: str) -> Column:
    return F.expr(_phone(text, location))


def key_findings(text: str, location: str) -> Column:
    return F.expr(_keys(text, location))


def leak_findings(text: str, location: str) -> Column:
    return F.expr(_leaks(text, location))


def redact(text: Column) -> Column:
    """Text with keys, SSNs, cards, e-mails and phones replaced by masks."""
    out = text
    for regex in API_KEYS.values():
        out = F.regexp_replace(out, regex, "[API_KEY]")
    for regex, mask in ((SSN, "[SSN]"), (CARD, "[CARD]"), (EMAIL, "[EMAIL]"), (PHONE, "[PHONE]")):
        out = F.regexp_replace(out, f"{UNICODE}{regex}", mask)
    return out
