"""Guards of texts: what blocks them, and what is masked in them."""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.functions.text import _luhn, has_card

# Instructions aimed at a model, identifiers and credentials, each with its name.
INJECTION = (
    r"\b(ignore|disregard|forget|override)\b[^.?!\n]{0,30}\b(previous|prior|above|earlier|all|your|the system)\b[^.?!\n]{0,20}\b(instructions?|prompts?|rules|guidelines|messages?)\b",
    r"\b(reveal|show|print|repeat|output|tell me|what (is|are))\b[^.?!\n]{0,20}\b(your|the)\b[^.?!\n]{0,15}\b(system prompt|hidden (prompt|instructions)|initial instructions|developer (message|prompt))\b",
    r"\byou are (now|no longer)\b[^.?!\n]{0,40}\b(dan|jailbroken|unrestricted|unfiltered|without (any )?(rules|restrictions|limits))\b",
    r"\b(enter|enable|activate|switch to)\b[^.?!\n]{0,15}\b(developer|god|dan|jailbreak) mode\b",
    r"\bpretend\b[^.?!\n]{0,30}\b(no|without) (rules|restrictions|guidelines|filters)\b",
)
SSN = r"\b(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b"
SECRETS = {
    "aws_access_key": r"\b(AKIA|ASIA)[0-9A-Z]{16}\b",
    "private_key": r"-----BEGIN (RSA |EC |OPENSSH |DSA )?PRIVATE KEY-----",
    "api_token": r"\b(sk-[A-Za-z0-9_-]{20,}|ghp_[A-Za-z0-9]{36}|xox[bap]-[A-Za-z0-9-]{20,}|AIza[0-9A-Za-z_-]{35})\b",
}
CARD = r"\b[0-9](?:[ -]?[0-9]){12,18}\b"
ANY_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?<![0-9])(?:\+?1[-. ]*)?\(?[0-9]{3}[-. )]*[0-9]{3}[-. ]*[0-9]{4}(?![0-9])"
SENSITIVE_KEYS = ("address", "date_of_birth", "dob", "email", "first_name", "last_name", "member_id", "member_ref", "name", "phone", "postal_code", "ssn")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def redacted(text: Column | str) -> Column:
    """Social security numbers, addresses and phone numbers as placeholders; null stays null."""
    x = F.regexp_replace(_c(text), ANY_SSN, "[SSN]")
    return F.regexp_replace(F.regexp_replace(x, EMAIL, "[EMAIL]"), PHONE, "[PHONE]")


def redacted_map(fields: Column | str) -> Column:
    """A map of texts with values under sensitive keys taken out and the others redacted."""
    return F.transform_values(_c(fields), lambda k, v: F.when(F.lower(k).isin(*SENSITIVE_KEYS), F.lit("[REDACTED]")).otherwise(redacted(v)))


def _sanitised(value: Any, key: str | None, clean) -> Any:
    if key and key.lower() in SENSITIVE_KEYS:
        return "[REDACTED]"
    if isinstance(value, dict):
        return {k: _sanitised(v, k, clean) for k, v in value.items()}
    if isinstance(value, list):
        return [_sanitised(v, None, clean) for v in value]
    return clean(value) if isinstance(value, str) else value


@F.pandas_udf(T.StringType())
def redacted_json(s: pd.Series) -> pd.Series:
    """JSON of any depth, redacted by key and by pattern; other text is redacted as such. Depth isn't known, so no column expression can say it."""
    import re

    rules = [(re.compile(p), r) for p, r in ((ANY_SSN, "[SSN]"), (EMAIL, "[EMAIL]"), (PHONE, "[PHONE]"))]

    def clean(t: str) -> str:
        for p, r in rules:
            t = p.sub(r, t)
        return t

    def one(t):
        if t is None:
            return None
        try:
            return json.dumps(_sanitised(json.loads(t), None, clean), ensure_ascii=False)
        except ValueError:
            return clean(t)

    return s.map(one, na_action="ignore")


def guard_reason(text: Column | str, direction: str = "input") -> Column:
    """The first reason to block a text, null if there is none: prompt_injection (of inputs only), ssn, payment_card, secret:<name>."""
    t = _c(text)
    rules = [(t.rlike("(?i)" + "|".join(f"(?:{p})" for p in INJECTION)), "prompt_injection")] if direction == "input" else []
    rules += [(t.rlike(SSN), "ssn"), (has_card(t), "payment_card"), *((t.rlike(p), f"secret:{name}") for name, p in SECRETS.items())]
    out = F.when(rules[0][0], rules[0][1])
    for cond, name in rules[1:]:
        out = out.when(cond, name)
    return out


def verdict(text: Column | str, direction: str = "input") -> Column:
    """(allowed, category, text): blocked texts keep their text; allowed ones are ``redacted`` or ``ok``. Null text gives a null verdict."""
    t = _c(text)
    reason, clean = guard_reason(t, direction), redacted(t)
    category = F.coalesce(reason, F.when(clean != t, "redacted").otherwise("ok"))
    return F.when(t.isNotNull(), F.struct(reason.isNull().alias("allowed"), category.alias("category"), F.when(reason.isNull(), clean).otherwise(t).alias("text")))


def guarded(text: Column | str, direction: str, mode: str, refusal: str) -> Column:
    """The text to use: as it is (modes ``off`` and ``monitor``), or the verdict's, with the refusal for what is blocked (``enforce``)."""
    if mode != "enforce":
        return _c(text)
    v = verdict(text, direction)
    return F.when(v.allowed, v.text).when(_c(text).isNotNull(), F.lit(refusal))


def scrubbed(text: Column | str) -> Column:
    """Every identifier and credential as a placeholder, card numbers only where the Luhn test holds."""
    x = F.regexp_replace(_c(text), SSN, "[SSN]")
    digits = lambda c: F.regexp_replace(c, "[ -]", "")
    cards = F.filter(F.regexp_extract_all(x, F.lit(CARD), F.lit(0)), lambda c: _luhn(digits(c)) & (F.size(F.array_distinct(F.split(digits(c), ""))) > 1))
    x = F.aggregate(cards, x, lambda acc, c: F.replace(acc, c, F.lit("[CARD]")))
    for name, p in SECRETS.items():
        x = F.regexp_replace(x, p, f"[{name.upper()}]")
    return redacted(x)
