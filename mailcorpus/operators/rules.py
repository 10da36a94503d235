"""Starter rules: Spark SQL conditions over ``message_facts``, by the tag that each asserts.

Conditions may call the helpers of ``functions.helpers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailcorpus.functions import columns as C
from mailcorpus.functions import fixed as X

_WORDS = ", ".join(f"'{w}'" for w in X.URGENT_SUBJECT)
_RISKY = ", ".join(f"'{e}'" for e in X.RISKY_EXTENSIONS)
#: The conditions of the starter rules.
RULES = {
    "sender-anomaly": "from_domain is not null and reply_domain is not null and not (from_domain <=> reply_domain)",
    "return-path-anomaly": "from_domain is not null and return_domain is not null and not (from_domain <=> return_domain)",
    "sender-reply-to-org-mismatch": "from_domain is not null and reply_domain is not null and not h_domains_align(from_domain, reply_domain)",
    "sender-return-path-org-mismatch": "from_domain is not null and return_domain is not null and not h_domains_align(from_domain, return_domain)",
    "dmarc-fail": "dmarc <=> 'fail'",
    "auth-fail": "spf <=> 'fail' or dkim <=> 'fail'",
    "lookalike-domain": "array_contains(flags, 'lookalike')",
    "urgency-subject": f"h_includes_any(subject, array({_WORDS}))",
    "risky-attachment": f"h_any_extension(att_names, array({_RISKY}))",
    "many-attachments": "attachment_count >= 4",
    "suspicious-header": "h_matches(x_mailer, 'bulk|mass ?mail|phish')",
    "nested-eml-attachment": "exists(att_exts, e -> e = '.eml') or exists(att_types, t -> t = 'message/rfc822')",
    "possible-pii": r"body rlike '\\b\\d{3}-\\d{2}-\\d{4}\\b' or body rlike '\\b(?:\\d[ -]?){13,19}\\b' or body rlike '\\b[2-9]\\d{3}\\s?\\d{4}\\s?\\d{4}\\b'",
    "dual-extension": "h_any_dual_extension(att_names)",
    "hidden-unicode-subject": "h_has_hidden(subject)",
    "random-subject-token": "h_any_random(subject)",
    "brand-impersonation": "array_contains(flags, 'name-mismatch')",
    "trusted-domain-lookalike": "lookalike_domain",
    "punycode-sender": "array_contains(flags, 'punycode')",
    "high-urgency-score": "urgency_score >= 3",
    "financial-indicator": "size(financial) > 0",
    "bec-combined-signal": "urgency_score >= 2 and size(financial) > 0",
    "many-recipients-25": "recipient_count > 25 and recipient_count <= 75",
    "many-recipients-75": "recipient_count > 75 and recipient_count <= 200",
    "many-recipients-200": "recipient_count > 200 and recipient_count <= 500",
    "many-recipients-500": "recipient_count > 500",
    "flagged-domain-category": "size(categories) > 0",
}


def rule_facts(messages: DataFrame, scanned: int | None = None) -> DataFrame:
    """The columns that rules name, on top of a flat message table.

    Signs of urgency and money are looked for in whole bodies, or in the ``scanned`` first characters of them.
    """
    body = F.substring("body", 1, scanned) if scanned else F.col("body")
    names = F.coalesce("att_names", F.array().cast("array<string>"))
    types = F.coalesce("att_types", F.array().cast("array<string>")) if "att_types" in messages.columns else F.array().cast("array<string>")
    if "lookalike_domain" not in messages.columns:
        messages = messages.withColumn("lookalike_domain", F.lit(False))
    near = C.any_of([F.levenshtein("from_domain", F.lit(b), 2).between(0, 2) & (F.col("from_domain") != b) for b in X.BRANDS])
    flags = F.array_compact(F.array(F.when(near, "lookalike"), F.when(C.brand_mismatch(F.col("from_name"), F.col("from_domain")), "name-mismatch"), F.when(C.is_punycode(F.col("from_domain")), "punycode")))
    return messages.withColumns({
        "from_org": C.registrable_domain(F.col("from_domain")), "reply_org": C.registrable_domain(F.col("reply_domain")), "return_org": C.registrable_domain(F.col("return_domain")),
        "flags": flags, "att_exts": F.transform(names, C.extension), "att_types": types, "attachment_count": F.size(names), "dual_extension": F.exists(names, C.dual_extension),
        "hidden_in_subject": C.hidden_unicode_count(F.col("subject")), "h_any_random(subject)": F.exists(F.split("subject", r"\s+"), lambda w: C.looks_random(w)),
        "urgency_score": C.urgency_score(body), "financial": C.financial_indicators(body),
    })
