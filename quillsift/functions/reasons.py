"""Outcomes and rules that end up in written rows (fixed values)."""

PAIR = "dpo_pair"
FIRST_FAILED = "first_generation_failed"
FIRST_GOOD = "first_generation_already_correct_secure"
REVISION_FAILED = "revision_failed"
REVISION_BAD = "revision_not_correct_secure"
NO_REFERENCE = "missing_reference_code"
REFERENCE_FAILED = "reference_eval_failed"
REFERENCE_BAD = "reference_not_correct_secure"
NO_ATTEMPTS = "no_negative_attempts"
NEGATIVE_FAILED = "negative_generation_failed"
NEGATIVE_BAD = "negative_did_not_match_filter"
REVISION_RULE = "first_not_correct_secure_revision_correct_secure"
NEGATIVE_RULE = "reference_correct_secure_rejected_functional_insecure"
