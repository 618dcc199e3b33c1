"""Closed domains of the data model (fixed values)."""

CATEGORIES = ("ssn", "dob", "drivers_license", "passport", "financial_account", "credit_card", "medical", "credentials", "address", "phone", "email")
#: Element type to exposure category; a name exposes nothing.
ELEMENT_CATEGORY = {
    "ssn": "ssn", "ssn_last4": "ssn", "dob": "dob", "drivers_license": "drivers_license", "passport": "passport",
    "financial_account": "financial_account", "credit_card": "credit_card", "medical": "medical", "credential": "credentials",
    "address": "address", "phone": "phone", "email": "email",
}
VALID, INVALID_CHECKSUM, FORMAT_ONLY = "valid", "invalid_checksum", "format_only"
#: Types for which only ``valid`` counts; for all others ``format_only`` counts too.
VERDICT_TYPES = ("ssn", "credit_card", "phone", "email")
#: Identifiers that decide identity.
STRONG_TYPES = ("ssn", "email", "phone", "financial_account", "credit_card", "employee_id", "drivers_license", "passport")
#: Confidence of an element without a stored one, by detector; any other detector counts 0.5.
DETECTOR_CONFIDENCE = {"checksum": 0.95, "regex": 0.85, "llm_tier1": 0.75, "llm_tier2": 0.75, "reviewer": 0.99}
