"""Structural checks and normal forms of detected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.domains import FORMAT_ONLY, INVALID_CHECKSUM, VALID

# The syntax of an address, types compared by digits, and the structural rules below.
EMAIL_SYNTAX = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"
_DIGIT_TYPES = ("ssn", "ssn_last4", "credit_card", "passport", "financial_account")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def ssn_valid(value: Column) -> Column:
    """Nine digits whose area is 001-899 but not 666, with no zero group or serial."""
    return value.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def luhn_valid(value: Column) -> Column:
    """Two digits or more whose Luhn sum divides by ten."""
    return value.rlike("^[0-9]{2,}$") & F.coalesce(F.call_function("luhn_check", value), F.lit(False))


def nanp_valid(value: Column) -> Column:
    """Ten digits, or eleven from 1, whose area and exchange begin with 2-9."""
    return value.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$")


def phone_digits(value: Column) -> Column:
    return F.regexp_replace(digits(value), "^1([0-9]{10})$", "$1")


def detector_value(element_type: Column, value: Column) -> Column:
    """Normal form of a detected value: digits, a telephone without country code, an address in lower case, else as it stands."""
    return F.when(element_type.isin(*_DIGIT_TYPES), digits(value)).when(element_type == "phone", phone_digits(value)).when(element_type == "email", F.lower(value)).otherwise(value)


def status_of(element_type: Column, value: Column) -> Column:
    """``valid`` or ``invalid_checksum`` where a check exists; e-mail is valid or format_only; else format_only."""
    checked = F.when(element_type == "ssn", ssn_valid(value)).when(element_type == "credit_card", luhn_valid(value)).when(element_type == "phone", nanp_valid(value))
    return (
        F.when(checked, VALID).when(element_type.isin("ssn", "credit_card", "phone"), INVALID_CHECKSUM)
        .when((element_type == "email") & value.rlike(EMAIL_SYNTAX), VALID).otherwise(FORMAT_ONLY)
    )
