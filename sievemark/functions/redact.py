"""Redaction of JSON records: values of named keys at any depth, without a schema."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Keys whose values never leave, and what stands in their place (fixed values).
KEYS = ("value_raw", "value", "password", "api_key")
REDACTED = "[REDACTED]"

_STRING = r'"(?:[^"\\]++|\\.)*+"'
_PIECE = re.compile(r'"(?:[^"\\]++|\\.)*+"|[\[\]{}]', re.DOTALL)


def _key(keys: tuple[str, ...]) -> str:
    """A whole key of these and its colon: a quote that no backslash leads opens or ends a string, and only keys have a colon after them."""
    return r'(?<!\\)"(?:' + "|".join(rf"\Q{k}\E" for k in keys) + r')"\s*+:\s*+'


def _nested(keys: tuple[str, ...]):
    """The objects and arrays under ``keys`` replaced: from such a key, brackets outside strings are counted up to the one that closes."""
    begins = re.compile(_key(keys).replace(r"\Q", "").replace(r"\E", "") + r"(?=[\[{])", re.ASCII)

    def cut(text: str) -> str:
        out, at = [], 0
        while found := begins.search(text, at):
            depth = 0
            for piece in _PIECE.finditer(text, found.end()):
                depth += 1 if piece[0] in "[{" else -1 if piece[0] in "]}" else 0
                if not depth:
                    break
            out += [text[at : found.end()], f'"{REDACTED}"']
            at = piece.end()
        return "".join([*out, text[at:]]) if out else text

    @F.pandas_udf(StringType())
    def run(records: pd.Series) -> pd.Series:
        return records.map(cut, na_action="ignore")

    return run


def redact_json(record: Column, keys: tuple[str, ...] = KEYS) -> Column:
    """The JSON text ``record`` with ``"[REDACTED]"`` for the value of each of ``keys``, in objects and arrays of any depth.

    Strings, numbers and literals are replaced where they stand, and everything else
    stays letter for letter. Where such a key holds an object or array, the record is
    scanned once from there for its end, and the whole value goes. A record with escaped
    letters is first put in plain form, so that a key cannot hide. Text that is no
    JSON gives null, as nothing can be said of it; null gives null. Keys are names of letters, digits and underscores.
    """
    if not all(k.replace("_", "a").isalnum() and k.isascii() for k in keys):
        raise ValueError("keys of ASCII letters, digits and underscores")
    parsed = F.try_parse_json(record)
    plain = F.when(record.rlike(r"\\u00[2-7]"), F.to_json(parsed)).otherwise(record)
    simple = F.regexp_replace(plain, rf"(?s)({_key(keys)})(?:{_STRING}|[^\s\[\]{{}},\"]++)", f'$1"{REDACTED}"')
    return F.when(parsed.isNotNull(), _nested(keys)(simple))
