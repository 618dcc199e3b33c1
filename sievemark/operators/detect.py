"""Tier-0 detection: texts to personal-data elements, by patterns in precedence order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.domains import FORMAT_ONLY, INVALID_CHECKSUM, VALID
from sievemark.functions.claims import claims
from sievemark.functions.regex_spans import last_match_end, preceding
from sievemark.functions.validate import detector_value, status_of

# Patterns in precedence order, group 1 being the value; and the shape, in digits and the like, that a text must hold.
RULES: tuple[tuple[str, str, str], ...] = (
    ("email", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})\b", "@"),
    ("credit_card", r"(?<![\d-])(\d{4}([ -])\d{4}\2\d{4}\2\d{4})(?![\d-])", r"\d{4}[ -]\d{4}"),
    ("credit_card", r"(?<![\d-])(\d{4}([ -])\d{6}\2\d{5})(?![\d-])", r"\d{4}[ -]\d{6}"),
    ("credit_card", r"(?<![\d-])(\d{13,19})(?![\d-])", r"\d{13}"),
    ("phone", r"(?<![\d-])(\(([2-9]\d{2})\)\s?[2-9]\d{2}-\d{4})(?![\d-])", r"\(\d{3}\)"),
    ("phone", r"(?<![\d-])((?:\+?1[ .-])?[2-9]\d{2}([ .-])[2-9]\d{2}\2\d{4})(?![\d-])", r"\d{3}[ .-]\d{3}[ .-]\d{4}"),
    ("ssn", r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])", r"\d{3}-\d{2}-\d{4}"),
    ("ssn", r"(?<!\d )(?<!\d)(\d{3} \d{2} \d{4})(?!\d)(?! \d)", r"\d{3} \d{2} \d{4}"),
    ("ssn_last4", r"(?i:social\s+security(?:\s+number)?|\bssn\b)[^\n]{0,40}?(?i:ending\s+in|ending|last[\s-]?(?:four|4))[^\n\d]{0,15}(?<!\d)(\d{4})(?![\d-])", r"\d{4}"),
    ("passport", r"(?i:passport)(?:(?i:\s+(?:number|no\.?)))?\s*[:#|]?\s*(?<![\d-])(\d{9})(?![\d-])", r"\d{9}"),
    ("ssn", r"(?i:social\s+security(?:\s+number)?|\bssn\b)\s*[:#|]?\s*(?<![\d-])(\d{9})(?![\d-])", r"\d{9}"),
    ("financial_account", r"(?i:acc(?:oun)?t)(?:(?i:\s+(?:number|no\.?)))?\s*[:#|]?\s*(?<![\d-])(\d{9,12})(?![\d-])", r"\d{9}"),
    ("drivers_license", r"(?i:driver'?s?\s+licen[cs]e|licen[cs]e(?:\s+(?:number|no\.?))?|\bdl\b)\s*[:#|]?\s*([A-Z]\d{7})(?![0-9A-Za-z])", r"[A-Z]\d{7}"),
    ("employee_id", r"(?<![A-Za-z0-9])(E\d{5})(?![A-Za-z0-9])", r"E\d{5}"),
)
# What makes a hit a trap, looked for in so many characters before it.
BUSINESS_REFERENCE = (64, r"(?i)\b(?:order|invoice|ticket|case|claim|p\.?o\.?|purchase\s+order|ref(?:erence)?|confirmation|tracking|serial)\b(?:\s+(?:number|no\.?|num))?\s*[:#]?")
AFFIRMING = r"(?i)(?:\bssn\b|social\s+security|card\s+number|credit\s+card|card\s+on\s+file|\bcard\b|\bacc(?:oun)?t\b|direct\s+deposit|payroll|w-2|passport|licen[cs]e|\bmember\b|\bemployee\b|\bphone\b|\bcall\b|e-?mail|\bcontact\b)"
PLACEHOLDER_VALUE = r"^\{\{[^}]*\}\}$|^\[[^\]]+\]$|^<[^>]+>$|[Xx*#]{2,}[\s-]"
PLACEHOLDER = (80, r"(?i)(?:\bin\s+the\s+format|\bformat[:\s]|\btemplate\b|\bplaceholder\b|\bfor\s+example\b|\be\.g\.|\bsuch\s+as\b|\bmust\s+be\s+replaced\b)")
TEST_RECORD = (240, r"(?i:\b(?:test\s+record|do\s+not\s+process|test\s+user|test\s+data|sample\s+data|sample\s+record|qa\s+automation|dummy)\b)|\b(?:TEST|SAMPLE|DUMMY|EXAMPLE)\b")
SIGNATURE = (160, r"(?i)(?:\breported\s+by\b|\bhandled\s+by\b|\bregards\b|\bbest\s+regards\b|\bsincerely\b|\byours\s+truly\b|\brespectfully\b|\bsigned\b|\bthanks\b|\bthank\s+you\b)")

#: Characters before a hit that the widest of these tests looks at.
WIDEST = max(BUSINESS_REFERENCE[0], PLACEHOLDER[0], TEST_RECORD[0], SIGNATURE[0])
#: Where digits, at signs and what belongs to them stand, with the letter or bracket before them.
TRIGGER = r"[A-Za-z(+]?[\d@][\d .()@+-]*"

_claimed = claims([(pattern, shape) for _, pattern, shape in RULES], TRIGGER, PLACEHOLDER_VALUE, WIDEST, 40)


def trap_reason(text: Column, start: Column, element_type: Column) -> Column:
    """The first of business_reference, placeholder, test_record and signature_block that applies, or null.

    For a business reference the nearest label before the value decides.
    """
    near = preceding(text, start, BUSINESS_REFERENCE[0])
    reference, affirming = last_match_end(near, BUSINESS_REFERENCE[1]), last_match_end(near, AFFIRMING)
    business = reference.isNotNull() & (affirming.isNull() | (affirming < reference))
    return (
        F.when(element_type.isin("ssn", "ssn_last4", "credit_card") & business, "business_reference")
        .when(preceding(text, start, PLACEHOLDER[0]).rlike(PLACEHOLDER[1]), "placeholder")
        .when(preceding(text, start, TEST_RECORD[0]).rlike(TEST_RECORD[1]), "test_record")
        .when(element_type.isin("email", "phone") & preceding(text, start, SIGNATURE[0]).rlike(SIGNATURE[1]), "signature_block")
    )


def detect(passages: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per detected element, beside all columns of its passage.

    Adds ``element_type, value_raw, value_normalized, char_start, char_end,
    validation_status, trap_reason, detector, snippet``; a trapped hit is format_only.
    Passages without a digit or an at sign are left at the scan. A text is looked at once,
    and a hit carries the characters around it, so no later test goes back to the text. Null and empty texts
    give no row. A passage column with one of the added names is replaced.
    """
    text = F.col(text_col)
    types = F.array(*[F.lit(t) for t, _, _ in RULES])
    hit = passages.where(text.rlike(r"(?U)[\d@]")).withColumn("_hit", F.explode(_claimed(text)))
    kind, value, start, before = F.element_at(types, F.col("_hit.rule") + 1), F.col("_hit.value"), F.col("_hit.start"), F.col("_hit.before")
    hit = hit.withColumns({"element_type": kind, "value_raw": value, "char_start": start, "char_end": F.col("_hit.end"), "snippet": F.col("_hit.snippet")})
    kind = F.col("element_type")
    hit = hit.withColumns({"value_normalized": detector_value(kind, F.col("value_raw")), "trap_reason": trap_reason(before, F.length(before), kind)})
    status = F.when(F.col("trap_reason").isNotNull(), FORMAT_ONLY).otherwise(status_of(kind, F.col("value_normalized")))
    hit = hit.withColumn("validation_status", status)
    checked = F.col("validation_status").isin(VALID, INVALID_CHECKSUM) & kind.isin("ssn", "credit_card", "phone")
    return hit.withColumn("detector", F.when(checked, "checksum").otherwise("regex")).drop("_hit")


def cross_passage_traps(passages: DataFrame, hits: DataFrame, doc_col: str = "doc_id", seq_col: str = "seq", text_col: str = "text") -> DataFrame:
    """Hits whose trap shows only in the passages before: the text before a passage joins its own.

    ``passages`` has doc, seq, kind, part and text; ``hits`` the same keys and the columns of
    ``detect``. An address or number in an e-mail's headers is ``staff_header``. For a text
    block after the first, the last characters of the passages before it, as many as the
    widest window, come before its own. Only those characters are carried, so a document's
    text is never gathered.
    """
    tail = F.right(F.concat(F.lit("\n"), F.col(text_col)), F.lit(WIDEST))
    before = Window.partitionBy(doc_col).orderBy(seq_col).rowsBetween(-WIDEST, -1)
    carried = passages.withColumn("_before", F.right(F.array_join(F.collect_list(tail).over(before), ""), F.lit(WIDEST)))
    keyed = carried.select(doc_col, seq_col, F.col("kind").alias("_kind"), F.col("part").alias("_part"), F.concat("_before", F.lit("\n"), F.col(text_col)).alias("_text"), (F.length("_before") + 1).alias("_shift"))
    joined = hits.join(keyed, [doc_col, seq_col], "left")
    wide = trap_reason(F.col("_text"), F.col("char_start") + F.col("_shift"), F.col("element_type"))
    header = (F.col("_part") == "headers") & F.col("element_type").isin("email", "phone")
    reason = F.coalesce("trap_reason", F.when(header, "staff_header"), F.when((F.col("_kind") == "text_block") & (F.col(seq_col) > 0), wide))
    return (
        joined.withColumn("trap_reason", reason)
        .withColumn("validation_status", F.when(F.col("trap_reason").isNotNull(), FORMAT_ONLY).otherwise(F.col("validation_status")))
        .drop("_kind", "_part", "_text", "_shift")
    )
