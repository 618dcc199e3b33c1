"""Normal forms of names, dates of birth and other values, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark.functions.validate import digits, phone_digits

# Given names and their nicknames.
NICKNAMES: dict[str, tuple[str, ...]] = {
    "robert": ("bob", "rob", "bobby", "robbie"),
    "william": ("bill", "will", "billy", "willie"),
    "elizabeth": ("liz", "beth", "betsy", "eliza", "lizzie"),
    "margaret": ("peggy", "meg", "maggie", "marge"),
    "james": ("jim", "jimmy", "jamie"),
    "john": ("jack", "johnny", "jon"),
    "michael": ("mike", "mikey"),
    "katherine": ("kate", "katie", "kathy", "kit"),
    "jennifer": ("jen", "jenny"),
    "richard": ("rick", "richie", "dick", "ricky"),
    "thomas": ("tom", "tommy"),
    "christopher": ("chris", "kit", "topher"),
    "patricia": ("pat", "patty", "tricia", "trish"),
    "daniel": ("dan", "danny"),
    "anthony": ("tony",),
    "steven": ("steve",),
    "stephen": ("steve",),
    "edward": ("ed", "eddie", "ted", "ned"),
    "theodore": ("ted", "teddy", "theo"),
    "susan": ("sue", "susie"),
    "joseph": ("joe", "joey"),
    "charles": ("charlie", "chuck"),
    "andrew": ("andy", "drew"),
    "nicholas": ("nick",),
    "samantha": ("sam",),
    "samuel": ("sam", "sammy"),
    "alexander": ("alex", "sasha"),
    "alexandra": ("alex", "sasha", "lexi"),
    "benjamin": ("ben", "benny"),
    "rebecca": ("becky",),
    "deborah": ("deb", "debbie"),
    "timothy": ("tim",),
    "matthew": ("matt",),
    "victoria": ("vicky", "tori"),
    "patrick": ("pat", "paddy"),
    "christine": ("chris", "chrissy"),
    "christina": ("chris", "tina"),
}
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v", "md", "phd", "esq", "dds")
#: Date formats in the order of their trial: the shape a text must have, and Spark's pattern.
DATE_FORMATS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Za-z]+ \d{4}$", "d MMMM yyyy"),
)


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def canonicals(given: Column) -> Column:
    """Given names that ``given`` may stand for, itself included, sorted; a bare initial stands for itself."""
    stands: dict[str, list[str]] = {}
    for name, nicks in NICKNAMES.items():
        for nick in nicks:
            stands.setdefault(nick, []).append(name)
    table = F.create_map(*[x for nick, names in stands.items() for x in (F.lit(nick), F.array(*map(F.lit, names)))])
    longer = F.coalesce(F.try_element_at(table, given), F.array().cast("array<string>"))
    known = F.when(F.length(given) > 1, longer).otherwise(F.array().cast("array<string>"))
    return F.when(given.isNotNull(), F.array_sort(F.array_distinct(F.array_append(known, given)))).otherwise(F.array().cast("array<string>"))


def normal_name(raw: Column) -> Column:
    """A struct of ``full, tokens, given, surname, given_is_initial, canonicals, was_reordered``; null for a blank name.

    "Last, First" is turned round at its first comma; apostrophes vanish, other marks
    part tokens, suffixes drop; the first token is the given name, the last of two or
    more the surname.
    """
    text = F.trim(raw)
    comma = F.locate(",", text)
    left, right = F.trim(F.substring(text, F.lit(1), comma - 1)), F.trim(F.substring(text, comma + 1, F.length(text)))
    turned = (comma > 0) & (left != "") & (right != "")
    plain = F.when(turned, F.concat_ws(" ", right, left)).otherwise(text)
    spaced = F.regexp_replace(F.regexp_replace(fold(plain), "['`’]", ""), r"[^\p{L}\p{N}\s]", " ")
    tokens = F.filter(F.split(spaced, r"\s+"), lambda t: (t != "") & ~t.isin(*SUFFIXES))
    given = F.try_element_at(tokens, F.lit(1))
    surname = F.when(F.size(tokens) >= 2, F.try_element_at(tokens, F.lit(-1)))
    return F.when(text != "", F.struct(
        F.array_join(tokens, " ").alias("full"), tokens.alias("tokens"), given.alias("given"), surname.alias("surname"),
        F.coalesce(F.length(given) == 1, F.lit(False)).alias("given_is_initial"), canonicals(given).alias("canonicals"), turned.alias("was_reordered"),
    ))


def iso_date(raw: Column) -> Column:
    """A date of birth as yyyy-mm-dd, or null; a two-digit year above 68 lies in the 1900s."""
    text = F.trim(raw)
    tried = [F.when(text.rlike(shape), F.try_to_date(text, form)) for shape, form in DATE_FORMATS]
    year = F.regexp_extract(text, r"/(\d\d)$", 1)
    century = F.when(year > "68", F.lit("19")).otherwise(F.lit("20"))
    short = F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d\d$"), F.try_to_date(F.concat(F.regexp_extract(text, r"^(.*/)\d\d$", 1), century, year), "M/d/yyyy"))
    return F.date_format(F.coalesce(*tried, short), "yyyy-MM-dd")


def plain_text(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(raw), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def normal_value(element_type: Column, raw: Column) -> Column:
    """The normal form of a value under which equal identifiers compare equal."""
    mail = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^[.,;:<>()\[\]]+|[.,;:<>()\[\]]+$", ""), "^(?i:mailto:)", "")
    return (
        F.when(element_type.isin("ssn", "ssn_last4", "credit_card", "financial_account"), digits(raw))
        .when(element_type == "phone", phone_digits(raw)).when(element_type == "email", fold(mail))
        .when(element_type == "dob", F.coalesce(iso_date(raw), plain_text(raw)))
        .when(element_type.isin("employee_id", "drivers_license", "passport"), F.regexp_replace(F.upper(raw), "[^A-Z0-9]", ""))
        .when(element_type == "name", normal_name(raw)["full"]).when(element_type == "credential", F.trim(raw))
        .otherwise(plain_text(raw))
    )


def deletion_keys(surname: Column) -> Column:
    """The surname and each form of it with one character left out; shorter than three, itself alone."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(surname)), lambda k: F.concat(F.substring(surname, F.lit(1), k - 1), F.substring(surname, k + 1, F.length(surname))))
    return F.when(F.length(surname) < 3, F.array(surname)).when(surname.isNotNull(), F.array_distinct(F.array_prepend(shorter, surname)))
