"""Personal data in columns: scans of values, hints in names, risk, alerts and redaction."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import bound
from lodestone.operators.stats import long_form

#: Kinds of personal values with their forms, in the order in which they are tried. A value has a kind if
#: all forms of an entry fit it; letters count in either case where a form says so.
VALUE_FORMS: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("SSN", (r"^[0-9]{3}-?[0-9]{2}-?[0-9]{4}$",)),
    ("CreditCard", (r"^(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$",)),
    ("CreditCard", (r"^[0-9]{4}[ \t\n\r-]?[0-9]{4}[ \t\n\r-]?[0-9]{4}[ \t\n\r-]?[0-9]{4}$",)),
    ("Email", (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",)),
    ("PhoneNumber", (r"^(\+1)?[ \t\n\r.-]?\(?[0-9]{3}\)?[ \t\n\r.-]?[0-9]{3}[ \t\n\r.-]?[0-9]{4}$",)),
    ("IPAddress", (r"^(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)$",)),
    ("IPAddress", (r"^([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}$",)),
    ("MACAddress", (r"^([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})$",)),
    ("UUID", (r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",)),
    ("URL", (r"(?i)^https?://[^ \t\n\r/$.?#].[^ \t\n\r]*$",)),
    ("DateOfBirth", (r"^(0[1-9]|1[0-2])/(0[1-9]|[12][0-9]|3[01])/(19|20)[0-9]{2}$",)),
    ("DateOfBirth", (r"^(19|20)[0-9]{2}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",)),
    ("USState", (r"(?i)^(AL|AK|AZ|AR|CA|CO|CT|DE|FL|GA|HI|ID|IL|IN|IA|KS|KY|LA|ME|MD|MA|MI|MN|MS|MO|MT|NE|NV|NH|NJ|NM|NY|NC|ND|OH|OK|OR|PA|RI|SC|SD|TN|TX|UT|VT|VA|WA|WV|WI|WY|DC)$",)),
    ("ZipCode", (r"^[0-9]{5}(-[0-9]{4})?$",)),
    ("VIN", (r"(?i)^[A-HJ-NPR-Z0-9]{17}$",)),
    ("IBAN", (r"(?i)^[A-Z]{2}[0-9]{2}[A-Z0-9]{4,30}$",)),
    ("RoutingNumber", (r"^[0-9]{9}$",)),
    ("PhoneNumber", (r"^\+?[1-9][0-9]{9,14}$",)),
    ("PassportNumber", (r"(?i)^[A-Z0-9]{6,9}$", r"[0-9]")),
    ("BankAccount", (r"^[0-9]{8,17}$",)),
)
#: What a column's lower-case name says, in order; a name has all parts of one of the groups, or is a word whole.
NAME_HINTS: tuple[tuple[str, tuple[tuple[str, ...], ...], tuple[str, ...]], ...] = (
    ("SSN", (("ssn",), ("social_security",), ("socialsecurity",)), ()),
    ("CreditCard", (("credit", "card"), ("credit", "number"), ("card_number",), ("cardnumber",), ("cc_num",)), ()),
    ("Email", (("email",), ("e_mail",), ("e-mail",)), ()),
    ("PhoneNumber", (("phone",), ("mobile",), ("cell",), ("tel",)), ()),
    ("Address", (("address",), ("street",), ("addr",)), ()),
    ("PersonName", (("first_name",), ("last_name",), ("firstname",), ("lastname",), ("full_name",)), ("name",)),
    ("IPAddress", (("ip_address",), ("ipaddress",)), ("ip",)),
    ("DateOfBirth", (("dob",), ("birth",)), ()),
    ("PassportNumber", (("passport",),), ()),
    ("DriversLicense", (("license",), ("licence",), ("dl_",)), ()),
)
#: Kinds by how grave their loss is.
GRAVE, PLAIN = ("SSN", "CreditCard", "BankAccount", "PassportNumber"), ("Email", "PhoneNumber", "DriversLicense", "DateOfBirth")
#: Levels of risk from none up, the severity of their alerts, and what is to be done.
LEVELS = ("None", "Low", "Medium", "High", "Critical")
SEVERITY = {"Critical": "Error", "High": "Error", "Medium": "Warning", "Low": "Info"}
ACTIONS = {
    "Critical": "EXCLUDE from output or use heavy masking (e.g., hash)", "High": "Mask or redact values in synthetic output",
    "Medium": "Consider using Faker patterns for realistic pseudonymization", "Low": "Safe for synthetic generation with distribution matching", "None": "No action needed",
}
#: Labels that stand before redacted values.
LABELS = {
    "SSN": "<SSN>", "CreditCard": "<CARD>", "BankAccount": "<ACCT>", "PassportNumber": "<PASSPORT>", "DriversLicense": "<DL>", "Email": "<EMAIL>", "PhoneNumber": "<PHONE>",
    "IPAddress": "<IP>", "PersonName": "<NAME>", "Address": "<ADDR>", "DateOfBirth": "<DOB>", "Other": "<PII>",
}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _named(names: dict[str, str], key: Column, otherwise: str | None = None) -> Column:
    """The value of a small fixed table for a key."""
    out = F.lit(otherwise)
    for name, value in names.items():
        out = F.when(key == name, value).otherwise(out)
    return out


def value_kind(value: Column) -> Column:
    """Kind of a value: the first form that it has; null for none."""
    kind = F.lit(None).cast("string")
    for name, forms in reversed(VALUE_FORMS):
        kind = F.when(_all([value.rlike(form) for form in forms]), name).otherwise(kind)
    return F.when(may_be_personal(value), kind)


def may_be_personal(value: Column) -> Column:
    """A cheap test that every value of some kind passes: it has a digit, an @ or a colon, or the length of a state, VIN or UUID."""
    return value.rlike("[0-9@:]") | F.length(value).isin(2, 17, 36)


def name_kind(name: Column) -> Column:
    """Kind that a column's name hints at; null for none."""
    low, kind = F.lower(name), F.lit(None).cast("string")
    for found, groups, whole in reversed(NAME_HINTS):
        there = [_all([low.contains(part) for part in parts]) for parts in groups] + [low == word for word in whole]
        kind = F.when(_any(there), found).otherwise(kind)
    return kind


def risk(kind: Column, rate: Column) -> Column:
    """How much is at stake if a kind makes up so much of a column."""
    return F.when(kind.isin(*GRAVE), F.when(rate > 0.7, "Critical").otherwise("High")).when(kind.isin(*PLAIN), F.when(rate > 0.7, "High").otherwise("Medium")).otherwise(F.when(rate > 0.7, "Medium").otherwise("Low"))


def scan_columns(df: DataFrame, columns: list[str], least: float = 0.1) -> DataFrame:
    """Kinds that make up more than ``least`` of the distinct values of a column."""
    values = long_form(df, columns).distinct()
    kinds = values.groupBy("column_name", value_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))
    totals = F.broadcast(kinds.groupBy("column_name").agg(F.sum("n").alias("total")))  # a row a column
    rate = F.col("n") / F.col("total")
    return kinds.join(totals, "column_name").select("column_name", "kind", "n", rate.alias("rate")).filter(F.col("kind").isNotNull() & (F.col("rate") > least)).withColumn("risk", risk(F.col("kind"), F.col("rate"))).withColumn("is_pii", F.col("rate") > 0.5)


def columns_at_risk(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column its leading kind, from its values or else from its name, with confidence, risk and the verdict."""
    best = scan_columns(df, columns).groupBy("column_name").agg(F.max_by(F.struct("kind", "rate", "risk", "is_pii"), F.struct("rate", "kind")).alias("b")).select("column_name", "b.*")
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")  # a row a column
    hinted = names.join(best, "column_name", "left").withColumn("hint", name_kind(F.col("column_name"))).filter("kind is not null or hint is not null")
    by_name = F.col("kind").isNull()
    return hinted.select(
        "column_name", F.coalesce("kind", "hint").alias("kind"), F.coalesce("rate", F.lit(0.3)).alias("confidence"), F.when(by_name, "Medium").otherwise(F.col("risk")).alias("risk"),
        F.when(by_name, True).otherwise(F.col("is_pii")).alias("is_pii"), by_name.alias("from_name"),
    )


def alerts(found: DataFrame) -> DataFrame:
    """An alert for each column that ``columns_at_risk`` holds to be personal."""
    message = F.concat(F.lit("Potential "), "kind", F.lit(" detected ("), F.round(100 * F.col("confidence")).cast("int").cast("string"), F.lit("% confidence). Risk level: "), "risk", F.lit(". Consider masking or excluding this column."))
    return found.filter("is_pii").select("column_name", _named(SEVERITY, F.col("risk"), "Info").alias("severity"), message.alias("message"))


def ensemble_risk(df: DataFrame, columns: list[str]) -> DataFrame:
    """Overall risk of text columns: the higher of what their values' forms and their uniqueness tell, and the action to take."""
    kinds = scan_columns(df, columns).groupBy("column_name").agg(F.max(F.col("kind").isin("SSN", "CreditCard", "BankAccount")).alias("grave"), F.max("rate").alias("rate"))
    counts = long_form(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n")).groupBy("column_name").agg((F.count("*") / F.sum("n")).alias("unique_share"))
    level = lambda name: LEVELS.index(name)
    by_form = F.when(F.col("rate").isNull(), level("None")).when(F.col("grave"), level("Critical")).when(F.col("rate") > 0.7, level("High")).otherwise(level("Medium"))
    by_use = F.when(F.col("unique_share") > 0.99, level("High")).when(F.col("unique_share") > 0.9, level("Medium")).otherwise(level("None"))
    named = F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest(by_form, by_use) + 1)
    return counts.join(kinds, "column_name", "left").select("column_name", "unique_share", named.alias("risk")).withColumn("action", _named(ACTIONS, F.col("risk")))


def token_kinds(df: DataFrame, text: str) -> DataFrame:
    """How many tokens, parted by white space and less their quotes and stops, of each kind a text column holds.

    Tokens that can be of no kind leave at once; of the others each distinct one is classified once.
    """
    token = F.rtrim(F.ltrim(F.col("token"), F.lit(",;:()<>\"'")), F.lit(".,;:()<>\"'"))
    tokens = df.select(F.explode(F.split(F.col(text), "\\s+")).alias("token")).select(token.alias("token")).filter(may_be_personal(F.col("token")))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).select("n", value_kind(F.col("token")).alias("kind"))
    return counts.filter("kind is not null").groupBy("kind").agg(F.sum("n").alias("n"))


def masked(value: Column, kind: Column, visible: int = 2, labelled: bool = True) -> Column:
    """A value of a kind with its middle hidden, after its kind's label; a value of no kind stays.

    The last four digits of numbers and a mail address's last label can be seen, of others ``visible`` characters at both ends.
    """
    length = F.length(value)
    seen = F.least(F.lit(visible), F.floor(length / 2).cast("int"))
    stars = F.repeat(F.lit("*"), F.greatest(F.lit(3), F.least(F.lit(10), length - 2 * seen)))
    last = F.when(length >= 4, F.substring(value, -4, 4)).otherwise(F.lit("****"))
    local, host = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    mail = F.concat(F.when(F.length(local) > seen, F.substring(local, F.lit(1), seen)).otherwise(F.lit("")), stars, F.lit("@"), stars, F.when(host.contains("."), F.concat(F.lit("."), F.substring_index(host, ".", -1))).otherwise(F.lit("")))
    ends = F.concat(F.substring(value, F.lit(1), seen), stars, F.substring(value, length - seen + 1, seen))
    label = F.concat(_named(LABELS, kind, ""), F.lit(" "))
    plain = F.concat(F.when(label == " ", F.lit("")).otherwise(label), ends) if labelled else ends
    shown = F.when((kind == "Email") & (F.length(value) - F.length(F.replace(value, F.lit("@"))) == 1), mail).when((kind == "SSN") & value.contains("-"), F.concat(F.lit("***-**-"), last))
    shown = shown.when(kind == "CreditCard", F.concat(F.lit("**** **** **** "), F.when(length >= 4, F.substring(value, -4, 4)).otherwise(value))).when(kind == "PhoneNumber", F.concat(F.lit("***-***-"), last)).otherwise(plain)
    return F.when(kind.isNull(), value).otherwise(shown)


def redact_text(text: Column, allow: Collection[str] = ()) -> Column:
    """A text in which every token of a kind is masked; kinds in ``allow`` stay. White space is kept as it is."""
    lead, tail = r"^[,;:()<>\"']+", r"[.,;:()<>\"']+$"
    # runs of words of 3 to 16 letters, which ``may_be_personal`` lets none pass, and other tokens and gaps one by one
    piece = r"(?:\p{L}{3,16}+[.,;]*+\s++){1,30}+|\S++|\s++"

    def masks(t: Column, bare: Column) -> Column:
        kind = value_kind(bare)
        hide = F.when(kind.isin(*allow), F.lit(None)).otherwise(kind) if allow else kind
        return bound(hide, lambda k: F.when(k.isNull(), t).otherwise(F.concat(F.regexp_extract(t, lead, 0), masked(bare, k), F.regexp_extract(t, tail, 0))))

    def token(t: Column) -> Column:
        return bound(F.rtrim(F.ltrim(t, F.lit(",;:()<>\"'")), F.lit(".,;:()<>\"'")), lambda bare: masks(t, bare))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(0)), lambda p: F.when(p.rlike(r"\s"), p).otherwise(token(p))), "")
