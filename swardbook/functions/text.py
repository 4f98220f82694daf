"""Column functions for names, money, dates and line notes. Built-ins only, no UDF.

Blank-and-strip follows ASCII white space. Amounts are decimals and round half
up at every stage.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = Decimal("0.0635")
#: Fixed value: what an address to mail to looks like.
EMAIL = r"(?i)([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})"
CHANNELS = ("email", "sms", "mail")


def strip(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Strip, and one space between words."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def money(c: Column) -> Column:
    """decimal(18,2), half up; null counts as zero."""
    return F.round(F.coalesce(c.cast("decimal(24,6)"), F.lit(0).cast("decimal(24,6)")), 2).cast("decimal(18,2)")


def money_label(c: Column) -> Column:
    """$40 for whole amounts, $40.50 otherwise."""
    return F.when(c == F.floor(c), F.concat(F.lit("$"), F.floor(c).cast("long").cast("string"))).otherwise(F.concat(F.lit("$"), c.cast("decimal(18,2)").cast("string")))


def ordinal(day: Column) -> Column:
    last = F.when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd").otherwise("th")
    return F.concat(day.cast("string"), F.when((day % 100).between(10, 20), "th").otherwise(last))


def is_upper(c: Column) -> Column:
    """All letters are capitals, and there is one."""
    return (F.upper(c) == c) & (F.lower(c) != c)


def title(c: Column) -> Column:
    """Capital at the start of every run of letters, also after an apostrophe or hyphen."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 1000)))), "")


def after_comma(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"^[^,]*,", ""))


def first_name(c: Column) -> Column:
    """Given name of 'LAST, First', 'LAST First' or a plain name; Customer if there is none."""
    raw = squeeze(c)
    parts = F.split(raw, " ")
    given = F.when(raw.contains(","), after_comma(raw)).when((F.size(parts) >= 2) & is_upper(F.get(parts, F.lit(0))), F.element_at(parts, -1)).otherwise(raw)
    words = F.filter(F.split(given, " "), lambda w: ~w.isin("&", "and", ""))
    word = F.get(words, F.lit(0))
    return F.when(word.isNull(), "Customer").when(is_upper(word), title(word)).otherwise(word)


def person_name(c: Column) -> Column:
    """'First Last' from 'LAST, First'."""
    raw = squeeze(c)
    last = F.trim(F.regexp_extract(raw, r"^([^,]*),", 1))
    last = F.when(is_upper(last), title(last)).otherwise(last)
    return F.when(raw.contains(","), F.trim(F.concat_ws(" ", F.nullif(after_comma(raw), F.lit("")), F.nullif(last, F.lit(""))))).otherwise(raw)


def addresses(c: Column) -> Column:
    """Every mail address of a text in order, without case-insensitive repeats."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(EMAIL), F.lit(1))
    return F.filter(found, lambda x, i: F.array_position(F.transform(found, lambda y: F.lower(y)), F.lower(x)) == i + 1)


def contact_email(email: Column, notes: Column) -> Column:
    """The email field if it holds an address, else all addresses in the notes."""
    own = strip(email)
    found = F.regexp_extract_all(F.coalesce(notes, F.lit("")), F.lit(EMAIL), F.lit(1))
    return F.when(own.contains("@"), own).otherwise(F.array_join(found, ", "))


def delivery_channel(delivery: Column, prefer_mail: Column, email: Column, notes: Column, phone: Column) -> Column:
    """email, sms or mail: a saved choice, then paper if preferred, then what the contact data allow."""
    choice = F.lower(strip(delivery))
    return (
        F.when(choice.isin(*CHANNELS), choice)
        .when(F.coalesce(prefer_mail, F.lit(False)), "mail")
        .when(contact_email(email, notes).contains("@"), "email")
        .when(strip(phone) != "", "sms")
        .otherwise("mail")
    )


def is_month(c: Column) -> Column:
    """A calendar month such as 2026-09."""
    return F.coalesce(F.trim(c).rlike(r"^[0-9]+-(0?[1-9]|1[0-2])$"), F.lit(False))


def month_start(c: Column) -> Column:
    """First day of a calendar month, null for other labels."""
    year, number = F.split_part(F.trim(c), F.lit("-"), F.lit(1)), F.split_part(F.trim(c), F.lit("-"), F.lit(2))
    return F.when(is_month(c), F.make_date(year.try_cast("int"), number.try_cast("int"), F.lit(1)))


def month_number(c: Column) -> Column:
    return F.coalesce(F.month(month_start(c)), F.lit(0))


def letter_date(c: Column) -> Column:
    """A calendar month is billed on the first of the next one."""
    issued = F.add_months(month_start(c), 1)
    return F.concat(F.date_format(issued, "MMMM"), F.lit(" "), ordinal(F.dayofmonth(issued)), F.lit(", "), F.year(issued).cast("string"))


def month_name(c: Column) -> Column:
    """September for 2026-09; the words of any other label."""
    other = F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), "_", " ")
    return F.coalesce(F.date_format(month_start(c), "MMMM"), F.nullif(other, F.lit("")), F.lit("this period"))


def month_label(c: Column) -> Column:
    """September 2026 for 2026-09; any other text as it is."""
    return F.coalesce(F.date_format(month_start(c), "MMMM yyyy"), F.trim(c))


def work_month(today: Column) -> Column:
    """The month billed today: the one before."""
    return F.date_format(F.add_months(today, -1), "yyyy-MM")


def letter_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\r\n?", "\n"))


def letter_or_default(custom: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(letter_text(custom), F.lit("")), default)


def stored_letter(custom: Column, default: Column) -> Column:
    """Null while the text is the usual one, so that a later default can change."""
    text = letter_text(custom)
    return F.when((text != "") & (text != letter_text(default)), text)


def invoice_sentence(month: Column, custom: Column) -> Column:
    return letter_or_default(custom, F.concat(F.lit("Below is the invoice for any work done in "), month_name(month), F.lit(".")))


#: Fixed patterns of the stored line notes.
NOTE_DAY = r"(?i)^(\d{1,2})h?$"
PRIOR = r"(?i)^prior(-taxed)?:(\d{4}-\d{2})(?::(\d{1,2}))?$"
MOW = r"(?i)^mow(?:ing)?(?:\s+(\d{1,2}))?$"
HEDGE = r"(?i)^hedg(?:e|ing)(?:\s+(\d{1,2}))?$"


def _int(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast("int")


def service_label(description: Column) -> Column:
    desc = strip(description)
    return F.when(desc.rlike(MOW), "Mowing").when(desc.rlike(HEDGE), "Hedging").otherwise(desc)


def service_day(description: Column, note: Column) -> Column:
    """Day of month: the note's, else the one after a mowing or hedging name."""
    desc = strip(description)
    return F.coalesce(_int(strip(note), NOTE_DAY), _int(desc, MOW), _int(desc, HEDGE))


def line_role(description: Column, note: Column, kind: Column | None = None) -> Column:
    """visit, discount, prior or prior_taxed."""
    text, desc = strip(note), strip(description)
    role = F.when((F.lower(text) == "discount") | F.lower(desc).startswith("discount"), "discount").when(
        text.rlike(PRIOR), F.when(F.regexp_extract(text, PRIOR, 1) != "", "prior_taxed").otherwise("prior")
    )
    if kind is not None:
        role = role.when(strip(kind).isin("discount", "prior", "prior_taxed"), strip(kind))
    return role.otherwise("visit")


def prior_month(note: Column) -> Column:
    return F.regexp_extract(strip(note), PRIOR, 2)


def prior_day(note: Column) -> Column:
    return F.regexp_extract(strip(note), PRIOR, 3)


def editor_dates(raw: Column, month: Column) -> Column:
    """array<struct<month, day, hedge>> of a date cell such as '3, 9/5; 14h'.

    A date of another month takes the bill's year. Labels that are no calendar
    month give no dates with a month part.
    """
    year = F.regexp_extract(month, r"^(\d+)-", 1)

    def one(piece: Column) -> Column:
        text = F.trim(piece)
        hedge = F.lower(text).endswith("h") & ~text.rlike(r"(?i)^\d{1,2}/\d{1,2}h?$")
        bare = F.trim(F.regexp_replace(text, r"[hH]+$", ""))
        slash = bare.rlike(r"^\d{1,2}/\d{1,2}$")
        other = F.concat(year, F.lit("-"), F.lpad(F.split_part(bare, F.lit("/"), F.lit(1)), 2, "0"))
        day = F.when(slash, F.split_part(bare, F.lit("/"), F.lit(2))).when(bare.rlike(r"^\d{1,2}$"), bare).try_cast("int")
        return F.struct(F.when(slash, other).otherwise(month).alias("month"), day.alias("day"), hedge.alias("hedge"))

    return F.filter(F.transform(F.split(F.coalesce(raw, F.lit("")), "[,;]+"), one), lambda x: x["day"].isNotNull() & (year != ""))


def split_amount(total: Column, count: Column) -> Column:
    """Equal cents, the remainder on the last piece."""
    piece = F.round(total.cast("decimal(18,6)") / count, 2).cast("decimal(18,2)")
    rest = (total.cast("decimal(18,2)") - piece * (count - 1)).cast("decimal(18,2)")
    return F.when(count <= 0, F.array().cast("array<decimal(18,2)>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.when(i == count, rest).otherwise(piece))
    )


def visit_label(description: Column) -> Column:
    desc = strip(description)
    return F.when(desc.rlike(MOW) | desc.rlike("(?i)^mowing"), "Mowing").when(desc.rlike(HEDGE) | desc.rlike("(?i)^hedging"), "Hedging")


def note_for_line(description: Column, role: Column, month: Column, date: Column, existing: Column) -> Column:
    """The stored note of an edited line; the inverse of line_role, prior_month and service_day."""
    day = F.regexp_replace(strip(date), "[hH]+$", "")
    tail = F.when(day != "", F.concat(F.lit(":"), day)).otherwise("")
    return (
        F.when((role == "discount") | F.lower(strip(description)).startswith("discount"), "discount")
        .when(role == "prior_taxed", F.concat(F.lit("prior-taxed:"), month, tail))
        .when(role == "prior", F.concat(F.lit("prior:"), month, tail))
        .when((day != "") & description.rlike("(?i)hedg"), F.concat(day, F.lit("h")))
        .when(day != "", day)
        .otherwise(F.nullif(existing, F.lit("")))
    )


def name_key(c: Column) -> Column:
    """Letters and digits of a name in lower case."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def collapsed_key(c: Column) -> Column:
    """name_key with doubled letters written once."""
    return F.regexp_replace(name_key(c), r"(.)\1+", "$1")


def norm_name(c: Column) -> Column:
    """Upper case words with single spaces."""
    return F.trim(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^A-Z0-9]+", " "))


#: How entries that are places rather than people start.
PARCELS = ("R.O.W.", "WEST BENCHES", "EAST BENCHES", "CLUB HOUSE", "FIELD", "FLAG", "COTTAGE", "LOWER POND", "UPPER POND", "CAUSEWAY", "GNBA")


def entity_kind(c: Column) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    parcel = reduce(lambda a, b: a | b, (up.startswith(p) for p in PARCELS))
    return F.when(up.contains("GIANTS NECK BEACH") | up.startswith("GNBA"), "association").when(parcel, "parcel").otherwise("client")


#: Fixed patterns of contact data inside notes.
NOTE_EMAIL = r"([\w.+-]+@[\w.-]+\.\w+)"
NOTE_PHONE = r"((?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}(?!\d))"


def note_email(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), NOTE_EMAIL, 1), F.lit(""))


def note_phone(c: Column) -> Column:
    """First phone number of a note as 860-555-0123, unless an @ touches it."""
    text = strip(c)
    found = F.regexp_extract(text, NOTE_PHONE, 1)
    at = F.position(found, text)
    near = F.substring(text, F.greatest(at - 2, F.lit(1)), F.length(found) + F.least(at - 1, F.lit(2)) + 2)
    digits = F.regexp_replace(found, r"[^\d+]", "")
    ten = F.when(digits.startswith("1") & (F.length(digits) == 11), F.substring(digits, 2, 10)).otherwise(digits)
    shaped = F.concat_ws("-", F.substring(ten, 1, 3), F.substring(ten, 4, 3), F.substring(ten, 7, 4))
    return F.when((found != "") & ~near.contains("@"), F.when(F.length(ten) == 10, shaped).otherwise(F.trim(found)))


def notes_without_money(c: Column) -> Column:
    text = F.regexp_replace(F.coalesce(c, F.lit("")), r"\$\s*\d+(?:\.\d+)?|\b\d+\.\d{2}\b", "")
    text = F.regexp_replace(F.regexp_replace(text, r"\s{2,}", " "), r"\s+([,.;|/])", "$1")
    return F.regexp_replace(text, r"^[ |;-]+|[ |;-]+$", "")


def locator_line(name: Column, address: Column, phone: Column, email: Column, prefer_mail: Column, notes: Column, work_sheet: bool = True) -> Column:
    """What is on file to find a row by, without prices."""
    text = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    contact = F.coalesce(text("email: ", email), F.when(F.coalesce(prefer_mail, F.lit(False)), "billed by regular mail"))
    dates = F.lit("work dates are not on file — read them from the sheet") if work_sheet else F.lit(None).cast("string")
    rest = F.nullif(F.substring(notes_without_money(notes), 1, 90), F.lit(""))
    return F.concat_ws(" — ", strip(name), text("service address: ", address), text("phone: ", phone), contact, dates, F.concat(F.lit("notes: "), rest))


def percent(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), c.cast("int")))
