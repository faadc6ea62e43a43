"""Column functions for the rules of single source databases; each gives null where it cannot tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Age bands and the age that stands for each.
AGE_BANDS = {"(0,18]": 9, "(18,30]": 24, "(30,40]": 35, "(40,50]": 45, "(50,60]": 55, "(60,70]": 65, "(70,80]": 75, "(80,90]": 85, "(90,150]": 95}
#: What each source calls the sexes; one of them has its columns the wrong way round.
SEX_CODES = {
    "eicu": {"Male": "M", "Female": "F"},
    "omix": {"Male": "F", "Female": "M"},
    "sicdb": {"735": "M", "736": "F"},
}
#: Parts of note types, first match counts.
NOTE_TYPES = [("discharge", "discharge"), ("radiology", "radiology"), ("progress", "progress"), ("nurs", "nursing")]
#: Ranks of diagnoses by their stated priority.
PRIORITIES = {"Primary": 1, "Major": 2, "Other": 3}
NO_PRIORITY = 99
#: Parts of drug names and their classes, first match counts.
DRUG_HINTS = [
    ("norepinephrine", "vasopressor"), ("epinephrine", "vasopressor"), ("vasopressin", "vasopressor"), ("dopamine", "vasopressor"),
    ("phenylephrine", "vasopressor"), ("dobutamine", "vasopressor"), ("propofol", "sedative"), ("midazolam", "sedative"), ("fentanyl", "sedative"),
    ("morphine", "analgesic"), ("hydromorphone", "analgesic"), ("vancomycin", "antibiotic"), ("piperacillin", "antibiotic"), ("ceftriaxone", "antibiotic"),
    ("meropenem", "antibiotic"), ("imipenem", "antibiotic"), ("cefepime", "antibiotic"), ("ciprofloxacin", "antibiotic"), ("metronidazole", "antibiotic"),
    ("ampicillin", "antibiotic"), ("amikacin", "antibiotic"), ("azithromycin", "antibiotic"), ("bactrim", "antibiotic"), ("cefazolin", "antibiotic"),
    ("clindamycin", "antibiotic"), ("levofloxacin", "antibiotic"), ("levaquin", "antibiotic"), ("maxipime", "antibiotic"), ("ofloxacin", "antibiotic"),
    ("oxacillin", "antibiotic"), ("penicillin", "antibiotic"), ("rifampin", "antibiotic"), ("rocephin", "antibiotic"), ("tazobactam", "antibiotic"),
    ("tobramycin", "antibiotic"), ("zithromax", "antibiotic"), ("zosyn", "antibiotic"), ("vancocin", "antibiotic"), ("ceftazidime", "antibiotic"),
    ("nafcillin", "antibiotic"), ("ancef", "antibiotic"), ("heparin", "anticoagulant"), ("enoxaparin", "anticoagulant"), ("warfarin", "anticoagulant"),
]
#: What names antibiotics, by source.
ANTIBIOTIC_NAMES = {
    "eicu_infusion": r"bactrim|cipro|flagyl|metronidazole|zithromax|zosyn|(((amika|cleo|ofloxa)|(azithro|clinda|tobra|vanco)my)c|(ampi|oxa|peni|pipera)cill|cefazol|levaqu|rifamp)in",
    "eicu_medication": r"cipro|flagyl|maxipime|metronidazole|tazobactam|zosyn|cef(azolin|epime)|(((azithro|clinda|vanco)my|ofloxa|vanco)c|levaqu|piperacill|roceph)in",
    "nwicu": r"bactrim|cipro|flagyl|maxipime|metronidazole|tazobactam|zosyn|cef(azolin|epime|triax|tazid)|(((azithro|clinda|vanco|tobra|amika)my|ofloxa|vanco|ancef)c|levaqu|piperacill|roceph|merop|imip|nafcill|ampicill|oxacill|penicill|rifamp|vancoc)in",
}
LOOKBACK_MIN = 30 * 24 * 60


def _mapped(c: Column, values: dict, other: Column) -> Column:
    out = other
    for key, value in values.items():
        out = F.when(c == key, F.lit(value)).otherwise(out)
    return out


def two_part_key(prefix: str, subject: Column, hospital: Column) -> Column:
    """prefix_subject__hospital; null if either part is."""
    return F.concat(F.lit(f"{prefix}_"), subject.cast("string"), F.lit("__"), hospital.cast("string"))


def time_or_noon(time: Column, day: Column) -> Column:
    """The charted time, or noon of the charted day."""
    return F.coalesce(F.try_to_timestamp(time), F.try_to_timestamp(day) + F.expr("interval 12 hours"))


def age_of_band(band: Column) -> Column:
    return _mapped(band, AGE_BANDS, F.lit(None)).cast("float")


def age_at(anchor_age: Column, anchor_year: Column, admit: Column) -> Column:
    """The age in the anchor year, moved to the year of admission."""
    return (anchor_age + F.year(admit) - anchor_year).cast("float")


def sex(c: Column, dataset: str) -> Column:
    """M or F by the source's own codes; others are U where the source has such, else null."""
    return _mapped(c.cast("string"), SEX_CODES[dataset], F.lit("U" if dataset == "eicu" else None).cast("string"))


def note_type(c: Column) -> Column:
    low, out = F.lower(c), F.lit("other")
    for part, kind in reversed(NOTE_TYPES):
        out = F.when(low.contains(part), kind).otherwise(out)
    return out


def icd_priority(c: Column) -> Column:
    return _mapped(c, PRIORITIES, F.lit(NO_PRIORITY)).cast("int")


def is_morphology(code: Column) -> Column:
    """Tumour morphology codes, such as M8140/3."""
    return code.rlike(r"^[A-Za-z]\d{3,}/")


def icd_roots(listed: Column, decimals: bool = False) -> Column:
    """The codes of a ';' list, in order: three-character roots, or with their decimals; what opens with no code is left out."""
    pattern = r"^([A-Z]\d{2}(?:\.\d+)?)" if decimals else r"^([A-Z]\d{2})"
    return F.filter(F.transform(F.split(listed, ";"), lambda x: F.regexp_extract(x, pattern, 1)), lambda x: x != "")


def exam_text(category: Column, item: Column, described: Column, finding: Column) -> Column:
    """'<category> | <item>: <description> <finding>', white space collapsed; nulls are empty."""
    part = lambda c: F.coalesce(c, F.lit(""))
    text = F.concat(part(category), F.lit(" | "), part(item), F.lit(": "), part(described), F.lit(" "), part(finding))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plausible_offset(minutes: Column) -> Column:
    """Not more than 30 days before admission."""
    return minutes >= -LOOKBACK_MIN


def end_or_none(start: Column, end: Column) -> Column:
    """The end, or null where it lies before the start."""
    return F.when(end >= start, end)


def is_antibiotic(name: Column, source: str) -> Column:
    return F.coalesce(F.lower(name).rlike(ANTIBIOTIC_NAMES[source]), F.lit(False))
