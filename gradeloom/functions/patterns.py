"""Patterns, word lists and rule tables used by the text expressions."""

# ---------------------------------------------------------------------------
# Character classes. Both spell out the Unicode sets, because the
# shorthand classes \s, \w and \d mean different sets in different regex engines.
# ---------------------------------------------------------------------------
SPACE = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# ---------------------------------------------------------------------------
# Report fields.
# ---------------------------------------------------------------------------
CASE_ID_IN_TEXT = rf"Case ID[:{SPACE}]*([A-Za-z0-9\-]+)"
CASE_ID_IN_NAME = rf"(CASE-[A-Z0-9]+-{DIGIT}+)"

MONTH_DAY_YEAR = rf"([A-Za-z]+[{SPACE}]+{DIGIT}{{1,2}},[{SPACE}]+{DIGIT}{{4}})"
EXAM_DATE_PREFIXES = ("Date of exam", "Exam Date", "Date")
OPERATION_DATE = rf"Date[:{SPACE}]*({DIGIT}{{4}}-{DIGIT}{{2}}-{DIGIT}{{2}})"

APPENDIX_MM = rf"appendix.*?({DIGIT}+\.?{DIGIT}*)[{SPACE}]*mm"
WALL_MM = rf"wall.*?thick.*?({DIGIT}+\.?{DIGIT}*)[{SPACE}]*mm"

STOP_AT_PARAGRAPH_OR_HEADING = rf"\n\n|\n[A-Z]+[{SPACE}]*[A-Z]*:|$"
STOP_AT_IMPRESSION = "IMPRESSION|$"
STOP_AT_PARAGRAPH = r"$|\n\n"
STOP_AT_LINE_END = r"\n|$"

# ---------------------------------------------------------------------------
# Finding flags (column -> any of these substrings).
# ---------------------------------------------------------------------------
ULTRASOUND_FLAGS = {
    "has_free_fluid": ("free fluid",),
    "has_fat_stranding": ("fat stranding", "hyperechoic fat"),
    "has_lymph_nodes": ("lymph nodes",),
    "has_appendicolith": ("appendicolith",),
}
OPERATIVE_FLAGS = {
    "found_perforation": ("perforated", "perforation", "ruptured"),
    "found_abscess": ("abscess",),
    "found_gangrene": ("gangrenous",),
    "found_contamination": ("contamination", "purulent", "fibrinous"),
}

# ---------------------------------------------------------------------------
# Severity rules. The first rule with a matching substring wins.
# ---------------------------------------------------------------------------
REPORT_GRADES = (
    ("Normal", ("normal", "unremarkable")),
    ("Simple/Uncomplicated", ("simple", "uncomplicated")),
    ("Gangrenous", ("complicated", "gangrenous")),
    ("Perforated", ("perforated", "ruptured", "abscess")),
)
REPORT_GRADE_DEFAULT = "Uncertain"

RESPONSE_GRADES = (
    ("Normal", ("normal", "no signs of appendicitis", "appendix is normal")),
    ("Simple/Uncomplicated",
     ("simple", "uncomplicated", "not complicated", "mild", "not severe", "no complication")),
    ("Gangrenous", ("gangrenous", "gangrene")),
    ("Perforated", ("perforated", "perforation", "rupture", "perforate")),
)
RESPONSE_GRADE_DEFAULT = "Unknown"

# ---------------------------------------------------------------------------
# Keyword terms, in output order.
# ---------------------------------------------------------------------------
KEYWORDS = (
    "appendicitis", "perforated", "gangrenous", "inflamed", "abscess",
    "appendicolith", "fluid", "thickening", "diameter", "normal",
    "simple", "complicated", "phlegmon", "contamination",
)
