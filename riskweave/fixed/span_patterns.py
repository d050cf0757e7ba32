"""The span patterns of every rule set, their checks and their order.

Each entry is (type, pattern, ignore case). Order matters: it breaks ties between spans with equal start.
"""

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"

# Rule set "full": alternatives of one type are one pattern.
FULL_PHONE = (
    r"\b(?:\+?1[-.\s]?)?(?:\(?[2-9]\d{2}\)?[-.\s]?)?[2-9]\d{2}[-.\s]?\d{4}\b"
    r"|\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b"
    r"|\(\d{3}\)\s?\d{3}[-.\s]?\d{4}"
    r"|\+\d{1,3}[-.\s]?\d{6,14}\b"
)
FULL_PAN = (
    r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
    r"|\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
    r"|\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b"
    r"|\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
)
FULL_SSN = r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b|\b\d{9}\b"
FULL_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]*\.?)?\s+[A-Z][a-z]+\b"
FULL_ADDR_CLASS = r"[A-Za-z0-9\s,.-]"
FULL_ADDR_END = r"(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Place|Pl)\b"
FULL_ADDR = (
    rf"\b\d+\s+{FULL_ADDR_CLASS}+{FULL_ADDR_END}"
    r"|\b[A-Z][a-z]+,?\s+[A-Z]{2}\s+\d{5}(?:-\d{4})?\b"
)
FULL_DBURI = (
    r"(?:postgres|mysql|mongodb|redis)://[^\s]+"
    r"|jdbc:[^\s]+"
    r"|Server=[^;]+;Database=[^;]+"
    r"|mongodb\+srv://[^\s]+"
)
FULL_SECRET = (
    r"\b[A-Za-z0-9+/]{40,}={0,2}\b"
    r"|sk-[A-Za-z0-9]{40,}"
    r"|ghp_[A-Za-z0-9]{36}"
    r"|AIza[0-9A-Za-z_-]{35}"
    r"|AKIA[0-9A-Z]{16}"
    r"|xoxb-[0-9]+-[0-9]+-[0-9A-Za-z]+"
    r"|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
)
FULL_LEGAL = r"NDA\s*#?\d*|Matter\s*#?\d+|Case\s*#?\d+|Contract\s*#?\d+"

FULL_NAME_STOP_LIST = [
    "Dear Sir", "Thank You", "Best Regards", "Kind Regards",
    "John Doe", "Jane Doe", "Test User", "Admin User",
    "First Last", "Your Name", "User Name",
]
FULL_NAME_CONFIDENCE = 0.8
FULL_ADDR_CONFIDENCE = 0.9
FULL_SECRET_CONFIDENCE = 0.9

# Rule set "converter": every pattern ignores case.
CONVERTER = [
    ("EMAIL", EMAIL),
    ("PHONE", r"(?:\+\d{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}"),
    ("PAN", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("SSN", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("SECRET", r"\b(?:AKIA[A-Z0-9]{16}|sk-[A-Za-z0-9]{48}|xoxp-[a-z0-9\-]{72}|ghp_[A-Za-z0-9]{36})\b"),
    ("DBURI", r"\b(?:postgresql|mysql|mongodb|redis|sqlite)://[^\s]+\b"),
    ("NDA", r"\b(?:NDA|Non-Disclosure|Confidentiality Agreement)\b"),
    ("MATTER", r"\b(?:Matter [A-Z]?#?\d+[-\d]*|Case #\d+)\b"),
    ("NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
    ("ACCOUNT", r"\b(?:Account|Acct) #?(\d{4,})\b"),
]
CONVERTER_NAME_STOP_PHRASES = [
    "New York", "Los Angeles", "United States", "Data Loss",
    "Legal Matter", "Account Number", "Credit Card", "Social Security",
]

# Rule set "semantic": traditional patterns, then semantic ones, then euphemisms.
DIGIT_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine"
SPANISH_DIGIT_WORDS = "cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
TRADITIONAL = [
    ("EMAIL", EMAIL),
    ("PHONE", r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("PAN", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\b"),
    ("SSN", r"\b\d{3}-?\d{2}-?\d{4}\b"),
    ("SECRET", r"\bAKIA[A-Z0-9]{16}\b"),
    ("SECRET", r"\bsk-[A-Za-z0-9]{48}\b"),
    ("SECRET", r"\bghp_[A-Za-z0-9]{36}\b"),
    ("DBURI", r"\b(?:postgresql|mysql|mongodb)://[^\s]+\b"),
    ("NDA", r"\b(?:NDA|Non-Disclosure|Matter [A-Z]-\d+)\b"),
    ("NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b"),
]
SEMANTIC = [
    ("PAN_SEMANTIC", rf"\b(?:{DIGIT_WORDS})(?:\s+(?:{DIGIT_WORDS})){{7,15}}\b"),
    ("SSN_SEMANTIC", rf"\b(?:{DIGIT_WORDS})(?:\s+(?:{DIGIT_WORDS})){{8}}\b"),
    ("EMAIL_SEMANTIC", r"\b\w+\s+dot\s+\w+\s+at\s+\w+\s+dot\s+\w+\b"),
    ("PHONE_SEMANTIC", rf"\b(?:{DIGIT_WORDS})(?:\s+(?:{DIGIT_WORDS})){{9}}\b"),
    ("PAN_SPATIAL", r"\b\d\s+\d\s+\d\s+\d\s+\s+\d\s+\d\s+\d\s+\d\s+\s+\d\s+\d\s+\d\s+\d\s+\s+\d\s+\d\s+\d\s+\d\b"),
    ("SECRET_PHONETIC", r"\bsierra[-\s]?kilo[-\s]?\w+"),
    ("MULTILINGUAL_SEMANTIC", rf"\b(?:{SPANISH_DIGIT_WORDS})(?:\s+(?:{SPANISH_DIGIT_WORDS})){{3,15}}\b"),
]
EUPHEMISM = [
    ("PAN_EUPHEMISM", r"\b(?:sixteen[-\s]?digit|payment\s+(?:identifier|method|instrument))\b"),
    ("SECRET_EUPHEMISM", r"\b(?:authentication\s+credential|access\s+token|service\s+key)\b"),
    ("SSN_EUPHEMISM", r"\b(?:social\s+identifier|tax\s+identification|personal\s+reference)\b"),
    ("NDA_EUPHEMISM", r"\b(?:confidentiality\s+agreement|non[-\s]?disclosure)\b"),
]

# Rule set "synth": (type, pattern, ignore case).
SYNTH = [
    ("EMAIL", EMAIL, False),
    ("PHONE", r"(\+\d{1,3}\s?)?(\(\d{3}\)\s?)?[\d\s\-\.]{10,}", False),
    ("PAN", r"\b(?:\d{4}\s){3}\d{4}\b|\b\d{2}\s\d{6}\s\d{7}\b", False),
    ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", False),
    ("SECRET", r"\bAKIA[A-Z0-9]{16}\b", False),
    ("SECRET", r"\bSK_[A-Za-z0-9_]{16,}\b", False),
    ("SECRET", r"\bxoxp-[a-z0-9\-]{24,}\b", False),
    ("SECRET", r"\bghp_[A-Za-z0-9_]{36}\b", False),
    ("SECRET", r"-----BEGIN [A-Z\s]+-----", False),
    ("DBURI", r"\b(?:postgresql|mysql|mongodb|redis|postgres|sqlite|mssql|oracle)://[^\s]+\b", False),
    ("NDA", r"\b(?:NDA|Non-Disclosure|Confidentiality Agreement|Mutual NDA|Engagement|Agreement\s*#\d+)\b", True),
    ("MATTER", r"\b(?:M|MAT|CASE|PROJ)-\d{3,5}\b", False),
]

# Rule set "generator": (type, pattern, ignore case); the legal pattern splits into NDA and MATTER.
GENERATOR = [
    ("EMAIL", EMAIL, False),
    ("PHONE", r"(?:\+\d{1,3}[-.\s]?)?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", False),
    ("PAN", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|3[0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", False),
    ("SSN", r"\b\d{3}-?\d{2}-?\d{4}\b", False),
    ("SECRET", r"\bAKIA[A-Z0-9]{16}\b", False),
    ("SECRET", r"\bsk-[A-Za-z0-9]{48}\b", False),
    ("SECRET", r"\bxoxp-[a-z0-9\-]{72}\b", False),
    ("SECRET", r"\bghp_[A-Za-z0-9]{36}\b", False),
    ("SECRET", r"\b[A-Za-z0-9]{32,}\b(?=.*[A-Z])(?=.*[a-z])(?=.*[0-9])", False),
    ("DBURI", r"\b(?:postgresql|mysql|mongodb|redis|sqlite)://[^\s]+\b", False),
    ("NDA", r"\b(?:NDA|Non-Disclosure|Confidentiality Agreement|Matter [A-Z]-\d+|Agreement #\d+)\b", True),
    ("NAME", r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", False),
]
GENERATOR_NAME_STOP_PHRASES = ["new york", "los angeles", "united states", "data loss"]

# Tie order of the "longest" overlap rule.
TYPE_PRIORITY = {"PAN": 5, "SSN": 4, "EMAIL": 3, "PHONE": 2, "NAME": 1}

# Obfuscation flags of one text.
OBFUSCATION_FLAG_PATTERNS = {
    "number_words": r"\b(?:zero|one|two|three|four|five|six|seven|eight|nine|ten)\b",
    "decomposition": r"\b(?:dot|at|dash|space|underscore)\b",
    "euphemisms": r"\b(?:identifier|credential|authentication|payment\s+method|access\s+key)\b",
    "references": r"\b(?:discussed|mentioned|secure\s+folder|attached|as\s+agreed)\b",
    "multilingual": r"\b(?:uno|dos|tres|cuatro|cinco|sechs|sieben|acht)\b",
}
ZERO_WIDTH_CHARACTERS = "​‌‍﻿"
NFD_GROWTH_LIMIT = 1.1

# Obfuscation technique names and the substrings that show them.
TECHNIQUE_NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "zero"]
TECHNIQUE_DECOMPOSITION = [" dot ", " at ", " dash "]
TECHNIQUE_EUPHEMISM = ["identifier", "token", "credential", "authentication", "method"]
TECHNIQUE_REFERENCE = ["discussed", "mentioned", "attached", "secure", "base64"]
TECHNIQUE_SPANISH = ["uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"]

# Obfuscation patterns of the converter labels.
CONVERTER_OBFUSCATION = [
    r"base64", r"encoded", r"\*{3,}", r"[A-Za-z0-9+/]{20,}={0,2}",
    r"&#\d+;", r"%[0-9A-Fa-f]{2}",
]

# Masking rewrites: the last four digits stay.
MASK_SSN = (r"(\d{3})-(\d{2})-(\d{4})", "***-**-", 3)
MASK_CARD = (r"(\d{4})\s*(\d{4})\s*(\d{4})\s*(\d{4})", "****-****-****-", 4)

# Three tag vocabularies; they disagree and are used by name.
BIO_TYPES = {
    "training": ["EMAIL", "PHONE", "PAN", "SSN", "SECRET", "DBURI", "NDA", "MATTER", "NAME", "ADDR"],
    "extractor": ["EMAIL", "PHONE", "PAN", "SSN", "NAME", "ADDR", "SECRET", "DBURI", "NDA", "MATTER"],
    "converter": ["EMAIL", "PHONE", "PAN", "SSN", "NAME", "SECRET", "DBURI", "NDA", "MATTER", "ACCOUNT"],
}
IGNORE_ID = -100
