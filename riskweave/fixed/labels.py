"""Patterns, weights and thresholds of the labelling and calibration jobs."""

HEADS = ["sensitivity", "exposure", "context", "obfuscation"]

# Graded pattern labels: head -> level -> (weight, patterns). Text is lower-cased and case is ignored.
PATTERN_GROUPS = {
    "sensitivity": {
        "high": (0.8, [
            r"\b(ssn|social security)\b",
            r"\b\d{3}-\d{2}-\d{4}\b",
            r"\b(credit card|cc)\b",
            r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",
            r"\b(password|pwd|api[_\s]?key|secret[_\s]?key)\b",
            r"\b(database|db)[_\s]?(connection|uri|url)\b",
            r"postgresql://|mysql://|mongodb://",
            r"sk-[a-zA-Z0-9]{20,}",
            r"AKIA[0-9A-Z]{16}",
            r"\b(confidential|proprietary|trade[_\s]?secret)\b",
            r"\b(medical|health|phi|hipaa)\b",
            r"\b(attorney[_\s]?client|privileged)\b",
        ]),
        "medium": (0.5, [
            r"\b(employee[_\s]?id|emp[_\s]?id)\b",
            r"\b(phone|tel|mobile):\s*\d",
            r"\b\d{3}[-\.\s]\d{3}[-\.\s]\d{4}\b",
            r"\b(salary|compensation|bonus)\b",
            r"\b(nda|non[_\s]?disclosure)\b",
            r"\b(internal[_\s]?only|restricted)\b",
        ]),
        "low": (0.2, [
            r"\b(private|sensitive)\b",
            r"\b(meeting|discussion|review)\b",
        ]),
    },
    "exposure": {
        "high": (0.9, [
            r"@(gmail|yahoo|hotmail|outlook)\.com",
            r"@.*\.(ru|cn|tk|ml)",
            r"hacker|malicious|competitor|rival",
            r"personal[_\s]?email|private[_\s]?account",
        ]),
        "medium": (0.4, [
            r"@(?!.*\.(com|org|edu|gov)$)",
            r"external|vendor|partner|client",
            r"@.*\.(io|co|net)",
        ]),
        "low": (0.1, [
            r"@company\.com|@example\.com",
            r"team@|all-staff@|group@",
        ]),
    },
    "context": {
        "high": (0.7, [
            r"\b(intern|temp|contractor|unauthorized)\b",
            r"\b(violation|breach|incident)\b",
            r"\b(urgent|immediate|asap)\b",
            r"\b(selling|sale|buy|purchase)\b.*\b(data|database|information)\b",
        ]),
        "medium": (0.4, [
            r"\b(junior|new[_\s]?hire)\b",
            r"\b(mistake|error|wrong)\b",
            r"\b(personal|home|wife|spouse)\b",
        ]),
        "low": (0.1, [
            r"\b(manager|director|senior|lead)\b",
            r"\b(official|approved|authorized)\b",
        ]),
    },
    "obfuscation": {
        "high": (0.8, [
            r"\b(base64|encoded|encrypted|hidden)\b",
            r"\b(bitcoin|btc|crypto)\b",
            r"\$[0-9]+k\b.*\b(payment|cash|money)\b",
            r"\b(dark[_\s]?web|tor|onion)\b",
        ]),
        "medium": (0.4, [
            r"\b(obfuscated|masked|disguised)\b",
            r"\b(code|cipher|key)\b",
        ]),
    },
}
MATCH_STEP = 0.3
INDICATOR_WEIGHTS = {
    "PII": 0.8, "PHI": 0.9, "SSN": 0.9, "PHONE": 0.4,
    "Attorney-Client Privileged": 0.8, "Work Product": 0.7, "Client Confidential": 0.7,
    "NDA-Protected": 0.6, "Confidential": 0.6, "confidential": 0.6, "financial_data": 0.7,
    "internal_use_only": 0.4, "Legal": 0.5, "Contractual Confidentiality": 0.6, "general": 0.1,
    "non-sensitive": 0.0, "no_personal_data": 0.0, "policy_document": 0.2,
    "none": 0.0, "None": 0.0, "": 0.0,
}
CONTEXT_INDICATORS = ["PII", "PHI", "SSN", "confidential"]
INDICATOR_CONTEXT_SHARE = 0.5
LARGE_ATTACHMENT = 1_000_000
HUGE_ATTACHMENT = 10_000_000
BULK_ATTACHMENT = 50_000_000
LARGE_ATTACHMENT_RISK = 0.2
HUGE_ATTACHMENT_RISK = 0.3
ATTACHMENT_TEXT_SHARE = 0.3
ATTACHMENT_SENSITIVITY_SHARE = 0.6
ATTACHMENT_CONTEXT_SHARE = 0.4
PATTERN_NOISE = 0.05
CONTEXTUAL_NOISE = 0.02

# Contextual labels.
ROLE_TRUST = {
    "C-LEVEL": (5, 0.9), "VP": (4, 0.8), "DIRECTOR": (4, 0.8), "MANAGER": (3, 0.7), "SENIOR": (3, 0.7),
    "LEAD": (3, 0.7), "EMPLOYEE": (2, 0.6), "ANALYST": (2, 0.6), "INTERN": (1, 0.3), "TEMP": (1, 0.2),
    "CONTRACTOR": (1, 0.4),
}
DEFAULT_ROLE_TRUST = (2, 0.6)
DEPT_SENSITIVITY = {
    "FINANCE": 0.9, "LEGAL": 0.9, "HR": 0.8, "EXECUTIVE": 0.9, "IT": 0.7, "SECURITY": 0.8,
    "COMPLIANCE": 0.8, "ENGINEERING": 0.6, "SALES": 0.5, "MARKETING": 0.4, "OPERATIONS": 0.5, "SUPPORT": 0.4,
}
DEFAULT_DEPT_SENSITIVITY = 0.5
LEGITIMATE_SHARING = [
    "quarterly report", "board meeting", "audit preparation",
    "compliance review", "legal discovery", "merger due diligence",
    "performance review", "budget planning", "contract negotiation",
]
SUSPICIOUS_CONTEXTS = [
    "keep this quiet", "don't tell anyone", "between you and me",
    "off the record", "confidentially speaking", "this stays here",
    "personal favor", "side project", "freelance work",
]
PRESSURE_WORDS = [
    "urgent", "immediately", "asap", "rush", "emergency",
    "deadline passed", "overdue", "critical", "escalated",
]
FINANCIAL_MOTIVES = [
    "payment", "compensation", "bonus", "incentive", "reward",
    "commission", "fee", "consulting", "contract work",
]
SELLING_WORDS = ["selling", "for sale", "buyer", "purchase"]
ACCIDENT_WORDS = ["mistake", "accidentally", "wrong recipient"]
BUSINESS_SENSITIVE_TERMS = [
    "merger", "acquisition", "due diligence", "board decision",
    "layoffs", "restructuring", "budget cuts", "strategy",
    "competitive analysis", "market research", "client list",
]
SENSITIVE_FILE_WORDS = ["financial", "budget", "salary", "contract", "agreement"]
INTERNAL_MARKERS = ["company.com", "example.com"]
PERSONAL_MARKERS = ["gmail", "yahoo", "hotmail", "personal"]
OUTWARD_SENSITIVE_DEPTS = ["FINANCE", "LEGAL", "HR"]
FINANCE_READER_DEPTS = ["FINANCE", "LEGAL", "EXECUTIVE"]
LOW_ACCESS_ROLES = ["INTERN", "TEMP", "CONTRACTOR"]
JUNIOR_ROLES = ["INTERN", "TEMP"]

# Converter labels.
CONVERTER_HIGH_TYPES = ["PAN", "SSN", "SECRET", "DBURI", "ACCOUNT"]
CONVERTER_ATTACHMENT_INDICATORS = ["contains_ssn", "contains_pii", "financial_data", "medical_information"]
CONVERTER_LEGAL_ROLES = ["LEGAL", "COMPLIANCE"]
CONVERTER_FINANCE_ROLES = ["FINANCE", "ACCOUNTING"]
CONVERTER_FINANCE_WORDS = ["payment", "invoice", "bank", "financial"]
CONVERTER_LEGAL_SUMMARY_WORDS = ["legal", "attorney"]

# Generator, synthetic and simple labels.
GENERATOR_PERSONAL_DOMAINS = ["gmail.com", "proton.me", "outlook.com", "yahoo.com", "hotmail.com"]
SYNTH_PERSONAL_DOMAINS = ["gmail.com", "proton.me", "outlook.com", "yahoo.com"]
SIMPLE_PERSONAL_DOMAINS = ["gmail.com", "outlook.com", "yahoo.com", "hotmail.com"]

# Quality scores.
QUALITY_PLACEHOLDERS = ["lorem", "placeholder", "example", "test", "dummy"]
QUALITY_BUSINESS_TERMS = [
    "project", "meeting", "client", "team", "update", "review",
    "payment", "invoice", "contract", "agreement", "schedule",
    "employee", "benefits", "policy", "security", "access",
]
SHORT_PLACEHOLDERS = ["lorem", "placeholder", "example"]
HELPER_BUSINESS_WORDS = ["project", "meeting", "client", "team", "update", "review"]

# Decisions and risk.
RISK_WEIGHTS = {"sensitivity": 0.4, "exposure": 0.3, "context": 0.2, "obfuscation": 0.1}
CONCERN_NAMES = {
    "sensitivity": "Sensitivity", "exposure": "Exposure Risk",
    "context": "Context Issues", "obfuscation": "Obfuscation",
}
LOGIT_CLIP = 1e-7
CALIBRATED_TEMPERATURES = {"sensitivity": 0.26824779, "exposure": 5.0, "context": 5.0, "obfuscation": 5.0}
CALIBRATED_BIASES = {"sensitivity": 5.0, "exposure": -1.68696815, "context": 5.0, "obfuscation": -5.0}
BIAS_SHIFT = {"sensitivity": 11.0, "exposure": 10.5, "context": 10.0, "obfuscation": 10.5}
STRONG_BIAS_SHIFT = {"sensitivity": 13.0, "exposure": 12.5, "context": 11.5, "obfuscation": 12.0}
TEMPERATURE_BOUNDS = (0.1, 5.0)
BIAS_BOUNDS = (-5.0, 5.0)
TEMPERATURE_START = 1.5

# Content calibration: risk name -> (head, weight, substrings).
CONTENT_RISKS = {
    "high_sensitivity": ("sensitivity", 0.8, ["ssn", "social security", "password", "credit card", "api key", "database", "confidential"]),
    "high_exposure": ("exposure", 0.7, ["@gmail", "@yahoo", "@hotmail", "personal", "external", "competitor", "hacker"]),
    "context_risk": ("context", 0.6, ["intern", "temp", "unauthorized", "violation", "breach"]),
    "obfuscation": ("obfuscation", 0.5, ["base64", "encoded", "hidden", "secret", "urgent sale", "bitcoin"]),
}
CONTENT_STEP = 0.2
CONTENT_CAP = 0.99

# Diagnostics.
RISK_RECIPIENT_MARKERS = ["gmail", "yahoo", "hotmail", "personal"]
RISK_KEYWORDS = ["ssn", "social security", "password", "credit card", "confidential", "api key"]
DISAGREEMENT_LIMIT = 0.2
MODEL_PRICES = {  # per 1000 tokens: prompt, completion
    "gpt-4o": (0.005, 0.015),
    "gpt-4o-mini": (0.00015, 0.0006),
    "gpt-4-turbo": (0.01, 0.03),
    "claude-3-5-sonnet-20241022": (0.003, 0.015),
    "claude-3-haiku-20240307": (0.00025, 0.00125),
}
DEFAULT_PRICE = (0.001, 0.001)
EXPECTED_COST = {
    "gpt-4o": 0.05, "gpt-4o-mini": 0.005, "gpt-4-turbo": 0.08,
    "claude-3-5-sonnet-20241022": 0.04, "claude-3-haiku-20240307": 0.003,
}
DEFAULT_EXPECTED_COST = 0.02
