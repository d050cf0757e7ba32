"""Domain knowledge and content indicators for recipient and context analysis."""

PERSONAL_DOMAINS = [
    "gmail.com", "outlook.com", "hotmail.com", "yahoo.com",
    "proton.me", "protonmail.com", "icloud.com", "me.com",
    "aol.com", "mail.com", "yandex.com", "zoho.com",
]
HIGH_RISK_DOMAINS = [
    "dropbox.com", "drive.google.com", "onedrive.com",
    "sharepoint.com", "box.com", "wetransfer.com",
    "temp-mail.org", "10minutemail.com", "guerrillamail.com",
    "mailinator.com", "tempmail.io",
]
# Applied anchored at the start, so the suffix patterns never match a real domain.
BUSINESS_DOMAIN_PATTERNS = [
    r"\.gov$", r"\.edu$", r"\.org$", r"law\..*", r"legal\..*", r"accounting\..*", r"consulting\..*",
]
FALLBACK_SENDER_DOMAIN = "company.com"
BODY_DOMAIN_PATTERN = r"@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"

# Domain types in the order they are tried; each pattern is anchored at the start.
DOMAIN_TYPE_PATTERNS = {
    "personal": [
        r"gmail\.com$", r"outlook\.com$", r"yahoo\.com$", r"hotmail\.com$",
        r"proton\.me$", r"icloud\.com$", r"aol\.com$",
    ],
    "law_firm": [
        r".*law\.com$", r".*legal\.com$", r".*law\.net$", r".*legal\.net$",
        r".*attorneys\.com$", r".*counsel\.com$", r".*\-law\.com$",
        r".*lawfirm\.com$", r".*\-legal\.com$", r".*lawyers\.com$",
        r".*\.law$", r".*\.legal$", r".*llp\.com$", r".*\-llp\.com$",
    ],
    "financial": [
        r".*bank\.com$", r".*banking\.com$", r".*financial\.com$",
        r".*payment\.com$", r".*payments\.com$", r".*finance\.com$",
        r".*credit\.com$", r".*lending\.com$", r".*treasury\.com$",
        r"chase\.com$", r"wellsfargo\.com$", r"bankofamerica\.com$",
        r"jpmorgan\.com$", r"citi\.com$", r"stripe\.com$", r"paypal\.com$",
    ],
    "contractor": [
        r".*consulting\.com$", r".*contractor\.com$", r".*tech\.com$",
        r".*solutions\.com$", r".*services\.com$", r".*consulting\.net$",
    ],
    "vendor": [
        r".*vendor\.com$", r".*supplier\.com$", r".*corp\.com$",
        r".*company\.com$", r".*inc\.com$", r".*ltd\.com$",
    ],
    "government": [r".*\.gov$", r".*\.mil$", r".*regulatory\.com$", r".*compliance\.com$", r".*audit\.com$"],
    "suspicious": [r"^[a-z]{1,4}\.com$", r"^[0-9]+\.com$", r".*temp.*\.com$", r".*test.*\.com$"],
}

# Authorised sharing: span types, recipient domain type, sender roles, content keywords.
RELATIONSHIPS = [
    {
        "name": "legal_external",
        "data_types": ["NDA", "MATTER", "NAME", "EMAIL", "NDA_EUPHEMISM"],
        "domain_types": ["law_firm"],
        "roles": ["LEGAL", "COMPLIANCE", "PRIVACY"],
        "keywords": ["nda", "agreement", "matter", "counsel", "legal", "contract"],
    },
    {
        "name": "financial_external",
        "data_types": ["PAN", "EMAIL", "NAME", "PAN_SEMANTIC", "PAN_EUPHEMISM"],
        "domain_types": ["financial"],
        "roles": ["FINANCE", "ACCOUNTING", "TREASURY", "PAYMENTS"],
        "keywords": ["payment", "invoice", "bank", "wire", "processing", "vendor"],
    },
    {
        "name": "hr_external",
        "data_types": ["SSN", "NAME", "EMAIL", "PHONE", "SSN_SEMANTIC"],
        "domain_types": ["vendor"],
        "roles": ["HR", "PEOPLE", "BENEFITS"],
        "keywords": ["benefits", "enrollment", "provider", "insurance"],
    },
    {
        "name": "contractor_technical",
        "data_types": ["EMAIL", "NAME", "DBURI"],
        "domain_types": ["contractor"],
        "roles": ["ENGINEERING", "DEVOPS", "TECH"],
        "keywords": ["project", "development", "contractor", "consulting"],
    },
]

# Content indicators: all ignore case.
LEGITIMATE_PATTERNS = {
    "legal": [
        r"\b(?:nda|confidentiality|non-disclosure|agreement|contract)\b",
        r"\b(?:counsel|attorney|legal|law firm|matter)\b",
        r"\b(?:privileged|confidential|attorney-client)\b",
        r"\b(?:engagement|retainer|legal services)\b",
    ],
    "finance": [
        r"\b(?:audit|financial|accounting|tax|compliance)\b",
        r"\b(?:invoice|billing|payment|accounting)\b",
        r"\b(?:quarterly|annual|financial report)\b",
        r"\b(?:sec filing|10-k|10-q|proxy)\b",
    ],
    "hr": [
        r"\b(?:employment|hr|human resources|personnel)\b",
        r"\b(?:benefits|compensation|performance|review)\b",
        r"\b(?:onboarding|training|employee handbook)\b",
        r"\b(?:policy|procedure|compliance training)\b",
    ],
    "business_ops": [
        r"\b(?:vendor|supplier|partnership|collaboration)\b",
        r"\b(?:project|timeline|deliverables|milestone)\b",
        r"\b(?:meeting|conference|presentation|proposal)\b",
        r"\b(?:strategy|planning|roadmap|objectives)\b",
    ],
}
SUSPICIOUS_PATTERNS = [
    r"\b(?:urgent|asap|immediate|emergency)\b.*(?:send|share|provide)",
    r"\b(?:personal|private|secret|confidential)\b.*(?:information|data)",
    r"\b(?:password|login|access|credentials)\b",
    r"\b(?:delete|destroy|remove|erase)\b.*(?:after|once)",
    r"\b(?:don't tell|keep quiet|between us|confidential)\b",
    r"\b(?:wire transfer|bitcoin|crypto|untraceable)\b",
]
# Role evidence: role -> list of (pattern or None, span types or None).
ROLE_EVIDENCE = {
    "LEGAL": [(None, ["NDA", "MATTER", "CASE"]), (r"\b(?:privilege|confidential|attorney-client)\b", None)],
    "HR": [
        (r"\b(?:employee|benefits|performance|training)\b", None),
        (r"\b(?:confidential|personnel|employment)\b", None),
    ],
    "FINANCE": [(r"\b(?:audit|financial|accounting|compliance)\b", None), (None, ["PAN"])],
    "SECURITY": [(r"\b(?:incident|security|breach|vulnerability)\b", None)],
}
ROLE_CATEGORY = {"LEGAL": "legal", "HR": "hr", "FINANCE": "finance"}

HIGH_SENSITIVITY_TYPES = ["PAN", "SSN", "SECRET", "DBURI"]
MEDIUM_SENSITIVITY_TYPES = ["EMAIL", "PHONE", "NAME"]

# Primary business domain: keyword lists in tie order.
PRIMARY_DOMAIN_KEYWORDS = {
    "payroll": [
        "payroll", "salary", "wages", "employee", "benefits", "hr", "human resources",
        "compensation", "paystub", "w2", "w-2", "tax", "deduction",
    ],
    "legal": [
        "nda", "non-disclosure", "legal", "attorney", "counsel", "contract", "agreement",
        "confidential", "privileged", "litigation", "matter", "case", "settlement",
    ],
    "financial": [
        "financial", "revenue", "profit", "budget", "accounting", "invoice", "payment",
        "banking", "account", "transaction", "credit", "debit", "balance", "audit",
    ],
    "security": [
        "security", "password", "credential", "api", "token", "access", "authentication",
        "incident", "breach", "vulnerability", "keys", "cert", "certificate",
    ],
    "customer": [
        "customer", "client", "support", "ticket", "case", "complaint", "feedback",
        "personal", "contact", "phone", "address", "account",
    ],
}
CONVERTER_PERSONAL_DOMAINS = ["gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "proton.me", "aol.com", "icloud.com"]
COMPETITOR_WORDS = ["competitor", "rival", "vendor", "partner"]

# Current risk of a message before a flip request.
RISK_PERSONAL_DOMAINS = ["gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "proton.me", "aol.com"]
RISK_BUSINESS_WORDS = ["authorized", "agreement", "retainer", "contract", "vendor", "partner"]
RISK_CASUAL_WORDS = ["hey", "fyi", "just sharing", "thought you'd want", "quick note"]

# Sender role from content, first hit wins; agent names map directly.
AGENT_ROLE = {
    "legal": "LEGAL", "finance": "FINANCE", "hr": "HR",
    "security": "SECURITY", "clean_business": "BUSINESS", "casual": "EMPLOYEE",
}
ROLE_WORDS = {
    "LEGAL": ["legal", "attorney", "counsel", "law", "nda"],
    "HR": ["hr", "human resources", "employee", "personnel"],
    "FINANCE": ["finance", "accounting", "audit", "payment"],
    "SECURITY": ["security", "incident", "breach", "vulnerability"],
}
DEFAULT_ROLE = "BUSINESS"
