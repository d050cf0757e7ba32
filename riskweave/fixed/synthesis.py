"""Word pools and weights of the synthetic corpus. Sentences are our own."""

ROLES = ["LEGAL", "FINANCE", "HR", "ENG", "MARKETING", "INTERN"]
DEPARTMENTS = ["CORP", "LEGAL", "TECH", "SALES", "HR"]
SENIORITIES = ["JUNIOR", "SENIOR", "PRINCIPAL", "DIRECTOR", "VP"]
CHANNELS = ["email", "chat", "pr", "upload"]
SPAN_TYPES = ["EMAIL", "PHONE", "PAN", "SSN", "SECRET", "DBURI", "NDA", "MATTER", "NAME", "ADDR"]
OBFUSCATION_PROBABILITY = 0.15
ATTACHMENT_PROBABILITY = 0.3
LINK_PROBABILITY = 0.2
SPLIT_SIZES = {"train": 60000, "val": 5000, "test": 5000}

FIRST_NAMES = ["Ada", "Bruno", "Carla", "Dmitri", "Elif", "Farid", "Greta", "Hugo", "Ines", "Jonas", "Kaya", "Luca"]
LAST_NAMES = ["Abel", "Bauer", "Costa", "Duarte", "Evans", "Fischer", "Gomes", "Hansen", "Ito", "Jansen", "Keller", "Lopes"]
EMAIL_DOMAINS = ["company.com", "corp.com", "enterprise.com", "gmail.com", "proton.me", "outlook.com", "yahoo.com", "harbor-legal.com"]
PHONE_PREFIXES = ["+1", "+44", "+351", "+49", "+33"]
LEGAL_TERMS = ["NDA", "Confidentiality Agreement", "Mutual NDA", "Engagement Letter"]
MATTER_PREFIXES = ["M", "MAT", "CASE", "PROJ"]
SECRET_PREFIXES = ["AKIA", "SK_", "ghp_"]
DB_SCHEMES = ["postgresql://", "mysql://", "mongodb://", "redis://"]
DB_USERS = ["admin", "user", "app", "service"]
DB_HOSTS = ["localhost", "db.example.org", "staging.example.org"]
DB_PORTS = ["5432", "3306", "27017", "6379"]
DB_NAMES = ["production", "staging", "users", "logs"]
STREETS = ["Harbor St", "Mill Rd", "Park Ave", "Elm St"]
CITIES = ["Chicago", "Boston", "Houston", "Phoenix"]

# Recipient domains by sender role.
LEGAL_RECIPIENTS = ["harbor-legal.com", "keller-law.com", "company.com"]
TRUSTED_RECIPIENTS = ["company.com", "corp.com", "enterprise.com", "partner-firm.com"]
MIXED_RECIPIENTS = ["company.com", "gmail.com", "outlook.com", "proton.me", "partner.com"]

SUBJECTS = {
    "LEGAL": ["{matter}: papers for review", "{nda} ready to sign"],
    "FINANCE": ["Payment run {number}", "Invoice {number} is due"],
    "OTHER": ["List for the campaign", "Numbers for this week"],
}
BODIES = {
    "LEGAL": [
        "Under the {nda} and {matter} we enclose what was asked for: {data}. Please keep it confidential.",
        "The review of {matter} needs {data}; the {nda} covers it.",
    ],
    "FINANCE": ["Please pay with these details: {data}. It should leave today.", "The customer gave {data} for the payment."],
    "OTHER": ["Hi team, here is what we have for the campaign: {data}.", "Short update, the list now holds {data}. Looks good."],
}
ATTACHMENTS = [("customers.csv", 82000), ("report.pdf", 156000), ("users.xlsx", 234000), ("config.json", 12000), ("backup.sql", 1500000)]
LINKS = ["https://share.example.com/q3", "https://files.example.net/s/abc123", "https://go.example.org/x"]
ZERO_WIDTH = ["​", "‌", "‍", "﻿"]

# Addresses and file names by category.
ADDRESS_DOMAINS = {
    "legal": ["harbor-legal.com", "keller-law.com", "counselgroup.net"],
    "financial": ["northbank.com", "paygate.net", "treasuryhub.org"],
    "hr_vendors": ["benefithub.net", "payrollworks.org"],
    "vendors": ["acmevendor.com", "supplyline.net"],
    "consulting": ["adviceworks.com", "strategyline.net"],
    "tech_vendors": ["cloudworks.net", "softhouse.org"],
}
PERSONAL_DOMAINS = ["gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "proton.me", "aol.com", "icloud.com"]
FILE_NAMES = {
    "legal": ["nda_draft_{n}", "contract_review_{n}", "settlement_{n}"],
    "finance": ["payment_batch_{n}", "invoice_details_{n}", "budget_analysis_{n}"],
    "hr": ["employee_record_{n}", "benefits_enrollment_{n}", "salary_analysis_{n}"],
}
FILE_EXTENSIONS = {"legal": ["pdf", "docx", "doc"], "finance": ["xlsx", "csv", "pdf"], "hr": ["pdf", "docx", "xlsx"]}

# The small generator.
SMALL_DOMAINS = ["legal", "finance", "hr", "security", "casual"]
SMALL_BODIES = {
    "legal": "This contract holds details about our clients.",
    "finance": "Revenue for the fourth quarter grew in payments.",
    "hr": "The employee review is planned for next week.",
    "security": "Report on the security incident of last night.",
    "casual": "Hey team, see you at the meeting tomorrow!",
}
SMALL_SPLITS = {"train": 1000, "val": 200, "test": 200}
