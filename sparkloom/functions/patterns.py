"""Regular expressions used by profiles and guards (read the same by Java and RE2)."""

# Date shapes.
DATE_LIKE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}-[0-9]{2}-[0-9]{4}"

# Shapes that hint at the subject of a column.
SEMANTIC = {
    "icd_code": r"[A-Z][0-9]{2}\.[0-9]",
    "currency": r"[$€£]",
    "url": r"https?://",
    "mention": r"@[A-Za-z0-9_]+",
}

# Shapes of personal data.
PERSONAL = {
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\b[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}\b",
    "mrn": r"\bMRN[ :#]*[0-9]{5,}\b",
    "dob": r"\b(DOB|dob|born)[ :]*[0-9]{1,4}[-/][0-9]{1,2}[-/][0-9]{1,4}",
}

# Shapes of unsafe input.
UNSAFE = {
    "sql_injection": r"(?i)(union\s+select|drop\s+table|or\s+1\s*=\s*1|;\s*delete\s+from)",
    "prompt_injection": r"(?i)(ignore (all )?(previous|prior) instructions|disregard the above|system prompt)",
    "email": PERSONAL["email"],
    "phone": PERSONAL["phone"],
    "ssn": PERSONAL["ssn"],
}
