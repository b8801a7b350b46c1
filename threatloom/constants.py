"""Word lists, formats and patterns that results depend on."""

# Weakness classes in scope, in query order.
TARGET_CWES = (
    "CWE-119", "CWE-120", "CWE-121", "CWE-122",
    "CWE-125", "CWE-787", "CWE-416", "CWE-415",
    "CWE-476", "CWE-190", "CWE-191", "CWE-134",
    "CWE-362", "CWE-78", "CWE-20",
)

# (phrase, severity) of the keyword queries, in query order.
KEYWORD_GROUPS = (
    ("buffer overflow", "CRITICAL"),
    ("use after free", "CRITICAL"),
    ("memory corruption", "CRITICAL"),
    ("command injection", "CRITICAL"),
    ("improper input validation", "HIGH"),
)

# Report levels, most severe first, and the level of a finding that names none.
SEVERITY_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
DEFAULT_SEVERITY = "MEDIUM"

UNKNOWN = "UNKNOWN"
VULNERABLE = "vulnerable"
SAFE = "safe"

# Names stored in the `source` column, and the prefixes hashed into record ids.
TREE_SOURCE = "NIST_SARD_Juliet_v1.3"
DATASET_A_SOURCE, DATASET_A_PREFIX = "BigVul", "bigvul"
DATASET_B_SOURCE, DATASET_B_PREFIX = "PrimeVul", "primevul"

# Alternative column names of the two labelled datasets, first usable one wins.
DATASET_A_COLUMNS = {
    "code": ("func", "func_before"),
    "cwe": ("CWE ID", "cwe_id"),
    "cve": ("CVE ID", "cve_id"),
    "target": ("target",),
}
DATASET_B_COLUMNS = {
    "code": ("func", "func_before", "code"),
    "cwe": ("CWE", "cwe", "CWE ID", "cwe_id"),
    "cve": ("CVE_ID", "CVE ID", "cve_id"),
    "target": ("target",),
}

VECTOR_SIZE = 384
SNIPPET_CHARS = 512
# The short ids and code prefixes merge different records; stored records use the long ones.
SHORT_ID_DIGITS, RECORD_ID_DIGITS = 8, 15
ID_CODE_CHARS = 32
MIN_FUNCTION_CHARS = 20
CPE_KEPT = 5
CVE_IDS_SHOWN = 3
MATCHES_PER_FINDING = 5
CWE_QUERY_LIMIT = 500
KEYWORD_QUERY_LIMIT = 200

# Header line of a labelled test function (multi-line, any case), without the blank lines before it.
LABELLED_HEADER = (
    r"^[^\S\n]*(?:void|int|char\s*\*?|static\s+void)\s+"
    r"(\w*(?:bad|good)\w*)\s*\([^)]*\)\s*\{?\s*$"
)

# Prompt sent to the text model; the function text goes between head and tail.
PROMPT_HEAD = """You are a C/C++ security vulnerability analyzer.

Analyze this function for security vulnerabilities:
```c
"""
PROMPT_TAIL = """
```

Check for these vulnerability types ONLY:
- CWE-119/120/121/122/125: Buffer overflow / overread
- CWE-787: Out-of-bounds write
- CWE-416/415: Use-after-free / double free
- CWE-476: Null pointer dereference
- CWE-190/191: Integer overflow / underflow
- CWE-134: Format string vulnerability
- CWE-362: Race condition
- CWE-78: OS command injection
- CWE-20: Improper input validation

Respond with JSON ONLY — no explanation, no markdown, no extra text:
{"vulnerabilities": [{"cwe_id": "CWE-120", "severity": "HIGH", "description": "brief one-line reason"}]}
If no vulnerabilities found: {"vulnerabilities": []}"""

# Verification thresholds.
DEFINITE_CONFIDENCE = 0.75
AMBIGUOUS_KEPT_ABOVE = 0.6
