"""Categories, trigger patterns, masks, policy tables and seed rows.

Everything in this module is plain data that results depend on. Patterns are written in
Python ``re`` syntax; ``functions.text.java_pattern`` rewrites them for Spark's regex engine.
"""

from __future__ import annotations

# --- Fixed values: risk categories, in report order -------------------------------------
CATEGORIES = [
    "Violent crimes",
    "Non-violent crimes",
    "Sex-related crimes",
    "Child sexual exploitation",
    "Specialized advice",
    "Privacy",
    "Intellectual property",
    "Indiscriminate weapons",
    "Hate",
    "Suicide and self-harm",
    "Sexual content",
    "Jailbreak prompts",
]

# --- Fixed values: trigger patterns per category, matched against lowercased text -------
TRIGGERS = {
    "Violent crimes": [
        r"\bkill\b", r"\bmurder\b", r"\bassassinate\b", r"\bbomb\b",
        r"\bshoot\b", r"\bkidnap\b", r"\bhostage\b", r"\bterrorist\b",
    ],
    "Non-violent crimes": [
        r"\bsteal\b", r"\brob\b", r"\bhack\b", r"\bshoplift\b",
        r"\bpirate\b", r"\bcounterfeit\b", r"\bbribe\b", r"\bembezzle\b",
    ],
    "Sex-related crimes": [
        r"\brape\b", r"\bsexual assault\b", r"\bharass\b", r"\bstalk\b",
    ],
    "Child sexual exploitation": [
        r"\bchild exploitation\b", r"\bpedophile\b", r"\bcp\b", r"\bunderage sexual\b",
    ],
    "Specialized advice": [
        r"\bfinancial advice\b", r"\binvest in\b", r"\bbuy stock\b",
        r"\bdiagnose disease\b", r"\bprescribe medicine\b", r"\blegal counsel\b",
    ],
    "Privacy": [
        r"\bssh key\b", r"\bprivate key\b", r"\bpassword\b",
        r"\bleak info\b", r"\bcredit card\b", r"\bsocial security number\b",
    ],
    "Intellectual property": [
        r"\bcrack software\b", r"\bbypass drm\b", r"\bcopyrighted text\b", r"\bpirated book\b",
    ],
    "Indiscriminate weapons": [
        r"\bchemical weapon\b", r"\bbio-weapon\b", r"\bdirty bomb\b", r"\bthermonuclear\b",
        r"\bgun manufacturing\b", r"\bsarin\b", r"\bsynthesize\b", r"\bgas\b",
    ],
    "Hate": [
        r"\bracial slur\b", r"\bhate group\b", r"\bsupremacist\b", r"\bdiscrimination\b",
    ],
    "Suicide and self-harm": [
        r"\bsuicide\b", r"\bkill myself\b", r"\bend my life\b", r"\bself-harm\b", r"\bcutting\b",
    ],
    "Sexual content": [
        r"\bporn\b", r"\berotica\b", r"\bx-rated\b", r"\bnude pics\b",
    ],
    "Jailbreak prompts": [
        r"ignore (all )?previous instructions", r"system prompt", r"bypass safety rules",
        r"you are now a developer mode", r"act as an unrestricted", r"dan mode",
    ],
}

# --- Fixed values: score by number of matched patterns (last entry: that many or more) --
SCORE_LADDER = [0.01, 0.65, 0.85, 0.99]
DEFAULT_THRESHOLD = 0.5

# --- Fixed values: terms that override model scores, and the scores they set ------------
OVERRIDE_TERMS = [
    "sarin", "vx gas", "vx nerve", "soman", "tabun", "mustard gas", "phosgene",
    "synthesize sarin", "chemical weapon", "biological weapon", "bioweapon", "bio weapon",
    "nuclear payload", "nuclear warhead", "dirty bomb", "nerve agent", "synthesize weapon",
    "weapon variant", "biological nuclear", "weaponize", "lethal agent", "mass casualty",
]
OVERRIDE_SCORES = {"Indiscriminate weapons": 0.99, "Jailbreak prompts": 0.01}

# --- Fixed values: engine labels --------------------------------------------------------
ENGINE_EMPTY = "empty_input"
ENGINE_KEYWORDS = "fallback"
ENGINE_MODEL = "model"

# --- Fixed values: personal data patterns and masks -------------------------------------
EMAIL_PATTERN = (
    r"\b([a-zA-Z0-9_.+-])[a-zA-Z0-9_.+-]*([a-zA-Z0-9_.+-])@([a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+)\b"
)
CARD_PATTERN = r"\b(?:\d[ -]*?){13,16}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
PHONE_PATTERN = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
CARD_MASK = "****-****-****-"
SSN_MASK = "***-**-****"
PHONE_MASK = "(***) ***-"
SECRET_MASK = "********"

# --- Fixed values: a field whose lowercased name contains one of these is masked whole --
SENSITIVE_KEYS = ["password", "hash", "secret", "token", "apikey", "ssh_key", "private_key"]

# --- Fixed values: request policy -------------------------------------------------------
PROHIBITED_OPERATORS = ["$where", "$accumulator", "$function"]
WRITE_PROTECTED = ["rules", "security_logs"]
DROP_PROTECTED = ["users", "transactions", "security_logs", "rules"]
POLICY_CATEGORIES = ["Non-violent crimes", "Jailbreak prompts"]
READ_LIMIT = 50
LATENCY_RING = 100
MODEL_TOKENS = 512

# --- Fixed values: violation events and their detail texts ------------------------------
OPERATOR_EVENT = "NOSQL_INJECTION_ATTACK"
OPERATOR_DETAILS = "Prohibited NoSQL/Javascript operator '%s' detected in search query."
QUERY_EVENT = "INBOUND_QUERY_ATTACK"
QUERY_DETAILS = "Malicious query structure detected in collection '%s' search"
WRITE_EVENT = "UNAUTHORIZED_WRITE_BLOCKED"
WRITE_DETAILS = (
    "Unauthorized attempt to insert document directly into protected system collection '%s'"
)
WRITE_TEXT = "INSERT DOCUMENT: %s"
INSERT_EVENT = "INBOUND_INSERT_ATTACK"
INSERT_DETAILS = "Unsafe payload insertion blocked in collection '%s'"
DROP_EVENT = "DESTRUCTIVE_DROP_BLOCKED"
DROP_DETAILS = "Unauthorized attempt to drop core system collection '%s'"
DROP_TEXT = "DROP COLLECTION: %s"
DELETE_EVENT = "DESTRUCTIVE_ACTION_ATTACK"
DELETE_DETAILS = "Destructive action blocked on collection '%s' due to safety audit failure"
DELETE_TEXT = "ACTION: DELETE/DROP | COLLECTION: %s | QUERY: %s | DROP: %s"

# --- Fixed values: static rules (category, threat level, description, playbook) ---------
STATIC_RULES = [
    ("Violent crimes", "CRITICAL",
     "Details, guides, or incitement of physical violence, terrorism, or bodily harm.",
     "Immediate Block & System Alert. Halt downstream agent execution."),
    ("Non-violent crimes", "HIGH",
     "Information on illegal acts not involving physical harm, such as hacking, theft, or piracy.",
     "Block command. Log user ID for audit compliance."),
    ("Sex-related crimes", "CRITICAL",
     "Content depicting sexual coercion, non-consensual acts, or sexual harassment.",
     "Immediate Block & System Alert."),
    ("Child sexual exploitation", "CRITICAL",
     "Any content relating to the exploitation, harm, or abuse of minors.",
     "Immediate Hard Block. Terminate user session and log details."),
    ("Specialized advice", "MEDIUM",
     "Steering users with legal advice, medical diagnoses, or definitive stock market/financial"
     " planning.",
     "Flag result. Inject compliance disclaimer into agent response."),
    ("Privacy", "HIGH",
     "Exposure of sensitive PII (Social Security Numbers, credit cards, passwords, phone numbers).",
     "Activate Outbound Redactor. Scrub PII from JSON outputs."),
    ("Intellectual property", "MEDIUM",
     "Requests to bypass copyright protections, software DRM, or reproduce copyrighted content.",
     "Filter output. Block specific copy-generation queries."),
    ("Indiscriminate weapons", "CRITICAL",
     "Creation or acquisition guidelines for chemical, biological, or nuclear weapons.",
     "Immediate Hard Block. Halt agent execution."),
    ("Hate", "HIGH",
     "Hate speech, slurs, or harassment targeting race, religion, gender, or orientation.",
     "Block insert/query. Log content to security logs."),
    ("Suicide and self-harm", "CRITICAL",
     "Content encouraging self-destruction, cutting, or suicide.",
     "Immediate Block. Inject safety resource text and hotlines."),
    ("Sexual content", "LOW",
     "Erotica, pornographic text, or adult content.",
     "Block content representation in standard public databases."),
    ("Jailbreak prompts", "CRITICAL",
     "Adversarial prompts designed to ignore rules, act as unrestricted agents, or leak system"
     " prompts.",
     "Immediate Block. Flush agent context window to clear malicious instructions."),
]

# --- Fixed values: whitespace as Python's str.strip and re's \s see it ------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0         "
    "       　"
)
