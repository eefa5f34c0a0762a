"""Word lists and patterns of the governance rules.

All values in this module are fixed: results depend on each of them.  The patterns use the syntax that Java and RE2 share.
"""

TAG = r"\[\[([A-Z][A-Z0-9]{1,15}-[0-9]{3,})\]\]"
WORD = r"[A-Za-z0-9][A-Za-z0-9'’\-\.]*"
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "approx", "inc", "ltd", "no", "fig", "v", "mr", "ms", "dr")
STOPWORDS = tuple(
    """a an the and or but if then of to in on for with by at from as is are was were be been being it its this that
these those can will may might must should would could do does did has have had not no your you we our us their they them he she
his her i me my so than too very just also into over under about up down out more most such only own same other any each all both
via per""".split()
)

STATUS_WORDS = (
    ("beta", "beta"), ("preview", "beta"), ("early access", "beta"), ("experimental", "beta"),
    ("generally available", "ga"), ("general availability", "ga"),
    ("deprecated", "deprecated"), ("end of life", "deprecated"), ("retired", "deprecated"),
)
STATUS_TOKENS = ("beta", "preview", "generally", "available", "ga", "general", "availability", "deprecated", "early", "access", "experimental", "now", "released", "release")
GENERIC = ("product", "feature", "features", "support", "supports", "supported", "customers", "customer", "data", "use", "using", "available", "page", "explains", "describes")
GENERIC_STEMS = ("product", "featur", "help", "team", "customer", "make", "us", "way", "get", "new", "one", "use", "work")
REGISTRY_SUFFIXES = ("ations", "ation", "ings", "ing", "ies", "es", "ed", "ly", "s")
GATE_SUFFIXES = ("ations", "ation", "ingly", "ings", "ing", "edly", "ies", "ied", "es", "ed", "ly", "s")

ABSOLUTE = r"(?i)\b(no \w+(?: \w+)? (?:can|may|will|is)|never|cannot|can't|can not|always|impossible|without exception|nothing)\b"
EXCEPTION = r"(?i)\b(except(?:ion)?|outside (?:the|of)|bypass\w*|override\w*|break-glass|circumvent\w*|without (?:the |a )?(?:approval|review|second))\b"
REGISTRY_NEGATION = r"(?i)\b(not|no|never|cannot|can't|doesn't|does not|isn't|unsupported|unavailable)\b"
GATE_NEGATION = r"(?i)\b(not|no|never|cannot|can't|doesn't|does not|isn't|aren't|without|unsupported|unavailable)\b"
QUALIFIER = r"(?i)\b(?:on|in|for) the (\w+) (?:plan|edition|tier|region)\b"
SUBJECT_END = (
    r"(?i)\b(is|are|was|were|has|have|had|can|cannot|can't|will|does|do|must|may|lets?|"
    r"supports?|pairs?|includes?|requires?|provides?|offers?|stores?|keeps?|sends?|records?|"
    r"retains?|uses?|runs?|shows?|marks?|applies|apply|connects?|accepts?|reconciles?|matches?|"
    r"returns?|ships?|deletes?|holds?|resumes?|installs?|predicts?|measures?|reaches?)\b"
)
NUMBER_WITH_UNIT = r"(?i)\d+(?:[.,]\d+)*(?:\s?%|\s?(?:ms|s|x|gb|tb|mb|k|m))?"

CATEGORIES = (
    ("compliance", r"\b(soc ?2|iso ?27001|iso/iec|gdpr|hipaa|pci|fedramp|certif\w*|complian\w*|audit\w*|regulat\w*|data residency|resides? in|attest\w*)\b"),
    ("pricing", r"(\$\d|\bpric\w*|\bcost\w*\b|\bfee\b|\bfees\b|\bper (?:seat|user|month)\b|\bfree tier\b|\bbilling\b)"),
    ("competitive", r"\b(than|compared|unlike|competitor\w*|alternative\w*|versus|vs\.?)\b"),
    ("customer-reference", r"\b(customers? (?:such as|including|like)|used by|trusted by|case study)\b"),
    ("metric", r"(\d+(?:\.\d+)?\s?(?:%|ms|milliseconds?|seconds?|minutes?|hours?|days?)|\buptime\b|\bsla\b|\baccura\w*\b|\blatency\b|\bthroughput\b)"),
    ("security", r"\b(encrypt\w*|tls|aes|key[s]?\b|authenticat\w*|sso|saml|mfa|2fa|access control\w*|role-based|rbac|permission\w*|audit log\w*|tamper\w*)\b"),
    ("integration", r"\b(integrat\w*|api\b|apis\b|webhook\w*|sdk\w*|connector\w*|export\w* to|import\w* from|sync\w* with)\b"),
    ("deployment", r"\b(deploy\w*|on-prem\w*|self-host\w*|cloud|install\w*|region\w*|hosted)\b"),
    ("availability", r"\b(beta|preview|generally available|general availability|early access|available on|plan\b|plans\b|edition)\b"),
    ("limitation", r"\b(cannot|can't|not supported|unsupported|limit\w*|maximum|at most|up to|only)\b"),
)
DEFAULT_CATEGORY = "capability"
HEDGE = r"(?i)\b(typically|usually|may|might|approximately|about|around|up to|can vary|in most cases)\b"
ROADMAP = r"(?i)\b(planned|roadmap|coming soon|will be|expected to|in a future release|tbd)\b"
SKIPPED_OPENING = r"(?i)^(note|tip|see|learn more|for example|click|go to|select|open|navigate)\b"
CALL_TO_ACTION = r"(?i)^(talk|book|get|start|see|try|request|contact|learn|join|sign up|schedule|download|read|ask|let's|would)\b"
SUPERLATIVE = (
    r"(?i)\b(only|first|fastest|best|leading|unique|unmatched|unrivaled|guarantee[sd]?|always|never|all|every|any|"
    r"fully|completely|entirely|totally|unlimited|instant(?:ly)?|zero|100\s?%|most|no other|industry-leading|world-class|"
    r"perfect(?:ly)?|bulletproof|effortless(?:ly)?|anywhere|everywhere|everything|absolutely|certified|compliant|ever)\b"
)
CONDITION = (
    r"(?i)\b(only (?:on|in|with|for|when)|on the \w+ (?:plan|edition|tier)|(?:plan|edition|tier)s?\b|"
    r"version \d[\w.]*|v\d[\w.]*|\d+(?:\.\d+)+ or later|or later|or above|or newer|beta|preview|early access|when |if |unless|"
    r"except|in (?:the )?(?:us|eu|uk)\b|regions?|self-hosted|on-prem\w*|cloud|or (?:a |an )?(?:software |hardware )?equivalent)"
)
FACT_VERB = (
    r"(?i)\b(is|are|was|were|has|have|supports?|integrates?|encrypts?|stores?|offers?|includes?|provides?|runs?|requires?|"
    r"connects?|syncs?|works?|keeps?|lets?|allows?|enables?|delivers?|reduces?|cuts?|detects?|alerts?|records?|"
    r"protects?|meets?|complies|certified|compliant|available|guarantees?|ensures?|handles?|processes?|reconciles?|"
    r"matches?|exports?|imports?|sends?|logs?|retains?|lasts?|measures?|controls?|adjusts?|learns?|never|always|"
    r"can|cannot|can't|will|lose|loses|saves?|saving|means?)\b"
)
QUANTIFIER = r"(?i)\b(every|all|never|always|zero|no more|nothing|100\s?%|guaranteed|anywhere|everywhere)\b"
NORMATIVE = r"(?i)\b(deserves?|worth|should|matters?|best defen[cs]e|built for|designed for|made for|imagine|peace of mind|confidence|calm(?:er)?|trust(?:s|ed)?)\b"
CONCLUSION = r"(?i)\b(so|therefore|which means|that means|this means|as a result|thus|meaning|so you can|so your)\b"
HIGH_RISK = ("compliance", "metric", "pricing")

POSITIONING_SAMPLES = (
    "Your team deserves a calmer week.", "Built for the people who keep things running.", "See what changes when the busywork goes away.", "What would you do with the time back?",
    "Less firefighting, more planning.", "Start where you are.",
)
OVERSTATING = ("the only", "always", "every", "the fastest", "guaranteed", "fully")
SAMPLE_CONDITION = (
    r"(?i)(,?\s*(?:on the \w+ (?:plan|edition|tier)|with firmware [\d.]+ or later|in the \w+ region|"
    r"\(or [^)]+\)|or later|when [^,.]+|if [^,.]+|for [A-Z][\w-]+ customers)\b)"
)
SAMPLE_VERB = r"^(\S+(?:\s\S+)?)\s(is|are|can|supports?|provides?|lets?|keeps?|sends?|stores?)\b"
GRAFTED_VERB = r"^.*?\b(is|are|can|supports?|provides?|lets?|sends?|stores?|keeps?|includes?)\b"
#: Decisions that ban words, name the product and leave topics out; fixed values.
BANNED_DECISION = r"(?i)^(?:never|do not|don't) use (?:the )?(?:word|term|phrase)s?\s+(.+?)(?: in [\w\s-]+)?\.?$"
NAMING_DECISION = r"(?i)^always call it\s+(.+?),\s*never\s+(.+?)\.?$"
TOPIC_DECISION = r"(?i)^deprioriti[sz]e\s+(?:the\s+)?(.+?)(?:\s+(?:deployment|option|model|feature))?(?:\s+in copy)?\.?$"
