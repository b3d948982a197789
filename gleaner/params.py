"""Parameter tables.

Operators take their word lists, rule lists and limits as arguments; the
defaults below are the values the digest pipeline uses.  Everything in the
"fixed values" blocks must stay exactly as written for results to agree with
the original pipeline: same entries, same order.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — keyword lists of the digest pipeline (order kept)
# ---------------------------------------------------------------------------

# Core (transactional) patterns; an entry containing ".*" is a regex search,
# every other entry is a plain substring test on lower-cased text.
CORE_PATTERNS = [
    'agent wallet', 'agentic wallet', 'agent payment', 'agent purchase',
    'agent checkout', 'agentic checkout', 'agentic transaction',
    'agentic procurement', 'agentic commerce',
    'autonomous purchase', 'autonomous purchasing', 'autonomous buying',
    'auto-purchase', 'delegated spending', 'spending authority',
    'budget delegation', 'ai purchasing', 'ai shopping',
    'agent-to-agent', 'machine-to-machine commerce', 'm2m commerce',
    'shopping agent', 'shopping ai', 'ai agent.*checkout',
    'ai agent.*purchase', 'ai agent.*transaction',
]

# Broader commerce words for the pre-kill gate (plain substrings).
SHOPPING_WORDS = [
    'payment', 'wallet', 'transaction', 'purchase', 'purchasing',
    'checkout', 'buy', 'buying', 'procurement', 'negotiate', 'negotiation',
    'bid', 'bidding', 'auction', 'spending', 'budget',
    'shopping', 'commerce', 'retail', 'merchant', 'marketplace',
    'e-commerce', 'ecommerce', 'store', 'cart', 'price', 'pricing',
    'consumer', 'buyer', 'seller', 'vendor', 'supplier',
    'fulfillment', 'delivery', 'logistics', 'supply chain',
    'agent shopping', 'agentic commerce', 'agentic shopping',
    'product search', 'product discovery', 'comparison shopping',
]

# Words that do not count as a shared distinctive word in story matching.
GENERIC_WORDS = [
    'ai', 'agent', 'agents', 'agentic', 'launches', 'launch',
    'new', 'for', 'the', 'and', 'in', 'on', 'of', 'to', 'with',
    'introduces', 'unveils', 'announces', 'offers', 'platform',
]

# Boilerplate deletions, applied in this order, case-blind (Python regex syntax).
BOILERPLATE_RULES = [
    r'View this email in your browser.*',
    r'Unsubscribe.*',
    r'If you no longer wish to receive these emails.*',
    r'Copyright \d{4}.*reserved\.',
    r'Sent by:.*',
    r'Your privacy is important to us.*',
    r'Manage Preferences \| Unsubscribe.*',
    r'Read this email in your browser\s*',
    r'Having trouble viewing this email\? View it in your browser\.\s*',
    r'Click here to unsubscribe\s*',
    r'To ensure delivery, please add [^@]+@[\w.-]+ to your address book\.',
    r'Forward to a friend.*',
    r'If this email is not displaying correctly, you can view it here.*',
    r'To view this email as a web page, click here\..*',
]

# ---------------------------------------------------------------------------
# FIXED VALUES — gate messages (formats)
# ---------------------------------------------------------------------------
MSG_STATUS_NO_VIOLATIONS = "{status} with zero violations — no structural tension"
MSG_GENERIC_ANGLE = "GENERIC_ANGLE — no non-obvious take found"
MSG_WEAK_ANGLE = "weak angle ({n} chars < 100 minimum)"
MSG_CORE_WEAK = "CORE but weak axiom engagement (aligned={aligned}, tv={tv})"
MSG_CORE_BLAND = "CORE with zero violations AND zero tensions — no structural tension"
MSG_ADJ_NO_VIOLATIONS = "ADJACENT with no VIOLATIONS (tensions={tensions} don't count for ADJACENT)"
MSG_ADJ_NO_SUBSTANCE = "ADJACENT with no companies AND no technologies"
MSG_PASS_DETAIL = "tier={tier}, aligned={aligned}, tensions={tensions}, violations={violations}, angle_len={angle_len}"
MSG_PREKILL_T1 = "No violations, ADJACENT tier, no shopping/commerce keywords"
MSG_PREKILL_T2 = "No violations, {status}, no core transactional keywords"
MSG_NO_VERDICT = "No LLM verdict matched"

# ---------------------------------------------------------------------------
# FIXED VALUES — limits and weights
# ---------------------------------------------------------------------------
HARD_CAP = 8
SYNTHESIS_TOP = 5
ALIGNED_REASON_MIN = 10          # reason must be longer than this
ANGLE_MIN = 100                  # angle shorter than this is weak
SIMILAR_JACCARD = 0.4
CONTAIN_MIN_LEN = 10             # both keys longer than this for containment
OVERSIZED_CLUSTER = 25
CLUSTER_MIN_ITEMS = 3

# item score weights, in tenths so ties are exact
SCORE_TENTHS = {
    "core": 30, "violation": 10, "tension": 3,
    "CONFIRMED": 20, "REPORTED": 10, "ANALYSIS": 5,
    "angle_gt_150": 10, "angle_gt_100": 5, "companies": 5, "keep": 10,
}

# validation limits
VALIDATION = {
    "min_silhouette": 0.2, "max_noise_ratio": 0.3, "min_coherence": 0.4,
    "min_source_diversity": 0.2, "min_score": 0.3,
}
ALERT_COOLDOWN_MINUTES = 15
CACHE_TTL_HOURS = 24
CACHE_TRIM_TARGET = 0.8
HYBRID = {"min_score": 0.3, "min_clusters": 2, "max_clusters": 50, "similarity": 0.7}
DENSITY = {"min_cluster_size": 2, "min_samples": 2, "max_cluster_size": 25}

FILTER_MODES = [
    # mode, max_violations, threshold
    ("strict", 0, 0.75),
    ("balanced", 1, 0.60),
    ("exploratory", 3, 0.40),
]

DEFAULT_MODE = "balanced"
MIN_ALIGNED_THESES = 1

REALITY_STATUSES = [
    # status, requires_full_analysis
    ("CONFIRMED", True),
    ("REPORTED", True),
    ("RUMOR", False),
    ("OPINION", True),
    ("ANALYSIS", True),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — rule (axiom) dimension: id, title
# ---------------------------------------------------------------------------
RULES = [
    (1, "Institutions matter more than intent"),
    (2, "Legitimacy is a hard constraint"),
    (3, "Adaptability beats ambition"),
    (4, "Errors must be localized and costly"),
    (5, "Knowledge is dispersed; central intelligence is a liability"),
    (6, "Incentives overpower intentions every time"),
    (7, "Rules and markets beat ownership"),
    (8, "Architecture determines sustainability"),
    (9, "AI should narrow the judgment-consequence distance"),
    (10, "Symbolism is stabilizing but non-operative"),
    (11, "Buy outcomes, not subsidize ambition"),
    (12, "Most failures are structural, not ideological"),
]

# FIXED VALUES — thesis dimension: id, title, category
THESES = [
    (1, "Delegation is Power Transfer", "control"),
    (2, "Efficiency ≠ Sovereignty", "tradeoffs"),
    (3, "Virtue is Survival", "ethics"),
    (4, "Updates are Economic Events", "dependencies"),
    (5, "Exit is a Technical Mirage", "lock-in"),
    (6, "Survivability > Exit", "resilience"),
    (7, "Update Authority is the Chokepoint", "control"),
    (8, "Hybrid is Structural", "architecture"),
    (9, "Procurement is Enforcement", "procurement"),
    (10, "Habits Persist by UX", "adoption"),
    (11, "The Agentic Divide", "inequality"),
    (12, "Democratic Sovereignty is Non-Default", "policy"),
    (13, "Retail = Governor of Cognition", "retail"),
    (14, "Context is Shelf Space", "discovery"),
]
