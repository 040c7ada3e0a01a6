"""Fixed values of the scoring model, in their given order."""

EXACT_FIELDS = ("age", "relationship_goal", "wants_kids", "has_kids", "religion_importance")
JUDGED_FIELDS = ("location", "occupation", "values", "interests", "life_events", "dealbreakers", "partner_preferences", "communication_style")
ARRAY_FIELDS = ("values", "interests", "life_events", "dealbreakers", "partner_preferences")
UNSCORED_FIELDS = ("summary",)
DEALBREAKER_FIELDS = ("wants_kids", "has_kids", "religion_importance", "dealbreakers")
SCORED_FIELDS = EXACT_FIELDS + JUDGED_FIELDS
UNSURE_FIELDS = ("relationship_goal", "wants_kids")
UNSURE = "unsure"

ALL_FIELDS = SCORED_FIELDS + UNSCORED_FIELDS
EXACT_CLASSES = {
    "relationship_goal": ("casual", "long_term", "marriage", "unsure"),
    "wants_kids": ("yes", "no", "unsure"),
    "has_kids": ("true", "false"),
    "religion_importance": ("none", "low", "medium", "high"),
}
AGES = (25, 45)
CITIES = ("Portland", "Austin", "Minneapolis", "Philadelphia", "Denver", "Pittsburgh", "Sacramento", "Nashville", "Providence", "Tucson", "Milwaukee", "Richmond")
OCCUPATIONS = (
    "nurse", "structural engineer", "high school teacher", "line cook", "accountant", "physical therapist", "graphic designer", "electrician",
    "research librarian", "logistics coordinator", "veterinary technician", "software developer",
)
EDUCATION = ("high school", "trade certificate", "associate degree", "bachelor's degree", "master's degree")
EXACT_DISCLOSURES = ("volunteer", "needs_followup")
SPECIFIC_SHARE = 0.6
JUDGED_FACTS = (12, 16)

DISCLOSURES = ("volunteer", "needs_followup", "hedge", "contradict")
STYLES = ("terse", "balanced", "rambling", "tangential")
STYLE_WORDS = {"terse": (15, 40), "balanced": (40, 120), "rambling": (120, 250), "tangential": (120, 250)}
VERDICTS = ("supported", "supported_offsheet", "unsupported", "abstained", "judge_error", "span_invalid")
CREDITED = ("supported", "supported_offsheet")
ERRORS = ("judge_error", "span_invalid")
JUDGE_ONLY = ("supported_offsheet", "judge_error", "span_invalid")

GATED_KEYS = ("precision", "precision_dealbreakers", "recall_elicited", "recall_dealbreakers")
STATIC_RATES = (
    "precision", "hallucination_rate", "precision_dealbreakers", "recall", "recall_elicited", "recall_dealbreakers",
    "recall_exact", "offsheet_rate", "abstention_rate", "followup_share", "judge_error_rate",
    "span_invalid_rate_first_pass", "span_invalid_rate_final", "stability_extraction", "disclosure_mismatch",
)
STATIC_COUNTS = ("untagged_capture", "claims_deduped")
DYNAMIC_KINDS = {
    "recall_by_disclosure": "rate", "recall_by_field": "rate", "precision_by_field": "rate", "recall_exact_by_field": "rate",
    "exact_floor": "rate", "followup_share_by_style": "rate", "yield": "count", "yield_per_minute": "ratio",
}

STATUS_BY_REASON = {
    "schema_invalid": "schema_invalid", "refusal": "refusal", "max_tokens": "truncated",
    "model_context_window_exceeded": "truncated", "provider_error": "provider_error",
}

STOPWORDS = tuple(
    """
    a an and are as at be been being but by can could did do does for from had has have
    he her him his how i if in into is it its me more most my no not of on one or our out
    she so some that the their them then there these they this those to too up us very
    was we were what when where which while who why will with would you your am been
    about also just like really get got go going went make made take took thing things
    lot bit kind sort much many own new old time times way ways
    """.split()
)

OPERATION_WEIGHTS = (("drop", 0.40), ("homophone", 0.30), ("filler", 0.20), ("punctuation", 0.10))
FILLERS = ("um", "uh", "like", "you know")
SENTENCE_PUNCTUATION = ".,;:!?"
DISCLOSURE_MIX = (("volunteer", 0.6), ("needs_followup", 0.3), ("hedge", 0.1))

Z95 = 1.959963984540054
MIN_FLOOR = 0.005
DEGRADED_ABOVE = 0.05
MAX_SPAN_WORDS = 12
WORDS_PER_MINUTE = 150
FOLLOWUP_TRIGGER_WORDS = 40
