"""Fixed values of the ranking model.

Everything in this file is a fixed value: word lists, weights, labels and
patterns that decide the numbers and the sentences in the results.  Nothing here
is logic.
"""

# --- fixed values: tokens -------------------------------------------------
TOKEN_PATTERN = r"[A-Za-z][A-Za-z0-9+#.\-]{1,}"

STOPWORDS = (
    "a an and are as at based be for hands in of on or role systems the to with work"
).split()

GENERIC_SKILL_WORDS = (
    "advanced building design designing development experience expert excellent "
    "hands infrastructure production proficient strong"
).split()

# --- fixed values: evidence weights ---------------------------------------
PROFICIENCY_SCORES = {"beginner": 0.45, "intermediate": 0.68, "advanced": 0.86, "expert": 1.0}
PROFICIENCY_DEFAULT = 0.62
PROFICIENCY_ORDER = {"beginner": 1, "intermediate": 2, "advanced": 3, "expert": 4}

# --- fixed values: term lists ---------------------------------------------
PRODUCTION_TERMS = (
    "production deployed scale scalable latency throughput pipeline monitoring "
    "on-call kubernetes docker ci/cd aws gcp azure"
).split()
SENIOR_WORDS = "senior lead principal staff manager head architect".split()
JUNIOR_WORDS = "junior entry associate intern trainee".split()
PROMOTIONAL_WORDS = "expert guru rockstar".split()
AI_KEYWORDS = (
    "ai ml llm nlp rag lora qlora peft bert gpt python pytorch tensorflow sklearn "
    "transformer embedding vector milvus pinecone faiss langchain"
).split() + ["machine learning", "deep learning", "fine-tuning", "feature engineering", "model"]

# --- fixed values: patterns -----------------------------------------------
METRIC_PATTERN = r"\b\d+(?:\.\d+)?\s*(?:%|gb|tb|ms|k|m|users?|requests?|records?)\b"
DEGREE_PATTERN = r"\b(b\.?tech|m\.?tech|b\.?e\.?|m\.?e\.?|phd|computer science|data science)\b"
YEAR_PATTERN = r"\b20\d{2}\b"
SKILL_PREFIX_PATTERN = r"^(strong|expert|advanced|excellent)\s+"
SKILL_FILLER_PATTERN = (
    r"\b(experience|hands-on|designing|production|with|based|systems|infrastructure)\b"
)

# --- fixed values: semantic fields of an unknown schema --------------------
SEMANTIC_KEYWORDS = {
    "identity": "name full_name candidate email id profile".split(),
    "skills": "skill technology tool stack competency capabilit keyword".split(),
    "experience": "experience employment work history years role".split(),
    "education": "education degree university school certification".split(),
    "location": "location city country state remote timezone".split(),
    "availability": "availability notice start joining".split(),
    "seniority": "seniority level grade title".split(),
    "compensation": "salary compensation rate ctc".split(),
    "projects": "project portfolio achievement production impact".split(),
}
PATHS_PER_FIELD = 8

# --- fixed values: names inside the engagement-signals object --------------
SIGNAL_NUMBERS = {
    "response_rate": "recruiter_response_rate",
    "response_hours": "avg_response_time_hours",
    "completeness": "profile_completeness_score",
    "views": "profile_views_received_30d",
    "saved": "saved_by_recruiters_30d",
    "completion": "interview_completion_rate",
    "offer": "offer_acceptance_rate",
    "github": "github_activity_score",
    "notice": "notice_period_days",
}
SIGNAL_FLAGS = {
    "email_ok": "verified_email",
    "phone_ok": "verified_phone",
    "linked": "linkedin_connected",
    "open_to_work": "open_to_work_flag",
    "relocate": "willing_to_relocate",
}
SIGNAL_WORK_MODE = "preferred_work_mode"
SIGNAL_ASSESSMENTS = "skill_assessment_scores"

# --- fixed values: breakdown, labels ---------------------------------------
BREAKDOWN = (
    "semantic_match lexical_relevance technical_fit skill_overlap "
    "required_skill_coverage preferred_skill_coverage skill_depth role_fit "
    "relevant_experience production_experience_signals seniority_match "
    "career_progression career_consistency behavioral_signals availability "
    "education_relevance location_match fraud_detection consistency_analysis "
    "evidence_confidence must_have_gate"
).split()

STRENGTH_LABELS = {
    "lexical_relevance": "Lexical Relevance",
    "technical_fit": "Strong technical fit",
    "skill_overlap": "Strong skill alignment",
    "required_skill_coverage": "Required skills covered",
    "preferred_skill_coverage": "Preferred skills covered",
    "skill_depth": "Deep skill evidence",
    "role_fit": "Relevant current role",
    "relevant_experience": "Experience level fits role",
    "production_experience_signals": "Production delivery evidence",
    "seniority_match": "Seniority aligned",
    "career_progression": "Consistent career progression",
    "career_consistency": "Consistent career history",
    "behavioral_signals": "Strong engagement signals",
    "availability": "Favorable availability",
    "education_relevance": "Relevant education background",
    "location_match": "Location alignment",
    "fraud_detection": "Low integrity risk",
    "consistency_analysis": "Consistency Analysis",
    "evidence_confidence": "Rich profile evidence",
}

CONCERN_LABELS = {
    "technical_fit": "Weak technical fit",
    "required_skill_coverage": "Low required-skill coverage",
    "role_fit": "Current role appears weakly aligned",
    "relevant_experience": "Experience below role target",
    "production_experience_signals": "Limited production evidence",
    "behavioral_signals": "Weak engagement signals",
    "availability": "Availability may be less favorable",
    "evidence_confidence": "Profile evidence is thin",
}

FLAG_SPARSE = "Sparse profile data"
FLAG_LOW_DIVERSITY = "Low information diversity"
FLAG_LOW_COMPLETENESS = "Low profile completeness"
FLAG_OPEN_DATES = "Open-ended experience dates need review"
FLAG_PROMOTIONAL = "Repeated promotional language"

# --- fixed values: sentences of the long-form reason ------------------------
OPENING_STRONG = (
    "Candidate demonstrates strong %s expertise and extensive professional experience."
)
OPENING_RELEVANT = "Candidate demonstrates relevant %s capability for this role."
OPENING_PARTIAL = (
    "Candidate shows partial alignment with the role based on the available profile evidence."
)
STRENGTH_SENIOR = "Senior-level engineering background"
STRENGTH_CAREER = "Consistent career progression"
STRENGTH_CORE = "Strong alignment with core role requirements"
STRENGTH_DELIVERY = "Evidence of production delivery experience"
STRENGTH_NONE = "Best available match among the ranked candidate pool"
CONCERN_NONE = "No major concerns surfaced from the scoring evidence"
OVERALL_80 = (
    "Strong candidate, but may require targeted onboarding for the missing "
    "responsibilities noted above."
)
OVERALL_70 = "Strong candidate with solid evidence for the role requirements."
OVERALL_55 = "Moderate match; worth reviewing if the team can support skill ramp-up."
OVERALL_LOW = (
    "Lower-confidence match based on the current job criteria and profile evidence."
)

# --- fixed values: sizes ----------------------------------------------------
TOP_K_RETRIEVAL = 5000
TOP_K_FEATURES = 500
TOP_K_EXPORT = 100
EMBEDDING_DIMS = 384
JOB_TEXT_CHARS = 24000
