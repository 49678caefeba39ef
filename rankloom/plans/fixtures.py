"""Job descriptions for the registered queries."""

from rankloom.jobs import JobSpec

JD_STAR = JobSpec(
    jd_id="star",
    title="Senior Backend Engineer",
    seniority="senior",
    required_skills=("small ring", "red widget", "hot gear"),
    preferred_skills=("blue bolt", "Strong old plate", "new rod"),
    responsibilities=("Build production pipeline", "Handle monitoring"),
    locations=("nation-3", "ASIA"),
    education_keywords=("computer science",),
    experience_years_min=5,
    production_signals=("latency",),
)
JD_JUNIOR = JobSpec(
    jd_id="junior",
    title="Junior QA Engineer",
    seniority="Associate",
    required_skills=("old plate", " Old  Plate ", "cold spring expert", "hands-on production"),
    responsibilities=("Review data quality", "Test the red widget"),
    locations=("EUROPE",),
    experience_years_min=2,
)
JD_ANALYST = JobSpec(
    jd_id="analyst",
    title="Data Analyst",
    seniority="data analyst",
    preferred_skills=("new gizmo", "data engineer"),
    education_keywords=("science", "physics"),
)
JD_EMPTY = JobSpec(jd_id="empty")
CANDIDATE_JOBS = [JD_STAR, JD_JUNIOR, JD_ANALYST, JD_EMPTY]

JD_DOC = JobSpec(
    jd_id="doc",
    title="eriner nicht",
    required_skills=("thtion", "attion", "ering"),
    preferred_skills=("thing", "erble", "oning"),
)
