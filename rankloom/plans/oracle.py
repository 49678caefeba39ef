"""DuckDB SQL that states the expected results, over the same Parquet tables.

Written from the definitions, not from the Spark plans: layered common table
expressions that start from the base tables.
"""

from __future__ import annotations

from rankloom import constants as C
from rankloom.jobs import JobSpec
from rankloom.plans.fixtures import CANDIDATE_JOBS, JD_DOC


def _list(items) -> str:
    return "CAST([" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "] AS VARCHAR[])"


STOP = _list(C.STOPWORDS)
GENERIC = _list([*C.STOPWORDS, *C.GENERIC_SKILL_WORDS])


def toks(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all({x}, '[A-Za-z][A-Za-z0-9+#.\\-]+'), lambda tk: lower(tk)))"


def sig(x: str, noise: str = STOP) -> str:
    return f"list_filter({toks(x)}, lambda sg: NOT list_contains({noise}, sg))"


def sigs(texts: str) -> str:
    """Non-empty signal token lists of a list of texts."""
    return f"list_filter(list_transform({texts}, lambda tx: {sig('tx')}), lambda tl: len(tl) > 0)"


def clamp(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def soft(x: str, s: float) -> str:
    return f"(CASE WHEN {x} > 0 THEN 1.0::DOUBLE - exp(-({x})::DOUBLE / {float(s)}::DOUBLE) ELSE 0.0::DOUBLE END)"


def cov(a: str, b: str) -> str:
    return f"(len(list_intersect({a}, {b}))::DOUBLE / len({a}))"


def dens_scores(terms: str, tokens: str) -> str:
    return f"list_transform({terms}, lambda kt: least(1.0::DOUBLE, pow({cov('kt', tokens)}, 1.2)))"


def dens(scores: str) -> str:
    pos = f"list_filter({scores}, lambda ps: ps > 0)"
    return (
        f"(CASE WHEN len({pos}) = 0 THEN 0.0::DOUBLE ELSE "
        + clamp(
            f"0.62 * list_avg(list_slice(list_sort({pos}, 'DESC'), 1, 6)) "
            f"+ 0.38 * pow(len({pos})::DOUBLE / len({scores}), 0.7)"
        )
        + " END)"
    )


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


METRICS = C.METRIC_PATTERN.replace("\\\\", "\\")

# ---------------------------------------------------------------------------
# the derived candidates table
# ---------------------------------------------------------------------------

CANDIDATES = """
sk0 AS (
  SELECT o_custkey, p_name, CAST(sum(l_quantity) AS INTEGER) AS months, CAST(count(*) AS INTEGER) AS n, max(p_size) AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY o_custkey, p_name),
sk1 AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY months DESC, p_name) AS place,
    CASE WHEN size < 13 THEN 'beginner' WHEN size < 26 THEN 'intermediate' WHEN size < 39 THEN 'advanced' ELSE 'expert' END AS lvl
  FROM sk0),
sk AS (
  SELECT o_custkey, list({'name': p_name, 'proficiency': lvl, 'duration_months': months, 'endorsements': n} ORDER BY place) AS skills
  FROM sk1 WHERE place <= 12 GROUP BY o_custkey),
hi0 AS (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior Backend Engineer' WHEN '2-HIGH' THEN 'Data Analyst'
      WHEN '3-MEDIUM' THEN 'Junior QA Engineer' WHEN '4-NOT SPECIFIED' THEN 'Lead Data Engineer' ELSE 'Platform Architect' END AS title
  FROM orders),
hi AS (
  SELECT o_custkey, count(*) AS n_orders,
    list({'title': title, 'duration_months': CAST(floor(o_totalprice / 10000) AS INTEGER), 'is_current': o_orderstatus = 'O'} ORDER BY place) FILTER (WHERE place <= 6) AS history
  FROM hi0 GROUP BY o_custkey),
ev AS (
  SELECT user_id, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'click') AS clicks,
    count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
    count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'signup') AS signups,
    avg(value) AS mean_value, max(value) AS top_value
  FROM events GROUP BY user_id),
cand AS (
  SELECT c_custkey AS key, 'CAND_' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS candidate_id, c_name AS name,
    CASE c_mktsegment WHEN 'MACHINERY' THEN 'Senior Backend Engineer' WHEN 'HOUSEHOLD' THEN 'Data Analyst'
      WHEN 'FURNITURE' THEN 'Junior QA Engineer' WHEN 'BUILDING' THEN 'Lead Data Engineer' ELSE 'Platform Architect' END AS title,
    CASE WHEN c_custkey % 17 <> 0 THEN round(greatest(c_acctbal, 0.0) / 700, 1) END AS profile_years,
    replace(n_name, '_', '-') AS location, r_name AS country,
    CASE WHEN c_custkey % 50 = 0 THEN repeat('expert guru ', 5) || 'builder' WHEN c_custkey % 11 = 0 THEN 'x'
      ELSE 'Deployed production pipeline with monitoring handling ' || coalesce(n_orders, 0) || 'k requests and ' || coalesce(errors, 0) || 'ms latency' END AS summary,
    coalesce(skills, []) AS skills, coalesce(history, []) AS history,
    c_nationkey % 4 <> 3 AS has_education, 'tier_' || CAST(c_nationkey % 4 + 1 AS VARCHAR) AS tier,
    c_custkey % 13 <> 0 AS has_signals,
    round(clicks / n_events, 4) AS response_rate, round(mean_value, 2) AS response_hours,
    CAST(30 + c_custkey % 70 AS INTEGER) AS completeness, views, purchases AS saved,
    round(purchases / nullif(purchases + errors, 0), 4) AS completion,
    CASE WHEN c_custkey % 7 = 0 THEN -1.0::DOUBLE ELSE round(signups / n_events, 4) END AS offer,
    round(top_value / 5, 2) AS github,
    c_custkey % 2 = 0 AS email_ok, c_custkey % 3 = 0 AS phone_ok, c_custkey % 5 = 0 AS linked,
    c_custkey % 2 = 0 AS open_to_work, c_custkey % 3 = 0 AS relocate, CAST((c_custkey % 5) * 30 AS INTEGER) AS notice
  FROM customer
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN ev ON ev.user_id = c_custkey % (SELECT count(DISTINCT user_id) FROM events)
  LEFT JOIN sk ON sk.o_custkey = c_custkey LEFT JOIN hi ON hi.o_custkey = c_custkey)
"""

_PY_BOOL = "CASE WHEN {0} THEN 'True' ELSE 'False' END"


def _leaf(x: str) -> str:
    return f"coalesce(CAST({x} AS VARCHAR), '')"


_SKILL_LEAVES = (
    "CASE WHEN len(skills) = 0 THEN [''] ELSE flatten(list_transform(skills, lambda sx: [sx.name, sx.proficiency, "
    "CAST(sx.duration_months AS VARCHAR), CAST(sx.endorsements AS VARCHAR)])) END"
)
_HISTORY_LEAVES = (
    "CASE WHEN len(history) = 0 THEN [''] ELSE flatten(list_transform(history, lambda hx: [hx.title, "
    "CAST(hx.duration_months AS VARCHAR), CASE WHEN hx.is_current THEN 'True' ELSE 'False' END])) END"
)
_SIGNAL_LEAVES = (
    "CASE WHEN NOT has_signals THEN [''] ELSE ["
    + ", ".join(
        _leaf(x)
        for x in "response_rate response_hours completeness views saved completion offer github".split()
    )
    + ", "
    + ", ".join(_PY_BOOL.format(x) for x in "email_ok phone_ok linked open_to_work relocate".split())
    + ", "
    + _leaf("notice")
    + "] END"
)

# one row per record, with the inputs of every feature
PROFILE_C = f"""
prof AS (
  SELECT key, candidate_id, name AS display_name, title, title || ' ' AS titles, title AS reason_title,
    location || ', ' || country AS reason_location, location, country, summary,
    array_to_string(list_concat([candidate_id, name, title, {_leaf('profile_years')}, location, country, summary],
      {_SKILL_LEAVES}, {_HISTORY_LEAVES},
      CASE WHEN has_education THEN ['B.Tech Computer Science', tier] ELSE [''] END, {_SIGNAL_LEAVES}), ' ') AS text,
    skills, history, profile_years,
    coalesce(profile_years, CASE WHEN len(skills) + len(history) > 0 THEN
      (list_sum(list_transform(skills, lambda sx: sx.duration_months::DOUBLE)) + coalesce(list_sum(list_transform(history, lambda hx: hx.duration_months::DOUBLE)), 0)) / 12.0 END, 0.0) AS years,
    array_to_string(list_concat([title, title], list_transform(history, lambda hx: hx.title)), ' ') AS role_text,
    CASE WHEN has_education THEN 'B.Tech Computer Science ' || tier ELSE '' END AS education_text,
    CASE WHEN has_education THEN 1 ELSE 0 END AS education_count,
    concat_ws(' ', location, country, country, location) AS location_text,
    '' AS experience_text, true AS has_profile, has_signals,
    CASE WHEN has_signals THEN 14 ELSE 0 END AS signal_keys, false AS available,
    response_rate, response_hours, completeness::DOUBLE AS completeness, views::DOUBLE AS views, saved::DOUBLE AS saved,
    completion, offer, github, email_ok, phone_ok, linked, open_to_work, relocate, notice::DOUBLE AS notice
  FROM cand)
"""

PROFILE_D = """
prof AS (
  SELECT doc_id AS key, CAST(doc_id AS VARCHAR) AS candidate_id, CAST(doc_id AS VARCHAR) AS display_name, '' AS title, ' ' AS titles,
    'Candidate' AS reason_title, '' AS reason_location,
    CAST(doc_id AS VARCHAR) || ' ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text,
    CAST([] AS STRUCT("name" VARCHAR, proficiency VARCHAR, duration_months INTEGER, endorsements INTEGER)[]) AS skills,
    CAST([] AS STRUCT(title VARCHAR, duration_months INTEGER, is_current BOOLEAN)[]) AS history,
    NULL::DOUBLE AS profile_years, 0.0::DOUBLE AS years, '' AS role_text, '' AS education_text, 0 AS education_count,
    '' AS location_text, '' AS experience_text, false AS has_profile, false AS has_signals, 0 AS signal_keys, false AS available,
    NULL::DOUBLE AS response_rate, NULL::DOUBLE AS response_hours, NULL::DOUBLE AS completeness, NULL::DOUBLE AS views,
    NULL::DOUBLE AS saved, NULL::DOUBLE AS completion, NULL::DOUBLE AS offer, NULL::DOUBLE AS github, false AS email_ok,
    false AS phone_ok, false AS linked, false AS open_to_work, false AS relocate, NULL::DOUBLE AS notice
  FROM documents)
"""

# ---------------------------------------------------------------------------
# jobs and scores
# ---------------------------------------------------------------------------


def _tidy(terms) -> list[str]:
    seen: dict[str, str] = {}
    for t in terms:
        t = " ".join(t.split())
        if t and t.lower() not in seen:
            seen[t.lower()] = t
    return list(seen.values())


def jobs_cte(jobs: list[JobSpec]) -> str:
    rows = []
    for j in jobs:
        years = "NULL::DOUBLE" if j.experience_years_min is None else f"{float(j.experience_years_min)}::DOUBLE"
        rows.append(
            f"SELECT '{j.jd_id}' AS jd_id, '{j.title}' AS j_title, lower(trim('{j.seniority}')) AS level, "
            f"{_list(_tidy(j.required_skills))} AS req, {_list(_tidy(j.preferred_skills))} AS pref, "
            f"{_list([*j.required_skills, *j.preferred_skills, j.title, *j.responsibilities[:8]])} AS lex_texts, "
            f"{_list([j.title, j.seniority, *j.responsibilities[:6]])} AS role_texts, "
            f"{_list([*j.production_signals, *C.PRODUCTION_TERMS])} AS prod_texts, "
            f"{_list(j.education_keywords)} AS edu_texts, {_list(j.locations)} AS loc_texts, {years} AS min_years"
        )
    return (
        "job0 AS (" + " UNION ALL ".join(rows) + "), "
        f"""job AS (SELECT jd_id, level, min_years, loc_texts, edu_texts,
  list_transform(req, lambda rq: {{'term': rq, 'lowered': lower(rq), 'focus': {sig('rq', GENERIC)}, 'words': {toks('rq')}}}) AS required,
  list_transform(pref, lambda pf: {{'term': pf, 'lowered': lower(pf), 'focus': {sig('pf', GENERIC)}, 'words': {toks('pf')}}}) AS preferred,
  {sigs('lex_texts')} AS lex, list_distinct(flatten({sigs('role_texts')})) AS role, {sigs('prod_texts')} AS prod,
  {sigs('edu_texts')} AS edu, {sigs('loc_texts')} AS loc, {sigs('[level]')} AS sen FROM job0)"""
    )


_EVIDENCE = clamp(
    "0.62 * (CASE lower(sv.proficiency) WHEN 'beginner' THEN 0.45 WHEN 'intermediate' THEN 0.68 WHEN 'advanced' THEN 0.86 WHEN 'expert' THEN 1.0 ELSE 0.62 END)::DOUBLE"
    f" + 0.26 * {soft('sv.duration_months', 48)} + 0.12 * {soft('sv.endorsements', 40)}"
)
_F1 = "(2.0 * len(list_intersect(tm.focus, sm.focus)) / (len(tm.focus) + len(sm.focus)))"


def _match(terms: str) -> str:
    from_text = f"least(1.0::DOUBLE, pow({cov('tm.focus', 'tokens')}, 1.35) + CASE WHEN contains(lowered, tm.lowered) THEN 0.16 ELSE 0.0 END)"
    from_skills = (
        "coalesce(list_max(list_transform(sks, lambda sm: CASE WHEN len(sm.focus) = 0 THEN 0.0::DOUBLE "
        f"ELSE least(1.0::DOUBLE, {_F1}::DOUBLE * (0.78 + 0.22 * sm.evidence)) END)), 0.0::DOUBLE)"
    )
    return (
        f"list_transform({terms}, lambda tm: CASE WHEN len(tm.focus) = 0 THEN 0.0::DOUBLE "
        f"ELSE {clamp(f'greatest({from_text}, {from_skills})')} END)"
    )


def _depth(ev: str) -> str:
    return clamp(f"0.58 * list_avg(list_slice(list_sort({ev}, 'DESC'), 1, 6)) + 0.42 * {soft(f'len({ev})', 14)}")


def _present(terms: str) -> str:
    return (
        f"len(list_filter({terms}, lambda tp: contains(lowered, tp.lowered) OR "
        "(len(tp.words) > 0 AND len(list_intersect(tp.words, tokens)) = len(tp.words))))"
    )


def _non_zero(x: str, default: float) -> str:
    return f"coalesce(nullif({x}, 0), {default}::DOUBLE)"


_BEHAVIOR = clamp(
    f"coalesce(response_rate, 0.45) * 0.24 + (1.0 - {soft(_non_zero('response_hours', 168.0), 168)}) * 0.10 "
    f"+ {clamp(_non_zero('completeness', 55.0) + ' / 100')} * 0.14 + {soft('coalesce(views, 0)', 80)} * 0.10 "
    f"+ {soft('coalesce(saved, 0)', 12)} * 0.10 + coalesce(completion, 0.58) * 0.14 "
    "+ (CASE WHEN offer >= 0 THEN offer ELSE 0.55 END) * 0.08 "
    f"+ (CASE WHEN github >= 0 THEN {clamp('github / 100')} ELSE 0.45 END) * 0.05 "
    "+ (email_ok::INT + phone_ok::INT + linked::INT) / 3.0 * 0.05"
)
_AVAILABLE = clamp(
    "0.48 * (CASE WHEN open_to_work THEN 1.0 ELSE 0.48 END) "
    f"+ 0.34 * (1.0 - {soft(_non_zero('notice', 90.0), 120)}) + 0.18 * (CASE WHEN relocate THEN 1.0 ELSE 0.62 END)"
)
_DEGREE = C.DEGREE_PATTERN

SCORES = f"""
tok AS (
  SELECT *, {toks('text')} AS tokens, lower(text) AS lowered, trim(role_text) AS role_trim,
    list_transform(skills, lambda sv: {{'focus': {sig('sv.name', GENERIC)}, 'evidence': {_EVIDENCE}}}) AS sks
  FROM prof),
tok2 AS (
  SELECT *, len(tokens) AS n_tokens, CASE WHEN role_trim = '' THEN tokens ELSE {toks('role_text')} END AS role_tokens,
    list_transform(sks, lambda se: se.evidence) AS evidence,
    list_filter(history, lambda hc: hc.is_current) AS current_jobs,
    list_filter([CASE WHEN length(text) < 80 THEN 'Sparse profile data' END,
      CASE WHEN len(tokens) < 20 THEN 'Low information diversity' END,
      CASE WHEN has_signals AND completeness < 45 THEN 'Low profile completeness' END,
      CASE WHEN contains(lower(experience_text), 'present') AND NOT regexp_matches(experience_text, '\\b20\\d{{2}}\\b') THEN 'Open-ended experience dates need review' END,
      CASE WHEN ({count_of('lowered', 'expert')} + {count_of('lowered', 'guru')} + {count_of('lowered', 'rockstar')}) / 3.0 > 3 THEN 'Repeated promotional language' END],
      lambda fl: fl IS NOT NULL) AS integrity_flags
  FROM tok),
pair AS (SELECT * FROM tok2 CROSS JOIN job),
feat0 AS (
  SELECT *, {_match('required')} AS required_scores, {_match('preferred')} AS preferred_scores,
    {dens_scores('lex', 'tokens')} AS lex_s, {dens_scores('prod', 'tokens')} AS prod_s,
    {dens_scores('edu', toks('education_text'))} AS edu_s, {dens_scores('sen', toks('lower(titles)'))} AS sen_s,
    {dens_scores('loc', "CASE WHEN trim(location_text) = '' THEN tokens ELSE " + toks('location_text') + " END")} AS loc_s,
    {_present('list_concat(required, preferred)')} AS n_present,
    {count_of('lowered', METRICS)} AS n_metrics,
    greatest(years, 0.0) AS y0
  FROM pair),
feat1 AS (
  SELECT *, list_concat(required_scores, preferred_scores) AS all_scores,
    {dens('lex_s')} AS lexical_relevance,
    {clamp(f"0.78 * {dens('prod_s')} + 0.22 * least(1.0::DOUBLE, n_metrics / 5.0)")} AS production_score,
    CASE WHEN len(role) = 0 THEN 0.58::DOUBLE ELSE {clamp(f"0.70 * pow({cov('role', 'role_tokens')}, 0.8) + 0.30 * pow({cov('role', 'tokens')}, 0.9)")} END AS role_fit,
    CASE WHEN years <= 0 THEN 0.45::DOUBLE
      WHEN coalesce(min_years, 0) <= 0 THEN {clamp('0.30 + 0.70 * ' + soft('years', 8))}
      WHEN years >= min_years THEN {clamp('0.74 + 0.26 * ' + soft('(years - min_years)', 6))}
      ELSE {clamp('0.74 * pow(years / min_years, 1.45)')} END AS experience_score,
    CASE WHEN level = '' THEN {clamp('0.35 + 0.65 * ' + soft('y0', 8))}
      WHEN {contains_any('level', C.SENIOR_WORDS)} THEN {clamp('0.28 * (CASE WHEN ' + contains_any('lower(titles)', C.SENIOR_WORDS) + ' THEN 1.0 ELSE 0.0 END) + 0.72 * ' + soft('y0', 7))}
      WHEN {contains_any('level', C.JUNIOR_WORDS)} THEN {clamp('1.0 - least(0.55::DOUBLE, greatest(0.0::DOUBLE, y0 - 4.0) / 12.0)')}
      ELSE {dens('sen_s')} END AS seniority_score,
    CASE WHEN len(history) = 0 THEN {clamp('0.45 + 0.35 * ' + soft('n_tokens', 160))}
      ELSE {clamp(f"0.72 * {clamp('0.35 + 0.65 * ' + soft('list_avg(list_transform(history, lambda ha: ha.duration_months::DOUBLE))', 30))} + 0.28 * (CASE WHEN title <> '' AND contains(lower(array_to_string(list_transform(current_jobs, lambda hd: hd.title), ' ')), lower(title)) THEN 1.0 ELSE 0.72 END)")} END AS career_score,
    CASE WHEN has_signals THEN {_BEHAVIOR} ELSE 0.55::DOUBLE END AS behavioral_score,
    CASE WHEN has_signals THEN {_AVAILABLE} WHEN available THEN 0.65::DOUBLE ELSE 0.48::DOUBLE END AS availability_score,
    CASE WHEN education_text = '' THEN 0.48::DOUBLE ELSE {clamp(
      f"(CASE WHEN len(edu_texts) > 0 THEN {dens('edu_s')} ELSE 0.55 END)"
      " + (CASE WHEN contains(lower(education_text), 'tier_1') THEN 0.25 WHEN contains(lower(education_text), 'tier_2') THEN 0.16 WHEN contains(lower(education_text), 'tier_3') THEN 0.08 ELSE 0.0 END)"
      f" + (CASE WHEN regexp_matches(lower(education_text), '{_DEGREE}') THEN 0.10 ELSE 0.0 END)")} END AS education_score,
    CASE WHEN len(loc_texts) = 0 THEN 0.68::DOUBLE WHEN has_signals AND relocate THEN greatest({dens('loc_s')}, 0.72) ELSE {dens('loc_s')} END AS location_score,
    {clamp(f"(1.0 - least(0.62::DOUBLE, 0.16 * len(integrity_flags))) * (0.86 + 0.14 * {soft('n_tokens', 180)})")} AS integrity_score,
    {clamp(f"((CASE WHEN has_profile THEN 1.0 ELSE 0.0 END) + {soft('len(skills)', 12)} + {soft('len(history)', 4)} + {soft('education_count', 2)} + {soft('n_tokens', 220)} + {soft('signal_keys', 18)}) / 6.0")} AS evidence_confidence
  FROM feat0),
feat2 AS (
  SELECT *, 2 * lexical_relevance - 1 AS retrieval, {clamp('(2 * lexical_relevance - 1 + 1.0) / 2.0')} AS semantic_match,
    CASE WHEN len(required) = 0 THEN 0.58::DOUBLE ELSE {clamp('list_avg(required_scores)')} END AS required_coverage,
    CASE WHEN len(preferred) = 0 THEN 0.55::DOUBLE ELSE {clamp('list_avg(preferred_scores)')} END AS preferred_coverage,
    CASE WHEN len(all_scores) > 0 THEN {clamp('list_avg(all_scores)')} WHEN len(evidence) > 0 THEN {_depth('evidence')} ELSE 0.35::DOUBLE END AS skill_overlap_score,
    CASE WHEN len(evidence) > 0 THEN {_depth('evidence')} WHEN len(all_scores) = 0 THEN 0.45::DOUBLE ELSE {soft('n_present', 8)} END AS skill_depth
  FROM feat1),
feat3 AS (
  SELECT *, 0.42 * required_coverage + 0.20 * preferred_coverage + 0.18 * skill_depth + 0.12 * production_score + 0.08 * lexical_relevance AS technical_fit,
    0.38 * role_fit + 0.24 * semantic_match + 0.20 * experience_score + 0.10 * seniority_score + 0.08 * career_score AS role_relevance,
    0.30 * behavioral_score + 0.23 * availability_score + 0.18 * location_score + 0.16 * education_score + 0.13 * evidence_confidence AS hireability,
    0.52 * required_coverage + 0.22 * role_fit + 0.16 * experience_score + 0.10 * integrity_score AS must_have_gate
  FROM feat2),
scored AS (
  SELECT *, round({clamp('(0.55 * technical_fit + 0.32 * role_relevance + 0.13 * hireability) * (0.70 + 0.30 * must_have_gate) * (0.84 + 0.16 * integrity_score)')} * 100, 4) AS composite_score
  FROM feat3)
"""

_SOURCE = {
    "skill_overlap": "skill_overlap_score",
    "required_skill_coverage": "required_coverage",
    "preferred_skill_coverage": "preferred_coverage",
    "relevant_experience": "experience_score",
    "production_experience_signals": "production_score",
    "seniority_match": "seniority_score",
    "career_progression": "career_score",
    "career_consistency": "career_score",
    "behavioral_signals": "behavioral_score",
    "availability": "availability_score",
    "education_relevance": "education_score",
    "location_match": "location_score",
    "fraud_detection": "integrity_score",
    "consistency_analysis": "career_score",
}


def _feature(name: str) -> str:
    return _SOURCE.get(name, name)


def _picked(terms: str, scores: str, rule: str) -> str:
    return (
        f"list_transform(list_filter(list_zip({terms}, {scores}), lambda zp: zp[2] {rule}), lambda zq: zq[1].term)"
    )


_STRENGTH_CASES = ", ".join(
    f"CASE WHEN {_feature(n)} >= 0.72 THEN '{C.STRENGTH_LABELS[n]}' END" for n in C.BREAKDOWN if n in C.STRENGTH_LABELS
)
_CONCERN_CASES = ", ".join(
    f"CASE WHEN {_feature(n)} <= 0.32 THEN '{label}' END" for n, label in C.CONCERN_LABELS.items()
)
_NOT_NULL = "lambda nn: nn IS NOT NULL"

DETAILS = f"""
det0 AS (
  SELECT *, {", ".join(f"round({_feature(n)} * 100, 2) AS b_{n}" for n in C.BREAKDOWN)},
    {_picked('list_concat(required, preferred)', 'all_scores', '>= 0.52')} AS matched,
    {_picked('list_concat(required, preferred)', 'all_scores', '< 0.42')} AS missing,
    {_picked('required', 'required_scores', '< 0.42')} AS missing_required
  FROM scored),
det AS (
  SELECT *, list_slice(list_filter([CASE WHEN len(matched) > 0 THEN 'Matches ' || len(matched) || ' desired skills' END, {_STRENGTH_CASES}], {_NOT_NULL}), 1, 7) AS strengths,
    list_slice(list_concat(list_transform(list_slice(missing_required, 1, 4), lambda mr: 'Missing required skill: ' || mr), integrity_flags,
      list_filter([{_CONCERN_CASES}], {_NOT_NULL})), 1, 8) AS concerns
  FROM det0)
"""


def _label(x: str) -> str:
    return f"regexp_replace(trim({x}), '^(strong|expert|advanced|excellent)\\s+', '', 'i')"


def canonical(x: str) -> str:
    bare = f"regexp_replace(lower({_label(x)}), '\\b(experience|hands-on|designing|production|with|based|systems|infrastructure)\\b', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({bare}, '[^a-z0-9+#.]+', ' ', 'g'), ' +', ' ', 'g'))"


_AI = contains_any("lower(sa.name)", C.AI_KEYWORDS)
_SORT_KEY = (
    "{'lv': CASE lower(so.proficiency) WHEN 'expert' THEN 4 WHEN 'advanced' THEN 3 WHEN 'intermediate' THEN 2 WHEN 'beginner' THEN 1 ELSE 0 END, "
    "'mo': so.duration_months, 'en': so.endorsements, 'ix': -ox, 'sk': so}"
)


def _sorted(skills: str) -> str:
    return f"list_transform(list_sort(list_transform({skills}, lambda so, ox: {_SORT_KEY}), 'DESC'), lambda st: st.sk)"


REASONS = f"""
rs0 AS (
  SELECT *, list_filter(skills, lambda sc: len(list_filter(matched, lambda mx: contains({canonical('mx')}, {canonical('sc.name')}) OR contains({canonical('sc.name')}, {canonical('mx')}))) > 0) AS hit_skills
  FROM det),
rs1 AS (
  SELECT *, {_sorted('hit_skills')} AS hit_sorted, list_slice(CASE WHEN len(hit_skills) > 0 THEN {_sorted('hit_skills')} ELSE {_sorted('skills')} END, 1, 3) AS chosen,
    len(list_filter(skills, lambda sa: {_AI})) AS n_ai FROM rs0),
rs2 AS (
  SELECT *,
    CASE WHEN len(chosen) = 0 THEN '' ELSE
      (CASE WHEN len(hit_skills) > 0 THEN len(hit_skills) || ' matched JD skills' WHEN n_ai > 0 THEN n_ai || ' AI/data skills' ELSE 'top profile skills' END)
      || ': ' || array_to_string(list_transform(chosen, lambda cs: cs.name || ' (' || array_to_string(list_filter([cs.proficiency,
        CASE WHEN cs.duration_months >= 12 THEN cs.duration_months || ' mo' END, CASE WHEN cs.endorsements > 0 THEN cs.endorsements || ' endorsements' END], {_NOT_NULL}), ', ') || ')'), ', ') END AS skill_phrase,
    CASE WHEN NOT has_signals THEN '' ELSE array_to_string(list_slice(list_filter([CASE WHEN response_rate IS NOT NULL THEN 'response rate ' || printf('%.2f', response_rate) END,
      CASE WHEN notice IS NOT NULL THEN CAST(CAST(notice AS BIGINT) AS VARCHAR) || 'd notice' END,
      CASE WHEN github >= 0 THEN 'GitHub activity ' || printf('%.0f', github) || '/100' END], {_NOT_NULL}), 1, 3), ', ') END AS signal_phrase,
    CASE WHEN len(missing) = 0 THEN 'no major JD skill gaps flagged' ELSE 'gaps: ' || array_to_string(list_transform(list_slice(missing, 1, 2), lambda ml: {_label('ml')}), ', ') END AS gap_phrase,
    CASE WHEN profile_years IS NOT NULL THEN reason_title || ' with ' || printf('%.1f', profile_years) || ' yrs'
      WHEN reason_location <> '' THEN reason_title || ' with ' || reason_location ELSE reason_title END AS lead_phrase
  FROM rs1),
rs3 AS (
  SELECT *, array_to_string(list_filter([lead_phrase, skill_phrase, signal_phrase, gap_phrase], lambda ph: ph <> ''), '; ') || '.' AS evidence_reason,
    CASE WHEN len(matched) > 0 AND b_relevant_experience >= 75 THEN 'Candidate demonstrates strong ' || {_label('matched[1]')} || ' expertise and extensive professional experience.'
      WHEN len(matched) > 0 THEN 'Candidate demonstrates relevant ' || {_label('matched[1]')} || ' capability for this role.'
      ELSE '{C.OPENING_PARTIAL}' END AS opening,
    list_filter([CASE WHEN b_seniority_match >= 75 THEN '{C.STRENGTH_SENIOR}' END,
      CASE WHEN b_career_progression >= 75 THEN '{C.STRENGTH_CAREER}' END,
      CASE WHEN b_required_skill_coverage >= 70 OR b_skill_overlap >= 70 THEN '{C.STRENGTH_CORE}' END,
      CASE WHEN b_production_experience_signals >= 60 THEN '{C.STRENGTH_DELIVERY}' END,
      CASE WHEN len(matched) > 0 THEN 'Relevant skills include ' || array_to_string(list_slice(matched, 1, 5), ', ') END], {_NOT_NULL}) AS lead_strengths,
    list_transform(list_slice(missing, 1, 5), lambda mg: 'No evidence of ' || mg || ' experience') AS gone,
    list_transform(concerns, lambda cc: CASE WHEN starts_with(cc, 'Missing required skill: ') THEN 'No evidence of ' || replace(cc, 'Missing required skill: ', '') || ' experience' ELSE cc END) AS said
  FROM rs2),
rs4 AS (
  SELECT *, list_slice(list_concat(lead_strengths, list_filter(strengths, lambda ls: NOT list_contains(lead_strengths, ls) AND NOT contains(lower(ls), 'semantic'))), 1, 4) AS plus0,
    list_slice(list_concat(gone, list_filter(said, lambda sd: NOT list_contains(gone, sd))), 1, 4) AS minus0
  FROM rs3),
rs AS (
  SELECT *, opening || chr(10) || chr(10) || 'Key strengths:' || chr(10) || '- ' || array_to_string(CASE WHEN len(plus0) = 0 THEN ['{C.STRENGTH_NONE}'] ELSE plus0 END, chr(10) || '- ')
      || chr(10) || chr(10) || 'Potential concerns:' || chr(10) || '- ' || array_to_string(CASE WHEN len(minus0) = 0 THEN ['{C.CONCERN_NONE}'] ELSE minus0 END, chr(10) || '- ')
      || chr(10) || chr(10) || 'Overall assessment:' || chr(10) ||
      CASE WHEN composite_score >= 80 THEN '{C.OVERALL_80}' WHEN composite_score >= 70 THEN '{C.OVERALL_70}' WHEN composite_score >= 55 THEN '{C.OVERALL_55}' ELSE '{C.OVERALL_LOW}' END AS fallback_reason,
    row_number() OVER (PARTITION BY jd_id ORDER BY composite_score DESC, candidate_id) AS rank
  FROM rs4)
"""


def on_candidates(select: str, upto: str = "rs") -> str:
    """SQL that ends in ``select`` over one of: cand, prof, scored, det, rs."""
    parts = [CANDIDATES]
    if upto != "cand":
        parts.append(PROFILE_C)
    if upto in ("scored", "det", "rs"):
        parts += [jobs_cte(CANDIDATE_JOBS), SCORES]
    if upto in ("det", "rs"):
        parts.append(DETAILS)
    if upto == "rs":
        parts.append(REASONS)
    return "WITH " + ",\n".join(parts) + "\n" + select


def on_documents(select: str, upto: str = "rs", jobs: list[JobSpec] | None = None) -> str:
    parts = [PROFILE_D]
    if upto in ("scored", "det", "rs"):
        parts += [jobs_cte(jobs or [JD_DOC]), SCORES]
    if upto in ("det", "rs"):
        parts.append(DETAILS)
    if upto == "rs":
        parts.append(REASONS)
    return "WITH " + ",\n".join(parts) + "\n" + select
