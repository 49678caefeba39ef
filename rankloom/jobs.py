"""Job descriptions: the small structured side of every ranking.

A ``JobSpec`` is configuration, not data.  It is tokenised once on the driver and
enters the plan as one struct literal, so no record ever re-tokenises a job term.
"""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom import constants as C

_TERM = "struct<term:string,lowered:string,focus:array<string>,words:array<string>>"
COMPILED = (
    f"struct<jd_id:string,required:array<{_TERM}>,preferred:array<{_TERM}>,"
    "lexical:array<array<string>>,role:array<string>,production:array<array<string>>,"
    "education:array<array<string>>,has_education:boolean,"
    "locations:array<array<string>>,has_locations:boolean,"
    "level:string,seniority:array<array<string>>,min_years:double,vocabulary:array<string>,"
    "skill_words:array<string>>"
)
MAX_LITERAL_BYTES = 4 * 1024 * 1024


@dataclass(frozen=True)
class JobSpec:
    """Structured job description; every list may be empty."""

    jd_id: str = "job"
    title: str = ""
    seniority: str = ""
    required_skills: tuple[str, ...] = ()
    preferred_skills: tuple[str, ...] = ()
    responsibilities: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    education_keywords: tuple[str, ...] = ()
    experience_years_min: float | None = None
    production_signals: tuple[str, ...] = ()
    behavioral_signals: tuple[str, ...] = ()
    schema_notes: tuple[str, ...] = ()

    def as_dict(self) -> dict:
        years = self.experience_years_min
        return {**asdict(self), "experience_years_min": None if years is None else float(years)}


JOB_SCHEMA = T.StructType(
    [
        T.StructField(
            f.name,
            T.DoubleType()
            if f.name == "experience_years_min"
            else T.StringType()
            if f.name in ("jd_id", "title", "seniority")
            else T.ArrayType(T.StringType()),
        )
        for f in fields(JobSpec)
    ]
)


def jobs_from_frame(df: DataFrame) -> list[JobSpec]:
    """Job descriptions of a table, as configuration objects, fetched partition by partition.

    Ranking reads them in passes of bounded size; page a very large table by filtering it.
    """
    return [
        JobSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.asDict().items() if v is not None})
        for r in df.toLocalIterator()
    ]


def _distinct(items) -> list[str]:
    return list(dict.fromkeys(items))


def _words(text: str) -> list[str]:
    return _distinct(w.lower() for w in re.findall(C.TOKEN_PATTERN, text))


def _signal(text: str, generic: bool = True) -> list[str]:
    noise = set(C.STOPWORDS) if generic else {*C.STOPWORDS, *C.GENERIC_SKILL_WORDS}
    return [w for w in _words(text) if w not in noise]


def _density_terms(texts) -> list[list[str]]:
    return [t for t in map(_signal, texts) if t]


def _skill_terms(texts) -> list[dict]:
    tidy = (" ".join(t.split()) for t in texts)
    first = {}
    for t in tidy:
        if t:
            first.setdefault(t.lower(), t)
    return [
        {"term": t, "lowered": low, "focus": _signal(t, generic=False), "words": _words(low)}
        for low, t in first.items()
    ]


def _level(seniority: str) -> str:
    if not seniority:
        return "none"
    for name, markers in (("senior", C.SENIOR_WORDS), ("junior", C.JUNIOR_WORDS)):
        if any(m in seniority for m in markers):
            return name
    return "other"


def compiled(job: JobSpec) -> dict:
    """Token arrays of a job, in the layout of ``COMPILED``."""
    required, preferred = _skill_terms(job.required_skills), _skill_terms(job.preferred_skills)
    lexical = _density_terms(
        [*job.required_skills, *job.preferred_skills, job.title, *job.responsibilities[:8]]
    )
    role = _distinct(
        w for text in (job.title, job.seniority, *job.responsibilities[:6]) for w in _signal(text)
    )
    production = _density_terms([*job.production_signals, *C.PRODUCTION_TERMS])
    locations = _density_terms(job.locations)
    level = job.seniority.lower().strip()
    nested = [t["focus"] + t["words"] for t in required + preferred] + lexical + production + locations
    return {
        "jd_id": job.jd_id,
        "required": required,
        "preferred": preferred,
        "lexical": lexical,
        "role": role,
        "production": production,
        "education": _density_terms(job.education_keywords),
        "has_education": bool(job.education_keywords),
        "locations": locations,
        "has_locations": bool(job.locations),
        "level": _level(level),
        "seniority": _density_terms([level]),
        "min_years": None if job.experience_years_min is None else float(job.experience_years_min),
        # every token that is looked for in the full text, and in skill names
        "vocabulary": _distinct([w for group in nested for w in group] + role),
        "skill_words": _distinct(w for t in required + preferred for w in t["focus"]),
    }


def literal_sql(value, dtype: T.DataType) -> str:
    """Nested Python value as the SQL text of a literal of exactly the given type."""
    if value is None:
        return f"CAST(NULL AS {dtype.simpleString()})"
    if isinstance(dtype, T.ArrayType):
        items = ", ".join(literal_sql(v, dtype.elementType) for v in value)
        return f"CAST(array({items}) AS {dtype.simpleString()})"
    if isinstance(dtype, T.StructType):
        return "named_struct(" + ", ".join(f"'{f.name}', {literal_sql(value[f.name], f.dataType)}" for f in dtype) + ")"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return f"CAST({value} AS {dtype.simpleString()})"


def job_literal(job: JobSpec) -> Column:
    """One job as a struct literal, parsed once instead of built call by call."""
    return F.expr(literal_sql(compiled(job), T.DataType.fromDDL(COMPILED)))


def job_batches(jobs: list[JobSpec]) -> list[list[JobSpec]]:
    """Split a job list so that the literal of each batch stays below the size bound."""
    batches: list[list[JobSpec]] = []
    room = 0
    for job in jobs:
        size = len(repr(compiled(job)))
        if not batches or size > room:
            batches.append([])
            room = MAX_LITERAL_BYTES
        batches[-1].append(job)
        room -= size
    return batches


def with_jobs(df: DataFrame, jobs: list[JobSpec], column: str = "jd") -> DataFrame:
    """Attach every job of one batch to every record.

    One job is a constant column.  Several jobs are an exploded array literal inside
    the scan stage: no join, no shuffle, nothing shipped but the plan.
    """
    if len(jobs) == 1:
        return df.withColumn(column, job_literal(jobs[0]))
    return df.withColumn(column, F.explode(F.array(*[job_literal(j) for j in jobs])))
