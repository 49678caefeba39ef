"""Rank large tables of semi-structured records against job descriptions with Spark."""

from rankloom.jobs import JobSpec
from rankloom.operators.schema_map import SchemaMap
from rankloom.plans.ranking import RankingResult, rank, rank_files

__all__ = ["JobSpec", "RankingResult", "SchemaMap", "rank", "rank_files"]
