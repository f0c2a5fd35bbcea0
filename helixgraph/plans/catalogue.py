"""Importing this module registers all reference-domain queries."""

from ..sources.star import Star
from . import answer_queries, construction_queries, evaluation_queries, genetic_queries, gold_queries, graph_queries, question_queries  # noqa: F401
from .registry import register

register("answer_rouge_l", lambda spark, folder: evaluation_queries.answer_rouge_l(Star(spark, folder)))
register("answer_library_means", lambda spark, folder: evaluation_queries.answer_library_means(Star(spark, folder)))
