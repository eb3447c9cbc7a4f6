"""Ranked results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodecat.fixed import terms
from lodecat.functions import classify, score
from lodecat.functions.parse import parse_score
from lodecat.functions.render import score_prompt
from lodecat.functions.text import join_text
from lodecat.operators.joins import with_answers
from lodecat.session import cut_lineage, spread


def best_first(df: DataFrame, value: str, n: int | None, tie: str = "gse_id") -> DataFrame:
    """Highest value first; with ``n`` Spark keeps only ``n`` rows per partition."""
    out = df.orderBy(F.col(value).desc(), F.col(tie))
    return out.limit(n) if n else out


def numbered(page: DataFrame, value: str, tie: str = "gse_id") -> DataFrame:
    """Rank column on a page that is already cut to a fixed number of rows."""
    return page.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col(value).desc(), F.col(tie))))


def rank(view: DataFrame, top_n: int = 50, weights: score.Weights = score.Weights()) -> DataFrame:
    """Weighted score times species weight, best ``top_n`` with rank."""
    scored = view.withColumn("total_score", score.total(
        weights, F.col("organism"), F.col("sample_count"), F.col("relevance_score"),
        F.col("recency_score"), F.col("quality_score")))
    return numbered(best_first(scored, "total_score", top_n), "total_score")


def bio_parts(records: DataFrame, query: str, as_of: date, compat: bool = False) -> DataFrame:
    """Records with the parts of the biology-aware score, which no profile changes."""
    c = F.col
    rows = spread(records).withColumn("_text", F.lower(join_text(c("title"), c("summary"))))
    return rows.withColumns({
        "s_relevance": score.term_relevance(c("title"), c("summary"), c("keywords"), query),
        "s_recency": score.recency_by_year(c("publication_date"), as_of),
        "s_quality": F.coalesce("quality_score", F.lit(0.5)),
        "s_sample_size": score.sample_log(c("sample_count")),
        "s_perturbation": score.perturbation_bonus(c("perturbation_types"), c("_text"), compat),
        "s_single_cell": score.single_cell_bonus(c("single_cell"), c("_text")),
        "s_assay": score.assay_bonus(c("data_type")),
        "s_organism": score.organism_bonus(c("organism")),
    }).drop("_text")


def bio_total(weights: score.BioWeights) -> Column:
    """Weighted parts plus the assay and organism bonuses, at most 1."""
    c = F.col
    return F.least(
        weights.relevance * c("s_relevance") + weights.recency * c("s_recency")
        + weights.quality * c("s_quality") + weights.sample_size * c("s_sample_size")
        + weights.perturbation * c("s_perturbation")
        + weights.single_cell * c("s_single_cell") + c("s_assay") + c("s_organism"),
        F.lit(1.0))


def bio_rank(records: DataFrame, query: str, as_of: date, profile: str = "default",
             top_n: int | None = None, compat: bool = False) -> DataFrame:
    """Records by the total of one profile, best first (T4)."""
    scored = bio_parts(records, query, as_of, compat).withColumn(
        "total_score", bio_total(score.BIO_PROFILES[profile]))
    return best_first(scored, "total_score", top_n)


def skip_reasons(view: DataFrame, floor: float = 0.05) -> DataFrame:
    """Why a record is not worth a scored look: bulk files, or too little relevance (F8)."""
    c = F.col
    rows = view.withColumns({
        "_names": classify.file_names(c("supplementary_files"), "name", "type"),
        "_low": F.lower(join_text(c("title"), c("summary"), c("overall_design")))})
    by_files = classify.file_format(c("supplementary_files"), c("_names"), c("platform"),
                                    c("_low"))["skip_reason"]
    reason = F.when(by_files != "", by_files).when(
        c("relevance_score") < floor,
        F.format_string(f"relevance %.2f < {floor}", c("relevance_score"))).otherwise("")
    return rows.withColumn("skip_reason", reason).drop("_names", "_low")


def to_score(candidates: DataFrame, top_k: int = 20, min_relevance: float = 0.0,
             score_all: bool = False) -> DataFrame:
    """Marks the rows that get a score: the first ``top_k`` relevant enough, or all.

    ``candidates`` is a cut result page.
    """
    fit = F.col("relevance_score") >= min_relevance
    place = F.row_number().over(Window.orderBy(
        F.when(fit, 0).otherwise(1), F.col("total_score").desc(), F.col("gse_id")))
    return candidates.withColumn("to_score", fit if score_all else fit & (place <= top_k))


Scorer = Callable[[list[str]], list[str | None]]


def no_scores(prompts: list[str]) -> list[str | None]:
    """The scorer for use without a model: no answer, so every relevance stays."""
    return [None] * len(prompts)


def _answers(score_fn: Scorer, prompts: list[str]) -> list[tuple[str | None, str | None]]:
    try:
        got = list(score_fn(prompts))
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} answers to {len(prompts)} prompts")
        return [(None if g is None else str(g), None) for g in got]
    except Exception as e:  # a model may fail in any way; the row says how
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        return [a for p in prompts for a in _answers(score_fn, [p])]


def score_with(rows: DataFrame, score_fn: Scorer, prompt: Column,
               batch_rows: int = 64) -> DataFrame:
    """(gse_id, text, error): the answer of a scorer to every row's prompt.

    The scorer runs in the tasks, on at most ``batch_rows`` prompts at a time.  A batch that
    fails is asked row by row; a row that fails alone has no text, but its error.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), batch_rows):
                part = f.iloc[at:at + batch_rows]
                text, error = zip(*_answers(score_fn, part["prompt"].tolist()), strict=True)
                yield pd.DataFrame({"gse_id": part["gse_id"].tolist(), "text": text, "error": error})

    return rows.select("gse_id", prompt.alias("prompt")).mapInPandas(
        run, "gse_id string, text string, error string")


def rerank(view: DataFrame, scores: DataFrame | Scorer, query: str, top_n: int = 50, top_k: int = 20,
           min_relevance: float = 0.0, score_all: bool = False,
           answers: DataFrame | None = None, floor: float = 0.05,
           prompt: Column | None = None) -> DataFrame:
    """Second look at a page three times as long as wanted.

    Cheap tests come first; ``scores`` (gse_id, text) replaces the relevance of the rows
    chosen for scoring, an unreadable score keeps it; then the total is weighted anew.  A
    function instead of a table is asked for the chosen rows alone (:func:`score_with`), with
    their ``prompt``, the facts of the record unless told otherwise.
    """
    page = rank(view, top_n * 3).drop("rank")
    fit = skip_reasons(page, floor).filter("skip_reason = ''")
    marked = to_score(fit, top_k, min_relevance, score_all)
    if callable(scores):
        marked = cut_lineage(marked)  # a page; the scorer must not run for it twice
        scores = cut_lineage(score_with(marked.filter("to_score"), scores, score_prompt(query)
                                        if prompt is None else prompt))
    joined = marked.join(scores.select("gse_id", F.col("text").alias("_score_text")), "gse_id",
                         "left")
    scored = F.when(F.col("to_score"), parse_score(F.col("_score_text")))
    again = joined.withColumn("relevance_score", F.coalesce(scored, "relevance_score")).withColumn(
        "total_score", score.total(
            score.RERANK_WEIGHTS, F.col("organism"), F.col("sample_count"),
            F.col("relevance_score"), F.col("recency_score"), F.col("quality_score"),
            terms.SPECIES_WEIGHTS)).drop("_score_text")
    out = numbered(best_first(again, "total_score", top_n), "total_score")
    return out if answers is None else with_answers(out, answers, ["gse_id"])


def cut(ranked: DataFrame, n: int | Column) -> DataFrame:
    return ranked.filter(F.col("rank") <= n)
