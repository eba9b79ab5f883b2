"""The whole batch: one plan per step, checkpointed between steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from byline.functions.text import fingerprint, strip
from byline.operators.admission import admit_batch, cached_records
from byline.operators.affiliations import map_numbers, resolve_affiliation_maps, with_entries
from byline.operators.author_text import extract_author_markers
from byline.operators.decisions import decide_authors, paper_author_rows, paper_statuses
from byline.operators.fusion import (enrich_registry, evidence_scores, fuse_registry_vision,
                                     hover_complete, merge_hover, normalise_authors,
                                     usable_meta_institutions)
from byline.operators.keywords import papers_with_school, school_keywords, with_school_hit
from byline.operators.linkage import link_authors
from byline.operators.memory import memory_signals
from byline.operators.publish import publish
from byline.schemas import EVIDENCE_COLUMNS
from byline.session import cut_lineage
from byline.sources.pages import sidecar_authors, tooltip_text
from byline.sources.works import (openalex_authors, openalex_names, registry_authors, registry_names,
                                  registry_papers)


@dataclass
class BatchInputs:
    """Landed inputs of a batch; see ``byline.schemas`` for the columns."""
    requests: DataFrame          # input_pos, doi
    works: DataFrame             # registry works
    openalex: DataFrame          # OpenAlex works
    page_sidecars: DataFrame
    ocr_sidecars: DataFrame
    faculty: DataFrame
    papers: DataFrame
    paper_authors: DataFrame
    memory: DataFrame
    strategy: str = "SKIP"
    school_words: str = ""


@dataclass
class BatchResult:
    actions: DataFrame           # one row per request
    papers: DataFrame            # doi, title, journal, publish_date, status
    paper_authors: DataFrame
    fused: DataFrame             # all fused authors with their decision
    cached: DataFrame            # stored papers that answer requests without work


def adjudicate(registry: DataFrame, vision: DataFrame, texts: DataFrame, papers: DataFrame,
               faculty: DataFrame, memory: DataFrame, school_words: str = "",
               failed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Fuse, link and decide; returns (decided authors, paper statuses)."""
    fused = fuse_registry_vision(registry, vision)
    scored = cut_lineage(evidence_scores(fused, registry, vision))
    keywords = school_keywords(faculty, school_words)
    hits = with_school_hit(scored, keywords, ["doi", "pos"])
    linked = cut_lineage(link_authors(cut_lineage(hits), faculty))
    tokens = texts.select("doi", fingerprint(F.col("text")).alias("tokens"))
    linked = (linked.join(memory_signals(tokens, memory), "doi", "left")
              .na.fill(0, ["memory_hint_count"]).na.fill(0.0, ["memory_top_score"]))
    decided = cut_lineage(decide_authors(linked, faculty))
    school = papers_with_school(registry, keywords)
    statuses = (paper_statuses(decided, papers, failed).join(school, "doi", "left")
                .withColumn("has_school_aff", F.coalesce("has_school_aff", F.lit(False))))
    return decided, statuses


def vision_evidence(ocr: DataFrame, hover: DataFrame, registry: DataFrame, names: DataFrame,
                    pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vision authors, texts) of the papers: recognised text, unless the page suffices."""
    complete = hover_complete(hover, registry).where("complete").select("doi")
    meta = (pages.select("doi", usable_meta_institutions(
        F.col("meta.citation_author_institution")).alias("institutions")).where("institutions IS NOT NULL"))
    # a blank recognised text is no text: tooltips may stand in for it
    texts = (ocr.select("doi", F.col("ocr_text").alias("text")).where(F.length(F.trim("text")) > 0)
             .join(complete, "doi", "left_anti"))
    tips = tooltip_text(pages).join(texts.select("doi"), "doi", "left_anti")
    # the affiliation lists are read once, for the authors' numbers and for the maps
    every = cut_lineage(with_entries(texts.withColumn("recognised", F.lit(True)).unionByName(tips.withColumn("recognised", F.lit(False)))))
    read = normalise_authors(extract_author_markers(every.where("recognised").drop("recognised"), names, meta)).select(EVIDENCE_COLUMNS)
    vision = cut_lineage(merge_hover(cut_lineage(read), hover))
    maps = resolve_affiliation_maps(
        texts.sparkSession.createDataFrame([], "doi STRING, num INT, affiliation STRING"), every.drop("recognised"), meta)
    return cut_lineage(map_numbers(vision, maps).select(EVIDENCE_COLUMNS)), every.select("doi", "text")


def run_batch(inputs: BatchInputs) -> BatchResult:
    """Admission, flattening, text extraction, fusion, linking and decisions.

    Author tables that several later steps read are checkpointed once (see
    ``cut_lineage``), so no step is computed twice and a lost executor costs one step.
    DOIs without a landed work end as ERROR.
    """
    actions = admit_batch(inputs.requests, inputs.papers, inputs.strategy)
    todo = actions.where("action = 'process'").select("doi").distinct()

    def due(df):
        return df.join(todo, "doi", "left_semi")

    works, alex = due(inputs.works), due(inputs.openalex)
    meta = registry_papers(works, alex)
    registry = cut_lineage(enrich_registry(registry_authors(works), openalex_authors(alex).join(
        works.select("doi"), "doi", "left_semi")))
    pages = due(inputs.page_sidecars)
    names = (registry_names(works).join(openalex_names(alex).withColumnRenamed("names", "_oa"), "doi", "left")
             .select("doi", F.when(F.size("names") > 0, F.col("names")).otherwise(F.col("_oa")).alias("names")))
    vision, texts = vision_evidence(due(inputs.ocr_sidecars), sidecar_authors(pages), registry, names, pages)
    landed = works.select("doi").distinct()
    vision = vision.join(landed, "doi", "left_semi")
    failed = todo.join(landed, "doi", "left_anti")
    decided, statuses = adjudicate(registry, vision, texts, todo, inputs.faculty, inputs.memory,
                                   inputs.school_words, failed)
    papers = statuses.join(meta, "doi", "left").select(
        "doi", strip("title").alias("title"), "journal", "publish_date", "status", "has_school_aff")
    answered = inputs.papers.join(actions.where("action = 'skip_cached'").select("doi").distinct(), "doi", "left_semi")
    return BatchResult(actions, papers, paper_author_rows(decided), decided, cached_records(answered, inputs.paper_authors))


def publish_batch(result: BatchResult, root: str, batch: str) -> bool:
    """Make a batch's papers and authors current in the tables under ``root``; see ``publish``.

    Papers that were processed lose the authors they had, whatever the outcome: with OVERWRITE a failed paper keeps none.
    """
    done = result.actions.where("action = 'process'").select("doi").distinct()
    return publish(root, batch, result.papers.select("doi", "title", "journal", "publish_date", "status"), result.paper_authors, done)
