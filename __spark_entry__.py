"""

Every query runs over whole tables. For matching, either every vector of ``embeddings``
is both a candidate and a job, or the ``documents`` are matched with the ``benchmark``
passages through the local hashing embedder.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank import schemas as S
from pairrank.functions.chunks import split_fixed, split_recursive
from pairrank.functions.text import clean_id, safe_id
from pairrank.functions.vectors import cosine
from pairrank.models.embedders import HashingEmbedder
from pairrank.models.patterns import PatternModel
from pairrank.operators import assignment, cleaning, membership, pruning, ranking, report, similarity, snapshots, statistics, store
from pairrank.operators.embedding import embed_both, embed_table
from pairrank.operators.extraction import PROMPTS, extract_fields, in_lanes, model_fields
from pairrank.plans.matching import match_tables, run_match
from pairrank.runtime import checkpoint_folder, materialise, ship, spread
from pairrank.sinks import save_results, write_csv, write_text_files, write_wide_matrix
from pairrank.sources.documents import with_text
from pairrank.sources.files import latest_file, list_files
from pairrank.sources.large_csv import read_large_csv, read_wide_matrix
from pairrank.sources.tables import read_csv, rows_as_text, with_position

# The training-data operators and their pipeline are one removable part of the library.
try:
    import corpus_pipeline
    from pairrank.llm import queries as llm
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "pairrank.llm"):
        raise
    LLM_QUERIES, LLM_SQL = {}, {}
else:
    LLM_QUERIES = {**llm.QUERIES, "pipeline": corpus_pipeline.run}
    LLM_SQL = llm.SQL if corpus_pipeline.ORACLE_SQL is None else {**llm.SQL, "pipeline": corpus_pipeline.ORACLE_SQL}

Query = Callable[[SparkSession, str], DataFrame]

# Scores are rounded before they are ranked, so that the order of summation cannot
# change a result.
DECIMALS = 6
THRESHOLD = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column, places: int = DECIMALS):
    return F.round(column, places) + F.lit(0.0)


def cells(df, *keys, outer=False):
    """One row per number of a vector; ``outer`` keeps a row without a vector."""
    numbers = (F.posexplode_outer if outer else F.posexplode)("embedding").alias("i", "v")
    return df.select(*keys, numbers).select(*keys, "i", r6("v").alias("v"))


# --- inputs -------------------------------------------------------------------


def vectors(spark, sf_dir):
    both = table(spark, sf_dir, "embeddings")
    return similarity.as_candidates(both, "vec_id", "vec_id"), similarity.as_jobs(both, "vec_id", "vec_id")


def hashed(spark, sf_dir, name, id):
    texts = spread(table(spark, sf_dir, name).select(id, "text"), id)
    return materialise(embed_table(texts, "text", HashingEmbedder()), name)


def label_means(spark, sf_dir):
    """The mean vector of each label."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = each.groupBy("label", "i").agg(F.avg("v").alias("v"))
    listed = F.array_sort(F.collect_list(F.struct("i", "v")))
    return means.groupBy("label").agg(listed.alias("l")).select("label", F.col("l.v").alias("mean"))


def label_jobs(spark, sf_dir):
    means = label_means(spark, sf_dir).withColumn("job", F.concat(F.lit("label_"), F.col("label")))
    return similarity.as_jobs(means, "job", "label", "mean")


def top_five(spark, sf_dir, decimals=DECIMALS):
    return ranking.top_matches(*vectors(spark, sf_dir), 5, decimals=decimals)


def labelled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def label_titles(people):
    """The job of each label, up to one more than a wide table may hold, which then raises."""
    limit = int(people.sparkSession.conf.get("spark.sql.pivotMaxValues", "10000")) + 1
    return [f"label_{r.label}" for r in people.select("label").distinct().orderBy("label").limit(limit).collect()]


def label_matrix(spark, sf_dir, decimals=DECIMALS):
    candidates, _ = vectors(spark, sf_dir)
    pairs = similarity.pair_similarity(candidates, label_jobs(spark, sf_dir), decimals=decimals)
    return similarity.to_matrix(pairs, label_titles(table(spark, sf_dir, "embeddings")))


# --- text operators -------------------------------------------------------------


def combine_columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    columns = ["p_name", "p_note", "p_brand", "p_type", "p_size"]
    return cleaning.combine_columns(part, columns, "combined").select("p_partkey", "combined")


def candidate_text(spark, sf_dir):
    people = labelled(spark, sf_dir).withColumnsRenamed({"quality": S.YEARS, "lang": S.DEGREE, "text": S.SUMMARY})
    return cleaning.candidate_text(people).select("doc_id", F.md5(S.CANDIDATE_TEXT).alias("text_md5"))


def job_text(spark, sf_dir):
    jobs = table(spark, sf_dir, "part").withColumnsRenamed(
        {"p_name": "Role", "p_type": "Description", "p_brand": "Degree", "p_size": "Years of Exp"}
    )
    return cleaning.job_text(jobs).select("p_partkey", F.col(S.JOB_TEXT))


def clean_text(spark, sf_dir):
    cleaned = cleaning.clean_text(table(spark, sf_dir, "documents"), ["text", "absent"])
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n"))


def fill_missing(spark, sf_dir):
    passages = table(spark, sf_dir, "benchmark").withColumnsRenamed({"item_id": "doc_id", "text": "passage"})
    joined = labelled(spark, sf_dir).select("doc_id", "quality", "toxic").join(passages, "doc_id", "left")
    return cleaning.fill_missing(joined)


def normalize_years(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    text = (
        F.when(F.col("p_type") == "ECONOMY", F.concat("p_size", F.lit(" years, then 3 yrs")))
        .when(F.col("p_type") == "STANDARD", F.concat("p_size", F.lit("+ YRS")))
        .when(F.col("p_type") == "PROMO", F.concat(F.lit("1."), F.col("p_size"), F.lit("\tyear")))
        .when(F.col("p_brand") < "Brand#2", F.concat("p_size", F.lit(" +")))
        .when(F.col("p_size") > 25, F.concat(F.lit(" "), F.col("p_retailprice").cast("decimal(12,2)")))
        .when(F.col("p_size") > 12, F.col("p_name"))
        .when(F.col("p_size") > 6, F.col("p_size").cast("string"))
    )
    return cleaning.normalize_years(part.select("p_partkey", text.alias("years")), "years").drop("years")


def split_rows(spark, sf_dir):
    return cleaning.split_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def chunk_fixed(spark, sf_dir):
    chunks = split_fixed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return chunks.withColumn("chunk", F.md5("chunk"))


def chunk_recursive(spark, sf_dir):
    return split_recursive(table(spark, sf_dir, "documents").select("doc_id", "text"), "text")


def safe_ids(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", safe_id(clean_id(F.col("url"))).alias("safe"))


def row_texts(spark, sf_dir):
    return rows_as_text(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))


def extract_rules(spark, sf_dir):
    text = F.col("text")
    fields = {
        "name": F.regexp_extract(text, r"(\p{Lu}\p{Ll}+)", 1),
        "years_of_experience": F.regexp_extract(text, r"([0-9]+)", 1),
        "degree": F.regexp_extract(text, r"@([\w.]+)", 1),
        # Every sentence with a digit; each is read from its beginning only.
        "experience_summary": F.md5(F.array_join(F.regexp_extract_all(text, F.lit(r"(?<![^.])[^.0-9]*+[0-9][^.]*+\."), F.lit(0)), "")),
    }
    documents = with_text(table(spark, sf_dir, "documents")).select("doc_id", "text")
    found = extract_fields(documents, "text", fields)
    return cleaning.rename_extracted(found).drop("text", "errors")


def display_candidates(spark, sf_dir):
    people = table(spark, sf_dir, "documents").withColumnsRenamed({"source": S.NAME, "lang": S.DEGREE})
    return report.candidate_listing(people)


# --- flags and categories ---------------------------------------------------------


def flag_membership(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return membership.flag_members(documents, table(spark, sf_dir, "labels"), "doc_id")


def attach_status(spark, sf_dir):
    candidates, jobs = vectors(spark, sf_dir)
    flagged = membership.flag_members(candidates, table(spark, sf_dir, "labels"), "candidate_id")
    pairs = similarity.pairs_above(candidates, jobs, THRESHOLD, decimals=DECIMALS)
    return membership.attach_status(pairs, flagged).select("candidate_id", "job_id", "similarity", S.CONTINGENT)


def document_jobs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("job_position"))


def quality_categories(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return labels.select(F.col("doc_id").alias("job_id"), F.concat(F.lit("quality_"), "quality").alias("category"))


def category_axis(spark, sf_dir):
    axis = report.category_axis(document_jobs(spark, sf_dir), quality_categories(spark, sf_dir))
    return axis.select("job_id", "category", "x")


def category_spans(spark, sf_dir):
    return report.category_spans(
        report.category_axis(document_jobs(spark, sf_dir), quality_categories(spark, sf_dir))
    )


def category_heatmap(spark, sf_dir):
    both = table(spark, sf_dir, "embeddings")
    categories = both.select(F.col("vec_id").alias("job_id"), F.concat(F.lit("label_"), "label").alias("category"))
    cells, _ = report.category_heatmap(*vectors(spark, sf_dir), categories, decimals=DECIMALS)
    return cells


# --- similarity, ranking, assignment ------------------------------------------------


def pair_similarity(spark, sf_dir):
    pairs = similarity.pair_similarity(*vectors(spark, sf_dir), decimals=DECIMALS)
    return pairs.select("candidate_id", "job_id", "similarity")


def cosine_to_mean(spark, sf_dir):
    joined = table(spark, sf_dir, "embeddings").join(label_means(spark, sf_dir), "label")
    return joined.select("vec_id", "label", r6(cosine(F.col("embedding"), F.col("mean"))).alias("similarity"))


def mask_threshold(spark, sf_dir):
    return similarity.threshold_mask(pair_similarity(spark, sf_dir), THRESHOLD)


def filter_threshold(spark, sf_dir):
    pairs = similarity.pairs_above(*vectors(spark, sf_dir), THRESHOLD, decimals=DECIMALS)
    return pairs.select("candidate_id", "job_id", "similarity")


def pruned_threshold(spark, sf_dir):
    pairs = pruning.pairs_above(*vectors(spark, sf_dir), THRESHOLD, decimals=DECIMALS)
    return pairs.select("candidate_id", "job_id", "similarity")


def pruned_matches(spark, sf_dir):
    pairs = pruning.best_per_job(*vectors(spark, sf_dir), 5, decimals=DECIMALS)
    return ranking.as_match_table(ranking.rank_candidates(pairs, 5))


def positive_scores(spark, sf_dir):
    # The smallest positive number as the threshold; what is above 0 is counted where it is scored.
    kept = similarity.pairs_above(*vectors(spark, sf_dir), float(np.nextafter(0, 1)), counted=True, decimals=DECIMALS)
    return kept.groupBy("job_id").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n"))


def similarity_matrix(spark, sf_dir):
    return label_matrix(spark, sf_dir)


def matrix_listing(spark, sf_dir):
    return report.matrix_listing(label_matrix(spark, sf_dir, None))


def matrix_to_long(spark, sf_dir):
    return similarity.to_long(label_matrix(spark, sf_dir))


def heatmap_cells(spark, sf_dir):
    return report.heatmap_cells(*vectors(spark, sf_dir), decimals=DECIMALS)


def binned_heatmap(spark, sf_dir, **options):
    """All pairs of vectors as a grid of 20 x 15 cells."""
    return report.binned_heatmap(*vectors(spark, sf_dir), y_bins=20, x_bins=15, decimals=DECIMALS, **options)


def binned_heatmap_cells(spark, sf_dir):
    """The same through the grid of two large sides."""
    return binned_heatmap(spark, sf_dir, small_side_bytes=0)


def top_matches(spark, sf_dir):
    return ranking.as_match_table(top_five(spark, sf_dir))


def top_matches_head(spark, sf_dir):
    return ranking.as_match_table(ranking.first_matches(top_five(spark, sf_dir), 10))


def match_listing(spark, sf_dir):
    return report.match_listing(ranking.as_match_table(top_five(spark, sf_dir, None)))


def match_summary(spark, sf_dir):
    return statistics.match_summary(top_five(spark, sf_dir, None))


def ranking_summary(spark, sf_dir):
    summary = statistics.ranking_summary(top_five(spark, sf_dir))
    return summary.withColumn("avg_similarity", r6("avg_similarity", 8))


def versatile(spark, sf_dir):
    return statistics.versatile_candidates(top_five(spark, sf_dir))


def competitive(spark, sf_dir):
    jobs = statistics.competitive_jobs(top_five(spark, sf_dir))
    return jobs.withColumn("avg_similarity", r6("avg_similarity", 9))


def hash_embed(spark, sf_dir):
    embedded = hashed(spark, sf_dir, "documents", "doc_id")
    return embedded.select("doc_id", F.posexplode("embedding").alias("i", "v")).select("doc_id", "i", r6("v").alias("v"))


def embed_and_match(spark, sf_dir):
    documents = hashed(spark, sf_dir, "documents", "doc_id").withColumn("position", F.col("doc_id"))
    passages = hashed(spark, sf_dir, "benchmark", "item_id").withColumn("position", F.col("item_id"))
    return match_tables(documents, passages, "doc_id", "item_id", decimals=DECIMALS)["top_matches"]


def embed_texts_of_both(spark, sf_dir):
    people = labelled(spark, sf_dir).withColumnsRenamed({"quality": S.YEARS, "lang": S.DEGREE, "text": S.SUMMARY})
    jobs = table(spark, sf_dir, "part").withColumnsRenamed(
        {"p_name": "Role", "p_type": "Description", "p_brand": "Degree", "p_size": "Years of Exp"}
    )
    left, right = embed_both(people, jobs, HashingEmbedder())
    sides = [
        left.select(F.lit("candidate").alias("kind"), F.col("doc_id").alias("id"), "embedding"),
        right.select(F.lit("job").alias("kind"), F.col("p_partkey").alias("id"), "embedding"),
    ]
    both = sides[0].unionByName(sides[1])
    return cells(both, "kind", "id")


def greedy_assign(spark, sf_dir):
    """Every benchmark passage is a job, every document a candidate."""
    documents = similarity.as_candidates(hashed(spark, sf_dir, "documents", "doc_id"), "doc_id", "doc_id")
    passages = similarity.as_jobs(hashed(spark, sf_dir, "benchmark", "item_id"), "item_id", "item_id")
    return assignment.as_assignment_table(assignment.assign_best(documents, passages, 2, decimals=DECIMALS))


def assign_contested(spark, sf_dir):
    """The other way round, straight from vectors: far more jobs than the candidates can take."""
    passages = similarity.as_candidates(hashed(spark, sf_dir, "benchmark", "item_id"), "item_id", "item_id")
    documents = similarity.as_jobs(hashed(spark, sf_dir, "documents", "doc_id"), "doc_id", "doc_id")
    return assignment.as_assignment_table(assignment.assign_best(passages, documents, 2, decimals=DECIMALS))


def exact_copies(spark, sf_dir):
    """Every vector three times, under positions that mix the copies."""
    both = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    count = both.count()
    copies = both.withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).withColumn("at", F.col("copy") * count + F.col("vec_id"))
    return similarity.as_candidates(copies, "at", "at"), similarity.as_jobs(both, "vec_id", "vec_id")


def top_matches_exact(spark, sf_dir, **options):
    """Ranks over unrounded scores, where every candidate ties with its two copies."""
    ranked = ranking.top_matches(*exact_copies(spark, sf_dir), 3, **options)
    return ranked.select("job_id", "candidate_id", "rank")


def pair_similarity_cells(spark, sf_dir):
    pairs = similarity.pair_similarity(*vectors(spark, sf_dir), decimals=DECIMALS, small_side_bytes=0)
    return pairs.select("candidate_id", "job_id", "similarity")


# --- whole runs, from files to files ---


# Of a CSV file, before quotes: the task that writes it, and one that reads it whole, take no more.
CSV_BYTES = 64 << 20


def written_csv(df, key, path, files):
    """The table as CSV files by ranges of a key: at least ``files``, more where they would be too large for a task."""
    row_bytes = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)).cast("long") for c in df.columns), F.lit(0))
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    ranges = df.repartitionByRange(max(files, -(-size // CSV_BYTES)), key)
    return write_csv(ranges.sortWithinPartitions(key), path)


def written_listings(spark, sf_dir, folder):
    """The passages as a CSV of open positions."""
    listings = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("Role"), F.col("text").alias("Description"))
    return written_csv(listings, "Role", f"{folder}/listings.csv", 3)


def saved_matches(spark, paths):
    saved = read_csv(spark, paths["top_matches"])
    return saved.select(*(F.col(c).cast(t).alias(c) for c, t in (("Job", "long"), ("Candidate", "long"), ("Similarity", "double"), ("Rank", "int"))))


def match_files(spark, sf_dir):
    """All documents and passages as CSV files, matched by a whole run; the saved matches read back."""
    folder = f"{checkpoint_folder(spark)}/pairrank/run-{materialise_id()}"
    people = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(S.NAME), F.col("lang").alias(S.DEGREE), F.col("text").alias(S.SUMMARY))
    candidates = written_csv(people, S.NAME, f"{folder}/people.csv", 5)
    result = run_match(spark, HashingEmbedder(), written_listings(spark, sf_dir, folder), candidates,
                       folder=f"{folder}/out", decimals=DECIMALS, save_pairs=False)
    return saved_matches(spark, result["output_paths"])


def folder_run(spark, sf_dir):
    """Every document a text file, its fields asked of a model, then matched through a vector store."""
    folder = f"{checkpoint_folder(spark)}/pairrank/run-{materialise_id()}"
    texts = table(spark, sf_dir, "documents").select(F.concat_ws("\n", F.col("doc_id").cast("string"), "text").alias("value"))
    write_text_files(texts, f"{folder}/texts")
    patterns = {"name": r"[0-9]+", "years_of_experience": r"(?s)\n.*?([0-9]+)", "degree": r"@([A-Za-z0-9_.]+)",
                "experience_summary": r"(?s)\n(.*)"}
    model = PatternModel({PROMPTS[name]: pattern for name, pattern in patterns.items()})
    return folder, run_match(
        spark, HashingEmbedder(), written_listings(spark, sf_dir, folder), document_folder=f"{folder}/texts",
        fields=model_fields(model), store_path=f"{folder}/store", folder=f"{folder}/out", decimals=DECIMALS, save_pairs=False,
        document_options={"suffixes": [".txt"], "max_workers": 8})


def folder_match(spark, sf_dir):
    """The scores of the five best per position; files have no order, so equal scores tie between any of them."""
    _, result = folder_run(spark, sf_dir)
    return saved_matches(spark, result["output_paths"]).drop("Candidate")


def folder_candidates(spark, sf_dir):
    """What the model extracted, as the run saved it."""
    folder, _ = folder_run(spark, sf_dir)
    saved = read_csv(spark, f"{folder}/out/extracted_candidates.csv")
    summary = F.md5(F.regexp_replace(F.col(f"`{S.SUMMARY}`"), r"[ \t\n\r]+", "")).alias("summary_md5")
    return saved.select(F.col(f"`{S.NAME}`").alias("name"), F.col(f"`{S.YEARS}`").alias("years"), F.col(S.DEGREE).alias("degree"), summary)


def dashboard_tables(spark, sf_dir):
    """The dashboard's three tables, written and read back: heat-map cells, listed matches, listed candidates."""
    folder = f"{checkpoint_folder(spark)}/pairrank/dashboard-{materialise_id()}"
    people = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(S.NAME), F.col("label").cast("string").alias(S.DEGREE))
    written = report.dashboard(heatmap_cells(spark, sf_dir), top_five(spark, sf_dir, None), people, folder)
    saved = {name: spark.read.parquet(f"{folder}/{name}") for name in written}
    score = F.col("similarity").cast("double").alias("score")
    parts = [
        saved["similarity_heatmap"].select(F.lit("cell").alias("kind"), F.col("y").cast("long").alias("of"), F.col("x").cast("string").alias("with"), score),
        saved["top_matches_table"].select(F.lit("match"), F.col("Job").cast("long"), F.col("Candidate").cast("string"), score),
        saved["candidate_table"].select(F.lit("candidate"), F.col(f"`{S.NAME}`").cast("long"), F.col(S.DEGREE), F.lit(None).cast("double")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


# --- files ---


def csv_round_trip(spark, sf_dir):
    """All documents through several CSV files and back, numbered in file order."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = f"{checkpoint_folder(spark)}/pairrank/documents-{materialise_id()}"
    written_csv(documents, "doc_id", path, 5)
    return with_position(read_csv(spark, path)).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "position")


def csv_large_round_trip(spark, sf_dir):
    """The same through the reader that cuts quoted files by splits."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    path = f"{checkpoint_folder(spark)}/pairrank/documents-{materialise_id()}"
    written_csv(documents, "doc_id", path, 2)
    read = read_large_csv(spark, path, position="position")
    return read.select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "position")


def save_results_round_trip(spark, sf_dir):
    """Every vector scored against the label means, saved, and the wide CSV read back."""
    people = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    jobs = label_means(spark, sf_dir).withColumn("job", F.concat(F.lit("label_"), F.col("label")))
    titles = label_titles(people)
    candidates, _ = vectors(spark, sf_dir)
    pairs = similarity.pair_similarity(candidates, label_jobs(spark, sf_dir), decimals=DECIMALS)
    folder = f"{checkpoint_folder(spark)}/pairrank/results-{materialise_id()}"
    saved = save_results(people, jobs.withColumnRenamed("mean", "embedding"), pairs, folder, titles)
    listed = read_csv(spark, saved["candidates"]).select(F.col("vec_id").alias(S.NAME), "label")
    matrix = read_csv(spark, saved["similarity_matrix"]).select(S.NAME, *(F.col(t).cast("double").alias(t) for t in titles))
    return listed.join(matrix, S.NAME).withColumnRenamed(S.NAME, "name")


def wide_matrix_round_trip(spark, sf_dir):
    """Every vector a row and a column of the wide CSV, read back in long form."""
    people, jobs = vectors(spark, sf_dir)
    folder = f"{checkpoint_folder(spark)}/pairrank/wide-{materialise_id()}"
    pairs = materialise(similarity.pair_similarity(people, jobs, decimals=DECIMALS), "pairs")
    return read_wide_matrix(spark, write_wide_matrix(pairs, jobs, folder))


# --- vector store -----------------------------------------------------------------


def given_entries(spark, sf_dir):
    entries = store.as_entries(table(spark, sf_dir, "embeddings"), "candidate", "vec_id", "given")
    return entries.withColumns({
        "updated_at": F.lit("2024-01-01 00:00:00").cast("timestamp"), "embedding": F.col("embedding").cast("array<double>"),
    })


def store_lookup(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    found = store.load_vectors(documents, given_entries(spark, sf_dir), "candidate", "doc_id", "given")
    return cells(found, "doc_id", "needs_embedding", outer=True)


def store_point_lookup(spark, sf_dir):
    found = store.stored_vector(given_entries(spark, sf_dir), "candidate", "7")
    return cells(found, "entity_id")


def store_pending(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return store.pending(documents, given_entries(spark, sf_dir), "candidate", "doc_id", "given")


def store_counts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return statistics.store_counts(
        store.load_vectors(documents, given_entries(spark, sf_dir), "candidate", "doc_id", "given")
    )


def store_counts_observed(spark, sf_dir):
    """The same counts, taken by the job that writes the looked-up documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id")
    found = store.load_vectors(documents, given_entries(spark, sf_dir), "candidate", "doc_id", "given")
    observed, counts = statistics.observe_store_counts(found)
    materialise(observed, "looked-up")
    return spark.range(1).select(*(F.lit(counts.get.get(c, 0)).cast("long").alias(c) for c in ("loaded", "pending")))


def call_lanes(spark, sf_dir):
    """Documents dealt over 12 lanes of model calls: how many lanes, and whether they are as even as promised."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    dealt = in_lanes(texts, F.length("text"), 12, "doc_id").select(F.spark_partition_id().alias("lane"), F.length("text").alias("cost"))
    lanes = dealt.groupBy("lane").agg(F.sum("cost").alias("cost"), F.count("*").alias("n"), F.max("cost").alias("longest"))
    return lanes.agg(
        F.count("*").alias("lanes"), F.sum("cost").alias("cost"), F.sum("n").alias("n"),
        (F.max("cost") - F.min("cost") <= F.max("longest")).alias("even_cost"), (F.max("n") - F.min("n") <= 1).alias("even_rows"))


def store_upsert(spark, sf_dir):
    passages = embed_table(table(spark, sf_dir, "benchmark"), "text", HashingEmbedder())
    newer = store.as_entries(passages, "candidate", "item_id", "given").withColumn(
        "updated_at", F.lit("2024-01-02 00:00:00").cast("timestamp")
    )
    merged = store.upsert(given_entries(spark, sf_dir), newer)
    return cells(merged, "entity_id")


def store_round_trip(spark, sf_dir):
    """Documents embedded through a new store on disk, then embedded again from it."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{checkpoint_folder(spark)}/pairrank/store-{materialise_id()}"
    store.embed_with_store(documents, "candidate", "doc_id", "text", HashingEmbedder(), path)
    again = store.embed_with_store(documents, "candidate", "doc_id", "text", HashingEmbedder(), path)
    return cells(again, "doc_id")


def new_store(spark) -> str:
    return f"{checkpoint_folder(spark)}/pairrank/store-{materialise_id()}"


def benchmark_entries(spark, sf_dir):
    """Vectors of the benchmark's texts under ids that the given vectors have as well, one day later."""
    passages = embed_table(table(spark, sf_dir, "benchmark"), "text", HashingEmbedder())
    return store.as_entries(passages, "candidate", "item_id", "given").withColumn("updated_at", F.lit("2024-01-02 00:00:00").cast("timestamp"))


def snapshot_merge(spark, sf_dir):
    """The given vectors, then those of the benchmark merged in: the old version next to the new one."""
    path = new_store(spark)
    first = snapshots.merge(spark, given_entries(spark, sf_dir), path, buckets=16)
    old = snapshots.read_snapshot(spark, path)
    last = snapshots.merge(spark, benchmark_entries(spark, sf_dir), path)
    return cells(old, F.lit(first).alias("version"), "entity_id").unionByName(
        cells(snapshots.read_snapshot(spark, path), F.lit(last).alias("version"), "entity_id"))


def snapshot_lookup(spark, sf_dir):
    """Documents with the vector stored under their id, from a store that stays where it lies."""
    path = new_store(spark)
    snapshots.merge(spark, given_entries(spark, sf_dir), path, buckets=16)
    documents = table(spark, sf_dir, "documents").select("doc_id")
    return cells(snapshots.load_from_snapshot(documents, path, "candidate", "doc_id", "given"), "doc_id", "needs_embedding", outer=True)


def snapshot_embedding(spark, sf_dir):
    """The first half of the documents embedded by ranges of keys, then all of them: only the rest is embedded."""
    path = new_store(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    snapshots.embed_with_snapshots(documents.where("doc_id % 2 = 0"), "candidate", "doc_id", "text", HashingEmbedder(), path, buckets=16)
    again = snapshots.embed_with_snapshots(documents, "candidate", "doc_id", "text", HashingEmbedder(), path)
    return cells(again, "doc_id")


def materialise_id() -> str:
    import uuid

    return uuid.uuid4().hex


# --- files ------------------------------------------------------------------------


def files(spark, sf_dir):
    ship(spark)
    return list_files(spark, sf_dir, [".parquet", ".csv"]).select("name", "suffix", "length")


def newest_file(spark, sf_dir):
    return latest_file(spark, sf_dir, "*.parquet", return_path=False)


def entry(spark: SparkSession) -> DataFrame:
    """The five best candidates of every job, over the whole vector table."""
    return top_matches(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return {
        **LLM_QUERIES,
        "combine_columns": combine_columns,
        "candidate_text": candidate_text,
        "job_text": job_text,
        "clean_text": clean_text,
        "fill_missing": fill_missing,
        "normalize_years": normalize_years,
        "split_rows": split_rows,
        "chunk_fixed": chunk_fixed,
        "chunk_recursive": chunk_recursive,
        "safe_ids": safe_ids,
        "row_texts": row_texts,
        "extract_rules": extract_rules,
        "display_candidates": display_candidates,
        "flag_membership": flag_membership,
        "count_members": lambda spark, sf_dir: membership.count_members(flag_membership(spark, sf_dir)),
        "distinct_names": lambda spark, sf_dir: membership.distinct_names(
            table(spark, sf_dir, "documents").select("source")).withColumnRenamed("_member", "source"),
        "attach_status": attach_status,
        "job_categories": lambda spark, sf_dir: report.job_categories(
            document_jobs(spark, sf_dir).select("job_id"), quality_categories(spark, sf_dir)),
        "category_axis": category_axis,
        "category_spans": category_spans,
        "category_heatmap": category_heatmap,
        "pair_similarity": pair_similarity,
        "pair_similarity_cells": pair_similarity_cells,
        "top_matches_exact": top_matches_exact,
        "top_matches_cells": lambda spark, sf_dir: top_matches_exact(spark, sf_dir, small_side_bytes=0),
        "cosine_to_mean": cosine_to_mean,
        "mask_threshold": mask_threshold,
        "filter_threshold": filter_threshold,
        "pruned_threshold": pruned_threshold,
        "pruned_matches": pruned_matches,
        "positive_scores": positive_scores,
        "similarity_matrix": similarity_matrix,
        "matrix_listing": matrix_listing,
        "matrix_to_long": matrix_to_long,
        "heatmap_cells": heatmap_cells,
        "binned_heatmap": binned_heatmap,
        "binned_heatmap_cells": binned_heatmap_cells,
        "top_matches": top_matches,
        "top_matches_head": top_matches_head,
        "match_listing": match_listing,
        "match_summary": match_summary,
        "ranking_summary": ranking_summary,
        "versatile": versatile,
        "competitive": competitive,
        "hash_embed": hash_embed,
        "embed_and_match": embed_and_match,
        "embed_texts_of_both": embed_texts_of_both,
        "greedy_assign": greedy_assign,
        "assign_contested": assign_contested,
        "match_files": match_files,
        "folder_match": folder_match,
        "folder_candidates": folder_candidates,
        "dashboard_tables": dashboard_tables,
        "csv_round_trip": csv_round_trip,
        "csv_large_round_trip": csv_large_round_trip,
        "save_results_round_trip": save_results_round_trip,
        "wide_matrix_round_trip": wide_matrix_round_trip,
        "store_point_lookup": store_point_lookup,
        "store_lookup": store_lookup,
        "store_pending": store_pending,
        "store_counts": store_counts,
        "store_counts_observed": store_counts_observed,
        "call_lanes": call_lanes,
        "store_upsert": store_upsert,
        "store_round_trip": store_round_trip,
        "snapshot_merge": snapshot_merge,
        "snapshot_lookup": snapshot_lookup,
        "snapshot_embedding": snapshot_embedding,
        "list_files": files,
        "latest_file": newest_file,
    }


# --- the same in SQL --------------------------------------------------------------

WS = r"[\t-\r\x1c-\x1f\x85\p{Z}]"

PAIRS = """p AS (
  SELECT c.vec_id AS candidate_id, j.vec_id AS job_id,
         list_cosine_similarity(c.embedding::DOUBLE[], j.embedding::DOUBLE[]) AS exact,
         round(list_cosine_similarity(c.embedding::DOUBLE[], j.embedding::DOUBLE[]), 6) + 0.0 AS similarity
  FROM embeddings c CROSS JOIN embeddings j)"""

BINNED = f"""WITH {PAIRS}, o AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place, count(*) OVER () AS many FROM embeddings)
  SELECT c.place * 20 // c.many AS y, j.place * 15 // j.many AS x, count(*) AS n,
         sum(round(similarity * 1000000)::BIGINT)::DOUBLE / count(*) / 1000000.0::DOUBLE AS mean, max(similarity) AS highest
  FROM p JOIN o c ON c.vec_id = candidate_id JOIN o j ON j.vec_id = job_id GROUP BY ALL"""

FILE_ORDER = """SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, lang, source,
  row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents"""

RANKED = PAIRS + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, candidate_id) AS rank
  FROM p QUALIFY rank <= 5)"""

RANKED_EXACT = PAIRS + """, r AS (
  SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY exact DESC, candidate_id) AS rank
  FROM p QUALIFY rank <= 5)"""

MEANS = """d AS (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS a FROM embeddings, range(1, 65) t(i) GROUP BY label, i),
means AS (SELECT label, list(a ORDER BY i) AS mean FROM d GROUP BY label)"""

LABEL_PAIRS = MEANS + """, p AS (
  SELECT vec_id AS candidate_id, 'label_' || m.label AS job_id,
         list_cosine_similarity(embedding::DOUBLE[], mean) AS exact,
         round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) + 0.0 AS similarity
  FROM embeddings e CROSS JOIN means m)"""


# Every vector three times; of equal scores the lower position comes first.
EXACT_SQL = f"""WITH {PAIRS}, copies AS (
  SELECT job_id, c * (SELECT count(*) FROM embeddings) + candidate_id AS candidate_id, exact FROM p, range(3) t(c))
SELECT job_id, candidate_id, (row_number() OVER (PARTITION BY job_id ORDER BY exact DESC, candidate_id))::INTEGER AS rank
FROM copies QUALIFY rank <= 3"""


def hash_sql(name: str, source: str, id: str, text: str = "text") -> str:
    """CTEs ending in ``<name>(id, v)``: the hashing embedder over a table."""
    return f"""{name}_words AS (
  SELECT {id} AS id, unnest(string_split_regex(lower({text}), '{WS}+')) AS w FROM {source}),
{name}_counts AS (
  SELECT id, ('0x' || substring(md5(w), 1, 8))::BIGINT % 64 AS i,
         sum(CASE WHEN substring(md5(w), 9, 1) IN ('0','2','4','6','8','a','c','e') THEN 1 ELSE -1 END) AS n
  FROM {name}_words WHERE w <> '' GROUP BY 1, 2),
{name}_lengths AS (SELECT id, sqrt(sum(n * n)) AS len FROM {name}_counts GROUP BY id),
{name}_cells AS (
  SELECT s.{id} AS id, t.i, coalesce(n / CASE WHEN len = 0 THEN 1 ELSE len END, 0.0) AS x
  FROM {source} s CROSS JOIN range(0, 64) t(i)
  LEFT JOIN {name}_counts c ON c.id = s.{id} AND c.i = t.i LEFT JOIN {name}_lengths l ON l.id = s.{id}),
{name} AS (SELECT id, list(x::DOUBLE ORDER BY i) AS v FROM {name}_cells GROUP BY id)"""


def text_pairs_sql(candidates: str, jobs: str, text: str = "text") -> str:
    """CTEs ending in ``p``: documents and passages scored against each other."""
    ids = {"documents": "doc_id", "people": "doc_id", "benchmark": "item_id", "listings": "item_id"}
    return f"""{hash_sql('c', candidates, ids[candidates], text)}, {hash_sql('j', jobs, ids[jobs], text)},
p AS (SELECT c.id AS candidate_id, j.id AS job_id,
             round(coalesce(CASE WHEN isnan(list_cosine_similarity(c.v, j.v)) THEN 0 ELSE list_cosine_similarity(c.v, j.v) END, 0), 6) + 0.0 AS similarity
      FROM c CROSS JOIN j)"""


COUNTED = """SELECT count(vec_id) AS loaded, count(*) - count(vec_id) AS pending
    FROM documents LEFT JOIN embeddings ON vec_id = doc_id"""

# What the patterns of ``folder_run`` find in a document.
FOUND_YEARS = "coalesce(regexp_extract(text, '[0-9]+'), '')"
FOUND_DEGREE = "coalesce(regexp_extract(text, '@([A-Za-z0-9_.]+)', 1), '')"


def run_sql(person: str) -> str:
    """CTEs ending in ``best``: the five best people per listing, people read by the text ``person``."""
    return f"""WITH people AS (SELECT doc_id, {person} AS t FROM documents),
listings AS (SELECT item_id, item_id || ' ' || coalesce(nullif(text, ''), 'nan') AS t FROM benchmark),
{text_pairs_sql('people', 'listings', 't')},
best AS (SELECT *, (row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, candidate_id))::INTEGER AS rank FROM p QUALIFY rank <= 5)"""


def assign_sql(candidates: str, jobs: str) -> str:
    """The sequential rule: one best remaining pair per step."""
    return f"""WITH RECURSIVE {text_pairs_sql(candidates, jobs)},
e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY similarity DESC, job_id, candidate_id) AS i, * FROM p WHERE similarity > 0),
w AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS js, []::BIGINT[] AS cs
  UNION ALL
  SELECT e.i, list_append(w.js, e.job_id), list_append(w.cs, e.candidate_id)
  FROM (SELECT min(e.i) AS next FROM w JOIN e ON e.i > w.i
        WHERE NOT list_contains(w.js, e.job_id)
          AND len(list_filter(w.cs, lambda x: x = e.candidate_id)) < 2) n
  JOIN e ON e.i = n.next CROSS JOIN w)
SELECT e.job_id AS "Job", e.candidate_id AS "Candidate", e.similarity AS "Similarity" FROM w JOIN e USING (i)"""


def oracle_sql() -> dict[str, str]:
    text_of = lambda *columns: " || ' ' || ".join(f"coalesce({c}::VARCHAR, 'nan')" for c in columns)
    people = text_of("quality", "lang", "text")
    jobs = text_of("p_name", "p_type", "p_brand", "p_size") + " || '  '"
    return {
        **LLM_SQL,
        "combine_columns": f"""SELECT p_partkey, trim(regexp_replace({text_of('p_name', "''", 'p_brand', 'p_type', 'p_size')}, '{WS}+', ' ', 'g')) AS combined FROM part""",
        "candidate_text": f"SELECT doc_id, md5({people}) AS text_md5 FROM documents LEFT JOIN labels USING (doc_id)",
        "job_text": f"""SELECT p_partkey, coalesce(p_name, 'nan') || ' ' || coalesce(p_type, 'nan') || ' ' || coalesce(p_brand, 'nan')
            || ' ' || coalesce(p_size::VARCHAR, 'nan') || '  ' AS listing_to_embed FROM part""",
        "clean_text": f"""SELECT doc_id, md5(t) AS text_md5, length(t)::INTEGER AS n FROM (
            SELECT doc_id, trim(regexp_replace(coalesce(text, 'nan'), '{WS}+', ' ', 'g')) AS t FROM documents)""",
        "fill_missing": """SELECT d.doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic, coalesce(b.text, '') AS passage
            FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
        "normalize_years": f"""WITH t AS (
            SELECT p_partkey, lower(regexp_replace(coalesce(CASE
              WHEN p_type = 'ECONOMY' THEN p_size || ' years, then 3 yrs'
              WHEN p_type = 'STANDARD' THEN p_size || '+ YRS'
              WHEN p_type = 'PROMO' THEN '1.' || p_size || chr(9) || 'year'
              WHEN p_brand < 'Brand#2' THEN p_size || ' +'
              WHEN p_size > 25 THEN ' ' || p_retailprice::DECIMAL(12,2)
              WHEN p_size > 12 THEN p_name
              WHEN p_size > 6 THEN p_size::VARCHAR END, 'nan'), '^{WS}+|{WS}+$', '', 'g')) AS t FROM part)
            SELECT p_partkey, coalesce(
              {', '.join(f"try_cast(nullif(regexp_extract(t, '{p}', 1), '') AS DOUBLE)" for p in
                 [rf'([0-9]+){WS}*[+]?{WS}*years', rf'([0-9]+){WS}*[+]?{WS}*yrs', rf'([0-9]+){WS}*[+]?{WS}*year',
                  rf'([0-9]+){WS}*[+]?{WS}*yr', rf'([0-9]+){WS}*[+]', '^([0-9]+)$'])},
              CASE WHEN regexp_matches(t, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?$') THEN try_cast(t AS DOUBLE) END,
              0) AS years_numeric FROM t""",
        "split_rows": f"""SELECT doc_id, text FROM (
            SELECT doc_id, regexp_replace(unnest(string_split(coalesce(text, 'nan'), ',')), '^{WS}+|{WS}+$', '', 'g') AS text FROM documents)
            WHERE text <> ''""",
        "chunk_fixed": """SELECT doc_id, (s // 800)::INTEGER AS chunk_id, s::INTEGER AS start_index, md5(substring(text, s + 1, 1000)) AS chunk
            FROM (SELECT doc_id, text, unnest(generate_series(0, greatest(length(text) - 201, 0), 800)) AS s
                  FROM documents WHERE length(text) > 0)""",
        "safe_ids": f"SELECT page_id, regexp_replace(regexp_replace(coalesce(url, 'nan'), '^{WS}+|{WS}+$', '', 'g'), '[^\\p{{L}}\\p{{N}}]', '_', 'g') AS safe FROM pages",
        "row_texts": "SELECT to_json(struct_pack(p_partkey, p_name, p_brand, p_size))::VARCHAR AS text FROM part",
        "extract_rules": r"""SELECT doc_id, regexp_extract(text, '(\p{Lu}\p{Ll}+)', 1) AS "Name ",
            regexp_extract(text, '([0-9]+)', 1) AS "Years of experience ",
            regexp_extract(text, '@([\w.]+)', 1) AS "Degree",
            md5(array_to_string(regexp_extract_all(text, '[^.0-9]*[0-9][^.]*\.'), '')) AS "Resume Experience "
            FROM documents WHERE text <> ''""",
        "display_candidates": 'SELECT source AS "Name ", lang AS "Degree" FROM documents',
        "flag_membership": 'SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS "Contingent" FROM documents',
        "count_members": "SELECT count(*) AS members FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
        "distinct_names": "SELECT DISTINCT source FROM documents",
        "attach_status": f"""WITH {PAIRS} SELECT candidate_id, job_id, similarity,
            candidate_id IN (SELECT doc_id FROM labels) AS "Contingent" FROM p WHERE similarity >= 0.3""",
        "job_categories": """SELECT d.doc_id AS job_id, coalesce('quality_' || quality, 'Uncategorized') AS category
            FROM documents d LEFT JOIN labels USING (doc_id)""",
        "category_axis": """SELECT job_id, category, row_number() OVER (ORDER BY category, job_id) - 1 AS x FROM (
            SELECT d.doc_id AS job_id, coalesce('quality_' || quality, 'Uncategorized') AS category
            FROM documents d LEFT JOIN labels USING (doc_id))""",
        "category_spans": """SELECT category, min(x) AS start_x, max(x) AS end_x, (min(x) + max(x)) / 2.0 AS label_x FROM (
            SELECT category, row_number() OVER (ORDER BY category, job_id) - 1 AS x FROM (
            SELECT d.doc_id AS job_id, coalesce('quality_' || quality, 'Uncategorized') AS category
            FROM documents d LEFT JOIN labels USING (doc_id))) GROUP BY category""",
        "category_heatmap": f"""WITH {PAIRS},
            xs AS (SELECT vec_id, row_number() OVER (ORDER BY 'label_' || label, vec_id) - 1 AS x FROM embeddings),
            ys AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS y FROM embeddings)
            SELECT candidate_id, y, job_id, x, similarity FROM p
            JOIN xs ON xs.vec_id = job_id JOIN ys ON ys.vec_id = candidate_id""",
        "pair_similarity": f"WITH {PAIRS} SELECT candidate_id, job_id, similarity FROM p",
        "pair_similarity_cells": f"WITH {PAIRS} SELECT candidate_id, job_id, similarity FROM p",
        "top_matches_exact": EXACT_SQL,
        "top_matches_cells": EXACT_SQL,
        "cosine_to_mean": f"""WITH {MEANS} SELECT vec_id, label,
            round(list_cosine_similarity(embedding::DOUBLE[], mean), 6) + 0.0 AS similarity FROM embeddings JOIN means USING (label)""",
        "mask_threshold": f"WITH {PAIRS} SELECT candidate_id, job_id, CASE WHEN similarity >= 0.3 THEN similarity END AS similarity FROM p",
        "filter_threshold": f"WITH {PAIRS} SELECT candidate_id, job_id, similarity FROM p WHERE similarity >= 0.3",
        "pruned_threshold": f"WITH {PAIRS} SELECT candidate_id, job_id, similarity FROM p WHERE similarity >= 0.3",
        "pruned_matches": f"""WITH {RANKED} SELECT job_id AS "Job", candidate_id AS "Candidate", similarity AS "Similarity", rank::INTEGER AS "Rank" FROM r""",
        "positive_scores": f"WITH {PAIRS} SELECT job_id, count(*) AS n FROM p WHERE similarity > 0 GROUP BY job_id",
        "similarity_matrix": f"WITH {LABEL_PAIRS} SELECT candidate_id, "
            + ", ".join(f"max(CASE WHEN job_id = 'label_{i}' THEN similarity END) AS label_{i}" for i in range(10))
            + " FROM p GROUP BY candidate_id",
        "matrix_listing": f"WITH {LABEL_PAIRS} SELECT candidate_id, "
            + ", ".join(f"max(CASE WHEN job_id = 'label_{i}' THEN printf('%.2f', exact) END) AS label_{i}" for i in range(10))
            + " FROM p GROUP BY candidate_id",
        "matrix_to_long": f"WITH {LABEL_PAIRS} SELECT candidate_id, job_id, similarity FROM p",
        "heatmap_cells": f"""WITH {PAIRS}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)
            SELECT candidate_id, c.n AS y, job_id, j.n AS x, similarity FROM p
            JOIN o c ON c.vec_id = candidate_id JOIN o j ON j.vec_id = job_id""",
        "binned_heatmap": BINNED,
        "binned_heatmap_cells": BINNED,
        "top_matches": f"""WITH {RANKED} SELECT job_id AS "Job", candidate_id AS "Candidate", similarity AS "Similarity", rank::INTEGER AS "Rank" FROM r""",
        "top_matches_head": f"""WITH {RANKED} SELECT job_id AS "Job", candidate_id AS "Candidate", similarity AS "Similarity", rank::INTEGER AS "Rank"
            FROM r ORDER BY job_id, rank LIMIT 10""",
        "match_listing": f"""WITH {RANKED_EXACT} SELECT job_id AS "Job", candidate_id AS "Candidate", printf('%.3f', exact) AS "Similarity", rank::INTEGER AS "Rank" FROM r""",
        "match_summary": f"""WITH {RANKED_EXACT} SELECT job_id,
            string_agg('  ' || rank || '. ' || candidate_id || ' - Score: ' || printf('%.2f', exact), chr(10) ORDER BY rank) AS summary
            FROM r GROUP BY job_id""",
        "ranking_summary": f"""WITH {RANKED} SELECT count(DISTINCT candidate_id) AS unique_candidates, count(DISTINCT job_id) AS unique_jobs,
            round(avg(similarity), 8) AS avg_similarity FROM r""",
        "versatile": f"WITH {RANKED} SELECT candidate_id, count(*) AS n FROM r GROUP BY candidate_id HAVING count(*) > 1",
        "competitive": f"WITH {RANKED} SELECT job_id, round(avg(similarity), 9) AS avg_similarity FROM r GROUP BY job_id",
        "hash_embed": f"WITH {hash_sql('c', 'documents', 'doc_id')} SELECT id AS doc_id, i::INTEGER AS i, round(x, 6) + 0.0 AS v FROM c_cells",
        "embed_and_match": f"""WITH {text_pairs_sql('documents', 'benchmark')}
            SELECT job_id AS "Job", candidate_id AS "Candidate", similarity AS "Similarity",
            (row_number() OVER (PARTITION BY job_id ORDER BY similarity DESC, candidate_id))::INTEGER AS "Rank"
            FROM p QUALIFY "Rank" <= 5""",
        "embed_texts_of_both": f"""WITH people AS (SELECT doc_id, {people} AS t FROM documents LEFT JOIN labels USING (doc_id)),
            listings AS (SELECT p_partkey, {jobs} AS t FROM part),
            {hash_sql('c', 'people', 'doc_id', 't')}, {hash_sql('j', 'listings', 'p_partkey', 't')}
            SELECT kind, id, i::INTEGER AS i, round(x, 6) + 0.0 AS v
            FROM (SELECT 'candidate' AS kind, id, i, x FROM c_cells UNION ALL SELECT 'job', id, i, x FROM j_cells)""",
        "match_files": run_sql("coalesce(lang, 'nan') || ' ' || coalesce(nullif(text, ''), 'nan')") + """
            SELECT job_id AS "Job", candidate_id AS "Candidate", similarity AS "Similarity", rank AS "Rank" FROM best""",
        "folder_match": run_sql(f"{FOUND_YEARS} || ' ' || {FOUND_DEGREE} || ' ' || coalesce(text, '')") + """
            SELECT job_id AS "Job", similarity AS "Similarity", rank AS "Rank" FROM best""",
        "folder_candidates": f"""SELECT doc_id::VARCHAR AS name, nullif({FOUND_YEARS}, '') AS years, nullif({FOUND_DEGREE}, '') AS degree,
            md5(nullif(regexp_replace(coalesce(text, ''), '[ \t\n\r]+', '', 'g'), '')) AS summary_md5 FROM documents""",
        "dashboard_tables": f"""WITH {RANKED_EXACT}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)
            SELECT 'cell' AS kind, c.n AS "of", j.n::VARCHAR AS "with", similarity AS score FROM p
            JOIN o c ON c.vec_id = candidate_id JOIN o j ON j.vec_id = job_id
            UNION ALL SELECT 'match', job_id, candidate_id::VARCHAR, printf('%.3f', exact)::DOUBLE FROM r
            UNION ALL SELECT 'candidate', vec_id, label::VARCHAR, NULL FROM embeddings""",
        "greedy_assign": assign_sql("documents", "benchmark"),
        "assign_contested": assign_sql("benchmark", "documents"),
        "save_results_round_trip": f"WITH {LABEL_PAIRS} SELECT candidate_id::VARCHAR AS name, any_value(label)::VARCHAR AS label, "
            + ", ".join(f"max(CASE WHEN job_id = 'label_{i}' THEN similarity END) AS label_{i}" for i in range(10))
            + " FROM p JOIN embeddings ON vec_id = candidate_id GROUP BY candidate_id",
        "store_point_lookup": """SELECT vec_id::VARCHAR AS entity_id, unnest(range(len(embedding)))::INTEGER AS i,
            round(unnest(embedding)::DOUBLE, 6) + 0.0 AS v FROM embeddings WHERE vec_id = 7""",
        "csv_round_trip": FILE_ORDER,
        "csv_large_round_trip": FILE_ORDER,
        "wide_matrix_round_trip": f"""WITH {PAIRS}, o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings)
            SELECT place AS candidate_position, candidate_id::VARCHAR AS candidate_id, job_id::VARCHAR AS job_id, similarity
            FROM p JOIN o ON vec_id = candidate_id""",
        "store_lookup": """SELECT doc_id, vec_id IS NULL AS needs_embedding, i::INTEGER AS i, round(x, 6) + 0.0 AS v
            FROM documents LEFT JOIN (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) ON vec_id = doc_id""",
        "store_pending": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
        "store_counts_observed": COUNTED,
        "call_lanes": "SELECT 12::BIGINT AS lanes, sum(length(text))::BIGINT AS cost, count(*) AS n, true AS even_cost, true AS even_rows FROM documents",
        "store_counts": COUNTED,
        "store_upsert": f"""WITH {hash_sql('c', 'benchmark', 'item_id')},
            m AS (SELECT id, i, x FROM c_cells UNION ALL SELECT vec_id, unnest(range(len(embedding))), unnest(embedding)::DOUBLE FROM embeddings
                  WHERE vec_id NOT IN (SELECT item_id FROM benchmark))
            SELECT id::VARCHAR AS entity_id, i::INTEGER AS i, round(x, 6) + 0.0 AS v FROM m""",
        "store_round_trip": f"""WITH {hash_sql('c', 'documents', 'doc_id')}
            SELECT id AS doc_id, i::INTEGER AS i, round(x, 6) + 0.0 AS v FROM c_cells""",
        "snapshot_merge": f"""WITH {hash_sql('c', 'benchmark', 'item_id')},
            g AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
            m AS (SELECT 1 AS version, * FROM g UNION ALL SELECT 2, id, i, x FROM c_cells
                  UNION ALL SELECT 2, * FROM g WHERE vec_id NOT IN (SELECT item_id FROM benchmark))
            SELECT version::INTEGER AS version, vec_id::VARCHAR AS entity_id, i::INTEGER AS i, round(x, 6) + 0.0 AS v FROM m""",
        "snapshot_lookup": """SELECT doc_id, vec_id IS NULL AS needs_embedding, i::INTEGER AS i, round(x, 6) + 0.0 AS v
            FROM documents LEFT JOIN (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) ON vec_id = doc_id""",
        "snapshot_embedding": f"""WITH {hash_sql('c', 'documents', 'doc_id')}
            SELECT id AS doc_id, i::INTEGER AS i, round(x, 6) + 0.0 AS v FROM c_cells""",
    }
