"""Benchmark decontamination through a distributed positional inverted index.

The index holds the postings (term, document, word position) of the corpus. A window is
a run of consecutive words of a benchmark item. Its two rarest terms, by their counts in
the whole corpus, are looked up; their position lists, each shifted by the term's offset
in the item, are intersected, rarest first. What both lists agree on is an alignment of
an item with a document; only those few are compared word by word, which settles exact
phrase matches. Lists that miss each other by a few words are proximity matches.

Postings are kept only for the terms that some window looks up: which those are is known
once the corpus counts are. Frequent words are therefore neither shuffled nor stored
unless an item has nothing rarer.

The two passes over the corpus explode its words and join them with the benchmark's
terms without a shuffle, as long as the benchmark stays below a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairrank.llm.expressions import let, lower_ascii, pick
from pairrank.runtime import materialise

# Fixed value: what separates words once A-Z are lower case (all of ASCII but a-z and 0-9).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SLACK = 5
# A table of the benchmark with more rows is not broadcast; the joins then shuffle.
BROADCAST_ROWS = 500_000


def terms(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), lambda w: w != "")


def bounded(table: DataFrame) -> DataFrame:
    """Marked for broadcast if it has at most ``BROADCAST_ROWS`` rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def phrases_of(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Each different word sequence once: phrase (its hash), its words and its items' ids."""
    items = pick(benchmark, item=item_id, text=text).where("item IS NOT NULL").select("item", terms(F.col("text")).alias("words"))
    return (
        items.where(F.size("words") > 0).groupBy("words").agg(F.collect_set("item").alias("items"))
        .select(F.xxhash64("words").alias("phrase"), "words", "items")
    )


def named(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, doc and text per row.

    ``doc`` only proposes candidates, which are then compared with the row's own words, so
    two rows with an equal hash do no harm.
    """
    return pick(documents, doc_id=doc_id, text=text).withColumn("doc", F.xxhash64("doc_id", "text"))


def split_up(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "doc", terms(F.col("text")).alias("words"))


def hashed(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def lookups(corpus: DataFrame, phrases: DataFrame, window: int) -> DataFrame:
    """What to look up: phrase, its positions q1 and q2, and a row per side with that term and its position q.

    q1 and q2 are the positions of the rarest and the second rarest term of a window; a
    window with a term that the corpus lacks cannot occur and is left out.
    """
    placed = phrases.select("phrase", F.posexplode(hashed("words")).alias("q", "term"))
    vocabulary = bounded(placed.select("term").distinct())
    counts = corpus.select(F.explode(hashed("words")).alias("term")).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
    counts = materialise(counts, "term-counts")
    rare = (
        placed.join(counts, "term", "left").groupBy("phrase")
        .agg(F.array_sort(F.collect_list(F.struct("q", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("at"))
    )
    length = F.least(F.lit(window), F.size("at"))

    def two_rarest(start: Column) -> Column:
        by_count = F.sort_array(F.transform(F.slice("at", start + 1, length), lambda x: F.struct(x["n"], x["q"], x["term"])))
        return let(by_count, lambda s: F.when(s[0]["n"] > 0, F.struct(
            s[0].alias("a"), F.coalesce(F.get(s, F.lit(1)), s[0]).alias("b"))))

    windows = F.transform(F.sequence(F.lit(0), F.size("at") - length), two_rarest)
    pairs = F.array_distinct(F.filter(windows, lambda p: p.isNotNull()))
    one = rare.select("phrase", F.explode(pairs).alias("p"))
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(f"p.{s}.q").alias("q"), F.col(f"p.{s}.term").alias("term"))
                                for i, s in ((1, "a"), (2, "b")))))
    return one.select("phrase", F.col("p.a.q").alias("q1"), F.col("p.b.q").alias("q2"), sides.alias("s")).select("phrase", "q1", "q2", "s.*")


def postings(corpus: DataFrame, wanted: DataFrame) -> DataFrame:
    """The index: term, doc and position of every occurrence of a wanted term, as a written table."""
    listed = bounded(wanted.select("term").distinct())
    placed = corpus.select("doc", F.posexplode(hashed("words")).alias("position", "term"))
    return materialise(placed.join(listed, "term"), "postings")


def alignments(index: DataFrame, wanted: DataFrame, slack: int) -> DataFrame:
    """doc, phrase, shift (document position of the phrase's first word) and ``near``.

    ``near`` is null where both lists agree; else the number of words, up to ``slack``, by
    which the second term is off. Lists meet per document and look-up, so none is longer
    than a document.
    """
    shifted = index.join(bounded(wanted), "term").select(
        "doc", "phrase", "q1", "q2", "side", (F.col("position") - F.col("q")).alias("shift"))
    lists = Window.partitionBy("doc", "phrase", "q1", "q2").orderBy("shift", "side")
    merged = shifted.withColumns({"other": F.lag("side").over(lists), "gap": F.col("shift") - F.lag("shift").over(lists)})
    met = merged.where((F.col("side") != F.col("other")) & (F.col("gap") <= slack))
    return met.groupBy("doc", "phrase", "shift").agg(F.min("gap").alias("gap")).select(
        "doc", "phrase", "shift", F.when(F.col("gap") > 0, F.col("gap")).alias("near"))


def phrase_starts(words: Column, phrase: Column, shift: Column, window: int) -> Column:
    """The phrase positions at which a whole window equals the document's words."""
    length = F.least(F.lit(window), F.size(phrase))
    equal = F.transform(phrase, lambda w, j: F.coalesce(F.get(words, shift + j) == w, F.lit(False)))
    return let(equal, lambda e: F.filter(
        F.sequence(F.lit(0), F.size(phrase) - length), lambda i: F.forall(F.slice(e, i + 1, length), lambda x: x)))


def merged_spans(spans: Column) -> Column:
    """The maximal runs [start, end) of the positions in an array of such intervals."""
    positions = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"] - 1)))
    return let(F.sort_array(F.array_distinct(positions)), lambda p: F.zip_with(
        F.filter(p, lambda x, i: ~x.eqNullSafe(F.get(p, i - 1) + 1)),
        F.filter(p, lambda x, i: ~x.eqNullSafe(F.get(p, i + 1) - 1)),
        lambda first, last: F.struct(first.alias("start"), (last + 1).alias("end"))))


def find_benchmark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = SLACK) -> DataFrame:
    """Per row of ``documents``: doc_id, n_words, spans, items, near_items.

    ``spans`` are the maximal runs [start, end) of word positions that lie in an occurrence
    of a window, ``items`` the ids of the items with occurring windows, ``near_items`` those
    of items of which two rare terms occur, their distance in the item kept to within ``slack``
    words, without any window of it occurring. Windows have ``window`` words; an item with fewer is
    one window.

    A null text has no words. Items without an id or without words are passed over. Items
    of equal words share their matches, and repeated items count once; of repeated
    documents each row gets its own result. Empty tables give empty arrays, or no rows.
    """
    if window < 1 or slack < 0:
        raise ValueError("window is at least 1 and slack at least 0")
    named_rows = named(documents)
    corpus = split_up(named_rows)
    phrases = materialise(phrases_of(benchmark), "phrases")
    wanted = materialise(lookups(corpus, phrases, window), "lookups")
    found = materialise(alignments(postings(corpus, wanted), wanted, slack), "alignments")

    per_doc = found.join(bounded(phrases), "phrase").groupBy("doc").agg(
        F.collect_list(F.struct("shift", "near", "words", "items")).alias("aligned"))
    # Only the rows that have candidates are split into words again.
    candidates = split_up(named_rows.join(bounded(found.select("doc").distinct()), "doc", "left_semi"))
    checked = candidates.join(per_doc, "doc").select(
        "doc_id", "doc", F.size("words").alias("n_words"), F.transform("aligned", lambda a: F.struct(
            a["items"].alias("items"), a["near"].alias("near"), F.transform(
                F.when(a["near"].isNull(), phrase_starts(F.col("words"), a["words"], a["shift"], window))
                .otherwise(F.array().cast("array<int>")),
                lambda i: F.struct(
                    (a["shift"] + i).alias("start"),
                    (a["shift"] + i + F.least(F.lit(window), F.size(a["words"]))).alias("end")),
            ).alias("spans"))).alias("aligned"))
    exact = F.filter("aligned", lambda a: F.size(a["spans"]) > 0)
    spans = merged_spans(F.array_distinct(F.flatten(F.transform(exact, lambda a: a["spans"]))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(exact, lambda a: a["items"]))))
    near = F.flatten(F.transform("aligned", lambda a: a["items"]))
    results = checked.select("doc_id", "doc", "n_words", spans.alias("spans"), items.alias("items"), near.alias("near")).withColumn(
        "near_items", F.array_sort(F.array_except("near", "items"))).drop("near").dropDuplicates(["doc", "doc_id", "n_words"])
    rows = corpus.select("doc_id", "doc", F.size("words").alias("n_words"))
    same = rows.doc_id.eqNullSafe(results.doc_id) & (rows.doc == results.doc) & (rows.n_words == results.n_words)
    empty = F.array().cast
    kind = dict(results.dtypes)
    return rows.join(results, same, "left").select(
        rows.doc_id, rows.n_words.cast("long").alias("n_words"),
        *(F.coalesce(results[c], empty(kind[c])).alias(c) for c in ("spans", "items", "near_items")))
