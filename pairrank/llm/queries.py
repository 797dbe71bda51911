"""The queries of this subpackage and their SQL counterparts (DuckDB)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairrank.llm import bpe, decontamination, hard_negatives, html_text, language, licenses, line_dedup, minhash, mixing, passages, quality, spelling, warc
from pairrank.llm.expressions import table

# Production targets of the mixture, in percent of the characters, and the block size.
TARGETS = {"src0": 12, "src1": 10, "src2": 8, "src3": 8, "src4": 6, "src5": 6}
REST = 50
BLOCK_CHARS = 1 << 16


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars"))
    mixed = mixing.mix(documents, TARGETS, REST, BLOCK_CHARS, size=F.col("chars"))
    return mixed.select("doc_id", "source", "stream", "block", "slot", "place", "full")


_MIX_WEIGHTS = [*TARGETS.values(), REST]
_MIX_SQL = f"""
WITH RECURSIVE sched(slot, done, stream, nth) AS (
    SELECT -1, {[0] * len(_MIX_WEIGHTS)}::BIGINT[], NULL::BIGINT, NULL::BIGINT
    UNION ALL
    SELECT slot + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p - 1, done[p]
    FROM (SELECT slot, done, list_min(list_filter(list_transform(done, lambda k, i:
            CASE WHEN k < ws[i] AND (k * {sum(_MIX_WEIGHTS)}) // ws[i] <= slot + 1
                 THEN {{'due': ((k + 1) * {sum(_MIX_WEIGHTS)} + ws[i] - 1) // ws[i], 'i': i}} END), lambda x: x IS NOT NULL)).i AS p
          FROM (SELECT *, {_MIX_WEIGHTS}::BIGINT[] AS ws FROM sched WHERE slot < {sum(_MIX_WEIGHTS) - 1}))),
docs AS (
    SELECT doc_id, source, coalesce(length(text), 0) AS size,
        CASE {" ".join(f"WHEN source = '{s}' THEN {i}" for i, s in enumerate(TARGETS))} ELSE {len(TARGETS)} END AS stream FROM documents),
placed AS (
    SELECT *, coalesce(sum(size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {BLOCK_CHARS} AS block,
        row_number() OVER w - 1 AS place FROM docs
    WINDOW w AS (PARTITION BY stream ORDER BY md5(doc_id::VARCHAR), doc_id)),
totals AS (
    SELECT i AS stream, (coalesce(sum(size), 0)::BIGINT + {BLOCK_CHARS - 1}) // {BLOCK_CHARS} AS block
    FROM range({len(_MIX_WEIGHTS)}) r(i) LEFT JOIN docs ON stream = i GROUP BY i),
shares AS (SELECT unnest(range({len(_MIX_WEIGHTS)})) AS stream, unnest({_MIX_WEIGHTS}::BIGINT[]) AS share),
ends AS (
    SELECT min(block // share * {sum(_MIX_WEIGHTS)} + slot) AS ends FROM totals JOIN shares USING (stream)
    JOIN sched ON sched.stream = totals.stream AND nth = block % share)
SELECT doc_id, source, stream::INTEGER AS stream, block, block // share * {sum(_MIX_WEIGHTS)} + slot AS slot, place,
    block // share * {sum(_MIX_WEIGHTS)} + slot < ends AS "full"
FROM placed JOIN shares USING (stream) JOIN sched ON sched.stream = placed.stream AND nth = block % share, ends
"""


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op3_warc_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.convert_archives(warc.archives(table(spark, sf_dir, "pages")))
    records = warc.with_referred_key(warc.read_warc(spark, folder).drop("payload"))
    return records.select(
        F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"),
        F.col("refers_to_key").alias("refers_to"))


_WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(strlen(html), 0)::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to FROM t
"""


def learned_language(documents: DataFrame) -> tuple[language.Model, DataFrame]:
    """A model of the documents outside the holdout, and the documents with ``held_out``."""
    marked = documents.withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    return language.train(marked.where(~F.col("held_out"))), marked


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, marked = learned_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    held_out = F.coalesce("held_out", F.lit(False)).alias("held_out")
    return language.identify(marked.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_WORD = r"[^\x20\x09-\x0D]+"
_RATE = quality.MAX_FALSE / len(quality.RULES)
_QUALITY_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS stratum, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wins AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM wins),
reps AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM found WHERE n > 1) GROUP BY doc_id),
dups AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
    WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
m AS (SELECT d.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, coalesce(n_lines, 0) AS n_lines,
        coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(reps.n, 0)::BIGINT AS n_repeat_words
    FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN reps USING (doc_id)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m),
s AS ({" UNION ALL ".join(f"SELECT *, '{r}' AS rule, CASE WHEN {den} > 0 THEN 1000 * {num} // {den} ELSE 0 END AS score FROM b" for r, (num, den, _) in quality.RULES.items())}),
good AS (SELECT stratum, rule, score FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
ladders AS ({" UNION ALL ".join(f"SELECT '{r}' AS rule, unnest(range({c.start}, {c.stop}, {c.step})) AS cutoff" for r, (_, _, c) in quality.RULES.items())}),
tried AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM good JOIN ladders USING (rule) GROUP BY ALL),
tails AS (SELECT stratum, rule, cutoff, list_sum(list_transform(range(0, k + 1), lambda i:
        exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({_RATE}) + (n - i) * ln(1 - {_RATE})))) AS p FROM tried WHERE k < n * {_RATE}),
c AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tails
    WHERE p <= {1 - quality.CONFIDENCE} / ((SELECT count(DISTINCT stratum) FROM good) * {len(quality.RULES)}) GROUP BY ALL),
v AS (SELECT s.doc_id, bool_or(coalesce(score > cutoff, false)) AS bad FROM s LEFT JOIN c USING (stratum, rule) GROUP BY s.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM b JOIN v USING (doc_id)
"""


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_kept", F.md5("text").alias("kept_md5"))


_BLANK = r"[^\x20\x09-\x0D]"
_LINES_SQL = f"""
WITH l AS (SELECT doc_id, unnest(range(len(a))) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)),
words AS (SELECT * FROM l WHERE regexp_matches(line, '{_BLANK}')),
firsts AS (SELECT line, length(line) AS len, doc_id, n, row_number() OVER (ORDER BY doc_id, n) AS pos FROM words
    QUALIFY row_number() OVER (PARTITION BY line ORDER BY doc_id, n) = 1),
halves AS (SELECT line, len, pos, len - d AS m, side, CASE WHEN side = 0 THEN left(line, (len - d) // 2) ELSE right(line, (len - d) - (len - d) // 2) END AS half
    FROM firsts, range(2) a(d), range(2) b(side) WHERE len - d >= {line_dedup.MIN_CHARS}),
pairs AS (SELECT DISTINCT x.line AS line, y.line AS earlier FROM halves x JOIN halves y USING (m, side, half) WHERE y.pos < x.pos AND least(x.len, y.len) = m),
near AS (SELECT DISTINCT line FROM (SELECT line, string_split(line, '') AS x, string_split(earlier, '') AS y FROM pairs) WHERE CASE
    WHEN len(x) = len(y) THEN list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] <> y[i])::INT)) <= 1
    WHEN len(x) > len(y) THEN list_contains(list_transform(range(len(x)), lambda i: x[:i] || x[i + 2:]), y)
    ELSE list_contains(list_transform(range(len(y)), lambda i: y[:i] || y[i + 2:]), x) END),
stay AS (SELECT doc_id, n FROM firsts WHERE line NOT IN (SELECT line FROM near)),
kept AS (SELECT doc_id, count(*) FILTER (regexp_matches(line, '{_BLANK}')) AS n_lines, count(stay.n) AS n_kept,
    coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (stay.n IS NOT NULL OR NOT regexp_matches(line, '{_BLANK}')), '') AS t
    FROM l LEFT JOIN stay USING (doc_id, n) GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, CASE WHEN text IS NOT NULL THEN md5(t) END AS kept_md5
FROM documents LEFT JOIN kept USING (doc_id)
"""


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    ids = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(
            ":", m["license"], F.round(100 * m["coverage"]).cast("int"), m["start"], m["end"])), ",").alias("spans"))


def op9_passage_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passages.remove_passages(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def token_digests(documents: DataFrame, path: str) -> DataFrame:
    return bpe.round_trip(documents, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


# crc32 is computed byte by byte from its table (the polynomial is a fixed value).
_SPELLING_SQL = f"""
WITH RECURSIVE
shifts(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i)
    UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM shifts WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM shifts WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[{spelling.LETTERS}]{{{spelling.MIN_LETTERS},}}'),
        lambda r: translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS run FROM documents) GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs),
summed AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT,
        list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (
        SELECT n, CASE WHEN h % {spelling.MODULUS} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM summed)
    WHERE length(word) >= {spelling.MIN_LETTERS} GROUP BY word HAVING sum(n) >= {spelling.MIN_COUNT}),
less AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM less a JOIN v b ON a.rest = b.word
    UNION SELECT b.word, a.word, a.n FROM less a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
firsts AS (SELECT word, n_near, m, min(other) AS other FROM best JOIN near USING (word, m) GROUP BY ALL),
forms AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.FACTOR} * n THEN other END AS form,
    CASE WHEN m >= {spelling.FACTOR} * n THEN m END AS form_n FROM v LEFT JOIN firsts USING (word)),
walk(word, final, form) AS (SELECT word, word, form FROM forms
    UNION ALL SELECT walk.word, walk.form, forms.form FROM walk JOIN forms ON walk.form = forms.word)
SELECT forms.word, forms.form, final AS root, n, n_near, form_n FROM forms JOIN walk ON forms.word = walk.word AND walk.form IS NULL
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


_NEGATIVES_SQL = f"""
WITH rows AS (
    SELECT vec_id, CASE WHEN vec_id % {hard_negatives.RELABELLED} = 0 THEN (label + 1) % {hard_negatives.LABELS} ELSE label END AS label,
        list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * x::DOUBLE)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM rows a JOIN rows b ON a.vec_id % {hard_negatives.ANCHORS} = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.POSITIVES})
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank,
    id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND {hard_negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.HIGH} * positive_score
QUALIFY rank <= {hard_negatives.NEGATIVES}
"""


def _terms(text: str) -> str:
    lowered = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({lowered}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


_DECONTAMINATION_SQL = f"""
WITH items AS (SELECT item_id, w, least(len(w), {decontamination.WINDOW}) AS n FROM (
        SELECT item_id, {_terms("text")} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, w[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_terms("text")} AS w FROM documents),
grams AS (SELECT doc_id, n, i, w[i:i + n - 1] AS g FROM (
    SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows))),
found AS (SELECT doc_id, item_id, i, n FROM grams JOIN windows USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_html_extraction": op2_html_extraction,
    "op3_warc_conversion": op3_warc_conversion,
    "op4_language_id": op4_language_id,
    "op5_quality_rules": op5_quality_rules,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scan": op8_license_scan,
    "op9_passage_removal": op9_passage_removal,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_bpe_codec": op11_bpe_codec,
    "op12_spelling_forms": op12_spelling_forms,
    "op13_hard_negatives": op13_hard_negatives,
}
SQL = {
    "op1_mix_sources": _MIX_SQL,
    "op3_warc_conversion": _WARC_SQL,
    "op5_quality_rules": _QUALITY_SQL,
    "op7_line_dedup": _LINES_SQL,
    "op10_benchmark_decontamination": _DECONTAMINATION_SQL,
    "op12_spelling_forms": _SPELLING_SQL,
    "op13_hard_negatives": _NEGATIVES_SQL,
}
