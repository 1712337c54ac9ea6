"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

import catalog.label_queries  # noqa: F401  the SQL parts of labels are used here
from catalog.ctes import with_ctes
from catalog.registry import query
from catalog.text_queries import content_sql
from catalog.views import Views
from verstext.functions import text as tx
from verstext.functions.uniform import hash_uniform
from verstext.operators import labels, match, stats
from verstext.operators.attached import weighted_texts
from verstext.runtime import materialise

FLAGS = {
    "addition": "sent_idx_x IS NULL",
    "deletion": "sent_idx_y IS NULL",
    "edit": "sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL AND coalesce(avg_sentence_distance_x, avg_sentence_distance_y) > 0.01",
}
RATES = ", ".join(f"round(avg(CAST(({c}) AS INTEGER)), 6) AS {n}_rate" for n, c in FLAGS.items())


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


RATE_COLS = [f"{n}_rate" for n in FLAGS]


@query("pair_change_rates", with_ctes("matched", f"SELECT entry_id, version_x, version_y, {RATES} FROM matched GROUP BY ALL"))
def pair_change_rates(v: Views):
    """From raw texts to rates: derive versions, split, match, aggregate."""
    return _rounded(stats.pair_change_rates(match.match_bidirectional(materialise(v.make_sentences(), "sentences"))), *RATE_COLS)


@query("change_by_version", with_ctes("matched", """
    , p AS (SELECT entry_id, version_x, """ + ", ".join(f"avg(CAST(({c}) AS INTEGER)) AS {n}" for n, c in FLAGS.items()) + """
            FROM matched WHERE version_x < 32 GROUP BY ALL)
    SELECT version_x, round(avg(addition) * 100, 2) AS addition_pct, round(avg(deletion) * 100, 2) AS deletion_pct,
           round(avg(edit) * 100, 2) AS edit_pct FROM p GROUP BY version_x"""))
def change_by_version(v: Views):
    return stats.change_by_version(v.matched, 32)


@query("change_by_position", with_ctes("matched", f"""
    SELECT coalesce(sent_idx_x, sent_idx_y) AS sent_idx, {RATES}, count(*) AS n FROM matched
    WHERE coalesce(sent_idx_x, sent_idx_y) < 100 GROUP BY 1"""))
def change_by_position(v: Views):
    return _rounded(stats.change_by_position(v.matched, 100), *RATE_COLS)


@query("corpus_totals", with_ctes("matched", """
    , t AS (SELECT count(DISTINCT entry_id) AS entries, count(DISTINCT (entry_id, version_x)) AS versions, count(*) AS sentences, """
    + ", ".join(f"count(*) FILTER ({c}) AS {n}s" for n, c in FLAGS.items()) + """ FROM matched)
    SELECT entries, versions, additions, deletions, edits, sentences, round(additions / sentences, 6) AS addition_share,
           round(deletions / sentences, 6) AS deletion_share, round(edits / sentences, 6) AS edit_share,
           round(additions * (4200000 / versions), 2) AS scaled_additions, round(deletions * (4200000 / versions), 2) AS scaled_deletions,
           round(edits * (4200000 / versions), 2) AS scaled_edits FROM t"""))
def corpus_totals(v: Views):
    out = _rounded(stats.corpus_totals(v.matched, 4200000), *[f"{n}_share" for n in FLAGS])
    return out.withColumns({f"scaled_{n}s": F.round(f"scaled_{n}s", 2) for n in FLAGS})


@query("corpus_sketches", with_ctes("sentences", """
    , t AS (SELECT source, count(DISTINCT entry_id) AS entries, count(DISTINCT (entry_id, version)) AS versions, count(DISTINCT sentence) AS sentences,
                   count(*) AS n FROM sentences GROUP BY GROUPING SETS ((source), ()))
    SELECT source, entries, versions, sentences, n AS rows, TRUE AS within_bounds FROM t"""))
def corpus_sketches(v: Views):
    """Sketches of two arrivals that share every third document, added up, beside the exact numbers."""
    days = [v.sentences.where(F.col("entry_id") % 3 != k) for k in (1, 2)]
    seen = stats.add_sketches(*[stats.corpus_sketches(d) for d in days])
    near = stats.sketched_totals(seen).withColumnRenamed("source", "of").drop("rows")
    exact = v.sentences.groupingSets([["source"], []], "source").agg(
        F.countDistinct("entry_id").alias("exact_entries"), F.countDistinct("entry_id", "version").alias("exact_versions"),
        F.countDistinct("sentence").alias("exact_sentences"), F.count(F.lit(1)).alias("rows"))
    both = exact.join(near, F.col("source").eqNullSafe(F.col("of")))
    off = [F.abs(F.col(n) / F.col(f"exact_{n}") - 1) < 0.05 for n in stats.SKETCHED]
    return both.select("source", *[F.col(f"exact_{n}").alias(n) for n in stats.SKETCHED], "rows", (off[0] & off[1] & off[2]).alias("within_bounds"))


@query("source_totals", with_ctes("entryversion", """
    SELECT source, count(*) AS articles, CAST(sum(n) AS BIGINT) AS versions, count(*) FILTER (n > 1 AND n < 40) AS articles_in_band,
           CAST(coalesce(sum(n) FILTER (n > 1 AND n < 40), 0) AS BIGINT) AS versions_in_band
    FROM (SELECT source, entry_id, count(*) AS n FROM entryversion GROUP BY ALL) GROUP BY source"""))
def source_totals(v: Views):
    return stats.source_totals(v.entryversion)


@query("versions_per_entry", with_ctes("entryversion", """
    SELECT source, median(n)::DOUBLE AS median_versions FROM (SELECT source, entry_id, count(*) AS n FROM entryversion GROUP BY ALL) GROUP BY source"""))
def versions_per_entry(v: Views):
    return stats.versions_per_entry(v.entryversion)


@query("version_histogram", with_ctes("entryversion", """
    SELECT num_versions, count(*) AS entries, CAST(pow(2, floor(log2(num_versions))) AS BIGINT) AS bin
    FROM (SELECT DISTINCT entry_id, num_versions FROM entryversion) GROUP BY num_versions"""))
def version_histogram(v: Views):
    return stats.version_histogram(v.entryversion)


@query("p75_by_source", """
    SELECT source, p75, CAST(row_number() OVER (ORDER BY p75 DESC, source) AS INTEGER) AS rank FROM
    (SELECT event_type AS source, quantile_cont(n, 0.75)::DOUBLE AS p75 FROM
      (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1)""")
def p75_by_source(v: Views):
    crawl = v.events.select(F.col("event_type").alias("source"), F.col("user_id").alias("entry_id"))
    return stats.p75_by_source(crawl)


@query("update_lag", with_ctes("entryversion", """
    SELECT x.source, round(quantile_cont(epoch(y.created) - epoch(x.created), 0.5) / 86400, 6) AS median_days,
           round(quantile_cont(epoch(y.created) - epoch(x.created), 0.75) / 86400, 6) AS p75_days
    FROM entryversion x JOIN entryversion y ON x.entry_id = y.entry_id AND y.version = x.version + 1 GROUP BY 1"""))
def update_lag(v: Views):
    return _rounded(stats.update_lag(v.entryversion), "median_days", "p75_days")


@query("headline_change_rate", with_ctes("entryversion", """
    SELECT CAST(floor(x.version / 2) * 2 AS BIGINT) AS version_bin, round(avg(CAST(x.title <> y.title AS INTEGER)), 6) AS change_rate, count(*) AS n
    FROM entryversion x JOIN entryversion y ON x.entry_id = y.entry_id AND y.version = x.version + 1 GROUP BY 1"""))
def headline_change_rate(v: Views):
    return _rounded(stats.headline_change_rate(v.entryversion), "change_rate")


@query("mean_match_distance", with_ctes("matched", """
    SELECT * FROM (SELECT entry_id, version_x, version_y,
      round(avg((coalesce(avg_sentence_distance_x, 1.0) + coalesce(avg_sentence_distance_y, 1.0)) / 2), 6) AS mean_distance
      FROM matched GROUP BY ALL) WHERE mean_distance <> 0"""))
def mean_match_distance(v: Views):
    return _rounded(stats.mean_match_distance(v.matched), "mean_distance")


def _category_sql(tests: dict[str, str], table: str, keys: str) -> str:
    return " UNION ".join(f"SELECT {keys}, '{n}' AS category FROM {table} WHERE {t}" for n, t in tests.items())


def _contains_sql(patterns):
    return {n: "(" + " OR ".join(f"contains(lower(sentence), '{p}')" for p in ps) + ")" for n, ps in patterns.items()}


# Notes as they stand in articles, put in front of the test texts by source.
NOTES = {
    "src1": "This article was amended", "src2": "Correction to an earlier version", "src3": "A correctional officer",
    "src4": "Clarification of an error in the text", "src5": "Reporting by A; additional reporting by B; editing by C",
    "src6": "The figure was corrected and revised", "src7": "D contributed to this report",
}
NOTE_SQL = "CASE source " + " ".join(f"WHEN '{k}' THEN '{n} '" for k, n in NOTES.items()) + " ELSE '' END || sentence"


def _noted(v: Views):
    note = F.lit("")
    for k, n in NOTES.items():
        note = F.when(F.col("source") == k, n + " ").otherwise(note)
    return v.sentences.withColumn("sentence", F.concat(note, "sentence"))


@query("pattern_categories", with_ctes("sentences", f"""
    , n AS (SELECT entry_id, version, sent_idx, {NOTE_SQL} AS sentence FROM sentences) """ + _category_sql(
    {"correction": "contains(lower(sentence), 'correction') AND NOT contains(lower(sentence), 'correctional')",
     **_contains_sql(stats.CORRECTION_PATTERNS)}, "n", "entry_id, version, sent_idx")))
def pattern_categories(v: Views):
    return stats.categorise(_noted(v), ["entry_id", "version", "sent_idx"], stats.correction_tests())


@query("contributor_lines", with_ctes("sentences", f"""
    , n AS (SELECT entry_id, version, sent_idx, {NOTE_SQL} AS sentence FROM sentences) """ + _category_sql(
    _contains_sql(stats.CONTRIBUTOR_PATTERNS), "n", "entry_id, version, sent_idx")))
def contributor_lines(v: Views):
    tests = stats.contains_any("sentence", stats.CONTRIBUTOR_PATTERNS)
    return stats.categorise(_noted(v), ["entry_id", "version", "sent_idx"], tests)


@query("keyword_entries", with_ctes("entryversion", """
    SELECT id, entry_id FROM entryversion WHERE entry_id IN
      (SELECT entry_id FROM entryversion WHERE regexp_matches(summary, 'hahaha|[0-9]{3}-[0-9]{4}'))"""))
def keyword_entries(v: Views):
    return stats.keyword_entries(v.entryversion, "hahaha|[0-9]{3}-[0-9]{4}").select("id", "entry_id")


@query("any_version_matches", with_ctes("entryversion", """
    SELECT entry_id, bool_or(regexp_matches(title, '(?i)^the|ion')) AS matches FROM entryversion GROUP BY entry_id"""))
def any_version_matches(v: Views):
    return stats.any_version_matches(v.entryversion, F.col("title").rlike("(?i)^the|ion"))


FLAGGED_SQL = """
    , f AS (SELECT s.entry_id, s.version, s.sent_idx, s.sentence, d.lang, count(*) OVER (PARTITION BY s.entry_id, s.version) AS doc_len,
              CAST(EXISTS (SELECT 1 FROM matched m WHERE m.entry_id = s.entry_id AND m.version_y = s.version AND m.sent_idx_y = s.sent_idx AND m.sent_idx_x IS NULL) AS INTEGER) AS is_added,
              CAST(EXISTS (SELECT 1 FROM matched m WHERE m.entry_id = s.entry_id AND m.version_x = s.version AND m.sent_idx_x = s.sent_idx AND m.sent_idx_y IS NULL) AS INTEGER) AS is_deleted
            FROM sentences s JOIN documents d ON d.doc_id = s.entry_id)"""


def _flagged(v: Views):
    keys = ["entry_id", "version", "sent_idx"]
    flags = labels.added_deleted_table(v.matched).groupBy(*keys).agg(
        F.max("is_added").alias("is_added"), F.max("is_deleted").alias("is_deleted"))
    langs = v.documents.select(F.col("doc_id").alias("entry_id"), "lang")
    return v.sentences.join(langs, "entry_id").join(flags, keys, "left").na.fill(0, ["is_added", "is_deleted"])


@query("label_odds", with_ctes("matched sentences", FLAGGED_SQL + """
    SELECT lang, count(*) AS n,
      round((sum(is_added) / (SELECT sum(is_added) FROM f)) / (count(*) / (SELECT count(*) FROM f)), 6) AS odds_added,
      round((sum(is_deleted) / (SELECT sum(is_deleted) FROM f)) / (count(*) / (SELECT count(*) FROM f)), 6) AS odds_deleted
    FROM f GROUP BY lang"""))
def label_odds(v: Views):
    return _rounded(stats.label_odds(_flagged(v), "lang"), "odds_added", "odds_deleted")


@query("label_share_by_bin", with_ctes("matched sentences", FLAGGED_SQL + """
    , c AS (SELECT CAST(floor(doc_len / 10) * 10 AS BIGINT) AS len_bin, lang, count(*) AS n FROM f GROUP BY ALL),
    s AS (SELECT *, n / sum(n) OVER (PARTITION BY len_bin) AS share FROM c)
    SELECT len_bin, lang, n, round(share, 6) AS share, round(share / (avg(share) OVER (PARTITION BY lang)), 6) AS ratio FROM s"""))
def label_share_by_bin(v: Views):
    rows = stats.doc_len_attach(_flagged(v), 10)
    return _rounded(stats.label_share_by_bin(rows, "len_bin", "lang"), "share", "ratio")


@query("correlation", with_ctes("doc_labels", """
    , d AS (SELECT num_deleted AS a, length(sentences) AS b FROM doc_labels),
    r AS (SELECT a, b, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra,
                 rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM d)
    SELECT round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r"""))
def correlation(v: Views):
    rows = v.doc_labels.select(F.col("num_deleted").alias("a"), F.length("sentences").cast("long").alias("b"))
    return _rounded(stats.correlation(rows, "a", "b"), "pearson", "spearman")


@query("tag_transitions", with_ctes("matched sentences", r"""
    , t AS (SELECT entry_id, version, sent_idx, list_distinct(list_transform(list_filter(string_split_regex(lower(sentence), '\s+'), lambda x: x <> ''), lambda y: substr(y, 1, 1))) AS tags FROM sentences),
    p AS (SELECT unnest(a.tags) AS tag_x, b.tags AS y FROM matched m
          JOIN t a ON a.entry_id = m.entry_id AND a.version = m.version_x AND a.sent_idx = m.sent_idx_x
          JOIN t b ON b.entry_id = m.entry_id AND b.version = m.version_y AND b.sent_idx = m.sent_idx_y),
    q AS (SELECT tag_x, unnest(y) AS tag_y FROM p)
    SELECT tag_x, tag_y, count(*) AS n FROM q WHERE tag_x <> tag_y GROUP BY ALL ORDER BY n DESC, tag_x, tag_y LIMIT 50"""))
def tag_transitions(v: Views):
    tags = F.array_sort(F.array_distinct(F.transform(tx.tokens("sentence"), lambda t: F.substring(t, 1, 1))))
    rows = v.sentences.select("entry_id", "version", "sent_idx", tags.alias("tags"))
    return stats.tag_transitions(v.matched, rows, 50)


@query("share_with_feature", with_ctes("matched sentences", FLAGGED_SQL + r"""
    SELECT CASE WHEN is_added = 1 THEN 'added' WHEN is_deleted = 1 THEN 'deleted' ELSE 'control' END AS kind,
           round(avg(CAST(len(regexp_extract_all(sentence, '[0-9]+')) > 0 AS INTEGER)), 6) AS share, count(*) AS n FROM f GROUP BY 1"""))
def share_with_feature(v: Views):
    kind = F.when(F.col("is_added") == 1, "added").when(F.col("is_deleted") == 1, "deleted").otherwise("control")
    numbers = F.regexp_extract_all("sentence", F.lit("([0-9]+)"), F.lit(1))
    rows = _flagged(v).withColumn("kind", kind).withColumn("numbers", numbers)
    return _rounded(stats.share_with_feature(rows, "kind", "numbers"), "share")


@query("value_counts", """
    SELECT lang, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) AS share FROM documents GROUP BY lang""")
def value_counts(v: Views):
    return _rounded(stats.value_counts(v.documents, "lang"), "share")


@query("top_k", with_ctes("words", "SELECT token, count(*) AS n FROM words GROUP BY token ORDER BY n DESC, token LIMIT 25"))
def top_k(v: Views):
    return stats.top_k(v.words, "token", 25)


@query("ngram_lift", with_ctes("matched sentences", FLAGGED_SQL + f"""
    , t AS (SELECT is_added, {content_sql('sentence')} AS t FROM f),
    g AS (SELECT is_added, unnest(t) AS ngram FROM t
          UNION ALL SELECT is_added, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t),
    l AS (SELECT ngram, count(*) AS n, round((sum(is_added) / (SELECT sum(is_added) FROM g)) / (count(*) / (SELECT count(*) FROM g)), 9) AS lift
          FROM g GROUP BY ngram HAVING sum(is_added) > 0)
    SELECT ngram, n, round(lift, 6) AS lift, 'top' AS side FROM (SELECT * FROM l ORDER BY lift DESC, ngram LIMIT 30)
    UNION ALL SELECT ngram, n, round(lift, 6), 'bottom' FROM (SELECT * FROM l ORDER BY lift, ngram LIMIT 30)"""))
def ngram_lift(v: Views):
    added = v.matched.where("sent_idx_x IS NULL").select("entry_id", F.col("version_y").alias("version"), F.col("sent_idx_y").alias("sent_idx"))
    rows = weighted_texts(v.sentences, added, v.documents.select(F.col("doc_id").alias("entry_id")))
    return _rounded(stats.ngram_lift(rows, "sentence", "f", 30, count="n"), "lift")


@query("doc_len_attach", with_ctes("sentences", """
    SELECT entry_id, version, sent_idx, count(*) OVER (PARTITION BY entry_id, version) AS doc_len,
           CAST(floor(count(*) OVER (PARTITION BY entry_id, version) / 10) * 10 AS BIGINT) AS len_bin FROM sentences"""))
def doc_len_attach(v: Views):
    return stats.doc_len_attach(v.sentences).select("entry_id", "version", "sent_idx", "doc_len", "len_bin")


@query("coverage", with_ctes("entryversion", """
    , p AS (SELECT x.source, x.entry_id, x.archive_url IS NOT NULL AS done FROM entryversion x
            JOIN entryversion y ON x.entry_id = y.entry_id AND y.version = x.version + 1)
    SELECT source, count(*) AS eligible_pairs, count(DISTINCT entry_id) AS eligible_entries,
           count(*) FILTER (done) AS produced_pairs, count(DISTINCT entry_id) FILTER (done) AS produced_entries,
           round(count(*) FILTER (done) / count(*), 6) AS finished FROM p GROUP BY source"""))
def coverage(v: Views):
    pairs = match.adjacent_versions(v.entryversion, ["archive_url"], ("source", "entry_id"))
    return _rounded(stats.coverage(pairs, pairs.where("archive_url_x IS NOT NULL")), "finished")


@query("duplicate_audit", with_ctes("matched", """
    , t AS (SELECT * FROM matched UNION ALL SELECT * FROM matched WHERE sent_idx_x = 0)
    SELECT multiplicity, count(*) AS n FROM (SELECT count(*) AS multiplicity FROM t
      GROUP BY entry_id, version_x, version_y, sent_idx_x, sent_idx_y) GROUP BY 1"""))
def duplicate_audit(v: Views):
    return stats.duplicate_audit(v.matched.unionByName(v.matched.where("sent_idx_x = 0")))


@query("dedup_keep_first", """
    SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type""")
def dedup_keep_first(v: Views):
    return stats.dedup_keep_first(v.events.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], "event_id")


@query("date_histogram", """
    SELECT event_type AS source, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL""")
def date_histogram(v: Views):
    return stats.date_histogram(v.events.select(F.col("event_type").alias("source"), F.col("ts").alias("created")))


@query("title_counts", with_ctes("entryversion", """
    SELECT title, count(DISTINCT entry_id) AS n FROM entryversion GROUP BY title ORDER BY n DESC, title LIMIT 40"""))
def title_counts(v: Views):
    return stats.title_counts(v.entryversion, 40)


@query("partition_skew", with_ctes("sentences", """
    SELECT CAST(CAST('0x' || substr(md5(CAST(entry_id AS VARCHAR)), 1, 8) AS BIGINT) // 268435456 AS INTEGER) AS partition, count(*) AS n FROM sentences GROUP BY 1"""))
def partition_skew(v: Views):
    placed = stats.place_rows(v.sentences, F.floor(hash_uniform("entry_id") * 16), 16)
    return stats.partition_skew(placed)
