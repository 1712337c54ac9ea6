"""The jobs from raw versions to stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.ctes import match_parts, part, with_ctes
from catalog.registry import query
from catalog.views import CONFIG, Views
from verstext.functions import text as tx
from verstext.plans import jobs

_BARE = r"trim(regexp_replace(regexp_replace(replace(summary, '</p><p>', ' '), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))"
part("job_sentences", ("entryversion",), rf"""
    SELECT source, entry_id, version, CAST(unnest(range(len(p))) AS INTEGER) AS sent_idx, unnest(p) AS sentence
    FROM (SELECT source, entry_id, version, list_filter(string_split_regex(
            regexp_replace(translate({_BARE}, '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\x00-\x7F]', '', 'g'), '[.!?]\s+'),
            lambda s: trim(s) <> '') AS p
          FROM entryversion WHERE num_versions > 1 AND trim(summary) <> '')""")
part("job_words", ("job_sentences",), r"""
    SELECT entry_id, version, sent_idx,
           unnest(list_filter(string_split_regex(lower(sentence), '\s+'), lambda x: x <> '')) AS word FROM job_sentences""")
match_parts("job_", "job_sentences", "job_words", None, 0.5, 0.44)


@query("split_job", with_ctes("job_sentences", """
    SELECT source, entry_id, version, sent_idx, md5(sentence) AS sentence_md5 FROM job_sentences"""))
def split_job(v: Views):
    rows = jobs.split_job(v.entryversion)
    return rows.select("source", "entry_id", "version", "sent_idx", F.md5(F.col("sentence")).alias("sentence_md5"))


@query("match_job", with_ctes("job_matched", """
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y, round(avg_sentence_distance_x, 6) AS distance_x,
           round(avg_sentence_distance_y, 6) AS distance_y FROM job_matched"""))
def match_job(v: Views):
    rows = jobs.match_job(v.entryversion, config=CONFIG)
    return rows.select("entry_id", "version_x", "version_y", "sent_idx_x", "sent_idx_y", F.round("avg_sentence_distance_x", 6).alias("distance_x"),
                       F.round("avg_sentence_distance_y", 6).alias("distance_y"))
