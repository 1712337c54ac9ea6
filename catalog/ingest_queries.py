"""Version bookkeeping and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.ctes import with_ctes
from catalog.registry import query
from catalog.views import Views
from verstext.functions import text as tx
from verstext.operators import ingest, match
from verstext.runtime import materialise


def _crawl(v: Views):
    return v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("entry_id"),
                           F.col("event_type").alias("source"), F.col("ts").alias("created"))


@query("version_rank", """
    SELECT user_id AS entry_id, event_id AS id,
           dense_rank() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS version FROM events""")
def version_rank(v: Views):
    return ingest.version_rank(_crawl(v)).select("entry_id", "id", "version")


@query("num_versions", """
    SELECT event_type AS source, user_id AS entry_id, event_id AS id,
           count(*) OVER (PARTITION BY event_type, user_id) AS num_versions FROM events""")
def num_versions(v: Views):
    return ingest.num_versions(_crawl(v), ["source", "entry_id"]).select("source", "entry_id", "id", "num_versions")


@query("dedup_versions", with_ctes("entryversion", """
    , twice AS (SELECT *, id AS row_id FROM entryversion
               UNION ALL SELECT *, id + 1000000000 FROM entryversion WHERE archive_url IS NULL),
    by_url AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_id) AS r FROM twice) WHERE r = 1)
    SELECT row_id, entry_id, version, url FROM
      (SELECT *, row_number() OVER (PARTITION BY entry_id, version ORDER BY row_id) AS r2 FROM by_url)
    WHERE r2 = 1"""))
def dedup_versions(v: Views):
    rows = v.entryversion.select("entry_id", "version", "url", "archive_url", F.col("id").alias("row_id"))
    again = rows.where("archive_url IS NULL").withColumn("row_id", F.col("row_id") + 1000000000)
    return ingest.dedup_versions(rows.unionByName(again), "row_id").select("row_id", "entry_id", "version", "url")


@query("extract_ids", with_ctes("entryversion", """
    SELECT id, CAST(regexp_extract('Version ' || version || ' of ' || num_versions, '([0-9]+)', 1) AS INTEGER) AS version_no,
           split_part(url, '/', 6) AS entry_part FROM entryversion"""))
def extract_ids(v: Views):
    caption = F.concat(F.lit("Version "), F.col("version").cast("string"), F.lit(" of "), F.col("num_versions").cast("string"))
    return v.entryversion.select("id", ingest.version_of_text(caption).alias("version_no"),
                                 ingest.url_part(F.col("url"), 6).alias("entry_part"))


@query("clean_html", with_ctes("entryversion", """
    SELECT id, regexp_replace(summary, '&lt;.*?&gt;', '', 'g') AS body FROM entryversion"""))
def clean_html(v: Views):
    page = F.concat(
        F.lit('<p><a href="/x">x</a></p><p>Version 1 of 2</p><p>'), F.col("summary"),
        F.lit("</p><p>Currently monitoring 1,234 news articles</p>"),
    )
    return v.entryversion.select("id", tx.clean_html(page).alias("body"))


@query("strip_markup", r"""
    SELECT page_id, trim(regexp_replace(regexp_replace(replace(html, '</p><p>', ' '), '<[^>]*>', '', 'g'),
           '\s+', ' ', 'g')) AS body FROM pages""")
def strip_markup(v: Views):
    return v.pages.select("page_id", tx.strip_markup("html").alias("body"))


@query("fold_ascii", f"""
    SELECT doc_id, regexp_replace(translate(text, '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\\x00-\\x7F]', '', 'g') AS folded
    FROM documents""")
def fold_ascii(v: Views):
    return v.documents.select("doc_id", tx.fold_latin("text").alias("folded"))


@query("eligible_versions", with_ctes("entryversion", """
    SELECT id, entry_id, version FROM entryversion
    WHERE num_versions > 1 AND num_versions < 40 AND trim(summary) <> ''"""))
def eligible_versions(v: Views):
    return ingest.eligible_versions(v.entryversion).select("id", "entry_id", "version")


@query("only_new_entries", with_ctes("entryversion", """
    SELECT id, entry_id, version FROM entryversion WHERE entry_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)"""))
def only_new_entries(v: Views):
    done = v.labels_table.where("quality = 1").select(F.col("doc_id").alias("entry_id"))
    return ingest.only_new_entries(v.entryversion, done, ["entry_id"]).select("id", "entry_id", "version")


@query("entry_slice", with_ctes("entryversion", """
    , ids AS (SELECT entry_id, row_number() OVER (ORDER BY entry_id) - 1 AS pos FROM (SELECT DISTINCT entry_id FROM entryversion))
    SELECT id, e.entry_id, version FROM entryversion e JOIN ids ON ids.entry_id = e.entry_id
    WHERE pos >= 2 * ceil((SELECT count(*) FROM ids) / 7) AND pos < 3 * ceil((SELECT count(*) FROM ids) / 7)"""))
def entry_slice(v: Views):
    return ingest.entry_slice(v.entryversion, "entry_id", 2, 7).select("id", "entry_id", "version")


@query("multi_version_only", with_ctes("entryversion", """
    SELECT id, entry_id, version FROM
      (SELECT *, count(*) OVER (PARTITION BY entry_id) AS n FROM entryversion WHERE trim(summary) <> '')
    WHERE n > 1"""))
def multi_version_only(v: Views):
    return ingest.multi_version_only(v.entryversion).select("id", "entry_id", "version")


@query("missing_pairs", with_ctes("entryversion", """
    , expected AS (SELECT * FROM (SELECT entry_id, version AS version_x,
                   lead(version) OVER (PARTITION BY entry_id ORDER BY version) AS version_y FROM entryversion)
                   WHERE version_y IS NOT NULL),
    lost AS (SELECT * FROM expected e WHERE NOT EXISTS (SELECT 1 FROM
        (SELECT entry_id, version AS vx FROM entryversion WHERE archive_url IS NOT NULL) p
        WHERE p.entry_id = e.entry_id AND p.vx = e.version_x AND p.vx + 1 = e.version_y))
    SELECT entry_id, version_x, version_y, count(*) OVER (PARTITION BY entry_id) AS shortfall FROM lost"""))
def missing_pairs(v: Views):
    produced = v.entryversion.where("archive_url IS NOT NULL").select(
        "entry_id", F.col("version").alias("version_x"), (F.col("version") + 1).alias("version_y"))
    return ingest.missing_pairs(v.entryversion, produced).select("entry_id", "version_x", "version_y", "shortfall")


@query("version_chains", with_ctes("entryversion", """
    SELECT min(id) OVER (PARTITION BY entry_id) AS root,
           row_number() OVER (PARTITION BY entry_id ORDER BY version) - 1 AS position, id FROM entryversion"""))
def version_chains(v: Views):
    # the texts of the versions are read once
    versions = materialise(v.entryversion.select("id", "entry_id", "version"), "version_ids")
    steps = ingest.next_versions(versions)
    real = steps.select((F.col("entry_id") * 10 + F.col("version_x")).alias("old_id"),
                        (F.col("entry_id") * 10 + F.col("version_y")).alias("new_id"))
    ends = versions.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    last = ends.join(real, "old_id", "left_anti")
    return ingest.version_chains(real.unionByName(last)).select("root", "position", "id")


@query("parse_time", """
    SELECT event_id, try_strptime(CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END,
           '%Y-%m-%d %H:%M:%S') AS created FROM events""")
def parse_time(v: Views):
    shown = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return v.events.select("event_id", ingest.parse_time(shown).alias("created"))


@query("url_domain", """
    SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS domain, count(*) AS n FROM pages GROUP BY 1""")
def url_domain(v: Views):
    return ingest.url_domain(v.pages)


@query("missing_ids", """
    SELECT range AS id FROM range((SELECT max(doc_id) + 1 FROM documents))
    WHERE range NOT IN (SELECT doc_id FROM labels) AND range NOT IN (SELECT page_id FROM pages)""")
def missing_ids(v: Views):
    top = v.documents.agg(F.max("doc_id")).first()[0] + 1
    seen = v.labels_table.select(F.col("doc_id").alias("id"))
    return ingest.missing_ids(seen, v.pages.select(F.col("page_id").alias("id")), top)


@query("percentile_band", """
    WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, n FROM c WHERE n >= (SELECT quantile_cont(n, 0.01) FROM c WHERE n <> 0)
      AND n <= (SELECT quantile_cont(n, 0.99) FROM c WHERE n <> 0)""")
def percentile_band(v: Views):
    counts = v.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return ingest.percentile_band(counts, "n")


@query("adjacent_urls", with_ctes("entryversion", """
    SELECT entry_id, CAST(step AS INTEGER) AS step, CAST(step + 1 AS INTEGER) AS next_step,
           'diff/' || entry_id || '/' || step || '/' || (step + 1) AS address
    FROM (SELECT entry_id, unnest(range(num_versions)) AS step FROM (SELECT DISTINCT entry_id, num_versions FROM entryversion))"""))
def adjacent_urls(v: Views):
    return ingest.adjacent_urls(v.entryversion.select("entry_id", "num_versions").distinct())


@query("max_version_per_entry", with_ctes("entryversion", """
    SELECT entry_id, max(version) AS max_version, max_by(title, version) AS last_title FROM entryversion GROUP BY entry_id"""))
def max_version_per_entry(v: Views):
    return ingest.max_version_per_entry(v.entryversion)


@query("version_keys", with_ctes("matched", """
    SELECT entry_id, version_x AS version FROM matched UNION SELECT entry_id, version_y FROM matched"""))
def version_keys(v: Views):
    return ingest.version_keys(v.matched)


@query("page_paragraphs", r"""
    SELECT page_id, CAST(unnest(range(len(p))) AS INTEGER) AS par_idx, unnest(p) AS paragraph
    FROM (SELECT page_id, regexp_extract_all(html, '<p(?:\s[^>]*)?>(.*?)</p>', 1) AS p FROM pages)""")
def page_paragraphs(v: Views):
    return ingest.page_paragraphs(v.pages)


@query("since", with_ctes("entryversion", """
    SELECT id, entry_id, version FROM entryversion WHERE created > TIMESTAMP '2024-01-10 00:00:00'"""))
def since(v: Views):
    return ingest.since(v.entryversion, "2024-01-10 00:00:00").select("id", "entry_id", "version")


@query("unify_sources", """
    SELECT 'documents' AS origin, doc_id AS id, text, lang, NULL::VARCHAR AS role FROM documents
    UNION ALL SELECT 'conversations', conv_id, text, NULL, role FROM conversations
    UNION ALL SELECT 'benchmark', item_id, text, NULL, NULL FROM benchmark""")
def unify_sources(v: Views):
    return ingest.unify_sources([
        v.documents.select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text", "lang"),
        v.conversations.select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), "text", "role"),
        v.table("benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text"),
    ])


@query("exclude_multi_attr", """
    SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE value > 300)""")
def exclude_multi_attr(v: Views):
    return ingest.exclude_multi_attr(v.events, F.col("value") > 300, "user_id").select("event_id", "user_id")


@query("union_distinct", with_ctes("matched", """
    SELECT entry_id, version_x AS version, sent_idx_x AS sent_idx FROM matched WHERE sent_idx_x IS NOT NULL
    UNION SELECT entry_id, version_y, sent_idx_y FROM matched WHERE sent_idx_y IS NOT NULL"""))
def union_distinct(v: Views):
    m = v.matched
    x = m.where("sent_idx_x IS NOT NULL").select("entry_id", F.col("version_x").alias("version"), F.col("sent_idx_x").alias("sent_idx"))
    y = m.where("sent_idx_y IS NOT NULL").select("entry_id", F.col("version_y").alias("version"), F.col("sent_idx_y").alias("sent_idx"))
    return x.union(y).distinct()


@query("union_all", """
    SELECT text FROM documents UNION ALL SELECT text FROM conversations""")
def union_all(v: Views):
    return v.documents.select("text").unionByName(v.conversations.select("text"))


@query("difference", """
    SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def difference(v: Views):
    return v.documents.select("doc_id").subtract(v.labels_table.select("doc_id"))


@query("intersection", """
    SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 0""")
def intersection(v: Views):
    return v.documents.select("doc_id").intersect(v.labels_table.where("toxic = 0").select("doc_id"))


@query("distinct", with_ctes("sentences", """
    SELECT DISTINCT entry_id, sentence FROM sentences"""))
def distinct(v: Views):
    return v.sentences.select("entry_id", "sentence").dropDuplicates(["entry_id", "sentence"])


@query("adjacent_versions", with_ctes("entryversion", """
    SELECT x.entry_id, x.version AS version_x, y.version AS version_y, x.title AS title_x, y.title AS title_y
    FROM entryversion x JOIN entryversion y ON x.entry_id = y.entry_id AND y.version = x.version + 1"""))
def adjacent_versions(v: Views):
    return match.adjacent_versions(v.entryversion, ["title"])
