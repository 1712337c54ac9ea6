"""Sentences, tokens and text shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.ctes import with_ctes
from catalog.registry import query
from catalog.views import Views
from verstext.functions import text as tx
from verstext.operators import sentences as sent


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _boilerplate_sql(col: str) -> str:
    tests = [f"contains(lower({col}), {_quoted([p])})" for p in tx.BOILERPLATE_PHRASES]
    tests += [f"starts_with({col}, {_quoted([p])})" for p in tx.BOILERPLATE_STARTS]
    tests += [f"contains({col}, {_quoted([p])})" for p in tx.BOILERPLATE_INSIDE]
    tests += [f"ends_with({col}, {_quoted([p])})" for p in tx.BOILERPLATE_ENDS]
    return "(" + " OR ".join(tests) + ")"


def content_sql(col: str) -> str:
    """Content tokens of a text column in SQL."""
    return (
        f"list_filter(list_transform(list_filter(string_split_regex(lower({col}), '\\s+'), lambda a: a <> ''), "
        r"lambda b: regexp_replace(b, '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')), "
        f"lambda c: c <> '' AND NOT list_contains([{_quoted(tx.STOP_WORDS)}], c))"
    )


@query("split_sentences", r"""
    SELECT doc_id AS entry_id, CAST(unnest(range(len(p))) AS INTEGER) AS sent_idx, unnest(p) AS sentence
    FROM (SELECT doc_id, string_split_regex(text, '[.!?]\s+') AS p FROM documents)""")
def split_sentences(v: Views):
    rows = v.documents.withColumnRenamed("doc_id", "entry_id")
    return sent.split_sentences(rows, "text", ["entry_id"])


@query("split_paragraph_sentences", r"""
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY par_idx, i) - 1 AS INTEGER) AS sent_idx,
           CAST(par_idx AS INTEGER) AS par_idx, sentence
    FROM (SELECT doc_id, par_idx, unnest(range(len(s))) AS i, unnest(s) AS sentence
          FROM (SELECT doc_id, unnest(range(len(p))) AS par_idx,
                       string_split_regex(unnest(p), '[.!?]\s+') AS s
                FROM (SELECT doc_id, string_split(replace(text, chr(10), '</p><p>'), '</p><p>') AS p FROM documents)))""")
def split_paragraph_sentences(v: Views):
    rows = v.documents.withColumn("text", F.regexp_replace("text", "\n", tx.PARAGRAPH_BREAK))
    return sent.split_paragraph_sentences(rows, "text", ["doc_id"])


@query("filter_boilerplate", with_ctes("sentences", f"""
    SELECT entry_id, version, sent_idx, sentence FROM sentences WHERE NOT {_boilerplate_sql('sentence')}"""))
def filter_boilerplate(v: Views):
    return sent.filter_boilerplate(v.sentences).select("entry_id", "version", "sent_idx", "sentence")


@query("dateline", r"""
    SELECT doc_id, head AS dateline, CASE WHEN head IS NULL THEN t ELSE trim(substr(t, strpos(t, '—') + 1)) END AS body
    FROM (SELECT doc_id, t, CASE WHEN contains(t, '—')
                AND len(list_filter(string_split_regex(split_part(t, '—', 1), '\s+'), lambda x: x <> '')) < 6
                AND len(list_filter(string_split_regex(split_part(t, '—', 1), '\s+'),
                        lambda x: x <> '' AND upper(x) = x AND lower(x) <> x)) > 0
           THEN trim(split_part(t, '—', 1)) END AS head
          FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 'LONDON, ' || upper(source) || ' — ' || text
                WHEN 'de' THEN 'In a quiet place — ' || text ELSE text END AS t FROM documents))""")
def dateline(v: Views):
    lead = (
        F.when(F.col("lang") == "en", F.concat(F.lit("LONDON, "), F.upper("source"), F.lit(" — "), "text"))
        .when(F.col("lang") == "de", F.concat(F.lit("In a quiet place — "), "text")).otherwise(F.col("text"))
    )
    rows = v.documents.select("doc_id", lead.alias("t"))
    return sent.split_dateline(rows, "t").select("doc_id", "dateline", "body")


@query("dateline_places", """
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT contains(n_name, ' ') THEN 'Near ' || n_name_init || ' today' END AS dateline
    FROM (SELECT doc_id, n_name, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS n_name_init
          FROM documents JOIN nation ON n_nationkey = doc_id % 25)""")
def dateline_places(v: Views):
    nation = v.table("nation")
    names = nation.agg(F.collect_set(F.lower("n_name"))).scalar()
    near = F.concat(F.upper(F.substring("n_name", 1, 1)), F.lower(F.expr("substring(n_name, 2)")))
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Near "), near, F.lit(" today"))).otherwise(F.lit("Far from here"))
    rows = v.documents.join(nation, F.col("n_nationkey") == F.col("doc_id") % 25)
    rows = rows.select("doc_id", F.concat(head, F.lit(" — "), "text").alias("t")).withColumn("places", names)
    return sent.split_dateline(rows, "t", dashes=("—",), places=F.col("places")).select("doc_id", "dateline")


_MARKED_SQL = "CASE sent_idx % 4 WHEN 1 THEN '1. ' WHEN 2 THEN '(a) iv. ' WHEN 3 THEN '(' || sent_idx || ') b. (ii) ' ELSE '' END || sentence"


def _marks_sql(column: str) -> str:
    for mark in tx.LIST_MARKS:
        column = f"regexp_replace({column}, '{mark.replace('WORD', '[' + chr(92) + 'p{L}' + chr(92) + 'p{N}_]')}', '', 'g')"
    return column


@query("strip_list_marks", with_ctes("sentences", f"""
    , t AS (SELECT entry_id, version, sent_idx, {_MARKED_SQL} AS text FROM sentences),
    passes AS (WITH RECURSIVE r AS (
        SELECT entry_id, version, sent_idx, text, {_marks_sql('text')} AS next FROM t
        UNION ALL SELECT entry_id, version, sent_idx, next, {_marks_sql('next')} FROM r WHERE next <> text)
      SELECT * FROM r)
    SELECT entry_id, version, sent_idx, text FROM passes WHERE next = text"""))
def strip_list_marks(v: Views):
    kind = F.col("sent_idx") % 4
    mark = (
        F.when(kind == 1, "1. ").when(kind == 2, "(a) iv. ")
        .when(kind == 3, F.concat(F.lit("("), F.col("sent_idx").cast("string"), F.lit(") b. (ii) "))).otherwise("")
    )
    return v.sentences.select("entry_id", "version", "sent_idx", tx.strip_list_marks(F.concat(mark, "sentence")).alias("text"))


@query("words", with_ctes("words", """
    SELECT entry_id, version, sent_idx, word_idx, token, CAST(num_words AS INTEGER) AS num_words FROM words"""))
def words(v: Views):
    return v.words.select("entry_id", "version", "sent_idx", "word_idx", "token", "num_words")


@query("sentence_word_count", with_ctes("turn_words", """
    SELECT entry_id, version, sent_idx, word_idx, token, num_words FROM turn_words"""))
def sentence_word_count(v: Views):
    keys = ["entry_id", "version", "sent_idx"]
    return sent.sentence_word_count(v.turn_words.drop("num_words"), keys).select(*keys, "word_idx", "token", "num_words")


@query("drop_null_vectors", with_ctes("turn_words vectors", """
    SELECT entry_id, version, sent_idx, word_idx, token FROM turn_words w
    JOIN (SELECT vec_id FROM embeddings WHERE label <> 0) e ON e.vec_id = w.word"""))
def drop_null_vectors(v: Views):
    known = v.embeddings.where("label <> 0").select("vec_id", "embedding")
    rows = sent.attach_vectors(v.turn_words, known)
    return sent.drop_null_vectors(rows).select("entry_id", "version", "sent_idx", "word_idx", "token")


@query("join_sentences", with_ctes("sentences", """
    SELECT entry_id, version, string_agg(sentence, '<SENT>' ORDER BY sent_idx) AS sentences FROM sentences GROUP BY ALL"""))
def join_sentences(v: Views):
    return sent.join_sentences(v.sentences)


@query("content_tokens", f"SELECT doc_id, array_to_string({content_sql('text')}, ' ') AS content FROM documents")
def content_tokens(v: Views):
    return v.documents.select("doc_id", F.array_join(tx.content_tokens("text"), " ").alias("content"))


NGRAM_SQL = f"""
    WITH t AS (SELECT doc_id, source, {content_sql('text')} AS t FROM documents),
    g AS (SELECT doc_id, source, unnest(t) AS ngram FROM t
          UNION ALL SELECT doc_id, source, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM t)"""


@query("ngram_counts", NGRAM_SQL + """
    SELECT ngram, count(*) AS n, count(DISTINCT doc_id) AS doc_freq FROM g GROUP BY ngram
    HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) <= 0.5 * (SELECT count(*) FROM documents)""")
def ngram_counts(v: Views):
    return sent.ngram_counts(v.documents, "text", "doc_id", min_df=3, max_df=0.5)


@query("rebuild_story", with_ctes("sentences", """
    SELECT entry_id, version, string_agg(sentence, ' ' ORDER BY sent_idx) AS story, count(*) AS num_sents
    FROM sentences GROUP BY ALL"""))
def rebuild_story(v: Views):
    known = v.sentences.where("entry_id IS NOT NULL AND version IS NOT NULL")
    return sent.join_sentences(known, ["entry_id", "version"], separator=" ", out="story", count="num_sents")


@query("text_length_hist", r"""
    SELECT CAST(floor(len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> '')) / 50) * 50 AS BIGINT) AS bin_start,
           count(*) AS n FROM documents GROUP BY 1""")
def text_length_hist(v: Views):
    return sent.text_length_hist(v.documents, "text", 50)


@query("paragraph_frequency", with_ctes("sentences", """
    SELECT sentence AS paragraph, count(*) AS n FROM sentences GROUP BY 1 ORDER BY n DESC, paragraph LIMIT 50"""))
def paragraph_frequency(v: Views):
    return sent.paragraph_frequency(v.entryversion, "summary", 50)


@query("dateline_counts", r"""
    WITH h AS (SELECT trim(split_part(text, ',', 1)) AS dateline FROM documents WHERE contains(text, ','))
    SELECT dateline, count(*) AS n FROM h WHERE len(list_filter(string_split_regex(dateline, '\s+'), lambda x: x <> '')) < 7
    GROUP BY 1""")
def dateline_counts(v: Views):
    return sent.dateline_counts(v.documents, "text", ",")


@query("mean_vector", with_ctes("turn_words vectors", """
    SELECT entry_id, version, sent_idx, CAST(dim AS INTEGER) AS dim, round(avg(value), 6) AS value
    FROM (SELECT entry_id, version, sent_idx, unnest(range(len(vector))) AS dim, unnest(vector) AS value
          FROM turn_words w JOIN vectors e ON e.vec_id = w.word) GROUP BY entry_id, version, sent_idx, dim"""))
def mean_vector(v: Views):
    out = sent.mean_vector(v.turn_words, v.vectors, ["entry_id", "version", "sent_idx"])
    return out.withColumn("value", F.round("value", 6))


TERMS = ("the", "ion", "und")


@query("highlight_terms", r"""
    SELECT doc_id, regexp_replace(text, '(?i)(the|ion|und)', '<m>\1</m>', 'g') AS marked FROM documents""")
def highlight_terms(v: Views):
    return v.documents.select("doc_id", tx.highlight("text", TERMS).alias("marked"))


@query("hash_uniform", with_ctes("sentences", """
    SELECT entry_id, version, sent_idx,
           CAST('0x' || substr(md5(entry_id || '-' || version || '-' || sent_idx), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u
    FROM sentences"""))
def hash_uniform(v: Views):
    from verstext.functions.uniform import hash_uniform as u, key_of

    keys = ["entry_id", "version", "sent_idx"]
    return v.sentences.select(*keys, u(key_of(*keys)).alias("u"))
