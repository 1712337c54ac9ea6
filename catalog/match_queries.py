"""Sentence matching and the joins around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.ctes import with_ctes
from catalog.registry import query
from catalog.views import CONFIG, NORM_X_CONFIG, VECTOR_CONFIG, Views
from verstext.functions import grams, similarity, vector
from verstext.functions import text as tx
from verstext.operators import align, match

DIST = ["avg_sentence_distance_x", "avg_sentence_distance_y"]


def _rounded(df, *cols):
    return df.withColumns({c: F.round(c, 6) for c in cols})


@query("l2_normalise", with_ctes("vectors", """
    SELECT vec_id, CAST(unnest(range(len(vector))) AS INTEGER) AS dim, round(unnest(vector), 6) AS value FROM vectors"""))
def l2_normalise(v: Views):
    return v.embeddings.select("vec_id", F.posexplode(vector.l2_normalise("embedding")).alias("dim", "value")).select(
        "vec_id", "dim", F.round("value", 6).alias("value"))


@query("near_vectors", with_ctes("near_vectors", "SELECT word_a, word_b, round(distance, 6) AS distance FROM near_vectors"))
def near_vectors(v: Views):
    return _rounded(v.make_near(), "distance")


def _pairs_sql(near: str, p: str = "") -> str:
    """The scoring steps on the word pairs of one list of near words; table names begin with ``p``."""
    steps = []
    for side, other in ("xy", "yx"):
        s = "" if side == "x" else "_y"
        steps.append(f"""
    {p}minima{s} AS (SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y, word_idx_{side},
        min(num_words_{side}) AS num_words, min(distance) AS min_word_distance FROM {p}pairs GROUP BY ALL),
    {p}scored{s} AS (SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y,
        round((sum(min_word_distance) + 1.2 * (min(num_words) - count(*))) / min(num_words), 9) AS avg_sentence_distance
      FROM {p}minima{s} GROUP BY ALL),
    {p}best{s} AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, version_x, sent_idx_{side}
        ORDER BY avg_sentence_distance, abs(sent_idx_x - sent_idx_y), sent_idx_{other}) AS rn FROM {p}scored{s}) WHERE rn = 1)""")
    return f"""
    , {p}pairs AS (SELECT x.entry_id, x.version AS version_x, y.version AS version_y, x.sent_idx AS sent_idx_x,
        y.sent_idx AS sent_idx_y, x.word_idx AS word_idx_x, y.word_idx AS word_idx_y,
        x.num_words AS num_words_x, y.num_words AS num_words_y, nv.distance
      FROM turn_words x JOIN {near} nv ON nv.word_a = x.word
      JOIN turn_words y ON y.entry_id = x.entry_id AND y.version = x.version + 1 AND y.word = nv.word_b),{",".join(steps)}
"""


PAIRS_SQL = _pairs_sql("near_vectors")
MATCH_CTES = "turn_words near_vectors"


@query("exact_similarity_join", with_ctes(MATCH_CTES, PAIRS_SQL + """
    SELECT entry_id, version_x, sent_idx_x, sent_idx_y, word_idx_x, word_idx_y, round(distance, 6) AS distance FROM pairs"""))
def exact_similarity_join(v: Views):
    return _rounded(v.turn_pairs, "distance").select(
        "entry_id", "version_x", "sent_idx_x", "sent_idx_y", "word_idx_x", "word_idx_y", "distance")


@query("lsh_near_vectors", with_ctes("lsh_near", "SELECT word_a, word_b, round(distance, 6) AS distance FROM lsh_near"))
def lsh_near_vectors(v: Views):
    return _rounded(v.lsh_near, "distance")


@query("lsh_similarity_join", with_ctes(MATCH_CTES + " lsh_near", _pairs_sql("lsh_near") + """
    SELECT entry_id, version_x, sent_idx_x, sent_idx_y, word_idx_x, word_idx_y, round(distance, 6) AS distance FROM pairs"""))
def lsh_similarity_join(v: Views):
    found = _rounded(match.word_pairs(v.turn_words, v.lsh_near), "distance")
    return found.select("entry_id", "version_x", "sent_idx_x", "sent_idx_y", "word_idx_x", "word_idx_y", "distance")


def _matches_sql(p: str) -> str:
    cut = "CASE WHEN avg_sentence_distance < 0.9 THEN sent_idx_%s END"
    return (f"SELECT entry_id, version_x, sent_idx_x, {cut % 'y'} AS sent_idx_y FROM {p}best "
            f"UNION SELECT entry_id, version_x, {cut % 'x'}, sent_idx_y FROM {p}best_y")


@query("lsh_recall", with_ctes(MATCH_CTES + " lsh_near", _pairs_sql("near_vectors", "e_") + _pairs_sql("lsh_near", "l_") + f"""
    , e_all AS ({_matches_sql("e_")}), l_all AS ({_matches_sql("l_")}),
    n AS (SELECT (SELECT count(*) FROM (SELECT * FROM e_all INTERSECT SELECT * FROM l_all)) AS agree,
                 (SELECT count(*) FROM l_all) AS found, (SELECT count(*) FROM e_all) AS exact)
    SELECT agree, found, exact, round(agree / exact, 6) AS recall FROM n"""))
def lsh_recall(v: Views):
    found = match.match_steps(match.word_pairs(v.turn_words, v.lsh_near), VECTOR_CONFIG)
    return _rounded(align.match_agreement(found, match.match_steps(v.turn_pairs, VECTOR_CONFIG)).withColumns(
        {c: F.col(c).cast("long") for c in ("agree", "found", "exact")}), "recall")


@query("word_min_distance", with_ctes(MATCH_CTES, PAIRS_SQL + """
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y, word_idx_x, CAST(num_words AS INTEGER) AS num_words,
           round(min_word_distance, 6) AS min_word_distance FROM minima"""))
def word_min_distance(v: Views):
    return _rounded(match.word_min_distance(v.turn_pairs, "x"), "min_word_distance")


def _scored(v: Views):
    return match.sentence_distance(match.word_min_distance(v.turn_pairs, "x"), VECTOR_CONFIG)


@query("sentence_distance", with_ctes(MATCH_CTES, PAIRS_SQL + """
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y,
           round(avg_sentence_distance, 6) AS avg_sentence_distance FROM scored"""))
def sentence_distance(v: Views):
    return _rounded(_scored(v), "avg_sentence_distance")


@query("best_match", with_ctes(MATCH_CTES, PAIRS_SQL + """
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y,
           round(avg_sentence_distance, 6) AS avg_sentence_distance FROM best"""))
def best_match(v: Views):
    return _rounded(match.best_match(_scored(v), "x"), "avg_sentence_distance")


@query("apply_threshold", with_ctes(MATCH_CTES, PAIRS_SQL + """
    SELECT entry_id, version_x, version_y, sent_idx_x,
           CASE WHEN avg_sentence_distance < 0.9 THEN sent_idx_y END AS sent_idx_y,
           CASE WHEN avg_sentence_distance < 0.9 THEN round(avg_sentence_distance, 6) END AS avg_sentence_distance FROM best"""))
def apply_threshold(v: Views):
    return _rounded(match.apply_threshold(match.best_match(_scored(v), "x"), "x", VECTOR_CONFIG), "avg_sentence_distance")


MATCH_COLS = """entry_id, version_x, version_y, sent_idx_x, sent_idx_y,
    round(avg_sentence_distance_x, 6) AS avg_sentence_distance_x, round(avg_sentence_distance_y, 6) AS avg_sentence_distance_y"""


@query("match_bidirectional", with_ctes("matched", f"SELECT {MATCH_COLS} FROM matched"))
def match_bidirectional(v: Views):
    return _rounded(v.make_matched(), *DIST)


@query("match_by_vectors", with_ctes("t_matched", f"SELECT {MATCH_COLS} FROM t_matched"))
def match_by_vectors(v: Views):
    return _rounded(v.turn_matched, *DIST)


@query("match_by_vectors_in_production", with_ctes("prod_matched", f"SELECT {MATCH_COLS} FROM prod_matched"))
def match_by_vectors_in_production(v: Views):
    found = match.match_bidirectional(v.turns, words=v.turn_words, near=v.production_near, config=CONFIG)
    return _rounded(found, *DIST)


@query("match_by_old_length", with_ctes("nx_matched", f"SELECT {MATCH_COLS} FROM nx_matched"))
def match_by_old_length(v: Views):
    return _rounded(match.match_bidirectional(v.turns, words=v.turn_words, near=v.turn_near, config=NORM_X_CONFIG), *DIST)


@query("complete_matches", with_ctes("matched sentences", """
    , kept AS (SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y FROM matched
               WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL)
    SELECT * FROM kept
    UNION ALL
    SELECT entry_id, version, CAST(version + 1 AS INTEGER), sent_idx, NULL FROM sentences s
    WHERE EXISTS (SELECT 1 FROM sentences o WHERE o.entry_id = s.entry_id AND o.version = s.version + 1)
      AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.entry_id = s.entry_id AND k.version_x = s.version AND k.sent_idx_x = s.sent_idx)
    UNION ALL
    SELECT entry_id, CAST(version - 1 AS INTEGER), version, NULL, sent_idx FROM sentences s
    WHERE EXISTS (SELECT 1 FROM sentences o WHERE o.entry_id = s.entry_id AND o.version = s.version - 1)
      AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.entry_id = s.entry_id AND k.version_y = s.version AND k.sent_idx_y = s.sent_idx)"""))
def complete_matches(v: Views):
    lost = v.matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL")
    return match.complete_matches(lost, v.sentences).select("entry_id", "version_x", "version_y", "sent_idx_x", "sent_idx_y")


EDGES_SQL = """
    , edges AS (SELECT m.entry_id, m.version_x, m.sent_idx_x, m.sent_idx_y, x.sentence AS sentence_x, y.sentence AS sentence_y,
                       list_filter(string_split_regex(lower(x.sentence), '\\s+'), lambda w: w <> '') AS tx,
                       list_filter(string_split_regex(lower(y.sentence), '\\s+'), lambda w: w <> '') AS ty
      FROM matched m JOIN sentences x ON x.entry_id = m.entry_id AND x.version = m.version_x AND x.sent_idx = m.sent_idx_x
      JOIN sentences y ON y.entry_id = m.entry_id AND y.version = m.version_y AND y.sent_idx = m.sent_idx_y)"""
EDGE = ["entry_id", "version_x", "sent_idx_x", "sent_idx_y"]
EDGE_COLS = ", ".join(EDGE)


def _edges(v: Views):
    return align.attach_sentences(v.matched, v.sentences).where("sentence_x IS NOT NULL AND sentence_y IS NOT NULL")


def _runs_of(k: int, columns: str = "") -> str:
    """One row for each run of ``k`` tokens of ``l``; the tokens of a run come from lists unnested side by side."""
    tokens = ", ".join(f"unnest(t[{j + 1}:len(t) - {k - 1 - j}]) AS t{j}" for j in range(k))
    run = " || ' ' || ".join(f"t{j}" for j in range(k))
    place = f", unnest(range(1, len(t) - {k - 2})) AS i" if "i" in columns else ""
    return f"SELECT {EDGE_COLS}, side, {columns}{run} AS g FROM (SELECT {EDGE_COLS}, side, {tokens}{place} FROM l WHERE len(t) >= {k})"


SIDES_SQL = EDGES_SQL + f"""
    , n AS (SELECT {EDGE_COLS}, len(tx) AS nx, len(ty) AS ny FROM edges),
    l AS (SELECT {EDGE_COLS}, 'x' AS side, tx AS t FROM edges UNION ALL SELECT {EDGE_COLS}, 'y', ty FROM edges)"""


def _coverage_sql(k: int) -> str:
    spots = " UNION ".join(f"SELECT {EDGE_COLS}, side, i + {j} AS i FROM hit" for j in range(k))
    return with_ctes("matched sentences", SIDES_SQL + f"""
    , e AS ({_runs_of(k, "i, ")}),
    both_sides AS (SELECT {EDGE_COLS}, g FROM e GROUP BY ALL HAVING min(side) < max(side)),
    hit AS (SELECT {EDGE_COLS}, side, i FROM e JOIN both_sides USING ({EDGE_COLS}, g)),
    c AS (SELECT {EDGE_COLS}, count(*) FILTER (side = 'x') AS cx, count(*) FILTER (side = 'y') AS cy FROM ({spots}) GROUP BY ALL)
    SELECT {EDGE_COLS}, round(coalesce(cx, 0) / nullif(nx, 0), 6) AS coverage_x,
           round(coalesce(cy, 0) / nullif(ny, 0), 6) AS coverage_y FROM n LEFT JOIN c USING ({EDGE_COLS})""")


def _coverage(k: int):
    def run(v: Views):
        return _rounded(grams.shared_kgram_coverage(_edges(v), EDGE, "sentence_x", "sentence_y", k), "coverage_x", "coverage_y")

    return run


for _k, _name in ((1, "shared_token_coverage"), (2, "shared_kgram_coverage"), (3, "shared_trigram_coverage"), (4, "shared_4gram_coverage")):
    query(_name, _coverage_sql(_k))(_coverage(_k))


FOLD = f"regexp_replace(translate(%s, '{tx.ACCENTED}', '{tx.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')"


@query("edit_similarity", with_ctes("matched sentences", EDGES_SQL + f"""
    , f AS (SELECT {EDGE_COLS}, {FOLD % 'sentence_x'} AS a, {FOLD % 'sentence_y'} AS b FROM edges)
    SELECT {EDGE_COLS}, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0
        ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS similarity FROM f"""))
def edit_similarity(v: Views):
    return _edges(v).select(*EDGE, F.round(similarity.edit_similarity("sentence_x", "sentence_y"), 6).alias("similarity"))


@query("edit_similarity_sql", with_ctes("matched sentences", EDGES_SQL + f"""
    , f AS (SELECT {EDGE_COLS}, {FOLD % 'sentence_x'} AS a, {FOLD % 'sentence_y'} AS b FROM edges)
    SELECT {EDGE_COLS}, round(CASE WHEN greatest(length(a), length(b)) = 0 THEN 1.0
        ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS similarity FROM f"""))
def edit_similarity_sql(v: Views):
    similarity.register_sql_functions(v.spark)
    folded = _edges(v).select(*EDGE, tx.fold_latin("sentence_x").alias("a"), tx.fold_latin("sentence_y").alias("b"))
    return folded.selectExpr(*EDGE, "round(edit_similarity(a, b), 6) AS similarity")


@query("token_bag_ratio", with_ctes("matched sentences", EDGES_SQL + f"""
    , bx AS (SELECT {EDGE_COLS}, unnest(tx) AS w, 1 AS a, 0 AS b FROM edges UNION ALL SELECT {EDGE_COLS}, unnest(ty), 0, 1 FROM edges),
    c AS (SELECT {EDGE_COLS}, w, sum(a) AS a, sum(b) AS b FROM bx GROUP BY ALL)
    SELECT {EDGE_COLS}, round(2 * sum(least(a, b)) / sum(a + b), 6) AS ratio FROM c GROUP BY ALL"""))
def token_bag_ratio(v: Views):
    return _rounded(grams.token_bag_ratio(_edges(v), EDGE, "sentence_x", "sentence_y"), "ratio")


def _precision_sql(weights: tuple[float, ...]) -> str:
    used = [(k, w) for k, w in enumerate(weights, start=1) if w > 0]
    parts = [
        f"SELECT {EDGE_COLS}, {k} AS k, sum(least(a, b)) / sum(a) AS p FROM (SELECT {EDGE_COLS}, g, count(*) FILTER (side = 'x') AS a, "
        f"count(*) FILTER (side = 'y') AS b FROM e{k} GROUP BY ALL) GROUP BY ALL HAVING sum(least(a, b)) > 0"
        for k, _ in used
    ]
    runs = [f"e{k} AS ({_runs_of(k)})" for k, _ in used]
    weight = "CASE k " + " ".join(f"WHEN {k} THEN {w!r}" for k, w in used) + " END"
    return with_ctes("matched sentences", SIDES_SQL + f"""
    , {", ".join(runs)},
    p AS ({" UNION ALL ".join(parts)}),
    s AS (SELECT {EDGE_COLS}, exp(sum({weight} * ln(p))) AS m FROM p GROUP BY ALL HAVING count(*) = {len(used)})
    SELECT {EDGE_COLS}, round(CASE WHEN ny > 0 THEN coalesce(least(1.0, exp(1 - ny / nx)) * m, 0.0) ELSE 0.0 END, 6) AS score
    FROM n LEFT JOIN s USING ({EDGE_COLS})""")


def _precision(weights: tuple[float, ...]):
    def run(v: Views):
        return _rounded(grams.ngram_precision(_edges(v), EDGE, "sentence_x", "sentence_y", weights), "score")

    return run


for _name, _weights in (
    ("unigram_precision_similarity", (1.0,)), ("bigram_precision_similarity", (0.0, 1.0)), ("trigram_precision_similarity", (0.0, 0.0, 1.0)),
    ("ngram_precision_similarity", (0.5, 0.5)), ("mixed_precision_similarity", (0.33, 0.33, 0.34)),
):
    query(_name, _precision_sql(_weights))(_precision(_weights))


@query("changed_headline_entries", with_ctes("entryversion", """
    , ch AS (SELECT x.entry_id, x.version AS version_x, x.title AS title_x, y.title AS title_y
             FROM entryversion x JOIN entryversion y ON x.entry_id = y.entry_id AND y.version = x.version + 1
             WHERE x.title <> y.title)
    SELECT * FROM ch WHERE entry_id IN (SELECT entry_id FROM ch GROUP BY 1 HAVING count(*) = 2)"""))
def changed_headline_entries(v: Views):
    return align.changed_headline_entries(v.entryversion, 2)


@query("max_word_similarity", with_ctes("t_matched turn_words vectors", f"""
    , p AS (SELECT m.entry_id, m.version_x, m.sent_idx_x, m.sent_idx_y, x.word_idx AS wx, y.word_idx AS wy, list_cosine_similarity(a.vector, b.vector) AS cosine
      FROM (SELECT * FROM t_matched WHERE sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL) m
      JOIN turn_words x ON x.entry_id = m.entry_id AND x.version = m.version_x AND x.sent_idx = m.sent_idx_x
      JOIN turn_words y ON y.entry_id = m.entry_id AND y.version = m.version_y AND y.sent_idx = m.sent_idx_y
      JOIN vectors a ON a.vec_id = x.word JOIN vectors b ON b.vec_id = y.word),
    sx AS (SELECT {EDGE_COLS}, avg(best) AS similarity_x FROM (SELECT {EDGE_COLS}, wx, max(cosine) AS best FROM p GROUP BY ALL) GROUP BY ALL),
    sy AS (SELECT {EDGE_COLS}, avg(best) AS similarity_y FROM (SELECT {EDGE_COLS}, wy, max(cosine) AS best FROM p GROUP BY ALL) GROUP BY ALL)
    SELECT {EDGE_COLS}, round(similarity_x, 6) AS similarity_x, round(similarity_y, 6) AS similarity_y FROM sx JOIN sy USING ({EDGE_COLS})"""))
def max_word_similarity(v: Views):
    return _rounded(align.max_word_similarity(v.turn_matched, v.turn_words, v.vectors), "similarity_x", "similarity_y")


@query("attach_sentences", with_ctes("matched sentences", """
    SELECT m.entry_id, m.version_x, m.sent_idx_x, m.sent_idx_y, x.sentence AS sentence_x, y.sentence AS sentence_y
    FROM matched m
    LEFT JOIN sentences x ON x.entry_id = m.entry_id AND x.version = m.version_x AND x.sent_idx = m.sent_idx_x
    LEFT JOIN sentences y ON y.entry_id = m.entry_id AND y.version = m.version_y AND y.sent_idx = m.sent_idx_y"""))
def attach_sentences(v: Views):
    return align.attach_sentences(v.matched, v.sentences).select(*EDGE, "sentence_x", "sentence_y")


@query("doc_size_band", with_ctes("matched sentences", """
    , ok AS (SELECT entry_id, version FROM sentences GROUP BY ALL HAVING count(*) < 30 AND count(*) > 3)
    SELECT entry_id, version_x, version_y, sent_idx_x, sent_idx_y FROM matched m
    WHERE EXISTS (SELECT 1 FROM ok WHERE ok.entry_id = m.entry_id AND ok.version = m.version_x)
      AND EXISTS (SELECT 1 FROM ok WHERE ok.entry_id = m.entry_id AND ok.version = m.version_y)"""))
def doc_size_band(v: Views):
    return align.matches_in_size_band(v.matched, v.sentences, 3, 30).select(
        "entry_id", "version_x", "version_y", "sent_idx_x", "sent_idx_y")


@query("edited_sentence_keys", with_ctes("matched sentences", """
    , e AS (SELECT * FROM matched WHERE avg_sentence_distance_x > 0.1 AND avg_sentence_distance_y > 0.1)
    SELECT s.entry_id, s.version, s.sent_idx, s.sentence FROM sentences s SEMI JOIN
      (SELECT entry_id, version_x AS version, sent_idx_x AS sent_idx FROM e
       UNION SELECT entry_id, version_y, sent_idx_y FROM e) k
      ON k.entry_id = s.entry_id AND k.version = s.version AND k.sent_idx = s.sent_idx"""))
def edited_sentence_keys(v: Views):
    return align.edited_sentences(v.matched, v.sentences).select("entry_id", "version", "sent_idx", "sentence")


# The edits that a sentence may have in its document. One of EDITS + 1 pieces of it is left as it is, so places are tried around the
# occurrences of the beginnings of the pieces. The distance counts bytes: other characters are replaced by
# control characters, of which there are enough for 26 different ones in a pair.
EDITS = 5
GRAMS = [1, 2, 4, 8, 12, 16]
_PLAIN_SQL = f"translate(%s, '{tx.ACCENTED}', '{tx.PLAIN}')"
_CONTROLS_SQL = "array_to_string(list_transform(list_concat(range(1, 9), range(14, 32)), lambda c: chr(CAST(c AS INTEGER))), '')"


@query("locate_sentences", with_ctes("sentences", rf"""
    , p AS MATERIALIZED (SELECT s.entry_id, s.version, s.sent_idx, s.sentence, nullif(strpos(d.text, s.sentence), 0) AS pos
            FROM sentences s JOIN documents d ON d.doc_id = s.entry_id),
    lost AS MATERIALIZED (SELECT *, row_number() OVER () AS n, length(b) AS size FROM (
            SELECT DISTINCT entry_id, sentence, {_PLAIN_SQL % 'sentence'} AS b FROM p WHERE pos IS NULL AND length(sentence) > {EDITS})),
    plain AS MATERIALIZED (SELECT doc_id AS entry_id, {_PLAIN_SQL % 'text'} AS t, most FROM documents
            JOIN (SELECT entry_id, max(size) AS most FROM lost GROUP BY ALL) m ON m.entry_id = doc_id),
    letters AS MATERIALIZED (SELECT entry_id, most, string_split(t, '') AS c FROM plain),
    cut AS (SELECT entry_id, n, size * i // {EDITS + 1} AS skip, b[size * i // {EDITS + 1} + 1:size * (i + 1) // {EDITS + 1}] AS piece
            FROM lost, range({EDITS + 1}) r(i)),
    sized AS (SELECT *, list_max(list_filter({GRAMS}, lambda g: g <= length(piece))) AS q FROM cut),
    parts AS MATERIALIZED (SELECT entry_id, k, array_to_string(c[256 * k + 1:256 * k + 256 + greatest(most, {GRAMS[-1]})], '') AS part
              FROM (SELECT *, unnest(range(len(c) // 256 + 1)) AS k FROM letters)),
    spots AS (SELECT entry_id, q, 256 * k + i AS spot, substr(part, i, q) AS gram
              FROM (SELECT entry_id, k, part, unnest(range(1, 257)) AS i FROM (SELECT entry_id, k, part[1:{256 + GRAMS[-1]}] AS part FROM parts)),
                   (SELECT unnest({GRAMS}) AS q)),
    met AS (SELECT DISTINCT z.entry_id, n, spot - skip AS middle FROM (SELECT entry_id, n, skip, q, piece[1:q] AS gram FROM sized) z
            JOIN spots g ON g.entry_id = z.entry_id AND g.q = z.q AND g.gram = z.gram),
    tried AS (SELECT DISTINCT entry_id, n, middle + s AS place FROM met, range(-{EDITS}, {EDITS + 1}) r(s) WHERE middle + s > 0),
    pairs AS (SELECT l.entry_id, l.n, place, l.b, substr(part, place - 256 * k, size) AS a
              FROM tried JOIN lost l ON l.n = tried.n JOIN parts d ON d.entry_id = tried.entry_id AND d.k = (place - 1) // 256),
    bytes AS (SELECT *, array_to_string(list_distinct(regexp_extract_all(a || b, '[^\x00-\x7F]')), '') AS other, {_CONTROLS_SQL} AS controls
              FROM pairs WHERE length(b) - length(a) <= {EDITS}),
    near AS (SELECT n, min(place) AS place FROM bytes
             WHERE levenshtein(translate(a, other, controls), translate(b, other, controls)) <= {EDITS} GROUP BY ALL),
    placed AS (SELECT l.entry_id, l.sentence, place FROM near JOIN lost l ON l.n = near.n),
    found AS (SELECT p.entry_id, version, sent_idx, coalesce(pos, place) AS start FROM p LEFT JOIN placed n ON n.entry_id = p.entry_id AND n.sentence = p.sentence)
    SELECT entry_id, version, sent_idx, start, start IS NOT NULL AS found,
           coalesce(start < lag(start) OVER (PARTITION BY entry_id, version ORDER BY sent_idx), FALSE) AS out_of_order
    FROM found"""))
def locate_sentences(v: Views):
    docs = v.documents.select(F.col("doc_id").alias("entry_id"), "text")
    return align.locate_sentences(v.sentences, docs, max_edits=EDITS).select(
        "entry_id", "version", "sent_idx", F.col("start").cast("long").alias("start"), "found", "out_of_order")


REBUILT_SQL = r"array_to_string(string_split_regex(text, '[.!?]\s+'), '. ')"


@query("rebuild_distance", f"""
    WITH r AS (SELECT conv_id, turn, {FOLD % 'text'} AS a, {FOLD % REBUILT_SQL} AS b FROM conversations)
    SELECT conv_id, turn, levenshtein(a, b) AS distance FROM r""")
def rebuild_distance(v: Views):
    rebuilt = F.array_join(tx.sentence_pieces("text"), ". ")
    return v.conversations.select(
        "conv_id", "turn", F.levenshtein(tx.fold_latin("text"), tx.fold_latin(rebuilt)).cast("long").alias("distance"))


@query("match_distance_hist", with_ctes("matched", """
    SELECT CAST(floor(coalesce(avg_sentence_distance_x, avg_sentence_distance_y) * 20) AS BIGINT) AS bin, count(*) AS n
    FROM matched WHERE coalesce(avg_sentence_distance_x, avg_sentence_distance_y) IS NOT NULL GROUP BY 1"""))
def match_distance_hist(v: Views):
    d = F.coalesce(*DIST)
    return v.matched.where(d.isNotNull()).groupBy(F.floor(d * 20).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
