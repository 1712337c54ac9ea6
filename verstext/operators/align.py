"""Joins between match tables and the sentences they refer to."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType

from verstext.functions.text import ACCENTED, PLAIN
from verstext.operators.attached import attach_values
from verstext.operators.frequent import join_by_word
from verstext.operators.match import SENT_PAIR, adjacent_versions
from verstext.runtime import materialise

EDGE = ["entry_id", "version_x", "sent_idx_x", "sent_idx_y"]
PLACES, FEW_PLACES = 4096, 20  # places of a text that are looked at together, and how few are looked at one by one


def attach_sentences(matched: DataFrame, sentences: DataFrame) -> DataFrame:
    """Texts of both ends next to every match row; NULL where a side is absent."""
    return attach_values(matched, sentences.withColumn("value", F.col("sentence")), ("sentence_x", "sentence_y"))


def doc_size_band(sentences: DataFrame, low: int, high: int) -> DataFrame:
    """(entry_id, version) with low < number of sentences < high."""
    sizes = sentences.groupBy("entry_id", "version").agg(F.count(F.lit(1)).alias("_n"))
    return sizes.where((F.col("_n") > low) & (F.col("_n") < high)).select("entry_id", "version")


def matches_in_size_band(matched: DataFrame, sentences: DataFrame, low: int, high: int) -> DataFrame:
    """Match rows both of whose versions lie in the size band."""
    band = doc_size_band(sentences, low, high)
    for side in ("version_x", "version_y"):
        matched = matched.join(band.toDF("entry_id", side), ["entry_id", side], "left_semi")
    return matched


def edited_sentences(matched: DataFrame, sentences: DataFrame, min_distance: float = 0.1) -> DataFrame:
    """Texts of the sentences on either side of a match with both distances above a cut."""
    edited = matched.where(
        (F.col("avg_sentence_distance_x") > min_distance) & (F.col("avg_sentence_distance_y") > min_distance)
    )
    cols = ["entry_id", "version", "sent_idx"]
    keys = edited.select("entry_id", "version_x", "sent_idx_x").toDF(*cols).union(
        edited.select("entry_id", "version_y", "sent_idx_y").toDF(*cols)
    ).distinct()
    return sentences.join(keys, cols, "left_semi")


def changed_headline_entries(versions: DataFrame, changes: int) -> DataFrame:
    """Adjacent versions with different titles, of the entries with exactly that many changes."""
    changed = adjacent_versions(versions, ["title"]).where("title_x <> title_y").drop("version_y")
    wanted = changed.groupBy("entry_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == changes)
    return changed.join(wanted.select("entry_id"), "entry_id", "left_semi")


def max_word_similarity(matched: DataFrame, words: DataFrame, vectors: DataFrame) -> DataFrame:
    """For both sides of a match the mean over the words of the greatest cosine to a word of the other sentence.

    The words of a sentence travel as one list with their vectors in a row, so a matched pair is one row
    that holds both lists once, and one product of the two gives both means. Frequent words meet their
    vectors without a shuffle.
    """
    edges = matched.where("sent_idx_x IS NOT NULL AND sent_idx_y IS NOT NULL").select(*EDGE)
    bags = words.groupBy("entry_id", "version", "sent_idx", "word").agg(F.count(F.lit(1)).alias("c"))
    # both are read several times, and the match behind the edges is a long plan
    edges, bags = materialise(edges, "edges"), materialise(bags, "word_bags", "zstd")
    known = join_by_word(bags, vectors.withColumnRenamed("vec_id", "word"), "word")

    def side(name: str) -> DataFrame:
        version = F.col("version") - (1 if name == "y" else 0)
        own = known.groupBy("entry_id", version.alias("version_x"), F.col("sent_idx").alias(f"sent_idx_{name}")).agg(
            F.collect_list(F.struct("c", "vector")).alias("own")
        )
        counts, parts = F.transform("own", lambda w: w["c"]), F.flatten(F.transform("own", lambda w: w["vector"]))
        return own.withColumns({f"count_{name}": counts, f"parts_{name}": parts}).drop("own")

    rows = edges.join(side("x"), ["entry_id", "version_x", "sent_idx_x"]).join(side("y"), ["entry_id", "version_x", "sent_idx_y"])

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {"similarity_x": [], "similarity_y": []}
            for cx, px, cy, py in zip(*(batch[c] for c in ("count_x", "parts_x", "count_y", "parts_y")), strict=True):
                a, b = (np.asarray(p).reshape(len(c), -1) for p, c in ((px, cx), (py, cy)))
                a, b = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (a, b))
                cosine = a @ b.T
                for name, best, counts in (("similarity_x", cosine.max(axis=1), cx), ("similarity_y", cosine.max(axis=0), cy)):
                    found[name].append(float(np.average(best, weights=counts)))
            yield batch[EDGE].assign(**found)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInPandas(compare, ", ".join(f"{c} {kinds[c]}" for c in EDGE) + ", similarity_x double, similarity_y double")


def match_agreement(found: DataFrame, exact: DataFrame) -> DataFrame:
    """How many rows two match tables share, and the share of the exact rows that was found."""
    a = found.select(*SENT_PAIR).withColumn("a", F.lit(1)).withColumn("b", F.lit(0))
    b = exact.select(*SENT_PAIR).withColumn("a", F.lit(0)).withColumn("b", F.lit(1))
    both = a.unionByName(b).groupBy(*SENT_PAIR).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.agg(
        F.sum(F.col("a") * F.col("b")).alias("agree"), F.sum("a").alias("found"), F.sum("b").alias("exact"),
        F.try_divide(F.sum(F.col("a") * F.col("b")), F.sum("b")).alias("recall"),
    )


def _common(a: str, i: int, b: str, j: int) -> int:
    """How many characters ``a`` from ``i`` on and ``b`` from ``j`` on begin with in common."""
    most = min(len(a) - i, len(b) - j)
    same, step, grows = 0, 8, True
    while same < most:
        size = min(step, most - same)
        if a[i + same : i + same + size] == b[j + same : j + same + size]:
            same += size
            step = step * 2 if grows else step
        elif size == 1:
            break
        else:
            step, grows = size // 2, False
    return same


def _within(a: str, b: str, max_edits: int) -> bool:
    """Whether ``max_edits`` edits make ``a`` out of ``b``: how far each number of edits reaches on each diagonal."""
    aim = len(b) - len(a)
    if abs(aim) > max_edits:
        return False
    reach: dict[int, int] = {}
    for edits in range(max_edits + 1):
        before, reach = reach, {}
        for d in range(-edits, edits + 1):
            at = max(before.get(d - 1, -1), before.get(d, -2) + 1, before.get(d + 1, -2) + 1) if edits else 0
            at = min(at, len(a), len(b) - d)
            if at < 0 or at + d < 0:
                continue
            reach[d] = at = at + _common(a, at, b, at + d)
            if d == aim and at == len(a):
                return True
    return False


def _first_within(text: np.ndarray, places: np.ndarray, sentence: np.ndarray, max_edits: int) -> int | None:
    """First of the ``places`` from which on as many characters as the sentence has make it with ``max_edits`` edits.

    Both are of one length, so as many characters come in as go out, and the distances that matter lie within half of
    the edits of the diagonal. All places advance together, character by character, and those out of reach leave.
    """
    half, far = max_edits // 2, max_edits + 1
    for begin in range(0, len(places), PLACES):
        live = places[begin : begin + PLACES]
        cost = np.full((2 * half + 1, len(live)), far, np.int32)
        cost[half:] = np.arange(half + 1)[:, None]
        for i in range(len(sentence)):
            letter = text[live + i]
            now = np.full_like(cost, far)
            for d in range(-half, half + 1):
                used, row = i + 1 + d, now[half + d]
                if not 0 <= used <= len(sentence):
                    continue
                if used:
                    np.add(cost[half + d], letter != sentence[used - 1], out=row)
                if d < half:
                    np.minimum(row, cost[half + d + 1] + 1, out=row)
                if d > -half:
                    np.minimum(row, now[half + d - 1] + 1, out=row)
            cost = now
            if i % 4 == 3:
                near = (cost <= max_edits).any(axis=0)
                if not near.all():
                    live, cost = live[near], cost[:, near]
                if not len(live):
                    break
        if len(live) and (cost[half] <= max_edits).any():
            return int(live[cost[half] <= max_edits][0])
    return None


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _near_place(text: str, sentence: str, max_edits: int, codes: np.ndarray | None = None) -> int | None:
    """First place where ``sentence`` stands in ``text`` with at most ``max_edits`` edits, from 1; None if there is none."""
    size, pieces = len(sentence), max_edits + 1
    if size <= max_edits:
        return None
    middles = set()
    for i in range(pieces):
        begin, end = size * i // pieces, size * (i + 1) // pieces
        piece = sentence[begin:end]
        spot = text.find(piece)
        while spot >= 0:
            middles.add(spot - begin)
            spot = text.find(piece, spot + 1)
    if not middles:
        return None
    last = len(text) - size  # stretches from a later place on are shorter than the sentence
    half = max_edits // 2
    around = np.fromiter(middles, np.int64, len(middles))[:, None]
    whole = np.unique(around + np.arange(-half, half + 1))
    whole = whole[(whole >= 0) & (whole <= last)]
    if len(whole) > FEW_PLACES:
        place = _first_within(_codes(text) if codes is None else codes, whole, _codes(sentence), max_edits)
    else:
        place = next((p for p in whole.tolist() if _within(text[p : p + size], sentence, max_edits)), None)
    if place is None:
        cut = np.unique(around + np.arange(-max_edits, max_edits + 1))
        cut = cut[(cut >= 0) & (cut > last)].tolist()
        place = next((p for p in cut if _within(text[p : p + size], sentence, max_edits)), None)
    return None if place is None else place + 1


_PLAIN_LETTERS = str.maketrans(ACCENTED, PLAIN)


def _places(max_edits: int):
    """A column function: first place, from 1, of each sentence of a list in the text; NULL if there is none."""
    def places(text: str | None, sentences: Iterable[str | None]) -> list[int | None]:
        known: dict[str | None, int | None] = {None: None}
        plain = codes = None
        for s in sentences:
            if s in known:
                continue
            at = -1 if text is None else text.find(s)
            known[s] = at + 1 if at >= 0 else None
            if at < 0 and max_edits and text is not None:
                plain = text.translate(_PLAIN_LETTERS) if plain is None else plain
                codes = _codes(plain) if codes is None else codes
                known[s] = _near_place(plain, s.translate(_PLAIN_LETTERS), max_edits, codes)
        return [known[s] for s in sentences]

    @F.pandas_udf(ArrayType(IntegerType()))
    def found(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([places(t, sentences) for t, sentences in zip(texts, lists)], dtype=object)

    return found


def locate_sentences(sentences: DataFrame, docs: DataFrame, max_edits: int = 0) -> DataFrame:
    """Offset of each sentence in its document, whether it was found and whether it runs backwards.

    With ``max_edits`` a sentence that does not occur as such is also found where a stretch of its
    own length, with marked letters made plain, differs from it by at most that many edits; the first
    such place counts. Of ``max_edits + 1`` pieces of the sentence at least one must be left as it
    is, so every occurrence of every piece, moved by as many characters as edits can move it, is a
    place to try. A sentence of at most ``max_edits`` characters is only looked for as such.

    The sentences of a stored version meet their document as one row, so its text is copied once for each
    version and not for each sentence.
    """
    others = [c for c in sentences.columns if c not in ("entry_id", "version")]
    lists = sentences.repartition("entry_id").groupBy("entry_id", "version").agg(F.array_sort(F.collect_list(F.struct("sent_idx", *[c for c in others if c != "sent_idx"]))).alias("list"))
    rows = lists.join(docs, "entry_id")
    rows = rows.withColumn("starts", _places(max_edits)("text", F.transform("list", lambda s: s["sentence"])))
    placed = F.transform("list", lambda s, i: F.struct(
        s.alias("row"), F.get("starts", i).alias("start"),
        F.coalesce(F.get("starts", i) < F.get("starts", i - 1), F.lit(False)).alias("out_of_order"),
    ))
    found = rows.select("entry_id", "version", F.explode(placed).alias("p"))
    return found.select("entry_id", "version", *[F.col(f"p.row.{c}").alias(c) for c in others], "p.start", F.col("p.start").isNotNull().alias("found"), "p.out_of_order")
