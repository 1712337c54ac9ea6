"""Texts next to the pairs of places that two versions share, by arrays inside a task.

Sentences and matches are dealt together by entry and stretch of versions, each once, and a task reads them sorted by
version. What would be a join on (entry, version, sentence) is a search in sorted places of two versions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from verstext.functions import text as tx
from verstext.operators.dealing import deal
from verstext.operators.nearest import BATCH_TOKENS, Side, Versions, codes, in_pieces, ranges, stretch_of, with_stretches

TEXT_BYTES = 16_000_000
OWN = {"entry_id": "entry_id", "version_x": "version"}


def _dealt(values: DataFrame, matched: DataFrame | None) -> DataFrame:
    """Rows of sentences (``value``) and of matches (``link``), sorted by version, the sentences first."""
    places = ["entry_id", "stretch", "version", "sent_idx"]
    rows = with_stretches(values).select(*places, "value")
    if matched is not None:
        # the row itself names the entry and the version
        types = dict(values.dtypes)
        named = {c for c, own in OWN.items() if dict(matched.dtypes)[c] == types[own]}
        link = F.struct(*[c for c in matched.columns if c not in named])
        links = matched.where("entry_id IS NOT NULL AND version_x IS NOT NULL").select(
            "entry_id", stretch_of(F.col("version_x")).alias("stretch"), F.col("version_x").alias("version"), link.alias("link")
        )
        rows = rows.unionByName(links, allowMissingColumns=True)
    return deal(rows, ["entry_id", "stretch"], ["version", "sent_idx"])


class _Table:
    """Sentences of a table that holds sentences and links."""

    def __init__(self, table: pa.Table, last: bool):
        versions = Versions(table, last)
        self.table, self.rest = table, versions.rest
        idx = table.column("sent_idx").combine_chunks()
        known = idx.is_valid().to_numpy(zero_copy_only=False)
        values = idx.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.least = int(values[known].min()) if known.any() else 0
        self.place = np.where(known, values - self.least + 1, 0)
        self.span = int(self.place.max()) + 2
        version_of = np.repeat(np.arange(len(versions.begins)), versions.lengths)
        sentences = np.bincount(version_of, known, minlength=len(versions.begins)).astype(np.int64)
        self.version_of, self.known, self.begins, self.sentences = version_of, known, versions.begins, sentences
        self.count = len(versions.begins)
        self.pairs = versions.older[(sentences[versions.older] > 0) & (sentences[versions.older + 1] > 0)]
        self.done = self.count if last else self.count - 1
        follows = np.zeros(self.count, bool)
        follows[versions.older] = True
        self.newer = np.where(follows, np.arange(self.count) + 1, -1)
        # sorted as they come: by version and place
        self.row = np.flatnonzero(known)
        self.key = version_of[self.row] * self.span + self.place[self.row]

    def find(self, version: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the rows of the sentences there: (number of the asked place, row or -1), like a left join."""
        asked = np.where((place > 0) & (version >= 0), version * self.span + place, -1)
        low = np.searchsorted(self.key, asked, "left")
        found = np.searchsorted(self.key, asked, "right") - low
        times = np.maximum(found, 1)
        who = np.repeat(np.arange(len(asked)), times)
        at = ranges(low, times)
        return who, np.where(np.repeat(found, times) > 0, self.row[np.minimum(at, len(self.row) - 1)] if len(self.row) else -1, -1)

    def places(self, column: pa.Array) -> np.ndarray:
        """Indexes as places; 0 where there is none in the table."""
        values = column.fill_null(self.least - 1).to_numpy(zero_copy_only=False).astype(np.int64) - self.least + 1
        return np.where((values > 0) & (values < self.span), values, 0)

    def values(self, rows: np.ndarray) -> pa.Array:
        return _whole(self.table.column("value").take(pa.array(np.maximum(rows, 0), mask=rows < 0)))


def _whole(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def attach_values(matched: DataFrame, values: DataFrame, names: tuple[str, str]) -> DataFrame:
    """Every match row with the ``value`` of its older and its newer sentence, NULL where a side is absent."""
    kind = next(f.dataType for f in values.schema.fields if f.name == "value")
    schema = StructType([*matched.schema.fields, *[StructField(n, kind) for n in names]])

    names_of_match = matched.columns

    def work(table: pa.Table, last: bool):
        if table.num_rows == 0:
            return [], 0
        t = _Table(table, last)
        mine = np.flatnonzero(~t.known & (t.version_of < t.done))
        # a version whose newer one may still come waits with it
        mine = mine[mine < t.rest]
        link = _whole(table.column("link").take(pa.array(mine)))
        older = t.version_of[mine]
        who, old = t.find(older, t.places(link.field("sent_idx_x")))
        again, new = t.find(t.newer[older[who]], t.places(link.field("sent_idx_y"))[who])
        who, old = who[again], old[again]
        link, row = link.take(pa.array(who)), pa.array(mine[who])
        held = [f.name for f in link.type]
        there = [link.field(c) if c in held else _whole(table.column(OWN[c]).take(row)) for c in names_of_match]
        columns = [*there, t.values(old), t.values(new)]
        return [pa.RecordBatch.from_arrays(columns, schema.names)] if len(who) else [], t.rest

    found = _dealt(values, matched).mapInArrow(in_pieces(work, {"value": TEXT_BYTES}), schema)
    return found


def _codes_of(column: pa.Array) -> np.ndarray:
    encoded = column.dictionary_encode()
    return encoded.indices.fill_null(len(encoded.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)


def _occurrences(group: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The number, from 0, of each row within its group by place."""
    order = np.lexsort((place, group))
    fresh = np.r_[True, np.diff(group[order]) != 0][: len(order)]
    steps = np.arange(len(order))
    number = np.empty(len(order), np.int64)
    number[order] = steps - np.maximum.accumulate(np.where(fresh, steps, 0))
    return number


class _Slots:
    """Slots of the pairs of versions: kept ones, old ones and new ones alone, by the number of the occurrence."""

    def __init__(self, t: _Table):
        self.t = t
        text = _codes_of(_whole(t.table.column("value")))
        self.x, self.y = Side(t, t.begins[t.pairs], t.sentences[t.pairs]), Side(t, t.begins[t.pairs + 1], t.sentences[t.pairs + 1])
        self.text = [text[s.row] for s in (self.x, self.y)]
        texts = int(text.max()) + 1
        groups = [s.pair * texts + code for s, code in zip((self.x, self.y), self.text)]
        self.number = [_occurrences(g, s.place) for g, s in zip(groups, (self.x, self.y))]
        most = max((int(n.max()) + 1 for n in self.number if len(n)), default=1)
        dense = np.unique(np.concatenate(groups), return_inverse=True)[1]
        keys = [dense[: len(groups[0])] * most + self.number[0], dense[len(groups[0]):] * most + self.number[1]]
        self.kept_x, self.kept_y = np.intersect1d(*keys, assume_unique=True, return_indices=True)[1:]
        self.old, self.new = (np.flatnonzero(~np.isin(np.arange(len(k)), kept)) for k, kept in zip(keys, (self.kept_x, self.kept_y)))


def set_slots(sentences: DataFrame) -> DataFrame:
    """Aligned slots by equal text alone, with the text and the number of the occurrence."""
    kinds = {f.name: f.dataType for f in sentences.schema.fields}
    schema = StructType([
        StructField("entry_id", kinds["entry_id"]), StructField("version_x", kinds["version"]), StructField("sentence", StringType()),
        StructField("occurrence", IntegerType()), StructField("sent_idx_x", kinds["sent_idx"]), StructField("sent_idx_y", kinds["sent_idx"]),
    ])

    def work(table: pa.Table, last: bool):
        t = _Table(table, last) if table.num_rows else None
        if t is None or not len(t.pairs):
            return [], t.rest if t else 0
        s = _Slots(t)
        none = [np.zeros(len(n), np.int64) for n in (s.old, s.new)]
        pair = np.concatenate([s.x.pair[s.kept_x], s.x.pair[s.old], s.y.pair[s.new]])
        x = np.concatenate([s.x.place[s.kept_x], s.x.place[s.old], none[1]])
        y = np.concatenate([s.y.place[s.kept_y], none[0], s.y.place[s.new]])
        number = np.concatenate([s.number[0][s.kept_x], s.number[0][s.old], s.number[1][s.new]]) + 1
        who, row = t.find(np.where(x > 0, t.pairs[pair], t.pairs[pair] + 1), np.where(x > 0, x, y))
        first = pa.array(t.begins[t.pairs[pair[who]]])
        columns = [
            *(_whole(table.column(c).take(first)) for c in ("entry_id", "version")), t.values(row), pa.array(number[who].astype(np.int32)),
            *(_idx(t, p[who]) for p in (x, y)),
        ]
        return [pa.RecordBatch.from_arrays(columns, schema.names)], t.rest

    return _dealt(sentences.withColumn("value", F.col("sentence")), None).mapInArrow(in_pieces(work, {"value": TEXT_BYTES}), schema)


def _idx(t: _Table, place: np.ndarray) -> pa.Array:
    return pa.array(place + t.least - 1, mask=place == 0).cast(t.table.schema.field("sent_idx").type)


def diff_slots(sentences: DataFrame, matched: DataFrame) -> DataFrame:
    """The slots of all pairs with their texts, tags and number in reading order."""
    return _of_slots(sentences, matched, _slot_schema(sentences), lambda slots: slots)


def _slot_schema(sentences: DataFrame) -> StructType:
    kinds = {f.name: f.dataType for f in sentences.schema.fields}
    return StructType([
        StructField("entry_id", kinds["entry_id"]), StructField("version_x", kinds["version"]), StructField("version_y", kinds["version"]),
        StructField("sent_idx_x", kinds["sent_idx"]), StructField("sent_idx_y", kinds["sent_idx"]),
        *[StructField(c, StringType()) for c in ("tag_old", "tag_new", "sent_old", "sent_new")], StructField("s_idx", IntegerType()),
    ])


def _of_slots(sentences: DataFrame, matched: DataFrame, schema: StructType, finish: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """What ``finish`` makes of batches of slots; all slots of a pair of versions are in one batch, in reading order."""
    names = _slot_schema(sentences).names
    mutual = matched.where("avg_sentence_distance_x IS NOT NULL AND avg_sentence_distance_y IS NOT NULL").select(
        "entry_id", "version_x", "sent_idx_x", "sent_idx_y"
    )

    def work(table: pa.Table, last: bool):
        t = _Table(table, last) if table.num_rows else None
        if t is None or not len(t.pairs):
            return [], t.rest if t else 0
        return [finish(_diff(t, names))], t.rest

    return _dealt(sentences.withColumn("value", F.col("sentence")), mutual).mapInArrow(in_pieces(work, {"value": TEXT_BYTES}), schema)


def changed_texts(sentences: DataFrame, matched: DataFrame) -> DataFrame:
    """Number and new texts, in reading order, of the slots of each kind of change, by pair of versions.

    They are gathered in the task that makes the slots, so no slot is stored or shuffled.
    """
    slots = {f.name: f for f in _slot_schema(sentences).fields}
    schema = StructType([
        slots["entry_id"], slots["version_x"], StructField("kind", StringType()), StructField("n", LongType()),
        StructField("texts", ArrayType(StringType())),
    ])

    def gathered(batch: pa.RecordBatch) -> pa.RecordBatch:
        old, new = pc.equal(batch.column("tag_old"), "-"), pc.equal(batch.column("tag_new"), "+")
        kind = pc.if_else(old, pc.if_else(new, "changed", "removed"), "added")
        rows = pa.table([*(batch.column(c) for c in ("entry_id", "version_x")), kind, batch.column("sent_new")], ["entry_id", "version_x", "kind", "texts"])
        # one thread keeps the reading order
        found = rows.filter(pc.or_(old, new)).group_by(["entry_id", "version_x", "kind"], use_threads=False).aggregate([("texts", "list")])
        found = found.rename_columns({"texts_list": "texts"}).combine_chunks()
        n = pc.list_value_length(found.column("texts")).cast(pa.int64())
        columns = [*(_whole(found.column(c)) for c in ("entry_id", "version_x", "kind")), _whole(n), _whole(found.column("texts"))]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    return _of_slots(sentences, matched, schema, gathered)


def _partners(t: _Table, s: _Slots) -> tuple[np.ndarray, np.ndarray]:
    """The old sentences that stand alone with the place of their best match, or 0, like a left join."""
    number = np.full(t.count, -1)
    number[t.pairs] = np.arange(len(t.pairs))
    links = np.flatnonzero(~t.known)
    links = links[number[t.version_of[links]] >= 0]
    link = _whole(t.table.column("link").take(pa.array(links)))
    at = number[t.version_of[links]] * t.span + t.places(link.field("sent_idx_x"))
    order = np.argsort(at, kind="stable")
    at, partner = at[order], t.places(link.field("sent_idx_y"))[order]
    asked = s.x.key[s.old]
    low = np.searchsorted(at, asked, "left")
    found = np.searchsorted(at, asked, "right") - low
    times = np.maximum(found, 1)
    spots = np.minimum(ranges(low, times), max(len(at) - 1, 0))
    there = np.repeat(found, times) > 0
    return np.repeat(s.old, times), np.where(there, partner[spots], 0) if len(at) else np.zeros(len(there), np.int64)


def _diff(t: _Table, names: list[str]) -> pa.RecordBatch:
    s = _Slots(t)
    old, partner = _partners(t, s)
    # an old sentence and its best match meet under the index of the new one
    pair = np.concatenate([s.x.pair[old], s.y.pair[s.new]])
    under_y = np.concatenate([partner, s.y.place[s.new]])
    under_x = np.where(under_y > 0, 0, np.concatenate([s.x.place[old], np.zeros(len(s.new), np.int64)]))
    x = np.concatenate([s.x.place[old], np.zeros(len(s.new), np.int64)])
    y = np.concatenate([np.zeros(len(old), np.int64), s.y.place[s.new]])
    text_x = np.concatenate([s.text[0][old], np.full(len(s.new), -1)])
    text_y = np.concatenate([np.full(len(old), -1), s.text[1][s.new]])
    order = np.lexsort((under_x, under_y, pair))
    head = np.flatnonzero(np.r_[True, (np.diff(pair[order]) != 0) | (np.diff(under_y[order]) != 0) | (np.diff(under_x[order]) != 0)][: len(order)])
    if len(head):
        x, y, text_x, text_y = (np.maximum.reduceat(a[order], head) for a in (x, y, text_x, text_y))
        pair = pair[order][head]
    same = np.concatenate([np.ones(len(s.kept_x), bool), (text_x == text_y) & (text_x >= 0)])
    pair = np.concatenate([s.x.pair[s.kept_x], pair])
    x, y = np.concatenate([s.x.place[s.kept_x], x]), np.concatenate([s.y.place[s.kept_y], y])
    who, old = t.find(t.pairs[pair], x)
    again, new = t.find(t.pairs[pair[who]] + 1, np.where(same, 0, y)[who])
    who, old = who[again], old[again]
    pair, x, y, same = pair[who], x[who], y[who], same[who]
    new = np.where(same, old, new)
    far = t.span
    order = np.lexsort((np.where(y > 0, y, far), np.where(x > 0, x, far), np.where(x > 0, x, y), pair))
    pair, x, y, same, old, new = (a[order] for a in (pair, x, y, same, old, new))
    fresh = np.r_[True, np.diff(pair) != 0][: len(pair)]
    steps = np.arange(len(pair))
    number = steps - np.maximum.accumulate(np.where(fresh, steps, 0))
    first = pa.array(t.begins[t.pairs[pair]])
    entry, version = (_whole(t.table.column(c).take(first)) for c in ("entry_id", "version"))
    newer = pa.array(version.to_numpy(zero_copy_only=False) + 1).cast(version.type)
    tags = [pc.if_else(pa.array((p == 0) | same), " ", mark) for p, mark in ((x, "-"), (y, "+"))]
    texts = [t.values(rows).fill_null("") for rows in (old, new)]
    return pa.RecordBatch.from_arrays([entry, version, newer, _idx(t, x), _idx(t, y), *tags, *texts, pa.array(number.astype(np.int32))], names)


def pair_lists(sentences: DataFrame, edges: DataFrame) -> DataFrame:
    """For each pair of versions and source the ``nodes``, its sentences in order, and the ``arcs`` between them."""
    kinds = {f.name: f.dataType for f in [*edges.schema.fields, *sentences.schema.fields]}
    node, arc = ["version", "sent_idx", "sentence"], ["sent_idx_x", "sent_idx_y"]
    schema = StructType([
        StructField("entry_id", kinds["entry_id"]), StructField("version_x", kinds["version"]), StructField("source", kinds["source"]),
        StructField("nodes", ArrayType(StructType([StructField(c, kinds[c]) for c in node]))),
        StructField("arcs", ArrayType(StructType([StructField(c, kinds[c]) for c in arc]))),
    ])
    # a sentence without an index is a node, too
    nodes = with_stretches(sentences.withColumns({"place": F.col("sent_idx"), "sent_idx": F.lit(0)}))
    nodes = nodes.select("entry_id", "stretch", "version", "source", F.col("place").alias("sent_idx"), "sentence", F.lit(True).alias("is_node"))
    arcs = edges.where("entry_id IS NOT NULL AND version_x IS NOT NULL").select(
        "entry_id", stretch_of(F.col("version_x")).alias("stretch"), F.col("version_x").alias("version"), *arc, F.lit(False).alias("is_node")
    )
    dealt = deal(nodes.unionByName(arcs, allowMissingColumns=True), ["entry_id", "stretch"], ["version"])

    def work(table: pa.Table, last: bool):
        if table.num_rows == 0:
            return [], 0
        versions = Versions(table, last)
        is_node = table.column("is_node").to_numpy()
        version_of = np.repeat(np.arange(len(versions.begins)), versions.lengths)
        held = np.bincount(version_of, is_node, minlength=len(versions.begins))
        older = versions.older[(held[versions.older] > 0) & (held[versions.older + 1] > 0)]
        if not len(older):
            return [], versions.rest
        own, newer = (np.flatnonzero(np.isin(version_of, o) & is_node) for o in (older, older + 1))
        row = np.concatenate([own, newer])
        pair = np.concatenate([version_of[own], version_of[newer] - 1])
        listed = table.select(["source", *node]).take(pa.array(row)).append_column("pair", pa.array(pair))
        order = pc.sort_indices(listed, [(c, "ascending") for c in ("pair", "source", *node)], null_placement="at_start")
        listed = listed.take(order).combine_chunks()
        pair, source = listed.column("pair").to_numpy(), _codes_of(_whole(listed.column("source")))
        begins = np.flatnonzero(np.r_[True, (np.diff(pair) != 0) | (np.diff(source) != 0)])
        linked = np.flatnonzero(np.isin(version_of, older) & ~is_node)
        joined = table.select(arc).take(pa.array(linked)).append_column("pair", pa.array(version_of[linked]))
        joined = joined.take(pc.sort_indices(joined, [(c, "ascending") for c in ("pair", *arc)])).combine_chunks()
        # the arcs of a pair stand next to the nodes of each of its sources
        at = joined.column("pair").to_numpy()
        low, high = (np.searchsorted(at, pair[begins], side) for side in ("left", "right"))
        spread = joined.select(arc).take(pa.array(ranges(low, high - low))).combine_chunks()
        first = pa.array(versions.begins[pair[begins]])
        columns = [
            *(_whole(table.column(c).take(first)) for c in ("entry_id", "version")), _whole(listed.column("source").take(pa.array(begins))),
            _lists(listed.select(node), np.append(begins, len(pair))), _lists(spread, np.append(0, np.cumsum(high - low))),
        ]
        return [pa.RecordBatch.from_arrays(columns, schema.names)], versions.rest

    return dealt.mapInArrow(in_pieces(work, {"sentence": TEXT_BYTES}), schema)


def _lists(table: pa.Table, offsets: np.ndarray) -> pa.Array:
    """One list of rows, as structs, for each stretch between two offsets."""
    rows = pa.StructArray.from_arrays([_whole(c) for c in table.columns], table.column_names)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), rows)


def weighted_texts(sentences: DataFrame, flagged: DataFrame, entries: DataFrame) -> DataFrame:
    """``sentence, f, n``: texts with the number of their sentences, and of those whose place is in ``flagged``.

    Sentences count once for each row that ``entries`` has of their entry. A text may come several times.
    """
    place = ["entry_id", "version", "sent_idx"]
    kinds = {f.name: f.dataType for f in sentences.schema.fields}
    start = F.lit(-(1 << 31)).cast(kinds["version"])  # before all versions
    texts = sentences.where("entry_id IS NOT NULL AND sentence IS NOT NULL").select(
        "entry_id", F.coalesce("version", start + 1).alias("version"), "sent_idx", F.lit(2).alias("kind"), "sentence"
    )
    flags = flagged.where(" AND ".join(f"{c} IS NOT NULL" for c in place)).select(*place, F.lit(1).alias("kind"))
    times = entries.where("entry_id IS NOT NULL").groupBy("entry_id").agg(F.count(F.lit(1)).alias("times"))
    times = times.select("entry_id", start.alias("version"), F.lit(0).cast(kinds["sent_idx"]).alias("sent_idx"), F.lit(0).alias("kind"), "times")
    rows = texts.unionByName(flags, allowMissingColumns=True).unionByName(times, allowMissingColumns=True)

    def run(batches):
        carried = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if carried is None else [*carried, batch]).combine_chunks()
            entry, kind = codes(table.column("entry_id")), table.column("kind").to_numpy()
            version, idx = table.column("version").to_numpy(), table.column("sent_idx").combine_chunks()
            known = idx.is_valid().to_numpy(zero_copy_only=False)
            idx = idx.fill_null(0).to_numpy(zero_copy_only=False)
            # flags stand before the sentences of their place
            spot = np.cumsum(np.r_[False, (np.diff(entry) != 0) | (np.diff(version) != 0) | (np.diff(idx) != 0) | (np.diff(known) != 0)])
            marked = np.bincount(spot, kind == 1) > 0
            weight = np.bincount(entry, table.column("times").fill_null(0).to_numpy().astype(np.float64)).astype(np.int64)
            mine = np.flatnonzero((kind == 2) & (weight[entry] > 0))
            if len(mine):
                text = _whole(table.column("sentence")).take(pa.array(mine)).dictionary_encode()
                group = text.indices.to_numpy(zero_copy_only=False)
                sums = [np.bincount(group, weight[entry[mine]] * w, len(text.dictionary)).astype(np.int64) for w in (marked[spot[mine]], 1)]
                yield pa.RecordBatch.from_arrays([text.dictionary, *(pa.array(v) for v in sums)], ["sentence", "f", "n"])
            # the next batch may go on with this entry and place
            rest = (entry == entry[-1]) & ((kind == 0) | ((kind == 1) & (spot == spot[-1])))
            carried = table.filter(pa.array(rest)).to_batches()

    return deal(rows, ["entry_id"], ["version", "sent_idx", "kind"]).mapInArrow(run, "sentence string, f long, n long")


def shared_tokens(versions: DataFrame, text: str) -> DataFrame:
    """Tokens of both texts of each pair of versions, and how many they share, equal ones counted once each."""
    kinds = {f.name: f.dataType for f in versions.schema.fields}
    schema = StructType([
        StructField("entry_id", kinds["entry_id"]), StructField("version_x", kinds["version"]), StructField("shared", LongType()), StructField("total", LongType()),
    ])
    places = ["entry_id", "stretch", "version"]
    dealt = with_stretches(versions.select("entry_id", "version", F.lit(0).alias("sent_idx"), F.col(text).alias("value")))
    dealt = deal(dealt.select(*places, "value"), ["entry_id", "stretch"], ["version"])

    def work(table: pa.Table, last: bool):
        if table.num_rows == 0:
            return [], 0
        at = Versions(table, last)
        lists = table.column("tokens").combine_chunks()
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        version = np.repeat(np.repeat(np.arange(len(at.begins)), at.lengths), size)
        word = codes(lists.flatten())
        words = int(word.max()) + 1 if len(word) else 1
        bag = np.sort(version * words + word)
        head = np.flatnonzero(np.r_[True, np.diff(bag) != 0][: len(bag)])
        bag, count = bag[head], np.diff(np.r_[head, len(bag)])
        total = np.bincount(version, minlength=len(at.begins))
        # the same word in the next version
        spot = np.minimum(np.searchsorted(bag, bag + words), max(len(bag) - 1, 0))
        common = np.where(bag[spot] == bag + words, np.minimum(count, count[spot]), 0)
        shared = np.bincount(bag // words, common, minlength=len(at.begins)).astype(np.int64)
        both = total[at.older] + total[at.older + 1]
        used = at.older[both > 0]
        first = pa.array(at.begins[used])
        columns = [*(_whole(table.column(c).take(first)) for c in ("entry_id", "version")), pa.array(shared[used]), pa.array(both[both > 0])]
        return [pa.RecordBatch.from_arrays(columns, schema.names)], at.rest

    return dealt.select(*places, tx.token_hashes("value").alias("tokens")).mapInArrow(in_pieces(work, {"tokens": BATCH_TOKENS}), schema)
