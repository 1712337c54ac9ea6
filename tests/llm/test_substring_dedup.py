"""Repeated byte strings against brute force over all strings."""

import hashlib
import itertools

import numpy as np
import pytest

from verstext.llm import substring_dedup as sd


def slow_report(rows, length=50):
    smallest = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            if key is not None:
                s = data[i : i + length]
                smallest[s] = min(smallest.get(s, key), key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - length + 1):
            if key is not None and smallest[data[i : i + length]] < key:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((key, len(data), sum(gone), sum(g for g, _ in itertools.groupby(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def test_rows_that_share_an_id_lose_their_own_repeats(spark):
    rng = np.random.default_rng(2)
    text = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    line = text(120)
    rows = [(1, text(30) + line + text(30)), (2, text(60) + line), (2, text(200)), (2, line + text(60)), (3, text(200)), (3, text(10) + line[20:90] + text(40))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, sd.repeat_report(table).collect())) == sorted(slow_report(rows))


def planted():
    rng = np.random.default_rng(11)
    letters = list("abcdefghij é中")
    text = lambda n: "".join(rng.choice(letters, n))
    passage, line, exact = text(400), text(60), "x" * 50
    rows = [(d, text(int(rng.integers(0, 300)))) for d in range(40)]
    rows += [(100 + d, text(80) + passage[: 30 + 9 * d] + text(80)) for d in range(40)]
    rows += [(200 + d, text(20) + passage[9 * d : 9 * d + 70] + line + text(5) + line) for d in range(30)]
    rows += [(300 + d, passage) for d in range(5)]
    rows += [(400, exact), (401, exact[:-1]), (402, exact + "x"), (403, "a" * 400), (404, "a" * 380 + "b"), (405, "ab" * 200), (406, "b" + "ab" * 100)]
    rows += [(407, None), (408, ""), (None, passage), (409, passage), (409, passage), (-5, line + " and more"), (2**60, text(10) + line)]
    rows += [(430, "k" + passage[200:270] + "q"), (440, (text(9) + passage[150:400] + text(9)) * 3)]  # one text several times in a document
    rows += [(450, "k" * 60 + passage[:100] + "q" * 60), (451, ("m" * 90 + passage[30:90] + "n" * 90) * 3)]
    rows += [(500 + d, text(7) + line[5:54] + text(7)) for d in range(20)] + [(600 + d, text(7) + line[5:55] + text(7)) for d in range(20)]
    return rows


def test_repeats_equal_brute_force(spark):
    rows = planted()
    table = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, part string, at long").repartition(5)
    got = sorted(map(tuple, sd.repeat_report(table).collect()), key=repr)
    assert got == sorted(slow_report(rows), key=repr)
    assert sd.repeat_report(table.limit(0)).count() == 0


def test_repeats_of_the_small_table(spark, sf_dir, odd_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, sd.repeat_report(docs).collect()), key=repr) == sorted(slow_report(rows), key=repr)


@pytest.mark.parametrize("depth", [8, 13, 16, 50])
def test_index_finds_every_earlier_string(depth):
    rng = np.random.default_rng(depth)
    segments = [bytes(rng.choice(list(b"ab\x00\xff"), int(rng.integers(0, 90)))) for _ in range(60)]
    segments += [segments[3][:70], segments[4] + b"zz", b"a" * 80, b"a" * 90]
    docs = rng.permutation(len(segments)).astype(np.int64) % 40
    first = {}
    for s, d in zip(segments, docs.tolist(), strict=True):
        for i in range(len(s) - depth + 1):
            first[s[i : i + depth]] = min(first.get(s[i : i + depth], d), d)
    want = [[i for i in range(len(s) - depth + 1) if first[s[i : i + depth]] < d] for s, d in zip(segments, docs.tolist(), strict=True)]
    got = [[] for _ in segments]
    for s, i in zip(*map(np.ndarray.tolist, sd.match_segments(segments, docs, depth)), strict=True):
        got[s].append(i)
    assert [sorted(g) for g in got] == want


def test_streaming_starts_at_the_last_string_of_a_segment(monkeypatch):
    calls, step = [], sd.RunLengthIndex.step
    monkeypatch.setattr(sd.RunLengthIndex, "step", lambda self, *a: calls.append(1) or step(self, *a))
    text = bytes(np.random.default_rng(4).integers(97, 123, 84, dtype=np.uint8))
    which, starts = sd.match_segments([text, b"?" + text[5:70], text[:20]], np.array([1, 2, 0]), 50)
    assert sorted(zip(which.tolist(), starts.tolist(), strict=True)) == [(1, i) for i in range(1, 17)]
    assert len(calls) == 84 - 50


def test_every_string_covers_a_context():
    config = sd.RepeatConfig()
    rest = config.length - config.seed
    assert all(any(a <= left and b <= rest - left for a, b in config.contexts) for left in range(rest + 1))


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(1)
    config, hasher = sd.RepeatConfig(), sd.Hasher()
    common = bytes(rng.integers(97, 101, 50, dtype=np.uint8))
    seen = []
    for _ in range(30):
        head = bytes(rng.integers(97, 101, int(rng.integers(0, 60)), dtype=np.uint8))
        text = head + common + bytes(rng.integers(97, 101, int(rng.integers(0, 60)), dtype=np.uint8))
        places, hashes, *_ = sd.find_anchors(text, hasher, config)
        inside = {(int(p) - len(head), int(h)) for p, h in zip(places, hashes, strict=True) if len(head) <= p <= len(head) + 34}
        seen.append(inside)
    assert set.intersection(*seen)
