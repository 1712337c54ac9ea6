"""Fill-in-middle against a plain form on whole strings."""

import hashlib
import re
from collections import Counter

import pytest
import zstandard

from verstext.llm import fill_middle as fm

UNIT = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def slow(key, text):
    text = text or ""
    units = UNIT.findall(text)
    draw = sha(f"42:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(draw[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h4 % 100 < 80:
        return key, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return key, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def digested(key, text):
    *row, out = slow(key, text)
    return (*row, sha(out), sha(text or ""))


def texts():
    odd = ["", None, " ", "\n\t x", "x", "a  b ", "<P> is a mark", "almost <P <S <M> no", "< P>", "é中 \U0001f600 " * 9, "w " * 3000, "y" * 70_000, "<" * 40 + " >" * 40]
    rows = [(i, t) for i, t in enumerate(odd * 8)]
    rows += [(1000 + i, " ".join(f"w{k * i % 7}" for k in range(i)) + " " * (i % 3)) for i in range(150)]
    return rows + [(None, "no id here"), (None, None), (5, "one"), (5, "one"), (5, "two words")]


@pytest.mark.parametrize("units", [1, 3, 64, 1024])
def test_report_equals_a_plain_form(spark, units):
    rows = texts()
    table = spark.createDataFrame([(*r, "f", 1) for r in rows], "doc_id long, text string, form string, output long").repartition(3)
    got = fm.fim_report(table, fm.FimConfig(frame_units=units))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(digested(*r) for r in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in got.select("form").distinct().collect()}
    assert fm.fim_report(table.limit(0)).count() == 0


def test_report_of_the_small_table(spark, sf_dir, odd_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert Counter(map(tuple, fm.fim_report(docs).collect())) == Counter(digested(*r) for r in rows)


def test_output_is_one_stream_and_takes_whole_frames_over(spark):
    rows = [(i, " ".join(f"word{k}" for k in range(5000))) for i in range(40)]
    config = fm.FimConfig(frame_units=100)
    stored = fm.store_frames(spark.createDataFrame(rows, "doc_id long, text string"), config)
    frames = {r.doc_id: [bytes(f.data) for f in r.frames] for r in stored.collect()}
    assert all(len(f) == 50 for f in frames.values())
    for r in fm.fill_in_middle(stored, config).collect():
        stream = zstandard.ZstdDecompressor().stream_reader(b"".join(r.output), read_across_frames=True)
        assert stream.read().decode() == slow(*rows[r.doc_id])[-1]
        new = [f for f in map(bytes, r.output) if f not in set(frames[r.doc_id])]
        assert len(new) <= (0 if r.form == "plain" else 3 + 4)


def test_only_cut_frames_are_decompressed():
    text = b" ".join(b"w%d" % k for k in range(1000))
    compress = zstandard.ZstdCompressor().compress
    opened = []

    def decompress(frame):
        opened.append(frame)
        return zstandard.ZstdDecompressor().decompress(frame)

    frames = fm.to_frames(text, fm.FimConfig(frame_units=50), compress)
    reader = fm.FrameReader(frames, decompress, compress)
    places = [reader.place(u) for u in (0, 120, 500, 1000)]
    assert len(opened) == 1  # 120 lies inside a frame; 0, 500 and 1000 do not
    assert [p.chars for p in places] == [len(b" ".join(text.split()[:u])) for u in (0, 120, 500, 1000)]


def test_marks_over_the_border_of_frames_are_found():
    compress, decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    whole = b"<P>ab<<S>c <S d<M>e"
    for width in (1, 2, 3, 5):
        frames = [compress(whole[i : i + width]) for i in range(0, len(whole), width)]
        assert fm.find_marks(frames, fm.MARKS["psm"], decompress) == [0, 6, 15]
        assert b"".join(fm.restore(frames, "psm", decompress)) == b"ab<ec <S d"
