"""Archives, phrases and fill-in-middle against plain Python, on small tables."""

import base64
import hashlib
import itertools
import pathlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from quillon.llm import fim, phrases, warc
from quillon.session import shared_dir

# 11: archives


def _digest(s):
    return base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()


def _pages(spark):
    made = [(i, f"http://x.example/{i}?q=ü b", f"<html><body>page {i % 7} {'words of a page ' * 40}</body></html>") for i in range(60)]
    made += [(100, None, None), (101, "u", ""), (102, "u\r\nX: y", "é😀\r\n\r\nWARC/1.1\r\n"), (None, "n", "alone"), (None, "n", made[0][2]), (103, "u", "x" * 3_000_000), (104, "same", "twice"), (104, "same", "twice")]
    return made, spark.createDataFrame([(*m, "extra") for m in made], "page_id long, url string, html string, payload string")


def test_archives_give_every_page_back(spark, tmp_path):
    made, pages = _pages(spark)
    manifest = warc.write_archives(pages.repartition(3), f"file://{tmp_path}/a", archive_bytes=1 << 14)
    got = warc.read_archives(manifest).collect()
    best = {}
    for page_id, _, html in made:
        best[html or ""] = max(best.get(html or "", -1), -1 if page_id is None else page_id)
    assert sorted((str(r.page_id), r.url) for r in got) == sorted((str(p), u) for p, u, _ in made)
    texts = {(p, u): h or "" for p, u, h in made}
    texts[(None, "n")] = None  # two rows share this key
    for r in got:
        said = texts[(r.page_id, r.url)]
        if said is None:
            assert r.record_type == ("revisit" if r.refers_to is not None else "response")
            continue
        top = None if best[said] == -1 else best[said]
        assert r.payload_digest == _digest(said) and r.payload_bytes == len(said.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))
        assert r.payload == (said.encode() if r.record_type == "response" else None)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(made)


def test_small_payloads_do_not_refer_to_others(spark):
    pages = spark.createDataFrame([(1, "a", "short"), (2, "b", "short"), (3, "c", "l" * 100), (4, "d", "l" * 100)], "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archived_pages(pages, least_bytes=50).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.archived_pages(pages.limit(0)).collect() == []


def test_archives_leave_only_their_records_behind(spark):
    """The tables and the folder that archiving needs on its way are deleted, and each with the name it was stored under."""
    folder = pathlib.Path(shared_dir(spark).removeprefix("file://")) / "quillon"
    before = set(folder.glob("warc-*"))
    back = warc.archived_pages(_pages(spark)[1])
    left = set(folder.glob("warc-*")) - before
    assert [p.name for p in left] == [pathlib.Path(back.stored_at).name] and back.count() == len(_pages(spark)[0])


def test_an_archive_begins_with_its_dictionary():
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["alpha", "beta", "<div class='x'>", "gamma", "</div>"], k=300)).encode() for _ in range(200)]
    records = [warc.record(i, "http://e/", t, hashlib.sha1(t).digest(), None, False) for i, t in enumerate(texts)]
    data, size = warc.archive(records)
    assert size and data[:4] == bytes.fromhex("5D2A4D18") and int.from_bytes(data[4:8], "little") == size
    assert data[8:12] == bytes.fromhex("37A430EC")  # a trained dictionary
    # any reader of frames gets the same records with that dictionary
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    with plain.stream_reader(data[8 + size :], read_across_frames=True) as r:
        whole = r.read()
    assert whole.endswith(b"".join(records)) and whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    read = list(warc.read_archive(data))
    assert [block.partition(b"\r\n\r\n")[2] for _, block in read[1:]] == texts
    bare = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(r)) for r in records)
    assert len(data) - size < bare
    damaged = bytearray(data)
    damaged[-6] ^= 1
    with pytest.raises(zstandard.ZstdError):
        list(warc.read_archive(bytes(damaged)))


def test_too_little_for_a_dictionary():
    data, size = warc.archive([warc.record(1, None, b"", hashlib.sha1(b"").digest(), None, False)])
    assert size == 0 and len(list(warc.read_archive(data))) == 2


def test_frames_end_where_the_library_says():
    for size, options in itertools.product((0, 1, 200, 300, 70_000, 300_000), ({}, {"write_checksum": True}, {"write_content_size": False})):
        for text in (b"a" * size, random.Random(size).randbytes(size)):
            frame = zstandard.ZstdCompressor(**options).compress(text)
            assert warc.frame_end(frame + b"more", 0) == len(frame)


# 12: phrases


def _mined(rows, least, longest, top, share=100):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                counts.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    found = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    out = []
    for (lang, p), a in found.items():
        held = any(lg == lang and len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (lg, q), b in found.items())
        if held:
            continue
        score, k = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], n[lang]))
    best = []
    for lang, group in itertools.groupby(sorted(out), lambda r: r[0]):
        best += [(lang, i + 1, p.decode(), -a, left, right, words, -s) for i, (_, s, a, p, left, right, words) in enumerate(itertools.islice(group, top))]
    return best


def _mine(df, **options):
    return sorted(tuple(r) for r in phrases.mine(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("slice_bytes, longest, share", [(4 << 20, 5, 100), (64, 5, 60), (300, 3, 100), (4 << 20, 2, 100)])
def test_phrases_equal_plain_counts(spark, monkeypatch, slice_bytes, longest, share):
    rng = random.Random(7)
    words = ["a", "B", "new", "york", "é", "漢字", "of", "the", "x y", "rare1"]
    rows = []
    for i in range(300):
        ws = rng.choices(words, weights=[5, 4, 3, 3, 2, 2, 6, 6, 1, 1], k=rng.randrange(0, 40))
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "\x0b", " "]) for w in ws)
        rows.append((rng.choice(["en", "de", None, "und"]), text + (" New York City" if i % 3 else "") + f" unseen{i}"))
    rows += [("en", None), (None, ""), ("fr", " ., "), ("en", rows[0][1]), ("en", rows[0][1])]
    monkeypatch.setattr(phrases, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(phrases, "HELD_BYTES", 3 * slice_bytes)
    # the local workers are forked from a server that knows nothing of the patch, so slices are cut here as well
    raw = np.frombuffer("\n".join(t or "" for _, t in rows).encode(), dtype=np.uint8)
    assert b"".join(p.tobytes() for p in phrases._pieces(raw)) == raw.tobytes()
    df = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, n long")
    got = _mine(df, least=6, longest=longest, top=40, share=share)
    assert got == sorted(_mined(rows, 6, longest, 40, share)) and len(got) > 40


def test_phrases_of_one_hot_text_and_of_none(spark):
    df = spark.range(500).select(F.lit("en").alias("lang"), F.lit("to be or not to be that is").alias("text"))
    assert _mine(df) == _mined([("en", "to be or not to be that is")] * 500, 100, 5, 2000)
    assert _mine(df.limit(0)) == []
    assert _mine(df.withColumn("text", F.lit(None).cast("string"))) == []


def test_large_products_are_exact(spark):
    """Counts as of a far larger corpus: products pass 64 bits, quotients are just under a whole number."""
    a, n, left, right = 3 * 10**9, 7 * 10**13, 10**12 + 39, 3 * 10**10 + 7
    row = spark.createDataFrame([(a, n, left, right)], "f long, n long, l long, r long")
    got = row.select(phrases.exact_score(F.col("l"), F.col("r"))).first()[0]
    assert got == 1000 * a * n // (left * right)


@pytest.mark.parametrize("told", [1, 1 << 19])
def test_run_lengths_over_batches_of_any_cut(monkeypatch, told):
    monkeypatch.setattr(phrases, "TOLD", told)
    rng = random.Random(5)
    pairs = sorted((rng.randrange(4), rng.randrange(3)) for _ in range(200))
    key = phrases.packed(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), 4)
    rows = [(k.tobytes(), rng.randrange(1, 4), i) for i, k in enumerate(key)]
    want = Counter()
    for k, n, _ in rows:
        want[k] += n
    for size in (1, 2, 3, 7, 50, 200):
        batches = [pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows[i : i + size]), (pa.binary(), pa.int64(), pa.int64()))], names=["key", "n", "slice"]) for i in range(0, 200, size)]
        out = [r for b in phrases._run_lengths(30, 5, True, 4, part=3)(iter(batches)) for r in b.to_pylist()]
        ids = {r["key"]: r["id"] for r in out if r["id"] is not None}
        assert {r["key"]: r["f"] for r in out if r["id"] is not None} == {k: n for k, n in want.items() if n >= 30}
        assert len(set(ids.values())) == len(ids) and all(i % 5 == 4 for i in ids.values())
        heard = []
        for r in out:
            if r["slice"] is not None:
                numbers = np.frombuffer(r["told"], dtype="<i8").tolist()
                assert numbers == [ids[r["of"][8 * i : 8 * i + 8]] for i in range(len(numbers))]
                heard += [r["slice"]] * len(numbers)
        assert sorted(heard) == [i for k, _, i in rows if want[k] >= 30]


def test_what_waits_to_be_told_does_not_hold_whole_batches():
    """A frequent key in each of many batches of rare ones: only its own rows wait."""

    def batches():
        for i in range(100):
            keys = phrases.packed(np.full(5000, i + 1), np.append(np.zeros(50, np.int64), np.arange(1, 4951)), 8)
            yield pa.RecordBatch.from_arrays([pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([1] * 5000), pa.array(list(range(5000)))], names=["key", "n", "slice"])

    before, most, told = pa.total_allocated_bytes(), 0, 0
    for out in phrases._run_lengths(50, 5, True, 8, part=3)(batches()):
        most = max(most, pa.total_allocated_bytes() - before)
        told += sum(len(x) // 8 for x in out.column("told").to_pylist() if x)
    assert told == 100 * 50
    assert most < 10 * 5000 * (16 + 4 + 8 + 8)  # ten batches of a hundred


def test_slices_go_to_python_a_few_at_a_time(spark, monkeypatch):
    """A slice is a long row: Spark's own limits let a batch that is read have thousands of them, and one for Python 64 MB."""
    held, stored = {k: spark.conf.get(k, None) for k in phrases.BATCHES}, []
    seen = phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, name: stored.append((name, *(int(spark.conf.get(k)) for k in phrases.BATCHES))) or seen(df, name))
    df = spark.range(500).select(F.lit("en").alias("lang"), F.lit("to be or not to be that is").alias("text"))
    assert phrases.mine(df).count() > 0
    assert {"phrase-slices", "phrase-ids", "phrase-runs-2", "phrase-best"} <= {s[0] for s in stored}
    assert all(size <= 8 << 20 and rows <= 16 for _, size, rows in stored)
    assert {k: spark.conf.get(k, None) for k in phrases.BATCHES} == held
    row = phrases._coded(pa.array([1]), np.array([0, 1, 0, 0, 2, 2, 0], np.int32), np.array([7, 1 << 40]))
    assert row.column("codes").type.value_type == pa.int32() and row.column("codes")[0].as_py() == [1, 0, 2, 2]
    assert [x.tolist() for x in phrases.neighbours(np.array([1, 0, 2, 2, 1, 2, 2]), np.array([7, 1 << 40]))] == [[7, 1 << 40, 1 << 40], [1 << 40, 7, 1 << 40], [1, 1, 2]]


# 13: fill-in-middle


def _filled(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["", "a", "<P", "<P>", "x<S>y", "<M", "><M>", "<<P>", "<PP>", "<p>", "P>", "a<", "<", "é", "😀<S", "漢字 ab\n\tc", "<Ṕ>", "abc" * 50, "\x00\u0085", "M>a<S<M"]


def test_middles_equal_plain_python_and_come_back(spark):
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choices(list("abPSM<> é漢😀\n.,"), k=rng.randrange(1, 60))) for _ in range(400)] + ["wörter <b> " * 200_000]
    rows = [(i, t, "kept", "own") for i, t in enumerate(texts)] + [(None, "null id", None, "own"), (7, None, "null text", None), (3, "<P>", "kept", "own"), (3, "<P>", "kept", "own")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, form string")
    out = fim.fill_in_middle(df.repartition(3)).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(rows) and {r["form"] for r in out} == {"plain", "psm", "spm"}
    for r in out:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _filled(r.doc_id, r.text or "")
        assert r.back == (r.text or "") and r["a.b"] in ("kept", None, "null text")
    assert fim.fill_in_middle(df.limit(0)).collect() == []


def test_the_automaton_forgets_within_two_bytes():
    for state, a, b in itertools.product(range(4), range(6), range(6)):
        assert fim.TABLE[fim.TABLE[state, a] & 3, b] & 3 == fim.AFTER_TWO[a, b]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 64])
def test_scans_do_not_depend_on_blocks(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    texts = ODD + ["", "Mab <S> é", ""]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    text_at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    scan = fim.Scan(data, text_at)
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S) for t in texts]
    assert np.diff(scan.before[0]).tolist() == [len(u) for u in units]
    assert np.diff(scan.before[1]).tolist() == [len(t) for t in texts]
    assert np.diff(scan.before[2]).tolist() == [len(re.findall("<[PSM]>", t)) for t in texts]
    byte, points = scan.cuts(np.arange(sum(map(len, units))))
    flat = [x for u in units for x in u]
    assert byte.tolist() == [len("".join(flat[:i]).encode()) for i in range(len(flat))]
    assert points.tolist() == [len("".join(flat[:i])) for i in range(len(flat))]
