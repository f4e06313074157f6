"""Label registries, rule tables, model output, remembering streams, keyed tables and files as a source."""

import time

import pytest
from pyspark.sql import functions as F

from quillon.functions import aliases as al
from quillon.operators import labels, model_output, rule_table
from quillon.plans import QUERIES
from quillon.plans.lookups import WHOLE_REGISTRY
from quillon.plans.streams import run_out
from quillon.sinks import keyed
from quillon.sources import files
from quillon.streaming import stateful


def _best(label, registry):
    """An entry by entry search, as plain Python."""
    key, own = al.plain_key(label), set(al.plain_tokens(label))
    for names, score in ((lambda e: [e[0]], 99), (lambda e: e[2], 95)):
        for e in registry:
            if key in [al.plain_key(n) for n in names(e)]:
                return e[0], score
    over = lambda words: len(own & words) / len(own | words) if own and words else 0.0
    found = []
    for k, (name, priority, others, _, words) in enumerate(registry):
        held = {al.plain_key(w) for w in words}
        o = over(held)
        if o >= 0.45 and (any(w in key for w in held) or o >= 0.6):
            score = int(80.5 + o * 10)
        else:
            near = max(over(set(al.plain_tokens(a))) for a in (name, *others))
            score = 90 if near >= 0.75 else 85 if near >= 0.6 else 80 if near >= 0.5 else None
        if score:
            found.append((-score, -priority, k, name))
    return (min(found)[3], -min(found)[0]) if found else None


def test_label_joins_find_what_a_search_entry_by_entry_finds(spark):
    registry = tuple((n, p, a, (), w) for n, p, a, _, w in WHOLE_REGISTRY)
    words = ["bank", "guarantee", "amount", "period", "insurance", "delivery", "terms", "of", "sum", "payable", "award"]
    said = [" ".join(words[i % len(words)] for i in range(a, a + n)) for a in range(11) for n in range(1, 6)] + ["", " ", "EMD!", "Bank Guarantee Amount", "amount of bank guarantee"]
    frame = spark.createDataFrame([(s,) for s in said + said[:3]] + [(None,)], "label string")
    got = {r.label: (r.standard, r.score) for r in labels.resolved_labels(frame, labels.registry_tables(spark, registry)).collect()}
    assert got == {s: b for s in said if (b := _best(s, registry))} and len(got) > 30


def test_labels_match_in_a_few_seconds(spark, sf):
    QUERIES["j09_alias_match"](spark, sf).count()  # compiles
    began = time.perf_counter()
    QUERIES["j09_alias_match"](spark, sf).count()
    assert time.perf_counter() - began < 20


def test_rules_that_do_not_compile_or_are_off_are_left_out(spark):
    made = [("f", 1, "a+", 1, 50, True), ("f", 2, "(", 0, 99, True), ("f", 3, "b", 0, 90, False), ("g", 4, None, 0, 90, True), ("f", 5, "aa", 0, 50, True), ("g", 6, "c", 0, 10, True)]
    rules = spark.createDataFrame(made, "field string, rule_id int, pattern string, priority int, confidence int, active boolean")
    texts = spark.createDataFrame([(1, "x\naab c"), (2, "a"), (3, None), (4, "z")], "id int, text string")
    assert [r.rule_id for r in rule_table.usable(rules)] == [5, 6, 1]
    got = sorted((r.id, r.field, r.rule_id) for r in rule_table.best_matches(texts, rules, "id", "text").collect())
    assert got == [(1, "f", 5), (1, "g", 6), (2, "f", 1)]  # equal confidence: the lower priority number
    assert rule_table.best_matches(texts, rules.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize("raw, rows", [
    ('{"parameters": [{"parameter": "A", "value": "1", "page": "p. 4", "confidence": 90}]}', [("A", "1", 4, 90)]),
    ('so: {"parameters": [{"parameter": " A ", "value": 5}, {"parameter": "a", "value": "5"}]} ok', [("A", "5", 2, 87)]),
    ('{"parameters": [{"parameter": "B", "value": "none here", "confidence": "55.4"}, {"value": "x"}, {"parameter": "C", "value": {"x": 1}}, 7]}', [("B", "none here", 2, 55), ("C", '{"x":1}', 2, 75)]),
    ('{"parameters": [{"parameter": "Page 2 of 9", "value": "x"}, {"parameter": "D", "value": "N/A"}, {"parameter": "é", "value": "x"}]}', []),
    ("{broken", []), ("[]", []), ('{"parameters": {}}', []), (None, []), ("", []),
])
def test_model_output(spark, raw, rows):
    frame = spark.createDataFrame([(1, raw, "the value 5 is here", 2, 5)], "output_id int, raw string, text string, first_page int, last_page int")
    assert sorted((r.parameter, r.value, r.page, r.confidence) for r in model_output.output_rows(frame).collect()) == rows


def _batches(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_a_level_that_comes_back_is_sent_again(spark, tmp_path):
    schema = "key string, check_id int, at timestamp_ntz, level string"
    day = lambda n: __import__("datetime").datetime(2024, 1, n)
    made = [[("a", 1, day(1), "7_days"), ("a", 3, day(3), "3_days"), ("a", 2, day(2), "7_days"), ("b", 4, day(1), None)], [("a", 5, day(4), "3_days"), ("a", 6, day(5), "7_days"), ("b", 7, day(2), "expired")], [("b", 8, day(3), "expired"), ("a", 9, day(6), None), ("a", 10, day(7), "7_days")]]
    sent = run_out(stateful.new_levels(_batches(spark, tmp_path / "in", made, schema)), "levels", "append").collect()
    assert sorted((r.key, r.check_id, r.level) for r in sent) == [("a", 1, "7_days"), ("a", 3, "3_days"), ("a", 6, "7_days"), ("b", 7, "expired")]


def test_a_parameter_is_promoted_once_and_keeps_its_first_examples(spark, tmp_path):
    made = [[("p", f"c{i % 3}", f"e{i % 25:02d}", i) for i in range(30)] + [("q", None, "", 1)], [("p", "c9", f"f{i}", i) for i in range(25)], [("p", None, "x" * 300, 0), ("q", "c", "x" * 300, 0)]]
    rows = run_out(stateful.learned(_batches(spark, tmp_path / "in", made, "parameter string, category string, example string, at long")), "learned", "update").collect()
    by = {(r.parameter, r.batch): r for r in rows}
    last = [by[k] for k in sorted(by) if k[0] == "p"]
    assert [(r.event, r.frequency, r.categories) for r in last] == [("seen", 30, 3), ("promoted", 55, 4), ("seen", 56, 4)]
    assert all(r.examples == [f"e{i:02d}" for i in range(20)] for r in last)
    assert [(r.frequency, r.categories, r.examples) for k, r in sorted(by.items()) if k[0] == "q"] == [(1, 0, []), (2, 1, ["x" * 200])]


def test_keys_are_replaced_beside_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    rows = lambda t: sorted((str(r.k), r.v) for r in t.collect())
    assert keyed.read(spark, path) is None
    assert keyed.replace(frame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)]), path, ["k"], buckets=4) == 1
    before = keyed.read(spark, path)
    files_before = set(keyed.manifest(spark, path).values())
    assert keyed.replace(frame([("a", 9), (None, 7), ("d", 8)]), path, ["k"], buckets=4) == 2
    assert rows(before) == [("None", 4), ("a", 1), ("a", 2), ("b", 3), ("c", 5)]  # a reader that had begun goes on
    assert rows(keyed.read(spark, path)) == [("None", 7), ("a", 9), ("b", 3), ("c", 5), ("d", 8)]
    assert rows(keyed.read(spark, path, ["k"], frame([("a", 0), ("zz", 0)]), buckets=4)) == [("a", 9)]
    assert keyed.read(spark, path, ["k"], frame([]), buckets=4).count() == 0
    # a writer that dies before its manifest changes nothing
    frame([("b", 0)]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/data/lost")
    assert rows(keyed.read(spark, path)) == [("None", 7), ("a", 9), ("b", 3), ("c", 5), ("d", 8)]
    assert "lost" in keyed.vacuum(spark, path) and len(rows(keyed.read(spark, path))) == 5 and files_before


def test_files_are_loaded_once(spark, tmp_path):
    folder, store = tmp_path / "files", str(tmp_path / "hashes")
    (folder / "sub").mkdir(parents=True)
    for name, content in (("a.PDF", b"one"), ("b.docx", b"two"), ("sub/c.png", b"one"), ("empty", b""), ("large.pdf", b"x" * 50)):
        (folder / name).write_bytes(content)
    found = files.files(spark, str(folder), most_bytes=40)
    assert {r.name: (r.kind, r["size"], r.content is None) for r in found.collect()} == {"a.PDF": ("pdf", 3, False), "b.docx": ("docx", 3, False), "c.png": ("image", 3, False), "large.pdf": ("pdf", 50, True)}
    first = files.load_new(found, store, buckets=4)
    assert sorted(r.name for r in first.collect()) == ["a.PDF", "b.docx"]
    files.remember(first, store, buckets=4)
    (folder / "d.pdf").write_bytes(b"three")
    again = files.load_new(files.files(spark, str(folder), most_bytes=40), store, buckets=4)
    assert [r.name for r in again.collect()] == ["d.pdf"]
