"""JSON sessions, labels and the journal stream."""

from __future__ import annotations

import json

from emulsion.sources import session
from emulsion.streaming import journal
from pyspark.sql import functions as F


def write(folder, name, value):
    d = folder / name / ".session"
    d.mkdir(parents=True)
    (d / "roll.json").write_text(value if isinstance(value, str) else json.dumps(value))
    return str(d / "roll.json")


def test_sessions_with_defaults_versions_and_broken_files(spark, tmp_path):
    good = {
        "schema_version": 1, "app": "x", "unknown": 3, "excluded_files": ["z.cr3"],
        "images": {
            "a.cr3": {"file_size": 9, "mtime_ns": 1234567890123456789, "adjustments": {"exposure": 12, "nonsense": 1}, "lab_print_cmy_offsets": [0.1, 0.2, 0.3], "lab_print_cmy_strength": 65, "film_rect": {"x": 1, "y": 2, "width": 3, "height": 4, "angle": 0.5}},
            "b.cr3": {"lab_print_cmy_offsets": [0.1, 0.2], "lab_print_cmy_strength": 65, "lab_print_log_floors": [1, 2, 3], "film_rect": {"x": 1, "y": 2, "width": 0, "height": 4, "angle": 0}},
            "c.cr3": {"adjustments": {"auto_cmy_strength": 40}, "lab_print_cmy_offsets": [0.1, 0.2, 0.3], "lab_print_cmy_strength": 65},
        },
    }
    paths = [write(tmp_path, "roll1", good), write(tmp_path, "roll2", {**good, "schema_version": 2}), write(tmp_path, "roll3", "{not json")]
    rows = {r["file_name"]: r for r in session.adjusted(session.read_sessions(spark, *paths)).collect()}
    assert set(rows) == {"a.cr3", "b.cr3", "c.cr3"} and {r["folder"] for r in rows.values()} == {"roll1"}
    a, b, c = (rows[n] for n in sorted(rows))
    assert a["mtime_ns"] == 1234567890123456789 and a["exposure"] == 12 and a["mid_point"] == 50 and a["print_curve"] == "standard"
    assert tuple(a["cmy_offsets"]) == (0.1, 0.2, 0.3) and b["cmy_offsets"] is None and c["cmy_offsets"] is None
    assert a["film_rect"]["width"] == 3 and b["film_rect"] is None and b["log_floors"] is None
    assert [r[0] for r in session.excluded(spark, paths[0]).collect()] == ["z.cr3"]
    session.write_sessions(session.read_sessions(spark, *paths), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_labels(spark, tmp_path):
    lines = [{"name": "b", "negative_path": "/x/b.cr3"}, {"name": "a", "accepted": False, "quality": {"reason": "low"}}, {"name": "c", "confidence": 0.4, "negative_path": "/x/c.cr3"}, {}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    got = session.read_labels(spark, str(tmp_path / "l.jsonl"), least=0.5).collect()
    assert [(r["name"], r["confidence"], r["format"]) for r in got] == [("b", 1.0, "auto")]
    files = spark.createDataFrame([("c.cr3",)], "name string")
    assert [r["name"] for r in session.read_labels(spark, str(tmp_path / "l.jsonl"), files).collect()] == ["c"]
    every = spark.read.schema(session.LABELS).json(str(tmp_path / "l.jsonl")).filter("name is not null").withColumns({"accepted": F.coalesce("accepted", F.lit(True)), "confidence": F.coalesce("confidence", F.lit(1.0)), "format": F.coalesce("format", F.lit("auto"))})
    s = session.label_summary(every).first()
    assert (s["total"], s["accepted"], s["rejected"], s["rejection_reasons"], s["formats"]) == (3, 2, 1, {"low": 1}, {"auto": 2})


def test_json_defaults_and_keys(spark):
    df = spark.createDataFrame([('{"k": 3}',), ('{"k": "x"}',), ("broken",), (None,)], "j string")
    got = [r["k"] for r in session.with_defaults(df, "j", "k int", {"k": 20}).collect()]
    assert got == [3, 20, 20, 20]
    one = spark.createDataFrame([(1, None)], "b int, a string").select(session.canonical_key("b", "a").alias("k")).first()["k"]
    assert one == '{"a":null,"b":1}'


def test_journal_stream_counts_each_window_once(spark, tmp_path):
    path, out, mark = (str(tmp_path / n) for n in ("journal", "out", "mark"))
    at = lambda m: f"2026-01-01T{m // 60:02d}:{m % 60:02d}:00"
    journal.append(spark, path, [{"time": at(0), "event": "batch_start"}, {"time": at(1), "event": "item_done", "source": "a"}, {"time": at(2), "event": "item_done", "source": "b"}, {"time": "bad", "event": "item_done"}, {"time": at(3), "event": "other"}])
    journal.start(spark, path, out, mark).awaitTermination()
    journal.append(spark, path, [{"time": at(300), "event": "item_failed", "source": "a"}])
    journal.start(spark, path, out, mark).awaitTermination()
    journal.append(spark, path, [{"time": at(4), "event": "item_done", "source": "late"}, {"time": at(600), "event": "batch_finish"}])
    journal.start(spark, path, out, mark).awaitTermination()
    rows = {(r["event"], r["n"]) for r in spark.read.parquet(out).collect()}
    assert ("item_done", 2) in rows and ("batch_start", 1) in rows and ("item_done", 3) not in rows
    state = {r["source"]: r["done"] for r in journal.last_state(journal.read(spark, path)).collect()}
    assert state["a"] is False and state["b"] is True
