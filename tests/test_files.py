"""Readers, sinks and configuration against files of a temporary folder."""

from __future__ import annotations

import json
import time

import pytest

from vocalis.operators import index
from vocalis.sources import config, files, readers, sinks

SEGMENTS = "doc_id bigint, idx bigint, speaker string, text string, t0 bigint, t1 bigint"


def test_layers_and_profiles():
    base = {"a": {"b": 1, "c": [1]}, "d": 2, "profiles": {"fast": {"description": "x", "a": {"c": [2, 3]}, "e": {"f": 1}}}}
    assert config.merged({"a": {"b": 1}}, {"a": {"c": 2}}, {"a": 3}) == {"a": 3}
    assert config.profiled(base, "fast") == {**base, "a": {"b": 1, "c": [2, 3]}, "e": {"f": 1}}
    assert config.profiled(base, "none") == base
    assert config.overridden({"a": {"b": 1}}, {"a.b": 2, "x.y.z": True}) == {"a": {"b": 2}, "x": {"y": {"z": True}}}
    assert base["a"] == {"b": 1, "c": [1]}


def test_strict_checks():
    schema = {"a.b": int, "a.c": (list, str), "d": float}
    assert config.checked({"a": {"b": 1, "c": "x"}, "d": 0.5}, schema, ["a.b"]) is not None
    assert config.problems({"a": {"b": True, "z": 1}, "q": {}}, schema, ["d"]) == ["a.b: bool isn't int", "a.z: unknown", "q: unknown", "d: missing"]
    with pytest.raises(ValueError, match="unknown"):
        config.checked({"zz": 1}, schema)
    assert config.stages(" Clean, export ,", ["clean", "export"]) == ["clean", "export"]
    assert config.stages("", ["clean"]) is None
    with pytest.raises(ValueError, match="unknown stage"):
        config.stages("fly", ["clean"])


def test_rule_and_term_files(spark, tmp_path):
    (tmp_path / "rules.json").write_text(json.dumps({"rules": [{"pattern": "a", "replacement": "b"}, {"pattern": "c"}, "no", {"pattern": "", "replacement": "x"}, {"pattern": "d", "replacement": 5}]}))
    assert readers.rule_file(spark, str(tmp_path / "rules.json")) == [("a", "b"), ("d", "5")]
    assert readers.rule_file(spark, str(tmp_path / "none.json")) == []
    (tmp_path / "terms.txt").write_text("# comment\n Spark  SQL \n\nÉté\nspark sql\n", encoding="utf-8")
    assert [r.term for r in readers.term_list(spark, ["Kafka"], str(tmp_path / "terms.txt")).orderBy("term").collect()] == ["kafka", "spark sql", "été"]
    (tmp_path / "pairs.txt").write_text("# c\nchat gpt\tChatGPT\nno tab\nChat GPT\tChatGPT 4\n")
    got = readers.term_pairs(spark, [("ia", "IA"), ("only one",)], str(tmp_path / "pairs.txt"))
    assert [tuple(r) for r in got.orderBy("term").collect()] == [("chat gpt", "ChatGPT 4"), ("ia", "IA")]
    (tmp_path / "large.jsonl").write_text("x" * (files.MOST_BYTES + 1))
    with pytest.raises(ValueError, match="more than"):
        readers.rule_lines(spark, str(tmp_path / "large.jsonl"))


def test_run_manifest_is_replaced_at_once(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "out"))
    path = str(tmp_path / "run_manifest.json")
    sinks.write_run(spark, path, time.time() - 2, [{"name": "clean", "seconds": 1.0}], {"out": str(tmp_path / "out"), "gone": str(tmp_path / "gone")}, error="boom")
    assert json.loads((tmp_path / "run_manifest.json").read_text())["status"] == "failed"
    manifest = sinks.write_run(spark, path, time.time() - 2, [], {"out": str(tmp_path / "out")}, input="d.json")
    assert json.loads((tmp_path / "run_manifest.json").read_text()) == manifest
    assert manifest["status"] == "ok"
    assert manifest["export_bytes"]["out"] > 0
    assert 2 <= manifest["duration_sec"] < 60
    assert [p.name for p in tmp_path.iterdir() if "tmp" in p.name] == []


def test_formats_and_dry_run(spark, tmp_path):
    s = spark.createDataFrame([(1, 0, "A", "un \"deux\"", 0, 1500), (1, 1, "", "trois", 1500, 2000)], SEGMENTS)
    out = str(tmp_path / "export")
    with pytest.warns(UserWarning, match="pdf"):
        assert sorted(sinks.write_formats(s, out, ["TXT", " json", "pdf", "txt"], dry_run=True)) == ["json", "txt"]
    assert not (tmp_path / "export").exists()
    paths = sinks.write_formats(s, out, ["txt", "srt", "jsonl"])
    assert spark.read.parquet(paths["txt"]).first().body == "A: un \"deux\"\ntrois"
    assert spark.read.parquet(paths["srt"]).first().body.startswith("1\n00:00:00,000 --> 00:00:01,500\nun")
    assert json.loads(spark.read.parquet(paths["jsonl"]).first().body.split("\n")[1])["text"] == "trois"
    with pytest.raises(FileExistsError):
        sinks.write_formats(s, out, ["txt"])
    before = sorted(p.name for p in (tmp_path / "export" / "txt").iterdir())
    sinks.write_formats(s, out, ["txt"], force=True, dry_run=True)
    assert sorted(p.name for p in (tmp_path / "export" / "txt").iterdir()) == before
    sinks.write_formats(s, out, ["txt"], force=True)


def test_stage_reload_by_version(spark, tmp_path):
    path = str(tmp_path / "stage")
    assert readers.stage_output(spark, path, "v1") is None
    sinks.write_stage(spark.range(4), path, "v1")
    assert readers.stage_output(spark, path, "v1").count() == 4
    assert readers.stage_output(spark, path, "v2") is None


def test_postprocess_outputs(spark, tmp_path):
    rows = [(1, 0, "A", "Bonjour", False, False), (1, 1, "A", "euh", True, False), (1, 2, "", "Au revoir", None, True), (2, 0, None, "x", True, None)]
    phrases = spark.createDataFrame(rows, "doc_id bigint, idx bigint, speaker string, text string, dropped boolean, flagged boolean")
    orphans = spark.createDataFrame([(1, "perdu"), (1, " ")], "doc_id bigint, text string")
    sinks.write_postprocess(phrases, str(tmp_path / "p"), orphans)
    body = lambda name: {r.doc_id: r.body for r in spark.read.parquet(str(tmp_path / "p" / name)).collect()}
    assert body("normalized") == {1: "A: Bonjour\n\nAu revoir\n", 2: "\n"}
    assert body("final") == {1: "A : Bonjour\n\n⚠️ Au revoir\n\n⚠️ Phrases à vérifier\n\n- perdu\n", 2: "\n"}
    assert body("markdown")[1].startswith("**A** : Bonjour\n\n")
    qa = {r.doc_id: (r.phrases, r.dropped, r.flagged) for r in spark.read.json(str(tmp_path / "p" / "qa")).collect()}
    assert qa == {1: (3, 1, 1), 2: (1, 1, 0)}


def test_searches_over_a_stored_index(spark, tmp_path):
    built = index.build(spark.createDataFrame([("1-0", "l'installation du serveur"), ("2-0", "le serveur est prêt"), ("2-1", "rien")], "chunk_id string, text string"))
    sinks.write_index(built, str(tmp_path / "ix"), 4)
    stored = readers.index(spark, str(tmp_path / "ix"))
    assert sorted(map(str, index.bm25(stored, ["serveur"], 5).collect())) == sorted(map(str, index.bm25(built, ["serveur"], 5).collect()))
    assert [r.chunk_id for r in index.match_phrase(stored, ["serveur", "est"]).collect()] == ["2-0"]
