import json

import pytest
import yaml
from pyspark.sql import functions as F

from loomtext.operators import corpus as c
from loomtext.plans import cli, config
from loomtext.plans import predictive as pv
from loomtext.plans.report import run_report
from loomtext.plans.crossval import run_crossval
from loomtext.plans.text_corpus import united
from loomtext.sources import readers as rd
from loomtext.sources import writers as wr
from loomtext.sources.collection import FIELDS, Collection
from loomtext.streaming.clean import clean_stream

GOOD = "我看到一隻貓在桌子上面跑來跑去，然後牠把杯子打翻了，"


def lines(path):
    return [json.loads(x) for f in sorted(path.glob("part-*")) for x in f.read_text("utf-8").splitlines()]


@pytest.fixture(scope="module")
def setting(tmp_path_factory):
    """A small tree of inputs and the configuration that reads it."""
    root = tmp_path_factory.mktemp("plans")
    for label, names in {"AD": ["a.wav", "ad_b.MP3", "notes.txt"], "HC": ["c.flac"]}.items():
        (root / "audio" / label).mkdir(parents=True)
        for name in names:
            (root / "audio" / label / name).write_bytes(b"x")
    (root / "meta.csv").write_text("uuid,label,sex\nu1,AD,F\nu1,HC,M\n nan ,AD,F\nu2,NC,M\nu3,AD,F\n", "utf-8")
    (root / "egemaps.csv").write_text("uuid,f1,f2\nu1,0.5,1\nu2,1.5,2\nu9,3,3\n", "utf-8")
    (root / "tsv").mkdir()
    (root / "tsv" / "u1.tsv").write_text(f"no\tstart_time\tspeaker\tvalue\n2\t1.0\t<B>\t{GOOD}貓\n1\t2.0\tB\t{GOOD}狗\n3\t3\t<A>\tno\n4\t4\tsil\tx\n", "utf-8")
    (root / "tsv" / "u2.tsv").write_text("no\tstart_time\tspeaker\tvalue\n1\t1\tB\tsp\n", "utf-8")
    first = [{"ID": f"{k:04d}", "Diagnosis": "Probable AD" if k % 2 else "healthy_control", "Text_interviewer_participant": f"{GOOD * (1 + k % 3)}{k}", "Dataset": "one", "Languages": "zh"} for k in range(40)]
    first += [{"ID": "0000", "Diagnosis": "AD", "Text_interviewer_participant": "later", "Dataset": "one", "Languages": "zh"}, {"ID": "en", "Diagnosis": "AD", "Text_interviewer_participant": GOOD, "Dataset": "one", "Languages": " EN "}]
    second = [{"id": "s1", "label": "HC", "transcript": "短"}, {"id": "s2", "label": "MCI", "transcript": GOOD}]
    for name, rows in (("first", first), ("second", second)):
        (root / f"{name}.jsonl").write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows), "utf-8")
    (root / "words.vec").write_text("3 2\n我 1 0 9\n貓 0 1\nbad x y\n我 0.5 0.5\n", "utf-8")
    logistic = {"C": 1.0, "class_weight": "balanced", "solver": "lbfgs", "max_iter": 50}
    setting = {
        "common": {"seed": 42},
        "asr": {"data_root": str(root / "audio"), "output_csv": str(root / "asr_csv")},
        "predictive": {
            "meta_csv": str(root / "meta.csv"), "egemaps_csv": str(root / "egemaps.csv"), "tsv_root": str(root / "tsv"), "output_text_jsonl": str(root / "predictive.jsonl"),
            "output_egemaps_csv": str(root / "features_csv"), "dataset_name": "P", "tsv": {"keep_speakers": ["<B>"], "drop_silence": True, "order_by": "no"},
        },
        "text": {
            "ncmmsc_jsonl": str(root / "asr.jsonl"), "output_dir": str(root / "out"), "combined_name": "combined.jsonl", "cleaned_jsonl": str(root / "out" / "cleaned.jsonl"),
            "corpora": [{"name": "one", "path": str(root / "first.jsonl")}, {"name": "two", "path": str(root / "second.jsonl")}, {"name": "none", "path": None}, {"name": "asr", "path": str(root / "asr.jsonl")}],
            "target_datasets": ["one", "two"], "target_labels": ["AD", "HC"], "cap_per_class": 300, "subset_seed": 42, "label_map": {"HEALTHY_CONTROL": "HC"}, "language_filter": {"drop_languages": ["en"]},
            "prompt_filter": {"enabled": True, "apply_datasets": ["one"], "patterns": ["^請"]}, "quality_filter": {"enabled": True}, "length_filter": {"enabled": True, "std_k": 2.5},
        },
        "features": {
            "tfidf": {"vectorizer": {"ngram_range": [2, 3], "max_features": 200}, "logreg": logistic},
            "glove": {"embeddings_path": str(root / "words.vec"), "embedding_dim": 2, "tokenizer": "char", "logreg": logistic},
            "bert": {"pooling": "mean", "logreg": logistic},
            "crossval": {"n_splits": 3, "random_state": 42, "output_indices": str(root / "folds.json"), "metrics_output": str(root / "metrics.json"), "methods": ["tfidf", "glove", "bert"], "tfidf_fit_scope": "train", "train_balance": {"enabled": True, "strategy": "downsample", "random_state": 42}},
        },
    }
    path = root / "config.yaml"
    path.write_text(yaml.safe_dump(setting, allow_unicode=True), "utf-8")
    return root, str(path)


def test_steps(spark, setting):
    root, path = setting

    def recogniser():
        def one(file):
            if "c.flac" in file:
                raise OSError
            return [" 我 ", "", "看"], 1.5

        return one

    def encoder():
        return lambda texts: [([[[float(len(t)), float(t.count("1"))]]], [1]) for t in texts]

    cli.main(["--config", path, "--asr", "--predictive", "--text", "--cv", "--report", "--outdir", str(root / "report"), "--draw-boundary", "--unknown"], spark=spark, recogniser=lambda: recogniser(), encoders={"bert": encoder})
    asr = {r.id: r for r in rd.csv_table(spark, str(root / "asr_csv")).collect()}
    assert set(asr) == {"AD_a", "ad_b", "HC_c"} and asr["AD_a"].transcript == "我 看" and asr["HC_c"].transcript is None and float(asr["HC_c"].duration) == 0
    predictive = {r["ID"]: r for r in lines(root / "predictive.jsonl")}
    assert set(predictive) == {"u1", "u2"} and predictive["u1"]["Text_interviewer_participant"] == f"{GOOD}狗 {GOOD}貓" and predictive["u2"]["Text_interviewer_participant"] == ""
    assert predictive["u2"]["Diagnosis"] == "HC" and predictive["u1"]["age"] is None and predictive["u1"]["sex"] == "F"
    table = rd.csv_table(spark, str(root / "features_csv"))
    assert table.columns[0].endswith("uuid") and table.columns[1:] == ["Diagnosis", "sex", "f1", "f2"] and table.count() == 2
    cleaned = lines(root / "out" / "cleaned.jsonl")
    assert len(cleaned) == 40 and {r["ID"] for r in cleaned} == {f"{k:04d}" for k in range(40)} and cleaned[0]["Text_interviewer_participant"].endswith("0")
    assert len(lines(root / "out" / "combined.jsonl")) == 44
    folds = json.loads((root / "folds.json").read_text())
    assert sorted(i for f in folds for i in f["test_idx"]) == list(range(40))
    metrics = json.loads((root / "metrics.json").read_text())
    assert set(metrics["methods"]) == {"tfidf", "glove", "bert"} and metrics["data"]["label_counts"] == {"HC": 20, "AD": 20}
    assert len(metrics["methods"]["tfidf"]["fold_metrics"]) == 3 and metrics["methods"]["tfidf"]["tfidf_fit_scope"] == "train"
    report = rd.csv_table(spark, str(root / "report" / "results_table"))
    assert [r.Model for r in report.collect()] == ["TF-IDF (char 2–4gram)", "BERT-base (mean pooling)", "fastText/GloVe (300d)"]
    record = metrics["methods"]["glove"]["fold_metrics"][0]
    assert record["n_train"] + record["n_test"] == record["n_train_before_balance"] + record["n_test"] == 40 and record["train_label_counts"]["HC"] + record["test_label_counts"]["HC"] == 20
    assert not (root / "report" / "combined_boundary").exists() and (root / "report" / "combined_2d").exists()
    assert (root / "report" / "results_table.tex").exists() and rd.csv_table(spark, str(root / "report" / "cleaned_boundary")).count() == 280 * 280
    other = str(root / "other")
    cli.main(["--config", path, "--report", "--outdir", other, "--draw-boundary", "--boundary-scope", "both"], spark=spark)
    assert (root / "other" / "combined_boundary").exists()
    cli.main(["--config", path, "--cv", "--reuse-folds", "--methods", "glove"], spark=spark)
    assert json.loads((root / "folds.json").read_text()) == folds
    (root / "folds.json").write_text(json.dumps(folds[:2]))
    with pytest.raises(ValueError, match="other rows"):
        cli.main(["--config", path, "--cv", "--reuse-folds", "--methods", "glove"], spark=spark)
    with pytest.raises(ValueError, match="recogniser"):
        cli.main(["--config", path, "--asr"], spark=spark)
    with pytest.raises(SystemExit):
        cli.main(["--config", path], spark=spark)


def test_readers(spark, setting, tmp_path):
    root, _ = setting
    vectors = {r.word: list(r.vec) for r in rd.word_vectors(spark, str(root / "words.vec"), 2).collect()}
    assert vectors == {"我": [0.5, 0.5], "貓": [0.0, 1.0]} or vectors == {"我": [0.5, 0.5], "貓": [0.0, 1.0], "3": [2.0]}
    assert rd.word_vectors(spark, str(root / "words.vec"), 2, 1).count() == 1 and rd.word_vectors(spark, str(root / "words.vec"), 2, 0).count() == 0
    assert rd.audio_tree(spark, str(root / "audio"), cap=1).count() == 2 and rd.audio_tree(spark, str(root / "audio"), ["hc"]).count() == 1
    numbered = rd.numbered_json_lines(spark, str(root / "second.jsonl"), "id string").collect()
    assert [(r.id, r._line_at) for r in numbered] == [("s1", 0), ("s2", 1)]
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[2]\n"x"\n')
    assert [r.record for r in rd.checked_json_lines(spark, str(tmp_path / "a.jsonl")).collect()] == ['{"a": 1}', '{"_value": [2]}', '{"_value": "x"}']
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n\n' * 20 + "{oops\n")
    with pytest.raises(Exception, match="not JSON in .*bad.jsonl, line 41: .oops"):
        rd.checked_json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    wr.combine_json_lines(spark, [str(tmp_path / "a.jsonl")], str(tmp_path / "all"))
    assert len(lines(tmp_path / "all")) == 3
    with pytest.raises(ValueError):
        wr.combine_json_lines(spark, [], str(tmp_path / "x"))
    with pytest.raises(FileNotFoundError):
        wr.combine_json_lines(spark, [str(tmp_path / "missing")], str(tmp_path / "x"))
    (tmp_path / "folds.json").write_text('[{"train_idx": [1]}]')
    with pytest.raises(ValueError):
        rd.folds(spark, str(tmp_path / "folds.json"))
    got = rd.texts_and_labels(spark.createDataFrame([("b", "x"), ("a", "y"), ("a", " "), (None, "z")], "Diagnosis string, utterance string"))
    assert sorted((r.label, r.y) for r in got.collect()) == [("a", 0), ("b", 1)]
    rows = wr.transcript_rows(spark.createDataFrame([(" i ", None, None, "p", "bad")], "id string, label string, transcript string, audio_path string, duration string"), F.upper, older=True)
    assert tuple(rows.first()) == ("i", "", "", "", "p", 0.0)
    wr.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    wr.write_json_lines(spark.createDataFrame([(2, None)], "a int, b string"), str(tmp_path / "j"), force=False)
    assert lines(tmp_path / "j") == [{"a": 1, "b": None}]


def test_lines_keep_their_order_over_files_and_splits(spark, tmp_path):
    """Splits of a few lines, dealt into partitions by size: numbers and ordinals are those of the files."""
    for name, n in (("b", 400), ("a", 37), ("c", 900)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"id": f"{name}{k}", "k": k}) + "\n" for k in range(n)))
    places = [str(tmp_path / f"{name}.jsonl") for name in "abc"]
    before = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert spark.read.text(places).rdd.getNumPartitions() > 5
        rows = rd.numbered_lines(spark, places).collect()
        assert sorted((r.path.rpartition("/")[2], r.number, json.loads(r.value)["id"]) for r in rows) == sorted((f"{n}.jsonl", k + 1, f"{n}{k}") for n, of in (("a", 37), ("b", 400), ("c", 900)) for k in range(of))
        for name, n in (("b", 400), ("c", 900)):
            own = rd.json_lines(spark, str(tmp_path / f"{name}.jsonl"), ordered=True).repartition(11)
            assert [r.id for r in sorted(own.collect(), key=lambda r: r._line_at)] == [f"{name}{k}" for k in range(n)]
        wr.combine_json_lines(spark, places, str(tmp_path / "all"))
        assert [r["id"] for r in lines(tmp_path / "all")] == [f"{n}{k}" for n, of in (("a", 37), ("b", 400), ("c", 900)) for k in range(of)]
        # the first of the records with one id stays, in the order of corpora and then of lines
        rows = [{"ID": str(k % 150), "Diagnosis": "AD", "Text_interviewer_participant": f"t{k}", "Dataset": "d"} for k in range(600)]
        (tmp_path / "first.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        (tmp_path / "second.jsonl").write_text("".join(json.dumps(r | {"Text_interviewer_participant": "later", "ID": str(int(r["ID"]) + 100)}) + "\n" for r in rows))
        corpora = [(n, rd.json_lines(spark, str(tmp_path / f"{n}.jsonl"), ordered=True)) for n in ("first", "second")]
        kept = {r.ID: r[c.TEXT] for r in c.dedup_records(c.union_corpora(corpora)).collect()}
        assert kept == {str(k): f"t{k}" if k < 150 else "later" for k in range(250)}
        (tmp_path / "meta.csv").write_text("uuid,label,n\n" + "".join(f"u{k % 90},AD,{k}\n" for k in range(700)))
        found = pv.subjects(rd.csv_table(spark, str(tmp_path / "meta.csv"), ordered=True)).collect()
        assert sorted((r.uuid, int(r.n)) for r in found) == sorted((f"u{k}", k) for k in range(90))
        (tmp_path / "w.vec").write_text("".join(f"w{k % 60} {k}.0 1.0\n" for k in range(500)))
        assert {r.word: int(r.vec[0]) for r in rd.word_vectors(spark, str(tmp_path / "w.vec"), 2).collect()} == {f"w{k % 60}": k for k in range(440, 500)}
        assert {int(r.vec[0]) for r in rd.word_vectors(spark, str(tmp_path / "w.vec"), 2, 50).collect()} == set(range(50))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_report_without_metrics_or_with_a_bad_combined_corpus(spark, setting, tmp_path):
    root, path = setting
    conf = dict(config.load_config(path))
    conf["features"] = conf["features"] | {"crossval": conf["features"]["crossval"] | {"metrics_output": str(tmp_path / "none.json")}}
    (tmp_path / "combined.jsonl").write_text('{"other": 1}\n')
    conf["text"] = conf["text"] | {"output_dir": str(tmp_path)}
    run_report(spark, conf, str(tmp_path / "report"))
    assert (tmp_path / "report" / "cleaned_lengths").exists() and not (tmp_path / "report" / "results_table").exists() and not (tmp_path / "report" / "combined_lengths").exists()
    with pytest.raises(ValueError):
        run_report(spark, conf, str(tmp_path / "report"), boundary_scope="none")


def test_missing_corpora_are_skipped_only_if_told(spark, setting):
    text = dict(config.load_config(setting[1])["text"])
    text["corpora"] = [text["corpora"][0], {"name": "two", "path": str(setting[0] / "missing.jsonl")}]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|not exist"):
        united(spark, text)
    for options, told in ((text | {"skip_missing_corpora": True}, None), (text, True)):
        assert united(spark, options, skip_missing=told).count() == 42


def test_large_folds_are_a_table_that_reads_like_the_document(spark, tmp_path):
    folded = spark.range(10).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"))
    found = {}
    for most in (20, 4):
        path = str(tmp_path / f"{most}.json")
        wr.write_folds(folded, path, n_splits=3, most=most)
        back = rd.folds(spark, path)
        wr.check_folds(back, folded.select("row_id"))
        found[most] = sorted(map(tuple, back.collect()))
        with pytest.raises(ValueError):
            wr.check_folds(back, spark.range(9).select(F.col("id").alias("row_id")))
    assert found[20] == found[4] and len(found[4]) == 30
    assert "table" in json.loads((tmp_path / "4.json").read_text()) and isinstance(json.loads((tmp_path / "20.json").read_text()), list)
    for bad in ("{}", "[]", "no", '[{"train_idx": "x", "test_idx": []}]'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(ValueError):
            rd.folds(spark, str(tmp_path / "bad.json"))


def test_crossval_over_a_folds_table(spark, setting, tmp_path, monkeypatch):
    """More rows than the document lists: the folds are written, read back and used again."""
    monkeypatch.setattr(wr.write_folds, "__kwdefaults__", wr.write_folds.__kwdefaults__ | {"most": 5})
    words = [("wo shi hao ma", "HC"), ("ni bu shi ta de", "AD")]
    rows = [json.dumps({"ID": str(k), "Dataset": "d", "Text_interviewer_participant": f"{words[k % 2][0]} {k}", "Diagnosis": words[k % 2][1]}) for k in range(24)]
    (tmp_path / "cleaned.jsonl").write_text("\n".join(rows))
    vectorizer = {"ngram_range": [2, 2], "max_features": 50}
    cv = {"methods": ["tfidf"], "n_splits": 3, "random_state": 1, "output_indices": str(tmp_path / "folds.json"), "metrics_output": str(tmp_path / "metrics.json")}
    conf = {"text": {"cleaned_jsonl": str(tmp_path / "cleaned.jsonl")}, "features": {"crossval": cv, "tfidf": {"vectorizer": vectorizer}}}
    first = json.loads(open(run_crossval(spark, conf)).read())
    assert json.loads((tmp_path / "folds.json").read_text()) == {"n_splits": 3, "table": "folds.json.rows"}
    again = json.loads(open(run_crossval(spark, conf, reuse_folds=True)).read())
    assert first == again and first["data"]["n_samples"] == 24


def test_collection(spark):
    class Own(Collection):
        def raw(self, spark):
            return spark.createDataFrame([("p", "x")], "pid string, said string")

        def normalise(self, raw):
            return raw.select(F.col("pid").alias("PID"), F.array(F.lit("t")).alias("Task"), F.col("said").alias("Text_participant"))

    row = Own("here", "zh").normalised(spark).first()
    assert row.asDict().keys() == set(FIELDS) and (row.PID, row.Languages, row.Task, row.MMSE) == ("p", "zh", ["t"], None) and len(FIELDS) == 26


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("- 1")
    with pytest.raises(ValueError):
        config.load_config(tmp_path / "c.yaml")
    with pytest.raises(ValueError):
        config.section({"a": 1}, "a")
    with pytest.raises(KeyError):
        config.require({}, "a")
    assert config.names([" a ", "", None]) == ["a"] == config.names("a") and config.names([]) is None is config.names(" ")
    for bad in ({"balance": 1}, {"cap_per_class": True}, {"cap_per_class": -1}, {"cap_per_class": 3}):
        with pytest.raises(ValueError):
            config.sampling(bad)
    assert config.train_balance({"enabled": True, "strategy": "upsample"}) == {"balance": "upsample", "seed": 0} and config.train_balance(None)["balance"] == "none"
    assert [config.device(d, a) for d, a in (("auto", True), ("cuda", False), ("cpu", True), (None, False))] == ["cuda", "cpu", "cpu", "cpu"]


def test_stream_is_the_batch(spark, tmp_path):
    schema = f"ID string, {c.LABEL} string, {c.TEXT} string, {c.DATASET} string"
    rows = spark.createDataFrame([("1", "NC", f"Doctor: {GOOD} [聽不清楚]", "D"), ("2", "AD", "短", "D")], schema)
    rows.write.json(str(tmp_path / "in"))
    clean_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("cleaned").collect() == clean_stream(rows).collect() and spark.table("cleaned").first().Diagnosis == "HC"


def test_metrics_of_many_documents(spark, tmp_path):
    """Documents need not be alike; what isn't a number of a fold is left out, and what isn't JSON fails."""
    from loomtext.plans.report import fold_metrics_of
    from loomtext.sources.readers import metrics_runs

    one = {"methods": {"tfidf": {"fold_metrics": [{"fold": 1, "accuracy": 0.5, "f1": 1, "note": "x"}, {"fold": 2, "accuracy": 0.25, "own": 7.5}]}, "bert": {"error": "no model"}}}
    two = {"methods": {"glove": {"fold_metrics": [{"fold": 1, "accuracy": None, "recall": 0.125}]}, "linq": {"fold_metrics": []}}, "made": "later"}
    for name, document in (("one", one), ("two", two), ("three", {"other": 1})):
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=2))
    rows = metrics_runs(spark, str(tmp_path))
    got = {(r.run.rsplit("/", 1)[1], r.method, r.fold, r.metric): r.value for r in rows.collect()}
    own = [("accuracy", 1, 0.5), ("f1", 1, 1.0), ("accuracy", 2, 0.25), ("own", 2, 7.5)]
    assert got == {("one.json", "tfidf", fold, metric): value for metric, fold, value in own} | {("two.json", "glove", 1, "recall"): 0.125}
    wide = {(r.method, r.fold): (r.accuracy, r.precision, r.recall, r.f1) for r in fold_metrics_of(rows).collect()}
    assert wide == {("tfidf", 1): (0.5, None, None, 1.0), ("tfidf", 2): (0.25, None, None, None), ("glove", 1): (None, None, 0.125, None)}
    (tmp_path / "bad.json").write_text("{not json")
    with pytest.raises(Exception, match="MALFORMED"):
        metrics_runs(spark, str(tmp_path)).count()
