import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tonemill.sources import corpus, files, registry, requests
from tonemill.sources.lexicon import by_term, parse_lines, read_lexicon, score_lexicon


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "lexicon.txt"
    path.write_text(
        "# a comment\n  # another\n"
        "a\t1\t0.5\t0.25\tgood#1 fine#2\tgloss\n"
        "a\t2\t0.75\t0\tfine#2 Good_one#1\tgloss\n"
        "n\t3\t0\t0.5\tgood#4\tgloss\n"
        "a\t4\t0\t1\tgood#3\tgloss\n"
    )
    got = {(r.term, r.pos): r.score for r in score_lexicon(read_lexicon(spark, str(path))).collect()}
    assert got[("fine", "a")] == pytest.approx(0.75)
    assert got[("goodone", "a")] == pytest.approx(0.75)
    assert got[("good", "a")] == pytest.approx((0.25 / 1 - 1 / 3) / (1 + 1 / 3))
    assert got[("good", "n")] == pytest.approx(-0.5)


@pytest.mark.parametrize("line", ["a\t1\t0.5\t0.25\tgood#1", "a\t1\t0.5\t0.25\tgood#1\t", "a\t1\t0\t0\tx#1\tg\tmore", ""])
def test_lexicon_lines_need_six_fields(spark, line):
    lines = spark.createDataFrame([("n\t9\t0\t0\tok#1\tg",), (line,)], "value string")
    with pytest.raises(PySparkException, match="six fields"):
        parse_lines(lines).collect()


def test_by_term_sums_parts_of_speech(spark):
    scores = spark.createDataFrame([("x", "a", 0.5), ("x", "v", -0.25)], "term string, pos string, score double")
    row = by_term(scores).first()
    assert (row.score_adj, row.score_verb, row.score_noun, row.score_total) == (0.5, -0.25, 0.0, 0.25)


def test_formats():
    assert corpus.parse_format("score sentence") == corpus.LineFormat(True, {0: "neg", 1: "pos"})
    assert corpus.parse_format("sentence score") == corpus.LineFormat(False, {0: "neg", 1: "pos"})
    assert corpus.parse_format("ScoreX text 0=bad;2=good;q=no;3") == corpus.LineFormat(True, {0: "bad", 2: "good"})
    assert corpus.parse_format("text score q=no") == corpus.LineFormat(False, {0: "neg", 1: "pos"})
    assert corpus.parse_format(None) == corpus.LineFormat(False, {0: "neg", 1: "pos"})


def test_bad_lines_are_set_aside(spark):
    lines = ["only one", "a\tb\tc", "text\t7", "text\tzzz", "text\t", "\t1", "fine\t01", "fine\tneg", "tabs\t0\t\t", ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    split = corpus.split_lines(df, corpus.parse_format("sentence score"))
    good = {(r.text, r.label) for r in corpus.good_lines(split).collect()}
    assert good == {("", "pos"), ("fine", "pos"), ("fine", "neg"), ("tabs", "neg")}
    bad = {r.value: r.reason for r in corpus.bad_lines(split).collect()}
    assert bad == {
        "only one": corpus.NOT_TWO_FIELDS, "a\tb\tc": corpus.NOT_TWO_FIELDS, "text\t": corpus.NOT_TWO_FIELDS,
        "": corpus.NOT_TWO_FIELDS, "text\t7": corpus.UNKNOWN_CLASS, "text\tzzz": corpus.UNKNOWN_CLASS,
    }


def test_class_directories(spark, tmp_path):
    root = tmp_path / "my corpus"
    for label, name, body in [("pos", "a.txt", "Größe\nzwei"), ("neg +1", "b c.txt", "bad"), ("neg +1", "d", "")]:
        (root / label).mkdir(parents=True, exist_ok=True)
        (root / label / name).write_text(body)
    (root / "loose.txt").write_text("no class")
    got = {(r.label, r.text) for r in corpus.read_class_dirs(spark, str(root)).collect()}
    assert {("pos", "Größe\nzwei"), ("neg +1", "bad")} <= got
    assert all(label in {"pos", "neg +1"} for label, _ in got)
    # Empty files hold no row, and the file source does not list them.
    assert corpus.class_dir_files(spark, str(root)).count() == 2


def test_class_directories_are_listed_once_each(spark, tmp_path):
    root = tmp_path / "corpus"
    for where in ("pos", "neg", "pos/corpus/deep", "pos/corpus/pos"):
        (root / where).mkdir(parents=True)
    for where in ("pos/a", "pos/b", "neg/c", "neg/d", "neg/e"):
        (root / where).write_text(where)
    (root / "pos/corpus/deep/f").write_text("too deep")
    (root / "pos/corpus/pos/g").write_text("too deep")
    found, files = corpus.read_class_dirs(spark, str(root)), corpus.class_dir_files(spark, str(root))
    assert {(r.label, r.text) for r in found.collect()} == {(w[:3], w) for w in ("pos/a", "pos/b", "neg/c", "neg/d", "neg/e")}
    assert {r.file[-5:] for r in files.collect()} == {"pos/a", "pos/b", "neg/c", "neg/d", "neg/e"}
    for df in (found, files):
        relation = df._jdf.queryExecution().analyzed().collectLeaves().head().relation()
        assert relation.location().rootPaths().size() == 2  # the classes, not their files


def _files_held(df):
    """Files whose state the driver keeps for the tables that a query reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return sum(leaves.apply(i).relation().location().allFiles().size() for i in range(leaves.size()))


def test_the_driver_does_not_hold_the_files_of_class_directories(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"corpus/{i % 3}").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"corpus/{i % 3}/{i}").write_text(f"text {i}")
    found, listed = corpus.read_class_dirs(spark, str(tmp_path / "corpus")), corpus.class_dir_files(spark, str(tmp_path / "corpus"))
    assert found.count() == listed.count() == 300
    assert {(r.label, r.text) for r in found.collect()} == {(str(i % 3), f"text {i}") for i in range(300)}
    assert max(_files_held(found), _files_held(listed)) <= 6


def test_odd_names_and_contents_of_class_directories(spark, tmp_path):
    names = ["a b.txt", "g%41 i+j", "é𝒳\u3000", "[1]{2}^`|\"<>", "q?r#s", "_a=b", "_skipped", ".hidden", "half._COPYING_", "empty"]
    for label in ("pos +1", "_neg", "none"):
        (tmp_path / "corpus" / label).mkdir(parents=True)
        for name in names if label != "none" else []:
            (tmp_path / "corpus" / label / name).write_bytes(b"" if name == "empty" else b"\xef\xbb\xbf\r\n \xff " + name.encode())
    root = str(tmp_path / "corpus")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/*").select(F.col("content").cast("string"), F.col("_metadata.file_path"))
    found = corpus.read_class_dirs(spark, root)
    assert sorted(found.select("text", "file").collect()) == sorted(plain.collect()) and found.count() == 12
    assert {r.label for r in found.collect()} == {"pos +1", "_neg"}
    assert sorted(r.file for r in corpus.class_dir_files(spark, root).collect()) == sorted(r.file_path for r in plain.collect())


def test_a_file_that_does_not_fit_its_checksums_fails(spark, tmp_path):
    spark.createDataFrame([("x" * 2000,)], "text string").coalesce(1).write.text(str(tmp_path / "corpus/pos"))
    assert [r.text for r in corpus.read_class_dirs(spark, str(tmp_path / "corpus")).collect()] == ["x" * 2000 + "\n"]
    (file,) = (tmp_path / "corpus/pos").glob("part-*")
    file.write_text("x" * 1999 + "y\n")
    with pytest.raises(PySparkException, match="checksum error"):
        corpus.read_class_dirs(spark, str(tmp_path / "corpus")).collect()


def test_a_file_for_every_row_also_after_a_second_try(spark, tmp_path):
    rows = spark.createDataFrame([("pos", "a"), ("pos", "a"), ("neg", "a"), ("pos", None), ("pos", "é\n")] * 2, "label string, text string").repartition(2)
    root = str(tmp_path / "corpus")
    files.write_files(rows, root, ["neg", "pos", "none"])
    rows.mapInArrow(files._written(root), "n long").collect()
    assert sorted((r.label, r.text) for r in corpus.read_class_dirs(spark, root).collect()) == sorted([("pos", "a\n"), ("pos", "a\n"), ("neg", "a\n"), ("pos", "\n"), ("pos", "é\n\n")] * 2)
    assert (tmp_path / "corpus/none").is_dir()


def test_json_requests(spark):
    payloads = [
        '{"domain":"m","classes":["neg","pos"],"dataSet":[{"text":"a","textClass":"pos"},{"text":"b","textClass":""},'
        '{"text":null,"textClass":"neg"},{"textClass":"neg","text":"c"}],"useSentimentVector":false}',
        '{"dataSet":[{"text":"d","textClass":"neg"}]}', "not json", '{"domain":"e","dataSet":[]}',
    ]
    rows = requests.parse_requests(spark.createDataFrame([(p,) for p in payloads], "value string")).collect()
    got = {(r.domain, r.use_sentiment_vector, r.row_no, r.text, r.label) for r in rows}
    assert got == {("m", False, 0, "a", "pos"), ("m", False, 3, "c", "neg"), ("$DEF", True, 0, "d", "neg")}


def test_payloads(spark):
    payloads = {
        1: "% remark\n@relation r\n@attribute text string\n@attribute class {neg,pos}\n@data\n'it, so',pos\n\n% x\nplain,neg\n",
        2: "@RELATION r\n@ATTRIBUTE class {neg,pos}\n@ATTRIBUTE text STRING\n@DATA\npos,'first'\n",
        3: 'text,class\n"say ""hi"", you",pos\n',
        4: '{"header":{},"data":[{"values":["j","neg"]}]}',
        5: "free text", 6: "", 7: '{"broken', 8: "text,class\n", 9: "class,text\nneg,later\n",
    }
    df = spark.createDataFrame(list(payloads.items()), "id int, payload string")
    rows, bad = requests.parse_payloads(df, "payload", ["id"])
    got = {(r.id, r.form, r.text, r.label) for r in rows.collect()}
    assert got == {
        (1, "arff", "it, so", "pos"), (1, "arff", "plain", "neg"), (2, "arff", "first", "pos"),
        (3, "csv", 'say "hi", you', "pos"), (4, "json", "j", "neg"), (9, "csv", "later", "neg"),
    }
    assert {r.id for r in bad.collect()} == {5, 6, 7, 8}


def test_manifests(spark):
    contents = ["dir/a", "dir/b\n \nTRUE\nscore text", "dir/c\r\nmovies\r\nyes", " "]
    df = spark.createDataFrame([(c,) for c in contents], "value string")
    got = {tuple(r) for r in requests.parse_manifests(df).collect()}
    assert got == {
        ("dir/a", "$DEF", False, None), ("dir/b", "$DEF", True, "score text"), ("dir/c", "movies", False, None),
    }


PARAMS = "domain string, label string, feature string, n long, mean double, m2 double"


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    first = spark.createDataFrame([("d", "pos", "f", 3, 0.5, 1.0), ("e", "pos", "f", 0, 0.0, 0.0)], PARAMS)
    status = {r.domain: r.status for r in registry.save_models(first, path, "gaussian_nb", 1).collect()}
    assert status == {"d": registry.CREATED, "e": registry.IGNORED}
    again = registry.save_models(first.filter("domain = 'd'"), path, "gaussian_nb", 2)
    assert again.first().status == registry.EXISTS
    second = spark.createDataFrame([("d", "pos", "f", 9, 0.5, 1.0)], PARAMS)
    registry.save_models(second, path, "gaussian_nb", 3)
    assert registry.load_headers(spark, path).count() == 2
    assert [r.n for r in registry.latest_model(spark, path, "d").collect()] == [9]
    assert registry.latest_model(spark, path, "unknown").count() == 0


def test_registry_skips_damaged_files(spark, tmp_path):
    path = tmp_path / "registry"
    params = spark.createDataFrame([("d", "pos", "f", 3, 0.5, 1.0)], PARAMS)
    registry.save_models(params, str(path), "gaussian_nb", 1)
    older = registry.latest_model(spark, str(path)).first()
    more = spark.createDataFrame([("d", "pos", f, 4, 0.25, 2.0) for f in "fgh"], PARAMS)
    status = registry.save_models(more, str(path), "gaussian_nb", 2)
    folder = path / "params" / "domain=d" / f"model_id={status.first().model_id}"
    (folder / "part-broken.parquet").write_bytes(b"no parquet at all")
    assert registry.latest_model(spark, str(path)).count() == 3  # what else lies there does no harm
    for part in folder.glob("*.snappy.parquet"):
        part.write_bytes(b"damaged")
    # The damaged model is left out whole; the one before it answers.
    assert [r.model_id for r in registry.latest_model(spark, str(path)).collect()] == [older.model_id]
    assert registry.load_models(spark, str(tmp_path / "nowhere")).count() == 0


def test_registry_keeps_equal_models_apart_and_comes_back(spark, tmp_path):
    path = str(tmp_path / "registry")
    rows = lambda mean, *domains: spark.createDataFrame([(d, "pos", "f", 3, mean, 1.0) for d in domains], PARAMS)
    status = registry.save_models(rows(0.5, "d", "e"), path, "gaussian_nb", 1).collect()
    assert [r.status for r in status] == [registry.CREATED] * 2 and len({r.model_id for r in status}) == 1
    assert {r.domain for r in registry.latest_model(spark, path).collect()} == {"d", "e"}
    assert [r.status for r in registry.save_models(rows(0.5, "f"), path, "gaussian_nb", 1).collect()] == [registry.CREATED]
    # A, B, A: the model that is built again is the newest again, and once is enough.
    registry.save_models(rows(0.7, "d"), path, "gaussian_nb", 2)
    for _ in range(2):
        back = registry.save_models(rows(0.5, "d"), path, "gaussian_nb", 3)
        assert [r.status for r in back.collect()] == [registry.EXISTS]
    assert [(r["mean"], r.n) for r in registry.latest_model(spark, path, "d").collect()] == [(0.5, 3)]
    assert registry.load_headers(spark, path).count() == 5


def test_a_save_repeated_after_a_crash_stores_once(spark, tmp_path):
    path = tmp_path / "registry"
    params = spark.createDataFrame([("d", "pos", f, 3, 0.5, 1.0) for f in "fg"], PARAMS)
    registry.save_models(params, str(path), "gaussian_nb", 1)
    (path / "headers").rename(tmp_path / "lost")  # as if the headers had not been written
    registry.save_models(params, str(path), "gaussian_nb", 1)
    assert registry.latest_model(spark, str(path), "d").count() == 2


def test_requests_that_are_set_aside(spark):
    payloads = [
        '{"domain": "a", "dataSet": [{"text": "x", "textClass": "pos"}, {"text": "y"}, {"text": "z", "textClass": ""}]}',
        '{"domain": "a", "dataSet": []}', '{"domain": "a"}', "no json", '{"domain": ', "[1]", None,
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, value string")
    rows, rejects = requests.split_requests(df, keep=["id"])
    assert [(r.id, r.row_no, r.text) for r in rows.collect()] == [(0, 0, "x")]
    got = sorted((r.id, -1 if r.row_no is None else r.row_no, r.reason) for r in rejects.collect())
    assert got == [
        (0, 1, requests.NO_TEXT_OR_CLASS), (0, 2, requests.NO_TEXT_OR_CLASS), (1, -1, requests.NO_ROWS), (2, -1, requests.NO_ROWS),
        (3, -1, requests.NO_JSON), (4, -1, requests.NO_JSON), (5, -1, requests.NO_JSON), (6, -1, requests.NO_JSON),
    ]


def test_payloads_are_rows_or_rejects(spark):
    payloads = [
        'text,class\n"a ""b""\nc",pos\nd,\n', "text,class\n,pos\n", "class,text\npos,x\n", "text,class\n", '{"dataSet": [{"text": "t"}]}',
        '{"data": [{"values": ["t", "pos"]}, {"values": []}]}', "@relation r\n@data\n", "@relation r\n@attribute text string\n@data\n'x',neg\n'y'\n", "plain", None,
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "id int, payload string")
    rows, rejects = requests.parse_payloads(df, "payload", ["id"])
    assert {(r.id, r.row_no, r.text, r.label) for r in rows.collect()} == {
        (0, 0, 'a "b"\nc', "pos"), (2, 0, "x", "pos"), (5, 0, "t", "pos"), (7, 0, "x", "neg"),
    }
    assert {r.id for r in rejects.collect()} == {1, 3, 4, 6, 8, 9}
    left = requests.payload_row_rejects(df, "payload", ["id"]).collect()
    assert {(r.id, r.row_no) for r in left} == {(0, 1), (5, 1), (7, 1)}


def test_export(spark):
    params = spark.createDataFrame([("d", "pos", "f", 3, 0.5, 1.0)], PARAMS)
    value = registry.export_json(params).select(F.get_json_object("value", "$.mean")).first()[0]
    assert float(value) == 0.5


def test_each_step_of_the_payload_parser_is_taken_once(spark):
    df = spark.createDataFrame([(0, 'text,class\n"a",x\n'), (1, "bare")], "id int, payload string")
    # A payload that is made by an expression, so that steps and sources can be merged into one.
    made = df.select("id", F.translate("payload", "\t", " ").alias("payload"))
    rows, rejects = requests.parse_payloads(made, "payload", ["id"])
    for out in (rows, rejects, requests.payload_row_rejects(made, "payload", ["id"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 1 and plan.count("from_csv(") <= 2
    assert [r.id for r in rows.collect()] == [0] and [r.id for r in rejects.collect()] == [1]
