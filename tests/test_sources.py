import json

from pyspark.sql import functions as F

from kilnwork.operators import itemsets as I
from kilnwork.sources import readers, staging, writers


def test_readers(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"user_id": "u", "stars": 4.5}\n{"user_id": "v"}\n')
    assert [(r["user_id"], r["stars"]) for r in readers.json_lines(spark, str(tmp_path / "r.json"), readers.REVIEW).collect()] == [("u", 4.5), ("v", None)]
    (tmp_path / "p.csv").write_text('user_id,business_id\nu,"b,1"\n')
    assert [tuple(r) for r in readers.csv_rows(spark, str(tmp_path / "p.csv"), readers.PAIRS).collect()] == [("u", "b,1")]
    (tmp_path / "a.json").write_text(json.dumps({"x": 1.5, "y": 2}))
    assert sorted(map(tuple, readers.json_map(spark, str(tmp_path / "a.json")).collect())) == [("x", 1.5), ("y", 2.0)]
    (tmp_path / "stop").write_text(" the \n\nof\n")
    assert [r[0] for r in readers.word_list(spark, str(tmp_path / "stop")).collect()] == ["the", "of"]
    (tmp_path / "chunks").mkdir()
    (tmp_path / "chunks/b.txt").write_text("2,1.0,2.5\n")
    (tmp_path / "chunks/a.txt").write_text("1,0.5,1\n")
    assert [(r["id"], r["features"]) for r in readers.points(spark, str(tmp_path / "chunks")).orderBy("file").collect()] == [(1, [0.5, 1.0]), (2, [1.0, 2.5])]


def test_model_round_trip(spark, tmp_path):
    writers.json_lines(spark.createDataFrame([("z", "a", 0.5)], readers.MODEL), str(tmp_path / "m"))
    assert [tuple(r) for r in readers.model_pairs(spark, str(tmp_path / "m")).collect()] == [("a", "z", 0.5)]
    p = spark.createDataFrame([("d", [1, 2])], "id string, features array<int>")
    writers.sections(p, p, str(tmp_path / "s"))
    assert [d.count() for d in readers.sections(spark, str(tmp_path / "s"))] == [1, 1]


def test_itemset_report(spark):
    rows = spark.createDataFrame([("a", "100"), ("a", "97"), ("b", "100"), ("b", "97")], "basket string, item string")
    sets = I.frequent_itemsets(rows, 2)
    text = writers.itemset_report(sets, sets).first()[0]
    assert text == "Candidates: \n('100'),('97') \n \n('100', '97')\n \nFrequent Itemsets:\n('100'),('97') \n \n('100', '97')\n \n"
    assert writers.comparison_lines(I.agreement(sets, sets)).first()[0] == "Task2,3 \nTask3,3\nIntersection,3"


def test_line_formats(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 1.5)], "a string, b string, w double")
    assert writers.tuple_lines(df, "a", "b", weight="w").first()[0] == "('a', 'b'), 1.5"
    assert writers.tuple_lines(df, "a", "b").first()[0] == "'a', 'b'"
    writers.json_report(df, str(tmp_path / "r"), n=F.count("*"))
    assert json.loads(spark.read.text(str(tmp_path / "r")).first()[0]) == {"n": 1}


def test_tag_snapshot(spark):
    ranked = spark.createDataFrame([("b", 5, 1), ("a", 5, 1), ("c", 2, 2)], "tag string, n long, rank int")
    assert writers.tag_snapshot(ranked, 9).first()[0].splitlines()[1:] == ["a : 5", "b : 5", "c : 2"]


def test_staged_tables_are_read_from_the_shared_folder(spark):
    df = staging.stage(spark.range(5).toDF("x"), "t")
    assert df.count() == 5 and staging.shared_dir(spark) in df.inputFiles()[0].replace("file:", "").replace("///", "/")


def test_averages_as_one_object(spark, tmp_path):
    df = spark.createDataFrame([('a"b', 1.5), ("c\\d", None), ("e", 2.0), (None, 3.0)], "k string, v double")
    want = {'a"b': 1.5, "c\\d": None, "e": 2.0}
    for name, limit in (("one", 10), ("many", 1)):
        writers.json_object(df, str(tmp_path / name), "k", "v", limit)
        assert json.loads("".join(f.read_text() for f in sorted((tmp_path / name).glob("part-*")))) == want
    assert sorted(readers.json_map(spark, str(tmp_path / "one")).where("avg is not null").collect()) == [('a"b', 1.5), ("e", 2.0)]
    writers.json_object(df.limit(0), str(tmp_path / "none"), "k", "v")
    assert json.loads("".join(f.read_text() for f in sorted((tmp_path / "none").glob("part-*")))) == {}


def test_released_tables_are_gone(spark):
    df = staging.stage(spark.range(5).toDF("x"), "t")
    staging.release(df, None, spark.range(1))
    assert not staging._exists(spark, df._staged)
