import random

import pytest
from pyspark.sql import functions as F

from newsframe import session
from newsframe.functions import text
from newsframe.operators import sampling
from newsframe.operators.vocabulary import vocabulary
from newsframe.schema import ARTICLE, STATEMENT
from newsframe.sources import readers, writers
from newsframe.streaming import incremental


def test_csv_with_quotes_and_line_ends(spark, tmp_path):
    path = tmp_path / "a.csv"
    head = ",".join(ARTICLE.names)
    path.write_bytes((head + '\r\n1,d,fake,u,"He said ""no"",\r\nthen left",,,,t,a,,,,,\r\n2,e,,u,plain,,,,,,,,,,\r\n').encode())
    one, two = readers.read_csv(spark, str(path)).orderBy("id").collect()
    assert one.content.replace("\r", "") == 'He said "no",\nthen left' and one.title == "t"
    assert two.type is None and two.summary is None and one.summary is None
    assert readers.read_csv(spark, str(path)).filter("id = 1").select(text.clean_text(F.col("content"))).first()[0] == "he said no then left"


def test_tsv_and_union(spark, tmp_path):
    path = tmp_path / "a.tsv"
    path.write_text("1.json\tfalse\tSays x\ttaxes,jobs\tbob\t\tohio\tnone\t1\t2\t3\t4\t5\tan ad\n")
    df = readers.read_tsv(spark, str(path))
    row = df.first()
    assert df.columns == STATEMENT.names and row.subjects == "taxes,jobs" and row.speaker_job is None and row.pants_on_fire == 5
    both = readers.combine(df, df.select("id", "label"))
    assert both.count() == 2 and both.columns == STATEMENT.names


def test_writers(spark, tmp_path):
    df = spark.range(25).select("id", F.lit("x\ny").alias("content"), F.when(F.col("id") < 5, "fake").alias("type"),
                                F.lit("d").alias("domain"))
    writers.write_csv(df, str(tmp_path / "csv"))
    writers.write_csv(df, str(tmp_path / "csv"), append=True)
    assert readers.read_csv(spark, str(tmp_path / "csv"), df.schema).count() == 50
    writers.write_split(df, str(tmp_path / "split"), "id", 10)
    files = sorted((tmp_path / "split").glob("part-*.csv"))
    assert sorted(len(readers.read_csv(spark, str(file), df.schema).collect()) for file in files) == [5, 10, 10]
    starts = [min(r.id for r in readers.read_csv(spark, str(file), df.schema).collect()) for file in files]
    assert sorted(starts) == [0, 10, 20]
    writers.write_statistics(df, str(tmp_path / "stat"))
    read = lambda name: [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "stat" / name)).collect()]
    assert sorted(read("rows_cols")) == [("Number of cols", "4"), ("Number of rows", "25")]
    assert read("types") == [("none", "20"), ("fake", "5")] and len(read("content_length")) == 25


def test_word_vectors(spark, tmp_path):
    path = tmp_path / "v.txt"
    path.write_text("the 0.5 -1\ncat 1e-2 2\n")
    assert {r.word: list(r.vec) for r in readers.read_word_vectors(spark, str(path)).collect()} == {
        "the": [0.5, -1.0], "cat": [pytest.approx(0.01), 2.0]}


def test_incremental_counts_see_each_file_once(spark, tmp_path):
    source, counts, state = (str(tmp_path / name) for name in ("in", "counts", "state"))
    for part in (["a b a"], ["b c"], []):
        if part:
            spark.createDataFrame([(line,) for line in part], "text string").write.mode("append").parquet(source)
        stream = incremental.read_new_files(spark, source, "text string")
        incremental.add_word_counts(stream.select(text.tokens(F.col("text")).alias("words")), "words", counts, state)
    assert {r.word: r.n for r in incremental.running_word_counts(spark, counts).collect()} == {"a": 2, "b": 2, "c": 1}


class Session:
    """Stands for a session without spark.checkpoint.dir."""

    def __init__(self, master, folder=None):
        self.conf, self.sparkContext, self.master, self.folder = self, self, master, folder

    def get(self, key, default):
        return default

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_shared_folder(spark, tmp_path):
    assert session.shared_folder(Session("yarn", "hdfs://ck")) == "hdfs://ck"
    assert "newsframe-" in session.shared_folder(Session("local[2]"))
    with pytest.raises(ValueError):
        session.shared_folder(Session("yarn"))
    df = session.materialise(vocabulary(spark.createDataFrame([(["a", "a"],)], "w array<string>"), "w"))
    assert [tuple(r) for r in df.collect()] == [("a", 2)] and session.shared_folder(spark) in df.inputFiles()[0]


def test_csv_matches_columns_by_header(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(",type,id,unknown,domain,content\n0,fake,17,z,a.com,u\n1,bias,18,z,b.com,\"two\nlines\"\n")
    rows = readers.read_csv(spark, str(path)).orderBy("id").collect()
    assert [(r.id, r.domain, r.type, r.content, r.title) for r in rows] == [(17, "a.com", "fake", "u", None), (18, "b.com", "bias", "two\nlines", None)]
    other = tmp_path / "other.csv"
    other.write_text("domain,id\nc.com,19\n")
    assert [r.domain for r in readers.read_csv(spark, [str(path), str(other)]).orderBy("id").collect()] == ["a.com", "b.com", "c.com"]
    kept = readers.ingest_csv(spark, [str(path), str(other)], str(tmp_path / "parquet"))
    assert kept.count() == 3 and kept.columns == ARTICLE.names


def test_bad_csv_rows_are_not_silent(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("id,domain\n1,a\n2,b,c\nthree,d\n4\n5,e\n")
    schema = "id long, domain string"
    from pyspark.sql.types import StructType
    kept = readers.read_csv(spark, str(path), StructType.fromDDL(schema), multi_line=False, bad_rows="raw").collect()
    assert [(r.id, r.domain) for r in kept if r.raw is None] == [(1, "a"), (5, "e")] and len(kept) == 5
    with pytest.raises(Exception, match="bad CSV row"):
        readers.read_csv(spark, str(path), StructType.fromDDL(schema), multi_line=False).collect()


def test_more_csv_rows_are_more_tasks(spark, tmp_path):
    df = spark.range(400).select("id", F.lit("x\ny").alias("content")).coalesce(1)
    writers.write_csv(df, str(tmp_path / "csv"), rows_per_file=50)
    assert len(list((tmp_path / "csv").glob("part-*.csv"))) == 8
    assert readers.read_csv(spark, str(tmp_path / "csv"), df.schema).count() == 400


def test_materialise_leaves_no_shuffle_files(spark):
    kept = session.materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert kept.count() == 7 and spark.conf.get(session.CLEANUP) == "false"


@pytest.mark.parametrize("balanced", [[True, False, True], [False, True, False]])
def test_quota_splits_of_a_stream(spark, tmp_path, balanced):
    rng = random.Random(5)
    labels = [rng.choice(["a", "b", "c", None]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(labels)), "id long, type string")
    plan = dict(total_size=120, splits=[0.2, 0.25, 0.1], balanced=balanced, key="id", classes=["a", "b"])
    arriving, found, checkpoint = (str(tmp_path / name) for name in ("in", "out", "checkpoint"))
    wanted = {row.id: row.set for row in sampling.quota_split(df, **plan).collect()}
    # Any cut of the rows, also inside a set, and rows that come again.
    for low, high in ((0, 7), (7, 8), (8, 24), (24, 60), (60, 119), (119, 120)):
        df.filter(((F.col("id") >= low) & (F.col("id") < high)) | ((F.col("id") < low) & (F.col("id") % 4 == 0))).coalesce(1).write.mode("append").parquet(arriving)
        incremental.add_quota_split(incremental.read_new_files(spark, arriving, df.schema), path=found, checkpoint=checkpoint, **plan)
    rows = incremental.running_split(spark, found).collect()
    assert len(rows) == len(wanted) and {row.id: row.set for row in rows} == wanted and set(wanted.values()) == {0, 1, 2}
    # All sets are full: the next rows are not even read.
    before = sorted(path.name for path in (tmp_path / "checkpoint" / "offsets").iterdir())
    spark.createDataFrame([(500, "a")], df.schema).write.mode("append").parquet(arriving)
    incremental.add_quota_split(incremental.read_new_files(spark, arriving, df.schema), path=found, checkpoint=checkpoint, **plan)
    assert sorted(path.name for path in (tmp_path / "checkpoint" / "offsets").iterdir()) == before
