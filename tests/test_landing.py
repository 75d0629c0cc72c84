"""The CSV landing directory brings every text back unchanged."""

import pytest

import postlark as pl

TEXTS = [
    "plain",
    "two lines first\nsecond lineword",
    'he said "quoted word", then comma tail',
    '"fully quoted"',
    '"',
    '""',
    "ends with backslash\\",
    'backslash quote \\" inside, and comma',
    "  outer blanks  ",
    "\ttabs\t",
    "carriage\rreturn",
    "windows\r\nlines\r\n",
    "\nleading line break",
    "# not a comment",
    ",",
    "a,b,,c",
    "null",
    "Español 日本語 😀",
    "'single'",
    "x" * 100_000,
]


def posts(spark):
    return spark.createDataFrame(
        [
            ("Ann", i, "now", 0, 1, 2, "en", "FR", "[]", 3, text, i % 2 == 0)
            for i, text in enumerate(TEXTS)
        ],
        pl.POST,
    )


@pytest.mark.parametrize("records_per_file", [3, 100_000])
def test_round_trip(spark, tmp_path, records_per_file):
    path = str(tmp_path / "landing")
    pl.write_landing(posts(spark), path, records_per_file=records_per_file)
    landed = pl.read_landing(spark, path)
    assert landed.schema == pl.POST
    assert landed.orderBy("UserID").collect() == posts(spark).orderBy("UserID").collect()


def test_stream_round_trip(spark, tmp_path):
    source, path = str(tmp_path / "source"), str(tmp_path / "landing")
    posts(spark).repartition(3).write.parquet(source)
    stream = pl.read_posts(spark, source, "parquet", pl.POST, stream=True, maxFilesPerTrigger=1)
    pl.stream_landing(
        stream, path, str(tmp_path / "checkpoint"), {"availableNow": True}
    ).awaitTermination()
    landed = pl.read_landing(spark, path)
    assert landed.orderBy("UserID").collect() == posts(spark).orderBy("UserID").collect()


def test_empty_fields_become_null(spark, tmp_path):
    path = str(tmp_path / "landing")
    row = ("Ann", 1, "now", None, None, None, "", "", "", None, "text", False)
    pl.write_landing(spark.createDataFrame([row], pl.POST), path)
    landed = pl.read_landing(spark, path).collect()[0]
    assert (landed.Language, landed.Place, landed.Coordinates) == (None, None, None)
    assert (landed.TextRangeStart, landed.Text) == (None, "text")


def test_reads_files_written_elsewhere_by_glob(spark, tmp_path):
    (tmp_path / "data-0.csv").write_text(
        'Ann,1,now,0,5,0,en,,,0,"hello ""you"", there\nsecond line",false\r\n', newline=""
    )
    (tmp_path / "data-1.csv").write_text("Bob,2,now,0,5,0,,,,0,bye,true\r\n", newline="")
    (tmp_path / "other.csv").write_text("Eve,3,now,0,5,0,,,,0,no,true\r\n", newline="")
    landed = pl.read_landing(spark, f"{tmp_path}/data*.csv").orderBy("UserID").collect()
    assert [(r.UserName, r.Language, r.Text, r.isRetweet) for r in landed] == [
        ("Ann", "en", 'hello "you", there\nsecond line', False),
        ("Bob", None, "bye", True),
    ]


def test_stream_over_a_glob(spark, tmp_path):
    for name, user in [("data-0", "Ann"), ("data-1", "Bob"), ("other", "Eve")]:
        (tmp_path / f"{name}.csv").write_text(f"{user},1,now,0,5,0,en,,,0,some text,false\r\n")
    posts = pl.read_landing(spark, f"{tmp_path}/data*.csv", stream=True, maxFilesPerTrigger=1)
    query = (
        posts.writeStream.option("checkpointLocation", f"{tmp_path}/checkpoint")
        .trigger(availableNow=True)
        .format("parquet")
        .start(f"{tmp_path}/result")
    )
    assert query.awaitTermination(60)
    result = spark.read.parquet(f"{tmp_path}/result")
    assert sorted((r.UserName, r.isRetweet) for r in result.collect()) == [
        ("Ann", False),
        ("Bob", False),
    ]
