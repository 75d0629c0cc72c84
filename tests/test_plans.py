"""What the plans must look like to work on tables far larger than these."""

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
BATCH = [name for name in entry.core_queries() if not name.startswith(("stream", "post", "upsert"))]


def plan(frame, mode="simple"):
    return frame._sc._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), mode)


def initial(spark, name):
    return plan(entry.core_queries()[name](spark, SF_DIR))


@pytest.mark.parametrize("name", BATCH)
def test_no_python_workers_cross_joins_or_nested_loops(spark, name):
    text = initial(spark, name)
    for node in ("ArrowEval", "BatchEvalPython", "Python", "Cartesian", "NestedLoop"):
        assert node not in text


@pytest.mark.parametrize(
    "name, columns",
    [
        ("language_counts", "struct<lang:string>"),
        ("word_counts", "struct<text:string>"),
        ("session_top_words", "struct<text:string>"),
        ("keyword_filter", "struct<doc_id:bigint,text:string>"),
        ("top_words_guarded", "struct<event_type:string>"),
        ("feed_lines", "struct<conv_id:bigint,turn:bigint,role:string,text:string>"),
    ],
)
def test_scans_read_only_the_columns_needed(spark, name, columns):
    assert f"ReadSchema: {columns}" in initial(spark, name)


@pytest.mark.parametrize("name", ["language_counts", "word_counts", "top_words"])
def test_rows_are_summed_before_the_shuffle(spark, name):
    lines = initial(spark, name).splitlines()
    exchange = next(i for i, line in enumerate(lines) if "hashpartitioning" in line)
    assert "partial_count" in lines[exchange + 1]


def test_small_lookup_is_broadcast_and_a_large_one_is_not(spark):
    assert "BroadcastHashJoin" in initial(spark, "language_distribution")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        frame = entry.core_queries()["language_distribution"](spark, SF_DIR)
        assert "SortMergeJoin" in plan(frame)
        assert {row.language for row in frame.collect()} == {"English", "French", "German", "es"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_shares_reuse_the_exchange_of_the_counts(spark):
    frame = entry.core_queries()["language_distribution"](spark, SF_DIR)
    frame.collect()
    final = plan(frame).split("Initial Plan")[0]
    assert "ReusedExchange" in final
    assert "Window" not in final


def test_top_words_need_no_global_sort(spark):
    text = initial(spark, "top_words")
    assert "TakeOrderedAndProject" in text
    assert "rangepartitioning" not in text


def test_keyword_filter_does_not_shuffle(spark):
    for name in ("keyword_filter", "intake", "flatten_record", "feed_lines"):
        assert "Exchange" not in initial(spark, name)


def test_languages_are_filtered_in_the_scan(spark):
    for name in ("language_counts", "language_distribution"):
        assert "PushedFilters: [IsNotNull(lang)]" in initial(spark, name)


def test_word_expressions_stay_in_generated_code(spark):
    frame = entry.core_queries()["word_counts"](spark, SF_DIR)
    frame.collect()
    final = plan(frame).split("Initial Plan")[0]
    for node in ("Generate", "Filter", "Project", "HashAggregate"):
        marked = [line for line in final.splitlines() if f" {node}" in line.replace("(", " (")]
        assert marked and all("*(" in line for line in marked)
