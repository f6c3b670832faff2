import json

import pytest
from pyspark.sql import functions as F

from measureframe.operators.filters import RangeFilter
from measureframe.plans import jobs
from measureframe.roles import categories
from measureframe.sources import sink, text
from measureframe.roles import q
from measureframe.sources.paths import parse_path, path_patterns
from measureframe.sources.text import ImportSpec
from measureframe.streaming.measurements import import_new_files, stream_measurements

HEAD = "Exc1_-Ch2-_t1\tExc1_-Ch2-_t2\tExc2_-z\tCell line\tnote"


@pytest.fixture
def folder(tmp_path):
    base = tmp_path / "my data+1" / "HeLa" / "mito"
    base.mkdir(parents=True)
    (base / "Results-a-ctrl-1.txt").write_text(f"{HEAD}\n100\t2000\t1\t007\tok\n\n300\tNaN\t1\t008\tfine\n")
    (base / "Results-b-dox-2.txt").write_text(f"{HEAD}\textra\n500\t4400\t2\t9\tx\t7.5\n")
    (base / "Results--dox-3.txt").write_text(f"{HEAD}\n")
    (base / "skip.txt").write_text("a\n1\n")
    (base / "image.png").write_text("no")
    return str(tmp_path / "my data+1")


SPEC = ImportSpec(parser="celltype_compartment_fov_treatment_cell", exclude=("skip.txt",), combos=[("FOV", "Treatment")])


def test_discovery(spark, folder):
    files, counts = text.discover_files(spark, folder, exclude=["skip.txt"])
    assert [r["name"] for r in files.collect()] == ["Results--dox-3.txt", "Results-a-ctrl-1.txt", "Results-b-dox-2.txt"]
    assert tuple(counts.first()) == (3, 2)


def test_import(spark, folder):
    df = text.read_measurements(spark, folder, SPEC)
    rows = {r["NAD(P)H t1"]: r for r in df.collect()}
    assert set(rows) == {100.0, 300.0, 500.0}
    a = rows[100.0]
    assert (a["Cell line"], a["Compartment"], a["FOV"], a["Treatment"], a["Cell"]) == ("HeLa", "mito", "a", "ctrl", "1")
    assert a["FOV-Treatment"] == "a-ctrl" and a["note"] == "ok" and a["extra"] is None
    assert a["Directory"].endswith("my data+1/HeLa/mito") and a["File"] == "Results-a-ctrl-1.txt"
    assert rows[300.0]["NAD(P)H t2"] is None and rows[500.0]["extra"] == 7.5
    assert rows[500.0]["NADPH %"] == 100.0
    assert not [c for c in df.columns if "Exc2_" in c]
    cats = categories(df)
    assert df.columns[: len(cats)] == sorted(cats)


def test_labels_are_read_once_for_a_file(spark, folder, monkeypatch):
    def found():
        df = text.read_measurements(spark, folder, SPEC).filter(q("FOV").isNotNull() & q("NAD(P)H t1").isNotNull())
        return df, sorted(map(str, df.collect()))

    df, rows = found()
    scans = [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan csv" in line]
    assert scans and not [line for line in scans if "translate(" in line]
    monkeypatch.setattr(text, "BROADCAST_FILES", 0)
    assert len(rows) == 3 and found()[1] == rows


def test_delimiter_characters_are_alternatives(spark, tmp_path):
    (tmp_path / "one.csv").write_text("x\ty,z|w\n1,2\t3,4\n5\t\t7|t\n")
    df = text.read_measurements(spark, str(tmp_path), ImportSpec(delimiter="\t,|"))
    assert df.columns == ["w", "x", "y", "z"]
    assert [tuple(r) for r in df.orderBy("x").collect()] == [("4", 1.0, 2.0, 3.0), ("t", 5.0, None, 7.0)]
    typed = text.read_measurements(spark, str(tmp_path), ImportSpec(delimiter="\t,|", types={"x": "int", "y": "double"}))
    assert dict(typed.dtypes)["x"] == "int" and dict(typed.dtypes)["z"] == "string"


@pytest.mark.parametrize("delimiter", [",", ",;"])
@pytest.mark.parametrize("shared", [True, False])
def test_awkward_file_names(spark, tmp_path, delimiter, shared):
    (tmp_path / "x [1] {a} 50%25-b-c.csv").write_text("v,w\n1,2\n")
    spec = ImportSpec(delimiter=delimiter, parser={"Part": r".*/(.*?)-"}, shared_header=shared)
    row = text.read_measurements(spark, str(tmp_path), spec).first()
    assert (row["v"], row["Part"], row["File"]) == (1.0, "x [1] {a} 50%25", "x [1] {a} 50%25-b-c.csv")


def test_preview_and_open(spark, folder, tmp_path):
    assert text.preview(spark, folder, SPEC, 1).count() == 2
    path = tmp_path / "one.txt"
    path.write_text("Cell\tv\n01\t2.5\n")
    assert text.open_table(spark, str(path)).first()["v"] == 2.5
    with pytest.raises(FileNotFoundError):
        text.read_measurements(spark, folder, ImportSpec(extensions=(".none",)))


def test_shared_header_skips_the_header_pass(spark, folder):
    spec = ImportSpec(parser="fov_treatment_cell", exclude=("skip.txt", "Results-b-dox-2.txt"), shared_header=True)
    assert text.read_measurements(spark, folder, spec).count() == 2


def test_paths(spark):
    rows = [
        ("/data/HeLa/mito/Results-a-ctrl-1.txt",), ("C:\\data\\mito\\Results_b_dox_2.csv",),
        ("/x/plain.txt",), ("/d/mito/Results--dox-7.txt",),
    ]
    df = spark.createDataFrame(rows, "p string")
    out = parse_path(df, "p", "compartment_fov_treatment_cell").collect()
    assert (out[0]["Compartment"], out[0]["FOV"], out[0]["Treatment"], out[0]["Cell"]) == ("mito", "a", "ctrl", "1")
    assert (out[1]["Compartment"], out[1]["FOV"], out[1]["Cell"]) == ("mito", "b", "2")
    assert out[2]["FOV"] is None and out[3]["FOV"] == "?"
    assert parse_path(df, "p", "none").columns == ["p"]
    assert path_patterns({"A": "(.)"}) == {"A": "(.)"}


def test_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0)], "g string, `v\nmean` double")
    sink.write_table(df, str(tmp_path / "t"), "csv")
    head = [f for f in (tmp_path / "t").iterdir() if f.name.endswith(".csv")][0].read_text().splitlines()[0]
    assert head == "g\tv mean"
    assert sink.clean_name("Table: a|b %") == "Table_a_b_pcent"
    written = sink.write_results({"Table: x": df}, str(tmp_path / "r"), "parquet")
    assert spark.read.parquet(written["Table: x"]).columns == ["g", "v\nmean"]


def test_stream_equals_batch(spark, folder, tmp_path):
    spec = ImportSpec(parser="fov_treatment_cell", exclude=("skip.txt", "Results-b-dox-2.txt"))
    cols = {"Exc1_-Ch2-_t1": "double", "Exc1_-Ch2-_t2": "double", "Exc2_-z": "double", "Cell line": "string", "note": "string"}
    bins = {"feature": "NAD(P)H t1", "bins": [(0, 200, "short"), (200, 400, "long")], "name": "kind"}
    stream = stream_measurements(spark, folder, cols, spec, [RangeFilter("NAD(P)H t1", 0, 1000, True)], bins, 1)
    run = (
        stream.writeStream.format("memory").queryName("streamed").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    run.awaitTermination()
    got = {r["NAD(P)H t1"]: (r["kind"], r["FOV"]) for r in spark.table("streamed").collect()}
    assert got == {100.0: ("short", "a"), 300.0: ("long", "a")}
    batch = text.read_measurements(spark, folder, spec)
    assert set(batch.columns) | {"kind"} == set(stream.columns)


def test_stream_rows_equal_batch_rows(spark, tmp_path):
    """Two headers in different order, two delimiters, texts for missing values, and labels that look like numbers."""
    base = tmp_path / "in"
    base.mkdir()
    (base / "Results-a-ctrl-1.txt").write_text("x;y\tg;n\n10;20\tu;1d\nNA;1e3\tNA;2F\n\nx;y\tg;n\n")
    (base / "Results-b-dox-2.txt").write_text("y\tx;n\tg\n7\t-.5;3\tw\n")
    spec = ImportSpec(delimiter="\t;", parser="fov_treatment_cell", types={"x": "double", "y": "double", "g": "string", "n": "string"}, derived=())
    batch = text.read_measurements(spark, str(base), spec)
    stream = stream_measurements(spark, str(base), spec.types, spec)
    run = (
        stream.writeStream.format("memory").queryName("rows").trigger(availableNow=True)
        .option("checkpointLocation", str(tmp_path / "cp")).start()
    )
    run.awaitTermination()
    names = sorted(batch.columns)
    assert sorted(stream.columns) == names
    rows = [sorted(map(tuple, df.select(*[q(c) for c in names]).collect()), key=repr) for df in (batch, spark.table("rows"))]
    assert rows[0] == rows[1] and len(rows[0]) == 4
    # A line that equals the header inside a file is a row like any other.
    assert sum(r["x"] is None and r["g"] == "g" for r in batch.collect()) == 1


def test_stream_refuses_a_file_without_a_declared_column(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ty\n1\t2\n")
    stream = stream_measurements(spark, str(tmp_path / "in"), {"x": "double", "z": "double"}, ImportSpec(derived=()))
    run = stream.writeStream.format("memory").queryName("refused").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    with pytest.raises(Exception, match="columns missing"):
        run.awaitTermination()


@pytest.mark.parametrize("delimiter", ["\t", "\t;"])
def test_new_files_are_read_in_splits_and_once(spark, tmp_path, delimiter):
    base, target = tmp_path / "in put+1", str(tmp_path / "out")
    base.mkdir()
    spec = ImportSpec(delimiter=delimiter, parser="fov_treatment_cell", types={"x": "double", "g": "string"}, exclude=("skip.txt",), derived=())
    (base / "skip.txt").write_text("q\n1\n")
    new = lambda: import_new_files(spark, str(base), target, spec.types, spec)
    assert new().count() == 0 and set(new().columns) >= {"x", "g", "FOV"}
    (base / "Results-a-ctrl-1.txt").write_text("x\tg\n" + "".join(f"{i}\tu{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        first = new()
        batch = text.read_measurements(spark, str(base), spec)
        rows = lambda df: sorted(map(tuple, df.select(*[q(c) for c in sorted(batch.columns)]).collect()))
        assert sorted(first.columns) == sorted(batch.columns) and rows(first) == rows(batch)
        # One file, many tasks.
        assert len(list((tmp_path / "out" / "rows" / "turn=0").glob("part-*"))) > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # A turn that was broken off left rows; it is read again in whole.
    spark.range(3).write.parquet(f"{target}/rows/turn=1")
    (base / "Results-b-dox-2.txt").write_text("g\tn\tx\nw\t1\t-7\n")
    assert new().count() == 5001 and new().count() == 5001
    assert [tuple(r) for r in new().filter("x < 0").select("x", "g", "FOV").collect()] == [(-7.0, "w", "b")]
    (base / "Results-c-dox-3.txt").write_text("x\n1\n")
    for _ in range(2):
        with pytest.raises(ValueError, match="columns missing in .*c-dox-3.txt: g"):
            new()


def test_only_plain_numbers_are_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ty\tz\n1d\t1e5\t 2.5 \n2F\t-.5\tInf\n")
    df = text.read_measurements(spark, str(tmp_path), ImportSpec(derived=()))
    assert [dict(df.dtypes)[c] for c in "xyz"] == ["string", "double", "double"]
    assert [r["x"] for r in df.collect()] == ["1d", "2F"]


def test_job(spark, folder, tmp_path):
    spec = {
        "import": {"parser": "fov_treatment_cell", "exclude": ["skip.txt"]},
        "filters": {"use": True, "ranges": [{"name": "NAD(P)H t1", "low": 0, "high": 400, "selected": True}]},
        "steps": [
            {"op": "summarize", "args": {"grouping": "FOV", "features": ["NAD(P)H t1"], "aggs": ["mean"]}, "as": "stats"},
            {"op": "histogram_long", "input": "data", "args": {"feature": "NAD(P)H t1", "bins": 4}},
        ],
    }
    path = tmp_path / "job.json"
    path.write_text(json.dumps(spec, indent=1))
    jobs.main(["-i", folder, "-c", str(path), "-o", str(tmp_path / "out")])
    stats = spark.read.parquet(str(tmp_path / "out" / "stats")).collect()
    assert [tuple(r) for r in stats] == [("a", 200.0)]
    assert spark.read.parquet(str(tmp_path / "out" / "2_histogram_long")).count() == 4


def test_specification():
    spec = jobs.repaired({"import": {"delimiter": ","}})
    assert jobs.missing_keys(spec) == [] and ("steps",) in jobs.missing_keys({})
    assert jobs.get(spec, "delimiter") == "," and jobs.get(spec, ("import", "parser")) == "none"
    assert jobs.get(spec, "nothing", 3) == 3
    assert jobs.get(jobs.update(spec, ("import", "parser"), "x"), "parser") == "x"
    assert jobs.missing_keys(jobs.remove(spec, ("filters", "ranges"))) == [("filters", "ranges")]
    with pytest.raises(ValueError):
        jobs.load_spec('{"steps": [{"op": "nonsense"}]}')


def test_job_with_several_inputs_in_any_order(spark, folder, tmp_path):
    other = tmp_path / "other"
    other.mkdir()
    (other / "b_T1_c1.txt").write_text("NAD(P)H t1\tscore\n100\t1\n300\t2\n")
    spec = jobs.load_spec(json.dumps({
        "parser": "fov_treatment_cell",  # misplaced: belongs to import
        "import": {"exclude": ["skip.txt"]},
        "filters": {"ranges": None},
        "imports": {"second": {"paths": [str(other)]}},
        "steps": [
            {"op": "group_counts", "input": "both", "args": {"grouping": "Source"}, "as": "counts"},
            {"op": "pca", "input": "both", "args": {"features": ["NAD(P)H t1"], "n_components": 1}, "as": "pc"},
            {"op": "concat_rows", "inputs": {"one": "data", "two": "second"}, "as": "both"},
            {"op": "summarize", "input": "pc components", "args": {"grouping": "Source", "features": ["PC 1"], "aggs": ["count"]}, "as": "scores"},
        ],
    }))
    assert spec["import"]["parser"] == "fov_treatment_cell" and "parser" not in spec and spec["filters"]["ranges"] == []
    assert [jobs.step_names(spec)[i] for i in jobs.step_order(spec)] == ["both", "counts", "pc", "scores"]
    held = []
    tables = jobs.run_job(spark, [folder], spec, held)
    assert len(held) == 1 and tables["both"].storageLevel.useMemory
    counts = {r["Source"]: r["count"] for r in tables["counts"].collect()}
    assert counts == {"one": tables["data"].count(), "two": 2}
    assert {r["Source"]: r["PC 1__count"] for r in tables["scores"].collect()}["two"] == 2
    assert set(tables) == {"data", "second", "both", "counts", "pc components", "pc explained", "scores"}
    for bad in ([{"op": "pca", "input": "nothing"}], [{"op": "derive", "input": "b", "as": "a"}, {"op": "derive", "input": "a", "as": "b"}]):
        with pytest.raises(ValueError):
            jobs.load_spec(json.dumps({"steps": bad}))


def test_equal_imports_of_a_job_are_read_once(spark, folder, monkeypatch):
    calls = []

    def counted(session, paths, spec):
        calls.append(spec.parser)
        return text.read_measurements(session, paths, spec)

    monkeypatch.setattr(jobs, "read_measurements", counted)
    spec = jobs.load_spec(json.dumps({
        "import": {"parser": "celltype_compartment_fov_treatment_cell", "exclude": ["skip.txt"]},
        "imports": {"again": {"paths": [folder]}, "plain": {"paths": [folder], "parser": "none"}},
        "steps": [{"op": "concat_rows", "inputs": {"a": "data", "b": "again", "c": "plain"}, "as": "rows"}],
    }))
    rows = jobs.run_job(spark, [folder], spec)["rows"]
    assert sorted(calls) == ["celltype_compartment_fov_treatment_cell", "none"]
    assert {r["Source"]: (r["n"], r["fovs"]) for r in rows.groupBy("Source").agg(F.count("*").alias("n"), F.count("FOV").alias("fovs")).collect()} == {
        "a": (3, 3), "b": (3, 3), "c": (3, 0)}


def test_rows_are_dealt_out_before_they_are_written_by_label(spark, tmp_path):
    df = spark.range(60_000, numPartitions=40).select(F.lit("only").alias("label"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "1m")
    try:
        sink.write_table(df, str(tmp_path / "out"), "csv", ["label"])
    finally:
        spark.conf.set(size, before)
    assert 1 < len(list((tmp_path / "out" / "label=only").glob("*.csv"))) < 20
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "out"), header=True).select("id").distinct().count() == 60_000
