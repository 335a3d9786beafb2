import os
import tempfile

from pertscope.sources import io


def test_gmt_later_library_overrides(spark):
    d = tempfile.mkdtemp(prefix="pertscope-test-")
    a, b = os.path.join(d, "a.txt"), os.path.join(d, "b.txt")
    with open(a, "w") as f:
        f.write("T1\tdesc\tG1\tG2\t\tG2\nT2\tdesc\tG3\nshort\tonly\n")
    with open(b, "w") as f:
        f.write("T1\tdesc\tG9\n")
    gs = io.read_gmt(spark, [("libA", a), ("libB", b)])
    rows = sorted((r.library, r.term, r.gene) for r in gs.collect())
    assert rows == [("libA", "T2", "G3"), ("libB", "T1", "G9")]


def test_tsv_strings_and_nan(spark):
    d = tempfile.mkdtemp(prefix="pertscope-test-")
    p = os.path.join(d, "meta.txt")
    with open(p, "w") as f:
        f.write("sig_id\ttas\tqc_pass\ns1\t0.5\t1\ns2\tnan\t0\n")
    df = io.read_metadata_tsv(spark, p, ["sig_id", "tas", "qc_pass"])
    got = {r.sig_id: (r.tas, r.qc_pass) for r in df.collect()}
    assert got == {"s1": ("0.5", "1"), "s2": (None, "0")}


def test_write_neighbors_skips_existing(spark):
    d = tempfile.mkdtemp(prefix="pertscope-test-")
    out = os.path.join(d, "nn")
    io.write_neighbors(spark.createDataFrame([(1, 1, 2, 0.1)], "query_id long, rank int, ref_id long, distance double"), out)
    io.write_neighbors(spark.createDataFrame([(9, 1, 9, 0.9)], "query_id long, rank int, ref_id long, distance double"), out)
    assert [r.query_id for r in spark.read.parquet(out).collect()] == [1]


def test_metadata_is_read_by_column_name(spark, tmp_path):
    from pyspark.sql import types as T

    from pertscope.sources.io import read_compound_info, read_metadata_tsv
    (tmp_path / "m.tsv").write_text("sig_id\tpert_id\ttas\ns1\tP1\t0.5\ns2\trestricted\tnan\n")
    path = str(tmp_path / "m.tsv")
    got = read_metadata_tsv(spark, path, ["tas", "sig_id"]).orderBy("sig_id").collect()
    assert [tuple(r) for r in got] == [("0.5", "s1"), (None, "s2")]
    schema = T.StructType([T.StructField("tas", T.DoubleType()), T.StructField("pert_id", T.StringType())])
    assert [tuple(r) for r in read_compound_info(spark, path, schema, ["pert_id"]).collect()] == [(0.5, "P1")]
