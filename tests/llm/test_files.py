"""Archives, shards, the registered SQL twins and the pipeline."""

import base64
import gzip
import hashlib
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from msgscreen.llm import jaccard, packing, quality, sharding, suffixdedup, toxicity, warc
from msgscreen.llm.oracles import SQL
from msgscreen.llm.queries import QUERIES

from .conftest import SF0001, VOCABULARY

PAGES = [(1, "http://a/ b\n", "x"), (5, "http://b/", "x"), (3, None, "x"), (2, "u", None), (9, "u", ""), (4, "u", "é" * 100_000), (7, "u", "only"),
         (7, "u", "only"), (7, "v", "x"), (None, "n", "x"), (None, "n", "lonely"), (8, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def want_records(pages, least=0):
    top = {}
    for key, _, text in pages:
        top.setdefault(text or "", []).append(key)
    out = []
    for key, _, text in pages:
        best = max((k for k in top[text or ""] if k is not None), default=None)
        again = len((text or "").encode()) >= least and len(top[text or ""]) > 1 and key != best
        out.append((key, len((text or "").encode()), digest(text), "revisit" if again else "response", best if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 1])
def test_archive_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("shard", F.lit(0)).withColumn("sha1", F.lit("mine"))
    path = f"file://{tmp_path}/a"
    manifest = warc.write_warc(df, path, revisit_bytes=least, shards=3, file_bytes=300)
    out = warc.read_warc(spark, path, payloads=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want_records(PAGES, least)
    texts = Counter((r.page_id, bytes(r.payload)) for r in out if r.record_type == "response")
    assert all((k, t) in {(k, (h or "").encode()) for k, _, h in PAGES} for k, t in texts)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    assert {r.url for r in out} == {"http://a/%20b%0A", "http://b/", None, "u", "v", "n"}


def test_archive_is_deterministic(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    found = []
    for n, parts in (("a", 1), ("b", 4)):
        warc.write_warc(df.repartition(parts), f"{tmp_path}/{n}", shards=2, file_bytes=400)
        files = [f for f in sorted(os.listdir(f"{tmp_path}/{n}")) if f.endswith(".gz")]
        assert not any("_temporary" in f for f in os.listdir(f"{tmp_path}/{n}"))
        found.append([(f, open(f"{tmp_path}/{n}/{f}", "rb").read()) for f in files])
    assert found[0] == found[1]
    assert gzip.decompress(found[0][0][1]).startswith(b"WARC/1.1\r\nWARC-Type: ")


def file_bytes(path):
    return {f: hashlib.sha256(open(f"{path}/{f}", "rb").read()).hexdigest() for f in os.listdir(path) if f.endswith(".gz")}


def test_archive_depends_on_the_rows_alone(spark, tmp_path):
    """One id and text under several urls, in two orders, under two numbers of partitions; leftovers go."""
    rows = [(7, f"http://u{i}/", "same") for i in range(6)] + [(i, "http://x/", "t" * i) for i in range(40)] + [(None, f"http://n{i}/", f"n{i}") for i in range(9)]
    key, found = "spark.sql.shuffle.partitions", []
    before = spark.conf.get(key)
    try:
        for n, order in (("4", rows), ("9", rows[::-1])):
            spark.conf.set(key, n)
            path = f"{tmp_path}/p{n}"
            os.makedirs(path)
            open(f"{path}/_temporary-lost-shard-000000.warc.gz", "wb").close()
            warc.write_warc(spark.createDataFrame(order, "page_id long, url string, html string").repartition(int(n)), path, shard_bytes=200)
            assert not any(f.startswith("_temporary") for f in os.listdir(path))
            found.append(file_bytes(path))
    finally:
        spark.conf.set(key, before)
    assert found[0] == found[1] and len(found[0]) >= 2


@pytest.mark.parametrize("case", ["outlier", "hot id", "null ids", "dense", "far apart"])
def test_archive_shards_are_about_equal(spark, tmp_path, case):
    ids = {"outlier": [*range(200), 10**12], "hot id": [5] * 100 + list(range(200)), "null ids": [None] * 100 + list(range(200)), "dense": list(range(300)),
           "far apart": [x for i in range(150) for x in (i - 2**62, 2**62 + i)]}[case]
    rows = [(k, f"http://h/{i}", f"page {i} " + "x" * 3000) for i, k in enumerate(ids)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_warc(df, f"{tmp_path}/a", shards=4)
    held = {r.shard: r.n for r in manifest.groupBy("shard").agg(F.sum("records").alias("n")).collect()}
    assert set(held) == set(range(4)) and max(held.values()) <= 1.7 * len(rows) / 4 and sum(held.values()) == len(rows)
    order = [r.page_id for r in warc.read_warc(spark, f"{tmp_path}/a").withColumn("at", F.monotonically_increasing_id()).orderBy("file", "at").collect()]
    assert order == sorted(ids, key=lambda k: (k is not None, k or 0))


def test_archive_empty_and_damaged(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    assert warc.archive(df.where("false"), f"{tmp_path}/e").count() == 0
    warc.write_warc(df, f"{tmp_path}/d", shards=1)
    with open(f"{tmp_path}/d/left-over.warc.gz", "wb") as f:
        f.write(b"not in the manifest")
    assert warc.read_warc(spark, f"{tmp_path}/d").count() == len(PAGES)
    name = warc.read_warc(spark, f"{tmp_path}/d").first().file
    with open(f"{tmp_path}/d/{name}", "rb") as f:
        data = gzip.decompress(f.read())
    with open(f"{tmp_path}/d/{name}", "wb") as f:
        f.write(gzip.compress(data.replace(b"lonely", b"lovely")))
    with pytest.raises(Exception, match="digest|records"):
        warc.read_warc(spark, f"{tmp_path}/d").count()


def test_shards(docs, rows, none, tmp_path):
    out = sharding.interleave(docs, 5, carry=("lang",)).collect()
    assert len(out) == len(rows) and Counter(r.doc_id for r in out) == Counter(i for i, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sizes[s]))
    shares = Counter(r.source_key for r in out)
    for source, n in shares.items():
        for s in sizes:
            assert abs(sum(r.shard == s and r.source_key == source for r in out) - n * sizes[s] / len(out)) <= len(shares)
    assert {r["size"] for r in out if r.doc_id is None} >= {8}
    assert sharding.interleave(none).count() == 0
    sharding.write_shards(docs.select("doc_id", "text", "source"), f"{tmp_path}/s", n_shards=3)
    spark = docs.sparkSession
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(rows)


def test_shards_are_native(docs):
    plan = sharding.interleave(docs.select("doc_id", "text", "source"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    want = con.sql(SQL[name])
    got = QUERIES[name](spark, SF0001)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())


def test_all_registered():
    names = set(E.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(SQL) <= set(E.oracle_sql())


def test_pipeline_like_its_stages(spark):
    """Each stage's decision from its operator's plain scores and groups, on what the stage before kept."""
    labels = spark.read.parquet(f"{SF0001}/labels.parquet")
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.predicted for r in toxicity.classify(docs, labels).collect()}
    docs = docs.where(F.col("doc_id").isin([k for k in text if not toxic[k]]))
    good = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    docs = docs.where(F.col("doc_id").isin([k for k in good if good[k]]))
    groups = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    docs = docs.where(F.col("doc_id").isin([k for k in groups if groups[k] == k]))
    cut = {r.doc_id: r["cut"].kept.decode(errors="ignore") for r in suffixdedup.deduplicate(docs).collect()}
    want = packing.pieces(spark.createDataFrame(list(cut.items()), "doc_id long, text string"), VOCABULARY).collect()
    got = corpus_pipeline.run(spark, SF0001).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(map(tuple, want))
    assert len(cut) < len(text)


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, docs, stage):
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF0001)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert corpus_pipeline.STAGES[stage][1](spark, docs.where("false"), SF0001).count() == 0
