"""Buckets of the store, the kept text index, blocks of the similarity join, folding, and formats of model files."""

import json
import os
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismlake.functions import contracts, text
from prismlake.operators import search
from prismlake.plans.query import Filters, Query
from prismlake.sources.tables import Store, scratch


def parts(store, name, version):
    return store._parts(version)[name]["buckets"]


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=8)
    rows = spark.range(100).select(F.col("id").alias("mediaId"), F.lit(0).alias("n"))
    store.publish({"t": rows, "other": spark.range(3)})
    changed = rows.where("mediaId in (5, 6)").withColumn("n", F.lit(1))
    touched = store.touched(changed)
    assert 1 <= len(touched) <= 2
    new = store.read("t", buckets=touched).join(changed.select("mediaId"), "mediaId", "left_anti").unionByName(changed)
    store.publish({"t": new}, touched)
    assert {b for b, v in parts(store, "t", 2).items() if v == 2} == {str(b) for b in touched}
    assert sorted(map(tuple, store.read("t").collect())) == [(i, int(i in (5, 6))) for i in range(100)]
    assert store.read("t", 1).agg(F.sum("n")).first()[0] == 0 and store.read("other").count() == 3


def test_a_bucket_can_become_empty_and_old_parts_go(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4, keep=2)
    rows = spark.range(40).select(F.col("id").alias("mediaId"))
    store.publish({"t": rows})
    for step in range(3):
        store.publish({"t": rows.where(F.lit(step == 2))}, [0])
    assert store.version() == 4
    assert store.read("t").count() == 40  # bucket 0 came back in the last version
    assert not os.path.exists(tmp_path / "t/2") and os.path.exists(tmp_path / "t/1")
    store.publish({"t": rows.where("false")}, [0, 1, 2, 3])
    assert store.read("t").count() == 0 and store.read("t").columns == ["mediaId"]


def test_kept_text_index(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    texts = {1: "one two", 2: "two three", 3: "three", 4: ""}
    rows = spark.createDataFrame(list(texts.items()), "mediaId long, searchText string")
    index = search.TextIndex(store)
    store.publish(index.rebuilt(rows))
    assert {r[0] for r in index.matches(["two"]).collect()} == {1, 2} and {r[0] for r in index.matches(["two", "three"]).collect()} == {2}
    touched = store.touched(rows.where("mediaId = 3"))
    again = rows.where(store.bucket().isin(touched)).withColumn("searchText", F.when(F.col("mediaId") == 3, "two").otherwise(F.col("searchText")))
    store.publish(index.rebuilt(again), touched)
    assert {r[0] for r in index.matches(["two"]).collect()} == {1, 2, 3}
    plan = index.postings(["two"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "EqualTo(word,two)" in plan or "In(word" in plan


def test_similar_pairs_in_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, [1.0])], "id long, embedding array<double>")
    expected = {(i, j) for i in range(0, 60, 5) for j in range(60) if v[i] @ v[j] >= 0.3}
    for size in (1 << 20, 300):
        found = search.similar_pairs(df.where("id % 5 = 0"), df, 0.3, 8, block_bytes=size)
        assert {(r.left_id, r.right_id) for r in found.collect()} == expected
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert search.similar_pairs(df.limit(0), df, 0.3, 8).collect() == []


def test_faces_are_matched_after_the_cheap_filters(spark):
    media = spark.createDataFrame([(1, "IMAGE", 1, 0, [1.0], 1), (2, "VIDEO", 1, 0, [1.0], 1)], "mediaId long, mediaType string, dateTaken long, dateAdded long, embedding array<double>, embeddingDimension int")
    faces = spark.createDataFrame([(1, [[1.0, 0.0]]), (2, [[1.0, 0.0]])], "mediaId long, faces array<array<double>>")
    found = search.search(media, Query(Filters(media_type="IMAGE"), people=((1.0, 0.0),)), faces)
    assert [r.mediaId for r in found.collect()] == [1]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_folding_is_that_of_the_driver(spark):
    samples = ["Ánh Dương ĐẸP", "plain text", "ﬁ ½ Å K", "한국어 각", "가각", "été", "ÀÉÎõü ß ẞ Ʀ", "𝔘nicode 𐐀", "", "日本 語", "ǅ Ǆ", "İstanbul"]
    samples += [chr(c) for c in range(0xA0, 0x10000, 7) if unicodedata.ucd_3_2_0.category(chr(c)) not in ("Cs", "Cn")]  # older than the JVM's tables
    df = spark.createDataFrame([(i, t) for i, t in enumerate(samples)], "i int, t string")
    for t in ("ΟΔΟΣ ΣΑΣ Σ", "Đường ĐI", "İ̇x", None):
        assert t is None or text.folded(t) == text.fold_query(t)
    for i, t, got in df.select("i", "t", text.fold(F.col("t")).alias("f")).collect():
        bare = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M"))
        if bare.lower() == bare.casefold() and len(bare.lower()) == len(bare) and all(unicodedata.category(c) != "Cn" for c in t):
            assert got == text.fold_query(t), (t, got)


def test_public_word_ends_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("word_bpe_49k.json")
    ours, theirs = text.public_pairs(path), tokenizers.Tokenizer.from_file(path)
    for t in ("A photo of two cats, at 10 o'clock!", "the quick brown fox " * 30, "ñandú über-cool", ""):
        ids = [i for i in theirs.encode(t, add_special_tokens=False).ids if i < 49406]
        assert ours.ids(t) == ([49406, *ids[:75], 49407] + [0] * 77)[:77]


def test_wire_format():
    fields = [(1, 0), (2, b"name"), (15, 2**40), (3, b""), (1, 300)]
    data = contracts.wire_message(fields)
    assert list(contracts.wire_fields(data)) == fields
    assert list(contracts.wire_fields(contracts.wire_number(4 << 3 | 5) + b"abcd")) == [(4, b"abcd")]
    for broken in (data[:-1], b"\x0a\x05ab", b"\x0b", b"\xff" * 11):
        with pytest.raises(contracts.ContractError):
            list(contracts.wire_fields(broken))


def test_exported_tokenizer_reads_back(spark, tmp_path):
    names = ['a"b', "b\\", "c</w>", "é"]
    vocabulary = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "token string, id int").repartition(3)
    merges = spark.createDataFrame([(1, "b", "c"), (0, "a", "b")], "rank int, first string, second string")
    contracts.export_tokenizer(vocabulary, merges, str(tmp_path / "t"))
    written = "".join(r.value for r in spark.read.text(str(tmp_path / "t/vocabulary")).collect())
    assert list(json.loads(written).items()) == [(n, i) for i, n in enumerate(names)]
    assert [(r.first, r.second) for r in contracts.merge_list(spark, str(tmp_path / "t/merges")).orderBy("rank").collect()] == [("a", "b"), ("b", "c")]


def test_scratch_is_shared(spark):
    class Far:
        master = "spark://host:7077"

    class Session:
        sparkContext = Far

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(ValueError):
        scratch(Session)
