"""Operators on small fixtures whose results are worked out by hand or by brute force."""

import unicodedata
from datetime import UTC, datetime
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from prismlake.functions import contracts, faces, images, scalars, text, vectors
from prismlake.operators import albums, planning, search, store
from prismlake.plans import query as plans
from prismlake.plans.query import Filters, Query, QueryError
from prismlake.schemas import FACE_MODEL, FACES, FACE_INDEX, HISTORY, IMAGE_MODEL, MEDIA, PEOPLE, PHOTO_TEXT, TEXT_MODEL, allowed, conform, migrate
from prismlake.sources import library

HALF = 0.70710678


def media_rows(spark, rows):
    """(id, vector, dateTaken, revision) with everything else empty."""
    full = [(i, f"u{i}", "IMAGE", rev, None, taken, None, None, None, None, None, None, [float(x) for x in v], len(v), 0) for i, v, taken, rev in rows]
    return spark.createDataFrame(full, MEDIA)


@pytest.fixture(scope="module")
def album(spark):
    media = media_rows(spark, [(0, (1, 0), None, 0), (1, (0, 1), None, 0), (2, (HALF, HALF), None, 0)])
    face_rows = spark.createDataFrame([(0, 0, [1.0, 0.0], 2), (1, 0, [0.0, 1.0], 2), (2, 0, [1.0, 0.0], 2), (2, 1, [0.0, 1.0], 2)], FACES)
    scanned = spark.createDataFrame([(i, 0, FACE_MODEL) for i in range(3)], FACE_INDEX)
    people = spark.createDataFrame(
        [(1, "Alex", "alex", bytearray(b"a"), [1.0, 0.0], 2, FACE_MODEL), (2, "Mai", "mai", bytearray(b"b"), [0.0, 1.0], 2, FACE_MODEL), (3, "Old", "legacy", bytearray(b"c"), [1.0, 0.0], 2, IMAGE_MODEL)], PEOPLE
    )
    return media, face_rows, scanned, people


def texts_of(spark, rows, revision=0, model=TEXT_MODEL):
    df = spark.createDataFrame([(i, t, "", revision, model, False) for i, t in rows], PHOTO_TEXT)
    return df.withColumn("searchText", text.fold(F.col("text")))


def find(album, typed, mode="NORMAL", texts=None, limit=100, references=(), encoder=lambda t: [0.0, 1.0]):
    media, face_rows, scanned, people = album
    built = plans.build(typed, Filters(mode=mode), people, limit=limit, encode_text=encoder, references=references)
    ids = search.text_matches(texts, media, built.words) if mode == "OCR" else None
    rows = search.search(media, built, search.face_lists(face_rows, scanned, media), ids)
    return [r.mediaId for r in rows.collect()]


def refuse(_):
    raise AssertionError("nothing may be encoded")


def test_text_search_ignores_accents_and_knows_people(spark, album):
    texts = texts_of(spark, [(0, "HÓA ĐƠN Tổng cộng 70.000 đ"), (2, "hóa đơn 35.000 đ")])
    assert set(find(album, "hoa don", "OCR", texts, encoder=refuse)) == {0, 2}
    assert find(album, "hóa đơn 70.000", "OCR", texts) == [0]
    assert find(album, "@mai hóa đơn", "OCR", texts) == [2]
    assert find(album, "không tồn tại", "OCR", texts, encoder=refuse) == []


def test_people_and_descriptions(album):
    assert set(find(album, "@ALEX", encoder=refuse)) == {0, 2}
    assert find(album, "@alex beach")[0] == 2
    assert find(album, "@alex @mai beach") == [2]
    assert find(album, "", references=[[1.0, 0.0]])[0] == 0
    assert find(album, "beach", references=[[1.0, 0.0]])[0] == 2
    assert find(album, "beach", limit=1) == [1]
    assert find(album, "beach", limit=0) == []


@pytest.mark.parametrize("typed, mode, message", [("@unknown beach", "NORMAL", "@unknown"), ("@legacy", "NORMAL", "update the face photo"), ("beach with @", "NORMAL", "saved name"), ("— *", "OCR", "words"), ("", "NORMAL", "enter a prompt")])
def test_bad_queries_fail_before_encoding(album, typed, mode, message):
    with pytest.raises(QueryError, match=message):
        plans.build(typed, Filters(mode=mode), album[3], encode_text=refuse)
    with pytest.raises(QueryError):
        Query(Filters(mode="OCR"), vector=(1.0,))


def test_stale_text_and_faces_never_match(spark, album):
    media, face_rows, scanned, people = album
    assert find(album, "hoa", "OCR", texts_of(spark, [(0, "hóa")], revision=1)) == []
    assert find(album, "hoa", "OCR", texts_of(spark, [(0, "hóa")], model="old")) == []
    newer = media.withColumn("dateModified", F.col("dateModified") + 1)
    assert search.face_lists(face_rows, scanned, newer).count() == 0


def test_top_k_orders(spark):
    many = media_rows(spark, [(i, (1, 0), i, 0) for i in range(1, 601)])
    ids = many.select("mediaId")
    for rows in (many, many.orderBy(F.desc("mediaId")).repartition(7)):
        assert [r.mediaId for r in search.search(rows, Query(Filters(sort="NEWEST_FIRST", mode="OCR"), limit=3), text_ids=ids).collect()] == [600, 599, 598]
        assert [r.mediaId for r in search.search(rows, Query(Filters(sort="OLDEST_FIRST", mode="OCR"), limit=3), text_ids=ids).collect()] == [1, 2, 3]
        assert [r.mediaId for r in search.search(rows, Query(vector=(1.0, 0.0), limit=3)).collect()] == [600, 599, 598]
    few = media_rows(spark, [(1, (1, 0), 3, 0), (2, (0.8, 0.2), 9, 0), (3, (0, 1), 5, 0)])
    assert [r.mediaId for r in search.search(few, Query(vector=(1.0, 0.0), limit=2)).collect()] == [1, 2]
    # the k most relevant first, then by date
    assert [r.mediaId for r in search.search(few, Query(Filters(sort="NEWEST_FIRST"), (1.0, 0.0), limit=2)).collect()] == [2, 1]
    assert search.search(few, Query(vector=(1.0, 0.0, 0.0))).count() == 0
    assert search.search(few.where("false"), Query(vector=(1.0, 0.0))).count() == 0


def test_faces_are_matched_before_the_limit(spark):
    media = media_rows(spark, [(i, (1, 0) if i < 513 else (0, 1), i, 0) for i in range(1, 514)])
    lists = spark.createDataFrame([(513, [[1.0, 0.0]])], "mediaId long, faces array<array<float>>")
    assert [r.mediaId for r in search.search(media, Query(vector=(1.0, 0.0), people=((1.0, 0.0),), limit=1), lists).collect()] == [513]


ALEX, MAI, BOTH = [1.0, 0.0], [0.0, 1.0], [HALF, HALF]


@pytest.mark.parametrize(
    "people, found, expected",
    [([ALEX, MAI], [MAI, ALEX], 1.0), ([ALEX, MAI], [ALEX], None), ([ALEX, MAI], [ALEX, ALEX], None), ([ALEX, MAI], [BOTH, [-1.0, 0.0]], None), ([ALEX, MAI], [BOTH, ALEX], 0.85355),
     ([ALEX], [], None), ([ALEX], [MAI], None), ([ALEX], [[float("nan"), 0.0]], None), ([ALEX], [[1.0, 0.0, 0.0]], None)],
)
def test_face_assignment(spark, people, found, expected):
    row = spark.createDataFrame([(found,)], "faces array<array<float>>")
    got = row.select(faces.match_all(people)(F.col("faces"))).first()[0]
    assert got is None if expected is None else abs(got - expected) < 1e-4
    if len(people) == 1:
        assert row.select(faces.match_one(people[0])(F.col("faces"))).first()[0] == got
    with pytest.raises(ValueError):
        faces.match_all(people, 1.5)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4), st.integers(1, 5), st.integers(0, 10**6))
def test_assignment_exists_if_any_does(persons, n, seed):
    scores = np.random.default_rng(seed).uniform(-1, 1, (persons, n))
    possible = any(all(scores[p, f] >= 0.2 for p, f in enumerate(way)) for way in permutations(range(n), persons))
    assert (faces.assign(scores, 0.2) is not None) == possible


def test_assignment_keeps_its_choices():
    """Which faces are taken where several ways exist, as means of scores."""
    got = [faces.assign(np.random.default_rng(seed).uniform(0, 1, (4, 6)).round(2), 0.5) for seed in (1, 2, 3, 4, 5, 6)]
    assert np.allclose(got, [0.8875, 0.805, 0.745, 0.94, 0.915, 0.9175])
    assert faces.assign(np.array([[0.9, 0.8], [0.9, np.nan]]), 0.5) == pytest.approx(0.85)
    assert faces.assign(np.full((2, 2), 0.5), 0.5) == 0.5 and faces.assign(np.zeros((0, 3))) is None


def test_entities():
    cases = {"&amp;lt;": "&lt;", "&#65;&#x41;&#X6f;": "AAo", "&#x110000;&#xD800;&#;&#x;&#1_0;": "&#x110000;&#xD800;&#;&#x;&#1_0;", "& amp; &amp &&lt;": "& amp; &amp &<", "&NBSP;|&nope;&é;": "\xa0|&nope;&é;", "": "", "&": "&"}
    assert [text._unescape(k) for k in cases] == list(cases.values())


def test_overlaps_and_alignment(spark):
    def box(left, right, score):
        return {"left": left, "top": 0.0, "right": right, "bottom": 100.0, "score": score, "landmarks": []}

    boxes = [box(0.0, 100.0, 0.9), box(1.0, 100.0, 0.8), box(200.0, 300.0, 0.9)]
    assert faces.keep_best(boxes) == [boxes[0], boxes[2]]
    source = np.stack([-2 * faces.TEMPLATE[:, 1] + 300, 2 * faces.TEMPLATE[:, 0] + 20], 1)
    a, b, tx, ty = faces.align(source)
    back = np.stack([a * source[:, 0] - b * source[:, 1] + tx, b * source[:, 0] + a * source[:, 1] + ty], 1)
    assert np.abs(back - faces.TEMPLATE).max() < 1e-3
    for bad in (np.zeros((5, 2)), np.full((5, 2), np.nan), np.zeros((4, 2))):
        with pytest.raises(ValueError):
            faces.align(bad)
    df = spark.createDataFrame([([Row(x=1.0, y=1.0)] * 5,)], "p array<struct<x:double,y:double>>")
    assert "degenerate" in df.select(faces.aligned(F.col("p")).alias("t")).first().t.error


def test_anchors():
    outputs = [np.zeros(n * k) for k in (1, 4, 10) for n in (12800, 3200, 800)]
    cell = 2 * (10 * 80 + 20)  # the first anchor of row 10, column 20 at stride 8
    outputs[0][cell] = 0.9
    outputs[3][4 * cell : 4 * cell + 4] = [1, 2, 3, 4]
    (found,) = faces.decode_anchors(outputs, 1280, 640)
    assert [found[k] for k in ("left", "top", "right", "bottom")] == [304.0, 128.0, 368.0, 224.0] and found["landmarks"][0] == {"x": 320.0, "y": 160.0}
    with pytest.raises(ValueError):
        faces.decode_anchors(outputs[:8], 640, 640)


def test_vectors(spark):
    assert np.allclose(vectors.unit([3, 4]), [0.6, 0.8])
    for bad in ([0, 0], [float("nan"), 1]):
        with pytest.raises(ValueError):
            vectors.unit(bad)
    for references in ([[0, 1]], [[0, 1], [0, 1]]):
        assert np.allclose(vectors.compose([1, 0], references), [HALF, HALF])
    for text_vector, references in ((None, []), ([1, 0], [[1, 0, 0]])):
        with pytest.raises(ValueError):
            vectors.compose(text_vector, references)
    values = [-1.25, 0.0, 3.14159, 1.4e-45]
    df = spark.createDataFrame([(values,), ([0.5, -1.0, 2.0, 0.0],)], "v array<float>").withColumn("b", vectors.encode(F.col("v")))
    assert all(df.select(vectors.decode(F.col("b"), F.lit(4)) == F.col("v")).toPandas().iloc[:, 0])
    dots = [r[0] for r in df.select(vectors.encoded_dot([1, 0.5, 1.25, 0])(F.col("b"), F.lit(4))).collect()]
    assert abs(dots[1] - 2.5) < 1e-9
    with pytest.raises(Exception, match="bytes"):
        df.select(vectors.decode(F.col("b"), F.lit(3))).collect()
    assert df.select(F.round(vectors.norm(vectors.normalized(F.col("v"))), 9)).first()[0] == 1.0
    with pytest.raises(Exception, match="normalized"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(vectors.normalized(F.col("v"))).collect()


def test_folding_and_query_words(spark):
    cases = {"HÓA ĐƠN: Cà phê sữa — 70.000 đ": "hoa don ca phe sua 70 000 d", "  ": "", "É́x": "ex"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.fold(F.col("t"))).collect()] == list(cases.values())
    assert [text.fold_query(k) for k in cases] == list(cases.values())
    assert text.full_text_query("hóa đơn OR NEAR* hóa") == '"hoa" "don" "or" "near"' and text.full_text_query('— * "') is None
    with pytest.raises(ValueError):
        text.query_words(" ".join(f"w{i}" for i in range(65)))


def test_mentions_and_handles(spark):
    cases = {"@Alex and @mai_anh at the beach with @ALEX": (["alex", "mai_anh"], "and at the beach with"), "@Alex!": (["alex"], ""), "receipt from alex@example.com": ([], "receipt from alex@example.com"),
             unicodedata.normalize("NFD", "@Đặng_Thảo hóa đơn"): (["đặng_thảo"], unicodedata.normalize("NFD", "hóa đơn"))}
    for typed, (handles, rest) in cases.items():
        assert plans.parse(typed) == (rest, handles)
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select(text.mentions(F.col("t")), text.without_mentions(F.col("t"))).collect()
    assert [(list(r[0]), r[1]) for r in got] == list(cases.values())
    names = {" Mai Anh ": "mai_anh", "Trần": "trần", "Alex Smith!": None, "José": "josé", "José": "josé", "@x": "x", "": None, "a" * 41: None}
    df = spark.createDataFrame([(k,) for k in names], "t string")
    assert [r[0] for r in df.select(text.handle(F.col("t"))).collect()] == list(names.values())
    for name, wanted in names.items():
        if wanted is None:
            with pytest.raises(QueryError):
                plans.canonical_handle(name)
        else:
            assert plans.canonical_handle(name) == wanted


def test_open_mentions():
    cases = {"photos of @Ma": "ma", "@": "", "@mai ": None, "a@b": None, "x @Đặng": "đặng", "x @a.b": None, "@@x": None}
    assert {k: plans.open_mention(k) for k in cases} == cases


def test_faces_get_their_numbers(spark):
    df = spark.createDataFrame([(1, [5.0, 6.0]), (2, [])], "mediaId long, faces array<double>")
    assert [tuple(r) for r in faces.numbered(df).collect()] == [(1, 0, 5.0), (1, 1, 6.0)]
    with pytest.raises(Exception, match="too many faces"):
        faces.numbered(df, most=1).collect()


def test_cleaning_and_byte_pairs(spark):
    cases = {"  A &amp; B\n": "a & b", "&amp;lt;TAG&amp;gt;": "<tag>", "cafÃ©": "café", "Ünïcode 日本": "ünïcode 日本", "&#x41;&#66;&#xD800; &nope;": "ab&#xd800; &nope;"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(text.cleaned(F.col("t"))).collect()] == list(cases.values())
    assert len(set(text.byte_alphabet().values())) == 256
    alphabet = [*text.byte_alphabet().values()]
    merges = [("c", "a"), ("ca", "t</w>"), ("a", "t</w>")]
    names = [*alphabet, *(c + "</w>" for c in alphabet), *("".join(m) for m in merges), "<s>", "<e>"]
    vocabulary = {n: i for i, n in enumerate(names)}
    made = text.BytePairs(vocabulary, merges, "<s>", "<e>", length=8)
    assert made.ids("A cat") == [vocabulary[x] for x in ("<s>", "a</w>", "cat</w>", "<e>")] + [0] * 4
    assert len(made.ids("bat " * 9)) == 8 and made.ids("bat " * 9)[-1] == vocabulary["<e>"]
    assert made.pieces("bat") == ("b", "at</w>")
    assert [r[0] for r in df.limit(1).select(text.token_ids(made)(F.lit("cat"))).collect()] == [made.ids("cat")]


def test_names_modes_and_blanks(spark):
    df = spark.createDataFrame([("a/b.c.PNG", "image/jpeg"), ("x.webp", "image/x"), (None, "image/png"), (" .jpg", None), ("n" * 99, None)], "n string, m string")
    got = [r[0] for r in df.select(text.copy_name(F.col("n"), F.col("m"), F.lit("0123456789"))).collect()]
    assert got == ["a_b.c-copy-01234567.jpg", "x-copy-01234567.webp", "Photo-copy-01234567.png", "Photo-copy-01234567.jpg", "n" * 80 + "-copy-01234567.img"]
    modes = spark.createDataFrame([(m,) for m in ("HYBRID", "VISUAL", "NORMAL", "?", "TEXT_IN_PHOTOS", "OCR")], "m string")
    assert [r[0] for r in modes.select(text.stored_mode(F.col("m"))).collect()] == ["NORMAL"] * 4 + ["OCR"] * 2
    first, more = text.truncated(F.col("n"), 3)
    assert [tuple(r) for r in df.select(first, more).collect()][1:3] == [("x.w", True), (None, False)]


def test_dates():
    def ms(day, hour=0):
        return int(datetime(2026, 8, day, hour, tzinfo=UTC).timestamp() * 1000)

    assert scalars.date_bounds("TODAY", ms(29, 6), "Asia/Ho_Chi_Minh") == (ms(28, 17), ms(29, 17))
    assert scalars.date_bounds("CUSTOM", 0, custom=(10, 20)) == (10, 20) and scalars.date_bounds("ANY_TIME", 0) == (None, None)
    assert scalars.date_bounds("THIS_WEEK", ms(29, 6), first_weekday=6) == (ms(23), ms(30)) and scalars.date_bounds("THIS_WEEK", ms(29, 6))[0] == ms(24)
    assert scalars.date_bounds("YESTERDAY", ms(29, 6)) == (ms(28), ms(29)) and scalars.date_bounds("THIS_MONTH", ms(29, 6))[0] == ms(1)
    # a day of 23 and one of 25 hours
    assert [(b - a) / 3600000 for a, b in (scalars.date_bounds("TODAY", t, "America/New_York") for t in (1772985600000, 1793550000000))] == [23, 25]
    assert scalars.picked_range(ms(10), ms(12), "Asia/Ho_Chi_Minh") == (ms(9, 17), ms(12, 17))
    assert scalars.recent_cutoff(0) == -2592000 and scalars.recent_cutoff(1) == -2591999
    with pytest.raises(ValueError):
        scalars.date_bounds("SOMETIME", 0)


def test_null_dates_have_two_rules(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, 5), (3, 7, 5), (4, None, 2**62)], "id long, dateTaken long, dateAdded long")
    assert [tuple(r) for r in df.select(scalars.filter_time(), scalars.rank_time()).collect()] == [(None, 0), (5000, 5000), (7, 7), (None, None)]


def test_percentages(spark):
    df = spark.createDataFrame([(-2.0,), (-1.0,), (0.0,), (0.01,), (1.0,), (3.0,)], "s double")
    assert [r[0] for r in df.select(scalars.match_percentage(F.col("s"))).collect()] == [0, 0, 50, 51, 100, 100]


def photos(spark, rows):
    return spark.createDataFrame(rows, "mediaId long, uri string, dateTaken long, dateAdded long, bucketId string, bucketName string")


def test_albums(spark):
    rows = photos(spark, [(1, "a", None, 100, None, None), (2, "b", None, 200, "x", " "), (3, "c", None, 200, "y", None)])
    assert [r.mediaId for r in albums.photos_for(albums.RECENT, rows, 300000).collect()] == [3, 2, 1]
    assert [r.id for r in albums.build(rows, 300000).collect()] == ["all", "recent"]
    assert albums.build(rows.where("false"), 300000).collect() == []
    day = 86400
    edge = photos(spark, [(1, "a", None, 100 * day, "b1", "One"), (2, "b", None, 100 * day - 1, "b1", "One"), (3, "c", 5, 0, "b2", "Two"), (4, "d", 9, 0, "b2", "Two"), (5, "e", 1, 0, "b1", "Other name"), (6, "f", 0, 0, "all", "Mine")])
    got = [(r.id, r.name, r["count"], r.coverUri) for r in albums.build(edge, 130 * day * 1000).collect()]
    assert got == [("all", "All Photos", 6, "d"), ("recent", "Recently Added", 1, "a"), ("b2", "Two", 2, "d"), ("b1", "One", 2, "a")]
    assert [r.mediaId for r in albums.photos_for("b1", edge, 0).collect()] == [5, 1, 2]


def test_planning(spark):
    def items(rows):
        return spark.createDataFrame(rows, "mediaId long, dateModified long")

    def stored(rows):
        return spark.createDataFrame(rows, "mediaId long, dateModified long, embeddingDimension int")

    def work(current, known):
        return {r.mediaId: r.work for r in planning.classify(items(current), stored(known)).collect()}

    assert work([(1, 1), (2, 1)], [(1, 1, 512)]) == {1: "unchanged", 2: "new"}
    assert work([(1, 3)], [(1, 2, 512)]) == {1: "changed"} and work([(1, 1)], [(1, 1, 0)]) == {1: "pending"}
    assert [r.mediaId for r in planning.deleted(items([(1, 1)]), stored([(1, 1, 512), (9, 1, 512)])).collect()] == [9]
    states = spark.createDataFrame([(1, 1, TEXT_MODEL), (2, 1, "old"), (3, 0, TEXT_MODEL)], "mediaId long, dateModified long, modelVersion string")
    current = items([(1, 1), (2, 1), (3, 1), (4, 1)])
    assert {r.mediaId for r in planning.text_pending(current, states).collect()} == {2, 3, 4}
    assert {r.mediaId for r in planning.text_pending(current, states, items([(1, 1)])).collect()} == {1, 2, 3, 4}
    assert planning.snapshot_difference(current, current).isEmpty() and planning.snapshot_difference(current, items([(1, 2)])).count() == 5

    result = F.struct(F.lit("v").alias("value"), F.when(F.col("mediaId") == 2, "bad").alias("error"))

    def unavailable(_):
        raise RuntimeError("no model")

    stages = [planning.Stage("visual", lambda c: c, lambda p: p.withColumn("result", result), True), planning.Stage("faces", lambda c: c, unavailable, True), planning.Stage("text", lambda c: c.where("mediaId > 1"), lambda p: p.withColumn("result", result), False)]
    good, progress = planning.run_stages(current, stages)
    assert {r.mediaId for r in good["visual"].collect()} == {1, 3, 4} and "faces" not in good
    assert [(p["processed"], p["failed"], p["status"]) for p in progress] == [(4, 1, "INTERRUPTED"), (0, 0, "UNAVAILABLE"), (3, 1, "INTERRUPTED")]


def test_revision_rules(spark):
    stored = media_rows(spark, [(1, (1, 0), None, 2), (2, (1, 0), None, 1)])
    late, same, newer = (media_rows(spark, [(1, (0, 1), None, r)]) for r in (1, 2, 3))

    def state(df):
        return {r.mediaId: (r.dateModified, list(r.embedding)) for r in df.collect()}

    assert state(store.upsert_media(stored, late))[1] == (2, [1, 0]) and state(store.upsert_media(stored, same))[1] == (2, [0, 1]) and state(store.upsert_media(stored, newer))[1] == (3, [0, 1])
    assert state(store.ensure_metadata(stored, same))[1] == (2, [1, 0]) and state(store.ensure_metadata(stored, newer))[1] == (3, [])
    texts = texts_of(spark, [(1, "a"), (2, "b")], revision=2)
    assert [r.mediaId for r in store.put_text(texts.where("false"), texts, stored).collect()] == [1]
    for incoming, left in ((late, {1, 2}), (same, {1, 2}), (newer, {2})):
        kept = store.cascade({"photo_text": texts}, store.upsert_media(stored, incoming), stored)["photo_text"]
        assert {r.mediaId for r in kept.collect()} == left
    states = spark.createDataFrame([(1, 2, FACE_MODEL), (2, 1, FACE_MODEL)], FACE_INDEX)
    found = spark.createDataFrame([(1, 0, [1.0], 1), (1, 1, [1.0], 1), (2, 0, [1.0], 1)], FACES)
    _, left = store.replace_faces(states, found, states.where("mediaId = 1"), found.where("false"), stored)
    assert [(r.mediaId, r.faceIndex) for r in left.collect()] == [(2, 0)]
    gone = store.delete_media({"media_embeddings": stored, "photo_text": texts, "people": texts}, stored.where("mediaId = 1"))
    assert [gone[n].count() for n in ("media_embeddings", "photo_text", "people")] == [1, 1, 2]


def test_history_progress_and_people(spark, album):
    history = spark.createDataFrame([(i, "q", i // 2, "NORMAL", None) for i in range(105)], HISTORY)
    kept = store.add_history(history.limit(0), history)
    assert kept.count() == 100 and kept.first().id == 104 and store.clear(kept).count() == 0
    people = album[3]
    with pytest.raises(store.StoreError, match="@mai"):
        store.add_people(people, people.where("handle = 'mai'"))
    with pytest.raises(store.StoreError, match="already"):
        store.enroll(people, "@MAI", [1.0, 0.0], b"x")
    with pytest.raises(store.StoreError, match="no longer"):
        store.enroll(people, "mai", [1.0, 0.0], b"x", existing=1)
    more = store.enroll(people, " New One ", [1.0, 0.0], b"x")
    assert more.where("handle = 'new_one' AND id = 4 AND name = 'New One'").count() == 1
    again = store.enroll(people, "legacy", [0.0, 1.0], b"x", existing=3)
    assert again.where("id = 3").first().embeddingModel == FACE_MODEL
    assert store.update_face(people, 77, [1.0], b"")[1] == 0
    assert [r.handle for r in store.suggestions(people, "A").collect()] == ["alex"] and "embedding" not in store.saved_people(people).columns
    flags = {r.id: (r.ready, r.duplicate) for r in store.person_flags(people, "mai", 1).collect()}
    assert flags == {1: (True, False), 2: (True, True), 3: (False, False)}


def test_tolerant_source_and_migrations(spark):
    (row,) = library.from_rows(spark.createDataFrame([(42, 0), (43, 1)], "_id long, is_pending int")).collect()
    assert row.uri.endswith("/42") and row.dateModified == 0 and row.displayName is None
    with pytest.raises(ValueError):
        library.from_rows(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        library.scan(spark, "/tmp/no-such-library")
    with pytest.raises(ValueError, match="uri"):
        conform(spark.range(1), MEDIA)
    with pytest.raises(Exception, match="unknown mediaType"):
        allowed(spark.createDataFrame([("SOUND",)], "mediaType string"), "mediaType").collect()
    first = {"media_embeddings": media_rows(spark, [(1, (1, 0), None, 0)]), "search_history": spark.createDataFrame([(1, "q", 1, None)], "id long, query string, timestamp long, topResultUri string")}
    out = migrate(first, 1)
    assert set(out) == {"media_embeddings", "search_history", "people", "face_index", "face_embeddings", "photo_text"} and out["search_history"].first().searchMode == "HYBRID"
    second = first | {"people": album_people(spark)}
    assert migrate(second, 2)["people"].first().embeddingModel == IMAGE_MODEL


def album_people(spark):
    return spark.createDataFrame([(1, "A", "a", bytearray(b"t"), [1.0], 1)], "id long, name string, handle string, thumbnail binary, embedding array<float>, embeddingDimension int")


def test_pairs_in_blocks(spark):
    v = np.random.default_rng(3).normal(size=(60, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, embedding array<double>")
    got = {(r.left_id, r.right_id) for r in search.similar_pairs(df.where("id % 10 = 0"), df, 0.5, 4).collect()}
    assert got == {(i, j) for i in range(0, 60, 10) for j in range(60) if v[i] @ v[j] >= 0.5}


def test_images(spark):
    rng = np.random.default_rng(5)
    flat = np.full((30, 50, 3), 77, np.uint8)
    assert np.allclose(images.center_crop(flat, 16), 77 / 255, atol=1e-6) and images.center_crop(flat, 16).shape == (3, 16, 16)
    same = rng.integers(0, 256, (16, 16, 3)).astype(np.uint8)
    assert np.allclose(images.center_crop(same, 16), same.transpose(2, 0, 1) / 255, atol=1e-6)
    assert np.allclose(images.face_input(same, (1, 0, 0, 0), 16), (same.transpose(2, 0, 1) - 127.5) / 127.5, atol=1e-5)
    assert np.allclose(images.face_input(same, (1, 0, -100, 0), 16), -1)
    padded = images.detector_input(same, 32)
    assert padded.shape == (3, 32, 32) and np.allclose(images.detector_input(flat, 50)[:, :30], (77 - 127.5) / 128) and np.allclose(images.detector_input(flat, 50)[:, 31:], -127.5 / 128)
    assert images.resized(100, 50, 10) == (20, 10) and images.resized(50, 101, 10) == (10, 20)
    good = b"P6 2 1 255\n" + bytes(range(6))
    df = spark.createDataFrame([(bytearray(good),), (bytearray(b"broken"),)], "b binary")
    done = df.withColumn("result", images.kernel(images.raw_rgb, lambda p: p.mean(axis=(0, 1)))(F.col("b")))
    ok, bad = planning.split_errors(done)
    assert [list(r.value) for r in ok.collect()] == [[1.5, 2.5, 3.5]] and "PPM" in bad.first().error


def contract():
    root = {}
    for path, value in contracts.REQUIRED.items():
        *parents, last = path.split(".")
        at = root
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    root["image_encoder"] |= {"input_name": "i", "output_name": "o", "model_file": "a.onnx", "mean": [0, 0, 0], "std": [1, 1, 1]}
    root["text_encoder"] |= {"input_name": "i", "output_name": "o", "model_file": "b.onnx"}
    root["tokenizer"] |= {"regex": ".", "regex_ignore_case": True, "sot_token": "<s>", "eot_token": "<e>", "sot_token_id": 1, "eot_token_id": 2, "padding_value": 0, "vocab_file": "v.json", "merges_file": "m.txt", "merge_count": 5}
    root["tokenizer_test_vectors"] = [{"text": "x", "input_ids": [0] * 77}]
    return root


def test_contracts(spark, tmp_path):
    import json

    assert contracts.read_config(json.dumps(contract()))["tokenizer"]["merge_count"] == 5
    for path, value in (("model.name", "Other"), ("image_encoder.std", [0, 1, 1]), ("tokenizer.vocab_file", "../v"), ("tokenizer.merge_count", 0), ("image_encoder.input_shape", ["batch", 3, 256])):
        root = contract()
        head, last = path.split(".")
        root[head][last] = value
        with pytest.raises(contracts.ContractError):
            contracts.read_config(json.dumps(root))
    outputs = [contracts.Output("y", True, (-1, 512)), contracts.Output("z", True, (1, 4))]
    assert contracts.resolve_output("y", 512, outputs) == contracts.resolve_output("other", 512, outputs) == "y"
    for name, options in (("z", outputs), ("other", outputs[:1] * 2)):
        with pytest.raises(contracts.ContractError):
            contracts.resolve_output(name, 512, options)
    assert contracts.matches(["batch", 3], ["batch", 3]) and not contracts.matches(["batch", 3], ["batch", "3"])
    (tmp_path / "merges.txt").write_text("#version: 0.2\nt h\n\n th e</w> \nonly\n")
    assert [(r.first, r.second, r["rank"]) for r in contracts.merge_list(spark, str(tmp_path / "merges.txt")).orderBy("rank").collect()] == [("t", "h", 0), ("th", "e</w>", 1)]
    names = [*text.byte_alphabet().values(), *(c + "</w>" for c in text.byte_alphabet().values()), "th", "the</w>", "<s>", "<e>"]
    described = contract() | {"tokenizer_test_vectors": [{"text": "The t", "input_ids": [514, 513, names.index("t</w>"), 515] + [0] * 73}]}
    described["tokenizer"] |= {"vocab_size": 516, "merge_count": 2, "sot_token_id": 514, "eot_token_id": 515, "regex": text.BytePairs.PATTERN}
    merges, vocabulary = contracts.merge_list(spark, str(tmp_path / "merges.txt")), json.dumps({n: i for i, n in enumerate(names)})
    assert contracts.read_tokenizer(described, vocabulary, merges).ids("the")[:3] == [514, 513, 515]
    for key, value in (("merge_count", 3), ("sot_token_id", 1)):
        with pytest.raises(contracts.ContractError):
            contracts.read_tokenizer(described | {"tokenizer": described["tokenizer"] | {key: value}}, vocabulary, merges)
    with pytest.raises(contracts.ContractError, match="example 0"):
        contracts.read_tokenizer(described | {"tokenizer_test_vectors": [{"text": "x", "input_ids": [0] * 77}]}, vocabulary, merges)
    files = library.images(spark, str(tmp_path))
    digest = files.select(F.sha2("content", 256)).first()[0]
    assert contracts.with_checksum(files, {"merges.txt": digest}).count() == 1
    with pytest.raises(Exception, match="wrong checksum"):
        contracts.with_checksum(files, {"merges.txt": "0"}).select("sha256").collect()
