"""Errors as rows: mentions, checksums and types."""

import pytest

from prismlake import schemas
from prismlake.functions import contracts
from prismlake.operators import asking
from prismlake.plans import query as plans


def test_asked_people(spark):
    people = spark.createDataFrame([("mai", [1.0], "v1"), ("alex", [2.0], "old"), ("bo", [3.0], "v1")], "handle string, embedding array<double>, embeddingModel string")
    typed = {1: "@bo and @MAI, @bo", 2: "@zoe with @alex and @ann", 3: "@alex @mai", 4: "the sea", 5: None, 6: "a@mai"}
    rows = asking.asked_people(spark.createDataFrame(list(typed.items()), "id long, query string"), people, "v1").collect()
    got = {r.id: (r.people, r.error) for r in rows}
    assert got == {1: ([[3.0], [1.0]], None), 2: (None, "unknown @zoe, @ann"), 3: (None, "update the face photo of @alex"), 4: (None, None), 5: (None, None), 6: (None, None)}


def test_checksums_and_types(spark):
    files = spark.createDataFrame([("a/x", bytearray(b"1")), ("a/y", bytearray(b"2")), ("z", bytearray(b"")), ("n", None)], "path string, content binary")
    one = "6b86b273ff34fce19d6b804eff5a3f5747ada4eaa22f1d49c01e52ddb7875b4b"
    expected = spark.createDataFrame([("x", one.upper()), ("y", one), ("n", one)], "name string, sha256 string")
    got = {r.path: (r.sha256, r.error) for r in contracts.checksums(files, expected).collect()}
    assert got == {"a/x": (one, None), "a/y": (None, "wrong checksum of y"), "z": (None, "no checksum of z"), "n": (None, "no content of n")}
    rows = spark.createDataFrame([(1, "IMAGE"), (2, "AUDIO"), (3, None)], "i int, t string")
    assert [r.error for r in schemas.split_allowed(rows, "t").orderBy("i").collect()] == [None, "unknown t: AUDIO", None]


def test_checks_are_those_of_single_queries(spark):
    """The same answers, error for error, as building each query alone."""
    people = spark.createDataFrame([("mai", [1.0], "v1"), ("alex", [2.0], "old"), ("bo", [3.0], "v1")], "handle string, embedding array<double>, embeddingModel string")
    texts = ["a beach", "", None, "@mai", "@", "the sea @", " !? ", "@mai menu", "@nobody, @alex", "@alex", "x@mai", "@" + "a" * 41, "@MAI and @Bo!", "...", "Đường ĐI", " ".join(f"w{i}" for i in range(65)), "@a\u0301\u0323\u0337", "@ma\u0301i", "@@mai"]
    cases = [(i, t, mode, reference) for i, (t, mode, reference) in enumerate((t, m, r) for t in texts for m in ("NORMAL", "OCR") for r in (False, True))]
    got = {r.id: r for r in asking.checked(spark.createDataFrame(cases, "id int, query string, mode string, reference boolean"), people, "v1").collect()}
    people_vectors = plans.people_vectors

    def alone(typed, mode, reference):
        try:
            built = plans.build(typed or "", plans.Filters(mode=mode), people, encode_text=lambda t: [1.0], references=[[1.0]] if reference else [])
        except plans.QueryError as error:
            return str(error)
        except ValueError as error:
            return str(error)
        return (len(built.people), list(built.words), built.vector is not None)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(plans, "people_vectors", lambda p, h: people_vectors(p, h, "v1"))
        for i, typed, mode, reference in cases:
            r = got[i]
            mine = r.error or (len(r.people or []), list(r.words), r.wantsVector)
            assert mine == alone(typed, mode, reference), (typed, mode, reference)
